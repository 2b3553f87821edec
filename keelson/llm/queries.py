"""The registered query of each operator, with production parameters, and oracle SQL."""

from __future__ import annotations

from keelson.llm import chat, decontaminate, huffman, langid, partenum, quality, secrets, spotsigs, unigram, warc
from keelson.llm.common import read


def op1_secret_scan(spark, sf_dir):
    return secrets.query(read(spark, sf_dir, "documents"))


def op2_chat_formatting(spark, sf_dir):
    return chat.query(read(spark, sf_dir, "conversations"))


def op3_quality_ranking(spark, sf_dir):
    return quality.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_spotsigs(spark, sf_dir):
    return spotsigs.query(read(spark, sf_dir, "documents"))


def op5_partenum_join(spark, sf_dir):
    return partenum.query(read(spark, sf_dir, "documents"))


def op6_warc(spark, sf_dir):
    return warc.query(read(spark, sf_dir, "pages"))


def op7_decontamination(spark, sf_dir):
    return decontaminate.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_unigram_encoding(spark, sf_dir):
    return unigram.query(read(spark, sf_dir, "documents"))


def op9_huffman_files(spark, sf_dir):
    return huffman.query(read(spark, sf_dir, "documents"))


def op10_language_id(spark, sf_dir):
    return langid.query(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_chat_formatting, op3_quality_ranking, op4_spotsigs, op5_partenum_join, op6_warc, op7_decontamination, op8_unigram_encoding, op9_huffman_files, op10_language_id)}
ORACLE_SQL: dict[str, str] = {"op2_chat_formatting": chat.ORACLE, "op5_partenum_join": partenum.ORACLE, "op6_warc": warc.ORACLE, "op7_decontamination": decontaminate.ORACLE}
