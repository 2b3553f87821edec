import functools
import hashlib
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import chat, huffman, kernel, langid, quality, unigram

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " "), (4, "  two  words\n\nand ünï ▁ 東京 😀 \t end "), (5, "same"), (5, "same"), (None, "no id"), (7, "x" * 300_000), (8, "word " * 60_000), (9, "123 !!! ###")]


def table(spark, rows=ODD):
    from pyspark.sql import functions as F

    # columns that clash with names the operators use
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("lang", "ids", "n_tokens", "score", "lang_pred", "start", "source")})


def with_lang(spark, rows=ODD):
    from pyspark.sql import functions as F

    return table(spark, rows).withColumn("lang", F.when(F.col("doc_id") == 5, "aa").when(F.col("doc_id") == 8, "bb"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB \n\té東😀"), max_size=40)), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    import re

    data, offsets = kernel.buffers(pa.array(texts, pa.string()))
    for piece in (7, 1 << 19):
        old, kernel.PIECE = kernel.PIECE, piece
        h, s, e, first = kernel.words(data, offsets)
        kernel.PIECE = old
        own = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) for t in texts]
        assert np.diff(first).tolist() == [len(x) for x in own]
        flat = [w for x in own for w in x]
        assert len(set(zip(h.tolist(), flat, strict=True))) == len(set(flat)) == len(set(h.tolist()))


# ---- chat formatting


def test_chat_reads_back_what_was_written(spark):
    control = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", control), (1, 1, "assistant", None), (1, 2, "assistant", "a\\\\#<b:"), (2, None, None, "x"), (2, 5, "od:d <text> \\", "### x <text> y </turn>\n"), (2, 5, "od:d <text> \\", "### x <text> y </turn>\n"), (None, 1, "assistant", "é" * 50_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as rendered", "'y' as head")
    got = {r.conv_id: r for r in chat.query(turns).collect()}
    for conv in (1, 2, None, -7):
        own = [r for r in [*rows, *chat.PROBE] if r[0] == conv]
        digest = hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), digest)
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    texts = chat.example_texts(chat.segments(chat.format_turns(turns))).where("conv_id = 1").orderBy("target_turn").collect()
    assert [t.target for t in texts] == ["", "a\\\\\\\\\\#\\<b:"]
    assert texts[1].context.startswith("### user <text> \\\\\\#\\#\\# Assistant: \\</turn> ok </turn>\n### assistant <text>  </turn>\n")
    assert chat.query(turns.limit(0)).count() == 1


def test_chat_finds_turns_by_the_marks_alone(spark, monkeypatch):
    """Texts and roles that hold the marks, streams cut into many segments, ids beyond a double's whole numbers beside a null id."""
    big = 9007199254740993
    odd = [" </turn>\n", "### ", " <text> ", "\\", "\\ </turn>\n### assistant <text> x", "", "<", "a <text> b </turn>\n", "é\u2028\n"]
    rows = [(conv, k, r, t) for conv in (big, None, 3) for k, (r, t) in enumerate([(r, t) for t in odd for r in ("user", "assistant", " </turn>\n <text> ")])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for size in (1, 60, 1 << 16):
        monkeypatch.setattr(chat, "SEGMENT", size)
        got = {r.conv_id: r for r in chat.query(turns).collect()}
        assert got.keys() == {big, None, 3, -7}
        for conv in (big, None, 3):
            own = [r for r in rows if r[0] == conv]
            assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in own).encode()).hexdigest()
            assert got[conv].loss_sha256 == hashlib.sha256("".join(r[3] for r in own if r[2] == "assistant").encode()).hexdigest()
            assert got[conv].n_examples == len(odd)
    examples = chat.examples(chat.segments(chat.format_turns(turns))).where(f"conv_id = {big}").orderBy("target_turn").collect()
    assert [e.target for e in examples] == odd and [e.context_end for e in examples] == sorted(e.context_end for e in examples)


def test_chat_on_the_table(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    want = {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn)):
        want.setdefault(r.conv_id, []).append(r)
    got = {r.conv_id: r for r in chat.query(turns).collect()}
    assert got.keys() == want.keys() | {-7}
    for k, own in want.items():
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r.role}\n{r.text}\n" for r in own).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256("".join(r.text for r in own if r.role == "assistant").encode()).hexdigest()
        assert got[k].n_examples == sum(r.role == "assistant" for r in own)


# ---- classifiers


def test_quality_on_rows_kept_from_training(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.query(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    right = [np.mean([r.predicted == k for r in held if r.quality == k]) for k in (0, 1)]
    assert min(right) > 0.9, right
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_of_odd_tables(spark):
    labels = spark.createDataFrame([(5, 1, 0), (3, 0, 0), (3, 0, 0), (8, None, 0), (None, 1, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.query(table(spark), labels).count() == len(ODD)
    assert {r.score for r in quality.query(table(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.query(table(spark).limit(0), labels).count() == 0


def test_language_on_rows_kept_from_training(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.query(docs).join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in rows if r.held_out]) > 0.98
    assert langid.stage(docs).count() >= 0.99 * docs.count()
    assert langid.stage(docs).columns == docs.columns


def test_language_rejects_what_it_has_not_learned(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    junk = ["xqzjv kwpfg hjkqw zzxcv bnmqp wrtyp sdfgh", "Все люди рождаются свободными и равными", "人人生而自由在尊严和权利上一律平等", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności", "Zqxw " * 50_000]
    model = langid.train(docs)
    assert langid.predict(table(spark, list(enumerate(junk))).drop("lang"), model).where("lang_rejected").count() == len(junk)
    for unlearned in ("de", "es", "fr"):
        learned = docs.withColumn("lang", F.when(F.col("lang") != unlearned, F.col("lang")))
        got = langid.predict(docs, langid.train(learned))
        share = {r.other: r.share for r in got.groupBy((F.col("lang") == unlearned).alias("other")).agg(F.avg(F.col("lang_rejected").cast("int")).alias("share")).collect()}
        assert share[True] > 0.95 and share[False] < 0.01, (unlearned, share)


def test_language_of_odd_tables(spark):
    rows = langid.query(with_lang(spark)).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert len(rows) == len(ODD)
    assert got[1] == got[2] == got[3] == got[9] == ("und", 0.0)
    assert {got[k][0] for k in (5, 8)} <= {"aa", "bb"}  # those of the two that are in a learning fold
    kept = {r.doc_id for r in langid.stage(with_lang(spark)).collect()}
    assert not kept & {1, 2, 3, 9}
    assert langid.query(with_lang(spark).limit(0)).count() == 0


# ---- unigram


def small_model(kind=1):
    """A Unigram model file of a few pieces, without (kind 1) or with byte pieces."""
    field = lambda key, raw: bytes([key << 3 | 2]) + varint(len(raw)) + raw

    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    words = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "é", "aé", "▁▁", "cab", "aa", "aaa", "東"]
    pieces += [(w, -1.0 - 0.3 * i % 2.9, 1) for i, w in enumerate(words)]
    body = b"".join(field(1, field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + bytes([3 << 3, k])) for p, s, k in pieces)
    trainer = bytes([3 << 3, kind]) + varint(35 << 3) + b"\x01"
    normalizer = field(1, b"identity") + bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1])
    return body + field(2, trainer) + field(3, normalizer)


def brute_viterbi(text, pieces, scores, unknown):
    text = (" " + text.replace("▁", " ")).replace(" ", "▁") if text else ""
    best = {0: (0.0, [])}
    for s in range(len(text)):
        for e in range(s + 1, len(text) + 1):
            w = text[s:e]
            if w not in pieces and e - s > 1:
                continue
            c = best[s][0] + (scores[pieces[w]] if w in pieces else unknown)
            if e not in best or c > best[e][0]:
                best[e] = (c, [*best[s][1], (pieces.get(w, -1), w)])
    return [x for i, w in best[len(text)][1] for x in ([i] if i >= 0 else [3 + b for b in w.encode()])]


@pytest.mark.parametrize("real", [False, True])
def test_unigram_is_the_best_segmentation(real):
    raw = open(unigram.default_model(), "rb").read() if real else small_model()
    model = unigram.load(raw)
    pieces, is_unigram = unigram.read_model(raw)
    scores = unigram.log_scores(pieces, is_unigram)
    known = {p: i for i, (p, _, k) in reversed(list(enumerate(pieces))) if k == 1}
    texts = ["", "abc", "  aaaa bca", "cab▁ab  x", "aé東東z\nab", "the quick brown fox, über 東京 😀", "a" * 30, None]
    ids, at = unigram.encode(pa.array(texts, pa.string()), model)
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        want = brute_viterbi(t or "", known, scores, model.unknown_score)
        total = lambda x: sum(scores[i] for i in x)
        assert ids[a:b].tolist() == want or np.isclose(total(ids[a:b]), total(want))
    data, ends = unigram.decode(ids, at, model)
    for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        assert data[a:b].tobytes().decode() == (t or "").replace("▁", " ")


def test_unigram_agrees_with_the_library():
    import sentencepiece

    raw = small_model()
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    model = unigram.load(raw)
    texts = ["abc", "aaaa bca", "cab ab", "aé東東z ab", "bcabc abab ccc", "q 東é"]
    ids, at = unigram.encode(pa.array(texts), model)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode(t) for t in texts]
    assert [library.decode(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)] == texts


def test_unigram_of_odd_tables(spark):
    rows = unigram.query(table(spark)).collect()
    assert len(rows) == len(ODD)
    assert all(r.round_trip for r in rows if r.doc_id != 4)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {0}
    texts = unigram.decode_column(unigram.encode_column(table(spark))).collect()
    assert sorted((r.doc_id or 0, r.text) for r in texts) == sorted((i or 0, (t or "").replace("▁", " ")) for i, t in ODD)
    assert unigram.query(table(spark).limit(0)).count() == 0


# ---- token files


def brute_lengths(counts, limit):
    """Optimal limited lengths by trying all multisets is out of reach; plain Huffman where it fits the limit."""
    import heapq

    heap = [(c, i, [i]) for i, c in enumerate(counts) if c]
    heapq.heapify(heap)
    depth = [0] * len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[2] + b[2]:
            depth[i] += 1
        heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
    return depth


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=2, max_size=40), st.integers(6, 16))
def test_code_lengths(counts, limit):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts, limit)
    used = counts > 0
    assert (lengths[~used] == 0).all() and (lengths[used] > 0).all() and lengths.max(initial=0) <= limit
    if used.sum() > 1:
        assert sum(2.0 ** -int(x) for x in lengths[used]) == 1
        best = np.array(brute_lengths(counts.tolist(), limit))
        if best.max() <= limit:
            assert (counts * lengths).sum() == (counts * best).sum()
        else:
            assert (counts * lengths).sum() >= (counts * best).sum()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=700), max_size=8))
def test_bits_round_trip(docs):
    ids = np.array([i for d in docs for i in d], np.int64)
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=31))
    bits, size, marks = huffman.pack(ids, at, huffman.canonical_codes(lengths), lengths)
    assert huffman.unpack(bits, size, np.diff(at), marks, *huffman.decode_table(lengths)).tolist() == ids.tolist()


def library_rows(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(huffman.default_tokenizer())
    start, out = 0, []
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_of_odd_tables(spark):
    rows = [*ODD, (10, "<|endoftext|> it's İ ǅ ﬁ a\u0301 \u0301x Ｆ１"), (11, "\u00a0nbsp\u2003em\u3000wide\x1f\x85")]
    got = sorted(tuple(r) for r in huffman.query(table(spark, rows)).collect() if r.doc_id not in (None, 5))
    ordered = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    assert got == [r for r in library_rows(ordered) if r[0] not in (None, 5)]
    assert huffman.query(table(spark).limit(0)).count() == 0


def test_token_files_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(tuple(r) for r in huffman.query(docs).collect())
    assert got == library_rows(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_token_files_in_many_files(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    monkeypatch.setattr(huffman, "BLOCK_TOKENS", 20_000)
    tokens = huffman.tokenize(docs).cache()
    code = huffman.Code(huffman.code_lengths(huffman.count_ids(tokens)))
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/many"
    index = huffman.write_files(tokens, folder, code, file_tokens=100_000)
    assert len(os.listdir(folder.removeprefix("file://"))) > 5
    ids = {r.doc_id: bytes(r.ids) for r in tokens.collect()}
    rows = sorted(huffman.read_blocks(index).collect())
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    assert {r.doc_id: bytes(r.ids) for r in rows} == ids


def test_ids_of_very_many_rows_have_several_parts_and_files(spark):
    rows = [(None if k % 3 else 7, f"text {k % 50} of words w{k * 7919 % 1000} " * (k % 5)) for k in range(600)] + [(-4, "first but for the nulls"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tokens = huffman.tokenize(docs)
    code = huffman.Code(huffman.code_lengths(huffman.count_ids(tokens)))
    index = huffman.write_files(tokens, f"{spark.conf.get('spark.checkpoint.dir')}/hot", code, file_tokens=500, file_bytes=1)
    assert index.select("path").distinct().count() > 8
    got = sorted(huffman.read_blocks(index).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    key = [-(1 << 63) if r.doc_id is None else r.doc_id for r in got]
    assert key == sorted(key)
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(r.doc_id), bytes(r.ids)) for r in tokens.collect())
    cuts = huffman.Cuts.of([5, 5, 5, 5, 9])
    assert cuts.ids.tolist() == [5, 5, 5, 5, 9] and cuts.bytes.tolist() == [0, 64, 128, 192, 0]
    byte = np.array([255, 0, 64, 255, 0, 0, 0])
    assert cuts.part(np.array([4, 5, 5, 5, 8, 9, 10]), lambda which: byte[which]).tolist() == [0, 1, 2, 4, 4, 5, 5]


# ---- scores against plain loops


def plain_features(text):
    """The features of one text, byte by byte and word by word."""
    raw = (text or "").encode()
    kinds = {k: 0 for k in ("upper", "lower", "digit", "space", "newline", "bar", "bang", "mark", "stop", "other", "symbol")}
    for b in raw:
        c = chr(b)
        kind = "lower" if b >= 128 or "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digit" if "0" <= c <= "9" else "newline" if c == "\n" else "space" if c in " \t\x0b\x0c\r" else "bar" if c == "|" else "bang" if c == "!" else "mark" if c in "*#$%&@^~=" else "stop" if c in ".,;:?" else "symbol" if c in "<>{}[]\\/_+" else "other"
        kinds[kind] += 1
    share = {k: v / max(1, len(raw)) for k, v in kinds.items()}
    words, word = [], b""
    for b in raw + b" ":
        if b in b" \t\n\x0b\x0c\r":
            words += [word] * bool(word)
            word = b""
        else:
            word += bytes([b + 32 if 65 <= b <= 90 else b])
    n = len(words)
    repeated = sum(x == y for x, y in zip(words, words[1:], strict=False)) / max(1, n)
    mean = sum(map(len, words)) / max(1, n)
    seen = [share[k] > at for k, at in (("upper", 0.15), ("digit", 0.1), ("bar", 0.02), ("bang", 0.02), ("mark", 0.03), ("symbol", 0.05))]
    return [*(v**0.5 for v in share.values()), *map(float, seen), repeated, float(repeated > 0.2), np.log1p(n), min(mean, 40) / 10, float(n < 5)]


def test_quality_scores_are_those_of_plain_loops(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    m = quality.train(docs, labels)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()] + ODD
    got = sorted(((r.doc_id, r.quality_score) for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()), key=str)
    want = []
    for doc, text in rows:
        raw = sum((f - c) / s * w for f, c, s, w in zip(plain_features(text), m.centre, m.scale, m.weights, strict=True))
        z = m.slope * (raw - m.threshold) + np.log(0.3 / 0.7)
        want.append((doc, 1 / (1 + np.exp(-min(30, max(-30, z))))))
    assert [g for g, _ in got] == [w for w, _ in sorted(want, key=str)]
    assert sorted(x for _, x in got) == pytest.approx(sorted(x for _, x in want), abs=1e-9)


def test_language_scores_are_those_of_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = langid.train(docs)
    rows = [(i, t) for i, t in docs.select("doc_id", "text").limit(150).collect()] + [(i, t) for i, t in ODD if t is None or len(t) < 1000]
    got = langid.predict(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()
    assert len(got) == len(rows)
    by_text = {r.text: r for r in got}
    for _, text in rows:
        raw = [b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in (text or "").encode()]
        total, count, known = np.zeros(len(m.langs)), 0, 0
        for k, n in enumerate((3, 4)):
            for i in range(len(raw) - n + 1):
                if set(raw[i : i + n]) != {32}:
                    key = sum(b << (8 * j) for j, b in enumerate(raw[i : i + n]))
                    h = ((key * 0x9E3779B1) & 0xFFFFFFFF) ^ (key >> 15)
                    h = ((h * 0x85EBCA6B) & 0xFFFFFFFF) >> 12
                    total += m.logits[(h + (k << 20)) >> 7]
                    count, known = count + 1, known + bool(m.known[h + (k << 20)])
        z = (total / max(1, count) + m.bias) / m.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        r = by_text[text]
        if any(c.isalpha() for c in text or ""):
            assert r.lang_pred == m.langs[int(p.argmax())] and r.lang_score == pytest.approx(p.max(), abs=1e-4)
            assert r.lang_rejected == ((known + 20) / (count + 20) < m.reject_below)
        else:
            assert (r.lang_pred, r.lang_score, r.lang_rejected) == ("und", 0.0, True)


def test_the_language_stage_keeps_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit("mine") for c in ("lang_pred", "lang_score", "lang_rejected")})
    kept = langid.stage(docs)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.select("lang_pred", "lang_score", "lang_rejected").distinct().collect()} == {("mine",) * 3}


# ---- hashes


def _even_odd(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


#: Two words whose polynomial hashes modulo a power of two are equal, whatever the base.
TWINS = (_even_odd(2048), _even_odd(2048).translate(str.maketrans("ab", "ba")))


def test_words_with_one_polynomial_hash_stay_apart(spark):
    from keelson.llm import decontaminate, partenum

    data, offsets = kernel.buffers(pa.array(TWINS))
    assert len(set(kernel.words(data, offsets)[0].tolist())) == 2
    text = lambda w: " ".join([w, *"cdefghijklmno"])
    docs = spark.createDataFrame([(k, text(w)) for k, w in enumerate(TWINS)], "doc_id long, text string")
    assert [r.component_id for r in partenum.query(docs, 4, 85).orderBy("doc_id").collect()] == [0, 1]
    ids = [r.ids_crc32 for r in huffman.query(docs).orderBy("doc_id").collect()]
    assert ids[0] != ids[1]
    assert all(r.round_trip for r in unigram.query(docs).collect())
    one = spark.createDataFrame([(1, f"{TWINS[0]} zz")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.overlaps(spark.createDataFrame([(k, f"{w} zz") for k, w in enumerate(TWINS)], "doc_id long, text string"), one).collect()] == [0]


def test_a_memo_hit_needs_the_same_bytes():
    """All units get one hash: each still gets its own ids, also beyond 16 bytes and after the memo was cleared."""
    words = ["a", "b", "ab", "abcdefgh" * 2 + "x", "abcdefgh" * 2 + "y", "abcdefghi", "abcdefgh1" * 5, "abcdefgh1" * 4 + "abcdefgX1", "a", "", "a\0"]
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(w) for w in raw])
    starts = ends - [len(w) for w in raw]
    for hashes in (np.full(len(raw), 7, np.uint64), kernel.span_hashes(data, starts, ends), np.arange(len(raw), dtype=np.uint64) % 3):
        pool = kernel.Pool(limit=4)
        for _ in range(3):
            units = kernel.Units(data, starts, ends, hashes)

            def encode(which):
                own = [np.frombuffer(raw[k], np.uint8).astype(np.int32) for k in which]
                return np.concatenate([*own, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)

            at, n = pool.find(units, encode)
            assert [bytes(pool.ids[a : a + k].astype(np.uint8)) for a, k in zip(at, n, strict=True)] == raw


def test_unigram_search_of_many_new_units_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    words = ["".join(map(chr, w)) for w in rng.integers(97, 123, (200_000, 9))]
    with open(unigram.default_model(), "rb") as f:
        m = unigram.load(f.read())
    texts = pa.array([" ".join(words[i : i + 20_000]) for i in range(0, len(words), 20_000)])
    tracemalloc.start()
    ids, at = unigram.encode(texts, m)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    data, ends = unigram.decode(ids, at, m)
    assert [data[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:], strict=True)] == texts.to_pylist()


@functools.cache
def _public_tokenizer():
    from tokenizers import Tokenizer

    with open(huffman.default_tokenizer(), encoding="utf-8") as f:
        content = f.read()
    return Tokenizer.from_str(content), huffman.joints(content)


def _encoded(texts):
    tokenizer, kinds = _public_tokenizer()
    data, offsets = kernel.buffers(pa.array(texts, pa.string()))
    pool = kernel.Pool()
    ids, at = huffman.encode(data, offsets, tokenizer, pool, kinds)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)], [tokenizer.encode(t, add_special_tokens=False).ids for t in texts], pool


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aZs.,'-=_(1<|≯́KéİΣσ \n東😀", "'ll", "'S", "<|endoftext|>", "<|ENDOFTEXT|>", "endoftext", "word"]), max_size=12).map("".join), max_size=5))
def test_words_cut_from_signs_have_the_library_s_ids(texts):
    own, want, _ = _encoded(texts)
    assert own == want


def test_words_and_signs_beside_them_are_encoded_once():
    words = [chr(97 + i) + chr(97 + j) for i in range(10) for j in range(10)]
    own, want, pool = _encoded([" ".join(a + w + b for w in words) for a in ("", "(", '"') for b in ("", ",", ".", "!", '")')])
    assert own == want
    assert pool.units < 120  # 1,500 if signs stay with the words


def test_signs_of_added_tokens_and_unknown_tokenizers_are_not_cut():
    with open(huffman.default_tokenizer(), encoding="utf-8") as f:
        content = f.read()
    kinds = huffman.joints(content)
    assert not kinds[list(b"<|>'0\n ")].any() and kinds[ord("a")] == 1 and kinds[ord(",")] == 2
    assert not huffman.joints(content.replace('"ByteLevel"', '"Other"')).any() and not huffman.joints('{"pre_tokenizer": null}').any()
