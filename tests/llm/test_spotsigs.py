import hashlib
import itertools
import re

import pytest

from keelson.llm import spotsigs

SF = "/root/testdata/sf0.01"


def chains(text):
    low = text.lower()
    words = [w for w in re.split(r"[\W_]+", low) if w]
    anchors = set(spotsigs.ANCHORS)
    out = set()
    for i, w in enumerate(words):
        if w in anchors and i + 1 < len(words) and words[i + 1] not in anchors:
            content = (words[k] for k in range(i + 1, len(words)) if words[k] not in anchors)
            out.add(" ".join(itertools.islice(content, spotsigs.CHAIN)))
    return out or ({" ".join(words)} if words else {low} if low else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, texts):
    """texts in order."""
    assert len(rows) == len(texts)
    got = {(r.doc_id, r.edited_sha256): r for r in rows}
    prints = {}
    for i, (doc, text) in enumerate(texts):
        text, after = text or "", texts[(i + 1) % len(texts)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        r = got[doc, hashlib.sha256(edited.encode()).hexdigest()]
        assert r.n_chars == len(text)
        a, b, c = chains(text), chains(edited), chains(after)
        assert r.n_signatures == len(a)
        for near, other in ((r.near_edited, b), (r.near_next, c)):
            pruned = min(len(a), len(other)) < spotsigs.LEAST * max(len(a), len(other))
            assert near == pytest.approx(0.0 if pruned else jaccard(a, other), abs=1e-9)
        # likenesses are those of the reported fingerprints
        signatures = lambda print_: {print_[k : k + 16] for k in range(0, len(print_), 16)}
        assert r.near_edited == pytest.approx(jaccard(signatures(r.fingerprint), signatures(r.edited_fingerprint)), abs=1e-9)
        assert prints.setdefault(r.fingerprint, a) == a
        assert prints.setdefault(r.edited_fingerprint, b) == b


def test_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check(spotsigs.query(docs.repartition(5)).collect(), sorted((r.doc_id, r.text) for r in docs.collect()))


def test_odd_rows(spark):
    texts = [(None, "first the null key"), (-5, None), (1, ""), (2, "### !!"), (3, "the"), (4, "no anchors here " * 3), (5, "The quick brown fox of the über straße y 東京 is it"), (6, "same of text now"), (6, "same of text now"), (8, "the long word " * 30_000), (9, "x"), (10, "The " * 60_000 + "end of all")]
    docs = spark.createDataFrame(texts[::-1], "doc_id long, text string").selectExpr("*", "'z' as bucket", "1 as key", "'a' as sigs")
    check(spotsigs.query(docs).collect(), texts)
    assert spotsigs.query(docs.limit(0)).count() == 0
    check(spotsigs.query(docs.where("doc_id = 5")).collect(), [t for t in texts if t[0] == 5])


def test_a_short_text_beside_a_long_one_has_its_exact_likeness(spark):
    texts = [(1, "the first word0 of it"), (2, " ".join(f"the word{i} more{i}" for i in range(100)) + " the first word0")]
    a, b = (chains(t) for _, t in texts)
    got = {r.doc_id: r.near_next for r in spotsigs.query(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert 0 < jaccard(a, b) < 0.02
    assert got == pytest.approx({1: jaccard(a, b), 2: jaccard(a, b)}, abs=1e-9)


@pytest.mark.parametrize("size", [1, 3])
def test_small_buckets(spark, size, monkeypatch):
    texts = [(i * i - 50, f"the word{i} of thing{i % 7} and more{i % 3}") for i in range(90)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in spotsigs.with_neighbours(docs, size).where("ghost = 0").collect()}
    assert got == {d: texts[(i + 1) % len(texts)][1] for i, (d, _) in enumerate(texts)}


def test_pairs_are_all_those_above_the_threshold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 150")
    prints = spotsigs.with_signatures(docs.withColumnRenamed("doc_id", "fp"), "text", "sigs").select("fp", "sigs")
    sets = {r.fp: set(r.sigs) for r in prints.collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r.fp_a, r.fp_b) for r in spotsigs.similar_pairs(prints).collect()} == want and want


def test_plan_has_no_python(spark):
    plan = spotsigs.query(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert plan.count("Exchange hashpartitioning") == 1
