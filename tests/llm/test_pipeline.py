import corpus_pipeline
import pyarrow as pa
from test_partenum import brute as brute_groups
from test_secrets import base, linked
from test_warc_and_benchmark import words

from keelson.llm import decontaminate, langid, secrets, unigram

SF = "/root/testdata/sf0.001"


def masked(text):
    spans = sorted((a, b) for a, k, b in base(text) + linked(text, secrets.SCOPE) if k < 4)
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def leaks(text, items):
    """Whether some item's stretch overlaps, on any diagonal."""
    d = words(text)
    place = {}
    for i, w in enumerate(d):
        place.setdefault(w, []).append(i)
    for item in items:
        b = words(item)
        if len(b) < decontaminate.SHORTEST:
            continue
        votes = {}
        for k, w in enumerate(b):
            for i in place.get(w, ()):
                votes[i - k] = votes.get(i - k, 0) + 1
        for diagonal, v in votes.items():
            if v < 2:
                continue
            same = [0 <= k + diagonal < len(d) and d[k + diagonal] == w for k, w in enumerate(b)]
            stretch = min(decontaminate.MIN_WORDS, len(b))
            if max(sum(same[k : k + stretch]) for k in range(len(b) - stretch + 1)) >= decontaminate.MIN_MATCH * stretch:
                return True
    return False


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    rejected = {r.doc_id for r in langid.predict(docs, langid.train(docs)).where("lang_rejected").collect()}
    left = [(i, t) for i, t in sorted(rows.items()) if i not in rejected]
    left = [(i, t) for (i, t), (_, _, c) in zip(left, sorted(brute_groups(left, 5, 80)), strict=True) if i == c]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [(i, masked(t)) for i, t in left if not leaks(t, items)]
    with open(unigram.default_model(), "rb") as f:
        model = unigram.load(f.read())
    ids, at = unigram.encode(pa.array([t for _, t in left]), model)
    want = {i: ids[a:b].tolist() for (i, _), a, b in zip(left, at[:-1], at[1:], strict=True)}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
    assert 0.5 * len(rows) < len(got) < len(rows)


def test_stages_keep_the_columns_and_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "plain words of one text", "en", "s", 23), (3, "plain words of one text", "en", "s", 23), (None, "no id here at all", "en", None, None), (5, "token = abcdefgh123", "en", "s", 19)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    for name, stage in corpus_pipeline.STAGES:
        for own in (docs, docs.limit(0)):
            out = stage(spark, own, SF)
            assert out.columns == (["doc_id", "ids"] if name == corpus_pipeline.STAGES[-1][0] else docs.columns)
            if own is not docs:
                assert out.count() == 0
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.count() == len(rows)  # rows of one id are one document


def test_masking_changes_what_it_says(spark):
    docs = spark.createDataFrame([(1, "x token = abcdefgh123 y", "en", "s", 23)], "doc_id long, text string, lang string, source string, n_chars long")
    row = corpus_pipeline.mask_secrets(spark, docs, SF).first()
    assert (row.text, row.n_chars) == ("x [secret] y", 12)
