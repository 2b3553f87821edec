import random
import re

import numpy as np
import pyarrow as pa
import pytest

from keelson.llm import partenum

SF = "/root/testdata/sf0.01"


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(docs, n, percent):
    """Every pair that shares a shingle, by an index over shingles, joined by a union-find."""
    sets = [shingles(t, n) for _, t in docs]
    index, up = {}, list(range(len(docs)))
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    seen = set()
    for own in index.values():
        for a in own:
            for b in own:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                        up[root(b)] = root(a)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(docs)), key=str)


def made(seed, n=120):
    """Chains of edits around the threshold, copies, passages that many share, tiny texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and".split()) if rng.random() < 0.2 else "".join(rng.choice("abcd") for _ in range(4))
    passage = [word() for _ in range(60)]
    docs = [None, "", " \n", "one", "one", "ONE ", "two words", "a b c d", "A b\tc d", "a b c d e", "é É", "É é"]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5 and len(docs) > 15:
            own = (rng.choice(docs[12:]) or "").split()
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                if own:
                    own[rng.randrange(len(own))] = word()
            docs.append(" ".join(own))
        elif kind < 0.7:
            docs.append(" ".join(passage + [word() for _ in range(rng.randrange(12, 60))]))
        else:
            docs.append(" ".join(word() for _ in range(rng.choice([5, 20, 60, 150]))))
    return [(i * 7 % 1000 - 100, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 85), (2, 5, 80), (3, 2, 70)])
def test_components_against_brute_force(spark, seed, n, percent):
    docs = made(seed)
    docs += [(None, docs[30][1]), (None, None), docs[40], docs[40]]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as class", "1 as sig", "2 as n_shingles").repartition(3)
    assert sorted((tuple(r) for r in partenum.query(df, n, percent).collect()), key=str) == brute(docs, n, percent)


def test_on_the_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert sorted((tuple(r) for r in partenum.query(rows).collect()), key=str) == brute([tuple(r) for r in rows.collect()], 4, 85)


def test_texts_meet_classes_in_a_shuffle_too(spark, monkeypatch):
    monkeypatch.setattr(partenum, "BROADCAST_CLASSES", 0)
    docs = made(9)
    df = spark.createDataFrame([*docs, (None, docs[50][1])], "doc_id long, text string")
    assert sorted((tuple(r) for r in partenum.query(df).collect()), key=str) == brute([*docs, (None, docs[50][1])], 4, 85)
    want = {d for d, _, c in brute(docs, 5, 80) if d == c}
    kept = partenum.stage(df)
    assert {r.doc_id for r in kept.collect()} - {None} == want and kept.columns == df.columns


def test_empty_table(spark):
    assert partenum.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    table = rng.integers(0, 15, 1 << partenum.BITS).astype(np.uint8)
    for size in [1, 2, 3, 5, 6, 7, 9, 14, 30, 77, 200, 900, 1020, 3000]:
        for _ in range(25):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            differ = rng.integers(0, size * (100 - percent) // percent + 1)
            grown = rng.integers(0, differ + 1)
            b = np.concatenate([a[differ - grown :], rng.integers(0, 2**63, grown).astype(np.uint64)]) if rng.random() < 0.5 else np.concatenate([a, rng.integers(0, 2**63, differ).astype(np.uint64)])
            shared = len(np.intersect1d(a, b))
            if 100 * shared < percent * (len(a) + len(b) - shared):
                continue
            at = np.array([0, len(a), len(a) + len(b)])
            for levels in (None, table):
                found = [{}, {}]
                for row, sig, _ in partenum.signatures(np.concatenate([a, b]), at, percent, levels):
                    for r, s in zip(row.tolist(), sig.tolist(), strict=True):
                        found[r].setdefault(s & 127, set()).add(s)
                later = partenum.plan(partenum.bands(3600)[1:] - 1, percent)[2]
                # more are shared than each may leave out by whatever order
                assert any(len(found[0][x] & found[1][x]) > later[x] for x in found[0].keys() & found[1].keys())
            s = partenum.sketch(np.concatenate([a, b]), at).view(np.uint64)
            assert sum(int(x).bit_count() for x in s[0] ^ s[1]) <= len(a) + len(b) - 2 * shared
            assert partenum.sketch_difference(*partenum.wide_sketches(np.concatenate([a, b]), at)) <= len(a) + len(b) - 2 * shared


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    df = spark.createDataFrame([e if i % 2 else e[::-1] for i, e in enumerate(edges)], "a long, b long")
    assert {r.node: r.root for r in partenum.components(df).collect()} == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_sets_by_slices():
    texts = ["a b c d e", None, "x", "", "a b c d a b c d"]
    (lo, s, at), = partenum.sets_of(pa.array(texts), 4)
    assert lo == 0 and np.diff(at).tolist() == [len(shingles(t, 4)) for t in texts]


def test_few_links_are_joined_without_further_files(spark, monkeypatch):
    rng = random.Random(5)
    edges = [(rng.randrange(-300, 300) << 40, rng.randrange(-300, 300) << 40) for _ in range(280)] + [(i, i + 1) for i in range(1, 60)]
    up = {}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up.get(a, a), up.get(b, b))
    df = spark.createDataFrame(edges, "a long, b long")
    written = []
    monkeypatch.setattr(partenum, "materialize", lambda frame, what, own=partenum.materialize: written.append(what) or own(frame, what))
    assert {r.node: r.root for r in partenum.components(df).collect()} == up
    assert written == ["edges"]
    monkeypatch.setattr(partenum, "FEW_EDGES", 0)
    assert {r.node: r.root for r in partenum.components(df).collect()} == up
    assert len(written) > 2
    empty = partenum.components(df.limit(0))
    assert empty.columns == ["node", "root"] and not empty.count()
