import base64
import gzip
import hashlib
import itertools
import random

import numpy as np
import pytest

from keelson.llm import decontaminate, kernel, warc

SF = "/root/testdata/sf0.01"


def expect(pages, revisit_from=0):
    owner = {}
    for i, h in pages:
        if i is not None:
            owner[h or ""] = max(owner.get(h or "", i), i)
    out = []
    for i, h in pages:
        raw, own = (h or "").encode(), owner.get(h or "")
        other = own is not None and i != own and len(raw) >= revisit_from
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if other else "response", own if other else None))
    return sorted(out, key=str)


PAGES = [(1, None, None), (2, "", "u\r\nx"), (3, "<p>é</p>", "http://a"), (4, "<p>é</p>", "http://b"), (4, "<p>é</p>", "http://b"), (None, "<p>é</p>", None), (None, "only null", None), (9, "WARC/1.1\r\n\r\n\x1f\u008b\x08" * 9, "u"), (10, "x" * 3_000_000, "u")]


@pytest.mark.parametrize("least", [0, 5])
def test_archives_of_odd_pages(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, html string, url string").selectExpr("*", "'z' as payload", "1 as digest")
    got = sorted((tuple(r) for r in warc.query(pages, least).collect()), key=str)
    assert got == expect([p[:2] for p in PAGES], least)
    assert warc.query(pages.limit(0)).count() == 0


@pytest.mark.parametrize("split", [1, 1000, 50_000, 1 << 30])
def test_reader_reads_every_record_once(spark, tmp_path, split):
    rng = random.Random(split)
    raw, n = b"", 0
    for i in range(60 if split > 1 else 4):
        body = bytes(rng.randrange(256) for _ in range(rng.choice([0, 10, 2000]))) + warc.MAGIC * rng.randrange(3)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        raw += warc.member(warc.record(i, f"http://x/{i}", "response", digest, len(body), body, None))
        n += 1
    path = tmp_path / f"{split}.warc.gz"
    path.write_bytes(raw)
    files = [(f"file://{path}", len(raw))]
    if split == 1:
        source = warc._Source(files[0][0])
        starts = [a for a in range(len(raw)) if warc.next_record(source, a, a + 1) is not None]
        assert len(starts) == n
    else:
        rows = warc.read(spark.createDataFrame(files, "path string, size long"), split).collect()
        assert sorted(r.page_id for r in rows) == list(range(n))
        assert all(hashlib.sha1(bytes(r.payload)).digest() == base64.b32decode(r.payload_digest) for r in rows)
    assert gzip.decompress(raw).count(b"WARC-Type: response") >= n


def test_a_cut_archive_is_an_error(spark, tmp_path):
    raw = warc.member(warc.record(1, None, "response", base64.b32encode(hashlib.sha1(b"a" * 999).digest()).decode(), 999, b"a" * 999, None))
    (tmp_path / "cut").write_bytes(raw[:-9])
    with pytest.raises(Exception, match="cut off"):
        warc.read(spark.createDataFrame([(f"{tmp_path}/cut", len(raw) - 9)], "path string, size long")).collect()


def test_archives_on_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    doubled = pages.union(pages.selectExpr("page_id + 100000", "url", "html").where("page_id % 3 = 1"))
    got = sorted((tuple(r) for r in warc.query(doubled).collect()), key=str)
    assert got == expect([(r.page_id, r.html) for r in doubled.collect()])


def test_owners_meet_in_a_shuffle_and_files_roll(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "BROADCAST_OWNERS", 0)
    pages = spark.createDataFrame(PAGES, "page_id long, html string, url string")
    assert sorted((tuple(r) for r in warc.query(pages).collect()), key=str) == expect([p[:2] for p in PAGES])
    files = warc.write(warc.with_classes(pages.coalesce(1)), f"file://{tmp_path}/rolled", file_bytes=300)
    assert files.count() > 3
    assert sorted((tuple(r)[:5] for r in warc.read(files).collect()), key=str) == expect([p[:2] for p in PAGES])


# ---- decontamination


def words(text):
    import re

    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def brute(docs, items):
    """Every item on every diagonal of every document, word by word."""
    out = {}
    for doc, text in docs:
        d = words(text)
        for item, item_text in items:
            b = words(item_text)
            if len(b) < decontaminate.SHORTEST or doc is None or item is None:
                continue
            for diagonal in range(-len(b) + 1, len(d)):
                same = [0 <= k + diagonal < len(d) and d[k + diagonal] == w for k, w in enumerate(b)]
                stretch = min(decontaminate.MIN_WORDS, len(b))
                most = max(sum(same[k : k + stretch]) for k in range(len(b) - stretch + 1))
                if most >= decontaminate.MIN_MATCH * stretch:
                    out[doc, item] = max(out.get((doc, item), (0, 0)), (most, sum(same)))
    return sorted((*k, *v) for k, v in out.items())


def planted():
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefg") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([40, 25, 13, 12, 11, 8, 7, 1])] + [(50, ""), (51, None), (None, "a b c d e f g h i j k l m n")]
    docs = [(i, " ".join(word() for _ in range(60))) for i in range(20)] + [(100, None), (101, ""), (None, items[0][1]), (102, "É! " * 30_000)]
    for k, (_, text) in enumerate(items[:8]):
        own = text.split()
        for share in (0, 0.08, 0.2, 0.4):
            copy = [word() if rng.random() < share else w for w in own]
            docs.append((200 + 10 * k + int(share * 20), " ".join([word() for _ in range(k)] + copy + [word() for _ in range(9)]).upper().replace(" ", " -- ", 3)))
        docs.append((300 + k, " ".join(own[: len(own) // 2])))
        docs.append((400 + k, " ".join([text] * 3)))
    docs.append(docs[-1])
    return docs, items


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WORDS, 0])
def test_overlaps_against_brute_force(spark, limit):
    docs, items = planted()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as seed", "1 as item_id")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as doc_id")
    got = sorted((r.doc_id, r.item_id, r.matched_stretch, r.matched_words) for r in decontaminate.overlaps(d, b, broadcast_words=limit).collect())
    assert got == brute(docs, items)
    assert len(got) > 15
    assert decontaminate.overlaps(d.limit(0), b, broadcast_words=limit).count() == decontaminate.overlaps(d, b.limit(0), broadcast_words=limit).count() == 0
    bad = {x[0] for x in got}
    kept = decontaminate.stage(d, b, broadcast_words=limit)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} - {None} == {x[0] for x in docs} - bad - {None}


def test_seed_hashes_ignore_masked_words():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 30).astype(kernel.U)
    for mask in {m for own in decontaminate.MASKS.values() for m in own}:
        want = decontaminate.seed_hashes(h, mask)
        for p, bit in enumerate(mask):
            other = h.copy()
            other[5 + p] += kernel.U(1)
            assert (decontaminate.seed_hashes(other, mask)[5] == want[5]) == (bit == "0")


def test_masks_hit_whatever_words_are_unequal():
    for n in range(2, decontaminate.MIN_WORDS + 1):
        allowed = max(x for x in range(n) if n - x >= decontaminate.MIN_MATCH * n)
        masks = decontaminate.masks_of(n, decontaminate.MIN_WORDS, decontaminate.MIN_MATCH)
        assert masks == decontaminate.MASKS[n, allowed] and (n < 6 or any("0" in m for m in masks))
        places = [{k + p for p, bit in enumerate(m) if bit == "1"} for m in masks for k in range(n - len(m) + 1)]
        for unequal in itertools.combinations(range(n), allowed):
            assert any(not x & set(unequal) for x in places), (n, unequal)
    assert decontaminate.masks_of(50, 30, 0.9) == ("1" * 7,)


def accepted(docs, items):
    """Every item on every diagonal of every document, by MIN_MATCH alone."""
    out = set()
    for doc, text in docs:
        d = words(text)
        for item, item_text in items:
            b = words(item_text)
            stretch = min(decontaminate.MIN_WORDS, len(b))
            for diagonal in range(-len(b) + 1, len(d)):
                same = [0 <= k + diagonal < len(d) and d[k + diagonal] == w for k, w in enumerate(b)]
                if max(sum(same[k : k + stretch]) for k in range(len(b) - stretch + 1)) >= decontaminate.MIN_MATCH * stretch:
                    out.add((doc, item))
    return out


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_WORDS, 0])
def test_no_accepted_overlap_is_missed(spark, limit):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(n, " ".join(word() for _ in range(n))) for n in (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 20, 25, 59)]
    copies = []
    for _, text in items:
        own = text.split()
        copies += [[w if (k + phase) % every else word() for k, w in enumerate(own)] for every in (3, 4, 5) for phase in range(every)]
        copies += [[word() if rng.random() < share else w for w in own] for share in (0, 0.1, 0.2) for _ in range(8)]
        copies += [[word(), *own[1:]], own[:-3], own[3:]]
    # at the start, in the middle and at the end of a document
    docs = [(i, " ".join([word() for _ in range(i % 3 * 4)] + c + [word() for _ in range(i % 2 * 5)])) for i, c in enumerate(copies)]
    docs.append((-1, " ".join(f"{text} {word()}" for _, text in items)))
    want = accepted(docs, items)
    got = decontaminate.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_words=limit)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert {n for _, n in want} == {n for n, _ in items}


def test_hits_in_small_rounds_are_the_same(monkeypatch):
    words = np.array([1, 2, 1, 1, 2, 1, 2, 1, 1, 1, 1, 2, 1, 2, 2] * 30, kernel.U)
    first = np.array([0, 0, 100, 300, 300, 450])
    b = decontaminate.Benchmark.of(np.arange(3), words[:60], np.array([0, 20, 25, 60]), 13, 0.75)
    want = decontaminate.find(words, first, b, 13, 0.75)
    monkeypatch.setattr(decontaminate, "HITS", 7)
    assert decontaminate.find(words, first, b, 13, 0.75) == want
    assert {(r, i) for r, i, _, _ in want} == {(r, i) for r in (1, 2, 4) for i in range(3)}


def test_stage_is_the_same_for_any_size(spark):
    docs, items = planted()
    docs += [(None, docs[3][1]), (None, items[1][1]), (None, None), (3, items[0][1]), (3, docs[3][1]), (7, None), (7, items[1][1])]
    bad = {text for (_, text), hit in zip(docs, [accepted([(0, t)], [(i, x) for i, x in items if i is not None and len(words(x)) > 1]) for _, t in docs], strict=True) if hit}
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((r for r in docs if r[1] not in bad), key=str)
    assert len(bad) > 10 and sum(i is None for i, _ in want) == 2
    for limit in (decontaminate.BROADCAST_WORDS, 0):
        kept = decontaminate.stage(d, b, broadcast_words=limit)
        assert kept.columns == d.columns
        assert sorted((tuple(r) for r in kept.collect()), key=str) == want
