"""Near copies against every pair of shingle sets."""

import random

import numpy as np
import pytest

from threadloom.llm import near_copies
from threadloom.llm.near_copies import NearCopies

from . import cases


def plain_sets(docs):
    def grams(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    return {i: grams(t) for i, t in docs}


def plain_pairs(sets):
    """Pairs of ids at a Jaccard similarity of 0.8 or more; two empty texts are alike."""
    ids, found = sorted(sets), []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or (x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y)):
                found.append((a, b))
    return found


def plain_kept(docs):
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in plain_pairs(plain_sets(docs)):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i for i in root if find(i) == i}


def edited(pick, words, share):
    out = []
    for w in words:
        turn = pick.random()
        if turn < share / 3:
            continue
        out.append(f"e{pick.randrange(10**6)}" if turn < 2 * share / 3 else w)
        if turn > 1 - share / 3:
            out.append(f"n{pick.randrange(10**6)}")
    return out


def planted(seed, groups=60, share=0.012):
    pick = random.Random(seed)
    docs, i = [], 0
    for _ in range(groups):
        base = [f"w{int(pick.paretovariate(0.7)) % 5000}" for _ in range(pick.randint(60, 400))]
        docs.append((i, " ".join(base)))
        for k in range(pick.randint(1, 4)):
            docs.append((i + k + 1, " ".join(edited(pick, base, pick.uniform(0.002, share)))))
        i += 10
    return docs


@pytest.mark.parametrize("group_shingles", [4_000_000, 300])
def test_recall_and_precision_on_edits(spark, group_shingles):
    docs = planted(1)
    kept = {r.doc_id for r in near_copies.keep_one(spark.createDataFrame(docs, "doc_id long, text string"), p=NearCopies(group_shingles=group_shingles)).collect()}
    expected = plain_kept(docs)
    copies = {i for i, _ in docs} - expected
    assert len(copies) > 80 and len(copies - kept) >= 0.95 * len(copies)
    assert expected <= kept


def test_recall_on_real_texts(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    kept = {r.doc_id for r in near_copies.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    expected = plain_kept(docs)
    copies = {i for i, _ in docs} - expected
    assert len(copies - kept) >= 0.9 * len(copies) and expected <= kept


def test_all_candidates_of_large_buckets_meet(spark, monkeypatch):
    docs = planted(2, 12)
    whole = {r.doc_id for r in near_copies.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    original = near_copies.sampled_buckets
    monkeypatch.setattr(near_copies, "sampled_buckets", lambda values, p: original(values, p, 4))
    monkeypatch.setattr(near_copies, "size_checked", lambda table, *a, **b: table.hint("merge"))
    assert {r.doc_id for r in near_copies.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == whole


def test_awkward_rows(spark):
    docs = cases.docs(spark).withColumnsRenamed({"kept": "row", "hash": "node", "key": "fp", "spans": "row_key"})
    found = near_copies.keep_one(docs)
    assert found.columns == docs.columns
    ids = sorted((str(r.doc_id), r.text) for r in found.select("doc_id", "text").collect() if r.text != cases.LONG)
    # Texts without words are one group, of which id 1 is the least; rows that repeat stay once.
    assert [i for i, _ in ids] == ["1", "5", "7", "8", "8", "None"]
    assert near_copies.keep_one(cases.empty(spark)).collect() == []


def test_shingles_of_short_texts():
    assert len(near_copies.shingles([], 5)) == 0
    assert len(near_copies.shingles([b"a", b"b"], 5)) == 1
    assert len(near_copies.shingles([b"a"] * 9, 5)) == 1
    assert isinstance(near_copies.shingles([b"a"] * 9, 5), np.ndarray)


@pytest.mark.parametrize("hot", [100, 1])
def test_no_pair_is_lost(spark, hot):
    pick = random.Random(9)
    line = " ".join(f"common{i}" for i in range(12))
    docs = [(i, f"{text} {line}" if pick.random() < 0.5 else text) for i, text in planted(5, 80, 0.045)]
    p = NearCopies(**({"hot": hot} if hot != 100 else {}))
    kept = {r.doc_id for r in near_copies.keep_one(spark.createDataFrame(docs, "doc_id long, text string"), p=p).collect()}
    expected = plain_kept(docs)
    assert kept == expected and 20 < len(docs) - len(expected) < len(docs) - 80
