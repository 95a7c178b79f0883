"""SimHash components and repeated passages against brute force."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from threadloom.llm import line_chunks, simhash

from . import cases
from .plain_lines import cut_stretch, plain_rows


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius=3):
    values = sorted(set(values))
    a = np.array(values, dtype=np.uint64)
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= radius) + i + 1:
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return {v: values[find(i)] for i, v in enumerate(values)}


def check_components(rows, docs):
    fps = [plain_fingerprint(t) for _, t in docs]
    assert sorted((str(r.doc_id), r.fingerprint) for r in rows) == sorted((str(d[0]), f"{fp:016x}") for d, fp in zip(docs, fps, strict=True))
    label = plain_components(fps)
    least = {}
    for (doc_id, _), fp in zip(docs, fps, strict=True):
        if doc_id is not None:
            least[label[fp]] = min(doc_id, least.get(label[fp], doc_id))
    expected = sorted((str(d[0]), str(least.get(label[fp]))) for d, fp in zip(docs, fps, strict=True))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == expected


def test_components_of_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_components(simhash.components_digest(docs).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_components_of_awkward_rows(spark):
    check_components(simhash.components_digest(cases.docs(spark)).collect(), [r[:2] for r in cases.ROWS])
    assert simhash.components_digest(cases.empty(spark)).collect() == []


def clustered(seed, count, centres):
    pick = random.Random(seed)
    base = [pick.getrandbits(64) for _ in range(centres)]
    out = []
    for _ in range(count):
        v = pick.choice(base)
        for _ in range(pick.randint(0, 5)):
            v ^= 1 << pick.randrange(64)
        out.append(v)
    return sorted(set(out))


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 6])
def test_one_bucket_against_popcount(radius):
    values = clustered(radius, 400, 6)
    root = simhash.compare_bucket(np.array(values, dtype=np.uint64), radius, queries=32)
    assert {v: values[r] for v, r in zip(values, root.tolist(), strict=True)} == plain_components(values, radius)


def test_many_small_buckets_against_popcount():
    values = np.array(clustered(9, 500, 40), dtype=np.uint64)
    buckets = np.sort(np.random.default_rng(2).integers(0, 60, len(values)))
    a, b = simhash.compare_neighbours(values, buckets, 3)
    expected = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if buckets[i] == buckets[j] and bin(int(values[i] ^ values[j])).count("1") <= 3}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == expected


@pytest.mark.parametrize("large", [4096, 60, 12])
def test_links_in_hot_buckets_are_whole(spark, monkeypatch, large):
    values = clustered(large, 700, 3) + clustered(1, 200, 150)
    table = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in set(values)], "fp long")
    original = simhash.bucketed
    monkeypatch.setattr(simhash, "bucketed", lambda v, r: original(v, r, large))
    label = {r.node: r.label for r in simhash.components(simhash.links(table)).collect()}
    groups = defaultdict(set)
    for v in set(values):
        n = int(np.uint64(v).view(np.int64))
        groups[label.get(n, n)].add(v)
    expected = defaultdict(set)
    for v, root in plain_components(values).items():
        expected[root].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(90)] + [(200, 300)], "fp long, root long")
    label = {r.node: r.label for r in simhash.components(path).collect()}
    assert label == {**dict.fromkeys(range(91), 0), 200: 200, 300: 200}


def removal(docs):
    rows = line_chunks.remove_repeated_passages(docs).collect()
    return sorted([(str(r.doc_id), r.passages.text, r.passages.n_chunks, len(r.passages.removed), r.passages.n_checked) for r in rows], key=str)


def test_passages_of_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = removal(docs)
    assert rows == plain_rows([tuple(r) for r in docs.select("doc_id", "text").collect()])
    # What only the check finds here are lines that follow each other again and again within one document.
    assert sum(r[2] for r in rows) > 100 and 4 * sum(r[4] for r in rows) < sum(r[3] for r in rows)


def test_passages_sql_twin(spark):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    ours = line_chunks.passages_digest(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert sorted(map(tuple, ours.collect())) == sorted(con.execute(line_chunks.DIGEST_SQL).fetchall())


def test_shifted_passage_is_found():
    pick = random.Random(4)
    stretch = [(i, " ".join(f"w{pick.randrange(10**6)}" for _ in range(9)), 9) for i in range(60)]
    whole = cut_stretch(stretch, [0] + [2] * 59)
    later = cut_stretch(stretch[7:], [0] + [2] * 52)
    lines = [[tuple(x[1] for x in c) for c in chunks] for chunks in (whole, later)]
    assert len(whole) > 8 and sum(len(c) for c in set(lines[0]) & set(lines[1])) > 40


AWKWARD = [
    *cases.ROWS,
    (20, "\n\n\n", "en", "a", 3),
    (21, "\n\n\n", "en", "a", 3),
    (22, "Bx\nCy\nB\nC\n" * 30, "en", "a", 3),
    (23, "Bx\nCy\nB\nC\n" * 30, "en", "a", 3),
    (None, "Bx\nCy\nB\nC\n" * 30, "en", "a", 3),
    (None, ("long " * 60) + "\nend", "en", "a", 3),
    (24, ("long " * 60) + "\nother", "en", "a", 3),
]


def test_passages_of_awkward_rows(spark):
    assert removal(cases.docs(spark, AWKWARD)) == plain_rows([r[:2] for r in AWKWARD])
    many = "\n".join(f"line {i}" for i in range(100_000))
    (row,) = line_chunks.without_repeated(cases.docs(spark, [(1, many, "en", "a", 1), (2, many + "\nmore", "en", "a", 1)])).filter("doc_id = 2").collect()
    assert row.text == "more"
    clashing = cases.docs(spark, AWKWARD).withColumnsRenamed({"kept": "passages", "hash": "runs", "key": "row", "spans": "all"})
    assert line_chunks.remove_repeated_passages(clashing).columns[-1] == "passages" and line_chunks.without_repeated(clashing).columns == clashing.columns
    assert len(line_chunks.remove_repeated_passages(clashing).collect()) == len(line_chunks.without_repeated(clashing).collect()) == len(AWKWARD)
    assert line_chunks.passages_digest(cases.empty(spark)).collect() == []
    cleaned = line_chunks.without_repeated(cases.docs(spark, AWKWARD))
    assert cleaned.schema == cases.docs(spark).schema and cleaned.count() == len(AWKWARD)
    assert cleaned.filter("n_chars <> length(text)").count() == 0


def test_same_result_by_shuffled_joins(spark, monkeypatch):
    small = sorted(map(str, line_chunks.passages_digest(cases.docs(spark, AWKWARD)).collect()))
    monkeypatch.setattr(line_chunks, "size_checked", lambda table, *a, **b: table.hint("merge"))
    assert sorted(map(str, line_chunks.passages_digest(cases.docs(spark, AWKWARD)).collect())) == small
