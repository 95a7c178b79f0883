"""Passages of several lines between unlike neighbours, against windows of lines in plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threadloom.llm import line_chunks

from .plain_lines import plain_passages


def plain_runs(docs, most=50):
    """Every line within a run of lines of over ``most`` words that stands earlier too is gone."""
    lines = {i: [(no, x) for no, x in enumerate((t or "").split("\n")) if x.split()] for i, t in docs}
    first, met = {}, []
    for i in sorted(lines):
        for a in range(len(lines[i])):
            words = 0
            for b in range(a, len(lines[i])):
                words += len(lines[i][b][1].split())
                if words > most:
                    run = tuple(x for _, x in lines[i][a : b + 1])
                    met.append((i, lines[i][a][0], lines[i][b][0], run))
                    first.setdefault(run, (i, lines[i][a][0]))
    gone = {i: set() for i in lines}
    for i, low, high, run in met:
        if first[run] < (i, low):
            gone[i] |= set(range(low, high + 1))
    return {i: "\n".join(x for no, x in enumerate((t or "").split("\n")) if no not in gone[i]) for i, t in docs}


def planted(seed):
    pick = random.Random(seed)
    line = lambda n: " ".join(f"w{pick.randrange(10**6)}" for _ in range(n))
    docs, i = [], 0
    for n_lines, n_words in ((2, 30), (3, 20), (4, 15), (6, 40), (6, 9), (5, 10), (2, 25)) * 4:
        passage = [line(n_words) for _ in range(n_lines)]
        for _ in range(pick.randint(2, 3)):
            docs.append((i, "\n".join([line(8), line(9), *passage, line(7)])))
            i += 1
        docs.append((i, "\n".join([line(8), *passage[1:], *passage[:-1], "", line(7)])))
        i += 1
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_of_few_lines_are_found(spark, seed):
    docs = planted(seed)
    cleaned = {r.doc_id: r.text for r in line_chunks.without_repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert cleaned == {key[0]: row[0] for key, row in plain_passages(docs).items()}
    runs = plain_runs(docs)
    assert all(set(text.split("\n")) <= set(runs[i].split("\n")) for i, text in cleaned.items())
    left = " ".join(cleaned.values()).split()
    assert len(set(left)) == len(set(" ".join(t for _, t in docs).split()))
    # The passage is gone whole from the second document, between neighbours that stay.
    assert cleaned[1].count("\n") == 2


def test_every_shared_run_is_gone(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plain = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, small)
    text = {r.doc_id: r.text for r in found.collect()}
    assert text == {key[0]: row[0] for key, row in plain_passages(plain).items()} and found.columns == docs.columns
    runs = plain_runs([(i, t) for i, t in plain if t is not None])
    assert all(not Counter((text[i] or "").split("\n")) - Counter(t.split("\n")) for i, t in runs.items())


def test_bytes_decide(spark, monkeypatch):
    """Places that are taken for equal by their digests stay where their bytes differ."""
    docs = planted(3)
    monkeypatch.setattr(line_chunks, "_identity", lambda digests: F.unhex(F.md5(F.size(digests).cast("string").cast("binary"))))
    cleaned = {r.doc_id: r.text for r in line_chunks.without_repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    left = " ".join(cleaned.values()).split()
    assert len(set(left)) == len(set(" ".join(t for _, t in docs).split()))
