"""What a search makes: phrases meet texts by their words, pairs are not dealt anew."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from threadloom.operators import context, retrieval


def test_phrases_of_words_are_not_held_against_every_text(spark, monkeypatch):
    rng = random.Random(3)
    words = ["a", "ab", "b", "ba", "é", "straße", "x_1", "the", "of", "b́"]
    marks = [" ", "  ", "-", ", ", "\n", "..", "\U0001d54f ", " 😀 "]
    text = lambda n: rng.choice(["", "(", " "]) + "".join(rng.choice(words) + rng.choice(marks) for _ in range(n))
    texts = [(i, text(rng.randint(0, 25))) for i in range(150)] + [(900, None), (901, ""), (902, "b ab")]
    phrases = [(i, text(rng.randint(0, 5))) for i in range(60)]
    for i in range(60, 300):
        whole = rng.choice(texts[:150])[1]
        begin = rng.randrange(len(whole) + 1)
        phrases.append((i, whole[begin : begin + rng.randint(0, 22)]))
    blocks = []
    kept = retrieval.stated_blocks
    monkeypatch.setattr(retrieval, "stated_blocks", lambda table: (blocks.append(block) or block for block in kept(table)))
    found = retrieval.holding(spark.createDataFrame(texts, "doc long, text string"), "doc", "text", spark.createDataFrame(phrases, "q long, p string"), "q", "p").collect()
    expected = {(d, q) for d, t in texts if t is not None for q, p in phrases if p and p in t}
    assert {tuple(r) for r in found} == expected and len(found) == len(expected) > 500
    assert len({q for _, q in expected if len([w for w in phrases[q][1].split() if w.isalnum()]) > 2}) > 20
    assert not [r for block in blocks for r in block if len(r.p.split()) > 1 and all(w.isalpha() for w in r.p.split())]


def test_pairs_of_a_query_and_a_unit_are_not_shuffled(spark):
    units = spark.range(400).select(F.col("id").cast("string").alias("unit_id"), F.concat(F.lit("alpha beta w"), F.col("id")).alias("content"))
    queries = spark.createDataFrame([(i, f"alpha q{i}", 3) for i in range(40)], "query_id long, query string, most long")
    found = retrieval.scores(units, queries.drop("most"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(unit_id" in plan and "hashpartitioning(query_id" not in plan
    assert found.count() == 16_000
    best = retrieval.matches(units, queries)
    assert best.count() == 120 and {r.unit_id for r in best.collect()} == {"0", "1", "10"}
    assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()


def test_candidates_of_planning_queries_are_told_once(spark, monkeypatch):
    written = {}
    kept = context.stored
    monkeypatch.setattr(context, "stored", lambda df, name, **more: written.setdefault(name, kept(df, name, **more)))
    texts = [(f"u{i:03}", "message", f"s{i}", "p", "user", f"alpha must stay w{i}" if i % 2 else f"w{i} else") for i in range(60)]
    units = spark.createDataFrame(texts, "unit_id string, source_type string, source_id string, path string, role string, content string")
    # The first echoes one of its units; a target makes it a seed all the same, for that query alone.
    asked = [(0, "alpha must stay w1 plan"), *[(i, "alpha plan") for i in range(1, 40)], (40, "alpha")]
    units = units.unionByName(spark.createDataFrame([("echo", "message", "se", "p", "tool", "so Alpha must stay w1 PLAN it")], units.schema))
    edges = spark.createDataFrame([("u002", 0, "references", None, "u001"), ("u004", 1, "supersedes", "echo", "u004"), ("u006", 0, "references", None, "u004")], "owner string, nth int, kind string, source string, target string")
    targets = spark.createDataFrame([(5, "echo"), (0, "u000")], "query_id long, target string")
    found = context.pack_candidates(units, spark.createDataFrame(asked, "query_id long, query string"), edges, targets).collect()
    rows = {(r.query_id, r.unit_id): r for r in found}
    assert len(rows) == len(found)
    odd = {f"u{i:03}" for i in range(1, 60, 2)}
    assert {u for q, u in rows if q == 0} == odd | {"u000", "u002"}
    assert {u for q, u in rows if q == 1} == odd | {"echo", "u002", "u004"} == {u for q, u in rows if q == 5}
    assert {u for q, u in rows if q == 40} == odd | {"u002"}
    assert rows[1, "u004"].signals == "final_state" and rows[1, "u004"].score == 55.0 and not rows[1, "u004"].decided
    assert rows[5, "echo"].signals == "lexical_overlap,explicit_target" and rows[1, "echo"].signals == "lexical_overlap"
    assert rows[1, "u001"].signals == "lexical_overlap,decision_context" and rows[0, "u000"].signals == "explicit_target"
    # Signs, not pairs: of 60 units and 41 queries, less than a fifth of the candidates.
    assert written["pack-every"].count() < len(rows) / 5
