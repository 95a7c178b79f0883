"""Hand-computed rows of repository search and order, section grading, and plans that must not degrade."""

import time

from pyspark.sql import functions as F

from threadloom.functions import text
from threadloom.operators import grading, lookups, retrieval


def test_repository_scores_by_hand(spark):
    files = spark.createDataFrame(
        [("src/Cart.py", "total add", "the cart adds. Cart the the the the the THE end"), ("the/b.py", "", "nothing"), ("c.py", "cartful", "x"), ("d.py", None, None)],
        "path string, symbols string, content string",
    )
    queries = spark.createDataFrame([(1, "the cart"), (2, "cart cart"), (3, " cart"), (4, "?!"), (5, "a"), (6, None)], "query_id long, query string")
    found = {(r.query_id, r.path): r.score for r in retrieval.repository_scores(files, queries).collect()}
    # Stop words count: "the" stands seven times, which counts five; the phrase adds ten.
    assert found[1, "src/Cart.py"] == (10 + 2) + 5 + 10 and found[1, "the/b.py"] == 10 and found[1, "c.py"] == 8
    # A repeated word counts again; "cart cart" stands nowhere as it is.
    assert found[2, "src/Cart.py"] == 2 * 12 and found[2, "c.py"] == 16
    # The query is not trimmed: with its space it stands in the text.
    assert found[3, "src/Cart.py"] == 12 + 10 and found[3, "c.py"] == 8
    assert not [q for q, _ in found if q in (4, 6)]
    # Words stand inside words: "a" in path, symbols (total add) and text (cart adds cart); it is the whole query too.
    assert found[5, "src/Cart.py"] == 10 + 8 + 3 + 10


def test_equal_ratios_go_by_score(spark):
    rows = [(1, "b", 1, 10, 100), (1, "a", 1, 5, 50), (1, "c", 1, 1000001, 10000000), (1, "d", 1, 1000000, 10000000), (1, "z", 0, 0, 5)]
    files = spark.createDataFrame(rows, "query_id long, path string, tier int, score long, tokens long")
    found = [r.path for r in lookups.repository_order(files, 4).orderBy("place").collect()]
    assert found == ["z", "c", "d", "b"]


HEADINGS = ("Goal", "Open points")


def test_sections_by_hand(spark):
    answers = spark.createDataFrame(
        [
            (0, 1, "Queues here\n## GOAL:\nUse the queue.\nKeep retries bounded\r\n**Open points**\nretries drop events"),
            (0, 2, "no heading, retries bounded, queues, never drop events"),
            (0, 3, "> goal -\n\nopen points\ndrop event"),
            (0, 4, ""),
        ],
        "fixture long, answer_id long, text string",
    )
    facts = spark.createDataFrame(
        [
            (0, "queue", "Goal", True, [["queues"], ["topic", "log"]], []),
            (0, "retry", "Goal", False, [["bounded", "retry"]], ["retries unbounded"]),
            (0, "drop", "Open points", True, [["events"]], ["drop event"]),
        ],
        "fixture long, fact_id string, section string, critical boolean, acceptable array<array<string>>, contradictions array<string>",
    )
    grades = grading.section_grader(answers, facts, HEADINGS)
    found = {(r.answer_id, r.fact_id): r.status for r in grades.collect()}
    assert found == {
        (1, "queue"): "present", (1, "retry"): "present", (1, "drop"): "contradicted",
        (2, "queue"): "present", (2, "retry"): "present", (2, "drop"): "contradicted",
        (3, "queue"): "absent", (3, "retry"): "absent", (3, "drop"): "contradicted",
        (4, "queue"): "absent", (4, "retry"): "absent", (4, "drop"): "absent",
    }
    stale = spark.createDataFrame([(0, "old", "Goal", ["never", "queues bounded"])], "fixture long, item_id string, section string, patterns array<string>")
    made = grading.stale_claims_made(answers, stale, HEADINGS)
    assert sorted((r.answer_id, r.item_id) for r in made.collect()) == [(1, "old"), (2, "old")]
    verdicts = {r.answer_id: (r.coverage, r.critical_missing, r.stale, r.passed) for r in grading.section_verdicts(grades, made, 60.0).collect()}
    assert verdicts[1] == (66.67, ["drop"], ["old"], False) and verdicts[4] == (0.0, ["drop", "queue"], [], False)
    good = grades.withColumn("status", F.lit("present"))
    assert {r.passed for r in grading.section_verdicts(good, made.limit(0), 100.0).collect()} == {True}


def test_context_id_hangs_on_names_alone(spark):
    row = spark.range(1).select(text.context_id(a=F.lit(1), b=F.lit("x")).alias("p"), text.context_id(b=F.lit("x"), a=F.lit(1)).alias("q"), text.context_id(a=F.lit("x"), b=F.lit(1)).alias("r")).first()
    assert row.p == row.q != row.r


def test_search_is_linear_in_a_text(spark):
    """A long text of nothing but words of the query: its words are cut once, below the Generate."""
    long = " ".join(f"alpha beta{i % 7}" for i in range(100_000))
    units = spark.createDataFrame([(1, long), (2, "alpha beta1")], "unit_id long, content string")
    queries = spark.createDataFrame([(1, "alpha beta0 beta1 beta2 beta3")], "query_id long, query string")
    begin = time.perf_counter()
    found = {r.unit_id: r for r in retrieval.search(units, queries).collect()}
    assert time.perf_counter() - begin < 40 and found[1].terms == 5
    words = F.regexp_extract_all(F.lower("content"), F.lit(text.WORD), F.lit(0))
    counted = text.let(words, lambda w: F.transform(w, lambda x: F.struct(F.size(w).alias("length"), x.alias("term"))))
    plan = units.select("unit_id", F.explode(counted).alias("w")).select("unit_id", "w.length", "w.term")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan.split("Generate")[0]
