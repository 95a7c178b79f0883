"""Column functions and operators on small literal tables."""

import time

import __spark_entry__
import pytest
from pyspark.sql import functions as F

from threadloom import shared
from threadloom.functions import text
from threadloom.operators import grading, metrics, packing, relations, retrieval
from threadloom.sources import adapters


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_text_functions(spark):
    assert one(spark, "> Quoted  Straße,\n> line", text.normalized) == "quoted strasse line"
    assert one(spark, "What is the Plan for the plan B", text.query_terms) == ["plan", "b"]
    assert one(spark, "Étion, x_1!", text.token_count) == 4
    assert one(spark, None, text.token_count) == 0
    assert one(spark, "Ok thanks", text.low_information) is True
    assert one(spark, "ok then go on", text.low_information) is False
    assert one(spark, "parties classes bus keys", text.light_stems) == ["party", "classe", "bus", "key"]
    assert one(spark, "a/b/c", lambda c: text.in_scope(c, "a/b")) is True
    assert one(spark, "a/bc", lambda c: text.in_scope(c, "a\\b")) is False


def test_pack_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, 10, 1, 60), (1, 11, 2, 50), (1, 12, 3, 40), (1, 13, 2000, 1), (2, 10, 1, 101)], "query_id long, unit_id long, rank long, cost long")
    found = {(r.query_id, r.unit_id): r.status for r in packing.budget_pack(rows, 100).collect()}
    assert found == {(1, 10): "selected", (1, 11): "does_not_fit", (1, 12): "selected", (1, 13): "does_not_fit", (2, 10): "does_not_fit"}


def test_scores_by_hand(spark):
    units = spark.createDataFrame([("a", "Alpha beta alpha"), ("b", "beta gamma"), ("c", "the of"), ("d", "we saw alpha beta gamma delta here"), ("e", None)], "unit_id string, content string")
    queries = spark.createDataFrame([(1, "the alpha beta"), (2, "alpha beta gamma delta here"), (3, "the of")], "query_id long, query string")
    found = {(r.query_id, r.unit_id): r.score for r in retrieval.search(units, queries).collect()}
    idf = lambda df: 1 + (5 - df + 0.5) / (df + 0.5)
    gain = lambda df, tf, words: round(min(10.0, idf(df) * tf / (1 + 0.25 * words / 100)), 3)
    assert found[1, "a"] == round(gain(2, 2, 3) + gain(3, 1, 3), 3)
    assert found[1, "b"] == gain(3, 1, 2)
    # The unit that echoes a query of over four words is dropped; a query without terms finds nothing.
    assert (2, "d") not in found and found[2, "b"] == round(gain(3, 1, 2) + gain(2, 1, 2), 3)
    assert not any(q == 3 for q, _ in found)
    # A short query that stands as it is adds its weight, in parts of words too.
    short = spark.createDataFrame([(1, "alpha beta"), (2, "amma de")], "query_id long, query string")
    held = {(r.query_id, r.unit_id): r.score for r in retrieval.search(units, short, weights={"exact_phrase": 7}).collect()}
    assert held[1, "a"] == round(gain(2, 2, 3) + gain(3, 1, 3) + 7, 3) and held[2, "d"] == 7.0
    for bad in ({"nothing": 1}, {"explicit": 1001}, {"explicit": 0.5}):
        with pytest.raises(ValueError):
            retrieval.weights_with(bad)


def test_a_phrase_far_down_the_list_is_not_lost(spark):
    rows = [(f"s{i:03d}", "beta alpha " + "alpha beta " * 3) for i in range(150)]
    long = " ".join(f"w{i}" for i in range(4000)) + " alpha then beta"
    units = spark.createDataFrame([*rows, ("z", long)], "unit_id string, content string")
    found = retrieval.search(units, spark.createDataFrame([(1, "alpha then beta")], "query_id long, query string"), k=3).collect()
    assert [r.unit_id for r in found][0] == "z"


def test_near_copies_of_texts(spark):
    words = [f"w{i}" for i in range(30)]
    pairs = [("the plan", "well the plan holds"), (" ".join(words), " ".join(words[:27] + ["x", "y", "z"])), ("a b c", "a b d"), ("", "x"), (" ".join(words), " ".join(reversed(words)))]
    rows = spark.createDataFrame(pairs, "a string, b string").select(text.near_copy(text.copy_parts(F.col("a")), text.copy_parts(F.col("b"))).alias("same")).collect()
    assert [r.same for r in rows] == [True, True, False, False, True]


def packed(spark, units, edges=(), history=(), budget=200, scores=None):
    table = spark.createDataFrame([(u, "message", t, f"hash-{t}", len(t.split()), p, "RELEVANT CONTEXT") for u, t, p in units], "unit_id string, source_type string, content string, content_hash string, cost long, priority string, section string")
    candidates = spark.createDataFrame([(1, u, float((scores or {}).get(u, 50)), True) for u, _, _ in units], "query_id long, unit_id string, score double, lexical_only boolean")
    links = spark.createDataFrame(list(edges), "kind string, src_id string, dst_id string, heuristic boolean")
    had = spark.createDataFrame(list(history), "query_id long, unit_id string, content_hash string, level string")
    return {r.unit_id: r for r in packing.compile_pack(candidates, table, links, had, budget).collect()}


def test_every_status_of_a_pack(spark):
    units = [
        ("old", "use the first store for all of it", "supporting"),
        ("new", "we now use the second store instead of that", "supporting"),
        ("low", "some remark about nothing in particular at all", "supporting"),
        ("ack", "ok thanks", "supporting"),
        ("had", "this was said to the session before already", "required"),
        ("chg", "this was changed since the session had it last", "supporting"),
        ("copy", "now use the second store instead of that", "supporting"),
        ("big", " ".join(f"long{i}" for i in range(180)), "supporting"),
        ("crit", "must keep one writer for each of the shards", "critical"),
    ]
    edges = [("supersedes", "new", "old", False), ("updates", "new", "crit", True)]
    history = [(1, "had", "hash-this was said to the session before already", "pack"), (1, "chg", "hash-older", "pack")]
    found = packed(spark, units, edges, history, scores={"low": 3, "copy": 40})
    assert {u: r.status for u, r in found.items()} == {
        "old": "superseded", "new": "selected", "low": "below_floor", "ack": "low_information", "had": "referenced", "chg": "selected", "copy": "near_duplicate", "big": "does_not_fit", "crit": "selected",
    }
    assert found["old"].superseded_by == "new" and found["copy"].duplicate_of == "new" and found["chg"].invalidated and found["had"].known
    assert found["crit"].place == 0 and found["had"].place == 1


def test_used_tokens_never_exceed_the_budget(spark, small):
    queries = __spark_entry__.queries()
    packed = queries["context_pack"](spark, small)
    over = packed.filter("status = 'selected'").groupBy("query_id").agg(F.sum("cost").alias("used")).filter("used > 3000")
    assert over.count() == 0
    assert __spark_entry__.entry(spark).schema == packed.schema


def test_short_items_are_found_too(spark):
    gold = spark.createDataFrame([(1, "b c"), (2, "one two three four five"), (3, "")], "item_id long, text string")
    docs = spark.createDataFrame([(7, "ab cd"), (8, "zone two three four fives"), (9, None)], "doc_id long, text string")
    assert sorted(map(tuple, retrieval.contained(gold, docs).collect())) == [(1, 7), (2, 8)]


def test_unknown_cost_stays_unknown(spark):
    usage = spark.createDataFrame([("m", 10, 0, 5), ("m", None, 0, 5), ("other", 1, 0, 1)], "model string, input_tokens long, cached_tokens long, output_tokens long")
    pricing = spark.createDataFrame([("m", 1.0, 0.5, 2.0)], "model string, input_rate double, cached_rate double, output_rate double")
    assert [r.cost for r in metrics.estimated_cost(usage, pricing).collect()] == [2e-05, None, None]


def test_distances_and_one_hop(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.distance for r in relations.distances(edges, seeds, 3).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    kinds = spark.createDataFrame([("o", 2, "related_to", "u", "v"), ("o", 1, "depends_on", "v", "u"), ("a", 9, "contains", "u", "v"), ("o", 3, "supersedes", "w", "x"), ("o", 4, "follows", "u", "y")], "owner string, nth long, kind string, src_id string, dst_id string")
    seeds = spark.createDataFrame([("u",)], "unit_id string")
    assert [tuple(r) for r in relations.one_hop(seeds, kinds).collect()] == [("v", "depends_on", "direct_import", 70)]


def test_a_commit_pairs_a_bounded_number_of_files(spark):
    changes = spark.createDataFrame([(c, f"f{i:03d}") for c in (1, 2) for i in range(120)], "commit long, file string")
    assert relations.cochanges(changes).count() == 50 * 49 // 2


def test_waits_of_a_long_session_take_seconds(spark):
    events = spark.range(100_000).selectExpr("1L as session_id", "id as seq", "timestamp_micros(id * 1000000) as ts", "if(id % 1000 = 999, 'click', 'view') as operation")
    begin = time.perf_counter()
    assert metrics.wait_spans(events, "view", "click").agg(F.max("wait")).first()[0] == 999.0
    assert time.perf_counter() - begin < 30


def test_percentiles_of_few_values(spark):
    rows = spark.createDataFrame([("a", float(i)) for i in range(1, 25)] + [("a", None), ("b", 5.0), ("c", None)], "operation string, latency double")
    found = {r.operation: (r.p50, r.p95, r.n, r.missing) for r in metrics.percentiles(rows).collect()}
    assert found == {"a": (12.0, 23.0, 24, 1), "b": (5.0, 5.0, 1, 0), "c": (None, None, 0, 1)}


def test_scopes_and_shared_folder(spark):
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_classification_takes_the_first_rule(spark):
    texts = spark.createDataFrame([("a b",), ("b",), ("c",)], "text string")
    rows = grading.classified(texts, [("a", "first", "critical"), ("b", "second", "required")]).collect()
    assert [(r.category, r.priority) for r in rows] == [("first", "critical"), ("second", "required"), ("evidence", "informational")]


def test_plans_have_no_cross_product(spark, small):
    queries = __spark_entry__.queries()
    for name in ("doc_lexical_search", "passage_containment", "exact_duplicates", "cochange_pairs", "import_resolution"):
        plan = queries[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_adapters_sinks_and_pricing(spark, tmp_path):
    known = adapters.Adapters()
    known.register("notes", lambda t: t.selectExpr("id as unit_id", "'note' as source_type", "body as content", "md5(body) as content_hash", "1L as token_count"))
    notes = spark.createDataFrame([("n1", "text")], "id string, body string")
    assert known.units({"notes": notes}).count() == 1
    with pytest.raises(ValueError):
        known.register("notes", lambda t: t)
    known.register("bad", lambda t: t)
    with pytest.raises(ValueError):
        known.units({"bad": notes})
    runs = []
    fresh = adapters.Freshness()
    both = lambda: runs.append("files")
    fresh.register("repository_file", both)
    fresh.register("code_symbol", both)
    fresh.refresh(["repository", "repository_file", "unknown"])
    assert runs == ["files"]
    units = spark.createDataFrame([("message",), ("repository_file",), ("note",)], "source_type string")
    assert {r.source_type for r in adapters.of_source_types(units, ["conversation", "note"]).collect()} == {"message", "note"}
    rows = [("a", 1.0, 0.1, 2.0), ("b", 1.0, 0.1, 2.0), ("b", 2.0, 0.1, 2.0), (" ", 1.0, 0.1, 2.0), ("c", -1.0, 0.1, 2.0), ("d", None, 0.1, 2.0)]
    good, bad = adapters.pricing(spark.createDataFrame(rows, "model string, input_rate double, cached_rate double, output_rate double"))
    assert [r.model for r in good.collect()] == ["a"]
    assert sorted((r.model, r.reason) for r in bad.collect()) == [(" ", "blank_model"), ("b", "repeated_model"), ("b", "repeated_model"), ("c", "rate"), ("d", "rate")]
    traces = spark.createDataFrame([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00")], "seq long, t string").selectExpr("seq", "timestamp(t) as ts")
    for _ in range(2):
        adapters.append_traces(traces, str(tmp_path / "traces"))
    assert spark.read.parquet(str(tmp_path / "traces")).filter("day = '2024-01-02'").count() == 2
    adapters.write_report(traces, str(tmp_path / "report"))
    with pytest.raises(Exception, match="(?i)exist"):
        adapters.write_report(traces, str(tmp_path / "report"))
