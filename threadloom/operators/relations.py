"""Relations between units: expansion, supersession, copies, co-change and distance."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import size_checked, stored
from .retrieval import weights_with

#: The signal that a relation's kind gives to its other end; other kinds give none.
RELATION_SIGNALS = {
    "imports": "direct_import",
    "depends_on": "direct_import",
    "references_symbol": "referenced_symbol",
    "references": "related_unit",
    "related_to": "related_unit",
    "related_test": "related_test",
    "tested_by": "related_test",
    "consumed_by": "consumer",
    "decision_for": "related_unit",
    "constraint_for": "related_unit",
    "updates": "decision_context",
    "contradicts": "decision_context",
    "supersedes": "final_state",
    "cochanged": "cochanged",
}
#: Files of one commit that are paired with each other, in order of path.
PAIRED_FILES = 50


def one_hop(seeds: DataFrame, edges: DataFrame, weights: Mapping[str, int] | None = None) -> DataFrame:
    """(unit_id, kind, signal, weight) of the units that an edge joins to a seed, seeds left out.

    ``edges`` has owner, nth, kind, src_id and dst_id. Of several edges to one unit the
    first counts, by owner and then by number; edges of kinds without a signal do not.
    """
    own = weights_with(weights)
    signal = F.create_map(*[F.lit(x) for pair in RELATION_SIGNALS.items() for x in pair])
    typed = edges.filter(F.col("kind").isin(*RELATION_SIGNALS))
    ids = stored(seeds.select("unit_id").distinct(), "seeds")
    small = lambda name: size_checked(ids, 32, ["unit_id"]).withColumnRenamed("unit_id", name)
    out = typed.join(small("src_id"), "src_id", "left_semi").select(F.col("dst_id").alias("unit_id"), "owner", "nth", "kind")
    back = typed.join(small("dst_id"), "dst_id", "left_semi").select(F.col("src_id").alias("unit_id"), "owner", "nth", "kind")
    met = out.unionByName(back).join(small("unit_id"), "unit_id", "left_anti")
    first = met.groupBy("unit_id").agg(F.min_by("kind", F.struct("owner", "nth")).alias("kind")).withColumn("signal", signal[F.col("kind")])
    return first.withColumn("weight", F.create_map(*[F.lit(x) for pair in own.items() for x in pair])[F.col("signal")].cast("long"))


def resolved(values: DataFrame, units: DataFrame) -> DataFrame:
    """(value, unit_id): a unit's id, else the last unit of that source id, else of the part before "::".

    ``units`` has unit_id, source_id and nth, the order of units.
    """
    by_source = units.groupBy(F.col("source_id").alias("key")).agg(F.max_by("unit_id", "nth").alias("found"))
    own = units.select(F.col("unit_id").alias("value"), F.col("unit_id").alias("own"))
    whole = by_source.select(F.col("key").alias("value"), F.col("found").alias("whole"))
    head = by_source.select(F.col("key").alias("head"), F.col("found").alias("part"))
    asked = values.select("value").distinct().withColumn("head", F.substring_index("value", "::", 1))
    return asked.join(own, "value", "left").join(whole, "value", "left").join(head, "head", "left").select("value", F.coalesce("own", "whole", "part").alias("unit_id"))


def named_units(targets: DataFrame, units: DataFrame) -> DataFrame:
    """(query_id, unit_id), each once, of units that a target names by id, source id or path.

    A target may be a path that very many units have, so pairs are not made first and
    grouped then: units are grouped with the targets that name them, of which there are few,
    and a pair comes from the first target that the query and the unit have in common.
    """
    asked = stored(targets.select("query_id", "target").filter("target is not null").distinct(), "named-targets")
    keys = units.select("unit_id", F.explode(F.array_distinct(F.array("unit_id", "source_id", "path"))).alias("target"))
    met = keys.join(size_checked(stored(asked.select("target").distinct(), "target-names"), 24, ["target"]), "target", "left_semi")
    named = met.groupBy("unit_id").agg(F.collect_set("target").alias("names"))
    # Few bytes that become many pairs: a stated number of partitions is not made one for being small.
    spread = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = named.repartition(spread, F.xxhash64("unit_id")).select("unit_id", "names", F.explode("names").alias("target"))
    lists = stored(asked.groupBy("query_id").agg(F.collect_set("target").alias("own")), "targets-of-queries")
    pairs = named.join(size_checked(asked, 32, ["target"]), "target")
    one = pairs.filter(F.size("names") == 1).select("query_id", "unit_id")
    some = pairs.filter(F.size("names") > 1).join(size_checked(lists.select("query_id", "own", F.array_join("own", "").alias("text")), 64, ["text", "text"]).drop("text"), "query_id")
    first = F.col("target") == F.array_min(F.array_intersect("names", "own"))
    return one.unionByName(some.filter(first).select("query_id", "unit_id"))


def explicit_targets(targets: DataFrame, units: DataFrame) -> DataFrame:
    """(query_id, unit_id, weight) of units that a target names by id, source id or path; it adds 100 once."""
    return named_units(targets, units).withColumn("weight", F.lit(100).cast("long"))


def superseded(messages: DataFrame) -> DataFrame:
    """Each message with the turn of the next one of its role, which replaces it; null if none."""
    order = W.partitionBy("conv_id", "role").orderBy("turn")
    return messages.select("conv_id", "turn", "role", F.lead("turn").over(order).alias("superseded_by"))


def copies(docs: DataFrame) -> DataFrame:
    """The first document with the same text, and how many have it, for each document."""
    hashed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    classes = hashed.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    return hashed.join(classes, "content_hash").select("doc_id", "content_hash", "first_id", "n_copies")


def cochanges(changes: DataFrame, least: int = 2, most: int = PAIRED_FILES) -> DataFrame:
    """(a, b, times) of pairs of files in one commit; ``changes`` has commit and file.

    The first ``most`` files of a commit by path are paired, so a commit gives a bounded
    number of pairs; a pair that met ``least`` times has one row, the first by name as a,
    and stands for an edge either way.
    """
    order = W.partitionBy("commit").orderBy("file")
    own = changes.distinct().withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).drop("nth")
    files = own.groupBy("commit").agg(F.array_sort(F.collect_list("file")).alias("files"))
    later = lambda x, i: F.transform(F.slice(F.col("files"), i + 2, most), lambda y: F.struct(x.alias("a"), y.alias("b")))
    pairs = files.select(F.explode(F.flatten(F.transform("files", later))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") >= least)


def distances(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, distance) of all nodes within ``depth`` steps of a seed; edges go both ways.

    Each level is written, so none is computed again for the next. Edges may repeat: they
    stream past the nodes of the last level, and only distinct nodes are held.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = frontier = stored(seeds.select("node", F.lit(0).cast("long").alias("distance")).distinct(), "level-0")
    for step in range(1, depth + 1):
        ends = size_checked(frontier.select("node"), 24, ["node"], beyond="shuffle_hash").withColumnRenamed("node", "src")
        met = both.join(ends, "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = stored(met.join(seen.select("node"), "node", "left_anti").withColumn("distance", F.lit(step).cast("long")), f"level-{step}")
        seen = seen.unionByName(frontier)
    return seen


def unique_targets(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(owner, target, n) of candidate paths: the file where exactly one fits, else null."""
    found = wanted.join(files, "path", "left").groupBy("owner").agg(F.count("file").alias("n"), F.min("file").alias("file"))
    return found.select("owner", F.when(F.col("n") == 1, F.col("file")).alias("target"), "n")
