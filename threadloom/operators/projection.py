"""What a unit or a request shows: disclosure levels, export, scans of text, packs of files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import size_checked, stored
from .packing import greedy

#: Sentences and characters of the structure level.
SENTENCES, EXCERPT = 3, 240


def disclosed(units: DataFrame) -> DataFrame:
    """``unit_id`` and what its level shows.

    ``units`` has unit_id, content, token_count, level and terms. ``map`` shows the id and
    its tokens, ``structure`` the first sentences that have one of the terms, cut to
    EXCERPT characters, and any other level the content.
    """
    marked = F.regexp_replace("content", r"([.!?])\s+", "$1\x1f")
    sentences = F.transform(F.split(marked, "\x1f"), lambda s: F.left(F.trim(s), F.lit(EXCERPT)))
    relevant = F.filter(sentences, lambda s: (s != "") & F.exists("terms", lambda t: F.contains(F.lower(s), t)))
    shown = F.array_join(F.slice(F.array_distinct(relevant), 1, SENTENCES), "\n")
    named = F.concat("unit_id", F.lit(" ("), "token_count", F.lit(" tokens)"))
    text = F.when(F.col("level") == "map", named).when(F.col("level") == "structure", F.concat("unit_id", F.lit("\n"), shown)).otherwise(F.col("content"))
    return units.select("unit_id", "level", text.alias("shown"))


def exported(messages: DataFrame) -> DataFrame:
    """(conv_id, messages, body): each conversation as one JSON list of its messages in order.

    This is the export's own form: a conversation is one row, as long as it is.
    """
    one = F.struct("turn", "role", "text")
    return messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.to_json(F.array_sort(F.collect_list(one))).alias("body"))


def imported(exports: DataFrame) -> DataFrame:
    """Messages of exported conversations; the way back of ``exported``."""
    parsed = F.from_json("body", "array<struct<turn:bigint,role:string,text:string>>")
    return exports.select("conv_id", F.explode(parsed).alias("m")).select("conv_id", "m.*")


def text_signals(texts: DataFrame, key: str, patterns: Mapping[str, str]) -> DataFrame:
    """How often each pattern stands in a text, and the first named one that does."""
    counts = {f"n_{name}": F.regexp_count("text", F.lit(p)).cast("long") for name, p in patterns.items()}
    first = F.coalesce(*[F.when(F.col(f"n_{name}") > 0, name) for name in patterns], F.lit("none"))
    return texts.select(key, *[c.alias(n) for n, c in counts.items()]).withColumn("first_signal", first)


def claims(texts: DataFrame, key: str, claim: str, negation: str, reach: int = 48) -> DataFrame:
    """(key, stated, negated): claims of each text by whether a negation stands up to ``reach`` characters before.

    What stands before a claim begins after the claim before it, on the same line. The text
    is cut at its claims, once, so its length counts once and not ``reach`` times.
    """
    own = texts.filter(F.col("text").rlike(claim))
    before = F.transform(F.split("text", claim, -1), lambda x: F.substring_index(F.right(x, F.lit(reach)), "\n", -1))
    said = F.zip_with(F.regexp_extract_all("text", F.lit(claim), F.lit(0)), before, lambda c, b: F.when(c.isNotNull(), F.concat(b, c)))
    judged = own.select(key, F.transform(F.filter(said, lambda x: x.isNotNull()), lambda x: x.rlike(negation).cast("int")).alias("no"))
    negated = F.aggregate("no", F.lit(0).cast("long"), lambda acc, x: acc + x)
    return judged.select(key, (F.size("no") - negated).alias("stated"), negated.alias("negated"))


def phrases_near(texts: DataFrame, key: str, first: str, second: str, span: int = 14) -> DataFrame:
    """(key, distance) of texts where two words stand at most ``span`` words apart; the least distance.

    Only neighbouring places of either word are compared, which have the least distance.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    places = texts.select(key, F.posexplode(words).alias("at", "word")).filter(F.col("word").isin(first, second))
    order = W.partitionBy(key).orderBy("at")
    gap = F.when(F.lag("word").over(order) != F.col("word"), F.col("at") - F.lag("at").over(order))
    return places.withColumn("gap", gap).groupBy(key).agg(F.min("gap").cast("long").alias("distance")).filter(F.col("distance") <= span)


def rejected(requests: DataFrame, sources: Sequence[str]) -> DataFrame:
    """``requests`` with the first rule that each breaks; null where it is valid.

    An operation needs its field; budgets are 1 to 64,000, depths 0 to 3, limits 1 to 100.
    """
    needs = F.when(F.col("op").isin("search", "pack"), F.col("query")).when(F.col("op").isin("dependencies", "expand"), F.col("target")).otherwise("")
    reason = (
        F.when(needs.isNull(), "missing_field")
        .when(~F.col("budget").between(1, 64_000), "budget")
        .when(~F.col("depth").between(0, 3), "depth")
        .when(~F.col("limit").between(1, 100), "limit")
        .when(~F.col("source").isin(*sources), "unknown_source")
    )
    return requests.withColumn("reason", reason)


def overheads(timings: DataFrame) -> DataFrame:
    """``timings`` with what is left of the whole: never below 0, unknown where a part is."""
    known = F.col("total") - F.col("scoring") - F.col("compilation")
    return timings.withColumn("residual", F.round(F.greatest(F.lit(0.0), known), 6)).withColumn("residual", F.when(known.isNotNull(), F.col("residual")))


def file_pack(files: DataFrame, budget: int) -> DataFrame:
    """(query_id, path, cost, status, shown): files in order under a budget, the first cut if none fits.

    ``files`` has query_id, rank (from 1), path, cost and content, any number for each
    query. A file that does not fit is skipped. Where nothing fits, the first is
    ``truncated`` to as many words as the budget has; that is no delivery.
    """
    taken = greedy(files.select("query_id", F.col("rank").alias("place"), "cost", F.lit(budget).cast("long").alias("budget")))
    some = stored(taken.groupBy("query_id").agg(F.max("fits").alias("some")), "packs-with-files")
    joined = files.join(taken.withColumnRenamed("place", "rank"), ["query_id", "rank"]).join(size_checked(some, 24), "query_id")
    status = F.when(F.col("fits"), "selected").when(~F.col("some") & (F.col("rank") == 1), "truncated").otherwise("does_not_fit")
    joined = joined.withColumn("status", status)
    prefix = F.concat(F.array_join(F.slice(F.split("content", " "), 1, budget), " "), F.lit(" [truncated]"))
    shown = F.when(F.col("status") == "selected", F.col("content")).when(F.col("status") == "truncated", prefix)
    return joined.select("query_id", "path", "cost", "status", shown.alias("shown"))


def source_digests(files: DataFrame) -> DataFrame:
    """(source, files, digest): a state digest of each source that no order of files changes.

    Sums of hashes are added up in tasks, so a source of any size needs no list.
    """
    part = F.conv(F.left(F.col("content_hash"), F.lit(12)), 16, 10).cast("decimal(20,0)")
    return files.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(part).cast("string").alias("digest"))
