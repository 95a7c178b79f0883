"""Declarations of marked-up files: nested elements with their lines, as units of a repository."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import content_hash, token_count
from ..shared import stored

#: Elements that declare something; others are text of what they stand in.
DECLARING = ("main", "article", "section", "aside", "header", "footer", "nav", "div", "ul", "ol", "table", "form", "script", "style", "h1", "h2", "h3", "h4", "h5", "h6")


def _tag(mark: Column) -> Column:
    return F.lower(F.regexp_extract(mark, "^</?([A-Za-z][A-Za-z0-9]*)", 1))


def declarations(files: DataFrame, kinds: Sequence[str] = DECLARING) -> DataFrame:
    """(path, nth, kind, name, low, high, level, parent): elements of each file by where they start.

    ``low`` and ``high`` are the lines of an element's start and end, ``level`` how many
    others it stands in, ``parent`` the ``nth`` of the innermost of them. The name is the
    id, else the class, else a heading's text, else the kind, in lower case. An end belongs
    to the last open start of its kind; an end without a start is left out, and a start
    without an end lasts to the end of the file. ``files`` has path and content.

    What a stack would hold is told by depths: running sums over a file's marks give the
    depth of each within its kind, where starts and ends take turns. Files are sorted by
    Spark, so one may have any number of elements.
    """
    names = "|".join(kinds)
    pattern = rf"(?i)\n|<(?:{names})\b[^>]*>(?:[^<\n]*(?=</h[1-6]))?|</(?:{names})\s*>"
    marks = files.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("at", "mark"))
    order = W.partitionBy("path").orderBy("at")
    line = (1 + F.sum((F.col("mark") == "\n").cast("int")).over(order)).cast("long")
    last = F.max("line").over(W.partitionBy("path"))
    marks = marks.withColumn("line", line).withColumn("last", last).filter(F.col("mark") != "\n").withColumn("kind", _tag(F.col("mark")))
    marks = marks.withColumn("step", F.when(F.col("mark").startswith("</"), -1).otherwise(1))

    # Ends that nothing is open for would sink the depth: the lowest point so far is taken off.
    own = W.partitionBy("path", "kind").orderBy("at")
    marks = marks.withColumn("sum", F.sum("step").over(own))
    sunk = F.least(F.lit(0), F.min("sum").over(own))
    before = F.least(F.lit(0), F.coalesce(F.min("sum").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    marks = marks.withColumn("spare", (F.col("step") == -1) & (sunk < before)).filter("not spare")
    depth = F.sum("step").over(own)
    marks = marks.withColumn("depth", depth + F.when(F.col("step") == -1, 1).otherwise(0))
    pairs = W.partitionBy("path", "kind", "depth").orderBy("at")
    ended = marks.withColumns({"end_at": F.lead("at").over(pairs), "end_line": F.lead("line").over(pairs)}).filter("step = 1")
    none = F.lit(2**31 - 1)
    found = ended.select("path", "at", F.coalesce("end_at", none).alias("end_at"), "kind", "mark", F.col("line").alias("low"), F.coalesce("end_line", "last").alias("high"))
    found = stored(found.withColumn("nth", F.row_number().over(order).cast("long")), "declarations")

    # An element's level: starts less ends before it. Its parent: the latest start of the level above.
    events = found.select("path", F.col("at").alias("p"), F.lit(1).alias("s"), "nth").unionByName(found.filter(F.col("end_at") < none).select("path", F.col("end_at").alias("p"), F.lit(-1).alias("s"), F.lit(None).cast("long").alias("nth")))
    running = F.sum("s").over(W.partitionBy("path").orderBy("p"))
    levels = stored(events.withColumn("level", (running - 1).cast("long")).filter("s = 1").select("path", "p", "nth", "level"), "levels")
    givers = levels.select("path", "p", "level", F.col("nth").alias("given"), F.lit(None).cast("long").alias("nth"))
    takers = levels.select("path", "p", (F.col("level") - 1).alias("level"), F.lit(None).cast("long").alias("given"), "nth")
    parent = F.last("given", ignorenulls=True).over(W.partitionBy("path", "level").orderBy("p"))
    parents = givers.unionByName(takers).withColumn("parent", parent).filter("nth is not null").select("path", "nth", (F.col("level") + 1).alias("level"), "parent")
    attribute = lambda name: F.regexp_extract("mark", rf"""(?i)\s{name}\s*=\s*["']([^"']+)["']""", 1)
    text = F.trim(F.regexp_extract("mark", ">([^<]*)$", 1))
    named = F.coalesce(F.nullif(attribute("id"), F.lit("")), F.nullif(attribute("class"), F.lit("")), F.when(F.col("kind").rlike("^h[1-6]$"), F.nullif(text, F.lit(""))), F.col("kind"))
    return found.join(parents, ["path", "nth"]).select("path", "nth", "kind", F.lower(named).alias("name"), "low", "high", "level", "parent")


def repository_units(files: DataFrame, declared: DataFrame) -> DataFrame:
    """Units of files and of what they declare: unit_id, source_type, source_id, parent_id, kind, content, content_hash, token_count, low, high.

    A symbol's unit has the lines of its element; its parent is the element that it stands
    in (``declared_in``), else the file. ``files`` has path and content.
    """
    lines = F.regexp_extract_all("content", F.lit("[^\n]*\n|[^\n]+"), F.lit(0))
    whole = files.select(F.col("path").alias("unit_id"), F.lit("repository_file").alias("source_type"), F.col("path").alias("source_id"), F.lit("file").alias("kind"), "content", F.lit(1).cast("long").alias("low"), F.size(lines).cast("long").alias("high"))
    name = lambda prefix: F.concat("path", F.lit("::"), F.col(f"{prefix}name"), F.lit(":"), F.col(f"{prefix}nth"))
    above = declared.select("path", F.col("nth").alias("parent"), F.col("name").alias("parent_name"))
    placed = declared.join(above, ["path", "parent"], "left").withColumn("parent_nth", F.col("parent"))
    text = F.array_join(F.slice("lines", F.col("low").cast("int"), (F.col("high") - F.col("low") + 1).cast("int")), "")
    symbols = placed.join(files.select("path", lines.alias("lines")), "path")
    symbols = symbols.select(name("").alias("unit_id"), F.lit("code_symbol").alias("source_type"), F.col("path").alias("source_id"), F.coalesce(name("parent_"), F.col("path")).alias("parent_id"), "kind", text.alias("content"), "low", "high")
    both = whole.unionByName(symbols, allowMissingColumns=True)
    return both.select("unit_id", "source_type", "source_id", "parent_id", "kind", "content", content_hash(F.col("content")).alias("content_hash"), token_count(F.col("content")).alias("token_count"), "low", "high")


def bound_symbols(bindings: DataFrame, declared: DataFrame) -> DataFrame:
    """(kind, src, dst): what the names that a file binds refer to.

    ``bindings`` has file, target (the file that the module was resolved to) and name. A
    name that the target declares exactly once is a reference to that symbol; any other is
    one to the file, once for each pair of files.
    """
    single = declared.groupBy(F.col("path").alias("target"), "name").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("nth")).filter("n = 1")
    asked = bindings.filter("target is not null and target <> file").select("file", "target", "name").distinct()
    met = asked.join(single, ["target", "name"]).select(F.lit("references_symbol").alias("kind"), F.col("file").alias("src"), F.concat("target", F.lit("::"), "name", F.lit(":"), "nth").alias("dst"))
    rest = asked.join(single, ["target", "name"], "left_anti").select(F.lit("references").alias("kind"), F.col("file").alias("src"), F.col("target").alias("dst")).distinct()
    return met.unionByName(rest)
