"""Places of pattern matches as native expressions: code points, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let, scan

PLACES = "array<struct<start:int,end:int,value:string>>"
#: Code points of the pieces by which ``replaced`` reads a text.
PIECE = 1024


def match_spans(text: Column, pattern: Column, value_group: int = 0) -> Column:
    """Leftmost matches that do not overlap: start, end and the text of one group.

    What ``split`` leaves between matches gives each one's place. The pattern must not
    match the empty string.
    """

    def measured(xs: Column) -> Column:
        gaps = scan(xs, F.lit(0), lambda at, x: at + F.length(x["gap"]) + F.length(x["match"]))

        def place(x: Column, before: Column) -> Column:
            low = before + F.length(x["gap"])
            return F.struct(low.alias("start"), (low + F.length(x["match"])).alias("end"), x["value"].alias("value"))

        return let(gaps, lambda at: F.transform(xs, lambda x, i: place(x, F.get(at, i))))

    def places(between: Column) -> Column:
        matches = F.regexp_extract_all(text, pattern, F.lit(0))
        values = F.regexp_extract_all(text, pattern, F.lit(value_group)) if value_group else matches
        # The last gap has no match beside it; its entry is cut off.
        zipped = F.slice(F.arrays_zip(between.alias("gap"), matches.alias("match"), values.alias("value")), 1, F.size(between) - 1)
        return F.when(F.size(between) > 1, let(zipped, measured)).otherwise(F.array().cast(PLACES))

    return let(F.split(text, pattern, -1), places)


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_kind(places: Column, kind: str, rank: int) -> Column:
    """Places as spans: rank, start, end, kind, value."""
    return F.transform(places, lambda p: F.struct(F.lit(rank).alias("rank"), p["start"].alias("start"), p["end"].alias("end"), F.lit(kind).alias("kind"), p["value"].alias("value")))


def replaced(text: Column, spans: Column, shown: dict[str, str]) -> Column:
    """``text`` with each span replaced by what ``shown`` has for its kind.

    Of two that overlap, the one that starts first holds, then the one of lower rank. The
    text is read in pieces, as a place far into a long string is slow to reach.
    """
    kinds = F.create_map(*[F.lit(x) for pair in (shown | {"": ""}).items() for x in pair])
    size = F.length(text)
    last = F.struct(size.alias("start"), F.lit(2**31 - 1).alias("rank"), size.alias("end"), F.lit("").alias("kind"))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def rebuilt(pieces: Column, spans: Column, ends: Column) -> Column:
        def between(low: Column, high: Column) -> Column:
            first = F.floor(low / PIECE).cast("int")
            some = F.array_join(F.slice(pieces, first + 1, F.floor(high / PIECE).cast("int") - first + 1), "")
            return F.when(high > low, F.substring(some, low - first * PIECE + 1, high - low)).otherwise("")

        def shown_for(s: Column, i: Column) -> Column:
            return F.when(s["start"] >= F.get(ends, i), F.concat(between(F.get(ends, i), s["start"]), F.element_at(kinds, s["kind"]))).otherwise("")

        return F.array_join(F.transform(spans, shown_for), "")

    def walked(spans: Column) -> Column:
        ends = scan(spans, F.lit(0), lambda at, s: F.when(s["start"] >= at, s["end"]).otherwise(at))
        return let(ends, lambda at: let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda pieces: rebuilt(pieces, spans, at)))

    return let(F.concat(order, F.array(last)), walked)


def count_where(spans: Column, field: str, value: str) -> Column:
    """How many spans have ``value`` in a field."""
    return F.size(F.filter(spans, lambda s: s[field] == value)).cast("long")
