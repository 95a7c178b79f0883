"""Histogram sort into shards of nearly equal bytes.

The order is by a 63-bit key: the hash of the text, then the hash of the row, so equal
texts stand together and yet a large group of them can be cut. Splitters are found by
counting: each round sums the exact bytes below evenly spaced key boundaries inside the
brackets that are still open, and each splitter keeps the bracket that holds its target.
Once all are within tolerance, rows are exchanged once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import beside, size_checked, stored

SHARDS = 40
#: A splitter may miss its target by this share of a shard's bytes, or by one row.
TOLERANCE = 0.0005
#: Bits of the key that one round resolves: in the first, and in each later one.
FIRST_BITS, NEXT_BITS = 12, 7
KEY_BITS = 63
#: Rows that one part of a shard should have: parts are numbered by separate tasks.
PART_ROWS = 2_000_000
#: Parts of each shard, at least.
LEAST_PARTS = 4


@dataclass
class Bracket:
    """Keys from ``low`` on, ``width`` of them, and the bytes of all keys before them."""

    low: int
    width: int
    before: int


def _sort_key(text: Column, row: Column) -> Column:
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 33), 32)
    return high.bitwiseOR(F.shiftrightunsigned(F.xxhash64(row, F.lit("row")), 32))


def find_splitters(keys: DataFrame, targets: list[int], tolerance: int) -> list[int]:
    """For each target, the least key found with about so many bytes before it.

    ``keys`` has ``key`` and ``size``. The driver sees sums for at most 2**FIRST_BITS
    boundaries, then 2**NEXT_BITS for each target still open.
    """
    found: dict[int, int] = {}
    brackets = {0: Bracket(0, 1 << KEY_BITS, 0)}
    held = {t: 0 for t in targets}  # target -> the low of its bracket
    bits = FIRST_BITS
    while held:
        width = next(iter(brackets.values())).width
        shift = max(0, width.bit_length() - 1 - bits)
        step = 1 << shift
        bin_of = F.shiftright("key", shift)
        counted = keys
        if width < 1 << KEY_BITS:
            lows = sorted(x >> (width.bit_length() - 1) for x in brackets)
            counted = counted.filter(F.shiftright("key", width.bit_length() - 1).isin(lows))
        sums = counted.groupBy(bin_of.alias("bin")).agg(F.sum("size").alias("bytes")).collect()
        by_bracket: dict[int, list[tuple[int, int]]] = {x: [] for x in brackets}
        for k, size in sums:
            by_bracket[(k << shift) & ~(width - 1) if width < 1 << KEY_BITS else 0].append((k << shift, size))
        opened: dict[int, Bracket] = {}
        still: dict[int, int] = {}
        for low, bracket in brackets.items():
            at, bins = bracket.before, iter(sorted(by_bracket[low]))
            current = next(bins, None)
            for target in sorted(t for t, x in held.items() if x == low):
                while current is not None and at + current[1] < target:
                    at += current[1]
                    current = next(bins, None)
                if current is None:
                    found[target] = low + bracket.width
                    continue
                edge, size = current
                if target - at <= tolerance or at + size - target <= tolerance or step == 1:
                    found[target] = edge if target - at <= at + size - target else edge + step
                else:
                    still[target] = edge
                    opened[edge] = Bracket(edge, step, at)
        brackets, held, bits = opened, still, NEXT_BITS
    return [found[t] for t in targets]


def _number_of_splitters_below(key: Column, splitters: list[int]) -> Column:
    """By halving: log2 comparisons for each row, one native expression."""
    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < splitters[mid], between(low, mid)).otherwise(between(mid + 1, high))

    return between(0, len(splitters))


def histogram_shards(
    docs: DataFrame,
    *,
    shards: int = SHARDS,
    text: str = "text",
    carry: list[str] | None = None,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Rows dealt into ``shards`` of nearly equal bytes, in key order.

    Returns the columns ``carry`` (all by default; one named ``sharding`` is replaced) and
    a struct ``sharding``: size (UTF-8 bytes of the text plus 16), text_crc32, key, shard
    and slot. Slots of a shard run from 0 without a gap, in key order.

    A null text counts as no bytes, with the CRC of no bytes. Nulls elsewhere pass
    through. Repeated rows get keys of their own, so a group of any size can be cut. A
    row larger than a shard's share makes its shard large and leaves others smaller. An
    empty table gives no rows. Keys are written once, so a lost executor changes nothing;
    but equal texts are told apart by their place in the input, so another division of the
    same rows into files orders these among themselves in another way.
    """
    whole = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    carried = docs if carry is None else docs.select(*carry)
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried.columns]).alias("row"),
        (F.octet_length(whole) + F.lit(16)).cast("long").alias("size"),
        F.crc32(whole).alias("crc"),
        _sort_key(F.coalesce(F.col(text), F.lit("")), F.monotonically_increasing_id()).alias("key"),
    )
    keyed = stored(keyed, "sort-keys")

    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(LEAST_PARTS, -(-rows // (PART_ROWS * shards)))
    targets = [total * i // (shards * parts) for i in range(1, shards * parts)]
    allowed = int(total * tolerance / shards)
    wanted = sorted(set(targets))
    at = dict(zip(wanted, find_splitters(keyed.select("key", "size"), wanted, allowed), strict=True)) if total else {t: 0 for t in wanted}
    splitters = [at[t] for t in targets]
    for i in range(1, len(splitters)):  # tolerance may cross two splitters that share a large row
        splitters[i] = max(splitters[i], splitters[i - 1])

    part = _number_of_splitters_below(F.col("key"), splitters)
    dealt = keyed.withColumn("part", part)
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    within = W.partitionBy(F.floor(F.col("part") / parts)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = stored(counts.select("part", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("first")), "shard-parts")
    numbered = dealt.withColumn("slot", F.row_number().over(W.partitionBy("part").orderBy("key")) - 1)
    return numbered.join(size_checked(counts, 16), "part").select(
        *beside(carried, "sharding"),
        F.struct(
            "size",
            F.col("crc").alias("text_crc32"),
            "key",
            F.floor(F.col("part") / parts).cast("int").alias("shard"),
            (F.col("slot") + F.col("first")).cast("long").alias("slot"),
        ).alias("sharding"),
    )


def shards_digest(docs: DataFrame) -> DataFrame:
    """The shard and slot of each document."""
    found = histogram_shards(docs.select("doc_id", "text"), carry=["doc_id"])
    return found.select(
        "doc_id",
        "sharding.size",
        "sharding.text_crc32",
        F.lit("bytes").alias("law"),
        "sharding.shard",
        "sharding.slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
