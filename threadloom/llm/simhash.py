"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints within the radius agree in some choice of their blocks of bits, so each goes
to one bucket per choice. Inside a bucket, bit planes stand vertically: lane i of plane b
is bit b of fingerprint i, and carry-save counters in three planes add up the distances of
64 lanes at once. Blocks of lanes whose distances all exceed the radius are abandoned.

Buckets too large for one task are cut again: first by the bits they do not share, by the
same argument, and what is still too large into pairs of chunks. All is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, row_key, size_checked, stored

SEED, SHINGLE, RADIUS = 42, 3, 3
BITS = 64
#: Blocks that two fingerprints of a bucket share; there are RADIUS more blocks than that.
SHARED = 2
#: Fingerprints that a bucket may have before it is cut.
LARGE = 4096
#: Buckets of fewer fingerprints are compared many at a time.
SMALL = 48

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64 bits; a bit is set if over half of the shingles' hashes set it. No words: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], 0
    for word in words:
        at += len(word) + 1
        ends.append(at)
    last = max(1, len(words) - width + 1)
    cuts = zip([0, *ends], ends[min(width, len(words)) - 1 :], strict=False)
    digest = xxhash.xxh64_intdigest
    return bits_by_majority(np.array([digest(joined[a : b - 1], SEED) for (a, b), _ in zip(cuts, range(last), strict=False)], dtype="<u8"))


def bits_by_majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes set; none of no hashes."""
    set_in = np.zeros(BITS, dtype=np.int64)
    for low in range(0, len(hashes), 1 << 16):
        set_in += np.unpackbits(hashes[low : low + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, text: str = "text", width: int = SHINGLE) -> DataFrame:
    """``fp`` (the bits of a signed long) instead of the text column."""
    rest = [c for c in docs.columns if c != text]
    chosen = docs.select(*rest, text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, width) for x in batch.column(len(rest)).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=[*rest, "fp"])

    schema = T.StructType([f for f in chosen.schema if f.name != text] + [T.StructField("fp", T.LongType())])
    return arrow_map(chosen, read, schema)


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes: row b has bit b of all values, 64 lanes a word."""
    lanes = -len(values) % 64
    padded = np.concatenate([values, np.zeros(lanes, dtype=np.uint64)])
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


class Counter:
    """Distances of many lanes: two counter planes and one that stays set above 3."""

    def __init__(self, shape: tuple[int, ...], radius: int) -> None:
        self.planes = [np.zeros(shape, dtype=np.uint64) for _ in range(radius.bit_length())]
        self.over = np.zeros(shape, dtype=np.uint64)
        # Counting starts where the radius is the last value before the planes overflow.
        self._start = (1 << radius.bit_length()) - 1 - radius
        for i, plane in enumerate(self.planes):
            if self._start >> i & 1:
                plane[...] = _ALL

    def add(self, first: np.ndarray, second: np.ndarray) -> None:
        """Carry-save: two mismatch planes and the lowest counter plane make sum and carry."""
        low = self.planes[0]
        either = first ^ second
        carry = (first & second) | (low & either)
        low ^= either
        for plane in self.planes[1:]:
            plane ^= carry
            carry &= ~plane
        self.over |= carry

    def keep(self, lanes: np.ndarray) -> None:
        self.planes = [p[lanes] for p in self.planes]
        self.over = self.over[lanes]


def _spanning(count: int, linked: Iterator[tuple[int, np.ndarray]]) -> np.ndarray:
    """Least member of each one's component, from (i, all j that link with i)."""
    root = np.arange(count)
    for i, others in linked:
        met = np.unique(root[others])
        met = met[met != root[i]]
        if len(met):
            together = np.append(met, root[i])
            root[np.isin(root, together)] = together.min()
    return root


def compare_bucket(values: np.ndarray, radius: int, queries: int = 64) -> np.ndarray:
    """Components of one bucket: for each value, the place of the least linked one."""
    planes, words = planes_of(values), -(-len(values) // 64)

    def linked() -> Iterator[tuple[int, np.ndarray]]:
        for low in range(0, len(values), queries):
            asked = values[low : low + queries]
            from_word = low // 64
            spread = [np.where((asked >> np.uint64(b)) & np.uint64(1), _ALL, np.uint64(0))[:, None] for b in range(BITS)]
            live = np.arange(from_word, words)
            counter = Counter((len(asked), len(live)), radius)
            for b in range(0, BITS, 2):
                counter.add(planes[b][live] ^ spread[b], planes[b + 1][live] ^ spread[b + 1])
                if b % 16 == 14 and len(live):
                    near = (counter.over != _ALL).any(axis=0)
                    if not near.all():
                        live = live[near]
                        counter.planes = [p[:, near] for p in counter.planes]
                        counter.over = counter.over[:, near]
            hits = np.unpackbits(np.ascontiguousarray(~counter.over).view(np.uint8), axis=1, bitorder="little").reshape(len(asked), -1)
            lanes = (live[:, None] * 64 + np.arange(64)).ravel()
            for k in range(len(asked)):
                others = lanes[hits[k].astype(bool)]
                others = others[(others > low + k) & (others < len(values))]
                if len(others):
                    yield low + k, others

    return _spanning(len(values), linked())


def compare_neighbours(values: np.ndarray, buckets: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among values sorted by bucket: each with the one d places on, for all d at once in lanes."""
    left, right = [], []
    for d in range(1, len(values)):
        same = np.flatnonzero(buckets[d:] == buckets[:-d])
        if not len(same):
            break
        mismatch = planes_of(values[same] ^ values[same + d])
        live = np.arange(mismatch.shape[1])
        counter = Counter((len(live),), radius)
        for b in range(0, BITS, 2):
            counter.add(mismatch[b][live], mismatch[b + 1][live])
            if b % 16 == 14 and len(live):
                near = counter.over != _ALL
                if not near.all():
                    live = live[near]
                    counter.keep(near)
        hits = np.unpackbits(np.ascontiguousarray(~counter.over).view(np.uint8), bitorder="little").astype(bool)
        lanes = (live[:, None] * 64 + np.arange(64)).ravel()[hits]
        lanes = lanes[lanes < len(same)]
        left.append(same[lanes])
        right.append(same[lanes] + d)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    return join(left), join(right)


def _cuts(count: int, low: int, high: int) -> list[tuple[int, int]]:
    """``count`` blocks over bits ``low`` to ``high``: (first bit, bits)."""
    edges = [low + (high - low) * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _bits(fp: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def bucketed(values: DataFrame, radius: int, large: int = LARGE) -> DataFrame:
    """(bucket, fp) such that any two values within the radius share a bucket of bounded size."""
    blocks = _cuts(radius + SHARED, 0, BITS)
    choices = []
    for n, chosen in enumerate(combinations(blocks, SHARED)):
        rest = [x for x in blocks if x not in chosen]
        key = F.xxhash64(F.lit(n), *[_bits(F.col("fp"), *x) for x in chosen])
        again = F.array(*[F.xxhash64(F.lit(i), key, _bits(F.col("fp"), *x)) for i, x in enumerate(_finer(rest, radius))])
        choices.append(F.struct(key.alias("bucket"), again.alias("finer")))
    first = values.select("fp", F.explode(F.array(*choices)).alias("at")).select("fp", "at.bucket", "at.finer")
    hot = stored(first.groupBy("bucket").count().filter(F.col("count") > large).select("bucket", F.lit(True).alias("hot")), "hot-buckets")
    if not hot.take(1):
        return first.select("bucket", "fp")
    marked = first.join(size_checked(hot, 9), "bucket", "left")
    second = marked.filter("hot").select(F.explode("finer").alias("bucket"), "fp")
    counts = second.groupBy("bucket").count().filter(F.col("count") > large)
    hotter = stored(counts.select("bucket", F.ceil(F.col("count") / (large // 2)).cast("int").alias("chunks")), "hotter-buckets")
    second = second.join(size_checked(hotter, 12), "bucket", "left")
    chunk = F.pmod(F.xxhash64("fp", F.lit("chunk")), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.xxhash64("bucket", F.least(x, chunk), F.greatest(x, chunk)))
    third = second.filter("chunks is not null").select(F.explode(pairs).alias("bucket"), "fp")
    return marked.filter("hot is null").select("bucket", "fp").unionByName(second.filter("chunks is null").select("bucket", "fp")).unionByName(third)


def _finer(rest: list[tuple[int, int]], radius: int) -> list[tuple[int, int]]:
    """The blocks not shared: as there are no more than the radius, each is halved, so that
    values within the radius agree in at least one half."""
    halves = [x for first, width in rest for x in ((first, width // 2), (first + width // 2, width - width // 2))]
    assert len(halves) > radius
    return halves


def links(values: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root): enough links between distinct values that all linked ones hang together."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["fp", "root"])

        def full(buckets: np.ndarray, found: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole buckets, sorted."""
            edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]]))
            size = np.repeat(np.diff(edges), np.diff(edges))
            few = (size > 1) & (size < SMALL)
            a, b = compare_neighbours(found[few], buckets[few], radius)
            yield out(found[few][a], found[few][b])
            for low, high in zip(edges, edges[1:], strict=False):
                if high - low >= SMALL:
                    own = np.unique(found[low:high])
                    root = compare_bucket(own, radius)
                    moved = root != np.arange(len(own))
                    yield out(own[moved], own[root[moved]])

        held_b, held_v = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            held_b = np.concatenate([held_b, np.asarray(batch.column(0))])
            held_v = np.concatenate([held_v, np.asarray(batch.column(1)).view(np.uint64)])
            if len(held_b) and held_b[0] != held_b[-1]:
                end = int(np.searchsorted(held_b, held_b[-1]))
                yield from full(held_b[:end], held_v[:end])
                held_b, held_v = held_b[end:], held_v[end:]
        if len(held_b):
            yield from full(held_b, held_v)

    slots = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = bucketed(values, radius).repartition(slots, "bucket").sortWithinPartitions("bucket")
    return arrow_map(sorted_rows, compare, "fp long, root long")


def components(edges: DataFrame, row_bytes: int = 16) -> DataFrame:
    """(node, label): the least node reachable, for each node of the ``edges`` (fp, root).

    Labels fall to the least among neighbours and then to their label's label, so the
    number of rounds grows with the logarithm of the longest path. Each round is written,
    and the tables of the one before it are deleted. ``row_bytes`` is the size of a pair
    of nodes.
    """
    edges = stored(edges.select(F.col("fp").alias("a"), F.col("root").alias("b")).distinct(), "links")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    new = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("a").alias("old"), F.least("a", "b").alias("label")), "labels")
    while new.filter("label <> old").take(1):
        known = new.select(F.col("node").alias("b"), "label")
        offered = both.join(size_checked(known, row_bytes), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("offered"))
        offered = stored(offered, "offered")
        lower = new.select("node", F.col("label").alias("old")).join(size_checked(offered, row_bytes), "node", "left").select("node", "old", F.least("old", "offered").alias("label"))
        lower = stored(lower, "lower", replaces=[offered, new])
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = lower.join(size_checked(jump, row_bytes), "label", "left").select("node", "old", F.least("label", "further").alias("label"))
        new = stored(jumped, "labels", replaces=[lower])
    return new.select("node", "label")


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, row_key, fp and component_id of each row.

    Two rows link if their fingerprints differ in at most ``radius`` bits, and
    ``component_id`` is the least id that a row reaches by links, its own included.
    Only distinct fingerprints are compared, so copies cost nothing.

    A text that is null or has no words has fingerprint 0, and links like any other. A
    null id is never the least; a component of null ids alone has a null component_id.
    Repeated rows each get a row. An empty table gives none. A text may have any length: a
    task holds one Arrow batch. Other columns are not used.
    """
    key = row_key(F.col(doc_id), F.col(text)).alias("row_key")
    rows = stored(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), key, F.col(text).alias("text")), width=width), "fingerprints")
    values = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    label = components(links(values.select("fp"), radius))
    named = values.join(size_checked(label, 16), F.col("fp") == F.col("node"), "left")
    named = stored(named.select("fp", "least", F.coalesce("label", "fp").alias("label")), "labelled")
    least = stored(named.groupBy("label").agg(F.min("least").alias("component_id")), "least-ids")
    of_fp = stored(named.join(size_checked(least, 16), "label").select("fp", "component_id", "label"), "components")
    return rows.join(size_checked(of_fp, 24), "fp").select("doc_id", "row_key", "fp", "label", "component_id")


def components_digest(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of each document."""
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
