"""Near copies: SimHash candidates by bit-sliced comparison, then an exact check of shingles.

Documents are near copies if the sets of their five-word shingles have a Jaccard similarity
of 0.8 or more. One changed word changes five shingles but one word, so documents meet in
buckets by samples of a fingerprint over single words, each counted as often as it stands.
In a bucket, bit planes of a second fingerprint, over shingles of three words, which unlike
texts never come near to, tell the candidates; these are checked exactly, shingle by shingle.
Samples miss some pairs, so what they leave apart meets once more by a prefix of its sorted
shingles: sets that are similar enough share one there, and no pair is lost.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, row_key, size_checked, stored
from .simhash import BITS, LARGE, SEED, SMALL, bits_by_majority, compare_bucket, compare_neighbours, components, fingerprint


@dataclass(frozen=True)
class NearCopies:
    """Parameters of the search."""

    #: Words of a shingle, and the Jaccard similarity from which texts are near copies.
    width: int = 5
    similarity: float = 0.8
    #: Differing bits up to which the fingerprints of a bucket are candidates. At the
    #: similarity of 0.8 itself some seven differ; of unlike texts, thirty-two.
    radius: int = 14
    #: Samples of the other fingerprint's bits, and how many bits each has. At the similarity
    #: of 0.8 itself some four of 64 bits differ; most samples of 20 hold one of these.
    tables: int = 24
    sampled_bits: int = 20
    #: Shingles that a group may bring to one task before it is cut into pairs of chunks.
    group_shingles: int = 4_000_000
    #: A shingle that stands in the prefixes of more texts than this comes last in their order.
    hot: int = 100


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a shorter text is one shingle."""
    import xxhash

    if not words:
        return np.zeros(0, dtype="<u8")
    count = max(1, len(words) - width + 1)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(count)], dtype="<u8"))


def word_print(words: list[bytes]) -> int:
    """64 bits by majority over words; the second of two like words counts as another word."""
    import xxhash

    times = Counter(words)
    n = np.fromiter(times.values(), dtype=np.int64, count=len(times))
    hashes = np.repeat(np.array([xxhash.xxh64_intdigest(w, SEED) for w in times], dtype="<u8"), n)
    nth = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n)
    hashes = hashes + nth.astype("<u8") * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        hashes = (hashes ^ (hashes >> np.uint64(shift))) * np.uint64(factor)
    return bits_by_majority(hashes ^ (hashes >> np.uint64(31)))


def _batches(read: Callable[[pa.RecordBatch], dict[str, tuple]]) -> Callable:
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = read(batch)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))

    return mapped


def prefix_length(n: int, similarity: float) -> int:
    """Of two sets of which the larger shares ``similarity`` with the other, the first so many, in any one order, share a member."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def described(docs: DataFrame, p: NearCopies) -> DataFrame:
    """doc_id, row_key, node (hash of the sequence of words), fp over shingles, spread over words, size (number of shingles) and their prefix."""

    def read(batch: pa.RecordBatch) -> dict[str, tuple]:
        import xxhash

        nodes, fps, spread, sizes, prefixes = [], [], [], [], []
        for text in batch.column(2).to_pylist():
            words = words_of(text)
            nodes.append(xxhash.xxh3_128_hexdigest(b" ".join(words), SEED))
            fps.append(fingerprint(text))
            spread.append(word_print(words))
            own = shingles(words, p.width)
            sizes.append(len(own))
            prefixes.append(own[: prefix_length(len(own), p.similarity)].view(np.int64))
        return {
            "doc_id": (batch.column(0), pa.int64()),
            "row_key": (batch.column(1), pa.string()),
            "node": (nodes, pa.string()),
            "fp": (np.array(fps, dtype=np.uint64).view(np.int64), pa.int64()),
            "spread": (np.array(spread, dtype=np.uint64).view(np.int64), pa.int64()),
            "size": (sizes, pa.int64()),
            "prefix": (prefixes, pa.list_(pa.int64())),
        }

    return arrow_map(docs.select("doc_id", "row_key", "text"), _batches(read), "doc_id long, row_key string, node string, fp long, spread long, size long, prefix array<long>")


def bit_samples(p: NearCopies) -> list[int]:
    """Masks of the sampled bits, as signed longs; fixed by their seed."""
    pick = np.random.default_rng(20_250_301)
    masks = [sum(1 << int(b) for b in pick.choice(BITS, p.sampled_bits, replace=False)) for _ in range(p.tables)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def sampled_buckets(values: DataFrame, p: NearCopies, large: int = LARGE) -> DataFrame:
    """(bucket, fp) by each sample of bits of ``spread``; a large bucket becomes the pairs of its chunks."""
    keys = F.array(*[F.xxhash64(F.lit(n), F.col("spread").bitwiseAND(F.lit(mask))) for n, mask in enumerate(bit_samples(p))])
    first = values.select("fp", F.explode(keys).alias("bucket"))
    counts = first.groupBy("bucket").count().filter(F.col("count") > large)
    hot = stored(counts.select("bucket", F.ceil(F.col("count") / (large // 2)).cast("int").alias("chunks")), "hot-buckets")
    if not hot.take(1):
        return first
    marked = first.join(size_checked(hot, 12), "bucket", "left")
    return marked.select("fp", F.explode(F.when(F.col("chunks").isNull(), F.array("bucket")).otherwise(_chunk_pairs("bucket", "fp"))).alias("bucket"))


def _chunk_pairs(group: str, member: str) -> Column:
    """New groups for a member: its chunk of ``chunks`` beside each chunk."""
    chunk = F.pmod(F.xxhash64(member, F.lit("chunk")), F.col("chunks")).cast("int")
    return F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.xxhash64(group, F.least(x, chunk), F.greatest(x, chunk)))


def _linked(left: np.ndarray, right: np.ndarray) -> dict[int, list[int]]:
    """Members of each component of some pairs, by the least member."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.setdefault(i, i)) != i:
            root[i] = root[up]
            i = up
        return i

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    found: dict[int, list[int]] = {}
    for i in root:
        found.setdefault(find(i), []).append(i)
    return found


def near_groups(values: DataFrame, p: NearCopies) -> DataFrame:
    """(group, fp): fingerprints that hang together by the radius within some bucket.

    A group is named by its members, so the same one from several buckets is one.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def groups(buckets: np.ndarray, found: np.ndarray) -> Iterator[pa.RecordBatch]:
            edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]]))
            size = np.repeat(np.diff(edges), np.diff(edges))
            few = (size > 1) & (size < SMALL)
            members = [found[few][at] for at in _linked(*compare_neighbours(found[few], buckets[few], p.radius)).values()]
            for low, high in zip(edges, edges[1:], strict=False):
                if high - low >= SMALL:
                    own = np.unique(found[low:high])
                    root = compare_bucket(own, p.radius)
                    members += [own[root == r] for r in np.unique(root[root != np.arange(len(own))])]
            members = [np.sort(m) for m in members]
            names = np.array([xxhash.xxh64_intdigest(m.tobytes(), SEED) for m in members], dtype=np.uint64).view(np.int64)
            sizes = [len(m) for m in members]
            fps = np.concatenate(members) if members else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, sizes)), pa.array(fps.view(np.int64))], names=["group", "fp"])

        held_b, held_v = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            held_b = np.concatenate([held_b, np.asarray(batch.column(0))])
            held_v = np.concatenate([held_v, np.asarray(batch.column(1)).view(np.uint64)])
            if len(held_b) and held_b[0] != held_b[-1]:
                end = int(np.searchsorted(held_b, held_b[-1]))
                yield from groups(held_b[:end], held_v[:end])
                held_b, held_v = held_b[end:], held_v[end:]
        if len(held_b):
            yield from groups(held_b, held_v)

    slots = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = sampled_buckets(values, p).select("bucket", "fp").repartition(slots, "bucket").sortWithinPartitions("bucket")
    return arrow_map(buckets, compare, "group long, fp long").distinct()


def shingle_sets(docs: DataFrame, width: int, packed: bool = True) -> DataFrame:
    """node, n and shingles (packed, or else a list) of each row of (node, text)."""
    kind = (pa.binary(), "binary") if packed else (pa.list_(pa.int64()), "array<long>")

    def read(batch: pa.RecordBatch) -> dict[str, tuple]:
        found = [shingles(words_of(text), width) for text in batch.column(1).to_pylist()]
        return {"node": (batch.column(0), pa.string()), "n": ([len(x) for x in found], pa.int64()), "shingles": ([x.tobytes() if packed else x.view(np.int64) for x in found], kind[0])}

    return arrow_map(docs.select("node", "text"), _batches(read), f"node string, n long, shingles {kind[1]}")


def prefix_buckets(nodes: DataFrame, texts: DataFrame, p: NearCopies) -> DataFrame:
    """(bucket, short): the prefix of each node's shingles, by hash, but hot ones last; short is a hash of the node.

    ``nodes`` has node, row_key and prefix, by hash alone; ``texts`` row_key and text. Any one
    order will do: hot shingles come last as else all texts with a common phrase would meet.
    """
    first = nodes.select("node", F.explode("prefix").alias("bucket"))
    hot = stored(first.groupBy("bucket").count().filter(F.col("count") > p.hot).select("bucket", F.lit(1).alias("hot")), "hot-shingles")
    short = F.xxhash64("node").alias("short")
    if not hot.take(1):
        return first.select("bucket", short)
    moved = stored(first.join(size_checked(hot, 12), "bucket").select("node").distinct(), "moved-nodes")
    asked = stored(nodes.select("node", "row_key").join(size_checked(moved, 48), "node", "left_semi"), "moved-rows")
    sets = shingle_sets(texts.join(size_checked(asked, 80), "row_key"), p.width, packed=False).dropDuplicates(["node"])
    each = sets.select("node", "n", F.explode("shingles").alias("bucket")).join(size_checked(hot, 12), "bucket", "left")
    # Hashes are in the order of numbers without sign, as in the prefixes by hash.
    order = W.partitionBy("node").orderBy(F.coalesce("hot", F.lit(0)), F.col("bucket").bitwiseXOR(F.lit(-(1 << 63))))
    length = F.col("n") - F.ceil(F.lit(p.similarity) * F.col("n") - 1e-9) + 1
    again = stored(each.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= length).select("node", "bucket"), "moved-prefixes")
    return first.join(size_checked(moved, 48), "node", "left_anti").unionByName(again).select("bucket", short)


def left_pairs(buckets: DataFrame, nodes: DataFrame, label: DataFrame, p: NearCopies) -> DataFrame:
    """(group, short): two nodes with different labels that may be similar enough, by how many shingles of their prefixes they share.

    All of a set's shingles that it shares with another's prefix are in its own prefix or after
    it; so if too few are shared there, the rest of the set is too small to make up for it.
    Buckets of the same nodes are counted as one. Like hashes of two nodes only add pairs.
    """
    told = nodes.join(size_checked(label, 64), "node", "left").select(F.xxhash64("node").alias("short"), "size", F.xxhash64(F.coalesce("label", "node")).alias("leader"))
    told = size_checked(stored(told, "left-nodes"), 24)
    led = buckets.join(told, "short")
    met = led.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("short")).alias("x"), F.min("leader").alias("low"), F.max("leader").alias("high"))
    met = stored(met.filter("low <> high").select("bucket", F.xxhash64("n", "x", "low", "high").alias("group")), "left-buckets")
    weights = met.groupBy("group").agg(F.count(F.lit(1)).alias("weight"))
    members = stored(buckets.join(size_checked(met, 16), "bucket").select("group", "short").distinct().join(told, "short"), "left-members")
    other = members.select("group", *[F.col(c).alias(f"of_{c}") for c in ("short", "size", "leader")])
    most, every = F.greatest("size", "of_size"), F.col("size") + F.col("of_size")
    pairs = members.join(other, "group").filter((F.col("short") < F.col("of_short")) & (F.col("leader") != F.col("of_leader")) & (F.least("size", "of_size") >= p.similarity * most - 1e-9))
    shared = pairs.join(size_checked(weights, 16), "group").groupBy("short", "of_short", "size", "of_size").agg(F.sum("weight").alias("shared"))
    least = F.ceil(p.similarity / (1 + p.similarity) * every - 1e-9) - F.ceil(p.similarity * most - 1e-9) + 1
    found = shared.filter(F.col("shared") >= least).select(F.xxhash64("short", "of_short").alias("group"), F.explode(F.array("short", "of_short")).alias("short"))
    return stored(found, "left-pairs", replaces=[met, members])


def verified(members: DataFrame, p: NearCopies, radius: int | None = None) -> DataFrame:
    """(fp, root): links between nodes of a group whose shingles are similar enough.

    Fingerprints that differ in more than ``radius`` bits, ``p.radius`` by default, are not compared.

    Within a group, a pair is checked only if nothing links it yet, so a large group of
    near copies takes one check a member. ``members`` has group, node, fp, n, shingles.
    """

    radius = p.radius if radius is None else radius

    def similar(a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both >= p.similarity * (len(a) + len(b) - both)

    def checked(nodes: list[str], fps: list[int], sets: list[np.ndarray]) -> Iterator[tuple[str, str]]:
        values, sizes = np.array(fps, dtype=np.int64).view(np.uint64), np.array([len(s) for s in sets])
        root = np.arange(len(nodes))
        for i in range(1, len(nodes)):
            least, most = np.minimum(sizes[:i], sizes[i]), np.maximum(sizes[:i], sizes[i])
            near = np.flatnonzero((np.bitwise_count(values[:i] ^ values[i]) <= radius) & (least >= p.similarity * most))
            while len(near):
                j, near = near[0], near[1:]
                if similar(sets[i], sets[j]):
                    yield nodes[i], nodes[j]
                    root[root == root[i]] = root[j]
                near = near[root[near] != root[i]]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, fps, sets = None, [], [], []

        def out() -> pa.RecordBatch:
            pairs = list(checked(nodes, fps, sets))
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string())], names=["fp", "root"])

        for batch in batches:
            for name, node, fp, packed in zip(*(batch.column(c).to_pylist() for c in ("group", "node", "fp", "shingles")), strict=True):
                if name != group:
                    yield out()
                    group, nodes, fps, sets = name, [], [], []
                nodes.append(node)
                fps.append(fp)
                sets.append(np.frombuffer(packed, dtype="<u8"))
        yield out()

    slots = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select("group", "node", "fp", "shingles").repartition(slots, "group").sortWithinPartitions("group")
    return arrow_map(dealt, check, "fp string, root string")


def _checked(members: DataFrame, texts: DataFrame, p: NearCopies, radius: int) -> DataFrame:
    """Links within the groups of ``members`` (group, node, fp, row_key), by the shingles of their texts."""
    members = stored(members, "group-members")
    asked = stored(members.select("node", "row_key").distinct(), "candidates")
    sets = stored(shingle_sets(texts.join(size_checked(asked, 80), "row_key"), p.width).dropDuplicates(["node"]), "shingle-sets", replaces=[asked])
    measured = members.join(sets.select("node", "n"), "node")
    weights = measured.groupBy("group").agg(F.sum("n").alias("n")).filter(F.col("n") > p.group_shingles)
    heavy = stored(weights.select("group", F.ceil(F.col("n") / (p.group_shingles // 2)).cast("int").alias("chunks")), "heavy-groups")
    dealt = members.select("group", "node", "fp")
    if heavy.take(1):
        spread = dealt.join(size_checked(heavy, 12), "group", "left")
        dealt = spread.select("node", "fp", F.explode(F.when(F.col("chunks").isNull(), F.array("group")).otherwise(_chunk_pairs("group", "node"))).alias("group"))
    return stored(verified(dealt.join(sets, "node"), p, radius), "group-links", replaces=[members, sets, heavy])


def keep_one(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", p: NearCopies = NearCopies()) -> DataFrame:  # noqa: B008
    """One row of each group of near copies: that with the least id, of ties the least row key.

    Groups are joined through chains of similar texts. The texts of rows are not exchanged;
    what is: 24 hashes for each distinct fingerprint, a fifth of the shingles, and those of candidates.

    A null or empty text has no words, and is a copy of other such texts alone. A text of
    fewer words than a shingle is one shingle. A null id is never the least where another
    is there. Of rows that agree in id and text one stays. An empty table gives no rows. A
    text may have any length: a task holds one batch of texts, or the shingles of one group,
    which is cut into pairs of chunks beyond ``p.group_shingles``. Columns of any name stay.
    """
    named = docs.select(F.struct("*").alias("row"), row_key(F.col(doc_id), F.col(text)).alias("row_key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = stored(described(named, p), "described")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    nodes = stored(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("spread").alias("spread"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.min(rank).alias("rank"), F.count(F.lit(1)).alias("rows")), "nodes")
    values = stored(nodes.groupBy("fp", "spread").agg(F.count(F.lit(1)).alias("n_nodes")), "distinct-fingerprints")
    shared = values.groupBy("fp").agg(F.sum("n_nodes").alias("n_nodes"))
    texts, keyed = named.select("row_key", "text"), nodes.select("fp", "node", F.col("rank.row_key").alias("row_key"), "prefix")

    groups = near_groups(values, p).unionByName(shared.filter("n_nodes > 1").select(F.xxhash64("fp", F.lit("own")).alias("group"), "fp"))
    groups = stored(groups, "near-groups")
    links = stored(_checked(groups.join(keyed.drop("prefix"), "fp"), texts, p, p.radius), "links")
    label = components(links, row_bytes=64)
    buckets = stored(prefix_buckets(keyed, texts, p), "prefix-buckets")
    left = left_pairs(buckets, nodes, label, p)
    if left.take(1):
        more = _checked(left.join(keyed.drop("prefix").withColumn("short", F.xxhash64("node")), "short").drop("short"), texts, p, BITS)
        label = components(stored(links.unionByName(more), "all-links"), row_bytes=64)

    labelled = nodes.join(size_checked(label.withColumnRenamed("label", "leader"), 64), "node", "left").withColumn("leader", F.coalesce("leader", "node"))
    labelled = stored(labelled, "labelled-nodes", replaces=[values, groups, left, buckets])
    best = labelled.groupBy("leader").agg(F.min("rank").alias("best"), F.sum("rows").alias("rows")).filter("rows > 1")
    best = stored(best.select("leader", F.col("best.row_key").alias("best")), "best-rows")
    of_node = stored(labelled.join(size_checked(best, 64), "leader").select("node", "best"), "best-of-nodes")
    crowded = rows.join(size_checked(of_node, 64), "node").groupBy("row_key", "best").count()
    crowded = stored(crowded, "rows-with-copies")

    gone = stored(crowded.filter("row_key <> best").select("row_key"), "copies")
    repeated = stored(crowded.filter("row_key = best and count > 1").select("row_key"), "repeated-rows")
    kept = named.select("row", "row_key").join(size_checked(gone, 32), "row_key", "left_anti")
    if repeated.take(1):
        once = kept.join(size_checked(repeated, 32), "row_key", "left_semi").dropDuplicates(["row_key"])
        kept = kept.join(size_checked(repeated, 32), "row_key", "left_anti").unionByName(once)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
