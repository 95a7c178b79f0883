"""Alignment of two tokenisations of the same bytes.

Tokens of a batch of documents stay in Arrow: lists of ids are flattened beside the
document that each came from, token lengths become end offsets by a cumulative sum over
each document, and a hash join on (document, end) finds where tokens of both vocabularies
end, which cuts a text into groups. Pairs of overlapping tokens are counted batch by batch
with ``Table.group_by``; Spark adds the partial counts up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, size_checked, stored
from .tokens import PIECE_VOCABULARY, VOCABULARY, byte_bpe, vocabulary_path

#: Pairs of ids, at 13 bytes each, that are sent to every task at most; beyond it they are joined by a shuffle.
BROADCAST_PAIRS = 4_000_000
#: Distinct pairs that a task holds before it hands their counts on.
HELD_PAIRS = 1_000_000
#: Bits of a pair's code that the second id has.
SHIFT = 32

_RESULT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@dataclass(frozen=True)
class Vocabularies:
    """Both tokenizers, the bytes of each token, and each id as it is written in a digest."""

    a: object
    b: object
    bytes_a: pa.Array
    bytes_b: pa.Array
    written: pa.Array  #: a ids followed by "," then by "|", b ids followed by "," then ";" then nothing


@lru_cache(maxsize=2)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    import sentencepiece

    a = byte_bpe(path_a)
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    pieces = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(b.id_to_piece, range(b.get_piece_size())))]
    written = [f"{i}{mark}" for mark in ",|" for i in range(a.size)] + [f"{i}{mark}" for mark in (",", ";", "") for i in range(len(pieces))]
    return Vocabularies(a, b, pa.array(a.token_bytes(), pa.large_binary()), pa.array(pieces, pa.large_binary()), pa.array(written, pa.large_string()))


def _lists(ids: list[list[int]]) -> pa.LargeListArray:
    offsets = np.zeros(len(ids) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in ids]) if ids else np.zeros(0, dtype=np.int32)
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat))


class _Tokens:
    """The tokens of a batch of documents in one vocabulary, flat."""

    def __init__(self, ids: list[list[int]], token_bytes: pa.Array) -> None:
        lists = _lists(ids)
        self.ids = pc.list_flatten(lists)
        self.parent = pc.list_parent_indices(lists)
        self.first = np.asarray(lists.offsets)  # of each document's tokens
        spelt = token_bytes.take(self.ids)
        lengths = pc.cast(pc.binary_length(spelt), pa.int64())
        self.upto = np.asarray(pc.cumulative_sum(lengths)) if len(self.ids) else np.zeros(0, dtype=np.int64)
        self.base = np.concatenate([[0], self.upto])[self.first]  # bytes before each document, and all
        self.end = pa.array(self.upto - self.base[np.asarray(self.parent)])  # the sum starts anew in each document
        self.data = memoryview(spelt.buffers()[2] if len(self.ids) else b"").cast("B")

    def spells(self, document: int, text: bytes) -> bool:
        return self.data[self.base[document] : self.base[document + 1]] == text

    def table(self) -> pa.Table:
        return pa.table({"document": self.parent, "end": self.end})


def _segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each document's values, where ``first`` has the place of its first value, and the end of all."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[first])


def align(texts: list[str | None], own: Vocabularies) -> dict[str, object]:
    """Counts, digests and linked pairs of a batch of texts; a text's pairs are the codes of all its links in order."""
    known = [" " + t if t else "" for t in texts]
    ids_a = [own.a.encode(t) if t else [] for t in known]
    ids_b = own.b.encode([t or "" for t in texts], num_threads=1)
    a, b = _Tokens(ids_a, own.bytes_a), _Tokens(ids_b, own.bytes_b)
    spelt = [t.encode() for t in known]
    wrong = [i for i, t in enumerate(spelt) if not (a.spells(i, t) and b.spells(i, t))]
    if wrong:
        for i in wrong:
            ids_a[i], ids_b[i] = [], []
        a, b = _Tokens(ids_a, own.bytes_a), _Tokens(ids_b, own.bytes_b)

    both = a.table().join(b.table(), ["document", "end"], join_type="inner", use_threads=False)
    cuts = np.sort(a.base[np.asarray(both["document"])] + np.asarray(both["end"]))
    n_groups = np.diff(np.searchsorted(cuts, a.base, side="right"))

    # Documents have the same bytes in both vocabularies, so offsets run on over the whole batch.
    before_a, before_b = np.concatenate([[0], a.upto]), np.concatenate([[0], b.upto])
    low = np.searchsorted(b.upto, before_a[:-1], side="right")
    high = np.searchsorted(before_b[:-1], a.upto, side="left")
    times = high - low
    ends = np.cumsum(times)
    of_a = np.repeat(np.arange(len(times)), times)
    of_b = np.arange(len(of_a)) + np.repeat(low - (ends - times), times)
    codes = (np.asarray(a.ids).astype(np.uint64)[of_a] << np.uint64(SHIFT)) | np.asarray(b.ids).astype(np.uint64)[of_b]

    return {"n_a": np.diff(a.first), "n_b": np.diff(b.first), "n_groups": n_groups, "n_links": _segment_sums(times, a.first), "codes": codes, "groups_sha256": _digests(a, b, cuts, own)}


def _digests(a: _Tokens, b: _Tokens, cuts: np.ndarray, own: Vocabularies) -> list[str]:
    """SHA-256 of each document's groups as text, "" where it has none.

    Every token is written with the mark that follows it; where it stands in the text is
    its own place plus that of the other vocabulary's tokens before it. The written ids of
    a batch are taken by one Arrow call, whose buffer is the text.
    """
    n_a, n_b = len(a.ids), len(b.ids)
    last_a, last_b = np.searchsorted(a.upto, cuts), np.searchsorted(b.upto, cuts)  # the last token of each group
    ends_a, ends_b = np.zeros(n_a, dtype=np.int64), np.zeros(n_b, dtype=np.int64)
    ends_a[last_a], ends_b[last_b] = 1, 1
    group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    b_before = np.concatenate([[0], last_b + 1])
    size_a, size_b = own.a.size, len(own.bytes_b)
    ends_b[b.first[1:][np.diff(b.first) > 0] - 1] = 2  # the last token of a document
    order = np.empty(n_a + n_b, dtype=np.int64)
    order[np.arange(n_a) + b_before[group_a]] = np.asarray(a.ids) + size_a * ends_a
    order[np.arange(n_b) + last_a[group_b] + 1] = np.asarray(b.ids) + 2 * size_a + size_b * ends_b
    written = own.written.take(pa.array(order))
    if not len(written):
        return [""] * (len(a.first) - 1)
    at = np.frombuffer(written.buffers()[1], dtype=np.int64)[: len(written) + 1]
    bounds = at[a.first + b.first]
    data = memoryview(written.buffers()[2])
    return [hashlib.sha256(data[i:j]).hexdigest() if j > i else "" for i, j in zip(bounds, bounds[1:], strict=False)]


def _packed(codes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The codes of each document: both ids in 16 bits each where all fit, else in 32; the first byte tells."""
    low, high = codes & np.uint64((1 << SHIFT) - 1), codes >> np.uint64(SHIFT)
    if len(codes) and max(low.max(), high.max()) >= 1 << 16:
        whole, mark, width = codes.astype("<u8").tobytes(), b"\x08", 8
    else:
        whole, mark, width = ((high << np.uint64(16)) | low).astype("<u4").tobytes(), b"\x04", 4
    return [mark + whole[i * width : j * width] for i, j in zip(bounds, bounds[1:], strict=False)]


def _unpacked(links: bytes) -> np.ndarray:
    if links[:1] == b"\x08":
        return np.frombuffer(links, dtype="<u8", offset=1)
    short = np.frombuffer(links, dtype="<u4", offset=1).astype(np.uint64)
    return ((short >> np.uint64(16)) << np.uint64(SHIFT)) | (short & np.uint64(0xFFFF))


def tokenised(docs: DataFrame, id: str, text: str, path_a: str, path_b: str) -> DataFrame:
    """A stored table of what each document gives by itself; ``links`` has its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabularies(path_a, path_b)
        for batch in batches:
            found = align(batch.column("text").to_pylist(), own)
            bounds = np.concatenate([[0], np.cumsum(found["n_links"])])
            counts = [pa.array(found[n], pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *counts, pa.array(found["groups_sha256"]), pa.array(_packed(found["codes"], bounds), pa.binary())], names=names)

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
    kinds = [docs.schema[id].dataType, *[T.LongType()] * 4, T.StringType(), T.BinaryType()]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, kinds, strict=True)])
    return stored(arrow_map(docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")), run, schema), "alignment")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): links of each pair over all documents, and if no pair of its second id has more.

    A task counts its own pairs, so however frequent a pair is, it gives Spark a few rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            codes = [_unpacked(x) for x in batch.column(0).to_pylist()]
            pairs = pa.table({"pair": np.concatenate(codes).view(np.int64)}) if codes else pa.table({"pair": pa.array([], pa.int64())})
            held.append(pairs.group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "n"]))
            if sum(map(len, held)) > HELD_PAIRS:
                held = [merged(held)]
                if len(held[0]) > HELD_PAIRS // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from merged(held).to_batches()

    def merged(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"]).combine_chunks()

    counts = stored(arrow_map(found.select("links"), count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    second = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    highest = stored(counts.groupBy(second.alias("b")).agg(F.max("n").alias("most")), "highest-counts")
    best = counts.withColumn("b", second).join(size_checked(highest, 16), "b")
    return stored(best.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "weighed-pairs", replaces=[counts, highest])


def _looked_up(found: DataFrame, weighed: DataFrame) -> DataFrame:
    """``found`` with n_best and count_sum from a table of pairs that each task holds."""
    table = weighed.toArrow().sort_by("pair")
    shared = found.sparkSession.sparkContext.broadcast((table["pair"].to_numpy(), table["n"].to_numpy(), table["best"].to_numpy()))
    schema = T.StructType([*found.drop("links").schema, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            sums = [(0, 0)] * batch.num_rows
            for i, links in enumerate(batch.column("links").to_pylist()):
                if len(links) > 1:
                    at = np.searchsorted(pairs, _unpacked(links).view(np.int64))
                    sums[i] = (int(best[at].sum()), int(n[at].sum()))
            kept = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "links"]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array([s[k] for s in sums], pa.int64()) for k in (0, 1)]], names=schema.names)

    return arrow_map(found, look, schema)


def _joined(found: DataFrame, weighed: DataFrame) -> DataFrame:
    """The same by a shuffle: each document's distinct pairs meet the table of pairs by an equi join."""
    rows = found.withColumn("row", F.monotonically_increasing_id())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, links in zip(batch.column("row").to_pylist(), batch.column("links").to_pylist(), strict=True):
                pairs, times = np.unique(_unpacked(links).view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_pydict({"row": pa.array([row] * len(pairs), pa.int64()), "pair": pa.array(pairs), "times": pa.array(times, pa.int64())})

    links = arrow_map(rows.select("row", "links"), spread, "row long, pair long, times long")
    met = links.join(weighed.hint("merge"), "pair").groupBy("row")
    sums = met.agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")}
    return rows.drop("links").join(sums, "row", "left").drop("row").withColumns(zeros)


def aligned(docs: DataFrame, *, id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pieces: str = PIECE_VOCABULARY) -> DataFrame:
    """For each document how the tokens of two vocabularies lie over its bytes.

    A text is encoded with a space before it, without special tokens; ``vocabulary`` is a
    byte-level one, ``pieces`` a sentencepiece model that adds the space itself. A group
    ends where tokens of both end (``n_groups``, ``groups_sha256``); two tokens are linked
    if their bytes overlap (``n_links``). ``count_sum`` adds, over a document's links, how
    often their pair of ids is linked in all documents, and ``n_best`` counts the links
    whose pair is the most frequent of its second id, ties included.

    A text that is null or empty, or that a vocabulary does not spell byte by byte, has no
    tokens: zeros and an empty digest. Repeated rows count each time. Columns other than
    the id are not read; an id that has the name of a result column is replaced by it.
    Tables may be empty. A task holds the tokens of an Arrow batch, or of one long text.
    """
    found = tokenised(docs, id, text, vocabulary_path(vocabulary), vocabulary_path(pieces))
    weighed = pair_counts(found)
    summed = _looked_up(found, weighed) if weighed.count() <= BROADCAST_PAIRS else _joined(found, weighed)
    return summed.select(*[F.col("id").alias(id)] * (id not in _RESULT), *_RESULT)


def alignment_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for the registered query."""
    return aligned(docs.select("doc_id", "text"))
