"""Packing along a space-filling curve.

A document's hashed vector is projected to a few dimensions, and its place on a Hilbert
curve through them orders the corpus: neighbours on the curve are alike, and are packed
beside each other. Sequences are cut from one gapless order, so only the last is padded.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, stored
from .tokens import END_ID, VOCABULARY, byte_bpe, vocabulary_path

SEQUENCE = 2048
DIMENSIONS = 3
#: Bits of each coordinate; the curve's key has DIMENSIONS times as many.
BITS = 14
#: Entries of a document's hashed vector.
HASHED = 4096
#: Low bits of the sort key, from the row's hash: they spread equal texts over ranges.
SPREAD_BITS = 20
#: Tokens that a range of the sorted order should have, and the most ranges; beyond
#: that many the ranges grow, and a task's sort spills.
RANGE_TOKENS = 500_000
MOST_RANGES = 20_000


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Distance along the Hilbert curve of integer points (rows) below 2**bits.

    Skilling's transform (AIP Conf. Proc. 707, 2004), on all points at once.
    """
    x = points.T.astype(np.uint64).copy()
    n, zero = len(x), np.uint64(0)
    q = np.uint64(1 << (bits - 1))
    while q > 1:
        p = q - np.uint64(1)
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, zero, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), np.uint64(1 << (bits - 1))
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - np.uint64(1), zero)
        q >>= np.uint64(1)
    x ^= t
    keys = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            keys = (keys << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return keys


@lru_cache(maxsize=2)
def _projection(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sign of each id, and the Gaussian matrix; fixed by their seed."""
    rng = np.random.default_rng(20_240_601)
    return rng.integers(0, HASHED, size), rng.choice([-1.0, 1.0], size), rng.standard_normal((HASHED, DIMENSIONS))


def curve_place(ids: np.ndarray, size: int) -> np.ndarray:
    """Integer coordinates of a document, evenly spread for unrelated vectors."""
    bucket, sign, matrix = _projection(size)
    vector = np.bincount(bucket[ids], weights=sign[ids], minlength=HASHED)
    norm = float(np.sqrt(vector @ vector)) or 1.0
    at = [0.5 * (1 + math.erf(v / norm / math.sqrt(2))) for v in vector @ matrix]
    return np.array([min(int(v * (1 << BITS)), (1 << BITS) - 1) for v in at])


def _batch(columns: dict[str, tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def token_table(docs: DataFrame, *, text: str, doc_id: str, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, ids (packed), n_tokens and the place on the curve, for each row."""
    path = vocabulary_path(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_bpe(path)
        end = np.array([end_id], dtype=tokenizer.dtype)
        for batch in batches:
            places, rows = [], []
            for value in batch.column(1).to_pylist():
                ids = tokenizer.ids(value or "")
                places.append(curve_place(ids, tokenizer.size))
                rows.append((ids.tobytes() + end.tobytes(), len(ids) + 1))
            keys = hilbert_keys(np.array(places).reshape(-1, DIMENSIONS), BITS).astype(np.int64)
            yield _batch({"doc_id": (batch.column(0), pa.int64()), "spread": (batch.column(2), pa.int64()), "curve": (keys, pa.int64()), "n_tokens": ([r[1] for r in rows], pa.int64()), "ids": ([r[0] for r in rows], pa.binary())})

    spread = F.shiftrightunsigned(F.xxhash64(doc_id, F.monotonically_increasing_id()), 64 - SPREAD_BITS)
    keyed = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), spread.alias("spread"))
    return arrow_map(keyed, read, "doc_id long, spread long, curve long, n_tokens long, ids binary")


def pack_along_curve(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    sequence: int = SEQUENCE,
) -> DataFrame:
    """Pieces of documents, in sequences of exactly ``sequence`` ids but for the last.

    A piece is doc_id, start (the document's ids before it), length, ids_crc32 (of
    little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset (its place there),
    and ids, packed as little-endian unsigned 32-bit numbers. Sequences follow the curve.

    Tokens are written once to the shared folder and exchanged once by range of the key;
    the key's low bits come from the row, so copies of one text spread over ranges. What
    reaches the driver is a number for each range, of which there are MOST_RANGES at most.

    A null or empty text has the end id alone. An empty table gives no rows; repeated rows
    are packed as often as they stand; a null id stays null; other columns are not used. A
    text may have any length: a task holds one batch of texts. Tokens are written before
    they are ordered, so a lost executor changes nothing; but another division of the same
    rows into files may order equal texts in another way.
    """
    wide = byte_bpe(vocabulary_path(vocabulary)).dtype
    tokens = token_table(docs, text=text, doc_id=doc_id, vocabulary=vocabulary, end_id=end_id)
    key = F.shiftleft("curve", SPREAD_BITS).bitwiseOR(F.col("spread")).alias("key")
    tokens = stored(tokens.select("doc_id", key, "n_tokens", "ids"), "tokens")

    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    ranges = int(min(MOST_RANGES, max(1, total // RANGE_TOKENS)))
    cuts = [i / ranges for i in range(1, ranges)]
    found = tokens.agg(F.percentile_approx("key", cuts, max(10_000, 10 * ranges))).first()[0] if cuts and total else []
    bounds = np.unique(np.array(found or [], dtype=np.int64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(bounds, np.asarray(batch.column("key")), side="right")
            yield batch.append_column("range_id", pa.array(at, pa.int32()))

    def placed(columns: list[str]) -> DataFrame:
        chosen = tokens.select(*columns)
        return arrow_map(chosen, place, T.StructType([*chosen.schema, T.StructField("range_id", T.IntegerType())]))

    sums = dict(placed(["key", "n_tokens"]).groupBy("range_id").agg(F.sum("n_tokens")).collect())
    before = np.concatenate([[0], np.cumsum([sums.get(i, 0) for i in range(len(bounds) + 1)])]).tolist()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for batch in batches:
            out: list[tuple] = []
            for name, ids, range_id in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), batch.column("range_id").to_pylist(), strict=True):
                if range_id != last:
                    last, at = range_id, before[range_id]
                own, start = np.frombuffer(ids, dtype=wide).astype("<u4"), 0
                while start < len(own):
                    offset = at % sequence
                    part = own[start : start + sequence - offset].tobytes()
                    length = len(part) // 4
                    out.append((name, start, length, zlib.crc32(part), len(own), at // sequence, offset, part))
                    start, at = start + length, at + length
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            yield _batch({n: ([r[i] for r in out], pa.binary() if n == "ids" else pa.int64()) for i, n in enumerate(names)})

    slots = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    exchanged = placed(["doc_id", "key", "ids"]).repartition(max(slots, ranges // 4), "range_id").sortWithinPartitions("range_id", "key", "doc_id")
    return arrow_map(exchanged, cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def pieces_digest(docs: DataFrame) -> DataFrame:
    """Pieces without their ids."""
    return pack_along_curve(docs).drop("ids")
