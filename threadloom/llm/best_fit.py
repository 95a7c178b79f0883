"""Best-fit-decreasing packing of token ids into rows of one length.

Documents over the row length are cut without loss. Within windows of a bounded number of
tokens, pieces go in order of decreasing length to the fullest row that still has room,
which a segment tree over capacities finds in log(row length) steps. Each task packs what
it reads, so nothing is shuffled and no key can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from .common import arrow_map
from .tokens import END_ID, VOCABULARY, byte_bpe, vocabulary_path

ROW_LENGTH = 2048
#: Tokens that a task packs at once: its memory is bounded by this and one document.
WINDOW_TOKENS = 4_000_000
#: Row numbers of one task; task number times this is added to them.
ROWS_PER_TASK = 1 << 33

_SCHEMA = pa.schema(
    [
        ("row_id", pa.int64()),
        ("n_tokens", pa.int32()),
        ("ids", pa.binary()),
        ("positions", pa.binary()),
        ("cu_seqlens", pa.list_(pa.int32())),
        ("doc_ids", pa.list_(pa.int64())),
        ("starts", pa.list_(pa.int64())),
    ]
)


class Capacities:
    """Open rows by room left; finds the least room that is enough."""

    def __init__(self, length: int) -> None:
        self._leaves = 1 << length.bit_length()
        self._any = bytearray(2 * self._leaves)
        self._rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, row: int, room: int) -> None:
        self._rows[room].append(row)
        node = self._leaves + room
        while node and not self._any[node]:
            self._any[node] = 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """A row with the least room of at least ``size``, and that room; it is taken out."""
        marked, node = self._any, self._leaves + size
        if not marked[node]:
            while node > 1 and (node & 1 or not marked[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self._leaves:
                node = 2 * node if marked[2 * node] else 2 * node + 1
        room = node - self._leaves
        row = self._rows[room].pop()
        if not self._rows[room]:
            marked[node] = 0
            node >>= 1
            while node and not (marked[2 * node] or marked[2 * node + 1]):
                marked[node] = 0
                node >>= 1
        return row, room


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Rows of piece numbers; no row's sizes add up to more than ``length``.

    Pieces go in order of decreasing size, equal ones in the order given.
    """
    open_rows, rows = Capacities(length), []
    for piece in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[piece])
        if found := open_rows.take(size):
            row, room = found
            rows[row].append(piece)
        else:
            row, room = len(rows), length
            rows.append([piece])
        if room > size:
            open_rows.put(row, room - size)
    return rows


def pack_best_fit(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    vocabulary: str = VOCABULARY,
    length: int = ROW_LENGTH,
    window_tokens: int = WINDOW_TOKENS,
    end_id: int = END_ID,
    pad_id: int = 0,
) -> DataFrame:
    """Packed rows: a matrix row of ids, segment bounds and positions.

    ``ids`` and ``positions`` are ``length`` little-endian unsigned 32-bit numbers: ids of
    the row's segments and then ``pad_id``; positions that start at 0 in each segment and
    in the padding. ``cu_seqlens`` has 0 and the end of each segment; ``doc_ids`` and
    ``starts`` say which part of which document a segment is, counted in its ids.

    Each document's ids end with ``end_id``. A null or empty text gives that id alone. An
    empty table gives no rows; repeated rows are packed as often as they stand; a null
    document id stays null; other columns are not used. A text may have any length: a task
    holds one window of tokens and one document. Rows are numbered by task, so another
    division of the input into files packs and numbers them in another way.
    """
    path = vocabulary_path(vocabulary)
    pad = np.uint32(pad_id)

    def emit(pieces: list[tuple], numbers: Iterator[int]) -> Iterator[pa.RecordBatch]:
        rows = best_fit(np.array([len(x[2]) for x in pieces]), length)
        for low in range(0, len(rows), 256):
            columns: list[list] = [[] for _ in _SCHEMA]
            for row in rows[low : low + 256]:
                ids, positions = np.full(length, pad, dtype="<u4"), np.zeros(length, dtype="<u4")
                bounds = [0]
                for x in row:
                    part = pieces[x][2]
                    end = bounds[-1] + len(part)
                    ids[bounds[-1] : end] = part
                    positions[bounds[-1] : end] = np.arange(len(part))
                    bounds.append(end)
                positions[bounds[-1] :] = np.arange(length - bounds[-1])
                values = (next(numbers), bounds[-1], ids.tobytes(), positions.tobytes(), bounds, [pieces[x][0] for x in row], [pieces[x][1] for x in row])
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = byte_bpe(path)
        first = TaskContext.get().partitionId() * ROWS_PER_TASK
        numbers = iter(range(first, first + ROWS_PER_TASK))
        pieces: list[tuple] = []
        held = 0
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(tokenizer.ids(value or ""), tokenizer.dtype.type(end_id))
                pieces += [(key, at, ids[at : at + length]) for at in range(0, len(ids), length)]
                held += len(ids)
                if held >= window_tokens:
                    yield from emit(pieces, numbers)
                    pieces, held = [], 0
        if pieces:
            yield from emit(pieces, numbers)

    keyed = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return arrow_map(keyed, pack, T.StructType(list(from_arrow_schema(_SCHEMA))))


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet; ``path`` must not be there yet."""
    packed.write.mode("errorifexists").parquet(path)
