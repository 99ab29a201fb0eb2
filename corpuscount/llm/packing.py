"""Harmonic packing of token sequences.

Every worker packs its own documents, with no exchange between workers. A document's first multiples of the
capacity C are sequences by themselves. What remains, r < C tokens, belongs to class k where r lies in
(C/(k+1), C/k], and each bin of class k takes exactly k remainders; below C/SMALLEST a bin takes SMALLEST.
The room that a full bin has left is filled with a piece cut from a running filler: some documents, taken
when the filler runs low, that are cut wherever a bin ends. At its end a worker lays out what is still open,
one document after another, in full sequences and then in sequences whose lengths are powers of two. So no
sequence needs padding, and only filler documents and those longer than C are cut.

State of a worker: fewer than k remainders of at most C/k tokens for each class, and a filler of less than
three capacities. A lost task is run again from its own rows alone; sequence ids hold the task's number, so they
never meet.
"""

from __future__ import annotations

import gc
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscount.llm.bpe import pieces_of
from corpuscount.llm.exchange import trim
from corpuscount.runtime import SMALL_BATCH, prepare

#: Remainders below C/SMALLEST share one class.
SMALLEST = 32
#: Documents whose pieces are handed on together.
ROWS = 512
#: A piece: (document, tokens of the document before it, the document's tokens, the piece's ids as bytes).
Piece = tuple[object, int, int, bytes]


class Bins:
    """One worker's bins. add() and close() return the sequences that became full, each a list of pieces."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list[Piece]] = {k: [] for k in range(1, SMALLEST + 1)}
        self.filler: deque[Piece] = deque()
        self.spare = 0  # tokens in the filler

    def add(self, doc: object, ids: bytes) -> list[list[Piece]]:
        c, n = self.capacity, len(ids) // 4
        whole = n - n % c
        out = [[(doc, at, n, ids[4 * at : 4 * (at + c)])] for at in range(0, whole, c)]
        if whole == n:
            return out
        rest = (doc, whole, n, ids[4 * whole :])
        if self.spare < c:
            self.filler.append(rest)
            self.spare += n - whole
            return out
        k = min(c // (n - whole), SMALLEST)
        bin_ = self.open[k]
        bin_.append(rest)
        if len(bin_) == k:
            self.open[k] = []
            out.append(bin_ + self._cut(c - sum(len(x[3]) for x in bin_) // 4))
        return out

    def _cut(self, room: int) -> list[Piece]:
        """So many tokens from the front of the filler."""
        out = []
        while room and self.filler:
            doc, at, n, ids = self.filler.popleft()
            have = len(ids) // 4
            take = min(have, room)
            out.append((doc, at, n, ids[: 4 * take]))
            if take < have:
                self.filler.appendleft((doc, at + take, n, ids[4 * take :]))
            room -= take
            self.spare -= take
        return out

    def close(self) -> list[list[Piece]]:
        for bin_ in self.open.values():
            self.filler.extend(bin_)
            self.spare += sum(len(x[3]) // 4 for x in bin_)
        out = []
        while self.spare:
            out.append(self._cut(self.capacity if self.spare >= self.capacity else 1 << (self.spare.bit_length() - 1)))
        return out


def harmonic_pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pack the tokens of every whole text, each followed by end_id, into sequences of at most ``capacity`` tokens.

    Returns a row for each piece: id, start (tokens of its document before it), length, ids_crc32, doc_tokens,
    sequence_id, offset (within the sequence), and ``ids`` (array of long) with keep_ids. Null or empty text is
    a document of end_id alone. Equal rows are packed as often as they occur; an empty table gives no row; other
    columns of docs are left out. ``capacity`` must be a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    prepare(docs.sparkSession, SMALL_BATCH)
    end = end_id.to_bytes(4, "little")
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("text"))
    kind = rows.schema[0].dataType.simpleString()
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = f"`{id_col}` {kind}, " + ", ".join(f"`{x}` long" for x in names[1:]) + (", ids array<long>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the tokenizer's many small tuples live long and form no cycles
        try:
            yield from filled(batches)
        finally:
            gc.enable()
            trim()

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bins, made, id_type = pieces_of(tokenizer, "library"), Bins(capacity), TaskContext.get().partitionId() << 32, pa.int64()

        def laid(sequences: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal made
            cols: list[list] = [[] for _ in names]
            ids = []
            for seq in sequences:
                offset = 0
                for doc, at, n, raw in seq:
                    size = len(raw) // 4
                    for col, v in zip(cols, (doc, at, size, zlib.crc32(raw), n, made, offset), strict=True):
                        col.append(v)
                    if keep_ids:
                        ids.append(raw)
                    offset += size
                made += 1
            data = {x: pa.array(col, id_type if x == id_col else pa.int64()) for x, col in zip(names, cols, strict=True)}
            if keep_ids:  # from bytes to Arrow without a Python number for each id
                offsets = np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32)
                data["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int64)))
            return pa.RecordBatch.from_pydict(data)

        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            id_type = b.schema.field(0).type
            full: list[list[Piece]] = []
            for doc, (raw, _) in zip(b.column(0).to_pylist(), own.encoded(b.column(1).to_pylist()), strict=True):
                full += bins.add(doc, raw + end)
            yield laid(full)
        yield laid(bins.close())

    return rows.mapInArrow(run, schema)
