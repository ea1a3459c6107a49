"""Bounded-space online best-fit packing of tokenized documents into sequences.

A document is its ids and an end id. One longer than a sequence is cut into full-length
pieces, of which the first takes what is left over. Pieces arrive in order of a hash, LOOKAHEAD at
once, and are placed one by one, the longest of those at hand first; each goes
to the open sequence with the least sufficient free space, found in a bitset with a bit for
each amount of free space that some open sequence has. At most ``open_bins`` are open: when a
new one would exceed that, the fullest is closed.

Tokenizing runs on all partitions; pieces are narrow rows of numbers, and only they are
dealt out - by a hash of the document, so evenly, whatever the source - to packers of
about PACKER_DOCS documents each. A packer leaves at most some partly filled sequences
at its end, a vanishing share of what it has packed.

Defined cases: a null or empty text is its end id alone; null and repeated document ids
are packed like others; pieces of the same length are placed in order of document, piece and ids, and of sequences
with the same free space the one that came to it last is taken; very long texts are cut into pieces, nothing of them is left out;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
OPEN_BINS = 8192
#: Pieces that a packer takes at once, the longest first.
LOOKAHEAD = 8192
END_ID = 2
PACKER_DOCS = 200_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = PIECES + ", sequence_id bigint, offset bigint"


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


class BestFit:
    """``place(length)`` gives (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.free, self.n_open, self.n_bins = 0, 0, 0

    def _take(self, free: int) -> int:
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.free ^= 1 << free
        self.n_open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fits = self.free >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            number, free = self.n_bins, self.capacity
            self.n_bins += 1
        left = free - length
        if left:
            if self.n_open >= self.limit:
                fullest = (self.free & -self.free).bit_length() - 1
                if left <= fullest:
                    return number, self.capacity - free  # itself the fullest
                self._take(fullest)
            self.bins[left].append(number)
            self.free |= 1 << left
            self.n_open += 1
        return number, self.capacity - free


def _tokenizer(path: str | None, end_id: int, capacity: int):
    def cut(batches):
        import struct

        import pyarrow as pa

        from rasterflow.llm import tokens

        encoder, end = tokens.encoder(path), struct.pack("<I", end_id)
        for batch in batches:
            columns = [[], [], [], [], []]
            for doc_id, blob in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1))):
                raw = memoryview(blob + end)
                for k, (start, length) in enumerate(pieces_of(len(raw) // 4, capacity)):
                    for column, value in zip(columns, (doc_id, k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]))):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def _packer(capacity: int, open_bins: int, lookahead: int):
    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fit, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40

        def place(held):
            table = pa.Table.from_batches(held).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
            placed = [fit.place(n) for n in table["length"].to_pylist()]
            table = table.append_column("sequence_id", pa.array([base + b for b, _ in placed], pa.int64())).append_column("offset", pa.array([o for _, o in placed], pa.int64()))
            return table.combine_chunks().to_batches()

        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, lookahead):
                part = batch.slice(at, lookahead)
                if n + part.num_rows > lookahead:
                    yield from place(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield from place(held)

    return pack


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = END_ID, packer_docs: int = PACKER_DOCS, lookahead: int = LOOKAHEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    packers = max(1, math.ceil(rows.count() / packer_docs))
    pieces = rows.mapInArrow(_tokenizer(tokenizer, end_id, capacity), PIECES)
    dealt = pieces.repartition(packers, F.xxhash64("doc_id", "ids_crc32")).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(_packer(capacity, open_bins, lookahead), PLACED)
