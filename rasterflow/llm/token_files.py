"""Token ids in files of directly addressable codes.

Each id is cut into chunks of eight bits, lowest first. Level k holds the k-th chunk of
every id that has one, and a bitmap that says which of them go on in level k + 1; a rank
directory counts the set bits before each block of 512. So id i is read by one look-up and
one rank in each of at most four levels, and nothing else is decoded.

A file of segments: Parquet rows, written and committed by Spark on whatever store the
shared folder is in, each with one segment's bytes (layout: see ``pack``), its documents
and their lengths. Documents are range-partitioned by id, so segments stand in ascending
order of (part, seq), and a document's place follows from a sum over parts, in two steps - blocks of parts, then parts within
their block - and the running count that the writer keeps within a part.

Defined cases: a null or empty text is its end id alone; a null document id sorts first;
rows of one id stand in the order of a hash of their texts, and repeated rows each get their own entry; other columns are ignored; an empty table gives an
empty result. A text is never cut: a long one makes a long segment.
"""

from __future__ import annotations

import math
import struct
import zlib
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterflow.llm.common import materialize, text_bytes

MAGIC = b"DAC1"
BLOCK_BITS = 512
#: A segment is closed when it has so many ids.
SEGMENT_IDS = 1 << 20
#: UTF-8 bytes of text for each range partition.
PART_BYTES = 16 << 20
END_ID = 0
#: Range partitions up to which their offsets are broadcast.
BROADCAST_PARTS = 100_000
#: Range partitions whose counts are summed first.
BLOCK_PARTS = 4096

SEGMENTS = "part int, seq int, first long, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, payload binary"
ENTRIES = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, last_id bigint"


def pack(ids) -> bytes:
    """Magic, number of levels, then for each level: count, chunks, bitmap, rank directory."""
    import numpy as np

    rest, levels = np.asarray(ids, dtype=np.uint32), []
    while len(rest) or not levels:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        blocks = np.zeros(-(-len(bits) * 8 // BLOCK_BITS) * BLOCK_BITS // 8, np.uint8)
        blocks[: len(bits)] = bits
        ones = np.bitwise_count(blocks.reshape(-1, BLOCK_BITS // 8)).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, "<u4")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
    return MAGIC + struct.pack("<B", len(levels)) + b"".join(levels)


class Reader:
    """Random access to the ids of a packed segment."""

    def __init__(self, payload: bytes):
        import numpy as np

        if payload[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.levels, at = [], 5
        for _ in range(payload[4]):
            (count,) = struct.unpack_from("<Q", payload, at)
            n_bits = -(-count // 8)
            chunks = np.frombuffer(payload, np.uint8, count, at + 8)
            bits = np.frombuffer(payload, np.uint8, n_bits, at + 8 + count)
            ranks = np.frombuffer(payload, "<u4", -(-n_bits * 8 // BLOCK_BITS), at + 8 + count + n_bits)
            self.levels.append((chunks, bits, ranks))
            at += 8 + count + n_bits + 4 * len(ranks)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        import numpy as np

        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            byte, bit = divmod(i, 8)
            if not bits[byte] >> bit & 1:
                break
            block = i // BLOCK_BITS
            before = np.bitwise_count(bits[block * BLOCK_BITS // 8 : byte]).sum() + (int(bits[byte]) & ((1 << bit) - 1)).bit_count()
            i = int(ranks[block]) + int(before)
        return value

    def all(self):
        """Every id, decoded level by level."""
        import numpy as np

        out, at = np.zeros(len(self), np.uint32), None
        for k, (chunks, bits, _) in enumerate(self.levels):
            values = chunks.astype(np.uint32) << np.uint32(8 * k)
            if at is None:
                out |= values
            else:
                out[at] |= values
            more = np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))
            at = more if at is None else at[more]
        return out


def _writer(path: str | None, end_id: int, segment_ids: int):
    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from rasterflow.llm import tokens

        encoder, part = tokens.encoder(path), TaskContext.get().partitionId()
        end, seq, first = struct.pack("<I", end_id), 0, 0
        doc_ids, lengths, blobs, held = [], [], [], 0

        def segment():
            ids = np.frombuffer(b"".join(blobs), "<u4")
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()),
                pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([pack(ids)], pa.binary()),
            ], ["part", "seq", "first", "n_tokens", "doc_ids", "lengths", "payload"])

        for batch in batches:
            for doc_id, blob in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1))):
                blob += end
                doc_ids.append(doc_id)
                lengths.append(len(blob) // 4)
                blobs.append(blob)
                held += lengths[-1]
                if held >= segment_ids:
                    yield segment()
                    seq, first = seq + 1, first + held
                    doc_ids, lengths, blobs, held = [], [], [], 0
        if held:
            yield segment()

    return write


def write_token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, part_bytes: int = PART_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize, write the segment files in ascending id order, and return the written table."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    parts = max(1, math.ceil(text_bytes(rows, "text") / part_bytes))
    rows = rows.withColumn("mark", F.xxhash64("text"))  # texts of one id are spread as well
    rows = rows.repartitionByRange(parts, "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").drop("mark")
    return materialize(rows.mapInArrow(_writer(tokenizer, end_id, segment_ids), SEGMENTS), "token-files")


def _entries(batches):
    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            reader = Reader(row["payload"])
            ids, ends = reader.all().astype("<u4"), [0, *accumulate(row["lengths"])]
            raw = memoryview(ids.tobytes())
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_ids"], pa.int64()),
                pa.array([row["base"] + row["first"] + a for a in ends[:-1]], pa.int64()),
                pa.array(row["lengths"], pa.int64()),
                pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])], pa.int64()),
                pa.array([reader[b - 1] for b in ends[1:]], pa.int64()),
            ], ["doc_id", "start", "n_tokens", "ids_crc32", "last_id"])


def read_token_files(segments: DataFrame) -> DataFrame:
    """A row for each document from the files: doc_id, start, n_tokens, ids_crc32, last_id.

    ``last_id`` is fetched by random access.
    """
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("block", F.expr(f"part div {BLOCK_PARTS}"))
    totals = materialize(totals, "token-counts")
    earlier = lambda over: F.coalesce(F.sum("n").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = totals.groupBy("block").agg(F.sum("n").alias("n"))  # a row for each BLOCK_PARTS parts: these are summed in one task
    blocks = blocks.select("block", earlier(W.orderBy("block")).alias("before"))
    base = totals.withColumn("inside", earlier(W.partitionBy("block").orderBy("part"))).join(blocks, "block").select("part", (F.col("before") + F.col("inside")).alias("base"))
    if totals.count() <= BROADCAST_PARTS:
        base = F.broadcast(base)
    rows = segments.join(base, "part").select("first", "base", "doc_ids", "lengths", "payload")
    return rows.mapInArrow(_entries, ENTRIES)
