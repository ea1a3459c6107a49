"""Media columns: chroma fingerprints of audio, and recordings that align.

A media column holds 16-bit mono PCM. Its fingerprint: overlapping windowed spectra, summed by
pitch class; each frame scaled to length one; on the image of frames by
pitch class, FILTERS compare two areas by the logarithm of their sums, read from an integral image;
each filter's value is quantized to two Gray-coded bits, and all bits of a
place make one 32-bit integer.

Recordings align where their integers agree: equal integers of a query and another recording vote
for an offset; each offset with enough votes is checked by the share of unequal bits over the whole
overlap, and of those that pass the one with the most votes is kept, of equal ones that nearest to 0, then the larger. ``align`` takes
a stated set of queries against all recordings, in blocks: queries go to all tasks in chunks of at most QUERY_CODES integers, sorted, and each
task finds those of its recordings there. Votes are summed where they arise, for whole recordings, and only alignments leave
a task, so an integer that very many recordings share costs time where it stands and is never a join's hot key. Equal fingerprints are
one class, represented by its smallest id with the number of its rows, so
copies aren't expanded; a class aligns with itself at offset 0, without voting.

Defined cases: null audio, or too short for one integer, has an empty fingerprint and aligns with
nothing, as does one with a null id; equal fingerprints of repeated rows are one class, and rows of one id with other
fingerprints are recordings of their own; ties are settled as said above; other columns are ignored, whatever their names; an
empty table gives an empty result. Odd trailing bytes are dropped; audio is never cut otherwise.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterflow.llm.common import materialize

RATE = 4000
FRAME, HOP = 1024, 256
LOW_HZ, HIGH_HZ = 100.0, 1800.0
CLASSES = 12
#: Frames that a filter spans at most.
SPAN = 16
#: Log ratios between the four levels of a filter's value.
LEVELS = (-0.25, 0.0, 0.25)
#: Equal integers that an offset needs, and the share of unequal bits that it may have.
MIN_VOTES = 4
MAX_ERROR = 0.3
#: Integers, and rows, of the queries that are broadcast at once.
QUERY_CODES, QUERY_ROWS = 1 << 20, 1 << 14
#: Pairs of equal integers, or places compared, that a task holds at once.
MATCHES = 1 << 20


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, height, width) of 16 filters, by rule."""
    found = []
    for n in range(16):
        height = 2 + 2 * (n // 4)
        found.append((n % 4, (5 * n) % (CLASSES - height + 1), height, SPAN >> (n // 4 % 3)))
    return found


@functools.lru_cache(maxsize=1)
def _bins():
    """For each spectrum bin its pitch class, or -1 outside the range."""
    import numpy as np

    hz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    inside = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    pitch = np.full(len(hz), -1)
    pitch[inside] = np.round(CLASSES * np.log2(hz[inside] / 440.0)).astype(int) % CLASSES
    matrix = np.zeros((len(hz), CLASSES))
    matrix[np.flatnonzero(inside), pitch[inside]] = 1
    return np.hanning(FRAME), matrix


def chroma(samples):
    """Frames by pitch class, each frame of length one (or zero where silent)."""
    import numpy as np

    window, matrix = _bins()
    if len(samples) < FRAME:
        return np.zeros((0, CLASSES))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.concatenate([(np.abs(np.fft.rfft(frames[at : at + 512] * window)) ** 2) @ matrix for at in range(0, len(frames), 512)])
    size = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=size > 1e-9)


def fingerprint(pcm: bytes | None):
    """The packed 32-bit integers of a recording."""
    import numpy as np

    samples = np.frombuffer(pcm[: len(pcm) // 2 * 2], "<i2") / 32768.0 if pcm else np.zeros(0)
    image = chroma(samples)
    n = len(image) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, CLASSES + 1))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at, out = np.arange(n), np.zeros(n, np.uint32)

    def area(x0, y0, x1, y1):
        return total[at + x1, y1] - total[at + x0, y1] - total[at + x1, y0] + total[at + x0, y0]

    for kind, y, height, width in filters():
        whole, w, h = area(0, y, width, y + height), width // 2, height // 2
        if kind == 0:  # earlier against later
            a = area(0, y, w, y + height)
        elif kind == 1:  # lower against higher classes
            a = area(0, y, width, y + h)
        elif kind == 2:  # crosswise quarters
            a = area(0, y, w, y + h) + area(w, y + h, width, y + height)
        else:  # the middle against what is around
            a = area(width // 4, y, width - width // 4, y + height)
        value = np.log((1 + a) / (1 + whole - a))
        level = np.searchsorted(LEVELS, value).astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def fingerprints(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, codes): the packed integers of each recording."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            codes = [fingerprint(x.as_py()) for x in batch.column(1)]
            flat = np.concatenate([*codes, np.zeros(0, np.uint32)]).astype(np.int64)
            ends = np.cumsum([0, *map(len, codes)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["id", "codes"])

    return media.select(F.col(id_col).cast("bigint").alias("id"), media_col).mapInArrow(run, "id bigint, codes array<bigint>")


class _Asked:
    """A chunk of queries: keys, all their codes in order, and the places of the codes by code."""

    def __init__(self, keys: list[str], codes):
        import numpy as np

        self.keys, self.sizes = keys, np.array([len(c) for c in codes])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.codes = np.concatenate(codes).astype(np.uint32)
        self.order = np.argsort(self.codes, kind="stable")
        self.sorted = self.codes[self.order]
        self.owner = np.repeat(np.arange(len(keys)), self.sizes)
        self.number = {k: n for n, k in enumerate(keys)}

    def votes(self, codes, min_votes: int):
        """(query, offset, votes) of a recording's codes."""
        import numpy as np

        low, high = np.searchsorted(self.sorted, codes, "left"), np.searchsorted(self.sorted, codes, "right")
        n, held = high - low, [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        ends, at, span = np.cumsum(n), 0, len(codes) + int(self.sizes.max())
        while at < len(codes):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + MATCHES, "right")))
            some = n[at:stop]
            here = np.repeat(np.arange(at, stop), some)
            there = self.order[np.repeat(low[at:stop] - (np.cumsum(some) - some), some) + np.arange(some.sum())]
            query = self.owner[there]
            offset = here - (there - self.first[query])
            held.append(np.unique(query * (2 * span) + offset + span, return_counts=True))
            at = stop
        pair, votes = (np.concatenate(x) for x in zip(*held))
        if len(held) > 2:
            pair, number = np.unique(pair, return_inverse=True)
            votes = np.bincount(number, votes).astype(np.int64)
        enough = votes >= min_votes
        return pair[enough] // (2 * span), pair[enough] % (2 * span) - span, votes[enough]

    def errors(self, codes, query, offset):
        """The share of unequal bits of each query where its place p meets p + offset of ``codes``."""
        import numpy as np

        out = np.ones(len(query))
        start = np.maximum(0, -offset)
        n = np.minimum(self.sizes[query] - start, len(codes) - start - offset)
        ends, at = np.cumsum(n), 0
        while at < len(query):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + MATCHES, "right")))
            some = n[at:stop]
            nth = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
            mine = self.codes[np.repeat((self.first[query] + start)[at:stop], some) + nth]
            other = codes[np.repeat((start + offset)[at:stop], some) + nth]
            out[at:stop] = np.add.reduceat(np.bitwise_count(mine ^ other), np.cumsum(some) - some, dtype=np.int64) / (32 * some)
            at = stop
        return out


def _aligner(shared, min_votes: int, max_error: float):
    """The best alignment of each query of a chunk with each class (key, codes) of a batch."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        asked = shared.value
        for batch in batches:
            out = [[], [], [], [], []]
            for k in range(batch.num_rows):
                key, codes = batch.column(0)[k].as_py(), batch.column(1)[k].values.to_numpy().astype(np.uint32)
                query, offset, votes = asked.votes(codes, min_votes)
                other = query != asked.number.get(key, -1)
                query, offset, votes = query[other], offset[other], votes[other]
                if not len(query):
                    continue
                error = asked.errors(codes, query, offset)
                fine = np.flatnonzero(error <= max_error)
                fine = fine[np.lexsort((-offset[fine], np.abs(offset[fine]), -votes[fine], query[fine]))]
                fine = fine[np.concatenate([np.ones(min(1, len(fine)), bool), query[fine][1:] != query[fine][:-1]])]
                for column, values in zip(out, ([asked.keys[q] for q in query[fine].tolist()], [key] * len(fine), offset[fine].tolist(), votes[fine].tolist(), error[fine].tolist())):
                    column += values
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.float64()))], ["q", "r", "offset", "votes", "bit_error"])

    return run


def _chunks(asked: DataFrame):
    """The queries (key, codes) in chunks, in order of their keys; one with more than QUERY_CODES integers is alone."""
    import numpy as np

    low = None
    while True:
        left = asked if low is None else asked.where(F.col("key") > low)
        # no fingerprint is empty, so a chunk has at most QUERY_CODES rows; the running sum is over these alone
        before = F.sum(F.size("codes")).over(W.orderBy("key").rowsBetween(W.unboundedPreceding, -1))
        some = left.orderBy("key").limit(QUERY_ROWS).withColumn("before", F.coalesce(before, F.lit(0))).where((F.col("before") < QUERY_CODES)).select("key", "codes").toArrow()
        if not some.num_rows:
            return
        keys = some["key"].to_pylist()
        yield _Asked(keys, [c.values.to_numpy() for c in some["codes"]])
        low = max(keys)


def align(prints: DataFrame, is_query: Column, min_votes: int = MIN_VOTES, max_error: float = MAX_ERROR) -> DataFrame:
    """Alignments of the queries (a Column over ``id``) with all recordings.

    A row for each query and class of equal fingerprints: query_id, match_id (the class's
    smallest id but the query's own), n_rows (of the class, without the query's own), offset, votes, bit_error.
    """
    spark = prints.sparkSession
    rows = prints.select("id", "codes", is_query.alias("asks")).where(F.col("id").isNotNull() & (F.size("codes") > 0))
    rows = materialize(rows.withColumn("key", F.md5(F.array_join("codes", ","))), "prints")
    # the two smallest ids stand for a class: a query isn't its own match
    second = rows.select("key", "id").withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("id"))).where(F.col("n") <= 2).groupBy("key").agg(F.max("id").alias("next"))
    classes = rows.groupBy("key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n_rows"), F.first("codes").alias("codes"), F.max("asks").alias("asks"))
    classes = materialize(classes.join(second, "key"), "classes")
    found = spark.createDataFrame([], "q string, r string, offset int, votes bigint, bit_error double")
    for chunk in _chunks(classes.where("asks").select("key", "codes")):
        some = classes.select("key", "codes").mapInArrow(_aligner(spark.sparkContext.broadcast(chunk), min_votes, max_error), found.schema)
        found = found.unionAll(materialize(some, "alignments"))
    same = classes.where(F.col("asks") & (F.col("n_rows") > 1)).select(F.col("key").alias("q"), F.col("key").alias("r"), F.lit(0).alias("offset"), F.size("codes").cast("long").alias("votes"), F.lit(0.0).alias("bit_error"))
    asked = rows.where("asks").select(F.col("key").alias("q"), F.col("id").alias("query_id"))
    matched = found.unionAll(same).join(asked, "q").join(classes.select(F.col("key").alias("r"), "low", "next", "n_rows"), "r")
    own = F.col("q") == F.col("r")
    return matched.select(
        "query_id",
        F.when(F.col("low") == F.col("query_id"), F.col("next")).otherwise(F.col("low")).alias("match_id"),
        (F.col("n_rows") - own.cast("long")).alias("n_rows"),
        "offset",
        "votes",
        "bit_error",
    )


#: How a vector becomes a recording: note length in samples, and semitones above 110 Hz.
NOTE, LOWEST, SEMITONES = 512, 110.0, 36


def play(components) -> bytes:
    """A recording of a vector: one note for each component, its pitch by the component's size."""
    import numpy as np

    x = np.nan_to_num(np.asarray(components, np.float64), posinf=0, neginf=0)
    pitch = np.floor(np.abs(x) * 64).clip(0, 1e6).astype(np.int64) * 7 % SEMITONES
    hz = LOWEST * 2.0 ** (pitch / 12)
    time = np.arange(NOTE) / RATE
    tone = np.sin(2 * np.pi * hz[:, None] * time[None])
    return (12000 * tone).astype("<i2").tobytes()


def recordings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, audio): a media column made from vectors, as the test tables have none; null vectors stay null."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                audio = [None if v.as_py() is None else play([0.0 if x is None else x for x in v.as_py()]) for v in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(audio, pa.binary())], ["id", "audio"])

    return vectors.select(F.col(id_col).cast("bigint").alias("id"), vector_col).mapInArrow(run, "id bigint, audio binary")
