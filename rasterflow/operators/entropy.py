"""Entropy coding: differences, run lengths, length-limited Huffman codes and bit packing.

Tables are keyed by image_id; a code table by image_id and cls: 0 luma DC, 1 luma AC, 2 chroma
DC, 3 chroma AC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterflow.operators import arrays

LIMIT = 15
KEYS = ("image_id", "cls")
MADE = ("tok_idx", "run", "len", "bits", "sym", "cls")
#: Bytes of a stream that are joined at once.
CHUNK = 4096


def dc_difference(blocks: DataFrame, dc: Column, keys=("image_id", "channel"), order="scan_idx") -> DataFrame:
    """Adds dc_diff: each block's DC value less that of the block before, the first one's less 0."""
    before = F.lag(dc, 1, 0).over(W.partitionBy(*keys).orderBy(order))
    return blocks.withColumn("dc_diff", (dc.cast("int") - before.cast("int")))


def tokenize_blocks(blocks: DataFrame, column: str = "zz", keep=()) -> DataFrame:
    """A row for each token of blocks with dc_diff and zig-zag values: tok_idx 0 is the DC difference's.

    One narrow pass of Arrow batches, whole blocks at a time.
    """
    names = ["image_id", "channel", "scan_idx", *keep]

    def tokens(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            zz = batch.column(len(names) + 1).flatten().to_numpy().astype(np.int64).reshape(n, 64)
            zz[:, 0] = batch.column(len(names)).to_numpy()
            block, tok_idx, run, size, bits = arrays.block_tokens(zz)
            cls = np.where(batch.column(1).to_numpy()[block] > 0, 2, 0) + (tok_idx > 0)
            made = [pa.array(x, pa.int32()) for x in (tok_idx, run, size, bits, run << 4 | size, cls)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(block)) for k in range(len(names))), *made], [*names, *MADE])

    rows = blocks.select(*names, F.col("dc_diff").cast("int"), F.col(column).cast("array<int>"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*names).schema)
    return rows.mapInArrow(tokens, f"{kept}, " + ", ".join(f"{c} int" for c in MADE))


def symbol_counts(tokens: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, sym, freq); both chroma planes share their tables."""
    return tokens.groupBy(*keys, "sym").agg(F.count(F.lit(1)).alias("freq"))


def _node(freq: Column, kind: Column) -> Column:
    return F.struct(freq.alias("f"), kind.alias("k"))


def _next_packages(level: Column, leaves: Column) -> Column:
    """Pairs of a level merged, sorted in among the leaves; leaves come first among equals."""
    pairs = F.transform(
        F.filter(F.sequence(F.lit(0), F.greatest(F.size(level) - 1, F.lit(0))), lambda i: (i % 2 == 0) & (i + 1 < F.size(level))),
        lambda i: _node(F.get(level, i)["f"] + F.get(level, i + 1)["f"], F.lit(1)),
    )
    return F.array_sort(F.concat(leaves, pairs))


def code_lengths(freqs: DataFrame, limit: int = LIMIT, keys=KEYS) -> DataFrame:
    """(keys, sym, freq, rank, len): optimal code lengths up to ``limit``, by package-merge.

    rank orders by frequency, then symbol. A code of one symbol has length 0 here. More
    symbols than a code of that length can have are an error. A group has at most 256
    symbols, so the arrays are small.
    """
    groups = freqs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("freq", "sym"))).alias("s"))
    fits = F.size("s") <= F.lit(2**limit)
    groups = groups.withColumn("s", F.when(fits, F.col("s")).otherwise(F.raise_error(F.concat(F.lit(f"a code of depth {limit} can't hold "), F.size("s").cast("string"), F.lit(" symbols")))))
    groups = groups.withColumn("leaves", F.transform("s", lambda x: _node(x["freq"].cast("bigint"), F.lit(0))))
    levels = F.aggregate(F.sequence(F.lit(1), F.lit(limit - 1)), F.array("leaves"), lambda acc, _: F.concat(acc, F.array(_next_packages(F.element_at(acc, -1), F.col("leaves"))))) if limit > 1 else F.array("leaves")
    groups = groups.withColumn("levels", F.reverse(levels))

    def take(acc: Column, level: Column) -> Column:
        taken = F.slice(level, 1, acc["n"] * 2)
        leaves = F.size(F.filter(taken, lambda x: x["k"] == 0))
        return F.struct((F.size(taken) - leaves).alias("n"), F.concat(acc["leaves"], F.array(leaves)).alias("leaves"))

    start = F.struct((F.size("s") - 1).alias("n"), F.array().cast("array<int>").alias("leaves"))
    groups = groups.withColumn("taken", F.aggregate("levels", start, take)["leaves"])
    each = F.transform("s", lambda x, i: F.struct(x["sym"].alias("sym"), x["freq"].alias("freq"), i.alias("rank"), F.size(F.filter("taken", lambda n: n > i)).alias("len")))
    return groups.select(*keys, F.inline(each))


def reserve_all_ones(lengths: DataFrame) -> DataFrame:
    """The least frequent symbol's code one bit longer, so that no code is all ones."""
    return lengths.withColumn("len", F.when(F.col("rank") == 0, F.col("len") + 1).otherwise(F.col("len")))


def canonical_codes(lengths: DataFrame, keys=KEYS) -> DataFrame:
    """Adds code: the codes in order, from the most frequent symbol's shortest one."""
    before = W.partitionBy(*keys).orderBy(F.desc("rank")).rowsBetween(W.unboundedPreceding, -1)
    step = F.expr("cast(shiftleft(1, 16 - len) as int)")
    start = F.coalesce(F.sum(step).over(before), F.lit(0)).cast("int")
    return lengths.withColumn("_start", start).withColumn("code", F.expr("shiftright(_start, 16 - len)")).drop("_start")


def length_histogram(lengths: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, len, n) for all lengths from 1 to 16."""
    every = lengths.select(*keys).distinct().withColumn("len", F.explode(F.sequence(F.lit(1), F.lit(16))))
    counts = lengths.groupBy(*keys, "len").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, [*keys, "len"], "left").select(*keys, "len", F.coalesce("n", F.lit(0)).alias("n"))


def attach_codes(tokens: DataFrame, codes: DataFrame, keys=KEYS) -> DataFrame:
    """Tokens with nbits and word: the symbol's code, then the category bits. A symbol without a code is an error."""
    found = tokens.join(codes.select(*keys, "sym", F.col("len").alias("code_len"), "code"), [*keys, "sym"], "left")
    code = F.when(F.col("code").isNotNull(), F.col("code")).otherwise(F.raise_error(F.concat(F.lit("no code for symbol "), F.col("sym").cast("string"))))
    extra = F.col("len") if "len" in tokens.columns else F.lit(0)
    bits = F.col("bits") if "bits" in tokens.columns else F.lit(0)
    word = (code.cast("bigint") * F.expr("shiftleft(cast(1 as bigint), len)") if "len" in tokens.columns else code.cast("bigint")) + bits
    return found.withColumn("nbits", F.col("code_len") + extra).withColumn("word", word)


def bit_offsets(tokens: DataFrame, stream=("image_id",), block=("order_key",), token="tok_idx") -> DataFrame:
    """Adds offset, the bits before each token in its stream, and stream_bits, the bits of its stream.

    In two steps: blocks of a stream are summed first, so no window has a stream's tokens.
    """
    sums = tokens.groupBy(*stream, *block).agg(F.sum("nbits").alias("_n"))
    all_blocks = W.partitionBy(*stream)
    earlier = all_blocks.orderBy(*block).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*stream, *block, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_block"), F.sum("_n").over(all_blocks).alias("stream_bits"))
    inside = W.partitionBy(*stream, *block).orderBy(token).rowsBetween(W.unboundedPreceding, -1)
    return tokens.join(sums, [*stream, *block]).withColumn("offset", F.col("_block") + F.coalesce(F.sum("nbits").over(inside), F.lit(0))).drop("_block")


def pack_bits(tokens: DataFrame, pad_ones: bool = True, stream=("image_id",)) -> DataFrame:
    """(stream, byte_idx, b): words of up to 31 bits at their offsets, first bit highest.

    The last word of a stream takes the padding to a whole byte with it, so tokens are read once.
    """
    pad = F.when(F.col("offset") + F.col("nbits") == F.col("stream_bits"), (8 - F.col("stream_bits") % 8) % 8).otherwise(0).cast("int")
    words = tokens.where("nbits > 0").select(*stream, "offset", "nbits", "word", pad.alias("_pad"))
    ones = "shiftleft(cast(1 as bigint), _pad) - 1" if pad_ones else "0"
    padded = words.select(*stream, "offset", F.expr("nbits + _pad").alias("_n"), F.expr(f"shiftleft(word, _pad) + {ones}").alias("_word"))
    last = F.expr("(offset % 8 + _n - 1) div 8").cast("int")
    parts = padded.select(*stream, F.expr("offset div 8").alias("_first"), F.expr("shiftleft(_word, cast(40 - offset % 8 - _n as int))").alias("_w"), F.explode(F.sequence(F.lit(0), last)).alias("_k"))
    bytes_ = parts.select(*stream, (F.col("_first") + F.col("_k")).alias("byte_idx"), F.expr("cast(shiftright(_w, 32 - 8 * _k) & 255 as int)").alias("b"))
    return bytes_.groupBy(*stream, "byte_idx").agg(F.bit_or("b").alias("b"))


def byte_arrays(packed: DataFrame, stream=("image_id",)) -> DataFrame:
    """(stream, bytes): the byte values of each stream, in order."""
    return packed.groupBy(*stream).agg(F.array_sort(F.collect_list(F.struct("byte_idx", "b"))).alias("_s")).select(*stream, F.col("_s.b").alias("bytes"))


def stuffed_hex(packed: DataFrame, stream=("image_id",)) -> DataFrame:
    """(stream, scan): the bytes of each stream in hex, with a 0 after each 255; joined CHUNK bytes at a time, then by chunk."""
    one = F.when(F.col("b") == 255, "FF00").otherwise(F.lpad(F.hex(F.col("b").cast("bigint")), 2, "0"))
    joined = lambda at, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("k"), text.alias("t")))), lambda x: x["t"]), "")
    chunks = packed.withColumn("_chunk", F.expr(f"byte_idx div {CHUNK}")).groupBy(*stream, "_chunk").agg(joined("byte_idx", one).alias("_text"))
    return chunks.groupBy(*stream).agg(joined("_chunk", F.col("_text")).alias("scan"))


def huffman_encode(symbols: DataFrame, codes: DataFrame, pad_ones: bool = True, stream=("image_id",), keys=("image_id",), order="idx") -> DataFrame:
    """(stream, bytes) of symbols (stream, idx, sym)."""
    coded = attach_codes(symbols, codes, keys).withColumn("order_key", F.expr(f"{order} div 4096"))
    return byte_arrays(pack_bits(bit_offsets(coded, stream, ("order_key",), order), pad_ones, stream), stream)


def _tables(codes: DataFrame, keys) -> DataFrame:
    """(keys, _codes): each group's code as an array of (sym, len, code)."""
    return codes.groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("sym", "len", "code")])).alias("_codes"))


def _with_tables(streams: DataFrame, codes: DataFrame, keys, columns, function, schema: str) -> DataFrame:
    """``function`` of each row's columns and code, in Arrow batches; a group without a code has an empty one."""
    rows = streams.join(_tables(codes, keys), list(keys), "left").select(*keys, *columns, "_codes")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in streams.select(*keys).schema)
    width = len(keys)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):  # a stream at a time
                code = [(c["sym"], c["len"], c["code"]) for c in batch.column(batch.num_columns - 1)[k].as_py() or []]
                found = function(code, *(batch.column(j)[k].as_py() for j in range(width, batch.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(k, 1) for j in range(width)), *found], names)

    full = f"{kept}, {schema}"
    names = [*keys, *(part.split()[0] for part in schema.split(", "))]
    return rows.mapInArrow(run, full)


def byte_counts(streams: DataFrame, column: str = "data", keys=("image_id",)) -> DataFrame:
    """(keys, sym, freq): how often each byte stands in each stream."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in streams.select(*keys).schema)

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                freq = np.bincount(np.frombuffer(batch.column(len(keys))[k].as_py() or b"", np.uint8), minlength=256)
                sym = np.flatnonzero(freq)
                yield pa.RecordBatch.from_arrays([*(batch.column(j).take(pa.array(np.full(len(sym), k))) for j in range(len(keys))), pa.array(sym, pa.int32()), pa.array(freq[sym], pa.int64())], [*keys, "sym", "freq"])

    found = streams.select(*keys, column).mapInArrow(count, f"{kept}, sym int, freq bigint")
    return found.groupBy(*keys, "sym").agg(F.sum("freq").alias("freq"))


def encode_bytes(streams: DataFrame, codes: DataFrame, column: str = "data", keys=("image_id",), pad_ones: bool = True) -> DataFrame:
    """(keys, bytes, n): streams of bytes coded by their code tables, a whole stream at a time; n symbols."""

    def encode(code, data):
        import numpy as np
        import pyarrow as pa

        symbols, words, sizes = np.frombuffer(data or b"", np.uint8), np.zeros(256, np.int64), np.zeros(256, np.int64)
        for sym, length, word in code:
            words[sym], sizes[sym] = word, length
        missing = symbols[sizes[symbols] == 0]
        if len(missing):
            raise ValueError(f"no code for symbol {missing[0]}")
        return pa.array([arrays.bit_string(words[symbols], sizes[symbols], pad_ones)], pa.binary()), pa.array([len(symbols)], pa.int64())

    return _with_tables(streams, codes, keys, [column], encode, "bytes binary, n bigint")


def decode_bytes(streams: DataFrame, codes: DataFrame, keys=("image_id",)) -> DataFrame:
    """(keys, data, n_coded): the inverse of ``encode_bytes``, and the number of coded bytes."""

    def decode(code, raw, n):
        import numpy as np
        import pyarrow as pa

        return pa.array([arrays.decode_bits(raw, code, n).astype(np.uint8).tobytes()], pa.binary()), pa.array([len(raw)], pa.int64())

    return _with_tables(streams, codes, keys, ["bytes", "n"], decode, "data binary, n_coded bigint")


def huffman_decode(streams: DataFrame, codes: DataFrame, keys=("image_id",)) -> DataFrame:
    """(keys, symbols): streams (keys, bytes as an array, n) decoded by their code tables; n symbols, or all if n is null."""

    def decode(code, raw, n):
        import pyarrow as pa

        return (pa.array([arrays.decode_bits(bytes(raw or []), code, n)], pa.list_(pa.int32())),)

    n = (F.col("n") if "n" in streams.columns else F.lit(None)).cast("bigint")
    return _with_tables(streams.withColumn("n", n), codes, keys, ["bytes", "n"], decode, "symbols array<int>")


def code_tree(codes: list[tuple[int, int, int]], freqs: dict[int, int] | None = None) -> str:
    """A prefix code (symbol, length, code) drawn as a tree, one line for each node: symbols, and with ``freqs`` the occurrences below."""
    table = {format(code, f"0{length}b") if length else "": symbol for symbol, length, code in codes}

    def label(prefix: str) -> str:
        name = str(table.get(prefix, "*"))
        return name if freqs is None else f"{name} ({sum(freqs.get(s, 0) for p, s in table.items() if p.startswith(prefix))})"

    def draw(prefix: str) -> list[str]:
        if prefix in table:
            return [label(prefix)]
        lines = [label(prefix)]
        ends = [p for p in ("0", "1") if any(k.startswith(prefix + p) for k in table)]
        for p in ends:
            child, final = draw(prefix + p), p == ends[-1]
            lines.append(f"{'└' if final else '├'}{p} {child[0]}")
            lines += [f"{' ' if final else '│'}  {x}" for x in child[1:]]
        return lines

    return "\n".join(draw("")) if table else ""


def timing_stats(times: DataFrame, column: str = "micros") -> DataFrame:
    """min, max, average and deviation of whole microseconds, the latter two rounded down and to the nearest."""
    mean = F.expr(f"sum({column}) div count({column})")
    squares = F.sum(F.col(column).cast("bigint") * F.col(column))
    stats = times.agg(F.min(column).alias("min"), F.max(column).alias("max"), mean.alias("average"), F.count(column).alias("_n"), F.sum(column).alias("_sum"), squares.alias("_squares"))
    around = F.expr("_squares - 2 * average * _sum + _n * average * average")  # sum of squares around the average
    return stats.withColumn("_s", around).select("min", "max", "average", F.round(F.sqrt(F.expr("_s div _n"))).cast("bigint").alias("deviation"))
