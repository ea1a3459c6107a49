import functools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterflow.operators import arrays, entropy
from rasterflow.plans import fused



def best_lengths_cost(freqs, limit):
    """The least sum of frequency times length of a code whose lengths are at most ``limit``, by trying all."""
    n = len(freqs)
    ordered = sorted(freqs, reverse=True)

    @functools.cache
    def least(k, depth, free):
        # codes for symbols k.. by falling frequency, lengths rising from depth, with ``free`` nodes open there
        if k == n:
            return 0
        if depth > limit or not free:
            return math.inf
        return min(sum(ordered[k : k + used]) * depth + least(k + used, depth + 1, 2 * (free - used)) for used in range(min(free, n - k) + 1))

    return least(0, 1, 2)


def frequency_table(spark, freqs, start=0):
    return spark.createDataFrame([(0, 0, start + k, f) for k, f in enumerate(freqs)], "image_id int, cls int, sym int, freq long")


@pytest.mark.parametrize("limit", [3, 4, 5, 15])
def test_code_lengths_are_the_best(spark, limit):
    rng = random.Random(limit)
    for size in (2, 5, 8):
        freqs = sorted(rng.choice((1, 2, 3, 40, 900)) * rng.randint(1, 7) for _ in range(size))
        rows = entropy.code_lengths(frequency_table(spark, freqs), limit).orderBy("rank").collect()
        lengths = [r.len for r in rows]
        assert lengths == fused.package_lengths(freqs, limit) == sorted(lengths, reverse=True)
        assert max(lengths) <= limit and sum(2.0**-n for n in lengths) <= 1
        assert sum(f * n for f, n in zip(freqs, lengths)) == best_lengths_cost(tuple(freqs), limit)


def test_too_many_symbols(spark):
    with pytest.raises(Exception, match="can't hold"):
        entropy.code_lengths(frequency_table(spark, [1] * 10), 3).collect()
    with pytest.raises(ValueError, match="can't hold"):
        fused.package_lengths([1] * 10, 3)


def codes_of(spark, freqs: dict, limit):
    table = spark.createDataFrame([(0, s, f) for s, f in freqs.items()], "image_id int, sym int, freq long")
    return entropy.canonical_codes(entropy.reserve_all_ones(entropy.code_lengths(table, limit, ("image_id",))), ("image_id",))


def test_encode_and_decode(spark):
    rng = random.Random(12)
    freqs = {s: rng.randint(1, 60) for s in rng.sample(range(256), 40)}
    sequence = [rng.choice(list(freqs)) for _ in range(300)]
    codes = codes_of(spark, freqs, 9)
    words = {r.sym: format(r.code, f"0{r.len}b") for r in codes.collect()}
    bits = "".join(words[s] for s in sequence)
    bits += "0" * (-len(bits) % 8)
    symbols = spark.createDataFrame([(0, k, s) for k, s in enumerate(sequence)], "image_id int, idx int, sym int")
    coded = entropy.huffman_encode(symbols, codes, pad_ones=False)
    assert coded.first()["bytes"] == [int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)]
    assert entropy.huffman_decode(coded.withColumn("n", F.lit(len(sequence))), codes).first()["symbols"] == sequence


def test_streams_of_bytes(spark):
    rng = random.Random(13)
    data = {"empty": b"", "null": None, "one": b"a", "same": b"z" * 1000, "all": bytes(range(256)) * 3, "text": "é日🙂 text \0".encode() * 50, "noise": rng.randbytes(5000)}
    streams = spark.createDataFrame(list(data.items()), "image_id string, data binary")
    keys = ("image_id",)
    codes = entropy.canonical_codes(entropy.reserve_all_ones(entropy.code_lengths(entropy.byte_counts(streams), keys=keys)), keys=keys)
    coded = entropy.encode_bytes(streams, codes)
    assert {r.image_id: bytes(r.data) for r in entropy.decode_bytes(coded, codes).collect()} == {k: v or b"" for k, v in data.items()}
    assert {r.image_id: (len(r.bytes), r.n) for r in coded.collect() if r.image_id in ("empty", "same")} == {"empty": (0, 0), "same": (125, 1000)}
    relational = spark.createDataFrame([("text", k, b) for k, b in enumerate(data["text"])], "image_id string, idx int, sym int")
    same = entropy.huffman_encode(relational, codes.where("image_id = 'text'")).first()["bytes"]
    assert bytes(same) == next(bytes(r.bytes) for r in coded.collect() if r.image_id == "text")
    with pytest.raises(Exception, match="no code for symbol"):
        entropy.encode_bytes(streams, codes.where("sym <> 97")).collect()


def test_missing_symbol(spark):
    codes = codes_of(spark, {1: 2, 2: 3}, 4)
    symbols = spark.createDataFrame([(0, 0, 9)], "image_id int, idx int, sym int")
    with pytest.raises(Exception, match="no code for symbol 9"):
        entropy.huffman_encode(symbols, codes).collect()


def test_single_symbol_gets_a_bit(spark):
    row = codes_of(spark, {7: 5}, 15).first()
    assert (row.sym, row.len, row.code) == (7, 1, 0)


def test_random_codes_are_prefix_free_and_leave_all_ones_out():
    rng = random.Random(3)
    for _ in range(100):
        counts = {s: rng.choice((1, 2, 5, 100, 10_000)) * rng.randint(1, 9) for s in rng.sample(range(256), rng.randint(2, 150))}
        table = fused.code_table(counts)
        words = sorted(format(c, f"0{n}b") for _, n, c in table)
        assert all(not b.startswith(a) for a, b in zip(words, words[1:]))
        assert all(set(w) != {"1"} for w in words) and max(map(len, words)) <= 16
        assert sum(2.0 ** -len(w) for w in words) < 1


def test_spark_codes_equal_plain_ones(spark):
    rng = random.Random(4)
    groups = {g: {s: rng.randint(1, 50) for s in range(rng.randint(1, 60))} for g in range(12)}
    table = spark.createDataFrame([(g, 0, s, f) for g, x in groups.items() for s, f in x.items()], "image_id int, cls int, sym int, freq long")
    got = entropy.canonical_codes(entropy.reserve_all_ones(entropy.code_lengths(table))).collect()
    for g, x in groups.items():
        assert sorted((r.sym, r.len, r.code) for r in got if r.image_id == g) == sorted(fused.code_table(x))


def plain_tokens(zz):
    """(run, size, bits) of a block, by the rules: zeros before each value, sixteens apart, an end where zeros are last."""
    out, zeros = [], 0
    for k, value in enumerate(zz):
        if k and value == 0:
            zeros += 1
            continue
        out += [(15, 0, 0)] * (zeros // 16)
        size = abs(value).bit_length()
        out.append((zeros % 16, size, value if value >= 0 else (1 << size) - 1 + value))
        zeros = 0
    return out + [(0, 0, 0)] * (zeros > 0)


def some_blocks():
    rng = random.Random(14)
    blocks = [[0] * 64, [1] * 64, [0] * 63 + [-9], [5] + [0] * 63, [0] * 17 + [3] + [0] * 46, [-32767] * 2 + [32767] * 62]
    return blocks + [[rng.choice([0] * rng.randint(1, 30) + [rng.randint(-300, 300)]) for _ in range(64)] for _ in range(60)]


def test_tokens_of_blocks(spark):
    blocks = some_blocks()
    df = spark.createDataFrame([("i", k % 3, k, "kept", zz[0], [99, *zz[1:]]) for k, zz in enumerate(blocks)], "image_id string, channel int, scan_idx bigint, more string, dc_diff int, zz array<smallint>")
    got = entropy.tokenize_blocks(df, keep=("more",)).collect()
    for k, zz in enumerate(blocks):
        mine = sorted((r for r in got if r.scan_idx == k), key=lambda r: r.tok_idx)
        assert [(r.run, r.len, r.bits) for r in mine] == plain_tokens(zz) and [r.tok_idx for r in mine] == list(range(len(mine)))
        assert all(r.more == "kept" and r.sym == r.run * 16 + r.len and r.cls == 2 * (k % 3 > 0) + (r.tok_idx > 0) for r in mine)
    assert entropy.tokenize_blocks(df.limit(0), keep=("more",)).count() == 0


def test_dc_difference(spark):
    rows = [("i", 0, k, v) for k, v in enumerate((5, 3, 3, -2))] + [("i", 1, 0, 7)]
    df = spark.createDataFrame(rows, "image_id string, channel int, scan_idx int, dc int")
    got = entropy.dc_difference(df, F.col("dc")).orderBy("channel", "scan_idx").collect()
    assert [r.dc_diff for r in got] == [5, -2, 0, -5, 7]


def pack(spark, words, pad_ones):
    rows = [(0, k, n, w) for k, (w, n) in enumerate(words)]
    df = spark.createDataFrame(rows, "image_id int, tok_idx int, nbits int, word long").withColumn("order_key", F.expr("tok_idx div 3"))
    return entropy.byte_arrays(entropy.pack_bits(entropy.bit_offsets(df), pad_ones)).first()["bytes"]


def test_pack_bits(spark):
    assert pack(spark, [(0b101, 3), (0b11111111, 8)], False) == [0b10111111, 0b11100000]
    assert pack(spark, [(0b101, 3), (0b11111111, 8)], True) == [0b10111111, 0b11111111]
    assert pack(spark, [(1, 1)] * 8, True) == [255]


def test_pack_bits_against_strings(spark):
    rng = random.Random(5)
    words = [(rng.getrandbits(n), n) for n in (rng.randint(1, 31) for _ in range(300))]
    bits = "".join(format(w, f"0{n}b") for w, n in words)
    bits += "1" * (-len(bits) % 8)
    assert pack(spark, words, True) == [int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)]


def test_histogram(spark):
    lengths = spark.createDataFrame([(0, 0, 2), (0, 0, 2), (0, 0, 4)], "image_id int, cls int, len int")
    got = {r.len: r.n for r in entropy.length_histogram(lengths).collect()}
    assert len(got) == 16 and got[2] == 2 and got[4] == 1 and got[1] == 0


def test_tree_drawing():
    drawn = entropy.code_tree([(65, 1, 0), (66, 2, 0b10)])
    assert drawn.splitlines()[0] == "*" and "└1 *" in drawn and "├0 65" in drawn and "0 66" in drawn
    assert entropy.code_tree([]) == ""


def test_timing(spark):
    row = entropy.timing_stats(spark.createDataFrame([(10,), (20,), (33,)], "micros long")).first()
    assert (row["min"], row["max"], row["average"]) == (10, 33, 21)
    assert row["deviation"] == round(((121 + 1 + 144) // 3) ** 0.5)


def test_tree_drawing_with_occurrences():
    drawn = entropy.code_tree([(65, 1, 0), (66, 2, 0b10), (67, 3, 0b110)], {65: 9, 66: 3, 67: 1}).splitlines()
    assert drawn == ["* (13)", "├0 65 (9)", "└1 * (4)", "   ├0 66 (3)", "   └1 * (1)", "      └0 67 (1)"]


def test_bit_string():
    rng = random.Random(15)
    words = [(rng.getrandbits(n) if n else 0, n) for n in (rng.randint(0, 32) for _ in range(500))]
    bits = "".join(format(w, f"0{n}b") for w, n in words if n)
    for pad in "01":
        full = bits + pad * (-len(bits) % 8)
        w, n = np.array(words, np.int64).T
        assert arrays.bit_string(w, n, pad == "1") == int(full, 2).to_bytes(len(full) // 8, "big")
    assert arrays.bit_string(np.zeros(0, np.int64), np.zeros(0, np.int64)) == b""


def test_stuffed_hex(spark, monkeypatch):
    monkeypatch.setattr(entropy, "CHUNK", 3)
    rng = random.Random(16)
    raw = bytes(rng.choice((0, 7, 255)) for _ in range(40))
    packed = spark.createDataFrame([(s, k, b) for s in (1, 2) for k, b in enumerate(raw[s:])], "image_id int, byte_idx bigint, b int")
    got = {r.image_id: r.scan for r in entropy.stuffed_hex(packed).collect()}
    assert got == {s: raw[s:].replace(b"\xff", b"\xff\x00").hex().upper() for s in (1, 2)}


def test_decode_rejects_noise():
    with pytest.raises(ValueError):
        arrays.decode_bits(b"\xff\xff\xff\xff", [(1, 1, 0), (2, 2, 2)])
    assert arrays.decode_bits(b"\x7f", [(1, 1, 0), (2, 2, 2)]).tolist() == [1]
    assert len(arrays.decode_bits(b"", [(1, 1, 0)])) == len(arrays.decode_bits(b"\0", [])) == 0
    assert arrays.decode_bits(b"\0", [(1, 1, 0)], 3).tolist() == [1, 1, 1]
