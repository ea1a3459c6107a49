import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterflow.llm import media as M
from rasterflow.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>, score long, rank int, key long, asks boolean"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 1, 1, True) for i, v in rows], SCHEMA)


def corpus(n=260, width=8):
    rng = random.Random(3)
    rows = [(k, [rng.choice((-1.5, -0.25, 0.0, 0.5, 1.0)) for _ in range(width)]) for k in range(n)]
    rows += [(1000 + k, [0.25] * width) for k in range(20)]  # ties
    return rows + [(2000, None), (2001, [None] + [1.0] * (width - 1)), (2050, [float("nan")] * width), (2100, [float("inf")] * width), (2002, [2.0] * (width - 3)), (2150, [0.0] * width), (5, rows[5][1]), (1, [-3.0] * width), (50, rows[50][1]), (50, [1.5] * width), (None, [1.0] * width)]


def brute(rows, k=K.K):
    """By rows: repeated ones are candidates and queries each."""
    clean = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in clean:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in clean if j != i)
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("of_chunk", "cells"), [(K.QUERY_BYTES, K.SLICE), (64 * 3, 40)])
def test_top_k(spark, monkeypatch, of_chunk, cells):
    rows = corpus(width=8 if cells > 40 else 5)
    monkeypatch.setattr(K, "QUERY_BYTES", of_chunk)
    monkeypatch.setattr(K, "SLICE", cells)
    got = K.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_top_k_narrow_vectors(spark):
    rng = random.Random(8)
    rows = [(k, [rng.uniform(-2, 2) for _ in range(rng.randint(0, 3))]) for k in range(120)]
    assert sorted(map(tuple, K.top_k(vectors(spark, rows), F.col("vec_id") % 50 == 0).collect())) == brute([(i, np.array(v, np.float32).tolist()) for i, v in rows])


def test_top_k_small_tables(spark):
    few = [(50, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [-1.0, -1.0])]
    assert sorted(map(tuple, K.top_k(vectors(spark, few), F.col("vec_id") % 50 == 0).collect())) == brute(few)
    assert K.top_k(vectors(spark, few[:1]), F.col("vec_id") % 50 == 0).count() == 0
    assert K.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_large_components(spark):
    big = [(50, [1e6, -1e6, 3.0]), (1, [1e6, 1e6, 1.0]), (2, [1e6 + 1, 1e6, 2.0])]
    df = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in K.top_k(df, F.col("vec_id") == 50).collect()]
    assert sorted(got) == brute(big)


def test_top_k_beyond_64_bits(spark):
    for rows in ([(50, [1e9]), (1, [1e9])], [(50, [1e18]), (1, [1.0])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="beyond 64 bits"):
            K.top_k(df, F.col("vec_id") == 50).collect()
    df = spark.createDataFrame([(50, [1e4]), (1, [1e10 + 2]), (2, [1e10 + 1]), (3, [1e10])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in K.top_k(df, F.col("vec_id") == 50).orderBy("rank").collect()] == [1, 2, 3]


def test_top_k_sql():
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    rows = corpus()
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [list(r) for r in rows])
    assert sorted(con.execute(K.ORACLE_SQL).fetchall()) == brute(rows)


TUNES = np.random.default_rng(5).normal(0, 0.2, (12, 64))


def test_fingerprint_survives_noise_and_loudness():
    pcm = M.play(TUNES[0])
    noisy = (np.frombuffer(pcm, "<i2") * 0.5 + np.random.default_rng(1).normal(0, 200, len(pcm) // 2)).astype("<i2").tobytes()
    a, b, c = M.fingerprint(pcm), M.fingerprint(noisy), M.fingerprint(M.play(TUNES[1]))
    error = lambda x, y: np.bitwise_count(x ^ y).sum() / (32 * len(x))
    assert error(a, b) < 0.1 < 0.25 < error(a, c)


def test_fingerprint_edges():
    assert len(M.fingerprint(None)) == len(M.fingerprint(b"")) == len(M.fingerprint(b"\0" * 3001)) == 0
    assert len(M.fingerprint(bytes(2 * (M.FRAME + (M.SPAN - 1) * M.HOP)))) == 1
    assert len(M.filters()) == 16 and all(y + h <= M.CLASSES and w <= M.SPAN for _, y, h, w in M.filters())


def test_align(spark):
    late = b"\0" * (2 * M.HOP * 10) + M.play(TUNES[2])
    rows = [(k, M.play(t)) for k, t in enumerate(TUNES)] + [(100, late), (101, M.play(TUNES[0])), (102, M.play(TUNES[0])), (103, None), (104, b"\1"), (None, M.play(TUNES[3]))]
    df = spark.createDataFrame(rows, "k long, audio binary")
    prints = M.fingerprints(df, "k", "audio")
    got = {(r.query_id, r.match_id): r for r in M.align(prints, F.col("id").isin(0, 2, 5, 101, 103)).collect()}
    assert set(got) == {(0, 101), (2, 100), (101, 0)}
    assert got[0, 101].n_rows == 2 and got[0, 101].offset == 0 and got[0, 101].bit_error == 0
    assert got[2, 100].offset == 10 and got[2, 100].n_rows == 1 and got[2, 100].bit_error < 0.2


def test_align_checks_every_offset_with_votes(spark):
    rng = np.random.default_rng(8)
    body, own, other = (rng.integers(0, 2**32, n).tolist() for n in (60, 40, 40))
    noisy, held = [x if k % 6 == 0 else x ^ 0b111 for k, x in enumerate(body)], rng.integers(0, 2**32, 20).tolist()
    # the held integers vote most for an offset where little else agrees; the bodies agree at another
    prints = spark.createDataFrame([(0, own + held + body), (1, noisy + held + other)], "id long, codes array<long>")
    got = {(r.query_id, r.match_id): r for r in M.align(prints, F.col("id") == 0).collect()}
    assert set(got) == {(0, 1)} and (got[0, 1].offset, got[0, 1].votes) == (-60, 10) and got[0, 1].bit_error < 0.1


def test_align_short_copies_without_votes(spark):
    prints = spark.createDataFrame([(2, [1, 2]), (3, [1, 2]), (4, [5]), (5, [6])], "id long, codes array<long>")
    got = sorted(map(tuple, M.align(prints, F.lit(True)).collect()))
    assert got == [(2, 3, 1, 0, 2, 0.0), (3, 2, 1, 0, 2, 0.0)]


def plain_alignments(prints, queries):
    """All offsets of all pairs, place by place."""
    classes = {}
    for i, codes in prints:
        if i is not None and codes:
            classes.setdefault(tuple(codes), []).append(i)
    out = []
    for q, ids in classes.items():
        for i in ids:
            if i not in queries:
                continue
            for r, others in classes.items():
                name = sorted(others)[0] if sorted(others)[0] != i else sorted(others)[1] if len(others) > 1 else None
                if q == r:
                    if len(others) > 1:
                        out.append((i, name, len(others) - 1, 0, len(q), 0.0))
                    continue
                tried = []
                for offset in range(1 - len(q), len(r)):
                    met = [(q[p], r[p + offset]) for p in range(len(q)) if 0 <= p + offset < len(r)]
                    votes, error = sum(a == b for a, b in met), sum((a ^ b).bit_count() for a, b in met) / (32 * len(met))
                    if votes >= M.MIN_VOTES and error <= M.MAX_ERROR:
                        tried.append((votes, -abs(offset), offset, error))
                if tried:
                    votes, _, offset, error = max(tried)
                    out.append((i, name, len(others), offset, votes, error))
    return sorted(out)


@pytest.mark.parametrize(("codes", "rows", "matches"), [(M.QUERY_CODES, M.QUERY_ROWS, M.MATCHES), (60, 3, 7), (1, 1, 1)])
def test_align_against_all_offsets(spark, monkeypatch, codes, rows, matches):
    for name, value in (("QUERY_CODES", codes), ("QUERY_ROWS", rows), ("MATCHES", matches)):
        monkeypatch.setattr(M, name, value)
    rng = random.Random(17)
    silence, base = 0xFFFFFFFF, [rng.getrandbits(32) for _ in range(30)]
    prints = [(k, [silence] * rng.randint(1, 12)) for k in range(8)]  # one common integer in all
    for k in range(10, 30):
        cut = base[rng.randint(0, 12) : rng.randint(14, 30)]
        noisy = [c if rng.random() < 0.6 else c ^ (1 << rng.randrange(32)) for c in cut]
        prints.append((k, [silence] * rng.randint(0, 6) + noisy + [rng.getrandbits(32) for _ in range(rng.randint(0, 5))]))
    prints += [(40, base), (41, base), (42, base), (10, base[:9]), (43, []), (44, None), (None, base), (45, base * 2)]
    queries = {0, 3, 10, 11, 12, 20, 40, 41, 43, 45}
    df = spark.createDataFrame(prints, "id long, codes array<long>").withColumn("key", F.lit(1)).withColumn("q", F.lit(2)).withColumn("low", F.lit(3))
    got = sorted(map(tuple, M.align(df, F.col("id").isin(*queries)).collect()))
    expected = plain_alignments(prints, queries)
    assert len(expected) > 30 and [g[:5] for g in got] == [e[:5] for e in expected] and np.allclose([g[5] for g in got], [e[5] for e in expected])


def test_fingerprint_equals_plain_sums():
    rng = np.random.default_rng(18)
    for pcm in (M.play(TUNES[0]), rng.normal(0, 4000, 9000).astype("<i2").tobytes(), bytes(20000)):
        image, out = M.chroma(np.frombuffer(pcm, "<i2") / 32768.0), []
        for at in range(len(image) - M.SPAN + 1):
            code = 0
            for kind, y, height, width in M.filters():
                part = image[at : at + width, y : y + height]
                w, h = width // 2, height // 2
                one = (part[:w], part[:, :h], (part[:w, :h], part[w:, h:]), part[width // 4 : width - width // 4])[kind]
                a = sum(x.sum() for x in one) if isinstance(one, tuple) else one.sum()
                value = math.log((1 + a) / (1 + part.sum() - a))
                level = sum(value > x + 1e-9 for x in M.LEVELS)
                code = code << 2 | level ^ level >> 1
            out.append(code)
        got = M.fingerprint(pcm)
        assert len(got) == len(out) and sum((int(a) ^ b).bit_count() for a, b in zip(got, out)) <= len(out) // 50


def test_align_empty(spark):
    df = spark.createDataFrame([], "k long, audio binary")
    assert M.align(M.fingerprints(df, "k", "audio"), F.lit(True)).count() == 0


def test_recordings(spark):
    got = {r.id: r.audio for r in M.recordings(vectors(spark, [(1, [0.5, None]), (2, None), (3, [])])).collect()}
    assert got[2] is None and len(got[1]) == 2 * 2 * M.NOTE and got[3] == b""
