import duckdb
import numpy as np
import pytest

from rasterflow.llm import media, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    expected = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in expected.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(names) == sorted(got.columns)
    assert sorted(str([r[n] for n in names]) for r in got.collect()) == sorted(str(list(r)) for r in expected.fetchall())


@pytest.mark.parametrize(("name", "table"), [("op3_token_files", "documents"), ("op4_piece_bpe", "documents"), ("op5_lm_score", "documents"), ("op6_minhash", "documents"), ("op7_language_id", "documents"), ("op9_chroma_fingerprints", "embeddings")])
def test_a_row_for_each_input_row(spark, name, table):
    assert queries.QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


def test_op9_returns_every_alignment(spark, tmp_path):
    tune = np.random.default_rng(4).normal(0, 0.2, 64)
    rows = [(50, tune), (1, tune), (2, tune), (3, np.concatenate([[9.0] * 6, tune])), (4, -tune[::-1] * 3)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    audio = media.recordings(df)
    expected = sorted(tuple(r)[1:] for r in media.align(media.fingerprints(audio, "id", "audio"), media.F.col("id") == 50).collect())
    got = {r.vec_id: r for r in queries.QUERIES["op9_chroma_fingerprints"](spark, str(tmp_path)).collect()}
    assert len(got) == 5 and got[1].alignments is None
    assert {a.match_id for a in got[50].alignments} >= {1, 3} and [tuple(a) for a in got[50].alignments] == expected
    assert got[50].n_matches == len(expected) and got[50].best_match == 1
