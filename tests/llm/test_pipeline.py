import random

from helpers import documents, odd_rows, words
from test_language_id import text
from test_line_dedup import brute as cut
from test_near_dup import brute as groups
from test_tokens import check_packing

import corpus_pipeline as P


def corpus():
    rng = random.Random(11)
    rows = [(i, t, None, "s") for i, t in odd_rows() if i is not None]
    rows += [(100 + k, f"menu of the site\n{text(rng, lang, 30)}\n{text(rng, lang, 25)}", lang, "s") for k in range(60) for lang in [rng.choice(("aa", "bb", "cc"))]]
    rows += [(200 + k, rows[20 + k][1], "aa", "t") for k in range(10)]
    return [*rows, (300, "1234 ---", "aa", "s"), (301, "menu of the site", "aa", "s"), (302, words(rng, 40), None, None)]


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    documents(spark, rows).select(*P.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = P.identify_language(spark, docs, str(tmp_path))
    assert kept.columns == P.COLUMNS
    kept_ids = {r.doc_id for r in kept.collect()}
    assert not kept_ids & {1, 2, 3, 300} and {r[0] for r in rows if 100 <= r[0] < 300} <= kept_ids
    left = [(i, t, None, s) for i, t, _, s in rows if i in kept_ids]
    left = [(i, t, n) for i, t, n in cut(left) if not n or t.strip()]
    got = P.drop_boilerplate(spark, kept, str(tmp_path))
    assert got.columns == P.COLUMNS and sorted(str((r.doc_id, r.text)) for r in got.collect()) == sorted(str((i, t)) for i, t, _ in left)
    assert 301 not in {i for i, _, _ in left} and all("menu of" not in t for i, t, _ in left if i < 200)
    unique = {i: t for i, t, _ in left}
    unique = [(i, unique[i]) for i, _, _, keep in groups(list(unique.items())) if keep]
    got = P.drop_near_duplicates(spark, got, str(tmp_path))
    assert got.columns == P.COLUMNS and sorted((r.doc_id, r.text) for r in got.collect()) == sorted(unique)
    check_packing(P.run(spark, str(tmp_path)).collect(), unique)


def test_large_group_of_copies_keeps_one(spark, tmp_path):
    rng = random.Random(12)
    whole = f"{words(rng, 30)}\n{words(rng, 30)}"
    rows = [(k, f"menu of the site\n{words(rng, 40)}", "aa", "s") for k in range(20)] + [(100 + k, whole, "aa", "s") for k in range(10)]
    rows += [(200 + k, words(rng, 40), "aa", "t") for k in range(35)] + [(300 + k, whole + " x", "aa", "t") for k in range(4)]
    cut_rows = P.drop_boilerplate(spark, documents(spark, rows).select(*P.COLUMNS), str(tmp_path))
    got = {r.doc_id: r.text for r in cut_rows.collect()}
    assert got == {i: t.removeprefix("menu of the site\n") for i, t, _, _ in rows}
    kept = [r.text for r in P.drop_near_duplicates(spark, cut_rows, str(tmp_path)).collect()]
    assert sum(t.startswith(whole) for t in kept) == 1


def test_unlabelled_corpus_is_kept(spark, tmp_path):
    rng = random.Random(14)
    rows = [(k, text(rng, "aa", 30), None, "s") for k in range(20)] + [(30, "12", None, "s"), (31, None, "aa", "s")]
    kept = P.identify_language(spark, documents(spark, rows), str(tmp_path))
    assert kept.columns == P.COLUMNS and sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in rows)


def test_ids_with_several_texts_null_ids_and_repeated_rows(spark, tmp_path):
    rng = random.Random(15)
    a, b, c = (words(rng, 40, 10**6) for _ in range(3))
    rows = [(3, a), (5, a), (5, b), (7, b), (None, a), (None, a), (None, c), (8, ""), (8, None), (9, ""), (9, ""), (10, c), (10, c), (10, c + " x"), (11, "")]
    docs = documents(spark, rows)
    got = P.drop_near_duplicates(spark, docs, str(tmp_path))
    assert got.columns == P.COLUMNS
    found = sorted(map(str, ((r.doc_id, r.text) for r in got.collect())))
    one = [(10, t) for t in (c, c + " x")]  # one of these two
    rest = [(3, a), (5, b), (None, a), (None, c), (8, ""), (8, None), (9, ""), (11, "")]
    assert found in [sorted(map(str, [*rest, o])) for o in one]


def test_empty_tables(spark, tmp_path):
    docs = documents(spark, []).select(*P.COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in P.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert P.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_are_left_out(spark, tmp_path):
    rng = random.Random(16)
    rows = [(k, text(rng, lang, 30), lang, "s") for k in range(20) for lang in ("aa", "bb")]
    docs = documents(spark, rows)
    docs = docs.withColumn("_mark", docs["part"] * 2).withColumn("_alone", docs["part"])
    docs = docs.withColumn("_rules", docs["part"]).withColumn("_none", docs["part"])
    for name, stage in P.STAGES[:3]:
        assert stage(spark, docs, str(tmp_path)).columns == P.COLUMNS, name


def test_stages_are_named():
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "best_fit_packing"] and P.ORACLE_SQL is None
