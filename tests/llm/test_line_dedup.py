import duckdb
from helpers import documents, odd_rows

from rasterflow.llm import line_dedup as D


def brute(rows, ratio=D.RATIO, least=D.MIN_PAGES, copies_once=True):
    pages, holding = {}, {}
    for text, host in {(t, h) for _, t, _, h in rows} if copies_once else [(t, h) for _, t, _, h in rows]:
        pages[host] = pages.get(host, 0) + 1
        for line in set((text or "").split("\n")) - {""}:
            holding[host, line] = holding.get((host, line), 0) + 1
    bad = {k for k, n in holding.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for i, text, _, host in rows:
        lines = None if text is None else text.split("\n")
        left = None if lines is None else [x for x in lines if (host, x) not in bad]
        out.append((i, None if left is None else "\n".join(left), 0 if lines is None else len(lines) - len(left)))
    return out


def rows():
    out = [(i, t, None, None) for i, t in odd_rows()]
    out += [(100 + k, f"menu\nown {k}\n\nmenu\nfooter" if k % 3 else f"own {k}\nfooter", None, "a") for k in range(30)]
    out += [(200 + k, f"rare\ntext {k}" if k < 4 else f"text {k}", None, "b") for k in range(40)]
    out += [(300 + k, "menu\nonly", None, "c") for k in range(3)]
    return out + [(400 + k, "shared\nline", None, None) for k in range(5)]


def test_against_brute_force(spark):
    got = D.line_dedup(documents(spark, rows()), count_col="n_dropped")
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(map(str, ((r.doc_id, r.text, r.n_dropped) for r in got.collect()))) == sorted(map(str, brute(rows())))


def test_copies_counted_each(spark):
    got = D.line_dedup(documents(spark, rows()), count_col="n_dropped", copies_once=False)
    assert sorted(map(str, ((r.doc_id, r.text, r.n_dropped) for r in got.collect()))) == sorted(map(str, brute(rows(), copies_once=False)))


def test_sql():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [[i, t, h] for i, t, _, h in rows()])
    found = con.execute(D.oracle_sql("SELECT doc_id, text, n_dropped FROM cut")).fetchall()
    assert sorted(map(str, found)) == sorted(map(str, brute(rows())))


def test_names_that_the_operator_uses(spark):
    docs = documents(spark, rows())
    for name in ("rules", "host", "hit", "stay", "page", "a", "b", "line", "_rules", "_rule_host", "_hit", "_stay", "n_pages", "host_pages", "keys", "key", "a.b"):
        docs = docs.withColumn(name, docs["part"] + 1)
    got = D.line_dedup(docs, count_col="n_dropped")
    assert got.columns == [*docs.columns, "n_dropped"]
    assert sorted(map(str, ((r.doc_id, r.text, r.n_dropped) for r in got.collect()))) == sorted(map(str, brute(rows())))
    assert all(r[c] == 8 for r in got.collect() for c in ("rules", "host", "_hit", "key", "a.b"))


def test_hashes_are_of_different_seeds(spark):
    a, b = spark.sql("select 'x' as line").select(D._key(D.F.col("line")).alias("k")).first().k
    assert b != spark.sql(f"select xxhash64(1, {a}) as x, hash(1) as y").first().x and a != b
    chained = spark.sql("select xxhash64('x', 1) as x").first().x
    assert b != chained


def test_rules_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", -1)
    got = D.line_dedup(documents(spark, rows()))
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == sorted(str(r[:2]) for r in brute(rows()))


def test_empty(spark):
    assert D.line_dedup(documents(spark, [])).count() == 0
