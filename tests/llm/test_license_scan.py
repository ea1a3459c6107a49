import random

import duckdb
import pytest
from helpers import documents, odd_rows, words

from rasterflow.llm import license_scan as L

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def brute(text):
    words = L.words_of(text or "")
    places, base = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    own, most = set(), 0.0
    for _, label, template, width, must in L.template_sets(L.TEMPLATES):
        for k, word in enumerate(words):
            if word in template:
                block = set(words[k : k + width])
                held = len(block & set(template))
                if held >= L.needed(L.THRESHOLD, len(template)) and set(must) <= block:
                    own.add(label)
                    most = max(most, held / len(template))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if places else most)


def rows():
    rng = random.Random(5)
    out = odd_rows()
    for k in range(100, 160):
        lines = []
        for _ in range(rng.randint(1, 5)):
            _, text, _ = rng.choice(L.TEMPLATES)
            parts = text.split()
            for _ in range(rng.randint(0, 5)):
                parts.insert(rng.randrange(len(parts) + 1), rng.choice(["foo", "the", "MIT", "license", "cc-by", "Apache"]))
            if rng.random() < 0.5:
                del parts[rng.randrange(len(parts))]
            lines.append(rng.choice([" ", "  ", "\t"]).join(parts))
        out.append((k, "\n".join(lines)))
    notices = [t for _, t, _ in L.TEMPLATES]
    for k, text in enumerate(notices):  # wrapped, and with the words scattered over a long line
        parts = text.split()
        out.append((300 + k, "\n * ".join([" ".join(parts[: len(parts) // 3]), " ".join(parts[len(parts) // 3 : 2 * len(parts) // 3]), " ".join(parts[2 * len(parts) // 3 :])])))
        out.append((400 + k, words(rng, 40 + k) + " " + " pad pad pad ".join(parts) + " " + words(rng, 50)))
        out.append((500 + k, words(rng, 20 + 3 * k) + " " + text + ". " + words(rng, 10) + " " + " ".join(reversed(parts))))
    return [*out, (200, "GNU\ngeneral -- Public: LICENSE and mit license MIT License"), (201, "xgnu general public license"), (201, "xgnu general public license")]


def test_against_brute_force(spark):
    given = rows()
    got = sorted(map(str, (tuple(r) for r in L.license_scan(documents(spark, given)).collect())))
    assert got == sorted(str((i, *brute(t))) for i, t in given)


def test_sql(spark):
    given = [r for r in rows() if r[0] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in given])
    expected = con.execute(L.oracle_sql())
    names = [c[0] for c in expected.description]
    assert names == COLUMNS
    assert sorted(map(str, expected.fetchall())) == sorted(str((i, *brute(t))) for i, t in given)


def test_wrapped_scattered_and_short_notices(spark):
    mit, grant = (t for n, t, _ in L.TEMPLATES if n == "mit-notice")
    grant = grant.split()
    given = [
        (1, "# " + " ".join(grant[:6]) + "\n# " + " ".join(grant[6:12]) + "\n# " + " ".join(grant[12:])),
        (2, " ".join(f"{w} and then some more words of prose stand here" for w in "This work is in the public domain".split())),
        (3, "Licensed under CC BY-NC 4.0."),
        (4, "Released under the Apache License"),
        (5, mit),
        (6, "This work is licensed under a Creative Commons Attribution 4.0 International License."),
        (7, "This library is free software; you can redistribute it and/or modify it under\nthe terms of the GNU General Public License"),
    ]
    got = {r.doc_id: (r.labels, r.score) for r in L.license_scan(documents(spark, given)).collect()}
    assert got[1] == ("mit-notice", 1.0) and got[2] == ("", 0.0)
    assert got[3][0] == "cc-by,cc-by-nc-notice" and got[4][0] == "apache" and "mit-notice" in got[5][0]
    assert got[6] == ("cc-by-notice", 1.0) and got[7][0] == "gpl,gpl-notice"


def test_obligatory_words():
    assert L.template_sets([("a", "one two three", "two"), ("b", "One one"), ("c", " - ")]) == [(0, "a", ["one", "three", "two"], 4, ["two"]), (1, "b", ["one"], 3, [])]
    with pytest.raises(ValueError, match="must hold"):
        L.template_sets([("a", "one two", "three")])


def test_empty(spark):
    assert L.license_scan(documents(spark, [])).columns == COLUMNS
    assert L.license_scan(documents(spark, [])).count() == 0
