import math
import random

import numpy as np
import pytest
from helpers import documents, odd_rows
from pyspark.sql import functions as F

from rasterflow.llm import language_id as L

SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["schr", "eit", "ung"], "cc": ["é", "que", "eau"], "dd": ["zy", "wrz", "cki"]}


def text(rng, lang, n=40):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus():
    rng = random.Random(1)
    return [(k, text(rng, lang), lang) for k in range(120) for lang in [rng.choice(list(SYLLABLES))]]


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = documents(spark, rows).withColumn("held_out", L.remainder() == 1)
    model = L.fit(docs.where(~F.col("held_out")))
    found = {r.doc_id: r for r in L.identify(docs, model, ["doc_id", "held_out"]).collect()}
    held = [i for i, _, _ in rows if found[i].held_out]
    assert len(held) > 20 and all(found[i].lang_pred == lang for i, _, lang in rows if i in held)
    assert all(0 <= r.score <= 1 and not r.ambiguous for r in found.values())


def test_odd_rows(spark):
    model = L.fit(documents(spark, corpus()))
    rows = [*odd_rows(), (20, "12 34 -- !?"), (21, text(random.Random(3), "bb", 200_000))]
    found = L.identify(documents(spark, rows), model, ["doc_id", "source"]).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 3, 20))
    assert by_id[21].lang_pred == "bb" and by_id[9].lang_pred in SYLLABLES


def test_slices_do_not_matter(monkeypatch, spark):
    model = L.fit(documents(spark, corpus()))
    texts = [text(random.Random(k), "cc", 60) for k in range(5)] + ["", "x", "é"]
    whole = model.margins(texts)
    monkeypatch.setattr(L, "SLICE", 17)
    assert np.allclose(model.margins(texts), whole)


def test_between_two_is_flagged(spark):
    docs = documents(spark, [(1, "abab abab", "aa"), (2, "abab abab", "bb")])
    row = L.identify(docs, L.fit(docs), ["doc_id"]).first()
    assert row.ambiguous and row.score == pytest.approx(0.5)


def test_no_labels_one_label_no_rows(spark):
    assert L.fit(documents(spark, [(1, "abc")])) is None
    assert L.identify(documents(spark, [(1, "abc")]), None, ["doc_id"]).first().lang_pred == "und"
    docs = documents(spark, [(1, "abc", "aa"), (2, None, "bb")])
    assert L.identify(docs, L.fit(docs), ["doc_id"]).first().lang_pred == "aa"
    assert L.identify(documents(spark, []), L.fit(docs), ["doc_id"]).count() == 0


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 20, 60])
def test_codewords(n):
    code = L.codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n
    assert all(0 < c.sum() < n for c in code.T)
    assert (code == L.codewords(n)).all()


def test_one_wrong_bit_is_corrected():
    code = L.codewords(4)
    model = L.Model.__new__(L.Model)
    model.code = code
    for n, row in enumerate(code):
        for bit in range(code.shape[1]):
            margins = (2.0 * row - 1)[None].copy()
            margins[0, bit] *= -1
            assert model.decode(margins, L.MIN_GAP)[0][0] == n


def test_too_many_labels(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        L.fit(documents(spark, corpus()))


def plain_margins(rows, texts):
    """The margins by counts in dictionaries, and the codewords."""
    grams = lambda t: [raw[k : k + n] for raw in [t.encode().lower()] for n in (2, 3) for k in range(len(raw) - n + 1)]
    feature = lambda g: g[0] << 8 | g[1] if len(g) == 2 else L.BUCKETS + ((((g[0] << 16 | g[1] << 8 | g[2]) * 0x9E3779B1) & 0xFFFFFFFF) >> 16)
    languages = sorted({lang for _, _, lang in rows})
    counts = {lang: {} for lang in languages}
    for _, t, lang in rows:
        for g in grams(t):
            counts[lang][feature(g)] = counts[lang].get(feature(g), 0) + 1
    code = L.codewords(len(languages))
    out = []
    for t in texts:
        row = []
        for bit in code.T:
            sides = [{}, {}]
            for lang, b in zip(languages, bit):
                for f, n in counts[lang].items():
                    sides[b][f] = sides[b].get(f, 0) + n
            total = [sum(side.values()) for side in sides]
            weight = lambda f, sides=sides, total=total: math.log((sides[1].get(f, 0) + L.SMOOTHING) / (total[1] + L.SMOOTHING * L.FEATURES)) - math.log((sides[0].get(f, 0) + L.SMOOTHING) / (total[0] + L.SMOOTHING * L.FEATURES))
            found = [weight(feature(g)) for g in grams(t)]
            row.append(sum(found) / max(1, len(found)))
        out.append(row)
    return languages, code, out


def plain_decode(languages, code, margins):
    losses = [sum(math.log1p(math.exp(-L.SHARPNESS * m * (1 if b else -1))) for m, b in zip(margins, bits)) for bits in code.tolist()]
    best = min(range(len(losses)), key=losses.__getitem__)
    rest = sorted(losses)
    return languages[best], 1 / sum(math.exp(rest[0] - x) for x in losses), len(rest) > 1 and rest[1] - rest[0] < L.MIN_GAP


def test_against_a_plain_version(spark):
    rows = [(k, t[:80], lang) for k, t, lang in corpus()[:40]]
    docs = documents(spark, rows)
    rng = random.Random(9)
    texts = [t for _, t, _ in rows[:8]] + [text(rng, "aa", 4) + " " + text(rng, "bb", 4) for _ in range(6)] + ["x", "éé", "ab", "ka 12 que"]
    languages, code, margins = plain_margins(rows, texts)
    model = L.fit(docs)
    assert model.languages == languages and np.allclose(model.margins(texts), margins, atol=1e-4)
    found = {r.doc_id: r for r in L.identify(documents(spark, list(enumerate(texts))), model, ["doc_id"]).collect()}
    for k, row in enumerate(margins):
        lang, score, ambiguous = plain_decode(languages, code, row)
        assert found[k].lang_pred == lang and abs(found[k].score - score) < 1e-3 and found[k].ambiguous == ambiguous


@pytest.mark.parametrize(("t", "lettered"), [("12 ½ ² Ⅷ ① _", False), ("٣", False), ("ª", True), ("日", True), ("x1", True), ("\U00010400", True), ("ʰ", True), ("😀 \u0301", False)])
def test_letters(spark, t, lettered):
    model = L.fit(documents(spark, corpus()[:10]))
    assert (L.identify(documents(spark, [(1, t)]), model, ["doc_id"]).first().lang_pred != "und") == lettered
