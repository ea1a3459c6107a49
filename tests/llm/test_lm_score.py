import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import documents, odd_rows, words
from pyspark.sql import functions as F

from rasterflow.llm import language_id
from rasterflow.llm import lm_score as L


def brute(rows):
    """Base and model by dictionaries, context by context."""
    train = [zlib.crc32(str(i if i is not None else "").encode()) % 7 != 2 for i, _ in rows]
    texts = [(t or "").encode().lower() for _, t in rows]
    tokens = [[*t.split(), None] for t in texts]
    counts = Counter(w for ws, f in zip(tokens, train) if f for w in ws)
    n, v = sum(counts.values()), len(counts)
    contexts = defaultdict(Counter)
    pad = b"\xff" * L.ORDER
    for t, f in zip(texts, train):
        s = pad + t + b"\xff"
        for i in range(L.ORDER, len(s) if f else 0):
            for k in range(L.ORDER + 1):
                contexts[s[i - k : i]][s[i]] += 1

    def model(t):
        s, total = pad + t + b"\xff", 0.0
        for i in range(L.ORDER, len(s)):
            excluded = set()
            for k in range(L.ORDER, -1, -1):
                seen = {b: c for b, c in contexts[s[i - k : i]].items() if b not in excluded} if s[i - k : i] in contexts else {}
                size = sum(seen.values()) + len(seen)
                if s[i] in seen:
                    total += math.log10(seen[s[i]] / size)
                    break
                if seen:
                    total += math.log10(len(seen) / size)
                    excluded |= seen.keys()
            else:
                total -= math.log10(256 - len(excluded))
        return total

    cache = {}
    for (i, _), f, t, ws in zip(rows, train, texts, tokens):
        if t not in cache:
            cache[t] = model(t)
        yield i, not f, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), cache[t]


def corpus():
    rng = random.Random(4)
    rows = [r if r[0] != 8 else (8, words(rng, 3000)) for r in odd_rows()]
    return rows + [(k, words(rng, rng.randint(1, 80)) + rng.choice(["", " ÉTÉ", "\n\tend"])) for k in range(100, 160)]


@pytest.mark.parametrize(("bucket", "group"), [(1 << 24, 4096), (4000, 4096), (4000, 1)])
def test_against_brute_force(spark, monkeypatch, bucket, group):
    monkeypatch.setattr(L, "GROUP", group)
    monkeypatch.setattr(L, "FAN_IN", 2)
    monkeypatch.setattr(L, "MAX_SHARDS", 3)
    monkeypatch.setattr(L, "COPY", 2 if group == 1 else 1 << 18)
    rows = corpus()
    train = language_id.remainder(by=7) != 2
    found = L.lm_scores(documents(spark, rows), train, bucket_bytes=bucket).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[6])
    for got, expected in zip(sorted(map(tuple, found), key=key), sorted(brute(rows), key=key), strict=True):
        assert got[:5] == expected[:5]
        assert got[5] == pytest.approx(expected[5], rel=1e-9) and got[6] == pytest.approx(expected[6], rel=1e-5)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 101, 200).astype(np.uint8)) for _ in range(5)]
    grams, counts = np.unique(L.grams_of(texts)[0], return_counts=True)
    trie = L.Trie(grams, counts, L._merged(grams & np.uint64((1 << 8 * (L.SHALLOW + 1)) - 1), counts))
    for context in (b"abcda", b"zzzzz", b"zzzab", b"zabcd", b"\xff" * 5):
        base = np.uint64(int.from_bytes(context, "big")) << np.uint64(8)
        assert (10 ** trie.log10(base + np.arange(256, dtype=np.uint64))).sum() == pytest.approx(1)


def test_one_id_and_very_common_bytes(spark):
    """All rows of one id, most of them of one byte: buckets and shards go by texts and longer contexts too."""
    rng = random.Random(8)
    rows = [(7, "a" * rng.randint(0, 300)) for _ in range(60)] + [(None, "ab" * rng.randint(0, 90) + f" {k}") for k in range(40)]
    found = L.lm_scores(documents(spark, rows), language_id.remainder(by=7) != 2, bucket_bytes=2000).collect()
    key = lambda r: (r[0] is not None, r[2], r[6])
    for got, expected in zip(sorted(map(tuple, found), key=key), sorted(brute(rows), key=key), strict=True):
        assert got[:5] == expected[:5] and got[6] == pytest.approx(expected[6], rel=1e-5)


def test_no_training_rows_and_empty(spark):
    rows = L.lm_scores(documents(spark, [(1, "ab"), (2, None)]), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.held_out for r in rows)
    assert {r.doc_id: r.score for r in rows}[2] == pytest.approx(-math.log10(256))
    assert L.lm_scores(documents(spark, []), F.lit(True)).count() == 0


def test_adaptive_learns():
    mixed = "".join(random.Random(1).choices("abcdefghij", k=180))
    assert L.adaptive_bits("abc" * 60) < 180 < L.adaptive_bits(mixed)
    assert L.adaptive_bits("abc" * 120) - L.adaptive_bits("abc" * 60) < 40
    assert L.adaptive_bits("") == 8
