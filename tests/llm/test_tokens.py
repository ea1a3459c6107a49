import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents, odd_rows, words
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterflow.llm import packing as P
from rasterflow.llm import token_files as T
from rasterflow.llm import tokens

ENCODER = tokens.Encoder()
TEXTS = st.text(st.sampled_from("ab é,.'s\n \t1　日"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_ids_equal_the_tokenizers(texts):
    got = list(ENCODER.encode_all(pa.array(texts, pa.string())))
    assert got == [tokens.ids_of(ENCODER.tokenizer, t) for t in texts]


def test_full_cache(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 2)
    small = tokens.Encoder()
    text = words(random.Random(3), 500)
    assert small.encode(text) == small.encode(text) == tokens.ids_of(small.tokenizer, text) and len(small.known) == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_codes_round_trip(ids):
    reader = T.Reader(T.pack(ids))
    assert reader.all().tolist() == ids and len(reader) == len(ids)
    for i in {0, len(ids) // 2, len(ids) - 1} & set(range(len(ids))):
        assert reader[i] == ids[i]


def test_codes_access_across_blocks():
    ids = [(k * 7919) % 70_000 for k in range(5000)]
    reader = T.Reader(T.pack(ids))
    assert [reader[i] for i in range(0, 5000, 37)] == ids[::37]
    with pytest.raises(IndexError):
        reader[5000]
    with pytest.raises(ValueError):
        T.Reader(b"nothing at all")


def ids_of(text, end):
    return np.append(np.frombuffer(tokens.ids_of(ENCODER.tokenizer, text or ""), "<u4"), end).astype("<u4")


def corpus():
    rng = random.Random(8)
    return odd_rows() + [(100 + k, words(rng, rng.choice((1, 30, 300, 900)))) for k in range(60)]


@pytest.mark.parametrize(("segment", "part"), [(T.SEGMENT_IDS, T.PART_BYTES), (500, 20_000)])
def test_token_files(spark, segment, part):
    rows = corpus()
    found = T.read_token_files(T.write_token_files(documents(spark, rows), segment_ids=segment, part_bytes=part)).collect()
    expected, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = ids_of(text, T.END_ID)
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes()), T.END_ID))
        start += len(ids)
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_empty_tables(spark):
    assert T.read_token_files(T.write_token_files(documents(spark, []))).count() == 0
    assert P.pack_documents(documents(spark, [])).count() == 0


def test_pieces():
    assert P.pieces_of(5, 1024) == [(0, 5)]
    assert P.pieces_of(1024, 1024) == [(0, 1024)]
    assert P.pieces_of(2049, 1024) == [(0, 1), (1, 1024), (1025, 1024)]
    assert P.pieces_of(2048, 1024) == [(0, 1024), (1024, 1024)]


class Plain:
    """Best fit by looking at every open bin."""

    def __init__(self, capacity, limit):
        self.capacity, self.limit, self.open, self.n = capacity, limit, {}, 0

    def place(self, length):
        fits = [(free, b) for b, free in self.open.items() if free >= length]
        free, b = min(fits) if fits else (self.capacity, self.n)
        self.n += not fits
        self.open[b] = free - length
        if not self.open[b]:
            del self.open[b]
        while len(self.open) > self.limit:
            fullest = min(self.open.values())
            del self.open[max((k for k, f in self.open.items() if f == fullest), key=lambda k: k == b)]
        return free - length


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_best_fit_takes_the_least_space(limit):
    rng, fit, plain = random.Random(limit), P.BestFit(100, limit), Plain(100, limit)
    for _ in range(2000):
        n = rng.randint(1, 100)
        _, offset = fit.place(n)
        assert 100 - offset - n == plain.place(n)
    assert fit.n_bins == plain.n


def check_packing(placed, rows):
    whole = {}
    for r in placed:
        whole.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in whole.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= P.CAPACITY
    expected = []
    for i, text in rows:
        ids = ids_of(text, P.END_ID)
        expected += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(P.pieces_of(len(ids), P.CAPACITY))]
    assert sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in placed) == sorted(map(str, expected))
    return len(whole)


def test_pack_documents(spark):
    rows = corpus()
    placed = P.pack_documents(documents(spark, rows)).collect()
    total = sum(r.length for r in placed)
    assert check_packing(placed, rows) <= 1.1 * total / P.CAPACITY + 1
    check_packing(P.pack_documents(documents(spark, rows), packer_docs=20, open_bins=2, lookahead=3).collect(), rows)
