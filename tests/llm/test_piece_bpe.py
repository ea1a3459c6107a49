import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from helpers import documents, odd_rows, words
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterflow.llm import piece_bpe as B

MODEL = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
PLAIN, DROPPED = B.Encoder(dropout=0), B.Encoder(dropout=0.3, seed=9)
TEXTS = st.text(st.sampled_from("abehrstn é,.\n \t▁<日Ⅷ"), max_size=60)


def ids(blob):
    return np.frombuffer(blob, "<u4").tolist()


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_lossless_and_like_the_library(text):
    if B.MARK not in text:
        assert ids(PLAIN.encode(text)) == MODEL.encode(text)
    assert PLAIN.decode(PLAIN.encode(text)) == text
    assert DROPPED.decode(DROPPED.encode(text, 5)) == text


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("aberstnlo▁é日"), min_size=1, max_size=30), min_size=1, max_size=20), st.integers(0, 3))
def test_step_equals_agenda(some, variant):
    assert DROPPED.in_step(some, variant) == [DROPPED._bytes(w, DROPPED.agenda(w, variant)) for w in some]


def test_long_word_like_the_library():
    text = "x".join(words(random.Random(2), 300).split())
    assert ids(PLAIN.encode(text)) == MODEL.encode(text)
    assert DROPPED.decode(DROPPED.encode(text)) == text


def test_seeds_and_occurrences_vary():
    text = "international understanding " * 50
    a, b = DROPPED.encode(text, 1), B.Encoder(dropout=0.3, seed=10).encode(text, 1)
    assert a == B.Encoder(dropout=0.3, seed=9).encode(text, 1) != b
    assert len(ids(a)) > len(MODEL.encode(text))
    assert len({DROPPED.encode("international", k) for k in range(50)}) > 1


def by_occurrence(coder, text, document):
    """Each word by an agenda of its own."""
    out, key, feed = b"", np.array([coder._key(document)]), np.array([coder.pieces.byte[10]], "<u4").tobytes()
    for k, part in enumerate(text.replace("\n", " \n").split(" ")):
        word = part[1:] if part[:1] == "\n" else B.MARK + part
        blob = coder._bytes(word, coder.agenda(word, key=coder._occurrence(key, np.array([k])))) if word else b""
        out += feed + blob if part[:1] == "\n" else blob
    return out


@pytest.mark.parametrize("dropout", [0.1, 0.3, 0.6])
def test_every_occurrence_has_skips_of_its_own(dropout):
    coder = B.Encoder(dropout=dropout, seed=9)
    rng = random.Random(4)
    pool = ["international", "understanding", "the", "étude", "日本", "x" * 40, "information" * 3, "word" * 20]
    texts = [" ".join(rng.choice(pool) + rng.choice(["", "", "\n", "\nof"]) for _ in range(60)) for _ in range(8)]
    got = list(coder.encode_all(list(range(8)), pa.array(texts)))
    assert got == [by_occurrence(coder, t, k) for k, t in enumerate(texts)]
    assert [coder.decode(b) for b in got] == texts


@pytest.mark.parametrize("short, long", [(48, 512), (4, 512), (4, 6), (1, 2)])
def test_long_words_in_parts_equal_one_agenda(monkeypatch, short, long):
    monkeypatch.setattr(B, "SHORT", short)
    monkeypatch.setattr(B, "LONG", long)
    coder, rng = B.Encoder(dropout=0.2, seed=3), random.Random(7)
    texts = ["".join(rng.choice(["the", "und", "日本", "q", "ing", "é", "🙂", "x" * 5, "information", "\x00"]) for _ in range(n)) for n in (3, 30, 400)]
    texts += [t + "\n" + t for t in texts] + [f"{texts[1]} of {texts[1]}"]
    assert list(coder.encode_all(list(range(len(texts))), pa.array(texts))) == [by_occurrence(coder, t, k) for k, t in enumerate(texts)]
    whole = B.Encoder(dropout=0)
    assert ids(whole.encode(texts[1])) == MODEL.encode(texts[1])


def test_own_marks_and_runs_of_spaces():
    for text in ("▁", "a▁b  ▁▁ c", " x▁\n▁ y", "  🙂▁\n\n"):
        assert DROPPED.decode(DROPPED.encode(text, 2)) == PLAIN.decode(PLAIN.encode(text)) == text


def test_a_word_has_more_than_four_segmentations():
    word, coder = "international", B.Encoder(dropout=0.3, seed=9)
    assert len({coder.encode(word, k) for k in range(500)}) > 20
    assert len({coder.encode(f"{word} " * 200, k) for k in range(5)}) == 5


def test_batches_do_not_matter(monkeypatch):
    texts = [words(random.Random(k), 50) for k in range(20)] + ["a  b", "", None]
    whole = list(DROPPED.encode_all(list(range(23)), pa.array(texts)))
    monkeypatch.setattr(B, "BATCH_BYTES", 100)
    monkeypatch.setattr(B, "CACHE_WORDS", 5)
    assert list(B.Encoder(dropout=0.3, seed=9).encode_all(list(range(23)), pa.array(texts))) == whole


def test_documents(spark):
    rows = odd_rows()
    found = B.encode_documents(documents(spark, rows), with_ids=True).collect()
    assert len(found) == len(rows) and all(r.lossless for r in found)
    coder = B.Encoder()
    assert sorted(str((r.doc_id, r.n_tokens, bytes(r.ids))) for r in found) == sorted(str((i, len(b) // 4, b)) for i, b in ((i, coder.encode(t or "", i)) for i, t in rows))
    texts = B.decode_documents(B.encode_documents(documents(spark, rows), with_ids=True)).collect()
    assert sorted(str((r.doc_id, r.text)) for r in texts) == sorted(str((i, t or "")) for i, t in rows)
    assert B.encode_documents(documents(spark, [])).count() == 0
