"""Byte-level BPE ids of whole texts with the tokenizers library, each word encoded once.

A byte-level pre-tokenizer never joins a space to what stands before it when a character
that isn't white space follows, and takes a lone line feed by itself. So in a text
whose white space is lone spaces and lone line feeds between other characters, each word with
the space or line feed before it can be encoded on its own. Such texts are split and their words numbered by
Arrow; each different word is looked up or encoded once for a batch, and the ids of all
are gathered by array operations. Every other text goes to the tokenizer whole. Both ways give the
same ids.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

#: Characters taken for white space by Python, but for space and line feed.
ODD_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"
#: A text in which this is found goes to the tokenizer whole.
UNUSUAL = f"^$|^[ \n]|[ \n]$|[ \n][ \n]|[{ODD_SPACE}]"
#: Words kept at most, in all some 150 MB; other words are encoded once for each batch.
CACHE_WORDS = 600_000
#: Bytes of text whose words are numbered together.
BATCH_BYTES = 8 << 20


def load(path: str | None = None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Tokenizer.from_file(path)


def ids_of(tokenizer, text: str) -> bytes:
    import numpy as np

    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@functools.lru_cache(maxsize=1)
def encoder(path: str | None = None) -> Encoder:
    """The encoder of this worker process, whose words outlive a task."""
    return Encoder(path)


class Encoder:
    """The ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str | None = None):
        self.tokenizer, self.known = load(path), {}
        self.feed = ids_of(self.tokenizer, "\n")

    def encode(self, text: str) -> bytes:
        import pyarrow as pa

        return next(self.encode_all(pa.array([text])))

    def encode_all(self, texts) -> Iterator[bytes]:
        """The ids of each text of an Arrow string array, in order; a null counts as empty."""
        import pyarrow.compute as pc

        texts = texts.fill_null("")
        sizes, at = pc.binary_length(texts).to_pylist(), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size < BATCH_BYTES or end == at):
                size += sizes[end]
                end += 1
            yield from self._encode(texts.slice(at, end - at))
            at = end

    def _word(self, word: str) -> bytes:
        """A word with the line feed before it, or else with a space."""
        found = self.feed + ids_of(self.tokenizer, word[1:]) if word[:1] == "\n" else ids_of(self.tokenizer, " " + word)
        if len(self.known) < CACHE_WORDS:
            self.known[word] = found
        return found

    def _encode(self, texts) -> Iterator[bytes]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        unusual = pc.match_substring_regex(texts, UNUSUAL)
        plain = texts.filter(pc.invert(unusual))
        parts = iter(())
        if len(plain):
            begun = pc.binary_join_element_wise("\n", pc.replace_substring(plain, "\n", " \n"), "")
            words = pc.split_pattern(begun, " ")
            if isinstance(words, pa.ChunkedArray):
                words = words.combine_chunks()
            ends = words.offsets.to_numpy() - words.offsets[0].as_py()
            numbered = words.flatten().dictionary_encode()
            number = numbered.indices.to_numpy()
            known = self.known
            blobs = [known.get(w) or self._word(w) for w in numbered.dictionary.to_pylist()]
            n = np.fromiter(map(len, blobs), np.int64, len(blobs)) >> 2
            ids, first = np.frombuffer(b"".join(blobs), "<u4"), np.cumsum(n) - n
            each = n[number]
            before = np.concatenate([[0], np.cumsum(each)])
            place = np.repeat(first[number] - before[:-1], each)
            place += np.arange(before[-1])
            raw, bounds = memoryview(ids[place].tobytes()), 4 * before[ends]
            # each text's ids but for the line feed put before it
            parts = (bytes(raw[a + 4 : b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()))
        for text, whole in zip(texts, unusual.to_pylist()):
            yield ids_of(self.tokenizer, text.as_py()) if whole else next(parts)
