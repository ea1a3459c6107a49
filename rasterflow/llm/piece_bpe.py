"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

A text's spaces become the mark U+2581, one more stands before it, and each character is a
symbol. An agenda holds the pairs of neighbours whose joined string is a piece, best
score first, then leftmost; the next candidate is popped and merged, which brings up new ones. With
dropout, a candidate is skipped when a keyed hash of the seed, the document, the place of the
word's occurrence in it and the candidate's place in the word falls below the dropout rate. Equal seeds so give equal
segmentations on any number of machines, and other seeds, documents or places give others. Characters
without a piece become UTF-8 bytes; so does a mark that the text itself holds.

No piece goes on after a mark or a line feed once it has another character, so words - with
the marks before them - are encoded apart. Arrow splits and numbers the words of a batch. Each
word goes through its agenda once without skips, and is kept with its ids and all candidates that it met.
An occurrence whose own hashes skip none of these has the same ids; every other goes through
an agenda of its own. Agendas go in step, as arrays. Long words are first cut where no
piece can span, as no piece of two characters and no part of three of a piece is there.

Decoding joins pieces and bytes, turns marks into spaces and drops the first. It gives
back every text, at any dropout.

Defined cases: a null or empty text has no ids; repeated rows get the same ids; a null document
id has a hash of its own; other columns are ignored; an empty table gives an empty result.
Texts are never cut.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
DROPOUT = 0.1
SEED = 1
#: Words up to this length are kept with the candidates that they meet; longer ones are taken in parts.
SHORT = 48
#: Parts up to this length go through their agendas in step, longer ones by a heap.
LONG = 4096
#: Words that a worker keeps, up to a batch's more.
CACHE_WORDS = 400_000
#: Occurrences that are gone through at once.
OCCURRENCES = 1 << 17
#: Cells of a matrix whose words go in step; more for long words, so that a step is of ROWS words; at most MOST_CELLS.
CELLS, ROWS, MOST_CELLS = 1 << 17, 512, 1 << 21
#: Bytes of text whose words are numbered together.
BATCH_BYTES = 8 << 20
TABLE_BITS = 19
#: Stands for a mark that the text itself holds: a lone surrogate, which no text of Arrow has.
OWN_MARK = 0xDFFF
#: Texts in which this is found are taken apart one by one.
UNUSUAL = f"^$|^ |  |{MARK}"
UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

ENCODED = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, lossless boolean"


def _mix(x):
    """A 64-bit mixer of unsigned integer arrays."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(words: list[str]):
    """(the characters of all words, the length of each)."""
    import numpy as np

    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64), np.fromiter(map(len, words), np.int64, len(words))


def _offsets(codes, first):
    """The place of a word's first character: a line feed stands before the others."""
    return -(codes[first] == 10).astype("int64")


class Pieces:
    """The vocabulary of a model file: merges by pair, ids of characters and bytes."""

    def __init__(self, path: str | None = None):
        import numpy as np
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(self.size)]
        plain = {n: i for i, n in enumerate(names) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.byte = np.zeros(256, np.int32)
        for i in range(self.size):
            if model.is_byte(i):
                self.byte[int(names[i][3:5], 16)] = i
        self.raw = [n.replace(MARK, " ").encode() for n in names]
        for b, i in enumerate(self.byte.tolist()):
            self.raw[i] = bytes([b])
        self.unknown = model.unk_id()
        self.character = np.full(0x110000, self.unknown, np.int32)
        for n, i in plain.items():
            if len(n) == 1:
                self.character[ord(n)] = i
        self.rank = np.zeros(self.size, np.int32)
        self.pairs: dict[int, int] = {}
        threes = set()
        for n, i in plain.items():
            self.rank[i] = round(-model.get_score(i))
            threes.update(n[k : k + 3] for k in range(len(n) - 2))
            for k in range(1, len(n)):
                if n[:k] in plain and n[k:] in plain:
                    self.pairs[plain[n[:k]] * self.size + plain[n[k:]]] = i
        self.table, self.pair_piece = self._table(self.pairs)
        code = lambda part: functools.reduce(lambda x, c: (x << 21) | ord(c), part, 0)
        self.joined = np.array(sorted({code(n) for n in plain if len(n) == 2} | {code(n) for n in threes}), np.int64)

    @staticmethod
    def _slot(key):
        import numpy as np

        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _table(self, pairs: dict[int, int]):
        """An open hash table of the pairs: keys (-1: free), and their pieces."""
        import numpy as np

        keys, pieces = np.full((1 << TABLE_BITS) + len(pairs), -1, np.int64), np.zeros((1 << TABLE_BITS) + len(pairs), np.int32)
        for key, slot in zip(pairs, self._slot(np.array(list(pairs), np.int64)).tolist()):
            while keys[slot] >= 0:
                slot += 1
            keys[slot], pieces[slot] = key, pairs[key]
        return keys, pieces

    def merged(self, left, right):
        """The piece of each pair, or -1. (arrays)"""
        import numpy as np

        key = left.astype(np.int64) * self.size + right
        slot = self._slot(key)
        seen = self.table[slot]
        out = np.where(seen == key, self.pair_piece[slot], -1)
        open_ = np.flatnonzero((seen != key) & (seen >= 0))
        while len(open_):
            slot[open_] += 1
            seen = self.table[slot[open_]]
            hit = seen == key[open_]
            out[open_[hit]] = self.pair_piece[slot[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out

    def closed(self, codes):
        """Places (1 .. n - 1) that no piece found in the word can span: no piece of two, no part of three of a piece."""
        import numpy as np

        held = lambda x: self.joined[np.minimum(np.searchsorted(self.joined, x), len(self.joined) - 1)] == x
        codes = codes.astype(np.int64)
        two = (codes[:-1] << 21) | codes[1:]
        spanned, three = held(two), held((two[:-1] << 21) | codes[2:])
        spanned[:-1] |= three
        spanned[1:] |= three
        return np.flatnonzero(~spanned) + 1


class Encoder:
    """``encode(text, document)``: ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str | None = None, dropout: float = DROPOUT, seed: int = SEED):
        self.pieces, self.dropout, self.seed = Pieces(path), dropout, seed
        self._forget()

    def _forget(self) -> None:
        """No words: the number of each, and by it all candidates that its agenda meets if none is skipped, and its ids then."""
        import numpy as np

        self.words: dict[str, int] = {}
        self.met, self.met_ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.ids, self.id_ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _occurrence(self, key, place):
        """The keys of the occurrences at places of documents. (arrays)"""
        import numpy as np

        return _mix(key + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def _variant(self, variant: int):
        import numpy as np

        return self._occurrence(np.array([self._key(None)]), np.array([variant]))

    def skipped(self, key, start, middle, end):
        """Is the candidate of [start, middle) and [middle, end) skipped in the occurrence of this key? (arrays)"""
        import numpy as np

        if not self.dropout:
            return np.zeros(np.shape(start), bool)
        place = (start.astype(np.uint64) << np.uint64(42)) | (middle.astype(np.uint64) << np.uint64(21)) | end.astype(np.uint64)
        return (_mix(key + place * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) < self.dropout * 2.0**53

    def agenda(self, word: str, variant: int = 0, key=None) -> list[int]:
        """The pieces' ids of one occurrence of a word, by the agenda; unknown characters as the unknown id."""
        key = self._variant(variant) if key is None else key
        return [s for s in self._agenda([int(self.pieces.character[ord(c)]) for c in word], int(key[0]), 0) if s >= 0]

    def _agenda(self, symbols: list[int], key: int, offset: int) -> list[int]:
        """The piece that begins at each place, or -1."""
        p, n, most, whole = self.pieces, len(symbols), self.dropout * 2.0**53, (1 << 64) - 1
        rank, pairs, size = p.rank, p.pairs, p.size
        before, after, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if j < n and (piece := pairs.get(symbols[i] * size + symbols[j])) is not None:
                heapq.heappush(heap, (int(rank[piece]), i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if symbols[i] < 0 or after[i] != j or symbols[j] < 0 or end[j] != stop:
                continue
            place = ((i + offset) << 42) | ((j + offset) << 21) | (stop + offset)
            x = (key + place * 0x9E3779B97F4A7C15) & whole
            x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & whole
            x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & whole
            if ((x ^ (x >> 31)) >> 11) < most:
                continue
            symbols[i], symbols[j] = pairs[symbols[i] * size + symbols[j]], -1
            end[i], after[i] = stop, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return symbols

    def in_step(self, words: list[str], variant: int) -> list[bytes]:
        import numpy as np

        codes, sizes = _codes(words)
        ids, n, _ = self._in_step(codes, sizes, np.repeat(self._variant(variant), len(words)), np.zeros(len(words), np.int64))
        ends = np.concatenate([[0], np.cumsum(n)]).tolist()
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:])]

    def _in_step(self, codes, sizes, key, offset):
        """``agenda`` of many words at once: each step pops every word's best candidate.

        ``codes`` holds the characters of all words in order, ``sizes`` their numbers, ``key`` the occurrences'
        keys - None: nothing is skipped, and all candidates met are given - and ``offset`` the place of each word's first
        character. Gives (ids, number of ids of each word, met: (word, start, middle, end) packed in order of words).
        """
        import numpy as np

        first = np.cumsum(sizes) - sizes
        order, counts, parts, met = np.argsort(sizes, kind="stable"), np.zeros(len(sizes), np.int64), [], []
        sorted_sizes, at = sizes[order], 0
        while at < len(order):
            cells = sorted_sizes[at + 1 :] * np.arange(2, len(order) - at + 1)
            end = at + 1 + int((cells <= np.minimum(np.maximum(CELLS, ROWS * sorted_sizes[at + 1 :]), MOST_CELLS)).sum())
            some = order[at:end]
            ids, counts[some], seen = self._step(codes, first[some], sizes[some], None if key is None else key[some], offset[some])
            parts.append(ids)
            if key is None:
                met.append((some[seen[0]], seen[1]))
            at = end
        ids = np.concatenate([np.zeros(0, "<u4"), *parts])
        n = counts[order]
        begin = np.empty(len(order), np.int64)
        begin[order] = np.cumsum(n) - n
        ids = ids[np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))]
        if key is not None:
            return ids, counts, None
        word, code = (np.concatenate([np.zeros(0, kind), *(m[k] for m in met)]) for k, kind in ((0, np.int64), (1, np.uint32)))
        by_word = np.argsort(word, kind="stable")
        return ids, counts, (np.bincount(word, minlength=len(sizes)), code[by_word])

    def _step(self, codes, first, sizes, key, offset):
        """``_in_step`` of words of like sizes, as matrices with a row for each word and a column for each place."""
        import numpy as np

        p, none, rows, width = self.pieces, np.int32(2**31 - 1), len(sizes), int(sizes.max())
        step, columns = width + 1, np.arange(width + 1)
        inside = columns[None] < sizes[:, None]
        text = codes[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        symbols = np.full((rows, step), -1, np.int32)
        symbols[inside] = p.character[text]
        symbols = symbols.reshape(-1)
        ends = np.tile((columns + 1).astype(np.int32), rows)  # of the symbol that begins at a place
        starts = np.tile((columns - 1).astype(np.int32), rows)  # of the symbol that ends at a place
        rank, piece = np.full(rows * step, none, np.int32), np.zeros(rows * step, np.int32)
        seen: list = [[], []]

        def look(row, at):
            base = row * step
            here = base + at
            middle = ends[here]
            right = symbols[base + middle]
            made = p.merged(symbols[here], right)
            made[right < 0] = -1
            fits = np.flatnonzero(made >= 0)
            rank[here] = none
            if len(fits):
                row, at, here, middle, made = row[fits], at[fits], here[fits], middle[fits], made[fits]
                stop, off = ends[base[fits] + middle], offset[row]
                if key is None:
                    seen[0].append(row)
                    seen[1].append((((at + off) << 12) | ((middle + off) << 6) | (stop + off)).astype(np.uint32))
                elif self.dropout:
                    kept = ~self.skipped(key[row], at + off, middle + off, stop + off)
                    here, made = here[kept], made[kept]
                rank[here], piece[here] = p.rank[made], made

        row, at = np.nonzero(inside)
        look(row, at)
        live = np.arange(rows)
        grid = rank.reshape(rows, step)
        while len(live):
            best = (grid if len(live) == rows else grid[live]).argmin(axis=1)
            base = live * step
            more = np.flatnonzero(rank[base + best] < none)
            if not len(more):
                break
            live, at, base = live[more], best[more], base[more]
            here = base + at
            middle = base + ends[here]
            stop = ends[middle]
            symbols[here], symbols[middle], rank[middle] = piece[here], -1, none
            ends[here], starts[base + stop] = stop, at
            look(live, at)
            later = np.flatnonzero(at > 0)
            look(live[later], starts[here[later]])
        found = symbols >= 0
        ids, n = symbols[found], found.reshape(rows, step).sum(axis=1)
        odd = np.flatnonzero(ids == p.unknown)
        if len(odd):  # characters without a piece become bytes
            place = np.flatnonzero(found)[odd]
            row = place // step
            code = codes[first[row] + place - row * step].astype(np.int64)
            code[code == OWN_MARK] = ord(MARK)
            size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            times = np.ones(len(ids), np.int64)
            times[odd] = size
            n = n + np.bincount(row, size - 1, rows).astype(np.int64)
            ids = np.repeat(ids, times)
            head = np.repeat(np.cumsum(times)[odd] - size, size)
            nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            code, size = np.repeat(code, size), np.repeat(size, size)
            byte = np.where(nth == 0, np.where(size == 1, code, (0xF00 >> size & 0xFF) | code >> 6 * (size - 1)), 0x80 | code >> 6 * (size - 1 - nth) & 0x3F)
            ids[head + nth] = p.byte[byte]
        row = np.concatenate([np.zeros(0, np.int64), *seen[0]])
        return ids.astype("<u4"), n, (row, np.concatenate([np.zeros(0, np.uint32), *seen[1]]))

    def _bytes(self, word: str, ids: list[int]) -> bytes:
        import numpy as np

        p = self.pieces
        if p.unknown in ids:
            given, full, at = iter(ids), [], 0
            for i in given:
                if i == p.unknown:
                    full += [int(p.byte[b]) for b in word[at].encode("utf-8", "surrogatepass")]
                    at += 1
                else:
                    full.append(i)
                    at += len(p.raw[i].decode())
            ids = full
        return np.array(ids, "<u4").tobytes()

    def _known(self, words: list[str], codes, sizes):
        """The numbers of words among those kept; -1 for long ones."""
        import numpy as np

        if len(self.words) > CACHE_WORDS:
            self._forget()
        new = [k for k, w in enumerate(words) if sizes[k] <= SHORT and w not in self.words]
        if new:
            first, pick = np.cumsum(sizes) - sizes, np.array(new)
            n = sizes[pick]
            ids, each, (n_met, met) = self._in_step(codes[np.repeat(first[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n, None, _offsets(codes, first[pick]))
            self.words.update(zip([words[k] for k in new], range(len(self.words), len(self.words) + len(new))))
            self.met, self.met_ends = np.concatenate([self.met, met]), np.concatenate([self.met_ends, self.met_ends[-1] + np.cumsum(n_met)])
            self.ids, self.id_ends = np.concatenate([self.ids, ids]), np.concatenate([self.id_ends, self.id_ends[-1] + np.cumsum(each)])
        return np.array([self.words.get(w, -1) for w in words], np.int64)

    def _encoded(self, words: list[str], number, occurrence):
        """(ids of all occurrences in order, number of ids of each); an occurrence has the number of its word."""
        import numpy as np

        codes, lengths = _codes(words)
        first, known = np.cumsum(lengths) - lengths, self._known(words, codes, lengths)
        sizes, parts = [], []
        for at in range(0, len(number), OCCURRENCES):
            word, keyed = number[at : at + OCCURRENCES], occurrence[at : at + OCCURRENCES]
            node = known[word]
            own = node < 0
            if self.dropout:
                some = np.flatnonzero(~own)
                begin, n = self.met_ends[node[some]], self.met_ends[node[some] + 1] - self.met_ends[node[some]]
                row = np.repeat(some, n)
                met = self.met[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(len(row))]
                own[row[self.skipped(keyed[row], met >> 12, (met >> 6) & 63, met & 63)]] = True
            again = np.flatnonzero(own)
            ids, each = self._apart(codes, first[word[again]], lengths[word[again]], keyed[again])
            node[again] = len(self.id_ends) - 1 + np.arange(len(again))
            ends = np.concatenate([self.id_ends, self.id_ends[-1] + np.cumsum(each)])
            n = ends[node + 1] - ends[node]
            parts.append(np.concatenate([self.ids, ids])[np.repeat(ends[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            sizes.append(n)
        return np.concatenate([np.zeros(0, "<u4"), *parts]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def _apart(self, codes, first, sizes, key):
        """(ids, number of ids of each) of occurrences, each by a run of its own; long words in parts that no piece joins."""
        import numpy as np

        offset = _offsets(codes, first) if len(first) else first
        owner, begin, size = [np.flatnonzero(sizes <= SHORT)], [], []
        begin.append(first[owner[0]])
        size.append(sizes[owner[0]])
        for k in np.flatnonzero(sizes > SHORT).tolist():
            cuts = np.concatenate([[0], self.pieces.closed(codes[first[k] : first[k] + sizes[k]]), [sizes[k]]])
            owner.append(np.full(len(cuts) - 1, k))
            begin.append(first[k] + cuts[:-1])
            size.append(np.diff(cuts))
        owner, begin, size = (np.concatenate(x) for x in (owner, begin, size))
        order = np.lexsort((begin, owner))
        owner, begin, size = owner[order], begin[order], size[order]
        ahead, long = offset[owner] + begin - first[owner], np.flatnonzero(size > LONG)
        text = codes[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        if not len(long):
            ids, each, _ = self._in_step(text, size, key[owner], ahead)
            return ids, np.bincount(owner, each, len(first)).astype(np.int64)
        short = np.flatnonzero(size <= LONG)
        ids, n, _ = self._in_step(text[np.repeat(size <= LONG, size)], size[short], key[owner[short]], ahead[short])
        ends, each = np.concatenate([[0], np.cumsum(n)]), np.zeros(len(size), np.int64)
        each[short] = n
        blobs: dict[int, object] = dict(zip(short.tolist(), (ids[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist()))))
        for k in long.tolist():
            part = codes[begin[k] : begin[k] + size[k]]
            found = [s for s in self._agenda(self.pieces.character[part].tolist(), int(key[owner[k]]), int(ahead[k])) if s >= 0]
            blobs[k] = np.frombuffer(self._bytes("".join(map(chr, part.tolist())).replace(chr(OWN_MARK), MARK), found), "<u4")
            each[k] = len(blobs[k])
        return np.concatenate([blobs[k] for k in range(len(size))]), np.bincount(owner, each, len(first)).astype(np.int64)

    def _key(self, document):
        import numpy as np
        import xxhash

        return np.uint64(xxhash.xxh64_intdigest(str(document), seed=self.seed & (2**64 - 1)))

    def encode_all(self, documents, texts):
        """The ids of each text of an Arrow string array, in order; ``documents`` are their ids."""
        import pyarrow.compute as pc

        texts = texts.fill_null("")
        sizes, at = pc.binary_length(texts).to_pylist(), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size < BATCH_BYTES or end == at):
                size += sizes[end]
                end += 1
            yield from self._encode(documents[at:end], texts.slice(at, end - at))
            at = end

    def encode(self, text: str, document: int | None = None) -> bytes:
        import pyarrow as pa

        return next(self.encode_all([document], pa.array([text], pa.string())))

    def _encode(self, documents, texts):
        import numpy as np
        import pyarrow.compute as pc

        unusual = pc.match_substring_regex(texts, UNUSUAL)
        plain, flags = texts.filter(pc.invert(unusual)), unusual.to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        sizes = np.zeros(len(texts), np.int64)
        sizes[~flags] = np.diff(split.offsets.to_numpy())
        numbered = split.flatten().dictionary_encode()
        words = [w if w[:1] == "\n" else MARK + w for w in numbered.dictionary.to_pylist()]
        number, order = [numbered.indices.to_numpy().astype(np.int64)], np.concatenate([np.flatnonzero(~flags), np.flatnonzero(flags)])
        names: dict[str, int] = {}
        for k in np.flatnonzero(flags).tolist():
            text = texts[k].as_py()
            units = self._units(text) if text else []
            sizes[k] = len(units)
            number.append(np.fromiter((names.setdefault(u, len(words) + len(names)) for u in units), np.int64, len(units)))
        sizes = sizes[order]
        keys = np.array([self._key(documents[k]) for k in order.tolist()], np.uint64)
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids, each = self._encoded(words + list(names), np.concatenate(number), self._occurrence(np.repeat(keys, sizes), place))
        raw, before = memoryview(ids.tobytes()), 4 * np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(sizes)])]
        out = [b""] * len(texts)
        for k, a, b in zip(order.tolist(), before.tolist(), before[1:].tolist()):
            out[k] = bytes(raw[a:b])
        yield from out

    @staticmethod
    def _units(text: str) -> list[str]:
        """Words with the marks before them; a line feed, and a mark of the text's own, for itself."""
        units: list[str] = []
        for n, part in enumerate(text.split(MARK)):
            if n:
                units.append(chr(OWN_MARK))
            for k, line in enumerate(part.split("\n")):
                if k:
                    units.append("\n")
                units += UNIT.findall((line if n or k else " " + line).replace(" ", MARK))
        return units

    def decode(self, ids: bytes) -> str:
        import numpy as np

        raw = self.pieces.raw
        return b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()])[1:].decode("utf-8", "surrogatepass")


@functools.lru_cache(maxsize=2)
def encoder(path: str | None, dropout: float, seed: int) -> Encoder:
    """The encoder of this worker process, whose words outlive a task."""
    return Encoder(path, dropout, seed)


def encode_documents(docs: DataFrame, dropout: float = DROPOUT, seed: int = SEED, model: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_tokens, ids_crc32, lossless - and the ids, on request."""

    def encode(batches):
        import pyarrow as pa

        coder = encoder(model, dropout, seed)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            n, crc, same, blobs = [], [], [], []
            for text, blob in zip(texts, coder.encode_all(ids, texts)):
                n.append(len(blob) // 4)
                crc.append(zlib.crc32(blob))
                same.append(coder.decode(blob) == (text.as_py() or ""))
                if with_ids:
                    blobs.append(blob)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            names = ["doc_id", "n_tokens", "ids_crc32", "lossless"]
            if with_ids:
                columns, names = [*columns, pa.array(blobs, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, ENCODED + (", ids binary" if with_ids else ""))


def decode_documents(encoded: DataFrame, dropout: float = DROPOUT, seed: int = SEED, model: str | None = None) -> DataFrame:
    """(doc_id, text) of rows with doc_id and ids."""

    def decode(batches):
        import pyarrow as pa

        coder = encoder(model, dropout, seed)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(b.as_py() or b"") for b in batch.column(1)], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id bigint, text string")
