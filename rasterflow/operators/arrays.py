"""Entropy coding on whole arrays, for Arrow batches: tokens of blocks, bit strings, prefix codes."""

from __future__ import annotations


def block_tokens(zz):
    """Tokens of blocks [n, 64] in zig-zag order whose first value is the DC difference.

    Arrays (block, tok_idx, run, size, bits), in order: the DC difference, the other values with the zeros before
    them (a token (15, 0) for each sixteen), and a token (0, 0) where zeros are last.
    """
    import numpy as np

    zz = np.asarray(zz, np.int64)
    held = zz != 0
    held[:, 0] = True
    block, place = np.nonzero(held)
    value = zz[block, place]
    first = place == 0
    run = np.where(first, 0, place - np.concatenate([[0], place[:-1]])[: len(place)] - 1)
    skips, run = run // 16, run % 16
    last = np.concatenate([first[1:], [True]])[: len(place)]
    times = skips + 1 + (last & (place < 63))
    entry = np.repeat(np.arange(len(place)), times)
    nth = np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)
    own, long = nth == skips[entry], nth < skips[entry]
    size = np.frexp(np.abs(value).astype(np.float64))[1].astype(np.int64)
    bits = np.where(value >= 0, value, value + (1 << size) - 1)
    block = block[entry]
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(block)), bool), block[1:] != block[:-1]]))
    tok_idx = np.arange(len(block)) - np.repeat(begin, np.diff(np.append(begin, len(block))))
    return block, tok_idx, np.where(own, run[entry], np.where(long, 15, 0)), np.where(own, size[entry], 0), np.where(own, bits[entry], 0)


def bit_string(words, sizes, pad_ones: bool = True) -> bytes:
    """Words of up to 32 bits one after the other, the first bit highest, filled up to a whole byte."""
    import numpy as np

    words, sizes = words[sizes > 0].astype(np.int64), sizes[sizes > 0].astype(np.int64)
    if not len(words):
        return b""
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    pad = -total % 8
    words[-1] = (words[-1] << pad) | ((1 << pad) - 1 if pad_ones else 0)
    sizes[-1] += pad
    start = ends - np.append(sizes[:-1], sizes[-1] - pad)
    shifted = words << (40 - start % 8 - sizes)
    out = np.zeros((total + pad) // 8 + 5)
    for k in range(5):  # no two words share a bit, so sums are unions
        part = shifted >> (32 - 8 * k) & 0xFF
        some = np.flatnonzero(part)
        out += np.bincount(start[some] // 8 + k, part[some], len(out))
    return out[: (total + pad) // 8].astype(np.uint8).tobytes()


def decode_bits(raw: bytes, codes: list[tuple[int, int, int]], limit: int | None = None):
    """Symbols of a prefix code (symbol, length, code) in ``raw``, as an array; bits that end no code are padding.

    A table says for all next bits what symbol they begin with, and so where the symbol after it begins, for every
    place at once; then only the places are followed.
    """
    import numpy as np

    if not raw or not codes or limit == 0:
        return np.zeros(0, np.int64)
    longest = max(length for _, length, _ in codes)
    symbol_of, length_of = np.zeros(1 << longest, np.int64), np.zeros(1 << longest, np.int64)
    for symbol, length, code in codes:
        some = slice(code << (longest - length), (code + 1) << (longest - length))
        symbol_of[some], length_of[some] = symbol, length
    b = np.concatenate([np.frombuffer(raw, np.uint8), np.zeros(3, np.uint8)]).astype(np.int64)
    n = 8 * len(raw)
    place = np.arange(n)
    at = place >> 3
    window = ((b[at] << 16 | b[at + 1] << 8 | b[at + 2]) >> (24 - longest - (place & 7))) & ((1 << longest) - 1)
    step = length_of[window]
    after = np.where(step > 0, place + step, n + 1).tolist()
    starts, p, most = [], 0, n if limit is None else limit
    while p < n and len(starts) < most:
        if after[p] > n:
            if not step[p] and n - p > 16:
                raise ValueError("bits are no code")
            break
        starts.append(p)
        p = after[p]
    return symbol_of[window[np.array(starts, np.int64)]]
