"""A small baseline decoder, by the standard, to hold files against."""

import numpy as np

from rasterflow.functions.tables import ZIGZAG
from rasterflow.operators.transform import idct_blocks


def decode(raw: bytes):
    """(width, height, luma plane shifted by 128) and the two chroma planes at their own size."""
    at, tables, codes = 2, {}, {}
    assert raw[:2] == b"\xff\xd8" and raw[-2:] == b"\xff\xd9"
    while True:
        marker, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body = raw[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            table = np.zeros(64)
            table[ZIGZAG] = list(body[1:65])
            tables[body[0]] = table
        elif marker == 0xC4:
            symbols, code, found = iter(body[17:]), 0, {}
            for length, n in enumerate(body[1:17], 1):
                for _ in range(n):
                    found[length, code] = next(symbols)
                    code += 1
                code <<= 1
            codes[body[0]] = found
        elif marker == 0xC0:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [(body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 15, 3)]
        elif marker == 0xDA:
            use = [(body[k + 1] >> 4, body[k + 1] & 15) for k in (1, 3, 5)]
            break
    bits = "".join(format(b, "08b") for b in raw[at:-2].replace(b"\xff\x00", b"\xff"))
    place = 0

    def symbol(table):
        nonlocal place
        word = 0
        for n in range(1, 17):
            word = word << 1 | int(bits[place + n - 1])
            if (n, word) in table:
                place += n
                return table[n, word]
        raise ValueError("no code")

    def number(n):
        nonlocal place
        if not n:
            return 0
        v = int(bits[place : place + n], 2)
        place += n
        return v if v >> (n - 1) else v - (1 << n) + 1

    h, v = parts[0][:2]
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    planes = [np.zeros((down * 8 * q, across * 8 * p)) for p, q, _ in parts]
    last = [0, 0, 0]
    for unit in range(across * down):
        for c, (p, q, table) in enumerate(parts):
            dc, ac = codes[use[c][0]], codes[0x10 | use[c][1]]
            for k in range(p * q):
                values = np.zeros(64)
                last[c] += number(symbol(dc))
                values[0], i = last[c], 1
                while i < 64:
                    s = symbol(ac)
                    if s == 0:
                        break
                    i += s >> 4
                    values[ZIGZAG[i]] = number(s & 15)
                    i += 1
                block = idct_blocks((values * tables[table]).reshape(1, 8, 8))[0]
                y, x = (unit // across * q + k // p) * 8, (unit % across * p + k % p) * 8
                planes[c][y : y + 8, x : x + 8] = block
    assert set(bits[place:]) <= {"1"} and len(bits) - place < 8
    return width, height, planes
