"""PPM to JPEG in one narrow pass: each file is encoded where it is read, without a shuffle.

The relational operators answer questions about every step; this plan is for
throughput over many images. Both give the same bytes. A task holds one image at a time.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterflow.functions.tables import ZIGZAG, quantization_pair, subsampling
from rasterflow.operators.arrays import bit_string, block_tokens
from rasterflow.operators.jpeg import STRICT_ORDER, TABLE_ORDER
from rasterflow.operators.transform import dct_blocks
from rasterflow.sources.ppm import parse_bytes


def package_lengths(freqs: list[int], limit: int) -> list[int]:
    """Code lengths of ascending frequencies by package-merge."""
    if len(freqs) > 1 << limit:
        raise ValueError(f"a code of depth {limit} can't hold {len(freqs)} symbols")
    levels = [[(f, 0) for f in freqs]]
    for _ in range(limit - 1):
        last = levels[-1]
        levels.append(sorted(levels[0] + [(a[0] + b[0], 1) for a, b in zip(last[::2], last[1::2])]))
    lengths, n = [0] * len(freqs), len(freqs) - 1
    for level in reversed(levels):
        taken = level[: 2 * n]
        n = sum(kind for _, kind in taken)
        for i in range(len(taken) - n):
            lengths[i] += 1
    return lengths


def code_table(counts: Counter, limit: int = 15) -> list[tuple[int, int, int]]:
    """(symbol, length, code), most frequent first; the least frequent one's is longer by one."""
    order = sorted(counts, key=lambda s: (counts[s], s))
    lengths = package_lengths([counts[s] for s in order], limit)
    if lengths:
        lengths[0] += 1
    table, start = [], 0
    for symbol, length in zip(reversed(order), reversed(lengths)):
        table.append((symbol, length, start >> (16 - length)))
        start += 1 << (16 - length)
    return table


def encode_pixels(width: int, height: int, maximum: int, values, preset: str = "P420", table: str = "Specification", algorithm: str = "fast", bits_per_channel: int = 8, strict_ids: bool = False) -> bytes:
    """One image's components, pixel by pixel, as a JPEG file."""
    import numpy as np

    h, v, method = subsampling(preset)
    f = np.float32
    pw, ph = -(-width // (8 * h)) * 8 * h, -(-height // (8 * v)) * 8 * v
    rgb = np.zeros((ph, pw, 3), f)
    rgb[:height, :width] = np.asarray(values, f).reshape(height, width, 3) / f(maximum)
    r, g, b = (rgb[..., k] for k in range(3))
    weigh = lambda w: r * f(w[0]) + g * f(w[1]) + b * f(w[2])
    from rasterflow.functions.color import CHROMA_BLUE, CHROMA_RED, LUMA

    planes = [(weigh(LUMA) - f(128) / f(255)) * f(255), weigh(CHROMA_BLUE) * f(255), weigh(CHROMA_RED) * f(255)]
    parts, k = [], h * v
    for channel, plane in enumerate(planes):
        if channel and method == "average":
            total = None
            for i in range(h):
                for j in range(v):
                    part = plane[j::v, i::h]
                    total = part if total is None else total + part
            plane = total / f(h * v)
        rows, columns = plane.shape[0] // 8, plane.shape[1] // 8
        blocks = plane.reshape(rows, 8, columns, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        q = np.array(quantization_pair(table)[channel > 0], f).reshape(8, 8)
        ratio = dct_blocks(blocks, algorithm) / q
        levels = (np.sign(ratio) * np.floor(np.abs(ratio.astype(np.float64)) + 0.5)).astype(np.int64).reshape(-1, 64)
        if not channel and v == 2:
            levels = levels.reshape(rows // 2, 2, columns // 2, 2, 64).swapaxes(1, 2).reshape(-1, 64)
        zz = levels[:, ZIGZAG]
        zz[:, 0] = np.diff(zz[:, 0], prepend=0)
        block, at, run, size, bits = block_tokens(zz)
        place = block + block // k * 2 if not channel else block * (k + 2) + k + channel - 1  # of the block in the scan
        parts.append((place, np.where(at > 0, 1, 0) + (2 if channel else 0), run << 4 | size, size, bits))
    place, cls, symbol, size, bits = (np.concatenate(x) for x in zip(*parts))
    counts = np.bincount(cls << 8 | symbol, minlength=1024).reshape(4, 256)
    tables = [code_table(Counter({int(s): int(c[s]) for s in np.flatnonzero(c)})) for c in counts]
    words, lengths = np.zeros((2, 4, 256), np.int64)
    for c, made in enumerate(tables):
        for s, n, code in made:
            words[c, s], lengths[c, s] = code, n
    order = np.argsort(place, kind="stable")
    cls, symbol, size, bits = cls[order], symbol[order], size[order], bits[order]
    scan = bit_string(words[cls, symbol] << size | bits, lengths[cls, symbol] + size).replace(b"\xff", b"\xff\x00")
    part = lambda marker, content: bytes([0xFF, marker]) + (len(content) + 2).to_bytes(2, "big") + content
    luma, chroma = quantization_pair(table)
    out = [b"\xff\xd8", part(0xE0, b"JFIF\0\x01\x02\0\0\x48\0\x48\0\0")]
    out += [part(0xDB, bytes([n, *(t[p] for p in ZIGZAG)])) for n, t in enumerate((luma, chroma))]
    out.append(part(0xC0, bytes([bits_per_channel]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, h << 4 | v, 0, 2, 0x11, 1, 3, 0x11, 1])))
    for cls, number in STRICT_ORDER if strict_ids else TABLE_ORDER:
        sizes = Counter(n for _, n, _ in tables[cls])
        out.append(part(0xC4, bytes([number, *(sizes[n] for n in range(1, 17)), *(s for s, _, _ in tables[cls])])))
    ids = (0, 0x11) if strict_ids else (1, 0x23)
    out.append(part(0xDA, bytes([3, 1, ids[0], 2, ids[1], 3, ids[1], 0, 63, 0])))
    return b"".join([*out, scan, b"\xff\xd9"])


def encode_files(files: DataFrame, preset: str = "P420", table: str = "Specification", algorithm: str = "fast", bits_per_channel: int = 8, strict_ids: bool = False, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """(image_id, content, error): PPM files (id, content) as JPEG files."""
    subsampling(preset), quantization_pair(table)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                width, height, maximum, values, error = parse_bytes(batch.column(1)[k].as_py() or b"")
                content = None if error else encode_pixels(width, height, maximum, values, preset, table, algorithm, bits_per_channel, strict_ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([content], pa.binary()), pa.array([error], pa.string())], ["image_id", "content", "error"])

    rows = files.select(F.col(id_col).cast("string").alias("image_id"), F.col(content_col).alias("content"))
    return rows.mapInArrow(run, "image_id string, content binary, error string")
