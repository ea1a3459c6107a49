"""Plain-text PPM (P3) images: parser, writer and the ``ppm`` data source.

A file with a fault gives one image row with an error and no pixels.
"""

from __future__ import annotations

import re
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PARTS = ("header version", "width", "height", "max value")
PARSED = "width int, height int, max_value int, values array<int>, error string"
#: Pixels of a batch of rows.
PIXELS = 1 << 18


def parse(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """(image_id, width, height, max_value, values, error) of files (id, content).

    values has the components in order, or is null where there is an error. Each file is read once, in one pass of
    Arrow batches whose time is in proportion to its bytes.
    """
    rows = files.select(F.col(id_col).alias("image_id"), F.col(content_col).alias("content"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                width, height, maximum, values, error = parse_bytes(batch.column(1)[k].as_py() or b"")
                whole = [pa.array([x], pa.int32()) for x in (width, height, maximum)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *whole, pa.array([values], pa.list_(pa.int32())), pa.array([error], pa.string())], ["image_id", "width", "height", "max_value", "values", "error"])

    return rows.mapInArrow(run, f"image_id {rows.schema['image_id'].dataType.simpleString()}, {PARSED}")


def pixels_of(parsed: DataFrame) -> DataFrame:
    """(image_id, x, y, r, g, b) of parsed files without errors."""
    rows = parsed.where("error is null").select("image_id", "width", "values")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                width, rgb = batch.column(1)[k].as_py(), batch.column(2)[k].values.to_numpy().reshape(-1, 3)
                for at in range(0, len(rgb), PIXELS):
                    some = rgb[at : at + PIXELS]
                    p = np.arange(at, at + len(some))
                    columns = [batch.column(0).take(pa.array(np.full(len(some), k))), *(pa.array(x.astype(np.int32)) for x in (p % width, p // width, *some.T))]
                    yield pa.RecordBatch.from_arrays(columns, ["image_id", "x", "y", "r", "g", "b"])

    return rows.mapInArrow(run, f"image_id {parsed.schema['image_id'].dataType.simpleString()}, x int, y int, r int, g int, b int")


def read_ppm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(images, pixels) of PPM files; Spark's own reader lists and reads them from any store."""
    parsed = parse(spark.read.format("binaryFile").load(path))
    return parsed.drop("values"), pixels_of(parsed)


def to_ppm(pixels: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, content): pixels as PPM text."""
    lines = pixels.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b"))).alias("p"))
    text = F.array_join(F.transform("p", lambda p: F.concat_ws(" ", p["r"], p["g"], p["b"])), "\n")
    head = F.concat_ws("\n", F.lit("P3"), F.concat_ws(" ", "width", "height"), F.col("max_value").cast("string"))
    return lines.join(images, "image_id").select("image_id", F.encode(F.concat(head, F.lit("\n"), text, F.lit("\n")), "ISO-8859-1").alias("content"))


class PPMDataSource(DataSource):
    """``spark.read.format("ppm").load(path)``: one row for each file; ``path``, a file, folder or pattern, may be a URI of a store that Arrow knows.

    For stores that only Spark reads, use ``read_ppm``.
    """

    @classmethod
    def name(cls) -> str:
        return "ppm"

    def schema(self) -> str:
        return "image_id string, width int, height int, max_value int, values array<int>, error string"

    def reader(self, schema) -> DataSourceReader:
        return PPMReader(self.options)


class PPMReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        from pyarrow import fs

        system, path = _store(self.options["path"])
        folder = re.split(r"[*?\[]", path, maxsplit=1)[0].rpartition("/")[0] if re.search(r"[*?\[]", path) else path
        about = system.get_file_info(folder)
        if about.type == fs.FileType.File:
            return [InputPartition(path)]
        found = system.get_file_info(fs.FileSelector(folder, recursive=folder != path)) if about.type == fs.FileType.Directory else []
        names = sorted(f.path for f in found if f.type == fs.FileType.File and (folder == path or PurePosixPath(f.path).full_match(path)))
        if not names:
            raise FileNotFoundError(self.options["path"])
        return [InputPartition(name) for name in names]

    def read(self, partition):
        system, _ = _store(self.options["path"])
        with system.open_input_stream(partition.value) as f:
            *head, values, error = parse_bytes(f.read())
            yield (partition.value, *head, None if values is None else values.tolist(), error)


def _store(path: str):
    """(file system, path in it) of a path or of a URI of any store that Arrow knows."""
    from pyarrow import fs

    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", path):
        scheme, _, rest = path.partition("://")
        system, _ = fs.FileSystem.from_uri(f"{scheme}://{re.split(r'[*?]', rest, maxsplit=1)[0]}")
        return system, "/" + rest.partition("/")[2] if scheme in ("file", "hdfs") else rest
    return fs.LocalFileSystem(), str(Path(path.removeprefix("file:")).absolute())


def _split(raw: bytes) -> list[bytes]:
    return [t for t in re.split(b"[ \t\n\f\r]+", raw) if t]


def _head(raw: bytes) -> tuple[list[bytes], bytes]:
    """(up to four tokens, what follows them)."""
    tokens, at = [], 0
    for found in re.finditer(b"[^ \t\n\f\r]+", raw):
        tokens.append(found.group())
        at = found.end()
        if len(tokens) == 4:
            break
    return tokens, raw[at:]


def _number(token: bytes) -> int | None:
    """A 16-bit unsigned number, or None."""
    if not re.fullmatch(rb"\+?[0-9]+", token):
        return None
    digits = token.lstrip(b"+0") or b"0"
    return int(digits) if len(digits) <= 5 and int(digits) <= 65535 else None


def parse_bytes(raw: bytes) -> tuple:
    """(width, height, max_value, values as an array, error) of one file. Time is in proportion to its bytes."""
    import numpy as np

    if b"#" in raw:
        raw = re.sub(b"#[^\n]*\n?", b"", raw)
    tokens, body = _head(raw)
    head = [_number(t) for t in tokens[1:4]] + [None] * max(0, 4 - max(1, len(tokens)))
    if not tokens:
        return (*head[:3], None, "missing token: header version")
    if tokens[0] != b"P3":
        return (*head[:3], None, "missing token: P3")
    for k, name in ((1, "width"), (2, "height"), (3, "max value")):
        if len(tokens) <= k:
            return (*head[:3], None, f"missing token: {name}")
        if head[k - 1] is None:
            return (*head[:3], None, f"token can't be parsed: {name}")
    width, height, most = head
    if re.fullmatch(rb"[0-9 \t\n\f\r]*", body) and not re.search(rb"[0-9]{6}", body):  # numbers of at most five digits
        values = np.fromstring(body, np.int32, sep=" ") if body.strip() else np.zeros(0, np.int32)
        wrong = len(values) > 0 and int(values.max()) > 65535
    else:
        found = [_number(t) for t in _split(body)]
        wrong = None in found
        values = np.zeros(0, np.int32) if wrong else np.array(found, np.int32)
    error = None
    if wrong:
        error = "token can't be parsed: color value"
    elif len(values) % 3:
        error = f"incomplete pixel: {len(values) % 3}"
    elif not width or not height:
        error = "empty image"
    elif len(values) // 3 != width * height:
        error = "size in header and number of values differ"
    elif not most:
        error = "max value is zero"
    elif values.max() > most:
        error = "color value is over the max value"
    return width, height, most, values if error is None else None, error
