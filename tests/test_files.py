import random
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from jpeg_decoder import decode

import rasterflow
from rasterflow import cli
from rasterflow.functions.tables import ZIGZAG
from rasterflow.operators import jpeg
from rasterflow.plans import fused
from rasterflow.sources import ppm
from rasterflow.sources.jpeg import file_name
from rasterflow.streaming.encode import encode_stream, read_stream

SMALL = b"P3\n2 2\n255\n0 0 255  0 255 0\n255 255 0  255 0 255\n"


def image(width, height, color):
    body = "\n".join(" ".join(str(min(255, max(0, int(c)))) for c in color(x, y)) for y in range(height) for x in range(width))
    return f"P3 # an image\n{width} {height}\n255\n{body}\n".encode()


RNG = random.Random(2)
FILES = {
    "one": image(7, 17, lambda x, y: (217, 233, 255)),
    "slope": image(33, 20, lambda x, y: (x * 7, y * 9, (x * y) % 256)),
    "noise": image(16, 16, lambda x, y: [RNG.randrange(256) for _ in range(3)]),
    "small": SMALL,
}
FAULTS = {
    b"": "missing token: header version",
    b"P6 1 1 255": "missing token: P3",
    b"P3": "missing token: width",
    b"P3 1": "missing token: height",
    b"P3 1 1": "missing token: max value",
    b"P3 -1 1 255 0 0 0": "token can't be parsed: width",
    b"P3 1 65536 255 0 0 0": "token can't be parsed: height",
    b"P3 1 1 255 0 x 0": "token can't be parsed: color value",
    b"P3 1 1 255 0 0": "incomplete pixel: 2",
    b"P3 2 1 255 0 0 0": "size in header and number of values differ",
    b"P3 0 1 255": "empty image",
    b"P3 1 1 0 0 0 0": "max value is zero",
    b"P3 1 1 9 1 2 10": "color value is over the max value",
}


def table(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content binary")


def test_parse_tokens_and_comments(spark):
    files = {"a": b"P3\n3 2\n255\n1 2 3 4 5 6 7 8 9\n1 2 3 4 5 6 7 8 9\n", "b": b"P3 +1 1 1#c\n00 1 2 3#end", "c": b"P#x\n3\f1\r1 7 1 2 3 "}
    got = {r.image_id: r for r in ppm.parse(table(spark, files)).collect()}
    assert got["a"]["values"] == [1, 2, 3, 4, 5, 6, 7, 8, 9] * 2 and got["a"].error is None
    assert got["b"].max_value == 100 and got["b"].width == 1 and got["b"]["values"] == [1, 2, 3]
    assert got["c"]["values"] == [1, 2, 3]
    for k, raw in files.items():
        *head, values, error = fused.parse_bytes(raw)
        assert (*head, values.tolist(), error) == (got[k].width, got[k].height, got[k].max_value, got[k]["values"], None)


def test_parse_faults(spark):
    files = {str(k): raw for k, raw in enumerate(FAULTS)}
    got = {r.image_id: r for r in ppm.parse(table(spark, files)).collect()}
    for k, (raw, error) in enumerate(FAULTS.items()):
        assert got[str(k)].error == error == fused.parse_bytes(raw)[4]
        assert got[str(k)]["values"] is None
    assert ppm.pixels_of(ppm.parse(table(spark, files))).count() == 0


@pytest.mark.parametrize("raw", [b"P3 1 1 65535 65535 0 65536", b"P3 1 1 9 1 2 99999999999999999999", b"P3 1 1 9 1 2 -1", b"P3 1 1 9 1 2 \x0b3", "P3 1 1 9 1 2 ٣".encode()])
def test_values_that_are_no_numbers(raw):
    assert ppm.parse_bytes(raw)[3:] == (None, "token can't be parsed: color value")


def test_numbers_with_signs_and_zeros():
    assert ppm.parse_bytes(b"P3 1 1 65535 +1 000000000000000000000000000065535 " + b"0" * 5000)[3].tolist() == [1, 65535, 0]


def test_a_large_file_takes_time_in_proportion(spark):
    side = 1000
    raw = b"P3\n%d %d\n255\n" % (side, side) + b"1 20 255\n" * (side * side)
    start = time.perf_counter()
    rows = ppm.pixels_of(ppm.parse(table(spark, {"big": raw}))).selectExpr("count(*)", "sum(x)", "sum(y)", "sum(r + g + b)").first()
    assert tuple(rows) == (side**2, side**2 * (side - 1) // 2, side**2 * (side - 1) // 2, 276 * side**2)
    assert time.perf_counter() - start < 60


def test_ppm_round_trip(spark):
    parsed = ppm.parse(table(spark, FILES))
    again = ppm.parse(ppm.to_ppm(ppm.pixels_of(parsed), parsed).withColumnRenamed("image_id", "path"))
    assert {r.image_id: r["values"] for r in parsed.collect()} == {r.image_id: r["values"] for r in again.collect()}


@pytest.mark.parametrize("preset", ["P444", "P422", "P420"])
def test_both_plans_give_the_same_files(spark, preset):
    files = table(spark, FILES)
    parsed = ppm.parse(files)
    relational = {r.image_id: bytes(r.content) for r in jpeg.encode(ppm.pixels_of(parsed), parsed, preset).collect()}
    plain = {r.image_id: bytes(r.content) for r in fused.encode_files(files, preset).collect()}
    assert relational == plain and len(plain) == len(FILES)


@pytest.mark.parametrize("preset", ["P444", "P422", "P420"])
@pytest.mark.parametrize("name", list(FILES))
def test_decoded_again(preset, name):
    width, height, maximum, values, _ = ppm.parse_bytes(FILES[name])
    w, h, planes = decode(fused.encode_pixels(width, height, maximum, values, preset, "A-visual-detection-model", strict_ids=True))
    assert (w, h) == (width, height)
    rgb = np.array(values, float).reshape(height, width, 3)
    luma = rgb @ [0.299, 0.587, 0.114]
    assert np.abs(planes[0][:height, :width] + 128 - luma).mean() < 8


def test_segments(spark):
    def raw(column):
        return bytes.fromhex(spark.range(1).select(column).first()[0])

    from pyspark.sql import functions as F

    # fixed values: the segments of an image of 0 by 0, and of the luma table
    assert raw(jpeg.app0()) == b"\xff\xe0\x00\x10JFIF\0\x01\x02\x00\x00\x48\x00\x48\x00\x00"
    assert raw(jpeg.sof0(F.lit(258), F.lit(3), "P444")) == bytes([0xFF, 0xC0, 0, 0x11, 8, 0, 3, 1, 2, 3, 1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1])
    assert raw(jpeg.sos()) == bytes([0xFF, 0xDA, 0, 0x0C, 3, 1, 1, 2, 0x23, 3, 0x23, 0, 0x3F, 0])
    found = raw(jpeg.dqt(2, list(range(64))))
    assert found[:5] == bytes([0xFF, 0xDB, 0, 0x43, 2]) and list(found[5:]) == ZIGZAG


def test_names():
    assert file_name("7") == "7.jpeg" and file_name("file:/a/b/c.ppm").startswith("c-") and "/" not in file_name("a b/ü?")
    ids = ["/a/x.ppm", "/b/x.ppm", "x", "x.ppm", "x.txt", "/a/x", "", "/", "é", "e"]
    assert len({file_name(i) for i in ids}) == len(ids)


def test_ppm_format_and_jpeg_sink(spark, tmp_path):
    for name, raw in FILES.items():
        (tmp_path / f"{name}.ppm").write_bytes(raw)
    rows = spark.read.format("ppm").load(str(tmp_path)).collect()
    assert sorted(Path(r.image_id).stem for r in rows) == sorted(FILES) and all(r.error is None for r in rows)
    out = tmp_path / "out"
    encoded = fused.encode_files(spark.read.format("binaryFile").load(str(tmp_path / "*.ppm")))
    encoded.select("image_id", "content").write.format("jpeg").mode("append").save(str(out))
    assert sorted(p.name.rpartition("-")[0] for p in out.iterdir()) == sorted(FILES)
    assert next(out.glob("small-*.jpeg")).read_bytes() == fused.encode_pixels(*ppm.parse_bytes(SMALL)[:4])


def test_sink_keeps_images_apart(spark, tmp_path):
    out = tmp_path / "out"
    rows = lambda *r: spark.createDataFrame([(i, c) for i, c in r], "image_id string, content binary").repartition(2)
    save = lambda df, mode: df.write.format("jpeg").mode(mode).save(str(out))
    files = lambda: {p.name: p.read_bytes() for p in out.iterdir()}
    save(rows(("/a/x.ppm", b"1"), ("/b/x.ppm", b"2"), ("x", b"3")), "append")
    first = {file_name("/a/x.ppm"): b"1", file_name("/b/x.ppm"): b"2", "x.jpeg": b"3"}
    assert files() == first
    for bad in (rows(("y", b"4"), ("x", b"5"), ("y", b"6")), rows(("x", b"7"), ("z", None))):
        with pytest.raises(Exception, match="several rows|no content"):
            save(bad, "append")
        assert files() == first
    (out / "kept.txt").write_text("kept")
    save(rows(("x", b"8"), ("w", b"9")), "overwrite")
    assert files() == {"x.jpeg": b"8", "w.jpeg": b"9", "kept.txt": b"kept"}


def test_source_by_folder_pattern_and_uri(spark, tmp_path):
    for name, raw in FILES.items():
        (tmp_path / f"{name}.ppm").write_bytes(raw)
    load = lambda path: sorted(Path(r.image_id).stem for r in spark.read.format("ppm").load(path).collect())
    assert load(str(tmp_path)) == load(f"file://{tmp_path}") == load(f"{tmp_path}/*.ppm") == load(f"file://{tmp_path}/*.ppm") == sorted(FILES)
    assert load(f"{tmp_path}/s*.ppm") == ["slope", "small"] and load(f"{tmp_path}/one.ppm") == ["one"]
    with pytest.raises(Exception, match="nothing"):
        load(f"{tmp_path}/nothing*")


def test_convert_files_and_folders(spark, tmp_path):
    for name, raw in {**FILES, "bad": b"P3 1"}.items():
        (tmp_path / f"{name}.ppm").write_bytes(raw)
    assert rasterflow.convert_file(spark, str(tmp_path / "small.ppm"), str(tmp_path / "deep" / "x.jpeg")) is None
    assert (tmp_path / "deep" / "x.jpeg").read_bytes() == fused.encode_pixels(*ppm.parse_bytes(SMALL)[:4])
    assert rasterflow.convert_file(spark, str(tmp_path / "bad.ppm"), str(tmp_path / "y.jpeg")) == "missing token: height"
    assert not (tmp_path / "y.jpeg").exists()
    with pytest.raises(OSError, match="can't open"):
        rasterflow.convert_file(spark, str(tmp_path / "none.ppm"), str(tmp_path / "y.jpeg"))
    with pytest.raises(OSError, match="can't write"):
        rasterflow.convert_file(spark, str(tmp_path / "small.ppm"), str(tmp_path / "small.ppm" / "y.jpeg"))
    found = rasterflow.convert_folder(spark, str(tmp_path / "*.ppm"), str(tmp_path / "all"), "P444").collect()
    assert [(Path(r.image_id).name, r.error) for r in found] == [("bad.ppm", "missing token: height")]
    assert sorted(p.name.rpartition("-")[0] for p in (tmp_path / "all").iterdir()) == sorted(FILES)


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "small.ppm").write_bytes(SMALL)
    (source / "bad.ppm").write_bytes(b"P3 1")
    q = encode_stream(read_stream(spark, str(source))).writeStream.format("memory").queryName("encoded").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = {Path(r.image_id).name: r for r in spark.table("encoded").collect()}
    assert rows["bad.ppm"].error == "missing token: height" and rows["bad.ppm"].content is None
    assert bytes(rows["small.ppm"].content) == fused.encode_pixels(*ppm.parse_bytes(SMALL)[:4])


def test_command_line_options():
    a = cli.parser().parse_args(["in", "out"])
    assert (a.bits_per_channel, a.chroma_subsampling_preset, a.quantization_table) == (8, "P420", "Specification")
    a = cli.parser().parse_args(["in", "out", "-b", "16", "-p", "P422", "-q", "7", "-t", "2"])
    assert (a.bits_per_channel, a.chroma_subsampling_preset, a.quantization_table, a.threads) == (16, "P422", "A-visual-detection-model", 2)
    for bad in (["in"], ["in", "out", "-b", "9"], ["in", "out", "-p", "P411"], ["in", "out", "-q", "none"]):
        with pytest.raises(SystemExit):
            cli.parser().parse_args(bad)


def test_single_files_and_folders(tmp_path):
    (tmp_path / "a.ppm").write_bytes(SMALL)
    single = cli.is_single
    assert single(str(tmp_path / "a.ppm"), "out") and single(f"file://{tmp_path}/a.ppm", "out") and single("s3://bucket/a.ppm", "s3://bucket/a.JPG")
    assert not single(str(tmp_path), "a.jpeg") and not single("s3://bucket/*.ppm", "a.jpeg") and not single("s3://bucket/folder", "s3://bucket/out")


def test_command_line(tmp_path):
    (tmp_path / "small.ppm").write_bytes(SMALL)
    (tmp_path / "bad.ppm").write_bytes(b"P3 1")
    run = lambda *a: subprocess.run([sys.executable, "-m", "rasterflow.cli", *a], cwd=Path(__file__).parent.parent, capture_output=True, timeout=300)
    assert run(str(tmp_path / "small.ppm"), str(tmp_path / "x.jpeg"), "-t", "2").returncode == 0
    assert (tmp_path / "x.jpeg").read_bytes() == fused.encode_pixels(*ppm.parse_bytes(SMALL)[:4])
    assert run(str(tmp_path / "bad.ppm"), str(tmp_path / "y.jpeg"), "-t", "2").returncode == 1
    assert not (tmp_path / "y.jpeg").exists()
    gone = run(str(tmp_path / "none.ppm"), str(tmp_path / "z.jpeg"), "-t", "2")
    assert gone.returncode == 1 and b"can't open" in gone.stderr and b"Traceback" not in gone.stderr
    both = run(str(tmp_path / "*.ppm"), str(tmp_path / "out"), "-t", "2")
    assert both.returncode == 1 and b"missing token: height" in both.stderr and len(list((tmp_path / "out").iterdir())) == 1
