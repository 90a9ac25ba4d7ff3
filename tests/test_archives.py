"""Archives written by many tasks, read by the standard library."""

import json
import random
import zipfile
import zlib
from pathlib import Path

from pagelattice.operators import tables
from pagelattice.sources import archives


def opened(folder, manifest):
    out = {}
    for r in manifest.collect():
        path = Path(folder) / r["file"]
        assert path.stat().st_size == r["bytes"]
        with zipfile.ZipFile(path) as z:
            assert z.testzip() is None and len(z.namelist()) == r["entries"]
            out[r["bundle"]] = {n: z.read(n) for n in z.namelist()}
    return out


def test_crc_of_both():
    r = random.Random(1)
    for _ in range(200):
        a, b = r.randbytes(r.randint(0, 50)), r.randbytes(r.choice([0, 1, 5, 1000]))
        assert archives.crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_entries_of_many_pieces_and_bundles(spark, tmp_path):
    r = random.Random(2)
    rows = [(k % 3, f"a/é{k % 40}.bin", k, bytearray(r.randbytes(r.choice([0, 3, 2000])))) for k in range(600)]
    rows += [(9, "empty", 0, None), (None, "lost", 0, bytearray(b"x")), (9, None, 0, bytearray(b"x")), (9, "twice", 1, bytearray(b"b")), (9, "twice", 1, bytearray(b"b"))]
    wanted = {}
    for b, n, _, c in sorted((x for x in rows if x[0] is not None and x[1] is not None), key=lambda x: x[2]):
        wanted.setdefault(b, {}).setdefault(n, bytearray()).extend(c or b"")
    df = spark.createDataFrame(rows, "bundle long, name string, piece long, content binary").repartition(5)
    folder = tmp_path / "out"
    manifest = archives.write(df, f"file://{folder}")
    got = opened(folder, manifest)
    assert got == {b: {n: bytes(c) for n, c in e.items()} for b, e in wanted.items()}
    read = {(x["bundle"], x["name"]): bytes(x["content"]) for x in archives.read(manifest, f"file://{folder}").collect()}
    assert read == {(b, n): c for b, e in got.items() for n, c in e.items()}
    assert not list(folder.glob(".*.part")) and not (folder / "segments").exists()
    assert archives.write(df.limit(0), f"file://{tmp_path}/none").collect() == []


def test_more_entries_than_a_short_directory_counts(spark, tmp_path):
    rows = spark.range(70_000).selectExpr("1L AS bundle", "concat('n', id) AS name", "0L AS piece", "CAST(CAST(id AS string) AS binary) AS content")
    manifest = archives.write(rows, f"file://{tmp_path}/out")
    with zipfile.ZipFile(tmp_path / "out" / manifest.first()["file"]) as z:
        assert len(z.namelist()) == 70_000 and z.read("n69999") == b"69999"


def test_places_beyond_four_gigabytes():
    extra = archives.directory_entry(b"n", 1, 2, 3, 5 << 32)[46 + 1 :]
    assert extra == b"\x01\x00\x08\x00" + (5 << 32).to_bytes(8, "little")


def test_datasets(spark, tmp_path):
    lines = spark.createDataFrame([(7, "7_p1", 1, "0 a"), (7, "7_p1", 0, "1 b"), (8, "8_p1", 0, "2 c")], "page long, stem string, idx int, line string")
    images = spark.createDataFrame([(7, "7_p1.jpg", bytearray(b"\xff\xd8")), (99, "no.jpg", bytearray(b"x"))], "page long, name string, content binary")
    got = opened(tmp_path / "y", archives.write(archives.label_pieces(lines, images, 1), f"file://{tmp_path}/y"))
    assert got[0]["labels/7_p1.txt"] == b"1 b\n0 a\n" and got[0]["images/7_p1.jpg"] == b"\xff\xd8"
    assert sorted(got[1]) == ["README.md", "data.yaml", "labels/8_p1.txt"]
    t = spark.createDataFrame([(k, [0, 10, 20], [0, 30], 1, 30, 20) for k in range(1, 8)], "table_id long, rb array<int>, cb array<int>, header_rows int, crop_w int, crop_h int")
    got = opened(tmp_path / "c", archives.write(archives.annotation_pieces(tables.annotations(t), 5, 2), f"file://{tmp_path}/c"))
    made = [json.loads(got[b]["annotations.json"]) for b in (0, 1)]
    assert [[i["id"] for i in m["images"]] for m in made] == [[1, 2, 3, 4, 5], [6, 7]]
    assert [a["category_id"] for a in made[0]["annotations"]] == [1, 2, 3, 4] * 5 and [a["id"] for a in made[1]["annotations"]] == list(range(21, 29))
    assert made[0]["images"][0]["width"] == 30 and [c["id"] for c in made[0]["categories"]] == [1, 2, 3, 4]
