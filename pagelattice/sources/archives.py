"""ZIP archives that many tasks compress: datasets as bundles of label files or of annotations.

An entry is one piece or many. Tasks compress pieces, each a run of whole deflate blocks, into segment files, whatever entry or bundle they are of, so a bundle
with one huge entry is work for many tasks. Then a task a bundle copies its segments in order, a piece at a time and without compressing
anything again, sums up offsets, and writes the central directory last. It holds the directory of its bundle in memory, no contents.

Segments have names of their own for each attempt and only finished tasks' are named; a bundle is written aside and moved, and the manifest
(bundle, file, entries, bytes), written last, names what is whole. A task that runs again leaves the same bytes.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.export import CLASSES
from ..operators.scan import scanned
from ..operators.tables import CATEGORIES
from . import store

PIECES = "bundle long, name string, piece long, segment string, at long, packed long, size long, crc long"
MANIFEST = "bundle long, file string, entries long, bytes long"
#: What ends a run of deflate blocks, and the bytes of a piece that are copied at once.
LAST_BLOCK, COPY_BYTES = b"\x03\x00", 4 << 20
#: Signature, versions, flags (sizes follow the data; names in UTF-8), method and date of entries; fixed values of the format.
FLAGS, DEFLATED, DATE = 0x0808, 8, 0x21
BIG, MANY = 0xFFFFFFFF, 0xFFFF


def _product(a: int, b: int) -> int:
    """Product of two polynomials over two elements, modulo the one of CRC-32; the highest bit is the constant term."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def crc_of_both(first: int, second: int, size: int) -> int:
    """CRC-32 of two strings one after another, from theirs and the size of the second."""
    shift, power, n = 1 << 31, 1 << 30, 8 * size
    while n:
        if n & 1:
            shift = _product(shift, power)
        power, n = _product(power, power), n >> 1
    return _product(first, shift) ^ second


def local_header(name: bytes) -> bytes:
    return struct.pack("<4s5H3L2H", b"PK\3\4", 45, FLAGS, DEFLATED, 0, DATE, 0, 0, 0, len(name), 0) + name


def descriptor(crc: int, packed: int, size: int) -> bytes:
    return struct.pack("<4sL" + ("2Q" if max(packed, size) >= BIG else "2L"), b"PK\7\10", crc, packed, size)


def directory_entry(name: bytes, crc: int, packed: int, size: int, at: int) -> bytes:
    wide = b"".join(struct.pack("<Q", v) for v in (size, packed, at) if v >= BIG)
    extra = struct.pack("<2H", 1, len(wide)) + wide if wide else b""
    head = struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45, FLAGS, DEFLATED, 0, DATE, crc, min(packed, BIG), min(size, BIG), len(name), len(extra), 0, 0, 0, 0, min(at, BIG))
    return head + name + extra


def ending(entries: int, size: int, at: int) -> bytes:
    """What follows a directory of so many entries and bytes that begins at `at`."""
    wide = b""
    if entries >= MANY or size >= BIG or at >= BIG:
        wide = struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, entries, entries, size, at) + struct.pack("<4sLQL", b"PK\6\7", 0, at + size, 1)
    return wide + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, min(entries, MANY), min(entries, MANY), min(size, BIG), min(at, BIG), 0)


def packed(pieces: DataFrame, folder: str) -> DataFrame:
    """Compresses rows (bundle, name, piece, content) into segments below folder; where each piece stands, as a written table."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(f"{root}/segments", recursive=True)
        segment, at = uuid.uuid4().hex, 0
        with files.open_output_stream(f"{root}/segments/{segment}", compression=None) as out:
            for batch in batches:
                rows = []
                for bundle, name, piece, content in batch[["bundle", "name", "piece", "content"]].itertuples(index=False):
                    content = bytes(content) if content is not None else b""
                    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
                    data = deflate.compress(content) + deflate.flush(zlib.Z_FULL_FLUSH)
                    out.write(data)
                    rows.append((bundle, name, piece, segment, at, len(data), len(content), zlib.crc32(content)))
                    at += len(data)
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    keys = ["bundle", "name", "piece"]
    chosen = pieces.select("bundle", "name", F.col("piece").cast("long").alias("piece"), F.col("content").cast("binary").alias("content"))
    dealt = chosen.where("bundle IS NOT NULL AND name IS NOT NULL").repartitionByRange(*keys, F.xxhash64("content")).sortWithinPartitions(*keys)
    table = f"{folder}/pieces"
    dealt.mapInPandas(work, PIECES).write.parquet(table)
    return pieces.sparkSession.read.schema(PIECES).parquet(table)


def write(pieces: DataFrame, folder: str) -> DataFrame:
    """Writes rows (bundle, name, piece, content) as archives below a new folder; their manifest, a written table.

    The pieces of an entry follow by number, equal ones by their contents' CRC; a null content is empty; rows without a bundle or name are left out.
    """
    placed = packed(pieces, folder)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        sources: dict = {}

        def copy(out, segment: str, at: int, size: int) -> None:
            if segment not in sources:
                for old in sources.values():
                    old.close()
                sources.clear()
                sources[segment] = files.open_input_file(f"{root}/segments/{segment}")
            source = sources[segment]
            source.seek(at)
            while size:
                data = source.read(min(size, COPY_BYTES))
                if not data:
                    raise EOFError(segment)
                out.write(data)
                size -= len(data)

        bundle = out = part = entry = None
        position, directory = 0, []

        def end_entry() -> None:
            nonlocal position, entry
            if entry is not None:
                name, crc, size, length, at = entry
                tail = LAST_BLOCK + descriptor(crc, size + len(LAST_BLOCK), length)
                out.write(tail)
                position += len(tail)
                directory.append(directory_entry(name, crc, size + len(LAST_BLOCK), length, at))
                entry = None

        def end_bundle() -> tuple:
            nonlocal position
            end_entry()
            size = sum(map(len, directory))
            for d in directory:
                out.write(d)
            tail = ending(len(directory), size, position)
            out.write(tail)
            out.close()
            name = f"bundle-{bundle:08d}.zip"
            files.move(part, f"{root}/{name}")
            return bundle, name, len(directory), position + size + len(tail)

        columns = [c.split()[0] for c in MANIFEST.split(", ")]
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                if row.bundle != bundle:
                    if bundle is not None:
                        done.append(end_bundle())
                    bundle, position, directory[:] = row.bundle, 0, []
                    part = f"{root}/.{uuid.uuid4().hex}.part"
                    out = files.open_output_stream(part, compression=None)
                name = row.name.encode()
                if entry is None or entry[0] != name:
                    end_entry()
                    entry = [name, 0, 0, 0, position]
                    out.write(local_header(name))
                    position += len(local_header(name))
                copy(out, row.segment, row.at, row.packed)
                position += row.packed
                entry[1] = crc_of_both(entry[1], row.crc, row.size) if entry[3] else row.crc
                entry[2] += row.packed
                entry[3] += row.size
            if done:
                yield pd.DataFrame(done, columns=columns)
        if bundle is not None:
            yield pd.DataFrame([end_bundle()], columns=columns)
        for source in sources.values():
            source.close()

    made = placed.repartition("bundle").sortWithinPartitions("bundle", "name", "piece", "crc").mapInPandas(join, MANIFEST)
    made.write.parquet(f"{folder}/manifest")
    store.remove(pieces.sparkSession, f"{folder}/segments")
    store.remove(pieces.sparkSession, f"{folder}/pieces")
    return pieces.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(bundle, name, content) of the archives that a manifest names, each read through its directory."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zipfile

        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for bundle, file in zip(batch["bundle"], batch["file"], strict=True):
                with files.open_input_file(f"{root}/{file}") as f, zipfile.ZipFile(f) as z:
                    rows, held = [], 0
                    for entry in z.infolist():
                        rows.append((bundle, entry.filename, z.read(entry)))
                        held += len(rows[-1][2])
                        if held > COPY_BYTES or len(rows) == 1000:
                            yield pd.DataFrame(rows, columns=["bundle", "name", "content"])
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=["bundle", "name", "content"])

    return manifest.select("bundle", "file").mapInPandas(work, "bundle long, name string, content binary")


def label_pieces(lines: DataFrame, images: DataFrame | None = None, pages_in_bundle: int = 2000) -> DataFrame:
    """Pieces of bundles of label files, in each their description: lines (page, stem, idx, line), images (page, name, content).

    Bundles hold so many pages each, in the order of page; an image of a page without labels is left out.
    """
    names = [k for k, _ in sorted(CLASSES.items(), key=lambda x: x[1])]
    about = "path: .\ntrain: images\nval: images\nnc: %d\nnames: %s\n" % (len(names), json.dumps(names))
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "\n"), F.lit("\n"))
    pages = scanned(lines.groupBy("page", "stem").agg(text.alias("text")), ["page", "stem"])
    placed = pages.withColumn("bundle", F.expr(f"(rank - 1) div {pages_in_bundle}"))
    bundles = placed.select("bundle").distinct()

    def entries(rows: DataFrame, name, content) -> DataFrame:
        return rows.select("bundle", name.alias("name"), F.lit(0).cast("long").alias("piece"), content.cast("binary").alias("content"))

    out = entries(placed, F.concat(F.lit("labels/"), "stem", F.lit(".txt")), F.col("text")).unionByName(entries(bundles, F.lit("data.yaml"), F.lit(about)))
    out = out.unionByName(entries(bundles, F.lit("README.md"), F.lit("Labels: class, centre and size as shares of the image.\n")))
    if images is not None:
        shown = images.join(placed.groupBy("page").agg(F.min("bundle").alias("bundle")), "page")
        out = out.unionByName(entries(shown, F.concat(F.lit("images/"), "name"), F.col("content")))
    return out


def annotation_pieces(annotations: DataFrame, images_in_bundle: int = 2000, images_in_piece: int = 128) -> DataFrame:
    """Pieces of bundles with annotations.json: annotations as tables.annotations gives them; the JSON is put together in pieces of some images each."""
    rows = annotations.withColumns({"bundle": F.expr(f"(image_id - 1) div {images_in_bundle}"), "chunk": F.expr(f"(image_id - 1) % {images_in_bundle} div {images_in_piece}")})
    image = F.struct(F.col("image_id").alias("id"), F.concat(F.col("image_id").cast("string"), F.lit(".jpg")).alias("file_name"), F.col("w").alias("width"), F.col("h").alias("height"))
    box = F.struct(F.col("annotation_id").alias("id"), "image_id", "category_id", F.array("x", "y", "w", "h").alias("bbox"), "area", F.lit(0).alias("iscrowd"))

    def section(of: DataFrame, key: str, value, first: int) -> DataFrame:
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.to_json(value).alias("v")))), lambda x: x["v"]), ",\n")
        made = of.groupBy("bundle", "chunk").agg(listed.alias("text"))
        return made.select("bundle", (F.col("chunk") + first).alias("piece"), F.when(F.col("chunk") == 0, F.col("text")).otherwise(F.concat(F.lit(",\n"), "text")).alias("text"))

    def fixed(piece: int, text: str) -> DataFrame:
        return rows.select("bundle").distinct().select("bundle", F.lit(piece).cast("long").alias("piece"), F.lit(text).alias("text"))

    later = images_in_bundle + 10
    categories = json.dumps([{"id": k, "name": v} for k, v in CATEGORIES.items()])
    parts = fixed(0, f'{{"categories": {categories}, "images": [\n').unionByName(section(rows.where("category_id = 4"), "image_id", image, 1))
    parts = parts.unionByName(fixed(later, '],\n"annotations": [\n')).unionByName(section(rows, "annotation_id", box, later + 1)).unionByName(fixed(2 * later + 1, "]}\n"))
    return parts.select("bundle", F.lit("annotations.json").alias("name"), "piece", F.encode("text", "UTF-8").alias("content"))
