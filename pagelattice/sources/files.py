"""File sources: listings without contents, uploads, session images, data URLs."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import data_url_bytes
from ..operators.library import file_type


def listing(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    """(path, name, stem, size, mtime) of a folder's files, their contents unread; Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index("path", "/", -1)
    return files.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def contents(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content) of a folder's files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def uploads(files: DataFrame) -> DataFrame:
    """(filename, file_size, file_type) of listed files."""
    return files.select(F.col("name").alias("filename"), F.col("size").alias("file_size"), file_type(F.col("name")).alias("file_type"))


def session_images(wanted: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(session_id, path): where each session's image lies; the first listing goes before the second, none gives null."""
    at = lambda files, alias: files.groupBy(F.col("stem").alias("session_id")).agg(F.min("path").alias(alias))
    return wanted.join(at(first, "a"), "session_id", "left").join(at(second, "b"), "session_id", "left").select("session_id", F.coalesce("a", "b").alias("path"))


def placed_image_bytes(data_url: Column) -> Column:
    return data_url_bytes(data_url)


def image_size(content: bytes | None) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, JPEG, GIF or BMP; null for what can't be read."""
    b = bytes(content or b"")
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", b[16:24])
        if b[:3] == b"GIF":
            return struct.unpack("<HH", b[6:10])
        if b[:2] == b"BM":
            w, h = struct.unpack("<ii", b[18:26])
            return w, abs(h)
        if b[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(b) and b[at] == 0xFF:
                kind, size = b[at + 1], struct.unpack(">H", b[at + 2 : at + 4])[0]
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", b[at + 5 : at + 9])
                    return w, h
                at += 2 + size
    except struct.error:
        pass
    return None


_SIZE = T.StructType().add("width", "integer").add("height", "integer").add("error", "string")


@F.pandas_udf(_SIZE)
def sized(content: pd.Series) -> pd.DataFrame:
    """width and height, or an error: missing, or not an image that can be decoded."""
    found = [image_size(c) for c in content]
    errors = [None if f else "missing image" if c is None or not len(c) else "undecodable image" for f, c in zip(found, content, strict=True)]
    return pd.DataFrame({"width": pd.array([f and f[0] for f in found], "Int32"), "height": pd.array([f and f[1] for f in found], "Int32"), "error": errors})


def options(spark: SparkSession, prefix: str = "spark.pagelattice.") -> dict[str, str]:
    """Settings of the session under a prefix, without it."""
    return {k.removeprefix(prefix): v for k, v in spark.conf.getAll.items() if k.startswith(prefix)}
