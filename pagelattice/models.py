"""Where models are called: vectorised boundaries with a pluggable model and a deterministic stand-in for tests.

A model is given as a factory, which a worker process calls once. Nothing here guesses what a missing model would say.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.latex import clean, clean_latex, roman_text
from .operators.layout import handler, top_left
from .schema import BLOCK

BOXES = "page_id long, det_idx long, class_id int, confidence double, x1 double, y1 double, x2 double, y2 double"


class Detector(Protocol):
    def detect(self, image: bytes) -> list[tuple[int, float, float, float, float, float]]: ...


class Reader(Protocol):
    def read(self, image: bytes) -> list[dict]: ...


_loaded: dict[str, object] = {}


def once(name: str, factory: Callable[[], object]) -> object:
    """The model of this worker process."""
    if name not in _loaded:
        _loaded[name] = factory()
    return _loaded[name]


def detect(images: DataFrame, factory: Callable[[], Detector], name: str = "layout") -> DataFrame:
    """Raw boxes of images (page_id, content); confidence and overlap thresholds are the model's arguments."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = once(name, factory)
        for batch in batches:
            rows = [(p, i, *box) for p, c in zip(batch["page_id"], batch["content"], strict=True) for i, box in enumerate(model.detect(bytes(c)))]
            yield pd.DataFrame(rows, columns=["page_id", "det_idx", "class_id", "confidence", "x1", "y1", "x2", "y2"])

    return images.select("page_id", "content").mapInPandas(run, BOXES)


ELEMENT = "struct<type:string,text:string,line_number:int,x:double,y:double>"


def read(crops: DataFrame, factories: dict[str, Callable[[], Reader]]) -> DataFrame:
    """Adds elements and error to crops (label, content): each goes to the reader its label names; a failure is its row's."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in crops.schema)}, elements array<{ELEMENT}>, error string"
    routed = crops.withColumn("_handler", handler(F.col("label")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, errors = [], []
            for to, content in zip(batch["_handler"], batch["content"], strict=True):
                try:
                    found.append(once(to, factories[to]).read(bytes(content)))
                    errors.append(None)
                except Exception as e:  # a region that fails is an error row and never fails its page
                    found.append([])
                    errors.append(str(e) or type(e).__name__)
            yield batch.drop(columns="_handler").assign(elements=found, error=errors)

    return routed.mapInPandas(run, schema)


def ordered_elements(elements: Column, by_line: bool = True) -> Column:
    """Elements by line and place (by_line), or by top and left edge within a cell; ties keep their order."""
    keyed = F.transform(elements, lambda e, i: F.struct((F.coalesce(e["line_number"], F.lit(0)).cast("double") if by_line else F.coalesce(e["y"], F.lit(0.0))).alias("a"), F.coalesce(e["x"], F.lit(0.0)).alias("b"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda k: k["e"])


def cell_elements(elements: Column, width: Column, height: Column) -> Column:
    """A cell's elements by the top, then the left edge of their polygon `position`; without one they stand at the centre. Ties keep their order."""
    keyed = F.transform(elements, lambda e, i: F.struct(top_left(e["position"], width, height).alias("at"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda k: k["e"])


def to_blocks(elements: DataFrame) -> DataFrame:
    """(id, i, type, value, display) of elements (id, i, type, text): formulas cleaned, letters set as formulas made text again."""
    stripped = elements.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).where("text <> ''")
    formula = F.col("type").isin("embedding", "isolated")
    cleaned = stripped.withColumn("clean", F.when(formula, clean_latex("text")).otherwise(F.col("text")))
    plain = F.when(F.col("type") == "embedding", roman_text(F.col("clean")))
    return cleaned.select(
        "id", "i", F.when(formula & plain.isNull(), "latex").otherwise("text").alias("type"), F.coalesce(plain, "clean").alias("value"), (F.col("type") == "isolated").alias("display")
    )


def fallback_needed(blocks: Column) -> Column:
    """Whether a reading is formulas alone and text is read again without them."""
    return (F.size(blocks) > 0) & F.forall(blocks, lambda b: b["type"] == "latex")


class StandIn:
    """Says the same of the same bytes; for tests of everything around a model."""

    def detect(self, image: bytes) -> list[tuple[int, float, float, float, float, float]]:
        h = hashlib.sha256(image).digest()
        return [(h[i] % 10, 0.3 + h[i + 1] / 400, float(h[i + 2] * 4), float(h[i + 3] * 8), float(h[i + 2] * 4 + 300), float(h[i + 3] * 8 + 90)) for i in range(0, 16, 4)]

    def read(self, image: bytes) -> list[dict]:
        if not image:
            raise ValueError("empty crop")
        return [{"type": "text", "text": clean(image.decode("utf-8", "replace")), "line_number": 0, "x": 0.0, "y": 0.0}]


__all__ = ["BLOCK", "BOXES", "Detector", "Reader", "StandIn", "cell_elements", "detect", "fallback_needed", "once", "ordered_elements", "read", "to_blocks"]
