"""Dataset categories: the classes of a segmentation."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ord int, name string, palette_index int, palette_color array<int>, label_values array<array<int>>, weight double, is_active boolean, is_ignore boolean, is_thing boolean, supercategory string"


@dataclass(frozen=True)
class Category:
    """Names are lower-case; two categories are the same if their names are."""

    name: str
    palette_index: int
    palette_color: tuple[int, ...]
    label_values: tuple[tuple[int, ...], ...] = ()
    weight: float = 1.0
    is_active: bool = True
    is_ignore: bool = False
    is_thing: bool = False
    supercategory: str = ""

    def __post_init__(self):
        object.__setattr__(self, "name", self.name.lower())
        color = self.palette_color
        if isinstance(color, str):
            if not re.fullmatch(r"#[0-9a-fA-F]{6}", color):
                raise ValueError("a colour is (r, g, b) or #rrggbb")
            color = tuple(int(color[i : i + 2], 16) for i in (1, 3, 5))
        if len(color) != 3 or not all(0 <= c <= 255 for c in color) or not 0 <= self.palette_index <= 255:
            raise ValueError("colours and palette indices go from 0 to 255")
        object.__setattr__(self, "palette_color", tuple(color))
        object.__setattr__(self, "label_values", tuple(tuple(v) for v in self.label_values or ()))


def to_df(spark: SparkSession, categories: Sequence[Category]) -> DataFrame:
    if len(categories) < 2:
        raise ValueError("a segmentation has at least two categories")
    rows = [(i, c.name, c.palette_index, list(c.palette_color), [list(v) for v in c.label_values], c.weight, c.is_active, c.is_ignore, c.is_thing, c.supercategory) for i, c in enumerate(categories)]
    return spark.createDataFrame(rows, SCHEMA)


def from_json(text: str, include_ignore: bool = True) -> list[Category]:
    """A list of objects with the fields of Category."""
    found = [Category(**{k: v for k, v in c.items() if k in Category.__dataclass_fields__}) for c in json.loads(text)]
    return found if include_ignore else [c for c in found if not c.is_ignore]


def to_json_column() -> Column:
    return F.to_json(F.struct("name", "palette_index", "palette_color", "label_values", "is_active", "is_ignore"))


def coco_json_column() -> Column:
    return F.to_json(F.struct("supercategory", F.col("palette_color").alias("color"), F.col("is_thing").cast("int").alias("isthing"), F.col("palette_index").alias("id"), "name"))


def active(df: DataFrame) -> DataFrame:
    return df.where("is_active")


def not_ignored(df: DataFrame) -> DataFrame:
    return df.where("not is_ignore")


# The categories of an aerial land-cover benchmark.
LAND_COVER: Iterable[Category] = (
    Category("background", 0, (255, 0, 0), ((255, 0, 0),)),
    Category("building", 1, (0, 0, 255), ((0, 0, 255),)),
    Category("tree", 2, (0, 255, 0), ((0, 255, 0),)),
    Category("impervious_surfaces", 3, (255, 255, 255), ((255, 255, 255),)),
    Category("low_vegetation", 4, (0, 255, 255), ((0, 255, 255),)),
    Category("car", 5, (255, 255, 0), ((255, 255, 0),)),
    Category("reliable_area", 10, (255, 0, 255), ((255, 0, 255),)),
    Category("ignore", 255, (0, 0, 0), ((0, 0, 0),), is_active=False, is_ignore=True),
)
