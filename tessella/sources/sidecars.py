"""Georeferences in sidecar files: XML beside a raster, with its transform and CRS."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import exprs as X

ENDING = ".aux.xml"
# The elements of a sidecar, and the order of its six numbers.
ROOT, SCHEMA = "PAMDataset", "SRS string, GeoTransform string"
ORDER = "cabfde"


def sidecar_xml(transform="transform", crs="crs") -> Column:
    """The sidecar's text; null if there is neither a transform nor a CRS."""
    t = X.col(transform)
    numbers = F.when(t.isNotNull(), F.array_join(F.array(*[t[k].cast("string") for k in ORDER]), ", "))
    text = F.to_xml(F.struct(X.col(crs).alias("SRS"), numbers.alias("GeoTransform")), {"rowTag": ROOT})
    return F.when(t.isNotNull() | X.col(crs).isNotNull(), text)


def parsed_sidecar(text: str) -> tuple[Column, Column]:
    """transform and crs of a sidecar's text; null where it does not say or cannot be read. Six numbers make a transform."""
    found = F.from_xml(F.col(text), SCHEMA, {"rowTag": ROOT, "mode": "PERMISSIVE"})
    n = F.transform(F.split(found["GeoTransform"], ","), lambda s: F.trim(s).try_cast("double"))
    whole = (F.size(n) == 6) & F.forall(n, lambda v: v.isNotNull())
    at = {k: F.get(n, F.lit(i)) for i, k in enumerate(ORDER)}
    return F.when(whole, X.affine(*[at[k] for k in "abcdef"])), F.nullif(F.trim(found["SRS"]), F.lit(""))


def sidecars(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path (of the raster), transform, crs of files of sidecars; others are left out."""
    own = files.where(F.endswith(F.col(path), F.lit(ENDING)))
    transform, crs = parsed_sidecar(text)
    return own.select(F.substring(F.col(path), F.lit(1), F.length(path) - len(ENDING)).alias("path"), transform.alias("transform"), crs.alias("crs"))


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """path (of the raster), transform, crs of all sidecars below path."""
    found = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{ENDING}").load(path)
    return sidecars(found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def write_sidecars(rasters: DataFrame, path: str) -> None:
    """A Parquet table of path and text of each raster (path, transform, crs) that has a georeference, for a store of files to take over."""
    rasters.select(F.concat("path", F.lit(ENDING)).alias("path"), sidecar_xml().alias("text")).where("text is not null").write.parquet(path)


def with_sidecars(rasters: DataFrame, found: DataFrame, path: str = "path") -> DataFrame:
    """rasters with transform and crs of their sidecars where they have no transform (or the one that says nothing) or no CRS of their own."""
    beside = found.select(F.col("path").alias("_path"), F.col("transform").alias("_t"), F.col("crs").alias("_c"))
    own = F.col("transform").isNotNull() & ~X.is_default_transform("transform")
    joined = rasters.join(beside, F.col(path) == F.col("_path"), "left")
    return joined.withColumns({"transform": F.when(own, F.col("transform")).otherwise(F.coalesce("_t", "transform")), "crs": F.coalesce("crs", "_c")}).drop("_path", "_t", "_c")
