"""Page triage: which pages hold text, which only images, which nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.functions import geometry as G
from spandrel.functions.text import content_id

TEXT_CHARS, FEW_CHARS, BLANK_STDDEV = 150, 25, 5.0


def page_class(chars: Column, stddev: Column) -> Column:
    return F.when(chars >= TEXT_CHARS, "text").when(stddev < BLANK_STDDEV, "blank").when(chars < FEW_CHARS, "image_content").otherwise("text")


def counts(pages: DataFrame, keys: list) -> DataFrame:
    some = lambda k: F.sum((F.col("klass") == k).cast("int")).alias(k)
    return pages.groupBy(*keys).agg(some("text"), some("image_content"), some("blank"))


def ocr_markers(pages: DataFrame) -> DataFrame:
    """A marker the size of the page for every page whose content needs OCR: none is silently left out."""
    found = pages.where("klass = 'image_content'").select("doc", "page", F.lit("OcrDeferred").alias("status"), G.box(0, 0, F.col("width"), F.col("height")).alias("bbox"))
    return found.withColumn("artifact_id", content_id(F.concat_ws("|", F.lit("ImageRef"), "doc", "page", F.to_json("bbox")), F.lit(0)))


def figure_markers(regions: DataFrame) -> DataFrame:
    return regions.where("role = 'Figure'").select("doc", "page", F.lit("Figure").alias("status"), "bbox")
