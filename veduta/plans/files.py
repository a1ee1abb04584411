"""Queries over the bytes of files. Files are made from the tables' numbers, so that their facts are known without reading them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import media, pixels

#: Pictures that a task makes thumbnails of, about.
PER_TASK = 64


def big(n: Column, size: int) -> Column:
    """A number as ``size`` bytes of hex, the highest first."""
    return F.lpad(F.hex(n.cast("long")), 2 * size, "0")


def little(n: Column, size: int) -> Column:
    """A number as ``size`` bytes of hex, the lowest first."""
    text = big(n, size)
    return F.concat(*[F.substring(text, 2 * (size - i) - 1, 2) for i in range(size)])


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file a part: format by key, sides by size and key, an orientation for TIFF files."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") * 7 + 1).alias("w"), (F.col("p_partkey") % 900 + 2).alias("h"))
    w, h, kind = F.col("w"), F.col("h"), F.col("p_partkey") % 7
    entry = lambda tag, n: F.concat(F.lit(tag), F.lit("0300"), F.lit("01000000"), little(n, 2), F.lit("0000"))
    tiff = F.concat(F.lit("49492A00080000000300"), entry("0001", w), entry("0101", h), entry("1201", F.col("p_partkey") % 8 + 1), F.lit("00000000"))
    app1 = F.concat(F.lit("FFE1"), big(F.length(tiff) / 2 + 8, 2), F.lit("457869660000"), tiff)
    frame = F.concat(F.lit("FFC0001108"), big(h, 2), big(w, 2), F.lit("03011100021100031100"))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4), F.lit("0806000000"), F.lit("00000000"))
    code = (
        F.when(kind == 0, png)
        .when(kind == 1, F.concat(F.lit("474946383961"), little(w, 2), little(h, 2), F.lit("000000")))
        .when(kind == 2, F.concat(F.lit("424D"), F.lit("00" * 16), little(w, 4), little(h, 4), F.lit("01001800")))
        .when(kind == 3, F.concat(F.lit("FFD8"), frame, F.lit("FFDA")))
        .when(kind == 4, F.concat(F.lit("524946460000000057454250565038580A00000000000000"), little(w - 1, 3), little(h - 1, 3)))
        .when(kind == 5, tiff)
        .otherwise(F.concat(F.lit("FFD8"), app1, frame, F.lit("FFDA")))
    )
    return part.select("p_partkey", F.unhex(code).alias("content"))


def binary_parse_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts read from the files' bytes."""
    facts = media.parse(_files(spark, sf_dir))
    return facts.select("p_partkey", "format", "width", "height", "bpp", "alpha", "lossless", "orientation")


def webp_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of WebP files of the three kinds by arithmetic on their hex alone."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") * 7 + 2).alias("w"), (F.col("p_partkey") % 900 + 2).alias("h"))
    w, h, kind = F.col("w"), F.col("h"), F.col("p_partkey") % 3
    head = F.lit("524946460000000057454250")
    lossless = little((w - 1) + (h - 1) * 16384, 4)
    code = (
        F.when(kind == 0, F.concat(head, F.lit("565038200000000000000000009D012A"), F.lit(""), little(w, 2), little(h, 2)))
        .when(kind == 1, F.concat(head, F.lit("5650384C00000000"), F.lit("2F"), lossless, F.lit("0000000000")))
        .otherwise(F.concat(head, F.lit("565038580A00000000000000"), little(w - 1, 3), little(h - 1, 3)))
    )
    code = F.when(kind == 0, F.concat(head, F.lit("5650382000000000"), F.lit("000000"), F.lit("9D012A"), little(w, 2), little(h, 2))).otherwise(code)
    size = media.webp_size(F.col("hex"))
    return part.select("p_partkey", code.alias("hex")).select("p_partkey", size["width"].alias("width"), size["height"].alias("height"))


def thumbnail_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures (PNG files made of a supplier's numbers) to finished thumbnails, read back: their sides, and whether they are darker in the corner than a flat picture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"s_suppkey": [], "width": [], "height": [], "shaded": []}
            for key, w, h in zip(*(b.column(c).to_pylist() for c in ("s_suppkey", "w", "h")), strict=True):
                source = pixels.encode_png(np.full((h, w, 3 + key % 2), 200 if key % 2 == 0 else 255, np.uint8))
                made = pixels.decode_png(pixels.encode_png(pixels.thumbnail(pixels.pre_scale(pixels.decode_png(source)))))
                facts = (key, made.shape[1], made.shape[0], bool(made[0, 0, 0] < made[100, 125, 0]))
                for name, value in zip(out, facts, strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("s_suppkey", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("shaded", pa.bool_())]))

    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", (F.col("s_suppkey") % 37 * 23 + 20).alias("w"), (F.col("s_suppkey") % 29 * 31 + 20).alias("h"))
    # Dealt by the number of pictures: their numbers fill one small file, hence one task, at any size that matters.
    parts = min(max(math.ceil(rows.count() / PER_TASK), 1), 4096)
    return rows.repartition(parts, "s_suppkey").mapInArrow(run, "s_suppkey long, width int, height int, shaded boolean")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"binary_parse_suite": binary_parse_suite, "webp_dims": webp_dims, "thumbnail_pipeline": thumbnail_pipeline}
SQL = {
    "binary_parse_suite": """
SELECT p_partkey, ['png', 'gif', 'bmp', 'jpeg', 'webp', 'tiff', 'jpeg'][k + 1] AS format, p_size::BIGINT * 7 + 1 AS width, p_partkey % 900 + 2 AS height,
  CASE k WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE 24 END::BIGINT AS bpp, CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE 0 END::INTEGER AS alpha,
  CASE WHEN k IN (3, 4, 6) THEN 0 ELSE 1 END::INTEGER AS lossless, CASE WHEN k IN (5, 6) THEN p_partkey % 8 + 1 END::INTEGER AS orientation
FROM (SELECT *, p_partkey % 7 AS k FROM part)""",
    "webp_dims": "SELECT p_partkey, p_size::BIGINT * 7 + 2 AS width, p_partkey % 900 + 2 AS height FROM part",
    "thumbnail_pipeline": "SELECT s_suppkey, 250::INTEGER AS width, 200::INTEGER AS height, TRUE AS shaded FROM supplier",
}
