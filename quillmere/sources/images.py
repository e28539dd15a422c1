"""Image files as rows of gray values."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.plans.registry import session_query
from quillmere.shipping import ship
from quillmere.sources.shared import fresh_path
from quillmere.sources.tables import table

#: The weights of blue, green and red, in the order of the reader's bytes.
GRAY = (0.114, 0.587, 0.299)


def gray_images(spark: SparkSession, path: str) -> DataFrame:
    """(name, height, width, gray) of each image file of a folder; gray goes row by row from the top.

    Spark's reader decodes the files where they are read, from any file system it knows. What is
    no image is left out; an image that is gray already keeps its values, and transparency is
    not read.
    """

    def gray(data: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        for raw, n in zip(data, channels, strict=True):
            pixels = np.frombuffer(raw, np.uint8).reshape(-1, n).astype(float)
            out.append(pixels[:, 0] if n == 1 else pixels[:, :3] @ np.array(GRAY))
        return pd.Series(out)

    ship(spark)
    image = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    values = F.pandas_udf(gray, "array<double>")(F.col("data"), F.col("nChannels"))
    return image.select(F.element_at(F.split("origin", "/"), -1).alias("name"), "height", "width", values.alias("gray"))


def bitmap(pixels: np.ndarray) -> bytes:
    """A BMP file of (height, width, 3) red, green and blue bytes."""
    height, width, _ = pixels.shape
    rows = np.zeros((height, -(-3 * width // 4) * 4), np.uint8)  # rows are padded to four bytes, the lowest first
    rows[:, : 3 * width] = pixels[::-1, :, ::-1].reshape(height, -1)
    head = struct.pack("<2sIII", b"BM", 54 + rows.size, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 0, 0, 0, 0) + rows.tobytes()


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file, through the session's file systems."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


@session_query("S25 X8", "SELECT CAST(r_regionkey AS BIGINT) AS region, CAST(p AS INTEGER) AS pixel, round(CAST(0.299 * (40 * r_regionkey + p) + 0.587 * (10 * r_regionkey + 5) + 0.114 * 3 * r_regionkey AS DOUBLE), 3) AS gray FROM region, range(6) AS x(p)")
def image_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture of two by three pixels for each of the few regions, written, decoded and made gray."""
    path = fresh_path(spark, "images")
    for r in table(spark, sf_dir, "region").select("r_regionkey").collect():
        k = r["r_regionkey"]
        pixels = np.array([[40 * k + p, 10 * k + 5, 3 * k] for p in range(6)], np.uint8).reshape(2, 3, 3)
        write_file(spark, f"{path}/{k}.bmp", bitmap(pixels))
    pixels = gray_images(spark, path).select("name", F.posexplode("gray").alias("pixel", "gray"))
    return pixels.select(F.split_part("name", F.lit("."), F.lit(1)).cast("long").alias("region"), "pixel", F.round("gray", 3).alias("gray"))
