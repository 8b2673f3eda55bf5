"""Curve tables and images: schemas, checked readers, writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIXELS = T.StructType([T.StructField("frame", T.IntegerType()), T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("v", T.DoubleType())])

#: Columns that a curve table must have.
CURVE_COLUMNS = ("frame", "contour", "x", "y", "angle", "response")

#: The column titles of exchanged curve tables.
TITLES = {
    "frame": "Frame Number",
    "contour": "Contour Number",
    "point": "Point Number",
    "x": "X_(px)",
    "y": "Y_(px)",
    "angle": "Angle_of_normal_(radians)",
    "response": "Response",
    "width_l": "Width_left_(px)",
    "width_r": "Width_right_(px)",
    "asymmetry": "Asymmetry",
    "contrast": "Contrast",
    "amp": "Amplitude_Fit",
    "sd": "SD_fit",
    "bg": "BG_fit",
    "integr": "IntegrInt_fit",
    "r2": "R2_fit",
}


def checked(df: DataFrame, columns: tuple[str, ...] = CURVE_COLUMNS) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def read_curves(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """A curve table, with exchanged titles or with this library's names; other columns stay."""
    df = spark.read.format(format).options(**options).load(path)
    own = {v: k for k, v in TITLES.items()}
    return checked(df.select(*(F.col(f"`{c}`").alias(own.get(c, c)) for c in df.columns)))


def write_curves(df: DataFrame, path: str, format: str = "parquet", titles: bool = False, mode: str = "error", **options) -> None:
    """Write a curve table, partitioned by frame where the format can be read back so; with `titles`, under the exchanged titles and with row labels."""
    df = checked(df)
    if titles:
        label = F.concat(F.lit("contour_f_"), F.col("frame").cast("int"), F.lit("_c_"), F.col("contour").cast("int"))
        df = df.withColumn("label", label).select("label", *(F.col(c).alias(TITLES.get(c, c)) for c in df.columns))
        df.write.format(format).mode(mode).options(**options).save(path)
    else:
        df.write.format(format).mode(mode).options(**options).partitionBy("frame").save(path)


def read_pixels(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return checked(spark.read.format(format).load(path), ("frame", "y", "x", "v")).select(*(F.col(f.name).cast(f.dataType) for f in PIXELS))


def write_pixels(df: DataFrame, path: str, mode: str = "error") -> None:
    """An image table (any columns besides frame, y, x), partitioned by frame."""
    checked(df, ("frame", "y", "x")).write.mode(mode).partitionBy("frame").parquet(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of gray images in portable graymap files (P5, 8 or 16 bits). The frame is the last number in a file's name."""
    import numpy as np
    import pandas as pd

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"(\d+)[^/\d]*$", 1).cast("int").alias("frame"), "content")

    def decode(batches):
        for pdf in batches:
            for frame, content in zip(pdf["frame"], pdf["content"]):
                head = content.split(None, 4)[:4]
                if head[0] != b"P5":
                    raise ValueError("only gray images (P5) can be read")
                w, h, most = map(int, head[1:])
                kind = "u1" if most < 256 else ">u2"
                n = w * h * np.dtype(kind).itemsize
                v = np.frombuffer(content[-n:], kind).astype("float64")
                yield pd.DataFrame({"frame": np.full(w * h, frame, "int32"), "y": np.repeat(np.arange(h, dtype="int32"), w), "x": np.tile(np.arange(w, dtype="int32"), h), "v": v})

    return files.mapInPandas(decode, PIXELS)
