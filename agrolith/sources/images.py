"""Image folders.

Listings read only ``path`` and ``length`` of the ``binaryFile`` source, so no
file content is loaded; decoding uses Spark's ``image`` source on the
executors (bytes come as BGR). Resizing and normalising run per Arrow batch
in ``mapInPandas`` with numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolith.functions.text import file_extension, parent_name, parent_path
from agrolith.operators.profile import IMAGE_EXTENSIONS, list_files

# Extensions the labelled dataset accepts, and ImageNet channel statistics.
DATASET_EXTENSIONS = [".jpg", ".jpeg", ".png", ".tif"]
MEAN_RGB = [0.485, 0.456, 0.406]
STD_RGB = [0.229, 0.224, 0.225]


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """Image files under root by extension, any case (path, length, extension)."""
    return list_files(spark, root, IMAGE_EXTENSIONS)


def class_folders(spark: SparkSession, root: str) -> tuple[str, list[str]]:
    """The root with its scheme, and the names of the folders in it, sorted (a directory listing, no files)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    full = fs.makeQualified(path)
    return full.toString(), sorted(s.getPath().getName() for s in fs.listStatus(full) if s.isDirectory())


def labelled_images(spark: SparkSession, root: str) -> DataFrame:
    """Direct children of class folders (label = index of the folder by name, empty folders count);
    without folders the images in the root get label 0. Extensions match in lower case only."""
    full, classes = class_folders(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    files = files.withColumn("extension", F.regexp_extract("path", r"(\.[^./]+)$", 1)).where(F.col("extension").isin(DATASET_EXTENSIONS))
    inside = F.substring("path", len(full) + 2, 1 << 30)
    parts = F.split(inside, "/")
    if not classes:
        return files.where(F.size(parts) == 1).select("path", F.lit("").alias("class"), F.lit(0).alias("label"), "length", "extension")
    names = F.array(*[F.lit(c) for c in classes])
    return files.where(F.size(parts) == 2).withColumn("class", F.element_at(parts, 1)).select(
        "path", "class", (F.array_position(names, F.col("class")) - 1).cast("int").alias("label"), "length", "extension")


def decode_images(spark: SparkSession, root: str) -> DataFrame:
    """G1 (decode): one row per file; undecodable files stay as rows flagged ``valid = false``."""
    df = (spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", "true").load(root)
          .select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"),
                  F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"),
                  F.col("image.data").alias("data")))
    df = df.where(file_extension("path").isin(IMAGE_EXTENSIONS))
    return df.withColumn("valid", F.col("height") > 0).withColumn("class", parent_name("path")) \
        .withColumn("folder", parent_path("path"))


def _weights(n: int, size: int) -> np.ndarray:
    """Triangle filter from ``n`` to ``size`` samples; when shrinking it widens to cover every source sample."""
    scale = n / size
    wide = max(scale, 1.0)
    centre = (np.arange(size) + 0.5) * scale
    w = np.maximum(0.0, 1.0 - np.abs(np.arange(n)[None, :] + 0.5 - centre[:, None]) / wide)
    return w / w.sum(axis=1, keepdims=True)


def _resize_norm(data: bytes, h: int, w: int, c: int, size: int) -> np.ndarray:
    a = np.frombuffer(data, dtype=np.uint8).reshape(h, w, c).astype(np.float64)
    if c == 1:
        a = np.repeat(a, 3, axis=2)
    a = a[:, :, :3][:, :, ::-1]  # BGR(A) -> RGB
    # columns, then rows, each back to whole levels
    a = np.clip(np.floor(np.einsum("xw,hwc->hxc", _weights(w, size), a) + 0.5), 0, 255)
    a = np.clip(np.floor(np.einsum("yh,hxc->yxc", _weights(h, size), a) + 0.5), 0, 255)
    r = (a.astype(np.float32) / 255.0 - np.asarray(MEAN_RGB, np.float32)) / np.asarray(STD_RGB, np.float32)
    return np.ascontiguousarray(r.transpose(2, 0, 1)).ravel()  # channels first


def preprocess(decoded: DataFrame, size: int = 128) -> DataFrame:
    """G1: RGB, size x size, [0, 1], then channel mean/std; invalid rows keep a null tensor."""
    from agrolith.session import ship_package
    ship_package(decoded.sparkSession)

    def run(batches):
        for pdf in batches:
            out = []
            for d, h, w, c, ok in zip(pdf["data"], pdf["height"], pdf["width"], pdf["channels"], pdf["valid"]):
                out.append(_resize_norm(bytes(d), int(h), int(w), int(c), size) if ok else None)
            yield pd.DataFrame({"path": pdf["path"], "valid": pdf["valid"], "tensor": out})
    return decoded.select("path", "height", "width", "channels", "data", "valid") \
        .mapInPandas(run, "path string, valid boolean, tensor array<float>")


def land_images(listing: DataFrame, out: str) -> None:
    """Land an image listing as a table partitioned by class (existing data kept)."""
    listing.write.mode("ignore").partitionBy("class").parquet(out)
