"""File trees as tables: fingerprints, versions, kinds, pairs; CSV with a fixed header; publishing all or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGES = ["bmp", "jpg", "jpeg", "png", "tif", "tiff", "webp"]


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def kind(path: Column) -> Column:
    """What a file is, by its suffix; an image below a folder ``mask`` is a mask."""
    s = suffix(path)
    return (
        F.when(s.isin(IMAGES) & F.lower(path).rlike(r"(^|/)mask/"), "annotation_mask").when(s.isin(IMAGES), "image").when(s == "json", "annotation")
        .when(s.isin("xlsx", "xls"), "clinical_workbook").when(s.isin("yaml", "yml"), "annotation_config").otherwise("other")
    )


def fingerprints(files: DataFrame, cohort: str) -> DataFrame:
    """(path, content binary) -> cohort, path, kind, size_bytes, sha256; without office lock files."""
    own = files.where(~F.element_at(F.split("path", "/"), -1).startswith("~$"))
    return own.select(F.lit(cohort).alias("cohort"), "path", kind(F.col("path")).alias("kind"), F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """All files below a folder: path relative to it, content, modification time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.regexp_extract("path", "^(?:[a-z]+:)?/*" + _escaped(root) + "/*(.*)$", 1).alias("path"), "content", "modificationTime")


def _escaped(root: str) -> str:
    import re

    return re.escape(re.sub("^[a-z]+:", "", root).strip("/"))


def dataset_version(prints: DataFrame) -> DataFrame:
    """One SHA-256 over path, zero byte, hash and newline of all files by path: a digest of one stream, so one task holds a row per file. ``bucketed_version`` is for large trees."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat_ws("", x["path"], F.lit("\0"), x["sha256"], F.lit("\n")))
    return prints.agg(F.sha2(F.array_join(lines, ""), 256).alias("version"))


def digests(df: DataFrame, groups: list[str], key: str, line: Column, name: str) -> DataFrame:
    """One SHA-256 per group of any number of rows, as column ``name``; keys are distinct in a group.

    Rows fall into buckets by the first four hex digits of their key's SHA-256. A bucket's digest is that of its lines by
    key; buckets with the same two first digits are digested as lines of prefix, zero byte, digest and newline, and so are
    those of a group. So a task holds a 65,536th of a group's rows, or 256 digests."""
    whole = lambda order, text: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x["t"]), ""), 256)
    own = df.select(*groups, F.col(key).alias("k"), line.alias("t"), F.substring(F.sha2(F.col(key).cast("binary"), 256), 1, 4).alias("p"))
    own = own.groupBy(*groups, "p").agg(whole("k", "t").alias("d"))
    for digits in (2, 0):
        lines = own.withColumn("t", F.concat_ws("", "p", F.lit("\0"), "d", F.lit("\n")))
        own = lines.groupBy(*groups, F.substring("p", 1, digits).alias("q")).agg(whole("p", "t").alias("d")).withColumnRenamed("q", "p")
    return own.select(*groups, F.col("d").alias(name))


def bucketed_version(prints: DataFrame) -> DataFrame:
    """A version of a tree of any size, another number than ``dataset_version`` on purpose: ``digests`` of the same lines."""
    return digests(prints, [], "path", F.concat_ws("", "path", F.lit("\0"), "sha256", F.lit("\n")), "version")


def folder_versions(prints: DataFrame) -> DataFrame:
    """A version per first folder, by the same rule."""
    own = prints.groupBy(F.element_at(F.split("path", "/"), 1).alias("folder"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat_ws("", x["path"], F.lit("\0"), x["sha256"], F.lit("\n")))
    return own.agg(F.sha2(F.array_join(lines, ""), 256).alias("version"))


def tree_version(prints: DataFrame) -> DataFrame:
    """SHA-256 over the folders' versions, another number on purpose: a task holds one folder's files."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("folder", "version"))), lambda x: F.concat_ws("", x["folder"], F.lit("\0"), x["version"], F.lit("\n")))
    return folder_versions(prints).agg(F.sha2(F.array_join(lines, ""), 256).alias("version"))


def summary(prints: DataFrame) -> DataFrame:
    return prints.groupBy("cohort", "kind").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header that must be the schema's; a byte order mark is dropped by the reader."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(columns).write.mode("errorifexists").option("header", True).csv(path)


def split_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """Trimmed non-empty lines."""
    return lines.select(F.trim(column).alias("item")).where("item != ''")


def paired(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Both (class, person, path) -> class, person, stem, status: pair, image_only, annotation_only. Of several formats the last path counts."""
    last = lambda df, n: df.groupBy("class", "person", stem(F.col("path")).alias("stem")).agg(F.max("path").alias(n))
    own = last(images, "image_path").join(last(annotations, "annotation_path"), ["class", "person", "stem"], "full")
    return own.withColumn("status", F.when(F.col("image_path").isNull(), "annotation_only").when(F.col("annotation_path").isNull(), "image_only").otherwise("pair"))


def row_index(rows: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """(rows by key, keys that occur more than once)."""
    own = rows.withColumn("join_key", key)
    return own, own.groupBy("join_key").agg(F.count("*").alias("n")).where("n > 1")


def missing_only(wanted: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """What isn't there yet."""
    return wanted.join(existing.select(keys), keys, "left_anti")


def publish(df: DataFrame, path: str) -> None:
    """Writes a version folder that must not exist; readers take it only with its success mark."""
    df.write.mode("errorifexists").parquet(path)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """A published folder; one without its success mark is refused. The mark is looked up in whatever file system the path names."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        raise ValueError(f"{path} isn't complete")
    return spark.read.parquet(path)


def registry_digest(tables: DataFrame) -> DataFrame:
    """(position, name, sha256) -> one digest of named tables in a fixed order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("position", "name", "sha256"))), lambda x: F.concat_ws("", x["name"], F.lit("\0"), x["sha256"], F.lit("\n")))
    return tables.agg(F.sha2(F.array_join(lines, ""), 256).alias("digest"))


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")
