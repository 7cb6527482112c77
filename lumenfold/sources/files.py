"""File sources: discovery, metadata tables, nested class trees, ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.text import base_name, parse_pairs

# Suffixes of files that are taken.
SUFFIXES = ["bmp", "gif", "heic", "heif", "jpeg", "jpg", "png", "tif", "tiff", "webp"]


def scan(spark: SparkSession, root: str, recursive: bool = True, content: bool = False) -> DataFrame:
    """(path, mtime, size[, content, image_id]) of the files below root with a known suffix, in any case; image_id is a content
    digest. The contents are read only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    cols = [path.alias("path"), F.unix_micros("modificationTime").cast("double").alias("us"), F.col("length").alias("size")]
    if content:
        cols += ["content", F.substring(F.sha2("content", 256), 1, 16).alias("image_id")]
    out = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(SUFFIXES)).select(*cols)
    return out.withColumn("mtime", F.col("us") / 1e6).drop("us")


def meta_csv(spark: SparkSession, path: str, root: str) -> DataFrame:
    """(path, base, meta) of a metadata CSV: the key is the first column named path, filename or file; empty values are dropped
    and relative paths resolved below root. Without a key column it is an error."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    key = next((c for k in ("path", "filename", "file") for c in raw.columns if c.strip().lower() == k), None)
    if key is None:
        raise ValueError("metadata needs a column path, filename or file")
    rest = [c for c in raw.columns if c != key]
    pairs = F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").alias("v")) for c in rest]), lambda x: x.v.isNotNull() & (x.v != "")) if rest else F.array()
    full = F.when(F.col(f"`{key}`").startswith("/"), F.col(f"`{key}`")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col(f"`{key}`")))
    out = raw.where(F.col(f"`{key}`").isNotNull()).select(full.alias("path"), (F.map_from_entries(pairs) if rest else F.create_map().cast("map<string,string>")).alias("meta"))
    return out.select("path", base_name(F.col("path")).alias("base"), "meta")


def key_values(df: DataFrame, column: str) -> Column:
    """Array of key=value strings as a map."""
    return parse_pairs(F.col(column))


def class_tree(spark: SparkSession, tree: dict, name: str = "LabelName", children: str = "Subcategory") -> DataFrame:
    """(parent, child) edges of a nested class tree (reference data, walked on the driver); the root "entity" and edges of a
    class to itself are left out."""
    edges, todo = set(), [(tree, None)]
    while todo:
        node, parent = todo.pop()
        own = node.get(name, "").lower()
        if parent and own and parent != own and parent != "entity":
            edges.add((parent, own))
        todo += [(c, own) for c in node.get(children, [])]
    return spark.createDataFrame(sorted(edges), "parent string, child string")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(image, category, supercategory) from an instances file with images, annotations and categories."""
    raw = spark.read.option("multiLine", True).json(path)
    cats = raw.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("category"), F.col("c.supercategory").alias("supercategory"))
    ann = raw.select(F.explode("annotations").alias("a")).select(F.col("a.image_id").alias("image"), F.col("a.category_id").alias("category_id"))
    return ann.join(F.broadcast(cats), "category_id").select("image", "category", "supercategory").distinct()


def label_csv(df: DataFrame, ident: str = "ImageID", label: str = "LabelName", confidence: str = "Confidence") -> DataFrame:
    """(id, positive, negative): class sets by confidence 1 and 0."""
    one = F.col(confidence).cast("double") == 1
    return df.groupBy(F.col(ident).alias("id")).agg(F.array_sort(F.collect_set(F.when(one, F.col(label)))).alias("positive"), F.array_sort(F.collect_set(F.when(~one, F.col(label)))).alias("negative"))
