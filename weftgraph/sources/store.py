"""Storage of graphs, and lineage cuts that outlive executors."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; where none is named, one of our own in local mode, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/weftgraph-shared"
    return root.rstrip("/")


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: short lineage, and no executor holds the only copy."""
    path = f"{shared_folder(df.sparkSession)}/weftgraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class Parts:
    """A table of the shared folder that a loop writes part by part.

    All parts are read by one scan, so the plan of a step, and what the driver holds for it, does not grow with
    the steps before it, as a union of their tables does.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.paths = spark, []
        self.base = f"{shared_folder(spark)}/weftgraph/{name}-{uuid.uuid4().hex}"

    def add(self, df: DataFrame) -> DataFrame:
        """Write a part and read it again.  The columns are those of the first part."""
        self.paths.append(f"{self.base}/{len(self.paths)}")
        self.schema = df.schema if len(self.paths) == 1 else self.schema
        df.select(*self.schema.names).write.parquet(self.paths[-1])
        return self.spark.read.schema(self.schema).parquet(self.paths[-1])

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


def workspace_key(path: str) -> str:
    """Folder name of a workspace: sixteen hex digits of its SHA-256, then its last name made safe."""
    import hashlib

    last = re.sub(r"[^A-Za-z0-9._-]", "_", path.rstrip("/").rsplit("/", 1)[-1])
    return f"{hashlib.sha256(path.encode()).hexdigest()[:16]}-{last}"


def save_graph(nodes: DataFrame, edges: DataFrame, root: str, workspace: str) -> str:
    """Parquet, partitioned by label so that label scans read only their files."""
    base = f"{root.rstrip('/')}/{workspace_key(workspace)}"
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").partitionBy("label").parquet(f"{base}/{name}")
    return base


def load_graph(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{base}/nodes"), spark.read.parquet(f"{base}/edges")


def build_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge repeated vertices and drop dangling edges.

    The first row of an id gives label, name and ord; later rows overwrite other properties; null and
    blank values never do and are never stored.  Parallel edges stay.
    """
    clean = F.map_filter("props", lambda _, v: v.isNotNull() & (F.trim(v) != ""))
    entries = nodes.select("id", "ord", "label", "name", F.explode_outer(clean).alias("k", "v"), "nums")
    last = entries.where("k is not null").groupBy("id", "k").agg(F.max_by("v", "ord").alias("v")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("props"))
    numbers = nodes.select("id", "ord", F.explode("nums").alias("k", "v")).where("v is not null").groupBy("id", "k").agg(F.max_by("v", "ord").alias("v")).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("nums"))
    head = nodes.groupBy("id").agg(F.min("ord").alias("ord"), F.min_by("label", "ord").alias("label"), F.min_by("name", "ord").alias("name"))
    merged = head.join(last, "id", "left").join(numbers, "id", "left")
    merged = merged.select("ord", "id", "label", "name", F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"), F.coalesce("nums", F.create_map().cast("map<string,double>")).alias("nums"))
    ids = merged.select("id")
    return merged, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def merged(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without property maps, as a graph: the first row of each id, and no dangling edges."""
    rest = [c for c in nodes.columns if c != "id"]
    first = nodes.groupBy("id").agg(F.min_by(F.struct(*rest), "ord").alias("n")).select("id", "n.*")
    ids = first.select("id")
    return first.select(*nodes.columns), edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON document per row, map keys in order."""
    ordered = [F.map_from_entries(F.array_sort(F.map_entries(f.name))).alias(f.name) if f.dataType.typeName() == "map" else F.col(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*ordered)).alias("value"))


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """key, value of .properties files; of repeated keys the last file and line win."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    pair = lines.where(~F.trim("value").rlike("^[#!]") & F.col("value").rlike("[=:]"))
    parts = pair.select(F.trim(F.regexp_extract("value", r"^\s*([^=:\s]+)\s*[=:]\s*(.*)$", 1)).alias("key"), F.regexp_extract("value", r"^\s*([^=:\s]+)\s*[=:]\s*(.*)$", 2).alias("v"), "file", "line")
    return parts.where("key <> ''").groupBy("key").agg(F.max_by("v", F.struct("file", "line")).alias("value"))


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """group, host of INI inventories: a host belongs to the last group header above it in its file."""
    text = spark.read.text(path, wholetext=True)
    blocks = text.select(F.explode(F.regexp_extract_all("value", F.lit(r"\[([^\]]+)\]([^\[]*)"), F.lit(0))).alias("b"))
    return blocks.select(F.regexp_extract("b", r"\[([^\]]+)\]", 1).alias("group"), F.explode(F.split(F.regexp_replace("b", r"^\[[^\]]+\]", ""), "\n")).alias("line")).select("group", F.regexp_extract("line", r"^\s*([^\s#;]+)", 1).alias("host")).where("host <> ''")
