"""Text sinks: diagrams as DataFrames of lines, JSON and a viewer page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe(c: Column) -> Column:
    """An identifier that diagrams accept."""
    return F.regexp_replace(c, "[^A-Za-z0-9_]", "_")


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """position, line of a flowchart; edges whose ends are missing are left out by the caller."""
    head = nodes.sparkSession.createDataFrame([(0, "", "flowchart LR")], "part int, key string, line string")
    n = nodes.select(F.lit(1).alias("part"), F.col("id").alias("key"), F.concat(F.lit("  "), safe(F.col("id")), F.lit('["'), F.regexp_replace("name", '"', "#quot;"), F.lit('"]')).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws(" ", "src", "label", "dst").alias("key"), F.concat(F.lit("  "), safe(F.col("src")), F.lit(" -->|"), F.col("label"), F.lit("| "), safe(F.col("dst"))).alias("line"))
    return head.unionByName(n).unionByName(e)


def likec4(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same as a LikeC4 model."""
    spark = nodes.sparkSession
    fixed = spark.createDataFrame([(0, "", "model {"), (9, "", "}")], "part int, key string, line string")
    n = nodes.select(F.lit(1).alias("part"), F.col("id").alias("key"), F.concat(F.lit("  "), safe(F.col("id")), F.lit(" = component '"), F.regexp_replace("name", "'", "\\\\'"), F.lit("'")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat_ws(" ", "src", "label", "dst").alias("key"), F.concat(F.lit("  "), safe(F.col("src")), F.lit(" -> "), safe(F.col("dst")), F.lit(" '"), F.col("label"), F.lit("'")).alias("line"))
    return fixed.unionByName(n).unionByName(e)


def text(lines: DataFrame) -> str:
    """A diagram as one string; for diagrams, which people read, and not for whole graphs."""
    return "\n".join(r.line for r in lines.orderBy("part", "key").toLocalIterator())


def viewer_page(graph_json: str) -> str:
    """HTML with the graph embedded; `<` is escaped so that no text ends the script."""
    body = graph_json.replace("<", "\\u003c").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Graph</title></head><body><pre id="g"></pre><script>const graph = {body};document.getElementById("g").textContent = JSON.stringify(graph, null, 1);</script></body></html>'
