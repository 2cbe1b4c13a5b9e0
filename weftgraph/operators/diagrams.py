"""Diagrams as DataFrames of lines: part and key order them, `render.text` joins them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.render import safe

#: Brackets of a component's type in flowcharts; others are boxes (fixed values).
SHAPES = {"REPOSITORY": ("[(", ")]"), "HTTP_CLIENT": ("[/", "/]"), "MESSAGE_DRIVEN_BEAN": ("([", "])"), "SCHEDULER": ("([", "])"), "CDI_EVENT_CONSUMER": ("((", "))"), "CDI_EVENT_PRODUCER": ("((", "))")}


def _shaped(name: Column, kind: Column) -> Column:
    out = F.concat(F.lit("["), name, F.lit("]"))
    for k, (a, b) in SHAPES.items():
        out = F.when(kind == k, F.concat(F.lit(a), name, F.lit(b))).otherwise(out)
    return out


def _lines(part: int, key: Column, line: Column, df: DataFrame) -> DataFrame:
    return df.select(F.lit(part).alias("part"), key.cast("string").alias("key"), line.alias("line"))


def _number(position: Column) -> Column:
    """A number that sorts as text."""
    return F.lpad(position.cast("string"), 9, "0")


def call_flow(steps: DataFrame, edges: DataFrame, components: DataFrame, entrypoint_id: str) -> DataFrame:
    """One entrypoint's flow: the client, its steps in order and the calls between different steps."""
    spark = steps.sparkSession
    s = steps.where(F.col("entrypoint_id") == entrypoint_id).join(components.select(F.col("id").alias("component_id"), "name", "type"), "component_id")
    pid = F.concat(F.lit("p"), F.col("position").cast("string"))
    head = spark.createDataFrame([(0, "", "flowchart TD"), (1, "", "    Client([Client])")], "part int, key string, line string")
    nodes = _lines(2, _number(F.col("position")), F.concat(F.lit("    "), pid, _shaped(F.col("name"), F.col("type"))), s)
    first = _lines(3, F.lit(""), F.concat(F.lit("    Client -->|"), "via", F.lit("| "), pid), s.where("position = 0"))
    a, b = (s.select(F.col("component_id").alias(f"{x}_id"), "position", pid.alias(f"{x}_pid")).withColumnRenamed("position", f"{x}_at") for x in ("from", "to"))
    e = edges.where(F.col("entrypoint_id") == entrypoint_id).join(a, "from_id").join(b, "to_id").where("from_id <> to_id")
    calls = _lines(4, F.concat_ws(" ", _number(F.col("from_at")), _number(F.col("to_at")), "via"), F.concat(F.lit("    "), "from_pid", F.lit(" -->|"), "via", F.lit("| "), "to_pid"), e)
    return head.unionByName(nodes).unionByName(first).unionByName(calls)


def timeline(steps: DataFrame, entrypoints: DataFrame, components: DataFrame, most: int) -> DataFrame:
    """section, position, line of a Gantt chart of every flow: its first `most` steps and how many there are besides (the chart's own cut)."""
    label = F.when(F.col("http_method").isNotNull() & F.col("path").isNotNull(), F.concat_ws(" ", "http_method", "path")).otherwise(F.coalesce("channel", "e_name", "entrypoint_id"))
    e = entrypoints.select(F.col("id").alias("entrypoint_id"), "http_method", "path", "channel", F.col("name").alias("e_name"))
    s = steps.join(e, "entrypoint_id").join(components.select(F.col("id").alias("component_id"), "name"), "component_id", "left")
    task = F.concat(F.coalesce("name", "component_id"), F.lit(" via "), F.coalesce("via", F.lit("call")))
    style = F.when(F.col("position") == 0, "active, ").otherwise("")
    shown = s.where(F.col("position") < most).select(label.alias("section"), "entrypoint_id", "position", F.concat(F.lit("    "), F.rpad(task, 36, " "), F.lit(":"), style, F.col("position").cast("string"), F.lit(", 1")).alias("line"))
    n = s.groupBy("entrypoint_id", label.alias("section")).agg((F.count("*") - most).alias("more")).where("more > 0")
    rest = n.select("section", "entrypoint_id", F.lit(most).cast("long").alias("position"), F.concat(F.lit("    ... ("), F.col("more").cast("string"), F.lit(f" more steps) :crit, {most}, 1")).alias("line"))
    return shown.unionByName(rest)


def pipelines(segments: DataFrame) -> DataFrame:
    """chain, part, key, line: each chain as a left-to-right flowchart of its paths."""
    node = safe(F.col("path_id"))
    w = Window.partitionBy("chain").orderBy("segment_index")
    x = segments.withColumn("after", F.lead("path_id").over(w))
    head = segments.select("chain").distinct().select("chain", F.lit(0).alias("part"), F.lit("").alias("key"), F.lit("flowchart LR").alias("line"))
    nodes = x.select("chain", F.lit(1).alias("part"), _number(F.col("segment_index")).alias("key"), F.concat(F.lit("    "), node, F.lit("["), "path_id", F.lit("]")).alias("line"))
    arrows = x.where("after is not null").select("chain", F.lit(2).alias("part"), _number(F.col("segment_index")).alias("key"), F.concat(F.lit("    "), node, F.lit(" --> "), safe(F.col("after"))).alias("line"))
    return head.unionByName(nodes).unionByName(arrows)


def package_map(groups: DataFrame) -> DataFrame:
    """Lines of a dependency map.  groups: from_group, to_group, n, by_kind; dependencies inside a group are counted in its box."""
    spark = groups.sparkSession
    head = spark.createDataFrame([(0, "", "flowchart LR")], "part int, key string, line string")
    inside = groups.where("from_group = to_group").select(F.col("from_group").alias("g"), "n")
    names = groups.select(F.col("from_group").alias("g")).union(groups.select("to_group")).distinct().join(inside, "g", "left")
    boxes = _lines(1, F.col("g"), F.concat(F.lit("    "), safe(F.col("g")), F.lit("["), "g", F.when(F.col("n") > 0, F.concat(F.lit(" internal "), F.col("n").cast("string"))).otherwise(""), F.lit("]")), names)
    arrows = _lines(2, F.concat_ws(" ", "from_group", "to_group"), F.concat(F.lit("    "), safe(F.col("from_group")), F.lit(" -->|"), "by_kind", F.lit("| "), safe(F.col("to_group"))), groups.where("from_group <> to_group"))
    return head.unionByName(boxes).unionByName(arrows)
