"""Workflow chains: from roots along links, with cycle guards, then prefix and duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.scan import top_by
from weftgraph.sources.store import checkpointed


def roots(paths: DataFrame, links: DataFrame) -> DataFrame:
    """Paths that no link enters and some link leaves."""
    ids = paths.select("id")
    return ids.join(links.select(F.col("to_path").alias("id")), "id", "left_anti").join(links.select(F.col("from_path").alias("id")), "id", "left_semi")


def chains(paths: DataFrame, links: DataFrame, depth: int = 32) -> DataFrame:
    """ids (paths) and eps (their entrypoints) of every chain of two or more segments.

    A chain ends where no link leaves, where depth is reached, or where a link would repeat a path or an
    entrypoint: the chain up to there counts on its own, even if other links go on.
    """
    ep = paths.select(F.col("id").alias("path"), "entrypoint_id")
    front = roots(paths, links).join(ep, F.col("id") == F.col("path")).select(F.array("path").alias("ids"), F.array("entrypoint_id").alias("eps"))
    steps = links.select("from_path", "to_path").distinct().join(ep, F.col("to_path") == F.col("path")).select("from_path", "to_path", F.col("entrypoint_id").alias("to_ep"))
    steps = checkpointed(steps, "steps")
    done = None
    for at in range(depth):
        last = front.withColumn("from_path", F.element_at("ids", -1))
        if at == depth - 1:
            ended, more = front, None
        else:
            on = last.join(steps, "from_path", "left")
            repeats = F.array_contains("ids", F.col("to_path")) | F.array_contains("eps", F.col("to_ep"))
            on = checkpointed(on.withColumn("stop", F.col("to_path").isNull() | repeats), "chains")
            ended = on.where("stop").select("ids", "eps").distinct()
            more = on.where("not stop").select(F.array_append("ids", F.col("to_path")).alias("ids"), F.array_append("eps", F.col("to_ep")).alias("eps"))
        done = ended if done is None else done.unionByName(ended)
        if more is None or more.isEmpty():
            break
        front = more
    return done.where(F.size("ids") >= 2).distinct()


def without_prefixes(found: DataFrame) -> DataFrame:
    """Drop a chain if a longer one starts with all but its last path."""
    head = F.slice("ids", F.lit(1), F.size("ids") - 1)
    starts = found.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda n: F.struct(F.slice("ids", F.lit(1), n).alias("head"), F.size("ids").alias("n")))).alias("s"))
    longest = starts.groupBy("s.head").agg(F.max("s.n").alias("longest"))
    return found.withColumn("head", head).join(longest, "head", "left").where(F.coalesce("longest", F.lit(0)) <= F.size("ids")).select("ids", "eps")


def without_duplicates(found: DataFrame) -> DataFrame:
    """One chain per sequence of entrypoints, the one with the smallest paths."""
    return found.groupBy("eps").agg(F.min("ids").alias("ids")).select("ids", "eps")


def longest_per_root(found: DataFrame, limit: int) -> DataFrame:
    """Of each first entrypoint the longest chain (ties: smallest paths), of the first `limit` roots."""
    best = top_by(found.withColumn("root", F.element_at("eps", 1)), ["root"], [F.desc(F.size("ids")), F.asc("ids")])
    return best.orderBy("root").limit(limit)


def segments(found: DataFrame) -> DataFrame:
    """chain, segment_index, path_id, next_path of every segment."""
    chain = F.array_join("ids", ">")
    return found.select(chain.alias("chain"), F.posexplode("ids").alias("segment_index", "path_id"), "ids").select("chain", "segment_index", "path_id", F.get("ids", F.col("segment_index") + 1).alias("next_path"))
