"""Scans and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators import filters as P
from weftgraph.operators.limits import edge_limit, first_rows, node_limit, traversal_limit


def find_nodes(nodes: DataFrame, filters: dict[str, str] | None = None, label: str | None = None, text: str | None = None, limit: int | None = None) -> DataFrame:
    return first_rows(P.matching(nodes, filters, label).where(P.text_condition(text)), node_limit(limit))


def find_edges(edges: DataFrame, filters: dict[str, str] | None = None, label: str | None = None, limit: int | None = None) -> DataFrame:
    return first_rows(P.matching(edges, filters, label), edge_limit(limit))


def edges_between(edges: DataFrame, ids: DataFrame, labels: tuple[str, ...] = (), whole: bool = True) -> DataFrame:
    """Edges with both ends among `ids` (column id) in any of the labels: the first of each (label, src, dst), whole and in that order.

    Only keys and `ord` go through the aggregate; with `whole` the rows are fetched by `ord` and put in order,
    without it the result is src, dst, label, ord in no order.
    """
    ids = ids.select("id").distinct()
    inner = edges.where(F.col("label").isin(*labels)) if labels else edges
    inner = inner.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    first = inner.groupBy("src", "dst", "label").agg(F.min("ord").alias("ord"))
    if not whole:
        return first
    rest = [c for c in edges.columns if c not in ("src", "dst", "label")]
    return first.join(edges.select(*rest), "ord").select("src", "dst", "label", *rest).orderBy("label", "src", "dst")


def count_by_label(nodes: DataFrame, label: str | None = None) -> DataFrame:
    return P.matching(nodes, None, label).agg(F.count("*").alias("n"))


def summary(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count("*").alias("n"))


def by_ids(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """Distinct, in the order asked for; unknown ids are skipped."""
    wanted = {i: at for at, i in reversed(list(enumerate(ids)))}
    asked = nodes.sparkSession.createDataFrame([(i, at) for i, at in wanted.items()], "id string, at int")
    return nodes.join(F.broadcast(asked), "id")  # as many rows as the caller named


def neighborhood(edges: DataFrame, node_id: str, direction: str = "both", limit: int | None = None) -> DataFrame:
    """Edges at a node in insertion order; any word that is no direction means both."""
    out, into = F.col("src") == node_id, F.col("dst") == node_id
    test = {"in": into, "incoming": into, "out": out, "outgoing": out}.get(direction.lower(), out | into)
    return first_rows(edges.where(test), traversal_limit(limit))


def top_by(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def resolve_component(components: DataFrame, ref: str) -> DataFrame:
    """The id itself, else the first whose name is ref or whose qualified name contains it."""
    rank = F.when(F.col("id") == ref, 0).when((F.col("name") == ref) | F.contains("qualified_name", F.lit(ref)), 1)
    return components.withColumn("rank", rank).where("rank is not null").orderBy("rank", "ord").limit(1)


def resolve_entrypoint(entrypoints: DataFrame, ref: str) -> DataFrame:
    """The id itself; `METHOD /path` exactly, else the first below that path; else the name."""
    method, _, path = ref.partition(" ")
    if path.startswith("/"):
        same = F.lower("http_method") == method.lower()
        rank = F.when(F.col("id") == ref, 0).when(same & (F.lower("path") == path.lower()), 1)
        if "{" not in ref:
            rank = rank.when(same & P.path_discovery(F.col("path"), path), 2)
    else:
        rank = F.when(F.col("id") == ref, 0).when(F.col("name") == ref, 1)
    return entrypoints.withColumn("rank", rank).where("rank is not null").orderBy("rank", "ord").limit(1)


def resolution(candidates: DataFrame, exact: Column) -> DataFrame:
    """status of a lookup: exact matches are preferred; one is resolved, none unresolved, more ambiguous."""
    n = candidates.agg(F.count("*").alias("n"), F.count(F.when(exact, 1)).alias("exact"))
    found = F.when(F.col("exact") > 0, F.col("exact")).otherwise(F.col("n"))
    return n.select(F.when(found == 0, "unresolved").when(found == 1, "resolved").otherwise("ambiguous").alias("status"), found.alias("candidates"))


def snapshot(nodes: DataFrame, edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first nodes in insertion order, then sorted by (label, id), and the edges between them."""
    some = first_rows(nodes, limit)
    return some.orderBy("label", "id"), edges_between(edges, some)


def app_components(components: DataFrame, app: str) -> DataFrame:
    """Components of applications whose id contains `app`."""
    return components.where(F.contains(F.lower("app_id"), F.lit(app.lower())))


def find_components(components: DataFrame, type_: str | None = None, technology: str | None = None, app: str | None = None) -> DataFrame:
    """Without an application both filters are *contains*; within one, technology must be equal."""
    within = app_components(components, app) if app else components
    if type_:
        within = within.where(F.contains(F.lower("type"), F.lit(type_.lower())))
    if technology:
        within = within.where(F.lower("technology") == technology.lower() if app else F.contains(F.lower("technology"), F.lit(technology.lower())))
    return within


def find_entrypoints(entrypoints: DataFrame, type_: str | None = None, http_method: str | None = None, path: str | None = None) -> DataFrame:
    out = entrypoints
    if type_:
        out = out.where(F.lower("type") == type_.lower())
    if http_method:
        out = out.where(F.lower("http_method") == http_method.lower())
    return out.where(P.path_discovery(F.col("path"), path)) if path else out
