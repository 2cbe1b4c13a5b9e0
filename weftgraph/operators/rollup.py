"""Roll-ups: containers, package maps, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Layer of each component type (fixed values); others are `misc`.
LAYERS = {
    "api": ("REST_RESOURCE",),
    "service": ("SERVICE", "EJB_STATELESS", "EJB_STATEFUL", "EJB_SINGLETON", "CDI_EVENT_PRODUCER", "REMOTE_SERVICE"),
    "repository": ("REPOSITORY",),
    "domain": ("ENTITY",),
    "messaging": ("MESSAGE_DRIVEN_BEAN", "CDI_EVENT_CONSUMER"),
    "scheduling": ("SCHEDULER",),
    "client": ("HTTP_CLIENT",),
}


def layer(kind: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, kinds in LAYERS.items():
        out = out.when(kind.isin(*kinds), name)
    return out.otherwise("misc")


#: Containers of plain Java code by a part of the qualified name (fixed values, in this order).
PACKAGES = {".mcp.tools.": "mcp-tools", ".mcp.": "mcp-server", ".extractor.": "extractor", ".scanner.": "scanner", ".renderer.": "renderer", ".merger.": "deployment-merge", ".model.": "model", ".cache.": "cache"}


def inferred_containers(components: DataFrame) -> DataFrame:
    """container, name, technology, derived_from, id: by package where the technology is plain Java, else by layer."""
    by_layer, by_package = layer(F.col("type")), F.lit(None).cast("string")
    for part, name in reversed(PACKAGES.items()):
        by_package = F.when(F.contains("qualified_name", F.lit(part)), name).otherwise(by_package)
    plain = F.coalesce(F.col("technology") == "java", F.lit(False))
    x = components.withColumn("home", F.when(plain, F.coalesce(by_package, by_layer)).otherwise(by_layer)).withColumn("derived_from", F.when(plain, "package-convention").otherwise("stereotype-convention"))
    first = x.groupBy("module", "home").agg(F.min_by(F.struct("technology", "derived_from"), "ord").alias("c"))
    return x.select("module", "home", "id").join(first, ["module", "home"]).select(F.concat_ws(":", F.lit("container"), F.coalesce("module", F.lit("")), "home").alias("container"), F.col("home").alias("name"), "c.technology", "c.derived_from", "id")


def containers(components: DataFrame) -> DataFrame:
    """container, id: one container per module and layer."""
    return components.select(F.concat_ws(":", F.lit("container"), "module", layer(F.col("type"))).alias("container"), "id", "name")


def container_edges(components: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Edges between containers with the sorted set of kinds; targets outside keep their own id."""
    home = containers(components).select("id", "container")
    e = dependencies.join(home.select(F.col("id").alias("src"), F.col("container").alias("a")), "src").join(home.select(F.col("id").alias("dst"), F.col("container").alias("b")), "dst", "left")
    e = e.withColumn("b", F.coalesce("b", "dst")).where("a <> b")
    return e.groupBy("a", "b").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count("*").alias("n"))


def entrypoints_per_container(components: DataFrame, entrypoints: DataFrame) -> DataFrame:
    home = containers(components).select(F.col("id").alias("component_id"), "container")
    return entrypoints.join(home, "component_id").groupBy("container").agg(F.count("*").alias("n"))


def package_group(package: Column, level: int = 3) -> Column:
    return F.substring_index(package, ".", level)


def dependency_map(components: DataFrame, dependencies: DataFrame, level: int = 3) -> DataFrame:
    """from_group, to_group, n and n per kind; pairs within a group count as internal."""
    g = components.select("id", package_group(F.col("package"), level).alias("g"))
    e = dependencies.join(g.select(F.col("id").alias("src"), F.col("g").alias("from_group")), "src").join(g.select(F.col("id").alias("dst"), F.col("g").alias("to_group")), "dst")
    per_kind = e.groupBy("from_group", "to_group", "kind").agg(F.count("*").alias("n"))
    return per_kind.groupBy("from_group", "to_group").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", F.col("n").cast("string")))), ",").alias("by_kind"))


def common_package(components: DataFrame) -> DataFrame:
    """Longest dotted prefix of all packages: that of the smallest and the largest, a two-value aggregate."""
    ends = components.agg(F.min(F.split("package", r"\.")).alias("a"), F.max(F.split("package", r"\.")).alias("b"))
    # the first difference of the two extremes bounds what all share
    same = F.transform(F.arrays_zip("a", "b"), lambda p: p["a"].eqNullSafe(p["b"]))
    n = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & x).cast("int")).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])
    return ends.select(F.array_join(F.slice("a", F.lit(1), n), ".").alias("prefix"))


def external_systems(entrypoints: DataFrame) -> DataFrame:
    """One system per broker that is named, with its destinations counted."""
    return entrypoints.where("broker is not null and broker <> 'IN_MEMORY'").groupBy(F.concat(F.lit("external:"), F.lower("broker")).alias("id")).agg(F.countDistinct(F.coalesce("topic", "channel")).alias("destinations"), F.min("ord").alias("ord"))


#: Left out of exports (fixed values).
HIDDEN_NODES = ("Container", "PipelineChain", "RuntimeFlow", "RuntimeFlowStep")
HIDDEN_EDGES = ("CONTAINS", "HAS_SEGMENT", "HAS_STEP", "STARTED_BY", "VISITS")


def export(nodes: DataFrame, edges: DataFrame, hidden_nodes: tuple[str, ...] = HIDDEN_NODES, hidden_edges: tuple[str, ...] = HIDDEN_EDGES, rest_endpoints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without hidden labels, and no edge whose end is gone.  rest_endpoints (id): interfaces that are left out too."""
    n = nodes.where(~F.col("label").isin(*hidden_nodes))
    if rest_endpoints is not None:
        n = n.join(rest_endpoints.select("id", F.lit("Interface").alias("label")), ["id", "label"], "left_anti").select(*nodes.columns)
    e = edges.where(~F.col("label").isin(*hidden_edges))
    return n, e.join(n.select(F.col("id").alias("src")), "src", "left_semi").join(n.select(F.col("id").alias("dst")), "dst", "left_semi")


def per_package(components: DataFrame, most: int) -> DataFrame:
    """The first `most` components by name of each package."""
    from weftgraph.operators.scan import top_by

    return top_by(components, ["package"], [F.asc("name")], most).select("package", "name")
