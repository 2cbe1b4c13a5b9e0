"""Typed views, row shapes, existence checks and single-edge lookups over the software model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.filters import path_discovery

#: Keys of a row's properties that count as evidence, in this order (fixed values).
EVIDENCE_KEYS = ("derivedFrom", "sourceFile", "sourceLine", "confidence", "confidenceBand", "ambiguous", "evidence")
#: Labels with a typed view of their own (fixed values).
VIEWS = ("Application", "Component", "Container", "DataFlowPath", "Entrypoint", "ExternalSystem", "RuntimeFlow")


def label_view(nodes: DataFrame, label: str) -> DataFrame:
    """ord, id, name of one label: a scan that reads one partition of a stored graph."""
    return nodes.where(F.col("label") == label).select("ord", "id", "name")


def typed(nodes: DataFrame, label: str, schema: dict[str, str]) -> DataFrame:
    """id and the named properties of one label, cast to their types; what can't be cast is null."""
    return nodes.where(F.col("label") == label).select("id", *(F.try_element_at("props", F.lit(k)).try_cast(t).alias(k) for k, t in schema.items()))


def evidence_of(props: Column) -> Column:
    return F.map_filter(props, lambda k, _: k.isin(*EVIDENCE_KEYS))


def _json(pairs: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


def node_rows(nodes: DataFrame) -> DataFrame:
    """The public shape of a node: id, name, label, properties and evidence (null if there is none), maps as sorted JSON."""
    e = evidence_of(F.col("props"))
    return nodes.select("id", "name", "label", _json(F.col("props")).alias("properties"), F.when(F.size(e) > 0, _json(e)).alias("evidence"))


def edge_rows(edges: DataFrame) -> DataFrame:
    e = evidence_of(F.col("props"))
    return edges.select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"), "label", _json(F.col("props")).alias("properties"), F.when(F.size(e) > 0, _json(e)).alias("evidence"))


def existence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """is_empty and has_call_graph, each from one row at most."""
    some = nodes.limit(1).agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    calls = edges.where("label = 'CALLS'").limit(1).agg(F.count("*").alias("c")).withColumn("one", F.lit(1))
    return some.join(calls, "one").select((F.col("n") == 0).alias("is_empty"), (F.col("c") > 0).alias("has_call_graph"))


def list_apps(apps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every application with the graph's counts of components, entrypoints, interfaces and runtime flows."""
    names = {"component_count": "Component", "entrypoint_count": "Entrypoint", "interface_count": "Interface", "runtime_flow_count": "RuntimeFlow"}
    n = nodes.agg(*(F.count(F.when(F.col("label") == v, 1)).alias(k) for k, v in names.items())).withColumn("one", F.lit(1))
    return apps.withColumn("one", F.lit(1)).join(n, "one").select("id", "name", "technology", "packaging", *names)


def targets_of(edges: DataFrame, label: str, src: str) -> DataFrame:
    """id of what one node's edges of a label lead to: owned components, contained ones, configuration."""
    return edges.where((F.col("label") == label) & (F.col("src") == src)).select(F.col("dst").alias("id"))


def is_external(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """id, external of the ids asked for; unknown ones are not external."""
    return ids.join(nodes.where("label = 'ExternalSystem'").select("id").withColumn("hit", F.lit(True)), "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("external"))


def find_entrypoints_in_app(entrypoints: DataFrame, edges: DataFrame, app: str, type_: str | None = None, http_method: str | None = None, path: str | None = None) -> DataFrame:
    """Entrypoints of components that the application owns, by the other filters too."""
    from weftgraph.operators.scan import find_entrypoints

    owned = edges.where("label = 'OWNS'").where(F.contains(F.lower("src"), F.lit(app.lower()))).select(F.col("dst").alias("component_id"))
    return find_entrypoints(entrypoints, type_, http_method, path).join(owned, "component_id", "left_semi")


def trace_paths(paths: DataFrame, entrypoints: DataFrame, sinks: DataFrame, entrypoint_id: str | None = None, name: str | None = None, param: str | None = None, sink_kind: str | None = None) -> DataFrame:
    """Paths by entrypoint (its id contains), by name (contains, or `METHOD /path` by discovery), by parameter (contains) and by a kind of sink that exists."""
    out = paths
    if entrypoint_id:
        out = out.where(F.contains("entrypoint_id", F.lit(entrypoint_id)))
    if name:
        method, _, rest = name.partition(" ")
        at = rest if rest.startswith("/") else name
        test = F.contains(F.lower("name"), F.lit(at.lower()))
        if at.startswith("/"):
            test = test | (F.lower("path") == at.lower() if "{" in at else path_discovery(F.col("path"), at))
        if rest.startswith("/"):
            test = test & (F.lower("http_method") == method.lower())
        out = out.join(entrypoints.where(test).select(F.col("id").alias("entrypoint_id")), "entrypoint_id", "left_semi")
    if param:
        out = out.where(F.contains("param", F.lit(param)))
    if sink_kind:
        out = out.join(sinks.where(F.lower("kind") == sink_kind.lower()).select(F.col("path_id").alias("id")), "id", "left_semi")
    return out


def model_entrypoint(entrypoints: DataFrame, ref: str) -> DataFrame:
    """The first whose id is or contains the reference or whose name is it, or whose path is; else the first below that path."""
    method, _, rest = ref.partition(" ")
    at = rest if rest.startswith("/") else ref
    same = F.lower("http_method") == method.lower() if rest.startswith("/") else F.lit(True)
    exact = same & F.coalesce(F.lower("path") == at.lower(), F.lit(False))
    if not rest.startswith("/"):
        exact = exact | (F.col("name") == ref) | F.contains("id", F.lit(ref))
    rank = F.when(exact, 0)
    if at.startswith("/") and "{" not in at:
        rank = rank.when(same & path_discovery(F.col("path"), at), 1)
    return entrypoints.withColumn("rank", rank).where("rank is not null").orderBy("rank", "ord").limit(1)


def first_of(rows: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the first match of an ordered list of candidate keys.  rows: id, candidates (array); lookup: `keys`[0] (key), `keys`[1] (value), ord.

    The first candidate that exists wins; of several values under it, the first by ord.
    """
    key, value = keys
    best = lookup.groupBy(F.col(key).alias("key")).agg(F.min_by(value, "ord").alias("value"))
    x = rows.select("id", F.posexplode("candidates").alias("at", "key")).join(best, "key")
    return rows.select("id").join(x.groupBy("id").agg(F.min_by("value", "at").alias("value")), "id", "left")


def exactly_one(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and value of groups that hold exactly one row."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias(value)).where("n = 1").drop("n")


def distinct_first(rows: DataFrame, keys: list[str], order: str = "ord", last: bool = False) -> DataFrame:
    """One row per key, whole: the first by order, or the last."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def entrypoint_title(id_: Column) -> Column:
    """Title of an id `owner.Class#method:detail:detail`: `Class.method detail detail`."""
    part = lambda i: F.coalesce(F.get(F.split(id_, ":"), F.lit(i)), F.lit(""))
    own = part(0)
    cut = own.contains("#")
    owner = F.when(cut, F.regexp_extract(own, r"^(.*)#[^#]*$", 1)).otherwise(own)
    method = F.when(cut, F.regexp_extract(own, r"#([^#]*)$", 1)).otherwise(F.lit(""))
    simple = F.regexp_extract(owner, r"([^.]*)$", 1)
    named = F.concat(simple, F.lit("."), method)
    return (
        F.when((part(1) == "spring-listener") & (F.trim(part(2)) != ""), F.concat(named, F.lit(" "), F.trim(F.concat_ws(" ", part(2), part(3)))))
        .when((F.trim(part(1)) != "") & (F.trim(part(2)) != ""), F.concat_ws(" ", named, part(1), part(2)))
        .when(F.trim(part(1)) != "", F.concat_ws(" ", named, part(1)))
        .when(F.trim(method) == "", simple)
        .otherwise(named)
    )


def path_title(entrypoint_id: Column, param: Column) -> Column:
    return F.concat(entrypoint_title(entrypoint_id), F.when(F.trim(F.coalesce(param, F.lit(""))) != "", F.concat(F.lit(" #"), param)).otherwise(F.lit("")))


def entity_of(repository: Column) -> Column:
    """Name of the entity that a repository's name speaks of: without a leading I and a trailing Repository; blank is null."""
    name = F.regexp_replace(F.regexp_replace(repository, "^I", ""), "Repository$", "")
    return F.when(F.trim(name) != "", name)


def repository_entities(repositories: DataFrame, known: DataFrame) -> DataFrame:
    """id, entity: `<base>.model.X`, then `<base>.model.XEntity`, then any entity of that simple name under the base package.

    repositories: id, name, qualified_name; known: qualified_name, name, package of entities.
    """
    base = F.regexp_extract("qualified_name", r"^(.*)\.repository\.", 1)
    r = repositories.select("id", base.alias("base"), entity_of(F.col("name")).alias("x")).where("base <> '' and x is not null")
    have = known.select(F.col("qualified_name").alias("q")).distinct()
    a = r.withColumn("q", F.concat("base", F.lit(".model."), "x"))
    one = a.join(have, "q").select("id", F.col("q").alias("entity"), F.lit(0).alias("rank"))
    two = a.withColumn("q", F.concat("q", F.lit("Entity"))).join(have, "q").select("id", F.col("q").alias("entity"), F.lit(1).alias("rank"))
    three = r.join(known.select(F.col("name").alias("x"), "qualified_name"), "x").where(F.startswith("qualified_name", F.concat("base", F.lit(".")))).select("id", F.col("qualified_name").alias("entity"), F.lit(2).alias("rank"))
    found = one.unionByName(two).unionByName(three).groupBy("id").agg(F.min(F.struct("rank", "entity")).getField("entity").alias("entity"))
    return repositories.select("id").join(found, "id", "left")


def subtypes(types: DataFrame) -> DataFrame:
    """supertype, subtype: the transitive closure of `extends`, one deduplicated frontier a step."""
    from weftgraph.sources.store import checkpointed

    step = types.where("extends is not null").select(F.col("extends").alias("supertype"), F.col("id").alias("subtype")).distinct()
    seen = front = checkpointed(step, "types")
    while True:
        down = step.select(F.col("supertype").alias("subtype"), F.col("subtype").alias("next"))
        front = checkpointed(front.join(down, "subtype").select("supertype", F.col("next").alias("subtype")).distinct().join(seen, ["supertype", "subtype"], "left_anti"), "types")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def expand_types(types: DataFrame, most: int = 25) -> DataFrame:
    """declared, target, capped: the declared type if it is concrete, then its concrete subtypes by ord; at most `most`, and whether there were more.

    The cap is the rule's own.  A type with no target stands for itself.
    """
    from pyspark.sql import Window

    real = types.where("concrete").select(F.col("id").alias("target"), "ord")
    own = real.select(F.col("target").alias("declared"), "target", F.lit(-1).cast("bigint").alias("ord"))
    below = subtypes(types).select(F.col("supertype").alias("declared"), F.col("subtype").alias("target")).join(real, "target").select("declared", "target", "ord")
    w = Window.partitionBy("declared").orderBy("ord")
    found = own.unionByName(below).withColumn("r", F.row_number().over(w))
    n = own.unionByName(below).groupBy("declared").agg((F.count("*") > most).alias("capped"))
    out = found.where(F.col("r") <= most).join(n, "declared").select("declared", "target", "capped")
    alone = types.select(F.col("id").alias("declared")).join(n, "declared", "left_anti").select("declared", F.col("declared").alias("target"), F.lit(False).alias("capped"))
    return out.unionByName(alone)
