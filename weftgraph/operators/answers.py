"""Answers to architecture questions as rows: section, item, detail.

A section lists what was found, `unresolved` and `ambiguous` list codes, and one `status` row says
ambiguous, partial or resolved, in this order of precedence.  Searches are complete, without budgets of visits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.linkers import all_links, contains_links, workflow_links
from weftgraph.operators.traverse import evidence_paths, impacted_by, ways_back
from weftgraph.sources.adjacency import Adjacency
from weftgraph.sources.store import checkpointed

# Fixed values of the rules.
ENDPOINT_TYPES = ("REST_ENDPOINT", "SSE_ENDPOINT", "WEBSOCKET_ENDPOINT", "GRPC_METHOD")
CONSUMER_TYPES = ("MESSAGING_CONSUMER", "JMS_CONSUMER")
IMPACT_GROUPS = {
    "entrypoints": ("Entrypoint",),
    "workflows": ("RuntimeFlow", "RuntimeFlowStep", "DataFlowPath", "DataFlowSink", "PipelineChain"),
    "persistence": ("PersistenceUnit", "DataSource", "PersistenceOperation", "TransactionBoundary"),
    "externalIntegrations": ("ExternalSystem", "Interface"),
}


def section(name: str, df: DataFrame, item: str | Column = "id", detail: str | Column | None = None) -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(F.lit(name).alias("section"), col(item).cast("string").alias("item"), (F.lit(None) if detail is None else col(detail)).cast("string").alias("detail")).distinct()


def absent(df: DataFrame, code: str | Column) -> DataFrame:
    """The code as unresolved if there are no rows."""
    none = df.limit(1).agg(F.count("*").alias("n")).where("n = 0")
    return section("unresolved", none, F.lit(code) if isinstance(code, str) else code)


def envelope(*parts: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """All parts and the status that their codes give.  `once`: rows of a section that are distinct as they are; they are not stored and hold no codes."""
    every = checkpointed(reduce(DataFrame.unionByName, parts).distinct(), "answer")  # read twice
    seen = every.agg(F.max(F.col("section") == "ambiguous").alias("a"), F.max(F.col("section") == "unresolved").alias("u"))
    status = F.when(F.coalesce("a", F.lit(False)), "ambiguous").when(F.coalesce("u", F.lit(False)), "partial").otherwise("resolved")
    every = every.unionByName(section("status", seen, status))
    return every if once is None else every.unionByName(once)


def subject(nodes: DataFrame, ref: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """The one node that a reference means, and the code if it means none or several.

    Candidates are nodes whose id or name contains the reference; exact ones come first.
    """
    low = ref.lower()
    found = nodes.where(F.contains(F.lower("id"), F.lit(low)) | F.contains(F.lower("name"), F.lit(low))).withColumn("exact", (F.col("id") == ref) | (F.col("name") == ref))
    n = found.agg(F.count("*").alias("n"), F.count(F.when(F.col("exact"), 1)).alias("exact"), F.min("id").alias("any"), F.min(F.when(F.col("exact"), F.col("id"))).alias("one"))
    n = n.select(F.when(F.col("exact") > 0, F.col("exact")).otherwise(F.col("n")).alias("n"), F.coalesce("one", "any").alias("id"))
    several = F.concat(F.lit(f"{kind}-reference-matched-"), F.col("n").cast("string"), F.lit(f"-nodes:{ref}"))
    codes = section("ambiguous", n.where("n > 1"), several).unionByName(section("unresolved", n.where("n = 0"), F.lit(f"{kind}-not-resolved:{ref}")))
    return n.where("n = 1").select("id"), codes


def _labelled(ids: DataFrame, nodes: DataFrame | Adjacency) -> DataFrame:
    """ids with the labels of their nodes."""
    return nodes.nodes_of(ids).drop("name") if isinstance(nodes, Adjacency) else ids.join(nodes.select("id", "label"), "id")


def impact(nodes: DataFrame | Adjacency, edges: DataFrame | Adjacency, components: DataFrame, ref: str, depth: int = 4, most: int = 50) -> DataFrame:
    """What a component's change reaches, by five classes (detail is the length of the shortest evidence), and a shortest way of each of the nearest."""
    target, codes = subject(components, ref, "component")
    target = checkpointed(target, "target")
    ways = ways_back(edges, target, depth)
    hit = checkpointed(_labelled(ways.where("hop > 0").select("id", "hop"), nodes), "hit")
    group = F.lit("components")
    for name, labels in IMPACT_GROUPS.items():
        group = F.when(F.col("label").isin(*labels), name).otherwise(group)
    rows = hit.select(group.alias("section"), F.col("id").alias("item"), F.col("hop").cast("string").alias("detail"))
    chains = section("evidenceChains", evidence_paths(ways, most), F.array_join("node_ids", ">"), F.array_join("edge_labels", ">"))
    return envelope(section("subject", target), rows, chains, codes, absent(hit, "no-impacted-nodes-found"))


def endpoint_forward(entrypoints: DataFrame, ref: str, steps: DataFrame, paths: DataFrame, sinks: DataFrame, policies: DataFrame) -> DataFrame:
    """What an entrypoint calls, stores, sends and in which transactions.  steps: entrypoint_id, component_id, method."""
    target, codes = subject(entrypoints, ref, "entrypoint")
    e = entrypoints.join(target, "id", "left_semi")
    calls = steps.join(target.withColumnRenamed("id", "entrypoint_id"), "entrypoint_id", "left_semi")
    mine = sinks.join(paths.join(target.withColumnRenamed("id", "entrypoint_id"), "entrypoint_id", "left_semi").select(F.col("id").alias("path_id")), "path_id", "left_semi")
    tx = calls.join(policies.select("component_id", "method", "policy"), ["component_id", "method"])
    return envelope(
        section("inbound", e, F.concat_ws(" ", "http_method", "path")),
        section("owningComponent", e, "component_id"),
        section("runtimeCalls", calls, "component_id", "method"),
        section("dataFlowSinks", mine.where("kind = 'PERSISTENCE'"), "id", "entity"),
        section("outboundCalls", mine.where("kind <> 'PERSISTENCE'"), "id", "kind"),
        section("transactionTransitions", tx, F.concat_ws("#", "component_id", "method"), "policy"),
        codes,
        absent(calls, "runtime-flow-not-resolved"),
        absent(mine, "no-data-flow-sinks-resolved"),
        section("unresolved", e.sparkSession.createDataFrame([("security-not-modeled",), ("response-schema-not-modeled",)], "id string")),
    )


def endpoint_reverse(components: DataFrame, ref: str, nodes: DataFrame, edges: DataFrame, entrypoints: DataFrame, depth: int = 4) -> DataFrame:
    """Entrypoints that reach a component: those that answer requests, and others; detail is the number of hops."""
    target, codes = subject(components, ref, "component")
    hit = impacted_by(edges, target, depth).join(entrypoints.select("id", "type"), "id")
    served = hit.where(F.col("type").isin(*ENDPOINT_TYPES))
    other = hit.where(~F.col("type").isin(*ENDPOINT_TYPES))
    n = hit.agg(F.count(F.when(F.col("type").isin(*ENDPOINT_TYPES), 1)).alias("served"), F.count("*").alias("n")).where("served = 0")
    code = F.when(F.col("n") > 0, "no-rest-typed-entrypoint-reaches-subject; non-rest callers found").otherwise("no-entrypoint-reaches-subject")
    return envelope(section("subject", target), section("affectedEntrypoints", served, "id", "hop"), section("otherEntrypoints", other, "id", "hop"), codes, section("unresolved", n, code))


def consumer_context(entrypoints: DataFrame, ref: str, paths: DataFrame, sinks: DataFrame, steps: DataFrame) -> DataFrame:
    """An entrypoint's binding, the entrypoints whose paths link into its own by any kind of link, and what it reaches."""
    target, codes = subject(entrypoints, ref, "entrypoint")
    e = entrypoints.join(target, "id", "left_semi")
    own = checkpointed(paths.join(target.withColumnRenamed("id", "entrypoint_id"), "entrypoint_id", "left_semi").select(F.col("id").alias("path_id")), "own")
    links = workflow_links(all_links(sinks, paths, entrypoints, own.select(F.col("path_id").alias("target"))), sinks, paths, entrypoints)
    up = links.select(F.col("from_path").alias("id")).distinct().join(paths, "id").select("entrypoint_id").distinct()
    mine = sinks.join(own, "path_id", "left_semi")
    flow = steps.join(target.withColumnRenamed("id", "entrypoint_id"), "entrypoint_id", "left_semi")
    down = section("downstream", mine, "id", "kind").unionByName(section("downstream", flow, "component_id", "method"))
    return envelope(
        section("inboundBinding", e, F.coalesce("topic", "channel"), "broker"),
        section("upstream", up, "entrypoint_id"),
        down,
        codes,
        section("unresolved", e.where("channel is null and topic is null"), F.lit("consumer-binding-destination-not-resolved")),
        absent(up, "no-upstream-producer-linked"),
        absent(down, "no-downstream-flow-or-sink-resolved"),
    )


def transaction_context(entrypoints: DataFrame, ref: str, steps: DataFrame, policies: DataFrame, calls: DataFrame, components: DataFrame) -> DataFrame:
    """Policies of an entrypoint's steps, by *contains* on component and method, what they govern and their caveats."""
    target, codes = subject(entrypoints, ref, "entrypoint")
    flow = steps.join(target.withColumnRenamed("id", "entrypoint_id"), "entrypoint_id", "left_semi")
    names = contains_links(policies.select("component_id").distinct().select(F.col("component_id").alias("id"), F.col("component_id").alias("name")), flow.select("component_id").distinct().select(F.col("component_id").alias("id"), F.col("component_id").alias("name")))
    names = names.where(F.contains("left_id", F.col("right_id"))).select(F.col("left_id").alias("component_id"), F.col("right_id").alias("step_component"))
    s = flow.select(F.col("component_id").alias("step_component"), F.col("method").alias("step_method"))
    found = policies.join(names, "component_id").join(s, "step_component").where(F.contains("method", F.col("step_method")))
    repository = components.where("type = 'REPOSITORY'").select(F.col("id").alias("to_id"))
    governed = calls.join(repository, "to_id", "left_semi").select(F.col("from_id").alias("component_id"), F.col("from_method").alias("method"), F.concat_ws("#", "to_id", "to_method").alias("call")).join(found.select("component_id", "method").distinct(), ["component_id", "method"])
    return envelope(
        section("policies", found, F.concat_ws("#", "component_id", "method"), "policy"),
        section("scopeTransitions", flow, "component_id", "method"),
        section("governedCalls", governed, "call"),
        section("caveats", found.where("limitations <> ''"), "limitations"),
        codes,
        absent(flow, "runtime-flow-not-resolved"),
        absent(found, "no-effective-transaction-policy-resolved"),
    )


def scheduled_workflow(entrypoints: DataFrame, ref: str, steps: DataFrame, edges: DataFrame, paths: DataFrame, sinks: DataFrame) -> DataFrame:
    """Trigger, steps, fields that the steps' components read and write, and every sink that is no persistence."""
    target, codes = subject(entrypoints, ref, "entrypoint")
    e = entrypoints.join(target, "id", "left_semi")
    flow = steps.join(target.withColumnRenamed("id", "entrypoint_id"), "entrypoint_id", "left_semi")
    state = edges.where("label in ('READS_STATE', 'WRITES_STATE')").join(flow.select(F.col("component_id").alias("src")).distinct(), "src", "left_semi")
    mine = sinks.where("kind <> 'PERSISTENCE'").join(paths.join(target.withColumnRenamed("id", "entrypoint_id"), "entrypoint_id", "left_semi").select(F.col("id").alias("path_id")), "path_id", "left_semi")
    return envelope(
        section("triggerEvidence", e.where("trigger_kind is not null"), "trigger_kind"),
        section("runtimeCalls", flow, "component_id", "method"),
        section("stateReads", state.where("label = 'READS_STATE'"), F.concat_ws("#", "dst", "detail")),
        section("stateWrites", state.where("label = 'WRITES_STATE'"), F.concat_ws("#", "dst", "detail")),
        section("messagingAndExternalSinks", mine, "id", "kind"),
        codes,
        section("unresolved", e.where("trigger_kind is null"), F.lit("trigger-schedule-not-modeled")),
        absent(flow, "runtime-flow-not-resolved"),
    )


def external_integration(nodes: DataFrame, edges: DataFrame, ref: str, depth: int = 4) -> DataFrame:
    """Where an external system is configured, who calls it and what replacing it touches."""
    target, codes = subject(nodes.where("label = 'ExternalSystem'"), ref, "external-system")
    config = edges.where("label = 'CONFIGURED_BY'").join(target.withColumnRenamed("id", "src"), "src", "left_semi").orderBy("ord").limit(1)
    clients = edges.where("label = 'DEPENDS_ON'").join(target.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    # each client's own walk leaves that client out, but another client's may hold it
    hit = impacted_by_each(edges, clients, depth).join(nodes.select("id", "label"), "id")
    callers = hit.where("label = 'Entrypoint'")
    return envelope(
        section("configuredDestination", config, "dst"),
        section("callers", callers),
        section("replacementImpact", hit.where("label <> 'Entrypoint'"), "id", "label"),
        codes,
        absent(config, "base-url-not-modeled"),
        absent(callers, "no-caller-resolved"),
        section("unresolved", target, F.lit("data-sent-received-not-modeled")),
    )


def impacted_by_each(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """id: nodes with a walk of at most `depth` to some start that is not themselves.

    Of the starts that a node has walks to, the smallest and the largest number are carried along: one of
    them is another start unless there is none.  So a frontier has a row a node, not one a start and node.
    """
    numbered = checkpointed(starts.select("id").distinct().withColumn("own", F.monotonically_increasing_id()), "impact")
    steps = edges.select(F.col("dst").alias("id"), F.col("src").alias("next"))
    front, seen = numbered.select("id", F.col("own").alias("low"), F.col("own").alias("high")), None
    for _ in range(depth):
        met = front.join(steps, "id").groupBy(F.col("next").alias("id")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
        front = checkpointed(met, "impact")
        seen = front if seen is None else seen.unionByName(front)
    if seen is None:
        return numbered.select("id").limit(0)
    return seen.join(numbered, "id", "left").where("own is null or low <> own or high <> own").select("id").distinct()


def configuration_context(config: DataFrame, nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Declarations whose key contains `key`, who is configured by them, and placeholders that stay."""
    hit = config.where(F.contains(F.lower("key"), F.lit(key.lower())) & ~is_secret(F.col("key"))).withColumn("id", F.concat(F.lit("config:"), "app_id", F.lit(":"), "key"))
    declared = hit.select("id", "key").distinct()
    n = declared.agg(F.count("*").alias("n"))
    use = edges.where("label = 'CONFIGURED_BY'").join(declared.select(F.col("id").alias("dst")), "dst", "left_semi").join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
    return envelope(
        section("declarations", declared),
        section("usages", use, "src"),
        section("ambiguous", n.where("n > 1"), F.concat(F.lit("config-key-declared-in-"), F.col("n").cast("string"), F.lit(f"-modules:{key}"))),
        section("unresolved", n.where("n = 0"), F.lit(f"config-key-not-declared:{key}")),
        section("unresolved", hit.where(~is_expanded(F.col("value"))), F.concat(F.lit("unexpanded-placeholder:"), "key")),
        absent(use, f"no-usages-found:{key}"),
    )


def is_secret(key: Column) -> Column:
    return F.lower(key).rlike("password|secret|token|credential|private[-_.]?key|api[-_.]?key")


def is_expanded(value: Column) -> Column:
    """No `${...}` is left; null counts as expanded."""
    return F.coalesce(~value.rlike(r"\$\{[^}]+\}"), F.lit(True))


def state_lifecycle(accesses: DataFrame, handoffs: DataFrame, field: str) -> DataFrame:
    """Writers, readers and handoffs of fields whose name contains `field`.  handoffs: distinct, as of `state_handoffs`.

    Handoffs are far more than what makes them.  Distinct ones give distinct rows unless a name holds a separator, so only these are compared.
    """
    test = F.contains(F.lower("field"), F.lit(field.lower()))
    a, h = accesses.where(test), handoffs.where(test)
    w, r = a.where("kind = 'WRITE'"), a.where("kind = 'READ'")
    plain = ~F.coalesce(F.contains(F.concat("writer", "reader"), F.lit(">")) | F.contains(F.concat("owner_id", "field"), F.lit("#")), F.lit(True))
    item, detail = F.concat_ws(">", "writer", "reader"), F.concat_ws("#", "owner_id", "field")
    return envelope(
        section("writers", w, "component_id"),
        section("readers", r, "component_id"),
        section("handoffs", h.where(~plain), item, detail),
        absent(w, f"no-writer-resolved-for-field:{field}"),
        absent(r, f"no-reader-resolved-for-field:{field}"),
        once=h.where(plain).select(F.lit("handoffs").alias("section"), item.alias("item"), detail.alias("detail")),
    )


def messaging_flow(entrypoints: DataFrame, sinks: DataFrame, interfaces: DataFrame, paths: DataFrame, term: str) -> DataFrame:
    """Destination, broker, consumers, producing sinks and what the consumers' paths reach, for a topic or channel."""
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False))
    e = entrypoints.where(F.col("type").isin(*CONSUMER_TYPES) & (has("topic") | has("channel")))
    found = e.agg(F.min_by("topic", F.when(F.col("topic").isNotNull(), F.col("ord"))).alias("t"), F.min_by("channel", F.when(F.col("channel").isNotNull(), F.col("ord"))).alias("c"))
    name = found.select(F.coalesce("t", "c").alias("topic"), F.col("c").alias("channel"), F.coalesce("t", "c", F.lit(term)).alias("search"))
    made = sinks.where("kind = 'MESSAGING'").join(name.select("search"), F.contains(F.lower(F.coalesce("topic", F.lit(""))), F.lower("search")) | F.contains(F.lower(F.coalesce("channel", F.lit(""))), F.lower("search")))
    broker = interfaces.where("broker is not null").join(name.select("search"), F.contains(F.lower("topic"), F.lower("search"))).agg(F.min_by("broker", "ord").alias("broker")).where("broker is not null")
    down = sinks.join(paths.join(e.select(F.col("id").alias("entrypoint_id")), "entrypoint_id", "left_semi").select(F.col("id").alias("path_id")), "path_id", "left_semi")
    return envelope(
        section("topic", name.where("topic is not null"), "topic", "channel"),
        section("broker", broker, "broker"),
        section("producerSinks", made, "id"),
        section("consumers", e),
        section("downstreamSinks", down, "id", "kind"),
        absent(made, "no-producer-resolved-for-channel"),
        absent(e, "no-consumer-resolved-for-channel"),
        section("unresolved", name.where("topic is null"), F.lit("topic-not-resolved")),
    )


def persistence_destination(entrypoints: DataFrame, ref: str, param: str | None, paths: DataFrame, sinks: DataFrame, units: DataFrame, entities: DataFrame, datasources: DataFrame) -> DataFrame:
    """Where an entrypoint's persistence operations end: entity, the one unit that manages it, its data source and endpoint."""
    target, codes = subject(entrypoints, ref, "entrypoint")
    mine = paths.join(target.withColumnRenamed("id", "entrypoint_id"), "entrypoint_id", "left_semi")
    mine = mine.where(F.col("param") == param) if param is not None else mine
    ops = sinks.where("kind = 'PERSISTENCE'").join(mine.select(F.col("id").alias("path_id")), "path_id", "left_semi").select("id", "entity", "operation")
    per = ops.select("entity").distinct().join(entities.select("entity", F.col("unit_id")).distinct(), "entity", "left").groupBy("entity").agg(F.count("unit_id").alias("n"), F.min("unit_id").alias("unit_id"))
    only = units.agg(F.count("*").alias("units"), F.min("id").alias("only_unit"), F.min("name").alias("only_name"))
    # the one unit there is stands in for an entity that no unit names; the one-row table of it is read by a key of its own
    per = per.withColumn("one", F.lit(1)).join(only.withColumn("one", F.lit(1)), "one")
    fallback = (F.col("n") == 0) & (F.col("units") == 1)
    per = per.select("entity", F.when(F.col("n") == 1, F.col("unit_id")).when(fallback, F.col("only_unit")).alias("unit_id"), fallback.alias("fallback"), "only_name")
    u = per.where("unit_id is not null").join(units.select(F.col("id").alias("unit_id"), "name", "datasource"), "unit_id").join(datasources.select(F.col("name").alias("datasource"), F.lit(True).alias("known"), "endpoint"), "datasource", "left")
    return envelope(
        section("operations", ops, "id", "operation"),
        section("destinations", u, F.concat_ws(">", "entity", "unit_id", "datasource", "endpoint")),
        codes,
        absent(ops, "no-persistence-operation-matched"),
        section("ambiguous", per.where("fallback"), F.concat(F.lit("single-persistence-unit-fallback:"), "only_name")),
        section("unresolved", per.where("unit_id is null"), F.concat(F.lit("persistence-unit-not-uniquely-resolved:"), F.coalesce("entity", F.lit("unknown")))),
        section("unresolved", u.where("datasource is null"), F.concat(F.lit("datasource-not-resolved:"), "name")),
        section("unresolved", u.where("datasource is not null and known is null"), F.concat(F.lit("datasource-unresolved:"), "datasource")),
        section("unresolved", u.where("datasource is not null and endpoint is null"), F.concat(F.lit("external-database-endpoint-not-resolved:"), "name")),
    )


def relationship(nodes: DataFrame | Adjacency, edges: DataFrame | Adjacency, a: str, b: str, depth: int = 2) -> DataFrame:
    """What lies within `depth` of a node in any direction, by label, and the directed simple ways to another."""
    from weftgraph.operators.traverse import paths, reachable

    every = nodes.nodes if isinstance(nodes, Adjacency) else nodes
    start = checkpointed(every.where(F.col("id") == a).select("id"), "start")
    near = _labelled(checkpointed(reachable(edges, start, "both", None, depth), "near"), nodes)
    ways = paths(edges, a, b, depth)
    return envelope(section("neighborhood", near, "id", "label"), section("paths", ways, F.array_join("node_ids", ">"), F.array_join("edge_labels", ">")), absent(near, "no-neighborhood-found"))
