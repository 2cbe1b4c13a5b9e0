"""Views: ranked components, induced edges, budgets, inferred systems and configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.scan import edges_between

#: Edges that views show, and component types that come first in a workspace (fixed values).
VIEW_EDGES = ("DEPENDS_ON", "STATE_HANDOFF", "READS_STATE", "WRITES_STATE", "STARTS_AT", "STARTED_BY")
PRIMARY_TYPES = ("REST_RESOURCE", "SERVICE", "EJB_STATELESS", "EJB_STATEFUL", "EJB_SINGLETON", "MESSAGE_DRIVEN_BEAN", "SCHEDULER", "HTTP_CLIENT", "CDI_EVENT_CONSUMER", "CDI_EVENT_PRODUCER", "REMOTE_SERVICE", "REPOSITORY")
ENTRYPOINT_RANKS = ("MESSAGING_CONSUMER", "SCHEDULER", "REST_ENDPOINT", "MAIN_METHOD")
CANDIDATES, SCOPE_EDGES = 500, 100
#: Nodes of many slices up to which a slice is joined by lists.
WIDE = 100
BROKERS = {"smallrye-kafka": "KAFKA", "smallrye-mqtt": "MQTT", "smallrye-amqp": "AMQP", "smallrye-rabbitmq": "RABBITMQ", "smallrye-pulsar": "PULSAR"}
BROKER_NAMES = {"KAFKA": "Kafka", "MQTT": "MQTT", "AMQP": "AMQP", "RABBITMQ": "RabbitMQ", "PULSAR": "Pulsar", "JMS": "JMS", "UNKNOWN": "Messaging (unknown broker)"}

_PRIORITY = (F.desc, "workflow_relevant"), (F.desc, "business_relevant"), (F.desc, "bridge_score"), (F.asc, "noise_score"), (F.desc, "weight"), (F.asc, "name")


def _order(*rules) -> list[Column]:
    return [direction(column) for direction, column in rules]


def component_view(scored: DataFrame, edges: DataFrame, most: int, scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The most relevant of the first 500 components, within what an application's first 100 OWNS edges hold, and the edges between them.

    Both caps are the view's own.
    """
    some = scored.orderBy("ord").limit(CANDIDATES)
    if scope:
        owned = edges.where("label = 'OWNS'").orderBy("ord").limit(SCOPE_EDGES).where(F.col("src") == scope).select(F.col("dst").alias("id"))
        some = some.join(owned, "id", "left_semi")
    nodes = some.orderBy(*_order(*_PRIORITY)).limit(max(1, most))
    return nodes, edges_between(edges, nodes, VIEW_EDGES).where("src <> dst")


def high_signal(scored: DataFrame, most: int = 12, candidates: int = 100) -> DataFrame:
    """The report's twelve of the first hundred components."""
    return scored.orderBy("ord").limit(candidates).orderBy(F.desc("workflow_relevant"), F.desc("business_relevant"), "noise_score", F.desc("weight"), "id").limit(most)


def cross_module(dependencies: DataFrame, flags: DataFrame, most: int = 20, candidates: int = 100) -> DataFrame:
    """The report's twenty most certain of the first hundred dependencies between modules; ties keep their order."""
    return dependencies.join(flags.where("is_cross_module"), "ord").orderBy("ord").limit(candidates).orderBy(F.desc("confidence"), "ord").limit(most)


def entrypoint_budget(nodes: int) -> int:
    return max(1, min(8, nodes // 3))


def entity_budget(nodes: int, entrypoints: int, primary: int) -> int:
    left = nodes - entrypoints - primary
    return 0 if left <= 0 else min(left, min(4, max(1, nodes // 5)))


def workspace(scored: DataFrame, entrypoints: DataFrame, edges: DataFrame, most: int, scope: str | None = None) -> DataFrame:
    """role, id of a workspace of about `most` nodes, of one application or of all.

    Entrypoints by kind and name within their budget; primary components, those first that own a chosen
    entrypoint or that such a one depends on; entities that touch a chosen component; then others to fill up.
    `most` is the size of a diagram, so each list is a top-k and the counts of what was chosen are driver scalars.
    """
    from weftgraph.sources.store import checkpointed

    rank = F.coalesce(*(F.when(F.col("type") == t, i) for i, t in enumerate(ENTRYPOINT_RANKS)), F.lit(len(ENTRYPOINT_RANKS)))
    number = lambda df, role: df.select(F.lit(role).alias("role"), "id")
    if scope:
        owned = edges.where((F.col("label") == "OWNS") & (F.col("src") == scope)).select(F.col("dst").alias("id")).distinct()
        scored = scored.join(owned, "id", "left_semi")
        entrypoints = entrypoints.join(owned.withColumnRenamed("id", "component_id"), "component_id", "left_semi")
    eps = checkpointed(entrypoints.orderBy(rank, "name", "id").limit(entrypoint_budget(most)).select("id", "component_id"), "chosen")
    room = max(1, most - eps.count())
    owners = eps.select(F.col("component_id").alias("id")).distinct()
    primary = scored.where(F.col("type").isin(*PRIMARY_TYPES))
    near = edges.where("label = 'DEPENDS_ON'").join(owners.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    forced = owners.union(near).distinct().withColumn("forced", F.lit(True))
    chosen = primary.join(forced, "id", "left").orderBy(F.desc(F.coalesce("forced", F.lit(False))), *_order(*_PRIORITY)).limit(room)
    chosen = checkpointed(chosen.select("id"), "chosen")
    extra = entity_budget(most, eps.count(), chosen.count())
    touch = edges.where(F.col("label").isin(*VIEW_EDGES) & (F.col("src") != F.col("dst"))).select("src", "dst", "label").distinct()
    ends = touch.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(touch.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    links = ends.join(chosen.withColumnRenamed("id", "other"), "other", "left_semi").groupBy("id").agg(F.count("*").alias("links"))
    entities = scored.where("type = 'ENTITY'").join(links, "id").orderBy(F.desc("links"), F.desc("business_relevant"), "noise_score", "name").limit(extra).select("id") if extra else chosen.limit(0)
    entities = checkpointed(entities, "chosen")
    have = chosen.union(entities)
    left = most - have.count()
    fill = scored.where("type <> 'ENTITY'").join(have, "id", "left_anti").orderBy("noise_score", F.desc("weight"), "name").limit(max(0, left))
    return number(eps, "entrypoint").union(number(chosen, "primary")).union(number(entities, "entity")).union(number(fill, "fill"))


def broker_views(entrypoints: DataFrame) -> DataFrame:
    """view, source, target, title of the message flows of each broker."""
    e = entrypoints.where(F.col("type").isin("MESSAGING_CONSUMER", "JMS_CONSUMER", "MESSAGING_PRODUCER")).withColumn("b", F.coalesce("broker", F.lit("UNKNOWN")))
    topic = F.concat_ws(":", F.lit("topic"), "b", "channel")
    produces = F.col("type") == "MESSAGING_PRODUCER"
    return e.select(F.concat(F.lower("b"), F.lit("_flow")).alias("view"), F.when(produces, F.col("component_id")).otherwise(topic).alias("source"), F.when(produces, topic).otherwise(F.col("component_id")).alias("target"), F.concat(F.when(produces, "publishes to ").otherwise("consumes "), "channel").alias("title")).distinct()


def external_systems(interfaces: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """id, name, kind, technology, base_url_key of the systems that REST clients, messaging interfaces and entrypoints speak of.

    A REST system's key is the first that is not blank; channels in memory are no system.
    """
    rest = interfaces.where("type = 'rest_client'").where(F.trim("service") != "")
    rest = rest.groupBy(F.col("service").alias("name")).agg(F.min_by("config_key", F.when(F.trim("config_key") != "", F.col("ord"))).alias("base_url_key"))
    rest = rest.select(F.concat(F.lit("ext:rest:"), "name").alias("id"), "name", F.lit("REST_API").alias("kind"), F.lit("microprofile-rest-client").alias("technology"), "base_url_key")
    brokers = interfaces.where("type in ('messaging_consumer', 'messaging_producer', 'messaging_client')").select("broker").unionByName(entrypoints.where("type in ('MESSAGING_CONSUMER', 'MESSAGING_PRODUCER')").select("broker"))
    b = brokers.select(F.coalesce("broker", F.lit("UNKNOWN")).alias("b")).where("b <> 'IN_MEMORY'").distinct()
    label = F.coalesce(*(F.when(F.col("b") == k, v) for k, v in BROKER_NAMES.items()), F.col("b"))
    b = b.select(F.concat(F.lit("ext:messaging:"), F.lower("b")).alias("id"), label.alias("name"), F.lit("MESSAGE_BROKER").alias("kind"), F.lower("b").alias("technology"), F.lit(None).cast("string").alias("base_url_key"))
    return rest.unionByName(b)


def external_dependencies(interfaces: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """from_id, to_id, kind: which component speaks to which external system; each once."""
    rest = interfaces.where("type = 'rest_client'").where(F.trim("service") != "").select(F.col("component_id").alias("from_id"), F.concat(F.lit("ext:rest:"), "service").alias("to_id"), F.lit("rest-client").alias("kind"))
    a = interfaces.where("type in ('messaging_consumer', 'messaging_producer', 'messaging_client')").select("component_id", "broker")
    a = a.unionByName(entrypoints.where("type in ('MESSAGING_CONSUMER', 'MESSAGING_PRODUCER')").select("component_id", "broker"))
    broker = F.coalesce("broker", F.lit("UNKNOWN"))
    return rest.unionByName(a.where(broker != "IN_MEMORY").select(F.col("component_id").alias("from_id"), F.concat(F.lit("ext:messaging:"), F.lower(broker)).alias("to_id"), F.lit("messaging").alias("kind"))).where("from_id is not null").distinct()


def channel_config(config: DataFrame) -> DataFrame:
    """channel, broker, topic from flattened properties: the connector's broker (the last one said), the first destination."""
    connector = F.regexp_extract("key", r"^mp\.messaging\.(?:incoming|outgoing)\.(.+)\.connector$", 1)
    destination = F.regexp_extract("key", r"^mp\.messaging\.(?:incoming|outgoing)\.(.+)\.(?:topic|address|queue\.name|exchange\.name)$", 1)
    name = F.lower(F.trim("value"))
    broker = F.coalesce(*(F.when(name == k, v) for k, v in BROKERS.items()), F.lit("UNKNOWN"))
    a = config.where(connector != "").groupBy(connector.alias("channel")).agg(F.max_by(broker, "ord").alias("broker"))
    b = config.where((connector == "") & (destination != "")).groupBy(destination.alias("channel")).agg(F.min_by("value", "ord").alias("topic"))
    return a.join(b, "channel", "full").select("channel", F.coalesce("broker", F.lit("UNKNOWN")).alias("broker"), "topic")


def in_memory_channels(entrypoints: DataFrame, components: DataFrame, producers: DataFrame, resolved: DataFrame) -> DataFrame:
    """app_id, channel of channels that an application both feeds and reads and that no broker carries.

    producers: component_id, channel.
    """
    home = components.select(F.col("id").alias("component_id"), "app_id")
    out = producers.where("channel is not null").join(home, "component_id").select("app_id", "channel")
    into = entrypoints.where("type = 'MESSAGING_CONSUMER' and channel is not null").select("component_id", "channel").join(home, "component_id").select("app_id", "channel")
    return out.intersect(into).join(resolved.where("broker <> 'UNKNOWN'").select("channel"), "channel", "left_anti").select("app_id", "channel")


def reconcile_datasources(units: DataFrame, datasources: DataFrame) -> DataFrame:
    """name, endpoint, unresolved: the data sources there are, and a placeholder for each that a unit names but nobody declares."""
    named = units.where("datasource is not null").select(F.col("datasource").alias("name")).distinct()
    missing = named.join(datasources.select("name"), "name", "left_anti").select("name", F.lit(None).cast("string").alias("endpoint"), F.lit(True).alias("unresolved"))
    return datasources.select("name", "endpoint", F.lit(False).alias("unresolved")).unionByName(missing)


def entrypoints_per_container(membership: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """container, n.  membership: ord, container, component_id; a component of several containers counts in the last."""
    home = membership.groupBy("component_id").agg(F.max_by("container", F.struct("ord", "container")).alias("container"))
    return entrypoints.join(home, "component_id").groupBy("container").agg(F.count("*").alias("n"))


def pipeline_diagnostic(paths: DataFrame, sinks: DataFrame, links: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """Seven counts that say how chains were stitched.  links: sink_id."""
    destination = F.coalesce(F.when(F.trim("topic") != "", F.col("topic")), F.when(F.trim("channel") != "", F.col("channel")))
    open_ = destination.isNull() | F.contains(destination, F.lit("${")) | (destination == "(unresolved)")
    sent, stored = F.col("kind").isin("MESSAGING", "EVENT_BUS"), F.col("kind") == "PERSISTENCE"
    s = sinks.agg(F.count(F.when(sent, 1)).alias("messaging_sinks"), F.count(F.when(sent & open_, 1)).alias("unresolved_messaging"), F.count(F.when(stored & F.col("operation").rlike("^(save|delete)"), 1)).alias("persistence_writes"), F.count(F.when(stored & F.col("operation").rlike("^(find|get|read|exists)"), 1)).alias("persistence_reads"))
    linked = sinks.join(links.select(F.col("sink_id").alias("id")).distinct(), "id", "left_semi").select("path_id").distinct().agg(F.count("*").alias("linked_paths"))
    total = paths.agg(F.count("*").alias("total_paths"))
    topics = entrypoints.where("type in ('MESSAGING_CONSUMER', 'JMS_CONSUMER')").where((F.trim("channel") != "") & (F.col("channel") != "(unresolved)")).agg(F.countDistinct("channel").alias("consumer_topics"))
    out = total
    for part in (linked, s, topics):
        out = out.withColumn("one", F.lit(1)).join(part.withColumn("one", F.lit(1)), "one").drop("one")
    return out


def reconstruct_chains(segments: DataFrame, sinks: DataFrame, entrypoints: DataFrame, paths: DataFrame) -> DataFrame:
    """chain, segment_index, path_id, entrypoint_id, n_sinks, incoming_sink of every segment.

    segments: chain, segment_index, path_id.  Sinks count by their numeric suffix; the sink that leads into a
    segment is the first by that order of the previous segment.
    """
    number = F.coalesce(F.regexp_extract("id", r":sink:(\d+)$", 1).try_cast("int"), F.lit(2147483647))
    s = sinks.groupBy("path_id").agg(F.count("*").alias("n_sinks"), F.min_by("id", F.struct(number, "id")).alias("first_sink"))
    own = segments.join(paths.select(F.col("id").alias("path_id"), "entrypoint_id"), "path_id").join(s, "path_id", "left")
    before = own.select("chain", (F.col("segment_index") + 1).alias("segment_index"), F.col("first_sink").alias("incoming_sink"))
    known = entrypoints.select(F.col("id").alias("entrypoint_id"))
    out = own.join(before, ["chain", "segment_index"], "left").join(known.withColumn("hit", F.lit(True)), "entrypoint_id", "left")
    return out.select("chain", "segment_index", "path_id", F.when(F.col("hit"), F.col("entrypoint_id")).alias("entrypoint_id"), F.coalesce("n_sinks", F.lit(0)).alias("n_sinks"), "incoming_sink")


def project_pipeline(segment_ids: DataFrame, boundary: DataFrame, edges: DataFrame) -> DataFrame:
    """slice, src, dst, label, ord of the edges that a slice of the graph shows.

    segment_ids, boundary: slice, id.  First the spine: ORIGINATES into a segment, REACHES from a segment to a
    boundary sink, WORKFLOW_LINK between segments.  Then what boundary sinks point at; then every edge
    between what these have selected, which these edges are themselves.  So only the ends of spine and aims are
    gathered, and edges are made distinct before they meet the slices, of which they are shown in many.
    """
    from weftgraph.sources.store import checkpointed

    seg, sink = segment_ids.select("slice", "id").distinct(), boundary.select("slice", "id").distinct()
    src = lambda df: df.withColumnRenamed("id", "src")
    dst = lambda df: df.withColumnRenamed("id", "dst")
    ends = edges.where("label <> 'HAS_SEGMENT'").select("src", "dst", "label")
    of = lambda *labels: ends.where(F.col("label").isin(*labels)).drop("label")
    side = lambda df, c: df.select("slice", F.col(c).alias("id"))
    aims = of("AT_COMPONENT", "ON_FIELD").join(src(sink), "src")
    aims = checkpointed(aims.select("slice", F.explode(F.array("src", "dst")).alias("id")).distinct(), "aims")
    ids = seg.unionByName(aims).unionByName(side(of("ORIGINATES").join(dst(seg), "dst"), "src"))
    loose = checkpointed(sink.join(aims, ["slice", "id"], "left_anti"), "loose")
    if not loose.isEmpty():
        ids = ids.unionByName(side(of("REACHES").join(dst(loose), "dst").join(src(seg), ["slice", "src"]), "dst"))
        ids = ids.unionByName(side(of("LINKS_TO").join(src(loose), "src").join(dst(seg), ["slice", "dst"]), "src"))
    ids = checkpointed(ids.distinct().where("id not like 'chain:%'"), "shown")
    return edges_of_slices(edges.where("label <> 'HAS_SEGMENT'").select("src", "dst", "label", "ord"), ids)


def edges_of_slices(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """slice, src, dst, label, ord: each distinct edge once for each slice that shows both of its ends.  ids: slice, id, distinct.

    Most nodes are shown in one slice, which their edges then go to.  An edge between two nodes of many slices
    meets the slices of its source, each with a list of what else of many slices it shows, and is tested there:
    no row is shuffled for an edge that a slice does not show.  The lists of a slice of more than WIDE such
    nodes would grow with the square, so its edges are joined by both ends.
    """
    from weftgraph.sources.store import checkpointed

    of = ids.groupBy("id").agg(F.count("*").alias("n"), F.min("slice").alias("slice"))
    at = of.select("id", (F.col("n") > 1).alias("many"), F.when(F.col("n") == 1, F.col("slice")).alias("slice"))
    at = checkpointed(at, "at")
    end = lambda c, m, s: at.select(F.col("id").alias(c), F.col("many").alias(m), F.col("slice").alias(s))
    cols = ["slice", "src", "dst", "label", "ord"]
    both = edges.repartition("src").distinct().join(end("src", "many_a", "a"), "src").join(end("dst", "many_b", "b"), "dst")
    both = both.where("many_a or many_b or a = b")
    both = checkpointed(both.select(F.when(F.col("many_a"), F.col("b")).otherwise(F.col("a")).alias("slice"), "many_a", "many_b", "src", "dst", "label", "ord"), "inner")
    single = both.where("not many_a and not many_b").select(cols)
    shared = ids.join(at.where("many").select("id"), "id", "left_semi")
    shared = checkpointed(shared, "shared")
    one = both.where("many_a <> many_b").withColumn("id", F.when(F.col("many_a"), F.col("src")).otherwise(F.col("dst"))).join(shared, ["slice", "id"], "left_semi").select(cols)
    hubs = both.where("many_a and many_b").select("src", "dst", "label", "ord")
    size = shared.groupBy("slice").agg(F.count("*").alias("n"))
    lists = shared.join(size.where(F.col("n") <= WIDE).select("slice"), "slice", "left_semi").groupBy("slice").agg(F.collect_list("id").alias("others"))
    near = lists.select("slice", F.explode("others").alias("src"), "others")
    listed = hubs.join(near, "src").where(F.array_contains("others", F.col("dst"))).select(cols)
    wide = shared.join(size.where(F.col("n") > WIDE).select("slice"), "slice", "left_semi")
    joined = hubs.join(wide.withColumnRenamed("id", "src"), "src").join(wide.withColumnRenamed("id", "dst"), ["slice", "dst"]).select(cols)
    return single.unionByName(one).unionByName(listed).unionByName(joined)
