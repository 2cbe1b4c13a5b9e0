"""Lookups, views, inference and reports over the software model, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import linkers as L
from weftgraph.operators import lookup as K
from weftgraph.operators import metrics as M
from weftgraph.operators import policy as Y
from weftgraph.operators import rollup as R
from weftgraph.operators import views as V
from weftgraph.plans.registry import _CHAINS, _METRICS, _STORE, _chain_parts, _metrics, _store_links, query
from weftgraph.sources import store as G

_SCORED = ("components", "accesses", "dependencies", "entrypoints")


# ---- storage


@query("SELECT label, count(*) AS n, min(name) AS first_name FROM nodes GROUP BY label", "nodes")
def stored_graph(p):
    """Merged, stored by label and read back."""
    nodes, edges = G.build_graph(p.nodes, p.edges.where("label in ('IN_REGION', 'IN_NATION')"))
    back, _ = G.load_graph(p.spark, G.save_graph(nodes, edges, G.shared_folder(p.spark) + "/weftgraph/graphs", p.sf_dir))
    return back.groupBy("label").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


@query("SELECT id, '{\"id\":\"' || id || '\",\"label\":\"' || label || '\",\"name\":\"' || name || '\"}' AS json FROM model_nodes WHERE label IN ('Application', 'Component')", "model_nodes")
def export_json(p):
    nodes = p.model_nodes.where("label in ('Application', 'Component')").select("id", "label", "name")
    return nodes.select("id", F.to_json(F.struct("id", "label", "name")).alias("json"))


@query(
    """+ n AS (SELECT * FROM model_nodes WHERE label NOT IN ('Container', 'PipelineChain', 'RuntimeFlow', 'RuntimeFlowStep')), e AS (SELECT * FROM model_edges WHERE label NOT IN ('CONTAINS', 'HAS_SEGMENT', 'HAS_STEP', 'STARTED_BY', 'VISITS') AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n))
SELECT 'node' AS kind, label, count(*) AS n FROM n GROUP BY label UNION ALL SELECT 'edge', label, count(*) FROM e GROUP BY label""",
    "model_nodes",
    "model_edges",
)
def snapshot_counts(p):
    nodes, edges = R.export(p.model_nodes, p.model_edges)
    count = lambda kind, df: df.groupBy("label").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "label", "n")
    return count("node", nodes).unionByName(count("edge", edges))


@query(
    """+ n AS (SELECT * FROM model_nodes WHERE label NOT IN ('Container', 'PipelineChain', 'RuntimeFlow', 'RuntimeFlowStep') AND NOT (label = 'Interface' AND id IN (SELECT id FROM interfaces WHERE type = 'rest'))),
e AS (SELECT * FROM model_edges WHERE label NOT IN ('CONTAINS', 'HAS_SEGMENT', 'HAS_STEP', 'STARTED_BY', 'VISITS') AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n))
SELECT 'node' AS kind, label, id, NULL AS dst FROM n WHERE label IN ('Interface', 'Application') UNION ALL SELECT 'edge', label, src, dst FROM e WHERE label IN ('OWNS', 'CONNECTS_TO')""",
    "model_nodes",
    "model_edges",
    "interfaces",
)
def snapshot_public(p):
    """What an export shows: no hidden labels, no REST endpoints among the interfaces, no dangling edges."""
    nodes, edges = R.export(p.model_nodes, p.model_edges, rest_endpoints=p.interfaces.where("type = 'rest'"))
    n = nodes.where("label in ('Interface', 'Application')").select(F.lit("node").alias("kind"), "label", "id", F.lit(None).cast("string").alias("dst"))
    return n.unionByName(edges.where("label in ('OWNS', 'CONNECTS_TO')").select(F.lit("edge").alias("kind"), "label", F.col("src").alias("id"), "dst"))


# ---- views by label, row shapes, existence


@query("SELECT label, id, name FROM model_nodes WHERE label IN ('Application', 'Component', 'Container', 'DataFlowPath', 'Entrypoint', 'ExternalSystem', 'RuntimeFlow')", "model_nodes")
def label_views(p):
    out = None
    for label in K.VIEWS:
        view = K.label_view(p.model_nodes, label).select(F.lit(label).alias("label"), "id", "name")
        out = view if out is None else out.unionByName(view)
    return out


@query("SELECT id, name, size::INTEGER AS size, retailprice FROM nodes WHERE label = 'Part'", "nodes")
def typed_projection(p):
    return K.typed(p.nodes, "Part", {"name": "string", "size": "double", "retailprice": "double"}).withColumn("size", F.col("size").cast("int"))


@query("SELECT id, name, label, '{\"name\":\"' || name || '\"}' AS properties, NULL::VARCHAR AS evidence FROM nodes WHERE label IN ('Region', 'Nation')", "nodes")
def node_rows(p):
    return K.node_rows(p.nodes.where("label in ('Region', 'Nation')"))


@query("SELECT from_id, to_id, 'DEPENDS_ON' AS label, '{\"confidence\":\"' || c || '\",\"kind\":\"' || kind || '\"}' AS properties, '{\"confidence\":\"' || c || '\"}' AS evidence FROM (SELECT *, cast(floor(confidence * 1000) as bigint)::VARCHAR AS c FROM dependencies) d", "dependencies")
def edge_rows(p):
    props = F.create_map(F.lit("kind"), F.col("kind"), F.lit("confidence"), F.floor(F.col("confidence") * 1000).cast("string"))
    return K.edge_rows(p.dependency_edges.withColumn("props", props))


@query("SELECT count(*) = 0 AS is_empty, (SELECT count(*) FROM model_edges WHERE label = 'CALLS') > 0 AS has_call_graph FROM model_nodes", "model_nodes", "model_edges")
def graph_existence(p):
    return K.existence(p.model_nodes, p.model_edges)


@query("SELECT id, name, technology, packaging, (SELECT count(*) FROM components) AS component_count, (SELECT count(*) FROM entrypoints) AS entrypoint_count, (SELECT count(*) FROM interfaces) AS interface_count, 0::BIGINT AS runtime_flow_count FROM apps", "apps", "components", "entrypoints", "interfaces")
def list_apps(p):
    return K.list_apps(p.apps, p.model_nodes)


@query("SELECT id FROM components WHERE app_id = 'app:7'", "components")
def components_owned_by(p):
    return K.targets_of(p.model_edges, "OWNS", "app:7")


_HOME = "CASE WHEN type = 'REST_RESOURCE' THEN 'api' WHEN type IN ('SERVICE', 'EJB_STATELESS', 'CDI_EVENT_PRODUCER', 'REMOTE_SERVICE') THEN 'service' WHEN type = 'REPOSITORY' THEN 'repository' WHEN type = 'ENTITY' THEN 'domain' WHEN type IN ('MESSAGE_DRIVEN_BEAN', 'CDI_EVENT_CONSUMER') THEN 'messaging' WHEN type = 'SCHEDULER' THEN 'scheduling' WHEN type = 'HTTP_CLIENT' THEN 'client' ELSE 'misc' END"


@query(f"SELECT DISTINCT 'container:' || module || ':' || {_HOME} AS container FROM components WHERE app_id = 'app:7'", "components")
def containers_for_app(p):
    return R.containers(p.components.where("app_id = 'app:7'")).select("container").distinct()


_PACKAGED = "CASE WHEN ord % 2 = 0 THEN 'java' ELSE technology END"
_NAME = "replace(replace(replace(qualified_name, '.web.', '.model.'), '.mapper.', '.cache.'), '.redis.', '.mcp.tools.')"


@query(
    f"+ j AS (SELECT id, ord, type, module, {_PACKAGED} AS technology, {_NAME} AS q FROM components), h AS (SELECT *, CASE WHEN technology = 'java' THEN coalesce(CASE " + " ".join(f"WHEN contains(q, '{part}') THEN '{name}'" for part, name in R.PACKAGES.items()) + f" END, {_HOME}) ELSE {_HOME} END AS home FROM j) SELECT 'container:' || module || ':' || home AS container, home AS name, first_value(technology) OVER w AS technology, CASE first_value(technology) OVER w WHEN 'java' THEN 'package-convention' ELSE 'stereotype-convention' END AS derived_from, id FROM h WINDOW w AS (PARTITION BY module, home ORDER BY ord)",
    "components",
)
def containers_inferred(p):
    """Containers by package of plain Java code, by layer of the rest."""
    x = p.components.withColumn("technology", F.when(F.col("ord") % 2 == 0, "java").otherwise(F.col("technology")))
    for old, new in ((".web.", ".model."), (".mapper.", ".cache."), (".redis.", ".mcp.tools.")):
        x = x.withColumn("qualified_name", F.replace("qualified_name", F.lit(old), F.lit(new)))
    return R.inferred_containers(x)


@query(f"SELECT id FROM components WHERE 'container:' || module || ':' || {_HOME} = 'container:nation_7:service'", "components")
def components_in_container(p):
    return R.containers(p.components).where("container = 'container:nation_7:service'").select("id")


@query("SELECT id, name FROM apps WHERE parent_id = 'app:2'", "apps")
def child_apps(p):
    return p.apps.where("parent_id = 'app:2'").select("id", "name")


@query("SELECT id, id IN (SELECT id FROM model_nodes WHERE label = 'ExternalSystem') AS external FROM (SELECT unnest(['ext:db0', 'comp:1', 'ext:rest:svc2', 'nothing']) AS id) x", "model_nodes")
def is_external_system(p):
    return K.is_external(p.model_nodes, p.spark.createDataFrame([("ext:db0",), ("comp:1",), ("ext:rest:svc2",), ("nothing",)], "id string"))


@query("SELECT id, path FROM entrypoints WHERE lower(type) = 'rest_endpoint' AND component_id IN (SELECT id FROM components WHERE contains(lower(app_id), 'app:1'))", "entrypoints", "components")
def find_entrypoints_in_app(p):
    return K.find_entrypoints_in_app(p.entrypoints, p.model_edges, "app:1", "REST_ENDPOINT").select("id", "path")


@query("SELECT x.id FROM paths x JOIN entrypoints e ON e.id = x.entrypoint_id WHERE contains(x.entrypoint_id, 'ep:1') AND lower(http_method) = 'get' AND (lower(path) = '/building' OR contains(lower(e.name), '/building') OR starts_with(lower(path), '/building/') OR starts_with(lower(path), '/building{')) AND contains(param, 'high') AND x.id IN (SELECT path_id FROM sinks WHERE lower(kind) = 'persistence')", "paths", "entrypoints", "sinks")
def trace_paths_filters(p):
    return K.trace_paths(p.paths, p.entrypoints, p.sinks, "ep:1", "GET /building", "high", "Persistence").select("id")


@query("SELECT id, name FROM entrypoints WHERE name = 'ep:14' OR contains(id, 'ep:14') OR path = 'ep:14' ORDER BY ord LIMIT 1", "entrypoints")
def model_entrypoint_by_id(p):
    return K.model_entrypoint(p.entrypoints, "ep:14").select("id", "name")


@query("SELECT id, name FROM entrypoints WHERE lower(http_method) = 'post' AND (lower(path) = '/machinery' OR starts_with(lower(path), '/machinery/') OR starts_with(lower(path), '/machinery{')) ORDER BY CASE WHEN lower(path) = '/machinery' THEN 0 ELSE 1 END, ord LIMIT 1", "entrypoints")
def model_entrypoint_by_path(p):
    return K.model_entrypoint(p.entrypoints, "POST /machinery").select("id", "name")


@query("SELECT 'user:' || user_id::VARCHAR AS id, 'user:' || user_id::VARCHAR || ':' || 'detail' AS t, 'C' || user_id::VARCHAR || '.m detail' AS title FROM (SELECT DISTINCT user_id FROM events) u", "paths")
def entrypoint_titles(p):
    u = p.table("events").select("user_id").distinct()
    k = F.col("user_id").cast("string")
    return u.select(F.concat(F.lit("user:"), k).alias("id"), F.concat(F.lit("user:"), k, F.lit(":detail")).alias("t"), K.entrypoint_title(F.concat(F.lit("com.acme.C"), k, F.lit("#m:detail"))).alias("title"))


# ---- joins and keyed dedup


@query("+ c AS (SELECT s_suppkey AS id, unnest(['a' || (s_suppkey % 40)::VARCHAR, 'b' || (s_suppkey % 30)::VARCHAR, 'c']) AS key, unnest([0, 1, 2]) AS pos FROM supplier), l AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'a' ELSE 'b' END || (n_nationkey + 5)::VARCHAR AS key, n_name AS value, n_nationkey AS ord FROM nation) SELECT s_suppkey AS id, (SELECT value FROM c JOIN l ON l.key = c.key WHERE c.id = s_suppkey ORDER BY c.pos, l.ord LIMIT 1) AS value FROM supplier", "paths")
def first_match_join(p):
    k = F.col("s_suppkey")
    rows = p.table("supplier").select(k.alias("id"), F.array(F.concat(F.lit("a"), (k % 40).cast("string")), F.concat(F.lit("b"), (k % 30).cast("string")), F.lit("c")).alias("candidates"))
    n = F.col("n_nationkey")
    lookup = p.table("nation").select(F.concat(F.when(n % 2 == 0, "a").otherwise("b"), (n + 5).cast("string")).alias("k"), F.col("n_name").alias("v"), n.alias("ord"))
    return K.first_of(rows, lookup, ["k", "v"])


@query("+ u AS (SELECT app_id, name, id AS choice FROM units), o AS (SELECT 'if' || n_nationkey::VARCHAR AS id, 'app:' || (n_nationkey % 25)::VARCHAR AS app, CASE WHEN n_nationkey % 3 = 0 THEN 'pu' || (n_nationkey % 4)::VARCHAR END AS name FROM nation) SELECT o.id, choice FROM o JOIN u ON u.app_id = o.app AND u.name = o.name UNION ALL SELECT o.id, min(choice) FROM o JOIN u ON u.app_id = o.app WHERE o.name IS NULL GROUP BY o.id HAVING count(*) = 1", "units")
def default_unit_join(p):
    n = F.col("n_nationkey")
    rows = p.table("nation").select(F.concat(F.lit("if"), n.cast("string")).alias("id"), F.concat(F.lit("app:"), (n % 25).cast("string")).alias("app"), F.when(n % 3 == 0, F.concat(F.lit("pu"), (n % 4).cast("string"))).alias("name"))
    return L.default_if_single(rows, p.units.select(F.col("app_id").alias("app"), "name", F.col("id").alias("choice")))


@query("SELECT component_id, method, min(ord) AS ord FROM method_facts GROUP BY ALL HAVING count(*) = 1", "method_facts")
def unique_method_lookup(p):
    return K.exactly_one(p.method_facts, ["component_id", "method"], "ord")


@query("SELECT from_id, to_id, arg_min(kind, ord) AS kind, min(ord) AS ord FROM dependencies GROUP BY from_id, to_id", "dependencies")
def dependencies_first_wins(p):
    return K.distinct_first(p.dependencies.select("from_id", "to_id", "kind", "ord"), ["from_id", "to_id"])


@query("SELECT from_id, to_id, arg_max(kind, ord) AS kind, max(ord) AS ord FROM dependencies GROUP BY from_id, to_id", "dependencies")
def dependencies_last_wins(p):
    return K.distinct_first(p.dependencies.select("from_id", "to_id", "kind", "ord"), ["from_id", "to_id"], last=True)


@query("SELECT id FROM (SELECT id FROM components WHERE type = 'SERVICE' UNION SELECT component_id FROM entrypoints WHERE type = 'SCHEDULER') u INTERSECT SELECT to_id FROM dependencies", "components", "entrypoints", "dependencies")
def id_sets(p):
    both = p.components.where("type = 'SERVICE'").select("id").union(p.entrypoints.where("type = 'SCHEDULER'").select("component_id")).distinct()
    return both.intersect(p.dependencies.select("to_id"))


# ---- inference


@query("SELECT d.ord, regexp_matches(lower(kind), 'injection|method|event|client|message') AS is_runtime_relevant, a.type IN ('UTILITY', 'UNKNOWN') OR b.type IN ('UTILITY', 'UNKNOWN') AS is_condensable, a.module <> b.module AS is_cross_module FROM dependencies d JOIN components a ON a.id = from_id JOIN components b ON b.id = to_id", "dependencies", "components")
def dependency_flags(p):
    return Y.dependency_flags(p.dependency_edges, p.components)


_BROKER = "CASE b WHEN 'KAFKA' THEN 'Kafka' WHEN 'JMS' THEN 'JMS' WHEN 'UNKNOWN' THEN 'Messaging (unknown broker)' END"


@query(
    f"""+ b AS (SELECT DISTINCT coalesce(broker, 'UNKNOWN') AS b FROM (SELECT broker FROM interfaces WHERE type IN ('messaging_consumer', 'messaging_producer') UNION ALL SELECT broker FROM entrypoints WHERE type = 'MESSAGING_CONSUMER') x)
SELECT 'ext:rest:' || service AS id, service AS name, 'REST_API' AS kind, 'microprofile-rest-client' AS technology, arg_min(config_key, ord) FILTER (WHERE trim(config_key) <> '') AS base_url_key FROM interfaces WHERE type = 'rest_client' AND trim(service) <> '' GROUP BY service
UNION ALL SELECT 'ext:messaging:' || lower(b), {_BROKER}, 'MESSAGE_BROKER', lower(b), NULL FROM b WHERE b <> 'IN_MEMORY'""",
    "interfaces",
    "entrypoints",
)
def external_systems_inferred(p):
    return V.external_systems(p.interfaces, p.entrypoints)


@query("SELECT DISTINCT component_id AS from_id, 'ext:rest:' || service AS to_id, 'rest-client' AS kind FROM interfaces WHERE type = 'rest_client' AND trim(service) <> '' UNION SELECT component_id, 'ext:messaging:' || lower(coalesce(broker, 'UNKNOWN')), 'messaging' FROM (SELECT component_id, broker FROM interfaces WHERE type IN ('messaging_consumer', 'messaging_producer') UNION ALL SELECT component_id, broker FROM entrypoints WHERE type = 'MESSAGING_CONSUMER') x WHERE coalesce(broker, '') <> 'IN_MEMORY'", "interfaces", "entrypoints")
def external_dependencies(p):
    return V.external_dependencies(p.interfaces, p.entrypoints)


_CHANNELS = """c AS (SELECT regexp_extract(key, '^mp\\.messaging\\.(?:incoming|outgoing)\\.(.+)\\.connector$', 1) AS conn, regexp_extract(key, '^mp\\.messaging\\.(?:incoming|outgoing)\\.(.+)\\.(?:topic|address|queue\\.name|exchange\\.name)$', 1) AS dest, lower(trim(value)) AS v, value, ord FROM config),
a AS (SELECT conn AS channel, arg_max(CASE v WHEN 'smallrye-kafka' THEN 'KAFKA' WHEN 'smallrye-mqtt' THEN 'MQTT' WHEN 'smallrye-amqp' THEN 'AMQP' WHEN 'smallrye-rabbitmq' THEN 'RABBITMQ' WHEN 'smallrye-pulsar' THEN 'PULSAR' ELSE 'UNKNOWN' END, ord) AS broker FROM c WHERE conn <> '' GROUP BY conn),
d AS (SELECT dest AS channel, arg_min(value, ord) AS topic FROM c WHERE conn = '' AND dest <> '' GROUP BY dest),
channels AS (SELECT channel, coalesce(broker, 'UNKNOWN') AS broker, topic FROM a FULL JOIN d USING (channel))"""


@query("+ " + _CHANNELS + " SELECT * FROM channels", "config")
def broker_config(p):
    return V.channel_config(p.config)


@query("+ " + _CHANNELS + ", f AS (SELECT app_id, 'channel' || (t.ord % 25)::VARCHAR AS channel FROM interfaces t JOIN components m ON m.id = t.component_id WHERE t.type = 'messaging_producer'), r AS (SELECT app_id, channel FROM entrypoints e JOIN components m ON m.id = e.component_id WHERE e.type = 'MESSAGING_CONSUMER' AND channel IS NOT NULL) SELECT * FROM (SELECT * FROM f INTERSECT SELECT * FROM r) x WHERE channel NOT IN (SELECT channel FROM channels WHERE broker <> 'UNKNOWN')", "config", "interfaces", "components", "entrypoints")
def in_memory_channels(p):
    feeds = p.interfaces.where("type = 'messaging_producer'").select("component_id", F.concat(F.lit("channel"), (F.col("ord") % 25).cast("string")).alias("channel"))
    return V.in_memory_channels(p.entrypoints, p.components, feeds, V.channel_config(p.config))


@query("SELECT app_id || ':' || key AS id, regexp_matches(value, '\\$\\{[^}]+\\}') IS NOT TRUE AS resolved FROM config WHERE NOT regexp_matches(lower(key), 'password|secret|token|credential|private[-_.]?key|api[-_.]?key')", "config")
def config_properties(p):
    from weftgraph.operators.answers import is_expanded, is_secret

    return p.config.where(~is_secret(F.col("key"))).select(F.concat_ws(":", "app_id", "key").alias("id"), is_expanded(F.col("value")).alias("resolved"))


@query("SELECT name, endpoint, false AS unresolved FROM datasources UNION ALL SELECT DISTINCT datasource, NULL, true FROM units WHERE datasource IS NOT NULL AND datasource NOT IN (SELECT name FROM datasources)", "units", "datasources")
def persistence_reconcile(p):
    return V.reconcile_datasources(p.units, p.datasources)


@query("+ m AS (SELECT n_name AS name, (n_nationkey % 5)::BIGINT AS annotated, (n_nationkey % 3)::BIGINT AS deep_packages, lower(n_name || CASE n_nationkey % 4 WHEN 0 THEN '-service' WHEN 1 THEN '-util' WHEN 2 THEN '-core-api' ELSE '' END) AS full_name FROM nation), s AS (SELECT full_name AS name, (CASE WHEN annotated > 0 THEN 2 ELSE 0 END + CASE WHEN annotated >= 3 THEN 1 ELSE 0 END + CASE WHEN deep_packages >= 2 THEN 1 ELSE 0 END - CASE WHEN regexp_matches(full_name, 'util|dto|common|api|base|shared') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(full_name, 'service|domain|business|core|impl') THEN 1 ELSE 0 END)::INTEGER AS score FROM m) SELECT name, score, CASE WHEN score >= 2 THEN 'internal_module' ELSE 'technical_library' END AS role FROM s", "paths")
def module_roles(p):
    k = F.col("n_nationkey")
    name = F.lower(F.concat("n_name", F.when(k % 4 == 0, "-service").when(k % 4 == 1, "-util").when(k % 4 == 2, "-core-api").otherwise("")))
    return Y.module_role(p.table("nation").select(name.alias("name"), (k % 5).alias("annotated"), (k % 3).alias("deep_packages")))


@query("+ up(supertype, subtype) AS (SELECT extends, id FROM type_facts WHERE extends IS NOT NULL UNION SELECT up.supertype, t.id FROM up JOIN type_facts t ON t.extends = up.subtype) SELECT * FROM up", "type_facts")
def supertype_closure(p):
    return K.subtypes(p.type_facts)


@query(
    """+ up(supertype, subtype) AS (SELECT extends, id FROM type_facts WHERE extends IS NOT NULL UNION SELECT up.supertype, t.id FROM up JOIN type_facts t ON t.extends = up.subtype),
x AS (SELECT id AS declared, id AS target, -1 AS o FROM type_facts WHERE concrete UNION ALL SELECT supertype, subtype, ord FROM up JOIN type_facts t ON t.id = subtype WHERE concrete), r AS (SELECT *, row_number() OVER (PARTITION BY declared ORDER BY o) AS k, count(*) OVER (PARTITION BY declared) AS n FROM x)
SELECT declared, target, n > 25 AS capped FROM r WHERE k <= 25 UNION ALL SELECT id, id, false FROM type_facts WHERE id NOT IN (SELECT declared FROM x)""",
    "type_facts",
)
def polymorphic_expansion(p):
    return K.expand_types(p.type_facts)


@query("+ k AS (SELECT component_id, arg_max('container' || (p_partkey % 9)::VARCHAR, (p_partkey, 'container' || (p_partkey % 9)::VARCHAR)) AS container FROM (SELECT p_partkey, 'comp:' || (p_partkey % 100)::VARCHAR AS component_id FROM part) m GROUP BY component_id) SELECT container, count(*) AS n FROM entrypoints JOIN k USING (component_id) GROUP BY container", "entrypoints")
def entrypoints_per_last_container(p):
    k = F.col("p_partkey")
    membership = p.table("part").select(k.alias("ord"), F.concat(F.lit("container"), (k % 9).cast("string")).alias("container"), F.concat(F.lit("comp:"), (k % 100).cast("string")).alias("component_id"))
    return V.entrypoints_per_container(membership, p.entrypoints)


@query(
    _STORE
    + """ SELECT (SELECT count(*) FROM paths) AS total_paths, (SELECT count(DISTINCT path_id) FROM sinks WHERE id IN (SELECT sink_id FROM links)) AS linked_paths, count(*) FILTER (WHERE kind IN ('MESSAGING', 'EVENT_BUS')) AS messaging_sinks,
 count(*) FILTER (WHERE kind IN ('MESSAGING', 'EVENT_BUS') AND (coalesce(topic, channel, '') = '' OR contains(coalesce(topic, channel), '${') OR coalesce(topic, channel) = '(unresolved)')) AS unresolved_messaging,
 count(*) FILTER (WHERE kind = 'PERSISTENCE' AND regexp_matches(operation, '^(save|delete)')) AS persistence_writes, count(*) FILTER (WHERE kind = 'PERSISTENCE' AND regexp_matches(operation, '^(find|get|read|exists)')) AS persistence_reads,
 (SELECT count(DISTINCT channel) FROM entrypoints WHERE type IN ('MESSAGING_CONSUMER', 'JMS_CONSUMER') AND trim(channel) <> '' AND channel <> '(unresolved)') AS consumer_topics FROM sinks""",
    "sinks",
    "paths",
    "entrypoints",
)
def pipeline_counts(p):
    return V.pipeline_diagnostic(p.paths, p.sinks, _store_links(p), p.entrypoints)


# ---- views and reports

_RANK = "workflow_relevant DESC, business_relevant DESC, bridge_score DESC, noise_score, weight DESC, name"


def _scored(p):
    return M.relevance(_metrics(p))


@query(_METRICS + f" SELECT id, weight FROM (SELECT * FROM scored ORDER BY ord LIMIT 500) x WHERE id IN (SELECT dst FROM (SELECT * FROM model_edges WHERE label = 'OWNS' ORDER BY ord LIMIT 100) o WHERE src = 'app:3') ORDER BY {_RANK} LIMIT 12", *_SCORED, "model_edges")
def component_view_nodes(p):
    return V.component_view(_scored(p), p.model_edges, 12, "app:3")[0].select("id", "weight")


@query(_METRICS + f", top AS (SELECT id FROM (SELECT * FROM scored ORDER BY ord LIMIT 500) x ORDER BY {_RANK} LIMIT 25) SELECT label, src, dst FROM model_edges WHERE label IN ('DEPENDS_ON', 'READS_STATE', 'WRITES_STATE', 'STARTS_AT') AND src IN (SELECT id FROM top) AND dst IN (SELECT id FROM top) AND src <> dst GROUP BY ALL", *_SCORED, "model_edges")
def component_view_edges(p):
    return V.component_view(_scored(p), p.model_edges, 25)[1].select("label", "src", "dst")


@query(_METRICS + " SELECT id, noise_score, weight FROM (SELECT * FROM scored ORDER BY ord LIMIT 100) x ORDER BY workflow_relevant DESC, business_relevant DESC, noise_score, weight DESC, id LIMIT 12", *_SCORED)
def high_signal_components(p):
    return V.high_signal(_scored(p)).select("id", F.col("noise_score").cast("long").alias("noise_score"), "weight")


@query("SELECT o AS ord, c AS confidence FROM (SELECT d.ord AS o, d.confidence AS c FROM dependencies d JOIN components a ON a.id = from_id JOIN components b ON b.id = to_id WHERE a.module <> b.module ORDER BY d.ord LIMIT 100) x ORDER BY c DESC, o LIMIT 20", "dependencies", "components")
def cross_module_dependencies(p):
    return V.cross_module(p.dependency_edges, Y.dependency_flags(p.dependency_edges, p.components), 20).select("ord", "confidence")


_PRIMARY = "('" + "', '".join(V.PRIMARY_TYPES) + "')"


def _workspace(most: int, scope: str | None = None) -> str:
    """The budgets as the rule states them, each from the rows that were chosen before."""
    owned = f" AND {{}} IN (SELECT dst FROM model_edges WHERE label = 'OWNS' AND src = '{scope}')" if scope else ""
    return (
        _METRICS
        + f""", mine AS (SELECT * FROM scored WHERE true{owned.format("id")}), doors AS (SELECT * FROM entrypoints WHERE true{owned.format("component_id")}),
ep AS (SELECT id, component_id FROM doors ORDER BY CASE type WHEN 'MESSAGING_CONSUMER' THEN 0 WHEN 'SCHEDULER' THEN 1 WHEN 'REST_ENDPOINT' THEN 2 WHEN 'MAIN_METHOD' THEN 3 ELSE 4 END, name, id LIMIT greatest(1, least(8, {most} // 3))),
forced AS (SELECT component_id AS id FROM ep UNION SELECT to_id FROM dependencies WHERE from_id IN (SELECT component_id FROM ep)),
prim AS (SELECT id FROM mine WHERE type IN {_PRIMARY} QUALIFY row_number() OVER (ORDER BY (id IN (SELECT id FROM forced)) DESC, {_RANK}) <= greatest(1, {most} - (SELECT count(*) FROM ep))),
used AS (SELECT {most} - (SELECT count(*) FROM ep) - (SELECT count(*) FROM prim) AS room),
touch AS (SELECT DISTINCT src, dst, label FROM model_edges WHERE label IN ('DEPENDS_ON', 'READS_STATE', 'WRITES_STATE', 'STARTS_AT') AND src <> dst), lk AS (SELECT id, count(*) AS links FROM (SELECT src AS id, dst AS other FROM touch UNION ALL SELECT dst, src FROM touch) t WHERE other IN (SELECT id FROM prim) GROUP BY id),
ent AS (SELECT s.id FROM mine s JOIN lk ON lk.id = s.id WHERE type = 'ENTITY' QUALIFY row_number() OVER (ORDER BY links DESC, business_relevant DESC, noise_score, name) <= (SELECT CASE WHEN room <= 0 THEN 0 ELSE least(room, 4, greatest(1, {most} // 5)) END FROM used)),
have AS (SELECT id FROM prim UNION ALL SELECT id FROM ent), fill AS (SELECT id FROM mine WHERE type <> 'ENTITY' AND id NOT IN (SELECT id FROM have) QUALIFY row_number() OVER (ORDER BY noise_score, weight DESC, name) <= {most} - (SELECT count(*) FROM have))
SELECT 'entrypoint' AS role, id FROM ep UNION ALL SELECT 'primary', id FROM prim UNION ALL SELECT 'entity', id FROM ent UNION ALL SELECT 'fill', id FROM fill"""
    )


@query(_workspace(21), *_SCORED, "model_edges")
def workspace_budget(p):
    return V.workspace(_scored(p), p.entrypoints, p.model_edges, 21)


@query(_workspace(60, "app:3"), *_SCORED, "model_edges")
def workspace_of_application(p):
    return V.workspace(_scored(p), p.entrypoints, p.model_edges, 60, "app:3")


@query("SELECT DISTINCT lower(b) || '_flow' AS view, 'topic:' || b || ':' || channel AS source, component_id AS target, 'consumes ' || channel AS title FROM (SELECT *, coalesce(broker, 'UNKNOWN') AS b FROM entrypoints WHERE type = 'MESSAGING_CONSUMER') e", "entrypoints")
def broker_views(p):
    return V.broker_views(p.entrypoints)


@query(_CHAINS + ", seg AS (SELECT array_to_string(ids, '>') AS chain, (i - 1)::INTEGER AS segment_index, ids[i] AS path_id FROM (SELECT ids, unnest(range(1, len(ids) + 1)) AS i FROM chains)), s AS (SELECT path_id, count(*) AS n_sinks, arg_min(id, regexp_extract(id, ':sink:(\\d+)$', 1)::INTEGER) AS first_sink FROM sinks GROUP BY path_id) SELECT a.chain, a.segment_index, a.path_id, x.entrypoint_id, coalesce(s.n_sinks, 0) AS n_sinks, t.first_sink AS incoming_sink FROM seg a JOIN paths x ON x.id = a.path_id LEFT JOIN s ON s.path_id = a.path_id LEFT JOIN seg b ON b.chain = a.chain AND b.segment_index = a.segment_index - 1 LEFT JOIN s t ON t.path_id = b.path_id", "paths", "sinks")
def reconstructed_chains(p):
    from weftgraph.operators import chains as C

    return V.reconstruct_chains(C.segments(C.chains(*_chain_parts(p))), p.sinks, p.entrypoints, p.paths)


_SLICES = "seg AS (SELECT entrypoint_id AS slice, id FROM paths), bound AS (SELECT x.entrypoint_id AS slice, s.id FROM sinks s JOIN paths x ON x.id = s.path_id WHERE s.kind = 'MESSAGING')"


@query(
    "+ " + _SLICES + """, spine AS (SELECT slice, src, dst, label, ord FROM model_edges JOIN seg ON seg.id = dst WHERE label = 'ORIGINATES' UNION SELECT seg.slice, src, dst, label, ord FROM model_edges JOIN seg ON seg.id = src JOIN bound ON bound.id = dst AND bound.slice = seg.slice WHERE label = 'REACHES'),
aims AS (SELECT slice, src, dst, label, ord FROM model_edges JOIN bound ON bound.id = src WHERE label = 'AT_COMPONENT'), picked AS (SELECT * FROM spine UNION SELECT * FROM aims), ids AS (SELECT slice, id FROM seg UNION SELECT slice, src FROM picked UNION SELECT slice, dst FROM picked)
SELECT * FROM picked UNION SELECT a.slice, src, dst, label, ord FROM model_edges JOIN ids a ON a.id = src JOIN ids b ON b.id = dst AND b.slice = a.slice""",
    "paths",
    "sinks",
    "model_edges",
)
def pipeline_projection(p):
    seg = p.paths.select(F.col("entrypoint_id").alias("slice"), "id")
    bound = p.sinks.where("kind = 'MESSAGING'").join(p.paths.select(F.col("id").alias("path_id"), F.col("entrypoint_id").alias("slice")), "path_id").select("slice", "id")
    return V.project_pipeline(seg, bound, p.model_edges)


# ---- names, identities, branching chains, links of every kind


@query(
    """+ r AS (SELECT 'r' || n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 'I' ELSE '' END || 'E' || (n_nationkey % 8) || 'Repository' AS name, 'com.x' || (n_nationkey % 2) || CASE WHEN n_nationkey % 7 = 6 THEN '.dao.' ELSE '.repository.' END || 'T' || n_nationkey AS qualified_name FROM nation),
k AS (SELECT 'com.x' || (n_nationkey % 2) || CASE n_nationkey % 3 WHEN 2 THEN '.other.' ELSE '.model.' END || 'E' || (n_nationkey % 8) || CASE WHEN n_nationkey % 3 = 1 THEN 'Entity' ELSE '' END AS qualified_name, 'E' || (n_nationkey % 8) || CASE WHEN n_nationkey % 3 = 1 THEN 'Entity' ELSE '' END AS name FROM nation),
b AS (SELECT id, regexp_extract(qualified_name, '^(.*)\\.repository\\.', 1) AS base, regexp_replace(regexp_replace(name, '^I', ''), 'Repository$', '') AS x FROM r),
c AS (SELECT id, q.qualified_name AS entity, 0 AS rank FROM b JOIN k q ON q.qualified_name = base || '.model.' || x WHERE base <> '' UNION SELECT id, q.qualified_name, 1 FROM b JOIN k q ON q.qualified_name = base || '.model.' || x || 'Entity' WHERE base <> '' UNION SELECT id, q.qualified_name, 2 FROM b JOIN k q ON q.name = x AND starts_with(q.qualified_name, base || '.') WHERE base <> '')
SELECT r.id, (SELECT entity FROM c WHERE c.id = r.id ORDER BY rank, entity LIMIT 1) AS entity FROM r""",
    "paths",
)
def repository_entities(p):
    k, text = F.col("n_nationkey"), lambda c: c.cast("string")
    n = p.table("nation")
    repositories = n.select(F.concat(F.lit("r"), text(k)).alias("id"), F.concat(F.when(k % 3 == 0, "I").otherwise(""), F.lit("E"), text(k % 8), F.lit("Repository")).alias("name"), F.concat(F.lit("com.x"), text(k % 2), F.when(k % 7 == 6, ".dao.").otherwise(".repository."), F.lit("T"), text(k)).alias("qualified_name"))
    name = F.concat(F.lit("E"), text(k % 8), F.when(k % 3 == 1, "Entity").otherwise(""))
    known = n.select(F.concat(F.lit("com.x"), text(k % 2), F.when(k % 3 == 2, ".other.").otherwise(".model."), name).alias("qualified_name"), name.alias("name"))
    return K.repository_entities(repositories, known)


@query("SELECT id, 'investigations/impact/' || id || '-' || substr(sha256('{\"family\":\"impact\",\"request\":{\"component\":\"' || id || '\",\"maxDepth\":4}}'), 1, 12) || '.md' AS path FROM components", "components")
def concept_paths(p):
    key = F.sha2(F.to_json(F.struct(F.lit("impact").alias("family"), F.struct(F.col("id").alias("component"), F.lit(4).alias("maxDepth")).alias("request"))), 256)
    return p.components.select("id", F.concat(F.lit("investigations/impact/"), "id", F.lit("-"), F.substring(key, 1, 12), F.lit(".md")).alias("path"))


_BRANCHES = "SELECT DISTINCT 'path:' || cast(o_orderkey as string) AS from_path, 'path:' || cast(nxt as string) AS to_path FROM (SELECT o_orderkey, lead(o_orderkey, 1) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) UNION ALL SELECT o_orderkey, lead(o_orderkey, 2) OVER w FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey)) o WHERE nxt IS NOT NULL"


def _branching(p):
    from weftgraph.operators import chains as C

    paths, _ = _chain_parts(p)
    links = p.spark.sql(_BRANCHES.replace("FROM orders", "FROM {o}"), o=p.table("orders"))
    return C.chains(paths, links)


def _branching_sql() -> str:
    from weftgraph.plans.registry import _CHAIN_LINKS

    return _CHAINS.replace(_CHAIN_LINKS, _BRANCHES)


@query(_branching_sql() + " SELECT array_to_string(ids, '>') AS ids FROM chains", "paths")
def branching_chains(p):
    return _branching(p).select(F.array_join("ids", ">").alias("ids"))


@query(_branching_sql() + ", left_over AS (SELECT * FROM chains c WHERE NOT EXISTS (SELECT 1 FROM chains d WHERE len(d.ids) > len(c.ids) AND d.ids[1] = c.ids[1] AND d.ids[1:len(c.ids) - 1] = c.ids[1:len(c.ids) - 1])) SELECT array_to_string(eps, '>') AS eps, array_to_string(min(ids), '>') AS ids FROM left_over GROUP BY eps", "paths")
def branching_chains_reduced(p):
    """Prefixes removed, then one chain for each sequence of entrypoints."""
    from weftgraph.operators import chains as C

    out = C.without_duplicates(C.without_prefixes(_branching(p)))
    return out.select(F.array_join("eps", ">").alias("eps"), F.array_join("ids", ">").alias("ids"))


_KEY = "CASE WHEN %sbroker IS NOT NULL THEN upper(%sbroker) || ':' || coalesce(%stopic, %schannel) END"


def _all_links_sql() -> str:
    from weftgraph.plans.registry import _WORKFLOW

    kinds = f"""links0 AS (SELECT DISTINCT a.id AS sink_id, a.path_id, b.path_id AS target FROM s a JOIN s b ON a.owner_id = b.owner_id AND a.field = b.field WHERE a.kind = 'STORE' AND b.kind = 'PERSISTENCE' AND a.path_id <> b.path_id AND a.entrypoint_id <> b.entrypoint_id),
bus AS (SELECT s.id AS sink_id, s.path_id, x.id AS target FROM sinks s JOIN entrypoints e ON e.channel = s.channel AND e.type = 'EVENT_BUS_CONSUMER' JOIN paths x ON x.entrypoint_id = e.id WHERE s.kind = 'EVENT_BUS' AND x.id <> s.path_id),
loose AS (SELECT s.id AS sink_id, s.path_id, x.id AS target FROM sinks s JOIN entrypoints e ON e.type = 'MESSAGING_CONSUMER' AND e.channel = s.channel JOIN paths x ON x.entrypoint_id = e.id WHERE s.kind = 'MESSAGING' AND s.broker IS NULL AND x.id <> s.path_id),
msg AS (SELECT * FROM loose UNION SELECT s.id AS sink_id, s.path_id, x.id AS target FROM sinks s JOIN entrypoints e ON e.type = 'MESSAGING_CONSUMER' AND {_KEY.replace('%s', 'e.')} = {_KEY.replace('%s', 's.')} JOIN paths x ON x.entrypoint_id = e.id WHERE s.kind = 'MESSAGING' AND x.id <> s.path_id),
per AS (SELECT w.id AS sink_id, w.path_id, r.path_id AS target FROM s w JOIN s r ON w.entity = r.entity JOIN entrypoints e ON e.id = r.entrypoint_id WHERE w.kind = 'PERSISTENCE' AND r.kind = 'PERSISTENCE' AND w.operation = 'save' AND r.operation = 'findById' AND w.path_id <> r.path_id AND e.type NOT IN ('REST_ENDPOINT', 'GRPC_METHOD')),
links AS (SELECT * FROM links0 UNION SELECT * FROM bus UNION SELECT * FROM msg UNION SELECT * FROM per)"""
    a, b = _WORKFLOW.index("links AS (SELECT DISTINCT"), _WORKFLOW.index(", pe AS (")
    return _WORKFLOW[:a] + kinds + _WORKFLOW[b:]


@query(_all_links_sql() + " SELECT kind, from_path, to_path, sink_id, confidence FROM wl", "sinks", "paths", "entrypoints")
def workflow_links_all(p):
    """Links of every kind: state handoffs, event bus, messages and persistence."""
    return L.workflow_links_of(p.sinks, p.paths, p.entrypoints)


# ---- requests

_ASKED = """asked AS (SELECT c_custkey AS ord, CASE c_custkey % 5 WHEN 0 THEN 'endpoint_context' WHEN 1 THEN 'impact' WHEN 2 THEN 'relationship' WHEN 3 THEN 'state_lifecycle' ELSE 'messaging_flow' END AS family,
  CASE WHEN c_custkey % 7 < 5 THEN c_name END AS subject_id, CASE c_custkey % 7 WHEN 0 THEN 'Entrypoint' WHEN 1 THEN 'Component' WHEN 2 THEN 'DataSource' END AS subject_label, CASE WHEN c_custkey % 7 = 3 THEN 'stock' END AS subject_field, CASE WHEN c_custkey % 7 IN (3, 5) THEN 'where' END AS subject_query,
  CASE c_custkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'order' END AS param, CASE WHEN c_custkey % 11 = 0 THEN 'save' END AS method, CASE WHEN c_custkey % 13 = 0 THEN 'cache' END AS field, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) END AS query, CASE WHEN c_custkey % 4 = 1 THEN 'comp:1' END AS target,
  CASE WHEN c_custkey % 3 = 2 THEN 7 END AS max_depth FROM customer)"""


_REQUESTS = _ASKED + """, v AS (SELECT *, subject_label IS NOT DISTINCT FROM 'Entrypoint' AND subject_id IS NOT NULL AS e, subject_label IS NOT DISTINCT FROM 'Component' AND subject_id IS NOT NULL AS c FROM asked),
f AS (SELECT ord, family, CASE WHEN c THEN subject_id END AS component, CASE WHEN e THEN subject_id END AS entrypoint, coalesce(nullif(trim(field), ''), CASE WHEN NOT e AND NOT c THEN subject_field END) AS field,
  CASE WHEN family IN ('impact', 'relationship') OR (family = 'endpoint_context' AND NOT e) THEN coalesce(max_depth, CASE family WHEN 'relationship' THEN 2 ELSE 4 END) END AS depth, nullif(trim(method), '') AS method, CASE WHEN family = 'endpoint_context' THEN CASE WHEN e THEN 'forward' ELSE 'reverse' END END AS mode, nullif(trim(param), '') AS param,
  coalesce(CASE WHEN family IN ('state_lifecycle', 'messaging_flow') THEN nullif(trim(query), '') END, CASE WHEN NOT e AND NOT c AND subject_field IS NULL THEN subject_query END) AS query, CASE WHEN NOT e AND NOT c AND subject_field IS NULL AND subject_query IS NULL THEN subject_id END AS subject, CASE WHEN family = 'relationship' THEN nullif(trim(target), '') END AS target FROM v)
SELECT ord, family, '{' || concat_ws(',', '"component":"' || component || '"', '"entrypoint":"' || entrypoint || '"', '"field":"' || field || '"', '"maxDepth":' || depth::VARCHAR, '"method":"' || method || '"', '"mode":"' || mode || '"', '"param":"' || param || '"', '"query":"' || query || '"', '"subject":"' || subject || '"', '"target":"' || target || '"') || '}' AS request FROM f"""


@query("+ " + _REQUESTS, "apps")
def requests_normalized(p):
    """Questions as the requests that tell them apart."""
    from weftgraph.operators import questions as Q

    k = F.col("c_custkey")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    asked = p.table("customer").select(
        k.alias("ord"), pick(5, "endpoint_context", "impact", "relationship", "state_lifecycle", "messaging_flow").alias("family"), F.when(k % 7 < 5, F.col("c_name")).alias("subject_id"), pick(7, "Entrypoint", "Component", "DataSource", None, None, None, None).alias("subject_label"),
        F.when(k % 7 == 3, "stock").alias("subject_field"), F.when((k % 7).isin(3, 5), "where").alias("subject_query"), pick(3, " ", "order", None).alias("param"), F.when(k % 11 == 0, "save").alias("method"), F.when(k % 13 == 0, "cache").alias("field"),
        F.when(k % 2 == 0, F.lower("c_mktsegment")).alias("query"), F.when(k % 4 == 1, "comp:1").alias("target"), F.when(k % 3 == 2, 7).alias("max_depth"),
    )
    return Q.requests(asked).select("ord", "family", "request")
