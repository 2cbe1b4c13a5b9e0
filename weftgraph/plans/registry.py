"""The graph queries: each over whole tables, with the SQL that says the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import scalar as X
from weftgraph.operators import chains as C
from weftgraph.operators import filters as P
from weftgraph.operators import linkers as L
from weftgraph.operators import metrics as M
from weftgraph.operators import ordered as O
from weftgraph.operators import questions as Q
from weftgraph.operators import rollup as R
from weftgraph.operators import scan as S
from weftgraph.operators import traverse as T
from weftgraph.plans.projection import Projection, with_tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *relations: str):
    """Register a function of a Projection under its name, with an oracle that starts from `relations`."""

    def add(f: Callable[[Projection], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Projection(spark, sf_dir))
        if sql:
            head = with_tables(*relations)
            ORACLES[f.__name__] = head + (", " if sql.lstrip().startswith("+") else " ") + sql.lstrip().removeprefix("+")
        return f

    return add


def _ids(p: Projection, *ids: str) -> DataFrame:
    return p.spark.createDataFrame([(i,) for i in ids], "id string")


# ---- scans and predicates


@query("SELECT label, count(*) AS n FROM nodes GROUP BY label", "nodes")
def graph_summary_nodes(p):
    return S.summary(p.nodes)


@query("SELECT label, count(*) AS n FROM edges GROUP BY label", "edges")
def graph_summary_edges(p):
    return S.summary(p.edges)


@query("SELECT id, label FROM nodes WHERE lower(label) = 'part' AND contains(lower(ptype), 'eco') AND contains(lower(name), 'ring')", "nodes")
def find_nodes_text(p):
    return S.find_nodes(p.nodes, {"ptype": " Eco ", "name": "RING", "brand": "  "}, label="PART").select("id", "label")


@query("SELECT id FROM nodes WHERE acctbal >= 5000 AND acctbal < 9000.5", "nodes")
def find_nodes_numeric(p):
    return P.matching(P.matching(p.nodes, {"acctbal": ">= 5000"}), {"acctbal": "<9000.5"}).select("id")


@query("SELECT id FROM nodes WHERE contains(lower(segment), 'build') AND acctbal > 1000", "nodes")
def find_nodes_and(p):
    return S.find_nodes(p.nodes, P.merge_filters({"segment": "auto"}, segment="BUILD", acctbal=">1000")).select("id")


@query(
    """SELECT id, label FROM nodes WHERE contains(lower(id), 'red') OR (label IN ('Region', 'Nation', 'Supplier', 'User') AND contains(lower(name), 'red'))
    OR (label = 'Customer' AND (contains(lower(name), 'red') OR contains(lower(segment), 'red'))) OR (label = 'Part' AND (contains(lower(name), 'red') OR contains(lower(brand), 'red') OR contains(lower(ptype), 'red')))
    OR (label = 'Order' AND (contains(lower(name), 'red') OR contains(lower(status), 'red') OR contains(lower(priority), 'red')))""",
    "nodes",
)
def find_nodes_free_text(p):
    return S.find_nodes(p.nodes, text="Red").select("id", "label")


@query("SELECT src, dst, ord FROM edges WHERE quantity >= 45 AND discount <= 0.02 AND label = 'HAS_ITEM' ORDER BY ord LIMIT 50000", "edges")
def find_edges_filter(p):
    return S.find_edges(P.matching(p.edges, {"discount": "<=0.02"}), {"quantity": ">=45"}, label="has_item", limit=60_000).select("src", "dst", "ord")


@query("SELECT src, dst, label, ord FROM edges ORDER BY ord LIMIT 25", "edges")
def find_edges_default_limit(p):
    return S.find_edges(p.edges, limit=0).select("src", "dst", "label", "ord")


@query("SELECT src, dst, label, min(ord) AS ord FROM edges WHERE label = 'SUPPLIED_BY' GROUP BY src, dst, label", "edges")
def find_edges_between(p):
    return S.edges_between(p.edges, p.nodes.where("label in ('Part', 'Supplier')"), ("SUPPLIED_BY", "HAS_ITEM"), whole=False)


@query("SELECT count(*) AS n FROM nodes WHERE lower(label) = 'order'", "nodes")
def count_by_label(p):
    return S.count_by_label(p.nodes, "Order")


@query("SELECT id, name, CASE id WHEN 'part:7' THEN 0 WHEN 'nation:3' THEN 1 WHEN 'customer:5' THEN 3 END AS at FROM nodes WHERE id IN ('part:7', 'nation:3', 'customer:5')", "nodes")
def nodes_by_ids(p):
    return S.by_ids(p.nodes, ["part:7", "nation:3", "part:7", "customer:5", "missing:1"]).select("id", "name", "at")


@query("SELECT id, name FROM components WHERE name = 'Config' OR contains(qualified_name, 'Config') ORDER BY CASE WHEN id = 'Config' THEN 0 ELSE 1 END, ord LIMIT 1", "components")
def resolve_component(p):
    return S.resolve_component(p.components, "Config").select("id", "name")


@query(
    """SELECT id, path FROM entrypoints WHERE lower(http_method) = 'get' AND (lower(path) = '/building' OR starts_with(lower(path), '/building/') OR starts_with(lower(path), '/building{'))
    ORDER BY CASE WHEN lower(path) = '/building' THEN 1 ELSE 2 END, ord LIMIT 1""",
    "entrypoints",
)
def resolve_entrypoint(p):
    return S.resolve_entrypoint(p.entrypoints, "GET /building").select("id", "path")


@query("SELECT CASE WHEN found = 0 THEN 'unresolved' WHEN found = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, found AS candidates FROM (SELECT count(*) AS found FROM components WHERE contains(qualified_name, 'Mapper')) x", "components")
def resolution_status(p):
    return Q.component_status(p.components, "Mapper")


def _neighborhood(test: str) -> str:
    return f"SELECT src, dst, label, ord FROM edges WHERE {test} ORDER BY ord LIMIT 100"


@query(_neighborhood("dst = 'supplier:3'"), "edges")
def neighborhood_in(p):
    return S.neighborhood(p.edges, "supplier:3", "incoming", 1000).select("src", "dst", "label", "ord")


@query("SELECT src, dst, label, ord FROM edges WHERE src = 'order:12' ORDER BY ord LIMIT 25", "edges")
def neighborhood_out(p):
    return S.neighborhood(p.edges, "order:12", "out").select("src", "dst", "label", "ord")


@query(_neighborhood("src = 'part:9' OR dst = 'part:9'"), "edges")
def neighborhood_both(p):
    return S.neighborhood(p.edges, "part:9", "any", 256).select("src", "dst", "label", "ord")


@query("SELECT id FROM components WHERE contains(lower(type), 'service') AND contains(lower(technology), 'a')", "components")
def find_components(p):
    return S.find_components(p.components, "service", "A").select("id")


@query("SELECT id FROM components WHERE contains(lower(app_id), 'app:1') AND contains(lower(type), 'ser') AND lower(technology) = 'asia'", "components")
def find_components_in_app(p):
    return S.find_components(p.components, "SER", "Asia", "app:1").select("id")


@query("SELECT id, path FROM entrypoints WHERE lower(type) = 'rest_endpoint' AND lower(http_method) = 'get' AND (lower(path) = '/machinery' OR starts_with(lower(path), '/machinery/') OR starts_with(lower(path), '/machinery{'))", "entrypoints")
def find_entrypoints(p):
    return S.find_entrypoints(p.entrypoints, "rest_endpoint", "get", "/machinery").select("id", "path")


@query("SELECT id FROM paths p WHERE EXISTS (SELECT 1 FROM sinks s WHERE s.path_id = p.id AND lower(s.kind) = 'messaging') AND contains(param, 'urgent')", "paths", "sinks")
def trace_data_flow_filter(p):
    return p.paths.where(F.contains("param", F.lit("urgent"))).join(p.sinks.where("lower(kind) = 'messaging'").select(F.col("path_id").alias("id")), "id", "left_semi").select("id")


# ---- metrics


@query("SELECT n.id, (SELECT count(*) FROM edges e WHERE e.dst = n.id AND label = 'SUPPLIED_BY') AS fan_in, (SELECT count(*) FROM edges e WHERE e.src = n.id AND label = 'SUPPLIED_BY') AS fan_out, (SELECT count(*) FROM edges e WHERE e.dst = n.id AND label = 'SUPPLIED_BY') + (SELECT count(*) FROM edges e WHERE e.src = n.id AND label = 'SUPPLIED_BY') AS degree FROM nodes n", "nodes", "edges")
def degree(p):
    return M.degrees(p.nodes, p.edges, "SUPPLIED_BY")


@query("SELECT c.id, count(e.id) AS owned FROM components c LEFT JOIN entrypoints e ON e.component_id = c.id GROUP BY c.id", "components", "entrypoints")
def owned_count(p):
    return M.owned_entrypoints(p.components, p.entrypoints)


_STATE = """SELECT c.id, count(a.ord) FILTER (WHERE kind = 'READ') AS reads, count(a.ord) FILTER (WHERE kind = 'WRITE') AS writes,
 count(a.ord) FILTER (WHERE kind = 'READ' AND owner_id <> component_id) AS cross_reads, count(a.ord) FILTER (WHERE kind = 'WRITE' AND owner_id <> component_id) AS cross_writes FROM components c LEFT JOIN accesses a ON a.component_id = c.id GROUP BY c.id"""


@query(_STATE, "components", "accesses")
def cross_state_counts(p):
    return M.state_counts(p.components, p.accesses)


_METRICS = f"""+ state AS ({_STATE}), handoff AS (SELECT DISTINCT w.component_id AS writer, r.component_id AS reader, w.owner_id, w.field FROM accesses w JOIN accesses r ON w.owner_id = r.owner_id AND w.field = r.field WHERE w.kind = 'WRITE' AND r.kind = 'READ' AND w.component_id <> r.component_id),
m AS (SELECT c.*, lower(c.name) AS ln, s.cross_reads, s.cross_writes, (SELECT count(*) FROM dependencies d WHERE d.to_id = c.id) AS fan_in, (SELECT count(*) FROM dependencies d WHERE d.from_id = c.id) AS fan_out,
  (SELECT count(*) FROM entrypoints e WHERE e.component_id = c.id) AS owned, (SELECT count(*) FROM handoff h WHERE h.reader = c.id) AS handoffs_in, (SELECT count(*) FROM handoff h WHERE h.writer = c.id) AS handoffs_out FROM components c JOIN state s ON s.id = c.id),
n AS (SELECT *, CASE type WHEN 'UTILITY' THEN 3 WHEN 'UNKNOWN' THEN 2 ELSE 0 END + CASE WHEN regexp_matches(ln, 'formatter|parser|mapper|logger|logging|config') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(ln, 'dto|request|response|properties|constants') THEN 1 ELSE 0 END
  + CASE WHEN regexp_matches(package, '[.](util|common|config|logging|dto|mapper)') THEN 1 ELSE 0 END AS noise_score FROM m),
b AS (SELECT *, noise_score < 4 AND type NOT IN ('UTILITY', 'UNKNOWN') AS business_relevant, CASE type WHEN 'SCHEDULER' THEN 1 ELSE 0 END + cross_reads + cross_writes + 3 * (handoffs_in + handoffs_out) AS raw FROM n),
r AS (SELECT *, CASE WHEN business_relevant THEN raw ELSE least(raw, 2) END AS bridge_score FROM b),
scored AS (SELECT *, business_relevant AND (owned > 0 OR fan_out > 0 OR bridge_score > 0 OR type IN ('REST_RESOURCE', 'MESSAGE_DRIVEN_BEAN', 'SCHEDULER')) AS workflow_relevant,
  CASE WHEN type = 'UTILITY' THEN 'utility' WHEN contains(ln, 'formatter') THEN 'formatter' WHEN contains(ln, 'parser') THEN 'parser' WHEN contains(ln, 'mapper') THEN 'mapper' WHEN contains(ln, 'logg') THEN 'logging' WHEN regexp_matches(ln, 'config|properties') THEN 'configuration' WHEN noise_score >= 4 THEN 'utility'
   ELSE CASE type WHEN 'REST_RESOURCE' THEN 'entrypoint' WHEN 'SERVICE' THEN 'business-service' WHEN 'EJB_STATELESS' THEN 'business-service' WHEN 'REPOSITORY' THEN 'repository' WHEN 'ENTITY' THEN 'domain-entity' WHEN 'MESSAGE_DRIVEN_BEAN' THEN 'message-consumer' WHEN 'SCHEDULER' THEN 'scheduler'
    WHEN 'HTTP_CLIENT' THEN 'external-client' WHEN 'REMOTE_SERVICE' THEN 'external-client' WHEN 'UNKNOWN' THEN 'unknown' ELSE 'event-bus' END END AS infrastructure_role,
  greatest(0, least(fan_in, 3) + fan_out + 4 * owned + 3 * bridge_score + CASE WHEN business_relevant THEN 2 ELSE 0 END - 2 * noise_score) AS weight FROM r)"""
_MODEL = ("components", "accesses", "dependencies", "entrypoints")


def _metrics(p: Projection) -> DataFrame:
    c = p.components
    m = c.join(M.degrees(c, p.dependency_edges, "DEPENDS_ON"), "id").join(M.owned_entrypoints(c, p.entrypoints), "id").join(M.state_counts(c, p.accesses), "id").join(L.handoff_counts(p.accesses), "id", "left")
    return m.fillna(0, ["handoffs_in", "handoffs_out"])


@query(_METRICS + " SELECT id, noise_score, business_relevant, infrastructure_role, bridge_score, workflow_relevant, weight FROM scored", *_MODEL)
def relevance_score(p):
    return M.relevance(_metrics(p)).select("id", F.col("noise_score").cast("long"), "business_relevant", "infrastructure_role", "bridge_score", "workflow_relevant", "weight")


@query(_METRICS + " SELECT id, weight FROM scored ORDER BY workflow_relevant DESC, business_relevant DESC, bridge_score DESC, noise_score, weight DESC, name LIMIT 20", *_MODEL)
def component_priority_topk(p):
    return M.priority(M.relevance(_metrics(p)), 20).select("id", "weight")


@query(
    """+ k AS (SELECT c.*, lower(name) AS ln, contains(package, 'config') AS conf, (SELECT count(*) FROM dependencies d WHERE d.from_id = c.id) + (SELECT count(*) FROM entrypoints e WHERE e.component_id = c.id) AS busy FROM components c),
s AS (SELECT *, CASE WHEN regexp_matches(package, 'authorization|security') AND conf THEN 'security-configuration' WHEN contains(package, 'redis') AND regexp_matches(ln, 'lock|registry') THEN 'redis-lock' WHEN regexp_matches(ln, 'flyway|initializer|migration') AND regexp_matches(package, 'infrastructure|migration') THEN 'migration-initializer'
 WHEN contains(package, 'tenant') AND contains(ln, 'tenant') THEN 'tenant-infrastructure' WHEN conf OR regexp_matches(ln, 'config|properties') THEN 'configuration' WHEN regexp_matches(package, 'mapper|mapping') OR contains(ln, 'mapper') THEN 'mapper' WHEN contains(package, 'converter') OR contains(ln, 'converter') THEN 'converter'
 WHEN contains(package, 'validation') OR regexp_matches(ln, 'validator|validation') THEN 'validator' WHEN contains(ln, 'application') AND type = 'SERVICE' THEN 'application-bootstrap' WHEN type = 'UTILITY' OR contains(package, '.util') THEN 'utility' END AS support_role FROM k),
r AS (SELECT *, CASE WHEN support_role IS NOT NULL THEN 'support' ELSE CASE type WHEN 'REST_RESOURCE' THEN 'entrypoint' WHEN 'MESSAGE_DRIVEN_BEAN' THEN 'entrypoint' WHEN 'SCHEDULER' THEN 'entrypoint' WHEN 'SERVICE' THEN 'business-service' WHEN 'EJB_STATELESS' THEN 'business-service' WHEN 'REPOSITORY' THEN 'data-access' WHEN 'ENTITY' THEN 'domain-model' WHEN 'UTILITY' THEN 'support' WHEN 'UNKNOWN' THEN 'unknown' ELSE 'integration' END END AS primary_role FROM s)
SELECT id, primary_role, support_role, CASE WHEN primary_role = 'support' THEN 'supporting-infrastructure' WHEN primary_role = 'entrypoint' THEN 'boundary' WHEN primary_role IN ('data-access', 'domain-model') THEN 'data' WHEN primary_role = 'integration' THEN 'integration' WHEN primary_role = 'business-service' THEN CASE WHEN busy > 0 THEN 'core-workflow' ELSE 'supporting-infrastructure' END ELSE 'low-signal' END AS agent_category FROM r""",
    "components",
    "dependencies",
    "entrypoints",
)
def classify_component(p):
    c = p.components
    m = c.join(M.degrees(c, p.dependency_edges, "DEPENDS_ON"), "id").join(M.owned_entrypoints(c, p.entrypoints), "id")
    return M.classify(m).select("id", "primary_role", "support_role", "agent_category")


@query("SELECT id, CASE WHEN type = 'UNKNOWN' THEN 'ambiguous' WHEN confidence >= 0.9 THEN 'known' WHEN confidence >= 0.6 THEN 'inferred' WHEN confidence > 0 THEN 'ambiguous' ELSE 'unknown' END AS confidence_band, type = 'UNKNOWN' OR (confidence > 0 AND confidence < 0.6) AS ambiguous FROM components", "components")
def confidence_band(p):
    return M.evidence(p.components, F.col("type") == "UNKNOWN").select("id", "confidence_band", "ambiguous")


_REACHED = "+ r(id) AS (SELECT id FROM model_nodes WHERE label = 'Entrypoint' UNION SELECT dst FROM model_edges JOIN r ON src = r.id WHERE label IN ('" + "', '".join(T.ENTRYPOINT_EDGES) + "'))"


@query(_REACHED + " SELECT id, id IN (SELECT id FROM r) AS entrypoint_reachable FROM model_nodes WHERE label = 'Component'", "model_nodes", "model_edges")
def entrypoint_reachable(p):
    return T.entrypoint_reachable(p.model.nodes, p.model).where("label = 'Component'").select("id", "entrypoint_reachable")


@query(_REACHED + " SELECT id, label, id IN (SELECT id FROM r) AS entrypoint_reachable FROM model_nodes", "model_nodes", "model_edges")
def entrypoint_reachable_nodes(p):
    """Every node of the model, whether any entrypoint leads there."""
    return T.entrypoint_reachable(p.model.nodes, p.model)


# ---- traversal


@query(
    """+ e AS (SELECT * FROM edges), walk AS (SELECT ['customer:5', dst] AS ids, [label] AS labels, dst FROM e WHERE src = 'customer:5'
 UNION ALL SELECT list_append(ids, e.dst), list_append(labels, e.label), e.dst FROM walk JOIN e ON e.src = walk.dst WHERE len(labels) < 4 AND walk.dst <> 'nation:3' AND NOT list_contains(ids, e.dst))
SELECT array_to_string(ids, '>') AS nodes, array_to_string(labels, '>') AS labels, count(*) AS n FROM walk WHERE dst = 'nation:3' GROUP BY ALL""",
    "edges",
)
def paths_bounded(p):
    return T.paths(p.graph, "customer:5", "nation:3", 4).groupBy(F.array_join("node_ids", ">").alias("nodes"), F.array_join("edge_labels", ">").alias("labels")).agg(F.count("*").alias("n"))


def _walks(step: str, depth: int) -> str:
    return f"w(id, hop) AS (SELECT * FROM start UNION SELECT s.b, hop + 1 FROM w JOIN ({step}) s ON s.a = w.id WHERE hop < {depth})"


@query(
    "+ g AS (SELECT label, count(*) AS n FROM edges GROUP BY label), m AS (SELECT label, count(*) AS n FROM model_edges GROUP BY label) SELECT 'graph' AS graph, 'out' AS direction, label, n FROM g UNION ALL SELECT 'graph', 'in', label, n FROM g UNION ALL SELECT 'model', 'out', label, n FROM m UNION ALL SELECT 'model', 'in', label, n FROM m",
    "edges",
    "model_edges",
)
def adjacency_counts(p):
    """The stored adjacency of both graphs, made if the sources have changed, and its steps by label."""
    out = None
    for name, stored in (("graph", p.graph), ("model", p.model)):
        for direction in ("out", "in"):
            n = stored.counts(direction).select(F.lit(name).alias("graph"), F.lit(direction).alias("direction"), "label", "n")
            out = n if out is None else out.unionByName(n)
    return out


@query("+ start AS (SELECT 'supplier:3' AS id, 0 AS hop), " + _walks("SELECT DISTINCT dst AS a, src AS b FROM edges", 3) + " SELECT id, min(hop) AS hop FROM w WHERE id <> 'supplier:3' GROUP BY id", "edges")
def impacted_by(p):
    return T.impacted_by(p.graph, _ids(p, "supplier:3"))


@query("+ start AS (SELECT 'supplier:3' AS id, 0 AS hop), " + _walks("SELECT DISTINCT dst AS a, src AS b FROM edges", 3) + ", f AS (SELECT id, min(hop) AS hop FROM w WHERE hop > 0 GROUP BY id) SELECT (h - 1)::INTEGER AS step, 'hop' AS operation, h::INTEGER AS hop, 'in *' AS detail, (SELECT count(*) FROM f WHERE f.hop = h) AS n FROM (SELECT unnest(range(1, 4)) AS h) x", "edges")
def traversal_log(p):
    """What an impact search asked of the graph, hop by hop."""
    log = T.PlanLog()
    T.impacted_by(p.graph, _ids(p, "supplier:3"), log=log)
    return log.relation(p.spark)


@query("+ start AS (SELECT 'customer:5' AS id, 0 AS hop), " + _walks("SELECT DISTINCT src AS a, dst AS b FROM edges", 4) + " SELECT id, min(hop) AS hop FROM w WHERE hop > 0 GROUP BY id", "edges")
def reachable_out(p):
    return T.reachable(p.graph, _ids(p, "customer:5"), "out", None, 4)


@query("+ start AS (SELECT 'comp:4' AS id, 0 AS hop), " + _walks("SELECT DISTINCT to_id AS a, from_id AS b FROM dependencies", 3) + " SELECT id, min(hop) AS hop FROM w WHERE hop > 0 GROUP BY id", "dependencies")
def reachable_in(p):
    return T.reachable(p.dependency_edges, _ids(p, "comp:4"), "in", "depends_on", 3)


@query("+ start AS (SELECT 'nation:3' AS id, 0 AS hop), " + _walks("SELECT src AS a, dst AS b FROM edges WHERE label = 'IN_NATION' UNION SELECT dst, src FROM edges WHERE label = 'IN_NATION'", 2) + " SELECT id, min(hop) AS hop FROM w WHERE hop > 0 GROUP BY id", "edges")
def reachable_both(p):
    return T.reachable(p.graph, _ids(p, "nation:3"), "both", "IN_NATION", 2)


@query("+ start AS (SELECT 'comp:7' AS id, 0 AS hop), " + _walks("SELECT DISTINCT from_id AS a, to_id AS b FROM dependencies", 2) + " SELECT from_id AS src, to_id AS dst, 'DEPENDS_ON' AS label, min(ord) AS ord FROM dependencies WHERE from_id IN (SELECT id FROM w) AND to_id IN (SELECT id FROM w) AND from_id <> to_id GROUP BY ALL", "dependencies")
def dependency_closure(p):
    return T.dependency_closure(p.dependency_edges, _ids(p, "comp:7"), 2).select("src", "dst", "label", "ord")


@query("+ start AS (SELECT 'comp:7' AS id, 0 AS hop), " + _walks("SELECT DISTINCT from_id AS a, to_id AS b FROM dependencies", 1) + " SELECT DISTINCT from_id AS src, to_id AS dst FROM dependencies WHERE from_id IN (SELECT id FROM w)", "dependencies")
def dependency_slice(p):
    return T.dependency_slice(p.dependency_edges, _ids(p, "comp:7"), 2)


@query(
    """+ hidden AS (SELECT id FROM components WHERE type IN ('UTILITY', 'UNKNOWN')), e AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM dependencies),
c(src, dst) AS (SELECT src, dst FROM e WHERE src NOT IN (FROM hidden) UNION SELECT c.src, e.dst FROM c JOIN e ON e.src = c.dst WHERE c.dst IN (FROM hidden))
SELECT src, dst FROM c WHERE dst NOT IN (FROM hidden) AND (src <> dst OR EXISTS (SELECT 1 FROM e WHERE e.src = c.src AND e.dst = c.src))""",
    "components",
    "dependencies",
)
def condense_edges(p):
    return T.condense(p.dependency_edges, p.components)


# ---- linkers


@query("SELECT DISTINCT w.component_id AS writer, r.component_id AS reader, w.owner_id, w.field FROM accesses w JOIN accesses r ON w.owner_id = r.owner_id AND w.field = r.field WHERE w.kind = 'WRITE' AND r.kind = 'READ' AND w.component_id <> r.component_id", "accesses")
def state_handoff(p):
    return L.state_handoffs(p.accesses)


def _calls(p):
    return p.dependencies.select(F.col("from_id").alias("caller"), F.col("to_id").alias("callee"), F.when(F.col("ord") % 2 == 0, "purchase").otherwise("view").alias("method"), "ord")


@query(
    """+ calls AS (SELECT DISTINCT from_id AS caller, to_id AS callee, CASE WHEN ord % 2 = 0 THEN 'purchase' ELSE 'view' END AS method FROM dependencies)
SELECT DISTINCT a.caller AS writer, b.caller AS reader, w.component_id, w.field FROM accesses w JOIN accesses r ON w.component_id = r.component_id AND w.owner_id = r.owner_id AND w.field = r.field
JOIN calls a ON a.callee = w.component_id AND a.method = w.method JOIN calls b ON b.callee = r.component_id AND b.method = r.method WHERE w.kind = 'WRITE' AND r.kind = 'READ' AND w.owner_id = w.component_id AND w.method <> r.method AND a.caller <> b.caller""",
    "accesses",
    "dependencies",
)
def state_handoff_callers(p):
    return L.handoffs_through_callers(p.accesses, _calls(p))


@query("SELECT DISTINCT a.owner_id AS producer, b.owner_id AS consumer, a.field AS event_type, 0.8::DOUBLE AS confidence FROM (SELECT component_id AS owner_id, field FROM accesses WHERE kind = 'WRITE') a JOIN (SELECT component_id AS owner_id, field FROM accesses WHERE kind = 'READ') b ON a.field = b.field WHERE a.owner_id <> b.owner_id", "accesses")
def event_bus_links(p):
    w, r = p.accesses.where("kind = 'WRITE'"), p.accesses.where("kind = 'READ'")
    return L.event_bus_links(w.select(F.col("component_id").alias("producer"), F.col("field").alias("event_type")).distinct(), r.select(F.col("component_id").alias("consumer"), F.col("field").alias("event_type")).distinct())


_STORE = """+ s AS (SELECT s.*, p.entrypoint_id FROM sinks s JOIN paths p ON p.id = s.path_id),
links AS (SELECT DISTINCT a.id AS sink_id, a.path_id, b.path_id AS target FROM s a JOIN s b ON a.owner_id = b.owner_id AND a.field = b.field WHERE a.kind = 'STORE' AND b.kind = 'PERSISTENCE' AND a.path_id <> b.path_id AND a.entrypoint_id <> b.entrypoint_id)"""


def _store_links(p):
    s = p.sinks.join(p.paths.select(F.col("id").alias("path_id"), "entrypoint_id"), "path_id")
    return L.store_links(s, s.where("kind = 'PERSISTENCE'"))


@query(_STORE + " SELECT * FROM links", "sinks", "paths")
def store_links(p):
    return _store_links(p)


@query(
    """+ m AS (SELECT id, channel, broker, CASE WHEN broker IS NOT NULL THEN broker || ':' || coalesce(topic, channel) END AS key FROM sinks WHERE kind = 'MESSAGING'),
c AS (SELECT id AS entrypoint_id, channel, CASE WHEN broker IS NOT NULL THEN broker || ':' || coalesce(topic, channel) END AS key FROM entrypoints WHERE type = 'MESSAGING_CONSUMER'),
x AS (SELECT m.id AS sink_id, entrypoint_id FROM m JOIN c ON m.key = c.key)
SELECT * FROM x UNION SELECT m.id, entrypoint_id FROM m JOIN c ON m.channel = c.channel WHERE m.broker IS NULL AND m.id NOT IN (SELECT sink_id FROM x)""",
    "sinks",
    "entrypoints",
)
def messaging_links_fallback(p):
    consumers = p.entrypoints.where("type = 'MESSAGING_CONSUMER'").select(F.col("id").alias("entrypoint_id"), "broker", "topic", "channel")
    return L.messaging_links(p.sinks.where("kind = 'MESSAGING'"), consumers)


@query(
    """+ s AS (SELECT s.*, e.type AS ep_type FROM sinks s JOIN paths p ON p.id = s.path_id JOIN entrypoints e ON e.id = p.entrypoint_id WHERE kind = 'PERSISTENCE')
SELECT w.id AS writer, r.id AS reader, w.entity FROM s w JOIN s r ON w.entity = r.entity WHERE w.operation = 'save' AND r.operation = 'findById' AND w.path_id <> r.path_id AND r.ep_type NOT IN ('REST_ENDPOINT', 'GRPC_METHOD')""",
    "sinks",
    "paths",
    "entrypoints",
)
def persistence_links(p):
    s = p.sinks.join(p.paths.select(F.col("id").alias("path_id"), "entrypoint_id"), "path_id")
    return L.persistence_links(s, p.entrypoints)


_ROOT = "NOT (%stype = 'CDI_EVENT_OBSERVER' AND regexp_matches(lower(%sname || ' ' || %spath), 'shutdown|stop|destroy|close|halt|cleanup'))"
_WORKFLOW = (
    _STORE
    + f""", pe AS (SELECT p.id AS path_id, e.* EXCLUDE (id, ord) FROM paths p JOIN entrypoints e ON e.id = p.entrypoint_id),
own AS (SELECT DISTINCT owner_id, field FROM sinks s JOIN pe ON pe.path_id = s.path_id WHERE kind = 'STORE' AND pe.component_id = owner_id),
wl AS (SELECT CASE s.kind WHEN 'STORE' THEN 'STATE_HANDOFF' ELSE s.kind END AS kind, l.path_id AS from_path, l.target AS to_path, l.sink_id,
  least(CASE s.kind WHEN 'EVENT_BUS' THEN 0.75 WHEN 'PERSISTENCE' THEN 0.6 ELSE 0.9 END, CASE WHEN contains(evidence, 'call-graph-reach') THEN 0.6 ELSE 1 END)::DOUBLE AS confidence
 FROM links l JOIN sinks s ON s.id = l.sink_id JOIN pe f ON f.path_id = l.path_id JOIN pe t ON t.path_id = l.target
 WHERE {_ROOT.replace("%s", "f.")} AND {_ROOT.replace("%s", "t.")} AND NOT (s.kind = 'STORE' AND f.component_id <> s.owner_id AND EXISTS (SELECT 1 FROM own o WHERE o.owner_id = s.owner_id AND o.field = s.field))
 AND NOT (s.kind = 'STORE' AND f.type = 'SCHEDULER' AND t.type IN ('MESSAGING_CONSUMER', 'REST_ENDPOINT', 'EVENT_BUS_CONSUMER', 'GRPC_METHOD')))"""
)


def _workflow_links(p):
    return L.workflow_links_of(p.sinks, p.paths, p.entrypoints, ("STORE",))


@query(_WORKFLOW + " SELECT * FROM wl", "sinks", "paths", "entrypoints")
def workflow_links(p):
    return _workflow_links(p)


_NAMES = "SELECT 'n' || cast(n_nationkey as string) AS id, CASE n_nationkey % 4 WHEN 0 THEN 'java:comp/env/' WHEN 1 THEN 'java:/' WHEN 2 THEN 'java:jboss/' ELSE '' END || n_name AS name"


@query(f"+ l AS ({_NAMES} FROM nation) SELECT l.id AS left_id, 'app:' || cast(n_nationkey as string) AS right_id FROM l JOIN nation ON regexp_replace(regexp_replace(regexp_replace(lower(l.name), '^java:comp/env/', ''), '^java:/', ''), '^java:jboss/', '') = lower(n_name)", "paths")
def normalized_key_join(p):
    n = p.table("nation")
    left = p.spark.sql(f"{_NAMES} FROM {{n}}", n=n)
    return L.normalized_key_links(left, n.select(F.concat(F.lit("app:"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("none").alias("name"), F.array(F.col("n_name")).alias("aliases")))


@query("SELECT p_partkey AS left_id, n_nationkey AS right_id FROM part, (SELECT n_nationkey, cast(n_nationkey as string) AS w FROM nation) WHERE contains(lower(p_brand), w) OR contains(w, lower(p_brand))", "paths")
def theta_contains_join(p):
    return L.contains_links(p.table("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name")), p.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").cast("string").alias("name")))


@query("""SELECT id, CASE WHEN contains(name, 'Service') THEN 2 WHEN name LIKE 'Order%' THEN 1 WHEN contains(package, 'config') THEN 4 ELSE 3 END AS rule_id FROM components""", "components")
def glob_rule_join(p):
    rules = p.spark.createDataFrame([(1, "com.acme.*.Order*", "*"), (2, "com.acme.*Service*", "ha*dle"), (3, "*", "*"), (4, "com.*config*", "h*")], "rule_id int, type_glob string, method_glob string")
    return L.glob_rules(p.components.select("id", F.col("qualified_name").alias("type_name"), F.lit("handle").alias("method")), rules)


# ---- chains

#: Chains need sparse links: each path hands over to the path of the next order of the same clerk's round.
_CHAIN_LINKS = "SELECT 'path:' || cast(o_orderkey as string) AS from_path, 'path:' || cast(nxt as string) AS to_path FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders) o WHERE nxt IS NOT NULL"
_CHAIN_PATHS = "SELECT 'path:' || cast(o_orderkey as string) AS id, 'ep:' || cast(o_orderkey % 97 as string) AS entrypoint_id FROM orders"
_CHAINS = f"""+ links AS ({_CHAIN_LINKS}), cp AS ({_CHAIN_PATHS}), roots AS (SELECT id FROM cp WHERE id NOT IN (SELECT to_path FROM links) AND id IN (SELECT from_path FROM links)),
w(ids, eps, last, go) AS (SELECT [r.id], [entrypoint_id], r.id, true FROM roots r JOIN cp ON cp.id = r.id
 UNION ALL SELECT list_append(ids, to_path), list_append(eps, entrypoint_id), to_path, true FROM w JOIN links ON from_path = last JOIN cp ON cp.id = to_path WHERE len(ids) < 32 AND NOT list_contains(ids, to_path) AND NOT list_contains(eps, entrypoint_id)),
chains AS (SELECT DISTINCT ids, eps FROM w WHERE len(ids) >= 2 AND (len(ids) = 32 OR last NOT IN (SELECT from_path FROM links) OR EXISTS (SELECT 1 FROM links JOIN cp ON cp.id = to_path WHERE from_path = last AND (list_contains(ids, to_path) OR list_contains(eps, entrypoint_id)))))"""
_AS_TEXT = "array_to_string(ids, '>') AS ids, array_to_string(eps, '>') AS eps"


def _chain_parts(p):
    o = p.table("orders")
    return p.spark.sql(_CHAIN_PATHS.replace("FROM orders", "FROM {o}"), o=o), p.spark.sql(_CHAIN_LINKS.replace("FROM orders", "FROM {o}"), o=o)


def _text(found):
    return found.select(F.array_join("ids", ">").alias("ids"), F.array_join("eps", ">").alias("eps"))


@query(f"+ links AS ({_CHAIN_LINKS}), cp AS ({_CHAIN_PATHS}) SELECT id FROM cp WHERE id NOT IN (SELECT to_path FROM links) AND id IN (SELECT from_path FROM links)", "paths")
def workflow_roots(p):
    return C.roots(*_chain_parts(p))


@query(_CHAINS + f" SELECT {_AS_TEXT} FROM chains", "paths")
def pipeline_chains(p):
    return _text(C.chains(*_chain_parts(p)))


@query(_CHAINS + f" SELECT {_AS_TEXT} FROM chains c WHERE NOT EXISTS (SELECT 1 FROM chains d WHERE len(d.ids) > len(c.ids) AND d.ids[1:len(c.ids) - 1] = c.ids[1:len(c.ids) - 1] AND d.ids[1] = c.ids[1])", "paths")
def chains_prefix_removed(p):
    return _text(C.without_prefixes(C.chains(*_chain_parts(p))))


@query(_CHAINS + " SELECT array_to_string(eps, '>') AS eps, array_to_string(min(ids), '>') AS ids FROM chains GROUP BY eps", "paths")
def chains_dedup(p):
    return _text(C.without_duplicates(C.chains(*_chain_parts(p))))


@query(_CHAINS + f" SELECT {_AS_TEXT} FROM (SELECT *, row_number() OVER (PARTITION BY eps[1] ORDER BY len(ids) DESC, ids) AS r FROM chains) WHERE r = 1 ORDER BY eps[1] LIMIT 50", "paths")
def longest_chain_per_root(p):
    return _text(C.longest_per_root(C.chains(*_chain_parts(p)), 50))


@query(_CHAINS + " SELECT array_to_string(ids, '>') AS chain, (i - 1)::INTEGER AS segment_index, ids[i] AS path_id, ids[i + 1] AS next_path FROM (SELECT ids, unnest(range(1, len(ids) + 1)) AS i FROM chains)", "paths")
def chain_segments(p):
    return C.segments(C.chains(*_chain_parts(p)))


@query("SELECT count(*) FILTER (WHERE kind = 'STORE') AS store, count(*) FILTER (WHERE kind = 'MESSAGING') AS messaging, count(*) FILTER (WHERE kind = 'EVENT_BUS') AS event_bus, count(*) FILTER (WHERE kind = 'PERSISTENCE') AS persistence, count(*) FILTER (WHERE broker IS NULL) AS no_broker, count(*) FILTER (WHERE contains(evidence, 'reach')) AS reached, count(DISTINCT topic) AS topics FROM sinks", "sinks")
def pipeline_diagnostic(p):
    k = [F.count(F.when(F.col("kind") == x, 1)).alias(x.lower()) for x in ("STORE", "MESSAGING", "EVENT_BUS", "PERSISTENCE")]
    return p.sinks.agg(*k, F.count(F.when(F.col("broker").isNull(), 1)).alias("no_broker"), F.count(F.when(F.contains("evidence", F.lit("reach")), 1)).alias("reached"), F.countDistinct("topic").alias("topics"))


# ---- roll-ups

_HOME = """+ home AS (SELECT id, name, 'container:' || module || ':' || CASE WHEN type = 'REST_RESOURCE' THEN 'api' WHEN type IN ('SERVICE', 'EJB_STATELESS', 'CDI_EVENT_PRODUCER', 'REMOTE_SERVICE') THEN 'service' WHEN type = 'REPOSITORY' THEN 'repository' WHEN type = 'ENTITY' THEN 'domain' WHEN type IN ('MESSAGE_DRIVEN_BEAN', 'CDI_EVENT_CONSUMER') THEN 'messaging' WHEN type = 'SCHEDULER' THEN 'scheduling' WHEN type = 'HTTP_CLIENT' THEN 'client' ELSE 'misc' END AS container FROM components)"""


@query(_HOME + " SELECT container, id, name FROM home", "components")
def container_infer(p):
    return R.containers(p.components)


@query(_HOME + " SELECT a.container AS a, b.container AS b, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n FROM dependencies JOIN home a ON a.id = from_id JOIN home b ON b.id = to_id WHERE a.container <> b.container GROUP BY ALL", "components", "dependencies")
def container_edges(p):
    return R.container_edges(p.components, p.dependency_edges)


@query(_HOME + " SELECT container, count(*) AS n FROM entrypoints e JOIN home ON home.id = e.component_id GROUP BY container", "components", "entrypoints")
def entrypoints_per_container(p):
    return R.entrypoints_per_container(p.components, p.entrypoints)


@query(
    """+ g AS (SELECT id, array_to_string(string_split(package, '.')[1:3], '.') AS g FROM components), k AS (SELECT a.g AS from_group, b.g AS to_group, kind, count(*) AS n FROM dependencies JOIN g a ON a.id = from_id JOIN g b ON b.id = to_id GROUP BY ALL)
SELECT from_group, to_group, sum(n)::BIGINT AS n, string_agg(kind || '=' || n::VARCHAR, ',' ORDER BY kind) AS by_kind FROM k GROUP BY from_group, to_group""",
    "components",
    "dependencies",
)
def dependency_map(p):
    return R.dependency_map(p.components, p.dependency_edges)


@query("SELECT 'com.acme' AS prefix", "components")
def package_prefix(p):
    return R.common_package(p.components)


@query("SELECT 'external:' || lower(broker) AS id, count(DISTINCT coalesce(topic, channel)) AS destinations, min(ord) AS ord FROM entrypoints WHERE broker IS NOT NULL GROUP BY broker", "entrypoints")
def external_systems(p):
    return R.external_systems(p.entrypoints)


@query("SELECT label, count(*) AS n FROM edges WHERE label NOT IN ('PLACED', 'HAS_ITEM') AND src NOT LIKE 'customer:%' GROUP BY label", "edges")
def snapshot_export(p):
    return S.summary(R.export(p.nodes, p.edges, ("Customer",), ("PLACED", "HAS_ITEM"))[1])


@query("SELECT package, name FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY name) AS r FROM components) WHERE r <= 3", "components")
def package_overview(p):
    return R.per_package(p.components, 3)


# ---- ordered steps

_MACRO = """+ s AS (SELECT *, CASE WHEN policy IN ('REQUIRED', 'REQUIRES_NEW') THEN 1 WHEN policy = 'NOT_SUPPORTED' THEN 0 END AS leaves FROM steps),
w(flow_id, step, transition, active, n) AS (
 SELECT flow_id, 0::BIGINT, '', false, 0 FROM (SELECT DISTINCT flow_id FROM steps)
 UNION ALL SELECT s.flow_id, s.step::BIGINT, CASE WHEN policy = 'REQUIRED' THEN CASE WHEN active THEN 'join' ELSE 'begin' END WHEN policy = 'REQUIRES_NEW' THEN CASE WHEN active THEN 'suspend-and-begin' ELSE 'begin' END WHEN policy = 'NOT_SUPPORTED' THEN CASE WHEN active THEN 'suspend' ELSE 'none' END ELSE CASE WHEN active THEN 'join' ELSE 'none' END END,
  CASE WHEN leaves IS NULL THEN active ELSE leaves = 1 END, n + CASE WHEN policy = 'REQUIRES_NEW' OR (policy = 'REQUIRED' AND NOT active) THEN 1 ELSE 0 END FROM w JOIN s ON s.flow_id = w.flow_id AND s.step = w.step + 1)
SELECT flow_id, step, transition, CASE WHEN active THEN flow_id || ':tx:' || n::VARCHAR END AS scope FROM w WHERE step > 0"""


@query(_MACRO, "steps")
def transaction_scope(p):
    return O.transaction_scopes(p.steps.withColumn("step", F.col("step").cast("long")))


@query("SELECT flow_id, step::BIGINT AS step, component_id, lag(component_id) OVER w AS before, lead(component_id) OVER w AS after FROM steps WINDOW w AS (PARTITION BY flow_id ORDER BY step)", "steps")
def step_neighbours(p):
    return O.neighbours(p.steps.withColumn("step", F.col("step").cast("long")), "flow_id", "step", "component_id")


# ---- questions


@query("+ start AS (SELECT 'supplier:3' AS id, 0 AS hop), " + _walks("SELECT DISTINCT dst AS a, src AS b FROM edges", 4) + " SELECT label, count(*) AS n FROM nodes WHERE id IN (SELECT id FROM w WHERE id <> 'supplier:3') GROUP BY label", "edges", "nodes")
def question_impact(p):
    return Q.impact(p.edges, p.nodes, _ids(p, "supplier:3"))


@query("+ per AS (SELECT field, owner_id, component_id, bool_or(kind = 'WRITE') AS w, bool_or(kind = 'READ') AS r FROM accesses WHERE contains(field, 'field1') GROUP BY ALL) SELECT field, owner_id, count(*) FILTER (WHERE w) AS writers, count(*) FILTER (WHERE r) AS readers, count(*) FILTER (WHERE w AND r) AS both FROM per GROUP BY field, owner_id", "accesses")
def question_state_lifecycle(p):
    return Q.state_lifecycle(p.accesses, "Field1")


@query("+ a AS (SELECT coalesce(topic, channel) AS destination, count(*) AS producers FROM sinks WHERE kind = 'MESSAGING' GROUP BY 1), b AS (SELECT coalesce(topic, channel) AS destination, count(*) AS consumers FROM entrypoints GROUP BY 1) SELECT destination, coalesce(producers, 0) AS producers, coalesce(consumers, 0) AS consumers FROM a FULL JOIN b USING (destination)", "sinks", "entrypoints")
def question_messaging_flow(p):
    return Q.messaging_flow(p.entrypoints, p.sinks)


@query("SELECT operation, count(*) AS n, count(DISTINCT entity) AS entities FROM sinks s WHERE kind = 'PERSISTENCE' AND path_id IN (SELECT id FROM paths WHERE param = '1-urgent') GROUP BY operation", "sinks", "paths")
def question_persistence_destination(p):
    return Q.persistence_destination(p.sinks, "1-urgent", p.paths)


@query("SELECT e.id AS entrypoint_id, count(s.id) FILTER (WHERE kind = 'STORE') AS store, count(s.id) FILTER (WHERE kind = 'MESSAGING') AS messaging, count(s.id) FILTER (WHERE kind = 'EVENT_BUS') AS event_bus, count(s.id) FILTER (WHERE kind = 'PERSISTENCE') AS persistence FROM entrypoints e LEFT JOIN paths p ON p.entrypoint_id = e.id LEFT JOIN sinks s ON s.path_id = p.id GROUP BY e.id", "entrypoints", "paths", "sinks")
def question_endpoint_context(p):
    return Q.endpoint_context(p.entrypoints, p.paths, p.sinks)


_PLANNER = "+ q AS (SELECT item_id AS id, lower(text) AS t FROM benchmark UNION ALL SELECT c_custkey + 1000000, 'what does ' || CASE c_custkey % 4 WHEN 0 THEN 'the transaction rollback' WHEN 1 THEN 'impact of this break' WHEN 2 THEN 'cron job schedule trigger' ELSE 'consumer of the topic' END || ' mean for customer ' || c_custkey::VARCHAR FROM customer), f AS (" + " UNION ALL ".join(
    f"SELECT id, '{name}' AS family, (" + " + ".join("CASE WHEN regexp_matches(t, '" + rx.replace("'", "''") + f"') THEN {w} ELSE 0 END" for rx, w in triggers) + f") / {sum(w for _, w in triggers)}.0::DOUBLE AS score FROM q" for name, triggers in Q.TRIGGERS.items()
) + "), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, family) AS k FROM f) SELECT a.id, CASE WHEN a.score < 0.25 THEN 'unsupported' WHEN a.score - b.score < 0.15 AND a.score < 0.6 THEN 'needs-clarification' ELSE a.family END AS intent, round(a.score, 6) AS score FROM r a JOIN r b ON a.id = b.id AND a.k = 1 AND b.k = 2"


@query(_PLANNER, "paths")
def question_planner(p):
    b = p.table("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    k = F.col("c_custkey")
    what = F.when(k % 4 == 0, "the transaction rollback").when(k % 4 == 1, "impact of this break").when(k % 4 == 2, "cron job schedule trigger").otherwise("consumer of the topic")
    c = p.table("customer").select((k + 1_000_000).alias("id"), F.concat(F.lit("What does "), what, F.lit(" mean for customer "), k.cast("string")).alias("question"))
    return Q.plan(b.unionByName(c))


# ---- scalar functions


@query(
    """SELECT id, CASE type WHEN 'REST_ENDPOINT' THEN 'http' WHEN 'MESSAGING_CONSUMER' THEN 'messaging' WHEN 'SCHEDULER' THEN 'scheduler' WHEN 'CDI_EVENT_OBSERVER' THEN 'event' WHEN 'EVENT_BUS_CONSUMER' THEN 'event-bus' ELSE 'grpc' END AS protocol,
 CASE type WHEN 'REST_ENDPOINT' THEN http_method || ' ' || t WHEN 'MESSAGING_CONSUMER' THEN 'Process ' || upper(channel[1]) || channel[2:] WHEN 'SCHEDULER' THEN 'Scheduled: ' || t WHEN 'CDI_EVENT_OBSERVER' THEN 'On Event: ' || path ELSE t END AS use_case
FROM (SELECT *, CASE WHEN name LIKE 'on%' THEN 'On Shutdown' || name[11:] ELSE 'Handle' || name[7:] END AS t FROM entrypoints)""",
    "entrypoints",
)
def detect_use_cases(p):
    c = F.col
    return p.entrypoints.select("id", X.protocol(c("type")).alias("protocol"), X.use_case_name(c("type"), c("name"), c("http_method"), c("channel"), c("path")).alias("use_case"))


@query(
    """SELECT d.ord, round(CASE WHEN d.ord % 2 = 0 THEN 0.9 + CASE WHEN b.type IN ('REPOSITORY', 'REMOTE_SERVICE') THEN 0.03 ELSE 0 END
 ELSE 0.55 + CASE WHEN a.module = b.module THEN 0.05 ELSE 0 END + CASE WHEN b.type NOT IN ('ENTITY', 'UTILITY', 'UNKNOWN') THEN 0.05 ELSE 0 END END, 2)::DOUBLE AS score FROM dependencies d JOIN components a ON a.id = d.from_id JOIN components b ON b.id = d.to_id""",
    "dependencies",
    "components",
)
def dependency_scores(p):
    a, b = p.components.select(F.col("id").alias("src"), F.col("module").alias("am")), p.components.select(F.col("id").alias("dst"), F.col("module").alias("bm"), "type")
    return p.dependency_edges.join(a, "src").join(b, "dst").select("ord", X.dependency_score(F.col("ord") % 2 == 0, F.col("am") == F.col("bm"), F.col("type")).alias("score"))
