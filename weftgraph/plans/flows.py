"""Queries over method-level calls: runtime flows, call chains, traced names and their sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import flow as W
from weftgraph.operators import linkers as L
from weftgraph.operators import policy as Y
from weftgraph.plans.registry import query

_VISIBLE = "type IS NOT NULL AND type <> 'UTILITY' AND NOT coalesce(type = 'HTTP_CLIENT' AND stereotype = 'messaging', false)"
_INLINE = "coalesce(call_kind, '') NOT IN ('messaging', 'event-bus') AND NOT capped AND NOT ambiguous"
_VISITS = f"""+ shown AS (SELECT id FROM components WHERE {_VISIBLE}),
v(e, c, m, via, source, source_method, trail, keys, again, d) AS (
 SELECT id, component_id, method, CASE WHEN channel IS NOT NULL THEN channel WHEN http_method IS NOT NULL AND path IS NOT NULL THEN http_method || ' ' || path ELSE coalesce(path, lower(type), 'trigger') END, NULL::VARCHAR, NULL::VARCHAR, []::BIGINT[], [component_id || '#' || method], false, 0 FROM entrypoints
 UNION ALL SELECT e, to_id, to_method, to_method, CASE WHEN c IN (SELECT id FROM shown) THEN c ELSE source END, m, list_append(trail, k.ord), list_append(keys, to_id || '#' || to_method), list_contains(keys, to_id || '#' || to_method), d + 1
 FROM v JOIN calls k ON k.from_id = c AND k.from_method = m WHERE NOT again AND d <= 5 AND {_INLINE}),
seen AS (SELECT * FROM v WHERE c IN (SELECT id FROM shown))"""
_RELATIONS = ("entrypoints", "components", "calls")


def _visits(p):
    return W.visits(p.entrypoints, p.calls, p.components)


@query(_VISITS + " SELECT e AS entrypoint_id, row_number() OVER (PARTITION BY e ORDER BY trail) - 1 AS position, c AS component_id, via, m AS method FROM (SELECT *, row_number() OVER (PARTITION BY e, c ORDER BY trail) AS r FROM seen) WHERE r = 1", *_RELATIONS)
def runtime_flow_steps(p):
    return W.flow_steps(_visits(p))


@query(_VISITS + " SELECT DISTINCT e AS entrypoint_id, source AS from_id, c AS to_id, via FROM seen WHERE source IS NOT NULL", *_RELATIONS)
def runtime_flow_edges(p):
    return W.flow_edges(_visits(p))


@query(_VISITS + " SELECT DISTINCT e AS entrypoint_id, a.name || '.' || source_method || ' -> ' || b.name || '.' || m AS line FROM seen JOIN components a ON a.id = source JOIN components b ON b.id = c", *_RELATIONS)
def call_chain(p):
    return W.call_lines(_visits(p), p.components)


@query(
    f"""+ d AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM dependencies), w(e, c, hop) AS (SELECT id, component_id, 0 FROM entrypoints UNION SELECT w.e, dst, hop + 1 FROM w JOIN d ON src = w.c WHERE hop < 5)
SELECT e AS entrypoint_id, c AS component_id, min(hop) AS hop FROM w WHERE c IN (SELECT id FROM components WHERE {_VISIBLE}) GROUP BY e, c""",
    "entrypoints",
    "dependencies",
    "components",
)
def runtime_flow_fallback(p):
    return W.dependency_flow(p.entrypoints, p.dependency_edges, p.components)


@query(f"SELECT ord, coalesce(call_kind IN ('messaging', 'event-bus'), false) AS is_async, {_INLINE} AS inline FROM calls", "calls")
def call_predicates(p):
    return p.calls.select("ord", Y.is_async_boundary(F.col("call_kind")).alias("is_async"), Y.can_traverse_inline().alias("inline"))


@query(f"SELECT id, {_VISIBLE} AS visible, coalesce(type = 'HTTP_CLIENT' AND stereotype = 'messaging', false) AS raw_client FROM components", "components")
def component_visibility(p):
    return p.components.select("id", Y.is_human_visible().alias("visible"), Y.is_raw_messaging_client().alias("raw_client"))


# ---- traced names

_SINK_CALL = "(coalesce(k.call_kind IN ('messaging', 'event-bus'), false) OR coalesce(type IN ('REPOSITORY', 'HTTP_CLIENT', 'CDI_EVENT_PRODUCER'), false))"
_KILLED = "coalesce(x.now = k.killed, false)"
#: The names that go on: * passes, killed ones stop, unmapped ones stop beside mapped ones or at another receiver.
_NEXT = f"""list_transform(list_filter(names, lambda x: x.now = '*' OR NOT ({_KILLED}
   OR (len(list_filter(names, lambda y: y.now <> '*' AND coalesce(y.now = k.arg, false))) > 0 AND NOT coalesce(x.now = k.arg, false))
   OR (k.arg IS NULL AND k.receiver IS NOT NULL AND k.receiver <> x.now))),
  lambda x: struct_pack(now := CASE WHEN x.now <> '*' AND coalesce(x.now = k.arg, false) THEN k.param ELSE x.now END, first := x.first))"""
_TRACE = f"""+ k AS (SELECT k.*, type, stereotype, {_SINK_CALL} AS leaves, {_INLINE} AS inline FROM calls k LEFT JOIN components t ON t.id = k.to_id),
t(e, c, m, names, keys, d, caller, caller_method, lit, lit_value) AS (
 SELECT e.id, e.component_id, e.method, (SELECT list(struct_pack(now := name, first := name) ORDER BY ord) FROM tracked r WHERE r.entrypoint_id = e.id), [e.component_id || '#' || e.method], 0, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM entrypoints e
 UNION ALL SELECT e, to_id, to_method, {_NEXT}, list_append(keys, to_id || '#' || to_method), d + 1, c, m, k.literal, k.literal_value
 FROM t JOIN k ON k.from_id = c AND k.from_method = m WHERE d < 8 AND inline AND NOT leaves AND NOT list_contains(keys, to_id || '#' || to_method) AND len({_NEXT}) > 0),
n AS (SELECT e, c, m, d, keys, names, caller, caller_method, lit, lit_value, x.now AS now, x.first AS first FROM (SELECT *, unnest(names) AS x FROM t) u),
outbound AS (SELECT DISTINCT e, first, s.kind, c AS component_id, m AS method, coalesce(CASE WHEN trim(topic2) <> '' THEN topic2 END, channel2) AS channel, NULL::VARCHAR AS owner_id, NULL::VARCHAR AS field, c AS caller_id
 FROM (SELECT n.*, s.kind, s.only_component, s.only_method, CASE WHEN coalesce(topic = lit, false) THEN lit_value ELSE topic END AS topic2, CASE WHEN coalesce(channel = lit, false) THEN lit_value ELSE channel END AS channel2 FROM n JOIN sites s ON s.component_id = c AND s.method = m) s
 WHERE only_component IS NULL OR (coalesce(caller = only_component, false) AND (only_method IS NULL OR coalesce(caller_method = only_method, false)))),
stored AS (SELECT DISTINCT e, first, 'STORE' AS kind, owner_id AS component_id, field AS method, NULL::VARCHAR AS channel, owner_id, field, c AS caller_id FROM n JOIN field_access w ON w.component_id = c AND w.method = m AND w.kind = 'WRITE'
 WHERE now <> '*' AND (d = 0 OR coalesce(now = source_var, false) OR coalesce(now = source_field, false) OR coalesce(now = key_var, false) OR (source_var IS NULL AND source_field IS NULL))),
called AS (SELECT DISTINCT e, first, CASE WHEN k.call_kind = 'event-bus' THEN 'EVENT_BUS' WHEN k.call_kind = 'messaging' THEN 'MESSAGING' WHEN type IS NULL THEN 'UNKNOWN' WHEN stereotype = 'object-storage' THEN 'OBJECT_STORAGE' WHEN stereotype = 'file-outbound' THEN 'FILE_OUTBOUND'
   WHEN type = 'REPOSITORY' THEN 'PERSISTENCE' WHEN type = 'HTTP_CLIENT' AND stereotype = 'messaging' THEN 'MESSAGING' WHEN type = 'HTTP_CLIENT' THEN 'HTTP_OUTBOUND' WHEN type = 'CDI_EVENT_PRODUCER' THEN 'EVENT_BUS' ELSE 'UNKNOWN' END AS kind,
  to_id AS component_id, to_method AS method, NULL::VARCHAR AS channel, NULL::VARCHAR AS owner_id, NULL::VARCHAR AS field, c AS caller_id FROM n JOIN k ON k.from_id = c AND k.from_method = m WHERE leaves AND (now = '*' OR NOT coalesce(now = killed, false))),
found AS (SELECT e AS entrypoint_id, first AS tracked, kind, component_id, method, channel, owner_id, field, caller_id FROM (SELECT * FROM outbound UNION SELECT * FROM stored UNION SELECT * FROM called))"""
_TRACED = ("entrypoints", "components", "calls", "tracked", "field_access", "sites")


def _states(p):
    return W.trace(p.entrypoints, p.tracked, p.calls, p.components)


@query(_TRACE + " SELECT e AS entrypoint_id, first AS tracked, c AS component_id, m AS method, now AS local_name, min(d) AS depth FROM n GROUP BY ALL", *_TRACED)
def data_flow_trace(p):
    return W.trace_steps(_states(p))


def _sinks(p, states):
    return W.data_flow_sinks(states, p.calls, p.components, p.field_access, p.sites)


@query(_TRACE + " SELECT * FROM found", *_TRACED)
def data_flow_sinks(p):
    return _sinks(p, _states(p))


@query(_TRACE + " SELECT e AS entrypoint_id, first AS tracked, kind, component_id, method, channel, owner_id, field, caller_id FROM outbound", *_TRACED)
def outbound_sinks(p):
    return W.outbound_sinks(_states(p), p.sites)


@query(_TRACE + " SELECT e AS entrypoint_id, first AS tracked, kind, component_id, method, channel, owner_id, field, caller_id FROM stored", *_TRACED)
def field_write_sinks(p):
    return W.field_write_sinks(_states(p), p.field_access)


@query(
    _TRACE
    + f""", g AS (SELECT DISTINCT from_id, from_method, to_id, to_method FROM calls WHERE {_INLINE}), r(e, c, m) AS (SELECT id, component_id, method FROM entrypoints UNION SELECT e, to_id, to_method FROM r JOIN g ON from_id = c AND from_method = m),
l AS (SELECT ord, coalesce(CASE WHEN trim(topic) <> '' THEN topic END, channel) AS channel, component_id, coalesce(only_component, component_id) AS at_component, CASE WHEN only_component IS NULL THEN method ELSE only_method END AS at_method FROM sites WHERE kind = 'MESSAGING')
SELECT r.e AS entrypoint_id, (SELECT arg_min(name, ord) FROM tracked q WHERE q.entrypoint_id = r.e) AS tracked, channel, arg_min(component_id, l.ord) AS component_id FROM r JOIN l ON at_component = r.c AND at_method = r.m
WHERE channel IS NOT NULL AND NOT EXISTS (SELECT 1 FROM found f WHERE f.entrypoint_id = r.e AND f.kind = 'MESSAGING' AND f.channel = l.channel) GROUP BY r.e, channel""",
    *_TRACED,
)
def call_graph_reach(p):
    return W.call_graph_reach(p.entrypoints, p.sites, p.calls, _sinks(p, _states(p)), p.tracked)


@query(f"+ g AS (SELECT DISTINCT from_id, from_method, to_id, to_method FROM calls WHERE {_INLINE}), r(e, c, m) AS (SELECT id, component_id, method FROM entrypoints UNION SELECT e, to_id, to_method FROM r JOIN g ON from_id = c AND from_method = m) SELECT e AS entrypoint_id, c AS component_id, m AS method FROM r", *_RELATIONS)
def reachable_methods(p):
    """By distinct beginnings, then joined with the entrypoints that share them."""
    begin = p.entrypoints.select("component_id", "method").distinct()
    c = F.col
    turned = p.calls.select("call_kind", "capped", "ambiguous", c("to_id").alias("from_id"), c("to_method").alias("from_method"), c("from_id").alias("to_id"), c("from_method").alias("to_method"))
    found = W.reaching(begin, turned)
    e = p.entrypoints.select(F.col("id").alias("entrypoint_id"), F.col("component_id").alias("bc"), F.col("method").alias("bm"))
    return found.join(e, (F.col("component_id") == F.col("bc")) & (found["method"] == F.col("bm"))).select("entrypoint_id", F.col("c").alias("component_id"), F.col("m").alias("method"))


@query(f"+ g AS (SELECT DISTINCT from_id, from_method, to_id, to_method FROM calls WHERE {_INLINE}), r(e, c, m) AS (SELECT id, component_id, method FROM entrypoints UNION SELECT e, to_id, to_method FROM r JOIN g ON from_id = c AND from_method = m) SELECT DISTINCT e AS entrypoint_id, owner_id, field FROM r JOIN field_access a ON a.component_id = r.c AND a.method = r.m WHERE kind = 'READ' AND owner_id <> a.component_id", *_RELATIONS, "field_access")
def reachable_field_reads(p):
    return W.read_fields(p.entrypoints, p.field_access, p.calls)


_READ = f"g AS (SELECT DISTINCT from_id, from_method, to_id, to_method FROM calls WHERE {_INLINE}), r(e, c, m) AS (SELECT id, component_id, method FROM entrypoints UNION SELECT e, to_id, to_method FROM r JOIN g ON from_id = c AND from_method = m)"


@query("+ " + _READ + " SELECT DISTINCT e AS entrypoint_id, field FROM r JOIN field_access a ON a.component_id = r.c AND a.method = r.m WHERE kind = 'READ'", *_RELATIONS, "field_access")
def reachable_field_names(p):
    """Names of the fields that an entrypoint's calls read, whoever owns them."""
    return W.read_names(p.entrypoints, p.field_access, p.calls)


@query(
    "+ " + _READ + """, f AS (SELECT DISTINCT e AS entrypoint_id, field FROM r JOIN field_access a ON a.component_id = r.c AND a.method = r.m WHERE kind = 'READ'), own AS (SELECT entrypoint_id, 0 AS k, ord AS o, name FROM tracked WHERE name <> '*'),
every AS (SELECT * FROM own UNION ALL SELECT id, 0, 0, '*' FROM entrypoints WHERE id NOT IN (SELECT entrypoint_id FROM own)
  UNION ALL SELECT f.entrypoint_id, 1, 0, field FROM f JOIN entrypoints e ON e.id = f.entrypoint_id WHERE type IN ('MESSAGING_PRODUCER', 'SCHEDULER') OR e.id NOT IN (SELECT entrypoint_id FROM own)
  UNION ALL SELECT e.id, 2, c.ord, 'v' || (c.ord % 5)::VARCHAR FROM entrypoints e JOIN calls c ON c.from_id = e.component_id AND c.from_method = e.method WHERE c.ord % 4 = 0)
SELECT row_number() OVER (PARTITION BY entrypoint_id ORDER BY min((k, o)), name) - 1 AS ord, entrypoint_id, name FROM every GROUP BY entrypoint_id, name""",
    *_RELATIONS, "field_access", "tracked",
)
def tracked_names(p):
    """The names that are followed from each entrypoint."""
    calls = p.calls.withColumn("assigned", F.when(F.col("ord") % 4 == 0, F.concat(F.lit("v"), (F.col("ord") % 5).cast("string"))))
    return W.tracked_names(p.entrypoints, p.tracked.where("name <> '*'"), W.read_names(p.entrypoints, p.field_access, p.calls), calls)


@query(
    "+ " + _READ + """, f AS (SELECT DISTINCT e AS entrypoint_id, owner_id, field FROM r JOIN field_access a ON a.component_id = r.c AND a.method = r.m WHERE kind = 'READ' AND owner_id <> a.component_id),
s AS (SELECT s.id AS sink_id, s.path_id, s.owner_id, 'field' || (regexp_extract(s.field, '(\\d+)', 1)::BIGINT % 50)::VARCHAR AS field, x.entrypoint_id FROM sinks s JOIN paths x ON x.id = s.path_id WHERE s.kind = 'STORE')
SELECT DISTINCT sink_id, path_id, x.id AS target FROM s JOIN f USING (owner_id, field) JOIN paths x ON x.entrypoint_id = f.entrypoint_id WHERE x.id <> path_id AND x.entrypoint_id <> s.entrypoint_id""",
    *_RELATIONS, "field_access", "sinks", "paths",
)
def store_links_transitive(p):
    """Links from writes of a field to the paths of entrypoints whose calls read it anywhere."""
    sinks = p.sinks.join(p.paths.select(F.col("id").alias("path_id"), "entrypoint_id"), "path_id").withColumn("field", F.concat(F.lit("field"), (F.regexp_extract("field", r"(\d+)", 1).cast("bigint") % 50).cast("string")))
    readers = W.read_fields(p.entrypoints, p.field_access, p.calls).join(p.paths.select(F.col("id").alias("path_id"), "entrypoint_id"), "entrypoint_id")
    return L.store_links(sinks, readers)


_LABEL = "coalesce(CASE WHEN trim(branch_label) <> '' THEN branch_label END, CASE WHEN control IN ('IF_THEN', 'TERNARY_THEN') THEN 'then' WHEN control IN ('IF_ELSE', 'TERNARY_ELSE') THEN 'else' WHEN control = 'SWITCH_DEFAULT' THEN 'default' WHEN control = 'CATCH' THEN 'catch' WHEN control = 'FINALLY' THEN 'finally' WHEN control = 'SWITCH_CASE' THEN 'case' ELSE 'branch' END)"


@query(
    _TRACE
    + f""", b AS (SELECT e, unnest(CASE WHEN leaves THEN list_filter(names, lambda x: x.now = '*' OR NOT {_KILLED}) WHEN NOT list_contains(keys, to_id || '#' || to_method) AND d < 8 THEN {_NEXT} END) AS x, branch_group, {_LABEL} AS label, control FROM t JOIN k ON k.from_id = c AND k.from_method = m WHERE trim(branch_group) <> '' AND (leaves OR inline))
SELECT DISTINCT e AS entrypoint_id, x.first AS tracked, branch_group AS branch_id, branch_group || ':' || label AS arm_id, label, CASE WHEN control IN ('CATCH', 'FINALLY') THEN 'EXCEPTION' ELSE 'CONDITIONAL' END AS edge_kind,
 CASE WHEN control LIKE 'SWITCH%' THEN 'SWITCH' WHEN control LIKE 'TERNARY%' THEN 'TERNARY' WHEN control IN ('CATCH', 'FINALLY') THEN 'TRY' ELSE 'IF' END AS branch_kind FROM b""",
    *_TRACED,
)
def branch_topology(p):
    return W.branch_topology(_states(p), p.calls, p.components)
