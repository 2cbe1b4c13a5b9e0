"""Queries over facts about source code, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions.scalar import RECEIVER_EVIDENCE
from weftgraph.operators import dependencies as D
from weftgraph.operators import frameworks as W
from weftgraph.operators import receivers as Z
from weftgraph.operators import topics as N
from weftgraph.plans.registry import query


def _words(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_CODE = ("code_types", "code_supertypes", "code_fields", "code_locals", "code_methods", "code_calls")

#: Receivers as one statement: closures by recursion, every way a row, the first way of a call kept.
_RECEIVERS = f"""+ up(type, ancestor) AS (SELECT type, supertype FROM code_supertypes WHERE type <> supertype UNION SELECT up.type, s.supertype FROM up JOIN code_supertypes s ON s.type = up.ancestor WHERE s.supertype <> up.type),
classes(type, ancestor, depth) AS (SELECT type, supertype, 1 FROM code_supertypes WHERE is_class UNION SELECT c.type, s.supertype, depth + 1 FROM classes c JOIN code_supertypes s ON s.type = c.ancestor WHERE s.is_class),
known AS (SELECT * FROM code_types WHERE component_id IS NOT NULL),
targets_of AS (SELECT id AS declared, id AS target, 0 AS far, 'DECLARED_FIELD_TYPE' AS evidence FROM known WHERE NOT abstract UNION ALL SELECT ancestor, type, 1, 'SMALL_POLYMORPHIC_EXPANSION' FROM up JOIN known ON id = type WHERE NOT abstract),
every AS (SELECT * FROM targets_of UNION ALL SELECT id, id, 2, 'DECLARED_INTERFACE_ONLY' FROM known WHERE abstract AND id NOT IN (SELECT declared FROM targets_of)),
expanded AS (SELECT declared, target, evidence, row_number() OVER (PARTITION BY declared ORDER BY far, target) AS place, count(*) OVER (PARTITION BY declared) > {Z.MOST} AS capped FROM every QUALIFY place <= {Z.MOST}),
seen AS (SELECT o AS owner, name, declared, allocated, elements, injected FROM (SELECT owner AS o, 0 AS depth, f.* FROM code_fields f UNION ALL SELECT c.type, depth, f.* FROM code_fields f JOIN classes c ON c.ancestor = f.owner) x QUALIFY row_number() OVER (PARTITION BY o, name ORDER BY depth, ord) = 1),
firsts AS (SELECT owner, method, name, coalesce(elements, '') AS elements FROM code_locals QUALIFY row_number() OVER (PARTITION BY owner, method, name ORDER BY ord) = 1),
told AS (SELECT l.owner, l.method, l.name, coalesce(l.allocated, l.elements, nullif(coalesce(r.elements, s.elements), '')) AS targets, CASE WHEN l.allocated IS NOT NULL THEN 'LOCAL_ASSIGNMENT' ELSE 'COLLECTION_ELEMENT_ALLOCATION' END AS evidence
  FROM code_locals l LEFT JOIN firsts r ON r.owner = l.owner AND r.method = l.method AND r.name = l.iterates LEFT JOIN seen s ON s.owner = l.owner AND s.name = l.iterates
  WHERE targets IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l.owner, l.method, l.name ORDER BY l.ord) = 1),
accessors AS (SELECT name, min(owner) AS owner FROM code_methods WHERE owner IN (SELECT id FROM known) GROUP BY name),
ways AS (
  SELECT c.ord, 0 AS way, unnest(string_split(s.elements, ',')) AS type, generate_subscripts(string_split(s.elements, ','), 1) - 1 AS place, 'ARRAY_ELEMENT_ALLOCATION' AS evidence, false AS capped FROM code_calls c JOIN seen s USING (owner, name) WHERE target = 'array' AND s.elements IS NOT NULL
  UNION ALL SELECT c.ord, 1, e.target, place, evidence, capped FROM code_calls c JOIN seen s USING (owner, name) JOIN expanded e ON e.declared = s.declared WHERE c.target = 'array'
  UNION ALL SELECT c.ord, 0, e.target, place, 'ACCESSOR_RETURN', capped FROM code_calls c JOIN expanded e ON e.declared = accessor_type WHERE c.target = 'call'
  UNION ALL SELECT c.ord, 1, a.owner, 0, CASE WHEN callee IN {_words(Z.COLLECTION_CALLS)} THEN 'ACCESSOR_STATE_OWNER' ELSE 'ACCESSOR_NAME_FALLBACK' END, false FROM code_calls c JOIN accessors a ON a.name = accessor
    WHERE target = 'call' AND accessor NOT IN {_words(Z.LIBRARY_CALLS)} AND (accessor_type IS NULL OR callee IN {_words(Z.COLLECTION_CALLS)})
  UNION ALL SELECT c.ord, 0, unnest(string_split(t.targets, ',')), generate_subscripts(string_split(t.targets, ','), 1) - 1, t.evidence, false FROM code_calls c JOIN told t USING (owner, method, name) WHERE target IN ('variable', 'field')
  UNION ALL SELECT c.ord, 1, s.allocated, 0, 'CONSTRUCTOR_ASSIGNMENT', false FROM code_calls c JOIN seen s USING (owner, name) WHERE target IN ('variable', 'field') AND s.allocated IS NOT NULL
  UNION ALL SELECT c.ord, 2, e.target, place, evidence, capped FROM code_calls c JOIN seen s USING (owner, name) JOIN expanded e ON e.declared = s.declared WHERE c.target IN ('variable', 'field') AND s.allocated IS NULL
  UNION ALL SELECT c.ord, 3, e.target, place, evidence, capped FROM code_calls c JOIN expanded e ON e.declared = c.declared WHERE c.target IN ('variable', 'field') AND name IS NOT NULL),
found AS (SELECT ord, type, place, evidence, CASE evidence {" ".join(f"WHEN '{k}' THEN {v}" for k, v in RECEIVER_EVIDENCE.items())} END::DOUBLE AS confidence, capped FROM ways QUALIFY way = min(way) OVER (PARTITION BY ord))"""


def _facts(p):
    """invocations, types, supertypes, fields, locals, methods, with lists as arrays."""
    lists = lambda df: df.withColumn("elements", F.split("elements", ","))
    return p.code_calls, p.code_types, p.code_supertypes, lists(p.code_fields), lists(p.code_locals), p.code_methods


@query(_RECEIVERS + " SELECT ord, type, place::INTEGER AS place, evidence, confidence, capped FROM found", *_CODE)
def receivers_resolved(p):
    """The types that the receiver of every call can be."""
    return Z.resolve(*_facts(p))


@query(
    _RECEIVERS
    + """, single AS (SELECT f.owner, f.name, f.rank, min(k.component_id) AS component_id FROM (SELECT owner, name, 0 AS rank, declared AS t FROM seen UNION ALL SELECT owner, name, 1, injected FROM seen) f
  LEFT JOIN known o ON o.id = f.owner JOIN (SELECT id AS t, 0 AS far, component_id FROM known UNION ALL SELECT ancestor, 1, component_id FROM up JOIN known ON id = type WHERE NOT abstract) k ON k.t = f.t
  WHERE k.component_id IS DISTINCT FROM o.component_id GROUP BY f.owner, f.name, f.rank HAVING count(*) FILTER (WHERE far = 0) > 0 OR count(DISTINCT k.component_id) = 1),
direct AS (SELECT f.owner, f.name, f.rank, k.component_id FROM (SELECT owner, name, 0 AS rank, declared AS t FROM seen UNION ALL SELECT owner, name, 1, injected FROM seen) f LEFT JOIN known o ON o.id = f.owner JOIN known k ON k.id = f.t WHERE k.component_id IS DISTINCT FROM o.component_id),
held AS (SELECT s.owner, s.name, coalesce(d.component_id, s.component_id) AS component_id FROM single s LEFT JOIN direct d USING (owner, name, rank) QUALIFY row_number() OVER (PARTITION BY s.owner, s.name ORDER BY s.rank) = 1),
mine AS (SELECT c.*, k.component_id AS from_id FROM code_calls c JOIN known k ON k.id = c.owner),
edges AS (SELECT m.ord, m.from_id, m.method, k.component_id AS to_id, m.callee, m.arm, f.place, 'direct' AS call_kind, lower(replace(f.evidence, '_', '-')) AS evidence, f.confidence, f.capped FROM mine m JOIN found f USING (ord) JOIN known k ON k.id = f.type
  UNION ALL SELECT m.ord, m.from_id, m.method, h.component_id, m.callee, m.arm, 0, 'direct', 'legacy-field-read', 0.85, false FROM mine m JOIN held h USING (owner, name) WHERE m.target = 'field' AND m.ord NOT IN (SELECT ord FROM found)
  UNION ALL SELECT m.ord, m.from_id, m.method, m.from_id, m.callee, m.arm, 0, 'intra', NULL, NULL, false FROM mine m WHERE (m.target IS NULL OR m.target = 'this') AND m.callee <> m.method AND (m.owner, m.callee) IN (SELECT (owner, name) FROM code_methods)),
kept AS (SELECT * FROM edges WHERE call_kind = 'intra' OR from_id <> to_id QUALIFY row_number() OVER (PARTITION BY from_id, method, to_id, callee, arm ORDER BY ord, place) = 1),
dead AS (SELECT k.ord, string_agg(DISTINCT c.assigned, ',' ORDER BY c.assigned) AS killed FROM kept k JOIN code_calls m ON m.ord = k.ord JOIN code_calls c ON c.owner = m.owner AND c.method = m.method AND c.ord < m.ord WHERE c.assigned IS NOT NULL GROUP BY k.ord)
SELECT from_id, method AS from_method, to_id, callee AS to_method, arm, call_kind, evidence, confidence, capped, coalesce(evidence, '') = 'accessor-name-fallback' AS ambiguous, CASE WHEN call_kind = 'intra' THEN '' ELSE coalesce(killed, '') END AS killed
FROM kept LEFT JOIN dead USING (ord)""",
    *_CODE,
)
def call_edges_resolved(p):
    """Call edges between components, with what is known about each call's receiver."""
    calls, types, supertypes, fields, variables, methods = _facts(p)
    return Z.call_edges(calls, types, supertypes, fields, variables, methods).withColumn("killed", F.array_join("killed", ","))


_STATE = "type_name NOT IN " + _words(Z.NEVER_STATE) + "".join(f" AND NOT starts_with(type_name, '{p}')" for p in Z.NEVER_STATE_PREFIXES) + " AND (type_name IN " + _words(Z.STATE_TYPES) + "".join(f" OR ends_with(type_name, '{e}') OR ends_with(name, '{e[0].lower() + e[1:]}')" for e in Z.STATE_ENDINGS) + ")"


@query(f"SELECT ord, owner, method, name AS field, CASE WHEN callee IN {_words(Z.WRITING_CALLS)} THEN 'WRITE' ELSE 'READ' END AS kind FROM code_calls JOIN (SELECT DISTINCT owner, name FROM code_fields WHERE {_STATE}) f USING (owner, name) WHERE target = 'field'", "code_fields", "code_calls")
def state_accesses(p):
    """Reads and writes of shared state by calls on a type's own fields."""
    return Z.state_accesses(p.code_calls, p.code_fields)


# ---- topics

_CONSTANTS = f"""steps AS (SELECT id AS expression, init AS next FROM code_expressions WHERE kind IN ('field', 'local') AND init IS NOT NULL
  UNION SELECT e.id, a.expression FROM code_expressions e JOIN code_arguments a USING (owner, method, position) WHERE e.kind = 'param' AND NOT e.message
  UNION SELECT e.id, h.expression FROM code_expressions e JOIN code_arguments a ON a.owner = e.owner AND a.method = e.method JOIN code_headers h ON h.caller = a.caller AND h.caller_method = a.caller_method WHERE e.kind = 'param' AND e.message
  UNION SELECT e.id, r.expression FROM code_expressions e JOIN code_supertypes s ON s.supertype = e.receiver_type JOIN code_returns r ON r.owner = s.type AND r.method = e.callee WHERE e.kind = 'call'),
literals AS (SELECT id, value FROM code_expressions WHERE kind = 'literal' UNION ALL SELECT f.id, l.value FROM code_expressions f JOIN code_expressions l ON l.id = f.init WHERE f.kind = 'field' AND l.kind = 'literal'),
walked(root, expression, hop) AS (SELECT DISTINCT root, root, 1 FROM roots UNION SELECT w.root, s.next, hop + 1 FROM walked w JOIN steps s USING (expression) WHERE hop < {N.DEPTH}),
constants AS (SELECT DISTINCT root, value FROM walked JOIN literals ON id = expression)"""


@query(
    f"""+ open AS (SELECT * FROM code_sites WHERE topic IS NULL AND kind <> 'LITERAL'),
calls AS (SELECT o.id, o.accessor, o.param_type, a.call, a.expression AS argument, a.type AS argument_type, a.caller, a.caller_method, CASE WHEN o.accessor IS NULL THEN o.evidence WHEN o.evidence IS NULL THEN 'topic-expansion' ELSE o.evidence || '+topic-expansion' END AS evidence
  FROM open o JOIN code_arguments a USING (owner, method, position, arity)),
own AS (SELECT c.*, r.expression AS root FROM calls c JOIN code_types t ON t.id = c.argument_type AND NOT t.abstract JOIN code_returns r ON r.owner = c.argument_type AND r.method = c.accessor),
impl AS (SELECT c.*, r.expression AS root FROM calls c JOIN code_supertypes s ON s.supertype = c.param_type JOIN code_returns r ON r.owner = s.type AND r.method = c.accessor),
roots AS (SELECT expression AS root FROM open WHERE position IS NULL AND expression IS NOT NULL UNION SELECT argument FROM calls WHERE accessor IS NULL UNION SELECT root FROM own UNION SELECT root FROM impl),
{_CONSTANTS},
by_own AS (SELECT DISTINCT id, call, value, caller, caller_method, evidence FROM own JOIN constants USING (root)),
found AS (SELECT DISTINCT id, value AS topic, NULL AS only_component, NULL AS only_method, evidence FROM open JOIN constants ON root = expression WHERE position IS NULL
  UNION SELECT id, value, caller, caller_method, evidence FROM calls JOIN constants ON root = argument WHERE accessor IS NULL
  UNION SELECT id, value, caller, caller_method, evidence FROM by_own
  UNION SELECT id, value, caller, caller_method, evidence FROM impl JOIN constants USING (root) WHERE (id, call) NOT IN (SELECT (id, call) FROM by_own))
SELECT * FROM found UNION ALL SELECT id, topic, NULL, NULL, evidence FROM code_sites WHERE id NOT IN (SELECT id FROM found)""",
    "code_types",
    "code_supertypes",
    "code_expressions",
    "code_arguments",
    "code_headers",
    "code_returns",
    "code_sites",
)
def topics_resolved(p):
    """Every outbound site with each topic that it can send to."""
    types = p.code_types.select("id", F.col("abstract").alias("interface"))
    return N.resolve_topics(p.code_sites, p.code_expressions, p.code_arguments, p.code_headers, p.code_returns, types, p.code_supertypes)


# ---- dependencies


@query(
    f"""+ c AS (SELECT id, 'type:' || ord::VARCHAR AS qualified_name, type, module FROM components WHERE ord % 9 <> 8),
lone AS (SELECT supertype, min(type) AS implementor FROM code_apis WHERE NOT is_class AND type IN (SELECT qualified_name FROM c) GROUP BY supertype HAVING count(*) = 1),
held AS (SELECT h.ord, h.owner, coalesce(d.qualified_name, l.implementor) AS type, list_has_any(string_split(coalesce(annotations, ''), ','), {list(D.INJECTING)}) AS marked, d.id IS NULL AND is_final AS implied FROM code_held h LEFT JOIN c d ON d.qualified_name = h.type LEFT JOIN lone l ON l.supertype = h.type),
every AS (SELECT a.id AS from_id, b.id AS to_id, 0 AS place, h.ord, marked OR implied AS injected, a.module IS NOT DISTINCT FROM b.module AS same, b.type AS to_type, 'field' AS how FROM held h JOIN c a ON a.qualified_name = h.owner JOIN c b ON b.qualified_name = h.type
  UNION ALL SELECT a.id, b.id, 1, s.ord, false, false, '', 'signature' FROM code_signatures s JOIN c a ON a.qualified_name = s.owner JOIN c b ON b.qualified_name = s.type)
SELECT from_id, to_id, CASE WHEN how = 'signature' THEN 'type-usage' WHEN injected THEN 'injection' ELSE 'field-reference' END AS kind, CASE WHEN how = 'signature' THEN 'method-signature' WHEN injected THEN 'annotation' ELSE 'type-relation' END AS derived_from,
  CASE WHEN how = 'signature' THEN 0.5 WHEN injected THEN CASE WHEN to_type IN ('REPOSITORY', 'REMOTE_SERVICE') THEN 0.93 ELSE 0.9 END ELSE round(0.55 + CASE WHEN same THEN 0.05 ELSE 0 END + CASE WHEN to_type IN ('ENTITY', 'UTILITY', 'UNKNOWN') THEN 0 ELSE 0.05 END, 2) END::DOUBLE AS confidence
FROM every WHERE from_id <> to_id QUALIFY row_number() OVER (PARTITION BY from_id, to_id ORDER BY place, ord) = 1""",
    "components",
    "code_apis",
    "code_held",
    "code_signatures",
)
def dependencies_extracted(p):
    """Dependencies between components, told by their fields and signatures."""
    components = p.components.where("ord % 9 <> 8").select("id", F.concat(F.lit("type:"), F.col("ord").cast("string")).alias("qualified_name"), "type", "module")
    return D.extract(components, p.code_apis, p.code_held.withColumn("annotations", F.split("annotations", ",")), p.code_signatures)


# ---- frameworks

_RULES = "rules(framework, rank, place, mark, component_type, technology, stereotype) AS (VALUES " + ", ".join(f"('{f}', {r}, '{p}', '{m}', '{c}', '{t}', '{s}')" for f in W.COMPONENTS for r, p, m, c, t, s in W.rule_rows(f)) + ")"
_MEMBERS = ("code_classes", "code_members", "code_annotations")

_FOUND = f"""+ {_RULES},
marked AS (SELECT type, 'type' AS place, name AS mark FROM code_annotations WHERE member IS NULL UNION SELECT a.type, m.kind, a.name FROM code_annotations a JOIN code_members m ON m.type = a.type AND m.name = a.member UNION SELECT id, 'parent', unnest(string_split(parents, ',')) FROM code_classes),
met AS (SELECT framework, type, min(rank) AS rank, bool_or(stereotype = 'messaging') AS messaging FROM marked JOIN rules USING (mark) WHERE rules.place = marked.place OR (rules.place = 'any' AND marked.place IN ('type', 'method')) GROUP BY framework, type),
named AS (SELECT DISTINCT framework, c.id, c.name, c.parents, c.interface, lower(c.name) AS low, r.component_type AS given, technology, stereotype, messaging FROM met JOIN (SELECT DISTINCT framework, rank, component_type, technology, stereotype FROM rules) r USING (framework, rank) JOIN code_classes c ON c.id = type),
found AS (SELECT framework, id, name, parents, technology, CASE WHEN given <> '' THEN given WHEN regexp_matches(low, '(repository|repo|dao)$') THEN 'REPOSITORY' WHEN regexp_matches(low, 'service$') THEN 'SERVICE' WHEN regexp_matches(low, '(client|proxy)$') THEN 'HTTP_CLIENT' ELSE 'SERVICE' END AS component_type,
  CASE WHEN given <> '' THEN stereotype || CASE WHEN interface AND stereotype = 'rest-client' THEN ',interface' ELSE '' END
    ELSE concat_ws(',', CASE WHEN regexp_matches(low, '(repository|repo|dao)$') THEN 'repository' WHEN regexp_matches(low, 'service$') THEN 'service' WHEN regexp_matches(low, '(client|proxy)$') THEN 'client' END, CASE WHEN messaging THEN 'messaging' END) END AS stereotypes FROM named)"""


def _code(p):
    """types, members and annotations, with lists as arrays and attributes as maps."""
    pair = F.map_filter(F.create_map(F.coalesce("attribute", F.lit("")), "value"), lambda k, _: k != "")
    return p.code_classes.withColumn("parents", F.split("parents", ",")), p.code_members.withColumn("parameter_types", F.split("parameter_types", ",")), p.code_annotations.withColumn("attributes", pair)


def _of_each(make):
    """make(framework) for every framework, with its name."""
    out = None
    for f in W.COMPONENTS:
        one = make(f).select(F.lit(f).alias("framework"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(_FOUND + " SELECT framework, id, component_type, technology, stereotypes FROM found", *_MEMBERS)
def framework_components(p):
    """Components that the rules of each framework find."""
    types, members, annotations = _code(p)
    return _of_each(lambda f: W.components(types, members, annotations, f))


_PLAIN = "CASE " + " ".join("WHEN " + " OR ".join([*(f"contains(lower(qualified_name), '{x}')" for x in parts), *(f"ends_with(lower(name), '{x}')" for x in endings)]) + f" THEN '{c}'" for parts, endings, c in W.PLAIN) + " ELSE 'UNKNOWN' END"


@query(f"SELECT id, {_PLAIN} AS component_type FROM code_classes", "code_classes")
def plain_components(p):
    """Component types of classes that no framework claims."""
    return p.code_classes.select("id", W.plain_type(F.col("qualified_name"), F.col("name")).alias("component_type"))


def _sql_path(base: str, child: str) -> str:
    return f"regexp_replace('/' || {base} || CASE WHEN ends_with({base}, '/') OR starts_with({child}, '/') OR {child} = '' THEN '' ELSE '/' END || {child}, '/+', '/', 'g')"


def _first(*values: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({v}, '')" for v in values) + ", '')"


_PATHS = [f"{{0}}['{n}.{a}']" for n in ("RequestMapping", *W.MAPPINGS) for a in ("value", "path")]
_SPRING_PATH = _sql_path("'/shop'", _sql_path(_first(*(x.format("t") for x in _PATHS)), _first(*(x.format("a") for x in _PATHS))))
_JAX_PATH = _sql_path(_first("t['Path.value']"), _first("a['Path.value']"))
_HAS = "coalesce(list_contains(names, '{}'), false)"
_VERB = "CASE " + " ".join(f"WHEN {_HAS.format(v)} THEN '{v}'" for v in W.HTTP) + " END"
_SPRING_VERB = "CASE " + " ".join(f"WHEN {_HAS.format(n)} THEN '{v}'" for n, v in W.MAPPINGS.items()) + f" WHEN {_HAS.format('RequestMapping')} THEN CASE " + " ".join(f"WHEN contains(coalesce(a['RequestMapping.method'], ''), '{v}') THEN '{v}'" for v in W.VERBS) + " ELSE 'REQUEST' END END"
_LISTENED = " UNION ALL ".join(
    f"SELECT framework, id, member, '{kind}', 'spring-listener:{broker}:' || x, NULL, NULL, x, '{broker}', NULL, NULL FROM (SELECT *, coalesce(nullif(trim({_first(*(marks + chr(91) + chr(39) + n + '.' + c + chr(39) + chr(93) for c in of))}), ''), '{W.UNRESOLVED}') AS x FROM each WHERE framework = 'spring' AND method AND {when}) e"
    for n, (kind, broker, of), marks, when in [*((n, v, "a", _HAS.format(n)) for n, v in W.LISTENERS.items()), ("KafkaListener", W.LISTENERS["KafkaListener"], "t", f"coalesce(list_contains(type_names, 'KafkaListener'), false) AND {_HAS.format('KafkaHandler')}")]
)

_ENTRIES = (
    _FOUND
    + f""", marks AS (SELECT type, member, list(name) AS names, map_from_entries(list((name || '.' || coalesce(attribute, ''), value))) AS a FROM code_annotations GROUP BY type, member),
each AS (SELECT f.*, m.name AS member, m.kind = 'method' AS method, m.static, m.public, m.type_name, m.parameter_types, e.names, e.a, y.names AS type_names, y.a AS t, coalesce(list_contains(string_split(parents, ','), 'CommandLineRunner') OR list_contains(string_split(parents, ','), 'ApplicationRunner'), false) AS runs,
    regexp_matches(parents, 'Post(Insert|Update|Delete)EventListener') AS listens FROM found f JOIN code_members m ON m.type = f.id LEFT JOIN marks e ON e.type = f.id AND e.member = m.name LEFT JOIN marks y ON y.type = f.id AND y.member IS NULL),
quarkus AS (SELECT *, {_VERB} AS verb, {_JAX_PATH} AS full_path, regexp_matches({_first("a['Produces.value']", "t['Produces.value']")}, 'text/event-stream|SERVER_SENT_EVENTS') OR type_name IN ('Sse', 'SseEventSink') OR coalesce(list_has_any(string_split(parameter_types, ','), ['Sse', 'SseEventSink']), false) AS sse,
    {_HAS.format("OnMessage")} AS socket FROM each WHERE framework = 'quarkus'),
further AS (SELECT * FROM quarkus WHERE method AND technology <> 'grpc' AND NOT socket AND (verb IS NULL OR component_type = 'HTTP_CLIENT')),
made(framework, type, member, kind, suffix, http_method, path, channel, broker, trigger_kind, trigger) AS (
  SELECT framework, id, member, 'REST_ENDPOINT', v || ':' || x, v, x, NULL, NULL, NULL, NULL FROM (SELECT *, {_SPRING_VERB} AS v, {_SPRING_PATH} AS x FROM each WHERE framework = 'spring' AND method AND component_type <> 'HTTP_CLIENT') s WHERE v IS NOT NULL
  UNION ALL SELECT framework, id, member, 'SCHEDULER', 'scheduled', NULL, NULL, NULL, NULL, CASE WHEN a['Scheduled.cron'] <> '' THEN 'CRON' WHEN a['Scheduled.fixedRateString'] <> '' THEN 'FIXED_RATE' END, coalesce(a['Scheduled.cron'], a['Scheduled.fixedRateString']) FROM each WHERE framework = 'spring' AND method AND {_HAS.format("Scheduled")}
  UNION ALL {_LISTENED}
  UNION ALL SELECT framework, id, member, 'MAIN_METHOD', 'startup', NULL, NULL, NULL, NULL, NULL, NULL FROM each WHERE framework = 'spring' AND method AND ((member = 'main' AND static) OR (member = 'run' AND runs))
  UNION ALL SELECT framework, id, member, 'ENTITY_EVENT_LISTENER', 'entity-event', NULL, NULL, NULL, NULL, NULL, NULL FROM each WHERE framework = 'spring' AND method AND listens AND member IN ('onPostInsert', 'onPostUpdate', 'onPostDelete')
  UNION ALL SELECT framework, id, member, 'GRPC_METHOD', 'grpc', NULL, name || '/' || member, NULL, NULL, NULL, NULL FROM quarkus WHERE method AND technology = 'grpc' AND public AND member <> 'bindService'
  UNION ALL SELECT framework, id, member, 'WEBSOCKET_ENDPOINT', 'websocket', NULL, coalesce(t['ServerEndpoint.value'], ''), NULL, NULL, NULL, NULL FROM quarkus WHERE method AND technology <> 'grpc' AND socket
  UNION ALL SELECT framework, id, member, CASE WHEN sse THEN 'SSE_ENDPOINT' ELSE 'REST_ENDPOINT' END, CASE WHEN sse THEN 'sse' ELSE '' END, verb, full_path, NULL, NULL, NULL, NULL FROM quarkus WHERE method AND technology <> 'grpc' AND NOT socket AND verb IS NOT NULL AND component_type <> 'HTTP_CLIENT'
  UNION ALL SELECT framework, id, member, 'SCHEDULER', 'scheduled', NULL, NULL, NULL, NULL, CASE WHEN a['Scheduled.cron'] <> '' THEN 'CRON' WHEN a['Scheduled.every'] <> '' THEN 'EVERY' END, coalesce(a['Scheduled.cron'], a['Scheduled.every']) FROM further WHERE {_HAS.format("Scheduled")}
  UNION ALL SELECT framework, id, member, 'MESSAGING_CONSUMER', 'msg-in:' || a['Incoming.value'], NULL, NULL, a['Incoming.value'], 'UNKNOWN', NULL, NULL FROM further WHERE a['Incoming.value'] <> ''
  UNION ALL SELECT framework, id, member, 'MESSAGING_PRODUCER', 'msg-out:' || a['Outgoing.value'], NULL, NULL, a['Outgoing.value'], 'UNKNOWN', NULL, NULL FROM further WHERE a['Outgoing.value'] <> ''
  UNION ALL SELECT framework, id, member, 'MESSAGING_PRODUCER', 'emitter:' || a['Channel.value'], NULL, NULL, a['Channel.value'], 'UNKNOWN', NULL, NULL FROM quarkus WHERE NOT method AND technology <> 'grpc' AND a['Channel.value'] <> ''
  UNION ALL SELECT framework, id, member, 'REST_ENDPOINT', '', v, {_JAX_PATH}, NULL, NULL, NULL, NULL FROM (SELECT *, {_VERB} AS v FROM each WHERE framework = 'javaee' AND method) e WHERE v IN ('GET', 'POST', 'PUT', 'DELETE', 'PATCH')
  UNION ALL SELECT framework, id, member, 'JMS_CONSUMER', '', NULL, NULL, NULL, NULL, NULL, NULL FROM each WHERE framework = 'javaee' AND method AND component_type = 'MESSAGE_DRIVEN_BEAN' AND member = 'onMessage' AND ({_VERB}) IS NULL)"""
)


def _entries(p, framework):
    types, members, annotations = _code(p)
    return W.entrypoints(W.components(types, members, annotations, framework), types, members, annotations, framework, "/shop" if framework == "spring" else "")


@query(_ENTRIES + " SELECT * FROM made", *_MEMBERS)
def framework_entrypoints(p):
    """Entrypoints of the components that each framework's rules find."""
    return _of_each(lambda f: _entries(p, f))


@query(
    _ENTRIES
    + """, i AS (SELECT DISTINCT framework, CASE kind WHEN 'REST_ENDPOINT' THEN 'rest_endpoint' WHEN 'SSE_ENDPOINT' THEN 'sse_endpoint' WHEN 'JMS_CONSUMER' THEN CASE WHEN channel IS NOT NULL THEN 'jms_consumer' END WHEN 'MESSAGING_CONSUMER' THEN 'messaging_consumer' WHEN 'MESSAGING_PRODUCER' THEN 'messaging_producer' END AS type,
  CASE WHEN path IS NOT NULL THEN http_method || ' ' || path ELSE channel END AS name, coalesce(path, channel) AS path, type AS component, broker, CASE WHEN path IS NULL THEN channel END AS topic FROM made)
SELECT 'iface:' || component || ':' || type || ':' || name AS id, framework, type, name, min(path) AS path, component, min(broker) AS broker, min(topic) AS topic FROM i WHERE type IS NOT NULL GROUP BY framework, type, name, component""",
    *_MEMBERS,
)
def framework_interfaces(p):
    """Interfaces that the entrypoints of each framework offer or use."""
    return _of_each(lambda f: W.interfaces(_entries(p, f)))
