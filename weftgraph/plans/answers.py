"""The question families over the software model, each with its answer in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import answers as A
from weftgraph.operators import flow as W
from weftgraph.operators import linkers as L
from weftgraph.operators import policy as Y
from weftgraph.plans.flows import _VISITS, _visits
from weftgraph.plans.model import _all_links_sql
from weftgraph.plans.registry import _walks, query
from weftgraph.sources import okf as B
from weftgraph.sources.store import shared_folder


def _subject(rel: str, ref: str, kind: str) -> str:
    """CTEs `hits`, `target` (id) and `codes` (section, item) of a reference."""
    low = ref.lower()
    return f"""hits AS (SELECT id, id = '{ref}' OR name = '{ref}' AS exact FROM {rel} WHERE contains(lower(id), '{low}') OR contains(lower(name), '{low}')),
picked AS (SELECT id FROM hits WHERE exact OR NOT EXISTS (SELECT 1 FROM hits WHERE exact)), target AS (SELECT id FROM picked WHERE (SELECT count(*) FROM picked) = 1),
codes AS (SELECT 'ambiguous' AS section, '{kind}-reference-matched-' || count(*)::VARCHAR || '-nodes:{ref}' AS item FROM picked HAVING count(*) > 1 UNION ALL SELECT 'unresolved', '{kind}-not-resolved:{ref}' FROM picked HAVING count(*) = 0)"""


def _answer(ctes: str, sections: dict[str, str], codes: list[str]) -> str:
    """sections: SELECT item, detail; codes: SELECT section, item."""
    rows = " UNION ".join(f"SELECT '{n.split('|')[0]}' AS section, item::VARCHAR AS item, detail::VARCHAR AS detail FROM ({q}) q{i}" for i, (n, q) in enumerate(sections.items()))
    marks = " UNION ".join(f"SELECT section, item::VARCHAR AS item FROM ({q}) c{i}" for i, q in enumerate(codes))
    return f"""+ {ctes}, marks AS ({marks}), answer AS ({rows} UNION SELECT section, item, NULL FROM marks)
SELECT * FROM answer UNION ALL SELECT 'status', CASE WHEN EXISTS (SELECT 1 FROM marks WHERE section = 'ambiguous') THEN 'ambiguous' WHEN EXISTS (SELECT 1 FROM marks WHERE section = 'unresolved') THEN 'partial' ELSE 'resolved' END, NULL"""


def _absent(code: str, rows: str) -> str:
    return f"SELECT 'unresolved' AS section, '{code}' AS item WHERE NOT EXISTS ({rows})"


_CODES = "SELECT * FROM codes"
_MODEL = ("model_nodes", "model_edges")


# ---- impact

_GROUP = "CASE WHEN label = 'Entrypoint' THEN 'entrypoints' WHEN label IN ('DataFlowPath', 'DataFlowSink') THEN 'workflows' WHEN label IN ('PersistenceUnit', 'DataSource', 'TransactionBoundary') THEN 'persistence' WHEN label IN ('ExternalSystem', 'Interface') THEN 'externalIntegrations' ELSE 'components' END"


def _impact(ref: str) -> str:
    ctes = _subject("components", ref, "component") + ", start AS (SELECT id, 0 AS hop FROM target), " + _walks("SELECT DISTINCT dst AS a, src AS b FROM model_edges", 4)
    ctes += """, far AS MATERIALIZED (SELECT id, min(hop) AS hop FROM w GROUP BY id), next AS MATERIALIZED (SELECT a.id, arg_min(b.id, (e.ord, e.label, b.id)) AS nxt, arg_min(e.label, (e.ord, e.label, b.id)) AS lbl FROM far a JOIN model_edges e ON e.src = a.id JOIN far b ON b.id = e.dst AND b.hop = a.hop - 1 GROUP BY a.id),
chain(here, hop, ids, labels) AS (SELECT id, hop, id, '' FROM (SELECT * FROM far WHERE hop > 0 ORDER BY hop, id LIMIT 50) x UNION ALL SELECT nxt, hop - 1, ids || '>' || nxt, labels || '>' || lbl FROM chain JOIN next ON next.id = here WHERE hop > 0)"""
    ctes += f", hit AS MATERIALIZED (SELECT {_GROUP} AS g, far.id, hop FROM far JOIN model_nodes n ON n.id = far.id WHERE hop > 0)"
    sections = {"subject": "SELECT id AS item, NULL AS detail FROM target"} | {g: f"SELECT id AS item, hop AS detail FROM hit WHERE g = '{g}'" for g in (*A.IMPACT_GROUPS, "components")}
    sections["evidenceChains"] = "SELECT ids AS item, substr(labels, 2) AS detail FROM chain WHERE hop = 0"
    return _answer(ctes, sections, [_CODES, _absent("no-impacted-nodes-found", "SELECT 1 FROM hit")])


@query(_impact("comp:7"), *_MODEL, "components")
def answer_impact(p):
    return A.impact(p.model, p.model, p.components, "comp:7")


@query(_impact("Mapper"), *_MODEL, "components")
def answer_impact_ambiguous(p):
    return A.impact(p.model, p.model, p.components, "Mapper")


@query(_impact("NoSuchThing"), *_MODEL, "components")
def answer_impact_unresolved(p):
    return A.impact(p.model, p.model, p.components, "NoSuchThing")


# ---- endpoints, consumers, transactions, schedules

_STEPS = ", steps1 AS (SELECT e AS entrypoint_id, c AS component_id, m AS method FROM (SELECT *, row_number() OVER (PARTITION BY e, c ORDER BY trail) AS r FROM seen) WHERE r = 1)"
_FLOW = ("entrypoints", "components", "calls")
_TX = """tx AS (SELECT f.*, type, coalesce(on_method, on_type, inherited) AS raw, coalesce(type IN ('EJB_STATELESS', 'MESSAGE_DRIVEN_BEAN'), false) AS ejb, EXISTS (SELECT 1 FROM calls k WHERE k.from_id = f.component_id AND k.to_id = f.component_id AND k.to_method = f.method) AS own_call FROM method_facts f JOIN components c ON c.id = f.component_id),
tx2 AS (SELECT *, upper(list_extract(string_split(trim(replace(raw, '"', '')), '.'), -1)) AS simple, CASE WHEN bean_managed AND ejb THEN 'bean-managed' WHEN on_method IS NOT NULL THEN 'method' WHEN on_type IS NOT NULL THEN 'type' WHEN inherited IS NOT NULL THEN 'inherited-type' WHEN ejb THEN 'ejb-default' WHEN programmatic THEN 'programmatic-api' END AS level FROM tx),
tx3 AS (SELECT *, level IN ('method', 'type', 'inherited-type') AS declared FROM tx2 WHERE level IS NOT NULL),
tx4 AS (SELECT *, programmatic AND (declared OR level = 'ejb-default') AS inside, declared AND framework = 'spring' AS spring FROM tx3),
policies AS (SELECT ord, component_id, method, level,
 CASE WHEN level IN ('bean-managed', 'programmatic-api') THEN 'PROGRAMMATIC' WHEN level = 'ejb-default' THEN 'REQUIRED' WHEN simple IN ('', 'DEFAULT') THEN 'REQUIRED' WHEN simple = 'REQUIRESNEW' THEN 'REQUIRES_NEW' WHEN simple = 'NOTSUPPORTED' THEN 'NOT_SUPPORTED' ELSE simple END AS policy,
 least(CASE level WHEN 'bean-managed' THEN 0.95 WHEN 'inherited-type' THEN 0.8 WHEN 'ejb-default' THEN 0.9 WHEN 'programmatic-api' THEN 0.6 ELSE 1.0 END, CASE WHEN inside OR (spring AND own_call) THEN 0.6 ELSE 1.0 END)::DOUBLE AS confidence,
 concat_ws(',', CASE WHEN level = 'inherited-type' THEN 'inherited-policy-runtime-resolution' END, CASE WHEN inside THEN 'programmatic-transaction-api-inside-declarative-boundary' END, CASE WHEN spring THEN 'proxy-semantics-runtime-dependent' END, CASE WHEN level = 'programmatic-api' THEN 'scope-controlled-by-programmatic-api' END, CASE WHEN spring AND own_call THEN 'spring-self-invocation-may-bypass-proxy' END) AS limitations FROM tx4)"""


def _policies(p):
    return Y.policies(p.method_facts, p.components, p.calls)


@query("+ " + _TX + " SELECT * FROM policies", "method_facts", "components", "calls")
def transaction_policies(p):
    return _policies(p)


def _sql_glob(value: str, pattern: str) -> str:
    return f"regexp_full_match({value}, replace(replace(replace({pattern}, '.', '\\.'), '$', '\\$'), '*', '.*'))"


_NAMED = "CASE upper(list_extract(string_split(trim({0}), '.'), -1)) WHEN '' THEN 'REQUIRED' WHEN 'DEFAULT' THEN 'REQUIRED' WHEN 'REQUIRESNEW' THEN 'REQUIRES_NEW' WHEN 'NOTSUPPORTED' THEN 'NOT_SUPPORTED' ELSE upper(list_extract(string_split(trim({0}), '.'), -1)) END"
_ADVISED = rf"""aims AS (SELECT DISTINCT file, advisor, regexp_extract(pointcut, '{Y.EXECUTION}', 1) AS tp, regexp_extract(pointcut, '{Y.EXECUTION}', 2) AS mp FROM xml_advice),
methods AS (SELECT component_id, method, method || '(' || ord::VARCHAR || ')' AS signature FROM method_facts),
advised AS (SELECT a.file, a.advisor AS place, c.id AS component_id, m.method, m.signature, x.propagation, x.read_only, x.isolation FROM aims a JOIN components c ON a.tp <> '' AND {_sql_glob("c.qualified_name", "a.tp")} JOIN methods m ON m.component_id = c.id AND {_sql_glob("m.method", "a.mp")}
  JOIN xml_advice x ON x.file = a.file AND x.advisor = a.advisor AND {_sql_glob("m.method", "x.pattern")} QUALIFY row_number() OVER (PARTITION BY a.file, a.advisor, c.id, m.signature ORDER BY length(replace(x.pattern, '*', '')) DESC, x.rule) = 1)"""


def _xml(p):
    """What the advice and the EJB descriptors say, and the advisors that reach no method."""
    types = p.components.select(F.col("id").alias("component_id"), "qualified_name", "name", F.lit(None).cast("string").alias("ejb_name"))
    methods = p.method_facts.select("component_id", "method", F.concat("method", F.lit("("), F.col("ord").cast("string"), F.lit(")")).alias("signature"))
    advised, unmet = Y.advised(p.xml_advice, types, methods)
    ejb = p.xml_ejb.withColumn("parameters", F.lit(None).cast("array<string>"))
    return advised, Y.described(ejb, types, methods.withColumn("parameter_types", F.array().cast("array<string>"))), unmet


@query(
    "+ " + _TX + ", " + _ADVISED + f""",
said AS (SELECT file, place, 'spring-xml' AS framework, {_NAMED.format("propagation")} AS policy, 0.9 AS confidence, component_id, method, signature FROM advised
  UNION ALL SELECT x.file, x.place, 'ejb-xml', {_NAMED.format("x.attribute")}, 1.0, m.component_id, m.method, m.signature FROM xml_ejb x JOIN components c ON c.name = x.ejb_name OR c.qualified_name = x.ejb_name JOIN methods m ON m.component_id = c.id AND {_sql_glob("m.method", "x.method")}),
last AS (SELECT *, count(*) OVER (PARTITION BY signature, component_id) AS n FROM said QUALIFY row_number() OVER (PARTITION BY component_id, signature ORDER BY file DESC, place DESC) = 1),
ann AS (SELECT p.component_id, p.method, p.method || '(' || p.ord::VARCHAR || ')' AS signature, p.policy, p.level, f.framework, p.confidence, p.limitations FROM policies p JOIN method_facts f ON f.ord = p.ord)
SELECT coalesce(l.component_id, a.component_id) AS component_id, coalesce(l.method, a.method) AS method, coalesce(l.signature, a.signature) AS signature, coalesce(l.policy, a.policy) AS policy, CASE WHEN l.file IS NULL THEN a.level ELSE 'xml' END AS level, coalesce(l.framework, a.framework) AS framework,
  CASE WHEN l.file IS NULL THEN a.confidence WHEN l.framework = 'spring-xml' AND (n > 1 OR coalesce(a.level, 'ejb-default') <> 'ejb-default') THEN 0.6 ELSE l.confidence END::DOUBLE AS confidence,
  CASE WHEN l.file IS NULL THEN a.limitations WHEN l.framework = 'spring-xml' AND (n > 1 OR coalesce(a.level, 'ejb-default') <> 'ejb-default') THEN 'coexisting-annotation-and-xml-advice' ELSE '' END AS limitations
FROM ann a FULL JOIN last l ON l.component_id = a.component_id AND l.signature = a.signature""",
    "method_facts", "components", "calls", "xml_advice", "xml_ejb",
)
def transaction_policies_xml(p):
    """Policies of methods after the XML descriptors have been laid over the annotations."""
    own = _policies(p).join(p.method_facts.select("ord", "framework"), "ord")
    own = own.select("component_id", "method", F.concat("method", F.lit("("), F.col("ord").cast("string"), F.lit(")")).alias("signature"), "policy", "level", "framework", "confidence", "limitations", (F.col("level") == "ejb-default").alias("defaulted"))
    return Y.upserted(own, *_xml(p)[:2])


@query("+ " + _ADVISED + f" SELECT file, advice, pattern AS method, {_NAMED.format('propagation')} AS policy, propagation AS native FROM xml_advice x WHERE rule = 0 AND (file, advisor) NOT IN (SELECT (file, place) FROM advised)", "method_facts", "components", "xml_advice")
def advisors_unresolved(p):
    """Advisors whose pointcut reaches no method that is known."""
    return _xml(p)[2]



def _steps(p):
    return W.flow_steps(_visits(p))


_EP = _subject("entrypoints", "ep:16", "entrypoint")
_OWN = ", mine AS (SELECT s.* FROM sinks s JOIN paths x ON x.id = s.path_id WHERE x.entrypoint_id IN (SELECT id FROM target)), flow AS (SELECT * FROM steps1 WHERE entrypoint_id IN (SELECT id FROM target))"


@query(
    _answer(
        _VISITS.lstrip("+ ") + _STEPS + ", " + _TX + ", " + _EP + _OWN + ", tt AS (SELECT f.component_id, f.method, policy FROM flow f JOIN policies q ON q.component_id = f.component_id AND q.method = f.method)",
        {
            "inbound": "SELECT concat_ws(' ', http_method, path) AS item, NULL AS detail FROM entrypoints WHERE id IN (SELECT id FROM target)",
            "owningComponent": "SELECT component_id AS item, NULL AS detail FROM entrypoints WHERE id IN (SELECT id FROM target)",
            "runtimeCalls": "SELECT component_id AS item, method AS detail FROM flow",
            "dataFlowSinks": "SELECT id AS item, entity AS detail FROM mine WHERE kind = 'PERSISTENCE'",
            "outboundCalls": "SELECT id AS item, kind AS detail FROM mine WHERE kind <> 'PERSISTENCE'",
            "transactionTransitions": "SELECT component_id || '#' || method AS item, policy AS detail FROM tt",
        },
        [_CODES, _absent("runtime-flow-not-resolved", "SELECT 1 FROM flow"), _absent("no-data-flow-sinks-resolved", "SELECT 1 FROM mine"), "SELECT 'unresolved' AS section, unnest(['security-not-modeled', 'response-schema-not-modeled']) AS item"],
    ),
    *_FLOW, "method_facts", "paths", "sinks",
)
def answer_endpoint_context(p):
    return A.endpoint_forward(p.entrypoints, "ep:16", _steps(p), p.paths, p.sinks, _policies(p))


@query(
    _answer(
        _subject("components", "comp:21", "component") + ", start AS (SELECT id, 0 AS hop FROM target), " + _walks("SELECT DISTINCT dst AS a, src AS b FROM model_edges", 4) + ", hit AS (SELECT e.id, e.type IN ('REST_ENDPOINT', 'GRPC_METHOD') AS served, min(hop) AS hop FROM w JOIN entrypoints e ON e.id = w.id WHERE hop > 0 GROUP BY ALL)",
        {"subject": "SELECT id AS item, NULL AS detail FROM target", "affectedEntrypoints": "SELECT id AS item, hop AS detail FROM hit WHERE served", "otherEntrypoints": "SELECT id AS item, hop AS detail FROM hit WHERE NOT served"},
        [_CODES, "SELECT 'unresolved' AS section, CASE WHEN count(*) > 0 THEN 'no-rest-typed-entrypoint-reaches-subject; non-rest callers found' ELSE 'no-entrypoint-reaches-subject' END AS item FROM hit HAVING count(*) FILTER (WHERE served) = 0"],
    ),
    *_MODEL, "components", "entrypoints",
)
def answer_endpoint_reverse(p):
    return A.endpoint_reverse(p.components, "comp:21", p.model_nodes, p.model_edges, p.entrypoints)


_CONSUMER = _answer(
    _all_links_sql().lstrip("+ ") + ", " + _VISITS.lstrip("+ ") + _STEPS + ", " + _EP + _OWN + ", up AS (SELECT DISTINCT f.entrypoint_id FROM wl JOIN paths t ON t.id = wl.to_path JOIN paths f ON f.id = wl.from_path WHERE t.entrypoint_id IN (SELECT id FROM target))",
    {
        "inboundBinding": "SELECT coalesce(topic, channel) AS item, broker AS detail FROM entrypoints WHERE id IN (SELECT id FROM target)",
        "upstream": "SELECT entrypoint_id AS item, NULL AS detail FROM up",
        "downstream": "SELECT id AS item, kind AS detail FROM mine",
        "downstream|": "SELECT component_id AS item, method AS detail FROM flow",
    },
    [_CODES, "SELECT 'unresolved' AS section, 'consumer-binding-destination-not-resolved' AS item FROM entrypoints WHERE id IN (SELECT id FROM target) AND channel IS NULL AND topic IS NULL", _absent("no-upstream-producer-linked", "SELECT 1 FROM up"), _absent("no-downstream-flow-or-sink-resolved", "SELECT 1 FROM mine UNION ALL SELECT 1 FROM flow")],
)


@query(
    _CONSUMER,
    "sinks", "paths", *_FLOW,
)
def answer_consumer_context(p):
    return A.consumer_context(p.entrypoints, "ep:16", p.paths, p.sinks, _steps(p))


@query(
    _CONSUMER.replace("ep:16", "ep:7"),
    "sinks", "paths", *_FLOW,
)
def answer_consumer_of_messages(p):
    """A message consumer's producers."""
    return A.consumer_context(p.entrypoints, "ep:7", p.paths, p.sinks, _steps(p))


@query(
    _answer(
        _VISITS.lstrip("+ ") + _STEPS + ", " + _TX + ", " + _EP + ", flow AS (SELECT * FROM steps1 WHERE entrypoint_id IN (SELECT id FROM target)), pol AS (SELECT DISTINCT q.* FROM policies q JOIN flow f ON contains(q.component_id, f.component_id) AND contains(q.method, f.method))",
        {
            "policies": "SELECT component_id || '#' || method AS item, policy AS detail FROM pol",
            "scopeTransitions": "SELECT component_id AS item, method AS detail FROM flow",
            "governedCalls": "SELECT k.to_id || '#' || k.to_method AS item, NULL AS detail FROM pol JOIN calls k ON k.from_id = pol.component_id AND k.from_method = pol.method WHERE k.to_id IN (SELECT id FROM components WHERE type = 'REPOSITORY')",
            "caveats": "SELECT limitations AS item, NULL AS detail FROM pol WHERE limitations <> ''",
        },
        [_CODES, _absent("runtime-flow-not-resolved", "SELECT 1 FROM flow"), _absent("no-effective-transaction-policy-resolved", "SELECT 1 FROM pol")],
    ),
    *_FLOW, "method_facts",
)
def answer_transaction_context(p):
    return A.transaction_context(p.entrypoints, "ep:16", _steps(p), _policies(p), p.calls, p.components)


@query(
    _answer(
        _VISITS.lstrip("+ ") + _STEPS + ", " + _subject("entrypoints", "ep:8", "entrypoint") + _OWN + ", st AS (SELECT label, dst || '#' || detail AS f FROM model_edges WHERE label IN ('READS_STATE', 'WRITES_STATE') AND src IN (SELECT component_id FROM flow))",
        {
            "triggerEvidence": "SELECT trigger_kind AS item, NULL AS detail FROM entrypoints WHERE trigger_kind IS NOT NULL AND id IN (SELECT id FROM target)",
            "runtimeCalls": "SELECT component_id AS item, method AS detail FROM flow",
            "stateReads": "SELECT f AS item, NULL AS detail FROM st WHERE label = 'READS_STATE'",
            "stateWrites": "SELECT f AS item, NULL AS detail FROM st WHERE label = 'WRITES_STATE'",
            "messagingAndExternalSinks": "SELECT id AS item, kind AS detail FROM mine WHERE kind <> 'PERSISTENCE'",
        },
        [_CODES, "SELECT 'unresolved' AS section, 'trigger-schedule-not-modeled' AS item FROM entrypoints WHERE trigger_kind IS NULL AND id IN (SELECT id FROM target)", _absent("runtime-flow-not-resolved", "SELECT 1 FROM flow")],
    ),
    *_FLOW, "paths", "sinks", "model_edges",
)
def answer_scheduled_workflow(p):
    return A.scheduled_workflow(p.entrypoints, "ep:8", _steps(p), p.model_edges, p.paths, p.sinks)


# ---- external systems, configuration, state, messaging, persistence, relationship


@query(
    _answer(
        _subject("(SELECT * FROM model_nodes WHERE label = 'ExternalSystem') x", "ext:rest:svc3", "external-system")
        + ", clients AS (SELECT DISTINCT src AS id FROM model_edges WHERE label = 'DEPENDS_ON' AND dst IN (SELECT id FROM target)), back AS (SELECT DISTINCT dst AS a, src AS b FROM model_edges), wk(start, id, hop) AS (SELECT id, id, 0 FROM clients UNION SELECT start, b, hop + 1 FROM wk JOIN back ON a = wk.id WHERE hop < 4), hit AS (SELECT DISTINCT n.id, label FROM wk JOIN model_nodes n ON n.id = wk.id WHERE start <> wk.id), cfg AS (SELECT dst FROM model_edges WHERE label = 'CONFIGURED_BY' AND src IN (SELECT id FROM target) ORDER BY ord LIMIT 1)",
        {"configuredDestination": "SELECT dst AS item, NULL AS detail FROM cfg", "callers": "SELECT id AS item, NULL AS detail FROM hit WHERE label = 'Entrypoint'", "replacementImpact": "SELECT id AS item, label AS detail FROM hit WHERE label <> 'Entrypoint'"},
        [_CODES, _absent("base-url-not-modeled", "SELECT 1 FROM cfg"), _absent("no-caller-resolved", "SELECT 1 FROM hit WHERE label = 'Entrypoint'"), "SELECT 'unresolved' AS section, 'data-sent-received-not-modeled' AS item FROM target"],
    ),
    *_MODEL,
)
def answer_external_integration(p):
    return A.external_integration(p.model_nodes, p.model_edges, "ext:rest:svc3")


@query(
    _answer(
        "hit AS (SELECT *, 'config:' || app_id || ':' || key AS id FROM config WHERE contains(lower(key), 'service.url.3') AND NOT regexp_matches(lower(key), 'password|secret|token|credential|private[-_.]?key|api[-_.]?key')), declared AS (SELECT DISTINCT id FROM hit), use AS (SELECT DISTINCT src FROM model_edges WHERE label = 'CONFIGURED_BY' AND dst IN (SELECT id FROM declared) AND src IN (SELECT id FROM model_nodes))",
        {"declarations": "SELECT id AS item, NULL AS detail FROM declared", "usages": "SELECT src AS item, NULL AS detail FROM use"},
        ["SELECT 'ambiguous' AS section, 'config-key-declared-in-' || count(*)::VARCHAR || '-modules:service.url.3' AS item FROM declared HAVING count(*) > 1", _absent("config-key-not-declared:service.url.3", "SELECT 1 FROM declared"), "SELECT 'unresolved' AS section, 'unexpanded-placeholder:' || key AS item FROM hit WHERE regexp_matches(value, '\\$\\{[^}]+\\}')", _absent("no-usages-found:service.url.3", "SELECT 1 FROM use")],
    ),
    "config", *_MODEL,
)
def answer_configuration_context(p):
    return A.configuration_context(p.config, p.model_nodes, p.model_edges, "service.url.3")


@query(
    _answer(
        "a AS (SELECT * FROM accesses WHERE contains(field, 'field42')), ho AS (SELECT DISTINCT w.component_id AS writer, r.component_id AS reader, w.owner_id, w.field FROM a w JOIN a r ON w.owner_id = r.owner_id AND w.field = r.field WHERE w.kind = 'WRITE' AND r.kind = 'READ' AND w.component_id <> r.component_id)",
        {"writers": "SELECT component_id AS item, NULL AS detail FROM a WHERE kind = 'WRITE'", "readers": "SELECT component_id AS item, NULL AS detail FROM a WHERE kind = 'READ'", "handoffs": "SELECT writer || '>' || reader AS item, owner_id || '#' || field AS detail FROM ho"},
        [_absent("no-writer-resolved-for-field:Field42", "SELECT 1 FROM a WHERE kind = 'WRITE'"), _absent("no-reader-resolved-for-field:Field42", "SELECT 1 FROM a WHERE kind = 'READ'")],
    ),
    "accesses",
)
def answer_state_lifecycle(p):
    return A.state_lifecycle(p.accesses, L.state_handoffs(p.accesses.where(F.contains(F.lower("field"), F.lit("field42")))), "Field42")


@query(
    _answer(
        "ee AS (SELECT * FROM entrypoints WHERE type IN ('MESSAGING_CONSUMER', 'JMS_CONSUMER') AND (contains(lower(topic), 'topic9') OR contains(lower(channel), 'topic9'))), nm AS (SELECT coalesce(arg_min(topic, ord) FILTER (WHERE topic IS NOT NULL), arg_min(channel, ord) FILTER (WHERE channel IS NOT NULL)) AS topic, arg_min(channel, ord) FILTER (WHERE channel IS NOT NULL) AS channel FROM ee), se AS (SELECT lower(coalesce(topic, channel, 'topic9')) AS s FROM nm), made AS (SELECT id FROM sinks, se WHERE kind = 'MESSAGING' AND (contains(lower(coalesce(topic, '')), s) OR contains(lower(coalesce(channel, '')), s))), br AS (SELECT arg_min(broker, ord) AS broker FROM interfaces, se WHERE broker IS NOT NULL AND contains(lower(topic), s)), down AS (SELECT s.id, kind FROM sinks s JOIN paths x ON x.id = s.path_id WHERE x.entrypoint_id IN (SELECT id FROM ee))",
        {"topic": "SELECT topic AS item, channel AS detail FROM nm WHERE topic IS NOT NULL", "broker": "SELECT broker AS item, NULL AS detail FROM br WHERE broker IS NOT NULL", "producerSinks": "SELECT id AS item, NULL AS detail FROM made", "consumers": "SELECT id AS item, NULL AS detail FROM ee", "downstreamSinks": "SELECT id AS item, kind AS detail FROM down"},
        [_absent("no-producer-resolved-for-channel", "SELECT 1 FROM made"), _absent("no-consumer-resolved-for-channel", "SELECT 1 FROM ee"), "SELECT 'unresolved' AS section, 'topic-not-resolved' AS item FROM nm WHERE topic IS NULL"],
    ),
    "entrypoints", "sinks", "interfaces", "paths",
)
def answer_messaging_flow(p):
    return A.messaging_flow(p.entrypoints, p.sinks, p.interfaces, p.paths, "topic9")


@query(
    _answer(
        _subject("entrypoints", "ep:16", "entrypoint")
        + ", ops AS (SELECT s.id, entity, operation FROM sinks s JOIN paths x ON x.id = s.path_id WHERE kind = 'PERSISTENCE' AND x.entrypoint_id IN (SELECT id FROM target)), per AS (SELECT o.entity, count(DISTINCT u.unit_id) AS n, min(u.unit_id) AS unit_id FROM ops o LEFT JOIN unit_entities u ON u.entity = o.entity GROUP BY o.entity), uu AS (SELECT per.entity, un.id AS unit_id, un.name, un.datasource, d.name IS NOT NULL AS known, d.endpoint FROM per JOIN units un ON un.id = per.unit_id LEFT JOIN datasources d ON d.name = un.datasource WHERE n = 1)",
        {"operations": "SELECT id AS item, operation AS detail FROM ops", "destinations": "SELECT concat_ws('>', entity, unit_id, datasource, endpoint) AS item, NULL AS detail FROM uu"},
        [_CODES, _absent("no-persistence-operation-matched", "SELECT 1 FROM ops"), "SELECT 'unresolved' AS section, 'persistence-unit-not-uniquely-resolved:' || entity AS item FROM per WHERE n <> 1", "SELECT 'unresolved' AS section, 'datasource-not-resolved:' || name AS item FROM uu WHERE datasource IS NULL", "SELECT 'unresolved' AS section, 'datasource-unresolved:' || datasource AS item FROM uu WHERE datasource IS NOT NULL AND NOT known", "SELECT 'unresolved' AS section, 'external-database-endpoint-not-resolved:' || name AS item FROM uu WHERE datasource IS NOT NULL AND endpoint IS NULL"],
    ),
    "entrypoints", "paths", "sinks", "units", "unit_entities", "datasources",
)
def answer_persistence_destination(p):
    return A.persistence_destination(p.entrypoints, "ep:16", None, p.paths, p.sinks, p.units, p.unit_entities, p.datasources)


@query(
    _answer(
        "start AS (SELECT id, 0 AS hop FROM model_nodes WHERE id = 'ep:16'), both_ways AS (SELECT src AS a, dst AS b FROM model_edges UNION SELECT dst, src FROM model_edges), " + _walks("SELECT a, b FROM both_ways", 2) + ", near AS (SELECT DISTINCT n.id, label FROM w JOIN model_nodes n ON n.id = w.id WHERE hop > 0), one AS (SELECT [src, dst] AS ids, [label] AS ls, dst FROM model_edges WHERE src = 'ep:16' AND src <> dst), ways AS (SELECT ids, ls FROM one WHERE dst = 'comp:99' UNION ALL SELECT list_append(ids, e.dst), list_append(ls, e.label) FROM one JOIN model_edges e ON e.src = one.dst WHERE one.dst <> 'comp:99' AND e.dst = 'comp:99' AND NOT list_contains(ids, e.dst))",
        {"neighborhood": "SELECT id AS item, label AS detail FROM near", "paths": "SELECT array_to_string(ids, '>') AS item, array_to_string(ls, '>') AS detail FROM ways"},
        [_absent("no-neighborhood-found", "SELECT 1 FROM near")],
    ),
    *_MODEL,
)
def answer_relationship(p):
    return A.relationship(p.model, p.model, "ep:16", "comp:99")


# ---- knowledge bundles


def _destinations(p):
    """Every message destination's answer: who sends there and who listens."""
    made = p.sinks.where("kind = 'MESSAGING'").select(F.coalesce("topic", "channel").alias("subject"), F.lit("producers").alias("section"), F.col("id").alias("item"), F.col("broker").alias("detail"))
    used = p.entrypoints.where("type = 'MESSAGING_CONSUMER'").select(F.coalesce("topic", "channel").alias("subject"), F.lit("consumers").alias("section"), F.col("id").alias("item"), F.col("broker").alias("detail"))
    rows = made.unionByName(used)
    status = rows.groupBy("subject").agg(F.count_distinct("section").alias("n")).select("subject", F.lit("status").alias("section"), F.when(F.col("n") == 2, "resolved").otherwise("partial").alias("item"), F.lit(None).cast("string").alias("detail"))
    return rows.unionByName(status).select(F.lit("messaging_flow").alias("family"), F.concat(F.lit('{"channel":"'), "subject", F.lit('"}')).alias("request"), "subject", "section", "item", "detail")


@query(
    f"""+ r AS (SELECT coalesce(topic, channel) AS subject, 'producers' AS section, '- `' || id || '`' || coalesce(' ' || broker, '') AS line FROM sinks WHERE kind = 'MESSAGING' UNION ALL SELECT coalesce(topic, channel), 'consumers', '- `' || id || '`' || coalesce(' ' || broker, '') FROM entrypoints WHERE type = 'MESSAGING_CONSUMER'),
k AS (SELECT *, row_number() OVER (PARTITION BY subject, section ORDER BY line) AS k, count(*) OVER (PARTITION BY subject, section) AS n FROM r),
t AS (SELECT subject, section, max(n) AS n, '## ' || section || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY line) || CASE WHEN max(n) > {B.SHOWN} THEN chr(10) || '- and ' || (max(n) - {B.SHOWN})::BIGINT::VARCHAR || ' more' ELSE '' END || chr(10) AS text FROM k WHERE k <= {B.SHOWN} GROUP BY subject, section),
c AS (SELECT subject, sha256('{{"family":"messaging_flow","request":{{"channel":"' || subject || '"}}}}') AS key, CASE WHEN count(*) = 2 THEN 'resolved' ELSE 'partial' END AS status, sum(n)::BIGINT AS n, string_agg(text, chr(10) ORDER BY section) AS body FROM t GROUP BY subject)
SELECT 'investigations/messaging-flow/' || subject || '-' || substr(key, 1, 12) || '.md' AS path, key, 'Messaging Flow of ' || subject AS title, status || ', ' || n::VARCHAR || ' findings' AS description,
  sha256('---' || chr(10) || 'type: architecture-investigation' || chr(10) || 'generated: true' || chr(10) || 'semantic_key: ' || key || chr(10) || 'family: messaging_flow' || chr(10) || 'status: ' || status || chr(10) || '---' || chr(10) || chr(10) || '# Messaging Flow of ' || subject || chr(10) || chr(10) || body) AS markdown_sha256, 'created' AS status FROM c""",
    "sinks", "entrypoints",
)
def okf_bundle(p):
    """The answers about every message destination as a bundle of concepts, written and read back."""
    import uuid

    root = f"{shared_folder(p.spark)}/weftgraph/okf/{uuid.uuid4().hex}"
    told = B.write_bundle(B.concepts(_destinations(p)), root, "2024-01-01")
    made = B.read_bundle(p.spark, root)[0]
    return made.join(told, "path").select("path", "key", "title", "description", F.sha2("markdown", 256).alias("markdown_sha256"), "status")
