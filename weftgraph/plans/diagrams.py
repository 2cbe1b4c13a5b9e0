"""Diagrams as lines, each with its SQL."""

from __future__ import annotations

from weftgraph.operators import chains as C
from weftgraph.operators import diagrams as D
from weftgraph.operators import rollup as R
from weftgraph.plans.answers import _STEPS, _steps
from weftgraph.plans.flows import _VISITS, _visits
from weftgraph.operators import flow as W
from weftgraph.plans.registry import _CHAINS, _chain_parts, query

_SAFE = "regexp_replace(%s, '[^A-Za-z0-9_]', '_', 'g')"
_SHAPE = "CASE type WHEN 'REPOSITORY' THEN '[(' || name || ')]' WHEN 'HTTP_CLIENT' THEN '[/' || name || '/]' WHEN 'MESSAGE_DRIVEN_BEAN' THEN '([' || name || '])' WHEN 'SCHEDULER' THEN '([' || name || '])' WHEN 'CDI_EVENT_CONSUMER' THEN '((' || name || '))' WHEN 'CDI_EVENT_PRODUCER' THEN '((' || name || '))' ELSE '[' || name || ']' END"
_ORDERED = _STEPS + ", ordered AS (SELECT e AS entrypoint_id, row_number() OVER (PARTITION BY e ORDER BY trail) - 1 AS position, c AS component_id, via FROM (SELECT *, row_number() OVER (PARTITION BY e, c ORDER BY trail) AS r FROM seen) q WHERE r = 1)"


@query(
    _VISITS
    + _ORDERED
    + f""", s AS (SELECT o.*, name, type FROM ordered o JOIN components c ON c.id = o.component_id WHERE entrypoint_id = 'ep:16'), ed AS (SELECT DISTINCT source AS from_id, c AS to_id, via FROM seen WHERE source IS NOT NULL AND e = 'ep:16' AND source <> c)
SELECT 0 AS part, 'flowchart TD' AS line UNION ALL SELECT 1, '    Client([Client])' UNION ALL SELECT 2, '    p' || position || {_SHAPE} FROM s UNION ALL SELECT 3, '    Client -->|' || via || '| p0' FROM s WHERE position = 0
UNION ALL SELECT 4, '    p' || a.position || ' -->|' || ed.via || '| p' || b.position FROM ed JOIN s a ON a.component_id = from_id JOIN s b ON b.component_id = to_id""",
    "entrypoints",
    "components",
    "calls",
)
def call_flow_diagram(p):
    v = _visits(p)
    return D.call_flow(W.flow_steps(v), W.flow_edges(v), p.components, "ep:16").select("part", "line")


@query(
    _VISITS
    + _ORDERED
    + """, s AS (SELECT o.*, c.name, e.http_method || ' ' || e.path AS section FROM ordered o JOIN entrypoints e ON e.id = o.entrypoint_id JOIN components c ON c.id = o.component_id)
SELECT section, entrypoint_id, position, '    ' || rpad(name || ' via ' || via, 36, ' ') || ':' || CASE WHEN position = 0 THEN 'active, ' ELSE '' END || position || ', 1' AS line FROM s WHERE position < 3
UNION ALL SELECT section, entrypoint_id, 3, '    ... (' || (count(*) - 3) || ' more steps) :crit, 3, 1' FROM s GROUP BY section, entrypoint_id HAVING count(*) > 3""",
    "entrypoints",
    "components",
    "calls",
)
def use_case_timeline(p):
    return D.timeline(_steps(p), p.entrypoints, p.components, 3)


@query(_CHAINS + f", seg AS (SELECT array_to_string(ids, '>') AS chain, i - 1 AS k, ids[i] AS a, ids[i + 1] AS b FROM (SELECT ids, unnest(range(1, len(ids) + 1)) AS i FROM chains)) SELECT DISTINCT chain, 0 AS part, 'flowchart LR' AS line FROM seg UNION ALL SELECT chain, 1, '    ' || {_SAFE % 'a'} || '[' || a || ']' FROM seg UNION ALL SELECT chain, 2, '    ' || {_SAFE % 'a'} || ' --> ' || {_SAFE % 'b'} FROM seg WHERE b IS NOT NULL", "paths")
def pipeline_diagrams(p):
    return D.pipelines(C.segments(C.chains(*_chain_parts(p)))).select("chain", "part", "line")


@query(
    f"""+ g AS (SELECT id, array_to_string(string_split(package, '.')[1:3], '.') AS g FROM components), k AS (SELECT a.g AS f, b.g AS t, kind, count(*) AS n FROM dependencies JOIN g a ON a.id = from_id JOIN g b ON b.id = to_id GROUP BY ALL), m AS (SELECT f, t, sum(n)::BIGINT AS n, string_agg(kind || '=' || n::VARCHAR, ',' ORDER BY kind) AS by_kind FROM k GROUP BY f, t)
SELECT 0 AS part, 'flowchart LR' AS line UNION ALL SELECT 1, '    ' || {_SAFE % 'x.g'} || '[' || x.g || coalesce((SELECT ' internal ' || n FROM m WHERE f = x.g AND t = x.g), '') || ']' FROM (SELECT f AS g FROM m UNION SELECT t FROM m) x UNION ALL SELECT 2, '    ' || {_SAFE % 'f'} || ' -->|' || by_kind || '| ' || {_SAFE % 't'} FROM m WHERE f <> t""",
    "components",
    "dependencies",
)
def dependency_map_diagram(p):
    return D.package_map(R.dependency_map(p.components, p.dependency_edges)).select("part", "line")
