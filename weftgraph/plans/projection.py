"""A labelled property graph and a software model projected from the star-schema tables.

The statements are plain SQL that Spark and DuckDB both run, so a query and its oracle start from the
same rows.  `ord`, the insertion order that limits and first-wins rules follow, is computed from keys:
no global window, no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.adjacency import Adjacency, active, state_of

TEXT = ("segment", "brand", "ptype", "status", "priority")
NUMBER = ("acctbal", "retailprice", "size", "totalprice")
_RANK = 1 << 44


def _node(rank: int, key: str, prefix: str, label: str, name: str, table: str, **cols: str) -> str:
    text = ", ".join(f"{cols.get(c, 'cast(null as string)')} AS {c}" for c in TEXT)
    number = ", ".join(f"cast({cols.get(c, 'null')} as double) AS {c}" for c in NUMBER)
    return f"SELECT cast({rank * _RANK} as bigint) + {key} AS ord, '{prefix}:' || cast({key} as string) AS id, '{label}' AS label, {name} AS name, {text}, {number} FROM {table}"


NODES = " UNION ALL ".join(
    (
        _node(1, "r_regionkey", "region", "Region", "r_name", "region"),
        _node(2, "n_nationkey", "nation", "Nation", "n_name", "nation"),
        _node(3, "c_custkey", "customer", "Customer", "c_name", "customer", segment="c_mktsegment", acctbal="c_acctbal"),
        _node(4, "s_suppkey", "supplier", "Supplier", "s_name", "supplier", acctbal="s_acctbal"),
        _node(5, "p_partkey", "part", "Part", "p_name", "part", brand="p_brand", ptype="p_type", size="p_size", retailprice="p_retailprice"),
        _node(6, "o_orderkey", "order", "Order", "'order ' || cast(o_orderkey as string)", "orders", status="o_orderstatus", priority="o_orderpriority", totalprice="o_totalprice"),
        _node(7, "user_id", "user", "User", "'user ' || cast(user_id as string)", "(SELECT DISTINCT user_id FROM events) u"),
    )
)


def _edge(rank: int, key: str, src: str, dst: str, label: str, table: str, quantity: str = "null", discount: str = "null") -> str:
    return f"SELECT cast({rank * _RANK} as bigint) + {key} AS ord, {src} AS src, {dst} AS dst, '{label}' AS label, cast({quantity} as double) AS quantity, cast({discount} as double) AS discount FROM {table}"


def _id(prefix: str, key: str) -> str:
    return f"'{prefix}:' || cast({key} as string)"


EDGES = " UNION ALL ".join(
    (
        _edge(1, "n_nationkey", _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "IN_REGION", "nation"),
        _edge(2, "c_custkey", _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "IN_NATION", "customer"),
        _edge(3, "s_suppkey", _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "IN_NATION", "supplier"),
        _edge(4, "o_orderkey", _id("customer", "o_custkey"), _id("order", "o_orderkey"), "PLACED", "orders"),
        _edge(5, "(l_orderkey * 16 + l_linenumber)", _id("order", "l_orderkey"), _id("part", "l_partkey"), "HAS_ITEM", "lineitem", "l_quantity", "l_discount"),
        _edge(6, "(l_orderkey * 16 + l_linenumber)", _id("part", "l_partkey"), _id("supplier", "l_suppkey"), "SUPPLIED_BY", "lineitem", "l_quantity"),
    )
)

TYPES = ("REST_RESOURCE", "SERVICE", "REPOSITORY", "ENTITY", "EJB_STATELESS", "MESSAGE_DRIVEN_BEAN", "SCHEDULER", "HTTP_CLIENT", "CDI_EVENT_CONSUMER", "CDI_EVENT_PRODUCER", "REMOTE_SERVICE", "UTILITY", "UNKNOWN")
WORDS = ("OrderService", "PriceFormatter", "StockMapper", "UserConfig", "TenantResolver", "PaymentGateway", "RequestDto", "LockRegistry", "FlywayInitializer", "InputValidator", "Application")
LAYERS = ("service", "util", "redis", "config", "security.config", "web", "mapper", "infrastructure", "multitenant", "validation")


def _pick(values: tuple[str, ...], key: str) -> str:
    return "CASE " + f"({key}) % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


COMPONENTS = f"""
SELECT s_suppkey AS ord, 'comp:' || cast(s_suppkey as string) AS id, name || cast(s_suppkey as string) AS name, type,
  package || '.' || name || cast(s_suppkey as string) AS qualified_name, package, module, 'app:' || cast(s_nationkey as string) AS app_id, technology, confidence, {_pick(("messaging", "object-storage", "file-outbound", "web", "plain"), "s_suppkey")} AS stereotype
FROM (SELECT s_suppkey, s_nationkey, {_pick(WORDS, "s_suppkey")} AS name, {_pick(TYPES, "s_suppkey")} AS type, 'com.acme.' || lower(n_name) || '.' || {_pick(LAYERS, "s_suppkey + s_nationkey")} AS package,
    lower(n_name) AS module, lower(r_name) AS technology, abs(s_acctbal) / 10000 AS confidence
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) s"""

EP_TYPES = ("REST_ENDPOINT", "MESSAGING_CONSUMER", "SCHEDULER", "CDI_EVENT_OBSERVER", "EVENT_BUS_CONSUMER", "GRPC_METHOD")
ENTRYPOINTS = f"""
SELECT c_custkey AS ord, 'ep:' || cast(c_custkey as string) AS id, {_pick(EP_TYPES, "c_custkey")} AS type, {_pick(("GET", "POST", "PUT", "DELETE"), "c_custkey")} AS http_method,
  '/' || lower(c_mktsegment) || '/' || {_pick(("list", "{id}", "shutdown", "items"), "c_custkey")} || '/' || cast(c_custkey as string) AS path,
  CASE WHEN c_custkey % 3 = 0 THEN 'onShutdown' ELSE 'handle' END || cast(c_custkey as string) AS name,
  'comp:' || cast((c_custkey * 7) % n as string) AS component_id, 'channel' || cast(c_nationkey as string) AS channel,
  CASE WHEN c_custkey % 2 = 0 THEN 'topic' || cast(c_nationkey as string) END AS topic, CASE WHEN c_custkey % 4 = 0 THEN 'KAFKA' WHEN c_custkey % 4 = 2 THEN 'JMS' END AS broker,
  'm' || cast(c_custkey % 12 as string) AS method, CASE WHEN c_custkey % 6 = 2 THEN CASE WHEN c_custkey % 4 = 0 THEN 'cron' ELSE 'fixed-rate' END END AS trigger_kind
FROM customer CROSS JOIN (SELECT count(*) AS n FROM supplier) k"""

DEPENDENCIES = """
SELECT p_partkey AS ord, 'comp:' || cast((p_partkey * 3) % n as string) AS from_id, 'comp:' || cast((p_partkey * p_size + p_partkey) % n as string) AS to_id, p_type AS kind, p_retailprice / 2500 AS confidence
FROM part CROSS JOIN (SELECT count(*) AS n FROM supplier) k"""

ACCESSES = """
SELECT event_id AS ord, 'comp:' || cast(user_id % n as string) AS component_id, event_type AS method, CASE WHEN event_type IN ('purchase', 'signup') THEN 'WRITE' ELSE 'READ' END AS kind,
  'comp:' || cast(f % n as string) AS owner_id, 'field' || cast(f as string) AS field
FROM (SELECT event_id, user_id, event_type, cast(regexp_extract(props, '"k": *([0-9]+)', 1) as bigint) AS f FROM events) e CROSS JOIN (SELECT count(*) AS n FROM supplier) k"""

PATHS = "SELECT o_orderkey AS ord, 'path:' || cast(o_orderkey as string) AS id, 'ep:' || cast(o_custkey as string) AS entrypoint_id, lower(o_orderpriority) AS param FROM orders"

SINKS = """
SELECT l_orderkey * 16 + l_linenumber AS ord, 'path:' || cast(l_orderkey as string) || ':sink:' || cast(l_linenumber as string) AS id, 'path:' || cast(l_orderkey as string) AS path_id, l_linenumber AS sink_index,
  CASE WHEN l_returnflag = 'R' THEN 'STORE' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'MESSAGING' WHEN l_returnflag = 'A' THEN 'EVENT_BUS' ELSE 'PERSISTENCE' END AS kind,
  'comp:' || cast(l_suppkey as string) AS component_id, 'comp:' || cast(l_partkey % n as string) AS owner_id, 'field' || cast(l_partkey as string) AS field,
  CASE WHEN l_quantity % 2 = 0 THEN 'topic' || cast(l_suppkey % 25 as string) END AS topic, 'channel' || cast(l_suppkey % 25 as string) AS channel,
  CASE WHEN l_quantity % 3 = 0 THEN 'KAFKA' WHEN l_quantity % 3 = 1 THEN 'JMS' END AS broker, 'Entity' || cast(l_partkey as string) AS entity,
  CASE WHEN l_linestatus = 'O' THEN 'save' ELSE 'findById' END AS operation, CASE WHEN l_tax > 0.06 THEN 'flow+call-graph-reach' ELSE 'flow' END AS evidence
FROM lineitem CROSS JOIN (SELECT count(*) AS n FROM supplier) k"""

STEPS = """
SELECT 'flow:' || cast(user_id as string) AS flow_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, 'comp:' || cast(event_id % n as string) AS component_id,
  CASE event_type WHEN 'signup' THEN 'REQUIRED' WHEN 'purchase' THEN 'REQUIRES_NEW' WHEN 'view' THEN 'SUPPORTS' WHEN 'click' THEN 'NOT_SUPPORTED' END AS policy, event_type AS method
FROM events CROSS JOIN (SELECT count(*) AS n FROM supplier) k"""

_N = "CROSS JOIN (SELECT count(*) AS n FROM supplier) k"

#: Method-level call edges: how the call is made, what it maps, kills and substitutes, and its place in the control flow.
CALLS = f"""
SELECT p_partkey AS ord, 'comp:' || cast((p_partkey * 3) % n as string) AS from_id, 'm' || cast(cast(floor(p_partkey / n) as bigint) % 12 as string) AS from_method,
  'comp:' || cast((p_partkey * p_size + p_partkey) % n as string) AS to_id, 'm' || cast((p_size + p_partkey) % 20 as string) AS to_method,
  CASE p_partkey % 11 WHEN 3 THEN 'messaging' WHEN 7 THEN 'event-bus' ELSE 'direct' END AS call_kind, p_partkey % 13 = 5 AS capped, p_partkey % 17 = 4 AS ambiguous,
  CASE p_partkey % 5 WHEN 0 THEN 'order' WHEN 1 THEN 'price' END AS arg, CASE p_partkey % 5 WHEN 0 THEN 'item' WHEN 1 THEN 'order' END AS param,
  CASE WHEN p_partkey % 7 = 2 THEN 'order' END AS killed, CASE p_partkey % 4 WHEN 1 THEN 'order' WHEN 3 THEN 'client' END AS receiver,
  CASE WHEN p_partkey % 3 = 0 THEN 'topic' || cast(p_partkey % 25 as string) END AS literal, CASE WHEN p_partkey % 3 = 0 THEN 'orders.' || cast(p_partkey % 6 as string) END AS literal_value,
  {_pick(("IF_THEN", "IF_ELSE", "SWITCH_CASE", "SWITCH_DEFAULT", "TERNARY_THEN", "TERNARY_ELSE", "CATCH", "FINALLY", "UNCONDITIONAL"), "p_size")} AS control,
  CASE WHEN p_size % 9 < 8 THEN 'branch:' || cast(cast(floor(p_partkey / 2) as bigint) as string) END AS branch_group, CASE WHEN p_partkey % 10 = 1 THEN 'own label' END AS branch_label
FROM part {_N}"""

TRACKED = """
SELECT c_custkey * 4 AS ord, 'ep:' || cast(c_custkey as string) AS entrypoint_id, CASE WHEN c_custkey % 2 = 0 THEN 'order' WHEN c_custkey % 3 = 0 THEN 'price' ELSE '*' END AS name FROM customer
UNION ALL SELECT c_custkey * 4 + 1, 'ep:' || cast(c_custkey as string), 'price' FROM customer WHERE c_custkey % 6 = 0"""

FIELD_ACCESS = f"""
SELECT p_partkey AS ord, 'comp:' || cast((p_partkey * 7) % n as string) AS component_id, 'm' || cast(p_partkey % 20 as string) AS method, CASE WHEN p_size % 3 = 0 THEN 'READ' ELSE 'WRITE' END AS kind,
  'comp:' || cast((p_partkey * 7 + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END) % n as string) AS owner_id, 'field' || cast(p_size as string) AS field,
  CASE p_partkey % 6 WHEN 0 THEN 'order' WHEN 1 THEN 'price' WHEN 2 THEN 'item' WHEN 3 THEN 'other' END AS source_var, CASE p_partkey % 8 WHEN 5 THEN 'order' END AS source_field, CASE p_partkey % 10 WHEN 9 THEN 'order' END AS key_var
FROM part {_N}"""

#: Call sites that leave the application; some count only for one caller.
SITES = f"""
SELECT s_suppkey AS ord, 'comp:' || cast(s_suppkey as string) AS component_id, 'm' || cast(s_suppkey % 20 as string) AS method, CASE s_suppkey % 4 WHEN 0 THEN 'HTTP_OUTBOUND' ELSE 'MESSAGING' END AS kind,
  CASE WHEN s_suppkey % 3 <> 1 THEN 'topic' || cast(s_suppkey % 25 as string) END AS topic, 'channel' || cast(s_suppkey % 25 as string) AS channel, CASE s_suppkey % 2 WHEN 0 THEN 'KAFKA' END AS broker,
  CASE WHEN s_suppkey % 5 = 2 THEN 'comp:' || cast((s_suppkey * 3) % n as string) END AS only_component, CASE WHEN s_suppkey % 10 = 2 THEN 'm' || cast(s_suppkey % 12 as string) END AS only_method
FROM supplier {_N}"""

APPS = f"""
SELECT n_nationkey AS ord, 'app:' || cast(n_nationkey as string) AS id, lower(n_name) AS name, CASE WHEN n_nationkey >= 5 THEN 'app:' || cast(n_nationkey % 5 as string) END AS parent_id,
  lower(r_name) AS technology, {_pick(("jar", "war", "pom"), "n_nationkey")} AS packaging FROM nation JOIN region ON n_regionkey = r_regionkey"""

INTERFACES = f"""
SELECT s_suppkey AS ord, 'if:' || cast(s_suppkey as string) AS id, 'comp:' || cast(s_suppkey as string) AS component_id, {_pick(("rest_client", "messaging_producer", "messaging_consumer", "rest"), "s_suppkey")} AS type,
  CASE WHEN s_suppkey % 4 = 0 THEN 'svc' || cast(s_suppkey % 7 as string) END AS service, CASE WHEN s_suppkey % 8 = 0 THEN 'service.url.' || cast(s_suppkey % 7 as string) END AS config_key,
  CASE s_suppkey % 3 WHEN 0 THEN 'KAFKA' WHEN 1 THEN 'IN_MEMORY' END AS broker, 'topic' || cast(s_suppkey % 25 as string) AS topic FROM supplier"""

CONFIG = f"""
SELECT c_custkey AS ord, 'app:' || cast(c_nationkey as string) AS app_id, CASE c_custkey % 5 WHEN 0 THEN 'db.password.' || cast(c_custkey as string) WHEN 1 THEN 'mp.messaging.incoming.channel' || cast(c_custkey % 25 as string) || '.connector'
    WHEN 2 THEN 'mp.messaging.outgoing.channel' || cast(c_custkey % 24 as string) || '.topic' WHEN 3 THEN 'service.url.' || cast(c_custkey % 7 as string) ELSE 'feature.x' || cast(c_custkey % 40 as string) END AS key,
  CASE c_custkey % 5 WHEN 1 THEN {_pick(("smallrye-kafka", " Smallrye-AMQP", "smallrye-mqtt", "smallrye-rabbitmq", "smallrye-pulsar", "other"), "c_custkey")} WHEN 2 THEN 'topic' || cast(c_custkey % 25 as string)
    WHEN 3 THEN CASE WHEN c_custkey % 2 = 0 THEN '$' || '{{host}}/x' ELSE 'http://x/' || cast(c_custkey as string) END ELSE 'v' || cast(c_custkey as string) END AS value FROM customer"""

UNITS = """
SELECT n_nationkey AS ord, 'unit:' || cast(n_nationkey as string) AS id, 'pu' || cast(n_nationkey % 4 as string) AS name, 'app:' || cast(n_nationkey % 20 as string) AS app_id,
  CASE WHEN n_nationkey % 6 <> 5 THEN 'ds' || cast(n_nationkey % 7 as string) END AS datasource FROM nation"""

UNIT_ENTITIES = "SELECT p_partkey AS ord, 'unit:' || cast(p_partkey % 25 as string) AS unit_id, 'Entity' || cast(p_partkey - p_partkey % 3 as string) AS entity FROM part"

DATASOURCES = "SELECT r_regionkey AS ord, 'ds' || cast(r_regionkey as string) AS name, 'java:/ds' || cast(r_regionkey as string) AS jndi, CASE WHEN r_regionkey <> 3 THEN 'db' || cast(r_regionkey % 3 as string) END AS endpoint FROM region"

#: What the sources say about transactions, by method.
METHOD_FACTS = f"""
SELECT p_partkey AS ord, 'comp:' || cast((p_partkey * 3) % n as string) AS component_id, 'm' || cast(cast(floor(p_partkey / n) as bigint) % 12 as string) AS method,
  CASE p_partkey % 6 WHEN 0 THEN 'TxType.REQUIRED' WHEN 1 THEN '"REQUIRESNEW"' WHEN 2 THEN 'DEFAULT' END AS on_method, CASE ((p_partkey * 3) % n) % 5 WHEN 0 THEN 'SUPPORTS' END AS on_type, CASE ((p_partkey * 3) % n) % 7 WHEN 0 THEN 'MANDATORY' END AS inherited,
  ((p_partkey * 3) % n) % 13 = 4 AS bean_managed, p_partkey % 9 = 2 AS programmatic, CASE p_partkey % 2 WHEN 0 THEN 'spring' ELSE 'jakarta' END AS framework
FROM part {_N}"""

#: Types and what they extend or implement: a tree.
TYPES_FACTS = "SELECT s_suppkey AS ord, 'type:' || cast(s_suppkey as string) AS id, CASE WHEN s_suppkey > 0 THEN 'type:' || cast(cast(floor((s_suppkey - 1) / 3) as bigint) as string) END AS extends, s_suppkey % 4 <> 3 AS concrete FROM supplier"

#: Facts about source code.  Lists are joined by commas.
CODE_TYPES = """
SELECT 'type:' || cast(s_suppkey as string) AS id, CASE WHEN s_suppkey % 9 <> 8 THEN 'comp:' || cast(s_suppkey as string) END AS component_id, s_suppkey % 4 = 3 AS abstract FROM supplier
UNION ALL SELECT 'type:wide', 'comp:wide', true UNION ALL SELECT 'type:open', NULL, true UNION ALL SELECT 'type:lone', 'comp:lone', true"""

CODE_SUPERTYPES = f"""
SELECT 'type:' || cast(s_suppkey as string) AS type, 'type:' || cast(cast(floor((s_suppkey - 1) / 3) as bigint) as string) AS supertype, true AS is_class FROM supplier WHERE s_suppkey > 3
UNION ALL SELECT 'type:' || cast(s_suppkey as string), 'type:' || cast((s_suppkey * 5 + 2) % n as string), false FROM supplier {_N} WHERE s_suppkey % 6 = 0
UNION ALL SELECT 'type:' || cast(s_suppkey as string), 'type:wide', false FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'type:' || cast(s_suppkey as string), 'type:open', false FROM supplier WHERE s_suppkey = 5"""

CODE_FIELDS = f"""
SELECT p_partkey AS ord, 'type:' || cast((p_partkey * 3) % n as string) AS owner, 'f' || cast(cast(floor(p_partkey / n) as bigint) % 8 as string) AS name, 'Type' || cast(p_partkey % 30 as string) || {_pick(("", "Cache", "Store", "Log"), "p_partkey")} AS type_name,
  CASE p_partkey % 10 WHEN 9 THEN NULL WHEN 8 THEN 'type:wide' WHEN 7 THEN 'type:open' WHEN 6 THEN 'type:lone' WHEN 5 THEN 'lib:Map' ELSE 'type:' || cast((p_partkey * p_size + p_partkey) % n as string) END AS declared,
  CASE WHEN p_partkey % 6 = 0 THEN 'type:' || cast((p_partkey + 1) % n as string) END AS allocated,
  CASE WHEN p_partkey % 5 = 4 THEN 'type:' || cast(p_partkey % n as string) || ',type:' || cast((p_partkey + 2) % n as string) END AS elements,
  CASE WHEN p_partkey % 10 IN (5, 9) THEN 'type:' || cast((p_partkey + 3) % n as string) END AS injected FROM part {_N}"""

CODE_LOCALS = f"""
SELECT c_custkey AS ord, 'type:' || cast((c_custkey * 7) % n as string) AS owner, 'm' || cast(c_custkey % 6 as string) AS method, 'v' || cast(c_custkey % 5 as string) AS name,
  CASE WHEN c_custkey % 3 = 0 THEN 'type:' || cast((c_custkey * 3 + 1) % n as string) END AS allocated,
  CASE WHEN c_custkey % 9 = 1 THEN 'type:' || cast(c_custkey % n as string) || ',type:' || cast((c_custkey + 5) % n as string) END AS elements,
  CASE WHEN c_custkey % 9 = 2 THEN 'v' || cast((c_custkey + 1) % 5 as string) WHEN c_custkey % 9 = 4 THEN 'f' || cast(c_custkey % 8 as string) END AS iterates FROM customer {_N}"""

CODE_METHODS = f"""
SELECT 'type:' || cast(p_partkey % n as string) AS owner, CASE p_partkey % 6 WHEN 0 THEN 'acc' || cast(p_partkey % 40 as string) WHEN 1 THEN 'get' ELSE 'm' || cast(p_partkey % 12 as string) END AS name FROM part {_N}"""

CODE_CALLS = f"""
SELECT o_orderkey AS ord, 'type:' || cast(o_custkey % n as string) AS owner, 'm' || cast(o_orderkey % 6 as string) AS method, CASE o_orderkey % 8 WHEN 1 THEN 'put' WHEN 3 THEN 'size' ELSE 'm' || cast(o_orderkey % 12 as string) END AS callee,
  CASE o_orderkey % 7 WHEN 0 THEN 'array' WHEN 1 THEN 'call' WHEN 2 THEN 'variable' WHEN 3 THEN 'field' WHEN 4 THEN 'this' WHEN 5 THEN 'call' END AS target,
  CASE o_orderkey % 7 WHEN 0 THEN 'f' || cast(o_custkey % 9 as string) WHEN 2 THEN CASE WHEN o_custkey % 2 = 0 THEN 'v' || cast(o_custkey % 5 as string) ELSE 'f' || cast(o_custkey % 8 as string) END WHEN 3 THEN 'f' || cast(o_custkey % 10 as string) END AS name,
  CASE WHEN o_orderkey % 7 IN (1, 5) THEN CASE o_custkey % 5 WHEN 0 THEN 'get' ELSE 'acc' || cast(o_custkey % 50 as string) END END AS accessor,
  CASE WHEN o_orderkey % 7 = 5 THEN CASE o_custkey % 3 WHEN 0 THEN 'lib:Map' ELSE 'type:' || cast((o_custkey * 2) % n as string) END END AS accessor_type,
  CASE WHEN o_orderkey % 7 IN (2, 3) AND o_custkey % 4 <> 1 THEN 'type:' || cast((o_custkey + 4) % n as string) END AS declared,
  CASE WHEN o_orderkey % 11 = 3 THEN 'arm:' || cast(o_custkey % 3 as string) END AS arm, CASE WHEN o_orderkey % 5 = 2 THEN 'x' || cast(o_custkey % 3 as string) END AS assigned
FROM orders {_N}"""

_M = "CROSS JOIN (SELECT count(*) AS m FROM orders) j"

#: Rules of transaction advice and of EJB descriptors, as their readers give them.
XML_ADVICE = """
SELECT 'ctx' || cast(n_nationkey % 4 as string) || '.xml' AS file, cast(n_nationkey as int) AS advisor, 'tx' || cast(n_nationkey as string) AS advice,
  CASE n_nationkey % 3 WHEN 0 THEN 'execution(* com.acme.' || lower(n_name) || '.*.m*(..))' WHEN 1 THEN 'execution(* com.acme.*.web.*Service*.m1*(..))' ELSE 'within(com.acme..*)' END AS pointcut,
  cast(r_regionkey as int) AS rule, CASE r_regionkey WHEN 0 THEN 'm*' WHEN 1 THEN '*' WHEN 2 THEN 'm1*' WHEN 3 THEN 'm10' ELSE 'find*' END AS pattern,
  CASE r_regionkey WHEN 0 THEN 'REQUIRED' WHEN 1 THEN 'NotSupported' WHEN 2 THEN 'RequiresNew' WHEN 3 THEN 'Propagation.NEVER' ELSE 'SUPPORTS' END AS propagation, r_regionkey = 2 AS read_only, CASE WHEN r_regionkey = 3 THEN 'SERIALIZABLE' END AS isolation
FROM nation CROSS JOIN region"""

XML_EJB = f"""
SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'a/ejb-jar.xml' ELSE 'z/ejb-jar.xml' END AS file, cast(s_suppkey as int) AS place, {_pick(WORDS, "s_suppkey")} || cast(s_suppkey as string) AS ejb_name,
  CASE s_suppkey % 3 WHEN 0 THEN '*' WHEN 1 THEN 'm1*' ELSE 'm5' END AS method, CASE WHEN s_suppkey % 4 = 1 THEN 'Mandatory' ELSE 'RequiresNew' END AS attribute FROM supplier WHERE s_suppkey % 5 = 3"""

#: Expressions of source code and where their values come from; outbound sites whose topic is one of them.
CODE_EXPRESSIONS = f"""
SELECT 'x:' || cast(o_orderkey as string) AS id, CASE o_orderkey % 7 WHEN 0 THEN 'literal' WHEN 1 THEN 'field' WHEN 2 THEN 'local' WHEN 3 THEN 'param' WHEN 4 THEN 'param' WHEN 5 THEN 'call' ELSE 'other' END AS kind,
  CASE WHEN o_orderkey % 7 = 0 THEN 'topic' || cast(o_custkey % 40 as string) END AS value,
  CASE WHEN o_orderkey % 7 IN (1, 2) THEN 'x:' || cast(CASE WHEN o_custkey % 5 = 0 THEN o_orderkey - o_orderkey % 7 WHEN o_custkey % 5 = 1 THEN o_orderkey + 1 ELSE cast(floor(o_orderkey / 2) as bigint) END as string) END AS init,
  'type:' || cast(o_custkey % n as string) AS owner, 'm' || cast(o_custkey % 6 as string) AS method, o_custkey % 2 AS position, o_orderkey % 7 = 4 AS message,
  CASE WHEN o_orderkey % 7 = 5 THEN 'type:' || cast(o_custkey % n as string) END AS receiver_type, 'acc' || cast((o_custkey * 6) % 40 as string) AS callee FROM orders {_N}"""

CODE_ARGUMENTS = f"""
SELECT 'call:' || cast(c_custkey as string) AS call, 'type:' || cast((c_custkey * 3) % n as string) AS owner, 'm' || cast(c_custkey % 6 as string) AS method, k.at AS position, 2 AS arity,
  'x:' || cast((c_custkey * 11 + k.at * 4) % m as string) AS expression, 'type:' || cast((c_custkey * 5 + k.at) % n as string) AS type, 'type:' || cast(c_custkey % n as string) AS caller, 'm' || cast((c_custkey + 1) % 6 as string) AS caller_method
FROM customer CROSS JOIN (SELECT 0 AS at UNION ALL SELECT 1) k {_N.replace("k", "q")} {_M}"""

CODE_HEADERS = f"""
SELECT 'type:' || cast(c_custkey % n as string) AS caller, 'm' || cast((c_custkey + 1) % 6 as string) AS caller_method, 'x:' || cast((c_custkey * 13) % m as string) AS expression FROM customer {_N} {_M} WHERE c_custkey % 4 = 0"""

CODE_RETURNS = f"""
SELECT 'type:' || cast(p_partkey % n as string) AS owner, 'acc' || cast(p_partkey % 40 as string) AS method, 'x:' || cast((p_partkey * 3) % m as string) AS expression FROM part {_N} {_M}"""

CODE_SITES = f"""
SELECT 'site:' || cast(c_custkey as string) AS id, 'type:' || cast((c_custkey * 3) % n as string) AS owner, 'm' || cast(c_custkey % 6 as string) AS method, CASE WHEN c_custkey % 8 = 0 THEN 'fixed' || cast(c_custkey % 9 as string) END AS topic,
  CASE WHEN c_custkey % 8 = 0 THEN 'LITERAL' WHEN c_custkey % 5 = 1 THEN 'PARAM_REF' WHEN c_custkey % 5 = 2 THEN 'METHOD_CALL' ELSE 'OTHER' END AS kind, CASE WHEN c_custkey % 9 <> 4 THEN 'x:' || cast((c_custkey * 7 + 3) % m as string) END AS expression,
  CASE WHEN c_custkey % 5 IN (1, 2) THEN c_custkey % 2 END AS position, CASE WHEN c_custkey % 5 = 2 THEN 'acc' || cast(c_custkey % 40 as string) END AS accessor, 2 AS arity, 'type:' || cast((c_custkey * 2) % n as string) AS param_type,
  CASE WHEN c_custkey % 3 = 0 THEN 'flow' END AS evidence FROM customer {_N} {_M}"""

#: Types as classes with names, their members and annotations; fields and signatures that make dependencies.  Lists are joined by commas.
CODE_CLASSES = f"""
SELECT 'type:' || cast(s_suppkey as string) AS id, {_pick(("Order", "OrderService", "UserRepository", "PriceDao", "StockClient", "PageRenderer", "TextUtils"), "s_suppkey")} AS name,
  'com.acme.' || {_pick(("core", "model", "util", "dto", "web"), "s_suppkey")} || '.T' || cast(s_suppkey as string) AS qualified_name, s_suppkey % 4 = 3 AS interface,
  CASE s_suppkey % 6 WHEN 0 THEN 'CommandLineRunner' WHEN 1 THEN 'BindableService' WHEN 2 THEN 'PostInsertEventListener,Serializable' WHEN 3 THEN 'Object' ELSE '' END AS parents FROM supplier"""

CODE_MEMBERS = f"""
SELECT 'type:' || cast(p_partkey % n as string) AS type, CASE j WHEN 0 THEN 'main' WHEN 1 THEN 'run' WHEN 2 THEN 'onPostInsert' WHEN 3 THEN 'onMessage' WHEN 4 THEN 'bindService' ELSE 'm' || cast(j as string) END AS name,
  CASE WHEN j % 5 = 4 AND j > 4 THEN 'field' ELSE 'method' END AS kind, p_partkey % 3 = 0 AS static, p_partkey % 2 = 0 AS public, CASE WHEN p_partkey % 11 = 0 THEN 'SseEventSink' ELSE 'void' END AS type_name,
  CASE WHEN p_partkey % 13 = 0 THEN 'String,Sse' WHEN p_partkey % 13 < 6 THEN 'String' END AS parameter_types FROM (SELECT p_partkey, n, cast(floor(p_partkey / n) as bigint) AS j FROM part {_N}) p"""

CODE_ANNOTATIONS = f"""
SELECT p_partkey AS ord, type, member, name, CASE name WHEN 'GetMapping' THEN CASE WHEN h = 0 THEN 'value' ELSE 'path' END WHEN 'PostMapping' THEN 'value' WHEN 'RequestMapping' THEN 'method' WHEN 'Scheduled' THEN CASE h WHEN 0 THEN 'cron' WHEN 1 THEN 'fixedRateString' ELSE 'every' END
    WHEN 'KafkaListener' THEN CASE WHEN h = 0 THEN 'topics' ELSE 'topicPattern' END WHEN 'RabbitListener' THEN 'queues' WHEN 'JmsListener' THEN 'destination' WHEN 'Incoming' THEN 'value' WHEN 'Outgoing' THEN 'value' END AS attribute,
  CASE name WHEN 'RequestMapping' THEN CASE h WHEN 0 THEN 'RequestMethod.PUT' ELSE 'ANY' END WHEN 'JmsListener' THEN CASE h WHEN 0 THEN ' ' ELSE 'queue' END ELSE CASE h WHEN 0 THEN '/list/' WHEN 1 THEN 'items' ELSE '//deep//' END || cast(p_partkey % 50 as string) END AS value
FROM (SELECT p_partkey, 'type:' || cast(p_partkey % n as string) AS type, CASE j WHEN 0 THEN 'main' WHEN 1 THEN 'run' WHEN 2 THEN 'onPostInsert' WHEN 3 THEN 'onMessage' WHEN 4 THEN 'bindService' ELSE 'm' || cast(j as string) END AS member, cast(floor(p_partkey / 13) as bigint) % 3 AS h,
  {_pick(("GetMapping", "PostMapping", "RequestMapping", "Scheduled", "KafkaListener", "RabbitListener", "JmsListener", "GET", "POST", "Incoming", "Outgoing", "OnMessage", "KafkaHandler"), "p_partkey")} AS name FROM (SELECT p_partkey, n, cast(floor(p_partkey / n) as bigint) AS j FROM part {_N}) p) q
UNION ALL SELECT p_partkey + {_RANK}, 'type:' || cast(p_partkey % n as string), CASE j WHEN 0 THEN 'main' WHEN 1 THEN 'run' WHEN 2 THEN 'onPostInsert' WHEN 3 THEN 'onMessage' WHEN 4 THEN 'bindService' ELSE 'm' || cast(j as string) END, CASE WHEN p_partkey % 6 = 0 THEN 'Produces' WHEN j % 5 = 4 THEN 'Channel' ELSE 'Path' END, 'value',
  CASE WHEN p_partkey % 6 = 0 THEN 'text/event-stream' ELSE 'p' || cast(p_partkey % 20 as string) END FROM (SELECT p_partkey, n, cast(floor(p_partkey / n) as bigint) AS j FROM part {_N}) p WHERE p_partkey % 3 = 0
UNION ALL SELECT s_suppkey + {2 * _RANK}, 'type:' || cast(s_suppkey as string), NULL, name, CASE name WHEN 'KafkaListener' THEN 'topics' WHEN 'Path' THEN 'value' WHEN 'ServerEndpoint' THEN 'value' END, CASE name WHEN 'KafkaListener' THEN 'all' ELSE '/base//' || cast(s_suppkey as string) END FROM (SELECT s_suppkey,
  {_pick(("Entity", "SpringBootApplication", "FeignClient", "RestController", "Service", "Repository", "Configuration", "Component", "Path", "ServerEndpoint", "GrpcService", "ApplicationScoped", "Stateless", "Singleton", "MessageDriven", "RegisterRestClient", "KafkaListener", "Other"), "s_suppkey")} AS name FROM supplier) s
UNION ALL SELECT s_suppkey + {3 * _RANK}, 'type:' || cast(s_suppkey as string), NULL, 'RequestMapping', 'value', 'api/' FROM supplier WHERE s_suppkey % 4 = 1"""

CODE_HELD = f"""
SELECT p_partkey AS ord, 'type:' || cast(p_partkey % n as string) AS owner, CASE WHEN p_partkey % 5 = 0 THEN 'api:' || cast((p_partkey * p_size) % n as string) ELSE 'type:' || cast((p_partkey * p_size + 1) % n as string) END AS type,
  CASE p_partkey % 8 WHEN 0 THEN 'Inject' WHEN 1 THEN 'Deprecated,Autowired' WHEN 2 THEN 'Deprecated' END AS annotations, p_partkey % 3 = 0 AS is_final FROM part {_N}"""

CODE_SIGNATURES = f"""SELECT p_partkey AS ord, 'type:' || cast((p_partkey * 3) % n as string) AS owner, 'type:' || cast((p_partkey + p_size) % n as string) AS type FROM part {_N} WHERE p_partkey % 2 = 0"""

CODE_APIS = f"""
SELECT 'type:' || cast(s_suppkey as string) AS type, 'api:' || cast(cast(floor(s_suppkey / 2) as bigint) as string) AS supertype, false AS is_class FROM supplier WHERE s_suppkey % 5 <> 0
UNION ALL SELECT 'type:' || cast(s_suppkey as string), 'api:' || cast(s_suppkey as string), true FROM supplier"""

_MODEL_NODE = "SELECT cast({rank} * 17592186044416 as bigint) + ord AS ord, {id} AS id, '{label}' AS label, {name} AS name FROM ({sub}) x"
_MODEL_EDGE = "SELECT cast({rank} * 17592186044416 as bigint) + ord AS ord, {src} AS src, {dst} AS dst, '{label}' AS label, {detail} AS detail FROM ({sub}) x"


def _model(template: str, *rows: tuple) -> str:
    return " UNION ALL ".join(template.format(rank=i + 1, **dict(r)) for i, r in enumerate(rows))


def _mn(label, id_, name, sub):
    return (("label", label), ("id", id_), ("name", name), ("sub", sub))


def _me(label, src, dst, detail, sub):
    return (("label", label), ("src", src), ("dst", dst), ("detail", detail), ("sub", sub))


#: The software model as one graph.
MODEL_NODES = _model(
    _MODEL_NODE,
    _mn("Application", "id", "name", APPS),
    _mn("Component", "id", "name", COMPONENTS),
    _mn("Entrypoint", "id", "name", ENTRYPOINTS),
    _mn("Interface", "id", "topic", INTERFACES),
    _mn("DataFlowPath", "id", "param", PATHS),
    _mn("DataFlowSink", "id", "kind", SINKS),
    _mn("PersistenceUnit", "id", "name", UNITS),
    _mn("DataSource", "'datasource:' || name", "name", DATASOURCES),
    _mn("ExternalSystem", "'ext:' || endpoint", "endpoint", f"SELECT min(ord) AS ord, endpoint FROM ({DATASOURCES}) d WHERE endpoint IS NOT NULL GROUP BY endpoint"),
    _mn("ExternalSystem", "'ext:rest:' || service", "service", f"SELECT min(ord) AS ord, service FROM ({INTERFACES}) i WHERE service IS NOT NULL GROUP BY service"),
    _mn("ConfigProperty", "'config:' || app_id || ':' || key", "key", f"SELECT min(ord) AS ord, app_id, key FROM ({CONFIG}) c WHERE NOT (lower(key) LIKE '%password%') GROUP BY app_id, key"),
    _mn("TransactionBoundary", "'tx:' || cast(ord as string)", "method", METHOD_FACTS),
)
MODEL_EDGES = _model(
    _MODEL_EDGE,
    _me("OWNS", "app_id", "id", "type", COMPONENTS),
    _me("STARTS_AT", "id", "component_id", "type", ENTRYPOINTS),
    _me("DEPENDS_ON", "from_id", "to_id", "kind", DEPENDENCIES),
    _me("CALLS", "from_id", "to_id", "call_kind", CALLS),
    _me("ORIGINATES", "entrypoint_id", "id", "param", PATHS),
    _me("REACHES", "path_id", "id", "kind", SINKS),
    _me("AT_COMPONENT", "id", "component_id", "kind", SINKS),
    _me("READS_STATE", "component_id", "owner_id", "field", f"SELECT * FROM ({FIELD_ACCESS}) a WHERE kind = 'READ'"),
    _me("WRITES_STATE", "component_id", "owner_id", "field", f"SELECT * FROM ({FIELD_ACCESS}) a WHERE kind = 'WRITE'"),
    _me("USES_DATASOURCE", "id", "'datasource:' || datasource", "datasource", f"SELECT * FROM ({UNITS}) u WHERE datasource IS NOT NULL"),
    _me("CONNECTS_TO", "'datasource:' || name", "'ext:' || endpoint", "endpoint", f"SELECT * FROM ({DATASOURCES}) d WHERE endpoint IS NOT NULL"),
    _me("DEPENDS_ON", "component_id", "'ext:rest:' || service", "type", f"SELECT * FROM ({INTERFACES}) i WHERE service IS NOT NULL"),
    _me("CONFIGURED_BY", "'ext:rest:' || service", "'config:' || app_id || ':' || key", "key", f"SELECT min(c.ord) AS ord, service, app_id, key FROM ({INTERFACES}) i JOIN ({CONFIG}) c ON c.key = i.config_key GROUP BY service, app_id, key"),
    _me("HAS_TRANSACTION_BOUNDARY", "component_id", "'tx:' || cast(ord as string)", "method", METHOD_FACTS),
)

STATEMENTS = {
    "nodes": NODES, "edges": EDGES, "components": COMPONENTS, "entrypoints": ENTRYPOINTS, "dependencies": DEPENDENCIES, "accesses": ACCESSES, "paths": PATHS, "sinks": SINKS, "steps": STEPS,
    "calls": CALLS, "tracked": TRACKED, "field_access": FIELD_ACCESS, "sites": SITES, "apps": APPS, "interfaces": INTERFACES, "config": CONFIG, "units": UNITS, "unit_entities": UNIT_ENTITIES,
    "datasources": DATASOURCES, "method_facts": METHOD_FACTS, "type_facts": TYPES_FACTS, "code_types": CODE_TYPES, "code_supertypes": CODE_SUPERTYPES, "code_fields": CODE_FIELDS, "code_locals": CODE_LOCALS, "code_methods": CODE_METHODS,
    "code_calls": CODE_CALLS, "code_expressions": CODE_EXPRESSIONS, "code_arguments": CODE_ARGUMENTS, "code_headers": CODE_HEADERS, "code_returns": CODE_RETURNS, "code_sites": CODE_SITES,
    "code_classes": CODE_CLASSES, "code_members": CODE_MEMBERS, "code_annotations": CODE_ANNOTATIONS, "code_held": CODE_HELD, "code_signatures": CODE_SIGNATURES, "code_apis": CODE_APIS, "xml_advice": XML_ADVICE, "xml_ejb": XML_EJB, "model_nodes": MODEL_NODES, "model_edges": MODEL_EDGES,
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def with_tables(*names: str) -> str:
    """The start of an oracle: WITH clauses of the named relations."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({STATEMENTS[n]})" for n in names)


@dataclass(frozen=True)
class Projection:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, name: str) -> DataFrame:
        used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", STATEMENTS[name])]
        statement = re.sub(r"\b(FROM|JOIN) (" + "|".join(used) + r")\b", r"\1 {\2}", STATEMENTS[name].replace("{", "{{").replace("}", "}}"))
        return self.spark.sql(statement, **{t: self.table(t) for t in used})

    @cached_property
    def nodes(self) -> DataFrame:
        """ord, id, label, name, props (text form of every property) and nums (numeric ones)."""
        wide = self._sql("nodes")
        present = lambda pairs: F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(c).alias("k"), v.alias("v")) for c, v in pairs)), lambda e: e["v"].isNotNull()))
        text = [("name", F.col("name")), *((c, F.col(c)) for c in TEXT), *((c, F.format_string("%.2f", F.col(c))) for c in NUMBER)]
        text = [(c, F.when(F.col(c).isNotNull(), v) if c in NUMBER else v) for c, v in text]
        return wide.select("ord", "id", "label", "name", present(text).alias("props"), present([(c, F.col(c)) for c in NUMBER]).alias("nums"))

    @cached_property
    def edges(self) -> DataFrame:
        wide = self._sql("edges")
        nums = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in ("quantity", "discount"))), lambda e: e["v"].isNotNull()))
        return wide.select("ord", "src", "dst", "label", F.transform_values(nums, lambda _, v: F.format_string("%.2f", v)).alias("props"), nums.alias("nums"))

    def _stored(self, name: str, nodes: str, edges: str) -> Adjacency:
        used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", STATEMENTS[nodes] + STATEMENTS[edges])]
        return active(self.spark, self.sf_dir, name, state_of(self.spark, *(f"{self.sf_dir}/{t}.parquet" for t in used)), lambda: (self._sql(nodes), self._sql(edges)))

    @cached_property
    def graph(self) -> Adjacency:
        """The property graph as stored for traversals."""
        return self._stored("graph", "nodes", "edges")

    @cached_property
    def model(self) -> Adjacency:
        """The software model's graph as stored for traversals."""
        return self._stored("model", "model_nodes", "model_edges")

    @cached_property
    def dependency_edges(self) -> DataFrame:
        d = self.dependencies
        return d.select("ord", F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.lit("DEPENDS_ON").alias("label"), "kind", "confidence")

    def __getattr__(self, name: str) -> DataFrame:
        if name in STATEMENTS:
            self.__dict__[name] = made = self._sql(name)  # one plan for all uses
            return made
        raise AttributeError(name)
