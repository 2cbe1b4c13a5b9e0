"""Runtime flows, call lines and traced names on small call graphs, and traced names against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import flow, policy

CALL = "ord long, from_id string, from_method string, to_id string, to_method string, call_kind string, capped boolean, ambiguous boolean, arg string, param string, killed string, receiver string, literal string, literal_value string, control string, branch_group string, branch_label string"
FIELDS = [f.split()[0] for f in CALL.split(", ")]


def calls(spark, *rows):
    base = {"call_kind": "direct", "capped": False, "ambiguous": False}
    made = []
    for i, r in enumerate(rows):
        a, b = r[:2]
        d = base | dict(zip(("from_id", "from_method", "to_id", "to_method"), (*a.split("."), *b.split(".")))) | {"ord": i} | (r[2] if len(r) > 2 else {})
        made.append(tuple(d.get(f) for f in FIELDS))
    return spark.createDataFrame(made, CALL)


def components(spark, **types):
    """By type, or type and stereotype."""
    rows = [(k, k.upper(), *(v if isinstance(v, tuple) else (v, None))) for k, v in types.items()]
    return spark.createDataFrame(rows, "id string, name string, type string, stereotype string")


def entrypoint(spark, at="a.m"):
    c, m = at.split(".")
    return spark.createDataFrame([("e", c, m, None, "GET", "/x", "REST_ENDPOINT")], "id string, component_id string, method string, channel string, http_method string, path string, type string")


def tracked(spark, *names):
    return spark.createDataFrame([(i, "e", n) for i, n in enumerate(names)], "ord long, entrypoint_id string, name string")


def test_flow_goes_through_hidden_components(spark):
    c = components(spark, a="SERVICE", u="UTILITY", b="SERVICE", h=("HTTP_CLIENT", "messaging"), d="REPOSITORY")
    k = calls(spark, ("a.m", "u.x"), ("u.x", "b.y"), ("b.y", "h.s"), ("h.s", "d.z"), ("a.m", "d.z"))
    v = flow.visits(entrypoint(spark), k, c)
    steps = [(r.position, r.component_id, r.via, r.method) for r in flow.flow_steps(v).orderBy("position").collect()]
    assert steps == [(0, "a", "GET /x", "m"), (1, "b", "y", "y"), (2, "d", "z", "z")]
    assert {(r.from_id, r.to_id, r.via) for r in flow.flow_edges(v).collect()} == {("a", "b", "y"), ("b", "d", "z"), ("a", "d", "z")}
    assert {r.line for r in flow.call_lines(v, c).collect()} == {"A.x -> B.y", "B.s -> D.z", "A.m -> D.z"}


def test_flow_ends_at_async_capped_and_ambiguous_calls(spark):
    c = components(spark, **{x: "SERVICE" for x in "abcdef"})
    k = calls(spark, ("a.m", "b.m", {"call_kind": "messaging"}), ("a.m", "c.m", {"call_kind": "event-bus"}), ("a.m", "d.m", {"capped": True}), ("a.m", "e.m", {"ambiguous": True}), ("a.m", "f.m"), ("f.m", "a.m"))
    v = flow.visits(entrypoint(spark), k, c)
    assert [r.component_id for r in flow.flow_steps(v).orderBy("position").collect()] == ["a", "f"]
    assert {(r.from_id, r.to_id) for r in flow.flow_edges(v).collect()} == {("a", "f"), ("f", "a")}  # a call back is an edge, but goes no further


def test_flow_depth_and_an_entrypoint_without_calls(spark):
    c = components(spark, **{f"c{i}": "SERVICE" for i in range(10)})
    k = calls(spark, *((f"c{i}.m", f"c{i + 1}.m") for i in range(9)))
    assert flow.flow_steps(flow.visits(entrypoint(spark, "c0.m"), k, c)).count() == 7  # expanded at depths 0 to 5
    assert [r.component_id for r in flow.flow_steps(flow.visits(entrypoint(spark, "c9.m"), k, c)).collect()] == ["c9"]


def names_at(states, component):
    return {(n["now"], n["first"]) for r in states.where(F.col("c") == component).collect() for n in r.names}


@pytest.mark.parametrize(
    "names,call,want",
    [
        (["order"], {"arg": "order", "param": "item"}, {("item", "order")}),
        (["order"], {}, {("order", "order")}),
        (["order"], {"killed": "order"}, set()),
        (["*"], {"arg": "order", "param": "item", "killed": "*"}, {("*", "*")}),
        (["order", "price"], {"arg": "order", "param": "item"}, {("item", "order")}),  # an unmapped name stops beside a mapped one
        (["price"], {"arg": "order", "param": "item"}, {("price", "price")}),  # the call maps nothing that is tracked
        (["order"], {"receiver": "client"}, set()),  # nothing is mapped and the receiver is another local
        (["order"], {"receiver": "order"}, {("order", "order")}),
        (["order"], {"receiver": "client", "arg": "other", "param": "x"}, {("order", "order")}),
    ],
)
def test_what_becomes_of_names(spark, names, call, want):
    c = components(spark, a="SERVICE", b="SERVICE")
    assert names_at(flow.trace(entrypoint(spark), tracked(spark, *names), calls(spark, ("a.m", "b.n", call)), c), "b") == want


def test_sinks(spark):
    c = components(spark, a="SERVICE", r="REPOSITORY", h="HTTP_CLIENT", q=("HTTP_CLIENT", "messaging"), o=("SERVICE", "object-storage"), p="CDI_EVENT_PRODUCER", w="SERVICE")
    k = calls(spark, ("a.m", "r.save"), ("a.m", "h.get"), ("a.m", "q.send"), ("a.m", "p.fire"), ("a.m", "w.tell", {"call_kind": "event-bus"}), ("a.m", "o.put", {"call_kind": "messaging"}), ("a.m", "r.drop", {"killed": "order"}), ("a.m", "w.wrap", {"literal": "name", "literal_value": "orders"}))
    states = flow.trace(entrypoint(spark), tracked(spark, "order"), k, c)
    got = {(r.component_id, r.method, r.kind) for r in flow.call_sinks(states, k, c).collect()}
    assert got == {("r", "save", "PERSISTENCE"), ("h", "get", "HTTP_OUTBOUND"), ("q", "send", "MESSAGING"), ("p", "fire", "EVENT_BUS"), ("w", "tell", "EVENT_BUS"), ("o", "put", "MESSAGING")}
    site = "ord long, component_id string, method string, kind string, topic string, channel string, broker string, only_component string, only_method string"
    sites = spark.createDataFrame([(0, "w", "wrap", "MESSAGING", "name", None, None, "a", "m"), (1, "w", "wrap", "MESSAGING", "other", None, None, "z", None), (2, "w", "wrap", "MESSAGING", " ", "ch", None, None, None), (3, "r", "deep", "MESSAGING", "far", None, None, None, None)], site)
    sinks = flow.outbound_sinks(states, sites)
    assert {r.channel for r in sinks.collect()} == {"orders", "ch"}
    more = calls(spark, ("a.m", "r.deep"), ("a.m", "w.wrap", {"literal": "name", "literal_value": "orders"}))
    reach = flow.call_graph_reach(entrypoint(spark), sites, more, flow.outbound_sinks(flow.trace(entrypoint(spark), tracked(spark, "order"), more, c), sites), tracked(spark, "order"))
    assert {(r.channel, r.component_id) for r in reach.collect()} == {("far", "r"), ("name", "w")}


def test_field_writes(spark):
    c = components(spark, a="SERVICE", b="SERVICE")
    k = calls(spark, ("a.m", "b.n"))
    access = "component_id string, method string, kind string, owner_id string, field string, source_var string, source_field string, key_var string"
    w = spark.createDataFrame([("a", "m", "WRITE", "a", "own", "else", None, None), ("b", "n", "WRITE", "b", "by_var", "order", None, None), ("b", "n", "WRITE", "b", "by_key", "x", None, "order"), ("b", "n", "WRITE", "b", "open", None, None, None), ("b", "n", "WRITE", "b", "no", "x", "y", "z"), ("b", "n", "READ", "b", "read", "order", None, None)], access)
    fields = lambda *names: {r.field for r in flow.field_write_sinks(flow.trace(entrypoint(spark), tracked(spark, *names), k, c), w).collect()}
    assert fields("order") == {"own", "by_var", "by_key", "open"} and fields("*") == set()


def by_search(rows, leaves, names, depth):
    """Every (component, method, now, first) by a plain depth-first search over simple ways."""
    out = set()

    def go(at, current, way):
        out.update((*at, n, f) for n, f in current)
        for a, b, arg, param, killed, receiver in rows:
            if a != at or b in way or b[0] in leaves or len(way) > depth:
                continue
            any_mapped = any(n == arg for n, _ in current if n != "*" and arg)
            after = []
            for n, f in current:
                if n == "*":
                    after.append((n, f))
                elif n == killed or (any_mapped and n != arg) or (arg is None and receiver is not None and receiver != n):
                    continue
                else:
                    after.append((param if n == arg else n, f))
            if after:
                go(b, after, [*way, b])

    go(("a", "m"), [(n, n) for n in names], [("a", "m")])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_traced_names_by_search(spark, seed):
    rng = random.Random(seed)
    ids, leaves = ["a", "b", "c", "d", "r"], {"r"}
    rows = [((rng.choice(ids), rng.choice("mn")), (rng.choice(ids), rng.choice("mn")), rng.choice([None, "order", "price"]), rng.choice(["item", "order"]), rng.choice([None, None, "price"]), rng.choice([None, None, "order"])) for _ in range(14)]
    k = calls(spark, *((".".join(a), ".".join(b), {"arg": arg, "param": param if arg else None, "killed": killed, "receiver": receiver}) for a, b, arg, param, killed, receiver in rows))
    rows = [(a, b, arg, param if arg else None, killed, receiver) for a, b, arg, param, killed, receiver in rows]
    c = components(spark, **{i: "REPOSITORY" if i in leaves else "SERVICE" for i in ids})
    states = flow.trace(entrypoint(spark), tracked(spark, "order", "price"), k, c)
    got = {(r.component_id, r.method, r.local_name, r.tracked) for r in flow.trace_steps(states).collect()}
    assert got == by_search(rows, leaves, ["order", "price"], 8)


def test_policies(spark):
    c = components(spark, a="SERVICE", j="EJB_STATELESS")
    facts = spark.createDataFrame(
        [(0, "a", "m0", "javax.TxType.REQUIRES_NEW", None, None, False, False, "jakarta"), (1, "a", "m1", None, "DEFAULT", None, False, True, "spring"), (2, "a", "m2", None, None, "SUPPORTS", False, False, "jakarta"), (3, "j", "m3", None, None, None, False, False, "jakarta"), (4, "j", "m4", "REQUIRED", None, None, True, False, "jakarta"), (5, "a", "m5", None, None, None, False, True, "jakarta"), (6, "a", "m6", None, None, None, False, False, "spring"), (7, "a", "m7", "REQUIRED", None, None, False, False, "spring")],
        "ord long, component_id string, method string, on_method string, on_type string, inherited string, bean_managed boolean, programmatic boolean, framework string",
    )
    got = {r.ord: (r.policy, r.level, r.confidence) for r in policy.policies(facts, c, calls(spark, ("a.x", "a.m7"))).collect()}
    assert got == {0: ("REQUIRES_NEW", "method", 1.0), 1: ("REQUIRED", "type", 0.6), 2: ("SUPPORTS", "inherited-type", 0.8), 3: ("REQUIRED", "ejb-default", 0.9), 4: ("PROGRAMMATIC", "bean-managed", 0.95), 5: ("PROGRAMMATIC", "programmatic-api", 0.6), 7: ("REQUIRED", "method", 0.6)}


def test_calls_map_and_kill_several_names(spark):
    c = components(spark, a="SERVICE", b="SERVICE")
    base = calls(spark, ("a.m", "b.m", {"receiver": "client"}))
    t = lambda mapping, kills, *names: {(r.n.now, r.n.first) for r in flow.trace(entrypoint(spark), tracked(spark, *names), base.withColumn("mapping", F.lit(None).cast("map<string,string>") if mapping is None else F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else F.create_map().cast("map<string,string>")).withColumn("kills", F.array(*map(F.lit, kills)).cast("array<string>")), c).where("d = 1").select(F.explode("names").alias("n")).collect()}
    assert t({"order": "o", "price": "p"}, [], "order", "price", "item") == {("o", "order"), ("p", "price")}
    assert t({"order": "o", "price": "p"}, ["price"], "order", "price") == {("o", "order")}
    assert t({}, ["order", "price"], "order", "price", "client") == {("client", "client")}
    assert t({"x": "y"}, [], "order") == {("order", "order")}


def test_names_that_are_followed(spark):
    e = spark.createDataFrame([("plain", "a", "m", "REST_ENDPOINT"), ("none", "a", "n", "REST_ENDPOINT"), ("job", "b", "m", "SCHEDULER")], "id string, component_id string, method string, type string")
    parameters = spark.createDataFrame([("plain", 1, "order"), ("plain", 2, "price"), ("job", 1, "cron")], "entrypoint_id string, ord long, name string")
    accesses = spark.createDataFrame([("a", "n", "READ", "a", "cache"), ("c", "x", "READ", "d", "stock"), ("c", "x", "WRITE", "d", "log")], "component_id string, method string, kind string, owner_id string, field string")
    k = calls(spark, ("a.m", "c.x"), ("b.m", "c.x"), ("b.m", "b.z"))
    made = k.withColumn("assigned", F.when(F.col("ord") == 0, "result"))
    got = {}
    for r in flow.tracked_names(e, parameters, flow.read_names(e, accesses, k), made).orderBy("ord").collect():
        got.setdefault(r.entrypoint_id, []).append(r.name)
    assert got == {"plain": ["order", "price", "result"], "none": ["*", "cache"], "job": ["cron", "stock"]}
