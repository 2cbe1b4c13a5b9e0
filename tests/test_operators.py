"""Hand-made graphs with known answers, and traversals against plain Python on random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import chains, filters, limits, linkers, metrics, ordered, questions, render, rollup, scan, traverse
from weftgraph.sources import store

EDGES = "ord long, src string, dst string, label string"


def edges(spark, pairs, label="DEPENDS_ON"):
    return spark.createDataFrame([(i, a, b, label) for i, (a, b) in enumerate(pairs)], EDGES)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def found(df, *cols):
    return {tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).collect()}


def test_limits():
    assert [limits.traversal_limit(x) for x in (None, 0, 256)] == [25, 1, 100]
    assert [limits.node_limit(x) for x in (0, -1, 7, 10**6)] == [None, None, 7, 50_000]
    assert [limits.edge_limit(x) for x in (0, None, 20_000, 60_000)] == [25, 25, 20_000, 50_000]
    assert [limits.depth_limit(x, 5, 8) for x in (None, 0, 99)] == [5, 1, 8]


def test_edge_limit_of_a_hub(spark):
    hub = edges(spark, [("hub", f"n{i}") for i in range(150)])
    assert scan.find_edges(hub, label="depends_on", limit=20_000).count() == 150
    assert scan.find_edges(hub, limit=0).count() == 25
    assert scan.neighborhood(hub, "hub", "out", 1000).count() == 100


def test_filters_by_kind(spark):
    nodes = spark.createDataFrame([(1, "a", "X", "a", {"v": "10", "t": "10"}, {"v": 10.0}), (2, "b", "X", "b", {"v": "ten"}, {})], "ord long, id string, label string, name string, props map<string,string>, nums map<string,double>")
    ask = lambda **f: found(filters.matching(nodes, f), "id")
    assert ask(v=">=10") == {"a"}
    assert ask(t=">=10") == set()  # text that looks like a number is no number
    assert ask(v=" TEN ") == {"b"}
    assert ask(v=">x") == set()
    assert ask(v="  ") == {"a", "b"}
    assert ask(missing="a") == set()
    assert found(filters.matching(nodes, label="x"), "id") == {"a", "b"}


def test_paths_are_simple_and_count_parallel_edges(spark):
    e = edges(spark, [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("a", "c")])
    assert sorted(r[0] for r in traverse.paths(e, "a", "c", 3).select(F.array_join("node_ids", ">")).collect()) == ["a>b>c", "a>b>c", "a>c"]
    assert traverse.paths(e, "a", "a", 5).count() == 0
    assert traverse.paths(e, "a", "nowhere", 5).count() == 0


def test_reachable_emits_the_start_on_a_cycle(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c")])
    assert found(traverse.reachable(e, ids(spark, "a"), "out", None, 2), "id") == {"a", "b", "c"}
    assert found(traverse.impacted_by(e, ids(spark, "a"), 3), "id") == {"b"}


@pytest.mark.parametrize("seed", range(3))
def test_traversal_against_python(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(24)]
    e = edges(spark, pairs)
    front, seen = {"n0"}, set()
    for _ in range(3):
        front = {b for a, b in pairs if a in front}
        seen |= front
    assert found(traverse.reachable(e, ids(spark, "n0"), "out", None, 3), "id") == seen
    all_, front = {"n0"}, {"n0"}
    while front:
        front = {b for a, b in pairs if a in front} - all_
        all_ |= front
    assert found(traverse.closure(e, ids(spark, "n0")), "id") == all_
    want = []

    def walk(way, left):
        for a, b in pairs:
            if a == way[-1] and b not in way:
                if b == "n1":
                    want.append(">".join([*way, b]))
                elif left > 1:
                    walk([*way, b], left - 1)

    walk(["n0"], 5)
    got = [r[0] for r in traverse.paths(e, "n0", "n1").select(F.array_join("node_ids", ">")).collect()]
    assert sorted(got) == sorted(want)


def test_condensation(spark):
    comps = spark.createDataFrame([("A", "SERVICE"), ("U", "UTILITY"), ("C", "SERVICE")], "id string, type string")
    assert found(traverse.condense(edges(spark, [("A", "U"), ("U", "C"), ("U", "A")]), comps), "src", "dst") == {("A", "C")}


def test_noise_and_weight(spark):
    row = [("x", "TimestampFormatter", "UTILITY", "com.acme.util", 8, 0, 0, 0, 0, 0, 0)]
    m = spark.createDataFrame(row, "id string, name string, type string, package string, fan_in int, fan_out int, owned int, cross_reads int, cross_writes int, handoffs_in int, handoffs_out int")
    r = metrics.relevance(m).first()
    assert (r.noise_score, r.infrastructure_role, r.business_relevant, r.workflow_relevant, r.weight) == (6, "utility", False, False, 0)


def test_bridge_score_of_noise_is_capped(spark):
    m = spark.createDataFrame([("x", "Thing", "UNKNOWN", "a.b", 0, 0, 0, 30, 0, 0, 0)], "id string, name string, type string, package string, fan_in int, fan_out int, owned int, cross_reads int, cross_writes int, handoffs_in int, handoffs_out int")
    assert metrics.relevance(m).first().bridge_score <= 2


@pytest.mark.parametrize(
    "name,package,kind,role",
    [("OrderMapper", "a.b", "SERVICE", "mapper"), ("LockRegistry", "a.redis", "SERVICE", "redis-lock"), ("Web", "a.security.config", "SERVICE", "security-configuration"), ("FlywayRunner", "a.infrastructure", "SERVICE", "migration-initializer")],
)
def test_support_roles(spark, name, package, kind, role):
    r = metrics.classify(spark.createDataFrame([(name, package, kind, 0, 0)], "name string, package string, type string, fan_out int, owned int")).first()
    assert (r.support_role, r.primary_role, r.agent_category) == (role, "support", "supporting-infrastructure")


def test_evidence_bands(spark):
    df = spark.createDataFrame([(0.95, False), (0.95, True), (0.8, False), (0.4, False), (0.0, False), (None, None)], "confidence double, flag boolean")
    assert [r.confidence_band for r in metrics.evidence(df, F.col("flag")).collect()] == ["known", "ambiguous", "inferred", "ambiguous", "unknown", "unknown"]


def test_state_handoff(spark):
    a = spark.createDataFrame([("Order", "place", "WRITE", "Store", "snapshots"), ("Publisher", "tick", "READ", "Store", "snapshots")], "component_id string, method string, kind string, owner_id string, field string")
    assert found(linkers.state_handoffs(a), "writer", "reader") == {("Order", "Publisher")}


def test_messaging_falls_back_only_without_broker(spark):
    s = spark.createDataFrame([("s1", "KAFKA", "t", "c"), ("s2", None, None, "c"), ("s3", "JMS", None, "c")], "id string, broker string, topic string, channel string")
    c = spark.createDataFrame([("e1", "KAFKA", "t", "x"), ("e2", "AMQP", " ", "c")], "entrypoint_id string, broker string, topic string, channel string")
    assert found(linkers.messaging_links(s, c), "sink_id", "entrypoint_id") == {("s1", "e1"), ("s2", "e2")}


def test_contains_links_agree_for_small_and_large(spark):
    a = spark.createDataFrame([(1, "orders-api"), (2, "db"), (3, "x"), (4, "Billing")], "id int, name string")
    b = spark.createDataFrame([(1, "orders"), (2, "my-db-host"), (3, "bill"), (4, "xyz"), (5, "")], "id int, name string")
    small, large = (found(linkers.contains_links(a, b, small=n), "left_id", "right_id") for n in (100, 0))
    assert {(1, 1), (2, 2), (3, 4), (4, 3)} <= small
    assert {x for x in small if x[1] != 5} == {x for x in large if x[1] != 5}


def chain_tables(spark, links):
    names = sorted({x for pair in links for x in pair})
    return spark.createDataFrame([(n, "ep" + n) for n in names], "id string, entrypoint_id string"), spark.createDataFrame(links, "from_path string, to_path string")


def test_chains_and_prefixes(spark):
    made = chains.chains(*chain_tables(spark, [("R", "B"), ("B", "A"), ("B", "C"), ("C", "D")]))
    assert found(made, F.array_join("ids", "")) == {"RBA", "RBCD"}
    assert found(chains.without_prefixes(made), F.array_join("ids", "")) == {"RBCD"}


def test_chains_stop_on_cycles(spark):
    made = chains.chains(*chain_tables(spark, [("R", "A"), ("A", "B"), ("B", "A")]))
    assert found(made, F.array_join("ids", "")) == {"RAB"}


@pytest.mark.parametrize(
    "policies,want",
    [
        (["REQUIRED", "REQUIRES_NEW", "NOT_SUPPORTED", None], [("begin", "f:tx:1"), ("suspend-and-begin", "f:tx:2"), ("suspend", None), ("none", None)]),
        (["SUPPORTS", "MANDATORY", "NESTED", "NEVER"], [("none", None), ("missing-required-scope", None), ("begin", "f:tx:1"), ("invalid-active-scope", "f:tx:1")]),
        (["REQUIRED", None, "ODD", "REQUIRED"], [("begin", "f:tx:1"), ("join", "f:tx:1"), ("unknown", None), ("begin", "f:tx:2")]),
    ],
)
def test_transaction_scopes(spark, policies, want):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate(policies)], "flow_id string, step int, policy string")
    assert [(r.transition, r.scope) for r in ordered.transaction_scopes(df).orderBy("step").collect()] == want


def test_planner_and_subjects(spark):
    q = spark.createDataFrame([(1, "What does POST /orders/{id}? break"), (2, "hello"), (3, "Where is `x.y` persisted in the database entity"), (4, None)], "id int, question string")
    got = {r.id: r.intent for r in questions.plan(q).collect()}
    assert got[2] == got[4] == "unsupported" and got[3] == "persistence_destination"
    s = {r.id: r.s for r in q.select("id", questions.subject(F.col("question")).alias("s")).collect()}
    assert (s[1].kind, s[1].ref) == ("entrypoint", "POST /orders/{id}") and s[3].ref == "x.y" and s[2] is None


def test_identity_ignores_key_order():
    assert questions.concept_key("impact", {"a": 1, "b": 2}) == questions.concept_key("impact", {"b": 2, "a": 1})
    assert questions.concept_path("impact", "x", {}).startswith("investigations/impact/x-")


def test_build_merges_and_drops_dangling(spark):
    n = spark.createDataFrame([(2, "a", "Late", "late", {"k": "new", "z": " "}, {"w": 2.0}), (1, "a", "First", "first", {"k": "old", "y": "1"}, {"w": 1.0})], "ord long, id string, label string, name string, props map<string,string>, nums map<string,double>")
    nodes, kept = store.build_graph(n, edges(spark, [("a", "a"), ("a", "gone"), ("a", "a")]))
    r = nodes.first()
    assert (r.label, r.name, r.props, r.nums, r.ord) == ("First", "first", {"k": "new", "y": "1"}, {"w": 2.0}, 1)
    assert kept.count() == 2


def test_store_round_trip_and_readers(spark, tmp_path):
    n = spark.createDataFrame([(1, "a", "X", "a", {"k": "v"}, {"w": 1.0})], "ord long, id string, label string, name string, props map<string,string>, nums map<string,double>")
    base = store.save_graph(n, edges(spark, [("a", "a")]), f"file://{tmp_path}/g", "/work/My App")
    nodes, e = store.load_graph(spark, base)
    assert base.endswith("-My_App") and nodes.first().props == {"k": "v"} and e.count() == 1
    (tmp_path / "a.properties").write_text("# note\nx.y=1\nx.y = 2\nz: 3\n")
    assert found(store.read_properties(spark, f"file://{tmp_path}/a.properties"), "key", "value") == {("x.y", "2"), ("z", "3")}
    (tmp_path / "hosts.ini").write_text("[web]\nh1 port=1\nh2\n[db]\nh3\n")
    assert found(store.read_inventory(spark, f"file://{tmp_path}/hosts.ini"), "group", "host") == {("web", "h1"), ("web", "h2"), ("db", "h3")}
    assert store.to_json_lines(n).first().value == '{"ord":1,"id":"a","label":"X","name":"a","props":{"k":"v"},"nums":{"w":1.0}}'


def test_rendering(spark):
    n = spark.createDataFrame([("a:1", 'A "x"'), ("b", "B")], "id string, name string")
    out = render.text(render.mermaid(n, edges(spark, [("a:1", "b")])))
    assert out.splitlines() == ["flowchart LR", '  a_1["A #quot;x#quot;"]', '  b["B"]', "  a_1 -->|DEPENDS_ON| b"]
    assert render.text(render.likec4(n, edges(spark, []))).startswith("model {")
    assert "</script><script>" not in render.viewer_page('{"a":"</script><script>"}')


def test_common_package(spark):
    df = spark.createDataFrame([("a.b.c",), ("a.b.d.e",), ("a.bc",)], "package string")
    assert rollup.common_package(df).first().prefix == "a"


def test_event_bus_links_are_not_made_distinct_again(spark):
    """Distinct sides give distinct links: nothing is shuffled after the join, whose partitions stay apart."""
    p = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", None), ("a", "y")], "producer string, event_type string")
    c = spark.createDataFrame([("a", "x"), ("c", "x"), ("c", "x"), ("c", None), ("a", "y")], "consumer string, event_type string")
    links = linkers.event_bus_links(p, c)
    assert sorted(tuple(r) for r in links.collect()) == [("a", "c", "x", 0.8), ("b", "a", "x", 0.8), ("b", "c", "x", 0.8)]
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")] and plan.count("RepartitionByExpression") == 2


def test_dependency_flow_walks_from_components(spark, monkeypatch):
    """Entrypoints that share a component share its walk; an entrypoint with several components keeps the fewest hops."""
    from weftgraph.operators import flow

    seen = []
    monkeypatch.setattr(flow, "checkpointed", lambda df, name: seen.append(df.columns) or df.cache())
    e = spark.createDataFrame([("e", "a"), ("e", "a"), ("f", "a"), ("g", "a"), ("g", "b"), ("h", None)], "id string, component_id string")
    comps = spark.createDataFrame([(c, "SERVICE", "plain") for c in "abc"] + [("u", "UTILITY", "plain")], "id string, type string, stereotype string")
    got = sorted(tuple(r) for r in flow.dependency_flow(e, edges(spark, [("a", "u"), ("u", "c"), ("b", "c"), ("c", "a")]), comps).collect())
    assert got == [("e", "a", 0), ("e", "c", 2), ("f", "a", 0), ("f", "c", 2), ("g", "a", 0), ("g", "b", 0), ("g", "c", 1)]
    assert all("entrypoint_id" not in columns for columns in seen)


def test_reaching_walks_over_numbers(spark, monkeypatch):
    from weftgraph.operators import flow

    seen = []
    monkeypatch.setattr(flow, "checkpointed", lambda df, name: seen.append((name, [t for _, t in df.dtypes])) or df.localCheckpoint())
    calls = spark.createDataFrame([("a", "m", "b", "m"), ("b", "m", "c", "m"), ("c", "m", "a", "m"), ("x", None, "c", "m")], "from_id string, from_method string, to_id string, to_method string")
    calls = calls.select("*", F.lit("direct").alias("call_kind"), F.lit(False).alias("capped"), F.lit(False).alias("ambiguous"))
    at = spark.createDataFrame([("c", "m"), ("lone", "m"), ("c", "m")], "component_id string, method string")
    assert found(flow.reaching(at, calls), "component_id", "method", "c", "m") == {("c", "m", x, "m") for x in "abc"} | {("lone", "m", "lone", "m")}
    assert {tuple(t) for name, t in seen if name == "reach"} == {("bigint", "bigint")}


def test_handoffs_of_a_field_are_not_compared_again(spark, monkeypatch):
    from weftgraph.operators import answers

    stored = []
    keep = answers.checkpointed
    monkeypatch.setattr(answers, "checkpointed", lambda df, name: stored.append(keep(df, name)) or stored[-1])
    a = spark.createDataFrame([(c, k, "o", "f1") for c, k in (("w", "WRITE"), ("w", "READ"), ("r", "READ"), ("x>y", "READ"), ("x", "WRITE"), ("y>r", "READ"), ("x>y", "WRITE"))], "component_id string, kind string, owner_id string, field string")
    got = answers.state_lifecycle(a, linkers.state_handoffs(a), "f1").where("section = 'handoffs'").select("item").collect()
    assert sorted(r.item for r in got) == sorted({f"{w}>{r}" for w in ("w", "x", "x>y") for r in ("w", "r", "x>y", "y>r") if w != r})
    assert {r.item for r in stored[0].where("section = 'handoffs'").collect()} == {r.item for r in got if r.item.count(">") > 1}
