"""The stored adjacency, its pointer, evidence paths, the traversal log and policies of XML descriptors."""

import pytest

from weftgraph.operators import policy as Y
from weftgraph.operators import traverse as T
from weftgraph.sources import adjacency as A
from weftgraph.sources import xml_files as X


@pytest.fixture
def graph(spark, tmp_path):
    edges = [("e", "a", "STARTS_AT"), ("a", "b", "CALLS"), ("a", "b", "DEPENDS_ON"), ("b", "c", "CALLS"), ("x", "b", "DEPENDS_ON"), ("c", "a", "CALLS"), ("y", "x", "HIDES"), ("e", "x", "OWNS")]
    nodes = spark.createDataFrame([(i, n, "Entrypoint" if n == "e" else "Component", n.upper()) for i, n in enumerate("eabcxyz")], "ord long, id string, label string, name string")
    made = spark.createDataFrame([(i, *e) for i, e in enumerate(edges)], "ord long, src string, dst string, label string")
    return nodes, made, A.write_adjacency(nodes, made, f"file://{tmp_path}/graph")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_frontier_reads_its_buckets(spark, graph, monkeypatch):
    _, edges, stored = graph
    assert stored.steps(ids(spark, "a"), "out").count() == 2
    monkeypatch.setattr(A, "LEAST_BUCKETS", 1)
    assert rows(T.hops(stored, ids(spark, "a"), "both", (), 3)) == rows(T.hops(edges, ids(spark, "a"), "both", (), 3))
    plan = stored._held("out", ids(spark, "a"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_same_as_the_relation(spark, graph):
    nodes, edges, stored = graph
    for direction in ("out", "in", "both"):
        assert rows(T.hops(stored, ids(spark, "a"), direction, (), 3)) == rows(T.hops(edges, ids(spark, "a"), direction, (), 3))
    assert rows(T.paths(stored, "e", "c", 4)) == rows(T.paths(edges, "e", "c", 4))
    assert rows(T.closure(stored, ids(spark, "x"), "out", ("CALLS", "depends_on"))) == rows(T.closure(edges, ids(spark, "x"), "out", ("CALLS", "depends_on")))
    assert rows(stored.nodes_of(ids(spark, "a", "nothing"))) == [("a", "Component", "A")]


def test_entrypoints_reach_over_the_labels_that_count(spark, graph):
    nodes, edges, stored = graph
    found = {r.id: r.entrypoint_reachable for r in T.entrypoint_reachable(nodes, stored).collect()}
    assert found == {"e": True, "a": True, "b": True, "c": True, "x": False, "y": False, "z": False}


def test_evidence_is_a_shortest_way_by_the_first_edges(spark, graph):
    _, edges, stored = graph
    for g in (edges, stored):
        ways = T.ways_back(g, ids(spark, "c"), 4)
        got = {r.node_ids[0]: (r.node_ids, r.edge_labels) for r in T.evidence_paths(ways).collect()}
        assert got == {"b": (["b", "c"], ["CALLS"]), "a": (["a", "b", "c"], ["CALLS", "CALLS"]), "x": (["x", "b", "c"], ["DEPENDS_ON", "CALLS"]), "e": (["e", "a", "b", "c"], ["STARTS_AT", "CALLS", "CALLS"]), "y": (["y", "x", "b", "c"], ["HIDES", "DEPENDS_ON", "CALLS"])}
    assert [r.node_ids[0] for r in T.evidence_paths(ways, 1).collect()] == ["b"]
    assert T.evidence_paths(T.ways_back(stored, ids(spark), 3)).count() == 0


def test_log_counts_what_each_hop_reached(spark, graph):
    log = T.PlanLog()
    T.impacted_by(graph[2], ids(spark, "c"), 3, log)
    assert [tuple(r) for r in log.relation(spark).orderBy("step").collect()] == [(0, "hop", 1, "in *", 1), (1, "hop", 2, "in *", 2), (2, "hop", 3, "in *", 3)]


def test_pointer_is_swapped_when_the_sources_change(spark, graph, tmp_path):
    nodes, edges, _ = graph
    made = []

    def make():
        made.append(1)
        return nodes, edges

    first = A.active(spark, str(tmp_path), "g", "one", make)
    again = A.active(spark, str(tmp_path), "g", "one", make)
    assert first.base == again.base and len(made) == 1
    other = A.active(spark, str(tmp_path), "g", "two", make)
    assert other.base != first.base and len(made) == 2
    assert rows(T.hops(first, ids(spark, "a"), "out", (), 2)) == rows(T.hops(other, ids(spark, "a"), "out", (), 2))  # readers of the old version go on
    table = spark.createDataFrame([(1,)], "a int")
    table.write.parquet(f"file://{tmp_path}/t")
    before = A.state_of(spark, f"file://{tmp_path}/t")
    assert A.state_of(spark, f"{tmp_path}/t") == before
    table.write.mode("append").parquet(f"file://{tmp_path}/t")
    assert A.state_of(spark, f"file://{tmp_path}/t") != before


def test_a_version_makes_only_the_tables_that_are_asked_for(spark, graph, tmp_path):
    nodes, edges, _ = graph
    lazy = A.active(spark, str(tmp_path), "lazy", "one", lambda: (nodes, edges))
    stored = lambda: {t for t in ("out", "in", "nodes") if A.read_pointer(spark, f"{lazy.base}/{t}")}
    assert T.impacted_by(lazy, ids(spark)).count() == lazy.nodes_of(ids(spark)).count() == 0 and lazy.nodes.count() == 7 and stored() == set()
    assert rows(T.impacted_by(lazy, ids(spark, "c"))) == rows(T.impacted_by(edges, ids(spark, "c"))) and stored() == {"in"}
    again = A.active(spark, str(tmp_path), "lazy", "one", lambda: (nodes, edges))
    assert rows(T.reachable(again, ids(spark, "a"))) == rows(T.reachable(edges, ids(spark, "a"))) and stored() == {"in", "out"}


def test_an_empty_graph(spark, graph, tmp_path):
    nodes, edges, _ = graph
    empty = A.write_adjacency(nodes.limit(0), edges.limit(0), f"file://{tmp_path}/none")
    assert T.impacted_by(empty, ids(spark, "a")).count() == empty.nodes.count() == T.paths(empty, "a", "b").count() == 0


SPRING = """<beans xmlns:tx="t" xmlns:aop="a"><tx:advice id="tx"><tx:attributes><tx:method name="find*" read-only="true" propagation="SUPPORTS"/><tx:method name="*"/><tx:method name="findAll" propagation="RequiresNew" isolation="SERIALIZABLE"/></tx:attributes></tx:advice>
<aop:config><aop:pointcut id="p" expression="execution(* com.acme.*Service.*(..))"/><aop:advisor advice-ref="tx" pointcut-ref="p"/><aop:advisor advice-ref="tx" pointcut="within(com..*)"/></aop:config></beans>"""
EJB = """<ejb-jar xmlns="j"><assembly-descriptor><container-transaction><method><ejb-name>Cart</ejb-name><method-name>add*</method-name></method><method><ejb-name>Cart</ejb-name><method-name>buy</method-name><method-params><method-param>java.lang.String</method-param></method-params></method><trans-attribute>Mandatory</trans-attribute></container-transaction></assembly-descriptor></ejb-jar>"""
WEB = "<web-app><resource-ref><res-ref-name>jdbc/a</res-ref-name><res-type>javax.sql.DataSource</res-type></resource-ref><resource-ref><res-ref-name>mail</res-ref-name><res-type>Session</res-type></resource-ref><resource-ref><res-ref-name>r</res-ref-name><lookup-name>java:/b</lookup-name></resource-ref></web-app>"
SERVER = '<server xmlns="s"><datasources><datasource jndi-name="java:/main" pool-name="Main"><connection-url>jdbc:postgresql://me:secret@db/app?ssl=1</connection-url><driver>pg</driver></datasource><datasource jndi-name="java:/x"><connection-url>${url}</connection-url></datasource><datasource/></datasources></server>'


def described(spark):
    return spark.createDataFrame([("m", "context.xml", SPRING), ("m", "ejb-jar.xml", EJB), ("w", "web.xml", WEB), ("s", "standalone.xml", SERVER), ("o", "odd.xml", "<open>"), ("o", "type.xml", "<!DOCTYPE x><x/>"), ("o", "none.xml", None)], "folder string, name string, value string")


def test_descriptors(spark):
    files = described(spark)
    assert [(r.advisor, r.rule, r.pattern, r.propagation, r.read_only, r.isolation) for r in X.read_advice(files).where("advisor = 0").orderBy("rule").collect()] == [(0, 0, "find*", "SUPPORTS", True, None), (0, 1, "*", "REQUIRED", None, None), (0, 2, "findAll", "RequiresNew", None, "SERIALIZABLE")]
    assert rows(X.read_ejb_transactions(files)) == [("m/ejb-jar.xml", 0, "Cart", "add*", "Mandatory", None), ("m/ejb-jar.xml", 0, "Cart", "buy", "Mandatory", ["java.lang.String"])]
    assert sorted(r.datasource for r in X.read_resource_refs(files).collect()) == ["java:/b", "jdbc/a"]
    assert rows(X.read_server_datasources(files).drop("file")) == [("Main", "java:/main", "pg", "jdbc:postgresql://db/app", False), ("java:/x", "java:/x", None, None, True)]


def test_policies_in_xml_over_annotations(spark):
    files = described(spark)
    types = spark.createDataFrame([("s", "com.acme.OrderService", "OrderService", None), ("c", "com.acme.CartBean", "CartBean", "Cart"), ("u", "com.acme.Util", "Util", None)], "component_id string, qualified_name string, name string, ejb_name string")
    methods = spark.createDataFrame([("s", "findAll", "findAll()", []), ("s", "findOne", "findOne()", []), ("s", "save", "save()", []), ("c", "addItem", "addItem()", []), ("c", "buy", "buy(String)", ["String"]), ("c", "buy", "buy()", []), ("u", "find", "find()", [])], "component_id string, method string, signature string, parameter_types array<string>")
    advised, unmet = Y.advised(X.read_advice(files), types, methods)
    ejb = Y.described(X.read_ejb_transactions(files), types, methods)
    own = spark.createDataFrame([("s", "save", "save()", "MANDATORY", "method", "spring", 1.0, "", False), ("s", "findOne", "findOne()", "REQUIRED", "ejb-default", "ejb", 0.9, "", True), ("u", "find", "find()", "NEVER", "type", "spring", 1.0, "x", False)], "component_id string, method string, signature string, policy string, level string, framework string, confidence double, limitations string, defaulted boolean")
    got = {r.signature: (r.policy, r.level, r.framework, r.confidence, r.limitations) for r in Y.upserted(own, advised, ejb).collect()}
    assert got == {
        "findAll()": ("REQUIRES_NEW", "xml", "spring-xml", 0.9, ""), "findOne()": ("SUPPORTS", "xml", "spring-xml", 0.9, ""), "save()": ("REQUIRED", "xml", "spring-xml", 0.6, "coexisting-annotation-and-xml-advice"),
        "addItem()": ("MANDATORY", "xml", "ejb-xml", 1.0, ""), "buy(String)": ("MANDATORY", "xml", "ejb-xml", 1.0, ""), "find()": ("NEVER", "type", "spring", 1.0, "x"),
    }
    assert [(r.advice, r.method, r.policy) for r in unmet.collect()] == [("tx", "find*", "SUPPORTS")]


def test_consumers_upstream_by_message_alone(spark):
    """An entrypoint whose only producer sends it a message, without a broker, by its channel."""
    from weftgraph.operators import answers, linkers

    entrypoints = spark.createDataFrame([(1, "send", "REST_ENDPOINT", "send", "/s", "POST", "c1", None, None, None), (2, "take", "MESSAGING_CONSUMER", "take", None, None, "c2", "orders", None, "KAFKA")], "ord long, id string, type string, name string, path string, http_method string, component_id string, channel string, topic string, broker string")
    paths = spark.createDataFrame([("p1", "send"), ("p2", "take")], "id string, entrypoint_id string")
    sinks = spark.createDataFrame([("k", "p1", "MESSAGING", "c1", "c1", "f", "orders", None, None, None, None, "flow")], "id string, path_id string, kind string, component_id string, owner_id string, field string, channel string, topic string, broker string, entity string, operation string, evidence string")
    links = linkers.all_links(sinks, paths, entrypoints)
    assert [tuple(r) for r in links.collect()] == [("k", "p1", "p2")]
    steps = spark.createDataFrame([("take", "c2", "on")], "entrypoint_id string, component_id string, method string")
    got = {(r.section, r.item) for r in answers.consumer_context(entrypoints, "take", paths, sinks, steps).collect()}
    assert ("upstream", "send") in got and ("status", "resolved") in got
