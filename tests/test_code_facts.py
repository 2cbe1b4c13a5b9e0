"""Topics, dependencies and framework rules on small sources."""

from pyspark.sql import functions as F

from weftgraph.operators import dependencies as D
from weftgraph.operators import frameworks as W
from weftgraph.operators import topics as N


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


EXPRESSIONS = "id string, kind string, value string, init string, owner string, method string, position int, message boolean, receiver_type string, callee string"


def expression(id_, kind, value=None, init=None, owner=None, method=None, position=None, message=False, receiver=None, callee=None):
    return (id_, kind, value, init, owner, method, position, message, receiver, callee)


def sources(spark):
    expressions = frame(
        spark, EXPRESSIONS,
        expression("lit", "literal", "orders"), expression("budget", "literal", "budgetControl"), expression("account", "literal", "account"), expression("pdf", "literal", "pdfCreation"), expression("push", "literal", "pushNotification"),
        expression("CONST", "field", init="push"), expression("var", "local", init="CONST"), expression("p1", "param", owner="Wrapper", method="send", position=1), expression("msg", "param", owner="Mail", method="deliver", position=0, message=True),
        expression("inner", "call", receiver="Event", callee="topic"), expression("loopA", "local", init="loopB"), expression("loopB", "local", init="loopA"), expression("own", "literal", "ownTopic"), expression("dead", "other"),
    )
    arguments = frame(
        spark, "call string, owner string, method string, position int, arity int, expression string, type string, caller string, caller_method string",
        ("c1", "Wrapper", "send", 0, 2, "dead", "Object", "BudgetService", "trigger"), ("c1", "Wrapper", "send", 1, 2, "budget", "String", "BudgetService", "trigger"), ("c2", "Wrapper", "send", 1, 2, "account", "String", "AccountService", "register"),
        ("c3", "Wrapper", "emit", 0, 1, "dead", "OwnEvent", "OwnService", "go"), ("c4", "Wrapper", "emit", 0, 1, "dead", "Event", "SisService", "print"), ("c5", "Mail", "deliver", 0, 1, "dead", "Message", "MailService", "post"),
    )
    headers = frame(spark, "caller string, caller_method string, expression string", ("MailService", "post", "lit"))
    returns = frame(spark, "owner string, method string, expression string", ("PdfEvent", "topic", "pdf"), ("OwnEvent", "topic", "own"))
    types = frame(spark, "id string, interface boolean", ("Event", True), ("PdfEvent", False), ("OwnEvent", False))
    supertypes = frame(spark, "type string, supertype string", ("PdfEvent", "Event"))
    return expressions, arguments, headers, returns, types, supertypes


def site(id_, kind="OTHER", topic=None, expression=None, position=None, accessor=None, arity=None, param_type=None, evidence=None, owner="Wrapper", method="m"):
    return (id_, owner, method, topic, kind, expression, position, accessor, arity, param_type, evidence)


def test_topics(spark):
    sites = frame(
        spark, "id string, owner string, method string, topic string, kind string, expression string, position int, accessor string, arity int, param_type string, evidence string",
        site("known", "LITERAL", "orders.created"), site("constant", expression="var"), site("by-caller", "PARAM_REF", expression="p1", position=1, arity=2, method="send"), site("by-class", "METHOD_CALL", position=0, accessor="topic", arity=1, param_type="Event", evidence="flow", method="emit"),
        site("no-callers", "PARAM_REF", position=0, arity=9, method="send"), site("cycle", expression="loopA"), site("header", expression="msg"), site("implementations", expression="inner"), site("nothing"),
    )
    got = {}
    for r in N.resolve_topics(sites, *sources(spark)).collect():
        got.setdefault(r.id, set()).add((r.topic, r.only_component, r.only_method, r.evidence))
    assert got["known"] == {("orders.created", None, None, None)}
    assert got["constant"] == {("pushNotification", None, None, None)}
    assert got["by-caller"] == {("budgetControl", "BudgetService", "trigger", None), ("account", "AccountService", "register", None)}
    assert got["by-class"] == {("ownTopic", "OwnService", "go", "flow+topic-expansion"), ("pdfCreation", "SisService", "print", "flow+topic-expansion")}
    assert got["header"] == {("orders", None, None, None)} and got["implementations"] == {("pdfCreation", None, None, None)}
    assert got["no-callers"] == got["cycle"] == got["nothing"] == {(None, None, None, None)}


def test_topics_as_deep_as_the_rule(spark):
    chain = [expression(f"e{i}", "local", init=f"e{i + 1}") for i in range(20)] + [expression("e20", "literal", "end")]
    expressions = frame(spark, EXPRESSIONS, *chain)
    steps = expressions.where("init is not null").select(F.col("id").alias("expression"), F.col("init").alias("next"))
    roots = frame(spark, "expression string", ("e5",), ("e6",))
    assert [tuple(r) for r in N.constants(roots, expressions, steps).collect()] == [("e6", "end")]


def test_dependencies(spark):
    components = frame(spark, "id string, qualified_name string, type string, module string", ("a", "A", "SERVICE", "m"), ("b", "B", "REPOSITORY", "m"), ("c", "C", "ENTITY", "n"), ("d", "D", "SERVICE", None))
    supertypes = frame(spark, "type string, supertype string, is_class boolean", ("B", "Repo", False), ("C", "Two", False), ("D", "Two", False), ("X", "Repo", False), ("B", "Base", True))
    fields = frame(
        spark, "ord long, owner string, type string, annotations array<string>, is_final boolean",
        (1, "A", "Repo", ["Autowired"], False), (2, "A", "C", [], False), (3, "A", "Two", ["Inject"], True), (4, "A", "A", ["Inject"], False), (5, "D", "Repo", [], True), (6, "D", "B", ["Inject"], False), (7, "C", "Base", ["Inject"], False), (8, "C", "D", None, None),
    )
    signatures = frame(spark, "ord long, owner string, type string", (1, "A", "C"), (2, "B", "C"), (3, "B", "B"))
    got = {(r.from_id, r.to_id): (r.kind, r.derived_from, r.confidence) for r in D.extract(components, supertypes, fields, signatures).collect()}
    assert got == {
        ("a", "b"): ("injection", "annotation", 0.93), ("a", "c"): ("field-reference", "type-relation", 0.55), ("d", "b"): ("injection", "annotation", 0.93),
        ("c", "d"): ("field-reference", "type-relation", 0.6), ("b", "c"): ("type-usage", "method-signature", 0.5),
    }


def spring(spark):
    types = frame(
        spark, "id string, name string, interface boolean, parents array<string>",
        ("Orders", "Orders", False, []), ("Plain", "Plain", False, []), ("Client", "Client", True, []), ("Jobs", "Jobs", False, ["CommandLineRunner"]), ("Listener", "Listener", False, []), ("Item", "Item", False, []), ("Both", "Both", False, []),
    )
    members = frame(
        spark, "type string, name string, kind string, static boolean, public boolean, type_name string, parameter_types array<string>",
        *((t, m, "method", s, True, "void", []) for t, m, s in (("Orders", "list", False), ("Orders", "save", False), ("Orders", "any", False), ("Client", "fetch", False), ("Jobs", "run", False), ("Jobs", "tick", False), ("Listener", "on", False), ("Listener", "odd", False), ("Both", "main", True), ("Plain", "main", True))),
    )
    annotations = frame(
        spark, "ord long, type string, member string, name string, attributes map<string,string>",
        (1, "Orders", None, "RestController", {}), (2, "Orders", None, "RequestMapping", {"value": "/orders/"}), (3, "Orders", "list", "GetMapping", {"path": "{id}"}), (4, "Orders", "save", "PostMapping", None), (5, "Orders", "any", "RequestMapping", {"method": "RequestMethod.PUT", "value": "//deep"}),
        (6, "Client", None, "FeignClient", {"name": "stock"}), (7, "Client", "fetch", "GetMapping", {"value": "/x"}), (8, "Jobs", "tick", "Scheduled", {"fixedRateString": "5s"}), (9, "Listener", None, "KafkaListener", {"topicPattern": "t.*"}),
        (10, "Listener", "on", "KafkaHandler", {}), (11, "Listener", "odd", "JmsListener", {"destination": " "}), (12, "Item", None, "Entity", {}), (13, "Item", None, "Service", {}), (14, "Both", None, "Component", {}), (15, "Both", None, "Service", {}),
    )
    return types, members, annotations


def test_spring_rules(spark):
    types, members, annotations = spring(spark)
    found = W.components(types, members, annotations, "spring")
    assert {r.id: (r.component_type, r.technology, r.stereotypes) for r in found.collect()} == {
        "Orders": ("REST_RESOURCE", "spring", "controller"), "Client": ("HTTP_CLIENT", "spring", "feign-client"), "Jobs": ("SCHEDULER", "spring", "scheduled"), "Listener": ("MESSAGE_DRIVEN_BEAN", "spring", "messaging-listener"),
        "Item": ("ENTITY", "jpa", "entity"), "Both": ("SERVICE", "spring", "service"),
    }
    entries = W.entrypoints(found, types, members, annotations, "spring", "/shop")
    got = {(r.type, r.member): (r.kind, r.http_method, r.path, r.channel, r.broker, r.trigger_kind, r.trigger) for r in entries.collect()}
    assert got == {
        ("Orders", "list"): ("REST_ENDPOINT", "GET", "/shop/orders/{id}", None, None, None, None), ("Orders", "save"): ("REST_ENDPOINT", "POST", "/shop/orders/", None, None, None, None), ("Orders", "any"): ("REST_ENDPOINT", "PUT", "/shop/orders/deep", None, None, None, None),
        ("Jobs", "tick"): ("SCHEDULER", None, None, None, None, "FIXED_RATE", "5s"), ("Jobs", "run"): ("MAIN_METHOD", None, None, None, None, None, None), ("Both", "main"): ("MAIN_METHOD", None, None, None, None, None, None),
        ("Listener", "on"): ("MESSAGING_CONSUMER", None, None, "t.*", "KAFKA", None, None), ("Listener", "odd"): ("JMS_CONSUMER", None, None, W.UNRESOLVED, "JMS", None, None),
    }
    assert {r.id: r.topic for r in W.interfaces(entries).collect()} == {
        "iface:Orders:rest_endpoint:GET /shop/orders/{id}": None, "iface:Orders:rest_endpoint:POST /shop/orders/": None, "iface:Orders:rest_endpoint:PUT /shop/orders/deep": None,
        "iface:Listener:messaging_consumer:t.*": "t.*", f"iface:Listener:jms_consumer:{W.UNRESOLVED}": W.UNRESOLVED,
    }


def test_no_annotations(spark):
    types, members, annotations = spring(spark)
    for framework in W.COMPONENTS:
        found = W.components(types, members, annotations.limit(0), framework)
        assert W.interfaces(W.entrypoints(found, types, members, annotations.limit(0), framework)).count() == found.count() == 0


def test_placeholders(spark):
    rows = frame(spark, "id int, channel string", (1, "${topic.orders}"), (2, "a-${x}-${topic.orders}-${none}"), (3, "plain"), (4, None))
    config = frame(spark, "key string, value string", ("topic.orders", "orders.v1"), ("x", "y"))
    assert {r.id: r.channel for r in W.placeholders_resolved(rows, "channel", config).collect()} == {1: "orders.v1", 2: "a-y-orders.v1-${none}", 3: "plain", 4: None}
