"""Receivers and call edges on small sources, with the targets that the rules name."""

import pytest

from weftgraph.operators import receivers as Z

TYPES = "id string, component_id string, abstract boolean"
SUPERTYPES = "type string, supertype string, is_class boolean"
FIELDS = "ord long, owner string, name string, declared string, allocated string, elements array<string>, injected string"
LOCALS = "ord long, owner string, method string, name string, allocated string, elements array<string>, iterates string"
METHODS = "owner string, name string"
CALLS = "ord long, owner string, method string, callee string, target string, name string, accessor string, accessor_type string, declared string, arm string, assigned string"


def call(ord_, callee, target=None, name=None, accessor=None, accessor_type=None, declared=None, arm=None, assigned=None, owner="Main", method="run"):
    return (ord_, owner, method, callee, target, name, accessor, accessor_type, declared, arm, assigned)


def component(*names, abstract=()):
    return [(n, n, n in abstract) for n in names]


@pytest.fixture
def facts(spark):
    def make(calls, types, supertypes=(), fields=(), variables=(), methods=()):
        made = [spark.createDataFrame(list(rows), schema) for rows, schema in ((calls, CALLS), (types, TYPES), (supertypes, SUPERTYPES), (fields, FIELDS), (variables, LOCALS), (methods, METHODS))]
        return made

    return make


def targets(made):
    out = {}
    for r in sorted(Z.resolve(*made).collect(), key=lambda r: (r.ord, r.place)):
        out.setdefault(r.ord, []).append((r.type, r.evidence, r.confidence, r.capped))
    return out


def test_ladder_of_ways(facts):
    types = component("Main", "Game", "Player", "Random", "Simple", "Store", abstract=("Player",))
    above = [("Random", "Player", False), ("Simple", "Player", False)]
    fields = [(1, "Main", "game", "Game", "Game", None, None), (2, "Main", "players", "Player", None, ["Random", "Simple"], None), (3, "Main", "store", "Store", None, None, None), (4, "Main", "others", "Player", None, None, None)]
    variables = [(1, "Main", "run", "local", "Game", None, None), (2, "Main", "run", "list", None, ["Simple", "Random"], None), (3, "Main", "run", "each", None, None, "list"), (4, "Main", "run", "one", None, None, "players")]
    methods = [("Store", "cache"), ("Game", "get"), ("Game", "named")]
    calls = [
        call(1, "run", "field", "game"), call(2, "stats", "variable", "local"), call(3, "move", "array", "players"), call(4, "move", "variable", "each"), call(5, "move", "variable", "one"),
        call(6, "put", "call", accessor="cache", accessor_type="lib.Map"), call(7, "work", "call", accessor="cache", accessor_type="lib.Map"), call(8, "work", "call", accessor="get"),
        call(9, "work", "call", accessor="named"), call(10, "read", "call", accessor="open", accessor_type="Player"), call(11, "move", "array", "others"), call(12, "move", "variable", "argument", declared="Store"), call(13, "move", "variable", "unknown"),
    ]
    got = targets(facts(calls, types, above, fields, variables, methods))
    assert got[1] == [("Game", "CONSTRUCTOR_ASSIGNMENT", 0.9, False)]
    assert got[2] == [("Game", "LOCAL_ASSIGNMENT", 0.85, False)]
    assert got[3] == [("Random", "ARRAY_ELEMENT_ALLOCATION", 0.78, False), ("Simple", "ARRAY_ELEMENT_ALLOCATION", 0.78, False)]
    assert got[4] == [("Simple", "COLLECTION_ELEMENT_ALLOCATION", 0.75, False), ("Random", "COLLECTION_ELEMENT_ALLOCATION", 0.75, False)]
    assert [t[0] for t in got[5]] == ["Random", "Simple"]
    assert got[6] == [("Store", "ACCESSOR_STATE_OWNER", 0.6, False)]
    assert 7 not in got and 8 not in got and 13 not in got  # a declared type that tells nothing, a library method, nothing known
    assert got[9] == [("Game", "ACCESSOR_NAME_FALLBACK", 0.2, False)]
    assert got[10] == [("Random", "ACCESSOR_RETURN", 0.8, False), ("Simple", "ACCESSOR_RETURN", 0.8, False)]
    assert [t[:2] for t in got[11]] == [("Random", "SMALL_POLYMORPHIC_EXPANSION"), ("Simple", "SMALL_POLYMORPHIC_EXPANSION")]
    assert got[12] == [("Store", "DECLARED_FIELD_TYPE", 0.85, False)]


def test_closure_cap_and_interfaces(facts):
    many = [f"Impl{i:02d}" for i in range(30)]
    types = [*component("Main", "Concrete", "Base", "Child", "Lonely", *many, abstract=("Lonely",)), ("Middle", None, True)]
    above = [("Concrete", "Middle", True), ("Middle", "Root", False), ("Root", "Middle", False), ("Child", "Base", True), *[(m, "Many", False) for m in many]]
    calls = [call(i, "run", "variable", "x", declared=d) for i, d in enumerate(("Root", "Middle", "Concrete", "Base", "Lonely", "Many", "Nothing"))]
    got = targets(facts(calls, types, above))
    assert [t[0] for t in got[0]] == [t[0] for t in got[1]] == [t[0] for t in got[2]] == ["Concrete"]
    assert [t[:2] for t in got[3]] == [("Base", "DECLARED_FIELD_TYPE"), ("Child", "SMALL_POLYMORPHIC_EXPANSION")]
    assert got[4] == [("Lonely", "DECLARED_INTERFACE_ONLY", 0.55, False)]
    assert [t[0] for t in got[5]] == many[:25] and {t[3] for t in got[5]} == {True}
    assert 6 not in got


def test_edges(facts):
    types = component("Main", "Service", "Other", "Impl")
    above = [("Impl", "Api", False), ("Main", "Parent", True)]
    fields = [(1, "Parent", "service", "Service", None, None, None), (2, "Main", "me", "Main", None, None, None), (3, "Main", "injected", None, None, None, "Api")]
    methods = [("Main", "helper"), ("Main", "run"), ("Other", "named")]
    calls = [
        call(1, "save", "field", "service", assigned="x"), call(2, "save", "field", "service"), call(3, "save", "field", "service", arm="arm:then"), call(4, "helper", "this"), call(5, "run", None),
        call(6, "work", "call", accessor="named", assigned="y"), call(7, "go", "field", "me"), call(8, "fetch", "field", "injected"), call(9, "foreign", None),
    ]
    got = {(r.to_id, r.to_method, r.arm): r for r in Z.call_edges(*facts(calls, types, above, fields, (), methods)).collect()}
    assert set(got) == {("Service", "save", None), ("Service", "save", "arm:then"), ("Main", "helper", None), ("Other", "work", None), ("Impl", "fetch", None)}
    first, armed, guess = got["Service", "save", None], got["Service", "save", "arm:then"], got["Other", "work", None]
    assert (first.evidence, first.confidence, first.killed, first.ambiguous) == ("declared-field-type", 0.85, [], False)
    assert armed.killed == ["x"] and (guess.ambiguous, guess.evidence) == (True, "accessor-name-fallback")
    assert (got["Main", "helper", None].call_kind, got["Main", "helper", None].evidence) == ("intra", None)
    assert got["Impl", "fetch", None].evidence == "legacy-field-read" and got["Impl", "fetch", None].killed == ["x", "y"]


def test_no_facts(facts):
    made = facts([], [])
    assert Z.resolve(*made).count() == Z.call_edges(*made).count() == 0


def test_shared_state(spark):
    fields = spark.createDataFrame([("A", "users", "ConcurrentHashMap"), ("A", "cache", "Object"), ("A", "audit", "AuditStore"), ("A", "log", "Logger"), ("A", "name", "String")], "owner string, name string, type_name string")
    calls = spark.createDataFrame([call(i, m, "field", f, owner="A") for i, (f, m) in enumerate([("users", "put"), ("users", "get"), ("cache", "find"), ("audit", "add"), ("log", "set"), ("name", "get")])], CALLS)
    assert sorted((r.field, r.kind) for r in Z.state_accesses(calls, fields).collect()) == [("cache", "READ"), ("users", "READ"), ("users", "WRITE")]
