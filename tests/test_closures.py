"""Closures whose plan does not grow with their steps, and field reads through them."""

from tests.test_receivers import CALLS, FIELDS, LOCALS, METHODS, SUPERTYPES, TYPES, call, component
from weftgraph.operators import receivers as Z


def test_ancestors_of_long_ways_are_one_scan(spark):
    """A chain with shortcuts and a cycle: the fewest steps to each ancestor, read by one scan."""
    n = 23
    pairs = [(i, i + 1) for i in range(n)] + [(0, 6), (5, 13), (n, 20), (3, 3)]
    up = {}
    for a, b in pairs:
        up.setdefault(a, set()).add(b)
    want = set()
    for start in range(n + 1):
        seen, front, depth = {start}, {start}, 0
        while front:
            depth += 1
            front = {b for a in front for b in up.get(a, ())} - seen
            seen |= front
            want |= {(str(start), str(b), depth) for b in front}
    got = Z.ancestors(spark.createDataFrame([(str(a), str(b), True) for a, b in pairs], SUPERTYPES))
    assert {(r.type, r.ancestor, r.depth) for r in got.collect()} == want and got.count() == len(want)
    assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1


def test_inherited_field_tells_the_component(spark):
    """An untold read goes by the field that the type sees: inherited, and the first of a name."""
    types = component("Base", "Main", "Impl", "Late")
    above = [("Main", "Base", True), ("Impl", "Api", False)]
    fields = [(1, "Base", "api", None, None, None, "Api"), (2, "Main", "twice", "lib:Map", None, None, "Api"), (3, "Main", "twice", None, None, None, "Late")]
    calls = [call(1, "fetch", "field", "api"), call(2, "find", "field", "twice")]
    made = [spark.createDataFrame(rows, schema) for rows, schema in ((calls, CALLS), (types, TYPES), (above, SUPERTYPES), (fields, FIELDS), ([], LOCALS), ([], METHODS))]
    assert sorted((r.to_id, r.to_method, r.evidence) for r in Z.call_edges(*made).collect()) == [("Impl", "fetch", "legacy-field-read"), ("Impl", "find", "legacy-field-read")]
