"""Closures over calls by strides: long chains, cycles and shortcuts, in few rounds."""

from weftgraph.operators import flow

CALLS = "from_id string, from_method string, to_id string, to_method string, call_kind string, capped boolean, ambiguous boolean"


def reached(calls, starts):
    up, out = {}, set()
    for a, b in calls:
        up.setdefault(b, set()).add(a)
    for s in starts:
        seen, front = {s}, {s}
        while front:
            front = {a for b in front for a in up.get(b, ())} - seen
            seen |= front
        out |= {(s, x) for x in seen}
    return out


def made(spark, pairs, starts):
    calls = spark.createDataFrame([(f"c{a}", "m", f"c{b}", "m", "direct", False, False) for a, b in pairs], CALLS)
    at = spark.createDataFrame([(f"c{s}", "m") for s in starts], "component_id string, method string")
    return [(int(r.component_id[1:]), int(r.c[1:])) for r in flow.reaching(at, calls).collect()]


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    pairs = [(i, i + 1) for i in range(37)] + [(0, 9), (5, 30), (37, 33), (4, 4), (50, 51)]
    rounds = []
    add = flow.Parts.add
    monkeypatch.setattr(flow.Parts, "add", lambda self, df: rounds.append(1) or add(self, df))
    got = made(spark, pairs, [37, 51, 99])
    assert sorted(got) == sorted(reached(pairs, [37, 51, 99]))
    assert len(rounds) < 10


def test_dense_calls_keep_a_short_stride(spark):
    pairs = [(i, (i * k + 1) % 60) for i in range(60) for k in range(2, 14)] + [(60 + i, 61 + i) for i in range(9)] + [(3, 60)]
    got = made(spark, pairs, [0, 66, 69])
    assert sorted(got) == sorted(reached(pairs, [0, 66, 69]))
