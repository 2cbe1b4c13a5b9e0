"""Topics and slices: what many roots or slices share is not made again for each."""

import random

from weftgraph.operators import topics as N
from weftgraph.operators import views as V
from weftgraph.sources import store


def test_constants_have_a_row_a_value(spark, monkeypatch):
    """Forty roots lead into one chain with two constants; the last ones lie too far for some."""
    steps = [(f"r{i}", "e0") for i in range(40)] + [(f"e{i}", f"e{i + 1}") for i in range(16)] + [("e3", "e1"), ("e5", "lit")]
    expressions = [(f"e{i}", "other", None, None) for i in range(16)] + [("e16", "literal", "far", None), ("lit", "literal", "near", None)]
    sizes, add, write = [], store.Parts.add, store.checkpointed

    def counted(f):
        def g(*args):
            out = f(*args)
            sizes.append(out.count())
            return out

        return g

    monkeypatch.setattr(store.Parts, "add", counted(add))
    monkeypatch.setattr(store, "checkpointed", counted(write))
    roots = [(f"r{i}",) for i in range(40)] + [("e2",)]
    got = N.constants(*(spark.createDataFrame(rows, schema) for rows, schema in ((roots, "expression string"), (expressions, "id string, kind string, value string, init string"), (steps, "expression string, next string"))))
    assert sorted(map(tuple, got.collect())) == sorted([(f"r{i}", "near") for i in range(40)] + [("e2", "near"), ("e2", "far")])
    assert sum(sizes) - len(steps) <= 2 * (len(expressions) + len(roots))


def test_slices_show_each_edge_once(spark, monkeypatch):
    """Random graph with repeated edges, hubs of many slices and chain nodes, by lists and by joins."""
    r = random.Random(5)
    seg = [(f"s{i % 4}", f"p{i}") for i in range(12)]
    sink = [(f"s{i % 4}", f"k{i}") for i in range(12)]
    edges = [(f"s{i % 4}", f"p{i}", "ORIGINATES") for i in range(12)] + [("chain:1", "p1", "ORIGINATES"), ("p1", "p5", "WORKFLOW_LINK"), ("k9", "p1", "LINKS_TO"), ("p3", "p7", "HAS_SEGMENT")]
    edges += [(f"p{i}", f"k{i + d}", "REACHES") for i in range(12) for d in (0, 4) if i + d < 12]
    edges += [(f"k{i}", f"c{r.randrange(6)}", "AT_COMPONENT") for i in range(8)] + [(f"c{r.randrange(6)}", f"c{r.randrange(8)}", "CALLS") for _ in range(40)] + [("c0", "s1", "STARTS_AT"), ("k1", "chain:2", "ON_FIELD")]
    edges = [(*e, i % 50) for i, e in enumerate(edges + edges[:30])]
    inside, of = set(seg), set(sink)
    picked = {(s, a, b) for a, b, label, _ in edges for s in ("s0", "s1", "s2", "s3") if (label == "ORIGINATES" and (s, b) in inside) or (label == "REACHES" and (s, a) in inside and (s, b) in of) or (label == "LINKS_TO" and (s, a) in of and (s, b) in inside) or (label in ("AT_COMPONENT", "ON_FIELD") and (s, a) in of)}
    ids = inside | {(s, n) for s, a, b in picked for n in (a, b)}
    want = sorted({(s, a, b, label, o) for a, b, label, o in edges for s in ("s0", "s1", "s2", "s3") if (s, a) in ids and (s, b) in ids and label != "HAS_SEGMENT" and not a.startswith("chain:") and not b.startswith("chain:")})
    made = [spark.createDataFrame(rows, schema) for rows, schema in ((seg, "slice string, id string"), (sink, "slice string, id string"), (edges, "src string, dst string, label string, ord int"))]
    for wide in (100, 1):
        monkeypatch.setattr(V, "WIDE", wide)
        got = V.project_pipeline(*made)
        assert sorted(map(tuple, got.collect())) == want
        assert got._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
