"""Condensation through long chains and cycles of hidden components."""

from weftgraph.operators import traverse


def test_long_hidden_chain_and_cycle(spark):
    hidden = [f"u{i}" for i in range(13)]
    way = ["a", *hidden, "b"]
    pairs = [*zip(way, way[1:]), ("u12", "u0"), ("b", "u12")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    comps = spark.createDataFrame([("a", "SERVICE"), ("b", "SERVICE"), *((u, "UTILITY") for u in hidden)], "id string, type string")
    assert {tuple(r) for r in traverse.condense(e, comps).collect()} == {("a", "b")}


def test_many_classes_of_hidden_components(spark, monkeypatch):
    """Random graphs against a search from each component; no table holds the pairs before they are the result."""
    import random

    sizes, write = [], traverse.checkpointed

    def counted(df, name):
        out = write(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(traverse, "checkpointed", counted)
    for seed, degree in ((1, 1), (2, 2)):
        pick = random.Random(seed)
        names = [f"n{i}" for i in range(90)]
        hidden = {n for n in names if pick.random() < 0.25}
        pairs = [(pick.choice(names), pick.choice(names)) for _ in range(90 * degree)] + [("n0", "n0"), ("gone", "n1")]
        # two cycles of hidden ones between many sources and many ends
        pairs += [("u0", "u1"), ("u1", "u0"), ("u2", "u3"), ("u3", "u2"), ("u1", "u2"), *((n, "u0") for n in names[:60]), *(("u3", n) for n in names)]
        hidden |= {"u0", "u1", "u2", "u3"}
        want = {(a, b) for a, b in pairs if a == b and a in names and a not in hidden}
        for n in set(names) - hidden:
            seen, front = set(), {n}
            while front:
                near = {b for a, b in pairs if a in front} - seen
                seen |= near
                front = near & hidden
            want |= {(n, b) for b in seen - hidden - {n}}
        types = [(n, "UTILITY" if n in hidden else "SERVICE") for n in [*names, "u0", "u1", "u2", "u3"]]
        found = [tuple(r) for r in traverse.condense(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame(types, "id string, type string")).collect()]
        assert len(found) == len(set(found)) and set(found) == want
        assert max(sizes) < len(want) / 2
