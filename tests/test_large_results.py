"""Results that are far larger than their inputs: made once each, by nodes and classes instead of by pairs."""

from itertools import product

from weftgraph.operators import answers, linkers


def node(df):
    """The last step of a plan."""
    return df._jdf.queryExecution().optimizedPlan().nodeName()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_message_pairs_are_not_made_distinct(spark):
    """Sinks with one key come up once; those that repeat with several keys still give each pair once."""
    s = spark.createDataFrame([(f"s{i}", "KAFKA", "t", "c") for i in range(40)] + [("twice", "KAFKA", "t", "c"), ("twice", "JMS", "t", "c"), ("twice", None, "t", "c"), ("loose", None, "t", "c"), ("loose", None, "u", "c")], "id string, broker string, topic string, channel string")
    c = spark.createDataFrame([(f"e{i}", "kafka", "t", "c") for i in range(30)] + [("e0", "JMS", "t", "c")], "entrypoint_id string, broker string, topic string, channel string")
    made = linkers.messaging_links(s, c)
    eps = [f"e{i}" for i in range(30)]
    assert rows(made, "sink_id", "entrypoint_id") == sorted(product([*(f"s{i}" for i in range(40)), "twice", "loose"], eps))
    assert node(made) == "Union"


def test_impact_has_a_row_a_node(spark, monkeypatch):
    """Many starts: frontiers do not grow with their number, and a start's walk to itself alone does not count."""
    edges = [(f"x{i}", f"s{i % 20}") for i in range(30)] + [(f"y{i}", f"x{j}") for i in range(5) for j in range(30)] + [("s0", "y0"), ("lone", "lone"), ("s1", "s2")]
    e, starts = spark.createDataFrame(edges, "src string, dst string"), [f"s{i}" for i in range(20)] + ["lone"]
    want = set()
    for at in starts:
        front = {at}
        for _ in range(3):
            front = {a for a, b in edges if b in front}
            want |= front - {at}
    sizes, write = [], answers.checkpointed

    def counted(df, name):
        out = write(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(answers, "checkpointed", counted)
    assert {r.id for r in answers.impacted_by_each(e, spark.createDataFrame([(s,) for s in starts], "id string"), 3).collect()} == want
    assert "lone" not in want and max(sizes) <= len({a for pair in edges for a in pair})
