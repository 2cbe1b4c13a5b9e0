"""Traversal: bounded paths, reachability, impact, closure, slices, condensation.

Frontiers are deduplicated at every hop, so a walk costs edges times hops and not the number of walks;
only path enumeration carries arrays.  Loops are bounded by depth; unbounded ones end when a hop
adds nothing and cut their lineage in `spark.checkpoint.dir`.

`edges` is a relation, or a stored graph (`sources.adjacency`), of which a hop reads the buckets of its frontier.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.limits import depth_limit
from weftgraph.operators.linkers import spread
from weftgraph.operators.scan import edges_between
from weftgraph.sources.adjacency import Adjacency
from weftgraph.sources.store import checkpointed

#: What leads on from an entrypoint (fixed values).
ENTRYPOINT_EDGES = (
    "STARTS_AT", "CALLS", "DEPENDS_ON", "VISITS", "ORIGINATES", "REACHES", "LINKS_TO", "WORKFLOW_LINK", "WRITES_STATE", "READS_STATE", "STATE_HANDOFF", "ON_FIELD", "AT_COMPONENT", "HAS_SEGMENT",
    "USES_PERSISTENCE_UNIT", "USES_DATASOURCE", "MANAGES_ENTITY", "USES_TRANSACTION_POLICY", "HAS_TRANSACTION_BOUNDARY", "GOVERNS_OPERATION", "PERFORMS_PERSISTENCE_OPERATION", "OPERATES_ON_ENTITY", "CONNECTS_TO", "CONFIGURED_BY",
)


@dataclass
class PlanLog:
    """What a query asked of the graph: one row for each operation, with the rows it made, counted as they were written."""

    rows: list[tuple] = field(default_factory=list)

    def watch(self, df: DataFrame, operation: str, hop: int, detail: str, name: str) -> DataFrame:
        """Write `df` to a table and note how many rows it had."""
        from pyspark.sql import Observation

        seen = Observation(f"{operation}-{len(self.rows)}")
        out = checkpointed(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        self.rows.append((len(self.rows), operation, hop, detail, int(seen.get["n"])))
        return out

    def relation(self, spark) -> DataFrame:
        """step, operation, hop, detail, n."""
        return spark.createDataFrame(self.rows, "step int, operation string, hop int, detail string, n long")


def _directed(edges: DataFrame, direction: str, labels: tuple[str, ...]) -> DataFrame:
    """a -> b steps in the direction asked for; parallel edges give parallel steps."""
    e = edges.where(F.lower("label").isin(*(x.lower() for x in labels))) if labels else edges
    out, into = e.select(F.col("src").alias("a"), F.col("dst").alias("b")), e.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    steps = {"out": out, "outgoing": out, "in": into, "incoming": into}.get(direction.lower())
    return out.union(into) if steps is None else steps


def _meet(edges: DataFrame | Adjacency, front: DataFrame, direction: str, labels: tuple[str, ...]) -> DataFrame:
    """a, b of the steps from a frontier (column id)."""
    if isinstance(edges, Adjacency):
        return edges.steps(front, direction, labels)
    return front.select("id").join(_directed(edges, direction, labels), F.col("id") == F.col("a"))


def hops(edges: DataFrame | Adjacency, start: DataFrame, direction: str, labels: tuple[str, ...], depth: int, log: PlanLog | None = None) -> DataFrame:
    """id, hop: every node that a walk of 1 to depth steps from `start` (column id) ends at, with the fewest steps.

    The frontier meets the edges before anything is made distinct, so a hop shuffles what it reaches and
    not the graph; each frontier is a table, so the plan does not grow with the depth.
    """
    seen = None
    front = start.select("id").distinct()
    for hop in range(1, depth + 1):
        reached = _meet(edges, front, direction, labels).select(F.col("b").alias("id")).distinct()
        if seen is not None:
            reached = reached.join(seen, "id", "left_anti")
        reached = reached.withColumn("hop", F.lit(hop))
        if log is not None:
            reached = log.watch(reached, "hop", hop, f"{direction} {','.join(labels) or '*'}", "hop")
        elif hop < depth:
            reached = checkpointed(reached, "hop")
        seen = reached if seen is None else seen.union(reached)
        front = reached.select("id")
    return seen


def ways_back(edges: DataFrame | Adjacency, target: DataFrame, depth: int) -> DataFrame:
    """id, hop, next, label, ord: every node with a walk to the target, the fewest steps, and the first edge of such a walk that is first in the graph."""
    seen = front = target.select("id", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("next"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("bigint").alias("ord"))
    seen = front = checkpointed(front, "ways")
    for hop in range(1, depth + 1):
        if isinstance(edges, Adjacency):
            met = edges.steps(front, "in")
        else:
            met = front.select(F.col("id").alias("a")).join(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "label", "ord"), "a")
        best = met.groupBy(F.col("b").alias("id")).agg(F.min(F.struct("ord", "label", F.col("a").alias("next"))).alias("e")).join(seen.select("id"), "id", "left_anti")
        front = checkpointed(best.select("id", F.lit(hop).alias("hop"), "e.next", "e.label", "e.ord"), "ways")
        seen = seen.unionByName(front)
    return seen


def evidence_paths(ways: DataFrame, most: int = 50) -> DataFrame:
    """node_ids, edge_labels: a shortest way to the target of each of the `most` nearest nodes, by hops and id.  ways: of `ways_back`.

    Each way follows one pointer a step, so nothing is enumerated; `most` is the rule's own limit.
    """
    walk = checkpointed(ways.where("hop > 0").orderBy("hop", "id").limit(most).select("id", "hop", F.array("id").alias("node_ids"), F.array().cast("array<string>").alias("edge_labels")), "walk")
    depth = walk.agg(F.max("hop")).first()[0] or 0  # a depth, not rows
    step = ways.where("hop > 0").select("id", "next", "label")
    for _ in range(depth):
        on = walk.join(step, "id", "left")
        walk = on.select(F.coalesce("next", "id").alias("id"), "hop", F.when(F.col("next").isNull(), F.col("node_ids")).otherwise(F.array_append("node_ids", F.col("next"))).alias("node_ids"), F.when(F.col("next").isNull(), F.col("edge_labels")).otherwise(F.array_append("edge_labels", F.col("label"))).alias("edge_labels"))
    return walk.select("node_ids", "edge_labels")


def entrypoint_reachable(nodes: DataFrame, edges: DataFrame | Adjacency) -> DataFrame:
    """id, label, entrypoint_reachable of every node: does a way over ENTRYPOINT_EDGES lead there from any entrypoint?  All are followed at once."""
    found = closure(edges, nodes.where("label = 'Entrypoint'"), "out", ENTRYPOINT_EDGES).withColumn("hit", F.lit(True))
    return nodes.select("id", "label").join(found, "id", "left").select("id", "label", F.coalesce("hit", F.lit(False)).alias("entrypoint_reachable"))


def reachable(edges: DataFrame | Adjacency, start: DataFrame, direction: str = "out", label: str | None = None, depth: int | None = None) -> DataFrame:
    """Nodes reached; the start itself too if a walk returns to it.  Depth 1 by default, at most 10."""
    return hops(edges, start, direction, (label,) if label else (), depth_limit(depth, 1, 10))


def impacted_by(edges: DataFrame | Adjacency, target: DataFrame, depth: int | None = None, log: PlanLog | None = None) -> DataFrame:
    """Nodes with a walk to the target, without the target.  Depth 3 by default, at most 8."""
    return hops(edges, target, "in", (), depth_limit(depth, 3, 8), log).join(target.select("id"), "id", "left_anti")


def paths(edges: DataFrame | Adjacency, start: str, end: str, depth: int | None = None) -> DataFrame:
    """node_ids and edge_labels of every simple directed path of 1 to depth edges; parallel edges count each.

    The search is pruned from the end: a hop is taken only to nodes from which the end is near enough,
    so only beginnings of real answers are enumerated.
    """
    depth = depth_limit(depth, 5, 8)
    spark = edges.spark if isinstance(edges, Adjacency) else edges.sparkSession
    near = hops(edges, spark.createDataFrame([(end,)], "id string"), "in", (), depth - 1) if depth > 1 else None
    useful = spark.createDataFrame([(end, 0)], "id string, hop int")
    if near is not None:
        useful = useful.union(near.where(F.col("id") != end))
    # the edges that can lie on an answer, written once: every hop reads this table and not the graph
    useful = checkpointed(useful, "useful")
    into = edges.steps(useful, "in").select(F.col("b").alias("src"), F.col("a").alias("id"), "label", "ord") if isinstance(edges, Adjacency) else edges.select("src", F.col("dst").alias("id"), "label", "ord")
    steps = checkpointed(into.select("src", "id", F.col("label").alias("l"), "ord").join(useful, "id"), "useful")
    front = spark.createDataFrame([([start], [])], "node_ids array<string>, edge_labels array<string>")
    done = None
    for hop in range(1, depth + 1):
        front = (
            front.withColumn("src", F.element_at("node_ids", -1))
            .join(steps.where(F.col("hop") <= depth - hop), "src")
            .where(~F.array_contains("node_ids", F.col("id")))
            .select(F.array_append("node_ids", F.col("id")).alias("node_ids"), F.array_append("edge_labels", F.col("l")).alias("edge_labels"))
        )
        found = front.where(F.element_at("node_ids", -1) == end)
        done = found if done is None else done.union(found)
        front = front.where(F.element_at("node_ids", -1) != end)
    return done


def closure(edges: DataFrame | Adjacency, start: DataFrame, direction: str = "out", labels: tuple[str, ...] = ()) -> DataFrame:
    """Everything reachable from `start`, the start included, to a fixpoint."""
    seen = checkpointed(start.select("id").distinct(), "seen")
    front = seen
    while True:
        front = checkpointed(_meet(edges, front, direction, labels).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti"), "front")
        if front.isEmpty():
            return seen
        seen = seen.union(front)


def dependency_closure(dependencies: DataFrame, root: DataFrame, depth: int) -> DataFrame:
    """Edges among the root and what it depends on within depth, without self loops."""
    around = reachable(dependencies, root, "out", "DEPENDS_ON", depth).select("id").union(root.select("id"))
    return edges_between(dependencies, around, ("DEPENDS_ON",), whole=False).where("src <> dst")


def dependency_slice(dependencies: DataFrame, root: DataFrame, depth: int) -> DataFrame:
    """Out-edges of nodes fewer than depth hops away: the last frontier shows, what lies behind it does not."""
    inner = root.select("id")
    if depth > 1:
        inner = inner.union(hops(dependencies, root, "out", ("DEPENDS_ON",), depth - 1).select("id")).distinct()
    return dependencies.join(inner, F.col("src") == F.col("id"), "left_semi").select("src", "dst").distinct()


def condense(dependencies: DataFrame, components: DataFrame, hidden: tuple[str, ...] = ("UTILITY", "UNKNOWN")) -> DataFrame:
    """src, dst among components that are not hidden, joined through chains of hidden ones; no new self loops.

    The pairs can be nearly all there are, so they are made once and not searched for by pair: hidden
    components are followed to their ends among themselves, those that reach each other are one class with one
    set of ends, and a component takes the ends of its largest class and, apart, what its other classes and its
    own edges add to them.
    """
    kind = components.select("id", F.col("type").isin(*hidden).alias("hide"))
    e = dependencies.select("src", "dst").distinct()
    e = e.join(kind.select(F.col("id").alias("src"), F.col("hide").alias("hs")), "src").join(kind.select(F.col("id").alias("dst"), F.col("hide").alias("hd")), "dst")
    e = checkpointed(e.distinct(), "condense")
    on = e.where("hs").select(F.col("src").alias("mid"), "dst", "hd")
    inner = on.select("mid").distinct()  # a hidden component that leads nowhere ends a chain
    step = checkpointed(on.where("hd").select("mid", F.col("dst").alias("next")).join(inner.select(F.col("mid").alias("next")), "next", "left_semi"), "condense")
    seen = front = checkpointed(inner.select(F.col("mid").alias("start"), "mid"), "condense")
    while True:
        further = front.join(step, "mid").select("start", F.col("next").alias("mid")).distinct()
        front = checkpointed(further.join(seen, ["start", "mid"], "left_anti"), "condense")
        if front.isEmpty():
            break
        seen = seen.union(front)
    back = seen.select(F.col("mid").alias("start"), F.col("start").alias("mid"))
    classes = checkpointed(seen.join(back, ["start", "mid"]).groupBy("start").agg(F.min("mid").alias("class")), "condense")
    within = checkpointed(seen.join(classes.where("start = class").select("start"), "start", "left_semi").select(F.col("start").alias("class"), "mid"), "condense")
    ends = checkpointed(within.join(on.where("not hd").select("mid", "dst"), "mid").select("class", "dst").distinct(), "condense")

    sizes = ends.groupBy("class").agg(F.count("*").alias("n"))
    visible = e.where("not hs")
    into = visible.where("hd").select("src", F.col("dst").alias("start")).join(classes, "start").select("src", "class").distinct().join(sizes, "class")
    into = checkpointed(into.select("src", "class", "n"), "condense")
    base = checkpointed(into.groupBy("src").agg(F.max(F.struct("n", "class")).alias("b")).select("src", F.col("b.class").alias("base")), "condense")
    other = into.join(base, "src").where("class <> base").select("src", "base", "class")
    reached = within.select(F.col("class").alias("base"), F.col("mid").alias("class"))
    of_base = ends.select(F.col("class").alias("base"), "dst")
    added = other.select("base", "class").distinct().join(reached, ["base", "class"], "left_anti").join(ends, "class").join(of_base, ["base", "dst"], "left_anti")
    direct = visible.where("not hd").select("src", "dst")
    beside = direct.join(base, "src", "left").join(of_base, ["base", "dst"], "left_anti").select("src", "dst")
    more = other.join(added, ["base", "class"]).select("src", "dst").union(beside).where("src <> dst").distinct()
    most = spread(base, of_base, ["base"]).where("src <> dst").select("src", "dst")
    return most.union(more).union(direct.where("src = dst").distinct())
