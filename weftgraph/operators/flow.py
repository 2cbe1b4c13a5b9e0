"""Flows over method-level calls: runtime flows, call chains, traced names and the sinks they reach.

Calls have ord, from_id, from_method, to_id, to_method, call_kind, capped, ambiguous and, for traced names,
arg and param (the one name that is mapped), killed, receiver, literal and literal_value, control,
branch_group, branch_label.  Walks are simple ways of bounded depth, as the rules ask for: a frontier of
rows that carry their way, one table a hop.  Their number grows with branching, not with the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.linkers import spread
from weftgraph.operators.policy import can_traverse_inline, is_sink_call, sink_kind, visible_ids
from weftgraph.sources.store import Parts, checkpointed

#: Calls are expanded at depths 0 to 5, names traced to depth 8 (fixed values).
FLOW_DEPTH = 5
TRACE_DEPTH = 8


def entrypoint_via() -> Column:
    """How an entrypoint is reached: its channel, else method and path, else the path, else its type."""
    return F.when(F.col("channel").isNotNull(), F.col("channel")).when(F.col("http_method").isNotNull() & F.col("path").isNotNull(), F.concat_ws(" ", "http_method", "path")).otherwise(F.coalesce("path", F.lower("type"), F.lit("trigger")))


def _key(component: Column, method: Column) -> Column:
    return F.concat_ws("#", component, method)


def visits(entrypoints: DataFrame, calls: DataFrame, components: DataFrame, depth: int = FLOW_DEPTH) -> DataFrame:
    """Every arrival of a walk at a method: e, c, m, via, source and source_method (last visible component before and the calling method), trail (ordinals of the calls).

    A method on the way is arrived at again but not expanded again.  Hidden components are passed through.
    """
    shown = visible_ids(components).select(F.col("id").alias("c"), F.lit(True).alias("shown"))
    steps = calls.where(can_traverse_inline()).select(F.col("from_id").alias("c"), F.col("from_method").alias("m"), F.col("to_id").alias("next_c"), F.col("to_method").alias("next_m"), F.col("ord").alias("step"))
    front = entrypoints.select(F.col("id").alias("e"), F.col("component_id").alias("c"), F.col("method").alias("m"), entrypoint_via().alias("via"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("source_method"), F.array().cast("array<bigint>").alias("trail"), F.array(_key(F.col("component_id"), F.col("method"))).alias("keys"), F.lit(False).alias("again"))
    out = None
    for _ in range(depth + 2):
        front = checkpointed(front.join(shown, "c", "left").withColumn("shown", F.coalesce("shown", F.lit(False))), "visits")
        out = front if out is None else out.unionByName(front)
        key = _key(F.col("next_c"), F.col("next_m"))
        front = front.where("not again").join(steps, ["c", "m"]).select(
            "e", F.col("next_c").alias("c"), F.col("next_m").alias("m"), F.col("next_m").alias("via"), F.when(F.col("shown"), F.col("c")).otherwise(F.col("source")).alias("source"), F.col("m").alias("source_method"),
            F.array_append("trail", F.col("step")).alias("trail"), F.array_append("keys", key).alias("keys"), F.array_contains("keys", key).alias("again"),
        )
    return out.select("e", "c", "m", "via", "source", "source_method", "trail", "shown")


def flow_steps(arrivals: DataFrame) -> DataFrame:
    """entrypoint_id, position, component_id, via, method: visible components in the order of their first way, by call order."""
    first = arrivals.where("shown").groupBy("e", "c").agg(F.min(F.struct("trail", "via", "m")).alias("f"))
    number = F.row_number().over(Window.partitionBy("e").orderBy("f.trail")) - 1
    return first.select(F.col("e").alias("entrypoint_id"), number.cast("long").alias("position"), F.col("c").alias("component_id"), "f.via", F.col("f.m").alias("method"))


def flow_edges(arrivals: DataFrame) -> DataFrame:
    """entrypoint_id, from_id, to_id, via: every visible component that calls a visible one, also one met before."""
    return arrivals.where("shown and source is not null").select(F.col("e").alias("entrypoint_id"), F.col("source").alias("from_id"), F.col("c").alias("to_id"), "via").distinct()


def call_lines(arrivals: DataFrame, components: DataFrame) -> DataFrame:
    """entrypoint_id, line: `A.m -> B.n` of visible calls; a hidden component's calls hang on the last visible one."""
    name = components.select("id", "name")
    x = arrivals.where("shown and source is not null").select("e", "source", "source_method", "c", "m").distinct()
    x = x.join(name.select(F.col("id").alias("source"), F.col("name").alias("a")), "source").join(name.select(F.col("id").alias("c"), F.col("name").alias("b")), "c")
    return x.select(F.col("e").alias("entrypoint_id"), F.concat("a", F.lit("."), "source_method", F.lit(" -> "), "b", F.lit("."), "m").alias("line")).distinct()


def dependency_flow(entrypoints: DataFrame, dependencies: DataFrame, components: DataFrame, depth: int = FLOW_DEPTH) -> DataFrame:
    """entrypoint_id, component_id, hop without any calls: visible components that dependencies reach within depth.

    Walks start from components, not from the entrypoints that share them; only what is shown is joined with these.
    """
    steps = dependencies.select(F.col("src").alias("at"), F.col("dst").alias("component_id")).distinct()
    begins = entrypoints.select(F.col("id").alias("entrypoint_id"), F.col("component_id").alias("begin")).where("begin is not null").distinct()
    seen = front = begins.select("begin", F.col("begin").alias("component_id"), F.lit(0).alias("hop")).distinct()
    for hop in range(1, depth + 1):
        front = front.select("begin", F.col("component_id").alias("at")).join(steps, "at").select("begin", "component_id").distinct().join(seen, ["begin", "component_id"], "left_anti").withColumn("hop", F.lit(hop))
        front = checkpointed(front, "flow")
        seen = seen.unionByName(front)
    shown = seen.join(visible_ids(components).withColumnRenamed("id", "component_id"), "component_id", "left_semi")
    found = spread(shown, begins.withColumn("n", F.count("*").over(Window.partitionBy("entrypoint_id"))), ["begin"])
    cols = ["entrypoint_id", "component_id", "hop"]
    several = found.where("n > 1").groupBy("entrypoint_id", "component_id").agg(F.min("hop").alias("hop"))  # an id with several components
    return found.where("n = 1").select(cols).unionByName(several.select(cols))


# ---- traced names


def _targets(calls: DataFrame, components: DataFrame) -> DataFrame:
    kind = components.select(F.col("id").alias("to_id"), "type", "stereotype")
    return calls.join(kind, "to_id", "left").withColumn("leaves", is_sink_call())


def with_names(calls: DataFrame) -> DataFrame:
    """Calls with `mapping`, from names at the call to names in the method, and `kills`, names that were overwritten before.

    Either column may be there already; else it comes from arg and param, and from killed: one name each.
    """
    if "mapping" not in calls.columns:
        one = F.when(F.col("arg").isNotNull() & F.col("param").isNotNull(), F.create_map("arg", "param"))
        calls = calls.withColumn("mapping", F.coalesce(one, F.create_map().cast("map<string,string>")))
    if "kills" not in calls.columns:
        calls = calls.withColumn("kills", F.array_compact(F.array("killed")))
    return calls


def _killed(x: Column) -> Column:
    return F.coalesce(F.array_contains("kills", x["now"]), F.lit(False))


def _renamed() -> tuple[Column, Column]:
    """Does a call map a tracked name, and what becomes of the names: (now, first) pairs.

    `*` passes.  A killed name stops.  If the call maps any tracked name, names it does not map stop too;
    if it maps nothing at all and its receiver is another local, they stop as well; else they carry on.
    """
    n = "names"
    mapped = lambda x: F.coalesce(F.map_contains_key("mapping", x["now"]), F.lit(False))
    maps_any = F.exists(n, lambda x: (x["now"] != "*") & mapped(x))
    elsewhere = lambda x: (F.size("mapping") == 0) & F.col("receiver").isNotNull() & (F.col("receiver") != x["now"])
    kept = F.filter(n, lambda x: (x["now"] == "*") | ~(_killed(x) | (F.col("maps_any") & ~mapped(x)) | (~mapped(x) & elsewhere(x))))
    return maps_any, F.transform(kept, lambda x: F.struct(F.when(mapped(x) & (x["now"] != "*"), F.try_element_at("mapping", x["now"])).otherwise(x["now"]).alias("now"), x["first"].alias("first")))


#: Entrypoints that start from state as well as from their parameters (fixed values).
STATEFUL_STARTS = ("MESSAGING_PRODUCER", "SCHEDULER")


def tracked_names(entrypoints: DataFrame, parameters: DataFrame, reads: DataFrame, calls: DataFrame) -> DataFrame:
    """ord, entrypoint_id, name: what is followed from each entrypoint, each name once.

    entrypoints: id, component_id, method, type.  parameters: entrypoint_id, ord, name.  reads: of `read_names`.
    calls: from_id, from_method, ord, assigned (null unless a local gets the result and the callee returns what it
    was given).  The parameters, or `*` where there are none; the fields read, where there are none or the
    entrypoint starts from state; the locals that get results in its own method.
    """
    at = entrypoints.select(F.col("id").alias("entrypoint_id"), "component_id", "method", F.coalesce(F.col("type").isin(*STATEFUL_STARTS), F.lit(False)).alias("stateful"))
    own = parameters.select("entrypoint_id", F.lit(0).alias("k"), F.col("ord").cast("long").alias("o"), "name")
    without = at.join(own.select("entrypoint_id"), "entrypoint_id", "left_anti").select("entrypoint_id")
    every = without.select("entrypoint_id", F.lit(0).alias("k"), F.lit(0).cast("long").alias("o"), F.lit("*").alias("name"))
    by_field = at.where("stateful").select("entrypoint_id").unionByName(without).distinct().join(reads, "entrypoint_id").select("entrypoint_id", F.lit(1).alias("k"), F.lit(0).cast("long").alias("o"), F.col("field").alias("name"))
    results = calls.where("assigned is not null").select(F.col("from_id").alias("component_id"), F.col("from_method").alias("method"), "ord", "assigned")
    by_result = at.join(results, ["component_id", "method"]).select("entrypoint_id", F.lit(2).alias("k"), F.col("ord").cast("long").alias("o"), F.col("assigned").alias("name"))
    some = own.unionByName(every).unionByName(by_field).unionByName(by_result).where("name is not null")
    first = some.groupBy("entrypoint_id", "name").agg(F.min(F.struct("k", "o")).alias("place"))
    number = F.row_number().over(Window.partitionBy("entrypoint_id").orderBy("place", "name")) - 1
    return first.select(number.cast("long").alias("ord"), "entrypoint_id", "name")


def trace(entrypoints: DataFrame, tracked: DataFrame, calls: DataFrame, components: DataFrame, depth: int = TRACE_DEPTH) -> DataFrame:
    """Every method that tracked names are carried into: e, c, m, names, keys, d, caller, caller_method, literal, literal_value.

    The names of an entrypoint travel together, as a call that maps one of them stops the others.
    """
    names = tracked.groupBy("entrypoint_id").agg(F.sort_array(F.collect_list(F.struct("ord", "name"))).alias("n")).select(F.col("entrypoint_id").alias("id"), F.transform("n", lambda x: F.struct(x["name"].alias("now"), x["name"].alias("first"))).alias("names"))
    none = F.lit(None).cast("string")
    front = entrypoints.join(names, "id").select(F.col("id").alias("e"), F.col("component_id").alias("c"), F.col("method").alias("m"), "names", F.array(_key(F.col("component_id"), F.col("method"))).alias("keys"), F.lit(0).alias("d"), none.alias("caller"), none.alias("caller_method"), none.alias("literal"), none.alias("literal_value"))
    steps = _targets(with_names(calls), components).where(can_traverse_inline() & ~F.col("leaves"))
    steps = steps.select(F.col("from_id").alias("c"), F.col("from_method").alias("m"), "to_id", "to_method", "mapping", "kills", "receiver", F.col("literal").alias("l"), F.col("literal_value").alias("lv"))
    maps_any, renamed = _renamed()
    out = None
    for hop in range(depth + 1):
        front = checkpointed(front.distinct(), "trace")  # parallel calls that do the same arrive once
        out = front if out is None else out.unionByName(front)
        key = _key(F.col("to_id"), F.col("to_method"))
        x = front.join(steps, ["c", "m"]).where(~F.array_contains("keys", key)).withColumn("maps_any", maps_any).withColumn("next", renamed).where(F.size("next") > 0)
        front = x.select("e", F.col("to_id").alias("c"), F.col("to_method").alias("m"), F.col("next").alias("names"), F.array_append("keys", key).alias("keys"), F.lit(hop + 1).alias("d"), F.col("c").alias("caller"), F.col("m").alias("caller_method"), F.col("l").alias("literal"), F.col("lv").alias("literal_value"))
    return out


def trace_steps(states: DataFrame) -> DataFrame:
    """entrypoint_id, tracked, component_id, method, local_name, depth (the least) of the steps of each path."""
    x = states.select("e", "c", "m", "d", F.explode("names").alias("n"))
    return x.groupBy(F.col("e").alias("entrypoint_id"), F.col("n.first").alias("tracked"), F.col("c").alias("component_id"), F.col("m").alias("method"), F.col("n.now").alias("local_name")).agg(F.min("d").alias("depth"))


SINK = ("entrypoint_id", "tracked", "kind", "component_id", "method", "channel", "owner_id", "field", "caller_id")


def _sink(x: DataFrame, tracked: Column, kind: Column, component: Column, method: Column, channel: Column | None = None, owner: Column | None = None, field: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    cols = (F.col("e"), tracked, kind, component, method, none if channel is None else channel, none if owner is None else owner, none if field is None else field, F.col("c"))
    return x.select(*(c.alias(n) for c, n in zip(cols, SINK)))


def outbound_sinks(states: DataFrame, sites: DataFrame) -> DataFrame:
    """Sites in a traced method; one that counts for one caller only if that caller led here.  A literal argument replaces the name it stands for."""
    s = sites.select(F.col("component_id").alias("c"), F.col("method").alias("m"), "kind", "topic", "channel", "only_component", "only_method")
    x = states.join(s, ["c", "m"])
    x = x.where(F.col("only_component").isNull() | (F.coalesce(F.col("caller") == F.col("only_component"), F.lit(False)) & (F.col("only_method").isNull() | F.coalesce(F.col("caller_method") == F.col("only_method"), F.lit(False)))))
    spelled = lambda name: F.when(F.coalesce(F.col(name) == F.col("literal"), F.lit(False)), F.col("literal_value")).otherwise(F.col(name))
    blank = lambda v: F.when(F.trim(v) != "", v)
    x = x.withColumn("n", F.explode("names"))
    return _sink(x, F.col("n.first"), F.col("kind"), F.col("c"), F.col("m"), F.coalesce(blank(spelled("topic")), spelled("channel"))).distinct()


def field_write_sinks(states: DataFrame, accesses: DataFrame) -> DataFrame:
    """Writes in the entrypoint's own body with a named parameter, from a tracked name, or from something that can't be resolved."""
    w = accesses.where("kind = 'WRITE'").select(F.col("component_id").alias("c"), F.col("method").alias("m"), "owner_id", "field", "source_var", "source_field", "key_var")
    x = states.join(w, ["c", "m"]).withColumn("n", F.explode("names"))
    now = F.col("n.now")
    same = lambda c: F.coalesce(now == F.col(c), F.lit(False))
    named = now != "*"
    emits = named & ((F.col("d") == 0) | same("source_var") | same("source_field") | same("key_var") | (F.col("source_var").isNull() & F.col("source_field").isNull()))
    return _sink(x.where(emits), F.col("n.first"), F.lit("STORE"), F.col("owner_id"), F.col("field"), None, F.col("owner_id"), F.col("field")).distinct()


def call_sinks(states: DataFrame, calls: DataFrame, components: DataFrame) -> DataFrame:
    """Calls that leave the traced code, for every tracked name that they do not kill."""
    s = _targets(with_names(calls), components).where("leaves").select(F.col("from_id").alias("c"), F.col("from_method").alias("m"), "to_id", "to_method", "kills", sink_kind(F.col("call_kind"), F.col("type"), F.col("stereotype")).alias("kind"))
    x = states.join(s, ["c", "m"]).withColumn("n", F.explode("names")).where((F.col("n.now") == "*") | ~_killed(F.col("n")))
    return _sink(x, F.col("n.first"), F.col("kind"), F.col("to_id"), F.col("to_method")).distinct()


def data_flow_sinks(states: DataFrame, calls: DataFrame, components: DataFrame, accesses: DataFrame, sites: DataFrame) -> DataFrame:
    return outbound_sinks(states, sites).unionByName(field_write_sinks(states, accesses)).unionByName(call_sinks(states, calls, components)).distinct()


#: Ways of two strides, as a multiple of the steps, beyond which a stride is not doubled.
NEAR = 8


def _within(steps: DataFrame) -> tuple[DataFrame, int | None]:
    """a, b, more: the pairs within a stride and the fewest steps between them; the stride, or none if nothing lies beyond it.

    A stride is doubled while the ways of two, counted before they are made, are few for the steps there are.
    What lies beyond k steps leads through a pair that is k steps apart.
    """
    near, stride, most = steps.withColumn("more", F.lit(1)), 1, NEAR * steps.count()
    while True:
        edge = near.where(F.col("more") == stride).select("a", F.col("b").alias("via"))
        onward = near.select(F.col("a").alias("via"), "b", (F.col("more") + stride).alias("more"))
        ways = edge.groupBy("via").agg(F.count("*").cast("double").alias("i")).join(onward.groupBy("via").agg(F.count("*").alias("o")), "via").agg(F.sum(F.col("i") * F.col("o"))).first()[0]
        if ways is None:
            return near, None
        if ways > most:
            return near, stride
        beyond = edge.join(onward, "via").where("a <> b").select("a", "b", "more")
        near, stride = checkpointed(near.unionByName(beyond).groupBy("a", "b").agg(F.min("more").alias("more")), "near"), stride * 2


def reaching(locations: DataFrame, calls: DataFrame) -> DataFrame:
    """component_id, method (of `locations`), c, m: methods from which inline calls reach each location, to a fixpoint.

    Backwards from the few locations asked for, not forwards from every entrypoint.  Methods are numbered by a
    stored table, so that frontiers are pairs of numbers; names are joined to what was found.  A round goes a stride
    of steps, so long chains of calls take few rounds; all rounds are read by one scan.
    """
    back = calls.where(can_traverse_inline()).select(F.col("to_id").alias("c"), F.col("to_method").alias("m"), F.col("from_id").alias("next_c"), F.col("from_method").alias("next_m")).distinct()
    start = locations.select("component_id", "method").distinct()
    every = start.toDF("c", "m").unionByName(back.select("c", "m")).unionByName(back.select(F.col("next_c").alias("c"), F.col("next_m").alias("m")))
    named = checkpointed(every.where("c is not null and m is not null").distinct().withColumn("n", F.monotonically_increasing_id()), "methods")
    steps = back.join(named.withColumnRenamed("n", "a"), ["c", "m"]).join(named.select(F.col("c").alias("next_c"), F.col("m").alias("next_m"), F.col("n").alias("b")), ["next_c", "next_m"])
    near, stride = _within(checkpointed(steps.select("a", "b").where("a <> b"), "calls"))
    seen, reach = Parts(calls.sparkSession, "reach"), 0
    front = seen.add(start.toDF("c", "m").join(named, ["c", "m"]).select(F.col("n").alias("at"), "n", F.lit(0).alias("depth")))
    while True:
        further = front.where(F.col("depth") == reach).join(near, F.col("n") == F.col("a")).groupBy("at", F.col("b").alias("n")).agg((F.min("more") + reach).alias("depth"))
        front = seen.add(further.join(seen.read(), ["at", "n"], "left_anti"))
        if stride is None or front.isEmpty():
            break
        reach += stride
    seen = seen.read()
    return seen.join(named.select(F.col("c").alias("component_id"), F.col("m").alias("method"), F.col("n").alias("at")), "at").join(named, "n").select("component_id", "method", "c", "m")


def call_graph_reach(entrypoints: DataFrame, sites: DataFrame, calls: DataFrame, sinks: DataFrame, tracked: DataFrame) -> DataFrame:
    """Messaging sites that an entrypoint's calls reach on a channel that none of its sinks covers: entrypoint_id, tracked (its first path), channel, component_id.

    Of several sites of a channel the first counts.  A site for one caller is located at that caller.
    """
    channel = F.coalesce(F.when(F.trim("topic") != "", F.col("topic")), F.col("channel"))
    own = F.col("only_component").isNull()
    s = sites.where("kind = 'MESSAGING'").select("ord", channel.alias("channel"), F.col("component_id").alias("site"), F.when(own, F.col("component_id")).otherwise(F.col("only_component")).alias("component_id"), F.when(own, F.col("method")).otherwise(F.col("only_method")).alias("method")).where("channel is not null and method is not null")
    begin = entrypoints.select(F.col("id").alias("entrypoint_id"), F.col("component_id").alias("c"), F.col("method").alias("m"))
    x = reaching(s, calls).join(begin, ["c", "m"]).join(s, ["component_id", "method"])
    covered = sinks.where("kind = 'MESSAGING' and channel is not null").select("entrypoint_id", "channel").distinct()
    first = tracked.groupBy("entrypoint_id").agg(F.min_by("name", "ord").alias("tracked"))
    x = x.join(covered, ["entrypoint_id", "channel"], "left_anti").groupBy("entrypoint_id", "channel").agg(F.min_by("site", "ord").alias("component_id"))
    return x.join(first, "entrypoint_id").select("entrypoint_id", "tracked", "channel", "component_id")


def read_fields(entrypoints: DataFrame, accesses: DataFrame, calls: DataFrame) -> DataFrame:
    """entrypoint_id, owner_id, field: fields of other components read in any method that inline calls reach; no budget of visits."""
    r = accesses.where("kind = 'READ' and owner_id <> component_id").select("component_id", "method", "owner_id", "field").distinct()
    begin = entrypoints.select(F.col("id").alias("entrypoint_id"), F.col("component_id").alias("c"), F.col("method").alias("m"))
    return reaching(r, calls).join(r, ["component_id", "method"]).select("c", "m", "owner_id", "field").distinct().join(begin, ["c", "m"]).select("entrypoint_id", "owner_id", "field").distinct()


def read_names(entrypoints: DataFrame, accesses: DataFrame, calls: DataFrame) -> DataFrame:
    """entrypoint_id, field: names of all fields read in any method that inline calls reach; no budget of visits."""
    r = accesses.where("kind = 'READ'").select("component_id", "method", "field").distinct()
    begin = entrypoints.select(F.col("id").alias("entrypoint_id"), F.col("component_id").alias("c"), F.col("method").alias("m"))
    return reaching(r, calls).join(r, ["component_id", "method"]).select("c", "m", "field").distinct().join(begin, ["c", "m"]).select("entrypoint_id", "field").distinct()


def branch_topology(states: DataFrame, calls: DataFrame, components: DataFrame) -> DataFrame:
    """entrypoint_id, tracked, branch_id, arm_id, label, edge_kind, branch_kind of the branches that traced calls stand in."""
    k = _targets(with_names(calls), components).where(F.trim("branch_group") != "").where(can_traverse_inline() | F.col("leaves"))
    x = states.join(k.withColumnsRenamed({"from_id": "c", "from_method": "m", "literal": "l", "literal_value": "lv"}), ["c", "m"])
    maps_any, renamed = _renamed()
    x = x.withColumn("maps_any", maps_any).withColumn("next", renamed)
    alive = F.filter("names", lambda n: (n["now"] == "*") | ~_killed(n))
    enters = ~F.array_contains("keys", _key(F.col("to_id"), F.col("to_method"))) & (F.col("d") < TRACE_DEPTH)
    x = x.withColumn("n", F.explode(F.when(F.col("leaves"), alive).when(enters, F.col("next"))))
    control = F.col("control")
    default = F.when(control.isin("IF_THEN", "TERNARY_THEN"), "then").when(control.isin("IF_ELSE", "TERNARY_ELSE"), "else").when(control == "SWITCH_DEFAULT", "default").when(control == "CATCH", "catch").when(control == "FINALLY", "finally").when(control == "SWITCH_CASE", "case").otherwise("branch")
    label = F.coalesce(F.when(F.trim("branch_label") != "", F.col("branch_label")), default)
    kind = F.when(control.startswith("SWITCH"), "SWITCH").when(control.startswith("TERNARY"), "TERNARY").when(control.isin("CATCH", "FINALLY"), "TRY").otherwise("IF")
    edge = F.when(control.isin("CATCH", "FINALLY"), "EXCEPTION").otherwise("CONDITIONAL")
    return x.select(F.col("e").alias("entrypoint_id"), F.col("n.first").alias("tracked"), F.col("branch_group").alias("branch_id"), F.concat_ws(":", "branch_group", label).alias("arm_id"), label.alias("label"), edge.alias("edge_kind"), kind.alias("branch_kind")).distinct()
