"""Call edges from facts about source code: what a call's receiver can be, and how well that is known.

The facts are relations, one row each, written by whatever reads the sources (`ord` is the place in them):

- types: id, component_id (null if no component), abstract (interfaces are)
- supertypes: type, supertype, is_class
- fields: ord, owner, name, declared (the element's type for arrays and collections), allocated (by a
  constructor), elements (types allocated into it), injected
- locals: ord, owner, method, name, allocated, elements, iterates (the variable that a loop runs over)
- methods: owner, name
- invocations: ord, owner, method, callee, target (`array`, `call`, `field`, `variable`, `this` or null), name (of the variable),
  accessor and accessor_type (of a target that is a call), declared (type of the variable), arm, assigned

Every step is a join or a window; the only iteration is the closure of supertypes, a deduplicated frontier
a step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.scalar import RECEIVER_EVIDENCE, lookup

#: Targets of one declared type (the rule's own cap).
MOST = 25

#: Methods that read or change a collection, methods of the Java library that tell nothing about a receiver,
#: types and name endings of state that methods share, types that are never such state.
COLLECTION_CALLS = (
    "put", "putAll", "putIfAbsent", "compute", "computeIfAbsent", "computeIfPresent", "merge", "remove", "replace", "clear", "add", "addAll", "offer",
    "poll", "get", "containsKey", "containsValue", "values", "keySet", "entrySet", "size", "isEmpty", "contains", "iterator", "stream", "forEach",
)
LIBRARY_CALLS = (
    "get", "orElse", "orElseGet", "orElseThrow", "isPresent", "isEmpty", "stream", "findFirst", "findAny", "filter", "map", "flatMap", "collect", "toList",
    "count", "sorted", "distinct", "limit", "skip", "anyMatch", "allMatch", "noneMatch", "min", "max", "reduce", "forEach", "size", "iterator",
    "listIterator", "first", "last", "peek", "poll", "values", "keySet", "entrySet",
)
WRITING_CALLS = (
    "put", "putIfAbsent", "putAll", "computeIfAbsent", "compute", "merge", "replace", "add", "addAll", "addFirst", "addLast", "offer", "offerFirst",
    "offerLast", "push", "set", "lazySet", "getAndSet", "compareAndSet", "accumulateAndGet", "updateAndGet",
)
STATE_TYPES = (
    "Map", "ConcurrentMap", "ConcurrentHashMap", "HashMap", "LinkedHashMap", "TreeMap", "List", "ArrayList", "LinkedList", "CopyOnWriteArrayList", "Set", "HashSet",
    "LinkedHashSet", "TreeSet", "ConcurrentSkipListSet", "Collection", "Queue", "Deque", "BlockingQueue", "ConcurrentLinkedQueue", "AtomicReference", "AtomicLong",
    "AtomicInteger", "AtomicBoolean",
)
STATE_ENDINGS = ("Cache", "State", "Store", "Buffer", "Queue", "Registry", "Snapshots", "Repository")
NEVER_STATE = ("Logger", "Log", "Slf4j", "Tracer")
NEVER_STATE_PREFIXES = ("Audit",)


#: Steps that a round of a closure takes.
STRIDE = 4


def ancestors(supertypes: DataFrame) -> DataFrame:
    """type, ancestor, depth: every supertype of every type, with the fewest steps to it; cycles end.

    A round takes up to STRIDE steps from the pairs that lie a whole number of rounds apart: the shortest way to
    any pair that is farther leads through such a one.
    """
    from weftgraph.sources.store import Parts, checkpointed

    pair = ["type", "ancestor"]
    step = supertypes.where("supertype <> ''").select("type", F.col("supertype").alias("ancestor")).where("type <> ancestor").distinct()
    step = checkpointed(step, "supertypes")
    up = step.select(F.col("type").alias("ancestor"), F.col("ancestor").alias("next"))
    last, within = step, step.withColumn("depth", F.lit(1))
    for depth in range(2, STRIDE + 1):
        last = last.join(up, "ancestor").select("type", F.col("next").alias("ancestor")).where("type <> ancestor").distinct()
        within = within.unionByName(last.withColumn("depth", F.lit(depth)))
    seen = Parts(supertypes.sparkSession, "ancestors")
    near = front = seen.add(within.groupBy(*pair).agg(F.min("depth").alias("depth")))
    on = near.select(F.col("type").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
    reach = STRIDE
    while True:
        further = front.where(F.col("depth") == reach).join(on, "ancestor").where("type <> next").groupBy("type", F.col("next").alias("ancestor")).agg((F.min("more") + reach).alias("depth"))
        front = seen.add(further.join(seen.read(), pair, "left_anti"))
        if front.isEmpty():
            return seen.read()
        reach += STRIDE


def expansions(types: DataFrame, above: DataFrame) -> DataFrame:
    """declared, target, place, evidence, capped: what a variable of a declared type can hold.

    The type itself if it is concrete, then its concrete subtypes by name, MOST at most; a known abstract
    type without any stands for itself.  Only types that are components count; the declared one need not be.
    """
    known = types.where("component_id is not null")
    real = known.where("not abstract").select(F.col("id").alias("target"))
    own = real.select(F.col("target").alias("declared"), "target", F.lit(0).alias("far"), F.lit("DECLARED_FIELD_TYPE").alias("evidence"))
    below = above.select(F.col("ancestor").alias("declared"), F.col("type").alias("target")).join(real, "target").select("declared", "target", F.lit(1).alias("far"), F.lit("SMALL_POLYMORPHIC_EXPANSION").alias("evidence"))
    some = own.unionByName(below)
    alone = known.where("abstract").select(F.col("id").alias("declared")).join(some.select("declared"), "declared", "left_anti")
    every = some.unionByName(alone.select("declared", F.col("declared").alias("target"), F.lit(2).alias("far"), F.lit("DECLARED_INTERFACE_ONLY").alias("evidence")))
    sizes = every.groupBy("declared").agg((F.count("*") > MOST).alias("capped"))
    placed = every.withColumn("place", F.row_number().over(Window.partitionBy("declared").orderBy("far", "target"))).where(F.col("place") <= MOST)
    return placed.join(sizes, "declared").select("declared", "target", "place", "evidence", "capped")


def visible_fields(fields: DataFrame, supertypes: DataFrame) -> DataFrame:
    """owner, name and the field that a type sees under a name: its own, else that of the nearest superclass; the first of a name in a type."""
    of = ["declared", "allocated", "elements", "injected"]
    classes = ancestors(supertypes.where("is_class"))
    own = fields.select("owner", "name", F.struct(F.lit(0).alias("depth"), "ord", *of).alias("f"))
    above = fields.withColumnRenamed("owner", "ancestor").join(classes, "ancestor").select(F.col("type").alias("owner"), "name", F.struct("depth", "ord", *of).alias("f"))
    return own.unionByName(above).groupBy("owner", "name").agg(F.min_by("f", F.struct("f.depth", "f.ord")).alias("f")).select("owner", "name", *(F.col(f"f.{c}").alias(c) for c in of))


def known_locals(variables: DataFrame, fields: DataFrame) -> DataFrame:
    """owner, method, name, targets, evidence: what a local was given, by its first declaration that tells.

    A constructor tells its type; a factory of constructed elements tells theirs; a loop's variable is told
    by the elements of the local, else the field, that the loop runs over.
    """
    of = Window.partitionBy("owner", "method", "name").orderBy("ord")
    first = variables.withColumn("k", F.row_number().over(of)).where("k = 1").select("owner", "method", F.col("name").alias("iterates"), F.coalesce("elements", F.array().cast("array<string>")).alias("run_over"))
    loops = variables.join(first, ["owner", "method", "iterates"], "left")
    loops = loops.join(fields.select("owner", F.col("name").alias("iterates"), F.col("elements").alias("of_field")), ["owner", "iterates"], "left")
    has = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0
    shown = F.when(F.col("run_over").isNotNull(), F.col("run_over")).otherwise(F.col("of_field"))
    targets = F.when(F.col("allocated").isNotNull(), F.array("allocated")).when(has(F.col("elements")), F.col("elements")).when(has(shown), shown)
    told = loops.select("owner", "method", "name", "ord", targets.alias("targets"), F.when(F.col("allocated").isNotNull(), "LOCAL_ASSIGNMENT").otherwise("COLLECTION_ELEMENT_ALLOCATION").alias("evidence")).where("targets is not null")
    return told.groupBy("owner", "method", "name").agg(F.min_by(F.struct("targets", "evidence"), "ord").alias("t")).select("owner", "method", "name", "t.*")


def _listed(calls: DataFrame, targets: Column, evidence: str | Column) -> DataFrame:
    """One row for each type of a list."""
    out = calls.select("ord", F.posexplode(targets).alias("place", "to"), (F.lit(evidence) if isinstance(evidence, str) else evidence).alias("evidence"))
    return out.select("ord", F.col("to").alias("type"), F.col("place").cast("int").alias("place"), "evidence", F.lit(False).alias("capped"))


def _expanded(calls: DataFrame, expanded: DataFrame, declared: str) -> DataFrame:
    """One row for each type that a declared type can stand for."""
    return calls.select("ord", F.col(declared).alias("declared")).join(expanded, "declared").select("ord", F.col("target").alias("type"), "place", "evidence", "capped")


def resolve(invocations: DataFrame, types: DataFrame, supertypes: DataFrame, fields: DataFrame, variables: DataFrame, methods: DataFrame, above: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """ord, type, place, evidence, confidence, capped: the types that each call's receiver can be.

    The first way that tells anything counts.  An element of an array: what was allocated into the field,
    else its declared type.  A call's result: its declared type; else, unless a library method was called,
    the first type with a method of the accessor's name, if the outer call works on a collection or nothing
    is declared.  A variable: what the local was given, what the field was given, the field's declared type,
    the variable's declared type.  `above`, `seen`: the ancestors and the visible fields, where they are known already.
    """
    from weftgraph.sources.store import checkpointed

    above = ancestors(supertypes) if above is None else above
    expanded = checkpointed(expansions(types, above), "expansions")
    seen = checkpointed(visible_fields(fields, supertypes), "fields") if seen is None else seen
    ways: list[tuple[int, DataFrame]] = []

    arrays = invocations.where("target = 'array' and name is not null").select("ord", "owner", "name").join(seen, ["owner", "name"])
    ways += [(0, _listed(arrays, F.col("elements"), "ARRAY_ELEMENT_ALLOCATION")), (1, _expanded(arrays, expanded, "declared"))]

    results = invocations.where("target = 'call'")
    returned = _expanded(results, expanded, "accessor_type").withColumn("evidence", F.lit("ACCESSOR_RETURN"))
    owners = methods.join(types.where("component_id is not null").select(F.col("id").alias("owner")), "owner", "left_semi").groupBy(F.col("name").alias("accessor")).agg(F.min("owner").alias("type"))
    on_collection = F.col("callee").isin(*COLLECTION_CALLS)
    guessed = results.where((F.col("accessor_type").isNull() | on_collection) & ~F.col("accessor").isin(*LIBRARY_CALLS)).join(owners, "accessor")
    guessed = guessed.select("ord", "type", F.lit(0).alias("place"), F.when(on_collection, "ACCESSOR_STATE_OWNER").otherwise("ACCESSOR_NAME_FALLBACK").alias("evidence"), F.lit(False).alias("capped"))
    ways += [(0, returned), (1, guessed)]

    named = invocations.where("target in ('variable', 'field') and name is not null")
    given = named.join(known_locals(variables, seen), ["owner", "method", "name"])
    held = named.select("ord", "owner", "name").join(seen, ["owner", "name"])
    ways += [
        (0, _listed(given, F.col("targets"), F.col("evidence"))),
        (1, _listed(held.where("allocated is not null"), F.array("allocated"), "CONSTRUCTOR_ASSIGNMENT")),
        (2, _expanded(held.where("allocated is null"), expanded, "declared")),
        (3, _expanded(named, expanded, "declared")),
    ]
    every = None
    for way, found in ways:
        found = found.withColumn("way", F.lit(way))
        every = found if every is None else every.unionByName(found)
    every = checkpointed(every.where("type <> ''"), "receivers")
    best = every.groupBy("ord").agg(F.min("way").alias("way"))
    out = every.join(best, ["ord", "way"])
    return out.select("ord", "type", "place", "evidence", lookup(F.col("evidence"), RECEIVER_EVIDENCE).alias("confidence"), "capped")


def killed_names(invocations: DataFrame) -> DataFrame:
    """ord, killed: the names that earlier calls of the same method have overwritten, sorted."""
    before = Window.partitionBy("owner", "method").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return invocations.select("ord", F.array_sort(F.collect_set("assigned").over(before)).alias("killed"))


def field_components(fields: DataFrame, types: DataFrame, above: DataFrame) -> DataFrame:
    """owner, name, component_id of the fields whose type, or else the single implementor of it, is another component; the declared type wins over the injected one."""
    known = types.where("component_id is not null").select("id", "component_id")
    own = known.select(F.col("id").alias("owner"), F.col("component_id").alias("own"))
    each = fields.select("owner", "name", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("declared").alias("t")), F.struct(F.lit(1).alias("rank"), F.col("injected").alias("t")))).alias("x")).select("owner", "name", "x.*").where("t is not null")
    each = each.join(own, "owner", "left").withColumn("own", F.coalesce("own", F.lit("")))
    direct = each.join(known.withColumnRenamed("id", "t"), "t").where("component_id <> own").select("owner", "name", "rank", "component_id")
    missing = each.join(direct.select("owner", "name", "rank").distinct(), ["owner", "name", "rank"], "left_anti")
    below = above.select(F.col("ancestor").alias("t"), F.col("type").alias("id")).join(types.where("component_id is not null and not abstract").select("id", "component_id"), "id")
    single = missing.join(below, "t").where("component_id <> own").groupBy("owner", "name", "rank", "t").agg(F.min("component_id").alias("component_id"), F.max("component_id").alias("other")).where("component_id = other")
    found = direct.unionByName(single.select("owner", "name", "rank", "component_id"))
    return found.groupBy("owner", "name").agg(F.min_by("component_id", "rank").alias("component_id"))


def call_edges(invocations: DataFrame, types: DataFrame, supertypes: DataFrame, fields: DataFrame, variables: DataFrame, methods: DataFrame) -> DataFrame:
    """from_id, from_method, to_id, to_method, arm, call_kind, evidence, confidence, capped, ambiguous, killed.

    One edge for each pair of methods and arm of a branch, the first in the sources.  Calls on the object
    itself are `intra` edges; a field read whose receiver nothing tells goes to the component
    of the field that its type sees, an inherited one included.
    """
    from weftgraph.sources.store import checkpointed

    above, seen = ancestors(supertypes), checkpointed(visible_fields(fields, supertypes), "fields")
    found = checkpointed(resolve(invocations, types, supertypes, fields, variables, methods, above, seen), "resolved")
    known = types.where("component_id is not null").select("id", "component_id")
    calls = invocations.join(known.withColumnRenamed("id", "owner").withColumnRenamed("component_id", "from_id"), "owner")
    calls = calls.select("ord", "owner", "from_id", F.col("method").alias("from_method"), F.col("callee").alias("to_method"), "target", "name", "arm")
    base = ["ord", "from_id", "from_method", "to_id", "to_method", "arm", "place", "call_kind", "evidence", "confidence", "capped"]
    told = calls.join(found, "ord").join(known.select(F.col("id").alias("type"), F.col("component_id").alias("to_id")), "type").where("to_id <> from_id").withColumn("call_kind", F.lit("direct"))
    told = told.withColumn("evidence", F.replace(F.lower("evidence"), F.lit("_"), F.lit("-")))
    reads = calls.where("target = 'field'").join(found.select("ord").distinct(), "ord", "left_anti").join(field_components(seen, types, above).withColumnRenamed("component_id", "to_id"), ["owner", "name"])
    reads = reads.where("to_id <> from_id").select("*", F.lit(0).alias("place"), F.lit("direct").alias("call_kind"), F.lit("legacy-field-read").alias("evidence"), F.lit(0.85).alias("confidence"), F.lit(False).alias("capped"))
    inner = calls.where("target is null or target = 'this'").join(methods.select("owner", F.col("name").alias("to_method")).distinct(), ["owner", "to_method"]).where("to_method <> from_method")
    inner = inner.select("*", F.col("from_id").alias("to_id"), F.lit(0).alias("place"), F.lit("intra").alias("call_kind"), F.lit(None).cast("string").alias("evidence"), F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("capped"))
    every = told.select(*base).unionByName(reads.select(*base)).unionByName(inner.select(*base))
    first = every.groupBy("from_id", "from_method", "to_id", "to_method", "arm").agg(F.min_by(F.struct("ord", "call_kind", "evidence", "confidence", "capped"), F.struct("ord", "place")).alias("e"))
    first = first.select("from_id", "from_method", "to_id", "to_method", "arm", "e.*")
    out = first.join(killed_names(invocations), "ord")
    return out.select("from_id", "from_method", "to_id", "to_method", "arm", "call_kind", "evidence", "confidence", "capped", (F.coalesce("evidence", F.lit("")) == "accessor-name-fallback").alias("ambiguous"), F.when(F.col("call_kind") == "intra", F.array().cast("array<string>")).otherwise(F.col("killed")).alias("killed"))


def is_shared_state(type_name: Column, field: Column) -> Column:
    """Does a field, by its simple type name and its own name, hold state that methods share?"""
    denied = type_name.isin(*NEVER_STATE)
    for p in NEVER_STATE_PREFIXES:
        denied = denied | F.startswith(type_name, F.lit(p))
    held = type_name.isin(*STATE_TYPES)
    for e in STATE_ENDINGS:
        held = held | F.endswith(type_name, F.lit(e)) | F.endswith(field, F.lit(e[0].lower() + e[1:]))
    return F.coalesce(held & ~denied, F.lit(False))


def state_accesses(invocations: DataFrame, fields: DataFrame) -> DataFrame:
    """ord, owner, method, field, kind: calls on a type's own shared-state fields write or read them.  fields: owner, name, type_name."""
    state = fields.where(is_shared_state(F.col("type_name"), F.col("name"))).select("owner", "name").distinct()
    on = invocations.where("target = 'field'").join(state, ["owner", "name"])
    return on.select("ord", "owner", "method", F.col("name").alias("field"), F.when(F.col("callee").isin(*WRITING_CALLS), "WRITE").otherwise("READ").alias("kind"))
