"""Traversal and visibility rules as column expressions.

Components have `type` and `stereotype`; calls have `call_kind`, `capped` (too many receivers) and `ambiguous`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the rules.
ASYNC_KINDS = ("messaging", "event-bus")
HIDDEN_TYPES = ("UTILITY",)
SINK_TYPES = ("REPOSITORY", "HTTP_CLIENT", "CDI_EVENT_PRODUCER")
RUNTIME_WORDS = ("injection", "method", "event", "client", "message")


def is_async_boundary(kind: Column) -> Column:
    return F.coalesce(kind.isin(*ASYNC_KINDS), F.lit(False))


def can_traverse_inline(prefix: str = "") -> Column:
    """A call that goes on in the same process to a receiver that is known."""
    c = lambda name: F.coalesce(F.col(prefix + name), F.lit(False))
    return ~is_async_boundary(F.col(prefix + "call_kind")) & ~c("capped") & ~c("ambiguous")


def is_raw_messaging_client(prefix: str = "") -> Column:
    return F.coalesce((F.col(prefix + "type") == "HTTP_CLIENT") & (F.col(prefix + "stereotype") == "messaging"), F.lit(False))


def is_human_visible(prefix: str = "") -> Column:
    """Shown in diagrams: of a known type that is not hidden, and no bare transport client."""
    kind = F.col(prefix + "type")
    return kind.isNotNull() & ~kind.isin(*HIDDEN_TYPES) & ~is_raw_messaging_client(prefix)


def visible_ids(components: DataFrame) -> DataFrame:
    return components.where(is_human_visible()).select("id")


def sink_kind(kind: Column, type_: Column, stereotype: Column) -> Column:
    """What a call that leaves the traced code is: by how it is made, then the stereotype, then the type of its target."""
    return (
        F.when(kind == "event-bus", "EVENT_BUS")
        .when(kind == "messaging", "MESSAGING")
        .when(type_.isNull(), "UNKNOWN")
        .when(stereotype == "object-storage", "OBJECT_STORAGE")
        .when(stereotype == "file-outbound", "FILE_OUTBOUND")
        .when(type_ == "REPOSITORY", "PERSISTENCE")
        .when((type_ == "HTTP_CLIENT") & F.coalesce(stereotype == "messaging", F.lit(False)), "MESSAGING")
        .when(type_ == "HTTP_CLIENT", "HTTP_OUTBOUND")
        .when(type_ == "CDI_EVENT_PRODUCER", "EVENT_BUS")
        .otherwise("UNKNOWN")
    )


def is_sink_call() -> Column:
    """A call into something traced no further; columns call_kind and the target's type."""
    return is_async_boundary(F.col("call_kind")) | F.coalesce(F.col("type").isin(*SINK_TYPES), F.lit(False))


def dependency_flags(dependencies: DataFrame, components: DataFrame) -> DataFrame:
    """ord, is_runtime_relevant (by words of the kind), is_condensable (an end is a utility), is_cross_module."""
    utility = F.col("type").isin("UTILITY", "UNKNOWN")
    a = components.select(F.col("id").alias("src"), "module", utility.alias("a_utility"))
    b = components.select(F.col("id").alias("dst"), F.col("module").alias("b_module"), utility.alias("b_utility"))
    relevant = F.lit(False)
    for word in RUNTIME_WORDS:
        relevant = relevant | F.contains(F.lower(F.coalesce("kind", F.lit(""))), F.lit(word))
    x = dependencies.join(a, "src", "left").join(b, "dst", "left")
    ends = F.col("a_utility").isNotNull() & F.col("b_utility").isNotNull()
    return x.select("ord", relevant.alias("is_runtime_relevant"), F.coalesce(F.coalesce("a_utility", F.lit(False)) | F.coalesce("b_utility", F.lit(False)), F.lit(False)).alias("is_condensable"), (ends & ~F.col("module").eqNullSafe(F.col("b_module"))).alias("is_cross_module"))


def policy_name(raw: Column) -> Column:
    """A propagation or transaction attribute as written, by its one name."""
    simple = F.upper(F.substring_index(F.trim(F.replace(raw, F.lit('"'), F.lit(""))), ".", -1))
    return F.when((simple == "") | (simple == "DEFAULT"), "REQUIRED").when(simple == "REQUIRESNEW", "REQUIRES_NEW").when(simple == "NOTSUPPORTED", "NOT_SUPPORTED").otherwise(simple)


def policies(facts: DataFrame, components: DataFrame, calls: DataFrame) -> DataFrame:
    """ord, policy, level, confidence, limitations (sorted, joined by a comma) of each method that has a transaction policy.

    The first of: bean-managed EJB; annotation of the method, of the type, of a supertype; EJB default;
    use of the programmatic API.  A proxy is bypassed by a call from the same component.
    """
    ejb = F.coalesce(F.col("type").isin("EJB_STATELESS", "EJB_STATEFUL", "EJB_SINGLETON", "MESSAGE_DRIVEN_BEAN"), F.lit(False))
    raw = F.coalesce("on_method", "on_type", "inherited")
    named = policy_name(raw)
    own = calls.where("from_id = to_id").select(F.col("to_id").alias("component_id"), F.col("to_method").alias("method")).distinct().withColumn("own_call", F.lit(True))
    x = facts.join(components.select(F.col("id").alias("component_id"), "type"), "component_id").join(own, ["component_id", "method"], "left")
    managed, marked = F.col("bean_managed") & ejb, raw.isNotNull()
    level = F.when(managed, "bean-managed").when(F.col("on_method").isNotNull(), "method").when(F.col("on_type").isNotNull(), "type").when(marked, "inherited-type").when(ejb, "ejb-default").when(F.col("programmatic"), "programmatic-api")
    x = x.withColumns({"level": level, "policy": F.when(managed, "PROGRAMMATIC").when(marked, named).when(ejb, "REQUIRED").when(F.col("programmatic"), "PROGRAMMATIC")}).where("level is not null")
    declared = F.col("level").isin("method", "type", "inherited-type")
    spring = declared & (F.col("framework") == "spring")
    inside = F.col("programmatic") & (declared | (F.col("level") == "ejb-default"))
    bypass = spring & F.coalesce("own_call", F.lit(False))
    limits = F.array_compact(
        F.array(
            F.when(F.col("level") == "inherited-type", "inherited-policy-runtime-resolution"),
            F.when(inside, "programmatic-transaction-api-inside-declarative-boundary"),
            F.when(spring, "proxy-semantics-runtime-dependent"),
            F.when(F.col("level") == "programmatic-api", "scope-controlled-by-programmatic-api"),
            F.when(bypass, "spring-self-invocation-may-bypass-proxy"),
        )
    )
    base = F.when(F.col("level") == "bean-managed", 0.95).when(F.col("level") == "inherited-type", 0.8).when(declared, 1.0).when(F.col("level") == "ejb-default", 0.9).otherwise(0.6)
    return x.select("ord", "component_id", "method", "policy", "level", F.when(inside | bypass, F.least(base, F.lit(0.6))).otherwise(base).alias("confidence"), F.array_join(limits, ",").alias("limitations"))


def module_role(modules: DataFrame) -> DataFrame:
    """name, score, role of modules (name, annotated, deep_packages: counts of annotated types and of packages of three parts or more)."""
    name = F.lower("name")
    has = lambda *words: F.coalesce(name.rlike("|".join(words)), F.lit(False)).cast("int")
    score = F.when(F.col("annotated") > 0, 2).otherwise(0) + (F.col("annotated") >= 3).cast("int") + (F.col("deep_packages") >= 2).cast("int") - has("util", "dto", "common", "api", "base", "shared") + has("service", "domain", "business", "core", "impl")
    return modules.select("name", score.alias("score")).withColumn("role", F.when(F.col("score") >= 2, "internal_module").otherwise("technical_library"))


# ---- policies in XML

#: A pointcut whose types and methods can be told (a fixed pattern).
EXECUTION = r"^execution\s*\([^\s]+\s+([\w.$*]+)\.([\w$*]+)\s*\(.*$"


def glob(pattern: Column) -> Column:
    """A pattern with stars as a regular expression of the whole value."""
    return F.concat(F.lit(r"^\Q"), F.replace(pattern, F.lit("*"), F.lit(r"\E.*\Q")), F.lit(r"\E$"))


def glob_join(values: DataFrame, value: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """Rows of `values` with the rows of `patterns` whose glob their value matches.

    An equi-join on what stands before a pattern's first star: a value is taken once for each length that
    such a beginning has, of which names allow a few dozen.
    """
    start = F.substring_index(F.col(pattern), "*", 1)
    lengths = patterns.select(F.length(start).alias("n")).where("n is not null").agg(F.collect_set("n").alias("lengths"))
    cut = values.crossJoin(F.broadcast(lengths))  # one row, of numbers up to the length of a name
    cut = cut.select(*values.columns, F.explode(F.filter("lengths", lambda n: n <= F.length(value))).alias("_n")).withColumn("_start", F.substring(F.col(value), F.lit(1), F.col("_n"))).drop("_n")
    return cut.join(patterns.withColumn("_start", start), "_start").where(F.regexp_like(F.col(value), glob(F.col(pattern)))).drop("_start")


_XML = ["component_id", "method", "signature", "policy", "native", "framework", "confidence", "read_only", "isolation", "file", "place"]


def advised(rules: DataFrame, types: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Policies that advisors give to methods, and the advisors (file, advice, method, policy, native) that reach none.

    rules: of `read_advice`.  types: component_id, qualified_name.  methods: component_id, method, signature.
    Of the rules of an advice that match a method the one with most letters counts, the first of equals.
    """
    from weftgraph.sources.store import checkpointed

    advisors = rules.groupBy("file", "advisor").agg(F.first("advice").alias("advice"), F.first("pointcut").alias("pointcut"))
    cut = F.coalesce("pointcut", F.lit(""))
    aims = advisors.select("file", "advisor", F.regexp_extract(cut, EXECUTION, 1).alias("type_pattern"), F.regexp_extract(cut, EXECUTION, 2).alias("method_pattern")).where("type_pattern <> ''")
    on_types = glob_join(types.select("component_id", "qualified_name"), "qualified_name", aims, "type_pattern")
    met = on_types.join(methods.select("component_id", "method", "signature"), "component_id").where(F.regexp_like("method", glob(F.col("method_pattern"))))
    given = met.select("file", "advisor", "component_id", "method", "signature").join(rules, ["file", "advisor"]).where(F.regexp_like("method", glob(F.col("pattern"))))
    letters = F.length(F.replace("pattern", F.lit("*"), F.lit("")))
    best = given.groupBy("file", "advisor", "component_id", "method", "signature").agg(F.min_by(F.struct("propagation", "read_only", "isolation"), F.struct(-letters, "rule")).alias("r"))
    best = checkpointed(best, "advised")
    out = best.select("component_id", "method", "signature", policy_name(F.col("r.propagation")).alias("policy"), F.col("r.propagation").alias("native"), F.lit("spring-xml").alias("framework"), F.lit(0.9).alias("confidence"), "r.read_only", "r.isolation", "file", F.col("advisor").alias("place"))
    first = rules.groupBy("file", "advisor").agg(F.min_by(F.struct("advice", "pattern", "propagation"), "rule").alias("r"))
    left = first.join(best.select("file", "advisor").distinct(), ["file", "advisor"], "left_anti")
    return out.select(*_XML), left.select("file", "r.advice", F.col("r.pattern").alias("method"), policy_name(F.col("r.propagation")).alias("policy"), F.col("r.propagation").alias("native"))


def described(transactions: DataFrame, types: DataFrame, methods: DataFrame) -> DataFrame:
    """Policies that EJB descriptors give to methods.

    transactions: of `read_ejb_transactions`.  types: component_id, qualified_name, name, ejb_name.  methods:
    component_id, method, signature, parameter_types.  Parameter types that are given must agree, by full or simple name.
    """
    names = types.select("component_id", F.explode(F.array_distinct(F.array_compact(F.array("ejb_name", "name", "qualified_name")))).alias("ejb_name"))
    met = transactions.withColumnRenamed("method", "pattern").join(names, "ejb_name").join(methods, "component_id").where(F.regexp_like("method", glob(F.col("pattern"))))
    simple = lambda t: F.substring_index(F.substring_index(t, ".", -1), "$", -1)
    agree = F.forall(F.zip_with("parameters", "parameter_types", lambda a, b: simple(a) == simple(b)), lambda x: x)
    met = met.where(F.col("parameters").isNull() | ((F.size("parameters") == F.size("parameter_types")) & agree))
    none = F.lit(None)
    return met.select("component_id", "method", "signature", policy_name(F.col("attribute")).alias("policy"), F.col("attribute").alias("native"), F.lit("ejb-xml").alias("framework"), F.lit(1.0).alias("confidence"), none.cast("boolean").alias("read_only"), none.cast("string").alias("isolation"), "file", "place")


def upserted(annotated: DataFrame, *in_xml: DataFrame) -> DataFrame:
    """component_id, method, signature, policy, level, framework, confidence, limitations: of each method the policy that was said last.

    annotated: component_id, method, signature, policy, level, framework, confidence, limitations, defaulted.  XML comes after
    annotations, by file and place in it.  Spring advice beside a policy that was declared before is uncertain.
    """
    every = None
    for x in in_xml:
        every = x if every is None else every.unionByName(x)
    key = ["component_id", "method", "signature"]
    last = every.groupBy(*key).agg(F.max(F.struct("file", "place", "framework", "policy", "confidence")).alias("x"), F.count_distinct(F.struct("file", "place", "framework")).alias("said"))
    both = annotated.withColumn("declared", F.lit(True)).join(last, key, "full")
    beside = (F.col("x.framework") == "spring-xml") & ((F.col("said") > 1) | (F.coalesce("declared", F.lit(False)) & ~F.coalesce("defaulted", F.lit(False))))
    pick = lambda xml, own: F.when(F.col("x").isNotNull(), xml).otherwise(F.col(own))
    return both.select(
        *key, pick(F.col("x.policy"), "policy").alias("policy"), pick(F.lit("xml"), "level").alias("level"), pick(F.col("x.framework"), "framework").alias("framework"),
        pick(F.when(beside, F.least(F.col("x.confidence"), F.lit(0.6))).otherwise(F.col("x.confidence")), "confidence").alias("confidence"),
        pick(F.when(beside, "coexisting-annotation-and-xml-advice").otherwise(""), "limitations").alias("limitations"),
    )
