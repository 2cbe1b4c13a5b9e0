"""Topics of outbound messages: string constants followed through fields, locals, parameters and implementations.

Facts: expressions (id, kind, value, init, owner, method, position, message, receiver_type, callee), where a
`literal` has a value, a `field` or `local` the id of its initializer, a `param` its place in its method and
whether it is a message, and a `call` the type and method that it calls; arguments (call, owner, method,
position, arity, expression, type, caller, caller_method); headers (caller, caller_method, expression: what a
method sets as a message's topic); returns (owner, method, expression); supertypes (type, supertype).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Expressions on a way to a constant (the rule's own depth).
DEPTH = 15


def followed(expressions: DataFrame, arguments: DataFrame, headers: DataFrame, returns: DataFrame, supertypes: DataFrame) -> DataFrame:
    """expression, next: where the value of an expression may come from.

    An initializer; what callers pass for a parameter, or set as the topic header if it is a message; what the
    called method returns in the types directly below the receiver's.
    """
    inits = expressions.where("kind in ('field', 'local') and init is not null").select(F.col("id").alias("expression"), F.col("init").alias("next"))
    params = expressions.where("kind = 'param'").select(F.col("id").alias("expression"), "owner", "method", "position", F.coalesce("message", F.lit(False)).alias("message"))
    passed = params.where("not message").join(arguments.select("owner", "method", "position", F.col("expression").alias("next")), ["owner", "method", "position"]).select("expression", "next")
    callers = arguments.select("owner", "method", "caller", "caller_method").distinct()
    set_by = params.where("message").join(callers, ["owner", "method"]).join(headers.select("caller", "caller_method", F.col("expression").alias("next")), ["caller", "caller_method"]).select("expression", "next")
    calls = expressions.where("kind = 'call'").select(F.col("id").alias("expression"), F.col("receiver_type").alias("supertype"), F.col("callee").alias("method"))
    given = calls.join(supertypes.select(F.col("type").alias("owner"), "supertype"), "supertype").join(returns.select("owner", "method", F.col("expression").alias("next")), ["owner", "method"]).select("expression", "next")
    return inits.unionByName(passed).unionByName(set_by).unionByName(given).distinct()


def constants(roots: DataFrame, expressions: DataFrame, steps: DataFrame, depth: int = DEPTH) -> DataFrame:
    """root, value: the string constants that each root expression can have.

    Taken backwards from the constants: an expression has each value once, by its shortest way, so cycles end and
    what lies behind an expression is not followed again for each root that leads there.  A constant
    initializer of a field counts with the field.
    """
    from weftgraph.sources.store import Parts, checkpointed

    literal = expressions.where("kind = 'literal' and value is not null").select("id", "value")
    fields = expressions.where("kind = 'field'").select("id", "init").join(literal.withColumnRenamed("id", "init"), "init").select("id", "value")
    seen = Parts(expressions.sparkSession, "constants")
    front = seen.add(literal.unionByName(fields).select(F.col("id").alias("expression"), "value").distinct())
    step = checkpointed(steps, "steps")
    for _ in range(depth - 1):
        further = front.withColumnRenamed("expression", "next").join(step, "next").select("expression", "value").distinct()
        front = seen.add(further.join(seen.read(), ["expression", "value"], "left_anti"))
        if front.isEmpty():
            break
    return roots.select("expression").distinct().join(seen.read(), "expression").select(F.col("expression").alias("root"), "value")


def resolve_topics(sites: DataFrame, expressions: DataFrame, arguments: DataFrame, headers: DataFrame, returns: DataFrame, types: DataFrame, supertypes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """id, topic, only_component, only_method, evidence: each outbound site once for each of its topics, once without topic if none is known.

    sites: id, owner, method, topic, kind, expression, position (of the parameter that the topic comes from), accessor (called on that
    parameter), arity, param_type, evidence.  A known topic stays.  A topic that comes in by a parameter is resolved for each call of the
    method, and holds for that caller alone.  An accessor's value is what the argument's own class returns, or else what the
    implementations of the declared type return.
    """
    from weftgraph.sources.store import checkpointed

    known = sites.where("topic is not null or kind = 'LITERAL'")
    open_ = sites.where("topic is null and kind <> 'LITERAL'")
    plain = open_.where("position is null and expression is not null")
    calls = open_.where("position is not null").join(
        arguments.select("call", F.col("owner"), "method", "position", "arity", F.col("expression").alias("argument"), F.col("type").alias("argument_type"), "caller", "caller_method"), ["owner", "method", "position", "arity"]
    )
    calls = checkpointed(calls, "calls").withColumn("evidence", F.when(F.col("accessor").isNotNull(), F.concat_ws("+", "evidence", F.lit("topic-expansion"))).otherwise(F.col("evidence")))
    direct, through = calls.where("accessor is null"), calls.where("accessor is not null")
    concrete = types.where("not interface").select(F.col("id").alias("argument_type"))
    own = through.join(concrete, "argument_type").join(returns.select(F.col("owner").alias("argument_type"), F.col("method").alias("accessor"), F.col("expression").alias("root")), ["argument_type", "accessor"])
    below = supertypes.select(F.col("supertype").alias("param_type"), F.col("type").alias("implementation"))
    impl = through.join(below, "param_type").join(returns.select(F.col("owner").alias("implementation"), F.col("method").alias("accessor"), F.col("expression").alias("root")), ["implementation", "accessor"])
    roots = plain.select(F.col("expression").alias("root")).unionByName(direct.select(F.col("argument").alias("root"))).unionByName(own.select("root")).unionByName(impl.select("root"))
    values = checkpointed(constants(roots.where("root is not null").select(F.col("root").alias("expression")), expressions, followed(expressions, arguments, headers, returns, supertypes), depth), "constants")

    none = F.lit(None).cast("string")
    of = ["id", F.col("value").alias("topic"), F.col("caller").alias("only_component"), F.col("caller_method").alias("only_method"), "evidence"]
    by_plain = plain.join(values, plain["expression"] == values["root"]).select("id", F.col("value").alias("topic"), none.alias("only_component"), none.alias("only_method"), "evidence")
    by_direct = direct.join(values, direct["argument"] == values["root"]).select(*of)
    by_own = checkpointed(own.join(values, "root").select("call", *of).distinct(), "own")
    by_impl = impl.join(by_own.select("id", "call").distinct(), ["id", "call"], "left_anti").join(values, "root").select(*of)
    found = checkpointed(by_plain.unionByName(by_direct).unionByName(by_own.drop("call")).unionByName(by_impl).distinct(), "topics")
    rest = open_.join(found.select("id").distinct(), "id", "left_anti")
    as_is = known.unionByName(rest).select("id", "topic", none.alias("only_component"), none.alias("only_method"), "evidence")
    return found.unionByName(as_is)
