"""Operators over ordered steps: transaction scopes, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _transition(policy: Column, active: Column) -> Column:
    """What a step with this policy does, given whether a scope is active."""
    rules = (
        ("REQUIRED", "join", "begin"),
        ("REQUIRES_NEW", "suspend-and-begin", "begin"),
        ("NESTED", "nested", "begin"),
        ("SUPPORTS", "join", "none"),
        ("MANDATORY", "join", "missing-required-scope"),
        ("NOT_SUPPORTED", "suspend", "none"),
        ("NEVER", "invalid-active-scope", "none"),
    )
    out = F.when(policy.isNull(), F.when(active, "join").otherwise("none"))
    for name, inside, outside in rules:
        out = out.when(policy == name, F.when(active, inside).otherwise(outside))
    return out.otherwise("unknown")


def transaction_scopes(steps: DataFrame) -> DataFrame:
    """flow_id, step, transition, scope of every step (columns flow_id, step, policy).

    Whether a scope is active depends only on the last step whose policy decides it regardless of what
    was before: REQUIRED, REQUIRES_NEW and NESTED leave one active; NOT_SUPPORTED and unknown policies
    leave none; the others change nothing.  So the state machine is two window functions instead of a
    fold, and a scope's number counts the steps that began one.
    """
    order = Window.partitionBy("flow_id").orderBy("step")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    neutral = F.col("policy").isNull() | F.col("policy").isin("SUPPORTS", "MANDATORY", "NEVER")
    leaves = F.when(F.col("policy").isin("REQUIRED", "REQUIRES_NEW", "NESTED"), True).when(neutral, F.lit(None)).otherwise(False)
    x = steps.withColumn("leaves", leaves).withColumn("active", F.coalesce(F.last("leaves", ignorenulls=True).over(before), F.lit(False)))
    x = x.withColumn("transition", _transition(F.col("policy"), F.col("active")))
    begins = (F.col("policy").isin("REQUIRED", "NESTED") & ~F.col("active")) | (F.col("policy") == "REQUIRES_NEW")
    number = F.count(F.when(begins, 1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    now = F.coalesce("leaves", "active")
    return x.select("flow_id", "step", "transition", F.when(now, F.concat_ws(":", "flow_id", F.lit("tx"), number.cast("string"))).alias("scope"))


def neighbours(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Previous and next value of each row within its key."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.select(key, order, value, F.lag(value).over(w).alias("before"), F.lead(value).over(w).alias("after"))
