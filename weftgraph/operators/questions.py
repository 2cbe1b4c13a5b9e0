"""Question operators: planning, identity, and answers with evidence and what stays open."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.scan import resolution
from weftgraph.operators.traverse import impacted_by

#: Regexes and weights that speak for each question family (fixed values).
TRIGGERS = {
    "persistence_destination": ((r"\bpersist(ed|ence)?\b", 3), (r"\b(stored|saved?)\b", 2), (r"\b(database|entity|repository)\b", 2), (r"field.*flow|flow.*field", 2)),
    "consumer_context": ((r"\bconsum(e|er|es|ed)\b", 3), (r"\blisten(s|er)?\b", 2), (r"\bsubscribe\b", 2), (r"\b(channel|topic|queue)\b", 2), (r"\bpublishes\b", 2)),
    "impact": ((r"\bbreaks?\b", 3), (r"\bimpact\b", 3), (r"\breplace[ds]?\b", 2), (r"\baffects?\b", 2), ("what may", 1)),
    "transaction_context": ((r"\btransaction(al)?\b", 3), (r"\b(rollback|commit)\b", 2), (r"\bpropagation\b", 2), ("shares the transaction", 2)),
    "endpoint_context": ((r"\bendpoints?\b", 2), (r"\b(get|post|put|patch|delete)\b", 3), (r"/\S+", 3), ("calls service", 2), (r"\bcalls?\b", 1)),
    "messaging_flow": ((r"\bpublish(es)?\b", 3), (r"\btopic\b|\bchannel\b|\bqueue\b|\bbroker\b", 2), (r"\bdownstream\b", 1)),
    "scheduled_workflow": ((r"\bjob\b|\bschedule[dr]?\b", 3), (r"\bcron\b", 3), (r"\btriggers?\b", 2), ("fixed rate|fixed delay", 2)),
    "state_lifecycle": ((r"\bfield\b", 2), (r"\bwritten\b", 2), ("read and|read.*writ", 2)),
    "configuration_context": ((r"\bconfig(uration)?\b", 3), ("base url", 2), (r"\bpropert(y|ies)\b", 2), (r"\bplaceholder\b", 1)),
    "external_integration_context": ((r"\bintegration\b", 3), (r"\bclient\b", 2), (r"\bexternal\b", 2)),
    "relationship": ((r"\brelationship\b", 3), ("how.*related|connected to", 2)),
}
UNSUPPORTED, TIE, CONFIDENT = 0.25, 0.15, 0.6


def family_scores(questions: DataFrame, text_col: str = "question") -> DataFrame:
    """id, family, score: matched weight over total weight."""
    q = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    each = []
    for family, triggers in TRIGGERS.items():
        raw = sum((F.when(q.rlike(rx), w).otherwise(0) for rx, w in triggers[1:]), F.when(q.rlike(triggers[0][0]), triggers[0][1]).otherwise(0))
        each.append(F.struct(F.lit(family).alias("family"), (raw / sum(w for _, w in triggers)).alias("score")))
    return questions.select("id", F.explode(F.array(*each)).alias("s")).select("id", "s.family", "s.score")


def plan(questions: DataFrame, text_col: str = "question") -> DataFrame:
    """id, intent, score of every question; the two best scores come from one aggregate per question."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "family")))
    top = family_scores(questions, text_col).groupBy("id").agg(best.alias("b"))
    first, second = -F.get("b", F.lit(0))["minus"], -F.get("b", F.lit(1))["minus"]
    intent = F.when(first < UNSUPPORTED, "unsupported").when((first - second < TIE) & (first < CONFIDENT), "needs-clarification").otherwise(F.get("b", F.lit(0))["family"])
    return top.select("id", intent.alias("intent"), F.round(first, 6).alias("score"))


#: Leading words that name nothing (fixed values).
QUESTION_WORDS = ("What", "Which", "Who", "Where", "When", "How", "Why", "Does", "Do", "Is", "Are", "Will", "Would", "Should", "Can", "Could")


def subject(text: Column) -> Column:
    """kind, ref, confidence: method and path, then quoted, then `field x`, qualified name, capitalised word."""
    pick = lambda rx, group: F.regexp_extract(text, rx, group)
    method, path = pick(r"(?i)\b(GET|POST|PUT|PATCH|DELETE)\s+(/\S+)", 1), F.regexp_replace(pick(r"(?i)\b(GET|POST|PUT|PATCH|DELETE)\s+(/\S+)", 2), r"[?.,!;:]+$", "")
    quoted, field_ = pick("[`'\"]([^`'\"]+)[`'\"]", 1), pick(r"(?i)\bfield\s+([A-Za-z][A-Za-z0-9_]*)\b", 1)
    qualified = pick(r"\b([a-z][a-zA-Z0-9]*(?:\.[A-Za-z][a-zA-Z0-9]*)+)\b", 1)
    capital = F.get(F.filter(F.regexp_extract_all(text, F.lit(r"\b([A-Z][A-Za-z0-9]*)\b"), F.lit(1)), lambda w: ~w.isin(*QUESTION_WORDS)), F.lit(0))
    make = lambda kind, ref, c: F.struct(F.lit(kind).alias("kind"), ref.alias("ref"), F.lit(c).alias("confidence"))
    return (
        F.when(method != "", make("entrypoint", F.concat_ws(" ", F.upper(method), path), 0.95))
        .when(quoted != "", make("exact", quoted, 0.9))
        .when(field_ != "", make("field", field_, 0.85))
        .when(qualified != "", make("component", qualified, 0.8))
        .when(capital.isNotNull(), make("component", capital, 0.5))
    )


#: Families whose request keeps its query (fixed values).
QUERY_FAMILIES = ("state_lifecycle", "messaging_flow", "external_integration_context", "configuration_context")
DEPTHS = {"impact": 4, "relationship": 2}


def requests(asked: DataFrame) -> DataFrame:
    """asked with `request`, the JSON (keys in order) that tells one question from another.

    asked: family, subject_id, subject_label, subject_field, subject_query, param, method, field, query, target, max_depth.
    The subject is an entrypoint, a component, a field, a query or any other node, in this order; blank
    arguments are left out; depths have the family's default.
    """
    filled = lambda c: F.when(F.trim(c) != "", F.col(c))
    sid, label, family = F.col("subject_id"), F.col("subject_label"), F.col("family")
    entrypoint, component = F.when(label == "Entrypoint", sid), F.when(label == "Component", sid)
    none = entrypoint.isNull() & component.isNull()
    of_field = F.when(none, F.col("subject_field"))
    of_query = F.when(none & F.col("subject_field").isNull(), F.col("subject_query"))
    subject_ = F.when(none & F.col("subject_field").isNull() & F.col("subject_query").isNull(), sid)
    reverse = (family == "endpoint_context") & entrypoint.isNull()
    depth = F.when(family.isin(*DEPTHS) | reverse, F.coalesce("max_depth", F.when(family == "relationship", DEPTHS["relationship"]).otherwise(DEPTHS["impact"])).cast("int"))
    values = {
        "component": component, "entrypoint": entrypoint, "field": F.coalesce(filled("field"), of_field), "maxDepth": depth, "method": filled("method"),
        "mode": F.when(family == "endpoint_context", F.when(entrypoint.isNotNull(), "forward").otherwise("reverse")), "param": filled("param"),
        "query": F.coalesce(F.when(family.isin(*QUERY_FAMILIES), filled("query")), of_query), "subject": subject_, "target": F.when(family == "relationship", filled("target")),
    }
    return asked.withColumn("request", F.to_json(F.struct(*(v.alias(k) for k, v in values.items()))))


def concept_key(family: str, request: dict) -> str:
    """SHA-256 of the family and request as JSON with sorted keys."""
    return hashlib.sha256(json.dumps({"family": family, "request": request}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def concept_path(family: str, subject_: str, request: dict) -> str:
    return f"investigations/{family}/{subject_}-{concept_key(family, request)[:12]}.md"


def status(ambiguous: Column, missing: Column) -> Column:
    """ambiguous before partial before resolved."""
    return F.when(ambiguous, "ambiguous").when(missing, "partial").otherwise("resolved")


def impact(edges: DataFrame, nodes: DataFrame, target: DataFrame, depth: int = 4) -> DataFrame:
    """label, n of what the target's change reaches, by label."""
    return impacted_by(edges, target, depth).join(nodes.select("id", "label"), "id").groupBy("label").agg(F.count("*").alias("n"))


def state_lifecycle(accesses: DataFrame, field: str) -> DataFrame:
    """field, owner_id and the number of writers, readers and writers that read, of fields whose name contains `field`."""
    hit = accesses.where(F.contains(F.lower("field"), F.lit(field.lower())))
    per = hit.groupBy("field", "owner_id", "component_id").agg(F.max(F.col("kind") == "WRITE").alias("w"), F.max(F.col("kind") == "READ").alias("r"))
    return per.groupBy("field", "owner_id").agg(F.count(F.when(F.col("w"), 1)).alias("writers"), F.count(F.when(F.col("r"), 1)).alias("readers"), F.count(F.when(F.col("w") & F.col("r"), 1)).alias("both"))


def messaging_flow(entrypoints: DataFrame, sinks: DataFrame) -> DataFrame:
    """destination, producers, consumers: sinks and entrypoints that meet on a topic, or a channel where there is none."""
    made = sinks.where("kind = 'MESSAGING'").groupBy(F.coalesce("topic", "channel").alias("destination")).agg(F.count("*").alias("producers"))
    used = entrypoints.groupBy(F.coalesce("topic", "channel").alias("destination")).agg(F.count("*").alias("consumers"))
    return made.join(used, "destination", "full").select("destination", F.coalesce("producers", F.lit(0)).alias("producers"), F.coalesce("consumers", F.lit(0)).alias("consumers"))


def persistence_destination(sinks: DataFrame, param: str, paths: DataFrame) -> DataFrame:
    """entity, operation, n of the persistence sinks of paths that track exactly `param`."""
    mine = paths.where(F.col("param") == param).select(F.col("id").alias("path_id"))
    return sinks.where("kind = 'PERSISTENCE'").join(mine, "path_id", "left_semi").groupBy("operation").agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities"))


def endpoint_context(entrypoints: DataFrame, paths: DataFrame, sinks: DataFrame) -> DataFrame:
    """entrypoint_id, sinks by kind of every entrypoint's paths."""
    s = paths.select(F.col("id").alias("path_id"), "entrypoint_id").join(sinks.select("path_id", "kind"), "path_id")
    n = s.groupBy("entrypoint_id").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k.lower()) for k in ("STORE", "MESSAGING", "EVENT_BUS", "PERSISTENCE")))
    e = entrypoints.select(F.col("id").alias("entrypoint_id")).join(n, "entrypoint_id", "left")
    return e.select("entrypoint_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("store", "messaging", "event_bus", "persistence")))


def component_status(components: DataFrame, ref: str) -> DataFrame:
    return resolution(components.where((F.col("name") == ref) | F.contains("qualified_name", F.lit(ref))), F.col("name") == ref)
