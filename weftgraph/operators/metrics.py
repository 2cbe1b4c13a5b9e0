"""Degrees, relevance, classification and evidence bands as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word lists and weights of the relevance and role rules (fixed values).
NOISY_NAMES = ("formatter", "parser", "mapper", "logger", "logging", "config", "configuration")
DATA_NAMES = ("dto", "request", "response", "properties", "constants")
NOISY_PACKAGES = (".util", ".utils", ".common", ".config", ".logging", ".dto", ".mapper")
BUSINESS_TYPES = ("REST_RESOURCE", "SERVICE", "REPOSITORY", "ENTITY", "EJB_STATELESS", "EJB_STATEFUL", "EJB_SINGLETON", "MESSAGE_DRIVEN_BEAN", "SCHEDULER", "HTTP_CLIENT", "CDI_EVENT_CONSUMER", "CDI_EVENT_PRODUCER", "REMOTE_SERVICE")
BOUNDARY_TYPES = ("REST_RESOURCE", "MESSAGE_DRIVEN_BEAN", "SCHEDULER")
NAME_ROLES = (("formatter", ("formatter",)), ("parser", ("parser",)), ("mapper", ("mapper",)), ("logging", ("logger", "logging")), ("configuration", ("config", "configuration", "properties")))
TYPE_ROLES = {
    "REST_RESOURCE": ("entrypoint", "entrypoint"),
    "SERVICE": ("business-service", "business-service"),
    "EJB_STATELESS": ("business-service", "business-service"),
    "EJB_STATEFUL": ("business-service", "business-service"),
    "EJB_SINGLETON": ("business-service", "business-service"),
    "REPOSITORY": ("repository", "data-access"),
    "ENTITY": ("domain-entity", "domain-model"),
    "MESSAGE_DRIVEN_BEAN": ("message-consumer", "entrypoint"),
    "SCHEDULER": ("scheduler", "entrypoint"),
    "HTTP_CLIENT": ("external-client", "integration"),
    "REMOTE_SERVICE": ("external-client", "integration"),
    "CDI_EVENT_CONSUMER": ("event-bus", "integration"),
    "CDI_EVENT_PRODUCER": ("event-bus", "integration"),
    "UTILITY": ("utility", "support"),
    "UNKNOWN": ("unknown", "unknown"),
}


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words)), F.lit(False))


def _role(kind: Column, at: int) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for t, roles in TYPE_ROLES.items():
        out = out.when(kind == t, F.lit(roles[at]))
    return out


def degrees(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """id, fan_in, fan_out, degree for every node; one shuffle of edge ends, pre-aggregated."""
    e = edges.where(F.col("label") == label)
    ends = e.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(e.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    n = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    out = nodes.select("id").join(n, "id", "left")
    return out.select("id", F.coalesce("i", F.lit(0)).cast("long").alias("fan_in"), F.coalesce("o", F.lit(0)).cast("long").alias("fan_out"), (F.coalesce("i", F.lit(0)) + F.coalesce("o", F.lit(0))).cast("long").alias("degree"))


def owned_entrypoints(components: DataFrame, entrypoints: DataFrame) -> DataFrame:
    n = entrypoints.groupBy(F.col("component_id").alias("id")).agg(F.count("*").alias("n"))
    return components.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("owned"))


def state_counts(components: DataFrame, accesses: DataFrame) -> DataFrame:
    """id, reads, writes and those on another component's fields."""
    cross = F.col("component_id") != F.col("owner_id")
    read, write = F.col("kind") == "READ", F.col("kind") == "WRITE"
    n = accesses.groupBy(F.col("component_id").alias("id")).agg(*(F.count(F.when(c, 1)).alias(k) for k, c in (("reads", read), ("writes", write), ("cross_reads", read & cross), ("cross_writes", write & cross))))
    return components.select("id").join(n, "id", "left").select("id", *(F.coalesce(k, F.lit(0)).alias(k) for k in ("reads", "writes", "cross_reads", "cross_writes")))


def relevance(metrics: DataFrame) -> DataFrame:
    """Scores of components with type, name, package, fan_in, fan_out, owned, cross_reads, cross_writes, handoffs_in, handoffs_out."""
    name, package, kind = F.lower("name"), F.lower("package"), F.col("type")
    noise = F.when(kind == "UTILITY", 3).when(kind == "UNKNOWN", 2).otherwise(0)
    noise = noise + has_any(name, NOISY_NAMES).cast("int") * 2 + has_any(name, DATA_NAMES).cast("int") + has_any(package, NOISY_PACKAGES).cast("int")
    m = metrics.withColumn("noise_score", noise)
    role = F.when(kind == "UTILITY", "utility")
    for r, words in NAME_ROLES:
        role = role.when(has_any(name, words), r)
    role = role.when(F.col("noise_score") >= 4, "utility").otherwise(_role(kind, 0))
    m = m.withColumns({"infrastructure_role": role, "business_relevant": (F.col("noise_score") < 4) & kind.isin(*BUSINESS_TYPES)})
    raw = (kind == "SCHEDULER").cast("int") + F.col("cross_reads") + F.col("cross_writes") + 3 * (F.col("handoffs_in") + F.col("handoffs_out"))
    m = m.withColumn("bridge_score", F.when(F.col("business_relevant"), raw).otherwise(F.least(raw, F.lit(2))))
    active = (F.col("owned") > 0) | (F.col("fan_out") > 0) | (F.col("bridge_score") > 0) | kind.isin(*BOUNDARY_TYPES)
    weight = F.least("fan_in", F.lit(3)) + F.col("fan_out") + 4 * F.col("owned") + 3 * F.col("bridge_score") + 2 * F.col("business_relevant").cast("int") - 2 * F.col("noise_score")
    return m.withColumns({"workflow_relevant": F.col("business_relevant") & active, "weight": F.greatest(F.lit(0), weight)})


def classify(metrics: DataFrame) -> DataFrame:
    """primary_role, support_role and agent_category, by the first rule that holds."""
    name, package, kind = F.lower("name"), F.lower("package"), F.col("type")
    configured = F.contains(package, F.lit("config"))
    support = (
        F.when(has_any(package, ("authorization", "security")) & configured, "security-configuration")
        .when(has_any(package, ("redis",)) & has_any(name, ("lock", "registry")), "redis-lock")
        .when(has_any(name, ("flyway", "initializer", "migration")) & has_any(package, ("infrastructure", "migration")), "migration-initializer")
        .when(has_any(package, ("multitenant", "tenant")) & has_any(name, ("tenant",)), "tenant-infrastructure")
        .when(configured | has_any(name, ("config", "configuration", "properties")), "configuration")
        .when(has_any(package, ("mapper", "mapping")) | has_any(name, ("mapper",)), "mapper")
        .when(has_any(package, ("converter",)) | has_any(name, ("converter",)), "converter")
        .when(has_any(package, ("validation",)) | has_any(name, ("validator", "validation")), "validator")
        .when(has_any(name, ("application",)) & (kind == "SERVICE"), "application-bootstrap")
        .when((kind == "UTILITY") | has_any(package, (".util", ".utils")), "utility")
    )
    m = metrics.withColumn("support_role", support)
    m = m.withColumn("primary_role", F.when(F.col("support_role").isNotNull(), "support").otherwise(_role(kind, 1)))
    role = F.col("primary_role")
    busy = (F.col("fan_out") > 0) | (F.col("owned") > 0)
    category = (
        F.when(F.col("support_role").isNotNull() | (role == "support"), "supporting-infrastructure")
        .when(role == "entrypoint", "boundary")
        .when(role.isin("data-access", "domain-model"), "data")
        .when(role == "integration", "integration")
        .when((role == "business-service") & busy, "core-workflow")
        .when(role == "business-service", "supporting-infrastructure")
        .otherwise("low-signal")
    )
    return m.withColumn("agent_category", category)


def evidence(df: DataFrame, ambiguous: Column | None = None) -> DataFrame:
    """confidence_band of a confidence column, and the ambiguous flag that follows from it."""
    c = F.col("confidence")
    flagged = F.coalesce(ambiguous, F.lit(False)) if ambiguous is not None else F.lit(False)
    band = F.when(flagged, "ambiguous").when(c >= 0.9, "known").when(c >= 0.6, "inferred").when(c > 0, "ambiguous").otherwise("unknown")
    return df.withColumn("confidence_band", band).withColumn("ambiguous", F.col("confidence_band") == "ambiguous")


def priority(scored: DataFrame, k: int) -> DataFrame:
    """The k most relevant components, as a top-k."""
    return scored.orderBy(F.desc("workflow_relevant"), F.desc("business_relevant"), F.desc("bridge_score"), "noise_score", F.desc("weight"), "name").limit(max(1, k))
