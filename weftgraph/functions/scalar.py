"""Scalar functions as column expressions: names, protocols and scores of facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Protocol of each entrypoint type (fixed values).
PROTOCOLS = {
    "REST_ENDPOINT": "http",
    "JMS_CONSUMER": "jms",
    "MESSAGING_CONSUMER": "messaging",
    "MESSAGING_PRODUCER": "messaging",
    "CDI_EVENT_OBSERVER": "event",
    "SCHEDULER": "scheduler",
    "EJB_BUSINESS_METHOD": "ejb",
    "RMI_ENDPOINT": "rmi",
    "MAIN_METHOD": "main",
    "EVENT_BUS_CONSUMER": "event-bus",
    "WEBSOCKET_ENDPOINT": "websocket",
    "SSE_ENDPOINT": "sse",
    "GRPC_METHOD": "grpc",
    "ENTITY_EVENT_LISTENER": "entity-event",
    "UNKNOWN": "unknown",
}

#: Confidence of each kind of evidence for a call's receiver (fixed values).
RECEIVER_EVIDENCE = {
    "CONSTRUCTOR_ASSIGNMENT": 0.90,
    "DECLARED_FIELD_TYPE": 0.85,
    "LOCAL_ASSIGNMENT": 0.85,
    "ACCESSOR_RETURN": 0.80,
    "ARRAY_ELEMENT_ALLOCATION": 0.78,
    "COLLECTION_ELEMENT_ALLOCATION": 0.75,
    "GENERIC_ELEMENT_TYPE": 0.70,
    "SMALL_POLYMORPHIC_EXPANSION": 0.65,
    "ACCESSOR_STATE_OWNER": 0.60,
    "DECLARED_INTERFACE_ONLY": 0.55,
    "ACCESSOR_NAME_FALLBACK": 0.20,
}

#: Component types that are no architectural targets (fixed values).
PASSIVE = ("ENTITY", "UTILITY", "UNKNOWN")


def lookup(key: Column, table: dict) -> Column:
    """Value of a fixed table; null where it has none."""
    out = F.when(F.lit(False), F.lit(next(iter(table.values()))))
    for k, v in table.items():
        out = out.when(key == k, F.lit(v))
    return out


def protocol(kind: Column) -> Column:
    return lookup(kind, PROTOCOLS)


def title(name: Column) -> Column:
    """`camelCase-and_snake` as `Camel Case And Snake`."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "[-_]", " "), "([a-z])([A-Z])", "$1 $2")
    return F.initcap(F.trim(F.regexp_replace(spaced, r"\s+", " ")))


def use_case_name(kind: Column, name: Column, method: Column, channel: Column, path: Column, given: Column | None = None) -> Column:
    """Display name of an entrypoint's use case; a given name comes first."""
    derived = (
        F.when(kind == "REST_ENDPOINT", F.concat_ws(" ", method, title(name)))
        .when(kind == "MESSAGING_CONSUMER", F.concat(F.lit("Process "), title(F.coalesce(channel, name))))
        .when(kind == "MESSAGING_PRODUCER", F.concat(F.lit("Publish "), title(F.coalesce(channel, name))))
        .when(kind == "SCHEDULER", F.concat(F.lit("Scheduled: "), title(name)))
        .when(kind == "CDI_EVENT_OBSERVER", F.concat(F.lit("On Event: "), F.coalesce(path, name)))
        .when(kind == "JMS_CONSUMER", F.concat(F.lit("Consume "), title(name)))
        .otherwise(title(name))
    )
    return derived if given is None else F.coalesce(given, derived)


def dependency_score(annotated: Column, same_module: Column, target: Column) -> Column:
    """Confidence of a dependency: annotations say more than types; two digits."""
    by_annotation = F.lit(0.9) + target.isin("REPOSITORY", "REMOTE_SERVICE").cast("int") * 0.03
    by_type = F.lit(0.55) + F.coalesce(same_module, F.lit(False)).cast("int") * 0.05 + (~target.isin(*PASSIVE)).cast("int") * 0.05
    return F.round(F.when(annotated, by_annotation).otherwise(by_type), 2)
