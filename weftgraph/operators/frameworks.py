"""Components, entrypoints and interfaces from facts about annotations, by tables of rules.

Facts: types (id, name, interface, parents: names of what it extends or implements), members (type, name,
kind: `method` or `field`, static, public, type_name, parameter_types), annotations (ord, type, member: null
for the type's own, name without package, attributes as a map).  A framework's rules are data; of the rules
that a type meets the first counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.  Framework: (where, annotations, component type, technology, stereotype), the first that holds counts.
#: `type`: the type bears one of them; `method`, `field`: one of its members does; `any`: either; `parent`: a supertype has that name.
COMPONENTS = {
    "spring": (
        ("type", ("Entity",), "ENTITY", "jpa", "entity"),
        ("type", ("SpringBootApplication",), "SERVICE", "spring-boot", "spring-boot-application"),
        ("type", ("FeignClient",), "HTTP_CLIENT", "spring", "feign-client"),
        ("type", ("RestController", "Controller"), "REST_RESOURCE", "spring", "controller"),
        ("type", ("Service",), "SERVICE", "spring", "service"),
        ("type", ("Repository",), "REPOSITORY", "spring", "repository"),
        ("type", ("Configuration",), "SERVICE", "spring", "configuration"),
        ("method", ("Scheduled",), "SCHEDULER", "spring", "scheduled"),
        ("any", ("KafkaListener", "RabbitListener", "JmsListener"), "MESSAGE_DRIVEN_BEAN", "spring", "messaging-listener"),
        ("type", ("Component",), "SERVICE", "spring", "component"),
    ),
    "quarkus": (
        ("type", ("Entity",), "ENTITY", "jpa", "entity"),
        ("type", ("RegisterRestClient", "RestClient"), "HTTP_CLIENT", "microprofile-rest-client", "rest-client"),
        ("type", ("Path",), "REST_RESOURCE", "quarkus", "jax-rs"),
        ("type", ("ServerEndpoint",), "REST_RESOURCE", "websocket", "websocket"),
        ("type", ("GrpcService",), "REST_RESOURCE", "grpc", "grpc"),
        ("parent", ("BindableService",), "REST_RESOURCE", "grpc", "grpc"),
        ("method", ("Scheduled", "Schedule"), "SCHEDULER", "quarkus", "scheduled"),
        ("method", ("Incoming", "Outgoing"), "", "quarkus", "messaging"),
        ("field", ("Channel",), "", "quarkus", "messaging"),
        ("type", ("ApplicationScoped", "RequestScoped", "SessionScoped", "Singleton"), "", "quarkus", ""),
    ),
    "javaee": (
        ("type", ("Stateless",), "EJB_STATELESS", "javaee", "ejb-stateless"),
        ("type", ("Stateful",), "EJB_STATEFUL", "javaee", "ejb-stateful"),
        ("type", ("Singleton",), "EJB_SINGLETON", "javaee", "ejb-singleton"),
        ("type", ("MessageDriven",), "MESSAGE_DRIVEN_BEAN", "javaee", "mdb"),
        ("type", ("Path",), "REST_RESOURCE", "javaee", "jax-rs"),
        ("type", ("Entity",), "ENTITY", "jpa", "entity"),
    ),
}
#: Endings of a bean's name and what they make it, for rules that leave the component type open.
ENDINGS = ((("repository", "repo", "dao"), "REPOSITORY", "repository"), (("service",), "SERVICE", "service"), (("client", "proxy"), "HTTP_CLIENT", "client"))
#: Plain classes, by a part of the qualified name, or an ending of the simple one.
PLAIN = (
    ((".model.", ".dto."), (), "ENTITY"),
    ((), ("repository", "dao"), "REPOSITORY"),
    ((), ("client", "proxy"), "HTTP_CLIENT"),
    ((), ("renderer", "tool", "extractor", "merger", "scanner", "cache", "server"), "SERVICE"),
    ((".util.",), ("utils",), "UTILITY"),
)
#: Annotations of mapped methods and of listeners (entrypoint type, broker, attributes with the channel).
MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH")
HTTP = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
LISTENERS = {"KafkaListener": ("MESSAGING_CONSUMER", "KAFKA", ("topics", "topicPattern")), "RabbitListener": ("MESSAGING_CONSUMER", "RABBITMQ", ("queues", "bindings")), "JmsListener": ("JMS_CONSUMER", "JMS", ("destination",))}
EVENT_PARENTS = ("PostInsertEventListener", "PostUpdateEventListener", "PostDeleteEventListener")
EVENT_METHODS = ("onPostInsert", "onPostUpdate", "onPostDelete")
RUNNERS = ("ApplicationRunner", "CommandLineRunner")
UNRESOLVED = "(unresolved)"

_ENTRY = "struct<kind:string,suffix:string,http_method:string,path:string,channel:string,broker:string,trigger_kind:string,trigger:string>"


def rule_rows(framework: str) -> list[tuple]:
    """rank, place, annotation, component_type, technology, stereotype: the rules as rows."""
    return [(rank, place, name, component, technology, stereotype) for rank, (place, names, component, technology, stereotype) in enumerate(COMPONENTS[framework]) for name in names]


def placeholders_resolved(df: DataFrame, column: str, config: DataFrame) -> DataFrame:
    """`column` with every `${key}` replaced whose key the configuration (key, value) has."""
    from weftgraph.sources.store import checkpointed

    marked = checkpointed(df.withColumn("_row", F.monotonically_increasing_id()), "placeholders")
    keys = marked.select("_row", F.explode(F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(r"\$\{([^}]+)\}"), F.lit(1)))).alias("key"))
    found = keys.join(config.select("key", F.col("value").alias("_value")), "key").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("key", "_value"))).alias("_found"))
    filled = F.aggregate("_found", F.col(column), lambda text, kv: F.replace(text, F.concat(F.lit("${"), kv["key"], F.lit("}")), kv["_value"]))
    return marked.join(found, "_row", "left").withColumn(column, F.when(F.col("_found").isNotNull(), filled).otherwise(F.col(column))).drop("_row", "_found")


def _marks(annotations: DataFrame) -> DataFrame:
    """type, member, marks: the first annotation of each name on each element, as a map from name to attributes."""
    first = annotations.groupBy("type", "member", "name").agg(F.min_by("attributes", "ord").alias("attributes"))
    return first.groupBy("type", "member").agg(F.map_from_entries(F.collect_list(F.struct("name", F.coalesce("attributes", F.create_map().cast("map<string,string>"))))).alias("marks"))


def components(types: DataFrame, members: DataFrame, annotations: DataFrame, framework: str) -> DataFrame:
    """id, component_type, technology, stereotypes (joined by commas) of the types that a framework's rules make components."""
    spark = types.sparkSession
    rules = F.broadcast(spark.createDataFrame(rule_rows(framework), "rank int, place string, mark string, component_type string, technology string, stereotype string"))
    kinds = members.select("type", F.col("name").alias("member"), "kind").distinct()
    on_type = annotations.where("member is null").select("type", F.lit("type").alias("on"), F.col("name").alias("mark"))
    on_member = annotations.where("member is not null").join(kinds, ["type", "member"]).select("type", F.col("kind").alias("on"), F.col("name").alias("mark"))
    parents = types.select(F.col("id").alias("type"), F.lit("parent").alias("on"), F.explode("parents").alias("mark"))
    met = on_type.unionByName(on_member).unionByName(parents).join(rules, "mark").where((F.col("place") == F.col("on")) | ((F.col("place") == "any") & F.col("on").isin("type", "method")))
    best = met.groupBy("type").agg(F.min("rank").alias("rank"), F.max(F.col("stereotype") == "messaging").alias("messaging"))
    each = spark.createDataFrame([(rank, component, technology, stereotype) for rank, (_, _, component, technology, stereotype) in enumerate(COMPONENTS[framework])], "rank int, component_type string, technology string, stereotype string")
    named = types.join(best.withColumnRenamed("type", "id"), "id").join(F.broadcast(each), "rank")
    kind, first = F.lit("SERVICE"), F.lit(None).cast("string")
    for endings, component, stereotype in reversed(ENDINGS):
        ends = F.lit(False)
        for e in endings:
            ends = ends | F.endswith(F.lower("name"), F.lit(e))
        kind, first = F.when(ends, component).otherwise(kind), F.when(ends, stereotype).otherwise(first)
    by_name = F.col("component_type") == ""
    stereotypes = F.when(by_name, F.concat_ws(",", first, F.when(F.col("messaging"), "messaging"))).otherwise(F.concat_ws(",", "stereotype", F.when(F.col("interface") & (F.col("stereotype") == "rest-client"), "interface")))
    return named.select("id", F.when(by_name, kind).otherwise(F.col("component_type")).alias("component_type"), "technology", stereotypes.alias("stereotypes"))


def plain_type(qualified_name: Column, name: Column) -> Column:
    """Component type of a class that no framework claims."""
    out = F.lit("UNKNOWN")
    for parts, endings, component in reversed(PLAIN):
        holds = F.lit(False)
        for part in parts:
            holds = holds | F.contains(F.lower(qualified_name), F.lit(part))
        for e in endings:
            holds = holds | F.endswith(F.lower(name), F.lit(e))
        out = F.when(holds, component).otherwise(out)
    return out


def joined_path(base: Column, child: Column) -> Column:
    """Two parts of a path with one slash between, one in front and none doubled."""
    base, child = F.coalesce(base, F.lit("")), F.coalesce(child, F.lit(""))
    between = F.when(~F.endswith(base, F.lit("/")) & ~F.startswith(child, F.lit("/")) & (child != ""), F.concat(base, F.lit("/"), child)).otherwise(F.concat(base, child))
    return F.regexp_replace(F.concat(F.lit("/"), between), "/+", "/")


def _has(marks: Column, *names: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.coalesce(F.map_contains_key(marks, n), F.lit(False))
    return out


def _attribute(marks: Column, names: tuple[str, ...], *attributes: str) -> Column:
    """The first attribute that is there and not empty of the first of the annotations that is; else empty."""
    found = [F.when(F.try_element_at(F.try_element_at(marks, F.lit(n)), F.lit(a)) != "", F.try_element_at(F.try_element_at(marks, F.lit(n)), F.lit(a))) for n in names for a in attributes]
    return F.coalesce(*found, F.lit(""))


def _entry(when: Column, kind: str | Column, suffix: str | Column, **values: Column) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    fields = [lit(kind).alias("kind"), lit(suffix).alias("suffix"), *(lit(values.get(c, F.lit(None))).cast("string").alias(c) for c in ("http_method", "path", "channel", "broker", "trigger_kind", "trigger"))]
    return F.when(when, F.struct(*fields).cast(_ENTRY))


def _triggers(marks: Column, names: tuple[str, ...], *kinds: tuple[str, tuple[str, ...]]) -> tuple[Column, Column]:
    """Kind and expression of a schedule: the first kind with an attribute."""
    kind, expression = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, attributes in reversed(kinds):
        value = _attribute(marks, names, *attributes)
        kind, expression = F.when(value != "", k).otherwise(kind), F.when(value != "", value).otherwise(expression)
    return kind, expression


def _spring(m: Column, on_type: Column, context: str) -> list[Column]:
    paths = (("RequestMapping", "value"), ("RequestMapping", "path"), *((n, a) for n in MAPPINGS for a in ("value", "path")))
    path = lambda marks: F.coalesce(*(F.when(_attribute(marks, (n,), a) != "", _attribute(marks, (n,), a)) for n, a in paths), F.lit(""))
    asked = F.lit("REQUEST")
    for v in reversed(VERBS):
        asked = F.when(F.contains(_attribute(m, ("RequestMapping",), "method"), F.lit(v)), v).otherwise(asked)
    verb = F.when(_has(m, "RequestMapping"), asked)
    for n, v in reversed(MAPPINGS.items()):
        verb = F.when(_has(m, n), v).otherwise(verb)
    full = joined_path(F.lit(context), joined_path(path(on_type), path(m)))
    kind, expression = _triggers(m, ("Scheduled",), ("CRON", ("cron",)), ("FIXED_RATE", ("fixedRate", "fixedRateString")), ("FIXED_DELAY", ("fixedDelay", "fixedDelayString")))
    out = [
        _entry(verb.isNotNull() & (F.col("component_type") != "HTTP_CLIENT"), "REST_ENDPOINT", F.concat_ws(":", verb, full), http_method=verb, path=full),
        _entry(_has(m, "Scheduled"), "SCHEDULER", "scheduled", trigger_kind=kind, trigger=expression),
    ]
    heard = [(n, m, _has(m, n)) for n in LISTENERS] + [("KafkaListener", on_type, _has(on_type, "KafkaListener") & _has(m, "KafkaHandler"))]
    for name, marks, when in heard:
        entry, broker, attributes = LISTENERS[name]
        channel = _attribute(marks, (name,), *attributes)
        channel = F.when(F.trim(channel) == "", UNRESOLVED).otherwise(channel)
        out.append(_entry(when, entry, F.concat_ws(":", F.lit("spring-listener"), F.lit(broker), channel), channel=channel, broker=F.lit(broker)))
    out.append(_entry(((F.col("name") == "main") & F.col("static")) | ((F.col("name") == "run") & F.arrays_overlap("parents", F.array(*map(F.lit, RUNNERS)))), "MAIN_METHOD", "startup"))
    out.append(_entry(F.col("name").isin(*EVENT_METHODS) & F.arrays_overlap("parents", F.array(*map(F.lit, EVENT_PARENTS))), "ENTITY_EVENT_LISTENER", "entity-event"))
    return out


def _verb(m: Column, verbs: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.when(_has(m, v), v) for v in verbs))


def _quarkus(m: Column, on_type: Column) -> list[Column]:
    grpc, socket, verb = F.col("technology") == "grpc", _has(m, "OnMessage"), _verb(m, HTTP)
    full = joined_path(_attribute(on_type, ("Path",), "value"), _attribute(m, ("Path",), "value"))
    produces = F.coalesce(F.when(_attribute(m, ("Produces",), "value") != "", _attribute(m, ("Produces",), "value")), _attribute(on_type, ("Produces",), "value"))
    sinks = F.array(F.lit("SseEventSink"), F.lit("Sse"))
    sse = F.contains(produces, F.lit("text/event-stream")) | F.contains(produces, F.lit("SERVER_SENT_EVENTS")) | F.coalesce(F.array_contains(sinks, F.col("type_name")), F.lit(False)) | F.coalesce(F.arrays_overlap("parameter_types", sinks), F.lit(False))
    rest = verb.isNotNull() & (F.col("component_type") != "HTTP_CLIENT")
    method, further = (F.col("kind") == "method") & ~grpc, (F.col("kind") == "method") & ~grpc & ~socket & ~rest
    kind, expression = _triggers(m, ("Scheduled", "Schedule"), ("CRON", ("cron",)), ("EVERY", ("every",)))
    out = [
        _entry((F.col("kind") == "method") & grpc & F.col("public") & (F.col("name") != "bindService"), "GRPC_METHOD", "grpc", path=F.concat(F.col("owner_name"), F.lit("/"), F.col("name"))),
        _entry(method & socket, "WEBSOCKET_ENDPOINT", "websocket", path=_attribute(on_type, ("ServerEndpoint",), "value")),
        _entry(method & ~socket & rest, F.when(sse, "SSE_ENDPOINT").otherwise("REST_ENDPOINT"), F.when(sse, "sse").otherwise(""), http_method=verb, path=full),
        _entry(further & _has(m, "Scheduled", "Schedule"), "SCHEDULER", "scheduled", trigger_kind=kind, trigger=expression),
    ]
    for name, entry, suffix, where in (("Incoming", "MESSAGING_CONSUMER", "msg-in", further), ("Outgoing", "MESSAGING_PRODUCER", "msg-out", further), ("Channel", "MESSAGING_PRODUCER", "emitter", (F.col("kind") == "field") & ~grpc)):
        channel = _attribute(m, (name,), "value")
        out.append(_entry(where & (channel != ""), entry, F.concat_ws(":", F.lit(suffix), channel), channel=channel, broker=F.lit("UNKNOWN")))
    return out


def _javaee(m: Column, on_type: Column) -> list[Column]:
    verb = _verb(m, VERBS)
    full = joined_path(_attribute(on_type, ("Path",), "value"), _attribute(m, ("Path",), "value"))
    return [
        _entry(verb.isNotNull(), "REST_ENDPOINT", "", http_method=verb, path=full),
        _entry(verb.isNull() & (F.col("component_type") == "MESSAGE_DRIVEN_BEAN") & (F.col("name") == "onMessage"), "JMS_CONSUMER", ""),
    ]


def entrypoints(found: DataFrame, types: DataFrame, members: DataFrame, annotations: DataFrame, framework: str, context: str = "") -> DataFrame:
    """type, member, kind, suffix, http_method, path, channel, broker, trigger_kind, trigger of a framework's components.

    One of each type, member and suffix.  `context` is the path that all of an application's REST paths start with.
    """
    marks = _marks(annotations)
    on_type = marks.where("member is null").select("type", F.col("marks").alias("on_type"))
    on_member = marks.where("member is not null").select("type", F.col("member").alias("name"), "marks")
    known = found.select(F.col("id").alias("type"), "component_type", "technology").join(types.select(F.col("id").alias("type"), F.col("name").alias("owner_name"), "parents"), "type")
    rows = members.join(known, "type").join(on_member, ["type", "name"], "left").join(on_type, "type", "left")
    empty = F.create_map().cast("map<string,map<string,string>>")
    rows = rows.withColumn("marks", F.coalesce("marks", empty)).withColumn("on_type", F.coalesce("on_type", empty))
    if framework == "spring":
        rows, made = rows.where("kind = 'method'"), _spring(F.col("marks"), F.col("on_type"), context)
    elif framework == "quarkus":
        made = _quarkus(F.col("marks"), F.col("on_type"))
    else:
        rows, made = rows.where("kind = 'method'"), _javaee(F.col("marks"), F.col("on_type"))
    each = rows.select("type", F.col("name").alias("member"), F.explode(F.filter(F.array(*made), lambda e: e.isNotNull())).alias("e")).select("type", "member", "e.*")
    rest = [c for c in each.columns if c not in ("type", "member", "suffix")]
    return each.groupBy("type", "member", "suffix").agg(F.min(F.struct(*rest)).alias("e")).select("type", "member", "suffix", "e.*")


def interfaces(entries: DataFrame) -> DataFrame:
    """id, type, name, path, component, broker, topic of the interfaces that entrypoints offer or use."""
    kind = (
        F.when(F.col("kind") == "REST_ENDPOINT", "rest_endpoint").when(F.col("kind") == "SSE_ENDPOINT", "sse_endpoint").when(F.col("kind") == "JMS_CONSUMER", F.when(F.col("channel").isNotNull(), "jms_consumer"))
        .when(F.col("kind") == "MESSAGING_CONSUMER", "messaging_consumer").when(F.col("kind") == "MESSAGING_PRODUCER", "messaging_producer")
    )
    rest = F.col("kind").isin("REST_ENDPOINT", "SSE_ENDPOINT")
    name = F.when(rest, F.concat_ws(" ", "http_method", "path")).otherwise(F.col("channel"))
    some = entries.select(kind.alias("type"), name.alias("name"), F.when(rest, F.col("path")).otherwise(F.col("channel")).alias("path"), F.col("type").alias("component"), "broker", F.when(~rest, F.col("channel")).alias("topic")).where("type is not null")
    return some.select(F.concat_ws(":", F.lit("iface"), "component", "type", "name").alias("id"), "*").groupBy("id").agg(*(F.min(c).alias(c) for c in ("type", "name", "path", "component", "broker", "topic")))
