"""Readers of build, configuration and deployment files into tables.

Files are read whole by Spark, from any store it reads; XML goes through Spark's XPath functions and build
scripts through regular expressions.  YAML has no built-in reader: its (small) files are parsed in Arrow batches.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of one module, later ones override earlier ones key by key (fixed values).
CONFIG_FILES = ("application.properties", "application.yaml", "application.yml")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, folder, name and value of text files."""
    at = F.col("_metadata.file_path")
    return spark.read.text(path, wholetext=True).select(at.alias("path"), F.regexp_extract(at, r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract(at, r"([^/]*)$", 1).alias("name"), "value")


def without_namespaces(xml):
    """XPath 1.0 names match no namespaces: declarations and prefixes of elements are taken off."""
    plain = F.regexp_replace(F.regexp_replace(xml, r"<\?xml[^>]*\?>|<!DOCTYPE[^>]*>", ""), r"\sxmlns(:\w+)?\s*=\s*(\"[^\"]*\"|'[^']*')", "")
    return F.regexp_replace(F.regexp_replace(plain, r"(</?)[\w.-]+:", "$1"), r"\s[\w.-]+:([\w.-]+\s*=)", " $1")


def read_maven(poms: DataFrame) -> DataFrame:
    """folder, artifact, packaging (jar if none is named), modules of pom files (columns folder, value)."""
    x = poms.withColumn("x", without_namespaces(F.col("value")))
    packaging = F.trim(F.xpath_string("x", F.lit("/project/packaging")))
    return x.select("folder", F.xpath_string("x", F.lit("/project/artifactId")).alias("artifact"), F.when(packaging == "", "jar").otherwise(packaging).alias("packaging"), F.xpath("x", F.lit("/project/modules/module/text()")).alias("modules"))


def leaf_modules(poms: DataFrame) -> DataFrame:
    """folder, artifact, packaging, parent of the modules that name no modules themselves; the parent is the pom that names them."""
    m = read_maven(poms)
    inner = m.select(F.col("artifact").alias("parent"), F.explode("modules").alias("sub"), "folder").select("parent", F.concat_ws("/", "folder", F.trim("sub")).alias("folder"))
    named = m.join(inner, "folder", "left")
    return named.where(F.size("modules") == 0).select("folder", "artifact", "packaging", "parent")


def read_gradle_includes(settings: DataFrame) -> DataFrame:
    """folder, include of settings scripts: every quoted name on lines that start with include."""
    line = settings.select("folder", F.explode(F.split("value", r"\R")).alias("line")).where(F.startswith(F.trim("line"), F.lit("include")))
    return line.select("folder", F.explode(F.regexp_extract_all("line", F.lit("[\"']([^\"']+)[\"']"), F.lit(1))).alias("include"))


def read_gradle_plugins(scripts: DataFrame) -> DataFrame:
    """folder, plugins (sorted), packaging of build scripts: Groovy and Kotlin ids, java-library, and a line that only says java."""
    v = F.col("value")
    ids = F.concat(F.regexp_extract_all(v, F.lit(r"id\s*[\"']([^\"']+)[\"']"), F.lit(1)), F.regexp_extract_all(v, F.lit(r"id\s*\(\s*[\"']([^\"']+)[\"']\s*\)"), F.lit(1)))
    more = F.array_compact(F.array(F.when(F.contains(v, F.lit("java-library")), "java-library"), F.when(v.rlike(r"(?m)^[ \t]*java[ \t]*$"), "java")))
    x = scripts.select("folder", F.array_sort(F.array_distinct(F.concat(ids, more))).alias("plugins"))
    has = lambda p: F.array_contains("plugins", p)
    return x.withColumn("packaging", F.when(has("war"), "war").when(has("org.springframework.boot"), "boot-jar").when(has("java") | has("java-library"), "jar").otherwise("unknown"))


def read_persistence_xml(files: DataFrame) -> DataFrame:
    """folder, unit, datasource (JTA before non-JTA; null if none), classes of persistence.xml files."""
    x = files.select("folder", without_namespaces(F.col("value")).alias("x"))
    x = x.select("folder", "x", F.posexplode(F.xpath("x", F.lit("/persistence/persistence-unit/@name"))).alias("i", "unit"))
    # Spark's XPath takes no path from a column: each unit's own text is picked by its place
    parts = F.regexp_extract_all("x", F.lit(r"(?s)<persistence-unit\s.*?(?:</persistence-unit>|/>)"), F.lit(0))
    one = F.get(parts, F.col("i"))
    jta, local = F.trim(F.xpath_string(one, F.lit("//jta-data-source"))), F.trim(F.xpath_string(one, F.lit("//non-jta-data-source")))
    return x.select("folder", "unit", F.coalesce(F.when(jta != "", jta), F.when(local != "", local)).alias("datasource"), F.xpath(one, F.lit("//class/text()")).alias("classes"))


def _flat(value, prefix=""):
    if isinstance(value, dict):
        for k, v in value.items():
            yield from _flat(v, f"{prefix}.{_text(k)}" if prefix else _text(k))
    elif value is not None:
        yield prefix, _text(value)


def _text(value) -> str:
    """As written in YAML: true and false in lower case, lists in brackets."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, list):
        return "[" + ", ".join(map(_text, value)) + "]"
    return str(value)


def read_yaml(files: DataFrame) -> DataFrame:
    """folder, name, key, value of YAML files: nested keys joined by a dot, nulls left out; a file that is no mapping, or no YAML, has none."""

    def run(batches):
        import yaml

        for b in batches:
            out = []
            for folder, name, value in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    root = yaml.safe_load(value)
                except yaml.YAMLError:
                    continue
                if isinstance(root, dict):
                    out += [(folder, name, k, v) for k, v in _flat(root)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in list(zip(*out)) or [()] * 4], ["folder", "name", "key", "value"])

    return files.select("folder", "name", "value").mapInArrow(run, "folder string, name string, key string, value string")


def read_config(files: DataFrame) -> DataFrame:
    """folder, key, value, source of a module's configuration: .properties, then .yaml, then .yml, the last file that has a key wins."""
    mine = files.where(F.col("name").isin(*CONFIG_FILES))
    line = mine.where("name like '%.properties'").select("folder", "name", F.posexplode(F.split("value", r"\R")).alias("at", "line"))
    line = line.where(~F.trim("line").rlike("^[#!]"))
    pair = r"^\s*([^=:\s]+)\s*[=:\s]\s*(.*)$"
    plain = line.select("folder", "name", F.regexp_extract("line", pair, 1).alias("key"), F.regexp_extract("line", pair, 2).alias("value"), "at").where("key <> ''")
    nested = read_yaml(mine.where("name not like '%.properties'")).withColumn("at", F.lit(0))
    order = F.struct(F.array_position(F.array(*map(F.lit, CONFIG_FILES)), F.col("name")).alias("file"), "at")
    return plain.unionByName(nested).groupBy("folder", "key").agg(F.max_by("value", order).alias("value"), F.max_by("name", order).alias("source"))


def read_compose(files: DataFrame) -> DataFrame:
    """folder, service, ports, depends_on of Compose files; dependencies are a list or the keys of a mapping."""

    def run(batches):
        import yaml

        kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
        for b in batches:
            out = []
            for folder, value in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    root = yaml.safe_load(value)
                except yaml.YAMLError:
                    continue
                services = root.get("services") if isinstance(root, dict) else None
                for name, s in (services.items() if isinstance(services, dict) else ()):
                    s = s if isinstance(s, dict) else {}
                    listed = lambda v: [_text(x) for x in v] if isinstance(v, (list, dict)) else []
                    ports = s.get("ports")
                    out.append((folder, str(name), listed(ports) if isinstance(ports, list) else [], listed(s.get("depends_on"))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, kinds)], ["folder", "service", "ports", "depends_on"])

    return files.select("folder", "value").mapInArrow(run, "folder string, service string, ports array<string>, depends_on array<string>")


def deployments(compose: DataFrame, apps: DataFrame) -> DataFrame:
    """service, app_id of services and applications of which one's name contains the other's."""
    from weftgraph.operators.linkers import contains_links

    return contains_links(compose.select(F.col("service").alias("id"), F.col("service").alias("name")), apps.select("id", "name")).select(F.col("left_id").alias("service"), F.col("right_id").alias("app_id"))


def read_playbooks(files: DataFrame) -> DataFrame:
    """folder, hosts, role of playbooks: roles by name, or by the `role` of a mapping."""

    def run(batches):
        import yaml

        for b in batches:
            out = []
            for folder, value in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    plays = yaml.safe_load(value)
                except yaml.YAMLError:
                    continue
                for play in plays if isinstance(plays, list) else ():
                    if isinstance(play, dict):
                        for role in play.get("roles") or ():
                            name = role.get("role") if isinstance(role, dict) else role
                            if name is not None:
                                out.append((folder, _text(play.get("hosts")) if play.get("hosts") is not None else None, str(name)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in list(zip(*out)) or [()] * 3], ["folder", "hosts", "role"])

    return files.select("folder", "value").mapInArrow(run, "folder string, hosts string, role string")
