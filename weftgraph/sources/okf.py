"""Knowledge bundles: answers as Markdown concepts with an index and a log, written in versions.

A bundle's folder has a version for each write and a pointer to the current one.  A version holds three
tables: `concepts` (path, key, family, title, description, generated, markdown), `index` and `log`.  A write
that fails on the way leaves the pointer, and so the bundle, as it was.  `export_markdown` writes the current
version as files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.adjacency import _file, read_pointer, swap_pointer
from weftgraph.sources.store import checkpointed

#: Items that a concept shows of each section; the rest is counted.
SHOWN = 50
#: Keys that every concept's front matter must have, and the form of the bundle's lines (fixed values).
INDEX_LINE = r"^- \[[^\]]+\]\([^)]+\) - .+$"
LOG_LINE = r"^- \*\*(Creation|Refresh)\*\*: (Added|Refreshed) \[[^\]]+\]\([^)]+\)\.$"
CONCEPTS = "path string, key string, family string, title string, description string, generated boolean, markdown string"
INDEX = "path string, family string, line string, added long"
LOG = "day date, place long, line string"


def concept_keys(family: Column, request: Column) -> Column:
    """SHA-256 of a family and a request (JSON with sorted keys, as text)."""
    return F.sha2(F.concat(F.lit('{"family":"'), family, F.lit('","request":'), request, F.lit("}")), 256)


def slug(text: Column) -> Column:
    """Lower case, with dashes for everything that is no letter or digit."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def concepts(answers: DataFrame) -> DataFrame:
    """One concept of each answer that has a subject: path, key, family, title, description, generated, markdown.

    answers: family, request (JSON text), subject, section, item, detail; the rows of an answer share the first
    three.  An answer whose status is ambiguous is no concept.  A section shows its first SHOWN items and says
    how many more there are.
    """
    of = ["family", "request", "subject"]
    shown = answers.where("section not in ('status', 'subject')").groupBy(*of, "section")
    line = F.concat(F.lit("- `"), F.coalesce("item", F.lit("")), F.lit("`"), F.when(F.col("detail").isNotNull(), F.concat(F.lit(" "), F.col("detail"))).otherwise(""))
    ranked = answers.where("section not in ('status', 'subject')").withColumn("line", line)
    from pyspark.sql import Window

    ranked = ranked.withColumn("k", F.row_number().over(Window.partitionBy(*of, "section").orderBy("line"))).where(F.col("k") <= SHOWN)
    lines = ranked.groupBy(*of, "section").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    counts = shown.agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > SHOWN, F.concat(F.lit("\n- and "), (F.col("n") - SHOWN).cast("string"), F.lit(" more"))).otherwise("")
    parts = lines.join(counts, [*of, "section"]).select(*of, "section", F.concat(F.lit("## "), "section", F.lit("\n\n"), F.array_join("lines", "\n"), more, F.lit("\n")).alias("text"), "n")
    body = parts.groupBy(*of).agg(F.array_sort(F.collect_list(F.struct("section", "text"))).alias("parts"), F.sum("n").alias("rows"))
    status = answers.where("section = 'status'").select(*of, F.col("item").alias("status"))
    x = body.join(status, of).where("status <> 'ambiguous' and subject is not null")
    key = concept_keys(F.col("family"), F.col("request"))
    x = x.withColumn("key", key).withColumn("slug", F.regexp_replace("family", "_", "-"))
    x = x.withColumn("path", F.concat(F.lit("investigations/"), "slug", F.lit("/"), slug(F.col("subject")), F.lit("-"), F.substring("key", 1, 12), F.lit(".md")))
    title = F.concat(F.initcap(F.regexp_replace("family", "_", " ")), F.lit(" of "), "subject")
    head = F.concat(F.lit("---\ntype: architecture-investigation\ngenerated: true\nsemantic_key: "), "key", F.lit("\nfamily: "), "family", F.lit("\nstatus: "), "status", F.lit("\n---\n\n# "), title, F.lit("\n\n"))
    return x.select("path", "key", F.col("slug").alias("family"), title.alias("title"), F.concat("status", F.lit(", "), F.col("rows").cast("string"), F.lit(" findings")).alias("description"), F.lit(True).alias("generated"), F.concat(head, F.array_join(F.transform("parts", lambda p: p["text"]), "\n")).alias("markdown"))


def front_matter(markdown: Column, name: str) -> Column:
    """A value of a concept's front matter; null if there is none."""
    head = F.regexp_extract(markdown, r"(?s)^---\n(.*?)\n---\n", 1)
    found = F.trim(F.regexp_extract(head, rf"(?m)^{name}:(.*)$", 1))
    return F.when(found != "", found)


def faults(made: DataFrame) -> DataFrame:
    """path, fault of concepts that are no valid entries of a bundle."""
    md = F.col("markdown")
    fault = (
        F.when(md.isNull() | ~md.rlike(r"(?s)^---\n.*?\n---\n"), "no front matter")
        .when(front_matter(md, "type").isNull(), "no type")
        .when(~front_matter(md, "generated").eqNullSafe(F.lit("true")), "not marked as generated")
        .when(~front_matter(md, "semantic_key").eqNullSafe(F.col("key")), "another semantic key")
        .when(F.contains("path", F.lit("..")) | F.startswith("path", F.lit("/")), "outside the bundle")
        .when(~_index_line().rlike(INDEX_LINE), "no index line")
    )
    return made.select("path", fault.alias("fault")).where("fault is not null")


def _index_line() -> Column:
    return F.concat(F.lit("- ["), "title", F.lit("]("), "path", F.lit(") - "), "description")


def read_bundle(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """concepts, index and log of the current version; empty ones if there is none."""
    now = read_pointer(spark, root)
    if now is None:
        return tuple(spark.createDataFrame([], schema) for schema in (CONCEPTS, INDEX, LOG))
    return tuple(spark.read.schema(schema).parquet(f"{root}/{now['version']}/{t}") for t, schema in (("concepts", CONCEPTS), ("index", INDEX), ("log", LOG)))


def write_bundle(made: DataFrame, root: str, day: str, allow_overwrite: bool = False) -> DataFrame:
    """Add concepts to a bundle, or refresh them: path, status of each.

    Statuses: `created`, `updated`; `overwrite-required` for one that is there and may not be refreshed;
    `not-generated` and `other-key` for a path that holds something else; `invalid`.  Only the first two are
    written.  The rest of the bundle stays as it is; older log lines stay below newer ones.
    """
    spark = made.sparkSession
    old, index, log = read_bundle(spark, root)
    made = checkpointed(made, "concepts")
    here = old.select("path", F.col("generated").alias("old_generated"), F.col("key").alias("old_key"))
    bad = faults(made).select("path").distinct().withColumn("bad", F.lit(True))
    x = made.join(here, "path", "left").join(bad, "path", "left")
    there = F.col("old_generated").isNotNull()
    status = (
        F.when(F.col("bad"), "invalid").when(there & ~F.col("old_generated"), "not-generated").when(there & (F.col("old_key") != F.col("key")), "other-key")
        .when(there & F.lit(not allow_overwrite), "overwrite-required").when(there, "updated").otherwise("created")
    )
    told = checkpointed(x.withColumn("status", status).select(*made.columns, "status"), "told")
    written = told.where("status in ('created', 'updated')")
    if written.isEmpty():
        return told.select("path", "status")
    version = uuid.uuid4().hex
    base = f"{root}/{version}"
    kept = old.join(written.select("path"), "path", "left_anti").select(*made.columns)
    kept.unionByName(written.select(*made.columns)).write.parquet(f"{base}/concepts")
    lines = written.select("path", "family", _index_line().alias("line")).join(index.select("path", "added"), "path", "left")
    last = index.agg(F.coalesce(F.max("added"), F.lit(0))).first()[0]
    lines = lines.select("path", "family", "line", F.coalesce("added", F.lit(last + 1)).alias("added"))
    index.join(written.select("path"), "path", "left_anti").unionByName(lines).write.parquet(f"{base}/index")
    new = written.select(F.lit(day).cast("date").alias("day"), F.concat(F.lit("- **"), F.when(F.col("status") == "updated", "Refresh").otherwise("Creation"), F.lit("**: "), F.when(F.col("status") == "updated", "Refreshed").otherwise("Added"), F.lit(" ["), "title", F.lit("]("), "path", F.lit(").")).alias("line"))
    latest = log.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]
    log.unionByName(new.select("day", F.lit(latest + 1).alias("place"), "line")).write.parquet(f"{base}/log")
    swap_pointer(spark, root, version, 1, "bundle")  # last: until here the bundle is the old one
    return told.select("path", "status")


def index_markdown(index: DataFrame) -> DataFrame:
    """line, place of the index file: families in order, the lines of each as they were added."""
    heading = F.concat(F.lit("## "), F.upper(F.substring("family", 1, 1)), F.substring(F.regexp_replace("family", "-", " "), 2, 1000))
    heads = index.select("family").distinct().select(heading.alias("line"), F.struct("family", F.lit(0).cast("long").alias("added"), F.lit("").alias("path")).alias("place"))
    return heads.unionByName(index.select("line", F.struct("family", "added", "path").alias("place"))).orderBy("place")


def export_markdown(spark: SparkSession, root: str, target: str) -> int:
    """Write the current version as Markdown files below a folder, one concept at a time; how many files."""
    made, index, log = read_bundle(spark, root)

    def put(path: str, text: str) -> None:
        at, files = _file(spark, f"{target}/{path}")
        out = files.create(at, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    n = 0
    for path, text in made.select("path", "markdown").toLocalIterator():
        put(path, text)
        n += 1
    put("index.md", "# Architecture Investigations\n\n" + "".join(f"{line}\n" for line, in index_markdown(index).select("line").toLocalIterator()))
    put("log.md", "# Architecture Investigation Log\n\n" + "".join(f"{day} {line}\n" for day, line in log.orderBy(F.desc("day"), F.desc("place"), "line").select("day", "line").toLocalIterator()))
    return n + 2
