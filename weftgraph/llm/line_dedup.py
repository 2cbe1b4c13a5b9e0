"""Line dedup with overlapping windows of three lines.

Lines are what `\\n` separates.  Every `size` consecutive lines of a document are a window, known by
128 bits of hash.  A window that also starts earlier (smaller doc_id, or earlier in the same document)
is a repeat: the lines it covers go, and overlapping repeats merge.  Windows are judged on the input.
Only DataFrame functions: a map-side-combined minimum per window, a join back that adaptive execution
can split where a window is hot, and one join of the covered positions with the texts.

Defined results: a null text has no lines, an empty one has one empty line, and shorter documents than
a window keep all; a null doc_id is the smallest; rows that repeat a doc_id and its text are one
document (all of them get its result), and different texts under one doc_id are ordered by a hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._rows import checkpointed


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_removed and kept (the lines left) of every row, and the columns named in `keep`."""
    text = F.col(f"`{text_col}`")
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.xxhash64(text).alias("h"), text.alias("t"), *(F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(keep)))
    lines = F.split(F.col("t"), "\n", -1)
    many = docs.where(F.length("t") - F.length(F.replace(F.col("t"), F.lit("\n"), F.lit(""))) >= size - 1).select("d", "h", lines.alias("l"))
    window = F.transform(
        F.sequence(F.lit(0), F.size("l") - size),
        lambda i: F.struct(F.xxhash64(*(F.get("l", i + j) for j in range(size))).alias("a"), F.xxhash64(F.lit("second"), *(F.get("l", i + j) for j in range(size))).alias("b")),
    )
    windows = many.select("d", "h", F.posexplode(window).alias("at", "w")).select("d", "h", "at", "w.a", "w.b")
    first = windows.groupBy("a", "b").agg(F.min(F.struct("d", "h", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first")
    first = checkpointed(first, "lines")  # a table, so that both sides of the join are plain exchanges, which AQE can split
    repeats = windows.join(first, ["a", "b"]).where(~F.struct("d", "h", "at").eqNullSafe(F.col("first")))
    covered = repeats.groupBy("d", "h").agg(F.collect_set("at").alias("at")).select(F.col("d").alias("rd"), F.col("h").alias("rh"), F.flatten(F.transform("at", lambda p: F.sequence(p, p + size - 1))).alias("gone"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    joined = docs.join(covered, F.col("d").eqNullSafe(F.col("rd")) & (F.col("h") == F.col("rh")), "left")
    n = F.when(F.col("t").isNull(), 0).otherwise(F.size(lines))
    out = joined.withColumns({"n_lines": n.cast("long"), "left": F.when(F.col("gone").isNotNull(), left)})
    return out.select(
        F.col("d").alias("doc_id"),
        "n_lines",
        F.when(F.col("left").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("left")).cast("long").alias("n_removed"),
        F.when(F.col("left").isNull(), F.coalesce("t", F.lit(""))).otherwise(F.concat_ws("\n", F.transform("left", lambda i: F.get(lines, i)))).alias("kept"),
        *(F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)),
    )


#: The same result in DuckDB, per row of `documents`.
SQL = """
WITH docs AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS l FROM documents),
starts AS (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS pos FROM docs WHERE len(l) >= 3),
windows AS (SELECT doc_id, pos, l[pos + 1] || chr(10) || l[pos + 2] || chr(10) || l[pos + 3] AS w FROM starts),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS r FROM windows),
gone AS (SELECT DISTINCT doc_id, pos + j AS pos FROM ranked, (SELECT unnest([0, 1, 2]) AS j) WHERE r > 1),
places AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM docs),
kept AS (SELECT p.doc_id, string_agg(line, chr(10) ORDER BY p.pos) AS kept, count(*) AS n FROM places p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
SELECT d.doc_id, len(l)::BIGINT AS n_lines, (len(l) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
