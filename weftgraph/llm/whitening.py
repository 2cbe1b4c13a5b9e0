"""Embedding whitening: principal components of all vectors, and every vector in their terms.

Entries become integers, so sums are exact, and rows are centred exactly: n x - S is an integer for every
entry.  Spark MLlib's RowMatrix gives the Gramian of the centred rows; divided by n it is the covariance,
whose eigenvectors are found on the driver (dims x dims numbers).  They are broadcast, and mapInPandas
projects and scales each row.

Defined results: rows whose vector is null or holds a null or non-finite entry are left out.  Vectors must
agree in length: those of the commonest length are kept (the longer one of two as common), and empty ones
never.  Entries beyond the limit of 2^31 after scaling become the limit.  A component along which nothing
varies (an eigenvalue below 1e-12 of all variance) has a null `whitened` and is left out of identity_error,
which is null if no component varies.  Fewer components than asked for: as many as there are dimensions.
A deviation beyond 64 bits is null.  Repeated rows are vectors each; null identifiers stay null.  An empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._rows import bounded_batches, checkpointed
from weftgraph.llm._vectors import integers

LIMIT = 1 << 31
#: Share of the variance below which an eigenvalue counts as zero.
ZERO = 1e-12
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def gramian(df: DataFrame, vector: Column, dims: int) -> np.ndarray:
    """Sum over rows of the outer product of a column of double arrays with itself."""
    rows = MLUtils.convertVectorColumnsFromML(df.select(array_to_vector(vector).alias("v")), "v")
    return RowMatrix(rows, numCols=dims).computeGramianMatrix().toArray()


def _centred(x: Column, whole: list[int], part: list[float]) -> Column:
    """x - S / n, where S = whole * n + part * n: the difference of integers is exact, so one rounding remains."""
    less = F.arrays_zip(F.array(*map(F.lit, whole)).alias("q"), F.array(*map(F.lit, part)).alias("r"))
    return F.zip_with(x, less, lambda a, m: (a - m["q"]).cast("double") - m["r"])


def deviations(away: np.ndarray, part: np.ndarray, n: int) -> list[int | None]:
    """Exact sum of (n x - S)^2 of each row, where n x - S = n * away - part; null beyond 64 bits."""
    most = int(np.abs(away).max(initial=0)) + 1
    small = most < 1 << 28 and most * max(n, 1) * (away.shape[1] + 1) < 1 << 62
    away, part = (away, part) if small else (away.astype(object), part.astype(object))
    a, b, c = (away * away).sum(axis=1), (away * part).sum(axis=1), sum(int(p) ** 2 for p in part)
    out = [n * n * int(p) - 2 * n * int(q) + c for p, q in zip(a, b)]
    return [d if d < 1 << 63 else None for d in out]


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each vector and component."""
    spark = df.sparkSession
    bounded_batches(spark)
    every = checkpointed(integers(df, id_col, vec_col, scale, shift, LIMIT, "long").where(F.size("x") > 0), "vectors")
    sizes = every.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("dims")).first()
    if common is None:
        return spark.createDataFrame([], SCHEMA)
    dims, n = common
    rows = every.where(F.size("x") == dims)
    sums = np.zeros(dims, dtype=object)
    for d, s in rows.select(F.posexplode("x").alias("d", "x")).groupBy("d").agg(F.sum("x")).toLocalIterator():
        sums[d] = s
    q, r = [int(s) // n for s in sums], [int(s) % n for s in sums]
    part = [p / n for p in r]
    covariance = gramian(rows, _centred(F.col("x"), q, part), dims) / n

    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    first = np.argsort(-values, kind="stable")[:components]
    values, vectors, trace = np.maximum(values[first], 0), vectors[:, first], float(np.trace(covariance))
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(first))] < 0, -1, 1)
    varied = int((values > ZERO * trace).sum()) if trace > 0 else 0
    model = spark.sparkContext.broadcast((np.array(q), np.array(r), np.array(part), vectors[:, :varied] / np.sqrt(values[:varied])))
    none = [None] * (len(first) - varied)

    def project(frames):
        whole, rest, less, by = model.value
        for f in frames:
            if not len(f):
                continue
            away = np.stack(f["x"].to_numpy()).astype(np.int64) - whole
            white = (away - less) @ by
            yield pd.DataFrame({"vec_id": f["vec_id"].astype("Int64"), "deviation": pd.array(deviations(away, rest, n), dtype="Int64"), "whitened": [[*w, *none] for w in white.tolist()]})

    white = checkpointed(rows.mapInPandas(project, "vec_id long, deviation long, whitened array<double>"), "whitened")
    error = None
    if varied:
        kept = F.slice("whitened", 1, varied)
        means = [0.0] * varied
        for d, m in white.select(F.posexplode(kept).alias("d", "w")).groupBy("d").agg(F.avg("w")).toLocalIterator():
            means[d] = m
        centred = F.zip_with(kept, F.array(*map(F.lit, means)), lambda w, m: w - m)
        error = float(np.abs(gramian(white, centred, varied) / n - np.eye(varied)).max())
    explained = F.array(*(F.lit(float(v / trace) if trace > 0 else 0.0) for v in values))
    out = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
