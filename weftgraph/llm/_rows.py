"""Shared plumbing for operators that map one text to one row.

Every such operator reads exactly two columns of its input, the identifier and the text, under
names of its own, so further columns (whatever they are called) never reach it.  Rows are handled
one at a time: repeated rows give repeated results and the identifier may be null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text per step of a Python worker; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, text_at: int = 1, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a step holds about `limit` bytes of text, which bounds a worker's memory."""
    col = batch.column(text_at)
    size, begin = 0, 0
    lengths = pc.binary_length(col).to_pylist()
    for i, n in enumerate(lengths):
        size += n or 0
        if size >= limit:
            yield batch.slice(begin, i + 1 - begin)
            begin, size = i + 1, 0
    if begin < len(lengths):
        yield batch.slice(begin)


def map_texts(df: DataFrame, id_col: str, text_col: str, per_step: Callable, schema: str, setup: Callable | None = None, as_binary: bool = False) -> DataFrame:
    """Apply `per_step(ids, texts[, state]) -> list of columns` to steps of about STEP_BYTES of text.

    `setup()` runs once per task and makes the state.  `schema` is a DDL string; the columns returned
    are lists or arrow arrays in its order.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        state = (setup(),) if setup else ()
        for batch in batches:
            for part in slices(batch):
                out = per_step(part.column(0), part.column(1), *state)
                cols = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(out, fields)]
                yield pa.RecordBatch.from_arrays(cols, schema=fields)

    text = F.col(f"`{text_col}`")
    bounded_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").alias("_id"), (text.cast("binary") if as_binary else text).alias("_text")).mapInArrow(run, schema)


def filter_texts(df: DataFrame, text_col: str, decide: Callable, setup: Callable | None = None, replace: str | None = None) -> DataFrame:
    """Rows of `df`, all columns, for which `decide(texts[, state])` is true.

    With `replace`, decide returns (mask, values) and the values take that column's place.  Columns are
    addressed by position, so any names do.
    """
    text_at, replace_at = df.columns.index(text_col), df.columns.index(replace) if replace else None

    def run(batches):
        state = (setup(),) if setup else ()
        for batch in batches:
            for part in slices(batch, text_at):
                mask = decide(part.column(text_at), *state)
                if replace_at is not None:
                    mask, values = mask
                    cols = [pa.array(values, part.schema.field(i).type) if i == replace_at else c for i, c in enumerate(part.columns)]
                    part = pa.RecordBatch.from_arrays(cols, schema=part.schema)
                yield part.filter(pa.array(mask, pa.bool_()))

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, df.schema)


def bounded_batches(spark) -> None:
    """Arrow batches of a thousand rows and some MB: a batch of the longest texts still fits a small worker.

    The options hold when a plan is run, which may be after the caller's return; so they stay set.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark, name: str) -> str:
    """A fresh folder under the cluster's shared `spark.checkpoint.dir`; where none is named, one under /tmp in local mode, else an error."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/weftgraph-shared"
    return f"{root.rstrip('/')}/weftgraph/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a table in the shared folder; it survives the loss of any executor."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
