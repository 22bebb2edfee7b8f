"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.settings import fresh_dir as fresh_path

# A word is a run of code points other than space and \t \n \v \f \r. bytes.split()
# without arguments splits UTF-8 text at exactly these six.
WORD = r"[^\x20\x09-\x0D]+"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(table: DataFrame) -> DataFrame:
    """``table`` as one side of a join that broadcasts neither side.

    For joins of tables that grow with the data. Spark sizes a table by its compressed files and
    takes no account of the rows that an explode adds, so the driver may be given dozens of times
    the threshold below which it broadcasts.
    """
    return table.hint("merge")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Harmless where the package is installed on the executors.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def per_batch(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema
) -> DataFrame:
    """Map Arrow batches; ``make`` runs once per task and returns the batch function."""
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield from work(batch)

    return df.mapInArrow(run, schema)


def only(docs: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names, so that clashing extra columns go."""
    return docs.select(*(F.col(f"`{name}`").alias(alias) for alias, name in columns.items()))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def slices_of(column: pa.Array, at_once: int) -> Iterator[slice]:
    """Slices of the rows with about ``at_once`` bytes of text each."""
    sizes = pc.binary_length(column).to_numpy().astype(np.int64)
    firsts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // at_once, prepend=-1)).tolist()
    for first, end in zip(firsts, [*firsts[1:], len(column)]):
        yield slice(first, end)


# A key with more than this share of the rows is hot; there are fewer hot keys than that.
HOT_KEYS = 1000


def look_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``table``, null where a key is null or not in it.

    Keys of ``table`` are unique and not null. Of a key with over a thousandth of all rows - there are
    fewer than a thousand such keys - the entry is broadcast and the rows stay spread; the
    others meet their entry by a shuffle, where null keys are spread as well. ``rows`` is read
    three times.
    """
    least = rows.count() // HOT_KEYS
    hot = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > least).drop("n")
    named = {c: f"found_{i}" for i, c in enumerate(c for c in table.columns if c not in keys)}
    known = hot.join(table, keys, "left").withColumn("hot", F.lit(True))
    rows = rows.join(F.broadcast(known.withColumnsRenamed(named)), keys, "left")
    spread = F.monotonically_increasing_id() % 1024 + 1
    alone = functools.reduce(Column.__or__, (F.col(k).isNull() for k in keys), F.col("hot"))
    rows = rows.withColumn("place", F.when(alone, spread).otherwise(0))
    found = rows.join(table.withColumn("place", F.lit(0).cast("long")), [*keys, "place"], "left")
    return found.withColumns({c: F.coalesce(c, n) for c, n in named.items()}).drop(
        "place", "hot", *named.values()
    )
