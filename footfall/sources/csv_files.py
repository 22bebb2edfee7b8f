"""CSV files with a header each, whose columns may differ in order and number.

Spark takes the column names of a folder from one file and gives them to the fields of all
others by position. Here each file's own header is read first - a line per file, no data -
and files with equal headers are scanned together, so fields find their column by name. A line
whose number of fields is not that of its header, as after an unquoted comma, is kept as text
in the column ``MALFORMED``.
"""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MALFORMED = "_malformed_line"
# Headers read at a time.
THREADS = 32


def _files(spark: SparkSession, path: str) -> list[str]:
    """Data files under a path or pattern; names that begin with _ or . are no data."""
    # the listing of Spark itself: nothing is read
    return sorted(spark.read.option("recursiveFileLookup", True).text(path).inputFiles())


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names of a file, compressed or not; none for an empty one."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    # listed paths are URIs
    file = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file)
    stream = file.getFileSystem(conf).open(file)
    try:
        plain = codec.createInputStream(stream) if codec else stream
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8"))
        line = lines.readLine()
        while line is not None and not line.strip():
            line = lines.readLine()
    finally:
        stream.close()
    names = tuple(next(csv.reader([(line or "").removeprefix("\ufeff")]), ()))
    if len(set(names)) < len(names):
        raise ValueError(f"{path} names a column twice: {', '.join(names)}")
    return names


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the files as text, and ``MALFORMED``, which is null for a good line."""
    files = _files(spark, path)
    with ThreadPoolExecutor(THREADS) as pool:
        headers = list(pool.map(lambda f: _header(spark, f), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, names in zip(files, headers):
        if names:
            groups.setdefault(names, []).append(file)
    if not groups:
        raise ValueError(f"no CSV file with a header in {path}")
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        (_scan(spark, names, paths) for names, paths in groups.items()),
    )


def _scan(spark: SparkSession, names: tuple[str, ...], paths: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, MALFORMED)])
    reader = (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", MALFORMED)
        # with fewer columns parsed than there are, no line would seem too long
        .option("columnPruning", False)
    )
    return reader.csv(paths)


def refuse_malformed(df: DataFrame) -> DataFrame:
    """``df`` without the column ``MALFORMED``; a malformed line raises when it is read."""
    if MALFORMED not in df.columns:
        return df
    line = F.col(MALFORMED)
    # a query of that column alone, as a count would be, is refused: another one is named too
    read_as = F.coalesce(F.col(df.columns[0]), F.lit("NULL"))
    text = F.concat(F.lit("malformed CSV line: "), line, F.lit("; read as "), read_as)
    told = F.raise_error(text).cast("boolean")
    return df.filter(F.when(line.isNull(), True).otherwise(told)).drop(MALFORMED)
