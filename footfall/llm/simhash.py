"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its sixteen 4-bit segments. The
Manhattan distance of two such vectors never exceeds the Hamming distance, so pairs within
two bits lie within distance two, and then some grid cell is within distance one of both.
Every distinct fingerprint enters its own cell and those beside it (33 at most); rows of
one cell meet in an equi-join whose condition verifies the Hamming distance exactly.

Cells with very many fingerprints would cost the square of their number. There the links
are found through flipped bits instead: two fingerprints differ in at most two bits exactly
if they share a value reached by flipping at most one bit in each, so all that reach one
value hang on the smallest of them. No pairs are made, and the components are the same.

Copies share a fingerprint and are one node; pairs of copies are never made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.llm.common import only, per_batch, shuffled, stash, texts
from footfall.llm.components import component_roots

SHINGLE = 3
MOST_BITS = 2
SEED = 42
SEGMENTS = 16
# From this many distinct fingerprints in a cell on, links come from flipped bits.
CROWDED = 4096
# Hashes counted at once, which bounds the memory of very long texts (64 bytes each).
COUNTED = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bits set in more than half of the hashes of the word shingles; 0 without words."""
    raw = text.encode()
    words = raw.lower().split()  # bytes.lower() changes A-Z alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        spans = [(0, len(joined))]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at : at + COUNTED].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
) -> DataFrame:
    """(doc_id, row_hash, fp): the fingerprint of every row as a signed 64-bit integer.

    row_hash: a hash of id and text, which tells rows of equal id apart.
    """
    plain = only(docs, doc_id=id_col, text=text_col)
    plain = plain.withColumn("row_hash", row_hash("doc_id", "text"))
    kept = plain.drop("text").schema.fields
    schema = T.StructType([*kept, T.StructField("fp", T.LongType())])

    def make():
        def work(batch):
            fps = np.array([fingerprint(t, shingle) for t in texts(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_hash"), pa.array(fps.view(np.int64))],
                schema.fieldNames(),
            )

        return work

    return per_batch(plain, make, schema)


def row_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def _segment_counts(fp: Column) -> Column:
    """Bit counts of the sixteen 4-bit segments, one hexadecimal digit (0 to 4) each."""

    ones = F.lit(int("1" * 16, 16))
    first, *others = (F.shiftrightunsigned(fp, k).bitwiseAND(ones) for k in range(4))
    return first + others[0] + others[1] + others[2]


def _cells(counts: Column) -> Column:
    """A cell and its neighbours one step away, inside the range of possible counts."""
    steps = [counts]
    for i in range(SEGMENTS):
        digit = F.shiftrightunsigned(counts, 4 * i).bitwiseAND(F.lit(15))
        one = F.lit(1 << 4 * i)
        steps.append(F.when(digit < 4, counts + one))
        steps.append(F.when(digit > 0, counts - one))
    return F.array_compact(F.array(*steps))


def _flips(fp: Column) -> Column:
    return F.array(
        fp, *(fp.bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64))
    )


def near_links(distinct_fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(u, v): links that join all fingerprints ``fp`` within two bits into components.

    Outside crowded cells these are all pairs within two bits; inside, a star for each
    value within one bit of several fingerprints.
    """
    placed = distinct_fps.select("fp", F.explode(_cells(_segment_counts(F.col("fp")))).alias("cell"))
    shared = placed.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1")
    placed = stash(placed.join(shuffled(shared), "cell"), "cells")

    ordinary = placed.filter(F.col("n") <= crowded)
    a = ordinary.select("cell", F.col("fp").alias("u"))
    b = ordinary.select("cell", F.col("fp").alias("v"))
    verified = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MOST_BITS
    near = (a.cell == b.cell) & (a.u < b.v) & verified
    pairs = a.join(shuffled(b), near).select("u", "v").distinct()

    dense = placed.filter(F.col("n") > crowded).select("fp").distinct()
    reached = dense.select("fp", F.explode(_flips(F.col("fp"))).alias("value"))
    centers = reached.groupBy("value").agg(F.min("fp").alias("v"), F.max("fp").alias("last"))
    stars = (
        reached.join(shuffled(centers.filter("v <> last")), "value")
        .select(F.col("fp").alias("u"), "v")
        .filter("u <> v")
        .distinct()
    )
    return pairs.union(stars)


def _rooted(fps: DataFrame, crowded: int) -> DataFrame:
    """(fp, root, least_row): the component of every distinct fingerprint, with the least
    (doc_id, row_hash) of the rows that have the fingerprint; null ids come last."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_hash")
    nodes = stash(fps.groupBy("fp").agg(F.min(row).alias("least_row")), "nodes")
    roots = stash(component_roots(near_links(nodes.select("fp"), crowded)), "roots")
    return nodes.join(shuffled(roots), nodes.fp == roots.node, "left").select(
        "fp", "least_row", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Component: all rows reachable through links of two or fewer differing bits; its id is
    the smallest doc_id in it. Null and wordless texts have fingerprint zero and are linked
    like any others. Rows with equal ids stay separate rows; a null id is ignored for the
    smallest, and a component of null ids alone has a null component_id.
    """
    fps = stash(fingerprints(docs, id_col, text_col), "fingerprints")
    rooted = _rooted(fps, crowded)
    least = rooted.groupBy("root").agg(F.min("least_row")["doc_id"].alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(shuffled(named), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED
) -> DataFrame:
    """One row of each component, all columns unchanged: the one with the smallest id.

    Of several rows with that id the one with the least hash stays; of rows that are equal in
    id and text, any one.
    """
    fps = stash(fingerprints(docs, id_col, text_col), "fingerprints")
    least = _rooted(fps, crowded).groupBy("root").agg(F.min("least_row")["row_hash"].alias("kept"))
    held = docs.select(row_hash(id_col, text_col).alias("row_hash"), F.struct("*").alias("row"))
    return (
        held.join(least.select("kept").distinct(), F.col("row_hash") == F.col("kept"))
        .dropDuplicates(["row_hash"])
        .select("row.*")
    )
