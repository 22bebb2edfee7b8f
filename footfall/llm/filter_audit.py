"""How filters interact: what each removes, alone or after others, in every order.

One scan judges every text by all filters at once; Spark counts documents per part and
combination of verdicts, 32 cells for five filters. A part's cells are a 2x2x2x2x2 tensor,
and any figure of any order is a contraction of it: along each axis the documents that
pass, those that fail, or all are chosen. No order is ever run over the documents.

Filters (a text fails if):

    A  it has fewer than 50 words             B  under 65 % of its words are distinct
    C  over 5 % of its code points are A-Z    D  it holds one of # $ % & * |
    E  a document with a smaller id has the same text, whatever the filters say of that one

Edge cases: a null text is empty; a null part is the empty string. A null doc_id is neither
smaller nor larger than others, and has no label. Rows of equal id and text are no copies of
each other and count each; a document with several labels counts as good or toxic if one of
them says so. Long texts are split into words in blocks. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.llm.common import look_up, only, per_batch, stash, texts

FILTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT_PERCENT = 65
MOST_CAPITALS_PERCENT = 5
SYMBOLS = "#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))

# Bytes split into words at once; parts contracted at once (600 rows each).
BLOCK_BYTES = 1 << 20
PARTS_AT_ONCE = 100
SPACE = re.compile(rb"[\x09-\x0d ]")

PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
MEASURES = ("n", "good", "toxic")

JUDGED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.StringType()),
        T.StructField("cell", T.IntegerType()),
        T.StructField("digest", T.BinaryType()),
    ]
)
REPORT = T.StructType(
    [
        T.StructField("part", T.StringType()),
        T.StructField("filter_order", T.StringType()),
        T.StructField("step", T.IntegerType()),
        *(
            T.StructField(name, T.LongType())
            for name in (
                "kept",
                "removed",
                "redundant",
                "unique_fails",
                "good_lost",
                "toxic_lost",
                "shapley",
            )
        ),
    ]
)


def count_words(raw: bytes) -> tuple[int, int]:
    """Words and distinct words."""
    n, distinct, at = 0, set(), 0
    while at < len(raw):
        border = SPACE.search(raw, at + BLOCK_BYTES)
        stop = border.start() if border else len(raw)
        words = raw[at:stop].split()
        n += len(words)
        distinct.update(words)
        at = stop
    return n, len(distinct)


def cell_of(text: str) -> int:
    """Verdicts of A to D in the four upper of five bits; E, the lowest, is left open."""
    raw = text.encode()
    n, distinct = count_words(raw)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    failed = (
        n < LEAST_WORDS,
        100 * distinct < LEAST_DISTINCT_PERCENT * n,
        100 * capitals > MOST_CAPITALS_PERCENT * len(text),
        any(s in text for s in SYMBOLS),
    )
    return sum(f << 4 - i for i, f in enumerate(failed))


def judged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(doc_id, part, cell, digest): verdicts of A to D and the digest of every text."""

    def make():
        def work(batch):
            all_texts = texts(batch)
            digests = [hashlib.sha256(t.encode()).digest() for t in all_texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("part"),
                    pa.array(map(cell_of, all_texts), pa.int32()),
                    pa.array(digests, pa.binary()),
                ],
                JUDGED.fieldNames(),
            )

        return work

    plain = only(docs, doc_id=id_col, text=text_col, part=part_col)
    return per_batch(plain.withColumn("part", F.coalesce("part", F.lit(""))), make, JUDGED)


def cell_counts(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """(part, cell, n, good, toxic): documents per combination of verdicts."""
    rows = stash(judged(docs, id_col, text_col, part_col), "judged")
    # equal rows are added up before anything is shuffled
    groups = rows.groupBy("doc_id", "digest", "part", "cell").agg(F.count("*").alias("n"))
    groups = stash(groups, "groups")
    has_id = F.col("doc_id").isNotNull()
    first = (
        groups.filter(has_id)
        .groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"))
        .withColumn("first", F.lit(True))
    )
    marks = (
        labels.filter(has_id)
        .groupBy("doc_id")
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    )
    seen = look_up(look_up(groups, first, ["digest", "doc_id"]), marks, ["doc_id"])
    copies = has_id & F.col("first").isNull()
    cells = seen.select(
        "part",
        (F.col("cell") + copies.cast("int")).alias("cell"),
        "n",
        *(F.when(F.col(c), F.col("n")).otherwise(0).alias(c) for c in ("good", "toxic")),
    )
    return cells.groupBy("part", "cell").agg(*(F.sum(m).alias(m) for m in MEASURES))


def contract(cells: np.ndarray, **chosen: np.ndarray) -> np.ndarray:
    """Documents of each part and measure; each filter's axis is contracted as chosen."""
    return np.einsum(
        "pmabcde,a,b,c,d,e->pm", cells, *(chosen.get(f, ALL) for f in FILTERS)
    )


def interactions(cells: np.ndarray) -> list[tuple]:
    """(order, step, the seven figures as arrays over parts) of all orders of the filters.

    ``cells``: parts x measures x 2 x 2 x 2 x 2 x 2, the second place of an axis for failure.
    """
    known: dict[tuple, tuple] = {}

    def step_figures(before: str, own: str) -> tuple:
        key = frozenset(before), own
        if key not in known:
            earlier = {f: PASS for f in before}
            removed = contract(cells, **earlier, **{own: FAIL})
            failing = contract(cells, **{own: FAIL})
            alone = contract(cells, **{f: PASS for f in FILTERS if f != own}, **{own: FAIL})
            kept = contract(cells, **earlier, **{own: PASS})
            known[key] = kept[:, 0], removed, (failing - removed)[:, 0], alone[:, 0]
        return known[key]

    found, share = [], defaultdict(int)
    for order in map("".join, permutations(FILTERS)):
        for at, own in enumerate(order):
            kept, removed, redundant, alone = step_figures(order[:at], own)
            share[own] = share[own] + removed[:, 0]
            found.append((order, at + 1, kept, removed, redundant, alone))
    return [
        (order, step, kept, removed[:, 0], redundant, alone, removed[:, 1], removed[:, 2], share[order[step - 1]])
        for order, step, kept, removed, redundant, alone in found
    ]


def audit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """A row per part, order of the filters and step, zeros included.

    kept: documents left after the step; removed: by it; redundant: failing its filter,
    but removed before; unique_fails: failing no other filter; good_lost, toxic_lost: removed
    ones with that label; shapley: documents the filter removes, summed over all orders.
    """
    counts = cell_counts(docs, labels, id_col, text_col, part_col)
    # at most 32 cells a part
    parts = counts.groupBy("part").agg(
        F.collect_list(F.struct("cell", *MEASURES)).alias("cells")
    )

    def make():
        def some(names, lists):
            cells = np.zeros((len(names), len(MEASURES), 2 ** len(FILTERS)), np.int64)
            for p, entries in enumerate(lists):
                for entry in entries:
                    cells[p, :, entry["cell"]] = [entry[m] for m in MEASURES]
            cells = cells.reshape(len(names), len(MEASURES), *[2] * len(FILTERS))
            found = interactions(cells)
            columns = [np.repeat(names, len(found)).tolist()]
            columns += [[row[k] for row in found] * len(names) for k in (0, 1)]
            columns += [np.stack([row[k] for row in found], 1).ravel() for k in range(2, 9)]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.int32())]
                + [pa.array(c, pa.int64()) for c in columns[3:]],
                REPORT.fieldNames(),
            )

        def work(batch):
            names = np.array(batch.column("part").to_pylist(), object)
            lists = batch.column("cells").to_pylist()
            for at in range(0, len(names), PARTS_AT_ONCE):
                yield some(names[at : at + PARTS_AT_ONCE], lists[at : at + PARTS_AT_ONCE])

        return work

    return per_batch(parts, make, REPORT)
