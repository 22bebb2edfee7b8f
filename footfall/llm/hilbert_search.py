"""Nearest neighbours by inner product through shifted Hilbert curves.

Each curve orders all vectors: random orthogonal directions project them, every projected
coordinate is cut into cells at shifted quantiles, and the Hilbert index of the cell is the
key. A key is turned into a position between 0 and 1, the share of vectors before it, so
windows are shares of the data and blocks of the order hold equally many vectors. Rows of
equal key are spread over its range by a hash of their id, so no block is hot.

For a query, all vectors within the window around its position on any curve are candidates:
curves and blocks meet in a grouped join, inner products are taken block by block, and the best
of all blocks are merged. A pair within the window of several curves counts on the first.

What is fitted, on samples of bounded size: quantiles and positions on about ``SAMPLE``
vectors, and the width of the window on ``PROBES`` of them, whose true neighbours are found by
one pass over all vectors: the least width that holds the share ``RECALL`` of these neighbours,
and the share of ``LEAST_WINDOW`` times k distinct ids on either side.
Vectors with structure need narrow windows; where neighbours hardly stand out (independent
coordinates in many dimensions) the window grows to a fixed share of the data, and the work
with the number of queries times the number of vectors.

Edge cases: vectors that are null, empty, all zero or hold null or non-finite components take
no part, nor do rows without an id or with another dimension than most (ties: the larger).
Rows that repeat both id and vector are dropped first. Of equal vectors only the first k + 1
ids can be among k neighbours of anything, and only these are indexed. A query is never its
own neighbour; an id with several vectors counts once per query, with its best score, in the
fit, in each block and in the result. Fewer than k candidates are all returned. Empty tables give no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import importable, per_batch, stash

CURVES = 4
DIRECTIONS = 8
BITS = 6
SAMPLE = 16_384
PROBES = 128
RECALL = 0.975
LEAST_WINDOW = 4
BLOCK = 16_384
QUERIES_AT_ONCE = 128
SEED = 11


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points, one row each (Skilling, AIP Conf. Proc. 707, 2004).

    From the high bit down, a set bit of a coordinate inverts the lower bits of the first
    one, a clear bit swaps the lower bits in which the two differ; a Gray code over the
    transposed bits finishes.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(dims):
            is_set = (x[i] >> bit) & 1 == 1
            swapped = np.where(is_set, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(is_set, low, swapped)
            x[i] ^= swapped
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= turn
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            index = index << 1 | (x[i] >> bit) & 1
    return index


@dataclass
class Curve:
    directions: np.ndarray  # dimension x directions
    edges: list[np.ndarray]  # cell borders of each direction
    keys: np.ndarray  # sorted keys of the sample

    def key(self, vectors: np.ndarray) -> np.ndarray:
        projected = vectors @ self.directions
        cells = [np.searchsorted(e, projected[:, i], "right") for i, e in enumerate(self.edges)]
        return hilbert_index(np.stack(cells, axis=1), BITS)

    def position(self, vectors: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """Share of all vectors before each one; ``chance`` in [0, 1) places equal keys."""
        keys = self.key(vectors)
        first = np.searchsorted(self.keys, keys, "left")
        last = np.searchsorted(self.keys, keys, "right")
        padded = np.concatenate([[0], self.keys, [1 << DIRECTIONS * BITS]])
        gap = np.maximum(padded[first + 1] - padded[first], 1)
        between = (keys - padded[first]) / gap
        at = np.where(first == last, first - 1 + between, first + chance * (last - first) - 0.5)
        return np.clip((at + 0.5) / len(self.keys), 0, np.nextafter(1, 0))


def fit_curves(sample: np.ndarray) -> list[Curve]:
    random = np.random.default_rng(SEED)
    dimension = sample.shape[1]
    wide = max(dimension, DIRECTIONS)
    curves = []
    for _ in range(CURVES):
        turned, _ = np.linalg.qr(random.normal(size=(wide, wide)))
        directions = turned[:dimension, :DIRECTIONS]
        projected = sample @ directions
        shift = random.uniform(size=DIRECTIONS)
        cells = 1 << BITS
        edges = [
            np.quantile(projected[:, i], (np.arange(cells - 1) + 0.5 + shift[i] / 2) / cells)
            for i in range(DIRECTIONS)
        ]
        curve = Curve(directions, edges, np.empty(0, np.int64))
        curve.keys = np.sort(curve.key(sample))
        curves.append(curve)
    return curves


def _chance(ids: np.ndarray) -> np.ndarray:
    mixed = (ids.astype(np.int64).view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """A list column as float64 rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, dimension)


def _unpacked(column: pd.Series, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dimension)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the rows that take part, and their dimension (0 if there are none)."""
    v = F.col("v")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("v"),
    ).filter(F.col("vec_id").isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).collect()
    if not sizes:
        return rows, 0
    dimension = max(sizes, key=lambda r: (r.n, r.size)).size
    return rows.filter(F.size("v") == dimension), dimension


def _best_ids(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best distinct ids of each row of ``scores``, best first."""
    order = np.argsort(-scores, axis=1, kind="stable")
    if len(np.unique(ids)) == len(ids):
        return order[:, :k]
    return np.stack([o[np.sort(np.unique(ids[o], return_index=True)[1])[:k]] for o in order])


def _true_neighbours(rows: DataFrame, probes: np.ndarray, ids: np.ndarray, curves, k: int, dimension: int):
    """Positions of the k best ids of each probe over all rows: (probe, score, p0, p1, ...)."""
    shipped = rows.sparkSession.sparkContext.broadcast((probes, ids, curves))
    names = ["probe", "vec_id", "score", *(f"p{c}" for c in range(CURVES))]

    def make():
        held, held_ids, held_curves = shipped.value

        def work(batch):
            x = _matrix(batch.column("v"), dimension)
            vec_ids = batch.column("vec_id").to_numpy()
            scores = held @ x.T
            scores[held_ids[:, None] == vec_ids] = -np.inf
            best = _best_ids(scores, vec_ids, k)
            probe = np.repeat(np.arange(len(held)), best.shape[1])
            at = best.ravel()
            chance = _chance(vec_ids[at])
            columns = [probe, vec_ids[at], scores[probe, at]]
            columns += [c.position(x[at], chance) for c in held_curves]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        return work

    schema = "probe long, vec_id long, score double, " + ", ".join(
        f"p{c} double" for c in range(CURVES)
    )
    found = per_batch(rows.select("vec_id", "v"), make, schema).filter("score > '-Infinity'")
    best = F.max(F.struct(*names[2:])).alias("best")
    found = found.groupBy("probe", "vec_id").agg(best).select("probe", "vec_id", "best.*")
    nth = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= k).drop("nth").toPandas()


def fit(rows: DataFrame, dimension: int, k: int) -> tuple[list[Curve], float, int]:
    """Curves, half width of the window and number of rows."""
    n = rows.count()
    share = min(1.0, SAMPLE / max(n, 1))
    hashed = F.shiftrightunsigned(F.xxhash64("vec_id"), 11).cast("double") * F.lit(2.0**-53)
    sample = rows.filter(hashed < share).toPandas().sort_values("vec_id", ignore_index=True)
    if sample.empty:
        return [], 1.0, n
    x = np.array(sample["v"].tolist(), np.float64)
    curves = fit_curves(x)
    spread = np.unique(np.linspace(0, len(x) - 1, PROBES).astype(int))
    ids = sample["vec_id"].to_numpy()[spread]
    true = _true_neighbours(rows, x[spread], ids, curves, k, dimension)
    if true.empty:
        return curves, 1.0, n
    at = true["probe"].to_numpy()
    chance = _chance(ids)
    apart = [
        np.abs(true[f"p{c}"].to_numpy() - curve.position(x[spread], chance)[at])
        for c, curve in enumerate(curves)
    ]
    return curves, float(np.quantile(np.min(apart, axis=0), RECALL)), n


def _placed(rows: DataFrame, curves: list[Curve], dimension: int) -> DataFrame:
    """(vec_id, v as bytes, p: position on every curve)."""
    shipped = rows.sparkSession.sparkContext.broadcast(curves)

    def make():
        held = shipped.value

        def work(batch):
            x, ids = _matrix(batch.column("v"), dimension), batch.column("vec_id").to_numpy()
            p = np.stack([c.position(x, _chance(ids)) for c in held], axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    pa.array([row.tobytes() for row in x], pa.binary()),
                    pa.array(list(p), pa.list_(pa.float64())),
                ],
                ["vec_id", "v", "p"],
            )

        return work

    return per_batch(rows.select("vec_id", "v"), make, "vec_id long, v binary, p array<double>")


def _best_of_block(queries: pd.DataFrame, rows: pd.DataFrame, width: float, k: int, dimension: int):
    """The k best ids of one block for each query, among those whose first common window is
    on the curve of the block."""
    out = {"query_id": [], "vec_id": [], "score": []}
    if len(queries) and len(rows):
        curve = int(rows["curve"].iloc[0])
        x, ids = _unpacked(rows["v"], dimension), rows["vec_id"].to_numpy()
        p = np.stack(rows["p"].tolist())
        # rows of one id side by side; an id has several if its rows hold different vectors
        by_id = np.argsort(ids, kind="stable")
        x, ids, p = x[by_id], ids[by_id], p[by_id]
        first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
        of_id = np.repeat(np.arange(len(first)), np.diff(first, append=len(ids)))
        all_q, query_ids = _unpacked(queries["v"], dimension), queries["vec_id"].to_numpy()
        all_p = np.stack(queries["p"].tolist())
        for at in range(0, len(queries), QUERIES_AT_ONCE):
            some = slice(at, at + QUERIES_AT_ONCE)
            q, q_ids, q_p = all_q[some], query_ids[some], all_p[some]
            scores = q @ x.T
            near = np.abs(q_p[:, [curve]] - p[:, curve]) <= width
            for earlier in range(curve):
                near &= np.abs(q_p[:, [earlier]] - p[:, earlier]) > width
            scores[~near | (q_ids[:, None] == ids)] = -np.inf
            best = np.maximum.reduceat(scores, first, axis=1) if len(first) < len(ids) else scores
            take = min(k, len(first))
            least = -np.partition(-best, take - 1, axis=1)[:, take - 1]
            # rounding differs between blocks: keep what could tie, then score in one fixed way
            slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
            good = (scores >= (least - slack)[:, None]) & np.isfinite(scores)
            if len(first) < len(ids):
                top = best[:, of_id]
                good &= scores >= top - 1e-9 * (1 + np.abs(top))
            query, row = np.nonzero(good)
            exact = (q[query] * x[row]).sum(axis=1)
            order = np.lexsort((ids[row], -exact, query))
            if len(first) < len(ids):
                pair = query[order] * len(first) + of_id[row[order]]
                order = order[np.sort(np.unique(pair, return_index=True)[1])]
            query, row, exact = query[order], row[order], exact[order]
            nth = np.arange(len(query)) - np.searchsorted(query, query, "left")
            kept = nth < k
            out["query_id"].append(q_ids[query[kept]])
            out["vec_id"].append(ids[row[kept]])
            out["score"].append(exact[kept])
    empty = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
    return pd.DataFrame(
        {c: np.concatenate(v) if v else np.empty(0, empty[c]) for c, v in out.items()}
    )


def nearest(
    vectors: DataFrame,
    is_query: str = "vec_id % 20 = 0",
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest vectors found for each query, best first.

    ``is_query`` is a condition on ``vec_id``; all rows are candidates.
    """
    spark = vectors.sparkSession
    importable(spark)
    rows, dimension = usable(vectors, id_col, vector_col)
    if not dimension:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = stash(rows.dropDuplicates(["vec_id", "v"]), "vectors")
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    indexed = rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1).drop("nth")
    indexed = stash(indexed, "indexed")
    curves, width, n = fit(indexed, dimension, k)
    # enough rows on either side that no query finds fewer than k while there are more
    n_ids = indexed.select("vec_id").distinct().count()
    width = max(width, LEAST_WINDOW * k / n_ids)
    blocks = max(1, -(-n // BLOCK))

    on_curve = F.posexplode("p").alias("curve", "at")
    candidates = _placed(indexed, curves, dimension).select("vec_id", "v", "p", on_curve)
    candidates = candidates.withColumn("block", F.floor(F.col("at") * blocks).cast("int"))
    queries = _placed(rows.filter(is_query), curves, dimension).select("vec_id", "v", "p", on_curve)
    last = F.lit(blocks - 1)
    begin = F.greatest(F.lit(0), F.floor((F.col("at") - width) * blocks).cast("int"))
    end = F.least(last, F.floor((F.col("at") + width) * blocks).cast("int"))
    queries = queries.withColumn("block", F.explode(F.sequence(begin, end)))

    def best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        return _best_of_block(queries, rows, width, k, dimension)

    found = (
        queries.groupBy("curve", "block")
        .cogroup(candidates.groupBy("curve", "block"))
        .applyInPandas(best, "query_id long, vec_id long, score double")
    )
    # only ids with several vectors can meet twice
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
