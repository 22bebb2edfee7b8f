"""Quality rules: compression bands.

zstandard shrinks ordinary prose by a factor that depends on little but the length of
the input. A text far above that factor repeats itself, one far below is noise
(base64, keys, random characters). Both the whole text and each fixed-size chunk are
compressed, so a text that is fine on the whole but repetitive or random in places is
seen as well.

The limits are fitted, length by length, to all documents labelled good (``fit_bands``);
lengths of which there are too few have wide general limits.

Edge cases: a null text has no words and fails the base rules, like an empty one.
Repeated rows and equal ids are judged row by row. Texts of any length are compressed
in streams of one chunk or in one call; nothing is cut off. An empty table gives no row; without
labels all limits are the general ones. Extra columns are ignored, or kept where the table
itself is returned.
"""

from __future__ import annotations

from collections import Counter
from math import ceil, floor, log, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from footfall.llm.common import only, per_batch, shuffled, stash, texts

LEVEL = 3
CHUNK_BYTES = 4096
# A last chunk shorter than this belongs to the chunk before it.
LEAST_CHUNK = 1024


class Band(NamedTuple):
    """Limits of raw / compressed size for inputs of at least ``least_bytes``."""

    least_bytes: int
    lowest: float
    highest: float


# General limits, for lengths of which there is no good sample. The shorter the input, the less
# there is to refer back to, and the more the frame header weighs. Base64 stays under 1.35 at
# any length; prose of some 2,000 bytes shrinks by 1.8 or more. Chunks are held to the band of
# their own size.
BANDS = (
    Band(0, 0.95, 3.5),
    Band(512, 1.25, 4.0),
    Band(2048, 1.4, 5.0),
    Band(8192, 1.5, 6.5),
    Band(65536, 1.6, 8.0),
)
# Fitting: bands of lengths that grow by this factor, at least so many inputs in a band, the
# share of inputs left outside on either side, bands on either side that are looked at
# together, and what is added to the limits - besides their distance divided by the root of the
# number of inputs, as few inputs show little of the spread.
LENGTH_STEP = 1.25
LEAST_INPUTS = 10
NEAR = 2
SHARE_OUTSIDE = 0.001
MARGIN = 0.01
# Ratios are ranked bin by bin; so many bins hold ratios that differ by a factor of e.
BINS = 200
# A text goes when more than this share of its chunks is out of band.
MOST_BAD_CHUNKS = 0.1

LEAST_WORDS = 50
SYMBOLS = "#*$%&|<>"

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("ratio", T.DoubleType()),
        T.StructField("n_chunks", T.LongType()),
        T.StructField("n_bad_chunks", T.LongType()),
    ]
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur more than once."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    total, covered = 0, 0  # covered: end of the last counted window
    for start, window in enumerate(windows):
        if seen[window] > 1:
            total += start + 3 - max(start, covered)
            covered = start + 3
    return total


def duplicate_lines(raw: bytes) -> int:
    """Lines holding a word that equal an earlier line."""
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def chunk_sizes(n: int) -> list[int]:
    """Sizes of the fixed chunks of ``n`` bytes; a short tail joins the last one."""
    full, tail = divmod(n, CHUNK_BYTES)
    if not full or tail >= LEAST_CHUNK:
        return [CHUNK_BYTES] * full + ([tail] if tail else [])
    return [CHUNK_BYTES] * (full - 1) + [CHUNK_BYTES + tail]


def in_band(n_bytes: int, ratio: float, bands: tuple[Band, ...] = BANDS) -> bool:
    band = next(b for b in reversed(bands) if n_bytes >= b.least_bytes)
    return band.lowest <= ratio <= band.highest


def ratios(text: str, packer: zstandard.ZstdCompressor) -> list[tuple[int, float]]:
    """(bytes, ratio) of the whole text and of its chunks, none where the base rules fail."""
    raw = text.encode()
    words = raw.split()
    if base_fails(len(words), repeated_words(words)):
        return []
    found, at = [(len(raw), len(raw) / len(packer.compress(raw)))], 0
    sizes = chunk_sizes(len(raw))
    for size in sizes if len(sizes) > 1 else ():
        found.append((size, size / len(packer.compress(raw[at : at + size]))))
        at += size
    return found


def percentiles(
    values: DataFrame, shares: tuple[float, ...], least: int
) -> dict[int, tuple[float, ...]]:
    """step -> (number of values, exact percentiles) of (step, ratio), for steps of ``least`` or more.

    As the aggregate function ``percentile`` gives them, but no task holds all values of a step:
    counts by bin tell in which bins the values of the wanted ranks lie, and only these are sorted.
    """
    counts = stash(
        values.groupBy("step", "ratio")
        .agg(F.count("*").alias("n"))
        .withColumn("bin", F.floor(F.log("ratio") * BINS)),
        "ratios",
    )
    of_step = Window.partitionBy("step")
    up_to = of_step.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.array_distinct(
        F.flatten(
            F.array(
                *(
                    F.array(F.floor((F.col("total") - 1) * s), F.ceil((F.col("total") - 1) * s))
                    for s in map(F.lit, shares)
                )
            )
        )
    )
    bins = (
        counts.groupBy("step", "bin")
        .agg(F.sum("n").alias("in_bin"))
        .withColumns({"total": F.sum("in_bin").over(of_step), "upto": F.sum("in_bin").over(up_to)})
        .filter(F.col("total") >= least)
        .withColumns({"before": F.col("upto") - F.col("in_bin"), "ranks": wanted})
        .filter(F.exists("ranks", lambda r: (r >= F.col("before")) & (r < F.col("upto"))))
        .drop("in_bin", "upto")
    )
    # two bins for each share and step at most
    inside = counts.join(F.broadcast(bins), ["step", "bin"])
    up_to = Window.partitionBy("step", "bin").orderBy("ratio")
    up_to = up_to.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.col("before") + F.sum("n").over(up_to)
    ranked = (
        inside.withColumn("last", last)
        .withColumn(
            "ranks",
            F.filter("ranks", lambda r: (r < F.col("last")) & (r >= F.col("last") - F.col("n"))),
        )
        .select("step", "total", "ratio", F.explode("ranks").alias("rank"))
        .collect()  # two values for each share and step at most, some 60 steps up to a gigabyte
    )
    found = {(r.step, r.rank): r.ratio for r in ranked}

    def percentile(step: int, total: int, share: float) -> float:
        at = (total - 1) * share
        low, high = found[step, floor(at)], found[step, ceil(at)]
        return low if low == high else (ceil(at) - at) * low + (at - floor(at)) * high

    totals = {r.step: r.total for r in ranked}
    return {k: (n, *(percentile(k, n, share) for share in shares)) for k, n in totals.items()}


def fit_bands(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    most: int | None = None,
) -> tuple[Band, ...]:
    """Limits for every length, from the ratios of all documents labelled good.

    ``labels`` has doc_id and quality (1 for good). Of the inputs of a band ``SHARE_OUTSIDE`` lie
    below and as many above its limits, before these are widened. A caller may ask for ``most``
    documents only: those with the least hash of their id.
    """
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id")
    good = good.distinct()
    if most is not None:
        good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    plain = only(docs, doc_id=id_col, text=text_col).filter("doc_id is not null")

    def make():
        packer = zstandard.ZstdCompressor(level=LEVEL)

        def work(batch):
            found = [ratios(text, packer) for text in texts(batch)]
            rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows)),
                    pa.array([n for f in found for n, _ in f], pa.int64()),
                    pa.array([r for f in found for _, r in f], pa.float64()),
                ],
                ["doc_id", "n_bytes", "ratio"],
            )

        return work

    step = F.floor(F.log(F.col("n_bytes").cast("double")) / log(LENGTH_STEP)).cast("int")
    # numbers meet the labels, as there may be as many labels as texts and texts are long
    schema = T.StructType(
        [
            T.StructField("doc_id", plain.schema["doc_id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("ratio", T.DoubleType()),
        ]
    )
    measured = per_batch(plain, make, schema).join(shuffled(good), "doc_id", "left_semi")
    shares = SHARE_OUTSIDE, 0.5, 1 - SHARE_OUTSIDE
    limits = percentiles(measured.select(step.alias("step"), "ratio"), shares, LEAST_INPUTS)
    known = {}
    for at, (_, _, middle, _) in limits.items():
        # how far inputs lie from the middle hardly depends on the length: bands help each other
        near = [limits[k] for k in range(at - NEAR, at + NEAR + 1) if k in limits]
        low = min(lowest - own for _, lowest, own, _ in near)
        high = max(highest - own for _, _, own, highest in near)
        more = MARGIN + (high - low) / sqrt(sum(n for n, *_ in near))
        known[at] = middle + low - more, middle + high + more
    bands = []
    for at in range(max(known, default=-1) + 2):
        least = ceil(LENGTH_STEP**at) if at else 0
        general = next(b for b in reversed(BANDS) if least >= b.least_bytes)
        bands.append(Band(least, *known.get(at, (general.lowest, general.highest))))
    last = bands[-1].least_bytes if bands else 0
    return (*bands, *(b for b in BANDS if b.least_bytes > last)) if bands else BANDS


def base_fails(n_words: int, n_repeat: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat > 50 * n_words


def judge(
    text: str, packer: zstandard.ZstdCompressor, bands: tuple[Band, ...] = BANDS
) -> tuple:
    raw = text.encode()
    words = raw.split()
    n_words = len(words)
    word_chars = len(text) - sum(text.count(c) for c in " \t\n\v\f\r")
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    n_repeat = repeated_words(words)
    base_failed = base_fails(n_words, n_repeat)

    ratio, bad, sizes = None, 0, chunk_sizes(len(raw))
    if raw:
        ratio = len(raw) / len(packer.compress(raw))
        at = 0
        for size in sizes:
            bad += not in_band(size, size / len(packer.compress(raw[at : at + size])), bands)
            at += size
    fine = bool(raw) and in_band(len(raw), ratio, bands) and bad <= MOST_BAD_CHUNKS * len(sizes)
    kept = not base_failed and fine
    counts = n_words, word_chars, n_symbols, duplicate_lines(raw), n_repeat
    return *counts, base_failed, kept, ratio, len(sizes), bad


def quality_report(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bands: tuple[Band, ...] = BANDS,
) -> DataFrame:
    """Counts, base verdict and band verdict of every row."""

    def make():
        packer = zstandard.ZstdCompressor(level=LEVEL)

        def work(batch):
            judged = [judge(text, packer, bands) for text in texts(batch)]
            columns = [batch.column("doc_id").to_pylist(), *zip(*judged)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, to_arrow_schema(SCHEMA).types)],
                SCHEMA.fieldNames(),
            )

        return work

    return per_batch(only(docs, doc_id=id_col, text=text_col), make, SCHEMA)


def keep_good(
    docs: DataFrame, text_col: str = "text", bands: tuple[Band, ...] = BANDS
) -> DataFrame:
    """The rows whose text passes, with all their columns."""

    def make():
        packer = zstandard.ZstdCompressor(level=LEVEL)

        def work(batch):
            verdicts = [judge(t, packer, bands)[6] for t in texts(batch, text_col)]
            yield batch.filter(pa.array(verdicts, pa.bool_()))

        return work

    return per_batch(docs, make, docs.schema)
