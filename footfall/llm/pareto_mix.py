"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. Every document is taken whole as often as the target
holds the whole source; these copies are certain. What remains is filled by a sample without
replacement with unequal probabilities: a document of size s has inclusion probability
proportional to s ** POWER, so that longer ones are likelier, scaled so that the expected
words equal what remains and capped at one (such documents are certain as well). Documents
are ranked by random odds divided by inclusion odds (Rosen's Pareto sampling) and taken in
that order until the words reach what remains, stopping where they come nearest.

The random number of a document is a hash of its id and text, so reruns agree, and exact
repeats of a row are neighbours in the order.

No source is sorted as a whole. The ranks are cut into buckets whose words are summed, the
bucket in which the sum is reached is cut once more, and only the documents of that small
interval are ordered.

Edge cases: a null text has size 0, and a document of size 0 carries no words: it gets the
certain copies only. A null source is a source of its own, ordered last. A source without
words has target 0. No documents give no rows. Null and repeated ids are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import WORD, shuffled, stash

WEIGHTS = (1.0, 2.0, 3.0)
MOST_COPIES = 3.0
POWER = 1.0
# Inclusion probabilities are computed per size class: eight classes an octave.
CLASSES_PER_OCTAVE = 8
# Rank buckets: logarithm of the ranking ratio, cut into 1/64, then into 1/4096 of that.
COARSE, FINE = 64, 4096
# Per-source tables up to this many rows are broadcast; beyond, the join is salted.
BROADCAST_SOURCES = 10_000
SALTS = 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(hashed: Column) -> Column:
    """A hash as a number strictly between 0 and 1."""
    return (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) * F.lit(2.0**-53)


def _logit(p: Column) -> Column:
    return F.log(p) - F.log1p(-p)


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES
) -> DataFrame:
    """(source, source_size, weight, target) for (source, source_size).

    The targets share the size of all sources by weight. None exceeds ``most`` times its
    source; the excess goes to the others by weight until none does. A source is full
    exactly if its size per weight is below the level at which the rest is poured, so
    sorting by size per weight finds the full ones without repeated sharing.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    weighted = sizes.withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int")))

    room = F.lit(most) * F.col("source_size")
    up = Window.orderBy(room / F.col("weight"), F.col("source").asc_nulls_last())
    full = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    poured = (
        weighted.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("weights", F.sum("weight").over(every))
        .withColumn("full_room", F.sum(room).over(full))
        .withColumn("full_weight", F.sum("weight").over(full))
        # the level if all sources up to this one are full and the rest share what is left
        .withColumn(
            "level",
            F.when(
                F.col("full_weight") < F.col("weights"),
                (F.col("total") - F.col("full_room")) / (F.col("weights") - F.col("full_weight")),
            ),
        )
        .withColumn("before", F.lag("level").over(up))
        .withColumn("before", F.coalesce("before", F.col("total") / F.col("weights")))
    )
    # the first source that the level before it does not fill ends the full ones
    is_full = room <= F.col("before") * F.col("weight")
    flagged = poured.withColumn("is_full", is_full).withColumn(
        "all_full", F.min(F.col("is_full").cast("int")).over(full) == 1
    )
    level = F.min(F.when(~F.col("all_full"), F.struct(room / F.col("weight"), F.col("before")))).over(
        every
    )
    return flagged.withColumn("final", level.getField("before")).select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("all_full"), room)
        .otherwise(F.least(room, F.col("final") * F.col("weight")))
        .alias("target"),
    )


def _size_class(size: Column) -> Column:
    return F.floor(F.log2(size.cast("double")) * CLASSES_PER_OCTAVE)


def _inclusion(classes: DataFrame) -> DataFrame:
    """(source, class, probability) for (source, class, words, remainder).

    probability = min(1, scale * measure) with the words of the classes times probability
    adding up to the remainder. The largest classes are certain first, so one pass over the
    classes of a source (a few hundred at most) finds how many are.
    """
    measure = F.pow(F.lit(2.0), F.col("class") * (POWER / CLASSES_PER_OCTAVE))
    down = Window.partitionBy("source").orderBy(F.col("class").desc())
    certain = F.coalesce(
        F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    rest = F.sum(F.col("words") * measure).over(
        down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    # the scale if all larger classes are certain; right for the first class it leaves below 1
    scale = (F.col("remainder") - certain) / rest
    scaled = classes.withColumn("measure", measure).withColumn("scale", scale)
    fits = F.when(F.col("scale") * F.col("measure") < 1, F.struct(-F.col("class"), F.col("scale")))
    chosen = F.min(fits).over(Window.partitionBy("source"))
    return scaled.withColumn("chosen", chosen).select(
        "source",
        "class",
        F.when(F.col("chosen").isNull() | (-F.col("class") < F.col("chosen")["col1"]), 1.0)
        .otherwise(F.least(F.lit(1.0), F.col("chosen")["scale"] * F.col("measure")))
        .alias("probability"),
    )


def _with_source(rows: DataFrame, table: DataFrame, extra: list[str] = []) -> DataFrame:
    """Left join of a table with a row per source (and ``extra``): broadcast if it is small,
    else salted so that one source does not meet in one task."""
    keys = ["source", *extra]
    right = table.withColumnsRenamed({k: f"{k}_of" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys]
    if table.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(right), on, "left").drop(*(f"{k}_of" for k in keys))
    salted = rows.withColumn("salt", F.pmod(F.col("hashed"), F.lit(SALTS)).cast("int"))
    right = right.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on.append(F.col("salt") == F.col("salt_of"))
    return salted.join(shuffled(right), on, "left").drop("salt", "salt_of", *(f"{k}_of" for k in keys))


def _reaching(buckets: DataFrame, bucket: str) -> DataFrame:
    """Of the (source, bucket, words, remainder) rows the one of each source in which the
    running words reach the remainder, with the words before it."""
    order = Window.partitionBy("source").orderBy(bucket)
    before = F.sum("words").over(order) - F.col("words")
    running = buckets.withColumn("words_before", before)
    last = F.max(
        F.when(F.col("words_before") < F.col("remainder"), F.col(bucket))
    ).over(Window.partitionBy("source"))
    return running.withColumn("last", last).filter(F.col(bucket) == F.col("last")).drop("last", "words")


def decide_copies(
    sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES
) -> DataFrame:
    """Copies of every row of (doc_id, source, size, hashed); see the module.

    Returns doc_id, size, hashed, source, source_size, target, copies.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(per_source, weights, most)
    whole = F.floor(F.col("target") / F.col("source_size"))
    targets = targets.withColumn(
        "whole", F.when(F.col("source_size") > 0, F.least(whole, F.lit(int(most)))).otherwise(0)
    ).withColumn("remainder", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = stash(targets, "targets")

    with_class = sized.withColumn("class", F.when(F.col("size") > 0, _size_class(F.col("size"))))
    classes = (
        with_class.filter("size > 0")
        .groupBy("source", "class")
        .agg(F.sum("size").alias("words"))
        .join(
            targets.select(F.col("source").alias("s"), "remainder").filter("remainder > 0"),
            F.col("source").eqNullSafe(F.col("s")),
        )
        .drop("s")
    )
    inclusion = stash(_inclusion(classes), "inclusion")
    rows = _with_source(with_class, targets)
    rows = _with_source(rows, inclusion, ["class"])
    order = _logit(_uniform(F.col("hashed"))) - _logit(F.col("probability"))
    # documents of probability 1 come first; those without words or a remainder never
    ranked = rows.withColumn(
        "order",
        F.when(F.col("probability") >= 1, F.lit(-1e6)).when(F.col("probability") > 0, order),
    )
    ranked = stash(
        ranked.withColumn("coarse", F.floor(F.col("order") * COARSE))
        .withColumn("fine", F.floor((F.col("order") * COARSE - F.col("coarse")) * FINE))
        .drop("class", "probability"),
        "ranked",
    )

    coarse = _reaching(
        ranked.filter("coarse is not null")
        .groupBy("source", "coarse")
        .agg(F.sum("size").alias("words"), F.first("remainder").alias("remainder")),
        "coarse",
    )
    coarse = stash(coarse.withColumnRenamed("coarse", "at_coarse"), "coarse")
    inside = _with_source(ranked, coarse.drop("remainder")).filter("coarse = at_coarse")
    fine = _reaching(
        inside.groupBy("source", "fine").agg(
            F.sum("size").alias("words"),
            F.first(F.col("remainder") - F.col("words_before")).alias("remainder"),
        ),
        "fine",
    )
    cuts = stash(
        coarse.select("source", "at_coarse", "words_before").join(
            fine.select(
                F.col("source").alias("s"),
                F.col("fine").alias("at_fine"),
                F.col("words_before").alias("words_in_coarse"),
            ),
            F.col("source").eqNullSafe(F.col("s")),
        ).select(
            "source",
            "at_coarse",
            "at_fine",
            (F.col("words_before") + F.col("words_in_coarse")).alias("words_before"),
        ),
        "cuts",
    )
    placed = _with_source(ranked, cuts)
    here = (F.col("coarse") == F.col("at_coarse")) & (F.col("fine") == F.col("at_fine"))
    below = (F.col("coarse") < F.col("at_coarse")) | (
        (F.col("coarse") == F.col("at_coarse")) & (F.col("fine") < F.col("at_fine"))
    )
    # the interval that holds the cut: take rows while that brings the words nearer
    interval = Window.partitionBy("source").orderBy("order", "hashed", "doc_id", "size")
    last = placed.filter(here).withColumn(
        "so_far",
        F.col("words_before")
        + F.sum("size").over(interval.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    )
    columns = ["doc_id", "size", "hashed", "source", "source_size", "target"]
    drawn = last.withColumn("drawn", F.col("so_far") - F.col("size") / 2 <= F.col("remainder"))
    others = placed.filter(~F.coalesce(here, F.lit(False))).withColumn(
        "drawn", F.coalesce(below, F.lit(False))
    )
    return others.select(*columns, "whole", "drawn").union(drawn.select(*columns, "whole", "drawn")).select(
        *columns, (F.col("whole") + F.col("drawn").cast("long")).cast("long").alias("copies")
    )


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        n_words(F.col(f"`{text_col}`")).alias("size"),
        F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("hashed"),
    )


def mix_plan(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """What the mix takes of every row: doc_id, size, source_size, target, taken, copies."""
    sized = stash(_sized(docs, id_col, text_col, source_col), "sized")
    return decide_copies(sized, weights).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
        "source",
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mixed table: every row as often as the plan takes it, columns unchanged.

    Rows of equal id and text are interchangeable: one of them stands for all and is
    repeated as often as the plan takes them together.
    """
    sized = stash(_sized(docs, id_col, text_col, source_col), "sized")
    plan = decide_copies(sized, weights)
    shares = plan.groupBy("doc_id", "hashed").agg(
        F.sum("copies").alias("mix_copies"), F.count("*").alias("mix_rows")
    )
    shares = shares.filter("mix_copies > 0").withColumnsRenamed(
        {"doc_id": "mix_id", "hashed": "mix_hash"}
    )
    key = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    held = docs.select(key.alias("mix_key"), F.struct("*").alias("mix_row"))
    joined = held.join(
        shares,
        (F.col("mix_key") == F.col("mix_hash"))
        & F.col("mix_row").getField(id_col).eqNullSafe(F.col("mix_id")),
    )
    single = joined.filter("mix_rows = 1")
    several = joined.filter("mix_rows > 1").dropDuplicates(["mix_key", "mix_id"])
    repeated = F.explode(F.array_repeat("mix_row", F.col("mix_copies").cast("int")))
    return single.union(several).select(repeated.alias("mix_row")).select("mix_row.*")
