"""Frequent phrases whose words attract each other, from Rabin-Karp fingerprints.

Texts are cut into pieces and words by byte classes in numpy. Prefix polynomials modulo 2^64
over the bytes give every word a hash, prefix polynomials over those hashes give every run of
words a fingerprint. Work goes in steps, each a scan of the texts in blocks of bounded size:

1. Fingerprints of words and pairs are counted. Those found often enough set a bit in a map of
   fixed size. A clash only lets a rare phrase through to the next step.
2. Words, pairs and triples that can still be frequent (a triple needs both of its pairs) are
   aggregated by fingerprint: their number, the row of an occurrence, and the least and
   greatest value of a second, independent hash.
3. The texts at those rows give the phrases. Where the second hash shows that several texts
   share a fingerprint, all occurrences of that fingerprint are counted again by their text.

Every task adds up equal fingerprints before Spark sees them, so a word that fills a third
of a table costs one row per task. Scores are exact decimals.

Edge cases: a null text is empty, a null lang is ``und``. Rows count as often as they occur, ids
play no part. A text of any length is read in blocks that overlap by two words. Ties in score
and frequency are ordered by the phrase. An empty table gives no row; extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.llm.common import importable, only, stash

LEAST_FREQUENCY = 10
MOST_PER_LANG = 2000
# A phrase goes when a longer one has at least this share (in percent) of its occurrences.
COVERED_PERCENT = 50
NO_LANG = "und"

# Bytes of text worked on at once, and entries a task holds before it hands them on.
BLOCK_BYTES = 2 << 20
TEXTS_AT_ONCE = 200
HELD_BYTES = 24 << 20
PENDING_BYTES = 12 << 20
ROWS_PER_BATCH = 100_000
# Bits of the map of possibly frequent fingerprints: 16 MB, whatever the data.
MAP_BITS = 27
# Bits of one of Spark's bitmaps (a fixed value).
BUCKET = 32768
# Parts of a language that are ranked on their own before all of it is.
RANKED_APART = 64

WORD, BLANK, BREAK = 0, 1, 2
CLASS = np.zeros(256, np.uint8)
CLASS[list(b" \t")] = BLANK
CLASS[list(b".,;:!?\n\v\f\r")] = BREAK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on every other."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Polynomial:
    """Hashes of spans from prefix sums of value * base^position, modulo 2^64.

    The base is odd, hence invertible: the difference of two prefixes times the inverse power
    of the start no longer depends on where the span lies.
    """

    STEP = 1 << 16

    def __init__(self, base: int):
        inverse = pow(base, -1, 1 << 64)
        self.powers, self.leap = self._powers(base)
        self.inverses, self.inverse_leap = self._powers(inverse)

    def _powers(self, base: int) -> tuple[np.ndarray, int]:
        powers = np.full(self.STEP, base, U64)
        powers[0] = 1
        return np.cumprod(powers), pow(base, self.STEP, 1 << 64)

    def spans(self, values, n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of every span [start, end) of ``n`` values; both bounds ascend.

        ``values(a, b)`` returns the values from a to b, so that a long input is never held
        as 64-bit numbers.
        """
        at_start, at_end = np.zeros(len(starts), U64), np.zeros(len(ends), U64)
        before, scale = U64(0), 1
        for a in range(0, n, self.STEP):
            b = min(a + self.STEP, n)
            prefix = np.cumsum(values(a, b) * self.powers[: b - a]) * U64(scale) + before
            for bounds, found in ((starts, at_start), (ends, at_end)):
                low, high = np.searchsorted(bounds, (a, b), "right")
                found[low:high] = prefix[bounds[low:high] - a - 1]
            before, scale = prefix[-1], scale * self.leap % (1 << 64)
        leaps = np.full(n // self.STEP + 1, self.inverse_leap, U64)
        leaps[0] = 1
        back = np.cumprod(leaps)[starts // self.STEP] * self.inverses[starts % self.STEP]
        return (at_end - at_start) * back


class Hash(NamedTuple):
    """Polynomials of one family: over bytes and over word hashes, and its seed."""

    of_bytes: Polynomial
    of_words: Polynomial
    byte_values: np.ndarray
    seed: int


def _hash(seed: int) -> Hash:
    bases = [xxhash.xxh64_intdigest(f"base {i}", seed) | 1 for i in range(2)]
    values = [xxhash.xxh64_intdigest(bytes([b]), seed) for b in range(256)]
    return Hash(Polynomial(bases[0]), Polynomial(bases[1]), np.array(values, U64), seed)


FINGERPRINT, CHECK = _hash(1), _hash(2)


class Block(NamedTuple):
    """Lower-case bytes, words in them, and which words follow the one before in its piece."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    joined: np.ndarray
    # of each word: the text it belongs to. Words before ``new`` were in the block before.
    doc: np.ndarray
    new: int

    def runs(self, size: int) -> np.ndarray:
        """First words of all runs of ``size`` words of one piece that end in a new word."""
        whole = np.ones(max(len(self.starts) - size + 1, 0), bool)
        for k in range(size - 1):
            whole &= self.joined[k : k + len(whole)]
        first = np.flatnonzero(whole)
        return first[first + size > self.new]

    def word_hashes(self, family: Hash) -> np.ndarray:
        def values(a, b):
            return family.byte_values[self.raw[a:b]]

        return mixed(family.of_bytes.spans(values, len(self.raw), self.starts, self.ends))

    def phrase(self, first: int, size: int) -> str:
        if not size:
            return ""
        return b" ".join(
            self.raw[self.starts[i] : self.ends[i]].tobytes() for i in range(first, first + size)
        ).decode()


def blocks(texts: pa.Array) -> Iterator[Block]:
    """The texts as blocks; consecutive blocks share up to two words, so no run is cut."""
    for at in range(0, len(texts), TEXTS_AT_ONCE):
        for block in _blocks(texts.slice(at, TEXTS_AT_ONCE)):
            yield block._replace(doc=block.doc + at)


def _blocks(texts: pa.Array) -> Iterator[Block]:
    large = pa.large_string()
    nothing, line_end = pa.scalar("", large), pa.scalar("\n", large)
    lines = pc.binary_join_element_wise(texts.cast(large), nothing, line_end)
    offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
    blob = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    text_ends = offsets[1:] - offsets[0]
    at, context, stop = 0, 0, 0
    while stop < len(blob):
        # up to a byte that is no part of a word; the last one never is
        stop = min(stop + BLOCK_BYTES, len(blob)) - 1
        while not CLASS[blob[stop]]:
            ahead = np.flatnonzero(CLASS[blob[stop : stop + BLOCK_BYTES]])
            stop += int(ahead[0]) if len(ahead) else BLOCK_BYTES
        stop += 1
        raw = LOWER[blob[at:stop]]
        kind = CLASS[raw]
        edges = np.flatnonzero(np.diff(kind == WORD, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        if len(starts) > context:
            gaps = np.maximum.reduceat(kind, ends)[:-1]
            doc = np.searchsorted(text_ends, starts + at, "right")
            yield Block(raw, starts, ends, gaps < BREAK, doc, context)
        context = min(2, len(starts))
        at = at + int(starts[-context]) if context else stop


class Runs(NamedTuple):
    """Runs of ``size`` words: first word, text and fingerprint of each."""

    size: int
    first: np.ndarray
    doc: np.ndarray
    fp: np.ndarray

    def only(self, kept: np.ndarray) -> Runs:
        return Runs(self.size, self.first[kept], self.doc[kept], self.fp[kept])


class Reader:
    """Fingerprints of runs of words. ``bits`` is how many bits of them are kept."""

    def __init__(self, bits: int):
        self.bits = bits

    def begin(self, langs: pa.Array) -> None:
        """Seeds of the texts of a batch: equal words of two languages differ."""
        coded = langs.dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.seeds = {
            f.seed: np.array([xxhash.xxh64_intdigest(x, f.seed) for x in names], U64)[codes]
            for f in (FINGERPRINT, CHECK)
        }

    def _hashes(self, words, first, doc, size, family: Hash) -> np.ndarray:
        spans = family.of_words.spans(lambda a, b: words[a:b], len(words), first, first + size)
        return mixed(spans ^ mixed(self.seeds[family.seed][doc] + U64(size)))

    def runs(self, block: Block, words: np.ndarray, size: int, first=None) -> Runs:
        """All runs of a size, or those beginning at the words ``first``."""
        first = block.runs(size) if first is None else first
        doc = block.doc[first]
        fp = self._hashes(words, first, doc, size, FINGERPRINT) >> U64(64 - self.bits)
        return Runs(size, first, doc, fp)

    def checks(self, words: np.ndarray, runs: Runs) -> np.ndarray:
        found = self._hashes(words, runs.first, runs.doc, runs.size, CHECK)
        return (found >> U64(33)).astype(np.int32)

    def no_words(self, block: Block) -> tuple[Runs, np.ndarray]:
        """The empty run of each text with new words; it counts once for each of them."""
        _, at, n = np.unique(block.doc[block.new :], return_index=True, return_counts=True)
        nothing = np.zeros(len(block.starts), U64)
        return self.runs(block, nothing, 0, at + block.new), n


class Totals:
    """Adds up equal fingerprints of a task in sorted arrays of bounded size.

    Columns: fp, n, and for pointers also the least and greatest check and the least row.
    """

    MERGE = (None, np.add, np.minimum, np.maximum, np.minimum)

    def __init__(self, names: list[str]):
        self.names, self.held, self.pending, self.size = names, None, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.pending.append(columns)
        self.size += sum(c.nbytes for c in columns)
        if self.size >= PENDING_BYTES:
            self._merge()
            if sum(c.nbytes for c in self.held) >= HELD_BYTES:
                # the rarer half goes on; what was frequent so far is likely to come again
                n = self.held[1]
                rare = n <= np.partition(n, len(n) // 2)[len(n) // 2]
                yield from self._batches([c[rare] for c in self.held])
                self.held = [c[~rare] for c in self.held]

    def _merge(self) -> None:
        tables = ([self.held] if self.held else []) + self.pending
        columns = [list(c) for c in zip(*tables)]
        self.held, self.pending, self.size = [], [], 0
        del tables
        fp = np.concatenate(columns[0])
        order = np.argsort(fp, kind="stable")
        fp = fp[order]
        at = np.flatnonzero(np.concatenate((np.ones(min(len(fp), 1), bool), fp[1:] != fp[:-1])))
        self.held.append(fp[at])
        # column by column, each freed before the next
        for i, merge in enumerate(self.MERGE[1 : len(columns)], 1):
            column, columns[i] = np.concatenate(columns[i])[order], None
            self.held.append(merge.reduceat(column, at) if len(at) else column)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.pending:
            self._merge()
        if self.held:
            yield from self._batches(self.held)
        self.held = None

    def _batches(self, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        columns = [columns[0].view(np.int64), *columns[1:]]
        for a in range(0, len(columns[0]), ROWS_PER_BATCH):
            part = [pa.array(c[a : a + ROWS_PER_BATCH]) for c in columns]
            yield pa.RecordBatch.from_arrays(part, self.names)


class FixedMap:
    """One bit for each value of the first bits of a fingerprint."""

    def __init__(self, bits: int, buckets: np.ndarray, bitmaps: list[bytes]):
        self.shift = max(0, bits - MAP_BITS)
        self.bytes = np.zeros((max(1, (1 << min(bits, MAP_BITS)) // BUCKET), BUCKET // 8), np.uint8)
        for bucket, bitmap in zip(buckets, bitmaps):
            self.bytes[bucket - 1] = np.frombuffer(bitmap, np.uint8)
        self.bytes = self.bytes.ravel()

    def holds(self, fp: np.ndarray) -> np.ndarray:
        place = fp >> U64(self.shift)
        return self.bytes[place >> U64(3)] >> (place & U64(7)).astype(np.uint8) & 1 == 1


def fixed_map(fps: DataFrame, bits: int) -> FixedMap:
    """The map of a column ``fp``: at most 4,096 bitmaps of 4 KB reach the driver."""
    # numbers of buckets and places in them count from 1
    place = F.shiftrightunsigned("fp", max(0, bits - MAP_BITS)) + 1
    found = (
        fps.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("at"))
        .repartition("bucket")
        .groupBy("bucket")
        .agg(F.bitmap_construct_agg("at").alias("bitmap"))
        .toArrow()
    )
    return FixedMap(bits, found["bucket"].to_numpy(), found["bitmap"].to_pylist())


def _scan(docs: DataFrame, schema: str, bits: int, make) -> DataFrame:
    """Map the texts block by block. ``make(reader)`` returns (per block, at the end)."""
    importable(docs.sparkSession)

    def run(batches):
        reader = Reader(bits)
        work, finish = make(reader)
        for batch in batches:
            reader.begin(batch.column("lang"))
            for block in blocks(batch.column("text")):
                yield from work(batch, block)
        yield from finish()

    return docs.mapInArrow(run, schema)


def counted(docs: DataFrame, bits: int) -> DataFrame:
    """(fp, n) of words and pairs, added up per task."""

    def make(reader):
        totals = Totals(["fp", "n"])

        def work(batch, block):
            words = block.word_hashes(FINGERPRINT)
            for size in (1, 2):
                fp = reader.runs(block, words, size).fp
                yield from totals.add(fp, np.ones(len(fp), np.int64))

        return work, totals.flush

    return _scan(docs, "fp long, n long", bits, make)


def possible_runs(reader: Reader, block: Block, words: np.ndarray, frequent) -> Iterator[Runs]:
    """Runs of 1 to 3 words that the map allows; a triple needs both of its pairs."""
    single = reader.runs(block, words, 1)
    yield single.only(frequent.holds(single.fp))
    # pairs of words of the block before take part in triples, but are not counted again
    pairs = reader.runs(block._replace(new=0), words, 2)
    pairs = pairs.only(frequent.holds(pairs.fp))
    yield pairs.only(pairs.first + 2 > block.new)
    begins = np.zeros(len(words) + 1, bool)
    begins[pairs.first] = True
    triples = pairs.first[begins[pairs.first + 1]]
    yield reader.runs(block, words, 3, triples[triples + 3 > block.new])


def pointed(docs: DataFrame, bits: int, possible) -> DataFrame:
    """(fp, n, low, high, row) of all runs that may be frequent, and of the empty run.

    ``possible`` is the broadcast map of frequent words and pairs. low, high: bounds of the
    second hash. row: where the run occurs.
    """

    def make(reader):
        totals = Totals(["fp", "n", "low", "high", "row"])

        def work(batch, block):
            rows = batch.column("row").to_numpy()
            words, checked = (block.word_hashes(f) for f in (FINGERPRINT, CHECK))
            empty, n = reader.no_words(block)
            check = reader.checks(np.zeros_like(checked), empty)
            yield from totals.add(empty.fp, n, check, check, rows[empty.doc])
            for runs in possible_runs(reader, block, words, possible.value):
                check, ones = reader.checks(checked, runs), np.ones(len(runs.fp), np.int64)
                yield from totals.add(runs.fp, ones, check, check, rows[runs.doc])

        return work, totals.flush

    return _scan(docs, "fp long, n long, low int, high int, row long", bits, make)


def _all_runs(reader: Reader, block: Block) -> Iterator[Runs]:
    words = block.word_hashes(FINGERPRINT)
    yield reader.no_words(block)[0]
    for size in (1, 2, 3):
        yield reader.runs(block, words, size)


def _batch(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), ROWS_PER_BATCH):
        columns = zip(*rows[a : a + ROWS_PER_BATCH])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
        )


PHRASES = pa.schema(
    [("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())]
)


def phrases_at(docs: DataFrame, found: DataFrame, bits: int) -> DataFrame:
    """(lang, size, phrase, n) behind fingerprints, read at the row that each points to."""
    wanted = found.groupBy("row").agg(F.collect_list(F.struct("fp", "n")).alias("wanted"))
    rows = docs.join(wanted, "row").select("lang", "text", "wanted")

    def make(reader):
        state = {"batch": None}

        def begin(batch):
            lists = batch.column("wanted")
            flat = lists.flatten()
            fp = flat.field("fp").to_numpy().view(U64)
            order = np.argsort(fp)
            state["batch"], state["fp"] = batch, fp[order]
            state["n"] = flat.field("n").to_numpy()[order]
            lengths = pc.list_value_length(lists).to_numpy()
            state["doc"] = np.repeat(np.arange(len(lengths)), lengths)[order]
            state["open"] = np.ones(len(order), bool)
            state["langs"] = batch.column("lang").to_pylist()

        def work(batch, block):
            if batch is not state["batch"]:
                begin(batch)
            rows = []
            for runs in _all_runs(reader, block):
                # a fingerprint points to one row, so it occurs once among those wanted
                at = np.minimum(np.searchsorted(state["fp"], runs.fp), len(state["fp"]) - 1)
                hit = (state["fp"][at] == runs.fp) & (state["doc"][at] == runs.doc)
                some = np.flatnonzero(hit & state["open"][at])
                at, first = np.unique(at[some], return_index=True)
                state["open"][at] = False
                firsts, docs_ = runs.first[some[first]], runs.doc[some[first]]
                for word, doc, n in zip(
                    firsts.tolist(), docs_.tolist(), state["n"][at].tolist()
                ):
                    text = block.phrase(word, runs.size)
                    rows.append((state["langs"][doc], runs.size, text, n))
            yield from _batch(rows, PHRASES)

        return work, lambda: ()

    return _scan(rows, "lang string, size int, phrase string, n long", bits, make)


def recounted(docs: DataFrame, collided: DataFrame, bits: int) -> DataFrame:
    """(lang, size, phrase, n) of all runs with one of the fingerprints, counted by text."""
    possible = docs.sparkSession.sparkContext.broadcast(fixed_map(collided, bits))
    schema = pa.schema([("fp", pa.int64()), *PHRASES])

    def make(reader):
        def work(batch, block):
            langs, seen = batch.column("lang").to_pylist(), Counter()
            _, words = reader.no_words(block)
            for runs in _all_runs(reader, block):
                weights = words if runs.size == 0 else np.ones(len(runs.fp), np.int64)
                kept = possible.value.holds(runs.fp)
                runs, weights = runs.only(kept), weights[kept]
                fps = runs.fp.view(np.int64).tolist()
                for fp, doc, first, n in zip(
                    fps, runs.doc.tolist(), runs.first.tolist(), weights.tolist()
                ):
                    seen[fp, langs[doc], runs.size, block.phrase(first, runs.size)] += n
            yield from _batch([(*key, n) for key, n in seen.items()], schema)

        return work, lambda: ()

    rows = _scan(docs, "fp long, lang string, size int, phrase string, n long", bits, make)
    return (
        rows.join(collided, "fp", "left_semi")
        .groupBy("lang", "size", "phrase")
        .agg(F.sum("n").alias("n"))
    )


def frequent_runs(
    docs: DataFrame,
    least: int = LEAST_FREQUENCY,
    bits: int = 64,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """(lang, size, phrase, n): runs of 1 to 3 words that occur ``least`` times in a language.

    Size 0, the empty phrase, has the number of words of the language. ``bits`` shortens the
    fingerprints; the result does not depend on it.
    """
    spark = docs.sparkSession
    plain = only(docs, lang=lang_col, text=text_col).filter("text <> ''")
    numbered = stash(
        plain.select(
            F.monotonically_increasing_id().alias("row"),
            F.coalesce("lang", F.lit(NO_LANG)).alias("lang"),
            "text",
        ),
        "numbered",
    )
    enough = F.col("n") >= least
    short = counted(numbered, bits).groupBy("fp").agg(F.sum("n").alias("n")).filter(enough)
    possible = spark.sparkContext.broadcast(fixed_map(short, bits))
    groups = (
        pointed(numbered, bits, possible)
        .groupBy("fp")
        .agg(
            F.sum("n").alias("n"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.min("row").alias("row"),
        )
    )
    groups = stash(groups.filter(enough), "fingerprints")
    one_text = F.col("low") == F.col("high")
    found = phrases_at(numbered, groups.filter(one_text), bits)
    collided = groups.filter(~one_text).select("fp")
    if not collided.isEmpty():
        found = found.union(recounted(numbered, collided, bits).filter(enough))
    return stash(found, "phrases")


def collocations(
    docs: DataFrame,
    least: int = LEAST_FREQUENCY,
    most: int = MOST_PER_LANG,
    bits: int = 64,
    lang_col: str = "lang",
    text_col: str = "text",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``most`` best phrases.

    a: occurrences of the phrase, l and r: of the parts at its weakest cut, n: words of the
    language. score = floor(1000000 * a^2 / (l * r)) of that cut. Phrases inside a longer
    candidate that has at least half of their occurrences are left out.
    """
    runs = frequent_runs(docs, least, bits, lang_col, text_col)
    words = F.split("phrase", " ")
    candidates = runs.filter("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"))

    longer = candidates.filter("size = 3").select(
        "lang",
        F.explode(
            F.array(F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 2), " "))
        ).alias("phrase"),
        F.col("a").alias("within"),
    )
    covered = longer.groupBy("lang", "phrase").agg(F.max("within").alias("within"))
    kept = candidates.join(covered, ["lang", "phrase"], "left").filter(
        F.col("within").isNull() | (100 * F.col("within") < COVERED_PERCENT * F.col("a"))
    )

    cuts = kept.select(
        "lang", "phrase", "a", words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    ).select(
        "lang",
        "phrase",
        "a",
        "k",
        F.array_join(F.expr("slice(words, 1, k)"), " ").alias("first"),
        F.array_join(F.expr("slice(words, k + 1, size(words) - k)"), " ").alias("rest"),
    )
    parts = runs.filter("size IN (1, 2)")
    left = parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    exact = {c: f"CAST({c} AS DECIMAL(15, 0))" for c in "alr"}
    score = "CAST(1000000 AS DECIMAL(7, 0)) * {a} * {a} div ({l} * {r})".format(**exact)
    weakest = (
        cuts.join(left, ["lang", "first"])
        .join(right, ["lang", "rest"])
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct(F.expr(score).alias("score"), "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.*")
    )
    order = F.desc("score"), F.desc("a"), F.asc("phrase")
    # the best of each part first, so that a language is ranked from a bounded number of rows
    apart = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_APART))).orderBy(*order)
    weakest = weakest.withColumn("place", F.row_number().over(apart)).filter(F.col("place") <= most)
    best = Window.partitionBy("lang").orderBy(*order)
    sizes = runs.filter("size = 0").select("lang", "n")
    return (
        weakest.withColumn("rank", F.row_number().over(best).cast("long"))
        .filter(F.col("rank") <= most)
        .join(sizes, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
