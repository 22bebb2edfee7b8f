"""Hidden Markov language model, trained with Baum-Welch on all training texts.

A text is a sequence of words and one end mark. Hidden states follow each other as a Markov
chain; a state emits the class of a word, and the class the word:

    p(text) = sum over state paths of  prod p(state | state before) p(class | state) p(word | class)

The most frequent words are classes of their own (a bounded number, all words above a count
that is read off a histogram); every other word belongs to one of a fixed number of classes
by a hash of its ending, which carries over to words never seen. p(word | class) is estimated
from the counts of all training words, with one share for unseen words, as in the unigram
base score. The last factor does not depend on the states, so training needs classes only.

Training: expected counts of each partition are added up by Spark (a row per class, a vector
over the states) and the driver, which sees as many numbers as the model has, normalises them.
Every round reads all training texts. Scoring is the forward recursion over whole texts, in
batches of texts of similar length, scaled every few steps.

The word counts are a distributed table. Frequent words are looked up in a bounded table that
goes to the tasks; rare ones are joined, and only their sums per text come back.

Edge cases: a null or wordless text is the end mark alone. With no training text all counts
are zero and the scores uniform. Null ids are hashed as an empty text; repeated rows and equal
ids are scored row by row.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.llm.common import only, per_batch, slices_of, stash

STATES = 8
# Frequent words that are classes of their own, and those whose counts go to the tasks.
OWN_CLASSES = 8192
LOOKED_UP = 65536
# Classes of the other words, by a hash of their last three bytes.
ENDINGS = 4096
ENDING_BYTES = 3
SMOOTHING = 0.1
HELD_OUT_OF = 10
# Rounds of training; each reads all training texts (one in one).
ROUNDS = (1,) * 8
# Tokens worked on at once; bounds the memory of the forward values.
AT_ONCE = 1 << 19
# Steps between two scalings. A step shrinks the values to no less than the smoothing share of
# all words, over 1e-20, so that this many stay far from the least double.
SCALED_EVERY = 8
# Bytes of text whose words are counted, and looked up, together.
COUNTED_AT_ONCE = 1 << 25
LOOKED_UP_AT_ONCE = 1 << 23
END = b"\n"  # cannot be a word
SEED = 7


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT_OF == 0


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, one after the other, and where those of each text begin and end.

    Splits at the six characters of ASCII white space, which are those that end a word.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column))
    words, borders = lists.flatten().cast(pa.binary()), lists.offsets.to_numpy().astype(np.int64)
    # white space at either end leaves an empty word there
    full = pc.greater(pc.binary_length(words), 0)
    if pc.all(full).as_py() is False:
        before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        words, borders = words.filter(full), before[borders]
    return words, borders


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the training texts of (doc_id, text), end marks included."""

    def make():
        def work(batch):
            learned = pa.array([not held_out(i) for i in batch.column("doc_id").to_pylist()])
            column = pc.fill_null(batch.column("text"), "").filter(learned)
            for rows in slices_of(column, COUNTED_AT_ONCE):
                counts = pc.value_counts(words_of(column[rows])[0])
                ends = pa.array([rows.stop - rows.start], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([counts.field("values"), pa.array([END], pa.binary())]),
                        pa.concat_arrays([counts.field("counts"), ends]),
                    ],
                    ["word", "c"],
                )

        return work

    counted = per_batch(docs, make, "word binary, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int) -> dict[bytes, int]:
    """All words above the lowest count that leaves at most ``most`` of them.

    The count is found in a histogram of counts with 64 steps an octave, so its size does
    not grow with the vocabulary.
    """
    step = F.floor(F.log2(F.col("c").cast("double")) * 64).cast("int")
    histogram = sorted(
        ((r.step, r.n) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()),
        reverse=True,
    )
    total, least = 0, None
    for at, n in histogram:
        if total + n > most:
            break
        total, least = total + n, at
    if least is None:
        return {}
    return {bytes(r.word): r.c for r in counts.filter(step >= least).select("word", "c").collect()}


@dataclass
class Lexicon:
    """Bounded tables that turn words into classes and counts."""

    classes: dict[bytes, int]
    counts: dict[bytes, int]
    n_classes: int
    n_tokens: int
    n_words: int
    # log10 of the denominator of p(word | class) for each ending
    spread: np.ndarray

    def ending(self, word: bytes) -> int:
        return len(self.classes) + zlib.crc32(word[-ENDING_BYTES:]) % ENDINGS


def lexicon_of(counts: DataFrame) -> Lexicon:
    ends = F.sum(F.when(F.col("word") == F.lit(END), F.col("c")))
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), ends.alias("ends")).first()
    looked_up = frequent_words(counts, LOOKED_UP)
    # every text has an end mark, which is never joined as rare words are
    if totals.ends:
        looked_up[END] = totals.ends
    own = sorted(looked_up, key=lambda w: (-looked_up[w], w))[: OWN_CLASSES - 1]
    # the end mark is a class even if nothing was learned
    own = [END, *(w for w in own if w != END)]
    classes = {w: i for i, w in enumerate(own)}
    ending = F.crc32(F.expr(f"substring(word, greatest(1, length(word) - {ENDING_BYTES - 1}))"))
    grouped = (
        counts.withColumn("ending", (ending % ENDINGS).cast("int"))
        .groupBy("ending")
        .agg(F.sum("c").alias("n"), F.count("*").alias("v"))
        .collect()
    )
    mass, types = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in grouped:
        mass[r.ending], types[r.ending] = r.n, r.v
    for word in own:
        at = zlib.crc32(word[-ENDING_BYTES:]) % ENDINGS
        if word in looked_up:
            mass[at] -= looked_up[word]
            types[at] -= 1
    spread = np.log10(mass + SMOOTHING * (types + 1))
    return Lexicon(
        classes, looked_up, len(own) + ENDINGS, totals.n or 0, totals.v or 0, spread
    )


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def ending_numbers(words: pa.Array) -> np.ndarray:
    """crc32 of the last bytes of each word, as ``Lexicon.ending`` takes it, among ``ENDINGS``."""
    if not len(words):
        return np.zeros(0, np.int64)
    _, borders, content = words.buffers()
    borders = np.frombuffer(borders, np.int32)[words.offset : words.offset + len(words) + 1]
    content, ends, lengths = np.frombuffer(content, np.uint8), borders[1:], np.diff(borders)
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for back in range(ENDING_BYTES, 0, -1):
        reach = np.flatnonzero(lengths >= back)
        some = crc[reach]
        crc[reach] = CRC[(some ^ content[ends[reach] - back]) & 0xFF] ^ some >> 8
    return (~crc % ENDINGS).astype(np.int64)


class WordNumbers:
    """Rows of the tables of a lexicon: looked-up words have rows of their own; other words the
    row of their ending."""

    def __init__(self, lexicon: Lexicon):
        own = lexicon.classes
        others = [w for w in lexicon.counts if w not in own]
        words = [*sorted(own, key=own.__getitem__), *others]
        self.words = pa.array(words, pa.binary())
        self.end = words.index(END)
        # rows from here on are those of endings
        self.endings = len(words)
        classes = [*range(len(own)), *map(lexicon.ending, others)]
        classes += range(len(own), len(own) + ENDINGS)
        self.classes = np.array(classes, "<u2")
        counts = np.array([lexicon.counts.get(w, 0) for w in words], np.float64)
        nothing = np.zeros(ENDINGS)
        self.known = np.array([w in lexicon.counts for w in words] + [False] * ENDINGS)
        # log10(c + 0.1) of looked-up words, log10 p(word | class) as far as known of all
        self.base = np.concatenate([np.log10(counts + SMOOTHING), nothing])
        self.inside = np.where(self.known, self.base, 0)
        self.inside[: len(own)] = 0
        self.inside[len(own) :] -= lexicon.spread[self.classes[len(own) :] - np.uint16(len(own))]


def encode(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Texts as classes (uint16) with what the bounded tables tell about their words.

    uid names the row from here on. known, base and spread: number of looked-up tokens,
    the sums of log10(c + 0.1) over them and of log10 p(word | class) as far as known.
    rare: the words that are not in the tables, repeats included; times: how often each occurs
    in the text, at its first place, and zero at the others.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(lexicon)

    def make():
        numbers = WordNumbers(shipped.value)

        def sums(values, starts):
            return pa.array(np.add.reduceat(values, starts))

        def work(batch):
            column, ids = pc.fill_null(batch.column("text"), ""), batch.column("doc_id")
            held = pa.array([held_out(i) for i in ids.to_pylist()], pa.bool_())
            for rows in slices_of(column, LOOKED_UP_AT_ONCE):
                words, borders = words_of(column[rows])
                row_of = pc.index_in(words, value_set=numbers.words).fill_null(-1).to_numpy()
                places = np.flatnonzero(row_of < 0)
                rare = words.take(pa.array(places))
                row_of = row_of.astype(np.int64)
                row_of[places] = numbers.endings + ending_numbers(rare)
                # an end mark behind the words of each text
                lengths = np.diff(borders) + 1
                ends = np.cumsum(lengths)
                starts = ends - lengths
                at = np.insert(row_of, borders[1:], numbers.end)
                rare_borders = np.searchsorted(places, borders)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[rows],
                        held[rows],
                        pa.Array.from_buffers(
                            pa.binary(),
                            len(lengths),
                            [
                                None,
                                pa.py_buffer(np.append(0, 2 * ends).astype(np.int32)),
                                pa.py_buffer(numbers.classes[at]),
                            ],
                        ),
                        pa.array(lengths),
                        sums(numbers.known[at].astype(np.int64), starts),
                        sums(numbers.base[at], starts),
                        sums(numbers.inside[at], starts),
                        pa.ListArray.from_arrays(pa.array(rare_borders, pa.int32()), rare),
                        pa.ListArray.from_arrays(
                            pa.array(rare_borders, pa.int32()), pa.array(times_of(rare, rare_borders))
                        ),
                    ],
                    schema.fieldNames(),
                )

        return work

    schema = T.StructType.fromDDL(
        "doc_id long, held_out boolean, classes binary, n_tokens long, known long, base double, "
        "inside double, rare array<binary>, times array<long>"
    )
    return per_batch(docs, make, schema).withColumn("uid", F.monotonically_increasing_id())


def times_of(words: pa.Array, borders: np.ndarray) -> np.ndarray:
    """How often each word occurs between its borders: at its first place, zero at the others."""
    distinct = words.dictionary_encode()
    text = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    keys = text * len(distinct.dictionary) + distinct.indices.to_numpy()
    _, first, n = np.unique(keys, return_index=True, return_counts=True)
    times = np.zeros(len(words), np.int64)
    times[first] = n
    return times


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states


def first_model(n_classes: int, seed: int = SEED) -> Model:
    """States that tend to stay and emit classes almost alike, apart by a little chance."""
    random = np.random.default_rng(seed)
    move = np.full((STATES, STATES), 0.1 / (STATES - 1))
    np.fill_diagonal(move, 0.9)
    emit = random.uniform(0.5, 1.5, (n_classes, STATES))
    return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0))


class Batch:
    """Sequences side by side, longest first, so that those still running are a prefix.

    Values of all tokens lie step by step, so a step is a slice. Only the forward values of all
    tokens are held; the others are those of one step, which stay in the processor's cache.
    """

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences], np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate([sequences[i] for i in self.order])
        lengths = lengths[self.order]
        first = np.cumsum(lengths) - lengths
        running = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        ends = np.cumsum(running)
        begins = ends - running
        step = np.repeat(np.arange(len(running)), running)
        row = np.arange(len(flat)) - begins[step]
        self.classes = flat[first[row] + step].astype(np.int64)
        # where the last token of each sequence is
        self.last = begins[lengths - 1] + np.arange(len(lengths))
        self.spans = list(zip(begins.tolist(), ends.tolist()))

    def forward(self, model: Model, keep: bool):
        """Forward recursion, scaled every few steps: log likelihoods or, to be kept, scaled values
        and the scales by step (repeated for all states, which spares a loop per row)."""
        values, room = np.empty((len(self.classes), STATES)), np.empty((len(self.order), STATES))
        scales, ones, last = {}, np.ones((STATES, STATES)), None
        for step, (begin, end) in enumerate(self.spans):
            alpha, seen = values[begin:end], room[: end - begin]
            # checking the bounds would cost a copy
            np.take(model.emit, self.classes[begin:end], axis=0, out=seen, mode="clip")
            if last is None:
                np.multiply(seen, model.start, out=alpha)
            else:
                np.matmul(values[last : last + end - begin], model.move, out=alpha)
                alpha *= seen
            if step % SCALED_EVERY == SCALED_EVERY - 1:
                scales[step] = alpha @ ones
                alpha /= scales[step]
            last = begin
        if keep:
            return None, values, scales
        found = np.log(values[self.last].sum(axis=1))
        for scale in scales.values():
            found[: len(scale)] += np.log(scale[:, 0])
        result = np.empty_like(found)
        result[self.order] = found
        return result, None, None

    def expected(self, model: Model):
        """Expected counts of starts, moves and emissions."""
        _, values, scales = self.forward(model, keep=True)
        n_classes, n = len(model.emit), len(self.order)
        move, back = np.zeros((STATES, STATES)), np.ascontiguousarray(model.move.T)
        # of the last token of each sequence; those of running ones are written over
        all_beta = np.repeat(1 / values[self.last].sum(axis=1, keepdims=True), STATES, axis=1)
        room = np.empty_like(all_beta)
        # expected states of all tokens, state by state, which are added up in that order
        found = np.empty((STATES, len(values)))
        for step in range(len(self.spans) - 1, -1, -1):
            begin, end = self.spans[step]
            alpha, beta, ahead = values[begin:end], all_beta[: end - begin], room[: end - begin]
            if step:
                np.take(model.emit, self.classes[begin:end], axis=0, out=ahead, mode="clip")
                if step in scales:
                    ahead /= scales[step]
                ahead *= beta
                last = self.spans[step - 1][0]
                move += values[last : last + end - begin].T @ ahead
            np.multiply(alpha.T, beta.T, out=found[:, begin:end])
            if step:
                np.matmul(ahead, back, out=beta)
        emit = np.empty((STATES, n_classes))
        for state in range(STATES):
            emit[state] = np.bincount(self.classes, found[state], n_classes)
        return found[:, :n].sum(axis=1), move * model.move, emit.T


def _batches(rows: list[bytes], at_once: int = AT_ONCE):
    """Positions of sequences of similar length, about ``at_once`` classes together."""
    sizes = [len(r) // 2 for r in rows]
    some, total = [], 0
    for i in sorted(range(len(rows)), key=sizes.__getitem__):
        some.append(i)
        total += sizes[i]
        if total >= at_once:
            yield some
            some, total = [], 0
    if some:
        yield some


def _sequences(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("classes").to_pylist()


def train(encoded: DataFrame, n_classes: int, rounds: tuple[int, ...] = ROUNDS) -> Model:
    """Baum-Welch over all training rows of ``encoded``, one round per entry of ``rounds``."""
    if set(rounds) - {1}:
        raise ValueError("every round reads all training texts: shares other than 1 are not taken")
    spark = encoded.sparkSession
    model = first_model(n_classes)
    learned = encoded.filter("not held_out").select("classes")
    for _ in rounds:
        shipped = spark.sparkContext.broadcast(model)

        def make(shipped=shipped):
            held = shipped.value

            def work(batch):
                rows = _sequences(batch)
                start, move = np.zeros(STATES), np.zeros((STATES, STATES))
                emit = np.zeros(held.emit.shape)
                for some in _batches(rows):
                    counts = Batch([np.frombuffer(rows[i], "<u2") for i in some]).expected(held)
                    start, move, emit = start + counts[0], move + counts[1], emit + counts[2]
                used = np.flatnonzero(emit.sum(axis=1))
                keys = np.concatenate([[-1], -2 - np.arange(STATES), used])
                table = np.concatenate([start[None, :], move, emit[used]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), *(pa.array(table[:, s]) for s in range(STATES))], names
                )

            return work

        names = ["key", *(f"s{s}" for s in range(STATES))]
        schema = ", ".join(["key long", *(f"s{s} double" for s in range(STATES))])
        counted = (
            per_batch(learned, make, schema)
            .groupBy("key")
            .agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(STATES)))
            .collect()
        )
        model = _maximize(counted, n_classes)
        shipped.destroy()
    return model


def _maximize(counted: list, n_classes: int) -> Model:
    start, move = np.full(STATES, 1.0), np.full((STATES, STATES), 1.0)
    emit = np.full((n_classes, STATES), SMOOTHING / STATES)
    for row in counted:
        values = np.array(row[1:])
        if row.key == -1:
            start += values
        elif row.key < -1:
            move[-2 - row.key] += values
        else:
            emit[row.key] += values
    return Model(
        start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)
    )


def sequence_scores(encoded: DataFrame, model: Model) -> DataFrame:
    """(uid, path_score): log10 likelihood of the classes of every row."""
    shipped = encoded.sparkSession.sparkContext.broadcast(model)

    def make():
        held = shipped.value

        def work(batch):
            rows = _sequences(batch)
            scores = np.empty(len(rows))
            for some in _batches(rows):
                sequences = [np.frombuffer(rows[i], "<u2") for i in some]
                scores[some] = Batch(sequences).forward(held, keep=False)[0] / np.log(10)
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), pa.array(scores)], ["uid", "path_score"]
            )

        return work

    return per_batch(encoded.select("uid", "classes"), make, "uid long, path_score double")


def rare_sums(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """(uid, rare_known, rare_sum): what the rare words of a row add, by joining their counts."""
    words = encoded.select("uid", F.inline(F.arrays_zip("rare", "times")).alias("word", "n"))
    # a word that is not in the tables has a bounded count, so no key is hot, except for
    # words of held-out texts that were never learned; each of them is one row per text
    words = words.filter("n > 0")
    joined = words.join(counts, "word", "left")
    log_count = F.log10(F.coalesce("c", F.lit(0)) + SMOOTHING)
    return joined.groupBy("uid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * log_count).alias("rare_sum"),
    )


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: tuple[int, ...] = ROUNDS,
) -> DataFrame:
    """Unigram base score and model score of every row, learned from the training rows."""
    plain = only(docs, doc_id=id_col, text=text_col)
    counts = stash(word_counts(plain), "word_counts")
    lexicon = lexicon_of(counts)
    encoded = stash(encode(plain, lexicon), "classes")
    model = train(encoded, lexicon.n_classes, rounds)

    n, v = lexicon.n_tokens, lexicon.n_words
    denominator = float(np.log10(n + SMOOTHING * (v + 1)))
    paths = sequence_scores(encoded, model)
    rest = encoded.select("uid", "doc_id", "held_out", "n_tokens", "known", "base", "inside")
    zero = F.lit(0)
    rare_sum = F.coalesce("rare_sum", zero)
    return (
        rest.join(paths, "uid")
        .join(rare_sums(encoded, counts), "uid", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known") + F.coalesce("rare_known", zero)).alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base") + rare_sum - F.col("n_tokens") * F.lit(denominator)).alias("base_score"),
            (F.col("path_score") + F.col("inside") + rare_sum).alias("score"),
        )
    )
