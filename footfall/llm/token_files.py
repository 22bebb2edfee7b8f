"""Token ids in binary files: frequency-ranked, byte-aligned, separate control bytes.

Ids are replaced by their frequency rank, so frequent ones need a single byte. Four ranks
share a control byte, two bits each: the number of data bytes less one. Data bytes are
little-endian and kept apart from the control bytes, which makes decoding a table lookup:
a control byte gives the source positions of the sixteen bytes of its four values.

A file (``part-<partition>-<number>.tok``) holds consecutive documents:

    8 bytes  magic
    5 x int64  partition, ids before the file in its partition, documents, ids, data bytes
    int64    doc_id of each document        uint8  1 where the doc_id is null
    int64    number of ids of each document
    control bytes, data bytes

``ranks`` beside the files lists the id of each rank. Partitions are ascending ranges of
doc_id (nulls first, equal ids in the order of a hash of their ids).

A null text is an empty one: the end id alone. Repeated rows are written as often as they
occur. A document is never split, so a file holds at least one.
"""

from __future__ import annotations

import gc
import json
import re
import string
import uuid
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from footfall.llm.bpe import VISIBLE
from footfall.llm.common import only, per_batch, slices_of, stash

MAGIC = b"FFTOK\x00\x00\x01"
IDS_PER_FILE = 4 << 20
DECODED_AT_ONCE = 1 << 18  # control bytes
COUNTED_AT_ONCE = 1 << 20
# Words remembered per Python worker, those with more than letters among them, and bytes of text
# worked on at once.
REMEMBERED = 1_000_000
REMEMBERED_JOINED = 300_000
AT_ONCE = 1 << 23
# Pieces given to the library in one string, between special tokens.
JOINED = 100

# Where the text may be cut, so that pieces are encoded on their own: before a space that
# precedes anything but white space a pre-token always begins. A line break between two
# characters other than white space is a pre-token itself.
CUT = re.compile(r" (?=\S)")
# Letters, then ASCII marks: two pre-tokens, the second without a space of its own.
LETTERS, MARKS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+"), string.punctuation
# White space, other than spaces and line breaks, in a word, or no word at all.
SPACED = "^$|[" + "".join(rf"\x{{{c:x}}}" for c in range(0x110000) if chr(c).isspace()) + "]"
# Letters beyond ASCII as the model sees them, byte by byte. First the one whose sign stands for
# the first byte of all.
SHOWN = sorted(
    (
        (chr(c), "".join(chr(VISIBLE.get(b, b)) for b in chr(c).encode()))
        for c in range(0xC0, 0x100)
        if LETTERS.fullmatch(chr(c))
    ),
    key=lambda pair: pair[0] != pair[1][0],
)

ENCODED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


class PieceIds:
    """Ids of text pieces as little-endian bytes, remembered per worker."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.width = id_width(path)
        # after a space, and at the start of a line or text
        self.known: dict[str, dict[str, bytes]] = {" ": {}, "": {}}
        # pieces among them that are not of letters alone; there are many more of them
        self.others: dict[str, list[str]] = {" ": [], "": []}
        self.line_break = self._plain("\n")
        # a special token that splits the raw text before anything else is done to it
        added = self.library.get_added_tokens_decoder()
        self.border = next(
            (
                (str(t.content), i)
                for i, t in added.items()
                if not (t.normalized or t.single_word or t.lstrip or t.rstrip)
            ),
            None,
        )

        # Is a word of letters, with a space before it or not, one pre-token and nothing else?
        spec = json.loads(self.library.to_str())
        cut = spec["pre_tokenizer"] or {}
        self.model = None
        if (
            not spec["normalizer"]
            and not spec["truncation"]
            and cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True)
            and not cut["add_prefix_space"]
            and not any(re.fullmatch(r"[\s\w]*", str(t.content)) for t in added.values())
        ):
            self.model = self.library.model

    def _plain(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.width).tobytes()

    def _each(self, pieces: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, self.width).tobytes() for e in found]

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece. Joined by a special token they cost the library less."""
        if not self.border:
            return self._each(pieces)
        text, number = self.border
        encoded = []
        for at in range(0, len(pieces), JOINED):
            some = pieces[at : at + JOINED]
            joined = text.join(some)
            if joined.count(text) != len(some) - 1:
                encoded += self._each(some)
                continue
            found = self.library.encode_batch_fast([joined], add_special_tokens=False)
            ids = np.array(found[0].ids, self.width)
            cuts = np.flatnonzero(ids == number).tolist()
            raw, size = ids.tobytes(), ids.itemsize
            for a, b in zip([-1, *cuts], [*cuts, len(ids)]):
                encoded.append(raw[(a + 1) * size : b * size])
        return encoded

    def _words(self, words: list[str], lead: str) -> list[bytes]:
        """Ids of words of letters that follow ``lead``. They go to the library's model directly,
        which spares the search for special tokens and pre-tokens."""
        if not self.model or not words:
            return self._encode([lead + w for w in words])
        lead = chr(VISIBLE[ord(lead)]) if lead else ""
        shown = lead + ("\n" + lead).join(words)
        for letter, bytes_ in SHOWN:
            shown = shown.replace(letter, bytes_)
        tokens = self.model.tokenize
        kind = "H" if self.width == "<u2" else "I"
        return [array(kind, [t.id for t in tokens(word)]).tobytes() for word in shown.split("\n")]

    def _known(self, pieces: pa.Array, of_letters: pa.Array, lead: str) -> pa.Array:
        """Ids of distinct pieces that follow ``lead``."""
        known, others = self.known[lead], self.others[lead]
        if len(others) > REMEMBERED_JOINED:
            for piece in others:
                known.pop(piece, None)
            others.clear()
        if len(known) > REMEMBERED:
            known.clear()
            others.clear()
        names = pieces.to_pylist()
        found = list(map(known.get, names))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            plain = of_letters.take(pa.array(missing)).to_pylist()
            words = [i for i, letters in zip(missing, plain) if letters]
            rest = [i for i, letters in zip(missing, plain) if not letters]
            texts = [names[i] for i in rest]
            others += texts
            ids = self._words([names[i] for i in words], lead) + self._encode([lead + t for t in texts])
            for i, one in zip(words + rest, ids):
                found[i] = known[names[i]] = one
        return pa.array(found, pa.binary())

    def _ids(self, pieces: pa.Array, lead: str) -> pa.Array:
        """Ids of distinct pieces that follow ``lead``. Letters and the marks behind them are two
        pre-tokens, so they are looked up apart and put together."""
        words = pc.ascii_rtrim(pieces, MARKS)
        of_letters = pc.match_substring_regex(words, f"^{LETTERS.pattern}$")
        words = pc.if_else(of_letters, words, pieces).dictionary_encode()
        # one of the rows of each word; all agree on whether it is of letters
        row = np.empty(len(words.dictionary), np.int64)
        row[words.indices.to_numpy()] = np.arange(len(pieces))
        ids = self._known(words.dictionary, of_letters.take(pa.array(row)), lead).take(words.indices)
        starts = pc.binary_length(words.dictionary).take(words.indices).to_numpy()
        marked = np.flatnonzero(starts < pc.binary_length(pieces).to_numpy())
        if not len(marked):
            return ids
        some = pieces.take(pa.array(marked)).cast(pa.binary()).to_pylist()
        marks = [p[a:].decode() for p, a in zip(some, starts[marked].tolist())]
        marks = pa.array(marks, pa.string()).dictionary_encode()
        # the marks of each piece, the first entry where there are none
        behind = np.zeros(len(pieces), np.int64)
        behind[marked] = marks.indices.to_numpy() + 1
        not_letters = pa.array([False] * len(marks.dictionary))
        mark_ids = self._known(marks.dictionary, not_letters, "")
        mark_ids = pa.concat_arrays([pa.array([b""], pa.binary()), mark_ids])
        return pc.binary_join_element_wise(ids, mark_ids.take(pa.array(behind)), b"")

    def encode(self, group: list[str]) -> list[bytes]:
        """Ids of each text as bytes."""
        return self.encode_column(pa.array(group, pa.string())).to_pylist()

    def encode_column(self, column: pa.Array, end: bytes = b"") -> pa.Array:
        """Ids of each text as bytes, ``end`` behind them.

        Nothing here is cyclic, and walking millions of pieces in search of cycles costs
        a tenth of the time.
        """
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode_column(column, end)
        finally:
            if collecting:
                gc.enable()

    def _encode_column(self, column: pa.Array, end: bytes) -> pa.Array:
        """Each distinct word is looked up once; a text is a sequence of rows of a pool of ids."""
        if not len(column):
            return pa.array([], pa.binary())
        lines = pc.split_pattern(column, "\n")
        words = pc.split_pattern(lines.flatten(), " ")
        distinct = words.flatten().dictionary_encode()
        code, pieces = distinct.indices.to_numpy(), distinct.dictionary
        # where the words of each line, and of each text, begin and end
        of_lines = words.offsets.to_numpy().astype(np.int64)
        of_texts = of_lines[lines.offsets.to_numpy()]

        # texts whose white space is not single spaces and breaks between words
        spaced = pc.match_substring_regex(pieces, SPACED).to_numpy(zero_copy_only=False)
        odd = np.zeros(len(column), bool)
        if spaced.any():
            at = np.flatnonzero(spaced[code])
            odd[np.searchsorted(of_texts, at, side="right") - 1] = True
        heads = np.zeros(len(code), bool)
        heads[of_lines[:-1]] = True
        kept = np.repeat(~odd, np.diff(of_texts))

        pool, rows = [pa.array([self.line_break, end], pa.binary())], np.empty(len(code), np.int64)
        size = 2
        for lead, some in ((" ", kept & ~heads), ("", kept & heads)):
            used = np.flatnonzero(np.bincount(code[some], minlength=len(pieces)))
            row_of = np.empty(len(pieces), np.int64)
            row_of[used] = size + np.arange(len(used))
            rows[some] = row_of[code[some]]
            pool.append(self._ids(pieces.take(pa.array(used)), lead))
            size += len(used)
        pool.append(self._odd(column.filter(pa.array(odd))))

        # breaks lie between the lines of a text; behind each text its end, and before that an
        # odd text as a whole
        place = np.concatenate([[0], np.cumsum(kept)])
        breaks = of_lines[:-1][kept[of_lines[:-1]] & ~np.isin(of_lines[:-1], of_texts)]
        closing = np.repeat(place[of_texts[1:]], 1 + odd)
        closing_rows = np.ones(len(closing), np.int64)
        closing_rows[np.cumsum(1 + odd)[odd] - 2] = size + np.arange(odd.sum())
        inserted = np.concatenate([place[breaks], closing])
        what = np.concatenate([np.zeros(len(breaks), np.int64), closing_rows])
        sequence = np.insert(rows[kept], inserted, what)
        ends = place[of_texts[1:]] + np.searchsorted(place[breaks], place[of_texts[1:]])
        ends += np.cumsum(1 + odd)

        ids = pa.concat_arrays(pool).take(pa.array(sequence))
        borders = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1)
        cuts = pa.py_buffer(borders[np.append(0, ends)])
        return pa.Array.from_buffers(pa.binary(), len(column), [None, cuts, ids.buffers()[2]])

    def _odd(self, column: pa.Array) -> pa.Array:
        """Ids of texts cut before spaces that begin a pre-token."""
        texts = [CUT.split(text) for text in column.to_pylist()]

        def ids(pieces, lead):
            distinct = pa.array(pieces, pa.string()).dictionary_encode()
            return iter(self._ids(distinct.dictionary, lead).take(distinct.indices).to_pylist())

        heads = ids([text[0] for text in texts], "")
        tails = ids([piece for text in texts for piece in text[1:]], " ")
        joined = [next(heads) + b"".join(next(tails) for _ in text[1:]) for text in texts]
        return pa.array(joined, pa.binary())


@lru_cache(maxsize=2)
def piece_ids(path: str) -> PieceIds:
    return PieceIds(path)


@lru_cache(maxsize=4)
def vocabulary_size(path: str) -> int:
    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def id_width(path: str) -> str:
    return "<u2" if vocabulary_size(path) <= 1 << 16 else "<u4"


def encode_ids(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str):
    """(doc_id, n_tokens, ids) with the end id appended; ids in the narrowest width."""

    def make():
        encoder = piece_ids(vocabulary)
        end = np.array([end_id], encoder.width).tobytes()

        def work(batch):
            column, doc_ids = pc.fill_null(batch.column("text"), ""), batch.column("doc_id")
            for rows in slices_of(column, AT_ONCE):
                found = encoder.encode_column(column[rows], end)
                counts = pc.divide(pc.binary_length(found), len(end)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [doc_ids[rows], counts, found], ENCODED.fieldNames()
                )

        return work

    return per_batch(only(docs, doc_id=id_col, text=text_col), make, ENCODED)


def rank_table(encoded: DataFrame, width: str, size: int) -> np.ndarray:
    """Ids by falling frequency, ties by id. At most ``size`` counts reach the driver."""

    def make():
        def work(batch):
            counts = np.zeros(size, np.int64)
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), width)
            for at in range(0, len(ids), COUNTED_AT_ONCE):
                counts += np.bincount(ids[at : at + COUNTED_AT_ONCE], minlength=size)
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "n"])

        return work

    rows = (
        per_batch(encoded.select("ids"), make, "id long, n long")
        .groupBy("id")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    counts = np.zeros(size, np.int64)
    for row in rows:
        counts[row.id] = row.n
    return np.argsort(-counts, kind="stable")


def _length_table() -> np.ndarray:
    """For each control byte which of its sixteen output bytes are in the data."""
    lengths = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3) + 1
    return (np.arange(4) < lengths[:, :, None]).reshape(256, 16)


PRESENT = _length_table()
CONSUMED = PRESENT.sum(axis=1)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of uint32 values."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = extra
    control = codes.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)
    return np.bitwise_or.reduce(control, axis=1).astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values behind control and data bytes (uint8 arrays)."""
    values = np.zeros(len(control) * 16, np.uint8)
    # absent values of the last group take a byte each that is not there
    data = np.concatenate([data, np.zeros(4, np.uint8)])
    at = 0
    for start in range(0, len(control), DECODED_AT_ONCE):
        part = control[start : start + DECODED_AT_ONCE]
        used = int(CONSUMED[part].sum())
        out = values[16 * start : 16 * (start + len(part))]
        out[PRESENT[part].ravel()] = data[at : at + used]
        at += used
    values = values.view("<u4")
    return values[:n]


def _file_bytes(partition: int, before: int, rows: list[tuple], ranks: np.ndarray) -> bytes:
    doc_ids, lengths, _ = zip(*rows)
    control, data = pack(ranks)
    return b"".join(
        [
            MAGIC,
            np.array([partition, before, len(rows), len(ranks), len(data)], "<i8").tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.array(lengths, "<i8").tobytes(),
            control,
            data,
        ]
    )


def _put(folder: str, name: str, content: bytes) -> None:
    """Write whole or not at all, so that a lost or repeated task leaves no half file."""
    # Hadoop writes file:/x for what others call file:///x
    files, path = pafs.FileSystem.from_uri(re.sub(r"^file:/(?=[^/])", "file:///", folder))
    files.create_dir(path, recursive=True)
    partial = f"{path}/_{uuid.uuid4().hex}"
    with files.open_output_stream(partial) as out:
        out.write(content)
    files.move(partial, f"{path}/{name}")


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write all documents in ascending doc_id order; a row per partition with its ids."""
    spark, width = docs.sparkSession, id_width(vocabulary)
    encoded = stash(encode_ids(docs, vocabulary, end_id, id_col, text_col), "ids")
    id_of = rank_table(encoded, width, vocabulary_size(vocabulary))
    rank_of = np.argsort(id_of).astype("<u4")
    ranked = spark.createDataFrame(
        [(r, i) for r, i in enumerate(id_of.tolist())], "rank int, id int"
    )
    ranked.coalesce(1).write.parquet(f"{path}/ranks")

    def make():
        partition = TaskContext.get().partitionId()
        state = {"file": 0, "before": 0, "rows": [], "held": 0}

        def flush():
            rows = state["rows"]
            ids = np.frombuffer(b"".join(r[2] for r in rows), width)
            name = f"part-{partition:06d}-{state['file']:06d}.tok"
            _put(f"{path}/files", name, _file_bytes(partition, state["before"], rows, rank_of[ids]))
            state.update(
                file=state["file"] + 1, before=state["before"] + len(ids), rows=[], held=0
            )
            return pa.RecordBatch.from_arrays(
                [pa.array([partition]), pa.array([len(ids)], pa.int64())], ["part", "n_ids"]
            )

        def work(batch):
            for row in zip(*(batch.column(c).to_pylist() for c in ENCODED.fieldNames())):
                if state["rows"] and state["held"] + row[1] > IDS_PER_FILE:
                    yield flush()
                state["rows"].append(row)
                state["held"] += row[1]

        work.finish = lambda: [flush()] if state["rows"] else []
        return work

    def run(batches):
        work = make()
        for batch in batches:
            yield from work(batch)
        yield from work.finish()

    ordered = (
        encoded.withColumn("salt", F.xxhash64("ids"))
        .repartitionByRange("doc_id", "salt")
        .sortWithinPartitions("doc_id", "salt")
        .select(*ENCODED.fieldNames())
    )
    written = ordered.mapInArrow(run, "part long, n_ids long")
    return stash(written.groupBy("part").agg(F.sum("n_ids").alias("n_ids")), "written")


def read_token_files(spark: SparkSession, path: str, parts: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files; ids as little-endian uint32.

    ``parts`` is what the writer returned; one number per partition reaches the driver.
    """
    sizes = {r.part: r.n_ids for r in parts.collect()}
    base, total = {}, 0
    for part in sorted(sizes):
        base[part], total = total, total + sizes[part]
    ranked = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    id_of = np.array([r.id for r in ranked], "<u4")
    schema = "doc_id long, start long, n_tokens long, ids binary"
    names = ["doc_id", "start", "n_tokens", "ids"]

    def read(content: bytes):
        partition, before, n_docs, n_ids, n_data = np.frombuffer(content, "<i8", 5, 8).tolist()
        at = 48
        doc_ids = np.frombuffer(content, "<i8", n_docs, at)
        missing = np.frombuffer(content, np.uint8, n_docs, at + 8 * n_docs).astype(bool)
        lengths = np.frombuffer(content, "<i8", n_docs, at + 9 * n_docs)
        at += 17 * n_docs
        control = np.frombuffer(content, np.uint8, -(-n_ids // 4), at)
        data = np.frombuffer(content, np.uint8, n_data, at + len(control))
        ids = id_of[unpack(control, data, n_ids)]
        ends = np.cumsum(lengths)
        starts = ends - lengths
        blob = ids.tobytes()
        for some in range(0, n_docs, 500):
            rows = slice(some, some + 500)
            cuts = zip(starts[rows].tolist(), ends[rows].tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids[rows], mask=missing[rows]),
                    pa.array(base[partition] + before + starts[rows]),
                    pa.array(lengths[rows]),
                    pa.array([blob[4 * a : 4 * b] for a, b in cuts], pa.binary()),
                ],
                names,
            )

    def make():
        def work(batch):
            for content in batch.column("content"):
                yield from read(content.as_py())

        return work

    if not sizes:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(f"{path}/files").select("content")
    return per_batch(files, make, schema)
