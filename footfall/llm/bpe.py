"""BPE encoding and decoding: speculate, verify, repair.

Longest-match from the left proposes tokens for every new word. A sequence of tokens is the
BPE encoding exactly if every token encodes itself and every adjacent pair is compatible,
that is, if no merge across their border would have been applied while both sides still had
to grow. All adjacent pairs of all proposals are tested at once with numpy; only words with
a failing pair are merged step by step.

A null text is empty: no ids, an empty decoded text. Rows are independent, so repeated rows
and equal ids give repeated results; an empty table gives no row; extra columns are ignored. Texts are cut at white space and never truncated; one
word of any length is merged with a heap.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from footfall.llm.common import only, per_batch, slices_of

# Bytes remembered per Python worker, of which an entry takes so many beside its text and ids (they
# include its place in the table that finds it), and bytes of text worked on at once.
REMEMBERED_BYTES = 24 << 20
ENTRY_BYTES = 56
BYTES_AT_ONCE = 1 << 20
# Characters in a slice of ``groups_of``.
AT_ONCE = 1 << 20
NEVER = np.iinfo(np.int64).max
# Rank of a pair that no merge joins; twice as much is still a number.
NOWHERE = NEVER // 4
# Longer words are merged with a heap.
SHORT = 48

# Pieces that need no library call: Latin-1 letters, which normalization leaves alone but for
# their case, then ASCII marks (no apostrophe, no "<"), which form one word.
LETTERS = "".join(chr(c) for c in (*range(0x41, 0x7B), *range(0xC0, 0x100)) if chr(c).isalpha())
MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in "'<")
OF_LETTERS, OF_MARKS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$", r"^[!-&(-/:;=-@\[-`{-~]+$"


def _visible_bytes() -> dict[int, int]:
    """Byte -> code point of the byte-level alphabet: printable Latin-1 stands for itself,
    the other bytes take the code points from 256 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {b: 256 + i for i, b in enumerate(others)}


VISIBLE = _visible_bytes()


class MergeTable:
    """Vocabulary and merges of a BPE tokenizer file in the tokenizers format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*self.ids.values(), *self.specials.values()])
        self.strings: list[str] = [""] * self.size
        for string, i in [*self.ids.items(), *self.specials.items()]:
            self.strings[i] = string
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([self.ids[a] for a, _ in merges], np.int64)
        right = np.array([self.ids[b] for _, b in merges], np.int64)
        made = np.array([self.ids[a + b] for a, b in merges], np.int64)
        self.ranks = {
            (a, b): r for r, (a, b) in reversed(list(enumerate(zip(left.tolist(), right.tolist()))))
        }
        self.made, self.made_by_rank = made.tolist(), made
        # birth: rank of the merge that makes a token, -1 for single characters
        self.birth = np.full(self.size, -1, np.int64)
        self.left, self.right = np.full((2, self.size), -1, np.int64)
        self.birth[made], self.left[made], self.right[made] = np.arange(len(made)), left, right
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_ranks = keys[order], order
        # the walk in compatible() relies on parts being older than what they form
        ranks = np.arange(len(made))
        self.ordered = bool(
            np.all(self.birth[left] < ranks)
            and np.all(self.birth[right] < ranks)
            and len(np.unique(made)) == len(made)
        )
        self._grow_trie(self._self_encoding(made, left, right))

    def _self_encoding(self, made, left, right) -> np.ndarray:
        """Which tokens are the encoding of their own characters."""
        sound = np.ones(self.size, bool)
        sound[made] = self.compatible(left, right, 2 * np.arange(len(made)))
        for token, a, b in zip(made.tolist(), left.tolist(), right.tolist()):
            sound[token] &= sound[a] and sound[b]
        return sound

    def pair_ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        keys = x * self.size + y
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.key_ranks[at], NOWHERE)

    def compatible(self, a: np.ndarray, b: np.ndarray, before=None) -> np.ndarray:
        """For each pair of neighbours, whether no merge joins them across the border.

        Time runs backwards: the last merge inside either token is undone until both are
        single characters. While x and y face each other at the border, a merge of them
        would have been applied if it ranks before the merge that ended this state; of
        equal ranks the left place goes first. Times are twice the rank, plus one where
        the right side grew and an equal rank at the border would have won.
        """
        n = len(a)
        good = np.ones(n, bool)
        place, x, y = np.arange(n), a.copy(), b.copy()
        end = np.full(n, 2 * NOWHERE) if before is None else before.copy()
        while len(place):
            joined = 2 * self.pair_ranks(x, y) < end
            good[place[joined]] = False
            bx, by = self.birth[x], self.birth[y]
            on = ~joined & ((bx >= 0) | (by >= 0))
            place, x, y, bx, by = place[on], x[on], y[on], bx[on], by[on]
            undo_right = by >= bx
            end = np.where(undo_right, 2 * by + 1, 2 * bx)
            x = np.where(undo_right, x, self.right[x])
            y = np.where(undo_right, self.left[y], y)
        return good

    def _grow_trie(self, sound: np.ndarray) -> None:
        """Edges (node, symbol) -> node over the symbols of sound tokens.

        Symbols are the characters of the vocabulary from 1 on and 0 for the word end.
        """
        alphabet = sorted({c for t in self.ids for c in t.removesuffix(self.suffix)})
        self.symbol = np.zeros(1 + max(*map(ord, alphabet), *VISIBLE.values()), np.int64)
        for i, c in enumerate(alphabet):
            self.symbol[ord(c)] = i + 1
        self.byte_symbol = self.symbol[[VISIBLE.get(b, b) for b in range(256)]]
        self.fan = len(alphabet) + 1
        edges: dict[tuple[int, int], int] = {}
        token_at = [-1]
        plain = np.full((2, self.fan), -1, np.int64)  # ids of single symbols, inside and last
        for token, i in self.ids.items():
            last = bool(self.suffix) and token.endswith(self.suffix)
            symbols = self.symbol[[ord(c) for c in token.removesuffix(self.suffix)]].tolist()
            if len(symbols) == 1:
                plain[int(last), symbols[0]] = i
            if not sound[i]:
                continue
            node = 0
            for symbol in symbols + [0] * last:
                node = edges.setdefault((node, symbol), len(token_at))
                if node == len(token_at):
                    token_at.append(-1)
            token_at[node] = i
        keys = np.array([n * self.fan + c for n, c in edges], np.int64)
        order = np.argsort(keys)
        self.edge_keys, self.edge_to = keys[order], np.array(list(edges.values()))[order]
        self.token_at, self.single = np.array(token_at, np.int64), plain

    def propose(self, symbols: np.ndarray, first: np.ndarray, stop: np.ndarray):
        """Longest matches from the left in all words at once.

        Word i is symbols[first[i] : stop[i]], its end symbol included. Returns the tokens,
        the word of each token (both in order) and which words could not be covered.
        """
        stuck = np.zeros(len(first), bool)
        word, at, end = np.arange(len(first)), first.copy(), stop.copy()
        node = np.zeros(len(first), np.int64)
        token, token_end = np.full(len(first), -1, np.int64), at.copy()
        tokens, owners = [], []
        while len(word):
            inside = at < end
            keys = node * self.fan + symbols[np.minimum(at, end - 1)]
            edge = np.minimum(np.searchsorted(self.edge_keys, keys), len(self.edge_keys) - 1)
            goes_on = inside & (self.edge_keys[edge] == keys)
            node = np.where(goes_on, self.edge_to[edge], 0)
            at = at + goes_on
            # a token may not leave the bare word end over
            whole = goes_on & (self.token_at[node] >= 0) & (at != end - 1)
            token = np.where(whole, self.token_at[node], token)
            token_end = np.where(whole, at, token_end)
            done = ~goes_on
            stuck[word[done & (token < 0)]] = True
            emitted = done & (token >= 0)
            tokens.append(token[emitted])
            owners.append(word[emitted])
            at = np.where(done, token_end, at)
            live = ~(done & ((token < 0) | (token_end >= end)))
            token = np.where(done, -1, token)
            word, at, end, node = word[live], at[live], end[live], node[live]
            token, token_end = token[live], token_end[live]
        tokens, owners = np.concatenate(tokens), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        return tokens[order], owners[order], stuck

    def merge_many(self, parts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Exact merging of short words at once, in place; ``parts`` is padded with -1 on the
        right. Returns how many parts each word has left."""
        n, width = parts.shape
        columns = np.arange(width)
        ranks = np.full((n, width), NOWHERE)
        pairs = (columns[:-1] + 1) < lengths[:, None]
        ranks[:, :-1][pairs] = self.pair_ranks(parts[:, :-1][pairs], parts[:, 1:][pairs])
        lengths = lengths.copy()
        live = np.arange(n)
        while True:
            at = ranks[live].argmin(axis=1)
            rank = ranks[live, at]
            some = rank < NOWHERE
            live, at, rank = live[some], at[some], rank[some]
            if not len(live):
                break
            parts[live, at] = self.made_by_rank[rank]
            take = np.minimum(columns + (columns > at[:, None]), width - 1)
            parts[live] = np.take_along_axis(parts[live], take, axis=1)
            take = np.minimum(columns + (columns >= at[:, None]), width - 1)
            ranks[live] = np.take_along_axis(ranks[live], take, axis=1)
            lengths[live] -= 1
            for k in (at - 1, at):
                here = (k >= 0) & (k + 1 < lengths[live])
                rows, k0 = live[here], k[here]
                ranks[rows, k0] = self.pair_ranks(parts[rows, k0], parts[rows, k0 + 1])
            ranks[live, lengths[live] - 1] = NOWHERE
        return lengths

    def merge(self, word: str) -> list[int]:
        """Exact merging, lowest rank first and leftmost among equals."""
        symbols = [*word[:-1], word[-1] + self.suffix]
        return self._merge_long([self.ids[s] for s in symbols if s in self.ids])

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(get(p, NEVER), i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.made[rank], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (pair := (parts[k], parts[after[k]])) in self.ranks:
                    heapq.heappush(heap, (self.ranks[pair], k, *pair))
        return [p for p in parts if p >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word (in the alphabet of the vocabulary, not empty)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        tokens, sizes = self._encode(self.symbol[codes], lengths, lambda i: words[i])
        cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        listed = tokens.tolist()
        return [listed[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode_column(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words that are not empty, in plain UTF-8: of all words one after another,
        and how many each has."""
        if not len(words):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        _, offsets, data = words.buffers()
        cuts = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
        symbols = self.byte_symbol[np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]]]

        def word(i):
            return words[i].as_py().encode().decode("latin-1").translate(VISIBLE)

        return self._encode(symbols, np.diff(cuts).astype(np.int64), word)

    def _encode(self, symbols: np.ndarray, lengths: np.ndarray, word) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_column``, for words given by their symbols; word(i) is the text of one."""
        short = (lengths <= SHORT) & self.ordered
        if short.all():
            return self._encode_short(symbols, lengths)
        some, counts = self._encode_short(symbols[np.repeat(short, lengths)], lengths[short])
        merged = {i: self.merge(word(i)) for i in np.flatnonzero(~short).tolist()}
        sizes = np.empty(len(lengths), np.int64)
        sizes[short] = counts
        sizes[~short] = [len(ids) for ids in merged.values()]
        tokens = np.empty(sizes.sum(), np.int64)
        of_short = np.repeat(short, sizes)
        tokens[of_short] = some
        tokens[~of_short] = [i for ids in merged.values() for i in ids]
        return tokens, sizes

    def _encode_short(self, letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(lengths):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ends = int(bool(self.suffix))
        stop = np.cumsum(lengths + ends)
        first = stop - lengths - ends
        symbols = np.zeros(stop[-1], np.int64)
        of_letters = np.ones(stop[-1], bool)
        of_letters[stop - 1] = not ends
        symbols[of_letters] = letters

        tokens, owners, failed = self.propose(symbols, first, stop)
        inside = owners[1:] == owners[:-1]
        good = self.compatible(tokens[:-1][inside], tokens[1:][inside])
        failed[owners[1:][inside][~good]] = True
        sizes = np.bincount(owners, minlength=len(lengths))

        wrong = np.flatnonzero(failed)
        wrong = wrong[np.argsort(lengths[wrong], kind="stable")]
        repaired = []
        for some in np.array_split(wrong, max(1, len(wrong) // 4096)):
            if not len(some):
                continue
            column = np.arange(int(lengths[some].max()) + 1)
            used = column < lengths[some][:, None]
            place = np.minimum(first[some][:, None] + column, len(symbols) - 1)
            last = (column == lengths[some][:, None] - 1).astype(np.int64) * ends
            parts = np.where(used, self.single[last, symbols[place]], -1)
            sizes[some] = self.merge_many(parts, lengths[some])
            repaired.append((some, parts, column))
        starts = np.cumsum(sizes) - sizes
        found = np.empty(sizes.sum(), np.int64)
        found[np.repeat(~failed, sizes)] = tokens[~failed[owners]]
        for some, parts, column in repaired:
            left = column < sizes[some][:, None]
            found[(starts[some][:, None] + column)[left]] = parts[left]
        return found, sizes

    def decode(self, ids: list[int]) -> str:
        """As a tokenizer without a decoder does: the tokens, joined by spaces."""
        return " ".join([self.strings[i] for i in ids])


class PieceEncoder:
    """Ids and decoded form of texts, put together from pieces between white space.

    A piece of letters with marks behind them, or none, is looked up as two keys: the letters in
    lower case and the marks. Any other piece is a key itself. Ids of keys are remembered per
    worker, bounded in bytes: of too many the half used last stays.
    """

    def __init__(self, path: str):
        self.table = MergeTable(path)
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.special = re.compile("(" + "|".join(map(re.escape, self.table.specials)) + ")")
        self.numbers = pa.array([str(i) for i in range(self.table.size)], pa.string())
        self.strings = pa.array(self.table.strings, pa.string())
        # keys, their ids one after another, how many each has, and when each was used last
        self.keys = pa.array([], pa.string())
        self.tokens = np.empty(0, np.int32)
        self.sizes, self.used = np.empty(0, np.int64), np.empty(0, np.int64)
        self.turn = 0

    def _units(self, piece: str) -> list[str | int]:
        """Words and ids of special tokens of a piece."""
        units: list[str | int] = []
        for part in self.special.split(piece) if "<" in piece else [piece]:
            if part in self.table.specials:
                units.append(self.table.specials[part])
            elif part:
                units.extend(w for w, _ in self.split(self.normalize(part)))
        return units

    def _forget(self) -> None:
        """Keep the keys used last if they take too many bytes."""
        sizes = ENTRY_BYTES + self.sizes * self.tokens.itemsize
        sizes += pc.binary_length(self.keys).to_numpy()
        if sizes.sum() <= REMEMBERED_BYTES:
            return
        order = np.argsort(-self.used, kind="stable")
        kept = np.zeros(len(sizes), bool)
        kept[order[np.cumsum(sizes[order]) <= REMEMBERED_BYTES // 2]] = True
        self.keys = self.keys.filter(pa.array(kept))
        self.tokens = self.tokens[np.repeat(kept, self.sizes)]
        self.sizes, self.used = self.sizes[kept], self.used[kept]

    def _learn(self, keys: pa.Array) -> None:
        """Remember new keys, in this order."""
        plain = pc.or_(
            pc.match_substring_regex(keys, OF_LETTERS), pc.match_substring_regex(keys, OF_MARKS)
        )
        some, counts = self.table.encode_column(keys.filter(plain))
        plain = plain.to_numpy(zero_copy_only=False)
        units = [self._units(key) for key in keys.filter(pa.array(~plain)).to_pylist()]
        words = list({u for us in units for u in us if isinstance(u, str)})
        ids_of = {i: [i] for i in self.table.specials.values()}
        ids_of.update(zip(words, self.table.encode_words(words)))
        others = [[i for u in us for i in ids_of[u]] for us in units]
        sizes = np.empty(len(keys), np.int64)
        sizes[plain] = counts
        sizes[~plain] = [len(ids) for ids in others]
        tokens = np.empty(sizes.sum(), np.int32)
        of_plain = np.repeat(plain, sizes)
        tokens[of_plain] = some
        tokens[~of_plain] = [i for ids in others for i in ids]
        self.keys = pa.concat_arrays([self.keys, keys])
        self.tokens = np.concatenate([self.tokens, tokens])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used = np.concatenate([self.used, np.full(len(keys), self.turn)])

    def _rows(self, keys: pa.Array) -> np.ndarray:
        """Where distinct keys are remembered; until the next call."""
        self._forget()
        self.turn += 1
        rows = pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new = keys.take(pa.array(missing))
            # words that begin alike walk the same way through the table
            order = pc.sort_indices(new)
            rows[missing[order.to_numpy()]] = len(self.keys) + np.arange(len(missing))
            self._learn(new.take(order))
        self.used[rows] = self.turn
        return rows

    def _ids(self, keys: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(number of ids, ids joined by spaces, decoded text) of each key."""
        rows = self._rows(keys)
        sizes = self.sizes[rows]
        starts = (np.cumsum(self.sizes) - self.sizes)[rows]
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        tokens = pa.array(self.tokens[np.arange(cuts[-1]) + np.repeat(starts - cuts[:-1], sizes)])
        return sizes, joined(cuts, self.numbers.take(tokens)), joined(cuts, self.strings.take(tokens))

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(number of ids, ids joined by spaces, decoded text) of each distinct piece."""
        words = pc.ascii_rtrim(pieces, MARKS)
        of_letters = pc.match_substring_regex(words, OF_LETTERS)
        marks = pc.utf8_ltrim(pieces, LETTERS)
        marked = pc.and_(of_letters, pc.greater(pc.binary_length(marks), 0))
        words = pc.if_else(of_letters, pc.utf8_lower(words), pieces)
        keys = pa.concat_arrays([words, pc.if_else(marked, marks, None)]).dictionary_encode()
        n, ids, decoded = self._ids(keys.dictionary)
        of_words, of_marks = keys.indices[: len(pieces)], keys.indices[len(pieces) :]
        n_words = n[of_words.to_numpy()]
        n_marks = np.where(marked, n[pc.fill_null(of_marks, 0).to_numpy()], 0)
        blanks = pc.if_else(pa.array((n_words > 0) & (n_marks > 0)), " ", "")
        ids, decoded = (
            pc.binary_join_element_wise(
                column.take(of_words), blanks, pc.fill_null(column.take(of_marks), ""), ""
            )
            for column in (ids, decoded)
        )
        return n_words + n_marks, ids, decoded

    def encode(self, column: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """(number of ids, ids joined by spaces, decoded text) of each text."""
        pieces = pc.ascii_split_whitespace(column)
        distinct = pieces.flatten().dictionary_encode()
        n, ids, decoded = self._pieces(distinct.dictionary)
        cuts, sequence = pieces.offsets.to_numpy().astype(np.int64), distinct.indices.to_numpy()
        # pieces without ids leave no blank behind
        kept = n[sequence] > 0
        if not kept.all():
            sequence, cuts = sequence[kept], np.concatenate([[0], np.cumsum(kept)])[cuts]
        total = np.concatenate([[0], np.cumsum(n[sequence])])
        rows = pa.array(sequence)
        return (
            pa.array(total[cuts[1:]] - total[cuts[:-1]], pa.int64()),
            joined(cuts, ids.take(rows)),
            joined(cuts, decoded.take(rows)),
        )


def joined(cuts: np.ndarray, parts: pa.Array) -> pa.Array:
    """Runs of parts, one from each cut to the next, joined by spaces."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), parts), " ")


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def groups_of(all_texts: list[str], at_once: int = AT_ONCE):
    """Slices of the rows with about ``at_once`` characters each."""
    start = size = 0
    for i, text in enumerate(all_texts):
        size += len(text)
        if size >= at_once or i + 1 == len(all_texts):
            yield slice(start, i + 1)
            start, size = i + 1, 0


def encode_and_decode(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids in decimal, joined by single spaces."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.StringType()),
            T.StructField("decoded", T.StringType()),
        ]
    )

    def make():
        encoder = piece_encoder(vocabulary)

        def work(batch):
            column, doc_ids = pc.fill_null(batch.column("text"), ""), batch.column("doc_id")
            for rows in slices_of(column, BYTES_AT_ONCE):
                yield pa.RecordBatch.from_arrays(
                    [doc_ids[rows], *encoder.encode(column[rows])], schema.fieldNames()
                )
            # workers outlive their task, and what they hold lacks elsewhere in the executor
            pa.default_memory_pool().release_unused()

        return work

    return per_batch(only(docs, doc_id=id_col, text=text_col), make, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """Hashes of the ids and of the decoded text in place of the texts themselves."""
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
