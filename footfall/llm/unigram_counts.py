"""Token counts under a unigram vocabulary, by dynamic programming over a trie of words.

A word's best segmentation is the one whose pieces have the highest total score. The score
of a prefix does not depend on what follows, so words are inserted in a trie and the forward
scores are computed once per node: new words are visited in sorted order, which walks their
trie depth first, and only the characters after the prefix shared with the word before are
worked on. The number of pieces of the best segmentation is stored where a word ends.

Words are what stands between white space, with the word mark of the vocabulary in front.
A character that is in no piece costs one piece for each of its UTF-8 bytes. Of equal scores
the segmentation with fewer pieces counts. A null or wordless text has no words and no
tokens. Rows are independent of each other; texts and words of any length are worked on whole.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from footfall.llm.bpe import groups_of
from footfall.llm.common import only, per_batch, texts

WORD_MARK = "▁"
# Below the lowest score of the vocabulary, for each byte without a piece of its own.
UNKNOWN_PENALTY = 10.0
REMEMBERED = 600_000


class UnigramScores:
    """Pieces with their scores, and the counts of the words seen by this worker."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        usable = [
            i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        ]
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in usable}
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        # the longest piece for each last character bounds the look back
        self.reach: dict[str, int] = {}
        for piece in self.scores:
            self.reach[piece[-1]] = max(len(piece), self.reach.get(piece[-1], 0))
        self.counts: dict[bytes, int] = {}

    def learn(self, words: list[bytes]) -> None:
        """Counts of new words, walking their trie depth first."""
        scores, reach, unknown = self.scores, self.reach, self.unknown
        path: list[tuple[float, int]] = [(0.0, 0)]  # (score, - pieces) of each prefix
        last = ""
        for raw in sorted(words):
            word = WORD_MARK + raw.decode()
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                char = word[end - 1]
                bytes_alone = len(char.encode())
                score, pieces = path[-1]
                best = (score + unknown * bytes_alone, pieces - bytes_alone)
                for begin in range(end - 1, max(-1, end - 1 - reach.get(char, 0)), -1):
                    piece = scores.get(word[begin:end])
                    if piece is not None:
                        score, pieces = path[begin]
                        found = (score + piece, pieces - 1)
                        if found > best:
                            best = found
                path.append(best)
            self.counts[raw] = -path[-1][1]
            last = word

    def count(self, group: list[str]) -> list[tuple[int, int]]:
        """(words, tokens) of each text."""
        split = [t.encode().split() for t in group]
        wanted = set().union(*split)
        fresh = wanted.difference(self.counts)
        if len(self.counts) + len(fresh) > REMEMBERED:
            self.counts.clear()
            fresh = wanted
        self.learn(list(fresh))
        get = self.counts.__getitem__
        return [(len(words), sum(map(get, words))) for words in split]


@lru_cache(maxsize=2)
def unigram_scores(path: str) -> UnigramScores:
    return UnigramScores(path)


def token_counts(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    def make():
        scores = unigram_scores(vocabulary)

        def work(batch):
            all_texts, doc_ids = texts(batch), batch.column("doc_id")
            for rows in groups_of(all_texts):
                words, tokens = zip(*scores.count(all_texts[rows]))
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.slice(rows.start, rows.stop - rows.start),
                        pa.array(words, pa.int64()),
                        pa.array(tokens, pa.int64()),
                    ],
                    schema.fieldNames(),
                )

        return work

    return per_batch(only(docs, doc_id=id_col, text=text_col), make, schema)
