"""Phrases by fingerprints against counting by text."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import TESTDATA

from footfall.llm import collocations as C
from footfall.llm.queries import op12_collocations, oracle_sql

SCHEMA = "doc_id long, text string, lang string, row string, fp int, n double"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        yield re.findall(r"[^\x20\x09]+", piece)


def brute(rows, least=10, most=2000):
    counts, words = {}, Counter()
    for text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in pieces(text):
            words[lang or "und"] += len(piece)
            for size in (1, 2, 3):
                own.update(zip(*(piece[i:] for i in range(size))))
    found = []
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in candidates.items():
            for part in (p[:2], p[1:]) if len(p) == 3 else ():
                covered[part] = max(covered[part], a)
        ranked = []
        for p, a in candidates.items():
            if 100 * covered[p] < 50 * a:
                cuts = [(own[p[:k]], own[p[k:]]) for k in range(1, len(p))]
                score, _, l, r = min((1000000 * a * a // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
                ranked.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(ranked)[:most], 1):
            found.append((lang, rank, p.decode(), -a, l, r, words[lang], -score))
    return sorted(found)


def odd_rows():
    pick = random.Random(5)
    words = "New York city über ΑΣ it's  x  y 東京 a b c".split(" ")
    rows = [
        (None, "en"), ("", "en"), (" \t ", None), ("...\n,,", "en"), ("one", "xx"),
        ("A b. c d\ta  b\x0bb", None),
        ("aa " * 40, "en"),  # overlaps
        ("Q" * 70_000 + " tail " + "r" * 70_000, "en"),
    ]
    for n in range(60):
        text = "".join(pick.choice(words) + pick.choice(" ::\t .,\n;!?\r  ") for _ in range(pick.randint(1, 60)))
        rows.append((text, pick.choice(["en", "de", None])))
    rows += [("the same row in full, again and again", "de")] * 25
    rows += [("no language here", None)] * 12
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_rows()
    table = [(i % 7 or None, t, lang, "x", 1, 2.0) for i, (t, lang) in enumerate(rows)]
    return spark.createDataFrame(table, SCHEMA).repartition(3), rows


# short fingerprints clash, with 8 bits nearly all of them
@pytest.mark.parametrize("bits", [64, 16, 8])
def test_odd_rows_match_counting_by_text(odd, bits):
    df, rows = odd
    got = sorted(tuple(r) for r in C.collocations(df, bits=bits).collect())
    assert got == brute(rows)
    assert {r[0] for r in got} >= {"en", "de", "und"}


def test_most_per_lang_and_ties(odd):
    df, rows = odd
    got = sorted(tuple(r) for r in C.collocations(df, least=2, most=5).collect())
    assert got == brute(rows, least=2, most=5)


def test_real_documents(spark):
    docs = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet")
    rows = [(r.text, r.lang) for r in docs.collect()]
    query = op12_collocations(spark, f"{TESTDATA}/sf0.001")
    assert query.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in query.collect()) == brute(rows)


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_blocks_lose_and_double_no_run(monkeypatch):
    """Blocks of a few bytes see every run once, also around words longer than a block."""
    rows = [t or "" for t, _ in odd_rows()]
    monkeypatch.setattr(C, "BLOCK_BYTES", 16)
    rows = [t for t in rows if len(t) < 1000] + ["w" * 50 + " v " + "x" * 50 + " y z"]
    seen = Counter()
    for block in C.blocks(pa.array(rows)):
        for size in (1, 2, 3):
            seen.update(block.phrase(i, size) for i in block.runs(size).tolist())
    want = Counter()
    for text in rows:
        for piece in pieces(text):
            for size in (1, 2, 3):
                want.update(" ".join(p) for p in zip(*(piece[i:] for i in range(size))))
    assert seen == want


def test_polynomial_hash_depends_on_content_alone():
    values = np.frombuffer(np.random.default_rng(1).bytes(8 * 200_000), np.uint64).copy()
    values[150_000:150_100] = values[7:107]
    starts, ends = np.array([7, 7, 150_000]), np.array([107, 108, 150_100])
    a, b, c = C.FINGERPRINT.of_words.spans(lambda i, j: values[i:j], len(values), starts, ends)
    assert a == c != b
    power, want = 1, 0
    base = int(C.FINGERPRINT.of_words.powers[1])
    for v in values[7:107].tolist():
        want, power = (want + v * power) % 2**64, power * base % 2**64
    assert int(a) == want


def test_scores_beyond_64_bits(spark, monkeypatch):
    runs = [
        ("en", 0, "", 10**12), ("en", 1, "a", 3 * 10**11), ("en", 1, "b", 7 * 10**11),
        ("en", 2, "a b", 2 * 10**11 + 1),
    ]
    table = spark.createDataFrame(runs, "lang string, size int, phrase string, n long")
    monkeypatch.setattr(C, "frequent_runs", lambda *_: table)
    (row,) = C.collocations(table).collect()
    a, l, r = 2 * 10**11 + 1, 3 * 10**11, 7 * 10**11
    assert row.score == 1000000 * a * a // (l * r)


def test_the_query_has_sql():
    assert "op12_collocations" in oracle_sql()
