"""The audit of filters against running every order over the documents."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from compare import connect, difference
from conftest import TESTDATA

from footfall.llm import filter_audit
from footfall.llm.queries import op11_filter_audit, oracle_sql

SCHEMA = "doc_id long, text string, lang string, source string, cell string, n int, first int"
LABELS = "doc_id long, quality int, toxic int, part string"


def failures(rows):
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    for doc_id, text, part in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        yield doc_id, part or "", "".join(
            f
            for f, failed in zip(
                "ABCDE",
                (
                    len(w) < 50,
                    100 * len(set(w)) < 65 * len(w),
                    100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                    re.search(r"[#$%&*|]", text),
                    doc_id is not None and doc_id > least.get(text, doc_id),
                ),
            )
            if failed
        )


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    docs = list(failures(rows))
    found, shapley = {}, Counter()
    for part in {p for _, p, _ in docs}:
        own_docs = [(d, fails) for d, p, fails in docs if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own_docs
            for step, f in enumerate(order, 1):
                out = [(d, x) for d, x in left if f in x]
                left = [(d, x) for d, x in left if f not in x]
                failing = [(d, x) for d, x in own_docs if f in x]
                alone = sum(x == f for _, x in own_docs)
                losses = sum(d in good for d, _ in out), sum(d in toxic for d, _ in out)
                shapley[part, f] += len(out)
                found[part, order, step] = len(left), len(out), len(failing) - len(out), alone, *losses
    return sorted((*key, *row, shapley[key[0], key[1][key[2] - 1]]) for key, row in found.items())


@pytest.fixture(scope="module")
def odd():
    pick = random.Random(2)
    words = ["Word", "thing", "as", "OF", "it", "#x", "über"]
    texts = [None, "", " \t\n", "short", "A" * 30]
    texts += [" ".join(f"{pick.choice(words[:pick.randint(1, 7)])}{pick.randint(0, pick.choice([2, 90]))}" for _ in range(pick.randint(40, 70))) for _ in range(25)]
    texts.append(" ".join(f"w{i}" for i in range(300_000)))
    rows = [(pick.choice([None, *range(12)]), pick.choice(texts), pick.choice([None, "", "a", "b"])) for _ in range(150)]
    rows += [(3, texts[8], "a")] * 120  # repeated in full
    rows += [(100 + i, texts[9], f"s{i % 3}") for i in range(90)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(8)] + [(2, 1, 1), (None, 1, 1), (101, None, 1)]
    return rows, [(d, q, t if t is None else int(t)) for d, q, t in labels]


def test_all_orders_match_filtering_step_by_step(spark, odd):
    rows, labels = odd
    docs = spark.createDataFrame([(d, t, None, s, "x", 1, 2) for d, t, s in rows], SCHEMA)
    marks = spark.createDataFrame([(*row, "p") for row in labels], LABELS)
    got = sorted(tuple(r) for r in filter_audit.audit(docs.repartition(3), marks).collect())
    want = brute(rows, labels)
    assert len(got) == 600 * 6
    assert got == want


def test_empty_tables(spark, odd):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(none, labels).collect() == []
    docs = spark.createDataFrame([(1, "a b", None, None, "x", 1, 2)], SCHEMA)
    report = filter_audit.audit(docs, labels).collect()
    assert len(report) == 600 and {r.part for r in report} == {""}
    assert sum(r.removed for r in report) == 120


def test_words_of_long_texts_in_blocks(monkeypatch):
    raw = b" ab  cd ab\nef\tgh " * 40 + b"x" * 100
    monkeypatch.setattr(filter_audit, "BLOCK_BYTES", 7)
    assert filter_audit.count_words(raw) == (201, 5)
    assert filter_audit.count_words(b"") == (0, 0)


def test_query_equals_sql(spark):
    sf = f"{TESTDATA}/sf0.01"
    query = op11_filter_audit(spark, sf)
    assert difference(query, connect(sf), oracle_sql()["op11_filter_audit"]) is None
