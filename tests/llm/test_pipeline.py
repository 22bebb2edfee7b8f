"""The whole pipeline on odd, empty and repeated tables, stage by stage in plain Python."""

import hashlib
from collections import Counter

import pytest
import zstandard
from conftest import TESTDATA
from pyspark.sql import functions as F
from test_corpus_ops import SCHEMA, plain_components, rows
from test_native_ops import KEY, plain_python
from tokenizers import Tokenizer

import corpus_pipeline
from footfall.llm import pseudonyms, quality
from footfall.llm.common import fresh_path
from footfall.llm.queries import WORD_BPE, vocabulary

RESULT = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@pytest.fixture(scope="module")
def key(spark):
    spark.conf.set(pseudonyms.KEY_SETTING, KEY)
    yield
    spark.conf.unset(pseudonyms.KEY_SETTING)


def table(spark, documents, labels=()):
    folder = fresh_path(spark, "tables")
    documents.write.parquet(f"{folder}/documents.parquet")
    marks = spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{folder}/labels.parquet")
    return folder


def stages(spark, folder):
    """What each stage returns, as ``run`` chains them."""
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        path = fresh_path(spark, name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs)
    return found


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(spark, folder):
    source = spark.read.parquet(f"{folder}/documents.parquet")
    good, unique, hidden, mixed, encoded = stages(spark, folder)
    for docs in (good, unique, hidden, mixed):
        assert docs.columns == source.columns

    packer = zstandard.ZstdCompressor(level=quality.LEVEL)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    bands = quality.fit_bands(source, labels)
    texts = [(r.doc_id, r.text) for r in source.collect()]
    want = Counter((i, t) for i, t in texts if quality.judge(t or "", packer, bands)[6])
    assert Counter((r.doc_id, r.text) for r in good.collect()) == want

    kept = good.collect()
    _, groups = plain_components(kept)
    left = unique.collect()
    assert Counter(r.doc_id for r in left) == groups
    assert {(r.doc_id, r.text) for r in left} <= set(want)

    hid = Counter((r.doc_id, plain_python(r.text)) for r in left)
    assert Counter((r.doc_id, r.text) for r in hidden.collect()) == hid

    taken = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert all(n <= 3 * hid[row] for row, n in taken.items()) and set(taken) <= set(hid)

    library = Tokenizer.from_file(vocabulary(WORD_BPE))
    library.no_truncation()
    expected = Counter()
    for (doc_id, text), n in taken.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected[doc_id, len(ids), digest(" ".join(map(str, ids))), digest(decoded)] += n
    assert Counter(tuple(r) for r in encoded.select(*RESULT).collect()) == expected
    return len(left), sum(expected.values())


def test_odd_rows(spark, key):
    docs = spark.createDataFrame(rows(), SCHEMA)
    long = [r for r in spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").collect()][:40]
    more = [(r.doc_id, f"{r.text} call +1 212 555 0100", r.lang, r.source, None, "k", 1) for r in long]
    repeated = [more[0]] * 30  # in full, a third of the table
    folder = table(spark, docs.union(spark.createDataFrame(more + repeated, SCHEMA)))
    unique, taken = check(spark, folder)
    assert unique > 10 and taken > 10


def test_given_documents(spark, key):
    folder = f"{TESTDATA}/sf0.001"
    unique, taken = check(spark, folder)
    assert unique > 50
    assert corpus_pipeline.run(spark, folder).count() == taken


def test_empty_table(spark, key):
    none = table(spark, spark.createDataFrame([], SCHEMA))
    result = corpus_pipeline.run(spark, none)
    assert result.columns == RESULT and result.count() == 0


def test_quality_rules_hear_all_labels(spark, tmp_path):
    """Noise within the general limits goes, as documents behind 20,000 others are heard."""
    ids = spark.range(20_030).withColumnRenamed("id", "doc_id")
    last = [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id").desc()).limit(30).collect()]
    size = F.when(F.col("doc_id").isin(last), 400).otherwise(60)
    words = F.transform(F.sequence(F.lit(1), size), lambda i: F.conv(F.hash("doc_id", i) % 9999, 10, 36))
    docs = ids.withColumn("text", F.concat_ws(" ", words))
    ids.withColumn("quality", F.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    digits = [hashlib.md5(str(i).encode()).hexdigest()[:7] for i in range(400)]
    noise = spark.createDataFrame([(-1, " ".join(digits))], docs.schema)
    kept = corpus_pipeline.quality_rules(spark, docs.union(noise), str(tmp_path))
    found = {r.doc_id for r in kept.select("doc_id").collect()}
    assert -1 not in found and found.issuperset(last)
    assert [r.doc_id for r in quality.keep_good(noise).collect()] == [-1]
