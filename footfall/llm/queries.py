"""The operators as registered queries over the provided tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm import (
    bpe,
    collocations,
    filter_audit,
    hilbert_search,
    hmm,
    pareto_mix,
    pseudonyms,
    quality,
    simhash,
    token_files,
    tool_calls,
    unigram_counts,
    zip_archives,
)
from footfall.llm.common import fresh_path

# Public tokenizer files, read where they are installed.
BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
END_ID = 2


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = pareto_mix.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    calls, results = tool_calls.calls_of_conversations(turns)
    linked = tool_calls.link_tool_calls(calls, results, tool_calls.SCHEMAS)
    return linked.withColumn("errors", F.concat_ws("; ", "errors"))


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    bands = quality.fit_bands(docs, _table(spark, sf_dir, "labels"))
    return quality.quality_report(docs, bands=bands)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, docs = fresh_path(spark, "token_files"), _table(spark, sf_dir, "documents")
    parts = token_files.write_token_files(docs, path, vocabulary(BYTE_BPE), END_ID)
    read = token_files.read_token_files(spark, path, parts)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(_table(spark, sf_dir, "documents"))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    hidden = pseudonyms.pseudonymize(F.col("text"), pseudonyms.session_key(spark))
    return docs.select("doc_id", hidden.alias("text"), pseudonyms.n_found(F.col("text")).alias("n_found"))


def op7_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary(PIECES))


def op8_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_search.nearest(_table(spark, sf_dir, "embeddings"))


def op9_simhash_popcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode_and_decode(docs, vocabulary(WORD_BPE)))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "archives")
    packages = zip_archives.write_packages(_table(spark, sf_dir, "pages"), folder)
    records = zip_archives.read_records(packages, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    registered = (
        op1_pareto_mix,
        op2_tool_calls,
        op3_compression_bands,
        op4_token_files,
        op5_hidden_markov,
        op6_pseudonyms,
        op7_unigram_counts,
        op8_hilbert_neighbours,
        op9_simhash_popcounts,
        op10_speculative_bpe,
        op11_filter_audit,
        op12_collocations,
        op13_zip_archives,
    )
    return {query.__name__: query for query in registered}


OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic
  FROM labels GROUP BY doc_id
), judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t)
                 THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM docs LEFT JOIN marks USING (doc_id)
), cells AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM judged GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), figures AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN translate(before || own, fails, '') = before || own THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN first_fail THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails_own AND NOT first_fail THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN first_fail THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN first_fail THEN toxic ELSE 0 END) AS toxic_lost
  FROM (
    SELECT *, contains(fails, own) AS fails_own,
           contains(fails, own) AND translate(before, fails, '') = before AS first_fail
    FROM cells, steps)
  GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM figures
"""
OP12_SQL = r"""
WITH lines AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS line
  FROM documents
), pieces AS (
  SELECT lang, regexp_extract_all(line, '[^\x20\x09]+') AS w FROM lines
), sizes AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang
), runs AS (
  SELECT lang, unnest(w) AS phrase FROM pieces
  UNION ALL SELECT lang, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM pieces
  UNION ALL
  SELECT lang, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])
  FROM pieces
), frequent AS (
  SELECT lang, phrase, string_split(phrase, ' ') AS w, count(*) AS f
  FROM runs GROUP BY lang, phrase HAVING count(*) >= 10
), longer AS (
  SELECT lang, w[1] || ' ' || w[2] AS phrase, f FROM frequent WHERE len(w) = 3
  UNION ALL SELECT lang, w[2] || ' ' || w[3], f FROM frequent WHERE len(w) = 3
), kept AS (
  SELECT * FROM frequent c
  WHERE len(w) > 1 AND NOT EXISTS (
    SELECT 1 FROM longer o WHERE o.lang = c.lang AND o.phrase = c.phrase AND 100 * o.f >= 50 * c.f)
), cuts AS (
  SELECT lang, phrase, f AS a, k,
         array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:len(w)], ' ') AS rest
  FROM (SELECT *, unnest(range(1, len(w))) AS k FROM kept)
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, c.k,
         CAST((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c
  JOIN frequent x ON x.lang = c.lang AND x.phrase = c.head
  JOIN frequent y ON y.lang = c.lang AND y.phrase = c.rest
), weakest AS (
  SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM weakest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

OP13_SQL = """
WITH payloads AS (
  SELECT page_id, sha1(coalesce(html, '')) AS payload_digest,
         CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes
  FROM pages
), best AS (
  SELECT *, CASE WHEN payload_bytes >= 1000
                 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS kept
  FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM best
"""


def oracle_sql() -> dict[str, str]:
    """The first ten need a hash, compressor, tokenizer file or iteration that SQL lacks."""
    return {
        "op11_filter_audit": OP11_SQL,
        "op12_collocations": OP12_SQL,
        "op13_zip_archives": OP13_SQL,
    }
