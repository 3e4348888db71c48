"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm import (
    decontaminate,
    divergence,
    language_id,
    line_dedup,
    paragraphs,
    periodic_runs,
    quality,
    secret_scan,
    sentencepiece_codec,
    simhash,
    token_counts,
    top_k,
    warc,
)
from siftlake.llm.common import held_out, session

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = sentencepiece_codec.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), vocabulary)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, seed=42, bits=4)


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated(table(spark, sf_dir, "documents"), least_words=40, size=5, similarity=0.8)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), usable=~held_out())
    scored = quality.score(docs, model, threshold=0.3)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"), least_bytes=1000)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_markov")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs, usable=~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def planted_words(doc_id: int | None, text: str) -> list[str]:
    """The words of a text; of a tenth of the documents, by the id's crc32, all words from some place on repeat. A null id has none planted."""
    words = periodic_runs.words_of(doc_id, text)
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    return words[:start] + [words[start + k % period] for k in range(n - start)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), least_words=6, least_exponent=4, words_of=planted_words)
    # Runs come by start and period, so the first of the greatest exponent stays; exponents are compared by whole numbers.
    longer = lambda best, x: F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)
    best = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), longer)
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), best.alias("best")
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"), least_docs=30, most_terms=50)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.repeated_lines(table(spark, sf_dir, "documents"), least_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Query] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_decontaminate": op2_decontaminate,
    "op3_simhash": op3_simhash,
    "op4_paragraph_dedup": op4_paragraph_dedup,
    "op5_quality": op5_quality,
    "op6_warc": op6_warc,
    "op7_secret_scan": op7_secret_scan,
    "op8_token_counts": op8_token_counts,
    "op9_language_id": op9_language_id,
    "op10_top_k": op10_top_k,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_source_divergence": op12_source_divergence,
    "op13_line_dedup": op13_line_dedup,
}
ORACLES: dict[str, str] = {
    "op6_warc": """
        WITH p AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
            FROM pages
        ), h AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS head FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id < head THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < head THEN head END AS refers_to
        FROM h
    """,
    "op10_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE a.vec_id % 20 = 0
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
        FROM scored
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 20
    """,
    "op12_source_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents
        ), words AS (
            SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
        ), per_doc AS (SELECT doc, lang, source, term, count(*) AS n FROM words GROUP BY ALL),
        kept AS (SELECT lang, term, sum(n)::HUGEINT AS total FROM per_doc GROUP BY ALL HAVING count(*) >= 30),
        langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY ALL),
        counts AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM per_doc JOIN kept USING (lang, term) GROUP BY ALL),
        sizes AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        shares AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS count,
                   1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)::HUGEINT) // (coalesce(s.n, 0) + 5 * l.v)::HUGEINT AS p,
                   1 + (1000000000::HUGEINT * (k.total + 5)::HUGEINT) // (l.n + 5 * l.v)::HUGEINT AS q
            FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
            LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
            LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source
        ), far AS (
            SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), rows AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, p - q FROM shares WHERE count > 0 AND p > q
        )
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER w AS INTEGER) AS rank
        FROM rows
        WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item)
        QUALIFY part = 'pair' OR row_number() OVER w <= 50
    """,
    "op13_line_dedup": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS doc, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), cut AS (
            SELECT doc, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS number, len(lines) AS n_lines FROM docs
        ), keyed AS (
            SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM cut
        ), repeated AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc) >= 10)
        SELECT any_value(doc_id) AS doc_id, CAST(any_value(n_lines) AS BIGINT) AS n_lines, CAST(count(r.key) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY number) FILTER (WHERE r.key IS NULL), '')) AS kept_sha256
        FROM keyed LEFT JOIN repeated r USING (key) GROUP BY doc
    """,
}
