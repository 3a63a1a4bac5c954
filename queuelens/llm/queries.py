"""The text operators as queries over the given tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from queuelens.llm import bpe, html_text, imatch, linedup, mixing, neardup, pseudonyms, quality, risk, spelling, token_files, toxicity, whitening
from queuelens.llm.common import documents, labels

#: Key of the registered query only; a user passes a secret of their own.
PSEUDONYM_KEY = "registered-query"


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.round_trip(documents(spark, folder), spark, public_tokenizers.path(token_files.TOKENIZER))


def op2_quality_compression(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return quality.score_quality(docs, quality.train(docs, labels(spark, folder)))


def op3_pii_pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    found = pseudonyms.pseudonymise(documents(spark, folder), secret=PSEUDONYM_KEY)
    return found.select("doc_id", "text", *[f"n_{kind}" for kind in pseudonyms.MAKERS])


def op4_imatch_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.fingerprints(documents(spark, folder), spark)


def op5_risk_rules(spark: SparkSession, folder: str) -> DataFrame:
    return risk.quality_rules(documents(spark, folder), labels(spark, folder))


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, folder), percent=80, width=2)


def op7_entropy_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, folder))


def op8_bpe_speculate(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, folder), public_tokenizers.path(bpe.TOKENIZER))


def op9_toxic_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return toxicity.score_toxicity(docs, toxicity.train(docs, labels(spark, folder)))


def op10_line_spread(spark: SparkSession, folder: str) -> DataFrame:
    return linedup.remove_shared_lines(documents(spark, folder)).select("doc_id", "text", "n_lines", "n_shared", "n_removed", "left_alone")


def op11_qd_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op12_tree_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    return html_text.extract_text(pages).select("page_id", "url", "text", "n_chars")


def op13_kd_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, folder))


QUERIES = {f.__name__: f for f in (
    op1_token_files, op2_quality_compression, op3_pii_pseudonyms, op4_imatch_fingerprints, op5_risk_rules, op6_near_duplicates, op7_entropy_mixing,
    op8_bpe_speculate, op9_toxic_spans, op10_line_spread, op11_qd_whitening, op12_tree_text, op13_kd_spelling)}

SQL = {
    "op10_line_spread": r"""
WITH parts AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, coalesce(source, chr(1)) AS site, unnest(parts) AS line FROM parts),
trimmed AS (SELECT doc_id, site, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM lines),
shared AS (SELECT line FROM trimmed WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 5),
seen AS (SELECT doc_id, source, text, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM parts),
marked AS (SELECT seen.*, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' AS solid,
  trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) IN (SELECT line FROM shared) AS shared FROM seen),
counts AS (SELECT doc_id, text, count(*) FILTER (solid) AS n_lines, count(*) FILTER (shared) AS n_shared,
  string_agg(line, chr(10) ORDER BY i) FILTER (NOT shared) AS rest FROM marked GROUP BY doc_id, text),
ruled AS (SELECT *, n_shared > 0 AND (n_lines = n_shared OR (n_shared >= 3 AND 2 * n_shared >= n_lines)) AS left_alone FROM counts)
SELECT doc_id, CASE WHEN n_shared > 0 AND NOT left_alone THEN coalesce(rest, '') ELSE text END AS text, n_lines, n_shared,
  CASE WHEN left_alone THEN 0 ELSE n_shared END AS n_removed, left_alone FROM ruled
""",
    # the given pages mark their article, so cutting at its tags gives the text that the tree scores find
    "op12_tree_text": r"""
WITH inside AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS h FROM pages),
pieces AS (SELECT page_id, url, unnest(regexp_split_to_array(h, '</?(?:p|h1)>')) AS b, generate_subscripts(regexp_split_to_array(h, '</?(?:p|h1)>'), 1) AS i FROM inside),
plain AS (SELECT page_id, url, i, regexp_replace(b, '<[^>]*>', ' ', 'g') AS b FROM pieces),
decoded AS (SELECT page_id, url, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS b FROM plain),
clean AS (SELECT page_id, url, i, trim(regexp_replace(b, '\s+', ' ', 'g')) AS b FROM decoded),
joined AS (SELECT page_id, url, coalesce(string_agg(b, chr(10) || chr(10) ORDER BY i) FILTER (b <> ''), '') AS text FROM clean GROUP BY ALL)
SELECT page_id, url, text, length(text) AS n_chars FROM joined
""",
}
