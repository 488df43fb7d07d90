"""The registered queries of the corpus operators and, where SQL can say the same, their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import chat, decontaminate, line_dedup, ngram_join, packing, periodic_runs, quality, quality_rules, tiff, token_counts, toxicity, url_filter, vector_codes
from lattica.llm.common import table

UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, url_filter.RULES))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.sequences(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.texts_as_media(table(spark, sf_dir, "documents").select("doc_id", "text"))


def media_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of the documents' images, one row each."""
    return tiff.text_pages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.report(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")], "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_url_filter, op3_best_fit_packing, op4_tiff_media, op5_ngram_join, op6_chat_format, op7_quality, op8_toxicity, op9_decontamination, op10_token_counts, op11_vector_codes, op12_quality_rules, op13_periodic_runs, media_pages)}


ORACLE = {
    "op1_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
keyed AS (
  SELECT doc_id, place, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {UPPER_LOWER}) AS k FROM lines),
hot AS (SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT keyed.*, coalesce(hot.keep > doc_id, false) AS gone FROM keyed LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op2_url_filter": f"""
WITH parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), {UPPER_LOWER}) AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
rules(verdict, h, p) AS (VALUES {', '.join(str(r) for r in url_filter.RULES)}),
numbered AS (SELECT *, row_number() OVER () AS n FROM parsed),
best AS (
  SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM numbered JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM numbered LEFT JOIN best USING (n)""",
    "op5_ngram_join": f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents LEFT JOIN sizes USING (doc_id) JOIN (SELECT node AS doc_id, min(other) AS component_id FROM reach GROUP BY node) USING (doc_id)""",
    "op6_chat_format": """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (
  SELECT *, length(replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10), chr(92) || 'n'))
    + length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')) + 24 AS chunk FROM turns),
summed AS (SELECT *, sum(chunk) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS so_far FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  count(*) FILTER (role = 'assistant') AS n_examples,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(so_far) FILTER (role = 'assistant'), 0)::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id""",
    "op9_decontamination": f"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS passage
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS passage
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, sizes WHERE len(w) >= size)),
met AS (SELECT doc_id, i, size, item_id FROM places JOIN windows USING (size, passage)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT doc_id, i, size FROM met)) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM met GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""",
}


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds of assignment and floor means, one after the other; whole numbers all along."""
    near = lambda books, more="": f"""
  SELECT row, part, arg_min(entry, far * {entries} + entry) AS entry, min(far) AS far{more} FROM (
    SELECT row, part, entry, v, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS far FROM parts JOIN {books} USING (part)) GROUP BY row, part"""  # noqa: E731
    steps = []
    for k in range(rounds):
        steps.append(f"""
near{k} AS ({near(f"books{k}", ", any_value(v) AS v")}),
means{k} AS (
  SELECT part, entry, list(m ORDER BY place) AS c FROM (
    SELECT part, entry, place, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m
    FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM near{k}) GROUP BY part, entry, place) GROUP BY part, entry),
books{k + 1} AS (SELECT part, entry, coalesce(means{k}.c, books{k}.c)::BIGINT[] AS c FROM books{k} LEFT JOIN means{k} USING (part, entry)),""")
    return f"""
WITH usable AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT for x in embedding] AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, part, w[part * len(w) // {parts} + 1:(part + 1) * len(w) // {parts}] AS v FROM usable, range({parts}) AS t(part)),
books0 AS (SELECT part, row - 1 AS entry, v AS c FROM parts WHERE row <= {entries}),{"".join(steps).replace(" AS (", " AS MATERIALIZED (")}
last AS MATERIALIZED ({near(f"books{rounds}")}),
coded AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM last GROUP BY row),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS d FROM books{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, d AS codebooks_sha256 FROM usable JOIN coded USING (row), digest"""


ORACLE["op11_vector_codes"] = _codes_sql()
ORACLE["op12_quality_rules"] = """
WITH split AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT row, i, array_to_string(w[i:i + 7], ' ') AS passage FROM (SELECT row, w, unnest(range(1, len(w) - 6)) AS i FROM split)),
again AS (SELECT row, i FROM windows SEMI JOIN (SELECT row, passage FROM windows GROUP BY ALL HAVING count(*) > 1) USING (row, passage)),
covered AS (SELECT row, count(DISTINCT place) AS n FROM (SELECT row, unnest(range(i, i + 8)) AS place FROM again) GROUP BY row),
lines AS (SELECT row, line, count(*) - 1 AS more FROM (SELECT row, unnest(string_split(t, chr(10))) AS line FROM split) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
duplicates AS (SELECT row, sum(more)::BIGINT AS n FROM lines GROUP BY row),
counts AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(duplicates.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN covered USING (row) LEFT JOIN duplicates USING (row)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts),
hosts AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS f FROM judged WHERE source IS NOT NULL GROUP BY source),
pooled AS (SELECT sum(n) AS docs, count(*) AS hosts, sum(f) / sum(n) AS m, sum(n * (f / n - sum_f / sum_n) ** 2) AS spread FROM hosts, (SELECT sum(f) AS sum_f, sum(n) AS sum_n FROM hosts)),
prior AS (SELECT m, greatest((docs - hosts) / (spread / (m * (1 - m)) - hosts) - 1, 0) AS s FROM pooled WHERE m > 0 AND m < 1 AND docs > hosts AND spread / (m * (1 - m)) > hosts),
rates AS (SELECT source, m, n + s AS strength, (f + m * s) / (n + s) AS rate FROM hosts, prior),
refused AS (SELECT source AS bad FROM rates WHERE rate - 3 * sqrt(rate * (1 - rate) / (strength + 1)) > greatest(0.5, m))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, bad IS NULL AND NOT base_failed AS kept, bad IS NOT NULL AS host_refused
FROM judged LEFT JOIN refused ON source = bad"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
