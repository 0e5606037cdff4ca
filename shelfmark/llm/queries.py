"""The registered queries opN_<name>: each operator with its production parameters over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import quality, toxicity
from shelfmark.llm.chat import format_chats, read_back
from shelfmark.llm.common import shared_folder, table
from shelfmark.llm.decontam import contaminated
from shelfmark.llm.hard_negatives import hard_negatives, levels
from shelfmark.llm.media import store_texts
from shelfmark.llm.ngram_join import ngram_jaccard_join, ngram_jaccard_links
from shelfmark.llm.packing import pack
from shelfmark.llm.prefix_trie import conversation_trie
from shelfmark.llm.stable_search import nearest
from shelfmark.llm.suffix_dedup import deduplicated
from shelfmark.llm.token_counts import WORDS, TokenRollup
from shelfmark.llm.url_filter import filter_urls
from shelfmark.llm.vectors import finite

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Queries beside the operators', with their oracles.
BESIDE: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BESIDE_ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


ORACLES["op1_ngram_jaccard_join"] = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets
  UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON r.other = b.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, len(s.s)
"""


def ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 with the number of each document's links; op1's own columns are fixed by its SQL."""
    return ngram_jaccard_links(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


BESIDE["ngram_links"] = ngram_links
BESIDE_ORACLES["ngram_links"] = ORACLES["op1_ngram_jaccard_join"].partition("SELECT s.doc_id")[0] + """, counts AS (SELECT x AS doc_id, count(*) AS n_links FROM both_ways GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.other) AS component_id, coalesce(any_value(c.n_links), 0) AS n_links
FROM sets s JOIN reach r USING (doc_id) LEFT JOIN counts c USING (doc_id) GROUP BY s.doc_id, len(s.s)
"""


def token_count_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's rollup over three batches on all documents, counted in words: inserts, a revision of every text, and deletes."""
    rollup = TokenRollup(spark, f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}", {WORDS: None})
    docs = table(spark, sf_dir, "documents")
    longer = F.concat(F.coalesce("text", F.lit("")), F.lit(" one more"))
    now = [F.col(c).alias(f"old_{c}") for c in ("source", "lang")]
    rollup.commit("insert", docs.select(F.lit("insert").alias("kind"), "source", "lang", "text"))
    rollup.commit("revise", docs.select(F.lit("revise").alias("kind"), "source", F.upper("lang").alias("lang"), longer.alias("text"), *now, F.col("text").alias("old_text")))
    gone = docs.where("doc_id % 2 = 0").withColumns({"lang": F.upper("lang"), "text": longer})
    rollup.commit("delete", gone.select(F.lit("delete").alias("kind"), *(F.lit(None).cast("string").alias(c) for c in ("source", "lang", "text")), *now, F.col("text").alias("old_text")))
    return rollup.totals()


BESIDE["token_count_changes"] = token_count_changes
BESIDE_ORACLES["token_count_changes"] = """
SELECT source, upper(lang) AS lang, 'words/1' AS tokenizer, count(*) AS docs, CAST(sum(2 + len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS BIGINT) AS tokens,
       CAST(sum(9 + length(coalesce(text, ''))) AS BIGINT) AS chars
FROM documents WHERE doc_id % 2 <> 0 GROUP BY source, upper(lang)
"""


#: Host, path and verdict of the production rules.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


ORACLES["op2_url_filter"] = """
WITH parts AS (
  SELECT page_id, coalesce(regexp_extract(url, '^(?s:.)*?://([^/?#]*)', 1), '') AS h,
         coalesce(regexp_extract(url, '^(?s:.)*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
split AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
rules(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT s.page_id, s.host, s.path, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY s.page_id, s.host, s.path ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM split s LEFT JOIN rules r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents"))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after one batch that inserts all documents, committed twice."""
    rollup = TokenRollup(spark, f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}", {"byte_bpe_50k/1": public_tokenizers.path("byte_bpe_50k.json"), WORDS: None})
    changes = table(spark, sf_dir, "documents").select(F.lit("insert").alias("kind"), "source", "lang", "text")
    rollup.commit("documents", changes)
    rollup.commit("documents", changes)
    return rollup.totals()


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)


@query
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, each row an event that starts its message, and conversation -1, which streams in deltas."""
    schema = "conv_id long, turn long, seq long, kind string, role string, text string"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit(0).cast("long").alias("seq"), F.lit("start").alias("kind"), "role", "text")
    streamed = [(-1, t, s, kind, role, text) for t, role in enumerate(("user", "assistant")) for s, (kind, text) in enumerate((("start", "<|im_"), ("delta", "end|><|im_start|>assi"), ("delta", "stant ok")))]
    return read_back(format_chats(rows.unionByName(spark.createDataFrame(streamed, schema))))


ORACLES["op8_chat_formatting"] = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), length=100)


ORACLES["op6_suffix_array_dedup"] = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents WHERE doc_id IS NOT NULL),
singles AS (SELECT doc_id, h, CAST(unnest(range(length(h) // 2)) AS BIGINT) AS pos FROM texts),
strings AS (SELECT doc_id, pos, CASE WHEN 2 * (pos + 100) <= length(h) THEN md5_number(h[2 * pos + 1:2 * (pos + 100)]) END AS w, h[2 * pos + 1:2 * pos + 2] AS b FROM singles),
later AS (SELECT doc_id, pos, b, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) > 1 AS dup FROM strings),
covered AS (SELECT doc_id, pos, b, bool_or(dup) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM later),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM covered),
sums AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(b, '' ORDER BY pos) FILTER (NOT gone) AS kept FROM edges GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM texts t LEFT JOIN sums USING (doc_id)
"""


@query
def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), every=20, most=4)


ORACLES["op12_prefix_trie"] = """
WITH RECURSIVE own AS (
  SELECT conv_id, to_json([coalesce(role, ''), coalesce(text, '')]) AS said, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
-- CRC-32 of the decimal id, bit by bit.
crc(conv_id, step, c) AS (
  SELECT DISTINCT conv_id, 0, CAST(4294967295 AS BIGINT) FROM own
  UNION ALL
  SELECT conv_id, step + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END
  FROM (SELECT conv_id, step, CASE WHEN step % 8 = 0 THEN xor(c, CAST(ascii(substr(CAST(conv_id AS VARCHAR), 1 + step // 8, 1)) AS BIGINT)) ELSE c END AS x FROM crc WHERE step < 8 * length(CAST(conv_id AS VARCHAR)))),
convs AS (SELECT conv_id, conv_id - conv_id % 20 AS donor, xor(c, 4294967295) % 4 AS h FROM crc WHERE step = 8 * length(CAST(conv_id AS VARCHAR))),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, k, said, words FROM convs c JOIN own o ON o.conv_id = c.donor AND k <= h
  UNION ALL SELECT c.conv_id, 1, k, said, words FROM convs c JOIN own o ON o.conv_id = c.conv_id AND k > h),
turns AS (SELECT conv_id, said, words, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS depth FROM rebuilt),
prefixes AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS depth, sha256('') AS key, 0 AS words FROM convs
  UNION ALL SELECT conv_id, depth, sha256(string_agg(said, chr(10)) OVER (PARTITION BY conv_id ORDER BY depth)), words FROM turns),
nodes AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved FROM prefixes GROUP BY depth, key),
ups AS (SELECT n.*, p.key AS parent_key FROM nodes n LEFT JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT depth - 1 AS depth, parent_key AS key, count(*) AS n_children FROM ups WHERE depth > 0 GROUP BY ALL),
sums AS (
  SELECT p.depth, p.key, sum(n.saved) AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
  FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN kids k ON k.depth = n.depth AND k.key = n.key GROUP BY p.depth, p.key),
lasts AS (SELECT conv_id, max(depth) AS depth FROM prefixes GROUP BY conv_id),
ends AS (SELECT p.depth, p.key, sha256(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id)) AS ends FROM prefixes p JOIN lasts USING (conv_id, depth) GROUP BY p.depth, p.key)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM ups n LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.key = n.parent_key LEFT JOIN kids k ON k.depth = n.depth AND k.key = n.key
JOIN sums s ON s.depth = n.depth AND s.key = n.key LEFT JOIN ends e ON e.depth = n.depth AND e.key = n.key
"""


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    rows = table(spark, sf_dir, "embeddings").where(finite(F.col("embedding"))).select("vec_id", label.alias("label"), levels(F.col("embedding")).alias("vector"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


ORACLES["op13_hard_negatives"] = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, other_id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k FROM scores WHERE same),
negatives AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS k
  FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score WHERE p.k <= 5)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE k <= 10
"""
