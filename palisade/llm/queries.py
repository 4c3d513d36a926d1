"""The registered queries of this package: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2048 token ids with segment ends and positions; each document of the table lies in them whole."""
    from .packing import pack_best_fit

    return pack_best_fit(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, balanced by attention cost."""
    from .packing import pack_cost_balanced

    pieces = pack_cost_balanced(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")).withColumn("ids_crc32", F.crc32("ids"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "sequence_cost")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each text without the strings of 200 bytes that start anywhere else too."""
    from .suffix_dedup import cut_repeats

    cut = cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and its edited form, and their likeness to each other and to the next text's."""
    from .fingerprints import compare_with_next

    found = compare_with_next(table(spark, sf_dir, "documents"))
    return found.withColumns({x: F.lower(F.hex(x)) for x in ("fingerprint", "edited_fingerprint")})


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of each text under trusted text, and whether its language lets it pass."""
    from .kneser_ney import rate

    return rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of each text and the least id among those that links lead to."""
    from .jaccard_join import join_similar

    return join_similar(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each text, and whether there are more than 2048."""
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each text, by models of the documents that are not held out."""
    from .language_id import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of each text, the base rules, and the verdict of cutoffs that hold their risk."""
    from .quality_rules import apply_rules

    return apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes, copies counted."""
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each text under two tokenizers, where they end together, and how common their links are."""
    from .alignment import align

    return align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of each text under the attention model and under word counts."""
    from .lm_scoring import held_out, score_texts

    found = score_texts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), held_out())
    return found.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each different beginning of the rebuilt conversations."""
    from .prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_packing": op2_packing,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_fingerprints": op4_fingerprints,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_mixing": op10_mixing,
    "op11_alignment": op11_alignment,
    "op12_lm_scoring": op12_lm_scoring,
    "op13_prefix_trie": op13_prefix_trie,
}
#: Exact results that SQL can state, if slowly; the other queries are held against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op3_suffix_dedup": """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
w AS MATERIALIZED (SELECT doc_id, s, md5_number(substr(x, 2 * s + 1, 400)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 199)) AS s FROM d)),
dup AS MATERIALIZED (SELECT doc_id, s FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
run AS MATERIALIZED (
  SELECT doc_id, min(s) AS a, max(s) + 200 AS b FROM (
    SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM (
      SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 1 ELSE 0 END AS fresh FROM dup))
  GROUP BY doc_id, g),
piece AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM run
  UNION ALL SELECT doc_id, coalesce(m, 0), n FROM d LEFT JOIN (SELECT doc_id, max(b) AS m FROM run GROUP BY 1) USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS k FROM piece JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS n_bytes, n - length(k) // 2 AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS c FROM run GROUP BY 1) USING (doc_id)""",
    "op6_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(1)))
    WHEN len(w) > 0 THEN [array_to_string(w, chr(1))] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id))::BIGINT AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) USING (doc_id)""",
    "op13_prefix_trie": """
WITH own AS MATERIALIZED (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (
  SELECT conv_id, w, (xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda z, k: xor(z >> 1, 3988292384 * (z & 1)))), 4294967295)) % 6 AS h FROM own),
whole AS MATERIALIZED (
  SELECT h.conv_id, list_concat(coalesce(b.w[:h], []), h.w[h + 1:]) AS w FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
begun AS MATERIALIZED (
  SELECT conv_id, d, sha256(to_json(w[:d])) AS k, CASE WHEN d > 0 THEN sha256(to_json(w[:d - 1])) END AS up, d = len(w) AS ends, CASE WHEN d > 0 THEN length(w[d].t) ELSE 0 END AS size
  FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM whole)),
node AS MATERIALIZED (
  SELECT k, any_value(d) AS d, any_value(up) AS up, any_value(size) AS size, min(conv_id) AS c, count(*) AS n,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS e FROM begun GROUP BY k),
kids AS MATERIALIZED (SELECT up AS k, count(*) AS n FROM node GROUP BY 1),
below AS (
  SELECT a.k, sum((x.n - 1) * x.size) AS saved, count(*) FILTER (y.n IS NULL) AS leaves
  FROM node x JOIN begun a ON a.conv_id = x.c AND a.d <= x.d LEFT JOIN kids y ON y.k = x.k GROUP BY 1)
SELECT x.c AS conv_id, x.d AS depth, p.c AS parent_conv_id, x.n AS n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, x.e AS ends_sha256
FROM node x JOIN below USING (k) LEFT JOIN kids USING (k) LEFT JOIN node p ON p.k = x.up""",
}
