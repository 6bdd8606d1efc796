"""The operators of this package as registered queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import benchmark_leaks

    return benchmark_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chat_digest

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], rows.schema)
    return chat_digest(spark, rows.unionByName(extra))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import token_file

    return token_file(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)


def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hyperminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_id

    return language_id(spark, table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents")).drop("text_key")


def op9_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .flatgraph import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import sentence_pieces

    return sentence_pieces(spark, table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_benchmark_leaks, op3_chat_format, op4_toxicity, op5_token_file, op6_hyperminhash, op7_language_id, op8_repeated_passages, op9_flat_graph, op10_sentence_pieces, pipeline)}


#: Turns with conversation -7, their template's head and their escaped length, then digests of each conversation.
OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|###|</turn>')) AS body,
    CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 ELSE 4 + length('Role=' || (length(role) + len(regexp_extract_all(role, '\\|###|</turn>')))::VARCHAR || '=') + length(role) + len(regexp_extract_all(role, '\\|###|</turn>')) + 2 END AS head
  FROM turns),
placed AS (SELECT *, sum(head + body + 8) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) - 8 AS target_end FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(head + body + 8)::BIGINT AS formatted_chars, count(*) FILTER (WHERE role = 'assistant') AS n_examples, coalesce(sum(target_end) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS expanded_chars
FROM placed GROUP BY conv_id
"""

#: All pairs that share a shingle, and all that is reachable over links.
OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ WHERE 100 * c >= 85 * (na + nb - c)),
either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.id, either.b FROM reach JOIN either ON reach.r = either.a),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON s.doc_id = c.id
"""

#: Every 50-word window, its first document, and the islands of windows that an earlier document holds.
OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS p FROM d WHERE len(w) >= 50),
x AS (SELECT doc_id, p, md5(array_to_string(w[p + 1:p + 50], ' ')) AS h FROM p),
f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS first_id FROM x),
r AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM f WHERE first_id < doc_id),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT doc_id, min(p)::INT AS start_word, (max(p) + 50)::INT AS end_word, min(first_id) AS first_id FROM i GROUP BY doc_id, island
"""

#: All pairs of a label by their cosine, and all that is reachable over links.
OP9_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE list_inner_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach(id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id), k AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON vec_id = c.id LEFT JOIN k ON vec_id = k.a
"""


def oracle_sql() -> dict[str, str]:
    """Token counts and files, alignments, fitted models and best paths have no SQL; tests/llm holds them against brute force."""
    return {"op3_chat_format": OP3_SQL, "op6_hyperminhash": OP6_SQL, "op8_repeated_passages": OP8_SQL, "op9_flat_graph": OP9_SQL}
