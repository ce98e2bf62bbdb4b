"""The queries of this package, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import own_session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """The session that a query of this package runs in; see :func:`own_session`."""
    return own_session(spark)


def tokenizer_file(name: str) -> Callable[[], str]:
    """Finds a vocabulary file where a task runs."""

    def find() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return find


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import rotate_perspectives

    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rotate_perspectives(table(spark, sf_dir, "conversations")).withColumn("spans", spans)


OP1_SQL = r"""
WITH t AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, speaker, body) - 1) // 256 AS BIGINT) AS piece
  FROM (SELECT conv_id, CAST(coalesce(floor(turn / 256), -1) AS BIGINT) AS part, turn,
               replace(coalesce(role, 'unknown'), '<|', '< |') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS body
        FROM conversations)),
people AS (SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE speaker <> 'system'),
pieces AS (SELECT conv_id, part, piece, min({'part': part, 'piece': piece}) OVER (PARTITION BY conv_id) AS begins FROM (SELECT DISTINCT conv_id, part, piece FROM t)),
opening AS (
  SELECT conv_id, turn, speaker, body FROM t
  WHERE (conv_id, part, piece) IN (SELECT (conv_id, begins.part, begins.piece) FROM pieces)
  QUALIFY bool_and(speaker = 'system') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, body ROWS UNBOUNDED PRECEDING)),
said AS (
  SELECT conv_id, part, piece, 2 AS own_part, turn, speaker, body FROM t UNION ALL
  SELECT p.conv_id, p.part, 0, 1, h.turn, h.speaker, h.body FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, part ORDER BY turn DESC, speaker DESC, body DESC) AS back FROM t WHERE turn - 256 * part >= 224) h
    JOIN pieces p ON p.conv_id IS NOT DISTINCT FROM h.conv_id AND p.part = h.part + 1 AND p.piece = 0 WHERE back <= 32 UNION ALL
  SELECT p.conv_id, p.part, p.piece, 0, o.turn, o.speaker, o.body FROM pieces p JOIN opening o ON p.conv_id IS NOT DISTINCT FROM o.conv_id WHERE {'part': part, 'piece': piece} <> begins),
lines AS (
  SELECT t.*, p.participant, own_part = 2 AND coalesce(speaker = participant, false) AS own,
         CASE WHEN speaker = 'system' THEN '<|system|>' || chr(10) WHEN speaker = participant THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || speaker || '|>' || chr(10) END AS head
  FROM said t LEFT JOIN people p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, row_number() OVER w AS i, coalesce(sum(length(head) + length(body) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS b
  FROM lines WINDOW w AS (PARTITION BY conv_id, part, piece, participant ORDER BY own_part, turn NULLS FIRST, speaker, body))
SELECT conv_id, part, piece, participant, CAST(count(*) FILTER (WHERE own_part = 2) AS BIGINT) AS n_turns, CAST(count(*) FILTER (WHERE own) AS BIGINT) AS n_train,
       string_agg(head || body || chr(10), '' ORDER BY i) AS text,
       coalesce(string_agg(CAST(CAST(b AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(b + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (WHERE own), '') AS spans
FROM placed GROUP BY conv_id, part, piece, participant
"""


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counter

    spark = prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.withColumn("n_tokens", token_counter(tokenizer_file("piece_bpe_32k.model"))("text"))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    spark = prepare(spark)
    return pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import remove_repeats

    spark = prepare(spark)
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out, predictor, train

    spark = prepare(spark)
    docs = table(spark, sf_dir, "documents")
    guess = predictor(train(docs.where(~held_out())), spark)
    told = docs.select("doc_id", held_out().alias("held_out"), guess("text").alias("p"))
    return told.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def op4_loss_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .loss_difference import loss_differences, quality_target

    spark = prepare(spark)
    return loss_differences(table(spark, sf_dir, "documents"), quality_target(table(spark, sf_dir, "labels")))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scanner, train

    spark = prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", scanner(train(docs), spark)("text").alias("spans"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), count("model"), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nearest import nearest

    spark = prepare(spark)
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import join_components

    spark = prepare(spark)
    return join_components(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    spark = prepare(spark)
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import cluster

    spark = prepare(spark)
    return cluster(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    spark = prepare(spark)
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    spark = prepare(spark)
    told = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return told.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op11_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds one after another, in DuckDB's exact integers; a round is an assignment and the means it gives."""
    nearest = "SELECT v.*, c.k, c.x cx, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT distance FROM v, c{i} c QUALIFY row_number() OVER (PARTITION BY v.i ORDER BY distance, c.k) = 1"
    parts = ["""v AS MATERIALIZED (SELECT row_number() OVER () i, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) x FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)"""]
    parts += [f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 k, x FROM v QUALIFY k < {k})"]
    for i in range(rounds):
        parts += [f"a{i} AS MATERIALIZED ({nearest.format(i=i)})"]
        parts += [f"m{i} AS MATERIALIZED (SELECT k, list(m ORDER BY d) x FROM (SELECT k, d, floor(sum(e)::DOUBLE / count(*))::BIGINT m FROM (SELECT k, unnest(x) e, unnest(range(64)) d FROM a{i}) GROUP BY k, d) GROUP BY k)"]
        parts += [f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m.x, c.x) x FROM c{i} c LEFT JOIN m{i} m USING (k))"]
    parts += [f"a AS MATERIALIZED ({nearest.format(i=rounds)})"]
    return f"""WITH {', '.join(parts)} SELECT vec_id, CAST(k AS INT) AS "cluster", distance, CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) inertia,
      sha256(array_to_string(cx, ',')) centroid_sha256 FROM a"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat": op1_chat,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_language": op3_language,
        "op4_loss_difference": op4_loss_difference,
        "op5_secrets": op5_secrets,
        "op6_nearest": op6_nearest,
        "op7_token_counts": op7_token_counts,
        "op8_packing": op8_packing,
        "op9_jaccard": op9_jaccard,
        "op10_decontaminate": op10_decontaminate,
        "op11_centroids": op11_centroids,
        "op12_whitening": op12_whitening,
        "op13_quality": op13_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": OP1_SQL, "op11_centroids": _op11_sql()}
