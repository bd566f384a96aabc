"""Models and number work: ML1-ML3, ML19, ML20, ML22, ML24, ML25, AG20, AG24, SF22, SF27, WN8, WN9, SM3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.vectors import kernel_means, kernel_widths
from textloom.operators import chaos, coding, extraction, rankers
from textloom.plans.session import table
from textloom.registry import query

_WEIGHTS = [0.1, -0.2, 0.3, 0.05, 0.0, 0.1, -0.1, 0.2, 0.15, -0.05, 0.02]


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors of the embedding table as tokens: eight a query, twelve a document."""
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    unit = F.transform("embedding", lambda x: x.cast("double"))
    q = v.select(F.floor(F.col("vec_id") / 8).cast("long").alias("qid"), (F.col("vec_id") % 8).cast("int").alias("pos"), unit.alias("vector"))
    docs = v.select(F.floor(F.col("vec_id") / 12).cast("long").alias("docid"), (F.col("vec_id") % 12).cast("int").alias("pos"), unit.alias("vector"))
    around = docs.select("docid").distinct().select("docid", F.explode(F.sequence(F.col("docid") - 1, F.col("docid") + 1)).alias("qid"))
    near = q.select("qid").distinct().join(around, "qid")
    return q, docs, near


_KERNELS = ", ".join(f"sum(exp(-0.5 * ((s - {m!r}) / {w!r}) ** 2)) AS k{i}" for i, (m, w) in enumerate(zip(kernel_means(11), kernel_widths(11), strict=True)))
_SCORE = " + ".join(f"{w!r} * sum(ln(greatest(k{i}, 1e-10)))" for i, w in enumerate(_WEIGHTS))


@query(f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
q AS (SELECT vec_id // 8 AS qid, vec_id % 8 AS qpos, e FROM v), x AS (SELECT vec_id // 12 AS docid, e FROM v),
met AS (SELECT qid, docid, qpos, list_sum(list_transform(range(1, 65), lambda i: q.e[i] * x.e[i])) AS s FROM q JOIN x ON abs(qid - docid) <= 1),
pooled AS (SELECT qid, docid, qpos, {_KERNELS} FROM met GROUP BY 1, 2, 3)
SELECT qid, docid, round({_SCORE}, 4) AS score FROM pooled GROUP BY 1, 2""")
def ml19_sf22_kernel_scores(spark: SparkSession, d: str) -> DataFrame:
    q, docs, near = _vectors(spark, d)
    return rankers.kernel_scores(q, docs, near, _WEIGHTS).withColumn("score", F.round("score", 4))


@query()
def ml19_trained_head(spark: SparkSession, d: str) -> DataFrame:
    """Scores by a head that is fitted on judged pairs: a pair is relevant if the query's first vector has the label of most of the document's."""
    q, docs, near = _vectors(spark, d)
    labels = table(spark, d, "embeddings", "vec_id", "label")
    wanted = labels.filter("vec_id % 8 = 0").select(F.floor(F.col("vec_id") / 8).cast("long").alias("qid"), F.col("label").alias("wanted"))
    held = labels.groupBy(F.floor(F.col("vec_id") / 12).cast("long").alias("docid"), "label").agg(F.count("*").alias("n"))
    held = held.groupBy("docid").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("held"))
    judged = rankers.kernel_features(q, docs, near).join(wanted, "qid").join(held, "docid").withColumn("relevant", (F.col("wanted") == F.col("held")).cast("int"))
    weights, offset = rankers.trained_head(judged, "relevant")
    return judged.select("qid", "docid", "relevant", (sum((F.get("kernels", F.lit(i)) * w for i, w in enumerate(weights)), F.lit(offset))).alias("score"))


@query()
def ml20_ml22_context_scores(spark: SparkSession, d: str) -> DataFrame:
    q, docs, near = _vectors(spark, d)

    def listed(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "vector"))), lambda s: s.vector).alias(name))

    pairs = near.join(listed(q, "qid", "query_vectors"), "qid").join(listed(docs, "docid", "document_vectors"), "docid")
    return rankers.score_in_batches(pairs, ["qid", "docid"], rankers.ContextRanker(64))


@query()
def ml1_sc9_chunks(spark: SparkSession, d: str) -> DataFrame:
    return extraction.chunked(table(spark, d, "documents", "text", "doc_id"), "text", "doc_id")


@query()
def ml3_triples(spark: SparkSession, d: str) -> DataFrame:
    return extraction.extracted(table(spark, d, "chunks", "chunk_id", "text"), "triples", extraction.RuleClient())


@query()
def ml2_concepts(spark: SparkSession, d: str) -> DataFrame:
    return extraction.cleaned_concepts(extraction.extracted(table(spark, d, "chunks", "chunk_id", "text"), "concepts", extraction.RuleClient()))


@query()
def ml24_codebooks(spark: SparkSession, d: str) -> DataFrame:
    return coding.codebooks(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query()
def ag20_compression(spark: SparkSession, d: str) -> DataFrame:
    return coding.compression(ml24_codebooks(spark, d))


@query("""WITH b AS (SELECT key, symbol, count(*) AS n FROM (SELECT doc_id AS key, unnest(string_split(text, '')) AS symbol FROM documents WHERE text <> '') WHERE symbol <> '' GROUP BY 1, 2),
coded AS (SELECT key, n, ceil(log2(count(*) OVER (PARTITION BY key))) AS bits FROM b)
SELECT key, CAST(sum(bits * n) AS BIGINT) AS coded_bits, CAST(sum(n) * 8 AS BIGINT) AS plain_bits, round(100.0 * (1 - sum(bits * n) / (sum(n) * 8)), 6) AS reduction FROM coded GROUP BY 1""")
def ag20_sf26_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The size formula over all symbols of every text, with codes of one length for each text."""
    from pyspark.sql import Window

    symbols = table(spark, d, "documents", F.col("doc_id").alias("key"), F.explode(F.split("text", "")).alias("symbol")).filter("symbol <> ''")
    books = symbols.groupBy("key", "symbol").agg(F.count("*").alias("n"))
    bits = F.ceil(F.log2(F.count("*").over(Window.partitionBy("key")).cast("double")))
    return coding.compression(books.withColumn("code", F.repeat(F.lit("0"), bits.cast("int")))).withColumn("reduction", F.round("reduction", 6))


def _pendulums(spark: SparkSession, d: str) -> DataFrame:
    starts = table(spark, d, "nation", "n_nationkey").select(
        F.col("n_nationkey").cast("long").alias("traj_id"), (F.lit(1.3) + F.col("n_nationkey") * 0.01).alias("theta1"), F.lit(0.0).alias("z1"), F.lit(2.3).alias("theta2"), F.lit(0.0).alias("z2")
    )
    return chaos.trajectories(starts, seconds=30.0)


@query()
def ml25_sf27_pendulums(spark: SparkSession, d: str) -> DataFrame:
    return chaos.positions(_pendulums(spark, d))


@query()
def ag24_energy_drift(spark: SparkSession, d: str) -> DataFrame:
    return chaos.energy_drift(_pendulums(spark, d))


@query()
def wn8_trails(spark: SparkSession, d: str) -> DataFrame:
    return chaos.trails(_pendulums(spark, d))


@query("SELECT event_id FROM events WHERE event_id % 10 = 0")
def wn9_every_tenth(spark: SparkSession, d: str) -> DataFrame:
    return chaos.frames(table(spark, d, "events", F.col("event_id").alias("step"))).withColumnRenamed("step", "event_id")


@query("""SELECT user_id AS key, string_agg(event_type, '' ORDER BY event_id) AS text FROM events e
WHERE event_id <= coalesce((SELECT min(event_id) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase'), event_id) GROUP BY 1""")
def sm3_joined_stream(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "events", "user_id", "event_id", "event_type").withColumn("done", F.col("event_type") == "purchase")
    return extraction.joined_stream(parts, "user_id", "event_id", "event_type", "done").withColumnRenamed("user_id", "key")
