"""Topics: AG9-AG13, WN1, WN7, JN12-JN14, PF12, PF13, RS2-RS4, ST3, TK5, SF21, SF24, SF25, ML13-ML18."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import topic_tokens
from textloom.functions.vectors import argmax, dot, norm
from textloom.operators import topics as T
from textloom.plans.session import table
from textloom.registry import query

_STOP = "the of and in to a is was were for with by from at on that this".split()


@query("""SELECT Topic, Count, round(100.0 * Count / sum(Count) OVER (), 6) AS percent,
round(100.0 * sum(Count) OVER (ORDER BY Count DESC, Topic ROWS UNBOUNDED PRECEDING) / sum(Count) OVER (), 6) AS cumulative FROM topic_info""")
def ag13_wn1_topic_shares(spark: SparkSession, d: str) -> DataFrame:
    return T.shares(table(spark, d, "topic_info", "Topic", "Count")).withColumns({"percent": F.round("percent", 6), "cumulative": F.round("cumulative", 6)})


@query("SELECT Topic, Count FROM topic_info ORDER BY Count DESC, Topic LIMIT 7")
def tk5_largest_topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "topic_info", "Topic", "Count").orderBy(F.col("Count").desc(), "Topic").limit(7)


_MEAN = """cells AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
means AS (SELECT label, list(x ORDER BY i) AS v FROM cells GROUP BY 1)"""


@query(f"""WITH {_MEAN} SELECT a.label AS topic_1, b.label AS topic_2,
round(list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) / sqrt(list_sum(list_transform(a.v, lambda x: x * x))) / sqrt(list_sum(list_transform(b.v, lambda x: x * x))), 6) AS similarity
FROM means a JOIN means b ON a.label < b.label""")
def jn12_rs4_topic_similarity(spark: SparkSession, d: str) -> DataFrame:
    means = T.mean_vectors(table(spark, d, "embeddings", "label", "embedding"), "label", "embedding")
    return T.similarities(means, "label", "vector").withColumn("similarity", F.round("similarity", 6))


@query("""SELECT a.Name AS topic_1, b.Name AS topic_2 FROM topic_info a JOIN topic_info b ON a.Name < b.Name WHERE NOT starts_with(a.Name, '-1') AND NOT starts_with(b.Name, '-1')""")
def pf12_topic_pairs_without_outliers(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "topic_info", "Name").filter(~F.col("Name").startswith("-1"))
    return names.toDF("topic_1").join(names.toDF("topic_2"), F.col("topic_1") < F.col("topic_2"))


@query("SELECT vec_id, list_transform(list_filter(list_zip(embedding, range(0, 64)), lambda s: s[1] >= 0.13), lambda s: CAST(s[2] AS INTEGER)) AS topics FROM embeddings")
def pf13_sf24_positions_above(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings", "vec_id", "embedding")
    return T.above_threshold(rows, "embedding", 0.13).select("vec_id", "topics")


_PROBS = "probs AS (SELECT vec_id, round(abs(CAST(embedding[i] AS DOUBLE)), 4) AS prob FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"


def _probabilities(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.explode("embedding").alias("x"))
    return cells.select("vec_id", F.round(F.abs(F.col("x").cast("double")), 4).alias("prob"))


@query(f"""WITH {_PROBS}, per AS (SELECT t, vec_id, count(*) AS n FROM probs JOIN (SELECT unnest(range(0, 350)) AS t) ON floor(round(prob / 0.001, 6)) >= t GROUP BY 1, 2)
SELECT CAST(t AS INTEGER) AS threshold_no, least(n, 5) AS n_topics, count(*) AS docs FROM per GROUP BY 1, 2""")
def jn13_st3_threshold_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.topics_at_thresholds(_probabilities(spark, d), "vec_id", "prob")


@query(f"""WITH {_PROBS}, per AS (SELECT t, vec_id, count(*) AS n FROM probs JOIN (SELECT unnest(range(0, 350)) AS t) ON floor(round(prob / 0.001, 6)) >= t GROUP BY 1, 2),
docs AS (SELECT count(DISTINCT vec_id) AS m FROM probs)
SELECT CAST(t AS INTEGER) AS threshold_no, round(100.0 * (m - count(*)) / m, 6) AS n0, {", ".join(f"round(100.0 * count(*) FILTER (least(n, 5) = {k}) / m, 6) AS n{k}" for k in range(1, 6))}
FROM per, docs GROUP BY t, m""")
def ag12_rs2_sf25_threshold_table(spark: SparkSession, d: str) -> DataFrame:
    probabilities = _probabilities(spark, d)
    wide = T.threshold_table(T.topics_at_thresholds(probabilities, "vec_id", "prob"), probabilities.select("vec_id").distinct().count())
    return wide.withColumns({f"n{k}": F.round(f"n{k}", 6) for k in range(6)})


@query("""WITH ids AS (SELECT doc_id, [doc_id % 49 - 1, (doc_id + 7) % 49 - 1] AS ids FROM topic_modelling)
SELECT doc_id, a.Name || ', ' || b.Name AS names FROM ids JOIN topic_info a ON a.Topic = ids[1] JOIN topic_info b ON b.Topic = ids[2]""")
def jn14_sf12_topic_names(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "topic_modelling", "doc_id").select("doc_id", F.array(F.col("doc_id") % 49 - 1, (F.col("doc_id") + 7) % 49 - 1).alias("ids"))
    return T.labelled(docs, "ids", table(spark, d, "topic_info"), "Topic", "Name", "doc_id")


_WORDS = r"""texts AS (SELECT list_filter(regexp_split_to_array(abstract, '[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+'), lambda t: t <> '') AS w FROM article_info_long WHERE abstract IS NOT NULL)"""


@query(f"WITH {_WORDS} SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM texts) GROUP BY 1")
def ag9_sf7_unigrams(spark: SparkSession, d: str) -> DataFrame:
    return T.term_counts(table(spark, d, "article_info_long", "abstract"), "abstract")


@query(f"WITH {_WORDS}, pairs AS (SELECT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM texts)) SELECT a, b, count(*) AS n FROM pairs GROUP BY 1, 2")
def ag9_wn7_bigrams(spark: SparkSession, d: str) -> DataFrame:
    return T.bigram_counts(table(spark, d, "article_info_long", "abstract"), "abstract")


def _topic_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "topic_info", "Topic", "Representation").select(F.col("Topic").alias("topic"), F.posexplode("Representation").alias("place", "word"))


@query(f"""WITH {_WORDS}, one AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM texts) GROUP BY 1),
two AS (SELECT w[i] AS a, w[i + 1] AS b, count(*) AS n FROM (SELECT w, unnest(range(1, len(w))) AS i FROM texts) GROUP BY 1, 2),
tw AS (SELECT Topic AS topic, unnest(Representation) AS word, unnest(range(0, len(Representation))) AS place FROM topic_info),
docs AS (SELECT count(*) AS m FROM article_info_long WHERE abstract IS NOT NULL)
SELECT x.topic, round(avg(CASE WHEN t.n IS NULL THEN 0 ELSE ln((t.n / m) / (o.n / m) / (p.n / m)) / nullif(-ln(t.n / m), 0) END), 6) AS npmi
FROM tw x JOIN tw y ON x.topic = y.topic AND x.place < y.place CROSS JOIN docs LEFT JOIN one o ON o.word = x.word LEFT JOIN one p ON p.word = y.word
LEFT JOIN two t ON t.a = x.word AND t.b = y.word GROUP BY 1""")
def ag10_npmi(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "article_info_long", "abstract").dropna()
    return T.npmi(_topic_words(spark, d), texts, "abstract").withColumn("npmi", F.round("npmi", 6))


@query(f"""WITH {_WORDS.replace("SELECT list_filter", "SELECT id, list_filter")}, tw AS (SELECT Topic AS topic, unnest(Representation) AS word, unnest(range(0, len(Representation))) AS place FROM topic_info),
docs AS (SELECT id, w, greatest(len(w) - 10, 0) AS last FROM texts WHERE len(w) > 0), total AS (SELECT CAST(sum(greatest(len(w) - 9, 1)) AS DOUBLE) AS m FROM docs),
spots AS (SELECT id, last, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM docs),
held AS (SELECT DISTINCT id, word, unnest(range(greatest(pos - 9, 0), least(pos, last) + 1)) AS win FROM spots WHERE word IN (SELECT word FROM tw)),
one AS (SELECT word, count(*) AS n FROM held GROUP BY 1), two AS (SELECT x.word AS a, y.word AS b, count(*) AS n FROM held x JOIN held y ON x.id = y.id AND x.win = y.win AND x.word <> y.word GROUP BY 1, 2),
pairs AS (SELECT x.topic, coalesce(t.n, 0) / m + 1e-12 AS pij, coalesce(o.n, 0) / m AS pi, coalesce(p.n, 0) / m AS pj FROM tw x JOIN tw y ON x.topic = y.topic AND x.place < y.place CROSS JOIN total
LEFT JOIN one o ON o.word = x.word LEFT JOIN one p ON p.word = y.word LEFT JOIN two t ON t.a = x.word AND t.b = y.word)
SELECT topic, round(avg(CASE WHEN pi * pj = 0 THEN 0 ELSE coalesce(ln(pij / (pi * pj)) / nullif(-ln(pij), 0), 0) END), 6) AS coherence FROM pairs GROUP BY 1""")
def ml17_window_coherence(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "article_info_long", "id", "abstract")
    return T.window_coherence(_topic_words(spark, d), texts, "id", "abstract").withColumn("coherence", F.round("coherence", 6))


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS squared,
round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings""")
def sf20_sf21_sf22_ml10_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.round(dot(v, v), 4).alias("squared"), F.round(norm(v), 4).alias("norm"), argmax(v).alias("best"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "article_info_long", "id", "abstract").dropna().select("id", topic_tokens(F.col("abstract"), _STOP).alias("tokens")).filter(F.size("tokens") > 0)


@query()
def ml14_ml18_lda_topics(spark: SparkSession, d: str) -> DataFrame:
    return T.lda_topics(_tokens(spark, d), "tokens")


@query()
def ml15_lsa_topics(spark: SparkSession, d: str) -> DataFrame:
    return T.lsa_topics(_tokens(spark, d), "tokens")


@query()
def ml16_nmf_topics(spark: SparkSession, d: str) -> DataFrame:
    return T.nmf_topics(_tokens(spark, d), "id", "tokens")


@query()
def ml13_clustered_topics(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings", F.col("vec_id").alias("id"), "embedding")
    return T.clustered_topics(vectors, "id", "embedding", _tokens(spark, d), "tokens")
