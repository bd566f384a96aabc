"""Topic tables: shares, similarity, threshold sweeps, coherence, models."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import blank_tokens
from textloom.functions.vectors import cosine
from textloom.plans.order import numbered


def shares(topics: DataFrame, count: str = "Count", topic: str = "Topic") -> DataFrame:
    """Adds ``percent`` of the total and ``cumulative`` percent by count descending, then topic."""
    total = F.sum(count).over(Window.partitionBy())  # one row a topic
    running = F.sum(count).over(Window.orderBy(F.col(count).desc(), topic).rowsBetween(Window.unboundedPreceding, 0))
    return topics.withColumn("percent", 100.0 * F.col(count) / total).withColumn("cumulative", 100.0 * running / total)


def mean_vectors(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """``label, vector``: the mean of each position."""
    cells = vectors.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return cells.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("vector"))


def similarities(topics: DataFrame, label: str, vector: str) -> DataFrame:
    """``topic_1, topic_2, similarity`` for every two topics, the lesser first; topics are few."""
    a = topics.select(F.col(label).alias("topic_1"), F.col(vector).alias("v1"))
    b = topics.select(F.col(label).alias("topic_2"), F.col(vector).alias("v2"))
    return a.join(b, F.col("topic_1") < F.col("topic_2")).select("topic_1", "topic_2", cosine(F.col("v1"), F.col("v2")).alias("similarity"))


def topics_at_thresholds(probabilities: DataFrame, doc: str, prob: str, steps: int = 350, step: float = 0.001, most: int = 5) -> DataFrame:
    """``threshold_no, n_topics, docs``: how many documents have so many topics at each threshold.

    The number of topics of a document is a step function of the threshold, so each probability
    says once up to which step it counts, and runs of steps are added up: documents aren't
    multiplied by thresholds. ``n_topics`` of ``most`` or more is ``most``.
    """
    upto = F.least(F.floor(F.round(F.col(prob) / step, 6)).cast("int"), F.lit(steps - 1))
    cells = probabilities.select(doc, upto.alias("last")).filter("last >= 0").groupBy(doc, "last").agg(F.count("*").alias("m"))
    down = Window.partitionBy(doc).orderBy(F.col("last").desc())
    runs = cells.withColumn("n", F.sum("m").over(down)).withColumn("lower", F.coalesce(F.lead("last").over(down), F.lit(-1)))
    # the document has n topics on the steps (lower, last]
    changes = runs.select(F.least("n", F.lit(most)).alias("n_topics"), F.inline(F.array(F.struct((F.col("lower") + 1).alias("t"), F.lit(1).alias("c")), F.struct((F.col("last") + 1).alias("t"), F.lit(-1).alias("c")))))
    changes = changes.groupBy("n_topics", "t").agg(F.sum("c").alias("c"))
    grid = probabilities.sparkSession.range(steps).select(F.col("id").cast("int").alias("threshold_no"))
    counts = grid.join(changes, F.col("t") <= F.col("threshold_no")).groupBy("threshold_no", "n_topics").agg(F.sum("c").alias("docs"))
    return counts.filter("docs > 0")


def threshold_table(counts: DataFrame, docs: int, most: int = 5) -> DataFrame:
    """One row a threshold with the percent of documents by number of topics (``n0`` to ``n5``)."""
    wide = counts.groupBy("threshold_no").pivot("n_topics", list(range(1, most + 1))).agg(F.sum("docs")).na.fill(0)
    some = sum((F.col(str(k)) for k in range(2, most + 1)), F.col("1"))
    parts = [(100.0 * (docs - some) / docs).alias("n0"), *((100.0 * F.col(str(k)) / docs).alias(f"n{k}") for k in range(1, most + 1))]
    return wide.select("threshold_no", *parts)


def above_threshold(probabilities: DataFrame, array: str, threshold: float) -> DataFrame:
    """Adds ``topics``: positions in ``array`` of at least ``threshold``."""
    marked = F.transform(array, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    return probabilities.withColumn("topics", F.transform(F.filter(marked, lambda s: s.x >= threshold), lambda s: s.i))


def labelled(docs: DataFrame, ids: str, labels: DataFrame, topic: str, name: str, key: str) -> DataFrame:
    """``key, names``: the names of a list of topic ids, joined by commas in list order; unknown ids raise."""
    rows = docs.select(key, F.posexplode_outer(ids).alias("i", "t")).join(labels.select(F.col(topic).alias("t"), F.col(name).alias("n")), "t", "left")
    known = F.when(F.col("t").isNotNull() & F.col("n").isNull(), F.raise_error(F.concat(F.lit("unknown topic "), F.col("t").cast("string")))).otherwise(F.col("n"))
    listed = F.sort_array(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("i", known.alias("n")))))
    return rows.groupBy(key).agg(F.array_join(F.transform(listed, lambda s: s.n), ", ").alias("names"))


def term_counts(texts: DataFrame, text: str) -> DataFrame:
    return texts.select(F.explode(blank_tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def bigram_counts(texts: DataFrame, text: str) -> DataFrame:
    """Adjacent tokens within a text."""
    w = blank_tokens(F.col(text))
    rows = texts.select(w.alias("w")).filter(F.size("w") > 1)
    pairs = F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w") - 1).alias("b"))
    return rows.select(F.inline(pairs)).toDF("a", "b").groupBy("a", "b").agg(F.count("*").alias("n"))


def npmi(topics: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """``topic, npmi``: mean over the topic's word pairs, earlier word first.

    ``topics`` has ``topic, place, word``. Counts of tokens and adjacent pairs are divided by the
    number of texts, as the measure was published; a pair that never occurs counts 0, and one with
    a quotient of 1 is left out, since its measure isn't defined.
    """
    docs = texts.count()
    one, two = term_counts(texts, text), bigram_counts(texts, text)
    a = topics.select("topic", F.col("place").alias("p"), F.col("word").alias("a"))
    b = topics.select("topic", F.col("place").alias("q"), F.col("word").alias("b"))
    pairs = a.join(b, "topic").filter("p < q")
    pairs = pairs.join(one.select(F.col("word").alias("a"), F.col("n").alias("na")), "a", "left").join(one.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b", "left").join(two, ["a", "b"], "left")
    pij, pi, pj = (F.col(c).cast("double") / docs for c in ("n", "na", "nb"))
    value = F.when(F.col("n").isNull(), 0.0).otherwise(F.try_divide(F.ln(F.try_divide(pij, pi * pj)), -F.ln(pij)))
    return pairs.groupBy("topic").agg(F.avg(value).alias("npmi"))


def window_coherence(topics: DataFrame, texts: DataFrame, doc: str, text: str, size: int = 10, epsilon: float = 1e-12) -> DataFrame:
    """``topic, coherence``: mean NPMI of word pairs over sliding windows of ``size`` tokens.

    Only words of the topics are kept, with their places; a window counts a word once.
    """
    vocabulary = topics.select("word").distinct()
    rows = texts.select(F.col(doc).alias("doc"), blank_tokens(F.col(text)).alias("w")).filter(F.size("w") > 0)
    windows = rows.agg(F.sum(F.greatest(F.size("w") - (size - 1), F.lit(1)))).first()[0] or 0
    last = F.greatest(F.size("w") - size, F.lit(0))
    at = rows.select("doc", last.alias("last"), F.posexplode("w").alias("pos", "word")).join(vocabulary, "word", "left_semi")
    held = at.select("doc", "word", F.explode(F.sequence(F.greatest(F.col("pos") - (size - 1), F.lit(0)), F.least("pos", "last"))).alias("win")).distinct()
    one = held.groupBy("word").agg(F.count("*").alias("n"))
    b = held.select("doc", "win", F.col("word").alias("b"))
    two = held.withColumnRenamed("word", "a").join(b, ["doc", "win"]).filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n_ab"))
    left = topics.select("topic", F.col("place").alias("p"), F.col("word").alias("a"))
    pairs = left.join(topics.select("topic", F.col("place").alias("q"), F.col("word").alias("b")), "topic").filter("p < q")
    pairs = pairs.join(one.select(F.col("word").alias("a"), F.col("n").alias("n_a")), "a", "left").join(one.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b", "left").join(two, ["a", "b"], "left").na.fill(0, ["n_a", "n_b", "n_ab"])
    pij, pi, pj = (F.col(c) / F.lit(float(max(windows, 1))) for c in ("n_ab", "n_a", "n_b"))
    value = F.coalesce(F.try_divide(F.ln(F.try_divide(pij + epsilon, pi * pj)), -F.ln(pij + epsilon)), F.lit(0.0))
    return pairs.groupBy("topic").agg(F.avg(value).alias("coherence"))


def bag_of_words(texts: DataFrame, tokens: str, min_docs: int = 1, most: int = 2**31 - 1):
    from pyspark.ml.feature import CountVectorizer

    model = CountVectorizer(inputCol=tokens, outputCol="features", minDF=float(min_docs), vocabSize=most).fit(texts)
    return model, model.transform(texts)


def lda_topics(texts: DataFrame, tokens: str, k: int = 2, words: int = 5, seed: int = 42, rounds: int = 10) -> DataFrame:
    """``topic, place, word, weight``: the top words of each topic."""
    from pyspark.ml.clustering import LDA

    counts, bags = bag_of_words(texts, tokens)
    found = LDA(k=k, seed=seed, maxIter=rounds).fit(bags).describeTopics(words)
    vocabulary = F.array(*(F.lit(w) for w in counts.vocabulary)) if len(counts.vocabulary) < 2000 else None
    rows = found.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("place", "t")).select("topic", "place", F.col("t.termIndices").alias("i"), F.col("t.termWeights").alias("weight"))
    if vocabulary is not None:
        return rows.select("topic", "place", F.get(vocabulary, F.col("i")).alias("word"), "weight")
    names = texts.sparkSession.createDataFrame(list(enumerate(counts.vocabulary)), "i int, word string")
    return rows.join(names, "i").select("topic", "place", "word", "weight")


def lsa_topics(texts: DataFrame, tokens: str, k: int = 2, words: int = 5) -> DataFrame:
    """``topic, place, word, weight`` of the k strongest right singular vectors of the count matrix over all words."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    counts, bags = bag_of_words(texts, tokens)
    # the matrix type takes an RDD only; every iteration reads the rows
    rows = bags.select("features").rdd.map(lambda r: Vectors.fromML(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
    v = np.asarray(RowMatrix(rows).computeSVD(k).V.toArray())
    rows.unpersist()
    v = v * np.sign(v[np.abs(v).argmax(axis=0), range(v.shape[1])])
    out = [(t, p, counts.vocabulary[i], float(v[i, t])) for t in range(v.shape[1]) for p, i in enumerate(np.argsort(-v[:, t], kind="stable")[:words])]
    return texts.sparkSession.createDataFrame(out, "topic int, place int, word string, weight double")


def nmf_topics(texts: DataFrame, doc: str, tokens: str, k: int = 2, words: int = 5, seed: int = 42, rounds: int = 10) -> DataFrame:
    """``topic, place, word, weight`` by non-negative alternating least squares on the counts."""
    from pyspark.ml.recommendation import ALS

    cells = texts.select(F.col(doc).alias("doc"), F.explode(tokens).alias("word")).groupBy("doc", "word").agg(F.count("*").cast("float").alias("n"))
    for name, number in (("word", "w"), ("doc", "d")):
        cells = cells.join(numbered(cells.select(name).distinct(), [F.col(name)], number).withColumn(number, F.col(number).cast("int")), name)
    model = ALS(rank=k, maxIter=rounds, seed=seed, nonnegative=True, userCol="d", itemCol="w", ratingCol="n").fit(cells)
    names = cells.select(F.col("w").alias("id"), "word").distinct()
    weights = model.itemFactors.join(names, "id").select("word", F.posexplode("features").alias("topic", "weight"))
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.col("weight").desc(), "word")) - 1
    return weights.withColumn("place", place).filter(F.col("place") < words).select("topic", "place", "word", F.col("weight").cast("double").alias("weight"))


def clustered_topics(vectors: DataFrame, key: str, vector: str, texts: DataFrame, tokens: str, k: int = 10, words: int = 4, min_docs: int = 5, seed: int = 42) -> DataFrame:
    """``Topic, Count, Name, Representation``: k-means clusters named by class-based tf-idf."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    placed = KMeans(k=k, seed=seed).fit(points).transform(points).select(key, F.col("prediction").alias("Topic"))
    rows = placed.join(texts.select(key, F.col(tokens).alias("w")), key)
    terms = rows.select("Topic", key, F.explode("w").alias("word"))
    df = terms.select(key, "word").distinct().groupBy("word").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    tf = terms.join(df, "word").groupBy("Topic", "word").agg(F.count("*").alias("tf"))
    total = tf.groupBy("word").agg(F.sum("tf").alias("f"))
    size = tf.groupBy("Topic").agg(F.sum("tf").alias("size"))
    average = size.agg(F.avg("size").alias("a"))
    weighed = tf.join(total, "word").join(size, "Topic").join(F.broadcast(average)).withColumn("weight", F.col("tf") / F.col("size") * F.ln(1 + F.col("a") / F.col("f")))
    place = F.row_number().over(Window.partitionBy("Topic").orderBy(F.col("weight").desc(), "word"))
    best = weighed.withColumn("place", place).filter(F.col("place") <= words).groupBy("Topic").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("r"))
    named = best.select("Topic", F.transform("r", lambda s: s.word).alias("Representation"))
    count = placed.groupBy("Topic").agg(F.count("*").alias("Count"))
    return count.join(named, "Topic", "left").select("Topic", "Count", F.concat_ws("_", F.col("Topic").cast("string"), F.array_join("Representation", "_")).alias("Name"), "Representation")
