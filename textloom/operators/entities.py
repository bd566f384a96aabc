"""Entity mentions: word-piece merging, vocabulary matching, tag grammars."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.order import met, numbered, running


#: Terms of a vocabulary that texts are searched for.
MOST_TERMS = 100_000


def merge_word_pieces(pieces: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``doc, entity, score, index, word, start, end``: pieces that start with ``##`` join the word before.

    A merged word has the first piece's entity, index and start, the last one's end and the least
    score. Continuations with nothing before them are dropped.
    """
    order = Window.partitionBy(doc).orderBy("index")
    rows = pieces.withColumn("__new", (~F.col("word").startswith("##")).cast("int"))
    rows = rows.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("__island > 0")
    text = F.when(F.col("__new") == 1, F.col("word")).otherwise(F.expr("substring(word, 3)"))
    parts = F.sort_array(F.collect_list(F.struct("index", text.alias("t"))))
    merged = rows.groupBy(doc, "__island").agg(
        F.min_by("entity", "index").alias("entity"), F.min("score").alias("score"), F.min("index").alias("first"),
        F.array_join(F.transform(parts, lambda p: p.t), "").alias("word"), F.min_by("start", "index").alias("start"), F.max_by("end", "index").alias("end"),
    )
    return merged.select(doc, "entity", "score", F.col("first").alias("index"), "word", "start", "end")


def contains_any(rows: DataFrame, text: str, vocabulary: DataFrame, term: str) -> DataFrame:
    """Rows with each vocabulary term their text contains, whatever the case.

    The vocabulary is a stated list of at most ``MOST_TERMS``; rows are read once against all of it.
    """
    if vocabulary.limit(MOST_TERMS + 1).count() > MOST_TERMS:
        raise ValueError(f"a vocabulary of more than {MOST_TERMS} terms is no stated list")
    return rows.join(F.broadcast(vocabulary), F.lower(F.col(text)).contains(F.lower(F.col(term))))


def sentence_numbers(tokens: DataFrame, order: Column, index: str) -> DataFrame:
    """Adds ``sentence``: a new one starts where the index doesn't rise. ``order`` is the arrival order."""
    rows = numbered(tokens, [order], "__n")
    before = rows.select((F.col("__n") + 1).alias("__n"), F.col(index).alias("__before"))
    falls = F.coalesce((F.col(index) <= F.col("__before")).cast("int"), F.lit(0))
    return running(rows.join(before, "__n", "left"), [], [F.col("__n")], falls, "sentence").drop("__n", "__before")


def tagged(texts: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """``key, token, entity``: every word with its label in the vocabulary (``term, entity``, each term once) or ``No entity``."""
    tokens = texts.select(F.col(key).cast("string").alias("key"), F.explode(F.regexp_extract_all(F.col(text), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))).alias("token"))
    known = vocabulary.select(F.col("term").alias("__term"), "entity")
    return tokens.join(known, F.lower("token") == F.col("__term"), "left").select("key", "token", F.coalesce("entity", F.lit("No entity")).alias("entity"))


def noun_phrases(tokens: Column, tags: Column) -> Column:
    """Phrases of an optional determiner, adjectives and a noun: the grammar runs over the tag string."""
    joined = F.array_join(F.transform(F.arrays_zip(tokens.alias("w"), tags.alias("t")), lambda x: F.concat(x["w"], F.lit("/"), x["t"], F.lit(" "))), "")
    found = F.regexp_extract_all(joined, F.lit("(?:\\S+/DT )?(?:\\S+/JJ )*\\S+/NN "), F.lit(0))
    return F.transform(found, lambda p: F.rtrim(F.regexp_replace(p, "/[A-Z]+ ", " ")))


def tree_nouns(tree: Column) -> Column:
    """Proper and plural nouns of a bracketed parse tree, in order."""
    return F.regexp_extract_all(tree, F.lit("\\((NNP|NNS) ([^()]+)\\)"), F.lit(2))


def company_form(name: Column) -> Column:
    """The legal form a company name ends with; null for none."""
    form = F.regexp_extract(name, "(?i)\\b(GmbH & Co\\. KG|GmbH|AG|KG|OHG|UG|Ltd\\.?|LLP|Inc\\.?|S\\.A\\.|SE)(?:\\W|$)", 1)
    return F.nullif(form, F.lit(""))


def related(mentions: DataFrame, doc: str, place: str, entity: str, classify: Callable[[str, str], int]) -> DataFrame:
    """``doc, entity_1, entity_2, relation``: a pluggable class id for every two mentions, earlier first."""
    pairs = met(mentions.select(doc, place, entity), doc, {place: "__p", entity: "entity_1"}, {place: "__q", entity: "entity_2"}).filter("__p < __q")

    @F.pandas_udf("int")
    def label(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([classify(p, q) for p, q in zip(x, y, strict=True)], dtype="int32")

    return pairs.select(doc, "entity_1", "entity_2", label("entity_1", "entity_2").alias("relation"))
