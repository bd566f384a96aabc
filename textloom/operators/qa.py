"""Question-answer pairing, resuming, and answer scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import exact_match, token_f1
from textloom.plans.order import numbered


def with_query_text(answers: DataFrame, tuples: DataFrame) -> DataFrame:
    """``query_id, doc_id, query_text``: answers left-joined with query texts, deduplicated before the projection."""
    texts = tuples.select("queryid", "query_text")
    return answers.join(texts, F.col("query_id") == F.col("queryid"), "left").distinct().select("query_id", "doc_id", "query_text")


def with_document_text(pairs: DataFrame, tuples: DataFrame, complete: bool = True) -> DataFrame:
    """Adds ``document_text``, once per matching tuple; ``complete`` drops rows with a null, else equal rows are folded."""
    joined = pairs.join(tuples.select("documentid", "document_text"), F.col("doc_id") == F.col("documentid"), "left").drop("documentid")
    return joined.na.drop() if complete else joined.distinct()


def common_queries(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    return a.select(F.col(key_a).alias("queryid")).intersect(b.select(F.col(key_b).alias("queryid")))


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that has no result yet, each key once."""
    return work.dropDuplicates(keys).join(done.select(*keys), keys, "left_anti")


def answer_scores(gold: DataFrame, predicted: DataFrame, key: str, answer: str, positional: bool = False, order: str | None = None) -> DataFrame:
    """One row a compared pair: ``key, gold, predicted, exact, f1``.

    Answers are compared by ``key``; with ``positional`` by place in the order of ``order``, as far
    as the shorter list goes.
    """
    if positional:
        by = [F.col(order or key)]
        left = numbered(gold, by, "__n").select("__n", F.col(key), F.col(answer).alias("gold"))
        right = numbered(predicted, by, "__n").select("__n", F.col(answer).alias("predicted"))
        pairs = left.join(right, "__n").drop("__n")
    else:
        pairs = gold.select(key, F.col(answer).alias("gold")).join(predicted.select(key, F.col(answer).alias("predicted")), key)
    return pairs.withColumn("exact", exact_match(F.coalesce("gold", F.lit("")), F.coalesce("predicted", F.lit("")))).withColumn("f1", token_f1(F.col("gold"), F.col("predicted")))


def best_sentence(question: str, passage: str) -> str:
    """The offline reader: the sentence that shares most words with the question, the first of equals."""
    import re

    wanted = set(re.findall(r"\w+", question.lower()))
    parts = [p for p in re.split(r"(?<=[.!?。！？])\s+", passage.strip()) if p]
    return max(parts, key=lambda p: len(wanted & set(re.findall(r"\w+", p.lower()))), default="")


def extract_answers(pairs: DataFrame, keys: list[str], reader: Callable[[str, str], str] = best_sentence) -> DataFrame:
    """``keys, answer``: a pluggable reader over ``query_text`` and ``document_text``; null in, null out."""

    @F.pandas_udf("string")
    def answer(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for questions, passages in frames:
            yield pd.Series([None if q is None or p is None else reader(q, p) for q, p in zip(questions, passages, strict=True)], dtype="object")

    return pairs.select(*keys, answer("query_text", "document_text").alias("answer"))
