"""Evaluation passages that appear in a training corpus, in whole or in part.

A prefix-filtered set join on word shingles: shingles of the passages are ordered by how rare they
are in the corpus, each passage window joins on the rarest ones that it can't do without, and what
the bounds on count and position leave is verified word by word over windows of the passage.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.plans.scratch import Scratch

SHINGLE = 5
#: The filter of the items' shingles: bits for each, places a shingle takes, and the most bits, whatever the number of items (16 MB).
FILTER_BITS, PLACES, MOST_BITS = 32, 4, 2**27
_BASE = np.uint64(0x9E3779B97F4A7C15)

_TAGS = re.compile(r"<sup>[^<>]*</sup>|</?[A-Za-z][^<>]{0,80}>|\[\d{1,3}\]|[¹²³⁰⁴-⁹₀-₉]")
_HIDDEN = re.compile(r"[­​-‏⁠﻿]")
_WRAP = re.compile(r"(?<=\w)[-‐‑]\s*\n\s*(?=\w)")
_POINT = re.compile(r"(?<=\d)[.,'’٫](?=\d)|(?<=\w)['’ʼ`´\-‐‑](?=\w)")
_WORDS = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Words as compared: no case, accents, punctuation, markup, note marks, soft or line-end hyphens."""
    # each step runs only where its characters occur: most texts need few of them
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _HIDDEN.sub("", text)
    text = _TAGS.sub("", text) if "<" in text or "[" in text or not text.isascii() else text
    text = _WRAP.sub("", text) if "\n" in text else text
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    else:
        text = text.lower()
    return _WORDS.findall(_POINT.sub("", text))


#: Hashes of words seen by this process, up to MOST_KNOWN of them: most words of a text have been seen before.
_KNOWN: dict[str, int] = {}
MOST_KNOWN = 500_000


def _hashed(tokens: list[str]) -> np.ndarray:
    for token in tokens:
        if token not in _KNOWN:
            _KNOWN[token] = xxhash.xxh64_intdigest(token)
    hashes = np.fromiter(map(_KNOWN.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    if len(_KNOWN) > MOST_KNOWN:
        _KNOWN.clear()
    return hashes


def _shingles(hashes: np.ndarray) -> np.ndarray:
    n = len(hashes) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            out = out * _BASE + (hashes[k : k + n] ^ (hashes[k : k + n] >> np.uint64(29)))
        out ^= out >> np.uint64(32)
        out *= _BASE
        out ^= out >> np.uint64(29)
    return out


def _place(shingles: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The k-th place of each shingle in a filter of ``bits`` bits, a power of two."""
    with np.errstate(over="ignore"):
        return (shingles + np.uint64(k) * ((shingles >> np.uint64(33)) | np.uint64(1))) & np.uint64(bits - 1)


def carries(document: np.ndarray, passage: np.ndarray, run: int, diagonals: np.ndarray) -> bool:
    """Whether ``run`` running words of the passage stand in the document with at most one altered, dropped or added."""
    n = len(passage)
    if n < run:
        return False
    places = np.arange(n)

    def matches(diagonal: int) -> tuple[np.ndarray, np.ndarray]:
        at = places + diagonal
        inside = (at >= 0) & (at < len(document))
        same = np.zeros(n, dtype=bool)
        same[inside] = document[at[inside]] == passage[inside]
        ends, starts = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 2, dtype=np.int64)
        ends[1:] = places + 1 - np.maximum.accumulate(np.where(same, 0, places + 1))  # matches that end with word i
        starts[:n] = np.minimum.accumulate(np.where(same, n, places)[::-1])[::-1] - places  # matches that start at word i
        return ends, starts

    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(d: int) -> tuple[np.ndarray, np.ndarray]:
        if d not in known:
            known[d] = matches(d)
        return known[d]

    for d in {int(x) for x in diagonals}:
        ends, starts = at(d)
        # word i altered; with nothing altered the window is found as well
        if (ends[:n] + 1 + starts[1 : n + 1]).max() >= run or ends.max() >= run:
            return True
        for first, second in ((d, d - 1), (d + 1, d)):  # word i dropped
            if (at(first)[0][:n] + 1 + at(second)[1][1 : n + 1]).max() >= run:
                return True
        for first, second in ((d, d + 1), (d - 1, d)):  # a word added before word i
            joined = at(first)[0][: n + 1] + at(second)[1][: n + 1]
            if joined.max() >= run:
                return True
    return False


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, passage: str, run: int = 12) -> DataFrame:
    """Columns ``doc_id, item_id``: documents that carry ``run`` running words of a passage, at most one of them altered, dropped or added.

    Null and empty texts carry nothing; passages of fewer than ``run`` words can't be carried.
    Documents with the same id count as one. The documents are read once, whatever the number of
    items: what goes to the tasks is a filter of the items' shingles, of at most ``MOST_BITS`` bits,
    and what it lets through by chance finds no item. No document's words are shuffled unless it
    shares at least as many shingles with the items, that close together, as a leak must.
    """
    if run < 2 * SHINGLE + 1:
        raise ValueError(f"a run of {run} words with one altered need not share {SHINGLE} words in a row")
    spark = documents.sparkSession
    scratch = Scratch(spark, "leaks")
    # a window has run - 4 shingles; one altered word takes out 5 of them
    per_window = run - SHINGLE + 1
    needed = per_window - SHINGLE
    prefix = per_window - needed + 1

    @F.pandas_udf("array<long>")
    def item_words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _hashed(words(t)).view(np.int64).tolist())

    @F.pandas_udf("array<struct<h:long,p:int>>")
    def postings(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: [{"h": h, "p": p} for p, h in enumerate(_shingles(np.asarray(a, dtype=np.int64).view(np.uint64)).view(np.int64).tolist())])

    listed = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{passage}`").alias("passage")).dropna()
    listed = scratch.write(listed.withColumn("words", item_words("passage")).drop("passage").filter(F.size("words") >= run), "items")
    every = scratch.write(listed.select("item", F.inline(postings("words"))), "shingles")
    vocabulary = every.select("h").distinct()
    bits = min(MOST_BITS, max(2**12, 1 << (FILTER_BITS * vocabulary.count()).bit_length()))

    @F.pandas_udf("array<long>")
    def filter_places(h: pd.Series) -> pd.Series:
        return pd.Series(np.stack([_place(h.to_numpy().view(np.uint64), bits, k) for k in range(PLACES)], axis=1).astype(np.int64).tolist())

    set_bits = vocabulary.select(F.explode(filter_places("h")).alias("place"))
    set_bits = set_bits.groupBy((F.col("place") / 64).cast("long").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits"))
    field = np.zeros(bits // 64, dtype=np.int64)
    filled = set_bits.toPandas()  # MOST_BITS / 64 rows at most
    field[filled["word"].to_numpy(dtype=np.int64)] = filled["bits"].to_numpy(dtype=np.int64)
    shared_field = spark.sparkContext.broadcast(field.view(np.uint64))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = shared_field.value
        for frame in frames:
            rows = []
            # the texts of a batch are looked up at once: a shingle must not reach into the next text
            hashed = [_hashed(words(body)) for body in frame["text"]]
            flat = np.concatenate(hashed) if hashed else np.empty(0, dtype=np.uint64)
            of = np.repeat(np.arange(len(hashed)), [len(h) for h in hashed])
            starts = np.cumsum([0, *(len(h) for h in hashed)])
            shingles = _shingles(flat)
            at = np.flatnonzero(of[: len(shingles)] == of[SHINGLE - 1 :]) if len(shingles) else np.empty(0, dtype=np.int64)
            for k in range(PLACES):
                place = _place(shingles[at], bits, k)
                at = at[(field[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
            docs, firsts = np.unique(of[at], return_index=True)
            for doc, found in zip(docs, np.split(at, firsts[1:]) if len(docs) else (), strict=True):
                own = found - starts[doc]
                # bound on count and position: a leak has `needed` hits within the reach of one window
                near = len(own) >= needed and (own[needed - 1 :] - own[: len(own) - needed + 1] <= per_window).any()
                hits = [{"h": h, "p": p} for h, p in zip(shingles[found].view(np.int64).tolist(), own.tolist(), strict=True)]
                rows.append((frame["doc"].iloc[doc], hashed[doc].view(np.int64).tolist() if near else None, hits))
            yield pd.DataFrame(rows, columns=["doc", "words", "hits"])

    texts = documents.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text")).filter((F.length("text") > run) & F.col("doc").isNotNull())
    schema = T.StructType(
        [T.StructField("doc", texts.schema["doc"].dataType), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("hits", T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("p", T.IntegerType())])))]
    )
    seen = scratch.write(texts.mapInPandas(scan, schema), "seen")
    # how rare a shingle is in the whole corpus
    rarity = seen.select(F.explode(F.array_distinct("hits.h")).alias("h")).groupBy("h").agg(F.count("*").alias("df")).join(vocabulary, "h", "left_semi")
    ranked = every.join(rarity, "h", "left").na.fill(0, ["df"])
    # the rarest shingles of each window; each is listed once a passage place
    windows = ranked.withColumn("w", F.explode(F.sequence(F.greatest(F.col("p") - (per_window - 1), F.lit(0)), F.col("p"))))
    last = every.groupBy("item").agg(F.max("p").alias("last"))
    windows = windows.join(last, "item").filter(F.col("w") + (per_window - 1) <= F.col("last"))
    rank = F.row_number().over(Window.partitionBy("item", "w").orderBy("df", "h", "p"))
    necessary = windows.withColumn("r", rank).filter((F.col("r") <= prefix) & (F.col("df") > 0)).select("item", "h").distinct()
    near = seen.filter("words is not null")
    hits = near.select("doc", F.inline("hits"))
    candidates = scratch.write(hits.join(necessary, "h").select("doc", "item").distinct(), "candidates")
    # all shared shingles of a candidate pair, by diagonal: enough of them must lie close together
    shared = candidates.join(hits, "doc").join(every.select("item", "h", F.col("p").alias("ip")), ["item", "h"])
    seeds = shared.groupBy("doc", "item", (F.col("p") - F.col("ip")).alias("d")).agg(F.count("*").alias("m"))
    beside = Window.partitionBy("doc", "item").orderBy("d").rangeBetween(-1, 1)
    seeds = seeds.withColumn("m", F.sum("m").over(beside)).filter(F.col("m") >= needed).groupBy("doc", "item").agg(F.collect_set("d").alias("ds"))

    @F.pandas_udf("boolean")
    def verified(document: pd.Series, item: pd.Series, diagonals: pd.Series) -> pd.Series:
        return pd.Series([carries(np.asarray(d), np.asarray(i), run, np.asarray(x)) for d, i, x in zip(document, item, diagonals, strict=True)])

    pairs = seeds.join(near.select("doc", F.col("words").alias("doc_words")), "doc").join(listed.select("item", F.col("words").alias("item_words")), "item")
    return pairs.filter(verified("doc_words", "item_words", "ds")).select(F.col("doc").alias(doc_id), F.col("item").alias(item_id)).distinct()
