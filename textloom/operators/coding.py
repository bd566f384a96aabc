"""Symbol frequencies and Shannon-Fano codes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def symbol_counts(texts: DataFrame, text: str) -> DataFrame:
    """``symbol, n, probability`` over all texts."""
    symbols = texts.select(F.explode(F.split(text, "")).alias("symbol")).filter("symbol <> ''").groupBy("symbol").agg(F.count("*").alias("n"))
    return symbols.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a symbol


def shannon_fano(counts: list[int], lossless: bool = True) -> list[str]:
    """Codes for counts in descending order, by splitting where the halves' totals are nearest.

    With ``lossless`` false the published variant is followed: the split falls before the symbol
    that crosses half of the total, and a right part beside an empty left one is not split on, so
    codes may collide.
    """
    codes = [""] * len(counts)
    work = [(0, len(counts))]
    while work:
        start, end = work.pop()
        if end - start < 2:
            continue
        total, running, cut = sum(counts[start:end]), 0, start
        if lossless:
            best = None
            for k in range(start, end - 1):
                running += counts[k]
                gap = abs(total - 2 * running)
                if best is None or gap < best:
                    best, cut = gap, k + 1
            parts = ((start, cut, "0"), (cut, end, "1"))
        else:
            while cut < end and 2 * (running + counts[cut]) <= total:
                running += counts[cut]
                cut += 1
            if cut == start:
                codes[start] += "0"
                for k in range(start + 1, end):
                    codes[k] += "1"
                continue
            parts = ((start, cut, "0"), (cut, end, "1"))
        for low, high, bit in parts:
            for k in range(low, high):
                codes[k] += bit
            work.append((low, high))
    if len(counts) == 1:
        codes = ["0"]
    return codes


def codebooks(texts: DataFrame, key: str, text: str, lossless: bool = True) -> DataFrame:
    """``key, symbol, n, probability, code`` for every text. Only symbol counts reach the coder."""
    symbols = texts.select(F.col(key).cast("long").alias("key"), F.explode(F.split(text, "")).alias("symbol")).filter("symbol <> ''")
    counts = symbols.groupBy("key", "symbol").agg(F.count("*").alias("n"))

    # one row a text: as many entries as its alphabet has symbols
    listed = counts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "symbol"))).alias("s"))

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, symbols in frame.itertuples(index=False, name=None):
                n = [-int(x["less"]) for x in symbols]
                total = sum(n)
                rows += [(key, x["symbol"], k, k / total, c) for x, k, c in zip(symbols, n, shannon_fano(n, lossless), strict=True)]
            yield pd.DataFrame(rows, columns=["key", "symbol", "n", "probability", "code"])

    return listed.mapInPandas(code, "key long, symbol string, n long, probability double, code string")


def compression(books: DataFrame, bits_per_symbol: int = 8) -> DataFrame:
    """``key, coded_bits, plain_bits, reduction``: sizes without the codebook."""
    coded = F.sum(F.length("code") * F.col("n"))
    plain = F.sum(F.col("n")) * bits_per_symbol
    return books.groupBy("key").agg(coded.alias("coded_bits"), plain.alias("plain_bits")).withColumn("reduction", 100.0 * (1 - F.col("coded_bits") / F.col("plain_bits")))
