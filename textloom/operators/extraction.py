"""Chunks and what a language model finds in them; the client is given by the caller."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", " ", "")


class Client(Protocol):
    """Anything that answers a prompt with JSON."""

    def generate(self, prompt: str) -> str: ...


class RuleClient:
    """The offline client: neighbouring long words of a sentence as triples or concepts."""

    def generate(self, prompt: str) -> str:
        kind, _, text = prompt.partition("\n")
        rows = []
        for sentence in re.split(r"(?<=[.!?])\s+", text):
            words = re.findall(r"[^\W\d_]{6,}", sentence)
            if kind == "triples":
                rows += [{"node_1": a, "node_2": b, "edge": sentence.strip()} for a, b in zip(words, words[1:], strict=False)]
            else:
                rows += [{"entity": w, "importance": min(5, len(w) // 3), "category": "concept"} for w in words]
        return json.dumps(rows)


def recursive_chunks(text: str, size: int = 1500, overlap: int = 150, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that fits, sharing up to ``overlap``."""
    separator = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(separator) + 1 :]
    parts: list[str] = []
    for part in list(text) if separator == "" else text.split(separator):
        parts += [part] if len(part) <= size or not finer else recursive_chunks(part, size, overlap, finer)
    out: list[str] = []
    held: list[str] = []
    length = 0
    for part in parts:
        more = len(part) + (len(separator) if held else 0)
        if held and length + more > size:
            out.append(separator.join(held).strip())
            while held and (length > overlap or length + len(part) + len(separator) > size):
                length -= len(held.pop(0)) + (len(separator) if held else 0)
            more = len(part) + (len(separator) if held else 0)
        held.append(part)
        length += more
    out.append(separator.join(held).strip())
    return [c for c in out if c]


def chunked(texts: DataFrame, text: str, source: str, size: int = 1500, overlap: int = 150) -> DataFrame:
    """``text, source, chunk_no``: every text's chunks, numbered from 0."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(c, s, i) for body, s in frame.itertuples(index=False, name=None) if body for i, c in enumerate(recursive_chunks(body, size, overlap))]
            yield pd.DataFrame(rows, columns=["text", "source", "chunk_no"])

    return texts.select(F.col(text), F.col(source).cast("string")).mapInPandas(cut, "text string, source string, chunk_no int")


_SHAPES = {
    "triples": "array<struct<node_1:string,node_2:string,edge:string>>",
    "concepts": "array<struct<entity:string,importance:int,category:string>>",
}


def extracted(chunks: DataFrame, kind: str, client: Client) -> DataFrame:
    """The client's rows for every chunk, with its ``chunk_id``; answers that aren't the JSON asked for give none."""

    @F.pandas_udf("string")
    def answers(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            out = []
            for body in texts:
                try:
                    out.append(None if body is None else client.generate(f"{kind}\n{body}"))
                except Exception:  # one failing answer must not end the job; it gives no rows
                    out.append(None)
            yield pd.Series(out, dtype="object")

    rows = chunks.select("chunk_id", F.from_json(answers("text"), _SHAPES[kind]).alias("found"))
    return rows.select("chunk_id", F.inline("found"))


def cleaned_concepts(concepts: DataFrame) -> DataFrame:
    """Entities in lower case; a single blank counts as missing, and rows without entity are dropped."""
    return concepts.withColumn("entity", F.lower(F.nullif("entity", F.lit(" ")))).na.drop(subset=["entity"])


def joined_stream(parts: DataFrame, key: str, seq: str, text: str, done: str) -> DataFrame:
    """``key, text``: the parts of a streamed answer joined in order, up to the one marked done."""
    ended = parts.filter(F.col(done)).groupBy(key).agg(F.min(seq).alias("__end"))
    rows = parts.join(ended, key, "left").filter(F.col("__end").isNull() | (F.col(seq) <= F.col("__end")))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(seq, F.coalesce(text, F.lit("")).alias("t")))), lambda s: s.t), "").alias("text"))
