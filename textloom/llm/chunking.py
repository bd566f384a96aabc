"""Texts above a size limit, cut into overlapping pieces at content-defined places.

A rolling hash over the text marks landmarks that depend only on the characters around them. A cut
goes to the natural boundary nearest the first landmark after the minimum size, so an edit changes
the pieces near it and the cuts further on fall where they fell before. Landmarks are of two kinds:
where a window has none of the rare kind, the last one of the frequent kind is taken.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 32
LANDMARK_BITS, BACKUP_BITS = 9, 6
#: How far a cut may be from its landmark for a stronger boundary before a weaker one is taken.
NEAR = 300
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Natural boundaries, strongest first; the cut falls after the match.
_BOUNDARIES = tuple(
    re.compile(p)
    for p in (
        r"\n[^\S\n]*\n\s*",
        r"(?:[.!?…]+[\"'”’»)\]]*\s+(?=[^\Wa-zà-ÿа-я_]|[\"“„«¿¡(\[]|$)|[。！？]+[」』”’）]*\s*|[।؟۔]+\s*)",
        r"\n\s*",
        r"[,;:،؛、，；：–—]\s+|[、，；：]",
        r"\s+",
    )
)


@dataclass(frozen=True)
class Limits:
    """Sizes in characters (code points)."""

    most: int = 1500
    overlap: int = 150
    least: int = 500

    def __post_init__(self) -> None:
        if not 0 < 2 * self.least <= self.most - self.overlap or self.overlap < 0:
            raise ValueError("the least size must fit twice beside the overlap")


def landmarks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions at which the hash of the WINDOW characters before has its first bits 0: LANDMARK_BITS, and BACKUP_BITS of them."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < WINDOW:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(codes), _BASE, dtype=np.uint64), dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((codes + np.uint64(1)) * powers, dtype=np.uint64)])
        undo = np.cumprod(np.full(len(codes), _INVERSE, dtype=np.uint64), dtype=np.uint64)
        hashes = (sums[WINDOW:] - sums[:-WINDOW]) * undo[: len(codes) - WINDOW + 1]
        hashes ^= hashes >> np.uint64(31)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
    main, backup = (np.flatnonzero(hashes >> np.uint64(64 - bits) == 0) + WINDOW for bits in (LANDMARK_BITS, BACKUP_BITS))
    return main, backup


def _whole(text: str, at: int, low: int) -> int:
    """``at``, moved back so as not to part a character from its marks or joiners."""
    while at > low and at < len(text) and (unicodedata.combining(text[at]) or text[at] in "‍️" or text[at - 1] == "‍"):
        at -= 1
    return at


def split_text(text: str, limits: Limits) -> list[tuple[int, int, int]]:
    """(start, core start, end) of every piece: the cores join to the whole text."""
    if len(text) <= limits.most:
        return [(0, 0, len(text))]
    room = limits.most - limits.overlap
    marks, backups = landmarks(text)
    natural = [np.fromiter((m.end() for m in p.finditer(text)), dtype=np.int64) for p in _BOUNDARIES]

    def within(positions: np.ndarray, low: int, high: int) -> np.ndarray:
        return positions[np.searchsorted(positions, low) : np.searchsorted(positions, high, side="right")]

    def cut_near(aim: int, low: int, high: int) -> int:
        """The strongest boundary near the landmark, else the strongest there is, else 0."""
        for reach in (NEAR, high - low):
            for positions in natural:
                near = within(positions, max(low, aim - reach), min(high, aim + reach))
                if len(near):
                    return int(near[np.abs(near - aim).argmin()])
        return 0

    pieces, core, start = [], 0, 0
    while len(text) - core > room:
        low, high = core + limits.least, core + room
        if len(text) - high < limits.least:  # so that the last piece has the least size, too
            high = max(low, len(text) - limits.least)
        main, backup = within(marks, low, high), within(backups, low, high)
        aim = int(main[0]) if len(main) else int(backup[-1]) if len(backup) else high
        cut = cut_near(aim, low, high) or _whole(text, aim, low)
        pieces.append((start, core, cut))
        low = max(cut - limits.overlap, core)
        # the overlap begins at a sentence if one begins there, else at a word, else it is cut hard
        at = next((int(p[0]) for p in (within(natural[1], low, cut - 1), within(natural[4], low, cut - 1)) if len(p)), None)
        start, core = _whole(text, low, core) if at is None else at, cut
        if core - start > limits.overlap:
            start = core
    pieces.append((start, core, len(text)))
    return pieces


def split_oversized(df: DataFrame, keys: list[str], text: str, limits: Limits = Limits()) -> DataFrame:
    """Pieces of the texts above ``limits.most`` characters: ``keys, piece, pieces, start_char, core_start, end_char, piece_text``.

    Offsets are code points; ``piece`` counts from 1. A piece shares its characters from
    ``start_char`` to ``core_start`` with the one before. Texts within the limit, empty and null
    ones give no rows: they need no cut. Repeated rows give repeated pieces. Texts are cut whole;
    one without any blank is cut at its landmarks, never between a character and its marks. The
    least size holds for what a piece doesn't share with the one before, the last one included.
    """
    source = df.select(*(F.col(f"`{k}`").alias(k) for k in keys), F.col(f"`{text}`").cast("string").alias("__text")).filter(F.length("__text") > limits.most)
    schema = T.StructType(
        [source.schema[k] for k in keys]
        + [T.StructField(c, T.IntegerType()) for c in ("piece", "pieces", "start_char", "core_start", "end_char")]
        + [T.StructField("piece_text", T.StringType())]
    )

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple] = []
            for *key, body in frame.itertuples(index=False, name=None):
                pieces = split_text(body, limits)
                out.extend((*key, i, len(pieces), s, c, e, body[s:e]) for i, (s, c, e) in enumerate(pieces, 1))
            yield pd.DataFrame(out, columns=schema.names)

    return source.mapInPandas(cut, schema)
