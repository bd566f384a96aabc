"""Several values packed in one field, split into one row per value with its position.

Spans that may hold separators of their own (quoted values, degrees after a comma, surnames
before their given name, names of groups, topic labels) are replaced with indexed placeholders,
what is left is split at the separators, and every piece gets its spans back by looking them up
in the row's array of spans. The marks of the placeholders are escaped in the input first, so no
text can collide with them. All of it is column expressions: no Python and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "", ""
#: Stands on both sides of a span while it is taken out.
EDGE = "\ue002"
ESCAPED_EDGE = OPEN + "m"
ESCAPED = OPEN + "e"
BLANKS = "[\\s\\u00a0\\u2000-\\u200b\\u202f\\u205f\\u3000\\ufeff]"

_SEP = "[,;|/\\n\\t]"
#: What may stand before a value: the start of the field, a separator, or the last connector. The first part looks at one
#: character and rules out most places at once.
_START = f"(?<![^\\s,;|/])(?<=^\\s{{0,8}}|{_SEP}\\s{{0,8}}|\\band\\s|&\\s)"
_END = f"(?=\\s*(?:{_SEP}|$)|\\s+(?:and|&)\\s)"

QUOTED = f'{_START}"(?:[^"\\\\]|\\\\.|"")*"{_END}'
LIST_QUOTED = "(?<=^\\s{0,8}|,\\s{0,8})(?:'(?:[^'\\\\]|\\\\.)*'|\"(?:[^\"\\\\]|\\\\.)*\")(?=\\s*(?:,|$))"


@dataclass(frozen=True)
class Packing:
    """How a field packs its values: what is kept whole, and where the rest is split.

    Each pattern of ``keep`` comes with a text that every span of it holds: fields without that
    text need no search.
    """

    keep: tuple[tuple[str, str], ...]
    split: str


# Degrees after a comma, what may follow a comma within the name of a group, words that end one that is joined by "and".
DEGREES = ("MD", "M\\.D\\.", "PhD", "Ph\\.D\\.", "DSc", "MSc", "MPH", "FRCP", "RN", "Jr\\.?", "Sr\\.?")
GROUP_PARTS = ("phase\\s+[IVX\\d]+\\s+\\w+\\.?",)
GROUP_ENDS = ("cons?o\\w*m\\b", "cons\\.", "alliance\\b", "collaboration\\b")
_SURNAME_FIRST = (
    f"{_START}(?:(?i:van\\s+der|van\\s+den|van|von|v\\.\\s?d\\.|de\\s+la|de|di|da|dos|el|al)\\s+)?"
    f"[\\p{{L}}'’\\-]+\\s?,[ \\u00a0]*(?=[\\p{{L}}])[^,;|/\\n\\t{OPEN}]+"
)

#: A lone word is no full name, so one that ends an entry belongs to what stands before its comma.
_LONE_GIVEN = f"{_START}[^,;|/\\n\\t{OPEN}]+,[ \\u00a0]*[\\p{{L}}'’\\-]{{2,}}(?=\\s*(?:[;|/\\n\\t]|$))"


def name_packing(degrees: tuple[str, ...] = DEGREES, group_parts: tuple[str, ...] = GROUP_PARTS, group_ends: tuple[str, ...] = GROUP_ENDS) -> Packing:
    """Persons and groups: a comma after a lone surname belongs to the name. The lists are patterns of the field's own kind."""
    degree = f",\\s*(?:{'|'.join(degrees)}){_END}"
    part = f",\\s*(?i:{'|'.join(group_parts)})"
    joined = f"\\w+\\s+(?:and|&)\\s+\\w+\\s+(?i:{'|'.join(group_ends)})"
    keep = ((QUOTED, '"'), (part, ","), (degree, ","), (joined, ""), (_SURNAME_FIRST, ","), (_LONE_GIVEN, ","))
    return Packing(keep, f"{_SEP}|\\s+(?:and|&)\\s+|^and\\s+")


NAMES = name_packing()
#: Numbered labels: a separator counts only where another label or the end follows.
LABELS = Packing(
    ((QUOTED, '"'), (f"-?\\d+_(?s:(?!\\s*{_SEP}[\\s,;|/]*(?:-?\\d+_|\"|{OPEN}|$)).)+", "_")),
    _SEP,
)
#: Plain values: only quoted spans are kept whole.
PLAIN = Packing(((QUOTED, '"'),), _SEP)


def _mark(df: DataFrame, pattern: str, applies: Column) -> DataFrame:
    """Take the spans of one pattern out of ``__text``; the k-th gets the next free index. One search finds and parts them."""
    found = F.when(applies, F.split(F.regexp_replace("__text", F.lit(pattern), F.lit(f"{EDGE}$0{EDGE}")), EDGE, -1)).otherwise(F.array("__text"))
    df = df.withColumn("__parts", found)
    held = F.size("__spans")
    marked = F.transform("__parts", lambda part, i: F.when(i % 2 == 0, part).otherwise(F.concat(F.lit(OPEN), (held + F.floor(i / 2)).cast("string"), F.lit(CLOSE))))
    return df.withColumns({"__text": F.array_join(marked, ""), "__spans": F.concat("__spans", F.filter("__parts", lambda part, i: i % 2 == 1))}).drop("__parts")


def _restore(piece: Column, spans: Column) -> Column:
    return F.aggregate(
        F.regexp_extract_all(piece, F.lit(f"{OPEN}(\\d+){CLOSE}"), F.lit(1)),
        piece,
        lambda acc, i: F.replace(acc, F.concat(F.lit(OPEN), i, F.lit(CLOSE)), F.get(spans, i.cast("int"))),
    )


def _unquote(piece: Column) -> Column:
    inner = F.substring(piece, F.lit(2), F.length(piece) - 2)
    double = F.replace(F.regexp_replace(inner, '\\\\(["\\\\/])', "$1"), F.lit('""'), F.lit('"'))
    single = F.regexp_replace(inner, "\\\\(['\\\\])", "$1")
    return (
        F.when((F.length(piece) >= 2) & piece.startswith('"') & piece.endswith('"'), double)
        .when((F.length(piece) >= 2) & piece.startswith("'") & piece.endswith("'"), single)
        .otherwise(piece)
    )


def _trim(piece: Column) -> Column:
    return F.regexp_replace(piece, f"^{BLANKS}+|{BLANKS}+$", "")


def split_packed(df: DataFrame, value: str, packing: Packing, keys: list[str], val: str = "val", pos: str = "pos") -> DataFrame:
    """One row per value of ``df[value]``: the ``keys``, the position from 1, and the value.

    Null, blank and empty-list fields give no row; empty pieces give none and take no position.
    Repeated input rows give repeated output rows. Other columns of ``df`` are left out, so they
    can't clash; ``keys`` may not contain ``val`` or ``pos``.
    """
    if {val, pos} & set(keys):
        raise ValueError("keys may not be named like the columns of the result")
    df = df.select(*(F.col(f"`{k}`").alias(k) for k in keys), F.col(f"`{value}`").cast("string").alias("__text"))
    clean = _trim(F.replace(F.replace(F.col("__text"), F.lit(OPEN), F.lit(ESCAPED)), F.lit(EDGE), F.lit(ESCAPED_EDGE)))
    df = df.withColumn("__text", clean).filter(F.length("__text") > 0)
    listed = F.col("__text").startswith("[") & F.col("__text").endswith("]") & F.col("__text").rlike("^\\[\\s*(?:[\"']|\\])")
    df = df.withColumn("__list", listed).withColumn("__text", F.when(listed, F.expr("substring(__text, 2, length(__text) - 2)")).otherwise(F.col("__text")))
    df = df.withColumn("__spans", F.array().cast("array<string>"))
    for pattern, applies in ((LIST_QUOTED, F.col("__list")), *((p, ~F.col("__list") & F.col("__text").contains(held)) for p, held in packing.keep)):
        df = _mark(df, pattern, applies)
    pieces = F.split("__text", packing.split, -1)
    for _ in range(3):  # a kept span may hold one kept earlier
        pieces = F.transform(pieces, lambda p: _restore(p, F.col("__spans")))
    pieces = F.transform(pieces, lambda p: F.replace(F.replace(_trim(_unquote(_trim(p))), F.lit(ESCAPED_EDGE), F.lit(EDGE)), F.lit(ESCAPED), F.lit(OPEN)))
    pieces = F.filter(pieces, lambda p: F.length(p) > 0)
    return df.select(*(F.col(f"`{k}`") for k in keys), F.posexplode(pieces).alias(pos, val)).withColumn(pos, (F.col(pos) + 1).cast("int"))
