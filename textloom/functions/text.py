"""Column expressions over text: normalising, tokens, answer scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation, as a character class.
PUNCTUATION = "[!-/:-@\\[-`{-~]"


def normalize_answer(text: Column) -> Column:
    """Lower case, punctuation deleted, articles blanked, white space collapsed; in this order."""
    bare = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "(?U)\\b(a|an|the)\\b", " "), "(?U)\\s+", " "))


def answer_tokens(text: Column) -> Column:
    """Tokens of the normalised text; an empty array for null, empty and article-only texts."""
    return F.filter(F.split(normalize_answer(F.coalesce(text, F.lit(""))), " "), lambda t: t != "")


def exact_match(gold: Column, predicted: Column) -> Column:
    return (normalize_answer(gold) == normalize_answer(predicted)).cast("int")


def token_f1(gold: Column, predicted: Column) -> Column:
    """F1 of the token multisets; with an empty side 1 if both are empty, else 0."""

    def times(tokens: Column, token: Column) -> Column:
        return F.size(F.filter(tokens, lambda x: x == token))

    def score(g: Column, p: Column) -> Column:
        shared = F.aggregate(F.array_distinct(g), F.lit(0), lambda n, t: n + F.least(times(g, t), times(p, t)))
        return F.when((F.size(g) == 0) | (F.size(p) == 0), (F.size(g) == F.size(p)).cast("double")).otherwise(2 * shared / (F.size(g) + F.size(p)))

    # the tokens are bound to a lambda's variable, so each text is normalised once
    sides = F.array(F.struct(answer_tokens(gold).alias("g"), answer_tokens(predicted).alias("p")))
    return F.get(F.transform(sides, lambda s: score(s.g, s.p)), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores, in any script."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))


def blank_tokens(text: Column) -> Column:
    """Tokens between white space; none for a blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "(?U)\\s+"), lambda t: t != "")


def punctuated_tokens(text: Column) -> Column:
    """Words and single punctuation marks."""
    return F.regexp_extract_all(text, F.lit("[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]"), F.lit(0))


def without_stop_words(tokens: Column, stop_words: list[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(stop_words)) if stop_words else tokens


def topic_tokens(text: Column, stop_words: list[str]) -> Column:
    """Punctuation and digits out, stop words out, case kept."""
    bare = F.regexp_replace(F.regexp_replace(text, PUNCTUATION, " "), "\\d+", "")
    return F.filter(blank_tokens(bare), lambda t: ~F.lower(t).isin(stop_words))


def first_line(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def full_name(last: Column, first: Column) -> Column:
    """``last first``; a missing part reads ``None``."""
    return F.concat_ws(" ", F.coalesce(last, F.lit("None")), F.coalesce(first, F.lit("None")))


def json_triples(text: Column) -> Column:
    """An array of node_1, node_2, edge; null for anything that isn't JSON of that shape."""
    return F.from_json(text, "array<struct<node_1:string,node_2:string,edge:string>>")


def epoch_of(file_name: Column) -> Column:
    number = F.regexp_extract(file_name, "epoch_(\\d+)", 1)
    return F.when(number != "", number.cast("int"))


def stable_id(*parts: Column) -> Column:
    """A reproducible 128-bit hexadecimal id, where a random one would differ between runs."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 32)


def blank_to_null(value: Column, blank: str = " ") -> Column:
    return F.nullif(value, F.lit(blank))
