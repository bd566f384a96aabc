"""A mixture of sources that meets target shares of the size in tokens.

Every document has a fixed hash. Tokens are summed by source and leading hash bits; the budget of a
source ends in one bucket, and only that bucket is refined by the next bits, until it holds one
document. The documents below the threshold are the sample: no sort, and a smaller budget gives a
subset of a larger one's documents.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.scratch import Scratch

BITS = 10
#: Targets are a small table by nature; more sources than this are refused rather than collected.
MOST_SOURCES = 100_000


def token_counter(ranks_path: str, pattern: str):
    """A pandas UDF that counts the tokens of a text by a public byte-pair vocabulary of ranks."""

    @F.pandas_udf("long")
    def count(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in frames:
            yield pd.Series([0 if t is None else len(encoding.encode_ordinary(t)) for t in texts], dtype="int64")

    return count


def source_name(source: Column) -> Column:
    """Sources as typed differ in case, blanks and hyphens; documents and targets are read alike."""
    return F.regexp_replace(F.lower(F.regexp_replace(source, "^\\s+|\\s+$", "")), "[\\s-]+", "_")


def quotas(total: float, shares: dict[str, float], sizes: dict[str, int], repeats: dict[str, int]) -> dict[str, float]:
    """Tokens of each source: its share of ``total`` where it can give it, the rest of a source that can't goes to the others by their shares."""
    cap = {s: float(sizes.get(s, 0)) * max(repeats[s] or 0, 0) for s in shares}
    open_, result, left = {s for s in shares if shares[s] and cap[s] > 0}, dict.fromkeys(shares, 0.0), float(total)
    while open_:
        weight = sum(shares[s] for s in open_)
        short = {s for s in open_ if cap[s] <= left * shares[s] / weight}
        if not short:
            return result | {s: left * shares[s] / weight for s in open_}
        for s in short:
            result[s] = cap[s]
        left -= sum(cap[s] for s in short)
        open_ -= short
    return result


def mix_sources(documents: DataFrame, targets: DataFrame, doc_id: str, text: str, source: str, counter, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture (``doc_id, source, n_tokens, copies``) and the report by source.

    ``targets`` has ``source, target_share, max_repeats``; rows of one source add their shares, and
    the largest ``max_repeats`` holds. ``budget`` is the size of the mixture in
    tokens; without it, it is what all listed sources hold once. A source short of its share gives
    ``max_repeats`` copies of everything, and the others share the rest by their weights. Documents
    of no listed source, and null and empty texts, are not part of the mixture. Documents with the
    same id share one hash and are taken together. A source is off its quota by less than one
    document (or one group of equal ids). The report has ``source, target_share, max_repeats,
    available_tokens, quota_tokens, mixed_tokens, mixed_documents, reached_share``.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mix")
    wanted = [r.asDict() for r in targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").limit(MOST_SOURCES + 1).collect()]
    if len(wanted) > MOST_SOURCES:
        raise ValueError("too many sources in the targets")
    shares: dict[str, float] = {}
    repeats: dict[str, int] = {}
    for row in wanted:
        name = row["source"]
        if name:
            shares[name] = shares.get(name, 0.0) + float(row["target_share"] or 0)
            repeats[name] = max(repeats.get(name, 0), int(row["max_repeats"] or 0))
    schema = "source string, target_share double, max_repeats int"
    listed = spark.createDataFrame([(s, shares[s], repeats[s]) for s in sorted(shares)], schema)
    sizes_df = (
        documents.select(F.col(f"`{doc_id}`").alias("id"), source_name(F.col(f"`{source}`")).alias("source"), F.col(f"`{text}`").alias("text"))
        .join(F.broadcast(listed.select("source")), "source")
        .filter(F.length("text") > 0)
        .select("id", "source", counter(F.col("text")).alias("n_tokens"), F.shiftrightunsigned(F.xxhash64(F.col("id").cast("string")), 1).alias("h"))
    )
    sizes_df = scratch.write(sizes_df, "sizes")
    sizes = {r[0]: r[1] for r in sizes_df.groupBy("source").agg(F.sum("n_tokens")).collect()}  # one row a listed source
    quota = quotas(sum(sizes.values()) if budget is None else budget, shares, sizes, repeats)

    full = {s: int(quota[s] // sizes[s]) if sizes.get(s) else 0 for s in shares}
    rest = {s: quota[s] - full[s] * sizes.get(s, 0) for s in shares}
    prefix = {s: 0 for s in shares if rest[s] >= 1 and full[s] < repeats[s]}  # the boundary bucket so far
    threshold = {s: 0 for s in shares}
    taken = {s: 0.0 for s in shares}
    bits = 0
    while prefix and bits < 63:
        step = min(BITS, 63 - bits)
        at = spark.createDataFrame([(s, p) for s, p in prefix.items()], "source string, prefix long")
        inside = sizes_df.join(F.broadcast(at), "source").filter(F.shiftrightunsigned("h", 63 - bits) == F.col("prefix"))
        buckets = inside.groupBy("source", F.shiftrightunsigned("h", 63 - bits - step).alias("bucket")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
        running = buckets.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket")))
        need = spark.createDataFrame([(s, float(rest[s] - taken[s])) for s in prefix], "source string, need double")
        edge = running.join(F.broadcast(need), "source").filter("upto > need").groupBy("source").agg(F.min_by(F.struct("bucket", "tokens", "documents", "upto"), "bucket").alias("e"))
        found = {r["source"]: r["e"] for r in edge.collect()}
        bits += step
        for s in list(prefix):
            if s not in found:  # all of the bucket fits
                threshold[s] = (prefix[s] + 1) << (63 - bits + step)
                del prefix[s]
                continue
            e = found[s]
            taken[s] += e["upto"] - e["tokens"]
            threshold[s] = e["bucket"] << (63 - bits)
            if e["documents"] == 1 or bits == 63:
                if taken[s] + e["tokens"] - rest[s] < rest[s] - taken[s]:  # nearer with the last document than without
                    threshold[s] = (e["bucket"] + 1) << (63 - bits)
                del prefix[s]
            else:
                prefix[s] = e["bucket"]
    # a threshold past the last hash is one more full copy
    exact = spark.createDataFrame([(s, full[s] + (threshold[s] >= 2**63), threshold[s] % 2**63) for s in sorted(shares)], "source string, full int, cut long")
    mixture = (
        sizes_df.join(F.broadcast(exact), "source")
        .withColumn("copies", F.col("full") + (F.col("h") < F.col("cut")).cast("int"))
        .filter("copies > 0")
        .select(F.col("id").alias(doc_id), "source", "n_tokens", "copies")
    )
    reached = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("mixed_documents"))
    held = spark.createDataFrame([(s, int(sizes.get(s, 0)), float(quota[s])) for s in sorted(shares)], "source string, available_tokens long, quota_tokens double")
    report = listed.join(held, "source").join(reached, "source", "left").na.fill(0, ["mixed_tokens", "mixed_documents"])
    every = F.sum("mixed_tokens").over(Window.partitionBy())  # one row a listed source
    report = report.withColumn("reached_share", F.coalesce(F.try_divide(F.col("mixed_tokens"), every), F.lit(0.0)))
    return mixture, report
