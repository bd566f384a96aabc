"""Consensus labels from annotators who disagree, by regularised minimax conditional entropy.

An annotator's answer k to an item of true level c has log weight sigma_annotator(c, k) +
tau_item(c, k). The tilting parameters are the dual variables of the minimax problem; they climb
its regularised dual by coordinate-wise Newton steps, in turn with the posteriors of the levels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.plans.scratch import Scratch

SALTS = 16
#: Annotators whose parameters go to every task (16 numbers each at four levels); for more, answers are joined to them.
MOST_USERS = 50_000
#: Answers that are computed at once.
AT_ONCE = 100_000
#: A Newton step is at most so long, and so much of it is taken.
LONGEST, TAKEN = 2.0, 0.7


def readable_level(text: Column, levels: int) -> Column:
    """The level a label starts with: ``3``, ``3_full_answer`` or `` 3 full answer``; else null."""
    level = F.regexp_extract(F.trim(F.regexp_replace(text, "^[\\s\\u00a0]+", "")), "^(\\d)(?!\\d)", 1)
    number = F.when(level != "", level.cast("int"))
    return F.when(number < levels, number)


def latest_answers(judgements: DataFrame, item: list[str], user: str, label: str, at: str, loaded: str, levels: int) -> DataFrame:
    """One readable level per annotator and item: the last judged, then last loaded, then highest."""
    rows = judgements.select(
        *(F.col(f"`{c}`").alias(f"i{k}") for k, c in enumerate(item)),
        F.col(f"`{user}`").alias("user"),
        readable_level(F.col(f"`{label}`"), levels).alias("x"),
        F.col(f"`{at}`").alias("at"),
        F.col(f"`{loaded}`").alias("loaded"),
    )
    keys = [f"i{k}" for k in range(len(item))]
    rows = rows.dropna(subset=[*keys, "user", "x"]).filter(F.trim("user") != "")
    return rows.groupBy(*keys, "user").agg(F.max(F.struct("at", "loaded", "x")).alias("last")).select(*keys, "user", F.col("last.x").alias("x"))


def consensus(
    judgements: DataFrame,
    item: list[str],
    user: str,
    label: str,
    at: str,
    loaded: str,
    levels: int = 4,
    rounds: int = 16,
    alpha: float = 0.5,
    beta: float | None = None,
    tolerance: float = 0.01,
) -> tuple[DataFrame, DataFrame]:
    """Items (``*item, level, confidence, agreement, n_users``) and annotators (``user, n_items, accuracy, reliability``).

    ``level`` is the mode of the posterior, the lower of equals; ``agreement`` is the share of
    agreeing pairs of annotators (null with one annotator) and has no part in the fit.
    ``reliability`` is the annotator's fitted probability of the true level, averaged over the
    items' posteriors; ``accuracy`` the share of answers that equal the consensus. Unreadable
    labels and rows without item or annotator don't count; of several answers of one annotator
    the last judged counts. An empty input gives empty results. ``alpha`` and ``beta`` are the
    weights of the squared parameters of annotators and items; without ``beta`` it is ``alpha``
    times the answers of an annotator over those of an item, on average. The fit ends once no
    posterior moves by more than ``tolerance``, or after ``rounds``. Items carry ``tilt``, the
    largest of their tilting parameters, so it can be seen what these do.

    The answers are written once, as a list an item. While the annotators are few enough for their
    parameters to go to every task, a round is one pass over the items without a shuffle of theirs;
    sums of the annotators are combined in the task. Beyond that, answers are joined to parameters.
    """
    scratch = Scratch(judgements.sparkSession, "consensus")
    keys = [f"i{k}" for k in range(len(item))]
    answers = scratch.write(latest_answers(judgements, item, user, label, at, loaded, levels), "answers")
    n_users, n_items, n = answers.agg(F.count_distinct("user"), F.count_distinct(*keys), F.count("*")).first()
    beta = alpha * n_items / max(n_users, 1) if beta is None else beta
    fit = _fit_by_item if n_users <= MOST_USERS else _fit_by_joins
    items, annotators = fit(scratch, answers, keys, levels, rounds, alpha, beta, tolerance)
    items = items.select(*(F.col(k).alias(c) for k, c in zip(keys, item, strict=True)), "level", "confidence", "agreement", "n_users", "tilt")
    return items, annotators.withColumnRenamed("user", user)


class _Fit:
    """The pass over items for one state of the annotators' parameters ``sigma`` (annotator, true level, answer)."""

    def __init__(self, sigma: np.ndarray, beta: float, first: bool) -> None:
        self.sigma, self.beta, self.first = sigma, beta, first
        self.levels = sigma.shape[1]

    def chances(self, user: np.ndarray, tau: np.ndarray) -> np.ndarray:
        e = np.exp(self.sigma[user] + tau)
        return e / e.sum(axis=2, keepdims=True)

    def slopes(self, p: np.ndarray, x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the dual by answer."""
        seen = np.eye(self.levels)[x][:, None, :]
        return q[:, :, None] * (seen - p), q[:, :, None] * p * (1 - p)

    def parts(self, batch: pa.RecordBatch) -> Iterator[tuple]:
        """(rows, answers' annotators and levels, item of each answer, q, tau) of AT_ONCE answers or one item at a time."""
        ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(batch["u"])))])
        low = 0
        while low < len(ends) - 1:
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + AT_ONCE, side="right")) - 1)
            part = batch.slice(low, high - low)
            size = np.diff(ends[low : high + 1])
            numbers = {c: part[c].flatten().to_numpy(zero_copy_only=False) for c in ("u", "x", "q", "tau")}
            yield (
                part, numbers["u"], numbers["x"], np.repeat(np.arange(high - low), size), ends[low:high] - ends[low],
                numbers["q"].reshape(-1, self.levels), numbers["tau"].reshape(-1, self.levels, self.levels),
            )
            low = high

    def moved(self, user, x, of, starts, q, tau) -> tuple[np.ndarray, np.ndarray]:
        """New posteriors and tilting parameters of items."""
        p = self.chances(user, tau[of])
        g, h = (np.add.reduceat(v, starts) for v in self.slopes(p, x, q[of]))
        evidence = np.add.reduceat(np.log(np.take_along_axis(p, x[:, None, None], axis=2)[:, :, 0]), starts)
        weight = np.exp(evidence - evidence.max(axis=1, keepdims=True))
        return weight / weight.sum(axis=1, keepdims=True), tau + _step(g, h, tau, self.beta)

    def round(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The items with new parameters, and at the end one row an annotator with the sums for its own."""
        sums = np.zeros((2, len(self.sigma), self.levels**2))
        present = np.zeros(len(self.sigma), dtype=bool)
        furthest, schema = 0.0, None
        numbers = {c: pa.list_(pa.float64()) for c in ("q", "tau", "sums")} | {c: pa.list_(pa.int32()) for c in ("u", "x")}
        for batch in batches:
            schema = pa.schema([(f.name, numbers.get(f.name, f.type)) for f in batch.schema])
            for part, user, x, of, starts, q, tau in self.parts(batch):
                new_q, new_tau = (q, tau) if self.first else self.moved(user, x, of, starts, q, tau)
                furthest = max(furthest, 1.0 if self.first else float(np.abs(new_q - q).max()))
                p = self.chances(user, new_tau[of])
                for total, v in zip(sums, self.slopes(p, x, new_q[of]), strict=True):
                    flat = v.reshape(len(user), -1)
                    for k in range(flat.shape[1]):
                        total[:, k] += np.bincount(user, flat[:, k], minlength=len(total))
                present[user] = True
                columns = {c: part[c] for c in part.schema.names} | {"q": _lists(new_q), "tau": _lists(new_tau)}
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)
        if schema is not None:
            at = np.flatnonzero(present)
            rows = {"part": pa.array([*at.tolist(), -1], pa.int32()), "sums": pa.array([*np.concatenate([*sums], axis=1)[at].tolist(), [furthest]], pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_arrays([rows.get(f.name, pa.nulls(len(at) + 1, f.type)) for f in schema], schema=schema)

    def result(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, x, of, _, q, tau in self.parts(batch):
                counts = np.zeros(q.shape)
                np.add.at(counts, (of, x), 1)
                n = counts.sum(axis=1)
                agreeing = (counts * (counts - 1)).sum(axis=1)
                top = q.max(axis=1)
                own = [c for c in part.schema.names if c.startswith("i")]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part[c] for c in own),
                        pa.array((q >= top[:, None] - 1e-12).argmax(axis=1).astype(np.int32)), pa.array(top),
                        pa.array([a / (m * (m - 1)) if m > 1 else None for a, m in zip(agreeing, n, strict=True)], pa.float64()),
                        pa.array(n.astype(np.int32)), pa.array(np.abs(tau).max(axis=(1, 2))),
                    ],
                    names=[*own, "level", "confidence", "agreement", "n_users", "tilt"],
                )

    def reliability(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By annotator: answers, those that equal the consensus, and the summed chance of the true level."""
        sums = np.zeros((3, len(self.sigma)))
        for batch in batches:
            for _, user, x, of, _, q, tau in self.parts(batch):
                level = (q >= q.max(axis=1, keepdims=True) - 1e-12).argmax(axis=1)
                right = (q[of] * np.diagonal(self.chances(user, tau[of]), axis1=1, axis2=2)).sum(axis=1)
                for total, v in zip(sums, (np.ones(len(user)), x == level[of], right), strict=True):
                    total += np.bincount(user, v, minlength=len(total))
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(v[at]) for v in sums)], names=["u", "n", "hits", "right"])


def _step(g: np.ndarray, h: np.ndarray, old: np.ndarray, weight: float) -> np.ndarray:
    """One Newton step on each coordinate of the regularised dual, kept within the safe region."""
    return TAKEN * np.clip((g - weight * old) / (h + weight), -LONGEST, LONGEST)


def _lists(values: np.ndarray) -> pa.Array:
    flat = values.reshape(len(values), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def _fit_by_item(scratch: Scratch, answers: DataFrame, keys: list[str], levels: int, rounds: int, alpha: float, beta: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    spark = scratch.spark
    names = sorted(r[0] for r in answers.select("user").distinct().collect())  # MOST_USERS at most
    users = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "user string, u int")
    listed = answers.withColumn("user", F.col("user").cast("string")).join(users, "user")
    listed = listed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("u", "x"))).alias("a"))
    given = [F.aggregate("a.x", F.lit(0), lambda n, x: n + (x == level).cast("int")) for level in map(F.lit, range(levels))]
    votes = F.array(*((n + 0.25) / (F.size("a") + 0.25 * levels) for n in given))
    none = F.lit(None)
    items = listed.select(*keys, F.col("a.u").alias("u"), F.col("a.x").alias("x"), votes.alias("q"), F.array_repeat(F.lit(0.0), levels**2).alias("tau"), none.cast("int").alias("part"), none.cast("array<double>").alias("sums"))
    order = items.columns
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    sigma = np.tile(np.eye(levels), (len(names), 1, 1))
    for r in range(rounds + 1):
        table = scratch.write(items.mapInArrow(_over(_Fit(sigma, beta, r == 0), "round"), shape), f"round-{r}")
        columns = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(2 * levels**2)]
        # a row an annotator; that of -1 tells how far the posteriors moved
        sums = table.filter("part >= 0").groupBy("part").agg(*columns).collect()
        furthest = table.filter("part < 0").agg(F.max(F.col("sums")[0])).first()[0]
        items = table.filter("part is null").withColumns({"part": none.cast("int"), "sums": none.cast("array<double>")}).select(*order)
        scratch.drop(f"round-{r - 1}")
        if r == rounds or furthest is None or furthest <= tolerance:
            break
        g, h = np.zeros_like(sigma), np.zeros_like(sigma)
        for row in sums:
            g[row[0]], h[row[0]] = np.array(row[1:]).reshape(2, levels, levels)
        sigma = sigma + _step(g, h, sigma, alpha)
    fit = _Fit(sigma, beta, False)
    by_key = ", ".join(f"{k} {items.schema[k].dataType.simpleString()}" for k in keys)
    result = items.mapInArrow(_over(fit, "result"), f"{by_key}, level int, confidence double, agreement double, n_users int, tilt double")
    sums = items.mapInArrow(_over(fit, "reliability"), "u int, n double, hits double, right double").groupBy("u").agg(*(F.sum(c).alias(c) for c in ("n", "hits", "right")))
    annotators = sums.join(users, "u").select("user", F.col("n").cast("long").alias("n_items"), (F.col("hits") / F.col("n")).alias("accuracy"), (F.col("right") / F.col("n")).alias("reliability"))
    return result, annotators


def _over(fit: _Fit, step: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from getattr(fit, step)(batches)

    return apply


def _fit_by_joins(scratch: Scratch, answers: DataFrame, keys: list[str], levels: int, rounds: int, alpha: float, beta: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """The same for any number of annotators.


    The annotators' parameters are joined to the answers by (annotator, salt), so the busiest is
    spread over ``SALTS`` keys; all sums are combined map-side before they are shuffled.
    """
    cells = [(c, k) for c in range(levels) for k in range(levels)]
    answers = scratch.write(answers.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")), "salted")

    def zeros(n: int) -> Column:
        return F.array(*[F.lit(0.0)] * n)

    def spread(parameters: DataFrame) -> DataFrame:
        return parameters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    # smoothed vote shares to begin with
    votes = answers.groupBy(*keys).agg(*(F.sum((F.col("x") == c).cast("int")).alias(f"n{c}") for c in range(levels)))
    voted = sum(F.col(f"n{c}") for c in range(levels))
    items = scratch.write(votes.select(*keys, F.array(*((F.col(f"n{c}") + 0.25) / (voted + 0.25 * levels) for c in range(levels))).alias("q"), zeros(levels**2).alias("tau")), "items-0")
    # and confusions that favour the diagonal
    start = F.array(*(F.lit(1.0 if c == k else 0.0) for c, k in cells))
    users = scratch.write(answers.groupBy("user").agg(F.count("*").alias("n")).select("user", start.alias("sigma")), "users-0")

    def with_weights(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({f"e{c}{k}": F.exp(F.col("sigma")[c * levels + k] + F.col("tau")[c * levels + k]) for c, k in cells})
        rows = rows.withColumns({f"z{c}": sum((F.col(f"e{c}{k}") for k in range(1, levels)), F.col(f"e{c}0")) for c in range(levels)})
        return rows.withColumns({f"p{c}{k}": F.col(f"e{c}{k}") / F.col(f"z{c}") for c, k in cells})

    def sums() -> list[Column]:
        gradient = [F.sum(F.col("q")[c] * ((F.col("x") == k).cast("double") - F.col(f"p{c}{k}"))).alias(f"g{c}{k}") for c, k in cells]
        curvature = [F.sum(F.col("q")[c] * F.col(f"p{c}{k}") * (1 - F.col(f"p{c}{k}"))).alias(f"h{c}{k}") for c, k in cells]
        return gradient + curvature

    def climbed(old: str, weight: float) -> Column:
        # one Newton step on each coordinate of the regularised dual, kept within the safe region
        steps = (F.greatest(F.lit(-LONGEST), F.least(F.lit(LONGEST), (F.col(f"g{c}{k}") - weight * F.col(old)[c * levels + k]) / (F.col(f"h{c}{k}") + weight))) for c, k in cells)
        return F.array(*(F.col(old)[c * levels + k] + TAKEN * s for (c, k), s in zip(cells, steps, strict=True)))

    for r in range(1, rounds + 1):
        rows = answers.join(items, keys).join(spread(users), ["user", "salt"])
        new = with_weights(rows).groupBy("user").agg(F.first("sigma").alias("sigma"), *sums())
        users_new = scratch.write(new.select("user", climbed("sigma", alpha).alias("sigma")), f"users-{r}")
        rows = answers.join(items, keys).join(spread(users_new), ["user", "salt"])
        evidence = [F.sum(F.ln(F.element_at(F.array(*(F.col(f"p{c}{k}") for k in range(levels))), F.col("x") + 1))).alias(f"l{c}") for c in range(levels)]
        new = with_weights(rows).groupBy(*keys).agg(F.first("tau").alias("tau"), *sums(), *evidence)
        top = F.greatest(*(F.col(f"l{c}") for c in range(levels)))
        new = new.withColumns({f"w{c}": F.exp(F.col(f"l{c}") - top) for c in range(levels)})
        mass = sum((F.col(f"w{c}") for c in range(1, levels)), F.col("w0"))
        items_new = scratch.write(new.select(*keys, F.array(*(F.col(f"w{c}") / mass for c in range(levels))).alias("q"), climbed("tau", beta).alias("tau")), f"items-{r}")
        both = items_new.select(*keys, F.col("q").alias("new")).join(items.select(*keys, "q"), keys)
        furthest = both.agg(F.max(F.array_max(F.zip_with("q", "new", lambda a, b: F.abs(a - b))))).first()[0]
        scratch.drop(f"users-{r - 1}")
        scratch.drop(f"items-{r - 1}")
        users, items = users_new, items_new
        if furthest is None or furthest <= tolerance:
            break

    confidence = F.array_max("q")
    decided = items.select(*keys, (F.array_position(F.transform("q", lambda v: v >= confidence - 1e-12), True) - 1).cast("int").alias("level"), confidence.alias("confidence"), F.array_max(F.transform("tau", F.abs)).alias("tilt"))
    n = F.count("*")
    counts = answers.groupBy(*keys).agg(n.alias("n_users"), *(F.sum((F.col("x") == c).cast("long")).alias(f"n{c}") for c in range(levels)))
    agreeing = sum((F.col(f"n{c}") * (F.col(f"n{c}") - 1) for c in range(1, levels)), F.col("n0") * (F.col("n0") - 1))
    agreement = F.try_divide(agreeing.cast("double"), F.col("n_users") * (F.col("n_users") - 1))
    result = decided.join(counts, keys).select(*keys, "level", "confidence", agreement.alias("agreement"), F.col("n_users").cast("int"), "tilt")
    fitted = with_weights(answers.join(items, keys).join(spread(users), ["user", "salt"]).join(decided.drop("confidence", "tilt"), keys))
    right = sum((F.col("q")[c] * F.col(f"p{c}{c}") for c in range(1, levels)), F.col("q")[0] * F.col("p00"))
    annotators = fitted.groupBy("user").agg(F.count("*").alias("n_items"), F.avg((F.col("x") == F.col("level")).cast("double")).alias("accuracy"), F.avg(right).alias("reliability"))
    return result, annotators
