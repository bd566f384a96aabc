import math
import re
import string
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import vectors as V
from textloom.operators.coding import shannon_fano
from textloom.operators.extraction import recursive_chunks


def plain_norm(s):
    s = "".join(c for c in s.lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", s).split())


def plain_f1(g, p):
    g, p = plain_norm(g).split(), plain_norm(p).split()
    if not g or not p:
        return float(g == p)
    n = sum((Counter(g) & Counter(p)).values())
    return 0.0 if n == 0 else 2 * n / (len(g) + len(p))


CASES = [("a b b", "b b c"), ("the", ""), ("", "x"), ("Don't stop", "dont stop"), ("The theä cat", "cat theä"), ("a b c", "x y"), ("x x x", "x")]


def test_answer_scores(spark):
    df = spark.createDataFrame(CASES, "g string, p string").select("g", "p", T.token_f1(F.col("g"), F.col("p")).alias("f"), T.exact_match(F.col("g"), F.col("p")).alias("e"))
    for r in df.collect():
        assert r.f == pytest.approx(plain_f1(r.g, r.p)), r
        assert r.e == int(plain_norm(r.g) == plain_norm(r.p))
        assert not r.e or r.f == 1.0
    assert spark.sql("select cast(null as string) g, 'x' p").select(T.token_f1(F.col("g"), F.col("p"))).first()[0] == 0.0


def test_small_functions(spark):
    row = spark.sql("select 'm_epoch_12.pt' f, 'x\ny' l, '[{\"node_1\":\"a\",\"node_2\":\"b\",\"edge\":\"e\"}]' j, 'no json' n, ' ' b, array(1.0, 3.0, 3.0) v")
    got = row.select(T.epoch_of(F.col("f")), T.first_line(F.col("l")), F.size(T.json_triples(F.col("j"))), T.json_triples(F.col("n")), T.blank_to_null(F.col("b")), V.argmax(F.col("v"))).first()
    assert list(got)[:3] == [12, "x", 1] and got[4] is None and got[5] == 1
    assert V.kernel_means(11) == pytest.approx([1.0, 0.9, 0.7, 0.5, 0.3, 0.1, -0.1, -0.3, -0.5, -0.7, -0.9])
    assert V.kernel_widths(11) == pytest.approx([1e-4] + [0.1] * 10)
    assert V.kernel_means(1) == [1.0] and V.kernel_widths(1) == [1e-4]


def test_cosine_of_zero_vector_is_null(spark):
    assert spark.sql("select array(0d, 0d) a, array(1d, 0d) b").select(V.cosine(F.col("a"), F.col("b"))).first()[0] is None


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(1, 1000), min_size=2, max_size=40))
def test_codes_are_prefix_free_and_not_below_entropy(counts):
    counts = sorted(counts, reverse=True)
    codes = shannon_fano(counts)
    assert len(set(codes)) == len(codes)
    ordered = sorted(codes)
    assert not any(b.startswith(a) for a, b in zip(ordered, ordered[1:], strict=False))
    total = sum(counts)
    bits = sum(n * len(c) for n, c in zip(counts, codes, strict=True))
    assert bits >= -sum(n * math.log2(n / total) for n in counts) - 1e-6


def test_published_codes_collide():
    assert shannon_fano([4, 2, 1]) == ["0", "10", "11"]
    assert shannon_fano([4, 2, 1], lossless=False) == ["0", "1", "1"]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400))
def test_chunks_fit_and_lose_no_letter(text):
    chunks = recursive_chunks(text, 40, 10)
    assert all(len(c) <= 40 for c in chunks)
    assert Counter(re.sub(r"\s", "", text)) <= Counter(re.sub(r"\s", "", "".join(chunks)))
