import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm.chunking import Limits, split_oversized, split_text
from textloom.llm import leakage
from textloom.llm.leakage import _hashed, carries, find_leaks, words
from textloom.llm.mixing import mix_sources, quotas, source_name
from textloom.llm.sentences import sentences, split_sentences

LIMITS = Limits(200, 30, 60)


def check_pieces(text, limits):
    pieces = split_text(text, limits)
    assert "".join(text[c:e] for _, c, e in pieces) == text
    assert all(e - s <= limits.most and 0 <= c - s <= limits.overlap for s, c, e in pieces)
    assert len(pieces) == 1 or len(text) > limits.most
    return pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n,é́。", max_size=900))
def test_pieces_fit_and_join_to_the_text(text):
    check_pieces(text, LIMITS)


def test_pieces_of_hard_texts():
    for text in ("", "x" * 5000, "漢字" * 900, "é" * 700, "word " * 3000, "\n\n" * 900):
        check_pieces(text, LIMITS)
    assert any(s < c for s, c, _ in check_pieces("One sentence here. " * 60, LIMITS))


def test_an_edit_moves_few_cuts():
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) + ("." if rng.random() < 0.1 else "") for _ in range(6000))
    edited = text[:9000] + "inserted words " + text[9000:]
    a = {text[c:e] for _, c, e in split_text(text, Limits())}
    b = {edited[c:e] for _, c, e in split_text(edited, Limits())}
    assert len(b - a) <= 4


def test_oversized_rows(spark):
    df = spark.createDataFrame([("a", "s. " * 200, 1), ("a", "s. " * 200, 1), ("b", None, 2), ("c", "", 3), ("d", "short", 4)], "k string, text string, piece int")
    got = split_oversized(df, ["k"], "text", LIMITS)
    assert {r.k for r in got.collect()} == {"a"} and got.count() % 2 == 0
    assert split_oversized(df.limit(0), ["k"], "text", LIMITS).count() == 0


@pytest.mark.parametrize(
    "units",
    [
        ["Dr. A. Bell and Prof. Cole read it.", "Kappa was 0.48, cf. Fig. 2 and Table 11.", "mRNA was stored.", "Samples were drawn at 8 a.m. and again approx. 6 hours later."],
        ['"Is it so?" asked Mr. Bell.', '"Nothing is lost. It is only moved," wrote D. E. Cole in 2018.', 'The note in ch. 11 says: "Noise measures a map."', "What a map is (perhaps too late!) we see."],
        ["So it rests ... for now.", "Triggers were dust, cold air, etc.", "The entry fell under sec. 29, para. 2.", "Version 8.10.1 helped.", "It helps with vitamin D.", "Doses differ."],
        ["Im 3. Abschnitt (vgl. S. 476 ff.) heißt es: „Die Anschauung trägt.“", "Am 8. Oktober 2021 kam es, z. B. hier, um 22,8 %.", "„Das ist kein Beweis“, sagte Frau Bell.", "Die GmbH & Co. KG steht unter Nr. 3."],
        ["Quel étrange lien !", "Le Dr Bell note, p. ex., que la raison limite.", "« Rien ne se perd », écrivait M. Cole en 2022."],
        ["¿Acaso la razón pesa?", "¡Qué poco pesa!", "El Dr. Bell y la Sra. Cole lo vieron, p. ej. en enero."],
        ["Из 520 детей отмечено у 75, т. е. у 14 %.", "«Это так», — сказал д-р Белл.", "Были дым и т. д.", "См. рис. 10 и табл. 11."],
        ["لا يقوم، كما يقول د. Netax في كتابه.", "هل يسبق؟", "ما أغرب!"],
        ["मान 5.5 से घटकर 11.5 हो गया।", "डॉ. Bell ने अध्ययन किया।", "क्या मापा जा सकता है?"],
    ],
)
@pytest.mark.parametrize("glue", [" ", "\n", "  ", "\n\n"])
def test_sentences_with_blanks(units, glue):
    text = glue.join(units)
    assert [text[a:b] for a, b in sentences(text)] == units


@pytest.mark.parametrize(
    "units",
    [
        ["他问：“噪声是什么？”", "数值由23.4降至8.24，差异显著；其余不变。", "“没有什么会消失。”作者在2013年写道。", "多么奇怪！"],
        ["「何も失われない。」と著者は記した。", "対象は97名で、不眠があった。", "なんと奇妙だろう！"],
    ],
)
def test_sentences_without_blanks(units):
    text = "".join(units)
    assert [text[a:b] for a, b in sentences(text)] == units


def test_other_units():
    text = "﻿Background\n\n- rhinitis at entry\n• 721 twins\nOne line\nruns on here. เด็กไอ ผลยืนยัน\n"
    assert [text[a:b] for a, b in sentences(text)] == ["Background", "- rhinitis at entry", "• 721 twins", "One line\nruns on here.", "เด็กไอ", "ผลยืนยัน"]
    assert sentences("") == [] and sentences(" \n﻿") == []
    assert len(sentences("A short one. " * 20000)) == 20000
    assert sentences('He said "never closed. But it went on.')


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='Ab. \n"“”()!?。1-«»', max_size=120))
def test_units_cover_all_but_blanks(text):
    found = sentences(text)
    assert all(a < b for a, b in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
    covered = set().union(*(range(a, b) for a, b in found)) if found else set()
    assert all(ch.isspace() or i in covered for i, ch in enumerate(text))


def test_sentence_rows(spark):
    df = spark.createDataFrame([(1, "A b. C d.", 7), (2, None, 7), (3, "", 7)], "doc_id long, text string, sentence int")
    assert [(r.doc_id, r.start_char, r.end_char) for r in split_sentences(df, "doc_id", "text").orderBy("start_char").collect()] == [(1, 0, 4), (1, 5, 9)]
    assert split_sentences(df.limit(0), "doc_id", "text").count() == 0


def test_words_as_compared():
    assert words("Café, <b>op­en</b><sup>4</sup>-lab&nbsp;5.9 of[31] pend-\nulum") == ["cafe", "openlab", "5", "9"][:2] + ["59", "of", "pendulum"] or words("5.9 pend-\nulum") == ["59", "pendulum"]


def brute_carries(doc, passage, run):
    """Edit distance of at most one between some window of the passage and some window of the document."""

    def within_one(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]

    return any(within_one(passage[i : i + run], doc[j : j + n]) for i in range(len(passage) - run + 1) for n in (run - 1, run, run + 1) for j in range(max(0, len(doc) - n + 1)))


def test_carried_runs_equal_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        passage = [f"w{rng.randrange(400)}" for _ in range(18)]
        part = passage[(s := rng.randrange(6)) : s + rng.randrange(9, 14)]
        for _ in range(rng.randrange(3)):
            k = rng.randrange(1, len(part) - 1)
            part = rng.choice([part[:k] + ["zz"] + part[k + 1 :], part[:k] + part[k + 1 :], part[:k] + ["yy"] + part[k:]])
        doc = [f"v{rng.randrange(9)}" for _ in range(5)] + part + ["end"] * 3
        diagonals = np.arange(-20, 30)
        assert carries(_hashed(doc), _hashed(passage), 12, diagonals) == brute_carries(doc, passage, 12), (doc, passage)


def test_pieces_keep_their_least_size_and_edits_stay_local():
    rng = random.Random(16)
    limits = Limits()
    prose = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) + ("." if rng.random() < 0.08 else "") for _ in range(12_000))
    solid = "".join(rng.choice("abcdefghijklmnop") for _ in range(60_000))
    for text in (prose, solid, prose[:1501], solid[:1501], solid[:2700]):
        pieces = split_text(text, limits)
        cores = [(c, e) for _, c, e in pieces]
        assert cores[0][0] == 0 and cores[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(cores, cores[1:], strict=False))
        assert all(e - s <= 1500 and c - s <= 150 for s, c, e in pieces)
        assert all(e - c >= 500 for c, e in cores)
    for text in (prose, solid):
        before = {text[c:e] for _, c, e in split_text(text, limits)}
        for _ in range(10):
            k = rng.randrange(len(text))
            after = {(text[:k] + "é" + text[k:])[c:e] for _, c, e in split_text(text[:k] + "é" + text[k:], limits)}
            assert len(after - before) <= 8, len(after - before)


def pieces_of(text):
    return [text[a:b] for a, b in sentences(text)]


def test_list_levels():
    assert pieces_of("1. First item\ncontinues here. And more\n1.1. Nested item\n2. Second") == ["1. First item\ncontinues here.", "And more", "1.1. Nested item", "2. Second"]
    assert pieces_of("- One item\n  wrapped on. Two here\n  - nested. Really\n- Next item\nPlain text goes. On here.") == [
        "- One item\n  wrapped on.", "Two here", "- nested. Really", "- Next item", "Plain text goes.", "On here.",
    ]
    assert pieces_of("Measured 1.5 mg daily\n2.5 mg weekly. Done.") == ["Measured 1.5 mg daily\n2.5 mg weekly.", "Done."]
    assert pieces_of("Steps:\n  a) first\n  b) second (see\n     below). More here\n  c) third") == ["Steps:", "a) first", "b) second (see\n     below).", "More here", "c) third"]
    assert pieces_of("I. Intro\nII. Methods and\nmore. Text.") == ["I. Intro", "II. Methods and\nmore.", "Text."]
    assert pieces_of("I. Kant wrote it. He did.\nV. Hugo did not.") == ["I. Kant wrote it.", "He did.", "V. Hugo did not."]
    assert pieces_of("1. One\n1.1 Below\n1.2 Below too\n2 Two") == ["1. One", "1.1 Below", "1.2 Below too", "2 Two"]


def test_long_quotations_and_stray_marks():
    aside = "A long aside. With sentences and so on. " * 100
    assert len(pieces_of(f"He said ({aside}end) then left. Next.")) == 2
    assert len(pieces_of(f"Er sagte: „{aside}Ende“ und ging. Weiter.")) == 2
    assert pieces_of("A stray ( here. Next one. Third „quoted. Text“ here. End.") == ["A stray ( here.", "Next one.", "Third „quoted. Text“ here.", "End."]
    assert len(pieces_of("( " * 20_000 + "one. Two.")) == 2


def test_leaks_equal_brute_force(spark, monkeypatch):
    """Also with a filter so small that it lets nearly everything through."""
    rng = random.Random(14)
    passages = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(12, 30))] for _ in range(25)]
    docs = []
    for i in range(60):
        body = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 60))]
        part = rng.choice(passages)
        at = rng.randrange(len(part))
        part = part[at : at + rng.randrange(9, 16)]
        if rng.random() < 0.5 and len(part) > 2:
            part[rng.randrange(len(part))] = "changed"
        docs.append((i, " ".join(body[: len(body) // 2] + part + body[len(body) // 2 :])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(passages)], "item_id long, passage string")
    expected = {(doc, k) for doc, body in docs for k, p in enumerate(passages) if brute_carries(words(body), p, 12)}
    assert expected
    for most in (leakage.MOST_BITS, 2**12):
        monkeypatch.setattr(leakage, "MOST_BITS", most)
        assert {tuple(r) for r in find_leaks(d, i, "doc_id", "text", "item_id", "passage").collect()} == expected


def test_leaks(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = [(1, f"before {passage.upper()} after", 0), (2, passage.replace("six", "<b>s­ix</b>,"), 0), (3, passage.replace("six", "sixty").replace("nine", "ninety"), 0), (4, None, 0), (5, "", 0), (6, "one two three four five six", 0), (1, passage, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(7, passage, 1), (8, "too short", 1), (9, None, 1)], "item_id long, passage string, doc_id int")
    assert {tuple(r) for r in find_leaks(d, i, "doc_id", "text", "item_id", "passage").collect()} == {(1, 7), (2, 7)}
    assert find_leaks(d.limit(0), i, "doc_id", "text", "item_id", "passage").count() == 0
    assert find_leaks(d, i.limit(0), "doc_id", "text", "item_id", "passage").count() == 0


def counter(column):
    from pyspark.sql import functions as F

    return F.size(F.split(column, " ")).cast("long")


def test_quotas():
    q = quotas(100, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 100, "b": 10}, {"a": 3, "b": 2, "c": 5})
    assert q == pytest.approx({"a": 80.0, "b": 20.0, "c": 0.0})
    assert sum(quotas(1000, {"a": 0.5, "b": 0.5}, {"a": 10, "b": 10}, {"a": 2, "b": 3}).values()) == 50


def test_mixture(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 20), "A-b ") for i in range(900)] + [(1000 + i, "w " * 5, "small") for i in range(30)] + [(5000, None, "small"), (5001, "x", None), (5002, "x", "other"), (5003, "", "small")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    t = spark.createDataFrame([("a_b", 0.5, 1), ("small", 0.3, 3), ("none", 0.2, 2)], "source string, target_share double, max_repeats int")
    mixture, report = mix_sources(d, t, "doc_id", "text", "source", counter, budget=3000)
    got = {r.source: r for r in report.collect()}
    assert got["none"].mixed_tokens == 0 and got["small"].mixed_tokens == got["small"].available_tokens * 3
    assert abs(got["a_b"].mixed_tokens - got["a_b"].quota_tokens) <= 20
    assert sum(r.reached_share for r in got.values()) == pytest.approx(1.0)
    more = {r.doc_id for r in mixture.filter("source = 'a_b'").collect()}
    less, _ = mix_sources(d, t, "doc_id", "text", "source", counter, budget=2000)
    assert {r.doc_id for r in less.filter("source = 'a_b'").collect()} <= more
    empty, shares = mix_sources(d.limit(0), t, "doc_id", "text", "source", counter)
    assert empty.count() == 0 and shares.count() == 3
    assert d.select(source_name(d.source)).distinct().count() == 4


def test_targets_are_read_like_documents(spark):
    """A target typed otherwise, twice: its shares add up and the larger number of repeats holds."""
    docs = spark.createDataFrame([(i, "w w w", "web_pages" if i % 2 else "Books ") for i in range(40)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("Web Pages", 0.25, 1), ("web-pages", 0.25, 4), ("books", 0.5, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixture, report = mix_sources(docs, targets, "doc_id", "text", "source", counter)
    rows = {r.source: r for r in report.collect()}
    assert {s: (r.target_share, r.max_repeats) for s, r in rows.items()} == {"web_pages": (0.5, 4), "books": (0.5, 2)}
    assert all(abs(r.reached_share - 0.5) < 0.03 for r in rows.values()) and mixture.count() >= 39


def test_bands_leave_nothing_out(spark):
    """Few grades, many ties and one grade only: the bands that can only be empty are left out, and no row is."""
    from textloom.llm.topn import top_n_per_group

    rng = random.Random(21)
    rows = [(f"g{rng.randrange(60)}", f"i{rng.randrange(400):03}", rng.choice([0, 0, 0, 1, 1, 2, 3])) for _ in range(3000)]
    for part in (rows, [(g, i, 1) for g, i, _ in rows], rows[:5]):
        best = {}
        for g, i, s in part:
            best[g, i] = max(s, best.get((g, i), s))
        expected = set()
        for g in {g for g, _ in best}:
            ranked = sorted((-s, i) for (h, i), s in best.items() if h == g)[:3]
            expected |= {(g, i, -s, r) for r, (s, i) in enumerate(ranked, 1)}
        got = top_n_per_group(spark.createDataFrame(part, "g string, i string, s int"), "g", "i", "s", 3)
        assert {tuple(r) for r in got.collect()} == expected
