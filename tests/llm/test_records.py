import random

import numpy as np
import pyarrow as pa

from textloom.llm.components import connected_components
from textloom.llm.consensus import consensus
from textloom.llm import components
from textloom.llm import consensus as consenting
from textloom.llm import history as histories
from textloom.llm.history import History, _described, _two_edits, deduplicate_batches, doi_key, pubmed_key, title_key
from textloom.llm import names as linking
from textloom.llm.names import alignment, assigned, link_names, linked_pairs, parse
from textloom.plans.scratch import Scratch


def test_components_equal_union_find(spark, monkeypatch):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5), (None, 1)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "u long, v long")
    for few in (components.FEW, 0):
        monkeypatch.setattr(components, "FEW", few)
        got = {r.node: r.component for r in connected_components(df, Scratch(spark, "t"), "cc").collect()}
        assert got == {a: find(a) for a in parent}
    assert connected_components(df.limit(0), Scratch(spark, "t"), "cc").count() == 0


JUDGED = "userId string, queryId string, documentId string, relevanceLevel string, judged_at long, loaded_at long, level int"


def judged(spark, rows):
    return consensus(spark.createDataFrame(rows, JUDGED), ["queryId", "documentId"], "userId", "relevanceLevel", "judged_at", "loaded_at", rounds=3)


def test_consensus(spark):
    rng = random.Random(7)
    rows, truth = [], {}
    for i in range(120):
        truth[f"q{i}"] = t = rng.randrange(4)
        for u in range(4):
            rows.append((f"good{u}", f"q{i}", "d", f" {t if rng.random() < 0.85 else rng.randrange(4)}_x", 1, 1, 0))
        rows.append(("turned", f"q{i}", "d", str(3 - t), 1, 1, 0))
        rows.append(("dice", f"q{i}", "d", str(rng.randrange(4)), 1, 1, 0))
    rows += [("good0", "q0", "d", "0", 0, 9, 0), ("good0", "q0", "d", "skip", 5, 5, 0), (None, "q0", "d", "1", 1, 1, 0), (" ", "q0", "d", "1", 1, 1, 0), ("u", None, "d", "1", 1, 1, 0), rows[0], ("solo", "only", "d", "2 partial", None, None, 0)]
    items, users = judged(spark, rows)
    got = {r.queryId: r for r in items.collect()}
    assert sum(got[q].level == t for q, t in truth.items()) >= 114
    assert got["only"].level == 2 and got["only"].agreement is None and got["only"].n_users == 1 and got["q0"].n_users == 6
    rel = {r.userId: r.reliability for r in users.collect()}
    assert rel["good0"] > rel["dice"] > rel["turned"] and None not in rel
    items, users = judged(spark, [("u", "q", "d", "?", 1, 1, 0)])
    assert items.count() == 0 and users.count() == 0


def test_consensus_by_joins_is_the_same(spark, monkeypatch):
    rng = random.Random(15)
    rows = [(f"u{u}", f"q{i}", f"d{i % 3}", str(rng.choice([i % 4, i % 4, rng.randrange(4)])), 1, 1, 0) for i in range(60) for u in range(5) if rng.random() < 0.8]

    def fitted():
        items, users = judged(spark, rows)
        return {(r.queryId, r.documentId): r for r in items.collect()}, {r.userId: r for r in users.collect()}

    items, users = fitted()
    monkeypatch.setattr(consenting, "MOST_USERS", 0)
    monkeypatch.setattr(consenting, "AT_ONCE", 7)
    joined_items, joined_users = fitted()
    assert items.keys() == joined_items.keys() and users.keys() == joined_users.keys()
    for k, r in items.items():
        o = joined_items[k]
        assert (r.level, r.n_users, r.agreement) == (o.level, o.n_users, o.agreement) and abs(r.confidence - o.confidence) < 1e-9 and abs(r.tilt - o.tilt) < 1e-9
    for k, r in users.items():
        assert r.n_items == joined_users[k].n_items and abs(r.reliability - joined_users[k].reliability) < 1e-9 and r.accuracy == joined_users[k].accuracy
    # hard items tilt: the weights of items follow the number of their answers
    assert max(r.tilt for r in items.values()) > 0.1
    monkeypatch.undo()
    monkeypatch.setattr(consenting, "AT_ONCE", 7)
    few, _ = fitted()
    assert all(abs(few[k].confidence - r.confidence) < 1e-9 for k, r in items.items())


ARTICLE = "id long, fetch_batch int, pubmed_id string, doi string, title string, held_id int"
LONG = "Effect of nasal rinsing on cough score in Bellum among 24 twins"


def test_keys(spark):
    df = spark.createDataFrame([(" PMID:0012345\n99", "https://x.y/10.99120/Al.1 ", "<i>Eff</i>ect &amp; β-agonist‐Test."), ("NA", "10.0000/pending", None), ("0", "n/a", " ")], "p string, d string, t string")
    got = df.select(pubmed_key(df.p), doi_key(df.d), title_key(df.t)).collect()
    assert [tuple(r) for r in got] == [("12345", "10.99120/al.1", "effect and beta agonist test"), (None, None, ""), (None, None, "")]


def test_batches(spark):
    rows = [
        (1, 1, "123456", "10.99120/a.1", LONG), (2, 1, None, None, LONG.upper()), (3, 2, "NA", "10.99120/A.1", None), (4, 2, "999999", "10.99120/b.2", LONG),
        (5, 3, None, None, "Erratum to: " + LONG), (6, 3, None, None, LONG.replace("rinsing", "rinsnig")), (7, 3, None, None, LONG + ", part I"), (8, 3, None, None, "Editorial"),
        (9, 4, None, None, "Editorial"), (10, 4, "PMID:0123456", None, None), (11, 4, None, None, None), (12, 4, None, None, LONG[:40] + "..."), (13, None, "123456", None, "x"),
        (14, 4, None, None, "Erratum to: " + LONG + "."), (15, 4, None, None, LONG.replace("24", "25")), (None, 4, "123456", None, LONG),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], ARTICLE)
    expected = {2: 1, 3: 1, 6: 1, 9: None, 10: 1, 12: 1, 13: 1, 14: 5}
    for together in (1, 32):
        got = {r.id: r.held_id for r in deduplicate_batches(df, "id", "fetch_batch", "pubmed_id", "doi", "title", together).collect()}
        assert got == {i: expected.get(i) for i in range(1, 16)}
    assert deduplicate_batches(df.limit(0), "id", "fetch_batch", "pubmed_id", "doi", "title").count() == 0


def test_two_edits():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(9)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(9)))
        b = "".join(rng.choice("abc") for _ in range(rng.randrange(9))) if rng.random() < 0.3 else a[: rng.randrange(9)] + rng.choice(["", "a", "bc"]) + a[rng.randrange(9) :]
        assert _two_edits(a, b) == (distance(a, b) <= 2)


def test_every_batch_is_decided_by_itself(spark):
    """B is accepted before C, which joins it to A, is known; a later row that meets only B gets A, the lowest id of all three."""
    rows = [(1, 1, "123456", None, None), (2, 1, None, None, LONG), (3, 2, None, "10.99120/x.1", LONG + " again"), (4, 3, "123456", "10.99120/x.1", None), (5, 4, None, None, LONG), (6, 4, "777777", None, None), (7, 5, None, None, LONG + " again")]
    df = spark.createDataFrame([(*r, 0) for r in rows], ARTICLE)
    for together in (1, 2, 9):
        got = {r.id: r.held_id for r in deduplicate_batches(df, "id", "fetch_batch", "pubmed_id", "doi", "title", together).collect()}
        assert got == {1: None, 2: None, 3: None, 4: 1, 5: 2, 6: None, 7: 1}


def test_a_history_is_opened_again(spark, tmp_path):
    def told(rows):
        return _described(spark.createDataFrame([(*r, 0) for r in rows], ARTICLE), "id", "fetch_batch", "pubmed_id", "doi", "title")

    path = f"file://{tmp_path}/held"
    History(spark, path).ingest(told([(1, 1, "123456", None, LONG), (2, 1, None, "10.99120/b.1", "Another " + LONG)]))
    got = History(spark, path).ingest(told([(3, 2, None, None, LONG.upper()), (4, 2, None, "10.99120/b.1", None)])).collect()
    assert {r.id: r.held_id for r in got} == {3: 1, 4: 2}
    again = History(spark, path)
    assert again.state["commit"] == 2 and len(again.state["runs"]) == 2
    got = deduplicate_batches(spark.createDataFrame([(5, 3, None, None, LONG, 0)], ARTICLE), "id", "fetch_batch", "pubmed_id", "doi", "title", path=path).collect()
    assert [(r.id, r.batch, r.held_id) for r in got] == [(5, 3, 1)]


def test_runs_are_compacted_and_ranged(spark, monkeypatch):
    monkeypatch.setattr(histories, "RANGE_KEYS", 20)
    rng = random.Random(8)
    titles = [" ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(5)) for _ in range(60)]
    store = History(spark)
    for b in range(5):
        part = spark.createDataFrame([(100 * b + k, b, None, None, t if b != 1 else t + ".", 0) for k, t in enumerate(titles)], ARTICLE)
        got = store.ingest(_described(part, "id", "fetch_batch", "pubmed_id", "doi", "title")).collect()
        assert {r.id: r.held_id for r in got} == {100 * b + k: None if b == 0 else k for k in range(60)}
    assert store.state["bounds"]["title"] and store.state["compacted"] and len(store.state["runs"]) <= 4


def test_numbers_rule_out_most_pairs(monkeypatch):
    rng = random.Random(12)
    rows = []
    for node in range(2000):
        t = f"wheeze and eczema in children of {rng.choice('abcdefgh')}olufan after winter"
        rows.append((f"{t}{histories._TIE}{node:019d}", node, histories.HELD if node % 3 else node % 7, None, None if node % 50 == 0 else str(node), None, t, False, "||"))
    names = ["key", "node", "at", "cls", "p", "d", "t", "cut", "mark"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    table = table.append_column("kind", pa.array(["title"] * 2000)).append_column("range", pa.array([0] * 2000, pa.int32()))
    met, asked = histories._met, []
    monkeypatch.setattr(histories, "_met", lambda kind, a, b: asked.append((a, b)) or met(kind, a, b))
    links = histories._range_links(False)(table).to_pylist()
    # own numbers that differ are never one article: only rows without one are looked at, 16 times each
    assert 0 < len(asked) < 16 * 2 * 50
    own = {node: p for _, node, _, _, p, *_ in rows}
    assert links and all(own[x["a"]] is None or own[x["b"]] is None for x in links)


def test_commits_and_ranges_change_no_decision(spark, monkeypatch):
    rng = random.Random(10)
    stems = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(6)) for _ in range(25)]
    rows = []
    for i in range(240):
        k = rng.randrange(25)
        title = stems[k] if rng.random() < 0.7 else stems[k][:20] + rng.choice("xyz") + stems[k][21:]
        own = rng.random() < 0.8
        rows.append((i, i // 20, str(30_000 + k) if own and rng.random() < 0.6 else None, f"10.99120/k.{k}" if own and rng.random() < 0.6 else None, title if rng.random() < 0.8 else None, 0))
    # one number that a third of the rows hold, and fill ranges with
    rows += [(1000 + i, i // 10, "99", None, f"{stems[0]} and number {i}", 0) for i in range(120)]
    df = spark.createDataFrame(rows, ARTICLE)
    one = None
    for keys, together in ((10_000, 99), (40, 5), (40, 99)):
        monkeypatch.setattr(histories, "RANGE_KEYS", keys)
        got = {r.id: r.held_id for r in deduplicate_batches(df, "id", "fetch_batch", "pubmed_id", "doi", "title", together).collect()}
        one = one or got
        assert got == one
    assert all(got[1000 + i] == 1000 for i in range(1, 120))


def test_parsed_names():
    assert parse("van der Bell, Anna-Lena") == (False, 0, ["vander~bell", "anna-lena"], "")
    assert parse("A.-L. van dder Bell")[2:] == (["vandder~bell"], "al")
    assert parse('Bell William "Bill"')[2:] == (["bell", "william"], "")
    assert parse("The WG on Bell Allergy") == (True, -1, ["working", "group", "bell", "allergy"], "")
    for same in ("van derBell Anna", "van de rBell Anna", "VAN DER BELL Anna", "v.d. Bell Anna", "vd Bell, Anna", "Bell, Anna van der"):
        got = parse(same)
        assert got[1] == 0 and [t.replace("~", "") for t in got[2]] == ["vanderbell", "anna"]
    assert parse("Ludwig van Beethoven") == (False, 1, ["ludwig", "van~beethoven"], "")
    assert alignment(["a1b2c", "x"], ["xyz", "a1b2c"]) < 1 < 9 <= alignment(["abcde"], ["vwxyz"])


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for n, m in [(1, 1), (2, 4), (4, 4), (5, 6), (6, 6)] * 4:
        costs = rng.integers(0, 9, (n, m)).astype(float)
        got = assigned(costs)
        assert len(set(got)) == n
        assert sum(costs[i, j] for i, j in enumerate(got)) == min(sum(costs[i, j] for i, j in enumerate(p)) for p in permutations(range(m), n))
    long = [f"word{i}" for i in range(20)]
    assert alignment(long, long[::-1]) == 0 and alignment(["wrod3", *long[:3], *long[4:]], long) == 1


SAME = [
    ("Lopez, Maria Anna", "Lopez, Anna Maria"), ("Chen, Weiming", "Chne, Weiming"), ("Wang, Jianhua", "Wnag, Jianhua"), ("Wells, Catherine", "Wells, Katherine"),
    ("Meyerhof, Bert", "Meyerhof, Albert"), ("tre Borgmann, Anna", "ter Borgmann, Anna"), ("Smithson, John Robert", "Smithson, John R."), ("Dahlen, Karl-Otto", "Dahlen, Karl O."),
    ("Hillman, Bob James", "Hillman, Robert James"), ("Al Sayed, Omar", "Al-Sayed, Omar"), ("García López, María", "Garcia Lopez, Maria"), ("Lundberg, Marialuz", "Lundberg, Maria-Luz"), ("Ek Forest Sleep Registry Study Group of the Western Coast and Northern Hills of Old Land", "Ek Forest Sleep Registry Study Group of the Western Caost and Northern Hills of Old Land"),
]
OTHER = [("Zorn, Anna", "Zorn, Susanna"), ("Falk, Anna", "Falk, Anna-Lena"), ("Cheng, Wei", "Chen, Wei"), ("Moorland, Kim", "Moorland, Tim"), ("Bramwell, Sanna", "Bramwell, Anna"), ("Corbusch, John R.", "Corbusch, John Q.")]


def test_spellings_of_every_kind(spark):
    df = spark.createDataFrame([(n,) for pair in SAME + OTHER for n in pair], "val string")
    got = {r.val: r.class_id for r in link_names(df, "val").collect()}
    assert [p for p in SAME if got[p[0]] != got[p[1]]] == [] and [p for p in OTHER if got[p[0]] == got[p[1]]] == []


def test_deletes_of_tokens_are_never_broadcast(spark, tmp_path):
    path = str(tmp_path / "tokens")
    spark.createDataFrame([(f"token{k}",) for k in range(300)], "token string").coalesce(1).write.parquet(path)
    near = linking.near_tokens(spark.read.parquet(path))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    got = {(r.a, r.b) for r in near.collect()}
    words = [f"token{k}" for k in range(300)]
    assert got == {(a, b) for a in words for b in words if a != b and linking.near_words(a, b)}


def test_an_initial_joins_only_what_it_fits(spark):
    names = ["Arkwright, John R.", "Arkwright, John Robert", "Bexhill, John R.", "Bexhill, John Robert", "Bexhill, John Rupert", "Colmore, J.", "Colmore, James", "Colmore, John", "Dunmore, J.", "Dunmore, John"]
    got = {r.val: r.class_id for r in link_names(spark.createDataFrame([(n,) for n in names], "val string"), "val").collect()}
    assert len({got[n] for n in names}) == 8 and got[names[0]] == got[names[1]] and got[names[8]] == got[names[9]]


def test_hot_surname_is_salted_and_generated_typos_are_found(spark, monkeypatch):
    monkeypatch.setattr(linking, "HOT", 5)
    rng = random.Random(12)
    stems = sorted({"".join(rng.choice("brtkslmn") + rng.choice("aeiou") for _ in range(4)) for _ in range(330)})[:300]
    rng.shuffle(stems)
    rows, wanted = [], []
    for i, given in enumerate(stems):
        surname = "Wangford" if i % 3 == 0 else stems[(i * 7 + 3) % 300].title() + "berg"
        name = f"{surname}, {given.title()}"
        k = rng.randrange(1, len(given) - 1)
        typo = rng.choice([given[:k] + given[k + 1 :], given[1] + given[0] + given[2:], given[:k] + given[k + 1] + given[k] + given[k + 2 :], given[:k] + rng.choice("xyz") + given[k:]])
        other = rng.choice([f"{given.title()} {surname}", f"{surname}, {typo.title()}", f"{surname.upper()} {typo.title()}"])
        rows += [(name,)] * 3 + [(other,)]
        wanted.append((name, other))
    got = {r.val: r.class_id for r in link_names(spark.createDataFrame(rows, "val string"), "val").collect()}
    assert sum(got[a] == got[b] for a, b in wanted) >= 0.95 * len(wanted)
    assert len({got[a] for a, _ in wanted}) >= 0.98 * len(wanted)


def test_linked_names(spark):
    classes = [
        ["Stefavedez Michael", "Stefvaedez Michael", "STEFAVEDEZ Michael", "Stefavedez, Michael", "M. Stefavedez", "Michael Q. Stefavedez", "Mick Stefavedez", "Stefavedez Michael, MD"],
        ["Stefavedez Karin", "Stefavedez K"], ["van der Gärafoberg Maria-Luz", "v.d. Garafoberg M.-L.", "Gaerafoberg Maria Luz"],
        ["Botrufamoor Airway Cohort Study Group", "The Botrufamoor Airway Cohort Study Grp.", "BOTRUFAMOOR AIRWAY COHORT STUDY GROUP"], ["Working Group on Bell Allergy", "WG on Bell Allergy"],
        ["Lone Wolfgang"],
    ]
    rows = [(n, i, 0) for i, c in enumerate(classes) for n in c for _ in range(6 if n == c[0] else 1)]
    rows += [(f"{s} {g}", 9, 0) for s in ("Zukedrokyan", "Hanikalotti", "Pubistumark", "Trozikemoor") for g in ("Michael", "Karin", "Maria-Luz", "Anna")] + [(None, 9, 0), ("  ", 9, 0)]
    df = spark.createDataFrame(rows, "val string, c int, class_id int")
    got = link_names(df, "val")
    pairs = {(r.name_1, r.name_2) for r in linked_pairs(got, "val").collect()}
    assert pairs == {(a, b) for c in classes for a in c for b in c if a < b}
    assert link_names(df.limit(0), "val").count() == 0
