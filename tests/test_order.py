import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.plans import order
from textloom.plans.scratch import Scratch
from textloom.sources import readers, sinks
from textloom.sources.feeds import page_text


@pytest.fixture
def wide(spark):
    """Adaptive execution would join the few rows of a test in one partition."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_without_gaps(wide):
    rows = [(f"k{i % 7}", i) for i in range(500)]
    random.Random(1).shuffle(rows)
    df = wide.createDataFrame(rows, "k string, v int")
    got = order.numbered(df, [F.col("k"), F.col("v").desc()], "n", 0).collect()
    assert [(r.k, r.v) for r in sorted(got, key=lambda r: r.n)] == sorted(rows, key=lambda r: (r[0], -r[1]))
    assert sorted(r.n for r in got) == list(range(500))
    assert order.numbered(df.limit(0), [F.col("k")]).count() == 0


def test_a_hot_group_is_summed_by_many_tasks(wide):
    rng = random.Random(2)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", i, rng.randrange(5)) for i in range(900)] + [(None, 5000, 1), (None, 5001, 2)]
    df = wide.createDataFrame(rows, "g string, i int, v int")
    placed = order._placed(df, [F.col("g"), F.col("i")])
    assert placed.filter("g = 'hot'").select("__part").distinct().count() >= 2
    expected, total = {}, defaultdict(int)
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        total[g] += v
        expected[g, i] = total[g]
    got = order.running(df, ["g"], [F.col("i")], F.col("v"), "sum").collect()
    assert {(r.g, r.i): r["sum"] for r in got} == expected and len(got) == len(rows)


def test_a_large_key_is_met_by_many_keys(spark, monkeypatch):
    monkeypatch.setattr(order, "LARGE", 10)
    rows = [("large", i) for i in range(30)] + [("small", i) for i in range(3)] + [(None, 1)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = Counter(tuple(r) for r in order.met(df, "k", {"v": "a"}, {"v": "b"}).collect())
    assert got == Counter((k, a, b) for k, a in rows for l, b in rows if k == l and k)


def test_escaped_files_keep_everything(spark):
    rows = [("a\tb", "x\ny\r\n", 1), ("\\n", "\\\\n\\", 2), (None, "", 3), ('"quoted", "twice"', " blanks ", None), ("\\N", "N", 5), (",", "\n\n", 6)]
    df = spark.createDataFrame(rows, "a string, b string, n int")
    path = Scratch(spark, "t").path("rows.csv")
    for sep in ",\t|":
        sinks.write_delimited(df, path, sep, escaped=True)
        assert sorted(map(tuple, readers.read_delimited(spark, path, "a string, b string, n int", sep, header=True, escaped=True).collect()), key=repr) == sorted(rows, key=repr)


def test_lines_stay_in_the_order_of_files(spark, tmp_path):
    for k, size in enumerate((3, 40, 1)):  # splits are read by size
        (tmp_path / f"part-{k}.txt").write_text("".join(f"q {'Q0'} d{k}-{i:02} {i} 0.5 run\n" for i in range(size)))
    got = readers.read_ranking(spark, f"file://{tmp_path}").orderBy("rank").collect()
    assert [r.docid for r in got] == [f"d{k}-{i:02}" for k, size in enumerate((3, 40, 1)) for i in range(size)]
    (tmp_path / "v").mkdir()
    for k in range(3):
        (tmp_path / "v" / f"{k}.txt").write_text("".join(f"t{k}{i} {i}.5 2\n" for i in range(4 - k)))
    got = readers.read_vectors(spark, f"file://{tmp_path}/v", 2).orderBy("id").collect()
    assert [r.token for r in got] == [f"t{k}{i}" for k in range(3) for i in range(4 - k)] and [r.id for r in got] == list(range(1, 10))


def test_article_feed_reads_a_folder_a_day(spark, tmp_path):
    from textloom.sources.feeds import register_feeds

    register_feeds(spark)
    for day, titles in (("2020-01-01", ["Asthma a", "asthma b", "other"]), ("2020-01-03", ["Asthma c"]), ("2020-02-01", ["asthma late"])):
        (tmp_path / f"day={day}").mkdir()
        (tmp_path / f"day={day}" / "part.json").write_text("".join(f'{{"pubmed_id": "1", "title": "{t}", "authors": null}}\n' for t in titles))
    feed = spark.read.format("article_feed").option("path", str(tmp_path)).option("start", "2020-01-01").option("end", "2020-01-31").option("term", "asthma")
    assert sorted(r.title for r in feed.load().collect()) == ["Asthma a", "Asthma c", "asthma b"]
    assert sorted(r.title for r in feed.option("max_results", "1").load().collect()) == ["Asthma a", "Asthma c"]


def test_page_text():
    assert page_text("<head><title>t</title></head><p>a &lt;b&gt;\n c<script>x()</script></p><p>d</p>") == "a <b> c d"


def test_folders_are_cleared(spark):
    from textloom.plans.scratch import clear

    scratch = Scratch(spark, "t")
    scratch.write(spark.range(3).toDF("n"), "rows")
    scratch.save("note", "é")
    assert scratch.load("note") == "é" and scratch.load("other") is None
    clear(spark)
    assert scratch.load("note") is None
