import json
import sqlite3
import sys

import pytest
from pyspark.sql import functions as F

from textloom.operators import catalog
from textloom.sources import feeds, readers, sinks
from textloom.streaming import backfill


def test_qrels_and_rankings(spark, tmp_path):
    path = tmp_path / "qrels.txt"
    path.write_text("q Q0 a 1\n\nq  Q0\tb 0\nq Q0 a 2\nr Q0 c 0.00001\n", encoding="utf-8")
    assert {(r.qid, r.docid): r.grade for r in readers.read_qrels(spark, str(path)).collect()} == {("q", "a"): 2.0}
    path.write_text("q Q0 a\n")
    with pytest.raises(Exception, match="malformed"):
        readers.read_qrels(spark, str(path)).collect()
    ranks = tmp_path / "run.txt"
    ranks.write_text("q b x y\nq a x y\nr c x y\n")
    assert [(r.qid, r.docid, r["rank"]) for r in readers.read_ranking(spark, str(ranks)).orderBy("qid", "rank").collect()] == [("q", "b", 1), ("q", "a", 2), ("r", "c", 1)]
    ranks.write_text("q b x\n")
    with pytest.raises(Exception, match="malformed"):
        readers.read_ranking(spark, str(ranks)).collect()


def test_field_counts_are_checked(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("a\tb\tc\n\nd\te\tf\n")
    assert readers.read_fields(spark, str(path), readers.TRIPLES).count() == 2
    path.write_text("a\tb\n")
    with pytest.raises(Exception, match="wrong number"):
        readers.read_fields(spark, str(path), readers.TRIPLES).collect()


def test_checkpoints_vectors_and_latest(spark, tmp_path):
    assert readers.read_checkpoint(spark, str(tmp_path / "none"), "a int").count() == 0
    files = spark.createDataFrame([("knrm_epoch_2.pt",), ("knrm_epoch_10.pt",), ("tk_epoch_99.pt",)], "f string")
    assert readers.latest_checkpoint(files, "f", "knrm").first().file == "knrm_epoch_10.pt"
    assert readers.latest_checkpoint(files, "f", "bert").count() == 0
    (tmp_path / "v.txt").write_text("cat 0.5 1\ndog 2 3\n")
    assert [(r.token, r.id, list(r.vector)) for r in readers.read_vectors(spark, str(tmp_path / "v.txt"), 2).orderBy("id").collect()] == [("cat", 1, [0.5, 1.0]), ("dog", 2, [2.0, 3.0])]


def test_sqlite_and_feeds(spark, tmp_path):
    with sqlite3.connect(tmp_path / "x.db") as c:
        c.execute("create table t (id int, name text)")
        c.executemany("insert into t values (?, ?)", [(1, "a"), (2, None)])
    rows = readers.read_sqlite(spark, str(tmp_path / "x.db"), "select id, name from t where id > 0 limit 5", "id long, name string").collect()
    assert sorted(rows) == [(1, "a"), (2, None)]
    lines = [{"pubmed_id": str(i), "title": f"Asthma {i}", "publication_date": f"2020-01-0{i}", "authors": "A"} for i in range(1, 5)]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, lines)))
    feeds.register_feeds(spark)
    feed = spark.read.format("article_feed").option("path", str(tmp_path / "a.json")).option("term", "asthma").option("start", "2020-01-02").option("end", "2020-01-03").load()
    assert sorted(r.pubmed_id for r in feed.collect()) == ["2", "3"]
    (tmp_path / "p.json").write_text(json.dumps({"title": "T", "html": "<p>a <b>b</b></p>"}))
    assert spark.read.format("page_feed").option("path", str(tmp_path / "p.json")).load().first().body == "a b"


def test_sinks(spark, tmp_path):
    sent = spark.sparkContext.accumulator(0)
    sinks.send_rows(spark.range(7), lambda rows: sent.add(len(rows)), batch=3)
    assert sent.value == 7
    metrics = spark.createDataFrame([("MRR", 0.5)], "metric string, value double")
    sinks.write_metrics(metrics, str(tmp_path / "m"), "t")
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()][1] == "MRR: 0.5"


def test_tables(spark):
    spark.sql("DROP TABLE IF EXISTS demo_people")
    names = catalog.ensure_rows(spark, "demo_people", "id int, name string, age int", [(1, "a", 3), (2, "b", 4)])
    assert "demo_people" in {r.tableName for r in names.collect()}
    assert spark.table("demo_people").count() == 2
    assert sinks.replace_table(spark.range(3).toDF("x"), "demo_replaced").count() == 3
    with pytest.raises(Exception, match="missing_table"):
        catalog.first_column(spark, "select x from missing_table").collect()
    for t in ("demo_people", "demo_replaced"):
        spark.sql(f"DROP TABLE {t}")


def test_resumed_work_runs_each_key_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def work(batch):
        return batch.withColumn("answer", F.upper("k"))

    spark.createDataFrame([("a",), ("b",), ("a",)], "k string").write.parquet(src)
    backfill.resumed(spark, src, "k string", out, state, ["k"], work)
    spark.createDataFrame([("b",), ("c",)], "k string").write.mode("append").parquet(src)
    backfill.resumed(spark, src, "k string", out, state, ["k"], work)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_event_windows_on_a_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    stream = backfill.event_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("ev_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("ev_out").agg(F.sum("n")).first()[0] == events.count()


def test_works_without_the_training_subpackage():
    import subprocess
    from pathlib import Path

    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('textloom.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "print(len(e.queries()), any(k.startswith('p1_') for k in e.queries()), 'p3_found' in e.queries())"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert done.stdout.split()[1:] == ["False", "True"], done.stderr
