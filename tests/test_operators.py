import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom import registry
from textloom.operators import chaos, entities, extraction, graph, judgements, qa, ranking, topics

registry.load()
QUERIES = registry.QUERIES


def test_ties_go_to_the_reliable_judge(spark):
    rows = [(u, f"q{i}", "d", i % 4) for u in ("good", "g2", "g3", "g4", "g5") for i in range(8)] + [("bad", f"q{i}", "d", 3 - i % 4) for i in range(8)]
    rows += [("good", "t", "d", 1), ("bad", "t", "d", 2)]
    df = spark.createDataFrame(rows, "userId string, queryId string, documentId string, level int")
    r2 = {r.userId: r.r2 for r in judgements.reliability(df).collect()}
    assert r2["good"] > r2["bad"]
    assert judgements.aggregate_judgements(df).filter("queryId = 't'").first().relevanceLevel == 1


def test_judge_without_variance_has_no_weight(spark):
    df = spark.createDataFrame([("u", "a", "d", 1), ("v", "a", "d", 2)], "userId string, queryId string, documentId string, level int")
    assert {r.r2 for r in judgements.reliability(df).collect()} == {0.0}
    assert judgements.aggregate_judgements(df).first().relevanceLevel is None


def test_contextual_proximity_counts_and_symmetry(spark):
    edges = spark.createDataFrame([("a", "b", "c1"), ("a", "c", "c1"), ("b", "a", "c1"), ("a", "b", "c2")], "node_1 string, node_2 string, chunk_id string")
    got = {(r.node_1, r.node_2): r["count"] for r in graph.contextual_proximity(edges).collect()}
    assert got == {("a", "b"): 7, ("b", "a"): 7, ("a", "c"): 3, ("c", "a"): 3, ("b", "c"): 2, ("c", "b"): 2}


def test_communities_split_at_the_bridge(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "x"), ("x", "y"), ("y", "z"), ("x", "z"), ("p", "q")]
    df = spark.createDataFrame(edges, "src string, dst string")
    found = graph.communities(df, splits=1)
    lists = sorted(r.nodes for r in graph.community_lists(found).collect())
    assert ["a", "b", "c"] in lists and ["x", "y", "z"] in lists
    many = graph.communities(df, splits=1, most_edges=3)
    assert {r.node for r in many.collect()} == set("abcxyzpq")
    assert {r.node: r.component for r in graph.component_labels(df).collect()} == dict.fromkeys("abcxyz", "a") | dict.fromkeys("pq", "p")


def test_communities_of_large_components_are_exact(spark):
    """A ring of six triangles has no bridge: two cuts part it, where label propagation finds every triangle."""
    ring = [(f"{k}{a}", f"{k}{b}") for k in range(6) for a, b in ("ab", "bc", "ac")] + [(f"{k}c", f"{(k + 1) % 6}a") for k in range(6)]
    df = spark.createDataFrame([(min(e), max(e)) for e in ring], "src string, dst string")
    one = sorted(r.nodes for r in graph.community_lists(graph.communities(df, splits=1)).collect())
    many = sorted(r.nodes for r in graph.community_lists(graph.communities(df, splits=1, most_edges=3)).collect())
    assert one == many and sorted(map(len, many)) == [9, 9]
    u, v = (np.array(c) for c in zip((0, 1), (1, 2), (2, 3), (0, 3), (3, 4), strict=True))
    assert np.allclose(graph.edge_flows(5, u, v, np.arange(5)), graph.edge_flows(5, u, v, np.arange(5), dense=0))


def test_all_nodes_of_the_triples_have_a_community(spark, sf):
    nodes = {r.node for r in QUERIES["st2_nodes"](spark, sf).collect()} & {r.node for r in QUERIES["ag23_gr6_degrees"](spark, sf).collect()}
    found = QUERIES["jn19_nodes_with_community"](spark, sf).collect()
    assert {r.node for r in found} == nodes and None not in {r.community for r in found} and len({r.community for r in found}) == 3


def test_word_pieces(spark):
    rows = [(0, "##x", 0.9, 0, 1), (1, "Lee", 0.8, 1, 4), (2, "##o", 0.5, 4, 5), (3, "Ha", 0.7, 6, 8), (4, "##gem", 0.9, 8, 11)]
    df = spark.createDataFrame([(1, "PER", s, i, w, a, b) for i, w, s, a, b in rows], "doc_id int, entity string, score double, index int, word string, start int, end int")
    got = [(r.word, r.score, r.start, r.end) for r in entities.merge_word_pieces(df).orderBy("index").collect()]
    assert got == [("Leeo", 0.5, 1, 5), ("Hagem", 0.7, 6, 11)]
    again = entities.merge_word_pieces(entities.merge_word_pieces(df))
    assert sorted(r.word for r in again.collect()) == ["Hagem", "Leeo"]


def test_grammar_tree_and_sentences(spark):
    df = spark.sql("select array('the','cold','airway','is','open') w, array('DT','JJ','NN','X','JJ') t, '(S (NNP Ann) (VP (NNS parts)))' tree")
    got = df.select(entities.noun_phrases(F.col("w"), F.col("t")), entities.tree_nouns(F.col("tree"))).first()
    assert got[0] == ["the cold airway"] and got[1] == ["Ann", "parts"]
    tokens = spark.createDataFrame([(i, x) for i, x in enumerate([1, 2, 3, 1, 2, 1])], "n int, index int")
    assert [r.sentence for r in entities.sentence_numbers(tokens, F.col("n"), "index").orderBy("n").collect()] == [0, 0, 0, 1, 1, 2]


def test_ideal_ranking_scores_one(spark):
    qrels = spark.createDataFrame([("q", "a", 3.0), ("q", "b", 1.0), ("r", "c", 2.0)], "qid string, docid string, grade double")
    best = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("r", "c", 1), ("s", "x", 1)], "qid string, docid string, rank int")
    got = {r.metric: r.value for r in ranking.metrics(best, qrels).collect()}
    assert got["nDCG@3"] == got["MRR@10"] == got["MAP@1000"] == got["Recall@10"] == 1.0
    assert got["QueriesRanked"] == 2 and got["QueriesWithRelevant@10"] + got["QueriesWithNoRelevant@10"] == 3
    assert ranking.metrics(best.limit(0), qrels).filter("metric = 'MRR@10'").first().value is None


def test_positional_and_keyed_answers(spark):
    gold = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z")], "k string, a string")
    guess = spark.createDataFrame([("2", "y"), ("3", "q")], "k string, a string")
    assert {r.k: r.exact for r in qa.answer_scores(gold, guess, "k", "a").collect()} == {"2": 1, "3": 0}
    assert {r.k: r.exact for r in qa.answer_scores(gold, guess, "k", "a", positional=True).collect()} == {"1": 0, "2": 0}


def test_energy_is_kept(spark):
    starts = spark.createDataFrame([(1, 1.3, 0.0, 2.3, 0.0)], "traj_id long, theta1 double, z1 double, theta2 double, z2 double")
    states = chaos.trajectories(starts, seconds=3.0)
    assert states.count() == 301
    assert chaos.energy_drift(states).first().drift < 0.05
    assert chaos.frames(states).count() == 31
    assert chaos.trails(states).agg(F.max("segment")).first()[0] == 19


def test_pendulums_run_thirty_seconds(spark, sf):
    states = QUERIES["ml25_sf27_pendulums"](spark, sf)
    assert {(r.steps, r.last) for r in states.groupBy("traj_id").agg(F.count("*").alias("steps"), F.max("step").alias("last")).collect()} == {(3001, 3000)}
    trails = QUERIES["wn8_trails"](spark, sf).agg(F.countDistinct("traj_id"), F.max("step")).first()
    assert tuple(trails) == (states.select("traj_id").distinct().count(), 3000)


def test_latent_topics_of_all_words(spark):
    """The strongest words are rarer than 1,001 others."""
    rows = [([f"w{k}"],) for k in range(1001) for _ in range(6)] + [(["whole"] * 5,), (["half"] * 4,)]
    found = topics.lsa_topics(spark.createDataFrame(rows, "tokens array<string>"), "tokens", words=1)
    assert [(r.topic, r.word, round(r.weight, 6)) for r in found.orderBy("topic").collect()] == [(0, "whole", 1.0), (1, "half", 1.0)]


def test_unknown_topic_raises(spark):
    docs = spark.createDataFrame([(1, [0, 9])], "doc int, ids array<int>")
    labels = spark.createDataFrame([(0, "zero")], "Topic int, Name string")
    with pytest.raises(Exception, match="unknown topic"):
        topics.labelled(docs, "ids", labels, "Topic", "Name", "doc").collect()
    empty = spark.createDataFrame([(1, [])], "doc int, ids array<int>")
    assert topics.labelled(empty, "ids", labels, "Topic", "Name", "doc").first().names == ""


def test_failing_client_gives_no_rows(spark):
    class Failing:
        def generate(self, prompt):
            raise RuntimeError("no answer")

    class Prose:
        def generate(self, prompt):
            return "certainly!"

    chunks = spark.createDataFrame([("c", "Some longer sentence with entropy."), ("d", None)], "chunk_id string, text string")
    assert extraction.extracted(chunks, "triples", Failing()).count() == 0
    assert extraction.extracted(chunks, "triples", Prose()).count() == 0
    assert extraction.extracted(chunks, "triples", extraction.RuleClient()).count() > 0


def test_a_trained_head_tells_relevant_pairs(spark):
    """Held-out accuracy: documents that hold the query's tokens against those that don't."""
    from textloom.operators import rankers

    rng = np.random.default_rng(5)
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    queries, documents, pairs = [], [], []
    for i in range(120):
        tokens = [rng.normal(size=16) for _ in range(3)]
        queries += [(i, p, unit(t)) for p, t in enumerate(tokens)]
        relevant = i % 2
        documents += [(i, p, unit(rng.normal(size=16) + (4 * tokens[p] if relevant and p < 3 else 0))) for p in range(8)]
        pairs.append((i, i, relevant))
    q = spark.createDataFrame(queries, "qid long, pos int, vector array<double>")
    d = spark.createDataFrame(documents, "docid long, pos int, vector array<double>")
    p = spark.createDataFrame(pairs, "qid long, docid long, relevant int")
    features = rankers.kernel_features(q, d, p.select("qid", "docid")).join(p, ["qid", "docid"])
    weights, offset = rankers.trained_head(features.filter("qid < 80"), "relevant")
    held = features.filter("qid >= 80").collect()
    right = sum((np.dot(r.kernels, weights) + offset > 0) == bool(r.relevant) for r in held)
    assert len(held) == 40 and right >= 36
    scores = rankers.kernel_scores(q, d, p.select("qid", "docid"), weights).filter("qid >= 80").collect()
    assert all(abs(s.score - np.dot(next(r for r in held if r.qid == s.qid).kernels, weights)) < 1e-6 for s in scores)


def test_clustered_topics_are_named_by_their_own_words(spark):
    """Class-based weights by hand: a word counts where it is frequent in one cluster and rare in the others."""
    from textloom.operators import topics

    vectors = spark.createDataFrame([(i, [10.0, 0.0] if i % 2 else [0.0, 10.0]) for i in range(20)], "id long, v array<double>")
    texts = spark.createDataFrame([(i, ["odd", "odd", "both"] if i % 2 else ["even", "both", f"rare{i}"]) for i in range(20)], "id long, w array<string>")
    got = {tuple(r.Representation): r for r in topics.clustered_topics(vectors, "id", "v", texts, "w", k=2, words=2).collect()}
    assert set(got) == {("odd", "both"), ("even", "both")} and all(r.Count == 10 for r in got.values())
    assert all(r.Name == f"{r.Topic}_{'_'.join(r.Representation)}" for r in got.values())


def test_sentences_begin_where_the_index_falls(spark):
    rows = [(0, 1), (1, 2), (2, 3), (3, 1), (4, 2), (5, 2), (6, 9)]
    df = spark.createDataFrame(rows, "at int, i int")
    got = entities.sentence_numbers(df, F.col("at"), "i").orderBy("at").collect()
    assert [r.sentence for r in got] == [0, 0, 0, 1, 1, 2, 2] and got[0].asDict().keys() == {"at", "i", "sentence"}
