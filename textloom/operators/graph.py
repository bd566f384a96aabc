"""Edges from shared chunks and shared papers, simple graphs, communities."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import words
from textloom.plans.order import met, numbered
from textloom.plans.scratch import Scratch


def clean_edges(edges: DataFrame) -> DataFrame:
    """Labels in lower case; blank labels are null, and rows without both nodes or a chunk are dropped."""
    label = {c: F.nullif(F.lower(F.trim(c)), F.lit("")) for c in ("node_1", "node_2")}
    return edges.withColumns(label).na.drop(subset=["node_1", "node_2", "chunk_id"])


def melted(edges: DataFrame) -> DataFrame:
    """``chunk_id, variable, node``: both ends of every edge as rows."""
    return edges.unpivot(["chunk_id"], ["node_1", "node_2"], "variable", "node")


def contextual_proximity(edges: DataFrame, with_chunks: bool = False) -> DataFrame:
    """``node_1, node_2, count[, chunk_id], edge``: pairs that share chunks, in both directions.

    A chunk counts a pair as often as its mentions pair up. Mentions are added up per chunk before
    the self-join, so it meets each pair of labels once a chunk. Pairs seen once are dropped.
    """
    nodes = melted(edges).dropna(subset=["chunk_id", "node"]).groupBy("chunk_id", "node").agg(F.count("*").alias("m"))
    pairs = met(nodes, "chunk_id", {"node": "node_1", "m": "m1"}, {"node": "node_2", "m": "m2"}).filter("node_1 <> node_2")
    counts = [F.sum(F.col("m1") * F.col("m2")).alias("count")]
    if with_chunks:  # ids travel once with their number, and are repeated at the end
        listed = F.sort_array(F.collect_list(F.struct("chunk_id", (F.col("m1") * F.col("m2")).cast("int").alias("times"))))
        counts.append(F.array_join(F.flatten(F.transform(listed, lambda s: F.array_repeat(s.chunk_id, s.times))), ",").alias("chunk_id"))
    return pairs.groupBy("node_1", "node_2").agg(*counts).filter("count <> 1").withColumn("edge", F.lit("contextual proximity"))


def merged_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges of both, counts added and texts joined per pair of nodes."""
    rows = a.select("node_1", "node_2", "edge", "count").unionByName(b.select("node_1", "node_2", "edge", "count"))
    return rows.groupBy("node_1", "node_2").agg(F.sum("count").alias("count"), F.array_join(F.sort_array(F.collect_set("edge")), ",").alias("edge"))


def simple_graph(edges: DataFrame, order: str) -> DataFrame:
    """``src, dst`` (smaller first) with the attributes of the last of its edges in ``order``."""
    other = [c for c in edges.columns if c not in ("node_1", "node_2")]
    keyed = edges.select(F.least("node_1", "node_2").alias("src"), F.greatest("node_1", "node_2").alias("dst"), F.struct(order, *[c for c in other if c != order]).alias("last"))
    return keyed.groupBy("src", "dst").agg(F.max("last").alias("last")).select("src", "dst", "last.*")


def degrees(graph: DataFrame) -> DataFrame:
    return graph.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def pairs_in_lists(items: DataFrame, key: str, place: str, item: str) -> DataFrame:
    """``key, source, target``: every two items of a list, the earlier first."""
    return met(items.select(key, place, item), key, {place: "__p", item: "source"}, {place: "__q", item: "target"}).filter("__p < __q").select(key, "source", "target")


def weighted(pairs: DataFrame, directed: bool = True) -> DataFrame:
    """Edges with how often they occur; undirected ones have the smaller end first."""
    if not directed:
        pairs = pairs.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"))
    return pairs.groupBy("source", "target").agg(F.count("*").alias("weight"))


def numbered_nodes(names: DataFrame, name: str) -> DataFrame:
    """``id, label``: numbers from 0 in the order of the names."""
    return numbered(names.select(F.col(name).alias("label")).dropna().distinct(), [F.col("label")], "id", 0).withColumn("id", F.col("id").cast("int"))


def heaviest(edges: DataFrame, n: int) -> DataFrame:
    return edges.orderBy(F.col("weight").desc(), "source", "target").limit(n)


def component_labels(graph: DataFrame, rounds: int = 50) -> DataFrame:
    """``node, component``: the least node reachable, by minimum labels with pointer jumping."""
    scratch = Scratch(graph.sparkSession, "components")
    both = graph.select("src", "dst").unionByName(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    both = scratch.write(both, "edges")
    labels = scratch.write(both.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")), "labels-0")
    for k in range(1, rounds + 1):
        near = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("m"))
        new = labels.join(near, "node").withColumn("c", F.least("component", "m")).select("node", "c", (F.least("component", "m") < F.col("component")).alias("moved"))
        up = new.select(F.col("node").alias("c"), F.col("c").alias("above"))
        new = scratch.write(new.join(up, "c").select("node", F.least("c", "above").alias("component"), "moved"), f"labels-{k}")
        labels = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    return labels


def edge_flows(n: int, u: np.ndarray, v: np.ndarray, sources: np.ndarray, dense: int = 5_000) -> np.ndarray:
    """The shares of all shortest paths from the sources that run over each edge ``u[i], v[i]`` of the nodes 0 to n - 1.

    Sources are taken in blocks, level by level. Up to ``dense`` nodes a level is a product with the adjacency matrix,
    beyond that a sum over the sorted edges; both are exact.
    """
    total = np.zeros(len(u))
    if n <= dense:
        matrix, flow, width = np.zeros((n, n)), np.zeros((n, n)), 512
        matrix[u, v] = matrix[v, u] = 1.0
    else:
        heads, tails = np.concatenate([u, v]), np.concatenate([v, u])
        order = np.argsort(tails, kind="stable")
        heads, tails = heads[order], tails[order]
        starts = np.flatnonzero(np.concatenate([[True], tails[1:] != tails[:-1]]))
        width = max(1, 4_000_000 // len(heads))

    def step(x: np.ndarray) -> np.ndarray:
        if n <= dense:
            return x @ matrix
        out = np.zeros(x.shape)
        out[:, tails[starts]] = np.add.reduceat(x[:, heads], starts, axis=1)
        return out

    for lower in range(0, len(sources), width):
        block = sources[lower : lower + width]
        paths = np.zeros((len(block), n))
        paths[np.arange(len(block)), block] = 1.0
        seen, levels = paths > 0, [paths]
        while not seen.all():
            paths = step(paths)
            paths[seen] = 0.0
            if not paths.any():
                break
            seen |= paths > 0
            levels.append(paths)
        share = np.zeros((len(block), n))
        for k in range(len(levels) - 1, 0, -1):
            before, at = levels[k - 1], levels[k] > 0
            each = np.divide(1 + share, levels[k], out=np.zeros(share.shape), where=at)
            if n <= dense:
                flow += before.T @ each
            else:
                total += np.einsum("be,be->e", before[:, u], each[:, v]) + np.einsum("be,be->e", before[:, v], each[:, u])
            if k > 1:
                share = before * step(each)
    return flow[u, v] + flow[v, u] if n <= dense else total


def _parts(adjacent: dict[str, set[str]]) -> list[set[str]]:
    seen, out = set(), []
    for start in sorted(adjacent):
        if start in seen:
            continue
        part, stack = set(), [start]
        while stack:
            at = stack.pop()
            if at not in part:
                part.add(at)
                stack.extend(adjacent[at] - part)
        seen |= part
        out.append(part)
    return out


def split_component(edges: list[tuple[str, str]], splits: int, flows: Callable = edge_flows) -> list[set[str]]:
    """Parts after so many splits: the edge of most shortest paths goes first, ties to the least edge.

    ``flows`` counts the paths as ``edge_flows`` does, in the same process or in many tasks.
    """
    adjacent: dict[str, set[str]] = defaultdict(set)
    for a, b in edges:
        adjacent[a].add(b)
        adjacent[b].add(a)
    names = sorted(adjacent)
    number = {name: i for i, name in enumerate(names)}
    # in the order of the edges, so the first of equals is the least
    ends = np.array(sorted({(number[min(e)], number[max(e)]) for e in edges}), dtype=np.int64).reshape(-1, 2)
    parts = _parts(adjacent)
    target = len(parts) + splits
    while len(parts) < target and len(ends):
        score = flows(len(names), ends[:, 0], ends[:, 1], np.arange(len(names)))
        first = int(np.argmax(score >= score.max() * (1 - 1e-9)))
        a, b = (names[i] for i in ends[first])
        adjacent[a].discard(b)
        adjacent[b].discard(a)
        ends = np.delete(ends, first, axis=0)
        parts = _parts(adjacent)
    return parts


def _flows_in_tasks(spark: SparkSession) -> Callable:
    """``edge_flows`` with the sources dealt to tasks; the edges, as numbers, go to all of them."""

    def flows(n: int, u: np.ndarray, v: np.ndarray, sources: np.ndarray) -> np.ndarray:
        held = spark.sparkContext.broadcast((n, u, v))

        def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = [f["id"].to_numpy() for f in frames]
            if sum(map(len, own)):
                yield pd.DataFrame({"flow": [edge_flows(*held.value, np.concatenate(own)).tobytes()]})

        tasks = min(len(sources), spark.sparkContext.defaultParallelism)
        parts = spark.range(0, len(sources), 1, tasks).mapInPandas(counted, "flow binary").collect()
        total = sum((np.frombuffer(p["flow"]) for p in parts), np.zeros(len(u)))
        held.destroy()
        return total

    return flows


def communities(graph: DataFrame, splits: int = 2, most_edges: int = 10_000) -> DataFrame:
    """``node, community`` (1-based, in the order of the communities' least nodes).

    All components are split by edge betweenness: those of at most ``most_edges`` edges each in one
    task, larger ones one after the other, with the paths of each round counted in many tasks.
    """
    graph = graph.select("src", "dst").filter("src <> dst").distinct()
    labels = component_labels(graph)
    placed = graph.join(labels.withColumnRenamed("node", "src"), "src")
    size = placed.groupBy("component").agg(F.count("*").alias("n_edges"))
    placed = placed.join(size, "component")

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        parts = split_component(list(zip(frame.src, frame.dst, strict=True)), splits)
        return pd.DataFrame([(n, min(p)) for p in parts for n in p], columns=["node", "least"])

    small = placed.filter(F.col("n_edges") <= most_edges).groupBy("component").applyInPandas(split, "node string, least string")
    spark, large = graph.sparkSession, []
    for row in size.filter(F.col("n_edges") > most_edges).select("component").sort("component").collect():
        edges = placed.filter(F.col("component") == row["component"]).select("src", "dst").toPandas()
        parts = split_component(list(zip(edges.src, edges.dst, strict=True)), splits, _flows_in_tasks(spark))
        large += [(n, min(p)) for p in parts for n in p]
    found = small.unionByName(spark.createDataFrame(pd.DataFrame(large, columns=["node", "least"]), "node string, least string")) if large else small
    return numbered_communities(found, "least")


def numbered_communities(found: DataFrame, group: str) -> DataFrame:
    """``node, community``: groups numbered from 1 in the order of their least nodes."""
    least = found.groupBy(group).agg(F.min("node").alias("__least"))
    number = numbered(least, [F.col("__least")], "community").select(group, F.col("community").cast("int").alias("community"))
    return found.join(number, group).select("node", "community")


def community_lists(found: DataFrame) -> DataFrame:
    """One row a community with its sorted nodes."""
    return found.groupBy("community").agg(F.array_sort(F.collect_set("node")).alias("nodes"))


def entity_heads(texts: DataFrame, doc: str, text: str, vocabulary: list[str]) -> DataFrame:
    """``doc, entity, head``: words of a vocabulary with the word before them, each pair once a document."""

    w = words(F.col(text))
    rows = texts.select(F.col(doc).cast("long").alias("doc"), w.alias("w")).filter(F.size("w") > 1)
    pairs = F.filter(F.arrays_zip(F.slice("w", 2, F.size("w") - 1).alias("entity"), F.slice("w", 1, F.size("w") - 1).alias("head")), lambda p: p["entity"].isin(vocabulary))
    return rows.select("doc", F.inline(pairs)).toDF("doc", "entity", "head").distinct()
