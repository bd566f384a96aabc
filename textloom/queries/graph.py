"""Graphs: RS1, JN8, JN10, JN19, AG4-AG6, AG23, GR1-GR9, PF8, PF10, PF11, ST2, TK4, TK9, WN6, ML4, SC17, SK7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import graph as G
from textloom.operators.packed import NAMES, split_packed
from textloom.plans.session import table
from textloom.registry import query

_CLEAN = """clean AS (SELECT node_1, node_2, edge, chunk_id FROM (SELECT nullif(lower(trim(node_1)), '') AS node_1, nullif(lower(trim(node_2)), '') AS node_2, edge, chunk_id FROM graph)
WHERE node_1 IS NOT NULL AND node_2 IS NOT NULL AND chunk_id IS NOT NULL)"""
_MELT = ", melt AS (SELECT chunk_id, 'node_1' AS variable, node_1 AS node FROM clean UNION ALL SELECT chunk_id, 'node_2', node_2 FROM clean)"
_NEAR = """, near AS (SELECT a.node AS node_1, b.node AS node_2, count(*) AS count, string_agg(a.chunk_id, ',' ORDER BY a.chunk_id) AS chunk_id
FROM melt a JOIN melt b USING (chunk_id) WHERE a.node <> b.node GROUP BY 1, 2 HAVING count(*) <> 1)"""


def clean(spark: SparkSession, d: str) -> DataFrame:
    return G.clean_edges(table(spark, d, "graph"))


def _simple(spark: SparkSession, d: str) -> DataFrame:
    edges = clean(spark, d).filter("node_1 <> node_2").withColumn("ord", F.concat_ws("/", "chunk_id", F.coalesce("edge", F.lit(""))))
    return G.simple_graph(edges.withColumn("count", F.lit(4)), "ord")


_SIMPLE = """, simple AS (SELECT least(node_1, node_2) AS src, greatest(node_1, node_2) AS dst, max(chunk_id || '/' || coalesce(edge, '')) AS ord
FROM clean WHERE node_1 <> node_2 GROUP BY 1, 2)"""


@query(f"WITH {_CLEAN} SELECT * FROM clean")
def pf8_ml4_sf1_clean_edges(spark: SparkSession, d: str) -> DataFrame:
    return clean(spark, d)


@query(f"WITH {_CLEAN} SELECT node_1, node_2, edge, chunk_id, 4 AS count, 4 / 2 AS width FROM clean WHERE node_1 <> node_2")
def gr1_pf10_weighted_edges(spark: SparkSession, d: str) -> DataFrame:
    return clean(spark, d).filter("node_1 <> node_2").withColumn("count", F.lit(4)).withColumn("width", F.col("count") / 2)


@query(f"WITH {_CLEAN}{_MELT} SELECT * FROM melt")
def rs1_melted(spark: SparkSession, d: str) -> DataFrame:
    return G.melted(clean(spark, d))


@query(f"WITH {_CLEAN}{_MELT}{_NEAR} SELECT node_1, node_2, count, 'contextual proximity' AS edge FROM near")
def gr2_jn8_pf11_contextual_proximity(spark: SparkSession, d: str) -> DataFrame:
    return G.contextual_proximity(clean(spark, d))


@query(f"WITH {_CLEAN}{_MELT}{_NEAR} SELECT node_1, node_2, count, chunk_id, 'contextual proximity' AS edge FROM near")
def ag4_proximity_chunks(spark: SparkSession, d: str) -> DataFrame:
    return G.contextual_proximity(clean(spark, d), with_chunks=True)


@query(f"""WITH {_CLEAN}{_MELT}{_NEAR}, both_sides AS (SELECT node_1, node_2, edge, 4 AS count FROM clean UNION ALL SELECT node_1, node_2, 'contextual proximity', count FROM near)
SELECT node_1, node_2, CAST(sum(count) AS BIGINT) AS count, coalesce(string_agg(DISTINCT edge, ',' ORDER BY edge), '') AS edge FROM both_sides GROUP BY 1, 2""")
def ag5_merged_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.merged_edges(clean(spark, d).withColumn("count", F.lit(4).cast("long")), G.contextual_proximity(clean(spark, d)))


@query(f"WITH {_CLEAN} SELECT node_1 AS node FROM clean UNION SELECT node_2 FROM clean")
def st2_nodes(spark: SparkSession, d: str) -> DataFrame:
    edges = clean(spark, d)
    return edges.select(F.col("node_1").alias("node")).union(edges.select("node_2")).distinct()


@query(f"WITH {_CLEAN}{_SIMPLE} SELECT src, dst, ord FROM simple")
def gr3_simple_graph(spark: SparkSession, d: str) -> DataFrame:
    return _simple(spark, d).select("src", "dst", "ord")


@query(f"WITH {_CLEAN}{_SIMPLE} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM simple UNION ALL SELECT dst FROM simple) GROUP BY 1")
def ag23_gr6_degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(_simple(spark, d))


@query()
def gr4_gr5_communities(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the simple graph of all triples."""
    return G.communities(_simple(spark, d))


@query()
def tk9_community_lists(spark: SparkSession, d: str) -> DataFrame:
    return G.community_lists(G.communities(_simple(spark, d)))


@query()
def jn19_nodes_with_community(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(_simple(spark, d)).join(G.communities(_simple(spark, d)), "node", "left")


_GROUPS = """, firsts AS (SELECT node, min(chunk_id) AS first_chunk FROM (SELECT node_1 AS node, chunk_id FROM clean UNION ALL SELECT node_2, chunk_id FROM clean) GROUP BY 1),
numbers AS (SELECT first_chunk, CAST(row_number() OVER (ORDER BY min(node)) AS INTEGER) AS community FROM firsts GROUP BY 1),
grouped AS (SELECT node, community FROM firsts JOIN numbers USING (first_chunk))"""


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    return G.numbered_communities(sc17_sk7_vertices(spark, d), "first_chunk")


@query(f"WITH {_CLEAN}{_GROUPS} SELECT community, list(node ORDER BY node) AS nodes FROM grouped GROUP BY 1")
def tk9_gr5_lists_by_first_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Numbers and sorted lists of groups that SQL can make, too: nodes by the first chunk they stand in."""
    return G.community_lists(_grouped(spark, d))


@query(f"""WITH {_CLEAN}{_SIMPLE}{_GROUPS}, degrees AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM simple UNION ALL SELECT dst FROM simple) GROUP BY 1)
SELECT node, degree, community FROM degrees LEFT JOIN grouped USING (node)""")
def jn19_gr6_nodes_by_first_chunk(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(_simple(spark, d)).join(_grouped(spark, d), "node", "left")


def _authors(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(table(spark, d, "article_info_long", "id", "authors"), "authors", NAMES, ["id"])


_LISTED = """names AS (SELECT id, string_split(authors, ', ') AS w FROM article_info_long WHERE authors IS NOT NULL),
items AS (SELECT id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS val FROM names)"""


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """Authors as the plain lists they are joined to, without looking into their packing."""
    return table(spark, d, "article_info_long", "id", "authors").dropna().select("id", F.posexplode(F.split("authors", ", ")).alias("pos", "val"))


@query(f"WITH {_LISTED} SELECT a.id, a.val AS source, b.val AS target FROM items a JOIN items b ON a.id = b.id AND a.pos < b.pos")
def jn10_pairs_in_lists(spark: SparkSession, d: str) -> DataFrame:
    return G.pairs_in_lists(_listed(spark, d), "id", "pos", "val")


@query(f"WITH {_LISTED} SELECT a.val AS source, b.val AS target, count(*) AS weight FROM items a JOIN items b ON a.id = b.id AND a.pos < b.pos GROUP BY 1, 2")
def ag6_directed_weights(spark: SparkSession, d: str) -> DataFrame:
    return G.weighted(G.pairs_in_lists(_listed(spark, d), "id", "pos", "val"))


@query(f"WITH {_LISTED} SELECT least(a.val, b.val) AS source, greatest(a.val, b.val) AS target, count(*) AS weight FROM items a JOIN items b ON a.id = b.id AND a.pos < b.pos GROUP BY 1, 2")
def gr7_undirected_weights(spark: SparkSession, d: str) -> DataFrame:
    return G.weighted(G.pairs_in_lists(_listed(spark, d), "id", "pos", "val"), directed=False)


@query(f"""WITH {_LISTED} SELECT a.val AS source, b.val AS target, count(*) AS weight FROM items a JOIN items b ON a.id = b.id AND a.pos < b.pos
GROUP BY 1, 2 ORDER BY weight DESC, source, target LIMIT 10""")
def tk4_gr8_heaviest_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.heaviest(G.weighted(G.pairs_in_lists(_listed(spark, d), "id", "pos", "val")), 10)


@query()
def gr7_coauthors(spark: SparkSession, d: str) -> DataFrame:
    """Co-authorship edges between the authors as the packed fields name them."""
    return G.weighted(G.pairs_in_lists(_authors(spark, d), "id", "pos", "val"))


@query(f"WITH {_LISTED} SELECT val AS label, CAST(row_number() OVER (ORDER BY val) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT val FROM items)")
def wn6_numbered_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.numbered_nodes(_listed(spark, d), "val")


_HEADED = ["entropy", "noise", "asthma", "reason", "memory", "order", "chance"]


@query(rf"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(2, len(w) + 1)) AS i FROM t)
SELECT DISTINCT doc_id AS doc, w[i] AS entity, w[i - 1] AS head FROM p WHERE w[i] IN ({", ".join(f"'{w}'" for w in _HEADED)})""")
def gr9_ml8_entity_heads(spark: SparkSession, d: str) -> DataFrame:
    return G.entity_heads(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", _HEADED)


@query(f"WITH {_CLEAN} SELECT node, min(chunk_id) AS first_chunk FROM (SELECT node_1 AS node, chunk_id FROM clean UNION ALL SELECT node_2, chunk_id FROM clean) GROUP BY 1")
def sc17_sk7_vertices(spark: SparkSession, d: str) -> DataFrame:
    """All vertices of the property graph, each once."""
    from textloom.sources.sinks import property_graph

    return property_graph(clean(spark, d))[0]
