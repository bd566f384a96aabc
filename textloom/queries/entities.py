"""Entities and words: WN3, AG22, AG7, AG8, AG11, JN9, JN11, PF4, PF7, PF16, TK3, TK6-TK8, SF6, SF8-SF11, SF13-SF17, SF23, SF26, SF28, ML6-ML12."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import entities as E
from textloom.plans.session import table
from textloom.registry import query

# the words of all texts in pieces of five letters, as a word-piece tokenizer leaves them; each text's first word has lost its beginning
_PIECES = r"""tokens AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
words AS (SELECT doc_id, unnest(range(0, len(w))) AS spot, unnest(w) AS word FROM tokens),
merged AS (SELECT doc_id, CASE WHEN regexp_matches(word, '^\p{Lu}') THEN 'UPPER' WHEN regexp_matches(word, '^\p{N}') THEN 'NUMBER' ELSE 'WORD' END AS entity, round(1.0 / ((length(word) + 4) // 5), 4) AS score,
CAST(spot * 1000 AS INTEGER) AS index, word, CAST(spot * 1000 AS INTEGER) AS start, CAST(spot * 1000 + (length(word) + 4) // 5 AS INTEGER) AS "end" FROM words WHERE spot > 0)"""


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[\\p{L}\\p{N}]+"), F.lit(0))).alias("at", "word"))
    kind = F.when(F.col("word").rlike("^\\p{Lu}"), "UPPER").when(F.col("word").rlike("^\\p{N}"), "NUMBER").otherwise("WORD")
    pieces = words.select("doc_id", "at", "word", kind.alias("kind"), F.explode(F.sequence(F.lit(0), F.floor((F.length("word") - 1) / 5).cast("int"))).alias("j"))
    n = (F.col("at") * 1000 + F.col("j")).cast("int")
    part = F.substring("word", F.col("j") * 5 + 1, F.lit(5))
    return pieces.select(
        "doc_id", F.when(F.col("j") == 0, F.col("kind")).otherwise("PIECE").alias("entity"), F.round(1.0 / (F.col("j") + 1), 4).alias("score"), n.alias("index"), n.alias("start"), (n + 1).alias("end"),
        F.when((F.col("j") == 0) & (F.col("at") > 0), part).otherwise(F.concat(F.lit("##"), part)).alias("word"),
    )


@query(f"WITH {_PIECES} SELECT * FROM merged")
def wn3_ag22_word_pieces(spark: SparkSession, d: str) -> DataFrame:
    return E.merge_word_pieces(_pieces(spark, d))


@query(f"WITH {_PIECES} SELECT entity, count(*) AS n FROM merged GROUP BY 1")
def ag8_entity_counts(spark: SparkSession, d: str) -> DataFrame:
    return wn3_ag22_word_pieces(spark, d).groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "entity")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click'")
def pf7_label_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "event_type").filter(F.col("event_type") == "click")


@query("SELECT id FROM article_info_long WHERE abstract IS NOT NULL AND abstract <> ''")
def pf4_with_abstract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "article_info_long", "id", "abstract").filter(F.col("abstract").isNotNull() & ~F.col("abstract").eqNullSafe("")).select("id")


@query("SELECT p_partkey, p_name, n_name FROM part, (SELECT 'steel' AS n_name UNION ALL SELECT 'Red' UNION ALL SELECT 'blue' UNION ALL SELECT 'co') v WHERE contains(lower(p_name), lower(n_name))")
def jn9_pf16_vocabulary_matches(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = spark.createDataFrame([(w,) for w in ("steel", "Red", "blue", "co")], "n_name string")
    return E.contains_any(table(spark, d, "part", "p_partkey", "p_name"), "p_name", vocabulary, "n_name")


_WORDS = r"SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents"


@query(f"SELECT word, count(*) AS n FROM ({_WORDS}) GROUP BY 1")
def ag7_sf6_tk6_word_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "text").select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(f"SELECT word, count(*) AS n FROM ({_WORDS}) GROUP BY 1 ORDER BY n DESC, word LIMIT 10")
def tk3_most_common(spark: SparkSession, d: str) -> DataFrame:
    return ag7_sf6_tk6_word_counts(spark, d).orderBy(F.col("n").desc(), "word").limit(10)


@query("SELECT id, title FROM article_info_long WHERE abstract IS NOT NULL ORDER BY id LIMIT 250")
def tk7_sc7_first_rows(spark: SparkSession, d: str) -> DataFrame:
    """A scan with filter and limit; the order makes the limit the same in every run."""
    return table(spark, d, "article_info_long", "id", "title", "abstract").filter("abstract is not null").orderBy("id").limit(250).select("id", "title")


@query(r"SELECT doc_id, array_to_string((regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))[1:30], ' ') AS head FROM documents WHERE text IS NOT NULL")
def tk8_truncated_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").dropna(subset=["text"]).select("doc_id", F.array_join(F.slice(T.words(F.col("text")), 1, 30), " ").alias("head"))


@query("SELECT symbol, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS probability FROM (SELECT unnest(string_split(text, '')) AS symbol FROM documents WHERE text IS NOT NULL) WHERE symbol <> '' GROUP BY 1")
def ag11_symbol_frequencies(spark: SparkSession, d: str) -> DataFrame:
    from textloom.operators.coding import symbol_counts

    return symbol_counts(table(spark, d, "documents", "text"), "text").withColumn("probability", F.round("probability", 9))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) AS tokens FROM documents WHERE text IS NOT NULL")
def sf8_punctuated_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").dropna(subset=["text"]).select("doc_id", F.size(T.punctuated_tokens(F.col("text"))).cast("long").alias("tokens"))


@query(r"SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: w NOT IN ('the', 'of', 'and'))) AS kept FROM documents WHERE text IS NOT NULL")
def sf9_without_stop_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").dropna(subset=["text"]).select("doc_id", F.size(T.without_stop_words(T.words(F.col("text")), ["the", "of", "and"])).cast("long").alias("kept"))


@query(r"""SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '[!-/:-@\[-`{-~]', ' ', 'g'), '[0-9]+', '', 'g'), '[\s\x{00a0}\x{0085}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'),
lambda t: t <> '' AND lower(t) NOT IN ('the', 'of', 'and')) AS tokens FROM documents WHERE text IS NOT NULL""")
def sf10_topic_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").dropna(subset=["text"]).select("doc_id", T.topic_tokens(F.col("text"), ["the", "of", "and"]).alias("tokens"))


@query("SELECT id, split_part(pubmed_id, E'\\n', 1) AS own FROM article_info_long")
def sf11_first_line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "article_info_long", "id", "pubmed_id").select("id", T.first_line(F.col("pubmed_id")).alias("own"))


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'None') || ' ' || c_name AS full_name FROM customer")
def sf13_full_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_name").select("c_custkey", T.full_name(F.nullif("c_mktsegment", F.lit("BUILDING")), F.col("c_name")).alias("full_name"))


@query("SELECT item_id, 'Context: ' || passage || E'\\nQuestion: ' || question AS prompt FROM eval_items")
def sf14_prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items", "item_id", "passage", "question").select("item_id", F.format_string("Context: %s\nQuestion: %s", "passage", "question").alias("prompt"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def sf15_json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "props").select("event_id", F.from_json("props", "k int").k.alias("k"))


@query("SELECT DISTINCT chunk_id, substr(sha256(coalesce(source, '') || chr(31) || chunk_id), 1, 32) AS stable FROM chunks")
def sf16_stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks", "chunk_id", "source").select("chunk_id", T.stable_id(F.coalesce("source", F.lit("")), F.col("chunk_id")).alias("stable")).distinct()


@query("SELECT DISTINCT 'model_epoch_' || c_nationkey || '.pt' AS file, c_nationkey AS epoch FROM customer")
def sf17_sc19_epoch(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("model_epoch_"), F.col("c_nationkey"), F.lit(".pt"))
    return table(spark, d, "customer", "c_nationkey").select(name.alias("file")).distinct().withColumn("epoch", T.epoch_of(F.col("file")))


@query("SELECT a.day AS previous, a.day + 1 AS current, count(o.o_orderkey) AS n FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '1995-03-01', INTERVAL 1 DAY)) AS DATE) AS day) a LEFT JOIN orders o ON CAST(o.o_orderdate AS DATE) BETWEEN a.day AND a.day + 1 GROUP BY 1, 2")
def sf23_daily_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a day and the next, both ends included."""
    days = spark.sql("SELECT explode(sequence(DATE '1995-01-01', DATE '1995-03-01', INTERVAL 1 DAY)) AS previous").withColumn("current", F.date_add("previous", 1))
    orders = table(spark, d, "orders", "o_orderkey", "o_orderdate").withColumn("day", F.to_date("o_orderdate"))
    both = orders.select("o_orderkey", F.explode(F.array("day", F.date_sub("day", 1))).alias("previous"))
    return days.join(both, "previous", "left").groupBy("previous", "current").agg(F.count("o_orderkey").alias("n"))


@query("SELECT id, coalesce(journal, 'None') AS journal, round(100.0 * length(title) / nullif(length(abstract), 0), 6) AS percent FROM article_info_long")
def sf26_sf28_defaults_ratios(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "article_info_long", "id", "journal", "title", "abstract")
    return rows.select("id", F.coalesce("journal", F.lit("None")).alias("journal"), F.round(F.try_divide(100.0 * F.length("title"), F.length("abstract")), 6).alias("percent"))


# a tree a triple: labels of one word are common nouns, longer ones end in a plural, and edges are verbs
_NP = "CASE WHEN {0} IS NULL THEN '' WHEN instr({0}, ' ') = 0 THEN '(NP (NN ' || {0} || '))' ELSE '(NP (NNP ' || split_part({0}, ' ', 1) || ') (NNS ' || replace({0}, split_part({0}, ' ', 1) || ' ', '') || '))' END"
_TREE = f"'(S ' || {_NP.format('node_1')} || ' (VP (VBZ ' || coalesce(edge, '') || ') ' || {_NP.format('node_2')} || '))'"


@query(f"SELECT node_1, edge, node_2, array_to_string(regexp_extract_all({_TREE}, '\\((NNP|NNS) ([^()]+)\\)', 2), ' ') AS nouns FROM graph")
def ml7_tree_nouns(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "graph", "node_1", "edge", "node_2")
    return rows.select("node_1", "edge", "node_2", F.array_join(E.tree_nouns(F.expr(_TREE)), " ").alias("nouns"))


# a tagger without a model: closed classes by list, adjectives and verbs by their endings, else nouns
_DETERMINERS = "the a an this that these those each every some any no".split()
_CLOSED = "is was were are be been has have had do does did can could may might must shall should will would in of and or to by with from at on for as but if than not it its he she they we you i who which what there then so".split()
_JJ, _VB = "(?:al|ic|ive|ous|ful|less|able|ible|ary)$", "(?:ed|ing|izes?|ifies|ly)$"


def _tag(w: Column) -> Column:
    closed = F.when(w.isin(_DETERMINERS), "DT").when(w.isin(_CLOSED), "X")
    return closed.when((F.length(w) > 4) & w.rlike(_JJ), "JJ").when((F.length(w) > 4) & w.rlike(_VB), "X").otherwise("NN")


def _sql_list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


@query(rf"""WITH joined AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda w: w || '/' || CASE WHEN w IN ({_sql_list(_DETERMINERS)}) THEN 'DT' WHEN w IN ({_sql_list(_CLOSED)}) THEN 'X'
WHEN length(w) > 4 AND regexp_matches(w, '{_JJ}') THEN 'JJ' WHEN length(w) > 4 AND regexp_matches(w, '{_VB}') THEN 'X' ELSE 'NN' END || ' '), '') AS j FROM documents WHERE text IS NOT NULL)
SELECT doc_id, list_transform(regexp_extract_all(j, '(?:\S+/DT )?(?:\S+/JJ )*\S+/NN '), lambda p: rtrim(regexp_replace(p, '/[A-Z]+ ', ' ', 'g'))) AS phrases FROM joined""")
def ml6_noun_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Tags come from lists and endings; the grammar runs over them."""
    tokens, tag = T.words(F.col("text")), F.transform("tokens", _tag)
    return table(spark, d, "documents", "doc_id", "text").dropna(subset=["text"]).select("doc_id", tokens.alias("tokens")).withColumn("tags", tag).select("doc_id", E.noun_phrases(F.col("tokens"), F.col("tags")).alias("phrases"))


@query(r"""WITH terms AS (SELECT term, min(entity) AS entity FROM (SELECT lower(trim(node_1)) AS term, 'CONCEPT' AS entity FROM graph UNION ALL SELECT lower(trim(node_2)), 'CONCEPT' FROM graph
UNION ALL SELECT lower(unnest(Representation)), 'TOPIC' FROM topic_info) WHERE regexp_matches(term, '^[\p{L}\p{N}_]+$') GROUP BY 1)
SELECT chunk_id AS key, token, coalesce(entity, 'No entity') AS entity FROM (SELECT chunk_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS token FROM chunks) LEFT JOIN terms ON lower(token) = term""")
def ml9_tagged_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary: all labels of the graph that are one word, and the words of the topics."""
    labels = table(spark, d, "graph", "node_1", "node_2").select(F.explode(F.array("node_1", "node_2")).alias("term")).select(F.lower(F.trim("term")).alias("term"), F.lit("CONCEPT").alias("entity"))
    topics = table(spark, d, "topic_info", "Representation").select(F.explode(F.transform("Representation", F.lower)).alias("term"), F.lit("TOPIC").alias("entity"))
    terms = labels.unionByName(topics).filter(F.col("term").rlike("^[\\p{L}\\p{N}_]+$")).groupBy("term").agg(F.min("entity").alias("entity"))
    return E.tagged(table(spark, d, "chunks", "chunk_id", "text"), "chunk_id", "text", terms)


@query(r"SELECT doc_id, nullif(regexp_extract(text, '(?i)\b(GmbH & Co\. KG|GmbH|AG|KG|OHG|UG|Ltd\.?|LLP|Inc\.?|S\.A\.|SE)(?:\W|$)', 1), '') AS form FROM documents")
def ml12_company_forms(spark: SparkSession, d: str) -> DataFrame:
    """The first legal form in every text; many tell of registered companies."""
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", E.company_form(F.col("text")).alias("form"))


@query("""WITH names AS (SELECT id, string_split(authors, ', ') AS w FROM article_info_long WHERE authors IS NOT NULL), items AS (SELECT id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS val FROM names)
SELECT a.id, a.val AS entity_1, b.val AS entity_2, CAST(CASE WHEN a.val = b.val THEN 2 WHEN split_part(a.val, ' ', 1) = split_part(b.val, ' ', 1) THEN 1 ELSE 0 END AS INTEGER) AS relation FROM items a JOIN items b ON a.id = b.id AND a.pos < b.pos""")
def jn11_ml11_related_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every two authors of an article with an offline class: 2 for the same name, 1 for the same first word, else 0."""
    authors = table(spark, d, "article_info_long", "id", "authors").dropna().select("id", F.posexplode(F.split("authors", ", ")).alias("pos", "val"))
    return E.related(authors, "id", "pos", "val", lambda a, b: 2 if a == b else int(a.split(" ")[0] == b.split(" ")[0]))
