"""Queries of the text and evidence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.operators import text as t
from lamella.sources.tables import table

from .registry import query


@query("SELECT space, trim(regexp_replace(lower(space), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM labelfree_spaces")
def txt_slug(spark, d):
    """TXT-1."""
    return table(spark, d, "labelfree_spaces").select("space", t.slug(F.col("space")).alias("slug"))


@query("WITH d AS (SELECT doc_id, nullif(regexp_replace(regexp_extract(lower(text), '(10\\.[0-9]{4,9}/[^ \\t\\n\\r,;\"<>]+)', 1), '[.)\\]]+$', ''), '') AS found, nullif(regexp_extract(lower(text), 'arxiv:?[ \\t\\n\\r]?([0-9]{4}\\.[0-9]{4,5})', 1), '') AS arxiv FROM documents) SELECT doc_id, coalesce(found, '10.48550/arxiv.' || arxiv) AS doi FROM d")
def txt_doi(spark, d):
    """TXT-2."""
    return table(spark, d, "documents").select("doc_id", t.doi(F.col("text")).alias("doi"))


_TOK = "list_transform(list_filter(string_split_regex(lower(coalesce(title, '')), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN w[:-2] ELSE w END)"


@query(f"SELECT doc_id, array_to_string({_TOK}, ' ') AS words FROM documents")
def txt_tokens(spark, d):
    """TXT-3 in part: without synonyms and stop words."""
    return table(spark, d, "documents").select("doc_id", F.array_join(t.tokens(F.coalesce("title", F.lit(""))), " ").alias("words"))


_TF = """, tf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(w) AS term FROM d) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2),
w AS (SELECT item_id, tf.term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM d)) / (1 + df)) + 1) AS w FROM tf JOIN df ON tf.term = df.term), u AS (SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM w)"""


@query("WITH d AS (SELECT item_id, " + _TOK.replace("coalesce(title, '')", "text") + " AS w FROM eval_items)" + _TF + " SELECT a.item_id AS a, b.item_id AS b, round(sum(a.w * b.w), 6) AS cosine FROM u a JOIN u b ON a.term = b.term AND a.item_id < b.item_id GROUP BY 1, 2")
def txt_tfidf_pairs(spark, d):
    """TXT-4 in part: sub-linear TF-IDF cosine over single words of a fixed set of items, joined on terms."""
    i = table(spark, d, "eval_items").select("item_id", t.tokens(F.col("text")).alias("w"))
    u = t.tfidf(i, "item_id", "w")
    p = t.similar_texts(u.withColumnRenamed("item_id", "a"), u.withColumnRenamed("item_id", "b"), "a", "b")
    return p.where("a < b").withColumn("cosine", F.round("cosine", 6))


@query("SELECT doc_id, CASE WHEN c AND m THEN 'core' WHEN c THEN 'method' WHEN m THEN 'peripheral' ELSE 'drop' END AS tier FROM (SELECT doc_id, regexp_matches(lower(coalesce(text, '')), 'silicon|anode|electrode|graphite') AS c, regexp_matches(lower(coalesce(text, '')), 'segmentation|detector|threshold|tomography') AS m FROM documents)")
def txt_tier(spark, d):
    """TXT-8."""
    return table(spark, d, "documents").select("doc_id", t.tier(F.coalesce("text", F.lit(""))).alias("tier"))


@query("WITH q AS (SELECT a.item_id AS a, b.item_id AS b, list_distinct(string_split(a.suite, '-')) AS x, list_distinct(string_split(b.suite, '-')) AS y FROM eval_items a JOIN eval_items b ON a.item_id + 1 = b.item_id WHERE a.suite IS NOT NULL AND b.suite IS NOT NULL) SELECT a, b, CASE WHEN len(list_intersect(x, y)) = len(x) AND len(x) = len(y) THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM q")
def txt_name_match(spark, d):
    """TXT-5: equal, contained or different token sets."""
    i = table(spark, d, "eval_items").where("suite IS NOT NULL")
    a, b = i.select(F.col("item_id").alias("a"), F.col("suite").alias("p")), i.select(F.col("item_id").alias("b"), F.col("suite").alias("q"))
    return a.join(b, F.col("a") + 1 == F.col("b")).select("a", "b", t.name_match(F.col("p"), F.col("q")).cast("double").alias("score"))


_SPLIT = "string_split(trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ')"


@query(f"""WITH i AS (SELECT DISTINCT item_id, {_SPLIT} AS w FROM eval_items WHERE text IS NOT NULL), p AS (SELECT DISTINCT item_id, array_to_string(w[a:a + 4], ' ') AS piece FROM (SELECT item_id, w, unnest([len(w) // 3 + 1, 2, len(w) - 5]) AS a FROM i WHERE len(w) >= 8)),
d AS (SELECT doc_id, {_SPLIT} AS w FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, array_to_string(w[a:a + 4], ' ') AS piece FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS a FROM d WHERE len(w) >= 5))
SELECT DISTINCT doc_id, item_id FROM r JOIN p ON p.piece = r.piece""")
def evd_quotes(spark, d):
    """EVD-1: (doc_id, item_id) of every item quoted by a document, by three pieces of five words."""
    return t.quotes(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query("WITH c AS (SELECT source, count(*) FILTER (relevance = 'core') AS more, count(*) FILTER (relevance = 'method') AS less, count(*) FILTER (relevance = 'peripheral') AS optimum, count(*) AS n FROM documents WHERE relevance IS NOT NULL GROUP BY source) SELECT source, more, less, optimum, n, CASE WHEN n < 3 THEN 'too few' WHEN more >= 0.7 * n THEN 'more' WHEN less >= 0.7 * n THEN 'less' WHEN optimum >= 0.7 * n THEN 'optimum' ELSE 'mixed' END AS consensus FROM c")
def evd_consensus(spark, d):
    """EVD-4, EVD-6: directions counted into a consensus."""
    way = F.when(F.col("relevance") == "core", "more").when(F.col("relevance") == "method", "less").when(F.col("relevance") == "peripheral", "optimum").otherwise("none")
    return t.consensus(table(spark, d, "documents").where("relevance IS NOT NULL").withColumn("way", way), ["source"], "way")


@query("SELECT source, count(DISTINCT section) AS sections, min(year) AS first, max(year) AS last, count(title) AS titled FROM documents GROUP BY source")
def led_rollup(spark, d):
    """LED-5."""
    return table(spark, d, "documents").groupBy("source").agg(F.countDistinct("section").alias("sections"), F.min("year").alias("first"), F.max("year").alias("last"), F.count("title").alias("titled"))


_TAGS = "regexp_replace(text, '<[a-zA-Z/][^<>]*>|\\x1B\\[[0-9;]*m', '', 'g')"


@query(f"SELECT doc_id, md5(trim(regexp_replace({_TAGS}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')) AS squeezed FROM documents")
def txt_squeeze(spark, d):
    """TXT-10: tags and terminal colours out, white space to single blanks; compared by hash."""
    return table(spark, d, "documents").select("doc_id", F.md5(t.squeeze(F.col("text"))).alias("squeezed"))
