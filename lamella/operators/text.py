"""Text and evidence operators: slugs, DOIs, tokens, TF-IDF similarity, tiers, quotes, consensus, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def doi(c: Column) -> Column:
    """A DOI in lower case without resolver or label; an arXiv id gets its DOI; null where there is none."""
    found = F.regexp_extract(F.lower(c), r"(10\.\d{4,9}/[^\s,;\"<>]+)", 1)
    arxiv = F.regexp_extract(F.lower(c), r"arxiv:?\s?(\d{4}\.\d{4,5})", 1)
    found = F.regexp_replace(found, r"[.)\]]+$", "")
    return F.when(found != "", found).when(arxiv != "", F.concat(F.lit("10.48550/arxiv."), arxiv))


def squeeze(c: Column) -> Column:
    """Tags and terminal colours out, white space to single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[a-zA-Z/][^<>]*>|\x{1B}\[[0-9;]*m", ""), r"\s+", " "))


def tokens(c: Column) -> Column:
    """Words of letters and digits in lower case, with a plural s taken off words of over three letters."""
    words = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def tfidf(docs: DataFrame, key: str, words: str, min_df: int = 2, sublinear: bool = True) -> DataFrame:
    """(key, term, weight): smoothed idf, length one a document."""
    tf = docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    n = docs.agg(F.count("*").alias("n"))
    f = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    w = tf.join(df, "term").join(F.broadcast(n)).withColumn("w", f * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return w.select(key, "term", (F.col("w") / norm).alias("weight"))


def similar_texts(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, cosine) of documents with a common term, by a join on terms."""
    j = left.select(F.col(a), "term", F.col("weight").alias("_x")).join(right.select(F.col(b), "term", F.col("weight").alias("_y")), "term")
    return j.groupBy(a, b).agg(F.sum(F.col("_x") * F.col("_y")).alias("cosine"))


def tier(c: Column) -> Column:
    """core, method, peripheral or drop by families of words."""
    t = F.lower(c)
    core, method = t.rlike(r"silicon|anode|electrode|graphite"), t.rlike(r"segmentation|detector|threshold|tomography")
    return F.when(core & method, "core").when(core, "method").when(method, "peripheral").otherwise("drop")


def name_match(a: Column, b: Column) -> Column:
    """1 for equal token sets, 0.7 where one holds the other, else 0."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    both = F.size(F.array_intersect(x, y))
    return F.when((both == F.size(x)) & (both == F.size(y)), 1.0).when((both > 0) & ((both == F.size(x)) | (both == F.size(y))), 0.7).otherwise(0.0)


def quote_found(quote: Column, text: Column) -> Column:
    """Whether one of three five-word pieces of the quote stands in the text, punctuation and case aside; under 8 words: false."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    w = F.split(norm(quote), " ")
    piece = lambda at: F.array_join(F.slice(w, at, F.lit(5)), " ")
    hay = F.concat(F.lit(" "), norm(text), F.lit(" "))
    hit = lambda at: F.contains(hay, F.concat(F.lit(" "), piece(at), F.lit(" ")))
    n = F.size(w)
    return F.when(n < 8, False).otherwise(hit(F.floor(n / 3).cast("int") + 1) | hit(F.lit(2)) | hit(n - 5))


def quotes(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of all pairs for which ``quote_found`` holds: the pieces of the items joined with the runs of five words."""
    words = lambda c: F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), " ")
    run = lambda w, at: F.array_join(F.slice(w, at, F.lit(5)), " ")
    three = lambda w: F.when(F.size(w) >= 8, F.array(run(w, F.floor(F.size(w) / 3).cast("int") + 1), run(w, F.lit(2)), run(w, F.size(w) - 5)))
    every = lambda w: F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda at: run(w, at)))
    once = lambda c, of: F.explode(F.array_distinct(F.transform(F.array(words(c)), of)[0]))  # noqa: E731  (the words are made once a text)
    pieces = items.select("item_id", once(F.col("text"), three).alias("piece")).distinct()
    return docs.select("doc_id", once(F.col("text"), every).alias("piece")).join(pieces, "piece").select("doc_id", "item_id").distinct()


def consensus(answers: DataFrame, keys: list[str], direction: str, least: int = 3, share: float = 0.7) -> DataFrame:
    """too few, more, less, optimum or mixed, with the counts."""
    n = lambda v: F.count_if(F.col(direction) == v)
    c = answers.groupBy(*keys).agg(n("more").alias("more"), n("less").alias("less"), n("optimum").alias("optimum"), F.count("*").alias("n"))
    verdict = F.when(F.col("n") < least, "too few").when(F.col("more") >= share * F.col("n"), "more").when(F.col("less") >= share * F.col("n"), "less").when(F.col("optimum") >= share * F.col("n"), "optimum").otherwise("mixed")
    return c.withColumn("consensus", verdict)
