"""Exact-identifier lookup and BM25 phrase ranking.

An unquoted query is one exact term; a quoted one is a phrase. Exact terms are looked up in an inverted table,
sorted by term, so files and row groups of other terms are not read. A phrase over texts without an index takes one pass for
statistics and one for scores, with no shuffle before the top-k; :mod:`positions` has the index.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.plans.shared import spread

K1, B = 1.2, 0.75
LIMIT = 100
PLACES = 6


def exact_lookup(postings: DataFrame, queries: DataFrame, id_column: str = "id") -> DataFrame:
    """(query_id, id, n_identifiers): records that have a query's one term among their identifiers.

    ``postings`` has ``identifiers``; ``queries`` has query_id and text. Records with fewer
    identifiers come first, then smaller ids.
    """
    terms = queries.where(~T.is_quoted(F.col("text"))).select("query_id", T.exact_term(F.col("text")).alias("term"))
    rows = postings.select(F.col(id_column).alias("id"), F.size("identifiers").alias("n_identifiers"), F.explode(F.array_distinct("identifiers")).alias("term"))
    return rows.join(terms, "term").select("query_id", "id", "n_identifiers")


def inverted(postings: DataFrame, id_column: str = "id", *more: str) -> DataFrame:
    """(term, id, n_identifiers, more) of every distinct identifier; to be stored in ranges of terms."""
    return postings.select(F.explode(F.array_distinct("identifiers")).alias("term"), F.col(id_column).alias("id"), *more, F.size("identifiers").alias("n_identifiers"))


#: Terms that are pushed into the scan as a list; more are joined.
LISTED_TERMS = 1000


def term_lookup(terms: DataFrame, queries: DataFrame, *more: str) -> DataFrame:
    """As :func:`exact_lookup`, from a stored table of :func:`inverted`, with ``more`` of its columns."""
    asked = queries.where(~T.is_quoted(F.col("text"))).select("query_id", T.exact_term(F.col("text")).alias("term"))
    some = asked.select("term").distinct().limit(LISTED_TERMS + 1).collect()
    if len(some) > LISTED_TERMS:
        return terms.join(asked, "term").select("query_id", "id", "n_identifiers", *more)
    rows = terms.where(F.col("term").isin([r["term"] for r in some]))
    return rows.join(F.broadcast(asked) if asked.count() <= 10 * LISTED_TERMS else asked, "term").select("query_id", "id", "n_identifiers", *more)


_TERM = "[\\p{L}\\p{N}]"


def phrase_pattern(words: list[str]) -> str:
    """A pattern that matches the first token of each place where the tokens stand side by side.

    The other tokens are looked ahead at, so places may overlap.
    """
    rest = "".join(f"[^\\p{{L}}\\p{{N}}]+{w}" for w in words[1:])
    return f"(?<!{_TERM}){words[0]}(?={rest}(?!{_TERM}))"


def length(lowered: Column) -> Column:
    """The number of tokens, counted without making them."""
    return F.regexp_count(lowered, F.lit(f"{_TERM}+"))


def corpus_statistics(texts: DataFrame, words: list[str]) -> dict:
    """N, mean length and each term's document frequency, by one aggregation over (id, lowered)."""
    # A substring test is cheap, and most documents that fail a term fail it.
    has = lambda w: F.contains("lowered", F.lit(w)) & F.col("lowered").rlike(phrase_pattern([w]))
    counts = [F.count_if(has(w)).alias(f"df{k}") for k, w in enumerate(words)]
    return texts.agg(F.count("*").alias("n"), F.avg(length(F.col("lowered"))).alias("mean"), *counts).first().asDict()


def bm25_phrase(docs: DataFrame, phrase: str, id_column: str = "id", text_column: str = "content", limit: int = LIMIT) -> DataFrame:
    """(id, tf, dl, score) of the best documents that hold the phrase; scores have PLACES decimals.

    The phrase's weight is the sum of its terms' inverse document frequencies. Tokens are counted by
    patterns inside generated code; no token arrays are made.
    """
    session = docs.sparkSession
    words = [r["w"] for r in session.range(1).select(F.explode(T.unicode_tokens(F.lit(phrase))).alias("w")).collect()]
    if not words:
        return session.createDataFrame([], f"{id_column} {dict(docs.dtypes)[id_column]}, tf int, dl int, score double")
    texts = spread(docs.select(id_column, F.lower(F.col(text_column)).alias("lowered")))
    stats = corpus_statistics(texts, words)
    n, mean = stats["n"], stats["mean"] or 1.0
    idf = reduce(lambda a, b: a + b, [F.log(F.lit(1 + (n - stats[f"df{k}"] + 0.5) / (stats[f"df{k}"] + 0.5))) for k in range(len(words))])
    likely = reduce(lambda a, b: a & b, [F.contains("lowered", F.lit(w)) for w in words])
    found = texts.where(likely).withColumn("tf", F.regexp_count("lowered", F.lit(phrase_pattern(words)))).where("tf > 0")
    found = found.select(id_column, "tf", length(F.col("lowered")).alias("dl"))
    tf = F.col("tf").cast("double")
    score = idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("dl") / mean))
    found = found.withColumn("score", F.round(T.finite(score), PLACES))
    return found.orderBy(F.desc("score"), id_column).limit(limit)


def mode_preferred(mode: str, metadata: Column) -> Column:
    """Whether a record's metadata suits the mode."""
    if mode == "current":
        return F.coalesce((metadata["alignment"] == "CURRENT") | (metadata["lifecycle"] == "current"), F.lit(False))
    if mode == "design":
        return F.coalesce(metadata["alignment"] == "DESIGN", F.lit(False))
    return F.lit(False)


def rerank(hits: DataFrame, preferred: Column, id_column: str = "id", by: str | None = None) -> DataFrame:
    """Adds ``rank``: preferred first, then score, then id; within ``by`` if given."""
    window = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc(preferred), F.desc("score"), id_column)
    return hits.withColumn("rank", F.row_number().over(window))
