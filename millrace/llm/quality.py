"""Quality rules: base word statistics, and lines that many documents of one host share.

Native: DataFrame functions alone. The statistics are computed within each row by higher-order
functions, so whole texts never move. For cross-document frequency, lines are normalised (lower
case, runs of white space to one space, trimmed) and hashed. A digest of all of a document's
normalised lines in order tells documents apart: what is counted for a (host, line) is distinct digests,
so copies of one document count once, and are left to deduplication. Distinct (host, line, digest) are
found before and after a shuffle by all three, so a host with a third of all rows is no burden. A line
is removed where more than LIMIT different documents of its host have it, however large the host. A
document is rejected as depleted if lines were removed and what is left has under LEAST_WORDS words, or
under LEAST_SHARE of its words.

Defined results: null or empty text has no words, so it fails the base rules. A null source is a host
of its own. Rows with one text on one host count as one document; rows with one doc_id share the set of
removed lines. A null doc_id loses no lines. Very long texts and lines are whole. There are no ties: a line over the limit goes
wherever it is. Extra columns pass through :func:`keep` untouched, also those named like
the statistics. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.shared import materialize, with_facts

SPACE = "[\\x20\\x09-\\x0D]+"
#: A line is removed where more different documents of its host have it, whatever the size of the host.
LIMIT = 20
LEAST_WORDS = 10
LEAST_SHARE = 0.3
WINDOW = 5


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(w: Column, window: int = WINDOW) -> Column:
    """Words that stand in a window which the text has twice or more, from hashed windows.

    The hashes are sorted with their places; a place counts where a neighbour has the same hash.
    Each such place covers words up to its window's end or to the next place.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    def twice(o: Column) -> Column:
        same = F.transform(o, lambda x, k: F.when((F.get(o, k - 1)["h"] == x["h"]) | (F.get(o, k + 1)["h"] == x["h"]), x["i"]))
        return F.sort_array(F.filter(same, lambda i: i.isNotNull()))

    def covered(places: Column) -> Column:
        start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(let(placed, twice)))

    return F.when(F.size(w) <= window, F.lit(0)).otherwise(let(hashes, count))


def line_facts(text: Column) -> Column:
    """(hash of the normalised line, its words) for each line with a word."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.lower(F.trim(F.regexp_replace(x, SPACE, " "))))
    return F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n")))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, source, the base statistics, and the lines' hashes and sizes."""
    text = text_of()
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        let(
            words(text),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words")),
        ).alias("w"),
        F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        line_facts(text).alias("lines"),
    )
    out = out.select("doc_id", "source", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "lines")
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def host_lines(facts: DataFrame, *more: str) -> DataFrame:
    """(host, no_host, h, more): the different lines of each row."""
    host = [F.coalesce("source", F.lit("")).alias("host"), F.col("source").isNull().alias("no_host")]
    return facts.select(*more, *host, F.xxhash64("lines.h").alias("digest"), F.explode(F.array_distinct("lines.h")).alias("h"))


def common_lines(facts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(host, no_host, h, n): the lines that over ``limit`` different documents of a host have, and their rows."""
    seen = host_lines(facts).groupBy("host", "no_host", "h", "digest").agg(F.count("*").alias("n"))
    lines = seen.groupBy("host", "no_host", "h").agg(F.count("*").alias("documents"), F.sum("n").alias("n"))
    return lines.where(F.col("documents") > limit).drop("documents")


def removed_lines(facts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id and the hashes of its removed lines, for documents that lose any; written once.

    A line that a third of all rows have is not dealt by key.
    """
    common = materialize(common_lines(facts, limit), "common-lines")
    hit = with_facts(host_lines(facts.where("doc_id IS NOT NULL"), "doc_id"), common, "host", "no_host", "h")
    return materialize(hit.groupBy("doc_id").agg(F.collect_set("h").alias("gone")), "removed-lines")


def small(removed: DataFrame, hashes: int = 200_000) -> DataFrame:
    """Broadcast ``removed`` only if all its sets together are found to be small; else joins shuffle."""
    held = removed.agg(F.sum(4 + F.size("gone")).alias("n")).first()["n"] or 0
    return F.broadcast(removed) if held <= hashes else removed


def judge(facts: DataFrame, removed: DataFrame) -> DataFrame:
    """Adds ``removed_words`` and ``kept`` to the rows of :func:`statistics`."""
    gone = F.coalesce(F.col("gone"), F.array().cast("array<bigint>"))
    lost = F.aggregate(F.filter("lines", lambda x: F.array_contains(gone, x["h"])), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    out = facts.join(small(removed), "doc_id", "left").withColumn("removed_words", lost)
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < LEAST_WORDS) | (left < LEAST_SHARE * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def measured(docs: DataFrame) -> DataFrame:
    """Verdicts and statistics of all rows."""
    facts = materialize(statistics(docs), "quality")
    return judge(facts, removed_lines(facts))


def keep(docs: DataFrame) -> DataFrame:
    """The rows that pass, with removed lines gone from ``text`` and ``n_chars`` brought up to date.

    The verdict is computed in each row again, so only removed lines' hashes are joined.
    """
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), line_facts(text_of()).alias("lines"))
    removed = removed_lines(materialize(lines, "lines"))
    own = F.struct([F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("row")
    text = text_of("row.text")
    joined = docs.select(own, F.col("doc_id").cast("long").alias("doc_id")).join(small(removed), "doc_id", "left")
    gone = F.coalesce(F.col("gone"), F.array().cast("array<bigint>"))
    w = let(words(text), lambda x: F.struct(F.size(x).alias("n"), repeat_words(x).alias("r")))
    lost = F.aggregate(F.filter(line_facts(text), lambda x: F.array_contains(gone, x["h"])), F.lit(0), lambda a, x: a + x["n"])
    judged = joined.select("row", "gone", w.alias("w"), F.when(F.col("gone").isNull(), F.lit(0)).otherwise(lost).alias("lost"))
    left = F.col("w.n") - F.col("lost")
    failed = (F.col("w.n") < LEAST_WORDS) | (100 * F.col("w.r") > 20 * F.col("w.n"))
    depleted = (F.col("lost") > 0) & ((left < LEAST_WORDS) | (left < LEAST_SHARE * F.col("w.n")))
    normal = lambda x: F.xxhash64(F.lower(F.trim(F.regexp_replace(x, SPACE, " "))))
    cleaned = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(F.col("gone"), normal(x))), "\n")
    kept = judged.where(~failed & ~depleted).withColumn("clean", F.when(F.col("lost") > 0, cleaned).otherwise(F.col("row.text")))
    kinds = dict(docs.dtypes)
    own_or = {"text": F.col("clean").cast(kinds["text"])}
    if "n_chars" in kinds:
        own_or["n_chars"] = F.when(F.col("lost") > 0, F.char_length("clean").cast(kinds["n_chars"])).otherwise(F.col("row.n_chars"))
    return kept.select([own_or.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
    SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d
), windows AS (
    SELECT r, i, w[i : i + 4] AS five FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)
), twice AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS n FROM windows) WHERE n > 1
), repeated AS (
    SELECT r, count(DISTINCT i + j) AS n FROM twice, range(0, 5) AS x(j) GROUP BY r
), raw_lines AS (
    SELECT r, unnest(string_split(t, chr(10))) AS line FROM d
), lines AS (
    SELECT r, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS plain FROM raw_lines
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), counted AS (
    SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r
), texts AS (
    SELECT d.r, d.doc_id, d.source, trim(regexp_replace(lower(regexp_replace(d.t, '[\x20\x09\x0B-\x0D]+', ' ', 'g')), ' *\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS whole FROM d
), common AS (
    SELECT source, plain FROM (SELECT DISTINCT texts.source, lines.plain, texts.whole FROM texts JOIN lines USING (r)) GROUP BY source, plain HAVING count(*) > 20
), hit AS (
    SELECT DISTINCT d.doc_id, lines.plain FROM d JOIN lines USING (r) JOIN common ON lines.plain = common.plain AND d.source IS NOT DISTINCT FROM common.source
), lost AS (
    SELECT d.r, sum(len(string_split(lines.plain, ' '))) AS n FROM d JOIN lines USING (r) JOIN hit ON d.doc_id = hit.doc_id AND lines.plain = hit.plain GROUP BY d.r
), facts AS (
    SELECT d.doc_id, len(w.w) AS n_words, length(regexp_replace(d.t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(d.t) - length(translate(d.t, '#*$%&|<>', '')) AS n_symbols, coalesce(counted.n_dup_lines, 0) AS n_dup_lines,
        coalesce(repeated.n, 0) AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS removed_words
    FROM d JOIN w USING (r) LEFT JOIN counted USING (r) LEFT JOIN repeated USING (r) LEFT JOIN lost USING (r)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (removed_words > 0 AND (n_words - removed_words < 10 OR n_words - removed_words < 0.3 * n_words)) AS kept
FROM facts
"""


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` under the production limits."""
    out = measured(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")
