"""Language identification: one posterior from text, declared markup language, address and host.

Text: naive Bayes over hashed byte trigrams. Declared tags are folded to their first part in lower case, so ``EN``
and ``en-US`` are ``en``. The languages are all that are declared by a code of two or three letters, however many
(no more than 18,252 such codes exist); each is fitted on a bounded sample of its own rows (about TRAIN_ROWS in all,
but LEAST_ROWS or all rows of each language, chosen by hash, whole texts). The model keeps only trigrams that a
language's sample has. A background class with uniform trigrams stands for what is no language known here.

Declared language: right with probability TRUST, otherwise any other language alike. One outside the
model (no code, or declared only beside empty texts) is a class of its own for its row, with the background's
text likelihood and prior.

Address: hosts get a prior P(language | host), smoothed towards P(language | suffix), which is
smoothed towards P(language). The counts are grouped sums of the text's own decision over all
documents; a document does not count towards its own prior.

Hosts with over HOT rows are not dealt by host when priors are joined, if they are few enough to broadcast.
:func:`from_pages` makes rows of raw web pages: host and suffix from the address, the language that the page's
markup declares, and its visible text.

The weights of the evidence add up as logarithms; the text's is scaled by TEMPER, since trigrams of
a text depend on each other.

Defined results: null or empty text leaves the decision to the other evidence, and is rejected as it
has no language. Blank or null declared languages, and null hosts, say nothing; a null host is a
host of its own. Without a column ``lang`` nothing is declared, without ``source`` all hosts are null. Very long
texts are whole. Ties go to the language first in the alphabet, the background class last. Repeated
rows count each. A corpus without any declared language has only the background class. Extra columns
pass through :func:`keep` untouched. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.shared import materialize, spread

#: About so many labelled rows are used to fit the text model, however large the corpus.
TRAIN_ROWS = 6000
#: But not fewer of any language, as far as it has them.
LEAST_ROWS = 200
BUCKETS = 1 << 16
#: Added to the count of every trigram of every language.
SMOOTH = 0.05
TEMPER = 0.2
TRUST = 0.9
#: Documents that the next wider level of the prior counts for.
STRENGTH = 20.0
UND = "und"
UND_PRIOR = 0.01
#: The background must beat every language by so much for each trigram: rare words alone are not junk.
UND_MARGIN = 1.5
LEAST_CONFIDENCE = 0.5
#: Rows of one host beyond which they stay where they are; hosts that are broadcast at most, of up to eight languages each.
HOT, BROADCAST_HOSTS = 10_000, 50_000


def trigrams(text: str) -> np.ndarray:
    """The hashed buckets of the byte trigrams of lower-cased text, padded by a space on both sides."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(16)).astype(np.int64)


class TextModel(NamedTuple):
    """Log likelihoods: ``base`` of a trigram that a class has not seen, the background last, and what a seen one adds.

    Bucket b's languages and weights are at ``start[b]`` to ``start[b + 1]``.
    """

    base: np.ndarray
    start: np.ndarray
    language: np.ndarray
    weight: np.ndarray

    def score(self, codes: np.ndarray, step: int = 1 << 13) -> np.ndarray:
        out = len(codes) * self.base
        for at in range(0, len(codes), step):
            first = self.start[codes[at : at + step]]
            many = self.start[codes[at : at + step] + 1] - first
            places = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
            out += np.bincount(self.language[places], self.weight[places], len(out))
        return out


def tag(declared: Column) -> Column:
    """The first part of a language tag, in lower case; blank where nothing is declared."""
    return F.coalesce(F.regexp_extract(F.lower(F.trim(declared)), "^[^-_]*", 0), F.lit(""))


def constants(values: list, kind: str) -> Column:
    """A constant array, which is folded when the query is planned, whatever its size."""
    return (F.split(F.lit(" ".join(map(str, values))), " ") if values else F.array()).cast(f"array<{kind}>")


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, text) to (k, bucket, n): counts of each class's buckets, some 2 ** 20 at a time."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held = 0

    def merged() -> pa.RecordBatch:
        found, at = np.unique(np.concatenate([*keys, np.zeros(0, np.int64)]), return_inverse=True)
        n = np.bincount(at, np.concatenate([*counts, np.zeros(0, np.int64)]), len(found)).astype(np.int64)
        keys.clear()
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array((found >> 16).astype(np.int32)), pa.array(found & 0xFFFF), pa.array(n)], names=["k", "bucket", "n"])

    for batch in batches:
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            buckets, n = np.unique(trigrams(text.as_py()), return_counts=True)
            keys.append((k << 16) + buckets)
            counts.append(n)
            held += len(n)
            if held > 1 << 20:
                yield merged()
                held = 0
    yield merged()


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], TextModel]:
    """Language names in the alphabet's order, and the text model of them and the background."""
    declared = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.col("text").cast("string")
    labelled = docs.select(F.xxhash64("doc_id", "text", F.lit(3)).alias("h"), text.alias("text"), tag(declared).alias("lang"))
    labelled = labelled.where(F.col("lang").rlike("^[a-z]{2,3}$") & (F.col("text") != ""))
    # A row for each code of two or three letters at most.
    sizes = sorted((r["lang"], r["count"]) for r in labelled.groupBy("lang").count().collect())
    names = [x for x, _ in sizes]
    each = max(LEAST_ROWS, rows // max(1, len(names)))
    codes = F.broadcast(docs.sparkSession.createDataFrame([(x, k, n) for k, (x, n) in enumerate(sizes)], "lang string, k int, size long"))
    sample = labelled.join(codes, "lang").where(F.pmod("h", "size") < each).select("k", "text")
    # At most BUCKETS rows for each language of the sample.
    found = sample.mapInArrow(count_trigrams, "k int, bucket long, n long").groupBy("bucket", "k").agg(F.sum("n").alias("n")).toPandas()
    found = found.sort_values(["bucket", "k"])
    k, n = found["k"].to_numpy(np.int32), found["n"].to_numpy(float)
    base = np.log(SMOOTH / (np.bincount(k, n, len(names)) + SMOOTH * BUCKETS))
    start = np.searchsorted(found["bucket"].to_numpy(np.int64), np.arange(BUCKETS + 1))
    return names, TextModel(np.append(base, -np.log(BUCKETS) - UND_MARGIN), start, k, np.log1p(n / SMOOTH).astype(np.float32))


def text_scores(docs: DataFrame, table: TextModel) -> DataFrame:
    """doc_id, text_hash, host, declared and the text's log likelihoods; whole texts, in one pass."""
    wide = len(table.base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, wide))
            for i, text in enumerate(batch.column("text")):
                out[i] = table.score(trigrams(text.as_py() or ""))
            likelihood = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) * wide + 1, wide), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "text_hash", "host", "declared")], likelihood], names=["doc_id", "text_hash", "host", "declared", "likelihood"])

    text = F.col("text").cast("string")
    host = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    declared = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), host.alias("host"), declared.alias("declared"), text.alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, text_hash long, host string, declared string, likelihood array<double>")


def best(values: Column) -> Column:
    """The place, from 0, of the largest value; the first of equal ones."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def argmax(values: Column, names: list[str]) -> Column:
    return F.get(constants([*names, UND], "string"), best(values))


def suffix(host: Column) -> Column:
    """The host's last label, where it has more than one."""
    plain = F.regexp_replace(host, "^[a-z]+://|[:/?#].*$", "")
    return F.when(plain.contains("."), F.substring_index(plain, ".", -1)).otherwise("")


def with_priors(scores: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``prior``: smoothed counts of the other documents' decisions, host within suffix within all."""
    n = len(names)
    own = scores.withColumn("k", best(F.col("likelihood"))).withColumn("suffix", F.coalesce(suffix(F.col("host")), F.lit("")))
    own = own.withColumns({"text_lang": F.get(constants([*names, UND], "string"), F.col("k")), "host_key": F.coalesce("host", F.lit("")), "no_host": F.col("host").isNull()})
    keys = ["suffix", "host_key", "no_host"]

    def by_language(counts: DataFrame, *by: str) -> DataFrame:
        """(by, n, rows): for each group an array of its counts by language, and the count with the background's."""
        sums = counts.groupBy(*by, "k").agg(F.sum("n").alias("n")).groupBy(*by)
        out = sums.agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"), F.sum("n").alias("rows"))
        every = F.sequence(F.lit(0), F.lit(n - 1)) if n else F.array().cast("array<int>")
        return out.select(*by, F.transform(every, lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)).cast("double")).alias("n"), "rows")

    counts = materialize(own.groupBy(*keys, "k").agg(F.count("*").alias("n")), "host-counts")
    total = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    whole = constants([float(total.get(k, 0)) for k in range(n)], "double")
    hosts = by_language(counts, *keys).withColumnRenamed("n", "host_n")
    facts = materialize(hosts.join(by_language(counts, "suffix").select("suffix", F.col("n").alias("suffix_n")), "suffix"), "hosts")
    few = lambda df: df.count() * max(8, n) <= 8 * BROADCAST_HOSTS
    if few(facts):
        joined = own.join(F.broadcast(facts), keys)
    else:
        # Fewer than rows / HOT hosts are large; those of all others are dealt by host.
        large = facts.where(F.col("rows") > HOT)
        large = F.broadcast(large) if few(large) else large
        small = own.join(large.select(*keys), keys, "left_anti").join(facts.where(F.col("rows") <= HOT), keys)
        joined = own.join(large, keys).unionByName(small)
    joined = joined.drop("host_key", "no_host", "rows")
    # A document's own decision leaves all three levels.
    mine = lambda i: F.when(F.col("k") == i, 1.0).otherwise(0.0)

    def level(counts: Column, wider: Column) -> Column:
        rest = F.transform(counts, lambda c, i: F.greatest(F.lit(0.0), c - mine(i)))
        size = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(rest, wider, lambda c, w: (c + STRENGTH * w) / (size + STRENGTH))

    even = F.array_repeat(F.lit(1.0 / max(1, n)), n)
    joined = joined.withColumn("p0", level(whole, even)).withColumn("p1", level(F.col("suffix_n"), F.col("p0")))
    return joined.withColumn("prior", level(F.col("host_n"), F.col("p1"))).drop("p0", "p1", "host_n", "suffix_n", "k")


def fuse(scores: DataFrame, names: list[str]) -> DataFrame:
    """Posterior of every class, the language, its confidence, and the verdict."""
    n = len(names)
    declared = tag(F.col("declared"))
    said = declared != ""
    known = F.array_contains(constants(names, "string"), declared)
    others = F.when(known, float(np.log((1 - TRUST) / max(1, n - 1)))).otherwise(float(np.log((1 - TRUST) / max(1, n))))
    by_name = F.transform(constants(names, "string"), lambda x: F.when(~said, 0.0).when(declared == x, float(np.log(TRUST))).otherwise(others))
    markup = F.concat(by_name, F.array(F.when(said, float(np.log(1 / (n + 1)))).otherwise(0.0)))
    prior = F.concat(F.transform("prior", lambda p: F.log(F.greatest(p, F.lit(1e-9)) * (1 - UND_PRIOR))), F.array(F.lit(float(np.log(UND_PRIOR)))))
    total = F.transform(F.arrays_zip(F.col("likelihood").alias("t"), markup.alias("m"), prior.alias("p")), lambda x: TEMPER * x["t"] + x["m"] + x["p"])
    # Last, a declared language that the model does not have: text and prior as the background's.
    outside = F.when(said & ~known, TEMPER * F.get("likelihood", F.lit(n)) + float(np.log(TRUST) + np.log(UND_PRIOR))).otherwise(-1e300)
    out = with_priors(scores, names).withColumn("total", F.concat(total, F.array(outside)))
    norm = F.aggregate(F.transform("total", lambda x: F.exp(x - F.array_max("total"))), F.lit(0.0), lambda a, x: a + x)
    out = out.withColumn("language", F.coalesce(argmax(F.col("total"), names), declared)).withColumn("confidence", 1 / norm)
    # Texts without any word carry only padding trigrams.
    return out.withColumn("kept", (F.col("language") != UND) & (F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("text_hash") != F.xxhash64(F.lit(""))) & (F.col("text_hash") != F.xxhash64(F.lit(None).cast("string"))))


def identify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row for each row of ``docs``: language, confidence, the text's own decision and the verdict."""
    names, table = train(docs, rows)
    return fuse(materialize(text_scores(docs, table), "language"), names)


def keep(docs: DataFrame) -> DataFrame:
    """The rows whose language is known well enough, unchanged."""
    bad = materialize(identify(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_own_bad_id"), F.col("text_hash").alias("_own_bad_hash")).distinct(), "rejected")
    if bad.count() <= 100_000:
        bad = F.broadcast(bad)
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_own_bad_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_own_bad_hash"))
    return docs.join(bad, on, "left_anti")


def from_pages(pages: DataFrame) -> DataFrame:
    """Rows for :func:`identify` from (page_id, url, html): doc_id, text, lang and source."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    lang = F.lower(F.regexp_extract(html, "(?i)<html[^>]*[ \t\n]lang *= *[\"']?([A-Za-z]+)", 1))
    visible = F.regexp_replace(html, "(?is)<(script|style)[^>]*+>.*?</\\1>|<!--.*?-->|<[^>]*+>", " ")
    blank = lambda c: F.when(c != "", c)
    return pages.select(F.col("page_id").cast("long").alias("doc_id"), visible.alias("text"), blank(lang).alias("lang"), blank(host).alias("source"))


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages``, by text, the markup's declaration, and the address's suffix and host."""
    out = identify(from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.select(F.col("doc_id").alias("page_id"), "language", F.round("confidence", 6).alias("confidence"), "text_lang", "declared", "suffix", "host", "kept")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; ``lang`` is the declared language and ``source`` the host."""
    out = identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "language", F.round("confidence", 6).alias("confidence"), "text_lang", "declared", "kept")
