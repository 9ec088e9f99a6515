from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import language as L


def test_held_out_accuracy(docs):
    declared = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    blind = docs.withColumn("lang", declared)
    got = L.identify(blind).join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id").where("declared IS NULL")
    n, right, kept = got.agg(F.count("*"), F.count_if(F.col("language") == F.col("true")), F.count_if(F.col("kept"))).first()
    assert right >= 0.98 * n and kept >= 0.98 * n


def test_evidence_is_fused(spark, docs):
    names, table = L.train(docs)
    assert names == ["de", "en", "es", "fr"]
    rows = [(1, "z", "en", "x.de"), (2, "z", None, "x.de"), (3, "z", "qq", None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    german = docs.where("lang = 'de'").selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "'x.de' AS source")
    french = docs.where("lang = 'fr'").selectExpr("doc_id + 2000 AS doc_id", "text", "lang", "'y.de' AS source")
    scores = L.materialize(L.text_scores(odd.unionByName(german).unionByName(french), table), "t")
    got = {r["doc_id"]: r for r in L.fuse(scores, names).collect()}
    assert got[2]["prior"][0] > 0.5  # the host's documents are German
    assert got[2]["language"] == "de" and abs(sum(got[2]["prior"]) - 1) < 1e-9


def test_junk_and_edges(spark, docs, edge_docs, no_docs):
    junk = spark.createDataFrame([(900, "\x01\x02%$#@!^&*()_+=~`|\\{}[]" * 30, None, "src0")], "doc_id long, text string, lang string, source string")
    both = docs.select("doc_id", "text", "lang", "source").unionByName(junk)
    kept = {r["doc_id"] for r in L.keep(both).collect()}
    assert 900 not in kept and len(kept) >= 0.99 * docs.count()
    out = L.identify(edge_docs)
    assert out.count() == edge_docs.count()
    gone = {r["doc_id"] for r in out.where("NOT kept").collect()}
    assert {1, 2} <= gone and 5 not in gone
    assert L.keep(edge_docs).columns == edge_docs.columns
    assert L.identify(no_docs).count() == 0 and L.keep(no_docs).count() == 0


def test_rare_languages_are_known(spark, docs):
    """Languages come from all declared rows, and one outside the model is evidence still."""
    russian = "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по своему. " * 4
    rare = spark.createDataFrame([(10_000 + i, russian + str(i), "ru", "ru.example") for i in range(5)], "doc_id long, text string, lang string, source string")
    plain = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "source")
    labelled = docs.select("doc_id", "text", "lang", "source").where("doc_id % 2 = 0")
    both = plain.where("doc_id % 2 <> 0").unionByName(labelled).unionByName(rare)
    names, _ = L.train(both, rows=10)
    assert names == ["de", "en", "es", "fr", "ru"]
    judged = lambda: {r["doc_id"]: (r["language"], r["kept"]) for r in L.identify(both, rows=10).where("doc_id >= 10000").collect()}
    assert judged() == dict.fromkeys(range(10_000, 10_005), ("ru", True))
    both = both.withColumn("lang", F.when(F.col("lang") == "ru", "Russian").otherwise(F.col("lang")))
    assert L.train(both, rows=10)[0] == ["de", "en", "es", "fr"]
    assert judged() == dict.fromkeys(range(10_000, 10_005), ("russian", True))


def brute(rows, names):
    """Priors and posteriors in plain Python, from the likelihoods: {doc_id: (prior, posterior)}."""
    n = len(names)
    every, by_suffix, by_host = np.zeros(n), defaultdict(lambda: np.zeros(n)), defaultdict(lambda: np.zeros(n))
    facts = []
    for r in rows:
        like = np.asarray(r["likelihood"])
        plain = (r["host"] or "").split("://")[-1].split("/")[0].split(":")[0].split("?")[0].split("#")[0]
        suffix = plain.rsplit(".", 1)[-1] if "." in plain else ""
        own = np.zeros(n)
        if like.argmax() < n:
            own[like.argmax()] = 1
        facts.append((r, like, suffix, own))
        every += own
        by_suffix[suffix] += own
        by_host[suffix, r["host"]] += own
    out = {}
    for r, like, suffix, own in facts:
        level = lambda counts, wider, own=own: (np.maximum(counts - own, 0) + L.STRENGTH * wider) / (np.maximum(counts - own, 0).sum() + L.STRENGTH)
        p = level(by_host[suffix, r["host"]], level(by_suffix[suffix], level(every, np.full(n, 1 / n))))
        total = L.TEMPER * like + np.append(np.log(p * (1 - L.UND_PRIOR)), np.log(L.UND_PRIOR))
        if r["declared"]:
            known = r["declared"] in names
            wrong = (1 - L.TRUST) / (n - 1 if known else n)
            total += np.log([L.TRUST if x == r["declared"] else wrong for x in names] + [1 / (n + 1)])
        post = np.exp(total - total.max())
        out[r["doc_id"]] = (p, post / post.sum())
    return out


@pytest.mark.parametrize("hosts", [50_000, 0])
def test_fusion_against_plain_python(spark, docs, sf_dir, monkeypatch, hosts):
    """Host within suffix within all, each document without itself; broadcast hosts and dealt ones."""
    monkeypatch.setattr(L, "BROADCAST_HOSTS", hosts)
    monkeypatch.setattr(L, "HOT", 4)
    pages = L.from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    mixed = docs.select((F.col("doc_id") + 5000).alias("doc_id"), "text", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 5 > 0, F.concat("source", F.lit(".de"))).alias("source"))
    both = pages.unionByName(mixed)
    names, table = L.train(both)
    scores = L.materialize(L.text_scores(both, table), "t")
    want = brute(scores.collect(), names)
    got = L.fuse(scores, names).collect()
    assert len(got) == len(want) and Counter(r["suffix"] for r in got).keys() == {"", "com", "net", "org", "de"}
    for r in got:
        prior, post = want[r["doc_id"]]
        assert np.allclose(r["prior"], prior, atol=1e-12)
        best = int(post.argmax())
        assert r["language"] == [*names, L.UND][best] and abs(r["confidence"] - post[best]) < 1e-9


def test_suffix_and_markup_move_the_posterior(spark, docs):
    german = docs.where("lang = 'de'").selectExpr("doc_id", "text", "lang", "concat('h', doc_id, '.de') AS source")
    french = docs.where("lang = 'fr'").selectExpr("doc_id", "text", "lang", "concat('h', doc_id, '.fr') AS source")
    rows = [(9001, "la", None, "new.de"), (9002, "la", None, "new.fr"), (9003, "la", "de", "new.fr"), (9004, "la", None, "new")]
    got = {r["doc_id"]: r for r in L.identify(german.unionByName(french).unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()}
    assert got[9001]["prior"][0] > 0.5 > got[9002]["prior"][0]
    odds = {i: got[i]["total"][0] - got[i]["total"][1] for i in (9001, 9002, 9003, 9004)}  # German over French
    assert odds[9001] > odds[9004] > odds[9002] and odds[9003] > odds[9002] + 1


def test_pages_and_absent_columns(spark, docs):
    page = '<!DOCTYPE html><HTML class="x" lang="DE-at"><head><style>p{}</style></head><body>Guten <b>Tag</b><script>var t="<p>";</script></body></html>'
    rows = [(1, "https://u@Www.Beispiel.DE:80/a?b", page), (2, None, None), (3, "http://h", "<p>plain</p>")]
    got = [tuple(r) for r in L.from_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert [(i, lang, host) for i, _, lang, host in got] == [(1, "de", "www.beispiel.de"), (2, None, None), (3, None, "h")]
    assert got[0][1].split() == ["Guten", "Tag"]
    bare = docs.select("doc_id", "text")
    assert L.identify(bare).count() == docs.count() and {r["language"] for r in L.identify(bare).collect()} <= {L.UND}
    assert L.identify(bare.limit(0)).count() == 0


def test_any_number_of_languages(spark):
    """150 languages: a text is known without a declaration, and the fusion is that of plain Python."""
    rng = np.random.default_rng(5)
    codes = [a + b for a in "abcdefghijklmno" for b in "klmnopqrst"]
    rows, true = [], {}
    for k, code in enumerate(codes):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(60)]
        for i in range(6):
            true[k * 6 + i] = code
            rows.append((k * 6 + i, " ".join(rng.choice(words, 50)), code if i < 3 else None, f"h{k % 40}.{code}" if i % 2 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names, model = L.train(df)
    assert names == sorted(codes) and len(model.base) == 151
    scores = L.materialize(L.text_scores(df, model), "t")
    want = brute(scores.collect(), names)
    got = L.fuse(scores, names).collect()
    assert len(got) == 900
    for r in got:
        prior, post = want[r["doc_id"]]
        assert np.allclose(r["prior"], prior, atol=1e-12) and abs(r["confidence"] - post.max()) < 1e-9
        assert (r["language"], r["kept"]) == (true[r["doc_id"]], True)


def test_text_model_against_a_plain_table(docs):
    """The sparse model's scores are those of a table with a row for each bucket."""
    names, model = L.train(docs)
    counts = np.zeros((L.BUCKETS, len(names)))
    for r in docs.where("text <> ''").collect():
        np.add.at(counts[:, names.index(r["lang"])], L.trigrams(r["text"]), 1)
    table = np.log((counts + L.SMOOTH) / (counts + L.SMOOTH).sum(axis=0))
    for text in ("", "a", "der Hund und the dog " * 2000, "\u0101\u4e00\x00"):
        codes = L.trigrams(text)
        assert np.allclose(model.score(codes)[:-1], table[codes].sum(axis=0), rtol=1e-6)


def test_tags_are_folded(spark, docs):
    tags = F.element_at(F.array(F.upper("lang"), F.concat("lang", F.lit("-US")), F.concat(F.lit(" "), "lang", F.lit("_x")), F.col("lang")), (F.col("doc_id") % 4 + 1).cast("int"))
    folded = docs.withColumn("lang", tags)
    assert L.train(folded)[0] == ["de", "en", "es", "fr"]
    plain = {r["doc_id"]: (r["language"], round(r["confidence"], 9), r["kept"]) for r in L.identify(docs).collect()}
    assert {r["doc_id"]: (r["language"], round(r["confidence"], 9), r["kept"]) for r in L.identify(folded).collect()} == plain
