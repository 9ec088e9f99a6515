import functools
import re
from collections import Counter, defaultdict

import pytest

from millrace.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def check(df):
    want = Counter((r["doc_id"], *brute(r["text"])) for r in df.collect())
    got = Q.measured(df).collect()
    assert want == Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got)
    assert all(not r["kept"] for r in got if r["base_failed"])
    return got


def test_query_against_brute_force(docs):
    check(docs)


def test_edges(edge_docs, no_docs, spark):
    check(edge_docs)
    assert Q.measured(no_docs).count() == 0 and Q.keep(no_docs).count() == 0
    odd = ["a b c d e " * 9, "x " * 30, "\x1c\x85 a b", "1\n1\n\n 1\n", "a b c d e f a b c d e", "#*$%&|<> é"]
    check(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").selectExpr("*", "'h' AS source"))
    kept = Q.keep(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {5, 6, 7, None}


def test_common_lines_go_and_copies_stay(spark):
    text = lambda i, k: "\n".join(" ".join(f"t{i}l{j}w{n}" for n in range(12)) for j in range(k))
    legal = "All RIGHTS  reserved by nobody at all in this\tplace here"
    rows = [(i, text(i, 3) + "\n" + legal, "h") for i in range(40)]
    rows += [(100, "short own\n" + legal, "h")]  # depleted
    rows += [(200 + i, text(777, 4), "h") for i in range(40)]  # copies of one document
    rows += [(300, text(300, 2) + "\n" + legal, "other"), (301, legal + "\n" + text(301, 2), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "length(text) AS n_chars")
    facts = Q.materialize(Q.statistics(df), "t")
    gone = Q.removed_lines(facts, limit=20)
    assert {r["doc_id"] for r in gone.collect()} == {*range(40), 100}
    judged = {r["doc_id"]: r for r in Q.judge(facts, gone).collect()}
    assert not judged[100]["base_failed"] and not judged[100]["kept"]
    assert all(judged[i]["kept"] for i in [*range(40), *range(200, 240), 300, 301])
    assert judged[0]["removed_words"] == 11


def test_keep_cuts_lines(spark, monkeypatch):
    monkeypatch.setattr(Q, "removed_lines", lambda facts, **_: Q.materialize(facts.where("doc_id = 1").selectExpr("doc_id", "array(lines[0].h) AS gone"), "t"))
    body = "\n".join(" ".join(f"l{j}w{n}" for n in range(12)) for j in range(3))
    df = spark.createDataFrame([(1, "Drop  ME\n" + body, "h", 5), (2, "Drop me\n" + body, "h", 6)], "doc_id long, text string, source string, n_chars int")
    out = {r["doc_id"]: r for r in Q.keep(df).collect()}
    assert out[1]["text"] == body and out[1]["n_chars"] == len(body)
    assert out[2]["text"].startswith("Drop") and out[2]["n_chars"] == 6


def test_shared_blocks_go_and_copies_do_not_count(spark):
    """Boilerplate of several lines is told from copies by whole texts, not by another of its own lines."""
    own = lambda i: "\n".join(" ".join(f"t{i}l{j}w{n}" for n in range(12)) for j in range(3))
    block = "\n".join(f"Licence clause number {j} which all of these pages carry" for j in range(6))
    rows = [(i, block + "\n" + own(i), "h") for i in range(300)]
    # Two texts that share a line, of which there are many copies: two documents.
    rows += [(1000 + i, own(5000 + i % 2) + "\na line of two much copied documents", "h") for i in range(300)]
    facts = Q.materialize(Q.statistics(spark.createDataFrame(rows, "doc_id long, text string, source string")), "t")
    gone = {r["doc_id"]: len(r["gone"]) for r in Q.removed_lines(facts, limit=100).collect()}
    assert gone == dict.fromkeys(range(300), 6)


def test_one_limit_at_every_host_size(spark):
    own = lambda i: " ".join(f"t{i}w{n}" for n in range(12))
    rows = [(i, own(i) + ("\nin many pages of a small host" if i < 66 else "\nin few" if i < 80 else ""), "small") for i in range(500)]
    rows += [(1000 + i, own(i + 1000) + ("\nin few pages of a large host" if i < 30 else ""), "large") for i in range(3000)]
    facts = Q.materialize(Q.statistics(spark.createDataFrame(rows, "doc_id long, text string, source string")), "t")
    assert {r["doc_id"] for r in Q.removed_lines(facts).collect()} == {*range(66), *range(1000, 1030)}


def plain_rule(rows):
    """{doc_id: (removed words, kept)} by sets and counts in plain Python."""
    squeeze = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()
    lines = {r["doc_id"]: [x for x in map(squeeze, (r["text"] or "").split("\n")) if x] for r in rows}
    have = defaultdict(set)
    for r in rows:
        for x in lines[r["doc_id"]]:
            have[r["source"], x].add(tuple(lines[r["doc_id"]]))
    out = {}
    for r in rows:
        n, _, _, _, _, failed = brute(r["text"])
        lost = sum(len(x.split(" ")) for x in lines[r["doc_id"]] if len(have[r["source"], x]) > Q.LIMIT)
        out[r["doc_id"]] = (lost, not failed and not (lost and (n - lost < 10 or n - lost < 0.3 * n)))
    return out


@pytest.mark.parametrize("hot", [20])
def test_line_rule_against_a_plain_count(spark, sf_dir, monkeypatch, hot):
    """Over 10,000 documents, of which over a thousand lose lines, with lines dealt by key and broadcast ones."""
    monkeypatch.setattr(Q, "with_facts", functools.partial(Q.with_facts, hot=hot))
    docs = spark.read.parquet(f"{sf_dir}/../sf0.1/documents.parquet")
    want = plain_rule(docs.collect())
    got = {r["doc_id"]: (r["removed_words"], r["kept"]) for r in Q.measured(docs).collect()}
    assert got == want
    assert sum(lost > 0 for lost, _ in want.values()) > 1000
    kept = {r["doc_id"]: len(WORD.findall(r["text"])) for r in Q.keep(docs).collect()}
    words = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs.collect()}
    assert kept == {i: words[i] - lost for i, (lost, stays) in want.items() if stays}


def test_very_long_text_and_line(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    own = lambda i: " ".join(f"t{i}w{n}" for n in range(12))
    rows = [(i, own(i) + "\n" + long, "h") for i in range(Q.LIMIT + 1)] + [(99, long.replace(" ", "\n"), "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r["doc_id"]: (r["removed_words"], r["kept"]) for r in Q.measured(df).collect()} == plain_rule(rows_of(df))


def rows_of(df):
    return [r.asDict() for r in df.collect()]
