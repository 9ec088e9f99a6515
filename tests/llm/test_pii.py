import hashlib
import random
import re

from millrace.llm import pii as D

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def fine(kind, match):
    digits = [int(c) for c in match if c.isdigit()]
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    turned = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(digits[::-1])]
    return 13 <= len(digits) <= 19 and sum(turned) % 10 == 0


def base(text):
    spans = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if fine(k, m[0])]
    counts = tuple(sum(s[0] == k for s in spans) for k in BASE)
    return *counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def check(df):
    want = sorted((str(r["doc_id"]), *base(r["text"])) for r in df.collect())
    got = D.digest(D.detect(df)).collect()
    assert want == sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got)
    return {r["doc_id"]: r for r in got}


def test_query_against_brute_force(docs):
    check(docs)


def test_edges(edge_docs, no_docs):
    check(edge_docs)
    assert D.detect(no_docs).count() == 0 and D.redact(no_docs).count() == 0
    assert D.redact(edge_docs).columns == edge_docs.columns


def test_random_and_hostile_texts(spark):
    rng = random.Random(1)
    parts = ["1", "2", "25", "4111 1111 1111 1111", "255.", "256", "0", ".", "@", "-", " ", "+", "(", ")", "a", "b.c", "é", "😀", "%", "_", "x@y.z", "\n", "5500005555555559", "1.2.3.4", "+49 (30) 123-45 67", "@a.b_"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(3000)]
    rows += [(9001, "1 2 " * 30_000), (9002, "a" * 100_000), (9003, "a@b" + ".c" * 30_000), (9004, "9" * 50_000), (9005, "+1" * 20_000), (9006, "1." * 30_000), (9007, "AB12 " * 20_000)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_iban_context_and_redaction(spark):
    rows = [(1, "bank account GB29 NWBK 6016 1331 9268 19 now"), (2, "code GB29 NWBK 6016 1331 9268 18 now"), (3, "DE89370400440532013000"), (4, "call +49 30 1234567 or a@b.cd"), (5, "score +49 30 1234567")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) AS n_chars")
    out = check(df)
    assert [out[i]["n_iban"] for i in range(1, 6)] == [1, 0, 1, 0, 0]
    assert out[1]["spans"] == "iban:13:40" and out[4]["top_score"] > out[5]["top_score"]
    clean = {r["doc_id"]: r for r in D.redact(df).collect()}
    assert clean[1]["text"] == "bank account <IBAN> now" and clean[4]["text"] == "call <PHONE> or <EMAIL>"
    assert clean[4]["n_chars"] == 23 and clean[2]["text"] == rows[1][1]


def test_card_of_single_digits(spark):
    rows = [(i, f"my card {s.join('4' + '1' * 15)} thanks") for i, s in enumerate((" ", "-"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["n_card"] for r in check(df).values()] == [1, 1]
    assert {r["text"] for r in D.redact(df).collect()} == {"my card <CARD> thanks"}


def test_many_spans_take_steps_in_proportion(spark):
    """20,000 spans in one text: found, and redacted, in seconds."""
    import time

    unit = "é mail a@b.cd, call +1 234 567 8901; "
    df = spark.createDataFrame([(1, unit * 10_000), (2, unit * 130), (3, unit * 128)], "doc_id long, text string").repartition(2)
    began = time.time()
    got = check(df)
    assert (got[1]["n_email"], got[1]["n_phone"]) == (10_000, 10_000) and got[3]["n_email"] == 128
    texts = {r["doc_id"]: r["text"] for r in D.redact(df).collect()}
    assert time.time() - began < 30
    assert texts == {i: "é mail <EMAIL>, call <PHONE>; " * n for i, n in ((1, 10_000), (2, 130), (3, 128))}
