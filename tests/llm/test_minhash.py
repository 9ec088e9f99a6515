import random

import numpy as np

from millrace.llm import minhash as M


def sets_of(rows, k):
    out = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def brute(rows, k):
    sets = sets_of(rows, k)
    label = {i: i for i in sets}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def check(spark, rows, k):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in M.classify(df, k).collect()}
    assert got == brute(rows, k)


def test_copies_edits_chains_and_edges(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "One"), (4, "one "), (5, "two words"), (6, "Two  Words")]
    n = 10
    for size in (12, 60, 400):
        base = [rng.choice(words) for _ in range(size)]
        chain = base[:]
        for step in range(25):
            copy = base[:]
            for _ in range(max(1, int(size * rng.uniform(0, 0.09)))):
                copy[rng.randrange(size)] = f"e{rng.random()}"
            rows.append((n, " ".join(copy)))
            chain[rng.randrange(size)] = f"c{step}"
            rows.append((n + 1, " ".join(chain)))
            n += 2
    rows += [(n + i, " ".join(rng.choice(words) for _ in range(80))) for i in range(40)]
    check(spark, rows, 2)
    check(spark, rows, 5)


def test_query_against_brute_force(spark, docs):
    check(spark, [tuple(r) for r in docs.select("doc_id", "text").collect()], 2)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    b = np.concatenate([a[:3000], rng.integers(0, 2**63, 1000, dtype=np.uint64)])
    same = (M.signature(a, 2000) == M.signature(b, 2000)).mean()
    assert abs(same - 3000 / 5000) < 0.05
    assert (M.signature(a) == M.signature(a[::-1].copy())).all()


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(3)
    for n in (5, 300, 9000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[: n - n // 5], rng.integers(0, 2**63, n // 7, dtype=np.uint64)])
        x, y = (np.frombuffer(M.parity(s), np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(set(a) ^ set(b))


def test_keep_and_edges(spark, edge_docs, no_docs):
    kept = M.keep(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, 6, None], key=str)
    assert M.classify(no_docs, 2).count() == 0 and M.keep(no_docs).count() == 0
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert [r["doc_id"] for r in M.keep(twice).collect()] == [1]
    assert M.classify(twice, 2).count() == 3


def test_texts_under_one_id_keep_their_links(spark):
    """A repeated doc_id with two texts: both texts' near copies are found, and neither text is lost."""
    rng = random.Random(4)
    a, b, c = ([f"{x}{rng.randrange(500)}" for _ in range(120)] for x in "abc")
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, near(c)), (5, " ".join(c)), (5, " ".join(a))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in M.classify(df, 2).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 1), (5, 4)]
    kept = sorted((r["doc_id"], r["text"]) for r in M.keep(df, 2).collect())
    assert kept == sorted([(1, " ".join(a)), (1, " ".join(b)), (4, near(c))])


def test_one_id_with_texts_of_one_set_stays_once(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "A b c d e F"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert len(M.keep(df).collect()) == 1


def test_large_buckets_of_unlike_texts_are_split(spark, monkeypatch):
    """Half of every text is shared, so chance buckets are large; links among them stay whole."""
    monkeypatch.setattr(M, "HOT", 6)
    monkeypatch.setattr(M, "SPLIT", 5)
    monkeypatch.setattr(M, "SPLIT_ROUND", 1)
    splits, split = [], M.split_bands
    monkeypatch.setattr(M, "split_bands", lambda *args: splits.append(1) or split(*args))
    rng = random.Random(7)
    common = [f"c{i}" for i in range(170)]
    rows = []
    for i in range(60):
        own = [f"o{i}x{j}" for j in range(50)]
        rows += [(2 * i, " ".join([*common, *own])), (2 * i + 1, " ".join([*common, *own[:-3], f"z{rng.random()}"]))]
    check(spark, rows, 2)
    assert splits
