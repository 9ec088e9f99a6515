import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from millrace.llm import pitman_yor as H


def tokens(text):
    return [*(text or "").encode().lower().split(), b" "]


def check(df, part_pairs=H.PART_PAIRS):
    rows = [(r["doc_id"], tokens(r["text"])) for r in df.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in rows if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in rows)
    got = H.score(df, part_pairs).collect()
    assert want == sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)
    return got


def test_query_counts_and_held_out_perplexity(docs):
    got = check(docs)
    for held in (True, False):
        own = [r for r in got if r["held_out"] == held]
        n = sum(r["n_tokens"] for r in own)
        assert sum(r["score"] for r in own) / n > sum(r["base_score"] for r in own) / n + 0.1


def test_edges(edge_docs, no_docs):
    check(edge_docs)
    assert H.score(no_docs).count() == 0


def held_ids(n, start=1000):
    return [i for i in range(start, start + 40 * n) if zlib.crc32(str(i).encode()) % 7 == 2][:n]


def zipf_texts(n, words=30, seed=5):
    rng = np.random.default_rng(seed)
    ids = [i for i in range(3 * n) if zlib.crc32(str(i).encode()) % 7 != 2][:n]
    return [(i, " ".join(f"w{min(words - 1, int(x))}" for x in rng.zipf(1.6, rng.integers(3, 12)))) for i in ids]


def probe_rows(train):
    """Held-out texts that hold every pair of known words, and each word before and after an unseen one."""
    words = sorted({w for _, t in train for w in t.split()}) + ["unseenword"]
    return list(zip(held_ids(len(words)), [" ".join(f"{x} {y}" for y in words) for x in words], strict=True)), words


@pytest.mark.parametrize("part_pairs", [H.PART_PAIRS, 150])
def test_predictions_add_up_to_one(spark, part_pairs):
    """Every word known in training, the end, and one unseen word, from each context: a distribution."""
    train = zipf_texts(60)
    probes, words = probe_rows(train)
    probes += list(zip(held_ids(len(words), 90_000), words, strict=True))  # each before an end
    rows = spark.createDataFrame(train + probes, "doc_id long, text string").coalesce(1)
    p = H.pair_probabilities(rows, part_pairs).toPandas()
    totals = p.groupby("context").agg(total=("p", "sum"), n=("p", "size"))
    totals = totals[totals["n"] == len(words) + 1]  # contexts with every word and the end
    assert len(totals) == len(words)
    assert np.allclose(totals["total"], 1.0, atol=1e-6)


def plain_sampler(train, d, d0, theta, sweeps, burn, seed):
    """One customer at a time, in plain Python: the mean predictive probability of (context, word)."""
    rng = np.random.default_rng(seed)
    pairs = []
    for _, text in train:
        ws = ["", *text.split(), ""]
        pairs += list(zip(ws[:-1], ws[1:], strict=True))
    v = len({w for _, w in pairs})
    rest, root = {}, {}  # (context, word) -> table sizes; word -> table sizes
    t_of, c_of, sizes = Counter(), Counter(), {"t": 0, "c": 0}

    def p0(w):
        own = root.get(w, [])
        return (sum(own) - d0 * len(own) + (theta + d0 * sizes["t"]) / (v + 1)) / (theta + sizes["c"])

    def pick(tables, discount, new):
        weights = np.asarray([n - discount for n in tables] + [new])
        return int(np.searchsorted(np.cumsum(weights), rng.random() * weights.sum()))

    def join(tables, at):
        if at == len(tables):
            tables.append(1)
            return True
        tables[at] += 1
        return False

    def leave(tables):
        at = int(np.searchsorted(np.cumsum(tables), rng.random() * sum(tables), side="right"))
        tables[at] -= 1
        if not tables[at]:
            del tables[at]
            return True
        return False

    def add(u, w):
        tables = rest.setdefault((u, w), [])
        new = (theta + d * t_of[u]) * p0(w)
        c_of[u] += 1
        if join(tables, pick(tables, d, new)):
            t_of[u] += 1
            own = root.setdefault(w, [])
            up = (theta + d0 * sizes["t"]) / (v + 1)
            sizes["c"] += 1
            sizes["t"] += join(own, pick(own, d0, up))

    def remove(u, w):
        c_of[u] -= 1
        if leave(rest[u, w]):
            t_of[u] -= 1
            sizes["c"] -= 1
            sizes["t"] -= leave(root[w])

    for x in pairs:
        add(*x)
    mean = Counter()
    for sweep in range(sweeps):
        for x in pairs:
            remove(*x)
            add(*x)
        if sweep >= burn:
            for u in {u for u, _ in pairs}:
                for w in {w for _, w in pairs}:
                    own = rest.get((u, w), [])
                    mean[u, w] += (sum(own) - d * len(own) + (theta + d * t_of[u]) * p0(w)) / (theta + c_of[u]) / (sweeps - burn)
    return mean


def test_agrees_with_a_plain_sampler(spark):
    import xxhash

    train = zipf_texts(150, 20, 9)
    probes, _ = probe_rows(train)
    rows = spark.createDataFrame(train + probes, "doc_id long, text string").coalesce(1)
    model = H.Model(rows)
    want = plain_sampler(train, model.discount, model.root_discount, H.STRENGTH, 60, 15, 1)
    key = lambda w: int(np.uint64(xxhash.xxh3_64_intdigest(w.encode() or b" ")).view(np.int64))
    want = {(key(u), key(w)): p for (u, w), p in want.items()}
    got = {(r["context"], r["word"]): r["p"] for r in H.pair_probabilities(rows, 200, 12).collect()}
    both = sorted(want.keys() & got.keys())
    assert len(both) > 100
    ratio = np.log([got[k] / want[k] for k in both])
    assert np.abs(ratio).mean() < 0.08 and abs(ratio.mean()) < 0.04


def test_contexts_are_whole_words(spark):
    """Words that end in the same two bytes are contexts apart, and contexts grow with the corpus."""
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    rows = [(i, "running left" if i % 2 else "walking right") for i in train]
    rows += list(zip(held, ["running left", "running right", "walking right", "walking left"], strict=True))
    got = {r["doc_id"]: r["score"] for r in check(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[held[0]] > got[held[1]] + 1 and got[held[2]] > got[held[3]] + 1


@pytest.mark.parametrize(("c", "d", "w"), [(24, 0.6, 10.0), (400, 0.6, 10.0), (400, 0.6, 1.0), (3000, 0.8, 5.0)])
def test_tables_come_from_their_conditional(c, d, w):
    """Against exact weights S(c, t) w ** t: so many others that a dish's own tables do not change w."""
    logs = np.full(c + 2, -np.inf)
    logs[0] = 0.0
    for k in range(1, c + 1):
        stay = logs[1 : k + 1] + np.log(np.maximum(k - 1 - d * np.arange(1, k + 1), 1e-300))
        logs[1 : k + 1] = np.logaddexp(logs[:k], stay)
        logs[0] = -np.inf
    x = logs[1:-1] + np.arange(1, c + 1) * np.log(w)
    p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    mean = (p * np.arange(1, c + 1)).sum()
    sd = (p * (np.arange(1, c + 1) - mean) ** 2).sum() ** 0.5
    t = H.draw(np.full(1500, c), np.full(1500, w), d, np.random.default_rng(3))
    assert abs(t.mean() - mean) < 5 * sd / 1500**0.5 and 0.85 < t.std() / sd < 1.15


def test_places_beyond_three_bytes():
    for values in ([], [0, 5, (1 << 24) - 1], [3, 1 << 24, (1 << 32) - 1]):
        assert H.wide(H.narrow(np.asarray(values, np.uint32))).tolist() == values


def test_split_contexts_lose_nothing(docs):
    """With partitions so small that frequent words are split, counts and scores are whole."""
    few = {r["doc_id"]: r["score"] for r in check(docs)}
    many = {r["doc_id"]: r["score"] for r in check(docs, 20_000)}
    a, b = np.asarray([[few[i], many[i]] for i in few]).T
    assert abs(a.sum() / b.sum() - 1) < 0.01
