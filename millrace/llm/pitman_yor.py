"""Hierarchical Pitman-Yor language model: seating by Gibbs sampling, averaged predictions as scores.

Restaurants. A word is drawn in the restaurant of its context, the whole word before it (the end token
before the first). All contexts share one parent, the root restaurant, over a uniform base of the
vocabulary and one unseen word. Contexts and dishes are unbounded: every pair of words of every training
document is counted. Each level's discount is Ney's estimate n1 / (n1 + 2 * n2) from its own counts.

Seating. The sampler is a blocked Gibbs sampler that needs no estimate of another partition's state.
Given the root's measure G, contexts are independent. For each context x ~ Gamma(tables + strength /
discount) is drawn; given it, each dish's number of tables has probability in proportion to
S(c, t) * (discount * x * G(dish)) ** t for its c customers (S: generalised Stirling numbers), independent of
all other dishes. Tables are customers of the root, whose tables are drawn alike, and G is then drawn
anew: a Gamma variable of (customers - discount * tables) for each dish, and one of (strength +
discount * all tables) for what has no table, spread over the base. S is exact up to EXACT customers; beyond, t - 1 is
Poisson or normal by the saddle point of its generating function (the tests compare both with exact rows).
Sweeps go on until no level's total of tables changes by over SETTLED; then SAMPLES seatings are kept,
and a text's probability is the average over them.

Scale. Documents are coded in blocks of bounded size. A block sends its distinct (context, word) counts to
the partitions of the contexts, so what moves follows distinct pairs, not tokens. The number of
partitions follows a count of pairs, so each takes about PART_PAIRS of them. Contexts with more than a
partition's share of the pairs are split by word; only their sums (at most one row for each partition)
pass the driver. Dishes of the root live in coarser partitions by word; in each sweep partitions send
them sums and get values of G, in an order that was fixed once, for words that some context has twice or more.
All tables are written to the shared folder between steps.

Defined results: null or empty text is its end token alone. Very long texts are whole within one block,
whose places take four bytes beyond 2 ** 24 pairs. Rows with a null doc_id are held out by no rule and train.
Repeated rows count each; nothing depends on ties. Extra columns are not read. Without training tokens
every word has the base probability. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.shared import materialize, remove, spread

#: The end of a text: no word can hold a space.
END = b" "
STRENGTH = 1.0
SAMPLES = 2
#: Seatings burn in for BURN sweeps at least, and until no level's tables change by more than this share.
BURN = 3
SETTLED = 0.01
MOST_BURN = 30
#: Customers up to which Stirling numbers are exact.
EXACT = 256
BLOCK_BYTES = 12 << 20
#: Pairs of blocks that one partition takes; neighbouring partitions whose words share a partition of the root.
PART_PAIRS = 1_500_000
GROUP = 8
#: Inputs of more pairs than this take a partition for each core at least.
SMALL = 100_000


def squeezed(raw: bytes) -> bytes:
    """Compressed by entropy, which the shuffle's own codec does not do."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(raw)


def opened(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def u32(packed: bytes) -> np.ndarray:
    return np.frombuffer(opened(packed), np.uint32)


def pack32(values: np.ndarray) -> bytes:
    return squeezed(values.astype(np.uint32).tobytes())


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, place of each among them), by one sort."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.ones(len(ranked), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    at = np.empty(len(ranked), np.uint32)
    at[order] = np.cumsum(new) - 1
    return ranked[new], at


def narrow(values: np.ndarray) -> bytes:
    """Unsigned numbers as three bytes each, or four if one needs them, by place; the first byte says which."""
    size = 3 if not len(values) or int(values.max()) < 1 << 24 else 4
    return bytes([size]) + values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :size].T.tobytes()


def wide(packed: bytes) -> np.ndarray:
    size = packed[0]
    out = np.zeros(((len(packed) - 1) // size, 4), np.uint8)
    out[:, :size] = np.frombuffer(packed, np.uint8, offset=1).reshape(size, -1).T
    return out.view("<u4").ravel()


def pack_rising(places: np.ndarray) -> bytes:
    """Rising numbers by their differences."""
    return squeezed(narrow(np.diff(places, prepend=0)))


def rising(packed: bytes) -> np.ndarray:
    return np.cumsum(wide(opened(packed)), dtype=np.int64)


def pack48(keys: np.ndarray) -> bytes:
    """Keys below 2 ** 48 as six bytes each."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def keys48(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def cuts(keys: np.ndarray, partitions: int, bits: int = 64) -> np.ndarray:
    """Where each partition's keys begin among sorted ones, and their end."""
    limits = np.searchsorted((keys >> np.uint64(bits - 32)).astype(np.float64) * partitions / 2**32, np.arange(partitions + 1))
    limits[-1] = len(keys)
    return limits


def coded(numbers: np.ndarray, rows: np.ndarray) -> tuple[bytes, bytes]:
    """(rows that occur, places in them) of ``rows[numbers]``; most rows occur often."""
    found, at = distinct(numbers)
    return squeezed(rows[found].astype(np.float32).T.tobytes()), squeezed(narrow(at))


def decoded(rows: bytes, at: bytes, width: int) -> np.ndarray:
    return np.frombuffer(opened(rows), np.float32).reshape(width, -1).T[wide(opened(at))]


def batch(names: str, kinds: dict, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a batch; a column's type by its name, binary unless given."""
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(x, kinds.get(n, pa.binary())) for n, x in zip(names.split(), columns, strict=True)], names=names.split())


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


# Blocks


BLOCKS = "block long, pairs long, keys binary, each binary, word binary, counts binary, places binary, sizes binary, ids binary, flags binary"
HELD, NO_ID = 1, 2


def code_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of coded documents, a row each: the words' keys, how many words follow each, which ones, the pairs'
    training counts; the documents' tokens as places among the pairs, and their sizes, ids and flags.

    Pairs are ordered by the keys of the context and of the word.
    """

    def block(block_id: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        import xxhash

        ids = _Ids()
        get = ids.__getitem__
        tokens = []
        for i, (doc_id, held, text) in enumerate(rows):
            tokens.append(np.fromiter(map(get, (*text.lower().split(), END)), np.uint32))
            rows[i] = (doc_id, held, None)
        words = list(ids)
        keys = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        order = np.argsort(keys, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        keys = keys[order]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        word = rank[np.concatenate(tokens)]
        start = rank[get(END)]
        del tokens, words, ids, get, order, rank
        flat = np.empty_like(word)
        flat[1:] = word[:-1]
        flat[np.concatenate([[0], np.cumsum(sizes)[:-1]])] = start
        flat <<= 32
        flat |= word
        del word
        pairs, places = distinct(flat)
        del flat
        held = np.fromiter((h for _, h, _ in rows), bool, len(rows))
        counts = np.bincount(places, weights=np.repeat(~held, sizes), minlength=len(pairs))
        each = np.bincount(pairs >> 32, minlength=len(keys))  # every word is the context of another or of the end
        ids = np.fromiter((0 if r[0] is None else r[0] for r in rows), np.int64, len(rows))
        flags = np.fromiter(((HELD if r[1] else 0) | (NO_ID if r[0] is None else 0) for r in rows), np.uint8, len(rows))
        blobs = (keys.tobytes(), pack32(each), squeezed(narrow(pairs & 0xFFFFFFFF)), pack32(counts), squeezed(narrow(places)), pack32(sizes), squeezed(ids.tobytes()), squeezed(flags.tobytes()))
        yield batch("block pairs keys each word counts places sizes ids flags", {"block": pa.int64(), "pairs": pa.int64()}, [(block_id, len(pairs), *blobs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, number = TaskContext.get().partitionId() << 24, 0
        rows, size = [], 0
        for own in batches:
            for doc_id, text in zip(own.column(0).to_pylist(), own.column(1), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                rows.append((doc_id, doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2, raw))
                size += len(raw)
                if size >= BLOCK_BYTES:
                    yield from block(first + number, rows)
                    rows, size, number = [], 0, number + 1
        if rows:
            yield from block(first + number, rows)

    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, BLOCKS)


def hot_contexts(blocks: DataFrame, parts: int, total: int) -> dict[int, int]:
    """Into how many parts each context is split that has over a partition's share of the pairs.

    Fewer than ``parts`` contexts can have that share, whatever the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            for pairs, a, b in zip(*(own.column(c).to_pylist() for c in ("pairs", "keys", "each")), strict=True):
                each = u32(b)
                often = each * parts * 4 > pairs
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, np.uint64)[often].view(np.int64)), pa.array(each[often].astype(np.int64))], names=["key", "n"])

    counts = blocks.select("pairs", "keys", "each").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") * parts > total).collect()
    return {r["key"] & 0xFFFFFFFFFFFFFFFF: 1 + r["n"] * parts // total for r in found}


class Dealt:
    """How a block's pairs are dealt to partitions: by context, split contexts by context and word.

    ``order`` lists the block's pairs as partitions get them: for each its own words' pairs, then those of split ones.
    """

    def __init__(self, keys: np.ndarray, each: np.ndarray, word: np.ndarray, hot: dict[int, int], parts: int) -> None:
        each = each.astype(np.int64)
        names = np.fromiter(sorted(hot), np.uint64, len(hot))
        ways = np.fromiter((hot[int(x)] for x in names), np.uint64, len(hot))
        ctx = np.repeat(np.arange(len(keys)), each)
        self.is_hot = np.isin(keys, names)
        at = np.flatnonzero(self.is_hot[ctx])
        ways = ways[np.searchsorted(names, keys[ctx[at]])] if len(at) else np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            sub = keys[ctx[at]] + (1 + (keys[word[at]] >> np.uint64(16)) % np.maximum(ways, 1)) * np.uint64(0x9E3779B97F4A7C15)
            sub = (sub ^ (sub >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            sub ^= sub >> np.uint64(29)
        at = at[order := np.lexsort((word[at], sub))]
        self.subs, first, self.sub_each = np.unique(sub[order], return_index=True, return_counts=True)
        self.sub_of = keys[ctx[at[first]]] if len(at) else np.zeros(0, np.uint64)
        self.own_each = np.where(self.is_hot, 0, each)
        plain = np.flatnonzero(~self.is_hot[ctx])
        self.words, self.sub_cuts = cuts(keys, parts), cuts(self.subs, parts)
        own = np.concatenate([[0], np.cumsum(self.own_each)])[self.words]
        split = np.concatenate([[0], np.cumsum(self.sub_each)])[self.sub_cuts]
        self.parts = [(plain[own[p] : own[p + 1]], at[split[p] : split[p + 1]]) for p in range(parts)]
        self.order = np.concatenate([x for both in self.parts for x in both]) if parts else np.zeros(0, np.int64)


MESSAGES = "part int, block long, words binary, each binary, subs binary, sub_of binary, sub_each binary, follow binary, counts binary"


def messages(blocks: DataFrame, hot: dict[int, int], parts: int) -> DataFrame:
    """What each block sends to each partition that has one of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for block_id, a, b, c, d in zip(*(rows.column(x).to_pylist() for x in ("block", "keys", "each", "word", "counts")), strict=True):
                keys, each, word, counts = np.frombuffer(a, np.uint64), u32(b), wide(opened(c)), u32(d)
                dealt = Dealt(keys, each, word, hot, parts)
                short = keys >> np.uint64(16)
                out = []
                for p, both in enumerate(dealt.parts):
                    w, s = slice(*dealt.words[p : p + 2]), slice(*dealt.sub_cuts[p : p + 2])
                    pairs = np.concatenate(both)
                    if w.stop > w.start or len(pairs):
                        out.append((p, block_id, keys[w].tobytes(), pack32(dealt.own_each[w]), dealt.subs[s].tobytes(), dealt.sub_of[s].tobytes(), pack32(dealt.sub_each[s]), pack48(short[word[pairs]]), pack32(counts[pairs])))
                yield batch("part block words each subs sub_of sub_each follow counts", {"part": pa.int32(), "block": pa.int64()}, out)

    return blocks.select("block", "keys", "each", "word", "counts").mapInArrow(run, MESSAGES)


# Partitions by context


#: All tables between partitions. Kinds: 0 a partition, 1 its words or sums for a partition of the root, 2 a block's
#: places in it, 3 its contexts' keys; 4 values of G for a partition, 5 its tables by context, 6 by pair, 7 a partition of
#: the root, 8 its masses for a partition; 9 answers to a block. In tables of the root: 0 its keys, 1 places, 2 first sums, 3 sums.
STATE = "kind int, part int, home int, block long, stats array<double>, split array<struct<key:long,n:double,m:double>>, a binary, b binary, c binary, d binary, e binary, f binary"
COLUMNS = ["kind", "part", "home", "block", "stats", "split", *"abcdef"]


def row(kind: int, *blobs: bytes, part: int = -1, home: int = -1, block: int = -1, stats: list | None = None, split: list | None = None) -> tuple:
    return (kind, part, home, block, stats, split, *blobs, *[None] * (6 - len(blobs)))


def table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS)


def bound(body, *args):
    """``body`` of a group's rows and ``args`` as they are now."""
    return lambda rows: body(rows, *args)


def merge(rows: pd.DataFrame, homes: int) -> pd.DataFrame:
    """A partition's pairs from all blocks' messages."""
    rows = rows.sort_values("block")
    part = int(rows["part"].iloc[0])
    words = [np.frombuffer(x, np.uint64) for x in rows["words"]]
    subs = [np.frombuffer(x, np.uint64) for x in rows["subs"]]
    contexts = distinct(np.concatenate([*words, *subs]))[0]
    word_at = [np.searchsorted(contexts, x) for x in words]
    sub_of = np.zeros(len(contexts), np.uint64)
    ctx = []
    for at, s, of, each, sub_each in zip(word_at, subs, rows["sub_of"], rows["each"], rows["sub_each"], strict=True):
        places = np.searchsorted(contexts, s)
        sub_of[places] = np.frombuffer(of, np.uint64)
        ctx.append(np.concatenate([np.repeat(at, u32(each)), np.repeat(places, u32(sub_each))]))
    sizes = [len(x) for x in ctx]
    follow, inverse = distinct(np.concatenate([keys48(x) for x in rows["follow"]]))
    pairs, at = distinct(np.concatenate(ctx) * len(follow) + inverse)
    del ctx, inverse
    counts = np.bincount(at, weights=np.concatenate([u32(x) for x in rows["counts"]]), minlength=len(pairs)).astype(np.int64)
    ctx, word = np.divmod(pairs, len(follow))
    customers = np.bincount(ctx, weights=counts, minlength=len(contexts)).astype(np.int64)
    many = counts > 1
    singles = np.bincount(ctx, weights=counts == 1, minlength=len(contexts))
    kinds = np.zeros((2, len(follow)), np.int64)
    kinds[0], kinds[1] = np.bincount(word, weights=counts == 1, minlength=len(follow)), np.bincount(word, weights=many, minlength=len(follow))
    split = np.flatnonzero(sub_of)
    stats = [float(counts.sum()), float((customers[sub_of == 0] > 0).sum()), float((counts == 1).sum()), float((counts == 2).sum())]
    several = np.flatnonzero(kinds[1])
    rank = np.zeros(len(follow), np.int64)
    rank[several] = np.arange(len(several))
    seen = np.bincount(ctx, weights=counts > 0, minlength=len(contexts))
    hot = [(int(k.view(np.int64)), float(n), float(m)) for k, n, m in zip(sub_of[split], customers[split], seen[split], strict=True)]
    state = [pack32(customers), pack32(singles), pack32(counts), squeezed(narrow(rank[word[many]])), pack32(np.bincount(ctx, minlength=len(contexts))), split.astype(np.uint32).tobytes() + sub_of[split].tobytes()]
    out = [row(0, *state, part=part, stats=stats, split=hot), row(3, contexts.tobytes(), part=part)]
    at48 = cuts(follow, homes, 48)
    for q, (lo, hi) in enumerate(zip(at48[:-1], at48[1:], strict=True)):
        if hi > lo:
            out.append(row(1, pack48(follow[lo:hi]), pack32(kinds[0, lo:hi]), pack32(kinds[1, lo:hi]), part=part, home=q))
    within = np.split(at, np.cumsum(sizes)[:-1])
    for block_id, n, words_at, places in zip(rows["block"], rows["each"], word_at, within, strict=True):
        own = int(u32(n).sum())
        # A block's pairs of its own words come in order, and then those of split contexts.
        out.append(row(2, pack_rising(words_at), pack_rising(places[:own]), pack_rising(places[own:]), part=part, block=int(block_id)))
    return table(out)


class Part:
    """A partition's state: customers and single pairs by context, counts of all pairs, words of those that count twice or more."""

    def __init__(self, row: pd.Series) -> None:
        self.customers, self.singles, self.counts = u32(row["a"]), u32(row["b"]).astype(np.int64), u32(row["c"]).astype(np.int64)
        self.word = wide(opened(row["d"]))
        self.ctx = np.repeat(np.arange(len(self.customers)), u32(row["e"]))
        raw = row["f"]
        n = len(raw) // 12
        self.split, self.split_of = np.frombuffer(raw[: 4 * n], np.uint32), np.frombuffer(raw[4 * n :], np.uint64)
        self.many = self.counts > 1
        self.c, self.at = self.counts[self.many], self.ctx[self.many]

    def tables(self, t: np.ndarray) -> np.ndarray:
        """Each context's tables."""
        return self.singles + np.bincount(self.at, weights=t, minlength=len(self.singles)).astype(np.int64)


# Seating


@lru_cache
def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """[c, t]: log S(c, t), by its recurrence."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(1, most + 1):
        t = np.arange(1, c + 1)
        with np.errstate(divide="ignore"):
            stay = out[c - 1, 1 : c + 1] + np.log(np.maximum(c - 1 - discount * t, 0.0))
        out[c, 1 : c + 1] = np.logaddexp(out[c - 1, :c], stay)
    return out


def draw_large(c: np.ndarray, w: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """As :func:`draw`, for many customers.

    The weights' generating function is that of a Poisson number of groups of tilted sizes that add up to
    c. At its saddle point the groups but one have mean ``mean`` and variance ``var``.
    """
    low, high = np.full(len(c), -700.0), np.full(len(c), -1e-12)
    want = np.log(c / w)
    for _ in range(60):
        mid = (low + high) / 2
        more = np.log1p(-np.exp(mid)) + (discount - 1) * mid > want
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    mid = (low + high) / 2
    u = np.exp(mid)
    mean = w * -np.expm1(discount * mid) / discount
    var = np.maximum(mean - c / (1 + (1 - discount) * (1 - u) / u), 0.0)
    t = np.where(mean < 50, rng.poisson(np.minimum(mean, 50.0)), np.rint(mean + np.sqrt(var) * rng.standard_normal(len(c))))
    return np.clip(1 + t, 1, c).astype(np.int64)


def draw(c: np.ndarray, w: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with ``c`` customers: t with probability in proportion to S(c, t) * w ** t."""
    t = np.minimum(c, 1).astype(np.int64)
    logs = log_stirling(discount)
    order = np.argsort(c, kind="stable")
    lo, end = np.searchsorted(c[order], [2, EXACT + 1])
    while lo < end:
        hi = min(end, lo + max(1, 400_000 // int(c[order[min(end - 1, lo + 200_000)]])))
        own = order[lo:hi]
        most = int(c[own[-1]])
        chance = logs[c[own], 1 : most + 1] + np.log(np.maximum(w[own], 1e-300))[:, None] * np.arange(1, most + 1)
        chance -= chance.max(1, keepdims=True)
        np.exp(chance, out=chance)
        np.cumsum(chance, 1, out=chance)
        t[own] = 1 + (chance < rng.random((len(own), 1)) * chance[:, -1:]).sum(1)
        lo = hi
    if len(large := order[end:]):
        t[large] = draw_large(c[large].astype(float), np.maximum(w[large], 1e-300), discount, rng)
    return t


def rounded_discount(once: float, twice: float) -> float:
    """Ney's estimate, within bounds, coarse enough that all tasks share one table of Stirling numbers."""
    return round(min(0.95, max(0.05, once / (once + 2 * twice))), 3) if once else 0.5


def sweep_parts(rows: pd.DataFrame, discount: float, norm: float, rest: float, hot_x: dict[int, float], seed: int, keep: bool) -> pd.DataFrame:
    """Draws a partition's tables given the root's measure; sums by word for the root's partitions."""
    part = int(rows["part"].iloc[0])
    p = Part(rows[rows["kind"] == 0].iloc[0])
    rng = np.random.default_rng([seed, part])
    sent = rows[rows["kind"] == 4].sort_values("home")
    sent = [(int(h), np.frombuffer(opened(x), np.float32)) for h, x in zip(sent["home"], sent["a"], strict=True)]
    g = np.concatenate([np.zeros(0, np.float32), *[x for _, x in sent]]).astype(float)
    before = rows[rows["kind"] == 5]
    tables = u32(before["a"].iloc[0]).astype(np.int64) if len(before) else p.tables(np.ones(len(p.c)))
    x = rng.gamma(tables + STRENGTH / discount)
    for i, key in zip(p.split, p.split_of, strict=True):
        x[i] = hot_x[int(key)]
    t = draw(p.c, discount * x[p.at] * ((g + rest) / norm)[p.word], discount, rng)
    tables = p.tables(t)
    split = [(int(k.view(np.int64)), float(n), 0.0) for k, n in zip(p.split_of, tables[p.split], strict=True)]
    out = [row(5, pack32(tables), part=part, split=split)]
    sums = np.bincount(p.word, weights=t, minlength=len(g))
    at = 0
    for home, values in sent:
        out.append(row(1, pack32(sums[at : at + len(values)]), part=part, home=home))
        at += len(values)
    if keep:
        out.append(row(6, pack32(t), part=part))
    return table(out)


def gather_roots(rows: pd.DataFrame) -> pd.DataFrame:
    """A partition of the root from all partitions' words."""
    home = int(rows["home"].iloc[0])
    keys = [keys48(x) for x in rows["a"]]
    whole = distinct(np.concatenate(keys))[0]
    base, many, out = np.zeros(len(whole)), np.zeros(len(whole)), []
    for part, own, once, twice in zip(rows["part"], keys, rows["b"], rows["c"], strict=True):
        at, more = np.searchsorted(whole, own), u32(twice)
        base[at] += u32(once)
        many[at] += more
        if (more > 0).any():
            out.append(row(1, pack_rising(at[more > 0]), part=int(part), home=home))
    first = base + many  # the first seating has one table for each pair
    out.append(row(0, pack48(whole), pack32(base), home=home, stats=[float((first == 1).sum()), float((first == 2).sum()), float(first.sum()), float((first > 0).sum())]))
    out.append(row(2, pack32(many), home=home))
    return table(out)


def sweep_root(rows: pd.DataFrame, discount: float, x: float, uniform: float, seed: int, keep: bool) -> pd.DataFrame:
    """Draws the root's tables and measure for a partition of its dishes; values of G for other partitions."""
    home = int(rows["home"].iloc[0])
    rng = np.random.default_rng([seed, 1 << 20, home])
    c = u32(rows.loc[rows["kind"] == 0, "b"].iloc[0]).astype(np.int64)
    places = {int(p): rising(a) for p, a in zip(*(rows.loc[rows["kind"] == 1, k] for k in ("part", "a")), strict=True)}
    sent = rows[rows["kind"] == 3]
    for part, a in zip(sent["part"], sent["a"], strict=True):
        c[places[int(part)]] += u32(a)
    for a in rows.loc[rows["kind"] == 2, "a"]:
        c += u32(a)
    t = draw(c, np.full(len(c), discount * x * uniform), discount, rng)
    g = rng.gamma(np.maximum(c - discount * t, 0.0)).astype(np.float32)
    out = [row(4, squeezed(g[at].tobytes()), part=p, home=home) for p, at in places.items()]
    kept = (pack32(c), pack32(t)) if keep else ()
    out.append(row(7, *kept, home=home, stats=[float(c.sum()), float(t.sum()), float(g.sum(dtype=np.float64))]))
    return table(out)


# Predictions


def root_masses(rows: pd.DataFrame, discount: float, parts: int) -> pd.DataFrame:
    """To each partition: its words' keys and their mass at the root in each sample."""
    keys = keys48(rows.loc[rows["kind"] == 0, "a"].iloc[0])
    samples = rows[rows["kind"] == 7].sort_values("block")
    mass = np.stack([u32(c) - discount * u32(t) for c, t in zip(samples["a"], samples["b"], strict=True)]).astype(np.float32)
    at = cuts(keys, parts, 48)
    return table([row(8, pack48(keys[lo:hi]), squeezed(mass[:, lo:hi].tobytes()), part=p) for p, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)) if hi > lo])


def answer(rows: pd.DataFrame, discount: float, samples: int) -> pd.DataFrame:
    """To each block, for its words: training count (high and low part), mass at the root and tables as a context,
    in each sample; for its pairs: the average mass of their own. Mass is customers less discounts."""
    part = int(rows["part"].iloc[0])
    p = Part(rows[rows["kind"] == 0].iloc[0])
    contexts = np.frombuffer(rows.loc[rows["kind"] == 3, "a"].iloc[0], np.uint64)
    own = np.where(p.counts > 0, p.counts - discount, 0.0)
    kept = rows[rows["kind"] == 6].sort_values("block")
    own[p.many] = p.c - discount * np.mean([u32(x) for x in kept["a"]], axis=0)
    pair_rows, pair_at = distinct(own.astype(np.float32))
    tables = [u32(x) for x in rows[rows["kind"] == 5].sort_values("block")["a"]]
    root = np.zeros((samples, len(contexts)))
    for a, b in zip(*(rows.loc[rows["kind"] == 8, k] for k in "ab"), strict=True):
        keys = keys48(a)
        at = np.minimum(np.searchsorted(keys, contexts >> np.uint64(16)), len(keys) - 1)
        root += np.where(keys[at] == contexts >> np.uint64(16), np.frombuffer(opened(b), np.float32).reshape(samples, -1)[:, at], 0.0)
    word_rows, word_at = np.unique(np.column_stack([p.customers // (1 << 20), p.customers % (1 << 20), *root, *tables]).astype(np.float32), axis=0, return_inverse=True)
    out = []
    for block, a, b, c in zip(*(rows.loc[rows["kind"] == 2, k] for k in ("block", *"abc")), strict=True):
        pairs = np.concatenate([rising(b), rising(c)])
        out.append(row(9, *coded(word_at.ravel()[rising(a)], word_rows), *coded(pair_at[pairs], pair_rows[:, None]), part=part, block=int(block)))
    return table(out)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Model:
    """A sampled model: its partitions' tables, and the sums that all predictions share."""

    def __init__(self, docs: DataFrame, seed: int = 1, part_pairs: int = PART_PAIRS, samples: int = SAMPLES) -> None:
        self.wanted = samples
        self.blocks = materialize(code_blocks(docs), "coded")
        total = int(self.blocks.agg(F.sum("pairs").alias("n")).first()["n"] or 0)
        homes = max(1, -(-total // (part_pairs * GROUP)))
        cores = docs.sparkSession.sparkContext.defaultParallelism
        self.parts = homes * GROUP if homes > 1 else max(1, -(-total // part_pairs), cores if total > SMALL else 1)
        self.light = max(min(cores, self.parts), self.parts // 4)
        self.by_home = max(1, min(homes, self.light))
        split = hot_contexts(self.blocks, self.parts, total) if self.parts > 1 else {}
        sent = messages(self.blocks, split, self.parts).repartition(2 * self.parts, "part")
        self.state = materialize(sent.groupBy("part").applyInPandas(bound(merge, homes), STATE), "pairs")
        tokens, types, once, twice = self.sums(self.state.where("kind = 0"), 4)
        self.discount = rounded_discount(once, twice)
        # Split contexts are words too, whose counts are those of their parts.
        self.split, self.hot = split, self.hot_sums(self.state.where("kind = 0")) if split else {}
        self.tokens, self.types = int(tokens), int(types) + sum(n > 0 for n, _ in self.hot.values())
        self.uniform = 1.0 / (self.types + 1)
        self.roots = self.grouped(self.state.where("kind = 1"), "home", self.by_home, gather_roots, "roots")
        self.samples: list[dict] = []
        self.sweeps = self.sample(np.random.default_rng(seed), seed)

    @staticmethod
    def grouped(rows: DataFrame, key: str, tasks: int, body, label: str) -> DataFrame:
        return materialize(rows.select(*COLUMNS).repartition(tasks, key).groupBy(key).applyInPandas(body, STATE), label)

    @staticmethod
    def sums(rows: DataFrame, size: int) -> list[float]:
        found = rows.agg(*[F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(size)]).first()
        return [float(x or 0.0) for x in found]

    @staticmethod
    def hot_sums(rows: DataFrame) -> dict[int, tuple[float, float]]:
        """Both sums of every split context: fewer than partitions."""
        found = rows.select(F.explode("split").alias("s")).groupBy("s.key").agg(F.sum("s.n").alias("n"), F.sum("s.m").alias("m")).collect()
        return {r["key"] & 0xFFFFFFFFFFFFFFFF: (r["n"], r["m"]) for r in found}

    def sample(self, rng: np.random.Generator, seed: int) -> int:
        """Sweeps until seatings settle, then keeps those wanted; the number of sweeps."""
        once, twice, customers, dishes = self.sums(self.roots.where("kind = 0"), 4)
        self.root_discount = rounded_discount(once, twice)
        root_tables, tables = dishes, None
        hot_tables = {k: m for k, (_, m) in self.hot.items()}
        fixed, roots = self.state.where("kind = 0"), self.roots
        settled, last, sweep = False, np.zeros(2), 0
        while True:
            # The root, given the contexts' tables.
            keep, made = settled, seed * 1000 + sweep
            x = rng.gamma(root_tables + STRENGTH / self.root_discount)
            args = (self.root_discount, x, self.uniform, made, keep)
            rows = roots if tables is None else roots.where("kind <> 2").unionByName(tables.where("kind = 1").withColumn("kind", F.lit(3)))
            root = self.grouped(rows, "home", self.by_home, bound(sweep_root, *args), "root")
            customers, root_tables, mass = self.sums(root.where("kind = 7"), 3)
            rest = rng.gamma(STRENGTH + self.root_discount * root_tables)
            if keep:
                self.samples.append({"tables": tables, "root": root, "customers": customers, "root_tables": root_tables, "hot": hot_tables})
                if len(self.samples) == self.wanted:
                    return sweep
            now = np.asarray([customers, root_tables])
            settled = settled or sweep >= BURN and (sweep >= MOST_BURN or bool((np.abs(now - last) <= SETTLED * now).all()))
            last = now
            # The contexts, given the root.
            hot_x = {k: float(rng.gamma(n + STRENGTH / self.discount)) for k, n in hot_tables.items()}
            args = (self.discount, mass + rest, rest * self.uniform, hot_x, made, settled)
            rows = fixed.unionByName(root.where("kind = 4"))
            rows = rows if tables is None else rows.unionByName(tables.where("kind = 5"))
            old, tables = tables, self.grouped(rows, "part", self.light, bound(sweep_parts, *args), "tables")
            hot_tables = {k: n for k, (n, _) in self.hot_sums(tables.where("kind = 5")).items()} if self.hot else {}
            if not keep:
                remove(root)
                if old is not None:
                    remove(old)
            sweep += 1

    def answers(self) -> DataFrame:
        """What blocks need of the samples."""
        labelled = lambda name, kinds: [x[name].where(f"kind IN ({kinds})").withColumn("block", F.lit(i).cast("long")) for i, x in enumerate(self.samples)]
        rows = self.roots.where("kind = 0")
        for x in labelled("root", "7"):
            rows = rows.unionByName(x)
        masses = self.grouped(rows, "home", self.by_home, bound(root_masses, self.root_discount, self.parts), "masses")
        rows = self.state.where("kind IN (0, 2, 3)").unionByName(masses)
        for x in labelled("tables", "5, 6"):
            rows = rows.unionByName(x)
        out = self.grouped(rows, "part", 2 * self.parts, bound(answer, self.discount, self.wanted), "answers")
        for used in (self.state, self.roots, masses, *(x[name] for x in self.samples for name in ("tables", "root"))):
            remove(used)
        return out

    def shared(self) -> dict:
        """The few numbers that every prediction needs."""
        hot = sorted(self.hot)
        return {
            "tokens": self.tokens, "types": self.types, "uniform": self.uniform, "discount": self.discount, "root_discount": self.root_discount,
            "samples": self.wanted, "parts": self.parts, "split": self.split, "hot": np.asarray(hot, np.uint64), "hot_count": np.asarray([self.hot[k][0] for k in hot]),
            "hot_tables": np.asarray([[x["hot"].get(k, 0.0) for k in hot] for x in self.samples]),
            "customers": [x["customers"] for x in self.samples], "root_tables": [x["root_tables"] for x in self.samples],
        }


def predicted(block: pd.Series, own: pd.DataFrame, m: dict) -> tuple[np.ndarray, ...]:
    """A block's (word keys, contexts, words, training counts by word, probabilities by pair)."""
    own, samples = own.sort_values("part"), m["samples"]
    keys, each, word = np.frombuffer(block["keys"], np.uint64), u32(block["each"]), wide(opened(block["word"]))
    order = Dealt(keys, each, word, m["split"], m["parts"]).order
    ctx = np.repeat(np.arange(len(keys)), each)
    words = np.concatenate([decoded(a, b, 2 + 2 * samples) for a, b in zip(own["a"], own["b"], strict=True)]).astype(float)
    mass = np.zeros(len(word))
    mass[order] = np.concatenate([decoded(c, d, 1)[:, 0] for c, d in zip(own["c"], own["d"], strict=True)])
    counts, root, tables = words[:, 0] * (1 << 20) + words[:, 1], words[:, 2 : 2 + samples].T, words[:, 2 + samples :].T.copy()
    if len(m["hot"]):
        at = np.flatnonzero(np.isin(keys, m["hot"]))
        place = np.searchsorted(m["hot"], keys[at])
        counts[at], tables[:, at] = m["hot_count"][place], m["hot_tables"][:, place]
    for s in range(samples):
        p0 = (root[s] + (STRENGTH + m["root_discount"] * m["root_tables"][s]) * m["uniform"]) / (STRENGTH + m["customers"][s])
        mass += (STRENGTH + m["discount"] * tables[s][ctx]) * p0[word] / samples
    # A word comes before another, or the first of a text, as often as it occurs.
    return keys, ctx, word, counts, mass / (STRENGTH + counts[ctx])


def score(docs: DataFrame, part_pairs: int = PART_PAIRS) -> DataFrame:
    """The scores of every whole text of ``docs`` under the model of its training part."""
    model = Model(docs, part_pairs=part_pairs)
    m = model.shared()

    def run(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        block = rows.iloc[0]
        _, _, word, counts, p = predicted(block, own, m)
        places, sizes, flags = wide(opened(block["places"])), u32(block["sizes"]).astype(np.int64), np.frombuffer(opened(block["flags"]), np.uint8)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])  # every text has a token
        total = lambda values: np.add.reduceat(values[places], first)
        base = np.log10((counts + 1.0) / (m["tokens"] + (m["types"] + 1.0)))
        ids = pd.Series(np.frombuffer(opened(block["ids"]), np.int64)).astype("Int64").mask((flags & NO_ID) > 0)
        return pd.DataFrame({
            "doc_id": ids, "held_out": (flags & HELD) > 0, "n_tokens": sizes, "n_known": total((counts > 0)[word].astype(np.int64)), "train_tokens": m["tokens"],
            "base_score": total(base[word]), "score": total(np.log10(p)),
        })

    return by_block(model, ("sizes", "ids", "flags", "places")).applyInPandas(run, SCORES)


def by_block(model: Model, more: tuple[str, ...] = ()):
    """Blocks with their answers; more tasks than blocks, so that few get several."""
    tasks = max(2, 2 * model.parts)
    blocks = model.blocks.select("block", "keys", "each", "word", *more).repartition(tasks, "block")
    return blocks.groupBy("block").cogroup(model.answers().select("block", "part", *"abcd").repartition(tasks, "block").groupBy("block"))


def pair_probabilities(docs: DataFrame, part_pairs: int = PART_PAIRS, samples: int = SAMPLES) -> DataFrame:
    """(context, word, p): the probability of every pair of words of the texts, by the words' 64-bit hashes."""
    model = Model(docs, part_pairs=part_pairs, samples=samples)
    m = model.shared()

    def run(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        keys, ctx, word, _, p = predicted(rows.iloc[0], own, m)
        return pd.DataFrame({"context": keys[ctx].view(np.int64), "word": keys[word].view(np.int64), "p": p})

    return by_block(model).applyInPandas(run, "context long, word long, p double").distinct()


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts of ``documents``, learning from those whose checksum rule does not hold them out."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
