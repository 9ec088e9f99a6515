"""Packing of token sequences by exact complements, then best fit.

The planner sees only how many pieces there are of each length, at most ``capacity`` numbers
whatever the corpus holds. An index of single, pair and triple length sums is asked for what fills a gap exactly:
first the gap beside each single piece, then every gap that best fit leaves open. What it finds is consumed under
availability counts; the rest is packed best fit, longest first, many equal pieces at a time. The plan says, for each length, which ranks go to
which run of sequences at which offset. Ranks within a length come from counts per (length, salt)
group, so no group of equal lengths is ever in one task.

Defined results: null or empty text is one piece, the end token alone. Texts longer than the
capacity, however long, are cut into pieces of just that capacity, and a last one that may be shorter. Rows with
one doc_id are told apart by their texts' digest and order of arrival; null ids are packed too.
Ties go to the smaller salt, then doc_id, then piece. Clashing or extra columns are not read. An
empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.shared import materialize, spread

CAPACITY = 4096
END_ID = 1
#: Memory of one worker's word table; when it is full it is cleared, which changes speed alone.
MAX_WORDS = 500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"


class Words(dict):
    """Ids, as little-endian bytes, of text between white space; white space never joins tokens."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merge = self.whole.model.tokenize

    def ids(self, text: str) -> bytes:
        return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        # Letters and the stop after them are always separate tokens, so the letters' entry serves both.
        if word[-1] in ",." and word[:-1].isalpha():
            ids = self[word[:-1]] + self[word[-1]]
        elif word.isascii() and word.isalpha() and word.islower():  # normal already, and one piece
            ids = array("I", [x.id for x in self.merge(word)]).tobytes()
        else:
            ids = self.ids(word)
        if len(word) <= 64:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        # Special tokens' strings may span white space; separators below U+0020 are not white space to the tokenizer.
        if "<|" in text or any(x in text for x in "\x1c\x1d\x1e\x1f"):
            return self.ids(text)
        try:
            text.encode("latin-1")  # among these characters lower case is the same in any library
            text = text.lower()
        except UnicodeEncodeError:
            pass
        return b"".join(map(self.__getitem__, text.split()))


_words: dict[str, Words] = {}


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, salts: int = 1024) -> DataFrame:
    """The pieces of every whole text: where they start, how long they are, their ids' checksum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path not in _words:
            _words[path] = Words(path)
        words, end, step = _words[path], np.asarray([END_ID], "<u4").tobytes(), capacity * 4
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.encode(text.as_py() or "") + end
                whole = zlib.crc32(ids)
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    crc = zlib.crc32(part)
                    rows.append((doc_id, k, at // 4, len(part) // 4, crc, (crc ^ whole ^ (doc_id or 0) * 2654435761) % salts))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return spread(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, PIECES)


class Complements:
    """Index of single, pair and triple sums of the lengths that are left, under their availability counts.

    Counts only fall, so every sum's search goes on from where it stopped: each sum passes over the lengths once.
    """

    def __init__(self, left: dict[int, int]) -> None:
        self.left = left
        self.lengths = sorted(left, reverse=True)
        self.pairs: dict[int, tuple[int, ...] | None] = {}
        self.triples: dict[int, tuple[int, ...] | None] = {}
        self.at: dict[tuple[int, int], int] = {}

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often the lengths can be taken together."""
        need: dict[int, int] = defaultdict(int)
        for n in lengths:
            need[n] += 1
        return min(self.left.get(n, 0) // k for n, k in need.items())

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for n in lengths:
            self.left[n] -= times

    def single(self, total: int) -> tuple[int, ...] | None:
        return (total,) if self.left.get(total, 0) else None

    def pair(self, total: int) -> tuple[int, ...] | None:
        return self._search(total, 2, self.pairs, lambda n: (n, total - n) if 2 * n >= total else None)

    def triple(self, total: int) -> tuple[int, ...] | None:
        def completed(n: int) -> tuple[int, ...] | None:
            if 3 * n < total:
                return None
            rest = self.pair(total - n)
            return (n, *rest) if rest and rest[0] <= n else ()

        return self._search(total, 3, self.triples, completed)

    def _search(self, total: int, size: int, found: dict, complete) -> tuple[int, ...] | None:
        """The sum's last combination if it can be had still, or the next one; ``complete`` gives None beyond the last."""
        last = found.get(total, ())
        if last is None or (last and self.times(last)):
            return last
        at = self.at.get((size, total), 0)
        while at < len(self.lengths):
            n = self.lengths[at]
            if n < total and self.left[n]:
                lengths = complete(n)
                if lengths is None:
                    break
                if lengths and self.times(lengths):
                    self.at[size, total], found[total] = at, lengths
                    return lengths
            at += 1
        found[total] = None
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in order, how many such sequences), from piece counts by length."""
    left = {n: c for n, c in counts.items() if c > 0}
    done: list[tuple[tuple[int, ...], int]] = []
    index = Complements(left)

    def fill(lengths: tuple[int, ...], most: int | None, searches) -> int:
        """Completes sequences that hold ``lengths`` by what fills their gap exactly; how many.

        Without ``most``, ``lengths`` are taken too.
        """
        filled, gap = 0, capacity - sum(lengths)
        for search in searches:
            while (most is None or filled < most) and (rest := search(gap)):
                times = index.times((*lengths, *rest)) if most is None else min(most - filled, index.times(rest))
                if not times:
                    break
                index.take((*lengths, *rest) if most is None else rest, times)
                done.append(((*lengths, *rest), times))
                filled += times
        return filled

    if left.get(capacity):
        done.append(((capacity,), left.pop(capacity)))
        index.lengths.remove(capacity)
    # Fewer pieces first; long ones first, as they have the fewest ways to be completed.
    for search in (index.single, index.pair, index.triple):
        for a in index.lengths:
            if left[a] and capacity - a > 0:
                fill((a,), None, (search,))

    room: list[int] = []  # the capacities still open, in order
    bins: dict[int, list[list]] = defaultdict(list)  # by open capacity: [lengths, times]

    def put(open_: int, lengths: tuple[int, ...], times: int) -> None:
        if open_:
            times -= fill(lengths, times, (index.single, index.pair, index.triple))
        if times:
            if not bins[open_]:
                insort(room, open_)
            bins[open_].append([lengths, times])

    for n in index.lengths:
        while left[n]:
            at = bisect_left(room, n)
            if at == len(room):
                # Equal pieces fill new sequences one after another, as best fit puts them.
                each, todo = capacity // n, left[n]
                held = (todo // each, each) if todo >= each else (1, todo)
                left[n] -= held[0] * held[1]
                put(capacity - n * held[1], (n,) * held[1], held[0])
                continue
            open_ = room[at]
            lengths, times = bins[open_].pop()
            if not bins[open_]:
                room.pop(at)
            used = min(times, left[n])
            left[n] -= used
            if times > used:
                if not bins[open_]:
                    insort(room, open_)
                bins[open_].append([lengths, times - used])
            put(open_ - n, (*lengths, n), used)
    return done + [(tuple(lengths), times) for groups in bins.values() for lengths, times in groups if times]


def lay_out(sequences: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank of each run, its first sequence, and its offset in the sequence."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    next_rank: dict[int, int] = defaultdict(int)
    first = 0
    for lengths, times in sequences:
        offset = 0
        for n in lengths:
            found[n].append((next_rank[n], first, offset))
            next_rank[n] += times
            offset += n
        first += times
    return {n: tuple(np.asarray(x, np.int64) for x in zip(*runs, strict=True)) for n, runs in found.items()}


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to materialised ``pieces``."""
    groups = pieces.groupBy("length", "salt").count()
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    runs = lay_out(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = pieces.withColumn("rank", F.row_number().over(within)).join(starts, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank") - 1).alias("rank"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            ranks, lengths = rows["rank"].to_numpy(), rows["length"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(part):
                    lows, firsts, offsets = runs[int(lengths[part[0]])]
                    k = np.searchsorted(lows, ranks[part], "right") - 1
                    sequence[part], offset[part] = firsts[k] + ranks[part] - lows[k], offsets[k]
            yield rows.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    return ranked.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces with their places in as few sequences as the method finds."""
    return place(materialize(cut(docs, path, capacity), "pieces"), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts of ``documents`` under the 49k word vocabulary, in sequences of 4096."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
