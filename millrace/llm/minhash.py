"""Near duplicates by circulant MinHash, banding, and exact Jaccard verification.

Signatures. One permutation scatters a document's shingles; a second one, shifted circularly by k,
gives coordinate k: the smallest second-permutation value of (first value + k). Both permutations are
bijections of 32-bit numbers, so two permutations make all ROWS * BANDS coordinates.

Classes. Rows with equal shingle sets are one class, which is a node with a number of its own; only class
representatives go on. A component's name is the smallest doc_id of all its classes, and copies get it at the end.

Candidates and links. Classes that share a band meet in a bucket. A bucket's pairs are never all
emitted: in each round every bucket that still holds more than one component offers its next few
pivots (1, then 4 times as many in each round), each is compared with the members of other components,
and then leaves the bucket, as all its pairs there are decided. Links are confirmed on full sets:
100 * intersection >= threshold * union. A group of copies joins into one component in the first
rounds and is then done; a bucket of unlike texts is compared to the end, so no link between
different texts that share a band is lost. Two texts at similarity 0.8 share no band with probability
(1 - 0.8 ** ROWS) ** BANDS, under 2e-7. Pairs are compared by parity sketches before full sets are
fetched: sketches differ in at most as many bits as the sets have unshared shingles, so that step loses
no link, and it settles most pairs that are near the threshold, without a row for each of them.

Large buckets. Rows of a bucket with over HOT members are not dealt by bucket: its facts are broadcast where they
are found to be small. A bucket that still has over SPLIT members of several components after SPLIT_ROUND rounds
of pivots holds unlike texts; in its place its members meet again in a bucket for each other band they share. So pairs
there must share two bands of 40, which pairs at similarity 0.8 miss with probability under 3e-6.

Between rounds a label moves one step, to the smallest one that a new link leads to: equal labels are always of one component,
which is all that rounds need to leave pairs out. At the end all links make the components whole, by smallest labels with pointer
jumping over distributed tables; only labels that still differ across a link take part. Links, labels and sets never come to the
driver.

Defined results: null, empty or wordless text has no shingles and links with nothing. A text with
fewer words than a shingle is one shingle. Repeated rows with one doc_id are copies of each other if
their texts are alike; each row is returned. One doc_id with different texts is a node for each; all
its links stand, and each row has the component of its own text. Very long texts are whole, in blocks of shingles.
Rows with a null doc_id are left out of :func:`classify` and kept by :func:`keep`. Extra columns pass through :func:`keep` untouched. An empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans import shared
from millrace.plans.shared import materialize, remove, spread

ROWS, BANDS = 5, 40
THRESHOLD = 80
#: Bits of a parity sketch; members of a bucket that one task compares with its pivots; pairs at a time.
PARITY_BITS = 4096
CHUNK = 512
PAIRS_AT_ONCE = 10_000
#: Full sets, or pairs of them, that Python holds at a time: those of very long texts are megabytes each.
SETS_AT_ONCE = 32
#: Shingles whose coordinates are computed at a time; a document of any length takes bounded memory.
BLOCK = 1 << 14

#: Members of a bucket beyond which its rows stay where they are, and beyond which unlike members are split by a second band.
HOT, SPLIT, SPLIT_ROUND = 256, 4096, 3

#: Up to so many ids are broadcast (8 bytes each, counted first); beyond it their tables are shuffled.
BROADCAST_IDS = 500_000


def shingles(text: str | None, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the k-word shingles of lower-cased text, sorted."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    memo = _word_hashes
    if len(memo) > 100_000:
        memo.clear()
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    if len(words) < k:
        return np.asarray([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    out.sort()
    new = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out[new]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_word_hashes = _WordHashes()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(x: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(hashes: np.ndarray, size: int = ROWS * BANDS) -> np.ndarray:
    """``size`` circulant MinHash coordinates of a set of shingle hashes."""
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    first = (mix64(hashes) >> np.uint64(32)).astype(np.uint32)  # the first permutation, of 32-bit places
    for at in range(0, len(first), BLOCK):
        part = first[at : at + BLOCK]
        step = max(1, BLOCK // len(part))
        for k in range(0, size, step):
            shifts = np.arange(k, min(size, k + step), dtype=np.uint32)
            # Distant shifts: neighbouring ones would permute nearly equal places.
            values = permute(part[None, :] + (shifts * np.uint32(0x9E3779B1))[:, None])
            np.minimum(out[k : k + len(shifts)], values.min(axis=1), out=out[k : k + len(shifts)])
    return out


def set_hash(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that name a shingle set."""
    import xxhash

    d = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, the text's hash, set size, the set's name, its parity sketch, and the bands' hashes, for all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, sketches, bands = [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), k)
                sig = signature(found)
                keys = np.arange(1, BANDS + 1, dtype=np.uint64)
                for row in sig.reshape(BANDS, ROWS).T:
                    keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + row)
                sizes.append(len(found))
                names.append(set_hash(found))
                sketches.append(parity(found))
                bands.append(keys.view(np.int64))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(bands) + 1, BANDS), pa.int32()), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
            first, second = (pa.array([x[i] for x in names], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), first, second, pa.array(sketches, pa.binary()), listed], names=["doc_id", "text_hash", "n_shingles", "class", "class2", "sketch", "bands"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash().alias("text_hash"))
    return spread(rows).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, class long, class2 long, sketch binary, bands array<long>")


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def parity(hashes: np.ndarray) -> bytes:
    """A bit for each of PARITY_BITS places: whether an odd number of shingles falls there.

    Bits that differ between two sets are at most as many as shingles that only one of them has.
    """
    places = (mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(PARITY_BITS)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=PARITY_BITS) & 1).astype(np.uint8)).tobytes()


def _compare(rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b): pairs of a pivot and a member of its group, of different labels, that may reach the threshold.

    ``rows`` come sorted by (bucket, chunk), pivots first. A group's rows may span batches; only its
    pivots are kept meanwhile.
    """
    share = (100 - threshold) / (100 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = ("bucket", "chunk", "id", "label", "size")
            now = {c: batch.column(c).to_numpy() for c in names}
            now["member"] = np.asarray(batch.column("member").to_pylist(), bool)
            now["sketch"] = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(n, -1)
            if kept is not None:
                now = {c: np.concatenate([kept[c], x]) for c, x in now.items()}
            first = np.flatnonzero(np.concatenate([[True], (now["bucket"][1:] != now["bucket"][:-1]) | (now["chunk"][1:] != now["chunk"][:-1])]))
            group = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(now["id"])]])))
            pivots = np.bincount(group, weights=~now["member"]).astype(np.int64)
            members = np.flatnonzero(now["member"])
            each = pivots[group[members]]
            ends = np.cumsum(each)
            for part in np.split(np.arange(len(members)), np.searchsorted(ends, np.arange(PAIRS_AT_ONCE, ends[-1], PAIRS_AT_ONCE)) if len(ends) else []):
                if not len(part):
                    continue
                x = np.repeat(members[part], each[part])
                if not len(x):
                    continue
                within = np.arange(len(x)) - np.repeat(np.cumsum(each[part]) - each[part], each[part])
                y = first[group[x]] + within
                sizes = now["size"]
                good = (now["label"][x] != now["label"][y]) & (100 * np.minimum(sizes[x], sizes[y]) >= threshold * np.maximum(sizes[x], sizes[y]))
                x, y = x[good], y[good]
                differ = np.bitwise_count(now["sketch"][x] ^ now["sketch"][y]).sum(axis=1, dtype=np.int64)
                good = differ <= share * (sizes[x] + sizes[y]) + 1e-6
                i, j = now["id"][x[good]], now["id"][y[good]]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], names=["a", "b"])
            last = np.flatnonzero((group == group[-1]) & ~now["member"])
            kept = {c: x[last] for c, x in now.items()}

    return rows.mapInArrow(run, "a long, b long")


def bounded(ids: DataFrame) -> DataFrame:
    """Broadcast a table of ids if it is found to be small."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """id and full shingle set of the wanted (id, doc_id, class, class2); texts are read again, only theirs go to Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SETS_AT_ONCE):
                part = batch.slice(i, SETS_AT_ONCE)
                sets = [shingles(x.as_py(), k) for x in part.column(1)]
                good = [j for j, (x, *name) in enumerate(zip(sets, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)) if set_hash(x) == tuple(name)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(good, pa.int64())), pa.array([sets[j].tobytes() for j in good], pa.binary())], names=["id", "shingle_set"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(bounded(wanted), "doc_id").select("id", "text", "class", "class2").mapInArrow(run, "id long, shingle_set binary").dropDuplicates(["id"])


def _verify(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= threshold * (len(both) - common):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    a = sets.select(F.col("id").alias("a"), F.col("shingle_set").alias("set_a"))
    b = sets.select(F.col("id").alias("b"), F.col("shingle_set").alias("set_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every id in ``edges`` (a, b), label the smallest id that it reaches.

    Each round gives every id the smallest label next to it, then follows that one's own label of the round
    before, so long chains halve. Tables are written in each round, so lineage stays short.
    """
    both = materialize(edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        joined = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("far"))
        new = joined.join(jump, "next").select("id", "old", F.least("next", "far").alias("label"))
        new = materialize(new, "labels")
        changed = new.where("old <> label").limit(1).count()
        remove(labels)
        labels = new
        if not changed:
            remove(both)
            out = labels.select("id", "label")
            out.millrace_path = labels.millrace_path
            return out


def hooked(between: DataFrame) -> DataFrame:
    """(id, label) of the labels in ``between`` (a, b) that have a smaller one beside them: the smallest of those."""
    both = between.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("label"))
    return materialize(both.groupBy("id").agg(F.min("label").alias("label")), "hooked")


def merged(labels: DataFrame, new: DataFrame, whole: bool = False) -> DataFrame:
    """``labels`` (id, label) after the links ``new`` (a, b): only labels that these touch are worked on.

    ``whole`` labels are those of components. Otherwise each label moves one step, to the smallest label that a link leads to, so
    equal labels are of one component, but a component may have several for a while.
    """
    own = bounded(labels)
    for end in ("a", "b"):
        new = new.join(own.select(F.col("id").alias(end), "label"), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    between = materialize(new.where("a <> b").select("a", "b").distinct(), "between")
    if between.isEmpty():
        remove(between)
        return labels
    joined = components(between) if whole else hooked(between)
    remove(between)
    moved = bounded(joined.select(F.col("id").alias("label"), F.col("label").alias("now")))
    old = labels.join(moved, "label", "left").select("id", F.coalesce("now", "label").alias("label"))
    out = materialize(old.unionByName(joined.join(own.select("id"), "id", "left_anti")), "labels")
    remove(joined), remove(labels)
    return out


def with_facts(rows: DataFrame, groups: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with their groups' facts; rows of groups with over HOT members are not dealt by key."""
    return shared.with_facts(rows, groups, *keys, hot=HOT, most=BROADCAST_IDS)


def split_bands(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """(bucket, id) of large buckets' members by the other bands they have; every one needs two members."""
    bands = signed.select("id", F.explode("bands").alias("band"))
    more = rows.select("bucket", "id").join(bands, "id").where("band <> bucket").select(F.xxhash64("bucket", "band").alias("bucket"), "id")
    met = more.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return with_facts(more, materialize(met, "shared"), "bucket").select("bucket", "id")


def links(docs: DataFrame, signed: DataFrame, k: int, threshold: int = THRESHOLD) -> DataFrame:
    """(id, label): the components of linked classes, for ids that have a link.

    ``signed`` has a row for each class: id, doc_id, class, class2, size, sketch and bands.
    """
    spark = signed.sparkSession
    active = signed.select("id", F.explode("bands").alias("bucket"))
    facts = signed.select("id", "size", "sketch")
    labels = spark.createDataFrame([], "id long, label long")
    pivots, turn, all_links = 1, 0, []
    while True:
        labelled = active.join(bounded(labels), "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label"))
        # Buckets of one component have nothing left to find. Hash order is the same in all buckets, so they agree on pivots.
        groups = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.min_by("id", F.xxhash64("id")).alias("first"))
        open_ = materialize(groups.where("low <> high").select("bucket", "n", "first"), "open-buckets")
        if turn == SPLIT_ROUND and not open_.where(F.col("n") > SPLIT).isEmpty():
            large = open_.where(F.col("n") > SPLIT).select("bucket", "n")
            rest = with_facts(active, open_.where(F.col("n") <= SPLIT).select("bucket", "n"), "bucket").select("bucket", "id")
            again = split_bands(with_facts(active, large, "bucket"), signed)
            old, active = active, materialize(rest.unionByName(again), "buckets")
            remove(old), remove(open_)
            # New buckets have had no pivot; the others are offered some again, which are compared to no effect.
            pivots, turn = 1, turn + 1
            continue
        share = F.pmod(F.xxhash64("id"), F.lit(1 << 31)) / float(1 << 31)
        now = with_facts(labelled, open_, "bucket").select("bucket", "n", "id", "label", ((F.col("id") == F.col("first")) | (share * F.col("n") < pivots - 1)).alias("is_pivot"))
        now = materialize(now, "open")
        remove(active), remove(open_)
        if now.isEmpty():
            break
        # Large buckets are dealt out in chunks; their pivots go to each.
        chunks = (F.lit(1) + F.col("n") / CHUNK).cast("int")
        member = F.struct(F.pmod(F.xxhash64("id", F.lit(9)), F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("member"))
        leader = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(c.alias("chunk"), F.lit(False).alias("member")))
        places = F.when(F.col("is_pivot"), F.concat(F.array(member), leader)).otherwise(F.array(member))
        both = now.join(facts, "id").withColumn("chunks", chunks).select("bucket", "id", "label", "size", "sketch", F.inline(places))
        both = both.select("bucket", "chunk", "member", "id", "label", "size", "sketch")
        both = both.repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", "member")
        likely = materialize(_compare(both, threshold).distinct(), "likely")
        if not likely.isEmpty():
            ids = likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct()
            wanted = materialize(ids.join(signed.select("id", "doc_id", "class", "class2"), "id"), "wanted")
            sets = materialize(_full_sets(docs, wanted, k), "sets", "none", batch_rows=2 * SETS_AT_ONCE)
            new = materialize(_verify(likely, sets, threshold), "links", batch_rows=SETS_AT_ONCE)
            remove(sets), remove(wanted)
            labels = merged(labels, new)
            all_links.append(new)
        active = materialize(now.where("NOT is_pivot").select("bucket", "id"), "buckets")
        remove(now), remove(likely)
        pivots, turn = pivots * 4, turn + 1
    if all_links:
        labels = merged(labels, reduce(DataFrame.unionByName, all_links), whole=True)
        for table in all_links:
            remove(table)
    # What is a label has itself for a label.
    roots = labels.select(F.col("label").alias("id")).distinct().join(bounded(labels.select("id")), "id", "left_anti")
    return labels.unionByName(roots.withColumn("label", F.col("id")))


def grouped(docs: DataFrame, k: int, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, class, class2, n_shingles, component_id and the component's own number (node) of each row with a doc_id."""
    signed = materialize(_signed(docs, k), "signatures")
    names = signed.select("doc_id", "text_hash", "n_shingles", "class", "class2")
    first = names.where("n_shingles > 0").groupBy("class", "class2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    reps = materialize(first.withColumn("id", F.monotonically_increasing_id()), "classes")
    on = (signed["doc_id"] == reps["first"]) & (signed["class"] == reps["class"]) & (signed["class2"] == reps["class2"])
    own = signed.join(reps, on).select("id", "doc_id", signed["class"], signed["class2"], F.col("n_shingles").alias("size"), "sketch", "bands")
    nodes = materialize(own.dropDuplicates(["id"]), "nodes")
    labelled = materialize(links(docs, nodes, k, threshold).join(reps.select("id", "first"), "id"), "labelled")
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    named = reps.join(labelled.join(smallest, "label").select("id", "label", "component_id"), "id", "left")
    named = named.select("class", "class2", "n", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("label", "id").alias("node"))
    named = materialize(named, "components")
    remove(nodes), remove(labelled), remove(reps)
    out = with_facts(names.where("n_shingles > 0"), named, "class", "class2").drop("n")
    return out.unionByName(names.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "node": F.lit(None).cast("long")}))


def classify(docs: DataFrame, k: int, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, for each row with a doc_id."""
    return grouped(docs, k, threshold).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep(docs: DataFrame, k: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each group, one with the smallest doc_id; all columns unchanged.

    Of several different texts under that doc_id, those of other groups stay too. Of rows with one doc_id and one
    shingle set, one stays, with the text whose hash is smallest.
    """
    found = materialize(grouped(docs, k, threshold), "groups")
    stay = F.col("doc_id") == F.col("component_id")
    group = ["node", "doc_id"]
    several = found.where(stay & (F.col("n_shingles") > 0)).groupBy(*group).agg(F.count("*").alias("n"), F.min("text_hash").alias("text_hash"))
    several = materialize(several.where("n > 1"), "repeated")
    gone = found.where(~stay).select("doc_id", "text_hash")
    again = not several.isEmpty()
    if again:
        others = found.where(stay & (F.col("n_shingles") > 0)).join(several.select(*group, F.col("text_hash").alias("kept_hash")), group)
        gone = gone.unionByName(others.where("text_hash <> kept_hash").select("doc_id", "text_hash"))
    gone = gone.select(F.col("doc_id").alias("_own_id"), F.col("text_hash").alias("_own_hash")).distinct()
    on = (F.col("doc_id").cast("long") == F.col("_own_id")) & (text_hash() == F.col("_own_hash"))
    out = docs.join(bounded(gone), on, "left_anti")
    if not again:
        return out
    rows = several.select(F.col("doc_id").alias("_own_id"), F.col("text_hash").alias("_own_hash"))
    once = out.join(rows, on, "left_semi").withColumn("_own_hash", text_hash()).dropDuplicates(["doc_id", "_own_hash"]).drop("_own_hash")
    return out.join(rows, on, "left_anti").unionByName(once)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingle FROM w
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
    SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 80 * (nx.n + ny.n - c)
), linked AS (
    SELECT x, y FROM e UNION ALL SELECT y, x FROM e
), reach AS (
    SELECT doc_id, doc_id AS from_id FROM documents UNION SELECT linked.y, reach.from_id FROM reach JOIN linked ON reach.doc_id = linked.x
)
SELECT r.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, r.doc_id = r.component_id AS kept
FROM (SELECT doc_id, min(from_id) AS component_id FROM reach GROUP BY doc_id) r LEFT JOIN n ON r.doc_id = n.doc_id
"""


def op4_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole texts of ``documents`` by their 2-word shingles."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), 2)
