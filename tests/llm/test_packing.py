import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from millrace.llm import packing as K

PATH = P.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]


def test_words_are_the_tokenizers():
    words, rng = K.Words(PATH), random.Random(3)
    parts = ["Thon,", "é", "É.", "é", "it's", "'S", "x_y", "...", ").", "1.5", " ", "\x1c", "<|endoftext|>", "<|x", "ΣΑΣ", "İ", "ﬁ", " ", "😀", "word", "a" * 90, ","]
    for _ in range(400):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 8)))
        assert np.frombuffer(words.encode(text), "<u4").tolist() == ids_of(text)[:-1], text


def test_plan_uses_all_and_fills():
    rng = random.Random(1)
    for capacity, lengths in ((10, range(1, 11)), (64, range(1, 65)), (4096, range(1, 4097))):
        for _ in range(5):
            counts = Counter(rng.choice(lengths) for _ in range(400)) | {rng.choice(lengths): 1000}
            out = K.plan(counts, capacity)
            used = Counter()
            for ls, times in out:
                assert sum(ls) <= capacity and times > 0
                for n in ls:
                    used[n] += times
            assert used == Counter(counts)
            assert sum(t for _, t in out) <= 1.3 * max(sum(n * c for n, c in counts.items()) / capacity, sum(c for n, c in counts.items() if 2 * n > capacity)) + 2
    assert K.plan({6: 2, 4: 2, 3: 1, 5: 1, 2: 1}, 10) == [((6, 4), 2), ((5, 3, 2), 1)]
    assert K.plan({}, 10) == []


def test_gaps_are_completed_by_singles_pairs_and_triples():
    assert K.plan({40: 1, 30: 1, 20: 1, 10: 1}, 100) == [((40, 30, 20, 10), 1)]
    # Beside 60 only a triple fits; it is taken as often as all three are there.
    assert K.plan({60: 3, 19: 2, 13: 5, 8: 3}, 100)[0] == ((60, 19, 13, 8), 2)
    # A gap beside two pieces, which best fit opens, is filled exactly too.
    out = K.plan({34: 2, 16: 1, 11: 1, 5: 1}, 100)
    assert out == [((34, 34, 16, 11, 5), 1)]
    # Of equal lengths no more are taken than there are.
    assert sorted(K.plan({50: 3}, 100)) == [((50,), 1), ((50, 50), 1)]
    assert K.plan({25: 5}, 100)[0] == ((25, 25, 25, 25), 1)


def test_plan_reaches_the_bound_on_mixed_lengths():
    rng = random.Random(8)
    counts = Counter(min(4096, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(20_000))
    out = K.plan(counts)
    used = Counter()
    for ls, times in out:
        assert sum(ls) <= 4096
        for n in ls:
            used[n] += times
    total = sum(n * c for n, c in counts.items())
    assert used == counts and sum(t for _, t in out) <= -(-total // 4096) + 1


def check(df):
    rows = K.pack(df, PATH).collect()
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    want = Counter()
    for r in df.collect():
        ids = ids_of(r["text"])
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.asarray(ids[at : at + 4096], "<u4")
            want[r["doc_id"], k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    return len(places), sum(r["length"] for r in rows)


def test_query_against_brute_force(docs):
    sequences, total = check(docs)
    assert sequences <= -(-total // 4096) * 1.05 + 1


def test_edges(edge_docs, no_docs):
    check(edge_docs)
    assert K.pack(no_docs, PATH).count() == 0
