import hashlib
import math

import duckdb
import numpy as np

from millrace.llm import vector_codes as C

S = "vec_id long, label int, v array<double>, code string, error long, n int"


def plain(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error) of all rows and the digest, one part at a time with Python numbers."""
    good = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    v = [[math.floor(4096 * x) for x in r[2]] for r in good]
    d = len(v[0])
    codes, errors, numbers = [""] * len(v), [0] * len(v), []
    for p in range(parts):
        own = [x[d * p // parts : d * (p + 1) // parts] for x in v]
        book = own[:entries]
        for turn in range(rounds + 1):
            far = [[sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book] for x in own]
            chosen = [f.index(min(f)) for f in far]
            if turn < rounds:
                members = [[x for x, c in zip(own, chosen, strict=True) if c == e] for e in range(len(book))]
                book = [[sum(col) // len(m) for col in zip(*m, strict=True)] if m else b for m, b in zip(members, book, strict=True)]
        codes = [c + f"{x:02x}" for c, x in zip(codes, chosen, strict=True)]
        errors = [e + min(f) for e, f in zip(errors, far, strict=True)]
        numbers += [str(x) for e in book for x in e]
    by_label = {}
    for r, e in zip(good, errors, strict=True):
        by_label[r[1]] = by_label.get(r[1], 0) + e
    return sorted(((r[0], c, e, by_label[r[1]]) for r, c, e in zip(good, codes, errors, strict=True)), key=str), hashlib.sha256(",".join(numbers).encode()).hexdigest()


def check(spark, rows):
    got = C.compress(spark.createDataFrame([(*r, "x", 1, 1) for r in rows], S).repartition(3)).collect()
    want, digest = plain(rows)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=str) == want
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_as_plain_python(spark):
    rng = np.random.default_rng(3)
    check(spark, [(i * 3, int(i % 4), (rng.normal(size=16) / 4).tolist()) for i in range(150)])


def test_ties_repeated_rows_nulls_and_odd_sizes(spark):
    rng = np.random.default_rng(4)
    same = rng.normal(size=11).tolist()
    rows = [(i, None if i % 5 else 7, same if i % 2 else (rng.integers(-2, 3, size=11) / 4096).tolist()) for i in range(40)]
    rows += [rows[3], rows[3], (None, 1, same), (None, None, (rng.normal(size=11)).tolist())]
    rows += [(90, 1, None), (91, 1, same[:10] + [None]), (92, 1, same[:10] + [float("nan")]), (93, 1, same[:10] + [float("-inf")])]
    check(spark, rows)
    check(spark, rows[:5])


def test_other_lengths_large_numbers_and_empty_tables(spark):
    rows = [(1, 1, [0.5] * 8), (2, 1, [1e30] * 8), (3, 1, [0.25] * 8), (4, 1, [0.5] * 7), (5, 1, [])]
    got = C.compress(spark.createDataFrame([(*r, "x", 1, 1) for r in rows], S)).collect()
    assert sorted(r["vec_id"] for r in got) == [1, 2, 3] and {r["error"] for r in got} == {0}
    assert C.compress(spark.createDataFrame([], S)).collect() == []
    assert C.compress(spark.createDataFrame([(1, 1, None, "", 0, 0)], S)).collect() == []


def test_bounds_hold_and_leave_out_entries():
    rng = np.random.default_rng(5)
    x, book = rng.integers(-2000, 2000, size=(400, 8)), rng.integers(-1500, 1500, size=(16, 8))
    far = ((x[:, None] - book) ** 2).sum(axis=2)
    kept = C.candidates(x, book)
    assert kept[np.arange(400), far.argmin(axis=1)].all() and kept.mean() < 0.5
    own, least = C.nearest(x, book)
    assert (own == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()


def test_query_as_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = C.op13_vector_codes(spark, sf_dir)
    want = db.execute(C.ORACLE_SQL)
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())
