import math

import duckdb
import numpy as np
import pytest

from millrace.llm import hard_negatives as H

S = "id long, label int, v array<double>, rank int, window int, score long"


def plain(rows, every=10):
    good = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            one = (label, [math.floor(256 * x) for x in v])
            good[i] = min(good.get(i, one), one)
    out = []
    for a, (label, v) in good.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in good.items() if i != a)
        for s, p, _ in [x for x in scores if x[2] == label][:5]:
            fits = [x for x in scores if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a, p, n, i, -s, -t) for n, (t, i, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, every=10):
    df = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], S).repartition(3)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[c] for c in columns) for r in H.mine(df, f"id % {every} = 0").collect())


@pytest.mark.parametrize("scale", [0.2, 3.0])
def test_as_brute_force(spark, scale):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(4, 24))
    rows = [(i, int(i % 4), (scale * (centres[rng.integers(4)] + rng.normal(size=24))).tolist()) for i in range(400)]
    assert mined(spark, rows) == plain(rows) != []


def test_blocks_of_anchors_and_scans_agree(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, int(i % 3), rng.normal(size=8).tolist()) for i in range(300)]
    want = plain(rows, 2)
    for name, value in (("ANCHORS", 40), ("GROUP", 7), ("SCAN", 33)):
        monkeypatch.setattr(H, name, value)
    assert mined(spark, rows, 2) == want != []


def test_ties_nulls_repeated_rows(spark):
    same = [0.5, -0.25, 0.125]
    rows = [(i, i % 2, same if i % 3 else [0.4, -0.2, 0.1]) for i in range(40)]
    rows += [rows[1], rows[20], (20, 0, [0.1, 0.1, 0.1]), (None, 1, same), (50, None, same), (60, 1, None), (70, 1, [0.1, None, 0.2]), (80, 1, [float("nan"), 0.0, 0.0]), (90, 1, [float("inf"), 0.0, 0.0])]
    assert mined(spark, rows) == plain(rows) != []


def test_few_rows_and_other_lengths(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(10, 1, None)]) == []
    assert mined(spark, [(10, 1, [0.5, 0.5])]) == []
    rows = [(10, 1, [0.5, 0.5]), (11, 1, [0.5, 0.5]), (12, 2, [0.3, 0.3]), (13, 2, [-0.3, -0.3])]
    assert mined(spark, [*rows, (14, 2, [0.1])]) == plain(rows) == [(10, 11, 1, 12, 32768, 19456)]
    # An anchor whose positive's score is negative or zero has an empty window, or one of zero alone.
    assert mined(spark, [(10, 1, [1.0]), (11, 1, [-1.0]), (12, 2, [-0.5])]) == []
    assert mined(spark, [(10, 1, [1.0]), (11, 1, [0.0]), (12, 2, [0.0])]) == [(10, 11, 1, 12, 0, 0)]


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(i % 2), (rng.normal(size=4) * 90_000).tolist()) for i in range(80)]
    assert mined(spark, rows) == plain(rows) != []


def test_intervals_drop_pairs_before_the_last_plane():
    rng = np.random.default_rng(9)
    v, a = rng.integers(-128, 128, size=(4000, 64)), rng.integers(-128, 128, size=(4, 64))
    seen = []

    class Counted(H.Planes):
        def plane(self, at):
            seen.append(at)
            return super().plane(at)

    ends = np.full((4, 1), H.LEAST), np.full((4, 1), H.MOST)
    rows, columns, total = H.qualified(Counted(H.sliced(v, 7), 64, np.float32), 7, a, np.ones((4000, 4), bool), *ends, np.full((4, 1), H.LEAST), 5)
    assert seen == list(range(8)) and len(rows) < 100
    best = np.sort(v @ a.T, axis=0)[-5:]
    for j in range(4):
        assert sorted(total[columns == j])[-5:] == best[:, j].tolist()


def test_query_as_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = H.op12_hard_negatives(spark, sf_dir)
    want = db.execute(H.ORACLE_SQL)
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall()) != []
