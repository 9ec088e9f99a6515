import re
from fractions import Fraction

import numpy as np
import pytest

from millrace.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Targets of sources in order, by sharing again and again in exact numbers."""
    left, out = Fraction(3, 2) * sum(sizes.values()), {}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    while len(out) < len(order):
        rest = [s for s in order if s not in out]
        level = left / sum(weight[s] for s in rest)
        above = [s for s in rest if level * weight[s] >= 2 * sizes[s]]
        if not above:
            return out | {s: level * weight[s] for s in rest}
        for s in above:
            out[s] = Fraction(2 * sizes[s])
            left -= out[s]
    return out


def check(rows, got, near):
    sizes = sorted(len(WORD.findall(t or "")) for _, t, _ in rows)
    assert sorted(r["size"] for r in got) == sizes
    totals = {}
    for _, t, s in rows:
        totals[s] = totals.get(s, 0) + len(WORD.findall(t or ""))
    want = plain_targets(totals)
    by_id = {i: s for i, _, s in rows}
    taken = dict.fromkeys(totals, 0)
    for r in got:
        s = by_id[r["doc_id"]]
        assert r["source_size"] == totals[s] and r["target"] == pytest.approx(float(want[s]), rel=1e-12)
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["taken"] == r["copies"] * r["size"]
        taken[s] += r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= near(s), (s, n, float(want[s]))


def test_targets_and_sizes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    got = M.op11_mix_sources(spark, sf_dir).collect()
    check(rows, got, lambda s: 60)
    again = M.mix(docs.repartition(7)).collect()
    key = lambda x: sorted((r["doc_id"], r["copies"]) for r in x)
    assert key(again) == key(got)


def test_a_hot_source_many_groups(spark, monkeypatch):
    monkeypatch.setattr(M, "GROUP", 20)
    monkeypatch.setattr(M, "FAN", 4)
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.pareto(1.2) * 10 + 1)), "hot" if i % 3 else f"s{i % 10:02d}") for i in range(3000)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    check(rows, got, lambda s: 30)
    # Document totals are balanced too.
    by = {i: s for i, _, s in rows}
    share = next(r["target"] / r["source_size"] for r in got if by[r["doc_id"]] == "hot")
    n = sum(1 for i in by if by[i] == "hot")
    assert abs(sum(r["copies"] for r in got if by[r["doc_id"]] == "hot") - share * n) < 10


def test_edges(spark, edge_docs, no_docs):
    got = M.mix(edge_docs).collect()
    assert len(got) == edge_docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert {r["doc_id"]: r["size"] for r in got}[5] == 30_000
    assert M.mix(no_docs).collect() == []
    empty = M.mix(edge_docs.where("doc_id IN (1, 2, 3)")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 3


def test_sources_in_order_of_code_points(spark):
    names = ["b", "a", "", "Ä", "Z", "\U0001f600", "￿", None]
    rows = [(i, "w " * (50 + i % 9), names[i % 8]) for i in range(800)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    check(rows, got, lambda s: 30)  # half a document


def test_step_keeps_both_totals_and_chances():
    rng = np.random.default_rng(2)
    sums = np.zeros(3)
    for _ in range(4000):
        units = [[0.3, 10, 0.0], [0.5, 30, 0.0], [0.8, 17, float(rng.random())]]
        M.step(units)
        psi = np.asarray([x[0] for x in units])
        assert abs(psi.sum() - 1.6) < 1e-6 and abs(psi @ [10, 30, 17] - 31.6) < 1e-5
        assert set(psi) & {0.0, 1.0}
        sums += psi
    assert np.abs(sums / 4000 - [0.3, 0.5, 0.8]).max() < 0.02


def test_flight_leaves_two_at_most():
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(1, 500)), 0, 0, i, float(rng.random()), 0.684, 0, False) for i in range(1000)]
    out = M.flight(rows)
    left = [r for r in out if 0 < r[6] < 1]
    assert len(out) == 1000 and len(left) <= 2
    assert sum(r[6] for r in out) == pytest.approx(684, abs=1e-4)
    assert sum(r[6] * r[1] for r in out) == pytest.approx(0.684 * sum(r[1] for r in rows), abs=0.05)
