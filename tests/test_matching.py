"""One-to-one matching against a plain sequential version; folders that are swapped whole."""

from __future__ import annotations

import random

import pytest

from orrery.operators import evaluate
from orrery.sources import runs


def in_order(pairs):
    gold, predicted, out = set(), set(), set()
    for p in sorted(pairs, key=lambda p: (p[0], -p[8], p[9], (p[4], p[5]), (p[6], p[7]))):
        block = p[:4]
        g, q = (*block, p[4], p[5]), (*block, p[6], p[7])
        if g not in gold and q not in predicted:
            gold.add(g)
            predicted.add(q)
            out.add(p)
    return out


@pytest.mark.parametrize("block_pairs", [10**6, 40, 0])
def test_greedy_is_the_sequential_outcome(spark, block_pairs):
    rng = random.Random(3)
    pairs = {}
    for _ in range(500):
        relation = rng.choice(["OFFERS", "SERVES", "SERVES"])
        ends = tuple(rng.choice("abcdefg") for _ in range(4))
        key = (f"c{rng.randrange(3)}", "BusinessSegment", relation, "X", *ends)
        pairs[key] = rng.choice([(1.0, "exact"), (0.75, "object_parent_child"), (0.75, "subject_parent_child"), (0.5, "segment_rollup")])
    rows = [(*k, *v) for k, v in pairs.items()]
    names = "company string, subject_type string, relation string, object_type string, g_s string, g_o string, p_s string, p_o string, weight double, reason string"
    got = evaluate.greedy(spark.createDataFrame(rows, names), ["company"], block_pairs)
    assert {tuple(r) for r in got.select(*[n.split()[0] for n in names.split(", ")]).collect()} == in_order(rows)


def test_swap_keeps_what_it_can_not_replace(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "results")
    runs.swap_in(spark, path, lambda p: spark.range(3).write.parquet(p))
    runs.swap_in(spark, path, lambda p: spark.range(5).write.parquet(p))
    assert spark.read.parquet(path).count() == 5

    def fails(p):
        spark.range(1).write.parquet(p)
        raise OSError("disk")

    with pytest.raises(OSError):
        runs.swap_in(spark, path, fails)
    with pytest.raises(Exception):  # nothing was staged, so the new folder can't be moved
        runs.swap_in(spark, path, lambda p: None)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["results"]


def _sides(spark):
    names = "company string, subject string, subject_type string, relation string, object string, object_type string"
    rows = [(c, *r) for c in ("x", "y") for r in [(c, "Company", "HAS_SEGMENT", "s", "BusinessSegment"), ("s", "BusinessSegment", "OFFERS", "o", "Offering"), ("o", "Offering", "OFFERS", "p", "Offering")]]
    return spark.createDataFrame(rows, names), spark.createDataFrame(rows[:-1], names)


def test_candidates_broadcast_no_table(spark):
    """tables of names were broadcast by the size of their compressed files."""
    pairs = evaluate.candidates(*_sides(spark), ["company"])
    assert "BroadcastExchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.where("reason = 'exact'").count() == 5


def test_relaxed_broadcasts_no_table(spark):
    """nor are the matches of each group."""
    out = evaluate.relaxed(*_sides(spark), ["company"])
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.company, r.relaxed_true_positives) for r in out.collect()) == [("x", 3.0), ("y", 2.0)]
