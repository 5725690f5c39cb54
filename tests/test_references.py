from datetime import datetime, timedelta

import numpy as np
import pytest

from energraph.operators import references as rf
from energraph.operators.references import orphan_report, orphans

REF = "ref_table string, ref_field string, ref_id string, target_id string, at timestamp, scoped boolean, key string, slot int"
PARENT = "key string, begins timestamp, ends timestamp, scoped boolean, range_no int"
T = datetime(2024, 5, 17)


def day(n):
    return T + timedelta(days=n)


def run(spark, refs, parents, **more):
    r = spark.createDataFrame([("t", "f", i, k, at, s, "x", 1) for i, k, at, s in refs], REF)
    p = spark.createDataFrame([(*x, 1) for x in parents], PARENT)
    return {(x.ref_id, x.target_id, x.ref_month, x.kind) for x in orphans(r, p, **more).collect()}


def test_cases(spark):
    parents = [("a", day(0), None, True), ("b", day(0), day(5), True), ("b", day(8), None, True), ("b", day(0), day(5), True), ("p", day(0), None, False), ("n", None, day(3), True), (None, day(0), None, True), ("never", day(4), day(2), True)]
    refs = [
        ("1", "a", day(0), True), ("2", "a", day(-1), True), ("3", "b", day(5), True), ("4", "b", day(4), True), ("5", "b", day(8), True), ("6", "x", day(0), True), ("6", "x", day(0), True),
        ("7", "p", day(1), True), ("8", "p", day(1), False), ("9", None, day(1), True), ("10", "", day(1), True), ("11", "a ", day(1), True), ("12", "n", day(-99), True), ("13", "n", day(3), True),
        ("14", "a", None, True), ("15", "zz", None, True), ("16", "never", day(3), True), ("17", "never", day(5), True),
    ]
    want = {
        ("2", "a", "2024-05", "late"), ("3", "b", "2024-05", "deleted"), ("6", "x", "2024-05", "missing"), ("7", "p", "2024-05", "missing"), ("11", "a ", "2024-05", "missing"),
        ("13", "n", "2024-05", "deleted"), ("15", "zz", None, "missing"), ("16", "never", "2024-05", "late"), ("17", "never", "2024-05", "deleted"),
    }
    assert run(spark, refs, parents) == want
    assert run(spark, refs[:1], []) == {("1", "a", "2024-05", "missing")} and run(spark, [], parents) == set()


@pytest.mark.parametrize("range_rows,slot_rows", [(40, 100), (1 << 15, 1 << 17)])
def test_hot_key_against_brute_force(spark, range_rows, slot_rows):
    rng = np.random.default_rng(0)
    parents = []
    for i in rng.integers(0, 400, 900).tolist():
        begin = int(rng.integers(0, 300))
        parents.append((f"k{i:03d}", day(begin), None if rng.random() < 0.3 else day(begin + int(rng.integers(1, 40))), bool(rng.random() < 0.5)))
    refs = [(str(i), "k007" if i % 3 == 0 else f"k{int(rng.integers(0, 450)):03d}", day(int(rng.integers(0, 330))), bool(rng.random() < 0.5)) for i in range(2000)]
    want = set()
    for i, k, at, scoped in refs:
        own = [p for p in parents if p[0] == k and (p[3] or not scoped)]
        if not any(b <= at and (e is None or e > at) for _, b, e, _ in own):
            want.add((i, k, at.strftime("%Y-%m"), "missing" if not own else "late" if min(p[1] for p in own) > at else "deleted"))
    assert run(spark, refs, parents, range_rows=range_rows, slot_rows=slot_rows) == want


def test_one_key_longer_than_a_range(spark):
    parents = [("k", day(i), day(i + 1), True) for i in range(50)] + [("l", day(0), None, True)]
    assert run(spark, [("1", "k", day(49), True), ("2", "k", day(50), True), ("3", "l", day(9), True)], parents, range_rows=8) == {("2", "k", "2024-07", "deleted")}


def test_latest_end_counts(spark):
    keys, begins, ends = np.array(["a", "a", "a", "b"], object), np.array([0, 1, 2, 0]), np.array([9, 2, 3, 1])
    there, begun, lives = rf._last_begun(keys, begins, ends, np.array(["a", "a", "b", "c"], object), np.array([5, 9, 1, 1]))
    assert there.tolist() == [True, True, True, False] and begun.tolist() == [True, True, True, False] and lives.tolist() == [True, False, False, False]


def test_report(spark):
    found = spark.createDataFrame([("t", "f", "1", "x", "2024-05", "missing"), ("t", "f", "2", "x", "2024-05", "missing")], "ref_table string, ref_field string, ref_id string, target_id string, ref_month string, kind string")
    assert [(r.n_refs, r.n_targets) for r in orphan_report(found).collect()] == [(2, 1)]
