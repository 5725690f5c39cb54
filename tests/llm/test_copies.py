import json
import random
import re

import numpy as np

from energraph.llm import copies as cp
from energraph.llm.copies import Filter, copies, merge, observe, repeats_filter

SCHEMA = "chunk_id string, title string, text string, facts string, digest string, h long, share int"


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(parts)
    return {r.key: (r.keep, r.copies) for r in copies(df, "chunk_id", "title", "text", "facts").collect()}


def test_cases(spark):
    rows = [
        ("b", "A Title!", "Some text, here.", '{"Area km2": "1,200", "b": 1.50}'),
        ("a", "a  title", "some TEXT here", '{ "B":1.50, "area_km2" : "1200"}'),
        ("c", "a title", "some text here", '{"area km2": "1200", "b": 1.5}'),
        ("d", None, "some text here", None), ("e", "", "Some-text here", None), ("f", "", "some text here", "{}"),
        ("g", "t", None, None), ("h", "t", "...", None), ("i", "t", "", None), ("h", "t", "...", None),
        ("j", "x", "y", "not json"), ("k", "X", "Y", "NOT JSON!"), ("a", "a  title", "some TEXT here", '{ "B":1.50, "area_km2" : "1200"}'), (None, "x", "y", None),
    ]
    got = run(spark, rows)
    assert got == {"a": ("a", 2), "b": ("a", 2), "c": ("c", 1), "d": ("d", 2), "e": ("d", 2), "f": ("f", 1), "g": ("g", 1), "h": ("h", 1), "i": ("i", 1), "j": ("j", 2), "k": ("j", 2)}
    assert run(spark, []) == {}


def test_hot_group_and_long_text_against_brute_force(spark):
    rng = random.Random(2)
    words = ["alpha", "Beta", "gamma2", "Δέλτα", "эхо"]
    rows = []
    for i in range(2400):
        text = "hot passage" if i % 3 == 0 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))
        text = rng.choice([text, text.upper(), text.replace(" ", "  - "), f"«{text}»"])
        facts = rng.choice([None, json.dumps({"K": "v"}), '{"k":"V"}'])
        rows.append((f"c{i:05d}", rng.choice(["T", "t."]), text, facts))
    rows += [("long1", "", "z" * 500_000, None), ("long2", "", "Z-" * 500_000, None)]
    sets = {}
    for key, title, text, facts in rows:
        norm = tuple(re.sub(r"[\W_]", "", x.lower()) for x in (title, text)) + (None if facts is None else re.sub(r"[\W_]", "", facts.lower()),)
        sets.setdefault(norm, []).append(key)
    want = {k: (min(s), len(s)) for s in sets.values() for k in s}
    assert run(spark, rows, 5) == want


def test_merged_filters_miss_no_repeat():
    rng = np.random.default_rng(0)
    parts = [rng.integers(-(2**63), 2**63 - 1, 4000) for _ in range(4)]
    parts[3][:500] = parts[0][:500]
    parts[2][:100] = parts[2][100:200]
    pairs = []
    for h in parts:
        once, again = Filter(), Filter()
        for lo in range(0, len(h), 1500):
            observe(once, again, 0, h[lo : lo + 1500])
        pairs.append((once.segment(0), again.segment(0)))
    once, again = pairs[0]
    for other in pairs[1:]:
        merge(once, again, *other)
    hit = Filter({0: again})
    assert hit.has(0, parts[0][:500]).all() and hit.has(0, parts[2][:100]).all()
    assert hit.has(0, parts[1]).mean() < 0.01


def test_many_segments_give_the_same(spark, monkeypatch):
    rows = [(f"c{i:04d}", "t", f"text {i % 700}", None) for i in range(1000)]
    want = run(spark, rows)
    monkeypatch.setattr(cp, "SEGMENT_BITS", 10)
    monkeypatch.setattr(cp, "SHARE_SEGMENTS", 4)
    assert run(spark, rows) == want and sum(n > 1 for _, n in want.values()) == 600
    assert repeats_filter(spark.range(0).selectExpr("0 AS share", "id AS h"), 4).count() == 0


def test_as_many_jobs_for_many_segments_as_for_one(spark, monkeypatch):
    rows = [(f"c{i:04d}", "t", f"text {i % 700}", None) for i in range(1000)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    counts = []
    for bits in (23, 10):
        monkeypatch.setattr(cp, "SEGMENT_BITS", bits)
        monkeypatch.setattr(cp, "SHARE_SEGMENTS", 4)
        group = f"copies {bits}"
        spark.sparkContext.setJobGroup(group, group)
        assert copies(df, "chunk_id", "title", "text", "facts").where("copies > 1").count() == 600
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        spark.sparkContext.setJobGroup("rest", "rest")
    assert cp.segments_for(1000) == 16 and counts[0] == counts[1]
