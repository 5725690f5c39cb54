import random
from collections import Counter, defaultdict

from energraph.llm.terms import term_frequencies

SCHEMA = "node_id string, entities array<string>, term string, df int, mark string"


def frequencies(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(n, e, "x", 1, "y") for n, e in rows], SCHEMA).repartition(parts)
    return {r.term: (r.mentions, r.df, r.records, r.mark) for r in term_frequencies(df, "node_id", "entities", **more).collect()}


def test_cases(spark):
    rows = [("a", ["Lake  X", "lake\tx", " lake x ", None, "", "  "]), ("a", ["Lake  X", "lake\tx", " lake x ", None, "", "  "]), ("b", ["LAKE X"]), ("c", None), ("d", []), (None, ["ghost"]), ("e", ["solo"])]
    assert frequencies(spark, rows, max_df_ratio=0.3) == {"lake x": (4, 2, 5, "common"), "solo": (1, 1, 5, "rare")}
    assert frequencies(spark, rows, max_df_ratio=0.4)["lake x"][3] is None  # not more than the ratio
    assert frequencies(spark, []) == {}
    assert frequencies(spark, [("a", None), ("b", [])]) == {}


def test_hot_term_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"n{i:04d}", (["hot"] if i % 3 == 0 else []) + [f"t{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randrange(6))]) for i in range(2500)]
    rows += rng.sample(rows, 60)  # delivered again
    mentions, nodes = Counter(), defaultdict(set)
    for n, e in dict(rows).items():
        for t in e:
            mentions[t] += 1
            nodes[t].add(n)
    for parts in (1, 7):
        got = frequencies(spark, rows, parts)
        assert {t: v[:2] for t, v in got.items()} == {t: (mentions[t], len(nodes[t])) for t in mentions}
        assert {v[2] for v in got.values()} == {2500}


def test_long_terms_and_arrays(spark):
    got = frequencies(spark, [("a", ["x" * 100_000] * 3), ("b", [f"t{i}" for i in range(20_000)])])
    assert got["x" * 100_000][:2] == (3, 1) and len(got) == 20_001
