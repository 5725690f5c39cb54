import random
import re
import uuid

from energraph.llm import leaks as lk
from energraph.llm.leaks import code_points, leaks, shingle_hashes

DOC = "doc_id long, text string, words string, id long"
ITEM = "item_id long, text string, words string"


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], DOC).repartition(3)
    e = spark.createDataFrame([(i, t, "w") for i, t in items], ITEM)
    return {(r.doc_id, r.item_id) for r in leaks(d, e, **more).collect()}


def brute(docs, items, run=60):
    flat = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    out = set()
    for i, item in items:
        runs = {flat(item)[k : k + run] for k in range(len(flat(item)) - run + 1)}
        for d, text in docs:
            if any(flat(text)[k : k + run] in runs for k in range(len(flat(text)) - run + 1)):
                out.add((d, i))
    return out


def noise(rng, n):
    return " ".join("".join(rng.choice("abcdefgжзи") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_against_brute_force(spark):
    rng = random.Random(7)
    items = [(i, noise(rng, 40)) for i in range(12)] + [(50, "too short"), (51, None), (52, ""), (0, "")]
    common = noise(rng, 20)
    items += [(60, common + noise(rng, 10)), (61, common + noise(rng, 10))]
    docs = [(1, None), (2, ""), (3, "short")]
    for d in range(10, 90):
        text = noise(rng, 60)
        if d % 2:
            src = re.sub(r"\s", "", rng.choice(items[:12])[1])
            n, at = rng.choice([58, 59, 60, 61, 90]), rng.randrange(0, 60)
            cut = src[at : at + n]
            cut = rng.choice([cut, cut.upper(), "-".join(cut), cut.replace("a", "a­ ")])
            text = noise(rng, 5) + "ж" + cut + "x" + noise(rng, 5)
        docs.append((d, text))
    docs += [(100, common), (100, common), (101, noise(rng, 30) + common.upper())]
    want = brute(docs, items)
    assert len(want) > 15 and run(spark, docs, items) == want


def test_blocks_pieces_and_empty(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, noise(rng, 30)) for i in range(6)]
    docs = [(1, noise(rng, 400) + items[3][1] + noise(rng, 400)), (2, items[0][1] + items[5][1]), (3, noise(rng, 90))]
    want = brute(docs, items)
    monkeypatch.setattr(lk, "BLOCK_CHARS", 200)
    monkeypatch.setattr(lk, "PIECE", 300)
    monkeypatch.setattr(lk, "STEP", 500)
    assert run(spark, docs, items) == want == {(1, 3), (2, 0), (2, 5)}
    assert run(spark, [], items) == set() and run(spark, docs, []) == set()


def test_hashes_are_those_of_the_shingles():
    text = code_points("abcdefghij" * 8)
    for q in (1, 2, 3, 5, 8, 24, 60):
        h = shingle_hashes(text, q)
        assert len(h) == 80 - q + 1 and len(set(h.tolist())) == 10 and (h[:-10] == h[10:]).all()
    assert len(shingle_hashes(text[:5], 6)) == 0


def jobs(spark, run_it):
    """Spark's jobs while a function runs."""
    tracker, group = spark.sparkContext.statusTracker(), f"leaks {uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, group)
    run_it()
    n = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("rest", "rest")
    return n


def test_as_many_jobs_for_many_items_as_for_few(spark):
    rng = random.Random(3)
    items = [(i, noise(rng, 40)) for i in range(600)]
    docs = [(d, noise(rng, 20) + items[d * 5][1]) for d in range(60)]
    few, many = (jobs(spark, lambda own=own: run(spark, docs, own)) for own in (items[:20], items))
    assert few == many


def test_items_that_share_all_their_text(spark, monkeypatch):
    rng = random.Random(4)
    same = noise(rng, 30)
    items = [(i, same) for i in range(40)] + [(99, same + "tail")]
    docs = [(d, noise(rng, 3) + same) for d in range(50)]
    want = {(d, i) for d, _ in docs for i, _ in items}
    assert run(spark, docs, items) == want
    monkeypatch.setattr(lk, "BROADCAST_PLACES", 0)
    assert run(spark, docs, items) == want


def test_each_window_has_a_candidate():
    import numpy as np

    h = np.random.default_rng(1).permutation(399).astype(np.uint64) * np.uint64(4 << 11) + np.uint64(1 << 11)  # none by its hash
    chosen = lk.candidates(h, 37)
    assert all(chosen[w : w + 37].any() for w in range(len(h) - 36)) and chosen.sum() < 30
