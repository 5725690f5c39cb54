import os
import random

import pytest

from energraph.llm.packing import TOKENIZER, pack, pack_histogram, slots, token_counter

SCHEMA = "doc_id long, text string, length int, part int, container int"


def test_patterns_hold_every_item_and_fill_well():
    rng = random.Random(1)
    for capacity in (1, 10, 257, 2048):
        h = {}
        for _ in range(5000):
            n = min(capacity, 1 + int(rng.expovariate(5 / capacity)))
            h[n] = h.get(n, 0) + 1
        patterns = pack_histogram(h, capacity)
        held = {}
        for n, p in patterns:
            assert sum(a * t for a, t in p) <= capacity
            for a, t in p:
                held[a] = held.get(a, 0) + n * t
        assert held == h
        total = sum(a * n for a, n in h.items())
        assert sum(n for n, _ in patterns) <= 1.02 * total / capacity + 1
    assert pack_histogram({}, 10) == [] and len(slots([])["rank"]) == 0
    assert sum(n for n, _ in pack_histogram({3: 10**9, 7: 10**9}, 10)) == 10**9


def test_places(spark):
    if not os.path.exists(TOKENIZER):
        pytest.skip("no tokenizer file")
    rng = random.Random(4)
    texts = [(i, "word " * rng.randrange(1, 70) if i % 3 else "same text") for i in range(300)]
    texts += [(900, None), (901, ""), (902, "long " * 5000), (903, "same text"), (903, "same text"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 0, 0, 0) for i, t in texts], SCHEMA)
    got = pack(df, capacity=64).collect()
    again = pack(df.repartition(7), capacity=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    count = token_counter(TOKENIZER)
    by_doc, by_box = {}, {}
    for r in got:
        by_doc.setdefault(r.key, []).append(r)
        if r.container is not None:
            by_box.setdefault(r.container, []).append((r.container_offset, r.n_tokens))
    for i, t in texts:
        n = count([t])[0] if t else 0
        assert sum(r.n_tokens for r in by_doc[i]) == n * (2 if i == 903 else 1)
        if n <= 64:
            assert all(r.piece == 0 for r in by_doc[i])
    assert by_doc[900][0].container is None and by_doc[901][0].container is None
    for items in by_box.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 64
    total = sum(r.n_tokens for r in got)
    assert len(by_box) <= 1.1 * total / 64 + 1 and sorted(by_box) == list(range(len(by_box)))
    assert pack(df.limit(0), capacity=64).count() == 0


def test_tokenizer_kinds():
    folder = os.path.dirname(TOKENIZER)
    for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"):
        if os.path.exists(f"{folder}/{name}"):
            assert all(n > 0 for n in token_counter(f"{folder}/{name}")(["Hello there.", "<|endoftext|>"]))
    with pytest.raises(ValueError):
        token_counter("x.txt")
