from energraph.llm.sampling import sampled, sequence_numbers, stable_sample

SCHEMA = "id string, batch int, seq int, block int, part int"


def rows(n=600):
    return [(f"q{i * 7919 % n:04d}", i % 9 + 1) for i in range(n)]


def sample(spark, data, parts=2, **more):
    df = spark.createDataFrame([(i, b, 0, 0, 0) for i, b in data], SCHEMA).repartition(parts)
    return {r.key: (r.batch, r.seq, r.block, r.pos) for r in stable_sample(df, "id", "batch", **more).collect()}


def test_reruns_layouts_and_growth(spark):
    data = rows()
    whole = sample(spark, data)
    assert sample(spark, data[::-1] + data[:50], 5) == whole and len(whole) == 60
    for upto in (3, 6):
        early = sample(spark, [r for r in data if r[1] <= upto])
        assert early.items() <= whole.items() and {k for k, v in whole.items() if v[0] <= upto} == set(early)
    later = data + [(i, 8) for i, b in data if b <= 2]  # an id that comes again keeps its first batch
    assert sample(spark, later) == whole


def test_numbers_and_blocks(spark):
    data = rows(105) + [(None, 1), ("late", None)]
    df = spark.createDataFrame([(i, b, 0, 0, 0) for i, b in data], SCHEMA)
    numbers = {r.key: r.seq for r in sequence_numbers(df, "id", "batch").collect()}
    order = sorted((b, i) for i, b in rows(105))
    assert numbers == {i: n for n, (_, i) in enumerate(order)} | {"late": 105}
    per_block = {}
    for _, seq, block, pos in sample(spark, data, block_size=10, per_block=3).values():
        assert (seq // 10, seq % 10) == (block, pos)
        per_block[block] = per_block.get(block, 0) + 1
    assert all(n == 3 for b, n in per_block.items() if b < 10)
    assert sample(spark, []) == {} and len(sample(spark, data, block_size=5, per_block=5)) == 106
    assert sample(spark, data, seed=1) != sample(spark, data, seed=2)


def test_stored_numbers_keep_a_late_row_of_an_old_batch_from_moving_others(spark):
    data = rows(300)

    def table(rows):
        return spark.createDataFrame([(i, b, 0, 0, 0) for i, b in rows], SCHEMA)

    empty = spark.createDataFrame([], "key string, batch long, seq long")
    first = sequence_numbers(table(data[:200]), "id", "batch", empty)
    assert {r.key: r.seq for r in first.collect()} == {r.key: r.seq for r in sequence_numbers(table(data[:200]), "id", "batch").collect()}
    first = spark.createDataFrame(first.collect(), first.schema)
    late = [("late1", 1), ("late0", 1), *data[200:], *data[:7]]
    second = sequence_numbers(table(data[:200] + late), "id", "batch", first)
    old, new = ({r.key: (r.batch, r.seq) for r in t.collect()} for t in (first, second))
    assert old.items() <= new.items() and sorted(s for _, s in new.values()) == list(range(302))
    assert new["late0"][1] == 200 + sorted((b, i) for i, b in {("late1", 1), ("late0", 1), *data[200:]}).index((1, "late0"))
    again = {r.key for r in sampled(first).collect()}
    assert again and again <= {r.key for r in stable_sample(table(late), "id", "batch", stored=first).collect()}
