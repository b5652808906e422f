import math
import random

from pyspark.sql import functions as F

from shroudline.operators import drift as B, skew


def test_lookup_splits_hot_keys_and_spreads_nulls(spark):
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    table = spark.createDataFrame([("hot", 1), ("k1", 2), ("unused", 3)], "k string, v int")
    got = skew.lookup(rows, table, ["k"], "id", target=100)
    plain = rows.join(table, "k", "left")
    assert got.count() == 3000
    order = ["id", "k", "v"]
    assert sorted(map(str, got.select(*order).collect())) == sorted(map(str, plain.select(*order).collect()))
    inner = skew.lookup(rows, table, ["k"], "id", "inner", target=100)
    assert inner.count() == rows.join(table, "k").count()


def test_prefix_sum_over_blocks(spark):
    rng = random.Random(1)
    rows = [(key, order, rng.randint(0, 9)) for key in "ab" for order in range(50)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    got = {(r.k, r.o): r.before for r in skew.prefix_sum(df, "k", "o", F.col("v"), "before", block=4).collect()}
    for key in "ab":
        total = 0
        for _, order, value in sorted(r for r in rows if r[0] == key):
            assert got[key, order] == total
            total += value


def test_bracketed_quantiles_are_exact(spark):
    rng = random.Random(5)
    groups = {"a": [rng.gauss(0, 1) for _ in range(30_001)], "b": [float(rng.randint(0, 3)) for _ in range(20_000)], "c": [1.5]}
    rows = [(g, v) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double").repartition(8)
    wanted = {"p50": 0.5, "p95": 0.95}
    stats = df.groupBy("g").agg(F.count("*").alias("n"), *B.brackets("v", wanted))
    for direct in (1_000, 100_000):  # through the sketch, and directly
        got = {r.g: r for r in B.exact_quantiles(df, "v", ["g"], wanted, stats, direct).collect()}
        for name, values in groups.items():
            values = sorted(values)
            assert [got[name].p50, got[name].p95] == [values[math.floor((len(values) - 1) * p)] for p in wanted.values()]


def test_numbers_and_sums_over_sparse_orders(spark):
    import random

    r = random.Random(3)
    rows = []
    for key, n in (("hot", 3000), ("a", 1), ("b", 40), ("c", 700)):
        orders = [*{r.randrange(-(2**62), 2**62) for _ in range(n - 1)}, 2**63 - 1]
        rows += [(key, o, r.randrange(5)) for o in orders]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o bigint, v int").repartition(6)
    number, total, want = {}, {}, {}
    for key, order, value in sorted(rows):
        want[key, order] = (number.get(key, 0), total.get(key, 0))
        number[key], total[key] = number.get(key, 0) + 1, total.get(key, 0) + value
    got = {(x.k, x.o): x.n for x in skew.dense_order(df, "k", "o", "n").collect()}
    assert got == {k: n for k, (n, _) in want.items()}
    for block in (4096, 7):  # 7: blocks of blocks, and more than block ** 3 rows
        got = {(x.k, x.o): x.s for x in skew.prefix_sum(df, "k", "o", F.col("v").cast("bigint"), "s", block=block).collect()}
        assert got == {k: s for k, (_, s) in want.items()}
    assert skew.dense_order(df.limit(0), "k", "o", "n").count() == 0
    twice = spark.createDataFrame([("a", 5), ("a", 5), ("a", -9), ("a", 7)], "k string, o bigint")
    assert sorted((x.o, x.n) for x in skew.dense_order(twice, "k", "o", "n").collect()) == [(-9, 0), (5, 1), (5, 1), (7, 2)]


def test_quantiles_by_narrowing_alone(spark):
    """Brackets of many values, of heavy ties, and of one value, down to a handful of values at a time."""
    rng = random.Random(6)
    groups = {
        "wide": [rng.gauss(0, 1e6) for _ in range(20_000)], "ties": [float(rng.choice([0, 0, 0, 1, 2, 900])) for _ in range(9_000)],
        "steps": [math.floor(rng.expovariate(1) * 300) / 8 for _ in range(9_000)], "same": [2.5] * 5_000, "two": [1.0, 9.0],
    }
    df = spark.createDataFrame([(g, v) for g, values in groups.items() for v in values], "g string, v double").repartition(8)
    wanted = {"least": 0.0, "p50": 0.5, "p999": 0.999, "most": 1.0}
    stats = df.groupBy("g").agg(F.count("*").alias("n"), *B.brackets("v", wanted))
    got = {r.g: r for r in B.exact_quantiles(df, "v", ["g"], wanted, stats, 3).collect()}
    for name, values in groups.items():
        values = sorted(values)
        assert [got[name][q] for q in wanted] == [values[math.floor((len(values) - 1) * p)] for p in wanted.values()], name


def test_large_top_n(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(40)]), rng.choice(["a", "b", "c", None]), i) for i in range(3_000)]
    rows += [(39, "c", -1)] * 50
    df = spark.createDataFrame(rows, "x int, y string, i int").repartition(7)
    low = (-1, "")
    for order in ([("x", True), ("y", False)], [("x", False), ("y", True), ("i", True)]):
        def key(row):
            values = {"x": row[0], "y": row[1], "i": row[2]}
            return [values[c] for c, _ in order]
        ordered = list(rows)
        for at, (_, down) in reversed(list(enumerate(order))):  # stable, the last column first; NULL is least
            ordered.sort(key=lambda row: (key(row)[at] is not None, key(row)[at] if key(row)[at] is not None else low[0] if order[at][0] != "y" else low[1]), reverse=down)
        for n in (1, 30, 77, 1500, 3049, 3050, 9000):
            got = [tuple(r) for r in skew.top(df, n, order, taken=0).collect()]
            assert sorted(map(repr, map(key, got))) == sorted(map(repr, map(key, ordered[:n]))), (order, n)
            assert sorted(map(repr, map(key, (tuple(r) for r in skew.top(df, n, order).collect())))) == sorted(map(repr, map(key, got)))
    assert skew.top(df.limit(0), 5, [("x", True)], taken=0).count() == 0
