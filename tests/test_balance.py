"""Neighbours, balancing, splits, medians and scaling against plain computation."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradpath.operators import balance as ba
from gradpath.operators import knn, scale
from gradpath.operators.scale import MedianImputer, PopulationScaler
from gradpath.schema import FEATURES, LABEL

ROW = "id bigint, " + ", ".join(f"{f} double" for f in FEATURES) + f", {LABEL} int"


def random_rows(n, seed, clumped=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if clumped and i % 3 == 0:
            row = (20.0, 1.0, 1.0, 2.0, 7.5, 0.0, 0.0)  # a third of all rows are one vector
        else:
            cgpa = round(rng.uniform(0, 10), 2) if not clumped else 5 + rng.random() / 500
            row = (float(rng.choice([18, 19, 20, 25, 39])), float(rng.randrange(2)), float(rng.randrange(3)), float(rng.randrange(4)), cgpa, float(rng.randrange(2)), 0.0)
        rows.append((i, *row, 1))
    return rows


def brute(rows, k):
    out = {}
    for a in rows:
        d = sorted((sum((x - y) * (x - y) for x, y in zip(a[1:8], b[1:8])), b[0]) for b in rows if b[0] != a[0])
        out[a[0]] = [i for _, i in d[:k]]
    return out


@pytest.mark.parametrize("n,clumped,limit", [(150, False, None), (180, True, None), (180, True, 5), (4, False, None), (1, False, None)])
def test_nearest_equals_brute_force(spark, monkeypatch, n, clumped, limit):
    if limit:
        monkeypatch.setattr(knn, "BIN_LIMIT", limit)
    rows = random_rows(n, n, clumped)
    got = ba.class_neighbours(spark.createDataFrame(rows, ROW).repartition(3), 5)
    assert {r["id"]: [c["id"] for c in r["near"]] for r in got.collect()} == brute(rows, 5)


def test_balanced_classes_and_rows_between_parents(spark):
    rows = [r[:-1] + (1 if r[0] < 20 else 0,) for r in random_rows(90, 5)]
    df = spark.createDataFrame(rows, ROW)
    done = ba.balance(df).cache()
    assert {r[LABEL]: r["count"] for r in done.groupBy(LABEL).count().collect()} == {0: 70, 1: 70}
    near = {r["id"]: r for r in ba.class_neighbours(df.filter(F.col(LABEL) == 1)).collect()}
    new = done.filter("copy > 0").collect()
    assert len({(r["id"], r["copy"]) for r in new}) == 50
    for r in new:
        me, mates = near[r["id"]]["coords"], [c["coords"] for c in near[r["id"]]["near"]]
        point = [r[f] for f in FEATURES]
        inside = lambda m: all(min(a, b) - 1e-9 <= p <= max(a, b) + 1e-9 for a, b, p in zip(me, m, point))
        assert any(inside(m) for m in mates)
    again = ba.balance(df.repartition(7))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, done.collect()))


def test_shared_vectors_are_cut_before_the_shuffle(spark):
    from pyspark.sql import Window as W

    df = spark.createDataFrame(random_rows(30, 1, True), ROW)
    few = df.withColumn("_n", F.row_number().over(W.partitionBy(*FEATURES).orderBy("id"))).filter(F.col("_n") <= 6)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # once before and once after the exchange


def test_class_of_one_cannot_be_balanced(spark):
    rows = [r[:-1] + (1 if r[0] == 0 else 0,) for r in random_rows(10, 5)]
    with pytest.raises(ValueError):
        ba.balance(spark.createDataFrame(rows, ROW))


@pytest.mark.parametrize("wanted", [0, 1, 17, 299, 300, 301])
def test_smallest_by_hash_is_exact(spark, wanted):
    df = spark.range(300)
    key = ba.unit("id", 7)
    want = sorted((r["h"], r["id"]) for r in df.select("id", key.alias("h")).collect())[:wanted]
    assert sorted(r["id"] for r in ba.smallest_by_hash(df, wanted, key).collect()) == sorted(i for _, i in want)


def test_split_does_not_depend_on_partitions(spark):
    a = ba.assign_folds(ba.split(spark.range(2000))).collect()
    b = ba.assign_folds(ba.split(spark.range(2000).repartition(9))).orderBy("id").collect()
    assert sorted(a) == sorted(b)
    share = sum(r["in_train"] for r in a) / 2000
    assert 0.76 < share < 0.84
    assert {r["fold"] for r in a} == set(range(5))


def test_large_ids_do_not_overflow(spark):
    row = spark.createDataFrame([(2**62,), (-5,)], "id bigint").select(ba.unit("id", 42).alias("u")).collect()
    assert all(0 <= r["u"] < 1 for r in row)


@pytest.mark.parametrize("values", [[1, 2, 4, 9], [5, None, 1, 3], [7], [2, 2, 2, 8, 9, 9], list(range(1001))])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    assert scale.exact_medians(df, ["v"])["v"] == statistics.median([v for v in values if v is not None])


def test_median_narrows_a_full_bracket(spark, monkeypatch):
    monkeypatch.setattr(scale, "INLINE_VALUES", 40)
    monkeypatch.setattr(scale, "ACCURACY", 20)
    rng = random.Random(3)
    values = [rng.random() for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert scale.exact_medians(df, ["v"])["v"] == pytest.approx(statistics.median(values), abs=1e-15)


def test_population_deviation_and_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (9.0, 5.0)], "a double, b double")
    model = PopulationScaler(inputCols=["a", "b"]).fit(df)
    assert model.getOrDefault(model.deviations) == [pytest.approx(3.0822070014844885), 1.0]
    assert [r["b"] for r in model.transform(df).collect()] == [0.0] * 4


def test_statistics_come_from_the_training_rows(spark, tmp_path):
    train = spark.createDataFrame([(1.0,), (3.0,), (None,)], "a double")
    model = MedianImputer(inputCols=["a"]).fit(train)
    other = spark.createDataFrame([(None,), (100.0,)], "a double")
    assert [r["a"] for r in model.transform(other).collect()] == [2.0, 100.0]
    model.write().save(str(tmp_path / "m"))
    loaded = scale.MedianImputerModel.load(str(tmp_path / "m"))
    assert [r["a"] for r in loaded.transform(other).collect()] == [2.0, 100.0]
    with pytest.raises(ValueError):
        MedianImputer(inputCols=["a"]).fit(train.filter("a is null"))


def test_numbers_of_one_id_are_independent(spark):
    df = spark.range(0, 20000).select(*[ba.unit("id", n).alias(n) for n in ("split", "fold", "lucky", "pick1", "along1", "pick2")])
    names = df.columns
    r = df.agg(*[F.corr(a, b).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[:i]], *[F.avg(n).alias(n) for n in names]).first().asDict()
    assert all(abs(v) < 0.03 for k, v in r.items() if "_" in k)
    assert all(abs(r[n] - 0.5) < 0.01 for n in names)


def test_folds_of_the_training_rows_are_even(spark):
    rows = spark.range(0, 20000).withColumn("copy", (F.col("id") % 3).cast("int"))
    for key in ("id", ba.row_key()):
        train = ba.split(rows, key=key).filter("in_train")
        sizes = [r["count"] for r in ba.assign_folds(train, 5, key).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) < 1.1 * min(sizes)


def test_far_ids_and_their_copies(spark):
    far = spark.createDataFrame([(10**18 + k * 2**33, c) for k in range(500) for c in (0, 1)], "id bigint, copy int")
    u = [r["u"] for r in far.select(ba.unit(ba.row_key(), "split").alias("u")).collect()]
    assert len(set(u)) == len(u) and 0.45 < sum(u) / len(u) < 0.55


def test_missing_coordinates_are_refused(spark):
    from gradpath.schema import FEATURES

    row = {f: 1.0 for f in FEATURES}
    df = spark.createDataFrame([(1, *row.values()), (2, None, *list(row.values())[1:])], "id bigint, " + ", ".join(f"{f} double" for f in FEATURES))
    with pytest.raises(ValueError):
        ba.class_neighbours(df)


def test_training_rows_with_gaps_are_balanced(spark):
    from gradpath.plans.train import balanced_split
    from gradpath.schema import FEATURES, LABEL

    rows = [(i, 20 + i % 4 if i % 7 else None, i % 2, i % 3, i % 4, (i % 50) / 5 if i % 5 else None, 0, 1, int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{f} double" if f == "CGPA" else f"{f} int" for f in FEATURES) + f", {LABEL} int")
    for order in ("split_first", "reference"):
        train, test = balanced_split(df, order)
        both = train if order == "split_first" else train.unionByName(test)
        counts = [r["count"] for r in both.groupBy(LABEL).count().collect()]
        assert len(counts) == 2 and counts[0] == counts[1]


def plain_neighbours(rows, k):
    out = {}
    for i, x in rows:
        def d2(y):
            total = 0.0
            for a, b in zip(x, y):
                total += (a - b) * (a - b)
            return total
        out[i] = sorted((d2(y), j) for j, y in rows if j != i)[:k]
    return out


@pytest.mark.parametrize("n,cell,kind", [(400, 20, "even"), (400, 7, "clumped"), (300, 1000, "even"), (250, 3, "equal"), (4, 2, "even"), (350, 9, "line")])
def test_pivot_partitions_equal_all_pairs(spark, n, cell, kind):
    from gradpath.operators import pivots

    rng = np.random.default_rng(n + cell)
    x = rng.normal(size=(n, 3)) * 5
    if kind == "clumped":
        x = np.round(x / 20, 2) + rng.integers(0, 3, (n, 1)) * 40
        x[0] = 1e4
    if kind == "equal":
        x = np.round(rng.normal(size=(n, 3)) * 0.7)
    if kind == "line":
        x[:, 1:] = 0.0
    rows = [(int(i * 3 + 1), [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame([(i, *r) for i, r in rows], "id bigint, a double, b double, c double").repartition(3)
    got = pivots.nearest(df, ["a", "b", "c"], 5, cell=cell, slice_=6).collect()
    want = plain_neighbours(rows, 5)
    assert len(got) == n
    for r in got:
        assert [(c["d2"], c["id"]) for c in r["near"]] == want[r["id"]]
        assert all(dict(rows)[c["id"]] == c["coords"] for c in r["near"])


def test_balancing_of_fractional_features(spark):
    rng = np.random.default_rng(4)
    data = [(i, 20.3 + float(rng.normal()), i % 2, i % 5, i % 3, float(rng.uniform(4, 9)), 0, 1, int(i < 30)) for i in range(90)]
    df = spark.createDataFrame(data, "id bigint, " + ", ".join(f"{f} double" if f in ("Age", "CGPA") else f"{f} int" for f in FEATURES) + ", PlacedOrNot int")
    done = ba.balance(df)
    assert {r["PlacedOrNot"]: r["count"] for r in done.groupBy("PlacedOrNot").count().collect()} == {0: 60, 1: 60}
    near = {r["id"]: r["near"] for r in ba.class_neighbours(df.filter("PlacedOrNot = 1")).collect()}
    rows = [(r[0], [float(v) for v in r[1:8]]) for r in data if r[8]]
    assert {i: [(c["d2"], c["id"]) for c in v] for i, v in near.items()} == plain_neighbours(rows, 5)
