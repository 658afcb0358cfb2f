"""Sources, staging and streams: what the queries with SQL don't reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import staging
from tidemark.operators import events, impact, ranks
from tidemark.sources import tables as src
from tidemark.streaming import live


def test_slices_hold_every_day_once():
    for n in (1, 3, 7, 400):
        cut = src.slices(dt.date(2020, 2, 1), dt.date(2020, 3, 1), n)
        assert cut[0][0] == dt.date(2020, 2, 1) and cut[-1][1] == dt.date(2020, 3, 2)
        assert all(a[1] == b[0] for a, b in zip(cut, cut[1:])) and all(a < b for a, b in cut)


def test_sources(spark, tmp_path):
    spark.range(3).selectExpr("id", "concat('n', id) AS name").write.option("header", True).csv(str(tmp_path / "d"))
    assert src.dimension(spark, str(tmp_path / "d"), "id int, name string").count() == 3
    assert src.reachable(lambda: spark.range(1)) and not src.reachable(lambda: spark.read.parquet(str(tmp_path / "none")))
    assert src.run_all({"a": lambda: 1, "b": lambda: spark.range(5).count()}) == {"a": 1, "b": 5}
    with pytest.raises(ZeroDivisionError):
        src.run_all({"a": lambda: 1 / 0})
    df = spark.createDataFrame([(1, dt.date(2001, 1, 1)), (2, dt.date(2003, 1, 1)), (None, dt.date(2001, 1, 1)), (4, None)], "id int, d date")
    src.export_years({"t": (src.valid(df, "id", "d"), "d")}, str(tmp_path / "out"))
    assert src.missing_years(spark, str(tmp_path / "out"), "t", [2001, 2002, 2003]) == [2002]
    assert src.valid(df, "id", "d", 2003).count() == 1
    with pytest.raises(ValueError):
        src.save_index(df, str(tmp_path / "x"), "csv")


def test_query_cache_keeps_the_newest(spark, tmp_path):
    made = []

    def make(n):
        made.append(n)
        return spark.range(n)

    cache = src.QueryCache(spark, str(tmp_path), most=2)
    assert [cache.get(str(n), lambda n=n: make(n)).count() for n in (1, 2, 1, 3, 2, 1)] == [1, 2, 1, 3, 2, 1]
    assert made == [1, 2, 3, 1] and len(list(tmp_path.iterdir())) == 2


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, _):
            return None

    class Context:
        applicationId, master = "another", "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        staging.shared_dir(Session())


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    place = str(tmp_path / "t")
    merge = live.upsert(place, ["k"], "o", buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), "k int, o int, v string")
    merge(rows(*((k, 0, "a") for k in range(40))), 0)
    merge(rows((3, 2, "b"), (3, 1, "c"), (50, 0, "n")), 1)
    merge(rows((3, 2, "b"), (3, 1, "c"), (50, 0, "n")), 1)  # again, as after a failure
    merge(rows((4, 5, "d"), (3, 0, "old")), 2)
    got = {r.k: (r.o, r.v) for r in live.current(spark, place).collect()}
    assert len(got) == 41 and got[3] == (2, "b") and got[4] == (5, "d") and got[5] == (0, "a") and got[50] == (0, "n")
    for i in range(3, 7):
        merge(rows(*((k, i, "x") for k in range(60))), i)
    assert {p.name for p in (tmp_path / "t").iterdir()} == {"v0000000005", "v0000000006"}
    assert live.current(spark, place).where("v = 'x'").count() == 60


def test_quantiles_of_groups(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [("a", float(v)) for v in rng.integers(0, 9, 50)] + [("b", float(v)) for v in rng.normal(size=201)] + [("c", 1.5), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for p in (0.0, 0.3, 0.5, 1.0):
        got = {r.g: r.quantile for r in ranks.quantile(df, ["g"], "v", p).collect()}
        assert set(got) == {"a", "b", "c"}
        for g in got:
            assert got[g] == pytest.approx(np.quantile([v for x, v in rows if x == g], p))


def test_near_pairs_against_all_pairs(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=7 * i + i % 3) for i in range(60)]
    a = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "a int, x date")
    b = spark.createDataFrame([(i, d) for i, d in enumerate(days[::2])], "b int, y date")
    got = {(r.a, r.b) for r in impact.near_pairs(a, b, "x", "y").collect()}
    import math

    want = {(i, j) for i, d in enumerate(days) for j, e in enumerate(days[::2]) if math.exp(-(((d - e).days / 21) ** 2) / 2) >= 0.01}
    assert got == want


def test_membership_in_two_rounds(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=int(i))
    rows, seeds = [], []
    for c in range(2):
        centre = np.eye(4)[c]
        for i in range(30):
            near = i < 20
            v = centre + rng.normal(0, 0.05, 4) if near else rng.normal(size=4)
            rows.append((100 * c + i, "k", day(40 * c + i % 5 if near else rng.integers(0, 200)), [float(x) for x in v], 0.9 if near else 0.1))
            if i < 4:
                seeds.append((100 * c + i, f"k:{c}"))
    r = spark.createDataFrame(rows, "key long, kind string, day date, vector array<double>, w double")
    s = spark.createDataFrame(seeds, "key long, occurrence string")
    centres = spark.createDataFrame([(f"k:{c}", "k", day(40 * c + 2), [float(x) for x in np.eye(4)[c]]) for c in range(2)], "occurrence string, kind string, peak date, centroid array<double>")
    got, moved = events.assign_twice(r, s, centres, "kind", "key", "day", "vector", "w", 4)
    held = {(x.key, x.occurrence): x.belonging for x in got.collect()}
    assert set(seeds) <= set(held) and all(0 <= b <= 1 for b in held.values())
    assert all(k // 100 == int(o[-1]) for (k, o), b in held.items() if b > 0)
    assert sum(b > 0 for b in held.values()) >= 30 and moved.where(F.size("centroid") == 4).count() == 2
    apart = events.merge_types(s.withColumn("kind", F.lit("k")), s.select("occurrence").distinct().withColumn("cluster", F.lit("e")), centres.withColumn("mass", F.lit(1.0)), "key")
    assert {x.occurrence for x in apart.collect()} == {"k:0", "k:1"}
