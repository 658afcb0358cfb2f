"""Behaviour of the operators on small made-up tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import cluster, dominance
from tidemark.functions.exprs import cosine, first_max, flag
from tidemark.operators import detect, events, impact, paradigm, relational, resolve, series, vectors

DAY0 = dt.date(2020, 1, 1)


def day(i):
    return DAY0 + dt.timedelta(days=i)


def articles(spike: bool):
    """Ten rows a day for 200 days, two with the group; from day 150 to 159 twenty more."""
    rng = np.random.default_rng(42)
    rows, k = [], 0
    for d in range(200):
        for i in range(10 + (20 if spike and 150 <= d < 160 else 0)):
            hit = i < 2 or i >= 10
            rows.append((k, day(d), "hot" if hit else "rest", int(rng.integers(15)), int(rng.integers(5)), int(rng.integers(3))))
            k += 1
    return rows


def signals(spark, rows):
    a = spark.createDataFrame(rows, "k long, d date, f string, actor int, outlet int, source int")
    s = series.daily_proportions(a, "k", "d", "f")
    return a, series.trailing_z(s, "proportion", ["f"], "d").withColumn("composite", F.col("z"))


def test_spike_is_found_and_scored(spark):
    a, s = signals(spark, articles(True))
    b = detect.detect_bursts(s, "f", "d", "composite").where("f = 'hot'")
    found = b.collect()
    assert len(found) == 1 and found[0].onset <= day(151) and found[0].end >= day(158) and found[0].days <= 80
    r = detect.score_bursts(b, a, "f", "d", "actor", "outlet", "source").first()
    assert 0 < r.total <= 1 and r.classification in ("strong", "moderate", "weak") and r.n_outlets == 5 and r.n_actors == 15
    assert all(0 <= r[c] <= 1 for c in ("temporal", "participation", "convergence", "source"))


def test_flat_series_is_silent(spark):
    _, s = signals(spark, articles(False))
    assert detect.detect_bursts(s, "f", "d", "composite").count() == 0


def test_intervals_touching_nested_and_apart(spark):
    rows = [("g", day(0), day(3)), ("g", day(4), day(5)), ("g", day(1), day(2)), ("g", day(8), day(9)), ("h", day(0), day(0))]
    df = spark.createDataFrame(rows, "g string, a date, b date")
    got = {(r.g, r.a, r.b, r.merged) for r in series.merge_intervals(df, ["g"], "a", "b").collect()}
    assert got == {("g", day(0), day(5), 3), ("g", day(8), day(9), 1), ("h", day(0), day(0), 1)}
    assert detect.merge([(0, 3), (4, 5), (8, 9)]) == [(0, 5), (8, 9)]


def test_overlap_join_finds_each_pair_once(spark):
    rng = np.random.default_rng(0)
    make = lambda n, k: [(f"{k}{i}", day(int(a)), day(int(a + w))) for i, (a, w) in enumerate(zip(rng.integers(0, 300, n), rng.integers(0, 90, n)))]
    x, y = make(40, "x"), make(40, "y")
    a, b = spark.createDataFrame(x, "i string, a1 date, b1 date"), spark.createDataFrame(y, "j string, a2 date, b2 date")
    got = sorted((r.i, r.j) for r in relational.overlap_join(a, b, ("a1", "b1"), ("a2", "b2")).collect())
    assert got == sorted((i, j) for i, a1, b1 in x for j, a2, b2 in y if a1 <= b2 and a2 <= b1)


def test_nearest_takes_the_earlier_of_two(spark):
    left = spark.createDataFrame([("k", day(5)), ("k", day(9)), ("z", day(1))], "g string, d date")
    right = spark.createDataFrame([("k", day(3), 1), ("k", day(7), 2)], "g string, e date, v int")
    got = {(r.g, r.d): (r.nearest_e, r.v) for r in relational.nearest(left, "d", right, "e", "g", ["v"]).collect()}
    assert got == {("k", day(5)): (day(3), 1), ("k", day(9)): (day(7), 2), ("z", day(1)): (None, None)}


def test_flags_entities_and_articles(spark):
    df = spark.createDataFrame([("1", None, "2.5"), ("x", "0", "-1")], "a string, b string, c string")
    assert [tuple(r) for r in df.select(flag("a"), flag("b"), flag("c")).collect()] == [(1, 0, 1), (0, 0, 0)]
    n = spark.createDataFrame([(2, 3, 3), (0, 0, 0), (None, 1, 0)], "a int, b int, c int")
    assert [r[0] for r in n.select(first_max(["a", "b", "c"])).collect()] == ["b", None, "b"]
    j = spark.createDataFrame([(1, '{"PER":["Ann","Bob"],"ORG":"Acme"}'), (2, "broken {"), (3, None), (4, '{"PER":[]}')], "k int, j string")
    assert {tuple(r) for r in relational.explode_entities(j, ["k"], "j").collect()} == {(1, "PER", "Ann"), (1, "PER", "Bob"), (1, "ORG", "Acme")}
    s = spark.createDataFrame([(1, 2, None, 1.0), (1, 1, None, 3.0), (1, 3, "late", None), (None, 1, "x", 1.0)], "k int, o int, t string, v double")
    got = relational.to_articles(s, "k", ["o"], ["t"], ["v"]).collect()
    assert [tuple(r) for r in got] == [(1, "late", 4.0, 2.0, 3)]


def test_itemsets_against_brute_force(spark):
    from collections import Counter
    from itertools import combinations

    rng = np.random.default_rng(1)
    baskets = {k: set(rng.choice(list("abcdef"), int(rng.integers(1, 5)), replace=False)) for k in range(60)}
    df = spark.createDataFrame([(k, str(i)) for k, s in baskets.items() for i in s], "k int, i string")
    got = {r["items"]: r.n for r in relational.itemsets(df, "k", "i", (2, 3, 4), 0.1).collect()}
    want = Counter("|".join(c) for s in baskets.values() for n in (2, 3, 4) for c in combinations(sorted(s), n))
    assert got == {k: n for k, n in want.items() if n >= 6}


def test_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 6))
    df = spark.createDataFrame([(i % 3, i, [float(v) for v in x[i]]) for i in range(30)] + [(9, 99, [0.0] * 6)], "g int, k int, v array<double>")
    got = {r.g: r.similarity for r in vectors.mean_pairwise(df, ["g"], "v", 6).collect()}
    for g in range(3):
        u = x[[i for i in range(30) if i % 3 == g]]
        u = u / np.linalg.norm(u, axis=1, keepdims=True)
        s = u @ u.T
        assert got[g] == pytest.approx(s[np.triu_indices(10, 1)].mean())
    assert got[9] == 0
    assert df.select(cosine(F.col("v"), F.array(*[F.lit(0.0)] * 6))).first()[0] == 0
    dup = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [0.999, 0.01]), ("a", 3, [0.0, 1.0]), ("b", 4, [1.0, 0.0])], "g string, k long, v array<double>")
    assert {r.k: (r.kept, r.duplicate_of) for r in vectors.near_duplicates(dup, "g", "k", "v").collect()} == {1: (True, None), 2: (False, 1), 3: (True, None), 4: (True, None)}
    n = vectors.novelty(df, "g", ["k"], "v").where("g = 0").first()
    assert n.n == 10 and n.last_novelty is not None


def test_hierarchical_clustering_against_brute_force():
    rng = np.random.default_rng(3)
    for method, join in (("average", np.mean), ("complete", np.max), ("single", np.min)):
        p = rng.normal(size=(12, 3))
        d = np.linalg.norm(p[:, None] - p[None, :], axis=2)
        groups, heights = [[i] for i in range(12)], []
        while len(groups) > 1:
            h, i, j = min((join(d[np.ix_(a, b)]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
            heights.append(h)
            groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
        m = cluster.linkage(d, method)
        assert [x[2] for x in m] == pytest.approx(heights)
        assert len(set(cluster.cut(m, 12, k=4))) == 4 and len(set(cluster.cut(m, 12, height=heights[-1] + 1))) == 1
    two = np.concatenate([rng.normal(0, 0.1, (6, 2)), rng.normal(5, 0.1, (6, 2))])
    d = np.linalg.norm(two[:, None] - two[None, :], axis=2)
    label, s = cluster.best_cut(d)
    assert label.tolist() == [0] * 6 + [1] * 6 and s > 0.9
    assert cluster.cluster_or_single(np.zeros((4, 4))).tolist() == [0] * 4
    fine = cluster.refine(d, np.zeros(12, int))
    assert not set(fine[:6]) & set(fine[6:])


def test_events_gather_what_belongs_together(spark):
    rng = np.random.default_rng(4)
    centres = np.random.default_rng(12345).normal(size=(3, 16))
    rows = []
    for c in range(3):
        for i in range(10):
            v = centres[c] + rng.normal(0, 0.05, 16)
            rows.append((c * 100 + i, "storm", day(40 * c + i % 7), float(rng.uniform(0.5, 0.8)), [float(x) for x in v]))
    df = spark.createDataFrame(rows, "key long, kind string, day date, w double, v array<double>").withColumn("all", F.col("w"))
    s = events.seeds(df, "kind", "w", "all", percentile=0.0)
    m = events.cluster_seeds(s, "kind", "key", "day", "v")
    groups = {r.key: r.occurrence for r in m.collect()}
    assert len(groups) == 30 and all(len({groups[c * 100 + i] for i in range(10)}) == 1 for c in range(3)) and len(set(groups.values())) == 3
    o = events.occurrences(m, df, "kind", "key", "day", "w")
    for r in o.collect():
        assert r.seeds == 10 and r.first_day <= r.core_start <= r.peak <= r.core_end <= r.last_day and 0 <= r.confidence <= 1
    c = vectors.centroids(m.join(df.select("key", "v"), "key"), ["occurrence"], "v", 16).drop("n").join(o.select("occurrence", "kind", "peak"), "occurrence")
    b = events.soft_assign(df, c, "kind", "key", "day", "v", "w").collect()
    best = {}
    for r in b:
        best[r.key] = max(best.get(r.key, (0, "")), (r.belonging, r.occurrence))
    assert all(best[k][1] == g for k, g in groups.items())
    wide = {(r.key, r.occurrence): r.belonging for r in events.soft_assign(df, c, "kind", "key", "day", "v", "w", most=0).collect()}
    for r in b:
        assert wide[r.key, r.occurrence] == pytest.approx(r.belonging)
    assert len({r.cluster for r in events.group_occurrences(o, m, c, "key").collect()}) >= 1
    burst = spark.createDataFrame([("b0", day(0), day(6)), ("b1", day(200), day(220))], "burst_id string, onset date, end date")
    assert {r.burst_id for r in events.attribute(o, spark.createDataFrame(b), burst, df, "key", "day").collect()} == {"b0"}
    twice = m.unionByName(m.withColumn("occurrence", F.concat("occurrence", F.lit("x"))))
    o2 = o.select("occurrence", "mass").union(o.select(F.concat("occurrence", F.lit("x")), F.col("mass") / 2))
    assert {r.occurrence for r in events.deduplicate(twice, o2, "key").collect()} == set(groups.values())


def test_dominance_and_shifts(spark):
    rng = np.random.default_rng(5)
    names = list("abcdefgh")

    def weeks(top, n, start):
        return [(g, DAY0 + dt.timedelta(days=4 + 7 * (start + k)), float((0.35 if g == top else 0.05) + rng.normal(0, 0.02 if g == top else 0.01))) for k in range(n) for g in names]

    s = dominance.scores(np.array([[0.35 if g == "a" else 0.05 for g in names]] * 12) + rng.normal(0, 0.01, (12, 8)))
    assert s.min() >= 0 and s.max() <= 1
    df = spark.createDataFrame(weeks("a", 20, 0) + weeks("d", 20, 20), "g string, w date, p double")
    st = paradigm.states(df, "g", "w", "p", names, step_days=7)
    rows = st.orderBy("window_end").collect()
    assert "a" in rows[0].dominant and "d" in rows[-1].dominant and all(0 < r.concentration <= 1 for r in rows)
    sh = paradigm.shifts(st)
    got = sh.collect()
    assert got and all(r.magnitude > 0 and r.shift_type in ("full_replacement", "recomposition", "frame_entry", "frame_exit") for r in got)
    assert [r.shift_id for r in paradigm.shifts(st).orderBy("shift_date").collect()] == [r.shift_id for r in sh.orderBy("shift_date").collect()]
    merged = paradigm.merge_shifts(sh)
    assert 0 < merged.count() <= len(got) and paradigm.episodes(merged).count() <= merged.count()
    assert paradigm.qualify(merged, F.lit(day(400))).where("regime_days < 0").count() == 0


def test_drivers_are_recovered(spark):
    rng = np.random.default_rng(6)
    n = 160
    x = {e: np.maximum(0, rng.normal(1, 1, n)) for e in ("push", "drag", "n1", "n2")}
    y = 1.2 * x["push"] - 1.0 * x["drag"] + rng.normal(0, 0.4, n)
    t = spark.createDataFrame([("m", day(i), float(y[i])) for i in range(n)], "m string, d date, v double")
    m = spark.createDataFrame([("m", day(i), e, float(x[e][i])) for e in x for i in range(n)], "m string, d date, e string, mass double")
    roles = {r.entity: r.role for r in impact.select_drivers(t, m, "m", "d", "v", "e", lags=1, samples=30, bootstraps=200).collect()}
    assert roles["push"] == "driver" and roles["drag"] == "suppressor"
    assert impact.validate(t, "m", "d", "v").count() == 4


def test_prevalence_and_surge(spark):
    rows = [("g", day(i), 100 <= i < 110 and i % 5 != 0) for i in range(200) for _ in range(5 if 93 <= i < 110 else 2)]
    df = spark.createDataFrame(rows, "g string, d date, hit boolean")
    w = spark.createDataFrame([("b", "g", day(100), day(109))], "burst_id string, g string, onset date, end date")
    r = impact.prevalence(df, w, "g", "d", {"hit": F.col("hit")}).first()
    assert (r.a, r.b, r.c) == (40, 10, 0) and r.odds > 100 and r.q < 1e-6
    assert impact.surge(df, w, "g", "d").first().surge == pytest.approx(2.5)


def test_names_are_resolved(spark):
    assert resolve.person_similarity("John Smith", "J. Smith") >= 0.75 > resolve.person_similarity("John Smith", "Mary Smith")
    assert resolve.organisation_similarity("Acme Corp", "Acme Inc") >= 0.75 and resolve.location_similarity("Montreal", "Montréal") > 0.75
    rows = [("PER", "John Smith", 9), ("PER", "J. Smith", 2), ("PER", "Mary Smith", 5), ("ORG", "Acme Corp", 3), ("ORG", "Acme Inc", 4), ("LOC", "Paris", 1)]
    got = {(r.type, r.name): r.canonical for r in resolve.resolve(spark.createDataFrame(rows, "type string, name string, n long")).collect()}
    assert got == {("PER", "John Smith"): "John Smith", ("PER", "J. Smith"): "John Smith", ("PER", "Mary Smith"): "Mary Smith", ("ORG", "Acme Corp"): "Acme Inc", ("ORG", "Acme Inc"): "Acme Inc", ("LOC", "Paris"): "Paris"}


def test_new_entrants(spark):
    rows = spark.createDataFrame([("x", day(0)), ("x", day(100)), ("y", day(95)), ("y", day(101)), ("z", day(100))], "a string, d date")
    w = spark.createDataFrame([("w", day(100), day(101))], "id string, s date, e date")
    assert tuple(relational.new_entrants(rows, w, "id", "a", "d", "s", "e").first()) == ("w", 3, 2)


def test_events_are_split_absorbed_and_shattered(spark):
    up, down = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    members = spark.createDataFrame([(o, "storm" if o != "d" else "flood", k) for o, ks in {"a": [1, 2, 3, 4], "b": [3, 4, 5], "c": [8, 9], "d": [1, 2, 3]}.items() for k in ks], "occurrence string, kind string, key long")
    occ = spark.createDataFrame([(o, "storm" if o != "d" else "flood", day(d), day(d), day(d + 1), 1.0, 0.5, 0.6) for o, d in (("a", 0), ("b", 3), ("c", 90), ("d", 1))], "occurrence string, kind string, peak date, core_start date, core_end date, mass double, intensity double, confidence double")
    centres = spark.createDataFrame([("a", up), ("b", up), ("c", down), ("d", up)], "occurrence string, centroid array<double>")
    one = spark.createDataFrame([(o, 0) for o in "abcd"], "occurrence string, cluster int")
    parts = {r.occurrence: r.cluster for r in events.split_disconnected(one, occ, members, centres, "key").collect()}
    assert parts["a"] == parts["b"] == parts["d"] != parts["c"]
    own = spark.createDataFrame([(o, o) for o in "abcd"], "occurrence string, cluster string")
    into = {r.occurrence: r.cluster for r in events.absorb(own, members, "key").collect()}
    assert into == {"a": "a", "b": "b", "c": "c", "d": "a"}
    roles = {r.kind: r.role for r in events.type_structure(one, occ, members, "key").collect()}
    assert roles == {"storm": "constitutive", "flood": "constitutive"}
    rows = spark.createDataFrame([(k, [float(x) for x in (up if k < 6 else down)]) for k in range(1, 10)], "key long, v array<double>")
    shards = {r.key: r.part for r in events.coherence_gate(one, members, rows, "key", "v").collect()}
    assert len({shards[k] for k in (1, 2, 3, 4, 5)}) == 1 and shards[8] == shards[9] != shards[1]
    belong = members.select("key", "occurrence").withColumn("belonging", F.lit(0.5))
    s = events.summarise(one, occ, belong, rows, "key", 5).first()
    assert s.occurrences == 4 and s.rows == 7 and 0 < s.strength < 1


def test_far_rows_belong_whatever_the_number_of_centres(spark):
    rows = spark.createDataFrame([("storm", k, day(at), [1.0, 0.0], 0.9) for k, at in enumerate((0, 61, 500))], "kind string, key long, day date, v array<double>, w double")
    centres = spark.createDataFrame([(o, "storm", day(0), [0.9, float(np.sqrt(0.19))]) for o in ("a", "b")], "occurrence string, kind string, peak date, centroid array<double>")
    near, blocks = [{(r.key, r.occurrence): round(r.belonging, 9) for r in events.soft_assign(rows, centres, "kind", "key", "day", "v", "w", most=most).collect()} for most in (50_000, 1)]
    assert len(near) == 6 and blocks == near


def test_unfinished_iterations_raise(spark):
    from tidemark.operators import graph

    path = spark.createDataFrame([(i, i + 1) for i in range(30)], "src long, dst long")
    assert {r.core for r in graph.core_numbers(path).collect()} == {1}
    for f in (lambda: graph.core_numbers(path, rounds=3), lambda: graph.components(path, rounds=1)):
        with pytest.raises(RuntimeError):
            f()
    own = spark.createDataFrame([(o, o) for o in "abc"], "occurrence string, cluster string")
    members = spark.createDataFrame([(o, "storm", k) for o, n in (("a", 9), ("b", 7), ("c", 5)) for k in range(n)], "occurrence string, kind string, key long")
    with pytest.raises(RuntimeError):
        events.absorb(own, members, "key", rounds=1)


def test_registered_states_slide_by_a_day_and_drop_no_group(spark, tmp_path):
    from tidemark.plans import analysis_queries
    from tidemark.plans.tables import vocabulary

    rows = [(k, dt.datetime(2020, 1, 1) + dt.timedelta(days=k // 4), f"p{k % 3}", k % 7, "O", 1.0) for k in range(440)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate timestamp, o_orderpriority string, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    ends = sorted(r.window_end for r in analysis_queries.dominance_states(spark, str(tmp_path)).collect())
    assert len(ends) > 7 and {b - a for a, b in zip(ends, ends[1:])} == {dt.timedelta(days=1)}
    assert len(vocabulary(spark.range(150), "id")) == 150
    with pytest.raises(ValueError):
        vocabulary(spark.range(150), "id", most=100)


def test_clashing_names_are_not_joined(spark):
    """A surname alone joins either of two first names, but not both together."""
    rows = [("PER", "John Smith", 9), ("PER", "J. Smith", 3), ("PER", "Jane Smith", 5), ("PER", "Jon Smithe", 1), ("ORG", "acme inc", 2), ("ORG", "Acme", 4)]
    got = {(r.type, r["name"]): r.canonical for r in resolve.resolve(spark.createDataFrame(rows, "type string, name string, n long")).collect()}
    assert got["PER", "John Smith"] == "John Smith" and got["PER", "Jane Smith"] == "Jane Smith"
    assert got["PER", "J. Smith"] in ("John Smith", "Jane Smith") and got["ORG", "acme inc"] == got["ORG", "Acme"] == "Acme"
