"""The whole analysis on made-up sentences with one planted surge."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import detect
from tidemark.plans.pipeline import Columns, Config, run

FRAMES = ("eco", "pol", "sci")


@pytest.fixture(scope="module")
def inputs(spark):
    rng = np.random.default_rng(3)
    rows, vecs, k = [], [], 0
    centres = rng.normal(size=(2, 8))
    for d in range(260):
        day = dt.date(2019, 6, 1) + dt.timedelta(days=d)
        surge = 180 <= d < 192
        for i in range(8 + (14 if surge else 0)):
            hot = i >= 8
            for s in (1, 2):
                eco = "1" if hot or rng.random() < 0.15 else rng.choice(["0", "x"])
                rows.append((k, s, str(day) if k % 2 else day.strftime("%m-%d-%Y"), f"Author {int(rng.integers(12))}, Reuters" if i % 3 else None, f"paper{int(rng.integers(6))}", eco, str(int(rng.random() < 0.3)), str(int(rng.random() < 0.2)), str(int(rng.random() < 0.4)), "0", "1" if hot else "0", str(int(rng.random() < 0.02))))
                vecs.append((k, s, [float(v) for v in centres[int(hot)] + rng.normal(0, 0.2, 8)]))
            k += 1
    rows += [(None, 1, "2019-07-01", "A", "paper1", "1", "1", "1", "1", "0", "0", "0"), (k, 1, "no day", "A", "paper1", "1", "1", "1", "1", "0", "0", "0")]
    names = "doc_id long, sentence_id int, date string, author string, media string, eco string, pol string, sci string, expert string, official string, storm string, vote string"
    return spark.createDataFrame(rows, names), spark.createDataFrame(vecs, "doc_id long, sentence_id int, embedding array<double>")


def test_all_tables(spark, inputs, tmp_path):
    c = Columns(frames=FRAMES, sources=("expert", "official"), events=("storm", "vote"))
    a = run(Config(c, dim=8, state_step_days=14), *inputs)
    assert a.articles.where("doc_id is null or date is null").count() == 0 and a.articles.where("author like '%Reuters%'").count() == 0
    assert {r["count"] for r in a.daily.groupBy("frame").count().collect()} == {260}
    b = a.bursts.where("frame = 'eco'").collect()
    planted = dt.date(2019, 6, 1) + dt.timedelta(days=185)
    assert any(r.onset <= planted <= r.end for r in b)
    s = a.surges.collect()
    assert all(0 <= r.total <= 1 for r in s) and {r.burst_id for r in s} == {r.burst_id for r in a.bursts.collect()}
    assert a.networks.where("nodes < 2").count() == 0
    assert sum(r.n for r in a.counts.collect()) == len(s)
    assert a.states.count() > 5 and a.shifts.count() >= 0 and a.episodes.count() <= a.shifts.count() and a.roles.count() >= 0
    storm = a.occurrences.where("kind = 'storm'").collect()
    assert storm and any(r.core_start <= planted <= r.core_end or r.seeds > 3 for r in storm)
    assert a.belonging.where("belonging <= 0 or belonging > 1").count() == 0
    assert a.attributions.count() >= 0
    a.export(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/signals")).where("year = 2019").count() > 0
    assert dict(a.to_json("states").dtypes)["dominant"] == "string"


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Config(Columns(frames=FRAMES), weights={"temporal": 0.5})
    with pytest.raises(ValueError):
        Config(Columns())
    assert detect.Settings().ratio == 1.2
