"""Weekly aggregates from stored counts against a run over all files."""

import random

import pytest
from pyspark.sql import functions as F

from asphalta.operators import traffic
from asphalta.plans.weekly_state import WeeklyState
from asphalta.sources import files

HEADER = "iu_ac;t_1h;q;k\n"


def week(draw, number, sensors=4, readings=30):
    lines = []
    for s in range(sensors):
        for h in range(readings):
            q, k = ("" if draw.random() < 0.1 * s else f"{draw.randrange(50)}", "" if draw.random() < 0.2 else f"{draw.randrange(30) / 2}")
            lines.append(f"{s};2024-01-{number:02d} {h % 24:02d}:00:00;{q};{k}\n")
    return HEADER + "".join(lines)


def reader(spark, seen):
    def read(paths):
        seen.append(sorted(p.rsplit("/", 1)[1] for p in paths))
        lines = spark.read.schema("iu_ac string, t_1h string, q double, k double").option("sep", ";").option("header", True).csv(list(paths))
        return lines.select(files.logical_name(F.col("_metadata.file_path")).alias("fichier_source"), "iu_ac", "t_1h", "q", "k")

    return read


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_new_and_changed_files_are_all_that_is_read(spark, tmp_path):
    draw, seen = random.Random(6), []
    landed = tmp_path / "landed"
    landed.mkdir()
    for i in (1, 2):
        (landed / f"w{i}.csv").write_text(week(draw, i))
    read = reader(spark, seen)
    state = WeeklyState(spark, str(tmp_path / "state"), read)
    with pytest.raises(ValueError):
        state.counts()

    def check():
        whole = reader(spark, [])([str(p) for p in sorted(landed.iterdir())])
        assert rows(state.weekly()) == rows(traffic.weekly_aggregate(whole))
        assert rows(state.statistics()) == rows(traffic.sensor_statistics(whole))

    assert len(state.update(str(landed))) == 2
    check()
    (landed / "w3.csv").write_text(week(draw, 3))
    state.update(str(landed))
    assert seen[-1] == ["w3.csv"]
    check()
    assert state.update(str(landed)) == [] and len(seen) == 2
    (landed / "w2.csv").write_text(week(draw, 2))  # another content under the same name
    state.update(str(landed))
    assert seen[-1] == ["w2.csv"]
    check()
    (landed / "w1.csv").touch()  # only its time is new
    assert state.update(str(landed)) == [] and len(seen) == 3
    check()


def test_a_failed_update_changes_nothing(spark, tmp_path):
    landed, seen = tmp_path / "landed", []
    landed.mkdir()
    (landed / "w1.csv").write_text(week(random.Random(1), 1))
    good = reader(spark, seen)
    state = WeeklyState(spark, str(tmp_path / "state"), good)
    state.update(str(landed))
    before = rows(state.weekly())
    (landed / "w2.csv").write_text(week(random.Random(2), 2))
    bad = WeeklyState(spark, str(tmp_path / "state"), lambda p: good(p).withColumn("q", F.raise_error(F.lit("stop")).cast("double")))
    with pytest.raises(Exception, match="stop"):
        bad.update(str(landed))
    assert rows(state.weekly()) == before
    assert len(state.update(str(landed))) == 1 and len(rows(state.weekly())) > len(before)
