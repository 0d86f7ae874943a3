"""Fact table: order of its joins, and what its chosen columns ask for."""

from asphalta.plans import star
from asphalta.plans.star import Star, fact

PERSONS = "num_acc string, num_veh string, place string, grav int, catu int"
ACCIDENTS = "num_acc string, aaaammjj string, geo_key string, com string, iu_ac string, lum int, atm int, col int"


def tables(spark):
    persons = spark.createDataFrame(
        [("1", "1", "a", 2, 1), ("1", "1", "a", 2, 1), ("1", "2", "b", None, 1), ("2", None, "c", 3, 2), (None, "1", "d", 1, 1),
         ("9", "1", "e", 1, 1)], PERSONS)
    accidents = spark.createDataFrame([(k, "20240101", None, "75101", None, 1, 2, 3) for k in ("1", "2", "3")] + [
        (None, "20240102", None, "75102", None, 1, 2, 3)], ACCIDENTS)
    vehicles = spark.createDataFrame(
        [("1", "1", 7), ("2", None, 8), (None, "1", 9), ("9", "1", 5)], "num_acc string, num_veh string, catv int")
    return persons, accidents, vehicles


def test_persons_meet_vehicles_before_the_wide_rows(spark):
    joined = fact(*tables(spark), unique_vehicles=True)
    got = sorted((r.num_acc, r.id_usager, r.grav or 0, r.catv or 0) for r in joined.collect())
    assert [(a, g, c) for a, _, g, c in got] == [("1", 2, 7), ("1", 2, 7), ("1", 0, 0), ("2", 3, 0)]
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Join LeftOuter")


def test_columns_without_vehicles_do_not_read_them(spark, monkeypatch):
    persons, accidents, vehicles = tables(spark)

    class Domain:
        usagers = persons
        asked = 0

        @property
        def vehicules(self):
            self.asked += 1
            return vehicles

    monkeypatch.setattr(star, "CONTEXT", ())
    made = Star(domain := Domain())
    made.__dict__["located"] = accidents
    monkeypatch.setattr(Star, "with_context", lambda self, rows: rows)
    assert made.enriched_table(["num_acc", "grav"]).count() == 4 and domain.asked == 0
    assert made.enriched_table(["num_acc", "catv"]).where("catv = 7").count() == 2 and domain.asked == 1
    assert "catv" in made.enriched_table().columns and domain.asked == 2
