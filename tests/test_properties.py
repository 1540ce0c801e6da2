"""Properties that hold for any input: bounds, band and score agree, order of rows does not matter."""

import random

from pyspark.sql import functions as F

from groundplan.functions import scoring, values
from groundplan.operators import ingest, relational


def random_assessments(spark, n=400, seed=4):
    rng = random.Random(seed)
    flag = lambda: rng.choice([True, False, None])
    rows = [(k, rng.choice(["RED", "AMBER", "GREEN", None]), rng.choice(["2020-01-01", "2024-02-01", "2030-01-01", None]), rng.choice(["Type 1", "Type 3", None]), *(rng.choice([None, 0, 1, 5, 40]) for _ in range(3)), *(flag() for _ in range(8))) for k in range(n)]
    schema = "k int, rag_status string, v string, fra_assessment_type string, overdue_action_count int, outstanding_action_count int, no_date_action_count int, has_smoke_detection boolean, has_fire_doors boolean, has_compartmentation boolean, has_emergency_lighting boolean, bsa_2022_applicable boolean, accountable_person_noted boolean, mandatory_occurrence_noted boolean, evacuation_strategy_changed boolean"
    return spark.createDataFrame(rows, schema).withColumn("assessment_valid_until", F.col("v").cast("date"))


def test_scores_stay_in_bounds_and_agree_with_bands(spark):
    as_of = F.lit("2024-01-01").cast("date")
    rows = random_assessments(spark).select("k", scoring.fra_score(as_of).alias("s")).collect()
    assert len(rows) == 400
    for r in rows:
        assert r.s.score is not None and 0.5 <= r.s.score <= 10
        assert r.s.band == ("GREEN" if r.s.score >= 7.5 else "AMBER" if r.s.score >= 4.5 else "RED")
        assert r.s.floor_applied == (10 + r.s.cat1 + r.s.cat2 + r.s.cat3 + r.s.cat4 + r.s.cat5 < 0.5 - 1e-9)
        assert bool(r.s.notes) or r.s.score == 10


def test_unknown_flags_never_lower_a_score(spark):
    """Replacing any false flag by null gives the same score or a higher one."""
    as_of = F.lit("2024-01-01").cast("date")
    df = random_assessments(spark)
    flags = [c for c in df.columns if c.startswith("has_")]
    unknown = df.withColumns({c: F.lit(None).cast("boolean") for c in flags})
    a = {r.k: r.s for r in df.select("k", scoring.fra_score(as_of)["score"].alias("s")).collect()}
    b = {r.k: r.s for r in unknown.select("k", scoring.fra_score(as_of)["score"].alias("s")).collect()}
    assert all(b[k] >= a[k] for k in a)


def test_ingest_does_not_depend_on_row_order(spark):
    rows = [("b", "Stock", 0, 0, ["Property Ref", "Address", "Sum Insured 2024"])] + [("b", "Stock", 0, k + 1, [f"P{k % 7}", f"{k} Road", str(1000 + k)]) for k in range(30)]
    schema = "path string, sheet string, sheet_idx int, row_idx int, cells array<string>"
    rng = random.Random(1)
    found = []
    for _ in range(3):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, schema).repartition(3)
        found.append(sorted((r.property_reference, r.address, r.sum_insured) for r in ingest.properties(df).collect()))
    assert found[0] == found[1] == found[2] == sorted((f"P{k}", f"{k} Road", 1000.0 + k) for k in range(7))


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(k, k * 2) for k in range(20)], "k int, v int")
    new = spark.createDataFrame([(k, -k) for k in range(10, 30)], "k int, v int")
    once = relational.upsert(old, new, ["k"])
    assert sorted(map(tuple, relational.upsert(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect()))


def test_back_off_is_bounded(spark):
    waits = [r.w for r in spark.range(1, 60).select(values.back_off(F.col("id")).alias("w")).collect()]
    assert waits[0] == 60 and max(waits) == 21_600 and waits == sorted(waits)
