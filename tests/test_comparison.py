"""The comparison of two cohorts makes each of them once."""

from tidemark.plans.comparison import compare_cohorts


def test_cohorts_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(len(b))
            yield b

    cols = "anchor_age double, gender string, hospital_expire_flag int, los double, stroke_subtype string"
    rows = [(40.0 + i, "MF"[i % 2], i % 3 % 2, 1.0 + i % 7, ["ich", "sah"][i % 2]) for i in range(40)]
    first, second = (spark.createDataFrame(r, cols).mapInPandas(counted, cols) for r in (rows, rows[5:]))
    found = {r["metric"]: r for r in compare_cohorts(first, second).collect()}
    assert found["n_patients"]["primary"] == 40 and found["n_patients"]["external"] == 35
    assert made.value == 75
