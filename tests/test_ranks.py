"""Counting ranks and rank stability against plain windows and pairs."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulon.operators import scoring as K


@pytest.mark.parametrize("scores", [range(5), [7], [None, 3]])
def test_counting_ranks_equal_a_window(spark, scores):
    rng = random.Random(1)
    rows = [(s, c, rng.choice(list(scores))) for s in range(3) for c in rng.sample(range(1000), 400)]
    df = spark.createDataFrame(rows, "scenario_id long, case_id long, score long")
    w = Window.partitionBy("scenario_id").orderBy(F.coalesce("score", F.lit(-1)).desc(), "case_id")
    expected = df.withColumn("card_rank", F.row_number().over(w).cast("bigint")).collect()
    out = K.ranked_cards(df)
    assert sorted(map(str, out.select(*df.columns, "card_rank").collect())) == sorted(map(str, expected))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(scenario_id" in plan and "windowspecdefinition(scenario_id#" in plan
    assert K.ranked_cards(df.limit(0)).collect() == []


def test_rank_stability_counts_pairs(spark):
    rng = random.Random(2)
    rows = [(s, c, rng.choice([None, 1, 2, 3, 50])) for s in range(4) for c in range(60)] + [(9, 1, 5)]
    got = {r.scenario_id: r for r in K.rank_stability(spark.createDataFrame(rows, "scenario_id long, case_id long, score long"), base=2).collect()}
    score = {(s, c): -1 if v is None else v for s, c, v in rows}
    for s in range(4):
        signs = [(score[2, a] - score[2, b]) * (score[s, a] - score[s, b]) for a in range(60) for b in range(a)]
        expected = (sum(x > 0 for x in signs), sum(x < 0 for x in signs), sum(x == 0 for x in signs))
        assert (got[s].concordant, got[s].discordant, got[s].tied) == expected and got[s].kendall == expected[1] / len(signs)
    assert got[2].discordant == 0 and (got[9].n_cases, got[9].kendall) == (1, None)
