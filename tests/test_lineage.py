import random
import re

from briefmill.operators import ordered as o


def test_lineage_with_hubs_and_caps(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(70)] + [(0, i) for i in range(60, 200)] + [(None, 1), (5, 5)]
    near = {}
    for a, b in edges:
        if a is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    df = spark.createDataFrame(edges, "src int, dst int")
    seeds = spark.createDataFrame([(i,) for i in (0, 1, 5, 70, 999, 1)] + [(None,)], "id int")
    for most in (None, 50, 3):
        want = set()
        for seed in (0, 1, 5, 70, 999):
            depth, ring = {seed: 0}, [seed]
            for d in range(1, 5):
                ring = [n for x in ring for n in near.get(x, ()) if n not in depth and not depth.update({n: d})]
            want |= {(seed, n, d) for d, n in sorted((d, n) for n, d in depth.items())[:most]}
        assert {tuple(r) for r in o.lineage(df, seeds, most=most).collect()} == want
    plan = o.lineage(df, seeds)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 4


def test_hops_are_dealt_by_seed_once_and_not_broadcast(spark, tmp_path):
    spark.range(500).selectExpr("id", "id % 3 as scope", "id % 5 as revision", "id as src", "(id + 1) % 500 as dst").write.parquet(str(tmp_path / "n"))
    rows = spark.read.parquet(str(tmp_path / "n"))
    plan = o.lineage_in_scope(rows.select("src", "dst"), rows.select("id", "scope", "revision"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Broadcast") == 0 and plan.count("SortMergeJoin") == 6
    assert plan.count("REPARTITION_BY_NUM") == 4 and not re.search(r"hashpartitioning\(seed#\w+, node#\w+, \d+\)", plan)
