"""Findings of round 3 on modifications: F22, F23."""

import random

import pytest
from pyspark.sql import functions as F

from orfspark.operators import ptm
from orfspark.plans import adapters as V


def partners(species, tol):
    pts = [(i, s, *p) for i, s, ps in species for p in ps]
    found = {}
    for i, s, pos, a, b in pts:
        for j, t, q, c, d in pts:
            if q == pos and j != i and t > s and abs(a - c) <= tol and abs(b - d) <= tol:
                found[i] = max(found.get(i, (t, j)), (t, j))
    return sorted((i, j) for i, (_, j) in found.items())


@pytest.mark.parametrize("tol", [0.02, 3.0, 0])
def test_reconcile_species_over_cells_and_among_equal_points(spark, tol):
    r = random.Random(4)
    edges = [k * 64 * 1.001 * tol for k in (-1, 0, 1, 2)]  # borders of cells
    species = []
    for i in range(150):
        near = [e + r.uniform(-2, 2) * tol for e in edges]
        points = {(r.randint(1, 3), r.choice([*near, 7.0, 7.0, 8.5]), r.choice([0.0, 0.01, 0.02, 5.0])) for _ in range(r.randint(0, 4))}
        species.append((i, float(r.randint(0, 6)), sorted(points)))
    df = spark.createDataFrame(species, "id int, score double, points array<struct<pos:int,prefix:double,suffix:double>>").repartition(3)
    found = ptm.reconcile_species(df, tol)
    assert sorted((x.id, x.partner) for x in found.collect()) == partners(species, tol)
    # points are not multiplied by a join: they shuffle once by their cell
    plan = ptm.reconcile_species(df, tol)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning(pos") == 1


def test_first_hits_are_the_rows_of_rank_1(spark, tmp_path):
    cols = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
    r = random.Random(5)
    rows = [(r.choice([1, 2, None]), r.choice([*range(60), None]), r.randint(1, 2), r.randint(1, 9), 5.0, r.random(), 0.1, 0.0, "1995-01-01", "R", "F") for _ in range(150)]
    df = spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate string, l_returnflag string, l_linestatus string")
    assert df.columns == cols
    df.withColumn("l_shipdate", F.col("l_shipdate").cast("date")).write.parquet(f"{tmp_path}/lineitem.parquet")
    key = lambda x: [str(v) for v in x]
    first = sorted((tuple(x) for x in V.first_hits(spark, str(tmp_path)).collect()), key=key)
    assert first == sorted((tuple(x) for x in V.psm(spark, str(tmp_path)).where("rank = 1").collect()), key=key) and len(first) < 150
