"""Keyed permutations, partners and stored mix plans."""

import pytest
from pyspark.sql import functions as F

from pixloom.functions import permute as P
from pixloom.operators import labels as L
from pixloom.operators import mixing as M
from pixloom.sources import stored


@pytest.mark.parametrize("n", [1, 2, 3, 6, 97, 529, 530, 1000])
def test_permutations_can_be_undone(n):
    for seed in (0, 5):
        places = [P.permuted(x, n, seed) for x in range(n)]
        assert sorted(places) == list(range(n))
        assert [P.permuted(y, n, seed, back=True) for y in places] == list(range(n))


def test_spark_permutes_alike(spark):
    for n in (2, 37, 500):
        got = [r.p for r in spark.range(n).select("id", F.expr(P.permuted_column("id", n, 9)).alias("p")).orderBy("id").collect()]
        assert got == [P.permuted(x, n, 9) for x in range(n)]


def test_walks_of_a_large_grid_are_bounded():
    n = 10**9 - 7
    walk = P.longest_walk(n, 3)
    assert 1 <= walk < 50
    assert all(P.permuted(P.permuted(x, n, 3), n, 3, back=True) == x for x in range(0, n, n // 50))


def drawn(spark, n, w=4, h=4):
    return spark.range(n).selectExpr("id * 3 as image_id", f"{w} as w", f"{h} as h", f"array(transform(sequence(1, {w * h}), i -> cast((i * 7 + id * 13) % 256 as int))) as planes").withColumn("label", L.one_hot("cast(image_id % 5 as int)", 5))


def test_everyone_has_a_partner_of_its_own(spark):
    for n in (2, 3, 60, 401):
        rows = M.partners(drawn(spark, n), 5).collect()
        assert len(rows) == n and {r.partner for r in rows} == {r.image_id for r in rows}
        assert all(r.partner != r.image_id for r in rows)
        if n > 50:
            shifts = {(r.partner - r.image_id) // 3 % n for r in rows}
            assert len(shifts) > n // 3  # a single shift for all would be one
            assert {r.image_id: r.partner for r in M.partners(drawn(spark, n).repartition(5), 5).collect()} == {r.image_id: r.partner for r in rows}
            assert {r.image_id: r.partner for r in M.partners(drawn(spark, n), 6).collect()} != {r.image_id: r.partner for r in rows}
    assert [(r.partner, r.share) for r in M.partners(drawn(spark, 1), 5).collect()] == [(0, 1.0)]
    assert M.partners(drawn(spark, 0), 5).collect() == []


def test_a_stored_plan_gives_what_the_calls_give(spark, tmp_path):
    df = drawn(spark, 43, 6, 4)
    stages, path = ["mix_up", "cut_mix", "mosaic"], str(tmp_path / "plan")
    stored.write_plan(M.mix_plan(df, stages, 8), path)
    plan = stored.read_plan(spark, path)
    assert plan.columns == [x.split(" ")[0] for x in M.PLAN.split(", ")]
    assert "PartitionFilters: [isnotnull(step" in plan.where("step = 1")._jdf.queryExecution().executedPlan().toString()
    direct = M.mosaic(M.cut_mix(M.mix_up(df, 1.0, 8), 1.0, 9))
    assert sorted(M.replayed(df.repartition(3), plan).select(*direct.columns).collect()) == sorted(direct.collect())
    assert direct.count() == 10
    rects = plan.where("op = 'cut_mix'").collect()
    assert all(0 <= r.x0 <= r.x1 <= 6 and 0 <= r.y0 <= r.y1 <= 4 for r in rects) and len({(r.x0, r.y0) for r in rects}) > 5


def test_a_plan_reads_no_pixels(spark):
    df = drawn(spark, 20)
    path = M.mix_plan(df, ["cut_mix"], 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "planes" not in path and "label" not in path


def test_images_that_a_plan_does_not_name_go(spark):
    df = drawn(spark, 8)
    plan = M.mix_up_plan(df, 2).where("image_id < 12")
    assert sorted(r.image_id for r in M.replayed(df, plan).collect()) == [0, 3, 6, 9]
    assert M.replayed(df, plan.limit(0)).count() == 8  # a plan without steps changes nothing
