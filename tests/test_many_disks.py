"""Placement where disks are many: sf0.001 with 130,000 disks and 24 objects."""

import os
import re

import pytest
from oracle import connect, same
from pyspark.sql import functions as F
from test_operators import best_disks, placements

from bucketscope.operators import cluster
from bucketscope.plans import catalog


@pytest.fixture(scope="module")
def many(spark, sf_dir, tmp_path_factory):
    out = tmp_path_factory.mktemp("many")
    for f in os.listdir(sf_dir):
        if f not in ("orders.parquet", "supplier.parquet"):
            os.symlink(f"{sf_dir}/{f}", out / f)
    con = connect(sf_dir)
    con.execute(f"COPY (SELECT * FROM orders ORDER BY o_totalprice DESC LIMIT 4) TO '{out}/a.parquet'")
    con.execute(f"COPY ((SELECT * FROM orders ORDER BY o_orderkey LIMIT 20) UNION ALL FROM '{out}/a.parquet') TO '{out}/orders.parquet'")
    con.execute(f"COPY (SELECT s.* REPLACE (i AS s_suppkey, i % 25 AS s_nationkey, (i * 7919 % 1099999) / 100.0 - 999 AS s_acctbal) FROM range(1, 130001) r(i), (SELECT * FROM supplier LIMIT 1) s) TO '{out}/supplier.parquet'")
    os.remove(out / "a.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["placement_w04_w06_j15_p25", "pool_selection_w05", "rebalance_plan_m18_j13_j16"])
def test_many_disks_as_sql(spark, many, name):
    same(catalog.queries()[name](spark, many), connect(many), catalog.oracle_sql()[name])


def test_pool_choice_hashes_no_disk(spark, sf_dir):
    plan = catalog.queries()["pool_selection_w05"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(re.search(r"node_id|disk_id|fault_domain", line) for line in plan.splitlines() if "sha2" in line)


def test_pool_choice_takes_sizes_at_the_edge(spark):
    disks = [(i, f"n{i % 5}", (None, " ", "f1", "f2")[i % 4], ("p1", "p2", None)[i % 3], 100 + i, 7 * i % 100 if i % 6 else None) for i in range(1, 25)]
    schema = "disk_id long, node_id string, fault_domain string, pool_id string, total_bytes long, available_bytes long"
    rows = spark.createDataFrame(disks, schema).withColumns({"disk_status": F.lit("Online"), "node_status": F.lit("Online")})
    objects = [("b", f"k{i}", f"v{i}", i) for i in range(101)]
    asked = spark.createDataFrame(objects, "bucket string, key string, version_id string, content_length long")
    known = [d for d in disks if d[3] is not None and d[5] is not None]
    pool_of = {d[0]: d[3] for d in disks}
    for copies, domains, least, percent in ((1, 0, 0, 0), (2, 2, 10, 15), (3, 4, 0, 7), (8, 1, 0, 0), (9, 0, 0, 0)):
        want = {v: x and pool_of[x[0][0]] for v, x in best_disks(objects, known, copies, domains, least, percent).items()}
        assert {r.version_id: r.pool for r in cluster.pool_choice(asked, rows, "seed", copies, domains, least, percent).collect()} == want


def test_placement_ranks_all_disks_where_likely_ones_share_a_domain(spark):
    """Some 500 disks a pool, two in a hundred outside one fault domain: the likeliest disks often don't suffice. Objects too large for all but few disks, or for any, and repeated ones are there."""
    disks = [(i, *((f"m{i % 3}", "f2") if i % 53 == 0 else (f"n{i % 40}", "f1")), f"p{i % 2}", 2000, 1000 + i) for i in range(1, 1001)]
    schema = "disk_id long, node_id string, fault_domain string, pool_id string, total_bytes long, available_bytes long"
    rows = spark.createDataFrame(disks, schema).withColumns({"disk_status": F.lit("Online"), "node_status": F.lit("Online")})
    objects = [("b", f"k{i}", f"v{i}", (0, 900, 1900, 1990, 1999, 2500)[i % 6]) for i in range(60)]
    asked = spark.createDataFrame(objects, "bucket string, key string, version_id string, content_length long")
    for copies, domains in ((1, 0), (2, 2), (3, 0), (45, 0)):
        found = cluster.placed(asked, rows, "seed", copies, domains)
        assert placements(found.collect()) == best_disks(objects, disks, copies, domains)
    twice = cluster.placed(asked.union(asked), rows, "seed", 2, 2).groupBy(*cluster.placed(asked, rows, "seed", 2, 2).columns).count()
    assert {r["count"] for r in twice.collect()} == {2}


def test_placement_drops_unlikely_disks_before_they_are_ordered(spark, sf_dir):
    plan = catalog.queries()["rebalance_plan_m18_j13_j16"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert any("Filter" in line and "sha2" in line for line in plan.splitlines())


@pytest.mark.parametrize("name", ["placement_w04_w06_j15_p25", "rebalance_plan_m18_j13_j16"])
def test_objects_are_dealt_out_before_anything_is_hashed(spark, sf_dir, name):
    lines = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    dealt = [i for i, line in enumerate(lines) if "RepartitionByExpression" in line]  # what comes below in the plan is done before
    assert len(dealt) == 1 and not any("sha2" in line for line in lines[dealt[0] :])


def test_disks_are_held_against_the_bound_by_their_whole_hash(spark, sf_dir):
    lines = catalog.queries()["placement_w04_w06_j15_p25"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert [line for line in lines if "Filter" in line and "sha2" in line and "substr" not in line]
