"""What a task holds and what crosses an exchange as tables grow."""

import random

from pyspark.sql import functions as F

from tidemark.operators import graph, rollout, trees


def test_rows_of_a_hub_stay_dealt_out(spark):
    rows = spark.range(40_000).repartition(8).select(F.when(F.col("id") % 4 > 0, F.lit(-1)).otherwise(F.col("id")).alias("u"), F.col("id").alias("v"))
    each = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    out = graph.with_value(rows, "u", each, "m", 40_000)
    assert out.join(each.withColumnRenamed("m", "m2"), "u").where("m <> m2").count() == 0 and out.count() == 40_000
    parts = [r[1] for r in out.where("u = -1").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 30_000 and max(parts) < 10_000


def test_components_with_a_hub(spark):
    # A star of 30,000, tails on some of its leaves, and a chain besides.
    star = spark.range(1, 30_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    tails = spark.range(100_000, 100_050).select((F.col("id") - 99_990).alias("src"), F.col("id").alias("dst"))
    chain = spark.range(200_000, 200_040).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = graph.connected_components(star.union(tails).union(chain)).groupBy("component").count().collect()
    assert sorted(map(tuple, got)) == [(0, 30_051), (200_000, 41)]


def _nearest(rows):
    first, near = {}, {}
    for f, seq, node, parent, v in sorted(rows, key=lambda r: r[:2]):
        own, given = first.get((f, parent), (None, None))
        near[f, seq] = given if own is None else own
        if node is not None:
            first.setdefault((f, node), (v, near[f, seq]))
    return near


def test_ways_up_over_many_stretches(spark):
    rng = random.Random(3)
    rows = []
    for f in "fgh":
        for i in range(400):
            far = rng.choice([1, 1, 1, 3, 90, -5])
            rows.append((f, i, rng.choice([str(i), str(i), str(i), str(i - 7), None]), None if rng.random() < 0.02 else str(i - far), 2**60 + i if rng.random() < 0.1 else None))
    df = spark.createDataFrame(rows, "file string, seq int, node string, parent string, v long")
    for size in (16, 1 << 16):
        got = trees.inherit(df, {"near": F.col("v")}, spark.createDataFrame([("f", 1), ("g", 2)], "file string, h int"), size).collect()
        assert {(r.file, r.seq): r.near for r in got} == _nearest(rows) and len(got) == len(rows)
        assert all(r.h == {"f": 1, "g": 2}.get(r.file) for r in got)


def test_a_deep_tree_is_not_written_every_round(spark, monkeypatch):
    written, keep = [], trees.materialize

    def counted(df, name):
        out = keep(df, name)
        written.append(out[0].count())
        return out

    monkeypatch.setattr(trees, "materialize", counted)
    chain = spark.createDataFrame([("f", i, str(i), str(i - 1), i if i == 3 else None) for i in range(3000)], "file string, seq int, node string, parent string, v int")
    assert trees.inherit(chain, {"near": F.col("v")}).where("seq > 3 and near = 3").count() == 2996
    assert sum(written) <= 2 * 3000


def test_wide_rows_of_sessions_are_dealt_once(spark):
    # What a stretch starts with takes a few columns, but its rows with all of theirs cross one exchange for all carries.
    fields = dict(x.split(" ") for x in rollout.ROW.split(", "))
    rows = spark.range(1000).select(*[(F.col("id") if n == "seq" else F.lit("head") if n == "kind" else F.lit(None) if n in ("forked", "born") else F.col("id") % 7).cast(t).alias(n) if n != "at" else F.timestamp_seconds("id").alias(n) for n, t in fields.items()])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state = rollout.session_state(rows, 100)
        assert state.count() == 1000
        state.write.format("noop").mode("overwrite").save()
        # A window's rows come from the window below it, with no exchange of the session's rows between.
        plan = [x.strip(" :+-|") for x in state._jdf.queryExecution().executedPlan().toString().splitlines()]
        depth = [i for i, x in enumerate(plan) if "Window [" in x and "last(" in x]
        assert not any("Exchange hashpartitioning(session" in x for x in plan[depth[0] : depth[1]]), plan[depth[0] : depth[1]]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
