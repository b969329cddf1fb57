"""Connected components and parent chains over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import drop_path, materialize

#: A key with more than this part of a table's rows is heavy: there are as many at most.
HEAVY = 1000


def with_value(rows: DataFrame, by: str, each: DataFrame, value: str, total: int, least: int = 10_000) -> DataFrame:
    """``rows`` with ``value`` of their key, from ``each`` (by, value, n): one row a key, ``n`` of its rows.

    Rows of a heavy key stay where they are, as its value comes to them: of ``total`` rows no
    more than ``HEAVY`` keys have over ``total / HEAVY``. All others are dealt by key.
    """
    is_heavy = F.col("n") > F.greatest(F.lit(total) / HEAVY, F.lit(least))
    marked = rows.join(F.broadcast(each.where(is_heavy).select(by, F.col(value).alias("__heavy"))), by, "left")
    # Both sides read ``n``, so that they share one exchange.
    light = marked.where("__heavy is null").drop("__heavy").join(each.where(~is_heavy & (F.col("n") > 0)).select(by, value).hint("merge"), by)
    return marked.where("__heavy is not null").withColumnRenamed("__heavy", value).unionByName(light)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge table; the component is its smallest node.

    Alternates the large-star and small-star steps: each node hands its larger (then its
    smaller) neighbours to the smallest one it sees, until every edge points from a node to
    its component. Rounds grow with the logarithm of the longest chain. Each round is one
    table in the shared folder, so a lost executor costs one round at most. Null ends are
    dropped, self loops keep their node, an empty table gives an empty result.
    """
    spark = edges.sparkSession
    # Once as a table: both the nodes and the first round read it.
    e, _ = materialize(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null").distinct(), "links")
    nodes = e.select("u").union(e.select("v")).distinct().withColumnRenamed("u", "node")
    current, path = materialize(
        e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before, links = None, current.count()
    while True:
        stars = _small_star(_large_star(current, links), links)
        following, next_path = materialize(stars, "edges")
        state = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_path(spark, path)
        current, path, links = following, next_path, state[0]
        if tuple(state) == before:
            break
        before = tuple(state)
    return nodes.join(current.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def _large_star(edges: DataFrame, links: int) -> DataFrame:
    """Every edge leads on from its lower end to that end's smallest neighbour; ``edges`` (u, v) have u > v."""
    low = edges.select(F.col("v").alias("u"), F.col("u").alias("m"), F.lit(1).alias("n")).union(edges.select("u", F.col("v").alias("m"), F.lit(0).alias("n")))
    least = low.groupBy("u").agg(F.least(F.min("m"), F.col("u")).alias("m"), F.sum("n").alias("n"))
    joined = with_value(edges.select(F.col("v").alias("u"), F.col("u").alias("high")), "u", least, "m", links)
    return joined.select(F.col("high").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, links: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    joined = with_value(edges, "u", least, "m", links)
    return (
        joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def lineage(parents: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, ancestor, level) for all ancestors; a chain stops before it meets a node again.

    One join a level, each written to the shared folder, until no chain goes on. Null ends and
    rows that name themselves as parent are dropped; an empty table gives an empty result.
    """
    p, _ = materialize(parents.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("p is not null and c is not null").distinct(), "parents")
    level, _ = materialize(p.select(F.col("c").alias("node"), F.col("p").alias("ancestor"), F.array("c", "p").alias("seen")).where("c <> p"), "level")
    depth, levels = 1, []
    while not level.isEmpty():
        levels.append(level.select("node", "ancestor", F.lit(depth).alias("level")))
        # Both sides are dealt by key: a level's parents would go through the driver with every broadcast.
        following = (
            level.join(p.hint("merge"), level["ancestor"] == p["c"])
            .where(~F.array_contains("seen", F.col("p")))
            .select("node", F.col("p").alias("ancestor"), F.concat("seen", F.array("p")).alias("seen"))
        )
        level, _ = materialize(following, "level")
        depth += 1
    out = levels[0] if levels else level.select("node", "ancestor", F.lit(1).alias("level"))
    for more in levels[1:]:
        out = out.union(more)
    return out
