"""Transitive closure that is safe on circles and takes every link, however many a node has."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bytegrove.operators.skew import lookup_join, union_all
from bytegrove.scratch import Scratch


def closure(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(root, node, depth): nodes reachable from each root by one edge or more, with the fewest.

    A root is in its own closure only if a circle leads back. ``edges`` has (src, dst); a pair that comes twice is one
    edge, null ends are none, an empty table gives no rows. With ``seeds`` (root) only these are roots.

    Pairs double their reach: whoever is more than D and at most 2 D edges away has a node halfway that is D away, so a
    round joins the pairs of exactly D edges with all pairs, and the rounds are about log2 of the longest distance. Nodes
    that nothing leads on from are not joined at all, so a top that everything reaches makes no hot key. Each round
    writes its new pairs only.
    """
    sc = Scratch(edges.sparkSession, "closure")
    e = sc.save(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "edges")
    if seeds is not None:
        return _walk(sc, e, seeds)
    on = e.select("src").distinct().select(F.col("src").alias("dst"), F.lit(True).alias("on"))
    first = lookup_join(e, on, "dst", "left").select(F.col("src").alias("root"), F.col("dst").alias("node"), F.lit(1).alias("depth"), F.coalesce("on", F.lit(False)).alias("on"))
    pairs, seen = sc.counted(first, "pairs", n=F.count_if("on"))
    parts, reach = [pairs], 1
    sc.drop(e)
    while True:
        if not seen["n"]:
            return union_all(parts).select("root", "node", "depth")
        # Pairs of exactly ``reach`` edges are all in the newest part.
        ahead = parts[-1].where((F.col("depth") == reach) & F.col("on")).select("root", "node")
        known = union_all(parts)
        steps = known.select(F.col("root").alias("node"), F.col("node").alias("to"), F.col("depth").alias("more"), "on")
        step = ahead.join(steps, "node").groupBy("root", F.col("to").alias("node")).agg((F.min("more") + reach).cast("int").alias("depth"), F.first("on").alias("on"))
        reach *= 2
        new = step.join(known.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", "depth", "on")
        pairs, seen = sc.counted(new, "pairs", n=F.count_if((F.col("depth") == reach) & F.col("on")))
        parts.append(pairs)


def _walk(sc: Scratch, e: DataFrame, seeds: DataFrame) -> DataFrame:
    """From few roots by single edges: each round joins the newest pairs and keeps what was not seen."""
    start = e.join(seeds.select(F.col("root").alias("src")).distinct(), "src", "left_semi")
    parts = [sc.save(start.select(F.col("src").alias("root"), F.col("dst").alias("node"), F.lit(1).alias("depth")), "pairs")]
    while not parts[-1].isEmpty():
        step = parts[-1].select("root", F.col("node").alias("src")).join(e, "src").select("root", F.col("dst").alias("node")).distinct()
        seen = union_all(parts).select("root", "node")
        parts.append(sc.save(step.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(len(parts) + 1)), "pairs"))
    return union_all(parts)


def circles(links: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(node, cycle_name): every node on a circle of any links, with the smallest node that it reaches and is reached by.

    Links outside circles are peeled off first: a link whose end has no link on, or whose start none leads to, is on no
    circle. What is left is small unless circles are, and its closure tells who reaches whom.
    """
    sc = Scratch(links.sparkSession, "circles")
    e = sc.save(links.select(F.col(child).alias("src"), F.col(parent).alias("dst")).where("src is not null and dst is not null").distinct(), "links")
    n = e.count()
    while n:
        inner = lookup_join(e, e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        kept = sc.save(inner.join(inner.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"), "links")
        sc.drop(e)
        e, before = kept, n
        n = e.count()
        if n == before:
            break
    reach = closure(e).select("root", "node")
    back = reach.select(F.col("node").alias("root"), F.col("root").alias("node"))
    return reach.join(back, ["root", "node"], "left_semi").groupBy(F.col("root").alias("node")).agg(F.min("node").alias("low")).select("node", F.least("node", "low").alias("cycle_name"))
