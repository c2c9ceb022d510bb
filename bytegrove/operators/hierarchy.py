"""Parent-child rows to whole hierarchies by pointer doubling.

Each unresolved node keeps a pointer to an ancestor. A round joins pointers to pointers, so the distance doubles
and a tree of depth d is resolved in about log2 d rounds. A node whose pointer arrives at a node without parent is
resolved and leaves the rounds. The first round that resolves nothing proves that all nodes still left lead into a
circle; further doubling shrinks the set of pointed-to nodes to exactly the nodes on circles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bytegrove.operators.closure import circles, closure
from bytegrove.operators.skew import HOT_SHARE, lookup_join, union_all
from bytegrove.scratch import Scratch


def clean_links(links: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, parent, several) once for each node. Rows with a null end are no links.

    A child with several parents has the smallest (code points) here, and ``several`` says so.
    """
    return (
        links.select(F.col(child).alias("node"), F.col(parent).alias("parent"))
        .where(F.col("node").isNotNull() & F.col("parent").isNotNull())
        .groupBy("node")
        .agg(F.min("parent").alias("parent"), (F.min("parent") != F.max("parent")).alias("several"))
    )


def pointer_stats(pointers: DataFrame, before: int | None) -> tuple[int, int, list]:
    """Rows, distinct pointer targets, and hot targets of (node, ptr), in one job.

    Hot are targets of at least one in ``HOT_SHARE`` of ``before`` rows, which are at least as many as the rows now,
    so there are ``HOT_SHARE`` at most.
    """
    before = pointers.count() if before is None else before
    each = pointers.groupBy("ptr").agg(F.count(F.lit(1)).alias("n"))
    hot = F.collect_list(F.when(F.col("n") * HOT_SHARE >= before, F.col("ptr")))
    r = each.agg(F.sum("n"), F.count(F.lit(1)), hot).first()
    return r[0] or 0, r[1], sorted(r[2])


class Hierarchy:
    """The resolved links of one table; build it once, read its tables lazily.

    Null or missing ends, repeated rows and an empty table are fine; columns other than the two named are ignored. Where a
    node has several parents, its path (one of very many then) follows the smallest; circles and descendants are those of
    all links.
    """

    def __init__(self, links: DataFrame, child: str = "child", parent: str = "parent"):
        self.scratch = Scratch(links.sparkSession, "hierarchy")
        self.links = self.scratch.save(clean_links(links, child, parent), "links")
        self.every = links.select(F.col(child).alias("src"), F.col(parent).alias("dst"))
        self._several: bool | None = None
        self._rings: DataFrame | None = None
        self._nodes: DataFrame | None = None

    @property
    def several(self) -> bool:
        """Whether any node has several parents."""
        if self._several is None:
            self._several = not self.links.where("several").isEmpty()
        return self._several

    def cycles(self) -> DataFrame:
        """(node, cycle_name): every node on a circle, with the smallest node of its circle; of circles that share nodes,
        with the smallest of them all."""
        return circles(self.every, "src", "dst") if self.several else self.rings().select("node", "cycle_name")

    def rings(self) -> DataFrame:
        """(node, cycle_name, steps): the circles that paths lead into, with the links from the node to the smallest one."""
        if self._rings is None:
            self._rings = self._order_rings(self._double(paths=False)[1])
        return self._rings

    def _double(self, paths: bool) -> tuple[DataFrame | None, DataFrame]:
        """(resolved, left): nodes with a root, and nodes on or leading into circles, whose pointers are on circles.

        Columns are (node, ptr) and with ``paths`` seg, the names passed on the way to ptr; resolved nodes are only kept
        with ``paths``, as nothing else is known of them then.
        """
        sc = self.scratch
        state = self.links.select("node", F.col("parent").alias("ptr"), *([F.array("parent").alias("seg"), F.lit(False).alias("done")] if paths else []))
        state = sc.save(state, "pointers")
        total, image, hot = pointer_stats(state, None)
        #: What earlier rounds resolved, written once; a round reads and writes what it works on.
        done: list[DataFrame] = []
        while total:
            if paths:
                todo = state.where(~F.col("done"))
                ahead = union_all([*done, state]).select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("seg").alias("seg2"), F.col("done").alias("done2"))
                step = lookup_join(todo, ahead, "ptr", "left", hot).select(
                    "node",
                    F.coalesce("ptr2", "ptr").alias("ptr"),
                    F.when(F.col("ptr2").isNull(), F.col("seg")).otherwise(F.concat("seg", "seg2")).alias("seg"),
                    (F.col("ptr2").isNull() | F.col("done2")).alias("done"),
                )
                done.append(state.where("done"))
            else:
                # A pointer to a node that is itself resolved, or has no parent, ends at a root: the node leaves.
                ahead = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"))
                step = lookup_join(state, ahead, "ptr", "inner", hot).select("node", F.col("next").alias("ptr"))
            later = sc.save(step, "pointers")
            if not paths:
                sc.drop(state)
            state, before = later, (total, image)
            total, image, hot = pointer_stats(state.where(~F.col("done")) if paths else state, total)
            # No node left: all that remain lead into circles. No target less either: each target is on a circle,
            # as doubling then permutes the targets.
            if (total, image) == before:
                break
        if paths:
            return union_all([*done, state.where("done")]).drop("done"), state.where(~F.col("done")).drop("done")
        return None, state

    def _order_rings(self, left: DataFrame) -> DataFrame:
        sc = self.scratch
        ring = left.select(F.col("ptr").alias("node")).distinct().join(self.links, "node")
        low = F.least("node", "parent").alias("low")
        ring = sc.save(ring.select("node", F.col("parent").alias("ptr"), low, F.when(F.col("node") <= F.col("parent"), 0).otherwise(1).alias("steps"), F.lit(1).alias("span")), "ring")
        # The smallest name within reach doubles its reach until nothing changes.
        while not ring.isEmpty():
            ahead = ring.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"), F.col("low").alias("low2"), F.col("steps").alias("steps2"), F.col("span").alias("span2"))
            nearer = F.col("low2") < F.col("low")
            step = ring.join(ahead, "ptr").select(
                "node", F.col("next").alias("ptr"), F.least("low", "low2").alias("low"), F.when(nearer, F.col("span") + F.col("steps2")).otherwise(F.col("steps")).alias("steps"),
                (F.col("span") + F.col("span2")).alias("span"), nearer.alias("moved"),
            )
            later = sc.save(step, "ring")
            sc.drop(ring)
            ring = later
            if ring.where("moved").isEmpty():
                break
        return ring.select("node", F.col("low").alias("cycle_name"), "steps")

    def nodes(self) -> DataFrame:
        """(node, root, depth, path, status, cycle_name): one row per name that occurs in a link.

        ``path`` leads from the node (first) to its topmost ancestor (last); ``depth`` is its number of links.
        status is ``tree``; ``cycle`` for a node on a circle (path is the node alone, depth 0, root null); or
        ``into_cycle`` for a node above which a circle lies (the path ends at the circle's first node).
        """
        if self._nodes is not None:
            return self._nodes
        resolved, left = self._double(paths=True)
        if self._rings is None:
            self._rings = self._order_rings(left)
        cycles = self._rings.select("node", "cycle_name")
        none = F.lit(None).cast("string")
        tree = resolved.select(
            "node", F.col("ptr").alias("root"), F.size("seg").alias("depth"), F.concat(F.array("node"), "seg").alias("path"), F.lit("tree").alias("status"), none.alias("cycle_name")
        )
        # Where a path first meets a circle it is cut.
        outside = left.join(cycles, "node", "left_anti")
        passed = self.scratch.save(outside.select("node", F.posexplode("seg").alias("at", "ptr")), "passed")
        met = lookup_join(passed, cycles.withColumnRenamed("node", "ptr"), "ptr", "inner").groupBy("node").agg(F.min(F.struct("at", "cycle_name")).alias("m"))
        cut = F.slice("seg", 1, F.col("m.at") + 1)
        into = outside.join(met, "node").select(
            "node", none.alias("root"), (F.col("m.at") + 1).alias("depth"), F.concat(F.array("node"), cut).alias("path"), F.lit("into_cycle").alias("status"), "m.cycle_name"
        )
        tops = self.links.select(F.col("parent").alias("node")).distinct().join(self.links, "node", "left_anti")
        alone = F.array("node").alias("path")
        roots = tops.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), alone, F.lit("tree").alias("status"), none.alias("cycle_name"))
        on = cycles.select("node", none.alias("root"), F.lit(0).alias("depth"), alone, F.lit("cycle").alias("status"), "cycle_name")
        self._nodes = union_all([tree, into, roots, on])
        return self._nodes

    def descendants(self) -> DataFrame:
        """(node, descendant, distance): one row per pair, so that a top with billions below it is no single row.

        Nodes on a circle are no descendants of each other here; nodes that lead into it are, of its entry. Where a node has
        several parents these are the pairs of all links, with the least distance, those on circles included.
        """
        if self.several:
            return closure(self.every).select("node", F.col("root").alias("descendant"), F.col("depth").alias("distance"))
        step = self.nodes().where("depth > 0").select(F.col("node").alias("descendant"), F.posexplode("path").alias("distance", "node"))
        return step.where("distance > 0").select("node", "descendant", "distance")
