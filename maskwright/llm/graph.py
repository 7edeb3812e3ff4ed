"""Connected components of a link table, by hooking and pointer jumping, in the shared folder.

Defined cases. Links with a null end, and links from an id to itself, say nothing. Repeated links and both directions: as one.
No links: an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, saved


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (id, component): the smallest id reachable, for each id that occurs in links.

    Each round, every id takes the smallest label among its own and its neighbours', then the label of its label; the
    number of rounds grows with the logarithm of a component's width, not with its size. Labels are written to the shared
    folder each round. Joins on labels are plain equi-joins (no hint), so that adaptive execution can split hot keys; the
    minimum over neighbours is pre-aggregated.
    """
    real = links.filter("a <> b").select("a", "b")
    both = saved(real.union(real.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-links")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component"))
    labels = saved(labels, "cc-labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"id": "b", "component": "l"}), "b").groupBy("a").agg(F.min("l").alias("l")).withColumnRenamed("a", "id")
        hooked = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "l").alias("new"))
        # labels are ids with a label of their own: jump
        jump = labels.select(F.col("id").alias("new"), F.col("component").alias("further"))
        # what my old label's members see is mine too: the smallest label met by anyone under the same old label
        roots = hooked.groupBy("old").agg(F.min("new").alias("best"))
        stepped = hooked.join(roots, "old").select("id", "old", F.least("new", "best").alias("new")).join(jump, "new", "left")
        before, labels = labels, saved(stepped.select("id", "old", F.least("new", F.coalesce("further", "new")).alias("component")), "cc-labels")
        discard(before)
        if labels.filter("old <> component").isEmpty():
            discard(both)
            return labels.select("id", "component")
