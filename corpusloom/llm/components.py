"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), as DataFrame joins.

Each step rewires links towards smaller nodes and never adds more links than it had; the number of rounds grows
with the logarithm of the component size. It is over when all components are stars: each node has either larger neighbours only, or a smaller
one alone. Nothing is collected but two numbers per round. A hub with very many links is
aggregated by partial minima; its links are dealt to several tasks when they meet the minimum (`salted_join`). The tables of a round are
deleted when the next one has been written; they have as many files as their rows need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._shared import drop_tables, few_tasks, salted_join, table

#: Links that one task writes.
LINKS_A_TASK = 500_000


def components(links: DataFrame, max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """From links (a, b) between comparable nodes: node, root, the smallest node of its component.

    Nodes without links are not returned. Repeated links, links in both directions and loops are allowed. rows: how many links there are, if that is known.
    """
    first = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    at = table(first if rows is None else few_tasks(first, rows), "components")
    number = at.count()
    for _ in range(max_rounds):
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # no step makes more links than there were
        least = table(few_tasks(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), 2 * number), "components-least")
        state = least.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("ends"), F.count_if((F.col("m") < F.col("a")) & (F.col("n") > 1)).alias("open")).first()
        if not state["open"]:
            drop_tables([least])
            break
        tasks = 1 + state["ends"] // 2 // LINKS_A_TASK
        # the neighbours above a: links turned around
        up = at.select(F.col("b").alias("a"), F.col("a").alias("b"))
        lower = least.select("a", F.least("a", "m").alias("m"))
        large = table(salted_join(up, lower, ["a"], "b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().coalesce(tasks), "components-large")
        low = table(large.groupBy("a").agg(F.min("b").alias("m")).coalesce(tasks), "components-low")
        met = salted_join(large, low, ["a"], "b")
        small = met.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        before, at = at, table(small.filter("a > b").distinct().coalesce(tasks), "components")
        drop_tables([before, least, large, low])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = at.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(at.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
