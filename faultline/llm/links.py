"""Connected components of links between long ids, in jobs that keep links in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); a component is its smallest id.

    Each round every id takes the smallest id beside it, then the one that took, twice;
    links are rewritten to these and fold. An id is merged with one it is linked to, so a
    round keeps components, and the smallest id of each keeps itself. Chains shrink to a
    quarter per round, so rounds grow with the logarithm of the longest. What a round
    leaves is a stored table; the driver sees its number of rows only. Links of a hub are
    folded before they are shuffled, and adaptive execution may split its join.
    """
    links = materialize(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "links",
    )
    steps: list[DataFrame] = []
    while links.count() > 0:
        both = links.union(links.select("b", "a"))
        took = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
        took = materialize(took.select("id", F.least("id", "m").alias("m")), "links-took")
        for _ in range(2):
            onward = took.select(F.col("id").alias("m"), F.col("m").alias("n"))
            took = took.join(onward, "m").select("id", F.col("n").alias("m"))
        took = materialize(took, "links-took")
        steps.append(took)
        of = took.select(F.col("id").alias("a"), F.col("m").alias("x"))
        to = took.select(F.col("id").alias("b"), F.col("m").alias("y"))
        moved = links.join(of, "a").join(to, "b").where("x <> y")
        links = materialize(
            moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links"
        )
    if not steps:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = steps[0].withColumnRenamed("m", "component")
    for step in steps[1:]:
        onward = step.select(F.col("id").alias("component"), F.col("m").alias("next"))
        found = found.join(onward, "component", "left").select(
            "id", F.coalesce("next", "component").alias("component")
        )
    return found
