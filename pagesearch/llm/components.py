"""Connected components of a table of links, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesearch.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(u, v)`` (longs, not null); root is the same within a component.

    Each round hands every node to its smallest neighbour (or itself) and contracts the links, which at
    least halves the nodes that still have links, so the rounds grow with the logarithm of a component.
    A round's tables are written to the shared folder: plans stay short and lost executors do no harm.
    """
    spark = links.sparkSession
    links = materialize(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                        .distinct(), "links")
    found: DataFrame | None = None
    while links.head(1):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = materialize(both.groupBy("u").agg(F.min("v").alias("least"))
                              .select("u", F.least("u", "least").alias("parent")), "parents")
        if found is None:
            found = parents.select(F.col("u").alias("node"), F.col("parent").alias("root"))
        else:
            step = parents.select(F.col("u").alias("root"), "parent")
            found = materialize(found.join(step, "root", "left")
                                .select("node", F.coalesce("parent", "root").alias("root")), "roots")
        left = parents.select("u", F.col("parent").alias("pu"))
        right = parents.select(F.col("u").alias("v"), F.col("parent").alias("pv"))
        links = materialize(links.join(left, "u").join(right, "v").where("pu <> pv")
                            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(),
                            "links")
    return found if found is not None else spark.createDataFrame([], "node long, root long")
