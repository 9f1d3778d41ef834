"""Connected components as tables: labels hook onto smaller neighbours and jump along their own labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved, spread_join


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, label: the smallest node of its component, for every node that has a link.

    Each round takes the smallest label among neighbours, then follows labels of labels; labels are partially
    aggregated before they are shuffled, so a node with very many links is no burden. Rounds grow with the
    logarithm of a component's width. A label or a node that very many rows share is dealt to several tasks.

    Edge cases: no links give no rows; repeated links, links both ways and of a node with itself count once; null
    ends aren't allowed; the smallest of equal candidates is the label, whatever the order of rows; columns other
    than a and b aren't read.
    """
    edges = saved(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    n_edges, n_labels = edges.count(), labels.count()
    while True:
        seen = spread_join(edges, labels.select(F.col("node").alias("b"), F.col("label").alias("theirs")), "b", n_rows=n_edges).groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        hooked = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "theirs").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        hooked = saved(hooked, "hooked")
        jumped = saved(spread_join(hooked, up, "label", "left", n_rows=n_labels).select("node", "old", F.least("label", F.coalesce("higher", "label")).alias("label")), "labels")
        changed = jumped.where("old <> label").limit(1).count()
        dropped(hooked)
        labels = jumped.select("node", "label")
        if not changed:
            dropped(edges)
            return labels
