"""Hierarchical weighted hash tree: a row descends region, rack and shard, and at each level goes to the child
whose weighted hash draw is smallest.

A child's draw depends on the row's key and the child's own name alone, so changing one weight moves rows
only between that child and its siblings; every subtree without a changed weight keeps its rows where they
were. A shard added as a region of its own therefore takes rows only into itself.

Edge cases: a null key draws as the text 'null'; a null text counts no bytes (size 1, CRC 0); repeated keys
land together and get neighbouring slots; an empty table gives an empty result. ``place`` keeps all other
columns and replaces only one of the name it adds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_count, bucket_of, md5_bits, md5_unit, running


@dataclass(frozen=True)
class Node:
    """A leaf has a shard number and a weight; an inner node weighs what its children weigh."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(regions: int, racks: int, shards: int) -> Node:
    """A full tree; shards are numbered from 0 in depth-first order, all of weight 1."""
    return Node("root", tuple(
        Node(f"g{g}", tuple(
            Node(f"g{g}r{r}", tuple(
                Node(f"s{n}", shard=n) for n in range((g * racks + r) * shards, (g * racks + r + 1) * shards)
            )) for r in range(racks)
        )) for g in range(regions)
    ))


def with_region(root: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and a rack of its own."""
    leaf = Node(f"s{shard}", shard=shard, own_weight=weight)
    return Node(root.name, (*root.children, Node(f"g+{shard}", (Node(f"g+{shard}r0", (leaf,)),))))


def place(key: Column, root: Node) -> Column:
    """The shard of a key: at each node the child with the smallest -ln(u) / weight, ties to the earlier."""
    key = F.coalesce(key.cast("string"), F.lit("null"))

    def down(node: Node) -> Column:
        if not node.children:
            return F.lit(node.shard)
        open_children = [c for c in node.children if c.weight > 0]
        if len(open_children) == 1:
            return down(open_children[0])
        # the list index breaks ties and tells which child won
        draws = [F.struct((-F.log(md5_unit(F.lit(c.name), key)) / F.lit(float(c.weight))).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(open_children)]
        won = F.least(*draws)["k"]
        # each subtree's draws are computed only for the rows that reach it
        return F.element_at(F.transform(F.array(won), lambda w: _switch(w, [down(c) for c in open_children])), 1)

    return down(root).cast("int")


def _switch(which: Column, results: list[Column]) -> Column:
    out = F.when(which == 0, results[0])
    for k, r in enumerate(results[1:], 1):
        out = out.when(which == k, r)
    return out


def with_slots(df: DataFrame, shard: str, key: str, order: list[str], rows: int) -> DataFrame:
    """Adds ``slot``: gapless from 0 within each shard, in hash order; any shard may hold most rows."""
    buckets = bucket_count(rows)
    bits = md5_bits(F.lit("slot"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    put = df.withColumn("_bits", bits).withColumn("bucket", bucket_of(F.col("_bits"), buckets)).withColumn("_one", F.lit(1).cast("long"))
    totals = put.groupBy(shard, "bucket").agg(F.sum("_one").alias("total_slot"))
    return running(put, shard, "_bits", order, buckets, totals, slot="_one").drop("_bits", "bucket", "_one")


#: 2 regions of 2 racks of 4 shards.
TREE = (2, 2, 4)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    root = tree(*TREE)
    grown = with_region(root, 16)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    put = docs.select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(F.col("doc_id"), root).alias("shard"),
        place(F.col("doc_id"), grown).alias("grown_shard"),
    )
    return with_slots(put, "shard", "doc_id", ["doc_id", "text_crc32", "size"], docs.count()).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


QUERIES = {"op1_sharding": op1_sharding}
SQL = {
    "op1_sharding": r"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
raw AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
    list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM documents),
sums AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, b),
    lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1])), 4294967295) AS text_crc32 FROM raw, crc_table),
nodes(name, parent, w, grown_w, shard) AS (
  SELECT 'g' || i, 'root', 8.0, 8.0, NULL::INTEGER FROM range(2) r(i) UNION ALL
  SELECT 'g' || i // 2 || 'r' || i % 2, 'g' || i // 2, 4.0, 4.0, NULL FROM range(4) r(i) UNION ALL
  SELECT 's' || i, 'g' || i // 8 || 'r' || i // 4 % 2, 1.0, 1.0, i::INTEGER FROM range(16) r(i) UNION ALL
  SELECT 'g+16', 'root', 0.0, 1.0, 16),
draws AS (
  SELECT doc_id, name, parent, shard, w, grown_w,
    -ln((CAST('0x' || substr(md5(name || '/' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS e
  FROM documents, nodes),
wins AS (
  SELECT doc_id, parent, arg_min(name, e / w) FILTER (WHERE w > 0) AS child, arg_min(name, e / grown_w) AS grown_child FROM draws GROUP BY doc_id, parent),
paths AS (
  SELECT a.doc_id, CAST(substr(c.child, 2) AS INTEGER) AS shard
  FROM wins a JOIN wins b ON a.doc_id = b.doc_id AND b.parent = a.child JOIN wins c ON a.doc_id = c.doc_id AND c.parent = b.child WHERE a.parent = 'root'),
grown AS (
  SELECT doc_id FROM wins WHERE parent = 'root' AND grown_child = 'g+16')
SELECT s.doc_id, size, text_crc32, 'key' AS law, p.shard,
  row_number() OVER (PARTITION BY p.shard ORDER BY substr(md5('slot/' || s.doc_id), 1, 13), s.doc_id) - 1 AS slot,
  CASE WHEN g.doc_id IS NULL THEN p.shard ELSE 16 END AS grown_shard
FROM sums s JOIN paths p USING (doc_id) LEFT JOIN grown g USING (doc_id)"""
}
