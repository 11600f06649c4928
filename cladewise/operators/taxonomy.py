"""The taxonomy tree as a table: one row per node with the path root..self, so ancestry is array membership and LCA a common prefix.

The tree is bounded (a public taxonomy has a few million nodes, a trimmed one far fewer); it is never collected, and Spark broadcasts it in
joins when its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import common_prefix, lineage, lowest_common_path, mpa_lineage, rank_code

ROOT = 1
RECURSION_ROWS = 50_000_000


def with_paths(nodes: DataFrame) -> DataFrame:
    """Nodes (taxid, parent, rank, name) that hang from the root, with depth and path, rank_path, name_path (root first)."""
    spark = nodes.sparkSession
    if int(spark.conf.get("spark.sql.cteRecursionRowLimit", "1000000")) < RECURSION_ROWS:
        spark.conf.set("spark.sql.cteRecursionRowLimit", str(RECURSION_ROWS))
    rows = nodes.select(F.col("taxid").cast("long"), F.col("parent").cast("long"), "rank", "name")
    return spark.sql(
        """
        WITH RECURSIVE tree AS (
          SELECT taxid, CAST(0 AS BIGINT) AS parent, rank, name, 0 AS depth, array(taxid) AS path, array(rank) AS rank_path, array(name) AS name_path
          FROM {nodes} WHERE taxid = {root}
          UNION ALL
          SELECT n.taxid, n.parent, n.rank, n.name, t.depth + 1, concat(t.path, array(n.taxid)), concat(t.rank_path, array(n.rank)), concat(t.name_path, array(n.name))
          FROM {nodes} n JOIN tree t ON n.parent = t.taxid WHERE n.taxid <> {root}
        ) SELECT * FROM tree""",
        nodes=rows,
        root=ROOT,
    )


def marked_nodes(tree: DataFrame, taxids: DataFrame) -> DataFrame:
    """Taxids on a path from the root to a given taxid, the root always."""
    on_path = tree.join(taxids.select("taxid").distinct(), "taxid", "left_semi").select(F.explode("path").alias("taxid"))
    return on_path.unionByName(tree.filter(F.col("taxid") == ROOT).select("taxid")).distinct()


def trim(tree: DataFrame, taxids: DataFrame) -> DataFrame:
    """The tree with only the nodes that a given taxid needs."""
    return tree.join(marked_nodes(tree, taxids), "taxid", "left_semi")


def number_nodes(tree: DataFrame) -> DataFrame:
    """Adds internal_id: level by level, parents in order, children by taxid; the root is 1 (0 means unclassified).

    Level order with parents in order is the order of (depth, path). One window over the tree, which is bounded.
    """
    return tree.withColumn("internal_id", F.row_number().over(Window.orderBy("depth", "path")))


def node_table(tree: DataFrame) -> DataFrame:
    """Internal form of the tree: internal_id, external_id, parent_id, rank, name, child_ids, path (internal ids)."""
    numbered = number_nodes(tree)
    number = numbered.select(F.col("taxid").alias("of"), F.col("internal_id").alias("number"))
    steps = numbered.select("taxid", F.posexplode("path").alias("at", "of")).join(number, "of").groupBy("taxid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "number"))), lambda x: x["number"]).alias("ids"))
    children = numbered.filter(F.col("taxid") != ROOT).groupBy("parent").agg(F.array_sort(F.collect_list("internal_id")).alias("child_ids"))
    parent = number.withColumnRenamed("of", "parent").withColumnRenamed("number", "parent_id")
    out = numbered.join(steps, "taxid").join(parent, "parent", "left").join(children.withColumnRenamed("parent", "taxid"), "taxid", "left")
    empty = F.array().cast("array<int>")
    return out.select("internal_id", F.col("taxid").alias("external_id"), F.coalesce("parent_id", F.lit(0)).alias("parent_id"), "rank", "name", F.coalesce("child_ids", empty).alias("child_ids"), F.col("ids").alias("path"))


def to_internal(df: DataFrame, numbered: DataFrame, column: str = "taxid") -> DataFrame:
    """Adds internal_id of a taxid column, 0 where unknown."""
    ids = numbered.select(F.col("taxid").alias("_known"), F.col("internal_id"))
    return df.join(ids, df[column] == F.col("_known"), "left").withColumn("internal_id", F.coalesce("internal_id", F.lit(0))).drop("_known")


def is_ancestor(ancestor: Column, path: Column) -> Column:
    """Whether a taxid is on a path root..self (reflexive); false for 0 and for nodes without a path."""
    return (ancestor != 0) & F.coalesce(F.array_contains(path, ancestor), F.lit(False))


def lca(a_path: Column, b_path: Column) -> Column:
    """Lowest common ancestor of two nodes by their paths; a missing node gives the other one, none 0."""
    both = common_prefix(a_path, b_path)
    some = F.when(a_path.isNull(), b_path).when(b_path.isNull(), a_path).otherwise(both)
    return F.coalesce(F.try_element_at(some, F.lit(-1)), F.lit(0).cast("long"))


def lca_by(df: DataFrame, tree: DataFrame, *keys: str) -> DataFrame:
    """The lowest common ancestor of the taxids of each group, as taxid: a partial and a final aggregate of paths."""
    path = lowest_common_path(F.col("path"))
    found = df.join(tree.select("taxid", "path"), "taxid").groupBy(*keys).agg(path.alias("path"))
    return found.select(*keys, F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(0).cast("long")).alias("taxid"))


def described(tree: DataFrame) -> DataFrame:
    """taxid, name, rank, report code, depth and both kinds of lineage."""
    return tree.select("taxid", "name", "rank", rank_code(F.col("rank_path")).alias("rank_code"), "depth", lineage(F.col("rank_path"), F.col("name_path")).alias("lineage"), mpa_lineage(F.col("rank_path"), F.col("name_path")).alias("mpa"))


def rank_offsets(nodes: DataFrame) -> DataFrame:
    """Known ranks in order with the place of each in a pool of zero-ended strings."""
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    ranks = nodes.select("rank").distinct()
    return ranks.select("rank", F.coalesce(F.sum(F.octet_length("rank") + 1).over(before), F.lit(0)).cast("long").alias("offset"))
