"""Folder trees given by parent links: paths, reachability, and messages that no reachable folder holds.

Every folder looks twice as far up in each round: who knows the ancestor 2^k steps up, and the path to it, asks that
one for its own. So a tree of depth d takes log2 d rounds of one join, whatever its shape, and a cycle never ends a loop
of its own: a folder on or under one just meets no root. A depth has folders only if every smaller one has, so the first
round in which no further folder meets a root is the last. Rounds are settled in shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import shared_path

ORPHANS = "(orphaned messages)"


def _settled(df: DataFrame) -> DataFrame:
    path = shared_path(df.sparkSession, "folders")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tree(folders: DataFrame) -> DataFrame:
    """(folder_id, name, path, depth) of every folder; folders: folder_id, parent_id, name.

    A folder without a parent is a root of depth 0 whose path is its name; path and depth are null where no root is
    reached: on a cycle, under one, or under a parent that isn't there. Of rows that repeat an id the first by parent and
    name counts; a null id is no folder.
    """
    rows = folders.where("folder_id is not null").groupBy("folder_id").agg(F.min(F.struct("parent_id", "name")).alias("_f"))
    name = F.coalesce(F.col("_f.name"), F.lit(""))
    # up: the ancestor that this folder has reached so far, null once that is past a root; part: the path from below it.
    steps = _settled(rows.select("folder_id", name.alias("name"), F.col("_f.parent_id").alias("up"), name.alias("part"), F.lit(0).alias("steps")))
    rooted = steps.where("up is null").count()
    while True:
        above = steps.select(F.col("folder_id").alias("up"), F.col("up").alias("_up"), F.col("part").alias("_part"), F.col("steps").alias("_steps"), F.lit(True).alias("_there"))
        open_, done = steps.where("up is not null"), steps.where("up is null")
        # The ancestors of a folder are as many rows as folders ask for them; one that very many ask for is split by the join.
        nearer = open_.join(above, "up", "left").where("_there").select("folder_id", "name", F.col("_up").alias("up"), F.concat("_part", F.lit("/"), "part").alias("part"), (F.col("steps") + F.col("_steps") + 1).alias("steps"))
        steps = _settled(done.unionByName(nearer))
        now = steps.where("up is null").count()
        if now == rooted:
            break
        rooted = now
    found = steps.where("up is null").select("folder_id", F.col("part").alias("path"), F.col("steps").alias("depth"))
    return rows.select("folder_id", name.alias("name")).join(found, "folder_id", "left")


def orphans(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """The messages (column folder_id) that no reachable folder holds; paths: what `tree` gives."""
    return messages.join(paths.where("path is not null").select("folder_id"), "folder_id", "left_anti")


def with_orphans(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """All messages with `folder`, the path of theirs; orphans are in a folder of their own, below the root's name or at the top."""
    known = paths.where("path is not null").select("folder_id", F.col("path").alias("folder"))
    return messages.join(known, "folder_id", "left").withColumn("folder", F.coalesce("folder", F.lit(ORPHANS)))


def totals(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """(folder, messages, size) of each folder with all below it; messages: folder_id, size.

    Messages are counted by folder first; then each of the folder's ancestors gets the folder's sums.
    """
    each = with_orphans(messages, paths).groupBy("folder").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return each.select("n", "s", F.explode(above).alias("folder")).groupBy("folder").agg(F.sum("n").alias("messages"), F.sum("s").alias("size"))
