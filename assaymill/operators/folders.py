"""Folder trees: paths from parents, subtrees, moves and deletions by path prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_paths(folders: DataFrame) -> DataFrame:
    """Adds ``path`` (names from the root on) and ``depth``, level by level; folders that no root reaches are left out."""
    spark = folders.sparkSession
    folders.select("folder_id", "parent_id", "name").createOrReplaceTempView("_folder_rows")
    return spark.sql("""
        WITH RECURSIVE tree(folder_id, parent_id, name, path, depth) AS (
          SELECT folder_id, parent_id, name, name, 1 FROM _folder_rows WHERE parent_id IS NULL
          UNION ALL
          SELECT f.folder_id, f.parent_id, f.name, concat(t.path, '/', f.name), t.depth + 1
          FROM _folder_rows f JOIN tree t ON f.parent_id = t.folder_id)
        SELECT * FROM tree""")


def inside(path: Column, folder: str) -> Column:
    return (path == folder) | F.startswith(path, F.lit(folder + "/"))


def descendants(tree: DataFrame, folder: str) -> DataFrame:
    """The folder and all below it; names with wildcard signs are plain text."""
    return tree.where(inside(F.col("path"), folder))


def moved(path: Column, source: str, target: str) -> Column:
    """Path after a folder was renamed or moved; prefix siblings stay."""
    if target == source or target.startswith(source + "/"):
        raise ValueError("a folder can't move into itself or its child")
    return F.when(path == source, F.lit(target)).when(F.startswith(path, F.lit(source + "/")), F.concat(F.lit(target), F.substring(path, F.lit(len(source) + 1), F.length(path)))).otherwise(path)


def lifted(path: Column, folder: str) -> Column:
    """Path of a document after its folder was deleted: that segment goes; the root is the empty string."""
    parent = folder.rpartition("/")[0]
    rest = F.substring(path, F.lit(len(folder) + 2), F.length(path))
    below = F.concat(F.lit(parent + "/"), rest) if parent else rest
    return F.when(path == folder, F.lit(parent)).when(F.startswith(path, F.lit(folder + "/")), below).otherwise(path)


def duplicate_siblings(folders: DataFrame) -> DataFrame:
    return folders.groupBy("parent_id", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR contains(name, '/')")


def rollup(rows: DataFrame, path: str = "folder_path") -> DataFrame:
    """(prefix, n): rows in each folder or below it."""
    parts = F.split(path, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return rows.select(F.explode(prefixes).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))


def created(folders: DataFrame, path: str, first_id: int) -> DataFrame:
    """Folders with those of a path that are missing, each below the one before; the new ones are numbered from ``first_id`` on."""
    names = [p for p in path.split("/") if p]
    prefixes = ["/".join(names[: i + 1]) for i in range(len(names))]
    spark = folders.sparkSession
    known = {r.path: r.folder_id for r in with_paths(folders).where(F.col("path").isin(prefixes)).collect()} if prefixes else {}  # a row for each name of one path
    rows = []
    for i, prefix in enumerate(prefixes):
        if prefix not in known:
            known[prefix] = first_id + len(rows)
            rows.append((known[prefix], known[prefixes[i - 1]] if i else None, names[i]))
    return folders.unionByName(spark.createDataFrame(rows, folders.select("folder_id", "parent_id", "name").schema)) if rows else folders


def checked_move(tree: DataFrame, source: str, target: str) -> DataFrame:
    """(error) of a move that can't be made: an unknown folder, one that would go below itself, or a name that is taken there."""
    below = target == source or target.startswith(source + "/")
    found = tree.agg(F.count_if(F.col("path") == source).alias("known"), F.count_if((F.col("path") == target) & F.lit(target != source)).alias("taken"))
    error = F.when(F.col("known") == 0, "unknown folder").when(F.lit(below), "into itself").when(F.col("taken") > 0, "name taken")
    return found.select(error.alias("error")).where("error IS NOT NULL")


def deleted(folder: str, tree: DataFrame, documents: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(folders, documents, cases) without a folder and all below it: documents move up, cases of the subtree go."""
    path = F.coalesce("folder_path", F.lit(""))
    return tree.where(~inside(F.col("path"), folder)), documents.withColumn("folder_path", lifted(path, folder)), cases.where(~inside(path, folder))


def below(tree: DataFrame, parent: int | None = None) -> DataFrame:
    """The folders right below one, or the roots, by name."""
    return tree.where(F.col("parent_id").eqNullSafe(F.lit(parent))).orderBy("name")


def shares(cases: DataFrame, *by: str) -> DataFrame:
    """Reviewed cases in per cent: passed and rejected of all, whole numbers, 0 where there are none."""
    ok = lambda *s: F.count_if(F.col("review_status").isin(*s))
    percent = lambda c: F.coalesce(F.round(F.try_divide(c * 100.0, F.count(F.lit(1)))), F.lit(0)).cast("int")
    return cases.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), percent(ok("quality_verified", "approved")).alias("passed_pct"), percent(ok("rejected")).alias("rejected_pct"))
