"""Table operators: keyed merge, cascading deletes, change detection, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.schema import PARENTS


def last_writer(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with one key the one that comes last by `order`."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")


def merge(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """old with new put over it by key: columns in `keep` stay as they were in rows that exist, all others are the new ones.

    One shuffle by key on either side; new must have each key once, see last_writer().
    """
    o, n = old.alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    joined = o.withColumn("__old", F.lit(True)).alias("o").join(n, on, "full_outer")
    is_old, is_new = F.coalesce(F.col("o.__old"), F.lit(False)), F.coalesce(F.col("n.__new"), F.lit(False))
    pick = lambda c: F.when(is_old if c in keep else ~is_new, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return joined.select(*[pick(c) for c in old.columns])


def replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys of new, and new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows whose key is not among ids (one column of that name)."""
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def cascade(tables: dict[str, DataFrame], table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """tables after the rows of `table` with these ids (column id) went, and with them every row below."""
    out, gone = dict(tables), {table: ids.select("id").distinct()}
    out[table] = tables[table].join(gone[table], "id", "left_anti")
    for child in ("files", "symbols", "chunks", "embeddings", "imports"):
        for column, parent in PARENTS[child]:
            if child in out and parent in gone and parent != child:
                lost = out[child].join(gone[parent].withColumnRenamed("id", column), column, "left_semi")
                gone[child] = lost.select("id") if child not in gone else gone[child].unionByName(lost.select("id"))
                out[child] = out[child].join(gone[parent].withColumnRenamed("id", column), column, "left_anti")
    return out


def status_of(known: Column, old_hash: Column, is_there: Column, new_hash: Column, error: Column | None = None) -> Column:
    """What became of a file: failed if it could not be read, else new, deleted, unchanged or changed by the hashes of its contents."""
    failed = F.lit(False) if error is None else error.isNotNull()
    known, is_there = (F.coalesce(c, F.lit(False)) for c in (known, is_there))
    return F.when(failed, "failed").when(~known, "new").when(~is_there, "deleted").when(old_hash.eqNullSafe(new_hash), "unchanged").otherwise("changed")


def changes(old: DataFrame, new: DataFrame, key: str, content: str, error: str | None = None) -> DataFrame:
    """(key, status) of both snapshots: new, changed, unchanged or deleted, by the hash of their content; failed where new has an error."""
    o = old.select(key, F.sha2(F.col(content), 256).alias("__o"), F.lit(True).alias("__was"))
    n = new.select(key, F.sha2(F.col(content), 256).alias("__n"), F.lit(True).alias("__is"), (F.col(error) if error else F.lit(None)).alias("__error"))
    status = status_of(F.col("__was"), F.col("__o"), F.col("__is"), F.col("__n"), F.col("__error"))
    return o.join(n, key, "full_outer").select(key, status.alias("status"))


def insert(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with new appended, columns by name and in the types of old; what is there twice stands there twice."""
    return old.unionByName(new.select(*[F.col(c).cast(t).alias(c) for c, t in old.dtypes]))


def without(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """rows that have no counterpart, as chunks without an embedding."""
    return rows.join(others.select(key), key, "left_anti")


def counts_by(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """parents (key) with the number of rows each has in every child table, 0 if none.

    Each child is counted before it is joined, so joins move one row a parent.
    """
    out = parents.select(key).distinct()
    for name, child in children.items():
        out = out.join(child.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return out.select(key, *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in children])


def rows_where(table: DataFrame, **keys) -> DataFrame:
    """Point reads: rows of a table whose columns have these values, as a project by root_path or a file by content_hash."""
    for column, value in keys.items():
        table = table.where(F.col(column).eqNullSafe(F.lit(value)))
    return table


def listing(table: DataFrame, parent: str, value, order: str) -> DataFrame:
    """Rows of one parent in order: files of a project by file_path, symbols and chunks of a file by start_line, imports by import_path."""
    return rows_where(table, **{parent: value}).orderBy(order)


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new appended; a key that exists is an error."""
    if not new.join(old.select(*keys), keys, "left_semi").isEmpty():
        raise ValueError(f"a row with the same {', '.join(keys)} exists")
    return old.unionByName(new)


def delete_where_in(rows: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, int]:
    """rows without those ids, and how many went; no ids, none went."""
    gone = rows.join(ids.select(key).distinct(), key, "left_semi").count()
    return delete(rows, ids, key), gone


def health(counts: DataFrame) -> DataFrame:
    """counts (embeddings, indexed, chunks) with flags: that the store could be read, whether there are vectors, and whether the keyword index has a row for each chunk."""
    return counts.withColumns({"database_accessible": F.lit(True), "embeddings_available": F.col("embeddings") > 0, "fts_indexes_built": F.coalesce("indexed", F.lit(0)) == F.col("chunks")})
