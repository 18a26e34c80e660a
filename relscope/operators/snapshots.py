"""Snapshots of a catalog, stored so that two of them are compared without a shuffle.

A snapshot is a table of one row an object, bucketed and sorted by id, with the object's columns and foreign keys nested. Two
snapshots with the same number of buckets meet bucket by bucket in one full outer join; all changes of an object follow from
its two rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relscope.functions import scalars as S
from relscope.operators.lineage import shared_dir
from relscope.operators.relational import BREAKING, DEGRADING, SAFE

COLUMN = "struct<name:string,data_type:string,nullable:boolean>"
#: Buckets of a snapshot; two snapshots that are to be compared must have as many.
BUCKETS = 64


def nested(objects: DataFrame, columns: DataFrame, fks: DataFrame) -> DataFrame:
    """(id, kind, columns, fks): objects (id, kind), columns (id, column, data_type, nullable), fks (from_id, to_id, columns).

    A column whose name another of the object has without case counts once, the first by name. Keys of ids that are no
    objects have a row with a null kind.
    """
    own = columns.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("column").alias("name"), "data_type", "nullable"))).alias("columns"))
    keys = fks.groupBy(F.col("from_id").alias("id")).agg(F.array_sort(F.collect_set(S.fk_key(F.col("from_id"), F.col("to_id"), F.col("columns")))).alias("fks"))
    both = objects.select("id", "kind").join(own, "id", "left").join(keys, "id", "full_outer")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return both.select("id", "kind", F.coalesce("columns", none(COLUMN)).alias("columns"), F.coalesce("fks", none("string")).alias("fks"))


def write(rows: DataFrame, name: str | None = None, buckets: int = BUCKETS, path: str | None = None) -> str:
    """Store a snapshot (as `nested` makes it) as a table of the session's catalog; returns its name."""
    spark = rows.sparkSession
    name = name or f"relscope_snapshot_{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets, "id")  # one file a bucket
    dealt.write.format("parquet").mode("overwrite").bucketBy(buckets, "id").sortBy("id").option("path", path or f"{shared_dir(spark)}/relscope-{name}").saveAsTable(name)
    return name


def _change(kind: str, target: Column, risk: Column | int, detail: Column | str) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(kind).alias("kind"), target.alias("target"), as_column(risk).cast("int").alias("risk"), as_column(detail).alias("detail"))


def _first_by_name(columns: Column) -> Column:
    """columns with their lower-case name as key, each key once."""
    keyed = F.transform(columns, lambda c: F.struct(F.lower(c["name"]).alias("key"), c.alias("c")))
    return F.filter(keyed, lambda x, i: (i == 0) | ~F.exists(F.slice(keyed, F.lit(1), F.greatest(i, F.lit(1))), lambda y: y["key"] == x["key"]))


def drift(spark: SparkSession, old: str, new: str) -> DataFrame:
    """(kind, target, risk, detail) of two stored snapshots, as `relational.diff` tells it, in one join without a shuffle."""
    return changes(spark.table(old), spark.table(new))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    side = lambda d, p: d.select("id", *[F.col(c).alias(f"{p}_{c}") for c in ("kind", "columns", "fks")])
    both = side(old, "old").hint("merge").join(side(new, "new").hint("merge"), "id", "full_outer")
    had, has = F.col("old_kind").isNotNull(), F.col("new_kind").isNotNull()
    a, b = _first_by_name(F.col("old_columns")), _first_by_name(F.col("new_columns"))
    none = F.array().cast("array<struct<kind:string,target:string,risk:int,detail:string>>")
    when = lambda test, change: F.when(test, F.array(change)).otherwise(none)
    lacks = lambda columns, x: ~F.exists(columns, lambda y: y["key"] == x["key"])
    target = lambda c: F.concat("id", F.lit("."), c["name"])
    gone = F.transform(F.filter(F.col("a"), lambda x: lacks(F.col("b"), x)), lambda x: _change("column-dropped", target(x["c"]), BREAKING, "column removed"))
    fresh = F.transform(F.filter(F.col("b"), lambda x: lacks(F.col("a"), x)), lambda x: _change("column-added", target(x["c"]), F.when(x["c"]["nullable"], SAFE).otherwise(BREAKING), F.when(x["c"]["nullable"], "nullable column added").otherwise("NOT NULL column added")))
    pairs = F.flatten(F.transform(F.col("a"), lambda x: F.transform(F.filter(F.col("b"), lambda y: y["key"] == x["key"]), lambda y: F.struct(x["c"].alias("o"), y["c"].alias("n"), S.compare_types(x["c"]["data_type"], y["c"]["data_type"]).alias("cmp")))))
    text = lambda p: F.concat(p["o"]["data_type"], F.lit(" to "), p["n"]["data_type"])
    kept = F.flatten(F.transform(pairs, lambda p: F.concat(
        when(p["cmp"].isin("Narrowing", "Incompatible"), _change("column-type-narrowed", target(p["o"]), BREAKING, text(p))),
        when(p["cmp"] == "Compatible", _change("column-type-widened", target(p["o"]), SAFE, text(p))),
        when(p["o"]["nullable"] & ~p["n"]["nullable"], _change("column-not-null-tightened", target(p["o"]), BREAKING, "NULL to NOT NULL")),
    )))
    lost = F.transform(F.array_except(F.coalesce("old_fks", F.array().cast("array<string>")), F.coalesce("new_fks", F.array().cast("array<string>"))), lambda k: _change("fk-dropped", k, DEGRADING, "foreign key removed"))
    columns = F.when(had & has, F.concat(gone, fresh, kept)).otherwise(none)
    whole = F.concat(
        when(had & ~has, _change("object-dropped", F.col("id"), BREAKING, F.concat("old_kind", F.lit(" removed")))), when(has & ~had, _change("object-added", F.col("id"), SAFE, F.concat("new_kind", F.lit(" added")))), columns, lost,
    )
    keyed = both.withColumn("a", F.coalesce(a, F.array().cast(f"array<struct<key:string,c:{COLUMN}>>"))).withColumn("b", F.coalesce(b, F.array().cast(f"array<struct<key:string,c:{COLUMN}>>")))
    return keyed.select(F.explode(whole).alias("x")).select("x.*")
