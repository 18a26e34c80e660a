"""Live catalogs: the catalog queries as plans over system tables, read by JDBC or from tables of the same shape."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relscope.functions import scalars as S
from relscope.operators import model as M
from relscope.sources import scripts

# Object types that count, and server errors that mean a missing permission.
TYPE_CODES = ["U", "V", "P", "FN", "IF", "TF", "TR"]
DENIED = (297, 300)
# The SQLSTATE of a missing permission, with further digits on some servers.
DENIED_STATE = "4250"

ROWS = {
    "objects": "schema string, name string, type_code string",
    "columns": "schema string, table string, column string, type_name string, max_length int, precision int, scale int, is_nullable boolean, is_identity boolean, ordinal int, collation string",
    "primary_keys": "schema string, table string, column string, key_ordinal int",
    "foreign_keys": "schema string, table string, ref_schema string, ref_table string, fk_name string, on_delete string, from_column string, to_column string, ordinal int",
    "modules": "schema string, name string, definition string",
    "proc_stats": "schema string, name string, exec_count long, total_worker_ms long, total_logical_reads long",
    "index_usage": "schema string, table string, index_name string, seeks long, scans long, lookups long, updates long",
    "missing_indexes": "schema string, table string, equality_columns string, inequality_columns string, included_columns string, impact_score double",
    "index_columns": "schema string, table string, index_name string, is_unique boolean, is_primary_key boolean, type_desc string, is_disabled boolean, column_name string, key_ordinal int, is_included boolean",
    "table_stats": "schema string, table string, row_count long, reserved_kb long",
    "backups": "backup_finish_date timestamp",
    "stats_age": "schema string, table string, stats_name string, last_updated timestamp",
    "fragmentation": "schema string, table string, index_name string, fragmentation_percent double, page_count long",
}

Tables = Callable[[str], DataFrame]


#: Table functions of the server: they need arguments, so the server is asked with a query of its own for each.
FUNCTIONS = {
    "sys.dm_db_stats_properties": "(SELECT f.object_id, f.stats_id, f.last_updated FROM sys.stats AS x CROSS APPLY sys.dm_db_stats_properties(x.object_id, x.stats_id) AS f) AS q",
    "sys.dm_db_index_physical_stats": "(SELECT object_id, index_id, avg_fragmentation_in_percent, page_count FROM sys.dm_db_index_physical_stats(DB_ID(), NULL, NULL, NULL, 'LIMITED') AS f) AS q",
}


#: Columns by whose ranges a system table is read in parallel.
RANGE_COLUMNS = {
    "sys.objects": "object_id", "sys.columns": "object_id", "sys.indexes": "object_id", "sys.index_columns": "object_id", "sys.sql_modules": "object_id", "sys.stats": "object_id", "sys.dm_db_partition_stats": "object_id",
    "sys.dm_db_index_usage_stats": "object_id", "sys.foreign_key_columns": "constraint_object_id", "sys.foreign_keys": "object_id", "sys.key_constraints": "parent_object_id",
}


def jdbc_tables(spark: SparkSession, url: str, timeout: int = 30, partitions: int = 1, names: Callable[[str], str] | None = None, **options: str) -> Tables:
    """System tables over a read-only JDBC session; the timeout is held between 1 and 600 s.

    With several partitions a table of RANGE_COLUMNS is read by as many queries, each over a range of its column between the
    bounds that the server gives; filters and column lists go to the server either way. names turns a name into the one that
    the server has; options override those of the session.
    """
    base = {"url": url, "queryTimeout": str(min(600, max(1, timeout)))}
    if url.startswith("jdbc:sqlserver:"):
        base |= {"url": url + ";applicationIntent=ReadOnly", "sessionInitStatement": "SET TRANSACTION ISOLATION LEVEL READ UNCOMMITTED"}
    base |= options
    ask = lambda: spark.read.format("jdbc").options(**base)

    def read(name: str) -> DataFrame:
        source = names(name) if names else FUNCTIONS.get(name, name)
        column = RANGE_COLUMNS.get(name)
        if partitions > 1 and column:
            bounds = ask().option("dbtable", source).load().agg(F.min(column), F.max(column)).first()  # Spark has the server aggregate
            if bounds[0] is not None and bounds[1] > bounds[0]:
                ranged = {"partitionColumn": column, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
                return ask().options(**ranged).option("dbtable", source).load()
        return ask().option("dbtable", source).load()

    return read


def _named(t: Tables) -> DataFrame:
    """(object_id, schema, name, type, is_ms_shipped) of sys.objects with its schema."""
    o, s = t("sys.objects"), t("sys.schemas").select("schema_id", F.col("name").alias("schema"))
    return o.join(s, "schema_id").select("object_id", "schema", "name", "type", "is_ms_shipped")


def _tables(t: Tables) -> DataFrame:
    return _named(t).where("trim(type) = 'U'").select("object_id", "schema", F.col("name").alias("table"))


def _columns_of(t: Tables) -> DataFrame:
    return t("sys.columns").select("object_id", "column_id", F.col("name").alias("column"))


def objects(t: Tables) -> DataFrame:
    return _named(t).where(~F.col("is_ms_shipped") & F.trim("type").isin(TYPE_CODES)).select("schema", "name", F.trim("type").alias("type_code"))


def columns(t: Tables) -> DataFrame:
    types = t("sys.types").select("user_type_id", F.col("name").alias("type_name"))
    c = t("sys.columns").withColumnRenamed("name", "column").join(types, "user_type_id").join(_tables(t), "object_id")
    return c.select("schema", "table", "column", "type_name", "max_length", "precision", "scale", "is_nullable", "is_identity", F.col("column_id").alias("ordinal"), F.coalesce("collation_name", F.lit("")).alias("collation")).orderBy("schema", "table", "ordinal")


def index_columns(t: Tables) -> DataFrame:
    i = t("sys.indexes").where("name is not null").withColumnRenamed("name", "index_name")
    rows = i.join(t("sys.index_columns"), ["object_id", "index_id"]).join(_columns_of(t), ["object_id", "column_id"]).join(_tables(t), "object_id")
    return rows.select("schema", "table", "index_name", "is_unique", "is_primary_key", "type_desc", "is_disabled", F.col("column").alias("column_name"), "key_ordinal", F.col("is_included_column").alias("is_included")).orderBy("schema", "table", "index_name", "key_ordinal")


def table_stats(t: Tables) -> DataFrame:
    p = t("sys.dm_db_partition_stats").join(_tables(t), "object_id")
    return p.groupBy("schema", "table").agg(F.sum(F.when(F.col("index_id").isin(0, 1), F.col("row_count")).otherwise(0)).alias("row_count"), (F.sum("reserved_page_count") * 8).alias("reserved_kb"))


def primary_keys(t: Tables) -> DataFrame:
    k = t("sys.key_constraints").where("trim(type) = 'PK'").select(F.col("parent_object_id").alias("object_id"), F.col("unique_index_id").alias("index_id"))
    rows = k.join(t("sys.index_columns"), ["object_id", "index_id"]).join(_columns_of(t), ["object_id", "column_id"]).join(_tables(t), "object_id")
    return rows.select("schema", "table", "column", "key_ordinal").orderBy("schema", "table", "key_ordinal")


def foreign_keys(t: Tables) -> DataFrame:
    side = lambda p: (_tables(t).toDF(f"{p}_object_id", f"{p}_schema", f"{p}_table"), _columns_of(t).toDF(f"{p}_object_id", f"{p}_column_id", f"{p}_column"))
    (pt, pc), (rt, rc) = side("parent"), side("referenced")
    k = t("sys.foreign_keys").select(F.col("object_id").alias("constraint_object_id"), F.col("name").alias("fk_name"), F.col("delete_referential_action_desc").alias("on_delete"))
    c = t("sys.foreign_key_columns").select("constraint_object_id", "constraint_column_id", "parent_object_id", "parent_column_id", "referenced_object_id", "referenced_column_id")
    rows = k.join(c, "constraint_object_id").join(pt, "parent_object_id").join(pc, ["parent_object_id", "parent_column_id"]).join(rt, "referenced_object_id").join(rc, ["referenced_object_id", "referenced_column_id"])
    return rows.select(F.col("parent_schema").alias("schema"), F.col("parent_table").alias("table"), F.col("referenced_schema").alias("ref_schema"), F.col("referenced_table").alias("ref_table"), "fk_name", "on_delete", F.col("parent_column").alias("from_column"), F.col("referenced_column").alias("to_column"), F.col("constraint_column_id").alias("ordinal"))


def modules(t: Tables) -> DataFrame:
    return t("sys.sql_modules").join(_named(t).where(~F.col("is_ms_shipped")), "object_id").where("definition is not null").select("schema", "name", "definition")


def proc_stats(t: Tables, database_id: int) -> DataFrame:
    p = t("sys.dm_exec_procedure_stats").where(F.col("database_id") == database_id).join(_named(t), "object_id")
    return p.select("schema", "name", F.col("execution_count").alias("exec_count"), F.expr("total_worker_time div 1000").alias("total_worker_ms"), "total_logical_reads")


def index_usage(t: Tables, database_id: int) -> DataFrame:
    i = t("sys.indexes").where("name is not null").select("object_id", "index_id", F.col("name").alias("index_name")).join(_tables(t), "object_id")
    u = t("sys.dm_db_index_usage_stats").where(F.col("database_id") == database_id).select("object_id", "index_id", "user_seeks", "user_scans", "user_lookups", "user_updates")
    zero = lambda a, b: F.coalesce(a, F.lit(0)).cast("long").alias(b)
    return i.join(u, ["object_id", "index_id"], "left").select("schema", "table", "index_name", zero("user_seeks", "seeks"), zero("user_scans", "scans"), zero("user_lookups", "lookups"), zero("user_updates", "updates"))


def backups(t: Tables, database: str) -> DataFrame:
    return t("msdb.dbo.backupset").where(F.col("database_name") == database).select("backup_finish_date").orderBy(F.desc("backup_finish_date"))


def stats_age(t: Tables) -> DataFrame:
    s = t("sys.stats").select("object_id", "stats_id", F.col("name").alias("stats_name")).join(_tables(t), "object_id")
    return s.join(t("sys.dm_db_stats_properties"), ["object_id", "stats_id"]).where("last_updated is not null").select("schema", "table", "stats_name", "last_updated")


def fragmentation(t: Tables) -> DataFrame:
    f = t("sys.dm_db_index_physical_stats").where("index_id > 0 and page_count > 100")
    i = t("sys.indexes").select("object_id", "index_id", F.col("name").alias("index_name"))
    return f.join(i, ["object_id", "index_id"]).join(_tables(t), "object_id").select("schema", "table", "index_name", F.col("avg_fragmentation_in_percent").alias("fragmentation_percent"), "page_count")


def missing_indexes(t: Tables, database_id: int) -> DataFrame:
    d = t("sys.dm_db_missing_index_details").where(F.col("database_id") == database_id)
    pairs = t("sys.dm_db_missing_index_groups").select("index_handle", F.col("index_group_handle").alias("group_handle"))
    g = d.join(pairs, "index_handle").join(t("sys.dm_db_missing_index_group_stats"), "group_handle").join(_tables(t), "object_id")
    score = F.col("avg_total_user_cost") * F.col("avg_user_impact") / 100 * (F.col("user_seeks") + F.col("user_scans"))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return g.select("schema", "table", text("equality_columns"), text("inequality_columns"), text("included_columns"), score.alias("impact_score"))


def _causes(error: Exception):
    cause = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    for _ in range(20):
        if cause is None:
            return
        yield cause
        cause = cause.getCause()


def error_codes(error: Exception) -> set[int]:
    """The server's error numbers of a failed read: those that the JVM's exceptions carry, or that their text names."""
    found: set[int] = set()
    for cause in _causes(error):
        try:
            found.add(int(cause.getErrorCode()))
        except Exception:  # noqa: BLE001  not an SQL exception: only its cause may be one
            pass
    said = re.findall(r"error(?:\s*code)?\s*[:=]?\s*\(?(\d+)|permission (?:was )?denied \((\d+)\)", str(error), re.I)
    return found | {int(a or b) for a, b in said}


def sql_states(error: Exception) -> set[str]:
    """The SQLSTATEs of a failed read, which servers other than the first kind tell a missing permission by."""
    found: set[str] = set()
    for cause in _causes(error):
        try:
            found.add(str(cause.getSQLState()))
        except Exception:  # noqa: BLE001
            pass
    return found


def allowed(spark: SparkSession, query: Callable[[], DataFrame], schema: str) -> tuple[DataFrame, bool]:
    """The rows of a query and True, or no rows and False if the server denies them; other errors go on."""
    try:
        df = query()
        df.take(1)
        return df, True
    except (PySparkException, Py4JJavaError) as e:
        if error_codes(e) & set(DENIED) or any(x.startswith(DENIED_STATE) for x in sql_states(e)):
            return spark.createDataFrame([], schema), False
        raise


def runtime_note(counters: dict[str, DataFrame], available: bool) -> str:
    """How much a catalog's counters say, in words."""
    if not available:
        return "No runtime counters: the login may not read them."
    n = {k: counters[k].count() for k in ("object_stats", "missing_indexes")}
    unused = counters["index_stats"].where("is_unused").count()
    return f"{n['object_stats']} objects ran, {n['missing_indexes']} missing indexes are suggested, {unused} indexes are unused; counters begin anew when the server does."


def runtime(rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Counters by object id of rows proc_stats, index_usage and missing_indexes; an absent one is empty."""
    spark = next(iter(rows.values())).sparkSession
    get = lambda k: rows.get(k, spark.createDataFrame([], ROWS[k]))
    table_id = S.normalize_id(F.col("schema"), F.col("table"))
    p, u, m = get("proc_stats"), get("index_usage"), get("missing_indexes")
    unused = S.is_unused(F.col("seeks"), F.col("scans"), F.col("lookups"), F.col("updates"))
    return {
        "object_stats": p.groupBy(S.normalize_id(F.col("schema"), F.col("name")).alias("object_id")).agg(F.sum("exec_count").alias("execution_count"), F.sum("total_worker_ms").alias("total_worker_time_ms"), F.sum("total_logical_reads").alias("total_logical_reads")),
        "index_stats": u.select(table_id.alias("object_id"), "index_name", F.col("seeks").alias("user_seeks"), F.col("scans").alias("user_scans"), F.col("lookups").alias("user_lookups"), F.col("updates").alias("user_updates"), unused.alias("is_unused")),
        "missing_indexes": m.select(table_id.alias("object_id"), "equality_columns", "inequality_columns", "included_columns", "impact_score"),
    }


def maintenance(rows: dict[str, DataFrame], now: datetime) -> tuple[dict[str, DataFrame], int | None]:
    """Stale statistics and fragmented indexes (30 % and more), and whole days since the last backup or None."""
    spark = next(iter(rows.values())).sparkSession
    get = lambda k: rows.get(k, spark.createDataFrame([], ROWS[k]))
    at = F.lit(now).cast("timestamp")
    table_id = S.normalize_id(F.col("schema"), F.col("table")).alias("object_id")
    days = get("backups").agg(S.whole_days(F.max("backup_finish_date"), at).alias("d")).first()["d"]
    stale = get("stats_age").select(table_id, "stats_name", S.whole_days(F.col("last_updated"), at).cast("int").alias("days_since_update"))
    broken = get("fragmentation").where("fragmentation_percent >= 30").select(table_id, "index_name", "fragmentation_percent", "page_count")
    return {"stale_statistics": stale, "fragmented_indexes": broken}, days


def build(rows: dict[str, DataFrame], now: datetime, exclude: tuple[str, ...] = (), root_name: str = "database") -> M.Model:
    """A model of catalog rows: DDL is written from them and parsed like any script, then counters and details join."""
    spark = rows["objects"].sparkSession
    get = lambda k: rows.get(k, spark.createDataFrame([], ROWS[k]))
    m = M.build(scripts.reconstructed(rows["objects"], get("columns"), get("primary_keys"), get("foreign_keys"), get("modules")), exclude, root_name)
    upkeep, days = maintenance(rows, now)
    known = any(k in rows for k in ("proc_stats", "index_usage", "missing_indexes"))
    m = M.with_runtime(m, runtime(rows) | upkeep, known, days, bool(exclude))
    counters = {"object_stats": m.object_stats, "index_stats": m.index_stats, "missing_indexes": m.missing_indexes}
    m = replace(m, meta=m.meta | {"runtime_note": runtime_note(counters, known)})
    return M.with_catalog_detail(m, get("columns"), get("index_columns"), get("table_stats"))
