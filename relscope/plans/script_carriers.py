"""Registered queries over scripts and catalogs that are made of the parquet tables, each with its SQL.

Every part is a script: a table, a procedure or a view, whose text follows from the part's key and size. The scripts are
parsed, resolved and linted like any folder of scripts; the same parts fill the system tables that a live catalog reads.
The model is built once a session and folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relscope.operators import model as M
from relscope.operators import relational as R
from relscope.operators import rules, views
from relscope.plans.carriers import query, table
from relscope.sources import live

KEY, SIZE = "k", "s"

#: The parts as the SQL side sees them: key, size, kind, schema, name, id, and the table that a script is about.
PARTS_SQL = """p AS (
  SELECT p_partkey AS k, p_size AS s, p_partkey % 3 AS r, CASE WHEN p_partkey % 2 = 0 THEN 'dbo' ELSE 'app' END AS sch,
    CASE p_partkey % 3 WHEN 0 THEN 'T' || p_partkey WHEN 1 THEN 'p' || p_partkey ELSE CASE WHEN p_size % 11 = 0 THEN 'bad v' ELSE 'v' END || p_partkey END AS nm,
    CASE WHEN (p_partkey - CASE p_partkey % 3 WHEN 0 THEN 3 ELSE p_partkey % 3 END) % 2 = 0 THEN 'dbo' ELSE 'app' END || '.t' || (p_partkey - CASE p_partkey % 3 WHEN 0 THEN 3 ELSE p_partkey % 3 END) AS about
  FROM part),
o AS (SELECT *, lower(sch || '.' || nm) AS id, CASE r WHEN 0 THEN 'table' WHEN 1 THEN 'procedure' ELSE 'view' END AS kind, 'sql_k' || k || '_sql' AS slug FROM p)"""

_prev = "CASE WHEN (k - 3) % 2 = 0 THEN 'dbo' ELSE 'app' END || '.p' || (k - 3)"
#: All edges as they are parsed, before targets are resolved.
EDGES_SQL = PARTS_SQL + f""", raw AS (
  SELECT id, about AS t, 'fk' AS kind FROM o WHERE r = 0 UNION ALL SELECT id, about, 'read' FROM o WHERE r > 0 UNION ALL SELECT id, about, 'update' FROM o WHERE r = 1
  UNION ALL SELECT id, '', 'update-nowhere' FROM o WHERE r = 1 AND s % 5 = 0 UNION ALL SELECT id, about, 'delete' FROM o WHERE r = 1 AND s % 6 = 0
  UNION ALL SELECT id, '', 'exec-dynamic' FROM o WHERE r = 1 AND s % 7 = 0 UNION ALL SELECT id, 'dbo.xp_cmdshell', 'exec' FROM o WHERE r = 1 AND s % 17 = 0
  UNION ALL SELECT id, about, 'read' FROM o WHERE r = 1 AND s % 10 = 0 UNION ALL SELECT id, {_prev}, 'exec' FROM o WHERE r = 1 AND s % 2 = 1
  UNION ALL SELECT id, '', 'select-star' FROM o WHERE r > 0 AND s % 3 = 0),
d AS (SELECT raw.id AS src, coalesce(x.id, '') AS dst, CASE WHEN x.id IS NULL THEN t ELSE '' END AS ext, raw.kind FROM raw LEFT JOIN (SELECT id FROM o) x ON t = x.id)"""


def _schema(key: Column) -> Column:
    return F.when(key % 2 == 0, "dbo").otherwise("app")


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def parts(spark: SparkSession, d: str) -> DataFrame:
    """(k, s, r, sch, nm, about): one row a part, with the key of the table that its script is about."""
    k, s = F.col("p_partkey"), F.col("p_size")
    name = F.when(k % 3 == 0, _text("T", k)).when(k % 3 == 1, _text("p", k)).otherwise(_text(F.when(s % 11 == 0, "bad v").otherwise("v"), k))
    return table(spark, d, "part").select(k.alias("k"), s.alias("s"), (k % 3).alias("r"), _schema(k).alias("sch"), name.alias("nm"), (k - F.when(k % 3 == 0, 3).otherwise(k % 3)).alias("about"))


def scripts_of(spark: SparkSession, d: str) -> DataFrame:
    """(rel_path, content, dialect): the scripts of the parts."""
    k, s, about = F.col("k"), F.col("s"), F.col("about")
    own, other = _text("[", F.col("sch"), "].[", F.col("nm"), "]"), _text("[", _schema(about), "].[T", about, "]")
    when = lambda n, text, rest="": F.when(s % n == 0, text).otherwise(rest)
    made = _text(
        "CREATE TABLE ", own, " (\n  id INT ", when(3, "IDENTITY(1,1) "), "NOT NULL,\n  parent_id INT ", F.when(s % 6 < 3, "NULL").otherwise("NOT NULL"), ",\n  note ", when(7, "TEXT", "VARCHAR(50)"), " NULL",
        when(4, "", _text(",\n  CONSTRAINT PK_", k, " PRIMARY KEY (id)")), ",\n  CONSTRAINT FK_", k, " FOREIGN KEY (parent_id) REFERENCES ", other, " (id)", when(5, " ON DELETE CASCADE"), "\n)\n",
        when(2, _text("GO\nCREATE INDEX IX_", k, " ON ", own, " (parent_id)\n")), when(13, _text("GO\nCREATE LOGIN u", k, " WITH PASSWORD = 'x", k, "!'\n")),
    )
    checks = F.repeat(F.lit("  IF 1 = 1 PRINT 1;\n"), F.when(s > 40, 15).otherwise(s % 5).cast("int"))
    procedure = _text(
        "CREATE PROCEDURE ", own, " @x INT", when(9, " WITH EXECUTE AS OWNER"), " AS\nBEGIN\n", when(2, "  SET NOCOUNT ON;\n"), "  SELECT ", when(3, "*", "id"), " FROM ", other, when(4, " WITH (NOLOCK)"), " WHERE id = 1;\n",
        "  UPDATE ", other, " SET note = 'x'", when(5, "", " WHERE id = 2"), ";\n", when(6, _text("  DELETE FROM ", other, " WHERE id = 3;\n")), when(7, "  EXEC ('SELECT ' + @x);\n"), when(17, "  EXEC xp_cmdshell 'dir';\n"),
        when(10, _text("  DECLARE c CURSOR FOR SELECT id FROM ", other, ";\n")), when(8, "  PRINT @@IDENTITY;\n"), F.when(s % 2 == 1, _text("  EXEC [", _schema(k - 3), "].[p", k - 3, "];\n")).otherwise(""), checks, "END\n",
    )
    view = _text("CREATE VIEW ", own, " AS\nSELECT ", when(3, "*", "id"), " FROM ", other, " WHERE id > 0\n")
    content = F.when(F.col("r") == 0, made).when(F.col("r") == 1, procedure).otherwise(view)
    return parts(spark, d).select(_text("sql/k", k, ".sql").alias("rel_path"), content.alias("content"), F.lit("tsql").alias("dialect"))


def system(spark: SparkSession, d: str) -> live.Tables:
    """System tables of a catalog of the same objects, as a server has them."""
    p = parts(spark, d)
    k, s = F.col("k"), F.col("s")
    tables = p.where("r = 0")
    has = lambda n: (s % n == 0)
    column = lambda i, name, kind, width: F.struct(F.lit(i).alias("i"), F.lit(name).alias("name"), kind.alias("kind"), width.alias("width"))
    int_type, four = F.lit(56), F.lit(4)
    width = F.when(s % 9 == 0, -1).when(s % 9 == 1, 9000).otherwise(50)
    columns = F.array(column(1, "id", int_type, four), column(2, "parent_id", int_type, four), column(3, "note", F.when(has(7), 35).otherwise(167), F.when(has(7), 16).otherwise(width)))
    index = lambda i, name: F.struct(F.lit(i).alias("i"), name.alias("name"))
    none = F.lit(None).cast("struct<i:int,name:string>")
    indexes = F.filter(F.array(F.when(~has(4), index(1, _text("PK_", k))).otherwise(none), F.when(has(2), index(2, _text("IX_", k))).otherwise(none), F.when(has(10), index(3, _text("IY_", k))).otherwise(none)), lambda x: x.isNotNull())
    each = tables.select("k", "s", F.explode(indexes).alias("x")).select("k", "s", F.col("x.i").alias("index_id"), F.col("x.name").alias("name"))
    keyed = each.select("k", "index_id", F.explode(F.when(F.col("index_id") == 1, F.array(F.lit(1))).when(F.col("index_id") == 2, F.array(F.lit(2))).otherwise(F.array(F.lit(2), F.lit(3)))).alias("column_id"))
    fixed = lambda rows, schema: spark.createDataFrame(rows, schema)
    made: dict[str, Callable[[], DataFrame]] = {
        "sys.schemas": lambda: fixed([(0, "dbo"), (1, "app")], "schema_id int, name string"),
        "sys.objects": lambda: p.select(k.alias("object_id"), (k % 2).alias("schema_id"), F.col("nm").alias("name"), F.when(F.col("r") == 0, "U ").when(F.col("r") == 1, "P ").otherwise("V ").alias("type"), (s % 50 == 49).alias("is_ms_shipped")),
        "sys.types": lambda: fixed([(56, "int"), (35, "text"), (167, "varchar")], "user_type_id int, name string"),
        "sys.columns": lambda: tables.select("k", "s", F.explode(columns).alias("c")).select(k.alias("object_id"), F.col("c.i").alias("column_id"), F.col("c.name").alias("name"), F.col("c.kind").alias("user_type_id"), F.col("c.width").alias("max_length"), F.lit(10).alias("precision"), F.lit(0).alias("scale"), F.when(F.col("c.i") == 1, False).when(F.col("c.i") == 2, s % 6 < 3).otherwise(True).alias("is_nullable"), ((F.col("c.i") == 1) & has(3)).alias("is_identity"), F.when(F.col("c.i") == 3, "Latin1").alias("collation_name")),
        "sys.indexes": lambda: each.select(k.alias("object_id"), "index_id", "name", (F.col("index_id") == 1).alias("is_unique"), (F.col("index_id") == 1).alias("is_primary_key"), F.when(F.col("index_id") == 1, "CLUSTERED").otherwise("NONCLUSTERED").alias("type_desc"), F.lit(False).alias("is_disabled")),
        "sys.index_columns": lambda: keyed.select(k.alias("object_id"), "index_id", "column_id", F.when(F.col("index_id") == 3, F.col("column_id") - 1).otherwise(1).alias("key_ordinal"), F.lit(False).alias("is_included_column")),
        "sys.key_constraints": lambda: tables.where(~has(4)).select(k.alias("parent_object_id"), F.lit(1).alias("unique_index_id"), F.lit("PK").alias("type")),
        "sys.foreign_keys": lambda: tables.select((k + 1_000_000_000).alias("object_id"), _text("FK_", k).alias("name"), F.when(has(5), "CASCADE").otherwise("NO_ACTION").alias("delete_referential_action_desc")),
        "sys.foreign_key_columns": lambda: tables.select((k + 1_000_000_000).alias("constraint_object_id"), F.lit(1).alias("constraint_column_id"), k.alias("parent_object_id"), F.lit(2).alias("parent_column_id"), F.col("about").alias("referenced_object_id"), F.lit(1).alias("referenced_column_id")),
        "sys.sql_modules": lambda: scripts_of(spark, d).where("rel_path is not null").select(F.regexp_extract("rel_path", r"(\d+)", 1).cast("long").alias("object_id"), F.when(F.contains("content", F.lit("CREATE TABLE")), F.lit(None).cast("string")).otherwise(F.col("content")).alias("definition")),
        "sys.dm_exec_procedure_stats": lambda: p.where("r = 1 and s % 4 = 1").select((s % 2).alias("database_id"), k.alias("object_id"), (s * 10).cast("long").alias("execution_count"), (s * 1999).cast("long").alias("total_worker_time"), s.cast("long").alias("total_logical_reads")),
        "sys.dm_db_index_usage_stats": lambda: tables.where(has(2)).select(F.lit(1).alias("database_id"), k.alias("object_id"), F.lit(2).alias("index_id"), (s % 3).cast("long").alias("user_seeks"), F.lit(0).cast("long").alias("user_scans"), F.lit(0).cast("long").alias("user_lookups"), (s % 5).cast("long").alias("user_updates")),
        "sys.dm_db_partition_stats": lambda: tables.select(k.alias("object_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("index_id"), (s * 100).cast("long").alias("row_count"), s.cast("long").alias("reserved_page_count")),
        "msdb.dbo.backupset": lambda: table(spark, d, "events").select(F.col("event_type").alias("database_name"), F.col("ts").cast("timestamp").alias("backup_finish_date")),
        "sys.stats": lambda: tables.select(k.alias("object_id"), F.lit(1).alias("stats_id"), _text("ST_", k).alias("name")),
        "sys.dm_db_stats_properties": lambda: tables.select(k.alias("object_id"), F.lit(1).alias("stats_id"), F.when(~has(7), F.date_add(F.lit("2024-01-01").cast("date"), s.cast("int")).cast("timestamp")).alias("last_updated")),
        "sys.dm_db_index_physical_stats": lambda: each.select(k.alias("object_id"), "index_id", (s * 1.5).cast("double").alias("avg_fragmentation_in_percent"), (s * 10).cast("long").alias("page_count")),
        "sys.dm_db_missing_index_details": lambda: tables.where(has(3)).select(k.alias("index_handle"), F.lit(1).alias("database_id"), k.alias("object_id"), F.lit("[parent_id]").alias("equality_columns"), F.lit(None).cast("string").alias("inequality_columns"), F.lit(None).cast("string").alias("included_columns")),
        "sys.dm_db_missing_index_groups": lambda: tables.where(has(3)).select(k.alias("index_handle"), (k + 5).alias("index_group_handle")),
        "sys.dm_db_missing_index_group_stats": lambda: tables.where(has(3)).select((k + 5).alias("group_handle"), s.cast("double").alias("avg_total_user_cost"), F.lit(50.0).alias("avg_user_impact"), (s * 10).cast("long").alias("user_seeks"), F.lit(2).cast("long").alias("user_scans")),
    }
    return lambda name: made[name]()


_MODELS: dict[tuple[str, str], M.Model] = {}


def _readable(m: M.Model) -> bool:
    """Whether the model's tables are still there."""
    try:
        m.files.take(1), m.objects.take(1)
        return True
    except Exception:  # noqa: BLE001  whatever makes them unreadable, they are built anew
        return False


def catalog(spark: SparkSession, d: str) -> M.Model:
    """The linted model of the scripts with the counters and details of the system tables.

    Built once an application and folder, and anew where its tables have been cleared.
    """
    key = (spark.sparkContext.applicationId, d)
    if key not in _MODELS or not _readable(_MODELS[key]):
        t = system(spark, d)
        m = M.build(scripts_of(spark, d))
        got = {"proc_stats": live.proc_stats(t, 1), "index_usage": live.index_usage(t, 1), "missing_indexes": live.missing_indexes(t, 1)}
        m = M.with_runtime(m, live.runtime(got), True)
        m = M.with_catalog_detail(m, live.columns(t), live.index_columns(t), live.table_stats(t))
        _MODELS.clear()
        _MODELS[key] = rules.linted(m)
    return _MODELS[key]


# ---- parsed facts -------------------------------------------------------------------------------------------------


@query("parsed_objects", f"""WITH {EDGES_SQL}, ref AS (SELECT src, string_agg(DISTINCT dst, ',' ORDER BY dst) AS refs FROM d WHERE dst <> '' GROUP BY 1)
SELECT id, sch AS schema, nm AS name, kind, slug AS defined_in_slug, CAST(1 AS INTEGER) AS defined_at_line, CASE WHEN r = 0 AND s % 4 <> 0 THEN 'id' ELSE '' END AS primary_key, CASE WHEN r = 0 AND s % 2 = 0 THEN 'IX_' || k || '(parent_id)' ELSE '' END AS indexes,
  CAST(CASE WHEN r <> 1 THEN 1 WHEN s > 40 THEN 16 ELSE 1 + s % 5 END AS INTEGER) AS cyclomatic, coalesce(refs, '') AS refs FROM o LEFT JOIN ref ON id = src""")
def parsed_objects(spark: SparkSession, d: str) -> DataFrame:
    flat = [F.array_join(c, ",").alias(c) for c in ("primary_key", "indexes", "refs")]
    return catalog(spark, d).objects.select("id", "schema", "name", "kind", "defined_in_slug", "defined_at_line", "cyclomatic", *flat)


@query("parsed_columns", f"""WITH {PARTS_SQL}
SELECT id, 'id' AS name, 'INT' AS data_type, false AS nullable, s % 3 = 0 AS is_identity, 4 AS max_length, '' AS collation FROM o WHERE r = 0 UNION ALL SELECT id, 'parent_id', 'INT', s % 6 < 3, false, 4, '' FROM o WHERE r = 0
UNION ALL SELECT id, 'note', CASE WHEN s % 7 = 0 THEN 'TEXT' ELSE 'VARCHAR' END, true, false, CASE WHEN s % 7 = 0 THEN 16 WHEN s % 9 = 0 THEN -1 WHEN s % 9 = 1 THEN 9000 ELSE 50 END, 'Latin1' FROM o WHERE r = 0""")
def parsed_columns(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).objects.select("id", F.explode("columns").alias("c")).select("id", "c.name", "c.data_type", "c.nullable", "c.is_identity", "c.max_length", "c.collation")


@query("parsed_foreign_keys", f"""WITH {PARTS_SQL} SELECT id AS from_object_id, CASE WHEN about IN (SELECT id FROM o) THEN about ELSE '' END AS to_object_id, 'parent_id' AS from_columns, 'id' AS to_columns, 'FK_' || k AS name, CASE WHEN s % 5 = 0 THEN 'Cascade' ELSE 'NotSpecified' END AS on_delete FROM o WHERE r = 0""")
def parsed_foreign_keys(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).foreign_keys.select("from_object_id", "to_object_id", F.array_join("from_columns", ",").alias("from_columns"), F.array_join("to_columns", ",").alias("to_columns"), "name", "on_delete")


@query("parsed_dependencies", f"WITH {EDGES_SQL} SELECT src AS from_object_id, dst AS to_object_id, ext AS external_target, kind, count(*) AS n FROM d GROUP BY ALL")
def parsed_dependencies(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).dependencies.groupBy("from_object_id", "to_object_id", "external_target", "kind").agg(F.count("*").alias("n"))


@query("parsed_flags", f"WITH {PARTS_SQL} SELECT id, s % 4 = 0 AS uses_nolock, s % 10 = 0 AS uses_cursor, s % 8 = 0 AS uses_at_at_identity, s % 2 = 0 AS has_set_nocount, s % 9 = 0 AS uses_execute_as FROM o WHERE r = 1")
def parsed_flags(spark: SparkSession, d: str) -> DataFrame:
    return R.of_kind(catalog(spark, d).objects, "procedure").select("id", *[f"code_flags.{c}" for c in ("uses_nolock", "uses_cursor", "uses_at_at_identity", "has_set_nocount", "uses_execute_as")])


@query("script_files", f"""WITH {PARTS_SQL} SELECT 'sql/k' || k || '.sql' AS rel_path, slug, 'tsql' AS dialect, CAST(1 + CASE WHEN r = 0 AND s % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN r = 0 AND s % 13 = 0 THEN 1 ELSE 0 END AS INTEGER) AS statement_count,
  true AS parsed_cleanly, r = 0 AND s % 13 = 0 AS has_credential, '1 ' || kind AS purpose, id AS object_ids FROM o""")
def script_files(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).files.select("rel_path", "slug", "dialect", "statement_count", "parsed_cleanly", "has_credential", "purpose", F.array_join("object_ids", ",").alias("object_ids"))


@query("model_crud", f"""WITH {EDGES_SQL} SELECT dst AS target, src AS actor, string_agg(DISTINCT CASE kind WHEN 'read' THEN 'R' WHEN 'update' THEN 'U' ELSE 'D' END, '' ORDER BY CASE kind WHEN 'read' THEN 'R' WHEN 'update' THEN 'U' ELSE 'D' END) AS ops, false AS is_blind_spot FROM d
WHERE dst <> '' AND kind IN ('read', 'update', 'delete') GROUP BY 1, 2 UNION ALL SELECT '', src, '?', true FROM d WHERE kind = 'exec-dynamic'""")
def model_crud(spark: SparkSession, d: str) -> DataFrame:
    return catalog(spark, d).crud


# ---- rules, scorecard, gates --------------------------------------------------------------------------------------

_called = "(SELECT dst FROM d WHERE dst <> '')"
#: For each rule the objects that it finds, with how many findings.
FOUND_SQL = {
    "SQL0001": "SELECT '' AS object_id, slug, 1 AS n FROM o WHERE r = 0 AND s % 13 = 0",
    "SQL0002": "SELECT id, slug, 1 FROM o WHERE r = 1 AND s % 7 = 0",
    "SQL0003": "SELECT id, slug, 1 FROM o WHERE r = 0 AND s % 4 = 0",
    "SQL0004": "SELECT id, slug, 1 FROM o WHERE r = 1 AND s % 5 = 0",
    "SQL0005": "SELECT id, slug, 1 FROM o WHERE r > 0 AND s % 3 = 0",
    "SQL0006": "SELECT id, slug, 1 FROM o WHERE r = 0 AND s % 6 < 3",
    "SQL0007": "SELECT id, slug, 1 FROM o WHERE r = 0 AND s % 2 = 1",
    "SQL0008": "SELECT id, slug, 1 FROM o WHERE r = 1 AND s > 40",
    "SQL0009": "SELECT id, slug, 1 FROM o WHERE r = 2 AND s % 11 = 0",
    "SQL0010": f"SELECT id, slug, 1 FROM o WHERE r = 1 AND id NOT IN {_called} AND NOT (s % 4 = 1 AND s % 2 = 1)",
    "SQL0011": "SELECT id, slug, 1 FROM o WHERE r = 1 AND s % 17 = 0",
    "SQL0012": "SELECT id, slug, 1 FROM o WHERE r = 0 AND s % 7 = 0",
    "SQL0013": "SELECT id, slug, 1 FROM o WHERE r = 0 AND s % 4 = 0",
    "SQL0014": "SELECT id, slug, 1 FROM o WHERE r = 0 AND s % 10 = 0",
    "SQL0015": "SELECT id, slug, 1 FROM o WHERE r = 0 AND s % 7 <> 0 AND s % 9 < 2",
    "SQL0016": "SELECT id, slug, 1 FROM o WHERE r = 0 AND s % 2 = 0 AND s % 3 = 0 AND s % 5 > 0",
    "SQL0017": "SELECT id, slug, 1 FROM o WHERE r = 1 AND s % 4 = 0",
    "SQL0018": "SELECT id, slug, 1 FROM o WHERE r = 1 AND s % 10 = 0",
    "SQL0019": "SELECT id, slug, 1 FROM o WHERE r = 1 AND s % 8 = 0",
    "SQL0020": "SELECT id, slug, 1 FROM o WHERE r = 1 AND s % 2 = 1",
    "SQL0021": "SELECT id, slug, 1 FROM o WHERE r = 1 AND s % 9 = 0",
}


def _rule(rule: rules.Rule) -> None:
    sql = f"WITH {EDGES_SQL}, f(object_id, slug, n) AS ({FOUND_SQL[rule.id]}) SELECT '{rule.id}' AS rule_id, CAST({rule.severity} AS INTEGER) AS severity, object_id, slug, CAST(n AS BIGINT) AS n FROM f"
    query(f"lint_{rule.id.lower()}", sql)(lambda spark, d: catalog(spark, d).findings.where(F.col("rule_id") == rule.id).groupBy("rule_id", "severity", "object_id", "slug").agg(F.count("*").alias("n")))


for _one in rules.RULES:
    _rule(_one)

_sum = lambda where: f"(SELECT count(*) FROM o WHERE {where})"
CARD_SQL = f"""card(metric, bad, n, status) AS (
  SELECT 'Tables without a primary key', bad, n, CASE WHEN n = 0 THEN NULL WHEN bad = 0 THEN 0 WHEN bad <= n // 10 + 1 THEN 1 ELSE 2 END FROM (SELECT {_sum("r = 0 AND s % 4 = 0")} AS bad, {_sum("r = 0")} AS n)
  UNION ALL SELECT 'FK columns without a covering index', bad, n, CASE WHEN n = 0 THEN NULL WHEN bad = 0 THEN 0 WHEN bad <= n // 4 + 1 THEN 1 ELSE 2 END FROM (SELECT {_sum("r = 0 AND s % 2 = 1")} AS bad, {_sum("r = 0")} AS n)
  UNION ALL SELECT 'Credentials in DDL', bad, NULL, CASE WHEN bad = 0 THEN 0 ELSE 2 END FROM (SELECT {_sum("r = 0 AND s % 13 = 0")} AS bad)
  UNION ALL SELECT 'Injection-risk dynamic SQL', bad, NULL, CASE WHEN bad = 0 THEN 0 ELSE 2 END FROM (SELECT {_sum("r = 1 AND s % 7 = 0")} AS bad)
  UNION ALL SELECT 'Average procedure complexity', NULL, NULL, CASE WHEN a <= 5 THEN 0 WHEN a <= 10 THEN 1 ELSE 2 END FROM (SELECT avg(CASE WHEN s > 40 THEN 16 ELSE 1 + s % 5 END) AS a FROM o WHERE r = 1)
  UNION ALL SELECT 'Dead / unreferenced objects', bad, n, CASE WHEN n = 0 THEN NULL WHEN bad / n <= 0.1 THEN 0 WHEN bad / n <= 0.3 THEN 1 ELSE 2 END FROM (SELECT (SELECT count(*) FROM ({FOUND_SQL["SQL0010"]})) AS bad, {_sum("r = 1")} AS n))"""


@query("scorecard", f"""WITH {EDGES_SQL}, {CARD_SQL} SELECT metric, CASE WHEN metric LIKE 'Average%' THEN '' WHEN n IS NULL THEN CAST(bad AS VARCHAR) ELSE bad || '/' || n END AS value, CAST(status AS INTEGER) AS status,
  CASE status WHEN 0 THEN 'Ok' WHEN 1 THEN 'Watch' WHEN 2 THEN 'Fail' ELSE 'NA' END AS status_name FROM card""")
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    return rules.scorecard(catalog(spark, d)).withColumn("value", F.when(F.col("metric").startswith("Average"), "").otherwise(F.col("value")))


@query("scorecard_overall", f"WITH {EDGES_SQL}, {CARD_SQL} SELECT CAST(coalesce(max(status), 0) AS INTEGER) AS status FROM card")
def scorecard_overall(spark: SparkSession, d: str) -> DataFrame:
    return rules.overall(rules.scorecard(catalog(spark, d)))


@query("gates", f"""WITH {EDGES_SQL}, {CARD_SQL} SELECT g AS gate FROM (VALUES ('secrets', 'Credentials in DDL'), ('injection', 'Injection-risk dynamic SQL'), ('no-pk', 'Tables without a primary key')) v(g, m) JOIN card ON m = metric AND status = 2
UNION ALL SELECT 'scorecard' WHERE EXISTS (SELECT 1 FROM card WHERE status = 2)""")
def gates(spark: SparkSession, d: str) -> DataFrame:
    names = rules.tripped(rules.scorecard(catalog(spark, d)), rules.GATE_NAMES)
    return spark.createDataFrame([(n,) for n in names], "gate string")


@query("dead_programmables", f"WITH {EDGES_SQL} SELECT id FROM ({FOUND_SQL['SQL0010']}) x(id, slug, n)")
def dead_programmables(spark: SparkSession, d: str) -> DataFrame:
    return rules.dead_objects(catalog(spark, d)).select("id")


@query("resolve_blanked", f"WITH {PARTS_SQL} SELECT CASE WHEN about IN (SELECT id FROM o) THEN about ELSE '' END AS to_object_id, count(*) AS n FROM o WHERE r = 0 GROUP BY 1")
def resolve_blanked(spark: SparkSession, d: str) -> DataFrame:
    edges = parts(spark, d).where("r = 0").select(_text(_schema(F.col("about")), ".t", F.col("about")).alias("to_object_id"))
    known = parts(spark, d).select(F.lower(F.concat_ws(".", "sch", "nm")).alias("id"))
    return R.resolve(edges, known, external=None).groupBy("to_object_id").agg(F.count("*").alias("n"))


# ---- live catalog -------------------------------------------------------------------------------------------------

SHIPPED = "s % 50 <> 49"


def _live(name: str, sql: str, rows: Callable[[live.Tables], DataFrame]) -> None:
    query(f"live_{name}", f"WITH {PARTS_SQL} {sql}")(lambda spark, d: rows(system(spark, d)))


_IX = "ix AS (SELECT *, 1 AS i, 'PK_' || k AS x FROM o WHERE r = 0 AND s % 4 <> 0 UNION ALL SELECT *, 2, 'IX_' || k FROM o WHERE r = 0 AND s % 2 = 0 UNION ALL SELECT *, 3, 'IY_' || k FROM o WHERE r = 0 AND s % 10 = 0)"
_live("objects", f"SELECT sch AS schema, nm AS name, CASE r WHEN 0 THEN 'U' WHEN 1 THEN 'P' ELSE 'V' END AS type_code FROM o WHERE {SHIPPED}", live.objects)
_live("columns", """SELECT sch AS schema, nm AS "table", c AS "column", CASE WHEN c <> 'note' THEN 'int' WHEN s % 7 = 0 THEN 'text' ELSE 'varchar' END AS type_name, CAST(i AS INTEGER) AS ordinal,
  CASE c WHEN 'id' THEN false WHEN 'parent_id' THEN s % 6 < 3 ELSE true END AS is_nullable, c = 'id' AND s % 3 = 0 AS is_identity, CASE c WHEN 'note' THEN 'Latin1' ELSE '' END AS collation FROM o, (VALUES (1, 'id'), (2, 'parent_id'), (3, 'note')) v(i, c) WHERE r = 0""", lambda t: live.columns(t).select("schema", "table", "column", "type_name", "ordinal", "is_nullable", "is_identity", "collation"))
_live("index_columns", f""", {_IX} SELECT sch AS schema, nm AS "table", x AS index_name, i = 1 AS is_unique, i = 1 AS is_primary_key, CASE i WHEN 1 THEN 'CLUSTERED' ELSE 'NONCLUSTERED' END AS type_desc, false AS is_disabled, c AS column_name, CAST(n AS INTEGER) AS key_ordinal, false AS is_included
FROM ix JOIN (VALUES (1, 'id', 1), (2, 'parent_id', 1), (3, 'parent_id', 1), (3, 'note', 2)) v(j, c, n) ON i = j""".replace("WITH", ""), live.index_columns)
_live("table_stats", """SELECT sch AS schema, nm AS "table", CAST(s * 100 AS BIGINT) AS row_count, CAST(s * 16 AS BIGINT) AS reserved_kb FROM o WHERE r = 0""", live.table_stats)
_live("primary_keys", """SELECT sch AS schema, nm AS "table", 'id' AS "column", CAST(1 AS INTEGER) AS key_ordinal FROM o WHERE r = 0 AND s % 4 <> 0""", live.primary_keys)
_live("foreign_keys", """SELECT o.sch AS schema, o.nm AS "table", t.sch AS ref_schema, t.nm AS ref_table, 'FK_' || o.k AS fk_name, CASE WHEN o.s % 5 = 0 THEN 'CASCADE' ELSE 'NO_ACTION' END AS on_delete, 'parent_id' AS from_column, 'id' AS to_column, CAST(1 AS INTEGER) AS ordinal FROM o JOIN o t ON o.about = t.id WHERE o.r = 0""", live.foreign_keys)
_live("modules", f"SELECT sch AS schema, nm AS name, true AS has_text FROM o WHERE r > 0 AND {SHIPPED}", lambda t: live.modules(t).select("schema", "name", (F.length("definition") > 40).alias("has_text")))
_live("proc_stats", "SELECT sch AS schema, nm AS name, CAST(s * 10 AS BIGINT) AS exec_count, CAST(s * 1999 // 1000 AS BIGINT) AS total_worker_ms, CAST(s AS BIGINT) AS total_logical_reads FROM o WHERE r = 1 AND s % 4 = 1 AND s % 2 = 1", lambda t: live.proc_stats(t, 1))
_live("index_usage", f""", {_IX} SELECT sch AS schema, nm AS "table", x AS index_name, CAST(CASE i WHEN 2 THEN s % 3 ELSE 0 END AS BIGINT) AS seeks, CAST(0 AS BIGINT) AS scans, CAST(0 AS BIGINT) AS lookups, CAST(CASE i WHEN 2 THEN s % 5 ELSE 0 END AS BIGINT) AS updates FROM ix""", lambda t: live.index_usage(t, 1))
_live("backups", "SELECT CAST(ts AS TIMESTAMP) AS backup_finish_date FROM events WHERE event_type = 'purchase'", lambda t: live.backups(t, "purchase"))
_live("stats_age", """SELECT sch AS schema, nm AS "table", 'ST_' || k AS stats_name, CAST(DATE '2024-01-01' + CAST(s AS INTEGER) AS TIMESTAMP) AS last_updated FROM o WHERE r = 0 AND s % 7 <> 0""", live.stats_age)
_live("fragmentation", f""", {_IX} SELECT sch AS schema, nm AS "table", x AS index_name, s * 1.5::DOUBLE AS fragmentation_percent, CAST(s * 10 AS BIGINT) AS page_count FROM ix WHERE s > 10""", live.fragmentation)
_live("missing_indexes", """SELECT sch AS schema, nm AS "table", '[parent_id]' AS equality_columns, '' AS inequality_columns, '' AS included_columns, CAST(s AS DOUBLE) * 50.0 / 100 * (s * 10 + 2) AS impact_score FROM o WHERE r = 0 AND s % 3 = 0""", lambda t: live.missing_indexes(t, 1))


# ---- views --------------------------------------------------------------------------------------------------------


@query("view_overview", f"""WITH {EDGES_SQL}, {CARD_SQL}, n AS (SELECT {" + ".join(f"(SELECT count(*) FROM ({q}))" for q in FOUND_SQL.values())} AS findings)
SELECT tile, CAST(value AS BIGINT) AS value FROM (SELECT 'tables' AS tile, {_sum("r = 0")} AS value UNION ALL SELECT 'views', {_sum("r = 2")} UNION ALL SELECT 'programmables', {_sum("r = 1")} UNION ALL SELECT 'files', {_sum("true")}
UNION ALL SELECT 'degraded_files', 0 UNION ALL SELECT 'findings', findings FROM n UNION ALL SELECT 'foreign_keys', {_sum("r = 0")})""")
def view_overview(spark: SparkSession, d: str) -> DataFrame:
    return views.overview(catalog(spark, d)).select("tile", F.col("value").cast("long").alias("value"))


FAN2_SQL = "fan AS (SELECT o.id, coalesce(i.n, 0) AS fan_in, coalesce(u.n, 0) AS fan_out FROM o LEFT JOIN (SELECT dst, count(DISTINCT src) AS n FROM d WHERE dst <> '' GROUP BY 1) i ON o.id = i.dst LEFT JOIN (SELECT src, count(DISTINCT dst) AS n FROM d WHERE dst <> '' GROUP BY 1) u ON o.id = u.src)"


@query("view_objects", f"""WITH {EDGES_SQL}, {FAN2_SQL} SELECT sch AS schema, nm AS name, kind, CASE WHEN r = 0 THEN s % 4 <> 0 END AS has_primary_key, CAST(CASE WHEN r = 0 THEN 3 ELSE 0 END AS INTEGER) AS columns, fan_in, fan_out, 'sql/k' || k || '.sql' AS rel_path, false AS shallow FROM o JOIN fan USING (id)""")
def view_objects(spark: SparkSession, d: str) -> DataFrame:
    return views.objects(catalog(spark, d)).select("schema", "name", "kind", "has_primary_key", "columns", "fan_in", "fan_out", "rel_path", "shallow")


@query("view_coupling", f"""WITH {EDGES_SQL}, {FAN2_SQL} SELECT id, fan_in, fan_out, fan_out / CAST(fan_in + fan_out AS DOUBLE) AS instability FROM fan WHERE fan_in + fan_out > 0""")
def view_coupling(spark: SparkSession, d: str) -> DataFrame:
    return views.coupling(catalog(spark, d)).select("id", "fan_in", "fan_out", "instability")


@query("view_most_referenced", f"WITH {EDGES_SQL}, {FAN2_SQL} SELECT id, fan_in FROM fan ORDER BY fan_in DESC, id LIMIT 15")
def view_most_referenced(spark: SparkSession, d: str) -> DataFrame:
    return views.most_referenced(catalog(spark, d))


@query("view_most_referencing", f"WITH {EDGES_SQL}, {FAN2_SQL} SELECT id, fan_out FROM fan ORDER BY fan_out DESC, id LIMIT 15")
def view_most_referencing(spark: SparkSession, d: str) -> DataFrame:
    return views.most_referencing(catalog(spark, d))


@query("view_most_complex", f"WITH {PARTS_SQL} SELECT id, CAST(CASE WHEN s > 40 THEN 16 ELSE 1 + s % 5 END AS INTEGER) AS cyclomatic FROM o WHERE r = 1 ORDER BY 2 DESC, 1 LIMIT 20")
def view_most_complex(spark: SparkSession, d: str) -> DataFrame:
    return views.most_complex(catalog(spark, d))


@query("view_severity", f"""WITH {EDGES_SQL}, f(sev, n) AS ({" UNION ALL ".join(f"SELECT {r.severity}, count(*) FROM ({FOUND_SQL[r.id]})" for r in rules.RULES)}) SELECT CAST(sev AS INTEGER) AS severity, CAST(sum(n) AS BIGINT) AS findings FROM f GROUP BY sev""")
def view_severity(spark: SparkSession, d: str) -> DataFrame:
    return views.lint(catalog(spark, d))[0]


@query("view_secrets", f"WITH {PARTS_SQL} SELECT 'sql/k' || k || '.sql' AS rel_path, slug FROM o WHERE r = 0 AND s % 13 = 0")
def view_secrets(spark: SparkSession, d: str) -> DataFrame:
    return views.secrets(catalog(spark, d))


@query("view_heaps", f"WITH {PARTS_SQL} SELECT id, CAST(s * 100 AS BIGINT) AS row_count, CAST(s * 16 AS BIGINT) AS reserved_kb FROM o WHERE r = 0 AND s % 4 = 0")
def view_heaps(spark: SparkSession, d: str) -> DataFrame:
    return views.indexes(catalog(spark, d))["heaps"]


@query("view_duplicate_indexes", f"WITH {PARTS_SQL} SELECT id AS object_id, 'IX_' || k AS first, 'IY_' || k AS second, 'prefix' AS relation FROM o WHERE r = 0 AND s % 10 = 0")
def view_duplicate_indexes(spark: SparkSession, d: str) -> DataFrame:
    return views.indexes(catalog(spark, d))["duplicates"]


@query("view_unused_indexes", f"WITH {PARTS_SQL} SELECT id AS object_id, 'IX_' || k AS name, CAST(s % 5 AS BIGINT) AS user_updates FROM o WHERE r = 0 AND s % 2 = 0 AND s % 3 = 0 AND s % 5 > 0")
def view_unused_indexes(spark: SparkSession, d: str) -> DataFrame:
    return views.indexes(catalog(spark, d))["unused"].select("object_id", "name", "user_updates")


@query("view_largest", f"WITH {PARTS_SQL} SELECT id, CAST(s * 100 AS BIGINT) AS row_count, CAST(s * 16 AS BIGINT) AS reserved_kb FROM o WHERE r = 0 ORDER BY s DESC, id LIMIT 25")
def view_largest(spark: SparkSession, d: str) -> DataFrame:
    return views.indexes(catalog(spark, d))["largest"]


@query("view_missing_indexes", f"WITH {PARTS_SQL} SELECT id AS object_id, CAST(s AS DOUBLE) * 50.0 / 100 * (s * 10 + 2) AS impact_score, CAST(s AS DOUBLE) * 50.0 / 100 * (s * 10 + 2) >= 10000 AS high_impact FROM o WHERE r = 0 AND s % 3 = 0")
def view_missing_indexes(spark: SparkSession, d: str) -> DataFrame:
    return views.activity(catalog(spark, d))["missing"].select("object_id", "impact_score", "high_impact")


@query("view_crud", f"""WITH {EDGES_SQL} SELECT dst AS target, src AS actor, (CASE WHEN bool_or(kind = 'read') THEN 'R' ELSE '' END) || (CASE WHEN bool_or(kind = 'update') THEN 'U' ELSE '' END) || (CASE WHEN bool_or(kind = 'delete') THEN 'D' ELSE '' END) AS ops
FROM d WHERE dst <> '' AND kind IN ('read', 'update', 'delete') GROUP BY 1, 2""")
def view_crud(spark: SparkSession, d: str) -> DataFrame:
    return views.crud(catalog(spark, d))[0]


@query("view_blind_spots", f"WITH {EDGES_SQL} SELECT DISTINCT src AS actor FROM d WHERE kind = 'exec-dynamic'")
def view_blind_spots(spark: SparkSession, d: str) -> DataFrame:
    return views.crud(catalog(spark, d))[1]


@query("view_search", f"WITH {PARTS_SQL} SELECT 'object' AS kind, sch || '.' || nm AS name, kind AS detail, 'files/' || slug || '.html' AS href FROM o UNION ALL SELECT 'file', 'sql/k' || k || '.sql', 'file', 'files/' || slug || '.html' FROM o")
def view_search(spark: SparkSession, d: str) -> DataFrame:
    return views.search_index(catalog(spark, d))


@query("view_impact", f"""WITH RECURSIVE {EDGES_SQL}, e AS (SELECT DISTINCT src, dst FROM d WHERE dst <> ''), root AS (SELECT min(id) AS id FROM o WHERE r = 0),
h(id, depth) AS (SELECT id, 0 FROM root UNION SELECT src, depth + 1 FROM h JOIN e ON dst = h.id WHERE depth < 32) SELECT id AS object_id, CAST(min(depth) AS INTEGER) AS depth FROM h WHERE id NOT IN (SELECT id FROM root) GROUP BY 1""")
def view_impact(spark: SparkSession, d: str) -> DataFrame:
    m = catalog(spark, d)
    root = R.of_kind(m.objects, "table").agg(F.min("id").alias("id")).first()["id"]
    return views.impact(m, root).select("object_id", "depth")


@query("view_drift", f"""WITH {PARTS_SQL} SELECT 'object-dropped' AS kind, id AS target, 2 AS risk FROM o WHERE r = 2""")
def view_drift(spark: SparkSession, d: str) -> DataFrame:
    from dataclasses import replace

    m = catalog(spark, d)
    return views.drift(m, replace(m, objects=m.objects.where("kind <> 'view'"))).select("kind", "target", "risk")
