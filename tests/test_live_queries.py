"""Catalog queries over tables of the same shape as the system's."""

from datetime import datetime

import pytest

from relscope.sources import live


@pytest.fixture(scope="module")
def system(spark):
    df = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    tables = {
        "sys.schemas": df("schema_id int, name string", (1, "dbo"), (2, "app")),
        "sys.objects": df("object_id int, schema_id int, name string, type string, is_ms_shipped boolean", (10, 1, "Parent", "U ", False), (11, 2, "Child", "U ", False), (12, 1, "usp_a", "P ", False), (13, 1, "sysx", "U ", True), (14, 1, "q", "SQ", False)),
        "sys.types": df("user_type_id int, name string", (56, "int"), (231, "nvarchar")),
        "sys.columns": df("object_id int, column_id int, name string, user_type_id int, max_length int, precision int, scale int, is_nullable boolean, is_identity boolean, collation_name string", (10, 1, "Id", 56, 4, 10, 0, False, True, None), (11, 2, "Name", 231, 40, 0, 0, True, False, "C"), (11, 1, "ParentId", 56, 4, 10, 0, False, False, None)),
        "sys.indexes": df("object_id int, index_id int, name string, is_unique boolean, is_primary_key boolean, type_desc string, is_disabled boolean", (10, 1, "PK_Parent", True, True, "CLUSTERED", False), (11, 2, "IX", False, False, "NONCLUSTERED", False), (11, 0, None, False, False, "HEAP", False)),
        "sys.index_columns": df("object_id int, index_id int, column_id int, key_ordinal int, is_included_column boolean", (10, 1, 1, 1, False), (11, 2, 1, 1, False), (11, 2, 2, 0, True)),
        "sys.dm_db_partition_stats": df("object_id int, index_id int, row_count long, reserved_page_count long", (10, 1, 5, 2), (11, 0, 7, 3), (11, 2, 7, 4)),
        "sys.key_constraints": df("parent_object_id int, unique_index_id int, type string", (10, 1, "PK"), (11, 2, "UQ")),
        "sys.foreign_keys": df("object_id int, name string, delete_referential_action_desc string", (90, "FK", "CASCADE")),
        "sys.foreign_key_columns": df("constraint_object_id int, constraint_column_id int, parent_object_id int, parent_column_id int, referenced_object_id int, referenced_column_id int", (90, 1, 11, 1, 10, 1)),
        "sys.sql_modules": df("object_id int, definition string", (12, "CREATE PROCEDURE dbo.usp_a AS SELECT 1"), (13, "hidden")),
        "sys.dm_exec_procedure_stats": df("database_id int, object_id int, execution_count long, total_worker_time long, total_logical_reads long", (7, 12, 3, 2999, 5), (8, 12, 100, 0, 0)),
        "sys.dm_db_index_usage_stats": df("database_id int, object_id int, index_id int, user_seeks long, user_scans long, user_lookups long, user_updates long", (7, 11, 2, 0, 0, 0, 9), (8, 10, 1, 5, 5, 5, 5)),
        "msdb.dbo.backupset": df("database_name string, backup_finish_date timestamp", ("d", datetime(2024, 1, 1)), ("d", datetime(2024, 1, 3)), ("x", datetime(2024, 2, 1))),
        "sys.stats": df("object_id int, stats_id int, name string", (10, 1, "s1"), (11, 2, "s2")),
        "sys.dm_db_stats_properties": df("object_id int, stats_id int, last_updated timestamp", (10, 1, datetime(2024, 1, 1)), (11, 2, None)),
        "sys.dm_db_index_physical_stats": df("object_id int, index_id int, avg_fragmentation_in_percent double, page_count long", (11, 2, 40.0, 200), (10, 1, 50.0, 100), (11, 0, 90.0, 900)),
        "sys.dm_db_missing_index_details": df("index_handle int, database_id int, object_id int, equality_columns string, inequality_columns string, included_columns string", (1, 7, 11, "[Name]", None, None)),
        "sys.dm_db_missing_index_groups": df("index_handle int, index_group_handle int", (1, 2)),
        "sys.dm_db_missing_index_group_stats": df("group_handle int, avg_total_user_cost double, avg_user_impact double, user_seeks long, user_scans long", (2, 10.0, 50.0, 3, 1)),
    }
    return tables.__getitem__


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_every_query(system):
    assert rows(live.objects(system)) == [("app", "Child", "U"), ("dbo", "Parent", "U"), ("dbo", "usp_a", "P")]
    assert [r["column"] for r in live.columns(system).collect()] == ["ParentId", "Name", "Id"]
    assert [(r["index_name"], r["column_name"], r["is_included"]) for r in live.index_columns(system).collect()] == [("IX", "Name", True), ("IX", "ParentId", False), ("PK_Parent", "Id", False)]
    assert rows(live.table_stats(system)) == [("app", "Child", 7, 56), ("dbo", "Parent", 5, 16)]
    assert rows(live.primary_keys(system)) == [("dbo", "Parent", "Id", 1)]
    assert rows(live.foreign_keys(system)) == [("app", "Child", "dbo", "Parent", "FK", "CASCADE", "ParentId", "Id", 1)]
    assert rows(live.modules(system)) == [("dbo", "usp_a", "CREATE PROCEDURE dbo.usp_a AS SELECT 1")]
    assert rows(live.proc_stats(system, 7)) == [("dbo", "usp_a", 3, 2, 5)]
    assert rows(live.index_usage(system, 7)) == [("app", "Child", "IX", 0, 0, 0, 9), ("dbo", "Parent", "PK_Parent", 0, 0, 0, 0)]
    assert [r[0].day for r in live.backups(system, "d").collect()] == [3, 1]
    assert rows(live.stats_age(system)) == [("dbo", "Parent", "s1", datetime(2024, 1, 1))]
    assert rows(live.fragmentation(system)) == [("app", "Child", "IX", 40.0, 200)]
    assert rows(live.missing_indexes(system, 7)) == [("app", "Child", "[Name]", "", "", 20.0)]


def test_rows_have_the_declared_shapes(system, spark):
    got = {"objects": live.objects(system), "columns": live.columns(system), "primary_keys": live.primary_keys(system), "foreign_keys": live.foreign_keys(system), "modules": live.modules(system), "proc_stats": live.proc_stats(system, 7), "index_usage": live.index_usage(system, 7), "missing_indexes": live.missing_indexes(system, 7), "index_columns": live.index_columns(system), "table_stats": live.table_stats(system), "backups": live.backups(system, "d"), "stats_age": live.stats_age(system), "fragmentation": live.fragmentation(system)}
    for name, df in got.items():
        assert df.columns == [c.split()[0] for c in live.ROWS[name].split(", ")], name
    m = live.build(got, datetime(2024, 1, 10))
    assert rows(m.objects.select("id")) == [("app.child",), ("dbo.parent",), ("dbo.usp_a",)] and m.meta["days_since_last_backup"] == 7


class Thrown:
    """A Java exception as py4j shows it."""

    def __init__(self, cause=None, code=None):
        self.cause, self.code = cause, code

    def getErrorCode(self):  # noqa: N802
        if self.code is None:
            raise AttributeError("no such method")
        return self.code

    def getCause(self):  # noqa: N802
        return self.cause


@pytest.mark.parametrize(("error", "want"), [
    (Thrown(Thrown(code=297)), {297}), (Thrown(Thrown(Thrown(code=300))), {300}), (Thrown(code=208), {208}), (Thrown(), set()),
])
def test_error_codes_of_the_jvm(error, want):
    failure = Exception("An error occurred while calling o1.load")
    failure.java_exception = error
    assert live.error_codes(failure) == want


def test_error_codes_in_text():
    assert live.error_codes(ValueError("Error 297: VIEW SERVER STATE")) == {297}
    assert live.error_codes(ValueError("permission was denied (300)")) == {300} and live.error_codes(ValueError("nothing")) == set()


def test_table_functions_are_asked_with_their_arguments(spark):
    class Reader:
        def format(self, _):
            return self

        def options(self, **_):
            return self

        def option(self, _, value):
            self.asked = value
            return self

        def load(self):
            return self.asked

    class Session:
        read = Reader()

    t = live.jdbc_tables(Session(), "jdbc:sqlserver://h")
    assert "CROSS APPLY sys.dm_db_stats_properties(x.object_id, x.stats_id)" in t("sys.dm_db_stats_properties") and "NULL, NULL, NULL" in t("sys.dm_db_index_physical_stats")
    assert t("sys.objects") == "sys.objects"


def test_runtime_note_counts(system):
    got = {"objects": live.objects(system), "index_usage": live.index_usage(system, 7), "proc_stats": live.proc_stats(system, 7), "missing_indexes": live.missing_indexes(system, 7)}
    note = live.build(got, datetime(2024, 1, 10)).meta["runtime_note"]
    assert note.startswith("1 objects ran, 1 missing indexes are suggested, 1 indexes are unused")
    assert "may not read" in live.build({"objects": live.objects(system)}, datetime(2024, 1, 10)).meta["runtime_note"]
