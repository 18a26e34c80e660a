"""The script source, documents from partitions, and live reads through a real JDBC driver."""

import json
import os
from datetime import datetime

import pytest

from relscope.operators import model as M
from relscope.operators import rules, views
from relscope.sources import documents, live, script_source, scripts, sinks
from tests.test_live_queries import rows, system  # noqa: F401  (system is a fixture)


@pytest.fixture
def folder(tmp_path):
    for path, text in {"a.sql": b"CREATE TABLE dbo.a (id INT)", "sub/b.DDL": "CREATE TABLE dbo.ü (id INT)".encode("utf-16"), "sub/deep/c.psql": b"\xef\xbb\xbfselect 1", "sub/d.txt": b"no", "bin/x.sql": b"no", "Node_Modules/y.sql": b"no", "old/z.sql": b"no"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(text)
    os.symlink(tmp_path / "nothing.sql", tmp_path / "sub/gone.sql")
    return str(tmp_path)


def test_source_gives_units_and_problems(spark, folder):
    got = {r["rel_path"]: r for r in script_source.read(spark, folder, ["OLD"], files="1").collect()}
    assert sorted(got) == ["a.sql", "sub/b.DDL", "sub/deep/c.psql", "sub/gone.sql"]
    assert got["sub/b.DDL"]["content"] == "CREATE TABLE dbo.ü (id INT)" and got["sub/deep/c.psql"]["content"] == "select 1" and got["a.sql"]["size_bytes"] == 27
    assert got["sub/gone.sql"]["content"] is None and "sub/gone.sql" in got["sub/gone.sql"]["problem"] and got["a.sql"]["problem"] is None
    units, problems = scripts.read_folder(spark, "file://" + folder, ["old"])
    m = M.build(units, problems=problems)
    assert sorted(r["id"] for r in m.objects.select("id").collect()) == ["dbo.a", "dbo.ü"]
    assert "sub/gone.sql" in m.diagnostics.first()["message"] and views.diagnostics(m, 1).count() == 1


def test_skipped_and_ruled_out_folders_are_not_listed(folder):
    listed = []

    class Watched(script_source.ScriptReader):
        def entries(self, store, folder):
            listed.append(os.path.basename(folder))
            if folder.endswith("deep"):
                raise PermissionError(f"{folder}: permission denied")
            return super().entries(store, folder)

    reader = Watched({"path": folder, "skip": "old"})
    parts = reader.partitions()
    assert sorted(listed) == sorted([os.path.basename(folder), "sub", "deep"])
    problems = [r for p in parts for r in reader.read(p) if r[3]]
    assert {r[0] for r in problems} == {"sub/deep", "sub/gone.sql"} and all(r[1] is None for r in problems) and any("permission denied" in r[3] for r in problems)
    for filters, want, seen in [
        ([script_source.StringStartsWith(("rel_path",), "sub/de")], ["sub/deep/c.psql"], {"sub", "deep"}), ([script_source.EqualTo(("rel_path",), "a.sql")], ["a.sql"], set()),
        ([script_source.In(("rel_path",), ("a.sql", "sub/b.DDL"))], ["a.sql", "sub/b.DDL"], {"sub"}), ([script_source.StringEndsWith(("rel_path",), ".DDL")], ["sub/b.DDL"], {"sub", "deep", "old"}),
    ]:
        listed.clear()
        reader = script_source.ScriptReader({"path": folder})
        plain = reader.entries
        reader.entries = lambda store, f, plain=plain: listed.append(os.path.basename(f.rstrip("/"))) or plain(store, f)
        assert list(reader.pushFilters([*filters, script_source.EqualTo(("content",), "x")])) == [script_source.EqualTo(("content",), "x")]
        assert [r[0] for p in reader.partitions() for r in reader.read(p)] == want
        assert set(listed) - {os.path.basename(folder)} == seen


def test_conditions_reach_the_source(spark, folder):
    df = script_source.read(spark, folder).where("rel_path like 'sub/%' and problem is null")
    assert sorted(r["rel_path"] for r in df.collect()) == ["sub/b.DDL", "sub/deep/c.psql"]
    with pytest.raises(Exception, match="no such folder"):
        script_source.read(spark, folder + "/none").collect()


# ---- documents ----------------------------------------------------------------------------------------------------


def test_documents_keep_order_and_rows(spark, tmp_path):
    n = 5000
    df = spark.range(n).selectExpr("id", "concat('{\"n\":', id, ',\"t\":\"é\"}') as text").repartition(7).orderBy("id")
    path = str(tmp_path / "deep/doc.json")
    assert documents.join(path, "[", df, "]", separator=",\n") == n
    assert [x["n"] for x in json.load(open(path, encoding="utf-8"))] == list(range(n))
    assert documents.join(path, "[", df.limit(0), "]") == 0 and open(path).read() == "[]"
    assert os.listdir(tmp_path / "deep") == ["doc.json"]
    documents.write_files(spark.range(50).selectExpr("concat('d', id % 3, '/', id, '.txt') as path", "cast(id as string) as text").repartition(4), str(tmp_path / "many"))
    assert sorted(os.listdir(tmp_path / "many/d1"))[:2] == ["1.txt", "10.txt"] and open(tmp_path / "many/d2/5.txt").read() == "5"


def test_site_and_log_have_every_row(spark, tmp_path):
    many = [(f"t/{i:04d}.sql", f"CREATE TABLE dbo.t{i} (id INT, other_id INT)") for i in range(1200)]
    m = rules.linted(M.build(scripts.units(spark, many)))
    path = str(tmp_path / "log.sarif")
    sinks.write_sarif(m, path)
    log = json.load(open(path, encoding="utf-8"))
    assert len(log["runs"][0]["results"]) == m.findings.count() > 1000 and {r["id"] for r in log["runs"][0]["tool"]["driver"]["rules"]} == {r["rule_id"] for r in m.findings.select("rule_id").distinct().collect()}
    sinks.write_site(m, str(tmp_path / "site"))
    page = open(tmp_path / "site/objects.html", encoding="utf-8").read()
    assert page.count("<tr>") == 1201 and page.endswith("</body></html>") and len(os.listdir(tmp_path / "site/files")) == 1200
    assert len(json.load(open(tmp_path / "site/graph.json"))["nodes"]) == 1200
    index = open(tmp_path / "site/assets/search-index.js", encoding="utf-8").read()
    assert len(json.loads(index[index.index("=") + 1 : -1])) == 2400
    assert "Overall grade" in open(tmp_path / "site/index.html").read()
    again = sinks.read_model(spark, str(tmp_path / "site/model.json"))
    assert again.objects.count() == 1200 and again.findings.count() == m.findings.count()


# ---- a real driver ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def server(spark, system):  # noqa: F811
    """An embedded database with tables of the server's shape, and a reader who may not see one of them."""
    jvm = spark._jvm
    jvm.System.setProperty("derby.database.sqlAuthorization", "true")
    jvm.System.setProperty("derby.stream.error.method", "java.io.OutputStream.nullOutputStream")
    url = "jdbc:derby:memory:catalog;create=true"
    names = ["sys.schemas", "sys.objects", "sys.types", "sys.columns", "sys.indexes", "sys.index_columns", "sys.dm_db_partition_stats", "sys.key_constraints", "sys.foreign_keys", "sys.foreign_key_columns", "sys.sql_modules", "sys.dm_exec_procedure_stats"]
    names += ["sys.dm_db_index_usage_stats", "msdb.dbo.backupset", "sys.stats", "sys.dm_db_stats_properties", "sys.dm_db_index_physical_stats", "sys.dm_db_missing_index_details", "sys.dm_db_missing_index_groups", "sys.dm_db_missing_index_group_stats"]
    plain = lambda name: "owner." + name.replace(".", "_")
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    jvm.java.lang.Class.forName(driver)
    for name in names:
        system(name).write.format("jdbc").options(url=url, dbtable=plain(name) + "_raw", user="owner", driver=driver).mode("overwrite").save()
    link = jvm.java.sql.DriverManager.getConnection(url + ";user=owner")
    for name in names:  # strings are written as large objects; the server's are plain
        columns = ", ".join(f'CAST("{c}" AS VARCHAR(200)) AS "{c}"' if kind == "string" else f'"{c}"' for c, kind in system(name).dtypes)
        link.createStatement().execute(f"CREATE VIEW {plain(name)} AS SELECT {columns} FROM {plain(name)}_raw")
        if name != "sys.dm_exec_procedure_stats":
            link.createStatement().execute(f"GRANT SELECT ON {plain(name)} TO reader")
    link.close()
    return lambda **o: live.jdbc_tables(spark, "jdbc:derby:memory:catalog", names=plain, driver=driver, **({"user": "reader"} | o))


@pytest.mark.parametrize("partitions", [1, 3])
def test_every_query_through_the_driver(spark, system, server, partitions):  # noqa: F811
    t = server(user="owner", partitions=partitions)
    for query, more in [(live.objects, ()), (live.index_columns, ()), (live.table_stats, ()), (live.primary_keys, ()), (live.foreign_keys, ()), (live.modules, ()), (live.proc_stats, (7,)), (live.index_usage, (7,)), (live.backups, ("d",)), (live.stats_age, ()), (live.fragmentation, ()), (live.missing_indexes, (7,)), (live.columns, ())]:
        assert sorted(rows(query(t, *more)), key=repr) == sorted(rows(query(system, *more)), key=repr), query.__name__
    if partitions > 1:
        assert t("sys.objects").rdd.getNumPartitions() == 3


def test_a_denied_table_degrades(spark, server):
    t = server()
    got, ok = live.allowed(spark, lambda: live.proc_stats(t, 7), live.ROWS["proc_stats"])
    assert not ok and got.count() == 0 and got.columns == ["schema", "name", "exec_count", "total_worker_ms", "total_logical_reads"]
    usage, ok = live.allowed(spark, lambda: live.index_usage(t, 7), live.ROWS["index_usage"])
    assert ok and usage.count() == 2
    with pytest.raises(Exception, match="(?i)table"):
        live.allowed(spark, lambda: server(user="owner")("sys.nothing"), live.ROWS["objects"])
    m = live.build({"objects": live.objects(t), "columns": live.columns(t), "index_usage": usage}, datetime(2024, 1, 10))
    assert m.meta["runtime_available"] and m.objects.count() > 0
