import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from relscope import cli
from relscope.functions import scalars as S
from relscope.operators import model as M
from relscope.operators import rules, views
from relscope.sources import live, scripts, sinks
from tests.test_tsql import SHOP

CRUD = """CREATE TABLE dbo.Line (Id INT NOT NULL PRIMARY KEY, OrderId INT NOT NULL)
GO
CREATE PROCEDURE dbo.usp_Place @t INT AS BEGIN INSERT INTO dbo.Orders (Total) VALUES (@t); UPDATE o SET Total = @t FROM dbo.Orders o WHERE o.OrderId = 1; END
GO
CREATE PROCEDURE dbo.usp_Dyn @s NVARCHAR(10) AS BEGIN SET NOCOUNT ON; EXEC ('SELECT ' + @s); SELECT * FROM Line WITH (NOLOCK) END
GO
CREATE TABLE dbo.Customers (Other INT)
"""


@pytest.fixture(scope="module")
def shop(spark):
    m = M.build(scripts.units(spark, [("b.sql", SHOP), ("c.sql", CRUD), ("m.sql", "CREATE TABLE `x` (id INT AUTO_INCREMENT) ENGINE=InnoDB")]), root_name="shop")
    return rules.linted(m)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_resolution_and_duplicates(shop):
    assert shop.meta["dialect"] == "mixed"
    notes = [r["message"] for r in shop.diagnostics.collect()]
    assert any("duplicate object dbo.customers in c.sql" in n for n in notes) and any("m.sql: mysql" in n for n in notes)
    targets = {r["name"]: r["to_object_id"] for r in shop.foreign_keys.collect()}
    assert targets == {"FK_O_C": "dbo.customers", "FK2": ""}
    external = rows(shop.dependencies.where("external_target <> ''"), "external_target")
    assert external == [("other.things",)]


def test_crud(shop):
    assert ("dbo.orders", "dbo.usp_place", "CRU") in rows(shop.crud, "target", "actor", "ops")
    assert rows(shop.crud.where("is_blind_spot"), "actor") == [("dbo.usp_dyn",)]


def test_findings(shop):
    found = set(rows(shop.findings, "rule_id", "object_id"))
    assert {("SQL0001", ""), ("SQL0002", "dbo.usp_dyn"), ("SQL0005", "dbo.usp_dyn"), ("SQL0006", "dbo.orders"), ("SQL0010", "dbo.usp_place"), ("SQL0017", "dbo.usp_dyn"), ("SQL0020", "dbo.usp_place")} <= found
    assert ("SQL0007", "dbo.orders") not in found and ("SQL0020", "dbo.usp_dyn") not in found and not any(r == "SQL0013" for r, _ in found)
    line = shop.findings.where("rule_id = 'SQL0020'").first()
    assert (line["slug"], line["line"]) == ("c_sql", 3)


def test_scorecard_and_gates(shop):
    card = rules.scorecard(shop)
    status = {r["metric"]: r["status_name"] for r in card.collect()}
    assert status["Credentials in DDL"] == "Fail" and status["Tables without a primary key"] == "Ok" and status["FK columns without a covering index"] == "Ok"
    assert rules.overall(card).first()["status"] == rules.FAIL
    assert rules.tripped(card, ["secrets", "no-pk", "scorecard", "unknown"]) == ["secrets", "scorecard"]


def test_empty_model(spark):
    card = rules.scorecard(M.empty_model(spark))
    assert {r["status_name"] for r in card.collect()} == {"NA", "Ok"} and rules.overall(card).first()["status"] == rules.OK


def test_complexity_gate_follows_the_old_name(spark):
    m = M.with_rows(M.empty_model(spark), spark, objects=[{"id": "dbo.p", "schema": "dbo", "name": "p", "kind": "procedure", "cyclomatic": 40}])
    card = rules.scorecard(m)
    assert rules.tripped(card, ["complexity"]) == [] and rules.tripped(card, ["complexity"], strict=False) == ["complexity"]


def test_rules_on_catalog_detail(spark):
    column = {"name": "a", "data_type": "nvarchar", "nullable": True, "is_identity": False, "max_length": 10000, "precision": 0, "scale": 0, "collation": ""}
    ix = lambda name, keys, clustered=False: {"name": name, "key_columns": keys, "included_columns": [], "is_unique": False, "is_primary_key": False, "is_clustered": clustered, "is_disabled": False}
    base = {"schema": "dbo", "kind": "table", "defined_in_slug": "s", "defined_at_line": 1, "primary_key": ["a"]}
    objects = [
        base | {"id": "dbo.t", "name": "t", "columns": [column, column | {"name": "b", "data_type": "ntext"}, column | {"name": "c", "max_length": -1}], "index_details": [ix("IX_A", ["a", "b"]), ix("IX_B", ["A"])]},
        base | {"id": "dbo.u", "name": "2 u", "columns": [column | {"max_length": 100}], "index_details": [ix("PK", ["a"], True)]},
        {"id": "dbo.p", "schema": "dbo", "name": "p", "kind": "procedure"},
    ]
    deps = [{"from_object_id": "dbo.p", "external_target": "master.dbo.XP_CMDSHELL", "kind": "exec"}, {"from_object_id": "dbo.p", "external_target": "x.xp_cmdshell", "kind": "exec"}]
    m = M.with_rows(M.empty_model(spark), spark, objects=objects, dependencies=deps, index_stats=[{"object_id": "dbo.t", "index_name": "IX_B", "user_updates": 12, "is_unused": True}], object_stats=[{"object_id": "dbo.p", "execution_count": 5}])
    found = rows(rules.run(m), "rule_id", "object_id")
    assert [f for f in found if f[0] == "SQL0011"] == [("SQL0011", "dbo.p")]
    assert {("SQL0012", "dbo.t"), ("SQL0013", "dbo.t"), ("SQL0014", "dbo.t"), ("SQL0009", "dbo.u")} <= set(found)
    assert found.count(("SQL0015", "dbo.t")) == 2 and ("SQL0010", "dbo.p") not in found and ("SQL0016", "dbo.t") not in found
    seen = M.with_runtime(m, {}, True)
    assert ("SQL0016", "dbo.t") in rows(rules.run(seen, ["SQL0016"]), "rule_id", "object_id")
    assert [r["drop_text"] for r in views.indexes(seen)["unused"].collect()] == ["DROP INDEX [IX_B] ON [dbo].[t];"]


def test_exclusion(spark):
    m = M.build(scripts.units(spark, [("a.sql", "CREATE TABLE T (a INT PRIMARY KEY)\nGO\nCREATE TABLE T_BAK (a INT)\nGO\nCREATE VIEW v AS SELECT a FROM T_BAK")]), ["*_bak"])
    assert rows(m.objects, "id") == [("dbo.t",), ("dbo.v",)] and m.dependencies.count() == 0


def test_json_round_trip(spark, shop, tmp_path):
    a, b = tmp_path / "a.json", tmp_path / "b.json"
    sinks.write_model(shop, str(a))
    sinks.write_model(sinks.read_model(spark, str(a)), str(b))
    assert a.read_text() == b.read_text() and "hunter2" not in a.read_text()
    doc = json.loads(a.read_text())
    a.write_text(json.dumps(doc | {"schemaVersion": 99}))
    with pytest.raises(ValueError):
        sinks.read_model(spark, str(a))
    a.write_text(json.dumps({"rootName": "old", "schemaVersion": 0}))
    assert sinks.read_model(spark, str(a)).meta["schema_version"] == M.SCHEMA_VERSION


def test_sarif_and_site(shop, tmp_path):
    doc = sinks.sarif(shop)
    levels = {r["ruleId"]: r["level"] for r in doc["runs"][0]["results"]}
    assert levels["SQL0001"] == "error" and levels["SQL0006"] == "warning" and levels["SQL0020"] == "note" and "hunter2" not in json.dumps(doc)
    assert "crud" in sinks.write_site(shop, str(tmp_path)) and (tmp_path / "files" / "c_sql.html").exists()
    assert "erDiagram" in sinks.er_diagram(shop) and "flowchart" in sinks.dependency_diagram(shop)


def test_drift(spark):
    old = M.build(scripts.units(spark, [("a.sql", "CREATE TABLE T (a INT NULL, b BIGINT NULL, c INT)\nGO\nCREATE TABLE Gone (x INT)")]))
    new = M.build(scripts.units(spark, [("a.sql", "CREATE TABLE T (A INT NOT NULL, b INT NULL, d INT NULL, e INT NOT NULL)\nGO\nCREATE TABLE Fresh (x INT)")]))
    changes = views.drift(old, new)
    assert rows(changes, "kind", "risk") == sorted([("object-dropped", 2), ("object-added", 0), ("column-dropped", 2), ("column-added", 0), ("column-added", 2), ("column-type-narrowed", 2), ("column-not-null-tightened", 2)])
    text = sinks.diff_markdown(changes)
    assert text.index("## Breaking") < text.index("## Safe") and "`column-dropped` **dbo.t.c**" in text


def test_live_catalog(spark):
    df = lambda name, *r: spark.createDataFrame(list(r), live.ROWS[name])
    data = {
        "objects": df("objects", ("dbo", "Parent", "U "), ("dbo", "Child", "U "), ("dbo", "usp_hot", "P ")),
        "columns": df("columns", ("dbo", "Parent", "Id", "int", 4, 10, 0, False, True, 1, None), ("dbo", "Child", "ParentId", "int", 4, 10, 0, False, False, 2, None), ("dbo", "Child", "Name", "nvarchar", 200, 0, 0, True, False, 1, "C")),
        "primary_keys": df("primary_keys", ("dbo", "Parent", "Id", 1)), "foreign_keys": df("foreign_keys", ("dbo", "Child", "dbo", "Parent", "FK_C", "CASCADE", "ParentId", "Id", 1)),
        "modules": df("modules", ("dbo", "usp_hot", "CREATE PROCEDURE dbo.usp_hot AS SELECT Id FROM dbo.Parent")), "proc_stats": df("proc_stats", ("dbo", "usp_hot", 500, 1, 2), ("dbo", "usp_cold", 1, 1, 1)),
        "index_usage": df("index_usage", ("dbo", "Child", "IX_unused", 0, 0, 0, 42)), "backups": df("backups", (datetime(2024, 1, 1),), (datetime(2024, 1, 8),)), "stats_age": df("stats_age", ("dbo", "Child", "s", datetime(2023, 12, 12))),
        "fragmentation": df("fragmentation", ("dbo", "Child", "a", 10.0, 200), ("dbo", "Child", "b", 45.0, 200)), "table_stats": df("table_stats", ("dbo", "Child", 7, 64)),
        "index_columns": df("index_columns", ("dbo", "Child", "IX", False, False, "NONCLUSTERED", False, "Name", 2, False), ("dbo", "Child", "IX", False, False, "NONCLUSTERED", False, "ParentId", 1, False), ("dbo", "Child", "IX", False, False, "NONCLUSTERED", False, "Name", 0, True)),
    }
    m = live.build(data, datetime(2024, 1, 11))
    assert rows(m.objects, "id") == [("dbo.child",), ("dbo.parent",), ("dbo.usp_hot",)]
    child = m.objects.where("id = 'dbo.child'").first()
    assert [c["name"] for c in child["columns"]] == ["Name", "ParentId"] and child["columns"][0]["max_length"] == 200 and child["row_count"] == 7
    assert child["index_details"][0]["key_columns"] == ["ParentId", "Name"] and child["index_details"][0]["included_columns"] == ["Name"]
    assert m.meta["days_since_last_backup"] == 3 and rows(m.stale_statistics, "days_since_update") == [(30,)] and rows(m.fragmented_indexes, "index_name") == [("b",)]
    assert rows(m.index_stats, "is_unused") == [(True,)] and rows(m.edges, "src", "dst", "kind") == [("dbo.child", "dbo.parent", "fk"), ("dbo.child", "dbo.parent", "fk-cascade"), ("dbo.usp_hot", "dbo.parent", "read")]
    assert [r["object_id"] for r in views.activity(m)["hot"].collect()] == ["dbo.usp_hot"]


def test_denied_queries_degrade(spark):
    missing, ok = live.allowed(spark, lambda: spark.sql("select raise_error('error 297: denied') as x"), live.ROWS["backups"])
    assert not ok and missing.count() == 0
    with pytest.raises(Exception, match="else"):
        live.allowed(spark, lambda: spark.sql("select raise_error('something else') as x"), live.ROWS["backups"])


def test_folder_and_cli(spark, tmp_path, capsys):
    src, out = tmp_path / "src", tmp_path / "out"
    (src / "bin").mkdir(parents=True)
    (src / "a.SQL").write_text("﻿" + SHOP)
    (src / "bin" / "b.sql").write_text("CREATE TABLE Hidden (a INT)")
    (src / "n.txt").write_text("no")
    assert rows(scripts.folder(spark, str(src)), "rel_path", "dialect") == [("a.SQL", "tsql")]
    assert cli.main(["scan", str(src), "--out", str(out), "--fail-on", "secrets", "--sarif", str(tmp_path / "s.json")]) == 3
    model = str(out / "model.json")
    assert cli.main(["impact", "Customers", "--model", model]) == 0 and "dbo.orders" in capsys.readouterr().out
    assert cli.main(["impact", "Nothing", "--model", model]) == 2
    assert cli.main(["diff", model, model, "--out", str(tmp_path / "d.md")]) == 0
    assert cli.main(["query", "reachedby: dbo.customers", "--model", model]) == 0 and "dbo.vw" in capsys.readouterr().out
    assert cli.main(["format", str(src), "--check"]) == 3 and cli.main(["format", str(src)]) == 0 and cli.main(["format", str(src), "--check"]) == 0
    assert cli.main(["scan", str(src), "--fail-on", "nothing"]) == 2 and cli.main(["nothing"]) == 2


def test_inferred_relationships(spark):
    t = lambda i, n, *c: {"id": i, "schema": "dbo", "name": n, "kind": "table", "columns": [{"name": x, "data_type": "int", "nullable": False, "is_identity": False, "max_length": 0, "precision": 0, "scale": 0, "collation": ""} for x in c]}
    m = M.with_rows(M.empty_model(spark), spark, objects=[t("dbo.customer", "Customer", "Id", "CustomerId"), t("dbo.orders", "Orders", "CustomerId", "ZoneId"), t("dbo.orderline", "OrderLine", "Order_Id"), t("dbo.zone", "Zone"), t("dbo.zones", "Zones")])
    assert rows(views.relationships(m), "from_id", "to_id", "confidence") == [("dbo.orderline", "dbo.orders", "medium"), ("dbo.orders", "dbo.customer", "high")]
    assert m.objects.where(F.col("id") == "dbo.zone").count() == 1


def test_slugs_that_clash(spark):
    import hashlib

    paths = ["a/b.sql", "a_b.sql", "A-b.sql", "a_b_sql_2", "x/" + "y" * 120 + ".sql"]
    rows = M._with_slugs(spark.createDataFrame([(p,) for p in paths], "rel_path string").withColumn("slug0", S.make_slug(F.col("rel_path")))).collect()
    got = {r["rel_path"]: r["slug"] for r in rows}
    sha = lambda p: hashlib.sha256(p.encode()).hexdigest()[:8]
    assert got["A-b.sql"] == "A_b_sql" and got["a/b.sql"] == "a_b_sql_" + sha("a/b.sql") and got["a_b.sql"] == "a_b_sql_" + sha("a_b.sql")
    assert got["a_b_sql_2"] == "a_b_sql_2" and got[paths[4]].endswith("_" + sha(paths[4])) and len({s.lower() for s in got.values()}) == len(paths)
