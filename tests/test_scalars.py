import pytest
from pyspark.sql import functions as F

from relscope.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("schema", "name", "dialect", "want"), [("[dbo]", "[Orders]", "tsql", "dbo.orders"), ("dbo", "ORDERS", "tsql", "dbo.orders"), ("", "Orders", "tsql", "dbo.orders"), ("", "Accounts", "postgres", "public.accounts")])
def test_normalize_id(spark, schema, name, dialect, want):
    assert one(spark, S.normalize_id(F.lit(schema), F.lit(name), F.lit(dialect))) == want


@pytest.mark.parametrize(("text", "want"), [("CREATE TABLE `p` (id INT AUTO_INCREMENT) ENGINE=InnoDB", "mysql"), ("id SERIAL; AS $$ BEGIN END $$", "postgres"), ("SELECT * FROM [dbo].[T]\nGO\n", "tsql"), ("nothing", "tsql")])
def test_dialect(spark, text, want):
    assert one(spark, S.detect_dialect(F.lit(text))) == want


@pytest.mark.parametrize(("text", "pattern", "want"), [("usp_Foo_BAK", "*_bak", True), ("usp_Foo", "*_bak", False), ("tmp_Widgets", "tmp_*", True), ("abc", "a?c", True), ("abbc", "a?c", False), ("", "*", True), ("a.c", "a.c", True), ("abc", "a.c", False)])
def test_glob(spark, text, pattern, want):
    assert one(spark, S.glob_match(F.lit(text), pattern)) is want


@pytest.mark.parametrize(("kind", "length", "p", "s", "want"), [("nvarchar", 200, 0, 0, "nvarchar(100)"), ("nvarchar", -1, 0, 0, "nvarchar(max)"), ("varchar", 50, 0, 0, "varchar(50)"), ("decimal", 9, 18, 2, "decimal(18,2)"), ("datetime", 8, 0, 0, "datetime")])
def test_type_text(spark, kind, length, p, s, want):
    assert one(spark, S.type_text(F.lit(kind), F.lit(length), F.lit(p), F.lit(s))) == want


@pytest.mark.parametrize(("old", "new", "want"), [("int", "INT", "Same"), ("numeric", "decimal", "Same"), ("int", "bigint", "Compatible"), ("nvarchar", "varchar", "Narrowing"), ("bigint", "int", "Narrowing"), ("int", "varchar", "Incompatible")])
def test_compare_types(spark, old, new, want):
    assert one(spark, S.compare_types(F.lit(old), F.lit(new))) == want


@pytest.mark.parametrize(("name", "want"), [("Shop_CartItem_X", "Shop"), ("Int_Process_Y", "Int"), ("NoUnderscore", "NoUnderscore"), ("_", "(ungrouped)")])
def test_domain(spark, name, want):
    assert one(spark, S.domain_of(F.lit(name))) == want


@pytest.mark.parametrize(("name", "want"), [("Orders", "order"), ("Categories", "category"), ("Boxes", "box"), ("Class", "class"), ("Branches", "branch")])
def test_singular(spark, name, want):
    assert one(spark, S.canonical_singular(F.lit(name))) == want


@pytest.mark.parametrize(("source", "flag", "want"), [
    ("SELECT 1 FROM t WITH (NOLOCK)", "uses_nolock", True), ("SET TRANSACTION ISOLATION LEVEL READ UNCOMMITTED", "uses_nolock", True), ("SELECT NolockedValue", "uses_nolock", False), ("DECLARE c CURSOR FOR", "uses_cursor", True),
    ("SELECT @@IDENTITY", "uses_at_at_identity", True), ("SET NOCOUNT ON", "has_set_nocount", True), ("WITH EXECUTE AS OWNER", "uses_execute_as", True), ("-- EXECUTE AS x\nSELECT 'EXECUTE AS y'", "uses_execute_as", False),
])
def test_code_flags(spark, source, flag, want):
    assert one(spark, S.code_flags(F.lit(source)))[flag] is want


def test_cyclomatic_counts_substrings(spark):
    assert one(spark, S.cyclomatic(F.lit("IF a WHILE b CASE c BEGIN CATCH END IF(x)"))) == 5


def test_redact(spark):
    assert one(spark, S.redact(F.lit("Server=a;Database=b;PWD=c;x"))) == "Server=<redacted>;Database=b;PWD=<redacted>;x"


def test_lines(spark):
    assert [one(spark, S.count_lines(F.lit(t))) for t in ("", "a", "a\n", "a\nb")] == [0, 1, 1, 2]


def test_long_slug(spark):
    slug = one(spark, S.make_slug(F.lit("a/" * 80)))
    assert len(slug) == 100 and slug[91] == "_"
