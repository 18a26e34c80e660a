"""Lint rules, scorecard and gates over a model. Each rule is a function from the model to findings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relscope.functions import scalars as S
from relscope.operators import relational as R
from relscope.operators.model import FINDINGS, Model

COMPLEXITY_GATE, WIDE_CHARACTERS = 15, 4000
# Built-ins that can run commands, make COM objects or send mail.
DANGEROUS = ["xp_cmdshell", "sp_oacreate", "sp_oamethod", "sp_oasetproperty", "sp_oagetproperty", "sp_oadestroy", "sp_oageterrorinfo", "sp_send_dbmail"]
SEVERITIES = {0: "Critical", 1: "High", 2: "Medium", 3: "Low"}


@dataclass(frozen=True)
class Guide:
    """What a finding means: what goes wrong on the server, where it does no harm, and a statement that avoids it."""

    title: str
    breaks: str
    fine: str
    example: str


@dataclass(frozen=True)
class Rule:
    id: str
    severity: int
    category: str
    guide: Guide
    check: Callable[[Model], DataFrame]

    @property
    def title(self) -> str:
        return self.guide.title

    @property
    def why(self) -> str:
        """Why the rule is there."""
        return self.guide.breaks

    @property
    def remedy(self) -> str:
        """When a finding can stay, and what to write instead."""
        return f"No harm: {self.guide.fine} Instead: {self.guide.example}"


RULES: list[Rule] = []


def rule(id: str, severity: int, category: str, title: str, breaks: str, fine: str, example: str):
    """Register a check: it returns (object_id, message[, slug, line]); the texts are a Guide's."""

    def add(check: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        RULES.append(Rule(id, severity, category, Guide(title, breaks, fine, example), check))
        return check

    return add


def _say(rows: DataFrame, message: Column, object_id: str = "id") -> DataFrame:
    return rows.select(F.col(object_id).alias("object_id"), message.alias("message"))


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _deps(m: Model, *kinds: str) -> DataFrame:
    return m.dependencies.where(F.col("kind").isin(*kinds))


def _flagged(m: Model, flag: str, message: str) -> DataFrame:
    return _say(R.of_kind(m.objects, *S.PROGRAMMABLE).where(F.col(f"code_flags.{flag}")), _text(F.col("id"), message))


def _columns(m: Model) -> DataFrame:
    return R.of_kind(m.objects, "table").select("id", F.explode("columns").alias("c")).select("id", "c.*")


@rule(
    "SQL0001", 0, "Security", "Login password is readable in a script", "The clear text stays in the file, in its history and in every copy of either.",
    "a deployment step puts the password in place of a marker.", "CREATE LOGIN app FROM WINDOWS;",
)
def credentials(m: Model) -> DataFrame:
    return m.files.where("has_credential").select(F.lit("").alias("object_id"), _text(F.col("rel_path"), " creates a login with its password in the text").alias("message"), "slug", F.lit(0).alias("line"))


@rule(
    "SQL0002", 0, "Security", "Statement text is put together at run time", "A quote inside one of the parts ends the literal, and what follows it is executed.",
    "all parts are constants or go through QUOTENAME.", "EXEC sp_executesql N'SELECT n FROM t WHERE id = @id', N'@id int', @id = @x;",
)
def injection(m: Model) -> DataFrame:
    return _say(_deps(m, "exec-dynamic"), _text(F.col("from_object_id"), " executes a concatenated string"), "from_object_id")


@rule(
    "SQL0003", 1, "Schema", "Nothing identifies the table's rows", "Duplicates go in unnoticed; replication, change tracking and foreign keys can't use the table.",
    "a staging table that every load empties.", "ALTER TABLE t ADD CONSTRAINT PK_t PRIMARY KEY (id);",
)
def missing_primary_key(m: Model) -> DataFrame:
    return _say(R.of_kind(m.objects, "table").where(F.size("primary_key") == 0), _text(F.col("id"), " has no primary key"))


@rule(
    "SQL0004", 1, "Correctness", "Change without a row condition", "All rows are logged and locked, and the locks are likely to escalate to the table.",
    "the table holds one batch and is to be cleared.", "DELETE FROM t WHERE batch_id = @batch;",
)
def unfiltered_change(m: Model) -> DataFrame:
    what = F.when(F.col("kind") == "update-nowhere", "updates").otherwise("deletes")
    return _say(_deps(m, "update-nowhere", "delete-nowhere"), _text(F.col("from_object_id"), " ", what, " without WHERE"), "from_object_id")


@rule(
    "SQL0005", 2, "Maintainability", "Column list left to the table", "A view keeps the columns of its creation until sp_refreshview; INSERT ... EXEC fails once one is added.",
    "the star stands in EXISTS, which reads no column.", "SELECT id, name FROM t;",
)
def select_star(m: Model) -> DataFrame:
    return _say(_deps(m, "select-star"), _text(F.col("from_object_id"), " selects *"), "from_object_id")


@rule(
    "SQL0006", 2, "Schema", "Child rows may lack a parent", "A null isn't checked against the referenced table, so inner joins silently lose the row.",
    "the relation is optional.", "ALTER TABLE child ALTER COLUMN parent_id int NOT NULL;",
)
def nullable_fk(m: Model) -> DataFrame:
    keys = m.foreign_keys.select(F.col("from_object_id").alias("fk_id"), F.explode("from_columns").alias("fk_column"))
    hit = keys.join(_columns(m).where("nullable"), (F.col("fk_id") == F.col("id")) & (F.lower("fk_column") == F.lower("name")))
    return hit.select(F.col("id").alias("object_id"), _text(F.col("id"), ".", F.col("name"), " is a nullable foreign key").alias("message"), F.lit(0).alias("line"))


@rule(
    "SQL0007", 2, "Performance", "Foreign key without a supporting index", "The server makes no index for the key; deleting one parent reads the whole referencing table under locks.",
    "the referencing table stays within a few pages.", "CREATE INDEX IX_child_parent ON child (parent_id);",
)
def uncovered_fk(m: Model) -> DataFrame:
    tables = R.covered_columns(m.objects)
    joined = m.foreign_keys.join(tables, F.col("from_object_id") == F.col("id"))
    return _say(joined.where(F.size(F.array_except(S.lowered(F.col("from_columns")), "covered")) > 0), _text(F.col("id"), " has no index on foreign key column(s) ", F.array_join("from_columns", ", ")))


@rule(
    "SQL0008", 2, "Maintainability", "Many branches in one module", "The plan is compiled for all branches with the first call's parameters, also for those that didn't run.",
    "branches only pass the call on to other procedures.", "IF @full = 1 EXEC load_all; ELSE EXEC load_new;",
)
def complexity(m: Model) -> DataFrame:
    return _say(R.of_kind(m.objects, *S.PROGRAMMABLE).where(F.col("cyclomatic") >= COMPLEXITY_GATE), _text(F.col("id"), " has complexity ", F.col("cyclomatic").cast("string")))


@rule(
    "SQL0009", 3, "Convention", "Name that needs delimiters", "It isn't a regular identifier, so each use without brackets fails to parse.",
    "a product that can't be changed reads the name.", "EXEC sp_rename 'dbo.[2nd list]', 'second_list';",
)
def naming(m: Model) -> DataFrame:
    return _say(m.objects.where(S.bad_name(F.col("name"))), _text(F.col("id"), " has a space or begins with a digit"))


def dead_objects(m: Model) -> DataFrame:
    """Programmables that nothing references and that never ran."""
    called = m.objects.select(F.explode("refs").alias("id")).distinct()
    ran = m.object_stats.where("execution_count > 0").select(F.col("object_id").alias("id")).distinct()
    return R.of_kind(m.objects, *S.PROGRAMMABLE).join(called, "id", "left_anti").join(ran, "id", "left_anti")


@rule(
    "SQL0010", 3, "Maintainability", "Not called by any scanned script", "It has to follow every change of the tables that it names, for nobody.",
    "a job, a report or an application calls it.", "SELECT last_execution_time FROM sys.dm_exec_procedure_stats WHERE object_id = OBJECT_ID('dbo.p');",
)
def dead(m: Model) -> DataFrame:
    return _say(dead_objects(m), _text(F.col("id"), " is referenced by nothing in this scan"))


@rule(
    "SQL0011", 0, "Security", "Reaches out of the database engine", "Shell commands and automation objects run as processes of the service account.",
    "only administrators may execute the module.", "EXEC msdb.dbo.sp_start_job N'nightly export';",
)
def dangerous(m: Model) -> DataFrame:
    target = F.lower(F.when(F.col("external_target") != "", F.col("external_target")).otherwise(F.col("to_object_id")))
    command = F.coalesce(*[F.when(F.contains(target, F.lit(c)), c) for c in DANGEROUS])
    hit = m.dependencies.withColumn("command", command).where("command is not null").select("from_object_id", "command").distinct()
    return _say(hit, _text(F.col("from_object_id"), " calls ", F.col("command")), "from_object_id")


@rule(
    "SQL0012", 2, "Schema", "Column of the old large-object family", "Its values can't be compared, sorted or held in a variable.",
    "a driver of an old release reads the table.", "ALTER TABLE t ALTER COLUMN note varchar(max);",
)
def deprecated_type(m: Model) -> DataFrame:
    return _say(_columns(m).where(S.base_type(F.col("data_type")).isin(S.DEPRECATED_TYPES)), _text(F.col("id"), ".", F.col("name"), " is ", S.base_type(F.col("data_type"))))


def heap_tables(m: Model) -> DataFrame:
    """Tables with columns and without a clustered index; none if no object of the model has index details."""
    known = m.objects.where(F.size("index_details") > 0).limit(1).select(F.lit(True).alias("__known"))
    heaps = R.of_kind(m.objects, "table").where((F.size("columns") > 0) & ~F.exists("index_details", lambda i: i["is_clustered"]))
    return heaps.crossJoin(F.broadcast(known)).drop("__known")


@rule(
    "SQL0013", 2, "Performance", "Table stored as a heap", "A row that grows leaves a forwarding pointer behind, and every scan follows it with another read.",
    "the table is appended to and read as a whole.", "CREATE CLUSTERED INDEX CX_t ON t (id);",
)
def heaps(m: Model) -> DataFrame:
    return _say(heap_tables(m), _text(F.col("id"), " has no clustered index"))


def static_indexes(m: Model) -> DataFrame:
    return m.objects.select(F.col("id").alias("object_id"), F.explode("index_details").alias("i")).select("object_id", "i.*")


@rule(
    "SQL0014", 2, "Performance", "Two indexes with the same leading columns", "Each insert writes both and both take buffer pages, while a seek uses one.",
    "the shorter one is unique and enforces a rule.", "DROP INDEX IX_short ON t;",
)
def duplicate_indexes(m: Model) -> DataFrame:
    return _say(R.index_pairs(static_indexes(m)), _text(F.col("first"), " and ", F.col("second"), " on ", F.col("object_id"), " overlap (", F.col("relation"), ")"), "object_id")


@rule(
    "SQL0015", 3, "Schema", "Very wide or open-ended column", "Sorts ask for memory by the declared width, and an index key ends at 1,700 bytes.",
    "documents have no natural length.", "ALTER TABLE t ALTER COLUMN code varchar(40);",
)
def wide_columns(m: Model) -> DataFrame:
    width = S.character_width(F.col("data_type"), F.col("max_length"))
    rows = _columns(m).where(S.base_type(F.col("data_type")).isin(S.LENGTH_TYPES) & (F.col("max_length") != 0)).withColumn("w", width).where((F.col("w") == -1) | (F.col("w") > WIDE_CHARACTERS))
    return _say(rows, _text(F.col("id"), ".", F.col("name"), F.when(F.col("w") == -1, " is (max)").otherwise(F.concat(F.lit(" is "), F.col("w").cast("string"), F.lit(" characters wide")))))


@rule(
    "SQL0016", 3, "Performance", "Index that is written but not read", "Its pages are changed, logged and backed up with every write.",
    "counters were reset lately, or a yearly run needs it.", "ALTER INDEX IX_x ON t DISABLE;",
)
def unused(m: Model) -> DataFrame:
    rows = R.unused_indexes(static_indexes(m), m.index_stats)
    return _say(rows if m.meta.get("runtime_available") else rows.limit(0), _text(F.col("name"), " on ", F.col("object_id"), " is written but never read"), "object_id")


@rule(
    "SQL0017", 2, "Correctness", "Uncommitted rows are read", "A scan can miss rows or return them twice while pages split.",
    "a monitor wants a rough count.", "ALTER DATABASE d SET READ_COMMITTED_SNAPSHOT ON;",
)
def nolock(m: Model) -> DataFrame:
    return _flagged(m, "uses_nolock", " reads uncommitted rows")


@rule(
    "SQL0018", 3, "Maintainability", "Loop over single rows", "Every FETCH is a statement with locks and a call of its own.",
    "a procedure has to be called for each row.", "UPDATE t SET n = s.n FROM t JOIN s ON s.id = t.id;",
)
def cursors(m: Model) -> DataFrame:
    return _flagged(m, "uses_cursor", " uses a cursor")


@rule(
    "SQL0019", 3, "Correctness", "Last identity of the session, not of the insert", "A trigger that inserts elsewhere changes the value that comes back.",
    "no table of the session has a trigger.", "INSERT INTO t (a) OUTPUT inserted.id VALUES (1);",
)
def at_at_identity(m: Model) -> DataFrame:
    return _flagged(m, "uses_at_at_identity", " uses @@IDENTITY")


@rule(
    "SQL0020", 3, "Maintainability", "Row counts are sent for every statement", "One message a statement goes over the network; a loop sends thousands.",
    "the client uses the counts.", "SET NOCOUNT ON;",
)
def nocount(m: Model) -> DataFrame:
    return _say(R.of_kind(m.objects, "procedure").where("code_flags.scanned and not code_flags.has_set_nocount"), _text(F.col("id"), " doesn't SET NOCOUNT ON"))


@rule(
    "SQL0021", 1, "Security", "Runs as another principal", "Permissions are checked for that principal, so callers reach whatever it can.",
    "the principal has no login and only the rights that the module needs.", "ADD SIGNATURE TO dbo.p BY CERTIFICATE c;",
)
def execute_as(m: Model) -> DataFrame:
    return _flagged(m, "uses_execute_as", " runs under another identity")


def run(m: Model, only: list[str] | None = None) -> DataFrame:
    """Findings of all rules (or of the named ones), with where the object is defined."""
    place = m.objects.select(F.col("id").alias("object_id"), F.col("defined_in_slug").alias("at_slug"), F.col("defined_at_line").alias("at_line"))
    found = []
    for r in RULES:
        if only is None or r.id in only:
            rows = r.check(m)
            slug = F.col("slug") if "slug" in rows.columns else F.lit(None).cast("string")
            line = F.col("line") if "line" in rows.columns else F.lit(None).cast("int")
            found.append(rows.select(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.title).alias("title"), "message", "object_id", slug.alias("slug"), line.alias("line")))
    both = reduce(DataFrame.union, found).join(place, "object_id", "left")
    full = both.withColumn("slug", F.coalesce("slug", "at_slug", F.lit(""))).withColumn("line", F.coalesce("line", "at_line", F.lit(0)).cast("int"))
    return full.select(*[c.split()[0] for c in FINDINGS.split(", ")])


def linted(m: Model) -> Model:
    return replace(m, findings=run(m))


def by_severity(findings: DataFrame) -> DataFrame:
    """(severity, findings): the four bands, 0 where there is none."""
    bands = findings.sparkSession.createDataFrame([(k,) for k in SEVERITIES], "severity int")
    return bands.join(findings.groupBy("severity").agg(F.count("*").alias("findings")), "severity", "left").na.fill(0, ["findings"])


# ---- scorecard ----------------------------------------------------------------------------------------------------

OK, WATCH, FAIL, NA = 0, 1, 2, None
STATUS = {0: "Ok", 1: "Watch", 2: "Fail", None: "NA"}


def _status(bad: Column, n: Column, watch: Column) -> Column:
    return F.when(n == 0, F.lit(None)).when(bad == 0, OK).when(bad <= watch, WATCH).otherwise(FAIL).cast("int")


def scorecard(m: Model) -> DataFrame:
    """(metric, value, status, status_name), six rows; status is null where there is nothing to measure."""
    tables = R.of_kind(m.objects, "table").agg(F.count("*").alias("n"), F.count_if(F.size("primary_key") == 0).alias("bad"))
    ratio = F.when(F.col("n") == 0, "n/a").otherwise(F.concat(F.col("bad").cast("string"), F.lit("/"), F.col("n").cast("string")))
    row = lambda d, metric, value, status: d.select(F.lit(metric).alias("metric"), value.alias("value"), status.cast("int").alias("status"))
    keys = m.foreign_keys.agg(F.count("*").alias("n")).crossJoin(m.findings.where("rule_id = 'SQL0007'").agg(F.count("*").alias("bad")))
    secrets = m.files.agg(F.count_if("has_credential").alias("bad"))
    dynamic = m.dependencies.agg(F.count_if(F.col("kind") == "exec-dynamic").alias("bad"))
    procs = R.of_kind(m.objects, *S.PROGRAMMABLE).agg(F.count("*").alias("n"), F.avg("cyclomatic").alias("avg"))
    gone = R.of_kind(m.objects, *S.PROGRAMMABLE).agg(F.count("*").alias("n")).crossJoin(dead_objects(m).agg(F.count("*").alias("bad")))
    share = F.col("bad") / F.col("n")
    rows = [
        row(tables, "Tables without a primary key", ratio, _status(F.col("bad"), F.col("n"), F.expr("n div 10 + 1"))),
        row(keys, "FK columns without a covering index", ratio, _status(F.col("bad"), F.col("n"), F.expr("n div 4 + 1"))),
        row(secrets, "Credentials in DDL", F.col("bad").cast("string"), F.when(F.col("bad") == 0, OK).otherwise(FAIL)),
        row(dynamic, "Injection-risk dynamic SQL", F.col("bad").cast("string"), F.when(F.col("bad") == 0, OK).otherwise(FAIL)),
        row(procs, "Average procedure complexity", F.when(F.col("n") == 0, "n/a").otherwise(S.one_decimal(F.col("avg"))), F.when(F.col("n") == 0, F.lit(None)).when(F.col("avg") <= 5, OK).when(F.col("avg") <= 10, WATCH).otherwise(FAIL)),
        row(gone, "Dead / unreferenced objects", ratio, F.when(F.col("n") == 0, F.lit(None)).when(share <= 0.10, OK).when(share <= 0.30, WATCH).otherwise(FAIL)),
    ]
    name = F.when(F.col("status") == 0, "Ok").when(F.col("status") == 1, "Watch").when(F.col("status") == 2, "Fail").otherwise("NA")
    return reduce(DataFrame.union, rows).withColumn("status_name", name)


def overall(card: DataFrame) -> DataFrame:
    """One row: the worst status that was measured, Ok if none was."""
    return card.agg(F.coalesce(F.max("status"), F.lit(OK)).alias("status"))


# Gates and the scorecard metric each looks at. "complexity" names a metric that the scorecard doesn't have,
# as it always did: unless strict is off it can't trip.
GATES = {"secrets": "Credentials in DDL", "injection": "Injection-risk dynamic SQL", "no-pk": "Tables without a primary key", "complexity": "Procedure complexity"}
GATE_NAMES = [*GATES, "scorecard"]


def tripped(card: DataFrame, gates: list[str], strict: bool = True) -> list[str]:
    """Names of the gates whose metric fails; unknown names are left aside. strict=False repairs the complexity gate."""
    metric = dict(GATES) if strict else GATES | {"complexity": "Average procedure complexity"}
    failed = {r["metric"] for r in card.where(F.col("status") == FAIL).select("metric").collect()}  # six rows at most
    return [g for g in gates if g == "scorecard" and failed or metric.get(g) in failed]
