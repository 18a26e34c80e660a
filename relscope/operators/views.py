"""What each report shows, as DataFrames over a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relscope.functions import scalars as S
from relscope.operators import graph as G
from relscope.operators import relational as R
from relscope.operators import rules
from relscope.operators.model import Model, dialect_loc

# Thresholds of the activity report.
FRAGMENTED_PERCENT, IMPACT_SCORE, BACKUP_DAYS = 30.0, 10_000.0, 7
# Names that a search for an object suggests.
SUGGESTIONS = 20
# Kinds that the dependency diagram draws.
DRAWN_KINDS = ["read", "insert", "update", "delete", "exec", "fk", "fk-cascade"]


def fan(m: Model) -> DataFrame:
    """(id, fan_in, fan_out) by reference lists: self-references and foreign keys count."""
    pairs = m.objects.select(F.col("id").alias("src"), F.explode("refs").alias("dst"))
    return R.fan_counts(pairs, m.objects).select("id", "fan_in", "fan_out")


def coupling(m: Model) -> DataFrame:
    """(id, fan_in, fan_out, instability) over distinct dependencies without self-edges, most coupled first."""
    deps = m.dependencies.select(F.col("from_object_id").alias("src"), F.col("to_object_id").alias("dst"))
    return R.fan_counts(deps, m.objects, self_edges=False).where("fan_in + fan_out > 0").orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "id")


def nodes(m: Model) -> DataFrame:
    """The graph's nodes: id, schema, path, kind, loc, cog, fan_in, fan_out, execs (-1 where unknown), href."""
    ran = R.in_order(m.object_stats, ["object_id"]).select(F.col("object_id").alias("id"), F.col("execution_count").alias("execs"))
    loc = F.when(F.col("statement_count") > 0, F.col("statement_count")).otherwise(S.count_lines(F.col("body")))
    own = m.objects.select("id", "schema", F.concat_ws(".", "schema", "name").alias("path"), "kind", loc.alias("loc"), F.col("cyclomatic").alias("cog"), F.concat(F.lit("object.html?id="), S.uri_escape(F.col("id"))).alias("href"))
    return own.join(fan(m), "id", "left").join(ran, "id", "left").na.fill(-1, ["execs"])


def overview(m: Model) -> DataFrame:
    """(tile, value)."""
    kinds = m.objects.agg(F.count_if(F.col("kind") == "table").alias("tables"), F.count_if(F.col("kind") == "view").alias("views"), F.count_if(F.col("kind").isin(S.PROGRAMMABLE)).alias("programmables"))
    files = m.files.agg(F.count("*").alias("files"), F.count_if(~F.col("parsed_cleanly")).alias("degraded_files"))
    rest = m.findings.agg(F.count("*").alias("findings")).crossJoin(m.foreign_keys.agg(F.count("*").alias("foreign_keys")))
    row = kinds.crossJoin(files).crossJoin(rest)
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("tile"), F.col(c).alias("value")) for c in row.columns])).alias("t")).select("t.*")


def grade(m: Model) -> str:
    """The overall grade that the overview shows."""
    return rules.STATUS[rules.overall(rules.scorecard(m)).first()["status"]]


def diagnostics(m: Model, k: int = 50) -> DataFrame:
    """The first k diagnostics, as the overview lists them, in the order in which they were made."""
    return m.diagnostics.limit(k)


def dialect_mix(m: Model) -> DataFrame:
    return R.share_of_total(dialect_loc(m.files), "dialect", "loc").orderBy(F.desc("total"), "dialect")


def objects(m: Model) -> DataFrame:
    own = m.objects.join(fan(m), "id").join(m.files.select(F.col("slug").alias("defined_in_slug"), "rel_path", "parsed_cleanly"), "defined_in_slug", "left")
    has_key = F.when(F.col("kind") == "table", F.size("primary_key") > 0)
    return own.select("schema", "name", "kind", has_key.alias("has_primary_key"), F.size("columns").alias("columns"), "fan_in", "fan_out", "purpose", "rel_path", F.coalesce(~F.col("parsed_cleanly"), F.lit(False)).alias("shallow")).orderBy(F.lower("schema"), F.lower("name"), "kind")


def domains(m: Model) -> tuple[DataFrame, DataFrame]:
    deps = m.dependencies.where("to_object_id <> ''").select(F.col("from_object_id").alias("src"), F.col("to_object_id").alias("dst"))
    counts, cross = R.domains(m.objects, deps)
    return counts.orderBy(F.desc("objects"), "domain"), cross.orderBy(F.desc("edges"), "from_domain", "to_domain").limit(100)


def relationships(m: Model) -> DataFrame:
    tables = R.of_kind(m.objects, "table")
    columns = tables.select("id", F.explode("columns").alias("c")).select("id", F.col("c.name").alias("column"))
    declared = m.foreign_keys.select(F.col("from_object_id").alias("from_id"), F.col("to_object_id").alias("to_id"))
    return R.infer_relationships(columns, tables.select("id", "name"), declared).orderBy("from_id", "from_column")


def crud(m: Model) -> tuple[DataFrame, DataFrame]:
    """The matrix with letters in the order C, R, U, D, and the blind spots."""
    shown = m.crud.where("not is_blind_spot").select("target", "actor", S.display_ops(F.col("ops")).alias("ops")).orderBy("target", "actor")
    return shown, m.crud.where("is_blind_spot").select("actor").orderBy("actor")


def impact(m: Model, object_id: str) -> DataFrame:
    """What depends on an object, by depth, then most executed, then id."""
    roots = m.objects.sparkSession.createDataFrame([(object_id,)], "root string")
    ran = m.object_stats.groupBy("object_id").agg(F.max("execution_count").alias("execs"))
    return G.impact(m.edges, roots).join(ran, "object_id", "left").na.fill(-1, ["execs"]).orderBy("depth", F.desc("execs"), "object_id")


def find_object(m: Model, text: str) -> tuple[str | None, list[str]]:
    """The id that text names: as an id, else as the only object of that name; and suggestions where it names none."""
    schema, _, name = text.rpartition(".")
    spark = m.objects.sparkSession
    wanted = spark.range(1).select(S.normalize_id(F.lit(schema), F.lit(name)).alias("w")).first()["w"]
    if not m.objects.where(F.col("id") == wanted).isEmpty():
        return wanted, []
    named = [r["id"] for r in m.objects.where(F.lower("name") == text.lower()).select("id").orderBy("id").limit(SUGGESTIONS).collect()]
    if len(named) == 1:
        return named[0], []
    return None, named or [r["id"] for r in R.search_rows(m.objects, "id", name).select("id").orderBy("id").limit(SUGGESTIONS).collect()]


def lint(m: Model) -> tuple[DataFrame, DataFrame]:
    return rules.by_severity(m.findings).orderBy("severity"), m.findings.orderBy("severity", "rule_id", "object_id", "message")


def most_referenced(m: Model) -> DataFrame:
    return R.top_k(fan(m).select("id", "fan_in"), 15, F.desc("fan_in"), "id")


def most_referencing(m: Model) -> DataFrame:
    return R.top_k(fan(m).select("id", "fan_out"), 15, F.desc("fan_out"), "id")


def most_complex(m: Model) -> DataFrame:
    return R.top_k(R.of_kind(m.objects, *S.PROGRAMMABLE).select("id", "cyclomatic"), 20, F.desc("cyclomatic"), "id")


def metrics(m: Model) -> dict[str, DataFrame]:
    """All parts of the metrics page. The search for cycles runs jobs of its own, so who shows one part asks for that alone."""
    return {"fan_in": most_referenced(m), "fan_out": most_referencing(m), "complex": most_complex(m), "cycles": G.cycles(m.edges), "coupling": coupling(m)}


def activity(m: Model) -> dict[str, DataFrame]:
    stats = m.object_stats.orderBy(F.desc("execution_count"), "object_id")
    unused = m.index_stats.where("is_unused")
    issues = reduce(DataFrame.union, [d.select("object_id") for d in (m.findings.where("object_id <> ''"), m.missing_indexes, unused)])
    return {
        "hot": R.hot_rows(m.object_stats, "execution_count").orderBy(F.desc("execution_count"), "object_id"), "heat": R.heat_buckets(stats, "execution_count"),
        "missing": m.missing_indexes.withColumn("high_impact", F.col("impact_score") >= IMPACT_SCORE).orderBy(F.desc("impact_score"), "object_id"),
        "index_usage": m.index_stats.orderBy("object_id", "index_name"), "concentration": R.concentration(issues).orderBy(F.desc("issues"), "schema"),
        "stale": m.stale_statistics.orderBy(F.desc("days_since_update"), "object_id", "stats_name").limit(100),
        "fragmented": m.fragmented_indexes.where(F.col("fragmentation_percent") >= FRAGMENTED_PERCENT).orderBy(F.desc("fragmentation_percent"), "object_id", "index_name"),
    }


def indexes(m: Model) -> dict[str, DataFrame]:
    static = rules.static_indexes(m)
    unused = R.unused_indexes(static, m.index_stats).join(m.objects.select(F.col("id").alias("object_id"), "schema", F.col("name").alias("table")), "object_id")
    return {
        "heaps": rules.heap_tables(m).select("id", "row_count", "reserved_kb").orderBy(F.desc("row_count"), "id"), "duplicates": R.index_pairs(static).orderBy("object_id", "first", "second"),
        "unused": unused.select("object_id", "name", "user_updates", S.drop_index_text(F.col("object_id"), F.col("name"), F.col("schema"), F.col("table")).alias("drop_text")).orderBy(F.desc("user_updates"), "object_id"),
        "largest": R.top_k(R.of_kind(m.objects, "table").where("row_count > 0").select("id", "row_count", "reserved_kb"), 25, F.desc("row_count"), "id"),
    }


def snapshot(m: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Objects, columns and foreign keys of a model as `diff` takes them."""
    columns = m.objects.select("id", F.explode("columns").alias("c")).select("id", F.col("c.name").alias("column"), F.col("c.data_type").alias("data_type"), F.col("c.nullable").alias("nullable"))
    return m.objects.select("id", "kind"), columns, m.foreign_keys.select(F.col("from_object_id").alias("from_id"), F.col("to_object_id").alias("to_id"), F.col("from_columns").alias("columns"))


def drift(old: Model, new: Model) -> DataFrame:
    o, n = snapshot(old), snapshot(new)
    return R.diff(o[0], n[0], o[1], n[1], o[2], n[2]).orderBy(F.desc("risk"), "target", "kind")


def secrets(m: Model) -> DataFrame:
    return m.files.where("has_credential").select("rel_path", "slug").orderBy("rel_path")


def object_page(m: Model, object_id: str) -> dict[str, DataFrame]:
    own = m.objects.where(F.col("id") == object_id)
    return {
        "columns": own.select("primary_key", F.posexplode("columns").alias("pos", "c")).select("pos", "c.name", "c.data_type", "c.nullable", F.array_contains(S.lowered(F.col("primary_key")), F.lower("c.name")).alias("is_key")).orderBy("pos"),
        "findings": m.findings.where(F.col("object_id") == object_id).orderBy("severity", "rule_id"),
        "out": m.dependencies.where(F.col("from_object_id") == object_id), "in": m.dependencies.where(F.col("to_object_id") == object_id),
    }


def search_index(m: Model) -> DataFrame:
    """(kind, name, detail, href): objects by id, then files by slug."""
    o = m.objects.select(F.lit(0).alias("o"), F.col("id").alias("k"), F.lit("object").alias("kind"), F.concat_ws(".", "schema", "name").alias("name"), F.col("kind").alias("detail"), F.concat(F.lit("files/"), F.col("defined_in_slug"), F.lit(".html")).alias("href"))
    f = m.files.select(F.lit(1).alias("o"), F.col("slug").alias("k"), F.lit("file").alias("kind"), F.col("rel_path").alias("name"), F.lit("file").alias("detail"), F.concat(F.lit("files/"), F.col("slug"), F.lit(".html")).alias("href"))
    return o.union(f).orderBy("o", "k").drop("o", "k")


def palette(m: Model, text: str, k: int = 20) -> DataFrame:
    """The best matches of a search; for empty text the first twelve files."""
    rows = search_index(m)
    if not text:
        return rows.where("kind = 'file'").orderBy("name").limit(12)
    scored = rows.withColumn("score", S.palette_score(F.col("name"), F.col("detail"), text)).where("score > 0")
    return R.top_k(scored, k, F.desc("score"), "name", "href")
