"""The catalog model: one DataFrame for each kind of row, and the steps from parsed scripts to a resolved model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relscope.functions import scalars as S
from relscope.operators import relational as R
from relscope.operators import search
from relscope.operators.lineage import cut
from relscope.sources import tsql

SCHEMA_VERSION = 6
#: Scripts above this many bytes are counted, not parsed.
PARSE_LIMIT = 1 << 20
#: More patterns than these are joined with the names; fewer are one condition a row.
MANY_PATTERNS = 20

COLUMN = "struct<name:string,data_type:string,nullable:boolean,is_identity:boolean,max_length:int,precision:int,scale:int,collation:string>"
INDEX = "struct<name:string,key_columns:array<string>,included_columns:array<string>,is_unique:boolean,is_primary_key:boolean,is_clustered:boolean,is_disabled:boolean>"
FLAGS = "struct<uses_nolock:boolean,uses_cursor:boolean,uses_at_at_identity:boolean,has_set_nocount:boolean,uses_execute_as:boolean,scanned:boolean>"
FILES = "rel_path string, slug string, dialect string, size_bytes long, loc int, statement_count int, parsed_cleanly boolean, object_ids array<string>, has_credential boolean, purpose string"
OBJECTS = (
    "id string, schema string, name string, kind string, dialect string, defined_in_slug string, defined_at_line int, "
    f"columns array<{COLUMN}>, primary_key array<string>, indexes array<string>, refs array<string>, cyclomatic int, statement_count int, body string, "
    f"index_details array<{INDEX}>, row_count long, reserved_kb long, code_flags {FLAGS}, purpose string"
)
FOREIGN_KEYS = "from_object_id string, to_object_id string, from_columns array<string>, to_columns array<string>, name string, on_delete string"
DEPENDENCIES = "from_object_id string, to_object_id string, external_target string, kind string"
CRUD = "target string, actor string, ops string, is_blind_spot boolean"
FINDINGS = "rule_id string, severity int, title string, message string, object_id string, slug string, line int"
OBJECT_STATS = "object_id string, execution_count long, total_worker_time_ms long, total_logical_reads long"
INDEX_STATS = "object_id string, index_name string, user_seeks long, user_scans long, user_lookups long, user_updates long, is_unused boolean"
MISSING_INDEXES = "object_id string, equality_columns string, inequality_columns string, included_columns string, impact_score double"
STALE = "object_id string, stats_name string, days_since_update int"
FRAGMENTED = "object_id string, index_name string, fragmentation_percent double, page_count long"

_PARSED_OBJECT = "struct<id:string,schema:string,name:string,kind:string,dialect:string,defined_at_line:int,columns:array<struct<name:string,data_type:string,nullable:boolean,is_identity:boolean>>,primary_key:array<string>,indexes:array<string>,source:string,body:string>"
FACTS = (
    f"rel_path string, objects array<{_PARSED_OBJECT}>, foreign_keys array<struct<from_object_id:string,to_object_id:string,from_columns:array<string>,to_columns:array<string>,name:string,on_delete:string>>, "
    "dependencies array<struct<from_object_id:string,to_object_id:string,external_target:string,kind:string>>, diagnostics array<string>, statement_count int, parsed_cleanly boolean, has_credential boolean"
)


@dataclass(frozen=True)
class Model:
    """DataFrames of a model. meta has root_name, source_path, dialect, schema_version, runtime and maintenance notes."""

    meta: dict
    files: DataFrame
    objects: DataFrame
    foreign_keys: DataFrame
    dependencies: DataFrame
    crud: DataFrame
    findings: DataFrame
    diagnostics: DataFrame
    object_stats: DataFrame
    index_stats: DataFrame
    missing_indexes: DataFrame
    stale_statistics: DataFrame
    fragmented_indexes: DataFrame

    @property
    def edges(self) -> DataFrame:
        """Resolved dependencies and foreign keys, each (src, dst, kind) once."""
        return R.distinct_edges(self.dependencies, self.foreign_keys)


TABLES = {
    "files": FILES, "objects": OBJECTS, "foreign_keys": FOREIGN_KEYS, "dependencies": DEPENDENCIES, "crud": CRUD, "findings": FINDINGS, "diagnostics": "message string",
    "object_stats": OBJECT_STATS, "index_stats": INDEX_STATS, "missing_indexes": MISSING_INDEXES, "stale_statistics": STALE, "fragmented_indexes": FRAGMENTED,
}


def empty_model(spark: SparkSession, **meta) -> Model:
    return Model({"root_name": "project", "source_path": "", "dialect": "unknown", "schema_version": SCHEMA_VERSION, "runtime_available": False, "days_since_last_backup": None} | meta, **{k: spark.createDataFrame([], s) for k, s in TABLES.items()})


def with_rows(model: Model, spark: SparkSession, **rows: Sequence[dict]) -> Model:
    """model with tables built of dicts; missing fields take the model's empty values."""
    import re

    out = {}
    for name, given in rows.items():
        schema = spark.createDataFrame([], TABLES[name]).schema
        blank = {f.name: "" if f.dataType.simpleString() == "string" else [] if f.dataType.simpleString().startswith("array") else False if f.dataType.simpleString() == "boolean" else None if re.match("struct", f.dataType.simpleString()) else 0 for f in schema}
        if "nullable" in blank:
            blank["nullable"] = True
        out[name] = spark.createDataFrame([tuple((blank | r)[f.name] for f in schema) for r in given], schema)
    return replace(model, **out)


#: Analysers by dialect: (path, text) to tsql.Facts; they must not raise. Register another to parse another dialect.
ANALYZERS: dict[str, Callable[[str, str], tsql.Facts]] = {"tsql": tsql.analyze}


def parse_scripts(units: DataFrame) -> DataFrame:
    """units (rel_path, content, dialect) with the facts of each script; large and foreign scripts are only counted."""
    analyzers = dict(ANALYZERS)
    schema = units.sparkSession.createDataFrame([], FACTS).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content, dialect in zip(pdf["rel_path"], pdf["content"], pdf["dialect"], strict=True):
                size = len((content or "").encode())
                if size > PARSE_LIMIT:
                    f = tsql.Facts(diagnostics=[f"{path}: {size / (1 << 20):.1f} MB exceeds the limit; counted but not parsed"], parsed_cleanly=False)
                elif dialect not in analyzers:
                    f = tsql.Facts(diagnostics=[f"{path}: {dialect} is recorded but not parsed"], parsed_cleanly=False)
                else:
                    f = analyzers[dialect](path, content or "")
                rows.append((path, f.objects, f.foreign_keys, f.dependencies, f.diagnostics, f.statement_count, f.parsed_cleanly, f.has_credential))
            yield pd.DataFrame(rows, columns=schema.names)

    return units.select("rel_path", "content", "dialect").mapInPandas(run, schema)


def build(units: DataFrame, exclude: Sequence[str] = (), root_name: str = "project", source_path: str = "", problems: DataFrame | None = None) -> Model:
    """The resolved model of scripts (rel_path, content, dialect), without runtime counters and findings.

    problems (message) are what the source couldn't read; they come first among the diagnostics.
    """
    spark = units.sparkSession
    facts = cut(parse_scripts(units))
    size = S.utf8_bytes(F.col("content"))
    sized = units.select("rel_path", "dialect", size.alias("size_bytes"), F.when(size > PARSE_LIMIT, S.estimated_lines(size)).otherwise(S.count_lines(F.col("content"))).alias("loc"))
    base = sized.join(facts, "rel_path").withColumn("slug0", S.make_slug(F.col("rel_path")))
    files = _with_slugs(base)
    files = cut(files.select("rel_path", "slug", "dialect", "size_bytes", "loc", "statement_count", "parsed_cleanly", F.transform("objects", lambda o: o["id"]).alias("object_ids"), "has_credential", "objects", "foreign_keys", "dependencies", "diagnostics"))

    found = files.select("rel_path", "slug", F.posexplode("objects").alias("pos", "o"))
    raw = found.select("rel_path", "pos", "slug", "o.*")
    fks = files.select(F.explode("foreign_keys").alias("f")).select("f.*")
    deps = files.select(F.explode("dependencies").alias("d")).select("d.*")
    notes = files.select("rel_path", F.explode("diagnostics").alias("message")).orderBy("rel_path").select("message")
    notes = notes if problems is None else problems.union(notes)
    if exclude:
        many = spark.createDataFrame([(p,) for p in exclude], "pattern string") if len(exclude) > MANY_PATTERNS else None
        gone = R.excluded(raw, exclude) if many is None else cut(search.excluded_by(raw, many))
        fks = R.not_touching(fks, gone, ["from_object_id", "to_object_id"])
        deps = R.not_touching(deps, gone, ["from_object_id", "to_object_id"])
        raw = R.exclude(raw, exclude) if many is None else R.except_rows(raw, gone, ["id"])
        notes = notes.union(gone.agg(F.count("*").alias("n")).select(F.concat(F.lit("excluded objects: "), F.col("n").cast("string"))))
    notes = notes.union(R.dropped_duplicates(raw, ["id"], ["rel_path", "pos"]).select(F.concat(F.lit("duplicate object "), F.col("id"), F.lit(" in "), F.col("rel_path"), F.lit("; the first one is kept"))))
    raw = cut(R.keep_first(raw, ["id"], ["rel_path", "pos"]))

    deps, fks = cut(R.resolve(deps, raw)), cut(R.resolve(fks, raw, external=None))
    refs = R.references(R.distinct_edges(deps, fks))
    scanned = F.col("source") != ""
    wide = lambda c: F.struct(c["name"].alias("name"), c["data_type"].alias("data_type"), c["nullable"].alias("nullable"), c["is_identity"].alias("is_identity"), F.lit(0).alias("max_length"), F.lit(0).alias("precision"), F.lit(0).alias("scale"), F.lit("").alias("collation"))
    objects = raw.join(refs.select(F.col("id").alias("ref_id"), "refs"), F.col("id") == F.col("ref_id"), "left").select(
        "id", "schema", "name", "kind", "dialect", F.col("slug").alias("defined_in_slug"), "defined_at_line", F.transform("columns", wide).alias("columns"), "primary_key", "indexes",
        F.coalesce("refs", F.array().cast("array<string>")).alias("refs"), F.when(scanned, S.cyclomatic(F.col("source"))).otherwise(1).alias("cyclomatic"), F.lit(0).alias("statement_count"), "body",
        F.array().cast(f"array<{INDEX}>").alias("index_details"), F.lit(0).cast("long").alias("row_count"), F.lit(0).cast("long").alias("reserved_kb"),
        F.when(scanned, S.code_flags(F.col("source"))).alias("code_flags"), S.object_purpose(F.col("name"), F.col("kind")).alias("purpose"),
    )
    objects = cut(objects)
    purposes = R.file_purposes(objects)
    none = F.when(F.col("parsed_cleanly"), "No schema objects found in this file.").otherwise("Could not be parsed; see Diagnostics.")
    files = files.join(purposes, "slug", "left").select(*[F.coalesce("purpose", none).alias("purpose") if c == "purpose" else F.col(c) for c in spark.createDataFrame([], FILES).columns])
    dialect = R.overall_dialect(files).first()["dialect"]
    model = empty_model(spark, root_name=root_name, source_path=source_path, dialect=dialect)
    return replace(model, files=files, objects=objects, foreign_keys=fks, dependencies=deps, crud=R.crud_matrix(deps), diagnostics=notes)


def _with_slugs(files: DataFrame) -> DataFrame:
    """files (rel_path, slug0, ...) with `slug`, unique without case.

    The first path of a slug keeps it, the others take digits of their path's hash; only what clashes then is numbered.
    """
    hashed = F.concat(F.substring("slug0", 1, 91), F.lit("_"), F.substring(F.sha2("rel_path", 256), 1, 8))
    own = F.row_number().over(Window.partitionBy(F.lower("slug0")).orderBy("rel_path"))
    once = files.withColumn("__own", own).withColumn("slug1", F.when(F.col("__own") == 1, F.col("slug0")).otherwise(hashed))
    again = F.row_number().over(Window.partitionBy(F.lower("slug1")).orderBy(F.col("__own") > 1, "rel_path"))
    numbered = once.withColumn("__again", again)
    return numbered.withColumn("slug", F.when(F.col("__again") == 1, F.col("slug1")).otherwise(F.concat("slug1", F.lit("_"), F.col("__again").cast("string")))).drop("__own", "__again", "slug1")


def dialect_loc(files: DataFrame) -> DataFrame:
    return files.where("loc > 0").groupBy("dialect").agg(F.sum("loc").alias("loc"))


def with_catalog_detail(model: Model, columns: DataFrame, indexes: DataFrame, table_stats: DataFrame) -> Model:
    """Widths and collations of columns (by id and name without case), index definitions and sizes of the live catalog."""
    cols = columns.select(S.normalize_id(F.col("schema"), F.col("table")).alias("id"), F.lower("column").alias("c"), F.col("max_length").alias("l"), F.col("precision").cast("int").alias("p"), F.col("scale").cast("int").alias("s"), F.coalesce("collation", F.lit("")).alias("co"))
    own = model.objects.select("id", F.posexplode("columns").alias("pos", "x")).withColumn("c", F.lower("x.name")).join(R.keep_first(cols, ["id", "c"], ["l"]), ["id", "c"], "left")
    merged = own.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct(
        F.col("x.name").alias("name"), F.col("x.data_type").alias("data_type"), F.col("x.nullable").alias("nullable"), F.col("x.is_identity").alias("is_identity"),
        F.coalesce("l", "x.max_length").alias("max_length"), F.coalesce("p", "x.precision").alias("precision"), F.coalesce("s", "x.scale").alias("scale"), F.coalesce("co", "x.collation").alias("collation"),
    ).alias("v")))), lambda x: x["v"]).alias("new_columns"))
    inventory = R.index_inventory(indexes)
    details = inventory.groupBy(F.col("object_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(*[c for c in inventory.columns if c != "object_id"]))).alias("new_details"))
    sizes = table_stats.groupBy(S.normalize_id(F.col("schema"), F.col("table")).alias("id")).agg(F.max("row_count").alias("rows"), F.max("reserved_kb").alias("kb"))
    wide = model.objects.join(merged, "id", "left").join(details, "id", "left").join(sizes, "id", "left")
    changed = {"columns": F.coalesce("new_columns", "columns"), "index_details": F.coalesce("new_details", "index_details"), "row_count": F.coalesce("rows", "row_count"), "reserved_kb": F.coalesce("kb", "reserved_kb")}
    return replace(model, objects=wide.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in model.objects.columns]))


def with_runtime(model: Model, runtime: dict[str, DataFrame], available: bool, days_since_last_backup: int | None = None, excluded: bool = False) -> Model:
    """model with runtime counters; where patterns were excluded, counters of ids that the model lacks go."""
    got = {k: v for k, v in runtime.items() if k in TABLES}
    if excluded:
        got = {k: R.surviving(v, model.objects) if k in ("object_stats", "index_stats", "missing_indexes") else v for k, v in got.items()}
    return replace(model, meta=model.meta | {"runtime_available": available, "days_since_last_backup": days_since_last_backup}, **got)


def normalized(model: Model) -> Model:
    """A model read from elsewhere: ids once (the first stays), counters of an id summed, index rows once."""
    order = ["defined_in_slug", "defined_at_line"]
    stats = model.object_stats.groupBy("object_id").agg(*[F.sum(c).alias(c) for c in model.object_stats.columns[1:]])
    notes = R.dropped_duplicates(model.objects, ["id"], order).select(F.concat(F.lit("duplicate object "), F.col("id"), F.lit("; the first one is kept")).alias("message"))
    return replace(
        model, objects=R.keep_first(model.objects, ["id"], order), object_stats=stats, index_stats=R.in_order(model.index_stats, ["object_id", "index_name"]),
        missing_indexes=R.keep_first(model.missing_indexes, ["object_id", "equality_columns", "inequality_columns", "included_columns"], ["impact_score"]), diagnostics=model.diagnostics.unionByName(notes),
    )
