"""Sources of script units (rel_path, content, dialect): folders of SQL files, live catalogs, and rows of either."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relscope.functions import scalars as S
from relscope.sources import script_source
from relscope.sources.script_source import EXTENSIONS, SKIPPED_FOLDERS

def folder(spark: SparkSession, root: str, skip: Sequence[str] = (), dialect: str | None = None) -> DataFrame:
    """Scripts below root in a store that only Spark reads; unreadable files are left out without a word (see read_folder)."""
    any_case = ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in EXTENSIONS)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("pathGlobFilter", f"*.{{{any_case}}}").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/")
    plain = F.regexp_replace("path", "^[a-z]+:/+", "/")
    rel = F.substring(plain, F.lit(len("/" + full.split(":", 1)[-1].lstrip("/")) + 2), F.length(plain))
    folders = F.slice(F.split(F.lower("rel_path"), "/"), 1, F.size(F.split("rel_path", "/")) - 1)
    named = raw.select(rel.alias("rel_path"), "content").where(F.lower(F.element_at(F.split("rel_path", "[.]"), -1)).isin(EXTENSIONS))
    kept = named.where(~F.arrays_overlap(folders, F.array(*[F.lit(x.lower()) for x in [*SKIPPED_FOLDERS, *skip]])))
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")
    return kept.select("rel_path", text.alias("content")).withColumn("dialect", S.detect_dialect(F.col("content"), dialect))


def read_folder(spark: SparkSession, root: str, skip: Sequence[str] = (), dialect: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The scripts below root as units (rel_path, content, dialect), and (message) for each folder or file that can't be read."""
    rows = script_source.read(spark, root, skip)
    found = rows.where("problem is null").select("rel_path", "content").withColumn("dialect", S.detect_dialect(F.col("content"), dialect))
    return found, rows.where("problem is not null").orderBy("rel_path").select(F.col("problem").alias("message"))


def units(spark: SparkSession, rows: Sequence[tuple[str, str]], dialect: str | None = None) -> DataFrame:
    """Scripts given as (path, text)."""
    return spark.createDataFrame(list(rows), "rel_path string, content string").withColumn("dialect", S.detect_dialect(F.col("content"), dialect))


def reconstructed(objects: DataFrame, columns: DataFrame, primary_keys: DataFrame, foreign_keys: DataFrame, modules: DataFrame) -> DataFrame:
    """Script units that say what catalog rows say: a CREATE TABLE for each table, modules word for word."""
    quoted = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    ordered = lambda o, v: F.transform(F.array_sort(F.collect_list(F.struct(F.col(o).alias("o"), v.alias("v")))), lambda x: x["v"])
    kind = S.type_text(F.col("type_name"), F.col("max_length"), F.col("precision"), F.col("scale"))
    line = F.concat(F.lit("    "), quoted(F.col("column")), F.lit(" "), kind, F.when(F.col("is_identity"), " IDENTITY(1,1)").otherwise(""), F.when(F.col("is_nullable"), " NULL").otherwise(" NOT NULL"))
    cols = columns.groupBy("schema", "table").agg(ordered("ordinal", line).alias("lines"))
    keys = primary_keys.groupBy("schema", "table").agg(F.array_join(ordered("key_ordinal", quoted(F.col("column"))), ", ").alias("pk"))
    keys = keys.withColumn("pk", F.concat(F.lit("    CONSTRAINT [PK_"), "table", F.lit("] PRIMARY KEY ("), "pk", F.lit(")")))
    fks = foreign_keys.groupBy("schema", "table", "fk_name").agg(F.first("ref_schema").alias("rs"), F.first("ref_table").alias("rt"), F.first("on_delete").alias("od"), F.array_join(ordered("ordinal", quoted(F.col("from_column"))), ", ").alias("a"), F.array_join(ordered("ordinal", quoted(F.col("to_column"))), ", ").alias("b"))
    fk = F.concat(F.lit("    CONSTRAINT "), quoted(F.col("fk_name")), F.lit(" FOREIGN KEY ("), "a", F.lit(") REFERENCES "), quoted(F.col("rs")), F.lit("."), quoted(F.col("rt")), F.lit(" ("), "b", F.lit(")"), S.on_delete_clause(F.col("od")))
    fks = fks.select("schema", "table", "fk_name", fk.alias("fk")).groupBy("schema", "table").agg(ordered("fk_name", F.col("fk")).alias("fks"))
    tables = objects.where(F.trim("type_code") == "U").select("schema", F.col("name").alias("table"))
    none = F.array().cast("array<string>")
    joined = tables.join(cols, ["schema", "table"], "left").join(keys, ["schema", "table"], "left").join(fks, ["schema", "table"], "left")
    body = F.array_join(F.concat(F.coalesce("lines", none), F.when(F.col("pk").isNotNull(), F.array("pk")).otherwise(none), F.coalesce("fks", none)), ",\n")
    ddl = F.concat(F.lit("CREATE TABLE "), quoted(F.col("schema")), F.lit("."), quoted(F.col("table")), F.lit(" (\n"), body, F.lit("\n);\n"))
    made = joined.select(F.concat(F.lit("live/"), "schema", F.lit("."), "table").alias("rel_path"), ddl.alias("content"))
    return made.union(modules.select(F.concat(F.lit("live/"), "schema", F.lit("."), "name"), "definition")).withColumn("dialect", F.lit("tsql"))


@dataclass
class Config:
    exclude_patterns: list[str]


def load_config(explicit: str | None, *places: str) -> Config:
    """The configuration at the explicit path, else in the first place that has one; malformed JSON raises ValueError."""
    names = [explicit] if explicit else [os.path.join(p, "relscope.config.json") for p in places]
    for name in names:
        if os.path.exists(name):
            try:
                got = json.load(open(name, encoding="utf-8"))
                patterns = got.get("excludePatterns", [])
                if not isinstance(patterns, list) or not all(isinstance(p, str) for p in patterns):
                    raise ValueError("excludePatterns must be a list of strings")
            except (json.JSONDecodeError, AttributeError) as e:
                raise ValueError(f"{name}: {e}") from e
            return Config(patterns)
        if explicit:
            raise ValueError(f"{name}: no such file")
    return Config([])


def read_secret(file: str | None = None, env: str | None = None) -> str:
    """A connection string from a file or an environment variable; exactly one must be named."""
    if (file is None) == (env is None):
        raise ValueError("name a connection file or an environment variable, not both")
    text = open(file, encoding="utf-8").read() if file else os.environ.get(env or "", "")
    if not text.strip():
        raise ValueError("the connection string is empty")
    return text.strip()
