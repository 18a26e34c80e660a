"""Relational operators of the catalog engine, generic over tables: column names are arguments.

None of them collects rows or depends on partition order; ties are broken by explicit keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relscope.functions import scalars as S
from relscope.operators.lineage import cut

# Letters of the operations that a dependency kind stands for.
OP_LETTERS = {"read": "R", "insert": "C", "update": "U", "delete": "D"}
DYNAMIC = "exec-dynamic"


# ---- filters (PF) -------------------------------------------------------------------------------------------------


def of_kind(objects: DataFrame, *kinds: str, kind: str = "kind") -> DataFrame:
    return objects.where(F.col(kind).isin(*kinds))


def exclude(objects: DataFrame, patterns: Sequence[str], id_col: str = "id", name: str = "name") -> DataFrame:
    """Objects whose name and id match none of the globs."""
    return objects.where(~_any_glob(patterns, id_col, name))


def excluded(objects: DataFrame, patterns: Sequence[str], id_col: str = "id", name: str = "name") -> DataFrame:
    return objects.where(_any_glob(patterns, id_col, name))


def _any_glob(patterns: Sequence[str], *columns: str) -> Column:
    return reduce(lambda a, b: a | b, [S.glob_match(F.col(c), p) for p in patterns for c in columns], F.lit(False))


def not_touching(edges: DataFrame, gone: DataFrame, ends: Sequence[str], id_col: str = "id") -> DataFrame:
    """Edges none of whose ends is in gone."""
    for end in ends:
        edges = edges.join(gone.select(F.col(id_col).alias("__gone")).distinct(), F.col(end) == F.col("__gone"), "left_anti")
    return edges


def surviving(rows: DataFrame, objects: DataFrame, key: str = "object_id", id_col: str = "id") -> DataFrame:
    """Rows whose key is an object's id."""
    return rows.join(objects.select(F.col(id_col).alias("__id")), F.col(key) == F.col("__id"), "left_semi")


def search_rows(rows: DataFrame, column: str, text: str) -> DataFrame:
    return rows.where(F.contains(F.lower(column), F.lit(text.lower())))


def compare(rows: DataFrame, column: str, op: str, value: float) -> DataFrame:
    """Rows whose number stands in relation op (>=, <=, >, <, =) to value."""
    c = F.col(column)
    return rows.where({">=": c >= value, "<=": c <= value, ">": c > value, "<": c < value, "=": c == value}[op])


# ---- joins (JN) ---------------------------------------------------------------------------------------------------


def resolve(edges: DataFrame, objects: DataFrame, to: str = "to_object_id", external: str | None = "external_target", id_col: str = "id") -> DataFrame:
    """Edges whose target is no object lose it: it moves to `external`, or is blanked where that is None."""
    ids = objects.select(F.col(id_col).alias("__id")).distinct()
    joined = edges.join(ids, F.col(to) == F.col("__id"), "left")
    known = F.col("__id").isNotNull()
    out = joined
    if external is not None:
        kept = F.col(external) if external in edges.columns else F.lit("")
        out = out.withColumn(external, F.when(known, kept).otherwise(F.when(F.col(to) != "", F.col(to)).otherwise(kept)))
    return out.withColumn(to, F.when(known, F.col(to)).otherwise("")).drop("__id")


def infer_relationships(columns: DataFrame, tables: DataFrame, declared: DataFrame, suffix: str = "id") -> DataFrame:
    """(from_id, from_column, to_id, confidence): columns named after another table.

    columns (id, column), tables (id, name), declared (from_id, to_id). A column's stem must name exactly one table in
    its singular form; the own table and declared pairs don't count. Confidence is high if the stem is the table's name.
    """
    named = tables.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"), S.canonical_singular(F.col("name")).alias("key"))
    unique = named.groupBy("key").agg(F.count("*").alias("n"), F.first("to_id").alias("to_id"), F.first("to_name").alias("to_name")).where("n = 1")
    stems = columns.select(F.col("id").alias("from_id"), F.col("column").alias("from_column"), S.id_stem(F.col("column"), suffix).alias("stem")).where("stem is not null")
    hits = stems.withColumn("key", S.canonical_singular(F.col("stem"))).join(unique, "key").where("from_id <> to_id")
    hits = hits.join(declared.select("from_id", "to_id").distinct(), ["from_id", "to_id"], "left_anti")
    return hits.select("from_id", "from_column", "to_id", F.when(F.lower("stem") == F.lower("to_name"), "high").otherwise("medium").alias("confidence")).distinct()


def index_pairs(indexes: DataFrame, table: str = "object_id", name: str = "name", keys: str = "key_columns") -> DataFrame:
    """(object_id, first, second, relation): pairs of a table's indexes with identical keys or one a prefix of the other.

    Each index gives a hash of its whole key and one of each shorter prefix; a whole key meets the equal whole keys and
    prefixes of its table, so rows are joined in proportion to the pairs found, however many indexes share a first column.
    What meets is compared by the columns themselves.
    """
    rows = indexes.where(F.size(keys) > 0).select(F.col(table).alias("object_id"), F.col(name).alias("n"), F.col(keys).alias("k")).withColumn("low", S.lowered(F.col("k")))
    ends = F.sequence(F.lit(1), F.size("low"))
    marks = F.transform(ends, lambda i: F.struct(F.xxhash64(F.slice("low", F.lit(1), i)).alias("h"), (i == F.size("low")).alias("whole")))
    marked = rows.select("object_id", "n", "k", F.explode(marks).alias("m")).select("object_id", "n", "k", "m.*")
    short = marked.where("whole").select("object_id", "h", F.col("n").alias("na"), F.col("k").alias("ka"))
    long = marked.select("object_id", "h", F.col("n").alias("nb"), F.col("k").alias("kb"), "whole")
    same, prefix = S.same_columns(F.col("ka"), F.col("kb")), S.is_prefix(F.col("ka"), F.col("kb"))
    met = short.join(long, ["object_id", "h"]).where((F.col("whole") & (F.col("na") < F.col("nb")) & same) | (~F.col("whole") & (F.col("na") != F.col("nb")) & prefix))
    return met.select("object_id", F.least("na", "nb").alias("first"), F.greatest("na", "nb").alias("second"), F.when(F.col("whole"), "identical").otherwise("prefix").alias("relation"))


def unused_indexes(static: DataFrame, usage: DataFrame) -> DataFrame:
    """Static indexes (object_id, name, is_primary_key, is_disabled) that runtime counters never saw read."""
    first = in_order(usage, ["object_id", "index_name"])
    hit = first.where(S.is_unused(F.col("user_seeks"), F.col("user_scans"), F.col("user_lookups"), F.col("user_updates")))
    joined = static.where("not is_primary_key and not is_disabled").join(hit.withColumnRenamed("index_name", "name"), ["object_id", "name"])
    return joined.select("object_id", "name", "user_updates")


# ---- aggregates (AG) ----------------------------------------------------------------------------------------------


def crud_matrix(deps: DataFrame, actor: str = "from_object_id", target: str = "to_object_id", kind: str = "kind") -> DataFrame:
    """(target, actor, ops, is_blind_spot): letters of the operations, in order of the alphabet; one '?' row without
    target for each actor that runs dynamic SQL."""
    letter = F.create_map(*[F.lit(x) for pair in OP_LETTERS.items() for x in pair])[F.col(kind)]
    folded = (
        deps.where(F.col(target) != "").select(F.col(target).alias("target"), F.col(actor).alias("actor"), letter.alias("letter")).where("letter is not null")
        .groupBy("target", "actor").agg(F.array_join(F.array_sort(F.collect_set("letter")), "").alias("ops")).withColumn("is_blind_spot", F.lit(False))
    )
    blind = deps.where(F.col(kind) == DYNAMIC).select(F.lit("").alias("target"), F.col(actor).alias("actor"), F.lit("?").alias("ops"), F.lit(True).alias("is_blind_spot")).distinct()
    return folded.unionByName(blind)


def references(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, refs): the distinct targets of each source, sorted."""
    return edges.where(F.col(dst) != "").groupBy(F.col(src).alias("id")).agg(F.array_sort(F.collect_set(dst)).alias("refs"))


def fan_counts(edges: DataFrame, ids: DataFrame, id_col: str = "id", src: str = "src", dst: str = "dst", self_edges: bool = True) -> DataFrame:
    """(id, fan_in, fan_out, instability) of every id over distinct edges."""
    distinct = edges.where(F.col(dst) != "").select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct()
    if not self_edges:
        distinct = distinct.where("s <> d")
    ends = distinct.select(F.explode(F.array(F.struct(F.col("d").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("s").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    counts = ends.groupBy(F.col("e.id").alias("__id")).agg(F.sum("e.i").alias("fi"), F.sum("e.o").alias("fo"))
    out = ids.select(F.col(id_col).alias("id")).distinct().join(counts, F.col("id") == F.col("__id"), "left").select("id", F.coalesce("fi", F.lit(0)).cast("long").alias("fan_in"), F.coalesce("fo", F.lit(0)).cast("long").alias("fan_out"))
    return out.withColumn("instability", S.instability(F.col("fan_in"), F.col("fan_out")))


def touch_counts(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, touches): how many edge ends each id has; a self-edge counts twice."""
    return edges.select(F.explode(F.array(src, dst)).alias("id")).groupBy("id").agg(F.count("*").alias("touches"))


def domains(objects: DataFrame, edges: DataFrame, separator: str = "_") -> tuple[DataFrame, DataFrame]:
    """Per domain its objects, tables, programmables and internal, outgoing, incoming distinct edges; and the cross pairs.

    objects (id, name, kind), edges (src, dst). A self-edge is internal.
    """
    own = objects.select("id", S.domain_of(F.col("name"), separator).alias("domain"), "kind")
    counts = own.groupBy("domain").agg(F.count("*").alias("objects"), F.count_if(F.col("kind") == "table").alias("tables"), F.count_if(F.col("kind").isin(S.PROGRAMMABLE)).alias("programmables"))
    ends = own.select("id", "domain")
    pairs = edges.select("src", "dst").distinct().join(ends.toDF("src", "from_domain"), "src").join(ends.toDF("dst", "to_domain"), "dst").groupBy("from_domain", "to_domain").agg(F.count("*").alias("edges"))
    inner = F.col("from_domain") == F.col("to_domain")
    per = pairs.select(F.explode(F.when(inner, F.array(_end("from_domain", 1, 0, 0))).otherwise(F.array(_end("from_domain", 0, 1, 0), _end("to_domain", 0, 0, 1)))).alias("e"), "edges")
    sums = per.groupBy(F.col("e.domain").alias("domain")).agg(*[F.sum(F.col(f"e.{k}") * F.col("edges")).alias(k) for k in ("internal", "outgoing", "incoming")])
    out = counts.join(sums, "domain", "left").na.fill(0, ["internal", "outgoing", "incoming"])
    return out, pairs.where(~inner)


def _end(domain: str, internal: int, outgoing: int, incoming: int) -> Column:
    return F.struct(F.col(domain).alias("domain"), F.lit(internal).alias("internal"), F.lit(outgoing).alias("outgoing"), F.lit(incoming).alias("incoming"))


def index_inventory(rows: DataFrame) -> DataFrame:
    """(object_id, name, key_columns, included_columns, flags) of one row for each index column."""
    part = lambda included: F.transform(F.filter("__columns", lambda x: x["is_included"] == included), lambda x: x["column_name"])
    listed = rows.groupBy("schema", "table", "index_name").agg(
        F.array_sort(F.collect_list(F.struct("is_included", "key_ordinal", "column_name"))).alias("__columns"), F.max("is_unique").alias("is_unique"),
        F.max("is_primary_key").alias("is_primary_key"), F.max(F.upper("type_desc") == "CLUSTERED").alias("is_clustered"), F.max("is_disabled").alias("is_disabled"),
    )
    return listed.withColumn("key_columns", part(False)).withColumn("included_columns", part(True)).select(S.normalize_id(F.col("schema"), F.col("table")).alias("object_id"), F.col("index_name").alias("name"), "key_columns", "included_columns", "is_unique", "is_primary_key", "is_clustered", "is_disabled")


def share_of_total(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, total, share): each group's sum and its part of all."""
    sums = rows.groupBy(group).agg(F.sum(value).alias("total"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("total").alias("__all")))).select(group, "total", (F.col("total") / F.col("__all")).alias("share"))


def overall_dialect(files: DataFrame) -> DataFrame:
    """One row: unknown, the single dialect, or mixed, of the files that have lines."""
    return files.where("loc > 0").agg(F.count_distinct("dialect").alias("n"), F.min("dialect").alias("d")).select(F.when(F.col("n") == 0, "unknown").when(F.col("n") == 1, F.col("d")).otherwise("mixed").alias("dialect"))


def file_purposes(objects: DataFrame, slug: str = "defined_in_slug") -> DataFrame:
    """(slug, purpose): kinds by count, then name: "2 tables, 1 view"."""
    n = objects.groupBy(slug, "kind").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "kind", "n")))
    return n.groupBy(F.col(slug).alias("slug")).agg(F.array_join(F.transform(ordered, lambda x: S.pluralized(x["kind"], x["n"])), ", ").alias("purpose"))


def concentration(issues: DataFrame, object_id: str = "object_id") -> DataFrame:
    """(schema, issues): rows by schema, without case."""
    return issues.groupBy(F.lower(S.schema_of(F.col(object_id))).alias("schema")).agg(F.count("*").alias("issues"))


# ---- windows, sorts, limits (WN, TK) ------------------------------------------------------------------------------


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by order. Computed as a minimum, so a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"__first.{c}").alias(c) for c in rows.columns])


def in_order(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first row of each key in the order in which the rows come, as from a list or a file."""
    return keep_first(rows.withColumn("__at", F.monotonically_increasing_id()), keys, ["__at"]).drop("__at")


def dropped_duplicates(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows that keep_first leaves out, by position among equals: all but one of equal rows are left out too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n > 1").drop("__n")


def value_at(rows: DataFrame, value: str, place: int) -> object:
    """The value at `place` (from 1) of the descending order of a numeric column, nulls left out; None beyond its end.

    Radix selection: values become unsigned 64-bit keys of the same order; a pass counts the keys of the range that is left
    by their next 16 bits and keeps one of the 65,536 cells, so four passes of small aggregates find the key exactly.
    """
    kind = dict(rows.dtypes)[value]
    top = F.lit(-(1 << 63))
    if kind in ("float", "double"):
        # the bits of a double rise with it if those of negative numbers are turned over; -0.0 counts as 0.0
        bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col(value).cast("double") + F.lit(0.0)).cast("long")
        key = F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(top))
    elif kind in ("tinyint", "smallint", "int", "bigint"):
        key = F.col(value).cast("long").bitwiseXOR(top)
    else:
        raise ValueError(f"{value} is {kind}, not a whole or floating number")
    keyed = rows.where(F.col(value).isNotNull()).select(key.alias("__key"), F.col(value).alias("__v"))
    left, found = place, 0
    for shift in (48, 32, 16, 0):
        cell = F.shiftrightunsigned("__key", shift).bitwiseAND(0xFFFF)
        inside = keyed if shift == 48 else keyed.where(F.shiftrightunsigned("__key", shift + 16) == found)
        counts = inside.groupBy(cell.alias("c")).agg(F.count("*").alias("n"))
        for r in counts.orderBy(F.desc("c")).collect():  # 65,536 rows at most
            if r["n"] >= left:
                found = (found << 16) | r["c"]
                break
            left -= r["n"]
        else:
            return None
    exact = found - (1 << 64) if found >= 1 << 63 else found
    return keyed.where(F.col("__key") == exact).agg(F.max("__v")).first()[0]


def hot_rows(rows: DataFrame, value: str) -> DataFrame:
    """Rows whose value reaches the one at place max(1, n div 10) of the descending order; of fewer than 20 rows, the maximum."""
    n = rows.where(F.col(value).isNotNull()).count()
    if not n:
        return rows.limit(0)
    return rows.where(F.col(value) >= F.lit(value_at(rows, value, max(1, n // 10))))


def heat_buckets(rows: DataFrame, value: str, buckets: int = 5) -> DataFrame:
    """rows with `bucket` (logarithmic, 0 to 4) and `alpha`."""
    top = F.broadcast(rows.agg(F.max(value).alias("__top")))
    return rows.crossJoin(top).withColumn("bucket", S.log_bucket(F.col(value), F.col("__top"), buckets)).withColumn("alpha", S.bucket_alpha(F.col("bucket"))).drop("__top")


def top_k(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The first k rows by order; give a full order, so ties are settled."""
    return rows.orderBy(*order).limit(k)


def most_connected(nodes: DataFrame, edges: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """At most k nodes, those with most edge ends first, then by id."""
    return top_k(nodes.join(touch_counts(edges).withColumnRenamed("id", id_col), id_col, "left").na.fill(0, ["touches"]), max(10, k), F.desc("touches"), id_col)


def within(edges: DataFrame, shown: DataFrame, id_col: str = "id") -> DataFrame:
    """Edges both of whose ends are shown."""
    ids = shown.select(id_col)
    return edges.join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")


def page_of(rows: DataFrame, column: str, page: int, size: int = 25, descending: bool = False) -> DataFrame:
    """A page of a table sorted by a column: numbers by value, before other text."""
    number = F.expr(f"try_cast(`{column}` as double)")
    keys = [number, F.lower(F.col(column).cast("string"))]
    return rows.orderBy(number.isNull(), *[k.desc() if descending else k.asc() for k in keys], *rows.columns).offset((page - 1) * size).limit(size)


# ---- set operations (ST) ------------------------------------------------------------------------------------------


def distinct_edges(edges: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """(src, dst, kind): resolved dependencies and foreign keys, each once; cascading keys have a kind of their own."""
    deps = edges.where("to_object_id <> ''").select(F.col("from_object_id").alias("src"), F.col("to_object_id").alias("dst"), "kind")
    cascade = F.contains(F.lower("on_delete"), F.lit("cascade"))
    fks = foreign_keys.where("to_object_id <> ''").select(F.col("from_object_id").alias("src"), F.col("to_object_id").alias("dst"), F.when(cascade, "fk-cascade").otherwise("fk").alias("kind"))
    return deps.unionByName(fks).distinct()


def covered_columns(objects: DataFrame) -> DataFrame:
    """(id, covered): lower-case columns of the primary key and of any index."""
    text = F.flatten(F.transform("indexes", S.index_columns))
    return objects.select("id", F.array_distinct(S.lowered(F.concat("primary_key", text))).alias("covered"))


def except_rows(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")


def intersect_rows(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), list(keys), "left_semi")


# ---- diff (JN-12, DIFF) -------------------------------------------------------------------------------------------

BREAKING, DEGRADING, SAFE = 2, 1, 0
RISKS = {BREAKING: "Breaking", DEGRADING: "Degrading", SAFE: "Safe"}


def diff(old_objects: DataFrame, new_objects: DataFrame, old_columns: DataFrame, new_columns: DataFrame, old_fks: DataFrame, new_fks: DataFrame) -> DataFrame:
    """(kind, target, risk, detail) of two snapshots.

    objects (id, kind); columns (id, column, data_type, nullable); fks (from_id, to_id, columns). Columns are compared
    without case and only for objects that both snapshots have.
    """
    change = lambda kind, target, risk, detail: [F.lit(kind).alias("kind"), target.alias("target"), F.lit(risk).alias("risk"), detail.alias("detail")]
    o, n = old_objects.select("id", F.col("kind").alias("k")), new_objects.select("id", F.col("kind").alias("k"))
    both = o.toDF("id", "old").join(n.toDF("id", "new"), "id", "full_outer")
    objects = both.where("new is null").select(*change("object-dropped", F.col("id"), BREAKING, F.concat(F.col("old"), F.lit(" removed"))))
    objects = objects.union(both.where("old is null").select(*change("object-added", F.col("id"), SAFE, F.concat(F.col("new"), F.lit(" added")))))
    common = both.where("old is not null and new is not null").select("id")
    side = lambda d, p: d.join(common, "id", "left_semi").select("id", F.lower("column").alias("c"), F.col("column").alias(f"{p}_name"), F.col("data_type").alias(f"{p}_type"), F.col("nullable").alias(f"{p}_null"))
    cols = side(old_columns, "old").join(side(new_columns, "new"), ["id", "c"], "full_outer").withColumn("target", F.concat("id", F.lit("."), F.coalesce("old_name", "new_name")))
    gone = cols.where("new_name is null").select(*change("column-dropped", F.col("target"), BREAKING, F.lit("column removed")))
    fresh = cols.where("old_name is null").select(F.lit("column-added").alias("kind"), "target", F.when(F.col("new_null"), SAFE).otherwise(BREAKING).alias("risk"), F.when(F.col("new_null"), "nullable column added").otherwise("NOT NULL column added").alias("detail"))
    kept = cols.where("old_name is not null and new_name is not null").withColumn("cmp", S.compare_types(F.col("old_type"), F.col("new_type")))
    text = F.concat("old_type", F.lit(" to "), F.col("new_type"))
    narrowed = kept.where(F.col("cmp").isin("Narrowing", "Incompatible")).select(*change("column-type-narrowed", F.col("target"), BREAKING, text))
    widened = kept.where("cmp = 'Compatible'").select(*change("column-type-widened", F.col("target"), SAFE, text))
    tight = kept.where("old_null and not new_null").select(*change("column-not-null-tightened", F.col("target"), BREAKING, F.lit("NULL to NOT NULL")))
    key = lambda d: d.select(S.fk_key(F.col("from_id"), F.col("to_id"), F.col("columns")).alias("target")).distinct()
    fk = key(old_fks).join(key(new_fks), "target", "left_anti").select(*change("fk-dropped", F.col("target"), DEGRADING, F.lit("foreign key removed")))
    return reduce(DataFrame.union, [objects, gone, fresh, narrowed, widened, tight, fk])


def change_keys(changes: DataFrame) -> DataFrame:
    """changes with `key`: what a baseline remembers of a change."""
    return changes.withColumn("key", S.sha_key(F.col("kind"), F.col("target")))


def unsuppressed(changes: DataFrame, baseline: DataFrame) -> DataFrame:
    """Changes whose key the baseline (key) doesn't have."""
    return change_keys(changes).join(baseline.select("key").distinct(), "key", "left_anti").drop("key")
