"""Scalar functions of the catalog model, all Column to Column: they stay in generated JVM code.

Strings follow the model's null convention: a missing string is "", so equality joins work without null handling.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of SQL dialects, counted without case, in the order in which ties are decided.
DIALECT_MARKERS = {
    "tsql": ["GO\n", "[dbo]", "NVARCHAR", "@@", "PRINT ", "NOLOCK", "IDENTITY("],
    "mysql": ["ENGINE=", "AUTO_INCREMENT", "DELIMITER ", "UNSIGNED", "`"],
    "postgres": ["$$", "SERIAL", "RETURNS TRIGGER", "::", "public.", "SECURITY DEFINER"],
}
# Schemas that names without one belong to.
DEFAULT_SCHEMAS = {"tsql": "dbo", "postgres": "public", "mysql": ""}
# What a name's prefix or suffix says about its purpose, then what its kind says.
PREFIX_PURPOSES = [("usp_", "Stored procedure"), ("sp_", "Stored procedure"), ("vw_", "View"), ("fn_", "Function"), ("udf_", "User-defined function"), ("trg_", "Trigger")]
SUFFIX_PURPOSES = [("_audit", "Audit table"), ("_log", "Log table"), ("_history", "History table"), ("_v", "View")]
KIND_PURPOSES = {"table": "Table", "view": "View", "procedure": "Stored procedure", "function": "Function", "trigger": "Trigger"}
# Keys of a connection string whose values are secret.
SECRET_KEYS = ["password", "pwd", "user id", "uid", "server", "data source", "address", "addr", "network address"]
# Column types by what their length means.
LENGTH_TYPES = ["varchar", "char", "nvarchar", "nchar", "varbinary", "binary"]
PRECISION_TYPES = ["decimal", "numeric"]
TWO_BYTE_TYPES = ["nvarchar", "nchar"]
DEPRECATED_TYPES = ["text", "ntext", "image"]
# Type changes that lose nothing.
WIDENINGS = [("int", "bigint"), ("smallint", "int"), ("varchar", "nvarchar")]
PROGRAMMABLE = ["procedure", "function", "trigger"]


def strip_delims(name: Column) -> Column:
    """A name without surrounding white space and [ ] \" ` delimiters."""
    return F.trim(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r'^[\[\]"`]+|[\[\]"`]+$', ""))


def default_schema(dialect: Column) -> Column:
    out = F.lit("")
    for d, s in DEFAULT_SCHEMAS.items():
        out = F.when(dialect == d, s).otherwise(out)
    return out


def normalize_id(schema: Column, name: Column, dialect: Column | None = None) -> Column:
    """lower(schema.name) with the dialect's default schema where there is none."""
    dialect = F.lit("tsql") if dialect is None else dialect
    s = strip_delims(schema)
    s = F.when(s == "", default_schema(dialect)).otherwise(s)
    return F.lower(F.concat(s, F.lit("."), strip_delims(name)))


def count_lines(text: Column) -> Column:
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(breaks + F.when(text.endswith("\n"), 0).otherwise(1)).cast("int")


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def estimated_lines(n_bytes: Column) -> Column:
    """Lines of a script that is too large to parse, taken at 40 bytes a line."""
    return F.floor(n_bytes / 40).cast("int")


def count_occurrences(text: Column, marker: str) -> Column:
    """Non-overlapping occurrences without case."""
    low, m = F.lower(text), marker.lower()
    return F.floor((F.length(low) - F.length(F.replace(low, F.lit(m), F.lit("")))) / len(m)).cast("int")


def dialect_scores(text: Column) -> dict[str, Column]:
    return {d: sum((count_occurrences(text, m) for m in markers[1:]), count_occurrences(text, markers[0])) for d, markers in DIALECT_MARKERS.items()}


def detect_dialect(text: Column, forced: str | None = None) -> Column:
    """The dialect with the most markers; ties go to tsql, then mysql; none at all is tsql."""
    if forced in DIALECT_MARKERS:
        return F.lit(forced)
    s = dialect_scores(text)
    return F.when((s["tsql"] >= s["mysql"]) & (s["tsql"] >= s["postgres"]), "tsql").when(s["mysql"] >= s["postgres"], "mysql").otherwise("postgres")


def cyclomatic(source: Column) -> Column:
    """1 + occurrences of "IF ", "WHILE ", "CASE " and "CATCH" as plain substrings."""
    return F.lit(1) + count_occurrences(source, "IF ") + count_occurrences(source, "WHILE ") + count_occurrences(source, "CASE ") + count_occurrences(source, "CATCH")


def tokens(source: Column) -> Column:
    """Upper-case runs of letters, digits, @ and _."""
    return F.regexp_extract_all(F.upper(source), F.lit(r"([\p{L}\p{Nd}@_]+)"), 1)


def strip_comments_and_strings(source: Column) -> Column:
    """Line comments, block comments and '...' strings become one space; unterminated ones reach to the end."""
    return F.regexp_replace(source, r"(?s)--[^\n]*|/\*.*?(\*/|$)|'[^']*('|$)", " ")


def has_token(toks: Column, *sequence: str) -> Column:
    """Whether the tokens stand next to each other in this order."""
    return F.contains(F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" ")), F.lit(" " + " ".join(sequence) + " "))


def code_flags(source: Column) -> Column:
    """Struct of flags; all but uses_execute_as look at comments and strings too."""
    t = tokens(source)
    return F.struct(
        (has_token(t, "NOLOCK") | has_token(t, "READ", "UNCOMMITTED")).alias("uses_nolock"), has_token(t, "CURSOR").alias("uses_cursor"), has_token(t, "@@IDENTITY").alias("uses_at_at_identity"),
        has_token(t, "SET", "NOCOUNT", "ON").alias("has_set_nocount"), has_token(tokens(strip_comments_and_strings(source)), "EXECUTE", "AS").alias("uses_execute_as"), F.lit(True).alias("scanned"),
    )


def slug_base(path: Column) -> Column:
    return F.regexp_replace(path, r"[^\p{L}\p{Nd}]", "_")


def make_slug(path: Column) -> Column:
    """File name of a path: at most 100 characters, longer ones end in 8 digits of their SHA-256."""
    s = slug_base(path)
    return F.when(F.length(s) > 100, F.concat(F.substring(s, 1, 91), F.lit("_"), F.substring(F.sha2(path, 256), 1, 8))).otherwise(s)


def slugify(text: Column, lower: bool = False) -> Column:
    s = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{Nd}._-]", "-"), r"^[-.]+|[-.]+$", "")
    return F.lower(s) if lower else s


def glob_pattern(pattern: str) -> str:
    """Anchored regular expression of a glob: * and ?, without case, everything else literal."""
    body = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c.isascii() else c for c in pattern)
    return f"(?isu)^{body}\\z"


def glob_match(text: Column, pattern: str) -> Column:
    return F.coalesce(text, F.lit("")).rlike(glob_pattern(pattern))


def canonical_singular(name: Column) -> Column:
    """Lower-case name without a common plural ending."""
    s = F.lower(name)
    cut = lambda n: F.substring(s, F.lit(1), F.length(s) - n)
    return (
        F.when(s.endswith("ies") & (F.length(s) > 3), F.concat(cut(3), F.lit("y")))
        .when(s.rlike("(s|x|ch|sh)es$"), cut(2))
        .when(s.endswith("s") & ~s.endswith("ss") & (F.length(s) > 1), cut(1))
        .otherwise(s)
    )


def id_stem(column: Column, suffix: str = "id") -> Column:
    """What stands before the id suffix of a column name, or null."""
    has = F.lower(column).endswith(suffix) & (F.length(column) > len(suffix))
    stem = F.regexp_replace(F.substring(column, F.lit(1), F.length(column) - len(suffix)), r"^[_\-. ]+|[_\-. ]+$", "")
    return F.when(has & (stem != ""), stem)


def domain_of(name: Column, separator: str = "_") -> Column:
    parts = F.filter(F.split(name, f"[{separator}]"), lambda x: F.trim(x) != "")
    return F.coalesce(F.get(parts, F.lit(0)), F.lit("(ungrouped)"))


def object_purpose(name: Column, kind: Column) -> Column:
    low, out = F.lower(name), None
    for p, purpose in PREFIX_PURPOSES:
        out = F.when(low.startswith(p), purpose) if out is None else out.when(low.startswith(p), purpose)
    for p, purpose in SUFFIX_PURPOSES:
        out = out.when(low.endswith(p), purpose)
    for k, purpose in KIND_PURPOSES.items():
        out = out.when(kind == k, purpose)
    return out.otherwise("Database object")


def base_type(data_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(data_type, F.lit("("), F.lit(1))))


def character_width(data_type: Column, max_length: Column) -> Column:
    """Characters of a byte length; -1 is (max) and stays."""
    return F.when((max_length > 0) & base_type(data_type).isin(TWO_BYTE_TYPES), F.floor(max_length / 2)).otherwise(max_length).cast("int")


def type_text(data_type: Column, max_length: Column, precision: Column, scale: Column) -> Column:
    """A column type as DDL writes it."""
    t = F.lower(data_type)
    length = F.when(max_length == -1, "max").otherwise(character_width(t, max_length).cast("string"))
    return F.when(t.isin(PRECISION_TYPES), F.concat(t, F.lit("("), precision.cast("string"), F.lit(","), scale.cast("string"), F.lit(")"))).when(t.isin(LENGTH_TYPES), F.concat(t, F.lit("("), length, F.lit(")"))).otherwise(t)


def canonical_type(data_type: Column) -> Column:
    t = F.lower(F.trim(data_type))
    return F.when(t == "numeric", "decimal").when(t == "integer", "int").otherwise(t)


def compare_types(old: Column, new: Column) -> Column:
    """Same, Compatible (widening), Narrowing (the reverse) or Incompatible."""
    o, n = canonical_type(old), canonical_type(new)
    wider = [(o == a) & (n == b) for a, b in WIDENINGS]
    narrower = [(o == b) & (n == a) for a, b in WIDENINGS]
    return F.when(o == n, "Same").when(wider[0] | wider[1] | wider[2], "Compatible").when(narrower[0] | narrower[1] | narrower[2], "Narrowing").otherwise("Incompatible")


def index_columns(index_text: Column) -> Column:
    """The columns of "name(col,col)", trimmed."""
    return F.filter(F.transform(F.split(F.regexp_extract(index_text, r"\(([^)]*)\)", 1), ","), F.trim), lambda c: c != "")


def redact(text: Column) -> Column:
    """key=value; pairs with secret keys lose their value."""

    def one(part: Column) -> Column:
        key = F.lower(F.trim(F.substring_index(part, "=", 1)))
        return F.when((F.instr(part, "=") > 1) & key.isin(SECRET_KEYS), F.concat(F.substring_index(part, "=", 1), F.lit("=<redacted>"))).otherwise(part)

    return F.array_join(F.transform(F.split(text, ";"), one), ";")


def on_delete_clause(action: Column) -> Column:
    a = F.upper(F.regexp_replace(action, "[_ ]", ""))
    return F.when(a == "CASCADE", " ON DELETE CASCADE").when(a == "SETNULL", " ON DELETE SET NULL").when(a == "SETDEFAULT", " ON DELETE SET DEFAULT").otherwise("")


def schema_of(object_id: Column) -> Column:
    return F.when(F.instr(object_id, ".") > 1, F.substring_index(object_id, ".", 1)).otherwise(object_id)


def display_ops(ops: Column) -> Column:
    """Operation letters in the order C, R, U, D."""
    return F.array_join(F.filter(F.array(*[F.lit(x) for x in "CRUD"]), lambda x: F.contains(ops, x)), "")


def sarif_level(severity: Column) -> Column:
    return F.when(severity <= 1, "error").when(severity == 2, "warning").otherwise("note")


def drop_index_text(object_id: Column, index_name: Column, schema: Column, name: Column) -> Column:
    return F.format_string("DROP INDEX [%s] ON [%s].[%s];", index_name, schema, name)


def fk_key(from_id: Column, to_id: Column, columns: Column) -> Column:
    return F.concat(from_id, F.lit("->"), to_id, F.lit(":"), F.array_join(columns, ","))


def is_unused(seeks: Column, scans: Column, lookups: Column, updates: Column) -> Column:
    return (seeks + scans + lookups == 0) & (updates > 0)


def instability(fan_in: Column, fan_out: Column) -> Column:
    return F.when(fan_in + fan_out > 0, fan_out / (fan_in + fan_out)).otherwise(0.0)


def whole_days(earlier: Column, later: Column) -> Column:
    """Whole days between two instants, towards zero."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return ((micros(later) - micros(earlier)) / 86_400_000_000).cast("long")


def log_bucket(value: Column, top: Column, buckets: int = 5) -> Column:
    """0 .. buckets - 1 on a logarithmic scale up to top."""
    raw = F.when(top > 0, buckets * F.log1p(value.cast("double")) / F.log1p(top.cast("double"))).otherwise(0.0)
    return F.greatest(F.lit(0), F.least(F.lit(buckets - 1), raw.cast("int")))


def bucket_alpha(bucket: Column) -> Column:
    return 0.15 + 0.175 * bucket


def lowered(names: Column) -> Column:
    return F.transform(names, F.lower)


def same_columns(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (lowered(a) == lowered(b))


def is_prefix(short: Column, long: Column) -> Column:
    """Whether short, not empty and shorter, begins long; without case."""
    return (F.size(short) > 0) & (F.size(short) < F.size(long)) & (F.slice(lowered(long), F.lit(1), F.greatest(F.size(short), F.lit(1))) == lowered(short))


def clamp(value: Column, lo: int, hi: int | None = None) -> Column:
    out = F.greatest(value, F.lit(lo))
    return out if hi is None else F.least(out, F.lit(hi))


def database_name(connection: Column) -> Column:
    """Name of the database in a connection string, or "database"."""
    pairs = F.transform(F.split(connection, ";"), lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "=", 1))).alias("k"), F.trim(F.substring_index(p, "=", -1)).alias("v")))
    hit = F.filter(pairs, lambda p: p["k"].isin("initial catalog", "database") & (p["v"] != ""))
    return F.coalesce(F.get(hit, F.lit(0))["v"], F.lit("database"))


def palette_score(name: Column, detail: Column, query: str) -> Column:
    """100 prefix, 60 - min(40, position) substring, 10 in the detail, 5 subsequence, else 0."""
    q = query.lower()
    low, at = F.lower(name), F.instr(F.lower(name), q) - 1
    spread = "(?s)" + ".*".join("\\" + c if not c.isalnum() and c.isascii() else c for c in q)
    return F.when(at == 0, 100).when(at > 0, 60 - F.least(F.lit(40), at)).when(F.contains(F.lower(detail), F.lit(q)), 10).when(low.rlike(spread), 5).otherwise(0)


def alnum_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{Nd}]", "")


def sha_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def html_encode(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def uri_escape(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def one_decimal(value: Column) -> Column:
    """One decimal, as .NET's F1 without a culture: -0.0 keeps its sign, NaN and Infinity have their names; null stays null."""
    return F.when(value.isNotNull(), F.format_string("%.1f", value.cast("double")))


def megabytes(n_bytes: Column) -> Column:
    return one_decimal(n_bytes / (1024 * 1024))


def split_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x != "")


def pluralized(kind: Column, n: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), kind, F.when(n == 1, "").otherwise("s"))


def is_temp_name(name: Column) -> Column:
    return name.rlike("^[#@]")


def bad_name(name: Column) -> Column:
    """Whether a name has a space or begins with a digit."""
    return name.rlike(r" |^\p{Nd}")


def decoded(data: bytes) -> str:
    """A file's text by its byte order mark, else UTF-8; for use in tasks."""
    for mark, name in ((b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    return data.decode("utf-8", "replace")
