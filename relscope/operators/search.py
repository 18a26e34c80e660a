"""Search over names by an inverted index of grams, and set joins of many patterns with many names.

A needle's rarest gram names its candidates, which are then verified on the text; so work follows what is found, not the
product of needles and texts. Needles are at least one character long; those of one or two characters have grams as long
as themselves.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relscope.operators.lineage import cut

GRAM = 3


def _grams(text: Column, n: int) -> Column:
    """Distinct substrings of n characters."""
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n)))))


def index(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(gram, id): the 1-, 2- and 3-grams of each lower-cased text; to be written once and searched often."""
    low = F.lower(F.col(text))
    grams = F.flatten(F.array(*[F.coalesce(_grams(low, n), F.array().cast("array<string>")) for n in range(1, GRAM + 1)]))
    return texts.select(F.explode(grams).alias("gram"), F.col(key).alias("id"))


def _rarest(grams: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, n, gram): a needle's rarest gram and the number of its texts; needles with a gram that no text has are left out."""
    length = F.least(F.length("needle"), F.lit(GRAM))
    parts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("needle") - length + 1), lambda i: F.substring(F.col("needle"), i, length)))
    wanted = cut(needles.select("needle").where("needle <> ''").distinct().withColumn("part", F.explode(parts)))
    counts = grams.join(wanted.select(F.col("part").alias("gram")).distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, F.col("part") == F.col("gram"), "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("part").alias("gram"))).alias("r"))
    return cut(rarest.where("r.n > 0").select("needle", "r.n", "r.gram"))


def candidates(grams: DataFrame, needles: DataFrame) -> DataFrame:
    """(needle, id): texts that hold the needle's rarest gram; needles (needle) are lower case and not empty.

    A needle with a gram that no text has gets no candidate. Counts are combined before the shuffle; a gram that many
    texts share is met by a needle only where the needle has no rarer one.
    """
    return _rarest(grams, needles).select("needle", "gram").join(grams, "gram").select("needle", "id")


def containing(texts: DataFrame, needles: DataFrame, grams: DataFrame | None = None, key: str = "id", text: str = "text") -> DataFrame:
    """(needle, id): every text that holds a needle, both without case; the empty needle is held by none, as in a search box."""
    grams = cut(index(texts, key, text)) if grams is None else grams
    asked = needles.select(F.lower("needle").alias("needle"))
    found = candidates(grams, asked).join(texts.select(F.col(key).alias("id"), F.lower(F.col(text)).alias("__low")), "id")
    return found.where(F.contains("__low", "needle")).select("needle", "id").distinct()


# ---- palette ------------------------------------------------------------------------------------------------------


def _spread(needle: Column) -> Column:
    """Regular expression of the needle's characters in order, with anything between."""
    quoted = F.transform(F.split(needle, ""), lambda c: F.when(c.rlike(r"^[\p{L}\p{Nd}]$"), c).otherwise(F.concat(F.lit("\\"), c)))
    return F.concat(F.lit("(?s)"), F.array_join(quoted, ".*"))


def score(name: Column, detail: Column, needle: Column) -> Column:
    """palette_score for a needle column in lower case."""
    low = F.lower(name)
    at = F.position(needle, low) - 1
    return F.when(at == 0, 100).when(at > 0, 60 - F.least(F.lit(40), at)).when(F.contains(F.lower(detail), needle), 10).when(F.rlike(low, _spread(needle)), 5).otherwise(0)


def palette(rows: DataFrame, needles: DataFrame, k: int = 20) -> DataFrame:
    """(needle, score, name, detail, href): for each needle the k best of rows (name, detail, href).

    Names are found by their rarest gram, details by that of the distinct details, and names that hold the characters apart
    by their rarest character; each is scored as a scan would. Equal scores go by name, then href.
    """
    own = cut(rows.select("name", "detail", "href").withColumn("id", F.monotonically_increasing_id()))
    asked = cut(needles.select(F.lower("needle").alias("needle")).where("needle <> ''").distinct())
    grams = cut(index(own, "id", "name"))
    near = candidates(grams, asked)
    kinds = cut(own.select("detail").where("detail is not null").distinct())
    told = containing(kinds.select(F.col("detail").alias("id"), F.col("detail").alias("text")), asked).select("needle", F.col("id").alias("detail"))
    by_detail = told.join(own.select("id", "detail"), "detail").select("needle", "id")
    letters = asked.select("needle", F.explode(F.array_distinct(F.split("needle", ""))).alias("letter")).where("letter <> ''")
    counts = grams.where("length(gram) = 1").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = letters.join(counts, F.col("letter") == F.col("gram"), "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("letter").alias("gram"))).alias("r"))
    apart = rarest.where("r.n > 0").select("needle", F.col("r.gram").alias("gram")).join(grams, "gram").select("needle", "id")
    every = near.union(by_detail).union(apart).distinct().join(own, "id")
    scored = every.withColumn("score", score(F.col("name"), F.col("detail"), F.col("needle"))).where("score > 0")
    order = Window.partitionBy("needle").orderBy(F.desc("score"), "name", "href")
    return scored.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= k).select("needle", "score", "name", "detail", "href")


# ---- globs --------------------------------------------------------------------------------------------------------


def _glob_regex(pattern: Column) -> Column:
    """Anchored regular expression of a glob column; what is no letter, digit, * or ? is quoted."""
    quoted = F.regexp_replace(pattern, r"([^\p{L}\p{Nd}*?])", r"\\$1")
    return F.concat(F.lit("(?isu)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("\\z"))


#: Shapes of globs that texts are keyed by, the most frequent ones; pairs of first and last characters that an end of a shape is
#: filtered by; texts of a key up to which a glob asks for no rarer gram, and candidates a text that cost no more than its grams.
SHAPES, EDGES, SCARCE, GRAMS = 64, 512, 4096, 16


def _runs(shape: str) -> list[tuple[int, int]]:
    """(place, length) of the plain stretches of the end of a glob, where x stands for a plain character."""
    return [(m.start(), len(m.group())) for m in re.finditer("x+", shape)]


def _anchored(shape: str, text: Column) -> tuple[Column, list[Column], Column]:
    """Of a text or glob: whether its length suits a shape; the first and last plain character of both ends; all of them.

    A shape is what stands before the first and after the last star of a glob. Stretches are cut from the text before they
    are lower-cased, which may change lengths.
    """
    head, star, tail = shape.partition("*")
    size, n = F.length(text), len(head) + len(tail)
    ends = [[(F.lit(i + 1), k) for i, k in _runs(head)], [(size - (len(tail) - i - 1), k) for i, k in _runs(tail)]]
    part = lambda start, k: F.lower(F.substring(text, start, F.lit(k)))
    edges = [F.concat(part(e[0][0], 1), part(e[-1][0] + (e[-1][1] - 1), 1)) if e else F.lit("") for e in ends]
    return size >= n if star else size == n, edges, F.concat(*[part(*x) for e in ends for x in e])


def _glob_hits(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text, pattern): which of the distinct texts (text) match which of the globs."""
    plain = F.split(F.lower("pattern"), "[*?]+")
    longest = F.array_max(F.transform(plain, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    ends = F.regexp_replace(F.regexp_replace("pattern", "[^*?]", "x"), r"(?s)\*.*\*", "*")
    globs = cut(patterns.select("pattern").where("pattern is not null").distinct().select("pattern", longest.alias("needle"), ends.alias("shape")))
    shapes = [r["shape"] for r in globs.where(F.contains("shape", F.lit("x"))).groupBy("shape").count().orderBy(F.desc("count"), "shape").limit(SHAPES).collect()]
    keyed = texts.select("text", F.lit("").alias("shape"), F.lit("").alias("key")).limit(0)
    own = globs.select("pattern", "needle", F.lit(None).cast("string").alias("shape"), F.lit(None).cast("string").alias("key")).where("needle <> ''")
    if shapes:
        each = {s: _anchored(s, F.col("pattern")) for s in shapes}
        kept = lambda what: reduce(lambda c, s: c.when(F.col("shape") == s, what(each[s])), shapes, F.when(F.lit(False), F.lit(None).cast("string")))
        edged = [kept(lambda x, k=k: x[1][k]).alias(f"edge{k}") for k in (0, 1)]
        own = cut(globs.where("needle <> ''").select("pattern", "needle", F.when(F.col("shape").isin(shapes), F.col("shape")).alias("shape"), *edged, kept(lambda x: x[2]).alias("key")))
        known = own.where("shape is not null").select("shape", F.posexplode(F.array("edge0", "edge1")).alias("end", "edge")).distinct()
        known = known.withColumn("n", F.row_number().over(Window.partitionBy("shape", "end").orderBy("edge"))).where(F.col("n") <= EDGES + 1)
        edges: dict[tuple[str, int], list[str]] = {}
        for r in known.collect():
            edges.setdefault((r["shape"], r["end"]), []).append(r["edge"])

        def key_of(shape: str) -> Column:
            suits, ends_of, key = _anchored(shape, F.col("text"))
            for k, edge in enumerate(ends_of):
                if len(edges[shape, k]) <= EDGES:
                    suits = suits & edge.isin(edges[shape, k])
            return F.when(suits, F.struct(F.lit(shape).alias("shape"), key.alias("key")))

        keys = texts.select("text", F.explode(F.array(*map(key_of, shapes))).alias("k")).where("k is not null").select("text", "k.shape", "k.key")
        keyed = cut(keys.join(own.select("shape", "key").distinct(), ["shape", "key"], "left_semi").select("text", "shape", "key"))
    counts = keyed.groupBy("shape", "key").agg(F.count("*").alias("n"))
    counted = cut(own.join(counts, ["shape", "key"], "left").where("shape is null or n > 0").select("pattern", "needle", "shape", "key", "n"))
    few = counted.where(F.col("n") <= SCARCE)
    many = counted.where(F.col("n").isNull() | (F.col("n") > SCARCE))
    found = few.join(keyed, ["shape", "key"]).select("text", "pattern", "needle")
    weight = many.agg(F.sum("n").alias("n"), F.count_if(F.col("n").isNull()).alias("open"), F.count("*").alias("globs")).first()
    if weight["globs"] and not weight["open"] and weight["n"] <= GRAMS * texts.count():
        found = counted.join(keyed, ["shape", "key"]).select("text", "pattern", "needle")
    elif weight["globs"]:
        grams = cut(index(texts.select(F.col("text").alias("id"), "text")))
        asked = many.join(_rarest(grams, many).select("needle", "gram", F.col("n").alias("of_gram")), "needle")
        rarer = F.col("n").isNull() | (F.col("of_gram") < F.col("n"))
        by_gram = asked.where(rarer).join(grams, "gram").select(F.col("id").alias("text"), "pattern", "needle")
        found = found.union(by_gram).union(asked.where(~rarer).join(keyed, ["shape", "key"]).select("text", "pattern", "needle"))
    hits = found.where(F.contains(F.lower("text"), "needle")).where(F.rlike("text", _glob_regex(F.col("pattern")))).select("text", "pattern")
    open_ = globs.where("needle = ''").select("pattern", (F.length("pattern") - F.length(F.replace("pattern", F.lit("?"), F.lit("")))).alias("least"), F.contains("pattern", F.lit("*")).alias("more"))
    if open_.isEmpty():
        return hits
    lengths = texts.select(F.length("text").alias("length")).distinct()
    by_length = lengths.join(open_, (F.col("length") == F.col("least")) | (F.col("more") & (F.col("length") > F.col("least")))).select("length", "pattern")
    return hits.union(texts.withColumn("length", F.length("text")).join(by_length, "length").select("text", "pattern"))


def _named(texts: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(id, text): the texts' columns, a null one as the empty text."""
    return cut(texts.select(F.col(key).alias("id"), F.explode(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])).alias("text")).distinct())


def glob_matches(texts: DataFrame, patterns: DataFrame, key: str = "id", columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """(id, pattern): which of the texts' columns match which of the globs (pattern), without case; * and ? as wildcards.

    Globs with plain characters before their first or after their last star meet the texts that have the same characters in
    the same places from that end, by an equality join. Where many texts do, and for other globs, the longest run of plain
    characters must stand in the text: candidates are the texts with its rarest gram. The whole glob is verified on candidates.
    Patterns without any plain character ask for a length only: they meet the distinct lengths of the texts. A null text
    counts as empty, a null pattern matches nothing.
    """
    own = _named(texts, key, columns)
    return own.join(_glob_hits(cut(own.select("text").distinct()), patterns), "text").select("id", "pattern").distinct()


def excluded_by(objects: DataFrame, patterns: DataFrame, id_col: str = "id", name: str = "name") -> DataFrame:
    """Objects whose id or name matches any of the patterns (pattern)."""
    return objects.join(_gone(objects, patterns, id_col, name), id_col, "left_semi")


def excluding(objects: DataFrame, patterns: DataFrame, id_col: str = "id", name: str = "name") -> DataFrame:
    """Objects whose id and name match none of the patterns (pattern)."""
    return objects.join(_gone(objects, patterns, id_col, name), id_col, "left_anti")


def _gone(objects: DataFrame, patterns: DataFrame, id_col: str, name: str) -> DataFrame:
    own = _named(objects, id_col, tuple(dict.fromkeys((id_col, name))))
    hit = _glob_hits(cut(own.select("text").distinct()), patterns).select("text").distinct()
    return own.join(hit, "text", "left_semi").select(F.col("id").alias(id_col)).distinct()


__all__ = ["candidates", "containing", "excluded_by", "excluding", "glob_matches", "index", "palette", "score"]
