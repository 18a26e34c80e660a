"""Mixing sources to target weights with a low-discrepancy schedule (operator 9).

Each source's documents are shuffled by a hash and cut into blocks of equal word counts (smaller ones for a source that would
have too few). Slots 0, 1, 2, ... of the mix map the golden-ratio sequence frac((i + 1/2) * phi) through the cumulative
targets, in blocks, to a source; a slot's rank within its source names the block it takes, starting over when the source's
blocks are used up. A slot finds its source among those of one cell of the unit interval. Running sums and ranks are
computed in levels of bounded groups, so no window ever spans a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relscope.llm.common import Scratch, local_rows, read, small

WEIGHTS, REPEATS, SEED = (5, 2, 1), 3, 9
#: A source's target spans this many slots at least (or a slot a word); beyond MAX_SLOTS only small sources add slots.
SLOTS_OF_LEAST, MAX_SLOTS = 2048, 50_000_000
#: Slots are ranked in runs of this length.
RUN = 4096
#: 2^64 / golden ratio, odd; the sequence is computed in integers and is therefore the same on every machine.
STEP = 0x9E3779B97F4A7C15
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words: runs of anything but \\x20 and \\x09-\\x0D."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> list[float]:
    """Shares of the sum of sizes by repeating weights; none above repeats times its size, the excess goes to the rest."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        whole = sum(weights[i % len(weights)] for i in free)
        share = {i: left * weights[i % len(weights)] / whole for i in free}
        over = {i for i in free if share[i] > repeats * sizes[i]}
        if not over:
            for i in free:
                out[i] = share[i]
            break
        for i in over:
            out[i] = float(repeats * sizes[i])
        free -= over
    return out


def running_start(rows: DataFrame, group: str, order: str, value: str, n_rows: int, out: str) -> DataFrame:
    """rows with `out`: the sum of value over the rows of the same group that come earlier by order (a long hash).

    The order's upper bits cut a group into buckets of about a hundred rows; bucket sums are summed up in the same way,
    4096 buckets at a time. Ties in order are broken by the row's other columns.
    """
    bits = max(0, (max(1, n_rows // 64)).bit_length() - 1)
    bucket = F.shiftrightunsigned(order, 64 - bits) if bits else F.lit(0).cast("long")
    dealt = rows.withColumn("__bucket", bucket)
    sums = dealt.groupBy(group, "__bucket").agg(F.sum(value).alias("__sum"))
    level = _before(sums, group, bits)
    ties = [c for c in rows.columns if c not in (group, order)]
    unsigned = F.col(order).bitwiseXOR(F.lit(-(1 << 63)))  # as the buckets are cut
    inner = Window.partitionBy(group, "__bucket").orderBy(unsigned, *ties).rowsBetween(Window.unboundedPreceding, -1)
    same = dealt[group].eqNullSafe(level["__g"]) & (dealt["__bucket"] == level["__b"])
    local = dealt.withColumn("__local", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return local.join(level, same).withColumn(out, F.col("__local") + F.col("__before")).drop("__local", "__before", "__g", "__b", "__bucket")


def _before(sums: DataFrame, group: str, bits: int, fan: int = 12) -> DataFrame:
    """(__g, __b, __before): the sum over the group's earlier buckets."""
    cut = sums.withColumn("__top", F.shiftrightunsigned("__bucket", fan))
    inner = Window.partitionBy(group, "__top").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("__in", F.coalesce(F.sum("__sum").over(inner), F.lit(0)))
    if bits <= fan:
        return cut.select(F.col(group).alias("__g"), F.col("__bucket").alias("__b"), F.col("__in").alias("__before"))
    tops = sums.withColumn("__bucket", F.shiftrightunsigned("__bucket", fan)).groupBy(group, "__bucket").agg(F.sum("__sum").alias("__sum"))
    upper = _before(tops, group, bits - fan, fan).withColumnRenamed("__before", "__up")
    return cut.join(upper, cut[group].eqNullSafe(upper["__g"]) & (cut["__top"] == upper["__b"])).select(F.col(group).alias("__g"), F.col("__bucket").alias("__b"), (F.col("__in") + F.col("__up")).alias("__before"))


def plan(totals: list[tuple[str | None, int]], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> tuple[list[dict], int, int]:
    """For (source, size) rows in order: a row per source with its target, block size and cut; the largest block; the slots.

    Where MAX_SLOTS makes blocks larger, a source whose target would span less than SLOTS_OF_LEAST of them has smaller ones
    and as many more slots.
    """
    goals = targets([n for _, n in totals], weights, repeats)
    total, least = sum(n for _, n in totals), min((g for g in goals if g > 0), default=0.0)
    block = max(1, int(least // SLOTS_OF_LEAST), total // MAX_SLOTS)
    own = [max(1, min(block, int(g // SLOTS_OF_LEAST))) if g else block for g in goals]
    shares = [g / b for g, b in zip(goals, own, strict=True)]
    whole, at, out = total / block if all(b == block for b in own) else sum(shares), 0.0, []
    for i, ((source, size), goal, mine, share) in enumerate(zip(totals, goals, own, shares, strict=True)):
        lo, at = at, at + share
        cut = lambda x: int(x / whole * 2**53) if whole else 0
        out.append({"sid": i, "source": source, "source_size": size, "target": goal, "block": mine, "lo": cut(lo), "hi": cut(at) if i + 1 < len(totals) else 2**53, "blocks": -(-size // mine)})
    slots = math.ceil(whole)
    return out, block, slots


def schedule(spark: SparkSession, sources: list[dict], slots: int, block: int, repeats: int = REPEATS) -> DataFrame:
    """(slot, sid, rank, block): the mix in order. rank counts the source's slots from 0; block = rank mod its blocks.

    Slots beyond `repeats` uses of every block are left out, so no document is used more often than that.
    """
    used = [s for s in sources if s["hi"] > s["lo"] and s["blocks"]]
    # the unit interval in about as many cells as there are sources: a slot meets the sources that its cell touches
    bits = max(1, len(used).bit_length())
    table = local_rows(spark, [(s["sid"], s["lo"], s["hi"], s["blocks"]) for s in used], "sid int, lo long, hi long, blocks long")
    by_cell = table.withColumn("cell", F.explode(F.sequence(F.shiftright("lo", 53 - bits), F.shiftright(F.col("hi") - 1, 53 - bits))))
    # frac((i + 1/2) * phi) in units of 2^-53; multiplication wraps at 2^64 as it should
    point = F.expr(f"try_cast(pmod(cast(id as decimal(38,0)) * {STEP} + {STEP // 2}, 18446744073709551616) / 2048 as decimal(38,0))").cast("long")
    ids = spark.range(slots).select(F.col("id").alias("slot"), point.alias("u")).withColumn("cell", F.shiftright("u", 53 - bits))
    met = ids.join(small(by_cell, (len(used) + (1 << bits)) * 48), "cell")
    drawn = met.where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("slot", "sid", "blocks").withColumn("run", F.expr(f"slot div {RUN}"))
    counts = drawn.groupBy("sid", "run").agg(F.count("*").alias("n"))
    level = _before(counts.withColumnRenamed("run", "__bucket").withColumnRenamed("n", "__sum"), "sid", max(1, (slots // RUN).bit_length()))
    local = drawn.withColumn("in_run", F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")) - 1)
    ranked = local.join(level, (local["sid"] == level["__g"]) & (local["run"] == level["__b"])).withColumn("rank", F.col("in_run") + F.col("__before"))
    return ranked.where(F.col("rank") < repeats * F.col("blocks")).select("slot", "sid", "rank", F.expr("rank % blocks").alias("block"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs.

    Null and empty texts have size 0 and take 0; a null source is a source of its own and comes last. Repeated rows and
    ties in the shuffle order are told apart by all columns used, equal rows share alike. Sources are collected to the
    driver (one row each), documents never. Other columns are not read, so clashing names don't matter. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    order = F.xxhash64(F.lit(seed), F.col(doc_id), F.xxhash64(F.col(text)))
    with Scratch(spark) as scratch:
        given = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), order.alias("order"), word_count(F.col(text)).alias("size"))
        sized = scratch.save(given, "sizes")
        totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
        sources, block, slots = plan([(r["source"], int(r["size"])) for r in totals], weights, repeats)
        facts = local_rows(spark, [(s["sid"], s["source"], s["source_size"], s["target"], s["block"]) for s in sources], "sid int, source string, source_size long, target double, words long")
        facts = facts.withColumnRenamed("source", "__name")
        size = sum(80 + len((s["source"] or "").encode("utf-8", "surrogatepass")) for s in sources)
        known = sized.join(small(facts, size), sized["source"].eqNullSafe(facts["__name"])).select("doc_id", "sid", "order", "size", "source_size", "target", "words")
        placed = scratch.save(running_start(known, "sid", "order", "size", sum(r["n"] for r in totals), "start"), "placed")
        # each document meets the blocks that it overlaps, each block its uses in the schedule
        spans = placed.where("size > 0").select("sid", "start", "size", "words", F.explode(F.sequence(F.expr("start div words"), F.expr("(start + size - 1) div words"))).alias("block"))
        part = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("words")) - F.greatest(F.col("start"), F.col("block") * F.col("words"))
        uses = scratch.save(schedule(spark, sources, slots, block, repeats).groupBy("sid", "block").agg(F.count("*").alias("uses")), "uses")
        taken = spans.withColumn("part", part).join(uses, ["sid", "block"]).groupBy("sid", "start").agg(F.sum(F.col("part") * F.col("uses")).alias("got"))
        joined = placed.join(taken, ["sid", "start"], "left")
        words = F.when(F.col("size") > 0, F.coalesce("got", F.lit(0))).otherwise(0).cast("long")
        return scratch.keep(joined.select("doc_id", "size", "source_size", "target", words.alias("taken")), "mix")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents"))
