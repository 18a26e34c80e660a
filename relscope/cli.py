"""Command line: scan a folder, rebuild from a model, format, impact, diff, query.

Exit codes: 0 well, 1 a crash, 2 wrong usage, 3 a gate that tripped (outputs are still written).
"""

from __future__ import annotations

import argparse
import os
import sys
import webbrowser
from pathlib import Path

from pyspark.sql import SparkSession

from relscope.operators import model as M
from relscope.operators import query_lang, rules, views
from relscope.operators import relational as R
from relscope.sources import scripts, sinks, tsql


def session() -> SparkSession:
    return SparkSession.builder.appName("relscope").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("relscope")
    sub = p.add_subparsers(dest="verb", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--out", default="relscope-out")
    shared.add_argument("--max-nodes", type=int, default=60)
    shared.add_argument("--exclude-pattern", action="append", default=[])
    shared.add_argument("--config")
    shared.add_argument("--fail-on", default="")
    shared.add_argument("--sarif")
    shared.add_argument("--baseline")
    shared.add_argument("--no-open", action="store_true", help="don't show the site in a browser, as is done on a terminal")
    scan = sub.add_parser("scan", parents=[shared])
    scan.add_argument("folder")
    scan.add_argument("--exclude", action="append", default=[])
    scan.add_argument("--dialect", choices=["tsql", "mysql", "postgres"])
    connect = sub.add_parser("connect", parents=[shared])
    connect.add_argument("--conn-file")
    connect.add_argument("--env")
    connect.add_argument("--timeout", type=int, default=30)
    again = sub.add_parser("from-model")
    again.add_argument("model")
    again.add_argument("--out", default="relscope-out")
    fmt = sub.add_parser("format")
    fmt.add_argument("folder")
    fmt.add_argument("--check", action="store_true")
    fmt.add_argument("--dialect", choices=["tsql", "mysql", "postgres"])
    imp = sub.add_parser("impact")
    imp.add_argument("object")
    imp.add_argument("--model", required=True)
    dif = sub.add_parser("diff")
    dif.add_argument("old")
    dif.add_argument("new")
    dif.add_argument("--out")
    dif.add_argument("--html")
    dif.add_argument("--fail-on", default="")
    dif.add_argument("--baseline")
    dif.add_argument("--write-baseline")
    ask = sub.add_parser("query")
    ask.add_argument("text")
    ask.add_argument("--model", required=True)
    return p


def emit(spark: SparkSession, m: M.Model, a: argparse.Namespace) -> int:
    m = rules.linted(m)
    drift = None
    if a.baseline:
        drift = views.drift(sinks.read_model(spark, a.baseline), m)
    sinks.write_site(m, a.out, max(10, a.max_nodes), drift)
    if a.sarif:
        sinks.write_sarif(m, a.sarif)
    if sys.stdout.isatty() and not a.no_open:
        webbrowser.open(Path(a.out, "index.html").resolve().as_uri())
    gates = rules.tripped(rules.scorecard(m), [g.strip() for g in a.fail_on.split(",") if g.strip()])
    for g in gates:
        print(f"gate tripped: {g}", file=sys.stderr)
    return 3 if gates else 0


def main(argv: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 0 if e.code in (0, None) else 2
    try:
        return run(a)
    except (ValueError, OSError) as e:
        spark = session()
        from pyspark.sql import functions as F

        from relscope.functions.scalars import redact

        print(spark.range(1).select(redact(F.lit(str(e))).alias("m")).first()["m"], file=sys.stderr)
        return 2


def run(a: argparse.Namespace) -> int:
    spark = session()
    if a.verb == "scan":
        unknown = [g for g in a.fail_on.split(",") if g.strip() and g.strip() not in rules.GATE_NAMES]
        if unknown:
            raise ValueError(f"unknown gate: {', '.join(unknown)}")
        if not os.path.isdir(a.folder):
            raise ValueError(f"{a.folder}: no such folder")
        patterns = scripts.load_config(a.config, ".", a.folder).exclude_patterns + a.exclude_pattern
        name = os.path.basename(os.path.abspath(a.folder)) or "project"
        units, problems = scripts.read_folder(spark, a.folder, a.exclude, a.dialect)
        return emit(spark, M.build(units, patterns, name, a.folder, problems), a)
    if a.verb == "connect":
        from datetime import datetime, timezone

        from relscope.sources import live

        url = scripts.read_secret(a.conn_file, a.env)
        t = live.jdbc_tables(spark, url, a.timeout)
        rows = {"objects": live.objects(t), "columns": live.columns(t), "primary_keys": live.primary_keys(t), "foreign_keys": live.foreign_keys(t), "modules": live.modules(t), "index_columns": live.index_columns(t)}
        now = datetime.now(timezone.utc)
        here = t("(SELECT DB_ID() AS id, DB_NAME() AS name) d").first()
        queries = {
            "table_stats": live.table_stats, "stats_age": live.stats_age, "fragmentation": live.fragmentation, "proc_stats": lambda t: live.proc_stats(t, here["id"]),
            "index_usage": lambda t: live.index_usage(t, here["id"]), "missing_indexes": lambda t: live.missing_indexes(t, here["id"]), "backups": lambda t: live.backups(t, here["name"]),
        }
        for key, query in queries.items():
            df, ok = live.allowed(spark, lambda query=query: query(t), live.ROWS[key])
            if ok:
                rows[key] = df
        patterns = scripts.load_config(a.config, ".").exclude_patterns + a.exclude_pattern
        return emit(spark, live.build(rows, now, tuple(patterns)), a)
    if a.verb == "from-model":
        sinks.write_site(sinks.read_model(spark, a.model), a.out)
        return 0
    if a.verb == "format":
        changed = 0
        for r in scripts.folder(spark, a.folder, (), a.dialect).where("dialect = 'tsql'").orderBy("rel_path").toLocalIterator():
            new = tsql.format_sql(r["content"])
            if new != r["content"]:
                changed += 1
                print(r["rel_path"])
                if not a.check:
                    with open(os.path.join(a.folder, r["rel_path"]), "w", encoding="utf-8") as f:
                        f.write(new)
        return 3 if a.check and changed else 0
    if a.verb == "impact":
        m = sinks.read_model(spark, a.model)
        found, near = views.find_object(m, a.object)
        if found is None:
            raise ValueError(f"no object {a.object}" + (f"; did you mean {', '.join(near)}?" if near else ""))
        print(sinks.impact_report(m, found), end="")
        return 0
    if a.verb == "query":
        m = sinks.read_model(spark, a.model)
        for r in query_lang.query(views.nodes(m), m.edges.select("src", "dst").distinct(), a.text).collect():
            print(r["path"])
        return 0
    changes = views.drift(sinks.read_model(spark, a.old), sinks.read_model(spark, a.new))
    baseline = sinks.read_baseline(a.baseline) if a.baseline else set()
    text = sinks.diff_markdown(changes, baseline)
    if a.out:
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
    if a.html:
        with open(a.html, "w", encoding="utf-8") as f:
            f.write(sinks.diff_html(changes, baseline))
    if a.write_baseline:
        sinks.write_baseline(changes, a.write_baseline)
    if "breaking-change" in a.fail_on.split(","):
        left = R.change_keys(changes).where(f"risk = {R.BREAKING}").select("key").collect()
        return 3 if any(r["key"] not in baseline for r in left) else 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
