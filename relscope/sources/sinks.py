"""Sinks of a model: JSON documents, SARIF, diff reports, diagrams, assets and a static site.

What grows with the model is written from partitions (see `documents`); diagrams and reports of one question are capped or
small and made in the driver. Tables are written as Parquet by `write_parquet`.
"""

from __future__ import annotations

import hashlib
import html
import json
import os
import tempfile
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relscope.functions import scalars as S
from relscope.operators import graph as G
from relscope.operators import model as M
from relscope.operators import relational as R
from relscope.operators import rules, views
from relscope.operators.rules import RULES
from relscope.operators.model import Model
from relscope.sources import documents


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.title() for x in rest)


def snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


def _keyed(value, key):
    if isinstance(value, dict):
        return {key(k): _keyed(v, key) for k, v in value.items()}
    return [_keyed(v, key) for v in value] if isinstance(value, list) else value


ORDERS = {
    "files": ["rel_path"], "objects": ["defined_in_slug", "defined_at_line", "id"], "foreign_keys": ["from_object_id", "to_object_id", "name"], "dependencies": ["from_object_id", "to_object_id", "kind", "external_target"],
    "crud": ["target", "actor"], "findings": ["severity", "rule_id", "object_id", "message"], "diagnostics": ["message"], "object_stats": ["object_id"], "index_stats": ["object_id", "index_name"],
    "missing_indexes": ["object_id", "impact_score"], "stale_statistics": ["object_id", "stats_name"], "fragmented_indexes": ["object_id", "index_name"],
}


def _camel_type(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(camel(f.name), _camel_type(f.dataType), True) for f in kind])
    return T.ArrayType(_camel_type(kind.elementType)) if isinstance(kind, T.ArrayType) else kind


def _camel_rows(df: DataFrame) -> DataFrame:
    """(text): rows as JSON objects with camel-case keys at all depths."""
    return documents.json_rows(df, *[F.col(f.name).cast(_camel_type(f.dataType)).alias(camel(f.name)) for f in df.schema])


def _list(name: str, rows: DataFrame) -> list[str | DataFrame]:
    return [f"{json.dumps(name)}:[\n", rows, "\n]"]


def write_model(m: Model, path: str) -> None:
    """One JSON document, its rows written by the tasks that have them."""
    pieces: list[str | DataFrame] = ["{" + "".join(f"{json.dumps(camel(k))}:{json.dumps(v, ensure_ascii=False)},\n" for k, v in m.meta.items())]
    for i, (name, order) in enumerate(ORDERS.items()):
        pieces += [",\n" if i else "", *_list(camel(name), _camel_rows(getattr(m, name).orderBy(*order)))]
    documents.join(path, *pieces, "}\n", separator=",\n")


def read_model(spark: SparkSession, path: str) -> Model:
    """A model that write_model wrote; an older version is filled up with defaults, a newer one raises ValueError."""
    doc = json.load(open(path, encoding="utf-8"))
    meta = {snake(k): v for k, v in doc.items() if not isinstance(v, list)}
    if int(meta.get("schema_version") or 0) > M.SCHEMA_VERSION:
        raise ValueError(f"{path}: schema version {meta['schema_version']} is newer than {M.SCHEMA_VERSION}")
    m = M.empty_model(spark, **meta | {"schema_version": M.SCHEMA_VERSION})
    return M.normalized(M.with_rows(m, spark, **{name: [_keyed(r, snake) for r in doc.get(camel(name), [])] for name in ORDERS}))


def write_parquet(m: Model, folder: str) -> None:
    for name in M.TABLES:
        getattr(m, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def read_parquet(spark: SparkSession, folder: str, **meta) -> Model:
    return replace(M.empty_model(spark, **meta), **{name: spark.read.parquet(f"{folder}/{name}") for name in M.TABLES})


SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/Schemata/sarif-schema-2.1.0.json"


def write_sarif(m: Model, path: str) -> None:
    """The findings as a SARIF 2.1.0 log, written from partitions; the driver sees the ids of the rules that found something."""
    files = R.keep_first(m.files.select("slug", "rel_path"), ["slug"], ["rel_path"])
    rows = m.findings.join(files, "slug", "left").orderBy("severity", "rule_id", "object_id", "message")
    place = F.struct(F.struct(F.col("rel_path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.lit(1), "line").alias("startLine")).alias("region"))
    places = F.when(F.col("rel_path").isNotNull(), F.array(F.struct(place.alias("physicalLocation"))))
    results = rows.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), S.sarif_level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), places.alias("locations"))).alias("text"))
    known = {r.id: r for r in RULES}
    told = lambda i: {"id": i} | ({"shortDescription": {"text": known[i].title}, "fullDescription": {"text": known[i].why}, "help": {"text": known[i].remedy}} if i in known else {})
    ids = sorted(r["rule_id"] for r in m.findings.select("rule_id").distinct().collect())  # as many as there are rules
    head = {"$schema": SARIF_SCHEMA, "version": "2.1.0"}
    tool = {"driver": {"name": "relscope", "rules": [told(i) for i in ids]}}
    documents.join(path, json.dumps(head)[:-1] + ', "runs":[{"tool":' + json.dumps(tool, ensure_ascii=False) + ', "results":[\n', results, "\n]}]}\n", separator=",\n")


def sarif(m: Model) -> dict:
    """The log as an object, for models whose findings fit the driver."""
    with tempfile.TemporaryDirectory() as folder:
        write_sarif(m, f"{folder}/log.sarif")
        return json.load(open(f"{folder}/log.sarif", encoding="utf-8"))


def write_json(value, path: str, prefix: str = "", suffix: str = "") -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(prefix + json.dumps(value, indent=None if prefix else 2, ensure_ascii=False) + suffix)


def _changes(changes: DataFrame, baseline: set[str]) -> list[dict]:
    rows = R.change_keys(changes).orderBy(F.desc("risk"), "target", "kind").collect()
    return [r.asDict() | {"suppressed": r["key"] in baseline} for r in rows]


def diff_markdown(changes: DataFrame, baseline: set[str] = frozenset()) -> str:
    rows, out = _changes(changes, baseline), ["# Schema diff", ""]
    if not rows:
        return "\n".join([*out, "No schema changes detected.", ""])
    for risk, name in R.RISKS.items():
        mine = [r for r in rows if r["risk"] == risk]
        if mine:
            out += [f"## {name}", ""]
            for r in mine:
                text = f"`{r['kind']}` **{r['target']}** — {r['detail']}"
                out.append(f"- ~~{text}~~ (baselined)" if r["suppressed"] else f"- {text}")
            out.append("")
    return "\n".join(out)


def diff_html(changes: DataFrame, baseline: set[str] = frozenset()) -> str:
    rows = _changes(changes, baseline)
    if not rows:
        return "<p>No schema changes detected.</p>"
    e = html.escape
    line = lambda r: f"<tr{' class=baselined' if r['suppressed'] else ''}><td>{R.RISKS[r['risk']]}</td><td>{e(r['kind'])}</td><td>{e(r['target'])}</td><td>{e(r['detail'])}</td></tr>"
    return "<table><tr><th>Risk</th><th>Change</th><th>Target</th><th>Detail</th></tr>" + "".join(map(line, rows)) + "</table>"


def write_baseline(changes: DataFrame, path: str) -> None:
    keys = R.change_keys(changes).select("key").distinct().orderBy("key")
    documents.join(path, "[\n", keys.select(F.to_json(F.struct("key")).alias("j")).select(F.regexp_extract("j", r'^\{"key":(.*)\}$', 1).alias("text")), "\n]\n", separator=",\n")


def read_baseline(path: str) -> set[str]:
    return set(json.load(open(path, encoding="utf-8")))


def node_id(object_id: str) -> str:
    return "n" + hashlib.sha256(object_id.encode()).hexdigest()[:12]


def _label(text: str) -> str:
    return text.replace('"', "'")


def _word(text: str) -> str:
    return "".join(c for c in text if c.isalnum()) or "_"


def _capped(objects: DataFrame, edges: DataFrame, k: int) -> tuple[list, int]:
    n = objects.count()
    shown = R.most_connected(objects, edges, k) if n > max(10, k) else objects.orderBy("id")
    return shown.collect(), n


def _among(edges: DataFrame, a: str, b: str, shown: set[str]) -> DataFrame:
    """Edges both of whose ends are among the objects that a diagram shows, a few dozen at most."""
    return edges.where(F.col(a).isin(list(shown)) & F.col(b).isin(list(shown)))


def er_diagram(m: Model, max_nodes: int = 60) -> str:
    """Mermaid text of the tables and foreign keys, the most connected tables first."""
    tables = R.of_kind(m.objects, "table")
    keys = m.foreign_keys.where("to_object_id <> ''")
    shown, n = _capped(tables, keys.select(F.col("from_object_id").alias("src"), F.col("to_object_id").alias("dst")), max_nodes)
    out, ids = ["erDiagram"], {r["id"] for r in shown}
    for r in shown:
        primary = {c.lower() for c in r["primary_key"]}
        out.append(f'  {node_id(r["id"])}["{_label(r["schema"])}.{_label(r["name"])}"] {{')
        out += [f"    {_word(c['data_type'])} {_word(c['name'])}{' PK' if c['name'].lower() in primary else ''}" for c in r["columns"][:20]]
        out.append("  }")
    for k in _among(keys, "from_object_id", "to_object_id", ids).orderBy("from_object_id", "to_object_id", "name").collect():
        if k["from_object_id"] in ids:
            out.append(f'  {node_id(k["to_object_id"])} ||--o{{ {node_id(k["from_object_id"])} : "{_label(k["name"])}"')
    return "\n".join([*out, *([f"%% showing {len(shown)} of {n} tables (most-connected first)"] if len(shown) < n else [])]) + "\n"


def inferred_diagram(m: Model, max_nodes: int = 60) -> str:
    found = views.relationships(m)
    pairs = found.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    touched = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    tables = R.of_kind(m.objects, "table")
    some = tables if touched.isEmpty() else tables.join(touched, "id", "left_semi")
    shown, n = _capped(some, pairs, max_nodes)
    out, ids = ["erDiagram"], {r["id"] for r in shown}
    for r in shown:
        out += [f'  {node_id(r["id"])}["{_label(r["schema"])}.{_label(r["name"])}"] {{', '    string _ ""', "  }"]
    for r in _among(found, "from_id", "to_id", ids).orderBy("from_id", "from_column").collect():
        if r["from_id"] in ids:
            out.append(f'  {node_id(r["to_id"])} |o..o{{ {node_id(r["from_id"])} : "{_label(r["from_column"])} ({r["confidence"]})"')
    return "\n".join([*out, *([f"%% showing {len(shown)} of {n} related tables (most-connected first)"] if len(shown) < n else [])]) + "\n"


def dependency_diagram(m: Model, max_nodes: int = 60) -> str:
    edges = m.edges.where(F.col("kind").isin(views.DRAWN_KINDS)).select("src", "dst", "kind").dropDuplicates(["src", "dst"])
    shown, n = _capped(m.objects, edges, max_nodes)
    ids = {r["id"] for r in shown}
    out = ["flowchart LR"] + [f'  {node_id(r["id"])}["{_label(r["schema"])}.{_label(r["name"])}"]' for r in shown]
    for e in _among(edges, "src", "dst", ids).orderBy("src", "dst").collect():
        if e["src"] in ids:
            out.append(f"  {node_id(e['src'])} -->|{e['kind']}| {node_id(e['dst'])}")
    return "\n".join([*out, *([f"%% showing {len(shown)} of {n} objects (most-connected first)"] if len(shown) < n else [])]) + "\n"


def graph_rows(m: Model) -> tuple[DataFrame, DataFrame]:
    """(text) of the graph's nodes and of its edges, each in order."""
    nodes = views.nodes(m).orderBy("id")
    own = {"id": "id", "label": "path", "path": "path", "folder": "schema", "lang": "kind", "loc": "loc", "cog": "cog", "fanIn": "fan_in", "fanOut": "fan_out", "href": "href", "execs": "execs"}
    edges = m.edges.orderBy("src", "dst", "kind")
    return documents.json_rows(nodes, *[F.col(c).alias(k) for k, c in own.items()]), documents.json_rows(edges, F.col("src").alias("source"), F.col("dst").alias("target"), "kind")


def write_graph(m: Model, path: str, prefix: str = "", suffix: str = "") -> None:
    nodes, edges = graph_rows(m)
    documents.join(path, prefix + "{", *_list("nodes", nodes), ",", *_list("edges", edges), "}" + suffix, separator=",\n")


def graph_payload(m: Model) -> dict:
    """The graph as an object, for models that fit the driver."""
    nodes, edges = graph_rows(m)
    return {"nodes": [json.loads(r["text"]) for r in nodes.collect()], "edges": [json.loads(r["text"]) for r in edges.collect()]}


def detail_rows(m: Model) -> DataFrame:
    """(id, text): what an object's panel shows, as JSON."""
    found = m.findings.groupBy(F.col("object_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("severity", "rule_id", "title", "message"))).alias("findings"))
    columns = F.transform("columns", lambda c: F.struct(c["name"].alias("name"), c["data_type"].alias("type"), c["nullable"].alias("nullable"), F.array_contains(S.lowered(F.col("primary_key")), F.lower(c["name"])).alias("pk")))
    told = F.coalesce(F.transform("findings", lambda f: F.struct(f["severity"].alias("severity"), f["rule_id"].alias("ruleId"), f["title"].alias("title"), f["message"].alias("message"))), F.array().cast("array<struct<severity:int,ruleId:string,title:string,message:string>>"))
    slug = F.col("defined_in_slug")
    body = F.struct("id", "kind", "purpose", slug.alias("definedInSlug"), columns.alias("columns"), told.alias("findings"), F.concat(F.lit("files/"), slug, F.lit(".html")).alias("file"))
    return m.objects.join(found, "id", "left").orderBy("id").select("id", F.to_json(body, {"ignoreNullFields": "false"}).alias("text"))


def object_details(m: Model) -> dict:
    """The panels as an object, for models that fit the driver."""
    return {r["id"]: json.loads(r["text"]) for r in detail_rows(m).collect()}


def write_details(m: Model, path: str) -> None:
    name = F.regexp_extract(F.to_json(F.struct("id")), r'^\{"id":(.*)\}$', 1)
    documents.join(path, "window.OBJECTS={\n", detail_rows(m).select(F.concat(name, F.lit(":"), "text").alias("text")), "\n};", separator=",\n")


def impact_report(m: Model, object_id: str) -> str:
    rows = views.impact(m, object_id).collect()
    out = [f"{object_id}: {len(rows)} dependent object(s)"]
    for r in rows:
        out.append("  " * r["depth"] + f"{r['object_id']} ({r['via_kind']})" + (f" {r['execs']:,} executions" if r["execs"] >= 0 else ""))
    if any(r["capped"] for r in rows):
        out.append(f"(stopped at depth {G.DEPTH_CAP})")
    return "\n".join(out) + "\n"


def _page(title: str, *body: str | DataFrame) -> list[str | DataFrame]:
    return [f"<!DOCTYPE html><html lang=en><head><meta charset=utf-8><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>", *body, "</body></html>"]


def _file_pages(m: Model) -> DataFrame:
    """(path, text): the page of each script with its objects."""
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), S.html_encode(F.coalesce(F.col(c), F.lit(""))), F.lit("</td>")) for c in ("id", "kind", "purpose")], F.lit("</tr>"))
    own = m.objects.groupBy(F.col("defined_in_slug").alias("slug")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("defined_at_line", "id", row.alias("row")))), lambda x: x["row"]), "\n").alias("rows"))
    title, purpose = S.html_encode(F.col("rel_path")), S.html_encode(F.col("purpose"))
    text = F.concat(
        F.lit("<!DOCTYPE html><html lang=en><head><meta charset=utf-8><title>"), title, F.lit("</title></head><body><h1>"), title, F.lit("</h1><p>"), purpose,
        F.lit("</p><table><tr><th>id</th><th>kind</th><th>purpose</th></tr>\n"), F.coalesce("rows", F.lit("")), F.lit("</table></body></html>"),
    )
    return m.files.select("slug", "rel_path", "purpose").join(own, "slug", "left").select(F.concat(F.lit("files/"), S.uri_escape(F.col("slug")), F.lit(".html")).alias("path"), text.alias("text"))


def write_site(m: Model, out: str, max_nodes: int = 60, drift: DataFrame | None = None) -> list[str]:
    """A page for each report and each file, with the assets; returns the names of the pages.

    Tables are whole and written by tasks; only the capped diagrams are made in the driver.
    """
    pre = lambda text: [f"<pre class=mermaid>{html.escape(text)}</pre>"]
    domain_counts, cross = views.domains(m)
    matrix, blind = views.crud(m)
    bands, findings = views.lint(m)
    table = documents.table
    many = lambda d: [x for k, v in d.items() for x in (f"<h2>{k}</h2>", *table(v))]
    grade = views.grade(m)
    pages = {
        "index": [f"<p class=grade>Overall grade: {grade}</p>", *table(views.overview(m)), *table(views.dialect_mix(m)), *table(views.diagnostics(m))], "objects": table(views.objects(m)), "domains": [*table(domain_counts), *table(cross)],
        "er": pre(er_diagram(m, max_nodes)), "dependencies": pre(dependency_diagram(m, max_nodes)), "relationships": [*pre(inferred_diagram(m, max_nodes)), *table(views.relationships(m))], "crud": [*table(matrix), *table(blind)],
        "lint": [*table(bands), *table(findings)], "scorecard": table(rules.scorecard(m)), "metrics": many(views.metrics(m)), "activity": many(views.activity(m)), "indexes": many(views.indexes(m)), "config": table(views.secrets(m)),
        "drift": [diff_html(drift)] if drift is not None else ["<p>No baseline was given.</p>"],
    }
    for name, body in pages.items():
        documents.join(os.path.join(out, f"{name}.html"), *_page(name.title(), *body))
    documents.write_files(_file_pages(m), out)
    entry = F.to_json(F.array("kind", "name", "detail", "href")).alias("text")
    documents.join(os.path.join(out, "assets", "search-index.js"), "window.SEARCH_INDEX=[\n", views.search_index(m).select(entry), "\n];", separator=",\n")
    write_graph(m, os.path.join(out, "graph.json"))
    write_graph(m, os.path.join(out, "assets", "graph-data.js"), "window.GRAPH=", ";")
    write_details(m, os.path.join(out, "assets", "object-details.js"))
    write_model(m, os.path.join(out, "model.json"))
    return sorted(pages)
