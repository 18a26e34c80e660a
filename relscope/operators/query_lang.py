"""The graph query language: one line, aliases first, then the first form that fits.

nodes: (id, schema, path, kind, loc, cog, fan_in, fan_out), path is schema.name; edges: (src, dst). The result is the
matching nodes by path, or the steps of a path in order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relscope.operators import graph as G
from relscope.operators import graph_sets
from relscope.operators import relational as R

# Other names of the forms.
ALIASES = {
    "schema": "folder", "kind": "lang", "references": "imports", "reads": "imports", "usedby": "importedby", "referencedby": "importedby", "readby": "importedby", "writtenby": "importedby",
    "writes": "importedby", "affects": "reaches", "affectedby": "reachedby",
}
FIELDS = {"loc": "loc", "cog": "cog", "fanin": "fan_in", "fanout": "fan_out"}
NUMERIC = re.compile(r"(loc|cog|fanin|fanout)\s*(>=|<=|>|<|=)\s*(\d+(?:\.\d+)?)", re.I)
FORM = re.compile(r"([a-z]+)\s*:\s*(.+)", re.I | re.S)


def matching(nodes: DataFrame, text: str) -> DataFrame:
    return R.search_rows(nodes, "path", text.strip())


def query(nodes: DataFrame, edges: DataFrame, text: str, strict: bool = True) -> DataFrame:
    """Answer a query; raises ValueError for text that is no query.

    As documented elsewhere, orphans are nodes without any edge and `affects:` follows outgoing edges; strict=False takes
    the plain meanings instead: nodes that nothing references, and what depends on a node.
    """
    text = text.strip()
    by_path = lambda d: d.orderBy("path", "id")
    if m := NUMERIC.fullmatch(text):
        return by_path(R.compare(nodes, FIELDS[m[1].lower()], m[2], float(m[3])))
    if m := re.fullmatch(r"orphans(?:\s+in\s+(.+))?", text, re.I | re.S):
        found = G.orphans(nodes, edges, referenced_only=not strict)
        if m[1]:
            x = m[1].strip().lower()
            found = found.where((F.lower("schema") == x) | F.contains(F.lower("path"), F.lit(x)))
        return by_path(found)
    m = FORM.fullmatch(text)
    if not m:
        raise ValueError(f"not a query: {text}")
    given, rest = m[1].lower(), m[2].strip()
    form = ALIASES.get(given, given)
    if form == "folder":
        return by_path(nodes.where(F.lower("schema") == rest.lower()))
    if form == "lang":
        return by_path(R.search_rows(nodes, "kind", rest))
    if form == "path":
        ends = rest.split()
        if len(ends) != 2:
            raise ValueError("path: takes two names")
        first = [matching(nodes, e).orderBy("path", "id").first() for e in ends]
        steps = G.shortest_path(edges, first[0]["id"], first[1]["id"]) if all(first) else []
        order = nodes.sparkSession.createDataFrame(list(enumerate(steps)), "step int, id string")
        return order.join(nodes, "id").orderBy("step")
    anchors = matching(nodes, rest).select("id")
    if form in ("imports", "importedby"):
        ids = G.neighbours(edges, anchors, form == "imports")
    elif form in ("reaches", "reachedby"):
        forward = (form == "reaches") != (not strict and given in ("affects", "affectedby"))
        ids = graph_sets.closures(edges, anchors.toDF("seed"), forward).pairs().where("id <> seed").select("id").distinct()
    else:
        raise ValueError(f"unknown form: {given}")
    return by_path(nodes.join(ids, "id", "left_semi"))
