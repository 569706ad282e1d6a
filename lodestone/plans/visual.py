"""The drawn graph: nodes, links and counts, and one HTML page that shows them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph

#: Kinds of symbols that are drawn, and the kinds of edges.
DRAWN_KINDS = ("class", "interface", "enum")
DRAWN_EDGES = ("IMPORTS", "EXTENDS", "IMPLEMENTS")


def links(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, rel: imports among files, and inheritance among drawn symbols."""
    drawn = symbols.where(F.col("kind").isin(*DRAWN_KINDS)).select("symbol_id")
    imports = edges.where("rel = 'IMPORTS' and src_type = 'file' and dst_type = 'file'")
    inherits = edges.where("rel in ('EXTENDS', 'IMPLEMENTS') and src_type = 'symbol' and dst_type = 'symbol'")
    for end in ("src_id", "dst_id"):
        inherits = inherits.join(drawn.withColumnRenamed("symbol_id", end), end, "left_semi")
    name = lambda end: F.concat_ws(":", f"{end}_type", F.col(f"{end}_id").cast("string"))
    return imports.unionByName(inherits).select(name("src").alias("source"), name("dst").alias("target"), "rel")


def nodes(files: DataFrame, symbols: DataFrame, drawn_links: DataFrame) -> DataFrame:
    """Files that a link touches and all drawn symbols, with their number of links and radius."""
    degree = graph.degree(drawn_links.select(F.col("source").alias("src"), F.col("target").alias("dst"))).toDF("id", "connections")
    of_files = files.select(
        F.concat(F.lit("file:"), F.col("file_id").cast("string")).alias("id"), T.short_path(F.col("path")).alias("label"), F.lit("file").alias("group"), F.col("path").alias("fullPath"),
        F.col("path").alias("filePath"), "lang", F.col("size_bytes").alias("sizeBytes"), F.lit(None).cast("int").alias("startLine"), F.lit(None).cast("int").alias("endLine"),
    ).join(degree, "id")
    owner = files.select("file_id", F.col("path").alias("filePath"))
    of_symbols = (
        symbols.where(F.col("kind").isin(*DRAWN_KINDS))
        .join(owner, "file_id", "left")
        .select(
            F.concat(F.lit("symbol:"), F.col("symbol_id").cast("string")).alias("id"), F.col("name").alias("label"), F.col("kind").alias("group"), F.col("fq_name").alias("fullPath"),
            "filePath", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("long").alias("sizeBytes"), F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"),
        ).join(degree, "id", "left")
        .withColumn("connections", F.coalesce("connections", F.lit(0)))
    )
    every = of_files.unionByName(of_symbols)
    file_radius, symbol_radius = T.clamp(6 + 1.5 * F.col("connections"), 5.0, 22.0), T.clamp(8 + 2.0 * F.col("connections"), 7.0, 22.0)
    return every.withColumn("radius", F.when(F.col("group") == "file", file_radius).otherwise(symbol_radius))


def stats(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts."""
    kinds = symbols.agg(F.count("*").alias("symbols"), *[F.count_if(F.col("kind") == k).alias(n) for k, n in zip(DRAWN_KINDS, ("classes", "interfaces", "enums"), strict=True)])
    return files.agg(F.count("*").alias("files")).crossJoin(kinds).crossJoin(edges.agg(F.count("*").alias("edges")))


def find(drawn: DataFrame, text: str) -> DataFrame:
    """Nodes whose label or path holds a text, in any case."""
    low = F.lit(text.lower())
    return drawn.where(F.contains(F.lower("label"), low) | F.contains(F.lower(F.coalesce("fullPath", F.lit(""))), low))


def counted(n: Column, one: str, many: str) -> Column:
    """A number and what it counts, in the singular where it is 1."""
    return F.concat(n.cast("string"), F.when(n == 1, f" {one}").otherwise(f" {many}"))


_PAGE = """<!doctype html><meta charset="utf-8"><title>Code graph</title>
<style>body{margin:0;font:13px sans-serif}#bar{position:fixed;padding:8px;background:#fffd}svg{width:100vw;height:100vh}line{stroke:#bbb}.EXTENDS,.IMPLEMENTS{stroke:#c60}text{pointer-events:none}.dim{opacity:.1}</style>
<div id=bar><input id=find placeholder="Find"> <span id=stats></span> <span id=kinds></span> <b id=info></b></div><svg><g></g></svg>
<script id=data type="application/json">__DATA__</script>
<script>
const data = JSON.parse(document.getElementById('data').textContent), svg = document.querySelector('svg'), layer = svg.firstChild
const make = (tag, attributes, parent) => { const e = document.createElementNS('http://www.w3.org/2000/svg', tag); for (const k in attributes) e.setAttribute(k, attributes[k]); parent.append(e); return e }
const colours = { file: '#48c', class: '#4a4', interface: '#a4a', enum: '#ca4' }, byId = new Map(), hidden = new Set()
data.nodes.forEach((n, i) => { const r = 30 * Math.sqrt(i + 1), a = i * 2.4; n.x = innerWidth / 2 + r * Math.cos(a); n.y = innerHeight / 2 + r * Math.sin(a); byId.set(n.id, n) })
for (let round = 0; round < 120; round++) for (const l of data.links) { const a = byId.get(l.source), b = byId.get(l.target), dx = b.x - a.x, dy = b.y - a.y, d = Math.hypot(dx, dy) || 1, pull = (d - 90) / d * .05; a.x += dx * pull; a.y += dy * pull; b.x -= dx * pull; b.y -= dy * pull }
for (const l of data.links) l.line = make('line', { class: l.rel }, layer)
for (const n of data.nodes) { n.dot = make('circle', { r: n.radius, fill: colours[n.group] }, layer); n.name = make('text', { 'font-size': 10 }, layer); n.name.textContent = n.label
  n.dot.onmouseenter = () => { document.getElementById('info').textContent = n.fullPath + (n.startLine ? ' ' + n.startLine + '-' + n.endLine : '') + ' (' + n.connections + ')'; const near = new Set([n.id]); data.links.forEach(l => { if (l.source === n.id) near.add(l.target); if (l.target === n.id) near.add(l.source) }); mark(m => near.has(m.id)) }
  n.dot.onmouseleave = () => mark(() => true)
  n.dot.onpointerdown = e => { svg.onpointermove = m => { n.x = m.clientX; n.y = m.clientY; draw() }; svg.onpointerup = () => { svg.onpointermove = null } } }
function mark(keep) { for (const n of data.nodes) { n.dot.classList.toggle('dim', !keep(n)); n.name.classList.toggle('dim', !keep(n)) } }
function draw() { for (const n of data.nodes) { n.dot.setAttribute('cx', n.x); n.dot.setAttribute('cy', n.y); n.name.setAttribute('x', n.x + n.radius); n.name.setAttribute('y', n.y); n.dot.style.display = n.name.style.display = hidden.has(n.group) ? 'none' : '' }
  for (const l of data.links) { const a = byId.get(l.source), b = byId.get(l.target); l.line.setAttribute('x1', a.x); l.line.setAttribute('y1', a.y); l.line.setAttribute('x2', b.x); l.line.setAttribute('y2', b.y); l.line.style.display = hidden.has(a.group) || hidden.has(b.group) ? 'none' : '' } }
document.getElementById('find').oninput = e => { const w = e.target.value.toLowerCase(); mark(n => !w || n.label.toLowerCase().includes(w) || n.fullPath.toLowerCase().includes(w)) }
document.getElementById('stats').textContent = Object.entries(data.stats).map(([k, v]) => v + ' ' + k).join(', ')
for (const k in colours) { const b = document.createElement('button'); b.textContent = k; b.onclick = () => { hidden.has(k) ? hidden.delete(k) : hidden.add(k); draw() }; document.getElementById('kinds').append(b) }
draw()
</script>
"""


def page(found_nodes: DataFrame, found_links: DataFrame, counts: DataFrame, root: str) -> str:
    """One page with the graph in it.  A picture is of one repository; its rows go to the driver one at a time."""
    rows = lambda df: [r.asDict() for r in df.toLocalIterator()]
    data = {"nodes": rows(found_nodes.orderBy("group", "fullPath", "id")), "links": rows(found_links.orderBy("source", "target", "rel")), "stats": counts.first().asDict(), "repoPath": root}
    # A name may hold anything, so nothing in it may end the script element.
    return _PAGE.replace("__DATA__", json.dumps(data).replace("<", "\\u003c"))
