"""Reports, viewers and manifests of a graph."""

from __future__ import annotations

import html
import json
import sys
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork import __version__
from knotwork.functions.text import mermaid_id
from knotwork.operators import analytics
from knotwork.schema import Graph
from knotwork.sources.files import Folder


def viz_nodes(graph: Graph, communities: DataFrame | None = None) -> DataFrame:
    """Rows of the viewer's nodes: id, name, type, community, degree, src."""
    x = graph.nodes.join(analytics.degree(graph.nodes, graph.edges), "id")
    if communities is not None:
        x = x.join(communities.select("id", F.col("community").alias("new")), "id", "left").withColumn("community", F.coalesce("new", "community"))
    return x.select("id", F.coalesce("name", "id").alias("name"), F.coalesce("type", F.lit("?")).alias("type"), "community", "degree", "src", "ord")


def viz_links(graph: Graph) -> DataFrame:
    """Rows of the viewer's links: source, target, type."""
    return graph.edges.select("source", "target", F.coalesce("type", F.lit("edge")).alias("type"), "ord")


def _script_json(value) -> str:
    """JSON that cannot end the script element it stands in."""
    return json.dumps(value).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")


def _page(title: str, head: str, body: str) -> str:
    return f'<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<title>{html.escape(title)}</title>\n{head}</head>\n<body>\n{body}</body>\n</html>\n'


VIEWER = """
const view = d3.select("svg"), box = [innerWidth, innerHeight], layer = view.append("g");
view.attr("viewBox", [0, 0, ...box]).call(d3.zoom().on("zoom", e => layer.attr("transform", e.transform)));
const lines = layer.append("g").attr("stroke", "#89a").attr("stroke-opacity", .4).selectAll("line").data(graph.links).join("line");
const dots = layer.append("g").selectAll("circle").data(graph.nodes).join("circle")
  .attr("r", n => 3 + Math.sqrt(n.degree)).attr("fill", n => d3.schemeTableau10[(n.community ?? 0) % 10]);
dots.append("title").text(n => [n.id, n.type, `community ${n.community}`].join("\\n"));
const layout = d3.forceSimulation(graph.nodes).force("links", d3.forceLink(graph.links).id(n => n.id))
  .force("apart", d3.forceManyBody().strength(-60)).force("middle", d3.forceCenter(box[0] / 2, box[1] / 2)).on("tick", () => {
    lines.attr("x1", l => l.source.x).attr("y1", l => l.source.y).attr("x2", l => l.target.x).attr("y2", l => l.target.y);
    dots.attr("cx", n => n.x).attr("cy", n => n.y);
  });
dots.call(d3.drag().on("drag", (e, n) => { n.fx = e.x; n.fy = e.y; layout.alpha(.3).restart(); }).on("end", (e, n) => { n.fx = n.fy = null; }));
"""


def to_html(graph: Graph, communities: DataFrame | None = None) -> str:
    """A force-directed viewer in one page. A page holds the whole graph, so it is meant for graphs people can look at."""
    nodes = [r.asDict() for r in viz_nodes(graph, communities).orderBy("ord").drop("ord").toLocalIterator()]
    links = [r.asDict() for r in viz_links(graph).orderBy("ord").drop("ord").toLocalIterator()]
    count = len({n["community"] for n in nodes} - {None}) if communities is not None else 0
    info = html.escape(f"{len(nodes)} nodes, {len(links)} edges, {count} communities. Drag a node, scroll to zoom.")
    style = "<style>body{margin:0;background:#fff}svg{width:100vw;height:100vh}p{position:fixed;margin:8px;font:12px sans-serif}</style>\n"
    body = f'<p>{info}</p>\n<svg></svg>\n<script src="https://cdn.jsdelivr.net/npm/d3@7"></script>\n<script>const graph = {_script_json({"nodes": nodes, "links": links})};{VIEWER}</script>\n'
    return _page("Knotwork graph", style, body)


def callflow_nodes(graph: Graph, max_sections: int = 5) -> DataFrame:
    """The nodes of highest degree, ties by first sighting: id, name, mermaid_id, degree, ord."""
    x = analytics.degree(graph.nodes, graph.edges).join(graph.nodes.select("id", "name", "ord"), "id")
    x = x.orderBy(F.desc("degree"), "ord").limit(max(20, 8 * max_sections))
    return x.select("id", F.coalesce("name", "id").alias("name"), mermaid_id(F.col("id")).alias("mermaid_id"), "degree", "ord")


def callflow_edges(graph: Graph, max_sections: int = 5) -> DataFrame:
    """Edges between the callflow's nodes: source_id, target_id (as Mermaid ids), type."""
    top = callflow_nodes(graph, max_sections).select("id", "mermaid_id")
    side = lambda end: top.select(F.col("id").alias(end), F.col("mermaid_id").alias(f"{end}_id"))
    return graph.edges.join(side("source"), "source").join(side("target"), "target").select("source_id", "target_id", F.coalesce("type", F.lit("")).alias("type"), "source", "target", "ord")


def to_callflow_html(graph: Graph, max_sections: int = 5) -> str:
    """A Mermaid diagram of the nodes of highest degree; ids that collide keep their first label."""
    rows = callflow_nodes(graph, max_sections).orderBy(F.desc("degree"), "ord").collect()
    labels = {r.mermaid_id: r.name for r in reversed(rows)}
    order = dict.fromkeys(r.mermaid_id for r in rows)
    lines = ["graph TD", *(f'    {m}["{labels[m].replace(chr(34), chr(39))}"]' for m in order)]
    for e in callflow_edges(graph, max_sections).orderBy("ord").collect():
        lines.append(f"    {e.source_id} {f'-->|{e.type}|' if e.type else '-->'} {e.target_id}")
    summary = html.escape(f"{graph.nodes.count()} nodes total, focused view of top {len(order)} by degree.")
    start = '<script type="module">import mermaid from "https://cdn.jsdelivr.net/npm/mermaid@10/dist/mermaid.esm.min.mjs"; mermaid.initialize({startOnLoad: true});</script>\n'
    return _page("Knotwork callflow", "", f'<h1>Callflow</h1>\n<p>{summary}</p>\n<pre class="mermaid">\n{html.escape(chr(10).join(lines), quote=False)}\n</pre>\n{start}')


def report(graph: Graph, communities: DataFrame | None) -> str:
    """The Markdown report; every table in it is a bounded top list."""
    s = analytics.stats(graph.nodes, graph.edges, communities).first()
    hubs = analytics.hubs(graph.nodes, graph.edges)
    out = ["# Knotwork Graph Report", "", f"- Nodes: **{s.nodes}**", f"- Edges: **{s.edges}**", f"- Communities: **{s.communities}**", ""]

    def section(title: str, *lines: str) -> None:
        if lines:
            out.extend([f"## {title}", "", *lines, ""])

    types = [f"| {r.type} | {r.n} |" for r in analytics.type_counts(graph.nodes).collect()]
    section("Node breakdown by type", *(["| Type | Count |", "|---|---|", *types] if types else []))
    section("Edge confidence", *(f"- **{r.confidence}**: {r.n}" for r in analytics.confidence_counts(graph.edges).collect()))
    gods = [f"| {r.degree} | {r.type} | `{r.name}` | `{r.src or '-'}` |" for r in hubs.orderBy(F.desc("degree"), "id").collect()]
    section("God nodes (top by degree)", *(["| Degree | Type | Name | Source |", "|---|---|---|---|", *gods] if gods else []))
    if communities is not None:
        rows = analytics.community_sizes(graph.nodes, communities).orderBy(F.desc("n"), "community").collect()
        section("Communities", *(f"- **C{r.community}** ({r.n} nodes): " + ", ".join(f"`{x}`" for x in r["sample"]) for r in rows))
        seams = analytics.surprises(graph.nodes, graph.edges, communities).orderBy(F.desc("score"), "ord").collect()
        lines = [f"- `{r.source}` → `{r.target}` (C{r.source_community} → C{r.target_community}, type={r.type})" for r in seams]
        section("Cross-community surprises", *(["Edges that jump between communities — likely architectural seams.", "", *lines] if lines else []))
    section("Suggested first questions", *(f"- {r.question}" for r in analytics.questions(hubs, s.communities).orderBy("pos").collect()))
    return "\n".join([*out, "---", "", "Generated by knotwork."])


def manifest(root: str, stats: dict) -> dict:
    return {"knotwork_version": __version__, "root": root, "generated_at": int(time.time()), "stats": stats}


def write_manifest(out: Folder, root: str, stats: dict) -> None:
    out.write("manifest.json", json.dumps(manifest(root, stats), indent=2))
    out.write(".knotwork_python", f"{sys.executable}\n")
