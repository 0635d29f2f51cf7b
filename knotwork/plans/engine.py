"""The engine: build, update, cluster, query and export a graph kept in an output directory."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import code
from knotwork.operators import community, incremental, merge, render
from knotwork.runtime import cut
from knotwork.schema import Graph
from knotwork.sources import discover, extract, nodelink, places, sinks, store
from knotwork.sources.files import Folder


def output_dir(override: str | Path | None = None) -> str | Path:
    """The given directory, else KNOTWORK_OUT, else knotwork-out in the working directory; a URI of any store stays as it is."""
    given = override or os.environ.get("KNOTWORK_OUT") or Path.cwd() / "knotwork-out"
    return given if "://" in str(given) else Path(given).expanduser().resolve()


class ShrinkError(RuntimeError):
    """The new graph is much smaller than the one it would replace."""


class Engine:
    def __init__(self, spark: SparkSession, out: str | Path | None = None, cache_by_content: bool = False):
        self.spark, self.out = spark, output_dir(out)
        self.folder = Folder(spark, self.out)
        code.register(spark)
        self.cache = store.Cache(spark, Folder(spark, self.folder.at("cache")), cache_by_content)

    # state

    def graph(self, path: str | None = None) -> Graph:
        """The stored graph, or the one of a node-link file."""
        if path is not None:
            return nodelink.load(self.spark, path)
        if not store.has_graph(self.folder):
            raise FileNotFoundError(f"no graph in {self.out}; build one first")
        return store.load_graph(self.spark, self.folder)

    def _files(self, root: str | Path) -> DataFrame:
        """The files of the tree, in walk order."""
        return discover.discover(self.spark, root, frozenset() if "://" in str(self.out) else frozenset({os.path.realpath(self.out)}))

    def _extracted(self, files: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """The present files with their hashes, and their rows: those of the cache, as they are needed, and new ones; number of the files extracted."""
        contents = cut(discover.with_contents(files))
        hits, misses = self.cache.split(contents)
        misses = cut(misses)
        changed = misses.count()
        here = contents.select("rel", "sha256", "file_ord")
        if not changed:
            return here, hits, 0
        hits, new = cut(hits) if self.cache.by_content else hits, cut(extract.extracted(misses))
        self.cache.add(new)
        return here, hits.unionByName(new), changed

    @staticmethod
    def _merged(rows: DataFrame) -> Graph:
        rows = cut(rows)
        built = merge.build(extract.nodes_of(rows), extract.edges_of(rows))
        return Graph(cut(built.nodes), cut(built.edges))

    def _merged_anew(self, known: DataFrame, here: DataFrame) -> tuple[Graph, int] | None:
        """The stored graph with the ids of changed files merged anew, and their number; None where rows of old files are no longer known."""
        gone, came = cut(known.join(here, ["rel", "sha256"], "left_anti")), cut(here.join(known, ["rel", "sha256"], "left_anti"))
        rows = self.cache.rows()
        left = cut(rows.join(gone.select("rel", "sha256"), ["rel", "sha256"], "left_semi"))
        if not gone.join(left.select("rel").distinct(), "rel", "left_anti").isEmpty():
            return None
        new = cut(rows.join(came.select("rel", "sha256"), ["rel", "sha256"], "left_semi"))
        both = lambda x: Graph(extract.nodes_of(x), extract.edges_of(x))
        touched = incremental.Touched.by(both(left), both(new))
        # rows of touched ids are found before their files are, so other rows are only scanned
        shown = touched.ids.within(rows.where("id IS NOT NULL")).unionByName(touched.near(rows.where("source IS NOT NULL")))
        before = self.graph()
        before = Graph(before.nodes.withColumn("community", F.lit(None).cast("int")), before.edges)
        return incremental.merged(before, touched, both(self.cache.at_places(shown, here))).graph, touched.ids.count

    def _write(self, graph: Graph, communities: DataFrame | None, root: str | Path, viz: bool, stats: dict, files: DataFrame) -> dict:
        if communities is not None:
            graph = Graph(community.attached(graph.nodes, communities), graph.edges)
        graph = store.save_graph(graph, self.folder, files)
        nodelink.save(graph, self.folder.at("graph.json"))
        self.folder.write("GRAPH_REPORT.md", sinks.report(graph, communities))
        if viz:
            self.folder.write("graph.html", sinks.to_html(graph, communities))
        count = communities.select("community").distinct().count() if communities is not None else 0
        stats = {"nodes": graph.nodes.count(), "edges": graph.edges.count(), "communities": count} | stats
        sinks.write_manifest(self.folder, str(Path(root).resolve()), stats)
        return stats

    # commands

    def build(self, root: str | Path = ".", viz: bool = True, cluster: bool = True, force: bool = False) -> dict:
        """Scan, extract, merge, cluster and write everything; refuses to replace a much larger graph unless forced."""
        files = places.fresh(self._files(root))
        here, rows, changed = self._extracted(files)
        n_files, graph = files.count(), self._merged(rows)
        if store.has_graph(self.folder) and not force:
            prior, new = self.graph().nodes.count(), graph.nodes.count()
            if store.shrinks(prior, new):
                raise ShrinkError(f"the new graph has {new} nodes, the stored one {prior}; use force to replace it")
        communities = cut(community.communities(graph)) if cluster else None
        return self._write(graph, communities, root, viz, {"files_scanned": n_files, "cache_hits": n_files - changed}, here)

    def update(self, root: str | Path = ".", cluster: bool = True) -> dict:
        """Extract and merge what changed; report and viewer are refreshed, the guard does not apply.

        Ids that changed files show, before or after, are merged anew from the cache (``merged_ids``); all others keep their
        rows. The graph is merged whole where places of files changed, the extractor has another version, the cache no longer
        knows the old rows, or it is kept by content.
        """
        found, known = self._files(root), store.load_files(self.spark, self.folder)
        stable = known is not None and not self.cache.by_content and known.where(F.col("version") != str(extract.VERSION)).isEmpty()
        files, stable = places.placed(found, known) if stable else (places.fresh(found), False)
        here, rows, changed = self._extracted(files)
        anew = self._merged_anew(known, here) if stable else None
        graph, n = anew or (self._merged(rows), None)
        graph = Graph(cut(graph.nodes), cut(graph.edges)) if cluster else graph
        communities = cut(community.communities(graph)) if cluster else None
        stats = {"files_scanned": found.count(), "changed_files": changed, "merged_ids": graph.nodes.count() if n is None else n}
        return self._write(graph, communities, root, self.folder.exists("graph.html"), stats, here)

    def recluster(self, resolution: float = 1.0, path: str | None = None) -> int:
        """New communities for the stored graph, or for a node-link file, which is written back; returns their number."""
        graph = self.graph(path)
        graph = Graph(cut(graph.nodes), cut(graph.edges))
        found = cut(community.communities(graph, resolution))
        graph = Graph(community.attached(graph.nodes, found), graph.edges)
        if path is None:
            graph = store.save_graph(graph, self.folder)
        nodelink.save(graph, path or self.folder.at("graph.json"))
        return found.select("community").distinct().count()

    def query(self, question: str, depth: int = 3, budget: int = render.FIXED_BUDGET, strategy: str = "bfs", path: str | None = None) -> str:
        return render.answer(self.graph(path), question, depth, budget, strategy)

    def explain(self, node: str, path: str | None = None) -> str:
        return render.explain(self.graph(path), node)

    def path(self, source: str, target: str, path: str | None = None) -> str:
        return render.path(self.graph(path), source, target)

    def affected(self, node: str, depth: int = 2, path: str | None = None) -> str:
        return render.affected(self.graph(path), node, depth)

    def export_callflow(self, output: str | Path | None = None, max_sections: int = 5) -> str | Path:
        dest = output_dir(output) if output else self.folder.at("callflow.html") if "://" in str(self.out) else self.out / "callflow.html"
        folder, name = os.path.split(os.fspath(dest))
        Folder(self.spark, folder).write(name, sinks.to_callflow_html(self.graph(), max_sections))
        return dest

    def communities(self) -> DataFrame:
        """(community, id) of the stored graph."""
        return self.graph().nodes.where(F.col("community").isNotNull()).select("community", "id")
