"""Column layout of files, extractions, nodes and edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

#: The place of a first sighting: file, nodes before edges, number in its list, endpoint. Compared as a struct, it gives a
#: total order without any global sort.
ORD = "ord struct<file_ord:bigint,phase:int,ordinal:bigint,sub:int>"
NODE_ATTRIBUTES = ("type", "name", "src", "language", "level", "line", "confidence", "community", "extras")
EDGE_ATTRIBUTES = ("type", "symbol", "src", "line", "confidence", "extras")
NODES = f"id string, type string, name string, src string, language string, level int, line int, confidence string, community int, extras map<string,string>, {ORD}"
EDGES = f"source string, target string, type string, symbol string, src string, line int, confidence string, extras map<string,string>, {ORD}"
FILES = "file_ord long, rel string, path string, kind string, suffix string"
CONTENTS = "file_ord long, rel string, kind string, suffix string, sha256 string, content string"
#: One table for both: ``id`` is set for nodes, ``source`` and ``target`` for edges.
EXTRACTED = (
    "rel string, sha256 string, id string, source string, target string, type string, name string, symbol string, src string, "
    f"language string, level int, line int, confidence string, error string, {ORD}"
)


@dataclass(frozen=True)
class Graph:
    """A directed simple graph: ``nodes`` (one row an id) and ``edges`` (one row a (source, target))."""

    nodes: DataFrame
    edges: DataFrame
