"""Reading and writing graphs: GraphML, edge lists, node-link JSON, Parquet."""

from deltamesh.sources.formats import GraphFormatError, detect_format, discover_graphs, provenance, read_graph, write_graph

__all__ = ["GraphFormatError", "detect_format", "discover_graphs", "provenance", "read_graph", "write_graph"]
