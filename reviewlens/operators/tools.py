"""The tools that a reviewing agent may call: six names, each an argument to a table, over one project's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.operators import diff, facts, graph, retrieval
from reviewlens.sources.readers import guarded

Tool = Callable[[str], DataFrame]


@dataclass
class Project:
    """What the tools read: files, diff entries, allowed paths, facts, graph and index."""

    files: DataFrame
    entries: DataFrame
    allowed: DataFrame
    facts: DataFrame
    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    vocabulary: DataFrame
    weights: DataFrame


@dataclass
class Registry:
    """§2.12: tools by name. An unknown name, or a tool's own complaint, is a row that says so, not an exception."""

    spark: object
    tools: dict[str, Tool] = field(default_factory=dict)

    def register(self, name: str, tool: Tool) -> None:
        self.tools[name] = tool

    def names(self) -> list[str]:
        return sorted(self.tools)

    def call(self, name: str, argument: str) -> DataFrame:
        if name not in self.tools:
            return self.spark.createDataFrame([(f"unknown tool: {name}",)], "error string")
        try:
            return self.tools[name](argument)
        except ValueError as e:
            return self.spark.createDataFrame([(str(e),)], "error string")


def method_definition(project: Project, name: str) -> DataFrame:
    """The chunks of methods named ``name``, ``Class.name`` or like it in part."""
    owner, _, method = name.strip().rpartition(".")
    own = project.chunks.where("granularity = 'METHOD'")
    hit = (F.col("method_name") == method) & (F.lit(not owner) | (F.col("class_name") == owner))
    return own.where(hit).select("chunk_id", "file_path", "start_line", "end_line", "content")


def semantic_search(project: Project, text: str, k: int = 5) -> DataFrame:
    """The chunks nearest to a text; its terms are weighed as a document of the corpus."""
    n = project.chunks.count()
    query = retrieval.weights(project.files.sparkSession.createDataFrame([("query", text)], "chunk_id string, text string"), project.vocabulary, n, "chunk_id")
    return retrieval.search_terms(project.weights, query.select("term", "weight"), k, "chunk_id")


def default_tools(project: Project) -> Registry:
    out = Registry(project.files.sparkSession)
    out.register("get_file_content", lambda path: guarded(project.files, project.allowed).where(F.col("file_path") == path.strip()).select("file_path", "content"))
    out.register("get_diff_context", lambda request: diff.diff_context(project.entries, request))
    out.register("get_method_definition", lambda name: method_definition(project, name))
    out.register("get_call_graph", lambda request: graph.query(request, project.nodes, project.edges).select("id", "type"))
    out.register("get_related_files", lambda name: graph.related(project.nodes, project.edges, name))
    out.register("semantic_search", lambda text: semantic_search(project, text))
    return out


def project_of(files: DataFrame, entries: DataFrame, allowed: DataFrame) -> Project:
    found = facts.analyze(files)
    nodes, edges = graph.build(found)
    chunks, vocab, weights = retrieval.index_project(files)
    return Project(files, entries, allowed, found, nodes, edges, chunks, vocab, weights)
