"""The engine's read operations, one method each, over the tables it is given."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import values as V
from .operators import answer, chains, retrieve, search, stats
from .operators.search import Scope


@dataclass
class Engine:
    files: DataFrame
    edges: DataFrame
    knowledge: DataFrame
    concept_edges: DataFrame | None = None

    def list_knowledge(self, page: int | None = None) -> DataFrame:
        """All knowledge bases, last updated first; or a page of them."""
        rows, order = search.list_knowledge(self.knowledge, self.files), [F.desc("updated_seq"), "knowledge_id"]
        return rows.orderBy(*order) if page is None else chains.page(rows, order, page, V.PAGE_CHARS)

    def smart_search(self, query: str, scope: Scope = Scope(), page: int = 1, page_size: int = V.PAGE_SIZE) -> DataFrame:
        found = search.fused_search(self.files, self.edges, query, scope)
        return search.page(search.with_repo_names(found, self.knowledge), page, page_size)

    def answer(self, query: str, scope: Scope = Scope(), page: int = 1, page_size: int = V.PAGE_SIZE) -> DataFrame:
        return answer.answer(self.files, self.edges, self.knowledge, query, scope, page, page_size, self.concept_edges)

    def folder_clusters(self, query: str, scope: Scope = Scope()) -> DataFrame:
        return search.folder_clusters(search.fused_search(self.files, self.edges, query, scope))

    def concept_clusters(self, query: str, scope: Scope = Scope()) -> DataFrame:
        return search.concept_clusters(search.fused_search(self.files, self.edges, query, scope), self.concept_edges)

    def keyword_lookup(self, term: str, mode: str = "keyword", keywords: int = 20, files: int = 20, scope: Scope = Scope(), page: int | None = None) -> DataFrame:
        """Files of the entities that contain the term, with their texts; or a page of them."""
        found = search.keyword_lookup(self.edges, self.knowledge, term, mode, min(keywords, 50), min(files, 100), scope)
        rows = search.lookup_answer(found, self.files)
        return rows if page is None else chains.page(rows, ["name", "nth"], page, V.PAGE_CHARS)

    def retrieve_file(self, operation: str, asked: DataFrame, **options) -> DataFrame:
        """One of the operations on asked(knowledge_id, relative_path, ord): metadata, content (with `search`: matching lines) or bulk_search."""
        files = self.files.join(asked.select(*search.ID).distinct(), search.ID, "left_semi")
        if operation == "metadata":
            return search.metadata_answer(files, self.edges, asked)
        if operation == "content" and options.get("search"):
            return retrieve.content_search(files, options["search"], options.get("context", 3))
        if operation == "content":
            return retrieve.content_range(files, options.get("first", 1), options.get("last"), min(max(options.get("tokens", 10_000), 1_000), 50_000))
        if operation == "bulk_search":
            return retrieve.bulk_answer(files, asked, options["search"], options.get("context", 3), options.get("match_only", False))
        raise ValueError(f"unknown operation: {operation}")

    def metadata(self, paths: DataFrame) -> DataFrame:
        return search.file_metadata(self.files, self.edges, paths)

    def read(self, first: int = 1, last: int | None = None, tokens: int = 5000) -> DataFrame:
        return retrieve.read_range(self.files, first, last, min(max(tokens, 1000), 50_000))

    def search_lines(self, term: str, context: int = 3) -> DataFrame:
        return retrieve.search_lines(self.files, term, context)

    def bulk_search(self, term: str) -> DataFrame:
        return retrieve.bulk_search(self.files, term)

    def folder_rollup(self) -> DataFrame:
        return stats.folder_rollup(self.files)
