"""An index of a corpus: its tables, their build, storage and lookups."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verbatrix.errors import EngineError
from verbatrix.functions import text as T
from verbatrix.operators import graph, markdown, retrieval
from verbatrix.sources import shared

SCHEMA_VERSION = "2"
MAX_CHARS = 2000
TABLES = ("docs", "sections", "units", "graph", "token_df", "build")


def _titles(sections: DataFrame) -> DataFrame:
    return sections.groupBy("doc_id", "source_path").agg(F.min_by("heading", "ord").alias("title")).select("doc_id", "title", "source_path")


@dataclass(frozen=True)
class Index:
    """Tables of an indexed corpus. ``token_df`` holds the document frequencies,
    ``build`` one row about the build, ``edges`` the graph where it is stored; else it is computed when it is asked for."""

    docs: DataFrame
    sections: DataFrame
    units: DataFrame
    token_df: DataFrame
    build: DataFrame
    edges: DataFrame | None = None

    @classmethod
    def of(cls, files: DataFrame, library: str = markdown.LIBRARY, version: str = markdown.VERSION, inferred: bool = False) -> "Index":
        """Index of ``files`` (rel_path, content), not yet computed."""
        sections, units = markdown.sections(files), markdown.units(files, library, version)
        build = markdown.source_hash(files).select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(library).alias("library"), F.lit(version).alias("version"), "source_hash", F.current_timestamp().alias("built_at"), F.lit(inferred).alias("inferred"), F.lit("code-derived" if inferred else "").alias("derivation"))
        return cls(_titles(sections), sections, units, retrieval.token_df(units), build)

    def write(self, path: str) -> "Index":
        """Writes every table as parquet under ``path`` and gives the index that
        reads them. Sections and units are written first, what is derived from
        them is computed from the files."""
        spark = self.docs.sparkSession
        stored = self
        for name in ("docs", "sections", "units", "build"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
            stored = replace(stored, **{name: spark.read.parquet(f"{path}/{name}")})
        stored = replace(stored, token_df=retrieval.token_df(stored.units), edges=None)
        for name in ("graph", "token_df"):
            getattr(stored, name).write.mode("overwrite").parquet(f"{path}/{name}")
        return Index.read(spark, path)

    def materialized(self) -> "Index":
        """The index with sections and units as tables in the shared folder, so that
        what is derived from them doesn't parse the corpus again."""
        sections, units = shared.written(self.sections, "sections"), shared.written(self.units, "units")
        return replace(self, docs=_titles(sections), sections=sections, units=units, token_df=retrieval.token_df(units), edges=None)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "Index":
        try:
            tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
        except Exception as e:
            raise EngineError("INDEX_UNREADABLE", f"no index at {path}", "build one first") from e
        found = [r.schema_version for r in tables["build"].select("schema_version").take(1)]
        if found != [SCHEMA_VERSION]:
            raise EngineError("SCHEMA_MISMATCH", f"index at {path} has schema {found}, not {SCHEMA_VERSION}", "build it again")
        return cls(edges=tables.pop("graph"), **tables)

    def export_json(self, path: str) -> None:
        """One JSON line for each row of each table, partitioned by table."""
        for name in TABLES:
            getattr(self, name).write.mode("overwrite").json(f"{path}/{name}")

    @property
    def graph(self) -> DataFrame:
        """Edges between sections."""
        return self.edges if self.edges is not None else graph.edges(self.sections, self.units)

    # lookups ---------------------------------------------------------------

    def list_docs(self) -> DataFrame:
        counts = self.sections.groupBy("doc_id").agg(F.count("*").alias("sections"))
        return self.docs.join(counts, "doc_id", "left").select("doc_id", "title", "source_path", F.coalesce("sections", F.lit(0)).alias("sections"))

    def stats(self) -> DataFrame:
        docs = self.docs.agg(F.count("*").alias("docs_count"))
        sections = self.sections.agg(F.count("*").alias("sections_count"), F.coalesce(F.sum(F.size("code_blocks")), F.lit(0)).alias("code_blocks_count"))
        counts = docs.crossJoin(sections).crossJoin(self.units.agg(F.count("*").alias("evidence_units_count")))
        return counts.select("docs_count", "sections_count", "evidence_units_count", F.col("sections_count").alias("anchors_count"), "code_blocks_count", T.fixed(F.col("sections_count") / F.greatest(F.lit(1), "docs_count"), 2).alias("sections_per_doc"))

    def select_sections(self, asked: DataFrame) -> DataFrame:
        """Sections of ``asked`` (query_id, ref): the first with that anchor, or the
        document's first if the reference has no anchor."""
        # the choice is made on places, once for each document and anchor, and a section's text joins it at the end
        order = F.struct("line_start", T.icu(F.col("anchor")).alias("a"), T.icu(F.col("source_path")).alias("p"))
        placed = self.sections.select("doc_id", "anchor", "line_start", "source_path", "ord", order.alias("order"))
        place = F.struct("source_path", "ord")
        by_anchor = placed.groupBy("doc_id", F.col("anchor").alias("want")).agg(F.min_by(place, "order").alias("place"))
        by_doc = placed.groupBy("doc_id", F.lit("").alias("want")).agg(F.min_by(place, "order").alias("place"))
        found = self._wanted(asked).join(by_anchor.unionByName(by_doc), ["doc_id", "want"]).select("query_id", "place.source_path", "place.ord")
        return found.join(self.sections, ["source_path", "ord"])

    @staticmethod
    def _wanted(asked: DataFrame) -> DataFrame:
        return asked.select("query_id", F.split_part("ref", F.lit("#"), F.lit(1)).alias("doc_id"), F.split_part("ref", F.lit("#"), F.lit(2)).alias("want"))

    def missing_refs(self, asked: DataFrame) -> DataFrame:
        known = self.sections.select("doc_id", F.explode(F.array("anchor", F.lit(""))).alias("want")).distinct()
        there = self._wanted(asked).join(known, ["doc_id", "want"], "left_semi").select("query_id")
        return asked.join(there, "query_id", "left_anti")

    def require_refs(self, asked: DataFrame) -> None:
        missing = [r.ref for r in self.missing_refs(asked).select("ref").limit(5).collect()]
        if missing:
            raise EngineError("REF_NOT_FOUND", f"no section for {', '.join(missing)}", "search for a related query")

    def open(self, asked: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
        s = self.select_sections(asked)
        return s.select("query_id", F.concat_ws("#", "doc_id", "anchor").alias("ref"), "doc_id", "anchor", "heading", T.truncate(F.col("text"), max_chars).alias("content"), F.transform("code_blocks", lambda c: T.truncate(c, max_chars)).alias("code_blocks"), "source_path", "line_start", "line_end")

    def cite(self, asked: DataFrame) -> DataFrame:
        s = self.select_sections(asked).crossJoin(self.build.select("library", "version"))
        return s.select("query_id", F.format_string("%s@%s:%s#%s:%d-%d", "library", "version", "doc_id", "anchor", "line_start", "line_end").alias("citation_id"), "library", "version", "doc_id", "anchor", "source_path", "line_start", "line_end")

    # retrieval -------------------------------------------------------------

    def marked(self) -> DataFrame:
        return retrieval.prepared(self.units, self.sections)

    def weighted(self, queries: DataFrame) -> DataFrame:
        return retrieval.weighted(retrieval.profiles(queries), self.token_df, self.units)

    def candidates(self, queries: DataFrame, within: DataFrame | None = None) -> DataFrame:
        ranked = retrieval.candidates(retrieval.unlocated(self.units), self.weighted(queries), within)
        return retrieval.located(ranked, self.sections)

    def find(self, queries: DataFrame) -> DataFrame:
        return retrieval.find(self.candidates(queries))

    def extract(self, queries: DataFrame, within: DataFrame | None = None) -> DataFrame:
        """Units chosen under each query's budget; its ``refs``, or the table
        ``within`` (query_id, ref), limit where from."""
        return retrieval.select_by_budget(self.candidates(queries, within))

    def expand(self, asked: DataFrame) -> DataFrame:
        return retrieval.located(retrieval.expand(retrieval.unlocated(self.units), asked), self.sections)

    def neighbors(self, asked: DataFrame) -> DataFrame:
        """Edges of the references asked for; where none are stored, only these are computed."""
        edges = self.edges if self.edges is not None else graph.edges(self.sections, self.units, asked.select(F.trim("ref").alias("ref")))
        return retrieval.neighbors(edges, asked)
