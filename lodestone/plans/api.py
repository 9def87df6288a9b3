"""The analyses by name, with the parameters that callers know: analyze, search, dependencies, query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.text import stable_id
from lodestone.functions.vectors import embed_texts, embedder
from lodestone.operators import code_graph, environment, extract, graph, patterns, relational, rollup, search
from lodestone.operators.store import Table
from lodestone.sources.repo import read_repo

# Canned pattern questions, fixed values.
PATTERN_QUESTIONS = ["repository pattern", "factory pattern", "dependency injection", "singleton pattern", "observer pattern", "strategy pattern", "mediator pattern", "command query separation"]


@dataclass
class Engine:
    """Collections below a folder of the shared file system; each is a Table whose parts are repositories.

    service(list of texts) -> list of vectors is the embedding service that workers call; without one, or where it keeps
    failing, vectors are mock ones and marked so (is_mock).
    """

    spark: SparkSession
    path: str
    dimension: int = 64
    service: Callable[[list[str]], list[list[float]]] | None = None
    retries: int = 3
    delay: float = 1.0

    def _table(self, name: str) -> Table:
        return Table(self.spark, f"{self.path}/{name}", ["repo_id"], by="repo_id")

    def read(self, name: str, repo_id: str | None = None) -> DataFrame:
        """A collection; with repo_id only that repository's parts are read."""
        return self._table(name).read(labels=[repo_id] if repo_id else None)

    def _put(self, name: str, rows: DataFrame, repo: str) -> None:
        """Replaces one repository's rows in one version; the others' parts are not touched, and readers see the old rows until then."""
        self._table(name).replace(repo, rows.withColumn("repo_id", F.lit(repo)))

    def _resume(self, name: str, repo: str, files: DataFrame, make: Callable[[DataFrame], DataFrame], fresh: bool) -> DataFrame:
        """make(files), but rows stored for files that still have the same digest are taken over; only new and changed files are parsed."""
        stored = None if fresh or not self._table(name).versions() else self.read(name, repo)
        if stored is None:
            return make(files)
        known = stored.select("path", "digest").distinct()
        kept = stored.join(files.select("path", "digest"), ["path", "digest"], "left_semi").drop("repo_id")
        return make(files.join(known, ["path", "digest"], "left_anti")).unionByName(kept)

    def analyze(self, repo_path: str, repo_name: str, *, exclude_patterns: list[str] | None = None, include_embeddings: bool = True, file_limit: int | None = None, fresh: bool = False) -> dict:
        """Reads a tree and stores files, entities, documentation, chunks, graph, patterns, environment and vectors.

        Files that can't be read are counted as errors. Run again, also after a run that died, it parses and embeds only what is new or changed since,
        unless fresh is set.
        """
        if not repo_path or not repo_name:
            raise ValueError("repo_path and repo_name are required")
        repo = "r" + self.spark.range(1).select(stable_id(F.lit(repo_name)).alias("id")).first().id
        files = read_repo(self.spark, repo_path, exclude=exclude_patterns, substring=True)
        if file_limit:
            files = relational.first_n(files, file_limit, ["path"])
        self._put("files", files.withColumn("digest", F.sha2("content", 256)), repo)
        files = self.read("files", repo)
        code = files.where("content IS NOT NULL AND language IS NOT NULL").select("path", "digest", "language", "content")
        for name, f in (("entities", extract.entities), ("documentation", extract.documentation), ("chunks", extract.chunks)):
            self._put(name, self._resume(name, repo, code, lambda df, f=f: f(df, ["digest"]), fresh), repo)
        nodes, edges = code_graph.build(self.read("entities", repo).drop("repo_id", "digest"))
        self._put("nodes", nodes, repo)
        self._put("edges", edges, repo)
        self._put("environment", environment.facts(files.where("content IS NOT NULL")), repo)
        hits = self._hits(repo, code, files)
        self._put("pattern_sources", relational.pattern_sources(hits), repo)
        kinds = hits.groupBy("name").agg(F.min_by("kind", "seq").alias("kind"))
        self._put("patterns", relational.dedup_patterns(hits).join(kinds, "name"), repo)
        if include_embeddings:
            self._put("vectors", self._vectors(repo, fresh), repo)
        count = lambda df: df.count()
        done = {"repo_id": repo, "files": count(files.where("error IS NULL")), "errors": count(files.where("error IS NOT NULL")), "entities": count(self.read("entities", repo)), "patterns": count(self.read("patterns", repo))}
        self._put("repositories", self.spark.createDataFrame([(repo_name, repo_path)], "name string, path string").withColumn("created_at", F.current_timestamp()), repo)
        return done

    def _hits(self, repo: str, code: DataFrame, files: DataFrame) -> DataFrame:
        hits = patterns.file_patterns(code).select("name", "kind", "confidence", F.col("path").alias("source"), F.concat_ws("#", F.lit("0"), "path", F.lpad(F.col("rule_no").cast("string"), 3, "0")).alias("seq"))
        graphs = graph.graph_patterns(self.read("nodes", repo), self.read("edges", repo)).select("name", F.when(F.col("name").isin("MVC", "Layered Architecture", "Hexagonal/Clean Architecture"), "A").otherwise("D").alias("kind"), "confidence", F.lit("call_graph_analysis").alias("source"), F.concat(F.lit("1#"), "name").alias("seq"))
        dirs = patterns.folder_patterns(files).select("name", "kind", "confidence", F.lit("folder_structure").alias("source"), F.concat(F.lit("2#"), "name").alias("seq"))
        return hits.unionByName(graphs).unionByName(dirs)

    def texts_to_embed(self, repo: str) -> DataFrame:
        """(id, path, language, type, name, code_text, digest) of chunks, documentation, files and classes."""
        chunks = self.read("chunks", repo).select(F.col("chunk_id").alias("id"), "path", "language", "type", "name", F.col("content").alias("code_text"))
        docs = self.read("documentation", repo).where("text != ''").select(F.concat_ws("_doc_", "path", "seq").alias("id"), "path", "language", F.lit("documentation").alias("type"), "name", F.col("text").alias("code_text"))
        entities = self.read("entities", repo)
        members = entities.where("kind IN ('method', 'property')").groupBy("path", F.col("parent").alias("name")).agg(F.count_if(F.col("kind") == "method").alias("n_methods"), F.count_if(F.col("kind") == "property").alias("n_properties"))
        named = entities.where("kind IN ('class', 'interface')").join(members, ["path", "name"], "left").na.fill(0, ["n_methods", "n_properties"])
        of = lambda kind, *fields: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("seq", *fields))))
        per_file = named.groupBy("path", "language").agg(F.min("parent").alias("namespace"), of("class", "name", "n_methods", "n_properties").alias("classes"), of("interface", "name").alias("interfaces"))
        file = tx.file_text(F.col("path"), F.col("language"), F.col("namespace"), F.col("classes"), F.transform("interfaces", lambda x: x["name"]))
        files = per_file.select(F.concat(F.col("path"), F.lit("_file")).alias("id"), "path", "language", F.lit("file").alias("type"), F.substring_index("path", "/", -1).alias("name"), file.alias("code_text"))
        text = tx.class_text(F.col("name"), F.col("parent"), F.col("access"), F.col("modifier"), F.col("bases"))
        classes = entities.where("kind = 'class'").select(F.concat_ws("_class_", "path", "seq").alias("id"), "path", "language", F.lit("class").alias("type"), "name", text.alias("code_text"))
        return chunks.unionByName(docs).unionByName(files).unionByName(classes).withColumn("digest", F.sha2("code_text", 256))

    def _vectors(self, repo: str, fresh: bool) -> DataFrame:
        """Vectors of all texts; real ones that are stored for the same id and text are taken over."""
        texts = self.texts_to_embed(repo)
        made = lambda df: df.withColumn("_v", embedder(self.service, dimension=self.dimension, retries=self.retries, delay=self.delay)("code_text")).select("*", "_v.*").drop("_v")
        if fresh or not self._table("vectors").versions():
            return made(texts)
        stored = self.read("vectors", repo).drop("repo_id")
        stored = stored.where("NOT is_mock") if self.service else stored
        kept = stored.join(texts.select("id", "digest"), ["id", "digest"], "left_semi")
        return made(texts.join(stored.select("id", "digest"), ["id", "digest"], "left_anti")).unionByName(kept)

    def _embedded(self, texts: list[str]) -> list[list[float]]:
        return embed_texts(texts, self.service, dimension=self.dimension, retries=self.retries, delay=self.delay)[0]

    def search(self, query: str, *, repo_id: str | None = None, type: str = "all", code_type: str | None = None, chunk_type: str | None = None, code_language: str | None = None, limit: int = 10, include_code: bool = True) -> DataFrame:
        """The vectors nearest to a text: id, score, path, language, type, name, and code_text if wanted."""
        if not query:
            raise ValueError("query is required")
        where = relational.search_type_filter(type, code_type=code_type, chunk_type=chunk_type) & relational.payload_filter({k: v for k, v in (("language", code_language),) if v})
        hits = search.similar(self.read("vectors", repo_id), self._embedded([query])[0], limit, where=where)
        columns = ["id", "score", "path", "language", "type", F.coalesce("name", F.lit("Unknown")).alias("name")]
        return hits.select(*columns, *(["code_text"] if include_code else []))

    def text_search(self, terms: list[str], *, repo_id: str | None = None, language: str | None = None, limit: int = 10) -> DataFrame:
        files = relational.optional_filter(self.read("files", repo_id), language=language)
        return search.text_search(files.where("content IS NOT NULL"), terms, limit, key="path").select("path", "language", "score")

    def pattern_questions(self, repo_id: str | None = None) -> DataFrame:
        """The two nearest vectors of each canned question."""
        rows = list(zip(PATTERN_QUESTIONS, self._embedded(PATTERN_QUESTIONS), strict=True))
        questions = self.spark.createDataFrame(rows, "query_id string, query array<double>")
        return search.similar_to_each(self.read("vectors", repo_id), questions, 2)

    def dependencies(self, component: str, *, repo_id: str | None = None, direction: str = "both", transitive: bool = False) -> DataFrame:
        """See graph.dependencies()."""
        return graph.dependencies(self.read("nodes", repo_id), self.read("edges", repo_id), component, direction=direction, transitive=transitive)

    def dependencies_of_kind(self, kind: str, repo_id: str | None = None) -> DataFrame:
        """(id, dst, type) of all nodes of a kind, in one join."""
        return graph.dependencies_of_kind(self.read("nodes", repo_id), self.read("edges", repo_id), kind)

    def query(self, *, repo_id: str | None = None, component: str | None = None, pattern: str | None = None) -> DataFrame:
        """A component's declarations (exact name, else five partial ones), the first pattern by kind and name, or the roll-up of the repository."""
        if component:
            rows = self.read("entities", repo_id).where("kind IN ('class', 'interface', 'function')").select("name", "kind", "path", "parent", "bases")
            return relational.exact_else_partial(rows, "name", component, 5, ["name", "path"])
        if pattern:
            found = self.read("patterns", repo_id).where(F.contains(F.lower("name"), F.lit(pattern.lower()))).select("name", "kind", "confidence", F.coalesce("count", F.lit(1)).alias("count"))
            return relational.first_by_priority([found.where(F.col("kind") == k) for k in ("D", "A", "O", "L")], ["name"])
        env = self.read("environment", repo_id).where("category IN ('framework', 'package_manager', 'build_system')").select("repo_id", F.col("key").alias("fact"))
        return rollup.repository_rollup(self.read("files", repo_id), self.read("patterns", repo_id), env)

    def sources_of(self, pattern: str, *, repo_id: str | None = None, limit: int | None = None) -> DataFrame:
        """(repo_id, seq, source) of one pattern, in order; all of them without limit."""
        rows = self.read("pattern_sources", repo_id).where(F.col("name") == pattern).select("repo_id", "seq", "source").orderBy("repo_id", "seq")
        return rows if limit is None else rows.limit(limit)
