import os

import pytest
from pyspark.sql import functions as F

from lodestone import extract_queries as q
from lodestone.functions import text as tx
from lodestone.functions import vectors as vx
from lodestone.operators import chunk, code_graph, environment, extract, graph, parse, patterns, relational, search, split
from lodestone.operators.store import Conflict, Table
from lodestone.plans.api import Engine
from lodestone.plans.report import export_json, write_report
from lodestone.sources import repo
from lodestone.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, tx.byte_size(F.lit(1536))) == "1.50 KB" and one(spark, tx.preview(F.lit("x" * 201))) == "x" * 200 + "..."
    assert one(spark, tx.line_preview(F.lit("x" * 301))) == "x" * 300 + "..." and one(spark, tx.line_preview(F.lit("a" * 200 + "\n" + "b" * 200))) == "a" * 200 + "\n..."
    assert [one(spark, tx.extension(F.lit(p))) for p in ("a/b.CS", ".env", "x.tar.gz", "Makefile")] == [".cs", "", ".gz", ""]
    assert one(spark, tx.language_of(F.lit("a/b.tsx"))) == "typescript" and one(spark, tx.file_kind(F.lit("x.pipe.ts"))) == "pipe"
    stats = one(spark, tx.line_stats(F.lit("# c\n\ndef f():\n    pass\n")))
    assert tuple(stats) == (5, 2, 1) and tuple(one(spark, tx.line_stats(F.lit("")))) == (1, 1, 0)
    assert one(spark, tx.clean_xml_doc(F.lit("/// <summary>\n/// A b.\n/// </summary>"))) == "A b." and one(spark, tx.clean_jsdoc(F.lit("/**\n * A\n *\n * b \n */"))) == "A\n\nb"
    assert one(spark, tx.uptime(F.lit(90061))) == "1d 1h 1m 1s" and one(spark, tx.stable_id(F.lit("a"), F.lit(None))) != one(spark, tx.stable_id(F.lit("a"), F.lit("")))


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert round(one(spark, vx.cosine(a, b)), 6) == 0.707107 and one(spark, vx.euclid(a, b)) == 1 and one(spark, vx.dot(a, b)) == 1
    assert one(spark, vx.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0
    df = spark.createDataFrame([("Same text",), (None,), ("x",)], "t string")
    got = [r.v for r in df.select(vx.mock_embed(4)("t").alias("v")).collect()]
    assert got[1] is None and abs(sum(x * x for x in got[2]) - 1) < 1e-6

    def broken(texts):
        raise OSError("down")

    fell_back = [r.v for r in df.select(vx.embedder(broken, dimension=4, retries=1, delay=0)("t").alias("v")).collect()]
    assert [v.embedding for v in fell_back] == got and [v.is_mock for v in fell_back] == [True, None, True]
    real = [r.v for r in df.select(vx.embedder(lambda texts: [[len(t), 0, 0, 1] for t in texts], dimension=4, batch=1)("t").alias("v")).collect()]
    assert [v.embedding for v in real] == [[9, 0, 0, 1], None, [1, 0, 0, 1]] and [v.is_mock for v in real] == [False, None, False]


def test_embedding_waits_longer_after_each_failure(monkeypatch):
    waits, calls = [], []
    monkeypatch.setattr(vx.time, "sleep", waits.append)

    def third(texts):
        calls.append(texts)
        if len(calls) < 3:
            raise OSError("busy")
        return [[1.0]] * len(texts)

    assert vx.embed_texts(["a", "b"], third, dimension=1, delay=2.0) == ([[1.0], [1.0]], False)
    assert waits == [2.0, 4.0] and len(calls) == 3
    assert vx.embed_texts(["a"], lambda t: [], dimension=2, retries=1, delay=0)[1]  # a service that gives too few vectors has failed


def test_patterns_dedup(spark):
    rows = [("X", "medium", "a", 0), ("X", "medium", "b", 1), ("Y", "medium", "a", 2), ("Y", "medium", "b", 3), ("Y", "medium", "c", 4), ("Z", "medium", "a", 5), ("Z", "high", "b", 6), ("W", "high", "a", 7)]
    hits = spark.createDataFrame(rows, "name string, confidence string, source string, seq int")
    got = relational.sort_patterns(relational.dedup_patterns(hits)).collect()
    assert [(r.name, r.confidence, r["count"]) for r in got] == [("Y", "high", 3), ("Z", "high", 2), ("W", "high", 1), ("X", "medium", 2)]


def test_graph_patterns(spark):
    def found(nodes, edges):
        n = spark.createDataFrame(nodes, "id string, type string")
        e = spark.createDataFrame(edges, "src string, dst string, type string")
        return {r.name: r.confidence for r in graph.graph_patterns(n, e).collect()}

    di = lambda n: [("IFoo", f"F{i}", "di_registration") for i in range(n)]
    assert found([("IFoo", "interface")], di(2))["Strategy Pattern"] == "medium" and found([("IFoo", "interface")], di(3))["Strategy Pattern"] == "high"
    assert "Strategy Pattern" not in found([("IFoo", "interface")], di(1))
    assert found([("UserController", "class"), ("UserModel", "class"), ("render_view", "function")], [])["MVC"] == "medium"
    assert "MVC" not in found([("ViewController", "class"), ("UserModel", "class")], [])
    assert found([("A", "class")], [("A", "B", "di_registration")])["Dependency Injection"] == "high"
    assert "Layered Architecture" in found([("AController", "class"), ("AService", "class"), ("AEntity", "class")], [])
    assert "Hexagonal/Clean Architecture" in found([(f"I{i}", "interface") for i in range(6)] + [(f"XImpl{i}", "class") for i in range(6)], [])
    assert "Hexagonal/Clean Architecture" not in found([(f"I{i}", "interface") for i in range(6)] + [(f"XImpl{i}", "class") for i in range(5)], [])
    n = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "id string, type string")
    e = spark.createDataFrame([("a", "b", "t"), ("a", "c", "t")], "src string, dst string, type string")
    assert [tuple(r) for r in graph.degree_centrality(n, e).collect()] == [("a", 2, 1.0), ("b", 1, 0.5), ("c", 1, 0.5)]


def test_closure_with_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    got = graph.closure(e, spark.createDataFrame([("a",)], "id string"))
    assert {(r.id, r.depth, r.via) for r in got.collect()} == {("a", 0, None), ("b", 1, "a"), ("c", 2, "b"), ("d", 3, "c")}


def test_related_and_filters(spark):
    e = spark.createDataFrame([("1", "2", "uses"), ("3", "1", "calls"), ("1", "9", "uses")], "src string, dst string, type string")
    a, b = spark.createDataFrame([("2", "two")], "id string, name string"), spark.createDataFrame([("3", "three")], "id string, name string")
    assert [tuple(r) for r in relational.related_entities(e, "1", a, b).collect()] == [("3", "three", "calls", "in"), ("2", "two", "uses", "out")]
    assert relational.related_entities(e, "1", a, b, direction="out", kind="calls").count() == 0
    with pytest.raises(ValueError):
        relational.related_entities(e, "1", a, b, direction="up")
    with pytest.raises(ValueError):
        relational.search_type_filter("odd")
    paths = spark.createDataFrame([("src/bin/x.cs",), ("a/Y.Designer.cs",), ("a/b.cs",)], "path string")
    assert [r.path for r in paths.where(relational.without_globs(F.col("path"), repo.CSHARP_EXCLUDES)).collect()] == ["a/b.cs"]


def test_extract_and_graph(spark):
    entities = extract.entities(q.files(spark)).cache()
    assert entities.where("path = 'null.ts'").count() == 0
    nodes, edges = code_graph.build(entities)
    got = {(r.src, r.dst, r.type) for r in edges.collect()}
    assert {("N.M.UserController", "N.M.IUserStore", "implements"), ("N.M.UserController", "N.M.UserController.Get", "contains"), ("IUserStore", "UserController", "di_registration"), ("UserComponent", "UserService", "imports"), ("User", "abc.ABC", "inherits"), ("create_user", "os", "imports")} <= got
    assert not any(d in ("Component", "Input") for _, d, _ in got)
    types = {r.id: r.type for r in nodes.collect()}
    assert (types["N.M.IUserStore"], types["IUserStore"], types["UserComponent"], types["UserService"], types["os"]) == ("interface", "interface", "component", "import", "module")
    deps = {(r.src, r.dst) for r in code_graph.namespace_dependencies(entities).collect()}
    assert ("N.M.UserController", "A.B.Base") in deps and ("N.M.UserController", "N.M.Base") in deps
    assert {r.name for r in patterns.file_patterns(q.files(spark)).where("path = 'app/users.py'").collect()} == {"Factory Pattern", "Decorator Pattern", "Asyncio", "Type Annotations"}


def test_folders_and_environment(spark):
    assert {r.name for r in patterns.folder_patterns(q.tree(spark)).collect()} == {"Layer-based Organization", "Microservices Architecture", "Django Project Layout"}
    facts = {(r.category, r.key, r.value) for r in environment.facts(q.tree(spark)).collect()}
    assert {("framework", "React", ""), ("framework", "Flask", ""), ("framework", "ASP.NET Core", ""), ("dependency", "X", "2"), ("dependency", "b", "2"), ("dependency", "numpy", "latest"), ("env_variable", "KEY", ""), ("env_variable", "OTHER", ""), ("base_image", "python:3.13", ""), ("container", "kubernetes-manifest", ""), ("ci", "github-actions", ""), ("ci", "gitlab", ""), ("package_manager", "poetry", ""), ("npm_script", "test", "jest"), ("runtime", "node", ">=18")} <= facts
    assert not any("secret" in str(f) for f in facts)
    legacy = spark.createDataFrame([("flask==2.0",), ("numpy",), ("b!=2",)], "l string").select(environment.legacy_requirement(F.col("l")).alias("r"))
    assert [tuple(r.r) for r in legacy.collect()] == [("flask", "=2.0"), ("numpy", "latest"), ("b!", "2")]


def test_line_packer_agrees(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {}
    for r in chunk.line_chunks(docs, "doc_id", "text").orderBy("chunk_no").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    for r in docs.collect():
        assert got.get(r.doc_id, []) == [x["content"] for x in split.by_lines(r.text)]


def test_store(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", ["k"])
    t.upsert(spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, name string, v double"))
    t.upsert(spark.createDataFrame([(2, 5.0), (3, 6.0)], "k int, v double"))
    assert sorted(map(tuple, t.read().collect())) == [(1, "a", 1.0), (2, "b", 5.0), (3, None, 6.0)]
    assert t.delete(F.col("name") == "a") == 1 and t.read().count() == 2 and t.read(1).count() == 2 and t.delete(F.col("k") == 77) == 0
    t.append(spark.createDataFrame([(9, "z")], "k int, name string"))
    t.vacuum()
    assert len(t.versions()) == 1 and t.read().count() == 3
    t.upsert(spark.createDataFrame([(9, True)], "k int, extra boolean"))
    assert {(r.k, r.name, r.extra) for r in t.read().collect()} == {(2, "b", None), (3, None, None), (9, "z", True)}
    t.clear()
    assert t.read().count() == 0 and t.read().columns == ["k", "name", "v", "extra"]


def test_store_changes_only_touched_parts_and_sees_other_writers(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", ["k"], by="g")
    t.overwrite(spark.createDataFrame([(1, "a"), (2, "b/x"), (3, "a"), (4, None)], "k int, g string"))
    before = dict(map(tuple, t._load()["parts"]))
    t.replace("a", spark.createDataFrame([(7, "a")], "k int, g string"))
    after = dict(map(tuple, t._load()["parts"]))
    assert before.keys() == after.keys() and [g for g in after if after[g] != before[g]] == ["a"]
    assert sorted((r.k, r.g) for r in t.read(labels=["a", "b/x"]).collect()) == [(2, "b/x"), (7, "a")]
    stale = t._load()
    t.append(spark.createDataFrame([(8, "c")], "k int, g string"))
    with pytest.raises(Conflict):
        t._commit(stale, t.read().schema, [])
    raced = []

    def load(version=None, real=t._load):  # another writer gets in between reading and committing, once
        state = real(version)
        if not raced:
            raced.append(1)
            Table(spark, t.path, ["k"], by="g").append(spark.createDataFrame([(9, "d")], "k int, g string"))
        return state

    t._load = load
    t.append(spark.createDataFrame([(10, "e")], "k int, g string"))
    assert sorted(r.k for r in t.read().collect()) == [2, 4, 7, 8, 9, 10]


def test_stream_takes_new_files_once(spark, tmp_path):
    src, to = f"{tmp_path}/src", f"{tmp_path}/to"
    spark.range(5).write.parquet(src)
    assert ingest.copy_available(spark, src, to).count() == 5
    spark.range(5, 8).write.mode("append").parquet(src)
    assert ingest.copy_available(spark, src, to).count() == 8 and ingest.copy_available(spark, src, to).count() == 8


def test_analysis_of_a_tree(spark, tmp_path):
    root = tmp_path / "repo"
    for path, text in [*q.TREE, *[(p, t) for p, _, t in q.FILES if t is not None]]:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "bad.py").write_bytes(b"\xff\xfe\xff")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.js").write_text("x")
    engine = Engine(spark, f"file://{tmp_path}/store")
    done = engine.analyze(str(root), "demo", exclude_patterns=["node_modules"])
    assert done["errors"] == 1 and done["files"] == len(q.TREE) + sum(t is not None for _, _, t in q.FILES)
    again = engine.analyze(str(root), "demo", exclude_patterns=["node_modules"])
    assert again == done and engine.read("repositories").count() == 1
    repo_id = done["repo_id"]
    hits = engine.search("UserController", type="code", repo_id=repo_id, limit=3).collect()
    assert len(hits) == 3 and {h.type for h in hits} <= {"file", "class", "interface", "method", "function"}
    assert engine.text_search(["user"], language="python").first().path == "app/users.py"
    assert all(r.is_mock for r in engine.read("vectors").collect()) and {"file", "class", "documentation"} <= {r.type for r in engine.read("vectors").collect()}
    near = {(r.id, r.name, r.type, r.relationship, r.direction, r.depth, r.via) for r in engine.dependencies("N.M.UserController").collect()}
    assert near == {("N.M.IUserStore", "IUserStore", "interface", "implements", "out", 1, "N.M.UserController"), ("N.M.UserController.Get", "Get", "method", "contains", "out", 1, "N.M.UserController")}
    assert "abc.ABC" in {r.id for r in engine.dependencies("User", transitive=True, direction="out").collect()}
    assert [(r.id, r.error) for r in engine.dependencies("Nobody").collect()] == [(None, "Component Nobody not found in the call graph")]
    assert [r.source for r in engine.sources_of("Factory Pattern", repo_id=repo_id).collect()] == ["app/users.py"]
    assert engine.query(repo_id=repo_id, component="usercontr").first().name == "UserController"
    assert engine.query(repo_id=repo_id, pattern="factory").first().kind == "D"
    rolled = engine.query(repo_id=repo_id).first()
    assert "python" in rolled.languages and "Flask" in rolled.environment
    assert engine.pattern_questions(repo_id).count() == 16
    with pytest.raises(ValueError):
        engine.search("")
    files = write_report(engine, repo_id, "demo", f"{tmp_path}/report")
    assert {"report.md", "docs/README.md", "docs/structure/N_M.md", "docs/architecture/README.md", "docs/patterns/README.md", "docs/dependencies/README.md"} <= set(files) and os.path.getsize(f"{tmp_path}/report/report.md") > 500
    export_json(engine, repo_id, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json/call_graph_edges").count() == engine.read("edges", repo_id).count()
    assert repo.framework(repo.read_repo(spark, str(root))).first().framework == "both"
    assert repo.code_files(spark, str(root), ["app/"]).where("startswith(path, 'app/')").count() == 0


def test_similar_takes_filter_first(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    q0 = v.where("id = 3").first()
    got = search.similar(v, q0.embedding, 1).first()
    assert got.id == 3 and abs(got.score - 1) < 1e-6
    assert {r.label for r in search.similar(v, q0.embedding, 20, where=F.col("label") == 2).collect()} == {2}


def test_large_source_files_are_read(spark, tmp_path):
    big = "// x\n" * 300_000 + "class Far { }\n"
    for name in ("a.cs", "b.ts", "c.bin"):
        (tmp_path / name).write_text(big)
    for df in (repo.csharp_files(spark, str(tmp_path)), repo.angular_files(spark, str(tmp_path))):
        assert [(r.size, r.content == big, r.error) for r in df.collect()] == [(len(big), True, None)]
    raw = spark.read.format("repo").load(f"file://{tmp_path}").collect()
    assert len(raw) == 3 and all(r.content is None and "larger than" in r.error for r in raw)


def test_closure_of_a_long_chain(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(70)], "src string, dst string")
    got = graph.closure(e, spark.createDataFrame([("n0",)], "id string"))
    assert {(r.id, r.depth, r.via) for r in got.collect()} == {(f"n{i}", i, f"n{i - 1}" if i else None) for i in range(71)}
    assert graph.closure(e, spark.createDataFrame([("n0",)], "id string"), max_depth=2).count() == 3


def test_previews_of_whole_table(spark, sf_dir):
    def preview(text, most=300):
        if len(text) <= most:
            return text
        lines, n = [], 0
        for line in text.split("\n"):
            if n + len(line) > most:
                break
            lines.append(line)
            n += len(line) + 1
        return "\n".join(lines) + "\n..." if lines else text[:most] + "..."

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.preview for r in q.str_previews(spark, sf_dir).collect()}
    assert got == {i: preview(t) for i, t in texts.items()} and sum(len(t) > 300 for t in texts.values()) > len(texts) / 2


def test_analysis_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    root, calls = tmp_path / "repo", tmp_path / "calls"
    root.mkdir()
    for name in ("a", "b"):
        (root / f"{name}.py").write_text(f"class {name.upper()}:\n    pass\n")

    def service(texts):
        with open(calls, "a") as f:
            f.write("".join(t.replace("\n", " ") + "\n" for t in texts))
        return [[float(len(t)), 1.0] for t in texts]

    engine = Engine(spark, f"file://{tmp_path}/store", dimension=2, service=service)
    repo_id = engine.analyze(str(root), "demo")["repo_id"]
    assert not any(r.is_mock for r in engine.read("vectors").collect())
    calls.unlink()
    (root / "b.py").write_text("class B2:\n    pass\n")
    (root / "c.py").write_text("class C:\n    pass\n")
    seen = []
    real = extract.entities
    monkeypatch.setattr(extract, "entities", lambda df, keep: (seen.extend(r.path for r in df.collect()), real(df, keep))[1])
    engine.analyze(str(root), "demo")
    assert sorted(seen) == ["b.py", "c.py"]
    assert {r.name for r in engine.read("entities", repo_id).where("kind = 'class'").collect()} == {"A", "B2", "C"}
    texts = calls.read_text()
    assert "class A" not in texts and "class B2" in texts and "class C" in texts
    assert {r.path for r in engine.read("vectors", repo_id).collect()} == {"a.py", "b.py", "c.py"}


def test_left_out_folders_are_not_listed(spark, tmp_path):
    for p in ("src/a.cs", "src/bin/x/b.cs", "node_modules/c.cs", "packages.cs"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("class A { }")
    (tmp_path / "src/bin/x").chmod(0)
    reader = lambda **o: repo._Reader({"path": f"file://{tmp_path}", **o})
    got = [p for part in reader(excludeglobs='["**/bin/**"]', extensions=".cs", onlyextensions="true").partitions() for p, _ in part.files]
    assert got == ["node_modules/c.cs", "packages.cs", "src/a.cs"]
    assert [p for part in reader(excludeparts='["node_mod", "src/b"]').partitions() for p, _ in part.files] == ["packages.cs", "src/a.cs"]
    (tmp_path / "src/bin/x").chmod(0o755)


def test_long_texts_are_parsed_in_linear_time():
    import time

    one = "public class C%d { public string Get%d(int id) { if (id > 0) { return 1; } return 2; } }\n"
    took = []
    for n in (2000, 8000):
        text = "".join(one % (i, i) for i in range(n))
        began = time.time()
        rows = parse.csharp(text)
        took.append(time.time() - began)
        assert sum(r["kind"] == "method" for r in rows) == n and rows[-1]["parent"] == f"C{n - 1}"
    assert took[1] < 10 * max(took[0], 0.1)


def test_packer_on_many_lines(spark):
    text = "\n".join("x" * (i % 90) for i in range(60_000))
    got = chunk.line_chunks(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").orderBy("chunk_no").collect()
    assert [r.content for r in got] == [x["content"] for x in split.by_lines(text)]
