"""Markdown and JSON reports of stored analyses, rendered from small aggregates."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F

from lodestone.operators import graph, relational, rollup

from .api import Engine

TOP = 20


def _table(title: str, columns: list[str], rows: list, more: int = 0) -> str:
    lines = [f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    lines += ["| " + " | ".join(str(v) if v is not None else "" for v in r) + " |" for r in rows]
    return "\n".join(lines + ([f"", f"... and {more} more"] if more > 0 else [])) + "\n"


def overview(engine: Engine, repo_id: str) -> dict:
    """A report's figures: every list has at most TOP rows."""
    files, nodes, edges = (engine.read(x, repo_id) for x in ("files", "nodes", "edges"))
    entities = engine.read("entities", repo_id)
    per_file = rollup.kinds_by_file(entities, ["class", "interface"]).join(entities.where("kind = 'namespace'").groupBy("path").agg(F.min("name").alias("namespace")), "path", "left")
    per_ns = rollup.namespace_rollup(per_file, "namespace", {"classes": "n_class", "interfaces": "n_interface"})
    patterns = relational.sort_patterns(engine.read("patterns", repo_id)).select("name", "kind", "confidence", "count").collect()
    env = engine.read("environment", repo_id).where("category NOT IN ('env_variable', 'dependency', 'npm_script')").select("category", "key").distinct().orderBy("category", "key").limit(200).collect()
    return {
        "languages": [tuple(r) for r in rollup.histogram(files, "language", TOP).collect()],
        "kinds": [tuple(r) for r in rollup.histogram(entities, "kind", TOP).collect()],
        "namespaces": [tuple(r) for r in per_ns.orderBy(F.desc("classes"), "namespace").limit(TOP).collect()],
        "node_types": [tuple(r)[1:] for r in graph.type_counts(nodes, "node").orderBy("type").limit(TOP).collect()],
        "edge_types": [tuple(r)[1:] for r in graph.type_counts(edges, "edge").orderBy("type").limit(TOP).collect()],
        "central": [(r.id, r.degree, round(r.centrality, 6)) for r in graph.degree_centrality(nodes, edges).collect()],
        "patterns": [tuple(r) for r in patterns],
        "environment": [tuple(r) for r in env],
    }


HEADS = {"languages": ["language", "files"], "kinds": ["kind", "count"], "namespaces": ["namespace", "files", "classes", "interfaces"], "node_types": ["type", "nodes"], "edge_types": ["type", "edges"], "central": ["node", "degree", "centrality"], "patterns": ["pattern", "kind", "confidence", "count"], "environment": ["category", "name"]}


def markdown(name: str, figures: dict) -> str:
    parts = [f"# {name}\n"]
    for key, columns in HEADS.items():
        rows = figures[key]
        parts.append(_table(key.replace("_", " ").capitalize(), columns, rows[:TOP], len(rows) - TOP))
    return "\n".join(parts)


SECTIONS = {"structure": "Code Structure", "architecture": "Architecture", "patterns": "Patterns", "dependencies": "Dependencies"}


def write_report(engine: Engine, repo_id: str, name: str, folder: str) -> list[str]:
    """Writes report.md, report.json and the tree below docs: README.md and a page for each of SECTIONS, with one page of types for each namespace.

    A table shows at most TOP rows and how many more there are; whole lists are in export_json()'s files. The files' names.
    """
    figures, out = overview(engine, repo_id), Path(folder)
    for part in SECTIONS:
        (out / "docs" / part).mkdir(parents=True, exist_ok=True)
    (out / "report.md").write_text(markdown(name, figures))
    (out / "report.json").write_text(json.dumps(figures, indent=1))
    of = lambda category: [n for c, n in figures["environment"] if c == category]
    head = [f"# {name}", "", "## Key statistics", "", f"- Files: {sum(n for _, n in figures['languages'])}"]
    head += [f"- {label}: {', '.join(names)}" for label, names in (("Organization", [p[0] for p in figures["patterns"] if p[1] == "O"]), ("Frameworks", of("framework")), ("Package managers", of("package_manager"))) if names]
    head += ["", "## Sections", "", *(f"- [{title}](./{part}/README.md)" for part, title in SECTIONS.items()), ""]
    (out / "docs" / "README.md").write_text("\n".join(head))
    pages = {
        "structure": [_part("namespaces", figures), _part("kinds", figures), _part("languages", figures)],
        "architecture": [_part("patterns", figures, "A"), _part("patterns", figures, "O"), _part("node_types", figures), _part("edge_types", figures), _part("central", figures)],
        "patterns": [_part("patterns", figures, "D"), _part("patterns", figures, "L")],
        "dependencies": [_part("environment", figures), _packages(engine, repo_id)],
    }
    for part, tables in pages.items():
        (out / "docs" / part / "README.md").write_text(f"# {SECTIONS[part]}\n\n" + "\n".join(tables))
    names = [r[0] for r in figures["namespaces"]]
    rows = engine.read("entities", repo_id).where("kind IN ('class', 'interface')").withColumn("namespace", _namespace()).where(F.col("namespace").isin(names))
    shown = relational.top_with_rest(rows.select("namespace", "kind", "name", "bases", "path", "seq"), "namespace", [F.lower("name"), F.asc("path"), F.asc("seq")], TOP).collect()
    for ns in names:
        mine = sorted((r for r in shown if r.namespace == ns), key=lambda r: r.rank)
        if mine:
            page = _table(ns, ["kind", "name", "bases", "path"], [(r.kind, r.name, ", ".join(r.bases), r.path) for r in mine], mine[0].more)
            (out / "docs" / "structure" / f"{ns.replace('.', '_').replace('/', '_')}.md").write_text(page)
    return sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file())


def _part(key: str, figures: dict, kind: str | None = None) -> str:
    title = key.replace("_", " ").capitalize() if kind is None else {"A": "Architectural patterns", "O": "Code organization", "D": "Design patterns", "L": "Language patterns"}[kind]
    rows = figures[key] if kind is None else [r for r in figures[key] if r[1] == kind]
    return _table(title, HEADS[key], rows[:TOP], len(rows) - TOP)


def _packages(engine: Engine, repo_id: str) -> str:
    rows = engine.read("environment", repo_id).where("category = 'dependency'").select("key", "value").distinct()
    shown = rows.orderBy("key", "value").limit(TOP).collect()
    return _table("Packages", ["name", "version"], [tuple(r) for r in shown], rows.count() - TOP)


def _namespace():
    return F.coalesce(F.when(F.col("language") == "csharp", F.col("parent")), F.lit("Unknown"))


def export_json(engine: Engine, repo_id: str, folder: str) -> list[str]:
    """Writes whole collections as JSON lines below folder of the shared file system, one folder each, by the executors; the folders' names."""
    parts = {"environment": "environment", "patterns": "patterns", "pattern_sources": "pattern_sources", "code_content": "entities", "call_graph_nodes": "nodes", "call_graph_edges": "edges"}
    for name, collection in parts.items():
        engine.read(collection, repo_id).write.mode("overwrite").json(f"{folder.rstrip('/')}/{name}")
    return sorted(parts)
