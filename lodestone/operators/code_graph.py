"""Property graphs of source trees from parsed entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import last_wins


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


_CSHARP, _PYTHON = ("csharp", "cs", "c#"), ("python", "py")
_SCRIPT = ("typescript", "ts", "javascript", "js")


def build(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (id, type, language, path) and edges (src, dst, type, lifetime) of extract.entities().

    C#: namespace.Class and namespace.Interface, contains edges to namespace.Class.Method, di_registration edges from a service to its
    implementation, implements edges to interfaces of the same namespace. TypeScript and JavaScript: classes by their role (component, service,
    module or class), contains edges to methods, imports edges to each imported item but those of @angular/. Python: classes, inherits
    edges to their bases, contains edges to methods, functions, and imports edges of both to modules. A node that is only mentioned has type
    interface or class (C#), import or module; a declaration wins over it. There is one edge for each ordered pair, the last.
    """
    order = F.concat_ws("#", "path", F.lpad(F.col("seq").cast("string"), 8, "0")).alias("order")
    group = F.lower("language")
    rows = entities.withColumn("group", F.when(group.isin(*_CSHARP), "c").when(group.isin(*_SCRIPT), "t").when(group.isin(*_PYTHON), "p")).where("group IS NOT NULL")
    spaces = rows.where("group = 'c' AND kind = 'namespace'").groupBy("path").agg(F.min("name").alias("namespace"))
    rows = rows.join(spaces, "path", "left")
    inside = lambda *names: F.concat_ws(".", F.when(F.col("group") == "c", F.coalesce("namespace", F.lit("Unknown"))), *names)
    role = F.when(F.col("group") != "t", F.col("kind"))
    for flag in ("module", "service", "component"):
        role = F.when(F.array_contains("flags", f"is_{flag}"), flag).otherwise(role)
    types = rows.where("kind = 'class' OR (kind = 'interface' AND group = 'c')").select(inside("name").alias("id"), F.coalesce(role, F.lit("class")).alias("type"), "name", "kind", "bases", "group", "namespace", "language", "path", order)
    methods = rows.where("kind = 'method' AND parent IS NOT NULL").select(inside("parent").alias("of"), inside("parent", "name").alias("id"), "language", "path", order)
    functions = rows.where("kind = 'function' AND group = 'p'").select(F.col("name").alias("id"), F.lit("function").alias("type"), "language", "path", order)
    script = rows.where("group = 't' AND kind = 'import' AND NOT startswith(name, '@angular/')").select("path", F.explode("bases").alias("item"), F.lit("import").alias("type"), "language", order)
    modules = rows.where("group = 'p' AND kind = 'import'").select("path", F.col("name").alias("item"), F.lit("module").alias("type"), "language", order)
    imports = script.unionByName(modules)
    users = types.where("kind = 'class' AND group != 'c'").select("path", F.col("id").alias("user")).unionByName(functions.select("path", F.col("id").alias("user")))
    up = types.where("group = 'p'").select("id", F.explode("bases").alias("base"), "language", "path", "order")
    di = rows.where("kind = 'di_registration'").select("name", F.col("bases")[0].alias("impl"), F.col("type").alias("lifetime"), "language", "path", order)
    edge = lambda df, src, dst, kind, lifetime=None: df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("type"), (F.lit(None).cast("string") if lifetime is None else F.col(lifetime)).alias("lifetime"), "order")
    last = implementing(types.where("group = 'c'")).withColumn("order", F.concat(F.lit("~"), "order"))  # after all files
    edges = _union([edge(methods, "of", "id", "contains"), edge(up, "id", "base", "inherits"), edge(imports.join(users, "path"), "user", "item", "imports"), edge(di, "name", "impl", "di_registration", "lifetime"), edge(last, "src", "dst", "implements")])
    own = _union([types.select("id", "type", "language", "path", "order"), methods.select("id", F.lit("method").alias("type"), "language", "path", "order"), functions])
    said = lambda df, c, kind, path, rank: df.select(F.col(c).alias("id"), kind.alias("type"), "language", path.alias("path"), F.concat(F.col("order"), F.lit(rank)).alias("order"))
    at, nowhere = F.col("path"), F.lit("unknown")
    mentions = _union([said(up, "base", F.lit("class"), nowhere, "0"), said(imports, "item", F.col("type"), nowhere, "0"), said(di, "name", F.lit("interface"), at, "0"), said(di, "impl", F.lit("class"), at, "1")])
    mentions = mentions.groupBy("id").agg(F.min_by(F.struct("type", "language", "path"), "order").alias("m")).select("id", "m.*", F.lit("").alias("order"))  # the first one
    nodes = last_wins(own.unionByName(mentions), ["id"], ["order"]).drop("order")  # and any declaration wins
    return nodes, last_wins(edges, ["src", "dst"], ["order"]).drop("order")


def implementing(types: DataFrame) -> DataFrame:
    """(src, dst, order) of classes and the interfaces of the same namespace that they name as bases: types (id, name, kind, bases, namespace, order).

    Equality on namespace and name, so no class meets all interfaces of its namespace.
    """
    known = types.where("namespace IS NOT NULL")
    classes = known.where("kind = 'class'").select(F.col("id").alias("src"), "namespace", F.explode("bases").alias("base"), "order")
    classes = classes.withColumn("name", F.element_at(F.split(F.regexp_replace("base", r"<.*$", ""), r"\."), -1)).drop("base")
    interfaces = known.where("kind = 'interface'").select(F.col("id").alias("dst"), "namespace", "name")
    return classes.join(interfaces, ["namespace", "name"]).select("src", "dst", "order")


def class_hierarchy(entities: DataFrame) -> DataFrame:
    """(path, name, bases, line): one line a class, what it inherits from, or that it is a base class."""
    inherits = F.concat(F.lit("- **"), F.col("name"), F.lit("** inherits from "), F.array_join("bases", ", "))
    base = F.concat(F.lit("- **"), F.col("name"), F.lit("** (base class)"))
    return entities.where("kind = 'class'").select("path", "name", "bases", F.when(F.size("bases") > 0, inherits).otherwise(base).alias("line"))


def namespace_dependencies(entities: DataFrame) -> DataFrame:
    """(src, dst) of qualified C# classes: candidates using.Base for every using of the file, the class's own namespace, and Base itself if it is dotted."""
    entities = entities.where(F.lower("language").isin(*_CSHARP))
    classes = entities.where("kind = 'class'").select("path", "parent", F.concat_ws(".", "parent", "name").alias("src"), F.explode("bases").alias("base"))
    usings = entities.where("kind = 'using'").groupBy("path").agg(F.collect_set("name").alias("usings"))
    rows = classes.join(usings, "path", "left").withColumn("usings", F.coalesce("usings", F.array().cast("array<string>")))
    own = F.when(F.contains("base", F.lit(".")), F.col("base")).otherwise(F.concat_ws(".", "parent", "base"))
    return rows.select("src", F.explode(F.concat(F.array(own), F.transform("usings", lambda u: F.concat_ws(".", u, F.col("base"))))).alias("dst")).where("src != dst").distinct()


def startup_files(files: DataFrame) -> DataFrame:
    name = F.substring_index("path", "/", -1)
    return files.where(name.isin("Program.cs", "Startup.cs")).select("path", F.regexp_replace(name, r"\.cs$", "").alias("type"))


def component_templates(components: DataFrame, templates: DataFrame) -> DataFrame:
    """(component, path, inline): the first template file that a component's templateUrl names, or its inline template."""
    named = components.select(F.col("name").alias("component"), "doc", F.substring_index(F.get(F.transform(F.filter("params", lambda p: p["name"] == "templateUrl"), lambda p: p["type"]), F.lit(0)), "/", -1).alias("file"))
    first = templates.groupBy(F.substring_index("path", "/", -1).alias("file")).agg(F.min("path").alias("path"))
    return named.join(first, "file", "left").select("component", "path", F.col("doc").alias("inline")).where("path IS NOT NULL OR inline IS NOT NULL")
