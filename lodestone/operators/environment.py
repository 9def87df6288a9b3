"""Facts about a tree's build and run environment: one long table (category, key, value, path)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marker files and what they show, fixed values: (path pattern, category, key, value).
MARKERS = [
    (r"(^|/)package\.json$", "package_manager", "npm", ""), (r"(^|/)yarn\.lock$", "package_manager", "yarn", ""), (r"(^|/)requirements\.txt$", "package_manager", "pip", ""),
    (r"(^|/)Pipfile$", "package_manager", "pipenv", ""), (r"\.csproj$", "package_manager", "nuget", ""), (r"(^|/)pom\.xml$", "package_manager", "maven", ""), (r"(^|/)build\.gradle$", "package_manager", "gradle", ""),
    (r"^webpack\.config\.js$", "build_system", "webpack", ""), (r"^\.babelrc$", "build_system", "babel", ""), (r"^tsconfig\.json$", "build_system", "typescript", ""), (r"^Makefile$", "build_system", "make", ""),
    (r"^[^/]*\.sln$", "build_system", "msbuild", ""), (r"(^|/)pom\.xml$", "build_system", "maven", ""), (r"(^|/)build\.gradle$", "build_system", "gradle", ""),
    (r"(^|/)Dockerfile$", "container", "docker", ""), (r"^docker-compose\.ya?ml$", "container", "docker-compose", ""), (r"^kubernetes/", "container", "kubernetes", ""),
    (r"^\.github/workflows/[^/]+\.ya?ml$", "ci", "github-actions", ""), (r"^\.gitlab-ci\.yml$", "ci", "gitlab", ""), (r"^Jenkinsfile$", "ci", "jenkins", ""), (r"^\.travis\.yml$", "ci", "travis", ""), (r"^azure-pipelines\.yml$", "ci", "azure-pipelines", ""),
]
# Packages that name a framework, fixed values: (ecosystem, pattern, framework).
FRAMEWORKS = [("npm", "^react$", "React"), ("npm", "^@angular/core$", "Angular"), ("npm", "^vue$", "Vue.js"), ("pip", "(?i)^django$", "Django"), ("pip", "(?i)^flask$", "Flask"), ("pip", "(?i)^fastapi$", "FastAPI"), ("nuget", r"Microsoft\.AspNetCore", "ASP.NET Core")]
# Suffixes of settings files, fixed values.
CONFIG_SUFFIXES = (".config", ".ini", ".json", ".toml", ".xml", ".yaml", ".yml")
_REQUIREMENT = r"^\s*([A-Za-z0-9._\[\],-]+)\s*(?:(===|==|>=|<=|~=|!=|>|<)\s*([^;#\s]+))?"


def packages(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(keep, path, ecosystem, scope, name, version) from package.json, requirements.txt and project files; of a project package's repeats the last version counts.

    keep are columns that name a tree, for files of many trees.
    """
    k = keep or []
    kind = "struct<dependencies:map<string,string>,devDependencies:map<string,string>,peerDependencies:map<string,string>>"
    npm = files.where(F.col("path").rlike(r"(^|/)package\.json$")).select(*k, "path", F.from_json("content", kind).alias("j"))
    scopes = F.array(*[F.struct(F.lit(s).alias("scope"), F.col(f"j.{s}").alias("m")) for s in ("dependencies", "devDependencies", "peerDependencies")])
    npm = npm.select(*k, "path", F.explode(scopes).alias("s")).select(*k, "path", "s.scope", F.explode("s.m").alias("name", "version"))
    npm = npm.select(*k, "path", F.lit("npm").alias("ecosystem"), "scope", "name", "version")
    line = files.where(F.col("path").rlike(r"(^|/)requirements\.txt$")).select(*k, "path", F.explode(F.split("content", "\n", -1)).alias("line")).where("trim(line) != '' AND NOT startswith(trim(line), '#')")
    part = lambda g: F.regexp_extract("line", _REQUIREMENT, g)
    pip = line.select(*k, "path", F.lit("pip").alias("ecosystem"), F.lit("dependencies").alias("scope"), part(1).alias("name"), F.coalesce(F.nullif(part(3), F.lit("")), F.lit("latest")).alias("version")).where("name != ''")
    include = r'<PackageReference\s+Include="([^"]+)"\s+Version="([^"]+)"'
    pairs = F.arrays_zip(F.regexp_extract_all("content", F.lit(include), F.lit(1)).alias("name"), F.regexp_extract_all("content", F.lit(include), F.lit(2)).alias("version"))
    net = files.where(F.col("path").rlike(r"\.csproj$")).select(*k, "path", F.posexplode(pairs).alias("seq", "p")).groupBy(*k, F.col("p.name").alias("name")).agg(F.max_by("p.version", F.struct("path", "seq")).alias("version"), F.max("path").alias("path"))
    return npm.unionByName(pip).unionByName(net.select(*k, "path", F.lit("nuget").alias("ecosystem"), F.lit("dependencies").alias("scope"), "name", "version"))


def legacy_requirement(line: Column) -> Column:
    """struct<name, version> by one split at the first of = < > ~ , which leaves the rest of a two-character operator in the version."""
    parts = F.split(F.trim(line), "[=<>~]", 2)
    return F.struct(F.trim(parts[0]).alias("name"), F.coalesce(F.trim(F.get(parts, F.lit(1))), F.lit("latest")).alias("version"))


def facts(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(keep, category, key, value, path) of files (keep, path, content), without repeats. Values of .env files are never read out."""
    k = keep or []
    path = F.col("path")
    struct = lambda c, k, v: F.struct(F.lit(c).alias("category"), k.alias("key"), v.alias("value"))
    none = F.lit("")
    marks = F.array(*[F.when(path.rlike(p), struct(c, F.lit(k), F.lit(v))) for p, c, k, v in MARKERS])
    base = F.substring_index("path", "/", -1)
    own = F.array(
        F.when(path.rlike(r"(^|/)pyproject\.toml$") & F.contains("content", F.lit("[tool.poetry]")), struct("package_manager", F.lit("poetry"), none)),
        F.when(base == "Dockerfile", struct("base_image", F.coalesce(F.nullif(F.regexp_extract("content", r"(?m)^FROM (.+)$", 1), none), F.lit("unknown")), none)),
        F.when(path.rlike(r"\.ya?ml$") & F.contains("content", F.lit("apiVersion:")) & F.contains("content", F.lit("kind:")) & F.col("content").rlike("kind: (Deployment|Service|Pod)"), struct("container", F.lit("kubernetes-manifest"), none)),
        F.when(path.rlike(r"(^|/)(appsettings|config|settings)[^/]*$") & reduce(lambda a, b: a | b, [F.endswith(path, F.lit(s)) for s in CONFIG_SUFFIXES]), struct("config_file", path, none)),
    )
    rows = files.select(*k, "path", F.explode(F.array_compact(F.concat(marks, own))).alias("f")).select(*k, "f.*", "path")
    env = files.where(F.startswith(base, F.lit(".env")) | F.endswith(base, F.lit(".env"))).select(*k, "path", F.explode(F.split("content", "\n", -1)).alias("line")).where("trim(line) != '' AND NOT startswith(trim(line), '#')")
    env = env.select(*k, F.lit("env_variable").alias("category"), F.trim(F.regexp_extract("line", r"^\s*(?:export\s+)?([^=]*)", 1)).alias("key"), none.alias("value"), "path")
    manifest = files.where(F.col("path").rlike(r"(^|/)package\.json$")).select(*k, "path", F.from_json("content", "struct<scripts:map<string,string>,engines:map<string,string>>").alias("j"))
    more = [manifest.select(*k, "path", F.explode(f"j.{j}").alias("key", "value")).select(*k, F.lit(c).alias("category"), "key", "value", "path") for j, c in (("scripts", "npm_script"), ("engines", "runtime"))]
    pk = packages(files, keep)
    deps = pk.select(*k, F.lit("dependency").alias("category"), F.col("name").alias("key"), F.col("version").alias("value"), "path")
    named = F.array_compact(F.array(*[F.when((F.col("ecosystem") == e) & F.col("name").rlike(p), F.lit(n)) for e, p, n in FRAMEWORKS]))
    fw = pk.select(*k, F.lit("framework").alias("category"), F.explode(named).alias("key"), none.alias("value"), "path")
    return reduce(DataFrame.unionByName, [rows, env, *more, deps, fw]).distinct()


def config_json(files: DataFrame) -> DataFrame:
    """(path, projects): the workspace file angular.json, or .angular-cli.json if that is missing or broken."""
    rows = files.where(F.col("path").isin("angular.json", ".angular-cli.json")).select("path", F.try_parse_json("content").alias("j")).where("j IS NOT NULL")
    return rows.orderBy(F.desc(F.col("path") == "angular.json")).limit(1).select("path", F.to_json("j").alias("config"))
