"""Rule-based classification of files, folders and graphs.

All rules of a language are one array expression with constant patterns, so a corpus is classified in one
scan; hits come out by exploding what matched.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parse import ANGULAR_MARKS, ANGULAR_SUFFIXES


@dataclass(frozen=True)
class Rule:
    """A name of a kind (D design, A architectural, L language, O organization), hit if any of the patterns matches."""

    name: str
    kind: str
    confidence: str
    patterns: tuple[str, ...]
    #: Pattern that must match as well.
    gate: str = ""


_I = "(?i)"

# The rules of each language group, fixed values.
CSHARP = [
    Rule("Factory Pattern", "D", "high", (_I + r"class\s+\w*Factory\b",)),
    Rule("Repository Pattern", "D", "high", (_I + r"class\s+\w*Repository\b", _I + r"interface\s+I\w*Repository\b")),
    Rule("Unit of Work Pattern", "D", "high", (_I + r"class\s+\w*UnitOfWork\b", _I + r"interface\s+I\w*UnitOfWork\b")),
    Rule("Dependency Injection", "D", "high", (r"services\.Add\w+<", r"constructor\s*\(\s*[^)]*\b(?:I\w+)\s+\w+\s*[,)]")),
    Rule("Inversion of Control", "A", "high", (r"services\.Add\w+<", r"constructor\s*\(\s*[^)]*\b(?:I\w+)\s+\w+\s*[,)]")),
    Rule("CQRS", "A", "medium", (_I + r"class\s+\w*Command\b", _I + r"class\s+\w*Query\b", _I + r"interface\s+I\w*Handler\b")),
    Rule("MVC", "A", "high", (_I + r"class\s+\w*Controller\b",)),
    Rule("MVVM", "A", "high", (_I + r"class\s+\w*ViewModel\b",)),
    Rule("Mediator Pattern", "D", "high", (_I + r"class\s+\w*Mediator\b", _I + r"interface\s+I\w*Mediator\b")),
    Rule("Observer Pattern", "D", "medium", (r"event\s+\w+\s+\w+", r"\.Subscribe\(")),
    Rule("Strategy Pattern", "D", "high", (_I + r"interface\s+I\w*Strategy\b",)),
    Rule("ConfigureAwait Pattern", "L", "high", (r"\.ConfigureAwait\(false\)",)),
    Rule("LINQ Materialization", "L", "medium", (r"\.ToList\(\)", r"\.ToArray\(\)")),
    Rule("Entity Framework", "L", "high", (r"class\s+\w+\s*:\s*DbContext",)),
    Rule("Service Locator Pattern", "D", "high", (r"\.Add\(new\s+TypeRegistration\(typeof\(\w+\),\s*typeof\(\w+\),",)),
]
_NG, _REACT = "@angular", _I + "react|jsx"
TYPESCRIPT = [
    Rule("Angular Component", "L", "high", (r"@Component\(\s*\{",), _NG),
    Rule("Angular Service", "L", "high", (r"@Injectable\(\s*\{",), _NG),
    Rule("Dependency Injection", "D", "high", (r"@Injectable\(\s*\{",), _NG),
    Rule("Angular Module", "L", "high", (r"@NgModule\(\s*\{",), _NG),
    Rule("Angular Routing", "L", "high", (r"RouterModule\.forRoot\(", r"RouterModule\.forChild\("), _NG),
    Rule("Angular Reactive Forms", "L", "high", (r"FormBuilder", r"FormGroup", r"FormControl"), _NG),
    Rule("Angular Template-driven Forms", "L", "high", (r"ngModel", r"ngForm"), _NG),
    Rule("Angular HTTP Client", "L", "high", (r"HttpClient",), _NG),
    Rule("React Component", "L", "high", (r"class\s+\w+\s+extends\s+(?:React\.)?Component", r"function\s+\w+\s*\([^)]*\)\s*\{[^}]*return\s*\("), _REACT),
    Rule("React Hooks", "L", "high", (r"useState\(", r"useEffect\(", r"useContext\("), _REACT),
    Rule("Redux", "L", "high", (r"createStore", r"combineReducers", r"useSelector", r"useDispatch"), _REACT),
    Rule("Flux/Redux", "A", "high", (r"createStore", r"combineReducers", r"useSelector", r"useDispatch"), _REACT),
    Rule("Factory Pattern", "D", "high", (_I + r"class\s+\w*Factory\b", _I + r"function\s+\w*Factory\b")),
    Rule("Singleton Pattern", "D", "high", (r"static\s+instance", r"private\s+constructor", r"getInstance\(\)")),
    Rule("Observer Pattern", "D", "high", (r"\.subscribe\(", r"\.addEventListener\(", r"Subject<")),
    Rule("Module Pattern", "D", "medium", (r"export\s+const", r"export\s+function", r"export\s+class")),
    Rule("Promise/Async-Await", "L", "high", (r"new\s+Promise\(", r"async\s+function", r"await\s+")),
]
PYTHON = [
    Rule("Factory Pattern", "D", "high", (_I + r"class\s+\w*Factory\b", _I + r"def\s+create_\w+\(")),
    Rule("Singleton Pattern", "D", "high", (r"__instance\s*=\s*None", r"instance\s*=\s*None", r"cls\._\w+\s*=\s*cls\(")),
    Rule("Decorator Pattern", "D", "high", (r"def\s+\w+\s*\(\s*\w+\s*\)\s*:\s*\n\s*def\s+wrapper", r"@\w+")),
    Rule("Strategy Pattern", "D", "high", (_I + r"class\s+\w+Strategy\b",)),
    Rule("Observer Pattern", "D", "medium", (r"def\s+notify\(", r"def\s+update\(", r"observers\s*=\s*\[\]")),
    Rule("Flask Framework", "L", "high", (r"from\s+flask\s+import", r"app\s*=\s*Flask\(")),
    Rule("MVC", "A", "medium", (r"from\s+flask\s+import", r"app\s*=\s*Flask\(")),
    Rule("Django Framework", "L", "high", (r"from\s+django", r"from\s+rest_framework")),
    Rule("MVT", "A", "high", (r"from\s+django", r"from\s+rest_framework")),
    Rule("FastAPI Framework", "L", "high", (r"from\s+fastapi\s+import", r"app\s*=\s*FastAPI\(")),
    Rule("SQLAlchemy ORM", "L", "high", (r"from\s+sqlalchemy", r"db\.Column")),
    Rule("Django ORM", "L", "high", (r"from\s+django\.db\s+import\s+models", r"class\s+\w+\(models\.Model\)")),
    Rule("Asyncio", "L", "high", (r"async\s+def", r"await\s+", r"asyncio")),
    Rule("Type Annotations", "L", "high", (r"from\s+typing\s+import",)),
    Rule("Dataclasses", "L", "high", (r"@dataclass", r"from\s+dataclasses\s+import")),
]
#: Aliases of a language to its group; any other language has no rules.
GROUPS = {"csharp": CSHARP, "cs": CSHARP, "c#": CSHARP, "typescript": TYPESCRIPT, "ts": TYPESCRIPT, "javascript": TYPESCRIPT, "js": TYPESCRIPT, "python": PYTHON, "py": PYTHON}


def _hit(rule: Rule, text: Column, path: Column | None) -> Column:
    any_of = reduce(lambda a, b: a | b, [text.rlike(p) for p in rule.patterns])
    if not rule.gate:
        return any_of
    gate = text.rlike(rule.gate)
    if rule.gate == _NG and path is not None:  # an Angular file by its name or its decorators
        gate = gate | reduce(lambda a, b: a | b, [F.contains(path, F.lit(x)) for x in ANGULAR_SUFFIXES] + [F.contains(text, F.lit(x)) for x in ANGULAR_MARKS])
    return gate & any_of


def _hits_array(rules: list[Rule], text: Column, path: Column | None = None, first: int = 0) -> Column:
    return F.array_compact(F.array(*[F.when(_hit(r, text, path), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.name).alias("name"), F.lit(r.confidence).alias("confidence"), F.lit(first + i).alias("rule_no"))) for i, r in enumerate(rules)]))


def rule_hits(files: DataFrame, rules: list[Rule], *, text: str = "content", keep: list[str], seq: Column) -> DataFrame:
    """keep, kind, name, confidence and seq (the file's order plus the rule's) of every rule that a file meets."""
    rows = files.select(*keep, seq.alias("_seq"), F.explode(_hits_array(rules, F.col(text))).alias("h"))
    return rows.select(*keep, "h.kind", "h.name", "h.confidence", (F.col("_seq") + F.col("h.rule_no")).alias("seq"))


def file_patterns(files: DataFrame, *, path: str = "path", language: str = "language", text: str = "content") -> DataFrame:
    """(path, kind, name, confidence, rule_no) by the rules of each file's language, in one scan."""
    low, hits = F.lower(language), F.array().cast("array<struct<kind:string,name:string,confidence:string,rule_no:int>>")
    for rules in (CSHARP, TYPESCRIPT, PYTHON):
        names = [k for k, v in GROUPS.items() if v is rules]
        hits = F.when(low.isin(names), _hits_array(rules, F.col(text), F.col(path))).otherwise(hits)
    return files.select(path, F.explode(hits).alias("h")).select(path, "h.*")


# Words of folder rules, fixed values; they may stand anywhere in a folder's path.
FEATURE = ("feature", "module", "domain")
LAYER = ("controller", "service", "repository", "model", "dao", "api", "view", "ui")
COMPONENT = ("component", "widget", "element")
MANIFESTS = ("Dockerfile", "package.json", "setup.py")


@dataclass(frozen=True)
class Layout:
    name: str
    #: Paths of which all must exist, for each alternative.
    needs: tuple[tuple[str, ...], ...] = field(default=())


LAYOUTS = [
    Layout("Monorepo", (("packages",), ("apps", "libs"))),
    Layout("Angular CLI Project", (("angular.json",),)),
    Layout("Angular Standard Layout", (("src/app/app.module.ts",),)),
    Layout("Create React App Layout", (("public/index.html", "src/App.js"), ("public/index.html", "src/App.tsx"))),
    Layout("Django Project Layout", (("manage.py", "requirements.txt"),)),
    Layout("Flask Project Layout", (("app.py", "templates"),)),
]


def folders(files: DataFrame, path: str = "path", keep: list[str] | None = None) -> DataFrame:
    """(keep, dir) of all folders above files, without those whose path starts with .git."""
    parts = F.split(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda n: F.array_join(F.slice("p", 1, n), "/"))
    rows = files.select(*(keep or []), parts.alias("p")).where("size(p) > 1").select(*(keep or []), F.explode(prefixes).alias("dir")).distinct()
    return rows.where("dir != '' AND dir != '.' AND NOT startswith(dir, '.git')")


def folder_patterns(files: DataFrame, path: str = "path", keep: list[str] | None = None) -> DataFrame:
    """(keep, name, kind, confidence) of the organization that folder names and marker files show, for each tree that the columns keep name.

    Every folder and file adds to its tree's counters in one map-side combined aggregate.
    """
    keep = keep or []
    parent = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    dirs = folders(files, path, keep).select(*keep, F.col("dir").alias("at"), F.lit(True).alias("is_dir"), F.lit(None).cast("string").alias("service"))
    manifest = F.substring_index(path, "/", -1).isin(*MANIFESTS) & F.contains(F.lower(parent), F.lit("service")) & ~F.startswith(parent, F.lit(".git"))
    every = dirs.unionByName(files.select(*keep, F.col(path).alias("at"), F.lit(False).alias("is_dir"), F.when(manifest, parent).alias("service")))
    low = F.lower("at")
    word = lambda words: F.count_if(F.col("is_dir") & reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]))
    marks = sorted({m for x in LAYOUTS for alt in x.needs for m in alt})
    counts = [word(FEATURE).alias("feature"), word(LAYER).alias("layer"), word(COMPONENT).alias("component"), F.count_distinct("service").alias("services")]
    one = every.groupBy(*keep).agg(*counts, *[F.coalesce(F.max(F.col("at") == m), F.lit(False)).alias(f"m{i}") for i, m in enumerate(marks)])
    have = {m: F.col(f"m{i}") for i, m in enumerate(marks)}
    tests = [("Feature-based Organization", "O", F.col("feature") > 1), ("Layer-based Organization", "O", F.col("layer") > 2), ("Component-based Organization", "O", F.col("component") > 2), ("Microservices Architecture", "A", F.col("services") > 1)]
    for x in LAYOUTS:
        tests.append((x.name, "O", reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [have[m] for m in alt]) for alt in x.needs])))
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), F.lit("high").alias("confidence"))) for n, k, c in tests]))
    return one.select(*keep, F.explode(hits).alias("h")).select(*keep, "h.*")
