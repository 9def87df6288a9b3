"""Queries of the extractors over source trees made from documents: the driver's tables hold no source code.

Every document stands for one file (by its id one of MARKED, with the id in all names), one rule's text, or one repository. The
SQL gives, for each of these sources, rows that the parsers gave first and that were then checked by hand (the rules' and trees' were written by hand), with
the id put in for each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import code_graph, environment, extract, graph, patterns, relational, rollup
from .registry import query, table
from .storage import written

#: Stands in every name of the sources below; a document's id takes its place, or nothing.
MARK = "Z9Z"
_CSHARP = """using SystemZ9Z;
using A.BZ9Z;

/// <summary>Keeps users.</summary>
namespace N.MZ9Z
{
    /// <summary>All of them.</summary>
    public class UserZ9ZController : BaseZ9Z, IUserStoreZ9Z
    {
        private readonly IClockZ9Z clock;
        public const int Most = 9;
        public string Title { get; set; }
        public UserZ9ZController(IClockZ9Z clock, ILogZ9Z log) { this.clock = clock; }
        /// <summary>Finds one.</summary>
        /// <param name="id">Its id.</param>
        /// <returns>The user.</returns>
        public string Get(int id) { if (id > 0) { return "x"; } return ""; } // TODO cache
    }
    public interface IUserStoreZ9Z { string Get(int id); }
    public class SetupZ9Z { void Configure(S services) { services.AddScoped<IUserStoreZ9Z, UserZ9ZController>(); services.AddSingleton<ClockZ9Z>(); } }
}
"""
_TYPESCRIPT = """/** Shows users. */
import { Component, Input } from '@angular/core';
import { UserService, Other as O } from './userZ9Z.service';

@Component({ selector: 'app-user', templateUrl: './userZ9Z.component.html', styleUrls: ['./a.css', './b.css'] })
export class UserComponentZ9Z extends BaseZ9Z implements OnInitZ9Z, OnDestroyZ9Z {
  @Input() name: string;
  @Output() done = new EventEmitter();
  private items: Map<string, number>;
  constructor(private service: UserService) { super(); }
  async load(id: number, opts: { deep: boolean }): Promise<void> { if (id) { this.items = null; } }
}

/**
 * Adds.
 * @param {number} a the first
 * @returns the sum
 */
export function addZ9Z(a, b: number): number { return a + b; }
"""
_PYTHON = '''"""About users."""
import osZ9Z
from typingZ9Z import List as L


class UserZ9Z(BaseZ9Z, abc.ABCZ9Z):
    """A user."""
    table = "users"

    @property
    def name(self) -> str:
        return self._name

    async def load(self, key: int):
        """Loads.

        Args:
            key: its key
        Returns:
            nothing
        """
        await osZ9Z.read(key)


def create_userZ9Z(name):
    return UserZ9Z(name)  # TODO check
'''
_RUBY = "# a\n\nclass ShopZ9Z\n  def price(x)\n  end\nend\nrequire 'setZ9Z'\n"

MARKED = [("src/N/UserController.cs", "csharp", _CSHARP), ("src/app/user.component.ts", "typescript", _TYPESCRIPT), ("app/users.py", "python", _PYTHON), ("broken.py", "python", "def xZ9Z(:\n"), ("shop.rb", "ruby", _RUBY), ("empty.cs", "csharp", ""), ("null.ts", "typescript", None)]
FILES = [(p, g, None if t is None else t.replace(MARK, "")) for p, g, t in MARKED]
CSHARP, TYPESCRIPT, PYTHON, RUBY = (x.replace(MARK, "") for x in (_CSHARP, _TYPESCRIPT, _PYTHON, _RUBY))
TREE = [
    ("package.json", '{"dependencies": {"react": "^18", "left-pad": "1"}, "devDependencies": {"jest": "29"}, "scripts": {"test": "jest"}, "engines": {"node": ">=18"}}'),
    ("requirements.txt", "# base\nflask==2.0\nnumpy\na>=1\nb!=2\n"), ("a.csproj", '<PackageReference Include="Microsoft.AspNetCore.App" Version="2.2" />\n<PackageReference Include="X" Version="1" />\n<PackageReference Include="X" Version="2" />'),
    (".env", "KEY=secret\n# no\nexport OTHER=1\n"), ("Dockerfile", "FROM python:3.13\nRUN x\n"), ("k8s/deploy.yaml", "apiVersion: apps/v1\nkind: Deployment\n"), (".github/workflows/ci.yml", "on: push"), (".gitlab-ci.yml", "x: y"),
    ("controllers/a.py", ""), ("models/b.py", ""), ("views/c.py", ""), ("services/d.py", ""), ("order-service/package.json", "{}"), ("user-service/Dockerfile", "FROM scratch"), ("manage.py", ""), ("pyproject.toml", "[tool.poetry]\n"),
]


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "path string, language string, content string")


def tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TREE, "path string, content string")


# --- sources made from documents
def _pick(spark: SparkSession, d: str, rows: list[tuple], schema: str) -> DataFrame:
    """rows[doc_id % len(rows)] for every document, with doc_id; MARK becomes the id."""
    literal = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"t int, {schema}")
    docs = table(spark, d, "documents").select("doc_id", F.pmod(F.col("doc_id"), F.lit(len(rows))).cast("int").alias("t"))
    out = docs.join(F.broadcast(literal), "t")  # a literal table
    return out.select("doc_id", *[F.replace(F.col(c), F.lit(MARK), F.col("doc_id").cast("string")).alias(c) for c in literal.columns[1:]])


def marked_files(spark: SparkSession, d: str) -> DataFrame:
    rows = _pick(spark, d, MARKED, "path string, language string, content string")
    return rows.select(F.concat(F.lit("d"), F.col("doc_id"), F.lit("/"), "path").alias("path"), "language", "content")


def marked_trees(spark: SparkSession, d: str, trees: list[list[tuple[str, str]]]) -> DataFrame:
    """(repo_id, path, content): each document is a repository with the files of one of the trees."""
    literal = spark.createDataFrame([(i, p, c) for i, files in enumerate(trees) for p, c in files], "t int, path string, content string")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("repo_id"), F.pmod(F.col("doc_id"), F.lit(len(trees))).cast("int").alias("t"))
    return docs.join(F.broadcast(literal), "t").drop("t")


def _literal(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


def _given(n: int, columns: str, rows: list[tuple], *, numbers: tuple[str, ...] = (), path: str | None = "path") -> str:
    """SQL of rows (t, columns...) for each document with doc_id % n = t; MARK becomes the id, a path gets the document's folder."""
    names = columns.split()
    values = ", ".join("(" + ", ".join(_literal(x) for x in r) + ")" for r in rows)
    cell = lambda c: f"v.{c}::BIGINT AS {c}" if c in numbers else f"'d' || doc_id || '/' || v.{c} AS {c}" if c == path else f"replace(v.{c}::VARCHAR, '{MARK}', doc_id::VARCHAR) AS {c}"
    return f"SELECT {', '.join(cell(c) for c in names)} FROM documents JOIN (VALUES {values}) v(t, {', '.join(names)}) ON doc_id % {n} = t"


def _flat(df: DataFrame) -> DataFrame:
    params = F.array_join(F.transform("params", lambda p: F.concat_ws(":", p["name"], p["type"])), ",")
    return df.withColumn("params", params).withColumn("bases", F.array_join("bases", ",")).withColumn("flags", F.array_join("flags", ","))


_CS, _TS, _PY = (p for p, _, _ in MARKED[:3])
_N = len(MARKED)
_C, _I, _S = f"User{MARK}Controller", f"IUserStore{MARK}", f"Setup{MARK}"
_UC, _U = f"UserComponent{MARK}", f"User{MARK}"
_LOADS = "Loads.\n\nArgs:\n    key: its key\nReturns:\n    nothing"


def _e(t, seq, kind, name, parent=None, access=None, modifier=None, type=None, bases="", params="", flags="", doc=None, first=None, last=None):
    path, language, _ = MARKED[t]
    return (t, path, language, seq, kind, name, parent, access, modifier, type, bases, params, flags, doc, first, last)


_ENTITIES = [
    _e(0, 0, "namespace", f"N.M{MARK}"), _e(0, 1, "using", f"System{MARK}", first=1), _e(0, 2, "using", f"A.B{MARK}", first=2),
    _e(0, 3, "class", _C, f"N.M{MARK}", "public", bases=f"Base{MARK},{_I}", first=8, last=18), _e(0, 4, "class", _S, f"N.M{MARK}", "public", first=20, last=20),
    _e(0, 5, "interface", _I, f"N.M{MARK}", "public", first=19, last=19),
    _e(0, 6, "constructor", _C, _C, "public", params=f"clock:IClock{MARK},log:ILog{MARK}", first=13, last=13),
    _e(0, 7, "method", "Get", _C, "public", type="string", params="id:int", first=17, last=17), _e(0, 8, "method", "Get", None, "private", type="string", params="id:int", first=19, last=19),
    _e(0, 9, "method", "Configure", _S, "private", type="void", params="services:S", first=20, last=20),
    _e(0, 10, "constructor_parameter", "clock", _C, type=f"IClock{MARK}"), _e(0, 11, "constructor_parameter", "log", _C, type=f"ILog{MARK}"),
    _e(0, 12, "property", "Title", _C, "public", type="string", first=12), _e(0, 13, "property", "clock", _C, "private", "readonly", f"IClock{MARK}", flags="is_field", first=10),
    _e(0, 14, "property", "Most", _C, "public", "const", "int", flags="is_constant", first=11),
    _e(0, 15, "di_registration", _I, type="Scoped", bases=_C, first=20), _e(0, 16, "di_registration", f"Clock{MARK}", type="Singleton", bases=f"Clock{MARK}", first=20),
    _e(1, 0, "import", "@angular/core", bases="Component,Input", first=2), _e(1, 1, "import", f"./user{MARK}.service", bases="UserService,Other", first=3),
    _e(1, 2, "class", _UC, type=f"Base{MARK}", bases=f"OnInit{MARK},OnDestroy{MARK}", flags="is_component", doc="app-user", first=6, last=12),
    _e(1, 3, "constructor", "constructor", _UC, "public", type="any", params="service:UserService", first=10, last=10),
    _e(1, 4, "method", "load", _UC, "public", "async", "Promise<void>", params="id:number,opts:{ deep: boolean }", first=11, last=11),
    _e(1, 5, "property", "name", _UC, "public", type="string", flags="is_input", first=7), _e(1, 6, "property", "done", _UC, "public", type="any", flags="is_output", first=8),
    _e(1, 7, "property", "items", _UC, "private", type="Map<string, number>", first=9), _e(1, 8, "function", f"add{MARK}", type="number", params="a:any,b:number", first=19, last=19),
    _e(2, 0, "module_doc", None, doc="About users."), _e(2, 1, "import", f"os{MARK}", first=2), _e(2, 2, "import", f"typing{MARK}.List", type="L", first=3),
    _e(2, 3, "class", _U, bases=f"Base{MARK},abc.ABC{MARK}", doc="A user.", first=6, last=22), _e(2, 4, "property", "table", _U, first=8),
    _e(2, 5, "method", "name", _U, type="str", flags="@property", first=11, last=12), _e(2, 6, "method", "load", _U, params="key:int", flags="is_async", doc=_LOADS, first=14, last=22),
    _e(2, 7, "function", f"create_user{MARK}", params="name:", first=25, last=26),
    _e(3, 0, "function", f"x{MARK}", first=1),
    _e(4, 0, "function", "price", first=4), _e(4, 1, "class", f"Shop{MARK}", type="class", first=3), _e(4, 2, "import", f"set{MARK}"),
    _e(5, 0, "namespace", "Unknown"),
]


@query(_given(_N, "path language seq kind name parent access modifier type bases params flags doc first_line last_line", _ENTITIES, numbers=("seq", "first_line", "last_line")))
def ext_entities(spark, d):
    return _flat(extract.entities(marked_files(spark, d)))


_ANGULAR = [
    (1, _TS, 0, "import", "@angular/core", None, None, "Component,Input", "", "", None), (1, _TS, 1, "import", f"./user{MARK}.service", None, None, "UserService,Other as O", "", "", None),
    (1, _TS, 2, "component", _UC, None, "app-user", "./a.css,./b.css", f"templateUrl:./user{MARK}.component.html", "", None),
    (1, _TS, 3, "exported_class", _UC, None, f"Base{MARK}", f"OnInit{MARK},OnDestroy{MARK}", "Input:name,Output:done", "", None),
]


@query(_given(_N, "path seq kind name parent type bases params flags doc", _ANGULAR, numbers=("seq",)))
def ext_angular(spark, d):
    rows = _flat(extract.angular_entities(marked_files(spark, d).where("language = 'typescript'")))
    return rows.select("path", "seq", "kind", "name", "parent", "type", "bases", "params", "flags", "doc")


def _d(t, seq, kind, name, text, returns=None, params=""):
    path, language, _ = MARKED[t]
    return (t, path, language, seq, kind, name, text, returns, params)


_DOCUMENTATION = [
    _d(0, 0, "file", None, "<summary>Keeps users.</summary>"), _d(0, 1, "namespace", f"N.M{MARK}", "Keeps users."), _d(0, 2, "class", _C, "All of them."),
    _d(0, 3, "method", "Get", "Finds one.", "The user.", "id:Its id."), _d(0, 4, "comment", None, "<summary>Keeps users.</summary>"),
    _d(0, 5, "comment", None, "<summary>All of them.</summary>"), _d(0, 6, "comment", None, "<summary>Finds one.</summary>"),
    _d(0, 7, "comment", None, '<param name="id">Its id.</param>'), _d(0, 8, "comment", None, "<returns>The user.</returns>"), _d(0, 9, "todo", None, "cache"),
    _d(1, 0, "file", None, "Shows users."), _d(1, 1, "function", f"add{MARK}", "Adds.", "the sum", "a:the first"),
    _d(1, 2, "component", "app-user", "", None, f"selector:app-user,templateUrl:./user{MARK}.component.html,styleUrls:./a.css,styleUrls:./b.css"),
    _d(1, 3, "comment", None, "Shows users."), _d(1, 4, "comment", None, "Adds.\n@param {number} a the first\n@returns the sum"),
    _d(2, 0, "module", None, "About users."), _d(2, 1, "class", _U, "A user."), _d(2, 2, "method", "load", _LOADS, "nothing", "key:its key"),
    _d(4, 0, "comment", None, "a"),
]


@query(_given(_N, "path language seq kind name text returns params", _DOCUMENTATION, numbers=("seq",)))
def ext_documentation(spark, d):
    return extract.documentation(marked_files(spark, d)).withColumn("params", F.array_join(F.transform("params", lambda p: F.concat_ws(":", p["name"], p["text"])), ","))


def _between(text: str, start: str, end: str | None) -> str:
    at = text.index(start)
    return text[at : None if end is None else text.index(end, at)]


_CLASS = _between(_CSHARP, f"public class {_C}", f"    public interface {_I}").rstrip()
_COMPONENT = _between(_TYPESCRIPT, "@Component(", "/**\n * Adds").rstrip()
_CHUNKS = [
    (0, _CS, "csharp", 0, "class", _C, _CLASS), (0, _CS, "csharp", 1, "class", _S, _between(_CSHARP, f"public class {_S}", "\n}")), (0, _CS, "csharp", 2, "interface", _I, _between(_CSHARP, f"public interface {_I}", "\n    public class Setup")),
    (1, _TS, "typescript", 0, "imports", None, _between(_TYPESCRIPT, "/** Shows", "\n\n@Component")), (1, _TS, "typescript", 1, "angular_component", _UC, _COMPONENT), (1, _TS, "typescript", 2, "class", _UC, _COMPONENT[_COMPONENT.index("export class") :]),
    (2, _PY, "python", 0, "class", _U, _between(_PYTHON, "class User", "\n\n\ndef create")), (2, _PY, "python", 1, "function", f"create_user{MARK}", _between(_PYTHON, "def create", "\n" + "$") if "$" in _PYTHON else _PYTHON[_PYTHON.index("def create") :].rstrip("\n")),
    (3, "broken.py", "python", 0, "file", None, f"def x{MARK}(:\n"), (4, "shop.rb", "ruby", 0, "file", None, _RUBY), (5, "empty.cs", "csharp", 0, "file", None, ""), (6, "null.ts", "typescript", 0, "file", None, ""),
]


@query(f"SELECT path || '_chunk_' || chunk_no AS chunk_id, * FROM ({_given(_N, 'path language chunk_no type name content', _CHUNKS, numbers=('chunk_no',))})")
def ext_chunks(spark, d):
    return extract.chunks(marked_files(spark, d))


@query("SELECT 's' || doc_id || '.sln' AS path, 'Web' || doc_id AS project, 'src/Web/W' || doc_id || '.csproj' AS project_path, '1234' AS guid FROM documents")
def ext_solution(spark, d):
    text = f'Project("{{FAE0}}") = "Web{MARK}", "src\\Web\\W{MARK}.csproj", "{{1234}}"\nEndProject\n'
    return extract.solutions(_pick(spark, d, [(f"s{MARK}.sln", "sln", text)], "path string, language string, content string"))


# --- graphs
def _graph(spark, d):
    """The graph is built from stored entities, as in an analysis: files are parsed once."""
    return code_graph.build(written(extract.entities(marked_files(spark, d)), "entities"))


def _stored_graph(spark, d):
    return tuple(written(x, "graph") for x in _graph(spark, d))


_NODES = [
    (0, f"N.M{MARK}.{_C}", "class", "csharp", _CS), (0, f"N.M{MARK}.{_C}.Get", "method", "csharp", _CS), (0, f"N.M{MARK}.{_S}", "class", "csharp", _CS), (0, f"N.M{MARK}.{_S}.Configure", "method", "csharp", _CS),
    (0, f"N.M{MARK}.{_I}", "interface", "csharp", _CS), (0, _I, "interface", "csharp", _CS), (0, _C, "class", "csharp", _CS), (0, f"Clock{MARK}", "interface", "csharp", _CS),
    (1, _UC, "component", "typescript", _TS), (1, f"{_UC}.load", "method", "typescript", _TS), (1, "UserService", "import", "typescript", None), (1, "Other", "import", "typescript", None),
    (2, _U, "class", "python", _PY), (2, f"{_U}.name", "method", "python", _PY), (2, f"{_U}.load", "method", "python", _PY), (2, f"create_user{MARK}", "function", "python", _PY),
    (2, f"Base{MARK}", "class", "python", None), (2, f"abc.ABC{MARK}", "class", "python", None), (2, f"os{MARK}", "module", "python", None), (2, f"typing{MARK}.List", "module", "python", None),
    (3, f"x{MARK}", "function", "python", "broken.py"),
]
_NODES_SQL = f"SELECT DISTINCT id, type, language, coalesce(path, 'unknown') AS path FROM ({_given(_N, 'id type language path', _NODES)})"


@query(_NODES_SQL)
def ext_graph_nodes(spark, d):
    return _graph(spark, d)[0]


_EDGES = [
    (0, f"N.M{MARK}.{_C}", f"N.M{MARK}.{_C}.Get", "contains", None), (0, f"N.M{MARK}.{_S}", f"N.M{MARK}.{_S}.Configure", "contains", None), (0, f"N.M{MARK}.{_C}", f"N.M{MARK}.{_I}", "implements", None),
    (0, _I, _C, "di_registration", "Scoped"), (0, f"Clock{MARK}", f"Clock{MARK}", "di_registration", "Singleton"),
    (1, _UC, f"{_UC}.load", "contains", None), (1, _UC, "UserService", "imports", None), (1, _UC, "Other", "imports", None),
    (2, _U, f"{_U}.name", "contains", None), (2, _U, f"{_U}.load", "contains", None), (2, _U, f"Base{MARK}", "inherits", None), (2, _U, f"abc.ABC{MARK}", "inherits", None),
    (2, _U, f"os{MARK}", "imports", None), (2, _U, f"typing{MARK}.List", "imports", None), (2, f"create_user{MARK}", f"os{MARK}", "imports", None), (2, f"create_user{MARK}", f"typing{MARK}.List", "imports", None),
]
_EDGES_SQL = _given(_N, "src dst type lifetime", _EDGES)


@query(_EDGES_SQL)
def ext_graph_edges(spark, d):
    return _graph(spark, d)[1]


@query(f"SELECT src, dst FROM ({_EDGES_SQL}) WHERE type = 'implements'")
def ext_implements(spark, d):
    return _graph(spark, d)[1].where("type = 'implements'").select("src", "dst")


@query(_given(_N, "src dst", [(0, f"N.M{MARK}.{_C}", f"{ns}.{base}{MARK}") for ns in (f"N.M{MARK}", f"System{MARK}", f"A.B{MARK}") for base in ("Base", "IUserStore")]))
def ext_namespace_dependencies(spark, d):
    return code_graph.namespace_dependencies(extract.entities(marked_files(spark, d)))


@query(_given(_N, "path name line", [(0, _CS, _C, f"- **{_C}** inherits from Base{MARK}, {_I}"), (0, _CS, _S, f"- **{_S}** (base class)"), (1, _TS, _UC, f"- **{_UC}** inherits from OnInit{MARK}, OnDestroy{MARK}"), (2, _PY, _U, f"- **{_U}** inherits from Base{MARK}, abc.ABC{MARK}"), (4, "shop.rb", f"Shop{MARK}", f"- **Shop{MARK}** (base class)")]))
def ext_class_hierarchy(spark, d):
    return code_graph.class_hierarchy(extract.entities(marked_files(spark, d))).select("path", "name", "line")


@query(f"""WITH n AS ({_NODES_SQL}), e AS ({_EDGES_SQL}), l AS (SELECT *, lower(id) AS low FROM n)
    SELECT * FROM (SELECT 'Service Pattern' AS name, CASE WHEN count(*) > 2 THEN 'high' ELSE 'medium' END AS confidence, count(*) AS components FROM l WHERE contains(low, 'service')
    UNION ALL SELECT 'Dependency Injection', 'high', count(*) FROM e WHERE type = 'di_registration') WHERE components > 0""")
def ext_graph_patterns(spark, d):
    return graph.graph_patterns(*_stored_graph(spark, d))


@query(f"""WITH e AS ({_EDGES_SQL}), n AS ({_NODES_SQL}) SELECT e.dst AS id, regexp_extract(e.dst, '([^.]*)$', 1) AS name, coalesce(n.type, 'unknown') AS type, e.type AS relationship, 'out' AS direction, 1 AS depth, e.src AS via
    FROM e LEFT JOIN n ON n.id = e.dst WHERE e.src = (SELECT 'User' || min(doc_id) FROM documents WHERE doc_id % {_N} = 2)""")
def ext_dependencies(spark, d):
    """The direct dependencies of the first Python class."""
    nodes, edges = _stored_graph(spark, d)
    first = table(spark, d, "documents").where(F.col("doc_id") % _N == 2).agg(F.min("doc_id")).first()[0]
    return graph.dependencies(nodes, edges, f"User{first}", direction="out").drop("error")


@query("SELECT NULL::VARCHAR AS id, 'Component Nobody not found in the call graph' AS error")
def ext_dependencies_unknown(spark, d):
    return graph.dependencies(*_stored_graph(spark, d), "Nobody", transitive=True).select("id", "error")


@query(f"SELECT src AS id, dst, e.type FROM ({_EDGES_SQL}) e JOIN ({_NODES_SQL}) n ON n.id = src WHERE n.type = 'class'")
def ext_dependencies_of_kind(spark, d):
    return graph.dependencies_of_kind(*_stored_graph(spark, d), "class")


# --- roll-ups of parsed files
@query(f"""SELECT 'd' || doc_id || '/' || path AS path, c::BIGINT AS n_class, i::BIGINT AS n_interface, m::BIGINT AS n_method
    FROM documents JOIN (VALUES (0, '{_CS}', 2, 1, 3), (1, '{_TS}', 1, 0, 1), (2, '{_PY}', 1, 0, 2), (3, 'broken.py', 0, 0, 0), (4, 'shop.rb', 1, 0, 0), (5, 'empty.cs', 0, 0, 0)) v(t, path, c, i, m) ON doc_id % {_N} = t""")
def agg_file_counts(spark, d):
    return rollup.kinds_by_file(extract.entities(marked_files(spark, d)), ["class", "interface", "method"])


@query(f"""SELECT namespace, count(*) AS n_files, sum(c)::BIGINT AS classes, sum(i)::BIGINT AS interfaces
    FROM (SELECT CASE WHEN doc_id % {_N} = 0 THEN 'N.M' || doc_id ELSE 'Unknown' END AS namespace, [2, 1, 1, 0, 1, 0][doc_id % {_N} + 1] AS c, [1, 0, 0, 0, 0, 0][doc_id % {_N} + 1] AS i FROM documents WHERE doc_id % {_N} < 6) GROUP BY namespace""")
def agg_namespace_rollup(spark, d):
    entities = extract.entities(marked_files(spark, d))
    per_file = entities.groupBy("path").agg(F.max(F.when(F.col("kind") == "namespace", F.col("name"))).alias("namespace"), F.count_if(F.col("kind") == "class").alias("c"), F.count_if(F.col("kind") == "interface").alias("i"))
    return rollup.namespace_rollup(per_file, "namespace", {"classes": "c", "interfaces": "i"})


@query(f"SELECT doc_id, 'class' AS type, 'Class: User' || doc_id || 'Controller in namespace N.M' || doc_id || chr(10) || 'Access: public' || chr(10) || 'Modifier: none' || chr(10) || 'Inheritance: Base' || doc_id || ', IUserStore' || doc_id || chr(10) AS text FROM documents WHERE doc_id % {_N} = 0")
def str_class_text(spark, d):
    rows = extract.entities(marked_files(spark, d)).where("kind = 'class' AND language = 'csharp' AND size(bases) > 0")
    text = tx.class_text(F.col("name"), F.col("parent"), F.col("access"), F.col("modifier"), F.col("bases"))
    return rows.select(F.regexp_extract("path", "^d([0-9]+)/", 1).cast("long").alias("doc_id"), F.lit("class").alias("type"), text.alias("text"))


@query("""SELECT doc_id, chr(10) || 'File: f' || doc_id || '.cs' || chr(10) || 'Language: csharp' || chr(10) || 'Namespace: ' || coalesce(source, 'None') || chr(10) || chr(10) || 'Classes:' || chr(10) ||
    CASE WHEN doc_id % 3 = 0 THEN 'No classes found.' ELSE '- C' || doc_id || ': 2 methods, ' || doc_id % 3 || ' properties' || chr(10) END || chr(10) || chr(10) || 'Interfaces:' || chr(10) ||
    CASE WHEN doc_id % 2 = 0 THEN 'No interfaces found.' ELSE '- IA' || chr(10) || '- IB' || chr(10) END || chr(10) AS text FROM documents""")
def str_file_text(spark, d):
    one = F.array(F.struct(F.concat(F.lit("C"), F.col("doc_id")).alias("name"), F.lit(2).alias("n_methods"), (F.col("doc_id") % 3).alias("n_properties")))
    classes = F.when(F.col("doc_id") % 3 != 0, one)
    interfaces = F.when(F.col("doc_id") % 2 != 0, F.array(F.lit("IA"), F.lit("IB")))
    text = tx.file_text(F.concat(F.lit("f"), F.col("doc_id"), F.lit(".cs")), F.lit("csharp"), F.col("source"), classes, interfaces)
    return table(spark, d, "documents").select("doc_id", text.alias("text"))


# --- rules: a text, and the rules that it meets
_DI, _OBS = ("D", "Dependency Injection", "high"), ("D", "Observer Pattern", "medium")
RULE_TEXTS = [
    ("csharp", "class ThingFactory { }", [("D", "Factory Pattern", "high")]), ("csharp", "class AFactoryBase { }", []),
    ("csharp", "interface IUserRepository { }", [("D", "Repository Pattern", "high")]), ("cs", "class userrepository { }", [("D", "Repository Pattern", "high")]),
    ("csharp", "class MyUnitOfWork { }", [("D", "Unit of Work Pattern", "high")]),
    ("csharp", "services.AddScoped<IA, A>();", [_DI, ("A", "Inversion of Control", "high")]),
    ("csharp", "constructor (IClock clock, int n)", [_DI, ("A", "Inversion of Control", "high")]), ("csharp", "constructor (MyInt count)", []), ("csharp", "constructor (IClock clock = null)", []),
    ("csharp", "class SaveCommand { }", [("A", "CQRS", "medium")]), ("csharp", "interface IHandler { }", [("A", "CQRS", "medium")]),
    ("csharp", "class HomeController { }", [("A", "MVC", "high")]), ("csharp", "class HomeViewModel { }", [("A", "MVVM", "high")]), ("csharp", "class AppMediator { }", [("D", "Mediator Pattern", "high")]),
    ("csharp", "event Handler Changed;", [_OBS]), ("csharp", "x.Subscribe(y);", [_OBS]), ("csharp", "interface IPriceStrategy { }", [("D", "Strategy Pattern", "high")]),
    ("csharp", "t.ConfigureAwait(false)", [("L", "ConfigureAwait Pattern", "high")]), ("csharp", "q.ToArray()", [("L", "LINQ Materialization", "medium")]),
    ("csharp", "class Db : DbContext { }", [("L", "Entity Framework", "high")]), ("csharp", "void F<T>() where T : DbContext { }", []),
    ("csharp", "c.Add(new TypeRegistration(typeof(IA), typeof(A), x))", [("D", "Service Locator Pattern", "high")]), ("csharp", "c.Add(new TypeRegistration(typeof(List<A>), typeof(A), x))", []),
    ("typescript", "from '@angular/core' @Component( { a: 1 })", [("L", "Angular Component", "high")]), ("typescript", "from '@angular/core' @Injectable({", [("L", "Angular Service", "high"), ("D", "Dependency Injection", "high")]),
    ("typescript", "from '@angular/core' @Injectable()", []), ("typescript", "from '@angular/core' @NgModule(\n{", [("L", "Angular Module", "high")]),
    ("typescript", "from '@angular/router' RouterModule.forChild(r)", [("L", "Angular Routing", "high")]), ("typescript", "from '@angular/router' const r: Routes = []", []),
    ("typescript", "from '@angular/forms' FormGroup", [("L", "Angular Reactive Forms", "high")]), ("typescript", "from '@angular/forms' ngForm", [("L", "Angular Template-driven Forms", "high")]), ("typescript", "from '@angular/forms' NgForm", []),
    ("typescript", "from '@angular/common/http' HttpClient", [("L", "Angular HTTP Client", "high")]), ("typescript", "FormGroup HttpClient ngModel", []),
    ("javascript", "import React; class App extends React.Component { }", [("L", "React Component", "high")]), ("javascript", "import React; function App () { return (1) }", [("L", "React Component", "high")]),
    ("javascript", "import React; useState(0)", [("L", "React Hooks", "high")]), ("javascript", "import React; useState", []), ("javascript", "useEffect(f)", []),
    ("js", "import React; createStore(r)", [("L", "Redux", "high"), ("A", "Flux/Redux", "high")]),
    ("ts", "function userFactory() { }", [("D", "Factory Pattern", "high")]), ("ts", "private constructor() { }", [("D", "Singleton Pattern", "high")]), ("ts", "s.subscribe(f)", [("D", "Observer Pattern", "high")]),
    ("ts", "export const a = 1", [("D", "Module Pattern", "medium")]), ("ts", "new Promise(f)", [("L", "Promise/Async-Await", "high")]),
    ("python", "class ThingFactory: pass", [("D", "Factory Pattern", "high")]), ("python", "def create_user(x): pass", [("D", "Factory Pattern", "high")]),
    ("python", "    __instance = None", [("D", "Singleton Pattern", "high")]), ("python", "def outer(f):\n    def wrapper(): pass", [("D", "Decorator Pattern", "high")]), ("python", "@cached", [("D", "Decorator Pattern", "high")]),
    ("python", "class PriceStrategy: pass", [("D", "Strategy Pattern", "high")]), ("python", "class StrategyBase: pass", []), ("python", "class Strategy: pass", []),
    ("python", "def notify(x): pass", [("D", "Observer Pattern", "medium")]), ("python", "from flask import Flask", [("L", "Flask Framework", "high"), ("A", "MVC", "medium")]),
    ("python", "from django import forms", [("L", "Django Framework", "high"), ("A", "MVT", "high")]), ("py", "app = FastAPI()", [("L", "FastAPI Framework", "high")]),
    ("py", "from sqlalchemy import Column", [("L", "SQLAlchemy ORM", "high")]), ("py", "class A(models.Model): pass", [("L", "Django ORM", "high")]), ("py", "async def f(): pass", [("L", "Asyncio", "high")]),
    ("py", "from typing import Any", [("L", "Type Annotations", "high")]), ("py", "from dataclasses import field", [("L", "Dataclasses", "high")]),
    ("ruby", "class ThingFactory; end", []), ("python", None, []),
]


@query(_given(len(RULE_TEXTS), "path kind name confidence", [(i, f"p{i}", *x) for i, (_, _, found) in enumerate(RULE_TEXTS) for x in found]))
def ext_file_patterns(spark, d):
    rows = _pick(spark, d, [(f"d{MARK}/p{i}", g, t) for i, (g, t, _) in enumerate(RULE_TEXTS)], "path string, language string, content string")
    return patterns.file_patterns(rows).drop("rule_no")


@query(f"SELECT kind, count(*) AS n FROM ({_given(len(RULE_TEXTS), 'kind name', [(i, x[0], x[1]) for i, (_, _, found) in enumerate(RULE_TEXTS) for x in found])}) GROUP BY kind")
def agg_patterns_found(spark, d):
    rows = _pick(spark, d, [(f"d{MARK}/p{i}", g, t) for i, (g, t, _) in enumerate(RULE_TEXTS)], "path string, language string, content string")
    return rollup.histogram(patterns.file_patterns(rows), "kind")


# --- trees: files, and the organization that they show
_F = lambda *paths: [(p, "") for p in paths]
TREES = [
    (_F("controllers/a.py", "models/b.py", "views/c.py", "manage.py", "requirements.txt"), ["Layer-based Organization", "Django Project Layout"]),
    (_F("src/controllers/a.py", "main.py"), []), (_F("manage.py"), []),
    (_F("feature-a/x.ts", "my-domain/y.ts"), ["Feature-based Organization"]),
    (_F("widgets/a.ts", "element/b.ts", "Components/c.ts"), ["Component-based Organization"]),
    (_F("order-service/Dockerfile", "user-service/setup.py"), ["Microservices Architecture"]), (_F("order-service/Dockerfile", "user-service/pom.xml"), []),
    (_F("packages/a/x.js"), ["Monorepo"]), (_F("apps/a.js", "libs/b.js"), ["Monorepo"]), (_F("apps/a.js"), []),
    (_F("angular.json", "src/app/app.module.ts"), ["Angular CLI Project", "Angular Standard Layout"]),
    (_F("public/index.html", "src/App.tsx"), ["Create React App Layout"]), (_F("src/App.tsx"), []), (_F("app.py", "templates/a.html"), ["Flask Project Layout"]), (_F(".github/api/a", ".github/dao/b", ".github/view/c"), []),
]


@query(_given(len(TREES), "repo_id name kind confidence", [(i, MARK, x, "A" if x.startswith("Micro") else "O", "high") for i, (_, found) in enumerate(TREES) for x in found]).replace("replace(v.repo_id::VARCHAR, 'Z9Z', doc_id::VARCHAR)", "doc_id"))
def ext_folder_patterns(spark, d):
    return patterns.folder_patterns(marked_trees(spark, d, [t for t, _ in TREES]), keep=["repo_id"])


_FACTS = [
    ("base_image", "python:3.13", "", "Dockerfile"), ("base_image", "scratch", "", "user-service/Dockerfile"), ("ci", "github-actions", "", ".github/workflows/ci.yml"), ("ci", "gitlab", "", ".gitlab-ci.yml"),
    ("container", "docker", "", "Dockerfile"), ("container", "docker", "", "user-service/Dockerfile"), ("container", "kubernetes-manifest", "", "k8s/deploy.yaml"),
    ("dependency", "Microsoft.AspNetCore.App", "2.2", "a.csproj"), ("dependency", "X", "2", "a.csproj"), ("dependency", "a", "1", "requirements.txt"), ("dependency", "b", "2", "requirements.txt"),
    ("dependency", "flask", "2.0", "requirements.txt"), ("dependency", "numpy", "latest", "requirements.txt"), ("dependency", "jest", "29", "package.json"), ("dependency", "left-pad", "1", "package.json"), ("dependency", "react", "^18", "package.json"),
    ("env_variable", "KEY", "", ".env"), ("env_variable", "OTHER", "", ".env"), ("framework", "ASP.NET Core", "", "a.csproj"), ("framework", "Flask", "", "requirements.txt"), ("framework", "React", "", "package.json"),
    ("npm_script", "test", "jest", "package.json"), ("runtime", "node", ">=18", "package.json"), ("package_manager", "npm", "", "package.json"), ("package_manager", "npm", "", "order-service/package.json"),
    ("package_manager", "nuget", "", "a.csproj"), ("package_manager", "pip", "", "requirements.txt"), ("package_manager", "poetry", "", "pyproject.toml"),
]


@query(f"SELECT doc_id AS repo_id, v.* FROM documents CROSS JOIN (VALUES {', '.join('(' + ', '.join(_literal(x) for x in r) + ')' for r in _FACTS)}) v(category, key, value, path)")
def env_facts(spark, d):
    return environment.facts(marked_trees(spark, d, [TREE]), keep=["repo_id"])


@query("""SELECT doc_id AS repo_id, name, version FROM documents CROSS JOIN (VALUES ('a', '1'), ('b', '2'), ('flask', '2.0'), ('numpy', 'latest')) t(name, version)""")
def env_requirements(spark, d):
    return environment.packages(marked_trees(spark, d, [TREE]), keep=["repo_id"]).where("ecosystem = 'pip'").select("repo_id", "name", "version")


# --- texts
_PREVIEW = """CASE WHEN length(text) <= 300 THEN text ELSE (SELECT CASE WHEN n = 0 THEN left(text, 300) || '...' ELSE array_to_string(l[1:n], chr(10)) || chr(10) || '...' END
    FROM (SELECT l, len(list_filter(generate_series(1, len(l)), lambda i: length(array_to_string(l[1:i], chr(10))) <= 300)) AS n FROM (SELECT string_split(left(text, 301), chr(10)) AS l))) END"""
_SIZE = """CASE WHEN n_chars < 1024 THEN printf('%.2f B', n_chars::DOUBLE) ELSE printf('%.2f KB', n_chars / 1024.0) END"""


@query(f"SELECT doc_id, {_SIZE} AS size, {_PREVIEW} AS preview FROM documents")
def str_sizes_previews(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.byte_size(F.col("n_chars")).alias("size"), tx.line_preview(F.col("text")).alias("preview"))


@query(f"SELECT doc_id, {_PREVIEW} AS preview FROM documents")
def str_previews(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.line_preview(F.col("text")).alias("preview"))


@query("SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT p_partkey, 'part' FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)")
def jn_add_missing_all(spark, d):
    have = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind"))
    want = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("part").alias("kind"))
    return relational.add_missing(have, want)


@query("SELECT 'checkpoint_' || max(o_orderkey) || '_x' AS name FROM orders")
def top_latest_checkpoint(spark, d):
    return relational.latest_checkpoint(table(spark, d, "orders").select(F.concat(F.lit("checkpoint_"), F.col("o_orderkey"), F.lit("_x")).alias("name")))
