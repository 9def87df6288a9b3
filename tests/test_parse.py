from lodestone import extract_queries as q
from lodestone.functions.maths import evaluate
from lodestone.functions.vectors import mock_vector
from lodestone.operators import comments, parse, split

import pytest


def names(rows, kind):
    return [r["name"] for r in rows if r["kind"] == kind]


def test_csharp():
    rows = parse.csharp(q.CSHARP)
    assert names(rows, "namespace") == ["N.M"] and names(rows, "using") == ["System", "A.B"]
    assert names(rows, "class") == ["UserController", "Setup"] and names(rows, "interface") == ["IUserStore"]
    c = next(r for r in rows if r["kind"] == "class")
    assert c["bases"] == ["Base", "IUserStore"] and c["access"] == "public" and c["parent"] == "N.M"
    get = [r for r in rows if r["kind"] == "method" and r["parent"] == "UserController"]
    assert [(r["name"], r["type"], r["params"]) for r in get] == [("Get", "string", [{"name": "id", "type": "int"}])]
    assert [(r["name"], r["type"]) for r in rows if r["kind"] == "constructor_parameter"] == [("clock", "IClock"), ("log", "ILog")]
    assert [(r["name"], r["flags"]) for r in rows if r["kind"] == "property"] == [("Title", []), ("clock", ["is_field"]), ("Most", ["is_constant"])]
    assert [(r["name"], r["type"], r["bases"]) for r in rows if r["kind"] == "di_registration"] == [("IUserStore", "Scoped", ["UserController"]), ("Clock", "Singleton", ["Clock"])]


def test_typescript():
    rows = parse.typescript(q.TYPESCRIPT)
    assert [(r["name"], r["bases"]) for r in rows if r["kind"] == "import"] == [("@angular/core", ["Component", "Input"]), ("./user.service", ["UserService", "Other"])]
    c = next(r for r in rows if r["kind"] == "class")
    assert (c["name"], c["type"], c["bases"], c["flags"], c["doc"]) == ("UserComponent", "Base", ["OnInit", "OnDestroy"], ["is_component"], "app-user")
    load = next(r for r in rows if r["kind"] == "method")
    assert load["name"] == "load" and load["params"] == [{"name": "id", "type": "number"}, {"name": "opts", "type": "{ deep: boolean }"}]
    assert [(r["name"], r["flags"]) for r in rows if r["kind"] == "property"] == [("name", ["is_input"]), ("done", ["is_output"]), ("items", [])]
    assert [(r["name"], r["params"][0]["type"]) for r in rows if r["kind"] == "function"] == [("add", "any")]


def test_python_and_fallback():
    rows = parse.python(q.PYTHON)
    assert names(rows, "import") == ["os", "typing.List"] and next(r for r in rows if r["kind"] == "class")["bases"] == ["Base", "abc.ABC"]
    assert [(r["name"], r["flags"]) for r in rows if r["kind"] == "method"] == [("name", ["@property"]), ("load", ["is_async"])]
    assert names(rows, "property") == ["table"] and names(rows, "function") == ["create_user"]
    assert parse.parse("python", "def x(:") == parse.generic("def x(:") and names(parse.parse("PY", "def x(:"), "function") == ["x"]
    assert names(parse.parse("ruby", q.RUBY), "class") == ["Shop"] and names(parse.parse(None, None), "class") == []


def test_angular():
    rows = parse.angular(q.TYPESCRIPT)
    c = next(r for r in rows if r["kind"] == "component")
    assert (c["name"], c["type"], c["bases"], c["params"]) == ("UserComponent", "app-user", ["./a.css", "./b.css"], [{"name": "templateUrl", "type": "./user.component.html"}])
    x = next(r for r in rows if r["kind"] == "exported_class")
    assert x["params"] == [{"name": "Input", "type": "name"}, {"name": "Output", "type": "done"}]
    m = parse.angular("@NgModule({ declarations: [A, B], imports: [C] }) export class M {}")[0]
    assert [(p["name"], p["type"]) for p in m["params"]] == [("declarations", "A"), ("declarations", "B"), ("imports", "C")]
    assert parse.angular("@Pipe({ name: 'up', pure: false }) export class P {}")[0]["flags"] == []


def test_documentation():
    rows = comments.csharp(q.CSHARP)
    get = next(r for r in rows if r["kind"] == "method")
    assert (get["name"], get["text"], get["returns"], get["params"]) == ("Get", "Finds one.", "The user.", [{"name": "id", "text": "Its id."}])
    assert [r["text"] for r in rows if r["kind"] == "todo"] == ["cache"]
    ts = comments.typescript(q.TYPESCRIPT)
    add = next(r for r in ts if r["name"] == "add")
    assert (add["text"], add["returns"], add["params"]) == ("Adds.", "the sum", [{"name": "a", "text": "the first"}]) and ts[0]["text"] == "Shows users."
    py = comments.python(q.PYTHON)
    assert [(r["kind"], r["name"]) for r in py[:3]] == [("module", None), ("class", "User"), ("method", "load")]
    assert py[2]["params"] == [{"name": "key", "text": "its key"}] and py[2]["returns"] == "nothing"
    assert [r["text"] for r in comments.generic("ruby", q.RUBY)] == ["a"]


def test_chunks():
    assert [r["type"] for r in split.split("python", q.PYTHON)] == ["class", "function"]
    long = "class A:\n" + "".join(f"    def m{i}(self):\n" + "        x = 1\n" * 12 for i in range(20))
    rows = split.split("python", long)
    assert rows[0]["type"] == "class_declaration" and len(rows[0]["content"]) == 2000 and len(rows) == 21
    assert split.split("python", "x = 1") == [{"type": "file", "name": None, "content": "x = 1"}]
    assert split.by_lines("") == [{"type": "file", "name": None, "content": ""}]


def test_chunks_cover_all_lines():
    lines = [f"{i} " + "y" * (i * 37 % 300) for i in range(200)]
    rows = split.by_lines("\n".join(lines))
    assert [x for x in lines if any(x in r["content"].split("\n") for r in rows)] == lines and all(len(r["content"]) <= 2300 for r in rows)


def test_arithmetic():
    assert evaluate("2 * (3 - -1) ** 2 / 4 % 5") == 3 and evaluate("1/2") == 0.5
    for bad in ("+1", "7 // 2", "x", "__import__('os')", "1 / 0", "9 ** 9999", "'a' * 3"):
        with pytest.raises(ValueError):
            evaluate(bad)


def test_mock_vectors():
    assert [round(x, 6) for x in mock_vector("Same text", 4)] == [-0.436583, -0.192, 0.756724, -0.447102]
    assert [round(x, 6) for x in mock_vector("Different text", 4)] == [-0.40306, 0.436064, -0.411977, 0.691133]
