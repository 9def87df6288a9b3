"""Parsers of source texts: C#, TypeScript and JavaScript, Python, and any other language.

Each takes a text and gives rows of one shape (ROW), so that every later step is a DataFrame operation. The
parsers run inside an Arrow UDF; a text that can't be parsed gives the rows of the generic parser.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right

ROW = "struct<kind:string,name:string,parent:string,access:string,modifier:string,type:string,bases:array<string>,params:array<struct<name:string,type:string>>,flags:array<string>,doc:string,first_line:int,last_line:int>"
_FIELDS = ("kind", "name", "parent", "access", "modifier", "type", "bases", "params", "flags", "doc", "first_line", "last_line")


def row(kind: str, name: str | None, **more) -> dict:
    out = dict.fromkeys(_FIELDS) | {"kind": kind, "name": name, "bases": [], "params": [], "flags": []} | more
    out["params"] = [{"name": a, "type": b} for a, b in out["params"]]
    return out


class Source:
    """Lines and braces of a text, found in one pass. Strings and comments are not known."""

    def __init__(self, text: str):
        self.text, self.breaks = text, [m.start() for m in re.finditer("\n", text)]
        self.at, self.depths, self.close, is_open, depth = [], [0], [], [], 0
        for i, m in enumerate(re.finditer(r"[{}]", text)):
            self.at.append(m.start())
            self.close.append(len(text))
            if m.group() == "{":
                is_open.append(i)
            elif is_open:
                self.close[is_open.pop()] = m.end()
            depth += 1 if m.group() == "{" else -1
            self.depths.append(depth)

    def line(self, at: int) -> int:
        return bisect_left(self.breaks, at) + 1

    def depth(self, at: int) -> int:
        """Braces open before a place."""
        return self.depths[bisect_left(self.at, at)]

    def block_end(self, at: int) -> int:
        """The place after the brace that closes the first one from at on; the text's end if none does, at itself if no block opens there."""
        i = bisect_left(self.at, at)
        if i == len(self.at):
            return len(self.text)
        return self.close[i] if self.text[self.at[i]] == "{" else at


def block_end(text: str, at: int) -> int:
    return Source(text).block_end(at)


def split_outside(text: str, sep: str = ",") -> list[str]:
    """Parts between separators that stand in no bracket, trimmed, empty ones left out."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or (c == ">" and (i == 0 or text[i - 1] != "=")):
            depth -= 1
        elif c == sep and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, text[start:]] if p.strip()]


# --- C#
_ACCESS = r"public|private|protected|internal"
_CS_NAMESPACE = re.compile(r"namespace\s+([\w.]+)")
_CS_USING = re.compile(r"using\s+([\w.]+)\s*;")
_CS_CLASS = re.compile(rf"(?:({_ACCESS})\s+)?(?:(static|abstract|sealed|partial)\s+)?class\s+(\w+)(?:<[^>]+>)?(?:\s*:\s*([^{{]+))?")
_CS_INTERFACE = re.compile(rf"(?:({_ACCESS})\s+)?interface\s+(\w+)(?:<[^>]+>)?(?:\s*:\s*([^{{]+))?")
_CS_METHOD = re.compile(rf"(?:({_ACCESS})\s+)?(?:(static|virtual|abstract|override|async)\s+)*([\w<>\[\],.?]+)\s+(\w+)\s*\(([^)]*)\)\s*(?:where[^{{]+)?[{{;=]")
_CS_PROPERTY = re.compile(rf"({_ACCESS})\s+(?:(static|virtual|override|abstract)\s+)?([\w<>\[\],.?]+)\s+(\w+)\s*\{{\s*(?:get|set|init)")
_CS_FIELD = re.compile(rf"({_ACCESS})\s+((?:(?:static|readonly|const)\s+)*)([\w<>\[\],.?]+)\s+(\w+)\s*(?:=[^;]*)?;")
_CS_DI = re.compile(r"\.Add(Scoped|Transient|Singleton)<\s*([\w.]+)\s*(?:,\s*([\w.]+)\s*)?>")
_CS_PROJECT = re.compile(r'Project\("\{[^}]+\}"\)\s*=\s*"([^"]+)",\s*"([^"]+)",\s*"\{([^}]+)\}"')
# Words that only look like names of methods or fields, fixed values.
KEYWORDS = frozenset(
    ["if", "else", "for", "foreach", "while", "switch", "using", "lock", "catch", "return", "new", "throw", "nameof", "typeof", "sizeof",
     "await", "yield", "var", "function", "constructor", "do", "try", "with", "of", "in"]
)
PLACEHOLDERS = frozenset(["i", "j", "k", "temp", "tmp", "value", "index"])


def _cs_params(text: str) -> list[tuple[str, str]]:
    out = []
    for p in split_outside(text):
        words = re.sub(r"\s*=.*$", "", re.sub(r"^\s*(?:\[[^\]]*\]\s*|(?:this|ref|out|in|params)\s+)*", "", p)).split()
        if words:
            out.append((words[-1], " ".join(words[:-1])))
    return out


def csharp(text: str) -> list[dict]:
    """namespace, using, class, interface, method, property, constructor_parameter and di_registration rows."""
    src = Source(text)
    ns = m[1] if (m := _CS_NAMESPACE.search(text)) else None
    rows = [row("namespace", ns or "Unknown")]
    rows += [row("using", m[1], first_line=src.line(m.start())) for m in _CS_USING.finditer(text)]
    spans = []
    for m in _CS_CLASS.finditer(text):
        end = src.block_end(m.end())
        spans.append((m.start(), end, m[3]))
        rows.append(row("class", m[3], parent=ns, access=m[1] or "internal", modifier=m[2], bases=split_outside(m[4] or ""), first_line=src.line(m.start()), last_line=src.line(end - 1)))
    for m in _CS_INTERFACE.finditer(text):
        rows.append(row("interface", m[2], parent=ns, access=m[1] or "internal", bases=split_outside(m[3] or ""), first_line=src.line(m.start()), last_line=src.line(src.block_end(m.end()) - 1)))

    around: list[int] = []  # for each class, the one that it stands in
    for i, (_, end, _) in enumerate(spans):
        j = i - 1
        while j >= 0 and spans[j][1] < end:
            j = around[j]
        around.append(j)
    begins = [x[0] for x in spans]

    def owner(at: int) -> str | None:
        """The innermost class around a place."""
        i = bisect_right(begins, at) - 1
        while i >= 0 and spans[i][1] <= at:
            i = around[i]
        return spans[i][2] if i >= 0 else None

    for m in _CS_METHOD.finditer(text):
        if m[4].lower() in KEYWORDS or m[3].lower() in KEYWORDS - {"var"}:
            continue
        of = owner(m.start())
        built = m[4] == of
        end = src.block_end(m.end() - 1) if text[m.end() - 1] == "{" else m.end()
        kind, access = ("constructor", m[1] or (m[3] if re.fullmatch(_ACCESS, m[3]) else "private")) if built else ("method", m[1] or "private")
        rows.append(row(kind, m[4], parent=of, access=access, modifier=m[2], type=None if built else m[3], params=_cs_params(m[5]), first_line=src.line(m.start()), last_line=src.line(end - 1)))
    for x in [r for r in rows if r["kind"] == "constructor" and r["access"] == "public"][:1]:
        rows += [row("constructor_parameter", p["name"], parent=x["parent"], type=p["type"]) for p in x["params"]]
    seen = set()
    for pattern, flag in ((_CS_PROPERTY, None), (_CS_FIELD, "field")):
        for m in pattern.finditer(text):
            of = owner(m.start())
            if (of, m[4]) in seen or m[4].lower() in KEYWORDS or (flag and m[4].lower() in PLACEHOLDERS) or m[3].lower() in KEYWORDS - {"var"}:
                continue
            seen.add((of, m[4]))
            words = (m[2] or "").split()
            flags = [] if flag is None else ["is_constant"] if "const" in words else ["is_readonly"] if {"static", "readonly"} <= set(words) else ["is_field"]
            rows.append(row("property", m[4], parent=of, access=m[1], modifier=" ".join(words) or None, type=m[3], flags=flags, first_line=src.line(m.start())))
    rows += [row("di_registration", m[2], type=m[1], bases=[m[3] or m[2]], first_line=src.line(m.start())) for m in _CS_DI.finditer(text)]
    return rows


def solution(text: str) -> list[dict]:
    return [row("project", m[1], type=m[2].replace("\\", "/"), doc=m[3]) for m in _CS_PROJECT.finditer(text)]


# --- TypeScript and JavaScript
_TS_IMPORT = re.compile(r"import\s*\{([^}]+)\}\s*from\s*['\"]([^'\"]+)['\"]")
_TS_CLASS = re.compile(r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)(?:<[^>]+>)?(?:\s+extends\s+([\w.]+)(?:<[^>]+>)?)?(?:\s+implements\s+([^{]+))?\s*\{")
_TS_METHOD = re.compile(r"^[ \t]+(?:(public|private|protected)\s+)?(?:(static|async|abstract|override|get|set)\s+)*(\w+)\s*(?:<[^>]+>)?\(((?:[^()]|\([^()]*\))*)\)\s*(?::\s*([^{;=]+?))?\s*\{", re.M)
_TS_FUNCTION = re.compile(r"(?:export\s+)?(?:default\s+)?(async\s+)?function\s*\*?\s*(\w+)\s*(?:<[^>]+>)?\(((?:[^()]|\([^()]*\))*)\)\s*(?::\s*([^{;]+?))?\s*\{")
_TS_ARROW = re.compile(r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(async\s+)?\(((?:[^()]|\([^()]*\))*)\)\s*(?::\s*([^=]+?))?\s*=>")
_TS_PROPERTY = re.compile(r"^[ \t]+((?:@\w+\([^)]*\)\s*)*)(?:(public|private|protected)\s+)?(?:(?:static|readonly|declare)\s+)*(\w+)[?!]?\s*(?::\s*([^=;\n{(]+))?\s*(?:=[^=>][^;\n]*)?;", re.M)
_TS_DECORATORS = {"is_component": "@Component", "is_service": "@Injectable", "is_pipe": "@Pipe", "is_directive": "@Directive", "is_module": "@NgModule"}
ANGULAR_SUFFIXES = (".component.ts", ".service.ts", ".module.ts", ".directive.ts", ".pipe.ts")
ANGULAR_MARKS = ("@angular/core", "@Component", "@Injectable", "@NgModule", "@Directive", "@Pipe", "@Input", "@Output")


def is_angular(path: str, text: str) -> bool:
    return any(s in path for s in ANGULAR_SUFFIXES) or any(m in text for m in ANGULAR_MARKS)


def _ts_params(text: str) -> list[tuple[str, str]]:
    out = []
    for p in split_outside(text):
        name, _, kind = re.sub(r"\s*=(?!>).*$", "", p, flags=re.S).partition(":")
        out.append((re.sub(r"^(?:(?:public|private|protected|readonly)\s+)+", "", name.strip()).rstrip("?"), kind.strip() or "any"))
    return out


def typescript(text: str) -> list[dict]:
    """import, class, method, property and function rows; methods and properties come from the class's own body."""
    src, rows = Source(text), []
    for m in _TS_IMPORT.finditer(text):
        rows.append(row("import", m[2], bases=[x.split(" as ")[0].strip() for x in split_outside(m[1])], first_line=src.line(m.start())))
    bodies, reached = [], 0
    for m in _TS_CLASS.finditer(text):
        end = src.block_end(m.end() - 1)
        before = text[reached : m.start()]  # decorators come after the head of the class before
        bodies.append((m.start(), end))
        reached = m.end()
        near = before[max(before.rfind("}\n"), before.rfind(";\n"), 0) :] if not re.search(r"@\w+\([^@]*\)\s*$", before) else before[before.rfind("@") :]
        flags = [f for f, mark in _TS_DECORATORS.items() if mark in near]
        selector = s[1] if (s := re.search(r"selector\s*:\s*['\"]([^'\"]+)['\"]", near)) else None
        rows.append(row("class", m[1], type=m[2], bases=split_outside(m[3] or ""), flags=flags, doc=selector, first_line=src.line(m.start()), last_line=src.line(end - 1)))
        body, off = text[m.end() : end - 1], m.end()
        inner = src.depth(off)
        for x in _TS_METHOD.finditer(body):
            if x[3] in KEYWORDS - {"of", "in", "constructor"} or src.depth(off + x.start(3)) != inner:
                continue
            rows.append(row("constructor" if x[3] == "constructor" else "method", x[3], parent=m[1], access=x[1] or "public", modifier=x[2], type=(x[5] or "any").strip(), params=_ts_params(x[4]), first_line=src.line(m.end() + x.start(3)), last_line=src.line(min(end - 1, src.block_end(off + x.end() - 1)) - 1)))
        for x in _TS_PROPERTY.finditer(body):
            if x[3] in KEYWORDS or src.depth(off + x.start(3)) != inner:
                continue
            flags = [f for f, mark in (("is_input", "@Input"), ("is_output", "@Output")) if mark in x[1]]
            rows.append(row("property", x[3], parent=m[1], access=x[2] or "public", type=(x[4] or "any").strip(), flags=flags, first_line=src.line(m.end() + x.start(3))))
    ends = []  # the furthest end of the classes up to each one
    for _, end in bodies:
        ends.append(max([end, *ends[-1:]]))

    firsts = [b for b, _ in bodies]

    def inside(at: int) -> bool:
        i = bisect_right(firsts, at) - 1
        return i >= 0 and at < ends[i]

    for pattern, (a, name, params, result) in ((_TS_FUNCTION, (1, 2, 3, 4)), (_TS_ARROW, (2, 1, 3, 4))):
        for m in pattern.finditer(text):
            if not inside(m.start()) and m[name] not in KEYWORDS:
                brace = m.end() - 1 if text[m.end() - 1] == "{" else m.end() + re.match(r"\s*", text[m.end() : m.end() + 200]).end()
                end = src.block_end(brace) if text[brace : brace + 1] == "{" else m.end()
                rows.append(row("function", m[name], modifier="async" if m[a] else None, type=(m[result] or "any").strip(), params=_ts_params(m[params]), first_line=src.line(m.start()), last_line=src.line(end - 1)))
    return rows


# --- Python
def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}"
    if isinstance(node, (ast.Subscript, ast.Call)):
        return _dotted(node.value if isinstance(node, ast.Subscript) else node.func)
    return node.id if isinstance(node, ast.Name) else ""


def _py_function(node, kind: str, parent: str | None) -> dict:
    args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
    params = [(a.arg, ast.unparse(a.annotation) if a.annotation else "") for a in args if not (kind == "method" and a.arg in ("self", "cls"))]
    flags = (["is_async"] if isinstance(node, ast.AsyncFunctionDef) else []) + [f"@{d}" for x in node.decorator_list if (d := _dotted(x))]
    return row(kind, node.name, parent=parent, type=ast.unparse(node.returns) if node.returns else None, params=params, flags=flags, doc=ast.get_docstring(node), first_line=node.lineno, last_line=node.end_lineno)


def python(text: str) -> list[dict]:
    """import, class, method, property and function rows; SyntaxError if the text is no Python."""
    tree, rows = ast.parse(text), []
    if doc := ast.get_docstring(tree):
        rows.append(row("module_doc", None, doc=doc))
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            rows += [row("import", a.name, type=a.asname, first_line=node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            rows += [row("import", f"{'.' * node.level}{node.module or ''}.{a.name}".lstrip("."), type=a.asname, first_line=node.lineno) for a in node.names]
        elif isinstance(node, ast.ClassDef):
            rows.append(row("class", node.name, bases=[b for x in node.bases if (b := _dotted(x))], doc=ast.get_docstring(node), first_line=node.lineno, last_line=node.end_lineno))
            for x in node.body:
                if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    rows.append(_py_function(x, "method", node.name))
                elif isinstance(x, ast.Assign):
                    rows += [row("property", t.id, parent=node.name, first_line=x.lineno) for t in x.targets if isinstance(t, ast.Name)]
    rows += [_py_function(x, "function", None) for x in tree.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
    return rows


# --- any other language
_GENERIC_FUNCTION = re.compile(r"\b(?:function|def|func|fn|sub|proc|procedure)\s+(\w+)\s*\(")
_GENERIC_TYPE = re.compile(r"\b(class|interface|struct|enum|trait)\s+(\w+)")
_GENERIC_IMPORTS = [re.compile(p, re.M) for p in (r"^\s*import\s+([\w.]+)", r"^\s*from\s+([\w.]+)\s+import", r"^\s*#include\s*[<\"]([^>\"]+)[>\"]", r"^\s*using\s+([\w.]+)", r"\brequire\s*\(?\s*['\"]([^'\"]+)['\"]", r"^\s*use\s+([\w:]+)")]


def generic(text: str) -> list[dict]:
    src = Source(text)
    rows = [row("function", m[1], first_line=src.line(m.start())) for m in _GENERIC_FUNCTION.finditer(text)]
    rows += [row(m[1] if m[1] == "interface" else "class", m[2], type=m[1], first_line=src.line(m.start())) for m in _GENERIC_TYPE.finditer(text)]
    return rows + [row("import", x) for x in sorted({m[1] for p in _GENERIC_IMPORTS for m in p.finditer(text)})]


# --- Angular metadata
def _meta(text: str, mark: str) -> str | None:
    return m[1] if (m := re.search(rf"@{mark}\(\s*\{{([^}}]+)\}}", text)) else None


def _value(body: str, key: str) -> str | None:
    return m[2] if (m := re.search(rf"\b{key}\s*:\s*(['\"`])(.*?)\1", body, re.S)) else None


def _names(body: str, key: str, pattern: str = r"[A-Za-z0-9_]+") -> list[str]:
    return re.findall(pattern, m[1]) if (m := re.search(rf"\b{key}\s*:\s*\[([^\]]*)\]", body)) else []


def angular(text: str) -> list[dict]:
    """component, module, service, directive, pipe, import and exported_class rows; details as name-value params."""
    rows = [row("import", m[2], bases=split_outside(m[1])) for m in _TS_IMPORT.finditer(text)]
    known = re.search(r"export\s+(?:default\s+)?(?:abstract\s+)?class\s+(\w+)(?:\s+extends\s+([\w.]+))?(?:\s+implements\s+([^{]+))?", text)
    name = known[1] if known else None
    if (body := _meta(text, "Component")) is not None:
        inline = _value(body, "template") if "templateUrl" not in body else None
        styles = _names(body, "styleUrls", r"['\"]([^'\"]+)['\"]") or _names(body, "styles", r"['\"`]([^'\"`]+)['\"`]")
        rows.append(row("component", name, type=_value(body, "selector"), doc=inline, bases=styles, params=[("templateUrl", x)] if (x := _value(body, "templateUrl")) else []))
    if (body := _meta(text, "NgModule")) is not None:
        rows.append(row("module", name, params=[(k, x) for k in ("declarations", "imports", "exports", "bootstrap", "providers") for x in _names(body, k)]))
    if "@Injectable(" in text:
        rows.append(row("service", name, type=_value(_meta(text, "Injectable") or "", "providedIn")))
    if (body := _meta(text, "Directive")) is not None:
        rows.append(row("directive", name, type=_value(body, "selector")))
    if (body := _meta(text, "Pipe")) is not None:
        rows.append(row("pipe", _value(body, "name"), parent=name, flags=[] if re.search(r"pure\s*:\s*false", body) else ["pure"]))
    if known:
        ends = [(m[1], m[2]) for m in re.finditer(r"@(Input|Output)\([^)]*\)\s*(?:(?:public|private|protected|readonly)\s+)*(\w+)", text)]
        rows.append(row("exported_class", name, type=known[2], bases=split_outside(known[3] or ""), params=ends))
    return rows


#: Aliases of a language to its parser; any other language has the generic one.
PARSERS = {"csharp": csharp, "cs": csharp, "c#": csharp, "typescript": typescript, "ts": typescript, "javascript": typescript, "js": typescript, "python": python, "py": python}


def parse(language: str | None, text: str | None) -> list[dict]:
    try:
        return PARSERS.get((language or "").lower(), generic)(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return generic(text or "")
