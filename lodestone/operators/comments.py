"""Documentation of source texts: file headers, documented members, comments and open tasks."""

from __future__ import annotations

import ast
import re

ROW = "struct<kind:string,name:string,text:string,returns:string,params:array<struct<name:string,text:string>>>"


def row(kind: str, name: str | None, text: str, returns: str | None = None, params=()) -> dict:
    return {"kind": kind, "name": name, "text": text, "returns": returns, "params": [{"name": a, "text": b} for a, b in params]}


def _plain_xml(block: str) -> str:
    return " ".join(re.sub(r"<[^>]+>", " ", re.sub(r"(?m)^\s*///\s?", "", block)).split())


def _plain_jsdoc(block: str) -> str:
    lines = [re.sub(r"^\s*\*?\s?", "", x).rstrip() for x in re.sub(r"\*/\s*$", "", re.sub(r"^\s*/\*\*?", "", block)).split("\n")]
    return "\n".join(lines).strip("\n").strip()


_CS_MEMBER = re.compile(r"((?:^[ \t]*///[^\n]*\n)+)\s*(?:\[[^\]]*\]\s*)*([^\n{;]+)", re.M)


def csharp(text: str) -> list[dict]:
    rows = []
    head = text[: m.start()] if (m := re.search(r"\b(?:namespace|class)\s+\w", text)) else text
    if m := re.search(r"/\*\*.*?\*/", head, re.S):
        rows.append(row("file", None, _plain_jsdoc(m[0])))
    elif lines := re.findall(r"///[ \t]*([^\r\n]*)", head):
        rows.append(row("file", None, "\n".join(lines)))
    for m in _CS_MEMBER.finditer(text):
        block, line = m[1], m[2].strip()
        part = re.search(r"<summary>(.*?)</summary>", block, re.S)
        summary = _plain_xml(part[1] if part else block)
        if k := re.search(r"\b(namespace|class|interface)\s+([\w.]+)", line):
            rows.append(row(k[1], k[2], summary))
        elif k := re.search(r"(\w+)\s*\(", line):
            given = [(a, _plain_xml(b)) for a, b in re.findall(r'<param\s+name="([^"]+)">(.*?)</param>', block, re.S)]
            back = re.search(r"<returns>(.*?)</returns>", block, re.S)
            rows.append(row("method", k[1], summary, _plain_xml(back[1]) if back else None, given))
        elif k := re.search(r"(\w+)\s*$", line):
            rows.append(row("property", k[1], summary))
    rows += [row("comment", None, x.strip("/ \r")) for x in re.findall(r"///[^\n]*", text)]
    return rows + _todos(_OPEN.findall(text))


#: The text of an open task in a line comment.
_OPEN = re.compile(r"//[ \t]*TODO:?[ \t]*([^\r\n]*)")


def _todos(found: list[str]) -> list[dict]:
    return [row("todo", None, x.strip()) for x in found]


def typescript(text: str) -> list[dict]:
    rows = []
    if m := re.match(r"\s*(/\*\*.*?\*/)", text, re.S):
        rows.append(row("file", None, _plain_jsdoc(m[1])))
    for m in re.finditer(r"(/\*\*(?:(?!\*/).)*\*/)\s*(?:@\w+\([^)]*\)\s*)*(?:export\s+)?(?:default\s+)?(?:abstract\s+|async\s+)?(?:(class|function|const|let)\s+(\w+)|(?:(?:public|private|protected|static|async|get|set)\s+)*(\w+)\s*\()", text, re.S):
        plain = _plain_jsdoc(m[1])
        summary = next((x.strip() for x in plain.split("\n") if x.strip() and not x.strip().startswith("@")), "")
        given = [(b, c.strip()) for b, c in re.findall(r"@param\s+(?:\{[^}]*\}\s*)?(\w+)\s*-?\s*([^\n]*)", plain)]
        back = re.search(r"@returns?\s+(?:\{[^}]*\}\s*)?([^\n]*)", plain)
        rows.append(row("class" if m[2] == "class" else "function" if m[2] else "method", m[3] or m[4], summary, back[1].strip() if back else None, given))
    for m in re.finditer(r"@Component\(\s*\{([^}]+)\}", text):
        values = re.findall(r"(selector|templateUrl)\s*:\s*['\"]([^'\"]+)['\"]", m[1]) + [("styleUrls", x) for part in re.findall(r"styleUrls\s*:\s*\[([^\]]*)\]", m[1]) for x in re.findall(r"['\"]([^'\"]+)['\"]", part)]
        rows.append(row("component", dict(values).get("selector"), "", None, values))
    rows += [row("comment", None, _plain_jsdoc(x)) for x in re.findall(r"/\*\*.*?\*/", text, re.S)]
    return rows + _todos(_OPEN.findall(text))


def python(text: str) -> list[dict]:
    tree, rows = ast.parse(text), []
    if doc := ast.get_docstring(tree):
        rows.append(row("module", None, doc))
    for node, parent in [(n, p) for p in [tree, *[x for x in ast.walk(tree) if isinstance(x, ast.ClassDef)]] for n in p.body]:
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and (doc := ast.get_docstring(node)):
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if isinstance(parent, ast.ClassDef) else "function"
            part = re.search(r"Args:\s*\n((?:[ \t]+[^\n]+\n?)+)", doc)
            given = re.findall(r"^\s*(\w+)(?:\s*\([^)]*\))?:\s*([^\n]+)", part[1], re.M) if part else []
            back = re.search(r"Returns:\s*\n?\s*([^\n]+)", doc)
            rows.append(row(kind, node.name, doc, back[1].strip() if back else None, given))
    notes = [x.strip() for x in re.findall(r"^\s*#\s?([^\n]*)", text, re.M)]
    return rows + [row("comment", None, x) for x in notes] + _todos([x for x in notes if x.lower().startswith("todo")])


_HASH = {"python", "py", "ruby", "rb", "perl", "shell", "bash", "sh", "yaml", "r"}
_DASH = {"sql", "lua", "haskell", "ada"}


def generic(language: str, text: str) -> list[dict]:
    mark = "#" if language in _HASH else "--" if language in _DASH else "//"
    lines = [x.strip()[len(mark) :].strip() for x in text.split("\n") if x.strip().startswith(mark)]
    blocks = [_plain_jsdoc(x) for x in re.findall(r"/\*.*?\*/", text, re.S)]
    return [row("comment", None, x) for x in lines] + [row("block", None, x) for x in blocks] + _todos([x for x in lines if x.lower().startswith("todo")] + [m[1] for x in blocks if (m := re.search(r"TODO:?[ \t]*([^\r\n]*)", x))])


_READERS = {"csharp": csharp, "cs": csharp, "c#": csharp, "typescript": typescript, "ts": typescript, "javascript": typescript, "js": typescript, "python": python, "py": python}


def read(language: str, text: str) -> list[dict]:
    f = _READERS.get(language.lower())
    try:
        return f(text) if f else generic(language.lower(), text)
    except (SyntaxError, ValueError, RecursionError):
        return generic(language.lower(), text)
