"""Chunks along a language's structure: headers, classes, methods and functions, else ranges of lines."""

from __future__ import annotations

import re

from . import parse
from .chunk import LEAST, MOST, OVERLAP

ROW = "struct<type:string,name:string,content:string>"


def row(kind: str, name: str | None, content: str) -> dict:
    return {"type": kind, "name": name, "content": content}


def by_lines(text: str) -> list[dict]:
    """The line packer; see chunk.line_ranges() for its rule."""
    if len(text) <= MOST:
        return [row("file", None, text)]
    lines, out, start, size = text.split("\n"), [], 0, 0
    for i, line in enumerate(lines):
        if size + len(line) + 1 > MOST and size > LEAST:
            out.append(row("segment", None, "\n".join(lines[start:i])))
            start = i - min(i - start, OVERLAP)
            size = sum(len(x) + 1 for x in lines[start:i])
        size += len(line) + 1
    if size > LEAST:
        out.append(row("segment", None, "\n".join(lines[start:])))
    return out


_OPENS = re.compile(r"\s*\{")
_TS_IMPORTS = re.compile(r"import\s+.+\s+from\s+(['\"])[^'\"\n]*\1;?")
_TS_COMPONENT = re.compile(r"@Component\(\s*\{[^}]+\}\s*\)\s*export\s*class\s*(\w+)")


def _large(kind: str, name: str, body: str, members: list[tuple[str, str]]) -> list[dict]:
    """A class as one chunk, or its first MOST characters and its methods of more than LEAST."""
    if len(body) <= MOST:
        return [row(kind, name, body)]
    return [row("class_declaration", name, body[:MOST])] + [row("method", f"{name}.{n}", x) for n, x in members if len(x) > LEAST]


def csharp(text: str) -> list[dict]:
    src, out = parse.Source(text), []
    if (m := parse._CS_NAMESPACE.search(text)) and len(head := text[: m.start()].strip()) > LEAST:
        out.append(row("file_header", None, head))
    for m in parse._CS_CLASS.finditer(text):
        if _OPENS.match(text, m.end()):
            end = src.block_end(m.end())
            found = [(x[4], text[x.start() : src.block_end(x.end() - 1) if text[x.end() - 1] == "{" else x.end()]) for x in parse._CS_METHOD.finditer(text, m.end(), end) if x[4].lower() not in parse.KEYWORDS and x[3].lower() not in parse.KEYWORDS] if end - m.start() > MOST else []
            out += _large("class", m[3], text[m.start() : end], found)
    for m in parse._CS_INTERFACE.finditer(text):
        if _OPENS.match(text, m.end()):
            out.append(row("interface", m[2], text[m.start() : src.block_end(m.end())]))
    return out


def typescript(text: str) -> list[dict]:
    src, out, head = parse.Source(text), [], 0
    for m in _TS_IMPORTS.finditer(text):
        head = m.end()
    if len(text[:head].strip()) > LEAST:
        out.append(row("imports", None, text[:head].strip()))
    for m in _TS_COMPONENT.finditer(text):
        out.append(row("angular_component", m[1], text[m.start() : src.block_end(m.end())]))
    for m in parse._TS_CLASS.finditer(text):
        end = src.block_end(m.end() - 1)
        found = [(x[3], text[x.start(3) : src.block_end(x.end() - 1)]) for x in parse._TS_METHOD.finditer(text, m.end(), end) if x[3] not in parse.KEYWORDS - {"constructor"}] if end - m.start() > MOST else []
        out += _large("class", m[1], text[m.start() : end], found)
    for m in parse._TS_FUNCTION.finditer(text):
        if len(body := text[m.start() : src.block_end(m.end() - 1)]) > LEAST:
            out.append(row("function", m[2], body))
    return out


def python(text: str) -> list[dict]:
    """Top-level classes and functions up to their last line, and what comes before the first of them."""
    found, lines, out = parse.python(text), text.split("\n"), []
    part = lambda r: "\n".join(lines[r["first_line"] - 1 : r["last_line"]])
    tops = [r for r in found if r["kind"] in ("class", "function")]
    if tops and len(head := "\n".join(lines[: min(r["first_line"] for r in tops) - 1])) > LEAST:
        out.append(row("module_header", None, head))
    for r in tops:
        if r["kind"] == "function":
            out.append(row("function", r["name"], part(r)))
        else:
            out += _large("class", r["name"], part(r), [(x["name"], part(x)) for x in found if x["kind"] == "method" and x["parent"] == r["name"]] if len(part(r)) > MOST else [])
    return out


SPLITTERS = {parse.csharp: csharp, parse.typescript: typescript, parse.python: python}


def split(language: str, text: str) -> list[dict]:
    """Chunks by the language's structure: headers, components, classes (or their declarations and methods if they are longer than MOST), interfaces, functions; else ranges of lines."""
    f = SPLITTERS.get(parse.PARSERS.get(language.lower()))
    try:
        return (f(text) if f else []) or by_lines(text)
    except (SyntaxError, ValueError, RecursionError):
        return by_lines(text)
