"""Text functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension to language, fixed values.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".html": "html",
    ".css": "css", ".scss": "scss", ".sass": "sass", ".less": "less", ".json": "json", ".xml": "xml", ".yaml": "yaml", ".yml": "yaml",
    ".md": "markdown", ".cs": "csharp", ".java": "java", ".rb": "ruby", ".php": "php", ".go": "go", ".rs": "rust", ".c": "c",
    ".cpp": "cpp", ".h": "c", ".hpp": "cpp", ".sh": "bash", ".ps1": "powershell", ".sql": "sql", ".swift": "swift",
}
# Suffix to kind of an Angular file, fixed values, in order of precedence.
FILE_KINDS = {
    ".component.ts": "component", ".service.ts": "service", ".module.ts": "module", ".directive.ts": "directive",
    ".pipe.ts": "pipe", ".guard.ts": "guard", ".interceptor.ts": "interceptor",
}


def basename(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def extension(path: Column) -> Column:
    """The last suffix of the base name, lower-cased, with its dot; '' without one. A leading dot is no suffix."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))


def language_of(path: Column, unknown: str | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit(unknown))


def file_kind(path: Column) -> Column:
    out = F.lit("unknown")
    for suffix, kind in reversed(FILE_KINDS.items()):
        out = F.when(F.endswith(path, F.lit(suffix)), kind).otherwise(out)
    return out


def last_segment(name: Column, sep: str = ".") -> Column:
    return F.substring_index(name, sep, -1)


def qualified(namespace: Column, name: Column, sep: str = ".") -> Column:
    """namespace.name, or the name alone where the namespace is null or empty."""
    return F.concat_ws(sep, F.nullif(namespace, F.lit("")), name)


def split_trim(text: Column, sep: str = ",") -> Column:
    """Parts between separators, trimmed; empty ones are left out."""
    return F.filter(F.transform(F.split(text, re.escape(sep)), lambda x: F.trim(x)), lambda x: x != "")


def preview(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def line_preview(text: Column, most: int = 300) -> Column:
    """As many whole lines as fit into most characters, then '...'; a first line that is longer is cut."""
    lines = F.split(text, "\n", -1)
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def add(a: Column, line: Column) -> Column:
        joined = F.when(a["n"] == 0, line).otherwise(F.concat(a["kept"], F.lit("\n"), line))
        fits = ~a["full"] & (F.length(joined) <= most)
        return F.struct(F.when(fits, joined).otherwise(a["kept"]).alias("kept"), (a["n"] + F.when(fits, 1).otherwise(0)).alias("n"), (~fits).alias("full"))

    whole = F.aggregate(lines, start, add, lambda a: F.when(a["n"] == 0, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(F.concat(a["kept"], F.lit("\n..."))))
    return F.when(F.length(text) <= most, text).otherwise(whole)


def byte_size(n: Column) -> Column:
    """B to PB with two decimals, exact ties to the even one."""
    shown = lambda power: F.bround(n / F.lit(1024.0**power), 2)
    out = F.format_string("%.2f PB", shown(5))
    for power, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        out = F.when(n < F.lit(1024.0 ** (power + 1)), F.format_string(f"%.2f {unit}", shown(power))).otherwise(out)
    return out


def uptime(seconds: Column) -> Column:
    s = F.floor(seconds)
    return F.concat_ws(" ", F.concat(F.floor(s / 86400), F.lit("d")), F.concat(F.floor(F.pmod(s, F.lit(86400)) / 3600), F.lit("h")), F.concat(F.floor(F.pmod(s, F.lit(3600)) / 60), F.lit("m")), F.concat(F.pmod(s, F.lit(60)), F.lit("s")))


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression; * and ? also match '/'."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[^{body[1:]}]" if body[0] == "!" else f"[{body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def line_stats(text: Column) -> Column:
    """struct<line_count, empty_line_count, comment_line_count>; an empty text has one empty line. One match a line."""
    marks = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_extract(x, r"^\s*(#|//|/\*|\*|\S)?", 1))
    start = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("line_count", "empty_line_count", "comment_line_count")])
    one = lambda when: F.when(when, F.lit(1)).otherwise(F.lit(0)).cast("long")
    return F.aggregate(marks, start, lambda a, m: F.struct(
        (a["line_count"] + 1).alias("line_count"), (a["empty_line_count"] + one(m == "")).alias("empty_line_count"),
        (a["comment_line_count"] + one(m.isin("#", "//", "/*", "*"))).alias("comment_line_count"),
    ))


def stable_id(*parts: Column) -> Column:
    """A deterministic id of values; nulls and empty strings differ."""
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(F.concat(F.lit("s"), p.cast("string")), F.lit("n")) for p in parts]), 256)


def clean_xml_doc(text: Column) -> Column:
    """A /// comment without its markers and tags."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*///\s?", ""), "<[^>]+>", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def clean_jsdoc(text: Column) -> Column:
    """A /** */ comment without its markers, lines trimmed, without blank lines at both ends."""
    inner = F.regexp_replace(F.regexp_replace(text, r"^\s*/\*\*+", ""), r"\*/\s*$", "")
    lines = F.transform(F.split(inner, "\n", -1), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*\*?\s?", ""), r"\s+$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+$", "")


# --- texts of entities for embedding
def class_text(name: Column, namespace: Column, access: Column, modifier: Column, bases: Column, content: Column | None = None) -> Column:
    """A class as a text: its name, namespace, access, modifier, bases, and its content if there is any."""
    line = lambda label, value: F.concat(F.lit(label), value, F.lit("\n"))
    head = F.concat(
        F.lit("Class: "), F.coalesce(name, F.lit("None")), F.lit(" in namespace "), F.coalesce(namespace, F.lit("None")), F.lit("\n"),
        line("Access: ", F.coalesce(access, F.lit("unknown"))), line("Modifier: ", F.coalesce(modifier, F.lit("none"))), line("Inheritance: ", F.array_join(F.coalesce(bases, F.array().cast("array<string>")), ", ")),
    )
    return head if content is None else F.concat(head, F.when(F.coalesce(content, F.lit("")) != "", F.concat(F.lit("\nContent:\n"), content, F.lit("\n"))).otherwise(""))


def classes_text(classes: Column) -> Column:
    """A list of array<struct<name, n_methods, n_properties>>."""
    lines = F.transform(classes, lambda c: F.concat(F.lit("- "), c["name"], F.lit(": "), c["n_methods"].cast("string"), F.lit(" methods, "), c["n_properties"].cast("string"), F.lit(" properties\n")))
    return F.when(F.coalesce(F.size(classes), F.lit(0)) <= 0, "No classes found.").otherwise(F.array_join(lines, ""))


def interfaces_text(names: Column) -> Column:
    return F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, "No interfaces found.").otherwise(F.array_join(F.transform(names, lambda n: F.concat(F.lit("- "), n, F.lit("\n"))), ""))


def file_text(path: Column, language: Column, namespace: Column, classes: Column, interfaces: Column) -> Column:
    """A file as a text: its path, language and namespace, and the lists of its classes and interfaces."""
    none = lambda c: F.coalesce(c, F.lit("None"))
    return F.concat(F.lit("\nFile: "), path, F.lit("\nLanguage: "), none(language), F.lit("\nNamespace: "), none(namespace), F.lit("\n\nClasses:\n"), classes_text(classes), F.lit("\n\nInterfaces:\n"), interfaces_text(interfaces), F.lit("\n"))
