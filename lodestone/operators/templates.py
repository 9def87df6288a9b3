"""Tokens of HTML templates as sorted distinct arrays, by regular expressions inside the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def found(text: Column, *patterns: str) -> Column:
    """Distinct first groups of all matches of the patterns, sorted."""
    every = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])
    return F.array_sort(F.array_distinct(every))


def template_tokens(html: Column) -> dict[str, Column]:
    return {
        "components": found(html, r"<([a-z]+-[a-z0-9-]+)[^>]*>"),
        "directives": found(html, r"\*([A-Za-z]+)=", r"\[([A-Za-z]+)\]"),
        "pipes": found(html, r"\|\s*([A-Za-z0-9]+)"),
        "form_controls": found(html, r"formControlName=[\"']([^\"']+)[\"']"),
        "tags": found(html, r"<([a-z][a-z0-9]*)[\s>/]"),
        "links": found(html, r"href=[\"']([^\"']+)[\"']"),
    }
