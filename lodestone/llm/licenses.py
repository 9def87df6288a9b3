"""License scans by canonical digests (DataFrame functions only).

A text's canonical form is lower-cased, without copyright lines and punctuation, with white space as single blanks and
equivalent spellings of whole words made one. The SHA-256 of the whole form is hash-joined with the digests of known
licenses, and so is that of every line, which finds license statements inside longer texts. The form is made once: one scan writes each text's
digest and those line digests that may be known (a known set of checked size is a filter inside the scan); only these are joined.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, maybe_broadcast

# Equivalent spellings of whole words, fixed values: first the spelling that is replaced.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "favour": "favor",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelled": "labeled",
    "licence": "license",
    "licenced": "licensed",
    "licencing": "licensing",
    "organisation": "organization",
    "owner": "holder",
    "per cent": "percent",
    "programme": "program",
    "recognise": "recognize",
    "whilst": "while",
    "wilful": "willful",
    "https": "http",
}
_ANY = rf"\b(?:{'|'.join(SPELLINGS)})\b"
_COPYRIGHT = r"(?m)^[ \t#*/;.%-]*(?:copyright\b[^\n]*(?:\(c\)|©|[0-9]{4}|<|\[)|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*$"
_OTHER = r"[^\p{L}\p{N}\n]+"
#: Known digests up to which they are a filter inside the scan; a larger catalogue is joined with all lines.
IN_SCAN = 20_000

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Known texts: (license, text). Statements are texts of their own.
KNOWN = [
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]
#: Full texts: a file for each license.
TEXTS = Path(__file__).with_name("license_texts")
#: License: names in statements, the first one also as the text's title. Those without a file are known by statements only.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "ISC": ["ISC License", "ISC"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "Simplified BSD License", "2-Clause BSD License", "BSD-2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "New BSD License", "Modified BSD License", "3-Clause BSD License", "BSD-3-Clause License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License", "Apache 2.0"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "MPL-1.1": ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "Artistic-1.0": ["Artistic License", "Artistic License 1.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "EPL 2.0"],
    "GFDL-1.2": ["GNU Free Documentation License, Version 1.2"],
    "GFDL-1.3": ["GNU Free Documentation License, Version 1.3"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "CC0"],
}
for _id, _name, _short in (("GPL", "GNU General Public License", "GPL"), ("LGPL", "GNU Lesser General Public License", "LGPL"), ("AGPL", "GNU Affero General Public License", "AGPL")):
    for _v in {"GPL": ("1.0", "2.0", "3.0"), "LGPL": ("2.0", "2.1", "3.0"), "AGPL": ("3.0",)}[_id]:
        _brief = _v.removesuffix(".0")
        _own = "GNU Library General Public License" if (_id, _v) == ("LGPL", "2.0") else _name
        NAMES[f"{_id}-{_v}"] = [x for v in dict.fromkeys((_brief, _v)) for x in (f"{_own}, version {v}", f"{_own} version {v}", f"{_own} v{v}", f"{_own} {v}", f"{_short} v{v}", f"{_short}v{v}", f"{_short} {v}", f"{_short}-{v}")]
for _v in ("3.0", "4.0"):
    for _kind, _name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
        NAMES[f"CC-{_kind}-{_v}"] = [f"CC {_kind} {_v}", f"Creative Commons {_name} {_v} International License", f"Creative Commons {_name} {_v} License", f"Creative Commons {_name} {_v}"]


def statements(license: str) -> list[str]:
    """One-line statements of a license: SPDX tags, and its names in the usual sentences."""
    ids = [license, f"{license}-only", f"{license}-or-later", f"{license}+"] if re.match("A?L?GPL-|GFDL-", license) else [license]
    starts = [f"{a}{b}{c}" for a in ("", "This work is ", "This software is ", "This project is ", "This program is ", "This code is ", "This file is ") for b in ("licensed", "released", "distributed") for c in (" under ", " under the ", " under a ")]
    starts += ["License: ", "License: the ", "Available under the "]
    names = dict.fromkeys([*NAMES[license], *(f"{n} license" for n in NAMES[license] if "license" not in n.lower()), *ids])
    return [f"SPDX-License-Identifier: {i}" for i in ids] + [f"{a}{n}" for a in starts for n in names]


def full_texts(license: str) -> list[str]:
    """A license's whole text, also with its title, without its appendix or its clauses' numbers, and its header."""
    path = TEXTS / f"{license}.txt"
    if not path.exists():
        return []
    text = path.read_text()
    out = [text]
    end = re.search(r"(?m)^\s*END OF TERMS AND CONDITIONS\s*$", text)
    if end:
        out += [text[: end.end()], text[: end.start()]]
    if license == "Apache-2.0":
        out.append(text[text.index("Licensed under the Apache License") :])
    if license == "MPL-2.0":
        out.append(" ".join(text[text.index("This Source Code Form is subject to") : text.index("If it is not possible")].split()))
    if license in ("BSD-2-Clause", "BSD-3-Clause", "Zlib"):
        out.append(re.sub(r"(?m)^\d\. ", "", text))
    if license in ("BSD-2-Clause", "BSD-3-Clause", "Zlib", "BSL-1.0", "Unlicense"):
        out += [f"{a}{n}\n\n{x}" for x in list(out) for n in NAMES[license] for a in ("", "The ")]
    return out


KNOWN += [(x, t) for x in NAMES for t in (*full_texts(x), *statements(x))]


def canonical(text: Column) -> Column:
    """The canonical form, with line breaks still in it."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), _COPYRIGHT, ""), _OTHER, " ")
    same = out
    for old, new in SPELLINGS.items():
        same = F.regexp_replace(same, rf"\b{old}\b", new)
    return F.when(out.rlike(_ANY), same).otherwise(out)


def _lines(form: Column) -> Column:
    return F.filter(F.transform(F.split(form, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | DataFrame = KNOWN) -> DataFrame:
    """(license, digest) of (license, text); texts that are empty in canonical form are left out."""
    if not isinstance(known, DataFrame):
        known = spark.createDataFrame(known, "license string, text string")
    form = F.array_join(_lines(canonical(F.col("text"))), " ")
    return known.select("license", form.alias("form")).where("form != ''").select("license", F.sha2("form", 256).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def license_matches(docs: DataFrame, known: list[tuple[str, str]] | DataFrame = KNOWN, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, digest, license (of the whole text, or null), n_license_lines, line_licenses (sorted, comma-joined).

    Null texts count as empty; a text without letters and digits has a digest and no license. Of a digest known under
    several names the first by name counts. Repeated rows each get their row, ids must be integers or read as such; an empty table gives none.
    """
    digests = materialise(known_digests(docs.sparkSession, known), "licenses")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), canonical(text).alias("form")).select("doc_id", _lines(F.col("form")).alias("lines"))
    rows = rows.select("doc_id", F.sha2(F.array_join("lines", " "), 256).alias("digest"), F.transform("lines", lambda x: F.sha2(x, 256)).alias("line_digests"))
    some = [r.digest for r in digests.select("digest").limit(IN_SCAN + 1).collect()]
    if len(some) <= IN_SCAN:
        names = ", ".join(f"'{x}'" for x in some) or "''"
        rows = rows.withColumn("line_digests", F.expr(f"filter(line_digests, x -> x IN ({names}))"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "license-lines")  # fixed once written
    found = rows.select("row", F.explode("line_digests").alias("digest")).join(maybe_broadcast(digests), "digest")
    found = found.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("names"))
    out = rows.select("doc_id", "row", "digest").join(maybe_broadcast(digests), "digest", "left").join(found, "row", "left")
    return out.select("doc_id", "digest", "license", F.coalesce("n", F.lit(0)).cast("long").alias("n_license_lines"), F.coalesce("names", F.lit("")).alias("line_licenses"))


def plain_form(text: str) -> list[str]:
    """The lines of a text's canonical form, in plain Python; for SQL and tests."""
    out = re.sub(r"[^\w\n]|_", " ", re.sub(_COPYRIGHT, "", text.lower()))
    out = "\n".join(" ".join(x.split()) for x in out.split("\n"))
    for old, new in SPELLINGS.items():
        out = re.sub(rf"\b{old}\b", new, out)
    return [x for x in out.split("\n") if x]
