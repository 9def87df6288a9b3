"""Secret scans: fixed patterns, and a randomness test battery with false-discovery control.

Base spans come from three fixed patterns. The battery looks at every other run of LEAST or more characters
of an encoding's alphabet: its encoding is inferred (hexadecimal, base32, base36, base64), and the
positions of its characters in that alphabet go through three tests against a uniform random string:
chi-squared over equal groups of the alphabet (more groups for longer strings), runs above and below
the alphabet's middle, and serial correlation of neighbours. The least of the three p-values, times 3, is
the string's randomness (1: nothing speaks against a random string).

False-discovery control asks the reverse: could prose give this? All letters of every document outside of these spans and strings are
written in each encoding's alphabet (in one case where it has one, and for hexadecimal the letters a to f alone), cut into consecutive blocks
of each length class's least length, and tested in the same way; the share of these blocks that are at least as random
is a string's p-value within its encoding and length class. Short strings pass the tests more easily, so a shorter class's share
bounds it as well, which counts where texts are too short for long blocks. Benjamini-Hochberg at RATE over all strings of
the encoding and class gives the class's cutoff, which is never below FLOOR. With fewer than 1 / RATE - 1 blocks up to the class's length no string
could ever be reported; there the battery's own p-value decides, at FLOOR. All that is gathered are
histograms of BINS bins by encoding and length class; they count all documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, trimmed

LEAST, RATE, BINS = 20, 0.01, 50
#: The battery itself must not reject the string at one in a thousand.
FLOOR = BINS - 1 - 30
#: Length classes: the least length of each.
CLASSES = (20, 28, 40, 64)
KINDS = ("assign", "access", "hex", "random")

# Fixed patterns: the kinds' definitions.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

_LONG = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST)
_ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
_PLACES = [(name, {c: i for i, c in enumerate(a)}, len(a)) for name, a in _ALPHABETS]
#: Encodings that share a null distribution: upper and lower case of the same digits.
FAMILIES = ("hex", "base32", "base36", "base64")
_URL = str.maketrans("-_", "+/")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in code points, by start and then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, df: int) -> float:
    """Wilson and Hilferty's approximation of the chi-squared distribution's upper tail."""
    return 0.5 * math.erfc(((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)) / math.sqrt(2))


def randomness(codes: list[int], size: int) -> float:
    """Three times the least p-value of the battery, at most 1, for positions in an alphabet of that size."""
    n = len(codes)
    groups = max(2, min(size, n // 5, 16))
    counts = [0] * groups
    for c in codes:
        counts[c * groups // size] += 1
    widths = [0] * groups
    for c in range(size):
        widths[c * groups // size] += 1
    chi = sum((k - n * w / size) ** 2 / (n * w / size) for k, w in zip(counts, widths, strict=True))
    ps = [_chi_tail(chi, groups - 1)]
    above = [2 * c >= size for c in codes]
    up = sum(above)
    down = n - up
    if up and down:
        runs = 1 + sum(a != b for a, b in zip(above, above[1:]))
        mean = 1 + 2 * up * down / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        ps.append(_normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 0.0)
    else:
        ps.append(0.0)
    m = sum(codes) / n
    spread = sum((c - m) ** 2 for c in codes)
    serial = sum((a - m) * (b - m) for a, b in zip(codes, codes[1:])) / spread if spread else 1.0
    ps.append(_normal_tail((serial + 1 / n) * math.sqrt(n)))
    return min(1.0, 3 * min(ps))


def encoding(token: str) -> tuple[str, list[int], int]:
    """The first alphabet that has all characters of a token, its positions there, and the alphabet's size."""
    plain = token.rstrip("=").translate(_URL)
    have = set(plain)
    for name, place, size in _PLACES:
        if have <= place.keys():
            return name, [place[c] for c in plain], size
    raise ValueError(token)


def length_class(n: int) -> int:
    return sum(n >= x for x in CLASSES) - 1


def _bin(score: float) -> int:
    """Bins by the logarithm of the randomness: BINS - 1 for 1, and ten of them for each power of ten."""
    return max(0, BINS - 1 + math.ceil(10 * math.log10(max(score, 1e-9))))


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, int, int, int]]:
    """(start, end, family, length class, bin) of long strings that overlap no base span and have letters and digits, or both cases."""
    found = []
    for m in _LONG.finditer(text):
        s = m.group()
        if any(a < m.end() and m.start() < b for a, b, _ in taken) or not (any(c.isdigit() for c in s) or (s != s.lower() and s[1:].lower() != s[1:])):
            continue
        name, codes, size = encoding(s)
        if len(codes) >= LEAST:
            found.append((m.start(), m.end(), FAMILIES.index(name.lower()), length_class(len(codes)), _bin(randomness(codes, size))))
    return found


def _letters(family: str) -> tuple[np.ndarray, int]:
    """The letters' bytes as places in a family's alphabet, 255 for what it leaves out, and the alphabet's size."""
    place, size = next((p, n) for name, p, n in _PLACES if name == family)
    out = np.full(256, 255, np.uint8)
    for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
        at = place.get(c, place.get(c.lower(), place.get(c.upper())))
        if at is not None:
            out[ord(c)] = at
    return out, size


_LETTERS = [_letters(f) for f in FAMILIES]
_ERFC = np.frompyfunc(math.erfc, 1, 1)
#: Letters of blocks that are tested at a time.
PIECE = 1 << 18


def block_scores(codes: np.ndarray, size: int = 64) -> np.ndarray:
    """randomness() of each row of places in an alphabet of that size."""
    rows, n = codes.shape
    codes = codes.astype(np.int64)
    groups = max(2, min(size, n // 5, 16))
    group = codes * groups // size
    counts = np.bincount((group + groups * np.arange(rows)[:, None]).ravel(), minlength=rows * groups).reshape(rows, groups)
    mean = n * np.bincount(np.arange(size) * groups // size, minlength=groups) / size
    chi, df = ((counts - mean) ** 2 / mean).sum(axis=1), groups - 1
    chi = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)) / math.sqrt(2)
    above = 2 * codes >= size
    up = above.sum(axis=1)
    runs = 1 + (above[:, 1:] != above[:, :-1]).sum(axis=1)
    m = 1 + 2 * up * (n - up) / n
    var = (m - 1) * (m - 2) / (n - 1)
    ok = (up > 0) & (up < n) & (var > 0)
    z = np.where(ok, np.abs(runs - m) / np.sqrt(np.where(ok, var, 1)), np.inf)
    c = codes - codes.mean(axis=1, keepdims=True)
    spread = (c**2).sum(axis=1)
    serial = np.where(spread > 0, (c[:, 1:] * c[:, :-1]).sum(axis=1) / np.where(spread > 0, spread, 1), 1.0)
    z = np.maximum(z, np.abs((serial + 1 / n) * math.sqrt(n))) / math.sqrt(2)
    return np.minimum(1.0, 3 * np.minimum(0.5 * _ERFC(chi).astype(float), _ERFC(z).astype(float)))


def prose_histogram(texts: list[str]) -> np.ndarray:
    """Blocks by family, length class and bin: all consecutive blocks of each text's letters, for each family and length class."""
    hist = np.zeros((len(FAMILIES), len(CLASSES), BINS), np.int64)
    raw = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts]
    for family, (table, size) in enumerate(_LETTERS):
        places = [table[x] for x in raw]
        places = [x[x < 255] for x in places]
        if not places:
            return hist
        lengths = np.array([len(x) for x in places])
        first, letters = np.cumsum(lengths) - lengths, np.concatenate(places)
        for k, n in enumerate(CLASSES):
            blocks = lengths // n
            within = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            starts = np.repeat(first, blocks) + n * within
            for at in range(0, len(starts), PIECE // n):
                scores = block_scores(letters[starts[at : at + PIECE // n, None] + np.arange(n)], size)
                bins = np.maximum(0, BINS - 1 + np.ceil(10 * np.log10(np.maximum(scores, 1e-9)))).astype(np.int64)
                hist[family, k] += np.bincount(bins, minlength=BINS)
    return hist


def outside(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans."""
    parts, at = [], 0
    for a, b in sorted(spans):
        parts.append(text[at : max(at, a)])
        at = max(at, b)
    return "".join([*parts, text[at:]])


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("family", pa.int32()), ("size", pa.int32()), ("bin", pa.int32())]))
_PROSE = pa.list_(pa.struct([("family", pa.int32()), ("size", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(0, batch.num_rows, 500):
            part = batch.slice(row, 500)
            base, found, prose = [], [], []
            for text in part.column(1).to_pylist():
                text = text or ""
                spans = base_spans(text)
                base.append([{"start": a, "end": b, "kind": k} for a, b, k in spans])
                strings = candidates(text, spans)
                found.append([{"start": a, "end": b, "family": f, "size": c, "bin": d} for a, b, f, c, d in strings])
                prose.append(outside(text, [x[:2] for x in (*spans, *strings)]))
            hist = prose_histogram(prose)  # of all rows, with the first
            blocks = [[{"family": f, "size": k, "bin": b, "n": hist[f, k, b]} for f, k, b in zip(*np.nonzero(hist), strict=True)], *[None] * (len(prose) - 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, _SPAN), pa.array(found, _FOUND), pa.array(blocks, _PROSE)], ["doc_id", "base", "found", "prose"])


def cutoffs(found: dict[tuple[int, int], int], prose: dict[tuple[int, int], int], rate: float = RATE) -> dict[int, int]:
    """Length class: the least bin that is a secret, by Benjamini-Hochberg over histograms {(class, bin): count}."""
    chosen = {}
    for size in range(len(CLASSES)):
        m = sum(n for (s, _), n in found.items() if s == size)
        nulls = [sum(n for (s, _), n in prose.items() if s == k) for k in range(size + 1)]
        if m and 1 > rate * (1 + max(nulls)):
            chosen[size] = FLOOR
            continue
        rank, tails = 0, [0] * (size + 1)
        for b in range(BINS - 1, FLOOR - 1, -1):
            rank += found.get((size, b), 0)
            tails = [t + prose.get((k, b), 0) for k, t in enumerate(tails)]
            share = min((1 + t) / (1 + n) for t, n in zip(tails, nulls, strict=True))
            if rank and m * share <= rate * rank:
                chosen[size] = b
    return chosen


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """(doc_id, base, spans) of each document: spans array<struct<start, end, kind>> in code points, end exclusive, by start and kind.

    Null and empty texts have none; repeated rows each get theirs; ids must be integers or read as such; an empty table gives none. Other columns are ignored.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    span, cand, prose = ("array<struct<start:bigint,end:bigint,kind:string>>", "array<struct<start:bigint,end:bigint,family:int,size:int,bin:int>>", "array<struct<family:int,size:int,bin:int,n:bigint>>")
    scanned = materialise(rows.mapInArrow(trimmed(_scan), f"doc_id long, base {span}, found {cand}, prose {prose}"), "secrets")

    def histogram(column: str, n: str) -> dict[int, dict[tuple[int, int], int]]:  # at most families x classes x bins rows
        out = {f: {} for f in range(len(FAMILIES))}
        for r in scanned.select(F.explode(column).alias("x")).groupBy("x.family", "x.size", "x.bin").agg(F.sum(F.expr(n)).alias("n")).collect():
            out[r.family][r.size, r.bin] = r.n
        return out

    found, null = histogram("found", "1"), histogram("prose", "x.n")
    cut = {(f, s): b for f in found for s, b in cutoffs(found[f], null[f], rate).items()}
    secret = " OR ".join([f"(c.family = {f} AND c.size = {s} AND c.bin >= {b})" for (f, s), b in sorted(cut.items())] or ["false"])
    rank = "transform({}, c -> struct(c.start AS start, {} AS rank, c.end AS end))"
    base = rank.format("base", "array_position(array('assign', 'access', 'hex'), c.kind)")
    more = rank.format(f"filter(found, c -> {secret})", "4L")
    named = "transform({}, c -> struct(c.start AS start, c.end AS end, element_at(array('assign', 'access', 'hex', 'random'), cast(c.rank AS int)) AS kind))"
    return scanned.select("doc_id", "base", F.expr(named.format(f"array_sort(concat({base}, {more}))")).alias("spans"))


def secret_digests(spans: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of secret_spans()'s result."""
    joined = "array_join(transform({}, c -> concat(c.kind, ':', c.start, ':', c.end)), ',')"
    counts = [F.expr(f"cast(size(filter(base, c -> c.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS[:3]]
    return spans.select("doc_id", *counts, F.expr(f"sha2({joined.format('base')}, 256)").alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"))
