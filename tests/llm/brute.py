"""Plain versions of the operators, for comparison on small tables."""

import re


def words(text):
    return (text or "").encode().split()


def near_dup(rows, width=4, similarity=80):
    sets = []
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((doc, {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()))
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= similarity * len(s | t):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {(d, len(s), root(d), root(d) == d) for d, s in sets}


_ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_words(text):
    return _ITEM_WORD.findall((text or "").translate(_LOWER))


def contaminated(docs, items, window=10):
    from hashlib import sha256

    windows = {}
    for item, text in items:
        w = item_words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = set()
    for doc, text in docs:
        w, hit, found = item_words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (x := tuple(w[i : i + k])) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[x]
        ids = ",".join(sorted(str(x) for x in found))
        out.add((doc, len(w), len(hit), len(found), sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def quality(rows):
    out = set()
    for doc, text in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines, seen, dup = text.split("\n"), set(), 0
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        at = {}
        for i in range(len(w) - 7):
            at.setdefault(tuple(w[i : i + 8]), []).append(i)
        covered = {j for x in at.values() if len(x) > 1 for i in x for j in range(i, i + 8)}
        n = len(w)
        out.add((doc, n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n))
    return out


def secrets(text):
    from hashlib import sha256

    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    found.sort()
    n = [sum(k == i for _, k, _, _ in found) for i in range(3)]
    spans = [f"{name}:{a}:{b}" for a, _, b, name in found]
    return (*n, sha256(",".join(spans).encode()).hexdigest()), spans


def chat(rows):
    from hashlib import sha256

    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role or "", text or ""))
    out = set()
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        every = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out.add((conv, len(turns), sha256(every.encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest()))
    return out
