"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import re
from collections import defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text)


def shingles(text: str | None, n: int = 5) -> set:
    words = SPACED.findall(lower(text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def clusters(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id), comparing every pair."""
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            common = len(a & b)
            if a and b and 100 * common >= 75 * (len(a) + len(b) - common):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(a), root(i)) for i, a in sets}


def decontaminated(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], n: int = 13) -> dict[int, tuple[int, int, list[str]]]:
    """doc_id -> (n_words, n_hit, sorted item ids)."""
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall(lower(text or ""))
        width = min(n, len(words))
        for i in range(len(words) - width + 1) if width else ():
            windows[tuple(words[i : i + width])].add(str(item))
    widths = {len(w) for w in windows}
    out = {}
    for doc, text in docs:
        words = ALNUM.findall(lower(text or ""))
        hit, found = set(), set()
        for width in widths:
            for i in range(len(words) - width + 1):
                of = windows.get(tuple(words[i : i + width]))
                if of:
                    hit.update(range(i, i + width))
                    found |= of
        out[doc] = (len(words), len(hit), sorted(found))
    return out


def linked_sets(docs: list[tuple[int | None, str | None]], n: int, percent: int) -> list[tuple[int | None, int, int | None]]:
    """(doc_id, set size, component) of each row, comparing every pair of rows; a component is named by its smallest id."""
    sets = [shingles(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(a & b)
            if a and b and 100 * common >= percent * (len(a) + len(b) - common):
                parent[root(i)] = root(j)
    least: dict = defaultdict(list)
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(i)].append(doc)
    return [(doc, len(sets[i]), min(least[root(i)], default=None)) for i, (doc, _) in enumerate(docs)]


def periodic_runs(words: list, exponent: int = 4, shortest: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run, trying every period."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(shortest, exponent * q):
                found.setdefault((i, length), q)
            i = max(j, i) + 1
    return sorted((s, m, q) for (s, m), q in found.items())


def fim_tokens(text: str) -> list[str]:
    return re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
