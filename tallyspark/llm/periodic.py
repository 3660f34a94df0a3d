"""Runs of periodic words, found with a suffix automaton.

A run is a stretch of words with a smallest period q (words q apart are equal), of at least
`exponent` periods and `shortest` words, which no neighbouring word extends.

1. Stretches. A run of four periods or more and six words or more holds each of its groups
   of GROUP words at least twice, so words outside the groups that recur in their stretch
   can't be in a run. Stretches are narrowed by that rule until nothing changes; most texts
   end with none. The rule is exact: it drops no run. For fewer periods it isn't used.
2. Automaton. Each stretch gives a suffix automaton. From the longest states to the root, a
   state's ordered set of end positions is merged into its suffix link's, the smaller set
   into the larger one. A position new to a set meets its two neighbours: if their distance d
   doesn't exceed the state's length, the state's longest word repeats at distance d, a
   square. Of a run's squares the last one, which no further word continues, has the whole
   run within it: as many words before as the state is long.
3. Runs. Squares with less than (exponent - 1) * d words before are too short a run. Of the
   distances found for the same stretch of words the smallest is its period.

Defined cases: a null or empty text, or one of white space only, has no words and no runs.
Words are compared as bytes, not folded. Repeated rows give the same rows, a null doc_id
stays null. One text is worked on in one row, however long it is, with memory in proportion
to its length; an empty table gives no rows. Of the input only doc_id and text are read, so
other columns may have any name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.words import freed, hashes, portions, split, windows

EXPONENT, SHORTEST = 4, 6
#: Consecutive words that a run of EXPONENT periods and SHORTEST words holds twice.
GROUP = 5
#: Positions of one part of an ordered set.
PART = 512

RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Positions:
    """An ordered set of numbers, in parts of at most 2 * PART, so that adding one moves few others."""

    __slots__ = ("parts", "tops", "size")

    def __init__(self, first: int):
        self.parts, self.tops, self.size = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for part in self.parts:
            yield from part

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Add x, which is new, and give the numbers before and after it."""
        parts, tops = self.parts, self.tops
        at = min(bisect_left(tops, x), len(parts) - 1)
        part = parts[at]
        i = bisect_left(part, x)
        before = part[i - 1] if i else tops[at - 1] if at else None
        after = part[i] if i < len(part) else None
        part.insert(i, x)
        tops[at] = part[-1]
        self.size += 1
        if len(part) > 2 * PART:
            parts[at : at + 1] = [part[:PART], part[PART:]]
            tops[at : at + 1] = [part[PART - 1], part[-1]]
        return before, after


def automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, suffix link, own end position or -1) of each state; state 0 is the root."""
    length, link, end, step = [0], [-1], [-1], [{}]
    last = 0
    for i, c in enumerate(word):
        new = len(length)
        length.append(i + 1)
        link.append(0)
        end.append(i)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return length, link, end


def runs(word: list[int], exponent: int = EXPONENT, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the word, by start, then period."""
    length, link, end = automaton(word)
    n = len(word)
    held: list[Positions | None] = [Positions(e) if e >= 0 else None for e in end]
    found: dict[tuple[int, int], int] = {}
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        up, mine = link[state], held[state]
        held[state] = None
        theirs = held[up]
        if up == 0:  # words without a common suffix
            continue
        if theirs is None:
            held[up] = mine
            continue
        if theirs.size < mine.size:
            theirs, mine = mine, theirs
        size = length[up]
        most = size // (exponent - 1)
        last = None
        for x in mine:
            before, after = theirs.add(x)
            # a neighbour from the same set met x in a longer state
            for p, e in ((None if before == last else before, x), (x, after)):
                if p is None or e is None or e - p > most:
                    continue
                d = e - p
                if e + 1 < n and word[e + 1] == word[e + 1 - d]:
                    continue  # the same run's square one word on
                key = (p - size + 1, e)
                if e - key[0] + 1 >= shortest and found.get(key, n) > d:
                    found[key] = d
            last = x
        held[up] = theirs
    return sorted((a, e - a + 1, d) for (a, e), d in found.items())


def stretches(codes: np.ndarray, starts: np.ndarray, vocab: list[bytes], group: int = GROUP) -> Iterator[tuple[int, int, int]]:
    """(document, begin, end) of the stretches of the flat words in which each group of words recurs."""
    document = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    hashed = windows(hashes(vocab)[codes], group) if len(codes) >= group else np.zeros(0, np.uint64)
    at = np.flatnonzero(document[: len(hashed)] == document[group - 1 :]) if len(hashed) else np.zeros(0, np.int64)
    part = document[at]
    while len(at):
        order = np.lexsort((hashed[at], part))
        same = (hashed[at][order][1:] == hashed[at][order][:-1]) & (part[order][1:] == part[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        kept = at[twice]
        # a stretch ends where the next group isn't one word on, or belongs to another text
        gap = (np.diff(kept) != 1) | (document[kept[1:]] != document[kept[:-1]]) if len(kept) else np.zeros(0, bool)
        fresh = np.concatenate([[0], np.cumsum(gap)]) if len(kept) else np.zeros(0, np.int64)
        done = len(kept) == len(at)
        at, part = kept, fresh
        if done:
            break
    for first, last in zip(np.flatnonzero(np.diff(part, prepend=-1)), np.flatnonzero(np.diff(part, append=len(at) + 1)), strict=True):
        yield int(document[at[first]]), int(at[first]), int(at[last]) + group


def detected(docs: DataFrame, exponent: int = EXPONENT, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document: its runs by start, then period, and its words
    without those that only repeat (what follows the first period of a run), joined by one space."""
    if exponent < 2 or shortest < 2:
        raise ValueError("a run has two periods and two words at least")
    narrow = exponent >= EXPONENT and shortest >= SHORTEST
    source = docs.select("doc_id", F.col("text").cast("binary").alias("_text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "_text"):
            words = split(batch.column("_text"), None)
            n = len(words.starts) - 1
            rows: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
            spans = stretches(words.codes, words.starts, words.vocab) if narrow else ((i, a, z) for i, (a, z) in enumerate(zip(words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True)))
            for i, a, z in spans:
                shift = a - int(words.starts[i])
                rows[i] += [(s + shift, m, q) for s, m, q in runs(words.codes[a:z].tolist(), exponent, shortest)]
            collapsed = []
            for i, own in enumerate(rows):
                own.sort(key=lambda r: (r[0], r[2]))
                codes = words.codes[words.starts[i] : words.starts[i + 1]]
                keep = np.ones(len(codes), bool)
                for s, m, q in own:
                    keep[s + q : s + m] = False
                collapsed.append(b" ".join([words.vocab[c] for c in codes[keep].tolist()]).decode())
            kinds = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
            listed = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in rows], kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.counts), listed, pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(freed(scan), f"doc_id {kind}, n_words long, runs array<{RUN}>, collapsed string")


def longest(found: Column) -> Column:
    """Of an array of runs the longest, the first and then the one of the smallest period among equals; null without runs."""
    ranked = F.transform(found, lambda r: F.struct(-r["length"], r["start"], r["period"], r.alias("run")))
    return F.array_min(ranked)["run"]


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by their ids' hash, repeats from some word on.

    Let h be the crc32 of the id and g = h / 10 without remainder. Where h is divisible by 10, a text of
    n words keeps the first a = g % n and a period of p = 1 + (n - a) / (3 + g % 8) words after them,
    which then repeats. The words of such a text are joined by one space; other texts stay as they are."""
    space = "\\x20\\x09-\\x0D"
    words = F.regexp_extract_all("text", F.lit(f"[^{space}]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, words).alias("_w"))
    n, g = F.size("_w"), F.floor(F.col("_h") / 10)
    rows = rows.withColumn("_n", n.cast("long")).withColumn("_a", F.when(n > 0, g % n))
    rows = rows.withColumn("_p", F.lit(1) + F.floor((F.col("_n") - F.col("_a")) / (F.lit(3) + g % 8)))
    kept = F.slice("_w", F.lit(1), F.col("_a").cast("int"))
    period = F.slice("_w", (F.col("_a") + 1).cast("int"), F.col("_p").cast("int"))
    times = F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(period, times)), F.lit(1), (F.col("_n") - F.col("_a")).cast("int"))
    planted = F.array_join(F.concat(kept, tail), " ")
    return rows.select("doc_id", F.when(F.col("_n") > 0, planted).otherwise(F.col("text")).alias("text"))
