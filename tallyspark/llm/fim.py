"""Fill-in-the-middle rewriting over a run-length encoding of character classes.

A text is stored as its maximal runs of one character class (white space or not), each with
the cumulative number of units up to its end. A unit is a token (the white space before a
word and the word; white space at the end of the text is one of its own) or a character. A
cut after k units lies in the first run whose cumulative count reaches k, which a binary
search finds; as all units of a run have the same width, its offset is

    begin of the run + (k - units before the run) * (characters of the run / units of the run)

The first cut ends the prefix, the second the middle, the rest is the suffix. A text that is
empty or holds one of the markers stays plain, so that every output can be read back.

Defined cases: a null text is empty. A null doc_id is hashed as the empty string. Rows that
repeat each other give the same output. A text of any length is one row and is worked on
with a few arrays of its size; others are taken some megabytes at a time. An empty table
gives no rows. Only doc_id and text are read: other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.words import freed, portions, translated

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
SEED = 42
#: Of a hundred texts so many are rewritten, and of a hundred of those so many with the suffix first.
RATE, SPM_RATE = 50, 80
UNITS = ("token", "character")

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


class Runs:
    """The class runs of all texts of a batch: run r is the bytes begin[r] to end[r], and units[r]
    counts the units of all runs up to and with it. Runs never reach over the end of a text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str):
        space = _SPACE[data]
        change = np.zeros(len(data) + 1, bool)
        change[1:-1] = space[1:] != space[:-1]
        change[offsets[offsets < len(data)]] = True
        change[-1] = False
        self.begin = np.flatnonzero(change)
        self.end = np.append(self.begin[1:], len(data)) if len(self.begin) else self.begin
        #: characters before each byte; bytes 10xxxxxx continue one
        self.chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        if unit == "token":
            own = ~space[self.begin]
            own |= np.isin(self.end, offsets)  # white space at the end of a text
            own = own.astype(np.int64)
        else:
            own = self.chars[self.end] - self.chars[self.begin]
        self.own, self.units = own, np.cumsum(own)
        first = np.searchsorted(self.begin, offsets)
        self.before = np.concatenate([[0], self.units])[first]

    @property
    def counts(self) -> np.ndarray:
        """Units of each text."""
        return np.diff(self.before)

    def places(self, cuts: np.ndarray) -> np.ndarray:
        """Characters from the start of the batch to the cut after cuts[i] units of text i."""
        target = self.before[:-1] + cuts
        run = np.minimum(np.searchsorted(self.units, target), max(len(self.units) - 1, 0))
        if not len(self.units):
            return np.zeros(len(cuts), np.int64)
        width = (self.chars[self.end[run]] - self.chars[self.begin[run]]) // np.maximum(self.own[run], 1)
        return self.chars[self.begin[run]] + (target - (self.units[run] - self.own[run])) * width


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four unsigned numbers of 32 bits that depend on the seed and the document's id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, unit: str = "token") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): n units, form plain, psm or spm."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), *[h.alias(f"_h{i}") for i, h in enumerate(draws(seed, F.col("doc_id")), 1)])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "_text"):
            texts = translated(batch.column("_text"), None)
            offsets = np.frombuffer(texts.buffers()[1], np.int64)
            data = np.frombuffer(texts.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
            h1, h2, h3, h4 = (batch.column(f"_h{i}").to_numpy(zero_copy_only=False) for i in range(1, 5))
            runs = Runs(data, offsets, unit)
            n = runs.counts
            cut = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
            start = runs.chars[offsets[:-1]]
            one, two = (runs.places(c) - start for c in cut)
            one, two = np.where(cut[0] == 0, 0, one), np.where(cut[1] == 0, 0, two)
            form, prefix, middle, output = [], [], [], []
            for i, text in enumerate(batch.column("_text").to_pylist()):
                if not text or h3[i] % 100 >= rate or any(m in text for m in MARKERS):
                    form.append("plain")
                    prefix.append(None)
                    middle.append(None)
                    output.append(text)
                    continue
                a, b = int(one[i]), int(two[i])
                spm = h4[i] % 100 < spm_rate
                form.append("spm" if spm else "psm")
                prefix.append(a)
                middle.append(b - a)
                first = SUFFIX + text[b:] + PREFIX + text[:a] if spm else PREFIX + text[:a] + SUFFIX + text[b:]
                output.append(first + MIDDLE + text[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(freed(rewrite), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text again, from the output and its form alone. Each marker stands once in a rewritten
    output: no text holds one, and none can arise at a seam, as a marker begins nowhere within another."""
    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(output, right, 1), left, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
