"""Benchmark decontamination: a broadcast hash set of the benchmark's n-grams.

Words are runs of a-z (A-Z folded), digits and characters beyond ASCII. The
windows of n words of every benchmark item (an item with fewer, but not none,
is one window) are hashed and broadcast; every token window of every document
is looked up, hits are verified word by word, and the words inside verified
windows are marked. From the marks come spans to cut or documents to drop.

The windows go to the executors in blocks of a fixed number of them, each
with a job of its own whose result is a table before the next block is
collected, so driver and workers hold one block at a time whatever the size
of the benchmark.

Null or empty texts have no words and are never contaminated; items without
words or id are left out; repeated items and documents count each for itself
(items by their id). An empty benchmark hits nothing, an empty table gives no
rows. Extra columns pass through without_contaminated() and without_spans()
under any name. A very long text is read whole, in memory of some twenty
times its size; other texts share portions of four megabytes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.tables import saved
from tallyspark.llm.words import ALNUM, freed, hashes, portions, split, windows

N = 13
#: Windows broadcast at once, of at most N words each.
BLOCK_WINDOWS = 200_000
FILTER_BITS = 20
#: Benchmark text read at once, and windows given out at once.
ITEM_BYTES, ITEM_ROWS = 1 << 20, 50_000


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(item_id string, window binary, width int): the distinct windows of each item."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["item_id", "window", "width"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", ITEM_BYTES):
            words = split(batch.column("text"), ALNUM)
            rows = []
            for i, item in enumerate(batch.column("item_id").to_pylist()):
                own = [words.vocab[c] for c in words.codes[words.starts[i] : words.starts[i + 1]]]
                width = min(n, len(own))
                for j in range(len(own) - width + 1) if width else ():
                    rows.append((item, b" ".join(own[j : j + width]), width))
                    if len(rows) >= ITEM_ROWS:  # a very long item
                        yield table(rows)
                        rows = []
            if rows:
                yield table(rows)

    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    return items.mapInArrow(freed(cut), "item_id string, window binary, width long").distinct()


class WindowSet:
    """The windows of a block: sorted hashes by width, texts for the check, items by window."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        self.items: dict[bytes, list[str]] = defaultdict(list)
        for item, window in rows:
            self.items[window].append(item)
        texts = list(self.items)
        words = split(pa.array(texts, pa.large_binary()), None)
        h = hashes(words.vocab)[words.codes]
        self.by_width: dict[int, np.ndarray] = {}
        for width in np.unique(words.counts):
            of = np.flatnonzero(words.counts == width)
            at = words.starts[of][:, None] + np.arange(width)
            self.by_width[int(width)] = np.unique(windows(h[at].ravel(), int(width))[:: int(width)])
        self.filters = {}
        for width, known in self.by_width.items():
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[(known >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.filters[width] = bits

    def hits(self, words, h: np.ndarray) -> list[tuple[int, int, int, list[str]]]:
        """(document, first word, width, items) of every verified window of a batch."""
        out = []
        flat = h[words.codes]
        ends = words.starts[1:]
        for width, known in self.by_width.items():
            runs = windows(flat, width)
            maybe = np.flatnonzero(self.filters[width][(runs >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            if not len(maybe):
                continue
            at = np.minimum(np.searchsorted(known, runs[maybe]), len(known) - 1)
            maybe = maybe[known[at] == runs[maybe]]
            doc = np.searchsorted(ends, maybe, side="right")
            inside = maybe + width <= ends[doc]
            for i, p in zip(doc[inside].tolist(), maybe[inside].tolist(), strict=True):
                items = self.items.get(b" ".join([words.vocab[c] for c in words.codes[p : p + width]]))
                if items:
                    out.append((i, p - int(words.starts[i]), width, items))
        return out


def _marked(docs: DataFrame, benchmark: DataFrame, keep: list[str], n: int = N, with_text: bool = True) -> DataFrame:
    """The columns keep, text if wanted, n_words, spans and items of every document, as in scanned()."""
    spark = docs.sparkSession
    grams = saved(benchmark_windows(benchmark, n), "benchmark-windows")
    blocks = max(1, -(-grams.count() // BLOCK_WINDOWS))
    spans_type, items_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())
    # by place, so that columns of any name pass
    out = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)], F.col("text").alias("text"))
    types = {f.name: f.dataType.simpleString() for f in out.schema}
    for b in range(blocks):
        carried = [c for c in types if with_text or b + 1 < blocks or c != "text"]
        kinds = ", ".join(f"{c} {types[c]}" for c in carried)
        rows = grams.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b).select("item_id", "window").toArrow()
        shared = spark.sparkContext.broadcast(WindowSet(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True))))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, carried=carried) -> Iterator[pa.RecordBatch]:
            for batch in portions(batches, "text"):
                words = split(batch.column("text"), ALNUM)
                spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
                items: dict[int, set[str]] = defaultdict(set)
                if "spans" in batch.schema.names:  # what earlier blocks found
                    for i, (s, x) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                        if s:
                            spans[i], items[i] = [(y["first"], y["end"]) for y in s], set(x)
                for i, first, width, of in shared.value.hits(words, hashes(words.vocab)):
                    spans[i].append((first, first + width))
                    items[i].update(of)
                size = range(batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in carried),
                        pa.array(words.counts),
                        pa.array([[{"first": a, "end": z} for a, z in merged(spans[i])] if i in spans else [] for i in size], spans_type),
                        pa.array([sorted(items[i]) if i in items else [] for i in size], items_type),
                    ],
                    [*carried, "n_words", "spans", "items"],
                )

        out = out.mapInArrow(freed(scan), f"{kinds}, n_words long, spans array<struct<first:long,end:long>>, items array<string>")
        if b + 1 < blocks:
            out = saved(out, "decontaminate")
            shared.destroy()
    return out


def scanned(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", n: int = N) -> DataFrame:
    """(key, n_words, spans, items) of every document: spans are array<struct<first, end>> of
    verified windows, merged, items the sorted ids of the items they belong to."""
    return _marked(docs, benchmark, [key], n, with_text=False).select(F.col("c0").alias(key), "n_words", "spans", "items")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def hit_words():
    """Words inside any span."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["first"])


def contaminated():
    """The contract's rule: a twentieth of the words or more are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that are not contaminated."""
    marked = _marked(docs, benchmark, [c for c in docs.columns if c != "text"]).withColumn("n_hit", hit_words())
    return _named(marked.filter(~contaminated()), docs.columns, F.col("text"))


def _named(marked: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns of the documents in their order, with this text."""
    places = {c: k for k, c in enumerate(c for c in columns if c != "text")}
    return marked.select(*[text.alias(c) if c == "text" else F.col(f"c{places[c]}").alias(c) for c in columns])


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what lies between them."""
    flat = text.translate(ALNUM)
    starts = [i for i in range(len(flat)) if flat[i] != 32 and (i == 0 or flat[i - 1] == 32)]
    ends = [i + 1 for i in range(len(flat)) if flat[i] != 32 and (i + 1 == len(flat) or flat[i + 1] == 32)]
    out, at = [], 0
    for a, z in spans:
        out.append(text[at : starts[a]])
        at = ends[z - 1]
    return b"".join([*out, text[at:]])


def without_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with the hit passages cut from their texts."""
    marked = _marked(docs, benchmark, [c for c in docs.columns if c != "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            spans = [[(s["first"], s["end"]) for s in own] for own in batch.column("spans").to_pylist()]
            texts = [cut_spans(t.encode(), own).decode("utf-8", "ignore") for t, own in zip(batch.column("text").to_pylist(), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in kept], kept)

    # only texts with a hit go to Python once more
    kept = [c for c in marked.columns if c not in ("n_words", "spans", "items")]
    hit, clean = marked.filter(F.size("spans") > 0), marked.filter(F.size("spans") == 0).select(kept)
    both = clean.unionByName(hit.select(*kept, "spans").mapInArrow(freed(cut), clean.schema))
    return _named(both, docs.columns, F.col("text"))
