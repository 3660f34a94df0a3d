"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order. A word is coded
byte by byte: the symbol's count in the longest known context gives its
probability, and where it was never seen there, the escape probability of
that context is charged and the next shorter context is asked (method C:
escape = distinct symbols / (total + distinct symbols); below order 0 all
256 bytes are alike). Contexts begin at the space before the word, so the
code length of a text is the sum over its words, under statistics that are
frozen after fitting.

Nulls: a null text, an empty text and one without any letter get ``und``
with score 0. Rows without a language teach nothing. Without any training
row every prediction is ``und``, and an empty table gives no rows. Repeated
rows each get their own result. Extra columns are kept out of predict()'s
result and pass through identified() under any name. A very long text is read
whole, in memory of some fifteen times its size; other texts share portions
of four megabytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.words import freed, portions, split

ORDER = 4
UNDETERMINED = "und"
#: Words of letters: a-z after folding A-Z, and everything beyond ASCII.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Above so many known words (of four languages) a worker forgets their code lengths and starts anew.
CACHE_WORDS = 200_000
#: Languages that share one table of n-grams, so that the model grows with their number and not its square.
GROUP = 4
#: Words whose code lengths are found at once, which bounds memory.
TOGETHER = 20_000


def _positions(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each coded byte of the words (each with its closing space): the word's
    number, how long a context it has, and the n-gram keys for orders 0 to ORDER."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    at = np.arange(1, len(data))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    word = np.repeat(np.arange(len(words)), lengths)
    begin = np.cumsum(lengths) - lengths
    room = at - begin[word]
    wide = np.concatenate([np.zeros(ORDER, np.int64), data.astype(np.int64)])
    keys, key = [], np.zeros(len(at), np.int64)
    for k in range(ORDER + 1):
        key = key + (wide[at + ORDER - k] << (8 * k))
        keys.append(key)
    return word, room, keys


@dataclass
class ByteTrees:
    """Frozen statistics: per order the n-grams with their code lengths in bits,
    and the contexts with their escapes in bits; one column for each language."""

    languages: list[str]
    grams: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def _coded(self, keys: list[np.ndarray], room: np.ndarray, top: int, total: np.ndarray, todo: np.ndarray) -> None:
        for k in range(top, -1, -1):
            if len(todo) and len(self.grams[k]):
                now = todo[room[todo] >= k] if k else todo
                at = np.minimum(np.searchsorted(self.grams[k], keys[k][now]), len(self.grams[k]) - 1)
                hit = self.grams[k][at] == keys[k][now]
                total[now[hit]] += self.bits[k][at[hit]]
                miss = now[~hit]
                context = keys[k][miss] >> 8
                at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
                known = self.contexts[k][at] == context
                total[miss[known]] += self.escapes[k][at[known]]
                done = np.zeros(len(total), bool)
                done[now[hit]] = True
                todo = todo[~done[todo]]
        total[todo] += 8.0

    def code_lengths(self, words: list[bytes]) -> np.ndarray:
        """Bits of each word (with its closing space) in each language."""
        out = np.zeros((len(words), len(self.languages)))
        if not words:
            return out
        word, room, keys = _positions(words)
        total = np.zeros((len(word), len(self.languages)), np.float32)
        self._coded(keys, room, ORDER, total, np.arange(len(word)))
        ends = np.flatnonzero(np.diff(word, append=-1))
        sums = np.cumsum(total, axis=0, dtype=np.float64)[ends]
        return np.diff(sums, axis=0, prepend=0)


def trees(languages: list[str], rows: list[tuple[int, ...]] | np.ndarray) -> ByteTrees:
    """Trees from (language number, order, n-gram key, count) or, where not all n-grams are given,
    those with the total and the distinct symbols of the whole context behind them."""
    table = np.asarray(rows, dtype=np.int64)
    table = table.reshape(-1, table.shape[1] if table.ndim == 2 else 4)
    model = ByteTrees(languages, [], [], [], [])
    for k in range(ORDER + 1):
        lang, _, key, n, *whole = table[table[:, 1] == k].T
        grams, at = np.unique(key, return_inverse=True)
        count = np.zeros((len(grams), len(languages)))
        np.add.at(count, (at, lang), n)
        contexts, of = np.unique(grams >> 8, return_inverse=True)
        total = np.zeros((len(contexts), len(languages)))
        kinds = np.zeros_like(total)
        if whole:
            total[of[at], lang], kinds[of[at], lang] = whole
        else:
            np.add.at(total, of, count)
            np.add.at(kinds, of, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escapes = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            seen = -np.log2(count / (total + kinds)[of])
        lower = np.zeros_like(count, dtype=np.float32)
        if len(grams):
            keys = [grams & ((1 << (8 * (j + 1))) - 1) for j in range(k + 1)]
            model._coded(keys, np.full(len(grams), k), k - 1, lower, np.arange(len(grams)))
        model.grams.append(grams)
        model.bits.append(np.where(count > 0, seen, escapes[of] + lower).astype(np.float32))
        model.contexts.append(contexts)
        model.escapes.append(escapes.astype(np.float32))
    return model


@dataclass
class Forest:
    """Trees of groups of languages."""

    languages: list[str]
    groups: list[ByteTrees]

    def code_lengths(self, words: list[bytes]) -> np.ndarray:
        """Bits of each word (with its closing space) in each language."""
        return np.concatenate([g.code_lengths(words) for g in self.groups], axis=1)


def fit(rows: DataFrame, max_documents: int = 600, max_grams: int = 100_000) -> Forest | None:
    """Trees of every language among the labelled rows (doc_id, text, lang).

    They are learnt from a bounded sample of the labelled rows: about
    max_documents a language, by a hash of doc_id. Each language keeps its own
    most frequent max_grams n-grams, which bounds what is broadcast by the
    number of languages; escapes are those of the contexts before that.
    """
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    known = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(known)
    if not languages:
        return None
    number = {x: i for i, x in enumerate(languages)}
    share = rows.sparkSession.createDataFrame([(x, min(1.0, max_documents / known[x])) for x in languages], "lang string, _share double")
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(share), "lang").filter(unit < F.col("_share")).select("doc_id", "text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            langs = np.array([number[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            words = split(batch.column("text"), LETTERS)
            pair, n = np.unique(np.repeat(langs, words.counts) * len(words.vocab) + words.codes, return_counts=True)
            if not len(pair):
                continue
            word, room, keys = _positions([words.vocab[c] for c in pair % len(words.vocab)])
            lang = (pair // len(words.vocab))[word]
            for k in range(ORDER + 1):
                fits = room >= k
                both, at = np.unique(np.stack([lang[fits], keys[k][fits]]), axis=1, return_inverse=True)
                total = np.bincount(at.ravel(), weights=n[word][fits]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(np.full(len(total), k)), pa.array(both[1]), pa.array(total)], ["lang", "order", "gram", "n"])

    grams = sample.mapInArrow(freed(count), "lang long, order long, gram long, n long").groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))
    context = Window.partitionBy("lang", "order", F.shiftright("gram", 8))
    grams = grams.select("*", F.sum("n").over(context).alias("total"), F.count("n").over(context).alias("kinds"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "order", "gram"))
    kept = grams.withColumn("_rank", rank).filter(F.col("_rank") <= max_grams).drop("_rank").toArrow()
    table = np.stack([kept.column(c).to_numpy() for c in ("lang", "order", "gram", "n", "total", "kinds")], axis=1)
    groups = []
    for first in range(0, len(languages), GROUP):
        own = table[(table[:, 0] >= first) & (table[:, 0] < first + GROUP)]
        own[:, 0] -= first
        groups.append(trees(languages[first : first + GROUP], own))
    return Forest(languages, groups)


def has_letter(word: bytes) -> bool:
    return word.isascii() or any(c.isalpha() for c in word.decode("utf-8", "replace"))


def _told(batches: Iterator[pa.RecordBatch], column: str, model: Forest) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Portions of the rows with the number of each text's language (that of the languages for
    none) and its score."""
    count = len(model.languages)
    cache: dict[bytes, int] = {}
    bits, letter = np.zeros((0, count)), np.zeros(0, bool)
    for batch in portions(batches, column):
        words = split(batch.column(column), LETTERS)
        if len(cache) * count > CACHE_WORDS * 4:
            cache, bits, letter = {}, bits[:0], letter[:0]
        new = [w for w in words.vocab if w not in cache]
        if new:
            cache.update(zip(new, range(len(cache), len(cache) + len(new)), strict=True))
            bits = np.concatenate([bits, *(model.code_lengths(new[i : i + TOGETHER]) for i in range(0, len(new), TOGETHER))])
            letter = np.concatenate([letter, np.fromiter(map(has_letter, new), bool, len(new))])
        at = np.fromiter((cache[w] for w in words.vocab), np.int64, len(words.vocab))
        each, any_letter = bits[at], letter[at]
        total = np.zeros((len(words.counts), count))
        for j in range(count):
            run = np.concatenate([[0.0], np.cumsum(each[words.codes, j])])
            total[:, j] = run[words.starts[1:]] - run[words.starts[:-1]]
        lettered = np.concatenate([[0], np.cumsum(any_letter[words.codes])])
        lettered = lettered[words.starts[1:]] > lettered[words.starts[:-1]]
        spread = (total - total.min(axis=1, keepdims=True)) / np.sqrt(np.maximum(words.counts, 1))[:, None]
        share = 1 / np.exp2(-spread).sum(axis=1)
        yield batch, np.where(lettered, total.argmin(axis=1), count), np.where(lettered, share, 0.0)


def predict(docs: DataFrame, model: Forest | None, keep: list[str] | None = None) -> DataFrame:
    """The columns keep (doc_id), lang_pred and score: the share of the best language when
    each language counts as two to the power of minus its bits over the root of the words."""
    keep = keep or ["doc_id"]
    if model is None:
        return docs.select(*keep, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    frozen = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, F.col("text").cast("binary").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + ", lang_pred string, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*frozen.value.languages, UNDETERMINED], dtype=object)
        for batch, best, share in _told(batches, "_text", frozen.value):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names[best], pa.string()), pa.array(share)], [*keep, "lang_pred", "score"])

    return source.mapInArrow(freed(score), schema)


def identified(docs: DataFrame, model: Forest | None) -> DataFrame:
    """The documents, all columns, whose language can be told; those that get ``und`` go.

    Without a model no language can be told, and only null texts and those without letters go."""
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    frozen = docs.sparkSession.sparkContext.broadcast(model)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, best, _ in _told(batches, "text", frozen.value):
            yield batch.filter(pa.array(best < len(frozen.value.languages)))

    return docs.mapInArrow(freed(told), docs.schema)
