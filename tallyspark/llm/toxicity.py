"""Toxicity by a weighted lexicon, matched with Aho-Corasick.

Words are folded first: A-Z to a-z, homoglyphs of other scripts to Latin
letters, digits and signs that stand for letters back to them. The lexicon
holds whole words and beginnings of words, each weighted by the log odds of
its document frequency in toxic against other training rows; an automaton
finds them in each distinct word, anchored at the word's beginning. A match
counts nothing inside an exception phrase: a pair of neighbouring words that
holds a match but occurs in harmless training rows only. A logistic function
of the summed weight and of the weight per word, so normalised by length,
gives the score.

Null and empty texts have no match and get the score of a text without any.
Without toxic training rows the lexicon is empty and every score is 0; labels
other than 0 and 1 and null labels are left out. An empty table gives no rows,
repeated rows each get a score. Extra columns are kept out of scored()'s
result and pass through accepted() under any name. A very long text is read
whole, in memory of some fifteen times its size; other texts share portions
of four megabytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.tables import saved
from tallyspark.llm.words import Words, freed, portions, split

THRESHOLD = 0.3
#: Word bytes: a-z after folding A-Z, digits, the signs $ and @, everything beyond ASCII.
SIGNED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b in b"$@" else 32 for b in range(256))
#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = "аa вb еe кk мm нh оo рp сc тt уy хx іi јj ѕs ԁd ɡg ӏl αa βb εe ηn ιi κk νv οo ρp τt υu χx ѡw ｅe ａa ｉi ｏo ｓs ｔt"
#: Digits and signs that stand for letters.
SUBSTITUTES = "0o 1i 3e 4a 5s 7t 8b @a $s"
_GLYPHS = {ord(p[0]): p[1] for p in HOMOGLYPHS.split()}
_SIGNS = {ord(p[0]): p[1] for p in SUBSTITUTES.split()}
PREFIXES = range(4, 9)


def folded(word: bytes) -> str:
    """The word with homoglyphs and, where it has letters too, digits and signs folded."""
    text = word.decode("utf-8", "replace")
    if not word.isascii():
        text = text.lower().translate(_GLYPHS)
    text = text.strip("$@")
    return text if text.isalpha() or not any(c.isalpha() for c in text) else text.translate(_SIGNS)


@dataclass
class Lexicon:
    """Terms are " word " for whole words and " begin" for beginnings of words."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    #: intercept, weight of log(1 + sum), weight of sum per word.
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        a = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            a.add_word(term, weight)
        if not self.weights:
            return None
        a.make_automaton()
        return a


class Matcher:
    """Weights of distinct words, kept from batch to batch up to a number of words."""

    KEEP = 150_000

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.automaton, self.known = lexicon, lexicon.automaton(), {}

    def weight(self, word: bytes) -> float:
        w = self.known.get(word)
        if w is None:
            if len(self.known) > self.KEEP:
                self.known.clear()
            w = 0.0 if self.automaton is None else max((x for _, x in self.automaton.iter(f" {folded(word)} ")), default=0.0)
            self.known[word] = w
        return w

    def sums(self, words: Words) -> tuple[np.ndarray, list[tuple[int, str]]]:
        """The summed weight of each document and (document, pair of words) around each match."""
        each = np.fromiter(map(self.weight, words.vocab), np.float64, len(words.vocab))[words.codes]
        pairs = []
        for p in np.flatnonzero(each).tolist():
            i = int(np.searchsorted(words.starts, p, side="right")) - 1
            around = range(max(p - 1, int(words.starts[i])), min(p + 2, int(words.starts[i + 1])))
            text = [folded(words.vocab[words.codes[q]]) for q in around]
            own = [" ".join(text[j : j + 2]) for j in range(len(text) - 1)]
            pairs += [(i, x) for x in own]
            if any(x in self.lexicon.exceptions for x in own):
                each[p] = 0.0
        run = np.concatenate([[0.0], np.cumsum(each)])
        return run[words.starts[1:]] - run[words.starts[:-1]], pairs


def features(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(total), total / (n + 1.0) * 10], axis=1)


def _terms(word: str) -> list[str]:
    if not any(c.isalpha() for c in word):
        return []
    return [f" {word[:n]}" for n in PREFIXES if len(word) >= n] if len(word) > PREFIXES[0] else [f" {word} "]


def sampled(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> DataFrame:
    """(text, label) of about max_rows labelled rows of either label, by a hash of doc_id.

    The lexicon is learnt from this bounded sample of the labelled rows, not
    from more; as it is bounded, the labels are broadcast to the documents.
    """
    labels = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label"))
    known = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = {k: min(1.0, max_rows / n) for k, n in known.items()}
    some = labels.filter(unit < F.when(F.col("label") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    return docs.join(F.broadcast(some), "doc_id").select(F.col("text").cast("binary").alias("text"), "label", F.when(F.col("label") == 1, 1 / share.get(1, 1.0)).otherwise(1 / share.get(0, 1.0)).alias("weight"))


def fit(rows: DataFrame, max_terms: int = 2000, least: int = 4, odds: float = 3.0) -> Lexicon:
    """A lexicon from sampled rows (text, label, weight).

    least is the least number of toxic rows a term occurs in, odds the least
    log odds, max_terms bounds the lexicon.
    """
    sample = saved(rows.filter(F.col("text").isNotNull()).select("text", "label", "weight"), "toxicity-sample")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return Lexicon()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            words = split(batch.column("text"), SIGNED)
            terms = [_terms(folded(w)) for w in words.vocab]
            label = batch.column("label").to_pylist()
            seen: dict[str, list[int]] = {}
            for i in range(batch.num_rows):
                for t in {t for c in np.unique(words.codes[words.starts[i] : words.starts[i + 1]]) for t in terms[c]}:
                    seen.setdefault(t, [0, 0])[label[i]] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (1, 0))], ["term", "toxic", "clean"])

    found = sample.mapInArrow(freed(count), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    top = found.filter(F.col("toxic") >= least).withColumn("odds", ratio).filter(F.col("odds") >= odds).orderBy(F.desc(F.col("odds") * F.log("toxic")), "term").limit(10 * max_terms).collect()
    weights = chosen({r["term"]: (r["toxic"], float(r["odds"])) for r in top}, max_terms)
    lexicon = Lexicon(weights)
    plain = sample.sparkSession.sparkContext.broadcast(lexicon)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(plain.value)
        for batch in portions(batches, "text"):
            label, out = batch.column("label").to_pylist(), {}
            for i, pair in set(matcher.sums(split(batch.column("text"), SIGNED))[1]):
                out.setdefault(pair, [0, 0])[label[i]] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), *(pa.array([v[k] for v in out.values()], pa.int64()) for k in (1, 0))], ["pair", "toxic", "clean"])

    near = sample.mapInArrow(freed(pairs), "pair string, toxic long, clean long").groupBy("pair").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    harmless = near.filter((F.col("toxic") == 0) & (F.col("clean") >= least)).orderBy(F.desc("clean"), "pair").limit(max_terms).collect()
    lexicon = Lexicon(weights, frozenset(r["pair"] for r in harmless))
    whole = sample.sparkSession.sparkContext.broadcast(lexicon)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, total, n in _sums(batches, whole.value, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("weight"), pa.array(total), pa.array(n)], ["label", "weight", "total", "n"])

    points = sample.mapInArrow(freed(sums), "label int, weight double, total double, n long").toArrow()
    x = features(np.asarray(points.column("total").combine_chunks()), np.asarray(points.column("n").combine_chunks()))
    y = np.asarray(points.column("label").combine_chunks()).astype(float)
    lexicon.curve = tuple(_logistic(x, y, np.asarray(points.column("weight").combine_chunks())))
    return lexicon


def chosen(found: dict[str, tuple[int, float]], max_terms: int, gain: float = 1.2) -> dict[str, float]:
    """Weights of the terms to keep. A beginning of words is kept where it occurs in clearly more
    toxic rows than any longer one that begins with it, and then stands for those."""
    longer: dict[str, int] = {}
    for term, (toxic, _) in found.items():
        for n in range(2, len(term)):
            longer[term[:n]] = max(longer.get(term[:n], 0), toxic)
    weights: dict[str, float] = {}
    for term in sorted(found, key=lambda t: (len(t), t)):
        toxic, odds = found[term]
        if len(weights) < max_terms and toxic >= gain * longer.get(term, 0) and not any(term[:n] in weights for n in range(2, len(term))):
            weights[term] = odds
    return weights


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a ridge; weights are rows' multiplicities."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sums(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Portions of the rows with the summed weight and the number of words of each text."""
    matcher = Matcher(lexicon)
    for batch in portions(batches, text):
        words = split(batch.column(text), SIGNED)
        yield batch, matcher.sums(words)[0], words.counts


def _scores(lexicon: Lexicon, total: np.ndarray, n: np.ndarray) -> np.ndarray:
    if not lexicon.weights:
        return np.zeros(len(total))
    return 1 / (1 + np.exp(-np.clip(features(total, n) @ np.array(lexicon.curve), -700, 700)))


def scored(docs: DataFrame, lexicon: Lexicon, keep: list[str] | None = None) -> DataFrame:
    """The columns keep (doc_id) and score, 0 to 1."""
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, total, n in _sums(batches, shared.value, "_text"):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(_scores(shared.value, total, n))], [*keep, "score"])

    return docs.select(*keep, F.col("text").cast("binary").alias("_text")).mapInArrow(freed(score), f"{kinds}, score double")


def accepted(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The documents, all columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, total, n in _sums(batches, shared.value, "text"):
            yield batch.filter(pa.array(_scores(shared.value, total, n) < THRESHOLD))

    return docs.mapInArrow(freed(accept), docs.schema)
