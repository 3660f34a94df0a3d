import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tallyspark.llm import periodic, queries
from tests.llm.brute import SPACED, periodic_runs


def words_of_random(rng):
    out = []
    for _ in range(rng.randrange(1, 6)):
        unit = [rng.choice("abc") for _ in range(rng.randrange(1, 7))]
        out += unit * rng.randrange(1, 8) + unit[: rng.randrange(len(unit) + 1)]
    return out


def test_automaton_finds_the_runs_of_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        words = words_of_random(rng)
        codes = [ord(w) for w in words]
        for exponent, shortest in ((4, 6), (2, 2), (3, 4)):
            assert periodic.runs(codes, exponent, shortest) == periodic_runs(words, exponent, shortest), words


def test_large_sets_are_split_into_parts():
    n = 5000
    assert periodic.runs([7] * n) == [(0, n, 1)]
    assert periodic.runs([1, 2, 3] * n) == [(0, 3 * n, 3)]
    held = periodic.Positions(0)
    rng = random.Random(2)
    numbers = rng.sample(range(1, 100_000), 6000)
    known = [0]
    for x in numbers:
        before, after = held.add(x)
        i = np.searchsorted(known, x)
        assert (before, after) == (known[i - 1] if i else None, known[i] if i < len(known) else None)
        known.insert(int(i), x)
    assert list(held) == sorted([0, *numbers])


def test_stretches_lose_no_run(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(120):
        plain = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(60))]
        texts.append(" ".join(plain[:20] + words_of_random(rng) + plain[20:] + words_of_random(rng)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic.detected(docs).collect()}
    assert got == {i: periodic_runs(t.split()) for i, t in enumerate(texts)}
    assert any(got.values())
    loose = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic.detected(docs.filter("doc_id < 20"), 2, 4).collect()}
    assert loose == {i: periodic_runs(t.split(), 2, 4) for i, t in enumerate(texts[:20])}


def collapsed(words, runs):
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_cases_of_rows(spark):
    rows = [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "go go go go go go"),
        (5, "go go go go go"),
        (6, "A a A a A a A a x"),
        (7, "x y " * 9),
        (8, "a b a b a b a b c c c c c c a b a b a b a b"),
        (8, "a b a b a b a b c c c c c c a b a b a b a b"),
        (None, "é é é é é é é"),
        (9, "one two three " * 40_000),
    ]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, runs int, _text int, n_words int").repartition(2)
    out = sorted(periodic.detected(docs).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert len(out) == len(rows)
    for got, (doc, text) in zip(out, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        words = SPACED.findall(text or "")
        runs = periodic_runs(words) if doc != 9 else [(0, 120_000, 3)]
        assert (got["doc_id"], got["n_words"], [tuple(x) for x in got["runs"]]) == (doc, len(words), runs)
        assert got["collapsed"] == collapsed(words, runs)
    assert periodic.detected(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic.detected(docs, exponent=1)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r for r in queries.op13_periodic(spark, sf).collect()}
    assert got.keys() == texts.keys()
    planted = 0
    for doc, text in texts.items():
        words = re.findall(SPACED, text or "")
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            planted += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = periodic_runs(words) if n < 3000 else periodic.runs([hash(w) for w in words])
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        r = got[doc]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *top)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert planted and any(r["n_runs"] for r in got.values())
