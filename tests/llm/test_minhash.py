import random

import numpy as np

from tallyspark.llm import minhash, queries
from tallyspark.llm.jaccard_join import shingle_sets
from tests.llm.brute import linked_sets

import pyarrow as pa


def near_copies(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"n{rng.randrange(10**6)}"
    return " ".join(out)


def corpus():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = [(100, None), (101, ""), (102, " \n"), (103, "Alone"), (104, "alone"), (105, "a b"), (106, "a b c"), (107, "A  b\tc"), (108, "a b c d e"), (109, "a b c d e f")]
    for k in range(40):
        base = [word() for _ in range(rng.choice([6, 30, 120]))]
        rows += [(1000 + 20 * k + j, near_copies(rng, base, rng.randrange(0, 1 + len(base) // 12))) for j in range(rng.randrange(1, 9))]
    passage = [word() for _ in range(80)]  # many share more than half, and don't link
    rows += [(5000 + k, " ".join(passage + [f"own{k}x{i}" for i in range(30)])) for k in range(70)]
    copied = [word() for _ in range(60)]
    rows += [(7000 + k, near_copies(rng, copied, 1)) for k in range(60)] + [(8000 + k, " ".join(copied)) for k in range(30)]
    rows += [(1000, "another text under a known id, of its own words"), (None, " ".join(copied)), (None, "no id here " * 9), (None, "no id here " * 9)]
    rng.shuffle(rows)
    return rows


def test_components_are_those_of_brute_force(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n_shingles int, kept string").repartition(5)
    want = sorted((d is None, d or 0, n, c is None, c or 0) for d, n, c in linked_sets(rows, minhash.N, minhash.PERCENT))

    def check():
        got = minhash.clustered(docs).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"] is None, r["component_id"] or 0) for r in got) == want
        assert all(r["kept"] == (r["component_id"] is None or r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)

    check()
    # small blocks: larger buckets go through the blocks, hubs through their copies
    monkeypatch.setattr(minhash, "FEW", 4)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "HUBS", 20)
    check()


def test_signatures_estimate_the_similarity():
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), near_copies(rng, base, 20), near_copies(rng, base, 150), "other words only here and there"]
    sets = shingle_sets(pa.array(texts), 2)
    bands, low = minhash.signatures(sets)
    assert bands.shape == (4, minhash.BANDS) and low.shape == (4, minhash.MINIMA)
    for i in (1, 2, 3):
        common = len(np.intersect1d(sets[0], sets[i]))
        assert abs((low[0] == low[i]).mean() - common / (len(sets[0]) + len(sets[i]) - common)) < 0.12
    alive, equal = minhash.surviving(low[[0, 0, 0]], low[[1, 2, 3]], minhash.looks())
    assert alive.tolist() == [0] and equal[0] == (low[0] == low[1]).sum()


def test_fewest_matches_leave_the_chosen_chance():
    for miss in (1e-9, 1e-3, 0.1):
        for n in (48, 336):
            m = minhash.fewest(n, miss)
            draws = np.random.default_rng(6).beta(m + 1, n - m + 1, 400_000)
            over = (draws >= 0.8).mean()
            assert over >= miss * 0.8 - 5e-6
            below = np.random.default_rng(7).beta(m, n - m + 2, 400_000)
            assert (below >= 0.8).mean() <= miss * 1.2 + 5e-6


def test_empty_table(spark):
    assert minhash.clustered(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_very_long_text(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    rows = [(3, " ".join(base)), (2, near_copies(rng, base, 6000)), (5, "short text beside them")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.clustered(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: 2, 3: 2, 5: 5}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op12_minhash(spark, sf).collect())
    assert got == sorted(linked_sets(rows, 2, 80))
