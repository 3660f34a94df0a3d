import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import jaccard_join, words
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, key string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "en", "k") for i, t in docs], SCHEMA)


def found(spark, docs):
    rows = jaccard_join.clustered(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def mutated(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"m{rng.randrange(10**6)}"
    return " ".join(out)


def test_every_link_as_by_brute_force(spark):
    rng = random.Random(7)
    docs = []
    for g in range(25):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 6, 30, 90]))]
        docs += [mutated(rng, base, rng.randrange(0, 4)) for _ in range(rng.randrange(1, 8))]
    docs += ["only four words here", "Only FOUR words here", "", None, "  \t\n ", "one", "é è", "É è"]
    docs = list(enumerate(docs, 1))
    assert found(spark, docs) == brute.clusters(docs)


def test_region_too_large_for_a_task(spark):
    """Chains of near copies around one text, over SMALL sets in one region."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    docs = [mutated(rng, base, rng.randrange(1, 9)) for _ in range(2 * jaccard_join.SMALL)]
    docs += [" ".join(base)] * 5
    docs = list(enumerate(docs, 10))
    assert found(spark, docs) == brute.clusters(docs)


def test_chain_of_links(spark):
    words = [f"w{i}" for i in range(200)]
    docs = [(k + 1, " ".join(words[4 * k : 4 * k + 80])) for k in range(25)]
    got = found(spark, docs)
    assert got == brute.clusters(docs)
    assert {c for _, c in got.values()} == {1}


def test_the_bound_itself_links(spark):
    """15 of 20 shingles in common is 75 per cent exactly; 14 of 20 is not enough."""
    a = [f"w{i}" for i in range(19)]  # 15 shingles
    b = [*a, *(f"x{i}" for i in range(5))]  # 20 shingles, those 15 among them
    c = [*a, *(f"y{i}" for i in range(6))]  # 21 shingles
    docs = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))]
    assert found(spark, docs) == brute.clusters(docs) == {1: (15, 1), 2: (20, 1), 3: (21, 3)}


def test_null_ids_repeated_rows_and_empty_tables(spark):
    docs = [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, None), (5, "other words that stand alone here")]
    rows = sorted(tuple(r) for r in jaccard_join.clustered(frame(spark, docs)).fillna(-1).collect())
    assert rows == [(-1, 0, -1), (-1, 2, 2), (2, 2, 2), (2, 2, 2), (5, 2, 5)]
    assert jaccard_join.clustered(frame(spark, [])).count() == 0


def test_representatives_keep_all_columns(spark):
    docs = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (None, "x y"), (3, None)]
    kept = jaccard_join.representatives(frame(spark, docs))
    assert kept.columns == ["doc_id", "text", "lang", "key"]
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text) == [(0, "x y"), (1, "a b c d e f g")]
    assert sorted(r.doc_id for r in kept.collect() if not r.text) == [3, 4]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 20, 99])
def test_first_shingles_reach_every_link(n):
    """A linked set shares at least ceil(T n) shingles, so one of the first n - ceil(T n) + 1."""
    need = min(c for c in range(n + 1) if 100 * c >= 75 * n)
    assert jaccard_join.prefix_size(n) == n - need + 1


def test_regions_over_several_tasks(spark, monkeypatch):
    """Chains and loose groups in regions that are divided, with small chunks."""
    monkeypatch.setattr(jaccard_join, "SMALL", 8)
    monkeypatch.setattr(jaccard_join, "CHUNK", 6)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 3)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    docs = [" ".join(words[4 * k : 4 * k + 60]) for k in range(70)]
    for g in range(4):
        base = [f"g{g}x{i}" for i in range(60)]
        docs += [mutated(rng, base, rng.randrange(0, 7)) for _ in range(30)]
    docs = list(enumerate(docs, 1))
    rng.shuffle(docs)
    assert found(spark, docs) == brute.clusters(docs)


def test_rows_that_share_an_id_or_have_none(spark):
    """An id with two texts is two nodes; texts of rows without an id link others."""
    base = [f"w{i}" for i in range(40)]
    near = [" ".join([*base[:39], "x"]), " ".join([*base[1:39], "x"]), " ".join([*base[2:39], "x"])]
    other = " ".join(f"v{i}" for i in range(30))
    docs = [(1, near[0]), (7, other), (7, near[1]), (None, near[2]), (9, " ".join(base[3:39] + ["x"])), (4, None), (4, other)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.clustered(df).collect()}
    assert got[1, 36] == got[7, 35] == got[None, 34] == got[9, 33] == 1
    assert got[7, 26] == got[4, 26] == 4 and got[4, 0] == 4
    kept = sorted((tuple(r) for r in jaccard_join.representatives(df).collect()), key=repr)
    assert kept == sorted([(1, near[0]), (4, other), (None, near[2])], key=repr)


def test_labels_beyond_two_kinds_are_left_out(spark):
    from tallyspark.llm import toxicity

    docs = spark.createDataFrame([(i, "some text") for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, None)], "doc_id long, label int")
    assert sorted(r.label for r in toxicity.sampled(docs, labels).collect()) == [0, 1]


def test_pairs_that_cannot_link_by_size_are_not_made(spark):
    """Texts that share rare shingles, but whose sizes exclude a link, give no candidate pair; the others are made once."""
    rng = random.Random(11)
    texts = [" ".join(["a b c d e"] + [f"x{rng.randrange(10**9)}" for _ in range(4 * 2**k)]) for k in range(6)]
    docs = frame(spark, list(enumerate(texts + texts[:1])))
    found = jaccard_join.cells(docs, np.zeros(0, np.uint64), 4, True)
    assert set(found.columns) == {"a", "b", "cells", "n_a", "n_b"}
    assert all(75 * max(r.n_a, r.n_b) <= 100 * min(r.n_a, r.n_b) for r in found.collect())
    one = frame(spark, [(i, f"p q r s t {i} u") for i in range(jaccard_join.FULL)])
    assert jaccard_join.cells(one, np.zeros(0, np.uint64), 4, False).count() == 0


def test_cells_a_little_full_come_later_in_the_order(spark, monkeypatch):
    """Shingles in more than FULL sets leave the first ones, so sets of other rare shingles give no pairs; the result is the same."""
    rng = random.Random(12)
    docs = list(enumerate([" ".join([f"s{k}" for k in range(5)] + [f"x{rng.randrange(10**9)}" for _ in range(60)]) for _ in range(jaccard_join.CELL - 2)] + ["s0 s1 s2 s3 s4 y"] * 2))
    assert found(spark, docs) == brute.clusters(docs)
    seen = []
    plain = jaccard_join.candidate_edges
    monkeypatch.setattr(jaccard_join, "candidate_edges", lambda rows: seen.append(rows.count()) or plain(rows))
    found(spark, docs)
    assert seen[0] <= jaccard_join.CELL


def test_hashes_tell_words_apart_as_split_does():
    """White space at ends, nulls, slices, words beyond ASCII and on both sides of every eight bytes."""
    rng = random.Random(13)
    sizes = ["".join(rng.choice("abé") for _ in range(k)) for k in range(1, 200)]
    texts = ["  A b\t", None, "", "\n \t", "a" * 64 + " " + "a" * 65 + " " + "a" * 66, " ".join(sizes), "é É e a\x00 a", " ".join(sizes[::-1])]
    for array in (pa.array(texts), pa.array(texts)[3:], pa.array(texts)[:0], pa.array([None, ""], pa.string())):
        plain = words.split(array, words.SPACED)
        h, starts = words.word_hashes(array, words.SPACED)
        assert starts.tolist() == plain.starts.tolist()
        assert len(set(h.tolist())) == len(set(plain.codes.tolist())) == len(set(zip(h.tolist(), plain.codes.tolist(), strict=True)))
        sets = jaccard_join.shingle_sets(array)
        assert [len(s) for s in sets] == [len(brute.shingles(t)) for t in array.to_pylist()]
        assert all((s[1:] > s[:-1]).all() for s in sets)


def test_shingles_are_made_without_a_call_for_each_word():
    text = pa.array([" ".join(f"w{i}" for i in range(20_000))])
    jaccard_join.shingle_sets(text)
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event))
    try:
        (found,) = jaccard_join.shingle_sets(text)
    finally:
        sys.setprofile(None)
    assert len(found) == 19_996
    assert len(calls) < 2_000
