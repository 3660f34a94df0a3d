import random

from tallyspark.llm import decontaminate
from tests.llm import brute


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, spans string, item_id string").repartition(2)
    return d, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")


def data():
    rng = random.Random(9)
    word = lambda: rng.choice(["Alpha", "be-ta", "gäma", "x9", "漢字", "tail's"]) + str(rng.randrange(40))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 12, 13, 14, 40])))) for i in range(1, 16)] + [(16, None), (17, ""), (18, "..."), (None, "lost item words"), (2, "Second text of item two")]
    docs = []
    for i in range(120):
        parts = [word() for _ in range(rng.randrange(0, 200))]
        if rng.random() < 0.6:
            own = (rng.choice(items)[1] or "").split()
            at, k = rng.randrange(len(parts) + 1), rng.randrange(len(own) + 1)
            parts[at:at] = own[k // 2 :] if rng.random() < 0.5 else own
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(parts)))
    return [*docs, (900, None), (901, ""), (902, "!!"), (903, "word " * 50_000)], items


def test_hits_as_by_brute_force(spark, monkeypatch):
    docs, items = data()
    want = brute.decontaminated(docs, [x for x in items if x[0] is not None])
    d, b = frames(spark, docs, items)
    for block in (200_000, 40):
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
        rows = decontaminate.scanned(d, b).withColumn("n_hit", decontaminate.hit_words()).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows} == want
    assert any(0 < n < w for w, n, _ in want.values())


def test_documents_go_by_the_rule_and_keep_their_columns(spark):
    docs, items = data()
    want = brute.decontaminated(docs, [x for x in items if x[0] is not None])
    d, b = frames(spark, docs, items)
    kept = decontaminate.without_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (n, hit, _) in want.items() if not (hit and 20 * hit >= n))


def test_spans_are_cut(spark):
    item = " ".join(f"q{i}" for i in range(13))
    d, b = frames(spark, [(1, f"Before, {item.upper()}! after"), (2, "clean text"), (3, None)], [(7, item)])
    rows = {r.doc_id: r.text for r in decontaminate.without_spans(d, b).collect()}
    assert rows == {1: "Before, ! after", 2: "clean text", 3: None}


def test_empty_tables(spark):
    d, b = frames(spark, [(1, "a b c")], [(7, "a b c")])
    assert decontaminate.scanned(d.limit(0), b).count() == 0
    assert decontaminate.without_contaminated(d, b.limit(0)).count() == 1
    assert decontaminate.without_contaminated(d, b).count() == 0
