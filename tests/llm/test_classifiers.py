"""Language, quality and toxicity: held-out accuracy on the given tables, and odd inputs."""

import zlib

import numpy as np
import pytest

from tallyspark.llm import langid, quality, queries, toxicity
from tallyspark.llm.tables import table

SF = "/root/testdata/sf0.01"
ODD = [(1, None, None, "a", 3), (2, "", "en", None, 3), (3, "12 34 !!", None, None, None), (None, "words of some text", "en", "a", 1), (5, "words of some text", "en", "a", 1), (5, "words of some text", "en", "a", 1), (6, "long " * 200_000, "en", "a", 1), (7, "漢字 и ещё слова", "ru", "a", 1)]
SCHEMA = "doc_id long, text string, lang string, score string, _text int"


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


def area(y: np.ndarray, s: np.ndarray) -> float:
    """Chance that a row of label 1 scores higher than one of label 0."""
    high, low = s[y == 1][:, None], s[y == 0][None, :]
    return float(((high > low) + 0.5 * (high == low)).mean())


@pytest.mark.parametrize(("name", "label", "folds", "fold", "sf"), [("op1_quality", "quality", 5, 0, SF), ("op9_toxicity", "toxic", 4, 2, "/root/testdata/sf0.1")])
def test_scores_of_held_out_rows(spark, name, label, folds, fold, sf):
    rows = queries.queries()[name](spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    known = {r.doc_id: r[label] for r in table(spark, sf, "labels").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(known[r.doc_id], r.score) for r in rows if r.held_out and known.get(r.doc_id) is not None]
    assert area(*map(np.array, zip(*held, strict=True))) > 0.9


def test_languages_of_held_out_rows(spark):
    rows = queries.op7_langid(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id] is not None]
    assert len(held) > 100 and np.mean(held) > 0.97
    assert all(r.lang_pred in {*lang.values(), "und"} and 0 <= r.score <= 1 for r in rows)


def test_code_lengths_are_those_of_the_tree():
    """Method C by hand: after 'ab ' and 'ac ', in context ' a' both b and c count 1 of 2 + 2."""
    words = [b"ab", b"ac"]
    rows = []
    for word in words:
        _, room, keys = langid._positions([word])
        rows += [(0, k, int(keys[k][i]), 1) for i in range(len(room)) for k in range(langid.ORDER + 1) if room[i] >= k]
    counted = {}
    for lang, k, key, n in rows:
        counted[lang, k, key] = counted.get((lang, k, key), 0) + n
    model = langid.trees(["x"], [(lang, k, key, n) for (lang, k, key), n in counted.items()])
    bits = model.code_lengths([b"ab"])[0, 0]
    # 'a' after ' ': 2 of 2 + 1; 'b' after ' a': 1 of 2 + 2; ' ' after ' ab': 1 of 1 + 1
    assert bits == pytest.approx(-np.log2(2 / 3) + 2 + 1, abs=1e-4)
    # 'd' is new: escapes of ' a' (2/4), 'a' (2/4) and order 0 (4 kinds of 6 + 4), then one of 256
    whole = model.code_lengths([b"ad"])[0, 0]
    assert whole == pytest.approx(-np.log2(2 / 3) + 1 + 1 - np.log2(4 / 10) + 8 - np.log2(2 / 10), abs=1e-4)


def test_every_language_is_learnt_with_its_own_budget(spark):
    """70 languages, the last ones with the fewest rows, under a budget that the large ones would fill."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: letters[i % 26] + letters[i // 26] + letters[(i * 7 + 3) % 26]
    docs = [(1000 * i + j, f"{word(i)} " * 20, f"x{i:02d}") for i in range(70) for j in range(2 if i < 64 else 1)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(rows, max_grams=50)
    assert len(model.languages) == 70
    assert [r.doc_id for r in langid.predict(rows, model).join(rows, "doc_id").filter("lang <> lang_pred").collect()] == []


def test_escapes_are_counted_before_pruning(spark):
    rows = spark.createDataFrame([(1, "ab ab ab ac ad", "x")], "doc_id long, text string, lang string")
    # the rare ' ac' and ' ad' are pruned, yet b after ' a' stays 3 of 5 + 3
    model = langid.fit(rows, max_grams=9)
    assert model.code_lengths([b"ab"])[0, 0] == pytest.approx(langid.fit(rows).code_lengths([b"ab"])[0, 0], abs=1e-4)


def test_language_of_odd_rows(spark):
    docs = odd(spark)
    for model in (None, langid.fit(docs)):
        rows = langid.predict(docs, model).collect()
        assert len(rows) == len(ODD)
        assert {r.doc_id for r in rows if r.lang_pred == "und"} >= {1, 2, 3}
        assert all(0 <= r.score <= 1 for r in rows)
    kept = langid.identified(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 5, 5, 6, 7]
    assert langid.predict(docs.limit(0), model).count() == 0
    assert langid.fit(docs.limit(0)) is None


def test_without_labels_only_texts_without_letters_go(spark):
    docs = odd(spark)
    kept = langid.identified(docs, langid.fit(docs.filter("lang IS NULL")))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 5, 5, 6, 7]


def test_quality_of_odd_rows(spark):
    docs = odd(spark)
    rows = quality.binned(docs, docs.filter("doc_id = 5"))
    for w in (None, quality.fit(rows, 2, 3)):
        got = quality.scored(rows, w).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.fit(quality.binned(docs.limit(0), docs.limit(0))) is None


def test_negative_risk_is_turned_back():
    """Where the unlabelled part of the risk falls below 0, the gradient of that part is reversed."""
    at = np.zeros((4, 1), np.int64)
    s = quality._step_sums(np.full(quality.N_WEIGHTS, -5.0))(at, np.array([True, True, True, False]))
    n_p, n_u, loss_p, loss_u = s[-4:]
    assert (n_p, n_u) == (3, 4) and loss_p == pytest.approx(3 * np.logaddexp(0, -5)) and loss_u == pytest.approx(4 * np.logaddexp(0, -5))


def lexicon(spark):
    rows = [(i, f"a plain text about gardens number {i} with a cockpit view", 0) for i in range(60)]
    rows += [(100 + i, f"you are a total grumbleflork number {i}", 1) for i in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1, None)], "doc_id long, label int")
    return toxicity.fit(toxicity.sampled(docs, labels))


def test_toxic_words_in_disguise(spark):
    texts = ["you grumbleflork", "you GRUMBLEFLORK", "you grumbl3fl0rk", "you grumblеflоrk", "gardens and views", None, "", "good " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.scored(docs, lexicon(spark)).collect()}
    assert min(score[i] for i in range(4)) > 0.5 > 0.2 > max(score[i] for i in range(4, 8))


def test_toxicity_of_odd_rows(spark):
    docs = odd(spark)
    for lex in (toxicity.Lexicon(), lexicon(spark)):
        rows = toxicity.scored(docs, lex).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    kept = toxicity.accepted(docs, lex)
    assert kept.columns == docs.columns and kept.count() == len(ODD)
    none = spark.createDataFrame([], "doc_id long, label int")
    assert toxicity.fit(toxicity.sampled(docs, none)).weights == {}


def test_exception_phrases_count_nothing():
    lex = toxicity.Lexicon({" flork": 4.0}, frozenset(["flork bird"]), (-3.0, 3.0, 0.0))
    m = toxicity.Matcher(lex)
    import pyarrow as pa

    words = toxicity.split(pa.array([b"a flork bird", b"a flork dog", b"reflork"]), toxicity.SIGNED)
    assert m.sums(words)[0].tolist() == [0.0, 4.0, 0.0]
