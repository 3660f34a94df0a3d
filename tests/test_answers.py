import json
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import conversation, grounding
from tallyspark.operators.discovery import exactly_one, met

NONE = grounding.FALLBACK


def ground(spark, answer, contents):
    answers = spark.createDataFrame([(1, answer)], "doc_id long, answer string")
    chunks = spark.createDataFrame([(1, i, c) for i, c in enumerate(contents)], "doc_id long, chunk int, content string")
    rows = grounding.grounded(answers, chunks).collect()
    assert all(r["grounded"] == (r["value"] != NONE) for r in rows)
    return {r["field"]: r["value"] for r in rows}


def proposal(**fields):
    return json.dumps({"title": "Credit Policy", **fields})


def test_values_without_labels_are_not_grounded(spark):
    answer = proposal(document_id="123456789", version="1.0", effective_date="2025-01-01", review_cycle="Annual", target_audience="All Employees", enforcement_level="Strict", governance_owner="Board of Directors")
    got = ground(spark, answer, ["Credit Policy. This document establishes credit governance requirements."])
    assert got.pop("title") == "Credit Policy" and set(got.values()) == {NONE}


def test_a_value_elsewhere_in_the_text_is_not_grounded(spark):
    answer = proposal(document_id="Credit Policy", version="1.0", review_cycle="Annual", enforcement_level="Strict", governance_owner="Board")
    got = ground(spark, answer, ["Credit Policy. Annual reporting is required. Strict controls apply. The Board receives reports."])
    assert got.pop("title") == "Credit Policy" and set(got.values()) == {NONE}


def test_labelled_values_are_grounded(spark):
    answer = proposal(document_id="CP-001", version="2.1", effective_date="01 April 2026", review_cycle="Annual", target_audience=NONE, enforcement_level=NONE, governance_owner="Credit Risk  Department")
    text = "Credit Policy. Document ID: CP-001. Version: 2.1. Effective Date: 01\n April 2026. Review Cycle: Annual. Document Owner: Credit Risk Department."
    got = ground(spark, "```json\n" + answer + "\n```", [text])
    assert got == {"title": "Credit Policy", "document_id": "CP-001", "version": "2.1", "effective_date": "01 April 2026", "review_cycle": "Annual", "target_audience": NONE, "enforcement_level": NONE, "governance_owner": "Credit Risk  Department"}


@pytest.mark.parametrize("gap,held", [(160 - len("version "), True), (161 - len("version "), False)])
def test_the_distance_counts_from_begin_to_begin(spark, gap, held):
    text = "Credit Policy version " + "x" * (gap - 1) + " 7.5"
    assert ground(spark, proposal(version="7.5"), [text])["version"] == ("7.5" if held else NONE)


@pytest.mark.parametrize("answer", ["no json", "[1, 2]", "3", "", None, '{"title": {"a": 1}, "version": ["1.0"], "document_id": null, "review_cycle": " "}'])
def test_what_is_no_value_is_not_grounded(spark, answer):
    assert set(ground(spark, answer, ['Credit Policy version 1.0 {"a":1} ["1.0"]']).values()) == {NONE}


def test_numbers_titles_over_two_chunks_and_documents_without_chunks(spark):
    got = ground(spark, '{"title": "Credit Policy Manual", "version": 1.0}', ["page one of the Credit", "Policy  Manual with version 1.0", None, ""])
    assert got["title"] == "Credit Policy Manual" and got["version"] == "1.0"
    answers = spark.createDataFrame([(1, proposal()), (2, proposal())], "doc_id long, answer string")
    chunks = spark.createDataFrame([(2, 0, "credit policy")], "doc_id long, chunk int, content string")
    assert {(r["doc_id"], r["grounded"]) for r in grounding.grounded(answers, chunks).filter("field = 'title'").collect()} == {(1, False), (2, True)}


def greedy(lines, terms, most=8):
    scored = [(len(set(terms) & {w for w in __import__("re").findall("[a-z0-9]+", x.lower()) if len(w) > 2}), i) for i, x in enumerate(lines)]
    taken, used = [], set()
    for _, i in sorted(((s, i) for s, i in scored if s), key=lambda p: -p[0]):
        window = range(max(0, i - 2), min(len(lines), i + 3))
        if len(taken) < most and not used & set(window):
            taken.append("\n".join(lines[j] for j in window))
            used |= set(window)
    return taken


def test_snippets_are_those_of_a_greedy_choice(spark):
    rng = random.Random(9)
    words = ["loan", "rate", "card", "Loan,", "of", "is", "x1", "deposit"]
    pages = [[" ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(90))] for _ in range(60)] + [[], ["loan"], ["nothing"]]
    terms = ["loan", "rate", "card", "of"]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, lines array<string>")
    for most in (8, 2):
        got = {r["i"]: r["s"] for r in df.select("i", grounding.snippets(F.col("lines"), terms, most=most).alias("s")).collect()}
        assert got == {i: greedy(p, terms, most) for i, p in enumerate(pages)}


def test_a_follow_up_keeps_what_it_does_not_name(spark):
    turns = [
        (1, 0, "Show top 10 customers by deposit balance report"),
        (1, 1, "only Main branch"),
        (1, 2, "now in usd"),
        (1, 3, "bottom 3 instead"),
        (1, 4, "Show active account report by branch"),
        (1, 5, "lowest first"),
        (2, 0, "same in birr this month"),
        (2, 1, None),
        (3, None, "top 5"),
        (None, 1, "top 5"),
    ]
    rows = conversation.contexts(spark.createDataFrame(turns, "conv_id long, turn int, prompt string")).collect()
    got = {(r["conv_id"], r["turn"]): r for r in rows}
    assert len(got) == 8
    first = got[1, 3]
    assert (first["measure"], first["dimension"], first["ranking"], first["limit"], first["sort_direction"], first["branch"], first["filters"]) == ("balance", "branch", "bottom", 3, "ascending", "Main branch", {"branch": "Main branch", "currency": "USD"})
    assert first["previous_prompt"] == "bottom 3 instead" and [got[1, t]["follow_up"] for t in range(6)] == [False, True, True, True, False, True]
    assert (got[1, 4]["measure"], got[1, 4]["limit"], got[1, 4]["filters"], got[1, 4]["status"]) == ("count", None, {}, "active")
    assert (got[1, 5]["ranking"], got[1, 5]["sort_direction"], got[1, 5]["measure"]) == ("bottom", "ascending", "count")
    assert got[2, 0]["filters"] == {"currency": "ETB"} and got[2, 0]["period"] == "this_month"
    assert got[2, 1]["period"] is None and not got[2, 1]["follow_up"]


def test_carried_values_do_not_depend_on_the_blocks(spark):
    rng = random.Random(10)
    rows = [(k, i, rng.random() < 0.05, rng.choice([None, None, i]), rng.choice([None, None, None, -i])) for k in range(4) for i in range(rng.randrange(0, 300))]
    want, state = [], {}
    for k, i, fresh, a, b in rows:
        old = {} if fresh else state.get(k, {})
        state[k] = {"a": old.get("a") if a is None else a, "b": old.get("b") if b is None else b}
        want.append((k, i, state[k]["a"], state[k]["b"]))
    df = spark.createDataFrame(rows, "k int, i int, fresh boolean, a int, b int")
    for block in (1, 7, 1024):
        got = conversation.carried(df, "k", ["i"], "fresh", ["a", "b"], block).select("k", "i", "a", "b").collect()
        assert sorted(map(tuple, got)) == want
    assert conversation.carried(df.limit(0), "k", ["i"], "fresh", ["a", "b"]).collect() == []


def test_exactly_one_document_or_none(spark):
    docs = [
        (1, "Credit Policy", "cp.pdf", True),
        (2, "Loan Manual", "lm.pdf", True),
        (3, "Loan Manual", "lm2.pdf", False),
        (4, "Card Guide", "a.pdf", False),
        (5, "Card Guide", "b.pdf", False),
        (6, "Deposit Handbook of Branches", None, None),
        (7, None, "Credit Policy", True),
        (8, "Same", "same", False),
    ]
    queries = [(1, " loan manual"), (2, "CARD GUIDE"), (3, "cp.pdf"), (4, "handbook deposit"), (5, "pdf"), (6, "credit policy"), (7, "nothing of it"), (8, ""), (9, None), (10, "same"), (11, "deposit x")]
    out = exactly_one(spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(docs, "doc_id long, title string, filename string, ready boolean"))
    got = {r["query_id"]: (r["status"], r["doc_id"], r["candidates"]) for r in out.collect()}
    assert got == {
        1: ("resolved", 2, 2),
        2: ("ambiguous", None, 2),
        3: ("resolved", 1, 1),
        4: ("resolved", 6, 1),
        5: ("ambiguous", None, 5),
        6: ("ambiguous", None, 2),
        7: ("not_found", None, 0),
        8: ("not_found", None, 0),
        9: ("not_found", None, 0),
        10: ("resolved", 8, 1),
        11: ("not_found", None, 0),
    }


def test_copies_of_queries_and_documents_meet_once(spark):
    docs = [(i, "Loan Manual of Branches" if i % 2 else "manual loan branches OF", "x.pdf", False) for i in range(300)] + [(500, "Card manual", "y.pdf", True)]
    queries = [(i, "branches manual") for i in range(200)] + [(1000, "manual card"), (1001, "manual of nothing"), (1002, "manual")]
    queries, docs = spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(docs, "doc_id long, title string, filename string, ready boolean")
    got = {r["query_id"]: (r["status"], r["doc_id"], r["candidates"]) for r in exactly_one(queries, docs).collect()}
    assert got == {**{i: ("ambiguous", None, 300) for i in range(200)}, 1000: ("resolved", 500, 1), 1001: ("not_found", None, 0), 1002: ("ambiguous", None, 301)}
    wanted = spark.createDataFrame([(["branches", "manual"],), (["card", "manual"],), (["manual"],)], "_words array<string>")
    held = spark.createDataFrame([(["branches", "loan", "manual"], 300, 0), (["card", "manual"], 1, 500)], "_held array<string>, _docs long, _least long")
    assert met(wanted, held).count() == 4


def test_queries_by_words_as_by_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{int(rng.random() ** 2 * 25)}" for _ in range(4000)]
    pick = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, pick(rng.randrange(1, 6)), pick(1) + ".pdf") for i in range(120)]
    queries = [(i, "? " + pick(rng.randrange(1, 6))) for i in range(150)]
    out = exactly_one(spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame([(*x, False) for x in docs], "doc_id long, title string, filename string, ready boolean"))
    got = {r["query_id"]: (r["doc_id"], r["candidates"]) for r in out.collect()}
    held = {i: {*t.split(), *f.split(".")} for i, t, f in docs}
    for i, q in queries:
        own = [d for d, h in held.items() if set(q.split()[1:]) <= h]
        assert got[i] == (own[0] if len(own) == 1 else None, len(own))
