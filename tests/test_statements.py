import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import paths, statements


def brute(edges, start, end, most):
    near = {}
    for a, b, c in edges:
        if a is not None and b is not None and a != b:
            for x, y in ((a, b), (b, a)):
                near.setdefault(x, {})[y] = max(c, near.get(x, {}).get(y, 0))
    todo, seen = deque([[start]]), {start}
    while todo:
        path = todo.popleft()
        if len(path) > most:
            continue
        for n in sorted(near.get(path[-1], {})):
            if n == end:
                sure = [near[x][y] for x, y in zip(path + [n], path[1:] + [n])]
                return len(path), round(sum(sure) / len(sure)), path + [n]
            if n not in seen:
                seen.add(n)
                todo.append(path + [n])
    return None


@pytest.mark.parametrize("hub", [3, 1000])
def test_paths_are_the_first_of_the_shortest(spark, hub):
    rnd = random.Random(5)
    names = [f"n{i:02}" for i in range(40)]
    edges = [(rnd.choice(names), rnd.choice(names), rnd.randint(1, 100)) for _ in range(45)]
    edges += [("n00", n, 50) for n in names[10:20]] + [(None, "n01", 9), ("n01", None, 9)]
    pairs = [(a, b) for a in names[:8] for b in names[5:]] + [("n00", "n15"), (None, "n01"), ("n03", "absent")]
    got = paths.shortest(spark.createDataFrame(edges, "src string, dst string, confidence int"), spark.createDataFrame(pairs, "start string, end string"), 4, hub)
    got = {(r["start"], r["end"]): (r["steps"], r["confidence"], list(r["path"])) for r in got.collect()}
    want = {(a, b): brute(edges, a, b, 4) for a, b in pairs if a and a != b}
    assert got == {k: v for k, v in want.items() if v}
    assert {v[0] for v in got.values()} == {1, 2, 3, 4}


def test_no_paths_without_relationships(spark):
    edges = spark.createDataFrame([], "src string, dst string, confidence int")
    assert paths.shortest(edges, spark.createDataFrame([("a", "b")], "start string, end string")).count() == 0


def columns(spark, text, labels):
    r = spark.createDataFrame([(text,)], "text string").select(statements.two_columns(F.col("text"), labels).alias("v")).first()["v"]
    return r and tuple(r)


@pytest.mark.parametrize(
    "text,labels,want",
    [
        ("Gross amount     49,247,044   53,806,014", ["Gross amount"], (49247044, 53806014)),
        ("Impairment (774,367) (812,001)\nNet 5 6", ["Impairment"], (-774367, -812001)),
        ("gross AMOUNT in thousands -192 8.5", ["Gross amount"], (-192, 8)),
        ("Total 1,200 1,100", ["Gross", r"\bTotal\b"], (1200, 1100)),
        ("Gross amount 7", ["Gross amount"], None),
        ("Gross amount\n" + "x " * 70 + "1 2", ["Gross amount"], None),
        ("Gross (12 13", ["Gross"], None),
        ("", ["Gross"], None),
        (None, ["Gross"], None),
    ],
)
def test_two_numbers_after_a_label(spark, text, labels, want):
    assert columns(spark, text, labels) == want


REPORT = """Annual report, 30 June 2025 and 30 June 2024
14. Cash and bank
Gross 1 2
15. Loans and advances to customers
Gross {gross}
Allowance {allowance}
Net {net}
16. Other assets
Net 8 9
"""
LOANS = statements.Checked("Loans and advances", ["Gross"], ["Allowance"], ["Net"], "loans")


def read(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r["doc_id"], r["fact"], r["year"]): r["value"] for r in statements.facts(rows, [LOANS]).collect()}


def test_only_figures_that_agree_are_facts(spark):
    right = REPORT.format(gross="45,058,301 40,000", allowance="(774,367) (500)", net="44,283,934 39,000")
    # the year before is off by 500, more than five or a hundred-thousandth
    assert read(spark, right) == {(0, "loans_gross", 2025): 45058301, (0, "loans_allowance", 2025): 774367, (0, "loans_net", 2025): 44283934}


def test_reports_without_period_note_or_text_give_nothing(spark):
    whole = REPORT.format(gross="100 100", allowance="(10) (10)", net="90 85")
    got = read(spark, whole.replace("30 June 2024", ""), whole.replace("Loans", "Debts"), "", None, whole)
    assert {k[0] for k in got} == {4} and {k[2] for k in got} == {2025, 2024}


MIX = statements.Mix(groups=[["loans"], ["deposits", "total deposits"]], terms=["strategy", "digital", "branch"], excluded=["associate"], dated=["2025", "2024"], units=["thousands"], narrative=2, most=2_000, mandatory_chars=1_000)


def test_mandatory_chunks_come_first_and_once(spark):
    texts = [
        "deposits and strategy",
        "Loans in 2025 and 2024",
        "loans in thousands",
        "total deposits of an associate",
        "  ",
        "digital strategy of the branch",
        "branch",
        "digital " + "y" * 3000 + " branch",
        None,
    ]
    rows = spark.createDataFrame([(d, i, t) for d in (1, 2) for i, t in enumerate(texts)] + [(3, 0, "nothing"), (4, 0, "loans, deposits and strategy")], "doc_id long, chunk int, content string")
    got = statements.mixed(rows, MIX)
    found = {}
    for r in got.orderBy("doc_id", "part", "place").collect():
        found.setdefault(r["doc_id"], []).append((r["part"], r["chunk"], len(r["content"])))
    want = [("mandatory", 1, 22), ("mandatory", 0, 21), ("narrative", 5, 30), ("narrative", 7, 500)]
    assert found == {1: want, 2: want, 4: [("mandatory", 0, 28)]}
    text = {r["doc_id"]: r["evidence"] for r in statements.evidence_text(got, 61).collect()}
    assert text[1] == "VERIFIED EVIDENCE 1\nCONTENT:\nLoans in 2025 and 2024\n\nVERIFIED"


def test_no_chunks_give_no_evidence(spark):
    assert statements.mixed(spark.createDataFrame([], "doc_id long, chunk int, content string"), MIX).count() == 0
