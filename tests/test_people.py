"""People on pages, evidence of roles and reports by year, against plain loops and hand cases."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import people as P
from tallyspark.operators import roles as R
from tallyspark.operators import yearly as Y

POOL = ["Abebe B", "Qualification: MA", "qualification: x", "Experience: 9 years", "Director", "D/Chairman", "Member", "Company Secretary", "A Chief Executive Officer", "the CEO", "Deputy CEO", "Deputy Chief  Executive", "", "  ", "Sara\tK"]


def plain_lines(text):
    return [" ".join(x.split()) for x in (text or "").splitlines() if x.strip()]


def plain_board(text):
    rows, out = plain_lines(text), []
    starts = [i for i in range(1, len(rows)) if rows[i].lower().startswith("qualification:")]
    i = starts[0] - 1 if starts else len(rows)
    while i + 3 < len(rows) and "company secretary" not in rows[i].lower():
        name, q, e, role = rows[i : i + 4]
        if q.lower().startswith("qualification:") and e.lower().startswith("experience:") and role.lower() in P.BOARD_ROLES:
            out.append((name, role, q, e))
            i += 4
        else:
            i += 1
    return out


def plain_cards(text, deputy):
    rows, out = plain_lines(text), []
    for i, line in enumerate(rows):
        low = line.lower()
        if not any(w in low for w in (P.DEPUTY if deputy else P.CHIEF)) or (not deputy and "deputy" in low):
            continue
        near = [x for x in rows[max(0, i - 1) : i + 2] if deputy or not any(w in x.lower() for w in P.OF_DEPUTY)]
        if "\n".join(near) not in out:
            out.append("\n".join(near))
    return out[: P.MOST_RECORDS]


def test_people_like_a_plain_loop(spark):
    rng = random.Random(5)
    member = ["N", "Qualification: MA", "Experience: 9", "Director"]
    texts = ["\n".join(rng.choice(POOL) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += ["\n".join(x for _ in range(rng.randint(1, 12)) for x in rng.choice([member, member[1:], ["Company Secretary"], ["x"]])) for _ in range(400)]
    # a role line that would be the next member's name, and members one after the other in that way
    texts += ["\n".join(member + member[1:] * 5), "Qualification: MA\nExperience: 9\nDirector", "N\r\nQualification: a Experience: b\x0bchairman", "", None]
    texts += ["\n".join(f"{i}\nthe CEO" for i in range(50)), "\n".join(member * 3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", P.board(F.col("text")).alias("board"), P.role_records(F.col("text")).alias("chief"), P.role_records(F.col("text"), True).alias("deputy")).collect()
    found = 0
    for r in rows:
        assert [tuple(m) for m in r.board] == plain_board(texts[r.id]), texts[r.id]
        assert r.chief == plain_cards(texts[r.id], False)
        assert r.deputy == plain_cards(texts[r.id], True)
        found += len(r.board)
    assert len(rows) == len(texts) and found > 3000


@pytest.mark.parametrize(
    "question,title,content,kept",
    [
        ("What are the duties of the Branch Manager?", "Branch Manager", "He signs.", True),
        # another role, by a modifier that was not asked for
        ("What are the duties of the Branch Manager?", "Deputy Branch Manager", "The branch manager signs.", False),
        # some of the words and others besides
        ("What must a loan officer check?", "Loan Register", "The loan officer must check it.", False),
        ("What must a loan officer check?", "Loan staff", "The loan officer must check it.", True),
        ("What must a loan officer check?", "Files", "The loan officers, must check it.", True),
        ("What must a loan officer check?", "Files", "The loan is kept.", False),
        ("Auditors?", "Files", "Any auditor.", True),
        ("Auditors?", None, "x " * 600 + "auditor", False),
        ("Auditors?", None, None, False),
        ("Who is it?", "Who", "it", False),
        ("Manager of class", "Class manager", None, True),
    ],
)
def test_role_evidence(spark, question, title, content, kept):
    found = spark.createDataFrame([(1, title, content)], "doc_id long, title string, content string")
    assert bool(R.validated(found, question).collect()) == kept


def test_role_evidence_counts(spark):
    found = spark.createDataFrame([(1, "Loan officers", "A loan officer. Loans, loan")], "doc_id long, title string, content string")
    r = R.validated(found, "loan officer approval").first()
    assert r is not None and (r.title_hits, r.opening_hits) == (2, 2)


@pytest.mark.parametrize(
    "question,year",
    [
        ("profit of 2023/2024", "2023/2024"),
        ("profit of 2023 - 24", "2023/2024"),
        ("in 2021 or 2023/24", "2023/2024"),
        ("2023-24 against 2020/2021", "2020/2021"),
        ("in 2021, or 2022", "2021"),
        ("in 1999", None),
        ("12023", None),
        ("", None),
        (None, None),
    ],
)
def test_requested_year(spark, question, year):
    assert spark.createDataFrame([(question,)], "q string").select(Y.requested_year(F.col("q"))).first()[0] == year


def test_reports_by_year(spark):
    reports = spark.createDataFrame(
        [(5, "a", "Report 2023-24", None, None), (3, "a", "Report 2022/2023", "f.pdf", ""), (9, "a", "REPORT 2023/2024", "", None), (4, "a", "Report 2023/2024", "", ""), (1, "b", "Leaflet", None, None), (2, None, "Report 2023/2024", "", "")],
        "report_id long, owner string, title string, filename string, url string",
    )
    asked = [
        (1, "a", "for 2023/24", 4, 200),
        (2, "a", "for 2022", 3, 140),
        (3, "a", "for 2019", None, None),
        (4, "a", "the last one", 3, None),
        (5, "b", "for 2023", None, None),
        (6, "c", "for 2023", None, None),
        (7, None, "for 2023", None, None),
        (8, "a", None, None, None),
        (9, "a", "for 2023-2024", 4, 200),
        (10, "b", "any", 1, None),
    ]
    questions = spark.createDataFrame([r[:3] for r in asked], "query_id long, owner string, question string")
    got = {r.query_id: (r.report_id, r.score) for r in Y.select_reports(questions, reports).collect()}
    assert got == {r[0]: r[3:] for r in asked}
    assert Y.select_reports(questions, reports.limit(0)).filter("report_id is not null").count() == 0
    assert Y.select_reports(questions.limit(0), reports).count() == 0
