import random
import re

import pytest

from tallyspark.operators import sections as S


def parsed(spark, *texts):
    rows = spark.createDataFrame([(1, p, t) for p, t in enumerate(texts, 1)], "doc_id long, page int, text string")
    return [tuple(r)[2:] for r in S.paged_sections(rows).orderBy("k").collect()]


def test_contents_and_footers_are_no_sections(spark):
    contents = "1. Introduction ........ 3\n1.1 Purpose ..... 4\n2. Credit ...... 5"
    got = parsed(spark, contents, "Bank policy\nPage | 2\nApproved by the Board\n1. Introduction\nText.\n|\n1.1 Purpose", "pade 3\nOf the policy", "Table of Contents\n2. Credit")
    assert got == [
        (None, "Document Introduction", None, None, 2, 2, "Bank policy"),
        ("1", "Introduction", None, None, 2, 2, "1. Introduction\nText."),
        ("1.1", "Purpose", "1", "Introduction", 2, 3, "1.1 Purpose\nOf the policy"),
    ]


def test_numbers_are_chapters_only_after_a_chapter_line(spark):
    got = parsed(spark, "CHAPTER ONE\n1. Scope\n7. ATM\n2. Terms\nChapter II\n2 Credit Process\n3. Other\n71. Noise")
    assert [(r[0], r[1], r[6]) for r in got] == [("1", "Scope", "1. Scope\n7. ATM\n2. Terms"), ("2", "Credit Process", "2. Credit Process\n3. Other\n71. Noise")]


def test_roles_stay_and_clauses_get_their_number_back(spark):
    got = parsed(spark, "5. Responsibilities\n5.3 The President shall\n5.3.1 approve loans\n53.2 Review them\n53.x none\n6.1 Elsewhere\n5.4 ensures that it works\n5.5 Credit Department")
    assert [(r[0], r[2], r[6]) for r in got] == [
        ("5", None, "5. Responsibilities"),
        ("5.3", "5", "5.3 The President shall\n5.3.1. approve loans\n5.3.2. Review them\n53.x none\n6.1 Elsewhere\n5.4 ensures that it works"),
        ("5.5", "5", "5.5 Credit Department"),
    ]


def fold(lines):
    """The same rules, one line after another."""
    open_, majors, pending, above, role, out = None, 0, False, None, None, []

    def title_of(t):
        w = re.findall(r"[A-Za-z0-9/&'-]+", t)
        low = f" {t.lower()} "
        return len(t) <= 160 and 0 < len(w) <= 18 and w[0].lower() not in S.CLAUSE_WORDS and not any(x in low for x in S.REQUIRES) and not (len(w) > 8 and t[-1] in ".;,")

    for line in lines:
        if re.fullmatch("(?i)chapter [a-z0-9]+", line):
            pending = True
            continue
        m = re.fullmatch(r"[ |,;:\-]*(\d+(?:\.\d+){0,4})\.? +(.+)", line)
        n, t = (m[1], m[2]) if m else (None, None)
        if m and "." not in n and (pending or above is None) and int(n) <= 50 and title_of(t):
            above, role, pending, open_ = (n, t), None, False, [n, f"{n}. {t}"]
            out.append(open_)
            continue
        office = m and (any(o in t.lower() for o in S.OFFICES) or " shall" in t.lower())
        if m and n.count(".") == 1 and (above is None or n.split(".")[0] == above[0]) and (office or title_of(t)):
            role, open_ = n, [n, re.sub(r"^[|,;:\- ]+", "", line)]
            out.append(open_)
            continue
        if m and role:
            short = role.replace(".", "") + "."
            if n.startswith(role + "."):
                line = f"{n}. {t}"
            elif n.startswith(short) and n[len(short) :].isdigit():
                line = f"{role}.{n[len(short):]}. {t}"
        if open_ is None:
            open_ = [None]
            out.append(open_)
        open_.append(line)
    return [(x[0], "\n".join(x[1:])) for x in out]


@pytest.mark.parametrize("seed", range(4))
def test_windows_carry_what_a_fold_carries(spark, seed):
    rnd = random.Random(seed)
    titles = ["Credit Terms", "The Board shall", "ensure that all is well", "Scope of it", "It must be so", "Unit of risk, of many words that go on and on."]
    kinds = [
        lambda: f"Chapter {rnd.choice(['one', 'II', '3'])}",
        lambda: f"{rnd.randint(1, 4)}. {rnd.choice(titles)}",
        lambda: f"{rnd.choice('|;-')} {rnd.randint(1, 3)}.{rnd.randint(1, 2)} {rnd.choice(titles)}",
        lambda: f"{rnd.randint(1, 3)}.{rnd.randint(1, 2)}.{rnd.randint(1, 5)} {rnd.choice(titles)}",
        lambda: f"{rnd.randint(1, 3)}{rnd.randint(1, 2)}.{rnd.randint(1, 5)} {rnd.choice(titles)}",
        lambda: "some words of the text",
        lambda: f"{rnd.choice([51, 99, 120])} {rnd.choice(titles)}",
    ]
    docs = {d: [rnd.choice(kinds)() for _ in range(rnd.randint(1, 40))] for d in range(40)}
    rows = [(d, p, "\n".join(x[p * 7 : p * 7 + 7])) for d, x in docs.items() for p in range((len(x) + 6) // 7)]
    got = {}
    for r in S.paged_sections(spark.createDataFrame(rows, "doc_id long, page int, text string")).orderBy("doc_id", "k").collect():
        got.setdefault(r["doc_id"], []).append((r["number"], r["content"]))
    assert got == {d: f for d, x in docs.items() if (f := fold(x))}


def test_empty_pages_give_no_sections(spark):
    assert parsed(spark, "", None, " \n ") == []
    assert S.paged_sections(spark.createDataFrame([], "doc_id long, page int, text string")).count() == 0
