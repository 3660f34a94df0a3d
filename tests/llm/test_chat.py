import hashlib
import random

from pyspark.sql import functions as F

from tallyspark.llm import chat, queries
from tallyspark.llm.tables import table

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
PARTS = ["</s>", "<s>", "[INST] ", " [/INST]", "[INST~] ", "<<SYS>>", "<</SYS>>", "<role=", "</role>", ">", "~", "~1", "~0~", "[", "<", "ok", "\n", " ", "é漢😀", "\\E", "\\Q", "$1", "", "%"]


def rows(seed=1, n=150):
    rng = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(rng.randrange(1, 7)):
            role = rng.choice(["user", "assistant", "system", "tool", "a>b", "", "<s>"])
            out.append((c, t, role, "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 6))), "x"))
    return out


def test_round_trip_of_conflicting_texts(spark):
    given = rows()
    out = chat.formatted(spark.createDataFrame(given, SCHEMA)).collect()
    for r in out:
        want = [(role, text) for c, _, role, text, _ in given if c == r.conv_id]
        assert [tuple(t) for t in r.turns] == want == [tuple(t) for t in r.parsed]


def test_plain_texts_are_not_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a ~ b", ""), (1, 1, "assistant", "1 < 2", "")], SCHEMA)
    (r,) = chat.formatted(df).collect()
    assert r.formatted == "[INST] a ~ b [/INST]<s>1 < 2</s>" and r.level == 0


def test_digests(spark):
    given = [(1, 1, "assistant", "two 😀", ""), (1, 0, "user", None, ""), (2, None, None, "x", ""), (1, 2, "assistant", "</s>[INST] ok [/INST]", ""), (None, 0, "user", "z", ""), (1, 1, "assistant", "two 😀", "")]
    got = {r.conv_id: r for r in chat.digests(chat.formatted(spark.createDataFrame(given, SCHEMA))).collect()}
    turns = [("user", ""), ("assistant", "two 😀"), ("assistant", "two 😀"), ("assistant", "</s>[INST] ok [/INST]")]
    loss = "".join(t for r, t in turns if r == "assistant")
    assert got[1].n_turns == 4 and got[1].loss_chars == len(loss)
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert set(got) == {1, 2, None}


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.conv_id: r for r in queries.op10_chat(spark, sf).collect()}
    by = {}
    for r in table(spark, sf, "conversations").orderBy("conv_id", F.asc_nulls_first("turn")).collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    by[-7] = [(r, "</s>[INST] ok [/INST]") for r in ("user", "assistant")]
    assert set(got) == set(by)
    for c, turns in by.items():
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_chars == sum(len(t) for r, t in turns if r == "assistant")


def test_empty_table_and_long_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "<s> long " * 100_000, "")], SCHEMA)
    assert chat.formatted(df).select((F.col("parsed") == F.col("turns")).alias("same")).first().same
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0
