import hashlib

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import fim, queries
from tests.llm.brute import fim_tokens

TEXTS = [
    "one two  three\n\tfour",
    "  leading and trailing \n",
    "",
    None,
    "   ",
    "word",
    "é ü 漢字 😀 x y   z",
    "holds <S> a marker of its own",
    "ends with < and <S and <P",
    "<S <P <M >P> S>",
    "same text",
    "same text",
    "long " * 60_000 + "end",
    "\x0b\x0c mixed \r\n spaces\t",
]


def expected(doc, text, unit):
    text = text or ""
    units = fim_tokens(text) if unit == "token" else list(text)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in fim.MARKERS) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", ["token", "character"])
def test_outputs_and_round_trip(spark, unit):
    rows = [(i * 31 + k, t) for k in range(6) for i, t in enumerate(TEXTS)] + [(None, "an id is missing here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = fim.transformed(docs, unit=unit).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted(((r["doc_id"] is None, r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in out.collect() if r["doc_id"] is not None)
    want = sorted(((False, doc), *expected(doc, text, unit), text or "") for doc, text in rows if doc is not None)
    assert [g[:1] + g[1:] for g in got] == want
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    nameless = out.filter("doc_id is null").collect()
    assert [(r["n"], r["form"], r["output"]) for r in nameless] == [(expected(None, rows[-1][1], unit)[0], expected(None, rows[-1][1], unit)[1], expected(None, rows[-1][1], unit)[4])]


def test_every_text_is_rewritten_at_full_rate(spark):
    docs = spark.createDataFrame([(i, f"a{i} b c d") for i in range(40)], "doc_id long, text string")
    assert {r["form"] for r in fim.transformed(docs, rate=100, spm_rate=0).collect()} == {"psm"}
    assert {r["form"] for r in fim.transformed(docs, rate=100, spm_rate=100).collect()} == {"spm"}
    assert {r["form"] for r in fim.transformed(docs, rate=0).collect()} == {"plain"}
    with pytest.raises(ValueError):
        fim.transformed(docs, unit="byte")


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n int, form string, output string, _text string, _h1 int")
    assert fim.transformed(docs).collect() == []
    docs = spark.createDataFrame([(7, "x y z", 3, "f", "o", "t", 1)], docs.schema)
    assert fim.transformed(docs).first()["n"] == 3


def test_query_restores_every_text(spark):
    sf = "/root/testdata/sf0.001"
    out = queries.op11_fim(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("whole"))
    assert out.count() == docs.count()
    assert out.join(docs, "doc_id").filter("restored_sha256 <> whole").count() == 0
