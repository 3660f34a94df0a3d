"""Steps, actors, chunks, governance, sources and the stream, on small fixtures."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import catalog, documents, governance
from tallyspark.operators.report import Join, Measure, Report, run
from tallyspark.sources import tables
from tallyspark.streaming import series


def steps(spark, content):
    df = spark.createDataFrame([(1, 0, content)], "doc_id long, k int, content string")
    return [(r.number, r.action) for r in documents.steps(df).orderBy("step").collect()]


@pytest.mark.parametrize(
    "content,want",
    [
        ("4.1. Credit Processing\n1. The officer shall submit it.\n2) Managers approve.", [(1, "The officer shall submit it."), (2, "Managers approve.")]),
        ("7. LOAN FILE MANAGEMENT\n1. Files are kept.\n2. Files are signed.", [(1, "Files are kept."), (2, "Files are signed.")]),
        ("The ratio is 4.1. Above that it fails", []),
        ("1. Pay within 3/4. Then stop 12.5 Percent.", [(1, "Pay within 3/4. Then stop 12.5 Percent.")]),
        ("1. First line\ngoes on here.\n2.Second has no space.", [(1, "First line goes on here."), (2, "Second has no space.")]),
        ("", []),
    ],
)
def test_steps(spark, content, want):
    assert steps(spark, content) == want


@pytest.mark.parametrize(
    "action,want",
    [
        ("The file shall be reviewed by the Branch Manager.", ["Branch Manager"]),
        ("The form shall be signed by the Branch Manager before release.", ["Branch Manager"]),
        ("Contracts shall always be designed by the Legal Service Department, as agreed.", ["Legal Service Department"]),
        ("It must be re-appraised by the Credit Board other than the first one.", ["Credit Board"]),
        ("The Credit Officer is responsible for file review.", ["Credit Officer"]),
        ("A designated Case Team or individual/jointly named is responsible to keep it.", ["Case Team"]),
        ("The Audit Unit is entrusted with loan monitoring.", ["Audit Unit"]),
        ("In such cases, the Risk Team can advise on it.", ["Risk Team"]),
        ("However, if late, the responsible Loan Officer, in coordination with the Legal Office, shall prepare a note.", ["Loan Officer", "Legal Office"]),
        ("Credit Team must submit it in coordination with the Audit Office.", ["Credit Team", "Audit Office"]),
        ("The Branch Manager shall approve. It shall be signed by the Senior Branch Manager.", ["Branch Manager"]),
        ("The officer shall go home.", []),
        ("It shall be signed by the bank.", []),
        ("Nothing here.", []),
        ("", []),
        (None, []),
    ],
)
def test_actors(spark, action, want):
    assert sorted(spark.createDataFrame([(action,)], "t string").select(documents.actors(F.col("t"))).first()[0]) == sorted(want)


@pytest.mark.parametrize(
    "title,content,direct,procedure",
    [
        ("Steps", "First the file is opened, and then it is sent.", False, True),
        ("Steps", "Step one is the review.", False, True),
        ("Any", "Staff are expected to\n know it.", True, False),
        ("Any", "Officers are accountable for it; their duty is clear.", True, False),
        ("Scope", "Staff shall know it.", False, False),
        ("Scope of it", "They have the following responsibilities.", True, False),
        ("Any", "1. It shall be reviewed. 2. It shall be approved within 5 days.", True, True),
        ("Any", "1. It shall be reviewed. 2. It shall be reviewed.", True, False),
        ("Any", "1. Sent within 3 days. 2. Sent within 5 days.", False, False),
        ("Any", "The credit process shall cover appraisal, approval and recovery.", True, True),
        ("Any", "The objective of it: step 1.", False, False),
        ("Authority  and responsibilities", "Step 1. It shall be sent.", True, False),
        (None, None, False, False),
    ],
)
def test_evidence(spark, title, content, direct, procedure):
    rows = spark.createDataFrame([(1, 0, title, content)], "doc_id long, k int, title string, content string")
    got = documents.evidence(rows).first()
    assert (got["direct"], got["procedure"]) == (direct, procedure)


def test_steps_have_no_limit(spark):
    many = "\n".join(f"{i % 99 + 1}. Step that is done" for i in range(10_500))
    assert len(steps(spark, many)) == 10_500


def test_sections_and_chunks_of_odd_texts(spark):
    long = "x" * 4000
    df = spark.createDataFrame([(1, None), (2, ""), (3, "intro\n1. Scope of it\nbody\n1.1 Part\nmore"), (4, "\n".join([long, "a", long]))], "doc_id long, text string")
    rows = documents.sections(df).filter("doc_id = 3").orderBy("k").collect()
    assert [(r.number, r.title, r.parent_title, r.content) for r in rows] == [(None, "Document Introduction", None, "intro"), ("1", "Scope of it", None, "body"), ("1.1", "Part", "Scope of it", "more")]
    packed = documents.chunks(df).filter("doc_id = 4").orderBy("chunk").collect()
    assert [len(r.content) for r in packed] == [4000, 1, 4000]


def test_roles_see_different_rows(spark):
    rows = spark.range(400).select(F.col("id"), (F.col("id") % 2).alias("branch_of"))
    roles = spark.createDataFrame([("analyst", "confidential", False, True, None), ("standard_user", "internal", False, False, 1), ("manager", "restricted", False, False, None)], "role string, classification string, aggregate boolean, sensitive boolean, branch long")
    got = {r.role: (r.n, r.m) for r in governance.governed(rows, roles, ["id"], "branch_of").groupBy("role").agg(F.count("*").alias("n"), F.min("id").alias("m")).collect()}
    assert got == {"analyst": (400, 0), "standard_user": (100, 1)}


def test_scope_and_flipped_join_of_a_report(spark):
    frames = {"a": spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "k int, s string"), "b": spark.createDataFrame([(1,), (4,)], "bk int")}
    joins = [Join("b", "bk", "a", "k", "left")]
    report = Report(["a", "b"], measures=[Measure("n", "count")], dimensions={"s": F.col("s")})
    assert {(r.s, r.n) for r in run(report, frames, joins).collect()} == {("x", 1), (None, 1)}
    assert {(r.s, r.n) for r in run(report, frames, joins, scope=F.col("s") == "x").collect()} == {("x", 1)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', None), (2, "", 1.5)], "i int, s string, v double")
    tables.csv_sink(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "csv")).orderBy("i").collect()
    assert [r.s for r in back][0] == 'a "b", c'
    assert tables.json_rows(df).orderBy("json").first()[0] == '{"i":1,"s":"a \\"b\\", c","v":null}'
    with pytest.raises(ValueError):
        tables.jdbc_options("oracle", "h", "1521")
    assert tables.jdbc_options("mssql", "h", "1433", "d")["url"] == "jdbc:sqlserver://h:1433;databaseName=d"


def test_read_only_statements(spark):
    text = {"select 1": True, "SELECT 'drop table x'": True, "select 1; select 2": False, "update t set a = 1": False, "with a as (select 1) delete from t": False, "select dropped from t;": True}
    got = spark.createDataFrame([(k,) for k in text], "t string").select("t", catalog.read_only(F.col("t")).alias("ok")).collect()
    assert {r.t: r.ok for r in got} == text


def test_the_stream_gives_the_windows_of_the_batch(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [(day + datetime.timedelta(hours=7 * i), "view" if i % 3 else "click", float(i)) for i in range(40)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    points = {}

    def write(batch, number):
        points.update({(r.event_type, r.period): (r.n, r.total) for r in batch.collect()})

    series.run(source, write, str(tmp_path / "checkpoint")).awaitTermination()
    want = {(r.event_type, r.period): (r.n, r.total) for r in series.windowed(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert points == want and len(want) > 10


def test_top_sections_cut_other_manuals_once(spark, capsys):
    texts = [(i, f"{i + 1}. Authority and responsibilities of branch\n{i + 1}.1 Duties\nThe {'branch ' * (i % 7)}files.\n{i + 1}.2 Other\nx") for i in range(30)]
    plain = spark.createDataFrame(texts, "doc_id long, text string")
    every = documents.scored(documents.sections(plain), "branch responsibilities").select("doc_id", "k", "title", "parent_title", "score")
    want = documents.with_siblings(every.filter("score > 0").orderBy(F.desc("score"), "doc_id", "k").limit(3), every).collect()
    top = documents.top_sections(plain, "branch responsibilities", 3)
    got = top.collect()
    assert sorted(got) == sorted(want) and len({r.doc_id for r in got}) == 3 and len(got) == 6
    capsys.readouterr()
    top.explain()
    assert capsys.readouterr().out.split("== Initial Plan ==")[-1].count("Generate") == 1  # the siblings', of the best sections' manuals only
    assert documents.top_sections(plain, "nothing asked", 3).collect() == []
