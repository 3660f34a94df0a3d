import zlib

import corpus_pipeline
from tallyspark.llm import decontaminate, langid, packing, queries, toxicity
from tallyspark.llm.tables import table
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_one_after_the_other(spark):
    """Each stage drops what a plain version drops from what its predecessor kept."""
    docs = table(spark, SF, "documents")
    columns = docs.columns
    start = {r.doc_id: r for r in docs.collect()}
    model = langid.fit(docs.filter("crc32(cast(doc_id as string)) % 3 <> 1"))
    und = {r.doc_id for r in langid.predict(docs, model).collect() if r.lang_pred == "und"}
    toxic = {r.doc_id for r in toxicity.scored(docs, queries.toxicity_lexicon(spark, SF)).collect() if r.score >= toxicity.THRESHOLD}
    left = set(start) - und - toxic
    cluster = brute.clusters([(i, start[i].text) for i in sorted(left)])
    left = {i for i in left if cluster[i][1] == i}
    hits = brute.decontaminated([(i, start[i].text) for i in left], [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])
    left = {i for i in left if not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])}

    rows = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF)
        assert rows.columns == columns
    assert {r.doc_id for r in rows.collect()} == left
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == left
    by = {}
    for r in out:
        by[r.sequence_id] = by.get(r.sequence_id, 0) + r.length
    assert max(by.values()) <= packing.CAPACITY


def test_stages_take_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, None, None), (None, "Some words of a text", "en", "s", 3), (3, "", "en", "s", 0), (4, "Some words of a text", "en", "s", 3), (4, "Some words of a text", "en", "s", 3)],
        table(spark, SF, "documents").schema,
    )
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
        assert rows.count() >= 0
