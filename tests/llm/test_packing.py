import random
import zlib
from collections import defaultdict

import numpy as np

from tallyspark.llm import packing
from tallyspark.llm.tables import saved
from tallyspark.llm.tokens import vocabulary

BYTES = vocabulary("byte_bpe_50k.json")


def packed(spark, docs, capacity=packing.CAPACITY):
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, sequence_id int").repartition(3)
    cut = saved(packing.pieces(df, BYTES, 0, capacity), "test-pieces")
    return packing.packed(cut, ["doc_id"], capacity).collect()


def holds(rows, capacity=packing.CAPACITY):
    """Sequences are gapless and not over capacity; gives how many there are."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    docs = [(1, "hello  world\n"), (2, None), (3, ""), (4, "tok " * 5000), (5, "é漢字 <|endoftext|>"), (5, "é漢字 <|endoftext|>")]
    rows = packed(spark, docs)
    holds(rows)
    want = []
    for doc, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) - (-(-len(ids) // 2048) - 1) * 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        want += [(doc, k, a, z - a, zlib.crc32(np.array(ids[a:z], "<u4").tobytes())) for k, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)


def test_few_sequences(spark):
    """Within 2 per cent of the least that the sum of lengths allows, where small pieces abound."""
    rng = random.Random(2)
    docs = [(i, "a " * int(rng.lognormvariate(5, 1.2))) for i in range(1500)]
    rows = packed(spark, docs)
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    assert holds(rows) <= 1.02 * -(-sum(r.length for r in rows) // packing.CAPACITY) + 1


def test_large_pieces_only(spark):
    docs = [(i, "a " * n) for i, n in enumerate([1500] * 10 + [500] * 10 + [1024] * 4 + [2047] * 3)]
    assert holds(packed(spark, docs)) <= 17


def test_empty_table(spark):
    assert packed(spark, []) == []


def test_configurations_use_every_size_up():
    rng = random.Random(4)
    left = {rng.randrange(193, 2049): rng.randrange(1, 40) for _ in range(60)}
    used = defaultdict(int)
    for times, sizes in packing.configurations(left, 2048):
        assert sum(sizes) <= 2048
        for s in sizes:
            used[s] += times
    assert used == left
