import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer
from tallyspark.llm import token_files
from tallyspark.llm.tokens import SpacedEncoder, WordEncoder, vocabulary

WORDS, BYTES = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
PLAIN = {WordEncoder: Tokenizer.from_file(WORDS), SpacedEncoder: Tokenizer.from_file(BYTES)}
ENCODERS = {WordEncoder: WordEncoder(WORDS), SpacedEncoder: SpacedEncoder(BYTES)}
TEXTS = st.lists(st.text(alphabet=st.sampled_from(list("ab Z9é漢\n\t 　'!<|endoftext|>\x1f\r.,")), max_size=30), max_size=6)


@pytest.mark.parametrize("kind", [WordEncoder, SpacedEncoder])
@settings(max_examples=150, deadline=None)
@given(texts=TEXTS)
def test_pieces_give_the_ids_of_the_whole_text(kind, texts):
    encoder = ENCODERS[kind]
    ids, start = encoder.encode(pa.array(texts, pa.string()))
    got = [ids[a:z].tolist() for a, z in zip(start[:-1], start[1:], strict=True)]
    assert got == [PLAIN[kind].encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("kind,path", [(WordEncoder, WORDS), (SpacedEncoder, BYTES)])
def test_strings_of_special_tokens(kind, path):
    text = "a <|endoftext|> b\n\n<|endoftext|>c"
    own = PLAIN[kind].token_to_id("<|endoftext|>")
    assert ENCODERS[kind].encode(pa.array([text]))[0].tolist().count(own) == 2
    ids = kind(path, special_strings=False).encode(pa.array([text]))[0]
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids and own not in ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 65_535), max_size=300), st.integers(1, 40), st.integers(0, 3))
def test_coder_round_trip(ids, times, tail):
    flat = np.array(ids * times + ids[:tail], dtype=np.uint32)
    assert (token_files.decoded(token_files.encoded(flat)) == flat).all()


def test_coder_shrinks_what_repeats_and_tells_damage():
    rng = random.Random(1)
    ids = np.array([rng.choice([5, 6, 7, 5, 6, 7, 9]) for _ in range(10_000)] * 2, dtype=np.uint32)
    data = token_files.encoded(ids)
    assert len(data) < 2 * len(ids)
    for at in (0, token_files.HEAD.size - 1, len(data) // 2):
        with pytest.raises((ValueError, IndexError)):
            token_files.decoded(data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :])


def test_blocks_are_independent():
    ids = np.arange(3 * token_files.BLOCK, dtype=np.uint32) % 700
    data = token_files.encoded(ids)
    _, _, words, _ = token_files.HEAD.unpack_from(data, 0)
    size = token_files.HEAD.size + 2 * words
    assert (token_files.decoded(data[size:]) == ids[token_files.BLOCK :]).all()
    assert (token_files.decoded(data[:size]) == ids[: token_files.BLOCK]).all()


def expected(texts):
    at, out = 0, []
    for doc, text in sorted(texts):
        ids = [*PLAIN[WordEncoder].encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files_read_back(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(60)))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "word " * 9000), (-4, "é漢 x")]
    rng.shuffle(docs)
    df = spark.createDataFrame([(i, t, "n") for i, t in docs], "doc_id long, text string, n_ids string").repartition(3)
    files = token_files.written(df, WORDS, 2, 9000)
    got = sorted(tuple(r) for r in token_files.read(files).collect())
    assert got == expected([(i, t or "") for i, t in docs])
    assert token_files.read(token_files.written(df.limit(0), WORDS, 2)).count() == 0


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(3, "a b"), (3, "a b"), (None, "c"), (1, None)], "doc_id long, text string")
    rows = token_files.read(token_files.written(df, WORDS, 2, 40)).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [(None, 0, 2), (1, 2, 1), (3, 3, 3), (3, 6, 3)]


def test_ids_that_do_not_fit_raise():
    with pytest.raises(ValueError, match="65536"):
        token_files.encoded(np.array([1, 65_536], np.uint32))


def test_smaller_than_zlib():
    text = pq.read_table("/root/testdata/sf0.01/documents.parquet").sort_by("doc_id").column("text").combine_chunks()
    ids = ENCODERS[WordEncoder].encode(text)[0]
    data = token_files.encoded(ids)
    assert len(data) < 0.95 * len(zlib.compress(ids.astype("<u2").tobytes(), 9))
    assert (token_files.decoded(data) == ids).all()


def test_the_model_adapts_at_every_id():
    mixer = token_files.Mixer(1)
    freqs = []
    for i in range(12):
        freqs.append(int(mixer.predict()[0]))
        mixer.update(np.array([0]), np.array([3 if i == 0 else 0]))
    assert len(set(freqs[3:])) == 9


def test_every_event_keeps_the_least_frequency():
    mixer = token_files.Mixer(1)
    for i in range(3000):
        mixed = mixer.predict()
        end = 0
        for e in range(4):
            start, part = token_files._bounds(mixed, np.array([e]))
            assert part[0] >= token_files._LEAST and start[0] == end
            end = start[0] + part[0]
        assert end == 1 << token_files.BITS
        mixer.update(np.array([7 if i < 2000 else i]), np.array([0 if i < 2000 else 3]))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, token_files.BLOCK - 1), min_size=3, max_size=3), min_size=1, max_size=40))
def test_counts_are_those_of_a_plain_count(rows):
    counts, plain = token_files.Counts(3), np.zeros((3, token_files.BLOCK), np.int64)
    for row in rows:
        place = np.array(row)
        below, own = counts.span(place)
        assert below.tolist() == [plain[j, :p].sum() for j, p in enumerate(row)] and own.tolist() == [plain[j, p] for j, p in enumerate(row)]
        counts.add()
        plain[np.arange(3), place] += 1
    for target in range(len(rows)):
        want = [int(np.searchsorted(plain[j].cumsum(), target, side="right")) for j in range(3)]
        assert counts.find(np.full(3, target, np.uint16)).tolist() == want


@pytest.mark.parametrize("blocks", [0, 1, 3, 4, 5, 6, 7, 9, 10, 11, 40])
def test_no_few_blocks_are_left_over_for_a_call(blocks, monkeypatch):
    monkeypatch.setattr(token_files, "LANES", 4)
    parts = token_files.side_by_side(blocks)
    assert [i for a, z in parts for i in range(a, z)] == list(range(blocks))
    assert all(2 * (z - a) <= 3 * 4 for a, z in parts) and (len(parts) == 1 or all(z - a >= 3 for a, z in parts))


def test_blocks_of_a_segment_share_calls_and_are_the_same_in_any(monkeypatch):
    ids = np.arange(5 * token_files.BLOCK - 7, dtype=np.uint32) % 900
    one = token_files.encoded(ids)
    calls = []
    for name in ("_encoded", "_decoded"):
        monkeypatch.setattr(token_files, name, lambda *a, f=getattr(token_files, name): calls.append(1) or f(*a))
    monkeypatch.setattr(token_files, "LANES", 4)
    assert token_files.encoded(ids) == one and (token_files.decoded(one) == ids).all()
    assert len(calls) == 2
    monkeypatch.setattr(token_files, "LANES", 2)
    assert token_files.encoded(ids) == one and (token_files.decoded(one) == ids).all()


def test_what_a_place_needs_is_in_one_line_of_the_cache():
    counts = token_files.Counts(5)
    for place in (0, 1, 7, 8, 511, token_files.BLOCK - 1):
        at = counts.at(np.full(5, place))
        lines = [(x.ctypes.data + 2 * at) // 64 for x in (counts.before[-1], counts.own, counts.last, counts.ids)]
        assert all((x == lines[0]).all() for x in lines) and len(set(lines[0].tolist())) == 5


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(1, 2**64 - 1)), min_size=1, max_size=20))
def test_words_leave_lane_by_lane(rows):
    low, width = (np.array(x, np.uint64) for x in zip(*[(a, min(b, 2**64 - 1 - a) or 1) for a, b in rows]))
    left: list[list[int]] = [[] for _ in rows]
    want = []
    for lo, wide in zip(low.tolist(), width.tolist()):
        words = []
        while (settled := (lo ^ ((lo + wide) % 2**64)) < 2**48) or wide < 2**40:
            wide = wide if settled else -lo % 2**40
            words.append(lo >> 48)
            lo, wide = (lo << 16) % 2**64, (wide << 16) % 2**64
        want.append(words)

    def step(lanes, lo):
        for j, x in zip(lanes.tolist(), lo.tolist(), strict=True):
            left[j].append(x >> 48)

    token_files._shifted(low, width, step)
    assert left == want
