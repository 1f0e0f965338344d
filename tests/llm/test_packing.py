import functools
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tintframe.llm import packing, tokens


@functools.cache
def plain_tokenizer():
    return Tokenizer.from_file(tokens.default_path())


def whole_ids(texts, end=1):
    plain = plain_tokenizer()
    return [plain.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def check(rows, docs, length):
    want = dict(zip((d for d, _ in docs), whole_ids([t for _, t in docs]), strict=True))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == want.keys()
    for doc_id, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            ids = np.array(want[doc_id][p.start : p.start + p.length], "<u4").tobytes()
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids) and p.doc_tokens == len(want[doc_id])
            assert p.ids is None or bytes(p.ids) == ids
            at += p.length
        assert at == len(want[doc_id])
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= length
        padding += length - at
    return padding / (length * len(by_seq)), len(by_seq)


def test_every_id_is_in_one_piece(spark):
    docs = [(i, " ".join(f"word{j * i % 97} ça!" for j in range(i * 7 % 400))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "x" * 30_000), (1003, "A\x1cb\x85 c d <|endoftext|> I'm Été ΣΑΣ"), (1004, " \n\t ")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    rows = packing.pack(df, length=256, keep_open=4, max_gap=4, fan_in=3).collect()
    share, n = check(rows, docs, 256)
    assert share < 0.02 and n > 100


def test_rows_repeat_and_extra_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, "a b c", 5, 7)] * 3, "doc_id long, text string, length int, ids int")
    rows = packing.pack(df, length=8).collect()
    assert len(rows) >= 3 and sum(r.length for r in rows) == 12


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@given(st.lists(st.text(alphabet="aA'sStTreé É<|>.,1²ºªµßŉſİŒœ\x1c\x85\xa0\n\x00\u0301日Σ", max_size=12), max_size=4))
@settings(max_examples=400, deadline=None)
def test_pieces_give_the_ids_of_the_whole(texts):
    own = tokens.tokenizer(tokens.default_path())
    assert own.by_piece
    assert [list(np.frombuffer(b, "<u4")) + [1] for b in own.encode(texts)] == whole_ids(texts)


def test_another_tokenizer_encodes_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(path), tokens.WordTokenizer(path)
    texts = ["Hello  world", "", "one\ntwo 33"]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("limit", [0, 5, 10_000])
def test_word_cache_does_not_change_ids(limit):
    own = tokens.WordTokenizer(tokens.default_path(), limit)
    texts = ["Hello world don't", "hello  world\nétait 12345 ...", "", "w" * 300]
    for _ in range(2):
        got = [list(np.frombuffer(b, "<u4")) + [1] for b in own.encode(texts)]
        assert got == whole_ids(texts)
    assert len(own.known) <= limit
