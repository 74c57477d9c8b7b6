import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from orrerylake.llm import queries
from orrerylake.llm import token_files as T

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab'stmdrevlSé1½ٳ \n\t\r\x0b\x0c\x85　​.!?日😀")), max_size=25), max_size=6))
def test_encoder_equals_library(texts):
    own = T.encoder(PATH)
    assert [x.tolist() for x in own.encode(texts)] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), max_size=8), st.integers(2, 5))
def test_repair_round_trip(documents, least):
    ids = [np.array(d, np.int32) for d in documents]
    old, T.LEAST_COUNT = T.LEAST_COUNT, least
    try:
        file = T.TokenFile.from_bytes(T.TokenFile.of(ids, 6).to_bytes())
    finally:
        T.LEAST_COUNT = old
    flat = [x for d in documents for x in [*d, T.END_ID]]
    assert file.expand(file.symbols).tolist() == flat
    assert file.counts().tolist() == [len(d) + 1 for d in documents]
    for i, d in enumerate(documents):
        assert file.document(i).tolist() == [*d, T.END_ID]
    for a in range(0, len(flat), 7):
        assert file.stretch(a, min(len(flat), a + 11)).tolist() == flat[a : a + 11]


def test_repair_compresses():
    words = [np.array([7, 8, 9, 10, 11] * 40, np.int32)] * 30
    file = T.TokenFile.of(words, 100)
    assert len(file.symbols) < sum(map(len, words)) / 4 and len(file.rules)


def test_query_equals_library(spark, library):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    got = sorted(queries.op7_token_files(spark, SF).collect(), key=lambda r: r.doc_id)
    start = 0
    for d, g in zip(docs, got, strict=True):
        ids = np.array([*library.encode(d.text, add_special_tokens=False).ids, 2], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_edge_cases(spark, tmp_path):
    long = "river 42 " * 30_000
    rows = [(5, None, 1), (3, "", 1), (None, "a", 1), (4, long, 1), (4, long, 1), (1, "x <|endoftext|> y", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, part int")
    T.write_files(docs, str(tmp_path / "f"), PATH, file_ids=20_000, task_bytes=100_000)
    got = sorted(T.read_digests(spark, str(tmp_path / "f")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 3, 4, 4, 5]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert got[2].n_tokens == got[5].n_tokens == 1 and got[3].ids_crc32 == got[4].ids_crc32
    T.write_files(docs.limit(0), str(tmp_path / "none"), PATH)
    assert T.read_digests(spark, str(tmp_path / "none")).count() == 0
