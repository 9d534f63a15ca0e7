"""Token files: an exact round trip, ids of the tokenizer itself, and rows of every awkward kind."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkseries.llm import token_files
from sparkseries.llm.packing import ByteBpe
from sparkseries.llm.queries import QUERIES
from sparkseries.llm.token_files import TokenFiles, write_token_files

SF_DIR = "/root/testdata/sf0.01"
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BPE)


def ids_of(tokenizer, text, end=2):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_query_matches_the_tokenizer(spark, duck, tokenizer):
    got = {r.doc_id: r for r in QUERIES["op13_token_files"](spark, SF_DIR).collect()}
    docs = duck(f"select doc_id, text from '{SF_DIR}/documents.parquet' order by doc_id")
    assert len(got) == len(docs)
    start = 0
    for doc, text in docs:
        ids = ids_of(tokenizer, text)
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert tuple(got[doc]) == (doc, start, len(ids), crc)
        start += len(ids)


ODD = [
    (3, "plain words", "x"), (1, None, "x"), (2, "", "x"), (None, "no id", "x"), (None, "no id", "x"),
    (7, "a <|endoftext|>  b<|endoftext|>", "x"), (7, "a <|endoftext|>  b<|endoftext|>", "x"), (7, "other", "x"),
    (5, "  \n\t wide   spaces   ", "x"), (6, "日本語 текст 😀", "x"), (8, "long words " * 200_000, "x"),
]


def odd(spark, rows=ODD):
    return spark.createDataFrame(
        [(*r, 1, 2) for r in rows], "doc_id long, text string, frame string, n int, start int"
    )


@pytest.mark.parametrize("shard_tokens", [1 << 26, 50])
def test_round_trip_of_odd_rows(spark, tmp_path, tokenizer, shard_tokens):
    files = write_token_files(odd(spark), BPE, str(tmp_path / "f"), shard_tokens=shard_tokens)
    rows = sorted(files.read().collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == [None, None, 1, 2, 3, 5, 6, 7, 7, 7, 8]
    assert sorted(map(str, (r.ids for r in rows))) == sorted(str(ids_of(tokenizer, t)) for _, t, _ in ODD)
    assert [r.start for r in rows] == list(np.cumsum([0, *(len(r.ids) for r in rows)])[:-1])
    again = TokenFiles(spark, files.folder)
    few = again.read(where="doc_id in (5, 7) and n_ids > 2").collect()
    assert sorted(r.doc_id for r in few) == [5, 7, 7, 7][:len(few)] and len(few) >= 3
    as_bytes = {r.start: r.ids for r in again.read(form="bytes").collect()}
    assert all(list(np.frombuffer(as_bytes[r.start], "<u4")) == r.ids for r in rows)


def test_empty_table(spark, tmp_path):
    files = write_token_files(odd(spark).limit(0), BPE, str(tmp_path / "f"))
    assert files.read().collect() == [] and files.index().count() == 0


def test_null_texts_alone(spark, tmp_path):
    files = write_token_files(odd(spark, [(2, None, ""), (1, "", "")]), BPE, str(tmp_path / "f"))
    assert sorted((r.doc_id, r.start, r.ids) for r in files.read().collect()) == [(1, 0, [2]), (2, 1, [2])]


def test_another_dictionary_is_refused(spark, tmp_path):
    files = write_token_files(odd(spark), BPE, str(tmp_path / "f"))
    files.dictionary = b"another dictionary"
    with pytest.raises(Exception, match="another dictionary"):
        files.read().collect()


def test_dictionary_is_trained_and_saves_room(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("octet_length(text) < 1000")
    files = write_token_files(docs, BPE, str(tmp_path / "f"))
    assert files.trained and files.id_bytes == 2
    none = write_token_files(docs, BPE, str(tmp_path / "g"), samples=0)
    assert none.dictionary == b""
    size = lambda f: f.index().agg({"bytes": "sum"}).first()[0]
    assert size(files) < 0.95 * size(none)


def test_lookup_filters_the_sorted_index(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    files = write_token_files(docs, BPE, str(tmp_path / "f"))
    plan = files.index().where("doc_id = 77")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,77)" in plan
    assert files.read("doc_id = 77").count() == docs.where("doc_id = 77").count()


def test_long_frames_are_given_out_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "READ_BYTES", 64)
    files = write_token_files(odd(spark), BPE, str(tmp_path / "f"))
    assert files.read().count() == len(ODD)


def test_ids_equal_those_of_the_tokenizer(tokenizer):
    draw = np.random.default_rng(4)
    parts = ["a", " ", "  ", "\n", "é", "<|endoftext|>", "don't", "12", "　", "!", "<|", "endoftext|>"]
    cached = ByteBpe(BPE)
    for _ in range(3000):
        text = "".join(parts[i] for i in draw.integers(0, len(parts), draw.integers(0, 12)))
        assert list(cached.ids(text)) == tokenizer.encode(text, add_special_tokens=False).ids
