"""Alignment against a plain walk over bytes, and on awkward rows."""

import hashlib
import tracemalloc
from bisect import bisect_left
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sparkseries.llm import alignment
from sparkseries.llm.alignment import align, groups, overlaps, ranks
from sparkseries.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def plain():
    """``(groups, links)`` of a text, by a walk over the bytes of both."""
    tok_a = Tokenizer.from_file(A)
    tok_a.encode_special_tokens = True
    tok_b = sentencepiece.SentencePieceProcessor(model_file=B)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}

    def of(text):
        if not text:
            return "", []
        want = (" " + text).encode()
        ids_a = tok_a.encode(" " + text, add_special_tokens=False).ids
        ids_b = tok_b.encode(text)
        bytes_a = [bytes(byte_of[c] for c in tok_a.id_to_token(i)) for i in ids_a]
        bytes_b = []
        for i in ids_b:
            piece = tok_b.id_to_piece(i)
            is_byte = len(piece) == 6 and piece.startswith("<0x") and tok_b.is_byte(i)
            bytes_b.append(bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode())
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            return "", []
        owner_a = [k for k, t in enumerate(bytes_a) for _ in t]
        owner_b = [k for k, t in enumerate(bytes_b) for _ in t]
        links = sorted(set(zip(owner_a, owner_b)))
        out, left, right = [], [], []
        for at in range(len(want)):
            if owner_a[at] not in left:
                left.append(owner_a[at])
            if owner_b[at] not in right:
                right.append(owner_b[at])
            if at + 1 == len(want) or (owner_a[at + 1] != owner_a[at] and owner_b[at + 1] != owner_b[at]):
                out.append(",".join(str(ids_a[k]) for k in left) + "|" + ",".join(str(ids_b[k]) for k in right))
                left, right = [], []
        return ";".join(out), [(ids_a[i], ids_b[j]) for i, j in links]

    return of


def expected(plain, docs):
    done = [(doc, *plain(text)) for doc, text in docs]
    counts = Counter(link for _, _, links in done for link in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    rows = []
    for doc, text, links in done:
        parts = text.split(";") if text else []
        n_a = sum(p.split("|")[0].count(",") + 1 for p in parts)
        n_b = sum(p.split("|")[1].count(",") + 1 for p in parts)
        rows.append((
            doc, n_a, n_b, len(parts), len(links), sum(counts[x] == most[x[1]] for x in links),
            sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return rows


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def rows(df, last="groups"):
    return sorted((tuple(r[c] for c in [*NAMES, last]) for r in df.collect()), key=str)


def test_query_matches_brute_force(spark, duck, plain):
    docs = duck(f"select doc_id, text from '{SF_DIR}/documents.parquet'")
    got = rows(QUERIES["op12_alignment"](spark, SF_DIR), "groups_sha256")
    assert got == sorted(expected(plain, docs), key=str)
    assert all(n_links == n_a + n_b - n for _, n_a, n_b, n, n_links, *_ in got)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a  b\n\t c "), (5, "<|endoftext|> <s> </s> <unk> <0x41>"), (6, "▁ has the mark"),
    (7, "日本語 текст 😀 é é"), (8, "nul \x00 and \x7f"), (None, "no id"), (None, "no id"), (9, "a"), (9, "word " * 40_000),
    (10, "x" * 3000),
]


def odd(spark, rows=ODD):
    return spark.createDataFrame(
        [(*r, "x", 1, "y") for r in rows], "doc_id long, text string, links string, n int, block string"
    )


@pytest.mark.parametrize("block_bytes", [4 << 20, 10])
def test_odd_rows_and_small_blocks(spark, plain, monkeypatch, block_bytes):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block_bytes)
    want = sorted(expected(plain, ODD), key=str)
    assert rows(align(odd(spark), A, B, digest=True)) == want
    texts = {plain(t)[0] for _, t in ODD}
    assert {r.groups for r in groups(odd(spark), A, B).collect()} == texts


def test_groups_as_text_and_empty_tables(spark, plain):
    got = {r.groups for r in align(odd(spark), A, B).collect()}
    assert got == {plain(t)[0] for _, t in ODD}
    assert align(odd(spark).limit(0), A, B).collect() == []
    only = align(odd(spark, [(1, None), (2, "")]), A, B, digest=True)
    assert rows(only) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_galloping_ranks():
    draw = np.random.default_rng(2)
    for _ in range(300):
        longer = np.unique(draw.integers(0, 5000, draw.integers(1, 900)))
        driving = np.unique(draw.integers(0, 5200, draw.integers(0, 900)))
        assert ranks(driving, longer).tolist() == [bisect_left(longer.tolist(), d) for d in driving.tolist()]


def test_overlaps_of_random_cuts():
    draw = np.random.default_rng(3)
    for _ in range(300):
        size = int(draw.integers(1, 60))
        a, b = (np.unique([*draw.integers(1, size + 1, draw.integers(0, size)), size]) for _ in range(2))
        owner = [np.searchsorted(ends, np.arange(size), "right") for ends in (a, b)]
        want = sorted(set(zip(owner[0].tolist(), owner[1].tolist())))
        common_a, common_b, link_a, link_b = overlaps(a, b)
        assert list(zip(link_a.tolist(), link_b.tolist())) == want
        assert a[common_a].tolist() == b[common_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_a_block_holds_two_megabytes_of_text(spark):
    """A task's memory follows its block: about 80 bytes for each byte of text."""
    text = "plain words of a text " * 2000
    docs = spark.createDataFrame([(i, text) for i in range(60)], "doc_id long, text string").coalesce(1)
    blocks = alignment._blocks(docs, A, B, "doc_id", "text").selectExpr("size(docs) as n").collect()
    assert sum(r.n for r in blocks) == 60
    assert max(r.n for r in blocks) * len(text) < (2 << 20) + len(text)


def random_texts(many, words):
    draw = np.random.default_rng(4)
    stock = ["plain", "tokenizer", "αβγ", "😀", "isn't", "3.14", "\t", "wörter", "x_y", "", "<s>"]
    return [" ".join(draw.choice(stock, int(draw.integers(0, words)))) for _ in range(many)]


@pytest.mark.parametrize("digest", [False, True])
def test_a_block_of_pieces_is_the_block_of_all_texts(digest):
    pair = alignment.Pair(A, B)
    texts = ["", *random_texts(60, 200), "", "", "word " * 900, ""]
    documents, *numbers = pair.block(texts)
    if digest:
        documents = [(*d[:4], hashlib.sha256(d[4].encode()).hexdigest() if d[4] else "") for d in documents]
    for piece_bytes in (1, 700, 1 << 20):
        block = alignment.Block(pair, piece_bytes, digest)
        for k, text in enumerate(texts):
            block.add(k, text)
        got, *own = block.end()
        assert got == documents and block.size == sum(len(t.encode()) for t in texts)
        assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(own, numbers))


def test_a_task_holds_the_tokens_of_a_piece_only():
    """Two megabytes of text took 175 MB of Python's memory when a block was worked on as a whole."""
    pair = alignment.Pair(A, B)
    texts = random_texts(400, 1900)
    assert sum(len(t.encode()) for t in texts) > 1_500_000
    tracemalloc.start()
    block = alignment.Block(pair, alignment.PIECE_BYTES, digest=True)
    for k, text in enumerate(texts):
        block.add(k, text)
    block.end()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def test_small_pieces_and_digests_of_the_task(spark, plain, monkeypatch):
    monkeypatch.setattr(alignment, "PIECE_BYTES", 10)
    assert rows(align(odd(spark), A, B, digest=True)) == sorted(expected(plain, ODD), key=str)
    texts = {plain(t)[0] for _, t in ODD}
    assert {r.groups for r in align(odd(spark), A, B).collect()} == texts
    hashes = {hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts}
    blocks = alignment._blocks(odd(spark), A, B, "doc_id", "text", digest=True)
    assert {r.groups for r in blocks.selectExpr("inline(docs)").collect()} == hashes
