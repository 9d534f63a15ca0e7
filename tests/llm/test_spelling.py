"""Spelling variants against a plain search of every edit, and on awkward rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sparkseries.llm import spelling
from sparkseries.llm.queries import QUERIES
from sparkseries.llm.spelling import neighbours, numbered, rotations, variants, words_of

SF_DIR = "/root/testdata/sf0.01"


def plain_words(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_near(words):
    """Neighbours by trying every deletion of a word, and by equal deletions of two."""
    holes = {}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1:]), set()).add(w)
    near = {w: set() for w in words}
    for (a, b), group in holes.items():
        if a + b in words:
            near[a + b] |= group
            for w in group:
                near[w].add(a + b)
        for w in group:
            near[w] |= group - {w}
    return near


def plain_variants(words):
    near = plain_near(words)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {
        w: (n, len(near[w]), form.get(w), words.get(form.get(w)), root(w)) for w, n in words.items()
    }


def rows(df):
    got = [(r.word, (r.n, r.n_near, r.form, r.form_n, r.root)) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def test_query_matches_brute_force(spark, duck):
    want = plain_variants(plain_words(duck(f"select doc_id, text from '{SF_DIR}/documents.parquet'")))
    got = rows(QUERIES["op11_spelling"](spark, SF_DIR))
    assert got == want
    assert sum(w[2] is not None for w in got.values()) > 100


def random_words(seed, alphabet="abé", sizes=(1, 7)):
    draw = np.random.default_rng(seed)
    return {
        "".join(alphabet[i] for i in draw.integers(0, len(alphabet), draw.integers(*sizes))):
        int(10 ** draw.uniform(0, 5))
        for _ in range(300)
    }


@pytest.mark.parametrize("limit", [64, 4, 1])
def test_dense_words_and_long_keys(spark, monkeypatch, limit):
    """Most words are near many others; with a low limit the rotations are residues."""
    monkeypatch.setattr(spelling, "TEXT_POINTS", limit)
    words = random_words(limit)
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(variants(table)) == plain_variants(words)
    ids = numbered(table)
    place = {r.wid: r.word for r in ids.collect()}
    assert [place[i] for i in sorted(place)] == sorted(words)
    pairs = [(place[r.wid], place[r.near_wid]) for r in neighbours(ids).collect()]
    assert sorted(pairs) == sorted((w, o) for w, near in plain_near(words).items() for o in near)


def test_chain_of_forms(spark):
    chain = {"a" * 7 + "b" * i: 10 ** i for i in range(9)}
    got = rows(variants(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert got == plain_variants(chain)
    assert got["a" * 7][4] == "a" * 7 + "b" * 8


def test_very_long_words(spark):
    words = {"z" * 63: 4, "z" * 64: 40, "z" * 65: 2, "z" * 66: 400}
    long = "abcdefghij" * 20_000
    shorter, other = long[:777] + long[778:], long[:-1] + "x"
    table = spark.createDataFrame([*words.items(), (long, 50), (shorter, 3), (other, 6)], "word string, n long")
    assert rows(variants(table)) == plain_variants(words) | {
        long: (50, 2, None, None, long), shorter: (3, 1, long, 50, long), other: (6, 1, None, None, other),
    }


def test_groups_are_small(spark):
    """A group holds a word for each character and one more, however many words share its parts."""
    words = [("word" + c + "ending", 5) for c in "abcdefghijklmnopqrstuvwxyz"] + [("wordending", 5)]
    table = numbered(spark.createDataFrame(words, "word string, n long"))
    assert rotations(table).groupBy("key").count().agg({"count": "max"}).first()[0] == 27


def test_odd_documents(frame):
    docs = [
        (1, None, "", ""), (2, "", "", ""), (None, "Readable READABLE readable", "", ""),
        (3, "École-élève École-élève écolière écolière", "", ""), (3, "short 123 日本語日本語日本語", "", ""),
        (4, "x" * 2000 + " " + "x" * 2000, "", ""), (4, "readible readible", "", ""),
    ]
    want = plain_words([(d, t) for d, t, *_ in docs])
    assert {r.word: r.n for r in words_of(frame(docs)).collect()} == want
    assert rows(variants(words_of(frame(docs)))) == plain_variants(want)
    assert variants(words_of(frame(docs).limit(0))).collect() == []
