"""Language of texts, also mixed ones: script ranges, word scores and Viterbi.

Words are runs of letters and combining marks of one script that hold a letter. A word's score for a
language is the sum of the log probabilities of its letter trigrams, word borders included, among the
languages that were seen in its script. Viterbi with a penalty for each switch labels the words; words
in a row with one label are a span, and a text has the language with the most letters. Words in a script
that no language was seen in are spans of ``und``, and their letters count for all languages alike.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_of
from .quality import held_out
from .viterbi import best_paths

# Letter ranges of scripts; letters elsewhere are one more script.
SCRIPTS = [
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x0370, 0x03FF),
    ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF),
    ("Arabic", 0x0600, 0x077F), ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF),
    ("Gurmukhi", 0x0A00, 0x0A7F), ("Gujarati", 0x0A80, 0x0AFF), ("Tamil", 0x0B80, 0x0BFF),
    ("Telugu", 0x0C00, 0x0C7F), ("Kannada", 0x0C80, 0x0CFF), ("Malayalam", 0x0D00, 0x0D7F),
    ("Thai", 0x0E00, 0x0E7F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF),
    ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
    ("Han", 0x20000, 0x3FFFF),
]
NAMES = list(dict.fromkeys(name for name, _, _ in SCRIPTS)) + ["Other"]
TRIGRAM_BITS = 17
PIECE = 1 << 20  # characters laid out at a time
BATCH_CHARS = 1 << 21  # characters of the texts that advance through Viterbi together
FLOOR = -15.0  # what one word can speak against a language at most
SWITCH = 8.0
# Ids of texts to learn from that are sent to every task, a few MB.
BROADCAST_IDS = 100_000


def letter_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point its script (0: no part of a word), lower-case form and whether it is a letter."""
    script, letter = np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x40000):
        char = chr(c)
        if char.isalpha() or c > 127 and unicodedata.category(char)[0] == "M":
            script[c], letter[c] = len(NAMES), char.isalpha()
            small = char.lower()
            if len(small) == 1:
                lower[c] = ord(small)
    for name, first, last in SCRIPTS:
        part = script[first:last + 1]
        part[part > 0] = NAMES.index(name) + 1
    return script, lower, letter


class Words:
    """Words of texts: their scripts, letters and trigrams."""

    def __init__(self) -> None:
        self.script, self.lower, self.letter = letter_tables()

    def of(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """``(text, script, letters, begin, end)`` of each word and ``(trigram, word start)`` of its signs.

        A word of marks alone has no letters. Begin and end count from the start of the text.
        """
        data = "\0".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass")
        points = np.minimum(np.frombuffer(data, np.uint32), 0x10FFFF)
        script = self.script[points]
        at = np.nonzero(script)[0]
        empty = np.zeros(0, np.int64)
        if not len(at):
            return (empty,) * 7
        low = np.where(script > 0, self.lower[points], 0).astype(np.uint32)
        trigram = (
            low[at - 1] * np.uint32(0x9E3779B1) ^ low[at] * np.uint32(0x85EBCA6B)
            ^ low[at + 1] * np.uint32(0xC2B2AE35)
        )
        trigram = (trigram ^ trigram >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - TRIGRAM_BITS)
        own = script[at]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (own[1:] != own[:-1])
        start = np.nonzero(new)[0]
        borders = np.cumsum([0] + [len(t) + 1 for t in texts])
        text = np.searchsorted(borders[1:], at[start] - 1, side="right")
        begin = at[start] - 1 - borders[text]
        return (
            text, own[start].astype(np.int64), np.add.reduceat(self.letter[points[at]].astype(np.int64), start),
            begin, begin + np.diff(np.append(start, len(at))), trigram, start,
        )


class Model:
    """Trigram log probabilities of languages, and the scripts that they use."""

    def __init__(self, words: Words, texts: list[str], langs: list[str]) -> None:
        self.langs, self.words = sorted(set(langs)), words
        n = len(self.langs)
        counts = np.zeros((1 << TRIGRAM_BITS, n))
        scripts = np.zeros((len(NAMES) + 1, n))
        for k, lang in enumerate(self.langs):
            for text, of in zip(texts, langs):
                if of == lang:
                    _, script, letters, _, _, trigram, _ = words.of([text])
                    np.add.at(counts[:, k], trigram, 1)
                    np.add.at(scripts[:, k], script, letters)
        seen = (counts.sum(1) > 0).sum() + 1
        self.table = np.log((counts + 0.3) / (counts.sum(0) + 0.3 * seen)).astype(np.float32)
        self.allowed = scripts > 0.01 * np.maximum(scripts.sum(0), 1)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, list[list[tuple[int, int, str]]]]:
        """Language, share of the letters and spans ``(start, end, language)`` of each text."""
        names, share = ["und"] * len(texts), np.zeros(len(texts))
        spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        if not self.langs:
            return names, share, spans
        pieces, owner, begins = [], [], []
        for k, text in enumerate(texts):
            at = 0
            while at < len(text):
                end = min(len(text), at + PIECE)
                if end < len(text):
                    end = max(text.rfind(" ", at + 1, end), at) + 1 if " " in text[at + 1:end] else end
                pieces.append(text[at:end])
                owner.append(k)
                begins.append(at)
                at = end
        found = []
        i = 0
        while i < len(pieces):
            j, size = i, 0
            while j < len(pieces) and (j == i or size + len(pieces[j]) <= PIECE):
                size += len(pieces[j])
                j += 1
            text, script, letters, begin, end, trigram, start = self.words.of(pieces[i:j])
            if letters.any():
                word = np.add.reduceat(self.table[trigram], start, axis=0)
                allowed = self.allowed[script]
                known = allowed.any(1)
                word = np.where(allowed, word, -1e9)
                word = np.maximum(word - word.max(1, keepdims=True), FLOOR)
                word[~known] = 0
                first = np.asarray(begins[i:j])[text]
                rows = (np.asarray(owner[i:j])[text], word.astype(np.float32), letters, known, first + begin, first + end)
                found.append([r[letters > 0] for r in rows])
            i = j
        if found:
            doc, scores, letters, known, begin, end = (np.concatenate(r) for r in zip(*found))
            n = len(self.langs)
            change = np.full((n, n), -SWITCH, np.float32)
            np.fill_diagonal(change, 0)
            edges = np.nonzero(np.diff(doc, prepend=-1))[0]
            label = best_paths(scores, np.diff(np.append(edges, len(doc))), change).astype(np.int64)
            total = np.zeros((len(texts), n))
            np.add.at(total, (doc[known], label[known]), letters[known])
            np.add.at(total, doc[~known], letters[~known, None] / n)
            for k in np.unique(doc):
                best = int(total[k].argmax())
                names[k], share[k] = self.langs[best], total[k, best] / total[k].sum()
            label[~known] = n
            new = (np.diff(doc, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0)
            head = np.nonzero(new)[0]
            last = np.append(head[1:], len(doc)) - 1
            called = [*self.langs, "und"]
            for k, first, until, name in zip(doc[head], begin[head], end[last], label[head]):
                spans[k].append((int(first), int(until), called[name]))
        return names, share, spans


def train(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = 400
) -> Model:
    """A model of at most ``rows`` texts of each language, those of the least hashes of the id.

    Held-out ids and null languages teach nothing.
    """
    first = Window.partitionBy("lang").orderBy("order", "key")
    known = (
        docs.select(F.col(f"`{id}`").alias("key"), F.col(f"`{lang}`").alias("lang"))
        .where(F.col("lang").isNotNull() & F.col("key").isNotNull() & ~held_out("key"))
        .withColumn("order", F.xxhash64("key"))
        .withColumn("place", F.row_number().over(first)).where(F.col("place") <= rows)
        .select("key", "lang").distinct()
    )
    known = stored(known, "taught")
    if known.count() <= BROADCAST_IDS:  # beyond it the join is left to Spark
        known = F.broadcast(known)
    found = (
        docs.select(F.col(f"`{id}`").alias("key"), text_of(text).alias("text"))
        .join(known, "key").groupBy("key", "lang").agg(F.min("text").alias("text"))
        .orderBy("key", "lang").collect()  # at most ``rows`` texts of each language
    )
    return Model(Words(), [r["text"] for r in found], [r["lang"] for r in found])


def languages(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, spans`` for each row of ``docs``.

    ``spans`` are structs ``start, end, lang`` in order: code points from 0, end exclusive, from the
    first word of a language to its last before another's; ``und`` where no language was seen in the
    script. The score is the share of the letters that the predicted language's words hold, letters of
    unseen scripts dealt to all languages alike: a text without evidence scores one by their number.
    Null texts and those without letters (marks are none) are ``und`` with score 0 and no spans, as is
    everything if nothing can be learned. Repeated rows and null ids stay; of equal shares the first
    language by name wins. An empty table gives an empty result; other columns are not looked at.
    """
    model = train(docs, id, text, lang)

    @F.pandas_udf("lang string, score double, starts array<int>, ends array<int>, langs array<string>")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, names, scores, spans = list(part), [], [], []
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= BATCH_CHARS):
                    size += len(texts[j])
                    j += 1
                got = model.predict(texts[i:j])
                names += got[0]
                scores += got[1].tolist()
                spans += got[2]
                i = j
            yield pd.DataFrame({
                "lang": names, "score": scores,
                **{name: [[s[k] for s in of] for of in spans] for k, name in enumerate(("starts", "ends", "langs"))},
            })

    spans = F.expr("transform(got.starts, (s, i) -> named_struct('start', s, 'end', got.ends[i], 'lang', got.langs[i]))")
    return docs.select(
        F.col(f"`{id}`").alias("doc_id"), held_out(id).alias("held_out"),
        predict(text_of(text)).alias("got"),
    ).select(
        "doc_id", "held_out", F.col("got.lang").alias("lang_pred"), F.col("got.score").alias("score"),
        spans.alias("spans"),
    )
