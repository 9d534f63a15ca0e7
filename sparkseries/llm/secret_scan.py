"""Secrets by fixed patterns and a linear-chain conditional random field.

The patterns give the base spans. The field tags white-space separated tokens as begin, inside or
outside of a secret from the shapes and words of the token and its neighbours and from features of
the file. It learns from the base spans of a bounded sample, and from two secrets of a few fixed forms
that are planted into each sampled text, one token and several (a key block, pass phrase or grouped
codes), so that what looks and stands like them is found where no pattern matches. Tokens that no path
can tag as a secret split a text, and what lies between them is decoded by Viterbi. Long texts are laid
out by pieces and scored by blocks, and no result depends on where these end.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .viterbi import best_paths

# The patterns of the base spans, in the order of their kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
SHAPES, WORDS, FILES, EDGES = 4096, 2048, 16, 100
SLOTS = (SHAPES, WORDS, SHAPES, WORDS, SHAPES, WORDS, FILES, EDGES, EDGES, EDGES)
WINDOW = 16  # tokens of a training example
PIECE = 1 << 20  # characters that are laid out at a time
BLOCK = 1 << 16  # tokens that are scored at a time
PRIME = 0x100000001B3
# Sums over the characters of a token, and what lies at its two ends.
SUMS = ("digits", "uppers", "hexas", "lowers", "others", "signs", "turns")
PART = np.dtype(
    [(name, np.int64) for name in ("start", "end", *SUMS, "above", "below")]
    + [("word", np.uint64)] + [(name, np.int8) for name in ("first", "last", "left", "right")]
)
LEAST = 6  # characters of a span, as for the assigned ones
# Signs at the edges of a token: quotes, colon and equal sign, dash, others.
EDGE_SIGNS = np.zeros(128, np.int64)
for _kind, _signs in enumerate(("\"'`", ":=", "-", ".,;!?()[]{}<>*&%$#|/"), 1):
    EDGE_SIGNS[[ord(c) for c in _signs]] = _kind
# Forms of planted secrets, with the words that lead to them.
PHRASES = ("passphrase", "pass phrase", "seed phrase", "recovery phrase", "mnemonic")
CODES = ("", "recovery code", "backup code", "license key", "activation key", "access code")
BLOCKS = ("PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY")
LEADS = ("", "", "pwd=", "pass=", "auth:", "credential=", "sk_live_", "ghp_", "xoxb-")
CONTEXT = 24  # tokens that are kept on each side of a planted secret
FREE = 6  # windows at random places of a text
TRIM = "\"'`.,;:!?()[]{}<>=*&%$#|"


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """``(start, kind, end, secret start)`` of the fixed patterns, sorted."""
    spans = []
    low = text.lower()
    if any(word in low for word in ("passw", "secret", "token", "api")):
        spans += [
            (m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST
        ]
    spans += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(spans)


def _parts(points: np.ndarray, at: int, lines: int) -> np.ndarray:
    """The tokens of a piece that starts at ``at`` after ``lines`` line breaks; the outer two can be parts."""
    solid = (points > 32) & (points != 0xA0)
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    out = np.zeros(len(start), PART)
    if not len(start):
        return out
    c = points[solid]
    length = end - start
    begin = np.concatenate(([0], np.cumsum(length)[:-1]))
    digit = (c >= 48) & (c <= 57)
    upper = (c >= 65) & (c <= 90)
    lower = (c >= 97) & (c <= 122)
    beyond = c > 126
    kind = (digit + 2 * upper + 4 * (lower | beyond)).astype(np.int8)
    turn = np.zeros(len(c), bool)
    turn[1:] = (kind[1:] != kind[:-1]) & (digit[1:] | digit[:-1])
    turn[begin] = False
    hexa, sign = (c >= 97) & (c <= 102), (c == 61) | (c == 58)
    for name, of in zip(SUMS, (digit, upper, hexa, lower, beyond, sign, turn)):
        out[name] = np.add.reduceat(of.astype(np.int32), begin)
    # The letters of a token, lower-cased, as a hash that parts can be put together from.
    power = np.full(int(length.max()), PRIME, np.uint64)
    power[0] = 1
    place = np.arange(len(c)) - np.repeat(begin, length)
    low = np.where(upper, c + 32, c).astype(np.uint64) * np.cumprod(power, dtype=np.uint64)[place]
    out["word"] = np.add.reduceat(np.where(upper | lower | beyond, low, np.uint64(0)), begin)
    sign = EDGE_SIGNS[np.minimum(points, 127)]
    breaks = lines + np.concatenate(([0], np.cumsum(points == 10)))
    out["start"], out["end"] = at + start, at + end
    out["above"], out["below"] = breaks[start], breaks[end]
    out["first"], out["last"] = sign[start], sign[end - 1]
    out["left"], out["right"] = kind[begin], kind[begin + length - 1]
    return out


def _joined(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The token that begins as part ``one`` and goes on as part ``other`` (arrays of one row each)."""
    out = one.copy()
    for name in SUMS:
        out[name] += other[name]
    out["turns"] += (one["right"] != other["left"]) & ((one["right"] | other["left"]) & 1 > 0)
    size = int(one["end"][0] - one["start"][0])
    out["word"] += other["word"] * np.uint64(pow(PRIME, size, 1 << 64))
    for name in ("end", "below", "last", "right"):
        out[name] = other[name]
    return out


def _described(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(start, end, shape, word, signs, above, below)`` of whole tokens."""
    digits, uppers, hexas, lowers, others, signs, turns = (rows[name] for name in SUMS)
    length = rows["end"] - rows["start"]
    shape = (
        np.searchsorted([3, 6, 10, 16, 20, 28, 40], length, side="right")  # 8
        + 8 * np.minimum((4 * digits + length - 1) // np.maximum(length, 1), 3)  # 4
        + 32 * np.minimum(turns, 3)  # 4
        + 128 * (uppers > 0) + 256 * (uppers + digits == length) + 512 * (signs > 0)
        + 1024 * (digits + hexas >= length - 2) + 2048 * (lowers + others > 0)
    )
    word = rows["word"]
    word = (word ^ word >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(53)
    return (
        rows["start"], rows["end"], shape.astype(np.int16), word.astype(np.int16),
        rows["first"] + 5 * rows["last"], rows["above"], rows["below"],
    )


def tokens(text: str) -> tuple[np.ndarray, ...]:
    """``(start, end, shape, word, edge)`` of the white-space separated tokens."""
    done, held, lines = [_described(np.zeros(0, PART))], np.zeros(0, PART), 0
    for at in range(0, len(text), PIECE):
        piece = text[at:at + PIECE]
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        rows = _parts(points, at, lines)
        lines += int((points == 10).sum())
        if len(held) and len(rows) and held["end"][0] == rows["start"][0]:
            rows[:1] = _joined(held, rows[:1])
        elif len(held):
            rows = np.concatenate((held, rows))
        # A token that reaches the end of the piece may go on in the next one.
        whole = len(rows) - int(len(rows) and at + len(piece) < len(text) and rows["end"][-1] == at + len(piece))
        held = rows[whole:].copy()
        done.append(_described(rows[:whole]))
    start, end, shape, word, signs, above, below = map(np.concatenate, zip(*done))
    # The first and last sign of a token, and line breaks or the text's ends beside it.
    broken = np.ones(len(start) + 1, bool)
    if len(start):
        broken[1:-1] = above[1:] > below[:-1]
    return start, end, shape, word, (signs + 25 * broken[:-1] + 50 * broken[1:]).astype(np.int16)


def file_feature(shape: np.ndarray) -> int:
    """How usual tokens that mix digits with letters, and tokens with signs, are in the whole file."""
    if not len(shape):
        return 0
    coded, signs = np.mean((shape & 32 + 64) > 0), np.mean((shape & 512) > 0)
    return min(3, int(coded * 50)) + 4 * min(3, int(signs * 50))


def features(
    shape: np.ndarray, word: np.ndarray, edge: np.ndarray, file: int, first: int = 0, last: int | None = None
) -> np.ndarray:
    """The features in each slot of the tokens from ``first`` up to ``last`` of a text.

    Neighbours beyond the text are shape, word and edge 0.
    """
    n = len(shape)
    last = n if last is None else min(last, n)
    out = np.zeros((len(SLOTS), max(last - first, 0)), np.int64)
    if last <= first:
        return out
    before, after = int(first > 0), int(last < n)
    for slot, own in ((0, shape), (1, word), (7, edge)):
        step = 2 if slot < 7 else 1
        out[slot] = own[first:last]
        out[slot + step, 1 - before:] = own[first - before:last - 1]
        out[slot + 2 * step, :last - first - 1 + after] = own[first + 1:last + after]
    out[6] = file
    return out


class Field:
    """A linear-chain conditional random field over three tags."""

    def __init__(self) -> None:
        self.weights = [np.zeros((n, 3)) for n in SLOTS]
        self.change = np.zeros((3, 3))

    def emissions(self, feats: np.ndarray) -> np.ndarray:
        total = self.weights[0][feats[0]]
        for w, f in zip(self.weights[1:], feats[1:]):
            total = total + w[f]
        return total

    def fit(self, feats: np.ndarray, tags: np.ndarray, steps: int = 80, rate: float = 0.15) -> None:
        """Adam on the likelihood of ``tags`` (examples x tokens) with ``feats`` (slots x the same)."""
        if not len(tags):
            return
        n, length = tags.shape
        params = [*self.weights, self.change]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        hot = np.eye(3)[tags]
        moves = np.einsum("nta,ntb->ab", hot[:, :-1], hot[:, 1:])
        lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        for step in range(1, steps + 1):
            e = self.emissions(feats.reshape(len(SLOTS), -1)).reshape(n, length, 3)
            ahead, back = np.zeros_like(e), np.zeros_like(e)
            ahead[:, 0] = e[:, 0]
            for t in range(1, length):
                ahead[:, t] = lse(ahead[:, t - 1, :, None] + self.change, 1) + e[:, t]
            for t in range(length - 2, -1, -1):
                back[:, t] = lse(self.change + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            norm = lse(ahead[:, -1], 1)
            state = np.exp(ahead + back - norm[:, None, None])
            pair = np.exp(
                ahead[:, :-1, :, None] + self.change + (e[:, 1:] + back[:, 1:])[:, :, None, :]
                - norm[:, None, None, None]
            ).sum((0, 1))
            error = (state - hot).reshape(-1, 3)
            grads = []
            for w, f in zip(self.weights, feats.reshape(len(SLOTS), -1)):
                g = np.stack([np.bincount(f, error[:, k], len(w)) for k in range(3)], axis=1)
                grads.append(g / n + 1e-3 * w)
            grads.append((pair - moves) / n + 1e-3 * self.change)
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)

    def tag(self, feats: np.ndarray) -> np.ndarray:
        """The best tags of one text."""
        return self.tags([feats.shape[1]], [feats])[0]

    def tags(self, sizes: list[int], blocks: Iterable[np.ndarray]) -> list[np.ndarray]:
        """The best tags of texts of ``sizes`` tokens, whose features come in ``blocks`` in their order.

        A token whose score for outside exceeds the others by more than the transitions on its two
        sides can make up is outside on every best path, so the rest is decoded between such tokens.
        Only the scores of the rest are kept, and a run of them goes on over the ends of blocks.
        """
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        begin, end = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        begin[ends - sizes] = end[ends - 1] = True
        gain = np.maximum((self.change - self.change[:, [OUTSIDE]]).max(0), 0)
        gain = gain + np.maximum((self.change - self.change[[OUTSIDE]]).max(1), 0)
        places, kept, done = [np.zeros(0, np.int64)], [np.zeros((0, 3))], 0
        for feats in blocks:
            e = self.emissions(feats)
            loose = np.nonzero((e[:, [OUTSIDE]] - e[:, 1:] <= gain[1:] + 1e-3).any(1))[0]
            places.append(done + loose)
            kept.append(e[loose])
            done += len(e)
        tags = np.zeros(total, np.uint8)
        at, scores = np.concatenate(places), np.concatenate(kept)
        if len(at):
            first = np.nonzero((np.diff(at, prepend=-2) > 1) | begin[at])[0]
            last = np.append(first[1:], len(at)) - 1
            scores[first[~begin[at[first]]]] += self.change[OUTSIDE]
            scores[last[~end[at[last]]]] += self.change[:, OUTSIDE]
            tags[at] = best_paths(
                scores.astype(np.float32), last - first + 1, self.change.astype(np.float32)
            )
        return np.split(tags, ends[:-1])


def _gold(start: np.ndarray, end: np.ndarray, spans: list[tuple[int, int, int, int]]) -> np.ndarray:
    tags = np.zeros(len(start), np.int64)
    for _, _, stop, secret in spans:
        a, b = np.searchsorted(end, secret, side="right"), np.searchsorted(start, stop)
        free = tags[a:b] == OUTSIDE
        tags[a:b] = np.where(free, INSIDE, tags[a:b])
        if a < b and free[0]:
            tags[a] = BEGIN
    return tags


def planted(draw: np.random.Generator, words: list[str], form: int) -> tuple[str, str, str]:
    """What leads to a secret, the secret, and what follows it: one token, key block, phrase or codes.

    Phrases are made of ``words``. ``form`` is the place in that list.
    """
    some = lambda signs, n: "".join(signs[k] for k in draw.integers(0, len(signs), n))
    one = lambda of: of[draw.integers(0, len(of))]
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    letters = upper + upper.lower() + digits
    if form == 0:
        return "", one(LEADS) + some(letters, draw.integers(18, 41)), ""
    if form == 1:
        name = one(BLOCKS)
        lines = [some(letters + "+/", 64) for _ in range(draw.integers(1, 9))]
        lines.append(some(letters + "+/", draw.integers(8, 64)))
        return "\n", "\n".join((f"-----BEGIN {name}-----", *lines, f"-----END {name}-----")), "\n"
    sign = one((": ", " = ", " is "))
    if form == 2:
        quote = one(('"', "'", ""))
        phrase = " ".join(one(words) for _ in range(draw.integers(4, 10)))
        return one(PHRASES) + (sign if quote or sign != " is " else ": ") + quote, phrase, quote or "\n"
    lead, size = one(CODES), draw.integers(4, 7)
    groups = [some(upper + digits * 2, size) for _ in range(draw.integers(3, 7))]
    return lead and lead + sign, " ".join(groups), ""


def _plant(
    text: str, start: np.ndarray, end: np.ndarray, draw: np.random.Generator, form: int
) -> tuple[str, int, int]:
    """The surroundings of a place of ``text``, a secret planted there, and its start and end."""
    at = int(draw.integers(0, len(start)))
    left, right = max(0, at - CONTEXT), min(len(start), at + CONTEXT)
    before, after = text[start[left]:start[at]], text[start[at]:end[right - 1]]
    words = [w for w in (before + after).lower().split() if w.isalpha() and 2 < len(w) < 10]
    lead, secret, rest = planted(draw, words or ["word", "other"], form)
    begin = len(before) + len(lead)
    return f"{before}{lead}{secret}{rest} {after}", begin, begin + len(secret)


def examples(text: str, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """What a text gives to learn from: features (n x slots x WINDOW) and tags (n x WINDOW).

    Windows lie around base spans (``windows`` of them at most, drawn at random), at ``FREE`` random
    places and at both ends of two secrets that are planted, one token and one of another form. A text of fewer tokens than a window gives none.
    """
    feats, tags = np.zeros((0, len(SLOTS), WINDOW), np.int16), np.zeros((0, WINDOW), np.int8)
    start, end, *kinds = tokens(text)
    if len(start) < WINDOW:
        return feats, tags
    draw = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    file = file_feature(kinds[0])

    def cut(kinds: list[np.ndarray], gold: np.ndarray, begins: np.ndarray, more: int) -> None:
        nonlocal feats, tags
        top = len(gold) - WINDOW
        at = set(np.clip(begins - draw.integers(2, WINDOW - 2, len(begins)), 0, top).tolist())
        at |= set(draw.integers(0, top + 1, more).tolist())
        found = [features(*kinds, file, a, a + WINDOW) for a in sorted(at)]
        feats = np.concatenate((feats, np.stack(found).astype(np.int16)))
        tags = np.concatenate((tags, np.stack([gold[a:a + WINDOW] for a in sorted(at)]).astype(np.int8)))

    gold = _gold(start, end, base_spans(text))
    begins = np.nonzero(gold == BEGIN)[0]
    if len(begins) > windows:
        begins = np.sort(draw.choice(begins, windows, replace=False))
    cut(kinds, gold, begins, FREE)
    for form in (0, int(draw.integers(1, 4))):
        part, begin, stop = _plant(text, start, end, draw, form)
        a, b, *kinds = tokens(part)
        if len(a) < WINDOW:
            continue
        spans = [(begin, 3, stop, begin)]
        spans += [s for s in base_spans(part) if s[2] <= begin or stop <= s[0]]
        one, after = int(np.searchsorted(b, begin, side="right")), int(np.searchsorted(a, stop))
        # The secret's start, and its end with what follows.
        cut(kinds, _gold(a, b, spans), np.unique([one, max(one, after - 2)]), 0)
    return feats, tags


def learn(parts: list[tuple[np.ndarray, np.ndarray]]) -> Field:
    """A field learned from the :func:`examples` of texts."""
    field = Field()
    if sum(len(tags) for _, tags in parts):
        feats, tags = map(np.concatenate, zip(*parts))
        field.fit(feats.astype(np.int64).transpose(1, 0, 2), tags.astype(np.int64))
    return field


def train(
    docs: DataFrame, id: str = "doc_id", text: str = "text", rows: int = 3000, windows: int = 64
) -> Field:
    """A field learned from at most ``rows`` texts, those of the least hashes of the id.

    Tasks make the examples, of which the driver gets at most ``windows + FREE + 3`` for each text.
    """
    sample = (
        docs.select(F.col(f"`{id}`").alias("key")).where("key is not null").distinct()
        .orderBy(F.xxhash64("key"), "key").limit(rows)
    )

    @F.pandas_udf("feats binary, tags binary")
    def made(texts: pd.Series) -> pd.DataFrame:
        both = [examples(text, windows) for text in texts]
        return pd.DataFrame([(f.tobytes(), t.tobytes()) for f, t in both], columns=["feats", "tags"])

    found = (
        docs.select(F.col(f"`{id}`").alias("key"), text_of(text).alias("text"))
        .join(F.broadcast(sample), "key").groupBy("key").agg(F.min("text").alias("text"))
        .select("key", made("text").alias("made")).select("key", "made.*").collect()
    )
    return learn([
        (np.frombuffer(row["feats"], np.int16).reshape(-1, len(SLOTS), WINDOW),
         np.frombuffer(row["tags"], np.int8).reshape(-1, WINDOW))
        for row in sorted(found, key=lambda row: row["key"])
    ])


def _groups(texts: list[str]) -> Iterator[list[int]]:
    """Places of texts that are decoded together: a piece's characters, or one longer text."""
    group, size = [], 0
    for k, text in enumerate(texts):
        if group and size + len(text) > PIECE:
            yield group
            group, size = [], 0
        group.append(k)
        size += len(text)
    if group:
        yield group


def _blocks(laid: list[tuple[np.ndarray, ...]]) -> Iterator[np.ndarray]:
    """The features of all tokens of texts, some of a text or some texts at a time."""
    held, n = [], 0
    for _, _, *kinds in laid:
        file = file_feature(kinds[0])
        for a in range(0, len(kinds[0]), BLOCK):
            held.append(features(*kinds, file, a, a + BLOCK))
            n += held[-1].shape[1]
            if n >= BLOCK:
                yield np.concatenate(held, axis=1)
                held, n = [], 0
    if held:
        yield np.concatenate(held, axis=1)


def field_spans(
    field: Field, texts: list[str], bases: list[list[tuple[int, int, int, int]]]
) -> list[list[tuple[int, int, int]]]:
    """``(start, kind, end)`` of what the field adds to the base spans of each text."""
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for group in _groups(texts):
        laid = [tokens(texts[k]) for k in group]
        tags = field.tags([len(start) for start, *_ in laid], _blocks(laid))
        for k, (start, end, *_), own in zip(group, laid, tags):
            added[k] = _spans(texts[k], start, end, own, _Taken(bases[k]))
    return added


class _Taken:
    """What the base spans of a text cover."""

    def __init__(self, base: list[tuple[int, int, int, int]]) -> None:
        self.begins = np.array([s for s, *_ in base], np.int64)
        self.reach = np.maximum.accumulate(np.array([-1] + [e for _, _, e, _ in base], np.int64))

    def free(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.reach[np.searchsorted(self.begins, end)] <= start


def _spans(
    text: str, start: np.ndarray, end: np.ndarray, tags: np.ndarray, taken: _Taken
) -> list[tuple[int, int, int]]:
    """The tagged spans of a text without what meets its base spans."""
    added = []
    before = np.append(np.uint8(OUTSIDE), tags[:-1])
    for i in np.nonzero((tags == BEGIN) | (tags == INSIDE) & (before == OUTSIDE))[0]:
        j = i
        while j + 1 < len(tags) and tags[j + 1] == INSIDE:
            j += 1
        # Tokens that meet a base span are left out, also within a span of several.
        a, b = start[i:j + 1], end[i:j + 1]
        edge = np.diff(np.concatenate(([0], taken.free(a, b).view(np.int8), [0])))
        for m, n in zip(np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0] - 1):
            x, y = int(a[m]), int(b[n])
            while x < y and text[x] in TRIM:
                x += 1
            while x < y and text[y - 1] in TRIM:
                y -= 1
            if y - x >= LEAST:
                added.append((x, 3, y))
    return added


def secrets(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf`` for each row of ``docs``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind (assign,
    access, hex, crf), joined by commas; the field adds spans of kind crf that meet no base span. Null
    texts count as empty and have no spans. Repeated rows and null ids stay. An empty table gives an
    empty result; other columns are not looked at.
    """
    field = train(docs, id, text)

    @F.pandas_udf(
        "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_crf bigint"
    )
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            texts = list(part)
            bases = [base_spans(text) for text in texts]
            show = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
            for base, added in zip(bases, field_spans(field, texts, bases)):
                plain = [(s, k, e) for s, k, e, _ in base]
                count = [sum(k == kind for _, k, _ in plain) for kind in range(3)]
                rows.append((
                    *count, hashlib.sha256(show(plain).encode()).hexdigest(),
                    show(sorted(plain + added)), len(added),
                ))
            yield pd.DataFrame(
                rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"]
            )

    return docs.select(F.col(f"`{id}`").alias("doc_id"), scan(text_of(text)).alias("got")).select(
        "doc_id", "got.*"
    )
