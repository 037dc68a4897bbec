"""Secret scan: fixed patterns and a linear-chain conditional random field.

Tokens are tagged begin, inside or outside of a secret. Features are the shape of the
token and of its neighbours, how its characters are mixed, the words around it, the cues that
these have, what stands in the gap before it, and figures of the whole text. The field learns
from a bounded sample of documents: from the spans that the fixed patterns find, and from
seeds, secrets of other names and forms and harmless values, that are put among the words of
the sample. It is decoded by Viterbi's algorithm.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Flat, Words, chance, code_points, over_texts, share_of

KINDS = ("assign", "access", "hex", "field")
TAGS = BEGIN, INSIDE, OUTSIDE = 0, 1, 2
_HASHED = 4096
_SHAPES = 8 * 16 * 4
_WINDOW = 6  # tokens on each side in a training sequence

# The patterns of the contract.
_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{32,}")


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_DIGIT, _LOW, _UP = _flags(b"0123456789"), _flags(bytes(range(97, 123))), _flags(bytes(range(65, 91)))
_MARK = _flags(b"+/_.-")
_TOKEN = _DIGIT | _LOW | _UP | _MARK | (np.arange(256) >= 128)
_VOWEL = _flags(b"aeiouyAEIOUY")
_EQUALS = ord("=")

# Parts of words that speak of secrets.
CUES = (b"passw", b"passphrase", b"pwd", b"secret", b"token", b"key", b"auth", b"bearer", b"cred", b"private", b"signature")
# Names and forms of the seeds.
SECRET_NAMES = ("private_key", "secret_key", "client_secret", "access_token", "auth_token", "refresh_token", "signing_key", "encryption_key", "passphrase", "pwd", "credential", "authorization", "session_key", "webhook_secret", "db_password", "license_key", "x-api-key", "Bearer", "Authorization: Bearer")
PLAIN_NAMES = ("version", "color", "path", "file", "name", "order", "invoice", "isbn", "url", "id", "date", "timeout", "model", "phone", "price", "title", "build", "server", "keyboard", "author", "tokens", "see", "at", "the")
JOINTS = ("=", ": ", " = ", '": "', ': "', ' = "', "=\"", " => ", ": '", " ")
PREFIXES = ("ghp_", "sk_live_", "xoxb-", "glpat-", "AIza", "SG.", "npm_", "")


def base_spans(text: Flat) -> list[tuple[int, int, int, int]]:
    """(document, kind, start, end) in bytes of the slice, of the fixed patterns."""
    raw = text.data.tobytes()
    found = []
    sign = np.add.reduceat(((text.data == 58) | (text.data == 61)).astype(np.int32), np.minimum(text.offs[:-1], max(0, len(raw) - 1))) if len(raw) else np.zeros(text.n)
    for d in range(text.n):
        a, b = int(text.offs[d]), int(text.offs[d + 1])
        if a == b:
            continue
        if sign[d]:
            found += [(d, 0, *m.span()) for m in _ASSIGN.finditer(raw, a, b) if m.end(2) - m.start(2) >= 8]
    # a byte that no pattern has stands between documents, so one search goes through all
    apart = np.full(len(raw) + text.n, 10, np.uint8)
    apart[np.arange(len(raw)) + np.repeat(np.arange(text.n), text.lens)] = text.data
    begins = text.offs[:-1] + np.arange(text.n)
    joined = apart.tobytes()
    for kind, pattern, least in ((1, _ACCESS, 16), (2, _HEX, 32)):
        spans = [m.span() for m in pattern.finditer(joined) if m.end() - m.start() >= least]
        docs = np.searchsorted(begins, [s for s, _ in spans], "right") - 1
        found += [(int(d), kind, s - int(d), e - int(d)) for d, (s, e) in zip(docs, spans, strict=True)]
    return found


def _shape(words: Words) -> np.ndarray:
    """A number for length, kinds of characters and changes between letters and digits."""
    data, s, e = words.text.data, words.starts, words.ends

    def count(flags):
        pre = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flags, out=pre[1:])
        return pre[e] - pre[s]

    digit = _DIGIT[data]
    letter = _LOW[data] | _UP[data]
    change = np.zeros(len(data), bool)
    change[1:] = (digit[1:] & letter[:-1]) | (letter[1:] & digit[:-1])
    change[s[s < len(data)]] = False
    size = np.digitize(e - s, [4, 8, 12, 16, 24, 32, 64])
    kinds = (count(digit) > 0) * 8 + (count(_LOW[data]) > 0) * 4 + (count(_UP[data]) > 0) * 2 + (count(_MARK[data]) > 0)
    turns = np.digitize(count(change), [1, 3, 6])
    return (size * 16 + kinds) * 4 + turns


def _mixture(words: Words) -> np.ndarray:
    """A number for a token of eight bytes or more: how many different bytes it has, its longest
    run of small letters and its share of vowels; zero for shorter ones."""
    out = np.zeros(len(words.starts), np.int32)
    size = words.ends - words.starts
    at = np.flatnonzero(size >= 8)
    if not len(at):
        return out
    n = size[at]
    which = np.repeat(np.arange(len(at)), n)
    data = words.text.data[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(words.starts[at], n)]
    kinds = np.bincount(np.unique(which * 256 + data) >> 8, minlength=len(at))
    low = _LOW[data] | (data >= 128)
    stop = np.ones(len(data), bool)
    stop[1:] = ~low[1:] | (which[1:] != which[:-1])
    first = np.flatnonzero(stop)
    run = np.diff(np.append(first, len(data))) - ~low[first]
    longest = np.zeros(len(at), np.int64)
    np.maximum.at(longest, which[first], run)
    vowels = np.bincount(which[_VOWEL[data]], minlength=len(at)) / n
    out[at] = 1 + (np.digitize(kinds / np.minimum(n, 24), [0.35, 0.5, 0.65]) * 4 + np.digitize(longest, [3, 5, 8])) * 4 + np.digitize(vowels, [0.1, 0.22, 0.34])
    return out


def _even(mixture: np.ndarray, drop: int) -> np.ndarray:
    """Two of the three figures of a mixture: without the vowels (2) or the different bytes (0)."""
    figures = mixture - 1
    return np.where(mixture > 0, 1 + (figures >> 2 if drop else figures & 15), 0).astype(np.int32)


def _cues(words: Words) -> np.ndarray:
    """The last of CUES that a token has, from one; else zero."""
    out = np.zeros(len(words.starts), np.int32)
    raw = words.data.tobytes()
    for i, cue in enumerate(CUES, 1):
        spot = raw.find(cue)
        while spot >= 0:
            token = int(np.searchsorted(words.starts, spot, "right")) - 1
            if token >= 0 and spot + len(cue) <= words.ends[token]:
                out[token] = i
            spot = raw.find(cue, spot + 1)
    return out


def features(text: Flat) -> tuple[Words, np.ndarray]:
    """Tokens and their feature numbers, one column for each of the tables."""
    words = Words(text, ~_TOKEN)
    n = len(words.starts)
    doc = words.doc_of()
    shape = _shape(words).astype(np.int32)
    hashed = (words.hashes() % np.uint64(_HASHED)).astype(np.int32)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    has = words.counts > 0
    first[words.docs[:-1][has]] = True
    last[words.docs[1:][has] - 1] = True

    def shifted(x, by, edge, missing):
        out = np.full(n, missing, np.int32)
        if by > 0:
            out[by:] = x[:-by] if n > by else x[:0]
        elif n > 1:
            out[:by] = x[-by:]
        out[edge] = missing
        return out

    data = text.data
    pre = lambda flags: np.concatenate([[0], np.cumsum(flags)]).astype(np.int32)
    begin = shifted(words.ends.astype(np.int32), 1, first, -1)
    begin = np.where(begin < 0, text.offs[doc], begin)
    gap = sum((p[words.starts] - p[begin] > 0).astype(np.int32) << i for i, p in enumerate((pre((data == 58) | (data == 61)), pre((data == 34) | (data == 39)), pre(data == 10))))
    signs = np.bincount(doc, weights=(gap & 1), minlength=text.n)
    file = np.digitize(signs / np.maximum(words.counts, 1), [1e-9, 0.02, 0.1]).astype(np.int32)[doc]
    if not n:
        return words, np.zeros((0, len(_SIZES)), np.int32)
    cue = _cues(words)
    cue1 = shifted(cue, 1, first, 0)
    cue2 = shifted(cue1, 1, first, 0)
    mixture = _mixture(words)
    return words, np.stack(
        [shape, shifted(shape, 1, first, _SHAPES), shifted(shape, -1, last, _SHAPES), gap, shifted(hashed, 1, first, _HASHED), shifted(hashed, -1, last, _HASHED), file, mixture, cue1 * 8 + gap, cue2, mixture * 2 + (cue1 + cue2 > 0), shape >> 2, shape & 63, _even(mixture, 2), _even(mixture, 0)], 1
    )


_MIXED = 65
_SIZES = (_SHAPES, _SHAPES + 1, _SHAPES + 1, 8, _HASHED + 1, _HASHED + 1, 4, _MIXED, 8 * (len(CUES) + 1), len(CUES) + 1, 2 * _MIXED, _SHAPES >> 2, 64, 17, 17)
_FILE = 6
_BASE = np.concatenate([[0], np.cumsum(_SIZES)[:-1]])


def _tags(words: Words, values) -> np.ndarray:
    """Tags of the tokens that overlap the spans (start, end) of ``values``."""
    tags = np.full(len(words.starts), OUTSIDE, np.int8)
    for start, end in values:
        i = int(np.searchsorted(words.ends, start, "right"))
        j = int(np.searchsorted(words.starts, end))
        tags[i:j] = INSIDE
        tags[i : min(i + 1, j)] = BEGIN
    return tags


def _values(text: Flat, spans) -> list[tuple[int, int]]:
    """The secrets of base spans: of an assignment the value, not the name before it."""
    out = []
    for _, kind, start, end in spans:
        if kind == 0:
            start += _ASSIGN.match(text.data[start:end].tobytes()).start(2)
        out.append((start, end))
    return out


def _random(rng: np.random.Generator, letters: str, low: int, high: int) -> str:
    return "".join(rng.choice(list(letters), int(rng.integers(low, high))))


def _secret_value(rng: np.random.Generator) -> str:
    small, large, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kind = int(rng.integers(8))
    if kind == 0:
        return _random(rng, digits + "abcdef", 20, 65)
    if kind == 1:
        return _random(rng, small + large + digits + "+/", 20, 65) + "=" * int(rng.integers(3))
    if kind == 2:
        return "eyJ" + _random(rng, small + large + digits, 15, 40) + ".eyJ" + _random(rng, small + large + digits + "_-", 15, 40) + "." + _random(rng, small + large + digits + "_-", 20, 44)
    if kind == 3:
        return PREFIXES[int(rng.integers(len(PREFIXES)))] + _random(rng, small + large + digits, 16, 41)
    if kind == 4:
        return _random(rng, small + digits, 16, 41)
    if kind == 5:
        return _random(rng, large + digits, 12, 33)
    if kind == 6:
        return "MII" + _random(rng, large + large + small + digits, 20, 61)
    return _random(rng, small + large + digits + "_-.", 10, 21)


def _plain_value(rng: np.random.Generator, words: list[str]) -> str:
    number = lambda low, high: str(int(rng.integers(low, high)))
    word = lambda: words[int(rng.integers(len(words)))]
    kind = int(rng.integers(11))
    if kind == 0:
        return f"{number(0, 20)}.{number(0, 30)}.{number(0, 99)}-beta.{number(1, 9)}"
    if kind == 1:
        return f"{number(1990, 2030)}-0{number(1, 9)}-{number(10, 29)}"
    if kind == 2:
        return f"/usr/share/{word()}/{word()}-{word()}.txt"
    if kind == 3:
        return f"www.{word()}.example.com/{word()}/{word()}.html"
    if kind == 4:
        return number(1, 10**9)
    if kind == 5:
        return f"{word()}_{word()}_{word()}"
    if kind == 6:
        return f"{word().capitalize()}{word().capitalize()}{word().capitalize()}"
    if kind == 7:
        return f"978-{number(1, 9)}-{number(1000, 9999)}-{number(1000, 9999)}-{number(0, 9)}"
    if kind == 8:
        return f"{word().upper()}.{word()[:3]}"
    if kind == 9:
        return f"{word()}{number(0, 100)}.{word()[:2]}"
    return f"{word()}-{word()}"


def seed(rng: np.random.Generator, words: list[str], secret: bool) -> tuple[str, int, int]:
    """A secret or a harmless value behind a name and a joint, and the secret's place (start
    and end are equal if it isn't one)."""
    names = SECRET_NAMES if secret or rng.random() < 0.3 else PLAIN_NAMES
    name = names[int(rng.integers(len(names)))]
    joint = " " if name.endswith("Bearer") else JOINTS[int(rng.integers(len(JOINTS) - secret))]
    value = _secret_value(rng) if secret else _plain_value(rng, words)
    start = len((name + joint).encode())
    quote = joint[-1] if joint[-1] in "'\"" else ""
    return f"{name}{joint}{value}{quote}", start, start + (len(value.encode()) if secret else 0)


class Field:
    """Weights of a linear-chain conditional random field, trained on short sequences."""

    def __init__(self):
        self.weights = np.zeros((sum(_SIZES), 3))
        self.moves = np.zeros((3, 3))
        self.moves[OUTSIDE, INSIDE] = -8.0  # inside follows begin or inside

    def scores(self, feats: np.ndarray) -> np.ndarray:
        return sum(self.weights[feats[..., j] + _BASE[j]] for j in range(len(_SIZES)))

    def fit(self, parts: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, batch: int = 300, rate: float = 0.3, decay: float = 1e-4) -> Field:
        """Maximum likelihood over sequences of several lengths (features (n, length, tables),
        tags (n, length)), by adaptive steps on batches, in an order that is always the same."""
        g2w, g2m = np.full_like(self.weights, 1e-6), np.full_like(self.moves, 1e-6)
        batches = [(f[i : i + batch], t[i : i + batch]) for f, t in parts for i in range(0, len(f), batch)]
        for epoch in range(epochs):
            for i in np.random.default_rng(epoch).permutation(len(batches)):
                feats, tags = batches[i]
                grad, gm = np.zeros_like(self.weights), np.zeros_like(self.moves)
                self._gradient(feats, tags, grad, gm)
                grad = grad / len(feats) - decay * self.weights
                gm = gm / len(feats) - decay * self.moves
                g2w += grad**2
                g2m += gm**2
                self.weights += rate * grad / np.sqrt(g2w)
                self.moves += rate * gm / np.sqrt(g2m)
        return self

    def _gradient(self, feats: np.ndarray, tags: np.ndarray, grad: np.ndarray, gm: np.ndarray) -> None:
        """Adds the gradient of the log-likelihood to ``grad`` and ``gm``."""
        length = feats.shape[1]
        truth = np.eye(3)[tags]
        e = self.scores(feats)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, length):
            alpha[:, t] = e[:, t] + _lse(alpha[:, t - 1, :, None] + self.moves, 1)
        for t in range(length - 2, -1, -1):
            beta[:, t] = _lse(self.moves + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = _lse(alpha[:, -1], 1)[:, None, None]
        gm += np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:])
        for t in range(length - 1):
            gm -= np.exp(alpha[:, t, :, None] + self.moves + (e[:, t + 1] + beta[:, t + 1])[:, None, :] - z).sum(0)
        diff = np.repeat((truth - np.exp(alpha + beta - z)).reshape(-1, 3), len(_SIZES), 0)
        at = (feats + _BASE).reshape(-1)
        for y in range(3):
            grad[:, y] += np.bincount(at, weights=diff[:, y], minlength=len(grad))
    def decode(self, words: Words, feats: np.ndarray) -> np.ndarray:
        """The best tags of all documents.

        A stretch of tags other than outside can't beat outside if the leads of its tokens,
        each with the most that a move can add, sum to less than nothing. Tokens of which
        every stretch around them is so are outside in the best path (prefix sums tell), so
        only the stretches of other tokens are searched."""
        e = self.scores(feats)
        tags = np.full(len(e), OUTSIDE, np.int8)
        if not len(e):
            return tags
        other = np.ones((3, 3), bool)
        other[OUTSIDE, OUTSIDE] = False
        move = self.moves[other].max() - self.moves[OUTSIDE, OUTSIDE]
        lead = e[:, :2].max(1) - e[:, OUTSIDE] + move
        total = np.concatenate([[0.0], np.cumsum(lead)])
        best_before = total[1:] - np.minimum.accumulate(total[:-1])
        best_after = np.maximum.accumulate(total[:0:-1])[::-1] - total[:-1]
        open_ = np.flatnonzero(best_before + best_after - lead + abs(move) > -1e-9)
        if not len(open_):
            return tags
        doc = words.doc_of()
        cut = np.flatnonzero((np.diff(open_) > 1) | (np.diff(doc[open_]) > 0)) + 1
        for part in np.split(open_, cut):
            a, b = part[0], part[-1] + 1
            before = self.moves[OUTSIDE] if a > words.docs[doc[a]] else np.zeros(3)
            after = self.moves[:, OUTSIDE] if b < words.docs[doc[a] + 1] else np.zeros(3)
            best, back = e[a] + before, []
            for t in range(a + 1, b):
                step = best[:, None] + self.moves
                back.append(step.argmax(0))
                best = e[t] + step.max(0)
            y = int((best + after).argmax())
            for t in range(b - 1, a, -1):
                tags[t] = y
                y = int(back[t - a - 1][y])
            tags[a] = y
        return tags


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def train(docs: DataFrame, sample_docs: int = 5_000, max_sequences: int = 15_000) -> Field:
    """A field from about ``sample_docs`` documents (all, if there are fewer), whole texts.

    Each sampled text gives the sequences around its spans, one around a token that a hash
    chooses, and two with a seed before that token, one a secret and one harmless; the ``max_sequences``
    with the least hashes are used, so what reaches the driver is bounded. Texts of any length
    train; null and empty ones have no sequence; no sequence at all gives a field that finds
    nothing. Equal rows give equal sequences."""
    chosen = docs.where(chance("doc_id", "text", F.lit("secret")) < share_of(sample_docs, docs.count())).select("text")

    def work(part: pa.RecordBatch, text):
        words, feats = features(text)
        tags = _tags(words, _values(text, base_spans(text)))
        doc, h = words.doc_of(), words.hashes()
        middle = set(np.flatnonzero(tags == BEGIN).tolist())
        seeded, marks, files = [], [], []
        for d in np.flatnonzero(words.counts):
            a, b = int(words.docs[d]), int(words.docs[d + 1])
            m = a + int(h[a]) % (b - a)
            middle.add(m)
            lo, hi = max(a, m - _WINDOW + 1), min(b, m + _WINDOW - 1)
            rng = np.random.default_rng(int(h[m]))
            own = [text.data[words.starts[i] : words.ends[i]].tobytes().decode(errors="ignore") for i in range(lo, hi)]
            if (tags[lo:hi] != OUTSIDE).any():
                continue
            left = text.data[words.starts[lo] : words.starts[m]].tobytes()
            right = text.data[words.starts[m] : words.ends[hi - 1]].tobytes()
            plain = [w for w in own if w.isalpha()] or ["text"]
            for secret in (True, False):
                phrase, start, end = seed(rng, plain, secret)
                seeded.append(left + phrase.encode() + b" " + right)
                marks.append((len(left) + start, len(left) + end))
                files.append(int(rng.integers(1, 4)))  # texts with few signs and with many
        rows = []
        for m in sorted(middle):
            a, b = words.docs[doc[m]], words.docs[doc[m] + 1]
            a, b = max(m - _WINDOW, a), min(m + _WINDOW + 1, b)
            rows.append((feats[a:b].tobytes(), tags[a:b].tobytes()))
        if seeded:
            offs = np.concatenate([[0], np.cumsum([len(x) for x in seeded])]).astype(np.int64)
            small = Flat(np.frombuffer(b"".join(seeded), np.uint8), offs)
            w, f = features(small)
            t = _tags(w, [(o + s, o + e) for o, (s, e) in zip(offs, marks, strict=False) if e > s])
            f[:, _FILE] = np.array(files, np.int32)[w.doc_of()]
            rows += [(f[a:b].tobytes(), t[a:b].tobytes()) for a, b in zip(w.docs, w.docs[1:], strict=False) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], ["feats", "tags"])

    found = over_texts(chosen, work, "feats binary, tags binary").orderBy(F.xxhash64("feats"), "tags").limit(max_sequences).toArrow()
    field = Field()
    by: dict[int, list] = {}
    for feats, tags in zip(found["feats"].to_pylist(), found["tags"].to_pylist(), strict=True):
        by.setdefault(len(tags), []).append((feats, tags))
    if not by:
        field.weights[:, OUTSIDE] = 1.0
        return field
    parts = [(np.frombuffer(b"".join(f for f, _ in rows), np.int32).reshape(-1, n, len(_SIZES)), np.frombuffer(b"".join(t for _, t in rows), np.int8).reshape(-1, n)) for n, rows in sorted(by.items())]
    return field.fit(parts)


def scan(docs: DataFrame, field: Field, redact: str | None = None) -> DataFrame:
    """Spans of each row: (doc_id, n_assign, n_access, n_hex, spans), or ``docs`` redacted.

    ``spans`` is an array of (kind, start, end) in code points, by start; kind ``field``
    are stretches of eight characters or more that the field tags and no pattern covers. With
    ``redact``, the result has the columns of ``docs``, each span's place taken by
    that text, and ``n_chars`` to match. Null and empty texts have no span; a redacted null
    stays null; repeated rows each get a row; an empty table gives an empty one. Spans that
    begin together stand in the order of KINDS; of equally good tags the first of begin,
    inside and outside counts."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def spans_of(text):
        spans = base_spans(text)
        words, feats = features(text)
        tags = shared.value.decode(words, feats)
        starts = np.flatnonzero(tags == BEGIN)
        doc = words.doc_of()
        taken = sorted((s, e) for _, _, s, e in spans)
        taken_from, taken_to = np.array([s for s, _ in taken], np.int64), np.maximum.accumulate([e for _, e in taken]) if taken else np.zeros(0, np.int64)
        for i in starts:
            j = i + 1
            while j < len(tags) and tags[j] == INSIDE and doc[j] == doc[i]:
                j += 1
            s, e = int(words.starts[i]), int(words.ends[j - 1])
            stop = int(text.offs[doc[i] + 1])
            while e < stop and text.data[e] == _EQUALS:  # what pads a value is part of it
                e += 1
            before = int(np.searchsorted(taken_from, e))
            if e - s >= 8 and not (before and taken_to[before - 1] > s):
                spans.append((int(doc[i]), 3, s, e))
        return sorted(spans, key=lambda x: (x[0], x[2], x[1]))

    def work(part: pa.RecordBatch, text):
        spans = spans_of(text)
        point = np.concatenate([[0], np.cumsum(code_points(text.data))])
        own = np.array([x[0] for x in spans], np.int64)
        kind = np.array([x[1] for x in spans], np.int64)
        start = np.array([point[x[2]] - point[text.offs[x[0]]] for x in spans], np.int64)
        end = np.array([point[x[3]] - point[text.offs[x[0]]] for x in spans], np.int64)
        offs = np.searchsorted(own, np.arange(text.n + 1)).astype(np.int32)
        items = pa.StructArray.from_arrays([pa.array(np.array(KINDS, object)[kind] if len(kind) else [], pa.string()), pa.array(start), pa.array(end)], ["kind", "start", "end"])
        counts = [pa.array(np.bincount(own[kind == i], minlength=text.n).astype(np.int64)) for i in range(3)]
        return pa.RecordBatch.from_arrays([part.column(0), *counts, pa.ListArray.from_arrays(pa.array(offs), items)], ["doc_id", "n_assign", "n_access", "n_hex", "spans"])

    def clean(part: pa.RecordBatch, text):
        by: dict[int, list] = {}
        for d, _, s, e in spans_of(text):
            rows = by.setdefault(d, [])
            if rows and s < rows[-1][1]:
                rows[-1][1] = max(rows[-1][1], e)
            else:
                rows.append([s, e])
        out = []
        for i, name in enumerate(part.schema.names):
            column = part.column(i)
            if by and (name == "text" or name == "n_chars" and pa.types.is_integer(column.type)):
                values = column.to_pylist()
                for d, cuts in by.items():
                    pieces, at = [], int(text.offs[d])
                    for s, e in cuts:
                        pieces += [text.data[at:s].tobytes().decode(), redact]
                        at = e
                    new = "".join([*pieces, text.data[at : text.offs[d + 1]].tobytes().decode()])
                    values[d] = new if name == "text" else len(new)
                column = pa.array(values, column.type)
            out.append(column)
        return pa.RecordBatch.from_arrays(out, part.schema.names)

    if redact is not None:
        return over_texts(docs, clean, docs.schema)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, spans array<struct<kind: string, start: long, end: long>>"
    return over_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, schema)


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_scan(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, train(docs))
    base = F.filter("spans", lambda s: s["kind"] != "field")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))
