"""Personal data by a character-level bidirectional LSTM with CRF transitions.

Training runs in numpy on the driver, once a process, from labelled spans: generated
addresses, numbers and keys in generated prose, with harmless numbers between (``steps``
and ``batch`` bound the sample).  Nothing of the corpus is used.

A text is read in overlapping windows.  Each is decoded with Viterbi; then spans are
reconciled over the whole text: those cut by a window's edge are joined with their
continuation in the next, equal ones are merged, and of those that overlap the set of
the greatest weight stays, where weight is the number of windows that agree and the
distance to their edges.

A span must hold a mark: an ASCII digit, ``@``, a letter of an unbroken run of ``RUN``
ASCII letters, or a place up to ``AFTER`` characters after a word such as ``password`` or
``token``.  Others are dropped by rule, and so a window without a mark need not be decoded.
The result is that of decoding all.  What the rule can't find are secrets of fewer letters,
without a digit, that no such word announces.

Cases: a null or empty text has no span; texts of any length are read whole; a span may
be longer than a window; repeated rows and ids stay separate; null ids stay null; ids may be
numbers or texts; other columns, whatever their names, are ignored or, in ``masked``, passed on; an empty table
gives no rows.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_type, texts_of

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SSN", "SECRET")
TAGS = 1 + 2 * len(KINDS)  # 0 is outside; kind k begins with 1 + 2k and goes on with 2 + 2k
HIDDEN, WINDOW, STRIDE, STEPS, BATCH, TRAIN_SIZE = 24, 192, 96, 520, 64, 104
RUN, AFTER = 16, 32
CUE = r"pass(?:word|wd|phrase|code)|pwd|secret|token|credential|api[ _-]?key"
TRIGGER = f"[0-9@]|[A-Za-z]{{{RUN}}}|(?i:{CUE})"
_CUE, _STEMS = re.compile(CUE, re.I), ("pass", "pwd", "secret", "token", "credential", "api")

# 0 is padding; each printable ASCII character is itself; beyond, kinds of characters
SYMBOLS = 103
_KIND = {"Ll": 98, "Lu": 99, "Lt": 99, "Nd": 101}
_SYMBOL = np.full(1 << 16, 102, np.uint8)
for _i in range(1 << 16):
    _k = unicodedata.category(chr(_i))
    _SYMBOL[_i] = _i - 31 if 32 <= _i < 127 else 96 if chr(_i) in "\n\r" else 97 if _i < 128 else _KIND.get(_k, 100 if _k[0] == "L" else 102)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def symbols(text: str) -> np.ndarray:
    c = codes(text)
    return np.where(c < 1 << 16, _SYMBOL[np.minimum(c, 65535)], 100).astype(np.uint8)


def marks(text: str) -> np.ndarray:
    """Where a span may be, see above."""
    c = codes(text)
    out = ((c >= 48) & (c <= 57)) | (c == 64)
    letter = np.concatenate([[0], (((c | 32) >= 97) & ((c | 32) <= 122)).view(np.int8), [0]])
    edge = np.flatnonzero(np.diff(letter))
    for a, b in edge.reshape(-1, 2)[np.diff(edge.reshape(-1, 2), axis=1)[:, 0] >= RUN]:
        out[a:b] = True
    low = text.lower()
    if any(x in low for x in _STEMS):
        for m in _CUE.finditer(text):
            out[m.end() : m.end() + AFTER] = True
    return out


# === labelled spans ===

_SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "é", "è", "ç", "ü", "ö", "ñ", "ó", "ción", "eau", "sch", "ung", "lich", "ble", "ing", "mail", "com", "www"]
_OPEN, _CLOSE = ["", "b", "c", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "qu", "r", "s", "t", "v", "w", "x", "y", "z", "br", "cl", "tr", "pl", "gr", "sp"], ["", "", "", "n", "r", "s", "t", "l", "m", "ck", "x"]
_LETTERS, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789"
_ANNOUNCE = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api key", "API-KEY", "Password", "TOKEN", "passphrase", "client_secret", "credentials"]


class Samples:
    """Endless labelled windows: the text, and ``start, end, kind`` of its spans."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self) -> str:
        r = self.r
        x = r.random()
        n = r.randint(5, 9) if r.random() < 0.03 else r.randint(1, 4)
        w = "".join(r.choice(_SYLLABLES) for _ in range(n)) if x < 0.6 else "".join(r.choice(_OPEN) + r.choice("aeiou") + r.choice(_CLOSE) for _ in range(n))
        x = r.random()
        return w.upper() if x < 0.08 else w.capitalize() if x < 0.2 else w

    def digits(self, n: int) -> str:
        return "".join(self.r.choices(_DIGITS, k=n))

    def key(self, alphabet: str, low: int, high: int) -> str:
        return "".join(self.r.choices(alphabet, k=self.r.randrange(low, high)))

    def pick(self, *ways):  # noqa: ANN002, ANN201
        return self.r.choice(ways)

    def value(self, kind: str) -> str:
        d, r = self.digits, self.r
        if kind == "EMAIL":
            name = self.pick(lambda: self.word(), lambda: f"{self.word()}.{d(2)}", lambda: f"{self.word()}{d(r.randint(1, 3))}", lambda: f"{self.word()}{self.pick('.', '_', '-', '+')}{self.word()}")()
            host = self.pick(lambda: self.word(), lambda: f"mail{d(1)}.example", lambda: f"{self.word()}-{self.word()}", lambda: f"{self.word()}.{self.word()}", lambda: f"{self.word()}{d(1)}.{self.word()}")()
            out = f"{name}@{host}.{self.pick('com', 'org', 'net', 'de', 'fr', 'io', 'co.uk', 'example.com')}"
            return out.upper() if r.random() < 0.1 else out.lower() if r.random() < 0.8 else out
        if kind == "PHONE":
            a = self.pick(f"+{d(1)} ", f"+{d(2)} ", "", f"+{d(1)}-", f"00{d(2)} ")
            if r.random() < 0.5:
                return a + self.pick(f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"({d(3)}){d(3)}-{d(4)}")
            return (a or "+" + d(2) + " ") + self.pick(f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(10)}") if r.random() < 0.8 else f"{d(3)}-{d(3)}-{d(4)}"
        if kind == "IP":
            return ".".join(str(r.randrange(256)) for _ in range(4))
        if kind == "CARD":
            return self.pick(d(16), d(16), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", d(15), f"{d(4)} {d(6)} {d(5)}")
        if kind == "SSN":
            return f"{d(3)}-{d(2)}-{d(4)}"
        hexa, both, key = _DIGITS + "abcdef", _LETTERS + _DIGITS, self.key
        return self.pick(lambda: key(hexa, 32, 65), lambda: key(hexa, 40, 41), lambda: key(hexa, 20, 48), lambda: key(hexa.upper(), 32, 48), lambda: key(both, 20, 44), lambda: key(_LETTERS, 20, 44), lambda: key(_LETTERS[26:], 24, 44), lambda: "sk-" + key(both, 20, 48), lambda: "AKIA" + key(_LETTERS[:26] + _DIGITS, 16, 17), lambda: "ghp_" + key(both, 36, 37))()

    def harmless(self) -> str:
        d, r = self.digits, self.r
        return self.pick(lambda: d(r.randint(1, 8)), lambda: f"{d(r.randint(1, 2))}.{d(r.randint(1, 2))}{self.pick('', '.', ',')}", lambda: f"version {d(1)}{self.pick('.', '', '.' + d(1))}", lambda: f"{self.pick('19', '20')}{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"{d(r.randint(1, 3))},{d(3)}.{d(2)}", lambda: f"({d(r.randint(1, 4))})", lambda: f"{d(1)}.{d(1)}.{d(1)}", lambda: f"{d(r.randint(1, 3))}%", lambda: f"{self.word()}{d(r.randint(1, 3))}", lambda: f"@{self.word()}", lambda: f"{self.word()} @ {self.word()}", lambda: f"{d(2)}-{d(2)}", lambda: f"#{d(r.randint(1, 5))}", lambda: f"${d(r.randint(1, 4))}", lambda: f"{d(r.randint(2, 4))}/{d(2)}", lambda: f"CC BY-SA {d(1)}.{d(1)}.", lambda: f"http://{self.word()}.com/{d(3)}", lambda: f"{self.word().upper()}{d(2)}-{d(1)}", lambda: f"{self.word()}{self.word().capitalize()}{self.word().capitalize()}", lambda: f"{self.word()}_{self.word()}_{self.word()}", lambda: f"the {r.choice(_ANNOUNCE)} {self.pick('is', 'of', 'for', 'was', 'and', '')} {self.word()}", lambda: f"{r.choice(_ANNOUNCE)} {self.word()} {self.word()}")()

    def window(self, size: int) -> tuple[str, list[tuple[int, int, int]]]:
        r, text, spans = self.r, "", []
        # a text ends of its own or is cut by the window, never cut and then padded
        ends = r.random() < 0.3 and size > 80
        long = r.randrange(4, size - 70) if ends else size + 40
        noise = self.pick("", "", "", "!!", "###", "%%%", "***", "$$$", "&&&", "|")
        while len(text) < long:
            x = r.random()
            if x < 0.12:
                k = r.randrange(len(KINDS))
                value, short = self.value(KINDS[k]), KINDS[k] == "SECRET" and r.random() < 0.25
                before, after = "", self.pick("", "", "", "", ".", ",", ")", ";", noise, "\n")
                if short:  # few letters or digits are a secret by what announces them
                    value = self.key(self.pick(_LETTERS, _LETTERS + _DIGITS, _LETTERS[26:] + _DIGITS + "!$%-_"), 8, 20)
                if short or (KINDS[k] == "SECRET" and r.random() < 0.6):
                    before, after = r.choice(_ANNOUNCE) + self.pick(' = "', " = ", "=", ": ", "='", ': "', ":"), self.pick("", ".", "")
                    after = (before[-1] if before[-1] in "\"'" else "") + self.pick(after, noise)
                elif r.random() < 0.12:
                    before = self.pick("(", "<", "tel: ", "mail:", '"', "ip ", "no. ", "|", ", ")
                spans.append((len(text) + len(before), len(text) + len(before) + len(value), k))
                text += before + value + after
            elif x < 0.24:
                text += self.harmless() + self.pick("", "", ".", ",", noise)
            else:
                text += self.word() + self.pick("", "", "", "", "", ".", ",", ";", noise, noise)
            text += self.pick(" ", " ", " ", " ", " ", " ", " ", "\n", " | ")
        if ends:
            text = text.rstrip() if r.random() < 0.8 else text
            return text[:size], [(x, min(y, size), k) for x, y, k in spans if x < size]
        cut = r.randrange(40)
        return text[cut : cut + size], [(max(0, a - cut), min(size, b - cut), k) for a, b, k in spans if a - cut < size and b > cut]

    def batch(self, count: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        ids, tags = np.zeros((count, size), np.uint8), np.zeros((count, size), np.int64)
        for i in range(count):
            text, spans = self.window(size)
            ids[i, : len(text)] = symbols(text)
            for a, b, k in spans:
                tags[i, a:b] = 2 + 2 * k
                tags[i, a] = 1 + 2 * k
        return ids, tags


# === the network ===

#: A kind goes on only after itself.
ALLOWED = np.ones((TAGS, TAGS), bool)
for _k in range(len(KINDS)):
    ALLOWED[:, 2 + 2 * _k] = False
    ALLOWED[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = True
_FORBIDDEN = np.where(ALLOWED, 0, -1e4).astype(np.float32)
Weights = dict[str, np.ndarray]


def initial(hidden: int, seed: int) -> Weights:
    r = np.random.default_rng(seed)
    w = {"table": r.normal(0, 0.3, (2, SYMBOLS, 4 * hidden)), "again": r.normal(0, 1 / np.sqrt(hidden), (2, hidden, 4 * hidden)), "out": r.normal(0, 0.2, (2 * hidden, TAGS)), "bias": np.zeros(TAGS), "step": np.zeros((TAGS, TAGS))}
    w["table"][:, :, hidden : 2 * hidden] += 1  # remember at first
    return {k: v.astype(np.float32) for k, v in w.items()}


def run(w: Weights, ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """Emissions, batch by place by tag; both directions take each step together."""
    batch, size = ids.shape
    hidden = w["again"].shape[1]
    both = np.stack([ids, ids[:, ::-1]])
    h = np.zeros((2, batch, hidden), np.float32)
    c = np.zeros_like(h)
    states = np.empty((size, 2, batch, hidden), np.float32)
    tape = []
    half = np.ones(4 * hidden, np.float32)
    half[: 3 * hidden] = 0.5
    side = np.arange(2)[:, None]
    for t in range(size):
        z = h @ w["again"]
        z += w["table"][side, both[:, :, t]]
        z *= half
        np.tanh(z, out=z)
        gate = z[..., : 3 * hidden] * 0.5 + 0.5
        i, f, o, g = gate[..., :hidden], gate[..., hidden : 2 * hidden], gate[..., 2 * hidden :], z[..., 3 * hidden :]
        before, last = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        states[t] = h
        if keep:
            tape.append((i, f, o, g, before, tc, last))
    joined = np.concatenate([states[:, 0], states[::-1, 1]], axis=2).transpose(1, 0, 2)
    return joined @ w["out"] + w["bias"], [both, tape, joined]


def crf(e: np.ndarray, step: np.ndarray, tags: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of a window, and its gradients by emissions and transitions.

    Forward and backward sums are scaled at each place, so no logarithm is in the loops."""
    batch, size, n = e.shape
    top = e.max(axis=2)
    p, move = np.exp(e - top[:, :, None]), np.exp(step)
    a, b, scale = np.empty_like(e), np.ones_like(e), np.empty((batch, size), e.dtype)
    x = p[:, 0]
    for t in range(size):
        if t:
            x = (a[:, t - 1] @ move) * p[:, t]
        scale[:, t] = x.sum(axis=1)
        a[:, t] = x / scale[:, t, None]
    for t in range(size - 2, -1, -1):
        b[:, t] = (p[:, t + 1] * b[:, t + 1]) @ move.T / scale[:, t + 1, None]
    total = (np.log(scale) + top).sum(axis=1)
    rows, places = np.arange(batch)[:, None], np.arange(size)[None]
    gold = e[rows, places, tags].sum(axis=1) + step[tags[:, :-1], tags[:, 1:]].sum(axis=1)
    by_e = a * b
    after = (p * b)[:, 1:] / scale[:, 1:, None]
    by_step = np.einsum("btk,btl->kl", a[:, :-1], after, optimize=True) * move
    by_e[rows, places, tags] -= 1
    np.subtract.at(by_step, (tags[:, :-1], tags[:, 1:]), 1)
    return float((total - gold).mean()), by_e / batch, by_step / batch


def gradients(w: Weights, ids: np.ndarray, tags: np.ndarray) -> tuple[float, Weights]:
    e, (both, tape, joined) = run(w, ids, keep=True)
    loss, by_e, by_step = crf(e, w["step"] + _FORBIDDEN, tags)
    hidden = w["again"].shape[1]
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["out"] = np.einsum("bth,btk->hk", joined, by_e, optimize=True)
    g["bias"], g["step"] = by_e.sum(axis=(0, 1)), np.where(ALLOWED, by_step, 0).astype(np.float32)
    by_h = (by_e @ w["out"].T).transpose(1, 0, 2)
    from_out = np.stack([by_h[:, :, :hidden], by_h[::-1, :, hidden:]], axis=1)
    dh = np.zeros_like(from_out[0])
    dc = np.zeros_like(dh)
    back = w["again"].transpose(0, 2, 1)
    dz_all = np.empty((len(tape), *dh.shape[:2], 4 * hidden), dh.dtype)
    for t in range(len(tape) - 1, -1, -1):
        i, f, o, x, before, tc, last = tape[t]
        dh = dh + from_out[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * x * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - x * x)], axis=2)
        g["again"] += last.transpose(0, 2, 1) @ dz
        dz_all[t] = dz
        dh, dc = dz @ back, dc * f
    for k in range(2):
        seen = np.eye(SYMBOLS, dtype=dh.dtype)[both[k].T.ravel()]
        g["table"][k] = seen.T @ dz_all[:, k].reshape(len(seen), -1)
    return loss, g


def fit(steps: int = STEPS, batch: int = BATCH, size: int = TRAIN_SIZE, hidden: int = HIDDEN, seed: int = 7, rate: float = 0.02) -> Weights:
    """Adam on fresh samples, with a rate that falls to nothing."""
    w, samples = initial(hidden, seed), Samples(seed)
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    for n in range(1, steps + 1):
        _, g = gradients(w, *samples.batch(batch, size))
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        pace = rate * min(1, n / 20) * (0.5 + 0.5 * np.cos(np.pi * n / steps))
        for k, x in g.items():
            x = x * min(1, 5 / max(norm, 1e-6))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            w[k] -= (pace * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-6)).astype(np.float32)
    return w


@lru_cache(maxsize=1)
def model() -> Weights:
    return fit()


def decode(w: Weights, ids: np.ndarray) -> np.ndarray:
    """The best tags of each window."""
    e, _ = run(w, ids)
    step = w["step"] + _FORBIDDEN
    batch, size, _ = e.shape
    best, way = e[:, 0].copy(), np.empty((size, batch, TAGS), np.int8)
    best[:, 2::2] -= 1e-3  # a window may begin within a span
    for t in range(1, size):
        x = best[:, :, None] + step
        way[t] = x.argmax(axis=1)
        best = x.max(axis=1) + e[:, t]
    out = np.empty((batch, size), np.int8)
    out[:, -1] = best.argmax(axis=1)
    rows = np.arange(batch)
    for t in range(size - 1, 0, -1):
        out[:, t - 1] = way[t, rows, out[:, t]]
    return out


# === whole texts ===

Span = tuple[int, int, int]


def tagged(tags: np.ndarray) -> list[Span]:
    out: list[Span] = []
    for i in np.flatnonzero(tags):
        k, begins = (tags[i] - 1) // 2, tags[i] % 2 == 1
        if out and not begins and out[-1][1] == i and out[-1][2] == k:
            out[-1] = (out[-1][0], int(i) + 1, int(k))
        else:
            out.append((int(i), int(i) + 1, int(k)))
    return out


def starts(marked: np.ndarray, every: bool = False) -> list[int]:
    """Where windows begin: those that hold a mark, or all."""
    n = len(marked)
    grid = range(0, max(1, n - WINDOW + STRIDE), STRIDE) if n else range(0)
    if every:
        return list(grid)
    seen = np.concatenate([[0], np.cumsum(marked)])
    return [a for a in grid if seen[min(n, a + WINDOW)] > seen[a]]


def reconcile(found: list[tuple[int, int, Span]], marked: np.ndarray) -> list[Span]:
    """Spans of a text from ``window start, window end, span`` of all its windows."""
    n = len(marked)
    votes: dict[Span, float] = {}
    loose: list[Span] = []
    for low, high, (a, b, k) in sorted(found):
        if (a == low and low > 0) or (b == high and high < n):
            loose.append((a, b, k))
        else:
            room = min(a - low if low else WINDOW, high - b if high < n else WINDOW)
            votes[a, b, k] = votes.get((a, b, k), 0.0) + 1 + min(room, STRIDE) / STRIDE
    joined: list[Span] = []
    for a, b, k in sorted(loose):
        if joined and a <= joined[-1][1] and joined[-1][2] == k:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]), k)
        else:
            joined.append((a, b, k))
    for x in joined:
        # cut spans count for little, but where they are longer than any window
        votes[x] = votes.get(x, 0.0) + (3.0 if x[1] - x[0] > WINDOW else 0.1)
    seen = np.concatenate([[0], np.cumsum(marked)])
    spans = sorted((x for x in votes if seen[x[1]] > seen[x[0]]), key=lambda x: (x[1], x[0], x[2]))
    ends = [x[1] for x in spans]
    best: list[tuple[float, int, int]] = [(0.0, -1, 0)]  # weight, span taken, index before it
    for i, x in enumerate(spans):
        before = int(np.searchsorted(ends[:i], x[0], side="right"))
        take = best[before][0] + votes[x]
        best.append((take, i, before) if take > best[-1][0] else (best[-1][0], -1, i))
    out, at = [], len(spans)
    while at:
        _, taken, before = best[at]
        if taken >= 0:
            out.append(spans[taken])
        at = before
    return out[::-1]


def find(texts: list[str | None], w: Weights, every: bool = False, block: int = 256) -> list[list[Span]]:
    """Spans of each text: start, end, kind; windows of all texts share their batches."""
    coded = [symbols(t) if t else np.zeros(0, np.uint8) for t in texts]
    marked = [marks(t) if t else np.zeros(0, bool) for t in texts]
    windows = [(i, a) for i, m in enumerate(marked) for a in starts(m, every)]
    found: list[list[tuple[int, int, Span]]] = [[] for _ in texts]
    for at in range(0, len(windows), block):
        part = windows[at : at + block]
        ids = np.zeros((len(part), WINDOW), np.uint8)
        for row, (i, a) in enumerate(part):
            x = coded[i][a : a + WINDOW]
            ids[row, : len(x)] = x
        for (i, a), tags in zip(part, decode(w, ids)):
            end = min(a + WINDOW, len(coded[i]))
            found[i] += [(a, end, (a + s, a + e, k)) for s, e, k in tagged(tags[: end - a])]
    return [reconcile(f, m) if f else [] for f, m in zip(found, marked)]


def mask_text(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for a, b, k in spans:
        out += [text[at:a], f"<{KINDS[k]}>"]
        at = b
    return "".join(out) + text[at:]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans, text`` of each document with personal data: ``start-end:KIND``
    joined by commas, and the text with a mark in the place of each span."""
    w = model()

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches):
            texts = texts_of(pdf)
            rows = [(d, ",".join(f"{a}-{b}:{KINDS[k]}" for a, b, k in s), mask_text(t, s)) for d, t, s in zip(pdf["doc_id"], texts, find(texts, w)) if s]
            yield pd.DataFrame(rows, columns=["doc_id", "spans", "text"])

    kind = id_type(docs, id_col)
    may = docs.select(F.col(id_col).cast(kind).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike(TRIGGER))
    return may.mapInPandas(look, "doc_id string, spans string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with marks for personal data in the text."""
    w = model()

    @F.pandas_udf("string")
    def mark(s: pd.Series) -> pd.Series:
        out: list[str] = []
        for pdf in chunks([s.to_frame("text")]):
            texts = texts_of(pdf)
            out += [mask_text(t, x) for t, x in zip(texts, find(texts, w))]
        return pd.Series(out, dtype=object)

    text = F.col(f"`{text_col}`").cast("string")
    may = F.coalesce(text.rlike(TRIGGER), F.lit(False))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return docs.where(~may).unionAll(docs.where(may).select(*[mark(text).alias(c) if c == text_col else k for c, k in zip(docs.columns, kept)]))
