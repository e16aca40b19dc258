"""Personal data: four base patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The network is trained in numpy, from spans that a generator labels: usual and unusual spellings of the four kinds among
words, addresses spelt out in words too, and look-alikes (keys, dates, versions, prices, numbers) that are none. `train` made
the weights that lie beside this module (`python -m quillmesh.llm.pii` makes them again), so that a session need not.

Every window of every text is run, overlapping with the next by a span's usual length, and decoded by Viterbi; a window
where no path can gain enough over "outside" is left out of the decoding, which changes nothing. Spans that a window's edge
cuts are joined with their other part in the next window, whatever their length, and what is found is reconciled over the
whole text: of overlapping spans, those of the largest total score that do not overlap. Predictions that overlap a base
span give way to it.

Time is in proportion to the length of a text, whatever is in it: patterns look at a run of characters once.

Cases: a null or empty text has no spans; base spans of different kinds may overlap and all stay; equal starts are ordered
by kind; a text shorter than a window is one window; repeated rows give repeated results; an empty table gives an empty
result. `personal_data` reads no column but doc_id and text; `redacted` returns all columns, whatever their names.
"""

from __future__ import annotations

import os
import random
import re
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import append_texts, id_text, map_texts, sha256, spans_text, unused

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and from one to the next; and of a window of the training.
LENGTH, STRIDE, TRAINED = 1024, 960, 96
#: Least log-odds of a predicted span, transitions included, over leaving its characters outside.
LEAST_ODDS = 3.0
#: Rows of windows that are run together, windows that are decoded together, and steps whose states are held.
ROWS, BATCH, STEPS = 768, 256, 16

# A match that fails at the start of a run of its characters fails in all of the run, so runs are taken whole: an address
# begins where a run does, or where the last match ended.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
MODEL_FILE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_tagger.npz")

#: Characters that have a class of their own; other letters, digits and other characters share one each.
_OWN = "abcdefghijklmnopqrstuvwxyz @.+-()/:=\"',_[]#\n"
_CLASS = {c: i + 4 for i, c in enumerate(_OWN)}
PAD, DIGIT, LETTER, OTHER = range(4)
N_CLASSES = len(_OWN) + 4
_SMALLER = (0x212A,)  # the sign of Kelvin: beyond ASCII, it alone has a small form in it
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if "@" in text:
        out += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text) if m[1]]
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    """The class of every code point; a letter has that of its small form."""
    out = np.where(np.char.isalpha(np.arange(0x110000, dtype="<u4").view("<U1")), LETTER, OTHER).astype(np.uint8)
    out[ord("0") : ord("9") + 1] = DIGIT
    for c, k in _CLASS.items():
        out[[i for i in (ord(c), ord(c.upper()), *_SMALLER) if chr(i).lower() == c]] = k
    return out


def classes(text: str) -> np.ndarray:
    return _class_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


# ---- labelled spans


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _word(r: random.Random) -> str:
    w = "".join(r.choice(("an", "ber", "ción", "de", "eau", "er", "for", "ing", "is", "la", "le", "lich", "ment", "of", "on", "que", "re", "sch", "st", "th", "tion", "und", "wh", "ä", "é", "ó")) for _ in range(r.randint(1, 4)))
    return w.capitalize() if r.random() < 0.15 else w


def _card(r: random.Random) -> str:
    body = _digits(r, 15)
    full = next(body + d for d in "0123456789" if luhn(body + d))
    sep = r.choice(("", "", " ", "-", ".", "/", "_"))
    return sep.join(full[i : i + 4] for i in range(0, 16, 4))


def _phone(r: random.Random) -> str:
    a, b, c, d = _digits(r, 3), _digits(r, 3), _digits(r, 4), r.choice(("1", "33", "44", "49", "34"))
    return r.choice((f"+{d} ({a}) {b}-{c}", f"+{d} {a} {b} {c}", f"+{d}-{a}-{b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"00{d} {a} {b} {c}", f"+{d}.{a}.{b}.{c}", f"+ {d} ({a}) {b}-{c}"))


def _email(r: random.Random) -> str:
    user = _word(r).lower() + r.choice(("", ".", "_", "-")) + r.choice(("", _word(r).lower(), _digits(r, 2)))
    host, top = r.choice(("mail", "web", "post", _word(r).lower())) + r.choice(("", _digits(r, 1))), r.choice(("com", "org", "net", "de", "example.com"))
    return r.choice((f"{user}@{host}.{top}", f"{user}@{host}.{top}", f"{user} @ {host}.{top}", f"{user}@{host} . {top}", f"{user}@{host}[.]{top}", f"{user}@ {host}.{top}", f"{user}@{host}.{top}".replace(".", " dot "), f"{user.replace('.', '_')} at {host} dot {top.replace('.', ' dot ')}", f"{user}(at){host}.{top}", f"{user} [at] {host} [dot] {top.replace('.', ' [dot] ')}"))


def _ip(r: random.Random) -> str:
    part = lambda: str(r.randint(0, 255))
    four = [part(), part(), part(), part()]
    return r.choice((".".join(four), ".".join(four), "[.]".join(four), " . ".join(four)))


def _lookalike(r: random.Random) -> str:
    hexes = "".join(r.choice("0123456789abcdef") for _ in range(r.choice((18, 24, 32, 40))))
    key = "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    return r.choice((
        hexes, f"password={hexes}", f'token = "{hexes}"', key, f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(0, 23)}:{r.randint(10, 59)}", f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}",
        f"${_digits(r, 2)}.{_digits(r, 2)}", f"#{_digits(r, 5)}", _digits(r, r.randint(1, 9)), f"@{_word(r).lower()}", f"{_digits(r, 1)},{_digits(r, 3)}", f"{_digits(r, 2)}%", f"({r.randint(1900, 2030)})", f"{_digits(r, 2)}/{_digits(r, 2)}/{_digits(r, 4)}",
        f"{_word(r)} at {_word(r)}", f"at {_word(r)} dot", f"{_word(r)} (at) {_word(r)}", f"{_digits(r, 3)}-{_digits(r, 2)}", f"http://{_word(r).lower()}.com/{_digits(r, 4)}", f"{_digits(r, 12)}", _digits(r, r.randint(20, 30)), f"{_word(r)}{_digits(r, 2)}",
    ))


def labelled_text(seed: int, entities: int) -> tuple[str, list[tuple[int, int, str]]]:
    """A text with its labelled spans."""
    r, parts, spans, at = random.Random(seed), [], [], 0
    make = {"email": _email, "ip": _ip, "card": _card, "phone": _phone}
    for _ in range(entities):
        piece = " ".join(_word(r) for _ in range(r.randint(0, 9))) + r.choice((" ", " ", " ", ": ", ", ", ".\n", " (", "="))
        parts.append(piece)
        at += len(piece)
        if r.random() < 0.55:
            kind = r.choice(KINDS)
            piece = make[kind](r)
            spans.append((at, at + len(piece), kind))
        else:
            piece = _lookalike(r)
        tail = r.choice((" ", " ", " ", ". ", ", ", ".\n", ") "))
        parts.append(piece + tail)
        at += len(piece) + len(tail)
    return "".join(parts), spans


def tags_of(n: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for a, b, kind in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[a], out[a + 1 : b] = k, k + 1
    return out


# ---- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _aligned(*shape: int) -> np.ndarray:
    """Zeros from the start of a cache line on, for arrays that every step goes through."""
    size = 4 * int(np.prod(shape))
    raw = np.zeros(size + 64, np.uint8)
    at = -raw.ctypes.data % 64
    return raw[at : at + size].view(np.float32).reshape(shape)


class Tagger:
    """Both directions run as one batch: axis 0 of the recurrent weights is the direction."""

    def __init__(self, hidden: int = 16, seed: int = 7):
        rng, h = np.random.default_rng(seed), hidden
        self.h = h
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[-2]), s).astype(np.float32)
        self.p = {"x": draw(2, N_CLASSES, 4 * h) * 2, "u": draw(2, h, 4 * h), "v": draw(2, h, TAGS), "b": np.zeros(TAGS, np.float32), "t": np.zeros((TAGS, TAGS), np.float32)}
        self.p["x"][:, :, h : 2 * h] += 1  # gates that forget start open
        # inside only after begin or inside of its kind
        to = np.arange(TAGS)
        inside = (to > 0) & (to % 2 == 0)
        self.allowed = ~inside[None, :] | (to[:, None] == to[None, :]) | (to[:, None] + 1 == to[None, :])

    def run(self, x: np.ndarray, keep: bool = False):
        """Scores (time, batch, tags) of windows x (batch, time)."""
        h, (n, length) = self.h, x.shape
        both = np.stack([x.T, x.T[::-1]])  # direction, time, batch
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        states, kept = np.empty((length, 2, n, h), np.float32), []
        d = np.arange(2)[:, None]
        for t in range(length):
            z = self.p["x"][d, both[:, t]] + np.matmul(state, self.p["u"])
            gates, new = _sigmoid(z[..., : 3 * h]), np.tanh(z[..., 3 * h :])
            i, f, o = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            before, cell = cell, f * cell + i * new
            lit = np.tanh(cell)
            if keep:
                kept.append((i, f, o, new, before, lit, state))
            state = o * lit
            states[t] = state
        scores = states[:, 0] @ self.p["v"][0] + states[::-1, 1] @ self.p["v"][1] + self.p["b"]
        return (scores, states, kept, both) if keep else scores

    def scores(self, x: np.ndarray) -> np.ndarray:
        """As run, for use: gates lie apart, no array is made in a step, and exp serves for tanh, which takes twice its time.

        With e = exp(-x), a sigmoid is 1 / (1 + e), and with e = exp(-2 x), tanh is 2 / (1 + e) - 1; where e is infinite, both
        are at their limits. Gates stay as their denominators 1 + e, and cells are kept times -2, as their exp needs them.
        A padding takes nothing in and forgets all: it leaves the states from which windows start, in both directions, so
        windows with one between them may share a row, and what fills a row up has no part in them. It is outside.
        """
        h, (n, length) = self.h, x.shape
        scale = np.full(4 * h, -1, np.float32)
        scale[3 * h :] = -2
        inputs = np.ascontiguousarray((self.p["x"] * scale).reshape(2 * N_CLASSES, 4, h).transpose(1, 0, 2))
        inputs[:2, [PAD, N_CLASSES + PAD]] = np.inf
        turns = np.ascontiguousarray((self.p["u"] * scale).reshape(2, h, 4, h).transpose(2, 0, 1, 3))
        both = np.stack([x.T, x.T[::-1] + np.uint8(N_CLASSES)], 1).reshape(length, 2 * n)
        cell, lit = _aligned(2, n, h), _aligned(2, n, h)
        # states of few steps are held: they go into the scores while they are near
        states, z, turned = _aligned(STEPS + 1, 2, n, h), _aligned(4, 2, n, h), _aligned(4, 2, n, h)
        flat, (i, f, o, new) = z.reshape(4, 2 * n, h), z
        v, out = np.ascontiguousarray(self.p["v"].transpose(0, 2, 1)), np.empty((length, TAGS, n), np.float32)
        out[:] = self.p["b"][:, None]
        with np.errstate(over="ignore"):
            for start in range(0, length, STEPS):
                m, rows = min(STEPS, length - start), both[start : start + STEPS].astype(np.intp)
                for k in range(m):
                    inputs.take(rows[k], axis=1, out=flat, mode="clip")
                    np.matmul(states[k], turns, out=turned)
                    z += turned
                    np.exp(z, out=z)
                    z += 1
                    cell /= f
                    np.divide(-4, new, out=new)
                    new += 2
                    new /= i
                    cell += new
                    np.exp(cell, out=lit)
                    lit += 1
                    np.divide(2, lit, out=lit)
                    lit -= 1
                    np.divide(lit, o, out=states[k + 1])
                out[start : start + m] += v[0] @ states[1 : m + 1, 0].transpose(0, 2, 1)
                out[length - start - m : length - start] += (v[1] @ states[1 : m + 1, 1].transpose(0, 2, 1))[::-1]
                states[0] = states[m]
        out = out.transpose(0, 2, 1)
        out[x.T == PAD] = [0] + [-1e4] * (TAGS - 1)
        return out

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood a character, and its gradients."""
        scores, states, kept, both = self.run(x, keep=True)
        length, n, _ = scores.shape
        step = np.where(self.allowed, np.exp(self.p["t"]), 0).astype(np.float32)
        e = np.exp(scores - scores.max(2, keepdims=True))
        alpha, beta, scale = np.empty_like(e), np.empty_like(e), np.empty((length, n, 1), np.float32)
        a = e[0]
        for t in range(length):
            if t:
                a = (alpha[t - 1] @ step) * e[t]
            scale[t] = a.sum(1, keepdims=True)
            alpha[t] = a / scale[t]
        beta[-1] = 1
        for t in range(length - 1, 0, -1):
            beta[t - 1] = (beta[t] * e[t]) @ step.T / scale[t]
        yt = y.T
        rows = np.arange(n)
        gold = np.take_along_axis(scores, yt[:, :, None], 2).sum() + self.p["t"][yt[:-1], yt[1:]].sum()
        log_z = np.log(scale).sum() + scores.max(2).sum()
        size = float(n * length)
        ds = alpha * beta
        ds[np.arange(length)[:, None], rows[None, :], yt] -= 1
        ds /= size
        pair = np.einsum("tbi,tbj->ij", alpha[:-1], beta[1:] * e[1:] / scale[1:]) * step
        np.add.at(pair, (yt[:-1].reshape(-1), yt[1:].reshape(-1)), -1)
        g = {"t": np.where(self.allowed, pair / size, 0).astype(np.float32), "b": ds.sum((0, 1)), "v": np.stack([np.einsum("tbh,tbk->hk", states[:, 0], ds), np.einsum("tbh,tbk->hk", states[::-1, 1], ds)])}
        g |= {k: np.zeros_like(self.p[k]) for k in ("x", "u")}
        into = np.stack([ds @ self.p["v"][0].T, ds[::-1] @ self.p["v"][1].T], 1)  # time, direction, batch, hidden
        d_state, d_cell = np.zeros_like(into[0]), np.zeros_like(into[0])
        hot = np.eye(N_CLASSES, dtype=np.float32)
        for t in range(length - 1, -1, -1):
            i, f, o, new, before, lit, state = kept[t]
            dh = into[t] + d_state
            dc = dh * o * (1 - lit * lit) + d_cell
            dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * lit * o * (1 - o), dc * i * (1 - new * new)], 2)
            g["u"] += np.matmul(state.transpose(0, 2, 1), dz)
            g["x"] += np.matmul(hot[both[:, t]].transpose(0, 2, 1), dz)
            d_state, d_cell = np.matmul(dz, self.p["u"].transpose(0, 2, 1)), dc * f
        return float((log_z - gold) / size), g

    def most_gain(self, scores: np.ndarray, ends: list[list[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """What the best span of each row (time, row, tags) can gain over "outside", at most: a whole one, and one that goes on at the end of a window."""
        t, begin, inside = self.p["t"] - self.p["t"][0, 0], np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
        length, n, _ = scores.shape
        own = scores.transpose(0, 2, 1)
        enter = t[:, begin].max(0)
        stay = np.maximum(t[begin, inside], t[inside, inside])
        outside = np.r_[0, begin]
        leave = np.maximum(t[begin][:, outside].max(1), t[inside][:, outside].max(1))[:, None]
        step = np.stack([enter, stay], 1).reshape(-1, 1)
        at: dict[int, list[int]] = {}
        for row, its in enumerate([[length]] * n if ends is None else ends):
            for end in its:
                at.setdefault(end, []).append(row)
        gain, most, cut = (np.full((*shape, n), -np.inf, np.float32) for shape in ((len(KINDS),), (len(KINDS),), ()))
        for start in range(0, length, STEPS):
            over = own[start : start + STEPS, 1:] - own[start : start + STEPS, :1]
            over += step
            over = over.reshape(-1, len(KINDS), 2, n)
            for k, (begins, stays) in enumerate(zip(over[:, :, 0], over[:, :, 1], strict=True), start + 1):
                gain += stays
                np.maximum(gain, begins, out=gain)
                np.maximum(most, gain, out=most)
                if k in at:
                    cut[at[k]] = np.maximum(cut[at[k]], gain[:, at[k]].max(0))
        return (most + leave).max(0), cut

    def viterbi(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of each window (batch, time), and each character's log-odds over "outside", with the step to it."""
        free, inside = np.r_[0, 1:TAGS:2], np.arange(2, TAGS, 2)  # any tag may come before the free ones
        order = np.r_[free, inside]
        step = np.where(self.allowed, self.p["t"], -1e4).astype(np.float32)[np.ix_(order, order)]
        own = np.ascontiguousarray(scores[:, :, order].transpose(0, 2, 1))  # time, tag, batch
        k, length = len(free), len(own)
        to_free, began, stayed = step[:, :k, None], np.diag(step[1:k, k:])[:, None], np.diag(step[k:, k:])[:, None]
        for t in range(1, length):
            last, here = own[t - 1], own[t]
            here[:k] += (last[:, None, :] + to_free).max(0)
            here[k:] += np.maximum(last[1:k] + began, last[k:] + stayed)
        at = np.empty((length, own.shape[2]), np.int64)
        at[-1] = own[-1].argmax(0)
        for t in range(length - 1, 0, -1):
            at[t - 1] = (own[t - 1] + step[:, at[t]]).argmax(0)
        tags = order[at]
        over = np.take_along_axis(scores, tags[:, :, None], 2)[:, :, 0] - scores[:, :, 0]
        over[1:] += self.p["t"][tags[:-1], tags[1:]] - self.p["t"][0, 0]
        return tags.T, over.T


def train(steps: int = 900, batch: int = 64, entities: int = 12000, seed: int = 11) -> Tagger:
    text, spans = labelled_text(seed, entities)
    x, y, tagger = classes(text), tags_of(len(text), spans), Tagger()
    rng = np.random.default_rng(seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in tagger.p.items()}
    for n in range(1, steps + 1):
        at = rng.integers(0, len(text) - TRAINED, batch)[:, None] + np.arange(TRAINED)
        _, grads = tagger.loss(x[at], y[at])
        rate = 0.02 * min(1.0, 2 * (1 - n / (steps + 1)))
        for k, g in grads.items():
            m, v = moment[k]
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            tagger.p[k] -= (rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
    return tagger


@lru_cache(maxsize=1)
def tagger(path: str = MODEL_FILE) -> Tagger:
    """The trained network; trained anew where there are no weights."""
    if not os.path.exists(path):
        return train()
    out = Tagger()
    with np.load(path) as f:
        out.p = {k: f[k] for k in out.p}
    return out


# ---- from windows to spans of whole texts


def plausible(span: str, kind: str) -> bool:
    """Has what its kind cannot be without: so many digits, or a sign or word between the parts of an address."""
    n = sum("0" <= c <= "9" for c in span)
    at = "@" in span or re.search(r"(?i)(\bat\b|[(\[]at[)\]]).*(\.|\bdot\b)", span)
    return {"email": bool(at), "ip": n >= 4 and len(re.findall("[0-9]+", span)) == 4, "card": 14 <= n <= 19, "phone": 9 <= n <= 15}[kind]


def window_starts(n: int) -> range:
    """Starts of the windows over n characters."""
    return range(0, max(1, n - LENGTH + STRIDE), STRIDE) if n else range(0)


def reconcile(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """Spans that do not overlap, of the largest total score; each span counts once, with its best score."""
    best: dict[tuple[int, int, str], float] = {}
    for a, b, kind, score in spans:
        best[a, b, kind] = max(best.get((a, b, kind), 0.0), score)
    items = sorted(best, key=lambda s: (s[1], s[0], s[2]))
    ends = np.array([s[1] for s in items])
    total, take = [0.0], []
    for n, s in enumerate(items):
        before = int(np.searchsorted(ends[:n], s[0], "right"))
        with_it = total[before] + best[s]
        take.append((with_it > total[n], before))
        total.append(max(with_it, total[n]))
    out, n = [], len(items)
    while n:
        taken, before = take[n - 1]
        if taken:
            out.append(items[n - 1])
        n = before if taken else n - 1
    return out[::-1]


def in_rows(sizes: list[int]) -> list[list[int]]:
    """Windows of these sizes in rows of about one length, with a padding between two: the largest that is left, and the smallest beside it.

    A row is no longer than need be for ROWS of them, as each of its characters is a step.
    """
    order, rows = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True), []
    room = max(sizes[order[0]], min(LENGTH, sum(sizes) // ROWS + 1)) if order else 0
    first, last = 0, len(order)
    while first < last:
        row, left = [order[first]], room - sizes[order[first]]
        first += 1
        while first < last and (need := sizes[order[last - 1]] + 1) <= left:
            last, left = last - 1, left - need
            row.append(order[last])
        rows.append(row)
    return rows


def predicted(texts: list[str], model: Tagger) -> list[list[tuple[int, int, str]]]:
    """Spans that the network finds in whole texts."""
    coded = [classes(t) for t in texts]
    parts: dict[tuple[int, int], list[tuple[int, int, int, float, bool, bool]]] = {}

    def beside(held: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
        """Scores of windows as one array. After a short window comes outside, whichever windows it is with; a whole one may go on."""
        scores = np.full((min(LENGTH, max(len(s) for *_, s in held) + 1), len(held), TAGS), -1e4, np.float32)
        scores[:, :, 0] = 0
        for k, (*_, s) in enumerate(held):
            scores[: len(s), k] = s
        return scores

    def decode(held: list[tuple[int, int, np.ndarray]]) -> None:
        for i in range(0, len(held), BATCH):
            some = held[i : i + BATCH]
            for (n, a, _), tags, over in zip(some, *model.viterbi(beside(some)), strict=True):
                parts[n, a] = tagged_spans(tags, over, a, len(coded[n]))

    def look(where: list[tuple[int, int]], least: float) -> None:
        """Windows in which no span can gain `least` over "outside", nor half of it by the end, are not decoded: they have no spans."""

        def likely(scores: np.ndarray, ends: list[list[int]]) -> list[int]:
            whole, cut = model.most_gain(scores, ends)
            return np.flatnonzero((whole >= least) | (cut >= least / 2)).tolist()

        windows = [coded[n][a : a + LENGTH] for n, a in where]
        rows, held, shared = in_rows([len(w) for w in windows]), [], []
        size = -(-len(rows) // max(1, -(-len(rows) // ROWS)))  # batches of about one size
        for i in range(0, len(rows), size or 1):
            part = rows[i : i + size]
            ends = [list(accumulate((len(windows[w]) for w in row), lambda end, n: end + 1 + n)) for row in part]
            x = np.full((len(part), max(e[-1] for e in ends)), PAD, np.uint8)
            for k, row in enumerate(part):
                for w, end in zip(row, ends[k], strict=True):
                    x[k, end - len(windows[w]) : end] = windows[w]
            scores = model.scores(x)
            for k in likely(scores, ends):
                (held if len(part[k]) == 1 else shared).extend((*where[w], scores[end - len(windows[w]) : end, k].copy()) for w, end in zip(part[k], ends[k], strict=True))
            del scores  # before the next ones
            for j in range(0, len(shared), BATCH):  # which of the windows of a row it is
                some = shared[j : j + BATCH]
                held += [some[k] for k in likely(beside(some), [[len(s)] for *_, s in some])]
            shared.clear()
            if len(held) >= BATCH or i + size >= len(rows):
                held.sort(key=lambda w: len(w[2]))
                decode(held)
                held.clear()

    look([(n, a) for n, c in enumerate(coded) for a in window_starts(len(c))], LEAST_ODDS)
    # a span that goes on beyond a window has shown there all characters that two windows share; the next window sees its end
    after = {(n, a + STRIDE) for (n, a), found in parts.items() for p in found if p[5]}
    while after := [w for w in after if w not in parts]:
        look(after, -np.inf)
        after = {(n, a + STRIDE) for n, a in after for p in parts[n, a] if p[5]}
    raw: dict[int, list] = {}
    for n, a in sorted(parts):
        raw.setdefault(n, []).extend(parts[n, a])
    return [reconcile(whole_spans(texts[n], raw[n])) if n in raw else [] for n in range(len(texts))]


def tagged_spans(tags: np.ndarray, over: np.ndarray, at: int, end: int) -> list[tuple[int, int, int, float, bool, bool]]:
    """Spans of one window, which starts at `at` of a text of `end` characters: from, to, kind, score, cut at its start, cut at its end."""
    out, size = [], min(LENGTH, end - at)
    for b in np.flatnonzero(tags[:size]).tolist():
        kind = (int(tags[b]) - 1) // 2
        if tags[b] % 2 == 0 and b and (tags[b - 1] + 1) // 2 == kind + 1:
            continue  # inside of a span that began before
        e = b + 1
        while e < size and tags[e] == 2 * kind + 2:
            e += 1
        out.append((at + b, at + e, kind, float(over[b : e + 1].sum()), b == 0 and at > 0, e == size and at + e < end))  # with the step out of the span
    return out


def whole_spans(text: str, parts: list[tuple[int, int, int, float, bool, bool]]) -> list[tuple[int, int, str, float]]:
    """Spans of the windows' parts (from, to, kind, score, cut at its start, cut at its end), in the order of the windows.

    A part whose start a window cuts goes on from the part that the window before cut at its end, or is known whole there.
    """
    out: list[tuple[int, int, str, float]] = []
    going: dict[int, tuple[int, int, float]] = {}
    for a, b, kind, score, cut_start, cut_end in parts:
        if cut_start:
            before = going.pop(kind, None)
            if before is None or before[1] < a:
                continue
            score, a = before[2] + score * (b - before[1]) / (b - a), before[0]
        if cut_end:
            going[kind] = (a, b, score)
        elif score >= LEAST_ODDS and plausible(text[a:b], KINDS[kind]):
            out.append((a, b, KINDS[kind], score))
    return out


def found(texts: list[str], model: Tagger) -> list[tuple[list, list]]:
    """For each text its base spans and all spans, in order."""
    out = []
    for text, extra in zip(texts, predicted(texts, model), strict=True):
        base = base_spans(text)
        added = [s for s in extra if not any(a < s[1] and s[0] < b for a, b, _ in base)]
        out.append((ordered(base), ordered(base + added)))
    return out


def personal_data(docs: DataFrame, digests: bool = False) -> DataFrame:
    """doc_id, base counts by kind, n_added, spans (start, end, kind, text); with digests a SHA-256 and the spans as text."""
    held = docs.sparkSession.sparkContext.broadcast(tagger())
    tail = "base_sha256 string, spans string, n_added long" if digests else "n_added long, spans array<struct<start:int,end:int,kind:string,text:string>>"

    def make():
        model = held.value

        def kernel(ids, texts):
            both = found(texts, model)
            counts = [[sum(s[2] == k for s in base) for base, _ in both] for k in KINDS]
            added = [len(every) - len(base) for base, every in both]
            if digests:
                return [ids, *counts, [sha256(spans_text(base).encode()) for base, _ in both], [spans_text(every) for _, every in both], added]
            return [ids, *counts, added, [[{"start": a, "end": b, "kind": k, "text": t[a:b]} for a, b, k in every] for t, (_, every) in zip(texts, both, strict=True)]]

        return kernel

    return map_texts(id_text(docs), make, f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, {tail}")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind; spans that overlap become one, of the first kind."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with spans replaced by their kinds, and n_chars, if there, to match."""
    held = docs.sparkSession.sparkContext.broadcast(tagger())

    def make():
        model = held.value
        return lambda ids, texts: [[masked(t, every) for t, (_, every) in zip(texts, found(texts, model), strict=True)]]

    new = unused(docs, "_masked")
    out = append_texts(docs, make, f"{new} string").withColumn("text", F.col(new)).drop(new)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


if __name__ == "__main__":
    np.savez_compressed(MODEL_FILE, **train().p)
