"""Operator 11: personal data by rules, and by a character-level bidirectional LSTM with CRF transitions.

The rules find what is written as expected and label the sample that the network is trained on, in numpy, on the driver.
Half of the training windows show their spans in disguise (spelled-out signs, other separators, no plus), others show
look-alikes that are no personal data. Texts are read in overlapping windows; what the windows of a text find is
reconciled over the whole text by the best set of spans that don't overlap, rule-based ones first. A found span counts
if it is personal data once its disguise is taken off, so it holds a digit or a sign for "at": windows without either
can't add a span and aren't run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, findable

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and from one window to the next: a span of up to WINDOW - STRIDE is whole in one of them.
WINDOW, STRIDE = 128, 64
#: Bounds of the training sample: documents looked at, windows of one of them, windows of each kind (and without any).
SAMPLE, PER_TEXT, PER_KIND = 20_000, 8, 400
#: Training: windows shown in each round, rounds, windows of a step, width of the state, step size.
SHOWN, ROUNDS, STEP, WIDE, RATE = 1500, 10, 50, 24, 0.02
#: Windows decoded at once.
BATCH = 1024
LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NAME = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What a span that counts has: a digit, an at sign, or "at" in brackets or before a spelled-out dot.
AT = r"[\[({<] ?at ?[\])}>]|(?<= )at(?= [^\n@]{1,48}?[ \[({<]dot)"
TRIGGER = re.compile(rf"[0-9@]|{AT}", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in s.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of what the rules find, by start, then kind. The matches of one kind don't overlap."""
    out, last = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, m.end(), 0))
                last = m.end()
    out += [(*m.span(), 1) for m in IP.finditer(text) if _octets(m.group())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((*m.span(), 2))
    if "+" in text:
        out += [(*m.span(), 3) for m in PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


_SPELLED = [(re.compile(rf"\s*(?:{AT})\s*", re.IGNORECASE), "@"), (re.compile(r"\s*[\[({<] ?(?:dot|\.) ?[\])}>]\s*|\s+dot\s+", re.IGNORECASE), "."), (re.compile(r"\s*([@.])\s*"), r"\1")]
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
BETWEEN = re.compile(r"[\s._/‐-―()-]{1,2}")
GROUPED = re.compile(r"(?:\+|00)?[\s(]*[0-9]+(?:[\s./()‐-―-]{1,3}[0-9]+){2,5}")

#: A date with a time or number behind it, a book number.
NO_PHONE = re.compile(r"(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./].*|97[89][- ](?:[0-9]+[- ]){2,3}[0-9]")


def undisguised(piece: str, kind: int) -> str | None:
    """The personal data that a piece of text is in disguise, or None: digits for cards and phones."""
    if kind < 2:
        for pattern, sign in _SPELLED:
            piece = pattern.sub(sign, piece)
        return piece if (EMAIL.fullmatch(piece) if kind == 0 else IP.fullmatch(piece) and _octets(piece)) else None
    d = _digits(piece)
    if kind == 2:
        return d if 14 <= len(d) <= 19 and luhn(d) and not BETWEEN.sub("", piece).strip("0123456789") else None
    return d if 10 <= len(d) <= 15 and GROUPED.fullmatch(piece) and not NO_PHONE.fullmatch(piece) else None


# Characters as numbers: those of ASCII as they are, then blanks, dashes, letters and the rest beyond ASCII.
BLANK, DASH, OTHER, PAD, SYMBOLS = 128, 129, 130, 0, 131
_TABLE = np.full(0x3001, OTHER, np.uint8)
_TABLE[:128] = range(128)
_TABLE[[0xA0, *range(0x2000, 0x200C), 0x202F, 0x3000]] = BLANK
_TABLE[0x2010:0x2016] = DASH


def coded(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _TABLE[np.minimum(points, 0x2FFF)]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _legal() -> np.ndarray:
    """Whether one label may follow another; the last row: whether it may be the first."""
    ok = np.ones((LABELS + 1, LABELS), bool)
    for inside in range(2, LABELS, 2):
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    return ok


LEGAL = _legal()


@dataclass
class Tagger:
    """Weights: of the characters and the state into the gates, in either direction; of both states into the labels; of label pairs."""

    chars: list[np.ndarray]  # of the two directions: SYMBOLS x 4 WIDE
    state: list[np.ndarray]  # WIDE x 4 WIDE
    out: np.ndarray  # 2 WIDE x LABELS
    bias: np.ndarray
    pairs: np.ndarray  # LABELS + 1 x LABELS; the last row: of the first label

    @staticmethod
    def fresh(rng: np.random.Generator) -> Tagger:
        def some(*shape: int, size: float) -> np.ndarray:
            return rng.normal(0, size, shape).astype(np.float32)

        chars = [some(SYMBOLS, 4 * WIDE, size=0.3) for _ in range(2)]
        for c in chars:
            c[:, WIDE : 2 * WIDE] += 1  # remember at first
        return Tagger(chars, [some(WIDE, 4 * WIDE, size=0.2) for _ in range(2)], some(2 * WIDE, LABELS, size=0.2), np.zeros(LABELS, np.float32), np.zeros((LABELS + 1, LABELS), np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [*self.chars, *self.state, self.out, self.bias, self.pairs]

    def _run(self, x: np.ndarray, way: int, kept: list | None = None) -> np.ndarray:
        """States (places x windows x WIDE) of one direction."""
        n, t = x.shape
        h, c = np.zeros((n, WIDE), np.float32), np.zeros((n, WIDE), np.float32)
        out = np.empty((t, n, WIDE), np.float32)
        for k in range(t) if way == 0 else range(t - 1, -1, -1):
            z = self.chars[way][x[:, k]] + h @ self.state[way]
            gates, new = _sigmoid(z[:, : 3 * WIDE]), np.tanh(z[:, 3 * WIDE :])
            before = c
            c = gates[:, WIDE : 2 * WIDE] * c + gates[:, :WIDE] * new
            squashed = np.tanh(c)
            if kept is not None:
                kept.append((k, h, before, gates, new, squashed))
            h = out[k] = gates[:, 2 * WIDE :] * squashed
        return out

    def scores(self, x: np.ndarray, kept: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Label scores (places x windows x LABELS) and both states."""
        states = np.concatenate([self._run(x, way, kept[way] if kept else None) for way in range(2)], axis=2)
        return states @ self.out + self.bias, states

    def allowed(self) -> np.ndarray:
        return np.where(LEGAL, self.pairs, np.float32(-1e4))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best labels (windows x places), and how much better each place's label scores than outside."""
        e, _ = self.scores(x)
        pairs, back = self.allowed(), np.empty(e.shape, np.int8)
        best = pairs[-1] + e[0]
        for k in range(1, len(e)):
            each = best[:, :, None] + pairs[:-1]
            back[k] = each.argmax(axis=1)
            best = each.max(axis=1) + e[k]
        labels = np.empty(x.shape, np.int8)
        labels[:, -1] = best.argmax(axis=1)
        rows = np.arange(len(x))
        for k in range(len(e) - 1, 0, -1):
            labels[:, k - 1] = back[k, rows, labels[:, k]]
        own = np.take_along_axis(e, labels.T[:, :, None].astype(np.int64), axis=2)[:, :, 0] - e[:, :, 0]
        return labels, own.T

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean negative log likelihood of the label sequences."""
        n, t = x.shape
        kept: tuple[list, list] = ([], [])
        e, states = self.scores(x, kept)
        pairs = self.allowed()
        forward, backward = np.empty_like(e), np.zeros_like(e)
        forward[0] = pairs[-1] + e[0]
        for k in range(1, t):
            forward[k] = _logsum(forward[k - 1][:, :, None] + pairs[:-1], 1) + e[k]
        for k in range(t - 2, -1, -1):
            backward[k] = _logsum(pairs[:-1] + (e[k + 1] + backward[k + 1])[:, None, :], 2)
        total = _logsum(forward[-1], 1)
        chance = np.exp(forward + backward - total[:, None])
        d_pairs = np.zeros_like(self.pairs)
        for k in range(t - 1):
            d_pairs[:-1] += np.exp(forward[k][:, :, None] + pairs[:-1] + (e[k + 1] + backward[k + 1])[:, None, :] - total[:, None, None]).sum(axis=0)
        d_pairs[-1] = chance[0].sum(axis=0)
        np.add.at(d_pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        np.add.at(d_pairs, (np.full(n, LABELS), y[:, 0]), -1)
        d_e = chance
        d_e[np.arange(t)[:, None], np.arange(n)[None, :], y.T] -= 1
        d_out = np.einsum("tnh,tnl->hl", states, d_e)
        d_states = d_e @ self.out.T
        d_chars, d_state = [], []
        for way in range(2):
            dc, ds = np.zeros_like(self.chars[way]), np.zeros_like(self.state[way])
            dh, dcell = np.zeros((n, WIDE), np.float32), np.zeros((n, WIDE), np.float32)
            for k, h, before, gates, new, squashed in reversed(kept[way]):
                dh = dh + d_states[k][:, way * WIDE : (way + 1) * WIDE]
                i, f, o = gates[:, :WIDE], gates[:, WIDE : 2 * WIDE], gates[:, 2 * WIDE :]
                dcell = dcell + dh * o * (1 - squashed**2)
                dz = np.concatenate([dcell * new * i * (1 - i), dcell * before * f * (1 - f), dh * squashed * o * (1 - o), dcell * i * (1 - new**2)], axis=1)
                np.add.at(dc, x[:, k], dz)
                ds += h.T @ dz
                dh, dcell = dz @ self.state[way].T, dcell * f
            d_chars.append(dc)
            d_state.append(ds)
        return [g / n for g in (*d_chars, *d_state, d_out, d_e.sum(axis=(0, 1)), np.where(LEGAL, d_pairs, 0))]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


# How signs are spelled out, and what stands between groups of digits.
ATS = (" (at) ", "(at)", " [at] ", "[at]", " at ", " @ ", "{at}", "<at>")
DOTS = (".", " dot ", "[dot]", " [dot] ", "(dot)", "[.]", " . ", "(.)")
GAPS = (".", "/", "_", " ", "–", " - ", " ", "  ")


def disguised(piece: str, kind: int, rng: np.random.Generator) -> str:
    """A span of the rules as people write it to get past them."""
    pick = lambda s: s[int(rng.integers(len(s)))]
    if kind == 0:
        name, _, domain = piece.partition("@")
        at = pick(ATS)
        dot = pick(DOTS[1:4]) if at == " at " else pick(DOTS)
        return name + at + domain.replace(".", dot)
    if kind == 1:
        return piece.replace(".", pick(DOTS[1:]))
    d = _digits(piece)
    if kind == 2:
        size = int(pick((4, 4, 4, 5, 6)))
        return pick(GAPS).join(d[k : k + size] for k in range(0, len(d), size))
    land, rest = d[:-10], d[-10:]
    gap = pick((" ", "-", ".", "/", "–", " "))
    own = gap.join((rest[:3], rest[3:6], rest[6:])) if rng.random() < 0.5 else f"({rest[:3]}) {rest[3:6]}{gap}{rest[6:]}"
    return pick(("", "", f"00{land} ", f"+{land}/" if gap == "/" else f"+{land} ", f"{land}{gap}")) + own


def lookalike(rng: np.random.Generator) -> str:
    """Digits and signs that are no personal data: amounts, dates, versions, keys, short numbers."""
    n = lambda a, b: int(rng.integers(a, b))
    some = lambda k, of: "".join(of[n(0, len(of))] for _ in range(k))
    return (
        f"{n(1, 9999)}.{n(0, 99):02d}", f"{n(1900, 2100)}-{n(1, 13):02d}-{n(1, 29):02d}", f"{n(1, 20)}.{n(0, 30)}.{n(0, 99)}", some(n(24, 64), "0123456789abcdef"), str(n(1, 10**7)),
        f"{n(1, 13)}/{n(1, 29)}/{n(1990, 2030)}", f"{n(0, 24):02d}:{n(0, 60):02d}:{n(0, 60):02d}", f"AKIA{some(16, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')}", f"{n(1, 10**6):,}", f"@{some(6, 'abcdefghijkl')}",
        f"token={some(20, 'abcdefXYZ0123456789')}", some(n(20, 30), "0123456789"),
    )[n(0, 12)]


def _varied(piece: str, kind: int, rng: np.random.Generator) -> str:
    """Other digits, so that no number is learned by heart (octets stay, so that they stay octets)."""
    if kind == 1:
        return ".".join(str(int(rng.integers(256))) for _ in range(4))
    return "".join(str(int(rng.integers(10))) if "0" <= c <= "9" else c for c in piece)


def example(window: str, spans: list[tuple[int, int, int]], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Characters and labels of a training window: as it is, in disguise, or with look-alikes in the places of its spans."""
    way, parts, labels, at = rng.random(), [], [], 0
    for a, b, kind in spans:
        if a < at:
            continue
        parts.append(window[at:a])
        labels += [0] * (a - at)
        if way < 0.15:
            piece = lookalike(rng)
            labels += [0] * len(piece)
        else:
            piece = _varied(window[a:b], kind, rng)
            piece = disguised(piece, kind, rng) if way < 0.65 else piece
            labels += [1 + 2 * kind, *[2 + 2 * kind] * (len(piece) - 1)]
        parts.append(piece)
        at = b
    parts.append(window[at:])
    labels += [0] * (len(window) - at)
    text = "".join(parts)
    x, y = np.full(WINDOW, PAD, np.uint8), np.zeros(WINDOW, np.int64)
    # Not always whole: cut anywhere, as windows are.
    cut = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
    own = coded(text)[cut : cut + WINDOW]
    x[: len(own)], y[: len(own)] = own, labels[cut : cut + len(own)]
    for k in range(LABELS // 2):
        if y[0] == 2 + 2 * k:
            y[0] = 1 + 2 * k
    return x, y


def train(windows: list[tuple[str, list[tuple[int, int, int]]]], seed: int = 7) -> Tagger | None:
    """Learn from labelled windows: (text, spans). None if there is no span."""
    if not any(s for _, s in windows):
        return None
    rng = np.random.default_rng(seed)
    model = Tagger.fresh(rng)
    by = [[w for w in windows if any(s[2] == k for s in w[1])] for k in range(len(KINDS))] + [[w for w in windows if not w[1]]]
    by = [w for w in by if w]
    first, second = ([np.zeros_like(a) for a in model.arrays()] for _ in range(2))
    step, steps = 0, ROUNDS * (SHOWN // STEP)
    for _ in range(steps):
        pairs = []
        for k in range(STEP):
            own = by[k % len(by)]
            pairs.append(example(*own[int(rng.integers(len(own)))], rng))
        x, y = (np.stack([p[i] for p in pairs]) for i in range(2))
        grads = model.gradients(x, y)
        size = float(np.sqrt(sum(float((g**2).sum()) for g in grads)))
        step += 1
        rate = RATE * (1 - (step - 1) / steps) + 1e-4
        for a, g, m, v in zip(model.arrays(), grads, first, second):
            g = g * min(1.0, 5.0 / max(size, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def _labelled(text: str) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Up to PER_TEXT windows around spans of a text, spread over it, and one without any."""
    spans = base_spans(text)
    out = []
    for a, b, _ in spans[:: max(1, -(-len(spans) // (PER_TEXT - 1)))]:
        # Wider than a window, so that the place of the span in it can vary.
        lo, hi = max(0, a - WINDOW), min(len(text), b + WINDOW)
        out.append((text[lo:hi], [(s - lo, e - lo, k) for s, e, k in spans if lo <= s and e <= hi]))
    for lo in range(0, len(text), WINDOW * max(1, len(text) // (WINDOW * 50))):
        if not any(s < lo + WINDOW and e > lo for s, e, _ in spans):
            out.append((text[lo : lo + WINDOW], []))
            break
    return out


def fit(docs: DataFrame, text_col: str = "text") -> Tagger | None:
    """Train on windows of a sample of texts, picked by a hash of the text: SAMPLE, PER_TEXT and PER_KIND bound them."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")
    share = min(1.0, SAMPLE / max(docs.count(), 1))
    few = docs.select(text).where(F.pmod(F.xxhash64("t", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    @F.pandas_udf("array<struct<w:string,s:array<array<int>>>>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"w": w, "s": s} for w, s in _labelled(t)] for t in texts])

    rows = few.select(F.explode(of("t")).alias("x")).select("x.w", "x.s").distinct()
    order = Window.partitionBy(F.coalesce(F.get(F.get("s", F.lit(0)), F.lit(2)), F.lit(-1))).orderBy(F.xxhash64("w"), "w")
    picked = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= PER_KIND).collect()
    return train(sorted((r.w, [tuple(s) for s in r.s]) for r in picked))


def found_spans(texts: list[str], model: Tagger) -> list[list[tuple[int, int, int, float]]]:
    """Spans that the network finds in whole texts, from all windows that can hold one: start, end, kind, score."""
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
    todo: list[tuple[int, int, np.ndarray]] = []

    def run():
        x = np.full((len(todo), WINDOW), PAD, np.uint8)
        for k, (_, _, own) in enumerate(todo):
            x[k, : len(own)] = own
        labels, better = model.decode(x)
        for k in np.flatnonzero((labels > 0).any(axis=1)):
            n, lo, own = todo[k]
            row = labels[k, : len(own)]
            begins = np.flatnonzero(row % 2 == 1)
            for a in begins:
                b = a + 1
                while b < len(row) and row[b] == row[a] + 1:
                    b += 1
                # What an inner end of the window cuts is whole in its neighbour.
                if (a > 0 or lo == 0) and (b < len(own) or lo + b == len(texts[n])):
                    out[n].append((lo + int(a), lo + int(b), int(row[a]) // 2, float(better[k, a:b].sum())))
        todo.clear()

    for n, text in enumerate(texts):
        at = {m.start() // STRIDE for m in TRIGGER.finditer(text)}
        if not at:
            continue
        own = coded(text)
        for w in sorted(at | {k - 1 for k in at if k}):
            todo.append((n, w * STRIDE, own[w * STRIDE : w * STRIDE + WINDOW]))
            if len(todo) >= BATCH:
                run()
    if todo:
        run()
    return out


_GAP = re.compile(r"\s+")
_TRIM = re.compile(r"[^0-9A-Za-z+(]*(.*?)[^0-9A-Za-z)]*", re.DOTALL)


def reconciled(text: str, base: list[tuple[int, int, int]], found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """base, and of what windows found the best set that overlaps neither base nor itself: undisguised, of the largest total score."""
    good: dict[tuple[int, int, int], float] = {}
    for a, b, kind, score in found:
        if score <= 0:
            continue
        a, b = _TRIM.fullmatch(text, a, b).span(1)
        # A word or two too many in front are taken off.
        for lo in [a, *[m.end() for m in islice(_GAP.finditer(text, a, b), 3)]]:
            if undisguised(text[lo:b], kind) is not None:
                good[lo, b, kind] = max(score, good.get((lo, b, kind), 0.0))
                break
    if not good:
        return base
    taken = sorted((a, b) for a, b, _ in base)
    merged: list[list[int]] = []
    for a, b in taken:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = np.array([a for a, _ in merged], np.int64)
    free = []
    for (a, b, kind), score in good.items():
        k = int(np.searchsorted(starts, b)) - 1  # the last one that begins before b
        if k < 0 or merged[k][1] <= a:
            free.append((b, a, kind, score))
    free.sort()
    ends = [s[0] for s in free]
    best: list[tuple[float, int]] = [(0.0, -1)]  # total of the first k, and whether the k-th is in it
    for k, (_, a, _, score) in enumerate(free):
        with_it = best[int(np.searchsorted(ends[:k], a, "right"))][0] + score
        best.append((with_it, k) if with_it > best[-1][0] else (best[-1][0], best[-1][1] if best[-1][0] else -1))
    chosen, k = [], len(free)
    while k > 0:
        if best[k][0] == best[k - 1][0]:
            k -= 1
            continue
        b, a, kind, _ = free[k - 1]
        chosen.append((a, b, kind))
        k = int(np.searchsorted(ends[: k - 1], a, "right"))
    return sorted([*base, *chosen], key=lambda s: (s[0], s[2]))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, base and all_spans (arrays of kind, start, end in code points), n_email, n_ip, n_card, n_phone.

    Counts are of base. Null and empty texts have no spans. Without any span of the rules in the sample nothing is
    learned and all_spans is base. Repeated rows all come back, alike; an empty table gives an empty result; other
    columns are ignored. A found span longer than WINDOW - STRIDE may be missed; those of the rules may be of any length.
    """
    findable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col))
    span = "array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(f"base {span}, all {span}")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in spans]
        for texts in batches:
            texts = [t or "" for t in texts]
            base = [base_spans(t) for t in texts]
            more = found_spans(texts, shared.value) if shared.value else [[] for _ in texts]
            yield pd.DataFrame({"base": [named(b) for b in base], "all": [named(reconciled(t, b, f)) for t, b, f in zip(texts, base, more)]})

    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), of(F.col(f"`{text_col}`")).alias("_s"))
    def of_kind(kind: str) -> Column:
        return F.size(F.filter("_s.base", lambda s: s["kind"] == kind)).cast("long")

    return rows.select(id_col, *[of_kind(k).alias(f"n_{k}") for k in KINDS], F.col("_s.base").alias("base"), F.col("_s.all").alias("all_spans"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    rows = personal_data(documents(spark, sf_dir))
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(joined("base"), 256).alias("base_sha256"), joined("all_spans").alias("spans"))
