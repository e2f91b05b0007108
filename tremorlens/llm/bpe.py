"""Operator 3: BPE encoding and decoding by a tokenization automaton.

The automaton starts as one state with a loop for every byte. Each merge u v -> w in turn applies a gadget: the
state that u leads to is replaced, for u, by a copy without the v arc, and every state that still has a u arc
gets a w arc to where v led. A token sequence is the BPE tokenization of its bytes exactly if the final automaton
accepts it. Where a token leads depends on the token alone, so the automaton is a table of bits, states by classes of
tokens with the same arcs, built merge by merge: a state or a class is copied only where another token shares it
(14,639 states by 10,603 classes, 19 MB, for the 50,000 merges of the public vocabulary). Every prefix of a word has
one accepted path; its last arc is found left to right with a byte trie and the table, for many words at a time in
numpy. Decoding emits the labels of the arcs. The driver compiles once and broadcasts the tables, whose size is that of
the vocabulary.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents

#: Longer words (bytes) are walked one at a time.
WIDE = 32
#: Words in the cache of a worker before it starts anew; words (of one text) and characters taken at a time; rows of a result batch.
CACHE, WORDS, CHARS, ROWS = 160_000, 100_000, 1_500_000, 512
#: Rows and bytes a row of the arc table at first; it doubles.
CLASSES, STATES = 4096, 512

# The pre-splitting pattern of the byte-level vocabulary, and the same over ASCII alone.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SPLIT_ASCII = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in a byte-level vocabulary: itself, or the next free code point from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class MergeAutomaton:
    """Compiled merges of a byte-level tokenizer file."""

    def __init__(self, spec: bytes):
        tokenizer = json.loads(spec)
        model, alphabet = tokenizer["model"], byte_alphabet()
        self.added = {t["content"]: t["id"] for t in tokenizer["added_tokens"]}
        ids = model["vocab"]
        size = max([*ids.values(), *self.added.values()]) + 1
        self.labels = [b""] * size
        for token, i in ids.items():
            self.labels[i] = bytes(alphabet[c] for c in token)
        for token, i in self.added.items():
            self.labels[i] = token.encode()
        live = {i for token, i in ids.items() if len(self.labels[i]) == 1}
        self._compile(live, size, [(ids[u], ids[v], ids[u + v]) for u, v in (p.split(" ") if isinstance(p, str) else p for p in model["merges"])])
        self.live = np.array(sorted(live), np.int32)
        self._trie()

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("added", "labels", "live", "states", "classes", "wide", "arcs", "to", "kind")}

    def __setstate__(self, state: dict) -> None:
        """The trie is made anew where the automaton arrives: it is larger than the table."""
        self.__dict__.update(state)
        self._trie()

    def _compile(self, live: set[int], size: int, merges: list[tuple[int, int, int]]) -> None:
        """The arc table: bit `state` of row `class` tells whether the state has the arcs of the class."""
        to, kind = [0] * size, [0] * size  # the state a token leads to, and the class of its arcs
        leads, alike = [len(live)], [len(live)]  # tokens that lead to a state, and tokens of a class
        arcs = np.zeros((CLASSES, STATES), np.uint8)
        arcs[0, 0] = 1
        for u, v, w in merges:
            if w in live:
                raise ValueError(f"two merges make token {w}")
            if u not in live or v not in live or not arcs[kind[v], to[u] >> 3] >> (to[u] & 7) & 1:
                continue
            to[w] = to[v]
            leads[to[v]] += 1
            old = to[u]
            if leads[old] > 1:  # others lead there too: a state of its own for u
                new = len(leads)
                if new >> 3 == arcs.shape[1]:
                    arcs = np.concatenate([arcs, np.zeros_like(arcs)], axis=1)
                some = arcs[: len(alike)]
                some[:, new >> 3] |= (some[:, old >> 3] >> (old & 7) & 1) << (new & 7)
                leads[old] -= 1
                leads.append(1)
                to[u] = new
            if alike[kind[v]] > 1:  # others have these arcs too: a class of its own for v
                new = len(alike)
                if new == len(arcs):
                    arcs = np.concatenate([arcs, np.zeros_like(arcs)])
                arcs[new] = arcs[kind[v]]
                alike[kind[v]] -= 1
                alike.append(1)
                kind[v] = new
            arcs[kind[v], to[u] >> 3] &= 255 ^ 1 << (to[u] & 7)
            kind[w] = kind[u]
            alike[kind[u]] += 1
            live.add(w)
        self.states, self.classes = len(leads), len(alike)
        arcs = arcs[: self.classes, : self.states + 7 >> 3]
        self.wide, self.arcs = arcs.shape[1], np.ascontiguousarray(arcs).ravel()
        self.to, self.kind = np.array(to, np.int32), np.array(kind, np.int64)

    def accepts(self, t: int, w: int) -> bool:
        """Whether the state that t leads to has a w arc."""
        return bool(self.arcs[self.kind[w] * self.wide + (self.to[t] >> 3)] >> (self.to[t] & 7) & 1)

    def _trie(self) -> None:
        child: dict[tuple[int, int], int] = {}
        ends = {}
        for i in self.live.tolist():
            node = 0
            for b in self.labels[i]:
                node = child.setdefault((node, b), len(child) + 1)
            ends[node] = i
        # Nodes with children come first: only they have a row of the table, all others share one empty row.
        inner = sorted({node for node, _ in child})
        self.inner = len(inner)
        number = {node: k for k, node in enumerate(inner)}
        for node in range(len(child) + 1):
            number.setdefault(node, len(number))
        self.child = np.zeros((self.inner + 1) << 8, np.int32)
        for (node, b), to in child.items():
            self.child[number[node] << 8 | b] = number[to]
        self.ends = np.full(len(child) + 1, -1, np.int32)
        self.ends[[number[node] for node in ends]] = list(ends.values())
        self.lengths = np.array([len(x) for x in self.labels], np.int32)
        self.numbers = [str(i) for i in range(len(self.labels))]

    def _open(self, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """accepts() for many pairs."""
        state = self.to[t]
        return (self.arcs[self.kind[w] * self.wide + (state >> 3)] >> (state & 7).astype(np.uint8) & 1).astype(bool)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word (a word is not split further)."""
        out: list[list[int]] = [[]] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for k in np.flatnonzero(lengths > WIDE).tolist():
            out[k] = self._walk(words[k])
        for wide in range(4, WIDE + 1, 4):
            own = np.flatnonzero((lengths > wide - 4) & (lengths <= wide))
            if len(own):
                self._many([words[k] for k in own.tolist()], own.tolist(), lengths[own], wide, out)
        return out

    def _many(self, words: list[bytes], own: list[int], lengths: np.ndarray, wide: int, out: list[list[int]]) -> None:
        text = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(-1, wide).T.astype(np.int64)
        last = np.zeros((wide + 1, len(words)), np.int32)
        for j in range(wide):
            at = np.flatnonzero(lengths > j)
            node = np.zeros(len(at), np.int64)
            for e in range(j + 1, wide + 1):
                node = self.child[np.minimum(node, self.inner) << 8 | text[e - 1, at]]
                go = (node > 0) & (lengths[at] >= e)
                at, node = at[go], node[go].astype(np.int64)
                if not len(at):
                    break
                token = self.ends[node]
                ok = token >= 0
                hit, token = at[ok], token[ok]
                if j:
                    free = self._open(last[j, hit], token)
                    hit, token = hit[free], token[free]
                last[e, hit] = token
        at, end = np.arange(len(words)), lengths.copy()
        steps = []
        while len(at):
            token = last[end[at], at]
            steps.append((at, token))
            end[at] -= self.lengths[token]
            at = at[end[at] > 0]
        count = np.zeros(len(words), np.int64)
        for at, _ in steps:
            count[at] += 1
        stop = np.cumsum(count)
        flat = np.empty(int(stop[-1]), np.int32)
        for k, (at, token) in enumerate(steps):
            flat[stop[at] - 1 - k] = token
        ids, a = flat.tolist(), 0
        for k, b in zip(own, stop.tolist()):
            out[k] = ids[a:b]
            a = b

    def _walk(self, word: bytes) -> list[int]:
        child, ends, known = self.child, self.ends, {}
        last = [-1] * (len(word) + 1)
        for j in range(len(word)):
            node, t = 0, last[j]
            for e in range(j, len(word)):
                node = int(child[min(node, self.inner) << 8 | word[e]])
                if not node:
                    break
                token = int(ends[node])
                if token < 0:
                    continue
                if j:
                    if (t, token) not in known:
                        known[t, token] = self.accepts(t, token)
                    if not known[t, token]:
                        continue
                last[e + 1] = token
        ids, end = [], len(word)
        while end:
            ids.append(last[end])
            end -= len(self.labels[last[end]])
        return ids[::-1]

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Words in order, some at a time; a special token is a word of its own."""
        parts = [text]
        for special in self.added:
            if special in text:
                parts = [x for p in parts for x in (re.split(f"({re.escape(special)})", p) if p not in self.added else [p])]
        for part in parts:
            if part in self.added:
                yield [part]
                continue
            split = SPLIT_ASCII if part.isascii() else SPLIT
            if len(part) <= CHARS:
                yield split.findall(part)
                continue
            found = split.finditer(part)
            while words := [m.group() for m in islice(found, WORDS)]:
                yield words

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.labels[i] for i in ids]).decode("utf-8", "replace")


class Coder:
    """Encodes texts with a bounded cache of words: (number of tokens, ids as text, labels of the arcs, ids as bytes)."""

    def __init__(self, automaton: MergeAutomaton):
        self.automaton = automaton
        self.known: dict[str, tuple[int, str, bytes, bytes]] = {}

    def learn(self, words: set[str]) -> None:
        a = self.automaton
        if len(self.known) + len(words) > CACHE:
            self.known = {}
        # Few at a time, so that a long text without repeats stays within memory.
        new = [w for w in words if w not in self.known and w not in a.added]
        for k in range(0, len(new), 50_000):
            some = new[k : k + 50_000]
            for word, ids in zip(some, a.encode_words([w.encode("utf-8", "replace") for w in some])):
                self.known[word] = len(ids), ",".join([a.numbers[i] for i in ids]), b"".join([a.labels[i] for i in ids]), np.array(ids, np.int32).tobytes()
        for word in words & a.added.keys():
            i = a.added[word]
            self.known[word] = 1, str(i), a.labels[i], np.array([i], np.int32).tobytes()

    def batches(self, texts: list[str]) -> Iterator[tuple[int, list[tuple[int, str, bytes, bytes]]]]:
        """(number of the text, its words' entries) in order; a long text comes in several."""
        held: list[tuple[int, list[str]]] = []
        chars = 0
        for k, text in enumerate(texts):
            for words in self.automaton.pieces(text):
                held.append((k, words))
                chars += sum(map(len, words)) if len(text) > CHARS else 0
                if chars > CHARS:
                    yield from self._flush(held)
                    held, chars = [], 0
            chars += len(text) if len(text) <= CHARS else 0
            if chars > CHARS:
                yield from self._flush(held)
                held, chars = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[tuple[int, list[str]]]) -> Iterator:
        seen: set[str] = set()
        for _, words in held:
            seen.update(words)
        self.learn({w for w in seen if w not in self.known} if len(self.known) + len(seen) <= CACHE else seen)
        known = self.known
        for k, words in held:
            yield k, [known[w] for w in words]

    def coded(self, texts: list[str], with_ids: bool = False) -> list[tuple]:
        """(tokens, SHA-256 of the ids, SHA-256 of the decoded text, with_ids: the ids) of each text."""
        out: list[tuple] = []
        n, names, decoded, ids, at = 0, sha256(), [], [], 0

        def close() -> None:
            nonlocal n, names, decoded, ids
            text = b"".join(decoded).decode("utf-8", "replace").encode()
            own = (np.frombuffer(b"".join(ids), np.int32),) if with_ids else ()
            out.append((n, names.hexdigest(), sha256(text).hexdigest(), *own))
            n, names, decoded, ids = 0, sha256(), [], []

        for k, entries in self.batches(texts):
            while at < k:
                close()
                at += 1
            if entries:
                names.update(("," * (n > 0) + ",".join([e[1] for e in entries])).encode())
                n += sum([e[0] for e in entries])
                decoded.append(b"".join([e[2] for e in entries]))
                if with_ids:
                    ids.append(b"".join([e[3] for e in entries]))
        while at < len(texts):
            close()
            at += 1
        return out


_coders: dict[str, Coder] = {}


def _coder(compiled: tuple[str, MergeAutomaton]) -> Coder:
    """One for each worker process and tokenizer file, told apart by a digest."""
    name, automaton = compiled
    if name not in _coders:
        _coders.clear()
        _coders[name] = Coder(automaton)
    return _coders[name]


@lru_cache(maxsize=2)
def _compiled(spec: bytes) -> tuple[str, MergeAutomaton]:
    return sha256(spec).hexdigest(), MergeAutomaton(spec)


def _shared(docs: DataFrame, path: str | None):
    return docs.sparkSession.sparkContext.broadcast(_compiled(tokenizer_file(path)))


def tokenizer_file(path: str | None = None) -> bytes:
    """Contents of a byte-level BPE tokenizer file; by default the public 50k one. Read on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id_col and ids (array of int) of each whole text. Null text is empty and has no tokens; rows that repeat all come back."""
    spec = _shared(docs, path)

    @F.pandas_udf("array<int>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([c[3] for c in _coder(spec.value).coded([t or "" for t in texts], with_ids=True)], dtype=object)

    return docs.select(F.col(f"`{id_col}`").alias(id_col), of(F.col(f"`{text_col}`")).alias("ids"))


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """id_col and text of each array of ids; null ids give an empty text, bytes that aren't UTF-8 the replacement mark."""
    spec = _shared(coded, path)

    @F.pandas_udf("string")
    def of(ids: pd.Series) -> pd.Series:
        a = _coder(spec.value).automaton
        return pd.Series([a.decode(list(x) if x is not None else []) for x in ids])

    return coded.select(F.col(f"`{id_col}`").alias(id_col), of(F.col(f"`{ids_col}`")).alias("text"))


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 (and ids): what encode() and decode() give, in one pass.

    Null and empty texts have no tokens (digests of the empty string). Repeated rows all come back; an empty table
    gives an empty result; other columns are ignored.
    """
    spec = _shared(docs, path)
    slim = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("_text"))
    columns = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), *[("ids", T.ArrayType(T.IntegerType()))] * with_ids]
    schema = T.StructType([slim.schema[id_col], *[T.StructField(*c) for c in columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(spec.value)
        for batch in batches:
            # Results leave a few rows at a time, so that a batch of long texts doesn't pile up ids.
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                rows = coder.coded([t or "" for t in some.column(1).to_pylist()], with_ids)
                out = [some.column(0), pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[k] for r in rows], pa.string()) for k in (1, 2)]]
                if with_ids:
                    stops = np.cumsum([0, *(len(r[3]) for r in rows)])
                    out.append(pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(np.concatenate([r[3] for r in rows]), pa.int32())))
                yield pa.RecordBatch.from_arrays(out, schema.names)

    return slim.mapInArrow(run, schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir))
