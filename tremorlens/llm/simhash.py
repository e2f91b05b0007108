"""Operator 2: SimHash near-dedup by generalised pigeonhole.

Documents get 64-bit fingerprints; equal fingerprints are merged first. From the co-occurrence of bits over all
fingerprints, correlated bits are grouped into parts, and a dynamic programme allots each part its own distance
threshold (they sum to distance - parts + 1, so every pair within the distance agrees on some part within that
part's threshold) at the least estimated cost. Each fingerprint is dealt to one bucket per part and choice of
`threshold` masked bits; buckets are scanned in sorted order and all pairs in a bucket are verified with
vectorised bit counts. A bucket hands on a star for each of its linked sets, never its pairs. A bucket too large
to hold is dealt out anew over the bits it doesn't share yet. Stars are joined to components by large-star and
small-star rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import numbered_rows
from .common import documents, materialize

BITS = 64
#: Fingerprints of one bucket that a task holds at once; 2**11, so a bucket that shares all but 11 bits always fits.
BUCKET = 2048
#: Pairs of rows that are compared at once.
PAIRS = 1 << 21
#: Cost of one dealt row in verified pairs (a row is hashed, shuffled and sorted, a pair is one vectorised XOR).
ROW_COST = 200
#: The same where rows carry sketches.
SKETCH_COST = 4000
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16
#: Odd multipliers that make further hashes of a hash (any will do).
STEP, MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def simhash(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a whole text; 0 without words."""
    return simhashes(text, words, 1)[0]


def simhashes(text: str | None, words: int = 3, times: int = 1) -> list[int]:
    """The fingerprint, and others from further hashes of the same shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return [0] * times
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[:-1].tolist()]
    stops = (ends[words - 1 :] - 1).tolist() or [len(joined)]
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    ones = np.zeros((times, BITS), np.int64)
    for k in range(0, len(stops), CHUNK):
        hashes = np.array([digest(view[a:b], 42) for a, b in zip(starts[k : k + CHUNK], stops[k : k + CHUNK])], "<u8")
        for t in range(times):
            own = hashes if t == 0 else _mixed(hashes, t)
            ones[t] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(stops), axis=1, bitorder="little").view("<u8").ravel().tolist()


def _mixed(hashes: np.ndarray, t: int) -> np.ndarray:
    out = hashes + np.uint64(t * STEP & (1 << 64) - 1)
    for shift, factor in zip((30, 27), MIX):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return (out ^ (out >> np.uint64(31))).astype("<u8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """_id and _fp (the fingerprint as a signed long) for each row."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, words) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(f"`{id_col}`").alias("_id"), of(F.col(f"`{text_col}`")).alias("_fp"))


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both, n = np.zeros((BITS, BITS), np.int64), 0
    for b in batches:
        fps = b.column(0).to_numpy().astype(np.int64)
        bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        both += (bits.T @ bits).astype(np.int64)
        n += len(fps)
    rows = [*both.tolist(), [n] * BITS]
    yield pa.RecordBatch.from_arrays([pa.array(range(BITS + 1), pa.int32()), pa.array(rows, pa.list_(pa.int64()))], ["i", "c"])


def co_occurrence(groups: DataFrame) -> tuple[int, np.ndarray]:
    """Fingerprints in all, and for each two bits how many have both."""
    parts = groups.select("_fp").mapInArrow(_bit_counts, "i int, c array<long>")
    rows = parts.groupBy("i").agg(F.array(*[F.sum(F.col("c")[k]) for k in range(BITS)]).alias("c")).collect()
    table = {r.i: r.c for r in rows}
    if not table:
        return 0, np.zeros((BITS, BITS))
    return table[BITS][0], np.array([table[i] for i in range(BITS)], float)


def plan_parts(n: int, both: np.ndarray, distance: int, row_cost: int = ROW_COST) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts that are probed, at the least estimated cost."""
    n = max(n, 1)
    one = np.diag(both) / n
    joint = both / n
    spread = np.sqrt(np.maximum(one * (1 - one), 1e-12))
    correlation = np.abs(joint - np.outer(one, one)) / np.outer(spread, spread)
    np.fill_diagonal(correlation, 0)
    p11, p10, p01 = joint, one[:, None] - joint, one[None, :] - joint
    agree2 = p11**2 + p10**2 + p01**2 + np.maximum(1 - p11 - p10 - p01, 0) ** 2  # two rows agree on both bits
    agree1 = np.maximum(one**2 + (1 - one) ** 2, 1e-9)
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m in range(1, min(2 * distance + 2, 12)):
        parts = _grouped(correlation, m)
        costs = [[_cost(n, bits, t, distance, agree1, agree2, correlation, row_cost) for t in range(-1, distance + 1)] for bits in parts]
        total, chosen = _allot(costs, distance - m + 1)
        if total < best[0]:
            best = total, [(bits, t) for bits, t in zip(parts, chosen) if t >= 0]
    return best[1]


def _grouped(correlation: np.ndarray, m: int) -> list[list[int]]:
    """m parts of about equal size; each takes the bits most correlated with those it has."""
    left, parts = set(range(BITS)), []
    for k in range(m):
        want = len(left) // (m - k)
        rest = sorted(left)
        part = [max(rest, key=lambda i: (correlation[i, rest].max(), -i))]
        left.discard(part[0])
        while len(part) < want:
            nxt = max(sorted(left), key=lambda i: (correlation[i, part].sum(), -i))
            part.append(nxt)
            left.discard(nxt)
        parts.append(part)
    return parts


def _cost(n: int, bits: list[int], t: int, distance: int, agree1: np.ndarray, agree2: np.ndarray, correlation: np.ndarray, row_cost: int) -> float:
    """Rows dealt (again, where buckets would be too large) and pairs verified if a part is probed within t; 0 at -1 (not probed)."""
    if t < 0:
        return 0.0
    if t >= len(bits):
        return float("inf")  # no bits left to agree on
    within = np.zeros(t + 1)
    within[0] = 1.0
    for k, j in enumerate(bits):
        near = max(bits[:k], key=lambda i: correlation[i, j]) if k else None
        same = float(agree1[j] if near is None else min(1.0, agree2[near, j] / agree1[near]))
        moved = np.concatenate([[0.0], within[:-1]])
        within = within * same + moved * (1 - same)
    key = len(bits) - t
    bucket = n * float(within[0]) ** (key / len(bits))
    each = max(1.0, (BITS - key) / (distance + 1))  # bits that one more level adds to a key
    levels = ceil(max(0.0, log2(2 * bucket / BUCKET)) / each)
    dealt = sum((distance + 1) ** k for k in range(levels + 1))
    return n * comb(len(bits), t) * dealt * row_cost + min(n * n / 2 * float(within.sum()), n * comb(len(bits), t) * dealt * BUCKET)


def _allot(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (from -1) that sum to total at the least cost."""
    table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in table.items():
            for k, own in enumerate(row):
                at = s + k - 1
                if c + own < nxt.get(at, (float("inf"),))[0]:
                    nxt[at] = (c + own, [*chosen, k - 1])
        table = nxt
    return table.get(total, (float("inf"), []))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(parts: list[tuple[list[int], int]]) -> list[int]:
    """For each part and choice of `threshold` of its bits, the mask of the other bits."""
    out = set()
    for bits, t in parts:
        for off in combinations(bits, t):
            out.add(sum(1 << b for b in bits if b not in off))
    return sorted(out)


def _finer(mask: int, distance: int) -> list[int]:
    """Masks that add one of distance + 1 parts of the bits not in mask."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << b for b in rest[k :: distance + 1]) for k in range(distance + 1) if rest[k :: distance + 1]]


def _stars(fps: np.ndarray, end: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs (row i's run stops before end[i]): each linked fingerprint with the first of its set."""
    a, b = [], []
    at = np.flatnonzero(end - np.arange(len(fps)) > 1)
    lag = 1
    while len(at):
        near = np.bitwise_count(fps[at] ^ fps[at + lag]) <= distance
        a.append(at[near])
        b.append(at[near] + lag)
        lag += 1
        at = at[end[at] > at + lag]
    if not a:
        return fps[:0], fps[:0]
    u, v = np.concatenate(a), np.concatenate(b)
    label = np.arange(len(fps))
    while len(u):
        before = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        np.minimum.at(label, before[u], low)
        np.minimum.at(label, before[v], low)
        label = label[label]
        if np.array_equal(before, label):
            break
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def scan_buckets(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (_m, _k, _fp) in order; gives links (0, fingerprint, fingerprint) and, of buckets too large, finer rows."""
    held = [np.empty(0, np.int64)] * 3
    over: tuple[int, int] | None = None
    finer: dict[int, list[int]] = {}

    def out(m, k, fp):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (m, k, fp)], ["_m", "_k", "_fp"])

    def refined(m: np.ndarray, fp: np.ndarray):
        for mask in np.unique(m):
            own = fp[m == mask]
            for sub in finer.setdefault(int(mask), [_signed(x) for x in _finer(int(mask) & (1 << 64) - 1, distance)]):
                yield out(np.full(len(own), sub, np.int64), own & np.int64(sub), own)

    def linked(m: np.ndarray, k: np.ndarray, fp: np.ndarray):
        """Of whole runs."""
        if len(m) < 2:
            return
        cut = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (k[1:] != k[:-1])]))
        size = np.diff(np.concatenate([cut, [len(m)]]))
        end = np.repeat(cut + size, size)
        big = np.repeat(size > BUCKET, size)
        if big.any():
            yield from refined(m[big], fp[big])
            end = np.where(big, np.arange(len(m)) + 1, end)
        # Whole runs at a time, so that the pairs of several large buckets aren't held together.
        stops = np.flatnonzero(np.arange(len(fp)) + 1 >= end) + 1
        work = np.cumsum((end - np.arange(len(fp)) - 1)[: stops[-1]])[stops - 1]
        at = 0
        while at < len(fp):
            done = work[np.searchsorted(stops, at, "right") - 1] if at else 0
            to = int(stops[max(np.searchsorted(work, done + PAIRS, "right") - 1, np.searchsorted(stops, at, "right"))])
            u, v = _stars(fp[at:to].view(np.uint64), end[at:to] - at, distance)
            if len(u):
                yield out(np.zeros(len(u)), u.view(np.int64), v.view(np.int64))
            at = to

    for b in batches:
        new = [b.column(i).to_numpy().astype(np.int64) for i in range(3)]
        m, k, fp = (np.concatenate([x, y]) for x, y in zip(held, new))
        if not len(m):
            continue
        if over is not None:  # the rest of a bucket whose head has gone out already
            same = (m == over[0]) & (k == over[1])
            yield from refined(m[same], fp[same])
            if same.all():
                held = [np.empty(0, np.int64)] * 3
                continue
            m, k, fp, over = m[~same], k[~same], fp[~same], None
        tail = int(np.argmax((m == m[-1]) & (k == k[-1])))  # the last run may go on
        yield from linked(m[:tail], k[:tail], fp[:tail])
        held = [m[tail:], k[tail:], fp[tail:]]
        if len(held[0]) > BUCKET:
            over = int(m[-1]), int(k[-1])
            yield from refined(held[0], held[2])
            held = [np.empty(0, np.int64)] * 3
    yield from linked(*held)


def links(groups: DataFrame, distance: int) -> DataFrame:
    """_a, _b: fingerprints of one component; they connect all that lie within the distance of each other."""
    schema = "_m long, _k long, _fp long"
    n, both = co_occurrence(groups)
    dealt = [F.struct(F.lit(_signed(m)).alias("_m"), F.col("_fp").bitwiseAND(F.lit(_signed(m))).alias("_k")) for m in masks(plan_parts(n, both, distance))]
    rows = groups.select("_fp", F.explode(F.array(*dealt)).alias("_s")).select("_s._m", "_s._k", "_fp")
    found = None
    while True:
        sorted_rows = rows.repartition("_m", "_k").sortWithinPartitions("_m", "_k", "_fp")
        scanned = materialize(sorted_rows.mapInArrow(partial(scan_buckets, distance=distance), schema), "buckets")
        own = scanned.where("_m = 0").select(F.col("_k").alias("_a"), F.col("_fp").alias("_b"))
        found = own if found is None else found.unionByName(own)
        rows = scanned.where("_m <> 0")
        if rows.isEmpty():
            return found


def components(edges: DataFrame) -> DataFrame:
    """_node, _root (smallest node of its component) for each node of the edges (_a, _b)."""
    a, b = F.col("_a"), F.col("_b")
    edges = materialize(edges.where(a != b).select(F.greatest(a, b).alias("_a"), F.least(a, b).alias("_b")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(b.alias("_a"), a.alias("_b")))
        least = materialize(both.groupBy("_a").agg(F.least(F.min("_b"), a).alias("_r")), "least")
        # `least` is written before it is joined, so that the rows of a centre of many links can be split.
        large = both.where(b > a).join(least, "_a").select(b.alias("_a"), F.col("_r").alias("_b")).distinct()
        large = materialize(large, "large")
        least = materialize(large.groupBy("_a").agg(F.min("_b").alias("_r")), "least")
        small = large.join(least, "_a").select(F.explode(F.array(F.struct(b.alias("_a"), F.col("_r").alias("_b")), F.struct(a.alias("_a"), F.col("_r").alias("_b")))).alias("_e")).select("_e._a", "_e._b")
        edges = materialize(small.where(a != b).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(a.alias("_node"), b.alias("_root")).unionByName(edges.select(b.alias("_node"), b.alias("_root")).distinct())
        mark = now


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """One row for each input row: id_col, fingerprint (16 hex digits), component_id (smallest identifier of its component).

    Null and blank texts have fingerprint zero and are linked like any other. A null identifier counts in no
    minimum; a component without any other has a null component_id. Repeated rows all come back, alike; an empty
    table gives an empty result. Other columns are ignored.
    """
    of = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    groups = materialize(of.groupBy("_fp").agg(F.min("_id").alias("_rep")), "groups")
    roots = components(links(groups, distance))
    linked = groups.join(roots, F.col("_fp") == F.col("_node"), "left").withColumn("_root", F.coalesce("_root", "_fp"))
    # Written first: a join with a bare shuffle on either side can be split where one component holds many rows.
    least = materialize(linked.groupBy("_root").agg(F.min("_rep").alias("_least")), "least")
    each = linked.join(least, "_root").select("_fp", "_least")
    return of.join(each, "_fp").select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), F.col("_least").alias("component_id"))


def shingle_hashes(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a whole text (of all its words, where they are fewer)."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    each = {xxhash.xxh64_intdigest(b" ".join(found[k : k + words])) for k in range(max(1, len(found) - words + 1))} if found else set()
    return np.sort(np.fromiter(each, np.uint64, len(each))).view(np.int64)


def overlap(a: str | None, b: str | None, words: int = 5) -> float:
    """Jaccard similarity of the sets of word shingles of two whole texts; 1 for two texts without words."""
    x, y = (set(shingle_hashes(t, words).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


#: Bits of a sketch, each of the least of the shingle hashes under one multiplier: two texts agree on half of them and half
#: of their similarity more. Four standard deviations of that.
SKETCH, MARGIN = 256, 0.2
#: Shingles that are hashed under all multipliers at a time, and the bit of the least that is kept.
SOME, KEPT = 2048, 24


def sketch(text: str | None) -> list[int]:
    """SKETCH bits in signed longs; zero for a text without words."""
    hashes = shingle_hashes(text).view(np.uint64)
    if not len(hashes):
        return [0] * (SKETCH // BITS)
    least = np.full(SKETCH, np.uint64((1 << 64) - 1))
    for k in range(0, len(hashes), SOME):
        np.minimum(least, (hashes[k : k + SOME, None] * _MULTIPLIERS[None, :]).min(axis=0), out=least)
    return np.packbits((least >> np.uint64(KEPT) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<i8").tolist()


_MULTIPLIERS = _mixed(np.arange(SKETCH, dtype=np.uint64), 77) | np.uint64(1)


def _differing(similarity: float) -> int:
    """Sketch bits in which texts of a similarity differ."""
    return int(SKETCH * (1 - similarity) / 2)


def _alike(bits: np.ndarray, end: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one run (row i's run stops before end[i]) whose sketches differ in few bits: later, earlier row, bits."""
    a, b, d = [], [], []
    at, lag = np.flatnonzero(end - np.arange(len(bits)) > 1), 1
    while len(at):
        far = np.bitwise_count(bits[at] ^ bits[at + lag]).sum(axis=1, dtype=np.int64)
        near = far <= most
        a.append(at[near] + lag)
        b.append(at[near])
        d.append(far[near])
        lag += 1
        at = at[end[at] > at + lag]
    if not a:
        return (np.zeros(0, np.int64),) * 3
    a, b, d = np.concatenate(a), np.concatenate(b), np.concatenate(d)
    order = np.lexsort((b, a))
    return a[order], b[order], d[order]


def _first(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs in order, the first `most` of each a; and those a which have as many."""
    cut = np.flatnonzero(np.diff(a, prepend=-1))
    size = np.diff(np.append(cut, len(a)))
    keep = np.arange(len(a)) - np.repeat(cut, size) < most
    return a[keep], b[keep], a[cut[size >= most]]


def _shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Of pairs in the order of a, which have at least this Jaccard similarity of their sets (sorted as unsigned words)."""
    out, cut = np.zeros(len(a), bool), np.flatnonzero(np.diff(a, prepend=-1))
    for lo, hi in zip(cut, np.append(cut[1:], len(a))):
        own, others = sets[a[lo]].view(np.uint64), [sets[k] for k in b[lo:hi]]
        sizes, held = np.array([len(x) for x in others]), np.concatenate(others).view(np.uint64)
        place = np.minimum(np.searchsorted(own, held), max(len(own) - 1, 0))
        hits = np.append(0, np.cumsum(own[place] == held if len(own) else np.zeros(len(held), bool)))
        ends = np.cumsum(sizes)
        both, total = hits[ends] - hits[ends - sizes], sizes + len(own)
        out[lo:hi] = (total == 0) | (both >= least * (total - both))
    return out


def _confirmed(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, d: np.ndarray, least: float, most: int) -> np.ndarray:
    """Which of the pairs (in order) hold, as far as it takes to find the first `most` of each a. Few differing bits (d) decide, else the sets."""
    out, sure = np.zeros(len(a), bool), d <= _differing(least + MARGIN)
    cut = np.flatnonzero(np.diff(a, prepend=-1))
    size = np.diff(np.append(cut, len(a)))
    of, lo, hi = np.repeat(np.arange(len(cut)), size), 0, 2 * most
    rank, count_of = np.arange(len(a)) - np.repeat(cut, size), np.zeros(len(cut), np.int64)
    while len(at := np.flatnonzero((rank >= lo) & (rank < hi) & (count_of < most)[of])):
        out[at] = sure[at]
        asked = at[~sure[at]]
        out[asked] = _shared(sets, a[asked], b[asked], least)
        count_of += np.bincount(of[at[out[at]]], minlength=len(cut))
        lo, hi = hi, 2 * hi
    return out


def _first_met(x: np.ndarray, y: np.ndarray, m: np.ndarray, k: np.ndarray, masks_of: list[int]) -> np.ndarray:
    """Of pairs of rows with these fingerprints, which share no bucket before (m, k): one bucket is enough for a pair."""
    at = np.arange(len(x))
    for mask in sorted(map(_signed, masks_of)):
        if not len(at):
            break
        own, other, before = x[at] & mask, y[at] & mask, np.where(m[at] > mask, np.iinfo(np.int64).max, np.where(m[at] == mask, k[at], np.iinfo(np.int64).min))
        met = np.zeros(len(at), bool)
        for i in range(own.shape[1]):
            met |= (own[:, i] < before) & (own[:, i, None] == other).any(axis=1)
        at = at[~met]
    return at


FOUND = "_m long, _k long, _id long, _b long, " + ", ".join(f"_s{k} long" for k in range(SKETCH // BITS))
#: The same with the hashes of a text's shingles.
WITH_SET = FOUND + ", _set array<long>"


#: Earlier documents that a document is linked to in the first round, and by how much that grows in the next ones.
LINKS, MORE = 16, 8
#: Rows of a large bucket that are compared with those held before them at a time.
STEP_ROWS = 256
#: Bytes of shingle hashes of a large bucket that a task holds at once.
HELD = 1 << 26
#: Rows of identifiers (and text hashes) that are sent to every task rather than the texts shuffled to meet them.
FEW = 1 << 18


def scan_sketches(batches: Iterator[pa.RecordBatch], least: float, whole: bool, most: int = LINKS, drop: bool = True, members: list[int] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (_m, _k, _id, _b, sketch) in order of the first three; gives links (0, 0, later, earlier), marks and rows for another scan.

    A row is linked to the first `most` before it that it may be like; where rows have a _set, to those that it is like. One
    that has as many is marked (0, 1, row, 0) and, with drop, compared with nothing after it. Without drop all rows of a bucket
    are compared, and only those whose _b is above 0 are linked or marked. members (the masks; rows end with their fingerprints):
    in place of links, the rows (0, 2, row, 0, _m, _k) of either side of the pairs that share no bucket before this one. whole: all rows of a bucket are here. What is compared with BUCKET others that are held
    (or HELD bytes of sets) goes on to the next scan of the same bucket, so in the end all that aren't dropped have been
    compared. If not whole, this is one task's share of the buckets, and rows that aren't dropped go on to meet those of the
    other tasks.
    """
    names, words = [f.split()[0] for f in FOUND.split(", ")], SKETCH // BITS
    none = np.zeros(0, np.int64)
    key: tuple[int, int] | None = None
    held_id, held_asks, held_seen, held_bits, held_sets = none, none, none.astype(bool), np.zeros((0, words), np.int64), []
    few, may, with_sets = min(STEP_ROWS, BUCKET), _differing(least - MARGIN), False

    def out(m, k, ids, other, bits, sets=None):
        columns = [pa.array(np.ascontiguousarray(np.broadcast_to(np.asarray(c, np.int64), ids.shape))) for c in (m, k, ids, other, *bits.T)]
        if with_sets:
            columns.append(pa.array([none] * len(ids) if sets is None else sets, pa.list_(pa.int64())))
        more = ["_set"] if with_sets else [f"_f{i}" for i in range(len(columns) - len(names))]
        return pa.RecordBatch.from_arrays(columns, [*names, *more])

    def found(ids, a, b, full):
        blank = np.zeros((max(len(a), len(full)), words), np.int64)
        if len(a):
            yield out(0, 0, ids[a], ids[b], blank[: len(a)])
        if len(full):
            yield out(0, 1, ids[full], 0, blank[: len(full)])

    def met(m, k, ids, width):
        place = np.zeros((len(ids), width), np.int64)
        place[:, 0], place[:, 1] = m, k
        return out(0, 2, ids, 0, place)

    def linked(asks, a, c, d, sets):
        if not drop:
            a, c, d = (x[asks[a] > 0] for x in (a, c, d))
        if with_sets and len(a):
            holds = _confirmed(sets, a, c, d, least, most)
            a, c = a[holds], c[holds]
        return _first(a, c, most)

    def closed():
        """What is held of the run that ends, for the other tasks' rows."""
        if key and not whole and len(held_id):
            yield out(*key, held_id, held_asks, held_bits, held_sets)

    for b in batches:
        m, k, ids, asks = (b.column(i).to_numpy().astype(np.int64) for i in range(4))
        if not len(m):
            continue
        with_sets = not members and b.num_columns > len(names)
        bits = np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(4, b.num_columns - with_sets)], axis=1)
        if with_sets:
            hashes, ends = b.column(len(names)).values.to_numpy(), b.column(len(names)).offsets.to_numpy()
            sets = [hashes[x:y] for x, y in zip(ends, ends[1:])]
        else:
            sets = [none] * len(m)
        cut = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (k[1:] != k[:-1])]))
        stop = np.append(cut[1:], len(m))
        first, last = (int(m[0]), int(k[0])) == key, len(cut) - 1
        # Runs that are whole in this batch and not large, many at once.
        inside = (stop - cut <= few) & (np.arange(len(cut)) < last)
        inside[0] &= not first
        rows = np.repeat(inside, stop - cut)
        if rows.any():
            at = np.flatnonzero(rows)
            end = np.repeat(np.cumsum((stop - cut)[inside]), (stop - cut)[inside])
            steps = np.flatnonzero(np.arange(len(at)) + 1 >= end) + 1
            work = np.cumsum((end - np.arange(len(at)) - 1)[: steps[-1]])[steps - 1]
            lo = 0
            while lo < len(at):
                done = work[np.searchsorted(steps, lo, "right") - 1] if lo else 0
                hi = int(steps[max(np.searchsorted(work, done + PAIRS, "right") - 1, np.searchsorted(steps, lo, "right"))])
                own = at[lo:hi]
                a, c, d = _alike(np.ascontiguousarray(bits[own, :words]).view(np.uint64), end[lo:hi] - lo, may)
                if members:
                    a, c = own[a], own[c]
                    new = _first_met(bits[a, words:], bits[c, words:], m[a], k[a], members)
                    either = np.unique(np.concatenate([a[new], c[new]]))
                    yield met(m[either], k[either], ids[either], bits.shape[1])
                else:
                    a, c, full = linked(asks[own], a, c, d, [sets[x] for x in own])
                    yield from found(ids[own], a, c, full)
                    if not whole:
                        left = np.delete(own, full) if drop else own
                        yield out(m[left], k[left], ids[left], asks[left], bits[left], [sets[x] for x in left])
                lo = hi
        for r in np.flatnonzero(~inside):
            lo, hi = int(cut[r]), int(stop[r])
            if (int(m[lo]), int(k[lo])) != key:
                yield from closed()
                key = int(m[lo]), int(k[lo])
                held_id, held_asks, held_seen, held_bits, held_sets = ids[:0], asks[:0], held_seen[:0], bits[:0], []
            for at in range(lo, hi, few):
                to, n = min(hi, at + few), len(held_id)
                both_id, both_asks, both = (np.concatenate([x, y[at:to]]) for x, y in ((held_id, ids), (held_asks, asks), (held_bits, bits)))
                both_sets = [*held_sets, *(x.copy() for x in sets[at:to])]  # not the whole batch with them
                seen = np.concatenate([held_seen, np.zeros(to - at, bool)])
                own = both.view(np.uint64)  # of signed words the bits of the absolute value would be counted
                far = sum(np.bitwise_count(own[n:, w, None] ^ own[None, :, w]).astype(np.int16) for w in range(words))
                a, c = np.nonzero(np.tril(far <= may, n - 1))
                if members:
                    here = _first_met(both[a + n, words:], both[c, words:], *(np.full(len(a), x) for x in key), members)
                    either = np.unique(np.concatenate([a[here] + n, c[here]]))
                    new = either[~seen[either]]
                    yield met(*key, both_id[new], both.shape[1])
                    seen[new] = True
                else:
                    a, c, full = linked(both_asks, a + n, c, far[a, c], both_sets)
                    yield from found(both_id, a, c, full)
                    if drop:
                        both_id, both_asks, both, seen = (np.delete(x, full, axis=0) for x in (both_id, both_asks, both, seen))
                        gone = set(full.tolist())
                        both_sets = [x for i, x in enumerate(both_sets) if i not in gone]
                room = BUCKET
                if with_sets:
                    room = min(room, max(1, int(np.searchsorted(np.cumsum([x.nbytes for x in both_sets]), HELD, "right"))))
                if len(both_id) > room:
                    yield out(*key, both_id[room:], both_asks[room:], both[room:], both_sets[room:])
                held_id, held_asks, held_seen, held_bits, held_sets = both_id[:room], both_asks[:room], seen[:room], both[:room], both_sets[:room]
    yield from closed()


def _scanned(rows: DataFrame, schema: str, least: float, most: int, members: list[int] | None = None) -> DataFrame:
    """What scans of the buckets give until no rows are left for another: _k, _id, _b, _s0, _s1."""
    found = None
    while True:
        dealt = rows.repartition("_m", "_k").sortWithinPartitions("_m", "_k", "_id")
        scanned = materialize(dealt.mapInArrow(partial(scan_sketches, least=least, whole=True, most=most, drop=False, members=members), schema), "buckets")
        own, rows = scanned.where("_m = 0").select("_k", "_id", "_b", "_s0", "_s1"), scanned.where("_m <> 0")
        found = own if found is None else found.unionByName(own)
        if rows.isEmpty():
            return found


def _sketches(at: str = "_sk") -> list:
    return [F.col(at)[i].alias(f"_s{i}") for i in range(SKETCH // BITS)]


def _members(nodes: DataFrame, masks_of: list[int], least: float, times: int) -> DataFrame:
    """_m, _k, _id: documents in the first buckets in which they meet those that sketches don't tell apart from them."""
    fps = [F.col("_fps")[i].alias(f"_f{i}") for i in range(times)]
    rows = _dealt(nodes, masks_of).select("_m", "_k", "_id", F.lit(1).cast("long").alias("_b"), *_sketches(), *fps)
    found = _scanned(rows, ", ".join([FOUND, *(f"_f{i} long" for i in range(times))]), least, 0, masks_of)
    return materialize(found.select(F.col("_s0").alias("_m"), F.col("_s1").alias("_k"), "_id").distinct(), "members")


def _links_up_to(rest: DataFrame, members: DataFrame, sets: DataFrame, least: float, most: int) -> DataFrame:
    """_a > _b: documents of rest (_id, _sk, _asks) in one bucket that are like each other by the shingles of their texts (sets:
    _id, _set), for those _a that ask: the first `most` in each bucket. _b is null for each _a of which not all are given.
    """
    rows = members.join(rest.select("_id", "_sk", "_asks"), "_id")
    # Only buckets in which one asks, and what is before it there.
    keys = rows.where("_asks > 0").groupBy("_m", "_k").agg(F.max("_id").alias("_top"))
    rows = rows.join(keys, ["_m", "_k"]).where(F.col("_id") <= F.col("_top"))
    found = _scanned(rows.join(sets, "_id").select("_m", "_k", "_id", F.col("_asks").alias("_b"), *_sketches(), "_set"), WITH_SET, least, most)
    return materialize(found.select(F.col("_id").alias("_a"), F.when(F.col("_k") == 0, F.col("_b")).alias("_b")).distinct(), "proposed")


def _smallest(rest: DataFrame, members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Only the first in each bucket: a group of copies hands on one row for each, and nearly all of them go by that."""
    return _links_up_to(rest, members, sets, least, 1)


def _proposed(rest: DataFrame, members: DataFrame, sets: DataFrame, least: float, most: int = LINKS) -> DataFrame:
    """More of them, for what the smallest alone didn't decide."""
    return _links_up_to(rest, members, sets, least, most)


def _dealt(rest: DataFrame, masks_of: list[int]) -> DataFrame:
    """A row for each document and bucket: _m, _k, _id, _fps, _sk."""
    places = lambda fp: F.array(*[F.struct(F.lit(_signed(m)).alias("_m"), fp.bitwiseAND(F.lit(_signed(m))).alias("_k")) for m in masks_of])
    each = F.explode(F.array_distinct(F.flatten(F.transform("_fps", places))))  # fingerprints may share buckets
    return rest.select("_id", "_fps", "_sk", each.alias("_e")).select("_e._m", "_e._k", "_id", "_fps", "_sk")


def _few(df: DataFrame) -> DataFrame:
    """df, to be sent to every task if it is small."""
    return F.broadcast(df) if df.count() <= FEW else df


def _sets(texts: DataFrame) -> DataFrame:
    """_id, _set: the hashes of the shingles of texts (_id, _text), once where rows repeat."""

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return texts.map(shingle_hashes, na_action=None)

    return materialize(texts.select("_id", shingles("_text").alias("_set")).groupBy("_id").agg(F.first("_set").alias("_set")), "shingles")


def _linked(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """_a, _b: those of the pairs that are like each other. Sketches decide beyond their error, else the texts do."""
    left, right = nodes.select(F.col("_id").alias("_a"), F.col("_sk").alias("_x")), nodes.select(F.col("_id").alias("_b"), F.col("_sk").alias("_y"))
    far = sum((F.bit_count(F.col("_x")[k].bitwiseXOR(F.col("_y")[k])) for k in range(SKETCH // BITS)), F.lit(0))
    met = pairs.join(left, "_a").join(right, "_b").select("_a", "_b", far.alias("_d")).where(F.col("_d") <= _differing(least - MARGIN))
    met = materialize(met.withColumn("_sure", F.col("_d") <= _differing(least + MARGIN)), "met")

    asked = met.where("not _sure").select("_a", "_b")
    ends = materialize(asked.select(F.explode(F.array("_a", "_b")).alias("_id")).distinct(), "ends")
    # Each text that is asked for is hashed once.
    sets = _sets(texts.join(_few(ends), "_id", "left_semi"))
    both = asked.join(sets.select(F.col("_id").alias("_a"), F.col("_set").alias("_x")), "_a").join(sets.select(F.col("_id").alias("_b"), F.col("_set").alias("_y")), "_b")
    shared, sizes = F.size(F.array_intersect("_x", "_y")), F.size("_x") + F.size("_y")
    by_text = both.where((sizes == 0) | (shared >= F.lit(least) * (sizes - shared))).select("_a", "_b")
    return materialize(met.where("_sure").select("_a", "_b").unionByName(by_text), "alike")


def _settled(pairs: DataFrame, alike: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame | None, DataFrame]:
    """_id of what goes (None: nothing), and of what these pairs (_a > _b) don't decide.

    In each step those that wait for no other stay, and what is like them goes; each is given to `alike` with the smallest of
    them, and with the next in the next step if they aren't. A document without all its pairs (_b is null) waits until it
    goes. So what is decided stays decided.
    """
    went, a, b = None, F.col("_a"), F.col("_b")
    cut, left = pairs.where(b.isNull()).select(a.alias("_id")), pairs.where(b.isNotNull())
    while True:
        waits = materialize(left.select(a.alias("_id")).unionByName(cut).distinct(), "waits")
        now = materialize(left.join(waits.select(F.col("_id").alias("_b")), "_b", "left_anti").groupBy("_a").agg(F.min("_b").alias("_b")), "now")
        if now.isEmpty():
            # Those left have pairs with what stays no more: they wait for others, or for pairs that aren't given.
            return went, waits
        gone = materialize(alike(now).select(a.alias("_id")).distinct(), "gone")
        went = gone if went is None else went.unionByName(gone)
        left = left.join(now, ["_a", "_b"], "left_anti").join(gone.select(F.col("_id").alias("_a")), "_a", "left_anti").join(gone.select(F.col("_id").alias("_b")), "_b", "left_anti")
        left, cut = materialize(left.select("_a", "_b"), "left"), materialize(cut.join(gone, "_id", "left_anti"), "cut")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 2, distance: int = 5, times: int = 3, least: float = 0.5) -> DataFrame:
    """The rows of docs without near copies of documents that stay.

    A document goes if its text shares at least `least` of its five-word shingles (Jaccard) with one of smaller
    identifier that stays. Documents meet in the buckets of `times` fingerprints each, over shingles of `words` words: any
    two with fingerprints within the distance meet, and most others that are like each other. In a bucket each is compared
    with all of smaller identifier, by sketches of the five-word shingles; those that sketches don't tell apart come again with
    the shingles of their texts, in the first bucket that they share, and are told apart there, so pairs that aren't alike are
    no rows. Each gets the smallest that it is like, and is settled in the order of identifiers: what has no smaller one left
    stays, and what is like it goes, once compared by text. What isn't decided asks again for more, of what hasn't gone.
    Decisions are final, so in the end all that goes is like a smaller one that stays, and no two that met and stay are like
    each other. Links grow with the documents, not with the pairs of a group.

    Rows alike in identifier and text share one fate; of rows with one identifier the texts decide, in the order of their
    hashes. Rows without identifier stay. Null and blank texts have no shingles and are copies of one another. An empty
    table gives an empty result; other columns come along whatever their names.
    """
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    hashed = F.xxhash64(F.coalesce(text, F.lit("")), F.lit(5))

    @F.pandas_udf("fps array<long>, sk array<long>")
    def marks(texts: pd.Series) -> pd.DataFrame:
        rows = [(np.array(simhashes(t, words, times), np.uint64).view(np.int64), sketch(t)) for t in texts]
        return pd.DataFrame(rows, columns=["fps", "sk"])

    own = docs.where(key.isNotNull()).select(key.alias("_key"), hashed.alias("_th"), marks(text).alias("_v")).groupBy("_key", "_th").agg(F.first("_v").alias("_v"))
    nodes = materialize(numbered_rows(own.select("_key", "_th", F.col("_v.fps").alias("_fps"), F.col("_v.sk").alias("_sk")), [F.col("_key"), F.col("_th")], "_id"), "nodes")
    n, both = co_occurrence(nodes.select(F.explode(F.array_distinct("_fps")).alias("_fp")))
    if not n:
        return docs
    of = masks(plan_parts(n, both, distance, SKETCH_COST))
    named = nodes.select("_key", "_th", "_id")

    def texts_of(ids: DataFrame) -> DataFrame:
        wanted = materialize(named.join(ids, "_id", "left_semi"), "wanted")
        return docs.where(key.isNotNull()).select(key.alias("_key"), hashed.alias("_th"), text.alias("_text")).join(_few(wanted), ["_key", "_th"]).select("_id", "_text")

    def alike(pairs: DataFrame) -> DataFrame:
        return _linked(pairs, nodes, texts_of(pairs.select(F.explode(F.array("_a", "_b")).alias("_id")).distinct()), least)

    members = _members(nodes, of, least, times)
    sets = _sets(texts_of(members.select("_id").distinct()))
    gone, most = None, LINKS
    pairs = _smallest(nodes.withColumn("_asks", F.lit(1).cast("long")), members, sets, least)
    while True:
        went, waits = _settled(pairs, alike)
        if went is not None:
            gone = went if gone is None else gone.unionByName(went)
        if most > LINKS and waits.isEmpty():
            break
        stay = nodes if gone is None else nodes.join(gone, "_id", "left_anti")
        asks = waits.withColumn("_asks", F.lit(1).cast("long"))
        rest = materialize(stay.join(asks, "_id", "left").withColumn("_asks", F.coalesce("_asks", F.lit(0).cast("long"))), "rest")
        pairs, most = _proposed(rest, members, sets, least, most), MORE * most
    if gone is None:
        return docs
    left = materialize(gone.join(named, "_id").select(F.col("_key").alias("_near_key"), F.col("_th").alias("_near_hash")), "left")
    return docs.join(_few(left), (key == F.col("_near_key")) & (hashed == F.col("_near_hash")), "left_anti")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), words=3, distance=3)
