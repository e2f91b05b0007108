"""Operator 8: mixing sources to target weights by Pfair scheduling.

Each source's documents are dealt into blocks in the order of a hash. In the ideal mixture every source has exactly
its weight's share at any time; when one runs out, the others go on with their weights scaled up. Block j of a source
may not start before the slot in which the ideal reaches j - 1 blocks of it and must be done when the ideal reaches j;
earliest deadline first over these windows keeps every source within one block of the ideal at every slot, however
many there are. Windows are found from the exact weights in whole numbers. One task walks through the blocks (never
the rows) and writes their slots as a table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import partial
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, findable, materialize

#: Documents in a block.
BLOCK = 64
#: Documents in one ranking bucket, and buckets of a source at most.
BUCKET, BUCKETS = 1000, 65_536
#: Slots in one batch of the schedule.
BATCH = 1 << 16


@dataclass
class Phase:
    source: str
    first: int  # blocks from first to last (exclusive) of the source run in this phase
    last: int
    share: int
    period: int
    base: int  # slots before the phase
    slots: list[int]  # of the source in one period


def _whole(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the same proportions."""
    ratios = {s: Fraction(w).as_integer_ratio() for s, w in weights.items()}
    common = lcm(*{d for _, d in ratios.values()})
    return {s: n * (common // d) for s, (n, d) in ratios.items()}


def _in_order(blocks: dict[str, int], weights: dict[str, int]) -> Iterator[tuple[str, int]]:
    """Source and block (from 0) of each slot; weights are above 0. Equal deadlines go by name.

    At virtual time v the ideal has min(blocks, weight * v) blocks of a source, so it is piecewise linear in v.
    """
    ends = sorted(blocks, key=lambda s: Fraction(blocks[s], weights[s]))
    # While the k sources that end first are done, the ideal has done[k] + rate[k] * v blocks in all.
    done, rate = [0], [sum(weights.values())]
    for s in ends:
        done.append(done[-1] + blocks[s])
        rate.append(rate[-1] - weights[s])
    piece = dict.fromkeys(blocks, 0)

    def reached(s: str, j: int) -> tuple[int, int]:
        """Slot in which the ideal reaches j blocks of s, rounded down and up."""
        k, w = piece[s], weights[s]
        while blocks[ends[k]] * w < j * weights[ends[k]]:
            k += 1
        piece[s] = k
        whole, part = divmod(rate[k] * j, w)
        return done[k] + whole, done[k] + whole + (part > 0)

    waiting, ready = [], []

    def wait(s: str, j: int, release: int) -> None:
        after, deadline = reached(s, j)
        heapq.heappush(waiting, (release, deadline, s, j, after))

    for s in blocks:
        wait(s, 1, 0)
    for slot in range(done[-1]):
        while waiting and waiting[0][0] <= slot:
            _, deadline, s, j, after = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, j, after))
        _, s, j, after = heapq.heappop(ready)
        yield s, j - 1
        if j < blocks[s]:
            wait(s, j + 1, after)


def slots_in_order(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int]]:
    """Source and block of each slot from 0. Sources of weight zero come after all others, evenly among themselves."""
    named = {s: n for s, n in blocks.items() if n and weights.get(s, 0) > 0}
    others = {s: n for s, n in blocks.items() if n and s not in named}
    if named:
        yield from _in_order(named, _whole({s: weights[s] for s in named}))
    if others:
        yield from _in_order(others, dict.fromkeys(others, 1))


def period_slots(shares: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source where all end together after sum(shares) slots."""
    out: dict[str, list[int]] = {s: [] for s in shares}
    for slot, (s, _) in enumerate(_in_order(shares, shares)):
        out[s].append(slot)
    return out


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> list[Phase]:
    """The slots of all blocks, as one phase for each source."""
    out: dict[str, list[int]] = {s: [] for s, n in blocks.items() if n}
    for slot, (s, _) in enumerate(slots_in_order(blocks, weights)):
        out[s].append(slot)
    total = sum(map(len, out.values()))
    return [Phase(s, 0, len(slots), len(slots), total, 0, slots) for s, slots in out.items()]


def _planned(batches: Iterator[pa.RecordBatch], weights: dict[str, float] | None, block: int) -> Iterator[pa.RecordBatch]:
    """Rows (_of, _at, _slot) of the whole schedule from rows (_source, _n), which one task gets."""
    sizes = {s: n for b in batches for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    wanted = {s: n**0.5 for s, n in sizes.items()} if weights is None else weights
    order = slots_in_order({s: -(-n // block) for s, n in sorted(sizes.items())}, wanted)
    base = 0
    while part := list(islice(order, BATCH)):
        of, own = zip(*part)
        slots = pa.array(range(base, base + len(part)), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(own, pa.int64()), slots], ["_of", "_at", "_slot"])
        base += len(part)


def _key(source_col: str):
    """Source as text; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("null"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block: int = BLOCK, carry: bool = False, seed: int = 8) -> DataFrame:
    """One row for each input row: id_col, source_col, block (of its source, from 0), slot, position (order in the mixture).

    weights: target weight of each source; by default the root of its size, which evens large and small sources
    out. Sources not named, or of weight 0, come last. No row is dropped or repeated. A null source is a source of
    its own, null identifiers and texts are hashed as such, repeated rows keep a place each, an empty table gives an
    empty result. With carry the whole input row comes along as struct `row`.
    """
    spark = docs.sparkSession
    key = _key(source_col)
    findable(spark)
    sizes = materialize(docs.groupBy(key.alias("_source")).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    wanted = None if weights is None else {"null" if s is None else f"={s}": w for s, w in weights.items()}
    plan = materialize(sizes.coalesce(1).mapInArrow(partial(_planned, weights=wanted, block=block), "_of string, _at long, _slot long"), "plan")
    dealt = sizes.select("_source", F.least(F.lit(BUCKETS), F.ceil(F.col("_n") / BUCKET)).cast("int").alias("_buckets"))
    rows = docs.select(
        key.alias("_source"), F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("_name"),
        F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")).alias("_hash"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []),
    )
    # Ranks: a bucket is a range of hashes, so a rank is the rank in its bucket after the sizes of those before.
    place = F.shiftrightunsigned(F.col("_hash"), 32).cast("long")
    rows = rows.join(dealt, "_source").withColumn("_bucket", F.shiftright(place * F.col("_buckets"), 32))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_source", "_bucket").count().select("_source", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_source", "_bucket").orderBy(place, "_hash", "_id")
    ranked = rows.withColumn("_nth", F.row_number().over(inside) - 1).join(sums, ["_source", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_nth")).withColumn("_block", F.floor(F.col("_rank") / block))
    # The plan has one row for each block of each source. Its size decides how it is joined.
    found = ranked.join(plan, (F.col("_source") == F.col("_of")) & (F.col("_block") == F.col("_at")))
    slot = F.col("_slot")
    return found.select(
        F.col("_id").alias(id_col), F.col("_name").alias(source_col), F.col("_block").alias("block"), slot.alias("slot"),
        (slot * block + F.col("_rank") % block).cast("long").alias("position"), *([F.col("_row").alias("row")] if carry else []),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
