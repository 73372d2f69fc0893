"""Mixes sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: the mix has SHARE times all words; sources in code point order, null last, weigh WEIGHTS in turn; a target stops at
MOST times its source's words and the excess goes to the others by weight until none is above. A source's documents are
dealt to shards by a seeded hash; a shard's documents, in seeded order, make one run of words that is cut into blocks
of BLOCK words. The mix's blocks go to sources, and a source's to its shards, one by one to the highest quotient
weight / (2 * blocks so far + 1). Whole rounds of a shard's quota take all its blocks; the rest takes as many blocks
in a row, around the end, from a seeded place, so that at most two documents of a shard are cut.

A shard has a 4096th of all words, SHARD_WORDS[0] at least and SHARD_WORDS[1] at most, so that a task's share stays bounded while the number of
shards grows. Shards and their quotas are tables; a source's shards are apportioned together in one task (a row each, 40 bytes). The driver
sees a row for each source, and sends that table along up to FEW sources; more are joined by a shuffle.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.core import _SEPARATOR, Scratch, buffers, col, prepare

SHARE, WEIGHTS, MOST = 1.5, (5, 2, 1), 2
BLOCK, SHARD_WORDS, FEW = 16, (1 << 16, 1 << 24), 1 << 16


@F.arrow_udf(T.LongType())
def word_count(text: pa.Array) -> pa.Array:
    """Runs of bytes other than space and tab to carriage return; 0 for null."""
    data, offsets = buffers(text)
    letter = ~_SEPARATOR[data]
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = letter[first]
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(start, out=total[1:])
    return pa.array(total[offsets[1:]] - total[offsets[:-1]], pa.int64())


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Each source's target, for sizes in the sources' order."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, room, free = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while free:
        unit = room / sum(weight[i] for i in free)
        full = [i for i in free if unit * weight[i] > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weight[i]
            break
        for i in sorted(full):
            out[i] = float(most * sizes[i])
            room -= out[i]
            free.discard(i)
    return out


def sainte_lague(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients weight / (2 * seats + 1), the first of equal ones; none gets more than its cap."""
    out, free = [0] * len(weights), [i for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    seats = min(seats, sum(caps[i] for i in free))
    while seats and free:
        total = sum(weights[i] for i in free)
        got = {i: int(weights[i] / total * seats + 0.5) for i in free}
        left = seats - sum(got.values())
        if left > 0:
            heap = [(-weights[i] / (2 * got[i] + 1), i) for i in free]
            heapq.heapify(heap)
            for _ in range(left):
                i = heap[0][1]
                got[i] += 1
                heapq.heapreplace(heap, (-weights[i] / (2 * got[i] + 1), i))
        elif left < 0:
            heap = [(weights[i] / (2 * got[i] - 1), -i) for i in free if got[i]]
            heapq.heapify(heap)
            for _ in range(-left):
                i = -heapq.heappop(heap)[1]
                got[i] -= 1
                if got[i]:
                    heapq.heappush(heap, (weights[i] / (2 * got[i] - 1), -i))
        full = [i for i in free if got[i] >= caps[i]]
        if not any(got[i] > caps[i] for i in full):
            for i in free:
                out[i] = got[i]
            break
        for i in full:
            out[i] = caps[i]
            seats -= caps[i]
        free = [i for i in free if got[i] < caps[i]]
    return out


def _seeded(*key: object) -> int:
    return int.from_bytes(hashlib.sha256(repr(key).encode()).digest()[:8], "big")


_CHOSEN = "__i int, __shard int, __rounds int, __x long, __y long, __z long"


def _shard_quotas(seed: int):
    """From the shards (__i, __name, __shard, words, blocks) of one source and its quota: how many whole rounds each takes, and where its blocks begin and end."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["__shard"])
        quotas = sainte_lague([float(r["words"]) for r in rows], rows[0]["quota"], [MOST * r["blocks"] for r in rows])
        out = []
        for r, quota in zip(rows, quotas, strict=True):
            n = r["blocks"]
            whole, extra = divmod(quota, n) if n else (0, 0)
            at = _seeded(seed, r["__name"], r["__shard"]) % n if n else 0
            out.append((r["__i"], r["__shard"], whole, at * BLOCK, min(at + extra, n) * BLOCK, max(0, at + extra - n) * BLOCK))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _CHOSEN.split(", ")])

    return run


def plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, carried: list[str]) -> DataFrame:
    """row (a struct of the carried columns) and how it's mixed: __size, __source_size, __target, __rounds (whole copies) and the words [__from_1, __to_1) and [__from_2, __to_2) of one more."""
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "mixing")
    key = F.xxhash64(F.coalesce(col(id_col).cast("string"), col(text_col)), F.lit(seed))
    sized = docs.select(F.struct(*[col(c) for c in carried]).alias("row"), col(id_col).alias("id"), key.alias("key"), col(source_col).cast("string").alias("source"), word_count(col(text_col)).alias("__size"))
    slim = scratch.keep(sized.select("key", "source", F.col("__size").alias("size")), "sizes")

    totals = {r["source"]: r["words"] for r in slim.groupBy("source").agg(F.sum("size").alias("words")).collect()}
    names = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    sizes = [totals[s] for s in names]
    wanted = targets(sizes)
    shard_words = min(max(SHARD_WORDS[0], -(-sum(sizes) // 4096)), SHARD_WORDS[1])
    shards = [max(1, -(-n // shard_words)) for n in sizes]
    few = F.broadcast if len(names) <= FEW else lambda df: df
    sources = spark.createDataFrame(
        [(i, s, int(n), float(t), int(k)) for i, (s, n, t, k) in enumerate(zip(names, sizes, wanted, shards, strict=True))], "__i int, __name string, __source_size long, __target double, __shards int"
    )

    def dealt(df: DataFrame) -> DataFrame:
        df = df.join(few(sources), F.col("source").eqNullSafe(F.col("__name")))
        return df.withColumn("__shard", F.pmod(F.xxhash64("key"), F.col("__shards")).cast("int"))

    found = dealt(slim).groupBy("__i", "__name", "__shard").agg(F.sum("size").alias("words"))
    found = scratch.keep(found.withColumn("blocks", F.ceil(F.col("words") / BLOCK).cast("long")), "shards")
    room = {r["__i"]: MOST * r["blocks"] for r in found.groupBy("__i").agg(F.sum("blocks").alias("blocks")).collect()}
    quotas = sainte_lague(wanted, round(sum(wanted) / BLOCK), [room[i] for i in range(len(names))])
    quotas = spark.createDataFrame(list(enumerate(quotas)), "__i int, quota long")
    chosen = scratch.keep(found.join(few(quotas), "__i").groupBy("__i").applyInArrow(_shard_quotas(seed), _CHOSEN), "chosen")

    order = Window.partitionBy("__i", "__shard").orderBy(F.xxhash64(F.lit(seed + 1), "key"), F.col("id"), F.col("__size"))
    out = dealt(sized).withColumn("__end", F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(chosen, ["__i", "__shard"]).withColumn("__start", F.col("__end") - F.col("__size"))

    def inside(edge: str) -> F.Column:
        return F.least(F.greatest(F.expr(f"{edge} - __start"), F.lit(0)), F.col("__size"))

    out = out.withColumns({"__from_1": inside("__x"), "__to_1": inside("__y"), "__from_2": F.lit(0).cast("long"), "__to_2": inside("__z")})
    return out.select("row", "__size", "__source_size", "__target", "__rounds", "__from_1", "__to_1", "__from_2", "__to_2")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20) -> DataFrame:
    """id, size (words), source_size, target (the source's) and taken (words the mix takes, repeats counted) per row of docs.

    Null texts have size 0. Rows with an id of null are dealt by their text. Reruns agree, whatever the cluster, as long as the rows do.
    """
    slim = plan(docs, id_col, text_col, source_col, seed, [id_col])
    taken = F.col("__rounds") * F.col("__size") + F.col("__to_1") - F.col("__from_1") + F.col("__to_2") - F.col("__from_2")
    return slim.select(col(id_col, "row").alias(id_col), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), taken.cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20) -> DataFrame:
    """The mix, with the columns of docs: a row for each whole copy, and one with the words that a cut leaves, joined by one space."""
    planned = plan(docs, id_col, text_col, source_col, seed, docs.columns)
    text = col(text_col, "row")
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    part = lambda a, b: F.slice(words, F.col(a) + 1, F.col(b) - F.col(a))
    two = F.col("__to_1") - F.col("__from_1") + F.col("__to_2") - F.col("__from_2")
    cut = F.when(two == F.col("__size"), text).otherwise(F.array_join(F.concat(part("__from_2", "__to_2"), part("__from_1", "__to_1")), " "))
    copies = F.concat(
        F.when(F.col("__rounds") > 0, F.array_repeat(F.lit(True), F.col("__rounds"))).otherwise(F.array().cast("array<boolean>")),
        F.when(two > 0, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")),
    )
    rows = planned.filter("__size > 0").withColumn("__whole", F.explode(copies))
    return rows.select(*[F.when(F.col("__whole"), text).otherwise(cut).alias(c) if c == text_col else col(c, "row").alias(c) for c in docs.columns])
