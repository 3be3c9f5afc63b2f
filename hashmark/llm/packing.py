"""Filling fixed-capacity containers with items: variable-capacity best-fit over a histogram of sizes."""

from __future__ import annotations

import bisect
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hashmark.llm.tokens import encode
from hashmark.session import cut

#: Tokens a container holds, and the lengths it may be cut down to.
CAPACITY = 2048
LENGTHS = (256, 512, 1024, 2048)
#: What opening a container costs beside its length, in tokens: why two half containers are dearer than a whole one.
OPENING = 32
#: Items of one size are numbered in parts of about so many.
PART_ITEMS = 100_000


class Placement(NamedTuple):
    """Items ``first`` .. ``until`` of a size go to containers from ``container`` on, ``each`` to one."""

    size: int
    first: int
    until: int
    container: int
    each: int


def plan(histogram: dict[int, int], lengths: tuple[int, ...] = LENGTHS) -> list[Placement]:
    """Best-fit, largest first, over sizes and how many items have them; its length depends on the sizes alone.

    All items of a size are placed at once: into the open containers with the least room that is enough, runs of
    containers with equal room being one entry. Where none is open, containers of that permitted length are
    opened that costs least per token, judged by how far the sizes still to come would fill one.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    rooms: list[int] = []  # sorted
    runs: dict[int, list[tuple[int, int]]] = {}
    opened = 0
    out: list[Placement] = []

    def add(room: int, lo: int, hi: int) -> None:
        if hi > lo and room > 0:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            runs[room].append((lo, hi))

    def filled(length: int, size: int) -> int:
        room = length
        for s in sorted((s for s in left if s <= size), reverse=True):
            if room >= s:
                room -= min(left[s], room // s) * s
            if not room:
                break
        return length - room

    for size in sorted(left, reverse=True):
        first, n = 0, left[size]
        while first < n:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                length = min((x for x in lengths if x >= size), key=lambda x: ((x + OPENING) / filled(x, size), x))
                count = -(-(n - first) // (length // size))
                add(length, opened, opened + count)
                opened += count
                continue
            room = rooms[at]
            lo, hi = runs[room].pop()
            if not runs[room]:
                del runs[room]
                rooms.pop(at)
            each = room // size
            whole = min(hi - lo, (n - first) // each)
            if whole:
                out.append(Placement(size, first, first + whole * each, lo, each))
                add(room - each * size, lo, lo + whole)
                first += whole * each
                lo += whole
            if first < n and lo < hi:
                out.append(Placement(size, first, n, lo, n - first))
                add(room - (n - first) * size, lo, lo + 1)
                first, lo = n, lo + 1
            add(room, lo, hi)
        del left[size]
    return out


def pieces(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """``key``, ``piece`` from 0, ``size``: an item beyond the capacity is cut into full pieces and a rest; empty ones (and nulls) have none."""
    n = F.ceil(F.col(size) / capacity).cast("int")
    part = sizes.where(F.col(size) > 0).select(key, F.col(size).alias("_size"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    return part.select(key, "piece", F.least(F.lit(capacity), F.col("_size") - F.col("piece") * capacity).cast("int").alias("size"))


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "size", capacity: int = CAPACITY, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """``key``, ``piece``, ``container``, ``size``: where each item, or piece of one beyond the capacity, goes.

    The driver sees how many items each size has, at most ``capacity`` numbers whatever the corpus, and plans runs of
    containers for runs of items. Spark numbers the items within each size, in parts by its frequency so that none
    is large, and looks each number up in the plan. Items of equal key are
    items of their own; sizes of 0, below and null need no place. No item is split that fits.
    """
    if max(lengths) != capacity:
        raise ValueError("the largest permitted length is the capacity")
    spark = sizes.sparkSession
    items = pieces(sizes, key, size, capacity)
    histogram = {r.size: r.n for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.createDataFrame(plan(histogram, lengths), "p_size int, p_first long, p_until long, p_container long, p_each long")
    parts = spark.createDataFrame([(s, -(-n // PART_ITEMS)) for s, n in histogram.items()], "size int, n_parts int")
    items = items.join(F.broadcast(parts), "size").withColumn("_part", F.pmod(F.xxhash64(key, "piece"), F.col("n_parts")).cast("int")).drop("n_parts")
    counts = items.groupBy("size", "_part").agg(F.count(F.lit(1)).alias("n"))

    offsets = counts.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("size", "_part", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("size", "_part").orderBy(key, "piece")) - 1)
    numbered = ranked.join(offsets, ["size", "_part"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = numbered.join(F.broadcast(runs), (F.col("size") == F.col("p_size")) & (F.col("rank") >= F.col("p_first")) & (F.col("rank") < F.col("p_until")))
    return placed.select(key, "piece", (F.col("p_container") + F.floor((F.col("rank") - F.col("p_first")) / F.col("p_each"))).cast("long").alias("container"), "size")


def containers(packed: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """``container``, ``n_items``, ``used``, ``length``: each cut down to the least permitted length that its contents need."""
    used = packed.groupBy("container").agg(F.count(F.lit(1)).alias("n_items"), F.sum("size").alias("used"))
    return used.withColumn("length", F.coalesce(*[F.when(F.col("used") <= x, x) for x in sorted(lengths)]))


def faults(packed: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``key``, ``in_order``, ``cut_only_beyond``, ``within``: whether an item's pieces are numbered 0, 1, .. without gap, all but the
    last full (so that none is cut that fits), and all their containers within the capacity."""
    used = packed.groupBy("container").agg((F.sum("size") <= capacity).alias("within"))
    full = F.count_if(F.col("size") == capacity)
    counts = [F.count(F.lit(1)).alias("n"), F.min("piece").alias("a"), F.max("piece").alias("b"), full.alias("n_full"), F.bool_and("within").alias("within")]
    placed = packed.join(used, "container").groupBy(key).agg(*counts)
    return placed.select(key, ((F.col("a") == 0) & (F.col("b") + 1 == F.col("n"))).alias("in_order"), (F.col("n_full") >= F.col("n") - 1).alias("cut_only_beyond"), "within")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """All documents' texts, sized in tokens, packed."""
    sized = cut(encode(docs, counts=True).withColumnRenamed("ids", "size"))
    return pack(sized, "doc_id", "size", capacity, lengths)
