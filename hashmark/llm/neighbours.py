"""The most similar vectors of every vector, by additive quantisation and exact reranking."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashmark.llm import quantizer
from hashmark.session import cut

#: The codebooks are fitted on at most about so many vectors, drawn by a hash of their ids; everything else covers all.
SAMPLE = 98_304
#: Words of the first level: one for so many sampled vectors, at most FIRST; then the sizes of the other levels.
PER_WORD, FIRST, RESIDUAL = 48, 2048, (64,) * 8
#: Prefixes kept by the beam search; a cell's members that are told apart by exact products without the tables.
BEAM, RERANK = 6, 160
#: A vector is looked up in all cells no further behind their border than this by the square root of the dimensions, as a
#: neighbour differs from it by so much in any one direction; in LEAST cells at least, in PROBES at most.
BEHIND, LEAST, PROBES = 1.0, 3, 16
#: Members of a cell that are searched in one block; a cell of DIVIDE times as many is divided by one word more, by DEPTH words at most.
CELL, DIVIDE, DEPTH = 16_384, 4, 3
#: Prefixes that are divided are known to every task; beyond so many, cells are searched in blocks instead.
MAX_DIVIDED = 1 << 20
#: Vectors looked up in a cell that meet its members in one group; and divided cells of which a list is still broadcast.
CHUNK, MOST_BROADCAST = 16_384, 100_000
#: Rows that a searching task reads on average, whatever the cluster's setting for shuffles.
TASK_ROWS = 32_768
#: Rows an encoding task holds at once to find copies among them.
HELD = 65_536
#: Vectors have the same direction if their cosine is no further below 1: multiples of each other in single precision are within it.
ALIKE = 1e-14
#: Cosines in double and products in single precision that differ by no more count as equal.
NOISE, ROUGH = 1e-6, 1e-5


def _usable(batch: pa.RecordBatch, at: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the batch whose array is ``dims`` finite numbers, not all zero, and those as doubles."""
    column = batch.column(at)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(0))
    rows = np.flatnonzero(sizes == dims)
    values = column.take(pa.array(rows)).flatten() if len(rows) else pa.array([], pa.float64())
    x = np.asarray(values.to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), dims)
    fine = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[fine], x[fine]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _directions(unit: np.ndarray) -> np.ndarray:
    """For each row the first row of the same direction: found by rounded coordinates, verified by the cosine.

    Few rows stay apart although they are alike, as rounding separates them; the search doesn't depend on it.
    """
    bucket = np.unique(_keys(np.round(unit * 1e4).astype(np.int16)), return_inverse=True)[1]
    label, left = np.arange(len(unit)), np.arange(len(unit))
    for _ in range(16):
        if not len(left):
            break
        _, first, same = np.unique(bucket[left], return_index=True, return_inverse=True)
        head = left[first][same]
        alike = np.einsum("rd,rd->r", unit[left], unit[head]) >= 1 - ALIKE
        label[left[alike]] = head[alike]
        left = left[~alike]
    return label


def _keys(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()


def _sample(vectors: DataFrame, dims: int, size: int, n: int) -> np.ndarray:
    scale = 1 << 32
    share = min(1.0, size / max(n, 1))
    drawn = vectors.where((F.size("vector") == dims) & (F.pmod(F.xxhash64("id"), F.lit(scale)) < int(share * scale)))
    # ids that repeat are drawn together: only then a limit is needed, which passes through one task
    many = drawn.count() > 2 * size
    table = drawn.select("vector").limit(2 * size).toArrow() if many else drawn.select("vector").toArrow()
    found = [_usable(b, 0, dims)[1] for b in table.to_batches()]
    x = np.concatenate(found) if found else np.zeros((0, dims))
    return _unit(x).astype(np.float32) if len(x) else x.astype(np.float32)


def _behind(far: np.ndarray, words: np.ndarray, near: np.ndarray) -> np.ndarray:
    """How far behind the border of its nearest word's cell each of the words ``near`` begins, nearest first; ``far``: halves of squared distances."""
    apart = np.linalg.norm(words[near] - words[near[:, :1]], axis=2)
    apart[:, 0] = 1
    return (far - far[:, :1]) / np.maximum(apart, 1e-6)


def _visited(x: np.ndarray, words: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Which of the words ``near``, nearest first, a vector is looked up by."""
    far = (words[near] ** 2).sum(2) / 2 - np.einsum("nd,nwd->nw", x, words[near])
    return (_behind(far, words, near) <= BEHIND / np.sqrt(x.shape[1])) | (np.arange(near.shape[1]) < LEAST)


def _path(books: quantizer.Codebooks, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The nearest word of each level to what the nearest ones before leave over, beginning with ``first``."""
    path, left = [first], x
    for before, words in zip(books.words, books.words[1:DEPTH]):
        left = left - before[path[-1]]
        path.append(quantizer.nearest(left, words))
    return np.stack(path, axis=1).astype(np.uint16)


def _encoder(books: Broadcast, dims: int, k: int):
    """Among the rows held at once, exact copies of a vector become one row with their least ids; so do more than ``k`` + 1 vectors of one direction.

    A row has at most ``k`` + 1 ids; the others follow as rows without vector.
    """

    def encoded(id_: np.ndarray, raw: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(id_, kind="stable")
        id_, raw = id_[order], raw[order]
        _, first, same = np.unique(_keys(raw), return_index=True, return_inverse=True)
        # few multiples of a vector keep their own, many become one
        head = _directions(_unit(raw[first].astype(np.float64)))
        many = np.bincount(head[same], minlength=len(first)) > k + 1
        merged = np.where(many[head], head, np.arange(len(first)))[same]
        _, first, same = np.unique(merged, return_index=True, return_inverse=True)
        members: list[list[int]] = [[] for _ in first]
        rest_of, rest = [], []
        for i, c in zip(id_.tolist(), same.tolist()):
            if len(members[c]) <= k:
                members[c].append(i)
            else:
                rest_of.append(members[c][0])
                rest.append(i)
        x = raw[first]
        for at in range(0, len(x), 4096):
            part = slice(at, at + 4096)
            u = _unit(x[part].astype(np.float64)).astype(np.float32)
            codes, errors, near = quantizer.encode(books.value, u, BEAM, PROBES)
            visited = np.concatenate([_visited(u[i : i + 1024], books.value.words[0], near[i : i + 1024]) for i in range(0, len(u), 1024)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(members[part], pa.list_(pa.int64())),
                    pa.array([v.tobytes() for v in x[part]], pa.binary()),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(errors, pa.float32()),
                    pa.array([p.tobytes() for p in _path(books.value, u, near[:, 0].astype(np.int64))], pa.binary()),
                    pa.array([w[v].tobytes() for w, v in zip(near, visited)], pa.binary()),
                    pa.nulls(len(codes), pa.int64()),
                ],
                names=_ENCODED,
            )
        if rest:
            none = pa.nulls(len(rest), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([[i] for i in rest], pa.list_(pa.int64())), none, none, pa.nulls(len(rest), pa.float32()), none, none, pa.array(rest_of, pa.int64())], names=_ENCODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            rows, x = _usable(batch, 1, dims)
            held.append((np.asarray(batch.column(0))[rows].astype(np.int64), x.astype(np.float32)))
            n += len(rows)
            if n >= HELD:
                yield from encoded(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield from encoded(*map(np.concatenate, zip(*held)))

    return run


_ENCODED = ["ids", "vector", "code", "error", "path", "near", "copy_of"]
_PLACED = "ids array<bigint>, vector binary, code binary, error float, cells array<struct<cell:binary,home:boolean>>"


def _placer(shared: Broadcast, divided: Broadcast):
    """The cell of each vector, and the others that it is looked up in, up to PROBES in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, books = divided.value, shared.value

        def parts(prefix: bytes, left: np.ndarray, words: int) -> Iterator[tuple[float, bytes]]:
            """The cells that a divided one has for what the prefix leaves over of a vector, and how far behind the border they begin."""
            level = books.words[words]
            far = (level * level).sum(1) / 2 - level @ left
            near = quantizer.smallest(far[None], PROBES)
            behind = _behind(far[near], level, near)[0]
            for i, (word, b) in enumerate(zip(near[0], behind.tolist())):
                if i < LEAST or b <= BEHIND / np.sqrt(len(left)):
                    cell = prefix + np.uint16(word).tobytes()
                    if cell in known and words + 1 < DEPTH:
                        yield from ((max(b, c), x) for c, x in parts(cell, left - level[word], words + 1))
                    else:
                        yield b, cell

        for batch in batches:
            cells = []
            for raw, path, near in zip(*[batch.column(i).to_pylist() for i in (1, 4, 5)]):
                words = 1
                while 2 * words < len(path) and path[: 2 * words] in known:
                    words += 1
                home = path[: 2 * words]
                found = dict.fromkeys([home])
                first = [near[i : i + 2] for i in range(0, len(near), 2)]
                if not known.isdisjoint(first):
                    x = _unit(np.frombuffer(raw, np.float32).astype(np.float64)[None])[0].astype(np.float32)
                    each = [parts(c, x - books.words[0][int.from_bytes(c, sys.byteorder)], 1) if c in known else [(0.0, c)] for c in first]
                    first = [c for _, c in sorted((p for cell in each for p in cell), key=lambda p: p[0])]
                found |= dict.fromkeys(first)
                cells.append([{"cell": c, "home": c == home} for c in list(found)[:PROBES]])
            kind = pa.list_(pa.struct([("cell", pa.binary()), ("home", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(cells, kind)], names=["ids", "vector", "code", "error", "cells"])

    return run


def _placed_cells(distinct: DataFrame, shared: Broadcast, divided: Broadcast, n: int) -> DataFrame:
    """Each vector once for every cell it is looked up in: ``cell``, ``block``, ``chunk``, whether it ``asks`` there and is a ``member``.

    Cells differ in what they hold, and more in who comes by: a cell of more than ``CELL`` members is cut into blocks of them, and those
    looked up in a cell into chunks of ``CHUNK``, each chunk meeting each block in a group of its own. So no group
    grows with the data, and members, being few where many come by, are what is repeated.
    """

    placed = distinct.select("ids", "vector", "code", "error", "path", "near").mapInArrow(_placer(shared, divided), _PLACED)
    # only members are told apart by their codes
    held = ["ids", "vector", F.when(F.col("at.home"), F.col("code")).alias("code"), F.when(F.col("at.home"), F.col("error")).alias("error")]
    cells = placed.select("ids", "vector", "code", "error", F.explode("cells").alias("at")).select(*held, "at.cell", "at.home")
    if n <= CHUNK:
        return cells.select("cell", F.lit(0).alias("block"), F.lit(0).alias("chunk"), "ids", "vector", "code", "error", F.lit(True).alias("asks"), F.col("home").alias("member"))
    counted = placed.select(F.explode("cells").alias("at")).groupBy("at.cell").agg(F.count_if("at.home").alias("members"), F.count(F.lit(1)).alias("visitors"))
    parts = lambda c, size: F.ceil(F.col(c) / size).cast("int")
    load = cut(counted.where((F.col("members") > CELL) | (F.col("visitors") > CHUNK)).select("cell", F.greatest(parts("members", CELL), F.lit(1)).alias("n_blocks"), parts("visitors", CHUNK).alias("n_chunks")))
    known = cells.join(F.broadcast(load) if load.count() <= MOST_BROADCAST else load, "cell", "left")
    key = F.xxhash64(F.col("ids")[0])
    own_block, own_chunk = F.pmod(key, F.col("n_blocks")).cast("int"), F.pmod(F.xxhash64(key), F.col("n_chunks")).cast("int")

    def place(block, chunk, asks: bool, member) -> Column:
        return F.struct(block.alias("block"), chunk.alias("chunk"), F.lit(asks).alias("asks"), member.alias("member"))

    asking = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda b: place(b, own_chunk, True, F.lit(False)))
    asked = F.transform(F.sequence(F.lit(0), F.col("n_chunks") - 1), lambda c: place(own_block, c, False, F.lit(True)))
    alone = F.array(place(F.lit(0), F.lit(0), True, F.col("home")))
    places = F.when(F.col("n_blocks").isNull(), alone).when(F.col("home"), F.concat(asking, asked)).otherwise(asking)
    return known.select("cell", F.explode(places).alias("p"), "ids", "vector", "code", "error").select("cell", "p.block", "p.chunk", "ids", "vector", "code", "error", "p.asks", "p.member")


def _searcher(shared: Broadcast, dims: int, k: int):
    """In one group of a cell: the ``k`` best of its members for every vector that asks there, as ``id`` and ``found`` (similarity, id)."""

    def run(table: pa.Table) -> pa.Table:
        books = shared.value
        ids = table.column("ids").to_pylist()
        home, asking = np.asarray(table.column("member")), np.flatnonzero(np.asarray(table.column("asks")))
        raw = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float32).reshape(-1, dims)
        exact = _unit(raw.astype(np.float64))
        # members with the same vector are one, with the least ids of all
        at = np.flatnonzero(home)
        members = table.filter(pa.array(home))
        _, first, same = np.unique(_keys(raw[at]), return_index=True, return_inverse=True)
        listed: list[list[int]] = [[] for _ in first]
        for i, c in zip(at.tolist(), same.tolist()):
            listed[c] += ids[i]
        listed = [sorted(x)[: k + 1] for x in listed]
        db = exact[at[first]]
        # those of one direction are chosen by one of them, then each is held against the vector looked up
        heads, of = np.unique(_directions(db), return_inverse=True)
        by_head = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=len(heads)))[:-1])
        one = at[first[heads]]
        lead, lead_errors = exact[one], np.asarray(members.column("error"), np.float32)[first[heads]]
        codes = np.frombuffer(b"".join(members.column("code").to_pylist()), np.uint16).reshape(len(at), len(books.words))[first[heads]]
        alone = np.array([len(x) == 1 for x in by_head], bool)
        approximate, narrow = exact.astype(np.float32), lead.astype(np.float32)
        out_id, out_found = [], []
        n = min(RERANK, len(one))
        last = min(n, k + 1) - 1

        def closest(q: int, chosen: np.ndarray) -> list[tuple[float, int]]:
            """The best of all vectors with the directions ``chosen``, and of those the least ids where they tie."""
            near = lead[chosen] @ exact[q]
            if len(near) > last + 1:
                chosen = chosen[near >= -np.partition(-near, last)[last] - NOISE]
            rows = np.concatenate([by_head[c] for c in chosen])
            who = np.concatenate([np.array(listed[r], np.int64) for r in rows])
            sims = np.repeat(np.round(db[rows] @ exact[q], 12), [len(listed[r]) for r in rows])
            top = np.lexsort((who, -sims))[: k + 1]
            return list(zip((-sims[top]).tolist(), who[top].tolist()))

        def settle(part: np.ndarray, rough: np.ndarray, which: np.ndarray | None) -> None:
            """The best by products in single precision ``rough`` with the directions ``which`` (else all), those that count in double."""
            few = min(rough.shape[1], k + 6)
            counts = rough >= -np.partition(-rough, last, axis=1)[:, last, None] - ROUGH
            top = np.argpartition(-rough, few - 1, axis=1)[:, :few]
            best = top if which is None else np.take_along_axis(which, top, 1)
            wide = (counts.sum(1) > few) | ~alone[best].all(1)
            sims = np.round(np.einsum("qd,qrd->qr", exact[part], lead[best]), 12)
            for i, (q, row, sim, more) in enumerate(zip(part.tolist(), best.tolist(), sims.tolist(), wide.tolist())):
                if more:
                    # whatever single precision can't tell from the last one kept
                    pool = closest(q, np.flatnonzero(counts[i]) if which is None else which[i][counts[i]])
                else:
                    pool = sorted((-s, o) for s, c in zip(sim, row) for o in listed[by_head[c][0]])
                for doc in ids[q]:
                    near = [(-s, o) for s, o in pool if o != doc][:k]
                    out_id.append(doc)
                    out_found.append([{"s": s, "i": o} for s, o in near])

        for start in range(0, len(asking) if n else 0, 512):
            part = asking[start : start + 512]
            if n < len(one):
                # a product is no further from the tables' than what the code leaves over: the rest can't be among the best
                most = quantizer.scores(books, approximate[part], codes).T + lead_errors
                best = np.argpartition(-most, n - 1, axis=1)[:, :n]
                rough = np.einsum("qd,qrd->qr", approximate[part], narrow[best])
                rest = np.take_along_axis(most, best, 1).min(1)
                sure = rest < -np.partition(-rough, last, axis=1)[:, last] - ROUGH
                if sure.any():
                    settle(part[sure], rough[sure], best[sure])
                part = part[~sure]
            if len(part):
                settle(part, approximate[part] @ narrow.T, None)
        return pa.table({"id": pa.array(out_id, pa.int64()), "found": pa.array(out_found, pa.list_(pa.struct([("s", pa.float64()), ("i", pa.int64())])))})

    return run


def _exact(dims: int, k: int):
    """The ``k`` best of a block's members for every other row there, by exact similarity to all of them."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("ids").to_pylist()
        member = np.asarray(table.column("member"))
        x = _unit(np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float32).reshape(-1, dims).astype(np.float64))
        at, db = np.flatnonzero(member), x[member]
        least = np.array([ids[i][0] for i in at], np.int64)
        out_id, out_found = [], []
        for q in np.flatnonzero(~member):
            sims = np.round(db @ x[q], 12)
            # of rows that tie, those with the least ids hold all that can be among the best
            top = np.lexsort((least, -sims))[: k + 1]
            pool = sorted((-sims[r], i) for r in top for i in ids[at[r]] if i != ids[q][0])[:k]
            out_id.append(ids[q][0])
            out_found.append([{"s": -s, "i": i} for s, i in pool])
        kind = pa.list_(pa.struct([("s", pa.float64()), ("i", pa.int64())]))
        return pa.table({"id": pa.array(out_id, pa.int64()), "found": pa.array(out_found, kind)})

    return run


def _searched_everywhere(short: DataFrame, distinct: DataFrame, n: int, n_short: int, dims: int, k: int) -> DataFrame:
    """``id``, ``all``: the best of all vectors for the few of ``short`` (``id``), in blocks of both."""
    blocks, chunks = -(-n // CELL), -(-n_short // CELL)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    block = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    single = distinct.select(F.explode("ids").alias("id"), "vector").join(short, "id")
    asked = single.select(F.array("id").alias("ids"), "vector", block(F.col("id"), chunks).alias("chunk"), every(blocks).alias("block"))
    members = distinct.select("ids", "vector", block(F.col("ids")[0], blocks).alias("block"), every(chunks).alias("chunk"))
    both = asked.withColumn("member", F.lit(False)).unionByName(members.withColumn("member", F.lit(True)))
    found = both.groupBy("block", "chunk").applyInArrow(_exact(dims, k), "id bigint, found array<struct<s:double,i:bigint>>")
    return found.groupBy("id").agg(F.flatten(F.collect_list("found")).alias("all"))


def nearest(docs: DataFrame, k: int = 5, dims: int = 96, key: str = "doc_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """``key``, ``neighbours`` (array of (similarity, key), best first): the ``k`` most similar other vectors of every usable one.

    Usable: not null, exactly ``dims`` finite numbers, not all zero; others take no part. Similarity is the cosine, ties
    go to the smaller key. The search is approximate; what it returns is reranked by exact cosines. Where the cells
    looked up hold fewer than ``k`` others, the vector is held against all others exactly, in blocks; so a list is only
    shorter than ``k`` where there are fewer others.

    Codebooks of words in full dimension, each level fitted on what the levels before leave over, are
    fitted on a bounded sample. Every vector is encoded by beam search. A vector's cell is its nearest word; a cell
    of over ``DIVIDE * CELL`` vectors is divided by the next word; one of over ``CELL`` is searched in blocks, those
    looked up there in chunks, so that the groups stay small. A vector is looked up in its own cell and in all whose border is near, however many
    vectors they hold. Of a cell's members none is lost: tables of a vector's products with the words give the
    scores of all codes there, which are off by what the code leaves over at most; whatever can be among the best by that is held against it exactly.
    Exact copies are one vector with several keys in every step, so that many copies cost no more than one; so are
    vectors of one direction (multiples of each other, which differ by the rounding of single precision at most) where a
    task holds more than ``k`` + 1 of them. Fewer keep their own vectors. Whatever ties with the last one kept is kept too.
    """
    vectors = docs.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    out = f"{key} {kind}, neighbours array<struct<similarity:double,{key}:{kind}>>"
    drawn = _sample(vectors, dims, sample, vectors.count())
    if not len(drawn):
        drawn = np.eye(1, dims, dtype=np.float32)
    books = quantizer.train(drawn, [max(1, min(FIRST, len(drawn) // PER_WORD)), *RESIDUAL])
    shared = spark.sparkContext.broadcast(books)
    encoded = cut(vectors.where(F.size("vector") == dims).mapInArrow(_encoder(shared, dims, k), "ids array<bigint>, vector binary, code binary, error float, path binary, near binary, copy_of bigint"))
    distinct = encoded.where("vector IS NOT NULL")

    # which prefixes hold too many vectors: at most n / limit of them for each number of words come to the driver
    n = distinct.count()
    limit = max(DIVIDE * CELL, n * DEPTH // MAX_DIVIDED)
    prefixes = distinct.select(F.explode(F.array(*[F.expr(f"substring(path, 1, {2 * w})") for w in range(1, DEPTH)])).alias("cell"))
    large = prefixes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    divided = frozenset(bytes(r.cell) for r in large.select("cell").collect())
    cells = _placed_cells(distinct, shared, spark.sparkContext.broadcast(divided), n)
    tasks = max(spark.sparkContext.defaultParallelism, -(-(LEAST + 1) * n // TASK_ROWS))
    found = cells.repartition(tasks, "cell", "block", "chunk").groupBy("cell", "block", "chunk").applyInArrow(_searcher(shared, dims, k), "id bigint, found array<struct<s:double,i:bigint>>")

    # an id was looked up in a few cells (or blocks): their lists are short and few
    merged = found.groupBy("id").agg(F.flatten(F.collect_list("found")).alias("all"))
    by_rank = F.array_sort(F.transform(F.array_distinct("all"), lambda x: F.struct((-x["s"]).alias("s"), x["i"].alias("i"))))
    best = cut(merged.select("id", F.slice(by_rank, 1, k).alias("best")))
    listed = best.select("id", "best").where(F.size("best") > 0)
    short = best.where(F.size("best") < k).select("id")
    n_short = short.count()
    if n_short:
        everywhere = _searched_everywhere(short, distinct, n, n_short, dims, k).select("id", F.slice(by_rank, 1, k).alias("best"))
        listed = listed.where(F.size("best") == k).unionByName(everywhere.where(F.size("best") > 0))
    # copies beyond those listed: their nearest are the least of their kind, which are the listed one's and itself
    unlisted = encoded.where("copy_of IS NOT NULL").select(F.col("ids")[0].alias("id"), "copy_of")
    kind_of = F.array_sort(F.array_append("best", F.struct(F.lit(-1.0).alias("s"), F.col("copy_of").alias("i"))))
    others = unlisted.join(listed.withColumnRenamed("id", "copy_of"), "copy_of").select("id", F.slice(kind_of, 1, k).alias("best"))
    whole = listed.unionByName(others)
    neighbours = F.transform("best", lambda x: F.struct((-x["s"]).alias("similarity"), x["i"].alias(key)))
    return whole.select(F.col("id").cast(kind).alias(key), neighbours.cast(out.split(", neighbours ", 1)[1]).alias("neighbours"))


def nearest_pairs(docs: DataFrame, k: int = 5, dims: int = 96, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """``doc_id_a`` < ``doc_id_b``, distinct: one of the two is among the ``k`` nearest of the other."""
    edges = nearest(docs, k, dims, key, vector).select(F.col(key).alias("a"), F.explode(f"neighbours.{key}").alias("b"))
    return edges.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b")).distinct()
