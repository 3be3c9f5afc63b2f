"""Subject areas of documents: bisecting k-means, leaves labelled by discriminative terms, mixtures of leaves."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashmark.session import Kept, cut

#: A word counts as a term if this share of the documents, and at least so many, have it; of more than MAX_TERMS the commonest count.
TERM_SHARE, TERM_LEAST, MAX_TERMS = 0.0005, 4, 65_000
#: Dimensions of the document vectors, leaves of the clustering, passes over the sentences.
DIMENSIONS, LEAVES, PASSES = 48, 128, 3
#: A document's leaves are the nearest so many, weighted by exp(SHARPNESS * cosine).
NEAR, SHARPNESS = 4, 12.0
#: What the mixture of a document's leaves counts beside the terms of a sentence.
MIXTURE_WEIGHT = 1.0
#: Terms that label a leaf.
LEAF_TERMS = 80
#: What a leaf's terms count beside the annotators' votes in it.
LEAF_WEIGHT = 4.0
#: A term speaks for a subject if this share of where it occurs is on it: at first (by leaves), then (by sentences).
SHARE_FIRST, SHARE_THEN = 0.45, 0.6
#: What is added to the counts of a term, spread evenly, so that rare ones need more.
PRIOR_COUNT = 2.0
#: What is added to each subject's counts, as a share of the mean subject's, in proportion to the terms' share of all:
#: so that a subject found seldom doesn't own what is rare.
BALANCE = 0.02
#: A subject is one of a document's if at least 1 / so many of the sentences with any subject are on it.
FIFTH = 5
#: In an encoded text, what ends a sentence; terms are numbered below it.
STOP = 65_535

_WORD = re.compile(r"[^\W\d_]{2,}")
# a sentence ends at . ! ? before white space or a capital, but not after an initial; so does a paragraph
_END = re.compile(r"(?<=[^\W\d_][^\W\d_][.!?])(?=[\s\"”»)]*\s|[^\W\d_])|(?<=[\d\"”»)%;:][.!?])(?=\s)|(?<=[.!?][\"”»)])(?=\s)|\n\s*\n")


def sentences(text: str) -> list[list[str]]:
    """The words, in lower case, of each sentence that has any."""
    words = (_WORD.findall(s) for s in _END.split(text.replace("\xa0", " ").lower()) if s)
    return [w for w in words if w]


@dataclass(frozen=True)
class Vocabulary:
    terms: list[str]
    df: np.ndarray
    n_docs: int

    @property
    def idf(self) -> np.ndarray:
        return np.log((1 + self.n_docs) / (1 + self.df))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df: Counter[str] = Counter()
    n = 0

    def counted(terms: list[str], numbers: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(numbers, pa.int64())], names=["term", "df"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            found = set(_WORD.findall(text.lower()))
            n += bool(found)
            df.update(found)
        if len(df) > 500_000:
            yield counted(list(df), list(df.values()))
            df.clear()
    yield counted(["", *df], [n, *df.values()])


def vocabulary(docs: DataFrame) -> Vocabulary:
    """The terms of all texts that are common enough, with the documents that have them."""
    counts = cut(docs.where("text IS NOT NULL").select("text").mapInArrow(_count_terms, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")))
    n = counts.where("term = ''").agg(F.sum("df")).first()[0] or 0
    common = counts.where((F.col("term") != "") & (F.col("df") >= max(TERM_LEAST, n * TERM_SHARE)) & (F.col("df") <= 0.5 * max(n, 1)))
    kept = common.orderBy(F.desc("df"), "term").limit(MAX_TERMS).orderBy("term").toArrow()
    return Vocabulary(kept.column("term").to_pylist(), np.asarray(kept.column("df"), np.float64), n)


_ENCODED = "doc_id long, votes array<double>, words binary"


def _encoder(vocab: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(vocab.value.terms)}
        for batch in batches:
            words = []
            for text in batch.column(2).to_pylist():
                numbered = ([number[t] for t in s if t in number] for s in sentences(text))
                words.append(np.array([t for s in numbered if s for t in (*s, STOP)], np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.binary())], names=["doc_id", "votes", "words"])

    return run


@dataclass(frozen=True)
class _Batch:
    """Encoded documents in flat arrays."""

    terms: np.ndarray
    sentence_of: np.ndarray
    starts: np.ndarray
    doc_of: np.ndarray


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, for tables of one row per term of a document."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _flat(batch: pa.RecordBatch, at: int) -> _Batch:
    texts = [np.frombuffer(w, np.uint16) for w in batch.column(at).to_pylist()]
    words = np.concatenate([np.zeros(0, np.uint16), *texts])
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    ends = words == STOP
    sentence = np.cumsum(np.r_[0, ends[:-1]]) if len(words) else np.zeros(0, np.int64)
    terms, of = words[~ends].astype(np.int64), sentence[~ends]
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
    return _Batch(terms, of, starts, doc[ends])


def _sums(tables: DataFrame, size: int, columns: int, add) -> np.ndarray:
    """A (size, columns) table of sums over all documents; ``size`` is bounded by the vocabulary's and the leaves' numbers.

    Each task adds up its own and gives out the rows it has anything for; Spark adds up equal rows, partly before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, columns))
        for batch in _slices(batches):
            add(total, batch)
        rows = np.flatnonzero((total != 0).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *[pa.array(total[rows, c]) for c in range(columns)]], names=["row", *[f"c{c}" for c in range(columns)]])

    names = [f"c{c}" for c in range(columns)]
    added = tables.mapInArrow(run, "row int, " + ", ".join(f"{c} double" for c in names)).groupBy("row").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = np.zeros((size, columns))
    if added.num_rows:
        out[np.asarray(added.column("row"))] = np.stack([np.asarray(added.column(c)) for c in names], axis=1)
    return out


def _spread(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    for c in range(values.shape[1]):
        total[:, c] += np.bincount(rows, weights=values[:, c], minlength=len(total))


def _weights(b: _Batch, n_docs: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents as normalised sparse vectors: document, term and weight of every entry."""
    doc = b.doc_of[b.sentence_of]
    entry, n = np.unique(doc * len(idf) + b.terms, return_counts=True)
    doc, term = entry // len(idf), entry % len(idf)
    w = np.log1p(n) * idf[term]
    norm = np.sqrt(np.bincount(doc, weights=w * w, minlength=n_docs))
    return doc, term, w / np.maximum(norm[doc], 1e-12)


def _project(b: _Batch, n_docs: int, idf: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, tuple]:
    doc, term, w = entries = _weights(b, n_docs, idf)
    out = np.zeros((n_docs, basis.shape[1]), np.float32)
    if len(doc):
        first = np.r_[True, doc[1:] != doc[:-1]]
        out[doc[first]] = np.add.reduceat(basis[term] * w[:, None].astype(np.float32), np.flatnonzero(first), axis=0)
    return out, entries


def _vectors(b: _Batch, n_docs: int, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    v, _ = _project(b, n_docs, idf, basis)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _speaks(counts: np.ndarray, least: float) -> np.ndarray:
    """How strongly each term speaks for each subject; 0 where it doesn't. ``counts``: by subject, and last without any."""
    n = counts.shape[1]
    each = counts.sum(1, keepdims=True)
    # half way to subjects of equal size: else the commonest one would own what is common to all
    added = BALANCE * each.sum() / n + 1
    rate = (counts + added * each / max(each.sum(), 1)) / np.sqrt(counts.sum(0, keepdims=True) + added)
    share = rate / np.maximum(rate.sum(1, keepdims=True), 1e-12)
    share = (share[:, :-1] * each + PRIOR_COUNT / n) / (each + PRIOR_COUNT)
    return np.where(share >= least, np.log(share / (1 - share).clip(0.01) * (n - 1)), 0.0)


def _on(b: _Batch, speaks: np.ndarray, mixture: np.ndarray) -> np.ndarray:
    """For each sentence its share of each subject: the strengths of its terms on top of the mixture of its document's leaves; last 1 if no term speaks."""
    n = speaks.shape[1]
    out = np.zeros((len(b.starts), n + 1))
    if not len(b.starts):
        return out
    score = np.add.reduceat(speaks[b.terms], b.starts, axis=0)
    said = score.max(1) > 0
    score = score + MIXTURE_WEIGHT * np.log(mixture[b.doc_of])
    p = np.exp(score - score.max(1, keepdims=True))
    out[:, :n] = np.where(said[:, None], p / p.sum(1, keepdims=True), 0)
    out[:, n] = ~said
    return out


@dataclass(frozen=True)
class _Leaves:
    """Of each document of a batch its nearest leaves and their shares of it."""

    near: np.ndarray
    share: np.ndarray

    def mixture(self, mixtures: np.ndarray) -> np.ndarray:
        return np.einsum("dl,dls->ds", self.share, mixtures[self.near])

    def spread(self, total: np.ndarray, values: np.ndarray, doc_of: np.ndarray) -> None:
        """Add each row of ``values``, which belongs to a document, to that one's leaves by their shares."""
        for j in range(self.near.shape[1]):
            _spread(total, self.near[doc_of, j], values * self.share[doc_of, j][:, None])


def _leaves(batch: pa.RecordBatch, near_at: int, share_at: int) -> _Leaves:
    near = np.frombuffer(b"".join(batch.column(near_at).to_pylist()), np.uint8).reshape(batch.num_rows, NEAR)
    share = np.frombuffer(b"".join(batch.column(share_at).to_pylist()), np.float32).reshape(batch.num_rows, NEAR)
    return _Leaves(near.astype(np.int64), share.astype(np.float64))


def _placer(idf: Broadcast, basis: Broadcast, centres: Broadcast):
    """Adds to encoded documents their nearest leaves and what share each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            v = _vectors(_flat(batch, 2), batch.num_rows, idf.value, basis.value)
            cosine = v @ centres.value.T
            near = np.argsort(-cosine, axis=1, kind="stable")[:, :NEAR]
            near = np.pad(near, ((0, 0), (0, NEAR - near.shape[1])), mode="edge")
            top = np.take_along_axis(cosine, near, 1)
            share = np.exp(SHARPNESS * (top - top[:, :1]))
            share[:, centres.value.shape[0] :] = 0
            share = (share / share.sum(1, keepdims=True)).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r.tobytes() for r in near.astype(np.uint8)], pa.binary()), pa.array([r.tobytes() for r in share], pa.binary())], names=[*batch.schema.names, "near", "share"]
            )

    return run


@dataclass(frozen=True)
class Model:
    """``mixtures``: subjects' shares of each leaf; ``speaks``: each term's strength for each subject; ``labels``: the terms that label a leaf."""

    subjects: list[str]
    mixtures: np.ndarray
    speaks: np.ndarray
    labels: list[list[str]]


def _leaf_centres(encoded: DataFrame, idf: Broadcast, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The directions in which the documents vary most, and the centres of the leaves of bisecting k-means over their vectors."""
    spark = encoded.sparkSession
    start = spark.sparkContext.broadcast(np.random.default_rng(11).standard_normal((size, DIMENSIONS)).astype(np.float32))

    def vary(total: np.ndarray, batch: pa.RecordBatch) -> None:
        v, (doc, term, w) = _project(_flat(batch, 2), batch.num_rows, idf.value, start.value)
        order = np.argsort(term, kind="stable")
        first = np.flatnonzero(np.r_[True, term[order][1:] != term[order][:-1]]) if len(term) else term
        if len(first):
            total[term[order][first]] += np.add.reduceat(v[doc[order]] * w[order][:, None].astype(np.float32), first, axis=0)

    basis = np.linalg.qr(_sums(encoded, size, DIMENSIONS, vary))[0].astype(np.float32)
    basis = np.pad(basis, ((0, 0), (0, DIMENSIONS - basis.shape[1])))  # a vocabulary may have fewer directions
    known = spark.sparkContext.broadcast(basis)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            v = _vectors(_flat(batch, 2), batch.num_rows, idf.value, known.value)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(v.ravel(), pa.float32()), DIMENSIONS).cast(pa.list_(pa.float32()))], names=["vector"])

    held = cut(encoded.mapInArrow(vectors, "vector array<float>"))
    if held.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        held = held.repartition(spark.sparkContext.defaultParallelism)
    held = held.select(array_to_vector("vector").alias("v"))
    if not held.limit(1).count():
        return basis, np.zeros((1, DIMENSIONS), np.float32)
    leaves = BisectingKMeans(featuresCol="v", k=LEAVES, maxIter=5, seed=5, minDivisibleClusterSize=8.0).fit(held)
    centres = np.array(leaves.clusterCenters(), np.float32)
    return basis, centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def fit(docs: DataFrame, areas: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model]:
    """The encoded documents with their leaves, and the model.

    1. Document vectors: term weights log(1 + n) * idf, normalised, projected to the ``DIMENSIONS`` directions in
       which the documents vary most (one round of power iteration from random ones), normalised.
    2. Bisecting k-means over all vectors gives the leaves. Every document is then placed: it belongs to its
       ``NEAR`` nearest leaves, the nearer the more.
    3. A leaf's discriminative terms are those it has most beyond their share in all leaves. What annotators said of
       documents, and the areas' own descriptions, tell which subjects a term goes with; a leaf's terms
       together give its mixture of subjects.
    4. A term speaks for a subject if most of where it occurs is on it: at first judged by the mixtures of the leaves it
       is in, then by the sentences it is in. A sentence's subjects are the mixture of its document's leaves times
       what its terms say. A sentence in which no term speaks has no subject. A few such passes, in each of which the
       mixtures too are taken anew.

    Counts cover all documents; only tables by term, subject and leaf, all bounded, come to the driver.
    """
    sc = docs.sparkSession.sparkContext
    subjects = sorted(r.subject for r in areas.select("subject").where("subject IS NOT NULL").distinct().collect())
    n = max(1, len(subjects))
    vocab = vocabulary(docs)
    size = max(1, len(vocab.terms))
    shared = sc.broadcast(vocab)
    idf = sc.broadcast(vocab.idf if len(vocab.terms) else np.zeros(1))
    votes = labels.groupBy("doc_id").agg(F.array(*[F.count_if(F.col("subject") == s).cast("double") for s in subjects]).alias("votes"))
    texts = docs.where("text IS NOT NULL").select("doc_id", "text")

    kept = Kept(docs.sparkSession)
    encoded = kept.keep(texts.join(votes, "doc_id", "left").select("doc_id", "votes", "text").mapInArrow(_encoder(shared), _ENCODED).where("length(words) > 0"), "encoded")
    basis, centres = map(sc.broadcast, _leaf_centres(encoded, idf, size))
    placed = kept.keep(encoded.mapInArrow(_placer(idf, basis, centres), _ENCODED + ", near binary, share binary"), "placed")
    kept.drop("encoded")

    said = np.zeros((size, n))
    number = {t: i for i, t in enumerate(vocab.terms)}
    for r in areas.where("subject IS NOT NULL").collect():
        for s in sentences(f"{r.subject}. {r.description or ''}"):
            for t in s:
                if t in number:
                    said[number[t], subjects.index(r.subject)] += 1

    def of_votes(total: np.ndarray, batch: pa.RecordBatch) -> None:
        b, leaves = _flat(batch, 0), _leaves(batch, 1, 2)
        v = np.array([x or [0.0] * n for x in batch.column(3).to_pylist()])
        v /= np.maximum(v.sum(1, keepdims=True), 1)
        _spread(total[:size], b.terms, v[b.doc_of][b.sentence_of])
        leaves.spread(total[size:], v, np.arange(len(v)))

    judged = _sums(placed.where("votes IS NOT NULL").select("words", "near", "share", "votes"), size + LEAVES, n, of_votes)
    said += judged[:size]
    mixtures, by_leaves, names = _leaf_mixtures(_leaf_terms(placed), vocab, said, judged[size:])

    # the terms speak for subjects: at first by the leaves they are in, then by the sentences they are in
    by_leaves *= said.sum() / max(by_leaves.sum(), 1e-9)
    nowhere = np.zeros((size, 1))
    speaks = _speaks(np.concatenate([by_leaves + said, nowhere], axis=1), SHARE_FIRST)
    for _ in range(PASSES):
        known = sc.broadcast((speaks, mixtures))

        def by_sentence(total: np.ndarray, batch: pa.RecordBatch, known: Broadcast = known) -> None:
            b, leaves = _flat(batch, 0), _leaves(batch, 1, 2)
            speaks, mixtures = known.value
            p = _on(b, speaks, leaves.mixture(mixtures))
            _spread(total[:size], b.terms, p[b.sentence_of])
            leaves.spread(total[size:], p, b.doc_of)

        counts = _sums(placed.select("words", "near", "share"), size + LEAVES, n + 1, by_sentence)
        speaks = _speaks(counts[:size] + np.concatenate([said, nowhere], axis=1), SHARE_THEN)
        of_leaf = counts[size:, :-1]
        mixtures = 0.9 * (of_leaf + 1e-9) / (of_leaf + 1e-9).sum(1, keepdims=True) + 0.1 / n
    return placed, Model(subjects, mixtures, speaks, names)


def _leaf_terms(placed: DataFrame) -> DataFrame:
    """``leaf``, ``term``, ``n``: how often each term occurs in the documents nearest to each leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 10_000):
            b, leaves = _flat(batch, 0), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, NEAR)[:, 0].astype(np.int64)
            both, n = np.unique(leaves[b.doc_of][b.sentence_of] * (STOP + 1) + b.terms, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both // (STOP + 1), pa.int32()), pa.array(both % (STOP + 1), pa.int32()), pa.array(n, pa.int64())], names=["leaf", "term", "n"])

    return cut(placed.select("words", "near").mapInArrow(run, "leaf int, term int, n long").groupBy("leaf", "term").agg(F.sum("n").alias("n")))


def _leaf_mixtures(counts: DataFrame, vocab: Vocabulary, said: np.ndarray, said_of_leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """The mixture of each leaf by its discriminative terms and its votes, each term's subjects by the leaves it is in, and the terms that label a leaf."""
    size, n = said.shape
    total = counts.agg(F.sum("n").cast("double")).first()[0] or 1.0
    by_term, by_leaf = counts.groupBy("term").agg(F.sum("n").alias("t")), counts.groupBy("leaf").agg(F.sum("n").alias("l"))
    expected = F.col("t") * F.col("l") / total
    beyond = counts.join(by_term, "term").join(F.broadcast(by_leaf), "leaf").where(F.col("n") > expected).withColumn("excess", F.col("n") * F.log(F.col("n") / expected))
    best = beyond.withColumn("r", F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("excess"), "term"))).where(F.col("r") <= LEAF_TERMS)

    overall = said.sum(1, keepdims=True) / max(said.sum(), 1)
    goes_with = (said + PRIOR_COUNT * overall * size) / (said.sum(0, keepdims=True) + PRIOR_COUNT * size) * (said.sum(1, keepdims=True) > 0)
    goes_with /= np.maximum(goes_with.sum(1, keepdims=True), 1e-9)
    sure = goes_with.max(1) > 1.5 / n
    mixtures = np.full((LEAVES, n), 1 / n)
    names: list[list[str]] = [[] for _ in range(LEAVES)]
    share = np.full((LEAVES, n), 1e-9)
    for r in best.orderBy("leaf", "r").collect():
        names[r.leaf].append(vocab.terms[r.term])
        share[r.leaf] += r.excess * sure[r.term] * goes_with[r.term] ** 2
    share = LEAF_WEIGHT * share**2 / (share**2).sum(1, keepdims=True) + said_of_leaf
    mixtures = 0.9 * share / share.sum(1, keepdims=True) + 0.1 / n

    spark = counts.sparkSession
    parts = spark.createDataFrame([(leaf, *m) for leaf, m in enumerate(mixtures.tolist())], "leaf int, " + ", ".join(f"s{i} double" for i in range(n)))
    by_leaves = np.zeros((size, n))
    held = counts.join(F.broadcast(parts), "leaf").groupBy("term").agg(*[F.sum(F.col("n") * F.col(f"s{i}")).alias(f"s{i}") for i in range(n)]).toArrow()
    if held.num_rows:
        by_leaves[np.asarray(held.column("term"))] = np.stack([np.asarray(held.column(f"s{i}")) for i in range(n)], axis=1)
    return mixtures, by_leaves, [x[:12] for x in names]


def leaf_report(docs: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """``leaf``, ``terms`` that label it, ``subject``, ``share``: the leaves' labels and mixtures of subjects."""
    _, model = fit(docs, areas, labels)
    rows = [(leaf, terms, s, float(m)) for leaf, terms in enumerate(model.labels) if terms for s, m in zip(model.subjects, model.mixtures[leaf])]
    return docs.sparkSession.createDataFrame(rows, "leaf int, terms array<string>, subject string, share double")


def sentence_counts(docs: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``subject``, ``n_sentences``, ``n_any``: a document's sentences on each subject, and those on any."""
    placed, model = fit(docs, areas, labels)
    subjects = model.subjects
    known = docs.sparkSession.sparkContext.broadcast((model.speaks, model.mixtures))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            b = _flat(batch, 1)
            speaks, mixtures = known.value
            p = _on(b, speaks, _leaves(batch, 2, 3).mixture(mixtures))
            best = p.argmax(1) if len(p) else np.zeros(0, int)
            table = np.zeros((batch.num_rows, len(subjects) + 1), np.int64)
            np.add.at(table, (b.doc_of, best), 1)
            table = table[:, :-1]
            doc, subject = np.nonzero(table)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array([subjects[s] for s in subject], pa.string()), pa.array(table[doc, subject]), pa.array(table.sum(1)[doc])],
                names=["doc_id", "subject", "n_sentences", "n_any"],
            )

    return placed.select("doc_id", "words", "near", "share").mapInArrow(run, "doc_id long, subject string, n_sentences long, n_any long")


def is_subject() -> Column:
    """Of rows of ``sentence_counts``: at least a fifth of the sentences with any subject, so that one passing sentence among six isn't enough."""
    return FIFTH * F.col("n_sentences") >= F.col("n_any")


def document_subjects(docs: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``subject``: each subject that at least a fifth of the document's sentences with any subject are on.
    Null, empty and blank texts, and those without any subject, have no row; a document may have several.
    Language, and what ``lang`` says of it, doesn't matter. Without labels the areas' descriptions alone tell
    subjects apart; without areas there is no row.
    """
    counted = sentence_counts(docs, areas, labels)
    return counted.where(is_subject()).select("doc_id", "subject").distinct()
