"""Encoding of a whole corpus with a public tokenizer, long texts in overlapping chunks."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Where the vocabulary lies on every machine, and its pre-tokenisation.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters a chunk advances, and those it reaches into the next one.
STRIDE, OVERLAP = 16_384, 512


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a vocabulary file of ranks; special tokens are ordinary text to it."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def boundaries(text: str) -> list[int]:
    """Where pre-tokens of the text begin, and its end."""
    return [m.start() for m in _pattern().finditer(text)] + [len(text)]


def _encoder(path: str, text_at: int, counts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            keep = [batch.column(i) for i in range(batch.num_columns) if i != text_at]
            names = [n for i, n in enumerate(batch.schema.names) if i != text_at]
            if counts:
                out = pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts], pa.int32())
            else:
                out = pa.array([enc.encode_ordinary(t) if t else [] for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*keep, out], names=[*names, "ids"])

    return run


def _heads(chunks: DataFrame, stride: int, overlap: int) -> DataFrame:
    """The pre-token boundaries of each chunk in its first ``overlap`` characters and in its last ones, as places in the text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            heads, tails = [], []
            for start, last, text in zip(df["start"], df["is_last"], df["chunk"]):
                marks = boundaries(text)
                # what ends a chunk that isn't the last may go on in the text: its final pre-token isn't sure
                sure = marks if last else marks[:-2]
                # white space before a boundary is read differently where nothing follows it: such places aren't cut
                sure = [m for m in sure if not m or not text[m - 1].isspace()]
                heads.append([int(start) + m for m in sure if m < overlap] if start else [0])
                tails.append([int(start) + m for m in sure if m >= stride])
            yield pd.DataFrame({"_doc": df["_doc"], "start": df["start"], "heads": heads, "tails": tails})

    return chunks.select("_doc", "start", "is_last", "chunk").mapInPandas(run, "_doc long, start long, heads array<long>, tails array<long>")


def encode(
    docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, stride: int = STRIDE, overlap: int = OVERLAP, counts: bool = False
) -> DataFrame:
    """``key``, ``ids`` for every row of ``docs``: the token ids of its text, or only their number if ``counts``.

    Texts up to ``stride`` characters are encoded as they are. Longer ones are cut into chunks that overlap and are pre-tokenised
    in parallel. A pre-token depends only on the text from its start, so from the first place where both
    chunks of an overlap see a boundary they agree for good: there the text is cut into pieces. Chunks
    between which no boundary is shared (a run of one character class longer than the overlap) stay one piece. The
    pieces are encoded apart and their ids joined in order, which gives the ids of the whole text.

    Empty and null texts give an empty list (0 if ``counts``); rows with the same key stay apart; white space isn't trimmed.
    """
    if not 0 < overlap <= stride:
        raise ValueError("the overlap must be positive and no longer than the stride")
    kind = docs.schema[key].dataType.simpleString()
    out = f"{key} {kind}, ids {'int' if counts else 'array<int>'}"
    plain = docs.select(F.col(key).alias(key), F.col(text).alias("_text"))
    size = F.length("_text")
    is_long = F.coalesce(size > stride, F.lit(False))
    short = plain.where(~is_long).mapInArrow(_encoder(vocabulary, 1, counts), out)

    numbered = plain.where(is_long).select(key, "_text", F.xxhash64(key, "_text").alias("_doc"))
    # two rows with the same key and text are one text here, counted, and come back as many
    once = numbered.groupBy("_doc", key).agg(F.first("_text").alias("_text"), F.count(F.lit(1)).alias("_copies"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest((size - 1).cast("long"), F.lit(0).cast("long")), F.lit(stride).cast("long"))
    chunks = once.select("_doc", key, "_copies", "_text", F.explode(starts).alias("start")).select(
        "_doc", key, "_copies", "start", (F.col("start") + stride >= size).alias("is_last"), F.expr(f"substring(_text, cast(start AS int) + 1, {stride + overlap})").alias("chunk")
    )
    in_text = Window.partitionBy("_doc").orderBy("start")
    marks = _heads(chunks, stride, overlap)
    shared = F.array_min(F.array_intersect("heads", F.lag("tails").over(in_text)))
    synced = marks.select("_doc", "start", F.when(F.col("start") == 0, F.lit(0).cast("long")).otherwise(shared).alias("cut")).where("cut IS NOT NULL")
    # a piece begins at each shared boundary and ends at the next one
    pieces = synced.withColumn("until", F.lead("cut").over(Window.partitionBy("_doc").orderBy("cut"))).withColumn("next_start", F.lead("start").over(in_text))
    spans = pieces.select(F.col("_doc").alias("_pdoc"), F.col("start").alias("piece"), "cut", "until", "next_start")
    owned = chunks.join(spans, (chunks["_doc"] == spans["_pdoc"]) & (chunks["start"] >= spans["piece"]) & (F.col("next_start").isNull() | (chunks["start"] < F.col("next_start"))))
    # the part of each chunk that belongs to its piece: from the cut (or its own start) to the piece's end or the next chunk's start
    begin = F.greatest("cut", "start")
    end = F.when(F.col("next_start").isNull() & F.col("is_last"), F.lit(None).cast("long")).when(F.col("start") + stride == F.col("next_start"), F.col("until")).otherwise(F.col("start") + stride)
    part = F.when(end.isNull(), F.substring("chunk", (begin - F.col("start") + 1).cast("int"), F.lit(2**31 - 1))).otherwise(
        F.substring("chunk", (begin - F.col("start") + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))
    )
    parts = owned.select("_doc", key, "_copies", "piece", "start", part.alias("part"))
    joined = parts.groupBy("_doc", key, "_copies", "piece").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), "").alias("_text")
    )
    encoded = joined.select("_doc", key, "_copies", "piece", "_text").mapInArrow(_encoder(vocabulary, 4, counts), f"_doc long, {key} {kind}, _copies long, piece long, ids {'int' if counts else 'array<int>'}")
    by_text = encoded.groupBy("_doc", key, "_copies")
    if counts:
        whole = by_text.agg(F.sum("ids").cast("int").alias("ids"))
    else:
        whole = by_text.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.unionByName(whole.select(key, "ids", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_n")).drop("_n"))


def decode(encoded: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key``, ``text``: the raw bytes of the ids put together and read as UTF-8."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in batches:
            texts = [None if ids is None else b"".join(map(enc.decode_single_token_bytes, ids)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} {kind}, text string")
