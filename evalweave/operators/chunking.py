"""Chunkers: fixed, sliding, packed sentences (in the JVM), and similarity-driven (Arrow, with an embedder).

Input: rows with an id column and a text column; every other column is kept by
``keep``.  Null and blank texts give no chunks.  Chunk ids are ``<doc>::c<N>``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions import text as T
from evalweave.operators.providers import Embedder


def _explode(docs: DataFrame, texts: Column, doc_col: str, keep: list[str]) -> DataFrame:
    out = docs.select(*keep, F.col(doc_col).alias("doc_id"), F.posexplode(texts).alias("chunk_ix", "text"))
    return out.select(*keep, F.concat("doc_id", F.lit("::c"), F.col("chunk_ix").cast("string")).alias("chunk_id"), "doc_id", "chunk_ix", "text")


def _sliced(sentences: str, bounds: str) -> Column:
    """Texts of the sentences between each two neighbouring bounds."""
    return F.transform(F.slice(bounds, F.lit(1), F.size(bounds) - 1), lambda a, i: F.array_join(F.slice(sentences, a + 1, F.element_at(bounds, i + 2) - a), " "))


def chunk_sliding(docs: DataFrame, size: int = 256, overlap: int = 64, doc_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Windows of ``size`` tokens, each ``size - overlap`` after the last, until one reaches the end."""
    step = max(1, size - overlap)
    # the token array is a column of its own: inlined into the windows it would be split anew for each
    t = docs.select(*(keep or []), F.col(doc_col), T.tokens(F.col(text_col)).alias("_t")).where(F.size("_t") > 0)
    n = F.size("_t")
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / step).cast("int"))
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(F.col("_t"), i * step + 1, size), " "))
    return _explode(t, windows, doc_col, keep or [])


def chunk_fixed(docs: DataFrame, size: int = 256, overlap: int = 0, **kw) -> DataFrame:
    """Windows without overlap, unless one is asked for."""
    return chunk_sliding(docs, size, overlap, **kw)


def chunk_packed(docs: DataFrame, max_tokens: int = 384, doc_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Whole sentences packed up to ``max_tokens``; a longer sentence is a chunk by itself."""
    s = docs.select(*(keep or []), F.col(doc_col), T.sentences(F.col(text_col)).alias("_s")).where(F.size("_s") > 0)
    sizes = s.withColumn("_n", F.transform("_s", lambda x: F.size(T.tokens(x))))
    zero = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def step(acc, n):
        new = (acc["n"] > 0) & (acc["n"] + n > max_tokens)
        starts = F.when(new, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"])
        return F.struct(starts.alias("starts"), (F.when(new, F.lit(0)).otherwise(acc["n"]) + n).alias("n"), (acc["i"] + 1).alias("i"))

    # a fold over the sentence lengths finds where chunks start; texts are then sliced and joined once, without a shuffle
    cut = sizes.withColumn("_b", F.aggregate("_n", zero, step, lambda a: F.concat(a["starts"], F.array(a["i"]))))
    return _explode(cut, _sliced("_s", "_b"), doc_col, keep or [])


def similarity_starts(vecs: np.ndarray, sizes: np.ndarray, max_tokens: int, threshold: float) -> list[int]:
    """Places of the sentences that begin a chunk.

    A chunk ends before the first sentence that would exceed ``max_tokens`` or
    whose cosine to the sum of the chunk's unit vectors is under ``threshold``.
    """
    upto = np.cumsum(sizes)
    starts = [0]
    while True:
        first = starts[-1]
        room = upto[first] - sizes[first] + max_tokens
        stop = max(first + 1, int(np.searchsorted(upto, room, side="right")))
        sums, rest = np.cumsum(vecs[first : stop - 1], axis=0), vecs[first + 1 : stop]
        apart = np.flatnonzero((sums * rest).sum(1) < threshold * (np.linalg.norm(sums, axis=1) + 1e-9))
        stop = first + 1 + int(apart[0]) if len(apart) else stop
        if stop >= len(vecs):
            return starts
        starts.append(stop)


def chunk_semantic(docs: DataFrame, embedder: Embedder, max_tokens: int = 384, threshold: float = 0.55, doc_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Sentences joined while they resemble the chunk and fit.  Python finds only where chunks start; the JVM slices and joins the texts."""
    sents = docs.select(*(keep or []), F.col(doc_col), T.sentences(F.col(text_col)).alias("_s")).where(F.size("_s") > 0)

    @F.pandas_udf("array<int>")
    def cuts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = embedder.load()
        for batch in batches:
            flat = [x for s in batch for x in s]
            vecs = np.asarray(embed(flat), np.float64)
            vecs = vecs / (np.linalg.norm(vecs, axis=1, keepdims=True) + 1e-9)
            sizes = np.array([len(x.split()) for x in flat])
            ends = np.cumsum([len(s) for s in batch])
            yield pd.Series([[*similarity_starts(vecs[z - len(s) : z], sizes[z - len(s) : z], max_tokens, threshold), len(s)] for s, z in zip(batch, ends)])

    return _explode(sents.withColumn("_b", cuts("_s")), _sliced("_s", "_b"), doc_col, keep or [])


CHUNKERS = {"fixed": chunk_fixed, "sliding": chunk_sliding, "semantic": chunk_semantic}
_WINDOW = {"chunk_size": "size", "size": "size", "overlap": "overlap"}
#: Parameters in settings, under the reference's names too; the model of embed_model is the injected embedder.
PARAMS = {"fixed": _WINDOW, "sliding": _WINDOW, "semantic": {"max_chunk_size": "max_tokens", "max_tokens": "max_tokens", "similarity_threshold": "threshold", "threshold": "threshold", "embed_model": ""}}


def chunk_by_name(name: str, docs: DataFrame, params: dict, embedder: Embedder | None, **kw) -> DataFrame:
    """Chunks by the chunker of that name; ``semantic`` without an embedder packs sentences by size alone."""
    if name not in CHUNKERS:
        raise ValueError(f"no chunker is called {name}")
    if unknown := sorted(set(params) - set(PARAMS[name])):
        raise ValueError(f"the chunker {name} has no parameter {', '.join(unknown)}")
    known = {PARAMS[name][k]: v for k, v in params.items() if PARAMS[name][k]}
    if name != "semantic":
        return CHUNKERS[name](docs, **known, **kw)
    if embedder is None:
        known.pop("threshold", None)
        return chunk_packed(docs, **known, **kw)
    return chunk_semantic(docs, embedder, **known, **kw)
