"""Problem 7: held-out evaluation texts inside a training corpus.

Method: the evaluation items form a BM25 inverted index whose postings carry
block maxima; every passage (overlapping window) of every training document is
a query, answered by block-max WAND with all items above a threshold; each hit
is then verified by aligning the item's words with the whole document.

Impacts are divided by the item's self-score, so that one threshold means a
share of the item.  The index holds only the held-out set, which is small by
nature; its size is checked in words, and a set above ``shard_words`` is worked
off in shards: the corpus is then tokenised and written once, and each shard's
index is released before the next is sent.  ``recall_of_search`` holds the
search against a full scan.

Defined results for odd input: null or blank texts match nothing; repeated
document rows give one finding per id pair; an empty item table gives no rows;
texts are used whole.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.session import checkpointed, received, share

K1, B = 0.9, 0.4
BLOCK = 16
MAX_RANGES = 1024
MAX_CELLS = 1 << 23  # numbers in the table of range bounds
TAG = re.compile(r"<[^<>]{0,200}>")
WORD = re.compile(r"[^\W_]+")
APOSTROPHE = re.compile(r"(?<=\w)['’‘`´](?=\w)")
HYPHEN_BREAK = re.compile(r"(?<=\w)[-­‐]\s*\n\s*(?=\w)")


def words(text: str | None) -> list[str]:
    """Words without markup, case, accents, apostrophes and line-end hyphens."""
    t = text or ""
    if "&" in t:
        t = html.unescape(t)
    if "<" in t:
        t = TAG.sub(" ", t)
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t.replace("\u00ad", "").replace("\u200b", "").casefold())
        t = "".join(ch for ch in t if not unicodedata.combining(ch))
    else:
        t = t.lower()
    if "\n" in t:
        t = HYPHEN_BREAK.sub("", t)
    if "'" in t or not t.isascii():
        t = APOSTROPHE.sub("", t)
    return WORD.findall(t)


class ItemIndex:
    """BM25 postings of the items, in blocks with their largest impact."""

    def __init__(self, items: list[tuple[int, str, str]]):
        items = sorted((i, k or "passage", t or "") for i, k, t in items)
        toks = [words(t) for _, _, t in items]
        keep = [x for x in range(len(items)) if toks[x]]
        self.ids = [items[x][0] for x in keep]
        self.kinds = [items[x][1] for x in keep]
        self.tokens = [toks[x] for x in keep]
        n = len(keep)
        avg = sum(map(len, self.tokens)) / n if n else 1.0
        df = Counter(w for t in self.tokens for w in set(t))
        idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
        post: dict[str, list[tuple[int, float]]] = {}
        for x, t in enumerate(self.tokens):
            imp = {w: idf[w] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(t) / avg)) for w, f in Counter(t).items()}
            total = sum(imp.values()) or 1.0
            for w, v in imp.items():
                post.setdefault(w, []).append((x, v / total))
        self.vocab = {w: j for j, w in enumerate(post)}
        self.docs = [[x for x, _ in p] for p in post.values()]
        self.imps = [[v for _, v in p] for p in post.values()]
        self.block_last = [[d[min(lo + BLOCK, len(d)) - 1] for lo in range(0, len(d), BLOCK)] for d in self.docs]
        self.block_max = [[max(v[lo : lo + BLOCK]) for lo in range(0, len(v), BLOCK)] for v in self.imps]
        self.term_max = np.array([max(v) for v in self.imps] or [0.0])
        # per term and range of items the largest impact: whole ranges fall away at one sum
        self.width = max(1, -(-n // max(16, min(MAX_RANGES, MAX_CELLS // max(1, len(self.docs))))))
        self.range_max = np.zeros((len(self.docs), max(1, -(-n // self.width))), np.float32)
        for t, (d, v) in enumerate(zip(self.docs, self.imps)):
            np.maximum.at(self.range_max[t], np.asarray(d) // self.width, np.asarray(v, np.float32))
        self.bigrams = [set(zip(t, t[1:])) for t in self.tokens]

    def search(self, terms: list[int], theta: float) -> list[tuple[int, float]]:
        """All (item, score) with score >= theta, by block-max WAND with a fixed threshold within the ranges whose bound reaches it."""
        parts = self.range_max[terms]
        bounds = parts.sum(0)
        near = np.flatnonzero(bounds >= theta - 1e-4).tolist()
        if self.width == 1:  # the largest impacts of single items are their impacts
            return [(x, score) for x in near if (score := float(bounds[x])) >= theta - 1e-6]
        hits = []
        for r in near:
            hits += self._wand([terms[i] for i in np.flatnonzero(parts[:, r]).tolist()], r * self.width, min(len(self.ids), (r + 1) * self.width), theta)
        return hits

    def _wand(self, terms: list[int], begin: int, end: int, theta: float) -> list[tuple[int, float]]:
        cur = []  # next item, place, term
        for t in terms:
            d = self.docs[t]
            p = bisect_left(d, begin)
            if p < len(d) and d[p] < end:
                cur.append([d[p], p, t])
        hits = []
        while True:
            cur.sort()
            acc, pivot = 0.0, -1
            for j, (d, _, t) in enumerate(cur):
                if d >= end:
                    break
                acc += self.term_max[t]
                if acc >= theta:
                    pivot = j
                    break
            if pivot < 0:
                return hits
            item = cur[pivot][0]
            while pivot + 1 < len(cur) and cur[pivot + 1][0] == item:
                pivot += 1
            bound, nearest = 0.0, cur[pivot + 1][0] if pivot + 1 < len(cur) else end
            for d, p, t in cur[: pivot + 1]:
                b = p // BLOCK
                last = self.block_last[t]
                while b < len(last) and last[b] < item:
                    b += 1
                if b < len(last):
                    bound += self.block_max[t][b]
                    nearest = min(nearest, last[b] + 1)
            if bound >= theta:
                if cur[0][0] == item:
                    score = 0.0
                    for c in cur[: pivot + 1]:
                        if c[0] == item:
                            score += self.imps[c[2]][c[1]]
                    if score >= theta:
                        hits.append((item, score))
                    target = item + 1
                else:
                    target = item
            else:
                target = max(nearest, item + 1)
            for c in cur[: pivot + 1]:
                if c[0] < target:
                    d, p = self.docs[c[2]], c[1]
                    last = self.block_last[c[2]]
                    b = p // BLOCK
                    while b < len(last) and last[b] < target:  # skip whole blocks
                        b += 1
                    p = max(p, b * BLOCK)
                    while p < len(d) and d[p] < target:
                        p += 1
                    c[0], c[1] = (min(d[p], end) if p < len(d) else end), p


def covered(item: list[str], doc: list[str], gap: int = 4, least: int = 5) -> float:
    """Share of the item's words that the document holds in order in its best one or two stretches.

    A stretch is a chain of equal runs at most ``gap`` words apart on either
    side, with at least ``least`` equal words that are most of its span; words
    added, dropped, replaced or misspelled within it do not count against it.
    """
    runs = [b for b in SequenceMatcher(None, item, doc, autojunk=False).get_matching_blocks() if b.size]
    chains: list[list[int]] = []  # item from, item to, doc to, equal words
    for b in runs:
        if chains:
            c = chains[-1]
            if b.a - c[1] <= gap and b.b - c[2] <= gap:
                c[1], c[2], c[3] = b.a + b.size, b.b + b.size, c[3] + b.size
                continue
        chains.append([b.a, b.a + b.size, b.b + b.size, b.size])
    spans = sorted((c[1] - c[0] for c in chains if c[3] >= least and c[3] >= 0.65 * (c[1] - c[0])), reverse=True)
    return sum(spans[:2]) / len(item)



THETA = {"passage": 0.20, "question": 0.40}
LEAST = {"passage": 0.4, "question": 0.88}


def candidates(ix: ItemIndex, toks: list[str], window: int, theta: dict[str, float]) -> set[int]:
    """Items that some passage of the document reaches with its score.

    Windows hold any fifth of an item: for items of over 2.5 windows, wider ones
    are searched besides, doubled until they fit the longest.
    """
    low = min(theta.values())
    longest, wide = max(map(len, ix.tokens), default=0), [(window, 0)]
    while longest > 2.5 * wide[-1][0]:
        wide.append((2 * wide[-1][0], 2.5 * wide[-1][0]))
    known = [ix.vocab.get(w, -1) for w in toks]
    cand: set[int] = set()
    for size, over in wide:
        step = size // 2
        for lo in range(0, max(1, len(toks) - step), step):
            terms = set(known[lo : lo + size])
            terms.discard(-1)
            if terms:
                cand.update(x for x, v in ix.search(list(terms), low) if v >= theta.get(ix.kinds[x], low) - 1e-6 and len(ix.tokens[x]) > over)
    return cand


def search_document(ix: ItemIndex, toks: list[str], window: int, theta: dict[str, float], least: dict[str, float]) -> list[tuple[int, float]]:
    """(item, verified share) of every item that the document holds."""
    cand = candidates(ix, toks, window, theta) if ix.ids and toks else set()
    if not cand:
        return []
    pairs, found = set(zip(toks, toks[1:])), []
    for x in sorted(cand):
        need = least.get(ix.kinds[x], 0.4)
        # covered() takes stretches of 0.65 equal words: if each of the others stands alone, 0.3 of the bigrams are left, less one per stretch
        if len(pairs & ix.bigrams[x]) >= max(1.0, 0.3 * need * len(ix.bigrams[x]) - 2) and (c := covered(ix.tokens[x], toks)) >= need:
            found.append((x, min(1.0, c)))
    return found


def scan_document(ix: ItemIndex, toks: list[str], least: dict[str, float]) -> list[tuple[int, float]]:
    """As ``search_document``, by aligning every item that shares enough words to be held: no case can fall under that."""
    have, found = Counter(toks), []
    for x, item in enumerate(ix.tokens):
        need = least.get(ix.kinds[x], 0.4)
        if sum(min(n, have[w]) for w, n in Counter(item).items()) >= 0.65 * need * len(item) - 1e-9 and (c := covered(item, toks)) >= need:
            found.append((x, min(1.0, c)))
    return found


def _per_document(src: DataFrame, index: Broadcast, run_one: Callable[[ItemIndex, list[str]], list[tuple]], item_type: str, fields: str, names: list[str]) -> DataFrame:
    """Rows (id, item_id, ...) of ``run_one`` for each document of ``src`` (id, text or words)."""
    kind = dict(src.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = received(index)
        for pdf in batches:
            found = []
            for did, text in zip(pdf["id"], pdf["text"]):
                toks = words(text) if isinstance(text, str) or text is None else list(text)
                found += [(did, ix.ids[x], *rest) for x, *rest in run_one(ix, toks)]
            yield pd.DataFrame(found, columns=["id", "item_id", *names])

    return src.mapInPandas(run, f"id {kind}, item_id {item_type}, {fields}")


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 96,
    theta: dict[str, float] | None = None,
    least: dict[str, float] | None = None,
    shard_words: int = 2_000_000,
) -> DataFrame:
    """(doc id, item_id, share): every document that holds a fitting share of an item.

    ``theta`` is the BM25 threshold per item kind as a part of the item's
    self-score, ``least`` the verified share of its words.
    """
    theta, least = theta or THETA, least or LEAST
    spark = docs.sparkSession
    size = items.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] or 0
    shards = max(1, math.ceil(size / shard_words))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    it = items.select("item_id", "item_kind", "text")
    item_type = dict(it.dtypes)["item_id"]
    if shards > 1:
        kind = dict(src.dtypes)["id"]
        src = checkpointed(src.mapInPandas(lambda batches: (pdf.assign(text=pdf["text"].map(words)) for pdf in batches), f"id {kind}, text array<string>"))
    parts = []
    for s in range(shards):
        index = share(spark, ItemIndex([tuple(r) for r in it.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == s).collect()]))
        part = _per_document(src, index, lambda ix, toks: search_document(ix, toks, window, theta, least), item_type, "share double", ["share"])
        if shards > 1:
            part = checkpointed(part)
            index.unpersist()
        parts.append(part)
    return reduce(DataFrame.unionByName, parts).groupBy(F.col("id").alias(id_col), "item_id").agg(F.max("share").alias("share"))


def recall_of_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 96) -> DataFrame:
    """One row: pairs that a full scan of every item against the given documents finds, those the search finds of them, and the recall.

    For item sets of one shard.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    index = share(docs.sparkSession, ItemIndex([tuple(r) for r in items.select("item_id", "item_kind", "text").collect()]))

    def both(ix: ItemIndex, toks: list[str]) -> list[tuple]:
        hit = {x for x, _ in search_document(ix, toks, window, THETA, LEAST)}
        return [(x, x in hit) for x, _ in scan_document(ix, toks, LEAST)]

    got = _per_document(src, index, both, dict(items.dtypes)["item_id"], "hit boolean", ["hit"]).distinct()
    n, k = F.count("*"), F.count(F.when(F.col("hit"), 1))
    return got.agg(n.alias("n_pairs"), k.alias("n_found"), F.when(n > 0, k / n).otherwise(1.0).alias("recall"))
