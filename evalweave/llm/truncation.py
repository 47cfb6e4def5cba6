"""Problem 2: values cut off at a field limit or in mid-transfer.

Method: a backward character n-gram model.  Contexts are the last n characters
before a place (digits as one class, names in mid-sentence reduced to their
ending, so that the rest of the context stays comparable); for each context the
model holds how often the text ends a sentence there and how often it goes on.
The final context of a value gives the log-odds of "goes on" against "ends",
backing off from long contexts to short ones.  Facts about the value stand
beside it: debris left at a break, lengths and token counts at which values pile
up, and how far the token count of the call exceeds what the text can hold in
its language (the range is fitted per language).  A logistic model weighs the
n-gram log-odds and these facts; its log-odds are held against a threshold per
language and column.

All is fitted on all values of a column, whole, in the cluster: every place of
four fifths of the distinct values is counted, and weights and thresholds come
from all values of the other fifth (parted by hash, since a weight must be
fitted on values that its counts have not seen).  Those are cut at random places
for the purpose: with the token count of the call, without one, at a limit, with
and without debris.  Of the counts only contexts that some value or cut asks for
are kept, which changes no score of these values.

Defined results for odd input: null and blank values, placeholders and bare
markup are not truncated (they are empty, not cut); a null or zero token count
is no evidence; repeated rows are judged alike, each for itself; empty tables
give no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm import langid
from evalweave.llm.values import is_empty
from evalweave.session import received, share, written

ORDERS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 17, 20, 24)
DEPTH = max(ORDERS)
KAPPA = 3.0
RIDGE = 2.0
LONG = 80  # characters from which a token count tells a whole value from a part of it
# What transfers and cutters leave behind at a break.
DEBRIS = re.compile(r"(?:\\+|…|\.\.\.+|\[(?:\.{3}|…|truncated|cut)\]|\((?:more|continued|cont\.?|truncated)\)|�+|(?<=\s)\*{1,3}|(?<=\s)_{1,3}|\[|\(|\{|<[a-zA-Z/!][^<>]*|<|&(?:hellip;|#?[a-zA-Z0-9]{0,8})|&nbsp;|\[\d*|(?<=\s)[-–—*•]|[,;:\-–—/])$")
SOFT = re.compile(r"^(?:[,;:/–—-]|\*{1,3}|•)$")
CITE = re.compile(r"(?:\s*\[\d+(?:,\s*\d+)*\]|\s*\((?:see|vgl\.|voir|ver|zie|vedi|cf\.)?\s*[^\W\d_]*\s*\[?\d+\]?\)|\s[-–—]\s\S+\.\S+|\s\(?(?:https?://|www\.)\S+)$")
CLOSE = re.compile(r"[\s\"'”’»)*_`}\]​﻿]+$")
CLOSING = "".join(c for c in map(chr, [*range(0x3001), 0xFEFF]) if CLOSE.match(c))
LEFT = set("\\….])�*_[({<;-–—•,:/")  # how DEBRIS may end, apart from tags, entities and numbers
FINAL = ".!?。！？"
BULLET = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s")


def peel(text: str) -> tuple[str, bool, bool, bool]:
    """(core, hard debris seen, soft debris seen, ends with a final mark).

    The core is the value without white space, closing marks and break debris;
    citations and addresses after a final mark are peeled as well.
    """
    t = text.rstrip().rstrip("​﻿").rstrip()
    hard = soft = False
    for _ in range(4):
        closed = t.rstrip(CLOSING)
        if closed and closed[-1] in FINAL and not closed.endswith(".."):
            return closed, hard, soft, True
        last = t.rsplit(None, 1)[-1] if t else ""
        m = CITE.search(t) if "." in last or "/" in last or t.endswith(("]", ")")) else None
        if m and m.start() > 0:
            before = t[: m.start()].rstrip().rstrip(CLOSING)
            return before, hard, soft, True
        m = DEBRIS.search(t) if t[-1:] in LEFT or "<" in t or "&" in t[-10:] or t[-1:].isdigit() and "[" in t else None
        if not m:
            break
        if SOFT.match(m[0]):
            soft = True
        else:
            hard = True
        t = t[: m.start()].rstrip()
    stripped = t.rstrip(CLOSING)
    return stripped, hard, soft, bool(stripped) and stripped[-1] in FINAL


NAME = re.compile(r"(?<=[^\W_])(?<![.!?\n])(\s+)([^\W\d_a-zà-ÿа-я])([^\W\d_]+)")


def mask_tail(core: str, size: int = 64) -> str:
    """The last characters of a text as the model sees them, with ^ at the start of the text."""
    tail = core[-size:]
    if len(core) <= size:
        tail = "^" + tail
    tail = re.sub(r"\d", "0", tail)
    tail = NAME.sub(lambda m: m[1] + "§" + m[3][-2:], tail)
    if tail[:1] == "^" and tail[1:].isalpha() and tail[1:2].isupper():
        tail = "^§" + tail[-2:]  # a bare name
    return re.sub(r"\s+", " ", tail)


INSIDE = re.compile(r"(?<=[^.!?\s])(?=[^.!?\n])")  # places at which a text goes on
BREAK = re.compile(NAME.pattern + r"|\s{2,}|[^\S ]")


def contexts(core: str, places: list[int]) -> list[str]:
    """The contexts of ``mask_tail`` before each of the places (in order), from one look at the text."""
    text = re.sub(r"\d", "0", core)
    found = BREAK.finditer(text)
    built, at, m = "^", 0, next(found, None)
    out = []
    for i in places:
        while m and m.end() <= i:
            built = (built + text[at : m.start()] + (" §" + m[3][-2:] if m[3] else " "))[-DEPTH:]
            at, m = m.end(), next(found, None)
        if m and m.start() < i:
            name = m.start() + len(m[1]) if m[3] else i
            tail = built + text[at : m.start()] + " " + ("§" + text[name + 1 : i][-2:] if i > name + 1 else text[name:i])
        else:
            tail = built + text[max(at, i - DEPTH) : i] if i - at < DEPTH else text[i - DEPTH : i]
        if tail[0] == "^" and (i > 64 or tail[1:2].isupper() and core[:i].isalpha()):
            tail = mask_tail(core[:i])
        out.append(tail[-DEPTH:])
    return out


class Chains:
    """Contexts as chains of characters: the code of each, the one before it (0: none), and the last one of every context.

    Contexts of one text share their characters, so that none is written out.
    """

    def __init__(self, codes: np.ndarray, before: np.ndarray, last: np.ndarray):
        self.codes, self.before, self.last = codes, before, last

    @staticmethod
    def of(some: list[str]) -> Chains:
        """Contexts that are written out."""
        sizes = np.fromiter(map(len, some), np.int64, len(some))
        ends = np.cumsum(sizes)
        before = np.maximum(np.arange(sizes.sum() + 1) - 1, 0)
        before[(ends - sizes + 1)[sizes > 0]] = 0
        return Chains(_points("\0" + "".join(some)), before, np.where(sizes > 0, ends, 0))

    def hashes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each order n: its place, the hash of the last n characters of each context, and which have so many. Send back which contexts to go on with."""
        at, h = self.last, np.full(len(self.last), 0x9E3779B97F4A7C15, np.uint64)
        for n in range(1, DEPTH + 1):
            h = (h ^ self.codes[at]) * np.uint64(0x100000001B3D4F95)
            h ^= h >> np.uint64(29)
            if n in ORDERS:
                kept = yield ORDERS.index(n), h, at > 0
                at, h = at[kept], h[kept]
            at = self.before[at]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


# By code point, the last for all above: what may stand before a place at which a text goes on, and after it (INSIDE).
GOES_BEFORE = np.array([i > 0 and not chr(i).isspace() and chr(i) not in ".!?" for i in range(0x3002)])
GOES_AFTER = np.array([i > 0 and chr(i) not in ".!?\n" for i in range(0x3002)])


def going_on(cores: list[str]) -> list[Chains]:
    """The contexts of ``contexts`` before all places at which the texts go on, from one look at all texts.

    Every character follows the one in front of it, the first one a ^; white
    space in a row is one blank.  A letter of a name in mid-sentence follows a §
    with one letter of the name between.
    """
    odd = {i for i, c in enumerate(cores) if "^" in c or "\0" in c}
    plain = [c if i not in odd else "" for i, c in enumerate(cores)]
    text = re.sub(r"\d", "0", "\0\0" + "\0".join(plain) + "\0")
    starts = np.cumsum([2, *(len(c) + 1 for c in plain[:-1])]) if plain else np.zeros(0, np.int64)
    s, e, name = np.array([(*m.span(), m.start(2)) for m in BREAK.finditer(text)], np.int64).reshape(-1, 3).T
    named = name > 0
    codes = _points(text)
    kind = np.minimum(codes, len(GOES_AFTER) - 1).astype(np.int64)
    at = np.flatnonzero(GOES_BEFORE[kind[:-1]] & GOES_AFTER[kind[1:]])  # characters before the places
    if len(s):
        # long names or blanks at the start: ``mask_tail`` does not look back so far
        own = np.searchsorted(starts, s, "right") - 1
        lost = np.where(named, e - s - 2 - np.minimum(2, e - name - 1), e - s - 1)
        first = np.searchsorted(own, own)
        so_far = np.cumsum(lost)
        so_far -= (so_far - lost)[first]
        begin = np.where(first == np.arange(len(s)), starts[own], np.roll(e, 1))
        shrunk = set(own[(so_far >= 32) & (1 + begin - starts[own] - (so_far - lost) <= DEPTH)].tolist())
        if shrunk:
            at = at[~np.isin(np.searchsorted(starts, at, "right") - 1, list(shrunk))]
            odd |= shrunk
    size = len(codes)
    before = np.maximum(np.arange(size) - 1, 0)
    codes[starts - 1], before[starts - 1] = ord("^"), 0
    blank = np.where(named, name, e) - 1
    codes[blank], before[blank] = ord(" "), s - 1
    s, e, name, blank = s[named], e[named], name[named], blank[named]
    marks = size + np.arange(len(s))
    before[name + 1] = marks
    n = np.maximum(e - name - 3, 0)
    which = np.repeat(np.arange(len(s)), n)
    letters = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + name[which] + 2
    before[letters + 1] = size + len(s) + np.arange(len(letters))
    more_codes, more_before = [np.full(len(s), ord("§")), codes[letters]], [blank, marks[which]]
    # a text that is as yet one capitalised word ends as a bare name
    bare = [next((j for j, x in enumerate(c[: DEPTH - 1]) if not x.isalpha()), min(len(c), DEPTH - 1)) if c[:1].isupper() else 0 for c in plain]
    n = np.array(bare, np.int64)
    which = np.repeat(np.arange(len(n)), n)
    letters = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + starts[which]
    base = size + len(s) + len(more_codes[1])
    second, last = base + len(n) + np.arange(len(letters)), base + len(n) + len(letters) + np.arange(len(letters))
    more_codes += [np.full(len(n), ord("§")), codes[letters - 1], codes[letters]]
    more_before += [starts - 1, base + which, second]
    end = np.arange(size)
    end[letters] = last
    out = Chains(np.concatenate([codes, *more_codes]).astype(np.uint64), np.concatenate([before, *more_before]), end[at])
    return [out, *[Chains.of(contexts(cores[i], [m.start() for m in INSIDE.finditer(cores[i])])) for i in sorted(odd)]]


class Known:
    """Sorted hashes, found by their first bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        bits = len(hashes).bit_length() + 1
        self.shift = np.uint64(64 - bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount((hashes >> self.shift).astype(np.int64), minlength=1 << bits))]).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Where each stands, -1 for unknown ones."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        part = (h >> self.shift).astype(np.int64)
        at, stop = self.first[part], self.first[part + 1]
        same = self.hashes.take(at, mode="clip") == h  # in an empty part, the next part's: another one
        out = np.where(same, at, -1)
        left = np.flatnonzero(~same & (at + 1 < stop))
        while len(left):
            at[left] += 1
            same = self.hashes[at[left]] == h[left]
            out[left[same]] = at[left[same]]
            left = left[~same & (at[left] + 1 < stop[left])]
        return out


def _looked_up(some: Chains, known: list[Known]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order: its place, the contexts that are known by so many characters, and where they stand in its sorted hashes.

    A context that is not known by its last n characters is not known by more of them.
    """
    if not len(some.last):
        return
    left = np.arange(len(some.last))
    hashing = some.hashes()
    j, h, enough = next(hashing)
    while True:
        at = known[j].find(h)
        same = np.flatnonzero((at >= 0) & enough)
        left = left[same]
        yield j, left, at[same]
        if not len(left) or j + 1 == len(ORDERS):
            return
        j, h, enough = hashing.send(same)


class Counts:
    """How often a text ends and goes on, for known contexts: sorted hashes of each order."""

    def __init__(self, asked: list[np.ndarray]):
        self.asked = asked
        self.known = [Known(a) for a in asked]
        self.end = [np.zeros(len(a)) for a in asked]
        self.on = [np.zeros(len(a)) for a in asked]
        self.total = [0.0, 0.0]  # ends and places where texts go on, known or not

    def add(self, some: Chains, weight: np.ndarray | None = None) -> None:
        """Contexts in which texts go on, or end so often as ``weight`` says."""
        self.total[weight is None] += len(some.last) if weight is None else float(weight.sum())
        to = self.on if weight is None else self.end
        for j, left, at in _looked_up(some, self.known):
            to[j] += np.bincount(at, None if weight is None else weight[left], len(to[j]))


def known_contexts(some: list[str]) -> list[np.ndarray]:
    """Sorted hashes of the contexts, of each order."""
    out = [np.zeros(0, np.uint64) for _ in ORDERS]
    if not some:
        return out
    hashing = Chains.of(some).hashes()
    j, h, enough = next(hashing)
    while True:
        out[j] = np.unique(h[enough])
        if j + 1 == len(ORDERS):
            return out
        j, h, enough = hashing.send(slice(None))


FINAL_POINTS = _points(FINAL)
# Weights of the features (see ``features``) before any fit, and what a fit is drawn to where it has little to go by.
WEIGHTS = np.array([-1.5, 1.0, 4.0, 1.0, 2.0, 5.0, 7.0, 5.0, 1.0, -2.0, -9.0, -5.0, 1.0])
PRIOR = 0.08  # share of cut values for which weights and thresholds are balanced
MOST = 8  # times that a repeated value counts in the fit
HELD_OUT = 5  # one value in so many is kept from the counts, for weights and thresholds
# Debris as it is left on values that are cut for the fit.
BREAKS = ("…", "...", " [...]", "\\", ",", " -", "<b", "&am", "**", " (")


Value = tuple[str, float | None, str | None, int]  # text, tokens, language, rows that hold it


class EndModel:
    """Counts of "ends here" and "goes on" by context, and the token range by language."""

    def __init__(self) -> None:
        self.hash: list[np.ndarray] = [np.zeros(0, np.uint64) for _ in ORDERS]
        self.end: list[np.ndarray] = [np.zeros(0) for _ in ORDERS]
        self.on: list[np.ndarray] = [np.zeros(0) for _ in ORDERS]
        self.known: list[Known] | None = None  # of ``hash``, made where it is needed
        self.base = (1.0, 80.0)
        self.rates: dict[str, tuple[float, float]] = {}
        self.weights = WEIGHTS
        self.thresholds: dict[str, float] = {}  # by language; the column is the model's
        self.caps: set[int] = set()  # token counts at which calls were stopped
        self.sizes: set[int] = set()  # lengths at which fields were cut

    def fit(self, values: list[tuple], tokens: dict[int, int] | None = None, sizes: dict[int, int] | None = None) -> EndModel:
        """Fit here on values: (text, tokens or None, language or None, rows = 1); tokens, sizes: counts by token count and by length of all values without a final mark."""
        by: dict[str, list[float]] = {}
        tops: dict[int, int] = {}
        lengths: dict[int, int] = {}
        values = [(*v, 1)[:4] for v in values]
        for t, tok, lang, _ in values:
            done = peel(t)[3]
            if not done:
                lengths[len(t)] = lengths.get(len(t), 0) + 1
            if tok and tok > 0:
                if not done:
                    tops[int(tok)] = tops.get(int(tok), 0) + 1
                if (rate := token_rate(t, tok)) is not None:
                    by.setdefault(lang or "", []).append(rate)
        everything = sorted(x for v in by.values() for x in v)
        if everything:
            quantiles = lambda v: tuple(float(x) for x in np.quantile(v, [0.01, 0.99, 0.985]))
            self.set_rates(quantiles(everything), {la: (len(v), quantiles(v)) for la, v in by.items()})
        self.caps, self.sizes = piles(tokens or tops, 32), piles(sizes or lengths, 64)
        kept = [not held_out(t, times) for t, _, _, times in values]
        if sum(kept) < 50:  # too few to hold any out
            kept = [True] * len(kept)
        counted, rest = [v for v, own in zip(values, kept) if own], [v for v, own in zip(values, kept) if not own]
        ends, weights, ons = self.occurrences(counted)
        counts = Counts(known_contexts(ends + ons) if ends + ons else self.hash)
        counts.add(Chains.of(ends), weights), counts.add(Chains.of(ons))
        self.set_counts(counts)
        seen = self.seen(rest)
        self.set_weights(self.weighed(rest, *shares(seen)))
        return self

    def set_rates(self, whole: tuple[float, float, float], by: dict[str, tuple[int, tuple[float, float, float]]]) -> None:
        """From the 0.01, 0.99 and 0.985 quantiles of the tokens a character: of all, and by language with their number."""
        self.rates = {"": whole[:2]} | {la: (q[0], q[2]) for la, (n, q) in by.items() if la and n >= 30}

    def occurrences(self, values: list[Value]) -> tuple[list[str], np.ndarray, list[str]]:
        """(contexts in which the values end, how often, contexts in which they go on)."""
        ends, weights, cores = self.ends(values)
        return ends, weights, [x for c in cores for x in contexts(c, [m.start() for m in INSIDE.finditer(c)])]

    def ends(self, values: list[Value]) -> tuple[list[str], np.ndarray, list[str]]:
        """(contexts in which the values end, how often, cores of the values)."""
        ends, weights, cores = [], [], []
        for t, tok, lang, times in values:
            core, hard, soft, done = peel(t)
            at, places = 0, []
            for m in re.finditer(r"[.!?](?=\s)|\n", core):
                if m.start() > at + 1 and core[at : m.start()].strip():
                    places.append(len(core[: m.start()].rstrip()))
                at = m.end()
            whole = core.rstrip(FINAL)
            fits = tok is not None and tok > 0 and tok not in self.caps and len(core) not in self.sizes and self.excess(len(t.strip()), tok, lang) <= 0
            weights += [1] * len(places)
            if whole and not (hard or soft) and (done or fits):
                places.append(len(whole))
                weights.append(min(times, MOST))
            ends += contexts(core, places)
            cores.append(core)
        return ends, np.array(weights, float), cores

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}

    def set_counts(self, counts: Counts) -> None:
        self.known = None
        self.base = (max(1.0, counts.total[0]), max(1.0, counts.total[1]))
        for j, n in enumerate(ORDERS):
            keep = counts.end[j] + counts.on[j] >= (1 if n <= 3 else 2)
            self.hash[j], self.end[j], self.on[j] = counts.asked[j][keep], counts.end[j][keep].astype(np.float32), counts.on[j][keep].astype(np.float32)

    def _whole(self, values: list[Value]) -> Iterator[tuple]:
        """(text, core, tokens or None, language, rows, ends with a mark) of the values that don't look cut."""
        for t, tok, lang, times in values:
            core, hard, _, done = peel(t)
            known = tok is not None and tok > 0
            if t.strip() and (done or not (hard or len(t) in self.sizes or known and (tok in self.caps or self.excess(len(t.strip()), tok, lang) > 0))):
                yield t, core, tok if known else None, lang, times, done

    def seen(self, values: list[Value]) -> np.ndarray:
        """Of the values that don't look cut: rows with a final mark, rows of long ones without, values without a token count, values."""
        out = np.zeros(4)
        for t, _, tok, _, times, done in self._whole(values):
            out += (times * done, times * (not done and len(t) >= LONG), tok is None, 1)
        return out

    def made(self, values: list[Value], bare: float = 1.0, unknown: float = 1.0) -> list[tuple]:
        """What weights are fitted on: (text, tokens, language, is cut, weight, feature of a limit or None, doubtful)."""
        out = []
        for t, core, tok, lang, times, done in self._whole(values):
            out.append((t, tok, lang, False, float(times), None, not done))  # a doubtful one joins the whole ones once a first fit takes it for one
            if not done:
                continue
            rng = np.random.default_rng(xxhash.xxh32_intdigest(t))
            out.append((core.rstrip(FINAL), tok, lang, False, bare * times, None, False))
            final = np.isin(_points(core), FINAL_POINTS)
            places = np.flatnonzero(~(final[:-1] | final[1:])) + 1
            places = places[(places >= max(8, len(core) // 5)) & (places < len(core) - 3)]
            # cut later, so that the count of the call stands; without a count; at a field's limit; at a call's limit
            for w, tells, limit in ((1.0, True, None), (unknown, False, None), (0.2 * bool(self.sizes), rng.random() > unknown, 5), (0.2 * bool(self.caps and tok), None, 6)):
                at = places[places >= LONG] if limit == 6 else places
                if len(at) and w:
                    piece = core[: rng.choice(at)]
                    own = tok if tells else float(max(1, round(tok * len(piece) / len(core)))) if tells is None else None
                    out.append((piece + (BREAKS[rng.integers(len(BREAKS))] if rng.random() < 0.25 else ""), own, lang, True, w, limit, False))
        return out

    def weighed(self, values: list[Value], bare: float, unknown: float) -> dict[tuple, np.ndarray]:
        """Weight and number by (language, is cut, doubtful, *features) of what is made of the values; equal ones together, features to 1/32."""
        cases = self.made(values, bare, unknown)
        out: dict[tuple, np.ndarray] = {}
        for (_, _, lang, cut, w, limit, doubtful), f in zip(cases, self.features_many(*([c[i] for c in cases] for i in range(3)))):
            if f is not None:
                if limit:
                    f[limit] = 1.0
                key = (lang or "", cut, doubtful, *[round(32 * x) for x in f])
                out[key] = out.get(key, 0.0) + np.array([w, 1.0])
        return out

    def set_weights(self, weighed: dict[tuple, np.ndarray]) -> None:
        """Weights by logistic regression, and thresholds per language, on whole values and cuts of them."""
        keys = sorted(weighed)
        la, y, unsure = (np.array([k[i] for k in keys], kind) for i, kind in enumerate((object, bool, bool)))
        x, y = np.array([k[3:] for k in keys], float) / 32, y.astype(float)
        given, n = np.array([weighed[k] for k in keys]).reshape(-1, 2).T
        if not keys or (n * y).sum() < 50 or (n * (1 - y))[~unsure].sum() < 50:
            return
        counts = ~unsure
        for _ in range(2):
            w = given * counts
            w *= 2_000 * np.where(y > 0, PRIOR / (w * y).sum(), (1 - PRIOR) / (w * (1 - y)).sum())
            self.weights = logistic(x, y, w, WEIGHTS)
            score = x @ self.weights
            self.thresholds = {"": best_threshold(score, y, w)}
            for one in set(la):
                at = la == one
                if (n * y)[at].sum() >= 200 and (n * (1 - y))[at].sum() >= 100:
                    self.thresholds[one] = best_threshold(score[at], y[at], w[at])
            counts = ~unsure | (score <= np.array([self.threshold(z) for z in la]))

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang or "", self.thresholds.get("", 0.0))

    def excess(self, size: int, tokens: float, lang: str | None) -> float:
        """Log of the tokens over the most that a whole text of this size takes; 0 or less if it can hold them."""
        rate = self.rates.get(lang or "", self.rates.get(""))
        if not rate:
            return 0.0
        return math.log((tokens + 1e-9) / (size * rate[1] + 1.5))

    def goes_on(self, cores: list[str]) -> np.ndarray:
        """Log-odds of "goes on" against "ends" given each final context, without the prior of either."""
        p = np.full(len(cores), self.base[0] / (self.base[0] + self.base[1]))
        if self.known is None:
            self.known = [Known(h) for h in self.hash]
        for j, left, at in _looked_up(Chains.of([mask_tail(c)[-DEPTH:] for c in cores]), self.known):
            e, c = self.end[j][at].astype(float), self.on[j][at].astype(float)
            p[left] = (e + KAPPA * p[left]) / (e + c + KAPPA)
        p = np.clip(p, 1e-7, 1 - 1e-7)
        return np.log((1 - p) / p) - math.log(self.base[1] / self.base[0])

    def features_many(self, texts: list[str | None], tokens: list[float | None], langs: list[str | None]) -> list[list[float] | None]:
        """What speaks for and against a cut; None for values without text.

        In order: one; n-gram log-odds of the final context; hard and soft
        debris; a trailing blank; a length, a token count at which values pile
        up; a surplus of tokens, and how large; tokens that fit a long value, a
        short one; a final mark; a final mark under a surplus.
        """
        peeled = [None if is_empty(t) else peel(t) for t in texts]
        at = [i for i, x in enumerate(peeled) if x and re.search(r"[^\W_]", x[0])]
        out: list[list[float] | None] = [None] * len(texts)
        for i, on in zip(at, np.clip(self.goes_on([peeled[i][0].rstrip(FINAL) for i in at]), -9.0, 9.0).tolist()):
            text, tok, (_, hard, soft, done) = texts[i], tokens[i], peeled[i]
            known = tok is not None and tok == tok and tok > 0
            size = len(text.strip())
            x = self.excess(size, tok, langs[i]) if known else 0.0
            over = x > 0.03
            out[i] = [
                1.0, on if not done or over else 0.0, float(hard), float(soft and not hard), float(not done and text[-1] == " " and text[0] != " "),
                float(not done and len(text) in self.sizes), float(not done and known and tok in self.caps),
                float(over and not done), min(6.0, 25 * x) if over and not done else 0.0, float(known and x <= 0 and size >= LONG), float(known and x <= 0 and size < LONG), float(done), min(6.0, 10 * x) if over and done else 0.0,
            ]
        return out

    def log_odds_many(self, texts: list[str | None], tokens: list[float | None], langs: list[str | None]) -> list[float]:
        """Log-odds that each value is cut off, to be held against ``threshold``; -99 without text."""
        return [-99.0 if f is None else float(np.dot(self.weights, f)) for f in self.features_many(texts, tokens, langs)]

    def log_odds(self, text: str | None, tokens: float | None, lang: str | None) -> float:
        return self.log_odds_many([text], [tokens], [lang])[0]

    def is_cut(self, text: str | None, tokens: float | None, lang: str | None) -> bool:
        return self.log_odds(text, tokens, lang) > self.threshold(lang)


def token_rate(text: str, tokens: float | None) -> float | None:
    """Tokens a character of a long value with a final mark."""
    core, hard, _, done = peel(text)
    return tokens / len(text.strip()) if tokens and tokens > 0 and done and not hard and len(core) >= LONG else None


def held_out(text: str, times: int) -> bool:
    """Whether a value is kept from the counts, for weights and thresholds; repeated ones are not."""
    return times == 1 and xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass"), 1) % HELD_OUT == 0


def shares(seen: np.ndarray) -> tuple[float, float]:
    """How often whole values go without a mark, and without a token count."""
    return seen[1] / max(1, seen[0]), max(0.05, seen[2] / max(1, seen[3]))


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Weights of a logistic model of y, drawn to ``start``, by Newton steps that are halved until they help."""

    def loss(b: np.ndarray) -> float:
        return float((w * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ b))).sum() + RIDGE / 2 * ((b - start) ** 2).sum())

    beta = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.eye(len(beta)) * RIDGE, x.T @ (w * (y - p)) - RIDGE * (beta - start))
        now, part = loss(beta), 1.0
        while part > 1e-4 and loss(beta + part * step) >= now:
            part /= 2
        if part <= 1e-4:
            return beta
        beta = beta + part * step
    return beta


def best_threshold(score: np.ndarray, cut: np.ndarray, weight: np.ndarray) -> float:
    """Threshold of the least weighted error, in the middle between the two scores it parts; within 2 of 0."""
    order = np.argsort(score, kind="stable")
    s, c, w = score[order], cut[order], weight[order]
    lost = np.concatenate([[0], np.cumsum(w * c)])  # cuts at or below the threshold
    false = (w * (1 - c)).sum() - np.concatenate([[0], np.cumsum(w * (1 - c))])
    i = int(np.argmin(lost + false))
    low, high = s[max(0, i - 1)], s[min(i, len(s) - 1)]
    return float(np.clip((low + high) / 2, -2.0, 2.0))


def piles(counts: dict[int, int], least: int) -> set[int]:
    """Values from ``least`` on that occur far more often than their neighbours."""
    out = set()
    for v, n in counts.items():
        if v >= least and n >= 8:
            near = sum(counts.get(v + d, 0) for d in (-6, -5, -4, -3, -2, 2, 3, 4, 5, 6)) / 10
            if n > 4 * max(near, 1.0) and n >= max(counts.get(v - 1, 0), counts.get(v + 1, 0)):
                out.add(v)
    return out


def source_column(col: Column) -> Column:
    """A source name in one spelling: trimmed, lower case, words joined by _."""
    t = F.lower(F.regexp_replace(col, r"^[\s\p{IsWhite_Space}]+|[\s\p{IsWhite_Space}]+$", ""))
    return F.nullif(F.regexp_replace(t, r"[\s\p{IsWhite_Space}_-]+", "_"), F.lit(""))


def fit_end_model(rows: DataFrame, lang_model: langid.EcocModel, text_col: str = "answer", tokens_col: str | None = "tokens_out") -> EndModel:
    """Fit on all values of the column, for scoring them.

    The distinct values are written once, with language; passes over them count
    in the cluster.  The driver gets what the model is made of: the contexts
    that are asked for with their counts, and weights by equal features.
    """
    spark = rows.sparkSession
    tok = F.col(tokens_col).cast("double") if tokens_col else F.lit(None).cast("double")
    rows = rows.where(F.length(text_col) > 0)
    weights = spark.sparkContext.broadcast(lang_model.weights)

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm = langid.EcocModel(weights.value)
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                yield part.assign(lang=main_langs(part["t"].tolist(), lm), rate=[token_rate(t, k) for t, k in zip(part["t"], part["k"])])

    distinct = rows.select(F.col(text_col).alias("t"), tok.alias("k")).groupBy("t", "k").agg(F.count("*").alias("times"))
    values = written(distinct.mapInPandas(told, "t string, k double, times bigint, lang string, rate double"))
    open_end = rows.where(~F.col(text_col).rlike(r"[.!?][\s\]\"'”’»)*\d\[]*$"))
    sizes = {r["v"]: r["count"] for r in open_end.groupBy(F.length(text_col).alias("v")).agg(F.countDistinct(F.xxhash64(text_col)).alias("count")).where("count >= 5").collect()}
    tokens = {r["v"]: r["count"] for r in open_end.groupBy(tok.cast("int").alias("v")).agg(F.countDistinct(F.xxhash64(text_col)).alias("count")).where("count >= 5 and v > 0").collect()}
    model = EndModel()
    model.caps, model.sizes = piles(tokens, 32), piles(sizes, 64)
    got = values.where("rate is not null").rollup("lang").agg(F.grouping("lang").alias("all"), F.count("*").alias("n"), F.percentile("rate", F.array(*[F.lit(x) for x in (0.01, 0.99, 0.985)])).alias("q")).collect()
    for r in got:
        if r["all"] and r["n"]:
            model.set_rates(tuple(r["q"]), {x["lang"] or "": (x["n"], tuple(x["q"])) for x in got if not x["all"]})
    parts = lambda pdf: ([(t, None if k != k else float(k), la, int(min(n, MOST))) for t, k, la, n in zip(part["t"], part["k"], part["lang"], part["times"])] for part in (pdf.iloc[lo : lo + 500] for lo in range(0, len(pdf), 500)))
    rest = lambda vs: [v for v in vs if held_out(v[0], v[3])]

    ready = share(spark, model)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, total, seen, known = received(ready), np.zeros(2), np.zeros(4), [np.zeros(0, np.uint64)] * len(ORDERS)
        for pdf in batches:
            ends: set[str] = set()
            for vs in parts(pdf):
                own = rest(vs)
                total += (len(vs) - len(own), len(own))
                seen += m.seen(own)
                ends.update(mask_tail(peel(t)[0].rstrip(FINAL))[-DEPTH:] for t in [*(v[0] for v in vs), *(c[0] for c in m.made(own))])
            known = [np.union1d(a, b) for a, b in zip(known, known_contexts(sorted(ends)))]
        yield pd.DataFrame({"j": -1, "key": range(6), "n": [*total, *seen]})
        for j, a in enumerate(known):
            yield pd.DataFrame({"j": j, "key": a.view(np.int64), "n": 0.0})

    got = values.mapInPandas(ask, "j int, key bigint, n double").groupBy("j", "key").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    sums = got[got["j"] < 0].set_index("key")["n"].reindex(range(6), fill_value=0.0).to_numpy()
    hold = sums[0] >= 50  # else too few to hold any out
    asked = share(spark, [np.sort(got["key"][got["j"] == j].to_numpy(np.int64).view(np.uint64)) for j in range(len(ORDERS))])
    del got

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, counts = received(ready), Counts(received(asked))
        for pdf in batches:
            for vs in parts(pdf):
                ends, often, cores = m.ends([v for v in vs if not hold or not held_out(v[0], v[3])])
                counts.add(Chains.of(ends), often)
                for some in going_on(cores):
                    counts.add(some)
        yield pd.DataFrame({"j": [-1], "at": [0], "e": [counts.total[0]], "o": [counts.total[1]]})
        for j in range(len(ORDERS)):
            at = np.flatnonzero(counts.end[j] + counts.on[j])
            yield pd.DataFrame({"j": j, "at": at, "e": counts.end[j][at], "o": counts.on[j][at]})

    got = values.mapInPandas(count, "j int, at int, e double, o double").groupBy("j", "at").agg(F.sum("e").alias("e"), F.sum("o").alias("o")).toArrow().to_pandas()
    counts = Counts(received(asked))
    counts.total = got.loc[got["j"] < 0, ["e", "o"]].sum().tolist()
    for j in range(len(ORDERS)):
        own = got[got["j"] == j]
        counts.end[j][own["at"]], counts.on[j][own["at"]] = own["e"], own["o"]
    model.set_counts(counts)
    del got, counts
    if hold:
        fitted, (bare, unknown) = share(spark, model), shares(sums[2:])
        names = ["lang", "cut", "doubtful", *[f"f{i}" for i in range(len(WEIGHTS))]]

        def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m, out = received(fitted), {}
            for pdf in batches:
                for vs in parts(pdf):
                    for key, w in m.weighed(rest(vs), bare, unknown).items():
                        out[key] = out.get(key, 0.0) + w
            if out:
                yield pd.DataFrame([(*key, *w) for key, w in out.items()], columns=[*names, "w", "n"])

        got = values.mapInPandas(weigh, "lang string, cut boolean, doubtful boolean, " + ", ".join(f"{c} int" for c in names[3:]) + ", w double, n double").groupBy(*names).agg(F.sum("w").alias("w"), F.sum("n").alias("n")).toPandas()
        # rounded, since the order in which a cluster adds is not fixed
        model.set_weights({tuple(r[:-2]): np.array([round(r[-2], 6), r[-1]]) for r in got[[*names, "w", "n"]].itertuples(index=False, name=None)})
        fitted.unpersist()
    ready.unpersist(), asked.unpersist()
    return model


def score_truncation(
    rows: DataFrame, end_model: EndModel, lang_model: langid.EcocModel, id_col: str, text_col: str = "answer", tokens_col: str | None = "tokens_out", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per row: id, kept columns, ``lang``, ``log_odds``, ``has_text`` and ``truncated`` (log-odds above the threshold of its language)."""
    spark = rows.sparkSession
    weights = spark.sparkContext.broadcast(lang_model.weights)
    model = share(spark, end_model)
    tok = F.col(tokens_col).cast("double") if tokens_col else F.lit(None).cast("double")
    src = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), tok.alias("k"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    types = dict(src.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm, em = langid.EcocModel(weights.value), received(model)
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                texts = [t if isinstance(t, str) else None for t in part["t"]]
                langs = main_langs(texts, lm)
                odds = em.log_odds_many(texts, part["k"].tolist(), langs)
                res = part.drop(columns=["t", "k"]).copy()
                res["lang"] = langs
                res["log_odds"] = odds
                res["has_text"] = [not is_empty(t) for t in texts]
                res["truncated"] = [o > em.threshold(la) for o, la in zip(odds, langs)]
                yield res

    kept = "".join(f", k{i} {types[f'k{i}']}" for i in range(len(keep)))
    out = src.mapInPandas(run, f"id {types['id']}{kept}, lang string, log_odds double, has_text boolean, truncated boolean")
    return out.select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang", "log_odds", "has_text", "truncated")


def main_langs(texts: list[str | None], model: langid.EcocModel) -> list[str | None]:
    """Main language of each text, decoded from all of it at once."""
    at = [i for i, t in enumerate(texts) if t and langid.LETTER.search(t)]
    best, _, _ = model.decode([langid._plain(texts[i]) for i in at])
    out: list[str | None] = [None] * len(texts)
    for i, b in zip(at, best):
        out[i] = langid.LANGS[b]
    return out


def source_report(scored: DataFrame, source_col: str = "source", has_text: str = "has_text") -> DataFrame:
    """Per source: values with text, cut-off ones and their share. A null or blank source is reported as null."""
    return (
        scored.groupBy(source_column(F.col(source_col)).alias("source"))
        .agg(F.count(F.when(F.col(has_text), 1)).alias("n_values"), F.count(F.when(F.col("truncated"), 1)).alias("n_truncated"))
        .withColumn("share", F.when(F.col("n_values") > 0, F.col("n_truncated") / F.col("n_values")))
    )
