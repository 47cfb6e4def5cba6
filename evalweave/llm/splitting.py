"""Problem 4: texts over the size limit, cut into pieces at natural boundaries.

Method: balanced targets.  The least number of pieces that the limits allow is
computed, equal-length targets are placed, and each target is snapped to the
strongest boundary near it (paragraph, line, sentence, clause, word); if a
piece then breaks a limit, a piece is added and the targets are placed anew.
Every piece after the first begins ``overlap`` tokens before its own part.

A token is a run of characters other than Unicode White_Space.  A token that is
too long for a piece is cut between code points, not before combining marks;
white space that is too long for a piece is cut like a token of no weight.
Every character is in the own part of one piece.

Only rows over a limit leave the JVM.  Defined results for odd input: null,
empty and small texts are one piece (``split_rows`` returns them only with
``all_rows``); repeated rows are split alike, each for itself; whole texts are
used, whatever their length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, MAX_CHARS, OVERLAP = 384, 2600, 32
# The characters of Unicode's White_Space.
WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TOKEN = re.compile(f"[^{WS}]+")
SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]*_]*$")
UNBLANKED = re.compile("[^。！？、；]+[。！？、；]*|[。！？、；]+")
CLAUSE_END = re.compile(r"[,;:–—][\"'”’»)\]]*$")


def token_count(text: Column) -> Column:
    """Tokens of a text, in the JVM."""
    return F.regexp_count(text, F.lit(r"[^\p{IsWhite_Space}]+"))


def over_limit(text: Column, max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS) -> Column:
    """Whether a text is over a limit; tokens are only counted where there is room for so many."""
    n = F.length(text)
    return F.coalesce((n > max_chars) | ((n > 2 * max_tokens) & (token_count(text) > max_tokens)), F.lit(False))


def _units(text: str, longest: int) -> list[tuple[int, int, int, int]]:
    """(from, to, tokens begun, strength of the boundary before it) of each token or part of a long token."""
    out: list[tuple[int, int, int, int]] = []
    end = 0

    def blanks(lo: int, hi: int) -> None:
        """Units of white space, where there is too much of it to go with its neighbours."""
        if hi - lo > longest:
            out.extend((at, min(hi, at + longest), 0, 4 if at == lo else 1) for at in range(lo, hi, longest))

    for m in TOKEN.finditer(text):
        gap, before = text[end : m.start()], text[max(0, end - 8) : end]
        blanks(end, m.start())
        if not out:
            strength = 9
        elif gap.count("\n") > 1 or "\u2029" in gap:
            strength = 5
        elif "\n" in gap or "\u2028" in gap or "\r" in gap:
            strength = 4
        elif SENTENCE_END.search(before):
            strength = 3
        elif CLAUSE_END.search(before):
            strength = 2
        else:
            strength = 1
        lo, begun = m.start(), 1
        if m.end() - lo > longest:  # a script without blanks, or one long word: cut after its own marks first
            for part in UNBLANKED.finditer(m[0]):
                stop = m.start() + part.end()
                while stop - lo > longest:
                    cut = lo + longest
                    while cut > lo + longest // 2 and (unicodedata.combining(text[cut]) or text[cut] in "\u200d\ufe0f" or text[cut - 1] == "\u200d"):
                        cut -= 1
                    out.append((lo, cut, begun, strength))
                    lo, begun, strength = cut, 0, 0
                if stop < m.end():
                    out.append((lo, stop, begun, strength))
                    lo, begun, strength = stop, 0, 3 if text[stop - 1] in "。！？" else 2
        out.append((lo, m.end(), begun, strength))
        end = m.end()
    blanks(end, len(text))
    return out


def split_text(text: str, max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, int]]:
    """Pieces (start, own start, end, tokens, strength of the cut) of a text, as places in it.

    The own parts [own start, next own start) make up the text without gap or
    overlap; a piece's text is text[start:end].
    """
    units = _units(text, max(1, min(200, max_chars // 4)))
    n = len(units)
    # a piece runs to where the next one's own part begins, the first from the start of the text and the last to its end
    edge = [0, *[u[0] for u in units[1:]], len(text)]
    begun = [0]
    for u in units:
        begun.append(begun[-1] + u[2])
    tokens = begun[-1]
    if not n or tokens <= max_tokens and len(text) <= max_chars:
        return [(0, 0, len(text), tokens, 9)]
    overlap = max(0, min(overlap, max_tokens // 2))

    def back(i: int) -> int:
        """First unit of the overlap of a piece whose own part begins at unit i; never more than a third of the characters."""
        j, seen = i, 0
        while j > 0 and seen < overlap and edge[i] - edge[j - 1] <= max_chars // 3:
            j -= 1
            seen += units[j][2]
        return j

    def cost(i: int, j: int) -> tuple[int, int]:
        b = back(i) if i else 0
        return begun[j] - begun[b] + (0 if units[b][2] or text[units[b][0]].isspace() else 1), edge[j] - edge[b]

    def fits(i: int, j: int) -> bool:
        t, c = cost(i, j)
        return t <= max_tokens and c <= max_chars

    m = max(2, math.ceil((tokens - overlap) / max(1, max_tokens - overlap)), math.ceil(len(text) / max_chars))
    while True:
        cuts = [0]
        for k in range(1, m):
            left = n - cuts[-1]
            target = cuts[-1] + max(1, round(left / (m - k + 1)))
            reach = max(1, left // (m - k + 1) // 4)
            best, rank = None, None
            for j in range(max(cuts[-1] + 1, target - reach), min(n - (m - k), target + reach) + 1):
                r = (units[j][3], -abs(j - target))
                if (rank is None or r > rank) and fits(cuts[-1], j):
                    best, rank = j, r
            if best is None:
                break
            cuts.append(best)
        if len(cuts) == m and fits(cuts[-1], n):
            break
        m += max(1, m // 50)
        if m > n:  # a unit by itself
            cuts = list(range(n))
            break
    out = []
    for k, i in enumerate(cuts):
        j = cuts[k + 1] if k + 1 < len(cuts) else n
        b = back(i) if i else 0
        out.append((edge[b], edge[i], edge[j], cost(i, j)[0], units[i][3]))
    return out


def split_rows(df: DataFrame, id_col: str, text_col: str = "text", max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every row over a limit: id, ``piece_no``, ``n_pieces``, places, sizes, boundary strength and ``piece``."""
    src = df.where(over_limit(F.col(text_col), max_tokens, max_chars)).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = dict(src.dtypes)["id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 200):
                out = []
                for i, t in zip(pdf["id"].iloc[lo : lo + 200], pdf["t"].iloc[lo : lo + 200]):
                    ps = split_text(t, max_tokens, max_chars, overlap)
                    out += [(i, k, len(ps), a, own, z, tok, z - a, s, t[a:z]) for k, (a, own, z, tok, s) in enumerate(ps)]
                yield pd.DataFrame(out, columns=["id", "piece_no", "n_pieces", "start", "own_start", "stop", "n_tokens", "n_chars", "boundary", "piece"])

    out = src.mapInPandas(run, f"id {kind}, piece_no int, n_pieces int, start long, own_start long, stop long, n_tokens int, n_chars int, boundary int, piece string")
    return out.withColumnRenamed("id", id_col)
