"""Words of a value, and values that hold none."""

from __future__ import annotations

import html
import re

WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"<[^<>]{0,200}>")
# What stands in for an answer that was never made.
PLACEHOLDERS = set("answer|a|none|null|nil|nan|n a|na|no output|no content|empty|undefined|tbd|todo|output|response|placeholder|insert answer here|your answer here|blank".split("|"))



def tokens(text: str) -> list[str]:
    return WORD.findall(re.sub(r"(?<=\w)['’‘](?=\w)", "", text.casefold()))


def bare(answer: str) -> str:
    """The answer without tags, entities and zero-width characters."""
    t = TAG.sub(" ", html.unescape(answer))
    return re.sub("[​‌‍⁠﻿­]", "", t)


def is_empty(answer: str | None) -> bool:
    if answer is None or not answer.strip():
        return True
    if "<" not in answer and "&" not in answer and len(tokens(bare(answer[:100]))) > 4:
        return False  # what follows takes no word away
    toks = tokens(bare(answer))
    return not toks or len(toks) <= 4 and " ".join(toks) in PLACEHOLDERS and not (len(toks) == 1 and re.fullmatch(r"[^\W\d_]", answer.strip()))
