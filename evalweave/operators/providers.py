"""Models behind a small interface, loaded once per task, with offline defaults.

The defaults are deterministic stand-ins so that whole pipelines run without a
network; they are not models of comparable quality.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np


class Embedder(Protocol):
    dim: int

    def load(self) -> Callable[[Sequence[str]], np.ndarray]: ...


class Scorer(Protocol):
    def load(self) -> Callable[[Sequence[str], Sequence[str]], Sequence[float]]: ...


class Writer(Protocol):
    """Generator or judge: prompts to (text, tokens in, tokens out, milliseconds)."""

    def load(self) -> Callable[[Sequence[str]], Sequence[tuple[str, int, int, float]]]: ...


class Critic(Protocol):
    """What answer-quality metrics ask of a model: statements of an answer, verdicts (0 or 1) on text pairs, questions an answer would suit (with a mark for evasion)."""

    def load(self) -> tuple[Callable[[str], list[str]], Callable[[str, str], int], Callable[[str], list[tuple[str, int]]]]: ...


class HashedWords:
    """Counts of lower-case words in ``dim`` buckets of their md5."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def load(self) -> Callable[[Sequence[str]], np.ndarray]:
        dim, seen = self.dim, {}

        def bucket(w: str) -> int:
            b = seen.get(w)
            if b is None:
                if len(seen) > 200_000:
                    seen.clear()
                b = seen[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim
            return b

        def embed(texts: Sequence[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for i, t in enumerate(texts):
                for w in (t or "").lower().split():
                    out[i, bucket(w)] += 1.0
            return out

        return embed


class WordOverlap:
    """Share of the distinct query words that the passage holds."""

    def load(self) -> Callable[[Sequence[str], Sequence[str]], Sequence[float]]:
        def score(queries: Sequence[str], passages: Sequence[str]) -> list[float]:
            out = []
            for q, p in zip(queries, passages):
                words = set((q or "").lower().split())
                out.append(len(words & set((p or "").lower().split())) / len(words) if words else 0.0)
            return out

        return score


class FirstSentence:
    """Answers with the first sentence after the context mark of the prompt."""

    def load(self) -> Callable[[Sequence[str]], Sequence[tuple[str, int, int, float]]]:
        def write(prompts: Sequence[str]) -> list[tuple[str, int, int, float]]:
            out = []
            for p in prompts:
                body = p.partition("[1] ")[2]
                end = min((i for i in (body.find(x) for x in (". ", ".\n", "\n")) if i >= 0), default=len(body) - 1)
                a = body[: end + 1].strip()
                out.append((a, len(p) // 4, len(a) // 4, 0.0))
            return out

        return write


def _shared(a: str, b: str) -> float:
    words = set(re.findall(r"\w{3,}", (a or "").lower()))
    return len(words & set(re.findall(r"\w{3,}", (b or "").lower()))) / len(words) if words else 0.0


class OverlapJudge:
    """Replies to the judge's prompt with marks by shared words: question in context, answer in context, question in answer."""

    def load(self) -> Callable[[Sequence[str]], Sequence[tuple[str, int, int, float]]]:
        def judge(prompts: Sequence[str]) -> list[tuple[str, int, int, float]]:
            out = []
            for p in prompts:
                question, _, rest = p.partition("Question: ")[2].partition("\nContext: ")
                context, _, rest = rest.partition("\nAnswer: ")
                answer = rest.rpartition("\n\nCriteria:")[0]
                marks = {"context_relevance": int(_shared(question, context) >= 0.5), "answer_faithfulness": int(_shared(answer, context) >= 0.7), "answer_relevance": int(_shared(question, answer) >= 0.3)}
                reply = json.dumps(marks)
                out.append((reply, len(p) // 4, len(reply) // 4, 0.0))
            return out

        return judge


class OverlapCritic:
    """Sentences as statements, shared words as verdicts, the answer's own words as the question it suits; short answers count as evasive."""

    def load(self) -> tuple[Callable[[str], list[str]], Callable[[str, str], int], Callable[[str], list[tuple[str, int]]]]:
        def statements(answer: str) -> list[str]:
            return [x for x in re.split(r"(?<=[.!?])\s+", (answer or "").strip()) if x]

        return statements, lambda a, b: int(_shared(a, b) >= 0.5), lambda answer: [(answer or "", int(len((answer or "").split()) < 2))]
