import numpy as np
import pytest
from pyspark.sql import functions as F

from evalweave.functions import text as T
from evalweave.operators import chunking, generation, judging
from evalweave.operators.providers import HashedWords

DOC = "doc_id string, text string, extra string"


def test_tokens_like_python_split(make):
    texts = ["", "  a\tb\n c ", "x y z", "a\x1cb", None, "　lead"]
    df = make("i int, t string", *enumerate(texts))
    got = {r.i: r.v for r in df.select("i", T.tokens(F.col("t")).alias("v")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (t or "").split()


def test_fixed_and_sliding_counts(make):
    words = [f"{x}-{y}" for y in range(70) for x in "abcdefghij"]
    text = "\n".join(words)
    df = make(DOC, ("d", text, "k"), ("e", None, "k"), ("f", "  ", "k"))
    fixed = {r.chunk_id: r for r in chunking.chunk_fixed(df, 256, keep=["extra"]).collect()}
    assert sorted(fixed) == ["d::c0", "d::c1", "d::c2"]
    assert fixed["d::c0"].text == " ".join(words[:256]) and fixed["d::c0"].extra == "k"
    assert chunking.chunk_sliding(df, 256, 64).count() == 4


def test_packed_sentences(make):
    df = make(DOC, ("d", "Rain fell! Who saw it? Nobody near did. " * 40, ""), ("e", "word " * 80 + "end. Next.", ""))
    got = chunking.chunk_packed(df, 50).collect()
    assert all(len(r.text.split()) <= 50 for r in got if r.doc_id == "d")
    long = sorted((r.chunk_ix, r.text) for r in got if r.doc_id == "e")
    assert len(long) == 2 and long[1][1] == "Next."  # a long sentence stays whole


def test_semantic_against_plain_python(make):
    texts = ["The cat sat. The cat slept. Quantum fields differ! Quantum fields vary. ", "One.", "", None]
    df = make(DOC, *[(f"d{i}", t, "") for i, t in enumerate(texts)])
    got = {r.chunk_id: r.text for r in chunking.chunk_semantic(df, HashedWords(), 8, 0.4).collect()}
    assert got["d1::c0"] == "One." and not any(k.startswith(("d2", "d3")) for k in got)
    assert " ".join(got[k] for k in sorted(got) if k.startswith("d0")) == texts[0].strip()
    assert len([k for k in got if k.startswith("d0")]) == 2


def similarity_brute(vecs, sizes, limit, threshold):
    """Whether each sentence opens a chunk, asked of it alone."""
    starts = [0]
    for i in range(1, len(vecs)):
        mine = vecs[starts[-1] : i].sum(0)
        if sum(sizes[starts[-1] : i + 1]) > limit or mine @ vecs[i] / np.linalg.norm(mine) < threshold:
            starts.append(i)
    return starts


def test_similarity_starts():
    rng = np.random.default_rng(3)
    for n in [*range(1, 12), 300]:
        vecs = rng.random((n, 5)) ** 3
        vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
        sizes = rng.integers(1, 30, n)
        for limit, threshold in ((60, 0.7), (5, 0.5), (10_000, 0.0), (10_000, 0.95)):
            assert chunking.similarity_starts(vecs, sizes, limit, threshold) == similarity_brute(vecs, sizes, limit, threshold)


def test_prompt_and_cost(make):
    df = make("q string, c array<string>", ("why", ["a", "b"]), (None, None))
    rows = df.select(generation.prompt(F.col("q"), F.col("c")).alias("p")).collect()
    assert "[1] a\n\n[2] b\n\nQuestion: why" in rows[0].p and rows[1].p.endswith("Answer:")
    cost = df.select(generation.cost_eur(F.lit(1000), F.lit(200)).alias("c")).first().c
    assert cost == pytest.approx(0.0002484)


def test_judge_replies(make):
    replies = ['{"context_relevance":1,"answer_faithfulness":0}', 'so: {"answer_relevance": true} ok', "{bad", "", None, '{"context_relevance": "1.0", "answer_relevance": null}']
    df = make("i int, r string", *enumerate(replies))
    got = {r.i: tuple(r)[1:] for r in df.select("i", *[c.alias(d) for d, c in judging.parse_reply(F.col("r")).items()]).collect()}
    assert got == {0: (1, 0, 0), 1: (0, 0, 1), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0), 5: (1, 0, 0)}


def test_generate_asks_once_and_uses_the_cache(make):
    from evalweave.operators.providers import FirstSentence

    req = make("query_id string, question string, contexts array<string>", ("1", "q", ["Yes it is. More."]), ("2", "q", ["Yes it is. More."]), ("3", "other", []))
    rows, made = generation.generate(req, None, FirstSentence())
    assert made.count() == 2 and {r.answer for r in rows.where("query_id < '3'").collect()} == {"Yes it is."}
    again, made2 = generation.generate(req, made, FirstSentence())
    assert made2.count() == 0 and all(r.cached for r in again.collect())
