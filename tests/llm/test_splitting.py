import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalweave.llm import splitting as S


def check(text, max_tokens, max_chars, overlap):
    ps = S.split_text(text, max_tokens, max_chars, overlap)
    if len(ps) == 1:
        assert ps[0][:3] == (0, 0, len(text)) and len(text) <= max_chars and ps[0][3] <= max_tokens
        return ps
    assert "".join(text[a:b] for a, b in zip([p[1] for p in ps], [p[1] for p in ps[1:]] + [len(text)])) == text
    for k, (start, own, stop, tokens, _) in enumerate(ps):
        piece = text[start:stop]
        assert len(piece) <= max_chars and len(S.TOKEN.findall(piece)) == tokens <= max_tokens
        assert start <= own < stop and stop == (ps[k + 1][1] if k + 1 < len(ps) else len(text))
        if k:
            shared = len(S.TOKEN.findall(text[start:own]))
            assert shared <= overlap
            if all(len(t) < 20 for t in S.TOKEN.findall(text)) and max_chars >= 30 * max_tokens:
                assert shared == min(overlap, max_tokens // 2)
    return ps


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n ,é́漢!。、", max_size=900), st.integers(2, 40), st.integers(12, 200), st.integers(0, 8))
def test_round_trip_and_limits(text, max_tokens, max_chars, overlap):
    check(text, max_tokens, max_chars, overlap)


def test_cuts_at_strong_boundaries():
    para = "Short words stand here in one line. " * 10
    text = "\n\n".join([para.strip()] * 12)
    ps = check(text, 100, 10_000, 10)
    assert all(p[4] >= 3 for p in ps[1:])
    sizes = [p[3] for p in ps]
    assert max(sizes) - min(sizes) < 60  # balanced


def test_text_without_blanks_and_very_long():
    check("漢" * 9000, 384, 2600, 32)
    ps = check("図書館は毎週日曜に開きます。" * 700, 384, 2600, 32)
    assert all(p[4] == 3 for p in ps[1:])  # cut after a full stop, though no blank follows
    ps = check("word " * 200_000, 384, 2600, 32)
    assert 568 <= len(ps) < 580


def test_white_space_over_the_limit():
    for text in (" " * 3000, "a" + " " * 3000, " " * 3000 + "a", "a" + "\n" * 9000 + "b c " * 400, "\u3000" * 2601):
        assert len(check(text, 384, 2600, 32)) > 1


def test_token_count_like_the_definition(make):
    texts = ["a b c", "a b", "  x  ", "", None, "a\x1cb", "x　y z"]
    df = make("i int, t string", *enumerate(texts))
    got = {r.i: r.n for r in df.select("i", S.token_count(F.col("t")).alias("n")).collect()}
    assert got == {i: (None if t is None else len(re.findall(S.TOKEN, t))) for i, t in enumerate(texts)}


def test_rows(make):
    big, edge = "word " * 385, "word " * 384
    rows = [(1, big, 7), (1, big, 7), (2, edge, 7), (3, None, 7), (4, "", 7), (5, "x" * 2600, 7), (6, "x" * 2601, 7), (7, "a" + " " * 3000, 7)]
    df = make("load_id long, text string, piece int", *rows)
    got = S.split_rows(df, "load_id").collect()
    assert {r.load_id for r in got if r.n_pieces > 1} == {1, 6, 7} and len([r for r in got if r.load_id == 1]) == 4
    assert S.split_rows(df.where("false"), "load_id").count() == 0
