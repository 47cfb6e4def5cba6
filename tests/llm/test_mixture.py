import numpy as np
import pytest

from evalweave.llm import mixture as M

D = "doc_id long, text string, source string, position string"
W = "source string, target_share double, max_repeats int"


def test_quotas():
    q = M.fill_quotas({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 100.0, "b": 1e9, "c": 0.0}, 1000.0)
    assert q == {"a": 100.0, "b": pytest.approx(900.0), "c": 0.0}
    assert sum(M.fill_quotas({"a": 0.5, "b": 0.5}, {"a": 10.0, "b": 20.0}, 1000.0).values()) == 30.0
    assert M.fill_quotas({}, {}, 10.0) == {}


def test_default_total():
    w, r = {"a": 0.9, "b": 0.1, "gone": 0.5}, {"a": 1, "b": 2, "gone": 1}
    assert M.default_total(w, {"a": 1000, "b": 30, "gone": 0}, r) == 600  # b's 60 tokens are a tenth
    assert M.default_total(w, {"a": 1000, "b": 1, "gone": 0}, r) == 500  # half of what there is; b is capped
    assert M.default_total(w, {"a": 1000, "b": 900, "gone": 0}, r) == 1111  # all of a
    assert M.default_total({}, {}, {}) == 0


def test_tree_is_exact_and_even():
    q = np.array([1000, 37, 5, 0])
    for shards in (1, 7, 16):
        t = M.split_tree(q, shards, np.random.default_rng(1))
        assert (t.sum(0) == q).all() and (t >= 0).all() and t.sum(1).max() - t.sum(1).min() <= 1
    share = M.split_tree(q, 16, np.random.default_rng(1))[:, 0]
    assert share.std() > 0  # drawn, not dealt


def test_uses_are_placed_as_the_tree_says(spark, monkeypatch):
    monkeypatch.setattr(M, "FAN", 4)  # shards beyond the fan are split where their blocks are placed
    n = {"a": 500, "b": 37, "c": 0}
    rows = [(s, i) for s in n for i in range(n[s])]
    uses = spark.createDataFrame(rows, "source string, _use long")
    for shards in (1, 3, 11):
        got = M.place_uses(uses.repartition(3), list(n), list(n.values()), shards, 5).toPandas()
        sizes = got.groupby("shard").size()
        assert len(got) == 537 and len(sizes) == shards and sizes.max() - sizes.min() <= 2
        assert sorted(map(tuple, got.values)) == sorted(map(tuple, M.place_uses(uses, list(n), list(n.values()), shards, 5).toPandas().values))


def test_vocabularies_agree():
    if not M.Path(M.TOKENIZER).exists():
        pytest.skip("no vocabulary")
    texts = ["Plain words, and 12,345 numbers.", "naïve café — 漢字", " \n\n  x", "<|endoftext|>"]
    ranks = M.token_counter(M.Path(M.TOKENIZER).read_bytes(), ".tiktoken")(texts)
    assert ranks == M.token_counter(M.Path(M.TOKENIZER).with_suffix(".json").read_bytes(), ".json")(texts)


@pytest.fixture
def docs(make):
    rows = [(i, f"some words of text number {i} " * (1 + i % 5), "Web-Crawl " if i % 2 else "web_crawl", "x") for i in range(600)]
    rows += [(1000 + i, f"a small source {i} speaks " * 3, "lab notes", "x") for i in range(60)] + [(2000, None, "lab_notes", "x"), (2001, "", "lab_notes", "x"), (2002, "text", None, "x"), (2003, "text", "unlisted", "x"), (1000, "a small source 0 speaks " * 3, "lab notes", "x")]
    return make(D, *rows)


def test_mixture(docs, make):
    w = make(W, ("web_crawl", 0.5, 1), ("lab_notes", 0.3, 3), ("newswire", 0.2, 2))
    mix, rep = M.mix_sources(docs, w, total_tokens=4000, shards=4, block_tokens=100)
    m, r = mix.toPandas(), {x.source: x for x in rep.collect()}
    assert set(m.source) == {"web_crawl", "lab_notes"} and r["newswire"].actual_share == 0 and r["newswire"].capped
    got = m.groupby("source").n_tokens.sum()
    assert got["web_crawl"] == r["web_crawl"].mixed_tokens and abs(got.sum() - 4000) < 60
    assert r["web_crawl"].actual_share == pytest.approx(0.5 / 0.8, abs=0.02) and r["lab_notes"].actual_share == pytest.approx(0.3 / 0.8, abs=0.02)
    uses = m.groupby(["source", "doc_id"]).copy_no.nunique()
    assert uses["web_crawl"].max() == 1 and uses["lab_notes"].max() <= 3
    assert sorted(m.shard.unique()) == [0, 1, 2, 3] and all(sorted(g.position) == list(range(1, len(g) + 1)) for _, g in m.groupby("shard"))
    again = M.mix_sources(docs.repartition(5), w, total_tokens=4000, shards=4, block_tokens=100)[0].toPandas()
    key = ["doc_id", "copy_no", "shard", "position"]
    assert sorted(map(tuple, m[key].values)) == sorted(map(tuple, again[key].values))


def test_cap_is_kept_when_everything_is_used(docs, make):
    mix, rep = M.mix_sources(docs, make(W, ("lab_notes", 1.0, 2)), total_tokens=10**9, shards=2)
    r = rep.first()
    assert r.mixed_tokens == 2 * r.available_tokens and r.capped and mix.count() == 2 * 61


def test_empty_tables(docs, make):
    mix, rep = M.mix_sources(docs, make(W))
    assert mix.count() == 0 and rep.count() == 0
    mix, rep = M.mix_sources(docs.where("false"), make(W, ("web_crawl", 1.0, 1)))
    assert mix.count() == 0 and rep.first().actual_share == 0
