import random

import numpy as np
import pytest

from evalweave.llm import leakage as L

RNG = random.Random(5)
VOCAB = [f"w{i}" for i in range(300)]
ITEMS = [(i, "passage", " ".join(RNG.choices(VOCAB, k=60)) + f" Name{i} town") for i in range(40)] + [(100 + i, "question", " ".join(RNG.choices(VOCAB, k=20))) for i in range(10)] + [(900, "passage", None), (901, "question", "")]


@pytest.mark.parametrize("cells", [1 << 23, 16])  # ranges of one item, and of several, in which WAND runs
def test_wand_finds_what_a_full_scan_finds(monkeypatch, cells):
    monkeypatch.setattr(L, "MAX_CELLS", cells)
    ix = L.ItemIndex(ITEMS)
    assert (ix.width > 1) == (cells == 16)
    for _ in range(200):
        q = {ix.vocab[w] for w in RNG.choices(VOCAB, k=RNG.randint(1, 60)) if w in ix.vocab}
        full = np.zeros(len(ix.ids))
        for t in q:
            for x, v in zip(ix.docs[t], ix.imps[t]):
                full[x] += v
        for theta in (0.05, 0.15, 0.3):
            got = dict(ix.search(list(q), theta))
            want = {i: full[i] for i in range(len(full)) if full[i] >= theta}
            assert {k for k in want if want[k] > theta + 1e-9} <= got.keys() <= {i for i in range(len(full)) if full[i] > theta - 1e-5}


def test_whole_partial_noisy_and_decoys(make):
    item = ITEMS[3][2]
    w = item.split()
    noisy = " ".join(x.upper() if i % 2 else x for i, x in enumerate(w) if i % 11)
    rest = " ".join(RNG.choices([f"z{i}" for i in range(500)], k=400))
    docs = [
        (1, f"{rest} <b>{item}</b> {rest}"),
        (2, f"{rest}\n{noisy},\n{rest}"),
        (3, rest + " " + " ".join(w[:16]) + " " + rest + " " + " ".join(w[30:46])),
        (4, rest + " " + " ".join(w[:12]) + " " + rest),
        (5, rest),
        (6, None),
        (7, ""),
        (8, " ".join(reversed(w))),
        (9, ITEMS[44][2].replace(" ", "  ")),
        (10, " ".join(ITEMS[44][2].split()[:12])),
        (1, f"{rest} <b>{item}</b> {rest}"),
    ]
    d = make("doc_id long, text string, item_id int", *[(*x, 0) for x in docs])
    it = make("item_id long, item_kind string, text string", *ITEMS)
    got = {(r.doc_id, r.item_id) for r in L.find_leaks(d, it).collect()}
    assert got == {(1, 3), (2, 3), (3, 3), (9, 104)}
    assert got == {(r.doc_id, r.item_id) for r in L.find_leaks(d, it, shard_words=900).collect()}


def test_recall_against_a_full_scan(make):
    rng = random.Random(8)
    docs = []
    for i in range(120):
        t = [f"z{rng.randrange(500)}" for _ in range(rng.randint(50, 300))]
        item = rng.choice(ITEMS[:50])[2].split()
        part = item[rng.randint(0, 20) :] if rng.random() < 0.5 else item[: rng.randint(20, 60)]
        noisy = [x for x in part if rng.random() > 0.1]
        at = rng.randrange(len(t))
        docs.append((i, " ".join(t[:at] + noisy + t[at:])))
    r = L.recall_of_search(make("doc_id long, text string", *docs), make("item_id long, item_kind string, text string", *ITEMS)).first()
    assert r.n_pairs > 60 and r.recall >= 0.99


def test_empty_tables(make):
    d, it = make("doc_id long, text string", (1, "a b c")), make("item_id long, item_kind string, text string")
    assert L.find_leaks(d, it).count() == 0
    assert L.find_leaks(d.where("false"), make("item_id long, item_kind string, text string", *ITEMS[:2])).count() == 0


def test_very_long_text(make):
    long = " ".join(RNG.choices([f"z{i}" for i in range(500)], k=60_000))
    d = make("doc_id long, text string", (1, long + " " + ITEMS[0][2]))
    assert L.find_leaks(d, make("item_id long, item_kind string, text string", *ITEMS)).first().item_id == 0


def test_long_items_and_altered_passages(make):
    item = [f"v{i}" for i in range(1200)]
    short = [f"s{i}" for i in range(100)]
    rest = [f"z{i}" for i in range(300)]
    altered = [x if i % 3 else f"y{i}" for i, x in enumerate(short[:43])]
    docs = [(1, " ".join(rest + item + rest)), (2, " ".join(rest + item[300:800] + rest)), (3, " ".join(item[:200] + rest)), (4, " ".join(rest + altered + rest)), (5, " ".join(rest))]
    it = make("item_id long, item_kind string, text string", (1, "passage", " ".join(item)), (2, "passage", " ".join(short)))
    got = {(r.doc_id, r.item_id) for r in L.find_leaks(make("doc_id long, text string", *docs), it).collect()}
    assert got == {(1, 1), (2, 1), (4, 2)}
