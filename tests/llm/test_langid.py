import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from samples import sentence, text  # noqa: E402

from evalweave.llm import langid as L  # noqa: E402


def test_codewords_are_far_apart():
    c = L.codebook()
    assert c.shape == (8, 15) and all((c[i] != c[j]).sum() == 8 for i in range(8) for j in range(i))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    tr = [(sentence(x, rng), i) for i, x in enumerate(L.LANGS) for _ in range(60)]
    labels = np.array([i for _, i in tr])
    wrong = np.array([rng.randrange(8) if rng.random() < 0.2 else i for i in labels])  # noisy labels
    return L.fit([t for t, _ in tr], wrong)


def test_held_out_accuracy(model):
    rng = random.Random(2)
    held = [(sentence(x, rng), i) for i, x in enumerate(L.LANGS) for _ in range(40)]
    best, conf, _ = model.decode([t for t, _ in held])
    assert (best == np.array([i for _, i in held])).mean() > 0.97 and (conf <= 1).all()


def test_seed_words_alone_know_function_words():
    m = L.fit([], np.zeros(0, int))
    assert [L.LANGS[i] for i in m.decode(["which of the and that was", "и не на что это как для"])[0]] == ["en", "ru"]


def test_segments(model):
    rng = random.Random(3)
    t = text("en", 3, rng) + "\n" + text("fr", 2, rng) + " " + "Yes. " + text("en", 1, rng)
    segs = L.segment_texts([t, None, "", "12 34 !!", "Ok"], model)
    assert [s["lang"] for s in segs[0]] == ["en", "fr", "en"] and segs[1:4] == [[], [], []] and len(segs[4]) == 1
    assert sum(s["n_words"] for s in segs[0]) == len(t.split())


def test_labels(make):
    from pyspark.sql import functions as F

    names = {" EN ": "en", "en_GB": "en", "fr-CA": "fr", "German": "de", "dut": "nl", "sv": "other", "??": None, "": None, None: None, "und": None, "xx": None, "русский": "ru"}
    df = make("l string", *[(k,) for k in names])
    assert {r.l: r.v for r in df.select("l", L.label_column(F.col("l")).alias("v")).collect()} == names


def test_findings(make):
    rng = random.Random(4)
    rows = [(i, text(x, 4, rng), x, "e") for i, x in enumerate(L.LANGS * 20)]
    rows += [(900, text("de", 4, rng), "en", "e"), (901, text("es", 4, rng), None, "e"), (902, text("en", 4, rng) + " " + text("ru", 2, rng), "en", "e"), (903, "He called it 'à la carte'. " + text("en", 4, rng), "en-US", "e"), (904, None, "en", "e"), (905, "", None, "e"), (906, text("nl", 3, rng), "Dutch", "e"), (901, rows[0][1], "en", "e"), (907, text("it", 2, rng) * 300, "it", "e")]
    df = make("doc_id long, text string, lang string, finding string", *rows)
    got = {(r.doc_id, r.finding, r.lang) for r in L.label_findings(df).collect() if r.doc_id >= 900}
    assert got == {(900, "wrong", "de"), (901, "missing", "es"), (902, "mixed", "en"), (902, "mixed", "ru")}


def test_empty_table(make):
    assert L.label_findings(make("doc_id long, text string, lang string")).count() == 0


STOCK = ["This entry was last revised by the editors.", "Readers should check opening hours before they travel.", "All figures were rounded to whole numbers."]


def noisy_docs(rng, per_label, wrong, stock):
    """(text, label, all languages): as many documents of each label, a part of them English all the same; stock sentences in many English documents; some texts mixed."""
    out = []
    for label in L.LANGS:
        for _ in range(per_label):
            x = "en" if rng.random() < wrong else label
            parts = [text(x, rng.randint(1, 3), rng)] + ([rng.choice(STOCK)] if x == "en" and rng.random() < stock else [])
            langs = {x}
            if rng.random() < 0.1:
                other = rng.choice([y for y in L.LANGS if y != x])
                parts.append(text(other, 2, rng))
                langs.add(other)
            rng.shuffle(parts)
            out.append((" ".join(parts), label, langs))
    return out


def test_stock_sentences_stay_with_their_documents():
    held = noisy_docs(random.Random(99), 40, 0.3, 0.7)
    for seed in range(20):  # one fit for each sample of documents
        docs = noisy_docs(random.Random(seed), 30, 0.3, 0.7)
        sents = [(s, L.LANGS.index(lab), k) for k, (t, lab, _) in enumerate(docs) for _, s in L.sentences(t)]
        m = L.fit([s for s, _, _ in sents], np.array([x for _, x, _ in sents]), np.array([k for _, _, k in sents]))
        got = L.segment_texts([t for t, _, _ in held], m)
        found = [{s["lang"] for s in segs if not s["ambiguous"]} for segs in got]
        right = sum(f == langs for f, (_, _, langs) in zip(found, held))
        assert right >= 0.98 * len(held), (seed, right)


def test_lists_of_short_lines(model):
    rng = random.Random(5)
    halves = [f"{a} {b}" for a, b in zip(["Der Bäcker", "Unser Nachbar", "Die alte Lehrerin", "Ein junger Arzt"] * 2, ["öffnet", "liest", "wenn", "streicht"] * 2)]
    segs = L.segment_texts(["\n".join(halves), text("en", 3, rng) + "\n" + "\n".join(halves), "\n".join(["Ab", "Cd", "Ef"])], model)
    assert [s["lang"] for s in segs[0]] == ["de"] and [s["lang"] for s in segs[1]] == ["en", "de"] and len(segs[2]) == 1
    assert segs[0][0]["n_words"] == sum(len(x.split()) for x in halves)
