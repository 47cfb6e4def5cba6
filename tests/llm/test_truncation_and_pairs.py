import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from samples import sentence, text  # noqa: E402

from evalweave.llm import langid, pairs, truncation  # noqa: E402

Q = {"en": "who opens the shop before breakfast", "de": "wer öffnet den Laden vor dem Frühstück"}


@pytest.fixture(scope="module")
def lm():
    rng = random.Random(1)
    tr = [(sentence(x, rng), i) for i, x in enumerate(langid.LANGS) for _ in range(60)]
    return langid.fit([t for t, _ in tr], np.array([i for _, i in tr]))


def cases(n, seed):
    """(text, tokens, is cut): whole answers, and answers cut at a random place, some with debris."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = text("en", rng.randint(2, 6), rng)
        tokens = float(max(1, round(len(t) / 4 * rng.uniform(0.9, 1.0)))) if rng.random() < 0.8 else None
        if i % 3:
            out.append((t if rng.random() < 0.7 else t[:-1], tokens, False))
        else:
            at = rng.randint(30, len(t) - 12)
            while t[at - 1] in ". " or t[at] in ".":
                at += 1
            out.append((t[:at] + rng.choice(["", "", "…", " [...]", "\\"]), tokens, True))
    return out


@pytest.fixture(scope="module")
def em():
    return truncation.EndModel().fit([(t, k, "en") for t, k, _ in cases(1500, 7)])


def test_held_out_truncation(em):
    got = [(em.is_cut(t, k, "en"), cut) for t, k, cut in cases(600, 8)]
    tp = sum(a and b for a, b in got)
    assert tp / sum(b for _, b in got) > 0.95 and tp / max(1, sum(a for a, _ in got)) > 0.95


def test_peel():
    assert truncation.peel("It ends. [2]")[3] and truncation.peel("It ends.”")[3]
    assert truncation.peel("the har [...]")[:2] == ("the har", True)
    assert not truncation.peel("on the road to")[3]


def test_limits_are_found():
    assert truncation.piles({512: 40, 511: 1, 100: 3, 101: 4, 5: 900}, 32) == {512}


def test_is_empty():
    for t in (None, "", " \n\t", "N/A", "null", "[no output]", "<p></p>", "—", "...", "{}", "Answer:", "**", "​", "-", "A:"):
        assert pairs.is_empty(t), t
    for t in ("No", "Yes.", "1880", "A", "x", "None of them do."):
        assert not pairs.is_empty(t), t


def test_is_copy():
    q = "Which town uses the old mill of Lunley?"
    for a in (q, q.upper(), f"**{q[:-1]}**", "Q: " + q + "\nA: " + q, q[:-1] + " " + q[:-1], "which town uses the this mill of Lunley", "Which, town uses the old mill of Lunley"):
        assert pairs.is_copy(q, a), a
    for a in ("The town of Arden uses the old mill of Lunley.", f"You asked: {q} The town of Arden does.", "Arden", "", "The old mill of Lunley is used by Arden since 1880"):
        assert not pairs.is_copy(q, a), a
    assert not pairs.is_copy("how many people visit the mill in Lunley each year", "About 75 people visit the mill in Lunley each year.")
    assert not pairs.is_copy(None, "x y z") and not pairs.is_copy("", "a b c")


def test_is_refusal():
    q = "How tall is the mill of Lunley?"
    for a in ("I don't know.", "Sorry, the texts never touch on Lunley. Try rephrasing the question.", "Je ne sais pas", "Having read all the passages, I would only be guessing, so I will leave this blank.", "I cannot find any information about this in the provided documents.", "This cannot be determined. Passage [1] is about Arden and the others are no closer."):
        assert pairs.is_refusal(q, a), a
    for a in ("The mill of Lunley is 44 metres tall.", '"I don\'t know who built it", a guide joked in 1890. The mill of Lunley is 3 metres tall.', "I cannot be fully certain, but passage [2] says: it is 4 metres tall.", "Sorry for the long wait - the mill is 4 metres tall.", "No", "The first passage does not mention it, yet the third does: It is 9 metres tall."):
        assert not pairs.is_refusal(q, a), a


# what assistants commonly reply; written after the word lists and not used to make them
HELD_OUT = """
I'm sorry, but the provided documents do not contain any information about that.
The context given does not specify when this happened.
Based on the provided context, it is not possible to determine the answer.
Unfortunately, I was unable to find an answer to your question in the sources.
There is no mention of this in any of the passages.
I don't have enough information to answer this question.
The text does not say.
Not mentioned in the context.
I cannot answer from the given context.
As an AI language model, I cannot provide this information.
None of the retrieved passages address the question.
Sorry, I can't help with this.
The documents lack the details needed to answer.
It is unclear from the passages.
Insufficient information.
No answer found.
Leider enthalten die Texte keine Angaben darüber.
Diese Frage kann ich mit den Quellen nicht beantworten.
Le contexte ne précise pas cette information.
Je suis désolé, je ne trouve pas la réponse dans les documents.
No encuentro la respuesta en el texto.
El documento no indica nada sobre esto.
Ik kan het antwoord niet vinden in de tekst.
De bronnen vermelden dit niet.
Não encontrei essa informação no texto.
O documento não indica isso.
Non ho trovato la risposta nel testo.
Il documento non indica questo.
В тексте нет ответа на этот вопрос.
Я не могу ответить на этот вопрос.
"""


def test_held_out_refusals():
    lines = HELD_OUT.strip().split("\n")
    missed = [x for x in lines if not pairs.is_refusal("How tall is the mill of Lunley?", x)]
    assert len(missed) <= 0.1 * len(lines), missed
    for a in ("The source of the river lies above Arden.", "It is not open on Mondays.", "The text was carved in oak by a monk.", "Nobody lives there, and the mill stands empty.", "No tickets are sold after dusk.", "Es gibt dort kein Museum mehr, nur eine Ruine."):
        assert not pairs.is_refusal("How tall is the mill of Lunley?", a), a


def test_long_copies_and_refusals():
    q = "Which town uses the old mill of Lunley?"
    near = "Which town uses the this mill of Lunley?"
    for a in (" ".join([q] * 9), "\n".join([q] * 3000), " ".join([near] * 40), q + " [2]", q + " [1, 3]", f"1. {q}\n2. {q}\n3. {q}", " ".join(f"{i + 1}) {q}" for i in range(12))):
        assert pairs.is_copy(q, a), a[:80]
    for a in (" ".join([q] * 9) + " The people of Arden have used it since the war.", " ".join([q] * 9) + " 75", q + " 75", f"2. {q}", "mill " * 200, " ".join(["Lunley of mill old the uses town which"] * 20)):
        assert not pairs.is_copy(q, a), a[:80]
    for a in ("I don't know. " * 100, "I do not know " * 200, "I have read through all of the passages that were given to me and I could not find any information that would help to answer the question about the mill."):
        assert pairs.is_refusal(q, a), a[:80]
    for a in ("I don't know. " * 100 + "The mill is tall and red.", "The farmers who lived below the hill did not sell grain to the abbey because the old miller kept a secret source of flour hidden under the floor of his barn near Arden."):
        assert not pairs.is_refusal(q, a), a[-80:]


def test_sound_pairs_are_not_aligned(monkeypatch):
    """Words are aligned only where enough of them are shared for it to matter, and sentences after the first that answers are not looked at."""
    q = "Which town uses the old mill of Lunley?"
    monkeypatch.setattr(pairs, "lcs", lambda a, b: pytest.fail(f"aligned: {a}"))
    for a in ("The town of Arden has kept it since 1880, and its people grind flour there. " + "I don't know. " * 50, "Arden lies above the river, so I guess no one there needs it."):
        assert not pairs.is_copy(q, a) and not pairs.is_refusal(q, a), a


def test_rows(make, lm, em):
    rng = random.Random(9)
    good = text("en", 3, rng)
    rows = [
        (1, Q["en"], None, 10, "S a"), (2, Q["en"], "n/a", None, "S a"), (3, Q["en"], Q["en"].title(), 8, "s_a"),
        (4, Q["en"], "I don't know.", 3, None), (5, Q["en"], good[:57], 200, "s-a"), (6, Q["en"], text("de", 3, rng), 40, " "),
        (7, Q["de"], text("de", 3, rng), 40, "s_a"), (8, Q["en"], good, len(good) // 4, "s_a"), (9, Q["en"], "Yes", 1, "s_a"), (10, None, good, len(good) // 4, "s_a"),
        (5, Q["en"], good[:57], 200, "s-a"), (11, Q["en"], "The baker " + good * 400, None, "s_a"), (12, "", "", 0, "s_a"),
    ]
    df = make("gen_id long, question string, answer string, tokens_out int, source string, defect string", *[(*r, "old") for r in rows])
    got = pairs.find_defects(df, lm, em, keep=("source",))
    by = {}
    for r in got.collect():
        by.setdefault(r.gen_id, []).append(r.defect)
    assert by == {1: ["empty"], 2: ["empty"], 3: ["copy"], 4: ["refusal"], 5: ["truncated"] * 2, 6: ["language"], 7: [None], 8: [None], 9: [None], 10: [None], 11: [None], 12: ["empty"]}
    from pyspark.sql import functions as F

    rep = {r.source: r for r in truncation.source_report(got.withColumn("truncated", F.coalesce(F.col("defect") == "truncated", F.lit(False)))).collect()}
    assert rep["s_a"].n_truncated == 2 and rep[None].n_values == 2 and set(rep) == {"s_a", None}
    alone = truncation.score_truncation(df, em, lm, "gen_id")
    assert {r.gen_id for r in alone.where("truncated").collect()} >= {5} and alone.where("gen_id = 8 and truncated").count() == 0


def test_empty_table(make, lm):
    df = make("gen_id long, question string, answer string, tokens_out int, source string")
    em = truncation.fit_end_model(df, lm)
    assert pairs.find_defects(df, lm, em).count() == 0


def test_fit_counts_every_value(make, lm):
    """Nothing is left out of a column of more than 5,000 values, and the cluster's model judges them as a fit of all of them here."""
    rows = [(f"{t[:-1]} {i % 7} times." if t.endswith(".") else f"{t} {i}", k) for i, (t, k, _) in enumerate(cases(6500, 21))]
    df = make("answer string, tokens_out double", *rows).repartition(3)
    got = truncation.fit_end_model(df, lm)
    times = {}
    for r in rows:
        times[r] = times.get(r, 0) + 1
    values = [(t, k, la, n) for ((t, k), n), la in zip(times.items(), truncation.main_langs([t for t, _ in times], lm))]
    want = truncation.EndModel().fit(values)
    want.caps, want.sizes = got.caps, got.sizes
    counted = [v for v in values if not truncation.held_out(v[0], v[3])]
    ends, often, ons = got.occurrences(counted)
    assert len(values) > 6000 and got.base == (often.sum(), len(ons))
    columns = [[v[i] for v in values[:500]] for i in range(3)]
    if not (got.caps or got.sizes):
        assert np.allclose(got.weights, want.weights, atol=1e-6) and np.allclose(got.log_odds_many(*columns), want.log_odds_many(*columns), atol=1e-6)


def test_defects_stand_on_a_fit_of_all_answers(spark, tmp_path):
    """The model that p5_found judges by has counted the places of every answer that is not held out."""
    from evalweave.llm import queries

    rows = [(i, t, float(i % 40 + 5)) for i, t in enumerate({f"{t} Row {i}." for i, (t, _, _) in enumerate(cases(5600, 31))})]
    spark.createDataFrame(rows, "gen_id long, answer string, tokens_out double").write.parquet(f"{tmp_path}/generation.parquet")
    rng = random.Random(5)
    spark.createDataFrame([(text(x, 3, rng), x) for x in ("en", "de") for _ in range(40)], "text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    _, em = queries._models(spark, str(tmp_path), spark.read.parquet(f"{tmp_path}/generation.parquet"))
    assert em.base[1] == len(em.occurrences([(t, k, "en", 1) for _, t, k in rows if not truncation.held_out(t, 1)])[2])


def test_contexts_are_those_of_single_places():
    t = "In 1990 Anna Maria Lund  moved to Old Town.\nThe Mill of Lunley\tstood Still. " * 3
    assert truncation.contexts(t, list(range(1, len(t)))) == [truncation.mask_tail(t[:i])[-24:] for i in range(1, len(t))]


def test_places_are_counted_as_chains_not_strings(monkeypatch):
    """Chains hold the contexts of all places at which texts go on, of odd texts too; no string is made for a place of any other."""
    rng = random.Random(4)
    odd = ["", "A", "Abc", "Ä.", "?", " x", "^ a^b", "a\0b", "Aa" + "b" * 50 + " C" + "d" * 60 + " e", "x" + " " * 80 + "y Z", "Abcdefghijklmnopqrstuvwxyzabc d", "In 1990 Anna Maria Lund  moved.\nThe Mill\tstood Still", "Жанна Д’Арк 😀 Ы"]
    cores = [t for t, _, _ in cases(200, 3)] + odd + ["".join(rng.choice(["a", "B", " ", "\n", ".", "7", " Lund", " Anna Maria", "é", "\u3000"]) for _ in range(rng.randint(1, 90))) for _ in range(400)]
    strings = [x for c in cores for x in truncation.contexts(c, [m.start() for m in truncation.INSIDE.finditer(c)])]
    asked = truncation.known_contexts(sorted(set(strings))[::2])
    want, got = truncation.Counts(asked), truncation.Counts(asked)
    want.add(truncation.Chains.of(strings))
    for some in truncation.going_on(cores):
        got.add(some)
    assert got.total == want.total and all((a == b).all() for a, b in zip(got.on, want.on)) and sum(map(sum, want.on)) > 10_000
    monkeypatch.setattr(truncation, "contexts", lambda core, places: pytest.fail("a context is written out"))
    assert sum(len(x.last) for x in truncation.going_on([t for t, _, _ in cases(200, 3)])) > 10_000


def test_the_n_gram_model_is_needed(em):
    """Where no count tells of the call, cuts are found by their final context; without its weight they are lost."""
    got = [(t, cut) for t, _, cut in cases(600, 11)]
    blind = truncation.EndModel()
    blind.__dict__ |= em.__dict__ | {"weights": em.weights * np.where(np.arange(len(em.weights)) == 1, 0, 1)}
    plain = [(t, c) for t, c in got if not truncation.peel(t)[1]]
    n = sum(c for _, c in plain)
    found = sum(em.is_cut(t, None, "en") and c for t, c in plain)
    false = sum(em.is_cut(t, None, "en") and not c for t, c in plain)
    without = max(sum((blind.log_odds(t, None, "en") > x) and c for t, c in plain) for x in (-1.0, 0.0, 1.0) if sum((blind.log_odds(t, None, "en") > x) and not c for t, c in plain) <= max(5, false))
    assert found > 0.9 * n and false < 0.05 * n and without < 0.5 * found


def test_placeholders_are_empty_not_cut(em):
    assert not any(em.is_cut(t, 90.0, "en") for t in ("N/A", "null", "Answer:", "</answer>", "[no output]", " ", None))
