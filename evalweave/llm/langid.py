"""Problem 9: language of documents and of their single-language segments.

Method: error-correcting output codes.  Each of the eight languages has a
15-bit codeword (rows of a Hadamard matrix, pairwise distance 8).  One binary
character n-gram classifier (naive Bayes over hashed n-grams, classes weighted
equally) predicts each bit; a text is decoded to the codeword with the least
logistic loss over the bit margins, so that confident bits weigh more.  The
softmax over the negated losses is the confidence; a small lead over the second
codeword marks a sentence ambiguous: it then takes the language around it.

The bits are fitted on a bounded hash sample of labelled sentences
(``train_docs_per_label`` documents per label).  Labels are noisy, so the fit
repeats: predict the sample, keep what the model says (by document, at last by
sentence), fit again.

Defined results for odd input: null, blank and letterless texts yield no
segments and no findings; an unknown label counts as missing; texts are used
whole; repeated rows give repeated segments; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGS = ("en", "de", "fr", "es", "nl", "pt", "it", "ru")

# Names and codes of the languages (ISO 639-1, 639-2, English and own names).
LABELS = {
    "en": "en eng english",
    "de": "de ger deu german deutsch",
    "fr": "fr fre fra french français francais",
    "es": "es spa spanish español espanol castellano",
    "nl": "nl dut nld dutch nederlands flemish",
    "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano",
    "ru": "ru rus russian русский",
    "other": "sv swe swedish da dan danish no nor nb norwegian fi fin finnish pl pol polish cs ces czech tr tur turkish ar ara arabic zh zho chinese ja jpn japanese ko kor korean uk ukr ukrainian hu hun hungarian ro ron romanian el ell greek he heb hebrew hi hin hindi vi vie vietnamese ca cat catalan",
}
# Function words, so that a language with few labelled rows is known too.
SEED_WORDS = {
    "en": "the of and to in is was that for with as on are by this be at from which who how what where when why does many",
    "de": "der die das und ist nicht von mit dem den ein eine auf für wie was wer wo wann warum wurde viele nach aus sich",
    "fr": "le la les des et est une dans pour que qui sur pas avec au du quand où pourquoi comment combien quel ce il par",
    "es": "el la los las de y es una en por que con para se del cuándo dónde quién cómo cuántas qué al su como pero",
    "nl": "de het een en van is in op te dat met voor zijn niet aan er hoe wie wat waar wanneer waarom hoeveel werd door naar",
    "pt": "o a os as de e é uma em não que com para do da no na quando onde quem como quantas por ao mais foi",
    "it": "il lo la gli le di e è una che non per con del della nel dove quando chi come quante perché da sono si al",
    "ru": "и в не на что с по это как из у за от к для где когда почему кто сколько был город было его или",
}
BITS = 15
ORDERS = (1, 2, 3, 4)
TABLE = 1 << 17
BLOCK = 8192  # characters that are scored at once, at least a text
SCALE = 0.25
UNSURE = 0.6  # confidence below which the second codeword is close
TAG = re.compile(r"<[^<>]{0,200}>")
URL = re.compile(r"\b(?:https?://|www\.)\S+|\b\w+(?:\.\w+)*\.example\S*")
SENT = re.compile(r"(?<=[.!?…])[\"'”’»)\]*_]*\s+|\n+|(?<=[;])\s+")
LETTER = re.compile(r"[^\W\d_]")


def codebook() -> np.ndarray:
    """8 x 15 matrix of -1/1: rows 1..8 of the order-16 Hadamard matrix without its constant column."""
    h = np.array([[1]])
    while len(h) < 16:
        h = np.block([[h, h], [h, -h]])
    return h[1:9, 1:].astype(np.float32)


def label_column(col):
    """Language code named by a label column; 'other' for a known language outside LANGS; null if it names none."""
    base = F.lower(F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), r"^[\s\p{IsWhite_Space}]+|[\s\p{IsWhite_Space}]+$", ""))
    head = F.regexp_extract(base, r"^(\p{L}+)", 1)
    pairs = [F.lit(x) for code, names in LABELS.items() for name in names.split() for x in (name, code)]
    return F.create_map(*pairs)[head]


def _plain(text: str) -> str:
    return URL.sub(" ", TAG.sub(" ", html.unescape(text)))


def sentences(text: str) -> list[tuple[int, str]]:
    """(number of words, sentence) of a text; parts without letters are left out."""
    out = []
    for part in SENT.split(_plain(text)):
        if part and LETTER.search(part):
            out.append((len(part.split()), part))
    return out




def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts with a space around each, and where each starts."""
    clean = [" " + re.sub(r"[\W\d_]+", " ", t.lower()).strip() + " " for t in texts]
    lens = np.fromiter((len(t) for t in clean), np.int64, len(clean))
    if not clean:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes = np.frombuffer("".join(clean).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    return codes, np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)


def _grams(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each order n: hash of the n-gram that starts at each place (the last n-1 places wrap; they hold spaces)."""
    ahead = [codes if i == 0 else np.roll(codes, -i) for i in range(max(ORDERS))]
    for n in ORDERS:
        h = np.full(len(codes), n * 0x9E3779B97F4A7C15 & (2**64 - 1), np.uint64)
        for x in ahead[:n]:
            h ^= x
            h *= np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        yield (h >> np.uint64(47)).astype(np.int64) % TABLE


class EcocModel:
    """Bit weights (TABLE x BITS) and the codebook."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.code = codebook()

    def margins(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), BITS), np.float32)
        for lo in range(0, len(texts), 256):
            part = texts[lo : lo + 256]
            codes, starts = _codes(part)
            grams = list(_grams(codes))
            stops = np.append(starts[1:], len(codes))
            i = 0
            while i < len(part):  # some texts at a time, so that their rows stay in the cache
                j = max(i + 1, int(np.searchsorted(stops, starts[i] + BLOCK, "right")))
                a, b = starts[i], stops[j - 1]
                total = self.weights.take(grams[0][a:b], axis=0)
                for g in grams[1:]:
                    total += self.weights.take(g[a:b], axis=0)
                out[lo + i : lo + j] = np.add.reduceat(total, starts[i:j] - a, axis=0)
                i = j
        return out

    def decode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, confidence, and whether the second codeword is close, for each text."""
        if not texts:
            return np.zeros(0, int), np.zeros(0), np.zeros(0, bool)
        m = self.margins(texts) * SCALE
        n = np.array([max(4.0, len(t)) for t in texts], np.float32)[:, None]
        m = m / np.sqrt(n)  # evidence of neighbouring grams is dependent
        loss = np.logaddexp(0.0, -m[:, None, :] * self.code[None, :, :]).sum(-1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        conf = p[np.arange(len(p)), best]
        return best, conf, conf < UNSURE


def fit(texts: list[str], labels: np.ndarray, groups: np.ndarray | None = None, rounds: int = 3, alpha: float = 0.5) -> EcocModel:
    """Fit the bit classifiers on labelled sentences, relabelling them between the rounds.

    ``groups`` names the document of each sentence (by default each is its own).
    Between the rounds whole documents are relabelled, by the most words: a
    stock sentence that stands in many documents then stays with its documents,
    where single sentences alike could turn together.  Only before the last fit
    is every sentence relabelled by itself, for documents in several languages.
    """
    code = codebook()
    seeds = [SEED_WORDS[x] for x in LANGS]
    seed_of = np.arange(len(LANGS))
    texts = list(texts)
    labels = np.asarray(labels, int)
    groups = np.arange(len(texts)) if groups is None else np.unique(np.asarray(groups), return_inverse=True)[1]
    n_words = np.array([len(t.split()) for t in texts], float)
    grams = []  # per part: hashes of each order, owner of each place
    for part in (texts, seeds):
        codes, starts = _codes(part)
        owner = np.repeat(np.arange(len(part), dtype=np.int32), np.diff(np.append(starts, len(codes))))
        grams.append(([g.astype(np.int32) for g in _grams(codes)], owner))

    def tally(part: int, label: np.ndarray) -> np.ndarray:
        hashes, owner = grams[part]
        row = label[owner].astype(np.int64) * TABLE
        return sum(np.bincount(row + h, minlength=len(LANGS) * TABLE) for h in hashes).reshape(len(LANGS), TABLE).astype(np.float64)

    model = EcocModel(np.zeros((TABLE, BITS), np.float32))
    fixed = 2.0 * tally(1, seed_of)
    for r in range(rounds + 1):
        counts = fixed + (tally(0, labels) if len(texts) else 0.0)
        probs = (counts + alpha * 0.02) / (counts.sum(1, keepdims=True) + alpha * 0.02 * TABLE)
        w = np.zeros((TABLE, BITS), np.float32)
        for b in range(BITS):
            w[:, b] = np.log(probs[code[:, b] > 0].mean(0)) - np.log(probs[code[:, b] < 0].mean(0))
        w[counts.sum(0) == 0] = 0.0
        model = EcocModel(w)
        if r == rounds or not len(texts):
            break
        labels = model.decode(texts)[0]
        if r + 1 < rounds:
            votes = np.bincount(groups * len(LANGS) + labels, n_words, (groups.max() + 1) * len(LANGS)).reshape(-1, len(LANGS))
            labels = votes.argmax(1)[groups]
    return model


MIN_WORDS = 4  # shorter sentences take the language of their neighbour
SURE = 0.9  # confidence at which short lines in a row are a stretch of their own

SEGMENTS = "array<struct<lang:string,confidence:double,ambiguous:boolean,n_words:int,text:string>>"


def segment_texts(texts: list[str | None], model: EcocModel, min_words: int = MIN_WORDS) -> list[list[dict]]:
    """Single-language stretches of each text, in order.

    Short and ambiguous sentences do not open a stretch by themselves.  Such
    lines in a row (lists, tables, headings) are decoded together: they are a
    stretch if they are sure of their language, else they belong to what stands
    before them, or after them at the start.  A stretch is ambiguous if its
    mean confidence is low.
    """
    flat, owner, words = [], [], []
    for k, t in enumerate(texts):
        for n, s in sentences(t or ""):
            flat.append(s)
            owner.append(k)
            words.append(n)
    best, conf, amb = model.decode(flat)
    units: list[list] = []  # text number, first and past last sentence, language, confidence, decides
    for i, k in enumerate(owner):
        firm = words[i] >= min_words and not amb[i]
        if not firm and units and units[-1][0] == k and not units[-1][5]:
            units[-1][2] = i + 1
        else:
            units.append([k, i, i + 1, best[i], conf[i], firm])
    runs = [u for u in units if not u[5] and u[2] - u[1] > 1]
    if runs:
        b, c, _ = model.decode([" ".join(flat[u[1] : u[2]]) for u in runs])
        for u, x, y in zip(runs, b, c):
            u[3], u[4], u[5] = x, y, y >= SURE and sum(words[u[1] : u[2]]) >= 2 * min_words
    out: list[list[dict]] = [[] for _ in texts]
    for k, lo, hi, x, y, firm in units:
        segs, lang, n, text = out[k], LANGS[x], sum(words[lo:hi]), " ".join(flat[lo:hi])
        if segs and (not firm or segs[-1]["lang"] == lang or not segs[-1]["firm"]):
            last = segs[-1]
            if firm and not last["firm"]:
                last |= {"lang": lang, "confidence": 0.0, "weight": 0, "firm": True}
            if firm:
                last["confidence"] += y * n
                last["weight"] += n
            last["n_words"] += n
            last["text"] += " " + text
        else:
            segs.append({"lang": lang, "confidence": y * n, "weight": n, "n_words": n, "text": text, "firm": firm})
    for segs in out:
        for s in segs:
            s["confidence"] = float(s["confidence"] / max(1, s.pop("weight")))
            s["ambiguous"] = s["confidence"] < UNSURE
            s.pop("firm")
    return out


def fit_language_model(docs: DataFrame, text_col: str = "text", label_col: str = "lang", train_docs_per_label: int = 300, sentences_per_doc: int = 30) -> EcocModel:
    """Fit on about ``train_docs_per_label`` labelled rows of each language, chosen by hash.

    The sample is bounded by 8 x train_docs_per_label x sentences_per_doc
    sentences of at most 400 characters; with no labelled rows only the seed words speak.
    """
    rows = docs.select(F.col(text_col).alias("text"), label_column(F.col(label_col)).alias("label")).where(F.col("label").isin(*LANGS))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not n:
        return fit([], np.zeros(0, int))
    rate = F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(min(1.0, train_docs_per_label / v)))])
    sample = rows.withColumn("doc", F.xxhash64("text")).where(F.pmod("doc", F.lit(1_000_000)) < rate[F.col("label")] * 1_000_000)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            part = [(s[i : i + 400], lab, doc) for t, lab, doc in zip(pdf["text"], pdf["label"], pdf["doc"]) for _, s in sentences(t or "")[:sentences_per_doc] for i in range(0, min(len(s), 2000), 400)]
            yield pd.DataFrame(part, columns=["s", "label", "doc"])

    got = sample.mapInPandas(cut, "s string, label string, doc long").toPandas().sort_values(["doc", "s", "label"], kind="stable")
    return fit(got["s"].tolist(), np.array([LANGS.index(x) for x in got["label"]], int), got["doc"].to_numpy())


def document_languages(docs: DataFrame, model: EcocModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id, kept columns, main language (of most words), its confidence, and the segments.

    Rows without letters get a null language and no segments.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)])
    types = dict(src.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = EcocModel(weights.value)
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                segs = segment_texts([t if isinstance(t, str) else None for t in part["text"]], m)
                lang, conf = [], []
                for ss in segs:
                    words: dict[str, int] = {}
                    for s in ss:
                        words[s["lang"]] = words.get(s["lang"], 0) + s["n_words"]
                    main = max(words, key=lambda x: (words[x], x)) if words else None
                    lang.append(main)
                    conf.append(sum(s["confidence"] * s["n_words"] for s in ss if s["lang"] == main) / words[main] if main else None)
                res = part.drop(columns=["text"]).copy()
                res["main_lang"] = lang
                res["confidence"] = conf
                res["segments"] = segs
                yield res

    kept = "".join(f", k{i} {types[f'k{i}']}" for i in range(len(keep)))
    out = src.mapInPandas(run, f"id {types['id']}{kept}, main_lang string, confidence double, segments {SEGMENTS}")
    return out.select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], "main_lang", "confidence", "segments")


def label_findings(docs: DataFrame, model: EcocModel | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Rows (id, finding, lang): ``missing`` and ``wrong`` labels with the main language, ``mixed`` once per language of the text.

    Ambiguous stretches make no text mixed.
    """
    model = model or fit_language_model(docs, text_col, label_col)
    d = document_languages(docs.withColumn("_lab", label_column(F.col(label_col))), model, id_col, text_col, keep=("_lab",)).where("main_lang is not null")
    clear = F.transform(F.filter("segments", lambda s: ~s["ambiguous"]), lambda s: s["lang"])
    langs = F.sort_array(F.array_distinct(F.concat(clear, F.array("main_lang"))))
    label = F.when(F.col("_lab").isNull(), F.lit("missing")).when(F.col("_lab") != F.col("main_lang"), F.lit("wrong"))
    found = F.concat(
        F.when(label.isNotNull(), F.array(F.struct(label.alias("finding"), F.col("main_lang").alias("lang")))).otherwise(F.array()),
        F.when(F.size(langs) > 1, F.transform(langs, lambda x: F.struct(F.lit("mixed").alias("finding"), x.alias("lang")))).otherwise(F.array()),
    )
    return d.select(id_col, F.explode(found).alias("f")).select(id_col, "f.finding", "f.lang").distinct()
