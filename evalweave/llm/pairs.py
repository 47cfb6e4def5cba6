"""Problem 5: question-answer pairs that cannot be used, with the type of defect.

Method: the tokens of question and answer are aligned.  A copy is an answer
whose tokens the question explains (shingle containment of five words, or the
longest common subsequence where a word or two were changed) and that explains
the question.  A refusal is an answer each of whose sentences aligns with a
refusal template or is made of the words by which refusals deny, name the sources
and apologise.  Cut-off answers
come from the backward n-gram model of ``truncation``, answers in another
language from the output-code classifier of ``langid``, empty ones from what is
left without markup and placeholders.

The defects exclude each other and are tested in the order empty, copy,
refusal, truncated, language.  Defined results for odd input: a null answer is
empty; a null or blank question allows neither copy nor language; repeated rows
are judged alike, each for itself; texts are used whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.llm import langid, truncation
from evalweave.llm.values import WORD, bare, is_empty, tokens
from evalweave.session import received, share

DEFECTS = ("empty", "copy", "refusal", "truncated", "language")
WRAP = re.compile(r"^\s*(?:\{\s*\"?(?:answer|response|output|text)\"?\s*:\s*|\*{0,2}(?:answer|response|output|antwort|respuesta|réponse|resposta|risposta|antwoord|ответ)\s*:?\*{0,2}\s*:\s*)", re.I)
LABEL = re.compile(r"\b(?:q|a|question|answer|frage|antwort|pregunta|respuesta|vraag|antwoord|domanda|risposta|réponse|pergunta|resposta|вопрос|ответ)\s*:", re.I)
# Words of refusals, by language: denials; words of knowing and saying; words for the sources; plain words.
DENIALS = """
no not none nothing cannot cant couldnt dont doesnt didnt isnt arent wasnt wont wouldnt unable impossible unknown unclear insufficient lack lacks lacking missing without never neither nor silent beyond outside unrelated irrelevant other different elsewhere decline declined declining refuse refused
nicht kein keine keinen keiner keinerlei nichts nie ohne unmöglich unbekannt unklar
ne n pas rien aucun aucune sans jamais impossible inconnu inconnue
no nada ningún ninguna ninguno nunca sin imposible desconocido
niet geen niets niks nooit zonder onmogelijk onbekend onduidelijk
não nada nenhum nenhuma nunca sem impossível desconhecido
non nulla niente nessun nessuna nessuno mai senza impossibile sconosciuto
не нет ничего нельзя никаких никакой невозможно неизвестно без
"""
SAYING = """
answer answers answered answering say says said saying tell tells know knowing known knowledge find found finding determine determined help respond response reply comment resolve resolved establish established confirm verify information info details detail mention mentions mentioned cover covers covered state states stated address addresses addressed contain contains contained specify specified discuss discussed touch touches describe describes described evidence idea clue comply assist provide provides
weiß weiss wissen antwort antworten beantworten beantwortet sagen gesagt steht stehen erwähnt erwähnen nennt nennen auskunft information informationen angaben hinweis hinweise finden gefunden helfen bestimmen enthalten enthält
sais savoir réponse répondre dire disent dit mention mentionne mentionnent information informations figure figurent trouve trouver trouvé indique indiquent précise précisent aider déterminer
sé saber respuesta responder decir dicen dice menciona mencionan mención información encuentro encontrar encontrado indica indican figura consta ayudar determinar
weet weten antwoord antwoorden beantwoorden zeggen zegt gezegd staat staan vermeld vermelden vermeldt noemt noemen genoemd informatie vinden gevonden helpen bepalen
sei saber resposta responder dizer dizem diz menciona mencionam menção informação informações encontro encontrar encontrei indica indicam consta ajudar determinar
so sapere risposta rispondere dire dicono dice menziona menzionano parla parlano informazione informazioni trovo trovare trovato indica indicano aiutare determinare
знаю знать ответ ответа ответить сказать сказано говорится упоминается упоминает сведений информации данных найти нашёл нашел помочь определить
"""
SOURCES = """
text texts passage passages context contexts source sources document documents excerpt excerpts extract extracts material materials question request query snippet snippets article articles
text texte texten quelle quellen kontext abschnitt abschnitte abschnitten dokument dokumente dokumenten unterlagen frage passagen auszüge auszügen
texte textes source sources contexte document documents passage passages question extrait extraits
texto textos fuente fuentes contexto documento documentos pasaje pasajes pregunta fragmento fragmentos
tekst teksten bron bronnen context stuk stukken document documenten passage passages vraag fragment fragmenten
texto textos fonte fontes contexto documento documentos trecho trechos passagem passagens pergunta
testo testi fonte fonti contesto documento documenti brano brani passaggio passaggi domanda estratto estratti
текст тексте текстах тексты источник источники источниках контекст контексте документ документы документах документам вопрос отрывке отрывках
"""
PLAIN = """
a an the of to in on for from with by at as it its that this these those them they their which what who there here where when why how whether any all some one two three four five each every only just even so and or if be is are was were been being am has have had do does did can could would should will may might must me my i we us you your given shown provided supplied retrieved available needed able anything anywhere something either about among whole enough way possible use used hold holds come comes up go going gone through read reading having looked searched seen language model ai assistant rather better based im ive id ill its thats leave
ich es er sie das die der den dem des ein eine einen dazu darüber hierzu hier da in im mit mir aus auf zu zum zur über und ist sind kann konnte könnte habe haben hat wird werden diese diesen dieser dies vorliegenden von für nur
je j il elle le la les l un une des de du d ce ces cet cette cela sujet à au aux sur dans avec et est sont ai a peux peut pu puis pour me m que qu qui y en donc nous fournis
yo el la los las lo un una de del en con sobre esto eso esta este estos estas se puedo pude puede hay que por para y es son he ha ello al mi me tanto
ik het de een in deze dit dat die daar daarover hier over met op uit van en dus heb hebben is zijn kan kon er wordt om te voor mij
eu o a os as um uma de do da dos das em no na nos nas com sobre isso isto este estes esta estas disso se posso pode pude há que por para e é são foi me tanto
io il lo la i gli le un una di del della dei degli in nel nei con su questo questa questi queste ciò ho posso può ha è sono mi che per e quindi si da ne a al
я в о об на по к с и это этом этим эти этих этого мне могу можно у меня что для из есть быть был поэтому
"""
COURTESY = """
sorry unfortunately regrettably apologies apologise apologize afraid honest honestly frankly hmm please supply check try rephrase rephrasing share consult ask more another additional further again blank closer thank thanks
leider bedauerlicherweise entschuldigung bitte
désolé désolée malheureusement regrette pardon
siento lamento lamentablemente desafortunadamente perdón
helaas sorry excuses
lamento infelizmente desculpe
dispiace purtroppo scusa
сожалению извините простите
"""
# Sentences that refuse without a denial of knowledge.
REFUSALS = """
i can only guess
that would be guesswork
any reply would be pure speculation
i would have to make it up
it is unanswerable
that question stays open
the sources leave this open
answering would mean inventing something
i pass on this one
"""


def _words(text: str) -> set[str]:
    return set(text.split())


DENY, SAY, SOURCE, CIVIL = _words(DENIALS), _words(SAYING), _words(SOURCES), _words(COURTESY)
MUTE = _words(PLAIN) | DENY | SAY | SOURCE | CIVIL  # what a refusal is made of
GUESS = _words("guess guessing guesswork speculate speculation speculating unanswerable")
REFUSAL_TOKENS = [line.split() for line in REFUSALS.split("\n") if line]
# Words after which a sentence that begins as a refusal may still answer.
TURN = _words("but yet however though although nevertheless still instead except whereas while aber jedoch mais pourtant pero maar mas però ma но")
CITATION = re.compile(r"\[\d+(?:\s*[,;–-]\s*\d+)*\]")
NUMBERED = re.compile(r"(?:^|(?<=[\s.!?:;]))\(?(\d{1,4})[.)](?=\s+\S)")
SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n+|\s+[-–—]\s+|(?<=[.!?;])$")


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = diag = 0
        for j, y in enumerate(b, 1):
            up = row[j]
            left = row[j] = diag + 1 if x == y else (up if up > left else left)
            diag = up
    return row[-1]


def aligns(words: list[str], template: list[str]) -> bool:
    """Their longest common subsequence is three quarters of the template and most of the words."""
    least = max(0.75 * len(template), 0.65 * len(words))
    return least <= len(template) and sum(w in template for w in words) >= least and lcs(words, template) >= least


def unnumbered(text: str) -> str:
    """The text without citation marks, and without list numbers where they count up from 1."""
    t = CITATION.sub(" ", text)
    if (at := [int(x) for x in NUMBERED.findall(t)]) and at == list(range(1, len(at) + 1)):
        t = NUMBERED.sub(" ", t)
    return t


def repeats(q: list[str], a: list[str]) -> bool:
    """The answer is many repetitions of the question, each at most slightly changed: aligned with the question read in a circle, in time linear in the answer."""
    known, n = set(q), len(q)
    outside = [x not in known for x in a]
    if sum(outside) > 0.2 * len(a):
        return False
    inside = sum(outside[:n])
    for i in range(n, len(a) + 1):  # words of its own that stand together are an answer
        if inside > 0.25 * n + 1:
            return False
        inside += (outside[i] if i < len(a) else 0) - outside[i - n]
    # per place in the question: (words added or skipped, of these skipped)
    row = [(j, j) for j in range(n)]
    for x in a:
        new = [min((row[j][0] + 1, row[j][1]), row[j - 1] if x == q[j - 1] else (1 << 60, 0)) for j in range(n)]
        for j in [*range(n), *range(n)]:
            new[j] = min(new[j], (new[j - 1][0] + 1, new[j - 1][1] + 1))
        row = new
    cost, skipped = min(row)
    common = len(a) - (cost - skipped)
    return common >= 0.8 * len(a) and common >= 0.75 * (common + skipped)


def is_copy(question: str | None, answer: str) -> bool:
    """The answer is the question, once or repeated, at most slightly changed, and adds nothing."""
    q = tokens(question or "")
    if len(q) < 3:
        return False
    a = tokens(unnumbered(LABEL.sub(" ", WRAP.sub("", bare(answer)))))
    if not a:
        return False
    if any(t.isdigit() and t not in q for t in a):
        return False  # a figure is an answer
    if len(a) > 8 * len(q):
        return repeats(q, a)
    times = max(1, round(len(a) / len(q)))
    if len(a) < 0.7 * len(q):
        return False
    known = set(q)
    shared = sum(t in known for t in a)  # no subsequence is longer
    if shared < 0.75 * len(q):
        return False
    grams = {tuple(q[i : i + 5]) for i in range(len(q) - 4)}
    mine = [tuple(a[i : i + 5]) for i in range(len(a) - 4)]
    # the shingles that span two repetitions are not in the question
    inside = sum(g in grams for g in mine) / max(1, len(mine) - 4 * (times - 1)) if mine else 0.0
    if inside < 0.8 and shared < max(0.75 * len(q) * times, 0.8 * len(a)):
        return False
    common = lcs(a, q * times)
    return common >= 0.75 * len(q) * times and common >= 0.8 * len(a) or inside >= 0.8 and common >= 0.8 * len(q)


def refusal_sentence(sentence: str, asked: set[str]) -> str:
    """'refusal', 'filler' or 'content'.

    A refusal aligns with a template, or denies (to know, or that the sources
    say) in words that are to three quarters those of refusals or of the
    question (``asked``), nearly all where it takes a turn.
    """
    if re.search(r"\d", CITATION.sub(" ", sentence)) or '"' in sentence:
        return "content"
    s, aligned = [], False
    for clause in re.split(r"[,:]", CITATION.sub(" ", sentence)):
        whole = tokens(clause)
        c = [t for t in whole if t not in asked or t in MUTE]
        if any(aligns(x, t) for x in (whole, [t for t in whole if t not in CIVIL], [t for t in c if t not in CIVIL]) for t in REFUSAL_TOKENS):
            aligned = True
        else:
            s += c
    if not s:
        return "refusal" if aligned else "filler"
    have = set(s)
    muted = sum(t in MUTE or t in GUESS for t in s) / len(s)
    if muted < (0.75 if TURN.isdisjoint(have) else 0.9):
        return "content"
    if aligned or have & GUESS or have & DENY and (have & SAY or have & SOURCE or muted == 1 and "i" in have):
        return "refusal"
    return "filler" if have & CIVIL or have & SOURCE and have & SAY else "content"


def parts(text: str) -> Iterator[str]:
    """Sentences, one by one: the first mostly decides."""
    at = 0
    for m in SENTENCE.finditer(text):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def is_refusal(question: str | None, answer: str) -> bool:
    """Every sentence refuses or goes with a refusal, and at least one refuses."""
    text = WRAP.sub("", bare(answer)).strip(" \"'“”*}")
    asked = set(tokens(question or ""))
    refused = False
    for x in parts(text):
        if WORD.search(x):
            kind = refusal_sentence(x, asked)
            if kind == "content":
                return False
            refused |= kind == "refusal"
    return refused


def other_language(q: str, a: str, q_lang: str | None, a_lang: str | None, q_conf: float, a_conf: float) -> bool:
    if not q_lang or not a_lang or q_lang == a_lang:
        return False
    n = len([w for w in WORD.findall(a) if langid.LETTER.match(w)])
    return n >= 5 and q_conf >= 0.8 and a_conf >= 0.8


def find_defects(
    rows: DataFrame,
    lang_model: langid.EcocModel,
    end_model: truncation.EndModel,
    id_col: str = "gen_id",
    question_col: str = "question",
    answer_col: str = "answer",
    tokens_col: str | None = "tokens_out",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row: id, kept columns, ``defect`` (null for a sound pair) and ``has_text``."""
    spark = rows.sparkSession
    weights = spark.sparkContext.broadcast(lang_model.weights)
    ends = share(spark, end_model)
    tok = F.col(tokens_col).cast("double") if tokens_col else F.lit(None).cast("double")
    src = rows.select(F.col(id_col).alias("id"), F.col(question_col).alias("q"), F.col(answer_col).alias("a"), tok.alias("k"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    types = dict(src.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm, em = langid.EcocModel(weights.value), received(ends)
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                qs = [x if isinstance(x, str) else None for x in part["q"]]
                ans = [x if isinstance(x, str) else None for x in part["a"]]
                defects = judge(qs, ans, part["k"].tolist(), lm, em)
                res = part.drop(columns=["q", "a", "k"]).copy()
                res["defect"] = defects
                res["has_text"] = [d != "empty" for d in defects]
                yield res

    kept = "".join(f", k{i} {types[f'k{i}']}" for i in range(len(keep)))
    out = src.mapInPandas(run, f"id {types['id']}{kept}, defect string, has_text boolean")
    return out.select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "defect", "has_text")


def judge(qs: list[str | None], ans: list[str | None], toks: list[float], lm: langid.EcocModel, em: truncation.EndModel) -> list[str | None]:
    """Defect of each pair."""
    texts: list[str] = []
    for q, a in zip(qs, ans):
        # names the pair shares say nothing about the language
        shared = {w for w in WORD.findall(q or "") if w[:1].isupper()}
        texts.append(langid._plain(q or ""))
        texts.append(" ".join(w for w in langid._plain(WRAP.sub("", a or "")).split() if w.strip(".,;:!?\"'“”*()") not in shared))
    best, conf, _ = lm.decode(texts)
    lang = [langid.LANGS[b] if langid.LETTER.search(t) else None for b, t in zip(best, texts)]
    out: list[str | None] = []
    odds = em.log_odds_many(ans, toks, lang[1::2])
    for i, (q, a) in enumerate(zip(qs, ans)):
        ql, al = lang[2 * i], lang[2 * i + 1]
        if is_empty(a):
            out.append("empty")
        elif is_copy(q, a):
            out.append("copy")
        elif is_refusal(q, a):
            out.append("refusal")
        elif odds[i] > em.threshold(al):
            out.append("truncated")
        elif q and other_language(q, texts[2 * i + 1], ql, al, conf[2 * i], conf[2 * i + 1]):
            out.append("language")
        else:
            out.append(None)
    return out
