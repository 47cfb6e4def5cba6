"""Judge replies, judge composites, answer-quality ratios and prediction-powered inference."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalweave.functions import text as T
from evalweave.functions.stats import normal_quantile
from evalweave.operators.providers import Critic, Embedder, Writer
from evalweave.session import checkpointed

DIMS = ("context_relevance", "answer_faithfulness", "answer_relevance")
# Fixed value: the judge's prompt.
PROMPT = """You are evaluating a retrieval-augmented QA system. Given the
question, retrieved context, and generated answer, score each criterion 0 or 1.

Question: {question}
Context: {context}
Answer: {answer}

Criteria:
1. context_relevance: Is the context relevant to answering the question?
2. answer_faithfulness: Is the answer supported by the context (no hallucination)?
3. answer_relevance: Does the answer address the question?

Respond with ONLY a JSON object: {{"context_relevance": 0 or 1,
"answer_faithfulness": 0 or 1, "answer_relevance": 0 or 1}}"""


def judge_prompt(question: Column, contexts: Column, answer: Column) -> Column:
    return T.fill(PROMPT, question=question, context=F.array_join(contexts, "\n"), answer=answer)


def parse_reply(reply: Column) -> dict[str, Column]:
    """The three marks of a reply: the JSON object from the first { to the last }; what is absent or broken is 0."""
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0)
    out = {}
    for d in DIMS:
        v = F.get_json_object(body, f"$.{d}")
        n = F.when(v == "true", F.lit(1)).when(v == "false", F.lit(0)).otherwise(v.try_cast("double").try_cast("int"))
        out[d] = F.coalesce(n, F.lit(0))
    return out


def judge(rows: DataFrame, writer: Writer) -> DataFrame:
    """The rows with the judge's three marks."""
    src = rows.withColumn("_p", judge_prompt(F.col("question"), F.col("contexts"), F.col("answer")))

    @F.pandas_udf("string")
    def ask(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = writer.load()
        for p in it:
            yield pd.Series([x[0] for x in f(p.tolist())], dtype="object")

    marks = src.withColumn("_reply", ask("_p"))
    return marks.select(*rows.columns, *[c.alias(d) for d, c in parse_reply(F.col("_reply")).items()])


def composite(marks: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the three mean marks."""
    total = sum(F.avg(d) for d in DIMS[1:])
    return marks.groupBy(*by).agg(((F.avg(DIMS[0]) + total) / 3).alias("ares_composite"), F.count("*").alias("n_judged"))


def ppi(marks: DataFrame, labels: DataFrame, by: list[str], alpha: float = 0.05, mode: str = "per_config") -> DataFrame:
    """Calibrated composite with interval per config.

    Per config and mark: mean of all marks plus the mean of label minus mark on
    the labelled queries, variance var(all)/n + var(difference)/m; then the mean
    over the marks of point, lower and upper end.  ``mode='global'`` takes the
    difference over all configs of a data set together.  Without labels the raw
    composite stands, without an interval.
    """
    long = marks.select(*by, "query_id", F.expr("stack(3, " + ", ".join(f"'{d}', cast({d} as double)" for d in DIMS) + ") as (dim, mark)"))
    human = labels.select("dataset", "query_id", F.expr("stack(3, " + ", ".join(f"'{d}', cast({d} as double)" for d in DIMS) + ") as (dim, human)"))
    j = long.join(human, ["dataset", "query_id", "dim"], "left").withColumn("_d", F.col("human") - F.col("mark"))
    g = j.groupBy(*by, "dim").agg(F.avg("mark").alias("_m"), F.var_samp("mark").alias("_vm"), F.count("mark").alias("_n"), F.avg("_d").alias("_r"), F.var_samp("_d").alias("_vr"), F.count("_d").alias("_k"))
    if mode == "global":
        one = j.groupBy("dataset", "dim").agg(F.avg("_d").alias("_r"), F.var_samp("_d").alias("_vr"), F.count("_d").alias("_k"))
        g = g.drop("_r", "_vr", "_k").join(one, ["dataset", "dim"], "left")
    half = normal_quantile(1 - alpha / 2) * F.sqrt(F.col("_vm") / F.col("_n") + F.try_divide(F.col("_vr"), F.col("_k")))
    point = F.col("_m") + F.col("_r")
    d = g.select(*by, F.col("_m"), point.alias("_p"), (point - half).alias("_lo"), (point + half).alias("_hi"))
    return d.groupBy(*by).agg(F.avg(F.coalesce("_p", "_m")).alias("ares_composite"), F.avg("_lo").alias("ares_ci_lo"), F.avg("_hi").alias("ares_ci_hi"))


def ragas(rows: DataFrame, critic: Critic, embedder: Embedder, by: list[str]) -> DataFrame:
    """(by, ragas_faithfulness, ragas_answer_relevancy, ragas_context_relevancy) of rows with question, answer and contexts.

    The critic gives statements, verdicts and questions, the embedder the
    similarity of questions; the ratios are those of the three operators below.
    A null question, answer or context counts as empty.
    """
    src = rows.select(*by, "question", "answer", "contexts")
    types = dict(src.dtypes)
    fields = "supported array<int>, useful array<int>, similar array<struct<similarity:double,noncommittal:int>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (statements, verdict, questions), embed = critic.load(), embedder.load()
        for pdf in batches:
            out = []
            for *key, q, a, c in pdf.itertuples(index=False):
                q, a, texts = q or "", a or "", [x or "" for x in (c if c is not None else [])]
                asked = questions(a)
                v = np.asarray(embed([q, *[x for x, _ in asked]]), float)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                alike = [{"similarity": float(x @ v[0]), "noncommittal": int(n)} for x, (_, n) in zip(v[1:], asked)]
                out.append((*key, [verdict(s, "\n".join(texts)) for s in statements(a)], [verdict(q, x) for x in texts], alike))
            yield pd.DataFrame(out, columns=[*by, "supported", "useful", "similar"])

    got = checkpointed(src.mapInPandas(run, "".join(f"`{c}` {types[c]}, " for c in by) + fields))
    a = faithfulness(got.select(*by, F.explode_outer("supported").alias("verdict")), by)
    b = answer_relevancy(got.select(*by, F.explode_outer("similar").alias("_s")).select(*by, "_s.*"), by)
    c = context_precision(got.select(*by, F.posexplode_outer("useful").alias("rank", "verdict")).withColumn("rank", F.col("rank") + 1), by)
    return a.join(b, by, "left").join(c, by, "left")


def faithfulness(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Supported statements over all statements; no statements give null."""
    return verdicts.groupBy(*by).agg(F.try_divide(F.sum(F.col("verdict").cast("double")), F.count("verdict")).alias("ragas_faithfulness"))


def answer_relevancy(sims: DataFrame, by: list[str]) -> DataFrame:
    """Mean similarity of the question to the questions made from the answer, 0 if every one is noncommittal."""
    return sims.groupBy(*by).agg((F.avg("similarity") * F.when(F.min("noncommittal") == 1, 0.0).otherwise(1.0)).alias("ragas_answer_relevancy"))


def context_precision(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Average precision of the ordered verdicts; without a positive verdict 0."""
    run = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    v = verdicts.withColumn("_p", F.col("verdict") * F.sum("verdict").over(run) / F.col("rank"))
    return v.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum("_p"), F.sum("verdict").cast("double")), F.lit(0.0)).alias("ragas_context_relevancy"))
