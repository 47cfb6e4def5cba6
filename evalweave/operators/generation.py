"""Answer generation: contexts, prompts, cached calls, cost and latency."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.functions import text as T
from evalweave.operators.providers import Writer
from evalweave.session import checkpointed

# Prices per million tokens, the rate, and the prompt.
USD_IN_PER_M, USD_OUT_PER_M, USD_TO_EUR = 0.15, 0.60, 0.92
PROMPT = """Answer the question using ONLY the provided context passages. If the context does not contain the answer, say "I cannot answer from the given context."

Context:
{context}

Question: {question}

Answer:"""


def contexts(run: DataFrame, chunks: DataFrame, by: list[str], n: int = 5, chunk_keys: list[str] | None = None) -> DataFrame:
    """The texts of the n best chunks per query, in rank order."""
    keys = chunk_keys or ["dataset", "chunk_id"]
    head = run.where(F.col("rank") <= n).join(chunks.select(*keys, "text"), keys)
    g = head.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_c"))
    return g.select(*by, F.transform("_c", lambda x: x["text"]).alias("contexts"))


def prompt(question: Column, contexts: Column) -> Column:
    return T.fill(PROMPT, context=T.numbered(contexts), question=question)


def cache_key(model: str, temperature: float, question: Column, contexts: Column) -> Column:
    """Content key of a call."""
    return F.sha2(F.to_json(F.struct(contexts.alias("c"), F.lit(model).alias("m"), question.alias("q"), F.lit(temperature).alias("t")), {"ignoreNullFields": "false"}), 256)


def cost_eur(tokens_in: Column, tokens_out: Column) -> Column:
    return (tokens_in * USD_IN_PER_M + tokens_out * USD_OUT_PER_M) / 1e6 * USD_TO_EUR


def generate(requests: DataFrame, cache: DataFrame | None, writer: Writer, model: str = "offline", temperature: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(rows with answers, new cache entries).

    Requests carry question and contexts.  Equal calls are made once, when this
    is called; calls found in the cache are not made again and are marked ``cached``.
    """
    keyed = requests.withColumn("key", cache_key(model, temperature, F.col("question"), F.col("contexts")))
    once = keyed.select("key", prompt(F.col("question"), F.col("contexts")).alias("prompt")).dropDuplicates(["key"])
    if cache is not None:
        once = once.join(cache.select("key"), "key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = writer.load()
        for pdf in batches:
            got = pd.DataFrame(list(f(pdf["prompt"].tolist())), columns=["answer", "tokens_in", "tokens_out", "latency_ms"])
            got.insert(0, "key", pdf["key"].to_numpy())
            yield got

    # a model may be paid and need not answer alike twice: new answers are written once and read back
    made = checkpointed(once.mapInPandas(run, "key string, answer string, tokens_in long, tokens_out long, latency_ms double"))
    known = made.withColumn("cached", F.lit(False))
    if cache is not None:
        known = known.unionByName(cache.select("key", "answer", "tokens_in", "tokens_out", "latency_ms").withColumn("cached", F.lit(True)))
    out = keyed.join(known, "key").withColumn("cost_eur", cost_eur(F.col("tokens_in"), F.col("tokens_out")))
    return out, made


def cost_summary(generation: DataFrame, by: list[str]) -> DataFrame:
    """Mean latency and cost per thousand queries."""
    return generation.groupBy(*by).agg(F.avg(F.nanvl("latency_ms", F.lit(None).cast("double"))).alias("mean_latency_ms"), (F.avg("cost_eur") * 1000).alias("cost_eur_per_1k"), F.count("*").alias("n_calls"))
