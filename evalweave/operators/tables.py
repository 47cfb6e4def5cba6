"""The tables of an experiment as they stand: one row per document, query and judgement.

Every delivery is kept in the source tables; these operators give the last one.
Null and blank ids are left out; documents whose last delivery is deleted are
gone; a later delivery wins, ties go to the larger row id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalweave.functions import text as T


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key: one aggregate with map-side combine, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def current_corpus(corpus: DataFrame) -> DataFrame:
    """dataset, doc_id, title, text, load_id and ``doc_text`` of the documents in force."""
    d = corpus.select("dataset", T.clean_id(F.col("doc_id")).alias("doc_id"), "title", "text", "load_id", "loaded_at", "deleted_at").where("doc_id is not null")
    d = latest(d, ["dataset", "doc_id"], ["loaded_at", "load_id"]).where("deleted_at is null")
    return d.select("dataset", "doc_id", "title", "text", "load_id", T.document_text(F.col("title"), F.col("text")).alias("doc_text"))


def current_queries(queries: DataFrame) -> DataFrame:
    """dataset, query_id, text of the last delivery with a text."""
    q = queries.select("dataset", T.clean_id(F.col("query_id")).alias("query_id"), "text", "added_at").where("query_id is not null and text is not null")
    return latest(q, ["dataset", "query_id"], ["added_at", "text"]).select("dataset", "query_id", "text")


def current_qrels(qrels: DataFrame) -> DataFrame:
    """dataset, query_id, doc_id, rel of the last judgement; judgements without a grade are left out."""
    q = qrels.select("dataset", T.clean_id(F.col("query_id")).alias("query_id"), T.clean_id(F.col("doc_id")).alias("doc_id"), "rel", "judged_at", "qrel_id").where("query_id is not null and doc_id is not null and rel is not null")
    return latest(q, ["dataset", "query_id", "doc_id"], ["judged_at", "qrel_id"]).select("dataset", "query_id", "doc_id", "rel")


def stated_queries(queries: DataFrame, every: int = 50) -> DataFrame:
    """The query set of searches: queries whose number is divisible by ``every``."""
    n = F.regexp_extract("query_id", r"(\d+)$", 1)
    return queries.where(F.when(n != "", n.cast("long") % every == 0))
