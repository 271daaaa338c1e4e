"""Evidence for claims: who can be judged, with which passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import vectors

RETRIEVE, KEEP = 50, 20
_SCOPED = "modo de recuperacao atual e escopado por citacao."
NO_CITATION = f"Chunk nao cita nenhuma referencia; {_SCOPED}"
_B1 = "Referencia(s) citada(s) "
_B2 = " nao possui(em) conteudo indexado " + f"(nao baixada(s)/inacessivel(is)) e o {_SCOPED}"
PASSAGE = "struct<reference_chunk_id: string, reference_id: string, score: double, text: string>"


def lexical_score(claim: Column, passage: Column) -> Column:
    """Share of the claim's distinct words that the passage has; a deterministic stand-in for a cross-encoder."""
    bag = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    asked = bag(claim)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, bag(passage))).cast("double"), F.size(asked)), F.lit(0.0))


def rerank(found: DataFrame, claims: DataFrame, keep: int = KEEP, score=lexical_score) -> DataFrame:
    """Candidates by a second score, which replaces the first; ties stay in their order."""
    text = claims.select(F.col("id").alias("claim_id"), F.col("text").alias("_claim"))
    rows = found.join(text, "claim_id").withColumn("score", F.round(score(F.col("_claim"), F.col("text")), 6))
    order = W.partitionBy("claim_id").orderBy(F.desc("score"), "rank")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).drop("_claim")


def list_text(ids: Column) -> Column:
    """Ids as they are quoted in a reason: ['a', 'b']."""
    return F.concat(F.lit("["), F.array_join(F.transform(ids, lambda i: F.concat(F.lit("'"), i, F.lit("'"))), ", "), F.lit("]"))


def skip_reasons(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """(claim_id, skip_reason) in scoped mode: no citation, or nothing indexed of what is cited; else null."""
    cited = claims.select(F.col("id").alias("claim_id"), F.explode("cited_reference_ids").alias("reference_id"))
    held = cited.join(passages.select("reference_id").distinct(), "reference_id", "left_semi").select("claim_id").distinct().withColumn("has", F.lit(True))
    none = F.concat(F.lit(_B1), list_text(F.col("cited_reference_ids")), F.lit(_B2))
    reason = F.when(F.size("cited_reference_ids") == 0, F.lit(NO_CITATION)).when(F.col("has").isNull(), none)
    return claims.withColumnRenamed("id", "claim_id").join(held, "claim_id", "left").select("claim_id", reason.alias("skip_reason"))


def context(passages: Column) -> Column:
    """Ranked blocks of evidence, each under its reference and score."""
    block = lambda p: F.format_string("[referencia=%s score=%.3f]\n%s", p["reference_id"], p["score"], p["text"])
    return F.array_join(F.transform(passages, block), "\n\n---\n\n")


def curate(
    claims: DataFrame, passages: DataFrame, *, full_corpus: bool = False, retrieve: int = RETRIEVE, keep: int = KEEP, reranker=None
) -> DataFrame:
    """(answer_chunk_id, passages, assembled_context, skip_reason) of claims that carry an ``embedding``."""
    queries = claims.select(F.col("id").alias("claim_id"), "embedding", "cited_reference_ids")
    found = vectors.top_full(queries, passages, retrieve) if full_corpus else vectors.top_scoped(queries, passages, retrieve)
    found = rerank(found, claims, keep, reranker) if reranker else found.where(F.col("rank") <= keep)
    lists = found.groupBy(F.col("claim_id").alias("answer_chunk_id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("reference_chunk_id"), "reference_id", "score", "text"))).alias("p")
    )
    lists = lists.select("answer_chunk_id", F.transform("p", lambda x: F.struct(*[x[n].alias(n) for n in ("reference_chunk_id", "reference_id", "score", "text")])).alias("passages"))
    none = F.lit(None).cast("string")
    base = claims.select(F.col("id").alias("answer_chunk_id"), none.alias("skip_reason")) if full_corpus else skip_reasons(claims, passages).withColumnRenamed("claim_id", "answer_chunk_id")
    empty = F.array().cast(f"array<{PASSAGE}>")
    rows = base.join(lists, "answer_chunk_id", "left").withColumn("passages", F.coalesce(F.col("passages").cast(f"array<{PASSAGE}>"), empty))
    return rows.select("answer_chunk_id", "passages", context(F.col("passages")).alias("assembled_context"), "skip_reason")


