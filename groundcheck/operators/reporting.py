"""Aggregates over verdicts, costs and sources, and their Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..schemas import VERDICTS

EXAMPLES = 3
RULE = "\n\n---\n\n"


def pct(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole.cast("double")), F.lit(0.0))


def _counts() -> list[Column]:
    return [F.coalesce(F.sum((F.col("verdict") == v).cast("bigint")), F.lit(0).cast("bigint")).alias(f"count_{v}") for v in VERDICTS]


def verdict_counts(results: DataFrame, *by: str) -> DataFrame:
    """Rows of each verdict, 0 for absent ones; every row counts, repeated claims too."""
    return results.groupBy(*by).agg(*_counts())


def cost_summary(results: DataFrame, *by: str) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    return results.groupBy(*by).agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd"), total("prompt_tokens").alias("total_prompt_tokens"),
        total("completion_tokens").alias("total_completion_tokens"), (total("prompt_tokens") + total("completion_tokens")).alias("total_tokens"),
    )


def reference_stats(refs: DataFrame, claims: DataFrame, results: DataFrame) -> DataFrame:
    """For every extracted reference how often it is cited and with which verdicts.

    Citations of unknown references fall away; each claim's last result counts; most cited first, ties in list order.
    """
    last = results.groupBy("answer_chunk_id").agg(F.max_by("verdict", "seq").alias("verdict"))
    cited = claims.select("answer_id", F.col("id").alias("answer_chunk_id"), F.explode("cited_reference_ids").alias("id"))
    per = cited.join(last, "answer_chunk_id", "left").groupBy("answer_id", "id").agg(F.count("*").alias("times_cited"), *_counts())
    zero = F.lit(0).cast("bigint")
    rows = refs.join(per, ["answer_id", "id"], "left").select(
        "answer_id", F.col("id").alias("reference_id"), F.col("raw_url").alias("url"), "ord", F.coalesce("times_cited", zero).alias("times_cited"),
        *[F.coalesce(f"count_{v}", zero).alias(f"{v}_count") for v in VERDICTS], "status",
    )
    return rows.withColumn("place", F.row_number().over(W.partitionBy("answer_id").orderBy(F.desc("times_cited"), "ord")))


def failed(refs: DataFrame, status: str) -> DataFrame:
    """(answer_id, list) of references with a status, in list order; ``error`` is in neither list of a report."""
    rows = refs.where(F.col("status") == status).groupBy("answer_id")
    return rows.agg(F.array_sort(F.collect_list(F.struct("ord", "id", "raw_url", "error_message"))).alias("list"))


def tool_stats(results: DataFrame) -> DataFrame:
    """Percentages of judged claims only, by (run_id, tool_name)."""
    rows = results.groupBy("run_id", "tool_name").agg(F.count("*").alias("total_chunks"), *_counts())
    return rows.select("run_id", "tool_name", *[pct(F.col(f"count_{v}"), F.col("total_chunks")).alias(f"pct_{v}") for v in VERDICTS], "total_chunks")


def compare(results: DataFrame, runs: list[tuple[str, str]]) -> DataFrame:
    """One row for each (run, tool) asked for, in that order, runs without results included."""
    spark = results.sparkSession
    asked = spark.createDataFrame([(i, r, t) for i, (r, t) in enumerate(runs)], "ord int, run_id string, tool_name string")
    rows = asked.join(tool_stats(results).drop("tool_name"), "run_id", "left")
    return rows.select("ord", "run_id", "tool_name", *[F.coalesce(f"pct_{v}", F.lit(0.0)).alias(f"pct_{v}") for v in VERDICTS],
                       F.coalesce("total_chunks", F.lit(0).cast("bigint")).alias("total_chunks")).orderBy("ord")


def examples(results: DataFrame, claims: DataFrame, refs: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """The first results of each verdict and answer, with excerpts and the labels of what their claim cites."""
    known = claims.select(F.col("id").alias("answer_chunk_id"), "answer_id", F.col("text").alias("claim"), "cited_reference_ids")
    order = W.partitionBy("answer_id", "verdict").orderBy("seq")
    top = results.join(known, "answer_chunk_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    label = F.when(F.size("citation_markers") > 0, F.array_join("citation_markers", ", ")).otherwise(F.col("raw_url"))
    names = refs.select("answer_id", F.col("id").alias("ref"), label.alias("label"))
    labels = (
        top.select("answer_id", "answer_chunk_id", F.posexplode("cited_reference_ids").alias("at", "ref")).join(names, ["answer_id", "ref"])
        .groupBy("answer_chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]), " ").alias("labels"))
    )
    return top.join(labels, "answer_chunk_id", "left").select(
        "answer_id", "verdict", "n", "answer_chunk_id", F.coalesce("labels", F.lit("(sem referência resolvida)")).alias("labels"),
        T.excerpt(F.col("claim")).alias("claim_excerpt"), T.excerpt(F.col("justification")).alias("justification_excerpt"),
    )


def report(runs: DataFrame, claims: DataFrame, refs: DataFrame, results: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row a run (run_id is the answer's id). Percentages are of all claims, skipped and pending ones included."""
    of = claims.select(F.col("id").alias("answer_chunk_id"), "answer_id", "position")
    judged = results.join(of, "answer_chunk_id")
    left = skipped.join(of, "answer_chunk_id")
    total = claims.groupBy("answer_id").agg(F.count("*").alias("total_chunks"))
    skips = left.groupBy("answer_id").agg(
        F.count("*").alias("count_skipped"), F.array_sort(F.collect_list(F.struct("position", "answer_chunk_id", "reason"))).alias("skipped_chunks")
    )
    stats = reference_stats(refs, claims, results).groupBy("answer_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "reference_id", "url", "times_cited", *[f"{v}_count" for v in VERDICTS], "status"))).alias("reference_stats")
    )
    rows = runs.withColumn("answer_id", F.col("run_id"))
    for part in (total, verdict_counts(judged, "answer_id"), cost_summary(judged, "answer_id"), skips, stats,
                 failed(refs, "dead").withColumnRenamed("list", "dead_references"), failed(refs, "inaccessible").withColumnRenamed("list", "inaccessible_references")):
        rows = rows.join(part, "answer_id", "left")
    numbers = ["total_chunks", *[f"count_{v}" for v in VERDICTS], "count_skipped", "total_tokens"]
    rows = rows.withColumns({n: F.coalesce(n, F.lit(0).cast("bigint")) for n in numbers} | {"total_cost_usd": F.coalesce("total_cost_usd", F.lit(0.0))})
    return rows.withColumns({f"pct_{v}": pct(F.col(f"count_{v}"), F.col("total_chunks")) for v in VERDICTS})


def _table(head: str, rows: Column) -> Column:
    names = head.split()
    return F.concat(F.lit("| " + " | ".join(names) + " |\n|" + "---|" * len(names) + "\n"), F.array_join(rows, "\n"))


def _row(*cells: Column | str) -> Column:
    parts: list[Column] = []
    for cell in cells:
        parts += [F.lit("| "), F.lit(cell) if isinstance(cell, str) else cell, F.lit(" ")]
    return F.concat(*parts, F.lit("|"))


def _num(form: str, value: Column) -> Column:
    return F.format_string(form, value)


def markdown(reports: DataFrame, refs: DataFrame | None = None, shown: DataFrame | None = None, judge: dict | None = None) -> DataFrame:
    """(run_id, markdown) of reports; ``shown`` are ``examples``, without which their section is left out."""
    c = F.col
    meta = [("Run ID", c("run_id")), ("Ferramenta", c("tool_name")), ("Gerado em", c("generated_at").cast("string")), ("Total de chunks", c("total_chunks").cast("string")),
            ("Tempo de processamento", _num("%.1fs", c("processing_time_seconds")))]
    meta += [(k, F.lit(str(v))) for k, v in (judge or {}).items() if v is not None]
    judged = c("count_supported") + c("count_unsupported") + c("count_contradicted")
    skip_pct = pct(c("count_skipped"), c("total_chunks"))
    pcts = c("pct_supported") + c("pct_unsupported") + c("pct_contradicted")
    some = c("count_skipped") > 0
    spread = [_row(f"**{v.upper()}**", c(f"count_{v}").cast("string"), _num("%.1f%%", c(f"pct_{v}"))) for v in VERDICTS]
    spread.append(F.when(some, _row("**SKIPPED**", c("count_skipped").cast("string"), _num("%.1f%%", skip_pct))))
    spread.append(_row("**TOTAL**", (judged + c("count_skipped")).cast("string"), _num("%.1f%%", pcts + skip_pct)))
    mean = lambda x: F.coalesce(F.try_divide(x.cast("double"), judged), F.lit(0.0))
    cost = [
        _row("**Custo total estimado**", _num("US$ %.4f", c("total_cost_usd"))), _row("**Total de tokens**", c("total_tokens").cast("string")),
        _row("**Média de tokens por requisição**", _num("%.1f", mean(c("total_tokens")))), _row("**Média de custo por requisição**", _num("US$ %.4f", mean(c("total_cost_usd")))),
    ]
    rows = reports
    stats = F.coalesce(c("reference_stats"), F.array().cast(dict(reports.dtypes)["reference_stats"]))
    uncited, n = F.size(F.filter(stats, lambda s: s["times_cited"] == 0)), F.size(stats)
    line = lambda s, label: F.concat(
        F.lit("| ["), F.coalesce(label, s["url"]), F.lit("]("), s["url"], F.lit(") "),
        _row(s["status"], *[s[k].cast("string") for k in ("times_cited", "supported_count", "unsupported_count", "contradicted_count")]),
    )
    if refs is not None:  # a join, since a map of an answer's labels is searched from its start for every line
        labels = refs.where(F.size("citation_markers") > 0).select("answer_id", F.col("id").alias("ref"), F.array_join("citation_markers", " ").alias("label"))
        each = reports.select("answer_id", F.explode("reference_stats").alias("s")).withColumn("ref", c("s.reference_id"))
        each = each.join(labels, ["answer_id", "ref"], "left").select("answer_id", F.struct("s.place", line(c("s"), c("label")).alias("t")).alias("x"))
        rows = rows.join(each.groupBy("answer_id").agg(F.array_sort(F.collect_list("x")).alias("lines")), "answer_id", "left")
        lines = F.transform("lines", lambda e: e["t"])
    else:
        lines = F.transform(stats, lambda s: line(s, F.lit(None).cast("string")))
    ranking = F.when(n == 0, F.lit("Nenhuma referência citada nos chunks avaliados.")).otherwise(F.concat(
        F.format_string("Referências sem nenhuma citação: %d/%d (%.1f%%)\n\n", uncited, n, pct(uncited.cast("bigint"), n)),
        _table("Referência Status Citações SUPPORTED UNSUPPORTED CONTRADICTED", lines),
    ))
    item = lambda r: F.concat(F.lit("- "), r["raw_url"], F.lit(" — "), F.coalesce(F.nullif(r["error_message"], F.lit("")), F.lit("sem detalhes")))
    part = lambda name, title: F.when(F.size(name) > 0, F.concat(F.lit(f"\n### {title}\n\n"), F.array_join(F.transform(name, item), "\n")))
    lost = F.array_compact(F.array(part("dead_references", "Mortas (HTTP 404)"), part("inaccessible_references", "Inacessíveis (403/timeout/SSL)")))
    skips = F.transform("skipped_chunks", lambda s: F.concat(F.lit("- `"), s["answer_chunk_id"], F.lit("` — "), s["reason"]))
    if shown is not None:
        one = F.format_string("- **Chunk `%s`** %s\n  - Trecho: %s\n  - Justificativa: %s", "answer_chunk_id", "labels", "claim_excerpt", "justification_excerpt")
        blocks = shown.groupBy("answer_id", "verdict").agg(F.array_sort(F.collect_list(F.struct("n", one.alias("t")))).alias("x"))
        rank = F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), c("verdict"))
        blocks = blocks.select("answer_id", rank.alias("r"), F.concat(F.lit("\n### "), F.upper("verdict"), F.lit("\n\n"), F.array_join(F.transform("x", lambda e: e["t"]), "\n")).alias("b"))
        texts = blocks.groupBy("answer_id").agg(F.concat(F.lit("## 6. Exemplos Representativos por Veredito\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "b"))), lambda e: e["b"]), "\n")).alias("examples"))
        rows = rows.join(texts, "answer_id", "left")
    else:
        rows = rows.withColumn("examples", F.lit(None).cast("string"))
    sections = F.array_compact(F.array(
        F.concat(F.lit("# Relatório de Auditoria — "), c("tool_name"), F.lit(" ("), c("answer_id"), F.lit(")")),
        F.concat(F.lit("## 1. Metadados da Execução\n\n"), _table("Campo Valor", F.array(*[_row(f"**{k}**", v) for k, v in meta]))),
        F.concat(F.lit("## 2. Distribuição de Vereditos\n\n"), _table("Veredito Chunks Percentual", F.array_compact(F.array(*spread)))),
        F.concat(F.lit("## 3. Custo e Uso de Tokens\n\n"), _table("Métrica Valor", F.array(*cost))),
        F.concat(F.lit("## 4. Análise por Referência\n\n"), ranking),
        F.when(F.size(lost) > 0, F.concat(F.lit("## 5. Referências Mortas e Inacessíveis\n"), F.array_join(lost, "\n"))),
        c("examples"),
        F.when(F.size("skipped_chunks") > 0, F.concat(F.lit("## 7. Chunks Não Auditados\n\n"), F.array_join(skips, "\n"))),
    ))
    return rows.select("run_id", F.array_join(sections, RULE).alias("markdown"))


def report_json(reports: DataFrame) -> DataFrame:
    return reports.select("run_id", F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def comparison_markdown(rows: DataFrame) -> str:
    """The table of ``compare``, one line a run."""
    lines = [
        f"| {r['tool_name']} | {r['total_chunks']} | " + " | ".join(f"{r[f'pct_{v}']:.1f}%" for v in VERDICTS) + " |"
        for r in rows.orderBy("ord").collect()  # a row a run that was asked for
    ]
    head = "## Comparação entre Ferramentas\n\n"
    if not lines:
        return head + "Nenhum dado disponível."
    return head + "\n".join(["| Ferramenta | Chunks | SUPPORTED | UNSUPPORTED | CONTRADICTED |", "|" + "---|" * 5, *lines])
