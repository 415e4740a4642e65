"""Filters, counts and listings over the executions of a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioquery import fixed
from folioquery.functions.results import field_is, field_text, parse_result, percent, truthy
from folioquery.functions.text import tagged


def succeeded(executions: DataFrame) -> DataFrame:
    return executions.filter(F.col("status") == "SUCCEEDED")


def where(executions: DataFrame, filters: list[str], result: str = "result") -> DataFrame:
    """Rows whose parsed result meets every ``field=value``; one without '=' is met by none."""
    parsed = parse_result(F.col(result))
    tests = [field_is(parsed, *f.split("=", 1)) if "=" in f else F.lit(False) for f in filters]
    return executions.filter(reduce(lambda a, b: a & b, tests)) if tests else executions


def iterations(spec: str, column: str = "iteration") -> Column:
    """A predicate from 'N', 'N-M' (N <= M) or 'N,M,...'."""
    if "-" in spec:
        low, high = (int(x) for x in spec.split("-", 1))
        if low > high:
            raise ValueError(f"range runs backwards: {spec}")
        return F.col(column).between(low, high)
    return F.col(column).isin(*[int(x) for x in spec.split(",")])


def fields(executions: DataFrame, names: list[str]) -> DataFrame:
    """Without prompt and output; result reduced to the named fields, or raw where it is not JSON."""
    parsed = parse_result(F.col("result"))
    short = F.to_json(F.struct(*[field_text(parsed, n).alias(n) for n in names]))
    return executions.drop("prompt", "output").withColumn("result", F.when(parsed.isNull(), F.col("result")).otherwise(short))


def step_counts(steps: DataFrame, executions: DataFrame) -> DataFrame:
    """Per step succeeded, failed and other executions, steps by priority."""
    state = F.lower("status")
    n = executions.groupBy(F.col("step_name").alias("name")).agg(
        F.count_if(state == "succeeded").alias("succeeded"),
        F.count_if(state == "failed").alias("failed"),
        F.count_if(~F.coalesce(state.isin("succeeded", "failed"), F.lit(False))).alias("other"),
    )
    rows = steps.join(n, "name", "left").fillna(0, ["succeeded", "failed", "other"])
    return rows.orderBy(F.coalesce("priority", F.lit(0)), "name")


def _dated(date: Column) -> Column:
    return F.coalesce(date.rlike(r"\d{4}") & (date != "Unknown"), F.lit(False))


def _unknown(date: Column) -> Column:
    return F.coalesce(date == "Unknown", F.lit(True))


def date_stats(executions: DataFrame) -> DataFrame:
    """One row: pages and entries (rows that continue nothing), dated and unknown, with percentages; in one pass."""
    parsed = succeeded(executions).select(parse_result(F.col("result")).alias("r")).filter("r is not null")
    rows = parsed.select(field_text(F.col("r"), "date").alias("date"), (~truthy(F.col("r"), "continuation")).alias("entry"))
    d, u, e = _dated(F.col("date")), _unknown(F.col("date")), F.col("entry")
    out = rows.agg(F.count("*").alias("pages"), F.count_if(d).alias("dated"), F.count_if(u).alias("unknown"), F.count_if(e).alias("entries"), F.count_if(e & d).alias("entries_dated"), F.count_if(e & u).alias("entries_unknown"))
    return out.withColumn("unknown_pct", percent(F.col("unknown"), F.col("pages"))).withColumn("entries_unknown_pct", percent(F.col("entries_unknown"), F.col("entries")))


def tally(values: DataFrame, column: str) -> DataFrame:
    """Values and their counts, most frequent first; null and false count as N/A."""
    value = F.coalesce(F.col(column).cast("string"), F.lit("N/A"))
    return values.groupBy(F.when(value == "false", "N/A").otherwise(value).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def resolve_step(steps: DataFrame, name: str) -> DataFrame:
    """The step of that name, exact before case-insensitive; an error that lists the run's steps if there is none."""
    hits = steps.filter(F.lower("name") == name.lower())
    hit = hits.orderBy(F.when(F.col("name") == name, 0).otherwise(1), "ordinal").limit(1)
    if hit.isEmpty():
        known = [r["name"] for r in steps.orderBy("ordinal").limit(100).select("name").collect()]
        raise LookupError(f"no step named {name!r}; steps: {', '.join(map(str, known)) or 'none'}")
    return hit


def extract_step(steps: DataFrame) -> DataFrame:
    """The first step whose name speaks of the extract, one row with the usual name if none does."""
    hit = steps.filter(F.col("name").rlike("(?i)extract info")).agg(F.min_by("name", "ordinal").alias("name"))
    return hit.select(F.coalesce("name", F.lit("Extract Info")).alias("name"))


def list_pages(executions: DataFrame) -> DataFrame:
    """Succeeded rows of the extract step: page (the raw iteration), date, provider, categories and continuation."""
    rows = succeeded(executions).filter(F.col("step_name") == fixed.EXTRACT_STEP).withColumn("r", parse_result(F.col("result")))
    text = {n: field_text(F.col("r"), f) for n, f in (("date", "date"), ("provider", "provider"), ("category", "doc_category"), ("subcategory", "doc_subcategory"), ("continuation", "continuation"))}
    return rows.select(F.col("iteration").alias("page"), F.coalesce(text["date"], F.lit("Unknown")).alias("date"), *[text[n].alias(n) for n in ("provider", "category", "subcategory", "continuation")]).orderBy("page")


def list_letters(letters: DataFrame) -> DataFrame:
    """Letters numbered from one in their order, with date, provider, category, pages."""
    at = F.row_number().over(Window.partitionBy("run_id").orderBy("index")) if "run_id" in letters.columns else F.col("index") + 1
    run = ["run_id"] if "run_id" in letters.columns else []
    rows = letters.select(*run, at.alias("row"), *[c for c in ("id",) if c in letters.columns], "date", "provider", "category", "page_count", "pages")
    return rows.orderBy(*run, "row")


def compact(executions: DataFrame) -> DataFrame:
    """Eight columns of an execution: its iteration, the file its prompt names, and six fields of its result, null where that is no JSON."""
    r = parse_result(F.col("result"))
    fields_ = (("date", "date"), ("date_label", "date_label"), ("continuation", "continuation"), ("category", "doc_category"), ("subcategory", "doc_subcategory"), ("provider", "provider"))
    filename = tagged(F.col("prompt"), "filename") if "prompt" in executions.columns else F.lit(None).cast("string")
    return executions.select("iteration", filename.alias("filename"), *[field_text(r, f).alias(n) for n, f in fields_])


def flatten_steps(steps: DataFrame) -> DataFrame:
    """Step fields by kind, in order of priority; fields of other kinds are null."""
    a, kind = F.col("action"), F.col("kind")
    prompt, loop, code, form = kind == "PROMPT", kind == "ITERATOR", kind == "CODE", kind == "FORMATTER"
    prompts = F.array_join(F.transform(a["messages"], lambda m: F.concat(m["role"], F.lit(":\n"), m["template"])), "\n\n")
    out = steps.select(
        "name", "kind", "priority",
        F.when(prompt, a["model"]).alias("model"), F.when(prompt, a["temperature"]).alias("temperature"), F.when(prompt, prompts).alias("prompts"),
        F.when(loop, a["overKey"]).alias("over_key"), F.when(loop, a["iterationLimit"]).alias("iteration_limit"), F.when(loop, a["batchSize"]).alias("batch_size"),
        F.when(code, a["json"]).alias("code"), F.when(form, a["template"]).alias("template"),
    )
    return out.orderBy(F.coalesce("priority", F.lit(0)), "name")


def search(workflows: DataFrame, query: str | None) -> DataFrame:
    return workflows if not query else workflows.filter(F.contains(F.lower("name"), F.lit(query.lower())))
