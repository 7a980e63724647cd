"""The knowledge base: aggregate rows rendered to documents, with parent links, ids and a semantic header."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattloom.functions import calendar as cal
from wattloom.functions import text as tx

PARENT = {"daily": "weekly", "weekly": "monthly", "monthly": "seasonal"}

TEMPLATES = {
    "daily": "Zone %s on %s (%s): mean load %.1f MW, between %.1f and %.1f MW, deviation %.1f MW, energy %.1f MWh, %d readings.",
    "weekly": "Zone %s in ISO week %d of %d: mean of the daily means %.1f MW, between %.1f and %.1f MW, deviation %.1f MW.",
    "monthly": "Zone %s in %s %d: mean of the daily means %.1f MW, between %.1f and %.1f MW, deviation %.1f MW.",
    "seasonal": "Zone %s in %s %d: mean of the daily means %.1f MW, between %.1f and %.1f MW, deviation %.1f MW, %d days.",
    "house_daily": "House %s on %s: mean active power %.3f kW, between %.3f and %.3f kW, deviation %.3f kW.",
    "house_weekly": "House %s in the week to %s: mean active power %.3f kW, between %.3f and %.3f kW, deviation %.3f kW.",
    "house_monthly": "House %s in the month to %s: mean active power %.3f kW, between %.3f and %.3f kW, deviation %.3f kW.",
}


def _value(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def _month(year: str | Column, month: str | Column) -> Column:
    return cal.month_name(F.make_date(F.col(year) if isinstance(year, str) else year, F.col(month) if isinstance(month, str) else month, F.lit(1)))


def _documents(df: DataFrame, dataset: str, granularity: str, row_id: Column, context: Sequence[str], prompt: Column, parent: Column) -> DataFrame:
    return df.select(
        row_id.alias("row_id"), F.lit(dataset).alias("dataset"), F.lit(granularity).alias("granularity"),
        tx.row_json({c: F.col(c) for c in context}).alias("context_json"), prompt.alias("prompt_text"), parent.alias("parent_id"),
    )


def zone_documents(frame: DataFrame, granularity: str, dataset: str = "gefcom") -> DataFrame:
    """A document for each row of zone statistics, of any granularity, with an id built from whole numbers and its parent's.

    A day's parent is its ISO week, a week's the month of its Thursday; other granularities have none ('').
    """
    ident = lambda *parts: F.concat_ws("_", F.lit(dataset), F.lit(granularity), *parts)
    if granularity in ("daily", "system_daily"):
        row_id = ident(F.col("zone_id"), F.col("date").cast("string"))
        parent = F.concat_ws("_", F.lit(f"{dataset}_weekly"), F.col("zone_id"), F.concat(F.lit("W"), cal.iso_week("date")), cal.iso_year("date"))
        numbers = [_value(f"load_{c}") for c in ("mean", "min", "max", "std", "sum")]
        prompt = tx.render(TEMPLATES["daily"], F.col("zone_id"), F.col("date").cast("string"), F.col("dow"), *numbers, F.col("obs_count").cast("int"))
    elif granularity == "weekly":
        row_id = ident(F.col("zone_id"), F.concat(F.lit("W"), F.col("iso_week")), F.col("iso_year"))
        thursday = cal.iso_thursday("iso_year", "iso_week")
        parent = F.concat_ws("_", F.lit(f"{dataset}_monthly"), F.col("zone_id"), cal.month_name(thursday), F.year(thursday))
        prompt = tx.render(TEMPLATES["weekly"], F.col("zone_id"), F.col("iso_week"), F.col("iso_year"), *[_value(f"weekly_{c}") for c in ("mean", "min", "max", "std")])
    elif granularity == "monthly":
        row_id = ident(F.col("zone_id"), _month("year", "month"), F.col("year"))
        parent = F.lit("")
        prompt = tx.render(TEMPLATES["monthly"], F.col("zone_id"), _month("year", "month"), F.col("year"), *[_value(f"monthly_{c}") for c in ("mean", "min", "max", "std")])
    else:
        row_id = ident(F.col("zone_id"), F.col("season"), F.col("year"))
        parent = F.lit("")
        numbers = [_value(f"seasonal_{c}") for c in ("mean", "min", "max", "std")]
        prompt = tx.render(TEMPLATES["seasonal"], F.col("zone_id"), F.col("season"), F.col("year"), *numbers, F.col("day_count").cast("int"))
    return _documents(frame, dataset, granularity.removeprefix("system_"), row_id, frame.columns, prompt, parent)


def house_documents(frame: DataFrame, granularity: str, measure: str, dataset: str = "household") -> DataFrame:
    """A document for each resampled period of a house. A day's parent is the week to its Sunday, a week's the month to its end."""
    label = F.col("period_start").cast("string")
    row_id = F.concat_ws("_", F.lit(dataset), F.lit(granularity), F.col("house_id"), label)
    up = {"daily": cal.week_end("period_start"), "weekly": cal.month_end("period_start")}.get(granularity)
    parent = F.lit("") if up is None else F.concat_ws("_", F.lit(dataset), F.lit(PARENT[granularity]), F.col("house_id"), up.cast("string"))
    numbers = [_value(f"{measure}_{c}") for c in ("mean", "min", "max", "std")]
    prompt = tx.render(TEMPLATES[f"house_{granularity}"], F.col("house_id").cast("string"), label, *numbers)
    return _documents(frame, dataset, granularity, row_id, frame.columns, prompt, parent)


def first_by(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each key the first row by ``order``, which has to be total for a defined result."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def master_kb(parts: Sequence[DataFrame], summary: str = "prompt_text") -> DataFrame:
    """All document tables in one, each row id once (that of the earliest part), with fields out of the context.

    ``kb_id`` is a hash of the row id: an id that needs no single-task numbering of the whole table.
    """
    whole = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        whole = p if whole is None else whole.unionByName(p, allowMissingColumns=True)
    kb = first_by(whole, ["row_id"], [F.col("_part"), F.col("context_json")])
    field = lambda f: tx.json_field("context_json", f)
    return kb.select(
        F.xxhash64("row_id").alias("kb_id"), "row_id", "dataset", "granularity", field("zone_id").alias("zone_id"), field("year").alias("year"),
        field("month").alias("month"), field("season").alias("season"), "parent_id", F.col(summary).alias("summary"), "context_json",
    )


def enriched(kb: DataFrame, names: dict[str, str]) -> DataFrame:
    """``text``: a header of the document's place in plain words, then its summary. ``names`` tells what a dataset is about."""
    month = F.col("month").try_cast("int")
    m = F.when(month.between(1, 12), _month(F.lit(2000), month))
    week = tx.json_field("context_json", "iso_week").try_cast("int")
    g = F.col("granularity")
    parts = [
        F.coalesce(cal.choose("dataset", list(names.items())), F.col("dataset")),
        F.when(F.col("zone_id") != "", F.concat(F.lit("Zone "), F.col("zone_id"))),
        F.concat(g, F.lit(" granularity")),
        F.when((g == "daily") & m.isNotNull(), F.concat_ws(" ", m, cal.season(month), F.lit("daily demand pattern"))),
        F.when((g == "monthly") & m.isNotNull(), F.concat_ws(" ", m, F.lit("month"), cal.season(month), F.lit("season"))),
        F.when(g == "weekly", cal.quarter_words(week)),
        F.when((g == "seasonal") & (F.col("season") != ""), F.concat(F.col("season"), F.lit(" season"))),
    ]
    return kb.withColumn("text", F.concat(tx.header(parts), F.lit("\n"), F.trim("summary")))


def cleaned_documents(df: DataFrame, text: str, metadata: Sequence[str]) -> DataFrame:
    """Documents with content; metadata as text, '' for null."""
    return df.where(F.length(F.trim(text)) > 0).select(F.col(text).alias("text"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in metadata])


def select_context(kb: DataFrame, queries: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """For each query, ``n`` documents of its dataset and granularity; of the whole dataset if that granularity has none.

    Queries of one scope get the same sample: the ``n`` first of the scope by a hash of seed and document, found before any
    query is joined. Queries name ``query_id``, ``dataset`` and ``granularity``.
    """
    hashed = kb.select("row_id", "dataset", "granularity", "summary", F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("row_id"))).alias("_h"))

    def first(*scope: str) -> DataFrame:
        at = F.row_number().over(Window.partitionBy(*scope).orderBy("_h", "row_id"))
        return hashed.withColumn("rank", at).where(F.col("rank") <= n).drop("_h")

    asked = queries.select("query_id", "dataset", "granularity")
    exact = asked.join(first("dataset", "granularity"), ["dataset", "granularity"])
    rest = asked.drop("granularity").join(exact.select("query_id").distinct(), "query_id", "left_anti").join(first("dataset"), "dataset")
    return exact.unionByName(rest).select("query_id", "dataset", "row_id", "granularity", "summary", "rank")


def context_text(df: DataFrame, key: str, order: str, line: Column, empty: str = "No summaries retrieved.") -> DataFrame:
    """One text per key: the lines in order, separated by blank lines."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"])
    return df.groupBy(key).agg(lines.alias("lines")).select(key, F.when(F.size("lines") > 0, F.array_join("lines", "\n\n")).otherwise(empty).alias("context"))


def evidence_ids(df: DataFrame, key: str, order: str, letter: str = "E") -> DataFrame:
    """E1, E2, ... by position within a key."""
    return df.withColumn("evidence_id", F.concat(F.lit(letter), F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("string")))


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What isn't done yet, for runs that resume."""
    return todo.join(done.select(key).distinct(), key, "left_anti")
