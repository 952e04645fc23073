"""Labels from an external model: batches for a provider, parsing of its answers, fallback to local classes."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklake.functions import dates, text
from linklake.functions.urls import let
from linklake.operators.ordering import number_in_group

ANSWER = "batch bigint, answer string, error string, attempts int"
#: Statuses that are worth another attempt; others fail at once.
PASSING = (429, 500, 502, 503, 504)


class ProviderError(Exception):
    """A provider's failure; ``status`` says whether another attempt may help (null: it may)."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def attempted(call: Callable[[], str], attempts: int = 3, wait: Callable[[float], None] | None = None) -> tuple[str | None, str | None, int]:
    """(answer, error, attempts used): waits 0.4 s, 0.8 s and so on up to 5 s between attempts; statuses that no repetition
    cures end at once."""
    wait = wait or time.sleep
    for k in range(1, attempts + 1):
        try:
            return call(), None, k
        except Exception as e:  # the fault is part of the result
            error, final = f"{type(e).__name__}: {e}", getattr(e, "status", None) not in (None, *PASSING)
            if final or k == attempts:
                return None, error, k
            wait(min(0.4 * 2 ** (k - 1), 5.0))
    return None, "no attempt", 0


def ask(rows: DataFrame, provider: Callable[[list[dict]], str], size: int = 25, attempts: int = 3) -> DataFrame:
    """(batch, answer, error, attempts): the provider's text for batches of up to ``size`` rows (id, title, url), formed
    inside each partition. A provider that keeps failing gives a null answer and the last error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 33
        for b in batches:
            out = []
            for i in range(0, len(b), size):
                rows = b.iloc[i : i + size].to_dict("records")
                out.append((n, *attempted(lambda rows=rows: provider(rows), attempts)))
                n += 1
            yield pd.DataFrame(out, columns=["batch", "answer", "error", "attempts"])

    return trimmed(rows).mapInPandas(run, ANSWER)


def trimmed(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").cast("string").alias("id"), F.left("title", F.lit(200)).alias("title"), F.left("url", F.lit(300)).alias("url"))


def messages(rows: DataFrame, categories: list[str], size: int = 25) -> DataFrame:
    """(batch, n, system, user): the prompts of batches of ``size`` rows in id order; user is JSON with the categories and
    the trimmed rows."""
    numbered = number_in_group(rows.where("id is not null").select("id", "title", "url", F.lit(0).alias("g")), ["g"], ["id"])
    each = numbered.select(F.floor(F.col("place") / size).alias("batch"), "place", F.struct(F.col("id").cast("string").alias("id"), F.left("title", F.lit(200)).alias("title"), F.left("url", F.lit(300)).alias("url")).alias("b"))
    batch = each.groupBy("batch").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("place", "b"))), lambda x: x["b"]).alias("bookmarks"))
    system = F.concat(F.lit("Give every link one of these categories and no other: " + ", ".join(categories) + '. Answer with JSON only, as {"assignments": [{"id", "category", "confidence", "tags", "reason"}]}, one entry for each of the '), F.col("n").cast("string"), F.lit(" links."))
    user = F.to_json(F.struct(F.array(*map(F.lit, categories)).alias("categories"), "bookmarks"))
    return batch.select("batch", "n", system.alias("system"), user.alias("user"))


def answer_text(raw: Column) -> Column:
    """The text of a chat answer: the first choice's message (text or parts), else its text, else content or text; ''."""

    def of(v: Column) -> Column:
        get = lambda p: F.try_variant_get(v, p, "string")
        plain = lambda p: F.when(F.schema_of_variant(F.try_variant_get(v, p, "variant")) == "STRING", get(p))
        parts = F.try_variant_get(v, "$.choices[0].message.content", "array<variant>")
        part = lambda p: F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")).otherwise(F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
        return F.coalesce(plain("$.choices[0].message.content"), plain("$.choices[0].text"), F.array_join(F.transform(parts, part), ""), plain("$.content"), plain("$.text"), F.lit(""))

    return let(F.try_parse_json(raw), of)


def model_names(raw: Column) -> Column:
    """Names in an answer that lists models: a list, {data: [...]} or {models: [...]} of texts or of objects with id or
    name."""

    def of(v: Column) -> Column:
        list_ = F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in ("$", "$.data", "$.models")], F.array().cast("array<variant>"))
        name = lambda m: F.when(F.schema_of_variant(m) == "STRING", F.try_variant_get(m, "$", "string")).otherwise(F.coalesce(F.try_variant_get(m, "$.id", "string"), F.try_variant_get(m, "$.name", "string")))
        return F.filter(F.transform(list_, name), lambda n: F.coalesce(n != "", F.lit(False)))

    return let(F.try_parse_json(raw), of)


def within(local: DataFrame, categories: list[str], other: str = "other") -> DataFrame:
    """Local classes (id, category, confidence) limited to some categories; others become ``other`` with 0.2."""
    ok = F.col("category").isin(categories)
    return local.select("id", F.when(ok, F.col("category")).otherwise(other).alias("category"), F.when(ok, F.col("confidence")).otherwise(F.lit(0.2)).alias("confidence"))


def finished(labelled: DataFrame) -> DataFrame:
    """(category, n, from_model, from_local), largest first."""
    return labelled.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "ai").alias("from_model"), F.count_if(F.col("source") == "local").alias("from_local")).orderBy(F.desc("n"), "category")


def plan_of(labelled: DataFrame, names: dict[str, str], min_size: int = 1) -> DataFrame:
    """(name, n, id) of the labelled rows by category, under the category's name (itself where it has none); a null
    category is ``other``; groups under ``min_size`` are left out."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.create_map().cast("map<string,string>")
    keyed = labelled.select("id", F.coalesce("category", F.lit("other")).alias("category"))
    sizes = keyed.groupBy("category").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    return keyed.join(sizes, "category").select(F.coalesce(F.try_element_at(pairs, F.col("category")), "category").alias("name"), "n", "id")


def assignments(answers: DataFrame, categories: list[str]) -> DataFrame:
    """(id, category, confidence, tags, valid) of the answers' entries: a list or {assignments: [...]}, repaired if need
    be. Entries without an id or of an unknown category are not valid; answers that don't parse give no rows."""
    v = text.parsed_json(F.col("answer"))
    list_ = F.coalesce(F.try_variant_get(v, "$.assignments", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    e = answers.select(F.explode(list_).alias("e"))
    get = lambda p, t="string": F.try_variant_get("e", f"$.{p}", t)
    tags = F.slice(F.filter(F.coalesce(get("tags", "array<string>"), F.array().cast("array<string>")), lambda t: t != ""), 1, 8)
    return e.select(get("id").alias("id"), get("category").alias("category"), dates.clamp01(get("confidence", "double")).alias("confidence"), tags.alias("tags"), (F.coalesce(get("id") != "", F.lit(False)) & F.coalesce(get("category").isin(categories), F.lit(False))).alias("valid"))


def label(rows: DataFrame, assigned: DataFrame, local: DataFrame) -> DataFrame:
    """(id, category, confidence, source): the model's label where there is a valid one, else the local class."""
    best = assigned.where("valid").groupBy("id").agg(F.max(F.struct("confidence", "category")).alias("m"))
    j = rows.select(F.col("id").cast("string").alias("id")).join(best, "id", "left").join(local.select(F.col("id").cast("string").alias("id"), F.col("category").alias("lc"), F.col("confidence").alias("lf")), "id", "left")
    return j.select("id", F.coalesce("m.category", "lc").alias("category"), F.coalesce("m.confidence", "lf").alias("confidence"), F.when(F.col("m").isNotNull(), "ai").otherwise("local").alias("source"))
