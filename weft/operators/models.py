"""Model calls behind plain functions, with deterministic offline defaults.

A model is any function from a prompt to text, or None for the default. Calls run in mapInPandas: one client a partition,
retries inside, and a record of each call's time and cost beside its answer.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Dollars for 1000 prompt and completion tokens, by provider and model (fixed values of the public price lists used).
RATES = {("openrouter", "openai/gpt-4o-mini"): (0.00015, 0.0006), ("gemini", "gemini-2.5-flash"): (0.000075, 0.0003)}
FREE = "ollama"
ATTEMPTS = 5


@dataclass
class Completion:
    text: str
    provider: str = FREE
    model: str = "offline"
    prompt_tokens: int = 0
    completion_tokens: int = 0


def price(c: Completion, rates: dict = RATES) -> float:
    """Dollars; a paid provider without a rate is an error."""
    if c.provider.lower() == FREE:
        return 0.0
    if (c.provider.lower(), c.model) not in rates:
        raise ValueError(f"no rate for {c.provider} {c.model}")
    p, q = rates[c.provider.lower(), c.model]
    return c.prompt_tokens / 1000 * p + c.completion_tokens / 1000 * q


def with_retries(call: Callable[[str, float], Completion], prompt: str, accept: Callable[[str], bool] = bool, attempts: int = ATTEMPTS, wait: float = 0.0) -> Completion:
    """Up to `attempts` calls, each a little warmer and later than the one before, until an answer is accepted."""
    last: Exception | None = None
    for i in range(attempts):
        try:
            c = call(prompt, 0.1 * i)
            if accept(c.text):
                return c
            last = ValueError("answer not accepted")
        except (OSError, TimeoutError) as e:
            last = e
        time.sleep(wait * i)
    raise RuntimeError(f"no usable answer in {attempts} calls") from last


def complete(prompts: DataFrame, client: Callable[[], Callable[[str, float], Completion]], arm: str, stage: str, keep: list[str] | None = None) -> DataFrame:
    """prompts (query_id, prompt) with answer, provider, duration_seconds, cost_usd, arm, stage. client() is called once a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for b in batches:
            rows = []
            for q, p in zip(b["query_id"], b["prompt"], strict=True):
                began = time.perf_counter()
                c = with_retries(call, p)
                rows.append((q, c.text, c.provider, time.perf_counter() - began, price(c), arm, stage))
            yield pd.DataFrame(rows, columns=["query_id", "answer", "provider", "duration_seconds", "cost_usd", "arm", "stage"])

    kind = dict(prompts.dtypes)["query_id"]
    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, answer string, provider string, duration_seconds double, cost_usd double, arm string, stage string")


def refine_intent(query: Column) -> Column:
    """Default: the trimmed query, its capitalised runs, and broad if it asks for an overview."""
    q = F.trim(query)
    broad = F.lower(q).rlike("\\b(overview|summary|summarize|everything|all about|explain)\\b")
    return F.struct(q.alias("intent"), T.heuristic_entities(q).alias("entities"), F.when(broad, "broad_exploratory").otherwise("factual_lookup").alias("query_type"))


def segment(documents: DataFrame, shortlists: DataFrame) -> DataFrame:
    """Default: append to the first of the shortlist if it scores, else create. documents: query_id, text; shortlists: query_id, file_id, score, rank."""
    best = shortlists.where("rank = 1 and score > 0").select("query_id", F.col("file_id").alias("target_topic"))
    x = documents.join(best, "query_id", "left")
    action = F.when(F.col("target_topic").isNotNull(), "APPEND_EXISTING").otherwise("CREATE_NEW")
    path = F.when(F.col("target_topic").isNull(), F.concat(F.lit("new/"), F.array_join(F.slice(T.shortlist_tokens(F.col("text")), 1, 5), "-")))
    return x.select("query_id", action.alias("topic_action"), "target_topic", path.alias("new_topic_path"), F.col("text").alias("content_markdown"), F.array_distinct(T.heuristic_entities(F.col("text"))).alias("entities"))


def propose_split(files: DataFrame) -> DataFrame:
    """Default: two sections, cut at the line that starts nearest the middle; headers count as nearer. file_id, new_path, start, end (bytes)."""
    lines = F.split("content", "\n")
    starts = F.aggregate(lines, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<far:double,at:bigint>>").alias("s")), lambda a, x: F.struct((a["at"] + F.octet_length(x) + 1).alias("at"), F.concat(a["s"], F.array(F.struct((F.abs(a["at"] - F.octet_length("content") / 2) * F.when(T.is_header(x), 0.5).otherwise(1.0)).alias("far"), a["at"].alias("at")))).alias("s")))["s"]
    inner = F.filter(starts, lambda s: (s["at"] > 0) & (s["at"] < F.octet_length("content")))
    cut = F.array_min(inner)["at"]
    x = files.withColumn("cut", cut).where("cut is not null")
    parts = F.array(F.struct(F.concat("path", F.lit("/part-1")).alias("new_path"), F.lit(0).cast("long").alias("start"), F.col("cut").alias("end")), F.struct(F.concat("path", F.lit("/part-2")).alias("new_path"), F.col("cut").alias("start"), F.octet_length("content").cast("long").alias("end")))
    return x.select("file_id", F.inline(parts))


def synthesize(context: Column) -> Column:
    """Default: the first line of each file with its path as citation."""
    paths = T.provided_paths(context)
    lines = F.regexp_extract_all(context, F.lit("(?m)^## File: .+\\n(.*)$"), 1)
    return F.struct(F.array_join(F.zip_with(lines, paths, lambda a, p: F.concat(a, F.lit(" ["), p, F.lit("]"))), " ").alias("answer"), paths.alias("citations"))


CRITERIA = ("correctness", "completeness", "groundedness")


def parse_judge(answer: Column) -> Column:
    """The three scores of a judge's JSON and their mean, or an error text."""
    x = F.from_json(T.strip_code_fence(answer), ", ".join(f"{c} int" for c in CRITERIA) + ", rationale string")
    ok = F.lit(True)
    for c in CRITERIA:
        ok = ok & F.coalesce(x[c].between(1, 5), F.lit(False))
    mean = sum((x[c] for c in CRITERIA[1:]), x[CRITERIA[0]]) / len(CRITERIA)
    return F.struct(F.when(ok, x).alias("scores"), F.when(ok, mean).alias("overall"), F.when(~ok, "scores must be 1 to 5").alias("error"))


def validate(answer: Column, schema: str, required: list[str], one_of: dict[str, tuple] | None = None) -> Column:
    """(parsed, error) of a model's JSON answer: required keys, and values from a list."""
    x = F.from_json(T.strip_code_fence(answer), schema)
    error = F.when(x.isNull() | ~T.is_json(T.strip_code_fence(answer)), "not JSON")
    for c in required:
        error = F.coalesce(error, F.when(x[c].isNull(), f"missing {c}"))
    for c, values in (one_of or {}).items():
        error = F.coalesce(error, F.when(~x[c].isin(*values), f"bad {c}"))
    return F.struct(F.when(error.isNull(), x).alias("parsed"), error.alias("error"))


def _kind(v: Column, field: str) -> Column:
    """The type of a field of a JSON object: STRING, ARRAY, ... ; null if it is not there."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant")), "^[A-Z]+", 0)


def checked(answer: Column, strings: tuple, lists: tuple = (), enums: dict[str, tuple] | None = None, rules: tuple = ()) -> Column:
    """(parsed, error) of a model's JSON object. Every field has to be there, strings as strings and lists as lists of
    strings; enums name the values of some; rules are pairs of a function of the parsed fields and the error it tells of.
    The first that fails is the error, and parsed is then null.
    """
    text = T.strip_code_fence(answer)
    v = F.try_parse_json(text)
    error = F.when(v.isNull() | ~T.is_json(text), "not JSON").when(~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "not an object")
    for c in (*strings, *lists):
        error = F.coalesce(error, F.when(F.try_variant_get(v, f"$.{c}", "variant").isNull(), f"missing {c}"))
    for c in strings:
        error = F.coalesce(error, F.when(_kind(v, c) != "STRING", f"{c} must be a string"))
    for c in lists:
        of = F.schema_of_variant(F.try_variant_get(v, f"$.{c}", "variant"))
        error = F.coalesce(error, F.when(~of.isin("ARRAY<STRING>", "ARRAY<VOID>"), f"{c} must be a list of strings"))
    parsed = F.from_json(text, ", ".join([f"{c} string" for c in strings] + [f"{c} array<string>" for c in lists]))
    for c, values in (enums or {}).items():
        error = F.coalesce(error, F.when(~F.coalesce(parsed[c].isin(*values), F.lit(False)), f"bad {c}"))
    for wrong, message in rules:
        error = F.coalesce(error, F.when(F.coalesce(wrong(parsed), F.lit(False)), message))
    return F.struct(F.when(error.isNull(), parsed).alias("parsed"), error.alias("error"))


# Fields and choices of the models' answers.
ACTIONS = ("APPEND_EXISTING", "CREATE_NEW")
QUERY_TYPES = ("factual_lookup", "broad_exploratory")
LEAST_SECTIONS = 2


def parse_segment(answer: Column) -> Column:
    """(parsed, error) of where a document goes: appending needs a target, creating a path."""
    rules = (
        (lambda p: (p["topic_action"] == "APPEND_EXISTING") & (p["target_topic"] == ""), "APPEND_EXISTING without target_topic"),
        (lambda p: (p["topic_action"] == "CREATE_NEW") & (p["new_topic_path"] == ""), "CREATE_NEW without new_topic_path"),
    )
    return checked(answer, ("topic_action", "target_topic", "new_topic_path", "content_markdown"), ("entities", "related_topics"), {"topic_action": ACTIONS}, rules)


def parse_intent(answer: Column) -> Column:
    return checked(answer, ("refined_intent", "query_type"), ("entities",), {"query_type": QUERY_TYPES})


def parse_synthesis(answer: Column, context: Column) -> Column:
    """(parsed, error, unknown): unknown are citations of files that the context does not hold; they are no error."""
    x = checked(answer, ("answer",), ("citations",))
    return F.struct(x["parsed"].alias("parsed"), x["error"].alias("error"), T.unknown_citations(x["parsed"]["citations"], T.provided_paths(context)).alias("unknown"))


def parse_split(answer: Column) -> Column:
    """(sections, redirect_summary, error): two sections at least, each with a path of its own and a start marker."""
    text = T.strip_code_fence(answer)
    v = F.try_parse_json(text)
    parsed = F.from_json(text, "sections array<struct<new_topic_path:string,start_marker:string>>, redirect_summary string")
    s = parsed["sections"]
    paths = F.transform(s, lambda x: x["new_topic_path"])
    missing = lambda c: F.try_variant_get(v, f"$.{c}", "variant").isNull()
    none = lambda c: F.exists(s, lambda x: x.isNull() | F.coalesce(x[c], F.lit("")).eqNullSafe(""))
    error = (
        F.when(v.isNull() | ~T.is_json(text), "not JSON")
        .when(~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "not an object")
        .when(missing("sections"), "missing sections")
        .when(missing("redirect_summary"), "missing redirect_summary")
        .when(_kind(v, "redirect_summary") != "STRING", "redirect_summary must be a string")
        .when((_kind(v, "sections") != "ARRAY") | s.isNull(), "sections must be a list")
        .when(F.size(s) < LEAST_SECTIONS, "too few sections")
        .when(none("new_topic_path"), "section without new_topic_path")
        .when(none("start_marker"), "section without start_marker")
        .when(F.size(F.array_distinct(paths)) < F.size(paths), "duplicate new_topic_path")
    )
    return F.struct(F.when(error.isNull(), s).alias("sections"), F.when(error.isNull(), parsed["redirect_summary"]).alias("redirect_summary"), error.alias("error"))


def listwise_prompt(question: Column, texts: Column, most: int = 600) -> Column:
    """Numbered snippets of the documents to rank, cut to `most` characters each."""
    numbered = F.transform(texts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(x, 1, most)))
    return F.concat(F.lit("Rank the passages for the question.\nQuestion: "), question, F.lit("\n"), F.array_join(numbered, "\n"))
