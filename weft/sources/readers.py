"""Readers and writers of the knowledge base's own formats: tickets, mail, chat rows, framed pages, manifests, results."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as T

COMMENTS = "array<struct<author:string,body:string>>"
TICKET = f"ticket_id string, subject string, description string, status string, priority string, category string, requester string, assignee string, created_at string, comments {COMMENTS}"
TICKET_SCALARS = ("ticket_id", "subject", "description", "status", "priority", "category", "requester", "assignee", "created_at")


def _filled(df: DataFrame) -> DataFrame:
    """Missing scalars are empty text, missing comments none."""
    have = set(df.columns)
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in TICKET_SCALARS]
    none = F.array().cast(COMMENTS)
    return df.select(*cols, F.coalesce("comments", none).alias("comments") if "comments" in have else none.alias("comments"))


def tickets_json(spark: SparkSession, path: str) -> DataFrame:
    return _filled(spark.read.schema(TICKET).json(path, multiLine=True))


def tickets_json_text(df: DataFrame, col: str = "json") -> DataFrame:
    """Tickets of a column of JSON text; text that is none is an error."""
    return _filled(df.select(F.from_json(col, TICKET, {"mode": "FAILFAST"}).alias("t")).select("t.*"))


def tickets_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; assignee and comments may be missing; a comments cell is a JSON array."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    if "comments" in df.columns:
        df = df.withColumn("comments", F.from_json(F.nullif(F.trim("comments"), F.lit("")), COMMENTS))
    return _filled(df)


MAIL = S.StructType([S.StructField(c, S.StringType()) for c in ("sender", "subject", "in_reply_to", "references", "date", "body")])


def _mail_fields(raw: bytes) -> tuple:
    import email
    from email import policy
    from email.utils import parseaddr

    msg = email.message_from_bytes(raw, policy=policy.default)
    part = msg.get_body(preferencelist=("plain",)) if msg.is_multipart() else msg
    try:
        body = part.get_content() if part is not None else ""
    except (LookupError, UnicodeError, KeyError):
        body = (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
    sender = str(msg.get("From", ""))
    return parseaddr(sender)[1] or sender.strip(), str(msg.get("Subject", "")), str(msg.get("In-Reply-To", "")), str(msg.get("References", "")), str(msg.get("Date", "")), body.strip() if isinstance(body, str) else ""


@F.pandas_udf(MAIL)
def parse_mail(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_mail_fields(bytes(x)) for x in raw], columns=MAIL.names)


def mail(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """id (file stem), sender, subject, thread, body, date of the files of a folder in name order."""
    files = spark.read.format("binaryFile").load(path).orderBy("path")
    files = files.limit(limit) if limit is not None else files
    x = files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("id"), parse_mail("content").alias("m"))
    return x.select("id", "m.sender", "m.subject", T.thread_key(F.col("m.in_reply_to"), F.col("m.references"), F.col("m.subject")).alias("thread"), "m.body", "m.date")


def chat_tickets(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list of chat rows, or an object with it under rows, as closed tickets that the support bot has answered."""
    row = "array<struct<instruction:string,category:string,intent:string,response:string>>"
    raw = spark.read.text(path, wholetext=True)
    rows = F.coalesce(F.from_json(F.get_json_object("value", "$.rows"), row), F.from_json("value", row))
    x = raw.select(F.posexplode(rows).alias("i", "r"))
    return x.select(chat_ticket(F.col("r"), F.col("i")).alias("t")).select("t.*")


# Fixed values of a chat row's ticket.
BOT, CHAT_STATUS, CHAT_PRIORITY = "support-bot@example.com", "closed", "normal"


def chat_ticket(row: Column, i: Column) -> Column:
    """A ticket struct of a chat row (instruction, category, response) and its number."""
    said = lambda c: F.coalesce(row[c], F.lit(""))
    fields = {
        "ticket_id": F.format_string("BTX-%06d", i),
        "subject": F.substring(said("instruction"), 1, 80),
        "description": said("instruction"),
        "status": F.lit(CHAT_STATUS),
        "priority": F.lit(CHAT_PRIORITY),
        "category": said("category"),
        "requester": F.concat(F.lit("customer-"), i.cast("string"), F.lit("@example.com")),
        "assignee": F.lit(BOT),
        "created_at": T.synthetic_time(i),
    }
    comments = F.array(F.struct(F.lit(BOT).alias("author"), said("response").alias("body")))
    return F.struct(*[v.alias(k) for k, v in fields.items()], comments.alias("comments"))


RAW = "id string, source_type string, text string, structured_fields map<string,string>, ts timestamp"


def raw_documents(kind: str, df: DataFrame) -> DataFrame:
    """Dispatch by source type (pdf, email, ticket) to id, source_type, text, structured_fields, ts."""
    if kind == "ticket":
        fields = F.create_map(*[x for c in TICKET_SCALARS for x in (F.lit(c), F.col(c))], F.lit("comment_count"), F.size("comments").cast("string"))
        return df.select("*", F.struct(*df.columns).alias("ticket")).select(F.col("ticket_id").alias("id"), F.lit(kind).alias("source_type"), T.ticket_blob().alias("text"), fields.alias("structured_fields"), F.try_to_timestamp(F.col("created_at")).alias("ts"))
    if kind == "email":
        fields = F.create_map(*[x for c in ("sender", "subject", "thread") for x in (F.lit(c), F.col(c))])
        return df.select("id", F.lit(kind).alias("source_type"), F.col("body").alias("text"), fields.alias("structured_fields"), F.try_to_timestamp(F.col("date"), F.lit("EEE, d MMM yyyy HH:mm:ss Z")).alias("ts"))
    if kind == "pdf":
        x = df.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("page", T.frame_page(F.col("text"), F.col("page")).alias("framed")))).alias("p"))
        return x.select("id", F.lit(kind).alias("source_type"), F.array_join(F.transform("p", lambda y: y["framed"]), "").alias("text"), F.create_map(F.lit("page_count"), F.size("p").cast("string")).alias("structured_fields"), F.lit(None).cast("timestamp").alias("ts"))
    raise ValueError(f"unknown source type {kind}; one of email, pdf, ticket")


def parse_pages(text: str) -> list[tuple[int, str]]:
    """Pages of framed text. The stated length rules, so a payload may hold what looks like a marker."""
    import re

    out, at = [], 0
    opening = re.compile(r"\[\[PAGE (\d+) LEN=(\d+)\]\]\n")
    while at < len(text):
        m = opening.match(text, at)
        if not m:
            raise ValueError(f"no page at character {at}")
        end = m.end() + int(m[2])
        close = f"[[/PAGE {m[1]}]]\n"
        if text[end : end + len(close)] != close:
            raise ValueError(f"page {m[1]} does not close at character {end}")
        out.append((int(m[1]), text[m.end() : end]))
        at = end + len(close)
    return out


class _Pages:
    """The pages of one framed text."""

    def eval(self, text: str):
        if text is not None:
            yield from parse_pages(text)


def iter_pages(df: DataFrame, id_col: str = "id", text_col: str = "text", *keep: str) -> DataFrame:
    """id, page, text, and the columns of keep, for each page of framed documents; a null text has none.

    A table function joined laterally: only the text goes to Python, what stands beside it stays where it is.
    """
    pages = F.udtf(_Pages, returnType="page int, body string", useArrow=True)
    x = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"), *keep)
    return x.lateralJoin(pages(F.col("__text").outer())).select("id", "page", F.col("body").alias("text"), *keep)


def repair_json(text: str) -> str:
    """Triple-quoted spans become JSON strings; raw control characters inside strings are escaped."""
    import re

    text = re.sub(r'(?s)"""(.*?)"""', lambda m: json.dumps(m[1]), text)
    out, inside, skip = [], False, False
    for c in text:
        if skip:
            skip = False
        elif inside and c == "\\":
            skip = True
        elif c == '"':
            inside = not inside
        elif inside and c < " ":
            c = json.dumps(c)[1:-1]
        out.append(c)
    return "".join(out)


@F.pandas_udf(S.StringType())
def repaired(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else repair_json(x))


def with_entities(df: DataFrame, response: Column, source: Column, out: str = "entities") -> DataFrame:
    """Adds the entities of a response: its JSON array of strings, else capitalised runs of the source; first seen regardless of case."""
    df = df.withColumn("__json", repaired(T.strip_code_fence(response)))  # a column of its own, as lambdas take no Python function
    parsed = F.from_json("__json", "array<string>")
    df = df.withColumn("__names", F.filter(F.transform(F.coalesce(parsed, T.heuristic_entities(source)), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    keys = F.transform("__names", lambda x: F.lower(x))
    numbered = F.transform("__names", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    first = F.filter(numbered, lambda s: F.array_position(keys, F.lower(s["x"])) == s["i"] + 1)
    return df.withColumn(out, F.transform(first, lambda s: s["x"])).drop("__json", "__names")


MANIFEST = "generated_at string, provider string, model string, documents array<struct<doc_id:string,filename:string,primary_topic:struct<id:string,title:string>,cross_references:array<struct<id:string,title:string>>>>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, filename, primary_topic, cross_references; documents without id or topic are an error."""
    x = spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.explode("documents").alias("d")).select("d.*")
    good = F.col("doc_id").isNotNull() & F.col("primary_topic.id").isNotNull()
    return x.where(F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit("manifest: document without id or topic")).cast("boolean")))


def write_ground_truth(truth: DataFrame, path: str) -> None:
    truth.write.mode("overwrite").json(path)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.schema("topic_id string, doc_id string, label string").json(path)
    return x.where(F.when(F.col("label").isin("primary", "cross_reference"), F.lit(True)).otherwise(F.raise_error(F.lit("ground truth: bad label")).cast("boolean")))


def topic_seeds(spark: SparkSession, topics: list[dict]) -> DataFrame:
    """idx, id, title, key_facts of parsed seeds; ids must be unique."""
    if len({t["id"] for t in topics}) < len(topics):
        raise ValueError("topic ids repeat")
    return spark.createDataFrame([(i, t["id"], t["title"], list(t.get("key_facts", []))) for i, t in enumerate(topics)], "idx long, id string, title string, key_facts array<string>")


def topic_seeds_yaml(spark: SparkSession, path: str) -> DataFrame:
    """topic_seeds of YAML files: a list under topics, each with id and title; anything else is an error."""
    try:
        import yaml
    except ModuleNotFoundError as e:
        raise RuntimeError("reading YAML seeds needs PyYAML") from e

    topics: list[dict] = []
    for r in spark.read.text(path, wholetext=True).orderBy(F.input_file_name()).toLocalIterator():  # seeds are written by hand
        raw = yaml.safe_load(r["value"])
        if not isinstance(raw, dict) or not isinstance(raw.get("topics"), list) or not raw["topics"]:
            raise ValueError("topic seeds: a list under topics is due")
        for i, t in enumerate(raw["topics"]):
            if not isinstance(t, dict) or not {"id", "title"} <= t.keys():
                raise ValueError(f"topic seeds: entry {i} lacks id or title")
            topics.append({"id": str(t["id"]), "title": str(t["title"]), "key_facts": [str(x) for x in t.get("key_facts", [])]})
    return topic_seeds(spark, topics)


def live_corpus(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, title (in its own case), text of a manifest's documents (doc_id, filename, primary_topic) and their pages (filename, page, text), framed."""
    text = raw_documents("pdf", pages.withColumnRenamed("filename", "id")).select(F.col("id").alias("filename"), "text")
    return documents.select("doc_id", "filename", F.col("primary_topic.title").alias("title")).join(text, "filename").select("doc_id", "title", "text")


def write_report(path: str, checkpoints: DataFrame, rows: DataFrame, traversal: DataFrame) -> None:
    """One JSON object of a benchmark: checkpoints, rows and traversal_precision, each a list of a few results."""
    parts = {"checkpoints": checkpoints, "rows": rows, "traversal_precision": traversal}
    one = None
    for name, df in parts.items():
        x = df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
        one = x if one is None else one.join(x)
    one.coalesce(1).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    """A list of a benchmark's JSON object: checkpoints, rows or traversal_precision."""
    return spark.read.schema(f"{part} array<struct<{schema}>>").json(path).select(F.inline(part))


def ratings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query_id string, criterion string, human double, judge double").json(path, multiLine=True)


def write_results(rows: DataFrame, path: str) -> None:
    """One JSON object with its rows nested."""
    rows.agg(F.collect_list(F.struct(*rows.columns)).alias("rows")).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"rows array<struct<{schema}>>").json(path).select(F.inline("rows"))


DATASETS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "chat": chat_tickets,
    "mail": mail,
    "tickets_csv": tickets_csv,
    "tickets_json": tickets_json,
}


def load_dataset(spark: SparkSession, name: str, path: str, limit: int | None = None) -> DataFrame:
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name}; one of {', '.join(sorted(DATASETS))}")
    df = DATASETS[name](spark, path)
    return df.limit(limit) if limit is not None else df
