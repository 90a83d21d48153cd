"""Column functions on paths, terms, documents and scores. All are built-in expressions, so Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results have to agree on them.
#: Most distinct terms a search may have.
MAX_TERMS = 32
#: Bytes at which a file is due for a split.
SPLIT_THRESHOLD = 8192
REDIRECT_HEADER = "REDIRECT-STUB v1"
#: Words that do not begin an entity of several words.
NO_WORDS = ("the", "a", "an", "this", "that", "these", "those")
#: A run of capitalised words; letters and digits of any script bound it.
ENTITY = "(?<![\\p{L}\\p{N}_])([A-Z][a-zA-Z0-9]*(?:\\s+[A-Z][a-zA-Z0-9]*)*)(?![\\p{L}\\p{N}_])"
#: A code fence around all of an answer, with or without a tag; the line feeds next to it go with it.
FENCE = "(?s)^\\s*```[a-zA-Z0-9_+-]*\\s*\\n?(.*?)\\n?```\\s*\\z"
#: Seconds of the first synthetic time, 2024-01-01 UTC.
EPOCH = 1704067200


def split_terms(text: Column) -> Column:
    """Runs of ASCII letters and digits, case kept."""
    return F.filter(F.split(text, "[^a-zA-Z0-9]+"), lambda x: x != "")


def tokenize_terms(text: Column) -> Column:
    return split_terms(F.lower(text))


def distinct_terms(text: Column) -> Column:
    """First-seen order, case-sensitive; more than MAX_TERMS is an error."""
    terms = F.array_distinct(split_terms(text))
    return F.when(F.size(terms) > MAX_TERMS, F.raise_error(F.lit(f"more than {MAX_TERMS} distinct terms"))).otherwise(terms)


def shortlist_tokens(text: Column) -> Column:
    """As tokenize_terms, with a cut between a lower-case letter or digit and a capital."""
    return tokenize_terms(F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])", " "))


def term_counts(text: Column) -> tuple[Column, Column, Column, Column]:
    """Numbers of terms, of distinct ones, of distinct ones of tokenize_terms, and of shortlist_tokens, from one split.

    Lower case changes no term's bounds, and each cut makes one more token, but for the two characters that are not ASCII
    and whose lower case is or begins with a letter of ASCII (the Kelvin sign, the dotted capital I): texts with these are cut anew.
    """
    terms = split_terms(text)
    distinct = F.array_distinct(terms)
    odd = text.rlike("[\u0130\u212A]")
    lower = F.when(odd, F.size(F.array_distinct(tokenize_terms(text)))).otherwise(F.size(F.array_distinct(F.transform(distinct, F.lower))))
    short = F.when(odd, F.size(shortlist_tokens(text))).otherwise(F.size(terms) + F.regexp_count(text, F.lit("[a-z0-9](?=[A-Z])")))
    return F.size(terms), F.size(distinct), lower, short


def term_overlap(query: Column, path: Column) -> Column:
    """Share of the query's distinct terms that the path has; 0 without terms."""
    q = F.array_distinct(tokenize_terms(query))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, tokenize_terms(path))) / F.size(q))


def path_hash(path: Column) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, as a signed long; computed in halves of 32 bits so nothing overflows."""
    raw = F.hex(F.encode(path, "UTF-8"))
    bytes_ = F.transform(F.sequence(F.lit(0), (F.length(raw) / 2 - 1).cast("int")), lambda i: F.conv(F.substr(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    bytes_ = F.when(F.length(raw) == 0, F.array().cast("array<bigint>")).otherwise(bytes_)
    mask = F.lit(0xFFFFFFFF)

    def step(s, b):
        low = s["lo"].bitwiseXOR(b)
        p = low * 435
        return F.struct(((s["hi"] * 435 + F.shiftrightunsigned(p, 32) + F.call_function("shiftleft", low, F.lit(8))).bitwiseAND(mask)).alias("hi"), p.bitwiseAND(mask).alias("lo"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    return F.aggregate(bytes_, start, step, lambda s: F.call_function("shiftleft", s["hi"], F.lit(32)).bitwiseOR(s["lo"]))


def stripe(file_id: Column, stripes: int = 256) -> Column:
    return F.pmod(file_id, F.lit(stripes))


def is_header(line: Column) -> Column:
    """One to six # at the start, then the line's end, a blank or a tab."""
    return line.rlike("^#{1,6}([ \\t]|\\z)")


def header_offsets(content: Column) -> Column:
    """array<struct<header, offset>>: header lines, right-trimmed, with the byte at which they start."""
    lines = F.split(content, "\n")
    folded = F.aggregate(
        lines,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<header:string,offset:bigint>>").alias("out")),
        lambda s, x: F.struct(
            (s["at"] + F.octet_length(x) + 1).alias("at"),
            F.when(is_header(x), F.concat(s["out"], F.array(F.struct(F.regexp_replace(x, "[ \\t\\r]+\\z", "").alias("header"), s["at"].alias("offset"))))).otherwise(s["out"]).alias("out"),
        ),
    )
    return folded["out"]


def normalize_topic_path(path: Column) -> Column:
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^(\\./)+", "")
    p = F.regexp_replace(p, "/{2,}", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+\\z", ""))


def slice_bytes(content: Column, ranges: Column) -> Column:
    """The half-open byte ranges (array of structs start, end), one after another, as binary."""
    raw = content.cast("binary")
    return F.aggregate(ranges, F.lit(b""), lambda a, r: F.concat(a, F.substr(raw, (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int"))))


def char_to_byte_offset(text: Column, chars: Column) -> Column:
    return F.octet_length(F.substr(text, F.lit(1), chars))


def redirect_stub(ids: Column, header: str = REDIRECT_HEADER) -> Column:
    return F.concat(F.lit(header + "\n"), F.array_join(F.transform(ids, lambda x: F.concat(x.cast("string"), F.lit("\n"))), ""))


def entity_key(name: Column, file_id: Column) -> Column:
    return F.concat(F.lit("\0entity\0"), name, F.lit("\0"), F.lpad(file_id.cast("string"), 20, "0"))


def normalize_subject(subject: Column) -> Column:
    """Without reply and forward marks at its start, white space collapsed, lower case."""
    s = F.regexp_replace(subject, "(?i)^\\s*(?:(?:re|fwd?)\\s*:\\s*)+", "")
    return F.lower(F.trim(F.regexp_replace(s, "\\s+", " ")))


def thread_key(in_reply_to: Column, references: Column, subject: Column) -> Column:
    """The message replied to, else the first reference, else the normalised subject."""
    reply = F.nullif(F.trim(in_reply_to), F.lit(""))
    first = F.nullif(F.regexp_extract(references, "(\\S+)", 1), F.lit(""))
    return F.coalesce(reply, first, F.concat(F.lit("subject:"), normalize_subject(F.coalesce(subject, F.lit("")))))


def ticket_blob(t: str = "ticket") -> Column:
    """Labelled lines of a ticket struct, then its comments in frames that state their length."""
    c = lambda name: F.coalesce(F.col(f"{t}.{name}").cast("string"), F.lit(""))
    labels = ("ticket_id", "subject", "status", "priority", "category", "requester", "assignee", "created_at")
    comments = F.coalesce(F.col(f"{t}.comments"), F.array().cast("array<struct<author:string,body:string>>"))
    head = [F.concat(F.lit(f"{x.upper()}: "), c(x)) for x in labels]
    head += [F.concat(F.lit("DESCRIPTION:\n"), c("description")), F.concat(F.lit("COMMENTS: "), F.size(comments).cast("string"))]

    def frame(x, i):
        body = F.concat(F.lit("AUTHOR: "), F.coalesce(x["author"], F.lit("")), F.lit("\nBODY:\n"), F.coalesce(x["body"], F.lit("")), F.lit("\n"))
        n = (i + 1).cast("string")
        return F.concat(F.lit("[[COMMENT "), n, F.lit(" LEN="), F.length(body).cast("string"), F.lit("]]\n"), body, F.lit("[[/COMMENT "), n, F.lit("]]\n"))

    return F.concat(F.concat_ws("\n", *head), F.lit("\n"), F.array_join(F.transform(comments, frame), ""))


def frame_page(text: Column, page: Column) -> Column:
    """A page between its markers; a page that is not empty ends in a line feed; the length is in characters."""
    body = F.when((text == "") | text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))
    n = page.cast("string")
    return F.concat(F.lit("[[PAGE "), n, F.lit(" LEN="), F.length(body).cast("string"), F.lit("]]\n"), body, F.lit("[[/PAGE "), n, F.lit("]]\n"))


def strip_code_fence(raw: Column) -> Column:
    """What one fence around the whole answer holds; any other text as it is."""
    return F.when(raw.rlike(FENCE), F.regexp_extract(raw, FENCE, 1)).otherwise(raw)


def canonical_entity(name: Column) -> Column:
    return F.lower(F.trim(name))


def heuristic_entities(text: Column) -> Column:
    """Runs of capitalised words; of more than one word a leading article or demonstrative goes.

    Letters and digits of any script bound a word, so an accent keeps its own word out and no other.
    """
    runs = F.regexp_extract_all(text, F.lit(ENTITY), 1)

    def clean(run):
        words = F.split(run, "\\s+")
        cut = F.when((F.size(words) > 1) & F.lower(words[0]).isin(*NO_WORDS), F.slice(words, F.lit(2), F.size(words))).otherwise(words)
        return F.array_join(cut, " ")

    return F.transform(runs, clean)


def rerank_order(response: Column, n: Column) -> Column:
    """A permutation of 1..n: numbers of the response in range, first-seen, then those missing."""
    found = F.transform(F.regexp_extract_all(response, F.lit("(\\d+)"), 1), lambda x: x.try_cast("int"))  # a number too large is out of range
    fitting = F.filter(found, lambda x: (x >= 1) & (x <= n))
    every = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(fitting, every))


def recall_at_k(ids: Column, relevant: Column, k: int) -> Column:
    top = F.slice(ids, 1, k) if k > 0 else F.slice(ids, 1, 0)
    return F.when(F.size(relevant) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(top, relevant)) / F.size(F.array_distinct(relevant)))


def precision_at_k(ids: Column, relevant: Column, k: int) -> Column:
    if k <= 0:
        return F.lit(1.0)
    top = F.slice(ids, 1, k)
    return F.when(F.size(top) == 0, F.lit(0.0)).otherwise(F.size(F.filter(top, lambda x: F.array_contains(relevant, x))) / F.size(top))


def dot(a: Column, b: Column) -> Column:
    """In double precision."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 if either norm is 0."""
    both = norm(a) * norm(b)
    return F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / both)


def provided_paths(context: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(context, F.lit("(?m)^##\\s*File:\\s*(.+?)\\s*$"), 1))


def unknown_citations(citations: Column, provided: Column) -> Column:
    return F.array_except(citations, provided)


def file_block(path: Column, content: Column) -> Column:
    return F.concat(F.lit("## File: "), path, F.lit("\n"), content, F.lit("\n"))


def resolve_cost(cost: Column, provider: Column) -> Column:
    """The stated cost, else 0 for the free local provider, else an error."""
    return F.coalesce(cost, F.when(F.lower(provider) == "ollama", F.lit(0.0)).otherwise(F.raise_error(F.concat(F.lit("no cost for provider "), provider)).cast("double")))


def crossing(old: Column, new: Column, threshold: int = SPLIT_THRESHOLD) -> Column:
    """old <= threshold < new."""
    return (old <= threshold) & (new > threshold)


def is_json(text: Column) -> Column:
    """Whether the text is one JSON value and nothing else: the parser alone would stop after the first."""
    one = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return F.coalesce(F.size(one) == 1, F.lit(False))


def hop_decay(hop: Column) -> Column:
    return F.pow(F.lit(0.5), hop)


def synthetic_time(index: Column) -> Column:
    """2024-01-01 plus index minutes, as ISO text with the offset of UTC, whatever the session's zone."""
    t = F.timestamp_seconds(F.lit(EPOCH) + index.cast("long") * 60)
    return F.concat(F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def chunk_words(text: Column, size: int, overlap: int) -> Column:
    """array<struct<start_word, end_word, text>>: windows of size words, stride size - overlap; none begins after one has reached the end."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap smaller")
    words = F.filter(F.split(text, "\\s+"), lambda x: x != "")
    stride = size - overlap

    def windows(bound):  # over the words once they are cut: an expression inside a lambda is computed for each element
        w = bound["w"]
        n = F.size(w)
        chunks = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / stride).cast("int") + 1)
        starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), chunks - 1), lambda i: i * stride)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.struct(s.alias("start_word"), F.least(s + size, n).alias("end_word"), F.array_join(F.slice(w, s + 1, size), " ").alias("text")))

    return F.transform(F.array(F.struct(words.alias("w"))), windows)[0]
