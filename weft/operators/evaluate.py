"""Evaluation: retrieval metrics, costs and latencies, judging, corpus growth, retrieval baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .number import numbered
from .scan import scan
from .shared import new_dir, staged

FREE = "ollama"
#: Fixed values of the chunk grid: words of a chunk, and shares of them that overlap.
CHUNK_SIZES, OVERLAP_SHARES = (80, 150, 220), (0.0, 0.15, 0.30)


def chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, chunk_id, chunk_no, start_word, end_word, text."""
    x = docs.select("doc_id", F.posexplode(T.chunk_words(F.col("text"), size, overlap)).alias("chunk_no", "c"))
    return x.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("::chunk"), F.col("chunk_no").cast("string")).alias("chunk_id"), "chunk_no", "c.start_word", "c.end_word", "c.text")


#: Queries and vectors of a block; scores that a task holds at once, and pairs that it scores term by term at once.
QUERY_BLOCK, VECTOR_BLOCK, SCORES_AT_ONCE, AT_ONCE = 8192, 16384, 1 << 21, 1 << 16
#: Stretches of a block's keys whose largest products bound a query's k-th one; they are 4 * k at least.
STRETCHES = 512


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6, by: str | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: exhaustive cosine, a stated query set against all other vectors. With by, a column of vectors
    (its documents), a row is one of these with the score of its best vector: query_id, by, score, rank. Ties go to the smaller id.

    Blocks of queries meet blocks of vectors, each pair of blocks, by its number, in a task of its own: one product of matrices, from which
    the first k of each query go on, in their exact order: products, in single precision, only choose, and what may be
    among the first, given their error, is scored term by term as vector_scores does.
    """
    key = by or "vec_id"
    if k <= 0:
        s = vector_scores(queries, vectors.select("vec_id", "embedding", *([by] if by else [])), digits).select("query_id", key, "score")
        return s.withColumn("rank", F.lit(0)).where(F.lit(False))
    q = queries.where("query_id is not null").select(F.col("query_id").alias("query_id"), F.col("embedding").alias("q"))  # columns of its own, as both may come from one table
    v = vectors.where("vec_id is not null").select("vec_id", F.col(key).alias("key"), "embedding")
    nq, nv = -(-q.count() // QUERY_BLOCK) or 1, -(-v.count() // VECTOR_BLOCK) or 1
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("qb", deal("query_id", nq)).withColumn("vb", every(nv))
    v = v.withColumn("vb", deal("key", nv)).withColumn("qb", every(nq))
    kinds = f"query_id {q.schema['query_id'].dataType.simpleString()}, {key} {v.schema['key'].dataType.simpleString()}, score double"
    q, v = (x.withColumn("pair", F.col("qb") * nv + F.col("vb")).drop("qb", "vb").repartitionById(nq * nv, "pair").groupBy("pair") for x in (q, v))
    pairs = v.cogroup(q)
    x = pairs.applyInArrow(_best_of_blocks(k, digits, key, by is not None), kinds).withColumn("score", F.round("score", digits))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))).where(F.col("rank") <= k)


def _matrix(column):
    """Vectors as rows of doubles, cut or filled to one length; and which of them are null, hold a null, or have which length."""
    import numpy as np
    import pyarrow.compute as pc

    x = column.combine_chunks()
    n = np.asarray(pc.fill_null(pc.list_value_length(x), -1)).astype(np.int64)
    flat = x.flatten()
    nulls = np.asarray(pc.is_null(flat))
    flat = np.asarray(pc.fill_null(flat, 0)).astype(np.float64)
    width = int(n.max(initial=0))
    out, missing = np.zeros((len(n), width)), n < 0
    held = np.arange(width) < n[:, None]
    out[held] = flat
    bad = np.zeros(held.shape, bool)
    bad[held] = nulls
    return out, np.maximum(n, 0), missing | bad.any(axis=1)


def _rounded(x, digits: int):
    """x rounded half up in decimal, as Spark rounds doubles; values next to a half by their shortest decimal."""
    from decimal import ROUND_HALF_UP, Decimal

    import numpy as np

    scaled = x * 10.0**digits
    with np.errstate(invalid="ignore"):
        out = np.where(scaled >= 0, np.floor(scaled + 0.5), np.ceil(scaled - 0.5))
        close = np.flatnonzero(np.isfinite(scaled) & (np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5) < 1e-6))
    if len(close):
        values, back = np.unique(x[close], return_inverse=True)
        out[close] = np.array([float(Decimal(repr(float(y))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP).scaleb(digits)) for y in values])[back]
    return out


def _best_of_blocks(k: int, digits: int, key: str, grouped: bool):
    """A function from a block of vectors (vec_id, key, embedding) and one of queries (query_id, q) to the first k keys of each query."""

    def sequential(a, b):  # term by term, as an aggregate over the arrays adds
        import numpy as np

        s = np.zeros(len(a))
        for j in range(a.shape[1]):
            s = s + a[:, j] * b[:, j]
        return s

    def best(vectors, queries):
        import numpy as np
        import pyarrow as pa

        key_type, id_type = vectors.schema.field("key").type, queries.schema.field("query_id").type
        schema = pa.schema([("query_id", id_type), (key, key_type), ("score", pa.float64())])
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        vectors = vectors.sort_by([("key", "ascending"), ("vec_id", "ascending")])
        keys = vectors.column("key").combine_chunks()
        key_no = _numbers(keys)
        v, v_len, v_bad = _matrix(vectors.column("embedding"))
        q, q_len, q_bad = _matrix(queries.column("q"))
        width = max(v.shape[1], q.shape[1])
        v, q = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (v, q))
        own_row, own_col = _own(queries.column("query_id").to_pylist(), vectors.column("vec_id").to_pylist())
        with np.errstate(all="ignore"):
            nv, nq = np.sqrt(sequential(v, v)), np.sqrt(sequential(q, q))
            unit_v, unit_q = v / np.where(nv > 0, nv, 1)[:, None], q / np.where(nq > 0, nq, 1)[:, None]
        # vectors that a product says nothing reliable of are always scored
        odd_v, odd_q = (~np.isfinite(u).all(axis=1) | ~np.isfinite(n) | (n > 0) & (n < 1e-140) for u, n in ((unit_v, nv), (unit_q, nq)))
        unit_v[odd_v], unit_q[odd_q] = 0, 0
        unit_v, unit_q = unit_v.astype(np.float32), unit_q.astype(np.float32)
        margin = 2 * 10.0**-digits + 1e-9 + (width + 8) * 2.0**-22  # the last term is twice what two products of unit vectors may be off
        odd, partial = odd_v.any() or odd_q.any(), v_bad.any() or q_bad.any() or len(np.union1d(v_len, q_len)) > 1
        first = np.flatnonzero(np.diff(key_no, prepend=-1)) if grouped else np.arange(len(v))
        n_stretches = max(STRETCHES, 4 * k)
        turns = len(first) == len(v)  # stretches take vectors of keys of their own in turns
        starts = first[:: max(1, len(first) // n_stretches)]  # no key is in two stretches
        take_q, take_v, scores = [], [], []

        def choose(row, col, last):  # the first k of what may be among them, of whole rows of queries
            with np.errstate(all="ignore"):
                both = nv[col] * nq[row]
                dots = [sequential(q[row[i : i + AT_ONCE]], v[col[i : i + AT_ONCE]]) for i in range(0, len(row), AT_ONCE)]
                exact = np.where(both == 0, 0.0, np.concatenate([np.zeros(0), *dots]) / both)
            order = np.where(last, -np.inf, np.where(np.isnan(exact), np.inf, _rounded(np.where(np.isfinite(exact), exact, 0.0), digits)))
            order = np.where(~last & np.isinf(exact), np.sign(exact) * 1e300, order)
            by = np.lexsort((col, -order, row))  # columns are in order of keys
            row, col, exact, last = row[by], col[by], exact[by], last[by]
            if grouped:  # a key's best vector is its first
                pair = row.astype(np.int64) * len(v) + key_no[col]
                keep = np.sort(np.unique(pair, return_index=True)[1])
                row, col, exact, last = row[keep], col[keep], exact[keep], last[keep]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            keep = place < k
            take_q.append(row[keep])
            take_v.append(col[keep])
            scores.append(pa.array(exact[keep], mask=last[keep]))

        step, held, n_held = max(1, SCORES_AT_ONCE // len(v)), [], 0
        for a in range(0, len(q), step):
            some = slice(a, min(len(q), a + step))
            about = unit_q[some] @ unit_v.T
            if odd:
                about[:, odd_v] = -7.0  # bounds nothing
            if partial:
                about[v_bad[None, :] | q_bad[some, None] | (v_len[None, :] != q_len[some, None]) & (nv[None, :] * nq[some, None] != 0)] = -3.0  # null scores come last
            mine = slice(*np.searchsorted(own_row, (a, some.stop)))
            about[own_row[mine] - a, own_col[mine]] = -9.0
            most = _largest(about, n_stretches) if turns else np.maximum.reduceat(about, starts, axis=1)  # k keys reach the k-th of these
            n = most.shape[1]
            least = np.partition(most, n - k, axis=1)[:, n - k].astype(np.float64) if n > k else np.full(len(most), -8.0)
            least = np.nextafter(np.maximum(least - margin, -8.0).astype(np.float32), np.float32(-np.inf))
            if turns and not odd:
                row, col = _reaching(about, most, least)
            else:
                near = about >= least[:, None]
                if odd:
                    near |= (odd_v[None, :] | odd_q[some, None]) & (about > -8.5)
                row, col = np.divmod(np.flatnonzero(near), len(v))
            held.append((row + a, col, about[row, col] == -3.0 if partial else np.zeros(len(row), bool)))
            n_held += len(row)
            if n_held >= AT_ONCE or some.stop == len(q):
                choose(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, n_held = [], 0
        q_at, v_at = (np.concatenate(x) for x in (take_q, take_v))
        out = [queries.column("query_id").combine_chunks().take(pa.array(q_at)), keys.take(pa.array(v_at)), pa.concat_arrays(scores)]
        return pa.Table.from_arrays(out, schema=schema)

    return best


def _largest(about, n: int):
    """The largest of each row's n stretches, which take columns in turns: i, i + n, i + 2n, .."""
    import numpy as np

    most = about[:, :n].copy()
    for i in range(n, about.shape[1], n):
        some = about[:, i : i + n]
        held = most[:, : some.shape[1]]
        np.maximum(held, some, out=held)
    return most


def _reaching(about, most, least):
    """Rows and columns of what is at least its row's least; only stretches whose largest is are looked through."""
    import numpy as np

    row, stretch = np.nonzero(most >= least[:, None])
    col = stretch[:, None] + np.arange(0, about.shape[1], most.shape[1])
    row, col = np.repeat(row, col.shape[1]), col.ravel()
    row, col = row[col < about.shape[1]], col[col < about.shape[1]]
    near = about[row, col] >= least[row]
    return row[near], col[near]


def _own(query_ids, vec_ids):
    """The places of each query and of the vectors of its own id, in order of queries."""
    import numpy as np

    at = {}
    for i, x in enumerate(vec_ids):
        at.setdefault(x, []).append(i)
    own = [(i, j) for i, x in enumerate(query_ids) for j in at.get(x, [])]
    return np.array(own, np.int64).reshape(-1, 2).T


def _numbers(keys):
    """The number of each of sorted keys among the distinct ones."""
    import numpy as np
    import pyarrow.compute as pc

    if len(keys) < 2:
        return np.zeros(len(keys), np.int64)
    a, b = keys.slice(1), keys.slice(0, len(keys) - 1)
    new = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
    return np.append(0, np.cumsum(np.asarray(new).astype(np.int64)))


def vector_scores(queries: DataFrame, vectors: DataFrame, digits: int = 6) -> DataFrame:
    """query_id, vec_id, score and the vectors' other columns for each query with all other vectors; norms are taken once a vector."""
    q = queries.select("query_id", F.col("embedding").alias("q"), T.norm(F.col("embedding")).alias("__nq"))
    v = vectors.withColumn("__nv", T.norm(F.col("embedding")))
    both = F.col("__nv") * F.col("__nq")
    score = F.when(both == 0, F.lit(0.0)).otherwise(T.dot(F.col("embedding"), F.col("q")) / both)
    return v.join(q, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(score, digits).alias("score"), *[c for c in vectors.columns if c not in ("vec_id", "embedding")])


def best_chunk(scored: DataFrame, k: int, doc: str = "doc_id") -> DataFrame:
    """A document's score is that of its best chunk; k documents a query, ties to the smaller id."""
    best = scored.groupBy("query_id", doc).agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), doc))).where(F.col("rank") <= k)


def retrieval_scores(queries: DataFrame, retrieved: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """query_id, recall, precision; a query without rows in retrieved retrieved nothing. retrieved: query_id, doc_id, rank; qrels: query_id, doc_id."""
    rel = qrels.select("query_id", "doc_id").distinct()
    n = rel.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    top = retrieved.where(F.col("rank") <= max(k, 0)).select("query_id", "doc_id", "rank")
    x = _recall(queries, top.join(rel.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left"), n, [k], ["query_id"])
    return x.select("query_id", F.col("cuts")[0]["recall"].alias("recall"), F.col("cuts")[0]["precision"].alias("precision"))


def labelled_scores(queries: DataFrame, retrieved: DataFrame, labels: DataFrame, k: int, *keys: str) -> DataFrame:
    """retrieval_scores where all other documents of the query's label are relevant, without the pairs: these are counted a label.

    queries: query_id, label (null: nothing is relevant); labels: doc_id, label; all may have further keys, which are kept apart.
    """
    return labelled_cuts(queries, retrieved, labels, [k], *keys).select(*keys, "query_id", F.col("cuts")[0]["recall"].alias("recall"), F.col("cuts")[0]["precision"].alias("precision"))


def labelled_cuts(queries: DataFrame, retrieved: DataFrame, labels: DataFrame, ks: list[int], *keys: str) -> DataFrame:
    """labelled_scores at several cuts of the retrieved lists, which meet the labels once: the keys, query_id and cuts, an array of (k, recall, precision) in order of ks."""
    own = [*keys, "query_id"]
    d = labels.where("label is not null").select(*keys, "doc_id", "label").distinct()
    itself = d.select(*keys, F.col("doc_id").alias("query_id"), "label", F.lit(1).alias("itself"))
    n = queries.join(d.groupBy(*keys, "label").agg(F.count("*").alias("n")), [*keys, "label"]).join(itself, [*own, "label"], "left")
    n = n.select(*own, (F.col("n") - F.coalesce("itself", F.lit(0))).alias("n_rel")).where("n_rel > 0")
    top = retrieved.where(F.col("rank") <= max(0, *ks)).select(*own, "doc_id", "rank").join(queries.select(*own, "label"), own)
    hit = top.join(d.withColumn("same", F.lit(1)), [*keys, "doc_id", "label"], "left").withColumn("hit", F.when(F.col("doc_id") != F.col("query_id"), F.col("same")))
    return _recall(queries, hit, n, ks, own)


def _recall(queries: DataFrame, hit: DataFrame, n: DataFrame, ks: list[int], own: list[str]) -> DataFrame:
    within = [F.count_if(F.col("rank") <= max(k, 0)).alias(f"n{i}") for i, k in enumerate(ks)]
    docs = hit.groupBy(*own, "doc_id").agg(F.max("hit").alias("hit"), *within)
    sums = [(F.sum(f"n{i}").alias(f"n_top{i}"), F.sum(F.when(F.col("hit") == 1, F.col(f"n{i}"))).alias(f"hits{i}"), F.count_if((F.col("hit") == 1) & (F.col(f"n{i}") > 0)).alias(f"found{i}")) for i in range(len(ks))]
    x = queries.select(*own).join(docs.groupBy(*own).agg(*[c for three in sums for c in three]), own, "left").join(n, own, "left")

    def cut(i, k):
        recall = F.when(F.col("n_rel").isNull(), F.lit(1.0)).otherwise(F.coalesce(f"found{i}", F.lit(0)) / F.col("n_rel"))
        precision = F.lit(1.0) if k <= 0 else F.coalesce(F.when(F.col(f"n_top{i}") > 0, F.col(f"hits{i}") / F.col(f"n_top{i}")), F.lit(0.0))
        return F.struct(F.lit(k).alias("k"), recall.alias("recall"), precision.alias("precision"))

    return x.select(*own, F.array(*[cut(i, k) for i, k in enumerate(ks)]).alias("cuts"))


def holders(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, doc_id: the documents that hold a query's whole text. queries: query_id, text; docs: doc_id, text.

    What stands between two blanks of the query stands so in the document: the longest such piece finds the documents that may
    hold it, and only their texts are searched. Queries without one meet all documents.
    """
    pieces = F.split("text", " ")
    longest = F.reduce(F.slice(pieces, F.lit(2), F.greatest(F.lit(0), F.size(pieces) - 2)), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    q = queries.where("text is not null").select("query_id", F.col("text").alias("asked"), longest.alias("piece"))
    d = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("whole"))
    held = docs.select(F.col("doc_id").alias("held_by"), F.explode(F.array_distinct(pieces)).alias("piece"))
    near = held.join(q.where("piece <> ''"), "piece").select("held_by", "query_id", "asked").distinct()
    contains = F.col("whole").contains(F.col("asked"))
    found = d.join(near, F.col("doc_id").eqNullSafe(F.col("held_by"))).where(contains).select("query_id", "doc_id")
    return found.unionByName(d.join(q.where("piece = ''"), contains).select("query_id", "doc_id"))


def relevant(truth: DataFrame, include_cross_reference: bool = True) -> DataFrame:
    """query_id, doc_id of ground truth (query_id, doc_id, label): primary documents, and those of cross references if they count."""
    x = truth if include_cross_reference else truth.where(F.col("label") == "primary")
    return x.select("query_id", "doc_id").distinct()


def lexical_scores(queries: DataFrame, docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """query_id, doc_id, score: the most distinct terms of the query that one chunk of the document has."""
    c = chunks(docs, size, overlap).select("doc_id", "chunk_no", F.explode(F.array_distinct(T.tokenize_terms(F.col("text")))).alias("term"))
    q = queries.select("query_id", F.explode(F.array_distinct(T.tokenize_terms(F.col("text")))).alias("term"))
    s = c.join(q, "term").groupBy("query_id", "doc_id", "chunk_no").agg(F.count("*").alias("n"))
    return s.groupBy("query_id", "doc_id").agg(F.max("n").cast("double").alias("score"))


#: Queries of a block and bytes of text of a block of documents that meet in one task; entries of a matrix that it holds at once.
GRID_QUERIES, GRID_BYTES, ENTRIES_AT_ONCE = 256, 2 << 20, 1 << 22


def lexical_grid(queries: DataFrame, docs: DataFrame, cells: list[tuple[int, int]], k: int | None = None) -> DataFrame:
    """size, overlap, query_id, doc_id, score: lexical_scores for all cells (size, overlap) of a grid in one pass.

    Blocks of documents meet blocks of queries. A block cuts its texts into words once and tokenises each distinct word once; for
    a cell, chunks by terms times terms by queries are the counts. With k, the first k documents of each query and cell
    (ties to the smaller id) are among a block's first k, and no others leave it.
    """
    if any(size <= 0 or not 0 <= overlap < size for size, overlap in cells):
        raise ValueError("sizes must be positive and overlaps smaller")
    q = queries.select(F.col("query_id").alias("query_id"), F.array_distinct(T.tokenize_terms(F.col("text"))).alias("terms")).where(F.size("terms") > 0)
    d = docs.select(F.col("doc_id").alias("doc_id"), F.lower("text").alias("text")).where("text is not null")
    nq = -(-q.count() // GRID_QUERIES) or 1
    nd = -(-(d.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // GRID_BYTES) or 1
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("qb", deal("query_id", nq)).withColumn("db", every(nd))
    d = d.withColumn("db", deal("doc_id", nd)).withColumn("qb", every(nq))
    kinds = f"size int, overlap int, query_id {q.schema['query_id'].dataType.simpleString()}, doc_id {d.schema['doc_id'].dataType.simpleString()}, score double"
    pairs = d.repartition(nq * nd, "qb", "db").groupBy("qb", "db").cogroup(q.groupBy("qb", "db"))
    return pairs.applyInArrow(_grid_of_blocks(cells, k), kinds)


def _grid_of_blocks(cells: list[tuple[int, int]], k: int | None):
    """A function from a block of documents (doc_id, text in lower case) and one of queries (query_id, terms) to the rows of lexical_grid."""

    def occurrences(texts, number):
        """The words of each text, and of each occurrence of a numbered term its text, the place of its word and its number."""
        import re

        import numpy as np
        import pyarrow.compute as pc

        cut = pc.split_pattern_regex(texts, "[ \\t\\n\\x0B\\f\\r]+")
        row = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(cut)))
        words = cut.flatten().dictionary_encode()
        full = np.asarray(pc.not_equal(words.dictionary, "")).astype(bool)
        word = np.asarray(words.indices).astype(np.int64)
        row, word = row[full[word]], word[full[word]]
        n = np.bincount(row, minlength=len(texts))
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        terms = [[number[x] for x in set(re.findall("[a-z0-9]+", w)) if x in number] for w in words.dictionary.to_pylist()]
        many = np.array([len(x) for x in terms], np.int64)
        flat, start = np.array([x for y in terms for x in y], np.int64), np.cumsum(many) - many
        m = many[word]
        return n, np.repeat(row, m), np.repeat(at, m), flat[np.repeat(start[word], m) + within(m)]

    def within(m):  # 0, 1, .. up to each of m
        import numpy as np

        return np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)

    def best(docs, queries):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        id_type, doc_type = queries.schema.field("query_id").type, docs.schema.field("doc_id").type
        schema = pa.schema([("size", pa.int32()), ("overlap", pa.int32()), ("query_id", id_type), ("doc_id", doc_type), ("score", pa.float64())])
        if not docs.num_rows or not queries.num_rows:
            return schema.empty_table()
        docs = docs.take(pc.sort_indices(docs.column("doc_id"), null_placement="at_start"))
        ids = docs.column("doc_id").combine_chunks()
        doc_no = _numbers(ids)  # rows of one id are one document
        first = np.flatnonzero(np.diff(doc_no, prepend=-1))
        asked = queries.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
        held = queries.column("terms").combine_chunks()
        of = np.repeat(np.asarray(asked.indices), np.asarray(pc.list_value_length(held)))
        flat = held.flatten().to_pylist()
        number = {x: i for i, x in enumerate(dict.fromkeys(flat))}
        n, row, at, term = occurrences(docs.column("text").combine_chunks(), number)
        used, term = np.unique(term, return_inverse=True)  # the matrices have the terms that occur
        place = np.full(len(number), -1)
        place[used] = np.arange(len(used))
        column = place[[number[x] for x in flat]]
        asks = np.zeros((len(used), len(asked.dictionary)), np.float32)
        asks[column[column >= 0], of[column >= 0]] = 1
        out = []
        for size, overlap in cells:
            stride = size - overlap
            chunks = np.where(n <= size, 1, -(-(n - size) // stride) + 1)
            slots = np.maximum.reduceat(chunks, first)
            base = np.cumsum(slots) - slots
            low, high = np.maximum(0, -(-(at - size + 1) // stride)), np.minimum(chunks[row] - 1, at // stride)
            m = high - low + 1
            chunk, terms = np.repeat(base[doc_no[row]] + low, m) + within(m), np.repeat(term, m)
            order = np.argsort(chunk, kind="stable")
            chunk, terms = chunk[order], terms[order]
            doc_of, score = np.repeat(np.arange(len(slots)), slots), np.zeros((len(slots), asks.shape[1]), np.float32)
            step = max(1, ENTRIES_AT_ONCE // max(1, *asks.shape))
            for a in range(0, len(doc_of), step):
                b = min(len(doc_of), a + step)
                some = slice(*np.searchsorted(chunk, [a, b]))
                x = np.zeros((b - a, len(used)), np.float32)
                x[chunk[some] - a, terms[some]] = 1
                mine = doc_of[a:b]
                cut = np.flatnonzero(np.diff(mine, prepend=-1))
                score[mine[cut]] = np.maximum(score[mine[cut]], np.maximum.reduceat(x @ asks, cut, axis=0))
            near = score > 0
            if k is not None and 0 < k < len(score):
                near &= score >= np.partition(score, len(score) - k, axis=0)[len(score) - k]
            doc, query = np.nonzero(near)
            if k is not None:
                order = np.lexsort((doc, -score[doc, query], query))  # documents are in order of ids
                doc, query = doc[order], query[order]
                keep = np.arange(len(query)) - np.searchsorted(query, query) < k
                doc, query = doc[keep], query[keep]
            fixed = [pa.array(np.full(len(doc), x), pa.int32()) for x in (size, overlap)]
            out.append(pa.Table.from_arrays([*fixed, asked.dictionary.take(pa.array(query)), ids.take(pa.array(first[doc])), pa.array(score[doc, query].astype(np.float64))], schema=schema))
        return pa.concat_tables(out)

    return best


def chunk_grid(queries: DataFrame, docs: DataFrame, qrels: DataFrame, k: int = 3, scores=None, sizes: tuple = CHUNK_SIZES, shares: tuple = OVERLAP_SHARES) -> DataFrame:
    """size, overlap, mean_recall, best: recall of the first k documents for each chunk size and overlap; of equal recalls the smaller size, then the smaller overlap is best.

    scores(queries, docs, size, overlap) gives query_id, doc_id, score of a cell by a model's vectors; without it terms score, all cells in one pass.
    """
    cells = [(size, int(size * share)) for size in sizes for share in shares]
    in_cell = lambda df: df.select(F.struct("size", "overlap", "query_id").alias("query_id"), *[c for c in df.columns if c not in ("size", "overlap", "query_id")])
    if scores is None:
        scored = lexical_grid(queries, docs, cells, k)
    else:
        scored = None
        for size, overlap in cells:
            x = scores(queries, docs, size, overlap).select(F.lit(size).alias("size"), F.lit(overlap).alias("overlap"), "query_id", "doc_id", "score")
            scored = x if scored is None else scored.unionByName(x)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.lit(o).alias("overlap")) for s, o in cells])).alias("cell")
    spread = lambda df: df.select("*", each).select("cell.size", "cell.overlap", *df.columns)
    got = best_chunk(in_cell(scored), k)
    x = retrieval_scores(in_cell(spread(queries.select("query_id"))), got, in_cell(spread(qrels.select("query_id", "doc_id"))), k)
    means = x.groupBy("query_id.size", "query_id.overlap").agg(F.coalesce(F.avg("recall"), F.lit(0.0)).alias("mean_recall"))
    grid = queries.sparkSession.createDataFrame(cells, "size int, overlap int")
    out = grid.join(means, ["size", "overlap"], "left").select("size", "overlap", F.coalesce("mean_recall", F.lit(0.0)).alias("mean_recall"))
    order = Window.orderBy(F.desc("mean_recall"), "size", "overlap")  # a row for each cell of the grid
    return out.withColumn("best", F.row_number().over(order) == 1)


def arm_scores(scores: DataFrame) -> DataFrame:
    return scores.groupBy("arm").agg(F.coalesce(F.avg("recall"), F.lit(0.0)).alias("mean_recall"), F.coalesce(F.avg("precision"), F.lit(0.0)).alias("mean_precision"), F.count("*").alias("num_queries"))


def expansion_delta(with_: DataFrame, without: DataFrame) -> DataFrame:
    a, b = with_.select("query_id", F.col("precision").alias("expanded")), without.select("query_id", F.col("precision").alias("plain"))
    return deltas(a.join(b, "query_id"))


def deltas(both: DataFrame) -> DataFrame:
    """expansion_delta where both precisions of a query, expanded and plain, are in one row."""
    return both.select("query_id", "expanded", "plain", (F.col("expanded") - F.col("plain")).alias("delta"), (F.col("expanded") < F.col("plain")).alias("hurt"))


def stage_aggregate(stages: DataFrame) -> DataFrame:
    """Per arm and stage: calls, total and mean seconds, total cost (resolved)."""
    cost = T.resolve_cost(F.col("cost_usd"), F.col("provider"))
    return stages.groupBy("arm", "stage").agg(F.count("*").alias("call_count"), F.sum("duration_seconds").alias("total_seconds"), F.avg("duration_seconds").alias("mean_seconds"), F.sum(cost).alias("total_cost"))


def first_seen(groups: DataFrame, records: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    """groups with position, from 1: the place of a group's first record among all groups' first records. One row a group is ordered."""
    first = records.groupBy(*keys).agg(F.min(order).alias("__first"))
    return groups.join(first, list(keys)).withColumn("position", F.row_number().over(Window.orderBy("__first"))).drop("__first")


def cost_rollup_nested(stages: DataFrame) -> DataFrame:
    """cost_rollup with the arms' stages: an array of structs in first-seen order (a few stages an arm)."""
    s = first_seen(stage_aggregate(stages), stages, "arm", "stage")
    cols = [c for c in s.columns if c not in ("arm", "position")]
    nested = s.groupBy("arm").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", *cols))), lambda x: F.struct(*[x[c].alias(c) for c in cols])).alias("stages"))
    return first_seen(cost_rollup(stages).join(nested, "arm"), stages, "arm")


def cost_rollup(stages: DataFrame) -> DataFrame:
    """Per arm: queries (distinct ids; rows if there is no id at all), total cost, cost per 1000 queries."""
    cost = T.resolve_cost(F.col("cost_usd"), F.col("provider"))
    x = stages.groupBy("arm").agg(F.countDistinct("query_id").alias("ids"), F.count("*").alias("n"), F.sum(cost).alias("total_cost"))
    q = F.when(F.col("ids") == 0, F.col("n")).otherwise(F.col("ids"))
    return x.select("arm", q.alias("query_count"), "total_cost", (F.col("total_cost") / q * 1000).alias("cost_per_1000_queries"))


def token_cost(calls: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds cost_usd by provider (lower case) and model; unknown pairs of a provider that is not free are an error. rates is a short table."""
    r = rates.select(F.col("provider").alias("rp"), F.col("model").alias("rm"), "prompt_rate", "completion_rate")
    x = calls.join(F.broadcast(r), (F.lower("provider") == F.col("rp")) & (F.col("model") == F.col("rm")), "left")
    free = F.lower("provider") == FREE
    price = F.col("prompt_tokens") / 1000 * F.col("prompt_rate") + F.col("completion_tokens") / 1000 * F.col("completion_rate")
    return x.withColumn("cost_usd", F.when(free, 0.0).otherwise(F.coalesce(price, F.raise_error(F.lit("no rate")).cast("double")))).drop("rp", "rm", "prompt_rate", "completion_rate")


def running_cap(calls: DataFrame, cap: float, by: str = "arm", order: str = "seq", bound: int | None = None) -> DataFrame:
    """spent_before and refused: once what was spent reaches the cap, paid calls are refused and add nothing; calls of the free
    provider go on and add what they cost. Costs are not negative.

    Up to the first call that meets a reached cap nothing was refused, so that is a plain sum; from there on only the sum of
    free calls grows. Both are scans inside arms.
    """
    free = F.lower("provider") == FREE
    cost = F.coalesce("cost_usd", F.lit(0))
    sums = {"__all": (F.sum, cost), "__free": (F.sum, F.when(free, cost).otherwise(F.lit(0)))}
    x = scan(calls, [by], order, sums, bound=bound).fillna(0, ["__all", "__free"])
    reached = x.where(F.col("__all") >= cap).groupBy(by).agg(F.min_by(F.struct("__all", "__free"), order).alias("__at"))  # a row an arm
    spent = F.coalesce(F.when(F.col("__all") >= cap, F.col("__at.__all") + F.col("__free") - F.col("__at.__free")), F.col("__all"))
    x = x.join(reached, by, "left").withColumn("spent_before", spent).withColumn("refused", ~free & (F.col("spent_before") >= cap))
    return x.drop("__all", "__free", "__at")


def latency_report(samples: DataFrame, by: str = "method") -> DataFrame:
    """p50, p95, p99 (values that occur), successes, errors."""
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by duration)")
    return samples.groupBy(by).agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.count_if(F.col("ok")).alias("successes"), F.count_if(~F.col("ok")).alias("errors"))


#: Size of a latency sketch, and the rank error that it keeps to with 99% probability (of the sketch's own analysis, rounded up).
SKETCH_K, RANK_ERROR = 400, 0.01


def latency_sketches(samples: DataFrame, by: str = "method", at: str = "ts", span: str = "1 minute") -> DataFrame:
    """by, start, n, sketch: a quantile sketch of the durations of each method and span. Sketches merge, so a table of them answers for any time and stays a few KB a row however many samples there are."""
    spans = samples.groupBy(by, F.window(at, span).alias("w"))
    return spans.agg(F.count("duration").alias("n"), F.kll_sketch_agg_double(F.col("duration").cast("double"), SKETCH_K).alias("sketch")).select(by, F.col("w.start").alias("start"), "n", "sketch")


def sketched_latencies(sketches: DataFrame, by: str = "method", quantiles: tuple = (0.5, 0.95, 0.99)) -> DataFrame:
    """by, q, n, estimate from merged sketches; filter the table for a span of time first."""
    merged = sketches.groupBy(by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))
    each = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("estimate")) for q in quantiles]))
    return merged.select(by, "n", each.alias("e")).select(by, "e.q", "n", "e.estimate")


def rank_errors(estimates: DataFrame, samples: DataFrame, by: str = "method") -> DataFrame:
    """by, q, n, estimate, rank_error: how far q is from the share of samples up to the estimate (0 if a tie of samples spans q)."""
    e = estimates.select(by, F.struct("q", "n", "estimate").alias("e"))
    d = F.col("duration").cast("double")
    x = samples.where("duration is not null").join(e, by).groupBy(by, "e").agg(F.count_if(d < F.col("e.estimate")).alias("below"), F.count_if(d <= F.col("e.estimate")).alias("upto"), F.count("*").alias("all"))
    error = F.greatest(F.lit(0.0), F.col("below") / F.col("all") - F.col("e.q"), F.col("e.q") - F.col("upto") / F.col("all"))
    return x.select(by, "e.q", "e.n", "e.estimate", error.alias("rank_error"))


def judge_overall(scores: DataFrame, criteria: list[str]) -> DataFrame:
    return scores.withColumn("overall", sum((F.col(c) for c in criteria[1:]), F.col(criteria[0])) / len(criteria))


def calibration(pairs: DataFrame) -> DataFrame:
    """n, mean and largest absolute delta, share of at most 1 (1.0 without rows). pairs: judge, human."""
    d = F.abs(F.col("judge") - F.col("human"))
    return pairs.agg(F.count("*").alias("n"), F.coalesce(F.avg(d), F.lit(0.0)).alias("mean_abs"), F.coalesce(F.max(d), F.lit(0.0)).alias("max_abs"), F.coalesce(F.avg((d <= 1).cast("double")), F.lit(1.0)).alias("within_one"))


def rate_judge(ratings: DataFrame, judged: DataFrame) -> DataFrame:
    """query_id, criterion, human, judge, delta (judge less human) of ratings (query_id, criterion, human) that the judge scored too (query_id, criterion, judge)."""
    x = ratings.select("query_id", "criterion", "human").join(judged.select("query_id", "criterion", "judge"), ["query_id", "criterion"])
    return x.withColumn("delta", F.col("judge") - F.col("human"))


def ground_truth(manifest: DataFrame) -> DataFrame:
    """topic_id, doc_id, label from doc_id, primary_topic, cross_references."""
    a = manifest.select(F.col("primary_topic").alias("topic_id"), "doc_id", F.lit("primary").alias("label"))
    return a.unionByName(manifest.select(F.explode("cross_references").alias("topic_id"), "doc_id", F.lit("cross_reference").alias("label")))


def checkpoint_corpus(docs: DataFrame, percents: list[int]) -> DataFrame:
    """pct, doc_id, pos: the first ceil(n * pct / 100) documents by id, at least one."""
    ids = docs.select("doc_id")
    n = ids.agg(F.count("*").alias("n"))
    most = lambda p: F.greatest(F.lit(1), F.ceil(F.col("n") * p / 100))
    fits = F.filter(F.array(*[F.lit(p) for p in percents]), lambda p: F.col("pos") <= most(p))
    return numbered(ids, "doc_id", name="pos").join(F.broadcast(n)).select(F.explode(fits).alias("pct"), "doc_id", "pos")  # one row is broadcast


def checkpoint_topk(queries: DataFrame, vectors: DataFrame, checkpoints: DataFrame, percents: list[int], k: int) -> DataFrame:
    """pct, query_id, vec_id, score, rank: vector_topk among the vectors of each checkpoint (pct, doc_id, pos), which hold one another.

    A vector is scored once, in the smallest checkpoint that has it: the first of a checkpoint are among the first of its parts.
    """
    parts = checkpoints.groupBy("doc_id", "pos").agg(F.min("pct").alias("part")).select(F.col("doc_id").alias("vec_id"), "part")
    v, found = staged(vectors.select("vec_id", "embedding").join(parts, "vec_id"), new_dir(vectors.sparkSession, "parts")), None
    for part in sorted(percents):
        x = vector_topk(queries, v.where(F.col("part") == part), k).drop("rank").withColumn("part", F.lit(part))
        found = x if found is None else found.unionByName(x)
    holding = F.filter(F.array(*[F.lit(p) for p in percents]), lambda p: p >= F.col("part"))
    x = found.withColumn("pct", F.explode(holding)).drop("part")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("pct", "query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def chart(rows: DataFrame, arms: list[str]) -> DataFrame:
    """One row a checkpoint, a column an arm: recall / precision to three places, or (missing)."""
    cell = F.first(F.format_string("%.3f / %.3f", "mean_recall", "mean_precision"))
    wide = rows.groupBy("pct").pivot("arm", arms).agg(cell)
    return wide.select("pct", *[F.coalesce(F.col(f"`{a}`"), F.lit("(missing)")).alias(a) for a in arms])


def doc_specs(topics: DataFrame, k: int) -> DataFrame:
    """idx, title, off, ref_title: each topic refers to the next k, around the end."""
    n = topics.agg(F.count("*").alias("n"))
    a = topics.join(F.broadcast(n)).select("idx", "title", "n", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("off"))
    b = topics.select(F.col("idx").alias("ref"), F.col("title").alias("ref_title"))
    return a.withColumn("ref", (F.col("idx") + F.col("off")) % F.col("n")).join(b, "ref").where("ref <> idx").select("idx", "title", "off", "ref_title")


def benchmark(checkpoints: DataFrame, queries: DataFrame, retrieved: dict[str, DataFrame], qrels: DataFrame | None, k: int = 5, labels: DataFrame | None = None) -> DataFrame:
    """pct, arm, mean_recall, mean_precision, num_queries: every arm at every checkpoint, against the relevant documents that the checkpoint holds.

    checkpoints: pct, doc_id; retrieved: by arm, pct, query_id, doc_id, rank; qrels: query_id, doc_id. One plan for all checkpoints.
    With labels (doc_id, label) in place of qrels, what has the label of the query (queries: query_id, label) is relevant.
    """
    if labels is not None:
        asked = queries.select("query_id", "label").join(F.broadcast(checkpoints.select("pct").distinct()))  # a row a checkpoint
        held, out = checkpoints.select("pct", "doc_id").join(labels, "doc_id"), None
        for arm, rows in retrieved.items():
            x = labelled_scores(asked, rows, held, k, "pct").withColumn("arm", F.lit(arm))
            out = x if out is None else out.unionByName(x)
        return out.groupBy("pct", "arm").agg(F.avg("recall").alias("mean_recall"), F.avg("precision").alias("mean_precision"), F.count("*").alias("num_queries"))
    pcts = checkpoints.select("pct").distinct()
    asked = queries.select("query_id").join(F.broadcast(pcts)).select(F.struct("pct", "query_id").alias("query_id"))  # a row a checkpoint
    there = qrels.join(checkpoints.select("pct", "doc_id"), "doc_id").select(F.struct("pct", "query_id").alias("query_id"), "doc_id")
    out = None
    for arm, rows in retrieved.items():
        got = rows.select(F.struct("pct", "query_id").alias("query_id"), "doc_id", "rank")
        x = retrieval_scores(asked, got, there, k).withColumn("arm", F.lit(arm))
        out = x if out is None else out.unionByName(x)
    means = out.groupBy(F.col("query_id.pct").alias("pct"), "arm")
    return means.agg(F.avg("recall").alias("mean_recall"), F.avg("precision").alias("mean_precision"), F.count("*").alias("num_queries"))


def throughput(samples: DataFrame, elapsed_seconds: float, by: str = "method") -> DataFrame:
    return samples.groupBy(by).agg((F.count("*") / elapsed_seconds).alias("per_second"))


def expansion_study(with_: dict[int, DataFrame], without: dict[int, DataFrame]) -> DataFrame:
    """Per checkpoint: mean precision with and without expansion, and whether it hurt any query."""
    out = None
    for pct, scores in with_.items():
        d = expansion_delta(scores, without[pct])
        row = d.agg(F.lit(pct).alias("pct"), F.coalesce(F.avg("expanded"), F.lit(0.0)).alias("expanded"), F.coalesce(F.avg("plain"), F.lit(0.0)).alias("plain"), F.coalesce(F.bool_or("hurt"), F.lit(False)).alias("any_hurt"))
        out = row if out is None else out.unionByName(row)
    return out
