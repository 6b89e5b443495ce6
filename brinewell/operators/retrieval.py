"""Vector search, BM25, rank fusion, and context building for many questions at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_dimension(df: DataFrame, vector: str) -> DataFrame:
    """One row (dimension, uniform): the length of the vectors, and whether all have it."""
    return df.agg(F.max(F.size(vector)).alias("dimension"), (F.min(F.size(vector)) == F.max(F.size(vector))).alias("uniform"))


def _blocks(df: DataFrame, id_: str, vector: str, rows: int, names: tuple[str, str], extra: str | None = None) -> DataFrame:
    """Vectors packed into blocks of at most ``rows``, one binary matrix each."""
    def pack(batches):
        ids, mats, xs = [], [], []

        def out():
            m = np.concatenate(mats).astype(np.float32)
            cols = [pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([m.shape[1]], pa.int32())]
            if extra:
                cols.append(pa.array([np.concatenate(xs).tobytes()], pa.binary()))
            return pa.RecordBatch.from_arrays(cols, names=[f"{names[0]}", f"{names[1]}", f"{names[1]}_dim"] + ([f"{names[1]}_x"] if extra else []))

        held = 0
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1)
            dim = len(v[0])
            flat = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for k in range(0, len(flat), rows):
                ids.append(b.column(0).to_numpy()[k : k + rows].astype(np.int64))
                mats.append(flat[k : k + rows])
                if extra:
                    xs.append(b.column(2).to_numpy()[k : k + rows].astype(np.int64))
                held += len(mats[-1])
                if held >= rows:
                    yield out()
                    ids, mats, xs, held = [], [], [], 0
        if mats:
            yield out()

    picked = df.where(F.col(vector).isNotNull() & F.col(id_).isNotNull()).select(F.col(id_).cast("long"), F.col(vector).cast("array<float>"), *([F.col(extra).cast("long")] if extra else []))
    return picked.mapInArrow(pack, f"{names[0]} binary, {names[1]} binary, {names[1]}_dim int" + (f", {names[1]}_x binary" if extra else ""))


def nearest(corpus: DataFrame, queries: DataFrame, id_: str, vector: str, k: int, *, filter_by: str | None = None, query_rows: int = 1024, corpus_rows: int = 16384) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest corpus vectors of every query, exact squared L2.

    A stated set of queries meets the corpus in blocks: every pair of blocks keeps
    its k best per query, which are then merged. Ties go to the lower id.
    ``filter_by`` restricts candidates to rows with the query's value, before ranking.
    """
    q = _blocks(queries, id_, vector, query_rows, ("q_ids", "q"), filter_by)
    c = _blocks(corpus, id_, vector, corpus_rows, ("c_ids", "c"), filter_by)

    def best(batches):
        for b in batches:
            for r in b.to_pylist():
                qi, ci = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["c_ids"], np.int64)
                qm = np.frombuffer(r["q"], np.float32).reshape(-1, r["q_dim"]).astype(np.float64)
                cm = np.frombuffer(r["c"], np.float32).reshape(-1, r["c_dim"]).astype(np.float64)
                rough = (qm * qm).sum(1)[:, None] + (cm * cm).sum(1)[None, :] - 2 * qm @ cm.T
                if filter_by:
                    rough[np.frombuffer(r["q_x"], np.int64)[:, None] != np.frombuffer(r["c_x"], np.int64)[None, :]] = np.inf
                n = min(k, len(ci))
                out = ([], [], [])
                for i in range(len(qi)):
                    row = rough[i]
                    # everything up to the k-th distance and a rounding's width, then exact differences
                    kth = np.partition(row, n - 1)[n - 1]
                    if not np.isfinite(kth):
                        near = np.flatnonzero(np.isfinite(row))
                    else:
                        near = np.flatnonzero(row <= kth + 1e-9 * (1 + abs(kth)))
                    d = ((cm[near] - qm[i]) ** 2).sum(1)
                    order = np.lexsort((ci[near], d))[:n]
                    out[0].extend([qi[i]] * len(order))
                    out[1].extend(ci[near][order])
                    out[2].extend(d[order])
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "id", "distance"])

    partial = q.crossJoin(c).mapInArrow(best, "query_id long, id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def greedy_diverse(hits: DataFrame, vectors: DataFrame, queries: DataFrame, id_: str, vector: str, k: int, balance: float = 0.5) -> DataFrame:
    """Maximal marginal relevance: from each query's candidates (at most fetch_k rows) pick k, each
    the best by balance * cosine to the query - (1 - balance) * highest cosine to what is picked.
    Ties go to the candidate of lower rank."""
    cand = hits.join(vectors.select(F.col(id_).alias("id"), F.col(vector).alias("_v")), "id").join(queries.select(F.col(id_).alias("query_id"), F.col(vector).alias("_q")), "query_id")

    def pick(key, pdf):
        pdf = pdf.sort_values("rank", kind="stable")
        m = np.stack([np.asarray(v, float) for v in pdf["_v"]])
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        q = np.asarray(pdf["_q"].iloc[0], float)
        rel, taken = m @ (q / max(np.linalg.norm(q), 1e-300)), []
        worst = np.full(len(m), -np.inf)
        while len(taken) < min(k, len(m)):
            score = rel if not taken else balance * rel - (1 - balance) * worst
            score = np.where(np.isin(np.arange(len(m)), taken), -np.inf, score)
            i = int(np.argmax(score))
            taken.append(i)
            worst = np.maximum(worst, m @ m[i])
        return pd.DataFrame({"query_id": [key[0]] * len(taken), "pick": range(1, len(taken) + 1), "id": pdf["id"].to_numpy()[taken]})

    # a group is one query's candidates: bounded by fetch_k
    return cand.groupBy("query_id").applyInPandas(pick, "query_id long, pick int, id long")


def drop_redundant(hits: DataFrame, vectors: DataFrame | None, id_: str, vector: str, threshold: float = 0.95) -> DataFrame:
    """Candidates of a query in order of rank, without those whose cosine to a kept earlier one reaches the threshold.

    Without ``vectors`` the hits carry their own in the column ``vector``.
    """
    cand = hits.withColumnRenamed(vector, "_v") if vectors is None else hits.join(vectors.select(F.col(id_).alias("id"), F.col(vector).alias("_v")), "id")

    def keep(key, pdf):
        pdf = pdf.sort_values("rank", kind="stable")
        m = np.stack([np.asarray(v, float) for v in pdf["_v"]])
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        kept: list[int] = []
        for i in range(len(m)):
            if not kept or (m[kept] @ m[i]).max() < threshold:
                kept.append(i)
        return pdf.iloc[kept][["query_id", "rank", "id"]]

    return cand.groupBy("query_id").applyInPandas(keep, "query_id long, rank int, id long")


def keep_relevant(pairs: DataFrame, a: str, b: str, threshold: float = 0.76) -> DataFrame:
    """Pairs whose cosine is at least the threshold, with it."""
    return pairs.withColumn("similarity", cosine(F.col(a), F.col(b))).where(F.col("similarity") >= threshold)


# -- embedding, search, compression ---------------------------------------------------------------

DIMENSION = 64


def embed(text: Column, model=None) -> Column:
    """array<float> of each text by a callable from texts to vectors, in Arrow batches; null texts have none.

    The stand-in is a hashed bag of words of unit length.
    """
    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        have = [t for t in s if t is not None]
        got = iter((model or hashed_words)(have))
        return pd.Series([None if t is None else next(got) for t in s], dtype=object)

    return run(text)


def hashed_words(texts: list[str], dimension: int = DIMENSION) -> list[np.ndarray]:
    """Counts of lower-case words by the bucket of their MD5, scaled to unit length; a text without words is the zero vector."""
    import hashlib
    import re

    known: dict[str, int] = {}
    out = []
    for t in texts:
        v = np.zeros(dimension)
        for w in re.findall(r"\w+", t.lower()):
            if w not in known:
                known[w] = int(hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % dimension
            v[known[w]] += 1
        size = np.sqrt(v @ v)
        out.append((v / size if size else v).astype(np.float32))
    return out


def search(corpus: DataFrame, queries: DataFrame, id_: str, vector: str, k: int = 4, *, search_type: str = "similarity", filter_by: str | None = None, fetch_k: int = 20, threshold: float = 0.76) -> DataFrame:
    """(query_id, rank, id) by one of three kinds of search: 'similarity', 'mmr', or 'similarity_score_threshold' (cosine)."""
    if search_type == "similarity":
        return nearest(corpus, queries, id_, vector, k, filter_by=filter_by).select("query_id", "rank", "id")
    if search_type == "mmr":
        hits = nearest(corpus, queries, id_, vector, max(k, fetch_k), filter_by=filter_by)
        return greedy_diverse(hits, corpus, queries, id_, vector, k).select("query_id", F.col("pick").alias("rank"), "id")
    if search_type == "similarity_score_threshold":
        hits = nearest(corpus, queries, id_, vector, k, filter_by=filter_by)
        both = hits.join(corpus.select(F.col(id_).alias("id"), F.col(vector).alias("_a")), "id").join(queries.select(F.col(id_).alias("query_id"), F.col(vector).alias("_b")), "query_id")
        return keep_relevant(both, "_a", "_b", threshold).select("query_id", "rank", "id")
    raise ValueError(f"search type {search_type!r}")


def compress(hits: DataFrame, texts: DataFrame, queries: DataFrame, split: Column, *, redundant: float = 0.95, relevant: float = 0.76, model=None) -> DataFrame:
    """(query_id, rank, id, piece_no, piece, query_similarity_score): retrieved texts cut by ``split`` (of column text), without
    pieces that are nearly an earlier one of the query, and only those near the question.

    ``hits`` has (query_id, rank, id), at most k a query; ``texts`` (id, text); ``queries`` (query_id, question).
    """
    cut = hits.join(texts, "id").select("query_id", F.col("rank").alias("doc_rank"), "id", F.posexplode(split).alias("piece_no", "piece")).withColumn("_v", embed(F.col("piece"), model))
    asked = queries.select("query_id", embed(F.col("question"), model).alias("_q"))
    # one query's pieces: bounded by its hits
    order = cut.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_rank", "piece_no")))
    kept = drop_redundant(order.select("query_id", "rank", F.col("rank").cast("long").alias("id"), "_v"), None, "id", "_v", redundant)
    near = order.join(kept.select("query_id", "rank"), ["query_id", "rank"], "left_semi").join(asked, "query_id")
    return keep_relevant(near, "_v", "_q", relevant).select("query_id", "rank", "id", "piece_no", "piece", F.col("similarity").alias("query_similarity_score"))


# -- BM25 -----------------------------------------------------------------------------------------


def bm25(docs: DataFrame, doc_id: str, tokens: Column, questions: DataFrame, question_id: str, question_tokens: Column, k: int = 4, *, k1: float = 1.5, b: float = 0.75, idf_floor: float = 0.0, salt: int = 16) -> DataFrame:
    """(query_id, rank, seq_num, score): the k best documents of every question.

    Only terms of questions are exploded into postings (semi-join before any
    aggregation); lengths and their mean come from the token arrays. Empty tokens
    do not count. A question's repeated term counts each time. Postings of a term are
    spread over ``salt`` tasks by their document, and the questions' terms copied to each.
    """
    q = questions.select(F.col(question_id).cast("long").alias("query_id"), F.explode(question_tokens).alias("term")).where("term <> ''").groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    toks = docs.select(F.col(doc_id).cast("long").alias("seq_num"), F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: t != "").alias("_t")).withColumn("dl", F.size("_t"))
    stats = toks.agg(F.count(F.lit(1)).alias("_n"), F.avg("dl").alias("_avgdl"))
    terms = q.select("term").distinct()
    postings = toks.select("seq_num", "dl", F.explode("_t").alias("term")).join(terms, "term", "left_semi").groupBy("seq_num", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    idf = F.greatest(F.lit(float(idf_floor)), F.ln((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("_avgdl")))
    weights = df.join(F.broadcast(stats)).withColumn("idf", idf).where("idf > 0").select("term", "idf", "_avgdl")
    asked = weights.join(q, "term").withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
    scored = postings.withColumn("_s", F.pmod(F.xxhash64("seq_num"), F.lit(salt))).join(asked, ["term", "_s"]).groupBy("query_id", "seq_num").agg(F.sum(part).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "seq_num")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "seq_num", "score")


# -- fusion ---------------------------------------------------------------------------------------


def rank_score(hits: DataFrame, key: str = "seq_num", norm: float = 8.0) -> DataFrame:
    """(query_id, key, score): reciprocal ranks of a list added up per document, over a fixed norm."""
    return hits.groupBy("query_id", key).agg((F.sum(1 / F.col("rank")) / F.lit(norm)).alias("score"))


def fuse(lists: dict[str, DataFrame], weights: dict[str, float], key: str = "seq_num") -> DataFrame:
    """(query_id, key, one column per source, fused): weighted sums, a missing score counts 0."""
    tagged = None
    for name, df in lists.items():
        one = df.select("query_id", key, F.lit(name).alias("_s"), "score")
        tagged = one if tagged is None else tagged.unionByName(one)
    part = {n: F.sum(F.when(F.col("_s") == n, F.col("score")).otherwise(0.0)) for n in lists}
    total = None
    for n in lists:
        total = part[n] * weights[n] if total is None else total + part[n] * weights[n]
    return tagged.groupBy("query_id", key).agg(*[c.alias(n) for n, c in part.items()], total.alias("fused"))


def top_documents(fused: DataFrame, n: int = 2, key: str = "seq_num", score: str = "fused") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round(score, 9).desc(), key)
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("query_id", "rank", key, score)


def build_context(top: DataFrame, chunks: DataFrame, key: str = "seq_num", most: int = 10) -> DataFrame:
    """(query_id, context): the first chunks of each query's documents, in order of document rank and chunk, joined by line breaks."""
    joined = top.join(chunks, key).withColumn("_r", F.row_number().over(Window.partitionBy("query_id", key).orderBy("chunk_seq_num"))).where(F.col("_r") <= most)
    ordered = joined.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_seq_num", "page_content"))).alias("_c"))
    return ordered.select("query_id", F.array_join(F.transform("_c", lambda c: c["page_content"]), "\n").alias("context"))


def ranked_lines(hits: DataFrame, title: str = "title", score: str = "score") -> DataFrame:
    """A printable line per hit: rank, title cut at 64 characters, score or N/A."""
    return hits.select("query_id", "rank", F.concat_ws(" ", F.concat(F.col("rank").cast("string"), F.lit(".")), F.substring(F.coalesce(F.col(title), F.lit("")), 1, 64), F.coalesce(F.format_number(score, 4), F.lit("N/A"))).alias("line"))
