"""Chunking, retrieval, fusion and model-backed steps over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import clean_keywords, expected_count, is_yes, split_tokens, stable_id, strip_list_marks
from ..operators import models, retrieval, text
from ..runtime import cut_lineage
from ..sources.tables import table
from .panel import rounded

#: Searches take every row whose id is divisible by this, against all rows.
QUERY_STEP = 100


def documents(s, d):
    return table(s, d, "documents")


def questions(s, d):
    return documents(s, d).where((F.col("doc_id") % QUERY_STEP == 0) & F.col("title").isNotNull()).select(F.col("doc_id").alias("query_id"), F.col("title").alias("question"))


def doc_chunks(s, d):
    """Chunk records: id, what the document says of itself with the chunk's number, and the chunk."""
    cut = text.split_documents(documents(s, d), "text", ["doc_id", "title", "pub_date"])
    return cut.select("id", F.struct("doc_id", "title", "pub_date", "chunk_seq_num").alias("metadata"), "page_content")


def sentence_chunks(s, d):
    docs = documents(s, d)
    return text.split_documents(docs, "text", ["doc_id"], 150, 50, text.SENTENCE_SEPARATORS, scope="chunk").select("doc_id", "chunk_seq_num", "page_content")


def short_chunks(s, d):
    """Sentences of up to 80 characters that share up to 8."""
    return text.split_documents(documents(s, d), "text", ["doc_id"], 80, 8, text.SENTENCE_SEPARATORS, scope="chunk").select("doc_id", "chunk_seq_num", "page_content")


def doc_keywords(s, d):
    """The five terms of every document that tell it from the others."""
    return models.keyword_terms(documents(s, d).where("text is not null"), "doc_id", split_tokens(F.lower("text")))


def tokens(s, d):
    t = documents(s, d).where("title is not null")
    return t.select("doc_id", F.posexplode(split_tokens(F.col("title"))).alias("pos", "token"))


def keywords(s, d):
    return documents(s, d).where("title is not null").select("doc_id", clean_keywords(F.col("title")).alias("keywords"))


def list_marks_off(s, d):
    return documents(s, d).where("title is not null").select("doc_id", strip_list_marks(F.col("title")).alias("title"))


def query_count(s, d):
    return documents(s, d).select("doc_id", expected_count(F.col("text")).alias("n"))


def verdicts(s, d):
    return table(s, d, "selfcheck_state").select("state_id", is_yes(F.col("retry_fetch")).alias("kept"))


def document_ids(s, d):
    return documents(s, d).select("doc_id", stable_id(F.col("doc_id"), F.col("title")).alias("id"))


def vector_dimension(s, d):
    return retrieval.vector_dimension(table(s, d, "embeddings"), "embedding")


def _queries(s, d):
    e = table(s, d, "embeddings")
    return e, e.where(F.col("vec_id") % QUERY_STEP == 0)


def knn_l2_top8(s, d):
    e, q = _queries(s, d)
    return rounded(retrieval.nearest(e, q, "vec_id", "embedding", 8), 5)


def knn_filtered(s, d):
    e, q = _queries(s, d)
    return rounded(retrieval.nearest(e, q, "vec_id", "embedding", 10, filter_by="label"), 5)


def cosine_filter(s, d):
    """Hits of each query whose cosine reaches the relevance bound."""
    e, q = _queries(s, d)
    hits = retrieval.nearest(e, q, "vec_id", "embedding", 20)
    pairs = hits.join(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("a")), "id").join(q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("b")), "query_id")
    return rounded(retrieval.keep_relevant(pairs, "a", "b", 0.76).select("query_id", "id", "similarity"), 5)


def mmr_top10(s, d):
    e, q = _queries(s, d)
    return retrieval.greedy_diverse(retrieval.nearest(e, q, "vec_id", "embedding", 40), e, q, "vec_id", "embedding", 10)


def redundancy_filter(s, d):
    e, q = _queries(s, d)
    return retrieval.drop_redundant(retrieval.nearest(e, q, "vec_id", "embedding", 40), e, "vec_id", "embedding", 0.95)


def _bm25(s, d):
    q = questions(s, d)
    return retrieval.bm25(documents(s, d), "doc_id", split_tokens(F.col("text")), q, "query_id", split_tokens(clean_keywords(F.col("question"))))


def bm25_top4(s, d):
    return rounded(_bm25(s, d), 5)


def _vector_hits(s, d, k=8):
    e, q = _queries(s, d)
    return retrieval.nearest(e, q, "vec_id", "embedding", k).select("query_id", "rank", F.col("id").alias("seq_num"))


def rank_score(s, d):
    return rounded(retrieval.rank_score(_vector_hits(s, d)))


def _fused(s, d):
    near = retrieval.rank_score(_vector_hits(s, d))
    e, q = _queries(s, d)
    same = retrieval.rank_score(retrieval.nearest(e, q, "vec_id", "embedding", 8, filter_by="label").select("query_id", "rank", F.col("id").alias("seq_num")))
    words = retrieval.rank_score(_bm25(s, d))
    return retrieval.fuse({"expected": near, "summary": same, "lexical": words}, {"expected": 0.3, "summary": 0.4, "lexical": 0.3})


def fused_score(s, d):
    return rounded(_fused(s, d))


def top_documents(s, d):
    return rounded(retrieval.top_documents(_fused(s, d)))


def expected_query_index(s, d):
    """(seq_num, expanded_query_seq_num, page_content, embedding): the questions that every document is expected to answer."""
    q = models.expected_queries(documents(s, d).where("text is not null").select(F.col("doc_id").alias("seq_num"), "text"), "text", models.question_stub)
    rows = q.select("seq_num", F.posexplode("queries").alias("expanded_query_seq_num", "page_content"))
    return rows.withColumn("embedding", retrieval.embed(F.col("page_content")))


def intent_summary_index(s, d):
    """(id, seq_num, chunk_seq_num, page_content, embedding): the summary of the whole document, by its intent, for each of its chunks.

    A document is summarised once, whatever the number of its chunks.
    """
    m = models.intent_summary(models.metadata(documents(s, d).where("text is not null").select(F.col("doc_id").alias("seq_num"), "text"), "text"), "text", models.extract_stub)
    rows = m.select("seq_num", "summary", retrieval.embed(F.col("summary")).alias("embedding"), F.posexplode(text.chunks(F.col("text"))).alias("chunk_seq_num", "_c"))
    return rows.select(text.stable_id(F.col("seq_num"), F.col("chunk_seq_num")).alias("id"), "seq_num", "chunk_seq_num", F.col("summary").alias("page_content"), "embedding")


def _service_hits(s, d, k=8):
    """The three lists of the service: nearest expected questions, nearest summaries, best documents by words."""
    asked = questions(s, d).select(F.col("query_id").alias("key"), retrieval.embed(F.col("question")).alias("embedding"))
    expected = cut_lineage(expected_query_index(s, d).select((F.col("seq_num") * 1_000_000 + F.col("expanded_query_seq_num")).alias("key"), "embedding"))
    # the chunks of a document share its summary: the first stands for all
    summary = cut_lineage(intent_summary_index(s, d).where("chunk_seq_num = 0").select(F.col("seq_num").alias("key"), "embedding"))
    return {
        "expected": retrieval.nearest(expected, asked, "key", "embedding", k).select("query_id", "rank", F.floor(F.col("id") / 1_000_000).alias("seq_num")),
        "summary": retrieval.nearest(summary, asked, "key", "embedding", k).select("query_id", "rank", F.col("id").alias("seq_num")),
        "lexical": _bm25(s, d).select("query_id", "rank", "seq_num"),
    }


def service_fused(s, d):
    """Documents of every question by the fused score of the three lists, all parts kept."""
    lists = {n: retrieval.rank_score(h) for n, h in _service_hits(s, d).items()}
    return rounded(retrieval.fuse(lists, {"expected": 0.3, "summary": 0.4, "lexical": 0.3}))


def service_hits(s, d):
    """The three lists below each other, tagged by their source."""
    out = None
    for n, h in _service_hits(s, d).items():
        one = h.select("query_id", F.lit(n).alias("source"), F.col("rank").cast("int").alias("rank"), F.col("seq_num").cast("long").alias("seq_num"))
        out = one if out is None else out.unionByName(one)
    return out


def top_context(s, d):
    """Chunks of the two documents of every question that have the highest fused score."""
    top = cut_lineage(retrieval.top_documents(service_fused(s, d), 2))
    kept = documents(s, d).join(top.select(F.col("seq_num").alias("doc_id")).distinct(), "doc_id", "left_semi")
    chunks = text.split_documents(kept, "text", ["doc_id"]).select(F.col("doc_id").alias("seq_num"), "chunk_seq_num", "page_content")
    return retrieval.build_context(top.select("query_id", "rank", "seq_num"), chunks)


def compressed_hits(s, d):
    """Pieces of each question's ten best documents that are near it and not repeated."""
    hits = retrieval.bm25(documents(s, d), "doc_id", split_tokens(F.col("text")), questions(s, d), "query_id", split_tokens(clean_keywords(F.col("question"))), 10)
    texts = documents(s, d).select(F.col("doc_id").alias("id"), "text")
    return rounded(retrieval.compress(hits.select("query_id", "rank", F.col("seq_num").alias("id")), texts, questions(s, d), text.chunks(F.col("text"), 150, 50, text.SENTENCE_SEPARATORS)))


def searches(s, d):
    """One search of each kind over the same vectors, restricted to rows of the query's label and not."""
    e, q = _queries(s, d)
    out = None
    for kind in ("similarity", "mmr", "similarity_score_threshold"):
        for by in (None, "label"):
            one = retrieval.search(e, q, "vec_id", "embedding", 10, search_type=kind, filter_by=by).select(F.lit(kind).alias("kind"), F.lit(by is not None).alias("filtered"), "query_id", F.col("rank").cast("int").alias("rank"), "id")
            out = one if out is None else out.unionByName(one)
    return out


def ranked_lines(s, d):
    hits = _bm25(s, d).join(documents(s, d).select(F.col("doc_id").alias("seq_num"), "title"), "seq_num")
    return retrieval.ranked_lines(hits)


def expected_queries(s, d):
    return models.expected_queries(documents(s, d).select("doc_id", "text"), "text", models.question_stub).select("doc_id", "queries")


def self_check(s, d):
    return models.self_check(documents(s, d).where("text is not null").select("doc_id", "text"), "doc_id", "text", models.question_stub, models.check_stub)


def doc_metadata(s, d):
    m = models.metadata(documents(s, d).where("text is not null").select("doc_id", "text"), "text")
    return models.intent_summary(m, "text", models.extract_stub).join(doc_keywords(s, d), "doc_id", "left").select("doc_id", "sentence_type", "intent", "keywords", "summary")


def rag_answer(s, d):
    return models.answer(top_context(s, d), questions(s, d), models.extract_stub)


QUERIES = {f.__name__: f for f in (
    doc_chunks, sentence_chunks, short_chunks, doc_keywords, tokens, keywords, list_marks_off, query_count, verdicts, document_ids, vector_dimension, knn_l2_top8, knn_filtered, cosine_filter, mmr_top10, redundancy_filter, bm25_top4, rank_score, fused_score, top_documents, searches, expected_query_index, intent_summary_index, service_hits, service_fused, top_context, compressed_hits, ranked_lines,
    expected_queries, self_check, doc_metadata, rag_answer,
)}

_KNN = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
near AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(q.v, c.v)]) AS distance, q.v AS qv, c.v AS cv, q.label = c.label AS same FROM e q, e c WHERE q.vec_id % 100 = 0)"""
_TOP8 = f"{_KNN}, hits AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM near QUALIFY rank <= 8)"
_SAME8 = ", same8 AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM near WHERE same QUALIFY rank <= 8)"
_BM = r"""toks AS (SELECT doc_id AS seq_num, [t FOR t IN regexp_split_to_array(coalesce(text, ''), '[-\n,\s+]') IF t <> ''] AS t FROM documents),
docs AS (SELECT seq_num, t, len(t) AS dl FROM toks), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM docs),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT doc_id AS query_id, unnest(regexp_split_to_array(regexp_replace(title, '[-,\s]+', ' ', 'g'), '[-\n,\s+]')) AS term FROM documents WHERE doc_id % 100 = 0 AND title IS NOT NULL) WHERE term <> '' GROUP BY ALL),
post AS (SELECT seq_num, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT seq_num, dl, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM q) GROUP BY seq_num, term),
w AS (SELECT term, greatest(0.0, ln((n - df + 0.5) / (df + 0.5))) AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), st),
sc AS (SELECT query_id, seq_num, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM post JOIN w USING (term) JOIN q USING (term), st WHERE idf > 0 GROUP BY ALL),
bm AS (SELECT query_id, seq_num, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seq_num) AS rank FROM sc QUALIFY rank <= 4)"""
_FUSED = f"""WITH {_TOP8}{_SAME8}, {_BM}, l AS (SELECT query_id, id AS seq_num, 'e' AS s, 1 / rank AS r FROM hits UNION ALL SELECT query_id, id, 's', 1 / rank FROM same8 UNION ALL SELECT query_id, seq_num, 'l', 1 / rank FROM bm),
fu AS (SELECT query_id, seq_num, coalesce(sum(r) FILTER (s = 'e'), 0) / 8 AS expected, coalesce(sum(r) FILTER (s = 's'), 0) / 8 AS summary, coalesce(sum(r) FILTER (s = 'l'), 0) / 8 AS lexical FROM l GROUP BY ALL),
fused AS (SELECT *, expected * 0.3 + summary * 0.4 + lexical * 0.3 AS fused FROM fu)
"""
ORACLES = {
    "tokens": r"SELECT doc_id, (i - 1)::INT AS pos, t[i] AS token FROM (SELECT doc_id, regexp_split_to_array(title, '[-\n,\s+]') AS t, unnest(generate_series(1, len(regexp_split_to_array(title, '[-\n,\s+]')))) AS i FROM documents WHERE title IS NOT NULL)",
    "keywords": r"SELECT doc_id, regexp_replace(title, '[-,\s]+', ' ', 'g') AS keywords FROM documents WHERE title IS NOT NULL",
    "list_marks_off": r"SELECT doc_id, array_to_string([regexp_replace(l, '^\s*[-\p{Nd}#]+\.\s*', '') FOR l IN string_split(title, chr(10))], chr(10)) AS title FROM documents WHERE title IS NOT NULL",
    "doc_keywords": r"WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[-\n,\s+]')) AS term FROM documents WHERE text IS NOT NULL), tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term <> '' GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * ln(n / df), 9) DESC, term) AS r FROM tf JOIN df USING (term), n QUALIFY r <= 5) SELECT doc_id, string_agg(term, ',' ORDER BY r) AS keywords FROM s GROUP BY doc_id",
    "query_count": "SELECT doc_id, (length(text) // 20)::INT AS n FROM documents",
    "verdicts": r"SELECT state_id, coalesce(trim(retry_fetch, E' \n\t\r') IN ('yes', '예'), false) AS kept FROM selfcheck_state",
    "document_ids": "SELECT doc_id, sha256(doc_id || chr(31) || coalesce(title, chr(0))) AS id FROM documents",
    "vector_dimension": "SELECT max(len(embedding))::INT AS dimension, min(len(embedding)) = max(len(embedding)) AS uniform FROM embeddings",
    "knn_l2_top8": f"WITH {_TOP8} SELECT query_id, rank::INT AS rank, id, round(distance, 5) AS distance FROM hits",
    "knn_filtered": f"WITH {_KNN} SELECT query_id, id, round(distance, 5) AS distance, (row_number() OVER (PARTITION BY query_id ORDER BY near.distance, id))::INT AS rank FROM near WHERE same QUALIFY rank <= 10",
    "cosine_filter": f"WITH {_KNN}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM near QUALIFY rank <= 20) SELECT query_id, id, round(list_cosine_similarity(qv, cv), 5) AS similarity FROM h WHERE list_cosine_similarity(qv, cv) >= 0.76",
    "bm25_top4": f"WITH {_BM} SELECT query_id, rank::INT AS rank, seq_num, round(score, 5) AS score FROM bm",
    "rank_score": f"WITH {_TOP8} SELECT query_id, id AS seq_num, round(sum(1 / rank) / 8, 6) AS score FROM hits GROUP BY ALL",
    "fused_score": _FUSED + "SELECT query_id, seq_num, round(expected, 6) AS expected, round(summary, 6) AS summary, round(lexical, 6) AS lexical, round(fused, 6) AS fused FROM fused",
    "top_documents": _FUSED + "SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY round(f.fused, 9) DESC, seq_num))::INT AS rank, seq_num, round(f.fused, 6) AS fused FROM fused f QUALIFY rank <= 2",
}
