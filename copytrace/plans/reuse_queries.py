"""Queries about text reuse, the index and vector search."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from copytrace.functions.numeric import percent, round_even
from copytrace.operators import index as I
from copytrace.operators import lsa, pivots, quantized, reuse, semantic, similarity, vectors
from copytrace.operators.rerank import rerank_lexical, rerank_model
from copytrace.plans import common as C
from copytrace.session import materialize, new_path
from copytrace.sources.tables import corpus_table, query_table, read_table
from copytrace.streaming.jobs import index_stream, reuse_stream, text_stream

TOP = 10
SHORTLIST = 20
NEIGHBOURS = 5
PADDED = 3
LSA_COMPONENTS = 100

_SPACES: dict[tuple[str, str], lsa.LatentSpace] = {}


def _space(spark, folder):
    key = (spark.sparkContext.applicationId, folder)
    if key not in _SPACES:
        _SPACES[key] = lsa.fit_lsa(C.shared_index(spark, folder), LSA_COMPONENTS)
    return _SPACES[key]


def _ranking(spark, folder):
    return reuse.rank_documents(query_table(spark, folder), C.shared_index(spark, folder), TOP)


def _sentence_matches(spark, folder):
    return reuse.match_sentences(query_table(spark, folder), C.shared_index(spark, folder))


def _candidates(spark, folder, k):
    sents = reuse.query_sentences(query_table(spark, folder))
    return reuse.sentence_candidates(sents, C.shared_index(spark, folder), k)


def self_repetition(spark, folder):
    found = similarity.self_repetition(corpus_table(spark, folder))
    return found.select("doc_id", "sent_idx", "sentence", "partner_idx", "most_similar_to", "similarity")


def corpus_sentence_match(spark, folder):
    return similarity.corpus_sentence_match(query_table(spark, folder), corpus_table(spark, folder))


def fit_corpus_idf(spark, folder):
    vocab = C.shared_index(spark, folder).vocabulary
    return vocab.select("term", "df", round_even(F.col("idf"), 6).alias("idf"))


def document_ranking(spark, folder):
    return _ranking(spark, folder).select("query_id", "rank", "source", "similarity")


def sentence_match(spark, folder):
    return _sentence_matches(spark, folder).select(
        "query_id", "sent_idx", "sentence", "source", "source_idx", "matched_sentence", "similarity"
    )


def topk_candidates(spark, folder):
    found = _candidates(spark, folder, NEIGHBOURS)
    return found.select("query_id", "sent_idx", "rank", "source", "source_idx", percent(F.col("score")).alias("similarity"))


def rerank(spark, folder):
    found = rerank_lexical(_candidates(spark, folder, SHORTLIST))
    return found.select(
        "query_id", "sent_idx", "rank", "rerank_rank", round_even(F.col("rerank_score"), 4).alias("rerank_score")
    )


def retrieve_then_rerank(spark, folder):
    found = reuse.match_sentences(query_table(spark, folder), C.shared_index(spark, folder), rerank_lexical, SHORTLIST)
    return found.select("query_id", "sent_idx", "source", "source_idx", "similarity", "score_kind")


def _length_gap(query, cand):
    """A stand-in for a caller's pair model: how alike the lengths are."""
    return 3.0 - (query.str.len() - cand.str.len()).abs() / 10.0


def rerank_with_model(spark, folder):
    found = rerank_model(_candidates(spark, folder, SHORTLIST), _length_gap)
    return found.select(
        "query_id", "sent_idx", "rank", "rerank_rank", round_even(F.col("rerank_score"), 4).alias("rerank_score")
    )


def severity_flags(spark, folder):
    flagged = reuse.flag_matches(_sentence_matches(spark, folder))
    return flagged.select("query_id", "sent_idx", "source", "similarity", "severity")


def threshold_matches(spark, folder):
    docs = reuse.above(_ranking(spark, folder), reuse.DOCUMENT_THRESHOLD)
    sents = reuse.above(_sentence_matches(spark, folder), reuse.SENTENCE_THRESHOLD)
    docs = docs.select("query_id", F.lit(-1).alias("sent_idx"), "source", "similarity")
    return docs.unionByName(sents.select("query_id", "sent_idx", "source", "similarity"))


def reuse_score(spark, folder):
    return reuse.reuse_scores(query_table(spark, folder), _ranking(spark, folder))


def reuse_report(spark, folder):
    report = reuse.reuse_report(query_table(spark, folder), C.shared_index(spark, folder), TOP)
    copied = F.size(F.filter("sentence_matches", lambda m: m["similarity"] > 70.0))
    sources = F.transform("matches", lambda m: F.concat_ws(":", m["rank"], m["source"]))
    found = F.transform("sentence_matches", lambda m: F.concat_ws(":", m["sent_idx"], F.coalesce(m["source"].cast("string"), F.lit("none"))))
    return report.select(
        "query_id",
        "score",
        F.array_join(sources, ",").alias("matches"),
        F.array_join(found, ",").alias("sentence_sources"),
        copied.alias("copied_sentences"),
    )


# ---- index ---------------------------------------------------------------------


def _arrivals(spark, folder):
    """The benchmark passages as documents that arrive later."""
    return query_table(spark, folder).select((-F.col("query_id") - 1).alias("doc_id"), "text")


def build_index(spark, folder):
    """Rows of every table of the index and a sum over its content."""
    ix = I.build_index(corpus_table(spark, folder))
    first = (F.col("bid") == F.col("member")).cast("double")
    content = {
        "documents": F.length("text").cast("double"),
        "sentences": F.length("sentence").cast("double"),
        "vocabulary": F.col("idf"),
        "document_copies": first,
        "sentence_copies": first,
        "document_weights": F.col("w"),
        "sentence_weights": F.col("w"),
    }
    sums = [
        df.agg(F.count(F.lit(1)).alias("rows"), round_even(F.sum(content[name]), 2).alias("content")).select(F.lit(name).alias("name"), "rows", "content")
        for name, df in ix.tables().items()
    ]
    return reduce(DataFrame.unionByName, sums)


def new_documents(spark, folder):
    corpus = corpus_table(spark, folder).unionByName(_arrivals(spark, folder))
    return I.new_documents(C.shared_index(spark, folder), corpus).select("doc_id", "text")


def corpus_overlay(spark, folder):
    extra = query_table(spark, folder).select(F.col("query_id").alias("doc_id"), "text")
    return I.overlay(corpus_table(spark, folder), extra).select("doc_id", "text")


def incremental_index(spark, folder):
    """Counts after the whole corpus and the arrivals are offered to the index."""
    ix = C.shared_index(spark, folder)
    grown = I.add_documents(ix, corpus_table(spark, folder).unionByName(_arrivals(spark, folder)))
    added = grown.document_weights.filter(F.col("bid.batch") > 0)
    return I.index_health(grown).join(
        added.agg(F.count(F.lit(1)).alias("new_vector_terms"), F.lit("heuristic").alias("detector")), "detector"
    ).select("documents", "sentences", "new_vector_terms")


def out_of_vocabulary(spark, folder):
    oov = I.out_of_vocabulary(C.shared_index(spark, folder), _arrivals(spark, folder))
    return oov.select("doc_id", round_even(F.col("oov_ratio"), 6).alias("oov_ratio"))


def index_health(spark, folder):
    return I.index_health(C.shared_index(spark, folder))


def index_roundtrip(spark, folder):
    """The ranking from an index that was saved and loaded."""
    path = new_path(spark, "saved-index")
    I.save_index(C.shared_index(spark, folder), path)
    found = reuse.rank_documents(query_table(spark, folder), I.load_index(spark, path), TOP)
    return found.select("query_id", "rank", "source", "similarity")


def compacted_index(spark, folder):
    """Every document of a saved index after arrivals and a compaction: batch, sentences, first place of its text."""
    path = new_path(spark, "compacted-index")
    I.save_index(C.shared_index(spark, folder), path)
    I.append_to_saved(spark, path, corpus_table(spark, folder).unionByName(_arrivals(spark, folder)))
    I.append_to_saved(spark, path, _arrivals(spark, folder))  # all known by now
    I.compact_saved(spark, path)
    ix = I.load_index(spark, path)
    firsts = ix.document_copies.select(F.col("member.doc_id").alias("doc_id"), F.col("bid.doc_id").alias("first_doc_id"))
    counts = ix.sentences.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"))
    rows = ix.documents.select("doc_id", "batch").join(firsts, "doc_id").join(counts, "doc_id", "left")
    return rows.select("doc_id", F.col("batch").cast("long").alias("batch"), F.coalesce("sentences", F.lit(0)).alias("sentences"), "first_doc_id")


# ---- vectors -------------------------------------------------------------------


def _knn(spark, folder, k, search=vectors.knn_topk):
    store = read_table(spark, folder, "embeddings").select("vec_id", "embedding")
    asked = store.select(F.col("vec_id").alias("query_id"), "embedding")
    return asked, search(asked, store, k)


def knn_topk(spark, folder):
    found = _knn(spark, folder, NEIGHBOURS)[1]
    return found.select("query_id", "rank", "vec_id", round_even(F.col("score"), 6).alias("score"))


def knn_pivots(spark, folder):
    """The same neighbours by cells and bounds."""
    store = read_table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    found, _ = pivots.pivot_search(store.withColumnRenamed("vec_id", "query_id"), store, NEIGHBOURS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", round_even(F.col("score"), 6).alias("score"))


def _recall_row(spark, folder, search):
    """Queries, rows found, whether every score is the pair's product, and whether recall is 0.9 or more."""
    asked, found = _knn(spark, folder, NEIGHBOURS, search)
    found = materialize(found, "found")
    reached = quantized.recall(found, _knn(spark, folder, NEIGHBOURS)[1]) >= 0.9
    double = F.col("embedding").cast("array<double>")
    pairs = found.join(asked.select("query_id", double.alias("q")), "query_id").join(asked.select(F.col("query_id").alias("vec_id"), double.alias("v")), "vec_id")
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    exact = F.bool_and(F.abs(product - F.col("score")) < 1e-6)
    return pairs.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("found"), exact.alias("true_scores"), F.lit(reached).alias("recall_reached"))


def _quantized(asked, store, k):
    """A short list of 15 % of the vectors, all lists visited: the vectors have random directions."""
    return quantized.knn_quantized(asked, store, k, max(k, store.count() * 15 // 100))


def knn_quantized(spark, folder):
    """Approximate neighbours by codes: exact scores for 15 % of the pairs."""
    return _recall_row(spark, folder, _quantized)


def knn_lsh_recall(spark, folder):
    return _recall_row(spark, folder, vectors.knn_lsh)


def knn_topk_padded(spark, folder):
    """Neighbours above 0.5 only, padded to a fixed number of places."""
    asked, found = _knn(spark, folder, PADDED)
    padded = vectors.pad_topk(asked, found.filter(F.col("score") > 0.5), PADDED)
    return padded.select("query_id", "rank", "vec_id", round_even(F.col("score"), 6).alias("score"))


def knn_lsh(spark, folder):
    found = _knn(spark, folder, NEIGHBOURS, vectors.knn_lsh)[1]
    return found.select("query_id", "rank", "vec_id", round_even(F.col("score"), 6).alias("score"))


def lsa_components(spark, folder):
    return _space(spark, folder).components


def lsa_energy(spark, folder):
    """The matrix's energy, and whether the components are orthonormal and hold what their singular values say."""
    space = _space(spark, folder)
    weights = materialize(lsa.fit_matrix(C.shared_index(spark, folder)), "matrix")
    total = weights.agg(F.sum(F.col("w") * F.col("w"))).first()[0]
    space = replace(space, components=materialize(space.components, "components"))
    coords = lsa.project(weights, space.components, space.columns, ["bid"])
    held = coords.agg(*[F.sum(F.col(c) * F.col(c)).alias(c) for c in space.columns])
    squares = [s * s for s in space.singular_values]
    near = [F.abs(F.col(c) - F.lit(x)) <= 1e-6 * squares[0] for c, x in zip(space.columns, squares)]
    captured = F.lit(float(sum(squares)))
    return held.select(
        F.lit(len(squares)).cast("long").alias("components"),
        round_even(F.lit(total), 4).alias("energy"),
        F.lit(lsa.is_orthonormal(space)).alias("orthonormal"),
        reduce(lambda a, b: a & b, near).alias("values_match"),
        ((captured > 0) & (captured <= F.lit(total) * (1 + 1e-9))).alias("within_energy"),
    )


def lsa_embed(spark, folder):
    vecs = semantic.document_vectors(C.shared_index(spark, folder), _space(spark, folder))
    return vecs.select(F.col("vec_id").alias("doc_id"), F.posexplode("embedding").alias("pos", "value"))


def document_ranking_lsa(spark, folder):
    space = _space(spark, folder)
    vecs = materialize(semantic.document_vectors(C.shared_index(spark, folder), space), "docvecs")
    return semantic.rank_documents_dense(query_table(spark, folder), vecs, space, TOP)


def sentence_match_lsa(spark, folder):
    space, ix = _space(spark, folder), C.shared_index(spark, folder)
    vecs = materialize(semantic.sentence_vectors(ix, space), "sentvecs")
    found = semantic.match_sentences_dense(query_table(spark, folder), ix, vecs, space)
    return found.withColumn("similarity", percent(F.col("score"))).drop("score")


# ---- streams -------------------------------------------------------------------


def stream_reuse(spark, folder):
    """Every benchmark passage arrives on a stream and is ranked."""
    out = new_path(spark, "stream-reuse")
    arriving = text_stream(spark, f"{folder}/benchmark*.parquet", "item_id BIGINT, text STRING")
    arriving = arriving.withColumnRenamed("item_id", "query_id")
    reuse_stream(arriving, C.shared_index(spark, folder), out, new_path(spark, "cp"), TOP).awaitTermination()
    report = spark.read.parquet(out)
    return report.select("query_id", "score", F.size("matches").alias("n_matches"), F.size("sentence_matches").alias("n_sentences"))


def stream_index(spark, folder):
    """Documents and benchmark passages arrive; the saved index holds each once."""
    path, cp = new_path(spark, "grown-index"), new_path(spark, "cp")
    I.save_index(C.shared_index(spark, folder), path)
    known = text_stream(spark, f"{folder}/documents*.parquet", "doc_id BIGINT, text STRING")
    index_stream(known, path, cp).awaitTermination()
    fresh = text_stream(spark, f"{folder}/benchmark*.parquet", "item_id BIGINT, text STRING")
    fresh = fresh.select((-F.col("item_id") - 1).alias("doc_id"), "text")
    index_stream(fresh, path, new_path(spark, "cp")).awaitTermination()
    return I.index_health(I.load_index(spark, path))


QUERIES = {
    "reuse_report": reuse_report,
    "document_ranking": document_ranking,
    "reuse_score": reuse_score,
    "sentence_match": sentence_match,
    "topk_candidates": topk_candidates,
    "rerank_lexical": rerank,
    "retrieve_then_rerank": retrieve_then_rerank,
    "rerank_model": rerank_with_model,
    "severity_flags": severity_flags,
    "threshold_matches": threshold_matches,
    "self_repetition": self_repetition,
    "corpus_sentence_match": corpus_sentence_match,
    "fit_corpus_idf": fit_corpus_idf,
    "build_index": build_index,
    "new_documents": new_documents,
    "corpus_overlay": corpus_overlay,
    "incremental_index": incremental_index,
    "out_of_vocabulary": out_of_vocabulary,
    "index_health": index_health,
    "index_roundtrip": index_roundtrip,
    "compacted_index": compacted_index,
    "knn_topk": knn_topk,
    "knn_pivots": knn_pivots,
    "knn_quantized": knn_quantized,
    "knn_lsh_recall": knn_lsh_recall,
    "knn_topk_padded": knn_topk_padded,
    "knn_lsh": knn_lsh,
    "lsa_components": lsa_components,
    "lsa_energy": lsa_energy,
    "lsa_embed": lsa_embed,
    "document_ranking_lsa": document_ranking_lsa,
    "sentence_match_lsa": sentence_match_lsa,
    "stream_reuse": stream_reuse,
    "stream_index": stream_index,
}

# ---- SQL -----------------------------------------------------------------------

_RANKING = f"WITH {C.SQL_DOCUMENT_SCORES} SELECT query_id, rank, source, similarity FROM doc_ranking WHERE rank <= {TOP}"

_BEST = f"""best AS (
  SELECT qs.query_id, qs.sent_idx, qs.sentence, c.source, c.source_idx, c.matched_sentence,
         coalesce({C.sql_percent('c.score')}, 0.0::DOUBLE) AS similarity
  FROM qs LEFT JOIN (SELECT * FROM cand_text WHERE rank = 1) c ON c.query_id = qs.query_id AND c.sent_idx = qs.sent_idx)"""

# Document ranking and best sentences in one statement.
_DOCS_AND_SENTENCES = f"""WITH {C.SQL_DOCUMENT_SCORES},
{C.sql_sentence_scores(1)[len(C.SQL_INDEX) + 2:]},
{_BEST}"""

_SELF = f"""WITH {C.cte_sentences('s', 'documents', 'doc_id')},
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
{C.cte_postings('p', 's', 'doc_id, sent_idx', 'sentence', 1)},
f AS (SELECT doc_id, term, count(*) AS df FROM p GROUP BY ALL),
i AS (SELECT doc_id, sent_idx, term, tf * {C.sql_idf('2 * n', '2 * df')} AS x FROM p JOIN f USING (doc_id, term) JOIN n USING (doc_id)),
w AS (SELECT doc_id, sent_idx, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id, sent_idx)) AS w FROM i),
pairs AS (
  SELECT a.doc_id, a.sent_idx, b.sent_idx AS partner_idx, sum(a.w * b.w) AS score
  FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.term = b.term AND a.sent_idx <> b.sent_idx GROUP BY ALL),
top AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY {C.sql_rank('score')} DESC, partner_idx) = 1),
rep AS (
  SELECT s.doc_id, s.sent_idx, s.sentence, t.partner_idx, o.sentence AS most_similar_to,
         coalesce({C.sql_percent('score')}, 0.0::DOUBLE) AS similarity
  FROM s LEFT JOIN top t ON t.doc_id = s.doc_id AND t.sent_idx = s.sent_idx
  LEFT JOIN s o ON o.doc_id = s.doc_id AND o.sent_idx = t.partner_idx)"""

_CORPUS_MATCH = f"""WITH {C.SQL_QUERIES},
{C.cte_sentences('qs', 'q', 'query_id')},
{C.cte_sentences('rs', 'documents', 'doc_id')},
{C.cte_postings('qp', 'qs', 'query_id, sent_idx', 'sentence', 1)},
{C.cte_postings('rp', 'rs', 'doc_id, sent_idx', 'sentence', 1)},
n AS (SELECT (SELECT count(*) FROM qs) + (SELECT count(*) FROM rs) AS n),
idf AS (SELECT term, {C.sql_idf('any_value(n)', 'count(*)')} AS idf
        FROM (SELECT term FROM qp UNION ALL SELECT term FROM rp), n GROUP BY term),
{C.cte_weights('qw', 'qp', 'query_id, sent_idx', 'idf')},
{C.cte_weights('rw', 'rp', 'doc_id, sent_idx', 'idf')},
scores AS (SELECT qw.query_id, qw.sent_idx, rw.doc_id AS source, rw.sent_idx AS source_idx, sum(qw.w * rw.w) AS score
           FROM qw JOIN rw ON qw.term = rw.term GROUP BY ALL),
top AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY query_id, sent_idx ORDER BY {C.sql_rank('score')} DESC, source, source_idx) = 1),
first AS (SELECT doc_id, sent_idx FROM rs ORDER BY doc_id, sent_idx LIMIT 1),
best AS (
  SELECT qs.query_id, qs.sent_idx, qs.sentence, coalesce(top.source, first.doc_id) AS source,
         coalesce(top.source_idx, first.sent_idx) AS source_idx, coalesce({C.sql_percent('score')}, 0.0::DOUBLE) AS similarity
  FROM qs LEFT JOIN first ON true LEFT JOIN top ON top.query_id = qs.query_id AND top.sent_idx = qs.sent_idx)
SELECT best.*, rs.sentence AS matched_sentence
FROM best LEFT JOIN rs ON rs.doc_id = source AND rs.sent_idx = source_idx"""

_RERANKED = f"""WITH {C.sql_sentence_scores(SHORTLIST)},
sets AS (SELECT *, {C.sql_word_set('sentence')} AS qset, {C.sql_word_set('matched_sentence')} AS cset FROM cand_text),
jac AS (SELECT *, {C.sql_jaccard('qset', 'cset')} AS j FROM sets),
reranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, sent_idx ORDER BY j DESC, rank) AS rerank_rank,
         count(*) OVER (PARTITION BY query_id, sent_idx) AS n
  FROM jac)"""

_KNN = f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {C.sql_rank('list_dot_product(a.v, b.v)')} AS score FROM e a, e b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM x)"""

_ALL_DOCS = "arrived AS (SELECT -item_id - 1 AS doc_id, text FROM benchmark)"

SQL = {
    "reuse_report": f"""{_DOCS_AND_SENTENCES},
d AS (SELECT query_id, max(similarity) AS score, string_agg(rank || ':' || source, ',' ORDER BY rank) AS matches
      FROM doc_ranking WHERE rank <= {TOP} GROUP BY query_id),
m AS (SELECT query_id, string_agg(sent_idx || ':' || coalesce(source::VARCHAR, 'none'), ',' ORDER BY sent_idx) AS sentence_sources,
             count(*) FILTER (similarity > 70.0) AS copied_sentences FROM best GROUP BY query_id)
SELECT q.query_id, coalesce(score, 0.0::DOUBLE) AS score, coalesce(matches, '') AS matches,
       coalesce(sentence_sources, '') AS sentence_sources, coalesce(copied_sentences, 0) AS copied_sentences
FROM q LEFT JOIN d USING (query_id) LEFT JOIN m USING (query_id)""",
    "document_ranking": _RANKING,
    "reuse_score": f"""WITH {C.SQL_DOCUMENT_SCORES}
SELECT q.query_id, coalesce(max(similarity), 0.0::DOUBLE) AS score FROM q LEFT JOIN doc_ranking USING (query_id) GROUP BY q.query_id""",
    "sentence_match": f"WITH {C.sql_sentence_scores(1)}, {_BEST} SELECT * FROM best",
    "topk_candidates": f"""WITH {C.sql_sentence_scores(NEIGHBOURS)}
SELECT query_id, sent_idx, rank, source, source_idx, {C.sql_percent('score')} AS similarity FROM cand""",
    "rerank_lexical": f"{_RERANKED} SELECT query_id, sent_idx, rank, rerank_rank, {C.sql_round('j', 4)} AS rerank_score FROM reranked",
    "retrieve_then_rerank": f"""{_RERANKED},
picked AS (SELECT *, CASE WHEN n > 1 THEN j ELSE score END AS s, CASE WHEN n > 1 THEN 'rerank' ELSE 'cosine' END AS kind
           FROM reranked WHERE rerank_rank = 1)
SELECT qs.query_id, qs.sent_idx, p.source, p.source_idx, coalesce({C.sql_percent('s')}, 0.0::DOUBLE) AS similarity, kind AS score_kind
FROM qs LEFT JOIN picked p ON p.query_id = qs.query_id AND p.sent_idx = qs.sent_idx""",
    "rerank_model": f"""WITH {C.sql_sentence_scores(SHORTLIST)},
s AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(3.0::DOUBLE - abs(length(sentence) - length(matched_sentence)) / 10.0::DOUBLE))) AS j FROM cand_text)
SELECT query_id, sent_idx, rank, row_number() OVER (PARTITION BY query_id, sent_idx ORDER BY j DESC, rank) AS rerank_rank,
       {C.sql_round('j', 4)} AS rerank_score FROM s""",
    "severity_flags": f"""WITH {C.sql_sentence_scores(1)}, {_BEST}
SELECT query_id, sent_idx, source, similarity,
       CASE WHEN similarity > 70 THEN 'high' WHEN similarity > 40 THEN 'medium' ELSE 'none' END AS severity
FROM best WHERE source IS NOT NULL""",
    "threshold_matches": f"""{_DOCS_AND_SENTENCES}
SELECT query_id, -1 AS sent_idx, source, similarity FROM doc_ranking WHERE rank <= {TOP} AND similarity / 100.0::DOUBLE >= 0.35::DOUBLE
UNION ALL SELECT query_id, sent_idx, source, similarity FROM best WHERE similarity / 100.0::DOUBLE >= 0.7::DOUBLE""",
    "self_repetition": f"{_SELF} SELECT * FROM rep",
    "corpus_sentence_match": _CORPUS_MATCH,
    "fit_corpus_idf": f"WITH {C.SQL_INDEX} SELECT term, df, {C.sql_round('idf', 6)} AS idf FROM vocab",
    "build_index": f"""WITH {C.SQL_INDEX},
{C.cte_weights('dw', 'dp', 'doc_id', 'vocab')},
{C.cte_weights('sw', 'sp', 'doc_id, sent_idx', 'vocab')},
du AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text),
su AS (SELECT min((doc_id, sent_idx)) AS k FROM ds GROUP BY sentence)
SELECT 'documents' AS name, count(*) AS rows, sum(length(text))::DOUBLE AS content FROM documents
UNION ALL SELECT 'sentences', count(*), sum(length(sentence))::DOUBLE FROM ds
UNION ALL SELECT 'vocabulary', count(*), {C.sql_round('sum(idf)', 2)} FROM vocab
UNION ALL SELECT 'document_copies', count(*), count(DISTINCT text)::DOUBLE FROM documents
UNION ALL SELECT 'sentence_copies', count(*), count(DISTINCT sentence)::DOUBLE FROM ds
UNION ALL SELECT 'document_weights', count(*), {C.sql_round('sum(w)', 2)} FROM dw SEMI JOIN du USING (doc_id)
UNION ALL SELECT 'sentence_weights', count(*), {C.sql_round('sum(w)', 2)} FROM sw SEMI JOIN su ON (sw.doc_id, sw.sent_idx) = su.k""",
    "new_documents": f"WITH {_ALL_DOCS} SELECT doc_id, text FROM arrived",
    "corpus_overlay": """SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)
UNION ALL SELECT item_id, text FROM benchmark""",
    "incremental_index": f"""WITH {C.SQL_INDEX}, {_ALL_DOCS},
fresh AS (SELECT min(doc_id) AS doc_id, text FROM arrived WHERE text NOT IN (SELECT text FROM documents) GROUP BY text),
{C.cte_postings('ap', 'fresh', 'doc_id', 'text', 2)},
{C.cte_sentences('asn', 'arrived', 'doc_id')}
SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM arrived) AS documents,
       (SELECT count(*) FROM ds) + (SELECT count(*) FROM asn) AS sentences,
       (SELECT count(*) FROM ap SEMI JOIN vocab USING (term)) AS new_vector_terms""",
    "out_of_vocabulary": f"""WITH {C.SQL_INDEX}, {_ALL_DOCS},
{C.cte_postings('ap', 'arrived', 'doc_id', 'text', 2)}
SELECT doc_id, {C.sql_round('1.0::DOUBLE - count(vocab.term) / count(*)::DOUBLE', 6)} AS oov_ratio FROM ap LEFT JOIN vocab USING (term) GROUP BY doc_id""",
    "index_health": f"""WITH {C.cte_sentences('ds', 'documents', 'doc_id')}
SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM ds) AS sentences, 'heuristic' AS detector""",
    "index_roundtrip": _RANKING,
    "compacted_index": f"""WITH {_ALL_DOCS},
a AS (SELECT doc_id, text, 0::BIGINT AS batch FROM documents UNION ALL SELECT doc_id, text, 1::BIGINT FROM arrived),
{C.cte_sentences('asn', 'a', 'doc_id')},
n AS (SELECT doc_id, count(*) AS sentences FROM asn GROUP BY doc_id)
SELECT doc_id, batch, coalesce(sentences, 0) AS sentences,
       first(doc_id) OVER (PARTITION BY text ORDER BY batch, doc_id) AS first_doc_id FROM a LEFT JOIN n USING (doc_id)""",
    "knn_topk": f"{_KNN} SELECT query_id, rank, vec_id, {C.sql_round('score', 6)} AS score FROM r WHERE rank <= {NEIGHBOURS}",
    "knn_pivots": f"{_KNN} SELECT query_id, rank, vec_id, {C.sql_round('score', 6)} AS score FROM r WHERE rank <= {NEIGHBOURS}",
    # Every row of the matrix is a text's unit vector, a copy counted again.
    "lsa_energy": f"""WITH {C.SQL_INDEX},
{C.cte_weights('dw', 'dp', 'doc_id', 'vocab')},
{C.cte_weights('sw', 'sp', 'doc_id, sent_idx', 'vocab')},
w AS (SELECT w FROM dw UNION ALL SELECT w FROM sw)
SELECT (SELECT least({LSA_COMPONENTS}, count(*) - 1) FROM vocab) AS components, {C.sql_round('sum(w * w)', 4)} AS energy,
       TRUE AS orthonormal, TRUE AS values_match, TRUE AS within_energy FROM w""",
    "knn_quantized": f"SELECT count(*) AS queries, count(*) * {NEIGHBOURS} AS found, TRUE AS true_scores, TRUE AS recall_reached FROM embeddings",
    "knn_lsh_recall": f"SELECT count(*) AS queries, count(*) * {NEIGHBOURS} AS found, TRUE AS true_scores, TRUE AS recall_reached FROM embeddings",
    "knn_topk_padded": f"""{_KNN}
SELECT query_id, rank, CASE WHEN score > 0.5::DOUBLE THEN vec_id ELSE -1 END AS vec_id,
       CASE WHEN score > 0.5::DOUBLE THEN {C.sql_round('score', 6)} ELSE 0.0::DOUBLE END AS score
FROM r WHERE rank <= {PADDED}""",
    "stream_reuse": f"""{_DOCS_AND_SENTENCES},
d AS (SELECT query_id, max(similarity) AS score, count(*) AS n_matches FROM doc_ranking WHERE rank <= {TOP} GROUP BY query_id),
m AS (SELECT query_id, count(*) AS n_sentences FROM best GROUP BY query_id)
SELECT q.query_id, coalesce(score, 0.0::DOUBLE) AS score, coalesce(n_matches, 0) AS n_matches, coalesce(n_sentences, 0) AS n_sentences
FROM q LEFT JOIN d USING (query_id) LEFT JOIN m USING (query_id)""",
    "stream_index": f"""WITH {_ALL_DOCS}, {C.cte_sentences('ds', 'documents', 'doc_id')}, {C.cte_sentences('asn', 'arrived', 'doc_id')}
SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM arrived) AS documents,
       (SELECT count(*) FROM ds) + (SELECT count(*) FROM asn) AS sentences, 'heuristic' AS detector""",
}
