"""Queries over text columns, term tables and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from copytrace.functions import text as T
from copytrace.functions.numeric import l2_normalize, round_even, sigmoid, softmax
from copytrace.operators import similarity, split, train, vectorize
from copytrace.operators.statistics import STATS, text_stats
from copytrace.operators.vectors import embed_table
from copytrace.plans import common as C
from copytrace.session import new_path
from copytrace.sources.files import MAX_CHARS, MIN_CHARS, accepted, extract_text, load_blocks, rejected, valid_texts
from copytrace.sources.labelled import encode_label, labelled_turns, normalize_labelled, row_ids
from copytrace.sources.tables import corpus_table, read_table, spread, turn_table

VECTOR_DIGITS = 6
# Small enough that the test tables make many blocks; a corpus takes the default.
LINE_BLOCK = 256 << 10


def clean_text(spark, folder):
    return corpus_table(spark, folder).select("doc_id", T.clean(F.col("text")).alias("cleaned"))


def split_sentences(spark, folder):
    return vectorize.with_sentences(corpus_table(spark, folder), ["doc_id"])


def tokenize(spark, folder):
    toks = corpus_table(spark, folder).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return toks.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def word_ngrams(spark, folder):
    toks = corpus_table(spark, folder).select("doc_id", T.tokens(F.col("text")).alias("t"))
    grams = toks.select("doc_id", T.ngrams(F.col("t"), 2).alias("g"))
    return grams.select("doc_id", F.size("g").alias("n_grams"), F.array_join("g", "|").alias("grams"))


def stats(spark, folder):
    return text_stats(corpus_table(spark, folder)).select("doc_id", *STATS)


def valid_text_filter(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return valid_texts(docs).select("doc_id", F.char_length("text").alias("n_chars"))


def normalize_labels(spark, folder):
    """How many words of each document read as a machine or a human label."""
    words = corpus_table(spark, folder).select("doc_id", T.words(F.col("text")).alias("w"))
    kinds = words.select("doc_id", F.transform("w", lambda w: F.coalesce(T.label_class(w), F.lit("none"))).alias("k"))
    return kinds.select("doc_id", *[_times("k", c).alias(f"{c}_words") for c in ("ai", "human", "none")])


def _times(array: str, value: str):
    return F.size(F.filter(array, lambda x: x == value))


def labelled_source(spark, folder):
    labelled = labelled_turns(turn_table(spark, folder))
    return labelled.select("conv_id", "turn", "text", "label", encode_label(F.col("label")).alias("label_id"))


def numeric_labels(spark, folder):
    """documents with their quality number as a labelled set with numbered classes."""
    docs = read_table(spark, folder, "documents").select("doc_id", F.col("text").alias("abstract"))
    quality = read_table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    out = normalize_labelled(docs.join(quality, "doc_id", "left"))
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"))


def _adjacent_turns(spark, folder):
    """Each turn with the next one of its conversation."""
    t = turn_table(spark, folder).select("conv_id", "turn", "text")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return t.withColumnRenamed("text", "a").join(nxt, ["conv_id", "turn"])


def jaccard_similarity(spark, folder):
    pairs = similarity.pair_jaccard(_adjacent_turns(spark, folder), ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", round_even(F.col("jaccard"), 4).alias("jaccard"))


def pair_cosine(spark, folder):
    return similarity.pair_cosine(_adjacent_turns(spark, folder), ["conv_id", "turn"])


def _vectors(spark, folder):
    v = read_table(spark, folder, "embeddings")
    return v.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _by_position(df, value):
    return df.select("vec_id", F.posexplode(value).alias("pos", "x")).select(
        "vec_id", "pos", round_even(F.col("x"), VECTOR_DIGITS).alias("value")
    )


def sigmoid_scores(spark, folder):
    return _by_position(_vectors(spark, folder), F.transform("v", sigmoid))


def softmax_probs(spark, folder):
    return _by_position(_vectors(spark, folder), softmax(F.col("v"), 0.5))


def l2_normalized(spark, folder):
    return _by_position(_vectors(spark, folder), l2_normalize(F.transform("v", lambda x: x * 3.0)))


def term_frequency(spark, folder):
    return vectorize.postings(corpus_table(spark, folder), ["doc_id"])


def idf_table(spark, folder):
    docs = corpus_table(spark, folder)
    df = vectorize.document_frequency(vectorize.postings(docs, ["doc_id"]))
    idf = vectorize.smoothed_idf(docs.count())
    return df.select("term", "df", round_even(idf, VECTOR_DIGITS).alias("idf"))


def _weights(spark, folder, n):
    w = vectorize.tfidf_weights(corpus_table(spark, folder), ["doc_id"], n=n)
    return w.select("doc_id", "term", round_even(F.col("w"), VECTOR_DIGITS).alias("w"))


def tfidf_weights(spark, folder):
    return _weights(spark, folder, 1)


def tfidf_ngram_weights(spark, folder):
    return _weights(spark, folder, 2)


def tfidf_maxdf_vocab(spark, folder):
    turns = labelled_turns(turn_table(spark, folder))
    df = vectorize.document_frequency(vectorize.postings(turns, ["conv_id", "turn"], n=2))
    return vectorize.max_df_vocabulary(df, turns.count(), 0.95)


def shuffled_chunk(spark, folder):
    turns = labelled_turns(turn_table(spark, folder))
    return split.shuffled_chunk(turns, ["conv_id", "turn"], 1, 200).select("conv_id", "turn", "position")


def stratified_split(spark, folder):
    turns = labelled_turns(turn_table(spark, folder))
    return split.stratified_split(turns, ["conv_id", "turn"]).select("conv_id", "turn", "label", "split")


def balanced_class_weights(spark, folder):
    weighted = train.balanced_weights(labelled_turns(turn_table(spark, folder)))
    return weighted.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), round_even(F.first("weight"), VECTOR_DIGITS).alias("weight")
    )


def _files(spark, folder):
    """The documents table as files: UTF-8 content under a name with a suffix."""
    docs = read_table(spark, folder, "documents")
    name = F.concat("source", F.lit("/"), F.col("lang"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".TXT"))
    pages = read_table(spark, folder, "pages").select(
        F.concat(F.lit("web/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content")
    )
    return spread(docs.select(name.alias("path"), F.encode("text", "UTF-8").alias("content"))).unionByName(pages)


def ingest_documents(spark, folder):
    return accepted(extract_text(_files(spark, folder)))


def rejected_files(spark, folder):
    return rejected(extract_text(_files(spark, folder)))


def ingest_blocks(spark, folder):
    """The lines of the documents, written as plain text files and read in blocks: none cut, lost or read twice."""
    path = new_path(spark, "texts")
    spread(read_table(spark, folder, "documents")).select(F.coalesce("text", F.lit("")).alias("value")).write.text(path)
    lines = load_blocks(spark, path, LINE_BLOCK).select(F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.where("line <> ''")
    return lines.groupBy(F.md5("line").alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))


PLACES = 32


def _hashed_words(texts):
    import hashlib

    import numpy as np

    out = np.zeros((len(texts), PLACES))
    for i, text in enumerate(texts):
        for word in (text or "").lower().split(" "):
            if word:
                out[i, int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % PLACES] += 1.0
    return out


def embed(spark, folder):
    """A stand-in for a caller's model: word counts hashed into a few places."""
    vecs = embed_table(corpus_table(spark, folder), _hashed_words)
    return vecs.select("doc_id", F.posexplode("embedding").alias("pos", "x")).select(
        "doc_id", "pos", round_even(F.col("x"), VECTOR_DIGITS).alias("value")
    )


QUERIES = {
    "clean_text": clean_text,
    "split_sentences": split_sentences,
    "tokenize": tokenize,
    "word_ngrams": word_ngrams,
    "text_stats": stats,
    "valid_text_filter": valid_text_filter,
    "normalize_labels": normalize_labels,
    "labelled_source": labelled_source,
    "numeric_labels": numeric_labels,
    "jaccard_similarity": jaccard_similarity,
    "pair_cosine": pair_cosine,
    "sigmoid_scores": sigmoid_scores,
    "softmax_probs": softmax_probs,
    "l2_normalize": l2_normalized,
    "term_frequency": term_frequency,
    "idf_table": idf_table,
    "tfidf_weights": tfidf_weights,
    "tfidf_ngram_weights": tfidf_ngram_weights,
    "tfidf_maxdf_vocab": tfidf_maxdf_vocab,
    "shuffled_chunk": shuffled_chunk,
    "stratified_split": stratified_split,
    "balanced_class_weights": balanced_class_weights,
    "ingest_documents": ingest_documents,
    "rejected_files": rejected_files,
    "ingest_blocks": ingest_blocks,
    "embed_table": embed,
}

# ---- SQL ----------------------------------------------------------------------

SQL_TURNS = """turns AS (
  SELECT conv_id, turn, text, CASE role WHEN 'assistant' THEN 'ai' WHEN 'user' THEN 'human' END AS label
  FROM conversations WHERE role IN ('assistant', 'user') AND text IS NOT NULL)"""
SQL_PAIRS = """pairs AS (
  SELECT x.conv_id, x.turn, x.text AS a, y.text AS b
  FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)"""


def sql_text_stats(source: str, keys: str) -> str:
    """CTE stats(keys, the six statistics)."""
    edge = T.WORD_EDGE.replace("'", "''")
    distinct = f"len(list_distinct(list_transform(w, lambda x: trim(lower(x), '{edge}'))))"
    sums = "len(l)::DOUBLE * list_sum(list_transform(l, lambda x: x * x))::DOUBLE - list_sum(l)::DOUBLE * list_sum(l)::DOUBLE"
    return f"""pieces AS (
  SELECT {keys}, {C.sql_words('text')} AS w,
         list_transform({C.sql_sentences('text')}, lambda s: len({C.sql_words('s')})) AS l
  FROM {source}),
stats AS (
  SELECT {keys}, len(w) AS word_count, len(l) AS sentence_count,
         greatest(1, round_even(len(w) / 200.0::DOUBLE, 0))::BIGINT AS reading_time,
         {C.sql_round('len(w) / greatest(1, len(l))::DOUBLE', 2)} AS avg_sentence_length,
         CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE {C.sql_round(f'{distinct} / len(w)::DOUBLE', 3)} END AS lexical_diversity,
         CASE WHEN len(l) > 1 THEN {C.sql_round(f'sqrt({sums}) / len(l)::DOUBLE', 2)} ELSE 0.0::DOUBLE END AS burstiness
  FROM pieces)"""


def _sql_weights(n: int) -> str:
    return f"""WITH {C.cte_postings('p', 'documents', 'doc_id', 'text', n)},
idf AS (SELECT term, {C.sql_idf('(SELECT count(*) FROM documents)', 'count(*)')} AS idf FROM p GROUP BY term),
{C.cte_weights('w', 'p', 'doc_id', 'idf')}
SELECT doc_id, term, {C.sql_round('w', 6)} AS w FROM w"""


def _sql_positions(value: str) -> str:
    return f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
x AS (SELECT vec_id, {value} AS x FROM v)
SELECT vec_id, unnest(range(len(x))) AS pos, {C.sql_round('unnest(x)', 6)} AS value FROM x"""


_KIND = "CASE WHEN regexp_matches(lower(x), 'fake|ai|machine|generated') THEN 'ai' WHEN regexp_matches(lower(x), 'real|human') THEN 'human' ELSE 'none' END"
_SQUARE = "sum({m} * {m} * CASE WHEN {o} > 0 THEN 1.0::DOUBLE ELSE power(ln(1.5::DOUBLE) + 1.0, 2) END)"

SQL = {
    "clean_text": f"SELECT doc_id, {C.sql_clean('text')} AS cleaned FROM documents",
    "split_sentences": f"WITH {C.cte_sentences('s', 'documents', 'doc_id')} SELECT doc_id, sent_idx, sentence FROM s",
    "tokenize": f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {C.sql_tokens('text')} AS t FROM documents)",
    "word_ngrams": f"""SELECT doc_id, len(g) AS n_grams, array_to_string(g, '|') AS grams
FROM (SELECT doc_id, {C.sql_grams('t', 2)} AS g FROM (SELECT doc_id, {C.sql_tokens('text')} AS t FROM documents))""",
    "text_stats": f"WITH {sql_text_stats('documents', 'doc_id')} SELECT * FROM stats",
    "valid_text_filter": f"SELECT doc_id, length(text) AS n_chars FROM documents WHERE length(text) BETWEEN {MIN_CHARS} AND {MAX_CHARS}",
    "normalize_labels": f"""WITH k AS (SELECT doc_id, list_transform({C.sql_words('text')}, lambda x: {_KIND}) AS k FROM documents)
SELECT doc_id, len(list_filter(k, lambda x: x = 'ai')) AS ai_words, len(list_filter(k, lambda x: x = 'human')) AS human_words,
       len(list_filter(k, lambda x: x = 'none')) AS none_words FROM k""",
    "labelled_source": f"WITH {SQL_TURNS} SELECT conv_id, turn, text, label, (label = 'ai')::BIGINT AS label_id FROM turns",
    "numeric_labels": """SELECT CASE quality WHEN 0 THEN 'human' WHEN 1 THEN 'ai' ELSE quality::VARCHAR END AS label, count(*) AS n, sum(length(text))::BIGINT AS chars
FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND text IS NOT NULL GROUP BY 1""",
    "jaccard_similarity": f"""WITH {SQL_PAIRS},
s AS (SELECT conv_id, turn, {C.sql_word_set('a')} AS sa, {C.sql_word_set('b')} AS sb FROM pairs)
SELECT conv_id, turn, {C.sql_round(C.sql_jaccard('sa', 'sb'), 4)} AS jaccard FROM s""",
    "pair_cosine": f"""WITH {SQL_PAIRS},
{C.cte_postings('pa', 'pairs', 'conv_id, turn', 'a', 1)},
{C.cte_postings('pb', 'pairs', 'conv_id, turn', 'b', 1)},
t AS (SELECT coalesce(pa.conv_id, pb.conv_id) AS conv_id, coalesce(pa.turn, pb.turn) AS turn,
             coalesce(pa.tf, 0) AS ta, coalesce(pb.tf, 0) AS tb
      FROM pa FULL JOIN pb ON pa.conv_id = pb.conv_id AND pa.turn = pb.turn AND pa.term = pb.term),
s AS (SELECT conv_id, turn, sum(ta * tb) AS dot, {_SQUARE.format(m='ta', o='tb')} AS aa, {_SQUARE.format(m='tb', o='ta')} AS bb
      FROM t GROUP BY ALL)
SELECT conv_id, turn, coalesce(CASE WHEN aa > 0 AND bb > 0 THEN {C.sql_percent('dot / sqrt(aa * bb)')} END, 0.0::DOUBLE) AS similarity
FROM pairs LEFT JOIN s USING (conv_id, turn)""",
    "sigmoid_scores": _sql_positions("list_transform(v, lambda z: 1.0::DOUBLE / (1.0::DOUBLE + exp(-z)))"),
    "softmax_probs": _sql_positions(
        "list_transform(v, lambda z: exp((z - list_max(v)) / 0.5::DOUBLE) / list_sum(list_transform(v, lambda y: exp((y - list_max(v)) / 0.5::DOUBLE))))"
    ),
    "l2_normalize": _sql_positions(
        "list_transform(v, lambda z: (z * 3.0::DOUBLE) / sqrt(list_sum(list_transform(v, lambda y: (y * 3.0::DOUBLE) * (y * 3.0::DOUBLE)))))"
    ),
    "term_frequency": f"WITH {C.cte_postings('p', 'documents', 'doc_id', 'text', 1)} SELECT doc_id, term, tf FROM p",
    "idf_table": f"""WITH {C.cte_postings('p', 'documents', 'doc_id', 'text', 1)}
SELECT term, count(*) AS df, {C.sql_round(C.sql_idf('(SELECT count(*) FROM documents)', 'count(*)'), 6)} AS idf FROM p GROUP BY term""",
    "tfidf_weights": _sql_weights(1),
    "tfidf_ngram_weights": _sql_weights(2),
    "tfidf_maxdf_vocab": f"""WITH {SQL_TURNS}, {C.cte_postings('p', 'turns', 'conv_id, turn', 'text', 2)}
SELECT term, count(*) AS df FROM p GROUP BY term HAVING count(*) <= 0.95::DOUBLE * (SELECT count(*) FROM turns)""",
    "shuffled_chunk": f"""WITH {SQL_TURNS}
SELECT conv_id, turn, row_number() OVER (ORDER BY md5('42:' || conv_id || ':' || turn), conv_id, turn) - 1 AS position
FROM turns QUALIFY position >= 200 AND position < 400""",
    "stratified_split": f"""WITH {SQL_TURNS},
c AS (SELECT label, count(*) AS n FROM turns GROUP BY label),
a AS (SELECT label, n, ceil(round(sum(n) OVER () * 0.2::DOUBLE, 9)) AS target, sum(n) OVER () AS total FROM c),
s AS (SELECT label, target, n * target / total AS share, floor(n * target / total) AS base FROM a),
quota AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY share - base DESC, label) <= target - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || conv_id || ':' || turn), conv_id, turn) AS rank FROM turns)
SELECT conv_id, turn, label, CASE WHEN rank <= quota THEN 'test' ELSE 'train' END AS split FROM r JOIN quota USING (label)""",
    "balanced_class_weights": f"""WITH {SQL_TURNS}, c AS (SELECT label, count(*) AS n FROM turns GROUP BY label)
SELECT label, n, {C.sql_round('sum(n) OVER ()::DOUBLE / (count(*) OVER () * n)', 6)} AS weight FROM c""",
    "ingest_documents": "SELECT lang || '_' || doc_id || '.TXT' AS doc_id, text FROM documents",
    "rejected_files": "SELECT page_id || '.html' AS doc_id, 'unsupported' AS reason FROM pages",
    "ingest_blocks": """SELECT md5(line) AS line_md5, count(*) AS n
FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY line""",
    "embed_table": f"""WITH w AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM documents),
p AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 4))::BIGINT % {PLACES} AS pos, count(*)::DOUBLE AS n FROM w WHERE word <> '' GROUP BY ALL),
l AS (SELECT doc_id, sqrt(sum(n * n)) AS length FROM p GROUP BY doc_id),
g AS (SELECT doc_id, unnest(range({PLACES})) AS pos FROM documents)
SELECT g.doc_id, g.pos::INT AS pos, {C.sql_round('coalesce(n / length, 0.0::DOUBLE)', VECTOR_DIGITS)} AS value
FROM g LEFT JOIN p ON p.doc_id = g.doc_id AND p.pos = g.pos LEFT JOIN l ON l.doc_id = g.doc_id""",
}
