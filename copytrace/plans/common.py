"""Pieces shared by the registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from copytrace.functions.text import NOT_WORD_OR_SPACE, SPACE, SPACE_CHARS, TOKEN
from copytrace.operators.index import Index, build_index
from copytrace.sources.tables import corpus_table

_INDEXES: dict[tuple[str, str], Index] = {}


def shared_index(spark: SparkSession, folder: str) -> Index:
    """Index of the whole documents table, built once per application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _INDEXES:
        _INDEXES[key] = build_index(corpus_table(spark, folder))
    return _INDEXES[key]


def widen(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, so that both engines return the same types."""
    small = (S.IntegerType, S.ShortType, S.ByteType)
    return df.select(*[F.col(f.name).cast("long") if isinstance(f.dataType, small) else F.col(f.name) for f in df.schema.fields])


# ---- SQL fragments (DuckDB) -------------------------------------------------

SQL_SPACES = f"'{SPACE_CHARS}'"


def sql_strip(x: str) -> str:
    return f"trim({x}, {SQL_SPACES})"


def sql_clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({x}), '{NOT_WORD_OR_SPACE}', ' ', 'g'), '{SPACE}+', ' ', 'g'))"


def sql_sentences(x: str) -> str:
    marked = rf"regexp_replace({sql_strip(x)}, '([.!?]){SPACE}+', '\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s: s <> '')"


def sql_words(x: str) -> str:
    return f"list_filter(string_split_regex({sql_strip(x)}, '{SPACE}+'), lambda w: w <> '')"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{TOKEN}')"


def sql_grams(t: str, n: int) -> str:
    if n == 1:
        return t
    return f"list_concat({t}, list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1]))"


def sql_round(x: str, digits: int) -> str:
    scale = "1" + "0" * digits + ".0"
    return f"(round_even(({x}) * {scale}::DOUBLE, 0) / {scale}::DOUBLE)"


def sql_percent(x: str) -> str:
    return sql_round(f"({x}) * 100.0::DOUBLE", 2)


def sql_rank(x: str) -> str:
    return sql_round(x, 9)


def cte_sentences(name: str, source: str, keys: str, text: str = "text") -> str:
    """name(keys, sent_idx, sentence)"""
    return f"""{name} AS (
  SELECT {keys}, unnest(range(len(s))) AS sent_idx, unnest(s) AS sentence
  FROM (SELECT {keys}, {sql_sentences(text)} AS s FROM {source}))"""


def cte_postings(name: str, source: str, keys: str, text: str, n: int) -> str:
    """name(keys, term, tf)"""
    return f"""{name} AS (
  SELECT {keys}, term, count(*) AS tf
  FROM (SELECT {keys}, unnest({sql_grams('t', n)}) AS term
        FROM (SELECT {keys}, {sql_tokens(text)} AS t FROM {source}))
  GROUP BY ALL)"""


def cte_weights(name: str, posts: str, keys: str, idf: str) -> str:
    """name(keys, term, w): unit rows; terms missing from ``idf(term, idf)`` go."""
    return f"""{name} AS (
  SELECT {keys}, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY {keys})) AS w
  FROM {posts} JOIN {idf} USING (term))"""


def sql_idf(n: str, df: str) -> str:
    return f"(ln((1.0::DOUBLE + {n}) / (1.0::DOUBLE + {df})) + 1.0::DOUBLE)"


SQL_QUERIES = "q AS (SELECT item_id AS query_id, text FROM benchmark)"

# Index of the documents table: vocabulary over documents and their sentences.
SQL_INDEX = f"""{SQL_QUERIES},
{cte_sentences('ds', 'documents', 'doc_id')},
{cte_postings('dp', 'documents', 'doc_id', 'text', 2)},
{cte_postings('sp', 'ds', 'doc_id, sent_idx', 'sentence', 2)},
n_rows AS (SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM ds) AS n),
vocab AS (
  SELECT term, count(*) AS df, {sql_idf('any_value(n)', 'count(*)')} AS idf
  FROM (SELECT term FROM dp UNION ALL SELECT term FROM sp), n_rows
  GROUP BY term)"""

SQL_DOCUMENT_SCORES = f"""{SQL_INDEX},
{cte_weights('dw', 'dp', 'doc_id', 'vocab')},
{cte_postings('qp', 'q', 'query_id', 'text', 2)},
{cte_weights('qw', 'qp', 'query_id', 'vocab')},
doc_scores AS (
  SELECT query_id, doc_id, sum(qw.w * dw.w) AS score
  FROM qw JOIN dw USING (term) GROUP BY ALL),
doc_ranking AS (
  SELECT query_id, doc_id AS source, {sql_percent('score')} AS similarity,
         row_number() OVER (PARTITION BY query_id ORDER BY {sql_rank('score')} DESC, doc_id) AS rank
  FROM doc_scores)"""


def sql_sentence_scores(k: int) -> str:
    """cand(query_id, sent_idx, rank, source, source_idx, score): k best each."""
    return f"""{SQL_INDEX},
{cte_weights('sw', 'sp', 'doc_id, sent_idx', 'vocab')},
{cte_sentences('qs', 'q', 'query_id')},
{cte_postings('qsp', 'qs', 'query_id, sent_idx', 'sentence', 2)},
{cte_weights('qsw', 'qsp', 'query_id, sent_idx', 'vocab')},
sent_scores AS (
  SELECT qsw.query_id, qsw.sent_idx, sw.doc_id AS source, sw.sent_idx AS source_idx, sum(qsw.w * sw.w) AS score
  FROM qsw JOIN sw ON qsw.term = sw.term GROUP BY ALL),
cand AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, sent_idx ORDER BY {sql_rank('score')} DESC, source, source_idx) AS rank
  FROM sent_scores QUALIFY rank <= {k}),
cand_text AS (
  SELECT cand.*, qs.sentence AS sentence, ds.sentence AS matched_sentence
  FROM cand JOIN qs ON qs.query_id = cand.query_id AND qs.sent_idx = cand.sent_idx
  JOIN ds ON ds.doc_id = source AND ds.sent_idx = source_idx)"""



def sql_word_set(x: str) -> str:
    return f"list_distinct({sql_words(f'lower({x})')})"


def sql_jaccard(a: str, b: str) -> str:
    """Of two duplicate-free list expressions."""
    shared = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 0.0::DOUBLE ELSE {shared} / (len({a}) + len({b}) - {shared})::DOUBLE END)"
