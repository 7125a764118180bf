"""Reference corpus as a set of stored tables.

``documents(batch, doc_id, text)``        one row per corpus document
``sentences(batch, doc_id, sent_idx, sentence)``
``vocabulary(term, df, idf, doc_hot, sent_hot)``  frozen at build time, with what is
    hot for the matching join: both of its sides must agree on that
``document_copies`` / ``sentence_copies(h, bid, member)``  every place of a text: its hash,
    the key of its first place in corpus order (batch, doc_id[, sent_idx]), its own key
``document_weights`` / ``sentence_weights(bid, term, w, hot, hot_norm)``
    unit TF-IDF vectors, one per *distinct* text, under the key of its first place

``batch`` is 0 for the first build and grows with every append, so documents
added later come later in corpus order.

Saved, each table has one folder per batch of writing. An append asks the Bloom
filters of the stored batches which of its ids and text hashes may be there, and
looks up only those. ``compact_saved`` merges the folders into one, sorted by
what the table is searched by; ``remove_superseded`` deletes what no reader can
be reading any more. Saves, appends and these two come from one writer at a
time; any number may read meanwhile.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copytrace.functions import text as T
from copytrace.operators.arrivals import StoredKeys, blocks_for, build_filter
from copytrace.operators.vectorize import (
    VOCAB_ROW_BYTES,
    attach_by_part,
    attach_vocabulary,
    counts_by_part,
    normalized_weights,
    part_of,
    parts_for,
    postings,
    smoothed_idf,
    with_sentences,
)
from copytrace.session import discard, fits_broadcast, materialize

NGRAMS = 2
# A term in more documents / sentences than this is hot for the matching join. Cold terms pair a
# query with at most this many rows each; a higher value prunes more pairs of
# long shortlists, a lower one makes the first join cheaper.
HOT_DOCUMENTS = 256
HOT_ROWS = 2048
TABLES = ("documents", "sentences", "vocabulary", "document_copies", "sentence_copies", "document_weights", "sentence_weights")


@dataclass(frozen=True)
class Index:
    documents: DataFrame
    sentences: DataFrame
    vocabulary: DataFrame
    document_copies: DataFrame
    sentence_copies: DataFrame
    document_weights: DataFrame
    sentence_weights: DataFrame
    # Of a saved index: what is stored, by kind of key; None where no filters were saved.
    stored: Mapping[str, StoredKeys] | None = None

    @property
    def spark(self) -> SparkSession:
        return self.documents.sparkSession

    def tables(self) -> Mapping[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}


def document_key() -> Column:
    return F.struct("batch", "doc_id")


def sentence_key() -> Column:
    return F.struct("batch", "doc_id", "sent_idx")


def distinct_texts(df: DataFrame, key: Column, text: str) -> DataFrame:
    """text, bid (first key holding it), copies. Copies merge before the shuffle."""
    return df.groupBy(F.col(text).alias("text")).agg(F.min(key).alias("bid"), F.count(F.lit(1)).alias("copies"))


def copies_of(df: DataFrame, key: Column, text: str, stored: DataFrame | None = None) -> DataFrame:
    """h, bid, member of every row; only hashes and keys move. Texts in ``stored`` keep their first place."""
    places = df.select(F.md5(text).alias("h"), key.alias("member"))
    firsts = places.groupBy("h").agg(F.min("member").alias("bid"))
    if stored is not None:
        known = stored.filter(F.col("bid") == F.col("member")).select("h", F.col("bid").alias("known"))
        firsts = firsts.join(known, "h", "left").select("h", F.coalesce("known", "bid").alias("bid"))
    return places.join(firsts, "h").select("h", "bid", "member")


def first_texts(df: DataFrame, key: Column, text: str, copies: DataFrame) -> DataFrame:
    """bid, copies, text of the rows of ``df`` that are a text's first place."""
    counted = copies.groupBy("bid").agg(F.count(F.lit(1)).alias("copies"))
    return df.select(key.alias("bid"), F.col(text).alias("text")).join(counted, "bid")


def fit_weights(
    texts: DataFrame, parts: int, long: bool, rows: int, n: int, hot_documents: int | None, hot_rows: int, counted: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Vocabulary over documents and sentences together, and the weights of both: (sent, bid, term, w, hot, hot_norm).

    ``texts(part, sent, bid, copies, text)`` holds every distinct text with its
    ``copies``, documents and (``sent``) sentences, and lies by ``part``. A
    term in over ``hot_documents`` (``hot_rows``) distinct texts is hot among
    documents (sentences); without ``hot_documents`` one flag holds for both.
    ``counted`` replaces ``copies`` in the frequencies.
    """
    post = postings(texts, ["part", "sent", "bid", "copies"], n=n)
    sums = {
        "df": F.col("copies") if counted is None else counted,
        "doc_rows": (~F.col("sent")).cast("int"),
        "sent_rows": F.col("sent").cast("int"),
    }
    by_part = counts_by_part(post, sums).filter(F.col("df") > 0)
    sent_hot = F.col("sent_rows") > hot_rows
    doc_hot = sent_hot if hot_documents is None else F.col("doc_rows") > hot_documents
    flags = [doc_hot.alias("doc_hot"), sent_hot.alias("sent_hot")]
    by_part = materialize(by_part.select("part", "term", "df", *flags, "first"), "partterms")
    idf = smoothed_idf(rows)
    vocabulary = materialize(by_part.filter("first").select("term", "df", idf.alias("idf"), "doc_hot", "sent_hot"), "vocabulary")
    known = attach_by_part(post, by_part.drop("first"), parts, long)
    hot = F.when(F.col("sent"), F.col("sent_hot")).otherwise(F.col("doc_hot"))
    raw = known.select("part", "sent", "bid", "term", (F.col("tf") * idf).alias("raw"), hot.alias("hot"))
    row = Window.partitionBy("sent", "bid", "part")
    square = F.col("raw") * F.col("raw")
    norm = F.sqrt(F.sum(square).over(row))
    hot_norm = F.sqrt(F.sum(F.when(F.col("hot"), square).otherwise(0.0)).over(row)) / norm
    raw = raw.select("sent", "bid", "term", "raw", "hot", norm.alias("norm"), hot_norm.alias("hot_norm"))
    # Products of counts and idf repeat and are small on disk, unit weights are not.
    stored = materialize(raw, "weights", ["sent"])
    discard(by_part)
    return vocabulary, stored.select("sent", "bid", "term", (F.col("raw") / F.col("norm")).alias("w"), "hot", "hot_norm")


def weigh(post: DataFrame, vocabulary: DataFrame, hot: str) -> DataFrame:
    """bid, term, w, hot, hot_norm under a frozen vocabulary; ``hot`` names its flag."""
    if fits_broadcast(post, VOCAB_ROW_BYTES):
        # Few postings, as of queries, go to the vocabulary, which stays where it lies.
        known = vocabulary.select("term", "idf", hot).join(F.broadcast(post), "term")
    else:
        known = attach_vocabulary(post, vocabulary, ["bid"], ["idf", hot])
    return normalized_weights(known, ["bid"], F.col(hot))


def build_index(corpus: DataFrame, hot_documents: int = HOT_DOCUMENTS, hot_rows: int = HOT_ROWS) -> Index:
    """Index of ``corpus(doc_id, text)``."""
    documents = materialize(corpus.select(F.lit(0).alias("batch"), "doc_id", "text"), "documents")
    sentences = materialize(with_sentences(documents, ["batch", "doc_id"]), "sentences")
    doc_copies = materialize(copies_of(documents, document_key(), "text"), "doccopies")
    sent_copies = materialize(copies_of(sentences, sentence_key(), "sentence"), "sentcopies")
    parts, long = parts_for(documents)
    texts = _dealt_texts(documents, doc_copies, sent_copies, parts)
    rows = documents.count() + sentences.count()
    vocabulary, weights = fit_weights(texts, parts, long, rows, NGRAMS, hot_documents, hot_rows)
    columns = ["bid", "term", "w", "hot", "hot_norm"]
    doc_bid = F.struct("bid.batch", "bid.doc_id").alias("bid")
    return Index(
        documents,
        sentences,
        vocabulary,
        doc_copies,
        sent_copies,
        weights.filter("NOT sent").select(doc_bid, *columns[1:]),
        weights.filter("sent").select(*columns),
    )


def _dealt_texts(documents: DataFrame, doc_copies: DataFrame, sent_copies: DataFrame, parts: int) -> DataFrame:
    """part, sent, bid, copies, text of every distinct document and sentence, dealt by the document of its first place.

    Only whole documents are moved; their sentences are split off where they arrive.
    """
    part = part_of(parts, "doc_id").alias("part")
    dealt = documents.select(part, "batch", "doc_id", "text").repartitionById(parts, F.col("part"))
    place = F.posexplode(F.concat(F.array("text"), F.coalesce(T.sentences(F.col("text")), F.array().cast("array<string>")))).alias("place", "text")
    texts = dealt.select("part", "batch", "doc_id", place)
    sent = F.col("place") > 0
    texts = texts.select("part", sent.alias("sent"), F.struct("batch", "doc_id", F.when(sent, F.col("place") - 1).alias("sent_idx")).alias("bid"), "text")

    def counted(copies: DataFrame, is_sent: bool, sent_idx: Column) -> DataFrame:
        counts = copies.groupBy("bid").agg(F.count(F.lit(1)).alias("copies"))
        return counts.select(F.lit(is_sent).alias("sent"), F.struct("bid.batch", "bid.doc_id", sent_idx.alias("sent_idx")).alias("bid"), "copies")

    firsts = counted(doc_copies, False, F.lit(None).cast("int")).unionByName(counted(sent_copies, True, F.col("bid.sent_idx")))
    firsts = firsts.select(part_of(parts, "bid.doc_id").alias("part"), "*").repartitionById(parts, F.col("part"))
    return texts.join(firsts, ["part", "sent", "bid"])


def new_documents(index: Index, corpus: DataFrame) -> DataFrame:
    """Rows of ``corpus`` whose doc_id is not indexed yet (changed text under a known id stays out)."""
    known = _stored_rows(index, "documents", corpus)
    return corpus if known is None else corpus.join(known.select("doc_id"), "doc_id", "left_anti")


def _stored_rows(index: Index, table: str, keys: DataFrame) -> DataFrame | None:
    """Rows of an index table that matter to ``keys``: those its filters let through, or all; None if there are none."""
    return getattr(index, table) if index.stored is None else index.stored[table].known(keys)


def overlay(corpus: DataFrame, extra: DataFrame) -> DataFrame:
    """``corpus`` with the rows of ``extra`` added; ``extra`` wins by doc_id."""
    return corpus.join(extra.select("doc_id"), "doc_id", "left_anti").unionByName(extra)


def _append(index: Index, arrived: DataFrame, batch: int) -> dict[str, DataFrame]:
    # Of several texts under one id the smallest one counts.
    single = arrived.groupBy("doc_id").agg(F.min("text").alias("text"))
    fresh = new_documents(index, single)
    documents = materialize(fresh.select(F.lit(batch).alias("batch"), "doc_id", "text"), "documents")
    sentences = materialize(with_sentences(documents, ["batch", "doc_id"]), "sentences")
    # A text that is indexed already keeps its vector and only gains a copy.
    known_docs = _stored_rows(index, "document_copies", documents.select(F.md5("text").alias("h")))
    known_sents = _stored_rows(index, "sentence_copies", sentences.select(F.md5("sentence").alias("h")))
    doc_copies = materialize(copies_of(documents, document_key(), "text", known_docs), "doccopies")
    sent_copies = materialize(copies_of(sentences, sentence_key(), "sentence", known_sents), "sentcopies")
    docs = first_texts(documents, document_key(), "text", doc_copies)
    sents = first_texts(sentences, sentence_key(), "sentence", sent_copies)
    return {
        "documents": documents,
        "sentences": sentences,
        "document_copies": doc_copies,
        "sentence_copies": sent_copies,
        "document_weights": weigh(postings(docs, ["bid"], n=NGRAMS), index.vocabulary, "doc_hot"),
        "sentence_weights": weigh(postings(sents, ["bid"], n=NGRAMS), index.vocabulary, "sent_hot"),
    }


def add_documents(index: Index, arrived: DataFrame) -> Index:
    """Index with the new documents of ``arrived`` added; the vocabulary stays frozen."""
    last = index.documents.agg(F.max("batch")).first()[0]
    parts = {name: materialize(df, name) for name, df in _append(index, arrived, 0 if last is None else last + 1).items()}
    return Index(
        vocabulary=index.vocabulary, **{name: getattr(index, name).unionByName(df) for name, df in parts.items()}
    )


def out_of_vocabulary(index: Index, corpus: DataFrame) -> DataFrame:
    """doc_id, oov_ratio: share of distinct terms the frozen vocabulary lacks."""
    post = postings(corpus, ["doc_id"], n=NGRAMS)
    found = post.join(index.vocabulary.select("term", F.lit(1).alias("known")), "term", "left")
    known = F.coalesce(F.sum("known"), F.lit(0))
    return found.groupBy("doc_id").agg((F.lit(1.0) - known / F.count(F.lit(1))).alias("oov_ratio"))


MANIFEST = (
    "version long, folder string, last_batch long, published double, "
    "filters array<struct<name: string, batch: int, blocks: long>>"
)
# Key of the tables that appends look things up in, and what a compacted table is sorted by.
KEYS = {"documents": "doc_id", "document_copies": "h", "sentence_copies": "h"}
CLUSTERED = {
    "documents": ("batch", "doc_id"),
    "sentences": ("batch", "doc_id", "sent_idx"),
    "vocabulary": ("term",),
    "document_copies": ("h", "member"),
    "sentence_copies": ("h", "member"),
    "document_weights": ("term", "bid"),
    "sentence_weights": ("term", "bid"),
}


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    # A row that is removed while the folder is being read is not the newest one.
    return spark.read.schema(MANIFEST).option("ignoreMissingFiles", "true").parquet(f"{path}/manifest")


def _state(spark: SparkSession, path: str):
    """Newest manifest row of a saved index, None when there is none."""
    if not _exists(spark, f"{path}/manifest"):
        return None
    return _manifest(spark, path).orderBy(F.desc("version")).first()


def _publish(spark: SparkSession, path: str, version: int, folder: str, last_batch: int, filters: list | None) -> None:
    """Make ``folder`` up to ``last_batch`` the index that readers see; one small file, added at once."""
    row = spark.createDataFrame([(version, folder, last_batch, time.time(), filters)], MANIFEST).coalesce(1)
    row.write.mode("append").parquet(f"{path}/manifest")


def _write_batch(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame], batch: int) -> list:
    """One folder per table below ``folder``, with the filters of its keys; (name, batch, blocks) of these."""
    filters = []
    for name, df in tables.items():
        if name == "vocabulary":
            df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
            continue
        # The folder's number is the batch of writing; a document keeps the batch in which it was added.
        target = f"{folder}/{name}/batch={batch}"
        df.withColumnRenamed("batch", "added").write.mode("overwrite").option("compression", "zstd").parquet(target)
        if name in KEYS:
            written = spark.read.parquet(target)
            keys = written if name == "documents" else written.filter(F.col("bid") == F.col("member"))
            blocks = blocks_for(keys.count())
            build_filter(keys, KEYS[name], blocks).write.mode("overwrite").parquet(f"{folder}/filter_{name}/batch={batch}")
            filters.append((name, batch, blocks))
    return filters


def _save(tables: Mapping[str, DataFrame], spark: SparkSession, path: str, last_batch: int) -> None:
    before = _state(spark, path)
    version = before.version + 1 if before else 0
    folder = f"v{version}-{uuid.uuid4().hex[:8]}"
    filters = _write_batch(spark, f"{path}/{folder}", tables, last_batch)
    _publish(spark, path, version, folder, last_batch, filters)


def save_index(index: Index, path: str) -> None:
    """Write the index to a fresh folder below ``path``, then switch readers to it.

    An index saved to the same path before stays readable, also after the
    switch, until ``remove_superseded`` deletes it.
    """
    last = index.documents.agg(F.max("batch")).first()[0]
    _save(index.tables(), index.spark, path, last or 0)


def load_index(spark: SparkSession, path: str) -> Index:
    """Saved index. Batches that the manifest does not have yet are left-overs
    of an unfinished append and stay out."""
    state = _state(spark, path)
    if state is None:
        raise FileNotFoundError(f"no saved index at {path}")
    done = F.col("batch") <= state.last_batch
    raw = {name: spark.read.parquet(f"{path}/{state.folder}/{name}") for name in TABLES}
    raw = {name: df if name == "vocabulary" else df.filter(done) for name, df in raw.items()}
    tables = {name: df.drop("batch") for name, df in raw.items()}
    for name in ("documents", "sentences"):
        # Folders of before the compaction have no column of their own for it.
        added = F.coalesce("added", "batch") if "added" in raw[name].columns else F.col("batch")
        rest = [c for c in raw[name].columns if c not in ("added", "batch")]
        tables[name] = raw[name].select(added.alias("batch"), *rest)
    stored = None
    if state.filters is not None:
        stored = {
            name: StoredKeys(
                raw[name],
                key,
                spark.read.parquet(f"{path}/{state.folder}/filter_{name}"),
                {f["batch"]: f["blocks"] for f in state.filters if f["name"] == name},
            )
            for name, key in KEYS.items()
        }
    return Index(**tables, stored=stored)


def append_to_saved(spark: SparkSession, path: str, arrived: DataFrame, compact_after: int | None = None) -> None:
    """Append new documents to a saved index, safe to repeat after a failure:
    a retry takes the same batch number and overwrites its folders.

    With ``compact_after``, an index of more than so many batches is compacted.
    """
    state = _state(spark, path)
    index = load_index(spark, path)
    batch = state.last_batch + 1
    parts = {name: materialize(df, name) for name, df in _append(index, arrived, batch).items()}
    if parts["documents"].isEmpty():
        return
    filters = _write_batch(spark, f"{path}/{state.folder}", parts, batch)
    filters = None if state.filters is None else [tuple(f) for f in state.filters] + filters
    _publish(spark, path, state.version + 1, state.folder, batch, filters)
    if compact_after is not None and filters is not None and len(filters) > compact_after * len(KEYS):
        compact_saved(spark, path)


def compact_saved(spark: SparkSession, path: str) -> None:
    """Merge all batches of a saved index into one, in a fresh folder that readers are then switched to.

    Every table is range-partitioned and sorted by what it is searched by. Row
    counts decide the number of files (adaptive partition sizes), not the number
    of appends. Content and corpus order stay.
    """
    state = _state(spark, path)
    tables = {
        name: df.repartitionByRange(*CLUSTERED[name]).sortWithinPartitions(*CLUSTERED[name])
        for name, df in load_index(spark, path).tables().items()
    }
    _save(tables, spark, path, state.last_batch)


def remove_superseded(spark: SparkSession, path: str, grace_seconds: float) -> list[str]:
    """Delete folders and manifest rows that were superseded over ``grace_seconds`` ago; the folders' names.

    ``grace_seconds`` must exceed the longest time that a reader works with a
    loaded index. The newest row and its folder always stay, and so does what
    an unfinished save left, as it cannot be told from one at work.
    """
    rows = _manifest(spark, path).select("version", "folder", "published", F.col("_metadata.file_path").alias("file"))
    rows = rows.orderBy("version").collect()  # one row per append since the last removal
    newest, now = rows[-1], time.time()
    due = [r for r, later in zip(rows, rows[1:]) if later.published is not None and now - later.published >= grace_seconds]
    kept = {r.folder for r in rows if r not in due} | {newest.folder}
    folders = sorted({r.folder for r in due} - kept)
    for folder in folders:
        _delete(spark, f"{path}/{folder}")
    for row in due:
        _delete(spark, row.file)
    return folders


def index_health(index: Index, detector: str = "heuristic") -> DataFrame:
    """One row: document count, sentence count, detector in force."""
    d = index.documents.agg(F.count(F.lit(1)).alias("documents"))
    s = index.sentences.agg(F.count(F.lit(1)).alias("sentences"))
    return (
        d.withColumn("one", F.lit(1))
        .join(s.withColumn("one", F.lit(1)), "one")
        .select("documents", "sentences", F.lit(detector).alias("detector"))
    )
