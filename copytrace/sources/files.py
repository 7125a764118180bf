"""Documents from files: scan a folder, extract plain text per file."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Mapping
from urllib.parse import quote
from xml.etree import ElementTree

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the namespace of word-processing XML.
WORD_XML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

Extractor = Callable[[bytes], str]


def text_from_txt(data: bytes) -> str:
    return data.decode("utf-8", errors="replace")


def text_from_docx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD_XML}body")
    paragraphs = [] if body is None else body.findall(f"{WORD_XML}p")
    return "\n".join("".join(t.text or "" for t in p.iter(f"{WORD_XML}t")) for p in paragraphs)


EXTRACTORS: Mapping[str, Extractor] = {".txt": text_from_txt, ".docx": text_from_docx}


# Files of the accepted suffixes in any case; the filter runs before a file is opened.
ACCEPTED = "*.{[tT][xX][tT],[pP][dD][fF],[dD][oO][cC][xX]}"
PLAIN = "*.[tT][xX][tT]"
# Fixed value: the longest value a Spark column can hold.
LONGEST = (1 << 31) - 1
# A plain text of more bytes is read in blocks of this size, each a row.
BLOCK_BYTES = 64 << 20
# A block ends at the first line break within this many bytes after its nominal end, else at a blank.
REACH = 1 << 20
# Most lines end within so many bytes, which are read first.
NEAR = 4096


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def scan_folder(spark: SparkSession, folder: str, pattern: str = "*", max_bytes: int = LONGEST) -> DataFrame:
    """path, content of the files directly in ``folder``; none when it is missing.

    A file of over ``max_bytes`` is not read: its content is null. The default
    is the longest value Spark can hold; ``load_blocks`` has no such bound.
    """
    if not _exists(spark, folder):
        return spark.createDataFrame([], "path string, content binary")
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    read = found.filter(F.col("length") <= max_bytes).select("path", "content")
    return read.union(found.filter(F.col("length") > max_bytes).select("path", F.lit(None).cast("binary")))


def cut_after(head: bytes, whole: bool) -> int:
    """Bytes that ``head``, what follows a nominal cut and the byte before it, gives to the block before.

    The cut moves behind the first line break, else behind the first blank,
    else to the end if the file ends here (``whole``), else to the next
    character: a character has at most three bytes after its first.
    """
    for mark in (b"\n", b" "):
        at = head.find(mark)
        if at >= 0:
            return at
    if whole:
        return len(head) - 1
    move = 0
    while move < 3 and head[1 + move : 2 + move] and head[1 + move] & 0xC0 == 0x80:
        move += 1
    return move


def _open(path: str):
    """A readable file of any file system that Arrow knows, by the address Spark lists it under."""
    local = path.removeprefix("file://").removeprefix("file:")
    where = local if "://" not in local else quote(path.replace("s3a://", "s3://", 1), safe=":/@")
    system, name = FileSystem.from_uri(where)
    return system.open_input_file(name)


def read_block(source, start: int, stop: int, length: int, reach: int = REACH) -> bytes:
    """The bytes of ``source`` between the cuts at ``start`` and ``stop``; all blocks together are the file."""
    reach = max(reach, 3)  # what may follow a character's first byte

    def cut(at: int) -> int:
        if at <= 0 or at >= length:
            return min(max(at, 0), length)
        head = source.read_at(min(NEAR, reach) + 1, at - 1)
        if b"\n" not in head:
            head = source.read_at(reach + 1, at - 1)
        return min(at + cut_after(head, at + reach >= length), length)

    first, last = cut(start), cut(stop)
    return source.read_at(last - first, first) if last > first else b""


def load_blocks(
    spark: SparkSession, folder: str, block_bytes: int = BLOCK_BYTES, reach: int = REACH, least: int = 0
) -> DataFrame:
    """doc_id (file name), block, text of the plain text files of ``least`` bytes or more directly in ``folder``.

    A file of over ``block_bytes`` becomes one row per block, so its blocks are
    read by many tasks and none holds more than a block and what reaches over
    its end. Blocks end behind a line break, where there is one near; joined in
    order they are the whole text. An empty file is one empty block 0; a block
    that a long line has swallowed whole has no row.
    """
    if not _exists(spark, folder):
        return spark.createDataFrame([], "doc_id string, block long, text string")
    if block_bytes < 4:
        raise ValueError("a block must hold any character")
    # Without its content column this lists files only.
    found = spark.read.format("binaryFile").option("pathGlobFilter", PLAIN).load(folder).select("path", "length")
    found = found.filter(F.col("length") >= least)
    last = F.greatest(F.ceil(F.col("length") / block_bytes) - 1, F.lit(0)).cast("long")
    blocks = found.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    blocks = blocks.repartition("path", "block")  # rows without content: blocks are dealt before they are read

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, length, block in zip(pdf["path"], pdf["length"], pdf["block"]):
                with _open(path) as source:
                    data = read_block(source, block * block_bytes, (block + 1) * block_bytes, length, reach)
                if data or not length:
                    name = path.rsplit("/", 1)[-1]
                    yield pd.DataFrame({"doc_id": [name], "block": [block], "text": [text_from_txt(data)]})

    return blocks.mapInPandas(read, "doc_id string, block long, text string")


def extract_text(files: DataFrame, extractors: Mapping[str, Extractor] = EXTRACTORS) -> DataFrame:
    """doc_id (file name), text, reason per file.

    ``reason`` is null for good files, else ``unsupported``, ``unreadable`` or ``too large`` (null content).
    PDF needs a caller's extractor, passed as ``{**EXTRACTORS, ".pdf": fn}``.
    """
    named = files.withColumn("doc_id", F.element_at(F.split("path", "/"), -1))
    suffix = F.lower(F.regexp_extract("doc_id", r"(\.[^.]*)$", 1))
    known = dict(extractors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, reasons = [], []
            for suffix, data in zip(pdf["suffix"], pdf["content"]):
                text, reason = None, "unsupported"
                if suffix in known and data is None:
                    reason = "too large"
                elif suffix in known:
                    try:
                        text, reason = known[suffix](bytes(data)), None
                    except Exception:  # a broken file must not fail the job
                        reason = "unreadable"
                texts.append(text)
                reasons.append(reason)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts, "reason": reasons})

    return named.select("doc_id", suffix.alias("suffix"), "content").mapInPandas(
        run, "doc_id string, text string, reason string"
    )


def load_corpus(
    spark: SparkSession, folder: str, extractors: Mapping[str, Extractor] = EXTRACTORS, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, text of all supported, readable files of a folder (order = doc_id).

    A plain text of over ``block_bytes`` is a document per block: ``name#00000``, ``name#00001`` and so on.
    """
    plain = extractors.get(".txt") is text_from_txt
    if not plain or not _exists(spark, folder):
        return accepted(extract_text(scan_folder(spark, folder, ACCEPTED), extractors))
    sizes = spark.read.format("binaryFile").option("pathGlobFilter", ACCEPTED).load(folder)
    text = F.lower("path").endswith(".txt")
    small = sizes.filter(F.col("length") <= F.when(text, block_bytes).otherwise(LONGEST)).select("path", "content")
    number = F.format_string("%s#%05d", "doc_id", "block")
    large = load_blocks(spark, folder, block_bytes, least=block_bytes + 1).select(number.alias("doc_id"), "text")
    return accepted(extract_text(small, extractors)).union(large)


def accepted(extracted: DataFrame) -> DataFrame:
    return extracted.filter(F.col("reason").isNull()).select("doc_id", "text")


def rejected(extracted: DataFrame) -> DataFrame:
    return extracted.filter(F.col("reason").isNotNull()).select("doc_id", "reason")


def strict(extracted: DataFrame) -> DataFrame:
    """Fail the job on the first rejected file."""
    message = F.concat(F.lit("cannot read "), F.col("doc_id"), F.lit(": "), F.col("reason"))
    text = F.when(F.col("reason").isNull(), F.col("text")).otherwise(F.raise_error(message))
    return extracted.select("doc_id", text.alias("text"))


# Accepted length of a request text, in characters.
MIN_CHARS, MAX_CHARS = 1, 50_000


def valid_texts(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(F.char_length(F.col(text)).between(MIN_CHARS, MAX_CHARS))
