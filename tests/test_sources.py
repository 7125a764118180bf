import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from copytrace.operators.index import build_index, index_health, load_index, save_index
from copytrace.operators.reuse import reuse_report_from_files
from copytrace.session import new_path
from copytrace.sources import files, labelled
from copytrace.streaming import jobs


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    return buf.getvalue()


def test_folder(spark, tmp_path):
    (tmp_path / "b.TXT").write_bytes("café \xff".encode("latin-1"))
    (tmp_path / "a.docx").write_bytes(docx("First part", "Second part"))
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    (tmp_path / "d.png").write_bytes(b"x")
    (tmp_path / "e.pdf").write_bytes(b"pdf words")
    rows = {r["doc_id"]: r["text"] for r in files.load_corpus(spark, str(tmp_path)).collect()}
    assert rows == {"a.docx": "First part\nSecond part", "b.TXT": "caf� �"}
    extracted = files.extract_text(files.scan_folder(spark, str(tmp_path)))
    bad = {r["doc_id"]: r["reason"] for r in files.rejected(extracted).collect()}
    assert bad == {"c.docx": "unreadable", "d.png": "unsupported", "e.pdf": "unsupported"}
    with pytest.raises(Exception, match="cannot read"):
        files.strict(extracted).collect()
    with_pdf = {**files.EXTRACTORS, ".pdf": files.text_from_txt}
    assert files.load_corpus(spark, str(tmp_path), with_pdf).count() == 3
    assert files.load_corpus(spark, str(tmp_path / "missing")).count() == 0
    limited = files.extract_text(files.scan_folder(spark, str(tmp_path), files.ACCEPTED, 6))
    assert {r["doc_id"]: r["reason"] for r in files.rejected(limited).collect()}["a.docx"] == "too large"
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        (tmp_path / "big.zip").write_bytes(b"0" * 2000)  # foreign files are not opened
        assert files.load_corpus(spark, str(tmp_path), with_pdf).count() == 3
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


TEXTS = ["", "one line", "a\nbb\n\nccc", "no break at all " * 40, "é€𝄞" * 200, "x" * 500, "long " * 30 + "\n" + "y" * 90 + "\nend\n"]


@pytest.mark.parametrize("block", [4, 7, 64, 1000])
def test_blocks_are_the_file(spark, tmp_path, block):
    for i, text in enumerate(TEXTS):
        (tmp_path / f"f {i}%41.txt").write_bytes(text.encode())
    (tmp_path / "skip.docx").write_bytes(b"x" * 100)
    rows = files.load_blocks(spark, str(tmp_path), block, 32).collect()
    for i, text in enumerate(TEXTS):
        parts = sorted((r["block"], r["text"]) for r in rows if r["doc_id"] == f"f {i}%41.txt")
        assert "".join(t for _, t in parts) == text
        assert len(parts) > 1 or len(text.encode()) <= max(block, 36)
        assert all(len(t.encode()) <= block + 33 for _, t in parts)
    assert files.load_blocks(spark, str(tmp_path / "missing")).count() == 0
    with pytest.raises(ValueError):
        files.load_blocks(spark, str(tmp_path), 3)


class Memory:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


@given(st.lists(st.sampled_from([b"a", b" ", b"\n", "é".encode(), "€".encode(), "𝄞".encode(), b"\x80", b"\xe2\x82", b"\xff", b"\xf0"]), max_size=60), st.integers(4, 20), st.integers(1, 20))
@settings(max_examples=400, deadline=None)
def test_any_bytes_in_blocks(pieces, block, reach):
    data = b"".join(pieces)
    parts = [files.read_block(Memory(data), at, at + block, len(data), reach) for at in range(0, max(len(data), 1), block)]
    assert b"".join(parts) == data
    # Invalid bytes are replaced as in the whole text.
    assert "".join(map(files.text_from_txt, parts)) == files.text_from_txt(data)


def test_large_files_of_a_corpus(spark, tmp_path):
    (tmp_path / "small.txt").write_text("Owls hunt.")
    (tmp_path / "large.TXT").write_text("Bread rises slowly.\n" * 10)
    (tmp_path / "a.docx").write_bytes(docx("First part " * 50))
    rows = {r["doc_id"]: r["text"] for r in files.load_corpus(spark, str(tmp_path), block_bytes=100).collect()}
    assert rows["small.txt"] == "Owls hunt." and rows["a.docx"].startswith("First part")
    assert {k for k in rows if "#" in k} == {"large.TXT#00000", "large.TXT#00001"} and len(rows) == 4
    assert rows["large.TXT#00000"] + rows["large.TXT#00001"] == "Bread rises slowly.\n" * 10


def test_report_from_files(spark, tmp_path):
    (tmp_path / "copy.txt").write_text("Owls hunt at night. Plain filler here.")
    (tmp_path / "other.docx").write_bytes(docx("Bread rises slowly."))
    (tmp_path / "skip.png").write_bytes(b"x")
    ix = build_index(spark.createDataFrame([("a.txt", "Owls hunt at night."), ("b.txt", "Bread rises slowly.")], "doc_id string, text string"))
    rows = {r["query_id"]: r for r in reuse_report_from_files(spark, str(tmp_path), ix, top_k=1).collect()}
    assert rows.keys() == {"copy.txt", "other.docx"}
    assert rows["copy.txt"]["matches"][0]["source"] == "a.txt" and rows["other.docx"]["score"] == 100.0
    assert [m["source"] for m in rows["copy.txt"]["sentence_matches"]] == ["a.txt", None]


def test_valid_texts(spark):
    df = spark.createDataFrame([("",), ("a",), ("b" * 50_000,), ("c" * 50_001,), (None,)], "text string")
    assert files.valid_texts(df).count() == 2


def test_labelled_csv(spark, tmp_path):
    def read(name, content, **kw):
        (tmp_path / name).write_text(content)
        return [tuple(r) for r in labelled.read_labelled_csv(spark, str(tmp_path / name), **kw).collect()]

    assert read("a.csv", 'text,label\n"one, two",human\n"say ""hi""",ai\n,ai\n') == [("one, two", "human"), ('say "hi"', "ai")]
    abstract = "title,abstract,label\nt,x,0\nt,y,1\nt,z,other\n"
    assert read("b.csv", abstract) == [("x", "human"), ("y", "ai"), ("z", "other")]
    assert read("c.csv", abstract, on_unknown="drop") == [("x", "human"), ("y", "ai")]
    assert read("d.csv", "text,generated\nx,0\ny,1.0\nz,7\n", on_unknown="drop") == [("x", "human"), ("y", "ai")]
    with pytest.raises(ValueError):
        read("e.csv", "a,b\n1,2\n")


def test_streams(spark, tmp_path):
    schema = "doc_id bigint, text string"
    rows = [(1, "Owls hunt at night."), (2, "Bread rises slowly.")]
    ix = build_index(spark.createDataFrame(rows, schema))
    path = new_path(spark, "ix")
    save_index(ix, path)
    inbox = str(tmp_path / "in")
    spark.createDataFrame([(2, "again"), (3, "Rain falls. It is wet.")], schema).coalesce(1).write.parquet(inbox)
    spark.createDataFrame([(3, "once more"), (4, "Snow.")], schema).coalesce(1).write.mode("append").parquet(inbox)
    jobs.index_stream(jobs.text_stream(spark, inbox, schema, 1), path, new_path(spark, "cp")).awaitTermination()
    assert index_health(load_index(spark, path)).first()["documents"] == 4

    out, cp = str(tmp_path / "out"), new_path(spark, "cp")
    for _ in range(2):  # a restart finds nothing new
        jobs.detect_stream(jobs.text_stream(spark, inbox, schema), out, cp).awaitTermination()
    assert spark.read.parquet(out).count() == 4

    asked = jobs.text_stream(spark, inbox, schema).withColumnRenamed("doc_id", "query_id")
    jobs.reuse_stream(asked, ix, str(tmp_path / "rep"), new_path(spark, "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "rep")).count() == 4
