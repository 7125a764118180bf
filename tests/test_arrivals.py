"""Filters of arriving keys, compaction and removal of saved indexes."""

import glob
import os

import pytest

from copytrace.operators import index as I
from copytrace.operators import reuse as R
from copytrace.operators.arrivals import StoredKeys, blocks_for, build_filter
from copytrace.session import new_path

FIRST = [(1, "Owls hunt at night. Mice hide."), (2, "Bread rises with yeast. Salt slows it.")]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.fixture
def saved(spark):
    path = new_path(spark, "ix")
    I.save_index(I.build_index(docs(spark, FIRST)), path)
    return path


def content(ix):
    return {name: sorted((repr(r) for r in df.select(sorted(df.columns)).collect())) for name, df in ix.tables().items()}


def test_filter_loses_no_key_and_lets_few_others_pass(spark):
    stored = spark.range(20_000).selectExpr("cast(id as string) as k", "cast(id % 3 as int) as batch")
    sizes = {b: blocks_for(7000) for b in range(3)}
    filters = None
    for b, n in sizes.items():
        part = build_filter(stored.filter(f"batch = {b}"), "k", n).selectExpr(f"{b} as batch", "*")
        filters = part if filters is None else filters.unionByName(part)
    kept = StoredKeys(stored, "k", filters, sizes)
    own = kept.may_hold(stored).join(stored, ["k", "batch"], "left_semi")
    assert own.count() == 20_000
    others = spark.range(100_000, 120_000).selectExpr("cast(id as string) as k")
    assert kept.may_hold(others).count() < 0.01 * 3 * 20_000
    assert kept.may_hold(spark.createDataFrame([(None,)], "k string")).count() == 0
    asked = spark.createDataFrame([("5",), ("7",), ("absent",)], "k string")
    assert {r.k for r in kept.known(asked).collect()} >= {"5", "7"}


def test_keys_of_another_integer_type_are_found(spark, saved):
    ix = I.load_index(spark, saved)
    arrived = spark.createDataFrame([(1, "x"), (9, "y")], "doc_id int, text string")
    assert [r.doc_id for r in I.new_documents(ix, arrived).collect()] == [9]


def test_fresh_arrivals_read_no_stored_table(spark, saved, monkeypatch):
    asked = []
    whole = I.copies_of
    monkeypatch.setattr(I, "copies_of", lambda df, key, text, stored=None: asked.append(stored) or whole(df, key, text, stored))
    I.append_to_saved(spark, saved, docs(spark, [(3, "Volcanoes release ash."), (4, None), (5, "")]))
    assert asked == [None, None]
    # A known sentence is looked up, in the batch that holds it only.
    I.append_to_saved(spark, saved, docs(spark, [(6, "Volcanoes release ash. Rain fell.")]))
    assert asked[2] is None and {r.member.doc_id for r in asked[3].collect()} == {3}
    scans = [x for x in asked[3]._jdf.queryExecution().toString().splitlines() if "FileScan" in x and "sentence_copies" in x]
    assert scans and all("batch#" in x and "= 1)" in x.split("PartitionFilters: ")[1].split("]")[0] for x in scans)
    ix = I.load_index(spark, saved)
    first = ix.sentence_copies.filter("member.doc_id = 6 and member.sent_idx = 0").first()
    assert first.bid.doc_id == 3 and first.bid.batch == 1


def test_appends_equal_appends_without_filters(spark, saved):
    rows = [(2, "other"), (3, FIRST[0][1]), (None, "Mice hide."), (4, "Salt slows it. New here."), (4, "A smaller text.")]
    plain = I.add_documents(I.build_index(docs(spark, FIRST)), docs(spark, rows))
    I.append_to_saved(spark, saved, docs(spark, rows))
    assert content(I.load_index(spark, saved)) == content(plain)


def test_compaction_keeps_content_order_and_readers(spark, saved):
    for i in range(3, 5):
        I.append_to_saved(spark, saved, docs(spark, [(i, f"Text {i} is new. Owls hunt at night.")]))
    reader = I.load_index(spark, saved)
    before = content(reader)
    I.compact_saved(spark, saved)
    merged = I.load_index(spark, saved)
    assert content(merged) == before
    folder = I._state(spark, saved).folder
    for name in I.TABLES:
        assert len(glob.glob(f"{saved}/{folder}/{name}/batch=*")) == (name != "vocabulary")
    # A reader of the old folder goes on until the grace period is over.
    assert I.remove_superseded(spark, saved, 3600) == []
    assert content(reader) == before
    assert len(I.remove_superseded(spark, saved, 0)) == 1
    assert len(glob.glob(f"{saved}/v*")) == 1 and len(glob.glob(f"{saved}/manifest/*.parquet")) == 1
    assert content(I.load_index(spark, saved)) == before
    # Appends go on, and known ids and texts are still told.
    I.append_to_saved(spark, saved, docs(spark, [(3, "known"), (20, FIRST[1][1])]))
    grown = I.load_index(spark, saved)
    assert grown.documents.count() == 5
    assert grown.document_copies.filter("member.doc_id = 20").first().bid.doc_id == 2
    found = R.rank_documents(docs(spark, [(0, FIRST[1][1])]).selectExpr("doc_id as query_id", "text"), grown, 2)
    assert [r.source for r in found.orderBy("rank").collect()] == [2, 20]


def test_many_appends_leave_a_bounded_number_of_folders(spark, saved):
    for i in range(3, 7):
        I.append_to_saved(spark, saved, docs(spark, [(i, f"Text {i}.")]), compact_after=2)
        I.remove_superseded(spark, saved, 0)
        assert len(glob.glob(f"{saved}/v*")) == 1
        assert len(glob.glob(f"{saved}/v*/documents/batch=*")) <= 2
    assert I.load_index(spark, saved).documents.count() == 6


def test_unfinished_saves_are_left_alone(spark, saved):
    os.makedirs(f"{saved}/v9-unfinished")
    I.compact_saved(spark, saved)
    assert len(I.remove_superseded(spark, saved, 0)) == 1
    assert os.path.isdir(f"{saved}/v9-unfinished")


def test_an_empty_index_takes_appends(spark):
    path = new_path(spark, "ix")
    I.save_index(I.build_index(docs(spark, [])), path)
    I.append_to_saved(spark, path, docs(spark, [(1, "One.")]))
    I.compact_saved(spark, path)
    assert [r.doc_id for r in I.load_index(spark, path).documents.collect()] == [1]
