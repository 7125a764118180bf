"""Prefix trie of conversations by fixed-length block hashing.

A node is a distinct sequence of first turns (role, text). Turns are told apart
by 128 bits of hash; a prefix by the exclusive or of its turns' hashes, each
mixed with its position, so a prefix's hash comes from a window sum, and a very
long conversation's from slices whose totals are carried on.

Equal conversations become one with a count first. Conversations are then
grouped by the hash at the end of each block of ``BLOCK`` turns. Where all
members of a block's node go on with the same block, the nodes inside have the
same members and need no grouping: they are listed from one conversation. Turn
boundaries are grouped only in blocks where siblings diverge (or some end).

What a node sums up over its subtree are sums over its member conversations.
Every node is owned by its smallest member; a conversation owns the nodes from
some depth on, the words before that depth are its shared words. A subtree's
saved words are the shared words of the members but the owner's, less the words
before the node once for each of them; its leaves are the members that own a
childless last node.

The ids that end at a node are hashed in ascending order: pieces of up to
``IDS`` ids are joined where a range-partitioned sort put them, and only those
pieces meet by node, as a stream, so a node at which a third of all
conversations end takes bounded memory.

Defined cases: turns are ordered by turn, null first, ties by role and by the
MD5 of the text; a null role or text is empty; equal turns each count; turns
without a conversation id belong to no conversation; a conversation may have no
turns and then belongs to the root alone; no conversations, no nodes; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from copytrace.llm.common import WORD, prepare, rank_by, spread, text_of, word_count
from copytrace.session import materialize
from copytrace.sources.tables import read_table

BLOCK = 4
# Turns of a conversation that one window adds up; a multiple of BLOCK.
SLICE = 8192
IDS = 4096
# The query's rebuilding: conversations in groups of GROUP share up to SHARED - 1 first turns.
GROUP, SHARED = 20, 4
KEY = ["depth", "a", "b"]
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def number_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, p, a, b, w), turns by their position from 1, hash and words; and (conv, m), turns of each conversation."""
    role, text = text_of("role"), text_of("text")
    source = spread(turns.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text"))
    slim = source.select(
        F.col("conv_id").alias("conv"),
        "turn",
        role.alias("role"),
        F.md5(text).alias("tie"),
        F.xxhash64(F.lit("a"), role, text).alias("a"),
        F.xxhash64(F.lit("b"), text, role).alias("b"),
        word_count(text).alias("w"),
    )
    ranked = rank_by(slim, F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("tie"), name="turn-order")
    firsts = ranked.groupBy("conv").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("m"))
    firsts = materialize(firsts, "conversations")
    placed = ranked.join(firsts, "conv").select("conv", (F.col("rank") - F.col("first") + 1).alias("p"), "a", "b", "w")
    return materialize(placed, "turns"), firsts.select("conv", "m")


def rebuild(turns: DataFrame, convs: DataFrame, group: int = GROUP, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of their group's first one; h is the id's CRC-32 modulo ``shared``."""
    h = F.crc32(F.col("conv").cast("string")) % shared
    own = convs.select("conv", "m", h.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base"))
    lead = convs.select(F.col("conv").alias("base"), F.col("m").alias("lead"))
    new = own.join(lead, "base", "left").withColumn("k", F.least("h", F.coalesce("lead", F.lit(0))))
    new = materialize(new, "rebuilt")
    rest = turns.join(new.select("conv", "h", "k"), "conv").where(F.col("p") > F.col("h"))
    rest = rest.select("conv", (F.col("p") - F.col("h") + F.col("k")).alias("p"), "a", "b", "w")
    # At most shared - 1 turns of a base, and at most group conversations that take them.
    heads = turns.where((F.col("conv") % group == 0) & (F.col("p") < shared)).withColumnRenamed("conv", "base")
    given = heads.join(new.select("conv", "base", "h"), "base").where(F.col("p") <= F.col("h")).select("conv", "p", "a", "b", "w")
    length = F.col("k") + F.greatest(F.col("m") - F.col("h"), F.lit(0))
    return materialize(rest.union(given), "rebuilt-turns"), new.select("conv", length.alias("m"))


def _paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, m, part, p, a, b, a0, b0, w0, w): per turn the prefix hash with it and before it, and the words before it."""
    mix_a, mix_b = F.xxhash64("p", "a", "b"), F.xxhash64("b", "p", "a")
    part = F.floor((F.col("p") - 1) / SLICE).alias("part")
    mixed = turns.join(convs, "conv").select("conv", "m", part, "p", mix_a.alias("x"), mix_b.alias("y"), "w")
    inside = Window.partitionBy("conv", "part").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = mixed.select(
        "*", F.bit_xor("x").over(inside).alias("a"), F.bit_xor("y").over(inside).alias("b"), F.sum("w").over(inside).alias("words")
    )
    # Only conversations of several slices have anything to carry on.
    totals = mixed.where(F.col("m") > SLICE).groupBy("conv", "part").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("w").alias("w"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv", "part", *[f(c).over(before).alias(n) for f, c, n in ((F.bit_xor, "x", "ca"), (F.bit_xor, "y", "cb"), (F.sum, "w", "cw"))])
    carried = materialize(carried, "carried")
    zero = F.lit(0).cast("long")
    found = found.join(carried, ["conv", "part"], "left")
    a = F.col("a").bitwiseXOR(F.coalesce("ca", zero))
    b = F.col("b").bitwiseXOR(F.coalesce("cb", zero))
    return found.select(
        "conv", "m", "part", "p", a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("x")).alias("a0"), b.bitwiseXOR(F.col("y")).alias("b0"),
        (F.col("words") - F.col("w") + F.coalesce("cw", zero)).alias("w0"), "w",
    )


def _blocks(paths: DataFrame) -> DataFrame:
    """(conv, m, turns, depth, a, b, depth0, a0, b0): per block its turns in order, the key at its end and before it."""
    turn = F.struct("p", "a", "b", "a0", "b0", "w0", "w")
    block = F.floor((F.col("p") - 1) / BLOCK).alias("block")
    found = paths.groupBy("conv", "m", "part", block).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return _with_keys(found.select("conv", "m", "turns"))


def _with_keys(segments: DataFrame) -> DataFrame:
    first, last = F.element_at("turns", 1), F.element_at("turns", -1)
    return segments.select(
        "*", last["p"].alias("depth"), last["a"].alias("a"), last["b"].alias("b"),
        (first["p"] - 1).alias("depth0"), first["a0"].alias("a0"), first["b0"].alias("b0"),
    )


def _root() -> list[Column]:
    return [F.lit(0).cast("long").alias(c) for c in KEY]


def _ends(finals: DataFrame) -> DataFrame:
    """(depth, a, b, ends): per last node the SHA-256 of the ids that end there, ascending and joined by commas."""
    order = [*KEY, "conv"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            out = []
            for key, group in groupby(rows, lambda r: r[:3]):
                ids = [r[3] for r in group]
                out += [(*key, ids[i], ",".join(map(str, ids[i : i + IDS]))) for i in range(0, len(ids), IDS)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [*order, "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for *found, ids in zip(*(c.to_pylist() for c in batch.select([*KEY, "ids"]).columns)):
                if found == key:
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    done.append((*key, state.hexdigest()))
                key, state = found, hashlib.sha256(ids.encode())
            if done:
                yield _key_rows(done)
        if state:
            yield _key_rows([(*key, state.hexdigest())])

    keys = "depth long, a long, b long"
    pieces = finals.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = materialize(pieces.mapInArrow(joined, f"{keys}, conv long, ids string"), "ends")
    return pieces.repartition(*KEY).sortWithinPartitions(*order).mapInArrow(hashed, f"{keys}, ends string")


def _key_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], [*KEY, "ends"])


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie, from (conv, p, a, b, w) and (conv, m) as ``number_turns`` gives them."""
    blocks = materialize(_blocks(_paths(turns, convs)), "blocks")
    finals = blocks.where(F.col("depth") == F.col("m")).select("conv", *KEY)
    finals = finals.union(convs.where("m = 0").select("conv", *_root()))
    # Equal conversations go on as their smallest one.
    distinct = materialize(finals.groupBy(*KEY).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("copies")), "distinct")
    whole = distinct.agg(F.min("conv").alias("owner"), F.sum("copies").alias("n")).first()
    root_owner, n_all = whole["owner"], whole["n"] or 0
    own = materialize(blocks.join(distinct.select("conv", "copies"), "conv"), "distinct-blocks")
    marked = materialize(_mark_blocks(own, distinct), "marked")
    segments = materialize(_segments(marked), "segments")

    shared = F.col("owner") != F.col("conv")
    per_conv = segments.groupBy("conv").agg(
        F.sum("words").alias("words"),
        F.sum(F.when(shared, F.col("words")).otherwise(0)).alias("shared"),
        F.max_by("owner", F.when(shared, F.col("depth"))).alias("above"),
        F.min(F.when(~shared, F.col("depth0") + 1)).alias("own_from"),
        F.max(F.when((F.col("depth") == F.col("m")) & (F.col("n") == F.col("copies")), 1).otherwise(0)).alias("leaf"),
    )
    per_conv = materialize(per_conv, "per-conversation")
    # What a conversation (and its copies) adds to the nodes it is a member of; copies share all their words.
    copies = (F.col("copies") - 1) * F.col("words")
    member = segments.drop("words", "n").join(per_conv, "conv")
    mine = F.col("owner") == F.col("conv")
    added = [F.col("copies").alias("n"), (F.when(mine, 0).otherwise(F.col("shared")) + copies).alias("shared"), "leaf"]
    owned = [F.when(mine, F.struct("conv", "own_from", "above", "turns")).alias("owned")]
    none = [F.lit(0).cast("long").alias("children"), F.lit(None).cast("string").alias("ends")]
    nodes = member.select(*KEY, *added, *owned, *none)
    empty = nodes.select("owned").schema["owned"].dataType
    nothing = F.lit(None).cast(empty).alias("owned")
    zero = [F.lit(0).cast("long").alias(c) for c in ("n", "shared", "leaf")]
    children = segments.where(F.col("owner") == F.col("conv")).select(
        F.col("depth0").alias("depth"), F.col("a0").alias("a"), F.col("b0").alias("b"), *zero, nothing,
        F.lit(1).cast("long").alias("children"), none[1],
    )
    ends = _ends(finals).select(*KEY, *zero, nothing, none[0], "ends")
    # All conversations are members of the root, those without turns too.
    root = distinct.select("conv", "copies").join(per_conv, "conv", "left")
    at_root = [
        F.col("copies").alias("n"),
        F.coalesce(F.when(F.col("conv") == root_owner, 0).otherwise(F.col("shared")) + copies, F.lit(0)).alias("shared"),
        F.coalesce("leaf", (F.col("copies") == n_all).cast("int")).alias("leaf"),
    ]
    root = root.select(*_root(), *at_root, nothing, *none)
    found = nodes.union(children).union(ends).union(root).groupBy(*KEY).agg(
        F.sum("n").alias("n"), F.sum("shared").alias("shared"), F.sum("leaf").alias("leaves"), F.first("owned", ignorenulls=True).alias("owned"),
        F.sum("children").alias("children"), F.coalesce(F.max("ends"), F.lit(hashlib.sha256().hexdigest())).alias("ends"),
    )
    return _listed(found, root_owner)


def _mark_blocks(own: DataFrame, distinct: DataFrame) -> DataFrame:
    """``own`` with ``uniform``, whether all members of the node before the block go on with it, and that node's n and owner."""
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    here = own.select(*KEY, F.col("copies").alias("n"), F.col("conv").alias("owner"), zero.alias("going"), none.alias("x"), none.alias("y"))
    root = distinct.select(*_root(), F.col("copies").alias("n"), F.col("conv").alias("owner"), zero, none, none)
    going = own.select("depth0", "a0", "b0", zero, none, "copies", "a", "b")
    parents = here.union(root).union(going).groupBy(*KEY).agg(
        F.sum("n").alias("n"), F.min("owner").alias("owner"), F.sum("going").alias("going"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
    )
    same = (F.col("x0") == F.col("x1")) & (F.col("y0") == F.col("y1")) & (F.col("going") == F.col("n"))
    parents = parents.where("going > 0").select(F.col("depth").alias("depth0"), F.col("a").alias("a0"), F.col("b").alias("b0"), "n", "owner", same.alias("uniform"))
    return own.join(materialize(parents, "block-nodes"), ["depth0", "a0", "b0"])


def _segments(marked: DataFrame) -> DataFrame:
    """Uniform blocks whole, the others turn by turn: with words, and n and owner of the node at the end.

    Only the owner's rows keep their turns.
    """
    words = F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["w"])
    columns = ["conv", "m", "copies", *KEY, "depth0", "a0", "b0", words.alias("words"), "n", "owner"]
    turns = F.when(F.col("owner") == F.col("conv"), F.col("turns")).alias("turns")
    even = marked.where("uniform").select(*columns, turns)
    single = marked.where("NOT uniform").select("conv", "m", "copies", F.explode("turns").alias("t"))
    single = _with_keys(single.select("conv", "m", "copies", F.array("t").alias("turns")))
    nodes = single.groupBy(*KEY).agg(F.sum("copies").alias("n"), F.min("conv").alias("owner"))
    return even.union(single.join(materialize(nodes, "turn-nodes"), KEY).select(*columns, turns))


def _listed(found: DataFrame, root_owner: int | None) -> DataFrame:
    """One row for each node: those inside a uniform block, too."""
    root = found.where("depth = 0").select(
        F.lit(root_owner).cast("long"), "depth", F.lit(None).cast("long"), "n", "children", "leaves", F.col("shared"), "ends"
    )
    each = found.where("depth > 0").withColumn("t", F.explode("owned.turns"))
    last = F.col("t.p") == F.col("depth")
    owner = F.col("owned.conv")
    above = F.coalesce("owned.above", F.lit(root_owner).cast("long"))
    each = each.select(
        owner,
        "t.p",
        F.when(F.col("t.p") == F.col("owned.own_from"), above).otherwise(owner),
        "n",
        F.when(last, F.col("children")).otherwise(1),
        "leaves",
        F.col("shared") - (F.col("n") - 1) * F.col("t.w0"),
        F.when(last, F.col("ends")).otherwise(hashlib.sha256().hexdigest()),
    )
    return root.union(each).toDF(*NODE)


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each node of the trie of all rebuilt conversations."""
    table = read_table(prepare(spark), folder, "conversations")
    return prefix_trie(*rebuild(*number_turns(table)))


SQL = f"""WITH crc AS (SELECT list(list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tbl
  FROM range(256) AS r(i)),
t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id
  ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY pos) AS ls FROM t GROUP BY c),
h AS (SELECT c, xor(list_reduce([4294967295] || [ascii(substr(c::VARCHAR, i, 1))::BIGINT FOR i IN range(1, len(c::VARCHAR) + 1)],
  lambda s, b: xor(s >> 8, tbl[(xor(s, b) & 255) + 1])), 4294967295) % {SHARED} AS h FROM o, crc),
p AS (SELECT o.c, list_concat(b.ls[1:h], o.ls[h + 1:]) AS ls FROM o JOIN h USING (c) LEFT JOIN o AS b ON b.c = o.c - o.c % {GROUP}),
m AS (SELECT c, d, ls[1:d] AS path, d = len(ls) AS ending FROM (SELECT c, ls, unnest(range(len(ls) + 1)) AS d FROM p)),
n AS (SELECT path, d, min(c) AS c, count(*) AS n, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ending) AS ends,
  CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].x, '{WORD}')) END AS w FROM m GROUP BY path, d),
k AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.d = n.d AND k.path = n.path),
s AS (SELECT u.path, u.d, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum((v.n - 1) * v.w) AS saved
  FROM a AS u JOIN a AS v ON v.d >= u.d AND v.path[1:u.d] = u.path GROUP BY u.path, u.d)
SELECT a.c AS conv_id, a.d AS depth, b.c AS parent_conv_id, a.n AS n_convs, a.n_children, n_leaves, saved::BIGINT AS saved_tokens,
  sha256(coalesce(a.ends, '')) AS ends_sha256
FROM a JOIN s ON s.d = a.d AND s.path = a.path LEFT JOIN n AS b ON b.d = a.d - 1 AND b.path = a.path[1:a.d - 1]"""
