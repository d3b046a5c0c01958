"""Operator 11, the trie of conversation prefixes: every node is owned by its smallest member, and a conversation owns a suffix of its path.

A node is a distinct sequence of first turns (role, text); its members are the conversations that start with it, the root's are all.
If a conversation is the smallest member of a node, it is the smallest of every deeper node on its path, so one number a conversation,
the depth from which it owns its path, says all about ownership:

* a group by prefix, reduced before the shuffle, finds each node's owner, and a group by owner the depth from which it owns;
* windows over the turns of each conversation mark the nodes that it owns and add up, from each depth down, the tokens of its
  occurrences less those of owned nodes (each node once);
* one group by prefix adds these up over members: saved tokens of the whole subtree, its leaves (each marked at its owner), its
  children (each counted where its owner passes through).

Prefixes travel as 128 bits: two independent hashes of (depth, role, text), each joined over the turns by exclusive or; texts are never
shuffled. Turns of a conversation are ordered by turn (null first), and turns that share a number by the hash of role and text; rows that
are equal in all are turns of their own. A null role or text is empty. `rebuilt` gives conversations a shared start, by rule.

Defined cases: rows without a conv_id belong to no conversation and are left out; an empty table has no nodes; a conversation of very
many turns is a spilling window in one task; extra columns, whatever their names, are ignored. Tokens are UTF-8 bytes.

Hot nodes (the root, a first turn that a third of all conversations share) are reduced before each shuffle; children of hot parents get
the parent's owner by broadcast; and the members that end at a node are put in order by ranges and digested in blocks, so that the task
that joins the digests reads a row for each BLOCK members.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import join_hot, map_arrow, modest_batches, table, written

#: Members in a block of the list of those that end at a node.
BLOCK = 4096
NODE = ["h1", "h2"]


def numbered(conversations: DataFrame, group: Column | None = None) -> DataFrame:
    """conv_id, group, k (from 1), n (turns of the conversation), t1, t2 (hashes of role and text) and bytes of each turn; dealt by group."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit("b"), text, role).alias("t2"), F.octet_length(text).cast("long").alias("bytes"))
    rows = rows.withColumn("group", F.col("conv_id") if group is None else group).repartition("group")
    own = W.Window.partitionBy("group", "conv_id")
    return rows.withColumns({"k": F.row_number().over(own.orderBy(F.asc_nulls_first("turn"), "t1", "t2")), "n": F.count("*").over(own)}).drop("turn")


def rebuilt(conversations: DataFrame, groups: int = 5, heads: int = 9) -> DataFrame:
    """conv_id, length, depth, t1, t2, bytes of conversations with shared starts: the first h turns of conversation c - c % groups, then
    c's own after its first h, with h = crc32(decimal c) % heads. A row of depth 0 stands for each conversation."""
    c = F.col("conv_id")
    turns = written(numbered(conversations, c - F.pmod(c, F.lit(groups))), "turns")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    convs = turns.filter("k = 1").select("conv_id", "group", "n", h.alias("h"))
    bases = convs.filter("conv_id = group").select("group", F.col("n").alias("base_n"))
    convs = convs.join(bases, "group", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = written(convs.select("conv_id", "group", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    root = convs.select("conv_id", "length", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t2"), F.lit(0).cast("long").alias("bytes"))
    starts = turns.filter(f"conv_id = group AND k < {heads}").select("group", "k", "t1", "t2", "bytes")
    first = convs.join(starts, (convs["group"] == starts["group"]) & (starts["k"] <= convs["head"])).select("conv_id", "length", F.col("k").cast("long").alias("depth"), "t1", "t2", "bytes")
    rest = turns.join(convs.select("conv_id", "h", "head", "length"), "conv_id").filter("k > h").select("conv_id", "length", (F.col("head") + F.col("k") - F.col("h")).alias("depth"), "t1", "t2", "bytes")
    return root.unionByName(first).unionByName(rest)


def original(conversations: DataFrame) -> DataFrame:
    """conv_id, length, depth, t1, t2, bytes of conversations as they are, with a row of depth 0 for each."""
    turns = written(numbered(conversations), "turns")
    zero = F.lit(0).cast("long")
    root = turns.filter("k = 1").select("conv_id", F.col("n").alias("length"), zero.alias("depth"), zero.alias("t1"), zero.alias("t2"), zero.alias("bytes"))
    return root.unionByName(turns.select("conv_id", F.col("n").alias("length"), F.col("k").cast("long").alias("depth"), "t1", "t2", "bytes"))


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, length, depth, bytes, h1, h2 (of the prefix) and p1, p2 (of the one before)."""
    own1, own2 = F.xxhash64("depth", "t1", "t2"), F.xxhash64("t2", F.lit("b"), "depth", "t1")
    none = F.lit(0).cast("long")
    rows = turns.withColumns({"a": F.when(F.col("depth") > 0, own1).otherwise(none), "b": F.when(F.col("depth") > 0, own2).otherwise(none)})
    down = W.Window.partitionBy("conv_id").orderBy("depth").rowsBetween(W.Window.unboundedPreceding, 0)
    rows = rows.withColumns({"h1": F.bit_xor("a").over(down), "h2": F.bit_xor("b").over(down)})
    return rows.select("conv_id", "length", "depth", "bytes", "h1", "h2", F.col("h1").bitwiseXOR(F.col("a")).alias("p1"), F.col("h2").bitwiseXOR(F.col("b")).alias("p2"))


def members_digest(ends: DataFrame) -> DataFrame:
    """h1, h2 and ends_sha256: SHA-256 of the ascending conv_ids of each node of ends (h1, h2, conv_id), in decimal, comma-joined.

    Ranges of (h1, h2, conv_id) are even whatever a node holds; blocks of ids follow each other in the digest of their node."""

    def blocks(batch: pa.RecordBatch) -> dict:
        h1, h2, c = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("h1", "h2", "conv_id"))
        new = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
        cuts = np.unique(np.concatenate([[0], new, np.arange(0, len(c), BLOCK)])).tolist()
        ids = c.tolist()
        return {"h1": h1[cuts], "h2": h2[cuts], "first": c[cuts], "ids": [",".join(map(str, ids[a:b])) for a, b in zip(cuts, [*cuts[1:], len(ids)])]}

    def digests(batches):
        key, state = None, None
        for batch in batches:
            out: dict = {"h1": [], "h2": [], "ends_sha256": []}
            for *now, ids in zip(*(batch.column(x).to_pylist() for x in ("h1", "h2", "ids"))):
                if now == key:
                    state.update(b"," + ids.encode())
                    continue
                if key:
                    for name, x in zip(out, (*key, state.hexdigest())):
                        out[name].append(x)
                key, state = now, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pydict(out, schema)
        if key:
            yield pa.RecordBatch.from_pydict({"h1": [key[0]], "h2": [key[1]], "ends_sha256": [state.hexdigest()]}, schema)

    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("ends_sha256", pa.string())])
    modest_batches(ends.sparkSession)
    listed = map_arrow(ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id"), blocks, "h1 long, h2 long, first long, ids string")
    return listed.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "ids").mapInArrow(digests, "h1 long, h2 long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """A row for each node; turns: what `original` or `rebuilt` give."""
    rows = written(paths(turns), "paths")
    nodes = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max("length").alias("longest"))
    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("own_from"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"))

    # what a conversation has from each depth down: tokens of its occurrences, and of the nodes that it owns
    up = W.Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(W.Window.unboundedPreceding, 0)
    from_ = F.coalesce("own_from", F.col("length") + 1)
    marked = rows.join(owners, "conv_id", "left").withColumn("own_from", from_)
    owned = F.col("depth") >= F.col("own_from")
    marked = marked.withColumn("saved", F.sum(F.when(owned, 0).otherwise(F.col("bytes"))).over(up))
    child = (F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= F.col("own_from"))
    found = marked.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.min("depth").alias("depth"),
        F.min("own_from").alias("own_from"),
        F.min("p1").alias("p1"),
        F.min("p2").alias("p2"),
        F.count("*").alias("n_convs"),
        F.sum(child.cast("long")).alias("n_children"),
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"),
    )
    ends = members_digest(rows.filter("depth = length").select(*NODE, "conv_id"))
    found = written(found.join(ends, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))), "nodes")

    # only the first node that a conversation owns hangs on another one's
    first = (F.col("depth") == F.col("own_from")) & (F.col("depth") > 0)
    parents = found.filter("n_children > 0").select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    hung = join_hot(found.filter(first), parents, ["p1", "p2"])
    rest = found.filter(~first).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    return hung.unionByName(rest).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(table(spark, sf_dir, "conversations")))


SQL = """
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, conv_id - conv_id % 5 AS base, count(*) AS n,
             xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                 lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                                       lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % 9 AS h
      FROM o GROUP BY conv_id),
t AS (SELECT s.conv_id, s.h, least(s.h, coalesce(b.n, 0)) AS head, s.base FROM s LEFT JOIN s b ON b.conv_id = s.base),
r AS (SELECT t.conv_id, o.k AS d, o.role, o.text FROM t JOIN o ON o.conv_id = t.base AND o.k <= t.head
      UNION ALL SELECT t.conv_id, t.head + o.k - t.h, o.role, o.text FROM t JOIN o ON o.conv_id = t.conv_id AND o.k > t.h),
p AS (SELECT conv_id, d, text, list([role, text]) OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS path FROM r
      UNION ALL SELECT conv_id, 0, '', [] FROM t),
l AS (SELECT conv_id, max(d) AS len FROM p GROUP BY conv_id),
n AS (SELECT path, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(octet_length(encode(text))) AS own,
             coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE l.len = d), '') AS ends
      FROM p JOIN l USING (conv_id) GROUP BY path),
c AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
e AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM n LEFT JOIN c ON c.path = n.path),
u AS (SELECT a.path, sum(b.own) AS saved, count(*) FILTER (WHERE b.n_children = 0) AS leaves
      FROM e a JOIN e b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path GROUP BY a.path)
SELECT e.conv_id, CAST(e.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, CAST(e.n_convs AS BIGINT) AS n_convs, CAST(e.n_children AS BIGINT) AS n_children,
       CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(e.ends) AS ends_sha256
FROM e JOIN u ON u.path = e.path LEFT JOIN e q ON e.depth > 0 AND q.path = e.path[1:e.depth - 1]
"""
