"""Prefix trie of conversations by collapsing whole sequences.

``rebuilt`` gives the turns of each conversation: here the first ones of another conversation, then its own. ``chained`` walks
through the turns, sorted within tasks, and gives each prefix a key: 128 bits of SHA-256 over the key before and the turn's
digest. Only digests and lengths are shuffled, no texts.

Identical conversations collapse into one weighted sequence with its list of ends, so a conversation that a third of all are equal
to costs one row per turn. Sequences that are proper prefixes of others go by an anti-join; the rest are leaves. The prefixes of
distinct sequences are then added up by key, with weights: members, leaves, bytes.

Saved bytes of a subtree need each distinct node once. A node is charged to the sequence of its smallest member; along a
sequence these nodes are the last ones, from the first on whose smallest member is its own (none, if a smaller one goes on
from its end). So two sums over the prefixes of
sequences are enough, and no node is joined with its ancestors.

A hot prefix is a hot key in three places. Sums are pre-aggregated in the tasks before. The look-up of a parent's smallest
member joins nodes of one hot parent with one row, which Spark splits; only sequences' first own nodes need it. Lists of ends are
gathered for ``CHUNK`` neighbouring ids at a time and digested as a stream in order, so the sequence with most ends costs one task
a hundredth to a thousandth of its ids in rows, and no memory.

Defined cases: turns are ordered by ``turn``, null first, ties by the SHA-256 of role and text, equal rows stay; null role
and text are empty; rows without ``conv_id`` are left out; conversations of any length are streamed; a conversation without turns is
a member of the root and ends there; other columns are not read; an empty table gives no node.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Conversations that share a beginning; ids of one list of ends; the smallest lengths that may be taken over.
GROUP, CHUNK, SHARED = 5, 4096, 9
CHAIN = "conv_id long, depth long, key binary, parent binary, bytes long, before long, last boolean"
ROOT = hashlib.sha256(b"").digest()[:16]


def _turns(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, at, digest, bytes), ``at`` from 0 in order of the turns."""
    role, text = common.text_of("role"), common.text_of("text")
    digest = F.unhex(F.sha2(F.concat(F.lpad(F.octet_length(role).cast("string"), 10, "0"), role, text), 256))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).where("conv_id IS NOT NULL")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "digest")) - 1
    return rows.select("conv_id", at.cast("long").alias("at"), "digest", "bytes")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, part, at, digest, bytes) of every conversation c: one of part -1 for itself, then the first h turns of
    conversation c - c % 5 (part 0) and its own after its first h (part 1); h = crc32(c as text) % 9."""
    turns = common.written(_turns(conversations), "turns")
    shared = F.crc32(F.col("conv_id").cast("string")) % SHARED
    convs = turns.where("at = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), shared.alias("h"))
    first = turns.where(F.col("at") < SHARED - 1).withColumnRenamed("conv_id", "base")
    taken = first.join(convs, "base").where("at < h").select("conv_id", F.lit(0).alias("part"), "at", "digest", "bytes")
    own = turns.where(F.col("at") >= shared).select("conv_id", F.lit(1).alias("part"), "at", "digest", "bytes")
    heads = convs.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("at"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return heads.unionByName(taken).unionByName(own)


def chained(sequences: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, key, parent, bytes, before, last): the prefixes of each conversation of ``rebuilt`` rows.

    ``bytes`` is the length of the prefix's last text, ``before`` the sum of the ones before it."""

    def run(batches):
        held = conv = key = None
        for batch in batches:
            out = []
            for own, part, digest, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "digest", "bytes")), strict=True):
                if held is not None:
                    out.append((*held, own != conv))
                if own != conv:
                    conv, key, depth, before, held = own, ROOT, 0, 0, (own, 0, ROOT, None, 0, 0)
                    if part < 0:
                        continue
                    out.append((*held, False))
                parent, depth, key = key, depth + 1, hashlib.sha256(key + digest).digest()[:16]
                held, before = (conv, depth, key, parent, size, before), before + size
            if out:
                yield _rows(out)
        if held is not None:
            yield _rows([(*held, True)])

    ordered = sequences.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")
    return ordered.mapInArrow(run, CHAIN)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "depth", "key", "parent", "bytes", "before", "last"])


def ends(chain: DataFrame) -> DataFrame:
    """Rows (key, chunk, conv_ids): the conversations that end with a prefix, ascending, ``CHUNK`` neighbouring ids a row."""
    chunk = F.floor(F.col("conv_id") / F.lit(CHUNK)).cast("long")
    return chain.where("last").groupBy("key", chunk.alias("chunk")).agg(F.array_sort(F.collect_list("conv_id")).alias("conv_ids"))


def ends_digests(lists: DataFrame) -> DataFrame:
    """Rows (key, ends_sha256): SHA-256 of each prefix's ends, joined by commas, in a stream over its lists."""

    def run(batches):
        key = digest = None
        for batch in batches:
            out = []
            for own, text in zip(batch.column("key").to_pylist(), common.as_bytes(batch.column("ids")), strict=True):
                if own != key:
                    if key is not None:
                        out.append((key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256(text)
                else:
                    digest.update(b"," + text)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], type=pa.binary()), pa.array([d for _, d in out], type=pa.string())], names=["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], type=pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    rows = lists.select("key", "chunk", F.array_join(F.transform("conv_ids", lambda c: c.cast("string")), ",").alias("ids"))
    return rows.repartition("key").sortWithinPartitions("key", "chunk").select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def nodes(chain: DataFrame) -> DataFrame:
    """The trie's nodes: (key, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens)."""
    whole = chain.where("last").withColumn("total", F.col("before") + F.col("bytes"))
    sequences = common.written(whole.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.first("total").alias("total")), "sequences")
    # one conversation of each sequence stands for it
    prefixes = chain.drop("last").join(sequences.drop("key"), "conv_id")
    first = common.written(
        prefixes.groupBy("key").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("before").alias("before"), F.min("conv_id").alias("conv_id"), F.sum("weight").alias("n_convs")),
        "nodes",
    )
    inner = first.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    leaves = sequences.join(inner, "key", "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    own = first.groupBy("conv_id").agg(F.min("before").alias("own_before"), F.min("depth").alias("own_depth"))
    charged = prefixes.select("conv_id", "key", "before", "weight", "total").join(own, "conv_id", "left").join(leaves, "conv_id", "left")
    saved = F.col("weight") * (F.col("total") - F.col("before")) - (F.col("total") - F.greatest("before", F.coalesce("own_before", "total")))
    sums = charged.groupBy("key").agg(F.sum(saved).alias("saved_tokens"), F.sum(F.coalesce("leaf", F.lit(0))).cast("long").alias("n_leaves"))
    found = first.join(sums, "key").join(inner, "key", "left").join(own.select("conv_id", "own_depth"), "conv_id").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    # below a sequence's first own node the parent has the same smallest member
    above = first.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    kept = [c for c in found.columns if c not in ("before", "own_depth")]
    same = found.where("depth > own_depth").select(*kept, F.col("conv_id").alias("parent_conv_id"))
    other = found.where("depth = own_depth").join(above, "parent", "left").select(*kept, F.col("above").alias("parent_conv_id"))
    return same.unionByName(other).select("key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def trie(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie of rebuilt conversations, and the lists of their ends."""
    chain = common.written(chained(rebuilt(conversations)), "chain")
    return nodes(chain), ends(chain)


#: CRC-32 of a number's digits, from the polynomial.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda r, b:
  xor(r >> 8, list_reduce(list_prepend(xor(r, b) & 255, [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)))"""

ORACLE = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, {{'role': role, 'text': text}} AS m, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST,
        sha256(lpad(octet_length(encode(role))::VARCHAR, 10, '0') || role || text)) - 1 AS pos FROM t),
h AS (SELECT c, c - c % {GROUP} AS base, xor({_CRC}, 4294967295) % {SHARED} AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, 0 AS part, pos, m FROM h JOIN o ON o.c = h.base WHERE pos < h.h UNION ALL SELECT h.c, 1, pos, m FROM h JOIN o USING (c) WHERE pos >= h.h),
s AS (SELECT c, coalesce(list(m ORDER BY part, pos) FILTER (m IS NOT NULL), []) AS own FROM h LEFT JOIN r USING (c) GROUP BY c),
p AS (SELECT c, own, len(own) AS n, unnest(range(0, len(own) + 1)) AS depth FROM s),
k AS (SELECT c, n, depth, own[1:depth] AS path, own[1:depth-1] AS up, CASE WHEN depth > 0 THEN octet_length(encode(own[depth].text)) ELSE 0 END AS bytes FROM p),
node AS (SELECT depth, path, any_value(up) AS up, any_value(bytes) AS bytes, min(c) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256 FROM k GROUP BY depth, path),
kids AS (SELECT depth - 1 AS depth, up AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (depth, path)),
above AS (SELECT path, conv_id, n_convs, bytes, n_children, unnest(range(0, depth + 1)) AS depth FROM full_node),
below AS (SELECT depth, path[1:depth] AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * bytes) AS saved FROM above GROUP BY ALL)
SELECT a.conv_id, a.depth::BIGINT AS depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children::BIGINT AS n_children, below.n_leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, a.ends_sha256
FROM full_node AS a JOIN below ON below.depth = a.depth AND below.path = a.path LEFT JOIN node AS b ON a.depth > 0 AND b.depth = a.depth - 1 AND b.path = a.up
"""
