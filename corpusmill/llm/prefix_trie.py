"""Prefix trie of conversations by prefix-doubling names.

Equal turns get one dense name.  Blocks of 2, 4, 8, ... turns that start at a
multiple of their length are named from the names of their halves, so all
blocks of all conversations are named in a logarithmic number of join rounds.
A prefix of d turns is the row of blocks that the binary digits of d cut it
into: the prefix without its last block, which is named already, and that
block.  So prefixes are named in as many rounds as d has digits that are one;
the name of a prefix is its smallest conversation, which together with the
depth is the node of the trie.

Sums over subtrees double as well: what lies less than 2^k turns below a node
is known after round k, and the sums of the nodes exactly 2^k below add the
rest.  No round holds more rows than there are turns, whatever the depth, and
nothing is collected: hot names meet in partial aggregates and in joins with
written tables, which Spark can split.

Edge cases: rows without a conversation id belong to none and are left out; a
null role or text is an empty one; turns with equal numbers are ordered by the
SHA-256 of role and text, repeated rows are turns of their own; very long texts
are read once, for their digest and their words; columns other than those named
are ignored; an empty table gives an empty result (without a conversation there
is no root).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.joins import ranked_rows
from corpusmill.plans.scratch import materialize, remove

from ._sql import crc32_sql
from .mixing import word_count

SHARED_GROUP, SHARED_TURNS = 20, 4
IDS_A_BLOCK = 10  # bits: ids of 1,024 neighbours are joined to a text before they meet


def turn_key(role: Column, text: Column) -> Column:
    """A digest that equal turns share and others do not."""
    role, text = (F.coalesce(c, F.lit("")) for c in (role, text))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def numbered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, key, words): the turns of every conversation in order, from 0.

    Positions come from one range sort of all turns, so a conversation of any length is no single task's work.
    """
    turns = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), turn_key(F.col(role), F.col(text)).alias("key"), word_count(F.col(text)).alias("words")
    )
    placed = ranked_rows(turns, ["conv_id", "turn", "key"]).select("conv_id", "_place", "key", "words")
    firsts = materialize(placed.groupBy("conv_id").agg(F.min("_place").alias("_first")), "firsts")
    return placed.join(firsts, "conv_id").select("conv_id", (F.col("_place") - F.col("_first")).alias("pos"), "key", "words")


def with_shared_starts(turns: DataFrame, group: int = SHARED_GROUP, most: int = SHARED_TURNS) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt so that those of a group begin alike: (convs, turns).

    Of every conversation c the first h turns, h = crc32(c) modulo ``most``, are replaced by the first h of conversation
    c - c % ``group``: all of them if it has fewer, none if it does not exist.  Remainders have the sign of c, as in SQL.
    """
    turns = materialize(turns, "own")
    sizes = materialize(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "sizes")
    begins = sizes.withColumns({"first": F.col("conv_id") - F.col("conv_id") % group, "h": F.crc32(F.col("conv_id").cast("string")) % most})
    heads = sizes.select(F.col("conv_id").alias("first"), F.col("n").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = begins.join(heads, "first", "left").select("conv_id", "first", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))
    convs = materialize(convs, "convs")
    lent = turns.filter(F.col("pos") < most - 1).withColumnRenamed("conv_id", "first")
    lent = convs.select("conv_id", "first", "h").join(lent, "first").filter("pos < h").select("conv_id", "pos", "key", "words")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "words")
    rebuilt = materialize(lent.unionByName(own), "rebuilt")
    remove(turns, sizes)
    return convs.select("conv_id", "n"), rebuilt


def dense_names(df: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """(keys, name): the distinct keys with numbers from 0 without gaps.

    The rows are written with their place in their partition; only the partitions' sizes are added up in one task.
    """
    held = materialize(df.select(*keys).distinct().withColumn("_turn", F.monotonically_increasing_id()), "names")
    part = F.shiftright("_turn", 33)
    # one row for each partition
    sizes = held.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = held.join(F.broadcast(offsets), part == F.col("_p"))
    return numbered.select(*keys, (F.col("_before") + F.col("_turn").bitwiseAND((1 << 33) - 1)).alias(name))


def block_names(turns: DataFrame, longest: int) -> list[DataFrame]:
    """(conv_id, i, name) for each power of two: the name of turns i * 2^k up to (i + 1) * 2^k of a conversation, where all are there."""
    names = dense_names(turns, ["key"])
    levels = [materialize(turns.join(names, "key").select("conv_id", F.col("pos").alias("i"), "name"), "blocks")]
    while 2 << (len(levels) - 1) <= longest:
        half = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("name")))
        pairs = levels[-1].groupBy("conv_id", F.shiftright("i", 1).alias("i")).agg(half(0).alias("a"), half(1).alias("b"))
        pairs = materialize(pairs.filter("a is not null and b is not null"), "pairs")
        levels.append(materialize(pairs.join(dense_names(pairs, ["a", "b"]), ["a", "b"]).select("conv_id", "i", "name"), "blocks"))
        remove(pairs)
    return levels


def prefix_nodes(convs: DataFrame, turns: DataFrame, longest: int) -> DataFrame:
    """(conv_id, depth, node): for every conversation and every depth from 0 to its length the smallest conversation that begins alike."""
    levels = block_names(turns, longest)
    # a block at an even place ends the prefix of (i + 1) * 2^k turns, of which it is the last block
    ends = None
    for k, level in enumerate(levels):
        last = level.filter("i % 2 = 0").select(
            "conv_id", F.shiftleft(F.col("i") + 1, k).alias("depth"), F.shiftleft("i", k).alias("rest"), "name", (F.bit_count("i") + 1).alias("blocks")
        )
        ends = last if ends is None else ends.unionByName(last)
    root = convs.agg(F.min("conv_id").alias("least")).first().least
    rounds = [convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("node"))]
    for r in range(1, longest.bit_length() + 1):
        before = rounds[-1].select("conv_id", F.col("depth").alias("rest"), F.col("node").alias("up"))
        met = materialize(ends.filter(F.col("blocks") == r).join(before, ["conv_id", "rest"]).select("conv_id", "depth", "up", "name"), "met")
        named = materialize(met.groupBy("depth", "up", "name").agg(F.min("conv_id").alias("node")), "nodes")
        rounds.append(materialize(met.join(named, ["depth", "up", "name"]).select("conv_id", "depth", "node"), "prefixes"))
        remove(met, named)
    out = rounds[0]
    for one in rounds[1:]:
        out = out.unionByName(one)
    out = materialize(out, "prefixes")
    remove(*levels, *rounds)
    return out


def subtree_sums(nodes: DataFrame, prefixes: DataFrame, values: list[str], deepest: int) -> DataFrame:
    """(conv_id, depth, values) with each value summed over the node's subtree, the node included."""
    known, k = nodes.select("conv_id", "depth", *values), 0
    while 1 << k <= deepest:
        # the node 2^k turns above is the one of the same conversation
        below = known.filter(F.col("depth") >= 1 << k).select("conv_id", (F.col("depth") - (1 << k)).alias("depth"), *values)
        above = below.join(prefixes, ["conv_id", "depth"]).groupBy(F.col("node").alias("conv_id"), "depth").agg(*(F.sum(v).alias(f"{v}_more") for v in values))
        summed = known.join(above, ["conv_id", "depth"], "left")
        after = materialize(summed.select("conv_id", "depth", *((F.col(v) + F.coalesce(f"{v}_more", F.lit(0))).alias(v) for v in values)), "sums")
        if k:
            remove(known)
        known, k = after, k + 1
    return known


DIGESTS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node over its sorted rows; holds one hash state, not the members."""
    at, state = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*at, state.hexdigest()), DIGESTS, strict=True)], schema=DIGESTS)

    for batch in batches:
        for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
            if at != (conv, depth):
                if at:
                    yield row()
                at, state = (conv, depth), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if at:
        yield row()


def member_digests(members: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of (conv_id, depth, member): the digest of each node's distinct members, ascending and joined by commas.

    Up to 1,024 neighbouring ids are joined to one text first.  The digest of one node can only be taken in order, so
    the texts of a node pass through one task, which holds no more than a batch of them.
    """
    some = F.array_join(F.transform(F.array_sort(F.collect_set("member")), lambda m: m.cast("string")), ",")
    texts = members.groupBy("conv_id", "depth", F.shiftright("member", IDS_A_BLOCK).alias("block")).agg(some.alias("ids"))
    return texts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block").mapInArrow(_digest, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns, from the root without turns (depth 0).

    ``convs`` has (conv_id, n), a row for each conversation and its number of turns; ``turns`` has (conv_id, pos, key,
    words).  A node is named by its smallest member ``conv_id`` and its ``depth``; ``n_convs`` counts its members,
    ``saved_tokens`` is the sum over its subtree of words of the last turn times members beyond the first.
    """
    longest = convs.agg(F.max("n").alias("n")).first().n or 0
    prefixes = prefix_nodes(convs, turns, longest)
    own = prefixes.groupBy(F.col("node").alias("conv_id"), "depth").agg(F.count(F.lit(1)).alias("n_convs"))
    above = prefixes.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent_conv_id"))
    last = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "words")
    nodes = materialize(own.join(above, ["conv_id", "depth"], "left").join(last, ["conv_id", "depth"], "left"), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), ((F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))).alias("saved_tokens")
    )
    nodes = materialize(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")), "nodes")
    sums = subtree_sums(nodes, prefixes, ["n_leaves", "saved_tokens"], longest)
    ended = convs.select("conv_id", F.col("n").alias("depth")).join(prefixes, ["conv_id", "depth"])
    digests = member_digests(ended.select(F.col("node").alias("conv_id"), "depth", F.col("conv_id").alias("member")))
    out = nodes.drop("n_leaves", "saved_tokens").join(sums, ["conv_id", "depth"]).join(digests, ["conv_id", "depth"], "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def conversation_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """:func:`prefix_trie` of the conversations, rebuilt by :func:`with_shared_starts`."""
    return prefix_trie(*with_shared_starts(numbered_turns(conversations, conv, turn, role, text)))


def conversation_trie_sql() -> str:
    """The same rows in DuckDB's SQL, with every prefix written out and every node joined to its ancestors."""
    crc = crc32_sql("conv_id")
    return rf"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 own AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS s, {crc} % {SHARED_TURNS} AS h FROM turns GROUP BY conv_id),
 rebuilt AS (SELECT o.conv_id, list_concat(list_slice(coalesce(f.s, []), 1, o.h), list_slice(o.s, o.h + 1, len(o.s))) AS s FROM own o LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % {SHARED_GROUP}),
 spread AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM rebuilt),
 keyed AS (SELECT conv_id, depth, len(s) AS n, CASE WHEN depth = 0 THEN '' ELSE list_slice(s, 1, depth)::VARCHAR || sha256(array_to_string(list_transform(list_slice(s, 1, depth), lambda x: sha256(x.r) || sha256(x.t)), '')) END AS prefix, CASE WHEN depth > 0 THEN s[depth].t END AS last FROM spread),
 named AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, prefix) AS node FROM keyed),
 nodes AS (SELECT node, depth, count(*) AS n_convs, coalesce(max(len(regexp_extract_all(last, '[^\x20\x09-\x0D]+'))), 0) AS words, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends FROM named GROUP BY node, depth),
 up AS (SELECT v.*, p.node AS parent FROM nodes v LEFT JOIN named p ON p.conv_id = v.node AND p.depth = v.depth - 1),
 kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n FROM up WHERE depth > 0 GROUP BY ALL),
 full_nodes AS (SELECT u.*, coalesce(k.n, 0) AS n_children FROM up u LEFT JOIN kids k ON k.node = u.node AND k.depth = u.depth),
 sums AS (SELECT a.node, a.depth, sum((v.n_convs - 1) * v.words) AS saved, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS leaves FROM full_nodes v JOIN named a ON a.conv_id = v.node AND a.depth <= v.depth GROUP BY a.node, a.depth)
SELECT v.node AS conv_id, v.depth::BIGINT AS depth, v.parent AS parent_conv_id, v.n_convs::BIGINT AS n_convs, v.n_children::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(v.ends) AS ends_sha256
 FROM full_nodes v JOIN sums s ON s.node = v.node AND s.depth = v.depth"""
