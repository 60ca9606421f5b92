"""Prefix trie of conversations by vertical bitmaps, shard by shard.

Conversations are first rebuilt: some opening turns come from the first conversation of a hundred,
the rest are their own. A node of the trie is a distinct sequence of first turns.

1. Turns are hashed and numbered. A node's name is the exclusive-or of the hashes of its (position,
   turn) pairs in two 64-bit lanes, so it needs no walk along the conversation.
2. A shard is SHARD consecutive conversation ids; long conversations are also cut into segments of
   SEGMENT positions. Each piece, SHARD x SEGMENT turns at most, indexes (position, turn) to a
   bitset of conversations. Depth first from its start nodes, the parent's bitset is intersected with
   the posting of the lowest conversation not yet dealt with: one intersection per child. That
   gives children, popcounts, smallest members and the bitsets of conversations that end.
3. Pieces are merged by node name with grouped sums and minima. The piece that holds a node's smallest
   member owns the node, so that a node is counted once.
4. Back in the pieces, with whole counts known, a preorder makes every subtree a range of rows, so
   its sums are differences of running sums. A node's saved tokens are the lengths of all turns at or
   below it in conversations that don't own them; what lies in later segments is added
   per conversation from running sums over segments. All of it adds up over pieces.
5. End lists are bitsets, one per piece, sorted by shard and hashed as a stream.

A group of copies is one path in a shard, a hot first turn one posting. No task ever holds more than
one piece or one batch of bitsets.

Cases: null role or text is empty; a null turn comes first, and turns that tie are ordered by the MD5
of role and text, so repeated rows are turns of their own; rows without a conversation id belong
to none and are left out; a turnless conversation is a member of the root, which is the only node then; an
empty table gives no node; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarterline.functions.ranks import running_sum
from quarterline.llm.common import fixed, query, table

#: Conversation ids that share an opening, and the greatest number of borrowed turns plus one.
FAMILY, BORROWED = 100, 6
#: Conversation ids of a shard, positions of a segment.
SHARD, SEGMENT = 1024, 64


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``c, pos, k, len`` of the original turns: position from 1, hash of role and text, code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashed = F.md5(F.concat(F.length(role), F.lit(":"), role, text).cast("binary"))
    slim = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("c"),
        F.col("turn").isNotNull().alias("has"),
        F.coalesce("turn", F.lit(0)).alias("t"),
        hashed.alias("k"),
        F.length(text).cast("bigint").alias("len"),
    )
    placed = running_sum(slim, ["c"], "t", F.lit(1), "pos", order=["k"], major=["has"])
    return placed.select("c", "pos", "k", "len")


def borrowed(c) -> F.Column:
    """How many opening turns a conversation takes from the first of its family."""
    return F.crc32(c.cast("string").cast("binary")) % BORROWED


def rebuilt(turns: DataFrame) -> DataFrame:
    """``c, pos, ha, hb, len, d`` of rebuilt conversations of d turns; a row at position 0 for each.

    ``ha, hb`` hash the position with the turn.
    """
    counts = turns.groupBy("c").agg(F.count("*").alias("n"))
    c = F.col("c")
    h, base = borrowed(c), c - c % FAMILY
    first = counts.where(c % FAMILY == 0).select(c.alias("base"), F.col("n").alias("bn"))
    convs = counts.select("c", "n", h.alias("h"), base.alias("base")).join(first, "base", "left")
    taken = F.when(c == F.col("base"), F.least("h", "n")).otherwise(F.least("h", F.coalesce("bn", F.lit(0))))
    convs = convs.select("c", "base", "h", taken.alias("p"), (taken + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("d"))
    own = turns.join(convs.select("c", "h", "p", "d"), "c").where((F.col("pos") > F.col("h")))
    own = own.select("c", (F.col("pos") - F.col("h") + F.col("p")).alias("pos"), "k", "len", "d")
    opening = turns.where((c % FAMILY == 0) & (F.col("pos") < BORROWED)).select(c.alias("base"), "pos", "k", "len")
    lent = convs.select("c", "base", "h", "d").join(opening, "base").where(F.col("pos") <= F.col("h"))
    rows = own.unionByName(lent.select("c", "pos", "k", "len", "d"))
    digest = F.md5(F.concat(F.col("pos"), F.lit(":"), F.col("k")).cast("binary"))
    lane = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("bigint")
    zero = F.lit(0).cast("bigint")
    roots = convs.select("c", zero.alias("pos"), zero.alias("ha"), zero.alias("hb"), zero.alias("len"), "d")
    return rows.select("c", "pos", lane(1).alias("ha"), lane(17).alias("hb"), "len", "d").unionByName(roots)


def segment_of(pos) -> F.Column:
    return F.greatest(F.lit(0), F.floor((pos - 1) / SEGMENT)).cast("bigint")


_NODES = (
    "shard bigint, seg bigint, idx int, size int, up int, top boolean, ka bigint, kb bigint, depth bigint, len bigint, "
    "n bigint, least bigint, n_ends bigint, ends binary, through array<bigint>"
)


def bits_of(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def walk_piece(rows: pd.DataFrame, shard: int, seg: int) -> list[tuple]:
    """All nodes of one piece in preorder, by depth-first intersection of bitsets.

    ``size`` counts a node and all below it in the piece, ``up`` is the parent's place (-1: none).
    ``top`` marks a segment's start nodes, which belong to the segment before. ``through`` lists the
    conversations that go on in the next segment.
    """
    start, origin = seg * SEGMENT, shard * SHARD
    postings: dict[tuple, int] = {}
    turn_at: dict[tuple, tuple] = {}
    ends_at: dict[int, int] = {}
    roots: dict[tuple, int] = {}
    place = (rows["c"] - origin).tolist()
    for b, pos, ha, hb, size, d, sa, sb in zip(place, *(rows[x].tolist() for x in ("pos", "ha", "hb", "len", "d", "sa", "sb"))):
        bit = 1 << b
        roots[sa, sb] = roots.get((sa, sb), 0) | bit
        ends_at[d] = ends_at.get(d, 0) | bit
        if pos:
            turn_at[pos, b] = (pos, ha, hb, size)
            postings[pos, ha, hb, size] = postings.get((pos, ha, hb, size), 0) | bit
    present: dict[int, int] = {}
    for (pos, *_), members in postings.items():
        present[pos] = present.get(pos, 0) | members
    out: list[list] = []
    stack = [(members, start, sa, sb, 0, -1) for (sa, sb), members in sorted(roots.items(), reverse=True)]
    while stack:
        members, depth, ka, kb, size, up = stack.pop()
        idx, top = len(out), depth == start and seg > 0
        ends = 0 if top else members & ends_at.get(depth, 0)
        onward = list(bits_of(members & ~ends)) if depth == start + SEGMENT else []
        out.append([
            shard, seg, idx, 1, up, top, ka, kb, depth, size, members.bit_count(), origin + (members & -members).bit_length() - 1,
            ends.bit_count(), ends.to_bytes(-(-ends.bit_length() // 8), "little"), [origin + b for b in onward],
        ])
        rest = members & present.get(depth + 1, 0)
        while rest:
            turn = turn_at[depth + 1, (rest & -rest).bit_length() - 1]
            child = members & postings[turn]
            rest &= ~child
            stack.append((child, depth + 1, ka ^ turn[1], kb ^ turn[2], turn[3], idx))
    for i in range(len(out) - 1, -1, -1):
        if out[i][4] >= 0:
            out[out[i][4]][3] += out[i][3]
    return [tuple(x) for x in out]


def _walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(walk_piece(rows, int(key[0]), int(key[1])), columns=[x.split()[0] for x in _NODES.split(", ")])


_PARTS = "ka bigint, kb bigint, depth bigint, top boolean, parent bigint, saved bigint, leaves bigint, children bigint"


def _sum_piece(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Subtree sums of one piece: its rows in preorder, each subtree a range."""
    rows = rows.sort_values("idx", ignore_index=True)
    own = (rows["least"] == rows["all_least"]).to_numpy() & ~rows["top"].to_numpy()
    up, idx = rows["up"].to_numpy(), rows["idx"].to_numpy()
    end = idx + rows["size"].to_numpy()

    def below(each: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(each)])
        return total[end] - total[idx]

    real = (~rows["top"]).to_numpy().astype(np.int64)
    saved = rows["len"].to_numpy() * (rows["n"].to_numpy() - own) * real + rows["later"].to_numpy()
    childless = (rows["all_n"] == rows["all_ends"]).to_numpy()
    leaves = (own & childless).astype(np.int64) + rows["later_leaves"].to_numpy()
    children = np.bincount(up[own & (up >= 0)], minlength=len(rows))
    parent = pd.array(np.where(up >= 0, rows["all_least"].to_numpy()[np.maximum(up, 0)], 0), "Int64")
    parent[up < 0] = pd.NA
    return pd.DataFrame({
        "ka": rows["ka"], "kb": rows["kb"], "depth": rows["depth"], "top": rows["top"], "parent": parent,
        "saved": below(saved) * real, "leaves": below(leaves) * real, "children": children,
    })


def _hash_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of end lists from bitsets sorted by node and shard; one open hash at a time."""
    open_key, state = None, None
    for rows in batches:
        done = []
        for ka, kb, shard, ends in zip(rows["ka"], rows["kb"], rows["shard"], rows["ends"]):
            ids = ",".join(str(shard * SHARD + b) for b in bits_of(int.from_bytes(ends, "little"))).encode()
            if (ka, kb) != open_key:
                if open_key is not None:
                    done.append((*open_key, state.hexdigest()))
                open_key, state = (ka, kb), hashlib.sha256(ids)
            else:
                state.update(b"," + ids)
        yield pd.DataFrame(done, columns=["ka", "kb", "digest"])
    if open_key is not None:
        yield pd.DataFrame([(*open_key, state.hexdigest())], columns=["ka", "kb", "digest"])


def _starts(rows: DataFrame) -> DataFrame:
    """``c, seg, sa, sb``: node names at the start of later segments of long conversations."""
    each = rows.where(F.col("d") > SEGMENT).groupBy("c", "seg").agg(F.bit_xor("ha").alias("ha"), F.bit_xor("hb").alias("hb"))
    before = W.partitionBy("c").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    return each.select("c", "seg", F.bit_xor("ha").over(before).alias("sa"), F.bit_xor("hb").over(before).alias("sb")).where("seg > 0")


def _later(rows: DataFrame, pieces: DataFrame, merged: DataFrame) -> DataFrame:
    """``shard, seg, idx, later, later_leaves``: what lies in later segments under a segment's last nodes."""
    owned = merged.groupBy(F.col("all_least").alias("c")).agg(
        F.min("depth").alias("from_depth"), F.max((F.col("all_n") == F.col("all_ends")).cast("bigint")).alias("leaf")
    )
    lengths = rows.where(F.col("d") > SEGMENT).join(owned, "c", "left")
    lent = F.when(F.col("from_depth").isNull() | (F.col("pos") < F.col("from_depth")), F.col("len")).otherwise(F.lit(0))
    each = lengths.groupBy("c", "seg").agg(F.sum(lent).alias("s"), F.max(F.coalesce("leaf", F.lit(0))).alias("leaf"))
    after = W.partitionBy("c").orderBy(F.desc("seg")).rowsBetween(W.unboundedPreceding, -1)
    each = each.select("c", "seg", F.coalesce(F.sum("s").over(after), F.lit(0)).alias("s"), "leaf")
    through = pieces.where(F.size("through") > 0).select("shard", "seg", "idx", F.explode("through").alias("c"))
    return through.join(each, ["c", "seg"]).groupBy("shard", "seg", "idx").agg(F.sum("s").alias("later"), F.sum("leaf").alias("later_leaves"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    rows = rebuilt(turn_rows(conversations))
    rows = fixed(rows.withColumns({"shard": F.floor(F.col("c") / SHARD).cast("bigint"), "seg": segment_of(F.col("pos"))}))
    deep = (rows.agg(F.max("d")).first()[0] or 0) > SEGMENT
    zero = F.lit(0).cast("bigint")
    if deep:
        started = rows.join(_starts(rows), ["c", "seg"], "left").withColumns({x: F.coalesce(x, zero) for x in ("sa", "sb")})
    else:
        started = rows.withColumns({"sa": zero, "sb": zero})
    pieces = fixed(started.groupBy("shard", "seg").applyInPandas(_walk, _NODES))
    merged = pieces.where(~F.col("top")).groupBy("ka", "kb").agg(
        F.sum("n").alias("all_n"), F.min("least").alias("all_least"), F.sum("n_ends").alias("all_ends"), F.first("depth").alias("depth")
    )
    slim = pieces.drop("ends", "through").join(merged.drop("depth"), ["ka", "kb"])
    if deep:
        slim = slim.join(_later(rows, pieces, merged), ["shard", "seg", "idx"], "left")
        slim = slim.withColumns({x: F.coalesce(x, zero) for x in ("later", "later_leaves")})
    else:
        slim = slim.withColumns({"later": zero, "later_leaves": zero})
    parts = slim.groupBy("shard", "seg").applyInPandas(_sum_piece, _PARTS)
    sums = parts.groupBy("ka", "kb").agg(
        F.max("depth").alias("depth"),
        F.max(F.when(~F.col("top"), F.col("parent"))).alias("parent"),
        *[F.sum(x).alias(x) for x in ("saved", "leaves", "children")],
    )
    ends = pieces.where("n_ends > 0").select("ka", "kb", "shard", "ends").repartition("ka", "kb").sortWithinPartitions("ka", "kb", "shard")
    ends = ends.mapInPandas(_hash_ends, "ka bigint, kb bigint, digest string")
    none = hashlib.sha256(b"").hexdigest()
    return sums.join(merged.drop("depth"), ["ka", "kb"]).join(ends, ["ka", "kb"], "left").select(
        F.col("all_least").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("all_n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("digest", F.lit(none)).alias("ends_sha256"),
    )


TRIE_SQL = f"""
WITH ct AS (SELECT list(list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, v) ORDER BY v) AS t
  FROM (SELECT unnest(range(256)) AS v)),
o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(struct_pack(role := role, text := text) ORDER BY pos) AS t FROM o GROUP BY c),
hs AS (SELECT c, own.t AS t, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT)),
  lambda a, b: xor(a >> 8, ct.t[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % {BORROWED} AS h FROM own, ct),
reb AS (SELECT a.c, list_concat(coalesce(b.t[1:a.h], []), a.t[a.h + 1:]) AS t FROM hs a LEFT JOIN own b ON b.c = a.c - a.c % {FAMILY}),
pre AS (SELECT c, d, t[1:d] AS p, len(t) = d AS at_end FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM reb)),
node AS (SELECT p, any_value(d) AS d, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE at_end), '')) AS e
  FROM pre GROUP BY p),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY 1),
full_ AS (SELECT node.p, node.d, node.c, node.n, node.e, coalesce(k, 0) AS k FROM node LEFT JOIN kids ON node.p = kids.p),
up AS (SELECT p[1:x] AS p, sum(k = 0) AS leaves, sum(CASE WHEN d = 0 THEN 0 ELSE (n - 1) * length(p[d].text) END) AS saved
  FROM (SELECT p, d, n, k, unnest(range(0, d + 1)) AS x FROM full_) GROUP BY 1)
SELECT f.c AS conv_id, f.d AS depth, q.c AS parent_conv_id, f.n AS n_convs, CAST(f.k AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, f.e AS ends_sha256
FROM full_ f JOIN up ON f.p = up.p LEFT JOIN node q ON f.d > 0 AND q.p = f.p[1:f.d - 1]"""


@query("op12_prefix_trie", TRIE_SQL)
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
