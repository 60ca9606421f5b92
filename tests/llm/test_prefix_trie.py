"""The conversation trie against plain Python, over copies, long conversations and odd rows."""

import hashlib
import math
import random
import zlib

import pytest

from quarterline.llm import prefix_trie as p


def brute(rows):
    own = {}
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members = {}
    for c, t in paths.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    kids, leaves, saved = {}, {}, {}
    for t in members:
        if t:
            kids[t[:-1]] = kids.get(t[:-1], 0) + 1
    for t, m in members.items():
        for d in range(len(t) + 1):
            leaves[t[:d]] = leaves.get(t[:d], 0) + (t not in kids)
            saved[t[:d]] = saved.get(t[:d], 0) + (len(m) - 1) * (len(t[-1][1]) if t else 0)
    out = []
    for t, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if paths[c] == t)
        out.append((min(m), len(t), min(members[t[:-1]]) if t else None, len(m), kids.get(t, 0), leaves[t], saved[t], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk(rng, n):
    return [("user" if i % 2 == 0 else "assistant", rng.choice("abcé😀") * rng.randrange(0, 4)) for i in range(n)]


def rows_of(convs):
    return [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]


def mixture():
    rng = random.Random(9)
    convs = {c: talk(rng, rng.randrange(1, 9)) for c in [*range(0, 130), 305, 307, 1023, 1024, 1100, 1101, 5003, -1, -5, -100, -101, -2000]}
    same = talk(rng, 6)
    convs |= {c: list(same) for c in range(1400, 1460)}
    convs |= {c: [same[0], *talk(rng, 3)] for c in range(2000, 2060)}
    deep = talk(rng, 3 * p.SEGMENT)
    for i, c in enumerate((3000, 3001, 3050, 4100, 4101, 4150)):  # share long beginnings in several shards
        convs[c] = deep[: rng.choice([p.SEGMENT - 1, p.SEGMENT, 2 * p.SEGMENT, len(deep)])] + talk(rng, i * 30)
    convs[4200], convs[4201], convs[4202] = list(deep), list(deep), deep[: p.SEGMENT + 1]
    rows = rows_of(convs)
    rows += [(60, None, None, "first"), (60, None, "user", None), (61, 2, "user", "tie"), (61, 2, "user", "tie"), (62, 1, None, None)]
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [mixture(), [(7, 0, "user", "x")], [(100, 0, "u", "a"), (100, 0, "u", "b")]])
def test_nodes_are_those_of_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, LEN string, shard int").repartition(6)
    assert sorted((tuple(r) for r in p.prefix_trie(df).collect()), key=str) == brute(rows)


def test_turnless_conversations_and_no_rows(spark):
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 2)
    df = spark.createDataFrame([(c, 0, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    only = p.prefix_trie(df).collect()
    assert [tuple(r) for r in only] == brute([(c, 0, "user", "x")])
    assert only[0].depth == 0 and only[0].n_leaves == 1 and only[0].parent_conv_id is None
    assert p.prefix_trie(df.where("conv_id < 0")).count() == 0


def test_pieces_are_bounded_and_children_cost_one_intersection():
    """A piece's work grows with its nodes: a group of copies is one path."""
    import pandas as pd

    one = [(b, pos, pos, 1, 5, 8) for b in range(p.SHARD) for pos in range(9)]
    rows = pd.DataFrame(one, columns=["c", "pos", "ha", "hb", "len", "d"]).assign(sa=0, sb=0)
    nodes = p.walk_piece(rows, 0, 0)
    assert len(nodes) == 9 and all(n[10] == p.SHARD for n in nodes) and nodes[-1][12] == p.SHARD
