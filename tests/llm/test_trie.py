"""Nodes and subtree totals against a trie in dictionaries."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from locusflow.llm import trie

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def plain(rows):
    def order(r):
        role, text = r[2] or "", r[3] or ""
        return (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest())

    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        leaf = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in nodes)]
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(p))))
        above = min(nodes[p[:-1]]) if p else None
        children = sum(len(q) == len(p) + 1 for q in below)
        out.append((min(members), len(p), above, len(members), children, len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 AS depth", "2 AS a", "3 AS rank", "4 AS words")
    got = sorted((tuple(r) for r in trie.prefix_trie(df, **kw).collect()), key=str)
    assert got == plain(rows)


def conversations(seed, n, longest, kinds):
    random.seed(seed)
    rows = []
    for c in range(n):
        for t in range(random.randrange(1, longest)):
            rows.append((c, t, random.choice(["user", "assistant", None]), random.choice([f"w{k} x" * (k % 3) for k in range(kinds)] + [None])))
    return rows


@pytest.mark.parametrize(("shard_turns", "queue_limit"), [(200_000, 200_000), (6, 2), (0, 3)])
def test_against_plain(spark, shard_turns, queue_limit):
    check(spark, conversations(shard_turns, 70, 7, 2), shard_turns=shard_turns, queue_limit=queue_limit)


def test_edges(spark):
    rows = conversations(5, 25, 5, 2)
    rows += [(None, 0, "user", "lost"), (1000, None, None, None), (1000, None, None, None), (1000, 3, "user", ""), (1000, 3, "user", "tie"), (1001, 5, "a", "b" * 50_000)]
    check(spark, rows + rows[:9], shard_turns=20)


def test_copies_and_one_long_conversation(spark):
    """Half of the conversations are equal, one holds a third of all turns, and it has a copy."""
    rows = [(20 * c, t, "user", f"t{t} same") for c in range(30) for t in range(4)]
    rows += [(c, t, "user", f"long {t}") for c in (7, 9) for t in range(120)]
    rows += [(11, t, "user", f"own {t}") for t in range(200)]
    check(spark, rows, shard_turns=10, queue_limit=4)


def test_no_conversations(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []


def test_queue_spills():
    random.seed(1)
    queue, messages = trie.SpillingQueue(limit=5), [((random.randrange(20),), k) for k in range(200)]
    for key, k in messages:
        queue.push(key, k)
    assert queue.spilled >= 40
    for key in range(20):
        assert sorted(v for (v,) in queue.take((key,))) == [k for (x,), k in messages if x == key]
    assert not queue.heap and not queue.runs
