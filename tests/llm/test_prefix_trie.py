"""The trie of rebuilt conversations against a plain form that lists every prefix."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from fieldspark.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, id string, bytes int, ids string, n int, first string, part int, level int"
ANY = (3, "x", 1, "y", 2, "z", 7, 9)


def plain(rows):
    """{(conv_id, depth): (parent, n, children, leaves, saved, ends)} from (conv, turn, role, text) without ties but of equal rows."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    whole = {}
    for conv in turns:
        h = zlib.crc32(str(conv).encode()) % 9
        base = conv - (abs(conv) % 5) * (1 if conv >= 0 else -1)
        order = lambda c: [t[2:] for t in sorted(turns.get(c, []))]
        whole[conv] = tuple(order(base)[:h] + order(conv)[h:])
    members = defaultdict(set)
    for conv, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].add(conv)
    children = defaultdict(set)
    for seq in members:
        if seq:
            children[seq[:-1]].add(seq)
    leaves, saved, out = {}, {}, {}
    for seq in sorted(members, key=len, reverse=True):
        leaves[seq] = sum(leaves[c] for c in children[seq]) or 1
        saved[seq] = (len(members[seq]) - 1) * (len(seq[-1][1].encode()) if seq else 0) + sum(saved[c] for c in children[seq])
    for seq, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if whole[c] == seq))
        out[min(who), len(seq)] = (min(members[seq[:-1]]) if seq else None, len(who), len(children[seq]), leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest())
    return out


def awkward():
    draw = random.Random(7)
    say = ["hello", "yes", "no", None, "", "déjà vu", "x" * 3000]
    rows = []
    for conv in [*range(-12, 60), 1005, 1006, 2**40]:
        for t in range(draw.choice([1, 2, 2, 3, 5, 9, 14])):
            rows.append((conv, None if t == 0 and conv % 3 == 0 else t, draw.choice(["user", "assistant", None]), draw.choice(say[:3] if conv < 30 else say)))
    copied = [r for r in rows if r[0] == 10]
    rows += [(c, *r[1:]) for c in range(100, 160, 5) for r in copied]  # copies, bases of their own
    rows += [(200, t, "user", "again") for t in range(40)] + [(205, t, "user", "again") for t in range(33)] + [(210, t, "user", "again") for t in range(40)]
    rows += [(3, 1, "user", "yes")] * 2 if not any(r[0] == 3 and r[1] == 1 for r in rows) else []
    rows += [(None, 1, "user", "lost"), (77, 5, "user", "same"), (77, 5, "user", "same")]
    return rows


@pytest.mark.parametrize(("segment", "run_turns", "bits"), [(256, 1 << 16, 56), (9, 7, 56), (16, 1, 56), (256, 40, 4)])
def test_trie_equals_plain_form(spark, segment, run_turns, bits):
    rows = awkward()
    turns = spark.createDataFrame([(*r, *ANY) for r in rows], SCHEMA).repartition(5)
    got = prefix_trie.prefix_trie(turns, segment, run_turns, bits).collect()
    want = plain(rows)
    assert len(got) == len(want)
    assert {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got} == want


def test_query_equals_plain_form(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    want = plain([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
    got = prefix_trie.op11_prefix_trie(spark, sf_dir).collect()
    assert {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got} == want
    assert len(got) == len(want)


def test_sql_equals_plain_form():
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    rows = awkward()
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert {(r[0], r[1]): r[2:] for r in con.execute(prefix_trie.OP11_SQL).fetchall()} == plain(rows)


def test_no_conversation(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_of_medians_is_shallow():
    tree = prefix_trie.Tree()
    for k in prefix_trie._middle_first(1023):
        tree.add([k], [1], k, 1, k)
    steps = []
    for k in range(1023):
        at, n = tree.down[0], 1
        while tree.key[at] != k:
            at, n = (tree.less if k < tree.key[at] else tree.more)[at], n + 1
        steps.append(n)
    assert max(steps) == 10


def test_numbers_of_one_hot_key(spark):
    rows = [(5, (k * 7919) % 10_007) for k in range(5000)] + [(k, 1) for k in range(5)]
    d = prefix_trie.numbered(spark.createDataFrame(rows, "key bigint, o bigint"), "key", ["o"], "at")
    got = {(r["key"], r["o"]): r["at"] for r in d.collect()}
    order = sorted(o for k, o in rows if k == 5)
    assert [got[5, o] for o in order] == list(range(5000))
    assert all(got[k, 1] == 0 for k in range(5))
