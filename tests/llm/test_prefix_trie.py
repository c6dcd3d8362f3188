"""The trie of conversations against one built turn by turn."""

import hashlib
import random
import re
import zlib

import pytest
from helixframe.llm import prefix_trie


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))  # remainders as SQL has them
        full[c] = own.get(base, [])[:h] + v[h:]
    members = {}
    for c, v in full.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    out = set()
    for seq, who in members.items():
        below = [s for s in members if s[: len(seq)] == seq]
        children = [s for s in below if len(s) == len(seq) + 1]
        leaves = [s for s in below if not any(len(t) == len(s) + 1 and t[: len(s)] == s for t in below)]
        saved = sum((len(members[s]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) for s in below if s)
        ends = ",".join(map(str, sorted(c for c in who if len(full[c]) == len(seq))))
        parent = min(members[seq[:-1]]) if seq else None
        out.add((min(who), len(seq), parent, len(who), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    say = lambda: rng.choice(["a", "b c", "c  d e", "", None, " ", "é x"])
    out = []
    for c in [*range(-45, 90), 4000, 4001, 4002, 2**62]:
        if c % 20 or rng.random() < 0.7:  # some families have no first conversation
            for t in range(rng.choice([1, 1, 2, 3, 3, 4, 5, 9, 17])):
                out.append((c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "user", None]), say()))
    out += [(4000, t, "user", "same") for t in range(40)] + [(4005, t, "user", "same") for t in range(70)]
    out += [(None, 1, "user", "no conversation"), (None, None, None, None)]
    out += out[5:9]  # repeated rows
    rng.shuffle(out)
    return out


def test_same_as_turn_by_turn(spark, rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    monkeypatch.setattr(prefix_trie.ends_digest, "__defaults__", (3,))  # several strings a node
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, name string, depth long").repartition(5)
    got = [tuple(r) for r in prefix_trie.trie(frame).collect()]
    expected = brute(rows)
    assert len(got) == len(expected) and set(got) == expected


def test_no_conversations(spark):
    frame = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(frame).collect() == [] == prefix_trie.trie(frame.limit(0)).collect()
