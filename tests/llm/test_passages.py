"""Duplicate passages and byte strings against brute force, hostile words and long texts among them."""

import hashlib
import random

import numpy as np
import pytest
from helixframe.llm import substring_dedup, suffix_dedup
from pyspark.sql import functions as F


def kept_words(rows, window):
    first, out = {}, []
    docs = [(k, (t or "").encode().split()) for k, t in rows]
    for k, w in docs:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if k is not None:
                first[key] = min(first.get(key, k), k)
    for k, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            f = first.get(tuple(w[i : i + window]))
            if f is not None and (k is None or f < k):
                gone[i : i + window] = [True] * window
        out.append((k, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def kept_bytes(rows, length):
    first, out = set(), []
    for k, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 2, int)
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in first:
                gone[i : i + length] = 1
            first.add(s)
        mask = gone[: len(raw)] > 0
        out.append((k, len(raw), int(mask.sum()), int((np.diff(gone[:-1], prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~mask].tobytes()).hexdigest()))
    return sorted(out, key=str)


def morse(n, flip):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def passages(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    base = rng.choices(vocab, k=400)
    rows = []
    for i in range(40):
        t = rng.choices(vocab, k=rng.randint(0, 90))
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 380)
            t += base[a : a + rng.randint(30, 150)] + rng.choices(vocab, k=rng.randint(0, 20))
        rows.append((i if i % 7 else None, " ".join(t)))
    return rows


def test_words(spark):
    head, tail = (" ".join(f"{x}{i}" for i in range(30)) for x in "qr")
    rows = passages(3) + [(1001 + f, f"{head} {morse(1024, f)} {tail}") for f in (0, 1)]  # words that simple polynomial hashes confuse
    rows += [(2000 + i, "x " * 300) for i in range(3)] + [(None, None), (5, ""), (5, "a b"), (None, "x " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.digest(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == kept_words(rows, 50)
    odd = df.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.lit(1).alias("my col"), F.lit("z").alias("n_words"))
    out = substring_dedup.remove_repeats(odd)
    assert out.columns == ["doc_id", "my col", "n_words", "n_removed", "kept"] and out.count() == len(rows)


def test_parse_joins_neighbouring_blocks():
    blocks = [{"start": 9, "n": 2, "dup": True}, {"start": 0, "n": 4, "dup": True}, {"start": 4, "n": 3, "dup": True}, {"start": 7, "n": 2, "dup": False}]
    assert substring_dedup.parse(blocks, 5) == ([[0, 11], [9, 15]], [7, 8])


@pytest.mark.parametrize("runs", [1024, 2])
def test_bytes(spark, monkeypatch, runs):
    monkeypatch.setattr(suffix_dedup, "RUNS", runs)
    rng = random.Random(5)
    base = " ".join(rng.choices([f"w{i}" for i in range(40)], k=300))
    rows = []
    for i in range(40):
        t = "".join(rng.choices("abcdé ", k=rng.randint(0, 200)))
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 700)
            t += base[a : a + rng.randint(60, 300)] + "".join(rng.choices("abcd ", k=rng.randint(0, 60)))
        rows.append((i, t))
    rows += [(2000 + i, "x" * (900 + i)) for i in range(3)] + [(3000, "ab" * 500), (3001, "abc" * 400), (None, None), (5000, ""), (6001, "q" * 99), (6002, "q" * 100), (6003, "q\0" * 60)]
    got = suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == kept_bytes(rows, 100)


def test_one_letter_for_long(spark):
    rows = [(1, "x" * 200_000), (2, "x" * 200_000)]
    out = {r.doc_id: r.n_removed for r in suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: 199_999, 2: 200_000}


def test_strings_that_repeat_in_a_shard():
    rng = random.Random(5)
    for _ in range(200):
        parts = [bytes(rng.choices(b"ab\0", k=rng.randint(0, 60))) for _ in range(rng.randint(1, 6))]
        length = rng.choice([3, 5, 8, 10])
        bases, order, leaders = suffix_dedup.repeated(parts, length)
        seen, want = {}, {}
        for b, p in zip(bases.tolist(), parts):
            for i in range(len(p) - length + 1):
                want[b + i] = seen.setdefault(p[i : i + length], b + i)
        assert dict(zip(order.tolist(), leaders.tolist())) == want


def test_shards_merge_to_their_earliest():
    rng = random.Random(7)
    shards, places = [], {}
    for s in range(6):
        strings = sorted({bytes(rng.choices(b"ab\0", k=3)) for _ in range(9)})
        shards.append([(x, (rng.randint(0, 99), s)) for x in strings])
        for x, p in shards[-1]:
            places.setdefault(x, []).append(p)
    assert sorted(suffix_dedup.merge(shards)) == sorted(p for v in places.values() for p in v if p != min(v))
