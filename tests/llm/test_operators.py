"""The numbered operators against brute-force versions, with rows of every awkward kind."""

import hashlib
import random
import zlib

import pytest
import xxhash
from helixframe.llm import decontaminate, fingerprints, html_text, licenses, quality, registry, sentencepiece_codec, sharding, simhash, substring_dedup, suffix_dedup
from helixframe.llm.license_templates import TEMPLATES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, th string"


def made(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(900)] + ["é", "ß€", "…"]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    passage, base = say(70), say(200)
    texts = [None, "", " \n\t", "one", "one two", "one two three", base, base, base + " tail", base.upper(), passage]
    texts += [say(rng.randint(1, 90)) + " " + passage[rng.randint(0, 9):] + "\n" + say(rng.randint(0, 90)) for _ in range(12)]
    texts += [say(6000), "ab" * 2000, "x" * 350, "x" * 500]
    return [(i * 3, t, None, "hot", len(t or ""), 1, "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_substrings(docs, rows):
    first, words = {}, {r[0]: (r[1] or "").encode().split() for r in rows}
    for k in sorted(words):
        for i in range(len(words[k]) - 49):
            first.setdefault(tuple(words[k][i : i + 50]), k)
    got = by_id(substring_dedup.digest(docs))
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if first[tuple(w[i : i + 50])] < k:
                gone[i : i + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    assert sum(r.n_removed for r in got.values()) > 500


def test_suffixes(docs, rows):
    seen, got = set(), by_id(suffix_dedup.digest(docs))
    for k, text, *_ in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(raw[i : i + 100])
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_simhash(docs, rows):
    prints = {}
    for k, text, *_ in rows:
        w = (text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {k: k for k in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    got = by_id(simhash.near_duplicates(docs))
    assert {k: (r.fingerprint, r.component_id) for k, r in got.items()} == {k: (f"{v:016x}", root[k]) for k, v in prints.items()}


def test_fingerprints(docs, rows):
    got, texts = by_id(fingerprints.edited_fingerprints(docs)), [r[1] or "" for r in rows]
    for i, (k, *_) in enumerate(rows):
        t, after = texts[i], texts[(i + 1) % len(texts)]
        half = len(t) // 2
        assert got[k].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert got[k].n_chars == len(t) and 0 <= got[k].near_edited <= 1
        grams = lambda x: {tuple(w[j : j + 5]) for w in [x.split()] for j in range(max(1, len(w) - 4))} if x.split() else set()
        a, b = grams(t), grams(after)
        assert got[k].near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0, abs=0.15)
    assert got[18].fingerprint == got[21].fingerprint and got[18].near_next == 1.0


def test_fingerprints_of_the_largest_and_of_no_number(spark):
    largest = (1 << 63) - 1
    rows = [(largest, "a b c d e f"), (None, "g h i"), (1, "k"), (None, "l m"), (largest, None), (-largest - 1, "n o")]
    got = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_chars) for r in got) == sorted(((k is None, k or 0), len(t or "")) for k, t in rows)
    after = {r.n_chars: r.edited_sha256 for r in got if r.doc_id is not None}
    assert after[1] == hashlib.sha256(b"k").hexdigest() and after[3] == hashlib.sha256(b"n k").hexdigest()


def test_merged_sketches(spark):
    parts = spark.createDataFrame([("a", [3, 5, 9]), ("a", [1, 5]), ("b", [2])], "key string, s array<bigint>")
    assert {r.key: r.s for r in fingerprints.merge_sketches(parts, "key", "s", k=3).collect()} == {"a": [1, 3, 5], "b": [2]}


def test_sharding(docs, rows):
    got = sharding.shard(docs).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {r[0]: (len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows}
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, sharding.shard(docs.repartition(7)).collect()))


def test_decontamination(spark):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 5, 9, 30, 80])))) for i in range(30)] + [(90, None), (91, ""), (92, "?!")]
    texts = [None, "", *(" ".join([*rng.choices(vocab, k=400), t.upper() if i % 2 else t, *rng.choices(vocab, k=100)]) for i, t in items[:20])]
    half = items[5][1].split()
    texts.append(" ".join(half[: len(half) // 2]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def grams(t):
        w = __import__("regex").findall(r"[\p{L}\p{N}]+", (t or "").lower())
        return {" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()

    expected = {(d, i) for d, t in enumerate(texts) for i, x in items if (q := grams(x)) and len(q & grams(t)) >= 0.8 * len(q) - 1e-9}
    for rows in (500_000, 0):  # broadcast and shuffled
        assert {(r.doc_id, r.item_id) for r in decontaminate.contained(docs, bench, broadcast_rows=rows).collect()} == expected
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == set(range(len(texts))) - {d for d, _ in expected}


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p>a<p>b", "a\n\nb"), ("<div style='display:none'>x</div>y", "y"), ("<script>1</script>t<!-- c -->", "t"),
    ("<ul><li>a<li>b</ul>", "- a\n- b"), ("a&amp;b<br>c", "a&b\nc"), ("<pre>x\n  y</pre>", "x\n  y"),
])
def test_html(spark, page, text):
    out = html_text.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()["text"]
    assert [x.strip("•*- ") for x in out.strip("\n").split("\n")] == [x.strip("- ") for x in text.split("\n")] or out == text


def test_table_cells_line_up(spark):
    page = "<table><tr><td>a<td>bb</tr><tr><td>cccc<td>d</table>"
    first, second = html_text.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()["text"].strip("\n").split("\n")
    assert first.index("bb") == second.index("d")


def test_sentencepiece(docs, rows):
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL_PATH)
    extra = ["<s> </s> <unk>", "tab\tand\n\nlines", "\U0001f600́ 한글 \x01", "  two  spaces ", "▁ mark ▁▁x", "a\x00b", "é" * 3000]
    codec = sentencepiece_codec.load(sentencepiece_codec.MODEL_PATH)
    for t in [r[1] or "" for r in rows] + extra:
        ids = codec.encode([t])[0].tolist()
        assert ids == reference.encode(t)
        assert codec.decode([ids])[0] == codec.tok.decode(ids, skip_special_tokens=False)
    got = by_id(sentencepiece_codec.encode(docs))
    assert all(r.parity and r.decoded == (rows[k // 3][1] or "") and r.n_tokens == len(r.token_ids) for k, r in got.items())


def test_licenses(spark):
    (name, form), text = max(TEMPLATES.items(), key=lambda x: len(x[1]))
    words = text.split()
    near = " ".join(words[:3] + ["extra"] + words[3:])
    docs = spark.createDataFrame([(1, "before " + text + " after"), (2, near), (3, None), (4, ""), (5, "nothing here")], "doc_id long, text string")
    got = licenses.scan(docs).collect()
    assert {(r.doc_id, r.license) for r in got} == {(1, name), (2, name)}
    assert all(r.coverage >= 0.8 for r in got)


def test_quality(spark, sf):
    out = registry.op1_quality(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    held = out[out.held_out].merge(labels, on="doc_id")
    assert (out.held_out == out.doc_id.map(lambda k: zlib.crc32(str(k).encode()) % 5 == 0)).all()
    assert ((held.predicted == 1) == (held.quality == 1)).mean() > 0.9
    assert out.score.between(0, 1).all() and len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        substring_dedup.digest(nothing), suffix_dedup.digest(nothing), simhash.near_duplicates(nothing), fingerprints.edited_fingerprints(nothing), sharding.shard(nothing),
        sentencepiece_codec.encode(nothing), licenses.scan(nothing), quality.classify(nothing, labels),
        decontaminate.contained(nothing, spark.createDataFrame([], "item_id long, text string")), html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert out.count() == 0


def test_null_and_repeated_ids(spark):
    text = " ".join(f"q{i}" for i in range(80))
    docs = spark.createDataFrame([(None, text), (None, text), (1, text), (1, text), (2, "other")], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring_dedup.digest(docs).collect()) == [0, 0, 0, 80, 80]
    assert sorted(r.n_removed > 0 for r in suffix_dedup.digest(docs).collect()) == [False, False, False, True, True]
    for out in (simhash.near_duplicates(docs), fingerprints.edited_fingerprints(docs), sharding.shard(docs)):
        assert out.count() == 5


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept.count(), corpus_pipeline.materialize(stage(spark, kept, sf), "test")
        assert kept.columns == docs.columns and 0 < kept.count() <= before, name
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in kept.collect()}
    assert out.where("not parity").count() == 0
