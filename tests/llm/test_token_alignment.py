"""Tokens aligned by byte offsets against whole texts encoded one by one."""

import hashlib
import json
import random
from collections import Counter

import pytest
import sentencepiece
import tokenizers
from helixframe.llm import registry, token_alignment


def brute(texts):
    """For each text the columns of the contract, from both libraries and loops over tokens."""
    a = tokenizers.Tokenizer.from_file(token_alignment.BYTE_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=token_alignment.MODEL_PATH)
    alphabet = token_alignment._byte_alphabet()
    spell_a = lambda i: bytes(alphabet[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    each = []
    for text in texts:
        a_ids, b_ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        a_bytes, b_bytes = [spell_a(i) for i in a_ids], [spell_b(i) for i in b_ids]
        if not text or not b"".join(a_bytes) == (" " + text).encode() == b"".join(b_bytes):
            each.append(([], [], [], []))
            continue
        spans = []
        for pieces in (a_bytes, b_bytes):
            at, out = 0, []
            for x in pieces:
                out.append((at, at + len(x)))
                at += len(x)
            spans.append(out)
        groups, i, j = [], 0, 0
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        for cut in cuts:
            p = [a_ids[k] for k in range(i, len(a_ids)) if spans[0][k][1] <= cut]
            q = [b_ids[k] for k in range(j, len(b_ids)) if spans[1][k][1] <= cut]
            i, j = i + len(p), j + len(q)
            groups.append(",".join(map(str, p)) + "|" + ",".join(map(str, q)))
        links, low = [], 0
        for x, (s, e) in zip(a_ids, spans[0]):
            while spans[1][low][1] <= s:
                low += 1
            k = low
            while k < len(b_ids) and spans[1][k][0] < e:
                links.append((x, b_ids[k]))
                k += 1
        each.append((a_ids, b_ids, groups, links))
    count = Counter(pair for *_, links in each for pair in links)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    return [
        (len(p), len(q), len(g), len(x), sum(count[pair] == top[pair[1]] for pair in x), sum(count[pair] for pair in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for p, q, g, x in each
    ]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = ["the", "Thtion", "naïve", "don't", "it's", "日本語テキスト", "x" * 40, "12345", "e=mc²", "</s>", "<|endoftext|>", "<0x41>", "…", "(foo)", "🙂🙂", "a\tb", "ﬁn", "é", "é", "\x00", "\x1c"]
    space = [" ", " ", " ", " ", "  ", "\n", "\n\n", "\n ", " \n", "\t", "\r\n", " ", "　", "   \n\n  ", "\x85"]
    out = [None, "", " ", "  ", "\n", "\n\n", " \n", "the", " the", "the ", "the\n", "a▁b the", "▁", "the ▁ the", "日" * 300, "ab " * 4000, "\x1f", " \x1d "]
    out += ["".join(x for _ in range(rng.randint(1, 60)) for x in (rng.choice(words), rng.choice(space))) for _ in range(80)]
    return out + out[7:40]


@pytest.mark.parametrize("dictionary, pairs", [(token_alignment.DICTIONARY, token_alignment.PAIRS), (40, 40), (0, 0)])
def test_same_as_token_by_token(spark, texts, dictionary, pairs):
    rows = [(i if i % 5 else None, t, "clash", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, segment string, key long").repartition(3)
    got = Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in token_alignment.align(docs, dictionary=dictionary, pairs_known=pairs).collect())
    assert got == Counter((r[0], *x) for r, x in zip(rows, brute(texts)))


def test_texts_in_one_piece_where_no_cut_is_known(spark, texts, tmp_path):
    with open(token_alignment.BYTE_PATH) as f:
        settings = json.load(f)
    settings["pre_tokenizer"]["add_prefix_space"] = True  # makes no difference to texts that begin with a space
    path = tmp_path / "other.json"
    path.write_text(json.dumps(settings))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in token_alignment.align(docs, byte_path=str(path)).collect()}
    assert got == dict(enumerate(brute(texts)))


def test_query_on_the_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in registry.queries()["op11_token_alignment"](spark, sf).collect()}
    assert got == {r.doc_id: x for r, x in zip(rows, brute([r.text for r in rows]))}


def test_no_documents(spark):
    assert token_alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []
