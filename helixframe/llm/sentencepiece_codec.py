"""SentencePiece models run by the tokenizers library.

The model's protobuf is read field by field; its normaliser, white-space marker,
pieces, scores and byte fallback are rebuilt as a ``tokenizers`` pipeline
(unigram or BPE, as the model says). Batches are encoded by the library's
threads. Parity with the reference implementation of the format is verified for
every text where ``verify`` is set.

Defined results: null and empty texts have no tokens and decode to ""; strings
of control pieces in a text are ordinary text; white space is kept or collapsed
as the model says; repeated rows and other columns make no difference.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark.sql import DataFrame
from tokenizers import decoders, models, normalizers, pre_tokenizers

MODEL_PATH = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
CUT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Kinds of pieces and models: fixed values of the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Bytes encoded by one call, which bounds memory for any batch.
CALL = 1 << 17
#: Threads of the library in each task.
THREADS = "2"
#: Words of a sequence that goes to the library; several go at once.
WORDS = 4096
#: Cuts whose ids a worker remembers before it forgets all: some 60 MB for words.
REMEMBERED = 300_000


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    unk_id: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_prefix: bool = True
    collapse: bool = True
    escape: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as int, all else as bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(wire)
            if size is None:
                if wire != 2:
                    raise ValueError(f"wire type {wire} is not in this format")
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def parse(data: bytes) -> Model:
    out = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
            out.pieces.append((piece[1].decode("utf-8"), struct.unpack("<f", piece[2])[0], piece[3]))
        elif number == 2:
            trainer = dict(_fields(value))
            out.kind = trainer.get(3, UNIGRAM)
            out.byte_fallback = bool(trainer.get(35, 0))
        elif number == 3:
            norm = dict(_fields(value))
            out.charsmap = norm.get(2, b"")
            out.add_prefix, out.collapse, out.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
    out.unk_id = next((i for i, p in enumerate(out.pieces) if p[2] == UNKNOWN), 0)
    return out


def _merges(model: Model, vocab: dict[str, int]) -> list[tuple[str, str]]:
    """All ways to put a piece together from two, best pieces first."""
    usable = {p for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL:
            for i in range(1, len(piece)):
                if piece[:i] in usable and piece[i:] in usable:
                    found.append((-score, vocab[piece], vocab[piece[:i]], piece[:i], piece[i:]))
    return [(a, b) for *_, a, b in sorted(found)]


def _cuttable(model: Model) -> bool:
    """No piece goes on past a marker: text may be cut before runs of markers and gives the same ids."""
    return model.escape and not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED))


def _cuts(text: str) -> list[str]:
    """What CUT finds in a text; where each marker stands alone before a word, by splitting, which is faster."""
    if text.startswith(MARK) and not text.endswith(MARK) and MARK + MARK not in text:
        return [MARK + w for w in text[1:].split(MARK)]
    return CUT.findall(text)


def _core(model: Model, remember: bool = True):
    """The model without its normaliser; the library remembers pieces unless what it is given never comes twice."""
    vocab = {piece: i for i, (piece, _, _) in enumerate(model.pieces)}
    if model.kind == UNIGRAM:
        return models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk_id, model.byte_fallback)
    if model.kind == BPE:
        return models.BPE(vocab, _merges(model, vocab), unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback, **({} if remember else {"cache_capacity": 0}))
    raise ValueError(f"models of kind {model.kind} are not supported")


def build(model: Model) -> tokenizers.Tokenizer:
    """The model as one pipeline of the library."""
    tok = tokenizers.Tokenizer(_core(model))
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.collapse:
        steps += [normalizers.Strip(), normalizers.Replace(tokenizers.Regex(" {2,}"), " ")]
    if model.add_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    tok.normalizer = normalizers.Sequence(steps)
    if _cuttable(model):
        tok.pre_tokenizer = pre_tokenizers.Split(tokenizers.Regex(CUT.pattern), "isolated")
    user = [p for p, _, kind in model.pieces if kind == USER_DEFINED]
    if user:
        tok.add_tokens([tokenizers.AddedToken(p, normalized=False) for p in user])
    parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tok.decoder = decoders.Sequence(parts + ([decoders.Strip(" ", 1, 0)] if model.add_prefix else []))
    return tok


class Codec:
    """Batches of texts to ids and back.

    Where the model lets text be cut, texts are normalised and cut here, which
    is faster than the library's own steps. Different cuts go to the library in
    batches and are remembered, as running text repeats its words. For other
    models whole texts go through the pipeline.
    """

    def __init__(self, model: Model) -> None:
        self.model, self.tok = model, build(model)
        self.cut = _cuttable(model) and not any(kind == USER_DEFINED for *_, kind in model.pieces)
        self.pieces = tokenizers.Tokenizer(self.tok.model)
        #: What different cuts are encoded by.
        self.once = tokenizers.Tokenizer(_core(model, remember=False)) if self.cut else None
        self.known: dict[str, bytes] = {}
        #: A piece as it is read; ASCII bytes stand for themselves, other bytes get a mark: the library puts them together.
        byte = lambda p: chr(int(p[3:5], 16)) if int(p[3:5], 16) < 128 else "\0"
        self.surface = [byte(p) if kind == BYTE else "\0" if "\0" in p else p.replace(MARK, " ") for p, _, kind in model.pieces]
        self.marked = np.array([p.startswith(MARK) for p, *_ in model.pieces])
        self.charsmap = normalizers.Precompiled(model.charsmap) if model.charsmap else None

    def normalize(self, text: str) -> str:
        if self.charsmap:
            text = self.charsmap.normalize_str(text)
        if self.model.collapse:
            text = re.sub(" {2,}", " ", text.strip(" "))
        return (MARK if self.model.add_prefix and text else "") + text.replace(" ", MARK)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.cut:
            return [np.array(e.ids, np.int32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        cuts = [_cuts(self.normalize(t)) for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        known.update(self._ids(list(set().union(*cuts).difference(known))))
        return [np.frombuffer(b"".join(map(known.__getitem__, part)), np.int32) for part in cuts]

    def _ids(self, cuts: list[str]) -> dict[str, bytes]:
        """The ids of different cuts, as the bytes of an int32 array. Those of one marker and a word go as
        sequences of words, which the library's threads share: a piece that begins with the marker begins a cut."""
        words = [c for c in cuts if len(c) > 1 and c[0] == MARK and c[1] != MARK]
        out = {}
        if words:
            sequences = [words[i : i + WORDS] for i in range(0, len(words), WORDS)]
            ids = np.concatenate([np.array(e.ids, np.int32) for e in self.once.encode_batch_fast(sequences, is_pretokenized=True, add_special_tokens=False)])
            at = np.flatnonzero(self.marked[ids]).tolist()
            if len(at) == len(words) and at[0] == 0:
                raw, ends = ids.tobytes(), [*at[1:], len(ids)]
                out = {c: raw[4 * i : 4 * j] for c, i, j in zip(words, at, ends)}
        rest = [c for c in cuts if c not in out] if len(out) < len(cuts) else []
        out.update(zip(rest, (np.array(e.ids, np.int32).tobytes() for e in self.once.encode_batch_fast(rest, add_special_tokens=False))))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of ids. Pieces without bytes to be put together are joined here, others by the library."""
        out = ["".join(map(self.surface.__getitem__, x)) for x in ids]
        whole = [i for i, x in enumerate(out) if "\0" in x]
        for i, text in zip(whole, self.tok.decode_batch([ids[i] for i in whole], skip_special_tokens=False)):
            out[i] = text
        if self.model.add_prefix:
            done = set(whole)
            out = [x if i in done else x.removeprefix(" ") for i, x in enumerate(out)]
        return out


def load(path: str) -> Codec:
    with open(path, "rb") as f:
        return Codec(parse(f.read()))


_built: dict[bytes, tuple] = {}


def _built_once(proto: bytes, verify: bool) -> tuple:
    """The codec and, if wanted, the reference, built once a worker."""
    os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
    if proto not in _built:
        _built[proto] = (Codec(parse(proto)), None)
    codec, reference = _built[proto]
    if verify and reference is None:
        import sentencepiece

        reference = sentencepiece.SentencePieceProcessor(model_proto=proto)
        _built[proto] = (codec, reference)
    return codec, reference


def _calls(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CALL bytes, one text at least."""
    lo = total = 0
    for hi, n in enumerate(sizes):
        if hi > lo and total + n > CALL:
            yield lo, hi
            lo, total = hi, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def _codec(proto: bytes, verify: bool, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, reference = _built_once(proto, verify)
        names = [*keep, "token_ids", "n_tokens", "decoded", "round_trip", "parity"]
        for batch in batches:
            sizes = [n or 0 for n in pc.binary_length(batch.column("text")).to_pylist()]
            for lo, hi in _calls(sizes):
                piece = batch.slice(lo, hi - lo)
                part = [x or "" for x in piece.column("text").to_pylist()]
                arrays = codec.encode(part)
                ids = [x.tolist() for x in arrays]
                ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))
                back = codec.decode(ids)
                same = [x == y for x, y in zip(ids, reference.encode(part, num_threads=1))] if verify else [None] * len(part)
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in keep), lists, pa.array(np.diff(ends).astype(np.int64)), pa.array(back, pa.string()),
                     pa.array([x == y for x, y in zip(back, part)]), pa.array(same, pa.bool_())], names)

    return run


def encode(documents: DataFrame, path: str = MODEL_PATH, verify: bool = True) -> DataFrame:
    """doc_id, token_ids, n_tokens, decoded text, round_trip and parity.

    round_trip says that the decoded text is the text itself (a model that
    normalises may change it); parity that the ids equal those of the format's
    own library, null where not verified. The driver reads the model file, of
    some hundred kB, and sends it along; executors need no path.
    """
    with open(path, "rb") as f:
        proto = f.read()
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, token_ids array<int>, n_tokens long, decoded string, round_trip boolean, parity boolean"
    return documents.select("doc_id", "text").mapInArrow(_codec(proto, verify, ["doc_id"]), schema)

