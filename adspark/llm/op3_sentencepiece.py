"""SentencePiece encoding and decoding through the tokenizers library.

The model file's protobuf is parsed here (pieces, scores, types, trainer and
normaliser fields); the normaliser, the metaspace marker, the scores (Unigram,
or the merges that a BPE model's scores stand for) and byte fallback are
rebuilt as a ``tokenizers.Tokenizer``. A task encodes in one thread.
Parity with the reference library is verified on every distinct segment that
is encoded, so on all of each text.

Null and empty text: no ids, decoded to the empty text. Repeated rows: equal
results. Very long texts: in segments, whole. Extra columns are left alone;
those named ``ids``, ``round_trip`` or ``parity`` give way to the result's.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import flat
from .common import bound_batches, lean, pieces, shield
from .segments import SegmentEncoder

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(b: bytes):
    """(field number, value) of a protobuf message; value is an int or bytes."""

    def varint(i):
        r = s = 0
        while True:
            c = b[i]
            i += 1
            r |= (c & 127) << s
            s += 7
            if c < 128:
                return r, i

    i = 0
    while i < len(b):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = b[i : i + n], i + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, i = b[i : i + n], i + n
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def parse_model(blob: bytes) -> dict:
    """pieces [(text, score, type)], kind, byte_fallback, unk_id and the normaliser's fields."""
    out = {"pieces": [], "kind": 1, "byte_fallback": False, "unk_id": 0, "name": "nmt_nfkc", "charsmap": b"", "dummy_prefix": True, "squeeze": True, "escape": True}
    for f, v in _fields(blob):
        if f == 1:
            p = dict(_fields(v))
            out["pieces"].append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        elif f == 2:
            t = dict(_fields(v))
            out |= {"kind": t.get(3, 1), "byte_fallback": bool(t.get(35, 0)), "unk_id": t.get(40, 0)}
        elif f == 3:
            n = dict(_fields(v))
            out |= {
                "name": n.get(1, b"").decode(), "charsmap": n.get(2, b""), "dummy_prefix": bool(n.get(3, 1)),
                "squeeze": bool(n.get(4, 1)), "escape": bool(n.get(5, 1)),
            }
    return out


def merges_of(pieces: list) -> list[tuple[str, str]]:
    """The merges of a BPE model: every split of a piece into two pieces, best score first."""
    rank = {p: i for i, (p, _, _) in enumerate(pieces)}
    out = []
    for i, (p, score, kind) in enumerate(pieces):
        if kind != NORMAL or len(p) < 2:
            continue
        halves = [(p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank]
        out += [(-score, i, rank[a], rank[b], a, b) for a, b in halves]
    out.sort(key=lambda x: x[:4])
    return [(x[4], x[5]) for x in out]


def build(model: dict):
    """A ``tokenizers.Tokenizer`` with the model's results, without the dummy prefix."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    pieces = model["pieces"]
    unk = pieces[model["unk_id"]][0]
    if model["kind"] == 1:
        core = models.Unigram([(p, s) for p, s, _ in pieces], unk_id=model["unk_id"], byte_fallback=model["byte_fallback"])
    elif model["kind"] == 2:
        vocab = {p: i for i, (p, _, _) in enumerate(pieces)}
        core = models.BPE(vocab, merges_of(pieces), unk_token=unk, fuse_unk=True, byte_fallback=model["byte_fallback"])
    else:
        raise ValueError(f"model type {model['kind']}")
    tok = Tokenizer(core)
    steps = []
    if model["charsmap"]:
        steps.append(normalizers.Precompiled(model["charsmap"]))
    if model["squeeze"]:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tok.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, k in pieces if k == NORMAL):
        # no piece has a marker behind another character: merges never cross there
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    own = [AddedToken(p, normalized=False) for p, _, k in pieces if k == USER]
    if own:
        tok.add_tokens(own)
    return tok


class Codec:
    """Encoder and decoder of one model file; ``verify`` compares every distinct segment with the reference library."""

    def __init__(self, blob: bytes, verify: bool = True):
        self.model = parse_model(blob)
        self.tok = build(self.model)
        self.reference = None
        if verify:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.checked = self.differ = 0
        self.odd = np.zeros(0, bool)
        pieces = self.model["pieces"]
        self.bytes_of = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p.replace(MARK, " ").encode() for p, _, k in pieces]
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.table = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.table_at = np.cumsum(self.lengths) - self.lengths
        #: only an identity normaliser leaves segments independent
        self.segments = SegmentEncoder(self._encode, self.lengths, whole_runs=True, differs=self._differs) if not self.model["charsmap"] and not self.model["squeeze"] else None

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.int64) for e in found]

    def _differs(self, texts: list[str], ids: list[np.ndarray]) -> np.ndarray:
        """Which texts have other ids than the reference library's."""
        out = np.zeros(len(texts), bool)
        if self.reference is not None:
            # segments carry the blank that the library would add
            self.checked += len(texts)
            cut = int(self.model["dummy_prefix"])
            want = self.reference.encode([t[cut:] for t in texts], num_threads=2)
            out[:] = [not np.array_equal(a, np.array(b, np.int64)) for a, b in zip(ids, want)]
            self.differ += int(out.sum())
        return out

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the number for each; ``odd`` marks texts with a segment that differs from the library's."""
        if self.model["dummy_prefix"]:
            # a blank before each text that is not empty
            n = np.diff(off)
            lead = n > 0
            out = np.full(len(data) + int(lead.sum()), 32, np.uint8)
            keep = np.ones(len(out), bool)
            shift = np.cumsum(lead)
            keep[(off[:-1] + shift - 1)[lead]] = False
            out[keep] = data
            data, off = out, np.concatenate(([0], off[1:] + shift))
        if self.segments is not None:
            out = self.segments.texts(data, off)
            self.odd = self.segments.odd
            return out
        texts = [bytes(data[a:b]).decode() for a, b in zip(off[:-1], off[1:])]
        found = self._encode(texts)
        self.odd = self._differs(texts, found)
        return (np.concatenate(found).astype(np.uint32) if found else np.zeros(0, np.uint32)), np.array([len(x) for x in found], np.int64)

    def decode(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and their offsets: pieces joined, markers blanks, the dummy prefix off."""
        from .bytesops import ragged

        size = self.lengths[ids]
        data = self.table[ragged(self.table_at[ids], size)]
        ends = np.concatenate(([0], np.cumsum(size)))
        off = ends[np.concatenate(([0], np.cumsum(n)))]
        if self.model["dummy_prefix"]:
            full = np.diff(off) > 0
            lead = off[:-1][full]
            drop = lead[data[lead] == 32]
            keep = np.ones(len(data), bool)
            keep[drop] = False
            gone = np.concatenate(([0], np.cumsum(~keep)))
            data, off = data[keep], off - gone[off]
        return data, off


@functools.lru_cache(maxsize=2)
def codec(blob: bytes, verify: bool) -> Codec:
    return Codec(blob, verify)


def encoded(batches, text: str, names: list[str], blob: bytes, verify: bool):
    """The columns ``names`` of Arrow batches with ids, round trip and parity of the texts.

    A task has one core: the library's own threads would each keep their buffers as long as the worker lives.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    coder = codec(blob, verify)
    for b in (x for whole in batches for x in pieces(whole, text)):
        data, off = flat(b.column(text))
        ids, n = coder.encode(data, off)
        back, back_off = coder.decode(ids, n)
        if np.array_equal(back_off, off) and np.array_equal(back, data):
            same = np.ones(len(n), bool)
        else:
            same = np.array([bytes(back[a:c]) == bytes(data[d:e]) for a, c, d, e in zip(back_off[:-1], back_off[1:], off[:-1], off[1:])])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [*(b.column(x) for x in names), lists, pa.array(same), pa.array(~coder.odd)],
            names=[*names, "ids", "round_trip", "parity"],
        )


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", verify: bool = True) -> DataFrame:
    """Add ``ids`` array<int>, ``round_trip`` (decoding gives the text back) and ``parity``
    (every segment of the text has the reference library's ids).

    The model file travels in the task's closure, under 1 MB.
    """
    bound_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        blob = f.read()
    extra = "ids array<int>, round_trip boolean, parity boolean"
    from pyspark.sql.types import StructType, _parse_datatype_string

    docs, back = shield(docs, text)
    schema = StructType(list(docs.schema) + list(_parse_datatype_string(extra)))
    names = [x.name for x in schema[:-3]]

    def run(batches):
        yield from encoded(batches, text, names, blob, verify)

    return back(docs.mapInArrow(lean(run), schema))


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, model_file()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip", "parity")
