"""Binary token-id shards with a minimal perfect hash index.

A shard record holds the ids of consecutive documents as raw little-endian
words (16 bits where the vocabulary fits, else 32) and an index over its
document keys: seeds of a minimal perfect hash, and at the slot that a key
hashes to its fingerprint, first word and word count. A reader finds a key
with two hashes, one fingerprint compare and one slice, whatever the shard's
size; a key that is not there fails the compare.

The hash is built by displacement: keys fall into small buckets, and each
bucket, largest first, takes the first seed that sends its keys to free slots.

Shards are rows of Parquet files, which any store that Spark writes to holds;
a shard is cut at ``shard_words``, or holds one longer document. A catalogue
row per shard says which doc_ids and which global id offsets it has.

Null text: empty, one end id. Null id: the least long, before all others.
Repeated ids: each row is stored; a key lookup gives the first. Empty table:
no shards. Very long texts are whole. Extra columns are not stored.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesops import flat, mix, ragged
from .common import NULL_ID, bound_batches, buckets_for, lean, materialize
from .segments import SegmentEncoder

U64 = np.uint64
FULL = U64(0xFFFFFFFFFFFFFFFF)
SCHEMA = "part int, number int, first_id long, last_id long, docs long, words long, width int, payload binary, seeds binary, prints binary, starts binary, sizes binary, ids binary"


# -- minimal perfect hash ------------------------------------------------------


def _hash(keys: np.ndarray, seed) -> np.ndarray:
    return mix(keys ^ mix(np.atleast_1d(np.asarray(seed, U64)) * U64(0x9E3779B97F4A7C15) + U64(1)))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (_hash(keys, 1 << 40) % U64(buckets)).astype(np.int64)


def mph_build(keys: np.ndarray) -> np.ndarray:
    """Seeds (uint32, one per bucket) of a bijection from distinct uint64 keys to 0..n-1."""
    n = len(keys)
    buckets = max(1, -(-n // 3))
    seeds = np.zeros(buckets, np.uint32)
    if n < 2:
        return seeds
    bucket = _bucket(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket, minlength=buckets)
    begin = np.cumsum(size) - size
    taken = np.zeros(n, bool)
    tries = np.arange(256, dtype=np.uint64)[:, None]
    for b in np.argsort(-size, kind="stable"):
        if not size[b]:
            break
        own = keys[order[begin[b] : begin[b] + size[b]]]
        seed = 0
        while True:
            slots = (_hash(own[None, :], tries + U64(seed)) % U64(n)).astype(np.int64)
            free = ~taken[slots].any(axis=1)
            if len(own) > 1 and free.any():
                s = np.sort(slots[free], axis=1)
                free[np.flatnonzero(free)] = (s[:, 1:] != s[:, :-1]).all(axis=1)
            good = np.flatnonzero(free)
            if len(good):
                seeds[b] = seed + good[0]
                taken[slots[good[0]]] = True
                break
            seed += len(tries)
            if seed >= 1 << 32:
                raise ValueError("keys are not distinct")
    return seeds


def mph_slots(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The slot of each key; for a key outside the set, any slot."""
    return (_hash(keys, seeds[_bucket(keys, len(seeds))].astype(U64)) % U64(max(n, 1))).astype(np.int64)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1 << 41) >> U64(32)).astype(np.uint32)


class Shard:
    """Keyed access to one shard record."""

    def __init__(self, row: dict):
        self.words = np.frombuffer(row["payload"], f"<u{row['width']}")
        self.seeds, self.prints = np.frombuffer(row["seeds"], "<u4"), np.frombuffer(row["prints"], "<u4")
        self.starts, self.sizes = np.frombuffer(row["starts"], "<u8"), np.frombuffer(row["sizes"], "<u8")
        self.ids = np.frombuffer(row["ids"], "<i8")

    def find(self, doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, first word, word count) of each key, in constant time."""
        keys = np.ascontiguousarray(doc_ids, np.int64).view(U64)
        if not len(self.prints):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot = mph_slots(keys, self.seeds, len(self.prints))
        return self.prints[slot] == fingerprint(keys), self.starts[slot].astype(np.int64), self.sizes[slot].astype(np.int64)

    def get(self, doc_id: int) -> np.ndarray | None:
        found, start, size = self.find(np.array([doc_id]))
        return self.words[start[0] : start[0] + size[0]].astype(np.uint32) if found[0] else None


def pack(part: int, number: int, ids: np.ndarray, words: np.ndarray, sizes: np.ndarray, width: int) -> dict:
    """One shard record of documents in their order."""
    starts = np.cumsum(sizes) - sizes
    own, first = np.unique(ids, return_index=True)
    keys = own.astype(np.int64).view(U64)
    seeds = mph_build(keys)
    slot = mph_slots(keys, seeds, len(keys))
    put = lambda values, kind: (out := np.zeros(len(keys), kind), out.__setitem__(slot, values))[0].tobytes()
    return {
        "part": part, "number": number, "first_id": int(ids[0]), "last_id": int(ids[-1]), "docs": len(ids), "words": len(words), "width": width,
        "payload": words.astype(f"<u{width}").tobytes(), "seeds": seeds.astype("<u4").tobytes(), "prints": put(fingerprint(keys), "<u4"),
        "starts": put(starts[first], "<u8"), "sizes": put(sizes[first], "<u8"), "ids": np.stack((ids, sizes)).astype("<i8").tobytes(),
    }


# -- tokenizer -----------------------------------------------------------------


def _byte_lengths(tok) -> np.ndarray:
    """Bytes per id of a byte-level vocabulary, whose every character stands for one byte."""
    vocab = tok.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for piece, i in vocab.items():
        out[i] = len(piece)
    return out


@functools.lru_cache(maxsize=2)
def encoder(blob: str) -> SegmentEncoder:
    """The library's plain encoding; it looks for added tokens only in texts that hold one's string, where alone it matters."""
    from tokenizers import Tokenizer

    plain, fast = Tokenizer.from_str(blob), Tokenizer.from_str(blob)
    fast.encode_special_tokens = True
    added = [t.content for t in plain.get_added_tokens_decoder().values()]

    def encode(texts: list[str]) -> list[np.ndarray]:
        odd = [any(a in t for a in added) for t in texts]
        out = [np.array(e.ids, np.int64) for e in fast.encode_batch_fast(texts, add_special_tokens=False)]
        for i in np.flatnonzero(odd):
            out[i] = np.array(plain.encode(texts[i], add_special_tokens=False).ids, np.int64)
        return out

    return SegmentEncoder(encode, _byte_lengths(plain), keep=1 << 19)


# -- operator ------------------------------------------------------------------


def write_store(docs: DataFrame, tokenizer_json: str, end_id: int, shard_words: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Tokenise ``docs`` (doc_id, text) into shard records in ascending id order.

    Returns the written shards and a catalogue with each shard's global offset.
    Rows meet by range of id, so a part is a bounded run of ids; offsets need
    only one total per part.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer_json, encoding="utf-8") as f:
        blob = f.read()
    import json

    width = 2 if max(json.loads(blob)["model"]["vocab"].values(), default=0) < 1 << 16 else 4
    schema = pa.schema([
        ("part", pa.int32()), ("number", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("docs", pa.int64()), ("words", pa.int64()),
        ("width", pa.int32()), *((x, pa.binary()) for x in ("payload", "seeds", "prints", "starts", "sizes", "ids")),
    ])

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        coder = encoder(blob)
        held: list[tuple] = []
        words = 0

        def flush():
            nonlocal held, words, number
            row = pack(part, number, np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]), width)
            held, words, number = [], 0, number + 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            data, off = flat(b.column("text"))
            ids, n = coder.texts(data, off)
            size = n + 1
            out = np.full(len(ids) + len(n), end_id, np.uint32)
            keep = np.ones(len(out), bool)
            keep[np.cumsum(size) - 1] = False
            out[keep] = ids
            doc = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            # a cut where the running total passes a multiple of the shard's size
            upto = words + np.cumsum(size)
            cut = np.concatenate(([0], np.flatnonzero(upto[:-1] // shard_words != upto[1:] // shard_words) + 1, [len(doc)]))
            ends = np.concatenate(([0], np.cumsum(size)))
            for a, c in zip(cut[:-1], cut[1:]):
                if held and words + (ends[c] - ends[a]) > shard_words:
                    yield flush()
                held.append((doc[a:c], out[ends[a] : ends[c]], size[a:c]))
                words += int(ends[c] - ends[a])
        if held:
            yield flush()

    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = buckets_for(docs, 16 << 20)
    ordered = slim.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    shards = materialize(ordered.mapInArrow(lean(run), SCHEMA), "shards")
    meta = shards.select("part", "number", "first_id", "last_id", "docs", "words")
    # parts are as many as tasks; shards of a part are numbered, so no window spans more than these
    totals = meta.groupBy("part").agg(F.sum("words").alias("w"))
    before = totals.select(F.col("part").alias("p"), (F.sum("w").over(Window.orderBy("part")) - F.col("w")).alias("base"))
    own = Window.partitionBy("part").orderBy("number")
    catalogue = meta.join(before, F.col("part") == F.col("p")).withColumn("start", F.col("base") + F.sum("words").over(own) - F.col("words")).drop("p", "base")
    return shards, catalogue


#: Shards whose offsets are broadcast, at 16 bytes each; beyond it the payloads are shuffled to theirs.
SMALL_CATALOGUE = 1 << 20


def small_catalogue(shards: DataFrame) -> bool:
    """Whether there are few enough shards; the count reads Parquet footers only."""
    return shards.count() <= SMALL_CATALOGUE


def read_store(shards: DataFrame, catalogue: DataFrame) -> DataFrame:
    """One row per stored document, each read through the shard's index: doc_id, start, n_tokens, ids_crc32, keyed.

    ``keyed`` says that the index gave the document's own words for its key.
    """
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("keyed", pa.bool_())])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(row)
                ids, sizes = shard.ids.reshape(2, -1)
                found, at, n = shard.find(ids)
                place = np.cumsum(sizes) - sizes
                first = np.concatenate(([True], ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, bool)
                keyed = found & ((at == place) & (n == sizes) | ~first)
                at, n = np.where(first, at, place), np.where(first, n, sizes)
                wide = shard.words.astype("<u4")
                crc = [zlib.crc32(wide[a : a + k]) for a, k in zip(at.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64(), mask=ids == NULL_ID), pa.array(row["start"] + at), pa.array(n), pa.array(crc, pa.int64()), pa.array(keyed)
                ], schema=out)

    where = catalogue.select(F.col("part").alias("p"), F.col("number").alias("k"), "start")
    if small_catalogue(shards):
        where = F.broadcast(where)
    joined = shards.join(where, (F.col("part") == F.col("p")) & (F.col("number") == F.col("k"))).drop("p", "k")
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, keyed boolean")


def op10_tokenstore(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_store(*write_store(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))
