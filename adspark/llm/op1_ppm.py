"""Language-model scores by prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``order``, with the counts of what
follows each. A symbol (a byte, or the text's end) is predicted in its longest
known context; one not seen there escapes, with the probability that method D
gives to the number of different followers (half a count each), to the next shorter context,
where the symbols that the longer one offered are excluded. Below order 0 the
symbols left are equally likely. So probabilities of all texts sum to one.

Pretrained: the counts come from the training rows. Tasks count their n-grams,
buckets add the tasks' counts, and each order keeps the n-grams with at least
``floor`` occurrences, so the model grows with the input. As a node's suffix is
at least as frequent, the kept n-grams form a trie, and each context's
followers are among its suffix's: exclusion is a subtraction that is worked out
once per context, and scoring is table lookups over many positions at once.

The trie is never in one place. A bucket holds all contexts that end with the
same three symbols, whole; orders below three are small and are broadcast. Positions
travel packed to their context's bucket, and sums per document come back. The
longest n-grams with at least total / 2**23 occurrences are broadcast with
their final probabilities, which spares their positions the way and changes no
score.

Adaptive: a text is scored by a trie that learns from the text itself as it
goes (``AdaptivePPM``).

Beside the model's score stands a unigram baseline. Word counts are joined
without a word's text or a hot key: words with at least total / 2**18
occurrences (2**18 at most) are broadcast, other words' places travel packed to
their bucket, so none has more than a bounded share of the places.

Null text: empty, one end. Null id: hashed as the empty text, kept null.
Repeated rows: each is counted and scored. Empty table: no rows. Very long
texts are whole. Without training rows every symbol has probability 1/256.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import LOWER, counted, flat, hash_spans, lookup, mix, runs_of_words, spaced, uniques
from .common import bound_batches, buckets_for, crc_mod, lean, materialize

U64 = np.uint64
ORDER = 7
#: A byte that no UTF-8 text holds ends a text and stands before it.
END = 0xFF
SYMBOLS = 256
#: Contexts that end with the same symbols, so many, share a bucket.
JOINT = 3
#: Of n-grams with at least one in so many occurrences, tasks know the probability beforehand.
CACHE = 1 << 23
#: Rarer n-grams tell less about a context than its suffix does.
FLOOR = 4
HEAVY = 1 << 18
END_WORD = U64(0x1D0E5EED)
HOLD = 3 << 20
#: Positions that a task holds before it hands them on.
SEND = 4 << 20


# -- the two token streams -----------------------------------------------------


def gram_codes(data: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (8 bits a symbol) of all positions' last order + 1 symbols, and each text's first position."""
    n = np.diff(off)
    docs = len(n)
    gap = max(order, 1)
    total = len(data) + gap * (docs + 1)
    begin = gap + off[:-1] - off[0] + gap * np.arange(docs)
    edge = np.zeros(total + 1, np.int8)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + n, -1)
    at = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    # the eight symbols up to each position are a word of their own
    sym = np.full(7 + total, END, np.uint8)
    sym[7:][at] = data
    at[begin + n] = True  # the end after each text
    code = np.ndarray((total,), ">u8", buffer=sym, strides=(1,))[at].astype(U64)
    if order < 7:
        code &= U64((1 << (8 * (order + 1))) - 1)
    return code, np.cumsum(n + 1) - (n + 1)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and each text's first word."""
    buf, begin = spaced(data, off)
    buf = LOWER[buf]
    start, end = runs_of_words(buf)
    return hash_spans(buf, start, end), np.searchsorted(start, begin)


# -- model ---------------------------------------------------------------------


class Model:
    """A trie as sorted n-gram codes per order, with the log10 terms of every path through it."""

    PARTS = ("codes", "count", "n", "ctx", "own_d", "own_esc", "sub_d", "sub_esc", "suffix", "size", "total", "other")

    def __init__(self, grams: list[tuple[np.ndarray, ...]], base: Model | None = None):
        """``grams``: codes and counts per order, and contexts with all their occurrences where these are known; orders above ``base``'s."""
        for x in self.PARTS:
            setattr(self, x, list(getattr(base, x)) if base else [])
        low = len(self.codes)
        self.order = low + len(grams) - 1
        f4 = np.float32
        size, total, other = self.size, self.total, self.other
        self.tables: dict = dict(base.tables) if base else {}
        if base:
            self.left, self.best = base.left, base.best
        if not grams:
            return
        log = lambda x: np.log10(np.maximum(x, 1e-300))
        for k, (codes, n, *whole) in enumerate(grams, low):
            ctx, owner = np.unique(codes >> U64(8), return_inverse=True)
            q = np.bincount(owner, minlength=len(ctx)).astype(float)
            t = np.bincount(owner, n, minlength=len(ctx))
            # occurrences of the context whose follower is not kept go to the escape
            seen = t
            if whole and len(ctx):
                seen = whole[1][lookup(whole[0], ctx)[0]]
            elif k and len(ctx):
                at, have = lookup(self.codes[k - 1], ctx)
                seen = np.where(have, self.n[k - 1][at], t) if len(self.n[k - 1]) else t
            lost = np.maximum(seen - t, 0)
            self.codes.append(codes)
            self.n.append(n)
            self.count.append(np.log10(n - 0.5).astype(f4))
            self.ctx.append(ctx)
            self.own_d.append(log(t + lost).astype(f4))
            self.own_esc.append((log(q / 2 + lost) - log(t + lost)).astype(f4))
            if k:
                # a context's suffix, less the symbols that the context itself offers
                suffix, _ = lookup(self.ctx[k - 1], ctx & U64((1 << (8 * (k - 1))) - 1))
                below, _ = lookup(self.codes[k - 1], codes & U64((1 << (8 * k)) - 1))
                x = np.bincount(owner, self.n[k - 1][below], minlength=len(ctx))
                left = size[k - 1][suffix] - q
                d = total[k - 1][suffix] - x + other[k - 1][suffix]
                e = left / 2 + other[k - 1][suffix]
                self.suffix.append(suffix.astype(np.int32))
                self.sub_d.append(log(d).astype(f4))
                self.sub_esc.append(np.where(e > 0, log(e) - log(d), 0.0).astype(f4))
            else:
                self.suffix.append(None)
                self.sub_d.append(None)
                self.sub_esc.append(None)
            size.append(q)
            total.append(t)
            other.append(lost)
        self.left = SYMBOLS - (int(size[0][0]) if len(size[0]) else 0)
        self.best = self.count[-1] - self.own_d[-1][owner] if len(owner) else self.count[-1]

    def __getstate__(self):
        return self.__dict__ | {"tables": {}}

    def _find(self, what: str, k: int, keys: np.ndarray) -> np.ndarray:
        """The place of each key among an order's n-grams or contexts, or -1: an open-addressed table."""
        known = (self.codes if what == "codes" else self.ctx)[k]
        if len(known) and len(keys) and (what, k) not in self.tables:
            self.tables[what, k] = _open_table(known)
        return _probe(known, self.tables.get((what, k)), keys)

    def log10(self, code: np.ndarray, block: int = 1 << 18) -> np.ndarray:
        """log10 probability of each position's symbol in its context."""
        parts = [self._log10(code[i : i + block]) for i in range(0, len(code), block)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _log10(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros(len(code))
        at = self._find("codes", self.order, code)
        hit = at >= 0
        out[hit] = self.best[at[hit]]
        i = np.flatnonzero(~hit)  # positions whose symbol has not been found
        above = np.full(len(i), -1, np.int32)  # their known context one order up, or -1
        for k in range(self.order, -1, -1):
            if not len(i):
                break
            c = code[i] & U64((1 << (8 * (k + 1))) - 1)
            at = self._find("codes", k, c) if k < self.order else np.full(len(i), -1, np.int32)
            ctx = np.empty(len(i), np.int32)
            up = above >= 0
            if up.any():
                ctx[up] = self.suffix[k + 1][above[up]]
            ctx[~up] = self._find("ctx", k, c[~up] >> U64(8))
            known, have = ctx >= 0, at >= 0
            for rows, own, sub, sign in ((have, self.own_d, self.sub_d, -1), (known & ~have, self.own_esc, self.sub_esc, 1)):
                first, later = rows & ~up, rows & up
                out[i[first]] += sign * own[k][ctx[first]]
                if later.any():
                    out[i[later]] += sign * sub[k + 1][above[later]]
            out[i[have]] += self.count[k][at[have]]
            i, above = i[~have], ctx[~have]
        out[i] -= np.log10(max(self.left, 1))
        return out


def _open_table(known: np.ndarray) -> tuple[np.ndarray, int]:
    bits = max(4, int(2 * len(known)).bit_length())
    table = np.full(1 << bits, -1, np.int32)
    slot = (mix(known) >> U64(64 - bits)).astype(np.int32)
    left = np.arange(len(known), dtype=np.int32)
    while len(left):
        free = left[table[slot[left]] < 0]
        table[slot[free]] = free
        left = left[table[slot[left]] != left]
        slot[left] = (slot[left] + 1) & np.int32((1 << bits) - 1)
    return table, bits


def _probe(known: np.ndarray, opened: tuple[np.ndarray, int] | None, keys: np.ndarray) -> np.ndarray:
    out = np.full(len(keys), -1, np.int32)
    if not len(known) or not len(keys):
        return out
    table, bits = opened
    live, slot = None, (mix(keys) >> U64(64 - bits)).astype(np.int32)
    while live is None or len(live):
        found = table[slot]
        hit = (found >= 0) & (known[found] == (keys if live is None else keys[live]))
        more = np.flatnonzero(~hit & (found >= 0))
        if live is None:
            np.copyto(out, found, where=hit)
            live = more
        else:
            out[live[hit]] = found[hit]
            live = live[more]
        slot = (slot[more] + 1) & np.int32((1 << bits) - 1)
    return out


class Cache:
    """Final log10 probabilities of frequent n-grams of the full order."""

    def __init__(self, codes: np.ndarray, best: np.ndarray):
        self.codes, self.best, self.table = codes, best, None

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def log10(self, code: np.ndarray, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """Each position's log10 probability, 0 where it is not known, and the positions where it is not."""
        if self.table is None and len(self.codes):
            self.table = _open_table(self.codes)
        out, miss = np.zeros(len(code)), []
        for i in range(0, len(code), block):
            at = _probe(self.codes, self.table, code[i : i + block])
            hit = at >= 0
            out[i : i + block][hit] = self.best[at[hit]]
            miss.append(np.flatnonzero(~hit) + i)
        return out, np.concatenate(miss) if miss else np.zeros(0, np.int64)


class AdaptivePPM:
    """A context trie that learns a text while it codes it."""

    def __init__(self, order: int = 3):
        self.order = order
        self.trie: dict[bytes, dict[int, int]] = {}

    def log10(self, text: bytes) -> float:
        import math

        total = 0.0
        for i, s in enumerate([*text, END]):
            gone: set[int] = set()
            contexts = [bytes(text[max(i - k, 0) : i]) for k in range(min(self.order, i), -1, -1)]
            for c in contexts:
                node = self.trie.get(c)
                if node is None:
                    continue
                live = {x: n for x, n in node.items() if x not in gone}
                if not live:
                    continue
                d = 2 * sum(live.values())
                if s in live:
                    total += math.log10((2 * live[s] - 1) / d)
                    break
                total += math.log10(len(live) / d)
                gone |= live.keys()
            else:
                total -= math.log10(SYMBOLS - len(gone))
            for c in contexts:
                node = self.trie.setdefault(c, {})
                node[s] = node.get(s, 0) + 1
        return total


# -- counting ------------------------------------------------------------------


class Tally:
    """Counts of 64-bit keys. Parts are merged as they come; a task that still holds more than HOLD hands them on."""

    def __init__(self):
        self.keys, self.n, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> bool:
        """Whether it is time to hand on."""
        k, n = uniques(keys)
        self.keys.append(k)
        self.n.append(n)
        self.held += len(k)
        if self.held > HOLD:
            k, n = self.take()
            self.keys, self.n, self.held = [k], [n], len(k)
        return self.held > HOLD * 3 // 4

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        out = counted(np.concatenate(self.keys), np.concatenate(self.n)) if len(self.keys) > 1 else (self.keys[0], self.n[0])
        self.__init__()
        return out


def _squeeze(b: bytes) -> bytes:
    return len(b).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(b, asbytes=True)


def _swell(b: bytes) -> bytes:
    return pa.Codec("zstd").decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending words: how many leading bytes each shares with the one before, and its others."""
    rows = values.astype(">u8").view(np.uint8).reshape(-1, 8)
    new = np.ones(rows.shape, bool)
    new[1:] = rows[1:] != rows[:-1]
    shared = np.where(new.any(axis=1), new.argmax(axis=1), 8).astype(np.uint8)
    return _squeeze(shared.tobytes()), _squeeze(rows[np.arange(8)[None] >= shared[:, None]].tobytes())


def unpack(parts: tuple[bytes, bytes]) -> np.ndarray:
    shared = np.frombuffer(_swell(parts[0]), np.uint8)
    keep = np.arange(8)[None] >= shared[:, None]
    rows = np.zeros(keep.shape, np.uint8)
    rows[keep] = np.frombuffer(_swell(parts[1]), np.uint8)
    for i in range(7):
        # a shared byte is the last one that was written in its column
        rows[:, i] = rows[np.maximum.accumulate(np.where(keep[:, i], np.arange(len(rows)), 0)), i]
    return rows.view(">u8").ravel().astype(U64)


def pack_small(values: np.ndarray) -> bytes:
    """Whole numbers, mostly under 255; larger ones stand behind."""
    low = np.minimum(values, 255).astype(np.uint8)
    return len(low).to_bytes(8, "little") + _squeeze(low.tobytes() + values[values >= 255].astype(np.int64).tobytes())


def unpack_small(b: bytes) -> np.ndarray:
    n, own = int.from_bytes(b[:8], "little"), _swell(b[8:])
    out = np.frombuffer(own[:n], np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(own[n:], np.int64)
    return out


def pack_places(values: np.ndarray) -> bytes:
    """Places under 2**32, byte by byte, of which the higher ones are mostly zeros."""
    return _squeeze(values.astype(np.uint32).view(np.uint8).reshape(len(values), 4).T.tobytes())


def unpack_places(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_swell(b), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


WORDS, GRAMS = 0, 1


def _bucket(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    # n-grams whose contexts end alike meet, so contexts of JOINT symbols and more are whole in a bucket
    return (mix((keys >> U64(8)) & U64((1 << (8 * JOINT)) - 1)) if kind == GRAMS else mix(keys)) % U64(buckets)


def corpus_counts(train: DataFrame, order: int, buckets: int) -> DataFrame:
    """(kind, bucket, n, total, keys, counts): all words and n-grams of the texts."""

    def count(batches):
        tallies = (Tally(), Tally())

        def flush():
            rows = []
            for kind, t in enumerate(tallies):
                keys, n = t.take()
                b = _bucket(kind, keys, buckets)
                at = np.argsort(b, kind="stable")
                edge = np.searchsorted(b[at], np.arange(buckets + 1, dtype=np.uint64))
                for j in np.flatnonzero(np.diff(edge)):
                    own = at[edge[j] : edge[j + 1]]
                    rows.append((kind, int(j), *pack(keys[own]), pack_small(n[own])))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (2, 3, 4))],
                names=["kind", "bucket", "shared", "keys", "counts"],
            )

        for b in batches:
            data, off = flat(b.column("text"))
            docs = len(off) - 1
            w, _ = word_hashes(data, off)
            full = tallies[WORDS].add(np.concatenate((w, np.full(docs, END_WORD))))
            full |= tallies[GRAMS].add(gram_codes(data, off, order)[0])
            if full:
                yield flush()
        if tallies[0].held:
            yield flush()

    def add(t: pa.Table) -> pa.Table:
        keys, n = counted(*(np.concatenate(x) for x in zip(*(read_counts(*r) for r in counts_of(t)))))
        shared, rest = pack(keys)
        return pa.table({
            "kind": t.column("kind").slice(0, 1), "bucket": t.column("bucket").slice(0, 1), "n": pa.array([len(keys)]), "total": pa.array([int(n.sum())]),
            "shared": pa.array([shared], pa.binary()), "keys": pa.array([rest], pa.binary()), "counts": pa.array([pack_small(n)], pa.binary()),
        })

    parts = train.select("text").mapInArrow(lean(count), "kind int, bucket int, shared binary, keys binary, counts binary")
    return materialize(parts.groupBy("kind", "bucket").applyInArrow(lean(add), "kind int, bucket int, n long, total long, shared binary, keys binary, counts binary"), "counts")


def counts_of(t) -> list[tuple[bytes, bytes, bytes]]:
    return list(zip(*(t.column(x).to_pylist() for x in ("shared", "keys", "counts"))))


def read_counts(shared: bytes, keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return unpack((shared, keys)), unpack_small(counts)


def kept(codes: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams with ``least`` occurrences, and all contexts with all their occurrences."""
    c = codes >> U64(8)
    new = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1]))) if len(c) else np.zeros(0, np.int64)
    ok = n >= least
    return codes[ok], n[ok], c[new], np.add.reduceat(n, new) if len(c) else n


def upper(keys: np.ndarray, n: np.ndarray, order: int, floor: int) -> tuple[list, np.ndarray, np.ndarray]:
    """A bucket's kept n-grams of the orders from JOINT, and all n-grams of the order below."""
    out = []
    for k in range(order, JOINT - 1, -1):
        out.append(kept(keys, n, floor))
        keys, n = counted(keys & U64((1 << (8 * k)) - 1), n)
    return out[::-1], keys, n


def fit(counts: DataFrame, order: int, floor: int = FLOOR) -> tuple[Model, Cache]:
    """The model of the orders below JOINT, and the cache."""
    total = counts.where(F.col("kind") == GRAMS).agg(F.sum("total")).first()[0] or 0
    often = max(floor, -(-total // CACHE))
    top = min(order, JOINT - 1)

    def split(batches):
        for b in batches:
            for row in counts_of(b):
                orders, codes, n = upper(*read_counts(*row), order, floor)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(codes), bool)), pa.array(codes.view(np.int64)), pa.array(n), pa.nulls(len(codes), pa.float32())], names=["top", "code", "n", "best"])
                if orders:
                    codes, n, *_ = orders[-1]
                    ok = n >= often
                    best = Model([orders[-1]]).best[ok]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(best), bool)), pa.array(codes[ok].view(np.int64)), pa.array(n[ok]), pa.array(best, pa.float32())], names=["top", "code", "n", "best"])

    rows = materialize(counts.where(F.col("kind") == GRAMS).select("shared", "keys", "counts").mapInArrow(lean(split), "top boolean, code long, n long, best float"), "grams")
    low = rows.where("NOT top").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    keys, n = counted(low.column("code").to_numpy().view(U64), low.column("n").to_numpy())
    grams = []
    for k in range(top, -1, -1):
        # orders 0 and 1 are small and stay whole
        grams.append(kept(keys, n, floor if k > 1 else 1))
        keys, n = counted(keys & U64((1 << (8 * k)) - 1), n)
    heavy = rows.where("top").select("code", "best").toArrow()
    codes = heavy.column("code").to_numpy().view(U64)
    at = np.argsort(codes)
    return Model(grams[::-1]), Cache(codes[at], heavy.column("best").to_numpy()[at])


# -- scoring -------------------------------------------------------------------


def score_documents(docs: DataFrame, order: int = ORDER, train: str = "train", floor: int = FLOOR) -> DataFrame:
    """``docs`` (doc_id, text, and a boolean column that marks training rows): scores of every row."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col(train).alias("train"))
    buckets = buckets_for(docs)
    counts = corpus_counts(docs.where("train"), order, buckets)
    words = counts.where(F.col("kind") == WORDS)
    total, distinct = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    model, known_grams = (spark.sparkContext.broadcast(x) for x in fit(counts, order, floor))

    def often(batches):
        for b in batches:
            for row in counts_of(b):
                keys, n = read_counts(*row)
                keys = keys.view(np.int64)
                ok = n * HEAVY > total
                yield pa.RecordBatch.from_arrays([pa.array(keys[ok]), pa.array(n[ok])], names=["word", "n"])

    top = words.select("shared", "keys", "counts").mapInArrow(often, "word long, n long").toArrow()
    hw, hn = top.column("word").to_numpy().view(U64), top.column("n").to_numpy()
    by = np.argsort(hw)
    heavy = spark.sparkContext.broadcast((hw[by], np.log10(hn[by] + 1.0)))
    unit = float(np.log10(total + distinct + 1.0))

    def score(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        hw, hl = heavy.value
        held: tuple[list, list] = ([], [])  # (keys, documents of the chunk) of words and of positions
        own: list[pa.RecordBatch] = []
        count = size = 0

        def flush():
            """The chunk's documents, and a row per kind and bucket: its distinct keys, how often each comes, and the documents in the keys' order."""
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own[0].schema) as w:
                for b in own:
                    w.write_batch(b)
            rows = [(0, chunk % buckets, sink.getvalue().to_pybytes(), None, None, None)]
            for kind, parts in enumerate(held):
                keys, who = (np.concatenate(x) for x in zip(*parts))
                by = np.argsort(keys)
                keys, who = keys[by], who[by]
                by = np.argsort(_bucket(kind, keys, buckets).astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")
                keys, who = keys[by], who[by]
                new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
                keys, runs = keys[new], np.diff(np.append(new, len(keys)))
                edge = np.searchsorted(_bucket(kind, keys, buckets), np.arange(buckets + 1, dtype=np.uint64))
                ends = np.append(new, len(who))
                for j in np.flatnonzero(np.diff(edge)):
                    x, y = edge[j], edge[j + 1]
                    rows.append((kind + 1, int(j), *pack(keys[x:y]), pack_small(runs[x:y]), pack_places(who[ends[x] : ends[y]])))
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
            cols = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays([*cols[:2], pa.array(np.full(len(rows), chunk)), *cols[2:]], names=["kind", "bucket", "chunk", "shared", "keys", "runs", "at"])

        for b in batches:
            data, off = flat(b.column("text"))
            docs = len(off) - 1
            if not docs:
                continue
            code, first = gram_codes(data, off, order)
            p, miss = known_grams.value.log10(code)
            p = np.add.reduceat(p, first)
            held[GRAMS].append((code[miss], (np.searchsorted(first, miss, side="right") - 1 + count).astype(np.uint32)))
            del code
            w, at = word_hashes(data, off)
            owner = np.repeat(np.arange(docs), np.diff(at))
            n_tokens = np.diff(at) + 1
            place, have = lookup(hw, np.concatenate((w, np.full(docs, END_WORD))))
            owner2 = np.concatenate((owner, np.arange(docs)))
            known = np.bincount(owner2[have], minlength=docs)
            s = np.bincount(owner2[have], hl[place[have]], minlength=docs) - n_tokens * unit
            own.append(pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("train"), pa.array(n_tokens), pa.array(known), pa.array(s), pa.array(p)], names=OWN))
            rare = np.flatnonzero(~have)
            held[WORDS].append((np.concatenate((w, np.full(docs, END_WORD)))[rare], (owner2[rare] + count).astype(np.uint32)))
            count += docs
            size += len(miss)
            if size > SEND:
                yield flush()
                held, own, count, size, chunk = ([], []), [], 0, 0, chunk + 1
        if count:
            yield flush()

    OWN = ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        lean(score), "kind int, bucket int, chunk long, shared binary, keys binary, runs binary, at binary"
    )

    def rest(left: pa.Table, right: pa.Table) -> pa.Table:
        """A row per chunk that has words or positions in the bucket: where they are known, and sums of logs. A chunk's documents pass."""
        chunk, at, logs, kind = [], [], [], 0
        if right.num_rows:
            kind = right.column("kind")[0].as_py()
            none = np.zeros(0, U64), np.zeros(0, np.int64)
            table, n = read_counts(*counts_of(left)[0]) if left.num_rows else none
            trie = Model(upper(table, n, order, floor)[0], model.value) if kind == GRAMS + 1 else None
            for c, *w, r, p in zip(*(right.column(c).to_pylist() for c in ("chunk", "shared", "keys", "runs", "at"))):
                chunk.append(c)
                if kind == 0:
                    at.append(w[0])
                    logs.append(b"")
                    continue
                w, r, p = unpack(w), unpack_small(r), unpack_places(p)
                if kind == GRAMS + 1:
                    have, log = np.ones(len(w), bool), trie.log10(w)
                else:
                    i, have = lookup(table, w)
                    log = np.where(have, np.log10(n[i] + 1.0), 0.0) if len(n) else np.zeros(len(w))
                some = np.repeat(have, r)
                who, idx = np.unique(p[some], return_inverse=True)
                at.append(np.stack((who.astype(np.int64), np.bincount(idx, minlength=len(who)))).tobytes())
                logs.append(np.bincount(idx, np.repeat(log, r)[some], minlength=len(who)).astype(float).tobytes())
        return pa.table({"kind2": pa.array([kind] * len(chunk), pa.int32()), "chunk2": pa.array(chunk, pa.int64()), "at": pa.array(at, pa.binary()), "logs": pa.array(logs, pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        """A chunk's documents, with what its buckets' rows add."""
        kinds, at, logs = (t.column(x).to_pylist() for x in ("kind2", "at", "logs"))
        out = pa.ipc.open_stream(at[kinds.index(0)]).read_all()
        sums = []
        for kind in (WORDS, GRAMS):
            own = [i for i, k in enumerate(kinds) if k == kind + 1]
            who, n = np.concatenate([np.frombuffer(at[i], np.int64).reshape(2, -1) for i in own] or [np.zeros((2, 0), np.int64)], axis=1)
            log = np.concatenate([np.frombuffer(logs[i]) for i in own] or [np.zeros(0)])
            sums.append((np.bincount(who, n, minlength=out.num_rows).astype(np.int64), np.bincount(who, log, minlength=out.num_rows)))
        more = {"n_known": sums[WORDS][0], "base_score": sums[WORDS][1], "score": sums[GRAMS][1]}
        return pa.table({c: pa.array(out.column(c).to_numpy() + more[c]) if c in more else out.column(c) for c in OWN})

    known = counts.withColumn("kind", F.col("kind") + 1).select("kind", "bucket", "shared", "keys", "counts")
    scored = (
        known.groupBy("kind", "bucket").cogroup(sent.groupBy("kind", "bucket")).applyInArrow(lean(rest), "kind2 int, chunk2 long, at binary, logs binary")
        .groupBy("chunk2").applyInArrow(lean(add), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    )
    return scored.select(F.col("doc_id").cast(kind), "train", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def score_adaptive(docs: DataFrame, order: int = 3) -> DataFrame:
    """(doc_id, score): each text's own adaptive code length as a log10 probability."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            s = [AdaptivePPM(order).log10((t or "").encode()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op1_ppm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (crc_mod(F.col("doc_id"), 7) != 2).alias("train"))
    return score_documents(docs).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
