"""Removal of repeated byte strings by suffix sorting of anchored contexts.

A string of ``length`` bytes counts as repeated when it also starts anywhere
else in the table. Every such window picks an anchor, the least hash among its
``gram``-byte substrings, so equal windows have equal anchors at equal offsets,
and a document's windows fall into runs that share an anchor. Runs whose gram
occurs once in the table hold no repeat. Runs of one gram with the same bytes
throughout (by hash) are one class, whose windows are repeated where it has two
members; those that meet in one batch are settled there, and one of them goes on. What is left, classes that are alone beside others of their gram, is
settled exactly: the bytes left and right of the anchor become
sequences of wide symbols, and a suffix array of each side (grouping by Lyndon
prefixes, ``suffix_array``) puts them in order. Neighbours' common prefixes say
for every depth which classes agree so far, and a window is repeated when
another one agrees with it on both sides of the anchor.

An anchor with more than ``HOT`` classes would be a large sort in one task. Its
gram is lengthened first: the offsets of its windows are cut into blocks, and
all windows of a block hold the same bytes around the anchor, which with the
block are the new gram. Classes and their number are found anew for each, so a
block that is repeated throughout, or alone, needs no more work; a block that
is still crowded is cut into single windows, where the gram is the whole window
and each gram one class.

A 4 MB Bloom filter of the documents concerned spares shuffling other texts.
Equality of runs and grams rests on 64-bit hashes (a run's on two together).

A text is a sequence of bytes or, for passages of so many words, of its words'
64-bit hashes (words as they are written, whatever blanks part them); all of
the above holds for both.

Null or short text: nothing removed. Empty text: hash of no bytes. Repeated
rows: each one's windows occur in the other, so all of their bytes go where
they are long enough. Very long texts are read in overlapping segments. Columns
of the input named ``n_bytes``, ``removed``, ``kept`` or, with passages,
``passages`` or ``rest`` give way to the result's; others are carried, whatever
their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import flat, hash_spans, mix, ragged, runs_of_words, spaced
from .common import bloom, bloom_hits, bound_batches, buckets_for, files_for, lean, materialize, release, row_key, shield, with_bloom_places
from .suffix_array import suffix_array

U64 = np.uint64
SEGMENT = 1 << 19
HOT = 256
SYMBOLS = 8
#: Blocks of windows in a file.
ROWS_A_FILE = 1 << 17
#: Words of the shortest passage that the query's text is without: over fifty.
PASSAGE = 51

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0xD6E8FEB86659FD93)
_INVERSE = U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        up, down = np.full(n, _BASE), np.full(n, _INVERSE)
        up[0] = down[0] = U64(1)
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"][:n], _powers["down"][:n]


class Rolling:
    """Hashes of any substrings of an array of bytes or of words' hashes."""

    def __init__(self, x: np.ndarray):
        up, self.down = _table(len(x) + 1)
        self.sum = np.zeros(len(x) + 1, U64)
        np.cumsum((_BYTE[x] if x.dtype == np.uint8 else x) * up[:-1], out=self.sum[1:])

    def of(self, start, stop) -> np.ndarray:
        """Depends on the bytes alone, not on where they are."""
        return mix((self.sum[stop] - self.sum[start]) * self.down[start])

    def grams(self, n: int) -> np.ndarray:
        m = len(self.sum) - n
        return mix((self.sum[n:] - self.sum[:m]) * self.down[:m])


def word_places(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts in ``data``, their hashes, and the n+1 offsets of words."""
    buf, at = spaced(data, off)
    start, end = runs_of_words(buf)
    first = np.searchsorted(start, at)
    moved = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return start - moved, end - moved, hash_spans(buf, start, end), first


def word_hashes(col) -> tuple[np.ndarray, np.ndarray]:
    """All words of a string column as hashes and the n+1 offsets, as ``flat`` gives bytes."""
    return word_places(*flat(col))[2:]


def anchor_runs(data: np.ndarray, off: np.ndarray, length: int, gram: int):
    """(text, first window, last window, anchor, gram hash, run hash) of every run; places within the text."""
    span = length - gram + 1
    out = []
    segment = max(SEGMENT, 4 * length)
    bits = U64(int(segment + length).bit_length())
    low = (U64(1) << bits) - U64(1)
    for a in range(0, max(len(data) - length + 1, 0), segment):
        x = data[a : a + segment + length - 1]
        windows = len(x) - length + 1
        roll = Rolling(x)
        h = roll.grams(gram)
        packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        pad = -len(packed) % span
        block = np.concatenate((packed, np.full(pad, ~U64(0)))).reshape(-1, span)
        head = np.minimum.accumulate(block, axis=1).ravel()
        tail = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(tail[:windows], head[span - 1 : span - 1 + windows]) & low).astype(np.int64)
        text = np.searchsorted(off, a + np.arange(0, windows, 1, dtype=np.int64), side="right") - 1 if len(off) > 2 else np.zeros(windows, np.int64)
        inside = a + np.arange(windows) + length <= off[text + 1]
        new = np.ones(windows, bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        new &= inside
        first = np.flatnonzero(new)
        if not len(first):
            continue
        stop = np.append(first[1:], windows)
        # a text's last run ends with its last whole window
        last = np.minimum(stop - 1, off[text[first] + 1] - length - a)
        t = text[first]
        begin = off[t] - a
        q = at[first]
        run = mix(roll.of(first, last + length) + (q - first).astype(U64) * U64(0x9FB21C651E98DF25) + (last - first).astype(U64))
        out.append((t, first - begin, last - begin, q - begin, h[q], run))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(U64), z.astype(U64)
    return tuple(np.concatenate(c) for c in zip(*out))


def blocks(data: np.ndarray, base: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, length: int, gram: int, step: int):
    """Runs cut where the windows' offsets from the anchor pass a multiple of ``step``.

    (run, first window, last window, hash of what all of a block's windows hold, hash of all they cover).
    """
    need = length - gram
    low, high = (at - hi) // step, (at - lo) // step
    n = high - low + 1
    own = np.repeat(np.arange(len(lo)), n)
    block = ragged(low, n)
    a = np.maximum(lo[own], at[own] - block * step - step + 1)
    z = np.minimum(hi[own], at[own] - block * step)
    core, whole = np.zeros(len(own), U64), np.zeros(len(own), U64)
    # what a block shares depends on the block alone, so that its runs agree whichever of its windows they have
    near, far = block * step, np.minimum(block * step + step - 1, need)
    edge = np.concatenate(([0], np.cumsum(n)))
    for i in range(len(lo)):
        x, y = edge[i], edge[i + 1]
        start = base[i] + lo[i]
        roll = Rolling(data[start : base[i] + hi[i] + length])
        mid = at[i] - lo[i]
        tag = block[x:y].astype(U64) * U64(0xD1B54A32D192ED03)
        core[x:y] = mix(roll.of(mid - near[x:y], mid + gram + need - far[x:y]) + tag + U64(step))
        place = (at[i] - a[x:y]).astype(U64) * U64(0x9FB21C651E98DF25) + (z - a)[x:y].astype(U64)
        whole[x:y] = mix(roll.of(a[x:y] - lo[i], z[x:y] - lo[i] + length) + place)
    return own, a, z, core, whole


# -- contexts of one anchor ----------------------------------------------------


def _matrix(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Strings of symbols as rows, zero-padded to ``width``."""
    out = np.zeros((len(start), width), data.dtype)
    rows = np.repeat(np.arange(len(start)), size)
    out[rows, ragged(np.zeros(len(start), np.int64), size)] = data[ragged(start, size)]
    return out


def sorted_side(group: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of symbols within ascending groups, and each one's common prefix with the one before it."""
    m, width = rows.shape
    each = -(-width // SYMBOLS)
    wide = np.zeros((m, SYMBOLS * each), rows.dtype)
    wide[:, :width] = rows
    symbols = np.ascontiguousarray(wide).view(f"V{each * rows.itemsize}").ravel()
    _, rank = np.unique(symbols, return_inverse=True)
    text = np.concatenate((group[:, None], rank.reshape(m, SYMBOLS) + int(group.max()) + 1), axis=1).ravel()
    order = suffix_array(text)
    order = order[order % (SYMBOLS + 1) == 0] // (SYMBOLS + 1)
    a, b = rows[order[1:]], rows[order[:-1]]
    differ = a != b
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.concatenate(([0], lcp))


def repeated_in_groups(group: np.ndarray, left: np.ndarray, right: np.ndarray, shortest: np.ndarray, longest: np.ndarray, need: int) -> np.ndarray:
    """For each occurrence of an anchor, which offsets 0..need of its windows occur again in its group.

    ``left`` has the bytes before the anchor, nearest first, ``right`` those
    behind its gram; offsets from ``shortest`` to ``longest`` are windows.
    """
    m = len(group)
    out = np.zeros((m, need + 1), bool)
    depth = np.arange(need + 1)
    lo, llcp = sorted_side(group, left)
    ro, rlcp = sorted_side(group, right)
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        k = b - a
        if k < 2:
            continue
        # rows of a group are neighbours in both orders and in the input
        lc, rc = np.empty((k, need + 1), np.int64), np.empty((k, need + 1), np.int64)
        cut = llcp[a:b, None] < depth
        cut[0] = False
        lc[lo[a:b] - a] = np.cumsum(cut, axis=0)
        cut = rlcp[a:b, None] < depth[::-1]
        cut[0] = False
        rc[ro[a:b] - a] = np.cumsum(cut, axis=0)
        key = lc * k + rc
        valid = (depth >= shortest[a:b, None]) & (depth <= longest[a:b, None])
        key = np.where(valid, key, -1 - np.arange(k)[:, None])
        order = np.argsort(key, axis=0, kind="stable")
        s = np.take_along_axis(key, order, 0)
        same = s[1:] == s[:-1]
        hit = np.zeros((k, need + 1), bool)
        hit[1:] |= same
        hit[:-1] |= same
        np.put_along_axis(out[a:b], order, hit, 0)
    return out


def _spans(hit: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and first and last starts of the runs of True; offset d starts at anchor - d."""
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    r, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    return r, anchor[r] - (b - 1), anchor[r] - a


# -- operator ------------------------------------------------------------------

RUN = "k1 long, k2 long, gram long, run long, lo int, hi int, at int"
SPAN = "k1 long, k2 long, lo int, hi int"


def _unsettled(runs: DataFrame, table, files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Of ``runs`` (RUN and open: still to settle): spans repeated as a whole, and what to sort.

    That is one run of each class of the grams with a class that is alone and
    open beside others; ``m`` is the number of the gram's classes. ``table`` is ``materialize``.
    """
    equal = table(
        runs.groupBy("gram", "run").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("open"), F.min(F.struct("k1", "k2", "lo", "hi", "at")).alias("one")), "equal", files
    )
    settled = runs.where("open").join(equal.select("gram", "run", "n"), ["gram", "run"]).where("n > 1").select("k1", "k2", "lo", "hi")
    alone = (F.col("n") == 1) & F.col("open")
    loose = equal.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.max(alone).alias("some")).where("some AND m > 1").select("gram", "m")
    return settled, table(equal.join(loose, "gram").select("gram", "m", alone.alias("open"), "one.*"), "wanted", files)


def repeated_windows(docs: DataFrame, length: int, gram: int, symbols=flat) -> DataFrame:
    """(k1, k2, lo, hi): starts lo..hi of repeated strings in the documents (k1, k2, text).

    ``symbols`` reads a column's texts: ``flat`` as bytes, ``word_hashes`` as words. Its own tables go when the spans are written.
    """
    made = []

    def table(*args) -> DataFrame:
        made.append(materialize(*args))
        return made[-1]

    spans = materialize(_repeated(docs, length, gram, symbols, table), "spans")
    for t in made:
        release(t)
    return spans


def _repeated(docs: DataFrame, length: int, gram: int, symbols, table) -> DataFrame:
    need = length - gram

    def runs(batches):
        """Runs that are equal in a batch are settled there: their stretches (gram null), and one of them for the rest of the table."""
        for b in batches:
            data, off = symbols(b.column("text"))
            t, lo, hi, q, g, f = anchor_runs(data, off, length, gram)
            order = np.lexsort((f, g))
            new = np.ones(len(order), bool)
            new[1:] = (g[order][1:] != g[order][:-1]) | (f[order][1:] != f[order][:-1])
            again = ~new
            again[:-1] |= ~new[1:]
            twice = np.zeros(len(order), bool)
            twice[order] = again
            one = np.sort(order[new])
            # neighbours that are both settled are one stretch
            own = np.flatnonzero(twice)
            head = np.ones(len(own), bool)
            head[1:] = (t[own][1:] != t[own][:-1]) | (lo[own][1:] > hi[own][:-1] + 1)
            first = np.flatnonzero(head)
            last = np.append(first[1:], len(own))[: len(first)] - 1
            rows = np.concatenate((one, own[first]))
            n, m = len(one), len(first)
            stretch = np.arange(n + m) >= n
            take = pa.array(t[rows])
            high = np.concatenate((hi[one], hi[own[last]]))
            yield pa.RecordBatch.from_arrays([
                b.column("k1").take(take), b.column("k2").take(take), pa.array(g[rows].view(np.int64), mask=stretch), pa.array(f[rows].view(np.int64)),
                *(pa.array(x, pa.int32()) for x in (lo[rows], high, q[rows])), pa.array(~twice[rows]),
            ], names=["k1", "k2", "gram", "run", "lo", "hi", "at", "open"])

    found = table(docs.select("k1", "k2", "text").mapInArrow(lean(runs), RUN + ", open boolean"), "runs")
    every, here = found.where("gram IS NOT NULL"), found.where("gram IS NULL").select("k1", "k2", "lo", "hi")
    often = table(every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
    spans, wanted = _unsettled(table(every.join(often, "gram"), "candidates"), table)
    spans = spans.unionByName(here)
    # what is cut into blocks of windows, and those into single ones; a single window's classes are its grams, so none is left
    for step in (math.isqrt(need) + 1, 1):
        hot = wanted.where(F.col("m") > HOT)
        cold = wanted.where(F.col("m") <= HOT)
        if not cold.isEmpty():
            spans = spans.unionByName(_sorted(docs, cold, length, gram, symbols))
        crowded = hot.count()
        if not crowded:
            return spans

        def cut(batches, step=step):
            for b in batches:
                data, doc, base, k1, k2, g, op, lo, hi, at = _wanted(b, symbols)
                own, a, z, core, whole = blocks(data, base, lo, hi, at, length, gram, step)
                core = mix(core ^ g[own].view(U64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[own]), pa.array(k2[own]), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), *(pa.array(x, pa.int32()) for x in (a, z, at[own])), pa.array(op[own])],
                    names=["k1", "k2", "gram", "run", "lo", "hi", "at", "open"],
                )

        # a run has step blocks at most, and a block step windows
        files = files_for(crowded * (math.isqrt(need) + 1), ROWS_A_FILE)
        more, wanted = _unsettled(table(_beside(docs, hot).mapInArrow(lean(cut), RUN + ", open boolean"), "blocks", files), table, files)
        spans = spans.unionByName(more)
    return spans


def _beside(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k1, k2, text, runs): the texts of the wanted runs, each once, with them."""
    per = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "open", "lo", "hi", "at")).alias("runs"))
    filt = bloom(wanted.select("k1", "k2").distinct(), "k1", "k2")

    def maybe(batches):
        for b in batches:
            yield b.filter(pa.array(bloom_hits(filt.value, b))).select(["k1", "k2", "text"])

    texts = with_bloom_places(docs.select("k1", "k2", "text"), "k1", "k2").mapInArrow(lean(maybe), "k1 long, k2 long, text string").dropDuplicates(["k1", "k2"])
    return texts.join(per, ["k1", "k2"]).select("k1", "k2", "text", "runs")


def _wanted(b: pa.RecordBatch, symbols):
    """The symbols of a batch of ``_beside``, and of each run: its text, where that begins, and the run's columns."""
    data, off = symbols(b.column("text"))
    lists = b.column("runs")
    n = np.diff(lists.offsets.to_numpy())
    g, op, lo, hi, at = (lists.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(5))
    doc = np.repeat(np.arange(len(n)), n)
    return data, doc, off[doc], b.column("k1").to_numpy()[doc], b.column("k2").to_numpy()[doc], g, op, *(x.astype(np.int64) for x in (lo, hi, at))


def _sorted(docs: DataFrame, wanted: DataFrame, length: int, gram: int, symbols) -> DataFrame:
    """The repeated windows of the wanted runs that are open, by suffix arrays of their gram's contexts."""
    need = length - gram
    kind = symbols(pa.array([], pa.string()))[0].dtype

    def contexts(batches):
        """Symbols left (nearest first) and right of each wanted anchor."""
        for b in batches:
            data, doc, base, k1, k2, g, op, lo, hi, at = _wanted(b, symbols)
            if not len(g):
                continue
            ends = np.concatenate(([0], np.cumsum(at - lo))), np.concatenate(([0], np.cumsum(hi + length - at - gram)))
            left = data[::-1][ragged(len(data) - (base + at), at - lo)]
            right = data[ragged(base + at + gram, hi + length - at - gram)]
            sides = [pa.Array.from_buffers(pa.binary(), len(g), [None, pa.py_buffer((e * kind.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))]) for e, x in zip(ends, (left, right))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(g), pa.array(op), pa.array(k1), pa.array(k2), *(pa.array(x, pa.int32()) for x in (lo, hi, at)), *sides],
                names=["gram", "open", "k1", "k2", "lo", "hi", "at", "before", "behind"],
            )

    def settle(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("gram").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        _, group = np.unique(t.column("gram").to_numpy(), return_inverse=True)
        lo, hi, at = (t.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "at"))
        sides = []
        for c in ("before", "behind"):
            data, off = flat(t.column(c))
            off //= kind.itemsize
            sides.append(_matrix(data.copy().view(kind), off[:-1], np.diff(off), need))
        hit = repeated_in_groups(group, *sides, at - hi, at - lo, need)
        hit &= t.column("open").to_numpy(zero_copy_only=False)[:, None]
        r, a, z = _spans(hit, at)
        take = pa.array(r)
        return pa.table({"k1": t.column("k1").take(take), "k2": t.column("k2").take(take), "lo": pa.array(a, pa.int32()), "hi": pa.array(z, pa.int32())})

    around = _beside(docs, wanted).mapInArrow(lean(contexts), "gram long, open boolean, k1 long, k2 long, lo int, hi int, at int, before binary, behind binary")
    bucket = F.pmod(F.xxhash64("gram"), F.lit(buckets_for(docs)))
    return around.groupBy(bucket.alias("bucket")).applyInArrow(lean(settle), SPAN)


def _bytes_removed(n: int, spans: np.ndarray, length: int) -> np.ndarray:
    """Merged (start, stop) of the bytes that windows starting in the spans cover."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    start, stop = spans[:, 0], np.minimum(np.maximum.accumulate(spans[:, 1] + length), n)
    new = np.concatenate(([True], start[1:] > stop[:-1]))
    at = np.flatnonzero(new)
    return np.stack((start[at], stop[np.append(at[1:], len(start)) - 1]), axis=1)


def remove_repeats(docs: DataFrame, length: int = 400, gram: int | None = None, words: int | None = None) -> DataFrame:
    """``docs`` with ``n_bytes``, ``removed`` array<struct<start,stop>> and ``kept`` binary (what is left).

    With ``words``, also ``passages``, like ``removed`` the stretches that so many words in a row cover which
    start anywhere else too, and ``rest`` binary: what is left without both.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    if gram is None:
        gram = max(length // 3, 1)
    docs, back = shield(docs, "doc_id", "text")
    own = docs.columns
    keyed = row_key(docs)
    texts = keyed.select("k1", "k2", F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_windows(texts, length, gram).withColumn("by_word", F.lit(False))
    if words is not None:
        spans = spans.unionByName(repeated_windows(texts, words, max(words // 3, 1), word_hashes).withColumn("by_word", F.lit(True)))
    per = materialize(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi", "by_word")).alias("spans")), "removed")
    filt = bloom(per, "k1", "k2")
    rows = with_bloom_places(keyed, "k1", "k2")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    added = {"n_bytes": "long", "removed": "array<struct<start:int,stop:int>>", "kept": "binary"}
    if words is not None:
        added |= {"passages": "array<struct<start:int,stop:int>>", "rest": "binary"}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in own) + "".join(f", {c} {kind}" for c, kind in added.items())
    spans_kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    pairs = lambda m: [{"start": int(a), "stop": int(z)} for a, z in m]

    def without(text: bytes, m: np.ndarray) -> bytes:
        edges = [0, *m.ravel().tolist(), len(text)]
        return b"".join(text[a:z] for a, z in zip(edges[0::2], edges[1::2]))

    @lean
    def cut(batches, concerned: bool):
        for b in batches:
            if not concerned:
                b = b.filter(pa.array(~bloom_hits(filt.value, b)))
            data, off = flat(b.column("text"))
            n = np.diff(off)
            found = b.column("spans") if concerned else None
            if concerned and words is not None:
                start, end, _, first = word_places(data, off)
            removed, kept, passages, rest = [], [], [], []
            whole = data.tobytes()
            for i in range(len(n)):
                text = whole[off[i] : off[i + 1]]
                s = (found[i].as_py() if found is not None else None) or []
                m = _bytes_removed(len(text), np.array([(x["lo"], x["hi"]) for x in s if not x["by_word"]], np.int64), length)
                removed.append(pairs(m))
                kept.append(without(text, m) if len(m) else text)
                own_words = np.array([(x["lo"], x["hi"]) for x in s if x["by_word"]], np.int64)
                if not len(own_words):
                    passages.append([])
                    rest.append(None)  # as kept
                    continue
                places = np.stack((start[first[i] + own_words[:, 0]], end[first[i] + own_words[:, 1] + words - 1]), axis=1) - off[i]
                w = _bytes_removed(len(text), places, 0)
                passages.append(pairs(w))
                rest.append(without(text, _bytes_removed(len(text), np.concatenate((m, w)), 0)))
            results = {"n_bytes": pa.array(n), "removed": pa.array(removed, spans_kind), "kept": pa.array(kept, pa.binary()), "passages": pa.array(passages, spans_kind), "rest": pa.array(rest, pa.binary())}
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *(results[c] for c in added)], names=[*own, *added])

    def maybe(batches):
        for b in batches:
            yield b.filter(pa.array(bloom_hits(filt.value, b))).drop_columns(["_p1", "_p2"])

    clean = rows.select(*own, "_p1", "_p2").mapInArrow(lambda it: cut(it, False), schema)
    inner = ", ".join(f"`{c}` {kinds[c]}" for c in own) + ", k1 long, k2 long"
    near = rows.select(*own, "k1", "k2", "_p1", "_p2").mapInArrow(lean(maybe), inner).join(per, ["k1", "k2"], "left")
    out = clean.unionByName(near.select(*own, "spans").mapInArrow(lambda it: cut(it, True), schema))
    return back(out if words is None else out.withColumn("rest", F.coalesce("rest", "kept")))


def kept_text(column: str = "kept"):
    """``kept`` or ``rest`` as text: a cut inside a character leaves bytes that are none, and these are dropped."""
    left = F.col(column).cast("string")
    return F.coalesce(F.try_validate_utf8(left), F.regexp_replace(F.make_valid_utf8(left), "\ufffd", ""))


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The repeats of 400 bytes by document; ``text`` is without them and without repeated passages of over fifty words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return remove_repeats(docs, length=400, words=PASSAGE).select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.size("passages").cast("long").alias("n_passages"), kept_text("rest").alias("text"),
    )
