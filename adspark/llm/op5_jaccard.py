"""N-gram Jaccard self-join by PartEnum signatures.

A document's set is hashed word shingles. Sizes are cut into bands so that two
sets of the wanted similarity lie in one band or in neighbours, and within a
band similarity bounds the symmetric difference by some k. The feature domain
is dealt over about (k + 1) / 2 groups of three parts; two such sets differ in
at most one feature in some group, so two of its three parts agree. A set's
signatures are, for its band and the next, each group's three pairs of parts.
Two sets similar enough share one signature at least, whatever the data, and
there differ in one feature at most in the group's third part. More holds of
some group, by the pigeonring principle: with the l - 1 groups behind it on the
ring of groups it has under 2 l differences, for every l. 16-bit odd sketches of
the third part and of the next three groups travel with the signature, and sets
that share it are kept apart where these rule a link out.

Equal sets are one class, by a 128-bit hash of the set, before anything else.
Signatures travel packed; the task of a bucket finds the groups of classes
that share one and are linked by sketches. Links are then settled in rounds: first each class against the
least class of most of its groups, then against the likeliest class of other
components, then every pair of a group that is still in two components and was
not tested before. Before a pair's sets are fetched, its odd
sketches (xor of one bit per feature, so they never differ in more bits than
the sets differ in features) must allow the link. The test itself is exact, in
integers. No pair that shares a signature whose sketches allow a link goes untested unless both ends are in
one component by then, and no cap holds anywhere.

Null text and text without words: the empty set, linked with nothing. Fewer
words than a shingle: the whole sequence as one shingle. Null id: links with
nothing, component null. Repeated rows: one class. Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import LOWER, flat, hash_spans, mix, ragged, runs_of_words, spaced
from .common import bound_batches, buckets_for, files_for, lean, materialize
from .graph import components

U64 = np.uint64
FLUSH = 1 << 20
LOW = U64(0xFFFF)
#: A table of tested pairs, or of their sets, has a file for so many pairs, one at least.
PAIRS_A_FILE = 1 << 14
#: Groups behind a signature's own whose sketches travel with it.
AHEAD = 3
#: Members of a signature from which it is parted by its sketches' bits before any two are compared.
CROWD = 4096


# -- sets ----------------------------------------------------------------------


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, joined, and their numbers."""
    docs = len(off) - 1
    buf, begin = spaced(data, off)
    buf = LOWER[buf]
    start, end = runs_of_words(buf)
    w = hash_spans(buf, start, end)
    first = np.searchsorted(start, begin)
    words = np.diff(first)
    shingles = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    at = ragged(first[:-1], shingles)
    h = np.zeros(len(at), U64)
    # a short text's only shingle runs to its end; its length is part of the hash
    room = np.minimum(np.repeat(words, shingles), width)
    for i in range(width):
        live = room > i
        h[live] = mix(h[live] + w[at[live] + i] * U64(2 * i + 0x9E3779B97F4A7C15))
    h = mix(h + room.astype(U64))
    ends = np.cumsum(shingles)
    out, n = [], np.zeros(docs, np.int64)
    for d in range(docs):
        s = h[ends[d] - shingles[d] : ends[d]]
        if len(s) > 1:
            s = np.sort(s)
            new = s[1:] != s[:-1]
            if not new.all():
                s = s[np.concatenate(([True], new))]
        out.append(s)
        n[d] = len(s)
    return (np.concatenate(out) if out else h[:0]), n


def odd_sketch(s: np.ndarray) -> bytes:
    """One bit per feature, flipped: bits are a power of two, as many as features or more."""
    bits = 64
    while bits < len(s):
        bits *= 2
    at = (mix(s ^ U64(0xA5A5A5A5A5A5A5A5)) % U64(bits)).astype(np.int64)
    odd = np.bincount(at, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(words: np.ndarray, n: int) -> np.ndarray:
    """A sketch (rows of 64-bit words) at n words, which its own number is a multiple of."""
    return np.bitwise_xor.reduce(words.reshape(len(words), -1, n), axis=1)


def may_link(na, nb, sa: bytes, sb: bytes, num: int, den: int) -> bool:
    """False only where sets of these sizes and sketches cannot be similar enough."""
    if min(na, nb) * den < max(na, nb) * num:
        return False
    a, b = np.frombuffer(sa, U64)[None], np.frombuffer(sb, U64)[None]
    n = min(a.shape[1], b.shape[1])
    return int(np.bitwise_count(fold(a, n) ^ fold(b, n)).sum()) * (den + num) <= (na + nb) * (den - num)


# -- signatures ----------------------------------------------------------------


class Bands:
    """Size bands for a similarity num/den: sets of band i meet those of i and i + 1."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.high = [0]

    def upto(self, n: int) -> np.ndarray:
        while self.high[-1] < n:
            low = self.high[-1] + 1
            self.high.append(max(low, low * self.den // self.num))
        return np.array(self.high)

    def groups(self, band: np.ndarray) -> np.ndarray:
        """Feature groups of a band: more than half the largest symmetric difference."""
        self.upto(1)
        while len(self.high) <= int(band.max(initial=0)):
            self.upto(self.high[-1] + 1)
        k = (self.den - self.num) * 2 * np.array(self.high)[band] // (self.den + self.num)
        return (k + 2) // 2


def signatures(sets: np.ndarray, n: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All signatures of the sets, the odd sketches of the AHEAD groups behind each one's, and which set each belongs to.

    The low 16 bits are no part of a signature: they are the odd sketch of the
    group's third part, which differs in one feature at most, so in one bit,
    between sets that the group is to bring together.
    """
    owner = np.repeat(np.arange(len(n)), n)
    band = np.searchsorted(bands.upto(int(n.max(initial=1))), n)
    out, ring, who = [], [], []
    for more in (0, 1):
        b = band + more
        groups = np.where(n > 0, bands.groups(b), 0)
        base = np.cumsum(groups) - groups
        seed = mix(b.astype(U64) + U64(0x51ED27))
        h = mix(sets ^ seed[owner])
        group = (((h >> U64(32)) * groups[owner].astype(U64)) >> U64(32)).astype(np.int64)
        cell = (base[owner] + group) * 3 + ((h & U64(0xFFFFFFFF)) % U64(3)).astype(np.int64)
        sums = np.zeros(int(groups.sum()) * 3, U64)
        value = mix(h + U64(0x1234567))
        np.add.at(sums, cell, value)
        odd = np.zeros(len(sums), U64)
        np.bitwise_xor.at(odd, cell, U64(1) << (value & U64(15)))
        odd = odd.reshape(-1, 3)
        part = mix(sums).reshape(-1, 3)
        mine = np.repeat(np.arange(len(n)), groups)
        place = np.arange(len(mine)) - base[mine]
        tag = mix(seed[mine] + place.astype(U64))
        whole = np.bitwise_xor.reduce(odd, axis=1)
        ahead = np.zeros(len(mine), U64)
        for step in range(1, AHEAD + 1):
            there = groups[mine] > step  # a short ring ends before it comes round
            ahead[there] |= whole[(base[mine] + (place + step) % groups[mine])[there]] << U64(16 * step - 16)
        for i, j in ((0, 1), (0, 2), (1, 2)):
            s = mix(part[:, i] + part[:, j] * U64(0x9FB21C651E98DF25) + tag + U64(3 * i + j))
            out.append((s & LOW) ^ s | odd[:, 3 - i - j])
            ring.append(ahead)
            who.append(mine)
    return np.concatenate(out), np.concatenate(ring), np.concatenate(who)


# -- operator ------------------------------------------------------------------


def _classes(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, k2, n, cid, sketch) of every row."""
    import xxhash

    def run(batches):
        for b in batches:
            data, off = flat(b.column("text"))
            sets, n = shingle_sets(data, off, width)
            at = np.concatenate(([0], np.cumsum(n)))
            own = [sets[i:j] for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("k2"), pa.array(n), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in own], pa.binary()),
                pa.array([odd_sketch(s) for s in own], pa.binary()),
            ], names=["doc_id", "k2", "n", "cid", "sketch"])

    return docs.select("doc_id", "k2", "text").mapInArrow(lean(run), "doc_id long, k2 long, n long, cid binary, sketch binary")


def _groups(docs: DataFrame, width: int, num: int, den: int, buckets: int) -> DataFrame:
    """(bucket, sizes, members, classes): per bucket, the distinct groups of classes with a shared signature."""
    import xxhash

    def emit(batches):
        bands = Bands(num, den)
        seen: set[bytes] = set()
        sig, ring, who, cids, held = [], [], [], [], 0

        def flush():
            s, e, w = np.concatenate(sig), np.concatenate(ring), np.concatenate(who)
            bucket = ((s >> U64(16)) % U64(buckets)).astype(np.int64)
            order = np.lexsort((w, bucket))
            s, e, w, bucket = s[order], e[order], w[order], bucket[order]
            e = np.ascontiguousarray(e.view(np.uint8).reshape(-1, 8)[:, : 2 * AHEAD])
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            table = np.frombuffer(b"".join(cids), np.uint8).reshape(-1, 16)
            rows = []
            for k in np.flatnonzero(np.diff(edge)):
                own, each = np.unique(w[edge[k] : edge[k + 1]], return_counts=True)
                rows.append((k, s[edge[k] : edge[k + 1]].tobytes(), e[edge[k] : edge[k + 1]].tobytes(), each.astype(np.uint32).tobytes(), table[own].tobytes()))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3, 4))],
                names=["bucket", "sigs", "ahead", "each", "classes"],
            )

        for b in batches:
            data, off = flat(b.column("text"))
            sets, n = shingle_sets(data, off, width)
            at = np.concatenate(([0], np.cumsum(n)))
            take = np.zeros(len(n), bool)
            for d in np.flatnonzero(n):
                c = xxhash.xxh3_128_digest(sets[at[d] : at[d + 1]].tobytes())
                # a task's repeated classes count once; the bound on what it remembers costs repeats only
                if c not in seen:
                    take[d] = True
                    seen.add(c)
                    cids.append(c)
            if len(seen) > 1 << 19:
                seen.clear()
            if not take.any():
                continue
            s, e, w = signatures(sets[np.repeat(take, n)], n[take], bands)
            sig.append(s)
            ring.append(e)
            who.append(w + len(cids) - int(take.sum()))
            held += len(s)
            if held > FLUSH:
                yield flush()
                sig, ring, who, cids, held = [], [], [], [], 0
        if held:
            yield flush()

    def gather(t: pa.Table) -> pa.Table:
        k = t.column("bucket")[0].as_py()
        sig, ahead, each, tables = (b"".join(t.column(x).to_pylist()) for x in ("sigs", "ahead", "each", "classes"))
        own, inverse = np.unique(np.frombuffer(tables, "V16"), return_inverse=True)
        sig = np.frombuffer(sig, U64)
        ring = np.zeros((len(sig), 8), np.uint8)
        ring[:, : 2 * AHEAD] = np.frombuffer(ahead, np.uint8).reshape(-1, 2 * AHEAD)
        ring = ring.view(U64).ravel()
        member = np.repeat(inverse, np.frombuffer(each, np.uint32))
        del t, ahead, each, tables
        s, m = _shared(sig >> U64(16), member, sig & LOW, ring)
        begin = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(s)))
        # groups of one class go; of groups with the same members one stays
        print_of = np.add.reduceat(mix(m.astype(U64) + U64(1)), begin) if len(s) else np.zeros(0, U64)
        _, pick, often = np.unique(np.where(size > 1, print_of, U64(0)), return_index=True, return_counts=True)
        live = size[pick] > 1 if len(size) else np.zeros(0, bool)
        pick, often = pick[live], often[live]
        rows = []
        total = np.cumsum(size[pick]) // (1 << 20)
        for part in np.split(np.arange(len(pick)), np.flatnonzero(np.diff(total)) + 1) if len(pick) else []:
            g = pick[part]
            who = m[ragged(begin[g], size[g])]
            used, at = np.unique(who, return_inverse=True)
            rows.append((size[g].astype(np.uint32).tobytes(), at.astype(np.uint32).tobytes(), own[used].tobytes(), often[part].astype(np.uint32).tobytes()))
        return pa.table({"bucket": pa.array([k] * len(rows), pa.int32()), **{x: pa.array([r[i] for r in rows], pa.binary()) for i, x in enumerate(("sizes", "members", "classes", "often"))}})

    packed = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(lean(emit), "bucket int, sigs binary, ahead binary, each binary, classes binary")
    found = packed.groupBy("bucket").applyInArrow(lean(gather), "bucket int, sizes binary, members binary, classes binary, often binary")
    return materialize(found.withColumn("piece", F.xxhash64("bucket", "sizes", "members", "classes")), "groups")


def _distinct(s: np.ndarray, *more: np.ndarray):
    """Entries in order of key, then of what follows, each once."""
    order = np.lexsort((*more[::-1], s))
    cols = [x[order] for x in (s, *more)]
    keep = np.zeros(len(s), bool)
    keep[:1] = True
    for x in cols:
        keep[1:] |= x[1:] != x[:-1]
    return [x[keep] for x in cols]


def _several(s: np.ndarray) -> np.ndarray:
    """Which entries of sorted keys share theirs with another."""
    same = s[1:] == s[:-1]
    out = np.zeros(len(s), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def _shared(key: np.ndarray, member: np.ndarray, sketch: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, member) in order: members that share a key, as far as sketches that allow a link join them."""
    order = np.argsort(key, kind="stable")
    live = order[_several(key[order])]
    s, m, v, e = _distinct(key[live], member[live], sketch[live], ahead[live])
    some = _several(s)
    s, m, v, e = s[some], m[some], v[some], e[some]
    if not len(s):
        return s, m
    begin = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    size = np.diff(np.append(begin, len(s)))
    crowd = np.flatnonzero(np.repeat(size > CROWD, size))
    rest = np.flatnonzero(np.repeat(size <= CROWD, size))
    label = np.arange(len(s))
    label = _allowed(label, s[rest], rest, v, e)
    # an allowed pair agrees in all bits but one of the third part's sketch, and in one quarter of the next group's at least
    for bit in range(16 if len(crowd) else 0):
        for quarter in range(4):
            k = mix(s[crowd] + mix((v[crowd] & ~(U64(1) << U64(bit))) * U64(64) + U64(4 * bit + quarter) + mix((e[crowd] >> U64(4 * quarter)) & U64(15))))
            by = np.argsort(k, kind="stable")
            label = _allowed(label, k[by], crowd[by], v, e)
    order = np.argsort(label, kind="stable")
    order = order[_several(label[order])]
    return label[order].astype(U64), m[order]


def _allowed(label: np.ndarray, key: np.ndarray, place: np.ndarray, sketch: np.ndarray, ahead: np.ndarray, some: int = 1 << 20) -> np.ndarray:
    """The least labels after joining the places whose keys (in order) are equal and whose sketches allow a link."""
    n = len(key)
    if not n:
        return label
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    end = np.repeat(np.append(begin[1:], n), np.diff(np.append(begin, n)))
    left = end - np.arange(n) - 1
    cut = np.cumsum(left) // some
    edge = np.concatenate(([0], np.flatnonzero(np.diff(cut)) + 1, [n]))
    for x, y in zip(edge[:-1], edge[1:]):
        i = np.repeat(place[x:y], left[x:y])
        j = place[ragged(np.arange(x + 1, y + 1), left[x:y])]
        differ = np.bitwise_count(sketch[i] ^ sketch[j])
        for step in range(AHEAD + 1):
            if step:
                differ = differ + np.bitwise_count(((ahead[i] ^ ahead[j]) >> U64(16 * step - 16)) & LOW)
            ok = differ <= 2 * step + 1
            i, j, differ = i[ok], j[ok], differ[ok]
        i, j = label[i], label[j]
        if (i != j).any():
            label = least_labels(len(label), i, j)[label]
    return label


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of 0..n-1 that each reaches over the links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        # a link moves both ends' labels, and what hangs on them
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        live = label[a] != label[b]
        a, b = a[live], b[live]
    return label


def _unpack(row_sizes: bytes, row_members: bytes, row_classes: bytes):
    size = np.frombuffer(row_sizes, np.uint32).astype(np.int64)
    member = np.frombuffer(row_members, np.uint32).astype(np.int64)
    table = np.frombuffer(row_classes, "V16")
    return size, member, table, np.cumsum(size) - size


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in a], pa.binary()), pa.array([x.tobytes() for x in b], pa.binary())], names=["a", "b"])


def _stars(groups: DataFrame) -> DataFrame:
    """In each bucket, a class with the least class of most signatures' groups that it is in.

    Classes that share many signatures mostly link, so these pairs settle most
    components; what they miss is left to the later rounds.
    """

    def run(batches):
        for t in batches:
            for s, m, c, o in zip(*(t.column(x).to_pylist() for x in ("sizes", "members", "classes", "often"))):
                size, member, table, begin = _unpack(s, m, c)
                weight = np.repeat(np.frombuffer(o, np.uint32).astype(np.int64), size)
                hub = np.repeat(member[begin], size)
                other = hub != member
                pair, at = np.unique(member[other] * len(table) + hub[other], return_inverse=True)
                votes = np.bincount(at, weight[other], minlength=len(pair))
                x, h = pair // len(table), pair % len(table)
                best = np.lexsort((h, -votes, x))
                first = np.ones(len(best), bool)
                first[1:] = x[best][1:] != x[best][:-1]
                best = best[first]
                yield _pair_batch(table[h[best]], table[x[best]])

    return groups.select("sizes", "members", "classes", "often").mapInArrow(lean(run), "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rest(groups: DataFrame, known: DataFrame, num: int, den: int, every: bool, slices: int) -> DataFrame:
    """Pairs of a group in different components whose sketches allow a link.

    Not ``every``: of a class, only the pair whose sketches differ least.
    """
    def names(batches):
        """Each piece's classes, packed by slice of the class table."""
        for t in batches:
            for k, p, c in zip(*(t.column(x).to_pylist() for x in ("bucket", "piece", "classes"))):
                own = np.frombuffer(c, np.uint8).reshape(-1, 16)
                at = (own[:, :7].astype(np.int64) << np.arange(48, -8, -8)).sum(axis=1) % slices
                by = np.argsort(at, kind="stable")
                edge = np.searchsorted(at[by], np.arange(slices + 1))
                live = np.flatnonzero(np.diff(edge))
                yield pa.RecordBatch.from_arrays([
                    pa.array(live, pa.int32()), pa.array([k] * len(live), pa.int32()), pa.array([p] * len(live), pa.int64()),
                    pa.array([own[by[edge[i] : edge[i + 1]]].tobytes() for i in live], pa.binary()),
                ], names=["slice", "bucket", "piece", "cids"])

    def attach(left: pa.Table, right: pa.Table) -> pa.Table:
        """What is known of a slice's classes, for each piece that asks."""
        cid, label, n, sketch = (left.column(x).to_pylist() for x in ("cid", "label", "n", "sketch"))
        at = {c: i for i, c in enumerate(cid)}
        rows = []
        for c in right.column("cids").to_pylist():
            i = [at[c[j : j + 16]] for j in range(0, len(c), 16)]
            own = [sketch[x] for x in i]
            rows.append((b"".join(label[x] for x in i), np.array([n[x] for x in i], np.int64).tobytes(), np.array([len(x) for x in own], np.int64).tobytes(), b"".join(own)))
        return pa.table({
            **{x: right.column(x) for x in ("bucket", "piece", "cids")}, **{x: pa.array([r[i] for r in rows], pa.binary()) for i, x in enumerate(("labels", "n", "bytes", "sketches"))}
        })

    def cross(left: pa.Table, right: pa.Table) -> pa.Table:
        """The pairs of a piece, by a hash of the pair; other buckets may have some of them too."""
        part, outs = [], []
        if left.num_rows and right.num_rows:
            about = {}
            for c, lab, n, size, sk in zip(*(right.column(x).to_pylist() for x in ("cids", "labels", "n", "bytes", "sketches"))):
                n, size = np.frombuffer(n, np.int64).tolist(), np.frombuffer(size, np.int64)
                end = np.cumsum(size).tolist()
                for j in range(len(n)):
                    about[c[16 * j : 16 * j + 16]] = (lab[16 * j : 16 * j + 16], n[j], sk[end[j] - int(size[j]) : end[j]])
            for s, m, c in zip(*(left.column(x).to_pylist() for x in ("sizes", "members", "classes"))):
                size, member, table, begin = _unpack(s, m, c)
                info = [about[x.tobytes()] for x in table]
                _, label = np.unique([x[0] for x in info], return_inverse=True)
                n = np.array([x[1] for x in info], np.int64)
                words = np.array([len(x[2]) // 8 for x in info])
                sketches = [np.frombuffer(x[2], U64)[None] for x in info]
                mixed = np.flatnonzero(np.minimum.reduceat(label[member], begin) != np.maximum.reduceat(label[member], begin))
                got = [np.zeros(0, np.int64)]
                for g in mixed:
                    own = member[begin[g] : begin[g] + size[g]]
                    lab = label[own]
                    # the rows of the largest component meet the others only as the others' partners
                    common = np.bincount(lab).argmax()
                    # a group's sets are of like sizes, so are their sketches
                    least = int(words[own].min())
                    sketch = np.concatenate([fold(sketches[x], least) for x in own.tolist()])
                    few = np.flatnonzero(lab != common)
                    for i in few:
                        other = np.flatnonzero((lab != lab[i]) & ((lab == common) | (np.arange(len(own)) > i)))
                        x, y = own[i], own[other]
                        low, high = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
                        fit = low * den >= high * num
                        other, y = other[fit], y[fit]
                        differ = np.bitwise_count(sketch[other] ^ sketch[i]).sum(axis=1, dtype=np.int64)
                        fit = differ * (den + num) <= (n[x] + n[y]) * (den - num)
                        y = y[fit]
                        if not every and len(y) > 1:
                            y = y[differ[fit].argmin(keepdims=True)]
                        got.append(np.minimum(x, y) * len(table) + np.maximum(x, y))
                pair = np.unique(np.concatenate(got))
                both = np.stack((table[pair // len(table)], table[pair % len(table)]), axis=1).view(U64).reshape(-1, 4)
                both = np.where((both[:, :1].byteswap() > both[:, 2:3].byteswap()) | (both[:, :1] == both[:, 2:3]) & (both[:, 1:2].byteswap() > both[:, 3:].byteswap()), both[:, [2, 3, 0, 1]], both)
                at = mix(both[:, 0] ^ mix(both[:, 2])) % U64(slices)
                by = np.argsort(at, kind="stable")
                edge = np.searchsorted(at[by], np.arange(slices + 1, dtype=np.uint64))
                for k in np.flatnonzero(np.diff(edge)):
                    part.append(k)
                    outs.append(both[by[edge[k] : edge[k + 1]]].tobytes())
        return pa.table({"part": pa.array(part, pa.int32()), "pairs": pa.array(outs, pa.binary())})

    def once(t: pa.Table) -> pa.Table:
        both = np.unique(np.frombuffer(b"".join(t.column("pairs").to_pylist()), "V32"))
        return pa.table({x: pa.array([v.tobytes()[i : i + 16] for v in both], pa.binary()) for x, i in (("a", 0), ("b", 16))})

    asked = groups.select("bucket", "piece", "classes").mapInArrow(lean(names), "slice int, bucket int, piece long, cids binary")
    slice_of = F.conv(F.hex(F.substring("cid", 1, 7)), 16, 10).cast("bigint") % slices
    who = (
        known.withColumn("slice", slice_of.cast("int")).groupBy("slice").cogroup(asked.groupBy("slice"))
        .applyInArrow(lean(attach), "bucket int, piece long, cids binary, labels binary, n binary, bytes binary, sketches binary")
    )
    return groups.groupBy("bucket", "piece").cogroup(who.groupBy("bucket", "piece")).applyInArrow(lean(cross), "part int, pairs binary").groupBy("part").applyInArrow(lean(once), "a binary, b binary")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough, exactly."""

    def sieve(batches):
        for t in batches:
            rows = zip(*(t.column(x).to_pylist() for x in ("na", "nb", "sa", "sb")))
            ok = np.fromiter((may_link(*r, num, den) for r in rows), bool, t.num_rows)
            yield t.select(["a", "b"]).filter(pa.array(ok))

    files = files_for(pairs.count(), PAIRS_A_FILE)
    left = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    live = materialize(pairs.join(left, "a").join(right, "b").mapInArrow(lean(sieve), "a binary, b binary"), "pairs", files)
    used = live.select(F.col("a").alias("cid")).unionByName(live.select(F.col("b").alias("cid"))).distinct()
    where = classes.join(used, "cid").select("cid", F.col("row.doc_id").alias("doc_id"), F.col("row.k2").alias("k2"))

    def sets(batches):
        for t in batches:
            data, off = flat(t.column("text"))
            s, n = shingle_sets(data, off, width)
            at = np.concatenate(([0], np.cumsum(n)))
            yield pa.RecordBatch.from_arrays([t.column("cid"), pa.array([s[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())], names=["cid", "features"])

    texts = docs.join(where, ["doc_id", "k2"]).select("cid", "text")
    # rows that repeat in the table would repeat here
    known = materialize(texts.mapInArrow(lean(sets), "cid binary, features binary").dropDuplicates(["cid"]), "sets", files)

    def test(batches):
        for t in batches:
            ok = []
            for a, b in zip(t.column("fa").to_pylist(), t.column("fb").to_pylist()):
                a, b = np.frombuffer(a, U64), np.frombuffer(b, U64)
                both = np.sort(np.concatenate((a, b)))
                inter = int((both[1:] == both[:-1]).sum())
                ok.append(den * inter >= num * (len(a) + len(b) - inter))
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = live.join(known.select(F.col("cid").alias("a"), F.col("features").alias("fa")), "a").join(known.select(F.col("cid").alias("b"), F.col("features").alias("fb")), "b")
    return materialize(joined.select("a", "b", "fa", "fb").mapInArrow(lean(test), "a binary, b binary").distinct(), "linked", files)


def similar_documents(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, keyed: bool = False) -> DataFrame:
    """``docs`` (doc_id, text): doc_id, n_shingles, component_id of every row.

    ``keyed``: also k2 and component_k2, the text hashes of the row and of its component's least (id, hash).

    Rows link when den * |intersection| >= num * |union| of their shingle sets.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("k2", F.xxhash64("text"))
    rows = materialize(_classes(docs, width), "classes")
    classes = materialize(
        rows.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("cid")
        .agg(F.min(F.struct("doc_id", "k2")).alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch")),
        "class",
    )
    buckets = buckets_for(docs)
    groups = _groups(docs, width, num, den, buckets)
    tested = materialize(_stars(groups), "stars")
    links = _verified(tested, classes, docs, width, num, den)
    comp = components(links).withColumnsRenamed({"id": "cid", "component": "label"})
    for every in (False, True):
        known = classes.join(comp, "cid", "left").select("cid", F.coalesce("label", "cid").alias("label"), "n", "sketch")
        more = materialize(_rest(groups, known, num, den, every, buckets).join(tested, ["a", "b"], "left_anti"), "more")
        if more.isEmpty():
            continue  # nothing is left to test
        tested = tested.unionByName(more)
        links = links.unionByName(_verified(more, classes, docs, width, num, den))
        comp = components(links).withColumnsRenamed({"id": "cid", "component": "label"})
    labelled = classes.join(comp, "cid", "left").select("cid", F.coalesce("label", "cid").alias("label"), F.col("row").alias("least"))
    least = labelled.groupBy("label").agg(F.min("least").alias("least_row"))
    named = labelled.join(least, "label").select("cid", F.col("least_row.doc_id").alias("component_id"), F.col("least_row.k2").alias("component_k2"))
    return rows.join(named, "cid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
        *(["k2", F.coalesce("component_k2", "k2").alias("component_k2")] if keyed else []),
    )


def op5_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_documents(docs, width=4, num=85, den=100)
