"""Benchmark decontamination by template windows.

Texts become tokens (runs of letters, digits and bytes outside ASCII; a point
or comma between digits stays in the number), and tokens become templates:
numbers, names (capitalised where no sentence starts) and units of measure are
typed placeholders, other words are themselves in lower case. Windows of
``width`` template tokens are hash-joined with the benchmark's. A hit pairs
document slots with item slots; on one diagonal (document place minus item
place) each item value must stand for one document value throughout, or the
diagonal does not count. The reverse is not asked for: new values are drawn
freely, so two of an item's may be equal in its copy. A document is contaminated by an item when the item's
windows found on consistent diagonals are ``cover`` of all its windows or more;
it is verbatim when every slot has the item's own value.

The benchmark is read in parts of at most ``part_windows`` windows; each part
is the broadcast side of one scan, so its size is bounded whatever the
benchmark's, and no document text is shuffled.

Windows with fewer than half of their tokens outside placeholders are no
evidence and are left out on both sides. An item that has no others (sums,
equations, lists of names) is found by windows of its own values instead, so
its verbatim copies are found and the same with other values throughout is not. Items
shorter than a window are one window of their own length. Null or empty text:
no tokens, no match. Null ids are carried as they are. Equal items each match.
Repeated rows repeat. Empty tables: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import LOWER, flat, hash_spans, mix, runs_of_words, spaced
from .common import bound_batches, lean, pieces

U64 = np.uint64
NUM, NAME, UNIT = U64(1), U64(2), U64(3)
# Units of measure.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l s sec min h hr hrs ms ns hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa "
    "bar k c f mph kmh kb mb gb tb inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers gram grams "
    "kilogram kilograms pound pounds ounce ounces liter liters litre litres second seconds minute minutes hour hours day days week weeks "
    "month months year years dollar dollars euro euros cent cents percent degree degrees"
).split()

_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _unit_hashes() -> np.ndarray:
    data, off = spaced(np.frombuffer("".join(UNITS).encode(), np.uint8), np.concatenate(([0], np.cumsum([len(u) for u in UNITS]))))
    return np.sort(hash_spans(data, *runs_of_words(data)))


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template, value, first token of each text): hashes of the tokens' templates and of their own strings."""
    buf, begin = spaced(data, off)
    word = _WORD[buf]
    inner = np.flatnonzero((buf == 46) | (buf == 44))
    inner = inner[(inner > 0) & (inner < len(buf) - 1)]
    word[inner[_DIGIT[buf[inner - 1]] & _DIGIT[buf[inner + 1]]]] = True
    low = np.where(word, LOWER[buf], np.uint8(32))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    value = hash_spans(low, start, end)
    if not len(start):
        return value, value, np.zeros(len(off), np.int64)
    template = value.copy()
    first = buf[start]
    second = buf[np.minimum(start + 1, len(buf) - 1)]
    capital = (first >= 65) & (first <= 90) | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    # the text's last visible byte before the token tells whether a sentence starts
    visible = np.where(buf > 32, np.arange(len(buf)), -1)
    last = np.maximum.accumulate(visible)
    before = np.where(start > 0, last[np.maximum(start - 1, 0)], -1)
    text_of = np.searchsorted(begin, start, side="right") - 1
    opens = (before < begin[text_of]) | np.isin(buf[np.maximum(before, 0)], np.frombuffer(b".!?:\"'", np.uint8))
    lines = np.cumsum(buf == 10)
    opens |= lines[start] != lines[np.maximum(before, 0)]
    template[capital & ~opens] = NAME
    template[np.isin(value, _unit_hashes())] = UNIT
    template[_DIGIT[first]] = NUM
    return template, value, np.searchsorted(start, begin)


def windows(template: np.ndarray, first: np.ndarray, width: int, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's windows of ``width`` tokens that have words enough, or of all."""
    n = len(template) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h = np.zeros(n, U64)
    for i in range(width):
        h = mix(h + template[i : i + n] * U64(2 * i + 1))
    h += U64(width)
    plain = np.concatenate(([0], np.cumsum(template > U64(3))))
    text = np.searchsorted(first, np.arange(len(template) + 1), side="right")
    ok = (every | (2 * (plain[width:] - plain[:-width]) >= width)) & (text[:n] == text[width - 1 : width - 1 + n])
    at = np.flatnonzero(ok)
    return at, h[at]


class Index:
    """Window hashes of some benchmark items, sorted, and the items' tokens."""

    def __init__(self, items: list[tuple], width: int):
        self.items = []
        # windows of templates, and windows of values of the items that have no others
        found: tuple[list, list] = ([], [])
        for key, text in items:
            data = np.frombuffer((text or "").encode(), np.uint8)
            t, v, first = tokens(data, np.array([0, len(data)]))
            w = min(width, len(t))
            at, h = windows(t, np.array([0]), w) if w else (np.zeros(0, np.int64), np.zeros(0, U64))
            bare = w > 0 and not len(at)
            if bare:
                at, h = windows(v, np.array([0]), w, every=True)
            found[bare].append((h, np.full(len(at), len(self.items)), at, [w] * (len(at) > 0)))
            self.items.append((key, t, v, len(at), w))
        self.lists = []
        for parts in found:
            h, item, place = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, U64 if i == 0 else np.int64) for i in range(3))
            order = np.argsort(h, kind="stable")
            self.lists.append((h[order], item[order], place[order], sorted({w for p in parts for w in p[3]})))

    def matches(self, data: np.ndarray, off: np.ndarray, cover: float) -> list[tuple]:
        """(text, item, windows, found, slots, verbatim) of each contamination."""
        if not any(len(x[0]) for x in self.lists):
            return []
        t, v, first = tokens(data, off)
        out: list[tuple] = []
        pairs: dict[tuple[int, int], dict[int, list[int]]] = {}
        for bare, (known, item, place, widths) in enumerate(self.lists):
            for w in widths:
                a, h = windows(v if bare else t, first[:-1], w, every=bool(bare))
                i = np.searchsorted(known, h)
                hit = known[np.minimum(i, len(known) - 1)] == h
                at, low, high = a[hit], i[hit], np.searchsorted(known, h[hit], side="right")
                text = np.searchsorted(first[1:], at, side="right")
                for p, d, x, y in zip(at.tolist(), text.tolist(), low.tolist(), high.tolist()):
                    for k in range(x, y):
                        j = int(place[k])
                        pairs.setdefault((d, int(item[k])), {}).setdefault(p - j, []).append(j)
        for (d, i), diagonals in pairs.items():
            key, it, iv, total, w = self.items[i]
            found: set[int] = set()
            slots, verbatim = 0, True
            if len({j for js in diagonals.values() for j in js}) < cover * total:
                continue
            for shift, js in diagonals.items():
                place = np.unique((np.array(sorted(set(js)))[:, None] + np.arange(w)).ravel())
                place = place[it[place] <= U64(3)]
                a, b = iv[place], v[place + shift]
                _, seen = np.unique(a, return_inverse=True)
                if len(np.unique(np.stack((seen.astype(U64), b)), axis=1).T) != (seen.max() + 1 if len(seen) else 0):
                    continue  # one item value stands for two values of the text
                found.update(js)
                slots += len(place)
                verbatim &= bool((a == b).all())
            if found and len(found) >= cover * total:
                out.append((d, key, total, len(found), slots, verbatim))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, cover: float = 0.5, part_windows: int = 1 << 19, keys: tuple = ("doc_id",)) -> DataFrame:
    """(keys.., item_id, windows, found, slots, verbatim): one row per document and item."""
    spark = docs.sparkSession
    bound_batches(spark)
    kinds = {f.name: f.dataType for f in docs.schema}
    schema = ", ".join(f"{k} {kinds[k].simpleString()}" for k in keys) + ", item_id long, windows long, found long, slots long, verbatim boolean"

    def scan(index: Index) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def run(batches):
            for b in (x for whole in batches for x in pieces(whole, "text")):
                data, off = flat(b.column("text"))
                got = shared.value.matches(data, off, cover)
                if got:
                    own = [b.column(k).take(pa.array([g[0] for g in got])) for k in keys]
                    cols = [pa.array([g[i] for g in got], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), 1)]
                    yield pa.RecordBatch.from_arrays([*own, *cols], names=[*keys, "item_id", "windows", "found", "slots", "verbatim"])

        return docs.select(*keys, "text").mapInArrow(lean(run), schema)

    out, items, size = None, [], 0
    parts = []
    # the benchmark streams through the driver, one part at a time in an index
    for row in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        n = len(row[1] or "") // 2
        if items and size + n > part_windows:
            parts.append(scan(Index(items, width)))
            items, size = [], 0
        items.append((row[0], row[1]))
        size += n
    if items or not parts:
        parts.append(scan(Index(items, width)))
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
