"""A byte-level convolutional quality classifier in numpy.

Bytes are embedded, filters of eight bytes slide over the whole text in steps
of two, and each filter's largest response is taken in chunks that overlap by
half. A document's features are the largest and the mean of its chunks'
responses; a logistic unit makes them one probability. Training is Adam on the
log loss with gradients through the largest responses.

Fitting takes a bounded sample of labelled rows (``sample_rows``, of at most
``row_bytes`` each), balanced over the labels as far as they go; scoring runs
over every byte of every document.

Null and empty text: one chunk of padding, so a defined score. Repeated rows:
equal scores. No labels, or one label only: the score is the label's share
(1/2 without labels). Extra columns are passed through; one named ``score``
gives way to the result's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .bytesops import flat, ragged
from .common import bound_batches, crc_mod, lean, shield

WIDTH, STEP, HOP, DIM, FILTERS = 8, 2, 128, 8, 16


class ByteCNN:
    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, DIM)),
            "filter": rng.normal(0, 0.3, (WIDTH, DIM, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": rng.normal(0, 0.1, 2 * FILTERS),
            "shift": np.zeros(1),
        }
        self.constant: float | None = None

    def tables(self) -> np.ndarray:
        """A filter's response to each byte at each of its places."""
        return np.einsum("bd,jdf->jbf", self.p["embed"], self.p["filter"]).astype(np.float32)

    @staticmethod
    def lay_out(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts one behind another, each padded with zero bytes to whole hops, one at least."""
        n = np.diff(off)
        hops = np.maximum(-(-(n + WIDTH) // HOP), 1)
        first = np.cumsum(hops) - hops
        buf = np.zeros(int(hops.sum()) * HOP + WIDTH, np.uint8)
        buf[ragged(first * HOP, n)] = data
        return buf, first, hops

    def _hops(self, buf: np.ndarray, tables: np.ndarray, want_at: bool, last: np.ndarray):
        """Each hop's largest response per filter, and where. ``last``: the hops that end a text."""
        per = HOP // STEP
        total = (len(buf) - WIDTH) // HOP
        best = np.empty((total, FILTERS), np.float32)
        at = np.empty((total, FILTERS), np.int64) if want_at else None
        some = 1024
        for a in range(0, total, some):
            b = min(total, a + some)
            n = (b - a) * per
            acc = tables[0][buf[a * HOP : a * HOP + n * STEP : STEP]]
            for j in range(1, WIDTH):
                acc += np.take(tables[j], buf[a * HOP + j : a * HOP + j + n * STEP : STEP], axis=0)
            acc = acc.reshape(b - a, per, FILTERS)
            # behind a text's padding the filters would see the next text
            ends = last[np.searchsorted(last, a) : np.searchsorted(last, b)] - a
            acc[ends, per - (WIDTH // STEP - 1) :] = -1e9
            if want_at:
                k = acc.argmax(axis=1)
                best[a:b] = np.take_along_axis(acc, k[:, None], 1)[:, 0]
                at[a:b] = (np.arange(a, b)[:, None] * per + k) * STEP
            else:
                best[a:b] = acc.max(axis=1)
        return best, at

    @staticmethod
    def _chunks(best: np.ndarray, first: np.ndarray, hops: np.ndarray):
        """A chunk is two neighbouring hops of a text, or its only one."""
        nxt = np.arange(1, len(best) + 1)
        nxt[first + hops - 1] -= 1
        later = best[nxt] > best
        return np.where(later, best[nxt], best), nxt, later

    def features(self, buf, first, hops, tables=None):
        best, _ = self._hops(buf, self.tables() if tables is None else tables, False, first + hops - 1)
        chunk, _, _ = self._chunks(best, first, hops)
        chunk = np.maximum(chunk + self.p["bias"].astype(np.float32), 0)
        return np.concatenate((np.maximum.reduceat(chunk, first, axis=0), np.add.reduceat(chunk, first, axis=0) / hops[:, None]), axis=1)

    def score(self, data: np.ndarray, off: np.ndarray, tables=None) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(off) - 1, self.constant)
        if len(off) == 1:
            return np.zeros(0)
        h = self.features(*self.lay_out(data, off), tables)
        return 1 / (1 + np.exp(-np.clip(h @ self.p["out"] + self.p["shift"][0], -30, 30)))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 12, lot: int = 32, rate: float = 0.01, seed: int = 2) -> "ByteCNN":
        labels = np.asarray(labels, float)
        if len(labels) == 0 or labels.min() == labels.max():
            self.constant = float(labels[0]) if len(labels) else 0.5
            return self
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        total = epochs * -(-len(texts) // lot)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), lot):
                pick = order[i : i + lot]
                g = self._gradient([texts[k] for k in pick], labels[pick])
                step += 1
                lr = rate * (1 - 0.9 * step / total)
                for k, v in g.items():
                    m[k] += 0.1 * (v - m[k])
                    s[k] += 0.001 * (v * v - s[k])
                    self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradient(self, texts: list[bytes], y: np.ndarray) -> dict:
        data = np.frombuffer(b"".join(texts), np.uint8)
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        buf, first, hops = self.lay_out(data, off)
        best, at = self._hops(buf, self.tables(), True, first + hops - 1)
        chunk, nxt, later = self._chunks(best, first, hops)
        own = np.repeat(np.arange(len(first)), hops)
        pre = chunk + self.p["bias"]
        act = np.maximum(pre, 0)
        top = np.maximum.reduceat(act, first, axis=0)
        h = np.concatenate((top, np.add.reduceat(act, first, axis=0) / hops[:, None]), axis=1)
        z = h @ self.p["out"] + self.p["shift"][0]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        up = d[:, None] * self.p["out"]
        # the largest chunk of a text gets the first half; ties share it
        most = act == top[own]
        share = np.add.reduceat(most.astype(float), first, axis=0)
        g = (most * (up[:, :FILTERS] / share)[own] + (up[:, FILTERS:] / hops[:, None])[own]) * (pre > 0)
        rows, cols = np.nonzero(g)
        w = g[rows, cols]
        src = np.where(later[rows, cols], nxt[rows], rows)
        place = at[src, cols]
        table = np.zeros((WIDTH, 256, FILTERS))
        for j in range(WIDTH):
            np.add.at(table[j], (buf[place + j], cols), w)
        return {
            "embed": np.einsum("jbf,jdf->bd", table, self.p["filter"]) + 1e-5 * self.p["embed"],
            "filter": np.einsum("bd,jbf->jdf", self.p["embed"], table) + 1e-5 * self.p["filter"],
            "bias": g.sum(axis=0),
            "out": h.T @ d + 1e-4 * self.p["out"],
            "shift": np.array([d.sum()]),
        }


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, row_bytes: int = 1 << 16) -> ByteCNN:
    """Fit on at most ``sample_rows`` labelled ids outside the held-out fold, chosen by a hash of the id.

    Rows of such an id that repeat are one; of ids with several texts, twice ``sample_rows`` rows at most
    are taken, by a hash of id and text, so the same rows give the same model.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
    picked = None
    for q in (0, 1):
        part = usable.where(F.col("quality") == q).select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows // 2)
        picked = part if picked is None else picked.unionByName(part)
    # the bound on rows is a bound on what is broadcast and on what the driver gets
    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .where(F.octet_length("text") <= row_bytes)
        .join(F.broadcast(picked), "doc_id")
        .select("quality", "text", F.xxhash64("doc_id", "text").alias("place"))
        .distinct()
        .orderBy("place", "text", "quality")
        .limit(2 * sample_rows)
        .toArrow()
    )
    texts = [t.encode() for t in rows.column("text").to_pylist()]
    y = np.array(rows.column("quality").to_pylist(), float)
    order = np.array(sorted(range(len(texts)), key=lambda i: (texts[i], y[i])), int)
    return ByteCNN().fit([texts[i] for i in order], y[order])


def score_documents(docs: DataFrame, model: ByteCNN, text: str = "text") -> DataFrame:
    """Add ``score`` to every row."""
    bound_batches(docs.sparkSession)
    docs, back = shield(docs, text)
    schema = StructType(list(docs.schema) + list(_parse_datatype_string("score double")))
    names = [x.name for x in schema[:-1]]

    def run(batches):
        tables = model.tables()
        for b in batches:
            data, off = flat(b.column(text))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(model.score(data, off, tables))], names=[*names, "score"])

    return back(docs.mapInArrow(lean(run), schema))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
