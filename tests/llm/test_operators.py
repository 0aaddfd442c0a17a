"""The operators' queries against brute force, on texts with every odd case, and on empty tables."""

import collections
import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

from adspark.llm import (
    op1_ppm, op2_shards, op3_sentencepiece, op4_chat, op5_jaccard, op6_suffix_dedup, op7_decontaminate, op8_embeddings, op9_quality, op10_tokenstore,
)
from adspark.llm import queries as registered
from adspark.llm.common import pieces
from adspark.llm.suffix_array import repeated_starts, suffix_array


def collect(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def table(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def by_row(table, out, *cols):
    """Results beside the rows: equal (id, text) rows get equal results, so ids that are unique decide."""
    own = collections.defaultdict(list)
    for r in out:
        own[r["doc_id"]].append(tuple(r[c] for c in cols))
    count = collections.Counter(i for i, _ in table)
    assert {i: len(v) for i, v in own.items()} == dict(count)
    return own


def test_registered():
    names = registered.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(n for n in registered.queries() if not n.startswith(("op4", "op8"))))
def test_empty_table(spark, sf, name):
    assert registered.queries()[name](spark, sf[1]).collect() == []


# -- 1 -------------------------------------------------------------------------


def test_op1_codes_in_one_pass():
    """Codes hold each position's last symbols, and take few arrays as long as the text."""
    import tracemalloc

    texts = [b"", b"ab", "é".encode() * 5, b"", bytes(range(1, 200)), b"x"]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for order in range(8):
        want = [int.from_bytes((b"\xff" * 8 + t + b"\xff")[i + 8 - order : i + 9], "big") for t in texts for i in range(len(t) + 1)]
        code, first = op1_ppm.gram_codes(data, off, order)
        assert code.tolist() == want and first.tolist() == [0, 1, 4, 15, 16, 216]
    data = np.full(1 << 20, 97, np.uint8)
    tracemalloc.start()
    op1_ppm.gram_codes(data, np.array([0, len(data)]), 7)
    assert tracemalloc.get_traced_memory()[1] < 24 * len(data)
    tracemalloc.stop()


def test_op1(spark, sf, table):
    out = collect(op1_ppm.op1_ppm(spark, sf[0]))
    own = by_row(table, out, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7
    words = lambda t: (t or "").encode().lower().split()
    count = collections.Counter()
    for i, t in table:
        if crc(i) != 2:
            count.update(words(t) + [None])
    n, v = sum(count.values()), len(count)
    for i, t in table:
        w = words(t) + [None]
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        assert any(
            g[:4] == (crc(i) == 2, len(w), sum(count[x] > 0 for x in w), n) and math.isclose(g[4], base, rel_tol=1e-9) and g[5] < 0 for g in own[i]
        ), (i, own[i])


@pytest.mark.parametrize("least", [1, 3])
def test_op1_probabilities_sum_to_one(least):
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 101, rng.integers(0, 30)).astype(np.uint8)) for _ in range(200)]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    code, _ = op1_ppm.gram_codes(data, off, 3)
    grams, (k, n) = [None] * 4, op1_ppm.uniques(code)
    for o in range(3, -1, -1):
        if o < 3:
            k, n = op1_ppm.counted(k & np.uint64((1 << (8 * (o + 1))) - 1), n)
        ok = n >= (least if o > 1 else 1)
        grams[o] = (k[ok], n[ok])
    model = op1_ppm.Model(grams)
    ctx = np.unique(np.concatenate((code >> np.uint64(8), rng.integers(0, 1 << 24, 50).astype(np.uint64))))
    every = (ctx[:, None] << np.uint64(8)) | np.arange(256, dtype=np.uint64)[None]
    assert np.allclose((10 ** model.log10(every.ravel())).reshape(-1, 256).sum(axis=1), 1, atol=1e-5)


@pytest.mark.parametrize("cache", [1 << 3, 1 << 23])
def test_op1_whole_trie(spark, sf, table, monkeypatch, cache):
    """Scores are those of one trie of all n-grams with FLOOR occurrences, in however many buckets and whatever is known beforehand."""
    monkeypatch.setattr(op1_ppm, "CACHE", cache)
    monkeypatch.setattr(op1_ppm, "SEND", 5000)
    out = collect(op1_ppm.op1_ppm(spark, sf[0]))
    own = by_row(table, out, "score")
    texts = [(t or "").encode() for i, t in table if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    spans = lambda x: (np.frombuffer(b"".join(x), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in x]))))
    k, n = op1_ppm.uniques(op1_ppm.gram_codes(*spans(texts), op1_ppm.ORDER)[0])
    grams = []
    for o in range(op1_ppm.ORDER, -1, -1):
        grams.append(op1_ppm.kept(k, n, op1_ppm.FLOOR if o > 1 else 1))
        k, n = op1_ppm.counted(k & np.uint64((1 << (8 * o)) - 1), n)
    model = op1_ppm.Model(grams[::-1])
    code, first = op1_ppm.gram_codes(*spans([(t or "").encode() for _, t in table]), op1_ppm.ORDER)
    for (i, _), want in zip(table, np.add.reduceat(model.log10(code), first)):
        assert any(math.isclose(g[0], want, rel_tol=1e-5) for g in own[i]), (i, own[i], want)


def plain_ppm(train: list[bytes], order: int, floor: int):
    """Prediction by partial matching by dictionaries, a symbol at a time: method D, symbols of longer contexts excluded."""
    pad = bytes([op1_ppm.END])
    grams: list = [collections.Counter() for _ in range(order + 1)]
    for t in train:
        x = pad * order + t + pad
        for p in range(order, len(x)):
            for k in range(order + 1):
                grams[k][x[p - k : p + 1]] += 1
    follow: list = [collections.defaultdict(dict) for _ in range(order + 1)]
    for k in range(order + 1):
        for g, n in grams[k].items():
            if n >= (floor if k > 1 else 1):
                follow[k][g[:-1]][g[-1]] = n

    def lost(k, ctx):
        """Occurrences of a context whose follower is not kept."""
        return sum(grams[k][ctx + bytes([s])] for s in range(256)) - sum(follow[k][ctx].values())

    def score(text: bytes) -> float:
        x, total = pad * order + text + pad, 0.0
        for p in range(order, len(x)):
            above: dict = {}
            for k in range(order, -1, -1):
                ctx = x[p - k : p]
                if ctx not in follow[k]:
                    continue
                rest = {s: n for s, n in follow[k][ctx].items() if s not in above}
                other = lost(k, ctx)
                if x[p] in rest:
                    total += math.log10((rest[x[p]] - 0.5) / (sum(rest.values()) + other))
                    break
                if rest or other:
                    total += math.log10((len(rest) / 2 + other) / (sum(rest.values()) + other))
                above = follow[k][ctx]
            else:
                total -= math.log10(256 - len(follow[0][b""]))
        return total

    return score


def test_op1_by_dictionaries(spark, tmp_path):
    rng = random.Random(3)
    words = ["ab", "abc", "Bab", "c a", "é", "zz"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for i in range(90)] + [(90, None), (91, ""), (92, "unseen Ω x"), (None, "ab abc")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    score = plain_ppm([(t or "").encode() for i, t in rows if not held(i)], op1_ppm.ORDER, op1_ppm.FLOOR)
    got = {r["doc_id"]: r["score"] for r in collect(op1_ppm.op1_ppm(spark, str(tmp_path)))}
    assert len(got) == len(rows)
    for i, t in rows:
        assert math.isclose(got[i], score((t or "").encode()), rel_tol=1e-4), (i, t, got[i], score((t or "").encode()))


def test_op1_adaptive(spark, docs):
    fresh, again = op1_ppm.AdaptivePPM(), op1_ppm.AdaptivePPM()
    once = fresh.log10(b"abracadabra")
    assert once < 0 and fresh.log10(b"abracadabra") > once and again.log10(b"") == -math.log10(256)
    assert op1_ppm.score_adaptive(docs.limit(5)).count() == 5


# -- 2 -------------------------------------------------------------------------


def test_op2(spark, sf, table):
    out = collect(op2_shards.op2_stratified_interleave(spark, sf[0]))
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in table), key=repr)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=repr) == want
    slots = collections.defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    n = [len(slots[s]) for s in range(8)]
    assert max(n) - min(n) <= 1 and sum(n) == len(table)
    of = collections.Counter(r["source"] for r in out)
    for (s, k), m in collections.Counter((r["source"], r["shard"]) for r in out).items():
        assert abs(m - of[s] / 8) <= 2


def test_op2_by_brute_force(spark, docs, monkeypatch):
    """The whole order from its definition, in whatever order rows come and in however many buckets, with columns of any name."""
    from fractions import Fraction

    from pyspark.sql import functions as F

    slim = docs.select("doc_id", "source", "text", F.lit("x").alias("shard"), F.lit(1).alias("_h"), F.lit(2).alias("_cut"), F.col("n_chars").alias("a`b"))
    slim = slim.unionByName(slim.where("doc_id < 30").withColumns({"doc_id": F.lit(None).cast("bigint"), "source": F.lit(None).cast("string")}))
    rows = [(r["doc_id"], r["source"], r["t"]) for r in slim.withColumn("t", op2_shards.row_hash(slim)).collect()]
    sources = collections.defaultdict(list)
    for i, s, t in rows:
        h = int(hashlib.md5(f"7:{'' if i is None else i}:{t}".encode()).hexdigest()[:15], 16)
        sources[s].append((h, t, i))
    order = sorted((Fraction(2 * k - 1, len(v)), (s is not None, (s or "").encode()), k, i) for s, v in sources.items() for k, (_, _, i) in enumerate(sorted(v, key=lambda x: x[:2]), 1))
    n = len(order)
    want = sorted(((p * 5 // n, p - -(-(p * 5 // n) * n // 5), i) for p, (*_, i) in enumerate(order)), key=repr)
    for size, df in ((4 << 20, slim), (1, slim.orderBy(F.desc("text"))), (64, slim.repartition(7))):
        monkeypatch.setattr(op2_shards, "BUCKET_BYTES", size)
        if size == 1:
            monkeypatch.setattr(op2_shards, "input_bytes", lambda df: 5000)
        out = op2_shards.interleave(df, shards=5)
        assert out.columns == ["doc_id", "source", "text", "_h", "_cut", "a`b", "shard", "slot"]
        assert sorted(((r["shard"], r["slot"], r["doc_id"]) for r in out.collect()), key=repr) == want


# -- 3 and 10 ------------------------------------------------------------------


def test_op3(spark, sf, table):
    import sentencepiece

    out = collect(op3_sentencepiece.op3_sentencepiece(spark, sf[0]))
    own = by_row(table, out, "ids", "round_trip", "parity")
    sp = sentencepiece.SentencePieceProcessor(model_file=op3_sentencepiece.model_file())
    for i, t in table:
        assert (sp.encode(t or ""), True, True) in own[i]


def test_pieces_of_a_batch():
    texts = ["a" * 700, None, "é" * 300, "", "b" * 2500, "c", "d" * 999, None]
    b = pa.record_batch({"id": list(range(8)), "text": texts})
    for whole in (b, b.slice(2, 5), b.slice(0, 0)):
        parts = list(pieces(whole, "text", 1000))
        assert [r for p in parts for r in p.to_pylist()] == whole.to_pylist()
        assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column("text").to_pylist()) <= 1000 for p in parts)
    assert len(list(pieces(b, "text", 1000))) == 4


def test_op3_a_task_keeps_no_threads():
    """A worker lives on between stages, and with it the threads of a library and their buffers."""
    code = """
import os, pyarrow as pa
from adspark.llm import op3_sentencepiece as op
texts = [" ".join(f"word{(i * j) % 5003}" for j in range(2000)) for i in range(300)] + [None, ""]
batch = pa.record_batch({"doc_id": list(range(len(texts))), "text": texts})
blob = open(op.model_file(), "rb").read()
before = len(os.listdir("/proc/self/task"))
out = list(op.encoded([batch], "text", ["doc_id"], blob, True))
after = len(os.listdir("/proc/self/task"))
assert sum(b.num_rows for b in out) == len(texts) and len(out) > 2, len(out)
assert all(x for b in out for c in ("round_trip", "parity") for x in b.column(c).to_pylist())
assert after <= before, (before, after)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    path = os.pathsep.join(p for p in (root, env.get("PYTHONPATH")) if p)
    done = subprocess.run([sys.executable, "-c", code], env=env | {"PYTHONPATH": path}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_op3_unigram_rebuild():
    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("▁ab", -1.0, 1), ("ab", -2.5, 1)]
    tok = op3_sentencepiece.build({"pieces": pieces, "kind": 1, "byte_fallback": False, "unk_id": 0, "charsmap": b"", "squeeze": False, "escape": True})
    assert tok.encode(" ab ab").ids == [4, 4] and tok.decode([4, 4]) == " ab ab"


def test_op3_parity_is_per_text():
    with open(op3_sentencepiece.model_file(), "rb") as f:
        coder = op3_sentencepiece.Codec(f.read())
    true = coder.reference

    class Other:
        def encode(self, texts, num_threads):
            return [[0] + x if "zebra" in t else x for t, x in zip(texts, true.encode(texts))]

    coder.reference = Other()
    for texts in (["a zebra ran", "a horse ran"], ["a horse ran", "", "my zebra ran"], ["zebra", "ran"]):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        coder.encode(data, np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
        assert coder.odd.tolist() == ["zebra" in t for t in texts]


def test_op10(spark, sf, table):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = collect(op10_tokenstore.op10_tokenstore(spark, sf[0]))
    assert len(out) == len(table) and all(r["keyed"] for r in out)
    enc = lambda t: np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
    want = collections.Counter((i, len(e), zlib.crc32(e)) for i, t in table for e in [enc(t)])
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == want
    at = 0
    for r in sorted(out, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: -math.inf if i is None else i)


def test_op10_large_catalogue(spark, sf, monkeypatch):
    """Past the bound of the broadcast the shards are shuffled to their offsets; the rows are the same."""
    small = collect(op10_tokenstore.op10_tokenstore(spark, sf[0]))
    monkeypatch.setattr(op10_tokenstore, "SMALL_CATALOGUE", 0)
    key = lambda r: r["start"]
    assert sorted(collect(op10_tokenstore.op10_tokenstore(spark, sf[0])), key=key) == sorted(small, key=key)


def test_op10_special_tokens_are_the_librarys():
    """Strings of the vocabulary's added tokens get the ids that a plain call of the library gives, wherever they stand."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        coder = op10_tokenstore.encoder(f.read())
    texts = []
    for x in [t.content for t in tok.get_added_tokens_decoder().values()]:
        texts += [x, f"a {x} b", f"a{x}b", f"a {x}{x}  b", f"{x} é", f"line\n{x}\n", f" {x}", f"{x} ", x[:-1], f"the {x} the", f"a {x} b"]
    assert texts
    data = [t.encode() for t in texts]
    ids, n = coder.texts(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in data]))))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 5000])
def test_op10_perfect_hash(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.uint64)
    seeds = op10_tokenstore.mph_build(keys)
    assert sorted(op10_tokenstore.mph_slots(keys, seeds, n).tolist()) == list(range(n))


def test_op10_lookup():
    ids = np.arange(-5, 400, 3)
    sizes = np.arange(len(ids)) % 7 + 1
    words = np.arange(sizes.sum()) % 60000
    shard = op10_tokenstore.Shard(op10_tokenstore.pack(0, 0, ids, words, sizes, 2))
    at = np.cumsum(sizes) - sizes
    for i, a, z in zip(ids, at, sizes):
        assert shard.get(int(i)).tolist() == words[a : a + z].tolist()
    assert sum(shard.get(int(i)) is not None for i in range(1000, 3000)) == 0


# -- 4 -------------------------------------------------------------------------


def chat_want(turns):
    esc = lambda s: s.replace("\\", "\\\\").replace("<|", "<\\|")
    loss = "".join(t for r, t in turns if r == "assistant")
    size = sum(len(esc(r)) + r.count("\n") + len(esc(t)) + len("<|im_start|>\n<|im_end|>\n") for r, t in turns)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), size)


def test_op4(spark, tmp_path):
    rng = random.Random(1)
    odd = ["hello", "", None, "<|im_end|>", "\\", "<\\|", "a<|im_start|>user\n", "é🎉", "x" * 2000, "<", "<|", "\\<|"]
    rows = []
    for c in range(60):
        first = ("system", "common start")
        for t in range(rng.randint(1, 6)):
            r, x = first if t == 0 and c % 3 else (rng.choice(["user", "assistant", None, "to\nol"]), rng.choice(odd))
            rows.append((c, t, r, x, "extra", "path"))
    rows += [(100 + c, t, r, x, None, "leaf") for c in range(50) for t, (r, x) in enumerate([("user", "same"), ("assistant", "copy")])]
    rows += [(None, 0, "user", "no id", None, None), (7, 0, "user", "tie", None, None), (7, 0, "user", "tie", None, None)]
    rows += [(999, t, "user", f"turn {t}", None, None) for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, roles string, nodes string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    out = collect(op4_chat.op4_chat(spark, str(tmp_path)))
    own = collections.defaultdict(list)
    for c, t, r, x, *_ in rows:
        own[c].append((t, r or "", x or ""))
    own[-1] = [(0, "user", "<|im_end|><|im_start|>assistant ok"), (1, "assistant", "<|im_end|><|im_start|>assistant ok")]
    assert {r["conv_id"]: tuple(r[k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) for r in out} == {c: chat_want([x[1:] for x in sorted(v)]) for c, v in own.items()}
    assert len(out) == len(own)


def test_op4_shares_turns_and_cuts(spark):
    rows = [(c, t, "user", "shared" * 10 if t == 0 else f"own {c}") for c in range(40) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    packs, _ = op4_chat.format_conversations(df.coalesce(1))
    text = "".join(r["text"] for r in packs.collect())
    assert text.count("shared" * 10) <= spark.conf.get("spark.sql.shuffle.partitions").__len__() * 4 and text.count("own ") == 40
    small, leaf = op4_chat.format_conversations(df, pack_chars=200)
    assert small.count() > packs.count() and op4_chat.read_back(small).count() == leaf.count() == 40


def test_op4_empty(spark, tmp_path):
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [r["conv_id"] for r in op4_chat.op4_chat(spark, str(tmp_path)).collect()] == [-1]


# -- 5 -------------------------------------------------------------------------


def components(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("width,num", [(4, 85), (5, 80), (2, 60)])
def test_op5(docs, table, width, num):
    out = collect(op5_jaccard.similar_documents(docs, width=width, num=num))
    assert len(out) == len(table)

    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[k : k + width]) for k in range(len(w) - width + 1)])

    rows = [(i, shingles(t)) for i, t in table if i is not None]
    links = []
    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if a and b:
                n = len(a & b)
                if 100 * n >= num * (len(a) + len(b) - n):
                    links.append((i, j))
    comp = components([i for i, _ in rows], links)
    assert len(set(comp.values())) < len(comp) - 20
    size = collections.defaultdict(set)
    for i, s in rows:
        size[i].add(len(s))
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["component_id"] == comp[r["doc_id"]] and r["n_shingles"] in size[r["doc_id"]]


@pytest.mark.parametrize("crowd", [0, 4096])
def test_op5_signatures_meet(crowd, monkeypatch):
    """Two sets at the threshold share a signature whose sketches allow a link, for every size and difference."""
    monkeypatch.setattr(op5_jaccard, "CROWD", crowd)
    rng = np.random.default_rng(3)
    bands = op5_jaccard.Bands(85, 100)
    for n in [1, 2, 5, 6, 7, 13, 40, 41, 100, 333, 1000]:
        for _ in range(10):
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            drop = rng.integers(0, int(n * 0.15) + 1)
            add = 0 if drop else max(0, min(int(n / 0.85) - n, 3))
            b = np.concatenate((a[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)))
            both = n - drop
            if 100 * both < 85 * (n + add) or both == 0:
                continue
            sets, sizes = np.concatenate((np.sort(a), np.sort(b))), np.array([len(a), len(b)])
            s, ahead, who = op5_jaccard.signatures(sets, sizes, bands)
            _, members = op5_jaccard._shared(s >> np.uint64(16), who, s & np.uint64(0xFFFF), ahead)
            assert set(members.tolist()) == {0, 1}, (n, drop, add)
            assert op5_jaccard.may_link(len(a), len(b), op5_jaccard.odd_sketch(np.sort(a)), op5_jaccard.odd_sketch(np.sort(b)), 85, 100)


# -- 6 -------------------------------------------------------------------------


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(1500):
        n, a = rng.randint(0, 40), rng.randint(1, 4)
        s = [rng.randrange(a) for _ in range(n)]
        if rng.random() < 0.3 and n:
            s = (s[: rng.randint(1, 4)] * 40)[:n]
        assert suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:])
    assert suffix_array(b"banana").tolist() == [5, 3, 1, 0, 4, 2]
    assert repeated_starts(b"abcabcx", 3).tolist() == [0, 3]


@pytest.mark.parametrize("length,hot", [(400, 256), (60, 256), (60, 1), (25, 2)])
def test_op6(docs, table, length, hot, monkeypatch):
    monkeypatch.setattr(op6_suffix_dedup, "HOT", hot)
    out = collect(op6_suffix_dedup.remove_repeats(docs, length=length))
    texts = [(i, (t or "").encode()) for i, t in table]
    starts = collections.Counter(b[p : p + length] for _, b in texts for p in range(len(b) - length + 1))
    want = collections.Counter()
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if starts[b[p : p + length]] > 1:
                gone[p : p + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        want[i, len(b), tuple(zip(edge[0::2].tolist(), edge[1::2].tolist())), np.frombuffer(b, np.uint8)[~gone].tobytes()] += 1
    got = collections.Counter((r["doc_id"], r["n_bytes"], tuple((x["start"], x["stop"]) for x in r["removed"]), bytes(r["kept"])) for r in out)
    assert got == want and sum(len(k[2]) for k in want) > 10


@pytest.mark.parametrize("words,hot", [(51, 256), (20, 256), (6, 1), (3, 2)])
def test_op6_passages(docs, table, words, hot, monkeypatch):
    """Passages are words in a row that start anywhere else too, whatever blanks part them; the bytes' results stay."""
    monkeypatch.setattr(op6_suffix_dedup, "HOT", hot)
    out = collect(op6_suffix_dedup.remove_repeats(docs, length=400, words=words))
    plain = collections.Counter((r["doc_id"], r["n_bytes"], str(r["removed"]), bytes(r["kept"])) for r in collect(op6_suffix_dedup.remove_repeats(docs, length=400)))
    assert plain == collections.Counter((r["doc_id"], r["n_bytes"], str(r["removed"]), bytes(r["kept"])) for r in out)
    texts = [(i, [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())]) for i, t in table]
    window = lambda w, p: tuple(x[2] for x in w[p : p + words])
    starts = collections.Counter(window(w, p) for _, w in texts for p in range(len(w) - words + 1))
    want = collections.Counter()
    for (i, w), (_, t) in zip(texts, table):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(w) - words + 1):
            if starts[window(w, p)] > 1:
                gone[w[p][0] : w[p + words - 1][1]] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        want[i, len(b), tuple(zip(edge[0::2].tolist(), edge[1::2].tolist()))] += 1
    assert want == collections.Counter((r["doc_id"], r["n_bytes"], tuple((x["start"], x["stop"]) for x in r["passages"])) for r in out)
    assert sum(len(k[2]) for k in want) > 10
    whole = collections.defaultdict(set)
    for i, t in table:
        whole[i].add((t or "").encode())
    for r in out:
        left = set()
        for b in whole[r["doc_id"]]:
            gone = np.zeros(len(b), bool)
            for x in r["removed"] + r["passages"]:
                gone[x["start"] : x["stop"]] = True
            left.add(np.frombuffer(b, np.uint8)[~gone].tobytes() if len(b) == r["n_bytes"] else b"")
        assert bytes(r["rest"]) in left


def test_op6_short_passages(spark, tmp_path):
    """A passage of 51 words under 400 bytes goes from the query's text, one of 50 stays; the contract's columns keep both."""
    rng = random.Random(8)
    make = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    long, short = make(51), make(50)
    around = [(make(30), make(30)) for _ in range(6)]
    texts = [f"{a} {long} {b}" for a, b in around[:2]] + [f"{a} {short} {b}" for a, b in around[2:4]] + [f"{a} {long.replace(' ', '  ')} {b}" for a, b in around[4:]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r for r in collect(op6_suffix_dedup.op6_suffix_dedup(spark, str(tmp_path)))}
    for i, t in enumerate(texts):
        assert len(long) < 400 and out[i]["n_bytes"] == len(t) and out[i]["n_removed"] == out[i]["n_spans"] == 0
        assert out[i]["kept_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert out[i]["text"] == (t if i in (2, 3) else "  ".join(around[i])) and out[i]["n_passages"] == (i not in (2, 3))


def test_op6_tables(docs, monkeypatch):
    """The tables between are gone when the spans are written, by bytes and by words."""
    import adspark.llm.common as common

    names, gone = [], []
    monkeypatch.setattr(op6_suffix_dedup, "materialize", lambda df, name, *a: (names.append(name), common.materialize(df, name, *a))[1])
    monkeypatch.setattr(op6_suffix_dedup, "release", lambda df: (gone.append(df), common.release(df)))
    op6_suffix_dedup.remove_repeats(docs, length=60, words=6).collect()
    assert names.count("spans") == 2 and names.count("removed") == 1 and len(gone) == len(names) - 3


# -- 7 -------------------------------------------------------------------------


def test_op7(spark):
    item = "If Anna drives 120 km in 3 hours from Lyon, how far does she drive in 7 hours at the same speed?"
    changed = item.replace("Anna", "Peter").replace("120", "95.5").replace("3", "2").replace("7", "11").replace("Lyon", "Turin")
    mixed = changed.replace("2 hours", "2 hours from 4").replace("km", "km")
    texts = [
        (1, "Some words before. " + item + " And after it."), (2, "Before it. " + changed), (3, "Nothing of the kind is written here, at all, I should think."), (4, None), (5, ""),
        (6, "If Anna drives 120 km in 3 hours from Lyon, then she stops."), (7, mixed), (None, item), (1, "Some words before. " + item + " And after it."),
    ]
    bench = spark.createDataFrame([(10, item), (11, "one two"), (12, None), (13, "")], "item_id bigint, text string")
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    out = op7_decontaminate.contaminated(docs, bench)
    assert sorted(((r["doc_id"] or 0, r["item_id"], r["verbatim"]) for r in out.collect())) == [(0, 10, True), (1, 10, True), (1, 10, True), (2, 10, False), (7, 10, False)]
    parts = op7_decontaminate.contaminated(docs, bench, part_windows=10)
    assert sorted(map(tuple, parts.collect()), key=repr) == sorted(map(tuple, out.collect()), key=repr)
    short = op7_decontaminate.contaminated(spark.createDataFrame([(1, "say one two now")], "doc_id bigint, text string"), bench)
    assert [r["item_id"] for r in short.collect()] == [11]


@pytest.mark.parametrize(
    "item",
    [
        "Solve 3x + 5y = 12 and 2x - 4y = 6.",
        "What is 125 + 37 - 48 * 2 + 19 - 7 * 3?",
        "Put Paris, London, Berlin, Madrid, Rome, Vienna, Lisbon and Oslo in order",
        "12 + 7 = 19",
    ],
)
def test_op7_few_words(item):
    index = op7_decontaminate.Index([(1, item), (2, "Tell me how the old mill by the river was ever built")], 8)
    texts = [f"Here it comes: {item} And then some more.", "What is 1 + 2 - 3 * 4 + 5 - 6 * 7? Solve 1x + 2y = 3 and 4x - 5y = 9.", "Put Kyiv, Riga, Bern, Bonn, Nice, Pisa, Cork and Turku in order", "tell me how the old mill by the river was ever built"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    found = index.matches(data, np.concatenate(([0], np.cumsum([len(t) for t in texts]))), 0.5)
    assert sorted((d, key, verbatim) for d, key, *_, verbatim in found) == [(0, 1, True), (3, 2, True)]


def plain_templates(text: str) -> list[tuple]:
    """(template, value) of each token; a template is a word or one of the three types."""
    b = text.encode()
    out = []
    for m in re.finditer(rb"(?:[0-9A-Za-z\x80-\xff]|(?<=[0-9])[.,](?=[0-9]))+", b):
        value = m[0].lower()
        before = re.search(rb"([^\x00-\x20])[\x00-\x20]*\Z", b[: m.start()])
        opens = before is None or before[1] in b".!?:\"'" or b"\n" in before[0]
        if m[0][:1].isdigit():
            kind = "number"
        elif value in {u.encode() for u in op7_decontaminate.UNITS}:
            kind = "unit"
        elif not opens and (b"A" <= m[0][:1] <= b"Z" or b"\xc3\x80" <= m[0][:2] <= b"\xc3\x9e"):
            kind = "name"
        else:
            kind = value
        out.append((kind, value))
    return out


def plain_contaminated(text: str, item: str, width: int, cover: float):
    """(windows, found, slots, verbatim) or None, by comparing every window with every other."""
    t, u = plain_templates(text), plain_templates(item)
    w = min(width, len(u))
    wordy = lambda x: 2 * sum(isinstance(k, bytes) for k, _ in x) >= w
    places = [j for j in range(len(u) - w + 1) if wordy(u[j : j + w])] if w else []
    bare = w > 0 and not places
    if bare:
        places = list(range(len(u) - w + 1))
    part = lambda x: [v if bare else k for k, v in x]
    diagonals = collections.defaultdict(set)
    for p in range(len(t) - w + 1):
        for j in places:
            if (bare or wordy(t[p : p + w])) and part(t[p : p + w]) == part(u[j : j + w]):
                diagonals[p - j].add(j)
    found, slots, verbatim = set(), 0, True
    for shift, js in diagonals.items():
        typed = sorted({j + x for j in js for x in range(w) if not isinstance(u[j + x][0], bytes)})
        stands = collections.defaultdict(set)
        for x in typed:
            stands[u[x][1]].add(t[x + shift][1])
        if all(len(v) == 1 for v in stands.values()):
            found |= js
            slots += len(typed)
            verbatim &= all(u[x][1] == t[x + shift][1] for x in typed)
    return (len(places), len(found), slots, verbatim) if found and len(found) >= cover * len(places) else None


def test_op7_by_brute_force(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("take the red box and go back to old mill then count it over again near our house".split())
    slot = lambda: rng.choice(["Anna", "Émile", "Bob", "12", "7.5", "1,000", "km", "hours", "kg", "3"])
    stop = lambda: rng.choice(["", "", "", "", ",", ".", "?\n", ":", "\n"])
    make = lambda n, share: " ".join((slot() if rng.random() < share else word()) + stop() for _ in range(n))
    items = [(i, make(rng.randint(1, 25), rng.choice([0.1, 0.3, 0.9]))) for i in range(25)] + [(25, ""), (26, None), (27, "7 km")]
    texts = []
    for i in range(120):
        base = rng.choice(items[:25])[1].split(" ")
        if rng.random() < 0.8:
            base = [rng.choice([slot(), x, x]) if x[:1].isdigit() or x[:1].isupper() else x for x in base]
        if rng.random() < 0.3 and len(base) > 4:
            base = base[: len(base) // 2] + [word()] + base[len(base) // 2 :]
        texts.append((i, f"{make(rng.randint(0, 12), 0.3)} {' '.join(base)} {make(rng.randint(0, 12), 0.3)}"))
    texts += [(120, None), (121, ""), (None, items[0][1])]
    out = op7_decontaminate.contaminated(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    want = collections.Counter((d, i, *x) for d, t in texts for i, u in items for x in [plain_contaminated(t or "", u or "", 8, 0.5)] if x)
    assert collections.Counter(map(tuple, out.select("doc_id", "item_id", "windows", "found", "slots", "verbatim").collect())) == want
    assert len(want) > 60 and {x[-1] for x in want} == {True, False}


def test_op7_slots():
    item = "add 5 apples to 5 pears and give back the 9 plums you took"
    index = op7_decontaminate.Index([(1, item)], 8)

    def found(t):
        data = np.frombuffer(t.encode(), np.uint8)
        return len(index.matches(data, np.array([0, len(data)]), 0.5))

    assert found(item.replace("5", "6")) == 1
    assert found("add 6 apples to 7 pears and give back the 9 plums you took") == 0  # the item's 5 cannot be both
    assert found("add 9 apples to 9 pears and give back the 9 plums you took") == 1  # a copy's new values may be equal


# -- 8 -------------------------------------------------------------------------


def test_op8(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op8_embeddings, "TILE", 16)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 12))
    near = [x[i % 10] + rng.normal(size=12) * rng.choice([0.02, 0.2, 0.35]) for i in range(120)]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate([*x, *near])]
    rows += [(1000, rows[3][1]), (1001, rows[3][1]), (1001, rows[3][1]), (1002, [2 * v for v in rows[3][1]]), (1003, [0.0] * 12), (1004, None), (1005, [1.0, None] + [0.0] * 10), (1006, [float("nan")] * 12)]
    rows += [(1007, [float("inf")] + [0.0] * 11), (1008, []), (1009, [1.0, 0.0]), (None, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = collect(op8_embeddings.near_pairs(df))
    assert len(out) == len(rows)
    good = [(i, np.array(e) / np.linalg.norm(e)) for i, e in rows if i is not None and e is not None and len(e) == 12 and None not in e and np.isfinite(e).all() and np.any(e)]
    links = [(a, b) for k, (a, u) in enumerate(good) for b, v in good[:k] if u @ v >= 0.95]
    n = collections.Counter(i for p in links for i in p)
    comp = components({i for i, _ in good}, links)
    assert len(links) > 200
    for r in out:
        i = r["vec_id"]
        want = (n[i] // (2 if i == 1001 else 1), comp[i]) if i in comp else (0, i)
        assert (r["n_links"], r["component_id"]) == want, i
        assert r["kept"] == (i is None or i == want[1])
    df.limit(0).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert op8_embeddings.op8_embeddings(spark, str(tmp_path)).count() == 0


def test_op8_lengths(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [1.0, 0.02]), (7, [1.0] * 5), (8, None)]
    out = collect(op8_embeddings.near_pairs(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 2, 4), (5, 2, 4), (6, 2, 4), (7, 0, 7), (8, 0, 8)]


def test_op8_disk_follows_the_vectors(spark, monkeypatch):
    """Tables written for many tiles hold about one copy of the vectors, not one for each two tiles or cells."""
    monkeypatch.setattr(op8_embeddings, "TILE", 64)
    x = np.random.default_rng(3).normal(size=(3000, 32))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    written = []
    keep = op8_embeddings.materialize

    def note(t, *args):
        out = keep(t, *args)
        written.append(sum(os.path.getsize(f.removeprefix("file:").replace("///", "/")) for f in out.inputFiles()))
        return out

    monkeypatch.setattr(op8_embeddings, "materialize", note)
    assert op8_embeddings.near_pairs(df).where("n_links = 0").count() == 3000
    assert x.nbytes <= sum(written) < 2 * x.nbytes


# -- 9 -------------------------------------------------------------------------


def test_op9(spark, sf, table):
    out = collect(op9_quality.op9_quality(spark, sf[0]))
    own = by_row(table, out, "held_out", "score", "predicted")
    for i, _ in table:
        for held, score, predicted in own[i]:
            assert 0 <= score <= 1 and predicted == (score >= 0.3)
            assert held == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0)


def test_op9_learns_and_reads_whole_texts():
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    good = [" ".join(word() for _ in range(rng.randint(5, 200))).encode() for _ in range(150)]
    bad = [b" ".join(w + b"###" for w in g.split()) for g in good[:75]]
    y = np.array([1] * 150 + [0] * 75)
    model = op9_quality.ByteCNN().fit(good[:100] + bad[:50], np.concatenate((y[:100], y[150:200])), epochs=40)
    flat = lambda ts: (np.frombuffer(b"".join(ts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in ts]))))
    s = model.score(*flat(good[100:] + bad[50:]))
    assert ((s >= 0.3) == np.array([1] * 50 + [0] * 25)).mean() > 0.95
    # texts are scored alone, whatever stands beside them, and to their ends
    assert np.allclose(s[3], model.score(*flat([good[103]])))
    long = good[100] * 20
    assert model.score(*flat([long]))[0] != model.score(*flat([long + b" " + bad[0]]))[0]


def test_op9_by_loops():
    """A text's score, filter by filter and place by place."""
    model = op9_quality.ByteCNN(5)
    rng = np.random.default_rng(2)
    model.p["bias"] += rng.normal(0, 0.3, op9_quality.FILTERS)
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 119, 120, 121, 128, 500, 1500)]
    got = model.score(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    W, H = op9_quality.WIDTH, op9_quality.HOP
    for t, score in zip(texts, got):
        hops = max(1, -(-(len(t) + W) // H))
        x = t + bytes(hops * H - len(t))
        top, mean = [], []
        for f in range(op9_quality.FILTERS):
            at = {p: sum(model.p["embed"][x[p + j]] @ model.p["filter"][j, :, f] for j in range(W)) for p in range(0, len(x) - W + 1, op9_quality.STEP)}
            best = [max(v for p, v in at.items() if p // H == h) for h in range(hops)]
            chunks = [max(0.0, max(best[h : h + 2]) + model.p["bias"][f]) for h in range(hops)]
            top.append(max(chunks))
            mean.append(sum(chunks) / hops)
        assert math.isclose(score, 1 / (1 + math.exp(-(np.array(top + mean) @ model.p["out"] + model.p["shift"][0]))), rel_tol=1e-4)


def test_op9_held_out(spark):
    """Of a held-out document marked good and one marked bad, the good one mostly scores higher."""
    top = "/root/testdata/sf0.01"
    marked = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{top}/labels.parquet").collect()}
    out = [r for r in collect(op9_quality.op9_quality(spark, top)) if r["held_out"] and r["doc_id"] in marked]
    good, bad = (np.array([r["score"] for r in out if marked[r["doc_id"]] == q]) for q in (1, 0))
    assert len(good) > 10 and len(bad) > 10
    assert (good[:, None] > bad[None]).mean() > 0.9
    assert np.mean([r["predicted"] == marked[r["doc_id"]] for r in out]) > 0.85


def test_op9_gradient():
    model = op9_quality.ByteCNN(3)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(97, 110, n).astype(np.uint8)) for n in (0, 5, 300, 700)]
    y = np.array([1.0, 0, 1, 0])

    def loss():
        data, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        p = model.score(data, off)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = model._gradient(texts, y)
    for name in ("out", "bias", "filter", "embed"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        was, eps = model.p[name][at], 1e-3
        model.p[name][at] = was + eps
        up = loss()
        model.p[name][at] = was - eps
        down = loss()
        model.p[name][at] = was
        assert math.isclose((up - down) / (2 * eps), g[name][at], rel_tol=0.1, abs_tol=1e-3), name
