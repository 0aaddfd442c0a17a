"""Chat formatting into depth-first packed prefix trees.

Conversations that share initial turns share a path of a prefix tree. A packed
sequence holds the turns of a tree depth-first, each shared turn once; a node
row says where its code points lie, which positions they have in their
conversation, and which intervals of the sequence they may attend to (its
ancestors' and its own). A conversation is a leaf's path.

Turns are written ``<|im_start|>role``, newline, text, ``<|im_end|>``, newline.
In roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so no
text can form a control string, and reading back undoes it. The loss mask
covers assistant texts.

Turn rows meet by conversation and are folded while sorted rows stream by, so
a conversation of any length needs one conversation's memory. Equal
conversations are one leaf. Leaves are sorted by path over range partitions:
shared turns are neighbours, and a first turn that a third of all
conversations share is cut into sequences at ``pack_chars`` code points and at
partition edges, where the shared turns are written again, once.

Null role or text: empty. Null conv_id: one conversation. Ties in turn go by
role, then text; repeated rows are repeated turns. A conversation has one turn
at least. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, bound_batches, materialize

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
PACK_CHARS = 1 << 17


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn's string and where its text lies in it."""
    # the first plain newline ends the role
    head = OPEN + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n((?:[^<\\]|\\.|<(?!\|))*)<\|im_end\|>\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def fold_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, path, roles, texts): one row per conversation; path chains 8-byte digests of its turns."""
    slim = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        own, roles, texts = None, [], []
        out: list[tuple] = []

        def close():
            path, node = [], b""
            for r, t in zip(roles, texts):
                rb, tb = r.encode(), t.encode()
                node = hashlib.blake2b(node + len(rb).to_bytes(8, "little") + rb + tb, digest_size=16).digest()
                path.append(node)
            out.append((own, b"".join(path), roles, texts))

        def batch():
            return pa.RecordBatch.from_arrays([
                pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()),
                pa.array([x[2] for x in out], pa.list_(pa.string())), pa.array([x[3] for x in out], pa.list_(pa.string())),
            ], names=["conv_id", "path", "roles", "texts"])

        for b in batches:
            for c, r, t in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
                if c != own:
                    if own is not None:
                        close()
                    own, roles, texts = c, [], []
                roles.append(r)
                texts.append(t)
            if out:
                yield batch()
                out = []
        if own is not None:
            close()
        if out:
            yield batch()

    return ordered.mapInArrow(run, "conv_id long, path binary, roles array<string>, texts array<string>")


NODE = "node int, parent int, start int, stop int, position int, text_start int, text_stop int, loss boolean, leaf binary, attend array<struct<start:int,stop:int>>"


def pack_trees(leaves: DataFrame, pack_chars: int = PACK_CHARS) -> DataFrame:
    """``leaves`` (path, roles, texts), all different: packed sequences (text, nodes)."""
    ordered = leaves.repartitionByRange("path").sortWithinPartitions("path")
    kind = pa.struct([
        ("node", pa.int32()), ("parent", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("position", pa.int32()), ("text_start", pa.int32()),
        ("text_stop", pa.int32()), ("loss", pa.bool_()), ("leaf", pa.binary()), ("attend", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
    ])

    def run(batches):
        parts: list[str] = []
        nodes: list[dict] = []
        stack: list[tuple[bytes, int]] = []  # digest and node of the current path
        size = 0

        def flush():
            nonlocal parts, nodes, stack, size
            row = pa.RecordBatch.from_arrays([pa.array(["".join(parts)]), pa.array([nodes], pa.list_(kind))], names=["text", "nodes"])
            parts, nodes, stack, size = [], [], [], 0
            return row

        for b in batches:
            for path, roles, texts in zip(*(b.column(x).to_pylist() for x in ("path", "roles", "texts"))):
                own = [path[i : i + 16] for i in range(0, len(path), 16)]
                if size and (stack[0][0] != own[0] and size >= pack_chars // 8 or size + sum(map(len, texts)) > pack_chars):
                    yield flush()
                same = 0
                while same < min(len(stack), len(own)) and stack[same][0] == own[same]:
                    same += 1
                del stack[same:]
                for d in range(same, len(own)):
                    s, a, z = format_turn(roles[d], texts[d])
                    parent = stack[-1][1] if stack else -1
                    up = nodes[parent] if stack else None
                    position = up["position"] + up["stop"] - up["start"] if up else 0
                    # neighbouring intervals are one
                    attend = [dict(x) for x in up["attend"]] if up else []
                    if attend and attend[-1]["stop"] == size:
                        attend[-1]["stop"] = size + len(s)
                    else:
                        attend.append({"start": size, "stop": size + len(s)})
                    nodes.append({
                        "node": len(nodes), "parent": parent, "start": size, "stop": size + len(s), "position": position,
                        "text_start": size + a, "text_stop": size + z, "loss": roles[d] == "assistant", "leaf": None, "attend": attend,
                    })
                    stack.append((own[d], len(nodes) - 1))
                    parts.append(s)
                    size += len(s)
                nodes[stack[-1][1]]["leaf"] = hashlib.blake2b(path, digest_size=16).digest()
        if size:
            yield flush()

    return ordered.mapInArrow(run, f"text string, nodes array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in re.split(r', (?![^<]*>)', NODE))}>>")


def read_back(packs: DataFrame) -> DataFrame:
    """One row per leaf, from the sequences alone: its digests."""

    def run(batches):
        for b in batches:
            out = []
            for text, nodes in zip(b.column("text").to_pylist(), b.column("nodes").to_pylist()):
                for x in nodes:
                    if x["leaf"] is None:
                        continue
                    whole = "".join(text[i["start"] : i["stop"]] for i in x["attend"])
                    if len(whole) != x["position"] + x["stop"] - x["start"]:
                        raise ValueError("positions and intervals disagree")
                    turns = parse(whole)
                    masked, at = [], x["node"]
                    while at >= 0:
                        y = nodes[at]
                        if y["loss"]:
                            masked.append(unescape(text[y["text_start"] : y["text_stop"]]))
                        at = y["parent"]
                    loss = "".join(reversed(masked))
                    out.append((
                        x["leaf"], len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                        len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole),
                    ))
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return packs.mapInArrow(run, "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(turns: DataFrame, pack_chars: int = PACK_CHARS) -> tuple[DataFrame, DataFrame]:
    """The packed sequences, and (conv_id, leaf) of every conversation."""
    spark = turns.sparkSession
    bound_batches(spark)
    convs = materialize(fold_conversations(turns), "conversations")
    # equal conversations have equal paths; a task and then a key combine them
    leaves = convs.groupBy("path").agg(F.first("roles").alias("roles"), F.first("texts").alias("texts"))
    packs = materialize(pack_trees(leaves, pack_chars), "packs")

    def names(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([hashlib.blake2b(p, digest_size=16).digest() for p in b.column("path").to_pylist()], pa.binary())], names=["conv_id", "leaf"])

    return packs, convs.select("conv_id", "path").mapInArrow(names, "conv_id long, leaf binary")


def op4_chat(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"))
    packs, leaf = format_conversations(turns)
    digests = materialize(read_back(packs), "leaves")
    return (
        materialize(leaf, "leaf")
        .join(digests, "leaf")
        .select(F.when(F.col("conv_id") == NULL_ID, None).otherwise(F.col("conv_id")).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    )
