"""Chat formatting over a prefix tree.

Conversations that begin with the same turns share them. A node of the tree is a distinct run of first turns; its
segment, the formatted last turn, is emitted once, in depth-first order over the whole table. A node gets its place in
the emitted stream, the position id of its first token (the tokens of its ancestors), and the intervals of the stream
that its ancestors take: a token attends to these and to its own segment up to itself. Ancestors that stand next to
each other share an interval.

How the tree is built without gathering one: a turn's node is a chained hash over the turns up to it, made in one
streaming pass over rows sorted by conversation. A conversation's path, the hashes of its nodes one after the other,
sorts lexicographically in depth-first order; a range sort gives each conversation its rank, and a node belongs to the
least rank that has it. Nodes ordered by (rank, depth) are the depth-first order, and places are running sums inside the
sorted partitions plus the partitions' totals. A first turn that a third of all conversations share is one row after
the map side has combined it.

Template: `[INST]role[TEXT]text[/INST]`, for an assistant `<s>text</s>`. In roles and texts a backslash is doubled and
a control string gets a backslash after its first character; both are undone when reading. The loss mask covers the
texts of assistants.

Defined results: a null text or role counts as empty; rows of a null conv_id are one conversation; equal turn numbers
are ordered by role and text, null turns first; repeated rows are turns of their own; an empty table gives an empty one.
Tokens are code points, or ids of a tokenizer that is given; each segment is tokenised by itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

#: The control strings of the template.
CONTROL = ("[INST]", "[TEXT]", "[/INST]", "<s>", "</s>")
_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"\[INST\](.*?)\[TEXT\](.*?)\[/INST\]|<s>(.*?)</s>", re.DOTALL)
ASSISTANT = "assistant"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and where the loss mask begins and ends in it (code points)."""
    if role == ASSISTANT:
        body = f"<s>{escape(text)}</s>"
        return body, 3, len(body) - 4
    return f"[INST]{escape(role)}[TEXT]{escape(text)}[/INST]", 0, 0


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted conversation."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        out.append((ASSISTANT, unescape(m[3])) if m[3] is not None else (unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return out


TURNS = "cid long, id long, k int, node binary, parent binary, segment string, loss_from int, loss_to int, length int, position long, path binary, ids array<int>"


def _chain(tokenizer_path: str | None):
    """A streaming pass over rows sorted by conversation and turn: what TURNS says, the path on each conversation's last turn."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = None
        if tokenizer_path:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(tokenizer_path)
        base, number, now, last = TaskContext.get().partitionId() << 33, -1, object(), None
        node, path, k, position = b"", bytearray(), 0, 0
        for batch in batches:
            out = []
            for conv, none, role, text in zip(*(batch[c].tolist() for c in ("id", "none", "role", "text")), strict=True):
                conv = None if none else conv
                if number < 0 or conv != now:
                    if last is not None:
                        out.append((*last[:10], bytes(path), last[11]))
                        last = None
                    number, now = number + 1, conv
                    node, path, k, position = b"", bytearray(), 0, 0
                if last is not None:
                    out.append(last)
                role, text = role or "", text or ""
                body, start, end = segment(role, text)
                parent, head = node, role.encode()
                node = hashlib.blake2b(parent + len(head).to_bytes(8, "big") + head + text.encode(), digest_size=16).digest()
                path += node[:8]
                ids = tokenizer.encode(body, add_special_tokens=False).ids if tokenizer else None
                length = len(body) if ids is None else len(ids)
                last = (base + number, conv, k, node, parent, body, start, end, length, position, None, ids)
                k, position = k + 1, position + length
            if out:
                yield _turns(out)
        if last is not None:
            yield _turns([(*last[:10], bytes(path), last[11])])

    return run


def _turns(rows: list[tuple]) -> pd.DataFrame:
    columns = ["cid", "id", "k", "node", "parent", "segment", "loss_from", "loss_to", "length", "position", "path", "ids"]
    return pd.DataFrame(rows, columns=columns).assign(id=pd.array([r[1] for r in rows], "Int64"))


def _ancestors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For rows sorted by conversation and depth: each node that belongs to the conversation, with its ancestors' intervals."""
    now, spans = None, []
    for batch in batches:
        out = []
        for cid, node, start, length, own in zip(batch["cid"].tolist(), batch["node"], batch["start"].tolist(), batch["length"].tolist(), batch["own"].tolist(), strict=True):
            if cid != now:
                now, spans = cid, []
            if own:
                out.append((node, [{"start": a, "end": b} for a, b in spans]))
            if spans and spans[-1][1] == start:
                spans[-1] = (spans[-1][0], start + length)
            else:
                spans.append((start, start + length))
        yield pd.DataFrame(out, columns=["node", "ancestors"])


def build(rows: DataFrame, tokenizer_path: str | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The tree and the paths.

    Tree: a row for each node: node, parent (empty for a first turn), depth, segment, loss_from, loss_to, length, ids,
    start (place in the stream), position (id of the first token), ancestors (intervals of the stream), conversations.
    Paths: a row for each turn: cid (a number for the conversation), id_col, k (from 0), node.
    """
    own = F.col(id_col).cast("long")  # pandas has no null integers
    picked = rows.select(F.coalesce(own, F.lit(0)).alias("id"), own.isNull().alias("none"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    sorted_rows = picked.repartition(F.xxhash64("id", "none")).sortWithinPartitions("none", "id", "turn", "role", "text")
    turns = cut(sorted_rows.mapInPandas(_chain(tokenizer_path), TURNS), "chat-turns")
    ends = turns.where(F.col("path").isNotNull()).select("cid", "path").orderBy("path", "cid")
    ranks = cut(ends.select("cid", F.monotonically_increasing_id().alias("rank")), "chat-ranks")  # grows along the sort
    same = ["k", "parent", "segment", "loss_from", "loss_to", "length", "ids", "position"]  # alike for all turns of a node
    nodes = turns.join(ranks, "cid").groupBy("node").agg(F.min("rank").alias("rank"), F.count("*").alias("conversations"), *(F.first(c).alias(c) for c in same))
    placed = cut(nodes.orderBy("rank", "k").withColumn("seq", F.monotonically_increasing_id()), "chat-nodes")
    placed = placed.withColumn("part", F.shiftrightunsigned("seq", 33))
    running = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("length").alias("n")).orderBy("part").collect()  # a number for each partition
    before, sums = 0, []
    for r in totals:
        sums.append((r["part"], before))
        before += r["n"]
    bases = small(rows.sparkSession.createDataFrame(sums, "part long, base long"))
    started = placed.withColumn("own", F.coalesce(F.sum("length").over(running), F.lit(0))).join(bases, "part").withColumn("start", F.col("base") + F.col("own")).drop("own", "base", "part", "seq")
    started = cut(started, "chat-tree")
    walk = turns.select("cid", "k", "node").join(ranks, "cid").join(started.select("node", "start", "length", F.col("rank").alias("owner")), "node")
    walk = walk.select("cid", "k", "node", "start", "length", (F.col("rank") == F.col("owner")).alias("own"))
    intervals = walk.repartition("cid").sortWithinPartitions("cid", "k").mapInPandas(_ancestors, "node binary, ancestors array<struct<start: long, end: long>>")
    tree = started.join(intervals, "node").withColumnRenamed("k", "depth").drop("rank")
    return tree, turns.select("cid", F.col("id").alias(id_col), "k", "node")


def formatted(tree: DataFrame, paths: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Segments of each conversation in order, read from the emitted tree: cid, id_col, k, segment, loss_from, loss_to."""
    return paths.join(tree.select("node", "segment", "loss_from", "loss_to"), "node").select("cid", id_col, "k", "segment", "loss_from", "loss_to")


def digests(segments: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """A row for each conversation, read back from its segments: id_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None

        def done() -> tuple:
            return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

        for batch in batches:
            out = []
            for cid, conv, none, body, a, b in zip(*(batch[c].tolist() for c in ("cid", "id", "none", "segment", "loss_from", "loss_to")), strict=True):
                if cid != now:
                    if state:
                        out.append(done())
                    now, state = cid, [None if none else conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_back(body):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                loss = unescape(body[a:b])
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += len(body)
            yield _digests(out)
        if state:
            yield _digests([done()])

    def _digests(out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        return frame.assign(id=pd.array([r[0] for r in out], "Int64"))

    rows = segments.withColumn("none", F.col(id_col).isNull()).withColumn("id", F.coalesce(F.col(id_col), F.lit(0))).repartition("cid").sortWithinPartitions("cid", "k")
    return rows.mapInPandas(run, "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("id", id_col)
