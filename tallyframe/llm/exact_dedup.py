"""Exact dedup by Patricia-trie owners.

Two passes of the same trie. On the map side each task inserts its own texts, so that a text with a million copies
leaves a task once, with a count and the smallest owner. Those class rows go to partitions by length and content hash,
where the full byte strings are inserted again and each terminal node gets the owner of the whole table. Only counts
and owners of a text meet there, never the list of its rows: rows find their class by a join on the task's class number.

A trie's key is the content hash, the length and then the whole normalised text, so that a terminal node means equal
bytes, not equal hashes. A trie over its memory bound spills by subtree: the heaviest subtrees (by first byte of the
hash) go to files in the task's temp folder, later keys of theirs follow, and each is built by itself afterwards.

Defined results: a null text counts as empty; texts are equal if identical after lower-casing A-Z; a null id never
owns a text that a row with an id has; of rows alike in id the one read first stays; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import pickle
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread

#: Bytes of keys that a trie keeps in memory before it spills.
TRIE_BYTES = 48 << 20
#: Bytes of texts that a map task holds before it hands over its classes.
MAP_BYTES = 32 << 20


def normalise(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z alone


class Trie:
    """A compressed radix trie over byte strings. A node is [label, children by first byte, terminal value]."""

    def __init__(self):
        self.root: list = [b"", {}, None]
        self.bytes = 0

    def insert(self, key: bytes) -> list:
        """The terminal node of the key, made if need be; its value is for the caller to set."""
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = node[1][key[at]] = [key[at:], {}, None]
                self.bytes += len(key) - at + 200
                return child
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _common(label, key, at)
            upper = node[1][key[at]] = [label[:same], {label[same]: child}, None]
            child[0] = label[same:]
            self.bytes += 200
            node, at = upper, at + same
        return node

    def terminals(self) -> Iterator[tuple[bytes, list]]:
        """Every terminal with its key, in order of keys."""
        stack = [(self.root, b"")]
        while stack:
            node, before = stack.pop()
            key = before + node[0]
            if node[2] is not None:
                yield key, node
            stack.extend((node[1][b], key) for b in sorted(node[1], reverse=True))


def _common(label: bytes, key: bytes, at: int) -> int:
    """Bytes at the front of label that key has from there on; they differ somewhere."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if key.startswith(label[:mid], at):
            low = mid
        else:
            high = mid - 1
    return low


def merge(value: list | None, rank: tuple, count: int, member: int) -> list:
    """A terminal's value: smallest rank, rows, and the numbers of the classes that met."""
    if value is None:
        return [rank, count, [member]]
    value[0] = min(value[0], rank)
    value[1] += count
    value[2].append(member)
    return value


def owners(entries: Iterable[tuple[bytes, tuple, int, int]], limit: int = TRIE_BYTES, depth: int = 0) -> Iterator[list]:
    """Values of all terminals for entries (key, rank, count, class). Over the limit, subtrees spill to files and follow one by one."""
    trie, files = Trie(), {}
    try:
        for entry in entries:
            key, rank, count, member = entry
            branch = key[depth] if depth < len(key) else -1
            if branch in files:
                pickle.dump(entry, files[branch])
                continue
            node = trie.insert(key)
            node[2] = merge(node[2], rank, count, member)
            if trie.bytes > limit and depth < 8:
                _spill(trie, files, depth, limit)
        for _, node in trie.terminals():
            yield node[2]
        trie = None
        for f in files.values():
            f.seek(0)
            yield from owners(_read(f), limit, depth + 1)
            f.close()
    finally:
        for f in files.values():
            f.close()


def _spill(trie: Trie, files: dict, depth: int, limit: int) -> None:
    """Moves subtrees to files, heaviest first, until half of the limit is free."""
    groups: dict[int, list] = {}
    for key, node in trie.terminals():
        groups.setdefault(key[depth] if depth < len(key) else -1, []).append((key, node[2]))
    order = sorted(groups, key=lambda b: -sum(len(k) for k, _ in groups[b]))
    kept = Trie()
    trie.root, trie.bytes = kept.root, 0
    for i, b in enumerate(order):
        if i < (len(order) + 1) // 2:
            files[b] = tempfile.TemporaryFile()
            for key, (rank, count, members) in groups[b]:
                pickle.dump((key, rank, count, members[0]), files[b])
                for other in members[1:]:
                    pickle.dump((key, rank, 0, other), files[b])
        else:
            for key, value in groups[b]:
                trie.insert(key)[2] = value


def _read(f) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _local(largest: bool):
    """Map side: rows with their class number; a class's first row carries the text, later the summary row its rank and count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, row = TaskContext.get().partitionId() << 33, 0
        trie, rows, number = Trie(), [], 0
        columns = ["rid", "id", "cid", "sha", "key", "best_id", "best_none", "best_rid", "n"]

        def flush() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["rid", "id", "cid", "sha"], dtype=object)
            tops = [(v[2][0], k, v[0][1], v[0][0], v[0][2], v[1]) for k, v in ((k, node[2]) for k, node in trie.terminals())]
            tops = pd.DataFrame(tops, columns=["cid", "key", "best_id", "best_none", "best_rid", "n"], dtype=object)
            both = pd.concat([out, tops])[columns]
            return both.assign(**{c: pd.array(both[c].where(both[c].notna(), None), "Int64") for c in columns if c not in ("sha", "key")})

        for batch in batches:
            for i, none, text in zip(batch["id"].tolist(), batch["none"].tolist(), batch["text"].tolist(), strict=True):
                i = None if none else i
                body = normalise(text)
                sha = hashlib.sha256(body)
                key = sha.digest()[:8] + struct.pack(">Q", len(body)) + body
                node = trie.insert(key)
                rid = base + row
                rank = (1, 0, rid) if i is None else (0, -i if largest else i, rid)
                if node[2] is None:
                    node[2] = [rank, 1, [base + number]]
                    number += 1
                else:
                    node[2][0] = min(node[2][0], rank)
                    node[2][1] += 1
                rows.append((rid, i, node[2][2][0], sha.hexdigest()))
                row += 1
                if trie.bytes > MAP_BYTES or len(rows) >= 20_000:
                    yield flush()
                    trie, rows = Trie(), []
        if rows:
            yield flush()

    return run


def _final(largest: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def entries():
            for b in batches:
                for key, none, best, rid, n, cid in zip(b["key"], *(b[c].tolist() for c in ("best_none", "best_id", "best_rid", "n", "cid")), strict=True):
                    yield bytes(key), (none, best, rid), n, cid

        out: list[tuple] = []
        for (none, best, rid), n, members in owners(entries()):
            keep = None if none else (-best if largest else best)
            out += [(cid, keep, rid, n) for cid in members]
            if len(out) > 20_000:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    def _frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.array(v, "Int64") for c, v in zip(("cid", "keep_id", "keep_rid", "group_size"), zip(*out, strict=True), strict=True)})

    return run


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """A row for each row of docs: id_col, keep_id, group_size, kept, text_sha256. keep: the 'smallest' or 'largest' id of equal texts stays."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")
    own = F.col(id_col).cast("long")  # pandas has no null integers
    rows = spread(docs.select(F.coalesce(own, F.lit(0)).alias("id"), own.isNull().alias("none"), F.col(text_col).alias("text")))
    largest = keep == "largest"
    local = cut(rows.mapInPandas(_local(largest), "rid long, id long, cid long, sha string, key binary, best_id long, best_none long, best_rid long, n long"), "trie-classes")
    classes = local.where("key is not null").select("cid", "key", "best_id", "best_none", "best_rid", "n")
    shuffled = classes.repartition(F.substring("key", 1, 16))  # the content hash and the length
    whole = shuffled.mapInPandas(_final(largest), "cid long, keep_id long, keep_rid long, group_size long")
    members = local.where("key is null").select("rid", "id", "cid", "sha")
    return members.join(whole, "cid").select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256")
    )
