"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle set: class c holds sizes in
(2^(c-1), 2^c]. A document is read, for class c, in blocks of U = 2^c shingles; two
neighbouring blocks make a window of 2U, so a passage of up to U shingles lies whole in
some window and is at least a quarter of it. Each of 64 universal hashes has its minimum
over a window in a contained item with the probability of their similarity, so an item
whose whole set is in the window shares a minimum with it but for (3/4)^64 = 1e-8, and at
containment 0.8 but for 1e-6. Block minima of a class come from those of the class below, so
all classes together cost one pass of hashing and a window costs one comparison. Items of one
to four shingles have no class: every shingle of a document is looked up among theirs.

A shared minimum makes the item a candidate of the document; the share of the item's
shingles that the whole document has then decides. Items are searched in blocks of a
bounded number, against every document; nothing is shuffled but the items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm.common import arrow_pass, ids_and_bytes, joined_columns, pinned, shingle_hashes, word_hashes

HASHES = 64
#: Items in one index; bounds what a task holds (about 2 KB an item, and 64 KB a hash and class).
BLOCK_ITEMS = 20_000
#: Smallest class: blocks of 8 shingles. Items of at most FEW shingles are looked up instead.
FIRST_CLASS, FEW = 3, 4
#: Blocks hashed at once.
_STRETCH = 1 << 11
_PAIRS = "doc_id bigint, item_id bigint, n_shared bigint, n_item bigint"


def _multipliers() -> np.ndarray:
    return np.random.default_rng(77001).integers(0, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


class ItemIndex:
    """Minima of a block of items by size class, and their full sets."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        self.ids, self.sets, self.a = ids, sets, _multipliers()
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        by_class: dict[int, list[int]] = {}
        few = [(found, np.full(len(found), k)) for k, found in enumerate(sets) if 0 < len(found) <= FEW]
        keys, members = (np.concatenate(x) for x in zip(*few)) if few else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(keys, kind="stable")
        self.few, self.few_members, self.few_table = keys[order], members[order], np.zeros(1 << 16, bool)
        self.few_table[_slot(self.few)] = True
        for k, found in enumerate(sets):
            if len(found) > FEW:
                by_class.setdefault(max(FIRST_CLASS, int(len(found) - 1).bit_length()), []).append(k)
        for c, members in by_class.items():
            low = np.stack([(self.a[:, None] * sets[k][None, :]).min(axis=1) for k in members])
            self.classes[c] = []
            for h in range(HASHES):
                order = np.argsort(low[:, h], kind="stable")
                keys = low[order, h]
                table = np.zeros(1 << 16, bool)
                table[_slot(keys)] = True
                self.classes[c].append((keys, np.array(members)[order], table))
        self.first, self.last = min(self.classes, default=0), max(self.classes, default=0)

    def _with_few(self, text: np.ndarray) -> set[int]:
        """Small items that share a shingle with a text."""
        if not len(self.few):
            return set()
        near = np.unique(text[self.few_table[_slot(text)]])
        lo, hi = np.searchsorted(self.few, near), np.searchsorted(self.few, near, "right")
        return {k for x, y in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist()) for k in self.few_members[x:y].tolist()}

    def candidates(self, texts: list[np.ndarray]) -> list[set[int]]:
        """Items that share a minimum with a window of each text, or that are small and share a shingle.

        All texts go side by side. Each text is filled up to whole blocks of the largest class
        with its last shingle; a window across two texts only adds candidates.
        """
        found = [self._with_few(t) for t in texts]
        if not self.classes or not any(map(len, texts)):
            return found
        unit, size = 1 << self.last, 1 << self.first
        full = [-(-len(t) // unit) * unit for t in texts]
        row = np.empty(sum(full), np.uint64)
        at = 0
        for t, n in zip(texts, full):
            row[at:at + len(t)] = t
            row[at + len(t):at + n] = t[-1] if n else 0
            at += n
        blocks = np.ascontiguousarray(row.reshape(-1, size).T)
        owner = np.repeat(np.arange(len(texts)), [n // size for n in full])
        count = blocks.shape[1]
        for h in range(HASHES):
            low = np.empty(count, np.uint64)
            for k in range(0, count, _STRETCH):
                (blocks[:, k:k + _STRETCH] * self.a[h]).min(axis=0, out=low[k:k + _STRETCH])
            for c in range(self.first, self.last + 1):
                if c > self.first:
                    low = np.minimum(low[0::2], low[1::2])
                if c not in self.classes:
                    continue
                windows = low.copy()
                np.minimum(low[:-1], low[1:], out=windows[:-1])
                keys, members, table = self.classes[c][h]
                spots = np.flatnonzero(table[_slot(windows)])
                lo, hi = np.searchsorted(keys, windows[spots]), np.searchsorted(keys, windows[spots], "right")
                step = 1 << (c - self.first)
                for k, x, y in zip(spots[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                    items = members[x:y].tolist()
                    found[owner[k * step]].update(items)
                    found[owner[min((k + 1) * step, count - 1)]].update(items)
        return found

    def search(self, bodies: list[bytes], percent: int) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, shared, size) of each item whose shingles a text has to ``percent``."""
        texts = [shingle_hashes(word_hashes(b)) for b in bodies]
        for n, (shingles, near) in enumerate(zip(texts, self.candidates(texts))):
            whole = np.unique(shingles) if near else shingles
            for k in sorted(near) if len(whole) else ():
                item = self.sets[k]
                at = np.minimum(np.searchsorted(whole, item), len(whole) - 1)
                shared = int((whole[at] == item).sum())
                if 100 * shared >= percent * len(item):
                    yield n, self.ids[k], shared, len(item)


def _slot(values: np.ndarray) -> np.ndarray:
    """Sixteen bits of a minimum that are spread evenly."""
    return ((values >> np.uint64(36)) & np.uint64(0xFFFF)).astype(np.int64)


def _searcher(ids: list[int], sets: list[bytes], percent: int):
    state: list[ItemIndex] = []

    def search(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(ItemIndex(ids, [np.frombuffer(s, np.uint64) for s in sets]))
        docs = batch.column(0).to_pylist()
        rows = [(docs[n], *hit) for n, *hit in state[0].search(batch.column(1).to_pylist(), percent)]
        cols = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "n_shared", "n_item"])

    return search


def _item_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = [np.unique(shingle_hashes(word_hashes(b.as_py()))) for b in batch.column(1)]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["item_id", "found"])


def _item_blocks(items: DataFrame, size: int) -> Iterator[list]:
    """Blocks of at most ``size`` items at the driver, one at a time, in order of id."""
    after = None
    while True:
        rest = items if after is None else items.where(F.col("item_id") > after)
        block = rest.orderBy("item_id").limit(size).collect()
        if block:
            yield block
        if len(block) < size:
            return
        after = block[-1].item_id


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", percent: int = 80, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): documents that hold an item, with what they share.

    Words are runs without ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; an item is held if
    100 * shared >= ``percent`` * size, on sets of five-word shingles of the whole texts. A text
    of one to four words has one shingle, all its words: such an item is found only in a
    document that is equal to it. Items and documents without words, or null, match nothing;
    rows with a null item id are left out, documents with a null id give rows with a null id.
    Repeated rows of documents give repeated rows of results; items that repeat an id count
    once, by their union of shingles. Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    sets = (
        arrow_pass(ids_and_bytes(items, item_id, item_text), _item_sets, "item_id bigint, found binary")
        .where("item_id is not null and length(found) > 0")
        .groupBy("item_id").agg(F.collect_set("found").alias("found"))
    )
    sets = pinned(sets, "items")
    raw = ids_and_bytes(docs, id_col, text_col)
    out = spark.createDataFrame([], _PAIRS)
    for block in _item_blocks(sets, block_items):
        found = [np.unique(np.frombuffer(b"".join(r.found), np.uint64)).tobytes() for r in block]
        out = out.union(arrow_pass(raw, _searcher([r.item_id for r in block], found, percent), _PAIRS))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, all columns, whose id holds no item. Rows with a null id stay."""
    key = joined_columns(docs.columns, "held_id")
    held = contaminated(docs, items, id_col, text_col, **how).select(F.col("doc_id").alias(key)).distinct()
    held = pinned(held, "contaminated")
    return docs.join(held, docs[id_col].cast("bigint") == held[key], "left_anti")
