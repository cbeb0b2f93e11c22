"""MinHash near-duplicates: many universal minima, banding, signature check, exact links, stars.

1. Every text gives its set of five-word shingles (64-bit hashes), a fingerprint of the
   set and 125 minima of multiply-shift hashes. Documents with one fingerprint have one
   set; only the smallest id of each fingerprint goes on.
2. Minima are banded: 25 bands of 5 for links at 0.85 or more, 31 bands of 4 for links from
   0.80. At its bound a pair shares no band with probability 8e-7 or 8e-8. In each bucket
   the smallest member is the centre; the others are candidates with it alone, so a bucket
   of n members gives n - 1 pairs.
3. A candidate pair goes on if its signatures agree in at least ``sure`` of the minima
   (the bound minus six standard deviations); its full sets then decide, in integers.
4. Links become components by large-star and small-star steps.
5. A bucket whose members are in one component is done. In the others every pair of
   members of different components is compared in blocks of bounded size, exactly, and
   emitted only if it links: no link between different texts is lost, no size is capped and
   no group is paired out as rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import arrow_pass, flat_lists, ids_and_bytes, joined_columns, pinned, shingle_hashes, word_hashes
from lakewarden.llm.components import connected_components

MINIMA = 125
#: Links need 100 * intersection >= PERCENT * union, unless a caller asks for another bound.
PERCENT = 85
#: The lowest bound that the band layouts are made for.
LOWEST = 80
#: Rows and shingles that a block of members holds; a block of heads holds a quarter.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 16
#: Columns of the matrices of two blocks at once.
_COLUMNS = 4096
#: 64-bit words of the bitmap of ids whose texts a round needs.
MARK_WORDS = 1 << 20
_CHUNK = 1024


def layout(percent: int) -> tuple[int, int]:
    """Bands, and minima of each."""
    return (25, 5) if percent >= PERCENT else (31, 4)


def sure(percent: int) -> int:
    """Agreeing minima that a candidate needs: six standard deviations under the bound."""
    p = percent / 100
    return int((p - 6 * (p * (1 - p) / MINIMA) ** 0.5) * MINIMA)


@lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    return np.random.default_rng(20240607).integers(0, 1 << 63, MINIMA, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest multiply-shift hash of a set under each function, as 32 bits."""
    a = _multipliers()
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _CHUNK):
        np.minimum(low, (a * shingles[None, at:at + _CHUNK]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _signed(n: int, width: int):
    def signatures(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, prints, sigs, bands = [], [], [], []
        for body in batch.column(1):
            found = np.unique(shingle_hashes(word_hashes(body.as_py())))
            sizes.append(len(found))
            if len(found):
                low = minima(found)
                prints.append(xxhash.xxh3_128_digest(found.tobytes()))
                sigs.append(low.tobytes())
                each = low[:n * width].reshape(n, width)
                bands.append(np.array([xxhash.xxh3_64_intdigest(each[k].tobytes(), seed=k) for k in range(n)], np.uint64).view(np.int64))
            else:
                prints.append(None)
                sigs.append(None)
                bands.append(np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(sigs, pa.binary()), flat_lists(bands, pa.int64())],
            names=["id", "n_shingles", "print", "sig", "bands"],
        )

    return signatures


def _marks(ids: DataFrame) -> np.ndarray:
    """A bitmap with a bit for the hash of each id: at most 8 MB, whatever the number of ids.

    Bits are set in Spark; where ids are so many that most bits are set, more texts than
    needed are taken, and nothing is lost.
    """
    spot = F.xxhash64("id").bitwiseAND(F.lit(64 * MARK_WORDS - 1))
    words = ids.select(F.shiftright(spot, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), spot.bitwiseAND(F.lit(63)).cast("int")).alias("m"))
    out = np.zeros(MARK_WORDS, np.int64)
    for batch in words.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


def _marked(marks: np.ndarray, spots: pa.Array) -> pa.Array:
    spot = spots.to_numpy() & (64 * len(marks) - 1)
    return pa.array((marks[spot >> 6] >> (spot & 63)) & 1 == 1)


def _sets_of(marks: np.ndarray):
    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        wanted = _marked(marks, batch.column(2))
        ids, bodies = batch.column(0).filter(wanted), batch.column(1).filter(wanted)
        found = [np.unique(shingle_hashes(word_hashes(b.as_py()))).tobytes() for b in bodies]
        return pa.RecordBatch.from_arrays([ids, pa.array(found, pa.binary())], names=["id", "found"])

    return sets


def _sigs_of(marks: np.ndarray):
    def sigs(batch: pa.RecordBatch) -> pa.RecordBatch:
        wanted = _marked(marks, batch.column(2))
        return pa.RecordBatch.from_arrays([batch.column(0).filter(wanted), batch.column(1).filter(wanted)], names=["id", "sig"])

    return sigs


def _agree(least: int):
    def agree(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(-1, MINIMA) for c in batch.columns[2:])
        keep = pa.array((a == b).sum(axis=1) >= least)
        return pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return agree


def _linked(percent: int):
    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            # sorted and distinct: equal neighbours in the merged array are shared
            merged = np.concatenate([x, y])
            merged.sort(kind="stable")
            both = int((merged[1:] == merged[:-1]).sum())
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        keep = pa.array(keep, pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return check


def _halves(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The upper 32 bits of each hash of a set: equal hashes stay equal."""
    low = [(np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for x in batch.column(1)]
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(low, pa.binary())], names=["id", "low"])


def _table(rows: list[dict], columns: np.ndarray) -> np.ndarray:
    """How often each row's set has each of the sorted ``columns``."""
    out = np.zeros((len(rows), len(columns)), np.float32)
    for k, row in enumerate(rows):
        values = np.frombuffer(row["low"], np.uint32)
        at = np.minimum(np.searchsorted(columns, values), len(columns) - 1)
        np.add.at(out[k], at[columns[at] == values], 1)
    return out


def _across(percent: int):
    def links(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Pairs of two blocks, in different components, whose halves reach ``percent``."""
        a, b = [], []
        for members, heads in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            values = np.unique(np.concatenate([np.frombuffer(h["low"], np.uint32) for h in heads]))
            shared = np.zeros((len(heads), len(members)), np.float32)
            for at in range(0, len(values), _COLUMNS):
                part = values[at:at + _COLUMNS]
                shared += np.minimum(_table(heads, part), 1) @ _table(members, part).T
            sizes = [np.array([len(r["low"]) // 4 for r in side], np.float64) for side in (heads, members)]
            parts = [np.array([r["part"] for r in side]) for side in (heads, members)]
            near = (100 * shared >= percent * (sizes[0][:, None] + sizes[1][None, :] - shared)) & (parts[0][:, None] != parts[1][None, :])
            for i, j in zip(*np.nonzero(near)):
                x, y = heads[i]["id"], members[j]["id"]
                a.append(min(x, y))
                b.append(max(x, y))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return links


class _Links:
    """Exact links among pairs of representatives, or within buckets of several components."""

    def __init__(self, docs: DataFrame, signed: DataFrame, percent: int):
        self.docs, self.signed, self.percent = docs, signed, percent

    def _sets(self, ids: DataFrame) -> DataFrame | None:
        marks = _marks(ids)
        if not marks.any():
            return None
        texts = self.docs.select("id", "body", F.xxhash64("id").alias("spot"))
        return pinned(arrow_pass(texts, _sets_of(marks), "id bigint, found binary"), "sets").dropDuplicates(["id"])

    def _exact(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        full = (
            pairs.join(sets.select(F.col("id").alias("a"), F.col("found").alias("fa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("found").alias("fb")), "b")
        )
        return pinned(arrow_pass(full.select("a", "b", "fa", "fb"), _linked(self.percent), "a bigint, b bigint"), "links")

    def of(self, pairs: DataFrame) -> DataFrame | None:
        """Pairs go by their signatures, then by their sets."""
        marks = _marks(pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
        if not marks.any():
            return None
        sigs = arrow_pass(self.signed.select("id", "sig", F.xxhash64("id").alias("spot")), _sigs_of(marks), "id bigint, sig binary").dropDuplicates(["id"])
        near = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
        near = pinned(arrow_pass(near.select("a", "b", "sa", "sb"), _agree(sure(self.percent)), "a bigint, b bigint"), "candidates")
        sets = self._sets(near.select(F.col("a").alias("id")).union(near.select("b")))
        return None if sets is None else self._exact(near, sets)

    def across(self, rest: DataFrame) -> DataFrame | None:
        """Links between components that share a bucket; ``rest`` has band, id and part.

        Every pair of different components has a side outside the largest component of the
        bucket. Those sides are the heads. Members and heads are dealt into blocks of bounded
        size, and pairs of blocks are compared by one product of matrices each: no pair is a
        row until its halved hashes pass; then the full sets decide.
        """
        sets = self._sets(rest.select("id"))
        if sets is None:
            return None
        sizes = sets.select("id", (F.length("found") / 8).cast("bigint").alias("n"))
        rows = pinned(rest.join(sizes, "id"), "rows")
        largest = rows.groupBy("band", "part").agg(F.count("*").alias("c"), F.sum("n").alias("t")).groupBy("band").agg(
            F.max_by("part", F.struct("c", "part")).alias("giant"), F.sum("c").alias("c"), F.sum("t").alias("t"),
            F.max("c").alias("gc"), F.max_by("t", F.struct("c", "part")).alias("gt"),
        )
        blocks = lambda c, t, scale: F.greatest(F.ceil(c / (BLOCK_ROWS / scale)), F.ceil(t / (BLOCK_SHINGLES / scale)), F.lit(1))
        spread = F.abs(F.xxhash64("id") % F.lit(1 << 40))
        rows = pinned(rows.join(largest, "band").select(
            "band", "id", "part", (spread % blocks(F.col("c"), F.col("t"), 1)).alias("mb"),
            F.when(F.col("part") != F.col("giant"), spread % blocks(F.col("c") - F.col("gc"), F.col("t") - F.col("gt"), 4)).alias("hb"),
        ), "rows")
        full = rows.join(arrow_pass(sets, _halves, "id bigint, low binary"), "id")
        block = F.collect_list(F.struct("id", "part", "low"))
        members = full.groupBy("band", "mb").agg(block.alias("members")).drop("mb")
        heads = full.where("hb is not null").groupBy("band", "hb").agg(block.alias("heads")).drop("hb")
        found = arrow_pass(members.join(heads, "band").select("members", "heads"), _across(self.percent), "a bigint, b bigint")
        return self._exact(pinned(found.distinct(), "found"), sets)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component) for each row of ``docs``.

    Two documents are linked if 100 times the intersection of their sets of five-word
    shingles is at least ``percent`` (80 or more; the banding is made for that) of the union.
    The component is the smallest id reachable. A text without words, or null, has an empty
    set and stands alone. A null id keeps its row with a null component. Rows that repeat an
    id are one document: what one of them links to, all do. Other columns are not read.
    """
    if percent < LOWEST:
        raise ValueError(f"bands are made for {LOWEST} percent or more")
    raw = ids_and_bytes(docs, id_col, text_col)
    signed = pinned(arrow_pass(raw, _signed(*layout(percent)), "id bigint, n_shingles bigint, print binary, sig binary, bands array<bigint>"), "signatures")
    usable = signed.where("id is not null and print is not null")

    # one representative for each set
    groups = usable.groupBy("print").agg(F.min("id").alias("rep"))
    member_of = pinned(usable.select("id", "print").join(groups, "print").select("id", "rep"), "members")
    # ids that stand for several sets tie these together
    ties = member_of.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo != hi").select("id")
    ties = member_of.join(ties, "id", "left_semi").select(F.col("rep").alias("a"), F.col("id").alias("b"))

    reps = member_of.where("id = rep").select("id").distinct()
    buckets = usable.select("id", "bands").join(reps, "id", "left_semi").select("id", F.posexplode("bands").alias("k", "h"))
    buckets = buckets.select(F.xxhash64("k", "h").alias("band"), "id")
    centres = buckets.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a != z").select("band", "a")
    members = pinned(buckets.join(centres, "band").select("band", "a", "id"), "buckets")

    test = _Links(raw.where("id is not null"), usable, percent)
    links = ties
    first = test.of(pinned(members.where("id != a").select("a", F.col("id").alias("b")).distinct(), "pairs"))
    if first is not None:
        links = links.union(first)
    parts = connected_components(links)
    labelled = (
        members.join(parts.withColumnRenamed("node", "id"), "id", "left")
        .select("band", "id", F.coalesce("component", "id").alias("part"))
    )
    # a bucket of two is tested; a larger one is open if it has several components
    mixed = (
        labelled.groupBy("band").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n"))
        .where("lo != hi and n > 2").select("band")
    )
    more = test.across(pinned(labelled.join(mixed, "band", "left_semi").distinct(), "rest"))
    if more is not None:
        stars = parts.where("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        parts = connected_components(stars.union(more))

    whole = (
        member_of.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    )
    return signed.select("id", "n_shingles").join(whole, "id", "left").select(
        "id", "n_shingles", F.coalesce("component", "id").alias("component"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, whose id is the smallest of its near-duplicates.

    Rows with a null id stay.
    """
    key = joined_columns(docs.columns, "drop_id")
    drop = near_duplicates(docs, id_col, text_col, percent).where("id != component").select(F.col("id").alias(key)).distinct()
    drop = pinned(drop, "dropped")
    return docs.join(drop, docs[id_col].cast("bigint") == drop[key], "left_anti")
