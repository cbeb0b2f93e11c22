"""N-gram Jaccard join: rare-first prefixes find candidates, parity sketches test them, full sets verify.

A document's set is its distinct 5-word shingles (A-Z lower-cased, words
``[^\\x20\\x09-\\x0D]+``; fewer words: the whole sequence as one shingle; none: empty). Two
sets link when 100 * |A & B| >= 80 * |A | B|.

Method. Exact copies are one node (the set's 64-bit fingerprint) and link among themselves.
Two sets that link share at least ceil(0.8 n) shingles of either, n its size. So when all
shingles have one total order, the first n - ceil(0.8 n) + 1 of each set share a shingle:
a node emits only those as keys, about a fifth of its set. The order puts shingles last that are
frequent in a bounded sample or, in a first pass, the key of HOT or more rows of the whole table
(see ``ordered_shingles``), so that common phrases are rarely keys; any order finds
all pairs. Nodes on one key are candidates.

``jaccard_join`` lists no pairs: it counts links inside tiles (see ``tiles``). A node's home is
the commonest key it shares; two nodes that share a key meet in the cell of their two homes and
nowhere else, so each pair is tested once although it may share many keys. Large cells
are cut into tiles of BLOCK nodes a side. A tile first compares sizes and short parity
sketches, about half a byte a shingle (see ``sketched``); only nodes with a near partner send
their text there, once a tile, and the full sets decide (see ``counted_links``). A tile returns
a row for each of its linked nodes: its links and the smallest node it is tied to.

``jaccard_links`` lists the pairs themselves, for callers that want them: candidates meet by
size and short sketch (see ``near``), those left meet their texts in groups (see ``verify``).
Sizes fall into geometric bands
(ratio 5/4); two sets that can link are in one band or two neighbouring ones, and then
|A ^ B| <= (|A| + |B|) / 9 <= k of their layout. In a layout's parity sketch each shingle flips
one of 64 bits of one of m words, so the Hamming distance of two sketches is at most
|A ^ B|: candidates farther than k are dropped, the others are verified on the full sets.

Defined handling: null doc_id rows are left out. A null or empty text has the empty set,
which links with nothing; its component is its own doc_id. Rows with one doc_id and different
texts are one document: their sets are tied into one component, n_shingles is the largest
of them. Repeated rows count once. n_links counts, for each set of the document, the other
doc_ids holding a set that links with it, exact copies included (an id with two texts is
counted once for each of its sets). Very long texts
are read in pieces (common.word_hashes). Extra input columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.llm.common import arrow_pass, flat_lists, ids_and_bytes, mix, pinned, shingle_hashes, word_hashes
from lakewarden.llm.components import connected_components

#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Ratio of the size bands: the largest smaller set that can still link, inverted.
RATIO = 100 / PERCENT
#: Nodes of one key that are paired in one block.
BLOCK = 256
#: Rows whose shingles are counted for the order, about; the shingles kept, and the rows one needs.
ORDER_ROWS, MAX_FREQUENT, ORDER_MIN = 20_000, 100_000, 4
#: Bits of a short sketch for each shingle, at least, and of one sketch, at most.
SKETCH_BITS, MAX_SKETCH_BITS = 4, 1 << 17
#: Candidate pairs of one verification bucket, about.
BUCKET_PAIRS = 4_000
#: Rows that make a first-pass key frequent, the most such keys kept, and the tile members of one bucket, about.
HOT, MAX_HOT, BUCKET_ROWS = 8, 500_000, 1_000
#: Bands: the smallest size of band j.
_BOUNDS = np.array(sorted({math.ceil(RATIO ** j) for j in range(0, 160)}), dtype=np.int64)
_SALT = np.uint64(0x2545F4914F6CDD1D)
_MASK = (1 << 64) - 1


def band(n: int) -> int:
    """Index of the largest bound at most n (n >= 1)."""
    return int(np.searchsorted(_BOUNDS, n, side="right") - 1)


def layout(j: int) -> tuple[int, int]:
    """(k, m) of layout j, which pairs sets of bands j and j + 1."""
    largest = int(_BOUNDS[j + 2]) - 1 if j + 2 < len(_BOUNDS) else 1 << 62
    # |A ^ B| = |A| + |B| - 2 |A & B| and |A & B| >= PERCENT (|A| + |B|) / (100 + PERCENT).
    k = (2 * largest * (100 - PERCENT)) // (100 + PERCENT)
    slack = (k + 1) // 2 + 1
    return k, k + 1 + slack


def _set(body: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(body)))


def _node(h: np.ndarray) -> int | None:
    """The set's 64-bit fingerprint (signed); none for the empty set."""
    return xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h)) - (1 << 63) if len(h) else None


def _sketch(h: np.ndarray, j: int) -> np.ndarray:
    """Parity words of set ``h`` under layout j."""
    _, m = layout(j)
    mixed = mix(h ^ np.uint64((0x2545F4914F6CDD1D * (j + 1)) & _MASK))
    parity = np.zeros(m, np.uint64)
    np.bitwise_xor.at(parity, (mixed % np.uint64(m)).astype(np.int64), np.left_shift(np.uint64(1), mixed >> np.uint64(58)))
    return parity


def prefix(h: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The n - ceil(0.8 n) + 1 shingles of set ``h`` that come first: by frequency class, then by mixed hash.

    ``frequent`` is sorted, ``ranks`` its classes (from 1); all other shingles are of class 0.
    """
    size = len(h) + (-PERCENT * len(h) // 100) + 1
    mixed = mix(h ^ _SALT)
    if not len(frequent):
        return h[np.argpartition(mixed, size - 1)[:size]]
    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    return h[np.lexsort((mixed, np.where(frequent[at] == h, ranks[at], 0)))[:size]]


def short_sketch(h: np.ndarray) -> bytes:
    """Parity bits of set ``h``: a power of two of them, so that a longer sketch folds onto a shorter."""
    bits = min(MAX_SKETCH_BITS, max(64, 1 << (SKETCH_BITS * len(h) - 1).bit_length()))
    at = (mix(h ^ ~_SALT) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Hamming distance of two short sketches, the longer one folded: at most |A ^ B|."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def described(docs: DataFrame, frequent: np.ndarray, ranks: np.ndarray) -> DataFrame:
    """(id, node, n, keys, sketch) of every row with a non-null id, in one pass over the texts.

    node is the set's fingerprint (null if empty), keys its prefix, sketch its short sketch.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sizes, keys, sketches = [], [], [], []
        for body in batch.column("body").to_pylist():
            h = _set(body)
            nodes.append(_node(h))
            sizes.append(len(h))
            keys.append(prefix(h, frequent, ranks).view(np.int64) if len(h) else np.zeros(0, np.int64))
            sketches.append(short_sketch(h) if len(h) else None)
        columns = [batch.column("id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), flat_lists(keys, pa.int64()), pa.array(sketches, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["id", "node", "n", "keys", "sketch"])

    return arrow_pass(ids_and_bytes(docs), run, "id bigint, node bigint, n bigint, keys array<bigint>, sketch binary")


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, classes) of the commonest shingles in a sample of rows.

    They only order the shingles: about ORDER_ROWS rows are counted, and at most
    MAX_FREQUENT shingles that ORDER_MIN of them hold reach the driver.
    """
    rows = docs.count()
    spread = 1 << 20
    share = spread if rows <= ORDER_ROWS else max(1, spread * ORDER_ROWS // rows)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(spread)) < share)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate([_set(b) for b in batch.column("body").to_pylist()]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], ["s", "c"])

    counted = arrow_pass(ids_and_bytes(sample), run, "s bigint, c bigint").groupBy("s").agg(F.sum("c").alias("c"))
    common = counted.where(F.col("c") >= ORDER_MIN).orderBy(F.desc("c"), "s").limit(MAX_FREQUENT).toArrow()
    found, counts = common["s"].to_numpy().view(np.uint64), common["c"].to_numpy()
    order = np.argsort(found)
    return found[order], counts[order]


def ordered_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, classes): the sample's frequent shingles and keys that turn out to be common.

    The sample is bounded, so on a large table it misses shingles of some dozens of rows.
    Those that matter are keys under the sample's order: these are counted over all
    rows and the commonest come last too. A set without such a key keeps its prefix.
    """
    frequent, ranks = frequent_shingles(rows)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = [prefix(h, frequent, ranks) for h in map(_set, batch.column("body").to_pylist()) if len(h)]
        found, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *keys]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], ["s", "c"])

    counted = arrow_pass(ids_and_bytes(rows), run, "s bigint, c bigint").groupBy("s").agg(F.sum("c").alias("c"))
    hot = counted.where(F.col("c") >= HOT).orderBy(F.desc("c"), "s").limit(MAX_HOT).toArrow()
    _release(rows.sparkSession)
    found, at = np.unique(np.concatenate([frequent, hot["s"].to_numpy().view(np.uint64)]), return_inverse=True)
    classes = np.zeros(len(found), np.int64)
    np.maximum.at(classes, at, np.concatenate([ranks, hot["c"].to_numpy()]))
    return found, classes


#: Keys held by three or more rows that are broadcast to pick their members, at most, and
#: candidate nodes that are broadcast to fetch their texts; beyond, a join.
MAX_BROADCAST_KEYS, MAX_BROADCAST_NODES = 2_000_000, 1_000_000


def candidates(sets: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of nodes sharing a key.

    One aggregate per key, in one exchange, gives its rows and its least and greatest
    node: a key of two rows and two nodes is a pair at once, one whose least and
    greatest node agree holds copies of one set only. Keys of three or more rows and two
    or more nodes are few; their nodes are found by reading the keys again and joining
    (broadcast after a size check), dealt into blocks of at most BLOCK nodes, and paired
    block by block, so a key held by thousands of nodes is spread over many tasks.
    """
    keyed = sets.select(F.explode("keys").alias("key"), "node")
    counted = pinned(
        keyed.groupBy("key").agg(F.count("*").alias("c"), F.min("node").alias("a"), F.max("node").alias("b"))
        .where(F.col("a") != F.col("b")),
        "jaccard-shared",
    )
    pairs = counted.where("c = 2").select("a", "b")
    multi = counted.where("c > 2").select("key", F.greatest(F.lit(1), F.ceil(F.col("c") / F.lit(BLOCK))).cast("int").alias("blocks"))
    n_multi = multi.count()
    _release(sets.sparkSession)
    if n_multi:
        side = F.broadcast(multi) if n_multi <= MAX_BROADCAST_KEYS else multi
        dealt = keyed.join(side, "key").distinct().withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        sent = dealt.select("key", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
            "key", "node", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        )
        left = sent.select("key", "lo", "hi", F.col("node").alias("a"), F.col("block").alias("block_a"))
        right = sent.select("key", "lo", "hi", F.col("node").alias("b"), F.col("block").alias("block_b"))
        more = left.join(right, ["key", "lo", "hi"]).where(
            (F.col("a") < F.col("b"))
            & (((F.col("block_a") == F.col("lo")) & (F.col("block_b") == F.col("hi"))) | ((F.col("block_a") == F.col("hi")) & (F.col("block_b") == F.col("lo"))))
        )
        pairs = pairs.unionByName(more.select("a", "b"))
    return pairs.distinct()


def near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sizes allow a link and whose short sketches are at most (|A| + |B|) / 9 apart.

    Sets that link have |A ^ B| <= (|A| + |B|) / 9, so none of them is dropped. A pair
    carries two short sketches here, not two texts.
    """
    sizes = sets.where(F.col("node").isNotNull()).select("node", "n").distinct()
    fitting = pinned(
        pairs.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b")
        .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * PERCENT),
        "jaccard-fitting",
    )
    wanted = fitting.select(F.col("a").alias("node")).unionByName(fitting.select(F.col("b").alias("node"))).distinct()
    short = pinned(sets.select("node", "sketch").join(wanted, "node", "left_semi").groupBy("node").agg(F.max("sketch").alias("sketch")), "jaccard-short")
    sketched = fitting.join(short.toDF("a", "sketch_a"), "a").join(short.toDF("b", "sketch_b"), "b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b, n_a, n_b, short_a, short_b = (batch.column(c) for c in ("a", "b", "n_a", "n_b", "sketch_a", "sketch_b"))
        most = (n_a.to_numpy() + n_b.to_numpy()) * (100 - PERCENT) // (100 + PERCENT)
        gaps = np.fromiter(map(apart, short_a.to_pylist(), short_b.to_pylist()), np.int64, batch.num_rows)
        keep = pa.array(gaps <= most)
        return pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    return arrow_pass(sketched, run, "a bigint, b bigint")


def verify(pairs: DataFrame, held: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b) of the given pairs whose parity sketches are within k and whose full sets link.

    A text travels to buckets of pairs, not to each pair, and once: a pair belongs to the
    least neighbour of its smaller node, which the pairs of one cluster share, large
    clusters are cut into blocks on both sides, and those are dealt into buckets of about
    BUCKET_PAIRS pairs. The texts of candidate nodes (one row each, the smallest id) are
    read again, packed, and sent to the buckets of their node. A bucket makes each of its
    sets and sketches once. The layout is that of the smaller set's band (valid for both).
    """
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("home"))
    homed = pinned(pairs.join(least, "a"), "jaccard-homed")
    blocks = homed.groupBy("home").agg(F.ceil(F.sqrt(F.count("*")) / F.lit(BLOCK // 2)).alias("blocks"))
    n_buckets = max(1, math.ceil(homed.count() / BUCKET_PAIRS))

    def block(c: str):
        return F.pmod(F.xxhash64(c), F.col("blocks"))

    bucket = F.pmod(F.xxhash64("home", block("a"), block("b")), F.lit(n_buckets))
    dealt = pinned(homed.join(blocks, "home").select("a", "b", bucket.alias("bucket")), "jaccard-dealt")
    wanted = dealt.select("bucket", F.col("a").alias("node")).unionByName(dealt.select("bucket", F.col("b").alias("node")))
    sites = wanted.groupBy("node").agg(F.collect_set("bucket").alias("sites"))
    firsts = held.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("id"))
    heads = pinned(firsts.join(sites, "node"), "jaccard-heads")
    side = F.broadcast(heads) if heads.count() <= MAX_BROADCAST_NODES else heads
    fetched = ids_and_bytes(rows).join(side, "id").select("node", "body", "sites")
    sent = arrow_pass(fetched, _own_texts, "node bigint, body binary, sites array<bigint>").select("node", "body", F.explode("sites").alias("at"))
    _release(rows.sparkSession)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        packed = dict(zip(right["node"].to_pylist(), right["body"].to_pylist()))
        made = {node: _set(zlib.decompress(body)) for node, body in packed.items()}
        bands = {node: band(len(h)) for node, h in made.items()}
        sketches: dict[tuple[int, int], np.ndarray] = {}

        def sketch(node: int, j: int) -> np.ndarray:
            if (node, j) not in sketches:
                sketches[node, j] = _sketch(made[node], j)
            return sketches[node, j]

        keep_a, keep_b = [], []
        for a, b in zip(left["a"].to_pylist(), left["b"].to_pylist()):
            ha, hb = made[a], made[b]
            least_n, most_n = sorted((len(ha), len(hb)))
            if least_n * 100 < most_n * PERCENT:
                continue
            j = min(bands[a], bands[b])
            if int(np.bitwise_count(sketch(a, j) ^ sketch(b, j)).sum()) > layout(j)[0]:
                continue
            both = len(np.intersect1d(ha, hb, assume_unique=True))
            if both * 100 >= (len(ha) + len(hb) - both) * PERCENT:
                keep_a.append(a)
                keep_b.append(b)
        return pa.table([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], names=["a", "b"])

    return dealt.groupBy("bucket").cogroup(sent.groupBy("at")).applyInArrow(run, "a bigint, b bigint")


def shared_keys(sets: DataFrame) -> DataFrame:
    """Distinct (key, node, n, c) of keys on two or more nodes, c rows; keys of two rows whose sizes cannot link are left out."""
    keyed = sets.select(F.explode("keys").alias("key"), "node", "n")
    counted = pinned(
        keyed.groupBy("key").agg(
            F.count("*").alias("c"), F.min("node").alias("a"), F.max("node").alias("b"), F.min("n").alias("least"), F.max("n").alias("most"),
        ).where((F.col("a") != F.col("b")) & ((F.col("c") > 2) | (F.col("least") * 100 >= F.col("most") * PERCENT))),
        "jaccard-shared",
    )
    twos = counted.where("c = 2").select("key", F.explode(F.array("a", "b")).alias("node"), "c")
    multi = counted.where("c > 2").select("key", "c")
    _release(sets.sparkSession)
    side = F.broadcast(multi) if multi.count() <= MAX_BROADCAST_KEYS else multi
    return twos.unionByName(keyed.join(side, "key").select("key", "node", "c").distinct())


def tiles(sets: DataFrame) -> DataFrame:
    """(tile, role, node): in a tile roles 0 and 1 meet, or all of role 2; each pair that shares a key meets in one tile.

    A node's home is the commonest key it shares (ties: the greatest). A key is held by nodes
    of few homes, since these are at least as common as the key: members are dealt by key and
    home, never by key and member. The cell of two homes holds their nodes that share a key
    with the other; the cell of one home all its nodes. Cells are cut into BLOCK nodes a side.
    """
    shared = pinned(shared_keys(sets), "jaccard-entries")
    homes = shared.groupBy("node").agg(F.max(F.struct("c", "key"))["key"].alias("home"))
    homed = pinned(shared.select("key", "node").join(homes, "node"), "jaccard-homed")
    others = homed.select("key", F.col("home").alias("other")).distinct()
    members = pinned(
        homed.join(others, "key").select("node", F.least("home", "other").alias("lo"), F.greatest("home", "other").alias("hi"), (F.col("home") > F.col("other")).cast("int").alias("side")).distinct(),
        "jaccard-members",
    )
    one = F.col("lo") == F.col("hi")
    cells = members.groupBy("lo", "hi").agg(
        F.ceil(F.count_if(F.col("side") == 0) / F.lit(BLOCK)).alias("blocks_0"), F.ceil(F.count_if(F.col("side") == 1) / F.lit(BLOCK)).alias("blocks_1"), F.count("*").alias("size"),
    ).where("size > 1")
    blocks, across = F.when(F.col("side") == 0, F.col("blocks_0")).otherwise(F.col("blocks_1")), F.when(one | (F.col("side") == 1), F.col("blocks_0")).otherwise(F.col("blocks_1"))
    dealt = members.join(cells, ["lo", "hi"]).select(
        "lo", "hi", "side", "node", F.pmod(F.xxhash64("node"), blocks).alias("block"), F.explode(F.sequence(F.lit(0).cast("bigint"), across - 1)).alias("facing"),
    )
    row = F.when(one, F.least("block", "facing")).when(F.col("side") == 0, F.col("block")).otherwise(F.col("facing"))
    column = F.when(one, F.greatest("block", "facing")).when(F.col("side") == 0, F.col("facing")).otherwise(F.col("block"))
    role = F.when(one & (F.col("block") == F.col("facing")), 2).when(one, (F.col("block") > F.col("facing")).cast("int")).otherwise(F.col("side"))
    return dealt.select(F.xxhash64("lo", "hi", row, column).alias("tile"), role.alias("role"), "node")


def _meetings(tile: np.ndarray, role: np.ndarray):
    """(row, rows it meets) of every tile with a pair; each pair once."""
    order = np.lexsort((role, tile))
    cuts = np.flatnonzero(np.diff(tile[order])) + 1
    for rows in np.split(order, cuts):
        kinds = role[rows]
        if kinds[-1] == 2:
            for i in range(len(rows) - 1):
                yield rows[i], rows[i + 1:]
        else:
            right = rows[kinds == 1]
            if len(right):
                for i in rows[kinds == 0]:
                    yield i, right


def _fits(n: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    m = n[others]
    return others[np.minimum(m, n[i]) * 100 >= np.maximum(m, n[i]) * PERCENT]


def sketched(tiled: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of ``tiles`` whose node has a partner in its tile of fitting size and a short sketch at most (|A| + |B|) / 9 away."""
    wanted = tiled.select("node").distinct()
    short = sets.join(wanted, "node", "left_semi").groupBy("node").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    n_buckets = max(1, math.ceil(tiled.count() / BUCKET_ROWS))

    def run(table: pa.Table) -> pa.Table:
        tile, role, n = (table[c].to_numpy() for c in ("tile", "role", "n"))
        packed = [np.frombuffer(b, np.uint64) for b in table["sketch"].to_pylist()]
        words = np.array([len(w) for w in packed])
        keep = np.zeros(len(tile), bool)
        for i, others in _meetings(tile, role):
            others = _fits(n, i, others)
            # sizes within 5/4: sketches are of one length or two neighbouring ones
            for size in np.unique(words[others]):
                some = others[words[others] == size]
                a, b = packed[i], np.stack([packed[k] for k in some])
                while b.shape[1] > len(a):
                    b = b[:, :b.shape[1] // 2] ^ b[:, b.shape[1] // 2:]
                while len(a) > b.shape[1]:
                    a = a[:len(a) // 2] ^ a[len(a) // 2:]
                hit = np.bitwise_count(b ^ a).sum(1, dtype=np.int64) <= (n[some] + n[i]) * (100 - PERCENT) // (100 + PERCENT)
                keep[some[hit]] = True
                keep[i] |= hit.any()
        return table.select(["tile", "role", "node"]).filter(pa.array(keep))

    bucketed = tiled.join(short, "node").withColumn("bucket", F.pmod("tile", F.lit(n_buckets)))
    return bucketed.groupBy("bucket").applyInArrow(run, "tile bigint, role int, node bigint")


def counted_links(tiled: DataFrame, held: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root, far) for each linked node of a tile: the smallest node its links in the tile reach, and the ids on the nodes it links with there."""
    n_buckets = max(1, math.ceil(tiled.count() / BUCKET_ROWS))
    dealt = tiled.withColumn("bucket", F.pmod("tile", F.lit(n_buckets)))
    sites = dealt.groupBy("node").agg(F.collect_set("bucket").alias("sites"))
    firsts = held.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("id"), F.countDistinct("id").alias("ids"))
    heads = pinned(firsts.join(sites, "node"), "jaccard-heads")
    side = F.broadcast(heads.drop("ids")) if heads.count() <= MAX_BROADCAST_NODES else heads.drop("ids")
    fetched = ids_and_bytes(rows).join(side, "id").select("node", "body", "sites")
    sent = arrow_pass(fetched, _own_texts, "node bigint, body binary, sites array<bigint>").select("node", "body", F.explode("sites").alias("at"))
    weighed = dealt.join(heads.select("node", "ids"), "node")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = {}
        for node, body in zip(right["node"].to_pylist(), right["body"].to_pylist()):
            if node not in made:
                made[node] = _set(zlib.decompress(body))
        tile, role, node, ids = (left[c].to_numpy() for c in ("tile", "role", "node", "ids"))
        sets = [made[k] for k in node.tolist()]
        n = np.array([len(h) for h in sets])
        far, root = np.zeros(len(tile), np.int64), np.arange(len(tile))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for i, others in _meetings(tile, role):
            others = _fits(n, i, others)
            if not len(others):
                continue
            flat = np.concatenate([sets[k] for k in others])
            at = np.minimum(np.searchsorted(sets[i], flat), n[i] - 1)
            both = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(n[others])[:-1]]))
            linked = others[both * 100 >= (n[i] + n[others] - both) * PERCENT]
            far[linked] += ids[i]
            far[i] += ids[linked].sum()
            for k in linked.tolist():
                x, y = find(i), find(k)
                if x != y:  # the row of the smaller node leads
                    x, y = (x, y) if node[x] < node[y] else (y, x)
                    root[y] = x
        keep = np.flatnonzero(far)
        tops = node[[find(k) for k in keep.tolist()]] if len(keep) else node[:0]
        return pa.table([pa.array(node[keep]), pa.array(tops), pa.array(far[keep])], names=["node", "root", "far"])

    return weighed.groupBy("bucket").cogroup(sent.groupBy("at")).applyInArrow(run, "node bigint, root bigint, far bigint")


def _own_texts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows whose text has the node's set, packed: an id with several texts brings all of them."""
    nodes, bodies = batch.column("node").to_pylist(), batch.column("body").to_pylist()
    keep = [i for i, (n, b) in enumerate(zip(nodes, bodies)) if _node(_set(b)) == n]
    packed = pa.array([zlib.compress(bodies[i], 1) for i in keep], pa.binary())
    kept = batch.take(pa.array(keep, pa.int64()))
    return pa.RecordBatch.from_arrays([kept.column("node"), packed, kept.column("sites")], ["node", "body", "sites"])


def _release(spark) -> None:
    """Let the driver's JVM collect what the written stages no longer need, so that Spark's
    cleaner deletes their shuffle files now rather than at its periodic collection."""
    spark.sparkContext._jvm.System.gc()


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, node, n) of each row, verified links (a, b) between nodes.

    Sets are never stored: one pass writes keys and short sketches, and the texts of
    nodes that have a near candidate (one row each, the smallest id) are read again for
    the sketch test and the exact check.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = pinned(described(rows, *frequent_shingles(rows)), "jaccard-sets")
    held = sets.select("id", "node", "n")
    pairs = pinned(candidates(sets), "jaccard-candidates")
    _release(docs.sparkSession)
    close = pinned(near(pairs, sets), "jaccard-near")
    links = pinned(verify(close, held, rows), "jaccard-links")
    _release(docs.sparkSession)
    return held, links


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component, n_links), one row per distinct id."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = pinned(described(rows, *ordered_shingles(rows)), "jaccard-sets")
    members = sets.select("id", "node", "n")
    tiled = pinned(tiles(sets), "jaccard-tiles")
    _release(docs.sparkSession)
    close = pinned(sketched(tiled, sets), "jaccard-near")
    _release(docs.sparkSession)
    links = pinned(counted_links(close, members, rows), "jaccard-links")
    _release(docs.sparkSession)
    # Copies of one set and sets of one id are tied through the smallest id on the node.
    heads = members.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("head"), F.countDistinct("id").alias("ids"))
    tied = members.where(F.col("node").isNotNull()).join(heads, "node").select(F.col("id").alias("a"), F.col("head").alias("b"))
    between = links.where("node != root").select("node", "root").distinct().join(heads.select("node", F.col("head").alias("ha")), "node").join(
        heads.select(F.col("node").alias("root"), F.col("head").alias("hb")), "root",
    ).select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    parts = connected_components(tied.unionByName(between))
    # Links of an id: for each of its nodes, the other ids on it and the ids on nodes linked to it.
    reached = links.groupBy("node").agg(F.sum("far").alias("far"))
    per_node = heads.join(reached, "node", "left").select("node", (F.col("ids") - 1 + F.coalesce("far", F.lit(0))).alias("near"))
    counts = members.where(F.col("node").isNotNull()).select("id", "node").distinct().join(per_node, "node").groupBy("id").agg(F.sum("near").alias("n_links"))
    sizes = members.groupBy("id").agg(F.max("n").alias("n_shingles"))
    return sizes.join(parts.select(F.col("node").alias("id"), "component"), "id", "left").join(counts, "id", "left").select(
        "id", "n_shingles", F.coalesce("component", "id").alias("component"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )
