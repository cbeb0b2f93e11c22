"""Conversation prefix trie, with subtree totals by parallel tree contraction.

Conversations are rebuilt first: the turns of ``conv_id`` c, ordered by ``turn`` (nulls
first; ties by role, then text), keep their own turns after the first h, and take as their
first turns the first h of conversation c - c % 100 (all of them if it has fewer, none if it
is absent); h = unsigned crc32 of the decimal c, modulo 6. Every distinct sequence of the
first d rebuilt turns (role, text) is a node of depth d, below the textless root (d = 0); the
rebuilt conversations starting with it are its members.

A prefix is named by (depth, two sums of position-salted 64-bit turn hashes), the sums exact
in decimal: a running window sum within each conversation, so no list of turns is gathered.

Subtree totals (childless nodes, saved text) come from tree contraction in join rounds. Each
round rakes the leaves into their parents and compresses unary chains: a node with one child
whose parent is not compressed in the same round (a coin by hash settles who) is spliced out,
its own total moved onto the edge from its parent to its child, and ``T(node) = T(child) +
k`` recorded. When nothing is left, recorded nodes are expanded again, last round first.
Rounds shrink the tree by a constant share in expectation, so there are about log(nodes) of
them whatever the depth; each round is written below the shared folder.

Defined handling: rows with a null conv_id are left out; a null role or text is empty; a
conversation whose turns are all null-role, null-text is still a member of every node its
rebuilt turns pass; empty tables give no rows (not even a root). Repeated turn rows are turns.
Extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakewarden.llm.common import pinned

#: Turns taken from the family head, and the family size.
HEAD_TURNS, FAMILY = 6, 100

_SEEDS = (17, 91)
_STATE = ["node", "parent", "acc_s", "acc_l", "e_s", "e_l", "nch"]


def _hash_sum(seed: int) -> Column:
    """A turn's hash, salted by its place, as an exact decimal."""
    return F.xxhash64(F.lit(seed), F.col("pos"), F.col("role"), F.col("text")).cast("decimal(20,0)")


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): rebuilt conversations, positions from 1; turnless ones have none."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    own = turns.select("conv_id", F.row_number().over(ordered).alias("at"), "role", "text")
    ids = turns.select("conv_id").distinct().select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("head"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD_TURNS).cast("int").alias("h"),
    )
    head_turns = own.where(F.col("at") <= HEAD_TURNS - 1).select(F.col("conv_id").alias("head"), "at", "role", "text")
    lead = ids.join(head_turns, "head").where(F.col("at") <= F.col("h")).select("conv_id", "at", "role", "text")
    n_lead = lead.groupBy("conv_id").agg(F.count("*").alias("n_lead"))
    tail = own.join(ids.select("conv_id", "h"), "conv_id").where(F.col("at") > F.col("h")).join(n_lead, "conv_id", "left").select(
        "conv_id", (F.col("at") - F.col("h") + F.coalesce("n_lead", F.lit(0))).alias("at"), "role", "text",
    )
    return lead.unionByName(tail).select("conv_id", F.col("at").alias("pos"), "role", "text")


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """One row per node: key (depth, s1, s2), parent key, conv_id, n_convs, last text length, ends digest."""
    turns = rebuilt_turns(conversations)
    running = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keyed = turns.select(
        "conv_id", F.col("pos").alias("depth"), F.length("text").cast("bigint").alias("last_len"),
        F.sum(_hash_sum(_SEEDS[0])).over(running).alias("s1"), F.sum(_hash_sum(_SEEDS[1])).over(running).alias("s2"),
    )
    ids = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    zero = F.lit(0).cast("decimal(38,0)")
    root = ids.select("conv_id", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("last_len"), zero.alias("s1"), zero.alias("s2"))
    members = keyed.select("conv_id", "depth", "last_len", F.col("s1").cast("decimal(38,0)").alias("s1"), F.col("s2").cast("decimal(38,0)").alias("s2")).unionByName(root)
    lengths = members.groupBy("conv_id").agg(F.max("depth").alias("length"))
    before = Window.partitionBy("conv_id").orderBy("depth")
    linked = members.join(lengths, "conv_id").select(
        "*", F.lag("s1").over(before).alias("p1"), F.lag("s2").over(before).alias("p2"),
    )
    return linked.groupBy("depth", "s1", "s2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").cast("bigint").alias("n_convs"), F.first("last_len").alias("last_len"),
        F.first("p1").alias("p1"), F.first("p2").alias("p2"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("length") == F.col("depth"), F.col("conv_id")))), lambda x: x.cast("string")), ","), 256).alias("ends_sha256"),
    )


def _coin(node: Column, round_no: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(round_no)), F.lit(2)) == 0


def subtree_totals(tree: DataFrame) -> DataFrame:
    """(node, t_s, t_l): subtree sums of ``own_s`` and ``own_l`` for a forest of (node, parent, own_s, own_l).

    Rake and compress rounds until no node is left, then expansion of the compressed nodes.
    """
    children = tree.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("nch"))
    state = pinned(
        tree.join(children, "node", "left").select(
            "node", "parent", F.col("own_s").alias("acc_s"), F.col("own_l").alias("acc_l"),
            F.lit(0).cast("bigint").alias("e_s"), F.lit(0).cast("bigint").alias("e_l"), F.coalesce("nch", F.lit(0)).cast("bigint").alias("nch"),
        ),
        "trie-state",
    )
    done, spliced = [], []
    round_no = 0
    while True:
        counts = state.agg(F.count("*"), F.sum((F.col("nch") == 0).cast("int"))).first()
        if not counts[0]:
            break
        round_no += 1
        leaves = state.where("nch = 0")
        done.append(pinned(leaves.select("node", F.col("acc_s").alias("t_s"), F.col("acc_l").alias("t_l")), "trie-done"))
        up = leaves.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(
            F.sum(F.col("acc_s") + F.col("e_s")).alias("up_s"), F.sum(F.col("acc_l") + F.col("e_l")).alias("up_l"), F.count("*").alias("gone"),
        )
        rest = state.where("nch > 0").join(up, "node", "left").select(
            "node", "parent", (F.col("acc_s") + F.coalesce("up_s", F.lit(0))).alias("acc_s"),
            (F.col("acc_l") + F.coalesce("up_l", F.lit(0))).alias("acc_l"), "e_s", "e_l",
            (F.col("nch") - F.coalesce("gone", F.lit(0))).alias("nch"),
        )
        rest = pinned(rest, "trie-raked")
        # Compress: unary nodes with heads, under a parent that is not itself spliced now.
        unary = (F.col("nch") == 1) & F.col("parent").isNotNull() & _coin(F.col("node"), round_no)
        flagged = rest.select(*_STATE, unary.alias("cut"))
        parents = flagged.select(F.col("node").alias("parent"), F.col("cut").alias("parent_cut"))
        cut = flagged.join(parents, "parent", "left").where(F.col("cut") & ~F.coalesce("parent_cut", F.lit(False))).select(
            F.col("node").alias("w"), F.col("parent").alias("w_parent"), F.col("acc_s").alias("w_s"), F.col("acc_l").alias("w_l"),
            F.col("e_s").alias("w_es"), F.col("e_l").alias("w_el"),
        )
        cut = pinned(cut, "trie-cut")
        moved = flagged.join(cut, flagged["parent"] == cut["w"], "left")
        spliced.append(pinned(moved.where(F.col("w").isNotNull()).select(
            "w", F.col("node").alias("child"), (F.col("w_s") + F.col("e_s")).alias("k_s"), (F.col("w_l") + F.col("e_l")).alias("k_l"),
        ), "trie-spliced"))
        state = pinned(moved.join(cut.select(F.col("w").alias("node")), "node", "left_anti").select(
            "node", F.coalesce("w_parent", "parent").alias("parent"), "acc_s", "acc_l",
            F.when(F.col("w").isNotNull(), F.col("e_s") + F.col("w_s") + F.col("w_es")).otherwise(F.col("e_s")).alias("e_s"),
            F.when(F.col("w").isNotNull(), F.col("e_l") + F.col("w_l") + F.col("w_el")).otherwise(F.col("e_l")).alias("e_l"),
            "nch",
        ), "trie-state")
    if not done:
        return tree.select("node", F.lit(0).cast("bigint").alias("t_s"), F.lit(0).cast("bigint").alias("t_l"))
    known = pinned(_union(done), "trie-known")
    for records in reversed(spliced):
        found = records.join(known.select(F.col("node").alias("child"), "t_s", "t_l"), "child").select(
            F.col("w").alias("node"), (F.col("t_s") + F.col("k_s")).alias("t_s"), (F.col("t_l") + F.col("k_l")).alias("t_l"),
        )
        known = pinned(known.unionByName(found), "trie-known")
    return known


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 (longs but the digest)."""
    nodes = pinned(prefix_nodes(conversations), "trie-nodes")
    names = nodes.select(F.col("depth").alias("pd"), F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    named = nodes.join(names, (nodes["depth"] == names["pd"] + 1) & (nodes["p1"] == names["p1"]) & (nodes["p2"] == names["p2"]), "left").drop("pd", "p1", "p2")
    named = pinned(named, "trie-named")
    kids = named.where(F.col("parent_conv_id").isNotNull()).groupBy(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"),
    ).agg(F.count("*").cast("bigint").alias("n_children"))
    shaped = named.join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint"))
    shaped = pinned(shaped, "trie-shaped")
    # A node is (smallest member, depth): the smallest member repeats along its own path.
    tree = shaped.select(
        F.struct("conv_id", "depth").alias("node"),
        F.when(F.col("parent_conv_id").isNotNull(), F.struct(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))).alias("parent"),
        ((F.col("n_convs") - 1) * F.col("last_len")).cast("bigint").alias("own_s"), (F.col("n_children") == 0).cast("bigint").alias("own_l"),
    )
    totals = subtree_totals(tree).select("node.conv_id", "node.depth", "t_s", "t_l")
    return shaped.join(totals, ["conv_id", "depth"]).select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        F.col("t_l").cast("bigint").alias("n_leaves"), F.col("t_s").cast("bigint").alias("saved_tokens"), "ends_sha256",
    )
