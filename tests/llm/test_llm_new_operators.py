"""Jaccard join, filter audit and prefix trie against brute force, on awkward rows."""

import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lakewarden.llm import queries as text_queries
from lakewarden.llm.audit import filter_audit
from lakewarden.llm.jaccard import _BOUNDS, band, jaccard_join, layout
from lakewarden.llm.trie import prefix_trie
from test_llm_operators import SCHEMA, VOCABULARY, awkward, shingles


def brute_jaccard(rows, percent=80):
    sets = collections.defaultdict(list)
    for i, t in rows:
        if i is not None and frozenset(shingles(t or "")) not in sets[i]:
            sets[i].append(frozenset(shingles(t or "")))
    ids = sorted(sets)
    part = {i: i for i in ids}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    links = collections.Counter()
    for a, b in itertools.combinations(ids, 2):
        hit = 0
        for x in sets[a]:
            for y in sets[b]:
                both = len(x & y)
                if x and y and 100 * both >= percent * len(x | y):
                    hit += 1
        if hit:
            links[a] += hit
            links[b] += hit
            ra, rb = find(a), find(b)
            part[max(ra, rb)] = min(ra, rb)
    return {i: (max(len(s) for s in sets[i]), find(i), links[i]) for i in ids}


def near_copies(seed=5, groups=12):
    rng = random.Random(seed)
    texts = {}
    for g in range(groups):
        base = [f"{rng.choice(VOCABULARY)}{rng.randrange(50)}" for _ in range(rng.choice([6, 9, 14, 30, 80, 200]))]
        for c in range(rng.randrange(2, 6)):
            now = list(base)
            for _ in range(rng.randrange(0, 3)):
                now[rng.randrange(len(now))] = f"x{rng.randrange(10**6)}"
            texts[100 * g + c] = " ".join(now)
    return list(texts.items())


def test_bands_put_linkable_sizes_side_by_side():
    for n in range(1, 5000):
        for other in range(n, int(n / 0.8) + 1):
            assert band(other) - band(n) <= 1
    for j in range(60):
        k, m = layout(j)
        largest = int(_BOUNDS[j + 2]) - 1
        assert all(a + b - 2 * (-(-80 * (a + b) // 180)) <= k for a in range(max(1, largest - 3), largest + 1) for b in range(int(0.8 * a), a + 1))
        assert m > k + 1


@pytest.mark.parametrize("make", [awkward, near_copies])
def test_jaccard_join_against_brute_force(spark, make):
    rows = make() if make is near_copies else [(r[0], r[1]) for r in make()]
    rows = rows + [(rows[3][0], rows[5][1]), (rows[2][0], rows[2][1]), (None, rows[1][1])]  # one id with two texts, a repeat, a null id
    data = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA).withColumn("node", F.lit(1))
    got = {r.id: (r.n_shingles, r.component, r.n_links) for r in jaccard_join(data).collect()}
    want = brute_jaccard(rows)
    assert {i: g[:2] for i, g in got.items()} == {i: w[:2] for i, w in want.items()}
    assert len({g[1] for g in got.values()}) < len(got)
    unique = {i for i, t in rows if sum(1 for j, _ in rows if j == i) == 1}
    assert {i: g[2] for i, g in got.items() if i in unique} == {i: w[2] for i, w in want.items() if i in unique}


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join(spark.createDataFrame([], SCHEMA)).count() == 0
    only_empty = spark.createDataFrame([(1, None, None, None, 0), (2, "", None, None, 0), (3, " \t", None, None, 0)], SCHEMA)
    assert sorted(tuple(r) for r in jaccard_join(only_empty).collect()) == [(1, 0, 1, 0), (2, 0, 2, 0), (3, 0, 3, 0)]


def test_filter_audit_against_sql(spark, tmp_path):
    rng = random.Random(3)
    rows = [(r[0], r[1], ["en", None, "de"][(r[0] or 0) % 3], None, 0) for r in awkward()]
    rows += [(60 + k, " ".join(rng.choice(VOCABULARY) for _ in range(rng.choice([150, 250, 400]))) + rng.choice(["", " #", " ABCDEFGHIJKLMNOP"]), "en", None, 0) for k in range(30)]
    rows += [(5, rows[-1][1], "en", None, 0), (None, rows[-2][1], "de", None, 0), (90, None, None, None, 0), (91, "", "en", None, 0)]
    labels = [(60, 1, 0), (61, 0, 1), (61, 1, 1), (5, 1, 1), (None, 1, 1), (999, 1, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("shapley", F.lit(7))
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    lab.write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    df = text_queries.QUERIES["op12_filter_audit"](spark, str(tmp_path))
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()))
    assert got == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({text_queries.SQL['op12_filter_audit']})").fetchall())
    assert len(got) == 3 * 600
    assert sum(r[cols.index("removed")] for r in got if r[cols.index("filter_order")] == "ABCDE") == len(rows) - sum(
        r[cols.index("kept")] for r in got if r[cols.index("filter_order")] == "ABCDE" and r[cols.index("step")] == 5)
    assert filter_audit(spark.createDataFrame([], SCHEMA), lab).count() == 0


def brute_trie(rows):
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn, role or "", text or ""))
    ordered = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[1], x[2]))] for c, v in turns.items()}
    rebuilt = {}
    for c in ordered:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = ordered.get(c - c % 100, [])[:h] + ordered[c][h:]
    nodes = collections.defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    children = collections.Counter(p[:-1] for p in nodes if p)
    out = {}
    for p, members in nodes.items():
        sub = [q for q in nodes if q[:len(p)] == p]
        out[(min(members), len(p))] = (
            min(nodes[p[:-1]]) if p else None, len(members), children[p], sum(1 for q in sub if not children[q]),
            sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in sub if q),
            hashlib.sha256(",".join(str(c) for c in sorted(c for c in members if len(rebuilt[c]) == len(p))).encode()).hexdigest(),
        )
    return out


def conversation_rows(seed=9):
    rng = random.Random(seed)
    rows = []
    for c in [0, 1, 2, 3, 5, 7, 100, 101, 102, 150, 199, 205, 300, 301, 302, 303, 304, 305, 306, 307, 308, 309]:
        for t in range(rng.randrange(0, 9)):
            rows.append((c, rng.choice([t, t, None, 3]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "hello", "", None, "how are you", "ok"])))
    rows += [(None, 1, "user", "lost"), (301, 1, "user", "hi"), (301, 1, "user", "hi")]
    return rows


def test_prefix_trie_against_brute_force(spark):
    rows = conversation_rows()
    data = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("node", F.lit(0))
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie(data).collect()}
    assert got == brute_trie(rows)
    assert max(d for _, d in got) >= 5


def test_prefix_trie_of_a_long_chain_and_of_nothing(spark):
    rows = [(c, t, "user", f"turn {t}") for c in (1000, 1001) for t in range(60)] + [(1002, None, None, None)]
    data = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie(data).collect()}
    assert got == brute_trie(rows)
    assert prefix_trie(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_line_dedup_sql_strips_all_white_space(spark, tmp_path):
    """Lines that differ only by \\r, \\v or \\f at their ends share a key, in the operator and in its SQL."""
    rows = [
        (1, "A shared line of some length\r\nfirst own line\r\n"),
        (2, "a shared line of some length\x0b\nsecond own line"),
        (3, "\x0cA SHARED line of some length\x0c\nthird\r"),
        (4, None), (5, ""),
    ]
    spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    df = text_queries.QUERIES["op3_line_dedup"](spark, str(tmp_path))
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()))
    assert got == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({text_queries.SQL['op3_line_dedup']})").fetchall())
    assert {r[cols.index("doc_id")]: r[cols.index("n_dropped")] for r in got} == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0}


def test_secret_scan_is_linear_in_a_long_run(spark):
    """A candidate run of 200,000 characters is scanned in about the time of its length, with one merged hot span."""
    import time

    from lakewarden.llm.secrets import find_secrets

    rng = random.Random(2)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    run = "".join(rng.choice(alphabet) for _ in range(200_000))
    data = spark.createDataFrame([(1, "data: " + run + " end"), (2, "x" * 200_000)], "doc_id bigint, text string")
    start = time.perf_counter()
    found = {r.doc_id: r.secrets for r in find_secrets(data).collect()}
    assert time.perf_counter() - start < 120
    assert any(m["end"] - m["start"] >= 199_000 for m in found[1]) and not found[2]


def test_jaccard_prefix_keys(spark):
    """A set emits a fifth of its shingles, frequent ones last; linked sets share a key; texts travel to buckets, not to pairs."""
    import numpy as np

    from lakewarden.llm import jaccard as jc

    rng = np.random.default_rng(4)
    none = np.zeros(0, np.uint64)
    common = np.sort(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    ranks = rng.integers(1, 4, 300)
    for n in (1, 2, 4, 5, 9, 60, 333):
        a = np.unique(np.concatenate([rng.choice(common, n // 2, replace=False) if n < 600 else common, rng.integers(0, 1 << 63, n - n // 2).astype(np.uint64)]))
        for order in ((none, none), (common, ranks)):
            key = jc.prefix(a, *order)
            assert len(key) == len(a) + (-80 * len(a) // 100) + 1 <= 0.2 * len(a) + 1
            drop = max(0, len(a) - -(-80 * len(a) // 100))
            for _ in range(5):
                b = np.sort(rng.choice(a, len(a) - drop, replace=False))  # the least subset that can link
                assert len(np.intersect1d(key, jc.prefix(b, *order)))
    assert not np.isin(jc.prefix(np.unique(np.concatenate([common[:100], rng.integers(0, 1 << 63, 200).astype(np.uint64)])), common, ranks), common).any()
    base = [f"w{k}" for k in range(80)]
    rows = [(i, " ".join(base[:70] + [f"x{i}"]), None, None, 0) for i in range(40)]
    found, links = jc.jaccard_links(spark.createDataFrame(rows, SCHEMA))
    assert links.count() == 40 * 39 // 2 and found.count() == 40


def test_jaccard_far_candidates_drop_before_their_texts(spark):
    """Short sketches never exceed the sets' difference, and pairs on one key but far apart fetch no text."""
    import numpy as np

    from lakewarden.llm import jaccard as jc

    rng = np.random.default_rng(5)
    for n in (1, 3, 17, 64, 65, 300, 40_000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for drop, more in ((0, 0), (n // 10, n // 9), (n, n), (0, 3 * n)):
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, more + 1).astype(np.uint64)]))
            assert jc.apart(jc.short_sketch(a), jc.short_sketch(b)) <= len(np.setxor1d(a, b))
    head = [f"w{k}" for k in range(30)]
    far = [(i, " ".join(head + [f"x{i}_{k}" for k in range(40)]), None, None, 0) for i in range(30)]
    twins = [(100 + i, " ".join([f"y{k}" for k in range(90)] + [f"z{i}"]), None, None, 0) for i in range(2)]
    rows = spark.createDataFrame(far + twins, SCHEMA)
    none = np.zeros(0, np.uint64)
    sets = jc.described(rows, none, none).cache()
    pairs = jc.candidates(sets).cache()
    assert pairs.count() > 100
    assert jc.near(pairs, sets).count() == 1 == jc.jaccard_links(rows)[1].count()


def test_jaccard_counts_links_in_tiles_without_a_row_for_each_pair(spark, monkeypatch):
    """One large cluster of near copies is dealt as members of tiles; its links are counted, not listed."""
    from lakewarden.llm import jaccard as jc

    monkeypatch.setattr(jc, "BLOCK", 64)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(240)]
    rows = []
    for i in range(160):
        now = list(base)
        now[rng.randrange(240)] = f"x{i}"
        now[rng.choice([3, 120, 230])] = f"y{i}"
        rows.append((i, " ".join(now)))
    rows += [(500 + i, rows[0][1]) for i in range(3)] + [(600 + i, f"{rows[i][1]} {rows[i + 1][1]}") for i in range(6)]
    data = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], SCHEMA)
    sets = jc.described(data, *jc.ordered_shingles(data)).cache()
    dealt = jc.tiles(sets).cache()
    nodes = sets.select("node").distinct().count()
    assert dealt.count() < 20 * nodes
    assert dealt.groupBy("tile", "role").count().agg({"count": "max"}).first()[0] <= 2 * 64
    assert jc.sketched(dealt, sets).count() <= dealt.count()
    got = {r.id: (r.n_shingles, r.component, r.n_links) for r in jc.jaccard_join(data).collect()}
    assert got == brute_jaccard(rows)
    assert sum(n for _, _, n in got.values()) > 20 * nodes


def test_jaccard_order_knows_common_keys_outside_the_sample(spark, monkeypatch):
    """A phrase of many rows that the sample misses is hardly a key any more; a set without it keeps its prefix."""
    import numpy as np

    from lakewarden.llm import jaccard as jc

    monkeypatch.setattr(jc, "ORDER_ROWS", 1)
    phrase = [f"p{k}" for k in range(12)]
    rows = [(i, " ".join([*phrase, *(f"x{i}_{k}" for k in range(40))]), None, None, 0) for i in range(60)]
    data = spark.createDataFrame([*rows, (99, "a b c d e f g h i j", None, None, 0)], SCHEMA)
    none = np.zeros(0, np.uint64)
    before, after = jc.described(data, none, none).collect(), jc.described(data, *jc.ordered_shingles(data)).collect()
    seen = collections.Counter(k for r in before for k in r.keys)
    assert max(seen.values()) > 40 and max(collections.Counter(k for r in after for k in r.keys).values()) < jc.HOT
    assert [sorted(r.keys) for r in before if r.id == 99] == [sorted(r.keys) for r in after if r.id == 99]
