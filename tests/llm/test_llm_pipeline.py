"""The registered text queries, and the pipeline against stages in plain Python."""

import collections
import itertools
import os
import random

import duckdb
import pytest
import sentencepiece

import __spark_entry__ as contract
import corpus_pipeline
from lakewarden.llm import queries as text_queries
from test_llm_operators import ITEM, SCHEMA, VOCABULARY, awkward, lower, shingles, words

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(contract.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in text_queries.QUERIES}
    assert {*text_queries.QUERIES, "pipeline"} <= names and set(text_queries.SQL) <= set(contract.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "sentence_pieces"]


@pytest.mark.parametrize("name", sorted(text_queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = contract.queries()[name](spark, SF)
    columns = sorted(df.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({text_queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(expected)


def stages_in_python(rows, items):
    """(doc_id, text) after each of the first four stages; too few labels certify a cutoff."""
    def passes(text):
        w = words(text, False)
        counts = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if counts[tuple(w[k:k + 5])] > 1 for j in range(k, k + 5)}
        return len(w) >= 10 and 100 * len(covered) <= 20 * len(w)

    now = [(i, t) for i, t in rows if passes(t or "")]
    yield now
    key = lambda line: lower(line.strip(" \t\n\r\x0b\x0c"))
    owner = {}
    for i, t in now:
        for line in t.split("\n"):
            if i is not None and len(key(line)) >= 10:
                owner[key(line)] = min(i, owner.get(key(line), i))
    now = [(i, "\n".join(x for x in t.split("\n") if i is None or owner.get(key(x), i) == i)) for i, t in now]
    yield now
    sets = {i: shingles(t) for i, t in now if i is not None}
    part = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            lo, hi = sorted((part[a], part[b]))
            part = {i: lo if p == hi else p for i, p in part.items()}
    now = [(i, t) for i, t in now if i is None or part[i] == i]
    yield now
    yield [(i, t) for i, t in now if i is None or not any(100 * len(shingles(t) & shingles(x)) >= 80 * len(shingles(x)) for x in items)]


def test_pipeline_against_plain_python(spark, tmp_path):
    rows = awkward()
    data = spark.createDataFrame(rows, SCHEMA)
    data.write.parquet(os.path.join(tmp_path, "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(os.path.join(tmp_path, "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (48, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(os.path.join(tmp_path, "labels.parquet"))
    steps = list(stages_in_python([(r[0], r[1]) for r in rows], [ITEM]))
    assert len({len(s) for s in steps}) > 2
    docs = spark.read.parquet(os.path.join(tmp_path, "documents.parquet"))
    for (name, stage), expected in zip(corpus_pipeline.STAGES, steps):
        docs = corpus_pipeline.pinned(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == data.columns
        assert sorted([(r.doc_id, r.text) for r in docs.collect()], key=str) == sorted(expected, key=str), name
    library = sentencepiece.SentencePieceProcessor(model_file=text_queries.piece_model())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted([(r.doc_id, str(r.ids), r.n_tokens) for r in last], key=str) == sorted([(i, str(library.encode(t)), len(library.encode(t))) for i, t in steps[-1]], key=str)


def test_pipeline_of_nothing(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("benchmark", "item_id bigint, text string"), ("labels", "doc_id bigint, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(os.path.join(tmp_path, f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_stage_links_from_four_fifths(spark):
    """Near copies between 0.80 and 0.85 go, those under 0.80 stay, whatever the ids between them."""
    rng = random.Random(8)
    texts = {}
    for k in range(30):
        base = [f"{rng.choice(VOCABULARY)}{rng.randrange(99)}" for _ in range(84)]
        for j, cuts in enumerate([(), (20, 40), (10, 30, 50)]):  # 80 shingles: 70 of 90, then 65 of 95, shared with the base
            now = list(base)
            for c in cuts:
                now[c] = f"new{k}x{j}x{c}"
            texts[10 * k + j] = " ".join(now)
        now = list(base)
        now[2], now[60] = f"head{k}", f"tail{k}"  # 72 of 88: 0.818
        texts[10 * k + 5] = " ".join(now)
    sets = {i: shingles(t) for i, t in texts.items()}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(0.80 <= near(10 * k, 10 * k + 5) < 0.85 and near(10 * k, 10 * k + 1) < 0.80 for k in range(30))
    data = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in texts.items()], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, data, "").collect()}
    assert kept == {i for i in texts if i % 10 != 5}


def test_signature_bounds_follow_the_percent():
    from lakewarden.llm.neardup import layout, sure

    assert (sure(85), sure(80)) == (82, 73) and layout(85) == (25, 5)
    for percent in (80, 85):
        n, width = layout(percent)
        assert n * width <= 125 and (1 - (percent / 100) ** width) ** n < 1e-6
