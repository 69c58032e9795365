"""All registered text queries over test tables, empty tables, and tables with nulls, repeats and clashing columns."""

import os


import duckdb
import pytest
from pyspark.sql import functions as F

from folioflow.llm import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = ["extractions", "blocks", "text_lines", "documents", "sentence_tasks", "eval_items", "mix_targets", "common_words"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
ALL = sorted(Q.queries())
FOUND = {
    "p1_found": "tbl string, rec_id bigint, lang string", "p2_found": "block_id bigint, kind string, start_char int", "p3_found": "block_id bigint, kind string", "p4_found": "block_id bigint, end_char int",
    "p5_found": "line_id bigint, kind string", "p7_found": "block_a bigint, block_b bigint", "p8_found": "doc_id bigint, item_id bigint", "p10_found": "doc_id bigint",
}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A part of each table, with a null put in each column in turn, repeated rows, and extra columns."""
    d = str(tmp_path_factory.mktemp("odd"))
    for t in TABLES:
        df = spark.read.parquet(f"{SF}/{t}.parquet").limit(60)
        out = df.unionByName(df.limit(7))
        for c in df.columns:
            out = out.unionByName(df.limit(2).withColumn(c, F.lit(None).cast(df.schema[c].dataType)))
        extra = ["id", "key", "n", "kind", "word", "words", "tokens", "votes", "raw", "value", "cell", "day", "tbl", "rec_id", "cut", "line", "unit", "skip", "run", "mask", "left", "tail", "_r", "start_char", "whole"]
        out.select("*", *[F.lit("x").alias(c) for c in extra if c not in df.columns]).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.mark.parametrize("name", ALL)
def test_empty(spark, empty, name):
    n = Q.queries()[name](spark, empty).count()
    assert n == 0


@pytest.mark.parametrize("name", ALL)
def test_odd(spark, odd, name):
    df = Q.queries()[name](spark, odd)
    rows = df.collect()
    if name in FOUND:
        assert len(rows) == len(set(rows)) and not any(v is None for r in rows for v in r)


@pytest.mark.parametrize("name", sorted(FOUND))
def test_found(spark, name):
    df = Q.queries()[name](spark, SF)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == FOUND[name]
    rows = df.collect()
    assert len(rows) == len(set(rows)) and (rows or name in ("p7_found",))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = Q.queries()[name](spark, SF)
    cur = c.execute(Q.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted((tuple(norm(r[k]) for k in sorted(cols)) for r in df.collect()), key=str) == sorted((tuple(norm(r[cols.index(k)]) for k in sorted(cols)) for r in cur.fetchall()), key=str)


def test_block_statistics(spark):
    got = {r.block_id: r for r in Q.queries()["p3_block_stats"](spark, SF).collect()}
    texts = {r.block_id: r.text for r in spark.read.parquet(f"{SF}/blocks.parquet").where("block_id is not null").select("block_id", "text").distinct().collect()}
    assert set(got) == set(texts)
    assert all(got[i].n_words == len((t or "").split()) for i, t in texts.items() if (t or "").isascii()) and all(got[i].kind for i, t in texts.items() if t)


def test_all_problems_have_queries():
    assert {int(k[1:].split("_")[0]) for k in ALL} == set(range(1, 11)) and set(FOUND) <= set(ALL)


@pytest.mark.parametrize("name,wanted", [("p9_shares", True), ("p9_shares_exact", False)])
def test_shares(spark, name, wanted):
    got = Q.queries()[name](spark, SF).collect()
    live = [r for r in got if r.available and r.target_share]
    assert live and abs(sum(r.actual_share for r in got) - 1) < 1e-4 and all(r.tokens <= r.available * r.max_repeats + 1 and r.most_repeats <= r.max_repeats for r in got)
    if wanted:  # clamped sources are full, and the others share the rest in proportion
        free = [r for r in live if r.tokens < 0.98 * r.available * r.max_repeats]
        per = [r.tokens / r.target_share for r in free]
        assert free and len(free) < len(live) and max(per) < 1.25 * min(per)
        assert abs(sum(r.tokens for r in got) / min(sum(r.available for r in live), sum(r.available * r.max_repeats for r in live)) - 1) < 0.05
        assert {(r.source, r.tokens) for r in got} == {(r.source, r.t or 0) for r in Q.queries()["p9_mix"](spark, SF).groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("t")).collect()} | {(r.source, 0) for r in got if not r.tokens}


def test_every_record_with_text_has_a_row(spark):
    got = {(r.tbl, r.rec_id) for r in Q.queries()["p1_languages"](spark, SF).collect()}
    b = spark.read.parquet(f"{SF}/blocks.parquet").where("extraction_id is not null and length(text) > 0")
    d = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 0")
    assert got == {("extractions", r.extraction_id) for r in b.select("extraction_id").distinct().collect()} | {("documents", r.doc_id) for r in d.select("doc_id").collect()}
