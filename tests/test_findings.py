"""Queries beside their SQL on small tables of the rows in which they once differed."""

import glob
import hashlib
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import dataset as D
from graphloom.operators import review as R
from graphloom.plans import registry
from graphloom.sources.tables import shared_dir
from test_queries import rows


def beside_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL on these tables."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(folder))
    found = con.execute(registry.oracle_sql()[name])
    return rows(df.collect(), df.columns), rows(found.fetchall(), [d[0] for d in found.description])


def test_a_paper_without_hits_has_an_empty_text_of_queries(spark, tmp_path):
    customer = spark.createDataFrame([(1,), (2,)], "c_custkey long")
    orders = spark.createDataFrame([(1, "5-LOW"), (1, "1-URGENT"), (1, "5-LOW")], "o_custkey long, o_orderpriority string")
    mine, sql = beside_sql(spark, tmp_path, "annotate_query_provenance", customer=customer, orders=orders)
    assert mine == sql and mine[0] == [(1, "1-URGENT;5-LOW", "pack"), (2, "", "pack")]


def test_an_empty_sentence_puts_no_space_before_the_paper(spark, tmp_path):
    documents = spark.createDataFrame([(1, "Rather long."), (2, "Rat liver."), (3, "A rather long text."), (4, "none"), (5, "")], "doc_id long, text string")
    lines = spark.createDataFrame([(i, 1, i, i, 1.0, 0.1, "N") for i in range(1, 7)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_returnflag string")
    mine, sql = beside_sql(spark, tmp_path, "qualifier_enrich", documents=documents, lineitem=lines)
    assert mine == sql
    assert {r[2]: r[4] for r in mine[0]} == {"1": None, "2": "rat", "3": "rat", "4": None, "5": None, "6": None}


@pytest.mark.parametrize("name", ["active_learning_reasons", "candidate_priority"])
def test_which_rows_lack_evidence_follows_from_the_id(spark, tmp_path, name):
    texts = ["", "  ", None, "a text"]
    documents = spark.createDataFrame([(i, texts[i % 4], 4000) for i in range(1, 24)], "doc_id long, text string, n_chars long")
    mine, sql = beside_sql(spark, tmp_path, name, documents=documents)
    assert mine == sql and len(mine[0]) == 23
    blank = [T.active_learning_reasons(F.array().cast("array<string>"), F.lit(False), F.lit("LABEL_0"), F.lit("1"), F.lit(t)) for t in texts]
    assert [list(r) for r in spark.range(1).select(*blank).first()] == [["missing evidence text"]] * 3 + [[]]


def table_bytes(spark):
    """Bytes of the intermediate tables written so far."""
    at = shared_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(f) for f in glob.glob(f"{at}/table-*/*.parquet"))


def test_negatives_write_few_bytes_a_positive(spark):
    rows = spark.range(0, 20_000, 1, 4).selectExpr("id div 4 as group_id", "'p' || (id * 7919) % 2000 as head", "'s' || (id * 104729) % 1000 as tail").distinct()
    before = table_bytes(spark)
    assert D.negative_samples(rows).count() == rows.count()
    assert table_bytes(spark) - before < 60 * 20_000


@pytest.mark.parametrize("small", [0, 2, 256])
def test_negatives_of_small_and_large_groups_are_the_same(spark, small):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, None]), f"h{rng.randrange(6)}", rng.choice([f"t{rng.randrange(5)}", " ", None, f" h{rng.randrange(6)}"])) for _ in range(50)]
    df = spark.createDataFrame(rows, "group_id int, head string, tail string")
    ends, known = {}, {(g, a, (b or "").strip()) for g, a, b in rows}
    for g, *x in rows:
        ends.setdefault(g, set()).update(v.strip() for v in x if (v or "").strip())
    pairs = {(g, a, b) for g, e in ends.items() if g for a in e for b in e if a != b} - known
    order = sorted(pairs, key=lambda p: hashlib.sha256(f"13|{p[0]}|{p[1]}|{p[2]}".encode()).hexdigest())
    for ratio in (0.3, 1.0, 9.0):
        got = [tuple(r)[:3] for r in D.negative_samples(df, ratio, small=small).collect()]
        assert sorted(got) == sorted(order[: int(len(rows) * ratio)]), ratio


def test_quality_compares_keys_whose_hashes_come_again(spark):
    rows = [(1, "a", "b", "T"), (1, "a", "b", "T"), (1, "a", "b", "NO_RELATION"), (2, None, "b", "T"), (2, "", "b", "T"), (3, "c", "c", "T"), (None, "a", "b", "T")]
    got = D.relation_quality(spark.createDataFrame(rows, "group_id int, head string, tail string, label string"))
    assert got.first().asDict() == {"rows": 7, "positive": 6, "negative": 1, "missing_endpoint": 2, "identical": 1, "duplicates": 2}
    assert D.relation_quality(got.sparkSession.createDataFrame([], "group_id int, head string, tail string, label string")).first().duplicates == 0


def test_skipped_positives_are_those_of_groups_with_one_end(spark):
    rows = [(1, "a", "b"), (1, "a", " "), (2, "a", None), (2, " a", "a"), (3, "a", ""), (3, "", "b"), (4, None, " "), (None, "x", "y"), (None, "x", None), (5, "q", "q")]
    df = spark.createDataFrame(rows, "group_id int, head string, tail string")
    assert D.negative_report(df, df.limit(1)).first().skipped == 4


def test_several_texts_are_looked_for_in_one_reading(spark):
    texts = ["A LICENSE fee", "Straße", "only €", "ﬁne licenſe", None, "STRASSE €", "nothing"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: list(r.held) for r in R.texts_held(rows, "text", ("License", "€", "straSSe", "FIN")).collect()}
    assert got == {0: ["License"], 1: ["straSSe"], 2: ["€"], 3: ["License", "FIN"], 5: ["€", "straSSe"]}


def test_search_makes_no_index_of_grams(spark, tmp_path):
    words = ["license", "The", "price", "€", "a", "thing", "LICENSE"]
    documents = spark.createDataFrame([(i, " ".join(words[(i * k) % 7] for k in range(1, 60)) + " zz" * i, "abc"[i % 3], i) for i in range(60)], "doc_id long, text string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    before = table_bytes(spark)
    mine, sql = beside_sql(spark, tmp_path, "search_curated_evidence", documents=documents, labels=labels)
    assert mine == sql and len(mine[0]) == 50
    assert table_bytes(spark) - before < 20_000
