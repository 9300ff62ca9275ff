"""Linkage within blocks of more pairs than are compared at once, held against SQL and against all pairs."""

import math
import random
from difflib import SequenceMatcher
from functools import cache

import duckdb
import pytest
from pyspark.sql import functions as F

from datawright import queries as core
from datawright.operators import linkage

ROWS = 2_100  # of one block: 2,203,950 pairs


def all_pairs(rows, minimum=linkage.MINIMUM, limit=linkage.LIMIT):
    """Rows of (id, folded text, number), compared each with each."""
    ratio = cache(lambda a, b: 1.0 if a == b else SequenceMatcher(None, a, b).ratio())
    rows, found = sorted(rows), []
    for i, (left, a, x) in enumerate(rows):
        for right, b, y in rows[i + 1 :]:
            far = None if x is None or y is None or math.isnan(x) or math.isnan(y) else abs(x - y) / max(abs(x), abs(y), 1.0)
            number = 0.5 if far is None else 0.0 if math.isnan(far) else max(0.0, 1 - far)
            if (1.0 + number) / 2 >= minimum:
                text = 0.5 if a is None or b is None else ratio(a, b)
                if (text + number) / 2 >= minimum:
                    found.append((left, right, (text + number) / 2, text, number))
    return sorted(found, key=lambda p: (-p[2], p[0], p[1]))[:limit]


@pytest.mark.parametrize("types", [6, 1_000, 2_000])  # the last has fewer pairs than the limit
def test_pairs_of_a_large_block_match_sql(spark, tmp_path, types):
    made = random.Random(types)
    brands = [("Brand#1", 12), ("Brand#11", 2)]  # one block, as the key joins them
    rows = [(k, "x", brands[k % 2][0], f"Type {k % types}", brands[k % 2][1], round(made.uniform(1, 1_000), 2)) for k in range(ROWS)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(core.SQL["linkage_pairs"]).fetchall()
    assert len(want) == 500 if types < 2_000 else 0 < len(want) < 100
    assert [tuple(r) for r in core.QUERIES["linkage_pairs"](spark, str(tmp_path)).collect()] == want


def test_pairs_of_a_large_block_with_odd_rows(spark):
    """Copies, missing and odd numbers, missing and empty texts, in every order of ids; the limit cuts ties."""
    made = random.Random(3)
    numbers, texts = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1e-20, -0.4, 0.4, 1.0, 1.0000001, -1.02, 5.0, 5.1, -5.0, 1e9, 1.01e9, 1e300], [None, "", "ab", "abc", "abd", "west street 12", "west street 21"]
    for many in (1_900, 0):  # of one row with a missing text, or none
        rows = [(k, None, 5.0) if k < many else (k, made.choice(texts), made.choice(numbers) if many else made.uniform(-1e6, 1e6)) for k in range(ROWS)]
        made.shuffle(rows)
        d = spark.createDataFrame(rows, "id long, t string, x double").withColumn("b", F.lit("one"))
        for limit in (40, 3_000):
            got = [tuple(r) for r in linkage.link(d, ["t", "x"], "b", limit=limit, key="id", whole=True).collect()]
            assert got == all_pairs(rows, limit=limit)
        with pytest.raises(linkage.BlockTooLarge):
            linkage.link(d, ["t", "x"], "b", key="id")


def test_bands_part_no_near_numbers(spark):
    made = random.Random(5)
    for apart in (1e-9, 0.001, 0.1, 0.45):
        pairs = []
        for _ in range(5_000):
            a = made.choice((-1, 1)) * 10 ** made.uniform(-3, 3)
            b = a + made.choice((-1, 1)) * apart * max(abs(a), 1.0) * made.uniform(0.9, 2)
            if abs(a - b) / max(abs(a), abs(b), 1.0) <= apart:
                pairs.append((a, b))
        d = spark.createDataFrame(pairs, "a double, b double")
        assert len(pairs) > 100 and d.filter(F.abs(linkage._band(F.col("a"), apart) - linkage._band(F.col("b"), apart)) > 1).isEmpty()


@pytest.mark.parametrize("names", [60, ROWS])  # with and without copies of names
def test_similar_names_of_a_large_block(spark, tmp_path, names):
    made = random.Random(names)
    rows = [(k, f"Supplier#{k * 7 % names:09d}", 7, round(made.uniform(-1_000, 10_000), 2)) for k in range(ROWS)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    want = all_pairs([(k, name.lower(), x) for k, name, _, x in rows], minimum=0.95)
    assert len(want) == 500
    assert [tuple(r) for r in core.QUERIES["linkage_similar_names"](spark, str(tmp_path)).collect()] == want
