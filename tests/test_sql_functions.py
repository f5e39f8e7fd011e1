import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.functions import tables


@pytest.fixture(scope="module")
def sql(spark):
    tables.register(spark)
    return spark.sql


def packs(rows, budget):
    """(key, pack, n, total, first, last) by hand."""
    out = []
    for key in {r[0] for r in rows}:
        open_packs = []
        for _, item, size in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            if not open_packs or sum(s for _, s in open_packs[-1]) + (size or 0) > budget:
                open_packs.append([])
            open_packs[-1].append((item, size or 0))
        out += [(key, i, len(p), sum(s for _, s in p), p[0][0], p[-1][0]) for i, p in enumerate(open_packs)]
    return out


CALL = "SELECT * FROM pack_rows(budget => %d, rows => TABLE(SELECT * FROM {df}) PARTITION BY key ORDER BY item)"


def test_packs_equal_those_by_hand(spark, sql):
    rows = [(k, f"i{i:03}", None if i % 9 == 0 else i * 7 % 31) for i in range(120) for k in ("a", None)[: 1 + i % 2]] + [("b", "i000", 500)]
    df = spark.createDataFrame(rows, "key string, item string, size long")
    for budget in (0, 30, 100, 10**6):
        got = sql(CALL % budget, df=df)
        assert got.schema["first_item"].dataType.simpleString() == "string"
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(packs(rows, budget), key=repr)
    assert sql(CALL % 5, df=df.limit(0)).count() == 0


def test_schema_follows_the_table_and_is_checked(spark, sql):
    df = spark.sql("SELECT date'2024-01-01' AS key, 1.5D AS more, 7 AS item, 2L AS size")
    got = sql("SELECT * FROM pack_rows(budget => 10, rows => TABLE(SELECT * FROM {df}) PARTITION BY (key, more) ORDER BY item)", df=df)
    assert [f.dataType.simpleString() for f in got.schema] == ["date", "double", "bigint", "bigint", "bigint", "int", "int"]
    assert got.count() == 1
    with pytest.raises(Exception, match="columns item and size"):
        sql("SELECT * FROM pack_rows(budget => 10, rows => TABLE(SELECT 1 AS item) PARTITION BY item)").collect()
    with pytest.raises(Exception, match="budget"):
        sql(CALL.replace("%d", "-1"), df=df).collect()


@given(st.lists(st.one_of(st.none(), st.integers(0, 1000)), max_size=20))
@settings(max_examples=50, deadline=None)
def test_entropy_of_counts(counts):
    import math

    import pyarrow as pa

    told = tables.entropy_bits(pa.array(counts, pa.int64()))
    n = [c for c in counts if c]
    assert told == pytest.approx(-sum(c / sum(n) * math.log2(c / sum(n)) for c in n), abs=1e-9)


def test_entropy_from_sql(spark, sql):
    got = {r.k: r.e for r in sql("SELECT k, entropy_bits(n) AS e FROM VALUES ('a', 1L), ('a', 1L), ('b', 5L), (NULL, NULL) AS t(k, n) GROUP BY k").collect()}
    assert got == {"a": 1.0, "b": 0.0, None: 0.0}
