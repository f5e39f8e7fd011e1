import pytest
from pyspark.sql import functions as F
from support import assert_same, duck

from corpusmill.queries import ORACLES, QUERIES


@pytest.mark.parametrize("cut", [493, 496, 499])
@pytest.mark.parametrize("name", ["constrained_assignment", "figure_modes"])
def test_last_figure_may_be_incomplete(spark, small, tmp_path, name, cut):
    spark.read.parquet(f"{small}/embeddings.parquet").filter(F.col("vec_id") < cut).coalesce(1).write.parquet(str(tmp_path / "parts"))
    (part,) = (tmp_path / "parts").glob("*.parquet")
    part.rename(tmp_path / "embeddings.parquet")
    assert_same(QUERIES[name](spark, str(tmp_path)), duck(tmp_path).sql(ORACLES[name]))
