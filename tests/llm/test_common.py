from pyspark.sql import functions as F

from kinweave.llm import common


def test_rows_keep_their_places(spark, tmp_path):
    """Numbers of rows hold however a job splits its input, whatever a file's name; rows of no files are written down."""
    path = str(tmp_path / "a folder, with ümlaut & 50%")
    spark.range(200).select("id", F.lit("x").alias("path")).repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    one = {(r.row, r.id) for r in common.placed(df).collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert {(r.row, r.id) for r in common.placed(spark.read.parquet(path)).collect()} == one
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r for r, _ in one}) == 200 and {i for _, i in one} == set(range(200))
    some = common.placed(df.where("id % 7 = 0").select("id"))
    assert some.columns == ["row", "id"] and {(r.row, r.id) for r in some.collect()} == {x for x in one if x[1] % 7 == 0}
    assert len({r.row for r in common.placed(spark.range(50)).collect()}) == 50
    assert common.placed(spark.range(0)).count() == 0
