from fieldweave.operators import trees


def test_deep_trees_are_walked_to_the_end(spark):
    text = '{"k":' * 20 + '"end"' + "}" * 20
    df = spark.createDataFrame([(1, text)], "id long, j string")
    rows = trees.deep_triples(df, "j", key="id", base="b/").collect()
    assert len(rows) == 20 and ["end"] == [r["object"] for r in rows if r["object_kind"] == "literal"]


def test_gather_keeps_every_name(spark):
    df = spark.range(10_050).selectExpr("1L as id", "0 as pos", "concat('n', id) as name", "'v' as value")
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    try:
        assert len(trees.gather(df, ["id"]).columns) == 10_051
    finally:
        spark.conf.unset("spark.sql.codegen.wholeStage")
