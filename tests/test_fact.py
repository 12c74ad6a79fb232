from starmodel.operators import fact


def test_line_rejects(spark):
    detail = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (None, 4)], "SalesOrderID long, SalesOrderDetailID long")
    header = spark.createDataFrame([(1, "a"), (None, "b")], "SalesOrderID long, Status string")
    out = fact.line_rejects(detail, header)
    assert out.columns == [*detail.columns, "reject_reasons"]
    assert sorted((r.SalesOrderDetailID, r.reject_reasons) for r in out.collect()) == [(3, ["no such order"]), (4, ["SalesOrderID is missing"])]
