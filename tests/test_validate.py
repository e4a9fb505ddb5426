from loomgrid.operators.validate import without_nulls


def test_only_forbidden_nulls_are_left_out(spark):
    schema = {"properties": {"a": {"type": "number"}, "b": {"type": ["number", "null"]}, "c": {"type": "number", "default": 1}}}
    df = spark.createDataFrame([(None, None, None, None), (1.5, 2.5, 3.5, "x, {y}")], "a double, b double, c double, d string")
    got = [r.value for r in without_nulls(df, schema).collect()]
    assert got == ['{"b":null,"c":null,"d":null}', '{"a":1.5,"b":2.5,"c":3.5,"d":"x, {y}"}']
