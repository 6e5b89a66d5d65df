"""What a run writes into its plans."""

from pyspark.sql import functions as F

from tessera.operators import radiometry


def test_stretched_values_are_computed_once(spark):
    pixels = spark.range(40).select(F.lit("a").alias("image_id"), *((F.col("id") * (k + 1)).cast("int").alias(f"b{k}") for k in range(3)))
    params = spark.createDataFrame([("a", 4, 60, [50.0, 60.0, 40.0])], "image_id string, lower long, upper long, white array<double>")
    out = radiometry.corrected(pixels, params, ["image_id"], ["b0", "b1", "b2"], True)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("* 254") == 3

    def expected(v, white):
        return 0 if v == 0 else max(1, min(255, int(60 / white * ((min(max(v, 4), 60) - 4) * 254 // 56 + 1))))

    assert sorted((r.b0, r.b1, r.b2) for r in out.collect()) == sorted(tuple(expected(i * (k + 1), w) for k, w in enumerate((50.0, 60.0, 40.0))) for i in range(40))
