def rows_of(spark, folder, name="documents"):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]
