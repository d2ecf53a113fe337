from pavilion.sources.tables import read_csv, write_table

SCHEMA = {"match_id": "string", "date": "date", "overs": "int", "city": "string"}


def test_csv_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('overs,note,match_id,date\n20.0,"x, ""y""",m1,2020-01-02\nmany,,m2,soon\n')
    got = read_csv(spark, str(tmp_path), SCHEMA)
    assert dict(got.dtypes) == SCHEMA
    assert [(r.match_id, str(r.date), r.overs, r.city) for r in got.orderBy("match_id").collect()] == [("m1", "2020-01-02", 20, None), ("m2", "None", None, None)]


def test_csv_with_line_breaks(spark, tmp_path):
    rows = spark.createDataFrame([("m1", 'two\nlines, "quoted"', 7), ("m2", None, None)], "match_id string, city string, overs int")
    write_table(rows, f"{tmp_path}/t", form="csv")
    got = read_csv(spark, f"{tmp_path}/t", SCHEMA, multi_line=True).orderBy("match_id").collect()
    assert [(r.match_id, r.city, r.overs) for r in got] == [("m1", 'two\nlines, "quoted"', 7), ("m2", None, None)]


def test_csv_without_a_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert read_csv(spark, str(tmp_path), SCHEMA).count() == 0


def test_clustered_table_is_read_where_it_lies(spark, tmp_path):
    from pyspark.sql import functions as F

    from pavilion.operators.innings import phase_totals
    from pavilion.sources.tables import write_clustered

    rows = spark.range(600).select(
        F.concat(F.lit("m"), F.col("id") % 7).alias("match_id"), (1 + F.col("id") % 2).cast("int").alias("innings"), (1 + F.col("id") % 20).cast("int").alias("over"),
        F.col("id").cast("int").alias("ball"), (F.col("id") % 5).cast("int").alias("total_runs"), (F.col("id") % 5).cast("int").alias("batter_runs"),
        F.lit(0).alias("is_wicket"), F.lit(1).alias("in_powerplay"))
    table = write_clustered(rows, "clustered_balls", str(tmp_path / "clustered"), 4)
    totals = phase_totals(table)
    assert "Exchange" not in totals._jdf.queryExecution().executedPlan().toString()
    assert sorted(totals.collect()) == sorted(phase_totals(rows).collect()) and table.count() == 600
    spark.sql("DROP TABLE clustered_balls")
