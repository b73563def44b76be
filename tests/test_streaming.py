from gridloom.streaming import accumulate


def test_a_stream_of_pixels_adds_up(spark, tmp_path):
    spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "y long, x long, v double").write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame([(0, 0, 5.0)], "y long, x long, v double").write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema("y long, x long, v double").parquet(f"{tmp_path}/in/*")
    query = accumulate(stream).writeStream.outputMode("complete").format("memory").queryName("grown").option("checkpointLocation", f"{tmp_path}/state").start()
    try:
        query.processAllAvailable()
        assert sorted(map(tuple, spark.table("grown").collect())) == [(0, 0, 6.0), (0, 1, 2.0)]
    finally:
        query.stop()


def test_the_entry_runs_without_the_subpackage(monkeypatch):
    import sys

    import __spark_entry__

    for name in [n for n in sys.modules if n.startswith("gridloom.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    import gridloom

    monkeypatch.delattr(gridloom, "llm", raising=False)

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("gridloom.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    names = __spark_entry__.queries()
    assert "area_of_habitat" in names and not any(n.startswith("op") for n in names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)
