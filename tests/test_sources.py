from veilgrove.sources import tables as T


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    rows = [(1, 2.5), (3, 4.5)]
    read = lambda df: sorted(map(tuple, df.collect()))
    assert read(T.headerless(spark, put("a", "1,2.5\n3, 4.5\n"), "a int, b double")) == rows
    assert read(T.headerless(spark, put("b", "1;2.5\n3;4.5\n"), "a int, b double", ";")) == rows
    assert read(T.with_header(spark, put("c", "x,y\n1,2.5\n3,4.5\n"), "a int, b double")) == rows
    assert read(T.after_lines(spark, put("d", "junk\nx,y\n1,2.5\n3,4.5\n"), "a int, b double", 2)) == rows
    assert read(T.arff(spark, put("e", "% c\n@relation r\n@attribute a numeric\n@data\n1,2.5\n\n3,4.5\n"), "a int, b double")) == rows


def test_lines_that_come_again_stay(spark, tmp_path):
    (tmp_path / "x").write_text("1,2.0\n1,2.0\n3,4.0\n1,2.0\n")
    got = T.after_lines(spark, str(tmp_path / "x"), "a int, b double", 1).collect()
    assert sorted(map(tuple, got)) == [(1, 2.0), (1, 2.0), (3, 4.0)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20")
    try:
        (tmp_path / "y").write_text("head\n" + "".join(f"{i},1.0\n" for i in range(50)))
        assert sorted(r.a for r in T.after_lines(spark, str(tmp_path / "y"), "a int, b double", 4).collect()) == list(range(3, 50))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
