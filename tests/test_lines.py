from histria.sources import readers


def files(tmp_path, texts):
    for i, t in enumerate(texts):
        (tmp_path / f"part-{i:02d}.txt").write_bytes(t.encode())
    return str(tmp_path)


def test_lines_are_numbered_in_the_order_of_the_files(spark, tmp_path):
    texts = ["".join(f"f{i} line {k} {'x' * (k * 7 % 50)}\n" for k in range(n)) for i, n in enumerate((150, 0, 1, 90))] + ["last without end"]
    want, place = [], 0
    for i, t in enumerate(texts):
        for k, line in enumerate(t.splitlines()):
            want.append((line, f"part-{i:02d}.txt", k, place))
            place += 1
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("300", "5000", old):  # many blocks a file, some without a line of their own; and one a file
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = readers.numbered_lines(spark, files(tmp_path, texts)).collect()
            assert sorted((r["value"], r["file"].rpartition("/")[2], r["line"], r["place"]) for r in got) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_capped_fields_and_json(spark, tmp_path):
    path = files(tmp_path, ["a,b|c\n" + "".join(f"{k},v{k}|{k},more\n" for k in range(20)), "a,b|c\n100,x\n\n102,y,z\n"])
    got = [tuple(r) for r in readers.capped_fields(spark, path, ["a", "b"], 22).orderBy("place").collect()]
    assert got == [(k, str(k), f"v{k}|{k}") for k in range(20)] + [(20, "100", "x"), (21, "", None)]
    assert [r["b"] for r in readers.capped_fields(spark, path, ["a", "b"], 3, sep="|", header=False).orderBy("place").collect()] == ["c", "0,more", "1,more"]
    (tmp_path / "j").mkdir()
    path = files(tmp_path / "j", ['{"a": 1}\nnot json\n{"a": 3, "b": "x"}\n{"a": 4}\n'])
    assert [tuple(r) for r in readers.capped_json(spark, path, "a BIGINT, b STRING", 3).orderBy("place").collect()] == [(0, 1, None), (1, None, None), (2, 3, "x")]
