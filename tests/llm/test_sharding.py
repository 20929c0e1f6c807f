import zlib

from histria.llm import sharding as S


def test_bytes_law(spark):
    rows = [(i * 7 % 500, "é" * (i % 50), 1) for i in range(500)] + [(None, "null id", 1), (3, None, 1), (3, "", 1), (3, "", 1), (900, "x" * 5000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int")
    got = S.shard_by_bytes(df, 8).collect()
    assert len(got) == len(rows)
    want = sorted(((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == want
    total = sum(r["size"] for r in got)
    last = (False, -1)
    for k in range(8):
        mine = sorted((r for r in got if r["shard"] == k), key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        ids = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in mine]
        assert ids == sorted(ids) and last <= ids[0]
        last = ids[-1]
        assert abs(sum(r["size"] for r in mine) - total / 8) <= 5016
    assert S.shard_by_bytes(df.where("false")).count() == 0
