import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from histria.llm import kernels as K
from histria.llm import packing as P


def check(spark, rows, capacity=4096, unit=8):
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, cls int")
    got = P.pack(df, capacity=capacity, unit=unit).collect()
    t = Tokenizer.from_file(P.tokenizer_path())
    want = sorted(((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, x in rows for i in [t.encode(x or "", add_special_tokens=False).ids + [2]] if len(i) <= capacity), key=str)
    whole = sorted(((r["doc_id"], r["length"], r["ids_crc32"]) for r in got if r["length"] == r["doc_tokens"]), key=str)
    assert whole == want
    ids = {d: [t.encode(x or "", add_special_tokens=False).ids + [2] for c, x in rows if c == d] for d, _ in rows}
    for d, texts in ids.items():
        for x in texts:
            mine = sorted((r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == d and r["doc_tokens"] == len(x))
            cuts = [(a, len(x[a : a + capacity]), zlib.crc32(np.array(x[a : a + capacity], "<u4").tobytes())) for a in range(0, len(x), capacity)]
            assert mine == sorted(cuts * texts.count(x))
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in seqs.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= capacity
    return got, seqs


def test_pack_edges(spark):
    r = random.Random(4)
    words = [f"word{i}," for i in range(50)] + ["Éte", "<|endoftext|>", "it's", "!!", "naïve"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 60)))) for i in range(80)] + [(200, None), (201, ""), (202, "x y " * 500), (7, "again"), (7, "again"), (None, "no id")]
    got, seqs = check(spark, rows, 128, 4)
    assert len(got) > len(rows)
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_encoder_equals_the_tokenizer():
    t = Tokenizer.from_file(P.tokenizer_path())
    texts = ["It's 3.5, they'll GO!!  now\u00a0here", "é, è. ñ!", "<|endoftext|>A <|ENDOFTEXT|> b", "", "İstanbul ǅ ﬁ \u0301x a\u0301 K", "a.b.c, (x) [y]; z…", "don't. 'tis,' 'S", "漢字 かな, 한국어."]
    texts += ["".join(random.Random(s).choice("aB.,!' \n\té3<|漢") for _ in range(80)) for s in range(300)]
    (s,) = K.text_slices(iter([pa.record_batch([pa.array(texts)], ["t"])]), "t")
    ids, off = P.Encoder(P.tokenizer_path()).encode(s.data, s.off)
    for i, x in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_cutting_stock_holds_the_demand_with_little_waste():
    r = np.random.default_rng(5)
    sizes = np.arange(1, 65)
    demand = np.where(sizes < 24, r.integers(0, 400, 64), 0).astype(float)
    keep = demand > 0
    patterns, least = P.cutting_stock(sizes[keep], demand[keep], 64)
    total = sum(p * n for p, n in patterns)
    assert (total == demand[keep]).all() and all((p * sizes[keep]).sum() <= 64 for p, _ in patterns)
    assert (sizes * demand).sum() / 64 - 1e-6 <= least <= sum(n for _, n in patterns) <= least + keep.sum()
    assert sum(n for _, n in patterns) * 64 <= (sizes * demand).sum() * 1.02 + 64


def test_numbers_are_stable_and_other_tokenizers_refused(spark, tmp_path):
    spark.createDataFrame([(i, "word " * (i % 40)) for i in range(300)], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    one, two = (sorted(map(tuple, P.query(spark, str(tmp_path)).collect())) for _ in range(2))
    assert one == two and len(one) == 300
    other = tmp_path / "other.json"
    other.write_text(open(P.tokenizer_path()).read().replace('"Lowercase"', '"Strip", "strip_left": true, "strip_right": true'))
    with pytest.raises(ValueError):
        P.Encoder(str(other))


def test_an_idle_worker_holds_little():
    """Workers outnumber cores: what waits has no tables of powers and no threads of the tokenizer."""
    import os

    texts = pa.record_batch([pa.array(["the packed text of a worker"] * 3)], ["text"])
    sizes = []
    for s in K.text_slices(iter([texts]), "text", P.ENCODED_BYTES, keep="encoder"):
        P.encoder(P.tokenizer_path()).encode(s.data, s.off)
        sizes.append(len(s.data))
    assert sizes == [81] and not K._powers and os.environ["TOKENIZERS_PARALLELISM"] == "false"
