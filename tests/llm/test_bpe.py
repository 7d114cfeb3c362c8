import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import brute
from lumenrec.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ENCODING = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def pretokens(text):
    cuts = bpe.pretoken_starts(text).tolist()
    return [text[a:b] for a, b in zip(cuts, cuts[1:] + [len(text)])]


def test_pretokens_equal_the_pattern():
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(3)
    alphabet = ["'", "s", "t", "re", "ve", "m", "ll", "d", "S", " ", " ", "\n", "\t", " ", "　", "1", "٣", "é", "中", "!", "¿", "😀", "\x1c", "​", "a", "R"]
    for _ in range(20000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 12)))
        assert pretokens(text) == pattern.findall(text), repr(text)


@pytest.mark.parametrize("chunk, overlap", [(16_384, 512), (64, 16)])
def test_encode_equals_the_library_and_round_trips(spark, sf, tmp_path, chunk, overlap):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    texts |= {-1: None, -2: "", -3: " ", -4: "a" * 5000, -5: " " * 3000 + "x", -6: "it's we'll'd '' 'S\n\n x" * 90, -7: "😀é中" * 500, -8: "ab " * 40_000, -9: "<|endoftext|>" * 9}
    docs = brute.stored(spark, tmp_path, [(k, v, 1) for k, v in texts.items()] + [(-6, texts[-6], 2)], "doc_id long, text string, ids int")
    out = bpe.decode(bpe.encode(docs, PATH, chunk, overlap), PATH)
    out.write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    rows = out.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        ids = ENCODING.encode_ordinary(texts[r["doc_id"]] or "")
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids), r["doc_id"]
        assert r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]) == (texts[r["doc_id"]] or "").encode()
    digest = {r["doc_id"]: r for r in bpe.digests(out).collect()}
    assert digest[-8]["decoded_sha256"] == hashlib.sha256(texts[-8].encode()).hexdigest()
    unpacked = {r["doc_id"]: r["a"] for r in out.where("doc_id in (-6, -1)").select("doc_id", bpe.unpack_ids(F.col("ids")).alias("a")).collect()}
    assert unpacked[-6] == ENCODING.encode_ordinary(texts[-6]) and unpacked[-1] == []


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs, PATH), PATH).count() == 0


def test_tasks_take_a_batch_in_portions(monkeypatch):
    """What a task gives at a time is bounded by bytes, not by the rows of a batch; nothing is lost or reordered."""
    import pyarrow as pa

    monkeypatch.setattr(bpe, "PORTION", 1 << 10)
    texts = ["one two three " * (i % 30) for i in range(400)] + ["long " * 3_000, None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    out = list(bpe._encode_whole(PATH)([batch, batch.slice(0, 0)]))
    assert len(out) > 50 and max(o.num_rows for o in out) < len(texts) // 2
    assert sum((o.column("doc_id").to_pylist() for o in out), []) == list(range(len(texts)))
    ids = sum((o.column("ids").to_pylist() for o in out), [])
    assert ids == [struct.pack(f"<{len(x)}I", *x) for x in (ENCODING.encode_ordinary(t or "") for t in texts)]
