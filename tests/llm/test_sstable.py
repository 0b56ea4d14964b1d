import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import sstable

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("text", ["Hello <|endoftext|> it's I'LL\tfoo bar\x1cbaz", "ÀÉ éx 日本語 ǅ ß İ ſt 12a_b <|x Ⅳ½²", "'S 'Re\r\n don't<|startoftext|>x", "é ́x", "", "  \n "])
def test_ids_equal_the_tokenizers(text):
    want = ids_of(text)
    assert sstable.encode(text, PATH, 1) == struct.pack(f"<{len(want)}I", *want)


def test_shard_lookup():
    keys = sorted([-(2**60), -3, -1, 0, 1, 5, 5, 255, 256, 2**40])
    entries = [(sstable.key_bytes(k), struct.pack("<3I", i, 70000 * (i == 4), 9)) for i, k in enumerate(keys)]
    shard = sstable.Shard.whole(sstable.write_shard([(sstable.key_bytes(None), struct.pack("<I", 1)), *entries], 2, 3) + b"\n")
    assert [sstable.key_number(k) for k, _ in shard.scan()] == [None, *keys]
    assert [v.tolist() for v in shard.get(5)] == [[5, 0, 9], [6, 0, 9]]
    assert shard.get(None)[0].tolist() == [1] and shard.get(7) == [] and (shard.part, shard.seq, shard.tokens) == (2, 3, 31)


def test_lookup_across_blocks():
    entries = [(sstable.key_bytes(i // 3), np.full(40_000, i, "<u4").tobytes()) for i in range(30)]
    shard = sstable.Shard.whole(sstable.write_shard(entries, 0, 0))
    assert len(shard.places) > 5 and [int(v[0]) for v in shard.get(4)] == [12, 13, 14]


def test_files_round_trip(spark):
    texts = [(9, "the cat"), (-4, None), (2, ""), (None, "x"), (2**53 + 1, "word " * 3000), (9, "the cat"), (9, "a dog")]
    d = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS part")
    folder = sstable.write_token_shards(d, PATH, 1)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in sstable.read_token_shards(spark, folder).collect())
    assert [r[1] for r in got] == [None, -4, 2, 9, 9, 9, 2**53 + 1]
    assert [r[0] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
    want = sorted(zlib.crc32(struct.pack(f"<{len(i)}I", *i)) for i in map(ids_of, [t for _, t in texts]))
    assert sorted(r[3] for r in got) == want
    assert [r.ids for r in sstable.lookup(spark, folder, [2, 77]).collect()] == [[1]]


def test_no_documents(spark):
    folder = sstable.write_token_shards(spark.createDataFrame([], "doc_id long, text string"), PATH, 1)
    assert sstable.read_token_shards(spark, folder).count() == 0


def test_a_damaged_shard_is_an_error():
    data = bytearray(sstable.write_shard([(sstable.key_bytes(1), struct.pack("<I", 1))], 0, 0))
    data[3] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        sstable.Shard.whole(bytes(data))
    with pytest.raises(ValueError, match="footer"):
        sstable.Shard.whole(bytes(data[:-4]))


def test_lookup_reads_what_it_needs():
    entries = [(sstable.key_bytes(i), np.arange(50_000, dtype="<u4").tobytes()) for i in range(40)]
    data, read = sstable.write_shard(entries, 0, 0), []
    shard = sstable.Shard(lambda at, n: read.append(n) or data[at : at + n], len(data))
    assert shard.get(1000) == [] and sum(read) < 3_000
    assert len(shard.get(20)) == 1 and sum(read) < len(data) / 5


def test_tokenizers_of_another_make(tmp_path):
    from tokenizers import models, pre_tokenizers

    made = Tokenizer(models.BPE(vocab={"a": 0, " ": 1, "b": 2, "a ": 3, "a b": 4}, merges=[("a", " "), ("a ", "b")]))
    path = str(tmp_path / "plain.json")
    made.save(path)
    want = made.encode("a bb a", add_special_tokens=False).ids
    assert 4 in want and sstable.encode("a bb a", path, 9) == struct.pack(f"<{len(want) + 1}I", *want, 9)
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    made.save(path2 := str(tmp_path / "spaced.json"))
    want = made.encode("a bb a", add_special_tokens=False).ids
    assert sstable.encode("a bb a", path2, 9) == struct.pack(f"<{len(want) + 1}I", *want, 9)
