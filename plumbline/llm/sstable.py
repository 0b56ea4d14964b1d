"""Token-ID output as sorted-string-table shards, and their readers.

A shard is one file::

    block*            entries of ascending keys, prefix-compressed, then deflated
    index             for each block: first key, offset, length
    bloom             bits of a Bloom filter over the keys
    footer            fixed size: offsets and counts, checksum of all before it, magic number

An entry is shared key bytes (varint), other key bytes (varint), value bytes (varint), the
rest of the key, the value. A key is one byte (0: null, 1: a number) and, for a number, eight
big-endian bytes with the sign flipped, so that keys sort as the numbers do. A value is the
end-marked token ids, little-endian, two bytes each if all of a shard's ids allow it, else
four. Everything after the footer is ignored: text writers end a record with a line break.

Beside the shards stands an index of them: a row for each file with its key range, place and
counts. A lookup reads that, and of the files that may hold a key the footer, the index, the
filter and the blocks of the key.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import Memory
from plumbline.session import shared_dir

MAGIC = b"SSTIDS02"
FOOTER = struct.Struct("<qqqqqqiiiiI8s")
#: Bytes of ids in a block before compression, ids in a shard.
BLOCK_BYTES, SHARD_IDS = 1 << 18, 1 << 22
#: Words remembered by a Python worker.
CACHE_WORDS = 800_000
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_bytes(key: int | None) -> bytes:
    return b"\0" if key is None else b"\1" + struct.pack(">Q", key + (1 << 63))


def key_number(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, h & (2**64 - 1) | 1
    return [(a + i * b) % 2**64 % bits for i in range(BLOOM_HASHES)]


def write_shard(entries: list[tuple[bytes, bytes]], part: int, seq: int) -> bytes:
    """A shard of (key, little-endian four-byte ids) in ascending order of keys."""
    wide = any((np.frombuffer(v, "<u4") > 0xFFFF).any() for _, v in entries)
    body, index, block, last, first = bytearray(), bytearray(), bytearray(), b"", None
    blocks = tokens = 0

    def close() -> None:
        nonlocal blocks, last, first
        packed = zlib.compress(bytes(block), 1)
        index.extend(_varint(len(first)) + first + _varint(len(body)) + _varint(len(packed)))
        body.extend(packed)
        block.clear()
        blocks, last, first = blocks + 1, b"", None

    bits = max(64, len(entries) * BLOOM_BITS)
    bloom = np.zeros(bits, dtype=bool)
    for key, value in entries:
        shared = 0
        while shared < min(len(last), len(key)) and last[shared] == key[shared]:
            shared += 1
        ids = value if wide else np.frombuffer(value, "<u4").astype("<u2").tobytes()
        block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:] + ids
        first, last, tokens = key if first is None else first, key, tokens + len(value) // 4
        bloom[_bloom_places(key, bits)] = True
        if len(block) >= BLOCK_BYTES:
            close()
    if block:
        close()
    packed = np.packbits(bloom, bitorder="little").tobytes()
    at = len(body)
    made = bytes(body + index + packed)
    return made + FOOTER.pack(at, at + len(index), len(packed), bits, len(entries), tokens, part, seq, blocks, 4 if wide else 2, zlib.crc32(made), MAGIC)


class Shard:
    """Reader of one shard: scan, and lookup by Bloom filter, binary search in the index and one block.

    ``read`` gives n bytes from a place; only what is asked for is read.
    """

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        # A line break may follow the footer.
        tail = read(max(0, size - FOOTER.size - 2), min(size, FOOTER.size + 2))
        end = tail.rfind(MAGIC) + len(MAGIC)
        if end < FOOTER.size:
            raise ValueError("no shard: the footer is missing")
        self.read, self.end = read, size - len(tail) + end - FOOTER.size
        index, bloom, size, self.bits, self.rows, self.tokens, self.part, self.seq, blocks, self.width, self.crc, _ = FOOTER.unpack(tail[end - FOOTER.size : end])
        self.filter = (bloom, size)
        self.firsts: list[bytes] = []
        self.places: list[tuple[int, int]] = []
        data, at = read(index, bloom - index), 0
        for _ in range(blocks):
            n, at = _read_varint(data, at)
            self.firsts.append(data[at : at + n])
            start, at = _read_varint(data, at + n)
            length, at = _read_varint(data, at)
            self.places.append((start, length))

    @staticmethod
    def whole(data: bytes) -> Shard:
        """A shard in memory; its checksum must hold."""
        shard = Shard(lambda at, n: data[at : at + n], len(data))
        if zlib.crc32(data[: shard.end]) != shard.crc:
            raise ValueError("a shard does not match its checksum")
        return shard

    def range(self) -> tuple[int | None, int | None]:
        """First and last key."""
        last = None
        for key, _ in self._block(len(self.places) - 1):
            last = key
        return key_number(self.firsts[0]), key_number(last)

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        block, at, last = zlib.decompress(self.read(*self.places[i])), 0, b""
        while at < len(block):
            shared, at = _read_varint(block, at)
            rest, at = _read_varint(block, at)
            size, at = _read_varint(block, at)
            last = last[:shared] + block[at : at + rest]
            at += rest
            yield last, np.frombuffer(block, f"<u{self.width}", size // self.width, at).astype("<u4")
            at += size

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.places)):
            yield from self._block(i)

    def get(self, number: int | None) -> list[np.ndarray]:
        """The values of a key; several if the key was written several times."""
        key = key_bytes(number)
        bloom = self.read(*self.filter)
        if not all(bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits)):
            return []
        found, i = [], max(0, bisect_right(self.firsts, key) - 1)
        while i and self.firsts[i] == key:  # repeats of a key may begin in an earlier block
            i -= 1
        for j in range(i, len(self.places)):
            if self.firsts[j] > key:
                break
            found += [v for k, v in self._block(j) if k == key]
        return found


class WordEncoder:
    """Ids of a text from the remembered ids of its words.

    The tokenizer lower-cases, drops white space and splits words before it pairs, so a text's
    ids are those of its words in order. Words are cut here by the tokenizer's own pattern and only
    new ones go to its pairing model, which saves its bookkeeping of offsets. That short way
    is taken for plain characters below U+0250: composing leaves them as they are, and no Unicode version
    changes their classes. Chunks with other characters go through the whole tokenizer, and so do whole texts if the
    tokenizer is made in another way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.usual = self._is_usual(made)
        if not self.usual:
            return
        split = made["pre_tokenizer"]["pretokenizers"][0]
        low = [chr(i) for i in range(0x250)]
        pattern = split["pattern"]["Regex"]
        for kind in "LN":
            pattern = pattern.replace(f"\\p{{{kind}}}", "".join(c for c in low if unicodedata.category(c)[0] == kind))
        self.split = re.compile(pattern).findall
        self.plain = re.compile("[\\n\x20-\x7e\xa1-\u012f\u0131-\u024f]*").fullmatch
        self.marks = {t["content"][:2] for t in made["added_tokens"]}
        # Byte-level vocabularies show printable bytes as themselves and the others from U+0100 on.
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 255 and b != 173)]
        self.levels = {b: 256 + i for i, b in enumerate(odd)}
        self.words = Memory(self._pair, CACHE_WORDS)

    @staticmethod
    def _is_usual(made: dict) -> bool:
        """Whether the tokenizer is made in the way that words can be cut and paired apart."""
        parts = lambda x, key: (x or {}).get(key) or []
        before = parts(made.get("pre_tokenizer"), "pretokenizers")
        if [x["type"] for x in before] != ["Split", "ByteLevel"] or (made.get("model") or {}).get("type") != "BPE":
            return False
        split, level = before
        return (
            [x["type"] for x in parts(made.get("normalizer"), "normalizers")] == ["NFC", "Replace", "Lowercase"]
            and (split["behavior"], split["invert"]) == ("Removed", True)
            and "Regex" in split["pattern"]
            and not level["add_prefix_space"]
            and made.get("post_processor") is None
        )

    def _pair(self, word: str) -> bytes:
        """Little-endian four-byte ids of a word, by the pairing model alone."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.levels)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(text.lower())))

    def _short(self, text: str) -> bool:
        return self.usual and self.plain(text) is not None and not any(m in text for m in self.marks)

    def encode(self, text: str) -> bytes:
        whole = self.tokenizer.encode
        if not self.usual:
            return array("I", whole(text, add_special_tokens=False).ids).tobytes()
        if self._short(text):
            return self._cut(text)
        return b"".join(
            self._cut(c) if self._short(c) else array("I", whole(c, add_special_tokens=False).ids).tobytes()
            for c in text.replace("\n", " ").split(" ")
        )


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode(text: str | None, path: str, end_id: int) -> bytes:
    """Little-endian four-byte ids of a text and the end id."""
    return _encoder(path).encode(text or "") + struct.pack("<I", end_id)


def write_token_shards(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> str:
    """Write the ids of all texts as shards in ascending order of doc_id; returns the folder.

    Rows are dealt by ranges of doc_id, so shard order is key order, and files come from Spark's
    own writer: a lost task leaves none behind and any file system will do. A task holds one
    shard of at most SHARD_IDS ids, or of one document, at a time. A null text is an empty one; a
    null doc_id comes first; rows with one doc_id are all kept, in the order of their texts'
    hashes, equal rows in any order. Other columns are ignored. An empty table leaves no shard.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/token-shards-{spark.sparkContext.applicationId}-{id(docs):x}-{np.random.default_rng().integers(2**62):x}"
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").withColumn("part", F.spark_partition_id())

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries: list[tuple[bytes, bytes]] = []
        size = seq = part = 0
        for batch in batches:
            for n, doc_id, text in zip(batch["part"], batch["doc_id"], batch["text"], strict=True):
                part = int(n)
                ids = encode(text, tokenizer_path, end_id)
                if entries and size + len(ids) > 4 * SHARD_IDS:
                    yield pd.DataFrame({"shard": [write_shard(entries, part, seq)]})
                    entries, size, seq = [], 0, seq + 1
                entries.append((key_bytes(None if pd.isna(doc_id) else int(doc_id)), ids))
                size += len(ids)
        if entries:
            yield pd.DataFrame({"shard": [write_shard(entries, part, seq)]})

    # doc_id as text: nullable numbers would pass through doubles in pandas.
    files = rows.withColumn("doc_id", F.col("doc_id").cast("string")).drop("h").mapInPandas(shards, "shard binary")
    # The text writer puts a record's bytes down as they are, and one record makes one file.
    files.select(F.col("shard").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(folder)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                shard = Shard.whole(data)
                out.append((path, len(data), *map(_text, shard.range()), shard.part, shard.seq, shard.rows, shard.tokens))
            yield pd.DataFrame(out, columns=["path", "size", "first", "last", "part", "seq", "rows", "tokens"])

    index = _files(spark, folder).mapInPandas(entries, "path string, size long, first string, last string, part long, seq long, rows long, tokens long")
    index.withColumns({c: F.col(c).cast("long") for c in ("first", "last")}).write.parquet(f"{folder}-index")
    return folder


def _text(number: int | None) -> str | None:
    return None if number is None else str(number)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


def read_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Shard totals come from the index of shards; their running sums are the shards' offsets, first over the parts that
    one task wrote, then inside a part. A shard whose checksum does not hold is an error.
    """
    files = _files(spark, folder).select("content")
    index = spark.read.parquet(f"{folder}-index")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                shard, at, out = Shard.whole(data), 0, []
                for key, ids in shard.scan():
                    out.append((shard.part, shard.seq, key_number(key), at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                made = pd.DataFrame(out, columns=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"], dtype=object)
                yield made.astype({c: "Int64" if c == "doc_id" else "int64" for c in made})

    parts = index.groupBy("part").agg(F.sum("tokens").alias("tokens"))  # as many as tasks that wrote
    parts = parts.selectExpr("part", "coalesce(sum(tokens) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    inside = "coalesce(sum(tokens) OVER (PARTITION BY part ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    offsets = index.selectExpr("part", "seq", f"{inside} AS inside").join(parts, "part").selectExpr("part", "seq", "before + inside AS base")
    found = files.mapInPandas(rows, "part long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(offsets, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of the named documents, a few at a time.

    The index of shards names the files whose key range holds a document; of those, the footer, the block index
    and the Bloom filter are read by their places, and a block only if the filter knows the key.
    """
    index = spark.read.parquet(f"{folder}-index")
    wanted = spark.createDataFrame([(d,) for d in doc_ids], "doc_id long").distinct()
    near = wanted.join(index, F.col("doc_id").between(F.coalesce("first", F.lit(-(2**63))), F.col("last"))).select("doc_id", "path", "size").collect()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for path, size in {(r["path"], r["size"]) for r in near}:
        place = jvm.org.apache.hadoop.fs.Path(path)
        opened = place.getFileSystem(conf).open(place)

        def read(at: int, n: int, opened=opened) -> bytes:
            opened.seek(at)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(opened, n))

        try:
            shard = Shard(read, size)
            out += [(r["doc_id"], v.astype(np.int64).tolist()) for r in near if r["path"] == path for v in shard.get(r["doc_id"])]
        finally:
            opened.close()
    return spark.createDataFrame(out, "doc_id long, ids array<long>")
