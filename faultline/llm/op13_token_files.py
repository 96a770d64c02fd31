"""Token ids in raw binary files, with a minimal perfect hash index for keyed access.

A folder of three kinds of files, all written by Spark's own text writer, so any store will do:

``kind=ids/shard=S``   the ids of the shard's documents one after another, as little-endian unsigned
                       16-bit integers where the vocabulary allows, else 32-bit
``kind=rows/shard=S``  one record per document of the shard, in the same order
``index/part=P``       the hash index of the keys that fall into part P
``shards``             one row per shard: its number, name, ids before it and documents

The text writer ends every row by a separator. A document's row is its ids without the end mark and
the separator is the end mark, so the file holds ids and nothing else. (Of an end mark whose bytes
are no ASCII, the separator is a padding id 0 behind it.)

Documents are dealt into ranges of (doc_id, hash of the text), sorted, encoded and cut into shards
of at most a bounded size and one document; so shards in the order of their names hold the
documents in ascending order, NULL ids first.

A key is (doc_id, copy): equal ids are numbered from 0 in file order. Each index part holds about
``PART_KEYS`` keys. Its hash function has levels of bit arrays: a key sits at the first level where
its bit is its alone, and the rank of that bit among all is its slot. Slots are the numbers from 0
without gaps; each stores a 64-bit fingerprint of its key, the shard, the place and length of the
ids. A lookup reads one word per level, a rank, one slot and the ids, whatever the number of
documents. A key that is not there is refused by the fingerprint.

Edge cases: a NULL or empty text is its end mark alone; texts are encoded whole, however long; rows
that repeat are documents of their own; an empty table gives an index without keys; other columns
are not read.
"""

from __future__ import annotations

import io
import json
import os
import re
import zlib
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import mix
from faultline.llm.op9_packing import _byte_names

# Bytes of a shard: a hundred-thousandth of the texts within these bounds.
SHARD_BYTES = (8 << 20, 256 << 20)
PART_KEYS = 500_000
END = 2
# Bits of a level per key that reaches it.
ROOM = 2
RECORD = np.dtype([("doc_id", "<i8"), ("n", "<u8"), ("crc", "<u4"), ("null", "<u4")])
SLOT = np.dtype([("print", "<u8"), ("at", "<u8"), ("n", "<u8"), ("shard", "<u4"), ("row", "<u4")])
LEVEL = np.dtype([("bits", "<u8"), ("words", "<u8"), ("ones", "<u8")])
_U = np.uint64


# -- encoding ------------------------------------------------------------------------------------

class Encoder:
    """Ids of whole texts as bytes.

    Of a tokenizer that drops white space, lower-cases and merges inside words (``_by_word``), texts
    of settled characters are parted into words here and merged by a faster reader of the same
    vocabulary: a mark ends each word in place of the file's suffix, and as the tokens with a suffix
    of one byte come first, the mark joins the last byte before any other merge. White space parts
    no fewer words than the tokenizer does, so of other texts only the pieces between white space
    that hold an unsettled character go through the file's own library, as do very long words,
    pieces with the beginning of a special token, and whole texts under any other tokenizer.
    """

    def __init__(self, path: str, width: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary = file["model"]["vocab"]
        special = {t["content"] for t in file.get("added_tokens") or []}
        size = max([*vocabulary.values(), *(t["id"] for t in file.get("added_tokens") or [])]) + 1
        self.width = width or id_width(size)
        self.fast = _word_merges(vocabulary, special) if _by_word(file) else None

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer
            self._library = Tokenizer.from_file(self.path)
        return self._library

    def _whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _settled(self, text: str) -> list[int]:
        words = _WORDS.findall(text.lower())
        if not words:
            return []
        if max(map(len, words)) > LONG_WORD:
            return self._whole(text)
        return self.fast.encode_ordinary(_MARK.join(words) + _MARK)

    def __call__(self, text: bytes) -> bytes:
        whole = text.decode("utf-8", "replace")
        if self.fast is None:
            ids = self._whole(whole)
        elif "<|" not in whole and _SETTLED.fullmatch(whole):
            ids = self._settled(whole)
        else:
            ids = []
            for odd, run in groupby(text.split(), key=_odd):
                part = b" ".join(run).decode("utf-8", "replace")
                ids += self._whole(part) if odd else self._settled(part)
        return np.array(ids, f"<u{self.width}").tobytes()


# Characters whose class, lower case and normal form are settled; letters, others.
_LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-įı-ɏ"
_OTHERS = "!-/:-@\\[-`{-~¡-©«-±´¶-¸»¿×÷‐-‧‰-⁞€"
# Letters whose lower case lies outside of them, as that of Ɓ does, are not settled.
_STAYING = "".join(c for c in map(chr, range(0x250)) if re.fullmatch(f"[{_LETTERS}]", c)
                   and re.fullmatch(f"[{_LETTERS}]+", c.lower()))
_SETTLED = re.compile(f"[ \t\n\r\x0b\x0c0-9{_STAYING}{_OTHERS}]*")
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[{_OTHERS}]+")
_MARK = "\x01"
LONG_WORD = 500


def _odd(piece: bytes) -> bool:
    return b"<|" in piece or not _SETTLED.fullmatch(piece.decode("utf-8", "replace"))


def _word_merges(vocabulary: dict[str, int], special: set[str]):
    import tiktoken
    to_byte = {c: b for b, c in _byte_names().items()}
    ranks = {}
    for token, i in vocabulary.items():
        if token not in special:
            word = token.removesuffix("</w>")
            end = _MARK.encode() if word != token else b""
            ranks[bytes(to_byte[c] for c in word) + end] = i
    if len(ranks) != len(vocabulary) - len(special & set(vocabulary)):
        raise ValueError("the vocabulary has a token with the byte of the mark")
    return tiktoken.Encoding("words", pat_str="[^\x01]+\x01", mergeable_ranks=ranks,
                             special_tokens={})


def _by_word(file: dict) -> bool:
    """Whether the tokenizer file normalises, parts and merges as ``Encoder`` needs for words."""
    parts = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    split, level = parts[0], parts[-1]
    steps = [n["type"] for n in (file.get("normalizer") or {}).get("normalizers") or []]
    pattern = (split.get("pattern") or {}).get("Regex", "")
    return (steps == ["NFC", "Replace", "Lowercase"] and len(parts) == 2
            and split.get("type") == "Split" and split.get("behavior") == "Removed"
            and split.get("invert") is True and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
            and level.get("type") == "ByteLevel" and not level.get("add_prefix_space")
            and not level.get("use_regex") and file["model"]["type"] == "BPE"
            and file["model"].get("end_of_word_suffix") == "</w>"
            and not any(any(c.isspace() for c in t["content"]) or t.get("lstrip") or t.get("rstrip")
                        for t in file.get("added_tokens") or []))


def id_width(vocabulary: int) -> int:
    return 2 if vocabulary <= 1 << 16 else 4


def separator(end: int, width: int) -> tuple[bytes, bytes]:
    """What ends a document's row, and what follows it: the writer's separator."""
    mark = end.to_bytes(width, "little")
    return (b"", mark) if max(mark) < 0x80 else (mark, bytes(width))


# -- writing -------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Layout:
    """What a reader must know of a folder."""

    path: str
    width: int
    end: int = END

    @property
    def padding(self) -> int:
        """Bytes between the end of a document and the next one."""
        return len(separator(self.end, self.width)[1]) if separator(self.end, self.width)[0] else 0


def write_ids(documents: DataFrame, path: str, tokenizer: str, end: int = END) -> Layout:
    """The ids of all documents, in files below ``path``, with shards table and index."""
    from tokenizers import Tokenizer
    spark = documents.sparkSession
    width = id_width(Tokenizer.from_file(tokenizer).get_vocab_size())
    tail, between = separator(end, width)
    layout = Layout(path, width, end)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    limit = min(max(size // 100_000, SHARD_BYTES[0]), SHARD_BYTES[1])
    # The ids take about half the bytes of a text.
    ranges = max(-(-size // (2 * limit)), min(cores, -(-size // (1 << 20))), 1)
    hashed = rows.withColumn("hash", F.xxhash64("text"))
    ordered = (hashed.repartitionByRange(int(ranges), F.col("doc_id").asc_nulls_first(), "hash")
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "hash", "text")
               .select(F.spark_partition_id().alias("range"), "doc_id",
                       F.col("text").cast("binary").alias("text")))

    def encode(batches):
        encoder, piece, filled, number = Encoder(tokenizer, width), 0, 0, 0
        schema = pa.schema([("kind", pa.string()), ("shard", pa.string()), ("seq", pa.int64()),
                            ("row", pa.binary())])
        for batch in batches:
            out: list[tuple] = []
            held = 0
            texts = batch.column("text")
            for i, (where, doc) in enumerate(zip(batch.column("range").to_pylist(),
                                                 batch.column("doc_id").to_pylist())):
                ids = encoder(texts[i].as_buffer().to_pybytes())
                whole = ids + end.to_bytes(width, "little")
                if filled + len(whole) > limit and filled:
                    piece, filled = piece + 1, 0
                filled += len(whole)
                shard = f"s{where:07d}-{piece:05d}"
                crc = zlib.crc32(np.frombuffer(whole, f"<u{width}").astype("<u4").tobytes())
                record = np.array([(doc or 0, len(whole) // width, crc, doc is None)], RECORD)
                out += [("ids", shard, number, ids + tail), ("rows", shard, number, record.tobytes())]
                number, held = number + 1, held + len(whole)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    encoded = (ordered.mapInArrow(encode, "kind string, shard string, seq bigint, row binary")
               .sortWithinPartitions("kind", "shard", "seq"))
    _write_raw(encoded.select("kind", "shard", F.col("row").cast("string").alias("row")),
               f"{path}/data", ["kind", "shard"], between)
    _write_shards(spark, layout)
    _write_index(spark, layout)
    return layout


def _write_raw(rows: DataFrame, path: str, by: list[str], between: bytes) -> None:
    """One file per task and value of ``by``, of the rows' bytes, each followed by ``between``."""
    (rows.write.partitionBy(*by).option("lineSep", between.decode("ascii"))
     .option("compression", "none").text(path))


def _files(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(name, content) of the files of ``path``, one per folder ``key=name``."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    name = F.regexp_extract("path", f"{key}=([^/]+)/", 1)
    return (spark.read.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
            .load(path).select(name.alias(key), "content"))


def _records(layout: Layout, content: bytes) -> np.ndarray:
    between = len(separator(layout.end, layout.width)[1])
    with_gap = np.dtype([("record", RECORD), ("gap", f"V{between}")])
    return np.frombuffer(content, with_gap)["record"]


def _record_files(spark: SparkSession, layout: Layout) -> DataFrame | None:
    """The files of records; None if there is no document."""
    data = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{layout.path}/data/kind=rows")
    there = data.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(data)
    return _files(spark, f"{layout.path}/data/kind=rows", "shard") if there else None


SHARDS = "number int, shard string, start bigint, docs bigint, copies bigint"


def _write_shards(spark: SparkSession, layout: Layout) -> None:
    """Per shard its number, its name, the ids before it, its documents, and how many documents of
    its first id lie before it. The driver sees one row per shard of ``SHARD_BYTES``."""
    files = _record_files(spark, layout)

    def sums(batches):
        for batch in batches:
            out = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                r = _records(layout, content.as_buffer().to_pybytes())
                key = r[["doc_id", "null"]]
                out.append((name, int(r["n"].sum()), len(r), int(r["doc_id"][0]), int(r["null"][0]),
                            int(r["doc_id"][-1]), int(r["null"][-1]), int((key == key[-1]).sum())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*out)],
                names=["shard", "ids", "docs", "first", "fnull", "last", "lnull", "run"])

    found = [] if files is None else sorted(files.mapInArrow(
        sums, "shard string, ids bigint, docs bigint, first bigint, fnull bigint, last bigint, "
              "lnull bigint, run bigint").collect())
    rows, start, last, run = [], 0, None, 0
    for number, r in enumerate(found):
        copies = run if (r.first, r.fnull) == last else 0
        rows.append((number, r.shard, start, r.docs, copies))
        start += r.ids
        run = r.run + (copies if r.run == r.docs else 0)
        last = (r.last, r.lnull)
    spark.createDataFrame(rows, SHARDS).coalesce(1).write.parquet(f"{layout.path}/shards")


# -- keys and the hash index -----------------------------------------------------------------------

def _hash(doc_id: np.ndarray, null: np.ndarray, copy: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of keys. The key itself goes into every seed's hash, so keys that meet under
    one seed part under the next."""
    with np.errstate(over="ignore"):
        step = _U(0x9E3779B97F4A7C15) * _U(2 * seed + 1)
        own = mix(doc_id.astype(np.int64).view(np.uint64) + step)
        return mix(own ^ mix(copy.astype(np.uint64) * _U(2) + null.astype(np.uint64) + ~step))


def key_part(doc_id: np.ndarray, null: np.ndarray, copy: np.ndarray, parts: int) -> np.ndarray:
    return (_hash(doc_id, null, copy, 1000) % _U(parts)).astype(np.int32)


def _prints(doc_id, null, copy) -> np.ndarray:
    return _hash(doc_id, null, copy, 2000)


def build_index(doc_id: np.ndarray, null: np.ndarray, copy: np.ndarray, shard: np.ndarray,
                row: np.ndarray, at: np.ndarray, n: np.ndarray) -> bytes:
    """The file of an index part: number of levels, a header per level, then each level's words and
    the ranks before them, then the slots."""
    left = np.arange(len(doc_id))
    levels, words, order = [], [], []
    while len(left):
        bits = -(-ROOM * len(left) // 64) * 64
        place = (_hash(doc_id[left], null[left], copy[left], len(levels)) % _U(bits)).astype(np.int64)
        alone = np.bincount(place, minlength=bits) == 1
        here = alone[place]
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        order.append(left[here][np.argsort(place[here])])
        levels.append((bits, bits // 64, int(here.sum())))
        left = left[~here]
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    slots = np.zeros(len(order), SLOT)
    slots["print"] = _prints(doc_id, null, copy)[order]
    for name, values in (("shard", shard), ("row", row), ("at", at), ("n", n)):
        slots[name] = values[order]
    out = io.BytesIO()
    out.write(np.array([len(levels)], "<u8").tobytes())
    out.write(np.array(levels, LEVEL).tobytes())
    before = 0
    for (_, _, ones), w in zip(levels, words):
        counts = np.bitwise_count(w).astype(np.uint64)
        ranks = before + np.cumsum(counts) - counts
        out.write(w.tobytes() + ranks.astype("<u8").tobytes())
        before += ones
    out.write(slots.tobytes())
    return out.getvalue()


class IndexPart:
    """Lookups in an index file. ``read(place, length)`` gives its bytes."""

    def __init__(self, read):
        self.read = read
        n = int(np.frombuffer(read(0, 8), "<u8")[0])
        self.levels = np.frombuffer(read(8, n * LEVEL.itemsize), LEVEL)
        ends = 8 + n * LEVEL.itemsize + 16 * np.cumsum(self.levels["words"].astype(np.int64))
        self.starts = np.append(8 + n * LEVEL.itemsize, ends)

    def slot(self, doc_id: int | None, copy: int) -> np.ndarray | None:
        """The slot of one key, by reads of a few bytes; None if it has none."""
        key = (np.array([doc_id or 0], np.int64), np.array([doc_id is None], np.int64),
               np.array([copy], np.int64))
        for level, start in zip(range(len(self.levels)), self.starts.tolist()):
            bits, words = int(self.levels["bits"][level]), int(self.levels["words"][level])
            place = int(_hash(*key, level)[0]) % bits
            word = int.from_bytes(self.read(start + 8 * (place // 64), 8), "little")
            if word >> (place % 64) & 1:
                rank = int.from_bytes(self.read(start + 8 * (words + place // 64), 8), "little")
                rank += (word & ((1 << place % 64) - 1)).bit_count()
                found = np.frombuffer(
                    self.read(int(self.starts[-1]) + rank * SLOT.itemsize, SLOT.itemsize), SLOT)[0]
                return found if int(found["print"]) == int(_prints(*key)[0]) else None
        return None

    def slots(self, doc_id: np.ndarray, null: np.ndarray, copy: np.ndarray
              ) -> tuple[np.ndarray, np.ndarray]:
        """The slots of many keys of this part, and which of them it knows."""
        rank = np.full(len(doc_id), -1, np.int64)
        left = np.arange(len(doc_id))
        for level, start in zip(range(len(self.levels)), self.starts.tolist()):
            bits, words = int(self.levels["bits"][level]), int(self.levels["words"][level])
            both = np.frombuffer(self.read(start, 16 * words), "<u8")
            place = _hash(doc_id[left], null[left], copy[left], level) % _U(bits)
            at = (place // _U(64)).astype(np.int64)
            word, bit = both[at], place % _U(64)
            here = (word >> bit & _U(1)).astype(bool)
            below = np.bitwise_count(word & ((_U(1) << bit) - _U(1)))
            rank[left[here]] = (both[words + at] + below)[here].astype(np.int64)
            left = left[~here]
        every = np.frombuffer(self.read(int(self.starts[-1]), -1), np.uint8)
        every = every[:len(every) // SLOT.itemsize * SLOT.itemsize].view(SLOT)
        known = rank >= 0
        out = every[rank[known]]
        known[known] = out["print"] == _prints(doc_id, null, copy)[known]
        return every[rank[known]], known


def _in_memory(content: bytes):
    return lambda at, n: content[at:] if n < 0 else content[at:at + n]


def _keys(spark: SparkSession, layout: Layout, parts: int) -> DataFrame | None:
    """Every key in the files with its part and the place of its ids."""
    files = _record_files(spark, layout)
    if files is None:
        return None
    shards = spark.read.schema(SHARDS).parquet(f"{layout.path}/shards")

    def keys(batches):
        for batch in batches:
            for i in range(len(batch)):
                r = _records(layout, batch.column("content")[i].as_buffer().to_pybytes())
                number, before = batch.column("number")[i].as_py(), batch.column("copies")[i].as_py()
                row = np.arange(len(r))
                key = r[["doc_id", "null"]]
                new = np.append(True, key[1:] != key[:-1])
                # Place in the run of equal ids; the shard's first run goes on from those before.
                run = np.cumsum(new) - 1
                copy = row - np.flatnonzero(new)[run] + np.where(run == 0, before, 0)
                at = np.cumsum(r["n"]) - r["n"]
                doc, null = r["doc_id"].astype(np.int64), r["null"].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key_part(doc, null, copy, parts)), pa.array(doc), pa.array(null),
                     pa.array(copy.astype(np.int64)), pa.array(np.full(len(r), number, np.int32)),
                     pa.array(row.astype(np.int64)), pa.array(at.astype(np.int64)),
                     pa.array(r["n"].astype(np.int64))],
                    names=["part", "doc_id", "null", "copy", "shard", "row", "at", "n"])

    return files.join(shards.select("shard", "number", "copies"), "shard").mapInArrow(
        keys, "part int, doc_id bigint, null bigint, copy bigint, shard int, row bigint, "
              "at bigint, n bigint")


def _parts(spark: SparkSession, layout: Layout) -> int:
    docs = spark.read.schema(SHARDS).parquet(f"{layout.path}/shards").agg(F.sum("docs")).first()[0]
    return max(-(-(docs or 0) // PART_KEYS), 1)


def _write_index(spark: SparkSession, layout: Layout) -> None:
    keys = _keys(spark, layout, _parts(spark, layout))
    if keys is None:
        return

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        columns = [rows[c].to_numpy() for c in ("doc_id", "null", "copy", "shard", "row", "at", "n")]
        return pd.DataFrame({"part": [int(rows["part"].iloc[0])], "row": [build_index(*columns)]})

    index = keys.groupBy("part").applyInPandas(build, "part int, row binary")
    _write_raw(index.select("part", F.col("row").cast("string").alias("row")),
               f"{layout.path}/index", ["part"], b"\0")


# -- reading -------------------------------------------------------------------------------------

class Reader:
    """The ids of single documents, by a constant number of small reads each."""

    def __init__(self, spark: SparkSession, layout: Layout):
        self.layout, self._jvm = layout, spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.shards = {r.number: r for r in spark.read.schema(SHARDS).parquet(
            f"{layout.path}/shards").collect()}
        self.parts = _parts(spark, layout)
        self._index: dict[int, IndexPart] = {}

    def _reads(self, folder: str):
        """Reads of the one file of a folder, at any place of it."""
        path = self._jvm.org.apache.hadoop.fs.Path
        fs = path(folder).getFileSystem(self._conf)
        if not fs.exists(path(folder)):
            return None
        found = [s.getPath() for s in fs.listStatus(path(folder))
                 if s.getPath().getName().startswith("part-")]

        def read(at: int, n: int) -> bytes:
            stream = fs.open(found[0])
            try:
                stream.seek(at)
                return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n)) if n else b""
            finally:
                stream.close()
        return read

    def get(self, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
        """All ids of a document, its end mark included; None if there is no such key."""
        part = int(key_part(np.array([doc_id or 0], np.int64), np.array([doc_id is None], np.int64),
                            np.array([copy], np.int64), self.parts)[0])
        if part not in self._index:
            read = self._reads(f"{self.layout.path}/index/part={part}")
            if read is None:
                return None
            self._index[part] = IndexPart(read)
        slot = self._index[part].slot(doc_id, copy)
        if slot is None:
            return None
        width, padding = self.layout.width, self.layout.padding
        at, n = int(slot["at"]) * width + int(slot["row"]) * padding, int(slot["n"]) * width
        name = self.shards[int(slot["shard"])].shard
        read = self._reads(f"{self.layout.path}/data/kind=ids/shard={name}")
        return np.frombuffer(read(at, n), f"<u{width}")


def all_keys(spark: SparkSession, layout: Layout) -> DataFrame:
    """(doc_id, copy) of every document in the files."""
    keys = _keys(spark, layout, 1)
    if keys is None:
        return spark.createDataFrame([], "doc_id bigint, copy bigint")
    return keys.select(F.when(F.col("null") == 0, F.col("doc_id")).alias("doc_id"), "copy")


def read_documents(keys: DataFrame, layout: Layout, with_ids: bool = False) -> DataFrame:
    """Per key (doc_id, copy) that the index knows: doc_id, copy, start, n_tokens, ids_crc32 and,
    if asked for, the ids as 32-bit bytes. Each index part and each shard is read once."""
    spark = keys.sparkSession
    parts, width, padding = _parts(spark, layout), layout.width, layout.padding
    schema = "doc_id bigint, copy bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    schema += ", ids binary" if with_ids else ""
    if _record_files(spark, layout) is None:
        return spark.createDataFrame([], schema)

    def place(batches):
        for batch in batches:
            doc = batch.column("doc_id")
            null = doc.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            doc, copy = doc.fill_null(0).to_numpy(), batch.column("copy").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(key_part(doc, null, copy, parts)), pa.array(doc), pa.array(null),
                 pa.array(copy)], names=["part", "doc_id", "null", "copy"])

    asked = (keys.select(F.col("doc_id").cast("long"), F.col("copy").cast("long"))
             .mapInArrow(place, "part int, doc_id bigint, null bigint, copy bigint"))
    index = _files(spark, f"{layout.path}/index", "part").withColumn("part", F.col("part").cast("int"))

    def look_up(rows: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        names = ["number", "doc_id", "null", "copy", "row", "at", "n"]
        if rows.empty or files.empty:
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
        key = [rows[c].to_numpy(np.int64) for c in ("doc_id", "null", "copy")]
        found, known = IndexPart(_in_memory(bytes(files["content"].iloc[0]))).slots(*key)
        values = [found["shard"], *(k[known] for k in key), found["row"], found["at"], found["n"]]
        return pd.DataFrame({c: v.astype(np.int64) for c, v in zip(names, values)})

    places = (asked.groupBy("part").cogroup(index.groupBy("part")).applyInPandas(
        look_up, "number int, doc_id bigint, null bigint, copy bigint, row bigint, at bigint, "
                 "n bigint"))
    # One row per shard; joined by shuffle unless Spark measures it small.
    shards = spark.read.schema(SHARDS).parquet(f"{layout.path}/shards")
    payload = (_files(spark, f"{layout.path}/data/kind=ids", "shard")
               .join(shards.select("shard", "number", "start"), "shard")
               .select("number", "start", "content"))

    names = [c.split()[0] for c in schema.split(", ")]

    def read(rows: pa.Table, files: pa.Table) -> pa.Table:
        # A group is a shard: its bytes are shared by all slices, and nothing else is held.
        if not rows.num_rows or not files.num_rows:
            return pa.table({c: pa.array([], pa.int64() if c != "ids" else pa.binary())
                             for c in names})
        content = files.column("content")[0].as_buffer()
        doc, null, copy, row, at, n = (rows.column(c).to_numpy()
                                       for c in ("doc_id", "null", "copy", "row", "at", "n"))
        wide = [np.frombuffer(content, f"<u{width}", b, a).astype("<u4").tobytes()
                for a, b in zip((at * width + row * padding).tolist(), n.tolist())]
        columns = [pa.array(doc, mask=null == 1), copy, at + files.column("start")[0].as_py(), n,
                   pa.array([zlib.crc32(w) for w in wide], pa.int64()), pa.array(wide, pa.binary())]
        return pa.table(dict(zip(names, columns)))

    return places.groupBy("number").cogroup(payload.groupBy("number")).applyInArrow(read, schema)


def write_and_read(documents: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """The files of ``documents`` written below ``path`` and every document read back by its key."""
    layout = write_ids(documents, path, tokenizer)
    found = read_documents(all_keys(documents.sparkSession, layout), layout)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")
