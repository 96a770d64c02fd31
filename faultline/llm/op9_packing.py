"""Best-fit packing: documents as token pieces into sequences, under several capacities at once.

A piece is a vector (tokens, documents, attention cost), its cost being the square of its tokens.
Every sequence has a capacity for each. Vector best-fit takes the pieces from long to short and
puts each into the open sequence that has room in every dimension and whose weighted residual is
smallest afterwards; a new one is opened if there is none.

Pieces of one length are alike, so the driver packs a histogram: at most ``capacity`` lengths with
their counts, whatever the size of the corpus. Sequences in the same state are one entry with a
count and take pieces together; the outcome is the one of placing the pieces one by one. The plan
says which ranks within a length go to which sequences. Tasks number the pieces within their
length and look up their places.

Edge cases: a NULL or empty text is its end mark alone; longer documents are cut into full
pieces, the first of which may be shorter; repeated rows are packed each; an empty table gives no
pieces; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import cut, number_within

END = 2


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds. Weights set how much a free share of each dimension counts."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.0625, 0.25)


# -- the plan --------------------------------------------------------------------------------

def pack_histogram(counts: dict[int, int], capacity: Capacity = Capacity()) -> dict[str, np.ndarray]:
    """Places for ``counts[length]`` pieces of each length: rows (length, first rank, pieces,
    first sequence, offset), where rank r goes to sequence first + (r - first rank)."""
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], float)
    weights = np.array(capacity.weights) / full**2
    # Entries: residual vector, sequences in that state, first sequence, offset in each.
    residual = np.zeros((0, 3))
    many, first = np.zeros(0, np.int64), np.zeros(0, np.int64)
    opened = 0
    places: list[tuple[int, int, int, int, int]] = []
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        piece = np.array([length, 1, length * length], float)
        if (piece > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity")
        rank, left = 0, int(counts[length])
        while left:
            fits = np.flatnonzero((residual >= piece).all(axis=1))
            if len(fits):
                after = ((residual[fits] - piece) ** 2 * weights).sum(axis=1)
                k = int(fits[np.lexsort((first[fits], after))[0]])
                start, state, there = int(first[k]), residual[k], int(many[k])
            else:
                start, state, there = opened, full, left
            # The sequence that took a piece is the fullest choice for the next one of its length,
            # so sequences are filled one after the other, each with as many as fit.
            each = int((state // piece).min())
            used = min(there, -(-left // each))
            taken = min(left, used * each)
            whole, rest = divmod(taken, each)
            if len(fits):
                many[k] -= used
                first[k] += used
            else:
                opened += used
            for slot in range(each if whole else rest):
                n = whole + (slot < rest)
                places.append((length, rank, n, start,
                               int(capacity.tokens - state[0]) + slot * length))
                rank += n
            for n, held, at in ((whole, each, start), (int(rest > 0), rest, start + whole)):
                if n:
                    residual = np.vstack([residual, state - held * piece])
                    many, first = np.append(many, n), np.append(first, at)
            left -= taken
            if (spent := many == 0).any():
                residual, many, first = residual[~spent], many[~spent], first[~spent]
            full_up = residual[:, 0] < 1
            if full_up.any():
                residual, many, first = residual[~full_up], many[~full_up], first[~full_up]
    table = np.array(places, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "pieces", "sequence", "offset"), table.T))


# -- tokens ----------------------------------------------------------------------------------

# Characters whose class has been the same in all Unicode versions the two libraries carry.
_SETTLED = re.compile("[\x00-ɏΑ-Ρα-ωА-я‐-‧‰-⁞€]*")


class Encoder:
    """Token ids of a byte-level BPE vocabulary file, as little-endian 32-bit bytes.

    Texts of settled characters go through the faster reader of the same vocabulary; a text with
    any other character, or with the beginning of a special token, through the file's own library.
    Both give the same ids.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        special = {t.content for t in self.own.get_added_tokens_decoder().values()}
        to_byte = {c: b for b, c in _byte_names().items()}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in vocabulary.items()
                 if token not in special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks,
                                      special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if "<|" not in text and _SETTLED.fullmatch(text):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4")


def _byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


def split_lengths(n: int, capacity: int) -> list[int]:
    """Pieces of ``n`` tokens: full ones, after a shorter first one if it does not come out even."""
    rest = n % capacity
    return ([rest] if rest else []) + [capacity] * (n // capacity)


PIECES = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def tokenized(documents: DataFrame, tokenizer: str, pattern: str, capacity: int,
              with_ids: bool = False) -> DataFrame:
    """One row per piece of every document row; ``with_ids`` adds the ids as 32-bit bytes."""
    def encode(batches: Iterable[pa.RecordBatch]):
        encoder = Encoder(tokenizer, pattern)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encoder(text or ""), np.uint32(END)).astype("<u4").tobytes()
                start = 0
                for piece, length in enumerate(split_lengths(len(ids) // 4, capacity)):
                    part = ids[4 * start:4 * (start + length)]
                    rows.append((doc, piece, start, length, zlib.crc32(part), part))
                    start += length
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if with_ids else 5
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns[:n], types[:n])], names=names[:n])

    schema = PIECES + (", ids binary" if with_ids else "")
    return (documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(encode, schema))


# -- the operator ----------------------------------------------------------------------------

def pack(documents: DataFrame, tokenizer: str, pattern: str,
         capacity: Capacity = Capacity(), with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and its token offset in the sequence."""
    pieces = cut(tokenized(documents, tokenizer, pattern, capacity.tokens, with_ids))
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = pack_histogram(histogram, capacity)
    ranked = number_within(pieces, "length", ["doc_id", "piece", "ids_crc32"], "rank",
                           sum(histogram.values()))
    order = np.lexsort((places["rank"], places["length"]))
    places = {k: v[order] for k, v in places.items()}
    starts = {int(n): int(i) for i, n in reversed(list(enumerate(places["length"])))}
    ends = {int(n): i + 1 for i, n in enumerate(places["length"])}
    names = pieces.columns

    def place(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            length = batch.column("length").to_numpy()
            row = np.empty(len(rank), np.int64)
            for n in np.unique(length):
                mine, low = length == n, starts[int(n)]
                firsts = places["rank"][low:ends[int(n)]]
                row[mine] = low + np.searchsorted(firsts, rank[mine], side="right") - 1
            sequence = places["sequence"][row] + rank - places["rank"][row]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names),
                 pa.array(sequence, pa.int64()), pa.array(places["offset"][row], pa.int64())],
                names=[*names, "sequence_id", "offset"])

    schema = PIECES + (", ids binary" if with_ids else "") + ", sequence_id bigint, offset bigint"
    return ranked.select(*names, "rank").mapInArrow(place, schema)


def packed_ids(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id and its ids, from pieces packed ``with_ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(parts.alias("parts"))
            .select("sequence_id", F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(
                all_, p["ids"])).alias("ids")))
