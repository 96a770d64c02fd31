"""N-gram Jaccard join as a blocked sparse matrix product.

Documents are rows and word shingles columns of a sparse 0/1 matrix; the product with its
transpose counts the shingles two documents share. Two link when 100 * shared >= 75 * united. A
document's class is the smallest id it reaches over links.

The whole product has as many cells as pairs, so bounds from the sizes cut it down first, none of
which can lose a link. With n shingles each, linked documents of different sets share at least
three quarters of the larger set.

1. Documents of equal sets are one class; a digest of the set finds them, and the smallest id
   stands for the class.
2. A linked document has three quarters of its shingles in common with another, hence at least
   so many that occur in two documents or more. One pass over packed shingle fingerprints counts
   them; colliding fingerprints only let a document pass. What remains are documents that are
   copies in the main, not those that merely quote. A second count among these alone takes out
   those whose shingles occur only in their own exact copies or in documents already out.
3. Ordered by hash, the first n - ceil(3n/4) + 1 shingles of two linked documents have one in
   common, and their sizes are within 4:3. Documents that share such a shingle and a size class
   are tied to one hub, never pair by pair. The hub is the document most of whose shingles occur
   elsewhere, as those of an original do. Each document is compared with the hub it shares most
   of these shingles with. That unites groups of near copies in time proportional to their size.
4. Pairs from different united groups are left. They are found by the first shingles in another
   order, that by hash with the shingles of more than ``HOT`` documents last, so that a common line
   is among the first only of documents that hold little else. A shingle of at most ``HOT``
   documents gives its pairs, which is at most HOT / 2 per entry; the product accumulates what a
   pair shares, and pairs whose bound from sizes and positions is too low are dropped before whole
   sets are compared.
5. Documents that share a hotter one of these shingles form clusters, cut by size class into
   blocks of ``BLOCK`` documents. The product of two blocks in reach of one another is accumulated
   row by row over whole sets; pairs out of the size bounds are dropped, and of the links in a cell
   those that unite something are returned. Pairs of blocks of one united group are left out.

What steps leave on disk is released when the next no longer needs it. The rows of a partition have
to come in the same order when a task is run again, as those of stored tables do; if not, step 2
fails with a message.

Edge cases: a NULL or empty text has no shingles, n_shingles 0, and is its own class; rows that
share their id are one document that has the links of each; a row without id has no class (NULL);
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import cut, release, small
from faultline.llm.components import connected
from faultline.llm.shingles import shingle_sets

SHARE = 75
HOT = 64
BLOCK = 1024
# Shingles a task holds before it packs them.
HELD = 1 << 20
# Of so many hot shingles the codes are sent to all tasks, 8 bytes each.
HOT_CODES = 1 << 22
# Fingerprints a part of the hash space holds; the number of parts follows the data.
PART = 1 << 20


def linked(shared, a, b, share: int = SHARE):
    """Whether sets of sizes a and b with so many common members link."""
    return 100 * shared >= share * (a + b - shared)


def prefix_length(n: int, share: int = SHARE) -> int:
    """Of the first so many members, in any common order, two linked sets of which this is one
    have one in common."""
    return n - (-(-share * n // 100)) + 1 if n else 0


# -- 1. sets -----------------------------------------------------------------------------------

def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def set_digests(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles and a digest of the shingle set."""
    def read(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                          pa.binary())], names=["doc_id", "n_shingles", "digest"])
    return _texts(documents).mapInArrow(read, "doc_id bigint, n_shingles bigint, digest binary")


# -- 2. documents that share most of their shingles ------------------------------------------------

def _pack(arrays: list[np.ndarray], kind) -> bytes:
    return np.concatenate(arrays).astype(kind).tobytes() if arrays else b""


def _text_sets(batch):
    return shingle_sets(batch.column("text"))


def _stored_sets(batch):
    return (np.frombuffer(raw, np.uint64) for raw in batch.column("set").to_pylist())


def shared_counts(rows: DataFrame, sets_of, total: int) -> DataFrame:
    """(doc_id, shared): at least the number of a document's shingles that occur in another row.
    ``sets_of`` gives the sets of a batch of ``rows``; ``total`` is about the sum of their sizes.

    The shingles of a batch travel as one packed row per part of the hash space, as fingerprints
    of as few bytes as leave 16 values free for each that is taken. Within a part those that occur
    once are told from the others. A part holds some ``PART`` fingerprints, so what a task reads and
    holds stays the same as the data grow. A packed row names documents by their places in the
    batch, in a byte or two each; the ids of a batch travel once, under their digest, to where the
    counts of its parts meet. Bytes a shingle so hardly depend on the number of parts.
    """
    return _sums(_counted(rows, sets_of, total))


def _sums(counted: DataFrame) -> DataFrame:
    return counted.filter("NOT hot").groupBy("doc_id").agg(F.sum("shared").alias("shared"))


def _parts(total: int) -> tuple[int, int]:
    """Number of parts of the hash space and bytes of a fingerprint for so many shingles."""
    parts = 16 + total // PART
    return parts, next(w for w in range(2, 9) if w == 8 or parts << (8 * w) >= 16 * max(total, 1))


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)


def _hot_limit(total: int) -> int:
    """Shingles count as hot beyond so many documents; at most ``HOT_CODES`` are."""
    return max(HOT, total // HOT_CODES)


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes each as the largest needs, after a byte that says so."""
    most = int(values.max()) if len(values) else 0
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)
    return bytes([kind().nbytes]) + values.astype(kind).tobytes()


def _widen(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _counted(rows: DataFrame, sets_of, total: int, often: int | None = None) -> DataFrame:
    """(doc_id, shared, code, hot): the counts of ``shared_counts`` by document and batch; and, if
    ``often`` is given, with ``hot`` set the codes (``codes_of``) of the shingles that occur in
    more than so many rows."""
    parts, width = _parts(total)
    kind = np.uint32 if width <= 4 else np.uint64

    def emit(batches):
        for batch in batches:
            docs, sets, held = [], [], 0
            for doc, own in zip(batch.column("doc_id").to_pylist(), sets_of(batch)):
                if doc is not None and len(own):
                    docs.append(doc)
                    sets.append(own)
                    held += len(own)
                if held >= HELD:
                    yield packed_rows(docs, sets)
                    docs, sets, held = [], [], 0
            if held:
                yield packed_rows(docs, sets)

    def packed_rows(docs, sets):
        ids = np.array(docs, np.int64).tobytes()
        name = hashlib.blake2b(ids, digest_size=16).digest()
        place, h = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        part = _part_of(h, parts)
        order = np.argsort(part, kind="stable")
        place, h, part = place[order], h[order], part[order]
        edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
        prints = h.view(np.uint8).reshape(-1, 8)[:, :width]
        # The ids go to parts of their own, so that no part has those of all batches.
        out = {"part": [parts + _home(name)], "ids": [ids], "places": [None], "counts": [None],
               "prints": [None]}
        for a, b in zip(edges[:-1], edges[1:]):
            first = np.flatnonzero(np.append(True, place[a + 1:b] != place[a:b - 1]))
            out["part"].append(int(part[a]))
            out["ids"].append(None)
            out["places"].append(_narrow(np.diff(place[a:b][first], prepend=0)))
            out["counts"].append(_narrow(np.diff(np.append(first, b - a))))
            out["prints"].append(np.ascontiguousarray(prints[a:b]).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(out["part"], pa.int32()), pa.array([name] * len(out["part"]), pa.binary()),
             *(pa.array(out[k], pa.binary()) for k in ("ids", "places", "counts", "prints"))],
            names=["part", "batch", "ids", "places", "counts", "prints"])

    def _home(name):
        return int.from_bytes(name[:8], "little") % parts

    def count(packed: pd.DataFrame) -> pd.DataFrame:
        part = int(packed["part"].iloc[0])
        if part >= parts:
            return packed.assign(home=part - parts, shared=None)[
                ["home", "batch", "ids", "places", "shared"]]
        each = [_widen(c) for c in packed["counts"]]
        edges = np.cumsum([0] + [len(c) for c in each])
        each = np.concatenate(each)
        raw = np.frombuffer(b"".join(packed["prints"]), np.uint8).reshape(-1, width)
        prints = np.zeros((len(raw), kind().nbytes), np.uint8)
        prints[:, :width] = raw
        prints = prints.view(kind)[:, 0]
        order = np.argsort(prints)
        ordered = prints[order]
        same = ordered[1:] == ordered[:-1]
        again = np.zeros(len(prints), bool)
        again[order] = np.append(False, same) | np.append(same, False)
        shared = np.add.reduceat(again, np.cumsum(each) - each, dtype=np.int64)
        out = []
        for name, places, a, b in zip(packed["batch"], packed["places"], edges[:-1], edges[1:]):
            some = shared[a:b] > 0
            if some.any():
                places = np.cumsum(_widen(places))[some]
                out.append((_home(name), name, None, _narrow(np.diff(places, prepend=0)),
                            _narrow(shared[a:b][some])))
        if often is not None:
            first = np.flatnonzero(np.append(True, ~same))
            times = np.diff(np.append(first, len(ordered)))
            codes = ordered[first][times > often].astype(np.uint64) | np.uint64(part << 8 * width)
            if len(codes):
                out.append((part, None, None, codes.tobytes(), None))
        return pd.DataFrame(out, columns=["home", "batch", "ids", "places", "shared"])

    def add_up(counted: pd.DataFrame) -> pd.DataFrame:
        codes = np.frombuffer(b"".join(counted["places"][counted["batch"].isna()]), np.int64)
        docs, shared_of = [], []
        for _, own in counted.groupby("batch"):
            ids = own["ids"].dropna()
            if not len(ids):
                raise RuntimeError("rows of the input came in another order when a task was run "
                                   "again; write them to a table first")
            ids = np.frombuffer(ids.iloc[0], np.int64)
            sums = np.zeros(len(ids), np.int64)
            own = own[own["ids"].isna()]
            for places, shared in zip(own["places"], own["shared"]):
                sums[np.cumsum(_widen(places))] += _widen(shared)
            docs.append(ids[sums > 0])
            shared_of.append(sums[sums > 0])
        known = sum(len(d) for d in docs)
        out = {"doc_id": [*docs, np.zeros(len(codes), np.int64)],
               "shared": [*shared_of, np.zeros(len(codes), np.int64)],
               "code": [np.zeros(known, np.int64), codes]}
        return pd.DataFrame({k: np.concatenate(v) for k, v in out.items()}
                            | {"hot": np.arange(known + len(codes)) >= known})

    packed = rows.mapInArrow(emit, "part int, batch binary, ids binary, places binary, "
                                   "counts binary, prints binary")
    counted = packed.repartition(16 + parts // 4, "part").groupBy("part").applyInPandas(
        count, "home int, batch binary, ids binary, places binary, shared binary")
    return counted.groupBy("home").applyInPandas(
        add_up, "doc_id bigint, shared bigint, code bigint, hot boolean")


def codes_of(h: np.ndarray, total: int) -> np.ndarray:
    """Part and fingerprint of shingles as one number each, for a count of so many shingles."""
    parts, width = _parts(total)
    low = h & np.uint64((1 << 8 * width) - 1)
    return (low | (_part_of(h, parts).astype(np.uint64) << np.uint64(8 * width))).view(np.int64)


def kept_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, shared, n, set) of the wanted documents (doc_id, digest, shared)."""
    def read(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column("text")))
            digests = batch.column("digest").to_pylist()
            keep = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d
                    for s, d in zip(sets, digests)]
            # Repeated rows stand next to each other after a sort by id.
            ids = batch.column("doc_id").to_pylist()
            seen = None
            for i, doc in enumerate(ids):
                if keep[i]:
                    keep[i], seen = (doc, digests[i]) != seen, (doc, digests[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").filter(pa.array(keep)),
                 batch.column("shared").filter(pa.array(keep)),
                 pa.array([len(s) for s, k in zip(sets, keep) if k], pa.int64()),
                 pa.array([s.tobytes() for s, k in zip(sets, keep) if k], pa.binary())],
                names=["doc_id", "shared", "n", "set"])
    return (_texts(documents).join(small(wanted, 64), "doc_id")
            .select("doc_id", "shared", "digest", "text")
            .mapInArrow(read, "doc_id bigint, shared bigint, n bigint, `set` binary"))


# -- 3. documents against hubs ----------------------------------------------------------------------

def prefix_entries(sets: DataFrame, is_hot=None) -> DataFrame:
    """(shingle, size class, doc_id, n, place, share) of the first shingles of each set; share is
    the document's rank as a hub, place that of the shingle in the set. Shingles are ordered by
    hash, those for which ``is_hot`` holds after all others."""
    def read(batches):
        for batch in batches:
            shingle, owner, place = [], [], []
            for i, raw in enumerate(batch.column("set").to_pylist()):
                own = np.frombuffer(raw, np.uint64)
                if is_hot:
                    own = own[np.argsort(is_hot(own), kind="stable")]
                own = own[:prefix_length(len(own))]
                shingle.append(own.view(np.int64))
                owner.append(np.full(len(own), i))
                place.append(np.arange(len(own)))
            if not owner:
                continue
            owner = np.concatenate(owner)
            doc, n, shared = (batch.column(c).to_numpy()[owner] for c in ("doc_id", "n", "shared"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(shingle), pa.int64()), pa.array(size_class(n), pa.int32()),
                 pa.array(doc, pa.int64()), pa.array(n, pa.int32()),
                 pa.array(np.concatenate(place), pa.int32()), pa.array(shared / n, pa.float64())],
                names=["shingle", "size_class", "doc_id", "n", "place", "share"])
    return sets.mapInArrow(read, "shingle bigint, size_class int, doc_id bigint, n int, place int, "
                                 "share double")


def hot_test(counted: DataFrame, total: int):
    """Whether shingles are hot, by the rows of ``_counted`` for so many shingles. Any fixed test
    gives the same links, since the first shingles may be taken in any common order."""
    codes = counted.filter("hot").select("code").toArrow().column("code").to_numpy()
    known = counted.sparkSession.sparkContext.broadcast(np.sort(codes))

    def is_hot(shingles):
        codes = codes_of(shingles, total)
        at = np.searchsorted(known.value, codes)
        at[at == len(known.value)] = 0
        return known.value[at] == codes if len(known.value) else np.zeros(len(codes), bool)
    return is_hot


def size_class(n: np.ndarray) -> np.ndarray:
    """Sizes within 4:3 of one another are in the same class or in neighbouring ones."""
    return np.floor(np.log(n) / np.log(4 / 3)).astype(np.int32)


def hub_pairs(entries: DataFrame) -> DataFrame:
    """(doc_id, hub): each document with the hub it shares most of its first shingles with."""
    rank = F.struct(F.col("share").alias("share"), (-F.col("doc_id")).alias("low"))
    hubs = (entries.groupBy("shingle", "size_class")
            .agg(F.max(rank).alias("best"), F.min("doc_id").alias("least"),
                 F.max("doc_id").alias("most"))
            .filter("least != most")
            .select("shingle", "size_class", (-F.col("best.low")).alias("hub")))
    ties = (entries.select("shingle", "size_class", "doc_id").join(hubs, ["shingle", "size_class"])
            .filter("doc_id != hub").groupBy("doc_id", "hub").agg(F.count(F.lit(1)).alias("common")))
    return (ties.groupBy("doc_id").agg(F.max(F.struct("common", "hub")).alias("best"))
            .select("doc_id", F.col("best.hub").alias("hub")))


def linked_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs (doc_id, hub) whose whole sets link."""
    pairs = cut(pairs)
    hubs = cut(pairs.select(F.col("hub").alias("doc_id")).distinct())
    own = sets.select("doc_id", F.col("set").alias("own"))
    of_hub = (sets.join(small(hubs, 32), "doc_id", "left_semi")
              .select(F.col("doc_id").alias("hub"), F.col("set").alias("hub_set")))

    def compare(batches):
        for batch in batches:
            keep, last_raw, last = [], None, None
            for own_raw, hub_raw in zip(batch.column("own"), batch.column("hub_set")):
                hub_raw = hub_raw.as_py()
                if hub_raw != last_raw:
                    last_raw, last = hub_raw, np.frombuffer(hub_raw, np.uint64)
                mine = np.frombuffer(own_raw.as_py(), np.uint64)
                shared = len(np.intersect1d(mine, last, assume_unique=True))
                keep.append(linked(shared, len(mine), len(last)))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").filter(mask), batch.column("hub").filter(mask)],
                names=["a", "b"])

    return (own.join(small(pairs, 32), "doc_id").join(of_hub, "hub")
            .select("doc_id", "hub", "own", "hub_set").mapInArrow(compare, "a bigint, b bigint"))


# -- 4. pairs of different groups -------------------------------------------------------------------

def mixed_entries(entries: DataFrame, united: DataFrame) -> DataFrame:
    """The entries of shingles that occur in several united groups, with the group (class_) and
    the number of the shingle's documents (docs)."""
    group = united.select(F.col("node").alias("doc_id"), F.col("root").alias("class_"))
    entries = (entries.drop("share").join(small(cut(group), 32), "doc_id", "left")
               .withColumn("class_", F.coalesce("class_", "doc_id")))
    mixed = (entries.groupBy("shingle")
             .agg(F.count(F.lit(1)).alias("docs"), F.min("class_").alias("least"),
                  F.max("class_").alias("most"))
             .filter("least != most").select("shingle", "docs"))
    return cut(entries.join(mixed, "shingle"))


def rare_pairs(mixed: DataFrame, hot: int) -> DataFrame:
    """(doc_id, hub): the pairs of different groups with a rare first shingle in common that the
    bounds leave."""
    lists = (mixed.filter(F.col("docs") <= hot).groupBy("shingle")
             .agg(F.collect_list(F.struct("doc_id", "n", "place", "class_")).alias("members")))
    busy = (mixed.filter(F.col("docs") > hot).groupBy("doc_id")
            .agg(F.count(F.lit(1)).alias("busy")))

    def pair_up(batches):
        for batch in batches:
            members = batch.column("members")
            edges = members.offsets.to_numpy()
            flat = members.values
            doc, n, place, group = (
                flat.field(f).to_numpy() for f in ("doc_id", "n", "place", "class_"))
            out = []
            for a, b in zip(edges[:-1], edges[1:]):
                i, j = np.triu_indices(b - a, 1)
                i, j = i + a, j + a
                fits = (group[i] != group[j]) & (
                    100 * np.minimum(n[i], n[j]) >= SHARE * np.maximum(n[i], n[j]))
                i, j = i[fits], j[fits]
                swap = doc[i] > doc[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                out.append(np.stack([doc[i], doc[j], n[i], n[j], place[i], place[j]]))
            table = np.concatenate(out, axis=1) if out else np.zeros((6, 0), np.int64)
            order = np.lexsort((table[1], table[0]))
            table = table[:, order]
            first = np.flatnonzero(np.append(True, (table[:2, 1:] != table[:2, :-1]).any(0))
                                   if len(order) else np.zeros(0, bool))
            last = (np.maximum.reduceat(table[4:], first, axis=1) if len(first)
                    else np.zeros((2, 0), np.int64))
            common = np.diff(np.append(first, len(order)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (*table[:4, first], *last, common)],
                names=["a", "b", "n_a", "n_b", "last_a", "last_b", "common"])

    names = ["a", "b", "n_a", "n_b", "last_a", "last_b", "common"]
    pairs = (lists.mapInArrow(pair_up, ", ".join(f"{c} bigint" for c in names))
             .groupBy("a", "b", "n_a", "n_b")
             .agg(F.max("last_a").alias("last_a"), F.max("last_b").alias("last_b"),
                  F.sum("common").alias("common")))
    for side in "ab":
        pairs = pairs.join(busy.select(F.col("doc_id").alias(side), F.col("busy").alias(f"busy_{side}")),
                           side, "left")
    # What two sets share: the rare shingles counted, hot ones among the first of both, and no
    # more after the last counted one than either has left.
    most = (F.col("common") + F.least(F.coalesce("busy_a", F.lit(0)), F.coalesce("busy_b", F.lit(0)))
            + F.least(F.expr("n_a - 1 - last_a"), F.expr("n_b - 1 - last_b")))
    return (pairs.filter((100 + SHARE) * most >= SHARE * F.expr("n_a + n_b"))
            .select(F.col("a").alias("doc_id"), F.col("b").alias("hub")))


# -- 5. the product of blocks -----------------------------------------------------------------------

def product_links(left: list[np.ndarray], right: list[np.ndarray], share: int = SHARE):
    """(i, j) of the linked rows of two blocks of sets. Row i of the product is accumulated over
    the columns of the left set; pairs out of the size bounds are dropped before and after."""
    if not left or not right:
        return
    sizes = np.array([len(s) for s in right], np.int64)
    columns, place = np.unique(np.concatenate(right), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    for i, own in enumerate(left):
        n = len(own)
        fits = (100 * np.minimum(sizes, n) >= share * np.maximum(sizes, n)) & (sizes > 0)
        if not n or not fits.any():
            continue
        at = np.searchsorted(columns, own)
        at = at[at < len(columns)]
        mark = np.zeros(len(columns), np.int32)
        mark[at[columns[at] == own[:len(at)]]] = 1
        counts = np.add.reduceat(mark[place], np.minimum(starts, len(place) - 1))
        for j in np.flatnonzero(fits & linked(counts, sizes, n, share)):
            yield i, int(j)


def block_links(sets: DataFrame, mixed: DataFrame, hot: int, block: int) -> DataFrame:
    """(a, b): of the links between documents that share a hot first shingle, enough to connect
    what links connect."""
    busy = mixed.filter(F.col("docs") > hot)
    centre = busy.groupBy("shingle").agg(F.min("doc_id").alias("b"))
    clusters = connected(busy.join(centre, "shingle")
                         .select(F.col("doc_id").alias("a"), "b").distinct())
    spots = (busy.select("doc_id", "size_class", "class_").distinct()
             .join(clusters.select(F.col("node").alias("doc_id"), F.col("root").alias("cluster")),
                   "doc_id"))
    # Groups of a block or more in a size class have blocks of their own; others share blocks.
    place = ["cluster", "size_class"]
    groups = spots.groupBy(*place, "class_").agg(F.count(F.lit(1)).alias("members"))
    groups = groups.withColumn("owner", F.when(F.col("members") >= block, F.col("class_")))
    blocks = cut(groups.groupBy(*place, "owner").agg(
        F.ceil(F.sum("members") / block).cast("int").alias("blocks")))
    same_owner = F.col("owner").eqNullSafe(F.col("owner_1"))
    placed = (spots.join(groups.select(*place, "class_", "owner"), [*place, "class_"])
              .join(blocks.withColumnRenamed("owner", "owner_1"), place).filter(same_owner)
              .withColumn("number", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
              .drop("blocks", "owner_1"))
    other = blocks.select("cluster", F.col("size_class").alias("size_2"),
                          F.col("owner").alias("owner_2"), F.explode(F.sequence(
                              F.lit(0), F.col("blocks") - 1)).alias("number_2"))

    def key(end: str):
        own = F.col(f"owner{end}")
        return F.struct(F.col("size_class" if not end else f"size{end}").alias("c"),
                        F.coalesce(own, F.lit(0)).alias("o"), own.isNull().alias("s"),
                        F.col(f"number{end}").alias("n"))

    mine, theirs = key(""), key("_2")
    in_reach = F.abs(F.col("size_class") - F.col("size_2")) <= 1
    one_group = F.coalesce(F.col("owner") == F.col("owner_2"), F.lit(False))
    cells = cut(placed.join(other, "cluster").filter(in_reach & ~one_group)
                .select("doc_id", "class_", F.xxhash64("cluster", F.least(mine, theirs),
                                                       F.greatest(mine, theirs)).alias("cell"),
                        (mine <= theirs).alias("left"), (mine >= theirs).alias("right")))
    work = (sets.select("doc_id", "set").join(small(cells, 64), "doc_id").repartition("cell")
            .sortWithinPartitions("cell", "doc_id"))

    def cell_links(rows):
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x
        left = [r for r in rows if r[2]]
        right = [r for r in rows if r[3]]
        sets_of = lambda side: [np.frombuffer(r[4], np.uint64) for r in side]
        for i, j in product_links(sets_of(left), sets_of(right)):
            a, b = find(left[i][1]), find(right[j][1])
            if a != b:
                root[max(a, b)] = min(a, b)
                yield left[i][0], right[j][0]

    def multiply(batches):
        rows, cell = [], None
        out: list[tuple[int, int]] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in
                             ("doc_id", "class_", "left", "right", "set", "cell"))):
                if row[5] != cell:
                    out.extend(cell_links(rows))
                    rows, cell = [], row[5]
                rows.append(row)
        out.extend(cell_links(rows))
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())],
            names=["a", "b"])

    return work.mapInArrow(multiply, "a bigint, b bigint")


# -- the operator ------------------------------------------------------------------------------------

def components(documents: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_shingles and component_id."""
    rows = cut(set_digests(documents))
    known = rows.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = known.groupBy("digest", F.col("n_shingles").alias("n")).agg(
        F.min("doc_id").alias("rep"))
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0

    shared = shared_counts(_texts(documents), _text_sets, total)
    most = 100 * F.col("shared") >= SHARE * F.col("n")
    wanted = cut(classes.withColumnRenamed("rep", "doc_id").join(shared, "doc_id").filter(most)
                 .select("doc_id", "digest", F.least("shared", "n").alias("shared")))
    release(documents.sparkSession)
    copies = cut(kept_sets(documents, wanted))
    total = copies.agg(F.sum("n")).first()[0] or 0
    counted = cut(_counted(copies, _stored_sets, total, _hot_limit(total)))
    again = cut(_sums(counted))
    sets = (copies.drop("shared").join(small(again, 32), "doc_id").filter(most)
            .withColumn("shared", F.least("shared", "n")))

    by_hub = cut(linked_pairs(hub_pairs(prefix_entries(sets)), sets))
    release(documents.sparkSession)
    mixed = mixed_entries(prefix_entries(sets, hot_test(counted, total)), connected(by_hub))
    release(documents.sparkSession)
    by_pair = linked_pairs(rare_pairs(mixed, HOT), sets)
    by_block = block_links(sets, mixed, HOT, BLOCK)
    # Rows of one id belong together, and so do rows of one set.
    equal = (known.join(classes.withColumnRenamed("n", "n_shingles"), ["digest", "n_shingles"])
             .filter("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    roots = connected(equal.union(by_hub).union(by_pair).union(by_block))
    release(documents.sparkSession)
    return (rows.join(roots, rows["doc_id"] == roots["node"], "left")
            .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")))
