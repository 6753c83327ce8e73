"""Near-duplicate documents by BagMinHash over the multiset of their five-word shingles.

Words are runs of non-blank bytes (blank: 0x20, 0x09-0x0D), A-Z lower-cased. A text of fewer than five words
is one shingle of all its words. A shingle that occurs w times has weight w. Its weight axis is cut into the
dyadic intervals (0, 1], (1, 2], (2, 4], (4, 8] ...; each carries its own Poisson process whose rate is the
interval's length times SLOTS. A point belongs to a slot and, by further bits of its hash, to one unit of its
interval: the halves into which an interval is split, again and again, are taken from these bits. Points above w do not count.
The signature is the earliest point of each slot, so two slots agree with the probability
sum(min) / sum(max), the weighted Jaccard similarity. Points are generated in order and only up to the time by
which all slots are filled, so after one point for each shingle the cost does not depend on the text's length.

    texts -> signatures -> equal multisets become one node -> bands -> nodes of a band that agree in enough slots
          -> groups of candidates -> exact multiset overlap of all pairs of a group -> links -> components

Bands find candidates, agreement over the whole signature keeps those that can reach the similarity, and only the
exact overlap makes a link. With 32 bands of 6 slots a pair at similarity 0.8 shares no band with probability
6e-5; a pair at 0.8 falls below AGREE in the signature with about as much. Large buckets and groups are cut into
blocks that meet pair by pair in separate tasks (pairs.py).

Defined cases: a null text counts as empty; a text without words has no shingle and links with nothing. Rows with
equal shingles are always in one class. Rows without doc_id take part; a class without any doc_id has a null
class id. Of a class the smallest doc_id is kept (null counts as largest), and of rows that repeat it, one.
An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from procmon.llm.common import batches, components, mix64, powers, stored, text_bytes, whole_text
from procmon.llm.pairs import block_pairs, clusters, runs

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 6
SLOTS = BANDS * ROWS
#: Share of equal slots from which a pair is compared exactly: four standard deviations below SIMILARITY.
AGREE = SIMILARITY - 4.0 * (SIMILARITY * (1 - SIMILARITY) / SLOTS) ** 0.5
#: Members of a group that are compared in one task.
GROUP_BLOCK = 500

_GOLD = np.uint64(0x9E3779B97F4A7C15)


_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
def _multiple(n: int, of: np.uint64) -> np.uint64:
    return np.uint64(n * int(of) & 0xFFFFFFFFFFFFFFFF)


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, times) for every different shingle of each text; sorted by text, then shingle."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not len(data):
        return none
    word = ~_BLANK[data]
    first = np.zeros(len(data), bool)
    first[at[:-1][at[:-1] < len(data)]] = True
    starts = np.flatnonzero(word & (first | ~np.concatenate([[False], word[:-1]])))
    ends = np.flatnonzero(word & np.concatenate([first[1:] | ~word[1:], [True]])) + 1
    if not len(starts):
        return none
    up, down = powers(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * up[:-1], dtype=np.uint64)])
    words = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    owner = np.searchsorted(at, starts, "right") - 1
    count = np.bincount(owner, minlength=len(at) - 1)
    begin = np.concatenate([[0], np.cumsum(count)])
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    weight = mix64(np.arange(1, WORDS + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
    place = np.arange(len(words))
    left = begin[owner + 1] - place  # words from here to the end of the text
    total = np.zeros(len(words), np.uint64)
    for k in range(WORDS):
        total += np.where(left > k, padded[k : k + len(words)], np.uint64(0)) * weight[k]
    whole = left >= WORDS
    whole |= (place == begin[owner]) & (left < WORDS)
    hashes = mix64(total + np.minimum(left, WORDS).astype(np.uint64))[whole]
    owner = owner[whole]
    bounds = np.searchsorted(owner, np.arange(len(at)))
    for i in range(len(at) - 1):
        hashes[bounds[i] : bounds[i + 1]].sort()
    new = np.concatenate([[True], (np.diff(owner) != 0) | (hashes[1:] != hashes[:-1])])
    where = np.flatnonzero(new)
    return owner[where], hashes[where], np.diff(np.append(where, len(hashes)))


def signatures(owner: np.ndarray, shingle: np.ndarray, times: np.ndarray, texts: int) -> np.ndarray:
    """For each text SLOTS numbers: the time of the earliest point above, 32 bits that name it below."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((texts, SLOTS), none, np.uint64)
    weight = np.bincount(owner, weights=times, minlength=texts)
    limit = (np.log(SLOTS) + 4.0) / np.maximum(weight, 1.0)
    open_ = weight > 0
    while open_.any():
        flat = out.reshape(-1)
        low, number = 0, 1
        mine = np.flatnonzero(open_[owner])
        while len(mine):
            length = max(1, low)
            _points(flat, owner[mine], mix64(shingle[mine] + _multiple(number, _GOLD)), times[mine], low, length, limit)
            low, number = low + length, number + 1
            mine = mine[times[mine] > low]
        open_ &= (out == none).any(axis=1)
        out[open_] = none
        limit = np.where(open_, limit * 2.0, limit)
    return out


def _points(flat: np.ndarray, owner: np.ndarray, seed: np.ndarray, times: np.ndarray, low: int, length: int, limit: np.ndarray) -> None:
    """Points of the processes of one interval, earliest first, until each has passed its text's limit."""
    now = np.zeros(len(owner))
    until = limit[owner]
    step = 0
    while len(owner):
        step += 2
        gap = (mix64(seed + _multiple(step, _ODD)) >> np.uint64(11)).astype(float) + 1.0
        now = now - np.log(gap * 2.0**-53) / (SLOTS * length)
        live = now < until
        owner, seed, times, now, until = (x[live] for x in (owner, seed, times, now, until))
        drawn = mix64(seed + _multiple(step + 1, _ODD))
        unit = low + ((drawn >> np.uint64(40)).astype(np.int64) * length >> 24)
        slot = ((drawn & np.uint64(0xFFFFFF)) * np.uint64(SLOTS) >> np.uint64(24)).astype(np.int64)
        name = mix64(drawn) & np.uint64(0xFFFFFFFF)
        # Times are positive floats, so their bits order like themselves.
        key = now.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | name
        counts = unit < times
        np.minimum.at(flat, owner[counts] * SLOTS + slot[counts], key[counts])


def _signed(batches_in):
    for table in batches(batches_in, 2 << 20):
        data, at = text_bytes(table.column("text"))
        owner, shingle, times = shingles(data, at)
        n = len(at) - 1
        names = signatures(owner, shingle, times, n) & np.uint64(0xFFFFFFFF)
        digest = []
        for salt in (1, 2):
            each = mix64(shingle + times.astype(np.uint64) * _ODD + _multiple(salt, _GOLD))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(each, dtype=np.uint64)])
            bounds = np.searchsorted(owner, np.arange(n + 1))
            digest.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
        words = np.bincount(owner, weights=times, minlength=n).astype(np.int64)
        turn = mix64(np.arange(1, ROWS + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
        band = (names.reshape(n, BANDS, ROWS) * turn).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD
        some = pa.array(words == 0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(mix64(band.reshape(-1)).view(np.int64)))
        packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SLOTS), n, [None, pa.py_buffer((names & np.uint64(255)).astype(np.uint8).tobytes())]).cast(pa.binary())
        yield from pa.table({
            "doc_id": table.column("doc_id"), "row": table.column("row"), "d1": pa.array(digest[0]), "d2": pa.array(digest[1]),
            "size": pa.array(words), "bands": lists, "signature": packed, "blank": some,
        }).to_batches()


def _agreeing(rows: pa.Table) -> pa.Table:
    """Links to the smallest member of each local component of pairs that agree in enough slots."""
    node, size = np.asarray(rows.column("node")), np.asarray(rows.column("size"), float)
    names = np.array([np.frombuffer(s, np.uint8) for s in rows.column("signature").to_pylist()], np.uint8).reshape(len(node), SLOTS)
    out = []
    for first, second in runs(rows, "bucket"):
        other = first if second is None else second
        left, right = [], []
        for k, i in enumerate(first):
            rest = other[k + 1 :] if second is None else other
            fits = rest[np.minimum(size[i], size[rest]) >= SIMILARITY * np.maximum(size[i], size[rest])]
            fits = fits[(names[fits] == names[i]).sum(axis=1) >= AGREE * SLOTS]
            left.append(np.full(len(fits), i))
            right.append(fits)
        if left:
            out.append(_stars(np.concatenate(left), np.concatenate(right), node))
    return _edges(out)


def _units(batches_in):
    """The shingles of each text, a shingle that occurs w times as w different units."""
    for table in batches(batches_in, 2 << 20):
        data, at = text_bytes(table.column("text"))
        owner, shingle, times = shingles(data, at)
        copy = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        units = mix64(np.repeat(shingle, times) + copy.astype(np.uint64) * _GOLD)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=times, minlength=len(at) - 1).astype(np.int64))])
        packed = [units[bounds[i] : bounds[i + 1]].tobytes() for i in range(len(at) - 1)]
        yield from pa.table({"node": table.column("node"), "units": pa.array(packed, pa.large_binary())}).cast(
            pa.schema([("node", pa.int64()), ("units", pa.binary())])
        ).to_batches()


def overlaps(units: list[np.ndarray], first: int) -> np.ndarray:
    """Shared units of each of the `first` leading sets with every set."""
    owner = np.repeat(np.arange(len(units)), [len(u) for u in units])
    codes = np.unique(np.concatenate(units), return_inverse=True)[1] if len(owner) else np.zeros(0, np.int64)
    seen = np.bincount(codes)
    column = np.cumsum(seen > 1) - 1
    shared = seen[codes] > 1
    owner, column = owner[shared], column[codes[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((first, len(units)), np.float32)
    width = 2048
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, [low, low + width]))
        grid = np.zeros((len(units), width), np.float32)
        grid[owner[part], column[part] - low] = 1.0
        out += grid[:first] @ grid.T
    return out


def _verified(rows: pa.Table) -> pa.Table:
    node = np.asarray(rows.column("node"))
    units = [np.frombuffer(u, np.uint64) for u in rows.column("units").to_pylist()]
    out = []
    for first, second in runs(rows, "cluster"):
        other = first if second is None else np.concatenate([first, second])
        both = overlaps([units[i] for i in other], len(first))
        size = np.array([len(units[i]) for i in other], float)
        similar = both >= SIMILARITY * (size[: len(first), None] + size[None, :] - both)
        i, j = np.nonzero(similar)
        real = j > i if second is None else j >= len(first)
        out.append(_stars(first[i[real]], other[j[real]], node))
    return _edges(out)


def _stars(left: np.ndarray, right: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both, at = np.unique(np.concatenate([left, right]).astype(np.int64), return_inverse=True)
    label = clusters(at[: len(left)], at[len(left) :], node[both])
    own = node[both] != label
    return node[both][own], label[own]


def _edges(out: list) -> pa.Table:
    a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, component_id, group_size, kept, row) of every row; `row` is the hash of its text."""
    own = docs.select(F.col(key).cast("long").alias("doc_id"), whole_text(text).alias("text")).withColumn("row", F.xxhash64("text"))
    signed = stored(
        own.mapInArrow(_signed, "doc_id long, row long, d1 long, d2 long, size long, bands array<long>, signature binary, blank boolean"), "signed"
    )
    # One node for each multiset, named by its smallest doc_id. Where there is none, or several multisets share
    # it, the name comes from the digest and is negative.
    some = signed.where("NOT blank").groupBy("d1", "d2").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("m"))
    some = some.select("d1", "d2", F.col("m.doc_id").alias("first_id"), F.col("m.row").alias("first_row"))
    nth = F.row_number().over(Window.partitionBy("first_id").orderBy("d1", "d2"))
    by_digest = F.expr("-(d1 & 4611686018427387903) - 1")
    nodes = some.where("first_id IS NOT NULL").withColumn("node", F.when(nth == 1, F.col("first_id")).otherwise(by_digest))
    nodes = stored(nodes.unionByName(some.where("first_id IS NULL").withColumn("node", by_digest)), "nodes")
    rep = signed.withColumnsRenamed({"doc_id": "id", "d1": "e1", "d2": "e2"}).dropDuplicates(["e1", "e2"]).join(
        nodes, (F.col("e1") == F.col("d1")) & (F.col("e2") == F.col("d2"))
    ).select("node", "size", "bands", "signature")
    slim = rep.select("node", F.explode(F.array_distinct("bands")).alias("bucket"))
    met = block_pairs(slim, "bucket", "node").join(rep.select("node", "size", "signature"), "node")
    close = met.groupBy("pack").applyInArrow(_agreeing, "a long, b long").distinct()
    groups = components(close, "a", "b").withColumnRenamed("component", "cluster")

    members = stored(groups.join(nodes, "node").select("node", "cluster", "first_id", "first_row"), "members")
    mine = (F.col("doc_id").eqNullSafe(F.col("first_id"))) & (F.col("row") == F.col("first_row"))
    # The same join at every size: members are as many as near copies, so they are never broadcast.
    texts = own.join(members.hint("merge"), mine).dropDuplicates(["node"]).select("node", "text")
    sets = texts.mapInArrow(_units, "node long, units binary")
    compared = block_pairs(members.select("node", "cluster"), "cluster", "node", GROUP_BLOCK).join(sets, "node")
    links = compared.groupBy("pack").applyInArrow(_verified, "a long, b long").distinct()
    classes = components(links, "a", "b").withColumnRenamed("node", "linked")

    named = nodes.join(classes, F.col("node") == F.col("linked"), "left").select("d1", "d2", F.coalesce("component", "node").alias("class"))
    rows = signed.join(named, ["d1", "d2"], "left").select("doc_id", "row", "blank", F.when(~F.col("blank"), F.col("class")).alias("class"))
    # The class keeps its smallest (doc_id, row); repeats of that row are numbered.
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row"))
    kept = rows.where("class IS NOT NULL").groupBy("class").agg(smallest.alias("k"), F.count("*").alias("n"))
    kept = kept.select("class", F.col("k.doc_id").alias("keep_id"), F.col("k.row").alias("keep_row"), "n")
    told = rows.join(kept, "class", "left")
    copy = F.row_number().over(Window.partitionBy("doc_id", "row").orderBy(F.lit(0)))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row")) & (copy == 1)
    return told.select(
        F.col("doc_id").alias(key), F.when(F.col("blank"), F.col("doc_id")).otherwise(F.col("keep_id")).alias("component_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (F.col("blank") | stays).alias("kept"), "row",
    )


def representatives(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that are kept, with all their columns."""
    told = near_duplicates(docs, text, key).where("kept").select(F.col(key).alias("_k"), F.col("row").alias("_r"))
    own = docs.withColumn("_own", F.col(key).cast("long")).withColumn("_row", F.xxhash64(whole_text(text)))
    chosen = own.join(told, F.col("_own").eqNullSafe(F.col("_k")) & (F.col("_row") == F.col("_r")), "left_semi")
    # Texts without words are all kept; of other rows that repeat doc_id and text, one.
    blank = ~F.coalesce(F.col(text).rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    single = chosen.where(~blank).dropDuplicates(["_own", "_row"])
    return single.unionByName(chosen.where(blank)).drop("_own", "_row")
