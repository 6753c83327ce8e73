"""Removal of passages of LENGTH bytes that occur more than once, within or across documents.

The suffixes that can share LENGTH bytes are brought together first. Every string of LENGTH bytes holds an anchor: of
all the GRAM-byte strings in it, the one with the smallest hash, the leftmost of equals. Equal strings have equal
anchors at equal distance, so only strings around equal anchors need comparing, and all strings around one anchor are
aligned by it. Consecutive strings with the same anchor form a stretch; stretches that are equal as a whole are
repeated as a whole, and one of them stands for all.

The others are decided by a column-wise construction of their common suffix order: beginning at the last column, each
round inserts one symbol of every stretch, re-sorts the present order by it (a stable pass over the symbols that
precede the sorted suffixes, which are their Burrows-Wheeler transform), and updates the array of common prefixes of
neighbours from its minima. A string of LENGTH bytes is repeated if its suffix shares LENGTH symbols with a neighbour.
The columns live in a file that is read once, from its end to its start; only the order and the prefixes are in memory.

Without the anchors the construction would need as many rounds as the longest document has bytes, each of them
rewriting all of the transform; with them it has 2 * LENGTH - GRAM rounds for any input.

    texts, packed into blocks -> anchors and stretches -> by anchor: repeated whole | to be compared
          -> stretches of text -> rounds of columns -> repeated spans -> back to the texts

Defined cases: a null text counts as empty; texts shorter than LENGTH lose nothing. Rows that repeat a document are
documents of their own, so all of it goes if it is long enough. Overlapping and touching spans are one. Every copy
goes, the first included. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmon.llm import blocks
from procmon.llm.common import bucketed, mix64, partitions, powers, stored, text_bytes, whole_text

LENGTH, GRAM = 200, 50
_REACH = LENGTH - GRAM  # distance of an anchor from the start of its string, at most
_COLUMNS = _REACH + LENGTH
_CHUNK = 1 << 20
BLOCK_BYTES = 8 << 20
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def stretches(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Of all strings of LENGTH bytes inside a text: runs with the same anchor.

    text; place of the anchor in the text; bytes of the run before (left) and from (right) it; hash of the anchor
    and of the whole run.
    """
    out: list[tuple] = []
    ends = np.repeat(at[1:], np.diff(at))
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for low in range(0, max(0, len(data) - LENGTH + 1), _CHUNK):
        piece = data[low : low + _CHUNK + LENGTH - 1]
        up, down = powers(len(piece) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[piece] * up[:-1], dtype=np.uint64)])
        n = len(piece) - GRAM + 1
        gram = mix64((sums[GRAM:] - sums[:n]) * down[:n])
        # The upper bits order the anchors, the lower ones hold the place: the leftmost of equals wins.
        ranked = (gram & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
        place = (_sliding_minimum(ranked, _REACH + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.arange(len(place))
        start = start[start + low + LENGTH <= ends[low : low + len(place)]]
        if not len(start):
            continue
        place = place[start]
        new = np.concatenate([[True], (np.diff(place) != 0) | (np.diff(start) != 1)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        begin, end, anchor = start[first], start[last] + LENGTH, place[first]
        whole = mix64((sums[end] - sums[begin]) * down[begin] + ((anchor - begin) * 1024 + end - begin).astype(np.uint64))
        text = owner[begin + low]
        out.append((text, anchor + low - at[text], anchor - begin, end - anchor, gram[anchor], whole))
    names = ("text", "place", "left", "right", "anchor", "whole")
    kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return {k: np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, (k, t) in enumerate(zip(names, kinds))}


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(x)] = x
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _kinds(anchor: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by anchor and whole, place in it of the first of each kind, members of each kind)."""
    order = np.lexsort((whole, anchor))
    head = (np.diff(anchor[order]) != 0) | (np.diff(whole[order]) != 0)
    first = np.flatnonzero(np.concatenate([[True], head])) if len(order) else np.zeros(0, np.int64)
    return order, first, np.diff(np.append(first, len(order)))


def _anchored(rows):
    """Stretches of each block. What repeats inside a block is decided here, and one of each kind goes on.

    `role`: 0 repeated, a span to be removed; 1 once in the block; 2 stands for several. Rows of role 0 are dealt out
    evenly, the others by their anchor, so a passage repeated many times is few rows for the task of its anchor.
    """
    for batch in rows:
        for row in range(batch.num_rows):
            found = stretches(*blocks.texts(batch, row))
            number = batch.column("block")[row].as_py()
            order, first, times = _kinds(found["anchor"], found["whole"])
            alike = order[np.repeat(times, times) > 1]
            pick = np.concatenate([order[first], alike])
            role = np.concatenate([1 + (times > 1), np.zeros(len(alike), int)]).astype(np.int8)
            anchor, place = found["anchor"][pick], found["place"][pick]
            even = mix64(place.astype(np.uint64) + (found["text"][pick].astype(np.uint64) << np.uint64(32)))
            yield from pa.table({
                "deal": pa.array(np.where(role > 0, anchor, even).view(np.int64)), "role": pa.array(role),
                "block": pa.array(np.full(len(pick), number, np.int64)), "text": pa.array(found["text"][pick].astype(np.int32)),
                "anchor": pa.array(anchor.view(np.int64)), "whole": pa.array(found["whole"][pick].view(np.int64)), "place": pa.array(place),
                "left": pa.array(found["left"][pick].astype(np.int16)), "right": pa.array(found["right"][pick].astype(np.int16)),
            }).to_batches(max_chunksize=1 << 16)


def _sorted_out(rows):
    """Of all stretches with the anchors of a task: those repeated whole, and one of each kind where kinds differ.

    `role`: 0 repeated whole, a span to be removed; 1 to be compared, once in the input; 2 to be compared with, repeated.
    """
    rows = list(rows)
    if not sum(r.num_rows for r in rows):
        return
    table = pa.Table.from_batches(rows)
    role = np.asarray(table.column("role"))
    decided, rest = np.flatnonzero(role == 0), np.flatnonzero(role > 0)
    anchor, whole = (np.asarray(table.column(c))[rest] for c in ("anchor", "whole"))
    order, first, members = _kinds(anchor, whole)
    if len(rest):
        times = np.add.reduceat(role[rest][order].astype(np.int64), first)
        single = role[rest][order] == 1
        alike = order[(np.repeat(times, members) > 1) & single]
        # A kind whose anchor has other kinds too.
        other = np.concatenate([[False], np.diff(anchor[order][first]) == 0])
        several = other | np.append(other[1:], False)
        one, as_ = order[first[several]], 1 + (times[several] > 1)
    else:
        alike = one = as_ = np.zeros(0, np.int64)
    picked = np.concatenate([decided, rest[alike], rest[one]])
    roles = np.concatenate([np.zeros(len(decided) + len(alike), np.int8), as_]).astype(np.int8)
    out = table.take(pa.array(picked)).drop_columns(["deal", "whole", "role"]).append_column("role", pa.array(roles))
    yield from out.to_batches(max_chunksize=1 << 16)


def _cut(block: pa.Table, wanted: pa.Table) -> pa.Table:
    """The bytes of the stretches of one block that are to be compared."""
    data, at = blocks.texts(block, 0)
    place, left, right = (np.asarray(wanted.column(c)).astype(np.int64) for c in ("place", "left", "right"))
    begin = at[np.asarray(wanted.column("text"))] + place - left
    size = left + right
    ends = np.concatenate([[0], np.cumsum(size)])
    pick = np.arange(ends[-1]) - np.repeat(ends[:-1] - begin, size)
    cut = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data[pick].tobytes())])
    return wanted.append_column("bytes", cut)


def _columns(rows):
    """Rounds over all stretches of a task; returns the repeated span of each stretch that has one."""
    with tempfile.TemporaryDirectory() as folder:
        kept, files = [], []
        for batch in rows:
            if not batch.num_rows:
                continue
            left, right = (np.asarray(batch.column(c)).astype(np.int64) for c in ("left", "right"))
            data, at = text_bytes(batch.column("bytes"))
            grid = np.zeros((batch.num_rows, _COLUMNS), np.uint8)
            size = np.diff(at)
            inner = np.arange(len(data)) - np.repeat(at[:-1], size)
            grid[np.repeat(np.arange(batch.num_rows), size), np.repeat(_REACH - left, size) + inner] = data
            files.append((os.path.join(folder, str(len(files))), batch.num_rows))
            np.ascontiguousarray(grid.T).tofile(files[-1][0])
            kept.append(batch.select(["anchor", "block", "text", "place", "left", "right", "role"]))
        if not kept:
            return
        table = pa.Table.from_batches(kept)
        parts = [np.memmap(f, np.uint8, "r", shape=(_COLUMNS, n)) for f, n in files]
        first, last = _rounds(parts, *(np.asarray(table.column(c)) for c in ("anchor", "left", "right")))
        del parts
    # Strings of one stretch lie less than LENGTH apart, so what is repeated of it is one span.
    hit = (last >= 0) & (np.asarray(table.column("role")) == 1)
    place = np.asarray(table.column("place"))[hit]
    yield from pa.table({
        "block": np.asarray(table.column("block"))[hit], "text": np.asarray(table.column("text"))[hit],
        "begin": place - _REACH + first[hit], "end": place - _REACH + last[hit] + LENGTH,
    }).to_batches(max_chunksize=1 << 16)


def _rounds(parts: list, anchor: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last column at which each stretch has a repeated string; -1 if none."""
    n = len(anchor)
    group = np.unique(anchor, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(group, kind="stable")
    begin, end = _REACH - left.astype(np.int64), _REACH + right.astype(np.int64)
    common = np.zeros(n + 1, np.int32)  # with the neighbour before; the last entry closes the array
    first, last = np.full(n, -1), np.full(n, -1)
    for column in range(_COLUMNS - 1, -1, -1):
        symbol = np.concatenate([p[column] for p in parts]).astype(np.int64)
        symbol[(column < begin) | (column >= end)] = 256
        key = group[order] * 512 + symbol[order]
        turn = np.argsort(key, kind="stable")
        key = key[turn]
        least = np.minimum.reduceat(common, turn + 1)[:-1]  # between each pair of new neighbours
        goes_on = (key[1:] == key[:-1]) & (key[1:] % 512 != 256)
        common[1:n] = np.where(goes_on, least + 1, 0)
        common[0] = common[n] = 0
        order = order[turn]
        if column <= _REACH:
            far = common >= LENGTH
            hit = order[far[:-1] | far[1:]]
            first[hit] = column
            last[hit] = np.maximum(last[hit], column)
    return first, last


def _removed(block: pa.Table, spans: pa.Table) -> pa.Table:
    """The documents of one block without their spans."""
    data, at = blocks.texts(block, 0)
    n = len(at) - 1
    text, begin, end = (np.asarray(spans.column(c)).astype(np.int64) for c in ("text", "begin", "end"))
    # Texts stand one after another, a byte apart, so that spans of neighbours never touch.
    apart = at + np.arange(n + 1)
    edge = np.zeros(apart[-1] + 1, np.int32)
    np.add.at(edge, apart[text] + begin, 1)
    np.add.at(edge, apart[text] + end, -1)
    gone = np.cumsum(edge[:-1]) > 0
    starts = gone & ~np.concatenate([[False], gone[:-1]])
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[apart])
    digests = []
    for k in range(n):
        of = data[at[k] : at[k + 1]]
        digests.append(hashlib.sha256(of[~gone[apart[k] : apart[k] + len(of)]].tobytes()).hexdigest())
    return pa.table({
        "doc_id": blocks.column(block, 0, "doc_id"), "n_bytes": pa.array(np.diff(at)), "n_removed": pa.array(total(gone)),
        "n_spans": pa.array(total(starts)), "kept_sha256": pa.array(digests, pa.string()),
    })


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    n = partitions(docs.sparkSession)
    own = docs.select(F.col(key).alias("doc_id"), whole_text(text).alias("text"))
    packed = bucketed(blocks.pack(own, BLOCK_BYTES), "block")
    place = "block long, text int, anchor long, place long, left smallint, right smallint"
    fields = "deal long, role tinyint, " + place.replace("anchor long", "anchor long, whole long")
    found = packed.mapInArrow(_anchored, fields).repartition(n, "deal")
    sorted_out = stored(found.mapInArrow(_sorted_out, f"{place}, role tinyint"), "stretches")
    wanted = sorted_out.where("role > 0")
    cut = packed.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(_cut, f"{place}, role tinyint, bytes binary")
    differing = cut.repartition(n, "anchor").mapInArrow(_columns, "block long, text int, begin long, end long")
    alike = sorted_out.where("role = 0").select("block", "text", F.expr("place - left").alias("begin"), F.expr("place + right").alias("end"))
    spans = alike.union(differing)
    id_type = own.schema["doc_id"].dataType.simpleString()
    told = packed.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(
        _removed, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    return told.withColumnRenamed("doc_id", key)
