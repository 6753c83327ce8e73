"""Language-model scoring by context-tree weighting.

Bytes are decomposed into eight binary decisions. For every prefix of a byte there is a context tree
over the DEPTH bytes before it; each node holds a Krichevsky-Trofimov (KT) estimate, and the block
probability of a node is half its own KT estimate and half the product of its children. A byte costs the
logarithm of the probability under the mixture over all depths that this weighting gives after training.

Everything a byte's probability depends on is its gram: the DEPTH bytes before it and itself. Documents are
packed where they are read into blocks of about BLOCK_BYTES, which are written compressed. A block names its
distinct grams and words with their counts in training documents; the counts are summed over all blocks; the
tree is weighted; and each block gets back one number for each gram and word that it named. So no table of the
corpus is broadcast or collected, and what travels is one row for each block and distinct gram or word.

    documents -> packed blocks -> (block, key, count), bucketed by key -> sums by key -> tree below two context bytes, by those two bytes
           -> levels 1 and 0 (at most 256 rows) -> value of each key -> back to the blocks -> documents

Every text begins after DEPTH marks and ends with a mark, the byte 255, which UTF-8 never uses. Words meet under a 63-bit hash: of a
billion different words, two share one with a probability of about 0.05, and then count as one word.

Defined cases: a null text counts as empty and consists of its end; a null doc_id belongs to training (the
crc32 of the empty text is 0). With no training document every bit costs one bit. Repeated rows count and
score as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procmon.llm import blocks
from procmon.llm.common import bucketed, mix64, partitions, powers, stored, whole_text

#: Bytes of context, at most 5: a gram and its place in a stretch of _CHUNK bytes fit into 64 bits.
DEPTH = 5
BLOCK_BYTES = 16 << 20
#: Bytes whose grams are formed at a time, and shares of a block's grams that are counted one after another.
_CHUNK = 1 << 16
PASSES = 4
MARK = 255
#: Keys: a gram is its bytes as a number, a word is negative, and then there are the end of a text, the number of tokens and of different tokens.
END, TOKENS, TYPES = (1 << 60) + 1, (1 << 60) + 2, (1 << 60) + 3
_GRAMS = 1 << (8 * DEPTH + 8)

_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


# ------------------------------------------------------------------ texts of a block


def _rolled(laid: np.ndarray) -> np.ndarray:
    """The gram that ends at each byte from the one at DEPTH on."""
    n = len(laid) - DEPTH
    gram = np.zeros(n, np.uint64)
    for k in range(DEPTH + 1):
        gram <<= np.uint64(8)
        gram |= laid[k : k + n]
    return gram


def grams_of(data: np.ndarray, at: np.ndarray):
    """For some texts at a time, or parts of a giant one: (gram of each byte and end mark, number of the text it belongs to)."""
    n, i = len(at) - 1, 0
    while i < n:
        j = min(int(np.searchsorted(at, at[i] + _CHUNK, "right")) - 1, i + _CHUNK // 8, n)
        if j > i:
            lengths = np.diff(at[i : j + 1])
            # Each text is laid out after DEPTH marks and is followed by one.
            starts = np.concatenate([[0], np.cumsum(lengths + DEPTH + 1)])
            laid, kept = np.full(starts[-1], MARK, np.uint8), np.ones(starts[-1], bool)
            for k in range(DEPTH):
                kept[starts[:-1] + k] = False
            text = kept.copy()
            text[starts[1:] - 1] = False
            laid[text] = data[at[i] : at[j]]
            yield _rolled(laid)[kept[DEPTH:]], np.repeat(np.arange(i, j, dtype=np.int32), lengths + 1)
            i = j
            continue
        own = data[at[i] : at[i + 1]]
        for low in range(0, len(own) + 1, _CHUNK):
            high = min(len(own) + 1, low + _CHUNK)
            before, after = np.full(max(0, DEPTH - low), MARK, np.uint8), np.full(high - min(high, len(own)), MARK, np.uint8)
            yield _rolled(np.concatenate([before, own[max(0, low - DEPTH) : high], after])), np.full(high - low, i, np.int32)
        i += 1


def words_of(data: np.ndarray, at: np.ndarray):
    """For some texts at a time, or parts of a giant one: (63-bit hash of each word, A-Z lower-cased, number of the text it belongs to)."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + 4 * _CHUNK, "right")) - 1)
        low, last = int(at[i]), int(at[j])
        while low < last:
            high = min(last, low + 4 * _CHUNK)
            if high < last:
                # A giant text is cut at a blank, however far away that is.
                back = np.flatnonzero(_BLANK[data[low:high]])
                while not len(back) and high < last:
                    high = min(last, 2 * high - low)
                    back = np.flatnonzero(_BLANK[data[low:high]])
                high = low + int(back[-1]) + 1 if len(back) else high
            yield _hashed(data[low:high], np.clip(at[i : j + 1] - low, 0, high - low), i)
            low = high
        i = j


def _hashed(part: np.ndarray, at: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    word = ~_BLANK[part]
    begins = np.zeros(len(part) + 1, bool)
    begins[at] = True
    starts = np.flatnonzero(word & (begins[:-1] | ~np.concatenate([[False], word[:-1]])))
    ends = np.flatnonzero(word & (begins[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    up, down = powers(len(part) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[part] * up[: len(part)], dtype=np.uint64)])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)) >> np.uint64(1)
    return hashes, (first + np.searchsorted(at, starts, "right") - 1).astype(np.int32)


def _tally(stretches, taught: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different values, how often each stands in a training document) of stretches of (values below 2**63, text of each)."""
    found, counts, held, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [], 0

    def settle() -> None:
        marked, n = np.unique(np.concatenate(held), return_counts=True)
        found.append(marked >> np.uint64(1))
        counts.append(np.where(marked & np.uint64(1), n, 0).astype(np.int32))
        held.clear()

    for value, owner in stretches:
        held.append((value << np.uint64(1)) | taught[owner])
        size += len(value)
        if size > 1 << 19:
            settle()
            size = 0
    if held:
        settle()
    value, n = np.concatenate(found), np.concatenate(counts)
    del found, counts
    order = np.argsort(value)
    value, n = value[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    return value[first], np.add.reduceat(n, first) if len(first) else n


def _asked(batches_in):
    """The keys of each block with their counts in its training documents."""
    for batch in batches_in:
        for row in range(batch.num_rows):
            held = blocks.column(batch, row, "held_out").to_numpy(zero_copy_only=False).astype(bool)
            block = batch.column("block")[row].as_py()
            for keys, n in _keys(*blocks.texts(batch, row), held):
                for low in range(0, len(n), 1 << 16):
                    part = n[low : low + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), block, np.int64)), pa.array(keys[low : low + len(part)]), pa.array(part)], ["block", "key", "n"]
                    )


def _keys(data: np.ndarray, at: np.ndarray, held: np.ndarray):
    """(keys, counts) of a block: its grams in PASSES shares, one after the other, then its words and sums."""
    taught = ~held
    flags = taught.astype(np.uint64)
    for share in range(PASSES):
        # Shares follow the low bits of the last byte and of the one before it.
        of_share = ((g[m], o[m]) for g, o in grams_of(data, at) for m in [((g ^ (g >> np.uint64(8))) & np.uint64(PASSES - 1)) == share])
        grams, n = _tally(of_share, flags)
        yield grams.view(np.int64), n
    words, n = _tally(words_of(data, at), flags)
    yield -1 - words.view(np.int64), n
    ends = int(taught.sum())
    yield np.array([END, TOKENS, TYPES]), np.array([ends, int(n.sum()) + ends, 0])


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of keys that are all known; `keys` is rising."""
    return values[np.searchsorted(keys, wanted)]


def _scored(block: pa.Table, values: pa.Table) -> pa.Table:
    """The documents of one block, from the value of every key it named."""
    key, value = np.asarray(values.column("key")), np.asarray(values.column("value"), float)
    order = np.argsort(key)
    key, value = key[order], value[order]
    del order
    # Rising: words, grams, then the three sums.
    low = int(np.searchsorted(key, 0))
    words, counts, grams, cost = key[:low], value[:low], key[low:-3].view(np.uint64), value[low:-3]
    ends, tokens, types = value[-3:]
    logs, known = np.log10(counts + 0.5), counts > 0
    end_log, scale = math.log10(ends + 0.5), math.log10(tokens + 0.5 * (types + 1))

    data, at = blocks.texts(block, 0)
    n = len(at) - 1
    score, base, n_tokens, n_known = (np.zeros(n) for _ in range(4))

    def add(sums: np.ndarray, owner: np.ndarray, each: np.ndarray | None = None) -> None:
        if len(owner):
            first = int(owner.min())
            part = np.bincount(owner - first, weights=each)
            sums[first : first + len(part)] += part

    for gram, owner in grams_of(data, at):
        # Sorted together with their places, equal grams are looked up once and one after another.
        sorted_ = np.sort((gram << np.uint64(16)) | np.arange(len(gram), dtype=np.uint64))
        place, gram = (sorted_ & np.uint64(0xFFFF)).astype(np.int64), sorted_ >> np.uint64(16)
        new = np.concatenate([[True], gram[1:] != gram[:-1]])
        add(score, owner[place], _found(grams, cost, gram[new])[np.cumsum(new) - 1])
    for word, owner in words_of(data, at):
        where = np.searchsorted(words, -1 - word.view(np.int64))
        add(base, owner, logs[where])
        add(n_tokens, owner)
        add(n_known, owner, known[where])
    n_tokens += 1
    n_known += ends > 0
    base += end_log - n_tokens * scale
    return pa.table({
        "doc_id": blocks.column(block, 0, "doc_id"), "held_out": blocks.column(block, 0, "held_out"), "n_tokens": pa.array(n_tokens.astype(np.int64)), "n_known": pa.array(n_known.astype(np.int64)),
        "train_tokens": pa.array(np.full(n, int(tokens), np.int64)), "base_score": pa.array(base), "score": pa.array(score), "n_bytes": pa.array(np.diff(at)),
    })


# ------------------------------------------------------------------ the tree


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after moving the argument up by eight."""
    up = np.ones_like(x)
    for k in range(8):
        up *= x + k
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(up)


#: Logarithms of the gamma function at k + 1/2 and at k + 1, for the small counts that most nodes have.
_SMALL = np.arange(1 << 12, dtype=float)
_HALVES, _WHOLES = log_gamma(_SMALL + 0.5), log_gamma(_SMALL + 1.0)


def _log_gamma_of(n: np.ndarray, add: float, small: np.ndarray) -> np.ndarray:
    """log_gamma(n + add) of counts n; `small` has its first values."""
    out = small[np.minimum(n, len(small) - 1).astype(np.int64)]
    large = n >= len(small)
    if large.any():
        x = n[large] + add
        # Large counts overflow the shifted product; their argument needs no shift.
        far = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x)
        out[large] = np.where(x < 1e6, log_gamma(np.minimum(x, 1e6)), far)
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the KT probability of a zeros and b ones, whole numbers."""
    return _log_gamma_of(a, 0.5, _HALVES) + _log_gamma_of(b, 0.5, _HALVES) - _log_gamma_of(a + b, 1.0, _WHOLES) - np.log(np.pi)


def _weigh(a: np.ndarray, b: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(log of the weighted block probability, share of the mixture that stops at the node)."""
    own = log_kt(a, b)
    if below is None:
        return own, np.ones_like(own)
    both = np.logaddexp(own, below) - np.log(2.0)
    return both, np.exp(np.minimum(own - both - np.log(2.0), 0.0))


def _levels(grams: np.ndarray, n: np.ndarray):
    """The rows of depths DEPTH down to 2, and the order of the grams that the deepest ones have.

    A depth is (codes, counts, up): the distinct contexts, nearest byte first, each followed by the byte itself, in
    rising order, so the rows of a node stand together for every prefix of the byte; `up` is the row of the next depth.
    """
    byte = lambda k: (grams >> np.uint64(8 * k)) & np.uint64(255)  # k = 0: the byte itself; k: k bytes before it
    codes = byte(1)
    for k in (*range(2, DEPTH + 1), 0):
        codes = (codes << np.uint64(8)) | byte(k)
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    levels = {}
    for d in range(DEPTH, 2, -1):
        fewer, up = np.unique(((codes >> np.uint64(16)) << np.uint64(8)) | (codes & np.uint64(255)), return_inverse=True)
        levels[d] = codes, n, up.astype(np.int32)
        codes, n = fewer, np.bincount(up, weights=n)
    levels[2] = codes, n, None
    return levels, order


def _nodes(levels: dict, bit: int):
    """For one bit and each depth, deepest first: (node of each row, its first row, zeros, ones, mass, stop) as of _weigh."""
    found, mass, parent = {}, None, None
    for d in range(DEPTH, 1, -1):
        codes, n, up = levels[d]
        prefix = codes >> np.uint64(8 - bit)
        starts = np.ones(len(codes), bool)
        starts[1:] = prefix[1:] != prefix[:-1]
        node, first = (np.cumsum(starts) - 1).astype(np.int32), np.flatnonzero(starts)
        one = ((codes >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
        b = np.add.reduceat(np.where(one, n, 0.0), first)
        a = np.add.reduceat(n, first) - b
        below = None if parent is None else np.bincount(node[parent], weights=mass, minlength=len(first))
        mass, stop = _weigh(a, b, below)
        parent = None if up is None else up[first]
        found[d] = node, first, one, a, b, mass, stop
    return found


def _tops(key: tuple, rows: pa.Table) -> pa.Table:
    """For a nearest context byte and a prefix: the counts, and the summed log probability of depth 2."""
    levels, _ = _levels(np.asarray(rows.column("key")).astype(np.uint64), np.asarray(rows.column("n"), float))
    tops = []
    for bit in range(8):
        _, first, _, a, b, mass, _ = _nodes(levels, bit)[2]
        codes = levels[2][0][first].astype(np.int64)
        top, inverse = np.unique((codes >> 16) * 256 + ((1 << bit) | ((codes & 255) >> (8 - bit))), return_inverse=True)
        tops.append((top, *(np.bincount(inverse, weights=x) for x in (a, b, mass))))
    top, a, b, mass = (np.concatenate(x) for x in zip(*tops))
    return pa.table({"near": pa.array(top // 256), "prefix": pa.array(top % 256), "a": pa.array(a), "b": pa.array(b), "mass": pa.array(mass)})


def _subtrees(key: tuple, rows: pa.Table) -> pa.Table:
    """For a gram: `q`, the probability of each of its bits given that the mixture goes on to depth 2."""
    keys = np.asarray(rows.column("key"))
    levels, order = _levels(keys.astype(np.uint64), np.asarray(rows.column("n"), float))
    q = np.empty((len(order), 8))
    for bit in range(8):
        # From the nearest bytes outwards: what the mixture has gathered, and the share that goes on.
        found, had, left = _nodes(levels, bit), None, None
        for d in range(2, DEPTH + 1):
            node, _, one, a, b, _, stop = found[d]
            kt = (np.where(one, b[node], a[node]) + 0.5) / (a[node] + b[node] + 1.0)
            if d > 2:
                up = levels[d][2]
                had, left = had[up], left[up]
            else:
                had, left = np.zeros(len(node)), np.ones(len(node))
            had = had + left * stop[node] * kt
            left = left * (1.0 - stop[node])
        q[:, bit] = had
    codes = levels[DEPTH][0]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, q.size + 1, 8, dtype=np.int32)), pa.array(q.reshape(-1)))
    near, symbol = (codes >> np.uint64(8 * DEPTH)).astype(np.int64), (codes & np.uint64(255)).astype(np.int64)
    return pa.table({"key": pa.array(keys[order]), "near": pa.array(near), "symbol": pa.array(symbol), "q": lists})


def _crown(rows: pa.Table) -> pa.Table:
    """Depths 1 and 0, from at most 256 x 255 sums: for each nearest byte and bit, P = c0 + c1 * q."""
    near, prefix = np.asarray(rows.column("near")), np.asarray(rows.column("prefix"))
    a, b, below = (np.zeros((256, 256)) for _ in range(3))
    for grid, name in ((a, "a"), (b, "b"), (below, "mass")):
        grid[near, prefix] = np.asarray(rows.column(name), float)
    mass, stop1 = _weigh(a, b, below)
    _, stop0 = _weigh(a.sum(0), b.sum(0), mass.sum(0))
    kt = lambda a, b: np.stack([a + 0.5, b + 0.5], -1) / (a + b + 1.0)[..., None]
    c0 = stop0[:, None] * kt(a.sum(0), b.sum(0)) + ((1 - stop0) * stop1)[..., None] * kt(a, b)
    c1 = np.repeat(((1 - stop0) * (1 - stop1))[..., None], 2, -1)
    used = np.unique(near)
    return pa.table({"near": pa.array(used), "c0": pa.array(c0[used].reshape(len(used), -1).tolist()), "c1": pa.array(c1[used].reshape(len(used), -1).tolist())})


# ------------------------------------------------------------------ the plan


def score_documents(docs: DataFrame, held_out: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Scores of all documents by a model of those whose `held_out` is false.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (word model), score (log10 of the
    text's probability under the tree), n_bytes and bits_per_byte (code length; null for an empty text).
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    own = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"), whole_text(text).alias("text"))
    id_type = own.schema["doc_id"].dataType.simpleString()
    packed = stored(blocks.pack(own, BLOCK_BYTES), "blocks")
    asked = bucketed(packed.mapInArrow(_asked, "block long, key long, n long"), "key")
    sums = asked.groupBy("key").agg(F.sum("n").alias("n"))

    grams = sums.where(f"key between 0 and {_GRAMS - 1}").withColumn("part", F.expr(f"pmod(xxhash64(shiftright(key, 8) & 65535), {8 * parts})"))
    tree = grams.groupBy("part").applyInArrow(_subtrees, "key long, near long, symbol long, q array<double>")
    tops = grams.groupBy("part").applyInArrow(_tops, "near long, prefix long, a double, b double, mass double")
    tops = tops.groupBy("near", "prefix").agg(*[F.sum(c).alias(c) for c in ("a", "b", "mass")])
    crown = tops.groupBy(F.lit(0).alias("all")).applyInArrow(_crown, "near long, c0 array<double>, c1 array<double>")
    # At most 256 rows, whatever the corpus.
    joined = tree.join(F.broadcast(crown), "near")
    bits = [f"log10(c0[cast({2 << b} + (symbol >> {7 - b}) as int)] + c1[cast({2 << b} + (symbol >> {7 - b}) as int)] * q[{b}])" for b in range(8)]
    gram_values = joined.select("key", F.expr(" + ".join(bits)).alias("value"))
    counted = asked.where(f"key < 0 or key = {END}").groupBy("key").agg(F.sum("n").alias("n"))
    types = counted.where("n > 0").agg(F.count("*").cast("double").alias("value")).select(F.lit(TYPES).alias("key"), "value")
    # Words, the end and the number of tokens have their sums as value.
    values = sums.join(gram_values.union(types), "key", "left").select("key", F.coalesce("value", F.col("n").cast("double")).alias("value"))
    told = asked.select("block", "key").join(values.hint("merge"), "key")
    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    scored = packed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_scored, schema)
    return scored.withColumn("bits_per_byte", F.when(F.col("n_bytes") > 0, -F.col("score") * float(np.log2(10.0)) / F.col("n_bytes")))
