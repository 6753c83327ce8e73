"""SentencePiece encoding and decoding, with giant documents cut into chunks that are encoded independently.

A text of up to CHUNK characters is encoded in the task that reads it. A longer one becomes chunks of about CHUNK
characters, dealt over all tasks, and is put together again from their pieces.

Unigram models take the segmentation with the largest sum of scores. Here a chunk is a matrix over its boundary
states (how far a piece reaches over the chunk's start, and over its end) of the best score between the two, in
the max-plus semiring. Matrices are combined associatively, block by block as in a parallel scan, which fixes the
state at every boundary of the best path; then each chunk is traced back alone from its two states.

Byte-pair models (the public one at hand is such a model) do not maximise a sum: they merge by rank, and the best
sum is another segmentation for most texts. Their chunks are cut where no piece can reach across, before a single
blank between two other characters; a boundary has one state, so no matrices are needed, and the pieces of the chunks
follow each other. Where no such place comes up for long, the chunk grows: whole words are never cut.

Defined cases: a null text counts as empty and has no pieces. Characters outside the vocabulary become bytes if the
model has byte pieces, else the unknown piece. Decoding restores the text except where the model's own
normalisation changes it (the mark U+2581 becomes a blank). Repeated rows are encoded alike. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procmon.llm.common import partitions, whole_text
from procmon.llm.ngrams import short_batches, slices

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters from which a text is cut.
CHUNK = 1 << 15
BLANK = "▁"
_UNKNOWN_PENALTY = 10.0


class Pieces:
    """A model in a worker: ids, scores and bytes of its pieces."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        spec = sentencepiece_model_pb2.ModelProto.FromString(proto)
        self.unigram = spec.trainer_spec.model_type == spec.trainer_spec.UNIGRAM
        self.prefix = spec.normalizer_spec.add_dummy_prefix
        kinds = type(spec.pieces[0]) if spec.pieces else None
        self.scores, self.bytes, self.table = {}, {}, []
        for i, p in enumerate(spec.pieces):
            if kinds and p.type == kinds.BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.table.append(bytes([int(p.piece[3:5], 16)]))
            elif kinds and p.type == kinds.CONTROL:
                self.table.append(b"")
            elif kinds and p.type == kinds.UNKNOWN:
                self.table.append(spec.trainer_spec.unk_surface.encode())
            else:
                if self.unigram:
                    self.scores[p.piece] = (p.score, i)
                self.table.append(p.piece.replace(BLANK, " ").encode())
        self.longest = max(map(len, self.scores), default=1)
        self.least = min((s for s, _ in self.scores.values()), default=0.0) - _UNKNOWN_PENALTY

    # -- whole texts

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []

    def decode(self, ids) -> str:
        """Pieces side by side; the blank that encoding put in front goes."""
        data = b"".join(map(self.table.__getitem__, ids))
        if self.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")

    def digest(self, ids) -> str:
        """SHA-256 of the text that the ids decode to."""
        return hashlib.sha256(self.decode(ids).encode()).hexdigest()

    # -- unigram chunks; a chunk is (its characters and those a piece may reach into, its own length)

    def normalised(self, text: str) -> str:
        text = self.model.normalize(text)
        return text

    def steps(self, text: str, start: int) -> list[tuple[int, float, int | None]]:
        """Pieces that can start at `start`: (length, score, id); the id is None for an unknown character."""
        found = []
        for n in range(1, min(self.longest, len(text) - start) + 1):
            hit = self.scores.get(text[start : start + n])
            if hit:
                found.append((n, *hit))
        if not found or found[0][0] > 1:
            found.append((1, self.least, None))
        return found

    def matrix(self, text: str, own: int) -> np.ndarray:
        """Best score from each entry state to each exit state."""
        width = self.longest
        best = np.full((width, own + width), -np.inf)
        best[np.arange(width), np.arange(width)] = 0.0  # entry state a: the first piece starts at a
        for i in range(own):
            for n, score, _ in self.steps(text, i):
                np.maximum(best[:, i + n], best[:, i] + score, out=best[:, i + n])
        return best[:, own : own + width]

    def trace(self, text: str, own: int, entry: int, leave: int) -> list[int]:
        """The pieces that start in the chunk, on the best path between two states."""
        best = np.full(own + self.longest, -np.inf)
        best[entry] = 0.0
        back: dict[int, tuple[int, int | None]] = {}
        for i in range(entry, own):
            if best[i] == -np.inf:
                continue
            for n, score, piece in self.steps(text, i):
                if best[i] + score > best[i + n]:
                    best[i + n] = best[i] + score
                    back[i + n] = (n, piece)
        ids, at = [], own + leave
        while at > entry:
            n, piece = back[at]
            if piece is None:
                coded = [self.bytes.get(b) for b in text[at - n : at].encode()]
                ids += [self.model.unk_id()] if None in coded else coded[::-1]
            else:
                ids.append(piece)
            at -= n
        return ids[::-1]


def plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two matrices in the max-plus semiring."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def boundary_states(matrices: list[np.ndarray]) -> list[int]:
    """State at the start of each chunk and at the end, on the best path from 0 to 0.

    The products of all leading chunks come from an inclusive scan that doubles its reach in each round.
    """
    scan, reach = list(matrices), 1
    while reach < len(scan):
        scan = [plus(scan[i - reach], m) if i >= reach else m for i, m in enumerate(scan)]
        reach *= 2
    states = [0] * (len(matrices) + 1)
    for i in range(len(matrices) - 1, 0, -1):
        states[i] = int((scan[i - 1][0] + matrices[i][:, states[i + 1]]).argmax())
    return states


@lru_cache(maxsize=4)
def _pieces(proto: bytes) -> Pieces:
    return Pieces(proto)


def model_bytes(path: str = MODEL_FILE) -> bytes:
    """The model as a byte string, read by the driver; executors get it with their tasks."""
    with open(path, "rb") as file:
        return file.read()


def cuts(text: str, chunk: int = CHUNK) -> list[str]:
    """Chunks of a text for a byte-pair model; the blanks at the cuts are left out, each encoding brings one."""
    out, start = [], 0
    while len(text) - start > chunk:
        at = text.find(" ", start + chunk)
        while at != -1 and (at + 1 >= len(text) or text[at - 1] in f" {BLANK}" or text[at + 1] in f" {BLANK}"):
            at = text.find(" ", at + 1)
        if at == -1:
            break
        out.append(text[start:at])
        start = at + 1
    return [*out, text[start:]]


def encode(
    docs: DataFrame, proto: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK, digest: str | None = None
) -> DataFrame:
    """The kept columns with `ids`; `digest` names a further column with the SHA-256 of the text that the ids decode to."""
    unigram = _pieces(proto).unigram
    spark: SparkSession = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(proto)
    names = [f"_k{i}" for i in range(len(keep))]
    own = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], whole_text(text).alias("_text"))
    fields = ", ".join(f"{n} {own.schema[n].dataType.simpleString()}" for n in names)

    def whole(rows):
        pieces = _pieces(shared.value)
        for batch in rows:
            for low, part in slices_of(batch.column("_text"), 1 << 18):
                ids = pieces.encode(part)
                told = [pa.array(list(map(pieces.digest, ids)), pa.string())] if digest else []
                own = [c.slice(low, len(part)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(ids, pa.list_(pa.int32())), *told], [*names, "ids", *["_digest"] * len(told)])

    def digests(rows):
        pieces = _pieces(shared.value)
        for batch in rows:
            for i in range(batch.num_rows):
                told = pa.array([pieces.digest(batch.column("ids")[i].values.to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns), told], [*batch.schema.names, "_digest"])

    def split(rows):
        pieces = _pieces(shared.value)
        for batch in rows:
            for row, value in enumerate(batch.column("_text").to_pylist()):
                if pieces.unigram:
                    value, reach = pieces.normalised(value), pieces.longest
                    parts = [(value[i : i + chunk + reach], min(chunk, len(value) - i)) for i in range(0, len(value), chunk)]
                else:
                    parts = [(c, len(c)) for c in cuts(value, chunk)]
                at = batch.column("_row")[row].as_py()
                yield pa.RecordBatch.from_pydict(
                    {"_row": pa.array([at] * len(parts), pa.string()), "no": range(len(parts)), "part": pa.array([p for p, _ in parts], pa.string()), "own": [n for _, n in parts]}
                )

    def matrices(rows):
        pieces = _pieces(shared.value)
        for batch in rows:
            found = [pieces.matrix(p, n).tobytes() for p, n in zip(batch.column("part").to_pylist(), batch.column("own").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("no"), pa.array(found, pa.binary())], ["_row", "no", "matrix"])

    def states(rows):
        width = _pieces(shared.value).longest
        for batch in rows:
            for row, of in enumerate(batch.column("chunks").to_pylist()):
                at = boundary_states([np.frombuffer(c["matrix"]).reshape(width, width) for c in of])
                yield pa.RecordBatch.from_pydict({
                    "_row": pa.array([batch.column("_row")[row].as_py()] * len(of), pa.string()), "no": [c["no"] for c in of], "entry": at[:-1], "leave": at[1:],
                })

    def traced(rows):
        pieces = _pieces(shared.value)
        for batch in rows:
            if pieces.unigram:
                columns = [batch.column(c).to_pylist() for c in ("part", "own", "entry", "leave")]
                ids = [pieces.trace(*c) for c in zip(*columns)]
            else:
                ids = pieces.encode(batch.column("part").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("no"), pa.array(ids, pa.list_(pa.int32()))], ["_row", "no", "ids"])

    coded = "ids array<int>, _digest string" if digest else "ids array<int>"
    short = own.where(F.length("_text") <= chunk).mapInArrow(whole, f"{fields}, {coded}")
    # Giant texts: equal ones are encoded once, under the digest of the text.
    giant = own.where(F.length("_text") > chunk).withColumn("_row", F.sha2(F.col("_text").cast("binary"), 256))
    n = partitions(spark)
    chunks = giant.dropDuplicates(["_row"]).select("_row", "_text").mapInArrow(split, "_row string, no long, part string, own long").repartition(n, "_row", "no")
    if unigram:
        solved = chunks.mapInArrow(matrices, "_row string, no long, matrix binary").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("no", "matrix"))).alias("chunks"))
        chunks = chunks.join(solved.mapInArrow(states, "_row string, no long, entry long, leave long"), ["_row", "no"])
    # A boundary of a byte-pair model has one state: its chunks need no matrices.
    parts = chunks.mapInArrow(traced, "_row string, no long, ids array<int>").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("no", "ids"))).alias("p"))
    found = parts.select("_row", F.flatten("p.ids").alias("ids"))
    if digest:
        found = found.mapInArrow(digests, f"_row string, {coded}")
    long = giant.select(*names, "_row").join(found, "_row").drop("_row")
    return short.unionByName(long).withColumnsRenamed(dict(zip(names, keep)) | ({"_digest": digest} if digest else {}))


def slices_of(texts: pa.Array, limit: int):
    """(number of the first, texts) in lists of about `limit` characters; a longer text comes alone."""
    low = 0
    for part in slices(texts.to_pylist(), limit):
        yield low, part
        low += len(part)


def decode(coded: DataFrame, proto: bytes, ids: str = "ids", out: str = "text") -> DataFrame:
    """`coded` with the text of its ids in the column `out`; null ids give a null text."""
    short_batches(coded.sparkSession)
    shared = coded.sparkSession.sparkContext.broadcast(proto)

    @F.pandas_udf("string")
    def decoded(lists):
        pieces = _pieces(shared.value)
        return lists.map(lambda x: None if x is None else pieces.decode(x.tolist()))

    return coded.withColumn(out, decoded(F.col(ids)))
