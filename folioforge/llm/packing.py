"""Problem 8: filling containers of fixed capacity with texts.

Method: space-filling-curve order. A text's tokens are hashed to signs in few
dimensions and averaged; the point's cell on a Hilbert curve is its key. Documents
are range-sorted by key and neighbours along the curve are packed together, in short
windows: each, largest text first, goes to the open container it fits best. A container
is closed when the curve has gone on ``reach`` windows from the one that opened it, so
that what lies in it stood near together. ``locality`` measures how near.

Only a text above the capacity is cut, into pieces of the capacity and a rest.

Scale: each text is read and tokenised once; what is sorted is (key, id, tokens). A
range partition packs its stretch of the curve alone, in windows, with the open
containers as its only state, and leaves its last containers part full: a fixed loss
for each ``rows_per_task`` texts. Range bounds include the id, so texts of equal
vectors are spread too.

Defined results: null and empty texts have no tokens and take a place of size 0;
rows with a null id are no documents; repeated rows count once, and of several texts
under one id the one with the most tokens counts. Empty tables give no containers.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.tokens import VOCABULARY, tokenizer
from folioforge.plans.lineage import cut
from folioforge.sources.tables import table

DIMS, BITS, BUCKETS = 4, 8, 4096


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (n, dims), 0 <= cell < 2^bits."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # undo the rotations from the top level down
        side, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            flip = (x[d] & side) != 0
            swap = np.where(flip, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    t = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        t = np.where(x[dims - 1] & (1 << level), t ^ ((1 << level) - 1), t)
    x ^= t
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> level) & 1)
    return key


def _signs(seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (BUCKETS, DIMS))


def _placed(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    encode, signs = tokenizer(vocabulary).encode_ordinary, _signs()
    for batch in batches:
        if not batch.num_rows:
            continue
        counts, points = [], np.zeros((batch.num_rows, DIMS))
        for i, text in enumerate(batch.column("text").to_pylist()):
            tokens = np.array(encode(text), np.int64) if text else np.empty(0, np.int64)
            counts.append(len(tokens))
            if len(tokens):
                kinds = np.unique(tokens)
                points[i] = signs[(kinds * 2654435761 >> 7) % BUCKETS].sum(axis=0) / len(kinds) ** 0.5
        # each dimension is about standard normal: a logistic of it is about even
        cells = np.minimum((2**BITS / (1 + np.exp(-1.702 * points))).astype(np.int64), 2**BITS - 1)
        yield pa.record_batch(
            [batch.column("id"), pa.array(counts, pa.int64()), pa.array(hilbert_keys(cells, BITS))], names=["id", "tokens", "key"]
        )


class Packer:
    """Open containers of one stretch of the curve; none takes texts of more than
    ``reach`` windows after the one that opened it."""

    def __init__(self, capacity: int, part: int, reach: int) -> None:
        self.capacity, self.next, self.reach, self.now = capacity, part << 32, reach, 0
        self.free: list[tuple[int, int]] = []  # (room, container), sorted
        self.places: dict[int, int] = {}
        self.opened: dict[int, int] = {}

    def put(self, size: int) -> tuple[int, int]:
        """(container, place in it) for a text: best fit, else a new container."""
        i = bisect_left(self.free, (size, -1))
        if i < len(self.free):
            room, box = self.free.pop(i)
        else:
            room, box, self.next = self.capacity, self.next, self.next + 1
            self.opened[box] = self.now
        place = self.places.get(box, 0)
        if room > size:
            insort(self.free, (room - size, box))
            self.places[box] = place + 1
        else:
            self.places.pop(box, None)
            del self.opened[box]
        return box, place

    def window(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        boxes, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int32)
        for i in np.argsort(-sizes, kind="stable"):
            boxes[i], places[i] = self.put(int(sizes[i]))
        self.now += 1
        late = {b for b, at in self.opened.items() if self.now - at > self.reach}
        if late:
            self.free = [x for x in self.free if x[1] not in late]
            for box in late:
                self.places.pop(box, None)
                del self.opened[box]
        return boxes, places


def _packed(batches: Iterator[pa.RecordBatch], capacity: int, window: int, reach: int) -> Iterator[pa.RecordBatch]:
    packer = Packer(capacity, TaskContext.get().partitionId(), reach)
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            boxes, places = packer.window(t["tokens"].to_numpy())
            t = t.append_column("container", pa.array(boxes)).append_column("place", pa.array(places))
            yield from t.select(["container", "place", "id", "piece", "start", "tokens", "key"]).to_batches()

    for batch in batches:
        while batch.num_rows:
            take = min(batch.num_rows, window - sum(b.num_rows for b in held))
            held.append(batch.slice(0, take))
            batch = batch.slice(take)
            if sum(b.num_rows for b in held) >= window:
                yield from flush()
    yield from flush()


def pack(documents: DataFrame, capacity: int = 2048, *, vocabulary: str = VOCABULARY, window: int = 32, reach: int = 8, rows_per_task: int = 100_000) -> DataFrame:
    """(container, place, id, piece, start, tokens, key) for documents (id bigint, text
    string): which tokens of which document lie in which container, in order; key is the
    document's place on the curve. A window's texts may be kept apart by at most
    ``window * reach`` texts of the curve from others of their container."""
    placed = documents.select("id", "text").where("id is not null").mapInArrow(lambda it: _placed(it, vocabulary), "id bigint, tokens bigint, key bigint")
    placed = cut(placed.groupBy("id").agg(F.max(F.struct("tokens", "key")).alias("x")).select("id", "x.*"))
    pieces = placed.select("key", "id", "tokens", F.explode(F.expr(f"sequence(0, greatest(0, cast((tokens - 1) div {capacity} as int)))")).alias("piece"))
    items = pieces.select(
        "key", "id", "piece", (F.col("piece") * F.lit(capacity).cast("bigint")).alias("start"),
        F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - F.col("piece") * capacity).alias("tokens"),
    )
    tasks = max(1, -(-placed.count() // rows_per_task))
    ordered = items.repartitionByRange(tasks, "key", "id", "piece").sortWithinPartitions("key", "id", "piece")
    schema = "container bigint, place int, id bigint, piece int, start bigint, tokens bigint, key bigint"
    return ordered.mapInArrow(lambda it: _packed(it, capacity, window, reach), schema)


def fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(containers, tokens, fill, least): containers used, their tokens, the share of
    room used, and the least number of containers that could hold the tokens."""
    used = packed.agg(F.count_distinct("container").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return used.select(
        "containers", "tokens", F.try_divide("tokens", F.col("containers") * capacity).alias("fill"),
        F.ceil(F.col("tokens") / capacity).alias("least"),
    )


def locality(packed: DataFrame) -> DataFrame:
    """(spread, random): the mean stretch of the curve, as a share of all documents, from
    a container's first document to its last, and what it would be if the documents of
    every container were drawn at random."""
    steps = 1000
    cuts = packed.agg(F.percentile_approx("key", [i / steps for i in range(steps + 1)], 10_000).alias("cuts"))
    part = packed.groupBy("container").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count_distinct("id").alias("n")).where("n > 1")
    at = lambda c: F.expr(f"size(filter(cuts, x -> x < {c})) / {steps + 1}.0D")
    apart = part.crossJoin(F.broadcast(cuts)).select((at("b") - at("a")).alias("s"), ((F.col("n") - 1) / (F.col("n") + 1)).alias("r"))  # cuts is one row
    return apart.agg(F.avg("s").alias("spread"), F.avg("r").alias("random"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in containers of 2,048 tokens."""
    return pack(_documents(spark, folder)).drop("key").withColumnsRenamed({"id": "doc_id", "start": "token_start"})


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are, and how near together on the curve their texts."""
    packed = cut(pack(_documents(spark, folder)))
    return fill(packed).join(F.broadcast(locality(packed)))  # two frames of one row


QUERIES = {"p8_pack": p8_pack, "p8_fill": p8_fill}
SQL: dict[str, str] = {}
