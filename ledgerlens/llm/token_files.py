"""Token-ID output (operator 10): one concatenated id array a segment, with
Elias-Fano encoded document boundaries.

Documents are sorted by id over range partitions; each partition writes its
segments in order. A segment holds the ids of its documents one after another,
in 2 bytes each if every id fits and in 4 otherwise, and the document ends as
an Elias-Fano code: the low bits packed, the high bits in unary, and a sample
of the positions of every 256th one for ``select``, which the readers use. That
takes about 2 + log2(ids / documents) bits a document. Segments are rows of a Parquet table,
so that any store that Spark reads can hold them.

Edge cases: a null text is empty and gets the end id only. Null ids come
first; equal ids are ordered by a hash of the text. An empty table gives no
segments and an empty result. Other columns are ignored."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path
from .common import one_array, regrouped, table
from .pieces import encoder

SEGMENT_BYTES = 8 << 20
SAMPLE = 256


class EliasFano:
    """Non-decreasing numbers below ``top + 1`` in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, int(np.floor(np.log2(top / n)))) if n and top > n else 0
        low = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).reshape(-1)
        ones = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, low_bits, np.packbits(low, bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        return (((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def select(self, i: int) -> int:
        """The i-th number, from the nearest sample on."""
        start, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = start >> 3, start & 7
        word = int(self.high[byte]) >> skip << skip
        while True:
            ones = word.bit_count()
            if left < ones:
                for bit in range(8):
                    if word >> bit & 1:
                        if left == 0:
                            return ((byte * 8 + bit - i) << self.low_bits) | int(self._low(np.array([i]))[0])
                        left -= 1
            left -= ones
            byte += 1
            word = int(self.high[byte])

    def select_many(self, i: np.ndarray) -> np.ndarray:
        """The numbers at the places ``i``; only the high bits between the samples around them are read."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.int64)
        stretch, which = np.unique(i // SAMPLE, return_inverse=True)
        begin = self.samples[stretch].astype(np.int64)
        n = np.append(self.samples, 8 * len(self.high)).astype(np.int64)[stretch + 1] - begin
        bits = np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)
        ones = bits[(self.high[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1]
        # every stretch has SAMPLE ones, but the last of all
        return ((ones[which * SAMPLE + i % SAMPLE] - i) << self.low_bits) | self._low(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        return ((ones - np.arange(self.n)) << self.low_bits) | self._low(np.arange(self.n))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)], "<u4")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> "EliasFano":
        n, low_bits, a, b, _ = (int(x) for x in np.frombuffer(raw, "<u4", 5))
        body = np.frombuffer(raw, np.uint8, offset=20)
        return cls(n, low_bits, body[:a], body[a:a + b], np.frombuffer(body[a + b:].tobytes(), "<u4"))


SEGMENT = "part int, segment int, start_in_part long, n_ids long, id_bytes int, doc_ids {}, ends binary, ids binary"


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
                      segment_bytes: int = SEGMENT_BYTES) -> None:
    """Encode every text, end it with ``end_id`` and write the segments to
    ``path`` in ascending order of id."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]

    def segments(batches):
        enc = encoder(shared.value)
        part, segment, start = TaskContext.get().partitionId(), 0, 0
        for rows in regrouped(batches, "text", segment_bytes):
            n, ids = enc.documents(one_array(rows["text"]), with_ids=True)
            ends = np.cumsum(n + 1)
            out = np.full(int(ends[-1]), end_id, np.uint32)
            keep = np.ones(len(out), bool)
            keep[ends - 1] = False
            out[keep] = ids
            width = 2 if out.max() < 1 << 16 else 4
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([start], pa.int64()), pa.array([len(out)], pa.int64()),
                 pa.array([width], pa.int32()), pa.array([one_array(rows["doc_id"])], pa.list_(rows.schema.field("doc_id").type)),
                 pa.array([EliasFano.encode(ends).to_bytes()], pa.binary()), pa.array([out.astype(f"<u{width}").tobytes()], pa.binary())],
                ["part", "segment", "start_in_part", "n_ids", "id_bytes", "doc_ids", "ends", "ids"])
            segment, start = segment + 1, start + len(out)

    kind = rows.schema["doc_id"].dataType.simpleString()
    (rows.repartitionByRange(*order).sortWithinPartitions(*order)
     .mapInArrow(segments, SEGMENT.format(f"array<{kind}>")).write.option("compression", "zstd").parquet(path))


def read_token_files(spark, path: str) -> DataFrame:
    """The index of the written files: doc_id, start (ids of all documents
    before it), n_tokens and the unsigned crc32 of its ids as 4-byte words."""
    files = spark.read.parquet(path)
    # a row a partition, not a segment
    parts = (files.groupBy("part").agg(F.sum("n_ids").alias("n"))
             .select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start")))
    rows = files.join(F.broadcast(parts), "part").select((F.col("part_start") + F.col("start_in_part")).alias("start"), "id_bytes", "doc_ids", "ends", "ids")

    def index(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                start, width = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                code = EliasFano.from_bytes(batch.column(3)[k].as_py())
                ends = code.select_many(np.arange(code.n))
                ids = np.frombuffer(batch.column(4)[k].as_buffer(), f"<u{width}").astype("<u4")
                begins = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2)[k].values, pa.array(begins + start, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    return rows.mapInArrow(index, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_documents(spark, path: str, numbers: list[int]) -> DataFrame:
    """The documents of the given numbers, counted from 0 in the order of the
    files: number, doc_id and ids. Of a segment only these documents' ends are
    decoded; numbers that the files don't have give no row."""
    files = spark.read.parquet(path)
    sizes = files.select("part", "segment", F.size("doc_ids").cast("long").alias("n"))
    # a row a partition, not a segment
    parts = (sizes.groupBy("part").agg(F.sum("n").alias("of_part"))
             .select("part", (F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")).alias("before")))
    first = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("segment")) - F.col("n")
    index = sizes.join(F.broadcast(parts), "part").select("part", "segment", "n", first.alias("first"))
    asked = spark.createDataFrame([(int(k),) for k in sorted(set(numbers))], "number long")
    wanted = (index.join(F.broadcast(asked), (F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("n")))
              .groupBy("part", "segment", "first").agg(F.array_sort(F.collect_list("number")).alias("numbers")))
    rows = files.join(wanted, ["part", "segment"]).select("first", "numbers", "id_bytes", "doc_ids", "ends", "ids")

    def chosen(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                first, width = batch.column(0)[k].as_py(), batch.column(2)[k].as_py()
                numbers = batch.column(1)[k].values.to_numpy()
                at = numbers - first
                code = EliasFano.from_bytes(batch.column(4)[k].as_py())
                ends, begins = code.select_many(at), np.where(at > 0, code.select_many(np.maximum(at - 1, 0)), 0)
                ids = np.frombuffer(batch.column(5)[k].as_buffer(), f"<u{width}")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers, pa.int64()), batch.column(3)[k].values.take(pa.array(at)), pa.array([ids[a:b].astype(np.int32) for a, b in zip(begins, ends)], pa.list_(pa.int32()))],
                    ["number", "doc_id", "ids"])

    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    return rows.mapInArrow(chosen, f"number long, doc_id {kind}, ids array<int>")


def op10_token_files(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "llm-tables", f"token-files-{uuid.uuid4().hex}")
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_token_files(spark, path)
