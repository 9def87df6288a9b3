"""Token ids as fixed-stride binary shards in training order.

1. One pass tokenises every text; a task's texts, each with END_OF_TEXT behind it, are one stream that is cut into sequences of LENGTH ids, so
   only a task's last sequence is padded. Blocks of compressed sequences with their task's number and their place in the task are
   the catalogue, written once. Adding up the tasks' counts numbers the sequences from 0 to N - 1.
2. A keyed Feistel network over the least a x a >= N, walked along its cycle until it is below N, is a bijection of
   [0, N): it gives every sequence its slot in training order, without a sort and without a table.
3. Slot // SHARD is a sequence's shard. What a task has for one shard travels as one compressed row, and each
   shard is one partition, which puts the records in their places and writes one file: records of one size, so slot s of a
   shard is at byte (s % SHARD) * STRIDE, and a reader can go on from any slot. A file is written beside its place
   and renamed, so a task that runs again does no harm. What an earlier run left below the same path is replaced or removed; the
   manifest goes first and comes back last, so a folder with a manifest is whole.

Record: LENGTH ids (uint16, little-endian). The order table has a row for each piece of a document in a slot: its offset in the record, its
document, part and number of ids; what no piece covers is padding (END_OF_TEXT). So shards are nothing but ids and can be mapped into memory.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, mix64, remove, shared_dir, trimmed
from .tokenizer import END_OF_TEXT, VOCABULARY, encoder

LENGTH, SHARD, KEY, ROUNDS = 256, 16384, 0x5DEECE66D, 6
STRIDE = 2 * LENGTH
#: Sequences of a block of the catalogue, bytes of ids that a task holds before it hands them on, and the strength of compression.
BLOCK, BUFFER, LEVEL = 2048, 32 << 20, 6


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slots of indexes in [0, n): a keyed bijection of [0, n)."""
    side = np.uint64(max(1, math.isqrt(max(0, n - 1)) + 1))
    rounds = [mix64(np.array([key + 0x1000193 * r], dtype=np.uint64))[0] for r in range(ROUNDS)]
    out = np.asarray(index, dtype=np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] // side, out[todo] % side
        for r in rounds:
            with np.errstate(over="ignore"):
                left, right = right, (left + mix64(right ^ r) % side) % side
        out[todo] = left * side + right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


_PIECES = "doc_ids array<long>, parts array<int>, starts array<int>, lengths array<int>"
_CATALOGUE = f"task int, place long, records int, {_PIECES}, ids binary"
_PART = f"shard int, slots array<int>, {_PIECES}, ids binary"
_KINDS = [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
_NAMES = ["doc_ids", "parts", "starts", "lengths"]


def _tokenise(vocabulary: str, length: int, records: int):
    """Blocks of a task's stream of ids: pieces of documents by their start and length in the block; parts counts a document's records so far."""
    end = np.uint16(END_OF_TEXT).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, place, pack = encoder(vocabulary).encode, TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=LEVEL).compress
        most, ids, size, pieces = 2 * length * records, [], 0, ([], [], [], [])

        def block(data: bytes) -> pa.RecordBatch:
            columns = [pa.array([task], pa.int32()), pa.array([place]), pa.array([len(data) // (2 * length)], pa.int32()), *(pa.array([x], k) for x, k in zip(pieces, _KINDS, strict=True)), pa.array([pack(data)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["task", "place", "records", *_NAMES, "ids"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for doc, text in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                    data, part = encode(text or "") + end, 0
                    while data:
                        room = most - size
                        taken, data = data[:room], data[room:]
                        for x, v in zip(pieces, (doc, part, size // 2, len(taken) // 2), strict=True):
                            x.append(v)
                        first = size // 2 // length
                        ids.append(taken)
                        size += len(taken)
                        part += (size // 2 - 1) // length - first + 1
                        if size == most:
                            yield block(b"".join(ids))
                            place += records
                            ids, size, pieces = [], 0, ([], [], [], [])
        if size:
            yield block(b"".join([*ids, end * (-(size // 2) % length)]))

    return run


def _segments(doc_ids, parts, starts, lengths, length: int) -> tuple[np.ndarray, ...]:
    """(record, offset, index into doc_ids, part, count) of a block's pieces, cut where records end."""
    starts, lengths = np.asarray(starts, np.int64), np.asarray(lengths, np.int64)
    n = (starts + lengths - 1) // length - starts // length + 1
    of = np.repeat(np.arange(len(starts)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    record = starts[of] // length + k
    first = np.maximum(starts[of], record * length)
    last = np.minimum(starts[of] + lengths[of], (record + 1) * length)
    return record, first - record * length, of, np.asarray(parts, np.int64)[of] + k, last - first


def _deal(first: np.ndarray, total: int, length: int, shard_size: int, key: int):
    """From blocks to one row for each shard, for at most BUFFER bytes of ids at a time; starts are now slot * length + offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack, held, size = zstandard.ZstdCompressor(level=LEVEL).compress, zstandard.ZstdDecompressor().decompress, {}, 0

        def flush() -> pa.RecordBatch:
            shards = sorted(held)
            join = lambda i: [np.concatenate([x[i] for x in held[s]]) for s in shards]
            slots = [np.concatenate([x[0] for x in held[s]]) for s in shards]
            lists = [[sum((x[1] for x in held[s]), []) for s in shards], *(join(i) for i in (2, 3, 4))]
            ids = [pack(b"".join(x[5] for x in held[s])) for s in shards]
            return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(slots, pa.list_(pa.int32())), *(pa.array(x, k) for x, k in zip(lists, _KINDS, strict=True)), pa.array(ids, pa.binary())], ["shard", "slots", *_NAMES, "ids"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                image = np.frombuffer(unpack(row["ids"]), np.uint16).reshape(-1, length)
                slots = permute(first[row["task"]] + row["place"] + np.arange(row["records"]), total, key)
                record, offset, of, part, count = _segments(row["doc_ids"], row["parts"], row["starts"], row["lengths"], length)
                docs = row["doc_ids"]
                order, shard = np.argsort(slots // shard_size, kind="stable"), slots // shard_size
                by, at = np.argsort(shard[record], kind="stable"), slots % shard_size
                cut = np.unique(shard)
                rows, segs = np.searchsorted(shard[order], cut), np.searchsorted(shard[record][by], cut)
                for s, a, b, c, d in zip(cut.tolist(), rows, [*rows[1:], None], segs, [*segs[1:], None], strict=True):
                    mine, seg = order[a:b], by[c:d]
                    held.setdefault(s, []).append((at[mine], [docs[j] for j in of[seg]], part[seg], at[record[seg]] * length + offset[seg], count[seg], image[mine].tobytes()))
                size += image.nbytes
                if size > BUFFER:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    return run


def _write(path: str, total: int, length: int, shard_size: int):
    """Of all parts of a shard: writes its file, and gives the order table back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, image, found, unpack = None, None, [], zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if shard is None:
                    shard = row["shard"]
                    image = np.full((min(total, (shard + 1) * shard_size) - shard * shard_size, length), END_OF_TEXT, np.uint16)
                assert shard == row["shard"], "a partition holds one shard"
                image[row["slots"]] = np.frombuffer(unpack(row["ids"]), np.uint16).reshape(-1, length)
                found.append(pa.table([pa.array(row[c], k.value_type) for c, k in zip(_NAMES, _KINDS, strict=True)], _NAMES))
        if shard is not None:
            _store(path, shard, image.tobytes())
            found = pa.concat_tables(found).sort_by("starts").combine_chunks()
            slot, offset = np.divmod(np.asarray(found["starts"], np.int64), length)
            columns = [pa.array(slot + shard * shard_size), pa.array(offset.astype(np.int32)), pa.array(np.full(len(slot), shard, np.int64)), *(found[c].combine_chunks() for c in ("doc_ids", "parts", "lengths"))]
            for batch in pa.table(columns, ["slot", "offset", "shard", "doc_id", "part", "n_tokens"]).to_batches(max_chunksize=50_000):
                yield batch

    return run


def _store(path: str, shard: int, data: bytes) -> None:
    fs, root = pa.fs.FileSystem.from_uri(path)
    name = f"{root}/shard-{shard:08d}.bin"
    beside = f"{root}/.shard-{shard:08d}-{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(beside) as out:
        out.write(data)
    fs.move(beside, name)


def _clear(path: str, shards: int) -> None:
    """Makes the folder, and takes away an earlier run's manifest, shards beyond the number of shards, and files that were never renamed."""
    fs, root = pa.fs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    for info in fs.get_file_info(pa.fs.FileSelector(root)):
        if info.base_name == "manifest" and not info.is_file:
            fs.delete_dir(info.path)
        beyond = re.fullmatch(r"shard-(\d+)\.bin", info.base_name)
        if re.fullmatch(r"\.shard-\d+-\d+", info.base_name) or (beyond and int(beyond[1]) >= shards):
            fs.delete_file(info.path)


def write_shards(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, length: int = LENGTH, shard_size: int = SHARD, key: int = KEY) -> DataFrame:
    """Writes shards and manifest below path and returns the order table: slot, offset, shard, doc_id, part, n_tokens.

    path is a folder that all executors reach; without a scheme it is one of the default file system. Every text gives at least one
    piece; null and empty texts give END_OF_TEXT alone. Repeated rows are written as often as they come; a null id stays null in the order table, ids must be
    integers or read as such. An empty table gives a manifest without shards. Other columns are ignored.
    """
    spark = docs.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    path = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    catalogue = materialise(rows.mapInArrow(trimmed(_tokenise(vocabulary, length, BLOCK)), _CATALOGUE), "catalogue", scratch := shared_dir(spark, "token-output"))
    counts = sorted((r.task, r.n) for r in catalogue.groupBy("task").agg(F.sum("records").alias("n")).collect())  # one row a task
    total = sum(n for _, n in counts)
    first = np.zeros(counts[-1][0] + 1 if counts else 1, np.int64)
    for (task, _), start in zip(counts, np.cumsum([0, *[n for _, n in counts]]), strict=False):
        first[task] = start
    spec = {"records": total, "record_bytes": 2 * length, "ids_per_record": length, "records_per_shard": shard_size, "key": key, "end_of_text": END_OF_TEXT}
    shards = max(1, -(-total // shard_size))
    _clear(path, -(-total // shard_size))
    dealt = catalogue.mapInArrow(trimmed(_deal(first, total, length, shard_size, key)), _PART).repartitionById(shards, "shard")
    order = dealt.mapInArrow(trimmed(_write(path, total, length, shard_size)), "slot long, offset int, shard long, doc_id long, part int, n_tokens int")
    order = materialise(order, "order")
    spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    remove(spark, scratch)
    return order


def read_shard(data: bytes, length: int = LENGTH, start: int = 0) -> np.ndarray:
    """A shard's records (rows of length ids) from record start on."""
    return np.frombuffer(data, np.uint16, offset=start * 2 * length).reshape(-1, length)


def new_output(spark: SparkSession) -> str:
    return shared_dir(spark, "tokens")
