"""Document blocks and packed messages between blocks and key buckets.

A *block* holds the whole rows of the documents whose id hashes to it, Arrow-packed and
zstd-compressed, about ``BLOCK_BYTES`` of text each; their number follows the input. Operators send
packed numpy arrays from blocks to *key buckets* (hash ranges of keys) and back, so keys are
pre-aggregated in the block before any shuffle and a key that occurs in a third of all rows costs
one entry per block, not one per row. All exchanges are Spark's (``groupBy().applyInArrow`` and
``cogroup``); the block exchange of one query is planned once and reused by its later steps.

Where n destinations are more than ``DIRECT``, messages travel in two hops (``relayed``): a sender writes one
bundle for each of about sqrt(n) groups of destinations, and a relay turns the bundles of many senders into one row per
destination. Blocks x buckets rows become about 2 n sqrt(n), and the rows for one hot destination come through
sqrt(n) relays. An exchange has ``PARTITIONS`` partitions at most; a partition then takes its blocks or
buckets one after the other, so the memory of a task stays that of one.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 6 << 20
MESSAGE = "dest int, src int, blob binary"
DIRECT = 1 << 10      # destinations that senders write to one by one
PARTITIONS = 1 << 15  # of one exchange, at most
RELAYED = -2          # as src: the blob holds messages of many senders


def block_count(docs: DataFrame, text: str = "text", block_bytes: int | None = None) -> int:
    """Number of blocks for the table: its text bytes over the block size (one narrow scan)."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(1, -(-int(total) // (block_bytes or BLOCK_BYTES)))


def bucket_count(n_blocks: int, share: int = 2) -> int:
    return max(1, -(-n_blocks // share))


def to_blocks(docs: DataFrame, n_blocks: int, columns: list[str], by: str = "doc_id") -> DataFrame:
    """Rows (b, blob): ``columns`` of the documents, packed by block. A null id hashes like any value."""
    rows = docs.select(F.pmod(F.xxhash64(F.col(by)), F.lit(n_blocks)).cast("int").alias("b"), *[F.col(c) for c in columns])
    return _dealt(rows.mapInArrow(_pack, "b int, blob binary"), n_blocks, "b")


def _dealt(rows: DataFrame, n: int, by: str) -> DataFrame:
    return rows.repartition(min(n, PARTITIONS), by)


def _packed(rows: pa.RecordBatch | pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(blobs: pa.ChunkedArray | pa.Array) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_py()).read_all() for x in blobs]).combine_chunks()


def _by_first(rows: pa.RecordBatch | pa.Table, keys: np.ndarray) -> Iterator[tuple[int, pa.RecordBatch | pa.Table]]:
    """(key, its rows) in ascending keys."""
    order = np.argsort(keys, kind="stable")
    rows, keys = rows.take(pa.array(order)), keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    for lo, hi in zip(at.tolist(), np.append(at[1:], len(keys)).tolist()):
        yield int(keys[lo]), rows.slice(lo, hi - lo)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        b = batch.column(0).to_numpy(zero_copy_only=False)
        ids, blobs = zip(*[(i, _packed(own)) for i, own in _by_first(batch.select(batch.schema.names[1:]), b)])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["b", "blob"])


def unpack_docs(table: pa.Table) -> pa.Table | None:
    """The documents of one block, in an order that depends on the rows alone."""
    if not table.num_rows:
        return None
    whole = _unpacked(table.column("blob"))
    keys = [(c, "ascending") for c in whole.schema.names if pa.types.is_integer(whole.schema.field(c).type)]
    keys += [(c, "ascending") for c in whole.schema.names if pa.types.is_string(whole.schema.field(c).type)]
    return whole.take(pc.sort_indices(whole, sort_keys=keys))


def doc_ids(docs: pa.Table, name: str = "doc_id") -> np.ndarray:
    """Ids as int64; a null id compares as larger than every id."""
    return pc.fill_null(docs.column(name), np.iinfo(np.int64).max).to_numpy()


def texts(docs: pa.Table, name: str = "text") -> list[bytes]:
    """Texts as UTF-8 bytes; null is the empty text."""
    return [x or b"" for x in docs.column(name).cast(pa.binary()).to_pylist()]


def dump(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes, compressed: sorted or small values shrink to their information."""
    head, body = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(f"{a.dtype.str},{len(a)}")
        body.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"")
    raw = ";".join(head).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(raw).to_bytes(4, "little") + raw + b"".join(body))


def load(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, []
    for part in raw[4:4 + n].decode().split(";"):
        kind, size = part.split(",")
        kind, size = np.dtype(kind), int(size)
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(size))
        at += size * kind.itemsize
    return out


def message(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({
        "dest": pa.array([r[0] for r in rows], pa.int32()),
        "src": pa.array([r[1] for r in rows], pa.int32()),
        "blob": pa.array([r[2] for r in rows], pa.binary()),
    })


def received(table: pa.Table) -> list[tuple[int, bytes]]:
    """(src, blob) by sender: neither the order of arrival nor the way matters."""
    if table.num_rows and table.column("src")[0].as_py() == RELAYED:  # then all are
        table = _unpacked(table.column("blob"))
    return sorted(zip(table.column("src").to_pylist(), table.column("blob").to_pylist()))


def relayed(messages: DataFrame, n: int) -> DataFrame:
    """Messages to ``n`` destinations, bundled and sent through relays where the destinations are many."""
    if n <= DIRECT:
        return messages
    side = math.isqrt(n - 1) + 1

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = TaskContext.get().partitionId() % side
        for batch in batches:
            if batch.num_rows:
                group = batch.column(0).to_numpy(zero_copy_only=False) // side
                yield from message([(g * side + sender, RELAYED, _packed(own)) for g, own in _by_first(batch, group)]).to_batches()

    def pass_on(table: pa.Table) -> pa.Table:
        whole = _unpacked(table.column("blob"))
        return _trimmed(message([(d, RELAYED, _packed(own)) for d, own in _by_first(whole, whole.column("dest").to_numpy())]))

    return _dealt(messages.mapInArrow(bundle, MESSAGE), side * side, "dest").groupBy("dest").applyInArrow(pass_on, MESSAGE)


def _arriving(messages: DataFrame, n: int) -> DataFrame:
    """Rows at their destinations; rows that are no messages (one a destination) need no relay."""
    rows = relayed(messages, n) if messages.columns == ["dest", "src", "blob"] else messages
    return _dealt(rows, n, "dest")


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of 64-bit keys, in ascending order with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def slices(sorted_buckets: np.ndarray, n: int) -> list[tuple[int, int]]:
    """[lo, hi) of each bucket 0..n-1 in ascending bucket numbers."""
    edges = np.searchsorted(sorted_buckets, np.arange(n + 1))
    return [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:])]


def _trimmed(result: pa.Table) -> pa.Table:
    """Hands the memory that a finished group freed back to the system, for the executor's other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    return result


def per_block(blocks: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """fn(block number, documents) -> pa.Table, for every block."""
    def run(key, table):
        return _trimmed(fn(key[0].as_py(), unpack_docs(table)))
    return blocks.groupBy("b").applyInArrow(run, schema)


def per_block_with(blocks: DataFrame, n_blocks: int, messages: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """fn(block number, documents, [(src, blob)]) -> pa.Table; messages are addressed by ``dest``.

    Partition counts are stated: messages are small beside the work they cause, so merging
    partitions by their bytes would leave few tasks."""
    messages = _arriving(messages, n_blocks)
    def run(key, left, right):
        return _trimmed(fn(key[0].as_py(), unpack_docs(left), received(right)))
    return blocks.groupBy("b").cogroup(messages.groupBy("dest")).applyInArrow(run, schema)


def per_bucket(messages: DataFrame, n: int, fn: Callable, schema: str = MESSAGE) -> DataFrame:
    """fn(bucket, [(src, blob)]) -> pa.Table."""
    messages = _arriving(messages, n)
    def run(key, table):
        return _trimmed(fn(key[0].as_py(), received(table)))
    return messages.groupBy("dest").applyInArrow(run, schema)


def per_bucket_with(messages: DataFrame, n: int, answers: DataFrame, fn: Callable, schema: str = MESSAGE) -> DataFrame:
    """fn(bucket, [(src, blob)], answers to the bucket as a table) -> pa.Table, for every bucket."""
    messages, answers = _arriving(messages, n), _arriving(answers, n)
    def run(key, left, right):
        return _trimmed(fn(key[0].as_py(), received(left), right))
    return messages.groupBy("dest").cogroup(answers.groupBy("dest")).applyInArrow(run, schema)
