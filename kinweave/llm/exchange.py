"""Which keys of a text also occur elsewhere: an exchange of packed keys.

A map task handles a chunk of texts at a time. Keys that repeat within the chunk are settled there
(so a hot key leaves a chunk once, however many texts hold it); the others are sent, packed into one
binary row per bucket of the key space. A bucket compares the sorted arrays of its chunks and answers
each with the tags of those of its keys that other chunks hold too; the answers of a chunk meet again
in one group of bounded size. Only fixed-width arrays cross the network, never texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kinweave.llm.common import U, pieces, release, text_bytes

#: Bytes of text in a chunk, and bytes of packed keys meant for a bucket.
CHUNK, BUCKET = 4 << 20, 16 << 20
_WIRE = "bucket int, chunk long, home binary, keys binary, tags binary, many binary"


def buckets_for(key_bytes: int) -> int:
    """A power of two: so many buckets that each holds about BUCKET bytes."""
    return 1 << max(4, int(max(1, key_bytes // BUCKET) - 1).bit_length())


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays by name in one binary value."""
    columns = {k: pa.array([v.tobytes()], pa.large_binary()) for k, v in arrays.items()}
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, (b := pa.RecordBatch.from_pydict(columns)).schema) as w:
        w.write_batch(b)
    return sink.getvalue().to_pybytes()


def unpack(raw: bytes) -> dict[str, bytes]:
    batch = pa.ipc.open_stream(raw).read_next_batch()
    return {name: batch.column(k)[0].as_py() for k, name in enumerate(batch.schema.names)}


def _narrow(keys: np.ndarray, bits: int) -> bytes:
    """The 40 bits below the leading `bits`, which the bucket already tells."""
    short = (keys << U(bits)) >> U(24)
    return (short & U(0xFFFFFFFF)).astype(np.uint32).tobytes() + (short >> U(32)).astype(np.uint8).tobytes()


def _widen(raw: bytes) -> np.ndarray:
    n = len(raw) // 5
    return np.frombuffer(raw, np.uint32, n).astype(U) | np.frombuffer(raw, np.uint8, n, 4 * n).astype(U) << U(32)


def exchange(docs: DataFrame, buckets: int, keys_of: Callable, answer: Callable, schema: str, across_rows: bool, exact: bool = True, chunk_bytes: int = CHUNK) -> DataFrame:
    """Rows of `schema`, made by answer(home, tags) for each chunk of docs.

    keys_of(batch, data, offsets) -> (keys, rows, tags, home): 64-bit keys, the row each belongs to
    (a row's keys may repeat), a 32-bit tag for each, and a dict of arrays that answer() gets back
    as bytes. answer(home, tags) gets the tags of all shared keys, in no order. A key is shared if
    it occurs in two rows (across_rows), or twice anywhere. Unless `exact`, 40 bits of a key beside
    its bucket are compared: enough where a key that wrongly counts as shared only costs work.
    """
    bits = int(buckets).bit_length() - 1
    shift = U(64 - bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in pieces(batches, chunk_bytes):
            chunk = (task << 32) | n
            n += 1
            keys, rows, tags, home = keys_of(batch, *text_bytes(batch.column("text")))
            order = np.argsort(keys, kind="stable")
            keys, rows, tags = keys[order], rows[order], tags[order].astype(np.uint32)
            first = np.ones(len(keys), bool)
            first[1:] = keys[1:] != keys[:-1]
            group = np.cumsum(first) - 1
            at = np.flatnonzero(first)
            if across_rows:  # two different rows; rows are in order within a key
                many = np.zeros(len(at), bool)
                many[group[1:][(keys[1:] == keys[:-1]) & (rows[1:] != rows[:-1])]] = True
            else:
                many = np.diff(np.append(at, len(keys))) > 1
            settled = tags[many[group]]
            # of a key that only one row holds, all the tags go along
            one = ~many[group]
            sent = np.concatenate([keys[at[many]], keys[one]])
            flag = np.concatenate([np.ones(many.sum(), np.uint8), np.zeros(one.sum(), np.uint8)])
            tag = np.concatenate([np.zeros(many.sum(), np.uint32), tags[one]])
            bucket = (sent >> shift).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            sent, flag, tag, bucket = sent[order], flag[order], tag[order], bucket[order]
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(edge))
            parts = [(edge[b], edge[b + 1]) for b in full]
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array([chunk % buckets, *full.tolist()], pa.int32()), "chunk": pa.array([chunk] * (len(full) + 1), pa.int64()),
                    "home": pa.array([_pack(settled=settled, **home)] + [None] * len(full), pa.binary()),
                    "keys": pa.array([None] + [sent[a:b].tobytes() if exact else _narrow(sent[a:b], bits) for a, b in parts], pa.binary()),
                    "tags": pa.array([None] + [tag[a:b].tobytes() for a, b in parts], pa.binary()),
                    "many": pa.array([None] + [np.packbits(flag[a:b]).tobytes() for a, b in parts], pa.binary()),
                }
            )

    def compare(table: pa.Table) -> pa.Table:
        release()
        homes = table.filter(pa.compute.is_valid(table["home"]))
        sent = table.filter(pa.compute.is_valid(table["keys"]))
        raw = sent["keys"].to_pylist()
        keys = np.frombuffer(b"".join(raw), U) if exact else np.concatenate([*map(_widen, raw), np.zeros(0, U)])
        sizes = np.array([len(x) // (8 if exact else 5) for x in raw], np.int64)
        tags = np.frombuffer(b"".join(sent["tags"].to_pylist()), np.uint32)
        flag = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=int(k)) for x, k in zip(sent["many"].to_pylist(), sizes, strict=True)] or [np.zeros(0, np.uint8)]).astype(bool)
        part = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        order = np.argsort(keys)
        k, p = keys[order], part[order]
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        group = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        low, high = (np.minimum.reduceat(p, start), np.maximum.reduceat(p, start)) if len(start) else (p, p)
        shared = np.empty(len(k), bool)
        shared[order] = (low != high)[group]
        mine = shared & ~flag
        got_parts = part[mine]
        edge = np.searchsorted(got_parts, np.arange(len(raw) + 1))
        got = tags[mine]
        full = np.flatnonzero(np.diff(edge))
        chunk = sent["chunk"].to_numpy()
        return pa.table(
            {
                "chunk": pa.array(np.concatenate([homes["chunk"].to_numpy(), chunk[full]]).astype(np.int64)),
                "home": pa.array(homes["home"].to_pylist() + [None] * len(full), pa.binary()),
                "tags": pa.array([None] * len(homes) + [got[edge[i] : edge[i + 1]].tobytes() for i in full], pa.binary()),
            }
        )

    def close(table: pa.Table) -> pa.Table:
        home = unpack(next(x for x in table["home"].to_pylist() if x is not None))
        tags = [np.frombuffer(home.pop("settled"), np.uint32), *[np.frombuffer(x, np.uint32) for x in table["tags"].to_pylist() if x is not None]]
        return answer(home, np.concatenate(tags))

    wire = docs.mapInArrow(send, _WIRE)
    back = wire.groupBy("bucket").applyInArrow(compare, "chunk long, home binary, tags binary")
    return back.groupBy("chunk").applyInArrow(close, schema)
