"""Token ids packed into rows of a fixed length by best-fit decreasing.

Documents are tokenized and closed by an end id; one longer than a row is split into consecutive pieces, so nothing is
lost.  Pieces go, longest first, each into the row with the least room that still holds it; a segment tree over the
room left (a leaf for each number of free places) finds that row in a few steps.  A packed row is its ids, the
cumulative lengths of its segments, and the offset in its document at which each segment starts.

Every task packs what it reads in shards of bounded size, so memory is bounded and texts are never shuffled; a
document's pieces stay in one shard.  Rows of a shard that aren't full are padded on writing only.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default vocabulary (ranks of a byte-level BPE), its split pattern and the free id that ends a document.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID, ROW = 50256, 2048
#: Tokens after which a shard is packed and written out.
SHARD_TOKENS = 4_000_000
SCHEMA = "shard string, row int, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<bigint>, doc_offsets array<int>"


class Rooms:
    """Rows by the room they have left, in a segment tree whose nodes tell whether any row is below."""

    def __init__(self, size: int):
        self.width = 1
        while self.width < size + 1:
            self.width *= 2
        self.any = bytearray(2 * self.width)
        self.rows: dict[int, list[int]] = {}

    def put(self, room: int, row: int) -> None:
        held = self.rows.setdefault(room, [])
        held.append(row)
        at = self.width + room
        while at and not self.any[at]:
            self.any[at] = 1
            at //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least room of at least ``need``, taken out: (room, row); None if there is none."""
        at = self.width + need
        while not self.any[at]:
            while at & 1:  # up from a right child, until there is a sibling to the right
                at //= 2
            if at == 0:
                return None
            at += 1
        while at < self.width:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        room = at - self.width
        row = self.rows[room].pop()
        if not self.rows[room]:
            while at and not (at < self.width and (self.any[2 * at] or self.any[2 * at + 1])):
                self.any[at] = 0
                at //= 2
        return room, row


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of ``sizes`` (none above ``capacity``) by row; of equal sizes the earlier one goes first."""
    rooms, rows = Rooms(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = rooms.take(sizes[i])
        if found is None:
            rows.append([i])
            room, row = capacity, len(rows) - 1
        else:
            room, row = found
            rows[row].append(i)
        if room > sizes[i]:
            rooms.put(room - sizes[i], row)
    return rows


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


#: White space as the split pattern knows it, and the length of a run from which it is encoded apart.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = 4096


def encode(enc, text: str, pattern: str = PATTERN, long_run: int = LONG_RUN) -> list[int]:
    """Ids of one whole text, the same as the encoder's own for it.

    The encoder's regular expression can't look past very long runs of white space (a million spaces end the process), so
    long runs are cut out where ``PATTERN`` ends a piece anyway: before the run, and before its last character if a
    word follows (which may take that one in).  Other patterns get the text as it is.
    """
    if pattern != PATTERN or len(text) <= long_run:
        return enc.encode_ordinary(text)
    out, at = [], 0
    for m in re.finditer(f"[{_WHITE}]{{{long_run},}}", text):
        stop = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[at : m.start()])
        out += enc._encode_single_piece(text[m.start() : stop])
        at = stop
    return out + enc.encode_ordinary(text[at:])


def pack_shard(docs: list[tuple[int | None, np.ndarray]], row: int) -> Iterator[tuple]:
    """(ids, cumulative lengths, doc ids, doc offsets) of each row that the documents' ids are packed into."""
    pieces = [(d, at, ids[at : at + row]) for d, ids in docs for at in range(0, len(ids), row)]
    for members in best_fit_decreasing([len(p[2]) for p in pieces], row):
        cum = np.cumsum([0] + [len(pieces[i][2]) for i in members], dtype=np.int32)
        yield np.concatenate([pieces[i][2] for i in members]), cum, [pieces[i][0] for i in members], [pieces[i][1] for i in members]


def packed(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN, end_id: int = END_ID, row: int = ROW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Packed rows of all documents; only doc_id and text are read.

    shard and row name a packed row; ids are its n_tokens token ids as little-endian unsigned 16-bit numbers;
    cu_seqlens are the cumulative lengths of its segments from 0 on, position_resets the places where positions start
    again at 0; doc_ids and doc_offsets tell for each segment the document and the place in it.  A null text is packed
    as an empty one, whose only id is the end id.  Repeated rows and null ids are packed like others; texts of any length
    are packed whole, long runs of white space too; an empty table gives no rows.  Which documents share a row depends on
    how the table is split into tasks, their ids don't.
    """
    with open(path, "rb") as f:
        ranks = f.read()  # under 1 MB; tasks get the content, not the path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task = _encoding(ranks, pattern), TaskContext.get()
        held, tokens, shard = [], 0, 0

        def flush() -> pa.RecordBatch:
            rows = list(pack_shard(held, row))
            lists = lambda values, kind: pa.array(values, type=pa.list_(kind))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{task.partitionId():05d}-{shard:03d}"] * len(rows)), pa.array(range(len(rows)), type=pa.int32()), pa.array([len(r[0]) for r in rows], type=pa.int32()),
                    pa.array([r[0].astype("<u2").tobytes() for r in rows], type=pa.binary()), lists([r[1] for r in rows], pa.int32()), lists([r[1][:-1] for r in rows], pa.int32()),
                    lists([r[2] for r in rows], pa.int64()), lists([r[3] for r in rows], pa.int32()),
                ],
                names=["shard", "row", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets"],
            )

        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array(encode(enc, t.as_py() or "", pattern), dtype=np.uint16 if end_id < 65536 else np.uint32)
                held.append((d, np.append(ids, ids.dtype.type(end_id))))
                tokens += len(ids) + 1
                if tokens >= shard_tokens:
                    yield flush()
                    held, tokens, shard = [], 0, shard + 1
        if held:
            yield flush()

    if end_id >= 65536:
        raise ValueError("ids are written in 16 bits")
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def padded(rows: DataFrame, row: int = ROW, pad_id: int = END_ID) -> DataFrame:
    """Packed rows with ``ids`` filled up to ``row`` ids by ``pad_id``: the rows of the id matrix, all of one width."""
    padding = pad_id.to_bytes(2, "little") * row
    return rows.withColumn("ids", F.concat("ids", F.substring(F.lit(bytearray(padding)), 1, 2 * row - F.length("ids"))))


def write_matrices(rows: DataFrame, path: str, row: int = ROW, pad_id: int = END_ID) -> DataFrame:
    """Write packed rows as binary records for training: matrix rows (see ``padded``), beside them cumulative lengths and
    position resets.  Written by Spark, so a lost executor's files are written again; returns what was written."""
    padded(rows, row, pad_id).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)
