"""Cost-balanced packing: longest pieces first, each into the cheapest sequence with room for it.

A piece of n ids costs ``linear * n + quadratic * n * n``: the layers' matrices see every id once,
attention sees every pair of a piece. Documents longer than ``capacity`` are cut into full pieces and
a rest. Pieces are dealt at random to groups of bounded size, which tasks pack on their own. A group of
T ids gets ``T // capacity`` full sequences and, for the remainder, sequences of the powers of two that
sum up to it, none of which is padded. Pieces go in descending order of cost, each to the sequence of
the lowest cost that has room for all of it; where none has, the cheapest with any room takes what fits
and the rest waits for its turn among the shorter pieces. Room and ids are equally many, so every
sequence ends full; a group of any size pads nothing, and groups are alike because they are dealt at
random. Each cut fills a sequence, so there are fewer cuts than sequences.

Ids move once, two bytes each where the vocabulary allows. The number of groups follows from the bytes
of the texts, which are never fewer than their ids.

Defined results: a null text counts as empty, an empty text is the end id alone. Repeated rows are
packed as often as they occur. A null ``doc_id`` is kept as null. Equal costs go by room, then by number
of the sequence, equal pieces by their place in the table. Other columns are ignored, an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitwise.llm.common import prepare, slices
from unitwise.llm.packing import encoder

CAPACITY = 2048
END_ID = 1
#: Cost of an id and of a pair of ids: 6 * width and 1, as in a layer of that width.
LINEAR = 6 * 1024
QUADRATIC = 1
BYTES_PER_GROUP = 8 << 20

PLACED = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_cost long")
_PIECE = "row long, doc_id long, start long, length long, doc_tokens long, ids binary"


def rooms_for(total: int, capacity: int) -> list[int]:
    """Sequences that hold ``total`` ids: full ones, then powers of two."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def assign(lengths: np.ndarray, capacity: int = CAPACITY, linear: int = LINEAR,
           quadratic: int = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """((item, start, length, sequence, offset) of every part, cost of every sequence)."""
    rooms = rooms_for(int(lengths.sum()), capacity)
    costs = [0] * len(rooms)
    by_room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for number, room in enumerate(rooms):
        by_room[room].append((0, number))
    lowest = np.full(capacity + 1, np.inf)  # of the sequences with so much room
    for room, some in enumerate(by_room):
        if some and room:
            lowest[room] = 0
    due: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for item, n in enumerate(lengths.tolist()):
        due[n].append((item, 0))
    parts = []
    for n in range(capacity, 0, -1):
        for item, start in due[n]:
            room, fits = n + int(lowest[n:].argmin()), n
            if lowest[room] == np.inf:
                room = 1 + int(lowest[1:n].argmin())
                fits = room
                due[n - room].append((item, start + room))
            cost, number = heappop(by_room[room])
            parts.append((item, start, fits, number, rooms[number] - room))
            lowest[room] = by_room[room][0][0] if by_room[room] else np.inf
            costs[number] = cost = cost + linear * fits + quadratic * fits * fits
            if left := room - fits:
                heappush(by_room[left], (cost, number))
                lowest[left] = by_room[left][0][0]
        due[n] = []
    return parts, costs


def tokenize(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every row, with the row's number in the table."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        narrow = encode.tokenizer.get_vocab_size() <= 1 << 16
        end = array("I", [END_ID]).tobytes()
        for batch in slices(batches, "text", 2 << 20):
            out: list[tuple] = []
            for row, doc, ids in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(),
                                     encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                own = np.frombuffer(ids + end, "<u4")
                total = len(own)
                if narrow:
                    own = own.astype("<u2")
                out.extend((row, doc, at, min(capacity, total - at), total, own[at:at + capacity].tobytes())
                           for at in range(0, total, capacity))
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                             names=[x.split()[0] for x in _PIECE.split(", ")])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       "text").mapInArrow(pieces, _PIECE)


def cost_balanced_packing(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY,
                          linear: int = LINEAR, quadratic: int = QUADRATIC) -> DataFrame:
    """Tokenize and pack every row of ``docs``: ``PLACED``."""
    prepare(docs.sparkSession)
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        group = TaskContext.get().partitionId()
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found).sort_by([("row", "ascending"), ("start", "ascending")])
        lengths = table.column("length").to_numpy()
        ids = [np.frombuffer(x.as_buffer(), f"<u{x.as_buffer().size // n}")
               for x, n in zip(table.column("ids"), lengths, strict=True)]
        parts, costs = assign(lengths, capacity, linear, quadratic)
        item, first, length, number, offset = (np.array(c, np.int64) for c in zip(*parts, strict=True))
        crc = [zlib.crc32(ids[i][a:a + n].astype("<u4").tobytes()) for i, a, n, _, _ in parts]
        start = table.column("start").to_numpy()[item] + first
        columns = [table.column("doc_id").take(pa.array(item)).combine_chunks(), start, length, crc,
                   table.column("doc_tokens").to_numpy()[item], (group << 32) + number, offset,
                   np.array(costs, np.int64)[number]]
        yield from pa.table([pa.array(c, pa.int64()) for c in columns],
                            names=[x.split()[0] for x in PLACED.split(", ")]).to_batches(50_000)

    groups = max(1, -(-size // BYTES_PER_GROUP))
    return tokenize(docs, vocabulary, capacity).repartition(groups, F.xxhash64("row", "start")).mapInArrow(pack, PLACED)
