"""Best-fit packing of tokenized documents, improved by swap-based local search.

Documents become pieces of at most ``CAPACITY`` ids. Groups of pieces are packed in
parallel: best fit, longest first, then local search among the bins that are not full.
The search moves a piece, or swaps one for one, two for one or one for two, from an emptier
to a fuller bin, so that each step raises the sum of squared fills, until bins are empty; it
ends when no smaller number of bins is possible or no step is left, however many that takes.
The emptiest bin of every group goes, piece by piece, to the next round over fewer
groups, until one group is left, so groups cost no bins.

Defined results: a null text counts as empty, and an empty text is the end id alone. A
text of any length is tokenized whole. Repeated rows are packed as often as they occur,
each at a place of its own. A null ``doc_id`` is kept as null. Other columns are ignored,
an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitwise.llm.common import partitions_for, prepare, slices
from unitwise.session import stage

CAPACITY = 2048
END_ID = 0
PIECES_PER_GROUP = 100_000
_CACHED = 700_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"


class Encoder:
    """Ids of texts by the byte-level vocabulary, each distinct word encoded once.

    A byte-level vocabulary splits a text into words first and encodes each on its own, so
    the ids of a text are those of its words in order. Words are found by the plain ``re``
    module where a text has only characters both modules class alike, else by ``regex``.
    """

    _plain = re.compile(f"[\\t-\\r -~{_LETTERS}]*")
    _split = re.compile(
        f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\t-\\r {_LETTERS}0-9]+|[\\t-\\r ]+(?![^\\t-\\r ])|[\\t-\\r ]+")

    def __init__(self, vocabulary: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
        self.tokenizer.encode_special_tokens = True
        self._any = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        return (self._split if self._plain.fullmatch(text) else self._any).findall(text)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers."""
        split = [self.words(t) for t in texts]
        new = list(set().union(*split).difference(self.known))
        known = self.known
        full = len(known) >= _CACHED
        for at in range(0, len(new), 50_000):
            part = new[at:at + 50_000]
            for word, found in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                known[word] = array("I", found.ids).tobytes()
        out = [b"".join(map(known.__getitem__, found)) for found in split]
        if full:  # the first words, mostly the frequent ones, stay
            for word in new:
                del known[word]
        return out


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(vocabulary: str | None = None) -> Encoder:
    """The encoder of this process; later tasks of a worker find its words known."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def tokenize(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY,
             with_ids: bool = False) -> DataFrame:
    """One row of ``PIECES`` per piece of every row; ``with_ids`` adds the ids as binary."""
    prepare(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        end = array("I", [END_ID]).tobytes()
        for batch in slices(batches, "text", 4 << 20):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(),
                                encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start:4 * (start + length)]
                    rows.append((doc, k, start, length, zlib.crc32(own), own if with_ids else None))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][:6 if with_ids else 5]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(kinds)])

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(
        pieces, PIECES + (", ids binary" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit k is set while a bin has k places left
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        fitting = open_ >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            own = by_space[space].pop()
            if not by_space[space]:
                open_ ^= 1 << space
        else:
            space, own = capacity, len(bins)
            bins.append([])
        bins[own].append(item)
        left = space - n
        if left:
            by_space[left].append(own)
            open_ |= 1 << left
    return bins


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound of the bins needed: total length, and for every t the pieces longer than ``capacity - t``
    beside the rest of at least ``t`` each (Martello and Toth)."""
    count = np.bincount(lengths, minlength=capacity + 1)
    mass = count * np.arange(capacity + 1)
    pieces, total = np.append(0, np.cumsum(count)), np.append(0, np.cumsum(mass))  # of lengths below k
    half = capacity // 2
    t = np.arange(half + 1)
    alone = pieces[capacity + 1] - pieces[capacity - t + 1]
    long = pieces[capacity - t + 1] - pieces[half + 1]
    room = long * capacity - (total[capacity - t + 1] - total[half + 1])
    short = total[half + 1] - total[t]
    return int((alone + long + np.maximum(0, -((room - short) // capacity))).max())


def _masks(own: dict[int, list[int]]) -> tuple[int, int]:
    """Bit n of the first is set for a piece of length n, of the second for two pieces of total length n."""
    single = pair = 0
    for n, items in own.items():
        pair |= single << n
        if len(items) > 1:
            pair |= 1 << 2 * n
        single |= 1 << n
    return single, pair


class _Underfull:
    """Bins that are not full by their free space, each space with the lengths its bins can give.

    Lengths of bins that left a space stay until a look-up meets them in vain.
    """

    def __init__(self, capacity: int):
        self.bins: list[dict[int, tuple[int, int]]] = [{} for _ in range(capacity + 1)]
        self.gives = [[0, 0] for _ in range(capacity + 1)]

    def add(self, bin_: int, space: int, single: int, pair: int) -> None:
        # For one piece: nothing, one or two of the fuller bin's; for two pieces: one.
        own = (1 | single | pair, single)
        self.bins[space][bin_] = own
        self.gives[space][0] |= own[0]
        self.gives[space][1] |= own[1]

    def remove(self, bin_: int, space: int) -> None:
        del self.bins[space][bin_]
        if not self.bins[space]:
            self.gives[space] = [0, 0]

    def step(self, takes: tuple[int, int], most: int) -> tuple[int, int, int, int] | None:
        """(carried, kind, given back, bin) of the step that carries most into a bin of at most ``most`` free space."""
        found = [0, 0]
        for carried in range(most, 0, -1):
            gives = self.gives[carried]
            found[0] |= gives[0]
            found[1] |= gives[1]
            for kind in (0, 1):
                while both := (takes[kind] >> carried) & found[kind]:
                    back = both & -both
                    for space in range(carried, most + 1):
                        if self.gives[space][kind] & back:
                            for bin_, own in self.bins[space].items():
                                if own[kind] & back:
                                    return carried, kind, back.bit_length() - 1, bin_
                            self.gives[space][kind] &= ~back
                    found[kind] &= ~back
        return None


def _take(own: dict[int, list[int]], total: int, pieces: int) -> list[tuple[int, int]]:
    """Remove ``pieces`` pieces (0, 1 or 2) of ``total`` length: (length, item)."""
    if pieces == 2:
        first = next(n for n, items in own.items() if total - n in own and (2 * n != total or len(items) > 1))
        return _take(own, first, 1) + _take(own, total - first, 1)
    if not pieces:
        return []
    item = own[total].pop()
    if not own[total]:
        del own[total]
    return [(total, item)]


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Raise the sum of squared fills by exchanges until no fewer bins are possible or no step is left.

    Bins are drained from the emptiest on, each by the steps that carry most, found by look-up among the
    fuller bins; passes over them end when one finds no step. Every step raises the sum, so they do end.
    """
    least = least_bins(lengths, capacity)
    held: list[dict[int, list[int]]] = []
    for own in bins:
        held.append({})
        for i in own:
            held[-1].setdefault(int(lengths[i]), []).append(i)
    space = [capacity - sum(n * len(items) for n, items in own.items()) for own in held]
    live = len(held)
    index = _Underfull(capacity)
    masks: dict[int, tuple[int, int]] = {}
    for b, own in enumerate(held):
        if space[b]:
            masks[b] = _masks(own)
            index.add(b, space[b], *masks[b])

    moved = True
    while moved and live > least:
        moved = False
        due = [(-space[b], b) for b in masks]
        heapify(due)
        while due and live > least:
            left, low = heappop(due)
            if low not in masks or space[low] != -left:
                continue
            index.remove(low, space[low])
            while held[low] and (found := index.step(masks[low], space[low])):
                carried, kind, back, high = found
                index.remove(high, space[high])
                gone = _take(held[low], carried + back, kind + 1)
                come = _take(held[high], back, 0 if not back else 1 if masks[high][0] >> back & 1 else 2)
                for into, some in ((held[high], gone), (held[low], come)):
                    for n, item in some:
                        into.setdefault(n, []).append(item)
                space[low] += carried
                space[high] -= carried
                masks[low], masks[high] = _masks(held[low]), _masks(held[high])
                if space[high]:
                    index.add(high, space[high], *masks[high])
                    heappush(due, (-space[high], high))
                else:
                    del masks[high]
                moved = True
            if held[low]:
                index.add(low, space[low], *masks[low])
            else:
                del masks[low]
                live -= 1
    return [[i for n in sorted(own, reverse=True) for i in own[n]] for own in held if own]


def pack_group(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(lengths, capacity), lengths, capacity)


_PLACED = PIECES + ", sequence_id long, offset long, open boolean"


def _pack_round(pieces: DataFrame, groups: int, round_: int, capacity: int) -> DataFrame:
    """Pack each of ``groups`` groups; pieces of its emptiest bin are ``open`` while there are several."""
    names = [x.split()[0] for x in PIECES.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        group = TaskContext.get().partitionId()
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found).sort_by([(n, "ascending") for n in names])
        lengths = table.column("length").to_numpy()
        bins = pack_group(lengths, capacity)
        fills = [int(lengths[own].sum()) for own in bins]
        emptiest = int(np.argmin(fills)) if groups > 1 and min(fills) < capacity else -1
        order = np.concatenate([np.array(own, np.int64) for own in bins])
        bin_of = np.repeat(np.arange(len(bins)), [len(own) for own in bins])
        ends = np.cumsum(lengths[order])
        firsts = np.concatenate([[0], np.cumsum(fills)[:-1]])
        placed = table.take(pa.array(order)).append_column(
            "sequence_id", pa.array((round_ << 58) + (group << 32) + bin_of, pa.int64())).append_column(
            "offset", pa.array(ends - lengths[order] - firsts[bin_of], pa.int64())).append_column(
            "open", pa.array(bin_of == emptiest))
        yield from placed.to_batches(50_000)

    dealt = pieces.coalesce(1) if groups == 1 else pieces.repartition(groups, *(F.col(n) for n in names[:2]))
    return dealt.mapInArrow(pack, _PLACED)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every row of ``pieces`` (``PIECES``) with its sequence and its offset there."""
    spark = prepare(pieces.sparkSession)
    rest, done, round_ = stage(pieces), None, 0
    while True:
        # As many groups as hold the pieces; at the last one everything left is placed.
        groups = -(-rest.count() // PIECES_PER_GROUP) or 1
        if round_ == 0 and groups > 1:
            groups = partitions_for(spark, groups * PIECES_PER_GROUP, PIECES_PER_GROUP)
        placed = stage(_pack_round(rest, groups, round_, capacity))
        closed = placed.filter("NOT open").drop("open")
        done = closed if done is None else done.unionByName(closed)
        if groups == 1:
            return done
        rest, round_ = placed.filter("open").drop("sequence_id", "offset", "open"), round_ + 1


def best_fit_packing(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize and pack every row of ``docs``: ``PIECES``, sequence_id and offset."""
    return pack(tokenize(docs, vocabulary, capacity), capacity)
