"""Exact Jaccard linking of classes that share keys: pivots, regions, triangle-inequality windows.

``shared`` rows (s, cls, least, score, k) say that a class holds a key ``s``. Two classes link when
the Jaccard similarity of their bodies reaches a percentage; a pair is looked at when it shares a
key. Every key names as pivot its class of highest score; at keys of at most ``PAIRED`` classes, of
every pair one is the other's pivot. What links to a pivot is connected; in every region,
classes outside the pivot's component join against the other components inside the
triangle-inequality window, large regions divide by pivots of their own.
Bodies are sorted 48-bit hashes; the membership filter has a fixed size and only saves work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitwise.llm.common import mix
from unitwise.llm.components import connected_components
from unitwise.session import stage, stage_by

REGION = 2048
LEVELS = 3
#: Hashes of a block's bodies on either side; a region above it is cut like one of too many classes.
KEYS = 2_000_000
#: Classes of a block when links are counted: all of a component are home there, so blocks are smaller.
COUNTED = 512
FILTER_BITS = 1 << 27
ROWS_PER_TASK = 1_500_000
ROWS_AT_ONCE = 1_000_000
#: A key of at most this many classes names its pairs when shared keys are counted per pair.
PAIRED = 4
#: A key held by more rows of one flush is dealt by class; one row of it stays with the others.
OFTEN = 512
LOW48 = np.uint64((1 << 48) - 1)
_NEAR = 1e-9
_MET_AT_ONCE = 4_000_000


def to_bytes(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


class Packer:
    """Collects (marked key, class) rows of a map task and packs them by part of the key space.

    A marked key holds 16 bits of marks above 48 bits of key. Rows of ``spread`` keys, and of keys
    met often in one flush, are dealt by class (kind 1), so that no part receives a frequent key. Of
    the latter one row goes to the key's own part (kind 2) and names the key frequent there.
    """

    def __init__(self, parts: int):
        self.parts = parts
        self._clear()

    def _clear(self) -> None:
        self.rows: list[tuple[list[np.ndarray], list[tuple[int, int]]]] = [([], []), ([], [])]
        self.size = 0

    def add(self, marked: np.ndarray, cls: int, spread: bool = False) -> None:
        if len(marked):
            keys, classes = self.rows[spread]
            keys.append(marked)
            classes.append((cls, len(marked)))
            self.size += len(marked)

    @property
    def full(self) -> bool:
        return self.size > ROWS_AT_ONCE

    def flush(self) -> pa.RecordBatch:
        out = []
        for spread, (keys, classes) in enumerate(self.rows):
            if not keys:
                continue
            pairs = np.stack([np.concatenate(keys), np.repeat(
                np.array([x for x, _ in classes], np.int64), [n for _, n in classes]).view(np.uint64)], axis=1)
            if spread:
                out += self._dealt(pairs, pairs[:, 1], 1)
                continue
            key = pairs[:, 0] & LOW48
            kinds = np.sort(key)
            many = kinds[np.append(kinds[OFTEN:] == kinds[:-OFTEN], np.zeros(min(OFTEN, len(kinds)), bool))]
            often = np.isin(key, np.unique(many))
            named = np.zeros(len(key), bool)
            named[np.flatnonzero(often)[np.unique(key[often], return_index=True)[1]]] = True
            often &= ~named
            plain = ~often & ~named
            out += self._dealt(pairs[plain], key[plain], 0) + self._dealt(pairs[named], key[named], 2)
            out += self._dealt(pairs[often], pairs[often, 1], 1)
        self._clear()
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())],
            names=["part", "kind", "rows"])

    def _dealt(self, pairs: np.ndarray, by: np.ndarray, kind: int) -> list[tuple[int, int, bytes]]:
        # Numbers of 16 bits are sorted by their digits.
        part = (mix(by) % np.uint64(self.parts)).astype(np.uint16 if self.parts < 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        pairs, cuts = pairs[order], np.searchsorted(part[order], np.arange(self.parts + 1))
        return [(p, kind, pairs[cuts[p]:cuts[p + 1]].tobytes()) for p in range(self.parts) if cuts[p] < cuts[p + 1]]


PACKED = "part int, kind int, rows binary"


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, bool], list[np.ndarray]] = {}
    for batch in batches:
        for part, kind, rows in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            pairs = np.frombuffer(rows, np.uint64).reshape(-1, 2)
            held.setdefault((part, kind == 1), []).append((pairs, kind))
    for (_, spread), found in held.items():
        pairs, kinds = np.concatenate([x for x, _ in found]), np.repeat([k for _, k in found], [len(x) for x, _ in found])
        if not spread:
            # Most keys are met once, so the rest is sorted by class too.
            s = pairs[:, 0] & LOW48
            order = np.argsort(s)
            new = np.append(True, s[order[1:]] != s[order[:-1]])
            order = order[~(new & np.append(new[1:], True)) | (kinds[order] == 2)]
            pairs, kinds = pairs[order], kinds[order]
        s, c = pairs[:, 0] & LOW48, pairs[:, 1]
        order = np.lexsort((c, s))
        pairs, kinds, s, c = pairs[order], kinds[order], s[order], c[order]
        if not len(s):
            continue
        first = np.append(True, s[1:] != s[:-1])
        group = np.cumsum(first) - 1
        fresh = first | np.append(True, c[1:] != c[:-1])
        k = np.bincount(group, fresh).astype(np.int64)
        named = np.bincount(group, kinds == 2) > 0
        k = np.where(named | spread, 0, k)[group]
        keep = fresh & (k != 1)
        pairs, s, k = pairs[keep], s[keep], k[keep]
        for at in range(0, len(s), 100_000):
            own = pairs[at:at + 100_000]
            marks = (own[:, 0] >> np.uint64(48)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(s[at:at + 100_000].astype(np.int64)), pa.array(own[:, 1].copy().view(np.int64)),
                 pa.array(marks >> 6), pa.array(marks & 63), pa.array(k[at:at + 100_000])],
                names=["s", "cls", "least", "score", "k"])


def shared_keys(packed: DataFrame, parts: int) -> DataFrame:
    """(s, cls, least, score, k) of ``PACKED`` rows: the keys that ``k`` > 1 classes hold, and with
    ``k`` 0 the frequent ones, whose rows may repeat."""
    return packed.repartition(parts, "part").mapInArrow(
        _shared_rows, "s long, cls long, least int, score int, k long")


def _few(k: str = "k") -> Column:
    return (F.col(k) > 0) & (F.col(k) <= PAIRED)


def able_pairs(shared: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(p, c) pairs that meet at keys of few classes and may link, and rows (s, cls, score) of other keys.

    Classes that hold fewer shared keys than ``least`` go first. Of a pair, the keys of few classes
    it shares are counted; it shares no more of the other keys than either of the two holds. Pairs
    below ``least``, and pairs of sizes too different to link, are left out; the class of higher
    score is the pivot of the other. Pairs that meet at keys of many classes only share at most what
    either holds of these, so classes that hold too few are left out there. All this is exact;
    counts that include repeated rows only keep more.
    """
    total = shared.groupBy("cls").agg(F.count("*").alias("n"), F.first("least").alias("need"))
    rows = stage(shared.join(total.filter("n < need").select("cls"), "cls", "left_anti"))
    many, few = rows.filter(~_few()), rows.filter(_few())
    held = many.groupBy("cls").agg(F.count("*").alias("n"), F.first("least").alias("need"))
    side = lambda c: few.select("s", F.struct("cls", "least", "score").alias(c))
    met = side("a").join(side("b"), "s").filter("a.cls < b.cls").groupBy(
        F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).agg(
        F.count("*").alias("n"), F.first("a.least").alias("x"), F.first("b.least").alias("y"),
        F.first("a.score").alias("u"), F.first("b.score").alias("v"))
    of = lambda c: held.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"))
    enough = F.col("n") + F.least(F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))) >= F.greatest("x", "y")
    # ``least`` is a twentieth of the size, rounded up and cut off at 1023.
    sizes = (F.greatest("x", "y") >= 1023) | (100 * F.least("x", "y") >= percent * (F.greatest("x", "y") - 1))
    able = met.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(enough & sizes)
    return _pivoted(able), many.join(
        held.filter("n >= need").select("cls"), "cls", "left_semi").select("s", "cls", "score").distinct()


def _pivoted(pairs: DataFrame) -> DataFrame:
    first = (F.col("u") > F.col("v")) | ((F.col("u") == F.col("v")) & (F.col("a") > F.col("b")))
    return pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("p"),
                        F.when(first, F.col("b")).otherwise(F.col("a")).alias("c"))


def filter_bits(classes: DataFrame, count: int) -> np.ndarray:
    """Bit table of at most ``FILTER_BITS`` bits that holds all classes, and others by chance."""
    size = min(FILTER_BITS, 1 << max(10, int(16 * max(count, 1)).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            for place in _places(batch.column("cls").to_numpy(), size):
                bits[place] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(size // 8, np.uint8)
    for row in classes.coalesce(8).mapInArrow(mark, "bits binary").collect():
        out |= np.frombuffer(row["bits"], np.uint8)
    return out


def _places(cls: np.ndarray, size: int) -> list[np.ndarray]:
    one = mix(cls.view(np.uint64))
    two = mix(one) | np.uint64(1)
    return [((one + np.uint64(k) * two) % np.uint64(size)).astype(np.int64) for k in range(3)]


class Picker:
    """Which rows of a map task belong to wanted classes, each class once a task."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.seen = bits, set()

    def __call__(self, cls: np.ndarray) -> list[int]:
        keep = np.ones(len(cls), bool)
        for place in _places(cls, len(self.bits) * 8):
            keep &= (self.bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
        return [i for i in np.flatnonzero(keep).tolist() if cls[i] not in self.seen and not self.seen.add(cls[i])]


def measured(pairs: DataFrame, bodies: DataFrame, *keep: str) -> DataFrame:
    """``pairs`` (p, c, keep...) with the size of their intersection and both sizes."""
    one = bodies.select(F.col("cls").alias("c"), F.col("n").alias("n_c"), F.col("body").alias("body_c"))
    pivots = bodies.join(pairs.select(F.col("p").alias("cls")).distinct(), "cls", "left_semi")
    # The bodies of pivots move: only where both sides are exchanged does the runtime split a pivot of many
    # rows, and without an expression around the key it would keep to the buckets of ``bodies``.
    two = pivots.select(F.col("cls").bitwiseXOR(F.lit(0)).alias("p"), F.col("n").alias("n_p"),
                        F.col("body").alias("body_p"))
    columns = ["p", "c", *keep, "n_p", "n_c"]
    schema = ", ".join(f"{k} long" for k in [*columns, "both"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for p, b, a in zip(batch.column("p").to_pylist(), batch.column("body_p"), batch.column("body_c"), strict=True):
                if p != last:
                    last, own = p, from_bytes(b.as_py())
                out.append(len(np.intersect1d(from_bytes(a.as_py()), own, assume_unique=True)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).cast(pa.int64()) for k in columns), pa.array(out, pa.int64())],
                names=[*columns, "both"])

    return pairs.join(one, "c").join(two, "p").select(*columns, "body_p", "body_c").mapInArrow(meet, schema)


_DISTANCE = "1 - both / (n_p + n_c - both)"


def _close(rows: dict[str, np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Every home class of a block by its place, and which classes of the block link with it.

    Keys that a quarter of the classes hold are multiplied as a matrix, the others counted holder by holder.
    """
    sizes = np.array([len(b) // 6 for b in rows["body"]])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    flat = from_bytes(b"".join(rows["body"]))
    order = np.argsort(flat, kind="stable")
    flat, holders = flat[order], owner[order]
    first = np.append(True, flat[1:] != flat[:-1])[:len(flat)]
    code = np.empty(len(flat), np.int64)
    code[order] = np.cumsum(first) - 1
    held = np.diff(np.flatnonzero(first), append=len(flat))
    ends, starts = np.append(0, np.cumsum(held)), np.append(0, np.cumsum(sizes))
    often = held > max(len(sizes) // 4, 1)
    line = np.cumsum(often) - 1
    at = often[code]
    table = np.zeros((int(often.sum()), len(sizes)), np.float32 if sizes.max() < 1 << 24 else np.float64)
    table[line[code[at]], owner[at]] = 1
    some = ((held > 1) & ~often)[code]
    met = np.append(0, np.cumsum(np.where(some, held[code], 0)))[starts]
    far = rows["d"]
    homes = np.flatnonzero(rows["home"])
    while len(homes):
        # As many homes at once as keep the holders met, and the counts, in bounds.
        part = homes[:max(1, min(256, int(np.searchsorted(np.cumsum(met[homes + 1] - met[homes]), _MET_AT_ONCE))))]
        homes = homes[len(part):]
        both = (table[:, part].T @ table).astype(np.int64)
        sought = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in part])
        row = np.repeat(np.arange(len(part)), sizes[part])[some[sought]]
        own = code[sought[some[sought]]]
        if len(own):
            n = held[own]
            place = np.arange(n.sum()) + np.repeat(ends[own] - np.cumsum(n) + n, n)
            both += np.bincount(np.repeat(row, n) * len(sizes) + holders[place], minlength=both.size).reshape(both.shape)
        for i, count in zip(part, both, strict=True):
            count[i] = sizes[i]
            close = 100 * count >= percent * (sizes[i] + sizes - count)
            yield i, close & ~(np.abs(far - far[i]) > 1 - percent / 100 + _NEAR)


def _rows(table: pa.Table) -> dict[str, np.ndarray]:
    """The columns of a block, each class once, by class."""
    cls, place = np.unique(table["cls"].to_numpy(), return_index=True)
    table = table.take(pa.array(place))
    return {"cls": cls, "body": table["body"].to_pylist()} | {
        k: table[k].to_numpy() for k in table.column_names if k not in ("cls", "body")}


def _join_block(table: pa.Table, percent: int) -> pa.Table:
    """Links between home classes and classes of other components: enough to connect them."""
    rows = _rows(table)
    group = np.unique(rows["comp"], return_inverse=True)[1]
    out = []
    if group.any():
        for i, close in _close(rows, percent):
            near = np.flatnonzero(close & (group != group[i]))
            if len(near):
                joined, first = np.unique(group[near], return_index=True)
                out += [(rows["cls"][i], rows["cls"][j]) for j in near[first]]
                group[np.isin(group, joined)] = group[i]
    found = np.array(out, np.int64).reshape(-1, 2)
    return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])


def _count_block(table: pa.Table, percent: int) -> pa.Table:
    """Of every home class, the rows (``size``) of the other classes dealt to this block that link with it."""
    rows = _rows(table)
    size = np.where(rows["partner"], rows["size"], 0)
    out = np.array([(rows["cls"][i], size[close].sum() - size[i]) for i, close in _close(rows, percent)],
                   np.int64).reshape(-1, 2)
    return pa.table([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["cls", "linked"])


def join_regions(members: DataFrame, bodies: DataFrame, percent: int, region: int = REGION, levels: int = LEVELS,
                 block: Callable[[pa.Table, int], pa.Table] = _join_block,
                 schema: str = "a long, b long") -> DataFrame:
    """What ``block`` finds between the home classes of every region and its classes; each pair meets in one block.

    ``members``: region, cls, comp, home, d (distance to the region's pivot, null if unknown), n (hashes).
    A cell that keeps more than half of the region it was cut from is not divided again: its classes
    are too close to each other for any pivot, so blocks take it.
    """
    out, level = [], 0
    members = members.withColumn("was", F.lit(None).cast("long"))
    while True:
        members = stage(members)
        counts = members.groupBy("region").agg(
            F.count("*").alias("n_all"), F.count_if("home").alias("n_home"), F.sum("n").alias("k_all"),
            F.sum(F.when(F.col("home"), F.col("n"))).alias("k_home")).filter("n_home > 0 AND n_all > 1")
        sized = members.join(counts, "region")
        fits = (F.col("n_all") <= region) & (F.col("k_all") <= KEYS)
        ready = fits | F.coalesce(2 * F.col("n_all") > F.col("was"), F.lit(False)) | F.lit(level >= levels)
        now = sized.filter(ready)
        pieces = lambda side: F.ceil(F.greatest(
            F.col(f"n_{side}") / region, F.col(f"k_{side}") / KEYS)).cast("int")
        own = F.pmod(F.xxhash64("cls"), pieces("all")).cast("int")
        mine = F.pmod(F.xxhash64("cls", F.lit(1)), pieces("home")).cast("int")
        # Home classes of one block meet the classes of every block; a home class is a partner too.
        homes = now.filter("home").select(
            "region", "cls", "comp", "home", F.lit(False).alias("partner"), "d", mine.alias("hb"),
            F.explode(F.sequence(F.lit(0), pieces("all") - 1)).alias("ab"))
        partners = now.select(
            "region", "cls", "comp", F.lit(False).alias("home"), F.lit(True).alias("partner"), "d",
            F.explode(F.sequence(F.lit(0), pieces("home") - 1)).alias("hb"), own.alias("ab"))
        blocks = homes.unionByName(partners).groupBy("region", "hb", "ab", "cls", "comp", "d").agg(
            F.max("home").alias("home"), F.max("partner").alias("partner"))
        out.append(blocks.join(bodies, "cls").groupBy("region", "hb", "ab").applyInArrow(
            lambda rows: block(rows, percent), schema))
        if level >= levels:
            break
        large = stage(sized.filter(~ready))
        if large.isEmpty():
            break
        members = _divide(large, bodies, percent, region, level)
        level += 1
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def count_links(groups: DataFrame, bodies: DataFrame, percent: int, region: int = COUNTED,
                levels: int = LEVELS) -> DataFrame:
    """(cls, linked): rows of other classes that link with each class of ``groups`` (cls, component).

    Links lie inside components, so every component is a region all of whose classes are home: each is
    home in one cell, the nearest pivot's, where the windows bring all its partners. ``bodies`` has the
    rows of a class in ``size``. Only counts leave a block, never pairs.
    """
    members = groups.join(bodies.select("cls", "n"), "cls").select(
        F.col("component").alias("region"), "cls", F.col("cls").alias("comp"), F.lit(True).alias("home"),
        F.lit(None).cast("double").alias("d"), "n")
    return join_regions(members, bodies, percent, region, levels, _count_block, "cls long, linked long").groupBy(
        "cls").agg(F.sum("linked").alias("linked"))


def _divide(large: DataFrame, bodies: DataFrame, percent: int, region: int, level: int) -> DataFrame:
    """Cells of the large regions: home classes at their nearest pivot, others within reach of a cell."""
    eps = 1 - percent / 100 + _NEAR
    wanted = F.least(F.lit(32), F.ceil(F.greatest(F.col("n_all") / region, F.col("k_all") / KEYS)) + 1)
    draw = F.pmod(F.xxhash64("cls", F.lit(level)), F.lit(1 << 30)) / float(1 << 30)
    pivots = large.filter("home").filter(draw * F.col("n_home") < wanted).select("region", F.col("cls").alias("p"))
    tried = large.select("region", F.col("cls").alias("c"), "comp", F.col("home").cast("long").alias("home"),
                         F.col("n_all").alias("was")).join(pivots, "region")
    seen = stage(measured(tried, bodies, "region", "comp", "home", "was").withColumn("d", F.expr(_DISTANCE)))
    nearest = seen.filter("home = 1").groupBy("region", "c").agg(F.min_by("p", F.struct("d", "p")).alias("cell"))
    placed = seen.join(nearest, ["region", "c"], "left").withColumn("here", F.coalesce(F.col("cell") == F.col("p"), F.lit(False)))
    reach = placed.filter("here").groupBy("region", "p").agg(F.max("d").alias("most"), F.min("d").alias("least"))
    near = placed.join(reach, ["region", "p"]).filter(
        (F.col("d") <= F.col("most") + eps) & (F.col("d") >= F.col("least") - eps))
    cells = near.select(F.xxhash64("region", "p", F.lit(level)).alias("region"), F.col("c").alias("cls"), "comp",
                        F.col("here").alias("home"), "d", F.col("n_c").alias("n"), "was")
    # A region for which no pivot was drawn stays as it is.
    return cells.unionByName(large.join(pivots, "region", "left_anti").select(
        "region", "cls", "comp", "home", "d", "n", "was"))


def _region_members(seen: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Home classes of every region and the pivot-linked classes inside some home class's window."""
    eps = 1 - percent / 100 + _NEAR
    of_p = comps.select(F.col("node").alias("p"), F.col("component").alias("p_comp"))
    of_c = comps.select(F.col("node").alias("c"), F.col("component").alias("c_comp"))
    each = seen.join(of_c, "c", "left").join(of_p, "p", "left").select(
        F.col("p").alias("region"), F.col("c").alias("cls"), F.coalesce("c_comp", "c").alias("comp"),
        (F.coalesce("c_comp", "c") != F.coalesce("p_comp", "p")).alias("home"), F.expr(_DISTANCE).alias("d"),
        F.col("n_c").alias("n"))
    reach = each.groupBy("region").agg(
        F.min(F.when(F.col("home"), F.col("d"))).alias("least"), F.max(F.when(F.col("home"), F.col("d"))).alias("most"),
        F.count("*").alias("rows")).filter("least IS NOT NULL AND rows > 1")
    return each.join(reach, "region").filter(
        F.col("home") | ((F.col("d") >= F.col("least") - eps) & (F.col("d") <= F.col("most") + eps))
    ).select("region", "cls", "comp", "home", "d", "n")


def link_shared(shared: DataFrame, bodies_of: Callable[[Broadcast], DataFrame], percent: int,
                region: int = REGION, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(node, component) of every class that links with another one it shares a key with, and the staged bodies.

    ``bodies_of`` gives (cls, n, body) rows of the classes a broadcast bit table holds, each class once.
    """
    near, many = able_pairs(shared, percent)
    many = stage(many)
    leads = many.groupBy("s").agg(F.max(F.struct("score", "cls")).alias("most"), F.min("cls").alias("x"),
                                  F.max("cls").alias("y")).filter("x <> y").select("s", F.col("most.cls").alias("p"))
    met = many.join(leads, "s").filter("p <> cls").select("p", F.col("cls").alias("c"), F.lit(1).alias("region"))
    pairs = stage(met.unionByName(near.withColumn("region", F.lit(0))).groupBy("p", "c").agg(
        F.max("region").alias("region")))
    classes = pairs.select(F.col("c").alias("cls")).unionByName(pairs.select(F.col("p").alias("cls"))).distinct()
    bits = pairs.sparkSession.sparkContext.broadcast(filter_bits(classes, classes.count()))
    bodies = stage_by(bodies_of(bits), "cls")
    bits.destroy()
    seen = stage(measured(pairs, bodies, "region"))
    stars = seen.filter(f"100 * both >= {percent} * (n_p + n_c - both)").select(
        F.col("p").alias("a"), F.col("c").alias("b"))
    comps = stage(connected_components(stars))
    members = _region_members(seen.filter("region = 1"), comps, percent)
    links = stage(join_regions(members, bodies, percent, region, levels))
    if links.isEmpty():
        return comps, bodies
    # What the pivots connected is a star already; only components that a link joins change.
    joined = comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)
    return connected_components(joined), bodies
