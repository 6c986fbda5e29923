"""N-gram Jaccard join: which texts share nearly all of their word shingles.

A text is the set of 64-bit hashes of its distinct shingles. Texts whose sets are equal are one
vertex. Only vertices that may reach the threshold meet: a set is dealt into as many parts as two
sets of that size may differ in, and one more, so two linked sets have an equal part. The vertices that
have one part of one size band in common are a candidate group; groups are never merged, so texts that
share a passage with each other in turn do not run together. A group is cut into tiles of bounded size; in a tile hashed
bitmaps bound every overlap from above by counting bits, and an exact intersection of the sorted arrays
decides the rest. Links within a tile leave it as a spanning forest, never as all pairs.

Each vertex first goes to its largest group alone, which links nearly all of a family of copies. Of all its groups
only those are then compared whose members are still in several components, and only members
outside a group's largest component with the others. There the bitmaps go first and alone, a sixteenth of the
arrays; arrays follow for those rows only that have a partner which the bounds leave.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qlog.llm.common import MASK64, U64, Hasher, forget, mix, small, spans, text_key, text_slices, written
from qlog.llm.graph import components

#: ASCII blanks separate words; everything else belongs to them.
WORD_BYTES = np.array([0 if b in (9, 10, 11, 12, 13, 32) else 1 for b in range(256)], np.uint8)
TILE, PIVOTS, SMALL_ROWS = 1024, 32, 128
#: Groups of so many members go to the task of their smallest one, so that a set that is in many of them is sent there once.
FAMILY = 16
#: Shingles that the sets of a tile hold together, about; a tile of longer texts has fewer rows, ``LEAST_TILE`` at least.
TILE_SHINGLES, LEAST_TILE = 1 << 20, 8
#: The table that picks the texts of candidates (four numbers a row) is broadcast up to so many rows, else shuffled.
SEND_ROWS = 500_000


class Bands:
    """Size bands for a threshold num/den, and how many parts a set of a band is dealt into.

    Band c holds sizes from ``low[c]`` up to (not including) ``low[c + 1]``. A pair belongs to the
    band of its smaller set. ``parts[c]`` exceeds the largest difference of a linked pair of the band
    by ``spare[c]`` + 1; ``spare`` allows for parts that are empty by chance.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        low = [1]
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, -(-low[-1] * 13 // 10)))
        self.low = np.array(low, np.int64)
        parts, spare = [], []
        for a, b in zip(low[:-1], low[1:]):
            most = b - 1 + (b - 1) * den // num  # sizes of both together
            differ = most * (den - num) // (den + num)
            empty = (differ + 1) * math.exp(-a / (differ + 1))
            spare.append(0 if empty < 0.1 else math.ceil(empty + 2 * math.sqrt(empty)))
            parts.append(differ + 1 + spare[-1])
        self.parts, self.spare = parts, spare

    def of(self, n: int) -> range:
        """Bands of the pairs that a set of ``n`` can be in: as the smaller set, or with a smaller one."""
        least = -(-n * self.num // self.den)
        a, b = np.searchsorted(self.low, [least, n], "right") - 1
        return range(int(a), int(b) + 1)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than ``n`` words make one shingle of them all."""
    start, end, first = spans(raw, offsets, WORD_BYTES)
    w = Hasher(raw, fold_case=True).of(start, end)
    size = max(0, len(w) - n + 1)
    h = np.full(size, n, U64)
    for k in range(n):
        h = mix(h * U64(0x9E3779B97F4A7C15) + w[k : k + size])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            yield np.unique(h[a : b - n + 1])
        elif b > a:
            one = U64(b - a)
            for x in w[a:b]:
                one = mix(np.array([one], U64) * U64(0x9E3779B97F4A7C15) + x)[0]
            yield np.array([one], U64)
        else:
            yield np.zeros(0, U64)


def part_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the non-empty parts of a set, for each band it can be in.

    Where more parts are empty than the band spares, the set is dealt anew with the next seed as well.
    Of two linked sets, take the first seed at which either has few enough empty parts: both have keys
    for it, more parts are equal than empty, so they share a key.
    """
    out = []
    for c in bands.of(len(s)):
        k, seed = bands.parts[c], 0
        while True:
            h = s if seed == 0 else np.sort(mix(s + U64(seed * 0xD1B54A32D192ED03 & MASK64)))
            part = ((h >> U64(32)) * U64(k)) >> U64(32)
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            sums = np.concatenate([[U64(0)], np.cumsum(mix(h), dtype=U64)])
            total = sums[np.append(cut[1:], len(h))] - sums[cut]
            out.append(mix(total + mix(part[cut] + U64(((c << 40) + (seed << 32)) * 0xA24BAED4963EE407 & MASK64))))
            if k - len(cut) <= bands.spare[c]:
                break
            seed += 1
    return np.concatenate(out)


def features(docs: DataFrame, n: int, bands: Bands) -> DataFrame:
    """doc_id, th (identity of the text), n_shingles, h1 and h2 (128-bit hash of the set; null if empty), keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, raw, offsets in text_slices(b.column(2)):
                sizes, keys, ends, digests = [], [], [0], []
                for s in shingle_sets(raw, offsets, n):
                    sizes.append(len(s))
                    if len(s):
                        digests.append(hashlib.blake2b(s, digest_size=16).digest())
                        keys.append(part_keys(s, bands))
                    ends.append(ends[-1] + (len(keys[-1]) if len(s) else 0))
                none = np.array(sizes) == 0
                halves = np.zeros((len(sizes), 2), np.int64)
                halves[~none] = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                flat = pa.array(np.concatenate(keys).view(np.int64) if keys else [], pa.int64())
                made = [pa.array(sizes, pa.int64()), *[pa.array(halves[:, k].copy(), pa.int64(), mask=none) for k in (0, 1)], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *made], ["doc_id", "th", "n_shingles", "h1", "h2", "keys"])

    return docs.select(F.col("doc_id").cast("long"), text_key().alias("th"), "text").mapInArrow(run, "doc_id long, th string, n_shingles long, h1 long, h2 long, keys array<long>")


def bitmap(s: np.ndarray) -> np.ndarray:
    """Hashed bitmap of a set, four bits a shingle at least, a power of two; half of it folded on the other is that of half the size."""
    bits = 1 << max(6, int(4 * len(s) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(s & U64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out).view(U64)


def folded(maps: list[np.ndarray]) -> np.ndarray:
    """Bitmaps of one tile as rows of the smallest one's size."""
    least = min(len(m) for m in maps)
    return np.stack([np.bitwise_or.reduce(m.reshape(-1, least), axis=0) for m in maps])


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """(id, bits, shingles) of each vertex's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, raw, offsets in text_slices(b.column(1)):
                arrays = list(shingle_sets(raw, offsets, n))
                made = [pa.array([f(x).tobytes() for x in arrays], pa.binary()) for f in (bitmap, np.asarray)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *made], ["id", "bits", "shingles"])

    return texts.select("id", "text").mapInArrow(run, "id long, bits binary, shingles binary")


class Tile:
    """Rows of a tile by size. Pairs have at least one member in ``left`` and belong to different ``comps``.

    Of a pair (i, j), at most size(i) less the bits of i that j lacks can be shared, and the same the
    other way round.
    """

    def __init__(self, sizes: np.ndarray, maps: list[np.ndarray], comps: np.ndarray, left: np.ndarray, num: int, den: int):
        self.order = np.argsort(sizes, kind="stable")
        self.n, self.comp, self.left = sizes[self.order], comps[self.order].copy(), left[self.order]
        self.maps, self.num, self.den = folded([maps[i] for i in self.order]), num, den

    def partners(self, i: int) -> np.ndarray:
        """Rows after ``i`` that the bounds leave as its partners."""
        n, maps = self.n, self.maps
        j = np.arange(i + 1, np.searchsorted(n, n[i] * self.den // self.num, "right"))
        j = j[(self.comp[j] != self.comp[i]) & (self.left[j] | self.left[i])]
        if not len(j):
            return j
        only_i = np.bitwise_count(maps[i] & ~maps[j]).sum(1, dtype=np.int64)
        only_j = np.bitwise_count(maps[j] & ~maps[i]).sum(1, dtype=np.int64)
        most = np.minimum(n[i] - only_i, n[j] - only_j)
        return j[(self.num + self.den) * most >= self.num * (n[i] + n[j])]

    def live(self) -> np.ndarray:
        """Which rows (in the given order) have a partner that the bounds leave."""
        out = np.zeros(len(self.n), bool)
        for i in range(len(self.n) - 1):
            j = self.partners(i)
            if len(j):
                out[self.order[i]] = out[self.order[j]] = True
        return out

    def links(self, arrays: list[np.ndarray]) -> list[tuple[int, int]]:
        """Spanning forest of the links."""
        arrays, out = [arrays[i] for i in self.order], []
        for i in range(len(self.n) - 1):
            for k in self.partners(i):
                if self.comp[k] == self.comp[i]:
                    continue
                shared = len(np.intersect1d(arrays[i], arrays[k], assume_unique=True))
                if (self.num + self.den) * shared >= self.num * (self.n[i] + self.n[k]):
                    out.append((int(self.order[i]), int(self.order[k])))
                    self.comp[self.comp == self.comp[k]] = self.comp[i]
        return out


#: A row of a tile; ``pool`` tells which small tiles go to one task.
ROW = "id long, blocks long, n long, comp long, left boolean, tile long, pool long"
NAMES = [c.split()[0] for c in ROW.split(", ")]


def _in_tasks(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` (ROW) by task and set, with the columns of ``sets``: each set once a task, and the tiles it is in there.

    A tile of a large group is a task, tiles of small groups share tasks of bounded size.
    """
    small_tile = F.col("blocks") == 1
    held = rows.where(small_tile).agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    tasks = max(1, held["k"] // SMALL_ROWS, (held["n"] or 0) // TILE_SHINGLES)
    task = F.when(small_tile, F.pmod(F.xxhash64("pool"), F.lit(tasks))).otherwise(F.col("tile"))
    own = rows.withColumn("task", task).groupBy("task", "id", "n", "comp").agg(F.collect_list(F.struct("tile", "left", "blocks", "pool")).alias("places"))
    return own.join(sets, "id")


def _places(t: pa.Table) -> dict[str, np.ndarray]:
    """Columns of ROW, and ``at``: the row of ``t`` of each."""
    places = t["places"].combine_chunks()
    flat = places.flatten()
    at = np.repeat(np.arange(len(places)), np.diff(places.offsets.to_numpy()))
    own = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("tile", "left", "blocks", "pool")}
    return own | {c: t[c].to_numpy()[at] for c in ("id", "n", "comp")} | {"at": at}


def _each_tile(t: pa.Table, rows: dict[str, np.ndarray], num: int, den: int) -> Iterator[tuple[np.ndarray, Tile]]:
    """(numbers of its rows, tile) of every tile of a task with several rows."""
    order = np.argsort(rows["tile"], kind="stable")
    bits = t["bits"].combine_chunks()
    for own in np.split(order, np.flatnonzero(np.diff(rows["tile"][order])) + 1):
        if len(own) > 1:
            yield own, Tile(rows["n"][own], [np.frombuffer(bits[int(i)].as_buffer(), U64) for i in rows["at"][own]], rows["comp"][own], rows["left"][own], num, den)


def _tiles(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between components, found in the tiles of ``rows`` (ROW)."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        places, raw = _places(t), t["shingles"].combine_chunks()
        a, b = [], []
        for own, tile in _each_tile(t, places, num, den):
            for x, y in tile.links([np.frombuffer(raw[int(i)].as_buffer(), U64) for i in places["at"][own]]):
                a.append(int(places["comp"][own[x]]))
                b.append(int(places["comp"][own[y]]))
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _in_tasks(rows, sets).groupBy("task").applyInArrow(run, "a long, b long")


def _live(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those ``rows`` (ROW) that have a partner in their tile which the bounds leave."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        places = _places(t)
        live = np.zeros(len(places["at"]), bool)
        for own, tile in _each_tile(t, places, num, den):
            live[own] = tile.live()
        yield pa.RecordBatch.from_pydict({c: pa.array(places[c][live], pa.bool_() if c == "left" else pa.int64()) for c in NAMES})

    return _in_tasks(rows, sets.select("id", "bits")).groupBy("task").applyInArrow(run, ROW)


def _longs(top: str) -> F.Column:
    return F.sequence(F.lit(0).cast("long"), F.col(top) - 1)


def _first_links(met: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links found where each vertex goes to the largest of its groups; some pivots of a large group go to all its tiles."""
    one = met.groupBy("id").agg(F.min(F.struct((-F.col("k")).alias("o"), "key", "k", "blocks", "n")).alias("g")).select("id", "g.key", "g.k", "g.blocks", "g.n")
    pivot = F.pmod(F.xxhash64("id", F.lit(1)), "k") < PIVOTS
    tiles = F.when((F.col("blocks") > 1) & pivot, _longs("blocks")).otherwise(F.array(F.pmod(F.xxhash64("id"), "blocks")))
    rows = one.withColumn("b", F.explode(tiles)).withColumn("tile", F.xxhash64("key", "b"))
    rows = rows.select("id", "blocks", "n", F.col("id").alias("comp"), F.lit(True).alias("left"), "tile", F.col("tile").alias("pool"))
    return _tiles(written(rows, "rows"), sets, num, den)


def _groups(pairs: DataFrame, tile: int, name: str) -> DataFrame:
    """(key, id, n, k, tile, blocks) of the groups of ``pairs`` (id, n, key) that have several members."""
    shared = pairs.groupBy("key").agg(F.count("*").alias("k"), F.max("n").alias("most")).where("k > 1")
    rows = F.greatest(F.lit(min(LEAST_TILE, tile)), F.least(F.lit(tile), F.floor(F.lit(TILE_SHINGLES) / F.col("most")))).alias("tile")
    shared = written(shared.select("key", "k", rows).withColumn("blocks", F.ceil(F.col("k") / F.col("tile"))), "shared")
    met = written(pairs.join(shared, "key"), name)
    forget(shared)
    return met


def _open(met: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of the groups that hold several components, with their component and how many rows are outside the largest.

    Of groups with the same members (told by a 128-bit hash of them all) one is enough.
    """
    labelled = written(met.join(comps, F.col("id") == F.col("node"), "left").select("key", "blocks", "tile", "n", "id", F.coalesce("component", "id").alias("comp")), "labelled")
    both = lambda x, y: [F.bit_xor(x).alias("x"), F.bit_xor(y).alias("y")]
    by = labelled.groupBy("key", "comp").agg(F.count("*").alias("k"), F.min("id").alias("id"), *both(F.xxhash64("id"), F.xxhash64("id", F.lit(3))))
    main = by.groupBy("key").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").alias("k"), F.max("k").alias("most"), F.min("id").alias("id"), *both("x", "y")).where("k > most")
    main = main.groupBy("k", "x", "y").agg(F.min_by(F.struct("key", "main", (F.col("k") - F.col("most")).alias("rest"), F.when(F.col("k") <= FAMILY, F.col("id")).alias("pool")), "key").alias("g")).select("g.*")
    rows = written(labelled.join(written(main, "main"), "key").withColumn("left", F.col("comp") != F.col("main")), "open")
    forget(labelled)
    return rows


def _rare_keys(ids: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """(id, n, key): keys of each set's rarest shingles, of which two linked sets share one.

    Sets of a band differ in so many shingles at most; of one more, taken rarest first in one order for
    all, the first shared shingle is among both sets' own. Shingles that no other set has need no key.
    """

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(1)]
            sizes = [len(x) for x in arrays]
            if arrays:
                yield pa.RecordBatch.from_pydict({"id": np.repeat(b.column(0).to_numpy(), sizes), "n": np.repeat(np.array(sizes, np.int64), sizes), "x": np.concatenate(arrays)})

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys = [], []
            for i, (n, shared) in enumerate(zip(b.column(1).to_pylist(), b.column(2))):
                own = shared.values.to_numpy().view(U64)
                for c in bands.of(n):
                    took = own[: max(0, bands.parts[c] - bands.spare[c] - (n - len(own)))]
                    keys.append(mix(took + U64((c + 1) * 0xA24BAED4963EE407 & MASK64)))
                    at += [i] * len(took)
            take = pa.array(at, pa.int64())
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(flat)], ["id", "n", "key"])

    items = written(sets.join(ids, "id", "left_semi").select("id", "shingles").mapInArrow(every, "id long, n long, x long"), "items")
    often = items.groupBy("x").agg(F.count("*").alias("k")).where("k > 1")
    rare = items.join(written(often, "often"), "x").groupBy("id", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda r: r["x"]).alias("shared"))
    keys = written(rare.select("id", "n", "shared").mapInArrow(keyed, "id long, n long, key long"), "keys")
    forget(items)
    return keys


def _other_links(met: DataFrame, sets: DataFrame, comps: DataFrame, bands: Bands, tile: int) -> DataFrame:
    """Links between different components inside all groups that still hold several.

    Members of groups of more than one tile are grouped anew by their rarest shingles, so that texts which
    only have a frequent passage in common no longer meet. What is still larger than a tile is compared
    tile by tile, the rest with all.
    """
    rows = _open(met, comps)
    single = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "left"))
    small_groups, large = rows.where("blocks = 1"), rows.where("blocks > 1")
    done = small_groups.select("key", "blocks", "n", "id", "comp", "pool", F.inline(single))
    if not large.isEmpty():
        again = _open(_groups(_rare_keys(large.select("id").distinct(), sets, bands), tile, "met again"), comps)
        again = again.withColumn("rests", F.ceil(F.col("rest") / F.col("tile")))
        a, b = F.pmod(F.xxhash64("id", F.lit(2)), "rests"), F.pmod(F.xxhash64("id"), "blocks")
        each = lambda x, y, left: F.struct(x.alias("a"), y.alias("b"), F.lit(left).alias("left"))
        as_right = F.transform(_longs("rests"), lambda x: each(x, b, False))
        as_left = F.transform(_longs("blocks"), lambda x: each(a, x, True))
        product = F.when(F.col("left"), F.concat(as_left, as_right)).otherwise(as_right)
        done = done.unionByName(again.select("key", "blocks", "n", "id", "comp", "pool", F.inline(F.when(F.col("blocks") == 1, single).otherwise(product))))
    tile_of = F.xxhash64("key", "a", "b")
    done = written(done.select("id", F.col("blocks").cast("long").alias("blocks"), "n", "comp", "left", tile_of.alias("tile"), F.coalesce("pool", tile_of).alias("pool")), "rows")
    live = written(_live(done, sets, bands.num, bands.den), "live")
    links = written(_tiles(live, sets, bands.num, bands.den), "links")
    forget(rows, done, live)
    return links


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, tile: int = TILE, text_hash: bool = False, send_rows: int = SEND_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``; with ``text_hash`` also th, the ``text_key`` of its text, and
    component, a number of its own for each component (null without shingles), as one id may stand on texts of several.

    Two texts link when ``den`` * shared >= ``num`` * united shingles. component_id is the smallest
    doc_id reachable by links. Null texts and texts without words have no shingles and are linked with
    nothing. Rows with equal sets (repeated rows among them) are linked with each other. Null ids are
    never a component's name while another id is there. An empty table gives no rows. Other columns
    of ``docs`` are ignored. ``tile``: rows of a tile at most; ``send_rows``: see ``SEND_ROWS``.
    """
    bands = Bands(num, den)
    feats = written(features(docs, n, bands), "features")
    # one row for each distinct set, numbered; one of its documents stands for it
    own = feats.where("h1 is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "th")).alias("d"), F.any_value("n_shingles").alias("n"), F.any_value("keys").alias("keys"))
    own = written(own.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "n", "first", "d.doc_id", "d.th", "keys"), "vertices")
    met = _groups(own.select("id", "n", F.explode("keys").alias("key")), tile, "met")
    chosen = written(own.join(met.select("id").distinct(), "id", "left_semi").select("id", F.col("doc_id").alias("d"), "th"), "chosen")
    texts = docs.select(F.col("doc_id").cast("long").alias("d2"), text_key().alias("th2"), "text")
    texts = texts.join(small(chosen, send_rows), F.col("th2").eqNullSafe(F.col("th")) & F.col("d2").eqNullSafe(F.col("d"))).select("id", "text")
    sets = written(_sets(texts, n).dropDuplicates(["id"]).drop("n"), "sets")
    first = components(_first_links(met, sets, num, den))
    more = components(_other_links(met, sets, first, bands, tile))
    moved = more.select(F.col("node").alias("component"), F.col("component").alias("last"))
    comps = first.unionByName(more.select("node", F.col("node").alias("component"))).dropDuplicates(["node"]).join(moved, "component", "left").select("node", F.coalesce("last", "component").alias("comp"))
    # vertices to components, components to their smallest document
    linked = written(own.select("id", "first").join(comps, F.col("id") == F.col("node")).select("id", "first", "comp"), "linked")
    names = linked.groupBy("comp").agg(F.min("first").alias("name"))
    named = own.select("id", "h1", "h2", "first").join(linked.join(names, "comp").select("id", "comp", "name"), "id", "left")
    named = written(named.select("h1", "h2", F.coalesce("name", "first").alias("component_id"), F.coalesce("comp", "id").alias("component")), "named")
    forget(own, met, chosen, sets, linked)
    extra = ["th", "component"] if text_hash else []
    out = feats.select("doc_id", "n_shingles", "h1", "h2", *extra[:1]).join(named, ["h1", "h2"], "left")
    return out.select("doc_id", *extra, "n_shingles", F.when(F.col("h1").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


DIGEST_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\v\f\r]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT rid, x FROM (
    SELECT rid, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
f AS (SELECT x, count(*) AS c FROM s GROUP BY x),
p AS (
  SELECT rid, x, n, row_number() OVER (PARTITION BY rid ORDER BY c, x) AS k FROM s JOIN n USING (rid) JOIN f USING (x)),
q AS (SELECT rid, x, n FROM p WHERE k <= n - CAST(ceil(n * 0.9 - 1e-9) AS BIGINT) + 1),
cand AS (
  SELECT DISTINCT a.rid AS a, b.rid AS b FROM q a JOIN q b USING (x)
  WHERE a.rid < b.rid AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)),
shared AS (SELECT a, b, count(*) AS i FROM cand JOIN s x ON x.rid = a JOIN s y ON y.rid = b AND y.x = x.x GROUP BY a, b),
links AS (
  SELECT a, b FROM shared JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
reach AS (
  WITH RECURSIVE r(a, b) AS (
    SELECT rid, rid FROM w
    UNION
    SELECT r.a, l.b FROM r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.b)
  SELECT a, b FROM r)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (rid)
JOIN (SELECT a, min(d.doc_id) AS component_id FROM reach JOIN w d ON d.rid = b GROUP BY a) c ON c.a = w.rid
"""
