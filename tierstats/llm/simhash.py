"""SimHash near-duplicates: exact comparison of fingerprint tiles with numpy xor and bit counts.

``near_duplicates`` links fingerprints within a radius. ``near_copies`` links texts whose shingle sets have a given
similarity: there bands of longer fingerprints and a wide radius propose pairs, and the whole sets decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierstats.operators.graph import connected_components, stars
from tierstats.sources.shared import discard

from .common import lookup_join, staged
from .words import LOWER, chunks, mix, whole_windows, window_hashes, word_hashes

SEED = 42
#: Sets of similarity 0.8 differ in 15 % of the bits of their fingerprints (two of 4 and 5 shingles in 19 %), unrelated ones in half.
#: A band is BITS bits of a fingerprint, and such pairs share one of BANDS bands with a probability of 1 - (1 - 0.85^BITS)^BANDS =
#: 0.9999, more above; sets of at most SMALL shingles have MORE bands, and sets of fewer than LEAST are only like equal ones.
BANDS, MORE, BITS, SMALL, LEAST = 64, 128, 12, 16, 4
#: Of 128 further bits sets of similarity 0.8 differ in 19.4 (standard deviation 4.1), unrelated ones in 64 (5.7); above WIDE bits sets
#: are not compared, or, where a group is compared by sets, those of at least FEW shingles.
WIDE, FEW = 38, 64
#: Fingerprints in a tile of a band's group, and sets whose bits are held at once.
BAND_TILE, SIGNED = 1 << 14, 256
#: Shingles in a tile of a candidate group.
SET_TILE = 1 << 21
_TABLE = np.frombuffer(LOWER, np.uint8)
#: A seed for each 64 bits: two of the radius, then those of the bands.
_SEEDS = mix(np.arange(1, 3 + MORE * BITS // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fingerprint(text: bytes, k: int = 4) -> int:
    """Signed 64-bit SimHash of the k-word shingles, repeats included; 0 if there is no word."""
    words = text.translate(LOWER).split()  # bytes.split() cuts at the six ASCII spaces
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - k].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, len(words) - k + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """(id, fp) for each row; null text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            fps = [fingerprint(t.as_py() or b"", k) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, fp long")


def _tile_links(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each of ``left`` to ``right`` within the radius. Both are cut into tiles in order of population count, and
    only the part of ``right`` is compared whose counts differ by the radius at most."""
    left, right = (x[np.argsort(np.bitwise_count(x), kind="stable")] for x in (left, right))
    low, pc = np.bitwise_count(left).astype(np.int64), np.bitwise_count(right).astype(np.int64)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        first, last = np.searchsorted(pc, low[at] - radius), np.searchsorted(pc, low[min(at + 256, len(left)) - 1] + radius, "right")
        for start in range(first, last, 1 << 14):
            part = right[start : min(last, start + (1 << 14))]
            i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ part[None, :]) <= radius)
            a, b = stars(rows[i].view(np.int64), part[j].view(np.int64))
            found_a.append(a)
            found_b.append(b)
    return stars(np.concatenate(found_a), np.concatenate(found_b))


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by group (combo, value, kind, x, y); a group is at most two tiles."""

    def solve(group: np.ndarray, active: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        sizes = np.diff(np.append(edges, len(group)))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        tiny = np.repeat(sizes <= 64, sizes)
        g, f = group[tiny], fp[tiny]
        for d in range(1, int(sizes[sizes <= 64].max(initial=1))):  # small groups together: each row with the d-th after it
            same = np.flatnonzero((g[d:] == g[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= radius))
            a.append(f[same].view(np.int64))
            b.append(f[same + d].view(np.int64))
        for at, n in zip(edges[sizes > 64], sizes[sizes > 64], strict=True):
            f = fp[at : at + n]
            x, y = _tile_links(f[active[at : at + n]], f, radius)
            a.append(x)
            b.append(y)
        a, b = stars(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(c)) for c in ("combo", "value", "kind", "x", "y", "fp")] + [batch.column("active").to_numpy(zero_copy_only=False)]
        if held is not None:
            keys = [np.concatenate([x, y]) for x, y in zip(held, keys, strict=True)]
        change = np.zeros(len(keys[0]), np.int64)
        for x in keys[:5]:
            change[1:] |= x[1:] != x[:-1]
        group = np.cumsum(change)
        last = int(np.searchsorted(group, group[-1]))
        held = [x[last:] for x in keys]
        if last:
            yield solve(group[:last], keys[6][:last], keys[5][:last].view(np.uint64))
    if held is not None:
        yield solve(np.zeros(len(held[0]), np.int64), held[6], held[5].view(np.uint64))


def block_masks(n: int, radius: int, tile: int, most: int = 64) -> list[int]:
    """Masks of which any two fingerprints within the radius share at least one: 64 bits are cut into blocks, the
    differing bits touch at most ``radius`` of them, and every choice of that many fewer blocks is a mask. More
    blocks make longer masks, so that n fingerprints fall into groups of about a tile at most; as each fingerprint is
    written once for each mask, there are at most ``most`` masks (and at least radius + 1)."""
    found: list[int] = []
    for extra in range(1, 5):
        blocks = radius + extra
        if found and comb(blocks, extra) > most:
            break
        edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
        found = [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in kept) for kept in combinations(range(blocks), extra)]
        if n <= tile << (64 * extra // blocks):
            break
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def group_components(rows: DataFrame, by: list[str], weight: Column, key: str, tile: int, compare: Callable[[DataFrame], DataFrame], salts: int = 3) -> DataFrame:
    """rows (``by``, ``key``, ...) -> (node, root): the components of the links inside groups of equal ``by``. No pair of rows
    of one group is lost, whatever the group's size.

    A group whose weights sum up to no more than a tile is compared as it is. A larger one is first dealt to tiles by
    ``salts`` different hashes, and each tile is compared by itself; rows that are alike are nearly all in one
    component then. Pairs inside a component need no look, so in a second pass only the rows outside the group's
    largest component meet all others, by pairs of tiles.

    compare: rows (``by``, kind, x, y, active, ...) -> links (a, b) of every active row with all rows of its
    (``by``, kind, x, y).
    """
    spark = rows.sparkSession
    sizes = rows.groupBy(*by).agg(F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*by, F.ceil(F.col("w") / tile).alias("tiles"))
    # written first: between two plain exchanges Spark splits the partition of a hot group
    sizes = staged(sizes, "simhash-groups")
    sized = rows.join(sizes.hint("merge"), by)
    salt = F.explode(F.when(F.col("tiles") > 1, F.array(*(F.lit(i) for i in range(salts)))).otherwise(F.array(F.lit(0))))
    dealt = sized.withColumn("kind", salt).withColumns({"x": F.pmod(F.xxhash64(key, "kind"), F.col("tiles")), "y": F.lit(0).cast("long"), "active": F.lit(True)})
    links = staged(compare(dealt.drop("tiles")), "simhash-links")
    if sizes.where("tiles > 1").isEmpty():
        return connected_components(links)
    roots = connected_components(links)
    hot = sized.where("tiles > 1").drop("tiles").join(roots.hint("merge"), F.col(key) == F.col("node"), "left")
    hot = staged(hot.withColumn("root", F.coalesce("root", key)).drop("node"), "simhash-hot")
    parts = hot.groupBy(*by, "root").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
    main = parts.groupBy(*by).agg(F.max_by(F.struct("root", "w"), F.struct("n", "root")).alias("m"), F.sum("w").alias("w"))
    main = main.select(*by, F.col("m.root").alias("main"), F.ceil(F.col("m.w") / tile).alias("n_main"), F.ceil((F.col("w") - F.col("m.w")) / tile).alias("n_rest")).where("n_rest > 0")
    split = hot.join(staged(main, "simhash-main").hint("merge"), by)
    split = split.withColumn("active", F.col("root") != F.col("main"))
    slot = F.pmod(F.xxhash64(F.col(key), F.lit(0)), F.when(F.col("active"), F.col("n_rest")).otherwise(F.col("n_main")))
    split = split.withColumn("slot", slot)
    with_main = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_main") - 1), lambda j: F.struct(F.lit(0).alias("kind"), F.col("slot").alias("x"), j.alias("y")))
    with_rest = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_rest") - 1), lambda j: F.struct(F.lit(1).alias("kind"), F.least("slot", j).alias("x"), F.greatest("slot", j).alias("y")))
    of_main = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_rest") - 1), lambda i: F.struct(F.lit(0).alias("kind"), i.alias("x"), F.col("slot").alias("y")))
    meets = F.when(F.col("active"), F.concat(with_main, with_rest)).otherwise(of_main)
    split = split.withColumn("p", F.explode(meets)).withColumns({c: F.col(f"p.{c}") for c in ("kind", "x", "y")}).drop("p", "slot", "root", "main", "n_main", "n_rest")
    more = compare(split)
    both = links.unionByName(more).unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    out = connected_components(both)
    for done in (sizes, links, hot):
        discard(spark, done)
    return out


def fingerprint_components(distinct: DataFrame, radius: int = 4, tile: int = 2048) -> DataFrame:
    """distinct (fp), one row each -> (node, root): components of fingerprints within ``radius`` differing bits.

    Exact at any size. Fingerprints that share a mask's bits are a group, compared by tiles. From each come links to the
    smallest member of each local component, never all pairs.
    """
    masks = block_masks(distinct.count(), radius, tile)
    key = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("combo"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for i, m in enumerate(masks))))
    rows = distinct.select("fp", key.alias("k")).select("fp", "k.combo", "k.value")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = ["combo", "value", "kind", "x", "y"]

    def compare(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select(*group, "active", "fp").repartition(parts, *group).sortWithinPartitions(*group)
        return dealt.mapInArrow(partial(_links, radius=radius), "a long, b long")

    return group_components(rows, ["combo", "value"], F.lit(1), "fp", tile, compare)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, radius: int = 4, tile: int = 2048) -> DataFrame:
    """(id_col, fp, component_id) for each row of ``docs``.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest id reachable over
    links, the own id included. Equal fingerprints are compared once. Texts without a word, also null, have
    fingerprint zero and link like any other. Null ids: kept, not candidates for the smallest id unless the
    whole component has none. Rows that share an id keep a row each. Empty table: empty result. Other columns
    are not carried.
    """
    fps = staged(fingerprints(docs, id_col, text_col, k), "simhash")
    distinct = staged(fps.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-distinct")
    roots = fingerprint_components(distinct.select("fp"), radius, tile)
    linked = staged(lookup_join(distinct, roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = staged(linked.groupBy("root").agg(F.min("rep").alias("component_id")), "simhash-least")
    of_fp = staged(linked.join(least.hint("merge"), "root").select(F.col("fp").alias("f"), "component_id"), "simhash-components")
    out = fps.join(of_fp.hint("merge"), F.col("fp") == F.col("f"))
    return out.select(F.col("id").alias(id_col), "fp", "component_id")


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sizes, hashes) for each chunk of rows: how many distinct shingles of k words each row has, and their
    hashes, sorted, row by row. A text of fewer words is one shingle, a text without words has none."""
    for c in chunks(column):
        words = word_hashes(_TABLE[c.data], c.starts, c.ends)
        at, n = whole_windows(c.first, k), c.n_words
        owners, hashes = [c.doc_of_word()[at]], [window_hashes(words, k)[at]]
        for short in range(1, k):
            rows = np.flatnonzero(n == short)
            if len(rows):
                owners.append(rows)
                hashes.append(window_hashes(words, short)[c.first[rows]])
        owner, h = np.concatenate(owners), np.concatenate(hashes)
        order = np.lexsort((h, owner))
        owner, h = owner[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
        yield c.lo, np.bincount(owner[new], minlength=len(n)), h[new]


def set_bits(sizes: np.ndarray, h: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """(sets, 64 bits a seed): the SimHash of each set for every seed; zero for an empty set. So that small sets of an even size lean to
    neither side, a bit that half of the shingles have is decided by small weights of the shingles, in sets of FEW and more by one."""
    out, ends, lo, hi = np.zeros((len(sizes), 64 * len(seeds)), np.uint8), np.cumsum(sizes), 0, 0
    for i in np.flatnonzero(sizes):
        count, tie, few = np.zeros(out.shape[1], np.int64), None, sizes[i] < FEW
        for at in range(ends[i] - sizes[i], ends[i], 255):  # so many are added up in a byte
            to = min(ends[i], at + 255)
            if to > hi:
                lo, hi = at, min(len(h), at + (1 << 12))
                words = mix(h[lo:hi, None] ^ seeds)
            bits = np.unpackbits(words[at - lo : to - lo].view(np.uint8), axis=1, bitorder="little")
            if few:
                weight = (1 << 14) + np.roll(words[at - lo : to - lo].view(np.uint8), 8, axis=1).astype(np.float32)  # one for eight bits
                out[i] = (2 * np.einsum("nbk,nb->bk", bits.reshape(*weight.shape, 8), weight) > weight.sum(axis=0)[:, None]).ravel()
            else:
                tie = bits[0] if tie is None else tie
                count += bits.sum(axis=0, dtype=np.uint8)
        if not few:
            out[i] = 2 * count + tie > sizes[i]
    return out


def band_values(bits: np.ndarray, first: int = 0) -> np.ndarray:
    """(sets, bands): a number for each BITS bits of a row, different for each band."""
    values = bits.reshape(len(bits), bits.shape[1] // BITS, BITS).astype(np.int32) @ (1 << np.arange(BITS, dtype=np.int32))
    return values + ((first + np.arange(values.shape[1], dtype=np.int32)) << BITS)


def _signatures(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    cut = 2 + BANDS * BITS // 64
    for b in batches:
        for lo, sizes, h in shingle_sets(b.column(2), k):
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for x in range(0, len(sizes), SIGNED):
                y = min(len(sizes), x + SIGNED)
                n, own = sizes[x:y], h[ends[x] : ends[y]]
                filled, key = np.flatnonzero(n), np.zeros(y - x, np.uint64)
                if len(filled):
                    key[filled] = mix(np.add.reduceat(mix(own), (np.cumsum(n) - n)[filled]) + n[filled].astype(np.uint64))
                bits = set_bits(n, own, _SEEDS[:cut])
                fps = np.packbits(bits[:, :128], axis=1, bitorder="little").view(np.int64)
                small = (n >= LEAST) & (n <= SMALL)
                bands = np.zeros((y - x, MORE), np.int32)
                bands[:, :BANDS] = band_values(bits[:, 128:])
                bands[small, BANDS:] = band_values(set_bits(n[small], own[np.repeat(small, n)], _SEEDS[cut:]), BANDS)
                many = np.where(small, MORE, np.where(n >= LEAST, BANDS, 0))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(bands[np.arange(MORE) < many[:, None]]))
                cols = [b.column(0).slice(lo + x, y - x), b.column(1).slice(lo + x, y - x), pa.array(key.view(np.int64)), pa.array(fps[:, 0]), pa.array(fps[:, 1]), pa.array(n.astype(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "id", "key", "fp", "fp2", "size", "bands"])


def _proposals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (band, kind, x, y, active, key, fp, fp2, size) sorted by group (band, kind, x, y) -> (a, b): links of sets whose fingerprints
    are within WIDE bits and whose sizes allow a similarity of 0.8, of every active row with all of its group."""

    def near(f: np.ndarray, g: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        close = np.bitwise_count(f[0] ^ g[0]) + np.bitwise_count(f[1] ^ g[1]) <= WIDE
        return close & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))

    def solve(group: np.ndarray, active: np.ndarray, key: np.ndarray, f: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        rows = np.diff(np.append(edges, len(group)))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = np.flatnonzero(np.repeat(rows <= 128, rows))
        for d in range(1, int(rows[rows <= 128].max(initial=1))):  # small groups together: each row with the d-th after it
            at = at[at + d < len(group)]
            at = at[group[at + d] == group[at]]
            same = at[near(f[:, at], f[:, at + d], n[at], n[at + d])]
            a.append(key[same])
            b.append(key[same + d])
        for start, size in zip(edges[rows > 128], rows[rows > 128], strict=True):
            own = slice(start, start + size)
            left = start + np.flatnonzero(active[own])
            for i in range(0, len(left), 64):
                part = left[i : i + 64]
                x, y = np.nonzero(near(f[:, part, None], f[:, None, own], n[part, None], n[None, own]))
                x, y = stars(key[part[x]], key[start + y])
                a.append(x)
                b.append(y)
        a, b = stars(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(9)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        change = np.zeros(len(cols[0]), np.int64)
        for x in cols[:4]:
            change[1:] |= x[1:] != x[:-1]
        group = np.cumsum(change)
        last = int(np.searchsorted(group, group[-1]))
        held = [x[last:] for x in cols]
        if last:
            yield solve(group[:last], cols[4][:last], cols[5][:last], np.stack([x[:last].view(np.uint64) for x in cols[6:8]]), cols[8][:last])
    if held is not None:
        yield solve(np.zeros(len(held[0]), np.int64), held[4], held[5], np.stack([x.view(np.uint64) for x in held[6:8]]), held[8])


def proposed_groups(sets: DataFrame, tile: int | None = None) -> DataFrame:
    """sets (key, fp, fp2, size, bands) -> (group, key): components of the sets that share a band and are within WIDE bits, those of two
    sets or more. Groups of more than a tile of fingerprints are compared by tiles, so none is too large."""
    spark, tile = sets.sparkSession, tile or BAND_TILE
    rows = sets.select("key", "fp", "fp2", "size", F.explode("bands").alias("band"))
    parts, place = int(spark.conf.get("spark.sql.shuffle.partitions")), ["band", "kind", "x", "y"]

    def compare(dealt: DataFrame) -> DataFrame:
        dealt = dealt.select(*place, "active", "key", "fp", "fp2", "size").repartition(parts, *place).sortWithinPartitions(*place)
        return dealt.mapInArrow(_proposals, "a long, b long")

    plain = {"kind": F.lit(0), "x": F.lit(0).cast("long"), "y": F.lit(0).cast("long"), "active": F.lit(True)}
    hot = staged(rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile).select("band"), "copy-hot")
    if hot.isEmpty():
        links = compare(rows.withColumns(plain))
    else:  # as many as there are values of bands at most
        warm = group_components(rows.join(F.broadcast(hot), "band", "left_semi"), ["band"], F.lit(1), "key", tile, compare)
        links = compare(rows.join(F.broadcast(hot), "band", "left_anti").withColumns(plain)).unionByName(warm.select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = connected_components(links)
    return roots.select(F.col("root").alias("group"), F.col("node").alias("key")).unionByName(roots.select(F.col("root").alias("group"), F.col("root").alias("key")).distinct())


def similar(keys: np.ndarray, active: np.ndarray, fps: np.ndarray, sizes: np.ndarray, h: np.ndarray) -> list[tuple[int, int]]:
    """Links (key, key) that join all active sets with all sets of similarity 0.8 or more: each active set is compared with
    those not reached yet and the inactive ones, first its fingerprint with all of theirs by exclusive-or and bit count,
    then its shingles with those of the sets within WIDE bits."""
    ids, links = np.unique(h, return_inverse=True)[1], []
    flag = np.zeros(len(h), bool)
    left, left_ids, ends = np.arange(len(keys)), ids, np.cumsum(sizes)
    starts, reached = ends - sizes, []
    while len(left):
        if reached:
            i = reached.pop()
        else:
            at = int(np.argmax(active[left]))
            i = left[at]
            if not active[i]:
                break
            before = int(sizes[left[:at]].sum())
            left, left_ids = np.delete(left, at), np.delete(left_ids, slice(before, before + sizes[i]))
            if not len(left):
                break
        mine, n = ids[starts[i] : ends[i]], sizes[left]
        close = (np.bitwise_count(fps[left] ^ fps[i]).sum(axis=1) <= WIDE) | (n < FEW) | (sizes[i] < FEW)
        close &= 5 * np.minimum(n, sizes[i]) >= 4 * np.maximum(n, sizes[i])
        if not close.any():
            continue
        flag[mine] = True
        own = n[close]
        common = np.add.reduceat(flag[left_ids[np.repeat(close, n)]], np.cumsum(own) - own, dtype=np.int64)
        flag[mine] = False
        near = np.zeros(len(left), bool)
        near[close] = 5 * common >= 4 * (own + sizes[i] - common)
        if near.any():
            links += [(int(keys[i]), int(keys[j])) for j in left[near]]
            near &= active[left]
            reached += left[near].tolist()
            left_ids, left = left_ids[np.repeat(~near, n)], left[~near]
    return links


def _set_links(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Batches (group, kind, x, y, active, key, fp, fp2, text) sorted by (group, kind, x, y) -> (a, b)."""
    group, held = None, []

    def solve() -> pa.RecordBatch:
        found = similar(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for b in batches:
        place = np.stack([np.asarray(b.column(i)) for i in range(4)])
        active = b.column(4).to_numpy(zero_copy_only=False)
        keys, fps = np.asarray(b.column(5)), np.stack([np.asarray(b.column(i)).view(np.uint64) for i in (6, 7)], axis=1)
        for lo, sizes, h in shingle_sets(b.column(8), k):
            at, ends = place[:, lo : lo + len(sizes)], np.concatenate([[0], np.cumsum(sizes)])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), len(sizes)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if (now := tuple(at[:, x].tolist())) != group:
                    if held:
                        yield solve()
                    group, held = now, []
                held.append((keys[lo + x : lo + y], active[lo + x : lo + y], fps[lo + x : lo + y], sizes[x:y], h[ends[x] : ends[y]]))
    if held:
        yield solve()


def near_copies(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """(row_col, kept) for each row of ``docs``: the row that stays for it.

    Rows are linked if the sets of their k-word shingles (words at ASCII space, A-Z lower-cased) have a Jaccard
    similarity of 0.8 or more; of all that are reachable over links the row of smallest (id, row) stays, null ids last.
    Texts without a word, also null, are copies of each other only. ``row_col`` must be unique and written (long).

    Equal sets are compared once. SimHash proposes: sets that share a band of their fingerprints and are within the radius
    WIDE are linked, and what is connected is a group. A group is compared by tiles, and every pair of it within the radius is
    checked on the whole sets. Sets and shingles are told apart by 64-bit hashes.

    Long texts are read whole, repeated rows are copies of each other, an empty table gives an empty result. Other
    columns are not carried, so their names cannot clash.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(row_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = staged(rows.mapInArrow(partial(_signatures, k=k), f"row long, id {id_type}, key long, fp long, fp2 long, size long, bands array<int>"), "copy-signatures")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row"))
    sets = staged(signed.groupBy("key").agg(least.alias("least"), *(F.first(c).alias(c) for c in ("fp", "fp2", "size", "bands"))), "copy-sets")
    groups = staged(proposed_groups(sets), "copy-groups")
    members = staged(sets.select("key", "fp", "fp2", "size", F.col("least.row").alias("row")).join(groups.hint("merge"), "key"), "copy-members")
    wanted = members.select("row", "key")
    texts = staged(rows.select("row", "text").join(wanted.hint("merge"), "row").select("key", "text"), "copy-texts")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = ["group", "kind", "x", "y"]

    def compare(dealt: DataFrame) -> DataFrame:
        with_text = dealt.join(texts.hint("merge"), "key").select(*group, "active", "key", "fp", "fp2", "text")
        with_text = with_text.repartition(parts, *group).sortWithinPartitions(*group)
        return with_text.mapInArrow(partial(_set_links, k=k), "a long, b long")

    roots = group_components(members.drop("row"), ["group"], F.col("size"), "key", SET_TILE, compare)
    of_set = staged(sets.select("key", "least").join(roots.hint("merge"), F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("root", "key").alias("root")), "copy-roots")
    kept = staged(of_set.groupBy("root").agg(F.min("least").alias("least")).select("root", F.col("least.row").alias("kept")), "copy-least")
    of_set = staged(of_set.join(kept.hint("merge"), "root").select("key", "kept"), "copy-components")
    for done in (sets, groups, members, texts, kept):
        discard(docs.sparkSession, done)
    return signed.select("row", "key").join(of_set.hint("merge"), "key").select(F.col("row").alias(row_col), "kept")


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
