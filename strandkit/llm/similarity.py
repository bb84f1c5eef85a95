"""N-gram Jaccard join: links between documents whose shingle sets are similar, and the classes that links make.

Sets are 64-bit hashes; equal sets are one from the start. All sets sort their members alike, the rarest first by a sketch of
frequencies. A set that lacks at most f of its members in a partner has one that they share among its first f + 1, so these members,
with the band of the set's size, name its tiles; a set is in the tiles of its own band and of the next if it can link into that. Tiles of
one set are dropped. In a tile of up to TILE sets those meet that the sizes, and the places of the shared member, allow to link. In a larger
tile every set first meets the busiest one, and what is then still in different components meets in blocks: a task holds two blocks and
compares their hashed bitmaps. Every pair that met has its bitmaps compared, whose length follows the size: bit counts bound the
overlap from above, and only pairs that may link go on to the exact intersection of sorted arrays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import ExitStack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, fresh, tidied, write_table

WORDS, THRESHOLD = 5, 80
#: Sets up to which a tile's pairs are met by a join of ids; and members of a block in larger ones, about.
TILE, BLOCK = 64, 2048
#: Ids up to which a side is broadcast; beyond it the same join is shuffled.
BROADCAST_ROWS = 500_000
#: Slots of the frequency sketch that orders the members of sets: 2 to this power, whatever the input; and slots a row of counts.
SLOT_BITS, CHUNK = 17, 1 << 10
#: A member may be common if its slot has more than so many times the mean; others hold at most that share of all members.
COMMON = 4
#: Bytes of texts that are hashed at once; and pairs that are checked at once.
PIECE, PAIRS = 1 << 18, 256
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0xD6E8FEB86659FD93
_BYTES = np.random.default_rng(20).integers(1, 1 << 64, 256, np.uint64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_POWERS: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _B
    h = (h ^ (h >> np.uint64(29))) * _A
    return h ^ (h >> np.uint64(32))


def slots_of(s: np.ndarray) -> np.ndarray:
    return (s * _B) >> np.uint64(64 - SLOT_BITS)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * PIECE + (1 << 16))
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the bytes, by its bytes alone, and where the words begin.

    A running sum of a random number a byte times a power of the base gives each word's polynomial as a difference, which the inverse
    power moves to the front.
    """
    b = np.frombuffer(raw, np.uint8)
    solid = np.r_[False, ~_SPACE[b], False]
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = _powers(len(b))
    sums = np.r_[np.uint64(0), np.cumsum(_BYTES[b] * up[: len(b)])]
    return _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _A), start


def shingle_sets(texts: Iterable[str | None], words: int) -> Iterator[np.ndarray]:
    """For every text, in order: sorted distinct hashes of all runs of `words` words, A-Z lower-cased; of the whole sequence if it is
    shorter; none without words. Short texts are hashed many at a time, long ones in pieces."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        # bytes: exactly A-Z, and exactly ASCII white space
        held.append(text.encode("utf-8", "surrogatepass").lower() if text else b"")
        size += len(held[-1]) + 1
        if size >= PIECE:
            yield from _sets_of(held, words)
            held, size = [], 0
    yield from _sets_of(held, words)


def _sets_of(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    raw, at, hashes, starts = b"\n".join(texts), 0, [], []
    while at < len(raw):
        cut = len(raw) if len(raw) - at <= 2 * PIECE else at + PIECE
        while cut < len(raw) and not _SPACE[raw[cut]]:  # a piece ends where a word does
            cut += 1
        h, start = word_hashes(raw[at:cut])
        hashes.append(h)
        starts.append(start + at)
        at = cut
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    first = np.searchsorted(np.concatenate(starts) if starts else np.zeros(0, np.int64), offsets).tolist()
    runs = _runs(h, words)
    for a, b in zip(first[:-1], first[1:]):
        s = np.sort(runs[a : b - words + 1] if b - a >= words else _runs(h[a:b], b - a))
        yield s[np.r_[True, s[1:] != s[:-1]]] if len(s) > 1 else s


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k hashes."""
    n = len(h) - k + 1
    if k == 0 or n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, np.uint64(k))
    for i in range(k):
        acc = _mix(acc * _A + h[i : i + n])
    return acc


def rarest(s: np.ndarray, threshold: int, often: np.ndarray) -> np.ndarray:
    """The members of a set that name its tiles: the first ones, one more than it may lack in a partner. Any order common to all sets serves."""
    return s[np.argsort(often[slots_of(s)], kind="stable")[: len(s) * (100 - threshold) // 100 + 1]]


def bitmap(s: np.ndarray) -> bytes:
    """A power of two of bits, at least four times the set, hashed from its members."""
    bits = 1 << max(7, int(4 * len(s) - 1).bit_length())
    on = np.zeros(bits, np.uint8)
    on[(s * _B) >> np.uint64(64 - bits.bit_length() + 1)] = 1
    return np.packbits(on).tobytes()


def bound(a: bytes, n_a: int, b: bytes, n_b: int) -> int:
    """No intersection is larger: each bit that one side alone has set stands for a member the other lacks."""
    if len(a) == len(b):
        x, y = int.from_bytes(a), int.from_bytes(b)
        both = (x & y).bit_count()
        return min(n_a - x.bit_count(), n_b - y.bit_count()) + both
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y, n_a, n_b = y, x, n_b, n_a
    y = np.packbits(np.unpackbits(y).reshape(len(x) * 8, -1).max(1))  # the longer bitmap's neighbouring bits fall together
    return int(min(n_a - np.bitwise_count(x & ~y).sum(), n_b - np.bitwise_count(y & ~x).sum()))


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Exact, on sorted distinct arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (len(a) + len(b) - both)


def set_rows(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (a digest of the set): one row a document; and, with `chunk` not null, rows of every task's counts of
    the sketch's slots, as many however large the task."""
    ids = docs.schema["doc_id"].dataType.simpleString()

    @tidied
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        counts, waiting, n_waiting, kind = np.zeros(1 << SLOT_BITS, np.int64), [], 0, None
        for batch in batches:
            kind, out = batch.schema.field(0).type, []
            for s in shingle_sets((t.as_py() for t in batch.column(1)), words):
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                out.append((len(s), (d & (2**64 - 1)) - 2**63, (d >> 64) - 2**63))
                waiting.append(s)
                n_waiting += len(s)
                if n_waiting > 1 << 19:
                    counts += np.bincount(slots_of(np.concatenate(waiting)).astype(np.int64), minlength=len(counts))
                    waiting, n_waiting = [], 0
            yield made(batch.column(0), *(pa.array(x, pa.int64()) for x in (zip(*out) if out else ([], [], []))), [None] * len(out), [None] * len(out))
        if waiting:
            counts += np.bincount(slots_of(np.concatenate(waiting)).astype(np.int64), minlength=len(counts))
        used = np.flatnonzero(counts.reshape(-1, CHUNK).any(1))
        if len(used):
            none = pa.nulls(len(used), pa.int64())
            yield made(pa.nulls(len(used), kind), none, none, none, used, counts.reshape(-1, CHUNK)[used].tolist())

    def made(ids: pa.Array, n: pa.Array, d1: pa.Array, d2: pa.Array, chunk: list, counts: list) -> pa.RecordBatch:
        arrays = [ids, n, d1, d2, pa.array(chunk, pa.int32()), pa.array(counts, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "d1", "d2", "chunk", "counts"])

    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {ids}, n_shingles long, d1 long, d2 long, chunk int, counts array<long>")


def frequencies(rows: DataFrame) -> np.ndarray:
    """How many sets have a member in each slot: at most 2^SLOT_BITS counts come to the driver, from all rows of set_rows."""
    each = rows.where(F.col("chunk").isNotNull()).select("chunk", F.posexplode("counts").alias("at", "n"))
    got = each.groupBy((F.col("chunk") * CHUNK + F.col("at")).alias("slot")).agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SLOT_BITS, np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def offered_rows(docs: DataFrame, words: int, threshold: int, often: np.ndarray) -> DataFrame:
    """id, n, members, common, bits: a document's set by its size, the members that name its tiles, how many of the last of them may be
    common ones, and its bitmap."""
    limit = max(TILE, COMMON * float(often.mean()))

    @F.pandas_udf("n long, members array<long>, common int, bits binary")
    @tidied
    def offer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for s in shingle_sets(texts, words):
                m = rarest(s, threshold, often) if len(s) else s
                out.append((len(s), m.view(np.int64), int((often[slots_of(m)] > limit).sum()), bitmap(s)))
            yield pd.DataFrame(out, columns=["n", "members", "common", "bits"])

    return docs.select(F.col("doc_id").alias("id"), offer("text").alias("m")).select("id", "m.*")


def band(n: Column) -> Column:
    """The band of a size: sizes from a power of four up to the next."""
    return F.floor((F.length(F.bin(n)) - 1) / 2)


def tiles_with_company(offered: DataFrame, threshold: int) -> DataFrame:
    """key, id, n, at, c: the tiles of several sets, with a set's size, the place of the tile's member in it, and the sets of the tile.

    A set is in the tiles of its own band and of the bands up to that of the largest set it can link with, so two sets that can link
    meet in the larger one's band. A tile is dealt by its key once; only members that may be common, as the sketch shows, are counted
    first and joined, so that a tile of very many sets is pre-aggregated and its rows can be split. A tile needs a set that
    may be the smaller of a linked pair, whose shared member stands further in front.
    """
    bands = F.sequence(band(F.col("n")), band(F.floor(F.col("n") * 100 / threshold).cast("bigint")))
    front = fronts(threshold).cast("int")
    each = offered.select("id", "n", bands.alias("bands"), (F.size("members") - F.col("common")).alias("rare"), F.posexplode("members").alias("at", "member"))
    each = each.select("id", "n", "at", front.alias("front"), (F.col("at") >= F.col("rare")).alias("common"), "member", F.explode("bands").alias("band"))
    each = each.select(F.xxhash64("member", "band").alias("key"), "id", "n", "at", "front", "common")
    by = Window.partitionBy("key")
    rare = each.where(~F.col("common")).select("key", "id", "n", "at", F.count("*").over(by).alias("c"), F.sum("front").over(by).alias("fronts"))
    often = each.where("common")
    counted = often.groupBy("key").agg(F.count("*").alias("c"), F.sum("front").alias("fronts")).where((F.col("c") > 1) & (F.col("fronts") > 0))
    rare = rare.where((F.col("c") > 1) & (F.col("fronts") > 0))
    return rare.select("key", "id", "n", "at", "c").unionByName(often.select("key", "id", "n", "at").join(counted, "key").select("key", "id", "n", "at", "c"))


def may_meet(a: str, b: str, threshold: int) -> Column:
    """Whether sets that share the members at these places, and none before, can link: what follows is enough on both sides."""
    n_a, n_b = F.col(f"{a}n"), F.col(f"{b}n")
    near = (n_a * 100 >= n_b * threshold) & (n_b * 100 >= n_a * threshold)
    return near & (F.least(n_a - F.col(f"{a}at"), n_b - F.col(f"{b}at")) * (100 + threshold) >= (n_a + n_b) * threshold)


def met_in_small_tiles(hits: DataFrame, threshold: int) -> DataFrame:
    """(a, b), a < b: the pairs that tiles of at most TILE sets let meet. A set meets fewer than TILE others in a tile, whatever the input."""
    small = hits.where(F.col("c") <= TILE)
    left, right = (small.select("key", *[F.col(c).alias(f"{s}{c}") for c in ("id", "n", "at")]) for s in ("x_", "y_"))
    met = left.join(right, "key").where((F.col("x_id") < F.col("y_id")) & may_meet("x_", "y_", threshold))
    return met.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct()


def within_bound(pairs: DataFrame, offered: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose bitmaps let them link."""

    @F.pandas_udf("boolean")
    @tidied
    def check(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            rows = zip(*(c.tolist() for c in columns))
            yield pd.Series([bound(p, n, q, m) * (100 + threshold) >= threshold * (n + m) for n, p, m, q in rows], dtype=bool)

    pairs = cut(pairs)
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    bits = kept(offered.select(F.col("id").alias("doc_id"), "n", "bits"), ids)
    left, right = (bits.select(F.col("doc_id").alias(s), F.col("n").alias(f"{s}_n"), F.col("bits").alias(f"{s}_bits")) for s in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").where(check("a_n", "a_bits", "b_n", "b_bits")).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """The pairs (a, b) of ids whose sets link. Whole texts travel, which take less room than their hashes; sorted arrays are made where
    a pair meets, once for some pairs of a text that follow each other."""

    @F.pandas_udf("boolean")
    @tidied
    def check(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for left, right in batches:
            out: list[bool] = []
            for at in range(0, len(left), PAIRS):
                some = list(zip(left[at : at + PAIRS], right[at : at + PAIRS]))
                every = list(dict.fromkeys(x for pair in some for x in pair))
                made = dict(zip(every, shingle_sets(every, words)))
                out += [linked(made[x], made[y], threshold) for x, y in some]
            yield pd.Series(out, dtype=bool)

    pairs = cut(pairs)
    texts = kept(docs.select("doc_id", "text"), pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").where(check("ta", "tb")).select("a", "b")


def kept(rows: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose doc_id is, or is not, among the ids: by broadcast up to BROADCAST_ROWS of them, else by a shuffled join."""
    ids = cut(ids)
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", how)


def leaders(hits: DataFrame, threshold: int) -> DataFrame:
    """(a, b), a < b: each set with one partner, the one that leads most of its tiles. A tile is led by its busiest set, the one
    with most company in all its tiles: in a group of near copies that is the least altered, to which most others link."""
    busy = hits.groupBy("id").agg(F.sum("c").alias("busy"))
    lead = hits.join(busy, "id").groupBy("key").agg(F.min_by(F.struct("id", "n", "at"), F.struct(-F.col("busy"), "id")).alias("lead"))
    lead = lead.select("key", F.col("lead.id").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.at").alias("lead_at"))
    met = hits.join(lead, "key").where((F.col("id") != F.col("lead")) & may_meet("", "lead_", threshold)).select("id", "lead")
    often = met.groupBy("id", "lead").count()
    one = often.groupBy("id").agg(F.min_by("lead", F.struct(-F.col("count"), "lead")).alias("lead"))
    return one.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()


def fronts(threshold: int) -> Column:
    """Whether a set may be the smaller, or as large, of a linked pair whose first shared member stands at this place. Of a linked pair
    one set at least is such a one."""
    return (F.col("n") - F.col("at")) * (100 + threshold) >= F.col("n") * 2 * threshold


def cells(at: DataFrame, threshold: int) -> DataFrame:
    """key, id, n, at, component, block, cell (low, high): the pairs of blocks a tile's member takes part in. Rows of `at`: key, id, n, at,
    component.

    A tile of one component has nothing to compare. Members of its largest component need not meet each other, nor need sets that
    share the tile's member too far behind to be the smaller of a pair. So blocks of four kinds are laid out one after another: front
    and other sets of the rest, then front and other sets of the largest component, and only kinds that have something to compare meet.
    A tile of a common passage that all its sets hold behind parts of their own has no front sets, and is not dealt at all.
    """
    at = at.withColumn("front", fronts(threshold).cast("int"))
    part = at.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("front").alias("f"))
    tile = part.groupBy("key").agg(
        F.min_by(F.struct("component", "n", "f"), F.struct(-F.col("n"), "component")).alias("home"), F.sum("n").alias("n"), F.sum("f").alias("f"), F.count("*").alias("parts")
    )

    def blocks(n: Column) -> Column:
        return F.ceil(n / BLOCK)

    home_f, home_o = F.col("home.f"), F.col("home.n") - F.col("home.f")
    rest_f = F.col("f") - home_f
    tile = tile.where("parts > 1").select(
        "key", F.col("home.component").alias("home"), blocks(rest_f).alias("b0"), blocks(F.col("n") - F.col("f") - home_o).alias("b1"), blocks(home_f).alias("b2"), blocks(home_o).alias("b3")
    )
    tile = tile.where("b0 > 0 OR (b1 > 0 AND b2 > 0)")
    home, front, h = F.col("component") == F.col("home"), F.col("front") == 1, F.xxhash64("id")
    start = [F.lit(0).cast("long"), F.col("b0"), F.col("b0") + F.col("b1"), F.col("b0") + F.col("b1") + F.col("b2"), F.col("b0") + F.col("b1") + F.col("b2") + F.col("b3")]

    def span(*kinds: int) -> Column:
        none = F.array().cast("array<bigint>")
        return F.concat(*[F.when(start[k + 1] > start[k], F.sequence(start[k], start[k + 1] - 1)).otherwise(none) for k in kinds])

    def place(k: int) -> Column:
        return start[k] + F.pmod(h, F.greatest(start[k + 1] - start[k], F.lit(1)))

    block = F.when(~home & front, place(0)).when(~home, place(1)).when(front, place(2)).otherwise(place(3))
    partners = F.when(~home & front, span(0, 1, 2, 3)).when(~home, span(0, 2)).when(front, span(0, 1)).otherwise(span(0))
    pair = F.transform(partners, lambda k: F.struct(F.least(k, F.col("block")).alias("low"), F.greatest(k, F.col("block")).alias("high")))
    return at.join(tile, "key").withColumn("block", block).select("key", "id", "n", "at", "component", "block", pair.alias("cells"))


def may_link(n: np.ndarray, rest: np.ndarray, component: np.ndarray, bits: list[bytes], left: np.ndarray, right: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs, of one of `left` and one of `right`, that are in different components and whose bounds let them link.
    `rest`: the members from the tile's on."""
    length = np.array([len(x) for x in bits])
    size = int(length.min())
    rows = []
    for x in bits:  # to one length: neighbouring bits of the longer fall together
        y = np.frombuffer(x, np.uint8)
        rows.append(y if len(x) == size else np.packbits(np.unpackbits(y).reshape(size * 8, -1).max(1)))
    m = np.stack(rows).view(np.uint64)
    ones, out = np.bitwise_count(m).sum(1, dtype=np.int64), []
    for i in left:
        k = right[component[right] != component[i]]
        k = k[(n[i] * 100 >= n[k] * threshold) & (n[k] * 100 >= n[i] * threshold) & (np.minimum(rest[i], rest[k]) * (100 + threshold) >= threshold * (n[i] + n[k]))]
        if len(k):
            both = np.bitwise_count(m[k] & m[i]).sum(1, dtype=np.int64)
            most = np.minimum(n[i] - ones[i] + both, n[k] - ones[k] + both)
            k = k[most * (100 + threshold) >= threshold * (n[i] + n[k])]
            if len(k):
                out.append((np.full(len(k), i), k))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def near_pairs(at: DataFrame, offered: DataFrame, threshold: int) -> DataFrame:
    """(a, b), a < b: the pairs that share a tile, are in different components, and pass the bound. Each pair of blocks is compared in
    the task it is dealt to; a task holds one pair of blocks at a time."""
    kind = offered.schema["id"].dataType.simpleString()

    @tidied
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found(rows: pd.DataFrame, starts: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
            ids, comp, n = rows["id"].to_numpy(), rows["component"].to_numpy(), rows["n"].to_numpy()
            rest = n - rows["at"].to_numpy()
            block, low, high, bits = rows["block"].to_numpy(), rows["low"].to_numpy(), rows["high"].to_numpy(), rows["bits"].tolist()
            a, b = [], []
            for s, e in zip(starts.tolist(), ends.tolist()):
                if e - s < 2 or (comp[s:e] == comp[s]).all():
                    continue
                every = np.arange(e - s)
                if low[s] == high[s]:
                    left = right = every
                else:
                    left, right = every[block[s:e] == low[s]], every[block[s:e] == high[s]]
                if len(left) and len(right):
                    x, y = may_link(n[s:e], rest[s:e], comp[s:e], bits[s:e], left, right, threshold)
                    a.append(ids[s:e][x])
                    b.append(ids[s:e][y])
            if not a:
                return pd.DataFrame({"a": ids[:0], "b": ids[:0]})
            x, y = np.concatenate(a), np.concatenate(b)
            return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()

        left_over = None
        for batch in batches:
            rows = batch if left_over is None else pd.concat([left_over, batch], ignore_index=True)
            k, lo, hi = (rows[c].to_numpy() for c in ("key", "low", "high"))
            starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]) if len(rows) else np.zeros(0, np.int64)
            if len(starts) > 1:
                yield found(rows, starts[:-1], starts[1:])
            left_over = rows.iloc[starts[-1] :] if len(starts) else None
        if left_over is not None:
            yield found(left_over, np.array([0]), np.array([len(left_over)]))

    open_ = cut(cells(at, threshold))
    bits = kept(offered.select(F.col("id").alias("doc_id"), "bits"), open_.select(F.col("id").alias("doc_id")).distinct()).withColumnRenamed("doc_id", "id")
    dealt = open_.join(bits, "id").select("key", "id", "n", "at", "component", "block", "bits", F.explode("cells").alias("cell")).select("*", "cell.low", "cell.high").drop("cell")
    dealt = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.mapInPandas(compare, f"a {kind}, b {kind}").distinct()


def classes(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of `docs`; component_id is the smallest id reachable by links.

    Null texts and texts without words have empty sets and link with nothing, not even each other. Ids may be numbers or strings, in
    their own order, and should be unique; rows with a null id are kept, with their own size and a null component. An empty table
    gives an empty result.
    """
    if not 50 <= threshold <= 100:
        raise ValueError("threshold must be from 50 to 100")
    rows = cut(set_rows(docs, words))
    often, rows = frequencies(rows), rows.where(F.col("chunk").isNull())
    some = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # equal sets are one, under their smallest id
    member = some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    named = cut(some.join(member, ["d1", "d2"]).select("doc_id", "rep").distinct())
    copies = named.where(F.col("doc_id") != F.col("rep")).select("doc_id")
    first = kept(docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text"), copies, "left_anti")
    with ExitStack() as tables:
        offered = write_table(offered_rows(first, words, threshold, often), tables)
        hits = write_table(tiles_with_company(offered, threshold), tables)
        large = hits.where(F.col("c") > TILE)
        pairs = cut(met_in_small_tiles(hits, threshold).union(leaders(large, threshold)).distinct())
        links = cut(verified(within_bound(pairs, offered, threshold), docs, words, threshold))
        comp = cut(components(links))
        # sets of one large tile that are still apart
        few = comp.count() <= BROADCAST_ROWS
        at = large.select("key", "id", "n", "at").distinct().join(F.broadcast(comp) if few else comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
        more = cut(near_pairs(at, offered, threshold).join(pairs, ["a", "b"], "left_anti"))
        if more.count():
            comp = cut(components(links.union(verified(more, docs, words, threshold))))
    # a component's smallest representative is its smallest member, for a representative is the smallest of its copies
    whole = named.join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left")
    whole = whole.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    return rows.select("doc_id", "n_shingles").join(whole, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The row of the smallest id of every class, with the columns it came with. Rows with a null id stay; rows that repeat an id
    go together."""
    name = fresh(docs, "component")
    rest = cut(classes(docs, words, threshold).where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(F.broadcast(rest) if rest.count() <= BROADCAST_ROWS else rest, F.col("doc_id") == F.col(name), "left_anti")
