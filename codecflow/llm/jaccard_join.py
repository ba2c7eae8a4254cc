"""Jaccard self-join on word shingles with adaptive multi-match prefixes.

Shingles have one global order, rare ones first: a bounded list of the frequent ones comes from a first round over all
documents in the order of hashes alone, the others are ordered by hash. Two sets of the wanted similarity share at least m shingles of their prefixes of length
size - ceil(0.75 * size) + m, for every m. Each document has the m that its estimated candidate cost asks for, and a prefix
of that length. The first round deals prefixes to buckets as six bytes a shingle, packed into one row for each bucket and
slice of a task's sets, and gets numbers of shingles met back: no posting is a row there. Documents that share enough prefix shingles with others to have a partner at all are joined to clusters
through the shingles they share, less those that may be there by chance and that no pair needs; there only pairs that share as many prefix shingles as the smaller m of the two are
verified. Clusters are cut into blocks of sets with the same least prefix shingle, and of two blocks only those meet that
share as many prefix shingles as any two of their sets must: so neither does a pair become a row, nor does a cluster meet in
one task or all with all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.dealing import tasks
from .common import checkpointed, components, discard, documents, forest, lean, one_thread, small_batches, table
from .words import Hasher, distinct, mixed, slices

WORDS = 5
#: Similarity as a fraction, in whole numbers.
ABOVE, BELOW = 75, 100
#: A shingle is frequent when it is this fraction of all shingles of all sets, so there are at most as many frequent ones.
FREQUENT = 1 << 22
LEAST_FREQUENT = 8
#: Largest number of shared prefix shingles asked for, as a share of a set's size (16 for small sets); the least, as a share
#: of the largest; the cost of verifying a candidate, in postings read.
MATCH_SHARE, LEAST_SHARE, VERIFY_COST = 1 / 5, 7 / 8, 200.0
#: Sets, and shingles of all of them, in a block of a cluster.
TILE, TILE_SHINGLES = 1024, 1 << 20
#: Size of the bitmap that says whose texts need not be read for verification.
MARK_BITS = 1 << 24
_CHUNK = 2048
#: Sets whose prefixes a task remembers to have passed on: copies in one task meet once.
_SEEN = 200_000
#: Shingles of all sets for each task of the first round, buckets for each task, sets and prefix shingles in a slice.
TASK_SHINGLES, TASK_BUCKETS, SLICE_SETS, SLICE_SHINGLES = 1 << 21, 2, 1 << 16, 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """64-bit hashes of the distinct shingles of texts, sorted."""

    def __init__(self, words: int = WORDS):
        self.words, self.hasher = words, Hasher()

    def fold(self, w: np.ndarray, k: int) -> np.ndarray:
        n = max(len(w) - k + 1, 0)
        with np.errstate(over="ignore"):
            h = np.full(n, np.uint64(k))
            for i in range(k):
                h = (h ^ w[i : i + n]) * _BASE
                h ^= h >> np.uint64(29)
        return h

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        w, n = self.hasher.of(texts)
        at = np.cumsum(n) - n
        whole = self.fold(w, self.words)  # those that cross from one text into the next are left out
        for lo, k in zip(at.tolist(), n.tolist()):
            if k >= self.words:
                yield distinct(whole[lo : lo + k - self.words + 1])
            else:
                yield self.fold(w[lo : lo + k], k) if k else w[:0]


def codes(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 more bits of each shingle: what tells shingles apart in the first round. Two with one code only seem to
    meet more often than they do."""
    g = mixed(h)
    return ((g >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)) << np.uint64(32) | g & np.uint64(0xFFFFFFFF)


class Order:
    """The global order of shingles: by the known frequency of their codes, then by hash."""

    def __init__(self, known: np.ndarray, counts: np.ndarray, buckets: int = 1):
        at = np.argsort(known)
        self.known, self.counts, self.buckets = known[at], counts[at], buckets

    def frequency(self, s: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.ones(len(s), np.int64)
        c = codes(s, self.buckets)
        at = np.minimum(np.searchsorted(self.known, c), len(self.known) - 1)
        return np.where(self.known[at] == c, self.counts[at], 1)

    def sorted(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = self.frequency(s)
        if len(f) and f.max() > 1:
            at = np.lexsort((s, f))
            return s[at], f[at]
        return s, f


def needed(n: int) -> int:
    """The least number of shared shingles with any set similar enough to one of n."""
    return -(-ABOVE * n // BELOW)


def most_matches(n: int) -> int:
    return min(max(16, int(n * MATCH_SHARE)), needed(n))


def least_matches(n: int) -> int:
    return max(1, int(most_matches(n) * LEAST_SHARE))


def matches(f: np.ndarray) -> int:
    """How many shared prefix shingles to ask for: the least estimated cost of postings read and candidates verified."""
    n = len(f)
    before = n - needed(n)
    m = np.arange(least_matches(n), most_matches(n) + 1)
    read = np.cumsum(f)[before + m - 1].astype(float)
    return int(m[np.argmin(read + VERIFY_COST * read / m)])


def least_shared(n: int, m: int) -> int:
    """What a set of n with m shares with others at least if it has a partner: the partner has needed(n) shingles or more."""
    return min(m, least_matches(needed(n)))


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def surveyed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, set_id of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for b in slices(batches, 1):
            sets = list(shingles.of(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64())], ["doc_id", "n", "set_id"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n long, set_id long")


PREFIXES = "set_id long, least int, prefix array<long>"


def prefixes(sets: Iterator[np.ndarray], ids: list[int], order: Order) -> pa.RecordBatch:
    """set_id, least, prefix of sets: the prefix is as long as the matches asked for need, `least` is what any partner
    shares of it."""
    kept, least, prefix = [], [], []
    for i, s in zip(ids, sets):
        if len(s):
            o, f = order.sorted(s)
            m = matches(f)
            kept.append(i)
            least.append(least_shared(len(s), m))
            prefix.append(o[: len(s) - needed(len(s)) + m].view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(least, pa.int32()), pa.array(prefix, pa.list_(pa.int64()))], ["set_id", "least", "prefix"])


def dealt(docs: DataFrame, marked, buckets: int, words: int) -> DataFrame:
    """Prefixes of the documents that `marked` does not rule out, in the order of hashes alone.

    For each slice of sets, and bucket: the low halves of codes and the numbers of their sets in the slice; and once, with a
    number behind those of the buckets, set_id and `least` of the sets.
    """
    bits = F.pmod(F.xxhash64("doc_id"), F.lit(MARK_BITS)).alias("at")

    def slice_(number: int, task: int, sets: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        code = codes(np.concatenate([p for _, _, p in sets]).view(np.uint64), buckets)
        own = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(p) for _, _, p in sets])
        by = np.argsort(code)
        code, own = code[by], own[by]
        bucket, first = np.unique((code >> np.uint64(32)).astype(np.int64), return_index=True)
        low, ends = code.astype(np.uint32), [*first[1:].tolist(), len(code)]
        lows = [low[i:j].tobytes() for i, j in zip(first.tolist(), ends)] + [np.array([i for i, _, _ in sets], np.int64).tobytes()]
        owns = [own[i:j].tobytes() for i, j in zip(first.tolist(), ends)] + [np.array([n for _, n, _ in sets], np.int32).tobytes()]
        to = [*bucket.tolist(), buckets + task % buckets]
        return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array([task << 32 | number] * len(to), pa.int64()), pa.array(lows, pa.binary()), pa.array(owns, pa.binary())], ["bucket", "slice", "low", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, by, bitmap = Shingles(words), Order(np.zeros(0, np.uint64), np.zeros(0, np.int64)), marked.value
        seen: set[int] = set()
        sets: list[tuple[int, int, np.ndarray]] = []
        number = held = task = 0
        for b in slices(batches, 2):
            task, at = b.column(0)[0].as_py(), b.column(1).to_numpy()
            maybe = np.flatnonzero(bitmap[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1))
            new = {}
            for s in shingles.of(b.column(2).take(pa.array(maybe))):
                i = set_id(s)
                if i not in seen:
                    new[i] = s
            if len(seen) > _SEEN:
                seen.clear()
            seen.update(new)
            got = prefixes(new.values(), list(new), by)
            values, ends = got.column(2).flatten().to_numpy(), got.column(2).offsets.to_numpy()
            for k, (i, least) in enumerate(zip(got.column(0).to_pylist(), got.column(1).to_pylist())):
                p = values[ends[k] : ends[k + 1]]
                if sets and (len(sets) == SLICE_SETS or held + len(p) > SLICE_SHINGLES):
                    yield slice_(number, task, sets)
                    sets, number, held = [], number + 1, 0
                sets.append((i, least, p))
                held += len(p)
        if sets:
            yield slice_(number, task, sets)

    return docs.select(F.spark_partition_id().cast("long").alias("task"), bits, "text").mapInArrow(lean(run), "bucket long, slice long, low binary, own binary")


def counted(rows: DataFrame, buckets: int, frequent: int) -> DataFrame:
    """What each bucket of dealt() tells: by slice, the numbers of the sets of shingles that came before (own), once for each
    such shingle; without a slice, codes (low) that came `frequent` times and their counts (own). Rows about sets stay, with
    their `low`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes, bytes]]] = {}
        out = lambda *c: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(c, (pa.int64(), pa.binary(), pa.binary()))], ["slice", "low", "own"])
        for b in batches:
            for bucket, part, low, own in zip(*(c.to_pylist() for c in b.columns)):
                if bucket >= buckets:
                    yield out(part, low, own)
                else:
                    held.setdefault(bucket, []).append((part, low, own))
        for bucket in list(held):
            parts = held.pop(bucket)
            every = np.concatenate([np.frombuffer(low, np.uint32) for _, low, _ in parts])
            every.sort()
            first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
            value, n = every[first], np.diff(np.r_[first, len(every)])
            met, often = value[n > 1], n >= frequent
            del every, first
            if often.any():
                yield out(None, (value[often].astype(np.uint64) | np.uint64(bucket << 32)).tobytes(), n[often].astype(np.int64).tobytes())
            if len(met):
                for part, low, own in parts:
                    low = np.frombuffer(low, np.uint32)
                    hit = met[np.minimum(np.searchsorted(met, low), len(met) - 1)] == low
                    if hit.any():
                        yield out(part, None, np.frombuffer(own, np.uint16)[hit].tobytes())

    return rows.mapInArrow(lean(run), "slice long, low binary, own binary")


def sociable(t: pa.Table) -> pa.Table:
    """set_id of the sets of one slice that share enough of their prefixes with others."""
    low, own = t.column("low").to_pylist(), t.column("own").to_pylist()
    at = next(k for k, x in enumerate(low) if x is not None)
    ids, least = np.frombuffer(low[at], np.int64), np.frombuffer(own[at], np.int32)
    n = np.zeros(len(ids), np.int64)
    for k, x in enumerate(own):
        if k != at:
            n += np.bincount(np.frombuffer(x, np.uint16), minlength=len(ids))
    return pa.table([pa.array(ids[n >= least], pa.int64())], names=["set_id"])


def first_round(docs: DataFrame, copies: DataFrame, total: int, words: int) -> tuple[DataFrame, Order]:
    """set_id of the sets that share enough of their prefixes with others to have a partner (and of a few more), and the order
    that follows from the shingles that came often there, at most FREQUENT of them.

    One of the copies of each set takes part, and whichever others the bitmap does not rule out.
    """
    spark = docs.sparkSession
    n = max(tasks(docs), -(-total // TASK_SHINGLES))
    buckets, marked = n * TASK_BUCKETS, spark.sparkContext.broadcast(marks(copies.select(F.col("rep").alias("id"))))  # MARK_BITS bits
    rows = checkpointed(counted(dealt(docs, marked, buckets, words).repartition(n, "bucket"), buckets, max(LEAST_FREQUENT, -(-total // FREQUENT))))
    often = rows.where("slice is null").select("low", "own").toArrow()
    known, counts = (np.frombuffer(b"".join(often.column(c).to_pylist()), t) for c, t in (("low", np.uint64), ("own", np.int64)))
    able = checkpointed(rows.where("slice is not null").groupBy("slice").applyInArrow(sociable, "set_id long").distinct())
    discard(rows)
    return able, Order(known, counts, buckets)


def prefixes_of_sets(sets: DataFrame, order) -> DataFrame:
    """Prefixes of ordered sets, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield prefixes([np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()], b.column(0).to_pylist(), order.value)

    return sets.select("set_id", "shingles").mapInArrow(lean(run), PREFIXES)


def meeting(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written table, and what is left of it: postings(h, set_id, least) of shingles in several prefixes, with the least
    set of each (`to`).

    Sets go that share fewer prefix shingles with all others together than they would with one partner. The sets of a shingle
    are never gathered: their least and greatest are summed up before the shuffle, and a frequent shingle's share of the join
    can be split.
    """
    shared_ = postings.groupBy("h").agg(F.min("set_id").alias("to"), F.max("set_id").alias("other")).where("to <> other").select("h", "to")
    met = postings.join(shared_, "h").groupBy("h", "set_id").agg(F.min("least").alias("least"), F.min("to").alias("to"))
    met = checkpointed(met)
    able = met.groupBy("set_id").agg(F.count("*").alias("n"), F.min("least").alias("l")).where("n >= l")
    return met, met.join(able.select("set_id"), "set_id")


def firm(met: DataFrame) -> DataFrame:
    """Edges (a, b) from sets to the least sets (`to`) of their prefix shingles, without those that chance alone may have made.

    Two partners share at least the greater `least` of the two, so each set may pass over fewer than half its own `least` of
    shingles, and one that both keep is left. It passes over those that it has in common with the fewest others of the same
    `to`: chance brings single ones, copies bring many. Otherwise, in a large corpus, such single shingles would join nearly
    all groups of copies to one cluster.
    """
    e = met.where("set_id <> to").groupBy("set_id", "to").agg(F.count("*").alias("c"), F.min("least").alias("least"))
    passed = F.sum("c").over(Window.partitionBy("set_id").orderBy("c", "to"))  # a set has no more rows than prefix shingles
    return e.withColumn("passed", passed).where("2 * passed >= least").select(F.col("set_id").alias("a"), F.col("to").alias("b"))


def marks(ids: DataFrame, bits: int = MARK_BITS) -> np.ndarray:
    """A bitmap of `bits` bits, those of the hashes of ids(id) set: it tells which ids are certainly not among them."""
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select(F.floor(at / 64).cast("long").alias("w"), F.expr("shiftleft(1L, cast(pmod(pmod(xxhash64(id), %d), 64) as int))" % bits).alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("m").to_numpy()
    return out.view(np.uint64)


def ordered_sets(docs: DataFrame, order, marked, words: int) -> DataFrame:
    """set_id, n, matches and the ordered set of the documents that `marked` does not rule out."""
    bits = F.pmod(F.xxhash64("doc_id"), F.lit(MARK_BITS)).alias("at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, by, bitmap = Shingles(words), order.value, marked.value
        for b in slices(batches, 1):
            at = b.column(0).to_numpy()
            maybe = np.flatnonzero(bitmap[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1))
            ids, n, m, sets = [], [], [], []
            for s in shingles.of(b.column(1).take(pa.array(maybe))):
                if len(s):
                    o, f = by.sorted(s)
                    ids.append(set_id(s)), n.append(len(s)), m.append(matches(f)), sets.append(o.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(sets, pa.binary())], ["set_id", "n", "matches", "shingles"])

    return docs.select(bits, "text").mapInArrow(lean(run), "set_id long, n long, matches long, shingles binary")


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common values of each set on the left with each on the right, by products of 0/1 blocks."""
    out = np.zeros((len(left), len(right)), np.int64)
    if not left or not right:
        return out
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        v, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        if not len(both):
            return row[:0], row[:0]
        at = np.minimum(np.searchsorted(both, v), len(both) - 1)
        hit = both[at] == v
        return row[hit], at[hit]

    (rl, cl), (rr, cr) = places(left), places(right)
    for lo in range(0, len(both), _CHUNK):
        a, b = np.zeros((len(left), _CHUNK), np.float32), np.zeros((len(right), _CHUNK), np.float32)
        for m, r, c in ((a, rl, cl), (b, rr, cr)):
            of = (c >= lo) & (c < lo + _CHUNK)
            m[r[of], c[of] - lo] = 1
        out += (a @ b.T).astype(np.int64)  # whole numbers, _CHUNK at most
    return out


def tile_links(t: pa.Table) -> pa.Table:
    """Links within one tile: (a, null, links of a here) and (a, b, 0) for a spanning forest."""
    one_thread()
    ids, side = t.column("set_id").to_numpy(), t.column("side").to_numpy()
    _, first = np.unique(np.stack([ids, side]), axis=1, return_index=True)
    mult = t.column("mult").to_numpy()
    n, m = (t.column(c).to_numpy() for c in ("n", "matches"))
    raw = t.column("shingles")
    sets = {k: np.frombuffer(raw[int(k)].as_buffer(), np.uint64) for k in first}
    left = [k for k in first if side[k] <= 0]
    right = [k for k in first if side[k] != 0]
    alone = bool((side < 0).any())
    if alone:
        right = left
    out: tuple[list, list, list] = ([], [], [])
    if left and right:
        nl, nr, ml, mr = n[left], n[right], m[left], m[right]
        prefix = lambda k: sets[k][: n[k] - needed(int(n[k])) + m[k]]
        enough = shared([prefix(k) for k in left], [prefix(k) for k in right]) >= np.minimum(ml[:, None], mr[None, :])
        enough &= (BELOW * nl[:, None] >= ABOVE * nr[None, :]) & (BELOW * nr[None, :] >= ABOVE * nl[:, None])
        enough &= ids[left][:, None] != ids[right][None, :]
        rows, cols = np.flatnonzero(enough.any(1)), np.flatnonzero(enough.any(0))
        if len(rows):
            both = shared([sets[left[i]] for i in rows], [sets[right[j]] for j in cols])
            near = (BELOW + ABOVE) * both >= ABOVE * (nl[rows][:, None] + nr[cols][None, :])
            near &= enough[np.ix_(rows, cols)]
            a, b = ids[left][rows], ids[right][cols]
            for ids_, count in ((a, near @ mult[right][cols]), *(() if alone else ((b, near.T @ mult[left][rows]),))):
                for k in np.flatnonzero(count):
                    out[0].append(int(ids_[k])), out[1].append(None), out[2].append(int(count[k]))
            i, j = np.nonzero(near)
            for u, v in forest(a[i], b[j]):
                out[0].append(u), out[1].append(v), out[2].append(0)
    return pa.table([pa.array(c, pa.int64()) for c in out], names=["a", "b", "n"])


def tiles(members: DataFrame, met: DataFrame, sets: DataFrame, tile: int) -> DataFrame:
    """The sets of members in every tile that they belong to: side -1 in a tile of one block, else 0 and 1 for the two blocks.

    A cluster of at most `tile` sets is one block. Otherwise the sets of a class of sizes (classes are a factor of
    BELOW / ABOVE apart, so only sets of the same or of neighbouring classes can link) are dealt into blocks by their least
    prefix shingle, which near copies nearly always have in common, and full blocks are dealt once more by hash. Two blocks
    make a tile when they share as many different prefix shingles (`met`) as two of their sets would have to.
    """
    many = lambda rows: F.ceil(F.greatest(F.count(F.lit(1)) / tile, F.sum("n") / TILE_SHINGLES)).cast("int").alias(rows)
    least = met.groupBy("set_id").agg(F.min(F.xxhash64("h")).alias("first"), F.min("least").alias("least"))
    m = members.join(members.groupBy("cluster").agg(many("whole")), "cluster").join(least, "set_id")
    own = F.floor(F.ln(F.col("n").cast("double")) / float(np.log(BELOW / ABOVE))).cast("int")
    m = m.withColumn("band", F.when(F.col("whole") == 1, F.lit(0)).otherwise(own)).drop("whole")
    m = m.join(m.groupBy("cluster", "band").agg(many("parts")), ["cluster", "band"]).withColumn("part", F.pmod(F.xxhash64("first", "cluster"), F.col("parts")))
    m = m.join(m.groupBy("cluster", "band", "part").agg(many("again")), ["cluster", "band", "part"])
    block = F.struct("band", F.col("part").cast("long").alias("part"), F.pmod(F.xxhash64("set_id", "cluster"), F.col("again")).cast("long").alias("sub"))
    m = checkpointed(m.select("set_id", "cluster", "mult", "least", block.alias("block")))
    blocks = m.groupBy("cluster", "block").agg(F.min("least").alias("least"))
    several = blocks.groupBy("cluster").agg(F.count("*").alias("c")).where("c > 1").select("cluster")
    held = met.select("h", "set_id").join(m.join(several, "cluster"), "set_id").select("cluster", "h", "block").distinct()
    x, y = held.select("cluster", "h", F.col("block").alias("lo")), held.select("cluster", "h", F.col("block").alias("hi"))
    pairs = x.join(y, ["cluster", "h"]).where("lo < hi and hi.band - lo.band <= 1").groupBy("cluster", "lo", "hi").agg(F.count("*").alias("c"))
    of = lambda end: blocks.select("cluster", F.col("block").alias(end), F.col("least").alias(f"least_{end}"))
    pairs = pairs.join(of("lo"), ["cluster", "lo"]).join(of("hi"), ["cluster", "hi"]).where("c >= least(least_lo, least_hi)").select("cluster", "lo", "hi")
    one = blocks.select("cluster", F.col("block").alias("lo"), F.col("block").alias("hi"))
    ends = one.select("cluster", "lo", "hi", F.col("lo").alias("block"), F.lit(-1).alias("side"))
    for side, end in enumerate(("lo", "hi")):
        ends = ends.unionAll(pairs.select("cluster", "lo", "hi", F.col(end).alias("block"), F.lit(side).alias("side")))
    return m.join(ends, ["cluster", "block"]).join(sets, "set_id").select("cluster", "lo", "hi", "side", "set_id", "mult", "n", "matches", "shingles")


def similar_documents(docs: DataFrame, words: int = WORDS, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of docs.

    Texts without words have an empty set and link with nothing; rows with a null doc_id take no part and have a null
    component_id; rows of one doc_id are one node. Equal sets are joined once, as one set with a multiplicity; sets are
    told apart by 64-bit hashes. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = documents(docs)
    found = checkpointed(surveyed(docs, words))
    able = found.where("n > 0 and doc_id is not null")
    copies = checkpointed(able.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("mult"), F.min("n").alias("n")))
    named = docs.where("doc_id is not null")
    # First by hash order: few sets share enough of their prefixes to have a partner. What came often there is frequent.
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    first, known = first_round(named, copies, total, words)
    order = spark.sparkContext.broadcast(known)
    left = checkpointed(first.join(copies, "set_id"))
    discard(first)
    marked = spark.sparkContext.broadcast(marks(left.select(F.col("rep").alias("id"))))  # MARK_BITS bits
    sets = checkpointed(ordered_sets(named, order, marked, words).join(left.select("set_id"), "set_id", "left_semi"))
    # Then in the order of frequency: what many documents share lies behind their prefixes and joins no clusters.
    second, met = meeting(prefixes_of_sets(sets, order).select(F.explode("prefix").alias("h"), "set_id", "least"))
    third, met = meeting(met.select("h", "set_id", "least"))  # what has gone may leave others without a partner
    discard(second)
    # The least set of each shingle stands for it: whoever shares a shingle that neither passes over is joined through it.
    clusters = components(firm(met))
    members = checkpointed(clusters.select(F.col("node").alias("set_id"), F.col("component").alias("cluster")).join(left, "set_id"))
    links = checkpointed(tiles(members, met, sets, tile).groupBy("cluster", "lo", "hi").applyInArrow(tile_links, "a long, b long, n long"))
    discard(third, sets)
    counts = links.where("b is null").groupBy(F.col("a").alias("set_id")).agg(F.sum("n").alias("n_linked"))
    reps = copies.select(F.col("set_id").alias("s"), "rep")
    edges = links.where("b is not null").join(reps, F.col("a") == F.col("s")).select(F.col("rep").alias("ra"), "b").join(reps, F.col("b") == F.col("s")).select(F.col("ra").alias("a"), F.col("rep").alias("b"))
    # copies under several ids are links of their own
    twins = able.select("set_id", "doc_id").join(copies.where("mult > 1"), "set_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    merged = components(edges.unionAll(twins))
    own = able.select("doc_id", "set_id").join(copies, "set_id").join(counts, "set_id", "left").groupBy("doc_id").agg(F.sum(F.col("mult") - 1 + F.coalesce("n_linked", F.lit(0))).alias("n_links"))
    out = found.select("doc_id", F.col("n").alias("n_shingles")).join(own, "doc_id", "left").join(merged.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of docs, all columns as they are, whose doc_id is the component of its group.

    Rows with a null doc_id stay, and so does every row of a doc_id that stays: one_row_each() has one of each.
    """
    groups = similar_documents(docs, words).where("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(groups, docs["doc_id"].cast("long") == groups["__id"], "left_anti")
    return kept


def one_row_each(docs: DataFrame) -> DataFrame:
    """docs with one row of those that have the same doc_id and text, null ids included, all columns as they are.

    A row with a null doc_id goes where its text comes under an id as well; rows with a null text stay. Texts are told
    apart by 128-bit hashes, and only texts that are repeated so are gathered.
    """
    text = F.md5(F.col("text").cast("string").cast("binary"))
    of_id = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("__t")).where("__t is not null").groupBy("__t", "id").agg(F.count("*").alias("c"))
    of_text = of_id.groupBy("__t").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.count("id").alias("named"), F.max(F.col("id").isNull()).alias("unnamed"))
    again = checkpointed(of_text.where("n > 1 and (most > 1 or unnamed)").select("__t", (F.col("named") > 0).alias("__named")))
    if again.isEmpty():
        return docs
    tagged = docs.withColumn("__t", text)
    once = tagged.join(again, "__t", "left_anti").select(*docs.columns)
    rows = tagged.join(again, "__t").where("doc_id is not null or not __named")
    # of rows that differ in other columns, always the same one
    first = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns))
    return once.unionAll(rows.groupBy("__t", "doc_id").agg(first.alias("__row")).select("__row.*"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return similar_documents(table(spark, sf_dir, "documents"))
