"""Scores of a weighted backoff automaton, whose counts are gathered over all training texts.

Every word, and every n-gram up to trigrams that comes LEAST_COUNT times, is in the model, however many there are: nothing
is capped, so the model grows with the corpus. N-grams are smoothed by interpolated absolute discounting. An n-gram that is
kept is an arc from the state of its context; what a context leaves is the weight of its failure arc, which leads to the
context without its first word. From the empty context every word has an arc with its add-one probability.

No machine holds the model. N-grams are counted in buckets by their context, and lie afterwards in buckets by their own
hash, as sorted arrays. The texts are dealt into blocks. Each block asks every bucket once for the words and n-grams that
it has, and gets the part of the automaton that its texts can reach; then one traversal from left to right scores them:
the state of a place is the longest context there that has arcs, and failure arcs are taken until one matches.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, crc32_of_id, discard, documents, release, small_batches, table, tidy
from .words import Hasher, Index, distinct, mixed, slices

FOLDS, HELD = 7, 2
ORDER = 3
LEAST_COUNT = 2
DISCOUNT = 0.75
#: Tokens whose n-grams make up a bucket, and a block of texts.
BUCKET, BLOCK = 1 << 21, 1 << 21
#: Rounds in which blocks are scored, so that only so small a share of what they ask for lies on disk at a time.
WAVES = 4
#: A context with this fraction of all tokens (there are at most as many) has its n-grams dealt over all buckets.
HOT = 4096
#: Bits of the bitmap of kept n-grams: what it rules out is surely not kept, all else is looked up. Beyond four n-grams a bit
#: it would rule out little and is not made.
MARK_BITS, _RANGE_BITS = 1 << 27, 1 << 23
#: Tokens that a task gathers before it passes on their counts.
_FLUSH = 1 << 21
#: Keys of what stands before a text, and of its end as a token.
_START, _END = np.uint64(1), np.uint64(2)

MODEL = "bucket long, keys binary, c binary, k binary, s binary, n long, total long"


def tokens(hasher: Hasher, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(keys of all tokens, tokens in each text): the words of each text, then its end."""
    h, n = hasher.of(texts)
    return np.insert(h, np.cumsum(n), _END), n + 1


def gram(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Keys of n-grams from those of their context and of their last n - 1 tokens."""
    with np.errstate(over="ignore"):
        return mixed(context * np.uint64(0x9E3779B97F4A7C15) + suffix)


def grams(w: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(keys, contexts, place): keys[k - 1] of the n-grams of order k that end at each token, contexts[k - 2] of those from
    order 2 on, and each token's place in its text. An n-gram of order k exists from place k - 2 on."""
    starts = np.cumsum(n) - n
    place = np.arange(len(w)) - np.repeat(starts, n)
    before = np.r_[_START, w[:-1]][: len(w)]
    before[starts] = _START
    keys, contexts = [w, gram(before, w)], [before]
    for _ in range(3, ORDER + 1):
        contexts.append(np.r_[_START, keys[-1][:-1]][: len(w)])
        keys.append(gram(contexts[-1], keys[-1]))
    return keys, contexts, place


def is_marked(bitmap: np.ndarray | None, key: np.ndarray) -> np.ndarray:
    if bitmap is None:
        return np.ones(len(key), bool)
    at = key & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def packed(x: np.ndarray, ascending: bool = False) -> bytes:
    """64-bit numbers as eight planes of bytes, ascending ones as their steps: high planes are zeros, which Spark compresses."""
    x = np.diff(x.view(np.uint64), prepend=np.uint64(0)) if ascending else x
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(x, kind=np.uint64, ascending: bool = False) -> np.ndarray:
    y = np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return (np.cumsum(y, dtype=np.uint64) if ascending else y).view(kind)


def buffers(column: pa.Array) -> list:
    """The binary values of an Arrow column, not copied; None where null."""
    return [x.as_buffer() if x.is_valid else None for x in column]


def equal_runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, ascending; an order of key by value; where in it each distinct key begins)."""
    by = np.argsort(key)
    k = key[by]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[at], by, at


def summed(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, an index of each in key, and the sums of the columns over each."""
    k, by, at = equal_runs(key)
    return k, by[at], *(np.add.reduceat(c[by], at) if len(at) else c[:0] for c in columns)


def dealt(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, its slice of each column) for each bucket that occurs; the order within a bucket is kept."""
    if len(bucket) and bucket.max() < 1 << 15:
        bucket = bucket.astype(np.int16)  # sorted by radix
    by = np.argsort(bucket, kind="stable")
    b, columns = bucket[by], [c[by] for c in columns]
    at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else []
    for lo, hi in zip(at, [*at[1:], len(b)]):
        yield int(b[lo]), *(c[lo:hi] for c in columns)


def joined(parts: list[np.ndarray], kind=np.uint64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts])


def batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int64(), "block": pa.int64(), "n": pa.int64(), "total": pa.int64(), "kind": pa.int32()}
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(x, pa.binary())) for x, c in zip(names, columns)], names)


def counted(docs: DataFrame, order: int, buckets: int, marked, hot, least: int) -> DataFrame:
    """Model rows of the n-grams of this order in docs(text) that come `least` times: their counts c by their own bucket, and
    for each context the number k and the sum s of its kept n-grams, by the context's bucket."""
    wide = np.uint64(buckets)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, size = Hasher(), [], 0
        bitmap, often = marked and marked.value, Index(hot.value if hot else np.zeros(0, np.uint64))

        def flush() -> pa.RecordBatch:
            context, key = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            held.clear()
            k, by, at = equal_runs(key)
            p, c = context[by[at]], np.diff(np.r_[at, len(by)])
            del context, key, by, at
            bucket = p % wide
            spread = often.places(p) < len(often)
            bucket[spread] = k[spread] % wide
            by = np.argsort(p)  # equal contexts side by side take little room when compressed
            columns = [k[by], c[by], p[by]][: 2 + (order > 1)]
            return batch([(to, *map(packed, x), None)[:4] for to, *x in dealt(bucket[by].astype(np.int64), *columns)], ["bucket", "keys", "c", "p"])

        for b in slices(batches, 0):
            w, n = tokens(hasher, b.column(0))
            keys, contexts, place = grams(w, n)
            if order == 1:
                held.append((w, w))
            else:
                p, suffix = contexts[order - 2], keys[order - 2]
                live = (place >= order - 2) & is_marked(bitmap, suffix) & (is_marked(bitmap, p) | (p == _START))
                held.append((p[live], keys[order - 1][live]))
            size += len(held[-1][0])
            if size > _FLUSH:
                yield flush()
                size = 0
        if held:
            yield flush()
        release()

    def settle(t: pa.Table) -> pa.Table:
        columns = [joined([unpacked(x) for x in buffers(t.column(name))]) for name in ("keys", "c", "p")[: 2 + (order > 1)]]
        k, first, c = summed(columns[0], columns[1].view(np.int64))
        keep = c >= least
        k, c, rows = k[keep], c[keep], []
        for to, x, y in dealt((k % wide).astype(np.int64), k, c):
            rows.append((to, packed(x, True), packed(y), None, None, len(x), int(y.sum())))
        if order > 1:
            p, _, n, s = summed(columns[2][first][keep], np.ones(len(k), np.int64), c)
            rows += [(to, packed(x, True), None, packed(y), packed(z), 0, 0) for to, x, y, z in dealt((p % wide).astype(np.int64), p, n, s)]
        out = pa.Table.from_batches([batch(rows, [x.split()[0] for x in MODEL.split(", ")])])
        rows.clear()
        release()
        return out

    got = docs.select("text").mapInArrow(gather, "bucket long, keys binary, c binary, p binary")
    return checkpointed(got.groupBy("bucket").applyInArrow(settle, MODEL))


def frequent(model: DataFrame, most: int) -> np.ndarray:
    """Keys with a count of 1 / HOT of all tokens, and what stands before a text, ascending: HOT + 1 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, c in zip(buffers(b.column(0)), buffers(b.column(1))):
                yield batch([(unpacked(keys, ascending=True)[unpacked(c, np.int64) >= most].tobytes(),)], ["keys"])

    found = model.where("c is not null").select("keys", "c").mapInArrow(run, "keys binary").where(F.octet_length("keys") > 0).toArrow()
    return distinct(np.r_[_START, joined([np.frombuffer(x, np.uint64) for x in found.column(0).to_pylist()])])


def marks(model: DataFrame) -> np.ndarray | None:
    """The bitmap of keys that are kept, by their last bits; None where too many are for it to be of use."""
    if (model.agg(F.sum("n")).first()[0] or 0) > 4 * MARK_BITS:
        return None

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, c in zip(buffers(b.column(0)), buffers(b.column(1))):
                at = np.sort((unpacked(keys, ascending=True)[unpacked(c, np.int64) >= LEAST_COUNT] & np.uint64(MARK_BITS - 1)).astype(np.uint32))
                yield batch([(to, x.tobytes()) for to, x in dealt((at // _RANGE_BITS).astype(np.int64), at % np.uint32(_RANGE_BITS))], ["bucket", "at"])

    def settle(t: pa.Table) -> pa.Table:
        bits = np.zeros(_RANGE_BITS, bool)
        for x in t.column("at").to_pylist():
            bits[np.frombuffer(x, np.uint32)] = True
        return pa.table({"bucket": t.column("bucket").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    placed = model.where("c is not null").select("keys", "c").mapInArrow(place, "bucket long, at binary")
    out = np.zeros(MARK_BITS // 8, np.uint8)
    for r in placed.groupBy("bucket").applyInArrow(settle, "bucket long, bits binary").toLocalIterator():
        out[r["bucket"] * (_RANGE_BITS // 8) :][: _RANGE_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def grouped(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """(value, batches of its rows) of sorted rows; what is left of a value's batches is read before the next one."""
    waiting: list[pa.RecordBatch] = []

    def rows(value: int) -> Iterator[pa.RecordBatch]:
        while True:
            b = waiting.pop() if waiting else next(batches, None)
            if b is None:
                return
            if not b.num_rows:
                continue
            n = int(np.searchsorted(b.column(at).to_numpy(), value, "right"))
            if n < b.num_rows:
                waiting.append(b.slice(n))
            if n:
                yield b.slice(0, n)
            if n < b.num_rows:
                return

    while True:
        b = waiting.pop() if waiting else next(batches, None)
        if b is None:
            return
        if not b.num_rows:
            continue
        at = b.schema.get_field_index(by)
        waiting.append(b)
        value = b.column(at)[0].as_py()
        mine = rows(value)
        yield value, mine
        for _ in mine:
            pass


def asked(texts: DataFrame, buckets: int, marked) -> DataFrame:
    """(bucket, block, keys) of the words and n-grams that each block of texts(block, text) has."""
    wide = np.uint64(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for block, mine in grouped(batches, "block"):
            held = [np.array([_START])]
            for b in slices(mine, 1):
                keys, _, place = grams(*tokens(hasher, b.column(1)))
                held.append(distinct(keys[0]))
                for k in range(2, ORDER + 1):
                    bitmap = marked[k - 2] and marked[k - 2].value
                    of = keys[k - 1][place >= k - 2]
                    held.append(distinct(of[is_marked(bitmap, of)]))
                if sum(map(len, held)) > _FLUSH:
                    held = [distinct(np.concatenate(held))]
            every = distinct(np.concatenate(held))
            held.clear()
            yield batch([(to, block, packed(k, True)) for to, k in dealt((every % wide).astype(np.int64), every)], ["bucket", "block", "keys"])
        release()

    dealt_out = texts.select("block", "text").repartition("block").sortWithinPartitions("block")
    return dealt_out.mapInArrow(run, "bucket long, block long, keys binary")


def answers(models: list[DataFrame], requests: DataFrame) -> DataFrame:
    """(block, keys, c, k, s): what the model has of the keys that a block asks a bucket for."""
    names = ["block", "keys", "c", "k", "s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, mine in grouped(batches, "bucket"):
            held: list[list] | None = [[], [], [], []]
            for b in mine:
                kinds, blocks = (b.column(i).to_pylist() for i in (1, 2))
                for kind, block, keys, *columns in zip(kinds, blocks, *(buffers(x) for x in b.columns[3:])):
                    q = unpacked(keys, ascending=True)
                    if kind == 0:
                        held[0].append(q)
                        for x, v in zip(held[1:], columns):
                            x.append(np.zeros(len(q), np.int64) if v is None else unpacked(v, np.int64))
                        continue
                    if held is not None:
                        key, _, *stats = summed(joined(held[0]), *(joined(x, np.int64) for x in held[1:]))
                        held = None
                    if not len(key):
                        continue
                    at = np.minimum(np.searchsorted(key, q), len(key) - 1)
                    hit = key[at] == q
                    yield batch([(block, packed(q[hit], True), *(packed(x[at[hit]]) for x in stats))], names)
        release()

    none = F.lit(None).cast("binary")
    both = requests.select("bucket", F.lit(1).alias("kind"), "block", "keys", none.alias("c"), none.alias("k"), none.alias("s"))
    for m in models:
        both = both.unionAll(m.select("bucket", F.lit(0), F.lit(-1).cast("long"), "keys", "c", "k", "s"))
    return both.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, "block long, keys binary, c binary, k binary, s binary")


class Part:
    """The part of the automaton that a block of texts can reach: key -> count, and number and sum of the arcs kept there."""

    def __init__(self, columns: list[list[np.ndarray]], train: int, kinds: int, texts: int):
        """columns: keys, c, k and s in pieces, which are taken out of it."""
        keys = joined(columns[0])
        columns[0].clear()
        by = np.argsort(keys)
        self.index = Index(keys[by])
        self.stats = []
        for x in columns[1:]:
            found = np.zeros(len(keys) + 1, np.result_type(np.uint32, *x))
            found[:-1] = joined(x, found.dtype)[by]
            self.stats.append(found)
            x.clear()
        del keys, by
        release()
        self.all = train + kinds + 1
        _, k, s = (int(x[0]) for x in self.look_up(np.array([_START])))
        self.start = texts, k, s

    def look_up(self, q: np.ndarray) -> list[np.ndarray]:
        at = self.index.places(q)
        return [x[at].astype(np.int64) for x in self.stats]

    def walk(self, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count of each token, its probability) along the texts.

        All places go at once, from the empty context up: where the context of the next order has arcs, its arc is taken if
        it has one for the token, and else its failure arc, whose weight multiplies what the shorter context gives.
        """
        keys, _, place = grams(w, n)
        here = self.look_up(keys[0])
        count = here[0]
        p = (count + 1) / self.all
        for k in range(2, ORDER + 1):
            of, arcs, sums = (np.r_[0, x[:-1]][: len(w)] for x in here)  # of the context, which ends a place before
            if k == 2:
                for x, v in zip((of, arcs, sums), self.start):
                    x[place == 0] = v
            live = (arcs > 0) & (place >= k - 2)
            here = self.look_up(keys[k - 1])
            total = np.maximum(of, 1).astype(float)
            failure = (of - sums + DISCOUNT * arcs) / total
            arc = np.where(here[0] > 0, (here[0] - DISCOUNT) / total, 0.0)
            p = np.where(live, arc + failure * p, p)
        return count, p


def scored(texts: DataFrame, parts: DataFrame, train: int, kinds: int, starts: int) -> DataFrame:
    """texts(block, doc_id, held_out, text), parts(block, keys, c, k, s) -> a row for each text."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
    all_ = math.log10(train + kinds + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for _, mine in grouped(batches, "block"):
            held: list[list] | None = [[], [], [], []]
            for b in mine:
                is_text = b.column(1).to_numpy() == 1
                at = int(np.argmax(is_text)) if is_text.any() else b.num_rows
                for i, x in enumerate(b.columns[5:]):
                    if at:
                        values = (unpacked(v, np.int64 if i else np.uint64, i == 0) for v in buffers(x.slice(0, at)))
                        held[i] += [v.astype(np.uint32) if i and len(v) and v.max() < 1 << 32 else v for v in values]
                b = b.slice(at)
                if not b.num_rows:
                    continue
                if held is not None:
                    part, held = Part(held, train, kinds, starts), None
                for b in slices([b], 4):
                    w, n = tokens(hasher, b.column(4))
                    c, p = part.walk(w, n)
                    of = np.cumsum(n) - n  # every text has a token
                    sums = (np.add.reduceat(x, of) for x in ((c > 0).astype(np.int64), np.log10(c + 1.0) - all_, np.log10(p)))
                    yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), pa.array(n), *(pa.array(x) for x in sums)], names)
        release()

    none = F.lit(None).cast("binary")
    rows = texts.select("block", F.lit(1).alias("kind"), "doc_id", "held_out", "text", *(none.alias(x) for x in ("keys", "c", "k", "s")))
    rows = rows.unionAll(parts.select("block", F.lit(0), F.lit(None).cast("long"), F.lit(None).cast("boolean"), F.lit(None).cast("string"), "keys", "c", "k", "s"))
    dealt_out = rows.repartition("block").sortWithinPartitions("block", "kind")
    return dealt_out.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    A null or empty text is the end alone. The fold of a null doc_id is that of an empty text; repeated rows count and
    score each for themselves. Words and n-grams are told apart by 64-bit hashes. Without training texts every word is
    unknown and has the probability 1.
    """
    docs = documents(docs).withColumn("held_out", F.pmod(crc32_of_id(F.col("doc_id")), F.lit(FOLDS)) == HELD)
    with tidy(docs.sparkSession):
        size, starts = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.col("held_out"))).first()
        buckets, blocks = (max(1, -(-size // (7 * most))) for most in (BUCKET, BLOCK))  # a word and its space have about 7 bytes
        training = docs.where(~F.col("held_out"))
        send: Callable = docs.sparkSession.sparkContext.broadcast
        models = [counted(training, 1, buckets, None, None, 1)]
        train, kinds = (int(x or 0) for x in models[0].agg(F.sum("total"), F.sum("n")).first())
        marked = []
        for order in range(2, ORDER + 1):
            known, hot = send(marks(models[-1])), send(frequent(models[-1], max(1, train // HOT)))
            models.append(counted(training, order, buckets, known, hot, LEAST_COUNT))
            marked += [known] if order > 2 else []
        marked.append(send(marks(models[-1])))
        texts = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long"))
        got, waves = [], min(WAVES, blocks)
        for wave in range(waves):
            mine = texts.where(F.col("block") % waves == wave)
            requests = checkpointed(asked(mine, buckets, marked))
            parts = checkpointed(answers(models, requests))
            discard(requests)
            got.append(checkpointed(scored(mine, parts, train, kinds, int(starts))))
            discard(parts)
        discard(*models)
    return functools.reduce(DataFrame.unionAll, got).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), "base_score", "score")


def op3_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return scores(table(spark, sf_dir, "documents"))
