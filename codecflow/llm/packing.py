"""Packing token sequences by cutting-stock column generation.

Every document gives its full sequences and one rest. The histogram of rests over length classes is a cutting-stock
problem whose size does not depend on the number of documents: a linear program over patterns of classes, priced by
knapsack dynamic programming. Rounded patterns are laid out one after the other and documents, ranked within their class,
find their place in a pattern by arithmetic. Token ids never leave the task that made them.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOCAL, TASK, documents, gapless_over_tasks, lean, numbered, one_thread, release, small_batches, table, tokenizer_path

SEQUENCE = 2048
#: Lengths are rounded up to this many tokens in the linear program.
CLASS_WIDTH = 8
END_ID = 1


def best_pattern(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: counts of classes 1 .. len(value) (class c takes c units) of the greatest value."""
    n = len(value)
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        top = min(c, n)
        got = best[c - 1 :: -1][:top] + value[:top]
        k = int(np.argmax(got))
        if got[k] > best[c - 1]:
            best[c], choice[c] = got[k], k + 1
        else:
            best[c], choice[c] = best[c - 1], 0
    counts, c = np.zeros(n, np.int64), capacity
    while c > 0:
        if choice[c]:
            counts[choice[c] - 1] += 1
            c -= choice[c]
        else:
            c -= 1
    return float(best[capacity]), counts


def column_generation(demand: np.ndarray, capacity: int, most_columns: int = 20_000) -> tuple[list[np.ndarray], np.ndarray]:
    """Patterns and how often the linear program uses each, so that the uses cover demand (of classes 1 .. n) exactly.

    Revised simplex with the inverse of the basis kept; it stops when no pattern is worth more than one sequence.
    Whatever basis it stops at is feasible, so the bound on columns can only cost padding.
    """
    n = len(demand)
    rows = np.flatnonzero(demand > 0)
    if not len(rows):
        return [], np.zeros(0)
    patterns = []
    for r in rows:
        p = np.zeros(n, np.int64)
        p[r] = capacity // (r + 1)
        patterns.append(p)
    inverse = np.diag([1.0 / patterns[i][r] for i, r in enumerate(rows)])
    x = inverse @ demand[rows].astype(float)
    for step in range(most_columns):
        dual = inverse.sum(axis=0)
        value = np.zeros(n)
        value[rows] = np.maximum(dual, 0)
        worth, p = best_pattern(value, capacity)
        if worth <= 1 + 1e-6:
            break
        column = inverse @ p[rows]
        usable = column > 1e-9
        ratio = np.where(usable, x / np.where(usable, column, 1), np.inf)
        out = int(np.argmin(ratio))
        amount = ratio[out]
        x = x - amount * column
        x[out] = amount
        x = np.maximum(x, 0)
        pivot = inverse[out] / column[out]
        inverse = inverse - np.outer(column, pivot)
        inverse[out] = pivot
        patterns[out] = p
    return patterns, x


def rounded(demand: np.ndarray, patterns: list[np.ndarray], uses: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, whole uses) that cover demand exactly: the program's uses rounded down, the rest packed largest first."""
    left = demand.astype(np.int64).copy()
    plan = []
    for i in np.argsort(-uses, kind="stable"):
        p = patterns[i]
        k = min([int(uses[i] + 1e-6), *(left[p > 0] // p[p > 0]).tolist()])
        if k > 0:
            plan.append((p, k))
            left -= k * p
    while left.any():
        p, room = np.zeros_like(left), capacity
        for c in np.flatnonzero(left)[::-1]:
            k = min(int(left[c]), room // (int(c) + 1))
            p[c] += k
            room -= k * (int(c) + 1)
        k = int((left[p > 0] // p[p > 0]).min())
        plan.append((p, k))
        left -= k * p
    return plan


@dataclass
class Layout:
    """Where the ranked pieces of each class go: for class c, starts[c] are ranks at which patterns begin."""

    starts: list[np.ndarray]
    first: list[np.ndarray]
    each: list[np.ndarray]
    sequences: int

    def place(self, c: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, slot within the class) of the pieces of class c with these ranks."""
        at = np.searchsorted(self.starts[c], rank, side="right") - 1
        inside = rank - self.starts[c][at]
        return self.first[c][at] + inside // self.each[c][at], inside % self.each[c][at]


def layout(demand: np.ndarray, capacity: int) -> Layout:
    plan = rounded(demand, *column_generation(demand, capacity), capacity)
    n = len(demand)
    starts, first, each = ([[] for _ in range(n)] for _ in range(3))
    taken, sequence = np.zeros(n, np.int64), 0
    for p, k in plan:
        for c in np.flatnonzero(p):
            starts[c].append(int(taken[c]))
            first[c].append(sequence)
            each[c].append(int(p[c]))
            taken[c] += int(p[c]) * k
        sequence += k
    return Layout(*([np.array(y, np.int64) for y in x] for x in (starts, first, each)), sequence)


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", TASK]


class Whole:
    """The tokenizer of a file, read when a text asks for it: few do, and it takes 28 MB of a worker."""

    def __init__(self, path: str):
        self.path = path

    @functools.cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str, **options):
        return self.tokenizer.encode(text, **options)


def cut(batches: Iterator[pa.RecordBatch], path: str, special: str, sequence: int, width: int) -> Iterator[pa.RecordBatch]:
    """PIECE of the pieces of batches(doc_id, text, task): full sequences, then the rest.

    cls is 0 for full sequences; class c has up to c * width tokens.
    """
    one_thread()
    whole = Whole(path)
    encode = fast_encoder(path, whole)
    release()  # of what the vocabulary was read from
    for b in batches:
        out: list[list] = [[] for _ in PIECE]
        for doc_id, text, task in zip(*(c.to_pylist() for c in b.columns)):
            ids = encode(text) if text and special not in text else whole.encode(text, add_special_tokens=False).ids if text else []
            data = np.array([*ids, END_ID], "<u4")
            for start in range(0, len(data), sequence):
                piece = data[start : start + sequence]
                cls = 0 if len(piece) == sequence else -(-len(piece) // width)
                for x, v in zip(out, (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(data), cls, task)):
                    x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], PIECE)


def token_pieces(docs: DataFrame, path: str, special: str, sequence: int, width: int) -> DataFrame:
    """PIECE of each piece, and its number within its task and class; one worker does both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return numbered(cut(batches, path, special, sequence, width), "cls")

    return docs.withColumn(TASK, F.spark_partition_id().cast("long")).mapInArrow(lean(run), ", ".join(f"{c} long" for c in [*PIECE, LOCAL]))


def fast_encoder(path: str, whole):
    """The same ids by tiktoken, several times faster, where the vocabulary is byte-level BPE; else the tokenizer itself.

    tiktoken takes ranks instead of merges; the tests hold the two against each other. Texts with the string of a special
    token never come here.
    """
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
        return lambda text: whole.encode(text, add_special_tokens=False).ids
    import public_tokenizers
    import tiktoken

    letters = {c: b for b, c in byte_letters().items()}
    special = {x["content"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself where printable, else from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, width: int = CLASS_WIDTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every row of docs.

    A document is cut only where it fills whole sequences. A null or empty text is the end id alone. Repeated rows (and
    rows with a null doc_id) are documents of their own; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    classes = sequence // width
    pieces = token_pieces(documents(docs), tokenizer_path("byte_bpe_50k.json", path), "<|endoftext|>", sequence, width)
    ranked = gapless_over_tasks(pieces, "cls", "rank")
    counts = dict(ranked.groupBy("cls").count().collect())  # one row for each class at most
    demand = np.array([counts.get(c, 0) for c in range(1, classes + 1)], np.int64)
    plan = spark.sparkContext.broadcast(layout(demand, classes))
    full = counts.get(0, 0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, rank = b.column("cls").to_numpy(), b.column("rank").to_numpy()
            seq, slot = rank.copy(), np.zeros(len(rank), np.int64)
            for c in np.unique(cls[cls > 0]).tolist():
                of = cls == c
                seq[of], slot[of] = plan.value.place(c - 1, rank[of])
                seq[of] += full
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(seq), pa.array(slot)], [*b.schema.names, "sequence_id", "slot"])

    placed = ranked.mapInArrow(lean(place), ranked.withColumns({"sequence_id": F.lit(0).cast("long"), "slot": F.lit(0).cast("long")}).schema)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    before = Window.partitionBy("sequence_id").orderBy("cls", "slot").rowsBetween(Window.unboundedPreceding, -1)
    rests = placed.where("cls > 0").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return placed.where("cls = 0").select(*columns, F.lit(0).cast("long").alias("offset")).unionByName(rests.select(*columns, "offset"))


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack(table(spark, sf_dir, "documents"))
