"""Removal of repeated byte strings by sorted suffixes.

Every string of LENGTH bytes holds an anchor: the place of the least hash among its GRAM-byte windows. Equal strings have
equal anchors at equal distances, so only texts around anchors whose hash occurs twice are sorted. There the suffixes from
the anchors on, and the reversed prefixes before them, are put in order by deep-shallow sorting: multikey quicksort on words
to a shallow depth, and a blind trie for each group that is still equal there. Depths of common prefixes of neighbours then
tell, for every distance from the anchor, which strings occur more than once.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, discard, lean, small_batches, table

LENGTH, GRAM = 200, 32
#: Windows in a string: each string has its anchor among so many places.
SPAN = LENGTH - GRAM + 1
#: Depth in bytes to which suffixes and reversed prefixes are sorted by words before tries take over.
SHALLOW_RIGHT, SHALLOW_LEFT = GRAM + 8, 16
#: Anchors with more contexts than this are resolved by fingerprints of all their strings instead.
HOT = 100_000
#: Bytes that are hashed at a time, and bytes of contexts that are sorted at a time (unless one anchor has more).
_SEGMENT, _SORTED = 1 << 18, 1 << 23
_Q = 0x9E3779B97F4A7C15
_MASK = (1 << 20) - 1
#: A place in one long: position, whether the anchor is hot, least and greatest distance from a string's start.
_POS, _HOT, _LO, _BYTE = 17, 1 << 16, 8, 255


def _powers(q: int, n: int) -> np.ndarray:
    out = np.full(n, q, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Hashes of windows, from their polynomials."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


class Anchors:
    """Anchors of byte strings: places, hashes, and the range of distances from a string's start to its anchor."""

    def __init__(self):
        n = 2 * _SEGMENT + LENGTH
        self.up, self.down = _powers(_Q, n + 1), _powers(pow(_Q, -1, 1 << 64), n + 1)

    def of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, hash, least distance, greatest distance) in concatenated texts that end at `ends`.

        `data` has fewer than 2**20 bytes; strings never cross an end.
        """
        n = len(data)
        strings = n - LENGTH + 1
        if strings <= 0:
            return (np.zeros(0, np.int64),) * 4
        with np.errstate(over="ignore"):
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(data.astype(np.uint64) * self.up[:n] + self.up[:n], out=s[1:])
            h = _mixed((s[GRAM:] - s[:-GRAM]) * self.down[: n - GRAM + 1])
        v = (h & ~np.uint64(_MASK)) | np.arange(len(h), dtype=np.uint64)
        pad = -len(v) % SPAN
        blocks = np.r_[v, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))].reshape(-1, SPAN)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(behind[:strings], ahead[SPAN - 1 : SPAN - 1 + strings]) & np.uint64(_MASK)).astype(np.int64)
        start = np.arange(strings)
        first_end = np.searchsorted(ends, start, side="right")
        whole = start + LENGTH <= ends[np.minimum(first_end, len(ends) - 1)]
        start, at, text = start[whole], at[whole], first_end[whole]
        if not len(start):
            return (np.zeros(0, np.int64),) * 4
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
        last = np.r_[new[1:] - 1, len(at) - 1]
        place = at[new]
        return place, h[place].view(np.int64), place - start[last], place - start[new]

    def at(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The hashes of the windows of data that begin at the places."""
        h = np.zeros(len(places), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(GRAM):
                h += (data[places + k].astype(np.uint64) + np.uint64(1)) * self.up[k]
            return _mixed(h).view(np.int64)


def segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """(bytes, ends, [(text, offset)]): the texts in pieces of bounded size; long ones overlap by a string less one byte."""
    held, where, size = [], [], 0

    def out():
        return np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]), where

    for i, t in enumerate(texts):
        for lo in range(0, max(len(t) - LENGTH + 1, 0), _SEGMENT):
            piece = t[lo : lo + _SEGMENT + LENGTH - 1]
            held.append(piece)
            where.append((i, lo))
            size += len(piece)
            if size >= _SEGMENT:
                yield out()
                held, where, size = [], [], 0
    if held:
        yield out()


def anchors(rows: DataFrame) -> DataFrame:
    """(h, rid, at) of rows(rid, body); at is the packed place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors()
        for b in batches:
            rid = b.column(0).to_numpy()
            for data, ends, where in segments(b.column(1).to_pylist()):
                place, h, lo, hi = find.of(data, ends)
                part = np.searchsorted(ends, place, side="right")
                text, offset = (np.array([w[k] for w in where], np.int64) for k in (0, 1))
                pos = place - np.r_[0, ends[:-1]][part] + offset[part]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(rid[text[part]]), pa.array(pos << _POS | lo << _LO | hi)], ["h", "rid", "at"])

    return rows.select("rid", "body").mapInArrow(lean(run), "h long, rid long, at long")


def unpacked(at) -> tuple:
    """(position, least distance, greatest distance) of packed places, as numbers or arrays."""
    return at >> _POS, at >> _LO & _BYTE, at & _BYTE


def bodies(rows: pa.StructArray) -> pa.Array:
    """UTF-8 bytes of the texts in an Arrow column of whole rows."""
    return rows.field("text").cast(pa.binary())


def contexts(rows: DataFrame) -> DataFrame:
    """rows(rid, row, found array<long>) -> (h, rid, at, context); found holds packed places.

    A context that a text holds twice is passed on once; both places come without context: they are known to be repeated.
    """
    names = ["h", "rid", "at", "context"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors()
        for b in batches:
            out: list[list] = [[] for _ in names]
            size = 0

            def put(*row) -> None:
                for x, v in zip(out, row):
                    x.append(v)

            texts = [x or b"" for x in bodies(b.column("row")).to_pylist()]
            found = b.column("found")
            places = found.flatten().to_numpy()
            n = found.value_lengths().to_numpy()
            begins = np.repeat(np.cumsum([0, *map(len, texts)])[:-1], n)
            hashes = find.at(np.frombuffer(b"".join(texts), np.uint8), begins + unpacked(places)[0]).tolist()
            places, upto = places.tolist(), np.cumsum(n).tolist()
            for rid, body, first, last in zip(b.column("rid").to_pylist(), texts, [0, *upto], upto):
                seen: dict[tuple[int, bytes], int] = {}
                for h, at in zip(hashes[first:last], places[first:last]):
                    pos, lo, hi = unpacked(at)
                    context = body[pos - hi : pos - lo + LENGTH]
                    before = seen.get((hi, context))
                    if before is None:
                        seen[hi, context] = at
                        put(h, rid, at, context)
                        size += len(context)
                    else:
                        if before >= 0:
                            put(h, rid, before, None)
                            seen[hi, context] = -1
                        put(h, rid, at, None)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)
                    out[:] = [[] for _ in names]
                    size = 0
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names)

    return rows.select("rid", "row", "found").mapInArrow(lean(run), "h long, rid long, at long, context binary")


def blind_trie(numbers: list[int], width: int, members: list[int]) -> tuple[list[int], list[int]]:
    """(members in order, common prefix of each with the one before) of byte strings of `width` bytes read as numbers.

    Inner nodes keep only the depth at which their children part and the bytes there; a string goes down blindly, is
    compared once with a leaf it arrives at, and is put in where they part.
    """

    def byte(x: int, depth: int) -> int:
        return x >> (8 * (width - 1 - depth)) & 255

    root: list | tuple = ("leaf", [members[0]])
    for m in members[1:]:
        x, node = numbers[m], root
        while type(node) is list:
            node = node[1].get(byte(x, node[0])) or next(iter(node[1].values()))
        differ = (x ^ numbers[node[1][0]]).bit_length()
        if not differ:
            node[1].append(m)
            continue
        depth = width - (differ + 7) // 8
        above, node = None, root
        while type(node) is list and node[0] < depth:
            above, node = node, node[1][byte(x, node[0])]
        if type(node) is list and node[0] == depth:
            node[1][byte(x, depth)] = ("leaf", [m])
            continue
        other = node
        while type(other) is list:
            other = next(iter(other[1].values()))
        parted = [depth, {byte(x, depth): ("leaf", [m]), byte(numbers[other[1][0]], depth): node}]
        if above is None:
            root = parted
        else:
            above[1][byte(x, above[0])] = parted
    order: list[int] = []
    common: list[int] = []
    stack: list[tuple] = [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if type(node) is tuple:
            order += node[1]
            common += [shared, *[width] * (len(node[1]) - 1)]
        else:
            children = [node[1][k] for k in sorted(node[1])]
            stack += [(c, node[0] if i else shared) for i, c in reversed(list(enumerate(children)))]
    return order, common


def multikey_quicksort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, start): rows of words in order of their words from the left; start marks places whose row differs from the one before.

    Every group of rows that agree up to their group's word is parted by a pivot into smaller, equal and larger ones; equal
    ones go on with the next word. All groups take their next step together, and equal rows stay in the order they came in.
    """
    n, width = words.shape
    order, level, start = np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool)
    start[:1] = True
    pick = np.random.default_rng(n)  # pivots decide how many steps are needed, never the result
    while True:
        first = np.flatnonzero(start)
        size = np.diff(np.r_[first, n])
        live = np.repeat((size > 1) & (level[first] < width), size)
        live = np.flatnonzero(live)
        if not len(live):
            return order, start
        begins = start[live]
        first = np.flatnonzero(begins)
        size = np.diff(np.r_[first, len(live)])
        group = np.cumsum(begins) - 1
        rows = order[live]
        w = words[rows, level[live]]
        x, y, z = (w[first + (pick.random(len(first)) * size).astype(np.int64)] for _ in range(3))
        pivot = np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z))[group]
        below, above = w < pivot, w > pivot
        # each side's rows keep their order behind the sides before it
        sides = (below, ~(below | above), above)
        base, place = first.copy(), np.empty(len(live), np.int64)
        for side in sides:
            upto = np.cumsum(side)
            before = upto[first] - side[first]
            place[side] = (base[group] + upto - 1 - before[group])[side]
            held = np.add.reduceat(side.astype(np.int64), first)
            start[live[base[held > 0]]] = True
            base = base + held
        order[live[place]] = rows
        level[live[place[sides[1]]]] += 1


def common_bytes(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row of words, in order, shares from the left with the one before, 0 for the first."""
    differ = words[order[1:]] ^ words[order[:-1]]
    k = (differ != 0).argmax(axis=1) if len(differ) else np.zeros(0, np.int64)
    x = differ[np.arange(len(differ)), k]
    bits = np.zeros(len(x), np.int64)
    for s in (32, 16, 8):
        up = (x >> np.uint64(s)) > 0
        bits += np.where(up, s, 0)
        x = np.where(up, x >> np.uint64(s), x)
    return np.r_[0, np.where(x > 0, 8 * k + 7 - bits // 8, 8 * words.shape[1])]


def deep_shallow(strings: list[bytes], width: int, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the strings' order, padded with zeros to `width`, and the common prefix of each with the one before.

    Multikey quicksort on words of eight bytes orders them to the shallow depth; a blind trie orders each group that is
    still equal there.
    """
    n = len(strings)
    words = np.frombuffer(b"".join([s[:shallow].ljust(shallow, b"\0") for s in strings]), ">u8").reshape(n, shallow // 8).astype(np.uint64)
    order, start = multikey_quicksort(words)
    common = common_bytes(words, order)
    first = np.flatnonzero(start)
    last = np.r_[first[1:], n]
    wide = last - first > 1
    for lo, hi in zip(first[wide].tolist(), last[wide].tolist()):
        members = order[lo:hi].tolist()
        numbers = {m: int.from_bytes(strings[m].ljust(width, b"\0"), "big") for m in members}
        got, shared = blind_trie(numbers, width, members)
        order[lo:hi] = got
        common[lo + 1 : hi] = shared[1:]
    return order, common


def repeated_distances(lo: np.ndarray, hi: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) distance from its anchor at which each context's string occurs again, (1, 0) where none does."""
    n = len(texts)
    ids: dict[tuple[int, bytes], int] = {}
    of = np.array([ids.setdefault((h, t), len(ids)) for h, t in zip(hi.tolist(), texts)], np.int64)
    _, rep, count = np.unique(of, return_index=True, return_counts=True)
    low, high = np.ones(len(rep), np.int64), np.zeros(len(rep), np.int64)
    twice = count > 1
    low[twice], high[twice] = lo[rep][twice], hi[rep][twice]
    if len(rep) > 1:
        a, b = lo[rep].astype(np.int64), hi[rep].astype(np.int64)
        right = [texts[k][hi[k] :] for k in rep]
        left = [texts[k][: hi[k]][::-1] for k in rep]
        ranks = []
        for strings, width, shallow in ((right, LENGTH, SHALLOW_RIGHT), (left, SPAN - 1, SHALLOW_LEFT)):
            order, common = deep_shallow(strings, width, shallow)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            ranks.append((rank, common))
        (rr, cr), (rl, cl) = ranks
        # a suffix shares an anchor's window with a neighbour, or its strings cannot come twice
        alone = np.maximum(cr, np.r_[cr[1:], 0]) < GRAM
        maybe = ~alone[rr]
        for d in range(SPAN):
            here = np.flatnonzero(maybe & (a <= d) & (d <= b))
            if len(here) < 2:
                continue
            code = np.cumsum(cr < LENGTH - d)[rr[here]] * np.int64(len(rep) + 1) + np.cumsum(cl < d)[rl[here]]
            by = np.argsort(code, kind="stable")
            c = code[by]
            same = c[1:] == c[:-1]
            hit = here[by[np.r_[False, same] | np.r_[same, False]]]
            none = low[hit] > high[hit]
            low[hit] = np.where(none, d, np.minimum(low[hit], d))
            high[hit] = np.where(none, d, np.maximum(high[hit], d))
    return low[of], high[of]


def repeated_spans(found: DataFrame) -> DataFrame:
    """contexts -> (rid, s, e): bytes that repeated strings cover."""
    names = ["rid", "s", "e"]

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        rid = t.column("rid").to_numpy()
        pos, lo, hi = unpacked(t.column("at").to_numpy())
        low, high = repeated_distances(lo, hi, t.column("context").to_pylist())
        hit = low <= high
        return pa.RecordBatch.from_arrays([pa.array(rid[hit]), pa.array(pos[hit] - high[hit]), pa.array(pos[hit] - low[hit] + LENGTH)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            h = b.column(0).to_numpy()
            if size > _SORTED and len(h):  # close at the first change of anchor
                last = held[-1].column(0)[len(held[-1]) - 1].as_py()
                at = int(np.flatnonzero(h != last)[0]) if (h != last).any() else len(h)
                if at < len(h):
                    if at:
                        held.append(b.slice(0, at))
                    yield settle(held)
                    held, size, b = [], 0, b.slice(at)
            if b.num_rows:
                held.append(b)
                size += b.nbytes
        if held:
            yield settle(held)

    hot = F.col("at").bitwiseAND(_HOT) != 0
    whole = F.col("context").isNotNull()
    ordered = found.where(whole & ~hot).select("h", "rid", "at", "context").repartition("h").sortWithinPartitions("h")
    sorted_ = ordered.mapInArrow(lean(run), "rid long, s long, e long")
    pos, lo, hi = F.shiftright("at", _POS), F.shiftright("at", _LO).bitwiseAND(_BYTE), F.col("at").bitwiseAND(_BYTE)
    known = found.where(~whole).select("rid", (pos - hi).alias("s"), (pos - lo + LENGTH).alias("e"))
    return sorted_.unionByName(known).unionByName(hot_spans(found.where(whole & hot)))


def hot_spans(found: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts: every string has a 128-bit fingerprint, whose counts are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rids, starts, prints = [], [], []
            for rid, at, context in zip(*(b.column(c).to_pylist() for c in ("rid", "at", "context"))):
                pos, lo, hi = unpacked(at)
                for k in range(hi - lo + 1):
                    rids.append(rid), starts.append(pos - hi + k), prints.append(xxhash.xxh3_128_digest(context[k : k + LENGTH]))
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(starts, pa.int64()), pa.array(prints, pa.binary())], ["rid", "s", "print"])

    prints = found.select("rid", "at", "context").mapInArrow(lean(run), "rid long, s long, print binary")
    twice = prints.groupBy("print").count().where("count > 1").select("print")
    return prints.join(twice, "print").select("rid", "s", (F.col("s") + LENGTH).alias("e"))


def removed(docs: DataFrame) -> DataFrame:
    """Every row of docs as a struct, spans of its text's bytes that occur again, and the copies of the whole text.

    A null text is empty; equal texts of LENGTH bytes or more go entirely, as every string of theirs occurs again.
    """
    rows = docs.select(F.struct(*[(docs[c].cast("string") if c == "text" else docs[c]).alias(c) for c in docs.columns]).alias("row"))
    rows = rows.withColumn("rid", F.xxhash64("row"))
    bodied = rows.select("rid", F.coalesce("row.text", F.lit("")).cast("binary").alias("body"))
    # Equal texts are found by digest; one of them stands for all.
    keyed = bodied.select("rid", F.md5("body").alias("m"))
    groups = keyed.groupBy("m").agg(F.min("rid").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    copies = checkpointed(keyed.join(groups, "m").groupBy("rid").agg(F.first("rep").alias("rep"), F.first("copies").alias("copies")))
    # Anchors are found once. Each step ends in a table, so that its shuffle files go before the texts are shuffled.
    all_anchors = checkpointed(anchors(bodied).join(copies, "rid", "left").where("rep is null or rep = rid").select("h", "rid", "at"))
    # anchors are counted before they are shuffled; the join of two plain tables can be split where an anchor is common
    often = checkpointed(all_anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    repeated = all_anchors.join(often, "h").select("rid", (F.col("at") + F.when(F.col("n") > HOT, _HOT).otherwise(0)).alias("at"))
    by_text = checkpointed(repeated.groupBy("rid").agg(F.collect_list("at").alias("found")))  # bounded by the text's length
    discard(all_anchors, often)
    # Both uses of the texts take whole rows, so that one exchange serves both.
    dealt = rows.repartition("rid")
    spans = repeated_spans(contexts(dealt.join(by_text, "rid", "left").where("found is not null")))
    spans = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))
    full = dealt.join(spans, "rid", "left").join(copies, "rid", "left")
    return full.select("row", "spans", F.coalesce("copies", F.lit(1)).alias("copies"))


def cut(body: bytes, spans: list[dict] | None, copies: int) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed)."""
    if copies > 1 and len(body) >= LENGTH:
        return b"", len(body), 1
    runs: list[list[int]] = []
    for x in spans or []:
        if runs and x["s"] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], x["e"])
        else:
            runs.append([x["s"], x["e"]])
    kept, at = [], 0
    for s, e in runs:
        kept.append(body[at:s])
        at = e
    kept.append(body[at:])
    left = b"".join(kept)
    return left, len(body) - len(left), len(runs)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; an empty table gives an empty result."""
    got = removed(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names[1:]]
            for body, spans, copies in zip(bodies(b.column("row")).to_pylist(), b.column("spans").to_pylist(), b.column("copies").to_pylist()):
                body = body or b""
                left, gone, runs = cut(body, spans, copies)
                for x, v in zip(out, (len(body), gone, runs, hashlib.sha256(left).hexdigest())):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([b.column("row").field("doc_id"), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], names)

    return got.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated strings cut out of text; other columns as they are, but n_chars, where there is one, counts anew.

    Bytes of characters that a cut has torn apart go with it, so that what is left is text. A null text stays null.
    """
    got = removed(docs)
    left_name = next(f"__left{i}" for i in itertools.count() if f"__left{i}" not in docs.columns)
    schema = docs.withColumn(left_name, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("row")
            cuts = zip(bodies(rows).to_pylist(), b.column("spans").to_pylist(), b.column("copies").to_pylist())
            left = [cut(body or b"", spans, copies)[0].decode("utf-8", "ignore") for body, spans, copies in cuts]
            yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(left, pa.string())], [*(f.name for f in rows.type), left_name])

    out = got.mapInArrow(lean(run), schema)
    changed = {"text": F.when(F.col("text").isNull(), None).otherwise(F.col(left_name))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(F.coalesce(F.col(left_name), F.lit(""))).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(changed).drop(left_name)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return digests(table(spark, sf_dir, "documents"))
