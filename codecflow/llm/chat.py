"""Chat formatting over a prefix tree: turns that conversations share from their start on are emitted once.

Conversations are ordered by the hashes of all their turns, so that neighbours share as long a prefix as they can, and dealt
out by ranges of that order; each task walks its range once, keeps the path of the current conversation and emits only what
is new, depth first. A tree is closed at a fixed number of tokens, as a sequence to train on is, and what the next one shares
with it is emitted anew: so no first turn, however common, meets in one task. Every node has the tokens of its turn, a
position id for each (the tokens above it and before it), the place of its first token in the tree's sequence, and the
intervals of places that its tokens may attend to.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, small_batches, table, tokenizer_path

#: A tree is closed when its sequence has so many tokens.
TREE_TOKENS = 1 << 18
LOSS_ROLE = "assistant"
OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<#]|\\.)*)</turn>\n", re.S)
NODES = "tree long, n long, depth long, start long, tokens array<int>, positions array<int>, intervals array<struct<lo:long,hi:long>>, loss_lo long, loss_hi long, is_leaf boolean, conv_id long"
_STRUCT = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(_STRUCT), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
_NAMES = [x.split()[0] for x in NODES.split(", ")]


@functools.lru_cache(2)
def codec(path: str) -> tuple[Callable[[str], list[int]], Callable[[list[int]], str]]:
    """(encode, decode) of a byte-level vocabulary, without special tokens; decoding gives every text back."""
    from tokenizers import Tokenizer

    from .packing import fast_encoder

    whole = Tokenizer.from_file(path)
    encode = fast_encoder(path, whole)
    owner = getattr(encode, "__self__", None)
    if owner is not None:
        return encode, lambda ids: owner.decode_bytes(ids).decode("utf-8")
    return encode, lambda ids: whole.decode(ids, skip_special_tokens=False)


def escape(text: str) -> str:
    r"""Every character that a control string begins with gets a backslash: \, #, < and :."""
    return re.sub(r"([\\#<:])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where in it the loss mask lies (empty but for the assistant)."""
    head = OPEN + escape(role) + BETWEEN
    body = escape(text)
    lo, hi = (len(head), len(head) + len(body)) if role == LOSS_ROLE else (0, 0)
    return head + body + CLOSE, lo, hi


def tokenized(encode: Callable[[str], list[int]], role: str, text: str) -> tuple[list[int], int, int]:
    """A turn's tokens, and where in them the loss mask lies: its borders are borders of tokens."""
    out, lo, hi = formatted(role, text)
    if lo == hi:
        return encode(out), 0, 0
    head, body = encode(out[:lo]), encode(out[lo:hi])
    return [*head, *body, *encode(out[hi:])], len(head), len(head) + len(body)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int = 512, most_chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    chars = 0
    for r in rows:
        held.append(r)
        chars += sum(len(x) for x in r if isinstance(x, (str, bytes, list)))
        if len(held) >= size or chars >= most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, role, text) by conversation and turn -> with number of the turn and node hash; behind each conversation a row
    of turn -1 with its key: eight bytes of the hash of each of its nodes."""

    def rows() -> Iterator[tuple]:
        current, started, chain, key, n = None, False, b"", bytearray(), 0
        for conv, role, text in _rows(batches):
            if not started or conv != current:
                if started:
                    yield current, -1, None, None, None, bytes(key)
                current, started, chain, key, n = conv, True, b"", bytearray(), 0
            h = hashlib.blake2b(chain, digest_size=16)
            for part in (role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")):
                h.update(len(part).to_bytes(8, "big") + part)
            chain = h.digest()
            key += chain[:8]
            yield conv, n, chain, role, text, None
            n += 1
        if started:
            yield current, -1, None, None, None, bytes(key)

    yield from _batched(rows(), ["conv_id", "turn", "node", "role", "text", "key"], [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.binary()])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id in order -> (conv, part, rank): the task's number and the place in it."""
    from pyspark import TaskContext

    part, rank = TaskContext.get().partitionId(), 0
    for b in batches:
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([part] * n, pa.int64()), pa.array(range(rank, rank + n), pa.int64())], ["conv", "part", "rank"])
        rank += n


def _walked(path_of: str, most: int) -> Callable:
    """Turns in order -> nodes of prefix trees, depth first, each conversation's leaf after its last node."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, _ = codec(path_of)
        first = TaskContext.get().partitionId() << 32

        def leaf(tree, n, depth, conv):
            return (tree, n, depth, None, None, None, None, None, None, True, conv)

        def rows() -> Iterator[tuple]:
            tree, n, place = first, 0, 0
            path: list[tuple[bytes, int, int, list]] = []  # node, position behind it, place behind it, intervals with it
            conv, started, depth = None, False, 0
            for c, turn, node, role, text in _rows(batches):
                if turn == 0:
                    if started:
                        del path[depth:]
                        yield leaf(tree, n, depth, conv)
                        n += 1
                        if place >= most:
                            tree, n, place, path = tree + 1, 0, 0, []
                    conv, started, depth = c, True, 0
                if depth < len(path) and path[depth][0] == node:
                    depth += 1
                    continue
                del path[depth:]
                ids, lo, hi = tokenized(encode, role, text)
                position, above = (path[-1][1], path[-1][3]) if path else (0, [])
                end = place + len(ids)
                intervals = [*above[:-1], (above[-1][0], end)] if above and above[-1][1] == place else [*above, (place, end)]
                yield (tree, n, depth, place, ids, list(range(position, position + len(ids))), [{"lo": a, "hi": b} for a, b in intervals], lo, hi, False, None)
                path.append((node, position + len(ids), end, intervals))
                n, place, depth = n + 1, end, depth + 1
            if started:
                yield leaf(tree, n, depth, conv)

        yield from _batched(rows(), _NAMES, _TYPES)

    return walk


def prefix_trees(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """Nodes and leaves of the prefix trees of conversations(conv_id, turn, role, text).

    A node has its tree, number in depth-first order, depth, place of its first token in the tree's sequence, tokens and
    their position ids, intervals of places it attends to (its own last, up to the token itself), and the loss mask within
    its tokens. A leaf names a conversation that ends at the node of that depth on the current path. Null roles and texts
    are empty, null turns come first, rows of one turn are ordered by role and text, rows with a null conv_id form one
    conversation; an empty table gives no rows.
    """
    text = lambda c: F.coalesce(conversations[c].cast("string"), F.lit("")).alias(c)
    turns = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), text("role"), text("text"))
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    hashed = checkpointed(turns.mapInArrow(_hashed, "conv_id long, turn long, node binary, role string, text string, key binary"))
    # a conversation's key, whatever its length, is sorted once; its turns only get its number
    keys = hashed.where("turn = -1").select("conv_id", "key").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").select("conv_id")
    order = checkpointed(keys.mapInArrow(_numbered, "conv long, part long, rank long"))
    ranged = hashed.where("turn >= 0").join(order, F.col("conv_id").eqNullSafe(F.col("conv"))).repartitionByRange("part", "rank").sortWithinPartitions("part", "rank", "turn")
    return ranged.select("conv_id", "turn", "node", "role", "text").mapInArrow(_walked(tokenizer_path("byte_bpe_50k.json", path), TREE_TOKENS), NODES)


def _read(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    _, decode = codec(vocabulary)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def rows() -> Iterator[tuple]:
        path: list[tuple] = []
        tree = None
        for t, depth, ids, lo, hi, is_leaf, conv in _rows(batches):
            if t != tree:
                tree, path = t, []
            del path[depth:]
            if is_leaf:
                n, turns, chars, loss, total = path[-1]
                yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), total
                continue
            n, turns, chars, loss, total = path[-1] if path else (0, hashlib.sha256(), 0, hashlib.sha256(), 0)
            text = decode(ids)
            m = _TURN.fullmatch(text)
            if not m:
                raise ValueError("a turn is not in the template: " + repr(text[:80]))
            turns, loss = turns.copy(), loss.copy()
            turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            masked = unescape(decode(ids[lo:hi]))
            loss.update(masked.encode("utf-8", "surrogatepass"))
            path.append((n + 1, turns, chars + len(masked), loss, total + len(text)))

    yield from _batched(rows(), names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])


def read_back(nodes: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each conversation, parsed and unescaped from the trees: every node is read once, whoever shares it."""
    vocabulary = tokenizer_path("byte_bpe_50k.json", path)
    ordered = nodes.select("tree", "n", "depth", "tokens", "loss_lo", "loss_hi", "is_leaf", "conv_id").repartition("tree").sortWithinPartitions("tree", "n")
    return ordered.drop("n").mapInArrow(lambda batches: _read(batches, vocabulary), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_chat_prefix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(prefix_trees(conversations))
