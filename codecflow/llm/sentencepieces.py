"""Encoding and decoding with merge-type SentencePiece vocabularies.

The encoder is an agenda of adjacent symbol pairs ordered by piece score, then by place: a heap, or a plain list for short parts. No merge can cross a place whose
two characters are neighbours in no piece of the vocabulary, so a text falls apart there: before space marks and between
letters and other characters, where the vocabulary allows it. Each part is encoded once and kept; the parts that an Arrow
batch brings are checked against the sentencepiece library, which also decodes.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, small_batches, table, tokenizer_path

MARK = "▁"
#: Parts whose encoding a worker keeps, and as many before them; the oldest half goes at once, less what was used since. That
#: changes no result.
KEPT_PARTS = 350_000
#: Symbols of a part up to which its agenda is a plain list, searched for the best rank: faster than a heap for words.
SHORT, NO_RANK = 32, 1 << 40


class Agenda:
    """Greedy merging by score for one vocabulary, as the library's BPE model does it."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(pieces) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))}
        score = {p: lib.get_score(i) for p, i in self.ids.items()}
        ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: ranks[s] for p, s in score.items()}
        self.fresh: list[str] = []
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        self.cut, self.before = self.cuts()
        self.known: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.older: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.numbers = list(range(n))

    def cuts(self) -> tuple[re.Pattern, dict[bool, str]]:
        """A pattern of the parts, and for parts that begin with a letter (or not) what may stand before them in a check."""
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            return re.compile(".+", re.S), {}
        words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        pairs = {x + y for p in self.ids for x, y in zip(p, p[1:]) if MARK not in (x, y)}
        letter = re.compile(r"[^\W\d_]")
        mixed = {x if letter.match(x) else y for x, y in pairs if bool(letter.match(x)) != bool(letter.match(y))}
        if len(mixed) > 50:
            return words, {}
        # the few letters that pieces join with other characters count as no letters
        none = "".join(sorted(map(re.escape, mixed)))
        letters, others = rf"[^\W\d_{none}]", rf"(?:(?!{MARK})[\W\d_{none}])"
        if any(re.search(f"{letters}{others}|{others}{letters}", p) for p in self.ids):
            return words, {}
        return re.compile(f"{MARK}*{letters}+|{MARK}*{others}+|{MARK}+"), {True: ".", False: "a"}

    def merge(self, symbols: str) -> list[int]:
        """Ids of one part: take the best-scored adjacent pair, leftmost among equals, until no pair is a piece."""
        out: list[int] = []
        for t in self.by_list(symbols) if len(symbols) <= SHORT else self.by_agenda(symbols):
            k = self.ids.get(t)
            if k is not None:
                out.append(k)
            elif self.byte:
                out += [self.byte[b] for b in t.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return out

    def by_list(self, symbols: str) -> list[str]:
        """by_agenda() of a short part: the agenda is the list of the ranks of all adjacent pairs, in their order."""
        rank = self.rank.get
        text = list(symbols)
        agenda = [rank(a + b, NO_RANK) for a, b in zip(text, text[1:])]
        while agenda:
            best = min(agenda)
            if best == NO_RANK:
                break
            i = agenda.index(best)
            text[i] = pair = text[i] + text.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(pair + text[i + 1], NO_RANK)
            if i:
                agenda[i - 1] = rank(text[i - 1] + pair, NO_RANK)
        return text

    def by_agenda(self, symbols: str) -> list[str]:
        """Symbols left when no adjacent pair is a piece. An entry of the agenda is the rank of a pair's score and its
        place in one number; an entry whose pair has changed meanwhile no longer has that rank and is passed over."""
        rank = self.rank.get
        text = list(symbols)
        n = len(text)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [r << 32 | i for i, r in enumerate([rank(a + b) for a, b in zip(text, text[1:])]) if r is not None]
        heapq.heapify(agenda)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            e = pop(agenda)
            i = e & 0xFFFFFFFF
            j = right[i]
            if j < 0 or not text[i]:
                continue
            pair = text[i] + text[j]
            if rank(pair) != e >> 32:
                continue
            text[i], text[j] = pair, ""
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                r = rank(pair + text[k])
                if r is not None:
                    push(agenda, r << 32 | i)
            k = left[i]
            if k >= 0:
                r = rank(text[k] + pair)
                if r is not None:
                    push(agenda, r << 32 | k)
        return [t for t in text if t]

    def parts(self, text: str) -> list[tuple[str, tuple[int, ...]]]:
        """(decimal ids joined by commas, ids) of each part of a text."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        found = self.cut.findall(marked)
        out = list(map(self.known.get, found))
        if None in out:
            for k, e in enumerate(out):
                if e is None:
                    out[k] = self.part(found[k])
        return out

    def part(self, p: str) -> tuple[str, tuple[int, ...]]:
        """What parts() gives for one part that was not known when its text came."""
        e = self.known.get(p) or self.older.get(p)
        if e is None:
            ids = tuple([self.numbers[i] for i in self.merge(p)])
            self.fresh.append(p)
            e = (",".join(map(str, ids)), ids)
        if len(p) <= 64:
            if len(self.known) >= KEPT_PARTS:
                self.known, self.older = {}, self.known
            self.known[p] = e
        return e

    def check(self) -> None:
        """Holds every part encoded since the last call against the library, which puts a space mark before each text."""
        fresh, self.fresh = self.fresh, []
        texts, ahead, merged = [], [], {"": []}
        for p in fresh:
            if not p.strip(MARK):  # marks alone: the library adds none to an empty text
                c = "a"
            else:
                c = "" if p[0] == MARK else self.before[not self.cut.fullmatch("." + p)]
            texts.append(c + p if c else p[1:])
            if c not in merged:
                merged[c] = self.merge(MARK + c)
            ahead.append(merged[c])
        for p, a, want in zip(fresh, ahead, self.lib.encode(texts, num_threads=1) if fresh else []):
            got = self.known.get(p) or self.older.get(p)
            if [*a, *(got[1] if got else self.merge(p))] != want:
                raise ValueError("the agenda and the library differ on " + repr(p[:60]))

    def encode(self, text: str) -> list[int]:
        return [i for e in self.parts(text) for i in e[1]]


@functools.cache
def agenda_of(path: str) -> Agenda:
    """One agenda for all tasks of a Python worker."""
    return Agenda(path)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; a null text is empty and has no ids.

    The parts that a batch brings for the first time are held against the library's encoding of them; a difference fails
    the task, results are never guessed. Repeated rows are encoded each for themselves; an empty table gives an empty result.
    """
    model = tokenizer_path("piece_bpe_32k.model", path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda = agenda_of(model)
        for b in batches:
            counts, sha, decoded = [], [], []
            for t in b.column(1).to_pylist():
                parts = agenda.parts(t or "")
                ids = list(chain.from_iterable([e[1] for e in parts]))
                counts.append(len(ids))
                sha.append(hashlib.sha256(",".join([e[0] for e in parts]).encode()).hexdigest())
                decoded.append(hashlib.sha256(agenda.lib.decode(ids).encode() if ids else b"").hexdigest())
            agenda.check()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(sha, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return encode_decode(table(spark, sf_dir, "documents"))
