"""Quality by nearest-neighbour voting in a latent semantic space.

A bounded sample of labelled documents spans the space (log term frequencies, inverse document frequencies, truncated
singular vectors). Their vectors are broadcast; every document is projected, compared with all of them by exact cosine
products in blocks, and takes the labels of its nearest ones weighted by similarity.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, documents, lean, one_thread, small_batches, table

#: Hashed terms, latent dimensions, labelled documents of each class that are fitted, neighbours that vote.
TERMS, LATENT, SAMPLE_PER_CLASS, NEIGHBOURS = 8192, 64, 1000, 25
#: Documents in a block of cosine products.
BLOCK = 256
THRESHOLD = 0.7
#: Held out: crc32 of the id's text modulo FOLDS is HELD.
FOLDS, HELD = 4, 2
#: The style terms (punctuation runs, capitals, line shapes) weigh so many times a word.
STYLE_WEIGHT = 3.0
_STYLE_TERMS = 256
_KEPT_WORDS = 200_000
_MARKS = re.compile(r"[^\w\s]+")


def style_terms(text: str, words: list[str]) -> list[tuple[str, float]]:
    """How a text is set, as (term, share): runs of marks, capitals, digits, repeated words and lines, short lines."""
    n = len(words) or 1
    lines = [x for x in text.split("\n") if x.strip()]
    marks: dict[str, int] = {}
    for m in _MARKS.findall(text):
        m = m[:3]
        marks[m] = marks.get(m, 0) + 1
    out = [("mark " + m, k / n) for m, k in marks.items()]
    out.append(("capitals", sum([w.isupper() for w in words]) / n))
    out.append(("digits", sum([w.isdigit() for w in words]) / n))
    out.append(("same words", 1 - len(set(words)) / n))
    out.append(("same lines", 1 - len(set(lines)) / (len(lines) or 1)))
    out.append(("lines", len(lines) / n))
    out.append(("letters", len(text) / n / 20))
    return out


class Terms:
    """Rows of hashed term weights; words below the style terms' places, style in the last _STYLE_TERMS."""

    def __init__(self, terms: int = TERMS):
        self.terms, self.known = terms, {}

    def row(self, text: str) -> np.ndarray:
        words = text.split()
        known = self.known
        at = [known.get(w, -1) for w in words]
        if -1 in at:
            if len(known) > _KEPT_WORDS:
                known.clear()
            for i, k in enumerate(at):
                if k < 0:
                    at[i] = known[words[i]] = zlib.crc32(words[i].lower().encode("utf-8", "surrogatepass")) % (self.terms - _STYLE_TERMS)
        out = np.bincount(np.array(at, np.int64), minlength=self.terms).astype(np.float32)
        if words:
            out /= len(words)
        np.log1p(out * 100, out=out)
        for term, share in style_terms(text, words):
            out[self.terms - _STYLE_TERMS + zlib.crc32(term.encode("utf-8", "surrogatepass")) % _STYLE_TERMS] += STYLE_WEIGHT * np.log1p(100 * share)
        return out


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    def latent(self, rows: np.ndarray) -> np.ndarray:
        z = (rows * self.idf) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest labelled vectors, by similarity; between 0 and 1.

        Vectors as similar as the last of the nearest vote too, so that ties never depend on an order.
        """
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        sims = self.latent(rows) @ self.vectors.T
        k = min(self.neighbours, sims.shape[1])
        last = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
        row, near = np.nonzero(sims >= last[:, None])
        weight = np.maximum(sims[row, near].astype(float), 0) ** 8 + 1e-9
        votes, all_ = (np.bincount(row, weights=w, minlength=len(rows)) for w in (weight * self.labels[near], weight))
        return np.clip(votes / all_, 0, 1)


def train(rows: np.ndarray, labels: np.ndarray, latent: int = LATENT, neighbours: int = NEIGHBOURS) -> Model:
    """Latent space and labelled vectors of term rows (a bounded number of them)."""
    if not len(rows):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), neighbours)
    idf = np.log((1 + len(rows)) / (1 + (rows > 0).sum(0))).astype(np.float32) + 1
    x = rows * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    power, left = np.linalg.eigh((x @ x.T).astype(np.float64))
    keep = np.argsort(-power)[: min(latent, len(rows))]
    keep = keep[power[keep] > 1e-9]
    axes = (x.T @ left[:, keep].astype(np.float32)) / np.sqrt(power[keep]).astype(np.float32)
    model = Model(idf, axes.astype(np.float32), np.zeros((0, 1), np.float32), labels.astype(float), neighbours)
    model.vectors = model.latent(rows).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """A model of the labelled rows outside the held-out fold: per_class of each label, those of the smallest hashes.

    Ids labelled both ways take the lower label. Texts are turned into term rows on the executors; the driver receives
    2 * per_class sparse rows of at most TERMS entries.
    """
    docs = documents(docs)
    marked = labels.where("doc_id is not null and quality is not null").groupBy(labels["doc_id"].cast("long").alias("__id")).agg(F.min("quality").alias("quality"))
    marked = marked.where(F.pmod(crc32_of_id(F.col("__id")), F.lit(FOLDS)) != HELD)
    marked = marked.join(docs.select("doc_id").where("doc_id is not null"), F.col("__id") == F.col("doc_id"), "left_semi")  # what an earlier stage took away is no label
    chosen = marked.where("quality = 1").orderBy(F.xxhash64("__id"), "__id").limit(per_class).unionAll(marked.where("quality <> 1").orderBy(F.xxhash64("__id"), "__id").limit(per_class))
    sample = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["__id"]).select("doc_id", "text", F.col("quality").cast("int"))  # 2 * per_class rows

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            at, weight = [], []
            for t in b.column(1).to_pylist():
                row = terms.row(t or "")
                nz = np.flatnonzero(row)
                at.append(nz.astype("<i4").tobytes())
                weight.append(row[nz].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(at, pa.binary()), pa.array(weight, pa.binary())], ["doc_id", "quality", "at", "weight"])

    # an id with several texts stands for the least of them, whatever the order of the rows
    got = sample.mapInArrow(lean(rows), "doc_id long, quality int, at binary, weight binary").groupBy("doc_id").agg(F.min(F.struct("quality", "at", "weight")).alias("r")).toLocalIterator()
    found = sorted((x["doc_id"], x["r"]["quality"], bytes(x["r"]["at"]), bytes(x["r"]["weight"])) for x in got)
    x = np.zeros((len(found), TERMS), np.float32)
    for i, (_, _, at, weight) in enumerate(found):
        x[i, np.frombuffer(at, "<i4")] = np.frombuffer(weight, "<f4")
    return train(x, np.array([q == 1 for _, q, _, _ in found], float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column `score`; docs must have a column `text`, whatever else it has stays as it is."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # TERMS * LATENT + 2 * SAMPLE_PER_CLASS * LATENT numbers
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        terms, m = Terms(), sent.value
        for b in batches:
            texts = b.column(at)
            scores = [np.zeros(0)]
            for lo in range(0, len(texts), BLOCK):
                rows = np.stack([terms.row(t or "") for t in texts.slice(lo, BLOCK).to_pylist()])
                scores.append(m.score(rows))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(scores))], [*b.schema.names, "score"])

    return docs.mapInArrow(lean(run), docs.withColumn("score", F.lit(0.0)).schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; only texts enter a score.

    Null and empty texts have a row of style terms only and are scored like others; repeated rows score alike; a null
    doc_id counts as empty text for the fold; without labels every score is 0.5.
    """
    got = scored(documents(docs), fit(docs, labels))
    return got.select("doc_id", (F.pmod(crc32_of_id(F.col("doc_id")), F.lit(FOLDS)) == HELD).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, that are predicted good."""
    whole = docs.select(F.struct("*").alias("__row"), docs["text"].cast("string").alias("text"))
    return scored(whole, fit(docs, labels)).where(F.col("score") >= THRESHOLD).select("__row.*")


def op6_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
