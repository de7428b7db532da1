"""Language identification with a string kernel.

Two texts are as similar as their sets of character n-grams: k(x, y) = |x & y| / sqrt(|x| |y|), the
normalised presence kernel of the blended spectrum (all n-gram lengths together, hashed to 2**16 buckets).
Nystroem landmarks are a sample of the labelled texts; kernel ridge regression is solved in their feature
space, one target per language. As the kernel is a product of presence vectors, landmark weights fold into
one weight per bucket and language, and texts are scored by batched products of presence and weight matrices.

Training uses a bounded sample: ``per_language`` texts of each language, ``landmarks`` of them as landmarks.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing
was labelled; a null label is no label; an id that is null is never in the sample; repeated rows are scored each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.llm.features import LETTERS, ngrams, sample_per_class
from trajecta.llm.shared import crc_of_id, map_arrow, slices, texts, valid_text

SIZES = (2, 3, 4)
BITS = 16
PER_LANGUAGE = 400
LANDMARKS = 256
RIDGE = 1e-3
UNKNOWN = "und"


def presence(found: list[str], sizes: tuple[int, ...]) -> np.ndarray:
    """Rows of 0 and 1: which buckets a text has n-grams in."""
    out = np.zeros(len(found) << BITS, bool)
    bucket, text = ngrams(found, sizes, BITS, LETTERS)
    out[(text << BITS) | bucket] = True
    return out.reshape(len(found), 1 << BITS)


def train(bits: list[bytes], labels: list[str], landmarks: int, ridge: float) -> tuple[list[str], np.ndarray]:
    """(languages, weights): a column of weights by bucket for each language."""
    names = sorted(set(labels))
    rows = lambda some: np.stack([np.unpackbits(np.frombuffer(bits[i], np.uint8)) for i in some]).astype(np.float32)
    norm = lambda p: p / np.sqrt(np.maximum(p.sum(1, keepdims=True), 1))
    # landmarks are taken from the languages in turn
    turns: dict[str, int] = {}
    order = sorted(range(len(labels)), key=lambda i: (turns.setdefault(labels[i], 0), turns.update({labels[i]: turns[labels[i]] + 1}))[0])
    marks = norm(rows(order[:landmarks]))
    kernel = np.concatenate([norm(rows(range(i, min(i + 100, len(bits))))) @ marks.T for i in range(0, len(bits), 100)]).astype(np.float64)
    among = (marks @ marks.T).astype(np.float64)
    value, vector = np.linalg.eigh(among)
    solid = value > 1e-6 * value[-1]
    root = vector[:, solid] / np.sqrt(value[solid])
    features = kernel @ root
    target = np.array([[float(x == name) for name in names] for x in labels])
    weight = 1 / np.sqrt(np.array([labels.count(x) for x in labels], np.float64))[:, None]
    a, b = features * weight, target * weight
    solved = np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ b)
    return names, marks.T @ (root @ solved).astype(np.float32)


def fit(docs: DataFrame, id_col: str, text_col: str, label_col: str, learn: Column, sizes: tuple[int, ...], per_language: int, landmarks: int, ridge: float) -> tuple[list[str], np.ndarray]:
    """Learns from text and label of the rows that ``learn`` holds for."""
    usable = docs.where(learn & F.col(text_col).rlike(r"\p{L}"))
    chosen = sample_per_class(usable, label_col, per_language, id_col)
    found = texts(usable, id_col, text_col, label=F.col(label_col)).join(F.broadcast(chosen), ["doc_id", "label"]).select("doc_id", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 500_000):
                for i, text in enumerate(batch.column("text").to_pylist()):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(i, 1), batch.column("label").slice(i, 1), pa.array([np.packbits(presence([text], sizes)[0]).tobytes()])], names=["doc_id", "label", "bits"]
                    )

    rows = sorted(map_arrow(found, run, "doc_id long, label string, bits binary").collect(), key=lambda r: (r.doc_id, r.label, r.bits))
    return train([bytes(r.bits) for r in rows], [r.label for r in rows], landmarks, ridge) if rows else ([], np.zeros((1 << BITS, 0), np.float32))


def predict(docs: DataFrame, id_col: str, text_col: str, model: tuple[list[str], np.ndarray], sizes: tuple[int, ...] = SIZES, keep: tuple[str, ...] = (), id_name: str = "doc_id") -> DataFrame:
    """``doc_id`` (or ``id_name``), ``lang_pred, score`` of every row, with ``keep`` also those columns and ``known``. The score is the best
    regression output, cut to 0..1; it falls with a text's n-gram count. ``known`` is the share of a text's n-grams that a landmark has."""
    names, weights = model
    extra = [weights.any(1, keepdims=True).astype(np.float32)] if keep else []
    shared = docs.sparkSession.sparkContext.broadcast((names, np.concatenate([weights, *extra, np.ones((1 << BITS, 1), np.float32)], 1)))
    rows = docs.select(F.col(id_col).alias("doc_id"), valid_text(text_col).alias("text"), F.struct(*(F.col(c) for c in keep)).alias("rest") if keep else F.lit(0).alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter, (names, weights) = regex.compile(r"\p{L}").search, shared.value
        for whole in batches:
            for part in slices(whole, "text", 500_000):
                for start in range(0, part.num_rows, 128):
                    batch = part.slice(start, 128)
                    found = batch.column("text").to_pylist()
                    sums = presence(found, sizes).astype(np.float32) @ weights
                    output = sums[:, : len(names)] / np.sqrt(np.maximum(sums[:, -1:], 1))
                    known = np.array([bool(names) and letter(t) is not None for t in found], bool)
                    best = output.argmax(1) if names else np.zeros(len(found), np.int64)
                    score = np.clip(output.max(1), 0, 1).astype(np.float64) if names else np.zeros(len(found))
                    lang = pa.array([names[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], pa.string())
                    columns = {"doc_id": batch.column("doc_id"), "lang_pred": lang, "score": pa.array(np.where(known, score, 0.0))}
                    if keep:
                        columns |= {"rest": batch.column("rest"), "known": pa.array((sums[:, -2] / np.maximum(sums[:, -1], 1)).astype(np.float64))}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = rows.schema["doc_id"].dataType.simpleString()
    if not keep:
        return map_arrow(rows, run, f"doc_id {kind}, lang_pred string, score double").withColumnRenamed("doc_id", id_name)
    scored = map_arrow(rows, run, f"doc_id {kind}, lang_pred string, score double, rest {rows.schema['rest'].dataType.simpleString()}, known double")
    return scored.select(F.col("doc_id").alias(id_name), "lang_pred", "score", "known", *(F.col(f"rest.`{c}`").alias(c) for c in keep))


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    sizes: tuple[int, ...] = SIZES,
    per_language: int = PER_LANGUAGE,
    landmarks: int = LANDMARKS,
    ridge: float = RIDGE,
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``. Rows whose crc32(id) mod 4 is 2 are held out of training."""
    held_out = F.coalesce(crc_of_id(id_col) % 4 == 2, F.lit(False))
    model = fit(docs, id_col, text_col, label_col, ~held_out, sizes, per_language, landmarks, ridge)
    return predict(docs, id_col, text_col, model, sizes).select("doc_id", F.coalesce(crc_of_id() % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
