"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, and every run of characters other than letters becomes one
space.  N-grams of 1 to 3 characters are hashed into ``2 ** bits`` buckets.  Counts per
language are summed by Spark; the matrix of log-probabilities (languages x buckets) is
broadcast, and numpy adds the rows of a batch.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Prediction for a text without letters.
UNKNOWN = "und"
#: Odd multipliers of the n-gram hash, by place (fixed so that a stored model stays valid).
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)

#: Characters of a batch.
PART = 1 << 18


@functools.lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, one space for each run of other characters, and
    a space at either end; empty if it has no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = _is_letter()[c]
    if not ok.any():
        return c[:0]
    keep = ok.copy()
    keep[1:] |= ok[:-1]  # the first of a run
    c = np.where(ok, c, 32)[keep]
    return np.concatenate(([32] if c[0] != 32 else [], c, [32] if c[-1] != 32 else [])).astype(np.uint32)


def ngrams(c: np.ndarray, bits: int, starts: int | None = None) -> np.ndarray:
    """Buckets of the n-grams of 1 to 3 characters (that start at the first ``starts`` places)."""
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(1, 4):
        if len(c) < n:
            break
        h = (h[:len(c) - n + 1] + c[n - 1:] * MULTIPLIERS[n - 1]).astype(np.uint32)
        mixed = h ^ (h >> np.uint32(15))
        out.append((mixed[:starts] * np.uint32(0x2C1B3C6D + 2 * n)) >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _parts(texts: list[str | None], most: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows and characters in batches of about ``most`` characters; a longer text comes in
    parts that overlap by two characters, each with the n-grams that start in it."""
    rows, parts, held = [], [], 0
    for i, text in enumerate(texts):
        c = letters(text) if text else np.zeros(0, np.uint32)
        for at in range(0, len(c), most):
            rows.append(i)
            parts.append(c[at:at + most + 2])
            held += len(parts[-1])
            if held >= most:
                yield rows, parts
                rows, parts, held = [], [], 0
    if rows:
        yield rows, parts


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray  # by language
    log_prob: np.ndarray  # languages x buckets
    bits: int

    def scores(self, texts: list[str | None], most: int = PART) -> tuple[np.ndarray, np.ndarray]:
        """(joint log-probability by text and language, whether the text has a letter)."""
        out = np.tile(self.log_prior, (len(texts), 1))
        seen = np.zeros(len(texts), bool)
        for rows, parts in _parts(texts, most):
            grams = [ngrams(p, self.bits, most) for p in parts]
            starts = np.cumsum([0, *map(len, grams[:-1])])
            g = np.concatenate(grams)
            seen[rows] = True
            for k, line in enumerate(self.log_prob):
                np.add.at(out[:, k], rows, np.add.reduceat(line[g], starts, dtype=np.float64))
        return out, seen


def train(docs: DataFrame, where: Column | None = None, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          rows_per_language: int = 20_000, bits: int = 16, smoothing: float = 0.5, max_buckets: int = 1 << 26) -> Model:
    """Fit the model on rows with a text and a language.

    At most about ``rows_per_language`` rows of a language are used: where it has more,
    each is taken with the same chance, by a hash of its id and text, and whole texts are read.
    ``where`` limits the rows further.  The matrix has languages x 2 ** bits entries;
    with more than ``max_buckets`` it is refused.  Without any such row the model knows no language,
    and every prediction is ``und``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.col(lang_col).cast("string").alias("lang"), (F.lit(True) if where is None else where).alias("use"))
    rows = rows.where("use and lang is not null and text is not null").select("id", "text", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if len(languages) << bits > max_buckets:
        raise ValueError(f"{len(languages)} languages x 2^{bits} buckets exceed max_buckets")
    if not languages:
        return Model([], np.zeros(0), np.zeros((0, 1 << bits), np.float32), bits)
    total = sum(sizes.values())
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, rows_per_language / sizes[x]))) for x in languages])
    taken = rows.where(F.pmod(F.xxhash64(F.lit("fit"), "id", "text"), F.lit(1 << 30)) < share * (1 << 30)).select("text", "lang")
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            names = b.column(1).to_pylist()
            for at, parts in _parts(b.column(0).to_pylist(), PART):
                for i, p in zip(at, parts):
                    own = sums.setdefault(names[i], np.zeros(1 << bits, np.int64))
                    own += np.bincount(ngrams(p, bits, PART), minlength=1 << bits)
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])],
                                             names=schema.names)

    counts = np.zeros((len(languages), 1 << bits))
    table = taken.mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    place = {x: i for i, x in enumerate(languages)}
    counts[[place[x] for x in table["lang"].to_pylist()], table["bucket"].to_numpy()] = table["n"].to_numpy()
    counts += smoothing
    log_prob = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)
    prior = np.log(np.array([sizes[x] / total for x in languages]))
    return Model(languages, prior, log_prob, bits)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None,
            lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """The columns ``keep`` (default: all) with the predicted language and its probability.

    A null text or one without a letter gets ``und`` and score 0.  Equal probabilities
    go to the language that sorts first.  One row per input row; ``keep`` must not hold
    the two new names.  Texts are scored whole; long ones in parts whose sums add up."""
    keep = docs.columns if keep is None else keep
    if {lang_name, score_name} & set(keep):
        raise ValueError("the names of the new columns are taken")
    last = "text_to_score" + "_" * sum(map(len, keep))  # no other name is as long
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias(last))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for b in batches:
            joint, seen = m.scores(b.column(b.num_columns - 1).to_pylist())
            best, prob = np.full(b.num_rows, len(m.languages)), np.zeros(b.num_rows)
            if m.languages:
                joint -= joint.max(1, keepdims=True)
                prob = np.where(seen, 1 / np.exp(joint).sum(1), 0.0)
                best = np.where(seen, joint.argmax(1), len(m.languages))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names[best], pa.string()), pa.array(prob)], names=schema.names)

    return rows.mapInArrow(score, schema)


def known_language(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``predict`` gives a learned language; those that it calls ``und`` go: texts
    that are null or have no letter, and all if the model knows no language."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    told = predict(rows, model, "text", keep=["row"])
    return told.where(F.col("lang_pred") != UNKNOWN).select("row.*")
