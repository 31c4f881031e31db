"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. For each of its columns a binary classifier over hashed byte trigrams
predicts the bit: its weights are the log ratio of a trigram's frequency in the languages with +1 to that in those with
-1. A text's languages are ranked by the logistic loss of its predicted bits against each codeword, each bit weighted
by how often its classifier was right on that language in training; a small lead over the second is flagged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.llm._util import annotate

BUCKETS = 1 << 16
UNDETERMINED = "und"
#: Distinct texts of each language that training reads, about; chosen by a hash of the text.
ROWS_PER_LANGUAGE = 2000
#: Texts of each language at least that rows_per_language is taken for.
LEAST_TEXTS = 20
#: A lead in loss, in nats, under which the nearest codeword is ambiguous.
MARGIN = 1.0
#: A mean weight of 1/SCALE is a log odds of 1, in texts of FULL trigrams or more.
SCALE, FULL = 3.0, 60
#: Languages whose sums a worker holds at a time.
OPEN = 64
_LETTER = r"\p{L}"


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1. Up to 7 languages every split of them into two sides is a column; beyond, random columns, the best spread of 64 draws."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.float32)
    if n <= 7:
        splits = np.arange(1, 1 << (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, -1, 1).astype(np.float32)
    width, rng, best = int(np.ceil(10 * np.log2(n))), np.random.default_rng(7), None
    for _ in range(64):
        m = rng.choice([-1.0, 1.0], size=(n, width)).astype(np.float32)
        m[:, np.abs(m.sum(0)) == n] = np.where(np.arange(n)[:, None] % 2, 1, -1)
        near = (width - (m @ m.T)) / 2 + np.eye(n) * width
        if best is None or near.min() > best[0]:
            best = (near.min(), m)
    return best[1]


def trigrams(text: str) -> np.ndarray:
    """The bucket of each run of three bytes of the small-lettered text, with a space at either end."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8).astype(np.uint32)
    h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
    return (h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # language x bit
    weights: np.ndarray  # bucket x bit
    trust: np.ndarray  # language x bit, rows sum to 1

    def margins(self, text: str) -> np.ndarray:
        """Each bit's score: its classifier's mean weight over the text's trigrams, SCALE-fold, less for fewer than FULL trigrams."""
        at = trigrams(text)
        mean = self.weights[at].mean(0, dtype=np.float64) if len(at) else np.zeros(self.weights.shape[1])
        return mean * SCALE * min(1.0, np.sqrt(len(at) / FULL))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True
        m = self.margins(text)
        loss = (self.trust * np.logaddexp(0.0, -self.codes * m)).sum(1) * self.codes.shape[1]
        order = np.argsort(loss, kind="stable")
        p = np.exp(loss[order[0]] - loss)
        lead = loss[order[1]] - loss[order[0]] if len(order) > 1 else np.inf
        return self.languages[order[0]], float(1 / p.sum()), bool(lead < MARGIN)


def _counts(sample: DataFrame) -> DataFrame:
    """lang, bucket, n over a sample's texts; sums within a partition leave it, never texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in sums:
                    if len(sums) >= OPEN:
                        yield from map(out, sums.items())
                        sums.clear()
                    sums[lang] = np.zeros(BUCKETS, dtype=np.int64)
                sums[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        yield from map(out, sums.items())

    def out(found: tuple[str, np.ndarray]) -> pa.RecordBatch:
        at = np.flatnonzero(found[1])
        return pa.RecordBatch.from_arrays([pa.array([found[0]] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(found[1][at])], names=["lang", "bucket", "n"])

    return sample.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, lang: str = "lang", text: str = "text", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """A model of the languages in docs' labelled rows with a letter, from about rows_per_language distinct texts of each.

    Only rows with a letter count for it, copies count once; of every language with such a row some text is read.
    What comes to the driver is at most languages x 65536 sums, and of a language no more than its sample's trigrams.
    Languages of equal loss rank by name.
    """
    seen = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(_LETTER)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    seen = seen.withColumn("h", F.xxhash64(F.lit("sample"), "text"))
    sizes = seen.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("always")).collect()
    if not sizes:
        return Model([], codewords(0), np.zeros((BUCKETS, 1), np.float32), codewords(0))
    by_language = F.broadcast(docs.sparkSession.createDataFrame(sizes, "lang string, n long, always long"))  # the model that every worker gets is larger
    # a language is rarer than the cut or is thinned to it
    share: Column = F.least(F.lit(1.0), F.lit(float(max(rows_per_language, LEAST_TEXTS))) / F.col("n"))
    chosen = seen.join(by_language, "lang").where((F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)) | (F.col("h") == F.col("always")))
    sample = chosen.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")
    rows = _counts(sample).toPandas()
    languages = sorted(rows["lang"].unique())
    place = {x: i for i, x in enumerate(languages)}
    at, bucket, n = rows["lang"].map(place).to_numpy(dtype=np.int64), rows["bucket"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.float64)
    # a trigram's share of its language, half a count more for each; the mean of these on either side of each bit
    total = np.bincount(at, weights=n, minlength=len(languages)) + 0.5 * BUCKETS
    codes = codewords(len(languages))
    bits = codes.shape[1]
    weights = np.zeros((BUCKETS, bits), dtype=np.float32)
    for b in range(bits if len(languages) > 1 else 0):
        mean = []
        for side in (1, -1):
            mine = codes[:, b] == side
            found = mine[at]
            mean.append((np.bincount(bucket[found], weights=n[found] / total[at[found]], minlength=BUCKETS) + (0.5 / total[mine]).sum()) / mine.sum())
        weights[:, b] = np.clip(np.log(mean[0]) - np.log(mean[1]), -8, 8)
    model = Model(languages, codes, weights, np.full(codes.shape, 1 / bits, dtype=np.float32))
    model.trust = _trust(sample, model, place)
    return model


def _trust(sample: DataFrame, model: Model, place: dict[str, int]) -> np.ndarray:
    """How often each bit's classifier is right on each language's sampled rows, each language's shares summing to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = np.zeros(model.codes.shape)
        rows = np.zeros(len(place), dtype=np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (i := place.get(lang)) is not None:
                    right[i] += model.margins(text) * model.codes[i] > 0
                    rows[i] += 1
        for i in np.flatnonzero(rows):
            yield pa.RecordBatch.from_arrays([pa.array([int(i)], pa.int32()), pa.array([right[i].tolist()], pa.list_(pa.float64())), pa.array([int(rows[i])])], names=["i", "hit", "n"])

    sums = sample.mapInArrow(run, "i int, hit array<double>, n long").groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(F.col("hit")[b]).alias(f"h{b}") for b in range(model.codes.shape[1])]).collect()
    trust = np.full(model.codes.shape, 0.5)
    for r in sums:
        trust[r["i"]] = [(r[f"h{b}"] + 1) / (r["n"] + 2) for b in range(model.codes.shape[1])]
    return (trust / trust.sum(1, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous, from the whole of each text.

    A null text or one without a letter is ``und`` at score 0, and so is any text if the model has no language; a
    column of docs named like one of the three gives way. Equal texts get equal results; no rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most languages-by-bits and 65536-by-bits numbers

    def rows(texts: list) -> Iterator[tuple]:
        return map(sent.value.predict, texts)

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    return annotate(docs, fields, rows, text)
