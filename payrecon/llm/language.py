"""Operator 7, language identification by string kernels."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shipped, bounded_batches, crc_of_id, hash_share, table, unused

#: The bounded sample that the model is fitted on, and how many of its texts are landmarks.
PER_LANGUAGE, LANDMARKS = 400, 160
ORDERS = (1, 2, 3)
SYMBOLS = 64
RIDGE = 1e-3
#: A text is held against so many landmarks to tell if its language is a known one; share of known texts less like them.
NEAREST, LOST = 8, 0.02
#: Of rare letters the numbers go by Unicode block; the rest of SYMBOLS is the sample's most frequent characters.
RARE = 8
UNKNOWN = "und"


def _codes(text: str, alphabet: dict[int, int]) -> np.ndarray:
    """The text's characters as numbers below SYMBOLS; rare letters share the last few, Latin ones one and others
    the rest by Unicode block, and other rare characters the very last."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds, back = np.unique(chars, return_inverse=True)
    rare = SYMBOLS - RARE
    other = lambda c: SYMBOLS - 1 if not chr(c).isalpha() else rare if c < 0x250 else rare + 1 + (c >> 7) % (RARE - 2)
    return np.array([alphabet[c] if c in alphabet else other(c) for c in kinds.tolist()], dtype=np.int64)[back]


def ngrams(codes: np.ndarray) -> np.ndarray:
    """Sorted numbers of the distinct n-grams of orders 1 to 3 of a whole text's _codes(), each order apart."""
    out, base = [], 0
    gram = np.zeros(len(codes), dtype=np.int64)
    for n in ORDERS:
        seen = np.zeros(SYMBOLS**n, dtype=bool)
        gram = codes if n == 1 else gram[:-1] * SYMBOLS + codes[n - 1 :]
        if len(gram):
            seen[gram] = True
        out.append(np.flatnonzero(seen) + base)
        base += SYMBOLS**n
    return np.concatenate(out)


@dataclass
class KernelModel:
    """Landmark incidence, the Nyström map with the ridge weights folded in, and the languages."""

    alphabet: dict[int, int]
    columns: np.ndarray  # n-gram number -> row of `presence`, -1 if no landmark has it
    presence: np.ndarray  # n-grams of landmarks x landmarks, 0/1
    sizes: np.ndarray  # distinct n-grams of each landmark
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray
    languages: list[str]
    least: float = 0.0  # the likeness to its nearest landmarks that all but LOST of the known texts have

    def shared(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many n-grams texts share with each landmark, as one product of matrices, how many they have, and the
        share of their characters that are no rare letters."""
        rows, own, plain = np.zeros((len(texts), len(self.presence)), dtype=np.float32), np.ones(len(texts)), np.ones(len(texts))
        for i, text in enumerate(texts):
            codes = _codes(text, self.alphabet)
            grams = ngrams(codes)
            own[i] = max(1, len(grams))
            plain[i] = 1 - ((codes >= SYMBOLS - RARE) & (codes < SYMBOLS - 1)).sum() / max(1, len(codes))
            at = self.columns[grams]
            rows[i, at[at >= 0]] = 1
        return rows @ self.presence, own, plain

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Normalised presence kernel of texts with the landmarks."""
        shared, own, _ = self.shared(texts)
        return shared / np.sqrt(own[:, None] * self.sizes[None, :])

    def scores(self, texts: list[str]) -> np.ndarray:
        """Soft-max of the one-versus-rest regressions, made less for texts that are like none of the landmarks: one
        that is half as like as `least` has half the score. Other scripts, which share next to nothing with any
        landmark, come out near 0, whatever language they are least unlike."""
        shared, own, plain = self.shared(texts)
        raw = 6.0 * (shared / np.sqrt(own[:, None] * self.sizes[None, :]) @ self.weights + self.bias)
        raw = np.exp(raw - raw.max(axis=1, keepdims=True))
        known = np.minimum(1.0, likeness(shared, own, plain) / max(self.least, 1e-9))
        return raw / raw.sum(axis=1, keepdims=True) * known[:, None]


def likeness(shared: np.ndarray, own: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """The share of a text's n-grams that a landmark has, as the mean of the NEAREST ones; less by its rare letters,
    of which the numbers tell little."""
    n = min(NEAREST, shared.shape[1])
    return np.partition(shared, shared.shape[1] - n, axis=1)[:, -n:].mean(axis=1) / own * plain


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel | None:
    """Kernel ridge regression, one language versus the rest, on the Nyström features of `landmarks` texts."""
    if not texts:
        return None
    counted = Counter(c for t in texts for c in t.lower())
    alphabet = {ord(c): i for i, (c, _) in enumerate(sorted(counted.items(), key=lambda x: (-x[1], x[0]))[: SYMBOLS - RARE])}
    names = sorted(set(languages))
    by = {name: [i for i, x in enumerate(languages) if x == name] for name in names}
    # Landmarks of a language are those of its texts with the smallest hashes, so that they are spread over it.
    spread = [(zlib.crc32(t.encode("utf-8", "surrogatepass")), t) for t in texts]
    picked = sorted(i for rows in by.values() for i in sorted(rows, key=spread.__getitem__)[: max(1, landmarks // len(names))])
    grams = [ngrams(_codes(texts[i], alphabet)) for i in picked]
    used = np.unique(np.concatenate(grams))
    columns = np.full(sum(SYMBOLS**n for n in ORDERS), -1, dtype=np.int32)
    columns[used] = np.arange(len(used))
    presence = np.zeros((len(used), len(picked)), dtype=np.float32)
    for j, g in enumerate(grams):
        presence[columns[g], j] = 1
    model = KernelModel(alphabet, columns, presence, np.array([max(1, len(g)) for g in grams], dtype=float), np.zeros(0), np.zeros(0), names)
    k = np.vstack([model.kernel(texts[at : at + 256]) for at in range(0, len(texts), 256)])
    values, vectors = np.linalg.eigh(model.kernel([texts[i] for i in picked]).astype(float))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    features = k @ root
    target = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    share = 1.0 / np.array([len(by[x]) for x in languages])  # every language weighs the same
    mean = (share[:, None] * features).sum(0) / share.sum()
    centre = (share[:, None] * target).sum(0) / share.sum()
    x, y = features - mean, target - centre
    w = np.linalg.solve((x * share[:, None]).T @ x + ridge * np.eye(x.shape[1]), (x * share[:, None]).T @ y)
    model.weights, model.bias = (root @ w).astype(np.float32), centre - mean @ w
    model.least = float(np.quantile(np.concatenate([likeness(*model.shared(texts[at : at + 256])) for at in range(0, len(texts), 256)]), LOST))
    return model


def learning_sample(docs: DataFrame, per_language: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Up to some `per_language` rows of each language, the same in every run: those of the smallest hashes.

    Only rows whose crc32(id as text) mod 3 is not 1 and that have text and language are there to learn from.
    Counts come from the columns of ids and languages alone; texts of the sample are all that is gathered.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.coalesce(crc_of_id(id_col) % 3 != 1, F.lit(False)))
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}  # one row a language
    if not counts:
        return known.select(text_col, lang_col).limit(0)
    share = F.lit(0.0)
    for name, n in sorted(counts.items()):
        share = F.when(F.col(lang_col) == name, F.lit(min(1.0, per_language / n))).otherwise(share)
    few = known.filter(hash_share(id_col, 7, text_col) < share)
    return few.select(F.col(text_col), F.col(lang_col)).distinct()  # a row that is repeated counts once


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> KernelModel | None:
    rows = sorted((r[1], r[0]) for r in learning_sample(docs, per_language, id_col, text_col, lang_col).collect())
    return fit([t for _, t in rows], [x for x, _ in rows], landmarks)


def with_language(docs: DataFrame, model: KernelModel | None, text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score (0 to 1); the text alone is looked at, and all of it.

    Defined cases: null texts and texts without a letter are `und` with score 0, and so is every text where
    there was nothing to learn from; repeated rows get the same prediction; ties go to the language that is
    first by name; an empty table gives an empty table; input columns named as the outputs are replaced.

    At scale: one narrow pass; the model is a bounded number of landmarks, whatever the size of the table.
    """
    bounded_batches(docs.sparkSession)
    shared = Shipped(docs.sparkSession, model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted = shared.get()
        for batch in batches:
            names, scores = [UNKNOWN] * len(batch), [0.0] * len(batch)
            for at in range(0, len(batch), 128):
                texts = batch.slice(at, 128).to_pylist()
                good = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))]
                if not good or fitted is None:
                    continue
                probs = fitted.scores([texts[i] for i in good])
                for i, p in zip(good, probs, strict=True):
                    best = int(np.argmax(p))
                    names[at + i], scores[at + i] = fitted.languages[best], float(p[best])
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    kept, said = [c for c in docs.columns if c not in out], unused("_said", docs)
    told = docs.withColumn(said, of(F.col(text_col)))
    return told.select(*kept, F.col(f"{said}.lang").alias(out[0]), F.col(f"{said}.score").alias(out[1]))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    said = with_language(docs.select("doc_id", "text"), train(docs))
    return said.select("doc_id", F.coalesce(crc_of_id("doc_id") % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
