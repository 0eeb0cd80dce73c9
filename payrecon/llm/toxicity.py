"""Operator 8, toxicity by a counterfactually regularised classifier."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shipped, bounded_batches, crc_of_id, hash_share, table

#: The bounded sample of labelled rows: so many of each label, about.
PER_LABEL = 2500
#: One occurrence in a short text counts for the whole.
DENSE = 1
BUCKETS = 1 << 20
GRAM = 5
FEATURES = 1500
SWAPS = 600
PENALTY = 20.0
RIDGE = 2e-3
ROUNDS = 40
#: Terms for groups of people by language and kind; a term is swapped for another of its own list.
IDENTITY = {
    "en gender": ("women", "men", "girls", "boys"), "en faith": ("muslims", "christians", "jews", "hindus", "atheists", "buddhists"),
    "en origin": ("immigrants", "refugees", "foreigners", "natives"), "en descent": ("black", "white", "asian", "african", "european", "arab"),
    "en orientation": ("gay", "lesbian", "straight", "bisexual", "transgender"), "en body": ("disabled", "deaf", "blind", "healthy"), "en age": ("old", "young", "elderly"),
    "de gender": ("frauen", "männer", "mädchen", "jungen"), "de faith": ("muslime", "christen", "juden", "atheisten"), "de origin": ("ausländer", "flüchtlinge", "einwanderer", "inländer"),
    "fr gender": ("femmes", "hommes", "filles", "garçons"), "fr faith": ("musulmans", "chrétiens", "juifs", "athées"), "fr origin": ("étrangers", "réfugiés", "immigrés"),
    "es gender": ("mujeres", "hombres", "niñas", "niños"), "es faith": ("musulmanes", "cristianos", "judíos", "ateos"), "es origin": ("extranjeros", "refugiados", "inmigrantes"),
}
#: Words that name no group, by language: half of the swaps end there, which ties a term's weight to none at all.
NEUTRAL = {"en": "people", "de": "menschen", "fr": "gens", "es": "gente"}
_SENTENCE, _WORD = re.compile(r"[^.!?\n]*[^.!?\n\s][^.!?\n]*[.!?]*"), re.compile(r"[^\W\d_]+")
_SPACE = np.array([32 if c < 48 or 58 <= c < 97 or 123 <= c < 128 else c for c in range(256)], dtype=np.uint8)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str | None) -> np.ndarray:
    """Bucket of each run of GRAM bytes of the whole text, lower-cased, with anything but letters and digits as a blank."""
    raw = _SPACE[np.frombuffer(b" " + (text or "").lower().encode("utf-8", "replace") + b" ", dtype=np.uint8)]
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    raw = raw[keep].astype(np.uint64)
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    code = np.zeros(n, dtype=np.uint64)
    for j in range(GRAM):
        code = (code << np.uint64(8)) | raw[j : j + n]
    return ((code * _FACTOR) >> np.uint64(44)).astype(np.int64)


def shares(found: np.ndarray, n: int) -> np.ndarray:
    """How dense each of n features is among the grams of a text: its count over DENSE and one more for each 600 grams
    (some 100 words), 1 at most. The same count says less in a longer text, in which chance alone brings some."""
    return np.minimum(1.0, np.bincount(found[found >= 0], minlength=n) / (DENSE + len(found) / 600))


@dataclass
class ToxicModel:
    slot: np.ndarray  # bucket -> feature, -1 if none
    weights: np.ndarray
    bias: float

    def raw(self, text: str | None) -> float:
        return float(shares(self.slot[grams(text)], len(self.weights)) @ self.weights + self.bias)

    def score(self, text: str | None) -> float:
        """Probability of the label from how dense the features are in the text."""
        return float(1 / (1 + np.exp(-np.clip(self.raw(text), -30, 30))))


def swapped(sentence: str, rng: np.random.Generator, terms: dict[str, tuple[str, ...]]) -> str | None:
    """The sentence with every identity term replaced by another of its language and kind, or by the language's
    neutral word; None if it has none."""
    kind = {t: k for k, words in terms.items() for t in words}
    found = [m for m in _WORD.finditer(sentence) if m[0].lower() in kind]
    out, end = [], 0
    for m in found:
        others = [t for t in terms[kind[m[0].lower()]] if t != m[0].lower()]
        new = NEUTRAL.get(kind[m[0].lower()][:2]) if rng.random() < 0.5 else None
        new = new or others[int(rng.integers(len(others)))]
        out += [sentence[end : m.start()], new.upper() if m[0].isupper() else new.capitalize() if m[0][0].isupper() else new]
        end = m.end()
    return "".join([*out, sentence[end:]]) if found else None


def made_pair(sentence: str, rng: np.random.Generator, terms: dict[str, tuple[str, ...]]) -> tuple[str, str]:
    """The sentence with a term, and with another of its list or the neutral word, in the place of one of its words."""
    words, name = sentence.split() or [""], sorted(terms)[int(rng.integers(len(terms)))]
    i, (a, b) = int(rng.integers(len(words))), rng.choice(len(terms[name]), 2, replace=False)
    other = NEUTRAL.get(name[:2], terms[name][b]) if rng.random() < 0.5 else terms[name][b]
    return tuple(" ".join([*words[:i], x, *words[i + 1 :]]) for x in (terms[name][a], other))


def pairs_of(texts: list[str], rng: np.random.Generator, terms: dict[str, tuple[str, ...]], most: int = SWAPS) -> list[tuple[str, str]]:
    """Labelled sentences that hold identity terms beside their counterfactuals, in random order, `most` at most.

    Where there are fewer than `most`, sentences without a term get one of a list and another of it in the place of
    a word, so that terms that the sample does not hold are held to the same scores too.
    """
    pairs, plain = [], []
    for i in rng.permutation(len(texts)):
        sentences = _SENTENCE.findall(texts[i])
        for sentence in sentences:
            other = swapped(sentence, rng, terms)
            if other is not None and len(pairs) < most:
                pairs.append((sentence, other))
        if sentences:
            plain.append(sentences[int(rng.integers(len(sentences)))])
    while plain and len(pairs) < min(most, 4 * len(texts)):
        pairs.append(made_pair(plain[int(rng.integers(len(plain)))], rng, terms))
    return pairs


def _dense(texts: list[str], slot: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(texts), n), dtype=np.float32)
    for i, text in enumerate(texts):
        out[i] = shares(slot[grams(text)], n)
    return out


def descend(x: np.ndarray, y: np.ndarray, weigh: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, bias) at the minimum of the weighted logistic loss plus w' flat w / 2, by Newton steps that are halved
    while they do not help."""
    x1 = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    rest = np.zeros((x1.shape[1], x1.shape[1]))
    rest[:-1, :-1] = flat

    def loss(w: np.ndarray) -> float:
        z = x1 @ w
        return float((weigh * (np.logaddexp(0, z) - y * z)).sum() + w @ rest @ w / 2)

    w = np.zeros(x1.shape[1])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        slope = x1.T @ (weigh * (p - y)) + rest @ w
        bent = (x1 * (weigh * p * (1 - p))[:, None].astype(x1.dtype)).T @ x1 + rest + 1e-9 * np.eye(len(w))
        step, now = np.linalg.solve(bent, slope), loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-6:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1].astype(np.float32), float(w[-1])


def fit(texts: list[str], labels: list[int], penalty: float = PENALTY, features: int = FEATURES, terms: dict[str, tuple[str, ...]] = IDENTITY) -> ToxicModel | None:
    """The model of fit_once() on all texts, its scores calibrated on texts that models of one half each have not seen:
    the ridge alone leaves them too near to the middle, and that middle off its place."""
    model = fit_once(texts, labels, penalty, features, terms)
    half = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % 2 for t in texts], dtype=int)
    z, y = [], []
    for k in (0, 1):
        other = fit_once([t for t, h in zip(texts, half, strict=True) if h != k], [v for v, h in zip(labels, half, strict=True) if h != k], penalty, features, terms)
        if other is None:
            return model
        seen = [(other.raw(t), v) for t, v, h in zip(texts, labels, half, strict=True) if h == k]
        z, y = z + [a for a, _ in seen], y + [b for _, b in seen]
    y = np.array(y, dtype=np.float64)
    a, b = descend(np.array(z)[:, None], y, np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())), np.array([[1e-4]]))
    if a[0] <= 0:
        return model
    return ToxicModel(model.slot, model.weights * a[0], float(model.bias * a[0] + b))


def fit_once(texts: list[str], labels: list[int], penalty: float = PENALTY, features: int = FEATURES, terms: dict[str, tuple[str, ...]] = IDENTITY) -> ToxicModel | None:
    """Logistic regression on the grams that tell the labels apart, plus `penalty` times the mean squared change
    of the score between a labelled sentence and its counterfactual, in which identity terms are swapped."""
    y = np.array(labels, dtype=np.float32)
    if len(y) == 0 or y.min() == y.max():
        return None
    counts = np.zeros((2, BUCKETS), dtype=np.float32)
    for text, label in zip(texts, labels, strict=True):
        kinds, back = np.unique(grams(text), return_inverse=True)
        counts[label, kinds] += shares(back, len(kinds))
    n1, n0 = y.sum(), len(y) - y.sum()
    both = counts.sum(0)
    share = both / len(y)
    gap = np.abs(counts[1] / n1 - counts[0] / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
    gap[both < 2] = 0
    best = np.argsort(-gap, kind="stable")[:features]
    best = best[gap[best] > 3.0]
    named = np.unique(np.concatenate([grams(t) for words in terms.values() for t in words]))
    chosen = np.union1d(best, named)
    slot = np.full(BUCKETS, -1, dtype=np.int32)
    slot[chosen] = np.arange(len(chosen))
    x = _dense(texts, slot, len(chosen))
    rng = np.random.default_rng(8)
    pairs = pairs_of(texts, rng, terms) or [("", "")]
    change = _dense([a for a, _ in pairs], slot, len(chosen)) - _dense([b for _, b in pairs], slot, len(chosen))
    weigh = np.where(y == 1, 0.5 / n1, 0.5 / n0).astype(np.float32)
    flat = (2 * penalty / len(pairs) * (change.T @ change) + RIDGE * np.eye(len(chosen), dtype=np.float32)).astype(np.float64)
    return ToxicModel(slot, *descend(x, y, weigh, flat))


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicModel | None:
    """Fit on up to some `per_label` rows of each label, those of the smallest hashes of the id.

    Only rows whose crc32(id as text) mod 5 is not 0 are looked at. The sample of ids and labels is bounded by
    the parameter, so it is broadcast to find its texts; these are what the driver gathers, each text once.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    known = known.filter(F.coalesce((crc_of_id("_id") % 5 != 0) & F.col("_y").isin(0, 1), F.lit(False)))
    n = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    share = F.when(F.col("_y") == 1, F.lit(min(1.0, per_label / n.get(1, 1)))).otherwise(F.lit(min(1.0, per_label / n.get(0, 1))))
    few = known.filter(hash_share("_id", 8) < share).distinct()
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).filter("_text IS NOT NULL")
    rows = texts.join(F.broadcast(few), F.col("_doc") == F.col("_id")).select("_text", "_y").distinct().collect()  # copies count once
    rows = sorted(tuple(r) for r in rows)
    return fit([r[0] for r in rows], [r[1] for r in rows], penalty)


def with_toxicity(docs: DataFrame, model: ToxicModel | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the toxicity score of every whole text, 0 to 1.

    Defined cases: null texts are scored like empty ones; without anything to learn from all scores are 0;
    repeated rows get the same score; an empty table gives an empty table; an input column named as the output
    is replaced. At scale: one narrow pass with a model of fixed size.
    """
    bounded_batches(docs.sparkSession)
    shared = Shipped(docs.sparkSession, model)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        fitted = shared.get()
        return pa.array([0.0 if fitted is None else fitted.score(t.as_py()) for t in texts], pa.float64())

    kept = [c for c in docs.columns if c != out]
    return docs.select(*kept).withColumn(out, of(F.col(text_col)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", F.coalesce(crc_of_id("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
