"""Language identification in two steps: the family first, then one-versus-one linear SVMs.

Features are shares of hashed letter sequences (1 to 3 bytes of the lower-cased text, everything
but letters turned into blanks). Family models are one-versus-rest linear SVMs; within a family a
linear SVM for every pair of its languages votes, and sums of margins settle equal votes.

Models are fitted on a bounded sample (SAMPLE rows of each language, see hashing.sample) of rows
with a language and text that are not held out; only text and lang are used. Prediction takes
whole texts. A text that is NULL or has no letter is `und` with score 0, and so is every text when
nothing could be learned. NULL doc_ids are not held out and not learned from; repeated rows are
predicted alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bloomgrid.llm import hashing
from bloomgrid.llm.batches import map_texts

SAMPLE = 300
SLOTS = 4096
UNKNOWN = "und"
#: Families by ISO 639-1 code; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz".split(),
    "sinitic": "zh yue".split(),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().split("-")[0], lang)


def codes(raw: np.ndarray) -> np.ndarray:
    """Slots of the sequences of one, two and three bytes that end at each byte."""
    wide = raw.astype(np.uint32)
    two = wide.copy()
    two[1:] |= wide[:-1] << np.uint32(8)
    three = two.copy()
    three[2:] |= wide[:-2] << np.uint32(16)
    spread = np.uint32(0x9E3779B1)
    shift = np.uint32(20)
    return np.stack([
        ((wide + np.uint32(7 << 24)) * spread) >> shift,
        ((two + np.uint32(11 << 24)) * spread) >> shift,
        ((three + np.uint32(13 << 24)) * spread) >> shift,
    ])


def prepared(text: str | None) -> bytes:
    """The lower-cased text in UTF-8, ASCII that is no letter as single blanks.

    Empty for a text without letters.
    """
    if not text:
        return b""
    raw = text.lower().encode("utf-8", "replace").translate(BLANKED)
    if text.isascii() or raw.translate(None, NOT_ASCII_LETTERS):
        parts = raw.split()
    else:
        parts = raw.split() if any(map(str.isalpha, text)) else []
    return b" " + b" ".join(parts) + b" " if parts else b""


BLANKED = bytes(i if i > 127 or chr(i).isalpha() else 32 for i in range(256))
NOT_ASCII_LETTERS = bytes(i for i in range(256) if not (i < 128 and chr(i).isalpha()))


def shares(texts: list[str | None]) -> np.ndarray:
    """Feature rows: square roots of slot shares (rows without letters are zero)."""
    found = np.zeros((len(texts), SLOTS), np.float32)
    for row, text in enumerate(texts):
        raw = np.frombuffer(prepared(text), np.uint8)
        if len(raw):
            counts = np.bincount(codes(raw).ravel(), minlength=SLOTS)
            found[row] = np.sqrt(counts / counts.sum())
    return found


def fit_svm(rows: np.ndarray, signs: np.ndarray, steps: int = 150) -> np.ndarray:
    """A linear SVM (squared hinge, L2) by accelerated gradient steps; the last weight is the bias."""
    x = np.concatenate((rows, np.ones((len(rows), 1), rows.dtype)), axis=1)
    each = np.where(signs > 0, 0.5 / max((signs > 0).sum(), 1), 0.5 / max((signs < 0).sum(), 1))
    penalty, rate = np.float32(1e-4), np.float32(0.2)
    x, signs, each = (v.astype(np.float32) for v in (x, signs, each))
    weights = momentum = np.zeros(x.shape[1], np.float32)
    for step in range(steps):
        ahead = weights + np.float32(step / (step + 3)) * momentum
        slack = np.maximum(1 - signs * (x @ ahead), 0)
        gradient = penalty * ahead - 2 * x.T @ (each * slack * signs)
        new = ahead - rate * gradient
        momentum, weights = new - weights, new
    return weights


@dataclass
class Model:
    families: list[str]
    family_weights: np.ndarray
    languages: dict[str, list[str]]
    pairs: dict[tuple[str, str], np.ndarray]

    def predict(self, rows: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each feature row."""
        x = np.concatenate((rows, np.ones((len(rows), 1), rows.dtype)), axis=1)
        margins = x @ self.family_weights.T
        best = margins.argmax(axis=1)
        ordered = np.sort(margins, axis=1)
        apart = ordered[:, -1] - ordered[:, -2] if len(self.families) > 1 else np.full(len(x), 4.0)
        score = 1 / (1 + np.exp(-2 * apart))
        found = [""] * len(x)
        for number, name in enumerate(self.families):
            at = np.flatnonzero(best == number)
            langs = self.languages[name]
            votes = np.zeros((len(at), len(langs)))
            for (a, b), weights in self.pairs.items():
                if a in langs and b in langs:
                    margin = np.tanh(x[at] @ weights) * 0.49  # a vote, and margins for ties
                    votes[:, langs.index(a)] += (margin > 0) + margin
                    votes[:, langs.index(b)] += (margin <= 0) - margin
            for row, own in zip(at, votes, strict=True):
                found[row] = langs[int(own.argmax())]
                if len(langs) > 1:
                    two = np.sort(own)[-2:]
                    score[row] *= 1 / (1 + np.exp(-3 * (two[1] - two[0])))
        return found, score


def fit(langs: list[str], rows: np.ndarray) -> Model | None:
    names = sorted(set(langs))
    if not names:
        return None
    labels = np.array(langs)
    kin = np.array([family(x) for x in langs])
    families = sorted(set(kin))
    family_weights = np.stack([
        fit_svm(rows, np.where(kin == name, 1.0, -1.0)) for name in families
    ])
    languages = {name: sorted(set(labels[kin == name])) for name in families}
    pairs = {}
    for own in languages.values():
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                chosen = (labels == a) | (labels == b)
                pairs[a, b] = fit_svm(rows[chosen], np.where(labels[chosen] == a, 1.0, -1.0))
    return Model(families, family_weights, languages, pairs)


def train(documents: DataFrame, size: int = SAMPLE) -> Model | None:
    """Fit on the given rows (lang, text); features of the bounded sample reach the driver."""
    usable = documents.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = shares(batch.column("text").to_pylist()).astype(np.float16)
        packed = [row.tobytes() if row.any() else None for row in rows]
        return pa.record_batch(
            [batch.column("lang"), pa.array(packed, pa.binary())], names=["lang", "packed"]
        )

    chosen = hashing.sample(usable, "lang", size)
    rows = map_texts(chosen, "lang string, packed binary", run).where("packed IS NOT NULL").collect()
    rows.sort(key=lambda x: (x.lang, x.packed))
    if not rows:
        return None
    found = np.stack([np.frombuffer(x.packed, np.float16) for x in rows]).astype(np.float32)
    return fit([x.lang for x in rows], found)


def identified(documents: DataFrame, model: Model | None) -> DataFrame:
    """Per row: doc_id, held_out (as given), lang_pred, score."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = shares(batch.column("text").to_pylist())
        known = rows.any(axis=1) if model else np.zeros(len(rows), bool)
        langs, scores = [UNKNOWN] * len(rows), np.zeros(len(rows))
        if known.any():
            found, sure = model.predict(rows[known])
            for at, lang in zip(np.flatnonzero(known), found, strict=True):
                langs[at] = lang
            scores[known] = sure
        return pa.record_batch(
            [batch.column("doc_id"), batch.column("held_out"), pa.array(langs), pa.array(scores)],
            names=["doc_id", "held_out", "lang_pred", "score"],
        )

    return map_texts(
        documents.select("doc_id", "held_out", "text"),
        "doc_id long, held_out boolean, lang_pred string, score double", run,
    )


def identify(documents: DataFrame, modulus: int = 4, held: int = 2, size: int = SAMPLE) -> DataFrame:
    """Train on rows whose crc32(doc_id) mod `modulus` is not `held`, predict every row."""
    part = hashing.remainder("doc_id", modulus)
    model = train(documents.where(part != held), size)
    return identified(
        documents.select("doc_id", "text", F.coalesce(part == held, F.lit(False)).alias("held_out")),
        model,
    )
