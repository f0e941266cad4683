"""Language identification: nearest of several centroids per language, by cosine of TF-IDF character n-grams.

The model is fitted on at most ``per_language`` texts of each language (the ones with the smallest hash of their id).
Document frequencies of the n-grams are counted over all training texts of that sample; the vectors of each language
are clustered by spherical k-means.  Every whole text is scored against all centroids.

Defined results: null text, or text without a letter, is ``und`` with score 0 and rejected.  A text whose best cosine
is under the rejection distance of that language is rejected but keeps its nearest language.  Ties go to the language
that sorts first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

UND = "und"


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # language of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # cosine under which a text is rejected, by language


def counts(texts: list[str], dims: int) -> np.ndarray:
    """Hashed counts of 1- to 3-grams of each lower-case text, words set off by one space."""
    out = np.zeros((len(texts), dims), np.float32)
    mask = np.uint32(dims - 1)
    for k, t in enumerate(texts):
        c = np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        c[(c < 65) | ((c > 90) & (c < 97)) | ((c > 122) & (c < 170))] = 32
        c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]
        a = c * np.uint32(0x9E3779B1)
        b = a[:-1] * np.uint32(0x85EBCA77) + c[1:]
        d = b[:-1] * np.uint32(0xC2B2AE3D) + c[2:]
        for g in (a, b, d):
            h = g * np.uint32(0x27D4EB2F)
            out[k] += np.bincount((h >> np.uint32(15)) & mask, minlength=dims)
    return out


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts(texts, len(idf))) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from seeds that lie farthest from those before them."""
    centres = [x.mean(0)]
    for _ in range(1, min(k, len(x))):
        centres.append(x[np.argmin(np.max(x @ np.array(centres).T, axis=1))])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = np.argmax(x @ c.T, axis=1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, clusters: int = 4, dims: int = 4096, max_languages: int = 400, chars: int = 20_000, slack: float = 0.35) -> Model:
    """``train``: labelled texts.  The sample is bounded: for each language ``per_language`` texts, of which a longer one gives
    its first ``chars`` characters.  More than ``max_languages`` languages are an error; none is left out."""
    rows = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col)).alias("h")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    share = rows.groupBy("lang").count().orderBy("lang").limit(max_languages + 1).collect()
    if len(share) > max_languages:
        raise ValueError(f"over {max_languages} languages")
    rows = rows.withColumn("text", F.substring("text", 1, chars))
    low, pick = -(1 << 63), F.lit(False)
    for r in share:
        part = min(1.0, 1.5 * per_language / max(1, r["count"]))
        pick = pick | ((F.col("lang") == r["lang"]) & (F.col("h") <= F.lit(min((1 << 63) - 1, int(low + part * ((1 << 64) - 1))))))
    sample = rows.filter(pick).orderBy("h").limit(2 * per_language * max(1, len(share))).collect()
    by: dict[str, list[str]] = {}
    for r in sample:
        if len(held := by.setdefault(r.lang, [])) < per_language:
            held.append(r.text)
    names = sorted(by)
    if not names:
        return Model([], np.zeros(0, np.int64), np.zeros((0, dims), np.float32), np.ones(dims, np.float32), np.zeros(0))
    df, n = np.zeros(dims), 0
    for name in names:
        df += (counts(by[name], dims) > 0).sum(0)
        n += len(by[name])
    idf = (np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)
    owner, cents, least = [], [], []
    for j, name in enumerate(names):
        x = vectors(by[name], idf)
        c = kmeans(x, clusters)
        near = [(x[h::2] @ kmeans(x[1 - h :: 2], clusters).T).max(1) for h in (0, 1)] if len(x) > 3 else [(x @ c.T).max(1)]
        least.append(float(slack * np.quantile(np.concatenate(near), 0.01)))  # texts against centroids of the other half
        owner += [j] * len(c)
        cents.append(c)
    return Model(names, np.array(owner), np.concatenate(cents).astype(np.float32), idf, np.array(least))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (best cosine, 0 to 1), rejected; one row per row of ``docs``."""
    found = identified(docs, model, text_col)
    return found.select(F.col(f"row.`{id_col}`").cast("long").alias(id_col), "found.lang_pred", "found.score", "found.rejected")


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row`` (a struct of all columns of ``docs``, so that no name can clash) and ``found`` (lang_pred, score, rejected)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def named(texts: pd.Series) -> pd.DataFrame:
        return label(texts.tolist(), held.value)

    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), named(F.col(text_col).cast("string")).alias("found"))


def label(texts: list[str | None], m: Model) -> pd.DataFrame:
    groups = [np.flatnonzero(m.owner == j) for j in range(len(m.languages))]
    names, scores, out = [UND] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    todo = [i for i, t in enumerate(texts) if t and (t.isalpha() or any(map(str.isalpha, t)))] if groups else []
    for a in range(0, len(todo), 256):
        part = todo[a : a + 256]
        sims = vectors([texts[i] for i in part], m.idf) @ m.centroids.T
        best = np.stack([sims[:, g].max(1) for g in groups], 1)
        for i, j, s in zip(part, best.argmax(1).tolist(), best.max(1).tolist(), strict=True):
            names[i], scores[i], out[i] = m.languages[j], min(1.0, max(0.0, s)), s < m.least[j]
    return pd.DataFrame({"lang_pred": names, "score": scores, "rejected": out})
