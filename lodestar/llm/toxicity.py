"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

Training sees confirmed toxic texts and unlabelled texts only.  With the class prior
``p`` the risk of a linear scorer ``g`` is

    p * E_pos[l(g)]  +  max(0, E_unl[l(-g)] - p * E_pos[l(-g)])

(``l`` the logistic loss), and where the second part falls below zero its gradient is reversed, so the scorer
cannot win by calling all unlabelled text clean beyond what the prior allows.

Features are the distinct lower-case words of a text (letters and digits), looked up in a
vocabulary of exact words, so that no rare word shares a weight by hashing.  The vocabulary
holds every word of ``LEAST_TEXTS`` toxic sample texts or more whose share among them exceeds that among
unlabelled ones.  None is cut by its strength: a word over-represented by ``z`` standard errors decays
``1 + (STEADY / z) ** 4`` times as fast, so the words of a language with few toxic texts still count, and
words over-represented by chance stay near 0.  Labels, language, source and id are never features.

The sample that fits the model is bounded: at most ``POSITIVES`` toxic and ``UNLABELLED``
other texts of rows that the fold rule leaves for learning, each of at most ``LONGEST``
bytes, picked by a hash of their ids.  Scoring reads every whole text.

Defined cases: null, empty and word-free texts get the scorer's score of no features;
documents without a label count as unlabelled; an id labelled both ways counts
as toxic; labels of null are no labels; without any toxic example every score is 0; rows that
occur twice are scored twice; an empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_column

#: Bounds of the training sample.
POSITIVES, UNLABELLED, LONGEST = 3000, 9000, 20_000
#: Words of the model are in at least so many toxic texts; standard errors at which a word's decay is doubled.
LEAST_TEXTS, STEADY = 4, 4.0
EPOCHS, RATE, DECAY = 500, 0.2, 1e-5
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def held_out(doc_id: Column) -> Column:
    """Rows that never lend a label: CRC-32 of the id's decimal text leaves 1 when divided by 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str) -> float:
        g = self.bias
        get = self.weights.get
        for w in words_of(text):
            g += get(w, 0.0)
        return float(1 / (1 + np.exp(-np.clip(g, -50, 50))))


class WordSets:
    """The word sets of texts, made anew in each pass, so that only the texts stay in memory."""

    def __init__(self, texts: list[str]):
        self.texts = texts

    def __len__(self) -> int:
        return len(self.texts)

    def __iter__(self):
        return map(words_of, self.texts)


def vocabulary_of(positive, unlabelled) -> dict[str, float]:
    """Words over-represented among the toxic texts and by how many standard errors, strongest first."""
    in_p = {w: k for w, k in Counter(w for s in positive for w in s).items() if k >= LEAST_TEXTS}
    in_u = Counter(w for s in unlabelled for w in s if w in in_p)
    n, m = len(positive), len(unlabelled)
    scores = {}
    for w, k in in_p.items():
        both = (k + in_u[w]) / (n + m)
        z = (k / n - in_u[w] / m) / max(np.sqrt(both * (1 - both) * (1 / n + 1 / m)), 1e-12)
        if z > 0:
            scores[w] = z
    return dict(sorted(scores.items(), key=lambda x: (-x[1], x[0])))


def fit(positive, unlabelled, prior: float) -> Model:
    """Full-batch Adam on the non-negative risk of a linear scorer over word presence (lists of word sets)."""
    if not positive or not unlabelled:
        return Model({}, -50.0)
    vocabulary = vocabulary_of(positive, unlabelled)
    at = {w: k for k, w in enumerate(vocabulary)}
    decay = DECAY * (1 + (STEADY / np.array(list(vocabulary.values()))) ** 4)
    xp, xu = _sparse(positive, at), _sparse(unlabelled, at)
    n = len(vocabulary) + 1  # the last weight is the bias
    w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    w[-1] = np.log(prior / (1 - prior)) if prior < 1 else 0.0
    for t in range(1, EPOCHS + 1):
        gp, gu = _margin(xp, w), _margin(xu, w)
        # Logistic loss: l(g) falls with the slope -s(-g), l(-g) rises with s(g).
        down, up_p, up_u = _sigmoid(-gp) / len(gp), _sigmoid(gp) / len(gp), _sigmoid(gu) / len(gu)
        rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        if rest >= 0:
            grad = _gather(xp, -prior * (down + up_p), n) + _gather(xu, up_u, n)
        else:
            grad = _gather(xp, prior * up_p, n) - _gather(xu, up_u, n)
        grad[:-1] += decay * w[:-1]
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        w -= RATE * (1 - t / (1.2 * EPOCHS)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return Model({x: float(w[k]) for x, k in at.items() if w[k]}, float(w[-1]))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _sparse(sets, at: dict[str, int]) -> tuple[np.ndarray, np.ndarray, int]:
    cols, lengths = array("i"), []
    for s in sets:
        before = len(cols)
        cols.extend(sorted(at[w] for w in s if w in at))
        lengths.append(len(cols) - before)
    return np.repeat(np.arange(len(lengths)), lengths), np.array(cols, np.int64), len(sets)


def _margin(x, w: np.ndarray) -> np.ndarray:
    rows, cols, n = x
    return np.bincount(rows, weights=w[cols], minlength=n).astype(float) + w[-1]  # whole numbers where no row has words


def _gather(x, slope: np.ndarray, n: int) -> np.ndarray:
    rows, cols, _ = x
    out = np.bincount(cols, weights=slope[rows], minlength=n).astype(float)
    out[-1] = slope.sum()
    return out


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample; the prior is the toxic share of the labelled learning rows."""
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
             .agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out(F.col("id"))))
    n_known, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic:
        return Model({}, -50.0)
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), text_column().alias("text"))
    learn = rows.where(~held_out(F.col("id")) & (F.octet_length("text") <= LONGEST))
    n_rows = max(1, learn.count())
    pick = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # Expected sizes stay under the bounds; the limits hold them whatever the hash does.
    toxic = known.where("toxic = 1").where(pick < 0.9 * POSITIVES / n_toxic).limit(POSITIVES)
    ids = toxic.select("id", F.lit(True).alias("positive")).unionByName(
        learn.select("id").where(pick < 0.9 * UNLABELLED / n_rows).limit(UNLABELLED)
        .select("id", F.lit(False).alias("positive")))
    sample = learn.join(F.broadcast(ids), "id").select("id", "positive", "text")
    got = sample.orderBy("id", "positive").limit(2 * (POSITIVES + UNLABELLED)).collect()
    texts = {kind: [r["text"] for r in got if r["positive"] == kind] for kind in (True, False)}
    del got
    return fit(WordSets(texts[True]), WordSets(texts[False]), n_toxic / n_known)


def scored(texts: Column, model: Model) -> Column:
    shared = model.weights, model.bias

    @F.pandas_udf("double")
    def score(column: pd.Series) -> pd.Series:
        own = Model(*shared)
        return column.map(own.score).astype("float64")

    return score(texts)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long"), scored(text_column(), model).alias("score"))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                       F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose score stays under the threshold, every column kept."""
    return docs.where(scored(text_column(), train(docs, labels)) < THRESHOLD)
