"""Operator 2: a quality classifier by co-training.

Two views of a document are classified apart, by logistic regression: its text (shares of kinds
of characters, word and line statistics) and its metadata (language, source, length). In each
round each view labels the unlabelled documents it is sure of, among all documents, for the other
view to learn from. A view is as sure as labelled documents kept aside show it to be; documents of
which the views are sure in contrary ways teach nothing. Equal documents count once; a round takes a
sample of those not yet taken, by hash, whose weight is that of all documents it stands for: as a
part of the labelled rows' weight, the share that they are of all documents. Pseudo-labels of
earlier rounds stay.

Labelled rows are dealt into four parts: to learn from, to tell sureness and calibrate each view's
log-odds, to combine the calibrated views, and for the bound. A document is rejected if its
score falls below a bound that rejects at most ``FALSE_REJECTS`` of the good ones of the last part.

Cases: null and empty texts have a text view of zeros; null metadata is a value of its own; equal
rows score alike; labels for unknown documents are ignored, several labels of one doc_id are averaged, null
labels dropped; with too few labels of either kind nothing is rejected and scores are 0.5; a part of
too few rows leaves log-odds as they are; an empty table gives no rows; input columns are kept,
those named like results replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.work import Scratch, bounded_sample, fresh, table

#: Labelled rows that are learnt from, at most (those of least hash); rounds; pseudo-labelled rows a round, view and class.
LABELLED, ROUNDS, EACH = 20_000, 3, 1000
#: Precision that held-out rows must show for a view's pseudo-labels; share of good rows that may be rejected.
SURE, FALSE_REJECTS = 0.97, 0.002
#: Of twenty labelled rows in hash order: how many go to each part.
LEARN, CALIBRATE, COMBINE = 12, 3, 2
SOURCES, LANGUAGES, LENGTHS = 32, 8, 24
MARKS = b"!*$%&#|,.;:?-_/<>{}[]()\"'@=+~"


def text_view(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "replace")
    if not raw.strip():
        return [0.0] * (12 + len(MARKS))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    often = Counter(words).most_common(1)[0][1]
    ends = sum(w[-1] in b"!*$%&#|" for w in words)
    upper = sum(w.isupper() for w in words)
    out = [counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum(), counts[128:].sum(), counts[10], len(raw) / len(words) / 10, len(set(words)) / len(words), often / len(words), len(set(lines)) / len(lines), math.log1p(len(words) / len(lines)), ends / len(words), upper / len(words)]
    return [float(x) for x in out] + [float(math.sqrt(counts[b])) for b in MARKS]


def metadata_view(lang: str | None, source: str | None, n_chars: float | None) -> list[float]:
    out = [0.0] * (LANGUAGES + SOURCES + LENGTHS)
    out[crc32((lang or "\0").encode()) % LANGUAGES] = 1.0
    out[LANGUAGES + crc32((source or "\0").encode()) % SOURCES] = 1.0
    n = 0 if n_chars is None or n_chars != n_chars else max(0, int(n_chars))
    out[LANGUAGES + SOURCES + min(LENGTHS - 1, n.bit_length())] = 1.0
    return out


class Logistic(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of a good document."""
        return np.clip((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1], -30, 30)


def learn(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0) -> Logistic:
    """By Newton's method, with a ridge on all weights but the intercept."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + penalty, z.T @ (weight * (y - p)) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, w)


def sure_from(odds: np.ndarray, right: np.ndarray) -> float:
    """The least log-odds above which SURE of the held-out rows are right; infinite if there is none."""
    order = np.argsort(-odds)
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    fit = np.flatnonzero((good >= SURE) & (np.arange(1, len(order) + 1) >= 20))
    return float(odds[order][fit[-1]]) if len(fit) else math.inf


class Model(NamedTuple):
    text: Logistic
    metadata: Logistic
    calibrated: tuple[Logistic, Logistic]  # of each view's log-odds
    combined: Logistic
    bound: float
    taught: tuple[int, int]  # pseudo-labelled rows that the text view and the metadata view learnt from

    def odds(self, text: np.ndarray, metadata: np.ndarray) -> list[np.ndarray]:
        """Calibrated log-odds of both views."""
        return [c.odds(m.odds(x)[:, None]) for c, m, x in zip(self.calibrated, (self.text, self.metadata), (text, metadata), strict=True)]

    def score(self, text: np.ndarray, metadata: np.ndarray) -> list[np.ndarray]:
        a, b = self.odds(text, metadata)
        return [1 / (1 + np.exp(-x)) for x in (a, b, self.combined.odds(np.column_stack([a, b])))]


def learn_or(x: np.ndarray, y: np.ndarray, weights: list[float]) -> Logistic:
    """Learnt where there are some rows of both classes, else these weights on the columns as they are."""
    if min((y == 1).sum(), (y == 0).sum()) >= 5:
        return learn(x, y)
    return Logistic(np.zeros(len(weights)), np.ones(len(weights)), np.array([*weights, 0.0]))


def stacked(v: pd.Series, width: int) -> np.ndarray:
    return np.array(v.tolist(), float).reshape(len(v), width)


def with_views(docs: DataFrame, name: str = "_v") -> DataFrame:
    """All rows with both views as arrays (t, m) and a hash of these (h), in a struct of that name."""

    @F.pandas_udf("t array<float>, m array<float>")
    def run(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"t": [text_view(x) for x in text], "m": [metadata_view(*x) for x in zip(lang, source, n_chars, strict=True)]})

    seen = docs.withColumn(name, run(F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("double")))
    return seen.withColumn(name, F.struct(f"{name}.t", f"{name}.m", F.xxhash64(f"{name}.t", f"{name}.m").alias("h")))


def train(seen: DataFrame, labels: DataFrame, work: Scratch, rounds: int = ROUNDS) -> Model | None:
    """Co-training over rows of doc_id, t, m and h; None where labels of a class are missing."""
    marked = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    rows = bounded_sample(work.save(seen.join(marked, "doc_id"), "labelled"), "doc_id", LABELLED).toPandas()
    if rows.y.nunique() < 2 or min(rows.y.value_counts()) < 10:
        return None
    x = [np.array(rows.t.tolist(), float), np.array(rows.m.tolist(), float)]
    y = rows.y.to_numpy(float)
    place = np.arange(len(y)) % 20  # rows come in hash order
    own, sure, combine = place < LEARN, (place >= LEARN) & (place < LEARN + CALIBRATE), (place >= LEARN + CALIBRATE) & (place < LEARN + CALIBRATE + COMBINE)
    last = place >= LEARN + CALIBRATE + COMBINE
    more: list[tuple[list, list, list]] = [([], [], []) for _ in x]  # each view's pseudo-labelled rows: features, labels, weights

    def learnt() -> list[Logistic]:
        return [learn(np.concatenate([a[own], np.array(b).reshape(-1, a.shape[1])]), np.concatenate([y[own], c]), np.concatenate([np.ones(own.sum()), w])) for a, (b, c, w) in zip(x, more, strict=True)]

    pool = work.save(seen.join(marked.select("doc_id"), "doc_id", "left_anti").select("t", "m", "h").dropDuplicates(["h"]), "pool")
    total, taken = pool.count(), set()
    for k in range(rounds if total else 0):
        models = learnt()
        bounds = [sure_from(sign * m.odds(a[sure]), y[sure] == (sign > 0)) for m, a in zip(models, x, strict=True) for sign in (1, -1)]
        picked = sample_of_sure(pool, models, bounds, taken, k)
        if not picked:
            break
        for view, good, got, share in picked:
            taken.update(got.h)
            features, classes, weights = more[1 - view]
            features.extend(got["tm"[1 - view]].tolist())
            classes.extend([float(good)] * len(got))
            weights.extend([own.sum() * share / total / len(got)] * len(got))
    models = learnt()
    calibrated = tuple(learn_or(m.odds(a[sure])[:, None], y[sure], [1.0]) for m, a in zip(models, x, strict=True))
    half = Model(*models, calibrated, None, 0.0, tuple(len(c) for _, c, _ in more))
    combined = learn_or(np.column_stack(half.odds(x[0][combine], x[1][combine])), y[combine], [1.0, 1.0])
    out = half._replace(combined=combined)
    good = np.sort(out.score(x[0][last], x[1][last])[2][y[last] == 1])
    return out._replace(bound=min(0.5, float(good[int(FALSE_REJECTS * len(good))])) if len(good) else 0.0)


def sample_of_sure(pool: DataFrame, models: list[Logistic], bounds: list[float], taken: set[int], salt: int) -> list[tuple[int, int, pd.DataFrame, int]]:
    """(view, class, rows, how many they stand for) of what each view is sure of: at most EACH rows of least hash each."""
    names = ["t1", "t0", "m1", "m0"]

    @F.pandas_udf("t1 boolean, t0 boolean, m1 boolean, m0 boolean")
    def run(t: pd.Series, m: pd.Series) -> pd.DataFrame:
        odds = [model.odds(stacked(v, len(model.mean))) for model, v in zip(models, (t, m), strict=True)]
        sure = [sign * odds[k // 2] >= bounds[k] for k, sign in enumerate((1, -1, 1, -1))]
        clear = [~(sure[2 * (1 - k // 2) + 1 - k % 2]) for k in range(4)]  # the other view isn't sure of the contrary
        return pd.DataFrame({n: a & b for n, a, b in zip(names, sure, clear, strict=True)})

    told = pool.withColumn("s", run("t", "m"))
    counts = told.agg(*[F.count(F.when(F.col(f"s.{n}"), 1)).alias(n) for n in names]).first()
    space = 1 << 30
    draw = F.pmod(F.xxhash64("h", F.lit(salt)), F.lit(space))
    within = [F.col(f"s.{n}") & (draw < min(space, int(space * (1.5 * EACH + 200) / max(1, counts[n])))) for n in names]
    rows = told.where(within[0] | within[1] | within[2] | within[3]).select("t", "m", "h", "s.*", draw.alias("draw")).toPandas()  # about 4 * 1.5 * EACH
    rows = rows[~rows.h.isin(taken)].sort_values(["draw", "h"])
    out = []
    for k, n in enumerate(names):
        got = rows[rows[n]].head(EACH)
        if len(got):
            out.append((k // 2, 1 - k % 2, got, counts[n]))
    return out


def judged(seen: DataFrame, name: str, labels: DataFrame, work: Scratch) -> DataFrame:
    """Rows of ``with_views`` whose struct holds text_score, metadata_score, score and accepted instead."""
    doc = F.col("doc_id").cast("long").alias("doc_id")
    model = train(seen.select(doc, f"{name}.t", f"{name}.m", f"{name}.h"), labels, work)
    if model is None:
        half = F.lit(0.5)
        return seen.withColumn(name, F.struct(half.alias("text_score"), half.alias("metadata_score"), half.alias("score"), F.lit(True).alias("accepted")))

    @F.pandas_udf("text_score double, metadata_score double, score double")
    def run(t: pd.Series, m: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(SCORES, model.score(stacked(t, len(model.text.mean)), stacked(m, len(model.metadata.mean))), strict=True)))

    told = seen.withColumn(name, run(f"{name}.t", f"{name}.m"))
    return told.withColumn(name, F.struct(f"{name}.*", (F.col(name)["score"] >= model.bound).alias("accepted")))


SCORES = ("text_score", "metadata_score", "score")


def _told(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, str]:
    """Documents and views are written once, so no text is read for its features twice."""
    work, name = Scratch(docs.sparkSession), fresh("_v", docs)
    return judged(work.save(with_views(docs, name), "seen"), name, labels, work), name


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows with text_score, metadata_score, score (chances of a good document) and accepted."""
    out, name = _told(docs, labels)
    return out.drop(*SCORES, "accepted").select("*", f"{name}.*").drop(name)


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The accepted rows with the input's columns as they are."""
    out, name = _told(docs, labels)
    return out.where(F.col(name)["accepted"]).select(*docs.columns)


def op2_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Scratch(spark)
    seen = work.save(with_views(table(spark, sf_dir, "documents")).select("doc_id", "_v"), "seen")
    return judged(seen, "_v", table(spark, sf_dir, "labels"), work).select("doc_id", "_v.*")
