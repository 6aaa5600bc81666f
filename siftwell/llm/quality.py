"""Operator 7, quality classifier by co-training of two views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import given, measured, quoted, unused, written

#: Bound of the sample of labelled rows on which the two classifiers are fitted.
#: In each round they score all unlabelled rows.
LABELLED = 6000
DIMENSIONS, ROUNDS, PER_ROUND, KEEP_AT, SALT = 2048, 4, 250, 0.5, "co-training"
#: A view is confident of a row below and above these probabilities.
LOW, HIGH = 0.1, 0.9
PIECE = 1 << 17


def content_features(raw: np.ndarray, off: np.ndarray, dims: int) -> np.ndarray:
    """Rows x (dims + 1): square roots of the shares of hashed byte trigrams, and
    of the share of words that repeat the one before."""
    index, counts = _trigrams(raw, off, dims)
    rows = len(off) - 1
    row = np.repeat(np.arange(rows), counts)
    hits = np.bincount(row * dims + index, minlength=rows * dims).reshape(rows, dims)
    shares = np.column_stack((hits / np.maximum(counts, 1)[:, None], K.repetition(raw, off)))
    return np.sqrt(shares).astype(np.float32)


def _trigrams(raw: np.ndarray, off: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    b = raw.astype(np.uint32)
    code = b.copy()
    code[:-1] |= b[1:] << 8
    code[:-2] |= b[2:] << 16
    code = ((code * np.uint32(2654435769)) >> np.uint32(32 - int(dims).bit_length() + 1)).astype(np.int64)
    counts = np.maximum(np.diff(off) - 2, 0)
    starts = np.zeros(len(counts), np.int64)
    np.cumsum(counts[:-1], out=starts[1:])
    at = np.arange(int(counts.sum())) + np.repeat(off[:-1] - starts, counts)
    return code[at], counts


LAYOUT = 6
#: Metadata that are names, each in so many hashed values, and that are numbers.
NAMES, BUCKETS, NUMBERS = ("lang", "source", "url"), 32, 2
META = len(NAMES) * BUCKETS + NUMBERS + LAYOUT
_KIND = np.zeros((4, 256), np.int64)
for _k, _chars in enumerate((b"\n", b" \n\t", b"|#*$%&!<>{}=~^_", b".,;:?")):
    _KIND[_k, list(_chars)] = 1


def layout_features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows x LAYOUT: length, lines, length of a line, and the shares of space,
    of symbols and of punctuation."""
    sums = []
    for kind in _KIND:
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(kind[raw], out=total[1:])
        sums.append(total[off[1:]] - total[off[:-1]])
    n, lines = np.maximum(np.diff(off), 1).astype(float), sums[0] + 1.0
    return np.stack([np.log(n) / 10, np.log(lines) / 5, np.log(n / lines) / 8, sums[1] / n * 3, sums[2] / n * 5, sums[3] / n * 5], axis=1)


def metadata(docs: DataFrame) -> Column:
    """What a row says of its text, as numbers: of language, source and the
    host of url the hashed value, then the logarithm of n_chars and whether it
    is missing. A column that docs doesn't have is null."""
    has = lambda c, kind: F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)
    host = F.lower(F.regexp_extract(has("url", "string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    names = [F.pmod(F.xxhash64(F.coalesce(x, F.lit(""))), F.lit(BUCKETS)).cast("double") for x in (has("lang", "string"), has("source", "string"), host)]
    size = has("n_chars", "double")
    return F.array(*names, F.coalesce(F.log1p(F.greatest(size, F.lit(0.0))) / 10, F.lit(0.0)), F.when(size.isNull(), 1.0).otherwise(0.0))


def meta_features(rows: np.ndarray) -> np.ndarray:
    """Rows x (META - LAYOUT) from metadata()."""
    hot = np.eye(BUCKETS)
    return np.column_stack([*(hot[rows[:, k].astype(int)] for k in range(len(NAMES))), rows[:, len(NAMES) :]])


@dataclass
class Logistic:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(x) + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, use: np.ndarray | None = None, start: Logistic | None = None, decay: float = 1e-4, steps: int = 200, rate: float = 0.15) -> Logistic:
    """Logistic regression by full-batch Adam on the rows in use, both classes
    of equal weight, from another model's weights if one is given."""
    x, use = x.astype(np.float32, copy=False), np.ones(len(y), bool) if use is None else use
    one, zero = use & (y == 1), use & (y == 0)
    weight = np.where(one, 0.5 / max(one.sum(), 1), np.where(zero, 0.5 / max(zero.sum(), 1), 0)).astype(np.float32)
    target = one.astype(np.float32)
    w = np.zeros(x.shape[1], np.float32) if start is None else start.weights.copy()
    bias = np.float32(0 if start is None else start.bias)
    m = v = np.zeros(x.shape[1] + 1, np.float32)
    for t in range(1, steps + 1):
        error = (_sigmoid(x @ w + bias) - target) * weight
        grad = np.append(error @ x + np.float32(decay) * w, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)).astype(np.float32)
        w, bias = w - move[:-1], bias - move[-1]
    return Logistic(w, float(bias))


def calibrate(model: Logistic, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling on rows that the model wasn't fitted on."""
    if len(set(y.tolist())) == 2:
        scale = fit_logistic(model.raw(x)[:, None] / 10, y, decay=1e-3)
        if scale.weights[0] > 0:
            model.slope, model.shift = float(scale.weights[0]) / 10, scale.bias


def co_train(content: np.ndarray, meta: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> tuple[Logistic, Logistic]:
    """Two classifiers that label rows for each other. y is NaN for the rows
    without a label, which are all here."""
    known, views = ~np.isnan(y), (content, meta)
    used = [known.copy(), known.copy()]

    def choose(models: list[Logistic], n_low: int, n_high: int) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for teacher, pupil in ((1, 0), (0, 1)):
            left = np.random.default_rng(int(known.sum())).permutation(np.flatnonzero(~used[pupil]))
            p = models[teacher].probability(views[teacher][left])
            low, high = np.flatnonzero(p < LOW)[:n_low], np.flatnonzero(p > HIGH)[:n_high]
            pick = left[np.r_[low, high]]
            used[pupil][pick] = True
            out.append((views[pupil][pick], np.r_[np.zeros(len(low)), np.ones(len(high))]))
        return out

    return _co_train((content[known], meta[known]), y[known], choose, rounds, per_round)


def _co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, choose: Callable, rounds: int, per_round: int) -> tuple[Logistic, Logistic]:
    """From labelled rows, and choose(models, n_low, n_high), which gives each
    view's new rows with the labels that the other one gave them: in every round
    so many of which that one is confident, in the classes' proportion. A fifth
    of the labelled rows stays out and calibrates both."""
    hold = np.arange(1, len(y) + 1) % 5 == 0
    if len(set(y[hold].tolist())) < 2 or len(set(y[~hold].tolist())) < 2:
        hold[:] = False
    good = max(1, round(per_round * y.mean()))
    xs, truth = [x[~hold] for x in views], [y[~hold], y[~hold]]
    models = [fit_logistic(x, t) for x, t in zip(xs, truth)]
    for _ in range(rounds):
        for k, (x, t) in enumerate(choose(models, max(1, per_round - good), good)):
            xs[k], truth[k] = np.concatenate((xs[k], x)), np.append(truth[k], t)
        models = [fit_logistic(x, t, start=m, steps=60) for x, t, m in zip(xs, truth, models)]
    for model, x in zip(models, views):
        calibrate(model, x[hold], y[hold])
    return models[0], models[1]


def _features(batch: pa.RecordBatch, dims: int):
    """Of each piece of a batch with text and meta its first row, the one after
    its last, and both views' features."""
    raw, off = K.string_buffers(batch.column("text"))
    for i, j in K.pieces(off, PIECE, 512):
        part, at = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        named = meta_features(np.array(batch.column("meta").slice(i, j - i).to_pylist(), float).reshape(j - i, len(NAMES) + NUMBERS))
        yield i, j, content_features(part, at, dims), np.column_stack((named, layout_features(part, at))).astype(np.float32)


def _fetched(rows: DataFrame, dims: int) -> pd.DataFrame:
    """Rows (__id, __key, __y, text, meta) with their features, on the driver."""

    def featured(batches):
        for batch in batches:
            for i, j, x, meta in _features(batch, dims):
                cols = [batch.column(k).slice(i, j - i) for k in range(3)]
                cols += [pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in meta], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "key", "y", "content", "meta"])

    return rows.select("__id", "__key", "__y", "text", "meta").mapInArrow(featured, "id long, key long, y double, content binary, meta binary").toPandas()


def _arrays(got: pd.DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    content = np.frombuffer(b"".join(got.content), np.float32).reshape(len(got), dims + 1)
    return content, np.frombuffer(b"".join(got.meta), np.float32).reshape(len(got), META)


def _scores(rows: DataFrame, models: list[Logistic], dims: int) -> DataFrame:
    """(id, key, p0, p1): of rows of which either view is confident, both
    views' probabilities."""

    def run(batches):
        for batch in batches:
            for i, j, *views in _features(batch, dims):
                p = [m.probability(x).astype(float) for m, x in zip(models, views)]
                sure = np.flatnonzero((p[0] < LOW) | (p[0] > HIGH) | (p[1] < LOW) | (p[1] > HIGH))
                cols = [batch.column(k).slice(i, j - i).take(pa.array(sure)) for k in range(2)] + [pa.array(x[sure]) for x in p]
                yield pa.RecordBatch.from_arrays(cols, ["id", "key", "p0", "p1"])

    return rows.select("__id", "__key", "text", "meta").mapInArrow(run, "id long, key long, p0 double, p1 double")


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int | None = None, dims: int = DIMENSIONS, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> tuple[Logistic, Logistic] | None:
    """The two fitted views; None where the labels have fewer than 2 classes."""
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("double").alias("__y"))
        .where("__id IS NOT NULL AND __y IN (0, 1)")
        .groupBy("__id").agg(F.min("__y").alias("__y"))
    )
    order = F.xxhash64(F.lit(SALT), F.col("id"))
    chosen = marks.withColumnRenamed("__id", "id").orderBy(order, "id").limit(labelled)
    view = docs.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), metadata(docs).alias("meta")).where("__id IS NOT NULL")
    view = view.withColumn("__key", F.xxhash64("text", "meta"))
    got = _fetched(view.join(F.broadcast(chosen.withColumnsRenamed({"id": "__id"})), "__id"), dims)
    got = got.sort_values(["id", "content"], kind="stable").drop_duplicates("id").sample(frac=1, random_state=0)
    if got.y.nunique() < 2:
        return None
    known = written(marks.select(F.col("__id").alias("id")), "labelled")
    if pool is not None:
        some = view.select(F.col("__id").alias("id")).distinct().join(measured(known), "id", "left_anti").orderBy(order, "id").limit(pool)
        view = view.join(F.broadcast(some.withColumnsRenamed({"id": "__id"})), "__id", "left_semi")
    taken: list[set[int]] = [set(), set()]

    def choose(models: list[Logistic], n_low: int, n_high: int) -> list[tuple[np.ndarray, np.ndarray]]:
        scores = _scores(view, models, dims).join(measured(known), "id", "left_anti")
        scores = written(scores.groupBy("key").agg(F.min("id").alias("id"), F.min("p0").alias("p0"), F.min("p1").alias("p1")), "scores")
        picks: list[dict[tuple[int, int], float]] = []
        for teacher, pupil in (("p1", 0), ("p0", 1)):
            found: dict[tuple[int, int], float] = {}
            for label, where, n in ((0.0, F.col(teacher) < LOW, n_low), (1.0, F.col(teacher) > HIGH, n_high)):
                # what was taken before is at most so many rows more
                sure = scores.where(where).orderBy(F.xxhash64(F.lit(SALT), "key"), "key").limit(n + len(taken[pupil])).select("id", "key").collect()
                found |= dict.fromkeys([(r.id, r.key) for r in sure if r.key not in taken[pupil]][:n], label)
            taken[pupil] |= {key for _, key in found}
            picks.append(found)
        wanted = sorted(picks[0].keys() | picks[1].keys())
        side = docs.sparkSession.createDataFrame(wanted, "__id long, __key long").withColumn("__y", F.lit(None).cast("double"))
        new = _fetched(view.join(F.broadcast(side), ["__id", "__key"]), dims).drop_duplicates(["id", "key"]).sort_values(["id", "key"])
        out = []
        for k, found in enumerate(picks):
            mine = new[np.array([pair in found for pair in zip(new.id, new.key)], bool)]
            out.append((_arrays(mine, dims)[k], np.array([found[pair] for pair in zip(mine.id, mine.key)], float)))
        return out

    return _co_train(_arrays(got, dims), got.y.to_numpy(float), choose, rounds, per_round)


def score_documents(docs: DataFrame, labels: DataFrame, keep_at: float = KEEP_AT, **params) -> DataFrame:
    """docs with __content, __meta, __score (the probability of good quality by
    either view, and by both) and __keep; existing columns of these names are
    replaced, others are as given, whatever their names.

    The content view sees the text's byte trigrams and repeated words; the
    metadata view language, source, host and n_chars as the row gives them, and
    the layout of the page (its lines, and how much of it is space, symbols or
    punctuation). labels: (doc_id, quality 0 or 1); other values, and null ids,
    are left out, and of several labels of one document the least counts. The
    classifiers are fitted on at most `labelled` labelled documents, those of
    least hash. In each round both views score all unlabelled ones (with
    `pool`, only so many of least hash), and of those of which one view is
    confident, per_round of least hash join the other's rows with its labels:
    a random draw from all of them, so that it is alike at every size. Equal
    documents count once. The combined score averages the calibrated log-odds.

    A null text is scored as an empty one; both lie at the classifiers' bias,
    their metadata and layout. A long text is scored whole. A null lang,
    source, url or n_chars is a value of its own. Rows that repeat a doc_id are
    scored each by its own text. A score that ties with keep_at is kept. Where
    labels name fewer than two classes there is nothing to learn: scores are
    null, all stay. An empty table stays empty.
    """
    dims = params.get("dims", DIMENSIONS)
    models = train(docs, labels, **params)
    docs = docs.select(*given([c for c in docs.columns if c.lower() not in ("__content", "__meta", "__score", "__keep")]))
    if models is None:
        nothing = F.lit(None).cast("double")
        return docs.withColumns({"__content": nothing, "__meta": nothing, "__score": nothing, "__keep": F.lit(True)})
    content, meta = models
    weights, layout = content.weights, meta.weights[-LAYOUT:]
    seen, said, zc, zm = unused(docs.columns, "seen", "said", "zc", "zm")

    @F.arrow_udf("struct<content: double, layout: double>")
    def views(text: pa.Array) -> pa.Array:
        raw, off = K.string_buffers(text)
        out, lay = np.zeros(len(off) - 1), np.zeros(len(off) - 1)
        for i, j in K.pieces(off, PIECE, 512):
            part, at = raw[off[i] : off[j]], off[i : j + 1] - off[i]
            out[i:j] = content_features(part, at, dims) @ weights
            lay[i:j] = layout_features(part, at) @ layout
        return pa.StructArray.from_arrays([pa.array(content.slope * (out + content.bias) + content.shift), pa.array(lay)], ["content", "layout"])

    logit = F.lit(meta.bias) + F.col(seen).getField("layout")
    for k in range(len(NAMES)):
        table = F.array(*[F.lit(float(w)) for w in meta.weights[k * BUCKETS : (k + 1) * BUCKETS]])
        logit = logit + F.get(table, F.col(said)[k].cast("int"))
    for k in range(NUMBERS):
        logit = logit + F.lit(float(meta.weights[len(NAMES) * BUCKETS + k])) * F.col(said)[len(NAMES) + k]
    logit = F.lit(meta.slope) * logit + F.lit(meta.shift)
    sigmoid = lambda z: 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))
    scored = docs.withColumns({seen: views(F.coalesce(F.col("text").cast("string"), F.lit(""))), said: metadata(docs)})
    scored = scored.withColumns({zc: F.col(seen).getField("content"), zm: logit})
    scored = scored.withColumns({"__content": sigmoid(F.col(zc)), "__meta": sigmoid(F.col(zm)), "__score": sigmoid((F.col(zc) + F.col(zm)) / 2)})
    return scored.withColumn("__keep", F.col("__score") >= keep_at).drop(zc, zm, seen, said)


def keep_good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """docs whose combined score is at least keep_at (by default even odds);
    columns as given, whatever their names. Else as score_documents()."""
    clash = [c for c in docs.columns if c.lower() in ("__content", "__meta", "__score", "__keep")]
    if not clash:
        return score_documents(docs, labels, **params).where("__keep").select(*given(docs.columns))
    safe = dict(zip(clash, unused(docs.columns, *("own" for _ in clash))))
    kept = score_documents(docs.withColumnsRenamed(safe), labels, **params).where("__keep")
    return kept.select(*[F.col(quoted(safe.get(c, c))).alias(c) for c in docs.columns])
