"""Quality classification by co-training two views.

The text view sees shape features of the whole text, each in quantile bins; the metadata
view sees language, source and declared length.  Both start from the labelled sample.  In
each round every row without a label is scored by both views; each view passes on
``per_round`` rows of each label among all that it is ``SURE`` of (those of least hash), and
the other view learns from them.  At the end both views are calibrated on labelled texts that
neither learned from, and a last logistic model over the two calibrated log odds scores every
document.

The labelled sample has at most ``most_labelled`` rows, those of least hash.  The features of
all rows are written once; the rounds and the scores read them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm.common import forget, prepare, written
from hopframe.llm.linear import fit_codes, fit_dense, platt, sigmoid
from hopframe.llm.quality_rules import CLASS_OF, CLASSES, _common_table, _duplicate_lines
from hopframe.llm.textcore import blocks, list_array, span_hashes, window_hashes

BINS = 8
#: columns of the metadata view: languages, sources, powers of two of the length
META = (16, 64, 24)
ROUNDS = 4
PER_ROUND = 400
SHAPES = (*CLASSES, "bang", "pipe", "repeats", "dup_lines", "runs", "distinct", "log_words", "word_len", "common", "marked_ends", "mixed")
SURE = 0.97


def _shapes_of(block) -> np.ndarray:
    """Features of each text of a block, in the order of SHAPES."""
    common, _ = _common_table()
    data, offsets, words = block.data, block.offsets, block.words
    exact, lower = block.word_hashes(), block.word_hashes(lower=True)
    first, ptr = block.window_starts(3)
    grams = window_hashes(exact, first, 3)
    slot = np.minimum(np.searchsorted(common, lower), len(common) - 1)
    is_common = common[slot] == lower
    classes = CLASS_OF[data]
    dup = _duplicate_lines(block)
    last = data[block.ends - 1] if len(block.ends) else np.zeros(0, np.uint8)
    marked = CLASS_OF[last] == CLASSES.index("symbol")
    symbolic = np.zeros(len(data) + 1, np.int64)
    np.cumsum(classes == CLASSES.index("symbol"), out=symbolic[1:])
    out = np.zeros((block.n, len(SHAPES)))
    for d in range(block.n):
        lo, hi, a, b = offsets[d], offsets[d + 1], words[d], words[d + 1]
        n, chars = int(b - a), max(int(hi - lo), 1)
        raw = data[lo:hi]
        out[d, : len(CLASSES)] = np.bincount(classes[lo:hi], minlength=len(CLASSES) + 1)[: len(CLASSES)] / chars
        rest = out[d, len(CLASSES) :]
        rest[0], rest[1] = (raw == 33).mean() if n else 0, (raw == 124).mean() if n else 0
        if n:
            own, g = lower[a:b], grams[ptr[d] : ptr[d + 1]]
            rest[2] = 1 - len(np.unique(g)) / len(g) if len(g) else 0
            rest[3] = dup[d] / max(int((raw == 10).sum()) + 1, 1)
            rest[4] = (own[1:] == own[:-1]).mean() if n > 1 else 0
            rest[5] = len(np.unique(own)) / n
            rest[6] = np.log1p(n)
            rest[7] = (block.ends[a:b] - block.starts[a:b]).mean()
            rest[8] = is_common[a:b].mean()
            rest[9] = marked[a:b].mean()
            rest[10] = (symbolic[block.ends[a:b]] > symbolic[block.starts[a:b]]).mean()
    return out


def _observed(extra: tuple[str, ...]):
    def run(batches):
        for batch in batches:
            shapes = [_shapes_of(b) for b in blocks(batch.column("text"))]
            if shapes:
                flat = np.concatenate(shapes).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in extra), list_array(flat.ravel(), np.arange(len(flat) + 1) * len(SHAPES))], names=[*extra, "shapes"])

    return run


def _text_codes(shapes: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The column of each feature's quantile bin."""
    base = np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])])
    return np.stack([base[j] + np.searchsorted(e, shapes[:, j], "right") for j, e in enumerate(edges)], axis=1)


def _slot(value: str | None, n: int) -> int:
    raw = np.frombuffer(("=" + value).encode() if value is not None else b"-", np.uint8)
    return int(span_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0] % np.uint64(n))


def _meta_codes(lang, source, n_chars) -> np.ndarray:
    seen: dict = {}
    slots = lambda v, n: seen.setdefault((v, n), _slot(v, n))
    length = [0 if c is None or c != c else 1 + min(int(np.log2(max(c, 1))), META[2] - 2) for c in n_chars]
    return np.stack([np.array([slots(x, META[0]) for x in lang], np.int64), META[0] + np.array([slots(x, META[1]) for x in source], np.int64), META[0] + META[1] + np.array(length, np.int64)], axis=1)


def _meta_of(batch) -> np.ndarray:
    return _meta_codes(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))


def _shapes_in(batch) -> np.ndarray:
    column = batch.column("shapes")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(SHAPES))


def _odds(codes: np.ndarray, model: np.ndarray) -> np.ndarray:
    return model[codes].sum(axis=1) + model[-1]


def _sure(batch, models: list[np.ndarray], edges: list[np.ndarray], taken: np.ndarray) -> list[np.ndarray]:
    """For each view and label (1, 0): which rows of the pool the view is sure of."""
    free = ~np.isin(np.asarray(batch.column("name")), taken)
    out = []
    for codes, m in zip((_text_codes(_shapes_in(batch), edges), _meta_of(batch)), models):
        p = sigmoid(_odds(codes, m))
        out += [free & (p >= SURE), free & (1 - p >= SURE)]
    return out


def _confident(pool: DataFrame, models: list[np.ndarray], edges: list[np.ndarray], taken: np.ndarray, per_round: int) -> list:
    """``per_round`` rows of each view and label among all rows of the pool that the view is sure of.

    A first pass counts them, so that the second sends only those of least hash.
    """

    def count(batches):
        total = np.zeros(4, np.int64)
        for batch in batches:
            total += [x.sum() for x in _sure(batch, models, edges, taken)]
        yield pa.RecordBatch.from_arrays([pa.array(range(4), pa.int32()), pa.array(total)], names=["kind", "n"])

    counts = {r["kind"]: r["n"] for r in pool.mapInArrow(count, "kind int, n long").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    share = [min(1.0, 2 * per_round / max(counts.get(k, 0), 1)) for k in range(4)]

    def send(batches):
        for batch in batches:
            order = np.asarray(batch.column("place"))
            for kind, sure in enumerate(_sure(batch, models, edges, taken)):
                # places are uniform over the signed 64-bit numbers
                rows = np.flatnonzero(sure & (order.astype(np.float64) <= (share[kind] * 2 - 1) * 2.0**63))
                if len(rows):
                    part = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32)), *(part.column(c) for c in _FEATURES)], names=["kind", *_FEATURES])

    sent = pool.mapInArrow(send, f"kind int, {_FEATURE_TYPES}")
    return [sent.where(F.col("kind") == k).orderBy("place", "name").limit(per_round).toArrow().combine_chunks() for k in range(4)] if sum(counts.values()) else []


_FEATURES = ("name", "place", "lang", "source", "n_chars", "shapes")
_FEATURE_TYPES = "name long, place long, lang string, source string, n_chars double, shapes array<float>"


def co_train(labelled: tuple[np.ndarray, np.ndarray, np.ndarray], edges: list[np.ndarray], pool: DataFrame | None, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> dict:
    """Models of both views and of their combination from ``labelled`` (codes of both views, labels).

    A fixed random quarter of the labelled rows is kept for calibration.  Passed rows weigh a half.
    """
    *views, y = labelled
    widths = (sum(len(e) + 1 for e in edges), sum(META))
    aside = np.zeros(len(y), bool)
    aside[np.random.default_rng(11).permutation(len(y))[: len(y) // 4]] = True
    # rows, labels and weights that each view learns from
    own = [[v[~aside]] for v in views]
    says, weighs = [[y[~aside].astype(np.float64)] for _ in views], [[np.ones((~aside).sum())] for _ in views]
    taken = np.zeros(0, np.int64)
    for step in range(rounds + 1):
        models = [fit_codes(np.concatenate(own[v]), widths[v], np.concatenate(says[v]), np.concatenate(weighs[v]), l2=2.0) for v in (0, 1)]
        if step == rounds or pool is None:
            break
        passed = _confident(pool, models, edges, taken, per_round)
        if not sum(t.num_rows for t in passed):
            break
        for kind, rows in enumerate(passed):
            if rows.num_rows:
                learner, label = 1 - kind // 2, 1.0 - kind % 2
                batch = rows.to_batches()[0]
                fresh = ~np.isin(np.asarray(batch.column("name")), taken)
                own[learner].append((_text_codes(_shapes_in(batch), edges) if learner == 0 else _meta_of(batch))[fresh])
                says[learner].append(np.full(fresh.sum(), label))
                weighs[learner].append(np.full(fresh.sum(), 0.5))
        taken = np.union1d(taken, np.concatenate([np.asarray(t.column("name")) for t in passed if t.num_rows]))
    held = y[aside].astype(np.float64)
    raw = [_odds(v[aside], m) for v, m in zip(views, models)]
    scales = [platt(r, held) for r in raw]
    odds = np.stack([a * r + b for r, (a, b) in zip(raw, scales)], axis=1)
    both = fit_dense(odds, held, l2=1.0) if len(set(held.tolist())) == 2 else np.array([1.0, 0.0, 0.0])
    return {"models": models, "scales": scales, "both": both, "edges": edges}


def _scores(model: dict, shapes: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "prior" in model:
        p = np.full(len(shapes), model["prior"])
        return p, p, p
    views = (_text_codes(shapes, model["edges"]), meta)
    odds = [a * _odds(codes, m) + b for codes, m, (a, b) in zip(views, model["models"], model["scales"])]
    return sigmoid(odds[0]), sigmoid(odds[1]), sigmoid(np.stack(odds, axis=1) @ model["both"][:-1] + model["both"][-1])


def _scorer(model: dict, text: bool):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            shapes = np.concatenate([_shapes_of(b) for b in blocks(batch.column("text"))]).astype(np.float32) if text else _shapes_in(batch)
            p = _scores(model, shapes, _meta_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(x, pa.float64()) for x in p)], names=["row", "text_score", "meta_score", "score"])

    return run


def quality_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of each row of ``docs`` with its label, written once; label is null in the pool.  Where labels disagree on an id, 0 counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    name = F.xxhash64("doc_id", "text", "lang", "source", "n_chars")
    extra = ("doc_id", "name", "place", "lang", "source", "n_chars")
    seen = _columns(docs).withColumn("name", name).withColumn("place", F.xxhash64("name", F.lit("place"))).mapInArrow(_observed(extra), f"doc_id long, {_FEATURE_TYPES}")
    return written(seen.join(known, "doc_id", "left"), "quality-features")


def fit_quality(features: DataFrame, most_labelled: int = 12_000, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> dict:
    """The model from :func:`quality_features`."""
    first = features.where("label is not null").orderBy("place", "name").limit(most_labelled).select("label", "lang", "source", "n_chars", "shapes")
    sample = first.toArrow().combine_chunks()
    y = np.asarray(sample.column("label"))
    if len(set(y.tolist())) < 2 or len(y) < 16:
        return {"prior": float(y.mean()) if len(y) else 0.5}
    batch = sample.to_batches()[0]
    shapes = _shapes_in(batch)
    # a feature that is mostly zero gets its bins from its other values
    edges = []
    for j in range(shapes.shape[1]):
        x = shapes[:, j]
        cut = np.quantile(x[x != 0], np.arange(BINS) / BINS) if (x != 0).any() else np.zeros(1)
        edges.append(np.unique(np.maximum(cut, np.nextafter(np.float32(0), np.float32(1)))).astype(np.float32))
    return co_train((_text_codes(shapes, edges), _meta_of(batch), y), edges, features.where("label is null"), rounds, per_round)


def _columns(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "double"}
    return docs.select(*[(F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def score_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3, most_labelled: int = 12_000) -> DataFrame:
    """``(doc_id, text_score, meta_score, score, kept)`` for each row of ``docs``; kept is score >= ``least``.

    Null and empty texts have the features of an empty text; null metadata is a value of its
    own.  Rows that share an id are scored each by its own text and metadata, and share its
    label; equal rows get equal scores.  Where labels disagree on an id, 0 counts.  With labels
    of one kind only, or under 16, all scores are the labelled share of 1 (0.5 without labels).
    Very long texts form a block of their own; memory is a small multiple of the longest.
    """
    prepare(docs.sparkSession)
    features = quality_features(docs, labels)
    model = fit_quality(features, most_labelled)
    scored = features.withColumnRenamed("doc_id", "row").mapInArrow(_scorer(model, text=False), "row long, text_score double, meta_score double, score double")
    return scored.select(F.col("row").alias("doc_id"), "text_score", "meta_score", "score", (F.col("score") >= least).alias("kept"))


def filter_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3, most_labelled: int = 12_000) -> DataFrame:
    """The rows of ``docs`` whose score (see :func:`score_quality`) is at least ``least``, with all their columns."""
    prepare(docs.sparkSession)
    features = quality_features(docs, labels)
    try:
        model = fit_quality(features, most_labelled)
    finally:
        forget(features)
    packed = docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    packed = packed.select(F.col("_row").alias("row"), *[(F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in (("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "double"))])
    schema = packed.select("row").withColumn("text_score", F.lit(0.0)).withColumn("meta_score", F.lit(0.0)).withColumn("score", F.lit(0.0)).schema
    scored = packed.mapInArrow(_scorer(model, text=True), schema).where(F.col("score") >= least)
    return scored.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
