"""Toxicity by weak supervision.

Voters: lexicons of words and of word beginnings that mark label 1 in one half of the labelled
sample, fixed lexicons of insults, and patterns (shouting, exclamation, insult next to a
second person).  The votes of every document, labelled or not, are counted by pattern, and a
generative label model (EM on these counts, each step one aggregation) estimates the prior
and how each voter votes under either label; no label enters it.  Voters that agree more than
the labels explain are correlated, and each counts for the inverse of its correlated company.
Its posteriors are the soft labels of a linear classifier over hashed words and word
beginnings, which alone scores the texts.  The other half of the labelled sample, unseen by
the lexicons, sets the scale of the scores.

The labelled sample has at most ``most_positive`` + ``most_negative`` texts, those of least
hash; rows held out (crc32 of the id as text, modulo 4, is 2) are never among them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm.common import forget, prepare, written
from hopframe.llm.linear import fit_sparse, platt, sigmoid
from hopframe.llm.textcore import LOWER_CODES, NOT_LETTER, U64, blocks, list_array, span_hashes

SLOTS = 1 << 20
PREFIXES = (4, 5, 6)
#: mined lexicons of words and of each length of beginnings
GROUPS = 3
MINED = (1 + len(PREFIXES)) * GROUPS
THRESHOLD = 0.3
#: nats by which a slot must tell label 1 to be in a mined lexicon (chance alone: one slot in a million; 9 nats let frequent words in, which vote in most texts)
TELLING = 14.0
#: deviations by which a slot must tell the labels apart to be a feature (chance alone passes none of a million)
SURE = 5.0
#: Insults and threats by language.
LEXICONS = {
    "en": "idiot moron stupid trash scum loser pathetic worthless disgusting clown dumb fool jerk bastard bitch asshole fuck fucking shit crap hate ugly retard imbecile filthy vermin".split(),
    "de": "idiot dumm arschloch scheiße dreck abschaum wertlos widerlich hure fotze trottel depp vollidiot hassen schwein missgeburt".split(),
    "fr": "idiot connard salope merde pute ordure débile crétin imbécile dégueulasse pourriture haine batard minable".split(),
    "es": "idiota imbécil estúpido mierda puta cabrón basura asqueroso pendejo gilipollas inútil odio maldito escoria payaso".split(),
}
#: Second persons.
YOU = "you your yours du dich dir ihr tu toi vous te tú usted ti vosotros".split()


def held_out(id_col):
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _name(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)]), LOWER_CODES)[0])


def slots_of(block) -> list[np.ndarray]:
    """Feature slots of each word of a block: the word, then its beginnings where it is longer."""
    out = [span_hashes(block.data, block.starts, block.ends, LOWER_CODES)]
    for k in PREFIXES:
        ends = np.minimum(block.starts + k, block.ends)
        out.append(span_hashes(block.data, block.starts, ends, LOWER_CODES) ^ U64(k))
    return [(h % U64(SLOTS)).astype(np.int64) for h in out]


#: mined lexicons, fixed lexicons, patterns
VOTERS = MINED + len(LEXICONS) + 3


def _any(hit: np.ndarray, block) -> np.ndarray:
    """For each text whether any of its words is hit."""
    total = np.concatenate([[0], np.cumsum(hit)])
    return total[block.words[1:]] > total[block.words[:-1]]


def votes_of(block, slots: list[np.ndarray], lexicons: list[np.ndarray]) -> np.ndarray:
    """Votes (text, voter) of 1, 0 (none) or -1."""
    out = np.zeros((block.n, VOTERS), np.int8)
    for v, lexicon in enumerate(lexicons):
        if len(lexicon):
            out[:, v] = _any(np.isin(slots[v // GROUPS], lexicon), block)
    names = span_hashes(block.data, block.starts, block.ends, LOWER_CODES)
    fixed = [np.isin(names, np.array([_name(w) for w in ws], U64)) for ws in LEXICONS.values()]
    for k, hit in enumerate(fixed):
        out[:, MINED + k] = _any(hit, block)
    insult, you = np.logical_or.reduce(fixed), np.isin(names, np.array([_name(w) for w in YOU], U64))
    owner = np.repeat(np.arange(block.n), np.diff(block.words))
    beside = np.zeros(len(names), bool)
    same = owner[1:] == owner[:-1]
    beside[1:] |= insult[1:] & you[:-1] & same
    beside[:-1] |= insult[:-1] & you[1:] & same
    sums = lambda of: np.diff(np.concatenate([[0], np.cumsum(of)])[block.offsets])
    shout = sums((block.data >= 65) & (block.data <= 90)) / np.maximum(np.diff(block.offsets), 1)
    marks = sums(block.data == 33)
    out[:, -3] = np.where(shout > 0.3, 1, np.where(shout < 0.1, -1, 0))
    out[:, -2] = np.where(marks * 50 > np.maximum(np.diff(block.words), 1), 1, np.where(marks == 0, -1, 0))
    out[:, -1] = _any(beside, block)
    return out


def pack_votes(votes: np.ndarray) -> np.ndarray:
    """A text's votes as one number of two bits a voter."""
    return ((votes.astype(np.int64) + 1) << (2 * np.arange(votes.shape[1], dtype=np.int64))).sum(axis=1)


def unpack_votes(packed: np.ndarray, voters: int) -> np.ndarray:
    return (np.asarray(packed, np.int64)[:, None] >> (2 * np.arange(voters, dtype=np.int64)) & 3) - 1


def _sampled(batches):
    """The distinct slots of each text, by kind (words, then each length of beginnings), and the votes of all but the mined voters."""
    for batch in batches:
        slots, lens, votes = [], [], []
        for block in blocks(batch.column("text"), space=NOT_LETTER):
            every = slots_of(block)
            votes.append(votes_of(block, every, []))
            for d in range(block.n):
                a, b = block.words[d], block.words[d + 1]
                found = np.unique(np.concatenate([e[a:b] + k * SLOTS for k, e in enumerate(every)]))
                slots.append(found)
                lens.append(len(found))
        if lens:
            flat = np.concatenate(votes).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("half"), list_array(np.concatenate(slots).astype(np.int32), np.concatenate([[0], np.cumsum(lens)])), list_array(flat.ravel(), np.arange(len(flat) + 1) * VOTERS)], names=["label", "half", "slots", "votes"])


def _counted(lexicons: list[np.ndarray]):
    """(votes) of each text, as one number."""

    def run(batches):
        for batch in batches:
            packed = [pack_votes(votes_of(b, slots_of(b), lexicons)) for b in blocks(batch.column("text"), space=NOT_LETTER)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(packed) if packed else np.zeros(0, np.int64))], names=["votes"])

    return run


def mined_lexicons(rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, least: int = 3) -> list[np.ndarray]:
    """Slots that mark label 1 in the given texts, dealt into ``GROUPS`` lexicons for each kind of slot.

    ``cols`` holds kind * SLOTS + slot.  A slot marks label 1 if its share of such texts is high
    and tells more (in nats against the share of all texts) than chance does in any slot.
    """
    kinds = 1 + len(PREFIXES)
    pos = np.bincount(cols, weights=labels[rows], minlength=SLOTS * kinds)
    both = np.bincount(cols, minlength=SLOTS * kinds)
    rate = float(np.clip(labels[np.unique(rows)].mean(), 1e-6, 1 - 1e-6))
    share = np.clip(pos / np.maximum(both, 1), 1e-9, 1 - 1e-9)
    tells = both * (share * np.log(share / rate) + (1 - share) * np.log((1 - share) / (1 - rate)))
    chosen = np.flatnonzero((both >= least) & (share > max(0.6, 1.5 * rate)) & (tells > TELLING))
    return [(own := chosen[chosen // SLOTS == k] % SLOTS)[own % GROUPS == g] for k in range(kinds) for g in range(GROUPS)]


def posterior(votes: np.ndarray, model: dict) -> np.ndarray:
    """Probability of label 1 of each row of votes."""
    gain = model["weights"][:, None] * np.log(model["table"][:, 1] / model["table"][:, 0])
    odds = np.log(model["prior"] / (1 - model["prior"])) + gain[np.arange(votes.shape[1]), votes + 1].sum(axis=1)
    return sigmoid(odds)


def _expected(voters: int, model: dict | None):
    """Sums over a partition's vote patterns, weighted by either label's probability (all to label 0 without a model): weight, votes, products of votes."""

    def run(batches):
        total, met, pair = np.zeros(2), np.zeros((voters, 2, 3)), np.zeros((2, voters, voters))
        for batch in batches:
            votes, n = unpack_votes(np.asarray(batch.column("votes")), voters), np.asarray(batch.column("n")).astype(np.float64)
            p = posterior(votes, model) if model else np.zeros(len(n))
            for y, q in enumerate((n * (1 - p), n * p)):
                total[y] += q.sum()
                for v in (-1, 0, 1):
                    met[:, y, v + 1] += q @ (votes == v)
                pair[y] += (votes * q[:, None]).T @ votes
        yield pa.RecordBatch.from_arrays([list_array(np.concatenate([total, met.ravel(), pair.ravel()]), np.array([0, 2 + voters * 6 + 2 * voters * voters]))], names=["sums"])

    return run


def _added(batches):
    total = None
    for batch in batches:
        for x in batch.column("sums"):
            x = x.values.to_numpy()
            total = x.copy() if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([list_array(total, np.array([0, len(total)]))], names=["sums"])


def _correlations(total: float, met: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Absolute correlations of voters from the sums of one label; 0 with themselves."""
    mean = (met[:, 2] - met[:, 0]) / max(total, 1e-9)
    cov = pair / max(total, 1e-9) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    out = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(out, 0)
    return out


def estimate_voters(patterns: DataFrame, voters: int, prior: float | None = None, steps: int = 20, strong: float = 0.35, same: float = 0.8) -> dict:
    """The label model ``{prior, table, weights}`` of ``patterns(votes, n)`` by EM; no text's label is used.

    ``table[voter, label, vote + 1]`` is P(vote | label); ``prior`` is estimated too unless given.
    A voter's weight is one over one plus the sum of its correlations: with the voters that it
    repeats (over ``same``, whatever the label) or, if that is more, with the others given the
    label, as far as they exceed ``strong``.  All start as voters that say 1 three times as often
    under label 1 and a third as often under label 0 as they do overall.  Each step is one
    aggregation of sums whose size depends on the voters alone.
    """
    summed = lambda m: np.array(patterns.mapInArrow(_expected(voters, m), "sums array<double>").coalesce(1).mapInArrow(_added, "sums array<double>").first()["sums"])
    cut = lambda x: (x[:2], x[2 : 2 + voters * 6].reshape(voters, 2, 3), x[2 + voters * 6 :].reshape(2, voters, voters))
    total, met, pair = cut(summed(None))
    base = (met[:, 0] + 0.5) / (total[0] + 1.5)
    table = np.stack([base * np.array([3.0, 1.0, 1 / 3]), base * np.array([1 / 3, 1.0, 3.0])], axis=1)
    table /= table.sum(axis=2, keepdims=True)
    alike = _correlations(total[0], met[:, 0], pair[0])
    repeats = np.where(alike > same, alike, 0).sum(axis=1)
    model = {"prior": 0.5 if prior is None else float(np.clip(prior, 1e-4, 1 - 1e-4)), "table": table, "weights": 1 / (1 + repeats)}
    for _ in range(steps):
        total, met, pair = cut(summed(model))
        table = (met + 0.5) / (total[None, :, None] + 1.5)
        rest = sum(_correlations(total[y], met[:, y], pair[y]) * total[y] for y in (0, 1)) / max(total.sum(), 1e-9)
        weights = 1 / (1 + np.maximum(repeats, np.where(rest > strong, rest, 0).sum(axis=1)))
        share = model["prior"] if prior is not None else float(np.clip(total[1] / max(total.sum(), 1e-9), 1e-4, 1 - 1e-4))
        before, model = model, {"prior": share, "table": table, "weights": weights}
        if np.abs(before["table"] - table).max() < 1e-3 and abs(before["prior"] - share) < 1e-3:
            break
    return model


def fit_classifier(rows: np.ndarray, cols: np.ndarray, post: np.ndarray, labels: np.ndarray, unseen: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights of all slots and the intercept: fitted on the posteriors, scaled on the ``unseen`` labelled texts."""
    n, weights = len(post), np.zeros(SLOTS, np.float32)
    cols = cols % SLOTS
    counts = np.bincount(cols, minlength=SLOTS)
    pos = np.bincount(cols, weights=post[rows], minlength=SLOTS)
    # slots that tell the posteriors apart by more than chance
    expected = counts * post.mean()
    tells = (counts >= 3) & (np.abs(pos - expected) > SURE * np.sqrt(np.maximum(expected * (1 - post.mean()), 0.3)))
    used = np.flatnonzero(tells)
    index = np.full(SLOTS, -1)
    index[used] = np.arange(len(used))
    keep = tells[cols]
    b, c = fit_sparse(rows[keep], index[cols[keep]], n, max(len(used), 1), post, np.ones(n), l2=0.5)
    raw = np.bincount(rows[keep], weights=b[index[cols[keep]]], minlength=n) + c
    # the sample's share of label 1 is not the corpus's
    share, prior = np.clip(labels.mean(), 1e-4, 1 - 1e-4), np.clip(prior, 1e-4, 1 - 1e-4)
    weight = np.where(labels > 0, prior / share, (1 - prior) / (1 - share))
    if len(set(labels[unseen].tolist())) < 2:
        unseen = np.ones(n, bool)
    slope, shift = platt(raw[unseen], labels[unseen].astype(np.float64), weight[unseen])
    weights[used] = b[: len(used)] * slope
    return weights, float(c * slope + shift)


def raw_scores(block, slots: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """For each text the sum of the weights of its distinct slots."""
    out = np.zeros(block.n)
    every = np.stack(slots, axis=1)
    heavy = weights[every] != 0
    if heavy.any():
        owner = np.repeat(np.arange(block.n), np.diff(block.words))
        pairs = np.unique(np.repeat(owner, every.shape[1])[heavy.ravel()] * SLOTS + every[heavy])
        np.add.at(out, pairs // SLOTS, weights[pairs % SLOTS])
    return out


def _scorer(slots: np.ndarray, values: np.ndarray, intercept: float):
    def run(batches):
        weights = np.zeros(SLOTS, np.float64)
        weights[slots] = values
        for batch in batches:
            scores = [raw_scores(b, slots_of(b), weights) for b in blocks(batch.column("text"), space=NOT_LETTER)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigmoid(np.concatenate(scores) + intercept) if scores else np.zeros(0), pa.float64())], names=["doc_id", "score"])

    return run


def fit_toxicity(texts: DataFrame, labels: DataFrame, most_positive: int, most_negative: int) -> tuple[np.ndarray, float]:
    """Weights of all slots and the intercept, from ``texts(doc_id, text)`` and usable ``labels(doc_id, label)``."""
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / max(sum(counts.values()), 1)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [labels.where(F.col("label") == y).orderBy(*order).limit(most) for y, most in ((0, most_negative), (1, most_positive))]
    # at most most_negative + most_positive ids; rows that share an id count once
    chosen = F.broadcast(parts[0].union(parts[1]))
    named = texts.where(F.col("text") != "").join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sample = named.select("label", (F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0).alias("half"), "text").mapInArrow(_sampled, "label int, half boolean, slots array<int>, votes array<int>").toArrow().combine_chunks()
    y, mining = np.asarray(sample.column("label")).astype(np.float64), np.asarray(sample.column("half")).astype(bool)
    if len(set(y.tolist())) < 2 or len(set(y[mining].tolist())) < 2:
        rate = np.clip(prior, 1e-3, 1 - 1e-3)
        return np.zeros(SLOTS, np.float32), float(np.log(rate / (1 - rate)))
    column = sample.column("slots").chunk(0)
    lens, cols = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    rows = np.repeat(np.arange(len(y), dtype=np.int32), lens)
    own = mining[rows]
    lexicons = mined_lexicons(rows[own], cols[own], y)
    patterns = written(texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_counted(lexicons), "votes long").groupBy("votes").agg(F.count("*").alias("n")), "votes")
    try:
        model = estimate_voters(patterns, VOTERS, prior)
    finally:
        forget(patterns)
    votes = np.stack(sample.column("votes").to_numpy(zero_copy_only=False)).astype(np.int64)
    for v, lexicon in enumerate(lexicons):
        votes[rows[np.isin(cols, lexicon + v // GROUPS * SLOTS)], v] = 1
    return fit_classifier(rows, cols, posterior(votes, model), y, ~mining, prior)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_positive: int = 2000, most_negative: int = 3000) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``.

    Null and empty texts get the score of a text without features.  A null id is the empty
    text to crc32.  Of rows that share an id the least text is learned from, and each is scored
    by its own.  Where labels disagree on an id, the larger counts; without labels of both
    kinds every score is the labelled share of label 1 (0.001 without labels).  Whole texts
    count, however long: one forms a block of its own.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    usable = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    weights, intercept = fit_toxicity(texts, usable.groupBy("doc_id").agg(F.max("label").alias("label")), most_positive, most_negative)
    used = np.flatnonzero(weights)
    scored = texts.mapInArrow(_scorer(used, weights[used], intercept), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
