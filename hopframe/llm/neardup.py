"""MinHash near-duplicate classes with odd sketches.

1. One Python pass turns every whole text into its set of word shingles (64-bit hashes),
   512 MinHash samples, the band keys of the first ``bands * rows``, and an odd sketch: each
   sample (index, value) flips one bit of a 2048-bit bitmap, so the population count of the
   XOR of two sketches estimates how many samples differ.  A second odd sketch takes the whole
   set: there the count never exceeds the shingles that only one of two sets holds.
2. Rows with one and the same set form a node; only nodes take part further on.
3. Each band bucket draws one hub by a hash of its own, and every node is proposed to the
   hubs of a fourth of its buckets, drawn by hash (linear in the bucket, no pairs inside it).
   Sizes, the sets' odd sketches (both lose no link) and those of the samples (4.5 deviations
   below the threshold) drop pairs; the rest are confirmed on the full sets.
4. Star contraction gives components.  Nodes apart from their bucket's hub meet that hub, if
   they didn't yet, and four more of each bucket.  Those still apart are at last proposed to
   all nodes of other components in their buckets (sketch first, then full sets), so hubs
   lose no link and a node that already is in its hub's component isn't compared again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm.common import forget, prepare, written
from hopframe.llm.components import connected_components
from hopframe.llm.textcore import U64, blocks, list_array, mix, window_hashes

ROWS = 5
SAMPLES = 512
SKETCH_BITS = 2048
LANES = SKETCH_BITS // 64
MORE_HUBS = 4
#: one in so many (node, bucket) rows is proposed at first, the others only where still apart
FIRST_SHARE = 4
#: ids up to which they are sent to the texts; beyond it texts and ids are dealt by id
MOST_SENT = 1_000_000
MISS = 1e-6
CHUNK = 256


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands so that a pair at the threshold shares no band with probability under ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def sketch_limit(threshold: float, samples: int, deviations: float = 4.5) -> int:
    """Most differing sketch bits that a pair at the threshold shows, that many deviations above the mean.

    The samples that differ are binomial; each flips two of the bits, and what two flips of one
    bit hide is a second, smaller source of spread.
    """
    flips = 2 * samples * (1 - threshold)
    shown = math.exp(-2 * flips / SKETCH_BITS)
    spread = 2 * shown * math.sqrt(samples * threshold * (1 - threshold))
    hidden = math.sqrt(SKETCH_BITS / 4 * (1 - shown) ** 2)
    return math.ceil(SKETCH_BITS / 2 * (1 - shown) + deviations * math.hypot(spread, hidden))


def shingle_sets(block, words: int, lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text; a shorter text is one shingle, no words none."""
    hashes = block.word_hashes(lower)
    first, ptr = block.window_starts(words)
    grams = window_hashes(hashes, first, words)
    for d in range(block.n):
        a, b = block.words[d], block.words[d + 1]
        if b - a >= words:
            yield np.unique(grams[ptr[d] : ptr[d + 1]])
        elif b > a:
            yield window_hashes(hashes[a:b], np.zeros(1, np.int64), int(b - a))
        else:
            yield np.zeros(0, U64)


def set_node(grams: np.ndarray) -> int:
    """One 64-bit name for a set: equal sets have equal names."""
    return int(mix(np.array([np.add.reduce(mix(grams ^ U64(0x5851F42D4C957F2D))) ^ U64(len(grams))], U64)).view(np.int64)[0])


def signer(words: int, bands: int, rows: int):
    samples = max(SAMPLES, bands * rows)
    seeds = mix(np.arange(1, 2 * samples + 1, dtype=U64) * U64(0x9FB21C651E98DF25))
    mult = (seeds[:samples] >> U64(32)).astype(np.uint32) | np.uint32(1)
    plus = (seeds[samples:] >> U64(32)).astype(np.uint32)
    weights = mix(np.arange(1, rows + 1, dtype=U64)) | U64(1)
    band_no = mix(np.arange(1, bands + 1, dtype=U64) * U64(0xA0761D6478BD642F))
    index = np.arange(samples, dtype=U64) << U64(32)

    def odd(items: np.ndarray) -> np.ndarray:
        bits = np.bincount((items % U64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
        return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)

    def sign(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band keys, and the odd sketch of the samples followed by that of the set."""
        low = (grams >> U64(32)).astype(np.uint32)
        best = np.full(samples, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(low), CHUNK):
            np.minimum(best, (low[i : i + CHUNK, None] * mult + plus).min(axis=0), out=best)
        keys = mix(mix(best[: bands * rows].astype(U64).reshape(bands, rows) * weights).sum(axis=1) + band_no)
        return keys.view(np.int64), np.concatenate([odd(mix(best.astype(U64) | index)), odd(mix(grams))])

    return sign


def _signatures(words: int, bands: int, rows: int):
    sign = signer(words, bands, rows)
    lanes = 2 * LANES

    def run(batches):
        for batch in batches:
            nodes, sizes, keys, lens, sketches = [], [], [], [], []
            for block in blocks(batch.column("text")):
                for grams in shingle_sets(block, words):
                    sizes.append(len(grams))
                    nodes.append(set_node(grams))
                    k, s = sign(grams) if len(grams) else (np.zeros(0, np.int64), np.zeros(lanes, np.int64))
                    keys.append(k)
                    lens.append(len(k))
                    sketches.append(s)
            if nodes:
                flat = np.concatenate(keys)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), list_array(flat, np.concatenate([[0], np.cumsum(lens)])), list_array(np.concatenate(sketches), np.arange(len(nodes) + 1) * lanes)], names=["doc_id", "n_shingles", "node", "keys", "sketch"])

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            nodes, sets = [], []
            for block in blocks(batch.column("text")):
                for grams in shingle_sets(block, words):
                    nodes.append(set_node(grams))
                    sets.append(grams.view(np.int64))
            if nodes:
                made = np.array(nodes, np.int64)
                fits = made == np.asarray(batch.column("node"))
                arrays = list_array(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
                yield pa.RecordBatch.from_arrays([pa.array(made), arrays], names=["node", "grams"]).filter(pa.array(fits))

    return run


def _differing(a: str, b: str, first: int):
    """Bits that differ between two sketches, from lane ``first`` on."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(first, first + LANES)), F.lit(0))


def _near(percent: int, limit: int):
    """Whether two nodes (sketches sa, sb; sizes na, nb) may be linked.

    Sets that differ in d shingles meet 100 * intersection >= percent * union if and only if
    (100 + percent) * d <= (100 - percent) * (na + nb), and their odd sketches differ in d
    bits at most, so this bound and that of the sizes lose no link.
    """
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    sets = _differing("sa", "sb", LANES) * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)
    return sizes & sets & (_differing("sa", "sb", 0) <= limit)


def _drawn(no: int):
    """A bucket's hub by draw ``no``: the node of least hash."""
    return F.min(F.struct(F.xxhash64("key", "node", F.lit(no)).alias("draw"), "node"))


def _early():
    return F.pmod(F.xxhash64("node", "key", F.lit("first")), F.lit(FIRST_SHARE)) == 0


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets share at least ``percent`` of their union."""
    a = sets.select(F.col("node").alias("u"), F.col("grams").alias("ga"))
    b = sets.select(F.col("node").alias("v"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb")).cast("long")
    union = F.size("ga") + F.size("gb") - F.col("both")
    return pairs.join(a, "u").join(b, "v").select("u", "v", "ga", "gb", both.alias("both")).where(F.col("both") * 100 >= union * percent).select("u", "v")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``.

    Links are pairs of texts whose shingle sets meet 100 * intersection >= percent * union.
    Null or empty texts have no shingles and stay alone.  Rows of one id count each by their
    own text.  component_id is the smallest id reachable (a null id never is, so a row
    without an id that reaches no other has component_id null); kept is doc_id = component_id.
    """
    prepare(docs.sparkSession)
    bands = bands_for(percent / 100, rows)
    limit = sketch_limit(percent / 100, max(SAMPLES, bands * rows))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = written(texts.mapInArrow(_signatures(words, bands, rows), "doc_id long, n_shingles long, node long, keys array<long>, sketch array<long>"), "signed")

    ids = signed.where("n_shingles > 0")
    nodes = ids.groupBy("node").agg(F.min("doc_id").alias("least"))
    keyed = ids.select("doc_id", "node", "keys").join(nodes, "node").where("doc_id <=> least")
    members = written(keyed.select("node", F.explode("keys").alias("key")).distinct(), "members")
    hubs = members.groupBy("key").agg(_drawn(0).alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", F.col("hub.node").alias("hub"))
    shared = written(members.join(hubs, "key").select("key", "node", "hub"), "buckets")
    # one row for each node: equal sets have equal sketches
    sketches = ids.select("node", "n_shingles", "sketch").join(shared.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    sketches = written(sketches, "sketches")
    keys_of = keyed.select("node", "keys").dropDuplicates(["node"])
    close = _near(percent, limit)

    def near(pairs: DataFrame) -> DataFrame:
        a = sketches.select(F.col("node").alias("u"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"))
        b = sketches.select(F.col("node").alias("v"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"))
        return pairs.join(a, "u").join(b, "v").where(close).select("u", "v")

    done: list[DataFrame] = [signed, members, shared, sketches]

    def kept(df: DataFrame, name: str) -> DataFrame:
        done.append(written(df, name))
        return done[-1]

    def sets_of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
        first = kept(nodes.join(wanted, "node", "left_semi").select("node", F.col("least").alias("id")), "wanted")
        sent = F.broadcast(first) if first.count() <= MOST_SENT else first
        found = texts.join(sent, F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "text")
        return kept(found.mapInArrow(_sets(words), "node long, grams array<long>").dropDuplicates(["node"]), "sets")

    def placed(roots: DataFrame) -> DataFrame:
        """Bucket rows with the node's root and whether the hub has another."""
        own = shared.join(roots, "node", "left").select("key", "node", "hub", F.coalesce("root", "node").alias("root"))
        of_hub = roots.select(F.col("node").alias("hub"), F.col("root").alias("hr"))
        return own.join(of_hub, "hub", "left").select("key", "node", "hub", "root", (F.col("root") != F.coalesce("hr", "hub")).alias("apart"))

    tried = kept(near(_ordered(shared.where("node <> hub").where(_early()), "node", "hub")), "pairs")
    edges = kept(_confirmed(tried, sets_of(tried), percent), "links")
    roots = kept(connected_components(edges), "roots")

    now = kept(placed(roots), "placed")
    open_keys = now.where("apart").select("key").distinct()
    draws = [_drawn(i).alias(f"h{i}") for i in range(MORE_HUBS + 1)]
    more = now.join(open_keys, "key", "left_semi").groupBy("key").agg(*draws)
    more = more.select("key", F.explode(F.array_distinct(F.array(*[f"h{i}.node" for i in range(MORE_HUBS + 1)]))).alias("hub"))
    askers = now.where("apart").select("key", F.col("node").alias("u"), F.when(_early(), F.col("hub")).alias("met_hub")).join(sketches.select(F.col("node").alias("u"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na")), "u")
    drawn = more.join(sketches.select(F.col("node").alias("hub"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb")), "hub").withColumnRenamed("hub", "v")
    met = _ordered(askers.join(drawn, "key").where("u <> v and not (v <=> met_hub)").where(close), "u", "v")
    met = kept(met.join(tried, ["u", "v"], "left_anti"), "pairs")
    if not met.isEmpty():
        edges = kept(edges.union(_confirmed(met, sets_of(met), percent)), "links")
        tried = tried.union(met)
        roots = kept(connected_components(edges), "roots")

    now = kept(placed(roots), "placed")
    now = now.join(now.where("apart").select("key").distinct(), "key", "left_semi").join(sketches, "node")
    now = kept(now.join(keys_of, "node"), "placed")
    apart = now.where("apart").select("key", F.col("node").alias("u"), F.col("root").alias("ru"), F.col("sketch").alias("sa"), F.col("n_shingles").alias("na"), F.col("keys").alias("ka"))
    others = now.select("key", F.col("node").alias("v"), F.col("root").alias("rv"), F.col("sketch").alias("sb"), F.col("n_shingles").alias("nb"), F.col("keys").alias("kb"), F.col("apart").alias("va"))
    # a pair meets in the first bucket that both its nodes are in
    first = F.array_intersect("ka", "kb")[0] == F.col("key")
    rest = apart.join(others, "key").where("ru <> rv and (not va or u < v)").where(close & first)
    rest = kept(_ordered(rest, "u", "v").join(tried, ["u", "v"], "left_anti"), "rest")
    if not rest.isEmpty():
        roots = kept(connected_components(edges.union(_confirmed(rest, sets_of(rest), percent))), "roots")

    least = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    groups = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(groups, "root").select("node", "component_id")
    some = ids.select("doc_id", "n_shingles", "node").join(named, "node").select("doc_id", "n_shingles", "component_id")
    none = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    result = written(some.union(none).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")), "classes")
    forget(*done)
    return result


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id is not kept by :func:`near_duplicates`, all columns as they are.

    An id stays if one of its rows is kept, and then once; rows without an id stay.
    """
    found = near_duplicates(docs, words, percent, id_col, text_col)
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    gone = written(ids.where("not kept").select(F.col("doc_id").alias("_gone")), "gone")
    sent = F.broadcast(gone) if gone.count() <= MOST_SENT else gone
    left = docs.join(sent, F.col(f"`{id_col}`").cast("long") == F.col("_gone"), "left_anti")
    if ids.where("kept and n > 1").isEmpty():
        return left
    named = left.where(F.col(f"`{id_col}`").isNotNull()).dropDuplicates([id_col])
    return named.unionByName(left.where(F.col(f"`{id_col}`").isNull()))
