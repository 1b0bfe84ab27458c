"""Removal of passages that start earlier in the corpus, found by difference-cover anchors.

Positions 0, 1, 3 modulo 7 form a difference cover: for any two positions some shift under 7
moves both onto cover positions at once.  So if a window of ``width`` words occurs at two
places, some anchor of ``width - 6`` words inside it begins at a cover position at both of
them.  Hence:

1. anchors are hashed at cover positions only (3 of 7) and dealt out by hash; an anchor met
   at two different places is repeated;
2. only windows that hold a repeated anchor in their first 7 starts are extended: their
   whole word sequence is hashed and dealt out; every place but the first is a repeat;
3. the words under repeats are removed from the text.

Texts with one and the same word sequence count as one content, whose first document holds
all its first places; anchors and windows travel as packed arrays, one row for each batch and
bucket, and a batch sends only one place of a hash on, so a frequent passage costs one entry
for each batch.  A window hash has 64 bits besides the bits that deal it out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm.common import prepare, written
from hopframe.llm.textcore import U64, blocks, mix, window_hashes

PERIOD = 7
COVER = (0, 1, 3)
#: words of input for each bucket that anchors or windows are dealt into
BUCKET_WORDS = 2_000_000
BUCKETS = (64, 65_536)
LAST = (1 << 63) - 1
_ANCHOR = np.dtype([("h", "<u4"), ("p", "<u4"), ("d", "<u2"), ("r", "u1")])
_WINDOW = np.dtype([("h", "<u8"), ("p", "<u4"), ("d", "<u2")])


def _sequence_name(words: np.ndarray) -> int:
    return int(window_hashes(words, np.zeros(1, np.int64), len(words)).view(np.int64)[0]) if len(words) else 0


def _packed(bucket: np.ndarray, entries: np.ndarray, ids: np.ndarray):
    """One (bucket, ids, body) for each bucket; ids are the batch's document names.

    A body holds its fields one after the other, by document and place, which compresses well.
    """
    order = np.lexsort((entries["p"], entries["d"], bucket))
    bucket, entries = bucket[order], entries[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for b, part in zip(bucket[np.concatenate([[0], cuts])] if len(bucket) else [], np.split(entries, cuts)):
        used, local = np.unique(part["d"], return_inverse=True)
        part = part.copy()
        part["d"] = local
        yield int(b), ids[used].tobytes(), b"".join(part[f].tobytes() for f in part.dtype.names)


def _unpacked(body, dtype) -> np.ndarray:
    n = len(body) // dtype.itemsize
    part, at = np.empty(n, dtype), 0
    for f in dtype.names:
        part[f] = np.frombuffer(body, dtype[f], n, at)
        at += n * dtype[f].itemsize
    return part


def _gathered(batches, dtype, settled):
    """(ids of entries, entries) for each bucket of a partition sorted by bucket; rows that batches
    settled by themselves go to ``settled`` in batches of their own."""
    at, ids, parts = None, [], []
    for batch in batches:
        own = pc.is_valid(batch.column("name"))
        done = batch.filter(own)
        if done.num_rows:
            settled.append(pa.RecordBatch.from_arrays([done.column("name"), done.column("places")], names=["name", "places"]))
        batch = batch.filter(pc.invert(own))
        for b, i, body in zip(batch.column("bucket").to_pylist(), batch.column("ids"), batch.column("body")):
            if b != at and parts:
                yield np.concatenate(ids), np.concatenate(parts)
                ids, parts = [], []
            at = b
            part = _unpacked(body.as_buffer(), dtype)
            ids.append(np.frombuffer(i.as_buffer(), np.int64)[part["d"]])
            parts.append(part)
        if not parts:
            yield np.zeros(0, np.int64), np.zeros(0, dtype)
    if parts:
        yield np.concatenate(ids), np.concatenate(parts)


def _groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index of each run of equal keys, and for each element its run's first index."""
    new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
    first = np.flatnonzero(new)
    return first, first[np.cumsum(new) - 1]


def _contents(batches):
    """(doc_id, n_words, content, sha) of every text."""
    for batch in batches:
        n_words, names, shas = [], [], []
        for block in blocks(batch.column("text")):
            hashes = block.word_hashes()
            for d in range(block.n):
                a, b = block.words[d], block.words[d + 1]
                n_words.append(int(b - a))
                names.append(_sequence_name(hashes[a:b]))
                shas.append(hashlib.sha256(b" ".join(block.text_of(d).split())).hexdigest())
        if names:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(names, pa.int64()), pa.array(shas)], names=["doc_id", "n_words", "content", "sha"])


def _anchors(width: int, buckets: int):
    length = width - PERIOD + 1
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def run(batches):
        for batch in batches:
            found, names, local = [], [], []
            for block in blocks(batch.column("text")):
                hashes = block.word_hashes()
                sizes = np.diff(block.words)
                first, ptr = block.window_starts(length)
                doc = np.repeat(np.arange(block.n), np.diff(ptr))
                pos = np.arange(len(first)) - ptr[doc]
                keep = cover[pos % PERIOD] & (sizes[doc] >= width)
                found.append((window_hashes(hashes, first[keep], length), pos[keep], doc[keep] + block.lo))
                names += [_sequence_name(hashes[block.words[d] : block.words[d + 1]]) for d in range(block.n)]
            if not found:
                continue
            names = np.array(names, np.int64)
            h, p, d = (np.concatenate([f[i] for f in found]) for i in range(3))
            order = np.lexsort((p, names[d], h))
            h, p, d = h[order], p[order], d[order]
            if not len(h):
                continue
            same = np.concatenate([[False], (h[1:] == h[:-1]) & (p[1:] == p[:-1]) & (names[d][1:] == names[d][:-1])])
            h, p, d = h[~same], p[~same], d[~same]
            head, of = _groups(h)
            lone = np.diff(np.concatenate([head, [len(h)]])) == 1
            sent = np.zeros(len(head), _ANCHOR)
            sent["h"], sent["p"], sent["d"], sent["r"] = (h[head] & U64(0xFFFFFFFF)), p[head], d[head], ~lone
            rows = [(b, i, x, None, None) for b, i, x in _packed(((h[head] >> U64(32)) % U64(buckets)).astype(np.int64), sent, names)]
            rest = of != np.arange(len(h))
            d, p = d[rest], p[rest].astype("<u4")
            order = np.argsort(d, kind="stable")
            d, p = d[order], p[order]
            cuts = np.flatnonzero(np.diff(d)) + 1
            rows += [(int(names[x] % buckets), None, None, int(names[x]), part.tobytes()) for x, part in zip(d[np.concatenate([[0], cuts])] if len(d) else [], np.split(p, cuts))]
            yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "ids", "body", "name", "places"), r)) for r in rows], schema=pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("body", pa.binary()), ("name", pa.int64()), ("places", pa.binary())]))

    return run


def _by_name(names: np.ndarray, places: np.ndarray):
    order = np.argsort(names, kind="stable")
    names, places = names[order], places[order]
    cuts = np.flatnonzero(np.diff(names)) + 1
    heads = names[np.concatenate([[0], cuts])] if len(names) else names
    return pa.RecordBatch.from_arrays([pa.array(heads, pa.int64()), pa.array([x.tobytes() for x in np.split(places, cuts)] if len(names) else [], pa.binary())], names=["name", "places"])


def _repeated_anchors(batches):
    settled: list = []
    for names, entries in _gathered(batches, _ANCHOR, settled):
        yield from settled
        settled.clear()
        if not len(names):
            continue
        order = np.argsort(entries["h"], kind="stable")
        names, entries = names[order], entries[order]
        head, of = _groups(entries["h"])
        differs = (names != names[of]) | (entries["p"] != entries["p"][of]) | (entries["r"] > 0)
        hit = np.logical_or.reduceat(differs, head)[np.searchsorted(head, of)]
        yield _by_name(names[hit], entries["p"][hit].astype("<u4"))
    yield from settled


def _places(cell) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, "<u4") for x in cell]).astype(np.int64) if cell else np.zeros(0, np.int64)


def _windows(width: int, buckets: int):
    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column("key"))
            places = batch.column("places").to_pylist()
            found = []
            for block in blocks(batch.column("text")):
                hashes = block.word_hashes()
                for d in range(block.n):
                    a, n = block.words[d], block.words[d + 1] - block.words[d]
                    if n < width:
                        continue
                    marks = np.zeros(n + 2, np.int64)
                    at = _places(places[block.lo + d])
                    np.add.at(marks, np.maximum(at - PERIOD + 1, 0), 1)
                    np.add.at(marks, np.minimum(at + 1, n + 1), -1)
                    start = np.flatnonzero(np.cumsum(marks)[: n - width + 1] > 0)
                    found.append((window_hashes(hashes[a : a + n], start, width), start, np.full(len(start), block.lo + d)))
            if not found:
                continue
            h, p, d = (np.concatenate([f[i] for f in found]) for i in range(3))
            order = np.lexsort((p, ids[d], h))
            h, p, d = h[order], p[order], d[order]
            if not len(h):
                continue
            head, of = _groups(h)
            sent = np.zeros(len(head), _WINDOW)
            sent["h"], sent["p"], sent["d"] = h[head], p[head], d[head]
            deal = mix(h[head] ^ U64(0x2545F4914F6CDD1D)) % U64(buckets)
            rows = [(b, i, x, None, None) for b, i, x in _packed(deal.astype(np.int64), sent, ids)]
            # a place of the same document and start is the same place, not a later one
            rest = (of != np.arange(len(h))) & ~((ids[d] == ids[d[of]]) & (p == p[of]))
            later = _by_name(ids[d[rest]], p[rest].astype("<u4"))
            rows += [(x["name"] % buckets, None, None, x["name"], x["places"]) for x in later.to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "ids", "body", "name", "places"), r)) for r in rows], schema=pa.schema([("bucket", pa.int32()), ("ids", pa.binary()), ("body", pa.binary()), ("name", pa.int64()), ("places", pa.binary())]))

    return run


def _later_windows(batches):
    settled: list = []
    for ids, entries in _gathered(batches, _WINDOW, settled):
        yield from settled
        settled.clear()
        if not len(ids):
            continue
        order = np.lexsort((entries["p"], ids, entries["h"]))
        ids, entries = ids[order], entries[order]
        _, of = _groups(entries["h"])
        later = (ids != ids[of]) | (entries["p"] != entries["p"][of])
        yield _by_name(ids[later], entries["p"][later].astype("<u4"))
    yield from settled


def _removed(width: int):
    def run(batches):
        for batch in batches:
            places = batch.column("places").to_pylist()
            counts, shas, texts = [], [], []
            for block in blocks(batch.column("text")):
                for d in range(block.n):
                    words = block.text_of(d).split()
                    marks = np.zeros(len(words) + 1, np.int64)
                    at = _places(places[block.lo + d])
                    np.add.at(marks, at, 1)
                    np.add.at(marks, np.minimum(at + width, len(words)), -1)
                    gone = np.cumsum(marks)[:-1] > 0
                    text = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                    counts.append(int(gone.sum()))
                    shas.append(hashlib.sha256(text).hexdigest())
                    texts.append(text.decode())
            if counts:
                yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(counts, pa.int64()), pa.array(shas), pa.array(texts)], names=["content", "gone", "rest_sha", "rest"])

    return run


_SENT = "bucket int, ids binary, body binary, name long, places binary"


def _dealt(sent: DataFrame, reduce) -> DataFrame:
    """(name, places) of all hits, from the buckets and from what the batches settled by themselves."""
    n = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(reduce, "name long, places binary")
    return met.groupBy("name").agg(F.collect_list("places").alias("places"))


def drop_repeated_passages(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for each row of ``docs``; ``kept_text`` too if asked for.

    Each word under a window of ``width`` words whose sequence starts earlier (smaller id, or
    same id and earlier start) is removed.  Null and empty texts have no words.  Null ids come
    last and count as one document, as do rows that share an id; rows equal in id and text get
    equal results.  Only the kept words, joined by one space, are hashed.
    """
    spark = docs.sparkSession
    prepare(spark)
    if width < PERIOD:
        raise ValueError(f"width must be at least {PERIOD}")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    base = written(texts.mapInArrow(_contents, "doc_id long, n_words long, content long, sha string"), "contents")
    total = base.agg(F.sum("n_words")).first()[0] or 0
    buckets = min(max(total // BUCKET_WORDS, BUCKETS[0]), BUCKETS[1])
    key = F.coalesce("doc_id", F.lit(LAST))
    firsts = base.where(F.col("n_words") >= width).groupBy("content").agg(F.min(key).alias("key"))

    sent = texts.select("text").mapInArrow(_anchors(width, buckets), _SENT)
    flags = _dealt(sent, _repeated_anchors).withColumnRenamed("name", "content")
    wanted = flags.join(firsts, "content")
    found = texts.select(key.alias("key"), "text").join(wanted, "key").select("key", "content", "places", "text")
    # rows that share an id may hold other contents, which have places of their own
    if not base.groupBy(key.alias("key")).agg(F.count_distinct("content").alias("n")).where("n > 1").isEmpty():
        found = found.join(base.select(key.alias("key"), "content", F.col("sha").alias("text_sha")).distinct(), ["key", "content"]).where(F.sha2(F.trim(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " ")), 256) == F.col("text_sha")).drop("text_sha")
    work = written(found.dropDuplicates(["key", "content"]), "passages")
    windows = work.select("key", "text", "places").mapInArrow(_windows(width, buckets), _SENT)
    later = _dealt(windows, _later_windows).withColumnRenamed("name", "key")
    left = work.select("key", "content", "text").join(later, "key").mapInArrow(_removed(width), "content long, gone long, rest_sha string, rest string")
    left = written(left if with_text else left.drop("rest"), "kept")

    placed = base.join(firsts, "content", "left").join(left, "content", "left")
    copy = F.coalesce(key > F.col("key"), F.lit(False))
    none = F.sha2(F.lit(""), 256)
    result = placed.select("doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"), F.when(copy, none).otherwise(F.coalesce("rest_sha", "sha")).alias("kept_sha256"), *(["content", copy.alias("copy"), "rest", F.col("sha").alias("text_sha")] if with_text else []))
    if not with_text:
        return result
    plain = F.trim(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+", " "))
    whole = texts.select("doc_id", plain.alias("plain")).withColumn("text_sha", F.sha2("plain", 256)).distinct()
    same = result["doc_id"].eqNullSafe(whole["doc_id"]) & (result["text_sha"] == whole["text_sha"])
    return result.join(whole, same).select(result["doc_id"], "n_words", "n_removed", "kept_sha256", F.when(F.col("copy"), "").otherwise(F.coalesce("rest", "plain")).alias("kept_text"))
