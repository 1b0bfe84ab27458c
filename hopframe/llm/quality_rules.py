"""Quality verdicts from distribution divergence.

Every whole text gives base counts, a histogram of character classes and a histogram of the
common words of its language.  References are the mean histograms of each language over all
texts of the corpus that pass the base rules and are long enough.  A text is rejected when
the Jensen-Shannon distance (square root of the base-2 divergence, 0 to 1) of a histogram
from its reference exceeds a limit; texts shorter than a guard are judged by the base alone.
The limit of the word test is a share of the distance that a text without any common word
has, and its guard is the length at which the reference expects enough common words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopframe.llm.common import prepare, written
from hopframe.llm.textcore import BYTE_CODES, SPACE, blocks, list_array, span_hashes, window_hashes

#: Frequent function words of each language.
COMMON = {
    "en": "the of and to a in is it that was for on are as with his they be at this have from or one had by but not what all were we when your can said there an which you".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus sie nach wird bei einer um am sind noch wie einem über".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son aux d'une ou ses mais comme on lui nous vous".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me".split(),
}
LANGS = tuple(COMMON)
OTHER = "other"
#: Character classes by byte, then two for letters beyond ASCII.
CLASSES = ("vowel", "consonant", "upper", "digit", "space", "line", "stop", "quote", "symbol", "mark", "control", "latin", "wide")
SYMBOLS = b"#*$%&|<>"


def _class_table() -> np.ndarray:
    table = np.full(256, CLASSES.index("control"), np.uint8)
    for name, members in (("mark", bytes(range(33, 127))), ("consonant", bytes(range(97, 123))), ("vowel", b"aeiou"), ("upper", bytes(range(65, 91))), ("digit", b"0123456789"), ("space", b" \t"), ("line", b"\n\r"), ("stop", b".,;:?!"), ("quote", b"'\"()-"), ("symbol", SYMBOLS)):
        table[list(members)] = CLASSES.index(name)
    table[0x80:0xC0] = len(CLASSES)  # inside a code point: not counted
    table[0xC0:0xE0] = CLASSES.index("latin")
    table[0xE0:] = CLASSES.index("wide")
    return table


CLASS_OF = _class_table()


def _word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(raw, np.zeros(1, np.int64), np.array([len(raw)]), BYTE_CODES)[0])


def _common_table() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all common words, and which word each is (words of several languages count once)."""
    words = sorted({w for ws in COMMON.values() for w in ws})
    hashes = np.array([_word_hash(w) for w in words], np.uint64)
    order = np.argsort(hashes)
    return hashes[order], order


ALL_WORDS = sorted({w for ws in COMMON.values() for w in ws})
OF_LANG = {lang: np.array([ALL_WORDS.index(w) for w in dict.fromkeys(ws)]) for lang, ws in COMMON.items()}


def _repeated_words(grams: np.ndarray, n_words: int, width: int) -> int:
    """Words under windows that occur at least twice in the text."""
    if len(grams) < 2:
        return 0
    _, of, counts = np.unique(grams, return_inverse=True, return_counts=True)
    marks = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(counts[of] > 1)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + width, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def _duplicate_lines(block) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    breaks = np.flatnonzero(block.data == 10)
    starts = np.sort(np.concatenate([block.offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, block.offsets[1:]]))
    starts = np.minimum(starts, ends)
    doc = np.searchsorted(block.offsets[1:], ends, "left")
    worded = np.searchsorted(block.starts, ends) > np.searchsorted(block.starts, starts)
    hashes, doc = span_hashes(block.data, starts, ends)[worded], doc[worded]
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    again = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    return np.bincount(doc[1:][again], minlength=block.n)[: block.n]


def _features(batches):
    common, which = _common_table()
    n_classes, n_common = len(CLASSES), len(ALL_WORDS)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    for batch in batches:
        cols: list[list] = [[] for _ in range(7)]
        for block in blocks(batch.column("text")):
            offsets, words = block.offsets, block.words
            chars = np.concatenate([[0], np.cumsum(block.is_word & ((block.data & 0xC0) != 0x80))])
            marks = np.concatenate([[0], np.cumsum(symbol[block.data])])
            exact = block.word_hashes()
            lower = block.word_hashes(lower=True)
            first, ptr = block.window_starts(3)
            grams = window_hashes(exact, first, 3)
            slot = np.minimum(np.searchsorted(common, lower), len(common) - 1)
            bins = np.where(common[slot] == lower, which[slot], n_common)
            classes = CLASS_OF[block.data]
            cols[0].append(np.diff(words))
            cols[1].append(chars[offsets[1:]] - chars[offsets[:-1]])
            cols[2].append(marks[offsets[1:]] - marks[offsets[:-1]])
            cols[3].append(_duplicate_lines(block))
            cols[4].append([_repeated_words(grams[ptr[d] : ptr[d + 1]], int(words[d + 1] - words[d]), 3) for d in range(block.n)])
            cols[5] += [np.bincount(classes[offsets[d] : offsets[d + 1]], minlength=n_classes + 1)[:n_classes] for d in range(block.n)]
            cols[6] += [np.bincount(bins[words[d] : words[d + 1]], minlength=n_common + 1) for d in range(block.n)]
        if cols[0]:
            counts = [pa.array(np.concatenate(c), pa.int64()) for c in cols[:5]]
            steps = np.arange(batch.num_rows + 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *counts, list_array(np.concatenate(cols[5]).astype(np.int32), steps * n_classes), list_array(np.concatenate(cols[6]).astype(np.int32), steps * (n_common + 1))], names=["doc_id", "lang", *_COUNTS, "classes", "common"])


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FEATURES = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", classes array<int>, common array<int>"
_SCALE = 1_000_000


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.float64)


def _in_lang(common: np.ndarray, lang: str) -> np.ndarray:
    """Histogram over the language's own common words and all other words."""
    own = common[:, OF_LANG[lang]]
    return np.concatenate([own, common.sum(axis=1, keepdims=True) - own.sum(axis=1, keepdims=True)], axis=1)


def _base_failed(n_words, n_repeat):
    return (n_words < 50) | (100 * n_repeat > 50 * n_words)


def _reference_parts(min_words: int):
    def run(batches):
        for batch in batches:
            n_words, repeat = np.asarray(batch.column("n_words")), np.asarray(batch.column("n_repeat_words"))
            usable = ~_base_failed(n_words, repeat) & (n_words >= min_words)
            langs = np.array([x if x in COMMON else OTHER for x in batch.column("lang").to_pylist()], object)
            classes, common = _shares(_matrix(batch.column("classes"))), _matrix(batch.column("common"))
            rows = []
            for lang in (*LANGS, OTHER):
                here = usable & (langs == lang)
                if here.any():
                    parts = [("class", classes[here])] + ([("word", _shares(_in_lang(common[here], lang)))] if lang in COMMON else [])
                    for kind, shares in parts:
                        sums = np.rint(shares * _SCALE).astype(np.int64).sum(axis=0)
                        rows += [(lang, kind, i, int(v)) for i, v in enumerate(sums)]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(("lang", "kind", "bin", "total"), r)) for r in rows], schema=pa.schema([("lang", pa.string()), ("kind", pa.string()), ("bin", pa.int32()), ("total", pa.int64())]))

    return run


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p from the distribution q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def wordless_distance(ref: np.ndarray) -> float:
    """Distance of a text without any common word from a word reference, whose last bin is all other words."""
    return float(js_distance(np.eye(len(ref))[-1:], ref)[0])


def _verdicts(refs: dict, min_words: int, class_limit: float, word_share: float, least_common: float):
    def run(batches):
        for batch in batches:
            n_words, repeat = np.asarray(batch.column("n_words")), np.asarray(batch.column("n_repeat_words"))
            failed = _base_failed(n_words, repeat)
            langs = np.array([x if x in COMMON else OTHER for x in batch.column("lang").to_pylist()], object)
            classes, common = _shares(_matrix(batch.column("classes"))), _matrix(batch.column("common"))
            d_class, d_word, strange = np.zeros(len(n_words)), np.zeros(len(n_words)), np.zeros(len(n_words), bool)
            for lang in (*LANGS, OTHER):
                here = langs == lang
                if here.any() and (lang, "class") in refs:
                    d_class[here] = js_distance(classes[here], refs[lang, "class"])
                if here.any() and (lang, "word") in refs:
                    ref = refs[lang, "word"]
                    d_word[here] = js_distance(_shares(_in_lang(common[here], lang)), ref)
                    strange[here] = (d_word[here] > word_share * wordless_distance(ref)) & (n_words[here] * (1 - ref[-1]) >= least_common)
            judged = n_words >= min_words
            kept = ~failed & ~(judged & ((d_class > class_limit) | strange))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(batch.column(c) for c in _COUNTS), pa.array(failed), pa.array(d_class), pa.array(d_word), pa.array(kept)], names=["doc_id", *_COUNTS, "base_failed", "class_distance", "word_distance", "kept"])

    return run


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 50, class_limit: float = 0.28, word_share: float = 0.8, least_common: float = 22) -> DataFrame:
    """Base counts, base_failed, both distances and kept, one row per row of ``docs``.

    Null texts count as empty: no words, so base_failed.  Languages without a word list,
    null among them, share one character reference and skip the word test; a language none
    of whose texts is usable has no reference and its texts are judged by the base alone.
    Sums behind the references are whole numbers, so reruns agree.  The word test rejects
    above ``word_share`` of the distance of a text without common words, and judges texts in
    which the reference expects ``least_common`` common words (about 100 words of prose).
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    features = written(texts.mapInArrow(_features, _FEATURES), "features")
    parts = features.mapInArrow(_reference_parts(min_words), "lang string, kind string, bin int, total long")
    # at most one row for each language of the fixed list, kind and bin
    sums: dict = {}
    for r in parts.groupBy("lang", "kind", "bin").agg(F.sum("total").alias("total")).collect():
        sums.setdefault((r["lang"], r["kind"]), {})[r["bin"]] = r["total"]
    refs = {}
    for k, bins in sums.items():
        h = np.array([bins[i] for i in range(len(bins))], np.float64)
        refs[k] = h / max(h.sum(), 1)
    names = ", ".join(f"{c} long" for c in _COUNTS)
    return features.mapInArrow(_verdicts(refs, min_words, class_limit, word_share, least_common), f"doc_id long, {names}, base_failed boolean, class_distance double, word_distance double, kept boolean")
