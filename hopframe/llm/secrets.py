"""Secret scans: trigram postings choose the texts that each rule's pattern is run on."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hopframe.llm.common import prepare
from hopframe.llm.textcore import LOWER, blocks
from hopframe.llm.trigrams import TRUE, answer, code, named, postings, trigram_query


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key")
#: Fixed values: (kind, pattern, group whose length counts, its least length); the first three are the base.
RULES = (
    ("assign", rf"({_KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 1),
    ("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 1),
    ("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/=-]{20,}", 0, 1),
    ("url_login", r"[a-z]+://[^\s/:@]+:[^\s/:@]+@[a-z0-9.-]+", 0, 1),
)
BASE = 3


def rule_spans(rule: tuple, compiled: re.Pattern, raw: bytes) -> list[tuple[int, int]]:
    """Byte spans of a rule's leftmost non-overlapping matches that are long enough."""
    _, _, group, least = rule
    return [m.span() for m in compiled.finditer(raw) if m.end(group) - m.start(group) >= least]


def _points(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    if raw.isascii():
        return spans
    where = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(where[a]), int(where[b])) for a, b in spans]


def _masked(raw: bytes, spans: list[tuple[int, int]], mask: bytes) -> bytes:
    out, at = [], 0
    for a, b in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [raw[at:a], mask]
        at = max(at, b)
    return b"".join([*out, raw[at:]])


def _scanner(mask: str | None):
    rules = [(i, r, trigram_query(r[1])) for i, r in enumerate(RULES)]
    wanted_codes = sorted({code(g) for _, _, q in rules for g in named(q)})

    def run(batches):
        compiled = [re.compile(r[1].encode()) for _, r, _ in rules]
        wanted = np.zeros(1 << 24, bool)
        wanted[wanted_codes] = True
        for batch in batches:
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "masked")}
            for block in blocks(batch.column("text")):
                index = postings(LOWER[block.data], block.offsets, wanted)
                found: dict[int, list] = {}
                for i, rule, query in rules:
                    for d in (range(block.n) if query == TRUE else answer(query, index, block.n).tolist()):
                        raw = block.text_of(d)
                        if spans := rule_spans(rule, compiled[i], raw):
                            found.setdefault(d, []).extend((a, i, b) for a, b in spans)
                for d in range(block.n):
                    hits = sorted(found.get(d, ()))
                    raw = block.text_of(d) if hits or mask is not None else b""
                    spans = _points(raw, [(a, b) for a, _, b in hits])
                    named_spans = [(i, f"{RULES[i][0]}:{a}:{b}") for (_, i, _), (a, b) in zip(hits, spans)]
                    for i, k in enumerate(("n_assign", "n_access", "n_hex")):
                        out[k].append(sum(x == i for x, _ in named_spans))
                    out["base_sha256"].append(hashlib.sha256(",".join(s for i, s in named_spans if i < BASE).encode()).hexdigest())
                    out["spans"].append(",".join(s for _, s in named_spans))
                    out["masked"].append(_masked(raw, [(a, b) for a, _, b in hits], mask.encode()).decode() if mask is not None else None)
            if out["spans"]:
                yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(out[k], pa.int64()) for k in ("n_assign", "n_access", "n_hex")), pa.array(out["base_sha256"]), pa.array(out["spans"]), pa.array(out["masked"], pa.string())], names=["row", *out])

    return run


_SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, masked string"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` for each row of ``docs``.

    Null texts count as empty; a text without secrets has empty spans and the digest of the
    empty string.  Spans are code points, the end exclusive, by start and then by rule order.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.mapInArrow(_scanner(None), f"row long, {_SCHEMA}").drop("masked").withColumnRenamed("row", "doc_id")


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", length_col: str | None = None) -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mask``; all other columns and rows as they are.

    Overlapping spans are masked as one.  A null text stays null.  ``length_col``, if given, is
    set to the code points of each text that was masked.
    """
    prepare(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([packed.schema["row"], *T.StructType.fromDDL(_SCHEMA)])
    scanned = packed.mapInArrow(_scanner(mask), schema)
    text = F.when(F.col(f"row.`{text_col}`").isNotNull(), F.col("masked"))

    def column(c: str):
        if c == text_col:
            return text
        own = F.col(f"row.`{c}`")
        return F.when(F.col("spans") != "", F.length("masked").cast(docs.schema[c].dataType)).otherwise(own) if c == length_col else own

    return scanned.select(*[column(c).alias(c) for c in docs.columns])
