"""Column expressions for text: normalisation, hashing, answers, phrases, actions.

All are built-in expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The pattern of a capitalised phrase and the words it may not start with.  The same as
#: ``\bW(?:\s+W)*\b``, whose repeated group takes a stack frame a word in Java and ends the executor at 2,000 words.
_WORD = r"[A-Z][A-Za-zÀ-ÖØ-öø-ÿ'’-]*"
_PHRASE = rf"\b(?:{_WORD}\s+(?={_WORD}\b))*+{_WORD}\b"
STOP_STARTS = ("Are", "Is", "Was", "Were", "Who", "What", "Where", "When", "Which", "The", "A", "An")
#: Words that stand for a country in the allowed text.
DEMONYMS = {"canada": ("canadian",), "america": ("american",), "united states": ("american",), "france": ("french",), "germany": ("german",), "england": ("english", "british"), "russia": ("russian",), "portugal": ("portuguese",)}
#: Label terms that must not appear in trajectories.
LEAK_TERMS = ("gold", "gold answer", "gold supporting facts", "supervised trajectory", "completed from")
#: Words of attribute questions.
ATTRIBUTE_WORDS = ("born", "birth", "where", "when", "located", "location", "founded", "founder", "died", "death", "nationality", "capital", "date", "year")
#: Parts of validation errors and the reason each stands for, in order.
REASONS = (
    ("unseen intermediate", "unseen_intermediate_query"), ("final_answer", "missing_or_unsupported_final_answer"), ("supported final answer", "missing_or_unsupported_final_answer"), ("retrieval_count", "state_leakage"), ("retrieval_history", "state_leakage"), ("state.evidence", "state_leakage"),
    ("top_k", "top_k_mismatch"), ("passage_id", "invalid_passage_selection"), ("rank", "invalid_passage_selection"), ("forbidden", "forbidden_training_label_text"), ("final answer is not supported", "missing_or_unsupported_final_answer"),
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def normalize_text(x: Column | str) -> Column:
    """White space runs to one space, ends trimmed (Unicode white space)."""
    return F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))


def casefold(x: Column | str) -> Column:
    return F.replace(F.lower(col(x)), F.lit("ß"), F.lit("ss"))


def normalize_key(x: Column | str) -> Column:
    return casefold(normalize_text(x))


def normalized_or_null(x: Column | str) -> Column:
    return F.nullif(normalize_text(x), F.lit(""))


def doc_id(dataset: Column | str, title: Column | str, text: Column | str) -> Column:
    """Content-addressed id: dataset:sha1 of the folded title and the text."""
    body = F.concat_ws(" ", casefold(F.coalesce(col(title), F.lit(""))), normalize_text(F.coalesce(col(text), F.lit(""))))
    return F.concat(col(dataset), F.lit(":"), F.sha1(normalize_text(body)))


def hash_id(namespace: str, x: Column | str) -> Column:
    return F.concat(F.lit(f"{namespace}-"), F.md5(col(x)))


def lines(x: Column | str) -> Column:
    """Non-blank lines, trimmed."""
    return F.filter(F.transform(F.split(col(x), "\n"), strip), lambda s: s != "")


def title_of(x: Column | str) -> Column:
    parts = lines(x)
    return F.when(F.size(parts) > 1, parts[0]).otherwise("")


def body_of(x: Column | str) -> Column:
    parts = lines(x)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.size(parts)), " ")).otherwise(F.coalesce(F.get(parts, F.lit(0)), F.lit("")))


def sentences(x: Column | str) -> Column:
    """Sentences split after . ! ?, trimmed, blanks dropped; a text that is not blank has at least one."""
    return normal_sentences(normalize_text(x))


def normal_sentences(x: Column | str) -> Column:
    """:func:`sentences` of a text whose white space is normalised already."""
    # trim by a lambda: as a bare function it would take the element's index as the characters to trim
    parts = F.filter(F.transform(F.split(col(x), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "\\]^-[&" else c for c in chars) + "]"


def normalize_answer(x: Column | str) -> Column:
    """Evaluation form: lower case, punctuation deleted, articles dropped, white space collapsed."""
    bare = F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), _class(PUNCTUATION), "")
    return normalize_text(F.regexp_replace(bare, r"\b(a|an|the)\b", " "))


def normalize_reward(x: Column | str) -> Column:
    """Reward form: as :func:`normalize_answer`, with punctuation turned into spaces."""
    bare = F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), _class(PUNCTUATION), " ")
    return normalize_text(F.regexp_replace(bare, r"\b(a|an|the)\b", " "))


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda t: t != "")


def overlap(p: Column, g: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    return F.aggregate(F.array_distinct(p), F.lit(0), lambda s, t: s + F.least(F.size(F.filter(p, lambda x: x == t)), F.size(F.filter(g, lambda x: x == t))))


def _f1(p: Column, g: Column) -> Column:
    both = overlap(p, g)
    return F.when(both == 0, 0.0).otherwise(2.0 * both / (F.size(p) + F.size(g)))


def token_f1(pred: Column | str, gold: Column | str) -> Column:
    """Evaluation F1: 0 if either side is empty."""
    p, g = tokens(normalize_answer(pred)), tokens(normalize_answer(gold))
    return F.when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(_f1(p, g))


def reward_f1(pred: Column | str, gold: Column | str) -> Column:
    """Reward F1: 1 if both sides are empty, 0 if one is."""
    p, g = tokens(normalize_reward(pred)), tokens(normalize_reward(gold))
    return F.when((F.size(p) == 0) & (F.size(g) == 0), 1.0).when((F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(_f1(p, g))


def best_reward_f1(pred: Column | str, golds: Column) -> Column:
    """Largest F1 over the gold answer and its aliases, 0 without any."""
    return F.coalesce(F.array_max(F.transform(golds, lambda g: reward_f1(pred, g))), F.lit(0.0))


def _blank(x: Column | str) -> Column:
    return F.coalesce(strip(x), F.lit("")) == ""


def contain_match(pred: Column | str, gold: Column | str) -> Column:
    """1 if either normalised answer contains the other; blank inputs give 0."""
    p, g = normalize_answer(pred), normalize_answer(gold)
    return F.when(_blank(pred) | _blank(gold), 0.0).when(F.contains(p, g) | F.contains(g, p), 1.0).otherwise(0.0)


def contain_one_way(pred: Column | str, gold: Column | str) -> Column:
    return F.contains(normalize_answer(pred), normalize_answer(gold)).cast("int")


def exact_match(pred: Column | str, gold: Column | str) -> Column:
    return F.when(_blank(pred) | _blank(gold), 0.0).when(normalize_answer(pred) == normalize_answer(gold), 1.0).otherwise(0.0)


def alias_match(pred: Column | str, golds: Column) -> Column:
    """Predicted answer equals one of the non-empty golds after folding."""
    p = normalize_key(F.coalesce(col(pred), F.lit("")))
    return (p != "") & F.array_contains(F.transform(golds, lambda g: normalize_key(g)), p)


def capitalized_phrases(x: Column | str) -> Column:
    """Runs of capitalised words without leading stop words."""
    found = F.regexp_extract_all(col(x), F.lit(_PHRASE), F.lit(0))
    lead = "^(?:(?:" + "|".join(STOP_STARTS) + r")(?:\s+|$))++"
    return F.filter(F.transform(found, lambda p: strip(F.regexp_replace(p, lead, ""))), lambda p: p != "")


def comparison_entities(x: Column | str) -> Column:
    """Phrases of three or more characters, unique by normalised form, first spelling kept."""
    marked = F.filter(F.transform(capitalized_phrases(x), lambda p, i: F.struct(normalize_key(p).alias("key"), i.alias("pos"), p.alias("phrase"))), lambda m: F.length(m["key"]) >= 3)
    # sorted by key and place, the first of each key stays; the array is bound by a lambda so that it is made once
    first = F.transform(F.array(F.array_sort(marked)), lambda s: F.filter(s, lambda m, i: (i == 0) | (m["key"] != F.get(s, i - 1)["key"])))[0]
    return F.transform(F.array_sort(F.transform(first, lambda m: F.struct(m["pos"], m["phrase"]))), lambda m: m["phrase"])


def has_unseen_term(query: Column | str, allowed: Column | str) -> Column:
    """A phrase of the query is neither in the allowed text nor a country one of whose words is."""
    seen = normalize_key(allowed)

    def alias_ok(p: Column) -> Column:
        known = [(p == F.lit(country)) & F.contains(seen, F.lit(word)) for country, words in DEMONYMS.items() for word in words]
        return F.array_contains(F.array(*known), True)

    return F.exists(capitalized_phrases(query), lambda p: ~F.contains(seen, normalize_key(p)) & ~alias_ok(normalize_key(p)))


def first_words(x: Column | str, n: int = 6) -> Column:
    return F.array_join(F.slice(F.split(strip(x), r"\s+"), 1, n), " ")


def strict_bool(x: Column | str) -> Column:
    """true/1/yes and false/0/no in any case; anything else is an error."""
    v = F.lower(strip(col(x).cast("string")))
    return F.when(v.isin("true", "1", "yes"), True).when(v.isin("false", "0", "no"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(v, F.lit("null")))).cast("boolean"))


def safe_name(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"[^\p{L}\p{N}_.-]", "_")


def leaks(x: Column | str, terms: tuple[str, ...] = LEAK_TERMS) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.lower(col(x)), t))


def occurrences(text: Column | str, part: Column | str) -> Column:
    """Non-overlapping occurrences of a literal; 0 for an empty one."""
    t, p = col(text), col(part)
    return F.when(F.length(p) == 0, 0).otherwise(((F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.length(p)).cast("int"))


def any_keyword(x: Column | str, keywords: tuple[str, ...] = ATTRIBUTE_WORDS) -> Column:
    return F.arrays_overlap(F.regexp_extract_all(F.lower(col(x)), F.lit(r"\w+"), F.lit(0)), F.array(*[F.lit(k) for k in keywords]))


def shared_keywords(a: Column | str, b: Column | str, keywords: tuple[str, ...] = ATTRIBUTE_WORDS) -> Column:
    return F.size(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.lower(col(a)), k) & F.contains(F.lower(col(b)), k)))


def fenced_json(x: Column | str) -> Column:
    """The JSON inside a code fence that spans the whole string, else the string."""
    return F.regexp_replace(strip(x), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1")


def tag_payload(x: Column | str, tag: str) -> Column:
    """Text of the first <tag>...</tag>, null if there is none."""
    return F.nullif(F.regexp_extract(col(x), rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", 1), F.lit(""))


def kind_of(payload: Column, field: str) -> Column:
    """JSON type of a top-level field as a variant schema name; null where it is absent or the JSON is bad."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), f"$.{field}", "variant"))


def can_answer(payload: Column) -> Column:
    """Boolean, or the strings true/false in any case; null otherwise."""
    kind, text = kind_of(payload, "can_answer"), F.lower(F.trim(F.get_json_object(payload, "$.can_answer")))
    return F.when((kind == "BOOLEAN") | (kind == "STRING"), F.when(text == "true", True).when(text == "false", False))


def filter_reason(error: Column | str) -> Column:
    """The reason of the first part that a validation error contains."""
    names = [F.when(F.contains(col(error), F.lit(part)), name) for part, name in REASONS]
    return F.coalesce(*names, F.lit("validation_error"))
