"""Text functions over columns: normalising, extraction, similarity, PII, SQL and intent scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# PII patterns (e-mail, US phone, SSN, card), SQL words.
PII_PATTERNS = [
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    r"\b\d{3}-\d{2}-\d{4}\b",
    r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14})\b",
]
SQL_WORDS = ["select", "insert", "update", "delete", "create", "alter", "drop", "with"]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normal(c: Column) -> Column:
    """Null to empty, white space at the ends off, lower case."""
    return F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))


def tokens(c: Column) -> Column:
    """Words between white space, repeats included."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(tokens(c))


def f1_of_sets(a: Column, b: Column) -> Column:
    """F1 of two token arrays taken as sets; 0 if either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | (both == 0), 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def token_f1(a: Column, b: Column) -> Column:
    return f1_of_sets(tokens(F.lower(F.coalesce(a, F.lit("")))), tokens(F.lower(F.coalesce(b, F.lit("")))))


def exact_match(output: Column, truth: Column) -> Column:
    o, t = normal(output), normal(truth)
    return ((t != "") & (o == t)).cast("double")


def contains_match(output: Column, truth: Column) -> Column:
    """Either contains the other; an empty output is contained in any truth, an empty truth matches nothing."""
    o, t = normal(output), normal(truth)
    return ((t != "") & (F.contains(o, t) | F.contains(t, o))).cast("double")


def legacy_verdict(legacy: Column, truth: Column) -> Column:
    """Of an earlier output: 'N/A' if it or the truth is null, else whether they are equal or one contains the other."""
    o, t = normal(legacy), normal(truth)
    same = (o == t) | F.contains(o, t) | F.contains(t, o)
    return F.when(legacy.isNull() | truth.isNull(), "N/A").when(same, "CORRECT").otherwise("INCORRECT")


def length_ratio(output: Column, truth: Column) -> Column:
    """Shorter over longer word count; without truth 1 for more than three words, else 0.5; blank 0."""
    o, t = word_count(output), word_count(truth)
    return F.when(o == 0, 0.0).when(t == 0, F.when(o > 3, 1.0).otherwise(0.5)).otherwise(F.least(o, t) / F.greatest(o, t))


def fenced(c: Column, language: str = "sql") -> Column:
    """The first fenced block, or the whole text; the SQL tag in any case, others as written."""
    flags = "(?is)" if language == "sql" else "(?s)"
    found = F.regexp_extract(c, rf"{flags}```(?:{language})?\s*\n(.*?)```", 1)
    return F.when(F.regexp_like(c, F.lit(rf"{flags}```(?:{language})?\s*\n.*?```")), found).otherwise(c)


def json_part(c: Column) -> Column:
    """The text if it is JSON, else its span from the first to the last brace if that is, else null."""
    span = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(c).isNotNull(), c).when(F.try_parse_json(span).isNotNull() & (span != ""), span)


def json_validity(c: Column) -> Column:
    """1 if the whole text is JSON, 0.8 if a span of it is, else 0."""
    part = json_part(c)
    return F.when(part.isNull() | (c == ""), 0.0).when(part == c, 1.0).otherwise(0.8)


def json_map(c: Column, whole: bool = False) -> Column:
    """The fields of an object; with ``whole`` a span of the text does not count."""
    part = F.when(F.try_parse_json(c).isNotNull(), c) if whole else json_part(c)
    return F.from_json(part, "map<string,string>")


def json_key_match(output: Column, truth: Column) -> Column:
    """Share of the truth's keys that the output has; 0 for none, for what is no object, and for a truth with other text around it."""
    keys = F.map_keys(json_map(truth, whole=True))
    n = F.size(keys)
    return F.when(n > 0, F.coalesce(F.size(F.array_intersect(keys, F.map_keys(json_map(output)))) / n, F.lit(0.0))).otherwise(0.0)


def json_value_match(output: Column, truth: Column) -> Column:
    """Share of the truth's keys whose normalised value the output repeats."""
    t, o = json_map(truth, whole=True), json_map(output)
    same = F.filter(F.map_keys(t), lambda k: F.array_contains(F.map_keys(o), k) & (normal(t[k]) == normal(o[k])))
    return F.when(F.size(t) > 0, F.coalesce(F.size(same), F.lit(0)) / F.size(t)).otherwise(0.0)


def sql_syntax(c: Column) -> Column:
    """0 if empty or without an SQL word, 1 if it begins with a statement, else 0.5."""
    low = F.lower(strip(F.regexp_replace(c, r"(?s)--[^\n]*|/\*.*?\*/", " ")))
    has = F.regexp_like(F.lower(c), F.lit("|".join(SQL_WORDS)))
    starts = F.regexp_like(low, F.lit(r"^\(*\s*(?:" + "|".join(SQL_WORDS) + r")\b"))
    return F.when((strip(c) == "") | ~has, 0.0).when(starts, 1.0).otherwise(0.5)


def sql_tokens(c: Column) -> Column:
    """Distinct tokens without comments; known words in upper case."""
    plain = F.regexp_replace(c, r"(?s)--[^\n]*|/\*.*?\*/", " ")
    words = SQL_WORDS + ["from", "where", "group", "by", "order", "having", "join", "left", "right", "inner", "on", "and", "or", "not", "as", "limit", "in", "is", "null"]
    return F.transform(tokens(plain), lambda x: F.when(F.lower(x).isin(words), F.upper(x)).otherwise(x))


def sql_similarity(output: Column, truth: Column) -> Column:
    return F.bround(f1_of_sets(sql_tokens(fenced(output)), sql_tokens(fenced(truth))), 3)


def pii_entities(c: Column) -> Column:
    """Distinct matches of the patterns; one is tried only on texts with what it cannot do without."""
    text, none = F.coalesce(c, F.lit("")), F.array().cast("array<string>")
    digits = F.regexp_like(text, F.lit(r"\d\d\d"))
    found = [F.when(F.contains(text, F.lit("@")) if i == 0 else digits, F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none) for i, p in enumerate(PII_PATTERNS)]
    return F.array_distinct(F.concat(*found))


def redaction(given: Column, output: Column, truth: Column) -> Column:
    """struct(precision, recall, f1, entities_found, leaked) of a redaction; null truth: all input entities are to go."""
    once = F.array(F.struct(pii_entities(given).alias("i"), pii_entities(output).alias("o"), pii_entities(truth).alias("t")))
    return F.get(F.transform(once, lambda x: _redaction(x["i"], x["o"], x["t"], truth)), F.lit(0))  # a struct of its own, so that each text is searched once


def _redaction(i: Column, o: Column, t: Column, truth: Column) -> Column:
    target = F.when(truth.isNull(), i).otherwise(F.array_except(i, t))
    extra = F.when(truth.isNull(), F.size(F.array_except(o, i))).otherwise(F.size(F.array_except(o, t)))
    tp, fn = F.size(F.array_except(target, o)), F.size(F.array_intersect(target, o))
    none = F.size(target) == 0
    recall = F.when(none | (tp + fn == 0), 1.0).otherwise(tp / F.greatest(tp + fn, F.lit(1)))
    precision = F.when(none, (extra == 0).cast("double")).when(tp + extra == 0, 1.0).otherwise(tp / F.greatest(tp + extra, F.lit(1)))
    f1 = F.when(none, precision).when(precision + recall > 0, 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-9))).otherwise(0.0)
    return F.struct(
        F.bround(precision, 3).alias("precision"), F.bround(recall, 3).alias("recall"), F.bround(f1, 3).alias("f1"),
        F.size(i).alias("entities_found"), F.when(none, 0).otherwise(fn).alias("leaked"),
    )


def ranked_intents(c: Column) -> Column:
    """A numbered list of two or more, else a list by comma or semicolon, else nothing; lower-cased."""
    numbered = F.regexp_extract_all(c, F.lit(r"(?m)^\s*\d+[.)]\s*(.+?)$"), F.lit(1))
    parts = F.split(strip(c), r",\s*|\s*;\s*")
    clean = lambda a: F.transform(a, lambda x: F.lower(strip(x)))
    listed = F.filter(clean(parts), lambda x: x != "")
    return F.when(F.size(numbered) >= 2, clean(numbered)).when(F.size(parts) >= 2, listed).otherwise(F.array().cast("array<string>"))


def precision_at(ranked: Column, truth: Column, k: int) -> Column:
    return F.array_contains(F.slice(ranked, 1, k), normal(truth)).cast("double")


def entity_id(c: Column) -> Column:
    """The number after store, negozio, id or farmacia in a question."""
    return F.regexp_extract(c, r"(?i)\b(?:store|negozio|id|farmacia)\s*(?:id\s*)?#?(\d+)\b", 1).try_cast("bigint")


def sanitised(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-zA-Z0-9_-]", "_")


def json_string_field(c: Column, key: str) -> Column:
    """One string field of JSON that may be cut off."""
    whole = F.get_json_object(F.when(F.try_parse_json(c).isNotNull(), c), f"$.{key}")
    return F.coalesce(whole, F.nullif(F.regexp_extract(c, rf'(?s)"{key}"\s*:\s*"(.*?)(?<!\\)"', 1), F.lit("")))


def json_string_list(c: Column, key: str) -> Column:
    """The complete strings of a list field of JSON that may be cut off."""
    body = F.regexp_extract(c, rf'(?s)"{key}"\s*:\s*\[([^\]]*)', 1)
    return F.regexp_extract_all(body, F.lit(r'(?s)"(.*?)(?<!\\)"'), F.lit(1))


def clamp_score(c: Column) -> Column:
    """A score given as text: the first JSON span's ``score`` between 0 and 1; 0 if unreadable."""
    value = F.get_json_object(json_part(c), "$.score").try_cast("double")
    return F.coalesce(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def replace_system(messages: Column, text: Column) -> Column:
    """Messages with their first system message's content replaced, or one put in front if there is none."""
    first = F.array_position(F.transform(messages, lambda m: m["role"]), "system")
    fresh = F.struct(F.lit("system").alias("role"), text.alias("content"))
    changed = F.transform(messages, lambda m, i: F.when(i + 1 == first, fresh).otherwise(m))
    return F.when(first > 0, changed).otherwise(F.concat(F.array(fresh), messages))
