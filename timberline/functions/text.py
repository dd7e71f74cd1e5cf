"""Column expressions over raw lines and messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from timberline import constants as K


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace_all(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Apply regex replacements in order."""
    return reduce(lambda acc, rule: F.regexp_replace(acc, F.lit(rule[0]), F.lit(rule[1])), rules, c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Split on whitespace and join with single spaces."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def lit_array(words: list[str]) -> Column:
    # split of a constant folds to one literal and keeps plan building short
    return F.split(F.lit("\x1f".join(words)), "\x1f")


def contains_any(c: Column, words: list[str]) -> Column:
    """Does the (already lower-cased) text contain one of the words?"""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def matched_words(c: Column, words: list[str]) -> Column:
    """The words contained in the text, in list order, joined by U+001F; empty if there are none.

    No lambda over an array: those are interpreted, and would make the text anew for every word.
    """
    return F.concat_ws("\x1f", *[F.when(F.contains(c, F.lit(w)), F.lit(w)) for w in words])


def count_words(c: Column, words: list[str]) -> Column:
    """How many of the words the text contains."""
    return reduce(lambda a, b: a + b, [F.when(F.contains(c, F.lit(w)), 1).otherwise(0) for w in words])


def strip_ansi(c: str | Column) -> Column:
    return F.regexp_replace(col(c), K.ANSI, "")


def normalize_line(c: str | Column) -> Column:
    """Drop ANSI codes, tabs to spaces, squeeze runs of spaces, strip."""
    spaced = F.translate(strip_ansi(c), "\t", " ")
    return strip(F.regexp_replace(spaced, "  +", " "))


def is_continuation(c: str | Column) -> Column:
    """Indented, and what follows the indent does not open with a timestamp."""
    text = col(c)
    return text.rlike(r"^\s") & ~F.regexp_replace(text, r"^\s+", "").rlike(K.ENTRY_START)


def clip(c: str | Column, n: int) -> Column:
    return F.substring(col(c), 1, n)


def truncate(c: str | Column, n: int) -> Column:
    """At most n characters, the cut marked by three dots."""
    text = col(c)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(clip(text, n - 3), F.lit("...")))


def first_ip(c: str | Column) -> Column:
    return blank_to_null(F.regexp_extract(col(c), K.IPV4, 0))


def all_ips(c: str | Column) -> Column:
    """Distinct IPv4-shaped tokens, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col(c), F.lit(K.IPV4), F.lit(0))))


def error_code(c: str | Column) -> Column:
    return blank_to_null(F.regexp_extract(col(c), K.ERROR_CODE, 1))


def error_tokens(c: str | Column) -> Column:
    """Code-like tokens, sorted; bare 3+ digit numbers count only beside such a token."""
    text = col(c)
    tokens = F.regexp_extract_all(text, F.lit(K.ERROR_TOKEN), F.lit(0))
    numbers = F.regexp_extract_all(text, F.lit(K.NUMERIC_CODE), F.lit(0))
    found = F.when(F.size(tokens) > 0, F.array_union(tokens, numbers)).otherwise(tokens)
    return F.array_sort(F.array_distinct(found))


def semantic_tags(*parts: str | Column) -> Column:
    text = F.lower(F.concat_ws(" ", *[blank_to_null(col(p)) for p in parts]))
    tags = [F.when(contains_any(text, words), F.lit(tag)) for tag, words in K.SEMANTIC_TAGS.items()]
    return F.array_compact(F.array(*tags))


def error_category(c: str | Column) -> Column:
    text = F.lower(F.coalesce(col(c), F.lit("")))
    out = F
    for name, words in K.ERROR_CATEGORIES.items():
        out = out.when(contains_any(text, words), F.lit(name))
    return out.otherwise(F.lit("other"))


def extract_template(c: str | Column) -> Column:
    """Replace the variable parts of a message by placeholders, collapsing runs of them."""
    return squeeze(collapse_placeholders(replace_all(strip(col(c)), K.TEMPLATE_RULES)))


def collapse_placeholders(text: Column) -> Column:
    """A run of placeholders keeps its first whitespace-free chunk."""
    return F.regexp_replace(text, r"((?:<\w+>)+)\s+(?:<\w+>\s*)+|((?:<\w+>){2,})\s*", "$1$2 ")


def cluster_text(c: str | Column) -> Column:
    return replace_all(strip(F.lower(col(c))), K.CLUSTER_RULES)


def line_signature(c: str | Column, with_hex: bool = True) -> Column:
    rules = K.SIGNATURE_RULES + ([K.SIGNATURE_HEX] if with_hex else [])
    text = replace_all(col(c), rules)
    return strip(text) if with_hex else text


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def lookup(c: Column, table: dict[str, object]) -> Column:
    """A literal map lookup, null for an unknown key."""
    text = "\x1e".join(f"{k}\x1f{v}" for k, v in table.items())
    found = F.try_element_at(F.str_to_map(F.lit(text), F.lit("\x1e"), F.lit("\x1f")), c)
    sample = next(iter(table.values()))
    return found if isinstance(sample, str) else found.cast("int" if isinstance(sample, int) else "double")


def severity_rank(c: str | Column) -> Column:
    return F.coalesce(lookup(col(c), K.SEVERITY_RANK), F.lit(0))


def severity_name(rank: Column) -> Column:
    return F.element_at(lit_array(list(K.SEVERITY_RANK)), rank + 1)
