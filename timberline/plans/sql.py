"""Small builders for the SQL used in the result checks."""

from __future__ import annotations

from timberline import constants as K


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items: list[str]) -> str:
    return "[" + ", ".join(q(w) for w in items) + "]"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def subs(x: str, rules: list[tuple[str, str]]) -> str:
    for pattern, to in rules:
        x = sub(x, pattern, to)
    return x


def hits(x: str, items: list[str]) -> str:
    """List of the words contained in x."""
    return f"list_filter({words(items)}, lambda w: contains({x}, w))"


def any_of(x: str, items: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, {q(w)})" for w in items) + ")"


def case_map(x: str, table: dict, default: str) -> str:
    arms = " ".join(
        f"when {q(k)} then {q(v) if isinstance(v, str) else f'{v}::double'}" for k, v in table.items())
    return f"(case {x} {arms} else {default} end)"


def strip(x: str) -> str:
    return sub(x, r"^\s+|\s+$", "")


def squeeze(x: str) -> str:
    return f"trim({sub(x, r'\s+', ' ')})"


def template(x: str) -> str:
    y = subs(strip(x), K.TEMPLATE_RULES)
    y = sub(y, r"((?:<\w+>)+)\s+(?:<\w+>\s*)+|((?:<\w+>){2,})\s*", r"\1\2 ")
    return squeeze(y)


def bucket(ts: str, minutes: int) -> str:
    return f"(date_trunc('hour', {ts}) + to_minutes(cast(floor(minute({ts}) / {minutes}) * {minutes} as bigint)))"


def rank(x: str) -> str:
    return f"(case {x} when 'CRITICAL' then 3 when 'HIGH' then 2 when 'MEDIUM' then 1 else 0 end)"


def clamp(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"
