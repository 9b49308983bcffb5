"""Column expressions shared by the operators. Everything here stays on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode-aware engines see it; Java's own \s is ASCII only.
WS = r"[\s\u0085\u001c-\u001f\p{Z}]"
HANGUL = r"[\u1100-\u11ff\u3130-\u318f\uac00-\ud7a3]"
CJK = r"[\u1100-\u11ff\u3040-\u30ff\u3130-\u318f\u3400-\u9fff\uac00-\ud7a3\uf900-\ufaff]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_round(c: Column | str) -> Column:
    """Round half towards +infinity."""
    return F.floor(col(c) + F.lit(0.5))


def half_even(c: Column | str, scale: int = 0) -> Column:
    return F.bround(col(c), scale)


def trim_ws(c: Column | str) -> Column:
    """Trim every kind of white space, not only U+0020."""
    return F.regexp_replace(col(c), f"^{WS}+|{WS}+$", "")


def is_blank(c: Column | str) -> Column:
    return trim_ws(c) == ""


def ext_of(name: Column | str) -> Column:
    """Text after the last dot in lower case, '' without a dot."""
    n = col(name)
    return F.when(F.contains(n, F.lit(".")), F.lower(F.substring_index(n, ".", -1))).otherwise(F.lit(""))


def stem_of(name: Column | str) -> Column:
    n = col(name)
    return F.when(F.contains(n, F.lit(".")), F.regexp_replace(n, r"\.[^.]*\z", "")).otherwise(n)


def str_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for kv in d.items() for v in kv])


def list_map(d: dict[str, list[str]]) -> Column:
    args = []
    for k, v in d.items():
        args += [F.lit(k), F.array(*[F.lit(x) for x in v])]
    return F.create_map(*args)


def lookup(m: Column, key: Column | str) -> Column:
    """Null-safe map access: null for an unknown or null key."""
    return F.try_element_at(m, col(key))


def str_array(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items]) if items else F.array().cast("array<string>")


def first_rule(key: Column, rules: list[tuple[str, str]], default: Column) -> Column:
    """Value of the first pattern that matches; one CASE expression, no join."""
    out = None
    for pattern, value in rules:
        cond = key.rlike(pattern)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(default) if out is not None else default


def ordered_concat(value: str, order: str, sep: str = "") -> Column:
    """Aggregate: concatenate `value` in `order` (SQL fragments)."""
    quoted = sep.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return F.expr(f"listagg({value}, '{quoted}') within group (order by {order})")


def overlap(lo1, hi1, lo2, hi2) -> Column:
    """Length of the common part of two intervals (negative when apart)."""
    return F.least(col(hi1), col(hi2)) - F.greatest(col(lo1), col(lo2))


def double_text(d: Column) -> Column:
    """A double in the shortest form that most tools print: plain digits from 1e-6 up to 1e21, else with an exponent."""
    mantissa, e = F.substring_index(F.abs(d).cast("string"), "E", 1), F.substring_index(F.abs(d).cast("string"), "E", -1)
    has_e = F.contains(d.cast("string"), F.lit("E"))
    plain = F.regexp_replace(mantissa, r"\.0$", "")
    digits = F.replace(plain, F.lit("."), F.lit(""))
    n, x = F.length(digits), e.try_cast("int")
    whole = F.when(n <= x + 1, F.rpad(digits, x + 1, "0")).otherwise(
        F.concat(F.substring(digits, F.lit(1), x + 1), F.lit("."), F.substring(digits, x + 2, n)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -x - 1), digits)
    far = F.concat(plain, F.lit("e"), F.when(x > 0, F.lit("+")).otherwise(F.lit("")), x.cast("string"))
    text = F.when(~has_e, plain).when(x >= 21, far).when(x >= 0, whole).when(x >= -6, small).otherwise(far)
    return F.when(d < 0, F.concat(F.lit("-"), text)).otherwise(text)
