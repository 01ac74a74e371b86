"""Scalar functions: text, HTML, JSON paths, dates, arithmetic, hashes, and the ``column op value`` mini-language."""

from __future__ import annotations

import ast
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import semantics as S

# Separators and stop words of the text featuriser.
SEPARATORS = " \t\n\r.,;:!?\"()-/"
STOP_WORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "is", "it", "for", "on", "with", "this", "that", "yang", "dan", "di", "ke", "dari", "untuk", "dengan", "ini", "itu", "pada", "adalah", "atau")
FILTER_SIGNS = (">=", "<=", "!=", "=", ">", "<", " contains ")


def parse_number(text: object) -> float | None:
    """A literal as a number by the rules of ``semantics.text_to_number``."""
    s = str(text if text is not None else "").strip()
    if re.fullmatch(r"\(\s*[\d.,]+\s*\)", s):
        s = "-" + s[1:-1].strip()
    if not re.fullmatch(r"[+-]?(\d[\d,]*\.?\d*|\.\d+)([eE][+-]?\d+)?", s):
        return None
    return float(s.replace(",", ""))


def contains_text(c: Column, value: str) -> Column:
    """Case-insensitive contains; null holds only the empty text."""
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(value.lower()))


def words(c: Column, remove_stop_words: bool = True) -> Column:
    """Lower-case words between separators, without stop words."""
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), "[" + re.escape(SEPARATORS) + "]+")
    stop = F.array(*map(F.lit, STOP_WORDS))
    keep = lambda w: (w != "") & ~F.array_contains(stop, w) if remove_stop_words else w != ""
    return F.filter(parts, keep)


def word_grams(c: Column, longest: int, remove_stop_words: bool = True) -> Column:
    """All runs of 1 to ``longest`` words, joined by underscores; single words first."""
    w = words(c, remove_stop_words)

    def of(n: int) -> Column:
        last = F.size(w) - n + 1
        starts = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: i <= last)
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), "_"))

    return F.flatten(F.array(w, *[of(n) for n in range(2, min(max(longest, 1), 5) + 1)]))


def char_grams(c: Column, n: int) -> Column:
    """All runs of ``n`` characters of the lower-case text."""
    t = F.lower(F.coalesce(c, F.lit("")))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: i <= F.length(t) - n + 1)
    return F.transform(starts, lambda i: F.substring(t, i, F.lit(n)))


def fill_template(df: DataFrame, template: str) -> Column:
    """``{{column}}`` replaced by the row's rendered values, in column order; null gives the empty text."""
    out = F.lit(template)
    for f in df.schema.fields:
        if "{{" + f.name + "}}" in template or "}}" in template:
            out = F.replace(out, F.lit("{{" + f.name + "}}"), S.key(f))
    return out


def slug(c: Column) -> Column:
    """Lower case, runs of other than letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def identifier(c: Column) -> Column:
    """Other than letters, digits and underscores as underscores; never empty, never begins with a digit."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9_]", "_")
    return F.when(s == "", F.lit("column")).when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)


def truncated(c: Column, limit: int) -> Column:
    """The first ``limit`` characters, with a note of how many there were if more."""
    n = F.length(c)
    return F.when(n > limit, F.concat(F.left(c, F.lit(limit)), F.lit("\n... ("), n.cast("string"), F.lit(" characters in all)"))).otherwise(c)


def visible_text(html: Column, limit: int = 12000) -> Column:
    """A page's visible text: no scripts, styles, navigation or footers, entities read, lines trimmed, short ones dropped."""
    s = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->", "")
    for tag in ("script", "style", "nav", "footer"):
        s = F.regexp_replace(s, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    s = F.regexp_replace(s, r"(?s)<[^>]+>", "")
    for entity, text in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(text))
    lines = F.filter(F.transform(F.split(s, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) > 1)
    return truncated(F.array_join(lines, "\n"), limit)


def json_path(c: Column, path: str) -> Column:
    """A dotted path with array indices (``a.b.0.c``) in JSON text, as text."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.replace("[", ".").replace("]", "").split(".") if p)
    return F.get_json_object(c, "$" + steps)


def days_between(first: Column, second: Column) -> Column:
    return F.datediff(second, first)


def now_in(zone: str | Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.current_timestamp().cast("timestamp_ntz"))


def to_ole_date(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(86400e6) + 25569


def sha256_hex(c: Column) -> Column:
    return F.upper(F.sha2(c, 256))


_ALLOWED = (ast.Expression, ast.BinOp, ast.UnaryOp, ast.Constant, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Mod, ast.Pow, ast.USub, ast.UAdd)


def arithmetic(expression: str) -> Column:
    """A numeric expression of ``+ - * / % ^`` and parentheses as a constant column; anything else raises."""
    tree = ast.parse(expression.replace("^", "**"), mode="eval")
    for node in ast.walk(tree):
        if not isinstance(node, _ALLOWED) or isinstance(node, ast.Constant) and not isinstance(node.value, (int, float)):
            raise ValueError(f"'{expression}' is not a numeric expression.")

    def build(n: ast.AST) -> Column:
        if isinstance(n, ast.Constant):
            return F.lit(float(n.value))
        if isinstance(n, ast.UnaryOp):
            return -build(n.operand) if isinstance(n.op, ast.USub) else build(n.operand)
        a, b = build(n.left), build(n.right)
        return {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: F.try_divide(a, b), ast.Mod: lambda: F.try_mod(a, b), ast.Pow: lambda: F.pow(a, b)}[type(n.op)]()

    return build(tree.body)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def log2(c: Column) -> Column:
    return F.log2(c)


def parse_filter(text: str) -> tuple[str, str, str] | None:
    """``column op value`` by the first sign found in a fixed order."""
    for sign in FILTER_SIGNS:
        at = text.lower().find(sign)
        if at > 0:
            return text[:at].strip(), sign.strip(), text[at + len(sign) :].strip()
    return None


def filter_condition(df: DataFrame, text: str) -> Column:
    """The mini-language's condition: an unknown column is false, orderings of text are equality, null is the empty text."""
    parsed = parse_filter(text)
    if parsed is None:
        return F.lit(True)
    name, sign, value = parsed
    f = S.field(df, name)
    if f is None:
        return F.lit(False)
    cell, wanted = S.key(f), parse_number(value)
    same = F.lower(cell) == F.lit(value.lower())
    as_text = {"!=": ~same, "contains": F.contains(F.lower(cell), F.lit(value.lower()))}.get(sign, same)
    if wanted is None or not math.isfinite(wanted):
        return as_text
    n = S.to_number(f)
    near = F.abs(n - wanted) < 1e-9
    compared = {">": n > wanted, ">=": n >= wanted, "<": n < wanted, "<=": n <= wanted, "!=": F.abs(n - wanted) > 1e-9}.get(sign, near)
    return F.when(n.isNotNull(), compared).otherwise(as_text)
