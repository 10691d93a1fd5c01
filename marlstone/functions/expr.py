"""Table expressions compiled to Spark columns.

    rows_where(df, "age > 30 AND city LIKE 'N*'")

Cells are text that may look like a number, and cells of numeric columns have a
text side too: a comparison or ``+`` works on doubles where both sides are
numeric, else on strings where both are; any other mix is null in that row
(``strict=True`` makes it an error). ``LIKE``, ``HAS`` and ``IN`` look at texts. ``AND`` and
``OR`` have the same precedence and associate to the left, unlike SQL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

_TOKEN = re.compile(
    r"""\s*(?:(?P<string>'[^']*')|(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?(?![\w.#:]))
    |(?P<op>==|!=|<=|>=|~=|&&|\|\||[<>+\-*/^()])|(?P<name>[@$]?!?(?:[0-9A-Za-z_.\#:]+|"[^"]*")))""",
    re.X,
)
_WORDS = {"AND", "OR", "NOT", "LIKE", "HAS", "IN", "TRUE", "FALSE"}
_COMPARE = {"==", "!=", "<", "<=", ">", ">=", "LIKE", "~=", "HAS", "IN"}


class ExpressionError(ValueError):
    """A malformed expression, an unknown name or, under ``strict``, operands that do not fit."""


@dataclass
class Value:
    """An operand: its numeric side and its text side; a missing side is None.

    A ``typed`` operand is a cell of a numeric column: among such and numbers
    alone it never counts as text.
    """

    num: Column | None
    text: Column | None
    typed: bool = False


def tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            rest = source[at:].strip()
            raise ExpressionError("use == to compare" if rest.startswith("=") else f"illegal character at {rest[:12]!r}")
        kind = m.lastgroup
        text = m[kind]
        out.append(("op", text) if kind == "name" and text in _WORDS else (kind, text))
        at = m.end()
    return out


class _Compiler:
    def __init__(self, df: DataFrame, source: str, strict: bool):
        self.df, self.strict, self.tokens, self.at = df, strict, tokens(source), 0

    def peek(self) -> str | None:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)
        return text if kind == "op" else None

    def next(self) -> tuple[str, str]:
        if self.at == len(self.tokens):
            raise ExpressionError("operator lacks operand")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> Value:
        out = self.logic()
        if self.at < len(self.tokens):
            raise ExpressionError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def logic(self) -> Value:
        left = self.negated()
        while (op := self.peek()) in ("AND", "&&", "OR", "||"):
            self.next()
            x, y = self.truth(left, op), self.truth(self.negated(), op)
            left = _flag(x & y if op in ("AND", "&&") else x | y)
        return left

    def negated(self) -> Value:
        if self.peek() == "NOT":
            self.next()
            return _flag(~self.truth(self.negated(), "NOT"))
        return self.compared()

    def compared(self) -> Value:
        left = self.sum()
        while (op := self.peek()) in _COMPARE:
            self.next()
            left = self.compare(op, left, self.sum())
        return left

    def sum(self) -> Value:
        left = self.product()
        while (op := self.peek()) in ("+", "-"):
            self.next()
            right = self.product()
            if op == "+":
                left = self.either(left, right, lambda x, y: x + y, F.concat, "+")
            else:
                left = Value(self.number(left, op) - self.number(right, op), None)
        return left

    def product(self) -> Value:
        left = self.unary()
        while (op := self.peek()) in ("*", "/"):
            self.next()
            x, y = self.number(left, op), self.number(self.unary(), op)
            left = Value(x * y if op == "*" else ieee_divide(x, y), None)
        return left

    def unary(self) -> Value:
        if self.peek() == "-":
            self.next()
            return Value(-self.number(self.unary(), "-"), None)
        out = self.primary()
        if self.peek() == "^":
            raise ExpressionError("the operator ^ is not implemented")
        return out

    def primary(self) -> Value:
        kind, text = self.next()
        if kind == "number":
            return Value(F.lit(float(text)), None)
        if kind == "string":
            return Value(None, F.lit(text[1:-1]))
        if kind == "name":
            return _cell(self.df, self.resolve(text))
        if text in ("TRUE", "FALSE"):
            return Value(F.lit(float(text == "TRUE")), None)
        if text == "(":
            inner = self.logic()
            if self.peek() != ")":
                raise ExpressionError("missing )")
            self.next()
            return inner
        raise ExpressionError("operator lacks operand")

    def resolve(self, name: str) -> str:
        """``$name`` is a name, ``@n`` a position from 0, anything else a name first, then a position."""
        columns, plain = self.df.columns, name.lstrip("$@").strip('"')
        if name[0] != "@" and plain in columns:
            return plain
        if name[0] != "$" and plain.isdigit() and int(plain) < len(columns):
            return columns[int(plain)]
        raise ExpressionError(f"no column {name!r}")

    def truth(self, v: Value, op: str) -> Column:
        return self.number(v, op) != 0

    def number(self, v: Value, op: str) -> Column:
        if v.num is None:
            if self.strict:
                raise ExpressionError(f"incompatible types for {op}")
            return F.lit(None).cast("double")
        return self.checked(v.num, v.num.isNotNull(), op)

    def checked(self, x: Column, ok: Column, op: str) -> Column:
        return F.when(ok, x).otherwise(F.raise_error(F.lit(f"incompatible types for {op}"))) if self.strict else x

    def either(self, a: Value, b: Value, on_numbers, on_texts, op: str) -> Value:
        """Numbers where both sides are, else texts where both are; a side that is never text has no text case."""
        both_num = a.num is not None and b.num is not None
        both_text = a.text is not None and b.text is not None and not (a.typed and b.typed)
        if both_num and not both_text:
            out = Value(on_numbers(a.num, b.num), None)
        elif both_text and not both_num:
            out = Value(None, on_texts(a.text, b.text))
        elif both_num:
            numeric = a.num.isNotNull() & b.num.isNotNull()
            return Value(F.when(numeric, on_numbers(a.num, b.num)), F.when(~numeric, on_texts(a.text, b.text)))
        elif self.strict:
            raise ExpressionError(f"incompatible types for {op}")
        else:
            return Value(F.lit(None).cast("double"), None)
        if out.num is not None:
            return Value(self.checked(out.num, a.num.isNotNull() & b.num.isNotNull(), op), None)
        return out

    def compare(self, op: str, a: Value, b: Value) -> Value:
        if op in ("LIKE", "~=", "HAS", "IN"):
            if a.text is None or b.text is None:
                if self.strict:
                    raise ExpressionError(f"incompatible types for {op}")
                return Value(F.lit(None).cast("double"), None)
            x, y = a.text, b.text
            if op == "HAS":
                return _flag(F.contains(x, y))
            if op == "IN":
                return _flag(F.array_contains(F.split(y, r"\|"), x))
            return _flag(F.rlike(x, _glob(y)))
        test = {"==": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
        as_number = lambda x, y: test(x, y).cast("double")
        out = self.either(a, b, as_number, as_number, op)
        if out.num is not None and out.text is not None:
            return Value(F.coalesce(out.num, out.text), None)
        return Value(out.num if out.num is not None else out.text, None)


def _flag(c: Column) -> Value:
    return Value(c.cast("double"), None)


def _glob(pattern: Column) -> Column:
    """``*`` is any run, ``?`` any one character; everything else stands for itself."""
    quoted = F.regexp_replace(pattern, r"([\\.\[\]{}()+^$|])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def numeric_text(c: Column) -> Column:
    """The value of a text that is wholly a number, else null."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def ieee_divide(x: Column, y: Column) -> Column:
    """Floating division with infinities and NaN instead of an error."""
    by_zero = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(y == 0, F.when(x.isNotNull(), by_zero)).otherwise(x / F.when(y != 0, y))


def _cell(df: DataFrame, name: str) -> Value:
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.NumericType | T.BooleanType):
        return Value(c.cast("double"), F.coalesce(c.cast("string"), F.lit("")), typed=True)
    text = F.coalesce(c.cast("string"), F.lit(""))
    return Value(numeric_text(text), text)


def expression(df: DataFrame, source: str, strict: bool = False) -> Column:
    """The value of an expression over the columns of ``df``: a double, or a string for text results."""
    out = _Compiler(df, source, strict).whole()
    if out.num is not None and out.text is not None and not out.typed:
        return F.coalesce(out.text, out.num.cast("string"))
    return out.num if out.num is not None else out.text


def rows_where(df: DataFrame, source: str, strict: bool = False) -> DataFrame:
    """The rows for which the expression is true (not 0); null counts as false."""
    out = _Compiler(df, source, strict).whole()
    if out.num is None:
        raise ExpressionError("a condition must be a number")
    return df.where(out.num != 0)


def with_expression(df: DataFrame, name: str, source: str, strict: bool = False) -> DataFrame:
    return df.withColumn(name, expression(df, source, strict))


def columns_where(df: DataFrame, key: str, source: str) -> DataFrame:
    """The columns whose transposed row satisfies the expression; ``key`` holds the row names and always stays.

    Only the rows that the expression names are read: they are made long, one
    aggregate a column brings their values side by side, and the names of the
    columns that pass are all that is fetched. Of rows of one name the largest
    value counts. An expression that uses row positions (``@2``) has the whole
    table transposed, which is for few rows.
    """
    if "@" in source:
        turned = df.transpose(key)
        name = turned.columns[0]
    else:
        used = set(re.findall(r"[A-Za-z_][A-Za-z0-9_.]*", source)) | {x for pair in re.findall(r"\"([^\"]*)\"|'([^']*)'", source) for x in pair if x}
        some = df.where(F.col(f"`{key}`").cast("string").isin(*used))
        name = "_column"
        long = some.select(F.col(f"`{key}`").cast("string").alias("_row"), *(f"`{c}`" for c in df.columns if c != key)).unpivot(["_row"], [f"`{c}`" for c in df.columns if c != key], name, "_value")
        rows = sorted(r[0] for r in some.select(F.col(f"`{key}`").cast("string").alias("_row")).distinct().collect())  # no more than the expression names
        turned = long.groupBy(name).agg(*(F.max(F.when(F.col("_row") == r, F.col("_value"))).alias(r) for r in rows)) if rows else df.sparkSession.createDataFrame([(c,) for c in df.columns if c != key], f"{name} string")
    names = {r[0].strip("`") for r in rows_where(turned, source).select(name).collect()}
    return df.select(key, *(f"`{c}`" for c in df.columns if c in names))
