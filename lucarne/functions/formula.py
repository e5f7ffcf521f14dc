"""Formula text to a Spark Column (EXP-10): a thin adapter over Python's expression grammar."""

from __future__ import annotations

import ast
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lucarne.functions import arithmetic

FUNCTIONS = ("ABS", "ROUND", "SQRT", "LOG", "LN", "EXP")


def _with_placeholders(text: str, columns: Sequence[str]) -> str:
    """Replace every way of naming a column by ``_0``, ``_1``... so that Python can read the text."""
    index = {c: i for i, c in enumerate(columns)}
    bare = "|".join(re.escape(c) for c in sorted(columns, key=len, reverse=True))
    pattern = re.compile(
        r"""f\[(?P<q>['"])(?P<ref>.*?)(?P=q)\]"""
        r"""|(?P<p>['"])(?P<quoted>.*?)(?P=p)"""
        rf"""|(?P<call>\b(?i:{'|'.join(FUNCTIONS)})\b)(?=\s*\()"""
        + (rf"""|(?P<bare>(?<!\w)(?:{bare})(?!\w))""" if bare else "")
        + r"""|(?P<number>\d[\d.]*|\.\d[\d.]*)|(?P<word>[^\W\d]\w*)""",
    )

    def swap(m: re.Match) -> str:
        found = m.groupdict()
        name = next((found[g] for g in ("ref", "quoted", "bare") if found.get(g) is not None), None)
        if name is not None:
            if name not in index:
                raise ValueError(f"unknown column {name!r}")
            return f" _{index[name]} "
        if found["word"] is not None and found["word"].upper() not in FUNCTIONS:
            raise ValueError(f"unknown name {found['word']!r}")
        return m.group(0)

    return pattern.sub(swap, text)


class _Reader:
    def __init__(self, source: str, columns: Sequence[str]):
        self.source, self.columns = source, columns

    def column(self, node: ast.expr) -> Column:
        if isinstance(node, ast.BinOp):
            if isinstance(node.op, ast.Pow):
                return self._powers(node)
            left, right = self.column(node.left), self.column(node.right)
            if isinstance(node.op, ast.Add):
                return left + right
            if isinstance(node.op, ast.Sub):
                return left - right
            if isinstance(node.op, ast.Mult):
                return left * right
            if isinstance(node.op, ast.Div):
                return arithmetic.divide(left, right)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            inner = node.operand
            if self._bare_power(inner, node.col_offset + 1):
                return self._powers(inner, negative=True)    # the sign binds tighter than **
            return -self.column(inner)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            return arithmetic.operand(F.col("`" + self.columns[int(node.id[1:])].replace("`", "``") + "`"))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.args and not node.keywords:
            return self._call(node.func.id.upper(), node.args)
        raise ValueError("only + - * / **, numbers, columns and the known functions may be used")

    def _bare_power(self, node: ast.expr, start: int) -> bool:
        """A power written without parentheses of its own, beginning at or after ``start``."""
        is_power = isinstance(node, ast.BinOp) and isinstance(node.op, ast.Pow)
        return is_power and "(" not in self.source[start:node.col_offset]

    def _powers(self, node: ast.BinOp, negative: bool = False) -> Column:
        """A chain of ``**`` from left to right, where Python would go right to left."""
        result = self.column(node.left)
        if negative:
            result = -result
        while self._bare_power(node.right, node.left.end_col_offset):
            # What stands between the two operands is "**", blanks and closing parentheses.
            node = node.right
            result = F.pow(result, self.column(node.left))
        return self._power_of(result, node.right, node.left.end_col_offset)

    def _power_of(self, base: Column, exponent: ast.expr, start: int) -> Column:
        # 2 ** -x ** 3: the sign belongs to x alone, the chain goes on after it.
        bare = "(" not in self.source[start:exponent.col_offset]
        if bare and isinstance(exponent, ast.UnaryOp) and isinstance(exponent.op, ast.USub):
            inner = exponent.operand
            if self._bare_power(inner, exponent.col_offset + 1):
                signed = ast.UnaryOp(op=ast.USub(), operand=inner.left, col_offset=exponent.col_offset)
                base = F.pow(base, self.column(signed))
                while self._bare_power(inner.right, inner.left.end_col_offset):
                    inner = inner.right
                    base = F.pow(base, self.column(inner.left))
                return self._power_of(base, inner.right, inner.left.end_col_offset)
        return F.pow(base, self.column(exponent))

    def _call(self, name: str, args: list[ast.expr]) -> Column:
        x = self.column(args[0])
        literal = args[1].value if len(args) > 1 and isinstance(args[1], ast.Constant) else None
        if name == "ABS":
            return F.abs(x)
        if name == "EXP":
            return F.exp(x)
        if name == "SQRT":
            return F.sqrt(x)
        if name == "LN":
            return arithmetic.natural_log(x)
        if name == "LOG":
            return arithmetic.log_base(x, float(literal) if literal is not None else 10.0)
        if name == "ROUND":
            return arithmetic.round_half_even(x, int(literal) if literal is not None else 0)
        raise ValueError(f"unknown function {name}")


def formula(text: str, columns: Sequence[str]) -> Column:
    """``Price * Qty``, ``f['unit price'] / 2``, ``ROUND("a" ** 2, 1)``... as a Column of doubles."""
    if not text.strip():
        raise ValueError("empty formula")
    source = _with_placeholders(text.strip(), columns).strip()
    if re.search(r"[^\w\s.+\-*/(),]", source) or "//" in source:
        raise ValueError("unexpected character in formula")
    try:
        tree = ast.parse(source, mode="eval")
    except SyntaxError as error:
        raise ValueError(f"the formula cannot be read: {error.msg}") from None
    return _Reader(source, columns).column(tree.body)
