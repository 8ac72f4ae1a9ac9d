"""Functions that no built-in expresses, as Arrow-batched pandas UDFs over plain functions (tested against brute force)."""

from __future__ import annotations

import ast
import io
import keyword
import tokenize
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.jsonfix import extract_queries


#: What the parser raises on code that isn't any, or that is nested too deeply.
UNREADABLE = (SyntaxError, ValueError, OverflowError, RecursionError, MemoryError)


def sequence_ratio(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp: twice the matched characters over all."""
    return SequenceMatcher(None, a or "", b or "").ratio()


def common_subsequence(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence, bit-parallel: a row of the table is one number with a bit for each place of the
    longer sequence, zero where the row rises, and an item of the shorter one advances it by an addition (64 places a word at a time)."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    places: dict = {}
    for i, x in enumerate(long):
        places.setdefault(x, []).append(i)
    wanted = set(short)
    masks = {}
    for x, at in places.items():
        if x in wanted:
            bits = bytearray(len(long) // 8 + 1)
            for i in at:
                bits[i >> 3] |= 1 << (i & 7)
            masks[x] = int.from_bytes(bits, "little")
    whole = (1 << len(long)) - 1
    row = whole
    for x in short:
        mask = masks.get(x)
        if mask:
            hit = row & mask
            row = (row + hit | row - hit) & whole
    return len(long) - row.bit_count()


def rouge_l(prediction: str | None, truth: str | None) -> float:
    """F of the longest common subsequence of words."""
    x, y = (prediction or "").split(), (truth or "").split()
    lcs = common_subsequence(x, y) if x and y else 0
    return 2 * lcs / (len(x) + len(y)) if lcs else 0.0


def fuzzy_first_line(prediction: str | None, truth: str | None) -> float:
    """Indel similarity in whole percent, over 100, with the first line free of backticks and comment signs."""
    line = next((x for x in (prediction or "").lstrip("\n").split("\n") if "`" not in x and "#" not in x and "//" not in x), "")
    a, b = line, truth or ""
    if not a and not b:
        return 1.0
    return round(200 * common_subsequence(a, b) / (len(a) + len(b))) / 100


def imported_names(code: str | None) -> list[str]:
    """``name=module.path`` of each import of the code, in order; none if it doesn't parse."""
    try:
        tree = ast.parse(code or "")
    except UNREADABLE:
        return []
    found = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found += [f"{a.asname or a.name}={a.name}" for a in node.names]
        elif isinstance(node, ast.ImportFrom) and node.module:
            found += [f"{a.asname or a.name}={node.module}.{a.name}" for a in node.names]
    return found


def resolve_api(code: str | None, name: str | None) -> str | None:
    """A dotted name with its first part replaced by what the code imports under it."""
    if not name:
        return None
    table = dict(x.split("=", 1) for x in imported_names(code))
    head, dot, rest = name.partition(".")
    return table.get(head, head) + dot + rest


def has_fstring(code: str | None) -> bool:
    try:
        return any(isinstance(node, ast.JoinedStr) for node in ast.walk(ast.parse(code or "")))
    except UNREADABLE:
        return False


def is_valid(code: str | None) -> bool:
    try:
        compile(code or "", "<code>", "exec", dont_inherit=True)
    except UNREADABLE:
        return False
    return True


def identifiers(code: str | None) -> list[str]:
    """Names that aren't keywords, in order, as far as the code can be cut into tokens."""
    found = []
    try:
        for token in tokenize.generate_tokens(io.StringIO(code or "").readline):
            if token.type == tokenize.NAME and not keyword.iskeyword(token.string):
                found.append(token.string)
    except (tokenize.TokenError, SyntaxError):
        pass
    return found


def _common_prefix(a, b) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def prefix_score(left: list, right: list) -> float:
    """The longest common prefix over all pairs, over the longer of that pair; the first of equals.

    Sorted neighbours share the longest prefixes, but the first pair of equals decides the divisor, so pairs are walked.
    """
    best, score = 0, 0.0
    for a in left:
        for b in right:
            n = _common_prefix(a, b)
            if n > best:
                best, score = n, n / max(len(a), len(b))
    return score


def identifier_prefix(prediction: str | None, truth: str | None) -> float:
    return prefix_score(list(dict.fromkeys(identifiers(prediction))), list(dict.fromkeys(identifiers(truth))))


def line_prefix(prediction: str | None, truth: str | None) -> float:
    lines = lambda code: list(dict.fromkeys(tuple(x.split()) for x in (code or "").split("\n") if x.strip()))
    return prefix_score(lines(prediction), lines(truth))


class _Unannotated(ast.NodeTransformer):
    def visit_FunctionDef(self, node):
        self.generic_visit(node)
        node.returns = None
        for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, node.args.vararg, node.args.kwarg):
            if a is not None:
                a.annotation = None
        return node

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_AnnAssign(self, node):
        self.generic_visit(node)
        return ast.Assign(targets=[node.target], value=node.value) if node.value is not None else ast.Pass()


def without_annotations(code: str | None) -> str:
    """The code without type annotations; as it is if it doesn't parse."""
    try:
        return ast.unparse(ast.fix_missing_locations(_Unannotated().visit(ast.parse(code or ""))))
    except UNREADABLE:
        return code or ""


def _udf(function, kind: T.DataType):
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([function(*row) for row in zip(*columns)], index=columns[0].index)

    if function.__code__.co_argcount == 1:
        return F.pandas_udf(lambda a: run(a), kind)
    return F.pandas_udf(lambda a, b: run(a, b), kind)


ratio = _udf(sequence_ratio, T.DoubleType())
rouge = _udf(rouge_l, T.DoubleType())
fuzzy = _udf(fuzzy_first_line, T.DoubleType())
imports = _udf(imported_names, T.ArrayType(T.StringType()))
resolved = _udf(resolve_api, T.StringType())
fstring = _udf(has_fstring, T.BooleanType())
valid = _udf(is_valid, T.BooleanType())
names = _udf(identifiers, T.ArrayType(T.StringType()))
ism = _udf(identifier_prefix, T.DoubleType())
pm = _udf(line_prefix, T.DoubleType())
bare = _udf(without_annotations, T.StringType())
queries_of = _udf(extract_queries, T.ArrayType(T.StringType()))
