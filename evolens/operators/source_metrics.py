"""Counts taken from source text, and before/after pairs of them."""

from __future__ import annotations

import ast
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evolens.functions import fixed_values as fv
from evolens.functions.text import strip


def code_line_count(source: Column) -> Column:
    """Lines that hold code: not blank, not comment.

    A line with an opening and a closing comment mark never changes whether a
    comment is open; then the opening mark counts, then the closing mark, and only
    then is the state looked at. Each line is sorted into one of these kinds on its
    own; a fold over the kinds carries the state.
    """
    def trimmed(c: Column) -> Column:
        return strip(c, fv.SCRIPT_WHITESPACE)

    def is_code(c: Column) -> Column:
        return ((F.length(c) > 0) & ~c.startswith("//")).cast("long")

    def sorted_line(line: Column) -> Column:
        opens, closes = line.contains("/*"), line.contains("*/")
        around = trimmed(F.regexp_replace(line, r"/\*.*?\*/", ""))
        before = trimmed(F.substring_index(line, "/*", 1))
        after = trimmed(F.get(F.split(line, r"\*/"), F.lit(1)))
        kind = (
            F.when(opens & closes, "both").when(opens, "open").when(closes, "close").otherwise("text")
        )
        code = (
            F.when(opens & closes, is_code(around))
            .when(opens, (F.length(before) > 0).cast("long"))
            .when(closes, is_code(after))
            .otherwise(is_code(line))
        )
        return F.struct(kind.alias("kind"), code.alias("code"))

    def step(state: Column, line: Column) -> Column:
        hidden = state["open"] & (line["kind"] == "text")
        is_open = F.when(line["kind"] == "open", True).when(line["kind"] == "close", False)
        return F.struct(
            (state["lines"] + F.when(hidden, 0).otherwise(line["code"])).alias("lines"),
            is_open.otherwise(state["open"]).alias("open"),
        )

    lines = F.transform(F.split(source, "\n"), lambda raw: trimmed(raw))
    start = F.struct(F.lit(0).cast("long").alias("lines"), F.lit(False).alias("open"))
    folded = F.aggregate(
        F.transform(lines, lambda line: sorted_line(line)), start, step, lambda state: state["lines"]
    )
    plain = F.size(F.filter(lines, lambda line: is_code(line) == 1)).cast("long")
    return F.when(source.contains("/*") | source.contains("*/"), folded).otherwise(plain)


# A word that is not part of a longer name; the name characters are spelled out
# so that every regular expression engine reads them alike.
def _words(alternatives: str) -> str:
    return rf"(?<![A-Za-z0-9_$])(?:{alternatives})(?![A-Za-z0-9_$])"


_HEAD = r"(?m)^[ \t]*(?:(?:async|static|get|set) +)*{name}[ \t]*\([^()]*\)[ \t]*\{{"
FUNCTION_WORDS = _words("function")
ARROWS = r"=>"
METHOD_HEADS = _HEAD.format(name=r"[A-Za-z_$][A-Za-z0-9_$]*")
CONTROL_HEADS = _HEAD.format(name=r"(?:if|for|while|switch|catch)")
IMPORT_LINES = r"(?m)^[ \t]*import(?![A-Za-z0-9_$])"
REQUIRE_CALLS = r"(?<![A-Za-z0-9_$.])require[ \t]*\([ \t]*[^) \t]"
BRANCH_WORDS = _words("if|for|while|case|catch")
LOGICAL = r"&&|\|\|"
OPTIONAL_CHAIN = r"\?\."
TERNARY = r"[^?]\?[^?.:]"


def lexical_counts(source: Column) -> Column:
    """Functions, imports and complexity of script text, counted by pattern.

    An approximation of a syntax tree: comments are removed first, strings are
    not. Complexity is 1 plus the decision points, per function where there are any.
    """
    code = F.regexp_replace(F.regexp_replace(source, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", "")

    def count(pattern: str) -> Column:
        return F.regexp_count(code, F.lit(pattern))

    functions = count(FUNCTION_WORDS) + count(ARROWS) + count(METHOD_HEADS) - count(CONTROL_HEADS)
    imports = count(IMPORT_LINES) + count(REQUIRE_CALLS)
    decisions = count(BRANCH_WORDS) + count(LOGICAL) + count(OPTIONAL_CHAIN) + count(TERNARY)
    return F.struct(
        functions.alias("function_count"),
        imports.alias("import_count"),
        (decisions + 1).alias("complexity_total"),
    )


def with_script_metrics(df: DataFrame, source: str) -> DataFrame:
    """Add loc, cc, mi (always null), function_count and import_count of script text."""
    counted = df.withColumn("_counts", lexical_counts(F.col(source)))
    functions, total = F.col("_counts.function_count"), F.col("_counts.complexity_total")
    cc = F.when(functions > 0, F.round(total / functions, 2)).otherwise(total.cast("double"))
    return counted.select(
        *df.columns,
        code_line_count(F.col(source)).alias("loc"),
        cc.alias("cc"),
        F.lit(None).cast("double").alias("mi"),
        functions.alias("function_count"),
        F.col("_counts.import_count").alias("import_count"),
    )


_DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.ExceptHandler, ast.Assert)


def _python_counts(source: str | None) -> tuple | None:
    """loc, cc, functions, imports of one Python text; None when it does not parse."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    imports, complexities = 0, []
    todo = [(tree, None)]
    while todo:
        node, block = todo.pop()
        imports += isinstance(node, (ast.Import, ast.ImportFrom))
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) and block is None:
            block = len(complexities)
            complexities.append(1)
        elif block is not None:
            if isinstance(node, _DECISIONS):
                complexities[block] += 1
            elif isinstance(node, ast.BoolOp):
                complexities[block] += len(node.values) - 1
            elif isinstance(node, ast.comprehension):
                complexities[block] += 1 + len(node.ifs)
            elif isinstance(node, ast.match_case):
                complexities[block] += 1
        todo.extend((child, block) for child in ast.iter_child_nodes(node))
    cc = round(sum(complexities) / len(complexities), 2) if complexities else 0.0
    return len((source or "").splitlines()), cc, len(complexities), imports


def with_python_metrics(df: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """loc, cc, mi (null), function_count and import_count of Python text; unparsable rows are dropped."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    schema += ", loc bigint, cc double, mi double, function_count bigint, import_count bigint"

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts = [_python_counts(s) for s in frame[source]]
            parsed = [c is not None for c in counts]
            out = frame.loc[parsed, list(keys)].reset_index(drop=True)
            kept = [c for c in counts if c is not None]
            out["loc"] = [c[0] for c in kept]
            out["cc"] = [float(c[1]) for c in kept]
            out["mi"] = None
            out["function_count"] = [c[2] for c in kept]
            out["import_count"] = [c[3] for c in kept]
            yield out

    return df.select(*keys, source).mapInPandas(measure, schema)


# Metric in a per-side table, and its name in the before/after table.
METRIC_NAMES = {
    "loc": "loc",
    "cc": "cc",
    "mi": "mi",
    "function_count": "func",
    "import_count": "imports",
}


def before_after(
    sides: DataFrame, keys: Sequence[str] = ("repo_name", "commit_hash", "file_path")
) -> DataFrame:
    """Pair the parent and commit side of every change.

    ``sides`` has one row per key and ``side`` (parent or commit). One aggregate
    brings the two sides together; keys with only one of them (added, deleted or
    unreadable files) are left out. A delta is null when either value is.
    """
    def at(side: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(column)))

    paired = sides.groupBy(*keys).agg(
        F.count_if(F.col("side") == "parent").alias("_before"),
        F.count_if(F.col("side") == "commit").alias("_after"),
        *[at("parent", m).alias(f"{n}_before") for m, n in METRIC_NAMES.items()],
        *[at("commit", m).alias(f"{n}_after") for m, n in METRIC_NAMES.items()],
    )
    both = paired.filter((F.col("_before") > 0) & (F.col("_after") > 0))
    columns = []
    for n in METRIC_NAMES.values():
        before, after = F.col(f"{n}_before"), F.col(f"{n}_after")
        columns += [before, after, (after - before).alias(f"{n}_delta")]
    return both.select(*keys, *columns)
