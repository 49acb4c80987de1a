"""Path expressions: normalising, suffix tests and classification."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from evolens.functions import fixed_values as fv


def normalise(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def segments(path: Column) -> Column:
    return F.split(normalise(path), "/")


def file_name(path: Column) -> Column:
    return F.substring_index(normalise(path), "/", -1)


def has_suffix(path: Column, suffixes: Sequence[str]) -> Column:
    return reduce(or_, [path.endswith(s) for s in suffixes])


def _in_directory(parts: Column, names: Sequence[str]) -> Column:
    return reduce(or_, [F.array_contains(parts, n) for n in names])


def file_type(path: Column) -> Column:
    """tests, docs, deps or code: the first test that holds decides."""
    lowered = F.lower(normalise(path))
    parts = F.split(lowered, "/")
    name = file_name(lowered)
    is_test = (
        _in_directory(parts, fv.TEST_DIRS)
        | name.startswith(fv.TEST_PREFIX)
        | has_suffix(name, fv.TEST_SUFFIXES)
    )
    is_doc = _in_directory(parts, fv.DOC_DIRS) | has_suffix(name, fv.DOC_SUFFIXES)
    is_dep = (
        name.isin(*fv.DEP_FILENAMES)
        | _in_directory(parts, fv.DEP_DIRS)
        | has_suffix(name, fv.DEP_SUFFIXES)
    )
    return F.when(is_test, "tests").when(is_doc, "docs").when(is_dep, "deps").otherwise("code")


def language(path: Column) -> Column:
    """python, js or null."""
    return F.when(has_suffix(path, fv.PYTHON_SUFFIXES), "python").when(
        has_suffix(path, fv.JS_SUFFIXES), "js"
    )


def component(path: Column) -> Column:
    """The second path segment, or root."""
    return F.coalesce(F.get(F.split(path, "/"), F.lit(1)), F.lit("root"))
