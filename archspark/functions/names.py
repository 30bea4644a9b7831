"""Column expressions on paths and names; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(path: Column) -> Column:
    """Backslashes to slashes."""
    return F.translate(path, "\\", "/")


def suffixes(path: Column) -> Column:
    """All trailing fragments of a path, longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of leading components that two paths share (the file name counts as one)."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")


def directory(path: Column) -> Column:
    """The path without its last component, '' at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def is_python(path: Column) -> Column:
    return path.rlike(r"\.pyi?$")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def language_of_extension(path: Column) -> Column:
    """cpp, python or null; case matters."""
    e = extension(path)
    return F.when(e.isin(".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".h"), "cpp").when(e.isin(".py", ".pyi"), "python")


#: Folders that no scan enters, besides those whose name begins with a dot.
EXCLUDED_DIRECTORIES = (".git", "build", "build-release", "_deps", "node_modules", "venv", ".venv", "__pycache__", "cmake-build-debug", "cmake-build-release")


def in_excluded_directory(relative: Column, excluded: tuple[str, ...] = EXCLUDED_DIRECTORIES) -> Column:
    """A directory of the relative path (not the file name) is excluded or hidden."""
    parts = F.split(relative, "/")
    return F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda d: d.isin(*excluded) | (d.rlike(r"^\..+") & (d != "..")))


def own_name(name: Column) -> Column:
    """The class's own name, without its bases."""
    return F.trim(F.substring_index(name, " : ", 1))


def base_types(name: Column) -> Column:
    """Names of the base types, in order, blanks dropped."""
    rest = F.when(F.instr(name, " : ") > 0, F.regexp_replace(name, "(?s)^.*? : ", "")).otherwise("")
    return F.filter(F.transform(F.split(rest, ","), lambda x: F.trim(x)), lambda x: x != "")


def last_of_type(name: Column) -> Column:
    """Simple name of a base type: after the last ``::``, then after the last dot."""
    return F.substring_index(F.substring_index(name, "::", -1), ".", -1)


def last_of_call(name: Column) -> Column:
    """Simple name of a call: after the last dot, then after the last ``::``."""
    return F.substring_index(F.substring_index(name, ".", -1), "::", -1)


def instability(ca: Column, ce: Column) -> Column:
    """Ce / (Ca + Ce), 0 without any coupling."""
    return F.when(ca + ce == 0, F.lit(0.0)).otherwise(ce / (ca + ce))


def strip_current(path: Column) -> Column:
    """Without leading ``./``, as editors compare paths."""
    return F.regexp_replace(path, r"^(?:\./)+", "")
