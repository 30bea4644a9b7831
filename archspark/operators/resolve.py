"""Import resolution: raw import text to the file it means, as joins on a suffix index.

``files(path[, ordinal])`` are the known files, ``imports(import_id, from_file, raw)`` what is to be resolved.  A C++
target is looked up beside the including file, then by suffix; a Python target by its module file, then its package,
then by suffix of the module file.  One match is ``resolved``, several are ``ambiguous`` (most leading components shared
with the importing file, then least ordinal, then least path), none is ``external``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archspark.functions.names import directory, is_python, normalise, suffixes


def known_files(files: DataFrame) -> DataFrame:
    """``path, ordinal`` with slashes, each path once."""
    ordinal = F.col("ordinal") if "ordinal" in files.columns else F.lit(0)
    return files.select(normalise(F.col("path")).alias("path"), ordinal.cast("bigint").alias("ordinal")).groupBy("path").agg(F.min("ordinal").alias("ordinal"))


def suffix_index(files: DataFrame) -> DataFrame:
    """``suffix, path, ordinal``: every trailing fragment of every path."""
    return known_files(files).select(F.explode(suffixes(F.col("path"))).alias("suffix"), "path", "ordinal")


def _prefixes(path: Column) -> Column:
    """``struct<shared, prefix>`` for each number of leading components, 0 to all."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("shared"), F.array_join(F.slice(parts, 1, k), "/").alias("prefix")))


def prefix_index(files: DataFrame, top: int = 1) -> DataFrame:
    """``suffix, shared, prefix, n, best``: how many files have a suffix below a prefix, and the ``top`` first of them.

    A file shares at least k leading components with another exactly if it lies below the other's first k, so the best
    candidate of an import is found by looking up its own prefixes; no import ever meets all files of a common name.

    The index has many rows a file, which Spark's estimates count as one: the hint keeps it from being broadcast.
    """
    spread = suffix_index(files).select("suffix", "ordinal", "path", F.explode(_prefixes(F.col("path"))).alias("x")).select("suffix", "x.*", "ordinal", "path")
    counted = spread.groupBy("suffix", "shared", "prefix").agg(F.count("*").alias("n"), F.min(F.struct("ordinal", "path")).alias("first"))
    if top == 1:
        return counted.select("suffix", "shared", "prefix", "n", F.array("first").alias("best")).hint("merge")
    order = Window.partitionBy("suffix", "shared", "prefix").orderBy("ordinal", "path")
    heads = spread.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).groupBy("suffix", "shared", "prefix").agg(F.array_sort(F.collect_list(F.struct("ordinal", "path"))).alias("best"))
    return counted.drop("first").join(heads.hint("merge"), ["suffix", "shared", "prefix"]).hint("merge")


def _targets(imports: DataFrame) -> DataFrame:
    """First and second exact candidate and the suffix to look for."""
    raw = F.trim(normalise(F.col("raw")))
    home = directory(normalise(F.col("from_file")))
    beside = lambda name: F.when(home == "", name).otherwise(F.concat(home, F.lit("/"), name))
    dots = F.length(F.regexp_extract(raw, r"^(\.*)", 1))
    rest = F.translate(F.regexp_replace(raw, r"^\.+", ""), ".", "/")
    # each dot after the first climbs one directory
    parts = F.split(home, "/")
    kept = F.greatest(F.size(parts) - (dots - 1), F.lit(0))
    base = F.when(home == "", "").otherwise(F.array_join(F.slice(parts, 1, kept), "/"))
    stem = F.when(dots > 0, F.concat(base, F.when((base != "") & (rest != ""), "/").otherwise(""), rest)).otherwise(rest)
    python = is_python(F.col("from_file"))
    return imports.select(
        "import_id", "from_file", "raw",
        F.when(raw == "", None).when(python, F.concat(stem, F.lit(".py"))).otherwise(beside(raw)).alias("first"),
        F.when((raw != "") & python, F.when(stem == "", F.lit("__init__.py")).otherwise(F.concat(stem, F.lit("/__init__.py")))).alias("second"),
        F.when(raw == "", None).when(python, F.concat(stem, F.lit(".py"))).otherwise(raw).alias("suffix"),
    )


def resolve(files: DataFrame, imports: DataFrame) -> DataFrame:
    """``import_id, from_file, raw, target, resolution, candidates`` of each import."""
    known = known_files(files).select("path")
    wanted = _targets(imports)
    exact = wanted.join(known.withColumnRenamed("path", "first").withColumn("hit1", F.lit(True)), "first", "left").join(known.withColumnRenamed("path", "second").withColumn("hit2", F.lit(True)), "second", "left")
    exact = exact.withColumn("hit", F.when(F.col("hit1"), F.col("first")).when(F.col("hit2"), F.col("second")))
    asked = exact.where("hit is null and suffix is not null").select("import_id", "suffix", F.explode(_prefixes(normalise(F.col("from_file")))).alias("x")).select("import_id", "suffix", "x.*")
    near = asked.join(prefix_index(files), ["suffix", "shared", "prefix"])
    matched = near.groupBy("import_id").agg(F.max_by("best", "shared").alias("b"), F.max("n").alias("n"))
    out = exact.join(matched, "import_id", "left")
    resolution = F.when(F.col("hit").isNotNull() | (F.col("n") == 1), "resolved").when(F.col("n") > 1, "ambiguous").otherwise("external")
    return out.select(
        "import_id", "from_file", "raw",
        F.coalesce("hit", F.col("b")[0]["path"], "raw").alias("target"),
        resolution.alias("resolution"),
        F.when(F.col("hit").isNotNull(), 1).otherwise(F.coalesce("n", F.lit(0))).cast("bigint").alias("candidates"),
    )


def ambiguity(files: DataFrame, imports: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` preferred candidates of each ambiguous import: most shared components, then ordinal, then path.

    The first ``top`` below each prefix suffice: what they leave out is preceded by ``top`` others.
    """
    resolved = resolve(files, imports).where("resolution = 'ambiguous'").select("import_id", "from_file")
    wanted = _targets(imports).select("import_id", "suffix").join(resolved, "import_id")
    asked = wanted.select("import_id", "suffix", F.explode(_prefixes(normalise(F.col("from_file")))).alias("x")).select("import_id", "suffix", "x.*")
    pairs = asked.join(prefix_index(files, top), ["suffix", "shared", "prefix"]).select("import_id", "shared", F.explode("best").alias("c"))
    once = pairs.groupBy("import_id", "c.path", "c.ordinal").agg(F.max("shared").alias("shared"))
    order = Window.partitionBy("import_id").orderBy(F.desc("shared"), "ordinal", "path")
    return once.withColumn("preference", F.row_number().over(order)).where(F.col("preference") <= top).select("import_id", "path", "shared", "preference")


def statistics(resolved: DataFrame) -> DataFrame:
    """One row: resolved, ambiguous, external, total and the share that is resolved or ambiguous."""
    counts = resolved.agg(*[F.count_if(F.col("resolution") == r).alias(r) for r in ("resolved", "ambiguous", "external")], F.count("*").alias("total"))
    share = F.when(F.col("total") > 0, (F.col("resolved") + F.col("ambiguous")) / F.col("total")).otherwise(0.0)
    return counts.withColumn("resolved_ratio", share)


def unresolved(resolved: DataFrame) -> DataFrame:
    """``raw, n``: how often each external target is imported."""
    return resolved.where("resolution = 'external'").groupBy("raw").agg(F.count("*").alias("n"))
