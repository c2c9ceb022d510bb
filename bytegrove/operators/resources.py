"""Files of class-path elements: order, masking, duplicates, modification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from bytegrove.operators.skew import numbered, union_all
from bytegrove.scratch import Scratch


def mask_classes(resources: DataFrame) -> DataFrame:
    """(cp_idx, path, masked): of class files with one path (``.class`` in any case) all but the first element's are masked.

    Other files are never masked, nor are module-info and package-info. Input is (cp_idx, path), optionally with ord.
    """
    return _marked(resources).select("cp_idx", "path", "masked")


def unmasked(resources: DataFrame) -> DataFrame:
    """Whole rows that ``mask_classes`` doesn't mask, by the same single shuffle."""
    return _marked(resources).where("not masked").select(*resources.columns)


def _marked(resources: DataFrame) -> DataFrame:
    r = resources if "ord" in resources.columns else resources.withColumn("ord", F.lit(0))
    key = F.regexp_replace("path", r"(?i)\.class$", ".class")
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.col("cp_idx").asc_nulls_last(), "ord", "path"))
    exempt = ~key.endswith(".class") | F.element_at(F.split(key, "/"), -1).isin("module-info.class", "package-info.class")
    return r.withColumn("n__", first).withColumn("masked", ~exempt & (F.col("n__") > 1))


def mask_same_file(resources: DataFrame, file_key: str = "file_key") -> DataFrame:
    """Rows of (cp_idx, path, file_key, ...) without those that lead to a file already seen under the same path.

    Rows without a file key are kept.
    """
    n = F.row_number().over(Window.partitionBy("path", file_key).orderBy(F.col("cp_idx").asc_nulls_last()))
    return resources.withColumn("n__", n).where(F.col(file_key).isNull() | (F.col("n__") == 1)).drop("n__")


def duplicates(resources: DataFrame) -> DataFrame:
    """(path, n): paths that several resources have."""
    return resources.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dedupe_elements(elements: DataFrame, file_key: str = "file") -> DataFrame:
    """Elements without later ones of the same canonical file; those without a file stay."""
    n = F.row_number().over(Window.partitionBy(file_key).orderBy("cp_idx"))
    return elements.withColumn("n__", n).where(F.col(file_key).isNull() | (F.col("n__") == 1)).drop("n__")


def outside_nested_roots(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries (cp_idx, path, ...) not below a nested root (cp_idx, prefix) of their element: those belong to that root.

    A path's own ancestors are its possible prefixes, so this is an equi-join on them and no range join.
    """
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    inside = (
        entries.select("cp_idx", "path", F.explode(heads).alias("prefix"))
        .join(roots.select("cp_idx", F.regexp_replace("prefix", "/$", "").alias("prefix")), ["cp_idx", "prefix"], "left_semi")
        .where("path <> prefix")
        .select("cp_idx", "path")
        .distinct()
    )
    return entries.join(inside, ["cp_idx", "path"], "left_anti")


def element_order(elements: DataFrame) -> DataFrame:
    """(cp_idx, position): modules first, then each element before its children, these by idx_in_parent; positions from 0.

    The order key is the path of indices from the top, built by joining upwards level by level, however deep. A parent that
    isn't there makes a top; of several parents the first that is reached counts. Elements whose parents run in a circle
    hang from nothing: they come last, by cp_idx.
    """
    sc = Scratch(elements.sparkSession, "element_order")
    e = elements.select("cp_idx", "parent_idx", F.coalesce("idx_in_parent", "cp_idx").alias("i"), F.coalesce(F.col("kind") == "module", F.lit(False)).alias("m")).where("cp_idx is not null")
    e = sc.save(e.join(e.select(F.col("cp_idx").alias("parent_idx"), F.lit(True).alias("known")).distinct(), "parent_idx", "left"), "elements")
    levels = [sc.save(e.where("known is null").groupBy("cp_idx").agg(F.max("m").alias("m")).select("cp_idx", "m", F.array("cp_idx").alias("key")), "level")]
    while not levels[-1].isEmpty():
        up = levels[-1].select(F.col("cp_idx").alias("parent_idx"), F.col("m").alias("top"), "key")
        step = e.where("known").join(up, "parent_idx").groupBy("cp_idx").agg(F.min(F.struct(F.concat("key", F.array("i")).alias("key"), F.col("top").alias("m"))).alias("b"))
        levels.append(sc.save(step.join(union_all(levels).select("cp_idx"), "cp_idx", "left_anti").select("cp_idx", "b.m", "b.key"), "level"))
    placed = union_all(levels).withColumn("last", F.lit(0))
    left = e.join(placed.select("cp_idx"), "cp_idx", "left_anti").groupBy("cp_idx").agg(F.max("m").alias("m")).select("cp_idx", "m", F.array("cp_idx").alias("key"), F.lit(1).alias("last"))
    ordered = numbered(placed.unionByName(left).withColumn("later", ~F.col("m")), ["last", "later", "key", "cp_idx"], "position")
    return ordered.select("cp_idx", F.col("position").cast("int").alias("position"))


def modification(elements: DataFrame, since: str, mtime: str = "mtime") -> DataFrame:
    """(last_modified, any_modified): the latest time of change that is not in the future, and whether any is after ``since``."""
    return elements.agg(F.date_format(F.max(F.when(F.col(mtime) < F.current_timestamp(), F.col(mtime))), "yyyy-MM-dd HH:mm:ss").alias("last_modified"), F.coalesce(F.bool_or(F.col(mtime) > F.to_timestamp(F.lit(since))), F.lit(False)).alias("any_modified"))


def select_resources(
    resources: DataFrame, *, path: str | None = None, leaf: str | None = None, extension: str | None = None, regex: str | None = None, glob: str | None = None, classfiles: bool | None = None
) -> DataFrame:
    """Resources by exact path, file name, extension (any case, without dot), full-match pattern, or glob; all given must hold."""
    from bytegrove.functions.globs import glob_to_regex

    c, out = F.col("path"), resources
    name = F.element_at(F.split(c, "/"), -1)
    if path is not None:
        out = out.where(c == path.strip("/"))
    if leaf is not None:
        out = out.where(name == leaf)
    if extension is not None:
        out = out.where(F.lower(name).endswith("." + extension.lstrip(".").lower()))
    if regex is not None:
        out = out.where(c.rlike(f"^(?:{regex})$"))
    if glob is not None:
        out = out.where(c.rlike(glob_to_regex(glob)))
    if classfiles is not None:
        out = out.where(F.lower(c).endswith(".class") == classfiles)
    return out


def elements_with_paths(elements: DataFrame, resources: DataFrame, accept: list[str] = (), reject: list[str] = ()) -> DataFrame:
    """Elements that contain an accepted path (any, if none is named) and no rejected one; paths may be globs."""
    from bytegrove.functions.globs import glob_to_regex, is_glob

    def holding(specs: list[str]) -> DataFrame:
        c = F.col("path")
        hit = F.lit(False)
        for s in specs:
            hit = hit | (c.rlike(glob_to_regex(s)) if is_glob(s) else c == s.strip("/"))
        return resources.where(hit).select("cp_idx").distinct()

    if accept:
        elements = elements.join(holding(accept), "cp_idx", "left_semi")
    if reject:
        elements = elements.join(holding(reject), "cp_idx", "left_anti")
    return elements
