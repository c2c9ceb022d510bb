"""Class names and descriptors as Column expressions, with the SQL that DuckDB understands."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


#: What Unicode has as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def class_name(c: Column | str) -> Column:
    """Dotted binary name of any spelling: ``La/b/C;``, ``a/b/C.class``, outer white space. Blank is null.

    ``.class`` is only taken for a file extension, so a name never ends in it; letter case is kept. Each step names its
    input once, so that the expression stays small when it is nested.
    """
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(F.btrim(c, F.lit(WHITE)), r"^L(.*);$", "$1")
    return F.nullif(F.translate(F.regexp_replace(c, r"\.class$", ""), "/", "."), F.lit(""))


def descriptor(c: Column | str) -> Column:
    """JVM descriptor with slashes and without blanks. Blank is null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.translate(c, "." + WHITE, "/"), F.lit(""))


def package_of(c: Column | str) -> Column:
    """Text before the last dot; the root package is the empty string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.instr(c, ".") > 0, F.regexp_replace(c, r"\.[^.]*$", "")).otherwise(F.when(c.isNotNull(), F.lit("")))


def simple_name(c: Column | str) -> Column:
    """Text after the last dot, then after the last dollar sign that is not at the end."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(c, r"^.*\.", "")
    return F.regexp_replace(c, r"^.*\$(?=[^$])", "")


def class_to_path(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.translate(c, ".", "/"), F.lit(".class"))


def path_to_class(c: Column | str) -> Column:
    """Class name of a ``.class`` path (extension in any case); null for other paths or an empty stem."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"(?i)[^/.]\.class$"), F.translate(F.regexp_replace(c, r"(?i)\.class$", ""), "/", "."))


def sql_class_name(c: str) -> str:
    return (
        rf"nullif(replace(regexp_replace(regexp_replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '^L(.*);$', '\1'), '\.class$', ''), '/', '.'), '')"
    )


def sql_descriptor(c: str) -> str:
    return rf"nullif(replace(regexp_replace({c}, '\s+', '', 'g'), '.', '/'), '')"
