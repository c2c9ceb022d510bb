"""The flags word of classes, methods and fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PUBLIC, PRIVATE, PROTECTED, STATIC, FINAL = 0x1, 0x2, 0x4, 0x8, 0x10
SYNCHRONIZED, VOLATILE, BRIDGE, VARARGS, TRANSIENT = 0x20, 0x40, 0x40, 0x80, 0x80
NATIVE, INTERFACE, ABSTRACT, STRICT, SYNTHETIC, ANNOTATION, ENUM, MODULE = 0x100, 0x200, 0x400, 0x800, 0x1000, 0x2000, 0x4000, 0x8000
ACCESS = PUBLIC | PRIVATE | PROTECTED

#: Keywords in the order they are written, by kind of declaration. Fixed values of the class-file format.
KEYWORDS = {
    "class": [(PUBLIC, "public"), (PRIVATE, "private"), (PROTECTED, "protected"), (ABSTRACT, "abstract"), (STATIC, "static"), (FINAL, "final"), (SYNTHETIC, "synthetic"), (STRICT, "strictfp")],
    "field": [
        (PUBLIC, "public"), (PRIVATE, "private"), (PROTECTED, "protected"), (ABSTRACT, "abstract"), (STATIC, "static"), (VOLATILE, "volatile"),
        (TRANSIENT, "transient"), (FINAL, "final"), (SYNTHETIC, "synthetic"),
    ],
    "method": [
        (PUBLIC, "public"), (PRIVATE, "private"), (PROTECTED, "protected"), (ABSTRACT, "abstract"), (STATIC, "static"), (FINAL, "final"),
        (SYNCHRONIZED, "synchronized"), (SYNTHETIC, "synthetic"), (BRIDGE, "bridge"), (NATIVE, "native"), (STRICT, "strictfp"),
    ],
}


def has(bits: int, column: str | Column = "modifiers") -> Column:
    """All of these bits are set; null flags have none."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.bitwiseAND(bits), F.lit(0)) == bits


def is_annotation(c: str = "modifiers") -> Column:
    return has(ANNOTATION, c)


def is_interface(c: str = "modifiers") -> Column:
    """An interface that is no annotation."""
    return has(INTERFACE, c) & ~has(ANNOTATION, c)


def is_interface_or_annotation(c: str = "modifiers") -> Column:
    return has(INTERFACE, c) | has(ANNOTATION, c)


def is_standard(c: str = "modifiers") -> Column:
    """Neither interface nor annotation."""
    return ~has(INTERFACE, c) & ~has(ANNOTATION, c)


def is_package_visible(c: str = "modifiers") -> Column:
    return F.coalesce(F.col(c).bitwiseAND(ACCESS), F.lit(0)) == 0


def modifiers_string(kind: str, c: str = "modifiers", *, default: Column | None = None) -> Column:
    """Keywords joined by blanks; for methods of interfaces with a body pass ``default`` as a boolean Column."""
    words = [F.when(has(bit, c), F.lit(word)) for bit, word in KEYWORDS[kind]]
    if default is not None:
        at = [w for _, w in KEYWORDS[kind]].index("synthetic") if kind == "method" else len(words)
        words.insert(at, F.when(default, F.lit("default")))
    return F.concat_ws(" ", *words)


def sql_modifiers_string(kind: str, c: str = "modifiers") -> str:
    words = ", ".join(f"CASE WHEN ({c} & {bit}) = {bit} THEN '{word}' END" for bit, word in KEYWORDS[kind])
    return f"concat_ws(' ', {words})"
