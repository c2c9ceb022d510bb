"""Globs and the accept/reject filters built of them, as plan-time Python that yields Columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F


def glob_to_regex(glob: str, sep: str = "/") -> str:
    """An anchored regular expression for java.util.regex, RE2 and Python alike.

    ``*`` and ``?`` stay within a segment. ``**`` must be a whole segment: at the start or between separators it is any
    number of segments, at the end anything below (the separator before it included), alone anything.
    """
    not_sep, lit = f"[^{re.escape(sep)}]", re.escape(sep)
    segments = glob.split(sep)
    if any("**" in s and s != "**" for s in segments):
        raise ValueError(f"** must be a whole segment: {glob}")
    if segments == ["**"]:
        return "^.*$"
    out, pending = "", False  # pending: a separator is due before the next segment
    for i, s in enumerate(segments):
        last = i == len(segments) - 1
        if s == "**":
            if last:
                out += f"(?:{lit}.*)?" if pending else ".*"
                pending = False
            else:
                out += (lit if pending else "") + f"(?:{not_sep}+{lit})*"
                pending = False
        else:
            out += (lit if pending else "") + "".join(f"{not_sep}*" if c == "*" else not_sep if c == "?" else re.escape(c) for c in s)
            pending = True
    return f"^{out}$"


def is_glob(spec: str) -> bool:
    return "*" in spec or "?" in spec


def strip_recursive(spec: str, sep: str = ".") -> str:
    """A prefix filter is recursive already, so a trailing ``**`` says nothing."""
    return spec[: -len(sep) - 2] if spec.endswith(sep + "**") else "" if spec == "**" else spec


def any_prefix(c: Column, specs: tuple[str, ...], sep: str = ".") -> Column:
    """Whether a dotted or slashed name is one of these or lies below it; specs may be globs."""
    tests = []
    for spec in (strip_recursive(s, sep) for s in specs):
        if is_glob(spec):
            tests.append(c.rlike(glob_to_regex(spec, sep)[:-1] + f"(?:{re.escape(sep)}.*)?$"))
        elif not spec:
            tests.append(F.lit(True))
        else:
            tests.append((c == spec) | c.startswith(spec + sep))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def sql_any_prefix(c: str, specs: tuple[str, ...], sep: str = ".") -> str:
    tests = []
    for spec in (strip_recursive(s, sep) for s in specs):
        if is_glob(spec):
            tests.append(f"regexp_full_match({c}, '{glob_to_regex(spec, sep)[1:-1]}(?:{re.escape(sep)}.*)?')")
        else:
            tests.append(f"({c} = '{spec}' OR starts_with({c}, '{spec}{sep}'))" if spec else "true")
    return "(" + (" OR ".join(tests) or "false") + ")"


class Filter:
    """Accept and reject lists of one kind: ``prefix`` (paths, packages), ``whole`` (names) or ``leaf`` (file names, any case).

    Reject wins; an empty accept list accepts all.
    """

    def __init__(self, kind: str, accept: tuple[str, ...] = (), reject: tuple[str, ...] = (), sep: str = "/"):
        if kind not in ("prefix", "whole", "leaf"):
            raise ValueError(kind)
        if kind == "leaf" and any("/" in s for s in (*accept, *reject)):
            raise ValueError("a file-name filter takes bare names")
        if kind == "prefix" and any(strip_recursive(s, sep) == "" for s in reject):
            raise ValueError("the root can't be rejected")
        self.kind, self.accept, self.reject, self.sep = kind, accept, reject, sep

    def _any(self, c: Column, specs: tuple[str, ...]) -> Column:
        if self.kind == "prefix":
            return any_prefix(c, specs, self.sep)
        if self.kind == "leaf":
            c, specs = F.lower(F.element_at(F.split(c, "/"), -1)), tuple(s.lower() for s in specs)
        plain = [s for s in specs if not is_glob(s)]
        tests = ([c.isin(*plain)] if plain else []) + [c.rlike(glob_to_regex(s, self.sep)) for s in specs if is_glob(s)]
        return reduce(lambda a, b: a | b, tests, F.lit(False))

    def rejected(self, c: Column) -> Column:
        return self._any(c, self.reject) if self.reject else F.lit(False)

    def accepted(self, c: Column) -> Column:
        """Accepted and not rejected."""
        return (self._any(c, self.accept) if self.accept else F.lit(True)) & ~self.rejected(c)


def path_status(directory: Column, accept: tuple[str, ...], reject: tuple[str, ...] = (), class_packages: tuple[str, ...] = ()) -> Column:
    """What a directory path (without outer slashes) is to a scan of accepted paths, the first that holds.

    rejected; accepted (nothing named); at (named itself); at_class_package (of a class named); below; above (an ancestor
    of something named, so a walk must pass it); outside.
    """
    literal = tuple(s for s in (strip_recursive(a, "/") for a in accept))
    exact = reduce(lambda a, b: a | b, [directory.rlike(glob_to_regex(s)) if is_glob(s) else directory == s for s in literal], F.lit(False))
    heads = sorted({h for s in (*literal, *class_packages) for h in _ancestors(s)})
    return (
        F.when(any_prefix(directory, reject, "/") if reject else F.lit(False), "rejected")
        .when(F.lit(not accept and not class_packages), "accepted")
        .when(exact, "at")
        .when(directory.isin(*class_packages) if class_packages else F.lit(False), "at_class_package")
        .when(any_prefix(directory, literal, "/"), "below")
        .when(reduce(lambda a, b: a | b, [directory.rlike(glob_to_regex(h)) if is_glob(h) else directory == h for h in heads], F.lit(False)), "above")
        .otherwise("outside")
    )


def _ancestors(path: str) -> list[str]:
    parts = path.split("/")
    return ["/".join(parts[:i]) for i in range(len(parts))]
