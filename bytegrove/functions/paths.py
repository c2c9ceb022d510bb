"""Paths, URLs and path lists: plan-time Python, and Columns where rows need it."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import quote, unquote

from pyspark.sql import Column, functions as F

_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]+:")
ARCHIVE = re.compile(r"\.(jar|zip|war|ear|jmod|par|sar|rar)$", re.I)
#: Schemes that need a network, denied unless asked for.
REMOTE = ("http", "https", "ftp", "mailto")


def sanitize(path: str, *, strip_start: bool = True, strip_end: bool = False) -> str:
    """Entry path without empty, ``.`` and ``..`` segments; ``..`` never leaves the top. ``!/`` starts a new top."""
    parts = []
    for section in path.replace("\\", "/").split("!/"):
        out: list[str] = []
        for s in section.split("/"):
            if s == "..":
                if out:
                    out.pop()
            elif s not in ("", "."):
                out.append(s)
        text = "/".join(out)
        if section.endswith("/") and text and not strip_end:
            text += "/"
        if section.startswith("/") and not strip_start and not parts:
            text = "/" + text
        parts.append(text)
    return "!/".join(parts)


def sanitize_column(c: Column | str) -> Column:
    """``sanitize`` for paths of one section, in Catalyst: segments are filtered, ``..`` removes the one before it."""
    c = F.col(c) if isinstance(c, str) else c
    segments = F.filter(F.split(F.translate(c, "\\", "/"), "/"), lambda s: ~s.isin("", "."))
    kept = F.aggregate(
        segments, F.array().cast("array<string>"), lambda acc, s: F.when(s != "..", F.concat(acc, F.array(s))).when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
    )
    return F.array_join(kept, "/")


def leaf(path: str) -> str:
    """Text after the last slash, whatever archives the path leads through."""
    return path.rstrip("/").rsplit("/", 1)[-1].split("!")[-1]


def parent_dir(path: str, sep: str = "/") -> str:
    return path.rsplit(sep, 1)[0] if sep in path else ""


def has_scheme(path: str) -> bool:
    """A URL; one letter before a colon is a drive."""
    return bool(_SCHEME.match(path))


def nested_separator(path: str) -> int:
    """Position of the last ``!`` that separates an archive from a path in it, or -1."""
    return max((m.start() for m in re.finditer(r"!(?=/|$)", path)), default=-1)


def decode_url(text: str) -> str:
    """Percent escapes as UTF-8; a plus sign is a plus sign, and a bad escape stays as it is."""
    return unquote(text, errors="replace")


def encode_url(path: str) -> str:
    """A path as part of a URL: slashes stay, and so do the marks of nested archives; a blank is %20."""
    return quote(path, safe="/!:@$&'()*+,;=~-._")


def normalize_url(url: str) -> str:
    """A file path or URL as a URL: ``jar:`` is added where the path leads into an archive, file paths get ``file:``."""
    text = url
    while (m := re.match(r"(?i)(jar|file|war|nested):", text)) and not re.match(r"(?i)[a-z]+://[^/]", text):
        text = text[m.end() :]
    if has_scheme(text):
        scheme, rest = text.split(":", 1)
        out = f"{scheme}:{encode_url(decode_url(rest))}"
    else:
        out = "file:" + encode_url(decode_url(re.sub(r"^/*(?=/)", "", text)))
    return "jar:" + out if "!" in out else out


def resolve(base: str, path: str) -> str:
    """A path relative to a base directory, or a URL, as a plain path; ``war:`` and ``nested:`` become ``!`` paths."""
    text = path
    if re.match(r"(?i)war:", text):
        text = re.sub(r"(?i)^war:", "", text).replace("*/", "!/").replace("^/", "!/")
    if re.match(r"(?i)(jar:)?nested:", text):
        text = re.sub(r"(?i)^(jar:)?nested:/*", "/", text).replace("/!", "!/").replace("!//", "!/")
    is_url = False
    while m := re.match(r"(?i)(jar|file|jrt):", text):
        text, is_url = text[m.end() :], True
        text = re.sub(r"^//(?=/)", "", text)
    if has_scheme(text):
        return text
    if is_url:
        text = decode_url(text)
    text = text.replace("\\", "/")
    if text.startswith("/") or re.match(r"[A-Za-z]:/", text):
        head, text = ("/" if text.startswith("/") else "", text.lstrip("/"))
        return head + sanitize(text, strip_end=True)
    joined = f"{base.rstrip('/')}/{text}"
    return ("/" if joined.startswith("/") else "") + sanitize(joined, strip_end=True)


def split_path_list(text: str, sep: str = ":") -> list[str]:
    """Elements of a class path. With ``:`` as separator, the colon of a URL scheme is none; ``\\:`` is a colon."""
    if sep != ":":
        return [p for p in (x.strip() for x in text.split(sep)) if p]
    out, start, i = [], 0, 0
    while i < len(text):
        if text[i] == "\\" and i + 1 < len(text):
            i += 2
            continue
        if text[i] == ":":
            head = text[start:i]
            nested = re.fullmatch(r"(?i)(?:(?:jar|war|nested):)*(?:[a-z][a-z0-9+.-]+)", head)
            port = re.search(r"(?i)^(?:jar:)?(?:https?|ftp)://[^/:]*$", head) and re.match(r":\d", text[i:])
            if not port and not (nested and (re.match(r":(//|/|[a-z]+:)", text[i:]) is not None) and re.match(r"(?i)(jar|file|war|nested|jrt|https?|ftp|s3a?|hdfs)$", head.rsplit(":", 1)[-1])):
                out.append(head)
                start = i + 1
        i += 1
    out.append(text[start:])
    return [p.replace("\\:", ":") for p in (x.strip() for x in out) if p]


def join_path_list(paths: list[str], sep: str = ":") -> str:
    return sep.join(p.replace(sep, "\\" + sep) if sep == ":" and not has_scheme(p) else p for p in paths)


def automatic_module_name(file: str) -> str:
    """Module name derived from an archive's file name: without directory, extension and version; dots between words."""
    stem = re.sub(r"\.[A-Za-z]+$", "", posixpath.basename(file.split("!/")[-1]))
    m = re.search(r"-(\d+(\.|$))", stem)
    stem = stem[: m.start()] if m else stem
    return re.sub(r"^\.|\.$", "", re.sub(r"\.+", ".", re.sub(r"[^A-Za-z0-9]", ".", stem)))


def automatic_module_name_column(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    for pattern, by in ((r"^.*/", ""), (r"\.[A-Za-z]+$", ""), (r"-\d+(\.|$).*$", ""), (r"[^A-Za-z0-9]", "."), (r"\.+", "."), (r"^\.|\.$", "")):
        c = F.regexp_replace(c, pattern, by)
    return c


def posix_permissions(mode: Column | str) -> Column:
    """Names of the permission bits of a mode, in order; null without a mode."""
    m = F.col(mode) if isinstance(mode, str) else mode
    names = [f"{who}_{what}" for who in ("OWNER", "GROUP", "OTHERS") for what in ("READ", "WRITE", "EXECUTE")]
    bits = [F.when(m.bitwiseAND(1 << (8 - i)) != 0, F.lit(n)) for i, n in enumerate(names)]
    return F.when(m.isNotNull(), F.array_compact(F.array(*bits)))
