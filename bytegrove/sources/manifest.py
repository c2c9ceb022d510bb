"""Archive manifests."""

from __future__ import annotations

import re


def parse_manifest(data: bytes) -> dict[str, str]:
    """The main section with keys in lower case; a line that starts with a blank continues the one before it.

    Any of the three line ends counts; the section ends at the first empty line. Lines without a colon are left out, of
    a repeated key the first counts.
    """
    text = data.decode("utf-8", "replace").lstrip("﻿")
    out: dict[str, str] = {}
    lines: list[str] = []
    for line in re.split(r"\r\n|\n|\r", text):
        if not line:
            break
        if line[0] == " " and lines:
            lines[-1] += line[1:]
        else:
            lines.append(line)
    for line in lines:
        key, colon, value = line.partition(":")
        if colon and key.strip():
            out.setdefault(key.strip().lower(), value[1:].rstrip() if value[:1] == " " else value.rstrip())
    return out


def child_paths(manifest: dict[str, str]) -> list[str]:
    """Further elements that a manifest names: Class-Path (by blanks) and Bundle-ClassPath (by commas, the archive itself aside)."""
    out = [p for p in manifest.get("class-path", "").split(" ") if p]
    for p in manifest.get("bundle-classpath", "").split(","):
        p = p.split(";")[0].strip()
        if p and p != ".":
            out.append(p)
    return out


def is_platform(manifest: dict[str, str]) -> bool:
    """Whether the archive is part of the Java platform by its titles."""
    return manifest.get("implementation-title") == "Java Runtime Environment" or manifest.get("specification-title") == "Java Platform API Specification"


def module_name(manifest: dict[str, str], descriptor: str | None, file: str) -> tuple[str, bool]:
    """(name, is_modular): the descriptor's name, else Automatic-Module-Name, else one derived from the file name."""
    from bytegrove.functions.paths import automatic_module_name

    if descriptor:
        return descriptor, True
    named = manifest.get("automatic-module-name")
    return (named, True) if named else (automatic_module_name(file), False)
