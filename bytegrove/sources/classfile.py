"""Class files to plain records: one pass over the bytes, nothing kept that was not asked for."""

from __future__ import annotations

import json
import math
import struct

#: Bytes of the constants whose size is fixed, by tag. Fixed values of the class-file format.
CONSTANT_SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
VISIBLE, INVISIBLE = "RuntimeVisible", "RuntimeInvisible"


class ClassFormatError(ValueError):
    """The bytes are no class file, or one that is cut off or contradicts itself."""


def modified_utf8(raw: bytes) -> str:
    """Java's own UTF-8: NUL in two bytes, characters beyond the basic plane as two encoded surrogates."""
    try:
        if b"\xc0\x80" not in raw and b"\xed" not in raw:
            return raw.decode("utf-8")
        text = raw.replace(b"\xc0\x80", b"\x00").decode("utf-8", "surrogatepass")
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    except UnicodeDecodeError as e:
        raise ClassFormatError(f"bad string constant: {e.reason}") from None


def _number(kind: str, value: float) -> dict:
    if isinstance(value, float) and not math.isfinite(value):
        return {"t": kind, "v": "NaN" if value != value else "Infinity" if value > 0 else "-Infinity"}
    return {"t": kind, "v": value}


def tagged(value: dict) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


class Reader:
    """A cursor over class-file bytes."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, fmt: str):
        try:
            out = struct.unpack_from(">" + fmt, self.data, self.at)
        except struct.error:
            raise ClassFormatError("cut off") from None
        self.at += struct.calcsize(">" + fmt)
        return out[0] if len(out) == 1 else out

    def u1(self) -> int:
        return self.take("B")

    def u2(self) -> int:
        return self.take("H")

    def u4(self) -> int:
        return self.take("I")

    def raw(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ClassFormatError("cut off")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out


class ClassFile:
    """Parsed class: ``record()`` gives what the tables take."""

    def __init__(self, data: bytes, *, invisible: bool = True, members: bool = True, refs: bool = True):
        self.r, self.invisible = Reader(data), invisible
        r = self.r
        if r.u4() != 0xCAFEBABE:
            raise ClassFormatError("no class file")
        self.minor, self.major = r.take("HH")
        self._pool()
        self.flags = r.u2()
        self.name = self.dotted(self.class_at(r.u2()))
        sup = r.u2()
        self.superclass = self.dotted(self.class_at(sup)) if sup else None
        self.interfaces = [self.dotted(self.class_at(r.u2())) for _ in range(r.u2())]
        self.annotations: list[dict] = []
        self.type_annotations: list[dict] = []
        self.params: list[dict] = []
        self.defaults: list[dict] = []
        self.fields = self._members("field", members)
        self.methods = self._members("method", members)
        self.signature = self.source_file = self.defining_method = self.module_name = None
        self.inner: list[dict] = []
        self.is_record = False
        self._class_attributes()
        self.refs = sorted(self._refs()) if refs else []

    @staticmethod
    def dotted(name: str) -> str:
        return name.replace("/", ".")

    def _pool(self) -> None:
        r, n = self.r, self.r.u2()
        self.tags, self.pool = [0] * n, [None] * n
        i = 1
        while i < n:
            tag = r.u1()
            self.tags[i] = tag
            if tag == 1:
                self.pool[i] = r.raw(r.u2())
            elif tag in CONSTANT_SIZES:
                self.pool[i] = r.raw(CONSTANT_SIZES[tag])
            else:
                raise ClassFormatError(f"unknown constant {tag}")
            i += 2 if tag in (5, 6) else 1

    def _at(self, i: int, *tags: int) -> bytes:
        if not 0 < i < len(self.pool) or self.tags[i] not in tags:
            raise ClassFormatError(f"constant {i} is not what it should be")
        return self.pool[i]

    def text(self, i: int) -> str:
        return modified_utf8(self._at(i, 1))

    def class_at(self, i: int) -> str:
        return self.text(struct.unpack(">H", self._at(i, 7, 8, 16, 19, 20))[0])

    def constant(self, i: int, desc: str) -> dict:
        """A ConstantValue, typed by the field's descriptor."""
        c = desc[:1]
        if c in "BSIZC":
            v = struct.unpack(">i", self._at(i, 3))[0]
            return {"t": c, "v": bool(v) if c == "Z" else v}
        if c == "J":
            return {"t": c, "v": struct.unpack(">q", self._at(i, 5))[0]}
        if c in "FD":
            return _number(c, struct.unpack(">f" if c == "F" else ">d", self._at(i, 4 if c == "F" else 6))[0])
        if desc == "Ljava/lang/String;":
            return {"t": "s", "v": self.class_at(i)}
        raise ClassFormatError(f"a constant of type {desc}")

    # annotations

    def element(self) -> dict:
        r, tag = self.r, chr(self.r.u1())
        if tag in "BCDFIJSZ":
            return self.constant(r.u2(), tag)
        if tag == "s":
            i = r.u2()
            return {"t": "s", "v": self.text(i) if self.tags[i] == 1 else self.class_at(i)}
        if tag == "e":
            return {"t": "e", "class": self.type_name(self.text(r.u2())), "name": self.text(r.u2())}
        if tag == "c":
            i = r.u2()
            return {"t": "c", "v": self.text(i) if 0 < i < len(self.tags) and self.tags[i] == 1 else self.class_at(i)}
        if tag == "@":
            name, params = self.annotation()
            return {"t": "@", "annotation": name, "params": params}
        if tag == "[":
            return {"t": "[", "v": [self.element() for _ in range(r.u2())]}
        raise ClassFormatError(f"unknown annotation value {tag!r}")

    @staticmethod
    def type_name(desc: str) -> str:
        return (desc[1:-1] if desc.startswith("L") and desc.endswith(";") else desc).replace("/", ".")

    def annotation(self) -> tuple[str, list[dict]]:
        name = self.type_name(self.text(self.r.u2()))
        return name, [{"name": self.text(self.r.u2()), "value_json": tagged(self.element())} for _ in range(self.r.u2())]

    def _add(self, kind: str, ord_: int | None, param: int | None, visible: bool) -> None:
        for _ in range(self.r.u2()):
            name, params = self.annotation()
            n = sum((a["target_kind"], a["member_ord"], a["param_idx"]) == (kind, ord_, param) for a in self.annotations)
            self.annotations.append({"target_kind": kind, "member_ord": ord_, "param_idx": param, "ord": n, "annotation": name, "visible": visible, "params": params})

    def _type_annotations(self, kind: str, ord_: int | None, visible: bool) -> None:
        """Targets by kind of declaration; others are format errors, and those of code are read and left out."""
        r = self.r
        allowed = {"class": (0x00, 0x10, 0x11), "field": (0x13,), "method": (0x01, 0x10, 0x12, 0x13, 0x14, 0x15, 0x16, 0x17)}[kind]
        for _ in range(r.u2()):
            target = r.u1()
            if target not in allowed:
                raise ClassFormatError(f"type annotation target {target:#x} on a {kind}")
            info: list[int] = []
            if target in (0x00, 0x01, 0x16):
                info = [r.u1()]
            elif target in (0x10, 0x17):
                info = [r.u2()]
            elif target in (0x11, 0x12):
                info = list(r.take("BB"))
            path = [{"kind": k, "arg": a} for k, a in (r.take("BB") for _ in range(r.u1()))]
            name, params = self.annotation()
            if kind == "method" and target in (0x10, 0x13):
                continue
            self.type_annotations.append({"target_kind": kind, "member_ord": ord_, "target_type": target, "target_info": info, "path": path, "annotation": name, "visible": visible, "params": params})

    def _parameter_annotations(self, ord_: int, visible: bool, counts: list[int]) -> None:
        n = self.r.u1()
        counts.append(n)
        if len(set(counts)) > 1:
            raise ClassFormatError("visible and invisible parameter annotations disagree on the number of parameters")
        for i in range(n):
            self._add("param", ord_, i, visible)

    # members

    def _attributes(self):
        """(name, end) of each attribute in turn; the cursor is moved to the end whatever was read."""
        r = self.r
        for _ in range(r.u2()):
            name, n = self.text(r.u2()), r.u4()
            end = r.at + n
            if end > len(r.data):
                raise ClassFormatError("cut off")
            yield name, end
            r.at = end

    def _annotation_attribute(self, name: str, kind: str, ord_: int | None, counts: list[int]) -> bool:
        visible = name.startswith(VISIBLE)
        if not visible and not name.startswith(INVISIBLE):
            return False
        if not visible and not self.invisible:
            return True
        rest = name[len(VISIBLE if visible else INVISIBLE) :]
        if rest == "Annotations":
            self._add(kind, ord_, None, visible)
        elif rest == "TypeAnnotations":
            self._type_annotations(kind, ord_, visible)
        elif rest == "ParameterAnnotations" and kind == "method":
            self._parameter_annotations(ord_, visible, counts)
        return True

    def _members(self, kind: str, keep: bool) -> list[dict]:
        r, out = self.r, []
        for ord_ in range(r.u2()):
            flags, name, desc = r.u2(), self.text(r.u2()), self.text(r.u2())
            m = {"ord": ord_, "name": name, "descriptor": desc, "modifiers": flags, "signature": None}
            if kind == "method":
                m |= {"has_body": False, "min_line": 0, "max_line": 0, "thrown": []}
            else:
                m["const_json"] = None
            counts: list[int] = []
            names: list[tuple[str | None, int]] = []
            for a, _ in self._attributes():
                if not keep and a != "AnnotationDefault":
                    continue
                if self._annotation_attribute(a, kind, ord_, counts):
                    continue
                if a == "Signature":
                    m["signature"] = self.text(r.u2())
                elif kind == "field" and a == "ConstantValue":
                    m["const_json"] = tagged(self.constant(r.u2(), desc))
                elif kind == "method" and a == "Exceptions":
                    m["thrown"] = [self.dotted(self.class_at(r.u2())) for _ in range(r.u2())]
                elif kind == "method" and a == "Code":
                    m["has_body"] = True
                    m["min_line"], m["max_line"] = self._lines()
                elif kind == "method" and a == "MethodParameters":
                    for _ in range(r.u1()):
                        i, f = r.take("HH")
                        names.append((self.text(i) if i else None, f))
                elif kind == "method" and a == "AnnotationDefault":
                    self.defaults.append({"ord": ord_, "name": name, "value_json": tagged(self.element())})
            if keep:
                out.append(m)
                if kind == "method":
                    self._parameters(m, names)
        return out

    def _lines(self) -> tuple[int, int]:
        """Smallest and largest line number of a body, 0 without any."""
        r = self.r
        r.take("HH")
        r.raw(r.u4())
        r.raw(8 * r.u2())
        lo = hi = 0
        for name, _ in self._attributes():
            if name == "LineNumberTable":
                for _ in range(r.u2()):
                    line = r.take("HH")[1]
                    if line:
                        lo, hi = (min(lo, line) if lo else line), max(hi, line)
        return lo, hi

    def _parameters(self, m: dict, names: list[tuple[str | None, int]]) -> None:
        """Parameters of the descriptor; what other attributes say of fewer of them is aligned to the right, as those
        that the compiler added come first."""
        from bytegrove.functions.signatures import SignatureError, parse_method, render_descriptors

        types = parameter_descriptors(m["descriptor"])
        try:
            sig = render_descriptors(parse_method(m["signature"])) if m["signature"] else []
        except SignatureError:
            sig = []
        n = len(types)
        pad = lambda xs, none: ([none] * (n - len(xs)) + list(xs))[-n:] if n else []
        if len(names) > n:
            names = names[-n:] if n else []
        for i, (t, s, (pname, flags)) in enumerate(zip(types, pad(sig[-n:] if n else [], None), pad(names, (None, 0)))):
            self.params.append({"method_ord": m["ord"], "idx": i, "name": pname, "modifiers": flags, "descriptor": t, "signature": s})
        have = [a for a in self.annotations if a["target_kind"] == "param" and a["member_ord"] == m["ord"]]
        if have:
            declared = max(a["param_idx"] for a in have) + 1
            shift = n - declared if declared < n and m["name"] == "<init>" and len(sig) == declared else 0
            for a in have:
                a["param_idx"] += shift

    # the class

    def _class_attributes(self) -> None:
        r = self.r
        for name, end in self._attributes():
            if self._annotation_attribute(name, "class", None, []):
                continue
            if name == "Signature":
                self.signature = self.text(r.u2())
            elif name == "SourceFile":
                self.source_file = self.text(r.u2())
            elif name == "Record":
                self.is_record = True
            elif name == "Module":
                self.module_name = self.class_at(r.u2())
            elif name == "InnerClasses":
                for _ in range(r.u2()):
                    inner, outer, _, flags = r.take("HHHH")
                    i, o = self.dotted(self.class_at(inner)), self.dotted(self.class_at(outer)) if outer else None
                    if o is not None and i == o:
                        raise ClassFormatError("a class within itself")
                    if i != "java.lang.invoke.MethodHandles$Lookup":
                        self.inner.append({"inner": i, "outer": o, "modifiers": flags})
            elif name == "EnclosingMethod":
                c, m = r.take("HH")
                outer = self.dotted(self.class_at(c))
                method = self.text(struct.unpack(">HH", self._at(m, 12))[0]) if m else "<clinit>"
                self.inner.append({"inner": self.name, "outer": outer, "modifiers": None})
                self.defining_method = f"{outer}.{method}"

    def _refs(self) -> set[str]:
        """Class names that the constant pool mentions, as classes or within descriptors; arrays count as their elements."""
        out: set[str] = set()
        for tag, v in zip(self.tags, self.pool):
            if tag == 7:
                name = self.text(struct.unpack(">H", v)[0])
                out.update(descriptor_classes(name) if name.startswith("[") else [self.dotted(name)])
            elif tag == 12:
                out.update(descriptor_classes(self.text(struct.unpack(">HH", v)[1])))
            elif tag == 16:
                out.update(descriptor_classes(self.text(struct.unpack(">H", v)[0])))
        out.discard(self.name)
        return out

    def record(self) -> dict:
        head = {k: getattr(self, k) for k in ("minor", "major", "superclass", "interfaces", "is_record", "source_file", "defining_method", "module_name", "inner", "fields", "methods", "params", "annotations", "type_annotations", "defaults", "refs")}
        return {"class_name": self.name, "modifiers": self.flags & ~0x20, "type_signature": self.signature} | head


def parameter_descriptors(desc: str) -> list[str]:
    out, i, end = [], 1, desc.find(")")
    if not desc.startswith("(") or end < 0:
        raise ClassFormatError(f"no method descriptor: {desc}")
    while i < end:
        j = i
        while desc[j] == "[":
            j += 1
        j = desc.index(";", j) + 1 if desc[j] == "L" else j + 1
        out.append(desc[i:j])
        i = j
    return out


def descriptor_classes(desc: str) -> list[str]:
    """Dotted class names in a descriptor."""
    out, i = [], 0
    while (i := desc.find("L", i)) >= 0:
        j = desc.find(";", i)
        if j < 0:
            break
        out.append(desc[i + 1 : j].replace("/", "."))
        i = j + 1
    return out
