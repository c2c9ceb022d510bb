"""Generic signatures: parsing to plain trees, rendering, erasure and substitution of type variables.

Nodes are dicts: base {"k": "base", "name"}, class {"k": "class", "name", "args", "suffixes"}, array {"k": "array", "dims",
"elt"}, var {"k": "var", "name"}; an argument is {"w": one of "*", "+", "-", "=", "t"}; a parameter {"name", "cb", "ib"}.
"""

from __future__ import annotations

import json

#: Fixed values of the class-file format.
BASE = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}


class SignatureError(ValueError):
    """The text is no signature of the kind asked for."""


class _Cursor:
    def __init__(self, text: str):
        self.s, self.i = text, 0

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def next(self) -> str:
        if self.i >= len(self.s):
            raise SignatureError(f"ends too early: {self.s}")
        self.i += 1
        return self.s[self.i - 1]

    def expect(self, c: str) -> None:
        if self.next() != c:
            raise SignatureError(f"{c} expected at {self.i - 1} in {self.s}")

    def name(self, stop: str) -> str:
        start = self.i
        while self.peek() and self.peek() not in stop:
            self.i += 1
        if self.i == start:
            raise SignatureError(f"a name expected at {start} in {self.s}")
        return self.s[start : self.i].replace("/", ".")

    def done(self) -> None:
        if self.i < len(self.s):
            raise SignatureError(f"{self.s[self.i:]} is left over in {self.s}")


def _args(c: _Cursor) -> list[dict]:
    out = []
    if c.peek() == "<":
        c.next()
        while c.peek() != ">":
            w = c.peek()
            if w == "*":
                c.next()
                out.append({"w": "*", "t": None})
            elif w and w in "+-":
                c.next()
                out.append({"w": w, "t": _reference(c)})
            else:
                out.append({"w": "=", "t": _reference(c)})
        c.next()
    return out


def _class(c: _Cursor) -> dict:
    c.expect("L")
    # A dollar starts a suffix only where a name follows; "$$" or a dollar at the end belong to the name.
    end = min((k for k in (c.s.find(x, c.i) for x in ";<:>") if k >= 0), default=len(c.s))
    plain = c.s[c.i : end]
    whole = "$$" in plain or plain.endswith("$")
    name = c.name(";<:>[" if whole else ";<:>[$.")
    node = {"k": "class", "name": name, "args": _args(c), "suffixes": []}
    while c.peek() and c.peek() in ".$":
        c.next()
        node["suffixes"].append({"name": c.name(";<:>[$."), "args": _args(c)})
    c.expect(";")
    return node


def _reference(c: _Cursor) -> dict:
    k = c.peek()
    if k == "L":
        return _class(c)
    if k == "T":
        c.next()
        node = {"k": "var", "name": c.name(";[<>:")}
        c.expect(";")
        return node
    if k == "[":
        dims = 0
        while c.peek() == "[":
            c.next()
            dims += 1
        return {"k": "array", "dims": dims, "elt": _type(c)}
    raise SignatureError(f"a reference type expected at {c.i} in {c.s}")


def _type(c: _Cursor) -> dict:
    if c.peek() and c.peek() in BASE:
        return {"k": "base", "name": BASE[c.next()]}
    return _reference(c)


def _params(c: _Cursor) -> list[dict]:
    out = []
    if c.peek() == "<":
        c.next()
        while c.peek() != ">":
            p = {"name": c.name(":;<>["), "cb": None, "ib": []}
            c.expect(":")
            if c.peek() and c.peek() in "LT[":
                p["cb"] = _reference(c)
            while c.peek() == ":":
                c.next()
                p["ib"].append(_reference(c))
            out.append(p)
        c.next()
    return out


def _throws(c: _Cursor) -> list[dict]:
    out = []
    while c.peek() == "^":
        c.next()
        out.append(_reference(c))
    return out


def parse_type(text: str) -> dict:
    c = _Cursor(text)
    out = _type(c)
    c.done()
    return out


def parse_class(text: str) -> dict:
    """{"params", "superclass", "interfaces", "throws"}; some compilers add throws to a class, which is let pass."""
    c = _Cursor(text)
    out = {"params": _params(c), "superclass": _class(c), "interfaces": []}
    while c.peek() == "L":
        out["interfaces"].append(_class(c))
    out["throws"] = _throws(c)
    c.done()
    return out


def parse_method(text: str) -> dict:
    """{"params", "args", "result", "throws"}; ``<init>`` stands for a method without arguments or result."""
    if text == "<init>":
        text = "()V"
    c = _Cursor(text)
    out = {"params": _params(c), "args": [], "result": None, "throws": []}
    c.expect("(")
    while c.peek() != ")":
        out["args"].append(_type(c))
    c.next()
    out["result"] = _type(c)
    out["throws"] = _throws(c)
    c.done()
    return out


def to_descriptor(t: dict, bounds: dict[str, dict] | None = None) -> str:
    """Erased descriptor of a type; a variable becomes its bound, or Object."""
    if t["k"] == "base":
        return next(c for c, n in BASE.items() if n == t["name"])
    if t["k"] == "array":
        return "[" * t["dims"] + to_descriptor(t["elt"], bounds)
    if t["k"] == "var":
        b = (bounds or {}).get(t["name"])
        return to_descriptor(b, {k: v for k, v in (bounds or {}).items() if k != t["name"]}) if b else "Ljava/lang/Object;"
    return "L" + "$".join([t["name"].replace(".", "/"), *(s["name"] for s in t["suffixes"])]) + ";"


def to_signature(t: dict) -> str:
    """The signature text of a type node."""
    if t["k"] == "base":
        return to_descriptor(t)
    if t["k"] == "array":
        return "[" * t["dims"] + to_signature(t["elt"])
    if t["k"] == "var":
        return f"T{t['name']};"
    text = "L" + t["name"].replace(".", "/") + _args_text(t["args"])
    for s in t["suffixes"]:
        text += ("." if "<" in text else "$") + s["name"] + _args_text(s["args"])
    return text + ";"


def _args_text(args: list[dict]) -> str:
    return "<" + "".join("*" if a["w"] == "*" else (a["w"] if a["w"] != "=" else "") + to_signature(a["t"]) for a in args) + ">" if args else ""


def render_descriptors(m: dict) -> list[str]:
    """Signature texts of a parsed method's arguments."""
    return [to_signature(a) for a in m["args"]]


def bounds_of(params: list[dict]) -> dict[str, dict]:
    return {p["name"]: p["cb"] or (p["ib"][0] if p["ib"] else None) for p in params if p["cb"] or p["ib"]}


def erase_method(m: dict, class_params: list[dict] = ()) -> str:
    b = bounds_of([*class_params, *m["params"]])
    return "(" + "".join(to_descriptor(a, b) for a in m["args"]) + ")" + to_descriptor(m["result"], b)


def same_ignoring_arguments(a: dict, b: dict) -> bool:
    """Whether two types are of one class, their type arguments aside."""
    return to_descriptor(a) == to_descriptor(b)


def render(t: dict | None, simple: bool = False) -> str:
    """A type as it is written in source, with full or simple names."""
    if t is None:
        return ""
    if t["k"] in ("base", "var"):
        return t["name"]
    if t["k"] == "array":
        return render(t["elt"], simple) + "[]" * t["dims"]
    text = t["name"].rsplit(".", 1)[-1] if simple else t["name"]
    text += _render_args(t["args"], simple)
    for s in t["suffixes"]:
        piece = s["name"] + _render_args(s["args"], simple)
        text = piece if simple else f"{text}${piece}"
    return text


def _render_args(args: list[dict], simple: bool) -> str:
    words = {"*": "?", "+": "? extends ", "-": "? super ", "=": ""}
    return "<" + ", ".join(words[a["w"]] + render(a["t"], simple) for a in args) + ">" if args else ""


def render_params(params: list[dict], simple: bool = False) -> str:
    def one(p: dict) -> str:
        bounds = [b for b in [p["cb"], *p["ib"]] if b and render(b) != "java.lang.Object"]
        return p["name"] + (" extends " + " & ".join(render(b, simple) for b in bounds) if bounds else "")

    return "<" + ", ".join(map(one, params)) + ">" if params else ""


def substitute(t: dict, bindings: dict[str, dict], argument: bool = False) -> dict:
    """A type with variables replaced by type arguments ({"w", "t"}).

    Where no argument may stand, ``? extends X`` gives X, while ``?`` and ``? super X`` leave the variable.
    """
    if t["k"] == "var":
        a = bindings.get(t["name"])
        return a["t"] if a and a["w"] in "=+" and a["t"] else t
    if t["k"] == "array":
        elt = substitute(t["elt"], bindings)
        return {"k": "array", "dims": t["dims"] + elt["dims"], "elt": elt["elt"]} if elt["k"] == "array" else {**t, "elt": elt}
    if t["k"] == "class":
        return {**t, "args": [_argument(a, bindings) for a in t["args"]], "suffixes": [{**s, "args": [_argument(a, bindings) for a in s["args"]]} for s in t["suffixes"]]}
    return t


def _argument(a: dict, bindings: dict[str, dict]) -> dict:
    if a["t"] is None:
        return a
    if a["w"] == "=" and a["t"]["k"] == "var" and a["t"]["name"] in bindings:
        return bindings[a["t"]["name"]]
    return {"w": a["w"], "t": substitute(a["t"], bindings)}


def supertype_bindings(signatures: dict[str, str], start: str) -> dict[str, dict[str, dict]]:
    """For each generic supertype of a class the arguments of its variables, composed down to ``start``.

    ``signatures`` has the class signatures of start and its supertypes; what it lacks ends the walk. Circles end too.
    """
    out: dict[str, dict[str, dict]] = {start: {}}
    todo = [start]
    while todo:
        name = todo.pop()
        try:
            sig = parse_class(signatures[name])
        except (KeyError, SignatureError):
            continue
        for sup in [sig["superclass"], *sig["interfaces"]]:
            sup = substitute(sup, out[name])
            full = "$".join([sup["name"], *(s["name"] for s in sup["suffixes"])])
            if full in out:
                continue
            args = sup["suffixes"][-1]["args"] if sup["suffixes"] else sup["args"]
            try:
                params = parse_class(signatures[full])["params"]
            except (KeyError, SignatureError):
                params = []
            out[full] = {p["name"]: a for p, a in zip(params, args)} if len(params) == len(args) else {}
            todo.append(full)
    return out


def declaring_parameter(name: str, method_params: list[dict], class_params: list[dict]) -> dict:
    """The parameter a variable refers to: of the method, else of the class, else one without bounds."""
    return next((p for p in [*method_params, *class_params] if p["name"] == name), {"name": name, "cb": None, "ib": []})


def to_json(node: dict) -> str:
    return json.dumps(node, separators=(",", ":"), sort_keys=True)
