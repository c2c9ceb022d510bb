"""Sentence boundaries across languages and scripts.

Blank lines, headings, speaker labels, brackets and quotations are structure and found by shape. What remains are
candidate boundaries: final punctuation of any script, the end of a quotation that holds some, and white space in scripts
that end sentences with it alone. A maximum-entropy model decides about each of them from the tokens around it, case,
length, digits and script. It starts from nothing: there are no word lists and no weights but those learned. Reliable
boundaries train it: candidates at blank lines, candidates before a lower-case letter, and words of which enough is seen
to tell whether they ever end a paragraph.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

#: Documents that the classifier is fitted on, the first by a hash of their id, and the longest of these that are taken.
SAMPLE_DOCS, SAMPLE_CHARS = 3000, 20_000
#: A word with so many candidates of which none ends a paragraph ends no sentence, if at least one in so many would.
TYPE_COUNT = 25
#: A word that ends so many paragraphs, and one in USUAL of its candidates, is taken to end sentences.
ENDS, USUAL = 3, 20
#: Words with fewer candidates are known by their shape only.
KNOWN = 4
#: White space is learned from the ends of blocks this long: shorter ones may be headings or labels.
PARAGRAPH = 80
#: Decisions that a task remembers.
MEMORY = 400_000

#: What Unicode has as the end of a sentence, but for the marks that also end abbreviations or stand for a break.
_STERM = "".join(regex.findall(r"\p{STerm}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))))
_WEAK = ".．｡…"
_ENDS = _STERM + "…．｡"

BLANK = regex.compile(r"[^\S\n]*\n(?:[^\S\n]*\n)+\s*")
OPEN = {"(": ")", "[": "]", "（": "）", "［": "］", "【": "】", "{": "}"}
QUOTES = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", '"': '"', "‹": "›", "〈": "〉", "《": "》", "＂": "＂"}
_MARKS = r"()\[\]（）［］【】{}“”„«»「」『』\"‹›〈〉《》＂"
_FINAL = re.escape(_ENDS) + ";;"
#: A mark, or a run of what may end a sentence; one set to begin with, which the search is fastest for.
_PLAIN_EVENT = re.compile(f"[{_MARKS}{_FINAL}](?:(?<=[{_FINAL}])[{_FINAL}]+)?")
_THAI_CHAR = re.compile("[\u0e00-\u0e7f]")
#: In Thai white space may end a sentence too.
_EVENT = regex.compile(rf"[{_MARKS}]|[{_FINAL}]+|(?<=\p{{Thai}}|[)\d])\s+(?=[\p{{Thai}}(\[])")
_TERMINAL = re.compile(f"[{re.escape(_ENDS)}]$")
_SURE = frozenset(_STERM) - frozenset(_WEAK)
_SPACE = regex.compile(r"\s*")
_SKIP = regex.compile(r"[\s\p{Cf}\p{Pi}\p{Ps}\p{Pf}\"'¿¡–—-]*")
#: Matched backwards from where it ends.
_TOKEN_BEFORE = regex.compile(r"(?r)[\p{L}\p{M}\p{N}\p{Cf}.’'§-]+")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}\p{Cf}’'-]+")
_LABEL = regex.compile(r"[^:：\n]{1,90}?(?:\n[^:：\n]{1,60}?)?\s?[:：]")
_PARTY = regex.compile(r"\s*[(（][^()（）]*[)）]")
_NO_LABEL = re.compile(f"[{re.escape(''.join(sorted(_SURE)))}…;,，、()（）\\[\\]“”„«»「」\"]")
_LABEL_WORD = regex.compile(r"[\p{L}\p{M}\p{N}’'.○-]+")
_NUMBERING = regex.compile(r"(?:\p{L}[\p{L}\p{M}]*[.]?\s?){0,2}第?\s?\d+\s?[\p{L}\p{M}]{0,6}[.。]\s*")
_BRACKET = regex.compile(r"[(\[（［]")
_COLON = regex.compile(r"[:：]\s*")
_QUOTE_END = re.compile(f"[{re.escape(_ENDS)}]\\s*$")
_GREEK = regex.compile(r"\p{Greek}")
_CF = regex.compile(r"\p{Cf}+")
_THAI_END = regex.compile(r"\p{Thai}$")
_PLAIN_WORD = re.compile(r"[^\W\d_]+")
_SCRIPTS = regex.compile(r"(?P<latin>\p{Latin})|(?P<greek>\p{Greek})|(?P<cyrillic>\p{Cyrillic})|(?P<thai>\p{Thai})|(?P<cjk>[\p{Han}\p{Hiragana}\p{Katakana}])|(?P<other>\p{L})")

#: Lower-case words that a speaker's label may hold. Fixed values.
LABEL_WORDS = frozenset(
    """le la les el los las señor señora monsieur madame président présidente presidente presidenta vice speaker κ κα κος der die das of the
    von van de du des del di da and und et y""".split()
)


class Context(NamedTuple):
    """What the model sees of a candidate."""

    #: period, sure (a mark that is nothing else), ellipsis, quote (its closing mark), semicolon (Greek) or space (Thai).
    kind: str
    #: The word before, without invisible characters; before a number, ``before`` is the word before that.
    word: str
    before: str
    #: What follows: upper, lower, digit, other or end; and its first word where case says nothing or a number stands before.
    next: str
    next_word: str
    #: No white space follows, or another period does so after one letter; the word is the first of its block.
    glued: int
    first: bool


class Candidate(NamedTuple):
    """A possible boundary: ``end`` is where the unit would end; a forced one is the end of its block."""

    end: int
    context: Context
    forced: bool


def token_of(c: Context) -> str:
    """What the word is counted by: numbers by the word before them."""
    if c.kind in ("quote", "semicolon"):
        return c.kind
    if c.word[-1:].isdigit() and c.kind != "space":
        return "#" + c.before.lower()
    if c.kind == "space":
        return c.word[-3:] if _THAI_END.search(c.word) else c.word[-1:]
    return c.word.lower()


def _bucket(n: int) -> str:
    return str(n) if n < 4 else "4" if n < 6 else "6" if n < 9 else "9"


def _usage(word: str, usage: dict[str, tuple[int, int]], own: int) -> str:
    """How often the sample has the word with a period, of all its occurrences but ``own``; of a rare one nothing is known."""
    n, dotted = usage.get(word, (0, 0))
    n, dotted = n - own, dotted - own
    return f"{min(4, 5 * dotted // n)}" if n >= KNOWN else ""


def features(c: Context, usage: dict[str, tuple[int, int]] = {}, own: int = 0) -> tuple[str, ...]:  # noqa: B006  never written
    """Names of the features that hold: neighbouring tokens, case, length, digits, script, and use without a period.

    ``own`` is 1 for a candidate of the sample itself, which then doesn't count for its word's use.
    """
    word, k = c.word, c.kind
    out = [k, f"{k}&{c.next}"]
    if k == "sure":
        return (*out, f"{k}&glued{c.glued}")
    m = _SCRIPTS.match(word[-1:])
    script = m.lastgroup if m else "digit" if word[-1:].isdigit() else "none"
    out += [f"{k}&{script}", f"{k}&{script}&{c.next}"]
    if k in ("quote", "semicolon"):
        return (*out, f"{k}&next={c.next_word}") if c.next_word else tuple(out)
    token = token_of(c)
    out += [f"w={token}", f"w={token}&{c.next}"]
    if k == "space":
        return (*out, f"end={token[-2:]}", f"end={token[-1:]}")
    if script == "digit":
        n = len(word)
        whole = "whole" if word.isdigit() else "part"
        out += [f"number{min(n, 4)}&{whole}", f"number&{whole}&{c.next}", f"number&first={c.first}"]
        if c.next_word:
            out.append(f"number&next={c.next_word}")
        return tuple(out)
    case = "initial" if len(word) == 1 and word.isupper() else "upper" if word.isupper() else "title" if word[:1].isupper() else "lower"
    length = _bucket(len(word))
    out += [f"{k}&len{length}", f"{k}&len{length}&{c.next}", f"{k}&{script}&len{length}", f"{k}&{case}&len{length}", f"glued{c.glued}", f"glued{c.glued}&{c.next}"]
    if not any(x in "aeiouyáéíóúàèìòùâêîôûäöüαεηιουωάέήίόύώ" for x in word.lower()) and script in ("latin", "greek"):
        out.append(f"no vowel&{c.next}")
    if "." in word:
        out += ["inner", f"inner&{c.next}"]
    elif k == "period":
        use = _usage(token, usage, own)
        if use:
            out += [f"use{use}", f"use{use}&{c.next}", f"use{use}&{case}"]
    if c.next_word:
        out.append(f"next={c.next_word}")
    return tuple(out)


def _events(text: str, lo: int, hi: int) -> list:
    """Matches of brackets, quotation marks and what may end a sentence, in order."""
    return list((_EVENT if _THAI_CHAR.search(text, lo, hi) else _PLAIN_EVENT).finditer(text, lo, hi))


def _pairs(events: list) -> list[tuple[int, int, bool]]:
    """(start, end, is_bracket) of the outermost brackets and quotations in order; what is left open is no pair."""
    out: list[tuple[int, int, bool]] = []
    stack: list[tuple[str, int]] = []
    closers = ")]）］】}”“»」』\"›〉》＂"
    for m in events:
        c = m.group()
        if len(c) != 1 or (c not in OPEN and c not in QUOTES and c not in closers):
            continue
        at = next((k for k in range(len(stack) - 1, -1, -1) if c in (OPEN.get(stack[k][0]) or QUOTES[stack[k][0]])), None)
        if at is not None and not (c == "“" and stack[at][0] != "„"):
            start = stack[at][1]
            opener = stack[at][0]
            del stack[at:]
            while out and out[-1][0] > start:
                out.pop()
            out.append((start, m.end(), opener in OPEN))
        elif c in OPEN or c in QUOTES:
            stack.append((c, m.start()))
    return out


def _outer(pairs: list[tuple[int, int, bool]]) -> list[tuple[int, int, bool]]:
    out: list[tuple[int, int, bool]] = []
    for p in sorted(pairs):
        if not out or p[0] >= out[-1][1]:
            out.append(p)
    return out


def _kind(text: str, i: int, hi: int) -> str:
    if i >= hi:
        return "end"
    c = text[i]
    if c.islower():
        return "lower"
    if c.isupper() or c.istitle():
        return "upper"
    return "digit" if c.isdigit() else "other"


def _ahead(text: str, i: int, hi: int, brackets: dict[int, int]) -> int:
    """Position of the first letter or digit from i on, past brackets, opening quotes and white space."""
    if i + 1 < hi and text[i] == " " and text[i + 1].isalnum():
        return i + 1
    while True:
        i = _SKIP_SPACE(text, i, hi)
        if i in brackets:
            i = brackets[i]
            continue
        j = _SKIP.match(text, i, hi).end()
        for k in range(i, j):
            if k in brackets:
                i = k
                break
        else:
            return j


def _SKIP_SPACE(text: str, i: int, hi: int) -> int:
    return _SPACE.match(text, i, hi).end()


def label_end(text: str, lo: int, hi: int, cuts: list[int] = ()) -> int | None:
    """End of a speaker label at the start of a block, its colon included; None if there is none, or a cut lies within."""
    m = _LABEL.match(text, lo, hi)
    if not m or any(lo < c < m.end() for c in cuts):
        return None
    name = _PARTY.sub("", m.group()[:-1]).strip()
    after = _SPACE.match(text, m.end(), hi).end()
    if after < hi and text[after] in QUOTES:
        return None
    if not name or _NO_LABEL.search(name) or name[0].isdigit():
        return None
    words = _LABEL_WORD.findall(name)
    if not words or any(w[0].isdigit() for w in words):
        return None
    for w in words:
        if w[0].islower() and w.rstrip(".").lower() not in LABEL_WORDS:
            return None
    if not any(c.isupper() for c in name) and len(name) > 40:
        return None
    return m.end()


def numbering_end(text: str, lo: int, hi: int) -> int:
    """End of the number that a block begins with, or ``lo``."""
    m = _NUMBERING.match(text, lo, hi)
    return m.end() if m else lo


def is_heading(text: str, lo: int, hi: int, cuts: list[int] = ()) -> bool:
    """A block without final punctuation at its end, and without a boundary inside but for one after its number."""
    if _TERMINAL.search(text[hi - 1 : hi]) or text[hi - 1] in ":：;；)）]］\"”»」":
        return False
    at = numbering_end(text, lo, hi)
    if at == lo and _BRACKET.search(text, lo, hi):
        return False
    if any(at < c < hi for c in cuts):
        return False
    colon = _COLON.search(text, at, hi)
    if colon and at == lo:
        # "ORDER OF THE DAY: bridge repairs" is one; "Mr. Rosin: I beg to move" isn't.
        head = text[lo : colon.start()]
        return text[colon.end() : colon.end() + 1].islower() and head.isupper() and len(head.split()) > 2
    return at > lo or not colon


def candidates(text: str, lo: int, hi: int) -> tuple[list[Candidate], list[tuple[int, int]]]:
    """Possible boundaries of a block in order, and its outermost brackets."""
    events = _events(text, lo, hi)
    outer = _outer(_pairs(events))
    brackets = {a: b for a, b, is_bracket in outer if is_bracket}
    out: list[Candidate] = []
    spans = iter(outer + [(hi + 1, hi + 1, True)])
    a, b, is_bracket = next(spans)
    for m in events:
        c, i = m.group(), m.start()
        while i >= b:
            a, b, is_bracket = next(spans)
        if a <= i:
            # The last closing mark of a quotation: a boundary may follow if the quotation ends in final punctuation.
            if is_bracket or m.end() != b or not _QUOTE_END.search(text[a : b - 1]):
                continue
            j = _ahead(text, b, hi, brackets)
            if b < hi and (text[b] in ",;:，；、：" or text[b] in _ENDS):
                continue
            k = _kind(text, j, hi)
            spaced = b >= hi or text[b].isspace() or b in brackets
            if spaced or k == "end":
                gap = _SPACE.match(text, b, hi).end()
                dash = gap < hi and text[gap] in "–—-"
                out.append(Candidate(b, Context("quote", text[b - 2 : b - 1], "", "lower" if dash else k, _word(text, j, hi)[:1] if k == "other" else "", int(not spaced), False), j >= hi))
            continue
        if c[0].isspace():
            out.append(Candidate(i, Context("space", text[max(lo, i - 4) : i], "", "bracket" if m.end() in brackets else "other", "", 0, False), False))
            continue
        if c in QUOTES or c[0] in "()[]（）［］【】{}”»」』›〉》":
            continue
        end = m.end()
        nxt = text[end] if end < hi else ""
        if nxt.isdigit() and c[-1] in ".．":
            continue  # within a number, or No.5
        if nxt in ",，、:：" and nxt:
            continue
        if c[-1] in ";;":
            before = _WORD.findall(text[max(lo, i - 20) : i])
            if c[-1] == ";" or (before and _GREEK.search(before[-1])):
                j = _ahead(text, end, hi, brackets)
                out.append(Candidate(end, Context("semicolon", "", "", _kind(text, j, hi), "", 0, False), j >= hi))
            continue
        j = _ahead(text, end, hi, brackets)
        out.append(_period(text, lo, hi, i, end, j, brackets))
    return out, sorted(brackets.items())


def _word(text: str, j: int, hi: int) -> str:
    m = _WORD.match(text, j, min(hi, j + 30))
    return m.group().lower() if m else ""


def _period(text: str, lo: int, hi: int, i: int, end: int, j: int, brackets: dict[int, int]) -> Candidate:
    c, kind = text[i:end], _kind(text, j, hi)
    glued = 0
    if end < hi and not text[end].isspace() and end not in brackets:
        glued = 2 if text[end + 1 : end + 2] == "." else 1
    if not _SURE.isdisjoint(c):
        return Candidate(end, Context("sure", "", "", kind, "", min(glued, 1), False), j >= hi)
    m = _TOKEN_BEFORE.match(text, max(lo, i - 30), i)
    word = m.group() if m else ""
    if not word.isascii():
        word = _CF.sub("", word)
    if not word.isalnum():
        word = word.strip("'’-").replace("’", "'").replace("-", "'").rsplit("'", 1)[-1]  # l’art. is art.
    dots = "…" in c or c.startswith("..")
    before = ""
    if word[-1:].isdigit():
        prev = _WORD.findall(text[max(lo, m.start() - 25) : m.start()])
        before = prev[-1].lower() if prev else ""
        if text[: m.start()].rstrip()[-1:] in _WEAK and before:
            before += "."
    follows = _word(text, j, hi) if kind == "other" or before else ""
    if follows and _SCRIPTS.match(follows) and _SCRIPTS.match(follows).lastgroup in ("cjk", "thai"):
        follows = follows[:1]
    return Candidate(end, Context("ellipsis" if dots else "period", word[-1:] if dots else word, before, kind, follows, glued, m is not None and m.start() <= lo), j >= hi)


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Trimmed spans between blank lines."""
    lo = 0
    for m in [*BLANK.finditer(text), None]:
        hi = m.start() if m else len(text)
        a = _SPACE.match(text, lo, hi).end()
        while hi > a and text[hi - 1].isspace():
            hi -= 1
        if a < hi:
            yield a, hi
        lo = m.end() if m else hi


class Model:
    """Weights by feature name; a feature it doesn't know counts nothing, and what it knows nothing of is a boundary."""

    def __init__(self, weights: dict[str, float], usage: dict[str, tuple[int, int]] | None = None):
        self.weights, self.usage = weights, usage or {}
        self._known: dict[Context, bool] = {}

    def score(self, context: Context) -> float:
        w = self.weights
        return sum(w.get(f, 0.0) for f in features(context, self.usage))

    def ends(self, context: Context) -> bool:
        """Whether a candidate is a boundary."""
        known = self._known.get(context)
        if known is None:
            if len(self._known) >= MEMORY:
                self._known.clear()
            known = self._known[context] = self.score(context) >= 0
        return known

    @classmethod
    def fit(cls, texts: list[str], *, rounds: int = 80, strength: float = 0.5, rate: float = 0.5) -> Model:
        """Maximum entropy with a Gaussian prior around nothing, on the boundaries that need no judgement.

        A candidate before a blank line is one, with what the next block begins with as what follows. One before a
        lower-case letter is none, nor is one after the number that a heading begins with. Of the others, those of a word
        that never ends a paragraph in ``TYPE_COUNT`` tries or more are none, and those of a word that often does are ones
        unless what follows never begins a paragraph. Candidates that none of this tells about are not used.
        """
        seen: list[tuple[Context, bool | None]] = []
        starts: Counter[str] = Counter()
        for t in texts:
            bs = list(blocks(t))
            for n, (lo, hi) in enumerate(bs):
                starts[_word(t, _ahead(t, lo, hi, {}), hi)[:1]] += 1
                start = label_end(t, lo, hi) or lo
                numbered = numbering_end(t, lo, hi) if is_heading(t, lo, hi) else lo
                follow = bs[n + 1] if n + 1 < len(bs) else None
                kind, word = "upper", ""
                if follow:
                    j = _ahead(t, *follow, {})
                    kind, word = _kind(t, j, follow[1]), _word(t, j, follow[1])[:1]
                for c in candidates(t, start, hi)[0]:
                    x = c.context
                    if c.forced:
                        seen.append((x._replace(next=kind if kind != "end" else "upper", next_word=word if kind == "other" else "", glued=0), True))
                    elif c.end <= numbered or x.next == "lower":
                        seen.append((x, False))
                    else:
                        seen.append((x, None))
                if hi - start >= PARAGRAPH and _THAI_END.search(t[hi - 1 : hi]):
                    seen.append((Context("space", t[max(lo, hi - 4) : hi], "", "other", "", 0, False), True))
        total = Counter(token_of(x) for x, _ in seen if x.kind != "sure")
        final = Counter(token_of(x) for x, last in seen if last and x.kind != "sure")
        words = Counter(w for t in texts for w in _PLAIN_WORD.findall(t.lower()))
        dotted = Counter(x.word.lower() for x, _ in seen if x.kind == "period")
        usage = {w: (words[w], n) for w, n in dotted.items()} | {w: (n, dotted[w]) for w, n in words.items() if n >= KNOWN}
        rows: Counter[tuple[tuple[str, ...], bool]] = Counter()
        for x, last in seen:
            if x.kind == "sure" and last is None:
                last = True
            if last is None:
                n, k = total[token_of(x)], final[token_of(x)]
                if x.next_word and not starts[x.next_word[:1]] and len(starts) >= TYPE_COUNT:
                    last = False
                elif n >= TYPE_COUNT and not k:
                    last = False
                elif k >= ENDS and k * USUAL >= n and x.kind != "quote":
                    last = True
                else:
                    continue
            known = features(x, usage, 1)
            if total[token_of(x)] < KNOWN:
                known = tuple(f for f in known if not f.startswith("w="))
            rows[known, last] += 1
        if not rows:
            return cls({})
        names = {f: i for i, f in enumerate(dict.fromkeys(f for fs, _ in rows for f in fs))}
        flat = np.fromiter((names[f] for fs, _ in rows for f in fs), np.int64)
        row = np.repeat(np.arange(len(rows)), [len(fs) for fs, _ in rows])
        y, times = np.array([v for _, v in rows], float), np.array(list(rows.values()), float)
        w, adapt = np.zeros(len(names)), np.full(len(names), 1e-8)
        for _ in range(rounds):
            z = np.bincount(row, w[flat], len(rows))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            g = np.bincount(flat, (times * (p - y))[row], len(names)) + strength * w
            adapt += g * g
            w -= rate * g / np.sqrt(adapt)
        return cls(dict(zip(names, w.tolist())), usage)


def units(text: str, model: Model) -> Iterator[tuple[int, int]]:
    """(start, end) of the sentence units of a text in order, without outer white space, in code points."""
    for lo, hi in blocks(text):
        cands, brackets = candidates(text, lo, hi)
        cuts = [c.end for c in cands if c.forced or model.ends(c.context)]
        if is_heading(text, lo, hi, cuts):
            yield lo, hi
            continue
        at = label_end(text, lo, hi, cuts)
        if at is not None:
            yield lo, at
            lo = _SPACE.match(text, at, hi).end()
            if lo >= hi:
                continue
        start, inside = lo, dict(brackets)
        for cut in [*cuts, hi]:
            if cut <= start:
                continue
            # Brackets at the start of a unit stand between sentences, each by itself.
            while start in inside and inside[start] <= cut or start in inside and cut >= hi:
                end = inside[start]
                yield start, end
                start = _SPACE.match(text, end, hi).end()
            if start < cut:
                end = cut
                while end > start and text[end - 1].isspace():
                    end -= 1
                if end > start:
                    yield start, end
                start = _SPACE.match(text, cut, hi).end()
            while start in inside:
                end = inside[start]
                yield start, end
                start = _SPACE.match(text, end, hi).end()


def fit_model(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS) -> Model:
    """The model of at most ``sample`` documents of at most ``SAMPLE_CHARS``, the first by a hash of their id.

    Hashes are chosen from the ids alone, texts are fetched of these only; of ids that many rows share some rows are taken.
    """
    h = F.xxhash64(F.col(doc_id), F.lit(11))
    last = docs.select(h.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return Model({})
    few = docs.where((h <= last) & F.length(text).between(1, SAMPLE_CHARS)).select(F.col(text).alias("t"), h.alias("h"))
    return Model.fit([r.t for r in few.orderBy("h", "t").limit(sample).collect()])


def split_sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, model: Model | None = None, with_text: bool = True) -> DataFrame:
    """(doc_id, ord, start_pos, end_pos, sentence): the units of each whole text in order; without ``with_text`` no sentence.

    Positions are code points from 0, the end exclusive; the units cover all of the text but white space. A heading, a
    speaker label, and a bracket between sentences are units. Null, empty and blank texts have none; a text without any
    boundary is one unit. Each document is split by itself, without a shuffle.
    """
    fitted = model or fit_model(docs, doc_id, text)
    shared = docs.sparkSession.sparkContext.broadcast((fitted.weights, fitted.usage))
    ddl = "doc_id bigint, ord int, start_pos int, end_pos int" + (", sentence string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        columns = [("doc_id", pa.int64()), ("ord", pa.int32()), ("start_pos", pa.int32()), ("end_pos", pa.int32())]
        schema = pa.schema(columns + ([("sentence", pa.string())] if with_text else []))
        for batch in batches:
            rows: list[tuple] = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t:
                    rows.extend((d, k, a, b, *((t[a:b],) if with_text else ())) for k, (a, b) in enumerate(units(t, m)))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, ddl)
