"""Personal data with offsets: exact patterns on the source, and the same patterns after offset-preserving deobfuscation.

The transducers rewrite disguises one after the other and keep what they replaced; a match on the rewritten text is mapped
back through their edits and reported as the source span of its characters.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from meterlake.llm.common import id_and_text, slices, whole_row

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits begins, as the first part takes the whole run.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LONG_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9]){12}")

Span = tuple[str, int, int]


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """True if the check digit of ``digits`` is right."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def find_plain(text: str) -> list[Span]:
    """(kind, start, end) by kind and start: leftmost non-overlapping matches of each kind that pass its test.

    An e-mail is found from its at sign backwards, so that long runs without one cost nothing.
    """
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", begin, free := m.end()))
        at = text.find("@", at + 1)
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split("."))]
    if _LONG_RUN.search(text):
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# Letters of other scripts that look like Latin ones, in alphabets' order.
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ɡ": "g", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "З": "3",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
#: Characters without a width, which are left out.
_UNSEEN = frozenset("­​‌‍⁠﻿")
# Digit words of English, German, French and Spanish.
_DIGIT_WORDS = {
    word: str(digit)
    for digit, words in enumerate(["zero oh null zéro cero", "one eins un uno", "two zwei zwo deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve"])
    for word in words.split()
}

_STRANGE = re.compile("[" + "".join(map(re.escape, [*_LOOKALIKES, *_UNSEEN])) + "！-～٠-٩۰-۹०-९]")
_NUMBER = "(?:" + "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)) + ")"
_BETWEEN = "(?:dot|point|punkt|punto)"
_GAP = r"[\x20,-]{1,2}"
#: Digits in words: four or more in a row, each a word of its own; "plus" may stand before them, "dot" between them.
_SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:(?:plus|más){_GAP})?(?:{_NUMBER}|[0-9]+)(?:{_GAP}(?:{_BETWEEN}{_GAP})?(?:{_NUMBER}|[0-9]+)){{3,}}(?![^\W_])")
_SPELLED_PART = re.compile(rf"(?i)plus|más|{_BETWEEN}|{_NUMBER}|[0-9]+")
#: A digit word beside another or beside figures, which any such run with a word has.
_HAS_NUMBER = re.compile(rf"(?i){_NUMBER}{_GAP}(?:{_BETWEEN}{_GAP})?(?:{_NUMBER}|[0-9])|[0-9]{_GAP}(?:{_BETWEEN}{_GAP})?{_NUMBER}")
#: Signs in brackets anywhere; as plain words or beside blanks only inside a whole address.
_BRACKETED = re.compile(r"(?i)[\x20]{0,2}[\[({<][\x20]?(at|ät|@|dot|punkt|punto|arroba|arr?obase|period|point|\.)[\x20]?[\])}>][\x20]{0,2}")


def _worded(at: str, dot: str, but: str = "") -> str:
    """An address with the words ``at`` and ``dot`` and any number of dots; it ends in two or more letters of one case, and www is a host.

    A match can't begin behind a dot in words, and what stands before the at sign is taken whole or not at all, so a long
    chain of words and dots is gone through once.
    """
    cut = rf"(?:\.|[\x20](?:{dot})[\x20])"
    begin = "".join(rf"(?<![a-z0-9_%+-][\x20]{d}[\x20])" for d in dot.split("|"))
    return (
        rf"(?<![A-Za-z0-9._%+-]){begin}[a-z0-9_%+-]++(?:{cut}[a-z0-9_%+-]++)*+(?:[\x20](?:{at})[\x20]|[\x20]?@[\x20]?)(?!www\.){but}[a-z0-9-]+"
        rf"(?:{cut}[a-z0-9-]+)*{cut}(?-i:[a-z]{{2,}}|[A-Z]{{2,}})(?![A-Za-z0-9-])"
    )


#: "at the dot on ..." is prose unless a common ending follows.
_PROSE = r"(?!(?:the|an?|this|that|each|every)[\x20]dot[\x20](?!(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|co)(?![A-Za-z0-9-])))"
#: "point" goes with the French at sign only: "at this point in" is prose.
_WORDED = re.compile("(?i)" + "|".join([_worded("at|ät", "dot|punkt", _PROSE), _worded("arr?obase", "point"), _worded("arroba", "punto")]))
_WORDED_SIGN = re.compile(r"(?i)[\x20](?:dot|punkt|point|punto|at|ät|arroba|arr?obase)[\x20]|[\x20]?@[\x20]?")
#: What every match of _WORDED holds: an at sign, the first part of a domain and what cuts it off.
_AT_SIGN = re.compile(r"(?i)(?:[\x20](?:[aä]t|arroba|arr?obase)[\x20]|@[\x20]?)[a-z0-9-]+(?:\.|[\x20](?:dot|punkt|point|punto)[\x20])")
_WORDS = re.compile(r"[^\W_]+")
_BESIDE = frozenset([*_DIGIT_WORDS, "dot", "point", "punkt", "punto"])


def _may_spell(text: str) -> bool:
    """False only if no digit word of ``text`` stands beside another, a sign between them, or figures."""
    words = _WORDS.findall(text.casefold())
    if _DIGIT_WORDS.keys().isdisjoint(words):
        return False
    near = lambda w: w in _BESIDE or "0" <= w[0] <= "9"
    return any(a in _DIGIT_WORDS and near(b) or b in _DIGIT_WORDS and near(a) for a, b in zip(words, words[1:]))


#: Edits of a rewritten text, ascending: its start and end in the new text, and in the old.
Edits = tuple[list[int], list[int], list[int], list[int]]


def _rewrite(text: str, edits: list[tuple[int, int, str]]) -> tuple[str, Edits]:
    """Replaces spans of a text; only the edits are kept, so a long text with few disguises costs little."""
    parts, at, here = [], 0, 0
    new_start, new_end, old_start, old_end = [], [], [], []
    for begin, end, new in edits:
        parts += [text[at:begin], new]
        here += begin - at
        new_start.append(here)
        here += len(new)
        new_end.append(here)
        old_start.append(begin)
        old_end.append(end)
        at = end
    return "".join([*parts, text[at:]]), (new_start, new_end, old_start, old_end)


def _before(edits: Edits, begin: int, end: int) -> tuple[int, int]:
    """The span of the old text that a span of the new one stands for; a replaced span counts as a whole."""
    new_start, new_end, old_start, old_end = edits

    def place(at: int, whole: list[int], after: int) -> int:
        k = bisect_right(new_start, at) - 1
        return at + after if k < 0 else whole[k] if at < new_end[k] else at + after + old_end[k] - new_end[k]

    return place(begin, old_start, 0), place(end - 1, old_end, 1)


def _plain_letters(text: str) -> tuple[str, Edits]:
    def plain(c: str) -> str:
        if c in _UNSEEN:
            return ""
        if "！" <= c <= "～":
            return chr(ord(c) - 0xFEE0)
        return _LOOKALIKES[c] if c in _LOOKALIKES else str(int(c))

    return _rewrite(text, [(m.start(), m.end(), plain(m[0])) for m in _STRANGE.finditer(text)])


def _digits_from_words(text: str) -> tuple[str, Edits]:
    edits = []
    for m in _SPELLED.finditer(text):
        if not _HAS_NUMBER.search(m[0]):
            continue
        at = m.start()
        for part in _SPELLED_PART.finditer(text, m.start(), m.end()):
            word = part[0].lower()
            if part.start() > at:
                edits.append((at, part.start(), ""))
            edits.append((part.start(), part.end(), {"plus": "+", "más": "+", "dot": ".", "point": ".", "punkt": ".", "punto": "."}.get(word) or _DIGIT_WORDS.get(word, word)))
            at = part.end()
    return _rewrite(text, edits)


def _sign(word: str) -> str:
    return "@" if word in ("at", "ät", "@", "arroba", "arobase", "arrobase") else "."


def _signs_from_brackets(text: str) -> tuple[str, Edits]:
    return _rewrite(text, [(m.start(), m.end(), _sign(m[1].lower())) for m in _BRACKETED.finditer(text)])


def _signs_from_words(text: str) -> tuple[str, Edits]:
    return _rewrite(text, [(w.start(), w.end(), _sign(w[0].strip().lower())) for m in _WORDED.finditer(text) for w in _WORDED_SIGN.finditer(text, m.start(), m.end())])


def find_all(text: str) -> tuple[list[Span], list[Span]]:
    """(base, all): plain spans, and those plus what deobfuscation adds; an added span never overlaps another of its
    kind. Spans are code-point offsets of the source, ordered by kind and start."""
    base = find_plain(text)
    strange, spelled, signed = _STRANGE.search(text), _may_spell(text) and _HAS_NUMBER.search(text), _BRACKETED.search(text) or _AT_SIGN.search(text) and _WORDED.search(text)
    if not (strange or spelled or signed):
        return base, base
    rewritten, levels = text, []
    for rewrite in (_plain_letters, _digits_from_words, _signs_from_brackets, _signs_from_words):
        rewritten, edits = rewrite(rewritten)
        levels.append(edits)
    plain = {kind: [s[1:] for s in base if s[0] == kind] for kind in KINDS}
    added, free = [], dict.fromkeys(KINDS, 0)
    for kind, begin, end in find_plain(rewritten):
        for edits in reversed(levels):
            begin, end = _before(edits, begin, end)
        at = bisect_right(plain[kind], (end,))  # plain spans of the kind that begin before this one ends
        if begin >= free[kind] and (not at or plain[kind][at - 1][1] <= begin):
            added.append((kind, begin, end))
            free[kind] = end
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1:]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; spans that overlap are replaced together, by all their kinds."""
    out, at, kinds = [], 0, []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if kinds and a < at:
            kinds += [kind] * (kind not in kinds)
            at = max(at, b)
            continue
        out += [f"[{'+'.join(kinds).upper()}]"] * bool(kinds)
        out.append(text[at:a])
        kinds, at = [kind], b
    out += [f"[{'+'.join(kinds).upper()}]"] * bool(kinds)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs`` (doc_id, text). Narrow.

    The counts and ``base_sha256`` are of the plain spans, ``spans`` lists all. Null and empty texts have none; null ids
    are kept; repeated rows give one row each; an empty table gives none; other columns are ignored.
    """

    def run(batches):
        for batch in slices(batches):
            pairs = [find_all(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in pairs], pa.int64()) for k in KINDS]
            sha = [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sha), pa.array([listed(a) for _, a in pairs], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind; ``n_chars``, if there, is counted anew. A null text stays null."""

    def run(batches):
        for batch in slices(batches):
            texts = [None if t is None else redact(t, find_all(t)[1]) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(1)], ["redacted", "row"])

    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select("text", F.struct(whole_row(docs, rest).alias("rest") if rest else F.lit(0).alias("rest")).alias("row"))
    done = packed.mapInArrow(run, StructType().add("redacted", StringType()).add("row", packed.schema["row"].dataType))
    own = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast(docs.schema["n_chars"].dataType) if "n_chars" in rest else None}
    return done.select(*((own[c] if c in own else F.col("row.rest").getField(c)).alias(c) for c in docs.columns))
