r"""Personal data: fixed patterns, and a conditional random field over word shapes that adds to them.

The field labels stretches of words around triggers: words with a digit or an @, or a written-out (at) or [at],
and CONTEXT words to either side.  Every kind of span holds a trigger, so words elsewhere are outside.  What the
field finds is kept if it passes the kind's own check and meets no pattern span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hourgrid.llm import crf

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 2
TAGS = ["O", *(f"{b}-{k}" for k in KINDS for b in "BI")]

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TRIGGER = re.compile(r"[0-9@]")
_WRITTEN_AT = re.compile(r"[(\[](?:at|AT|At)[)\]]")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match of these cannot begin inside a run of digits that it does not hold, so runs are tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SHAPES = [(re.compile(p), r) for p, r in ((r"[A-Z]+", "X"), (r"[a-z\x80-\U0010ffff]+", "x"), (r"[0-9]+", "d"))]
_EDGE = ".,;:!?\"'<>|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _address(text: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in text.split(".")))


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, leftmost and non-overlapping per kind, in order."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            out.append((start, 0, host.end()))
            done = host.end()
        at = text.find("@", max(at + 1, done))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _address(m[0])]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _shape(word: str) -> str:
    for pattern, letter in _SHAPES:
        word = pattern.sub(letter, word)
    return word[:24]


def _features(words: list[str]) -> list[list[str]]:
    core = [w.strip(_EDGE) or w for w in words]
    shapes = ["^", *map(_shape, core), "$"]
    out = []
    for i, w in enumerate(core, 1):
        runs = ".".join(str(min(len(r), 9)) for r in re.findall(r"[0-9]+", w)[:6])
        digits = sum(c.isdigit() for c in w)
        s = shapes[i]
        out.append([f"s:{s}", f"r:{s}:{runs}", f"n:{min(digits, 20)}", f"p:{shapes[i - 1]}", f"f:{shapes[i + 1]}", f"ps:{shapes[i - 1]} {s}",
                    f"sf:{s} {shapes[i + 1]}", f"a:{'@' in w}:{bool(_WRITTEN_AT.search(w))}", f"e:{bool(re.search(r'[.][a-z]{2,}$', w))}"])
    return out


def _triggered(word: str) -> bool:
    return bool(_TRIGGER.search(word) or _WRITTEN_AT.search(word))


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Word spans of every stretch around the triggers of a text."""
    words = [m.span() for m in _WORD.finditer(text)]
    hits = [i for i, (a, b) in enumerate(words) if _triggered(text[a:b])]
    out, last = [], -1
    for i in hits:
        a, b = max(0, i - CONTEXT), min(len(words), i + CONTEXT + 1)
        if out and a <= last:
            out[-1] += words[last:b]
        else:
            out.append(words[a:b])
        last = b
    return out


def _valid(kind: int, text: str) -> bool:
    digits = _digits(text)
    if kind == 0:
        return bool(re.fullmatch(r"[^@\s]+\s?(?:@|[(\[][aA][tT][)\]])\s?[^@\s]+[.][^@\s.]+", text))
    if kind == 1:
        return bool(re.fullmatch(r"\[?[0-9]+(?:\.[0-9]+){3}\]?(?::[0-9]+)?", text)) and _address(re.sub(r"[\[\]]|:.*", "", text))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9().\s/-]+[0-9]", text))


def added_spans(model: crf.Chain, texts: list[str], found: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """What the field finds in each text beside the spans already found there."""
    owner, spans = [], []
    for i, text in enumerate(texts):
        for s in stretches(text):
            owner.append(i)
            spans.append(s)
    paths = model.decode([_features([texts[i][a:b] for a, b in s]) for i, s in zip(owner, spans)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, words, path in zip(owner, spans, paths):
        k = 0
        while k < len(path):
            tag = model.tags[path[k]]
            if tag == "O":
                k += 1
                continue
            kind, j = KINDS.index(tag[2:]), k + 1
            while j < len(path) and model.tags[path[j]] == f"I-{KINDS[kind]}":
                j += 1
            a, b = words[k][0], words[j - 1][1]
            while a < b and texts[i][a] in _EDGE:
                a += 1
            while b > a and texts[i][b - 1] in _EDGE:
                b -= 1
            if _valid(kind, texts[i][a:b]) and all(e <= a or b <= s for s, _, e in found[i]):
                out[i].append((a, kind, b))
            k = j
    return out


def labelled_examples(n: int = 700, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """A small labelled table made by rule: words and tags of ``n`` short passages.  Each holds one span in one
    of its written forms, or a number, date, version, price, code or secret that is none."""
    rng = np.random.default_rng(seed)
    pick = lambda *options: options[rng.integers(len(options))]
    number = lambda k, lead=0: "".join(str(rng.integers(lead if i == 0 else 0, 10)) for i in range(k))
    letters = lambda k: "".join(chr(97 + rng.integers(26)) for _ in range(k))

    def plain() -> str:
        w = letters(rng.integers(1, 11))
        return pick(w, w, w, w, w.capitalize(), w.upper(), w + ",", w + ".", w + "é", w + "***", w + "!!", "|")

    def card() -> str:
        head = number(15, 1)
        return next(head + str(c) for c in range(10) if luhn(head + str(c)))

    def email() -> str:
        user = pick(f"{letters(5)}.{number(2)}", letters(6), f"{letters(3)}_{letters(4)}", f"{letters(4)}+{letters(3)}")
        host = pick(f"{letters(5)}.com", f"{letters(4)}{number(1)}.example.org", f"{letters(3)}.{letters(5)}.net")
        return f"{user}{pick('@', '@', '@', '(at)', '[at]', ' (at) ', ' [at] ')}{host}"

    def ip() -> str:
        a = ".".join(str(rng.integers(1, 256)) for _ in range(4))
        return pick(a, a, a + f":{number(4, 1)}", f"[{a}]")

    def grouped() -> str:
        c, sep = card(), pick("", "", " ", "-", ".", "/")
        return sep.join(c[i: i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = number(3, 2), number(3, 2), number(4)
        return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+44 {number(2)} {number(4)} {number(4)}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}")

    def other() -> str:
        code = "".join(pick(*"0123456789abcdef") for _ in range(pick(12, 18, 40)))
        return pick(number(rng.integers(1, 6), 1), f"{number(1)}.{number(1)}", f"{number(1)}.{number(1)}.{number(2)}", f"20{number(2)}-0{number(1, 1)}-1{number(1)}",
                    f"1{number(1)}:{number(2)}", f"${number(2)}.{number(2)}", f"{number(2)},{number(3)}", f"password={code}", f'token = "{code}"', code, f"{number(2)}%",
                    f"{number(2)}-{number(2)}", f"#{number(6)}", f"{letters(2)}{number(3)}", f"@{letters(6)}", f"{number(8)}", f"{number(4)}/{number(2)}", f"{number(3)} {number(3)}")

    out = []
    for _ in range(n):
        words, tags = [], []
        for _ in range(rng.integers(1, 3)):
            for _ in range(rng.integers(0, 4)):
                words.append(plain())
                tags.append("O")
            kind = pick("email", "ip", "card", "phone", None, None, None)
            parts = {"email": email, "ip": ip, "card": grouped, "phone": phone, None: other}[kind]().split(" ")
            parts[-1] += pick("", "", "", ".", ",", "?")
            words += parts
            tags += ["O"] * len(parts) if kind is None else [f"{'I' if i else 'B'}-{kind}" for i in range(len(parts))]
        for _ in range(rng.integers(0, 4)):
            words.append(plain())
            tags.append("O")
        out.append((words, tags))
    return out


def fit_field(examples: list[tuple[list[str], list[str]]]) -> crf.Chain:
    return crf.train([_features(w) for w, _ in examples], [t for _, t in examples], TAGS)


SPAN_TYPE = "array<struct<kind: string, start: long, end: long, base: boolean>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
#: Code points of the texts that are labelled together; one longer text is labelled alone.
GROUP_CHARS = 1 << 20


def _all_spans(model: crf.Chain, texts: list[str]) -> list[list[tuple[int, int, int, bool]]]:
    out: list[list] = [[] for _ in texts]
    marked = [i for i, t in enumerate(texts) if _TRIGGER.search(t) or (("(" in t or "[" in t) and _WRITTEN_AT.search(t))]
    while marked:
        size, group = 0, []
        while marked and (not group or size < GROUP_CHARS):
            group.append(marked.pop())
            size += len(texts[group[-1]])
        some = [texts[i] for i in group]
        base = [pattern_spans(t) for t in some]
        for i, fixed, more in zip(group, base, added_spans(model, some, base)):
            out[i] = sorted([(*s, True) for s in fixed] + [(*s, False) for s in more])
    return out


def redacted(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with every span, and every chain of overlapping spans, replaced by the kind of its first."""
    out, at = [], 0
    for start, kind, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, model: crf.Chain, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id by default) and ``spans``, in order of start and kind, for every row.

    A null text is empty and has no spans.  Offsets are code points of the whole text, end exclusive.  Repeated
    rows are read one by one; columns outside ``keep`` are not read, and ``keep`` must not name spans; an
    empty table gives an empty result.
    """
    keep = ["doc_id"] if keep is None else keep
    picked = docs.select(*[F.col(c) for c in keep], F.col("text").alias("__read"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.drop("__read").schema)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [t or "" for t in part.column("__read").to_pylist()]
            spans = [[{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, k, b, base in s] for s in _all_spans(model, texts)]
            yield pa.RecordBatch.from_arrays([*part.select(keep).columns, pa.array(spans, _ARROW_SPANS)], [*keep, "spans"])

    return picked.mapInArrow(batches, f"{fields}spans {SPAN_TYPE}")


def redact(docs: DataFrame, model: crf.Chain, text: str = "text") -> DataFrame:
    """The same rows and columns with the personal data in ``text`` replaced; a null text stays null."""

    def batches(at: int, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(at).to_pylist()
            spans = _all_spans(model, [t or "" for t in texts])
            column = pa.array([t and redacted(t, s) for t, s in zip(texts, spans)], part.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*part.columns[:at], column, *part.columns[at + 1:]], schema=part.schema)

    return docs.mapInArrow(partial(batches, docs.columns.index(text)), docs.schema)


def joined(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
