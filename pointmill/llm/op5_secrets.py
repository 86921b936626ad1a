"""Secret scans: three pattern kinds, and assignment-aware lexing for what patterns miss.

The lexer reads a text as source or configuration: a target name, an assignment sign, a value. Values are quoted
literals (also joined by +), bare values of configuration lines (name, sign and value alone on the line), or names of
other targets; attributes, calls and other expressions are no literals. Constants are propagated to a fixed point: a
literal counts for every name that it reaches, through any chain of names and in any order of assignments. A literal is
a secret (kind named) if its best target name and its own look score high enough together.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.llm.common import by_slices, text_bytes

KINDS = ("assign", "access", "hex", "named")
# fixed values: the base patterns of the contract
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: How much a part of a target's name says that its value is secret.
NAME_PARTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "bearer": 0.8, "authorization": 0.8, "auth": 0.6, "private": 0.5, "key": 0.5, "access": 0.3, "api": 0.4,
    "signing": 0.4, "encryption": 0.4, "client": 0.1, "session": 0.3, "salt": 0.6, "pass": 0.8,
}
#: A text without any of these has no name that scores: all parts but those that hold another.
SENSITIVE = [k for k in NAME_PARTS if not any(x in k for x in NAME_PARTS if x != k)]
PLACEHOLDER = re.compile(r"example|changeme|placeholder|your|dummy|sample|xxx|\*\*\*|\.\.\.|^\$|^<|^\{|^%|^(?:none|null|true|false|undefined|todo)$", re.IGNORECASE)
TARGET = re.compile(r"""(?<![\w.\-])([A-Za-z_][\w.\-]*)["'\]]{0,2}[ \t]*(?::[ \t]*[A-Za-z_][\w.]*[ \t]*(?==[^=>]))?(?:=>|:=|=(?!=)|:(?![:/]))[ \t]*""", re.ASCII)
LITERAL = re.compile(r""""((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`""")
#: Bare value, and what ends a line after it: a comment or the line's end. Both are matched once for a value, however many
#: signs it holds.
BARE, ENDED = re.compile(r"""[^\s"'`,;#(){}\[\]<>]+"""), re.compile(r"[ \t]*(?:[#;]|\r?\n|\r?\Z)")
#: What may stand before the name on a configuration line.
LEAD = re.compile(r"[ \t]*(?:(?:export|set|SET|ENV|-)[ \t]+)?[\"']?")
JOINED = re.compile(r"[ \t]*\+[ \t]*")
NAME = re.compile(r"[A-Za-z_][\w.]*", re.ASCII)
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base kinds, leftmost and not overlapping per kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def name_score(name: str) -> float:
    parts = [p.lower() for p in PARTS.findall(name.rpartition(".")[2])]
    return min(1.0, sum(NAME_PARTS.get(p, 0.0) for p in parts))


def literal_score(value: str) -> float:
    """0 for what no secret looks like; else by length and by the entropy of its letters."""
    if len(value) < 6 or PLACEHOLDER.search(value) or re.search(r"\s", value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    mixed = bool(re.search(r"\d", value)) + bool(re.search("[a-z]", value)) + bool(re.search("[A-Z]", value)) + bool(re.search(r"[^\w]", value))
    return min(1.0, 0.25 * (n >= 8) + 0.15 * (n >= 16) + 0.15 * min(entropy, 4) + 0.15 * (mixed - 1))


def assignments(text: str) -> Iterator[tuple[str, list[tuple[int, int]], str]]:
    """(target, spans of its literals, name that it is set to or '') in order."""
    at, key, line, line_end, bare_end, whole = 0, "", 0, -1, -1, False
    while m := TARGET.search(text, at):
        at, target, spans, other = m.end(), m[1], [], ""
        if m.start() > line_end:
            line, line_end, key = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.start()), ""
            line_end = len(text) if line_end < 0 else line_end
        while lit := LITERAL.match(text, at):
            k = next(k for k in (1, 2, 3) if lit[k] is not None)
            spans.append(lit.span(k))
            at = lit.end()
            if not (plus := JOINED.match(text, at)):
                break
            at = plus.end()
        if not spans and at >= bare_end:
            bare = BARE.match(text, at)
            bare_end = bare.end() if bare else at
            whole = bare is not None and ENDED.match(text, bare_end) is not None
        if not spans and whole and at < bare_end:
            name = NAME.fullmatch(text, at, bare_end)
            sign = m[0][len(m[1]) :].strip("\"'] \t")
            tight = m.end() - m.start() == len(m[1]) + len(sign)
            alone = LEAD.fullmatch(text, line, m.start()) is not None
            # a plain name is another target, but after name= on a line of its own, and where digits show that it is none
            if alone and (not name or sign == "=" and tight or sign == ":" and any(c.isdigit() for c in name[0])):
                spans.append((at, bare_end))
            if name:
                other = name[0]
        elif not spans and (name := NAME.match(text, at)) and text[name.end() : name.end() + 1] in (";", ","):
            other = name[0]
        if target.lower() in ("key", "name") and spans:
            key = text[spans[0][0] : spans[-1][1]]
        elif target.lower() == "value" and key:
            target = key
        yield target, spans, other


def named_spans(text: str, threshold: float = 0.6) -> list[tuple[int, int, int]]:
    """Spans of literals that were assigned, straight or through constants, to sensitive names."""
    low = text.lower()
    if not any(k in low for k in SENSITIVE):
        return []
    held: dict[str, list[list[tuple[int, int]]]] = {}
    refers: dict[str, list[str]] = {}
    for target, spans, other in assignments(text):
        if spans:
            held.setdefault(target, []).append(spans)
        if other and other != target:
            refers.setdefault(target, []).append(other)
    # from the highest score down, so that each name is visited once, with the best score that reaches it
    best: dict[tuple[int, int], float] = {}
    seen: set[str] = set()
    for name in sorted({*held, *refers}, key=name_score, reverse=True):
        score, todo = name_score(name), [name]
        if score <= 0:
            break
        while todo:
            if (own := todo.pop()) in seen:
                continue
            seen.add(own)
            todo += refers.get(own, ())
            for spans in held.get(own, ()):
                quality = literal_score("".join(text[a:b] for a, b in spans))
                for span in spans:
                    best[span] = max(best.get(span, 0.0), score * quality)
    return sorted((a, 3, b) for (a, b), s in best.items() if s >= threshold and b > a)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def _work(columns: list[list]) -> list[list]:
    out: list[list] = [[] for _ in FOUND]
    for doc_id, raw in zip(*columns, strict=True):
        text = raw.decode("utf-8", "replace")
        base = base_spans(text)
        more = named_spans(text)
        count = Counter(k for _, k, _ in base)
        for c, v in zip(out, (doc_id, count[0], count[1], count[2], len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more))), strict=True):
            c.append(v)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, counts by kind, base_sha256 and spans (kind:start:end in code points).

    A null text is empty: no spans. Null and repeated ids and rows come through, and an empty table gives an empty result.
    Texts of any length are read whole, in time that follows their length. Only doc_id and text are read, so other columns
    may have any names. Equal starts are ordered by kind as in KINDS. Bytes that are no UTF-8 count as U+FFFD.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes())
    return rows.mapInArrow(by_slices(_work, FOUND), ", ".join(["doc_id long", *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string"]))
