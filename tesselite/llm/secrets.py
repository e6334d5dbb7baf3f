"""Secret scan by assignment-aware lexing.

Three plain patterns give the base spans.  Beside them a lexer reads source and
configuration syntax into name-literal pairs (``name = "x"``, ``name: x``,
``"name": "x"``, ``name: type = x``, ``name := x``, ``name => x``, sums of strings and names, strings in triple quotes, with
prefixes or within a constructor of strings, XML elements, keys of property lists and ``--name x``), keeps the
constants it has seen, and scores every literal by the name it is given to.
A literal that reaches a sensitive name through other names is reported where it
is written.  Added spans have kind ``pair`` (assigned to a sensitive name) or
``flow`` (reaches one by way of constants).

Names, values, types and the blanks between them may have any length; every part of a text is
looked at a bounded number of times.

Spans are code points, end exclusive.  Null and empty texts have none.  Texts of
any length are read whole; repeated rows give equal results; columns other than
those asked for are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tesselite.llm._util import kept_and, map_texts

#: Order of kinds where spans start alike.
KINDS = ("assign", "access", "hex", "pair", "flow")

_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of 24 or more is always a whole run, so the shorter ones need not be visited.
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Sensitivity of a name's parts, 0 to 1.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "creds": 0.9, "auth": 0.7, "bearer": 0.9, "key": 0.4, "dsn": 0.7, "salt": 0.6,
    "signature": 0.6, "cookie": 0.6, "pin": 0.4,
}
#: Parts that make a "key" sensitive.
_KEY_KINDS = {"api", "access", "private", "secret", "encryption", "signing", "auth", "master", "session", "service", "shared", "account", "storage"}
#: Any text with a pair worth reporting holds one of these, in either case.
_STEMS = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer", "dsn", "salt", "signature", "cookie", "pin")
_PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|change[-_]?me|example.*|your[-_].*|placeholder|none|null|nil|true|false|undefined|todo|test|<.*>|\$\{?.*|%\(?.*|\{\{.*)$")

# a name and what may stand between it and its operator, read backwards
_NAME_BEFORE = re.compile(r"""[\x20\t]*["'\]]{0,2}([A-Za-z0-9_.\-]*)""")
_OPERATOR = re.compile(r":=|=>|(?<![=!<>:+\-*/|&^%~])=(?![=>~])|(?<![:A-Za-z]{2}:):(?![:/=])")
_QUOTED = re.compile(r"""\"{3}((?:[^"\\]++|\\[\s\S]|"(?!""))*+)\"{3}|'{3}((?:[^'\\]++|\\[\s\S]|'(?!''))*+)'{3}|"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`""")
_PREFIX = re.compile(r"""(?:[bBrRuUfFlL]{1,2}|u8|[@$])(?=["'])""")
_CALL = re.compile(r"""(?:new[\x20\t]+)?(?:[A-Za-z_][\w.]*\.)?(?:[Ss]tring|str|bytes|[Ss]ecret\w*|[Pp]assword|valueOf|toCharArray)\([\x20\t]*(?=["'`])""")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)(?:\s[^<>]*)?>([^<>]*)</\1\s*>")
_LISTED = re.compile(r"<key>([^<>]*)</key>\s*<string>([^<>]*)</string>")
_FLAG = re.compile(r"""(?<!\S)--([A-Za-z][\w-]*)[\x20\t]+(?:"([^"\n]*)"|'([^'\n]*)'|([^\s"'-]\S*))""")
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]#<>|]+""")
_IDENT = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
# a type between colon and sign of equality, as in Python, TypeScript, Kotlin, Rust and Swift; then a string or a name, or anything
# after a blank.  No part of it holds a single colon, so that it never runs past the next operator
_WITHIN = r"""(?:[^\n=;:"'`{}()]|::)*"""
_TYPE = rf"""(?:[&*]+(?:'\w+[\x20\t]+)?)?(?:(?:mut|dyn|impl|const|readonly|any)[\x20\t]+)?(?:[A-Za-z_][\w.]*+(?:::[A-Za-z_]\w*+)*+(?:[\[<]{_WITHIN}[\]>])?+|\[{_WITHIN}\]|"[A-Za-z_][\w.\[\], |]*+")[?!]?(?:\[\])*+"""
_TYPED = re.compile(rf"""[\x20\t]*{_TYPE}(?:[\x20\t]*[|&][\x20\t]*{_TYPE})*+(?:[\x20\t]*=(?=[\x20\t]*["'`])|[\x20\t]+=(?=[\x20\t]))""")
_GAP = re.compile(r"[\x20\t]*")
_PLUS = re.compile(r"[\x20\t]*\+[\x20\t]*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: Names of pass phrases, and of what is only said about them.
_PHRASE = ("password", "passwd", "passphrase", "pwd")
_ABOUT = {"label", "hint", "prompt", "message", "msg", "error", "text", "placeholder", "help", "title", "description", "policy", "rule", "rules"}
PAIR_SCORE = 0.5


@dataclass(frozen=True)
class Pair:
    """A name and the literals that make up its value."""

    name: str
    value: str
    spans: tuple[tuple[int, int], ...]
    quoted: bool
    through: bool


def sensitivity(name: str) -> float:
    """How sensitive a target's last component is, from 0 to 1."""
    parts = [p.lower() for p in _PARTS.findall(name.rpartition(".")[2] or name)]
    best = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    joined = "".join(parts).replace("secretar", "")
    for word in ("password", "passwd", "passphrase", "apikey", "secret", "credential"):
        if word in joined:
            best = max(best, SENSITIVE[word])
    if "key" in parts and _KEY_KINDS.intersection(parts):
        best = max(best, 0.9)
    return best


def names_phrase(name: str) -> bool:
    """Whether a name is that of a password or pass phrase, so that its value may be several words."""
    parts = [p.lower() for p in _PARTS.findall(name.rpartition(".")[2] or name)]
    return any(w in "".join(parts) for w in _PHRASE) and not _ABOUT.intersection(parts)


def strength(value: str, quoted: bool, phrase: bool = False) -> float:
    """How much a literal looks like a secret, from 0 to 1; phrase: it may be several words."""
    if len(value) < 6 or _PLACEHOLDER.match(value):
        return 0.0
    n = len(value)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    if any(c.isspace() for c in value):
        if quoted and phrase and n >= 8 and entropy >= 2.5:
            return 0.75
        return 0.0 if not quoted or kinds < 3 else 0.4
    if kinds == 1 and not value.isdigit():
        return 0.75 if quoted and n >= 8 and entropy >= 2.5 else 0.3
    if not quoted and not any(c.isdigit() for c in value):
        return 0.3
    return min(1.0, 0.45 + 0.1 * kinds + 0.08 * entropy) if entropy >= 2.0 else 0.3


def pairs(text: str) -> list[Pair]:
    """Name-literal pairs in the order of their operators; names on the right-hand side stand for the constants they hold."""
    found: list[Pair] = []
    constants: dict[str, Pair] = {}
    done = 0
    back = text[::-1]
    for op in _OPERATOR.finditer(text):
        if op.start() < done:
            continue
        name = _NAME_BEFORE.match(back, len(text) - op.start(), len(text) - done)[1][::-1].lstrip("0123456789.-")
        if not name:
            continue
        start = op.end()
        if op[0] == ":" and (typed := _TYPED.match(text, start)):
            # the name is given to what stands after the type; the type itself is read as a bare word as well
            if b := _BARE.match(text, _GAP.match(text, start).end()):
                kind = b[0].rstrip(".:!?*&%$")
                found.append(Pair(name, kind, ((b.start(), b.start() + len(kind)),), False, False))
            start = done = typed.end()
        at, value, spans, quoted, through, first = _GAP.match(text, start).end(), [], [], False, False, True
        if c := _CALL.match(text, at):
            at = c.end()
        while True:
            if p := _PREFIX.match(text, at):
                at = p.end()
            if q := _QUOTED.match(text, at):
                k = q.lastindex or 1
                value.append(q[k])
                spans.append(q.span(k))
                quoted, at = True, q.end()
            elif (i := _IDENT.match(text, at)) and i[0] in constants:
                known = constants[i[0]]
                value.append(known.value)
                spans.extend(known.spans)
                quoted, through, at = quoted or known.quoted, True, i.end()
            elif first and (b := _BARE.match(text, at)):
                value.append(b[0].rstrip(".:!?*&%$"))
                spans.append((b.start(), b.start() + len(value[-1])))
                at = b.end()
            else:
                break
            first = False
            if not (plus := _PLUS.match(text, at)) or not quoted:
                break
            at = plus.end()
        if not value or not "".join(value):
            continue
        pair = Pair(name, "".join(value), tuple(s for s in dict.fromkeys(spans) if s[0] < s[1]), quoted, through)
        found.append(pair)
        constants[pair.name] = pair
        if quoted:
            done = at
    return found


def marked_pairs(text: str) -> list[Pair]:
    """Name-literal pairs of XML elements, property lists and command-line flags."""
    found = []
    if "</" in text:
        for m in (*_ELEMENT.finditer(text), *_LISTED.finditer(text)):
            value = m[2].strip()
            at = m.start(2) + len(m[2]) - len(m[2].lstrip())
            found.append(Pair(m[1].strip(), value, ((at, at + len(value)),), True, False))
    if "--" in text:
        for m in _FLAG.finditer(text):
            found.append(Pair(m[1], m[m.lastindex], (m.span(m.lastindex),), m.lastindex < 4, False))
    return [p for p in found if p.value]


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the plain patterns' matches."""
    out = []
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, each as (start, rank of kind, end) in order."""
    text = text or ""
    low = text.lower()
    base = sorted(base_spans(text, low))
    more = set()
    if any(s in low for s in _STEMS):
        for p in (*(pairs(text) if "=" in text or ":" in text else ()), *marked_pairs(text)):
            s = sensitivity(p.name)
            if s >= PAIR_SCORE and s * strength(p.value, p.quoted, names_phrase(p.name)) >= PAIR_SCORE:
                more.update((a, 4 if p.through else 3, b) for a, b in p.spans)
    if not more:
        return base, base
    # a literal that a base span covers is known already; of pair and flow the former stays
    more = {(a, k, b) for a, k, b in more if not any(s <= a and b <= e for s, _, e in base) and not (k == 4 and (a, 3, b) in more)}
    return base, sorted([*base, *more])


def redact(text: str | None) -> str | None:
    """The text with the secret of every span replaced by one mark (an assignment keeps its name); spans that overlap become one."""
    if not text:
        return text
    spans = scan(text)[1]
    if not spans:
        return text
    out, at = [], 0
    for a, k, b in spans:
        if k == 0 and (m := _ASSIGN.match(text, a, b)):
            a = m.start(2)
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def find_secrets(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, base_spans and spans (kind, start, end) and redacted text of every document; no shuffle."""
    rows = documents.select(*keep, documents["text"].alias("_text"))
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            texts = b.column("_text").to_pylist()
            found = [scan(t) for t in texts]
            listed = [[[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f[i]] for f in found] for i in (0, 1)]
            yield pa.RecordBatch.from_pydict(
                {k: b.column(k) for k in keep} | {"base_spans": pa.array(listed[0], span_type), "spans": pa.array(listed[1], span_type), "redacted": pa.array([redact(t) if f[1] else t for t, f in zip(texts, found, strict=True)], pa.string())}
            )

    return map_texts(rows, run, kept_and(rows, keep, f"base_spans {SPAN}, spans {SPAN}, redacted string"))
