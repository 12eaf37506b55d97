"""Secret scans with multipart credential linking (operator 9).

Strong secrets are reported by themselves. Access identifiers, endpoints and weak secrets are only candidates;
within a scope (a stretch of text between blank lines) their intervals, widened by `reach` code points, are
joined, and a candidate is reported only when complementary parts of a credential co-occur: a weak secret beside an
identifier, an access id or an endpoint; an identifier or endpoint beside an assigned or weak secret. A long
token without a name is weak beside an identifier or access id only. A hexadecimal number, which can be a commit or a
digest, makes nothing else a credential, and a web address is an endpoint only beside a secret that has a name.
Candidates of a kind don't overlap, so the join is one binary search for each, and no pairs are made.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_batch, only

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "endpoint", "identifier", "weak")
ORDER = {k: i for i, k in enumerate(KINDS)}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is matched whole, so shorter ones may as well not match
ENDPOINT = re.compile(r"""(?:[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20"'<>]{4,})|(?:(?<![A-Za-z0-9])(?:host|hostname|endpoint|server|base_?url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}(?::[0-9]{2,5})?)""", re.I | re.A)
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:user|username|user_?id|login|account|client_?id|access_?key_?id|email)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""", re.I | re.A)
WEAK = re.compile(r"""(?<![A-Za-z0-9])(?:password|passwd|pwd|pass|passphrase|secret|secret_?(?:access_?)?key|client_?secret|token|auth|api_?key|private_?key|account_?key|credential)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=!@#$%^&*-]{4,})""", re.I | re.A)
#: user:password@ of a URL (a password may hold @), and parameters of a URL that are named as secrets are.
LOGIN = re.compile(r"""[a-z][a-z0-9+.-]{1,20}://([^\x00-\x20"'<>/?#:@]*):([^\x00-\x20"'<>/?#]+)@""", re.I | re.A)
PARAMETER = re.compile(r"""[?&;#]((?:[a-z0-9_.-]{0,40}[_.-])?(?:password|passwd|pwd|pass|passphrase|secret|secret[_-]?key|client[_-]?secret|token|auth|api[_-]?key|private[_-]?key|credential)=[^\x00-\x20"'<>&;#]{4,})""", re.I | re.A)
LOOSE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_-])")
WEAK_WORDS = ("passw", "pwd", "pass", "secret", "token", "auth", "key", "credential")
BLANK = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Strong secrets: leftmost non-overlapping matches of each kind, without those that are too short."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def _loose(text: str) -> list[tuple[int, int]]:
    """Long tokens of mixed letters and digits."""
    return [m.span() for m in LOOSE.finditer(text) if re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]) and re.search("[0-9]", m[0])]


def _clear(found: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of found that overlap nothing of taken, itself sorted and free of overlaps; leftmost first."""
    starts, out, last = [s for s, _ in taken], [], -1
    for s, e in sorted(found):
        k = bisect_left(starts, e)
        if s >= last and not (k and taken[k - 1][1] > s):
            out.append((s, e))
            last = e
    return out


def _near(span: tuple[int, int], others: list[tuple[int, int]], starts: list[int], reach: int) -> bool:
    k = bisect_right(starts, span[1] + reach)
    return k > 0 and others[k - 1][1] >= span[0] - reach


def _flat(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Their union, as sorted disjoint intervals."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _url_parts(start: int, end: int, text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Users, and passwords and secret parameters, of a URL."""
    logins = list(LOGIN.finditer(text, start, end))
    secret = [m.span(2) for m in logins] + [m.span(1) for m in PARAMETER.finditer(text, start, end)]
    return [m.span(1) for m in logins if m[1]], _clear(secret, [])


@dataclass
class Parts:
    """Candidates of a text by what they can be part of, each kind sorted and free of overlaps."""

    assigned: list[tuple[int, int]]
    access: list[tuple[int, int]]
    identifiers: list[tuple[int, int]]
    endpoints: list[tuple[int, int]]
    named: list[tuple[int, int]]  # weak secrets with a name, or in a URL
    loose: list[tuple[int, int]]  # weak secrets without


def candidates(text: str, base: list[Span]) -> Parts | None:
    """Parts of credentials in a text with these base spans; None if they can't make a pair."""
    low = text.lower()
    covered = _flat([(s, e) for _, s, e in base])
    weak_word = any(w in low for w in WEAK_WORDS)
    if not base and not weak_word and "://" not in low and ":" not in low and "=" not in low:
        return None
    places = [m.span() for m in ENDPOINT.finditer(text)]
    users: list[tuple[int, int]] = []
    in_urls: list[tuple[int, int]] = []
    split: dict[tuple[int, int], int] = {}  # URLs with parts, and where their own text begins
    for s, e in places if "://" in low else []:
        a, b = _url_parts(s, e, text)
        if b:
            users += a
            in_urls += [(x, y) for x, y in b if not any(p <= x and y <= q for p, q in covered)]  # a strong secret is reported anyway
            login = LOGIN.match(text, s, e)
            split[s, e] = login.end() if login else s
    users = _clear(users, covered)
    plain = _clear([m.span() for m in IDENTIFIER.finditer(text)], _flat(covered + users + in_urls))
    identifiers = sorted(users + plain)
    taken = _flat(covered + identifiers + in_urls)
    starts = [s for s, _ in taken]
    for i, (s, e) in enumerate(places):
        if (s, e) in split:  # up to its first part
            s = split[s, e]
            k = bisect_left(starts, s)
            cut = min(e, starts[k]) if k < len(starts) else e
            places[i] = (s, cut - (s < cut < e and text[cut - 1] in "?&;#"))
    endpoints = _clear([(s, e) for s, e in places if s < e], taken)
    access = _flat([(s, e) for k, s, e in base if k == "access"])
    if not identifiers and not endpoints and not access:
        return None
    found = [m.span() for m in WEAK.finditer(text)] if weak_word else []
    named = sorted(in_urls + _clear(found, _flat(taken + endpoints + list(split))))
    loose = _clear(_loose(text), _flat(taken + endpoints + list(split) + named)) if identifiers or access else []
    assigned = _flat([(s, e) for k, s, e in base if k == "assign"])
    return Parts(assigned, access, identifiers, endpoints, named, loose) if named or loose or assigned else None


def link(parts: Parts, cuts: list[int], reach: int) -> list[Span]:
    """The interval join, scope by scope; cuts are where scopes begin."""
    scopes: dict[int, dict[str, list[tuple[int, int]]]] = {}
    for kind, spans in vars(parts).items():
        for s, e in spans:
            scopes.setdefault(bisect_right(cuts, s), {}).setdefault(kind, []).append((s, e))
    out: list[Span] = []

    def beside(spans: list[tuple[int, int]], others: list[tuple[int, int]]) -> list[tuple[int, int]]:
        others = _flat(others)
        starts = [s for s, _ in others]
        return [x for x in spans if _near(x, others, starts, reach)]

    for here in scopes.values():
        assigned, access, identifiers, endpoints, named, loose = (here.get(k, []) for k in vars(parts))
        named = beside(named, identifiers + access + endpoints)
        loose = beside(loose, identifiers + access)
        out += [("weak", *x) for x in named + loose]
        out += [("identifier", *x) for x in beside(identifiers, assigned + named + loose)]
        out += [("endpoint", *x) for x in beside(endpoints, assigned + named)]
    return out


def linked_spans(text: str, base: list[Span], reach: int) -> list[Span]:
    """Candidates whose complementary parts are near them in their scope."""
    parts = candidates(text, base)
    return link(parts, [m.end() for m in BLANK.finditer(text)], reach) if parts else []


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], ORDER[x[0]], x[2])))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(docs: DataFrame, reach: int = 200) -> DataFrame:
    """Secrets in every whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, by start, then by kind as KINDS lists them. A null or empty text has
    no spans; a null doc_id stays null; repeated rows are scanned once each; other columns are ignored; an empty
    table gives no rows. Each row is judged by itself, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = base_spans(text or "")
                n = [sum(k == kind for k, _, _ in base) for kind in BASE]
                spans = base + linked_spans(text or "", base, reach)
                rows.append((doc, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows)) or [()] * len(SCHEMA)
            yield as_batch(SCHEMA, **dict(zip(SCHEMA.names, map(list, columns))))

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, reach: int = 200, mask: str = "[secret]") -> DataFrame:
    """docs with every secret that scan() reports replaced by `mask` in text; n_chars, if there, follows.

    Secrets are all kinds but identifiers and endpoints, which stay readable. Null texts stay null, empty ones empty;
    all rows and columns are kept, repeated rows too, whatever the columns are called; an empty table gives no rows.
    """
    names = docs.columns
    place = names.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        base = base_spans(text)
        spans = _flat([(s, e) for k, s, e in base + linked_spans(text, base, reach) if k not in ("identifier", "endpoint")])
        if not spans:
            return text
        out, at = [], 0
        for s, e in spans:
            out += [text[at:s], mask]
            at = e
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean(t) for t in batch.column(place).to_pylist()], type=batch.schema.field(place).type)
            yield batch.set_column(place, batch.schema.field(place), texts)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
