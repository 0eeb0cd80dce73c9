"""Operator 5, personal data: candidate spans judged by gradient boosting."""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Boosted, boost, calibrate, least_threshold
from .common import Shipped, bounded_batches, hash_share, table, unused

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "iban")
#: The bounded sample that the trees are fitted on: documents looked at, and candidates kept.
SAMPLE_DOCS, SAMPLE_CANDIDATES = 6000, 20_000
PRECISION = 0.98

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits that does not lead to three dots does not from its later digits either.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What the generators propose beyond the base: loose forms, which may overlap and may be wrong.
_AT = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}|<at>|@) ?|_at_| at ", re.IGNORECASE)
_DOT = re.compile(r" ?(?:\.|\(dot\)|\[dot\]|<dot>) ?|_dot_| dot ", re.IGNORECASE)
_LABEL = re.compile(r"[^\W_][^\W_-]*+(?:-++[^\W_-]++)*+")
_SPOKEN_DOTS = ("(dot)", "[dot]", "<dot>", "_dot_", " dot ")
#: An address with colons, an account number with its check digits, keys that say what they are.
_IP6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}(?![\w:])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_KNOWN_KEY = re.compile(r"(?:ghp_|gho_|[sp]k[-_]|xox[abp]-|AKIA|AIza|eyJ)")
_WIDE_NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[ ().+\[\]-]{0,3}[0-9])+")
_GROUP, _WORDY = re.compile(r"[0-9]+"), re.compile(r"[a-z$]")
#: A number goes on behind a span, or began before it.
_GOES_ON, _CAME_ON = re.compile(r"[ ().+\[\]-]{0,3}[0-9]"), re.compile(r"[0-9][ ().+\[\]-]{0,3}$")
#: Keys and passwords: a long run of letters and digits, or what is assigned to a word for a secret.
_RUN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+")
_ASSIGNED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|bearer|credential)s?[\"']?\s{0,2}(?:[:=]|\bis\b)\s{0,2}[\"']?([^\s\"',;]{6,})")
_HINTS = ("token", "secret", "pass", "pwd", "key", "bearer", "credential")
#: Digits of a proposed number; no span of groups is longer, which bounds the ends for a start.
_PHONE_DIGITS, _CARD_DIGITS, _MOST_DIGITS = range(7, 21), range(13, 20), 20
_NEAR = {
    "secret": _HINTS, "hash": ("sha", "md5", "commit", "checksum", "etag", "digest", "revision"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "contact"), "card": ("card", "visa", "credit", "payment"),
    "ip": ("ip", "host", "server", "address"), "email": ("mail", "write", "contact"), "not": ("token", "key", "id", "ref", "order", "isbn", "version", "no", "$"),
}

Span = tuple[str, int, int]
#: Features; right or not; whether the model is asked about such a span (base spans stand without it); held out.
Example = tuple[list[float], int, int, int]


@dataclass
class Judge:
    """Trees with a threshold for each kind, and how that did: `held[kind]` is held-out examples that the model is
    asked about, those over the threshold, and the right ones of these."""

    trees: Boosted
    thresholds: dict[str, float]
    held: dict[str, tuple[int, int, int]]


#: A digit taken twice, less nine where that has two digits.
_DOUBLED = str.maketrans("0123456789", "0246813579")


def luhn(digits: str) -> bool:
    doubled = digits[-2::-2].translate(_DOUBLED)
    return (sum(map(int, digits[-1::-2])) + sum(map(int, doubled))) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, from each @ outwards: its local part is all that may stand before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        else:
            end = at + 1
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The spans that the rules find: leftmost, not overlapping within a kind, failing matches dropped."""
    out: list[Span] = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _addresses(text: str) -> Iterator[Span]:
    """E-mail addresses however they are hidden: outwards from each mark for the at sign, the local part in any letters
    and with dots spelt out, the domain up to each of its ends. A bare word `at` counts only before a dot spelt out and an end of two to four letters."""
    end = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > end:
            if text[start - 1].isalnum() or text[start - 1] in "._%+-":
                start -= 1
            elif text[max(end, start - 5) : start].lower() in _SPOKEN_DOTS[:3]:
                start -= 5
            else:
                break
        label = _LABEL.match(text, m.end()) if start < m.start() else None
        if not label:
            continue
        ends, spoken = [label.end()], []
        while (dot := _DOT.match(text, ends[-1])) and (label := _LABEL.match(text, dot.end())):
            ends.append(label.end())
            spoken.append(dot[0].strip() != ".")
        mark, end = m[0].lower(), m.end()
        if mark == "_at_":
            ends = ends[1:]
        elif mark == " at ":
            tops = [text[ends[i - 1] : e].split(" ")[-1].split(".")[-1] for i, e in enumerate(ends)]  # at 0 of no account
            ends = [e for i, e in enumerate(ends) if i and any(spoken[:i]) and 2 <= len(tops[i]) <= 4]
        yield from (("email", start, e) for e in (ends[1:] if len(ends) > 1 and mark not in ("_at_", " at ") else ends))


def _spaced(text: str, groups: list[tuple[int, int]]) -> Iterator[Span]:
    """Numbers of which every digit stands alone: rows of ten to twelve of them, or of a card's with its check digit."""
    row: list[tuple[int, int]] = []
    for group in [*groups, (0, 0)]:
        if group[1] - group[0] == 1:
            row.append(group)
            continue
        if len(row) in (10, 11, 12):
            yield "phone", row[0][0], row[-1][1]
        elif len(row) in _CARD_DIGITS and luhn(_digits(text[row[0][0] : row[-1][1]])):
            yield "card", row[0][0], row[-1][1]
        row = []


def iban_like(text: str) -> bool:
    """The check digits of an account number are right."""
    bare = text.replace(" ", "")
    return 15 <= len(bare) <= 34 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _is_ip6(text: str) -> bool:
    if sum(bool(g) for g in text.split(":")) < 2:
        return False
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return True


def _numbers(text: str, start: int, end: int) -> Iterator[Span]:
    """What a run of digit groups may hold: every span from the start of a group to the end of a group that has the
    digits of a kind, so that neighbours swallowed by the run hide nothing. At most 20 ends a start. What cannot be
    of the kind is not proposed: parts of an address over 255,
    cards with a wrong check digit, a leading zero or brackets. More than one digit alone behind the first group is proposed
    only where all digits stand alone."""
    groups = [m.span() for m in _GROUP.finditer(text, start, end)]
    single = [e - s == 1 for s, e in groups]
    yield from _spaced(text, groups)
    dotted = [False, *("." in text[a[1] : b[0]] for a, b in zip(groups, groups[1:]))]  # between a group and the one before
    for i, (s, _) in enumerate(groups):
        if i + 3 < len(groups) and all(dotted[i + 1 : i + 4]) and all(b - a < 4 and int(text[a:b]) < 256 for a, b in groups[i : i + 4]):
            yield "ip", s, groups[i + 3][1]
        lead = s
        while lead > start and s - lead < 2 and text[lead - 1] in "+(":
            lead -= 1
        n, alone = 0, 0
        for j in range(i, len(groups)):
            e = groups[j][1]
            n += e - groups[j][0]
            alone += single[j] and j > i
            if n > _MOST_DIGITS or alone > 1:
                break
            if n in _PHONE_DIGITS:
                yield "phone", lead, e
            if n in _CARD_DIGITS and text[s] != "0" and "(" not in (body := text[s:e]) and luhn(_digits(body)):
                yield "card", s, e


def candidates(text: str) -> list[Span]:
    """All that may be personal data, overlapping and one kind beside the other: most are not."""
    out: set[Span] = set()
    low = text.lower()
    if "@" in text or any(x in low for x in ("at)", "at]", "at}", "at>", "_at_")) or " at " in low and any(x in low for x in _SPOKEN_DOTS):
        out.update(_addresses(text))
    if "::" in text or text.count(":") > 6:
        out.update(("ip", *m.span()) for m in _IP6.finditer(text) if _is_ip6(m[0]))
    accounts = [m.span() for m in _IBAN.finditer(text) if iban_like(m[0])]
    out.update(("iban", s, e) for s, e in accounts)
    parts = [*(x for a in accounts for x in a), len(text)]
    masked = text if not accounts else "".join(text[a:b] if i % 2 == 0 else "x" * (b - a) for i, (a, b) in enumerate(zip([0, *parts], parts, strict=False)))
    for m in _WIDE_NUMBER.finditer(masked):  # their digits are no other number
        if m.end() - m.start() >= 7:
            out.update(_numbers(masked, *m.span()))
    out.update(("secret", *m.span()) for m in _RUN.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]))
    if any(h in low for h in _HINTS):
        out.update(("secret", *m.span(1)) for m in _ASSIGNED.finditer(text) if any(c.isdigit() for c in m[1]))
    return sorted(out)


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate as numbers."""
    kind, s, e = span
    body = text[s:e]
    before, after = text[max(0, s - 24) : s].lower(), text[e : e + 12].lower()
    parts = _GROUP.findall(body)
    digits, groups = "".join(parts), [len(x) for x in parts]
    octets = [int(x) <= 255 for x in parts if len(x) < 9]
    dot = _DOT.match(after)
    left, right = (before[-1:] or " "), (after[:1] or " ")
    secret = kind == "secret"
    spread = -sum(n / len(body) * math.log2(n / len(body)) for n in Counter(body).values()) if secret else 0.0
    return [
        *(float(kind == k) for k in KINDS), float(len(body)), float(len(digits)), float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)),
        float(body[:1] == "+"), float("(" in body), float(body.count(".")), float(body.count("-") + body.count(" ")), float("@" in body or bool(_AT.search(body))), float(bool(_DOT.search(body)) and "." not in body),
        float(luhn(digits) if digits else 0), float(len(octets) == 4 and all(octets)), float(sum(c.isalpha() for c in body)),
        float(bool(_GOES_ON.match(after))), float(bool(_CAME_ON.search(before))), float(bool(dot) and after[dot.end() : dot.end() + 1].isalnum()),
        float(left.isalnum()), float(right.isalnum()), float(left in "\"'=_#"), float(right in "\"'_%"),
        spread, float(secret and bool(re.search(r"[:=][ \"']*$", before))), float(secret and bool(re.fullmatch("[0-9a-fA-F]+", body))),
        float(secret and bool(_KNOWN_KEY.match(body))), float(kind == "ip" and ":" in body), float(kind == "card" and (groups[:-1] == [4] * (len(groups) - 1) or groups == [4, 6, 5] or max(groups) == 1)), float(body[:1] == "0" or body[:2] == "(0"), float(len(groups) > 9 and max(groups) == 1),
        *([float(any(w in before for w in words)) for words in _NEAR.values()] if _WORDY.search(before) else [0.0] * len(_NEAR)),
    ]


_LETTERS = str.maketrans("0123456789", "abdehiklno")


def _overlap(a: Span, b: Span) -> bool:
    return a[1] < b[2] and b[1] < a[2]


class _Cover:
    """Which characters of a text are taken: a look at a span costs its length, however many spans there are."""

    def __init__(self, text: str, spans: list[Span] = ()) -> None:
        self.taken = bytearray(len(text))
        for span in spans:
            self.take(span)

    def take(self, span: Span) -> None:
        self.taken[span[1] : span[2]] = b"\1" * (span[2] - span[1])

    def meets(self, span: Span) -> bool:
        return self.taken.find(1, span[1], span[2]) >= 0


def _assigned(text: str) -> list[Span]:
    """Secrets beyond doubt: 16 characters or more, digits and letters, assigned to a word for a secret."""
    if not any(h in text.lower() for h in _HINTS):
        return []
    sure = lambda v: len(v) >= 16 and any(c.isdigit() for c in v) and any(c.isalpha() for c in v)
    return [("secret", *m.span(1)) for m in _ASSIGNED.finditer(text) if sure(m[1]) and _RUN.fullmatch(m[1])]


def _made_secrets(body: str, near: str, rest: str) -> Iterator[tuple[str, Span, int]]:
    """A key made of a hash, as keys are written, and the same characters where they are no secret."""
    value, pick = hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest(), zlib.crc32(body.encode("utf-8", "surrogatepass"))
    value = (value[:40], value[:32].upper(), ("sk-", "sk_test_", "ghp_")[pick // 3 % 3] + value[:24], value[:20] + "Xy/" + value[20:30], "AKIA" + value[:16].upper(), value * 4, value[:4] + "!" + value[4:9])[pick % 7]
    own = _KNOWN_KEY.match(value) is not None  # such a key needs no word before it
    plain = (("commit ", "", own), ("sha1:", "", own), ("", "", own), ('id="', '"', own))[pick // 28 % 4]
    for lead, tail, right in ((('token = "', '"', 1), ("api_key: ", "", 1), ("password=", "", 1), ("SECRET='", "'", 1))[pick // 7 % 4], *([plain] if len(value) > 15 else [])):
        yield near + lead + value + tail + rest, ("secret", len(near) + len(lead), len(near) + len(lead) + len(value)), int(right)


def _made_numbers(body: str, near: str, rest: str) -> Iterator[tuple[str, Span]]:
    """An account number with its check digits, and an address with colons, made of a hash."""
    value = hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest()
    country, digits = ("DE", "FR", "GB", "ES")[int(value[0], 16) % 4], str(int(value[:20], 16))[:18]
    check = 98 - int("".join(str(int(c, 36)) for c in digits + country + "00")) % 97
    account = f"{country}{check:02d}{digits}"
    account = re.sub("(.{4})(?=.)", r"\1 ", account) if int(value[1], 16) % 2 else account
    groups = [value[i : i + 4].lstrip("0") or "0" for i in range(0, 32, 4)]
    colons = ":".join(groups) if int(value[2], 16) % 2 else f"{groups[0]}:{groups[1]}::{groups[7]}"
    for kind, new in (("iban", account), ("ip", colons)):
        yield near + new + rest, (kind, len(near), len(near) + len(new))


def _nobodys(body: str, near: str, rest: str) -> Iterator[tuple[str, int, int]]:
    """Dates with times, seconds since 1970, versions, book numbers and the like made of a hash: all in them is wrong."""
    n = int(hashlib.sha256(b"-" + body.encode("utf-8", "surrogatepass")).hexdigest()[:15], 16)
    day = f"20{n % 30:02d}-{1 + n // 30 % 12:02d}-{1 + n // 360 % 28:02d}"
    forms = (f"{day} {n // 7 % 24:02d}:{n // 11 % 60:02d}:{n // 13 % 60:02d}", str(1_500_000_000 + n % 300_000_000), f"{n % 9}.{n // 3 % 40}.{256 + n // 5 % 700}.{256 + n // 7 % 9000}", f"978-{n % 10}-{n // 11 % 90 + 10}-{n // 13 % 900000 + 100000}-{n // 17 % 10}", f"{day.replace('-', '')} {n % 10**8}")
    new = forms[n % len(forms)]
    yield near + new + rest, len(near), len(near) + len(new)


def _disguised(text: str, span: Span) -> Iterator[tuple[str, Span]]:
    """A known span written as people hide or shorten it, or with a number behind it that the rules take for a part
    of it; each in its context, and only what the rules then do not find."""
    kind, s, e = span
    body, pick = text[s:e], zlib.crc32(text[s:e].encode("utf-8", "surrogatepass"))
    if kind == "email":
        mark, plain = (" (at) ", " [AT] ", "(At)", "{at}", "_at_", " at ")[pick % 6], body.translate(_LETTERS)
        dot = " dot " if mark == " at " else ("(dot)", "[dot]", ".")[pick // 6 % 3] if mark != "_at_" else "."
        name, host = plain.split("@", 1)
        forms = [(body.replace("@", mark, 1), "")] if mark != " at " else []
        labels = host.split(".")[-2:] if pick % 2 else ["news", *host.split(".")][-3:]
        forms += [(name.replace(".", dot if dot in ("(dot)", "[dot]") else ".") + mark + dot.join(labels), ""), (name.replace("e", "é").replace("o", "ö") + "@" + host, "")]
    elif kind == "phone":
        local = (" ", "-", ".")[pick % 3].join(_GROUP.findall(body)[1:] or [body])
        others = " ".join(local.translate(str.maketrans("0123456789", d)) for d in ("3456789012", "7890123456"))
        forms = [(re.sub(r"^\+[0-9]{1,3}[ -]", "", body), ""), (body, (" 2024-01-02", " 31.12.2023", " 1200 1300")[pick % 3]), (local, ""), (local, " " + others), (re.sub(r"^\+", "00", body), ""), ("0" + local, ""), (" ".join(_digits(body)[-10:]), "")]
    elif kind == "card":
        tail, fours = (" 2024", " 123", " 12-27", " 0427 911")[pick % 4], re.findall("[0-9]{1,4}", _digits(body))
        forms = [(body, tail), ((" ", "-")[pick // 4 % 2].join(fours), tail), ((".", "  ")[pick // 8 % 2].join(fours), "")]
    else:
        forms = [(body.replace(".", ("[.]", " . ", "(.)")[pick % 3]), ""), (f"{300 + pick % 600}.{body}", "")]
    near, rest = text[max(0, s - 40) : s], text[e : e + 40]
    for new, tail in forms:
        if new + tail == body:
            continue
        whole = near + new + tail + rest
        made = (kind, len(near) + (new.index(body) if kind == "ip" and body in new else 0), len(near) + len(new))
        if not any(_overlap(made, k) for k in base_spans(whole)):
            yield whole, made


def labelled(text: str) -> list[Example]:
    """Candidates of one text as examples: base spans are right, also disguised; what no rule confirms is wrong, and
    so are the other spans that overlap a disguised one. What would be a phone for the rules if it stood alone, but
    has a number behind it, is unknown, and no example; so is a run of characters that has a word for a secret before
    it but is not assigned to it. A fifth of the texts, by hash, is held out."""
    known, held = base_spans(text), int(zlib.crc32(text.encode("utf-8", "surrogatepass")) % 5 == 0)
    alone = lambda c: c[0] == "phone" and text[c[1]] == "+" and ("phone", 0, c[2] - c[1]) in base_spans(text[c[1] : c[2]])
    assigned, right, cover = set(_assigned(text)), set(known), _Cover(text, known)
    out = []
    for c in candidates(text):
        if c[0] == "secret":
            if c in assigned or not any(h in text[max(0, c[1] - 24) : c[1]].lower() for h in _HINTS):
                out.append((features(text, c), int(c in assigned), 1, held))
        elif c in right or not (cover.meets(c) or alone(c)):
            out.append((features(text, c), int(c in right), int(c not in right), held))
    for span in known:
        for whole, made in _disguised(text, span):
            out += [(features(whole, c), int(c == made), 1, held) for c in candidates(whole) if _overlap(c, made)]
        near, rest = text[max(0, span[1] - 40) : span[1]], text[span[2] : span[2] + 40]
        for whole, s, e in _nobodys(text[span[1] : span[2]], near, rest):
            out += [(features(whole, c), 0, 1, held) for c in candidates(whole) if _overlap(c, ("", s, e)) and not any(_overlap(c, k) for k in base_spans(whole))]
        for whole, made in _made_numbers(text[span[1] : span[2]], near, rest):
            out += [(features(whole, c), int(c == made), 1, held) for c in candidates(whole) if _overlap(c, made)]
        for whole, made, is_one in _made_secrets(text[span[1] : span[2]], near, rest):
            out += [(features(whole, c), int(is_one and c == made), 1, held) for c in candidates(whole) if c[0] == "secret" and _overlap(c, made)]
    return out


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_candidates: int = SAMPLE_CANDIDATES, id_col: str = "doc_id", text_col: str = "text") -> Judge | None:
    """Trees and threshold from the candidates of up to some `sample_docs` documents, of which the driver gets
    `sample_candidates` rows of numbers at most; see fit()."""
    bounded_batches(docs.sparkSession)
    n = max(1, docs.count())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for text in batch.column(0).to_pylist() for x in labelled(text)]
            numbers = [pa.array([x[i] for x in rows], pa.int32()) for i in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.list_(pa.float64())), *numbers], ["x", "y", "asked", "held"])

    few = docs.filter(F.col(text_col).isNotNull() & (hash_share(id_col, 5) < min(1.0, sample_docs / n))).select(text_col)
    rows = few.mapInArrow(of, "x array<double>, y int, asked int, held int")
    rows = rows.orderBy(F.xxhash64("x", "y", "asked", "held")).limit(sample_candidates).collect()  # the same in any partitioning
    return fit([tuple(r) for r in rows])


def fit(examples: list[Example]) -> Judge | None:
    """Trees from the texts that are not held out. Those that are, less base spans, give each kind the least
    threshold with PRECISION, so that easy spans that are never asked about cannot fill it; a kind without such
    examples adds nothing. None if nothing can be told apart."""
    rows = sorted((tuple(x), y, asked, held) for x, y, asked, held in examples)
    x, y, asked, held = (np.array([r[i] for r in rows]) for i in range(4))
    learns, judges = held == 0, (held == 1) & (asked == 1)
    if len(set(y[learns])) < 2 or not judges.any():
        return None
    model = boost(x[learns], y[learns])
    calibrate(model, x[judges], y[judges], PRECISION)
    thresholds, done = {}, {}
    for i, kind in enumerate(KINDS):
        of = judges & (x[:, i] == 1)
        p = model.probability(x[of])
        thresholds[kind] = least_threshold(p, y[of], PRECISION) if of.any() else 2.0
        over = p >= thresholds[kind]
        done[kind] = (int(of.sum()), int(over.sum()), int(y[of][over].sum()))
    return Judge(model, thresholds, done)


def spans_of(text: str, model: Judge | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): candidates over the threshold that touch no other span are added, surest first."""
    base = base_spans(text)
    if model is None:
        return base, base
    cover = _Cover(text, base)
    offered = [c for c in candidates(text) if not cover.meets(c)]
    if not offered:
        return base, base
    p = model.trees.probability(np.array([features(text, c) for c in offered]))
    chosen = list(base)
    for i in np.argsort(-p, kind="stable"):
        c = offered[i]
        if p[i] >= model.thresholds[c[0]] and not cover.meets(c):
            chosen.append(c)
            cover.take(c)
    return base, sorted(chosen, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPANS = "array<struct<kind: string, start: int, end: int>>"


def find_personal_data(docs: DataFrame, model: Judge | None, text_col: str = "text") -> DataFrame:
    """docs with `base_spans` and `all_spans`, arrays of kind, start and end (code points, end exclusive).

    Defined cases: null and empty texts have no spans; repeated rows have the same; without examples to learn
    from the base spans are all; an empty table gives an empty table; input columns named as the outputs are
    replaced. At scale: one narrow pass, linear in a text (a text of numbers has some candidates for each of them);
    the model is a few trees.
    """
    bounded_batches(docs.sparkSession)
    shared = Shipped(docs.sparkSession, model)

    @F.arrow_udf(f"struct<base_spans: {_SPANS}, all_spans: {_SPANS}>")
    def of(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        both = [spans_of(t.as_py() or "", shared.get()) for t in texts]
        as_rows = lambda spans: [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        return pa.StructArray.from_arrays([pa.array([as_rows(b[i]) for b in both], kind) for i in (0, 1)], ["base_spans", "all_spans"])

    kept, both = [c for c in docs.columns if c not in ("base_spans", "all_spans")], unused("_both", docs)
    found = docs.withColumn(both, of(F.col(text_col)))
    return found.select(*kept, f"{both}.base_spans", f"{both}.all_spans")


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The text of find_personal_data() with [KIND] in the place of every span; overlapping spans are one. A null text
    stays null, and one without spans, or with null for them, stays as it is."""
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("end"))

    def step(a, x):
        gap = F.substring(F.col(text_col), a["end"] + 1, F.greatest(F.lit(0), x["start"] - a["end"]))
        mark = F.when(x["start"] >= a["end"], F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.concat(a["t"], gap, mark).alias("t"), F.greatest(a["end"], x["end"]).alias("end"))

    done = F.aggregate("all_spans", start, step)
    rest = F.substring(F.col(text_col), done["end"] + 1, F.length(text_col))
    return found.withColumn(text_col, F.when(F.coalesce(F.size("all_spans"), F.lit(0)) <= 0, F.col(text_col)).otherwise(F.concat(done["t"], rest)))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs, train(docs))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of_kind = lambda spans, kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    counts = [of_kind("base_spans", kind).alias(f"n_{kind}") for kind in BASE]
    more = [of_kind("all_spans", "secret").alias("n_secret"), F.size("all_spans").cast("long").alias("n_spans")]
    return found.select("doc_id", *counts, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("all_spans").alias("spans"), *more)
