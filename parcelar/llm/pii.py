"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over each whole text and reports the places where personal data can
be recognised: at-signs, plus signs, digits, ``://`` and cue words such as IBAN.  From each anchor a
small deterministic parser walks outwards to the span's boundaries and validates it.  Parsers never
look at a character more than a fixed number of times, so the time is linear in the text.

Base kinds are ``email``, ``ip``, ``card`` and ``phone``.  Added kinds need an explicit cue:
``login`` (a URL with a user name and password before its host), ``iban`` (mod-97 check), ``ssn`` and
``account`` (digits behind the cue word).  Cues count in any case, and a few filler words such as "number"
or "is" may stand behind them.  Added spans may overlap base spans and never replace them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents

BASE = ("email", "ip", "card", "phone")
ADDED = ("login", "iban", "ssn", "account")

_DIGIT = frozenset("0123456789")
_LETTER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LOCAL = _LETTER | _DIGIT | frozenset("._%+-")
_LABEL = _LETTER | _DIGIT | frozenset("-")
_PHONE = _DIGIT | frozenset(" ().-")
_SCHEME = _LETTER | _DIGIT | frozenset("+.-")
_USERINFO = _LETTER | _DIGIT | frozenset("-._~!$&'()*+,;=%")
_ALNUM = _LETTER | _DIGIT
_CUES = {"iban": ("iban",), "ssn": ("ssn", "social security", "social security number"), "account": ("account", "acct", "konto", "cuenta", "compte")}
# Words between a cue and its value.  "no" needs a mark behind it, since it is also a negation.
_FILLER = re.compile(r"(?:numbers?|num|nr|nummer|n[uú]mero|num[eé]ro|n[°º]|is|ist|es|est|no(?=[.:#]))(?![A-Za-z0-9])", re.IGNORECASE)
_FILLERS = 3
_FOLD = {upper: upper + 32 for upper in range(65, 91)}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _walk(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _labels(text: str, at: int) -> tuple[int, int]:
    """End of a dotted name that starts at ``at``, and its number of dots; the end is ``at`` if none."""
    end, dots = _walk(text, at, _LABEL), 0
    if end == at:
        return at, 0
    while text[end : end + 1] == "." and text[end + 1 : end + 2] in _LABEL and end + 1 < len(text):
        end, dots = _walk(text, end + 1, _LABEL), dots + 1
    return end, dots


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    end, dots = _labels(text, at + 1)
    return (start, end) if dots else None


def ip_at(text: str, at: int) -> tuple[int, bool] | None:
    """End of four dotted numbers, and whether each is 255 at most."""
    good = True
    for part in range(4):
        end = _walk(text, at, _DIGIT)
        if end == at:
            return None
        number = text[at:end].lstrip("0")
        good &= len(number) < 3 or (len(number) == 3 and int(number) <= 255)
        if part == 3:
            return end, good
        if text[end : end + 1] != ".":
            return None
        at = end + 1
    return None


def card_at(text: str, at: int) -> tuple[int, bool]:
    """End of a chain of digits with single spaces or hyphens between, and whether it is a card number."""
    end, n, digits = at + 1, len(text), [text[at]]
    while end < n:
        if text[end] in _DIGIT:
            step = end
        elif text[end] in " -" and end + 1 < n and text[end + 1] in _DIGIT:
            step = end + 1
        else:
            break
        digits.append(text[step])
        end = step + 1
    return end, 12 <= len(digits) <= 19 and luhn("".join(digits))


def phone_at(text: str, at: int) -> tuple[int, bool] | None:
    if at + 1 >= len(text) or text[at + 1] not in _DIGIT:
        return None
    end = _walk(text, at + 2, _PHONE)
    while end > at + 3 and text[end - 1] not in _DIGIT:
        end -= 1
    if end <= at + 3:
        return None
    return end, 9 <= sum(c in _DIGIT for c in text[at:end]) <= 15


def login_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """``scheme://user:password@host`` around the ``://`` at ``at``."""
    start = at
    while start > floor and text[start - 1] in _SCHEME:
        start -= 1
    while start < at and text[start] not in _LETTER:
        start += 1
    user = _walk(text, at + 3, _USERINFO)
    if start == at or user == at + 3 or text[user : user + 1] != ":":
        return None
    password = _walk(text, user + 1, _USERINFO)
    if password == user + 1 or text[password : password + 1] != "@":
        return None
    end, _ = _labels(text, password + 1)
    return (start, end) if end > password + 1 else None


def _after_cue(text: str, at: int) -> int:
    """First letter or digit within eight characters behind a cue word that ends at ``at``, or behind its fillers; -1 if none."""
    if at < len(text) and text[at] in _LETTER:
        return -1
    for _ in range(_FILLERS + 1):
        start = next((i for i in range(at, min(at + 8, len(text))) if text[i] in _ALNUM), -1)
        if start < 0 or not (filler := _FILLER.match(text, start)):
            return start
        at = filler.end()
    return -1


def iban_at(text: str, at: int) -> int | None:
    chars, end = [], at
    while end < len(text) and len(chars) < 34:
        if text[end] in _ALNUM:
            chars.append(text[end])
            end += 1
        elif text[end] == " " and len(chars) % 4 == 0 and text[end + 1 : end + 2].isalnum():
            end += 1
        else:
            break
    code = "".join(chars).upper()
    if len(code) < 15 or not (code[:2].isalpha() and code[2:4].isdigit()):
        return None
    return end if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 else None


def ssn_at(text: str, at: int) -> int | None:
    part = text[at : at + 11]
    good = len(part) == 11 and part[3] == part[6] == "-" and all(part[i] in _DIGIT for i in (0, 1, 2, 4, 5, 7, 8, 9, 10))
    return at + 11 if good and (at + 11 == len(text) or text[at + 11] not in _ALNUM) else None


def account_at(text: str, at: int) -> int | None:
    end = _walk(text, at, _DIGIT)
    return end if 6 <= end - at <= 17 and (end == len(text) or text[end] not in _ALNUM) else None


_PARSERS = {"iban": iban_at, "ssn": ssn_at, "account": account_at}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for key in ("@", "+", "://", *sorted(_DIGIT)):
        found.add_word(key, ("digit" if key in _DIGIT else key, len(key)))
    for kind, words in _CUES.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def _folded(text: str) -> str:
    """The text in lower case, with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_FOLD)


def spans_of(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """All spans (kind, start, end) by start, then by kind as listed above; code points, end exclusive."""
    found: list[Span] = []
    email = ip = card = phone = login = cue = 0  # where the next match of each kind may start
    for last, (what, width) in anchors.iter(_folded(text)):
        at = last - width + 1
        if what == "digit":
            if at >= ip and (at == ip or text[at - 1] not in _DIGIT):
                if hit := ip_at(text, at):
                    ip = hit[0]
                    if hit[1]:
                        found.append(("ip", at, ip))
            if at >= card:
                card, good = card_at(text, at)
                if good:
                    found.append(("card", at, card))
        elif what == "@":
            if at >= email and (hit := email_at(text, at, email)):
                found.append(("email", *hit))
                email = hit[1]
        elif what == "+":
            if at >= phone and (hit := phone_at(text, at)):
                phone = hit[0]
                if hit[1]:
                    found.append(("phone", at, phone))
        elif what == "://":
            if at >= login and (hit := login_at(text, at, login)):
                found.append(("login", *hit))
                login = hit[1]
        elif at >= cue and (at == 0 or text[at - 1] not in _LETTER):
            start = _after_cue(text, last + 1)
            if start >= 0 and (end := _PARSERS[what](text, start)):
                found.append((what, start, end))
                cue = end
    order = {k: i for i, k in enumerate(BASE + ADDED)}
    return sorted(found, key=lambda s: (s[1], order[s[0]]))


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    anchors = automaton()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        spans = []
        for text in batch["text"]:
            body = text.as_py() or ""
            own = spans_of(body, anchors)
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(spans, kind)], names=["doc_id", "spans"])


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id and spans, an array of (kind, start, end) in code points.

    A null or empty text has no spans; null ids stay null; repeated rows each keep a row; an empty table
    gives an empty table; other columns are ignored, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_scan, f"doc_id {kind}, spans {_SPANS}")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *map(count, BASE),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )



#: The base kinds.  The added kinds, which the tables don't hold, are left to the tests.
SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS uid, coalesce(text, '') AS body FROM documents
), cut AS (
  SELECT uid, 1 AS ord, 'email' AS kind, regexp_extract_all(body, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS hits, string_split_regex(body, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS gaps FROM d UNION ALL SELECT uid, 2 AS ord, 'ip' AS kind, regexp_extract_all(body, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') AS hits, string_split_regex(body, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') AS gaps FROM d UNION ALL SELECT uid, 3 AS ord, 'card' AS kind, regexp_extract_all(body, '[0-9](?:[\x20-]?[0-9])+') AS hits, string_split_regex(body, '[0-9](?:[\x20-]?[0-9])+') AS gaps FROM d UNION ALL SELECT uid, 4 AS ord, 'phone' AS kind, regexp_extract_all(body, '\+[0-9][\x20().0-9-]+[0-9]') AS hits, string_split_regex(body, '\+[0-9][\x20().0-9-]+[0-9]') AS gaps FROM d
), hit AS (
  SELECT uid, ord, kind, hits[i] AS s, regexp_replace(hits[i], '[^0-9]', '', 'g') AS digits,
         list_sum([len(g) FOR g IN gaps[1:i]])::BIGINT + coalesce(list_sum([len(h) FOR h IN hits[1:i - 1]]), 0)::BIGINT AS start
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM cut)
), good AS (
  SELECT *, kind || ':' || start || ':' || (start + len(s)) AS span FROM hit
  WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN list_max([CASE WHEN len(ltrim(p, '0')) > 3 THEN 999 ELSE ('0' || ltrim(p, '0'))::INTEGER END FOR p IN string_split(s, '.')]) <= 255
    WHEN 'card' THEN len(digits) BETWEEN 12 AND 19 AND list_sum([
      CASE WHEN i % 2 = 1 THEN reverse(digits)[i]::INTEGER WHEN reverse(digits)[i]::INTEGER > 4 THEN 2 * reverse(digits)[i]::INTEGER - 9 ELSE 2 * reverse(digits)[i]::INTEGER END
      FOR i IN range(1, len(digits) + 1)]) % 10 = 0
    ELSE len(digits) BETWEEN 9 AND 15 END
), per AS (
  SELECT uid, count(*) FILTER (ord = 1) AS n_email, count(*) FILTER (ord = 2) AS n_ip, count(*) FILTER (ord = 3) AS n_card, count(*) FILTER (ord = 4) AS n_phone,
         string_agg(span, ',' ORDER BY start, ord) AS spans
  FROM good GROUP BY uid
)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (uid)
"""
