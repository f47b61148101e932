"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in whole texts: at-signs, address schemes, digits, plus
signs and words that announce an account or a street. Deterministic parsers then walk from an
anchor to the boundaries of the candidate and validate it: email, IP address, card, phone (the
base kinds, whose spans follow fixed rules), and url, account (IBAN by its check digits, numbers
after an account word) and address (a number with a street word).

Base spans are leftmost and non-overlapping for each kind; a candidate that fails its check is
dropped and the search goes on after it. Spans count code points, end exclusive. Cue words count in
any case of A-Z. Up to three words may stand between a house number and a street word, however long
they are. Null and empty texts have none. Repeated rows are treated one by one; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WholeRow, map_text

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "address")
SCHEMES = ("http://", "https://", "ftp://", "mailto:", "www.")
ACCOUNT_WORDS = ("iban", "account", "acct", "konto", "compte", "cuenta", "ssn", "passport", "customer id")
STREET_WORDS = ("street", "avenue", "road", "lane", "boulevard", "straße", "strasse", "platz", "rue", "calle")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def iban(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def span_finder() -> Callable[[str], list[tuple[int, int, int]]]:
    """A function from a text to its (start, kind number, end), in order."""
    automaton = ahocorasick.Automaton()
    anchors: dict[str, str] = {"@": "at", "+": "plus"}
    anchors |= {d: "digit" for d in "0123456789"}
    for words, what in ((SCHEMES, "scheme"), (ACCOUNT_WORDS, "account"), (STREET_WORDS, "street")):
        anchors |= dict.fromkeys(words, what)
    for word, what in anchors.items():
        automaton.add_word(word, (what, len(word)))
    automaton.make_automaton()
    domain = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+").match
    dotted = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").match
    run = re.compile(r"[0-9]([ -]?[0-9])+").match
    phone_run = re.compile(r"\+[0-9][ ().0-9-]+").match
    url_end = re.compile(r"[^\s\"'<>|]+").match
    number_after = re.compile(
        r"[ \t]*(?:no\.?|number|nr\.?|n°)?[ \t]*[:#=]?[ \t]*"
        r"([A-Za-z]{0,2}[0-9](?:[ -]?[0-9])*)(?![A-Za-z0-9])"
    ).match
    iban_at = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}").match
    number_end = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}[a-z]?,? $").search
    word = re.compile(r"[^\W\d_][\w.'-]*").fullmatch
    word_rest = re.compile(r"[\w.'-]*").fullmatch
    house_after = re.compile(r"[a-z]*\.? ([0-9]{1,5}[a-z]?)(?![\w])").match
    named_after = re.compile(r"(?: [^\W\d_][\w'-]*){1,4},? ([0-9]{1,5})(?!\w)").match

    def house_before(text: str, floor: int, at: int, words: int) -> int:
        """The first house number from `floor` with at most so many words between it and `at`, or -1."""
        begin = -1
        while at > floor and text[at - 1] == " ":
            if match := number_end(text, max(floor, at - 8), at):
                begin = match.start()
            before = text.rfind(" ", floor, at - 1) + 1
            if not words or not before or not word(text, before, at - 1):
                break
            at, words = before, words - 1
        return begin

    def spans_of(text: str) -> list[tuple[int, int, int]]:
        found: list[tuple[int, int, int]] = []
        # The cues are looked for in a copy in which A-Z alone are lower-cased; positions stay.
        lowered = text.encode().lower().decode()
        # The word that the last street word after a hyphen stands in: how far it is known to be one,
        # and the house number before it. Each character is looked at once, however many such words.
        hyphen_to, hyphen_house = 0, -1
        # Up to where each kind's last match reaches; ip_from: where a new attempt may begin.
        email_to = ip_to = card_to = phone_to = url_to = account_to = address_to = 0
        for last, (what, size) in automaton.iter(lowered):
            start = last - size + 1
            if what == "digit":
                if start >= ip_to:
                    if match := dotted(text, start):
                        ip_to = match.end()
                        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in match[0].split(".")):
                            found.append((start, 1, ip_to))
                    else:
                        # Starting later within the same digits cannot match either, unless dots
                        # follow them; the attempt from each later anchor stays linear in the run.
                        ip_to = start + 1
                        while ip_to < len(text) and text[ip_to] in _DIGITS:
                            ip_to += 1
                if start >= card_to and (match := run(text, start)):
                    card_to = match.end()
                    digits = match[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        found.append((start, 2, card_to))
            elif what == "at":
                begin = start
                while begin > email_to and text[begin - 1] in _LOCAL:
                    begin -= 1
                if begin < start and (match := domain(text, start + 1)):
                    email_to = match.end()
                    found.append((begin, 0, email_to))
            elif what == "plus":
                if start >= phone_to and (match := phone_run(text, start)):
                    end = match.end()
                    while text[end - 1] not in _DIGITS:
                        end -= 1
                    if end - start > 3:
                        phone_to = end
                        if 9 <= sum(c in _DIGITS for c in text[start:end]) <= 15:
                            found.append((start, 3, end))
            elif what == "scheme":
                if start >= url_to and (match := url_end(text, last + 1)):
                    end = match.end()
                    while end > last + 1 and text[end - 1] in ".,;:!?)]}":
                        end -= 1
                    if end > last + 1:
                        url_to = end
                        found.append((start, 4, end))
            elif what == "account":
                if start >= account_to and not (start and text[start - 1].isalnum()):
                    if match := iban_at(text, at := number_start(text, last + 1)):
                        code = match[0].replace(" ", "")
                        while len(code) >= 15 and not iban(code):
                            code = code[:-1]
                        if len(code) >= 15:
                            end = at
                            for c in code:
                                end = text.index(c, end) + 1
                            account_to = end
                            found.append((at, 5, end))
                            continue
                    if (match := number_after(text, last + 1)) and sum(c in _DIGITS for c in match[1]) >= 6:
                        account_to = match.end()
                        found.append((match.start(1), 5, account_to))
            elif start >= address_to:
                cue = lowered[start : last + 1]
                begin, end = start, 0
                if cue in ("rue", "calle"):
                    if not (start and text[start - 1].isalnum()) and (match := named_after(text, last + 1)):
                        end = match.end()
                elif cue in ("straße", "strasse", "platz"):
                    if match := house_after(text, last + 1):
                        end = match.end()
                        while begin > address_to and (text[begin - 1].isalpha() or text[begin - 1] == "-"):
                            begin -= 1
                elif not text[last + 1 : last + 2].isalnum():
                    house = -1
                    if text[start - 1 : start] == " ":
                        house = house_before(text, address_to, start, 3)
                    elif text[start - 1 : start] == "-":
                        space = text.rfind(" ", max(hyphen_to, address_to), start)
                        if space >= 0:
                            whole = word(text, space + 1, start - 1)
                            hyphen_house = house_before(text, address_to, space + 1, 2) if whole else -1
                        elif not word_rest(text, hyphen_to, start):
                            hyphen_house = -1
                        hyphen_to, house = start, hyphen_house
                    if house >= address_to:
                        begin, end = house, last + 1
                if end:
                    address_to = end
                    found.append((begin, 6, end))
        found.sort()
        return found

    def number_start(text: str, at: int) -> int:
        while at < len(text) and text[at] in " \t:#=":
            at += 1
        return at

    return spans_of


def find_pii(rows: DataFrame, text: str = "text", passed: dict[str, Column] | None = None) -> DataFrame:
    """The passed columns (doc_id unless given) and `found`: array of (start, kind, end)."""

    def factory():
        spans_of = span_finder()
        return lambda texts: [
            ([{"start": a, "kind": KINDS[k], "end": b} for a, k, b in spans_of(one)],) for one in texts
        ]

    made = "found array<struct<start: bigint, kind: string, end: bigint>>"
    return map_text(rows, text, passed, made, factory)


def digests() -> list[Column]:
    """The counts and joined spans of `found`."""
    joined = lambda spans: F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return [*map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans")]


def mask_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap become one."""
    parts, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            parts += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def mask_pii(rows: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns, with personal data in the text replaced. A null text stays null."""

    def factory():
        spans_of = span_finder()
        return lambda texts: [(mask_text(one, spans_of(one)),) for one in texts]

    masked = map_text(rows, text, WholeRow(), "masked string", factory)
    columns = [
        F.when(F.col("row")[name].isNotNull(), F.col("masked")).alias(name)
        if name == text
        else F.col("row")[name].alias(name)
        for name in rows.columns
    ]
    return masked.select(*columns)


