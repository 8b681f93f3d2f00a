"""Personal information in free text: a semi-Markov conditional random field over candidate spans."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotaloom.llm.gazetteer import GIVEN
from rotaloom.llm.leakage import _ACCENT, _SIGN, _SIGNS, _accent
from rotaloom.llm.spelling import unaccented

KINDS = ("email", "phone", "id_number", "address", "name")

#: Kinds of street.
STREETS_SV = "gatan|vägen|stigen|torget|liden|leden|backen|kroken|gränd|allén|platsen|gata|väg|stig|gränden"
STREETS_EN = r"Lane|Street|St\.|Road|Rd\.|Avenue|Ave\.|Crescent|Drive|Close|Square|Terrace|Court|Way"
COUNTRIES = "UK|USA|Sweden|Sverige|Germany|Deutschland|England|Scotland|Norway|Norge|Denmark|Danmark|Finland"

_GAP = r"(?:[ ~]|\\ |\\,|\r?\n[ \t]*(?:%+[ \t]*)?)"
_UP, _LOW = "A-ZÅÄÖÉÜØÆÁÈ", "a-zåäöéüøæßáè"
_CAP = rf"(?:[{_UP}][{_LOW}]+|[{_UP}]{{2,}})"
_TWO = rf"{_CAP}(?:--?{_CAP})?"
_NAMES = re.compile(
    rf"(?<![\w\\@\-]){_TWO}(?:{_GAP}{{1,2}}[{_UP}]\.)?{_GAP}{{1,2}}{_CAP}(?![\w@])"
    rf"|(?<![\w\\@\-]){_CAP},{_GAP}(?:{_TWO}(?:{_GAP}[{_UP}]\.)?|[{_UP}]\.)(?![\w@])"
    rf"|(?<![\w\\.@])(?:[{_UP}]\.(?:{_GAP}|(?=[{_UP}]))){{1,2}}{_CAP}(?![\w@])"
)
_FIRST = re.compile(r"[^\W\d_]*")
_DASH = r"(?:--?|–|‑)"
_DIGITS = re.compile(r"[+(]?\d(?:[\d() ~/.\-–]|\\[,; ])*\d")
_START = re.compile(r"(?<![\d.\-–+])[(\d]")  # where a number may begin inside a run
_BETWEEN_NUMBERS = " ~/\\,;"
_PHONES = [
    re.compile(r"(?:\+|00)\d{1,3}(?:[ ~/.\-–]|\\,)*(?:\(0\))?(?:(?:[ ~/.\-–]|\\,)*\(?\d+\)?){1,6}"),
    re.compile(r"\(0\d{1,3}\)(?:(?:[ ~/.\-–]|\\,)+\d{2,4}){1,4}"),
    re.compile(r"0\d{1,3}(?:[ ~/]|--?|\\,)*\d{2,4}(?:(?:[ ~.\-]|\\,)*\d{2,3}){1,3}"),
    re.compile(r"(?:1[ .\-])?\(?[2-9]\d{2}\)?[ .\-~]\d{3}[ .\-~]\d{4}"),
]
#: Fixed value: a phone number of an area code and six digits (eight in all) is only known by its groups.
_GROUPED = re.compile(r"0\d{1,2}(?:--?|[ ~/])\d{2,3}[ ~]\d{2}[ ~]?\d{2}")
_ID_SV = re.compile(rf"(?:\d{{2}})?\d{{6}}(?:{_DASH}|\+|[ ~])?\d{{4}}")
_ID_US = re.compile(r"\d{3}([ \-~])\d{2}\1\d{4}")
_HOST = r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]|\\-)*)"
_AT = re.compile(r"@|\(at\)|\[at\]|\{at\}|\$@\$| at (?=\w+ dot )", re.I)
_AT_SIGNS = ("(at)", "[at]", "{at}", "(AT)", "[AT]", " dot ", " DOT ")
_LIST_END = re.compile(r"\}(?:\\,|[ ~])?$")
_LIST = re.compile(r"\\?\{(?:[^{}@\\\r\n]|\\(?![{}])|(?:\r\n?|\n)(?![ \t]*[\r\n])){2,}\\?\}(?:\\,|[ ~])?")
_LOCAL = re.compile(r"(?:(?:[\w.+\-]|\\[_&])*(?:\w|\\_))(?:\\,|[ ~])?$")
_DOMAIN = re.compile(rf"(?:\\,|[ ~])?{_HOST}(?:(?:\.|[ ~]?[\[({{]dot[\])}}][ ~]?| dot ){_HOST})+", re.I)
_TOWN = rf"[{_UP}](?:[{_LOW}]+|[{_UP}]+)(?:[ ~](?!UK|USA)[{_UP}][{_LOW}]+)?"
_ADDRESS_SV = re.compile(rf"(?<!\w)(?:[{_UP}][{_LOW}]+ )?[{_UP}][{_LOW}{_UP}]*(?:{STREETS_SV}|{STREETS_SV.upper()}){_GAP}(?:nr\.?[ ~])?\d{{1,4}}(?!\d)(?:[ ~]?[A-Za-z](?![\w~]))?")
_TAIL_SV = re.compile(rf"(?:,|\\\\|\\newline)?(?:[ ~]|\r?\n[ \t]*(?:%+[ \t]*)?)*(?:(?:SE|S)-)?\d{{3}}[ ~]?\d{{2}}(?:[ ~]{_TOWN})?|(?:,[ ~]?|\\\\[ \r\n]*){_TOWN}")
_ADDRESS_EN = re.compile(rf"(?<![\w.,\-])\d{{1,4}}[A-Za-z]?[ ~](?:[{_UP}][{_LOW}]+[ ~]){{1,3}}(?:{STREETS_EN})(?![a-z])")
_TAIL_EN = re.compile(rf",?(?:[ ~]|\\\\|\r?\n[ \t]*)*{_TOWN}(?:,?[ ~](?:\d{{5}}|[A-Z]{{1,2}}\d[A-Z\d]? ?\d[A-Z]{{2}}))?")
_COUNTRY = re.compile(rf",[ ~](?:{COUNTRIES})\b")
_ZONE = re.compile(r"\\author\b|\\bibitem\b")
_ITEM_END = re.compile(r"\r?\n[ \t]*\r?\n|\\end\{|\\bibitem")
_SOURCE = re.compile(r"\\(?:[\"'`^~=.]|[uvHcdbkr](?![A-Za-z])|(?:aa|AA|ae|AE|oe|OE|o|O|ss|l|L)(?![A-Za-z]))")
_CODED = re.compile(rf"\{{(?:{_ACCENT.pattern}|{_SIGN.pattern})\}}|{_ACCENT.pattern}|{_SIGN.pattern}")

_NAME_LEFT = re.compile(r"(?:\bby|\bask|\bring|\bwith|\bto|\btackar|name:|participant|acknowledgements\}|\bthanks?|\bdr\.?|\bprof\.?|\bmr\.?|\bms\.?|\bfrom|\bherr|\bfrau|\bfru|dankt|kontakta|\band)\s*$", re.I)
_NAME_RIGHT = re.compile(r"\s*(?:\(?(?:pnr\b|\d{6})|&|,?\s*who\b|kindly|withdrew|about\b|för\b|at\b|på\b|,\s*\d|,\s*[A-ZÅÄÖ]\w+\s*\d|\()", re.I)
_BEFORE = re.compile(rf"[{_UP}](?:[{_LOW}]+|\.)[ ~-]$")
_RESULT = re.compile(r"\s*(?:--|inequality|theorem|scheme|lemma|conjecture|equation|criterion|method|model|effect|et al|\\etal|-sats|-Satz)", re.I)
_ID_LEFT = re.compile(r"(?:personnummer|pnr|id:|consent form|ssn|\(|&|identity|personal)\s*(?:no\.?|number|nr\.?)?\s*$", re.I)
_NOT_LEFT = re.compile(r"(?:\brun|grant no\.?|contract|doi|issn|isbn|catalogue lists|and|dnr|order|version|serial|ticket|batch|part|10\.\d+/\S*)[\s~:]*$", re.I)
_PHONE_LEFT = re.compile(r"(?:tel\.?|phone,?|called at|reachable on|på|call|mobile|fax|ring|&|tfn\.?|number|at|on)[\s~:]*$", re.I)

_GIVEN = {unaccented(g).lower() for g in GIVEN}
#: Usual endings of surnames.
_SURNAME = re.compile(r"(?:sson|sen|berg|borg|strom|lund|qvist|kvist|gren|dahl|man|mark|stedt|blad|ander|holm|vall|hjelm|felt|quist|son|mann|stein|ski|ska|escu|ova|dottir)$")


#: Words before or behind a name, and words of organisations and of titles, for names outside the lists.
_WARM_LEFT = re.compile(r"(?i:\bthanks?(?: go)?(?: to)?|\bgrateful to|\bindebted to|\btack(?: till|ar)|\bdank(?:t|en)|\bdr\.?|\bprof(?:\.|essor)?|\bmrs?\.?|\bms\.?|\bherrn?|\bfrau|\bfru|\bkontakta|\bcontact|\bname:|\bparticipant|\bvolunteer|\bpatient|\bsubject|\bask|\bring|acknowledgements\})" rf"(?:[\s~]+(?:{_TWO}|[{_UP}]\.)(?:[\s~]+[{_UP}]\.)?[\s~]+{_CAP}(?:,|,?[\s~]+(?:and|och|und)(?=[\s~])))*[\s~]*$")  # behind other names too
_COOL_LEFT = re.compile(r"\b(?:by|with|to|from|and|och|und|av|von|mit|at|of|in)[\s~]*$", re.I)
_WARM_RIGHT = re.compile(r"\s*(?:\(?(?:pnr\b|personnummer\b|\d{6,8}(?:--?|\+| )?\d{4})|&\s*\d{6}|,?\s*who\b|kindly\b|withdrew\b|left the study)", re.I)
_ORGANISATION = re.compile(r"\b(?:universit\w*|institut\w*|council|foundation|academy|school|college|department|centre|center|laborator\w*|society|press|verlag|group|team|project|program\w*|grant|fund|committee|office|agency|association|library|research|science|museum|hospital|new|north|south|east|west|san|los|monte|united|states)\b", re.I)
_TITLE = re.compile(r"(?:thanks?|professor|prof|dr|mrs?|ms|herrn?|frau|fru|tack|vi|we|ask|ring|contact|kontakta|participant|volunteer|patient|subject|name|the|a|an|in|on|to|by|from|for|with|and|letters|notes|dear)$")
_LOWER_WORD = re.compile(rf"(?<![^\W\d_])[{_LOW}]{{2,}}(?![^\W\d_])")


def decoded(text: str) -> tuple[str, list[int], list[int]]:
    """``text`` with accents written as commands turned into letters, and the places where offsets shift."""
    if not _SOURCE.search(text):
        return text, [0], [0]
    out, at, shift, last, size = [], [0], [0], 0, 0
    for m in _CODED.finditer(text):
        body = m[0]
        inner = body[1:-1] if body[0] == "{" else body
        sign = _ACCENT.fullmatch(inner) or _SIGN.fullmatch(inner)
        if not sign:
            continue
        letter = _accent(sign) if sign.re is _ACCENT else _SIGNS[sign[1]]
        if len(letter) != 1:
            continue
        out.append(text[last : m.start()])
        out.append(letter)
        size += m.start() - last
        at.append(size + 1)  # offsets after the letter
        size += 1
        shift.append(m.end() - size)
        last = m.end()
    out.append(text[last:])
    return "".join(out), at, shift


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(digits):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _dated(digits: str) -> bool:
    return 1 <= int(digits[-8:-6]) <= 12 and 1 <= int(digits[-6:-4]) <= 31


Span = tuple[int, int, str, tuple[str, ...]]  # start, end, kind, features


def candidates(text: str) -> list[Span]:
    """Candidate spans of all kinds with the features of the whole span and of its surroundings."""
    out: list[Span] = []
    for m in _AT.finditer(text) if "@" in text or any(sign in text for sign in _AT_SIGNS) else ():
        domain = _DOMAIN.match(text, m.end())
        local = domain and (_users(text, m.start()) or _local(text, m.start()))
        if local and (m[0] != "@" or not local[0].endswith((" ", "~"))):
            host = domain[0].lower()
            f = ["email:" + ("plain" if m[0] == "@" else "disguised"), "email:dot" if "." in host or "dot" in host else "email:nodot"]
            if local[0].startswith(("\\{", "{")):
                f.append("email:list")
            out.append((local.start(), domain.end(), "email", tuple(f)))
    for m in _DIGITS.finditer(text):
        if len(m[0]) >= 9 and sum(c.isdigit() for c in m[0]) >= (8 if _GROUPED.fullmatch(m[0]) else 9):
            out += _run(text, m)
    for m in _ADDRESS_SV.finditer(text):
        out += _extended(text, m, _TAIL_SV, "sv")
    for m in _ADDRESS_EN.finditer(text):
        out += _extended(text, m, _TAIL_EN, "en")
    at, zones, common = 0, [*_zones(text), (len(text), len(text))], set()
    for lo, hi in zones:
        while at < lo and (m := _NAMES.search(text, at)) and m.start() < lo:
            at = m.start() + max(1, len(_FIRST.match(m[0])[0]))  # the next candidate may begin with the next word
            common = common or {"", *_LOWER_WORD.findall(text)}
            f = _name_features(text, m, common)
            if f:
                out.append((m.start(), m.end(), "name", f))
        at = max(at, hi)
    return out


def _local(text: str, at: int) -> re.Match | None:
    """The user that ends at ``at``, however long: looked for in a stretch that grows while all of it is his."""
    back = 90
    while True:
        found = _LOCAL.search(text, max(0, at - back), at)
        if not found or found.start() > at - back or found.start() == 0:
            return found
        back *= 4


def _users(text: str, at: int) -> re.Match | None:
    """The bracketed list of users that ends at ``at``, from its opening bracket, however long."""
    end = _LIST_END.search(text, max(0, at - 3), at)
    begin = text.rfind("{", text.rfind("}", 0, end.start()) + 1, end.start()) if end else -1
    if begin < 0:
        return None
    return _LIST.fullmatch(text, begin - (text[begin - 1 : begin] == "\\"), at)


def _zones(text: str) -> list[tuple[int, int]]:
    """Where names are authors: ``\\author`` with its braces, and bibliography items up to a blank line."""
    out = []
    for m in _ZONE.finditer(text):
        if m[0] == "\\author":
            depth, i = 0, text.find("{", m.end())
            while 0 <= i < len(text):
                depth += (text[i] == "{" and text[i - 1] != "\\") - (text[i] == "}" and text[i - 1] != "\\")
                i += 1
                if depth <= 0:
                    break
            out.append((m.start(), i if i > 0 else m.end()))
        else:
            end = _ITEM_END.search(text, m.end())
            out.append((m.start(), end.start() if end else len(text)))
    return sorted(out)


def _unlisted(text: str, m: re.Match, long: list[str], common: set[str]) -> tuple[str, ...]:
    """Features of a possible name outside the lists: its form, its words elsewhere in the text (``common``: in lower case), its surroundings."""
    name = m[0]
    right, left = text[m.end() : m.end() + 32], text[max(0, m.start() - 90) : m.start()]
    words = [w.lower() for w in re.findall(r"[^\W\d_]{2,}", name)]
    warm, cool, behind = _WARM_LEFT.search(left), _COOL_LEFT.search(left), _WARM_RIGHT.match(right)
    f = ["other", "other:inverted" if "," in name else "other:initial" if len(long) == 1 else "other:plain", f"other:usual{min(2, sum(w in common for w in words))}"]
    f.append("other:warm" if warm else "other:cool" if cool else "other:noleft")
    f.append("other:behind" if behind else "other:noright")
    f += ["other:warmth"] * (bool(warm or behind))
    f += ["other:organisation"] * (_ORGANISATION.search(name) is not None)
    f += ["other:titled"] * (_TITLE.match(words[0]) is not None)
    f += ["other:result"] * (_RESULT.match(right) is not None)
    f += ["other:cited"] * (re.match(r"\s*\\?\\cite", right) is not None)
    f += ["other:partial"] * (_BEFORE.search(left) is not None and not warm)
    f += ["other:goeson"] * (re.match(rf"[ ~-][{_UP}][{_LOW}]", right) is not None)
    f += ["other:capitals"] * (name.isupper() and len(long) > 1)
    return tuple(f)


def _name_features(text: str, m: re.Match, common: set[str]) -> tuple[str, ...]:
    name = m[0]
    parts = re.findall(r"[^\W\d_]+", unaccented(name).lower())
    long = [p for p in parts if len(p) > 1]
    if not long:
        return ()
    given = sum(p in _GIVEN for p in parts)
    inverted = "," in name
    surname = long[0] if inverted else long[-1]
    shaped = _SURNAME.search(surname) is not None
    if not given and not (shaped and "." in name):
        return _unlisted(text, m, long, common)
    right, left = text[m.end() : m.end() + 24], text[max(0, m.start() - 24) : m.start()]
    f = [f"name:given{min(given, 1)}", f"name:shape{int(shaped)}", "name:inverted" if inverted else "name:plain"]
    if "." in name and len(long) == 1:
        f.append("name:initial")
    if surname in _GIVEN and not (shaped or given > 1):
        f.append("name:lastgiven")
    if _RESULT.match(right):
        f.append("name:result")
    if _NAME_LEFT.search(left):
        f.append("name:left")
    if _NAME_RIGHT.match(right):
        f.append("name:right")
    if re.match(r"\s*\\?\\cite", right):
        f.append("name:cited")
    if not given and "." not in name:
        f.append("name:unknown")
    if _BEFORE.search(left):
        f.append("name:partial")
    if parts[0] not in _GIVEN and len(parts[0]) > 1 and not inverted:
        f.append("name:oddfirst")
    return tuple(f)


def _extended(text: str, m: re.Match, tail: re.Pattern, kind: str) -> list[Span]:
    out = [(m.start(), m.end(), "address", ("address:" + kind,))]
    t = tail.match(text, m.end())
    if not t and kind == "sv":
        return out
    if t:
        f = ["address:" + kind, "address:town"] + (["address:code"] if re.search(r"\d{5}|\d{3}[ ~]?\d{2}", t[0]) else [])
        out.append((m.start(), t.end(), "address", tuple(f)))
        if kind == "en":
            first = re.compile(rf",?(?:[ ~]|\\\\|\r?\n[ \t]*)*{_TOWN}").match(text, m.end())
            if first and first.end() < t.end():
                out.append((m.start(), first.end(), "address", ("address:en", "address:town")))
        c = _COUNTRY.match(text, t.end())
        if c:
            out.append((m.start(), c.end(), "address", (*f, "address:country")))
    return out


def _run(text: str, run: re.Match) -> list[Span]:
    """Phone and identity numbers in a run of digits and separators, which may hold several."""
    first = run.start() + (run[0][0] == "(")
    starts = sorted({run.start()} | {run.start() + k.start() for k in _START.finditer(run[0])})
    own: dict[int, list[Span]] = {}
    ends, reach = set(), 0
    for p in starts:
        if text[p - 1 : p] == "/" and p > first and p - 1 not in ends:
            continue  # a slash inside a number, unless a whole number ends there
        later = [] if p <= first else ["later:inner" if p < reach else "later:apart", "later:signed" if re.match(r"\(|\d+-", text[p : p + 6]) else "later:bare"]
        own[p] = [(a, b, k, (*f, *later)) for a, b, k, f in _numbers(text, p, run.start() if later else p)]
        ends |= {b for _, b, _, _ in own[p]}
        reach = max([reach, *(b for _, b, _, _ in own[p])])
    out = [s for spans in own.values() for s in spans]
    begins = [p for p in own if own[p]]
    for p in own:
        for k, pattern in enumerate(_PHONES):
            whole = pattern.match(text, p)
            if not whole or re.search(r"[\w.\-]$", text[max(0, p - 1) : p]):
                continue
            for q in begins[bisect_right(begins, p) : bisect_right(begins, whole.end())]:  # numbers that it would run into
                end = len(text[p:q].rstrip(_BETWEEN_NUMBERS)) + p
                m = pattern.match(text, p, end)
                if m and m.end() == end and 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((p, end, "phone", (f"phone:form{k}", "phone:size", "phone:cut", "later:signed" if re.match(r"\+|\(|\d+-", m[0]) else "later:bare")))
    return out


def _numbers(text: str, start: int, run: int) -> list[Span]:
    """Phone and identity numbers that begin at ``start``, in a run of digits that begins at ``run``."""
    out = []
    left = text[max(0, run - 30) : run]
    around = ("not" if _NOT_LEFT.search(left) else "", "id" if _ID_LEFT.search(left) else "", "phone" if _PHONE_LEFT.search(left) else "")
    if run < start:
        around, left = (around[0], "", around[2]), text[start - 1 : start].replace("/", "")
    for pattern in (_ID_SV, _ID_US):
        m = pattern.match(text, start)
        if m and not re.match(r"[\d\w]|[-.]\d", text[m.end() : m.end() + 2]) and not re.search(r"[\w.\-/]$", left):
            digits = re.sub(r"\D", "", m[0])
            if pattern is _ID_SV and not _dated(digits):
                continue
            f = ["id:" + ("sv" if pattern is _ID_SV else "us")] + [f"id:{a}" for a in around if a]
            if pattern is _ID_SV:
                f.append("id:luhn" if luhn(digits[-10:]) else "id:badsum")
                f.append("id:century" if len(digits) == 12 else "id:short")
            else:
                f.append("id:range9" if digits[0] == "9" else "id:range")
            out.append((start, m.end(), "id_number", tuple(f)))
    for k, pattern in enumerate(_PHONES):
        m = pattern.match(text, start)
        if m and not re.match(r"[\d\w]|[-.]\d", text[m.end() : m.end() + 2]) and not re.search(r"[\w.\-/]$", left):
            digits = re.sub(r"\D", "", m[0])
            if (len(digits) >= 9 or len(digits) == 8 and _GROUPED.fullmatch(m[0])) and len(digits) <= 15:
                own = ["phone:short"] if len(digits) < 9 else [] if not _ID_SV.fullmatch(m[0]) or not _dated(digits) else ["phone:isid"]
                out.append((start, m.end(), "phone", (f"phone:form{k}", *own, *(f"phone:{a}" for a in around if a), "phone:long" if len(digits) > 13 else "phone:size")))
    return out


def score(span: Span, weights: dict[str, float]) -> float:
    return sum(weights.get(f, 0.0) for f in span[3]) + weights.get(span[2], 0.0)


def decode(spans: list[Span], weights: dict[str, float]) -> list[Span]:
    """The best scoring set of spans that don't overlap; text between them scores 0.

    Dynamic programming over span ends: the best of a prefix is that of a shorter prefix, or a span
    with the best before its start, so boundaries and kinds are chosen jointly."""
    order = sorted(spans, key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in order]
    best, take = [0.0], []
    for i, s in enumerate(order):
        before = bisect_right(ends, s[0], 0, i)
        with_it = best[before] + score(s, weights)
        take.append((with_it > best[-1], before))
        best.append(max(with_it, best[-1]))
    out, i = [], len(order)
    while i:
        taken, before = take[i - 1]
        if taken:
            out.append(order[i - 1])
            i = before
        else:
            i -= 1
    return out[::-1]


def log_partition(spans: list[Span], weights: dict[str, float]) -> tuple[float, list[float]]:
    """Log of the sum over all sets of spans that don't overlap, and each span's probability."""
    order = sorted(range(len(spans)), key=lambda i: (spans[i][1], spans[i][0], spans[i][2]))
    ends = [spans[i][1] for i in order]
    plus = lambda a, b: max(a, b) + log(1 + exp(-abs(a - b)))
    s = [score(spans[i], weights) for i in order]
    before = [bisect_right(ends, spans[i][0], 0, k) for k, i in enumerate(order)]
    forward = [0.0]
    for k in range(len(order)):
        forward.append(plus(forward[-1], forward[before[k]] + s[k]))
    back = [float("-inf")] * (len(order) + 1)
    back[-1] = 0.0
    for k in range(len(order) - 1, -1, -1):  # what can follow state k + 1 flows back to k and to before[k]
        back[k] = plus(back[k], back[k + 1]) if back[k] > float("-inf") else back[k + 1]
        v = back[k + 1] + s[k]
        back[before[k]] = plus(back[before[k]], v) if back[before[k]] > float("-inf") else v
    total = forward[-1]
    out = [0.0] * len(spans)
    for k, i in enumerate(order):
        out[i] = exp(forward[before[k]] + s[k] + back[k + 1] - total)
    return total, out


def fit(examples: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-3) -> dict[str, float]:
    """Weights that make the labelled spans likely: gradient ascent on the conditional log-likelihood."""
    prepared = []
    for text, gold in examples:
        spans = candidates(text)
        wanted = set(gold)
        prepared.append((spans, [(s[0], s[1], s[2]) in wanted for s in spans]))
    weights: dict[str, float] = {}
    for _ in range(rounds):
        for spans, truth in prepared:
            if not spans:
                continue
            _, p = log_partition(spans, weights)
            for s, t, q in zip(spans, truth, p):
                step = rate * (t - q)
                if abs(step) > 1e-4:
                    for f in (*s[3], s[2]):
                        weights[f] = weights.get(f, 0.0) * (1 - decay * rate) + step
    return weights


@lru_cache(1)
def trained(examples: int = 1500, seed: int = 7) -> tuple[tuple[str, float], ...]:
    """The model, trained on ``examples`` sentences each of the built-in labelled generators (a fixed bound)."""
    from rotaloom.llm.personal_training import runs, sentences, short_numbers, unlisted

    return tuple(sorted(fit([*sentences(examples, seed), *unlisted(examples, seed), *runs(examples, seed), *short_numbers(examples // 10, seed)]).items()))


def find(text: str, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """Start, end and kind of the personal information in ``text``, in offsets of ``text`` itself."""
    plain, at, shift = decoded(text)
    found = decode(candidates(plain), weights)
    if len(at) == 1:
        return [(a, b, k) for a, b, k, _ in found]
    start = lambda i: i + shift[bisect_right(at, i) - 1]
    return [(start(a), start(b - 1) + 1 if bisect_right(at, b) == bisect_right(at, b - 1) else start(b), k) for a, b, k, _ in found]


def replace(text: str, weights: dict[str, float]) -> str:
    """``text`` with typed placeholders such as ``[EMAIL]`` for what was found."""
    out, last = [], 0
    for a, b, kind in find(text, weights):
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join(out) + text[last:]


def find_personal(documents: DataFrame, examples: int = 1500) -> DataFrame:
    """Every piece of personal information of each document.

    ``documents``: ``doc_id``, ``text``; further columns are ignored. Result: ``doc_id``, ``kind``
    (email, phone, id_number, address, name), ``value`` exactly as it stands in the source, ``start``
    and ``end`` (offsets in code points). Null ids are kept; null and blank texts give no rows;
    repeated rows give repeated rows. Texts are read whole, in one pass without a shuffle.

    A semi-Markov conditional random field: patterns propose candidate spans, each scored by features
    of the whole span (form, check sum, known given name, town) and of its surroundings; names outside
    the lists need a context that speaks for a person; dynamic
    programming picks the best set that doesn't overlap. Weights are trained in the driver on
    ``examples`` sentences of the labelled generator.
    """
    weights = documents.sparkSession.sparkContext.broadcast(dict(trained(examples)))
    kept = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    schema = T.StructType([T.StructField("doc_id", kept.schema["doc_id"].dataType), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = weights.value
        for batch in batches:
            rows = [(d, k, t[a:b], a, b) for d, t in zip(batch.doc_id, batch.text) for a, b, k in find(t, w)]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "value", "start", "end"])

    return kept.mapInPandas(run, schema)


def mask_personal(documents: DataFrame, examples: int = 1500) -> DataFrame:
    """``documents`` (``doc_id``, ``text``) with typed placeholders for personal information; null stays null."""
    weights = documents.sparkSession.sparkContext.broadcast(dict(trained(examples)))

    @F.pandas_udf(T.StringType())
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: replace(t, weights.value), na_action="ignore")

    return documents.select("doc_id", masked("text").alias("text"))
