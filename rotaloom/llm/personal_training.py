"""A generator of labelled sentences for the personal-information model; all content is invented."""

from __future__ import annotations

import random

from rotaloom.llm.gazetteer import GIVEN
from rotaloom.llm.personal import luhn

_STEMS = ["Berg", "Lund", "Ek", "Sjö", "Norr", "Torn", "Kvist", "Alm", "Gran", "Hag"]
_ENDS = ["berg", "ström", "gren", "lind", "man", "crona", "fors", "hage", "vik", "bom", "sköld", "näs"]
_STREETS = ["Björkhags", "Ekbacks", "Norra", "Smedje", "Kvarn", "Storängs", "Lärkhagar"]
_KINDS = ["gatan", "vägen", "stigen", "torget", "liden", "leden", "backen", "kroken", "gränd", "allén"]
_TOWNS = ["Ekstad", "Norrhamn", "Bergköping", "Lundstrand", "Almbo", "Granvik"]


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _name(r: random.Random) -> str:
    given, family = r.choice(GIVEN), r.choice(_STEMS) + r.choice(_ENDS)
    if r.random() < 0.1:
        given += "-" + r.choice(GIVEN)
    if r.random() < 0.1:
        family = family.upper()
    return r.choice([f"{given} {family}"] * 5 + [f"{given}~{family}", f"{family}, {given}", f"{given[0]}. {family}", f"{given} {r.choice('ABEKLM')}. {family}"])


def _person_number(r: random.Random, valid: bool = True) -> str:
    day = f"{r.choice([r.randint(30, 99), r.randint(0, 9)]):02}{r.randint(1, 12):02}{r.randint(1, 28):02}"
    while True:
        body = day + _digits(r, 4)
        if luhn(body) == valid:
            break
    return r.choice(["", "", "19"]) + body[:6] + r.choice(["-", "-", "--", " ", ""]) + body[6:]


def _id(r: random.Random) -> str:
    sep = r.choice("-- ")
    return _person_number(r) if r.random() < 0.7 else f"9{_digits(r, 2)}{sep}{_digits(r, 2)}{sep}{_digits(r, 4)}"


def _phone(r: random.Random) -> str:
    a, b, c = _digits(r, 3), _digits(r, 2), _digits(r, 2)
    return r.choice([
        f"+46 31 {a} {b} {c}", f"+46~70~{a}~{b}~{c}", f"0046 31 {a}{b}{c}", f"+46 (0)70-{a}{b}{c}", f"(031) {a} {b} {c}", f"031-{a} {b} {c}", f"070{a}{b}{c}",
        f"031--{a}\\,{b}\\,{c}", f"+46/31/{a}{b}{c}", f"+1 (555) 555-{b}{c}", f"1-800-555-{b}{c}", f"212.555.{b}{c}", f"+4670{a}{b}{c}", f"070-{a} {b} {c}",
    ])


def _address(r: random.Random) -> str:
    n = r.randint(1, 180)
    if r.random() < 0.6:
        street = f"{r.choice(_STREETS)}{r.choice(_KINDS)}" if r.random() < 0.95 else f"Norra {r.choice(_STREETS[3:])}{r.choice(_KINDS)}"
        number, town, code = f"{n}{r.choice(['', '', '', 'A', ' B', 'c'])}", r.choice(_TOWNS), f"{_digits(r, 3)} {_digits(r, 2)}"
        return r.choice([f"{street} {number}, {code} {town}", f"{street} {number}, SE-{code} {town}", f"{street} {number}, {town}", f"{street}~{number}\\\\{code}~{town}"])
    town = r.choice(["Northford", "Port Ellery", "Ashbury", "Cold Cross"])
    street = f"{n} {r.choice(['Mill', 'Old Toll', 'Harbour', 'Quay'])} {r.choice(['Lane', 'St.', 'Road', 'Avenue', 'Crescent'])}"
    return r.choice([f"{street}, {town}", f"{street}, {town}, UK", f"{street}, {town} {_digits(r, 5)}"])


def _email(r: random.Random) -> str:
    user = r.choice(["anna.berg", "k\\_lund", "erik42", "maria+lists", "nils-ek"])
    host = r.choice([("lab", "example", "net"), ("dept", "uni", "example"), ("mail", "test")])
    return r.choice([f"{user}@{'.'.join(host)}"] * 3 + [f"{user}(at){'.'.join(host)}", f"{user} [at] {' [dot] '.join(host)}", f"{user}\\,@\\,{'.'.join(host)}", f"\\{{anna, berg\\}}@{'.'.join(host)}"])


_MAKE = {"name": _name, "id_number": _id, "phone": _phone, "address": _address, "email": _email}
_CARRIERS = [
    "Thanks go to {name} for the samples.", "The site was mapped by {name}, who answers at {phone}.", "% ask {name} for the logs, call {phone} first",
    "Subject {name} ({id_number}) left the study.", "{name} & {id_number} & {phone} \\\\", "The form {id_number} was filled in by {name} at {address}.",
    "Letters reach {name}, {address}.", "\\thanks{{Contact {name}, {address}; e-mail: \\texttt{{{email}}}, tel.~{phone}.}}", "Vi tackar {name} för hjälp; frågor till {email}.",
    "name: {name}\nid: {id_number}\nmail: {email}", "Notes (pnr {id_number}) are kept at {address} and sent on request, phone, {phone}.", "Write to {email}.", "Volunteer {name} ({id_number}) stayed.", "Professor {name} kindly shared it.", "We thank {name} and {name} for help.",
    "A draft went to {email} and to {name}.", "Personen med personnummer {id_number} bor på {address}.", "{name} kindly lent the data.", "ring {name} på {phone}",
]


def _decoy(r: random.Random) -> str:
    a, b = r.choice(_STEMS) + r.choice(_ENDS), r.choice(_STEMS) + r.choice(_ENDS)
    given = r.choice(GIVEN)
    return r.choice([
        f"The {a}--{b} inequality bounds the rank.", f"The {given} {a} theorem is sharp.", f"Following {a} and {b}, we omit it.", f"The {given[0]}. {a} scheme is stable.",
        f"Run 20{_digits(r, 2)}0{r.randint(1, 9)}{r.randint(10, 28)}-{_digits(r, 4)} was discarded.", f"Run {_person_number(r, False)} was discarded.",
        f"funded under grant no.~20{r.randint(10, 24)}-{_digits(r, 5)} and contract 31-390-{_digits(r, 4)}.", f"as DOI 10.5555/data.{_digits(r, 8)}.",
        f"lists {_digits(r, 4)}-{_digits(r, 4)} as an ISSN and 978-0-{_digits(r, 4)}-{_digits(r, 4)}-0 as an ISBN.", f"was {_digits(r, 4)} mm on Road~{_digits(r, 2)} of the track.",
        f"Results of {a} et al.\\ on the matter.", "\\def\\lab@hook{\\relax}",
    ])


def sentences(count: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``count`` texts with the spans (start, end, kind) of the personal information in them."""
    r = random.Random(seed)
    out = []
    for i in range(count):
        if i % 3 == 2:
            out.append((_decoy(r), []))
            continue
        text, spans = "", []
        pattern = r.choice(_CARRIERS)
        while pattern:
            head, brace, rest = pattern.partition("{")
            text += head.replace("}}", "}")
            if not brace:
                break
            if rest.startswith("{"):
                text, pattern = text + "{", rest[1:]
                continue
            kind, _, pattern = rest.partition("}")
            value = _MAKE[kind](r)
            spans.append((len(text), len(text) + len(value), kind))
            text += value
        out.append((text, spans))
    return out


_OTHERS = ["Hans", "Ingrid", "John", "Mary", "Pierre", "Jürgen", "Agnieszka", "Carlos", "Wei", "Fatima", "Otto", "Greta", "Ivan", "Priya", "Kofi", "Heidi"]
_FAMILIES = ["Müller", "Smith", "Novak", "Dupont", "Kowalska", "García", "Zhang", "Haddad", "Brown", "Weber", "Petrov", "Rao", "Mensah", "Jansen", "Rossi", "Fischer"]
_TERMS = ["Random Forest", "Gaussian Elimination", "Hilbert Space", "Neural Network", "Finite Element", "Main Theorem", "Central Limit", "Markov Chain", "Data Set", "Lower Bound"]
_PROPER = ["Monte Carlo", "New York", "Los Alamos", "San Diego", "Springer Verlag", "North Sea", "Nordic Council", "Ekstad University", "Royal Academy", "Baltic Institute"]
_WARM = [
    "Thanks to {} for the samples.", "Thanks go to {} for help.", "We thank {} for comments.", "I am grateful to {}.", "Vi tackar {} för hjälp.", "Wir danken {} sehr.", "Professor {} stayed.", "The visit of Dr. {} was short.",
    "Mr. {} signed.", "Fru {} bor kvar.", "{} (pnr NUMBER) left.", "{} (NUMBER) stayed.", "{} & NUMBER \\\\", "Participant {} did not answer.", "% ask {} first", "% ring {} om figur 3", "Kontakta {} om data.", "name: {}\nid: x", "{} kindly lent the data.",
    "We spoke to {}, who kept the notes.", "{} withdrew.",
]
_COLD = ["results by {} are old", "compared with {} here", "We move from {} to the next part", "{} is used below.", "See {} for more.", "In {} we find it.", "The {} method", "as in {} and others", "{}, {} and more", "\\section{{{}}}", "close to {} it fails", "{} \\cite{{a}} holds"]


def unlisted(count: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``count`` texts with and without names that no list holds, labelled as in ``sentences``."""
    r = random.Random(seed + 1)
    out = []
    for i in range(count):
        given, family = r.choice(_OTHERS), r.choice(_FAMILIES)
        name = r.choice([f"{given} {family}"] * 4 + [f"{given}~{family}", f"{family}, {given}", f"{given[0]}. {family}", f"{given} {r.choice('ABEKLM')}. {family}"])
        term = r.choice(_TERMS)
        if i % 2 == 0:
            text, number = r.choice(_WARM), _person_number(r)
            at, text = text.index("{}"), text.format(name)
            id_at = text.find("NUMBER")
            out.append((text.replace("NUMBER", number), [(at, at + len(name), "name")] + [(id_at, id_at + len(number), "id_number")] * (id_at >= 0)))
        elif i % 8 == 1:
            out.append((r.choice(["We thank the {} for funds.", "Thanks to {} for funds.", "supported by {} in part"]).format(r.choice(_PROPER)), []))
        elif i % 8 == 3:
            out.append((r.choice(_WARM).format(term).replace("NUMBER", "x") + f" A {term.lower()} is usual.", []))
        else:
            out.append((r.choice(_COLD).replace("{}", "{0}").format(r.choice([term, r.choice(_PROPER), f"{family}, {given[0]}."])) + r.choice(["", f" A {term.lower()} is usual."]), []))
    return out


_SHORT = ["Ring 08-{} idag.", "tel. 08-{}", "tfn 019-{}", "% call 08-{} first", "phone, 08-{}.", "\\texttt{{08-{}}}"]


def short_numbers(count: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``count`` texts with phone numbers of eight digits, and as many numbers in groups that are none."""
    r = random.Random(seed + 3)
    out = []
    for i in range(count):
        value = f"{_digits(r, 2)} {_digits(r, 2)} {_digits(r, 2)}"
        if i % 2:
            out.append((r.choice(["values 0{} {} here", "run 0{}-{} was discarded", "ISSN 0{}-{}", "version 0{}/{}"]).format(_digits(r, 1), value), []))
        else:
            text = r.choice(_SHORT).format(value)
            at = text.index("0")
            out.append((text, [(at, at + 3 + len(value) + text.startswith("tfn"), "phone")]))
    return out


_RUNS = ["{phone} / {phone}", "{phone} {phone}", "{id_number} {phone}", "{phone}/{phone}", "{phone} {id_number}", "{day} {phone}", "{item}. {phone}", "({item}) {phone}", "tel. {phone} / {phone}", "ring {phone} {phone}", "{item}. {id_number}", "{item} {day} {id_number} {phone}", "{phone}", "tel. {phone}", "{name} & {id_number}"]


def runs(count: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``count`` texts with several numbers, dates and list numbers in one run of digits, labelled as in ``sentences``."""
    r = random.Random(seed + 2)
    out = []
    for i in range(count):
        text, spans = "", []
        if i % 3 == 2:
            rows = [" ".join(f"{r.choice(['0', '', '', '1.', '12.'])}{_digits(r, r.randint(2, 4))}" for _ in range(r.randint(4, 9))) for _ in range(2)]
            out.append((r.choice([f"values {rows[0]} here", f"{rows[0]} & {rows[1]}", f"run {_person_number(r, False)} {_digits(r, 4)}", f"ISSN 0317-{_digits(r, 4)} 2024-05-01 12:30"]), []))
            continue
        for k, part in enumerate(r.choice(_RUNS).split("{")):
            if k:
                kind, _, part = part.partition("}")
                if kind in _MAKE:
                    value = _MAKE[kind](r)
                    spans.append((len(text), len(text) + len(value), kind))
                else:
                    value = str(r.randint(1, 20)) if kind == "item" else f"20{r.randint(10, 29)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"
                text += value
            text += part
        out.append((text, spans))
    return out
