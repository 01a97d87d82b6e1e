"""Places in one text that may be personal information: shapes with their contexts. Grammar only; what counts is decided
over the whole corpus in personal.py."""

from __future__ import annotations

import re
from bisect import bisect_left

# ---- fixed values: words that name kinds of identity numbers, titles, streets and openings -------------------------
ID_LABEL = re.compile(
    r"passport|passeport|pasaporte|reisepass|social security|ssn\b|tax id|tax number|steuer|national insurance|insurance number|nino\b|driving licen[cs]e|driver'?s licen[cs]e|"
    r"führerschein|permis de conduire|carnet de conducir|identity card|id card|identity number|national id|dni\b|nie\b|nif\b|personalausweis|ausweis|carte d.identité|sécurité sociale|"
    r"seguridad social|documento|pièce d.identité|licence number|license number",
    re.I,
)
NOT_ID = re.compile(r"(?:order|part|batch|invoice|tracking|serial|version|article|ean|item|model|ticket|case|sku|ref|reference|lot|charge|bestell\w*|rechnung\w*|commande|facture|pedido|factura|lote|auftrag\w*)[\s.:#°]*(?:no|nr|number|num)?[\s.:#°]*$", re.I)
TITLES = frozenset("mr mrs ms miss mx dr prof sir frau herr madame monsieur mme mlle señor señora señorita sr sra don doña".split())
OPENINGS = frozenset("ask hi hello dear mail call contact write send thanks signed regards from to by applicant phone tel yours kind best please our the for cc hallo liebe lieber bonjour hola estimado estimada name".split())
STREETS = (
    "street|st|road|rd|lane|ln|avenue|ave|drive|dr|way|yard|row|quay|close|court|ct|hill|square|sq|boulevard|blvd|terrace|place|pl|crescent|gardens|mews|walk|ropewalk|wharf|parade|alley|"
    "green|rise|view|grove|park|bridge|gate|mill|cross|path|track|circle|cir|loop|parkway|pkwy|highway|hwy|plaza"
)
# ---- end of fixed values ------------------------------------------------------------------------------------------

_U, _L = "A-ZÀ-ÖØ-ÞŁŚŻŽŠČ", "a-zß-öø-ÿłśżžšč"
_WORD = rf"[{_U}][{_U}{_L}'’]*(?:-[{_U}{_L}][{_U}{_L}'’]*)*"

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
_LOCAL = re.compile(r"[A-Za-z0-9](?:[\w.%+\-]*\w)?$", re.A)
_DOMAIN = re.compile(rf"(?:{_LABEL}\.)+[A-Za-z]{{2,}}")
_SPELLED = re.compile(
    rf"(?<![\w.+\-])[A-Za-z0-9](?:[\w.%+\-]*[\w])?(?:\s*[\[({{<]\s*at\s*[\])}}>]\s*|\s+at\s+|\s*[@＠]\s*){_LABEL}(?:(?:\s*[\[({{<]\s*(?:dot|punkt|point|punto)\s*[\])}}>]\s*|\s+dot\s+|\.){_LABEL})*"
    rf"(?:\s*[\[({{<]\s*(?:dot|punkt|point|punto)\s*[\])}}>]\s*|\s+dot\s+|\.)[A-Za-z]{{2,}}",
    re.I | re.A,
)
_NUMBER = re.compile(r"\d[\d().\-/  ‑– ]{4,}\d(?![\w]|[.,/]\d)")
_SIGN = re.compile(r"(?:\+\s?|\()$")
_DIGITS = re.compile(r"\d[ \-]?\d[ \-]?\d[ \-]?\d[A-Z0-9]*(?:[ \-](?=[A-Z0-9]*\d)[A-Z0-9]{1,9}|[ \-][A-Z](?![\w]))*(?![a-zà-ÿ])")
_BEFORE = re.compile(r"(?:(?<![\w\-])[A-Z]{1,5} )?(?:(?<!\w)[A-Z0-9]{1,9}-){0,3}[A-Z0-9]*$")
_TOWN = rf"(?:\d{{4,5}} )?{_WORD}(?: {_WORD})?(?: \d{{4,5}})?"
_UNIT = re.compile(r"(?<!\w)(?:Flat|Unit|Apt\.?|Apartment|Suite|Room|Floor|Studio|FLAT|UNIT|APT\.?|SUITE) [A-Z0-9]{1,4},? $")
_HOUSE = re.compile(rf"\d{{1,5}}[A-Za-z]?,? (?:[NSEW]\.? )?(?=[{_U}])")
_ENGLISH = re.compile(rf"(?:{_WORD} ){{0,3}}(?i:{STREETS})\b\.?(?:(?:,? ?\n|,? ){_TOWN}|(?=$|[\s.,;)]))")
_BOX = re.compile(rf"\b(?i:P\.? ?O\.? ?Box|Post(?: Office)? Box|Postfach|Apartado(?: de correos)?|B\.?P\.?|Boîte postale|Casilla) ?\d{{1,6}}(?:,? ?\n|, | )?(?:{_TOWN})?")
_GERMAN = re.compile(rf" \d{{1,4}} ?[a-z]?,? ?\n?(?:\d{{4,5}} )?{_WORD}")
_GERMAN_STREET = re.compile(
    rf"(?<![\w\-])(?:{_WORD}(?:straße|strasse|str\.|platz|weg|gasse|allee|ufer|ring|damm|markt|hof|steig|-Straße|-Platz|-Weg|-Allee|-Ring|-Ufer)|(?:{_WORD} )?(?:Straße|Strasse|Platz|Weg|Allee|Gasse)|(?:Am|An der|Im|Zur|Zum|Auf der|Unter den) {_WORD})$"
)
_FRENCH = re.compile(rf"\d{{1,4}}(?: (?:bis|ter|quater))?,? (?i:rue|avenue|av\.|boulevard|bd|chemin|place|quai|allée|impasse|route|cours|passage|sentier|square|ruelle|montée) [^\n,;.]{{2,40}},? ?\n?(?:\d{{4,5}} )?{_WORD}")
_FRENCH_HINT = re.compile(r"\d(?: (?:bis|ter|quater))?,? (?=[ravbcpqismRAVBCPQISM][uvodhlanmeéoi])")
_FRENCH_HINTS = (" rue", "avenue", "av.", "boulevard", " bd", "chemin", "place", "quai", "allée", "impasse", "route", "cours", "passage", "sentier", "square", "ruelle", "montée")
_SPANISH = re.compile(rf"(?<![\w\-])(?:(?i:calle|c/|avenida|avda\.?|paseo|plaza|camino|carretera|ronda|travesía|callejón|cuesta|vía)|C\.) [^\n,;.0-9]{{2,40}},? (?:n\.?º ?)?\d{{1,4}}(?: ?[a-zA-Z](?!\w))?(?:, ?\d{{1,2}}\.? ?[ºª°] ?[A-Za-z]{{0,4}})?,? ?\n?(?:\d{{4,5}} )?{_WORD}")
_SPANISH_HINT = (" c. ", "\nc. ", "calle", "c/", "avenida", "avda", "paseo", "plaza", "camino", "carretera", "ronda", "travesía", "callejón", "cuesta", "vía")
_WORD_REST = rf"[{_U}{_L}'’]*(?:-[{_U}{_L}][{_U}{_L}'’]*)*"
#: A capital that doesn't start a sentence going on in lower case, and the capitalised words that follow it.
_NAMES = re.compile(
    rf"[{_U}](?<![\w'’@.\-/+].)(?!(?:(?<=[.!?] .)|(?<=\n.)){_WORD_REST} [{_L}])(?:\.(?:-?[{_U}]\.)?(?: [{_U}]\.)? {_WORD}|{_WORD_REST})(?:(?: [{_U}]\.){{1,2}}(?= [{_U}][{_U}{_L}]))?"
    rf"(?: (?:von |van |de |la |di |da )?{_WORD}(?: [{_U}]\.(?= [{_U}]))?){{0,3}}(?:, {_WORD}(?: [{_U}]\.)?)?(?![\w@]|-\d)"
)
_SLOT = re.compile(rf"(?<=: )[{_L}]+(?:-[{_L}]+)?(?: [{_L}]\.)?(?: [{_L}'’\-]+){{0,2}}(?=;)")
_TOKENS = re.compile(r"\w+|\W+")
_DIGIT_RUN = re.compile(r"[0-9]+")
_START = re.compile(r"(?:^|[.!?…:]['\"”)]*\s+|\n[\s\-*•>]*)$")

_LABELLED = re.compile(rf"(?:{ID_LABEL.pattern})[\s:.#°]*(?:no|nr|n)?[\s:.#°]*$", re.I)
_NO_PREFIX = re.compile(r"^(?:ID|EAN|SSN|DNI|NIE|NIF|TAX|NO|NR|SKU|REF|ISBN|PIN|VAT) ")
_AT_DOMAIN = re.compile(r" at [a-z0-9\-]+(?:\.[a-z0-9\-]+)*\.[a-z]{2}", re.A)
_AT_HINTS = ("(at)", "[at]", "{at}", "<at>", "( at )", "[ at ]", "(@)", "[@]", " at\n")
_BOX_HINTS = ("box", "postfach", "apartado", "boîte", "boite", "b.p.", "bp ", "casilla")


def phone_like(s: str) -> bool:
    """Whether a span of digits and separators is written as a phone number."""
    d = re.sub(r"\D", "", s)
    if s[0] == "+":
        return 8 <= len(d) <= 15
    if s.startswith("00"):
        return 10 <= len(d) <= 16
    groups = [len(g) for g in re.findall(r"\d+", s)]
    if s[0] == "(":
        return 9 <= len(d) <= 12
    if re.fullmatch(r"1?[ .\-]?\d{3}[ .\-]\d{3}[ .\-](?:\d{4}|\d{3} ?\d)", s):
        return True
    if d[0] == "0" and 9 <= len(d) <= 12 and len(groups) >= 2:
        return groups[0] >= 2
    return len(d) == 9 and groups == [3, 3, 3] and d[0] in "6789"


def _local_before(text: str, at: int) -> int | None:
    """Where the mailbox that ends at a position begins, however long it is; None where there is none."""
    width = 64
    while m := _LOCAL.search(text, max(0, at - width), at):
        if m.start() > at - width or width >= at:
            return m.start()
        width *= 4
    return None


def _spans_email(text: str, low: str):
    """(start, end, whether the form alone decides)."""
    for sign in "@＠":
        at = text.find(sign)
        while at >= 0:
            a, n = _local_before(text, at), _DOMAIN.match(text, at + 1)
            if a is not None and n:
                yield a, n.end(), True
            at = text.find(sign, at + 1)
    if any(h in low for h in _AT_HINTS) or " at " in low and (" dot " in low or _AT_DOMAIN.search(low)) or "@ " in text or " @" in text:
        for m in _SPELLED.finditer(text):
            s = m.group(0)
            yield m.start(), m.end(), bool(re.search(r"[\[({<]\s*at\s*[\])}>]|[@＠]", s, re.I) or re.search(r"\sdot\s|[\[({<]\s*dot", s, re.I))


def _spans_address(text: str, low: str):
    """(start, end, whether the form alone decides)."""
    if any(h in low for h in _BOX_HINTS):
        for m in _BOX.finditer(text):
            yield m.start(), m.end(), True
    for m in _HOUSE.finditer(text):
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "-/.,_"):
            continue
        n = _ENGLISH.match(text, m.end())
        if n:
            u = _UNIT.search(text, max(0, m.start() - 20), m.start())
            yield u.start() if u else m.start(), n.end(), True
        elif n := _LOOSE.match(text, m.end()):
            yield m.start(), n.end(), False
    for m in _GERMAN.finditer(text):
        n = _GERMAN_STREET.search(text, max(0, m.start() - 40), m.start())
        if n:
            yield n.start(), m.end(), True
    for m in _FRENCH_HINT.finditer(text) if any(h in low for h in _FRENCH_HINTS) else ():
        at = m.start()
        while at > 0 and text[at - 1].isdigit():
            at -= 1
        n = _FRENCH.match(text, at)
        if n:
            yield at, n.end(), True
    if any(h in low for h in _SPANISH_HINT):
        for m in _SPANISH.finditer(text):
            yield m.start(), m.end(), True


def contexts(kind: str, text: str, start: int, end: int, sides_only: bool = False) -> list[str]:
    """Lexical patterns of a place: two words before it, two after it, and one on each side; digits and case don't count."""
    left = _TOKENS.findall(text[max(0, start - 40) : start])[-4:]
    right = _TOKENS.findall(text[end : end + 40])[:4]
    if left and not left[-1][-1].isalnum():
        left1, left2 = "".join(left[-2:]), "".join(left)
    else:
        left1, left2 = "".join(left[-1:]), "".join(left[-3:])
    if right and not right[0][0].isalnum():
        right1, right2 = "".join(right[:2]), "".join(right)
    else:
        right1, right2 = "".join(right[:1]), "".join(right[:3])
    found = [f"{kind}\tB {left1}\t{right1}"] if sides_only else [f"{kind}\tL {left2}", f"{kind}\tR {right2}", f"{kind}\tB {left1}\t{right1}"]
    return [_DIGIT_RUN.sub("0", p.lower()) for p in found]


def shape(code: str) -> str:
    return re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", code))


class _Taken:
    """Places in order that nothing else may overlap."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def free(self, a: int, b: int) -> bool:
        at = bisect_left(self.starts, b)
        return not at or self.ends[at - 1] <= a

    def add(self, a: int, b: int) -> None:
        at = bisect_left(self.starts, a)
        self.starts.insert(at, a)
        self.ends.insert(at, b)


#: Capitalised words and a town after a house number, without a word for a street: an address only where its surroundings say so.
_LOOSE = re.compile(rf"(?:{_WORD} ){{0,2}}{_WORD}, (?:\d{{4,5}} )?{_WORD}(?: \d{{4,5}})?")


def mentions(text: str, given: frozenset[str]) -> list[tuple[int, int, str, bool, bool, str, list[str]]]:
    """(start, end, kind, sure, seed, instance, patterns) of every place that may be personal information; given names in lower case.

    sure: the form alone decides, as for emails, addresses and phone numbers in usual or evaded forms, labelled numbers and
    names of a given name and another. seed: it teaches patterns. What is not sure is a candidate: other numbers, spelled
    emails, addresses without a word for a street, other capitalised words."""
    taken = _Taken()
    free = taken.free
    out = []
    low = text.lower()
    loose = []
    for a, b, certain in _spans_email(text, low):
        if free(a, b):
            if certain:
                taken.add(a, b)
                out.append((a, b, "email", True, True, "", contexts("e", text, a, b)))
            else:
                loose.append((a, b, "email", "spelled"))
    for a, b, certain in _spans_address(text, low):
        b -= len(text[a:b]) - len(text[a:b].rstrip(" \n,"))
        if certain and free(a, b):
            taken.add(a, b)
            out.append((a, b, "address", True, True, "", contexts("a", text, a, b)))
        elif not certain:
            loose.append((a, b, "address", "loose"))
    for m in _NUMBER.finditer(text):
        a, b = m.span()
        a = n.start() if (n := _SIGN.search(text, max(0, a - 2), a)) else a
        if a and (text[a - 1].isalnum() or text[a - 1] in ".,/+#-_"):
            continue
        s = text[a:b]
        while s.count(")") > s.count("("):
            s = s[: s.rindex(")")].rstrip(" .-/")
        b = a + len(s)
        if not free(a, b) or NOT_ID.search(text[max(0, a - 30) : a]):
            continue
        if not phone_like(s):
            if 6 <= sum(c.isdigit() for c in s) <= 15:
                loose.append((a, b, "phone", shape(s)))
        elif s[0] in "+(0" or not _LABELLED.search(text[max(0, a - 28) : a]):
            taken.add(a, b)
            out.append((a, b, "phone", True, True, shape(s), contexts("p", text, a, b)))
    for a, b, kind, instance in loose:
        if free(a, b):
            out.append((a, b, kind, False, False, instance, contexts(kind[0], text, a, b)))
    for m in _DIGITS.finditer(text):
        a, b = m.span()
        a = _BEFORE.search(text, max(0, a - 16), a).start()
        if n := _NO_PREFIX.match(text[a:b]):
            a += n.end()
        s = text[a:b].rstrip(" -")
        b = a + len(s)
        if sum(c.isdigit() for c in s) < 4 or len(s) > 20 or len(s) < 6 or not free(a, b):
            continue
        before, after = text[max(0, a - 40) : a], text[b : b + 40]
        seed = bool((ID_LABEL.search(before[-28:]) and re.search(r"[\w.]\s*:?\s*$", before)) or re.match(r"\s+(?:as|is|was)\s+(?:the|his|her|a)\s+", after) and ID_LABEL.search(after)) and not NOT_ID.search(before)
        if seed:
            taken.add(a, b)
        out.append((a, b, "id_number", seed, seed, shape(s), contexts("i", text, a, b)))
    for m in _SLOT.finditer(text):
        a, b = m.span()
        first, _, rest = m.group(0).partition(" ")
        if free(a, b):
            out.append((a, b, "name", False, first in given and bool(rest), m.group(0).rsplit(" ", 1)[-1], contexts("n", text, a, b)))
    for m in _NAMES.finditer(text):
        a, b = m.span()
        s = m.group(0)
        opens = _START.search(text, max(0, a - 6), a) is not None
        comma = s.rfind(", ")
        if comma > 0 and s[comma + 2 :].split(" ")[0].lower() not in given:
            s, comma = s[:comma], -1
        # Leave off openings and titles before the name; a title makes a seed.
        titled = False
        while True:
            first = s.split(" ", 1)[0]
            low = first.lower().rstrip(".")
            rest = s[len(first) + 1 :]
            if low in TITLES and low not in given:
                titled = True
            elif not (low in OPENINGS and low not in given and len(first) > 1 and not first.endswith(".")):
                break
            a += len(first) + 1
            s = rest
            opens = False
            if not s:
                break
        if not s or not s[0].isupper() or len(s) < 2:
            continue
        if not titled:
            w = re.search(r"(\w+)\.?\s$", text[max(0, a - 12) : a])
            titled = bool(w and w[1].lower() in TITLES and (w[1][0].isupper() or w[1][0] in "sdm"))
        b = a + len(s)
        tokens = [t for t in re.split(r"[ ,]+", s) if t]
        known = [t.lower() in given for t in tokens]
        first_given = known[0] or comma > 0
        if opens and len(tokens) == 1 and not known[0] and not titled:
            nxt = text[b : b + 2]
            if nxt[:1] == " " and nxt[1:].islower():
                continue  # an ordinary word at the start of a sentence
        if not free(a, b):
            continue
        inside = len(tokens) == 1 and not (known[0] or titled or opens) and text[a - 2 : a - 1].islower() and text[b : b + 1] == " " and text[b + 1 : b + 2].islower()
        sure = first_given and len(tokens) > 1 or titled and len(tokens[-1]) > 2
        seed = sure or known[0] and not opens
        last = tokens[0] if comma > 0 else tokens[-1]
        out.append((a, b, "name", sure, seed, last.lower(), contexts("n", text, a, b, inside)))
    return out
