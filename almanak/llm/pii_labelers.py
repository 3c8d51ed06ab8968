"""Candidate spans of personal data in free text, and what independent labelers say of each.

Each kind proposes its own spans, whatever others propose there: spans of
different kinds, and of names also several of one kind, may overlap. Every
candidate carries votes of -1 (none), 0 (no opinion) or 1 (personal) of the
labelers: its shape, a gazetteer, words for it nearby, words against it nearby,
its validity (digits, endings, letter case), the structure around it, and what
other kind's span it lies in. None of them decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

KINDS = ["email", "phone", "id_number", "address", "name"]
OTHER, INITIAL, GIVEN, FAMILY = range(4)
LABELERS = ["shape", "gazetteer", "context for", "context against", "validity", "structure", "inside another"]


class Candidate(NamedTuple):
    kind: str
    begin: int
    end: int
    votes: tuple[int, ...]


_BLANK = re.compile(r"<[a-zA-Z/!][^<>@]*>|\\[nN]|\\(?=[,;])|&(?:lt|gt|quot|amp|nbsp|apos|#39);")


def levelled(text: str) -> str:
    """The text with markup and escapes blanked out, place by place, so that spans found in it hold in the text."""

    def blank(m: re.Match) -> str:
        x = m[0]
        if x[0] == "\\" and len(x) == 2:
            return " \n"
        if x[0] == "&":
            return ("<" if x == "&lt;" else ">" if x == "&gt;" else '"' if x == "&quot;" else "&" if x == "&amp;" else " ").ljust(len(x))
        return re.sub(r"[^\n]", " ", x)

    return _BLANK.sub(blank, text) if "<" in text or "\\" in text or "&" in text else text


_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|punkt|point|punto)\s?[\])}]\s?)"
_AT_SIGN = re.compile("[@＠]")
_AT = re.compile(r"[@＠]|\s?[\[({]\s?(?:at|ät|arroba|chez)\s?[\])}]\s?|\s(?:at|AT)\s(?=[\w-]+\s(?:dot|DOT)\s\w)", re.I)
_LOCAL = re.compile(r"\w[\w.%+-]*$")
_DOMAIN = re.compile(rf"[\w-]+(?:{_DOT}[\w-]+)+", re.I)
_DOMAIN_WORDS = re.compile(r"[\w-]+(?:\s(?:dot|DOT)\s[\w-]+)+")
_FILE_END = re.compile(r"\.(?:png|jpe?g|gif|webp|svg|pdf|md|txt|docx?|xlsx?|zip)$", re.I)
_NUMBERED = re.compile(r"(?:message-id|in-reply-to|references|content-id|nachrichten-id|id de mensaje)\s*:?\s*[<\s]*$", re.I)

_JOIN = r"(?:,?[ \xa0]+|,?\s*\n\s*(?:(?:[>|]|[A-Z]{1,3}>)[ \xa0]*)*|,[ \xa0]*\s*)"
_W = r"[^\W\d_][\w’'.-]*"
_CAP = r"(?:[A-ZÀ-ÖØ-Þ][\w’']*)"
_HYPHENED = rf"{_CAP}(?:-[\w’']+)*"
_FIRST = r"(?:San|Santa|Santo|Saint|Sainte|St\.|Puerto|Villa|Villar|La|Le|Les|Los|Las|El|Bad|Neu|Alt|Ober|Unter|Nueva|Nuevo|Monte|Castillo|Torre|Fuente)"
_TOWN = rf"(?:{_FIRST}[ -])?{_HYPHENED}(?: (?:sur|sous|en|de|del|du|des|d’|la|le|les|los|las|am|an|der|im|bei|ob)(?: (?:la|las|los|le|les|der|den))? {_HYPHENED})*"
_TOWN_EN = rf"{_HYPHENED}(?:[ ]{_HYPHENED}){{0,2}}"
_POSTCODE_EN = r"(?:[A-Z]{2}[ \xa0]\d{5}(?:-\d{4})?|[A-Z]{1,2}\d[\dA-Z]?[ \xa0]\d[A-Z]{2})\b"
_STREET_EN = rf"(?:(?:[A-Z]\.|{_HYPHENED}\.?)[ \xa0]){{1,3}}?(?:(?:Row|Road|Street|Lane|Avenue|Drive|Close|Court|Way|Quay|Hill|Boulevard|Place|Square|Terrace|Gardens|Crescent|Grove|Walk|Mews|Yard|Park|Green|Parade)\b|(?:Rd|St|Ln|Ave|Dr|Ct|Blvd|Pl|Sq)\b\.?)"
_UNIT_EN = rf"(?:{_JOIN}(?:Unit|Apt|Apartment|Flat|Suite|Ste|Floor)\b\.?[ \xa0]?\w+|{_JOIN}?\#[ ]?\d+\w?)"
_NO = r"\d{1,4}[a-zA-Z]?"
_SMALL = r"(?:de[ ]los[ ]|de[ ]las[ ]|de[ ]la[ ]|de[ ]l[’']|des[ ]|del[ ]|du[ ]|de[ ]|d[’'])?"
_ADDRESS_FIRST_NUMBER = re.compile(
    rf"(?<![\w.,/#-])(?:{_NO}[ \xa0]{_STREET_EN}{_UNIT_EN}?(?:(?:{_JOIN}{_TOWN_EN})?{_JOIN}{_POSTCODE_EN})?"
    rf"|{_NO}(?:[ \xa0](?:bis|ter|quater)\b)?,?[ \xa0](?:rue|avenue|av\.|bd\.?|boulevard|chemin|allée|impasse|passe|passage|place|quai|route|cours|sentier|square|ruelle|voie|cité|faubourg)[ \xa0]{_SMALL}{_HYPHENED}(?:[ ]{_HYPHENED})*(?:{_JOIN}\d{{5}}[ \xa0]{_TOWN})?)"
)
#: A number from which an address may run: a letter follows it, perhaps after a comma.
_HOUSE_NUMBER = re.compile(rf"(?<![\w.,/#-]){_NO}(?=,?[ \xa0][^\W\d_])")
_DE_ENDS = "straße|strasse|str\\.|weg|gasse|platz|allee|ring|damm|ufer|graben|steig|markt"
_DE_WORDS = "Straße|Strasse|Str\\.|Weg|Platz|Allee|Ring"
_DE_FIRST = "Am|An der|Auf dem|Auf der|Im|Zum|Zur|Unter den|In der|Untere|Obere|Alte|Neue|Hintere|Vordere|Hohe|Große|Kleine|Lange|Mittlere"
_ADDRESS_DE = re.compile(
    rf"(?<![\w/#-])(?:{_CAP}?(?<=[a-zß])(?:{_DE_ENDS})|[A-ZÄÖÜ]\w*?(?:{_DE_ENDS})|{_CAP}(?:er|hauser)[ ](?:{_DE_WORDS})|(?:{_DE_FIRST})[ ]{_HYPHENED})[ \xa0]{_NO}(?![\d:.]\d)\b(?:{_JOIN}(?:D-)?\d{{5}}[ \xa0]{_TOWN})?"
)
_ADDRESS_ES = re.compile(
    rf"(?<![\w/#-])(?:Calle|C/|C\.|Avda\.|Avenida|Av\.|Paseo|P[ºo]\.|Plaza|Pza\.|Pl\.|Camino|Ronda|Travesía|Carretera|Ctra\.|Glorieta|Rambla)[ \xa0]?{_SMALL}{_HYPHENED}(?:[ ]{_SMALL}{_HYPHENED})*,?[ \xa0](?:n\.?[º°][ ]?|núm\.[ ]?)?{_NO}\b(?:,[ ]?(?:bajo|ático|entlo\.|\d{{1,2}}\.?[ºª°](?:[ ]?(?:[A-Z]\b|izq\.|dcha\.|izda\.))?|piso[ ]\w+))?(?:{_JOIN}\d{{5}}[ \xa0]{_TOWN})?"
)
# each with stretches of text one of which a text with such an address holds
_ADDRESSES = [
    (_ADDRESS_DE, (*(w.replace("\\", "") + blank for w in f"{_DE_ENDS}|{_DE_WORDS}".split("|") for blank in " \xa0"), *(f"{w} " for w in _DE_FIRST.split("|")))),
    (_ADDRESS_ES, ("Calle", "C/", "C.", "Avda", "Avenida", "Av.", "Paseo", "Pº", "Po.", "Plaza", "Pza", "Pl.", "Camino", "Ronda", "Travesía", "Carretera", "Ctra", "Glorieta", "Rambla")),
]
_NUMBERISH = re.compile(r"\d[\d \xa0().\-/‐‑–+]*")

PHONE = re.compile(r"(?<![\w#/.+(-])(?:\+|\(?(?=\d))\d[\d \xa0().\-/‐‑–]{6,22}\d(?![\w])")
_PHONE_FOR = re.compile(r"(?:\b(?:tel|tél|tlf|phone|mobile?|mob|fax|rückruf|ring|call|dial-in|dial|reached on|teléfono|móvil|portable|handy|telefon|contact[eo]?|t|m|numéro|atiende en el|répond au|erreichbar unter|unter)\b\.?[ \xa0]?:?[ \xa0]*)$", re.I)
_NUMBER_AGAINST = re.compile(r"(?:order|auftrag|commande|pedido|parcel|paket|colis|paquete|serial|seriennummer|série|serie|invoice|rechnung|facture|factura|ticket|lot|version|item|box|sheet|page|ref|isbn|iban|map|machine|number\s(?:plate)|posten|charge)\b[\s.:]*(?:no|nr|n)?[\s.º°:#]*$", re.I)
_ID_FOR = re.compile(r"(?:pass(?:port)?|reisepass|pasaporte|passeport|id-?nr|steuer-?id|steueridentifikationsnummer|tax id|tin|dni|nie|nif|ssn|social security|national insurance|nino|ni number|personnummer|personal number|personnr|sécurité sociale|nir|seguridad social|identity|id card|ausweis|carte d.identité|their number is|(?:an|a) id|sozialversicherungsnummer|número de identidad)\W{0,3}(?:number|no|nr|n)?[\s.º°:#]*$", re.I)
ID = re.compile(
    r"(?<![\w#/.+-])(?:(?P<nino>[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z](?P<s>[ \xa0-]?)\d\d(?P=s)\d\d(?P=s)\d\d(?P=s)[A-D])|(?P<passport>[A-Z]{2}[ ]?\d{7})|(?P<dni>\d{8}[ \xa0-]?[A-HJ-NP-TV-Z])|(?P<nie>[XYZ][ -]?\d{7}[ -]?[A-Z])"
    r"|(?P<person>(?:\d{2})?\d{6}[-+]\d{4})|(?P<ssn>\d{3}[ \xa0-]\d{2}[ \xa0-]\d{4})|(?P<nir>[12] \d\d \d\d \d\d \d{3} \d{3}(?: \d\d)?|[12]\d{12,14})|(?P<tin>\d{2}[ \xa0]?\d{3}[ \xa0]?\d{3}[ \xa0]?\d{3})|(?P<nine>\d{9}))(?![\w/]|[.,:-]\d|[ ]\d{3,}\b)"
)

_WORD = re.compile(r"(?<![^\W_])[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:[’'-](?!s\b)[^\W\d_]+)*")
_FIRM_NEXT = re.compile(r"[ \xa0](?:&|and Sons|Ltd|Limited|Inc|GmbH|AG|KG|LLC|PLC|SARL|SAS|S\.\s?L|S\.\s?A|Co\b|Partners|Press|Labs|Logistics|Housing|Group|Instruments|Bank|Trust|Society|Books|Foundation|Holding)")
_PLACE_NEXT = re.compile(r"[ \xa0](?:Row|Road|Rd|Street|St\b|Lane|Avenue|Ave|Drive|Close|Court|Way|Quay|Hill|Blvd|Square|Park|Bridge|Falls|period|bushes?|garden|\d)")
# Words after which a person's name stands, in the languages of the texts.
TITLES = frozenset("herr herrn frau mr mrs ms miss dr prof m mme mlle sr sra don doña d dña".split())
_NAME_FOR = frozenset("hi hello dear hallo liebe lieber salut bonjour hola estimada estimado querida querido tag cher chère guest attendee host contact contacto ask for met cc from to von an de para à a bitte by frau herr ansprechpartner ansprechpartnerin".split()) | TITLES


def last_word(text: str, at: int) -> str:
    words = text[max(0, at - 24) : at].rstrip(" \t\xa0.:\"„“*>").rsplit(None, 1)
    return words[-1].lower().lstrip("\"„“*>(") if words else ""


_NAME_AFTER = re.compile(r"\s*(?:said|says|wrote|schrieb|brings?|bringt|apporte|trae|can be reached|wants|scanned|checked|approved|and\s|und\s|et\s|y\s|<|\(|:|,?\s*\n|,|$|\|)")
_AMBIGUOUS_AFTER = re.compile(r"[ \xa0](?:(?:the|an|this|that|it|period|bush(?:es)?)\b|\d)", re.I)


def _near(text: str, at: int, size: int = 40) -> str:
    return text[max(0, at - size) : at]


_SPACED = (" ", "\xa0")
_DOTTED = (*_SPACED, ". ", ".\xa0")
_MAIL_NEXT = re.compile(r"[ \xa0]?<[^<>\s]*@")
_NANP = re.compile(r"(?:\+1[ .‐‑–-]?|1[ .‐‑–-])?(?:\([2-9]\d\d\)[ ]?|[2-9]\d\d[ .‐‑–-])[2-9]\d\d[ .‐‑–-]\d{4}|\+1\d{10}")
_DATE = re.compile(r"\d{4}-\d\d-\d\d.*|\d\d\.\d\d\.\d{4}.*")
_ID_FORMS = ("nino", "passport", "dni", "nie", "person", "ssn", "nir", "tin", "nine")


class Labelers:
    """Proposes candidates; ``is_given`` and ``is_family`` tell whether a word in small letters is in a gazetteer, ``common`` holds words that are no names."""

    def __init__(self, is_given: Callable[[str], bool], is_family: Callable[[str], bool], common: frozenset[str] = frozenset()):
        self.is_given, self.is_family, self.common = is_given, is_family, common
        self.known: dict[str, int] = {}

    def candidates(self, text: str) -> list[Candidate]:
        """All candidates of a text by their begin."""
        t = levelled(text)
        wide = self._emails(t) + self._addresses(t)
        numbers = [m.span() for m in _NUMBERISH.finditer(t)]
        numbers = [(a, b) for a, b in numbers if b - a >= 6 and (b - a > 6 or t[a:b].strip().isdigit())]
        narrow = self.names(t)
        if numbers:
            narrow += self._ids(t, numbers) + self._phones(t, numbers)
        if wide:
            narrow = [c if not any(w.begin <= c.begin and c.end <= w.end for w in wide) else c._replace(votes=(*c.votes[:-1], -1)) for c in narrow]
        return sorted(wide + narrow, key=lambda c: c.begin)

    @staticmethod
    def _emails(t: str) -> list[Candidate]:
        out, low = [], t.lower()
        worded = any(map(low.__contains__, ("(at", "[at", "{at", "( at", "[ at", " dot ", "(ät", "[ät", "arroba", "chez)", "chez]")))
        for m in (_AT if worded else _AT_SIGN).finditer(t):
            local = _LOCAL.search(t, max(0, m.start() - 64), m.start())
            domain = (_DOMAIN_WORDS if m[0].strip().isalpha() else _DOMAIN).match(t, m.end()) if local else None
            if domain is None:
                continue
            a, b = local.start(), domain.end()
            while t[b - 1] in ".-_%+":
                b -= 1
            s = t[a:b]
            file, numbered = bool(_FILE_END.search(s)), bool(_NUMBERED.search(_near(t, a, 24)))
            out.append(Candidate("email", a, b, (1, 0, 1 if m[0] in "@＠" else 0, -1 if numbered else 0, -1 if file or numbered or s[-1].isdigit() else 1, -1 if numbered or file else 1, 0)))
        return out

    @staticmethod
    def _addresses(t: str) -> list[Candidate]:
        found = [m for h in _HOUSE_NUMBER.finditer(t) if (m := _ADDRESS_FIRST_NUMBER.match(t, h.start()))]
        for shape, words in _ADDRESSES:
            if any(map(t.__contains__, words)):
                found += shape.finditer(t)
        out = []
        for m in found:
            a, b = m.span()
            code = bool(re.search(r"\d{5}|[A-Z]{1,2}\d\d? \d[A-Z]{2}$", m[0]))
            out.append(Candidate("address", a, b, (1, 0, 1 if code else 0, -1 if _NUMBER_AGAINST.search(_near(t, a, 24)) else 0, 1, 1 if code else 0, 0)))
        return out

    @staticmethod
    def _ids(t: str, numbers: list[tuple[int, int]]) -> list[Candidate]:
        out = []
        for a, b in numbers:
            m = ID.search(t, max(0, a - 3), b + 12)
            if m is None or not (a - 3 <= m.start() <= b):
                continue
            a, b = m.span()
            form = next(k for k in _ID_FORMS if m[k])
            before = _near(t, a)
            supported, against, phone = bool(_ID_FOR.search(before)), bool(_NUMBER_AGAINST.search(before)), bool(_PHONE_FOR.search(before))
            strong = form in _ID_FORMS[:6]
            out.append(Candidate("id_number", a, b, (1 if strong else -1, 0, 1 if supported else 0, -1 if against or phone and not supported else 0, 1 if strong else 0, 1 if supported else 0 if strong and not against else -1, 0)))
        return out

    @staticmethod
    def _phones(t: str, numbers: list[tuple[int, int]]) -> list[Candidate]:
        out = []
        for m in [x for a, b in numbers for x in PHONE.finditer(t, max(0, a - 2), b + 1)]:
            a, b = m.span()
            s = m[0]
            digits = sum(ch.isdigit() for ch in s)
            if s.count("(") < s.count(")") or not 8 <= digits <= 16:
                continue
            before = _near(t, a)
            supported, against, named = bool(_PHONE_FOR.search(before)), bool(_NUMBER_AGAINST.search(before)), bool(_ID_FOR.search(before))
            nanp = bool(_NANP.fullmatch(s.replace("\xa0", " ")))
            abroad = s.startswith(("+", "00", "(0"))
            trunk = s.startswith("0") and not abroad and 9 <= digits <= 12
            shaped = nanp or abroad or trunk
            no = against or named and not supported or bool(_NUMBERED.search(before))
            out.append(Candidate("phone", a, b, (1 if shaped else -1, 0, 1 if supported else 0, -1 if no else 0, -1 if digits > 15 or _DATE.fullmatch(s) else 1 if (nanp or abroad or supported) and digits > 8 else 0, -1 if no or not (shaped or supported) else 1 if nanp or abroad else 0, 0)))
        return out

    def words(self, t: str) -> list[tuple[int, int, str, int]]:
        """Begin, end, word and class of the capitalised words of a text."""
        known, out = self.known, []
        for m in _WORD.finditer(t):
            w = m[0]
            c = known.get(w)
            if c is None:
                c = self._classify(w)
            out.append((m.start(), m.end(), w, c))
        return out

    def names(self, t: str) -> list[Candidate]:
        """Names by the gazetteers, by what stands before and after capitalised words, and longer ones that a gazetteer knows in part."""
        words, out = self.words(t), []
        n, i = len(words), 0

        def add(i: int, j: int, kind: str, told: int, longer: bool = False) -> None:
            a, end = words[i][0], words[j][1]
            if len(words[j][2]) == 1 and t[end : end + 1] == ".":
                end += 1
            if t[max(0, a - 1) : a] in ("@", "/") or t[end : end + 1] in ("@", "＠"):
                return
            before, after = last_word(t, a), t[end : end + 24]
            firm, place = bool(_FIRM_NEXT.match(after)), bool(_PLACE_NEXT.match(after))
            alone = kind in ("given", "titled", "asked")
            ambiguous = alone and bool(_AMBIGUOUS_AFTER.match(after)) and before not in _NAME_FOR
            supported = before in _NAME_FOR or bool(_NAME_AFTER.match(after))
            no = firm or place or ambiguous
            plain = kind == "partly" and words[j][2].lower() in self.common
            out.append(Candidate("name", a, end, (0 if alone else 1, told, 1 if supported else 0, -1 if no else 0, -1 if ambiguous or firm or plain else 0 if kind == "asked" else 1, -1 if no or plain or longer else 0 if alone else 1, 0)))

        while i < n:
            a, b, w, c = words[i]
            j = i
            if c == GIVEN:
                j, kind = self._after_given(t, words, i)
                k = j + 1
                while k < n and kind == "given" and words[k][3] == INITIAL and t[words[k][1] : words[k][1] + 1] == "." and t[words[k - 1][1] : words[k][0]] in (*_SPACED, ". "):
                    k += 1
                if kind == "given" and k < n and words[k][3] == OTHER and len(words[k][2]) > 2 and t[words[k - 1][1] : words[k][0]] in (_SPACED if k == j + 1 else (". ", ".\xa0")):
                    # a given name and a word that no gazetteer holds: both readings stand against each other
                    plain = words[k][2].lower() in self.common
                    add(i, j, kind, 1, longer=not plain)
                    add(i, k, "partly", -1 if plain else 0)
                    j = j if plain else k
                else:
                    add(i, j, kind, 1)
            elif c == INITIAL and t[b : b + 1] == ".":
                k = i
                while k + 1 < n and words[k + 1][3] == INITIAL and t[words[k][1] : words[k + 1][0]] in (". ", ".\xa0", "."):
                    k += 1
                k += 1
                if k < n and t[words[k - 1][1] : words[k][0]] in (". ", ".\xa0", "."):
                    if words[k][3] == FAMILY:
                        j = k
                        add(i, k, "initial", 1)
                    elif words[k][3] == OTHER and len(words[k][2]) > 2 and words[k][2].lower() not in self.common:
                        j = k
                        add(i, k, "initial", 0)
            elif c == FAMILY and i + 1 < n and words[i + 1][3] == GIVEN and t[b : words[i + 1][0]] in (", ", ",\xa0"):
                j = i + 1
                while j + 1 < n and words[j + 1][3] == INITIAL and t[words[j][1] : words[j + 1][0]] in (*_SPACED, ". ") and t[words[j + 1][1] : words[j + 1][1] + 1] == ".":
                    j += 1
                add(i, j, "reversed", 1)
            elif c in (FAMILY, OTHER) and len(w) > 2:
                last = last_word(t, a)
                if last in _NAME_FOR and (c == FAMILY or w.lower() not in self.common):
                    # context alone: a title, a greeting or the like before a capitalised word
                    if i + 1 < n and words[i + 1][3] in (FAMILY, OTHER) and len(words[i + 1][2]) > 2 and t[b : words[i + 1][0]] in _SPACED and words[i + 1][2].lower() not in self.common:
                        j = i + 1
                        add(i, j, "full", 0 if words[j][3] == FAMILY else -1)
                    elif last in TITLES:
                        add(i, i, "titled", 1 if c == FAMILY else -1)
                    elif c == OTHER:
                        add(i, i, "asked", -1)
                elif i + 1 < n and t[b : words[i + 1][0]] in _SPACED and _MAIL_NEXT.match(t, words[i + 1][1]) and words[i + 1][3] in (FAMILY, OTHER):
                    j = i + 1
                    add(i, j, "full", 0 if words[j][3] == FAMILY else -1)
            i = j + 1
        return out

    def _classify(self, w: str) -> int:
        key = w.casefold()
        if len(w) == 1:
            c = INITIAL
        elif (w.istitle() or w.isupper() or "-" in w) and self.is_given(key):
            c = GIVEN
        elif len(w) > 3 and self.is_family(key):
            c = FAMILY
        else:
            c = OTHER
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[w] = c
        return c

    @staticmethod
    def _after_given(t: str, words: list[tuple[int, int, str, int]], i: int) -> tuple[int, str]:
        """The last word of the name that begins with given name ``i``, as far as the gazetteers know."""
        k = i
        while k + 1 < len(words):
            gap = t[words[k][1] : words[k + 1][0]]
            w = words[k + 1][2]
            if len(w) == 1 and gap in (*_SPACED, ". ") and t[words[k + 1][1] : words[k + 1][1] + 1] == ".":
                k += 1
                continue
            if gap in _DOTTED and (gap[0] != "." or len(words[k][2]) == 1) and words[k + 1][3] == FAMILY:
                return k + 1, "full"
            if k == i and gap == "-" and words[k + 1][3] == GIVEN:
                k += 1
                continue
            break
        return (i if k > i and len(words[k][2]) == 1 else k), "given"
