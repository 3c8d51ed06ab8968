"""What each line of a mail body is, by its marks and its place: the labels that the windows of authored.py start from."""

from __future__ import annotations

import html
import re

TEXT, QUOTE, INTRO, SIGNATURE, LEGAL, CLOSING = "text", "quote", "intro", "signature", "legal", "closing"

# Closing phrases in the languages of the mail, as a line of their own.
CLOSINGS = [
    "best", "all the best", "best regards", "best wishes", "kind regards", "warm regards", "regards", "many thanks", "thanks", "thank you", "cheers", "yours",
    "yours sincerely", "yours faithfully", "yours truly", "sincerely", "take care", "talk soon", "br", "mit freundlichen grüßen", "mit freundlichem gruß", "freundliche grüße",
    "viele grüße", "liebe grüße", "beste grüße", "herzliche grüße", "schöne grüße", "mit besten grüßen", "grüße", "gruß", "lg", "vg", "mfg", "hochachtungsvoll", "danke",
    "cordialement", "bien cordialement", "bien à vous", "bien à toi", "à bientôt", "amicalement", "sincères salutations", "salutations", "merci", "merci d’avance",
    "gracias", "muchas gracias", "saludos", "saludos cordiales", "un saludo", "un cordial saludo", "atentamente", "un abrazo", "hasta pronto",
]
_CLOSINGS = frozenset(CLOSINGS)

_MARK = re.compile(r"\s*(?:>|\|(?!\w)|[A-Z]{1,3}>(?=\s|$))")
_RULE = re.compile(r"\s*(?:--+|__+|\*\*\*+|==+|~~+|––+|——+)\s*$")
_SEPARATOR = re.compile(r"\s*(?:-{3,}\s*[^\s_-].*?\s*-{3,}|_{3,}\s*[^\s_-].*?\s*_{3,}|begin forwarded message:|début du message transféré ?:|anfang der weitergeleiteten nachricht:|inicio del mensaje reenviado:)\s*$", re.I)
# Names of mail headers as mail programs write them above earlier mail.
_FROM = re.compile(r"\s*\*?(?:from|von|de|expéditeur|remitente)\s?:\*?\s*\S", re.I)
_HEADER = re.compile(r"\s*\*?(?:from|sent|date|to|cc|subject|reply-to|von|gesendet|datum|an|kopie|betreff|de|envoyé|date|à|objet|enviado|enviado el|fecha|para|asunto)\s?:\*?(?:\s|$)", re.I)
_ADDRESS = r"<[^<>\s]+>|\S+@\S+"
_VERB = r"(?:wrote|writes|said|schrieb|a écrit|escribió|ha scritto|schreef|skrev|escreveu)"
_YEAR = r"(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}|\b(?:19|20)\d\d\b)"
_INTRO = re.compile(rf"\s*(?=.*{_YEAR})(?:.*\b{_VERB}\b.*|.*(?:{_ADDRESS}).*)\s?:\s*$", re.I)
_INTRO_OPENS = re.compile(rf"(?=.*{_YEAR}).{{7,}}[^.:!?;]\s*$", re.I)
_INTRO_ENDS = re.compile(rf".*(?:\b{_VERB}|>)\s?:\s*$", re.I)
_PHONE = re.compile(r"\s*(?:(?:t|m|p|f|tel|tél|tlf|mobile?|mob|mobil|phone|fax|móvil|portable|handy)\b\.?\s?:?\s*)?[+(]?\d[\d\s()./+‐‑–-]{5,}\s*$", re.I)
_MAIL = re.compile(r"\s*(?:(?:e-?mail|mail)\s?:\s*)?\S+(?:@|＠|\(at\)|\[at\]|\s\(at\)\s|\sat\s)\S+\s*$", re.I)
_SITE = re.compile(r"\s*(?:https?://|www\.)\S+\s*$", re.I)
_ROLE = re.compile(r"\s*[^|.!?]{2,60}\|[^|.!?]{2,60}$")
# Words that stay small within names of people, streets and places.
_SMALL = {"de", "del", "der", "den", "des", "du", "la", "las", "le", "les", "los", "el", "von", "van", "zu", "zum", "am", "an", "on", "of", "and", "y", "et", "und", "in", "rue", "bis", "bd.", "av.", "avda.", "c/", "apt", "unit", "nº", "n°", "plaza", "quai", "place", "allée", "chemin", "bajo", "st.", "sur", "sous", "piso", "izq.", "dcha."}
_FIRM = re.compile(r"\s*(?=.*[^\W\d_])[^.!?;:,]{2,40}(?:\b(?:ltd|inc|gmbh|ag|kg|llc|plc|sarl|sas|sa|co|partners|press|labs|logistics|housing|group|& sons(?: ltd)?)\b|s\.\s?l|s\.\s?a|b\.\s?v)\.?\s*$", re.I)
_DEVICE = re.compile(r"\s*(?:sent from|get \w+ for|gesendet von|von meinem|von meiner|envoyé de|envoyé depuis|enviado desde|enviado de)\b.{0,60}$", re.I)
_LEGAL = re.compile(
    r"confidentiality notice|accepts no liability|no liability for|may be privileged|legally privileged|intended (?:only|solely)|is not an offer|think of the (?:trees|environment)|before printing this|registered (?:office|in)\b|company number"
    r"|nachricht ist vertraulich|e-mail ist vertraulich|sitz laut|sitz der gesellschaft|handelsregister|änderungen vorbehalten|amtsgericht|geschäftsführer:"
    r"|message est confidentiel|courriel est confidentiel|décline toute responsabilité|mensaje es confidencial|correo es confidencial|no responde de las|no se hace responsable|(?:message|e-mail|email|transmission)\b.{0,60}\b(?:addressee|recipient)|siège social|domicilio social",
    re.I,
)
_LIST = re.compile(r"\s*(?:[\w.-]+ mailing list|to leave this list\b.*|to unsubscribe\b.*|unsubscribe\s?:.*|abbestellen\s?:.*|(?:pour )?(?:se )?désabonner.*|darse de baja\b.*|https?://lists?\..*)\s*$", re.I)
#: Running text: a sentence that ends, after words in small letters.
_SENTENCE = re.compile(r"(?:[^\W\d_A-ZÀ-ÖØ-Þ][\w’'-]*,? ){3}.*[.!?…][\"”»)]*\s*$")
#: Stretches of small letters one of which a legal line or a list footer holds: most texts hold none and skip the costly patterns.
_LEGAL_WORDS = ("confiden", "vertraulich", "liab", "privileged", "intended", "is not an offer", "think of the", "before printing", "registered", "company number", "sitz ", "handelsregister", "vorbehalten", "amtsgericht", "geschäftsführer", "responsa", "responde de", "addressee", "recipient", "siège", "domicilio")
_LIST_WORDS = ("mailing list", "leave this list", "unsubscribe", "abbestellen", "désabonner", "darse de baja", "://list")
_DIGIT = re.compile(r"\d")
_UNSEEN = re.compile("[­͏؜​-‏‪-‮⁠-⁤︀-️﻿]")
_TAG = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_QUOTE_BOX = re.compile(r"""(?:class|id)\s*=\s*["']?[^"'>]*(?:quote|cite-prefix|replyfwd|rplyfwd|appendonsend)|border-left\s*:""", re.I)
_SIGN_BOX = re.compile(r"""(?:class|id)\s*=\s*["']?[^"'>]*(?:signature|\bsig\b)""", re.I)
_REST_QUOTED = re.compile(r"""(?:class|id)\s*=\s*["']?[^"'>]*(?:replyfwd|rplyfwd|appendonsend)""", re.I)
_EMPTY_TAGS = {"br", "hr", "img", "meta", "link", "input", "wbr", "area", "base", "col", "source"}


def normalised(line: str) -> str:
    """A line without quote marks, invisible characters, case and spare blanks: equal for a line and its quotation."""
    while (">" in line or "|" in line) and (m := _MARK.match(line)):
        line = line[m.end() :]
    return " ".join(line.split()).lower()


def shown_lines(text: str, is_html: bool) -> tuple[list[str], list[str | None]]:
    """The visible text of each line, and for HTML the label of the box that it stands in."""
    if not is_html:
        lines = (text if text.isascii() else _UNSEEN.sub("", text)).split("\n")
        return [x.rstrip("\r") for x in lines] if "\r" in text else lines, [None] * len(lines)
    lines = text.split("\n")
    shown, boxes = [[] for _ in lines], [None] * len(lines)
    stack: list[tuple[str, str | None]] = []
    rest = None
    at = line = 0

    def put(piece: str) -> None:
        nonlocal line
        for i, x in enumerate(piece.split("\n")):
            line += i > 0
            x = _UNSEEN.sub("", html.unescape(x)).rstrip("\r")
            if x.strip():
                shown[line].append(x)
                boxes[line] = rest or next((b for _, b in stack if b == QUOTE), None) or next((b for _, b in reversed(stack) if b), None)

    skip = None
    for m in _TAG.finditer(text):
        if skip is None:
            put(text[at : m.start()])
        else:
            line += text.count("\n", at, m.start())
        line += m[0].count("\n")
        at = m.end()
        tag = (m[2] or "").lower()
        if m[1]:
            if tag == skip:
                skip = None
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag:
            box = QUOTE if tag == "blockquote" or _QUOTE_BOX.search(m[3]) else SIGNATURE if _SIGN_BOX.search(m[3]) else None
            if box == QUOTE and _REST_QUOTED.search(m[3]):
                rest = QUOTE
            if tag in ("style", "script", "head", "title"):
                skip = tag
            if tag not in _EMPTY_TAGS and not m[3].rstrip().endswith("/"):
                stack.append((tag, box))
    if skip is None:
        put(text[at:])
    return ["".join(x) for x in shown], boxes


def _tail_like(line: str) -> bool:
    """Whether a line at the end of a body reads as part of a signature: a name, a way to reach someone, a firm, a place."""
    s = line.strip()
    if _PHONE.match(s) or _MAIL.match(s) or _SITE.match(s) or _DEVICE.match(s) or _FIRM.match(s) or _ROLE.match(s):
        return True
    words = s.split()
    if s[-1] in ".!?:;," or re.search(r"\w:\s", s):
        return False
    proper = [w for w in words if w.lower().rstrip(",") not in _SMALL]
    return all(w[0].isupper() or w[0].isdigit() or w[0] in "#(" for w in proper) and any(w[0].isupper() for w in proper) or bool(re.fullmatch(r"\d{1,4}[a-z]?,? [^\W\d_]{2,5}\.? .{3,40}", s))


def _paragraph(at: list[int]) -> list[int]:
    """The first of these line numbers, up to the first gap between them."""
    return [j for k, j in enumerate(at) if j - at[0] == k]


def label_lines(text: str, is_html: bool) -> list[tuple[int, str, str]]:
    """``line_no`` from 1, normalised text and label of each line that shows something.

    ``text`` is what the sender seems to have written; ``closing`` is text at
    the end of it that might be a closing line of the sender's.
    """
    shown, boxes = shown_lines(text, is_html)
    n = len(shown)
    seen = [bool(x.strip()) for x in shown]
    label: list[str | None] = [None] * n
    filled = [i for i in range(n) if seen[i]]
    rest = False
    for k, i in enumerate(filled):
        x, follow = shown[i], filled[k + 1 : k + 4]
        if rest:
            label[i] = QUOTE
        elif boxes[i]:
            label[i] = boxes[i]
        elif (">" in x or "|" in x) and _MARK.match(x):
            label[i] = QUOTE
        elif (x.lstrip()[0] in "-_" or ":" in x) and _SEPARATOR.match(x):
            label[i], rest = QUOTE, True
        elif ":" in x and _FROM.match(x) and sum(bool(_HEADER.match(shown[j])) for j in follow) >= 2:
            label[i], rest = QUOTE, True
            if k and _RULE.match(shown[filled[k - 1]]) and label[filled[k - 1]] != QUOTE:
                label[filled[k - 1]] = QUOTE
        elif x.rstrip()[-1] == ":" and _DIGIT.search(x) and _INTRO.match(x):
            label[i] = INTRO
        elif follow and shown[follow[0]].rstrip()[-1] == ":" and _DIGIT.search(x) and _INTRO_OPENS.match(x) and _INTRO_ENDS.match(shown[follow[0]]):
            label[i] = label[follow[0]] = INTRO
        elif label[i] is None:
            label[i] = TEXT
    # an introduction without marks or a box after it introduces what is indented after it, or else all that follows
    for k, i in enumerate(filled):
        if label[i] == INTRO and k + 1 < len(filled) and label[filled[k + 1]] == TEXT:
            later = filled[k + 1 :]
            if shown[later[0]].startswith(("  ", "\t")):
                for j in later:
                    if not shown[j].startswith(("  ", "\t")):
                        break
                    label[j] = QUOTE
            elif not any(label[j] == QUOTE for j in _paragraph(later)):
                for j in later:
                    label[j] = QUOTE
                break
    # runs of the sender's text between quotations: signatures, legal lines and list footers at their ends
    runs: list[list[int]] = []
    for i in filled:
        if label[i] in (QUOTE, INTRO):
            runs.append([])
        else:
            if not runs:
                runs.append([])
            runs[-1].append(i)
    low = "\n".join(shown).lower()
    legal, listed = any(w in low for w in _LEGAL_WORDS), any(w in low for w in _LIST_WORDS)
    for run in runs:
        _label_run(run, shown, label, legal, listed)
    return [(i + 1, normalised(shown[i]), label[i]) for i in filled]


def _closing_phrase(line: str) -> bool:
    x = line.lower()
    return x in _CLOSINGS or x[-1] in ",.!;:" and x[:-1].rstrip() in _CLOSINGS


def _label_run(run: list[int], shown: list[str], label: list[str | None], legal: bool, listed: bool) -> None:
    if legal or listed:
        for i in run:
            if label[i] == TEXT and (legal and _LEGAL.search(shown[i]) or listed and _LIST.match(shown[i])):
                label[i] = LEGAL
    start = None
    for k, i in enumerate(run):
        x = shown[i].strip()
        if x[0] in "-_*=~–—" and _RULE.match(x):
            if not any(label[j] == TEXT and _SENTENCE.search(shown[j]) for j in run[k + 1 :]):
                start = k
                break
        if _closing_phrase(x) and not any(label[j] == TEXT and _SENTENCE.search(shown[j]) for j in run[k + 1 :]):
            start = k
            break
        if k and _DEVICE.match(x) and not any(label[j] == TEXT and not _tail_like(shown[j]) for j in run[k + 1 :]):
            start = k
            break
    if start is not None:
        for j in run[start:]:
            if label[j] == TEXT:
                label[j] = SIGNATURE
    k = (start if start is not None else len(run)) - 1
    while k >= 0:
        i = run[k]
        if label[i] in (LEGAL, SIGNATURE):
            k -= 1
        elif label[i] == TEXT and (_RULE.match(shown[i]) or _tail_like(shown[i])):
            label[i] = SIGNATURE
            k -= 1
        else:
            break
    for i in run[max(0, k - 2) : k + 1]:
        if label[i] == TEXT:
            label[i] = CLOSING
