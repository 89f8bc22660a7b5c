"""Problem 8: personal information inside free text, found by generous generators and picked by boosted trees.

Generators of high recall propose overlapping spans of five kinds; each span gets features of its form and its surroundings;
one model a kind, fitted on composed examples (see ``pii_examples``; their number is bounded by EXAMPLES), scores them; scores
are calibrated on held-out examples, spans above the kind's threshold of the highest F1 there are kept, the better one where two
overlap. Costly patterns are tried only round cheap signs of a place (an at sign, five digits, a comma before a capital). Whole texts are scanned;
null, empty and blank texts hold nothing; positions count Unicode characters; a place is reported once.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .boost import Boosted, best_threshold, isotonic
from .plans import spread

KINDS = ("email", "address", "id_number", "phone", "name")
#: Composed texts that the models are fitted on; every fourth is held out for the thresholds.
EXAMPLES = 6000
CONTEXT = 48
#: A reference list of given names may have so many entries.
GIVEN_NAMES = 1_000_000

_M = "̀-ͯ"
_U, _L = "A-ZÀ-ÖØ-ÞŒŠŽ", f"a-zß-öø-ÿœšž'’{_M}"
_CAP = f"[{_U}][{_M}]?[{_L}]+(?:-[{_U}][{_M}]?[{_L}]+)*"
_CAPS = f"(?:[{_U}][{_M}]?['’]?){{2,}}(?:-(?:[{_U}][{_M}]?){{2,}})*"
_LOW = f"[{_L}]{{2,}}(?:-[{_L}]{{2,}})*"
_SP = "[ \\u00a0\\u2009\\u202f\\t]"
_INIT = f"(?:[{_U}][{_M}]?\\.(?:{_SP}|-)?)"
_PART = f"(?:(?:van{_SP}der|van{_SP}den|van|von{_SP}der|von|zu|zur|vom|de{_SP}la|de{_SP}las|de{_SP}los|de|del|du|des|di|da|della|le|la|ter|ten|d['’]){_SP}+)"
_PART_ANY = f"(?:(?i:van{_SP}der|van{_SP}den|van|von{_SP}der|von|zu|zur|vom|de{_SP}la|de|del|du|des|di|da|della|le|la){_SP}+)"
_FAM = f"(?:{_CAP}|{_CAPS})"
_START = f"(?<![\\w{_M}@.+/-])(?<!\\w['’])"
_END = f"(?![\\w{_M}@])"

_AT = r"\s{0,2}(?:@|\(\s?(?:at|AT|a)\s?\)|\[\s?(?:at|AT)\s?\]|\{\s?(?:at|AT)\s?\}|<at>)\s{0,2}"
_WORD_AT = r"\s(?:at|AT|arroba|ARROBA|arobase|chez)\s"
_BRACKET_DOT = r"\s{0,2}(?:\(\s?(?:dot|DOT|punkt|point|punto)\s?\)|\[\s?(?:dot|DOT|punkt|point|punto)\s?\]|\{\s?(?:dot|DOT)\s?\})\s{0,2}"
_WORD_DOT = r"\s(?:dot|DOT|punkt|PUNKT|punto|PUNTO|point)\s"
_LOCAL, _LABEL, _TOP = r"(?<![\w.+%-])[^\W_](?:[\w.+%-]{0,62}[\w+-])?", r"[^\W_][\w-]{0,62}", r"[^\W\d_]{2,24}(?![\w-])"
_EMAIL = re.compile("|".join((
    rf"{_LOCAL}{_AT}{_LABEL}(?:(?:\.|{_BRACKET_DOT}|{_WORD_DOT}){_LABEL}){{0,4}}(?:\.|{_BRACKET_DOT}|{_WORD_DOT}){_TOP}",
    rf"{_LOCAL}{_WORD_AT}{_LABEL}(?:(?:{_BRACKET_DOT}|{_WORD_DOT}){_LABEL}){{0,4}}(?:{_BRACKET_DOT}|{_WORD_DOT}){_TOP}",
)))
_PHONE = re.compile(rf"(?<![\w.,+/\-:])(?:\(\+\d{{1,3}}\)|\+\d{{1,14}}+|\(\d{{1,5}}\)|\d{{2,14}}+)(?:(?:[ \u00a0\u2009\u202f./\-]|[ \u00a0\u2009\u202f]?(?=\()|(?<=\)))(?:\(\d{{1,5}}\)|\d{{1,14}}+)){{0,8}}(?:{_SP}?(?:ext\.?|x|Durchwahl|poste){_SP}?\d{{1,5}})?(?![\w/-])")
_ID = re.compile(rf"(?<![\w./+\-@])(?:[A-Z]{{1,3}}[ -]?)?\d[\dA-Z]{{0,13}}(?:[ \u00a0\u2009\u202f/\-][\dA-Z]{{1,12}}){{0,7}}(?![\w/@])|(?<![\w./+\-@])[A-Z]{{2}}\d{{2}}(?: [\dA-Z]{{2,4}}){{2,7}}(?!\w)|(?<![\w./+\-@])[A-Z]{{1,3}}\d{{2,12}}(?:[ \-]\d{{2,6}}){{0,4}}(?!\w)")
_CITY = f"(?:{_CAP}|{_CAPS})(?:[ -](?:{_CAP}|{_CAPS})){{0,2}}"
_TAIL = rf"(?:,?\s{{1,3}}(?:(?:[A-Z]{{1,3}}-)?\d{{4,5}}\s{_CITY}|{_CITY},?\s(?:\d{{5}}|[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s\d[A-Z]{{2}})))"
_UNIT = rf"(?:,\s?(?i:flat|suite|apt\.?|unit|room|floor|étage|piso|wohnung|bât\.?|\d{{1,2}}º)\s?[\w.]{{0,5}}(?:\s[A-Z]\b)?)"
_STREETS = tuple(re.compile(p) for p in (
    rf"\d(?<![\w.,-]\d)\d{{0,4}}[a-zA-Z]?\s(?:{_CAP}\s|{_CAPS}\s){{1,3}}(?i:ave(?:nue)?|street|st|road|rd|lane|ln|close|drive|dr|court|ct|way|square|sq|terrace|place|pl|crescent|blvd|boulevard|mews|hill|row|park|walk|gardens)\b\.?{_UNIT}?{_TAIL}?",
    rf"(?<![\w-])(?i:p\.?\s?o\.?\s?box|postfach|boîte postale|b\.?p\.?|bp|apartado(?: de correos)?|apdo\.?|casilla)\s\d{{1,3}}(?:\s?\d{{1,3}}){{0,3}}{_TAIL}?",
    rf"\d(?<![\w.-]\d)\d{{0,3}}(?:\s?(?:bis|ter|quater))?,?\s(?i:rue|avenue|av\.|chemin|allée|allee|boulevard|bd|place|impasse|quai|route|cours|passage|square|sentier)\s(?:d[eu]s?\s(?:la\s)?|de\sl['’]|d['’]|l['’])?{_CITY}{_TAIL}?",
    rf"(?<![\w-])(?i:calle|c/|avda\.?|avenida|plaza|pza\.?|paseo|camino|ronda|travesía|carretera|ctra\.?)\s(?:de(?:l|\sla|\slos|\slas)?\s)?{_CITY},?\s(?:n\.?º?\s?)?(?:\d{{1,4}}|s/n){_UNIT}?(?:,\s\d{{1,2}}\.?[ºª]?\s?[A-Z]?\b(?!\d))?{_TAIL}?",
    rf"[{_U}](?<![\w-].)[{_M}]?[{_L}]+(?:-[{_U}][{_M}]?[{_L}]+)*(?i:straße|strasse|str\.|gasse|weg|allee|platz|ring|damm|ufer|steig|pfad|chaussee|berg|hof|markt)\s\d{{1,4}}\s?[a-z]?\b{_TAIL}?",
    rf"[AIZ](?<![\w-].)(?:(?<=A)m|(?<=A)n der|(?<=I)m|(?<=Z)um|(?<=Z)ur|(?<=A)uf der)\s{_CAP}\s\d{{1,4}}\s?[a-z]?\b{_TAIL}?",
))
#: Words without one of which the second and the fourth form have no place.
_STREET_GATES = {1: ("box", "postfach", "postale", "bp", "b.p", "bp.", "apartado", "apdo", "casilla"), 3: ("calle", "c/", "avda", "avenida", "plaza", "pza", "paseo", "camino", "ronda", "travesía", "carretera", "ctra")}
#: Cheap signs of a place, round which the costly patterns are tried.
_AT_SIGN = re.compile(rf"@|[(\[{{<]\s?(?:at|AT|a)\s?[)\]}}>]|{_WORD_AT}{_LABEL}(?:{_BRACKET_DOT}|{_WORD_DOT})")
_NUMBER = re.compile(r"\d[\dA-Z ()/.\-   ]{4,}")
_COMMA_INITIAL, _COMMA_NAME = re.compile(rf",{_SP}[{_U}][{_M}]?\."), re.compile(rf",{_SP}[{_U}]")
_NAME_FORMS = tuple(re.compile(p) for p in (
    rf"{_START}{_INIT}{{1,3}}{_SP}?{_PART_ANY}{{0,2}}{_FAM}{_END}",
    rf"{_START}(?=({_PART_ANY}{{0,2}}{_FAM},{_SP}{_INIT}{{1,3}}))",
    rf"{_START}(?=((?:{_CAP}|{_CAPS}){_SP}(?:{_INIT}{_SP}?){{0,2}}(?:(?:{_CAP}|{_CAPS}){_SP})?{_PART_ANY}{{0,2}}{_FAM}))",
    rf"{_START}(?=({_PART_ANY}{{0,2}}{_FAM},{_SP}(?:{_CAP}|{_CAPS})(?:{_SP}{_INIT}){{0,2}}))",
))
_LOW_WORD = re.compile(f"[{_U}{_L}]{{2,}}")
_WHOLE = re.compile(f"{_START}[{_L}]{{3,}}")
_LOW_REST = re.compile(rf"{_SP}(?:(?:{_INIT}|[{_L}]\.){_SP}?){{0,2}}(?:{_PART}){{0,2}}{_LOW}")
_LOW_BEFORE = re.compile(rf"(?<![\w{_M}@.+/-])((?:{_PART}){{0,2}}{_LOW}),{_SP}$")
_LOW_LABELLED = re.compile(rf":{_SP}{{1,2}}(?:[A-Z][a-zª]{{0,4}}\.?ª?{_SP})?({_LOW}{_SP}(?:(?:{_INIT}|[{_L}]\.){_SP}?){{0,2}}(?:{_PART}){{0,2}}{_LOW}|{_LOW},{_SP}{_LOW})(?={_SP}?[(<,:])")

#: Words after which a person may be named in lower case: roles, and verbs and prepositions of authorship, in four languages.
_LOW_CUES = frozenset("""author contact operator technician visitor guest applicant referee reviewer supervisor clerk engineer sender owner editor member employee by ask see dear thank thanks signed attn cc
auteur opérateur technicien visiteur invité candidat rapporteur responsable ingénieur expéditeur par voir chère cher merci remercions autor kontakt bediener techniker besucher gast bewerber gutachter leiter ansprechpartner
absender mitglied von frag siehe liebe lieber danken dank contacto operador técnico visitante invitado candidato revisor ingeniero remitente por véase estimada estimado hola gracias agradecemos firmado gezeichnet signé""".split())
_LOW_CUED = re.compile(rf"(?:{_SP}\d{{1,3}})?{_SP}?[:,]?{_SP}?\(?(?:an{_SP}|à{_SP}|a{_SP}|to{_SP})?(?:(?:Dr|Prof|Pr|Ms|Mr|Mrs|Mme|Mlle|Frau|Herr|Sra?|Dra|D)\.?ª?{_SP})?(?<![{_L}])({_LOW}{_SP}(?:(?:{_INIT}|[{_L}]\.){_SP}?){{0,2}}(?:{_PART}){{0,2}}{_LOW}|{_LOW},{_SP}{_LOW})(?={_SP}?[(<:,;)]|\.?\s*$|\.?\n|{_SP}(?:and|und|et|y)\b)")

_CUES = {k: re.compile(v, re.I) for k, v in {
    "phone": r"\b(t[eé]l(?:[eé](?:phone|fono|fon))?|phone|call|mobile|fax|ring|reach|ruf|anruf\w*|appel\w*|joindre|llam\w*|fon|handy|portable|m[oó]vil|erreichbar)\b",
    "id": r"\b(badge|staff|pass(?:port|nummer)?\b|payroll|passeport|matric\w+|personal-?(?:nr|nummer|ausweis)|ausweis\w*|reisepass\w*|credencial|empleado|n[oó]mina|pasaporte|employ\w+|mitarbeiter\w*|lohn\w*|personnel|paie|dni|nif|n[oº°]\.? de s[eé]cu\w*|insurance|versicherung\w*|identi\w+|id\b)",
    "number": r"\b(order|invoice|catalogue|issn|isbn|grant|checksum|commande|facture|bestell\w*|rechnung|katalog|pedido|factura|cat[aá]logo|doi|stage|platine|stufe|etapa|lane|counts?|z[aä]hlung|compt\w*|recuento|scan|lot|los|lote|batch|build|shelf|thresholds?|seuils?|umbral\w*|schwellen?|page|file|fichier|datei|archivo|fold|sample|versi[oó]n|s[eé]rie|serial|ticket|room|subvention|f[oö]rder\w*|beca|arxiv|pp?\.|s\.)",
    "address": r"(address|adresse|anschrift|domicil\w+|direcci[oó]n|liv(?:es?|ing) (?:at|in)|habite|vive en|visit|deliver|ship|send|mail|post|liefer\w*|livrer|envo\w+|enviar|entregar|wohn\w+|\bto|\ban|\bà|\ba)\b",
    "name": r"\b(by|from|author|auteur|autor|conta[ck]t\w*|operator|op[eé]rateur|operador|bediener|techni\w+|t[eé]cnico|visit\w+|besucher|guest|invit\w+|gast|applicant|candidat\w*|bewerber|referee|reviewer|gutachter|rapporteur|revisor|supervisor|responsable|leiter|sender|remitente|absender|owner|editor|member|membre|mitglied|miembro|thank|thanks|merci|remercions|dank\w*|gracias|agradecemos|signed|sign[eé]|firmado|gezeichnet|note|nota|notiz|vermerk|memo|remark|ask|see|voir|siehe|v[eé]ase|frag\w*|ansprechpartner\w*|sobre|was|war|dear|hi|hello|cher|ch[eè]re|liebe\w*|hola|estimad\w+|regards|wishes|sincerely|cordialement|saludos|atentamente|gr[uü][sß]+e?|correspondant|attn|cc|to|for|für|pour|para|par|por|von|an|à|a|de|of|with|saw|con|bei|mit|avec|chez)\W{0,4}$",
}.items()}
_TITLE = re.compile(r"\b(dr|prof|pr|mr|mrs|ms|mme|mlle|frau|herr|herrn|sr|sra|dra|d\.ª|don|doña|ing|dipl)\.?\s{0,2}$", re.I)
_ORG = re.compile(r"^[’'-]?\s?-?(?:instruments?|threshold|index|schwelle|indice|índice|gmbh|ltd|inc|corp|group|test|method|methode|model|law|filter|stage|works|labs?|laborator\w+|institute?|university|co\b|ag\b|s\.?a\.?\b|systems?|optics|detector|equation|number|criterion|kriterium|gleichung|verfahren|modell|probe|kurve|werke|geräte)", re.I)
_METHOD_LEFT = re.compile(r"(seuil|umbral|indice|índice|méthode|método|platine|test|loi|ley|modelo|modèle|schwelle|methode|the)\s(?:de|del|d['’]|du|von)?\s?$", re.I)
#: Frequent words that begin sentences or headings and are no given names.
_COMMON = frozenset("""the a an and or of in on at with when where after before for to from by this that these those it its we our us you they two three see
note no if is was were are be been as both each between der die das den dem des ein eine und oder im am bei mit nach vor wo ob wir unser über unter auf aus zur zum
für kein keine le la les un une des et ou dans sur avec après avant pour par ce cette nous notre au aux du el los las una y o en con tras para por este esta se su
sus operator visitor reviewer badge payroll call order samples lot fold median score across earlier thresholds questions please corresponding author retake signed subject
bediener besucher gutachter ausweis bestellnummer proben rückfragen bitte ansprechpartner notiz zählung schwellen frühere anschrift opérateur auteur note commande adresse
operador autor nota pedido domicilio dudas escriba dos tres entre cada build stage issn cited table figure fig which what how whether who suppose explain given pupils
technician answer welche erkläre parmi expliquez explique muestras po box flat suite""".split())


_LOW_STOP = (_COMMON | frozenset("si that than then them there their his her all any some other lab laboratory room bench desk same next last first whole".split())) - {"de", "la", "le", "von", "zu", "del", "du", "y", "e", "o"}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    form: int


def candidates(text: str, given: frozenset[str]) -> list[Span]:
    """Overlapping spans of all kinds, with as few misses as can be; for each kind the earliest longest span of a form."""
    out: list[Span] = []
    for a, b in _around(_AT_SIGN.finditer(text), 80, 600):
        for m in _EMAIL.finditer(text, a, b):
            out.append(Span("email", m.start(), m.end(), 0 if "@" in m[0] else 1))
    low = text.lower()
    for form, rx in enumerate(_STREETS):
        if form not in _STREET_GATES or any(g in low for g in _STREET_GATES[form]):
            out += [Span("address", m.start(), m.end(), 0) for m in rx.finditer(text)]
    for a, b in _around((m for m in _NUMBER.finditer(text) if sum(map(str.isdigit, m[0])) >= 5), 8, 24):
        for m in _PHONE.finditer(text, a, b):
            if 7 <= sum(map(str.isdigit, m[0])) <= 18:
                out.append(Span("phone", m.start(), m.end(), 0))
        for m in _ID.finditer(text, a, b):
            if sum(map(str.isdigit, m[0])) >= 5:
                label = _ID_LABEL.match(m[0])
                out.append(Span("id_number", m.start() + (label.end() if label else 0), m.end(), 0))
    for form, rx in enumerate(_NAME_FORMS):
        places = [(0, len(text))] if form in (0, 2) else _around((_COMMA_INITIAL if form == 1 else _COMMA_NAME).finditer(text), 120, 90)
        for m in (m for x, y in places for m in rx.finditer(text, x, y)):
            a, b = m.span(1) if rx.groups else m.span()
            while b > a and text[b - 1] in " \u00a0\u2009\u202f\t-":
                b -= 1
            first = _FIRST.match(text, a, b)
            if first and (len(first[0]) == 1 or first[0].casefold() not in _COMMON) and not (text[a].islower() and _NOTE.search(text[max(0, a - 12) : a])):
                out.append(Span("name", a, b, form))
                if form == 2 and (cut := _FIRST_TWO.match(text[a:b])):
                    out.append(Span("name", a, a + cut.end(), form))
    for m in _LOW_WORD.finditer(text):
        word = m[0]
        if word in given and len(word) > 2 and _WHOLE.match(text, m.start()):
            a, b = m.span()
            if rest := _LOW_REST.match(text, b):
                out.append(Span("name", a, rest.end(), 4))
            if before := _LOW_BEFORE.search(text, max(0, a - 40), a):
                out.append(Span("name", before.start(1), b, 4))
        if word.lower() in _LOW_CUES and (c := _LOW_CUED.match(text, m.end())) and not _LOW_STOP & set(re.split(r"[\s,.]+", c[1])):
            out.append(Span("name", *c.span(1), 4))
    for m in _LOW_LABELLED.finditer(text):
        if not _LOW_STOP & set(re.split(r"[\s,.]+", m[1])):
            out.append(Span("name", *m.span(1), 4))
    return out


def _around(signs: Iterable[re.Match], before: int, after: int) -> list[tuple[int, int]]:
    """Stretches of text round the signs, those that touch put together."""
    out: list[tuple[int, int]] = []
    for m in signs:
        a, b = max(0, m.start() - before), m.end() + after
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_ID_LABEL, _FIRST = re.compile(r"(?:ID|NO|NR|REF)[ -]"), re.compile(r"[^\s,.]+")
_FIRST_TWO = re.compile(rf"(?:{_FAM}){_SP}(?:{_FAM})(?={_SP}{_FAM}$)")
_NOTE = re.compile(r"\b(?:note|nota|notiz|seuil|indice|umbral|índice)\s$", re.I)
_LETTERS = re.compile(r"[^\W\d_]")


def features(text: str, s: Span, given: frozenset[str], lows: frozenset[str]) -> list[float]:
    """Form and context of a span as numbers; the same list for all kinds."""
    v = text[s.start : s.end]
    left = text[max(0, s.start - CONTEXT) : s.start]
    cutoff = max(left.rfind("\n\n"), *(left.rfind(e) for e in (". ", "; ", "? ", "! ")))
    whole = left
    if cutoff >= 0 and not re.search(r"\b(?:tel|tél|no|nr|núm|num|dr|prof|pr|sr|sra|dra|ref|personalnr|[A-ZÉ])$", left[:cutoff], re.I):
        left = left[cutoff + 1 :]
    right = text[s.end : s.end + 24]
    near = left[-26:]
    digits = [len(g) for g in re.findall(r"\d+", v)]
    f = [float(s.form), float(len(v)), float(sum(digits)), float(len(digits)), float(max(digits, default=0)), float(len(_LETTERS.findall(v)))]
    f += [float(v[:1] == "+"), float(v[:1] == "("), float(v[:2] == "00"), float(v[:1] == "0"), float("/" in v), float("." in v), float(v.count("-")), float(v.count(" ")), float("(0)" in v), float("ext" in v)]
    f += [float(v[:1].isalpha()), float(v[-1:].isalpha()), float(bool(re.match(r"[A-Z]{2}\d{2} ", v))), float("\n" in v), float(bool(re.search(r"\d{5}|[A-Z]\d \d[A-Z]{2}", v)))]
    for k in ("phone", "id", "number", "address", "name"):
        rx = _CUES[k]
        hit = None
        for hit in rx.finditer(near if k != "address" else left):
            pass
        f.append(0.0 if hit is None else 1.0 / (1 + len(near if k != "address" else left) - hit.end()) + 1.0)
    f += [float(right[:1] == "("), float(right[:2] == " ("), float(right[:2] == " <"), float(right[:1] == ","), float(right[:1] == ":"), float(right[:1] == "."), float(right[:1] in "\n\r"), float(right[:1] == ")")]
    f += [float(left[-1:] == "("), float(whole[-1:] in "\n\r" or not whole), float(whole[-2:] == ": "), float(bool(re.search(r"[.!?]\s*$", left))), float(bool(_TITLE.search(near)))]
    words = re.findall(r"[^\s,.]+", v)
    low = [w.casefold() for w in words]
    real = [w for w in words if len(w) > 1]
    f += [float(sum(w in given for w in low)), float(bool(low) and low[0] in given), float(bool(low) and low[-1] in given), float(sum(len(w) == 1 for w in words)), float(len(words))]
    f += [float(bool(real) and all(w.isupper() for w in real)), float(v.islower()), float(sum(w in lows for w in low)), float(bool(low) and low[-1] in _COMMON), float("," in v), float(any(w in _COMMON for w in low))]
    f += [float(bool(_ORG.match(right.lstrip(" ")))), float(bool(_ORG.match(words[-1])) if words else 0), float(bool(_METHOD_LEFT.search(near))), float(bool(re.search(r"(?:\b(?:and|und|et|y|e)(?:\sa)?|[,;&])\s$", near))), float(bool(re.match(r"\s?\(?(?:and|und|et|y)\b", right)))]
    f += [float(bool(re.match(r"[,:]?\s{0,2}\(?[+(\d]", right))), float(bool(re.match(r"\s?[(<]", right))), float(left[-1:].isalpha()), float("-" in v and "," not in v)]
    return f


@dataclass
class Finder:
    """Fitted models and thresholds by kind."""

    models: dict[str, Boosted]
    thresholds: dict[str, float]
    calibration: dict[str, tuple[np.ndarray, np.ndarray]]
    given: frozenset[str]

    def find(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end), by start; spans do not overlap."""
        return self.find_many([text])[0]

    def find_many(self, texts: Iterable[str | None], at_once: int = 512) -> list[list[tuple[str, int, int]]]:
        """The places of each text; the spans of ``at_once`` texts are scored together, which changes no score."""
        texts, out = list(texts), []
        for i in range(0, len(texts), at_once):
            part = texts[i : i + at_once]
            spans, x, owner = [], [], []
            for n, text in enumerate(part):
                own = list(dict.fromkeys(candidates(text, self.given))) if text and not text.isspace() else []
                if own:
                    lows = frozenset(re.findall(rf"\b[{_L}]{{3,}}\b", text))
                    spans += own
                    x += [features(text, s, self.given, lows) for s in own]
                    owner += [n] * len(own)
            kept: list[list[tuple[float, Span]]] = [[] for _ in part]
            matrix = np.array(x)
            for kind in KINDS:
                at = [j for j, s in enumerate(spans) if s.kind == kind]
                if at:
                    score = self.models[kind].predict(matrix[at])
                    likely = np.interp(score, *self.calibration[kind]) >= self.thresholds[kind]
                    for q, ok, j in zip(score.tolist(), likely.tolist(), at):
                        if ok:
                            kept[owner[j]].append((q, spans[j]))
            out += [_apart(k) for k in kept]
        return out


_RANK = {k: i for i, k in enumerate(KINDS)}


def _apart(kept: list[tuple[float, Span]]) -> list[tuple[str, int, int]]:
    """Spans that do not overlap: e-mail and postal addresses first, names last, the more certain and longer before others."""
    order = lambda e: (e[1].kind == "name", e[1].kind not in ("email", "address"), -round(e[0], 1), _RANK[e[1].kind], -(e[1].end - e[1].start), e[1].start)
    out: list[tuple[str, int, int]] = []
    starts: list[int] = []
    for _, s in sorted(kept, key=order):
        n = bisect_left(starts, s.start)
        if (n == 0 or out[n - 1][2] <= s.start) and (n == len(out) or s.end <= out[n][1]):
            starts.insert(n, s.start)
            out.insert(n, (s.kind, s.start, s.end))
    return out


def fit_finder(given: Iterable[str], examples: int = EXAMPLES, seed: int = 1) -> Finder:
    """Fit one model a kind on composed examples; every fourth is held out for the kind's calibration and threshold."""
    from .pii_examples import compose

    names = frozenset(g.casefold() for g in given if g)
    rows: dict[str, tuple[list, list, list]] = {k: ([], [], []) for k in KINDS}
    for n, (text, truth) in enumerate(compose(examples, sorted(names), seed)):
        lows, starts = frozenset(re.findall(rf"\b[{_L}]{{3,}}\b", text)), {t[:2] for t in truth}
        for s in dict.fromkeys(candidates(text, names)):
            x, y, held = rows[s.kind]
            x.append(features(text, s, names, lows))
            y.append(float((s.kind, s.start, s.end) in truth or s.kind != "name" and (s.kind, s.start) in starts))
            held.append(n % 4 == 3)
    models, thresholds, calibration = {}, {}, {}
    for kind, (x, y, held) in rows.items():
        x, y, held = np.array(x), np.array(y), np.array(held)
        models[kind] = Boosted().fit(x[~held], y[~held])
        score = models[kind].predict(x[held])
        calibration[kind] = isotonic(score, y[held])
        thresholds[kind] = best_threshold(np.interp(score, *calibration[kind]), y[held])
    return Finder(models, thresholds, calibration, names)


@lru_cache(maxsize=2)
def _fitted(given: tuple[str, ...], examples: int) -> Finder:
    return fit_finder(given, examples)


def finder_for(given_names: DataFrame, examples: int = EXAMPLES) -> Finder:
    """The finder for a reference list of given names; its size is checked, as it travels to the executors."""
    names = given_names.select("given").where("given IS NOT NULL").distinct()
    if names.count() > GIVEN_NAMES:
        raise ValueError(f"more than {GIVEN_NAMES} given names")
    rows = names.orderBy("given").collect()
    return _fitted(tuple(r["given"] for r in rows), examples)


def find_personal(documents: DataFrame, given_names: DataFrame) -> DataFrame:
    """(doc_id, kind, start_pos): a row for each place. One scan, no shuffle."""
    finder = finder_for(given_names)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, k, s) for d, found in zip(b["doc_id"].tolist(), finder.find_many(b["text"])) for k, s, _ in found]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start_pos"]).astype({"doc_id": "int64", "start_pos": "int32"})

    return spread(documents.select("doc_id", "text")).mapInPandas(find, "doc_id bigint, kind string, start_pos int")


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with ``[EMAIL]``, ``[PHONE]`` and so on in place of the spans; null stays null."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact_personal(documents: DataFrame, given_names: DataFrame) -> DataFrame:
    """(doc_id, redacted, n_places) for every document."""
    finder = finder_for(given_names)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = finder.find_many(b["text"])
            yield pd.DataFrame({"doc_id": b["doc_id"], "redacted": [redact(t, f) for t, f in zip(b["text"], found)], "n_places": np.array([len(f) for f in found], dtype="int32")})

    return spread(documents.select("doc_id", "text")).mapInPandas(find, "doc_id bigint, redacted string, n_places int")
