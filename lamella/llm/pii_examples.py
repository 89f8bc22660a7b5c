"""Composed sentences with known places of personal information, for fitting and for tests.

Sentences come from a small grammar of everyday letters, forms and reports: no clause is taken from the corpus. What is no case
(other numbers, methods named after people, headings, lower-case phrases after the same words) comes from the same grammar.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

_ON = "b br c d dr f fl g gl gr h j k kl l m n p pl r s sch st t tr v w z".split()
_VO = "a e i o u ei au ie ou".split()
_CO = "l m n r s t ck nd rt lm st x ng".split()
_FAM_END = {"en": "ham ton by worth field son er ley".split(), "fr": "eau ard et in otte aud ez".split(), "de": "er mann bach feld hoff ke el".split(), "es": "ez ero ano ales illa os".split()}
_PARTS = {"en": ["van der ", "de ", "van "], "fr": ["de ", "du ", "de la ", "le "], "de": ["von ", "zu ", "von der "], "es": ["de la ", "del ", "de "]}
_TITLES = {"en": ["Dr. ", "Prof. ", "Ms ", "Mr ", "Mrs "], "fr": ["Dr ", "Mme ", "Pr ", "Mlle "], "de": ["Dr. ", "Prof. ", "Frau ", "Herr "], "es": ["Dra. ", "Sr. ", "Sra. ", "D.ª ", "Dr. "]}

#: Words of the grammar by language: what a person is called, what comes before a name, before numbers and addresses, and after.
_WORDS = {
    "en": {
        "role": "author|contact|operator|technician|visitor|guest|applicant|referee|reviewer|supervisor|clerk|engineer|sender|owner|editor|member", "before": "thanks to|signed off by|written by|ordered by|call by|met with|ask|see|dear|for|from|by|to|cc|attn|we saw|on behalf of|talk to|led by|was|thank",
        "idlabel": "badge|staff no.|passport|passport number|employee number|personnel no.|pass no.|payroll number|identity card|insurance no.|ID card|ID", "tel": "phone|tel.|telephone|mobile|call|ring|fax|reach me on",
        "adr": "address|lives at|home address is|visit us at|deliver to|mail to|send it to|to", "mail": "e-mail|mail to|reply to|write to|copies to|contact|via|at", "after": "today|for the day|as agreed|before lunch|this week|if it rains|when you can|again|and left|in good time|has gone|is new|about the key|with regards",
        "close": "Regards|Yours sincerely|Best wishes|Cheers|Signed", "and": "and", "note": "Remark|Memo|Comment|Note", "by": "by|from", "subject": "From", "number": "order|invoice|catalogue no.|ISBN|grant|page|file|batch|version|ticket|room|serial no.|DOI|counts|stage|shelf",
        "method": "method|test|threshold|index|equation|model|filter|group|stage|law|institute|Ltd", "of": "the method of|the law of|the threshold of"},
    "fr": {
        "role": "auteur|contact|opérateur|technicien|visiteur|invité|candidat|rapporteur|responsable|ingénieur|expéditeur|membre", "before": "merci à|rédigé par|signé par|commandé par|demander à|voir|chère|cher|pour|par|de|à|avec|remercions|chez",
        "idlabel": "badge|matricule|passeport|numéro de passeport|carte d'identité|n° de sécurité sociale|numéro d'employé|fiche de paie", "tel": "tél.|téléphone|appeler le|portable|fax|joindre au", "adr": "adresse|domicilié au|habite|livrer au|envoyer à|à",
        "mail": "courriel|répondre à|écrire à|mail|contact|via", "after": "aujourd'hui|cette semaine|avant midi|comme prévu|si besoin|encore une fois|est parti|pour la clé", "close": "Cordialement|Bien à vous|Salutations", "and": "et", "note": "Remarque|Mémo|Note", "by": "de|par", "subject": "De",
        "number": "commande|facture|catalogue|subvention|page|fichier|lot|version|série|comptage|platine", "method": "seuil|indice|test|modèle", "of": "le seuil de|la méthode de|l'indice de|la loi de"},
    "de": {
        "role": "Autor|Kontakt|Bediener|Techniker|Besucher|Gast|Bewerber|Gutachter|Leiter|Ansprechpartner|Absender|Mitglied", "before": "dank an|verfasst von|bestellt von|gezeichnet|frag|siehe|liebe|lieber|für|von|an|bei|mit|danken|fragen an|war",
        "idlabel": "Ausweis|Personalnr.|Reisepass|Passnummer|Mitarbeiternummer|Lohnkonto|Versicherungsnr.|Personalausweis", "tel": "Tel.|Telefon|Anruf unter|mobil|Fax|erreichbar unter", "adr": "Anschrift|Adresse|wohnhaft|liefern an|Post an|an",
        "mail": "E-Mail|Antwort an|schreiben an|Mail|Kontakt|per", "after": "heute|diese Woche|vor Mittag|wie vereinbart|bei Bedarf|noch einmal|ist fort|wegen des Schlüssels", "close": "Viele Grüße|Freundliche Grüße|Gruß", "and": "und", "note": "Bemerkung|Vermerk|Notiz", "by": "von", "subject": "Von",
        "number": "Bestellung|Rechnung|Katalog|Förderung|Seite|Datei|Los|Version|Serie|Zählung|Stufe", "method": "Schwelle|Index|Verfahren|Modell|GmbH", "of": "das Verfahren von|die Schwelle von|das Gesetz von"},
    "es": {
        "role": "autor|contacto|operador|técnico|visitante|invitado|candidato|revisor|responsable|ingeniero|remitente|miembro", "before": "gracias a|escrito por|firmado por|pedido por|preguntar a|véase|estimada|hola|para|por|de|a|con|agradecemos a|sobre",
        "idlabel": "credencial|pasaporte|número de pasaporte|DNI|número de empleado|nómina|tarjeta de identidad|matrícula de personal", "tel": "tel.|teléfono|llamar al|móvil|fax|llame al", "adr": "dirección|domicilio|vive en|entregar en|enviar a|a",
        "mail": "correo|responder a|escribir a|contacto|mediante", "after": "hoy|esta semana|antes de comer|según lo acordado|si hace falta|otra vez|se ha ido|por la llave", "close": "Saludos|Atentamente|Un abrazo", "and": "y", "note": "Aviso|Recado|Nota", "by": "de|por", "subject": "De",
        "number": "pedido|factura|catálogo|beca|página|archivo|lote|versión|serie|recuento|etapa", "method": "umbral|índice|modelo", "of": "el umbral de|el método de|la ley de"},
}
#: Sentences of the grammar; a slot in capitals begins with a capital.
_FOUND = """{ROLE}: {title}{name} ({email}), {tel} {phone}.|{ROLE} {title}{name} ({idlabel} {id}) {after}.|{ROLE} {before} {title}{name} ({idlabel} {id}).|{IDLABEL} {id} {after}.|{IDLABEL}: {id}|{IDLABEL} {id}; {adr} {address}.|{ROLE} {title}{name}, {idlabel} {id}, {after}.
{BEFORE} {title}{name} {after}.|{role} {before} {title}{name} {after}.|{BEFORE} {title}{name} {and} {title}{name} {after}.|{BEFORE} {title}{name} {and} {title}{name} {before} {low} {low}.|{low} {before} {title}{name}, {title}{name} {and} {title}{name} {after}.|{CLOSE}, {name} {and} {name}|{BEFORE} {title}{name}, {address}.|{BEFORE} {name}, {phone}.|{ADR}: {address}|{ADR} {address}.|{SUBJECT}: {name} <{email}>\n|{SUBJECT}: {name}\n|{MAIL} {email} {after}.
{TEL} {phone} {after}.|{TEL}: {phone}|{role} {d1} ({title}{name}) {after}; {mail} {email}.|{CLOSE}, {name}\n{address}\n{phone}|{CLOSE},\n{name}|{NOTE} {by} {title}{name}: {after}.|{before} {name} ({email})|{ROLE}: {name}; {name}; {name}\\n|{role} {title}{name} {after}.|{NAME_} {before} {d2}: {title}{name}, {phone}.""".replace("\n", "|").replace("\\n", "\n")
_OTHER = """{NUMBER} {d4}-{d3}-{U}, {number} {d3}-{d4}, {number} {d2}.|{NUMBER} {d4}-{d3}X; {number} {U}{U}-{d4}/{d2}.|{NUMBER} {d1}.{d2}.{d1}, {d12}, @{low}.|{d1} kV @ {d2}.{d2} mm, {d3} {low}.|{NUMBER}: {d3} {d3} {d4}, {d2} {d3} {d4}.|{NUMBER} {low} {low}: {d3} {d3} {d4}.|{NUMBER} {d2}.{d4}, {d2}.{d4}; {date}.
{number} {d2}.{d4}/{low}.{d4}.{d3}, {d3}-{d3}.|[{date}] {low} {d1} {low}, {low} 0.{d3}, {low} 0.{d3}|{NUMBER} {d3}, {d3} {and} {d2} {after}.|{fam} {method} {low} {d2} {after}.|{OF} {fam} {and} {of} {fam} {after}.|{fam}-{method}; {of} {fam}.|{fam} {number} {d2} {after}.|{fam} et al. ({year}) {after}.|{BEFORE} Dr. {fam} {after}.
{Fam} {and} {Fam} {low} {d2}.{d2}, {d3}?|{BEFORE} {Fam} {low} {d3} {low} {and} {Fam} {low} {low} {d2}.{d2}.|{Fam} {Fam} {Fam} {d3} {Fam}|{FAM} {FAM} {d2}, {FAM}|## {Fam} {Fam}|### {Fam} {low} ({year})|{NUMBER} {d3} {low} {low} {d2}.{d2}, {d2}.{d2}.|{Fam}: {low} {d2},{d2}, {low} {d2},{d2}.
{Fam} {low}: {d2},{d2} µm (n = {d3}).|{Fam} {Fam} (p = 0.{d3}) {after}.|{low} {low} {low} {d2}.{d2} µm (n = {d3}), {low} 0.{d3}.|(Fig. {d1}, {U}; Table {d1})|`{low}/{low}_{d1}.py --{low} {d1} --n {d3}`|{low};{low};{low}\n{low}{d1}{low};{d1};{d1}.{d2}|{{"{low}": "{low}{d1}", "p": [0.{d3}, 0.{d3}]}}|id: {low}_{d3}\n{low}: {low}
{BEFORE} {role} {before} {low} {low}; {low} {low}.|{BEFORE} {low} {low}, {d3} {low}.|{ROLE} {low} {low}, {d3} {low}.|{BEFORE} {low} {low} ({year}) {and} {low} {low}.|{NOTE} {by} {low} {low}: {low}.|{Fam} Nord {after}.|{role} {before} {low} {low} {and} {low}.|{NUMBER} {low}_{d4}{d4}_{d2}.tif, {d3}-{d4}-{d2}.|arXiv {d4}.{d5}, ISBN 978-{d1}-{d3}-{d5}-{d1}.|{low} = 0.{d3} * {low} + 0.{d3} * {low} - 0.{d3}|{MAIL} {low} {low}.|{BEFORE} {role} {d1} {after}.|{IDLABEL} {low} {low}, {d3} {low}.|{TEL} {low} {low} {d2}.|{CLOSE} {low} {low}.""".replace("\n", "|").replace("\\n", "\n")


def _word(r: random.Random, n: int) -> str:
    return "".join(r.choice(_ON) + r.choice(_VO) for _ in range(n)) + r.choice(_CO)


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def family(r: random.Random, lang: str) -> str:
    one = lambda: (r.choice(_ON) + r.choice(_VO) + r.choice(_CO) + r.choice(_FAM_END[lang])).capitalize()
    return one() + ("-" + one() if r.random() < 0.1 else "")


def person(r: random.Random, lang: str, given: list[str]) -> str:
    g = r.choice(given).title() if given and r.random() < 0.7 else (_word(r, r.choice((1, 2, 2)))).capitalize()
    f, how = family(r, lang), r.random()
    ini = " ".join(f"{r.choice('ABCDEFGHIJKLMNOPRSTVW')}." for _ in range(r.choice((1, 1, 2))))
    part = r.choice(_PARTS[lang]) if r.random() < 0.18 else ""
    if how < 0.18:
        s = f"{ini} {part}{f}"
    elif how < 0.28:
        s = f"{f}, {ini}"
    elif how < 0.38:
        s = f"{f}, {g}"
    elif how < 0.5:
        s = f"{g} {r.choice('ABCDEHJKLMRST')}. {part}{f}"
    else:
        s = f"{g} {part}{f}"
    case = r.random()
    return s.upper() if case < 0.09 else s.lower() if case < 0.17 and how >= 0.28 else s


def email(r: random.Random) -> str:
    a, b = _word(r, 1), _word(r, 2)
    local = r.choice((f"{a}.{b}", f"{a}-{b}", f"{a}{b}", f"{b}_{a[0]}", f"{b}{_digits(r, 2)}", f"{a}.{b}+{_word(r, 1)}"))
    host = r.choice((f"{_word(r, 2)}.{r.choice(('org', 'net', 'example', 'test', 'de'))}", f"{_word(r, 1)}-{_word(r, 1)}.example", f"mail.{_word(r, 2)}.invalid"))
    how = r.random()
    if how < 0.5:
        s = f"{local}@{host}"
    elif how < 0.6:
        s = f"{local} @ {host}"
    elif how < 0.7:
        s = f"{local}(at){host}"
    elif how < 0.8:
        s = f"{local} [at] {host.replace('.', ' [dot] ')}"
    else:
        s = f"{local} AT {host.replace('.', ' DOT ')}"
    return s.upper() if r.random() < 0.12 else s


def phone(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    return r.choice((
        f"+44 {r.randint(1000, 1999)} {d(6)}", f"+44 (0){r.randint(1000, 1999)} {d(3)} {d(3)}", f"0{r.randint(1000, 1999)} {d(6)}", f"+1-{d(3)}-{d(3)}-{d(4)} ext. {d(2)}", f"+1 {d(3)} {d(3)} {d(4)}", f"+1-{d(3)}-{d(3)}-{d(4)}",
        f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(3)}-{d(3)}-{d(3)}-{d(3)}", f"+{d(3)}{d(9)}", f"00{d(3)} {d(3)} {d(3)} {d(3)}", f"+{d(3)} {d(2)} {d(3)} {d(4)}", f"+49 (0){d(2)} {d(5)} {d(3)}", f"0{d(2)} {d(5)} {d(3)}", f"0{d(2)}/{d(5)}-{d(3)}",
        f"0034 {d(9)}", f"(+34) {d(3)} {d(2)} {d(2)} {d(2)}", f"+34 {d(3)} {d(3)} {d(3)}", f"{d(3)}-{d(3)}-{d(3)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(3)} {d(6)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)} {d(3)} {d(3)}",
    ))


def id_number(r: random.Random) -> str:
    d, u = lambda n: _digits(r, n), lambda n: "".join(r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))
    return r.choice((
        f"{d(4)}-{d(2)}-{d(3)}{u(1)}", f"{u(2)}-{d(2)}-{d(5)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{u(2)}{d(2)} {u(4)} {d(4)} {d(4)} {d(2)}", f"{d(3)}-{d(2)}-{d(4)}", f"{u(1)}{d(2)} {d(3)} {d(2)}",
        f"{u(2)}{d(7)}", f"{d(6)}/{d(4)}", f"{d(8)}-{u(1)}", f"{d(8)}{u(1)}", f"{u(1)}{d(8)}", f"{d(9)}",
    ))


def address(r: random.Random, lang: str) -> str:
    d = lambda n: _digits(r, n)
    c, s, sep = _word(r, 2).capitalize(), _word(r, 2).capitalize(), r.choice((", ", "\n"))
    n = str(r.randint(1, 4800))
    if lang == "en":
        unit = r.choice(("", "", f", Flat {r.randint(1, 60)}B", f", Suite {r.randint(1, 60)}"))
        a = r.choice((f"{n} {s} {r.choice(('Ave.', 'Street', 'Rd', 'Lane', 'Close', 'Mill Road', 'Drive'))}{unit}",) * 3 + (f"PO Box {d(4)}",))
        return a + sep + r.choice((f"{c} {d(5)}", f"{c} {r.choice('VXQL')}{d(1)} {d(1)}ZZ"))
    if lang == "de":
        return r.choice((f"{s}{r.choice(('straße', 'gasse', 'weg', 'allee'))} {r.randint(1, 120)}{r.choice(('', 'a', ''))}",) * 3 + (f"Postfach {d(2)} {d(2)}",)) + sep + f"{r.choice(('', 'D-'))}{d(5)} {c}"
    if lang == "fr":
        return r.choice((f"{r.randint(1, 99)}{r.choice(('', ' bis', ''))}{r.choice((', ', ' '))}{r.choice(('rue du', 'avenue', 'chemin des', 'allée de'))} {s}",) * 3 + (f"BP {d(3)}",)) + sep + f"{d(5)} {c}"
    return r.choice((f"Calle {s} {r.randint(1, 200)}", f"Avda. de {s}, {r.randint(1, 99)}", f"C/ del {s} {r.randint(1, 200)}, {r.randint(1, 9)}º B", f"Plaza {s} s/n", f"Apartado {d(4)}")) + sep + f"{d(5)} {c}"


def _slot(r: random.Random, slot: str, lang: str) -> str:
    """A slot that is no place of personal information."""
    if slot[0] == "d" and slot[1:].isdigit():
        return _digits(r, int(slot[1:]))
    if slot.lower() in _WORDS[lang]:
        w = r.choice(_WORDS[lang][slot.lower()].split("|"))
        return w[:1].upper() + w[1:] if slot.isupper() else w
    return {"U": lambda: r.choice("ABCDLMRT"), "fam": lambda: family(r, lang), "Fam": lambda: _word(r, 2).capitalize(), "FAM": lambda: _word(r, 2).upper(), "NAME_": lambda: _word(r, 2).capitalize(), "low": lambda: _word(r, r.choice((1, 2, 2))), "year": lambda: str(r.randint(1990, 2025)),
            "date": lambda: f"20{_digits(r, 2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}"}[slot]()


def compose(n: int, given: list[str], seed: int = 1) -> Iterator[tuple[str, set[tuple[str, int, int]]]]:
    """n short texts and the places in them, as (kind, start, end)."""
    r = random.Random(seed)
    kinds = {"name": "name", "email": "email", "phone": "phone", "id": "id_number", "address": "address"}
    found, other = ([t for t in x.split("|") if t] for x in (_FOUND, _OTHER))
    for _ in range(n):
        lang = r.choice(("en", "en", "fr", "de", "es"))
        text, truth = "", set()
        for _ in range(r.choice((2, 3, 4))):
            for part in re.split(r"(\{\w+\})", r.choice(found if r.random() < 0.55 else other)):
                slot = part[1:-1] if part[:1] == "{" and part[-1:] == "}" else ""
                if slot == "title":
                    text += r.choice(_TITLES[lang]) if r.random() < 0.15 else ""
                elif slot in kinds:
                    v = {"name": lambda: person(r, lang, given), "email": lambda: email(r), "phone": lambda: phone(r), "id": lambda: id_number(r), "address": lambda: address(r, lang)}[slot]()
                    text += "mailto:" if slot == "email" and r.random() < 0.1 else ""
                    truth.add((kinds[slot], len(text), len(text) + len(v)))
                    text += v
                else:
                    text += _slot(r, slot, lang) if slot else part.replace("{{", "{").replace("}}", "}")
            text += r.choice((" ", " ", "\n", "\n\n", "  "))
        yield text, truth
