"""Personal data in free text, found under disguises and reported by its exact characters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "name")
#: What ends a text that was cut.
CUT = "…"
FOUND = pa.list_(pa.struct([("field_name", pa.string()), ("kind", pa.string()), ("found_text", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
FOUND_DDL = "array<struct<field_name:string,kind:string,found_text:string,start:int,stop:int>>"

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕԁһАВЕКМНОРСТХІЈЅαονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhABEKMHOPCTXIJSaovABEZHIKMNOPTYX"))
#: Characters without width.
UNSEEN = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff")
#: Spelled digits.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_AT = re.compile(r"\s*[\[({<]\s*at\s*[\])}>]\s*", re.I)
_DOT = re.compile(r"\s*[\[({<]\s*(?:dot|punkt|punto|point)\s*[\])}>]\s*", re.I)
_SPOKEN = re.compile(r"(?<![\w@])[\w.+-]+(?P<at>\s+at\s+)[\w-]+(?:\s+dot\s+[\w-]+)+(?!\w)", re.I)
_SPOKEN_DOT = re.compile(r"\s+dot\s+", re.I)
_SPELLED = re.compile(rf"\b(?:{'|'.join(DIGITS)})(?:[ -](?:{'|'.join(DIGITS)}))+\b", re.I)
_SPELLED_ONE = re.compile("|".join(DIGITS), re.I)


class Normal:
    """A text without disguises, and for each of its characters the source characters it stands for."""

    def __init__(self, text: str) -> None:
        self.source = text
        if text.isascii():
            self.text, self.start, self.stop = text, range(len(text)), range(1, len(text) + 1)
        else:
            chars, start, stop = [], [], []
            word_is_mixed = self._mixed(text)
            for k, c in enumerate(text):
                if c in UNSEEN:
                    continue
                d = LOOKALIKES.get(c, c) if word_is_mixed[k] else c
                if d == c and not c.isascii() and not c.isalpha():
                    d = unicodedata.normalize("NFKC", c)
                    d = " " if d.isspace() or not d else d
                elif "\uff01" <= c <= "\uff5e":
                    d = unicodedata.normalize("NFKC", c)
                chars += d
                start += [k] * len(d)
                stop += [k + 1] * len(d)
            self.text, self.start, self.stop = "".join(chars), start, stop
        low = self.text.lower()
        if any(c in low for c in "[({<"):
            self._replace([(m.start(), m.end(), "@") for m in _AT.finditer(self.text)] + [(m.start(), m.end(), ".") for m in _DOT.finditer(self.text)])
        if "dot" in low:
            for m in [*_SPOKEN.finditer(self.text)][::-1]:
                self._replace([(m.start("at"), m.end("at"), "@")] + [(d.start() + m.end("at"), d.end() + m.end("at"), ".") for d in _SPOKEN_DOT.finditer(m[0][m.end("at") - m.start() :])])
        if any(w in low for w in DIGITS) and _SPELLED.search(self.text):
            self._replace([(m.start(), m.end(), "".join(DIGITS[d.lower()] for d in _SPELLED_ONE.findall(m[0]))) for m in _SPELLED.finditer(self.text)])

    @staticmethod
    def _mixed(text: str) -> list[bool]:
        """For each character, whether its word has both ASCII characters and lookalikes."""
        out = [False] * len(text)
        for m in re.finditer(r"\S+", text):
            if any(c in LOOKALIKES for c in m[0]) and any(c.isascii() and c.isalnum() for c in m[0]):
                out[m.start() : m.end()] = [True] * len(m[0])
        return out

    def _replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Each edit's new characters stand for all the source characters between its ends."""
        if not edits:
            return
        chars, start, stop, at = [], [], [], 0
        for a, z, new in sorted(edits):
            chars.append(self.text[at:a])
            start += self.start[at:a]
            stop += self.stop[at:a]
            chars.append(new)
            start += [self.start[a]] * len(new)
            stop += [self.stop[z - 1]] * len(new)
            at = z
        chars.append(self.text[at:])
        self.text, self.start, self.stop = "".join(chars), start + [*self.start[at:]], stop + [*self.stop[at:]]


#: Letters of names in the Latin, Cyrillic and Greek scripts, and characters of Chinese, Japanese and Korean ones.
_UPPER, _LOWER = "A-ZÀ-ÖØ-ÞŁŚŠŽČĆĐŐŰĞİĄĘŃŹŻŘĚŮŤĎŇĽĹŔА-ЯЁІЇЄҐΑ-Ω", "a-zß-öø-ÿłśšžčćđőűğıńęąźżřěůťďňľĺŕа-яёіїєґα-ωάέήίόύώ"
_HAN = "\u4e00-\u9fff\u3040-\u30ff\uac00-\ud7a3"
_EMAIL = re.compile(r"(?<![\w.+%-])[\w](?:[\w.+%'-]*[\w])?@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}(?![\w@-])")
#: Ends of unit names of the service manager, which have the form of an address.
_UNITS = frozenset("service socket target timer mount automount slice scope device path swap".split())
_PHONE_WORD = r"(?:phone|fon|tel|telephone|telefon|t[ée]l[ée]phone|tel[ée]fono|mobile|handy|cell|fax|sms|call|callback|reach|dial|ring|whatsapp|pager|contact)"
_PHONE = re.compile(
    rf"""(?<![\w.+/-])(?<!\d:)(?:
      \+\d{{1,3}}(?:[\ .\-/]?\(?\d{{1,4}}\)?){{2,8}}
    | 00\ ?\d{{1,3}}(?:[\ .\-/]\d{{1,4}}){{2,7}}
    | 00[1-9]\d{{8,12}}
    | \(\d{{2,4}}\)\ ?\d{{3,4}}[-.\ ]\d{{3,4}}
    | 0[1-9]\d{{1,3}}[\ /]\d{{6,8}}
    )(?![\w-])"""
    rf"""| (?:\b{_PHONE_WORD}[.:=]*\s*(?:me\s+on\s+|at\s+|on\s+|to\s+|is\s+)?["']?|[{_LOWER}{_UPPER}.]\s/\s)(?P<local>\(?\d{{3}}\)?[-.\ ]\d{{4}}|\d{{3}}[-.\ ]\d{{3}}[-.\ ]\d{{4}}|0\d{{1,4}}[-/\ ]\d{{3,8}}|\d{{7,11}})(?![\w-])""",
    re.X | re.I,
)
#: Words that only stand before identity numbers of persons, and the plain word, which machines have as well.
_PERSON_ID = r"(?:passports?|reisepass|pasaporte|passeport|ssn|nino|dni|nie|nif|ausweis|ausweis-nr|personnummer|driving\s+licen[cs]e|identity\s+card|social\s+security|national\s+insurance|(?:national|tax|subject|citizen|personal|identity)\s+id)"
_ANY_ID = r"ids?"
_ID_LINK = r"(?:\s*(?:number|no|nr|card))?\s*[.:=#]*\s*[\"'(]?"
_ID_FORM = r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{3}-\d{2}-\d{4}|(?:19|20)?\d{6}[-+]\d{4}|\d{3} \d{4} \d{4}|\d{4} \d{4} \d{4}|[XYZ]-?\d{7}-?[A-Z]?|\d{8}-?[A-Z]|[A-Z]\d{2}[A-Z]\d{5}"
_ID_WIDE = r"[A-Z]{1,2}\d{6,8}|[A-Z0-9]{9}"
_ID = re.compile(rf"(?i:\b{_PERSON_ID}\b{_ID_LINK})(?P<id>{_ID_FORM}|{_ID_WIDE})(?![\w-])|(?i:\b{_ANY_ID}\b{_ID_LINK})(?P<plain>{_ID_FORM})(?![\w-])")
#: Forms that are an identity number without a word before them.
_ID_ALONE = re.compile(r"(?<![\w.:+/#-])(?:[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] \d{2} \d{2} \d{2} [A-D]|(?!000|666)\d{3}-(?!00)\d{2}-(?!0000)\d{4})(?![\w-])")
_CAP = rf"[{_UPPER}][{_LOWER}{_UPPER}'’-]+"
#: Words of technology that are written like names. A surname is none of them, nor does it end in a role of software.
_TECH = "Docker|Engine|Node|Manager|Leader|Election|Raft|Core|Build|Agent|Container|Application|Lane|Service|Cluster|Swarm|Kernel|Server|Worker|Registry|Network|Storage|System|Started|Stopping|Stopped|Failed|Error|Warning|Suspect|Push|Pull|Out|Found|Process|Killed|GECOS|Tel|Mr|Mrs|Ms|Dr|Ausweis"
_SOFTWARE = rf"(?:{_TECH})\b|[{_UPPER}][{_LOWER}]*(?:manager|server|service|daemon|exporter|proxy|controller|agent|engine|cluster|registry|scheduler|gateway|operator|runner)\b"
_PLACE_WORD = rf"(?!(?:{_TECH})\b)[{_UPPER}][{_LOWER}{_UPPER}'’-]+(?![\w=])"
_PLACE = rf"{_PLACE_WORD}(?: (?:(?:am|an der|sur|de|del|la|upon|on|im|ob der) )?{_PLACE_WORD}){{0,2}}"
_CODE = r"(?:[A-Z]{1,2}-)?\d{4,6}(?:-\d{4})?(?![\w-])|[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2}\b"
_TAIL = rf"(?:,\s(?:(?:{_CODE}) {_PLACE}|{_PLACE}(?:,? (?:{_CODE}))?|(?:{_CODE})(?=[;,.)\"']|$)))?"
_UNIT = r"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room) \d+[A-Za-z]?, ?)?"
_NUMBER = r"\d{1,4}[A-Za-z]?"
_ROAD = r"(?:Street|St\.|St|Road|Rd\.|Rd|Avenue|Ave\.|Ave|Lane|Ln\.|Ln|Close|Court|Ct\.|Ct|Rise|Drive|Dr\.|Way|Place|Pl\.|Square|Sq\.|Terrace|Boulevard|Blvd\.|Blvd|Crescent|Gardens|Hill|Row|Mews|Walk|Parade|Quay)"
_ADDRESS = re.compile(
    rf"""(?<![\w.:/#-])(?:
      {_UNIT.replace(" ", chr(92) + " ")}{_NUMBER}\ (?:{_CAP}\ ){{1,3}}{_ROAD}(?![\w-])
    | {_UNIT.replace(" ", chr(92) + " ")}{_NUMBER}(?:\ (?:bis|ter))?,?\ (?:rue|avenue|av\.|boulevard|bd|place|quai|chemin|allée|impasse|route)\ (?:(?:de\ la|de\ l'|de|du|des|d')\ ?)?{_CAP}(?:[\ -]{_CAP}){{0,2}}
    | {_UNIT.replace(" ", chr(92) + " ")}(?:Calle|Avenida|Plaza|Paseo|Camino|Ronda|Travesía|Via|Viale|Piazza|Corso|Rua|Praça)\ (?:(?:del|de\ la|de\ los|de\ las|de|do|da|dei|della)\ )?{_CAP}(?:\ {_CAP})?,?\ {_NUMBER}
    | {_UNIT.replace(" ", chr(92) + " ")}(?:(?:Am|An\ der|Auf\ dem|Im|In\ der|Zum|Zur|Unter\ den)\ (?:{_CAP}\ ){{1,2}}|(?:{_CAP}[\ -])?[{_UPPER}][{_LOWER}]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm|gracht|straat|laan|gatan|vägen|vej|gade)\ |(?:{_CAP}[\ -])(?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ring|Ufer|Damm)\ ){_NUMBER}
    | {_UNIT.replace(" ", chr(92) + " ")}(?:ул|улица|пр|просп|проспект|пер|переулок|пл|площадь|наб|набережная|бульвар|шоссе)\.?\ {_CAP}(?:\ {_CAP})?,?\ (?:д\.?\ ?)?{_NUMBER}
    ){_TAIL.replace(" ", chr(92) + " ")}""",
    re.X,
)
_W = rf"(?:(?:[OD]['’]|Mc|Mac|Fitz)?[{_UPPER}](?:[{_LOWER}]+|[{_UPPER}'’]+)(?:-[{_UPPER}](?:[{_LOWER}]+|[{_UPPER}]+))*)"
_I = rf"[{_UPPER}]\."
_P = r"(?:(?:van der|van den|van de|van|von der|von und zu|von|zu|de la|de los|de|del|della|di|da|dos|das|do|du|le|la|el|al|bin|ibn|ter|ten|VAN DER|VAN DEN|VAN DE|VAN|VON DER|VON|DE LA|DE|DEL|DI|DA|DU) )"
_NAME = rf"(?:(?:{_W}|{_I})(?: (?:{_I}|{_W}(?= {_W},? (?:said|asked|passport))))? {_P}?(?!{_SOFTWARE}){_W}|{_P}?(?!{_SOFTWARE}){_W}, (?:{_W}|{_I})(?: {_I})?)(?![\w@=-])"
#: Names in scripts without capitals; they only count after a lead.
_PLAIN_NAME = rf"[{_HAN}]{{2,4}}(?:[ ·][{_HAN}]{{1,4}})?(?![{_HAN}\w])"
# What stands before a person's name in the languages of the texts: what was done by them, plain leads, labels that a colon may follow, fields and titles.
_DONE = "acknowledged opened closed reported approved signed submitted requested authored written created assigned confirmed handled reviewed".split()
_LEADS = ("assigned to", "handed over from", "handed over by", "taken over from", "taken over by", "on behalf of", "escalated to", "rückfragen an", "rueckfragen an", "per", "c/o", "please ask", "ask for")
_LABELS = ("ansprechpartner", "ansprechpartnerin", "contact", "contacto", "contacté", "contacte", "requester", "on-call", "operator", "engineer", "customer", "owner", "caller", "assignee", "technician", "attn", "контакт", "联系人")
_FIELDS = ("gecos", "maintainer", "username", "user.name", "full_name", "fullname", "display_name", "displayname", "owner", "author", "name", "contact", "comment")
_TITLES = ("Mr.", "Mrs.", "Ms.", "Miss.", "Mx.", "Dr.", "Prof.", "Hr.", "Fr.", "Sr.", "Sra.", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame", "Mme")
_AFTER = (" said", " asked", " wrote", " reported", " called", " confirmed", " <", ", reach at", ", callback", ", tel.", ", phone", "passport")


def _any_of(words: tuple[str, ...] | list[str]) -> str:
    return "|".join(map(re.escape, words))


_BEFORE = rf"(?:(?i:\b(?:{_any_of(_DONE)})[ -]by:?\s|\b(?:{_any_of(_LEADS)}) |\b(?:{_any_of(_LABELS)})[:：]?\s?(?<=[\s:：])|\b(?:{_any_of(_FIELDS)})=[\"']?)|\b(?:{_any_of(_TITLES)}) |(?<=\()(?=[^()]{{3,}}\)))"
_NAMED = re.compile(rf"{_BEFORE}(?:(?P<name>{_NAME})(?: to (?P<other>{_NAME}))?|(?P<plain>{_PLAIN_NAME}))")
_NAMED_AFTER = re.compile(rf"(?<![\w'’-])(?P<name>{_NAME})(?= (?:said|asked|wrote|reported|called|confirmed)\b| <[^<>@\s]+(?:@| ?[\[(]at)|, (?:reach at|callback|Tel\.|phone)|,? passport\b)")
#: Frequent given names in several languages. With a surname after it, such a name needs no lead.
_GIVEN = frozenset(
    """Aaron Adam Ahmed Aisha Alan Alexander Alice Amanda Amir Amy Ana Andrea Andreas Andrew Angela Anita Anna Anne Anton Antonio Arthur Barbara Ben Benjamin Bernd Brian Camille Carla Carlos Carmen Caroline
    Catherine Charles Charlotte Chen Chiara Christian Christine Claire Clara Claudia Daniel David Deborah Diana Dmitri Edward Elena Elisabeth Elizabeth Emily Emma Eric Erik Eva Fatima Felix Fernando Florian Francesca
    Francesco Frank Gabriel George Giulia Hannah Hans Heinrich Helen Henry Hiroshi Ingrid Irina Isabel Ivan Jack Jacob James Jan Jane Javier Jean Jennifer Jessica Johanna John Jonas Jonathan Jorge Jose Joseph Juan Julia
    Karen Karl Katharina Kenji Kevin Klaus Laura Lena Linda Lisa Louis Luca Lucia Luis Maria Marie Mark Markus Martin Mary Matthew Matthias Michael Miguel Mohammed Monika Nadia Natalia Nicolas Nicole Nina Olga Oliver
    Olivia Pablo Patricia Paul Pedro Peter Petra Philip Pierre Rachel Rahul Rebecca Richard Robert Roberto Rosa Samuel Sandra Sarah Sergei Simon Sofia Sophie Stefan Stephen Susan Thomas Ursula Victor Wei William Yuki""".split()
)
_CAPITAL = re.compile(rf"(?<![\w'’.-])([{_UPPER}][{_LOWER}]+)(?= )")
_SURNAMED = re.compile(rf"(?:{_I} )?{_P}?(?!{_SOFTWARE}){_W}(?![\w@=-])")
#: Plain pieces, in lower case, without one of which a detector finds nothing: looking for them is far cheaper. Each has a piece of every alternative of its detector.
_ID_HINTS = ("id", "pass", "pasaporte", "ssn", "nino", "dni", "nie", "nif", "ausweis", "personnummer", "licen", "social", "insurance")
_ROAD_HINTS = tuple(" street| st| road| rd| ave| lane| ln| close| court| ct| rise| drive| dr.| way| place| pl.| square| sq.| terrace| boulevard| blvd| crescent| gardens| hill| row| mews| walk| parade| quay|rue |av. |bd |quai |chemin |allée |impasse |route |calle |avenida |plaza |paseo |camino |ronda |travesía |via |viale |piazza |corso |rua |praça |am |an der |auf dem |im |in der |zum |zur |unter den |straße|strasse|str.|weg|gasse|platz|allee|ring|ufer|damm|gracht|straat|laan|gatan|vägen|vej|gade|ул|пр|пер|пл|наб|бульвар|шоссе".split("|"))
_NAME_HINTS = tuple(sorted({w[-1] + sep + "by" for w in _DONE for sep in " -"} | {x + " " for x in _LEADS} | {*_LABELS} | {x.rpartition(".")[2].rpartition("_")[2] + "=" for x in _FIELDS} | {x.lower() + " " for x in _TITLES} | {*_AFTER}))
_NAME_HINTS = tuple(h for h in _NAME_HINTS if not any(o != h and o in h for o in _NAME_HINTS))
_BRACKETED = re.compile(rf"\((?:[{_UPPER}{_HAN}]|{_P})")
_LONG_NUMBER = re.compile(r"\d{3}-\d\d-\d{4}|[A-Z]{2} \d\d \d\d ")
#: A phone number has seven digits, with three signs between two of them at most.
_CALLABLE = re.compile(r"\d(?:\D{0,3}\d){6}")


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of the personal data in a text, in order and without overlaps."""
    n = Normal(text)
    t = n.text
    found: list[tuple[int, int, str]] = []
    taken = bytearray(len(t))

    def take(a: int, z: int, kind: str) -> None:
        if z > a and not any(taken[a:z]):
            taken[a:z] = b"\1" * (z - a)
            found.append((n.start[a], n.stop[z - 1], kind))

    if "@" in t:
        for m in _EMAIL.finditer(t):
            token = t[: m.start()].rpartition(" ")[2]
            if m[0].rpartition(".")[2].lower() not in _UNITS and "://" not in token:
                take(m.start(), m.end(), "email")
    low = t.lower()
    if any(h in low for h in _ID_HINTS):
        for m in _ID.finditer(t):
            which = "id" if m["id"] else "plain"
            if _digits(m[which]) >= 6:
                take(m.start(which), m.end(which), "id_number")
    if _LONG_NUMBER.search(t):
        for m in _ID_ALONE.finditer(t):
            take(m.start(), m.end(), "id_number")
    if any(h in low for h in _ROAD_HINTS):
        for m in _ADDRESS.finditer(t):
            take(m.start(), m.end(), "address")
    if _CALLABLE.search(t):
        for m in _PHONE.finditer(t):
            which = "local" if m["local"] else 0
            s = m[which]
            if 7 <= _digits(s) <= 15 and (m["local"] or _digits(s) >= (10 if s.startswith("00") else 8)):
                s = s.rstrip(" ./-(")
                if s.endswith(")") and s.count(")") > s.count("("):  # closes what the number stands in
                    s = s[:-1]
                take(m.start(which), m.start(which) + len(s), "phone")
    if _BRACKETED.search(t) or any(h in low for h in _NAME_HINTS):
        for m in _NAMED.finditer(t):
            for part in ("name", "other", "plain"):
                if m[part]:
                    take(m.start(part), m.end(part), "name")
        for m in _NAMED_AFTER.finditer(t):
            take(m.start("name"), m.end("name"), "name")
    for m in _CAPITAL.finditer(t):
        if m[1] in _GIVEN and (rest := _SURNAMED.match(t, m.end() + 1)):
            take(m.start(), rest.end(), "name")
    return sorted(found)


def whole_spans(text: str, uncut: str | None = None) -> list[tuple[int, int, str]]:
    """As ``spans``, without pieces that a cut may have gone through.

    A text that ends in an ellipsis is cut; ``uncut`` is the text it may have been cut from, which tells what stands in full.
    """
    if not text.endswith(CUT):
        return spans(text)
    end = len(text) - len(CUT)
    if uncut is not None and uncut.startswith(text[:end]):
        return [s for s in spans(uncut) if s[1] <= end]
    return [s for s in spans(text) if text[s[1] : end].strip(" ,.(") != ""]


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each piece replaced by its kind, such as ``[EMAIL]``."""
    out, at = [], 0
    for a, z, kind in found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = z
    return "".join([*out, text[at:]])


def personal_data(rows: DataFrame, keys: list[Column], fields: list[str]) -> DataFrame:
    """The keys, ``found`` (field_name, kind, found_text, start, stop) and the masked text of each of ``fields``.

    Texts pass through transducers that undo lookalike letters, invisible characters, spelled digits and written-out
    at and dot signs and keep, for every character, where it came from. Emails, identity numbers, street addresses,
    phones and names are detected in the plain form, in this order, and mapped back, so ``found_text`` is the exact
    piece of the source (``start`` and ``stop`` count code points) and everything else stays as it is. Units and
    images with an at sign, serials, versions and capitalised technical terms are none. A later field that is cut
    (ends in ``…``) only counts what stands in it in full, if need be by the first field.

    One narrow pass, no shuffle; each text is read whole. A null field finds nothing and stays null; empty texts stay
    empty. Repeated rows and pieces come out as often as they stand there. An empty input gives no rows. Only keys and
    fields are read; result columns are the given key names, ``found`` and ``masked_<field>``.
    """
    picked = rows.select(*keys, *[F.col(f).alias(f"__f{k}") for k, f in enumerate(fields)])
    n = len(keys)
    key_names = picked.columns[:n]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:n]), f"found {FOUND_DDL}", *(f"masked_{f} string" for f in fields)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_all, cleaned = [], [[] for _ in fields]
            for texts in zip(*(batch.column(n + k).to_pylist() for k in range(len(fields)))):
                found: list[dict] = []
                done: dict[str, list] = {}
                for k, (field, text) in enumerate(zip(fields, texts)):
                    if text is None:
                        cleaned[k].append(None)
                        continue
                    got = done.get(text)
                    if got is None:
                        got = done[text] = whole_spans(text, texts[0] if k else None)
                    found += [{"field_name": field, "kind": kind, "found_text": text[a:z], "start": a, "stop": z} for a, z, kind in got]
                    cleaned[k].append(masked(text, got) if got else text)
                found_all.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found_all, FOUND), *(pa.array(c, pa.string()) for c in cleaned)], [*key_names, "found", *(f"masked_{f}" for f in fields)])

    return picked.mapInArrow(run, ddl)
