"""Personal information in free text: labelers vote on candidate spans, expectation maximisation estimates how reliable
they are, and a classifier trained on the resulting labels decides.

1. Names that the lexicon lacks are learned from the corpus: words that stand in several kinds of name slots. So are
   words of name slots that are common ones, or that always stand in the same slot.
2. One pass over the whole texts finds candidate spans of each kind, with the votes of regex, gazetteer and context
   labelers (for, against, none) and hashed features of the span and its surroundings. Persons are proposed by known
   names and by the cues around name slots, there whether the name is known or not.
3. The votes of all candidates are counted by pattern, and expectation maximisation runs on those counts.
4. A logistic classifier for each kind is fitted to the posteriors of a bounded sample and decides all candidates.
"""

from __future__ import annotations

import copy
import re
import uuid
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import materialize, ship

KINDS = ("email", "phone", "id_number", "address", "person")
#: Slots of different kinds a word must stand in to be learned as a name, and the share of its slots that a kind must have to
#: count.
SLOT_KINDS, SLOT_SHARE = 3, 0.02
#: Names and common words up to which every worker holds them all; more stay a table that texts are joined with.
HELD = 200_000
#: The share that a town must have of the places that it starts or that start it.
TOWN_SHARE = 0.3
#: How likely a name must be to stand in one kind of slot only, as often as it does, not to count as a fixed phrase.
ONE_SLOT = 0.05
#: What is known of labelers beforehand is worth this many candidates, whatever the size of the corpus.
PRIOR = 100.0
#: Candidates of each kind, at most, that the classifier is fitted on, and its hashed features.
SAMPLE, BUCKETS = 10_000, 1 << 14

# One character for one, so that positions stay: odd dashes and spaces, then full-width forms.
_PLAIN = {"\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u00a0": " ", "\u202f": " ", "\u2007": " ", "\u2009": " ", "\u2019": "'"}
_WIDE_SEEN = re.compile("[\uff0b\uff0d\uff0e\uff10-\uff19\uff20]")
_WIDE_CHAR = re.compile("[\uff01-\uff5e]")

_TLD = r"(?:\.|\s?[\[(]dot[\])]\s?|\sdot\s)"
_DOMAIN = re.compile(rf"[\w-]+(?:{_TLD}[\w-]+)*{_TLD}[^\W\d_]{{2,24}}(?![\w@])", re.I)
_AT = re.compile(r"\s?[\[(]at[\])]\s?", re.I)
_DOT_AT = re.compile(r"(?<![\w.+'-])([\w.+'-]*\w) at ([\w-]+(?: dot [\w-]+)* dot [^\W\d_]{2,24})(?!\w)", re.I)
_KNOWN_TLD = re.compile(r"(?:\.|dot[\])]?\s?)(?:com|org|net|edu|gov|io|co|de|fr|es|uk|eu|info|example|test|invalid)$", re.I)
_DISGUISE = re.compile(r"[\[(]at|\sdot\s", re.I)
_MAIL_CUE = re.compile(r"(?:mail|e-mail|correo|from|to|cc|write|écrire|ask|at|an|à|\"mail\": \"|user=|mailto:|<|\(|,)\W*(?:mailto:)?$", re.I)
_LOCAL = re.compile(r"[\w.+'%-]*\w$")

_PHONE = re.compile(
    r"""(?<![\w.+(/@#$-])(?<![\d],)(?:
    \+\d{1,3}[ .-]?(?:\(\d{1,4}\))?[ .-]?\d{1,5}(?:[ .-]\d{1,5}){1,5} | \+\d{9,14}
    | 1[ .-]\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4} | \(\d{3}\)\ ?\d{3}[ .-]\d{4} | \(0\d{1,4}\)\ ?\d{3,5}[ -]\d{3,5}
    | \d{3}([.-])\d{3}\1\d{4} | \d{3}\ \d{3}\ \d{4} | 0\d{2}\ \d{4}\ \d{4} | 0\d{4}\ \d{6} | 0\d{3}\ \d{3}\ \d{3,4} | 0\d{1,4}/\d{3,8}(?:-\d{1,4})?
    | 0\d(?:\.\d\d){4} | 0\d(?:\ \d\d){4} | [2-9]\d{2}[2-9]\d{6}
    )(?![\w%]|[.,-]\d)""",
    re.X,
)

_ID = re.compile(
    r"""(?<![\w.,+/-])(?:
    (?P<ssn>\d{3}-\d{2}-\d{4} | \d{3}\ \d{2}\ \d{4}) | (?P<tax>\d{2}\ \d{3}\ \d{3}\ \d{3}) | (?P<plain>\d{9} | \d{11})
    )(?![\w]|[-.,/]\d)""",
    re.X,
)
#: Words that label an identity number, and words before numbers of orders and the like.
_ID_LABEL = re.compile(r"(?:ssn|social(?: security)?(?: no\.?| number)?|taxpayer id|tax id|steuer-?id|idnr\.?|ni number|nino|national insurance(?: no\.?| number)?|passport(?: no\.?| number)?|reisepass|personalausweis|dni|nif)(?: on file)?(?: is)?[\s:=#]*$", re.I)
_NUMBER_LABEL = re.compile(r"(?:order|ordre|orden|ticket|auftrag|volume|volumen|run|build|invoice|sold|bought|shares|to|of|#)\s*#?$", re.I)
_PHONE_CUE = re.compile(r"(?:phone|tel\.?|telefon|telephone|teléfono|call|callback|ring|fax(?:ed)?|tried|line is|mob(?:ile)?|voicemail at|p\.|☎|appeler le|llamo al|rufen sie|at|\"tel\": \")[\s:=]*$", re.I)

_W = r"[A-ZÀ-ÖØ-Þ][\w'’.-]*"
_TYPES = r"(?:STREET|Street|street|ST\b\.?|St\b\.?|ROAD|Road|RD\b\.?|Rd\b\.?|LANE|Lane|LN\b\.?|Ln\b\.?|DRIVE|Drive|DR\b\.?|Dr\b\.?|AVENUE|Avenue|AVE\b\.?|Ave\b\.?|BOULEVARD|Boulevard|BLVD\b\.?|Blvd\b\.?|TERRACE|Terrace|COURT|Court|CT\b\.?|Ct\b\.?|YARD|Yard|WAY|Way|PLACE|Place|SQUARE|Square|CLOSE|Close|CRESCENT|Crescent|PARKWAY|Parkway|ROW|Row|WALK|Walk|MEWS|Mews|GARDENS|Gardens)"
_UNIT = r"(?:(?:,\s?|\s?\n|\s)(?:(?:APT|Apt|SUITE|Suite|STE|Ste|UNIT|Unit|FLAT|Flat|FLOOR|Floor|RM|Room)\b\.?\s?[\w-]{1,5}|\#\s?\w{1,5}))?"
_CITY_WORD = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_CITY = rf"{_CITY_WORD}(?:[ -]{_CITY_WORD}){{0,2}}"
_POST = r"(?:,?\s[A-Z]{2}\s\d{5}(?:-\d{4})?|,?\s\d{5}|,?\s[A-Z]{1,2}\d[A-Z\d]?\s\d[A-Z]{2})"
_TOWN = rf"(?:(?:,\s?|\s?\n){_CITY}?{_POST}(?!\d)|,\s(?:{_CITY})(?=[.;:)\]\"|\n]|,\s\d|\son\s|\sas\s|\savant\s|\santes\s|\sund?\s|\s-\s|\s/\s|。|，|；|$))?"
_ADDRESS = re.compile(
    rf"""(?<![\w.,/$%+-])(?<!\d:)(?:
    (?P<en>\#?\d{{1,5}}[A-Za-z]?\s(?:{_W}\ ){{1,4}}{_TYPES}(?![\w'’]){_UNIT}{_TOWN})
    | (?P<fr>\d{{1,4}}(?:\ ?(?:bis|ter|quater)\b)?,?\ (?:rue|avenue|impasse|boulevard|place|chemin|allée|quai|cours|route|square)\ (?:de\ la\ |des\ |du\ |de\ l['’]|de\ |d['’])?{_W}(?:[ -](?:{_W}|de|du|des|la|le))*(?:,\s\d{{5}}\s{_CITY})?)
    | (?P<es>(?:Calle|Plaza|Avenida|Avda?\.|Paseo|Camino|C/)\ (?:de\ (?:las?|los)\ |del\ |de\ )?{_W}(?:\ {_W})*,?\ \d{{1,4}}(?:,\s\d{{1,2}}\.?[ºª](?:\s[A-Z])?)?(?:,\s\d{{5}}\s{_CITY})?)
    | (?P<de>(?:(?:Am|An\ der|Im|Zum|Zur|Alte[rs]?|Neue[rs]?|Große[rs]?|Kleine[rs]?|{_W})\ )?[A-ZÄÖÜ][\wäöüß-]*(?:str\.|straße|strasse|gasse|weg|platz|kamp|graben|allee|ufer|ring|damm|hof|Straße)\ \d{{1,4}}\ ?[a-z]?\b(?:,\s\d{{5}}\s{_CITY})?)
    )""",
    re.X,
)
_NUMBERED = re.compile(rf"(?<![\w.,/$%+-])(?<!\d:)\#?\d{{1,5}}[A-Za-z]?\s(?:{_W} ){{0,3}}{_W}$")
_FR = re.compile(r"\d{1,4}(?: ?(?:bis|ter|quater))?,? $")
#: Words of streets that mark addresses which have the number elsewhere.
_STREET_WORDS = {
    **dict.fromkeys(("rue ", "avenue ", "impasse ", "boulevard ", "place ", "chemin ", "allée ", "quai ", "cours ", "route ", "square "), "fr"),
    **dict.fromkeys(("Calle ", "Plaza ", "Avenida ", "Av. ", "Avda. ", "Paseo ", "Camino ", "C/ "), "es"),
    **dict.fromkeys(("str. ", "straße ", "strasse ", "gasse ", "weg ", "platz ", "kamp ", "graben ", "allee ", "ufer ", "ring ", "damm ", "hof ", "Straße "), "de"),
}
_STREET_WORDS |= {f" {form}": "en" for word in "Street St Road Rd Lane Ln Drive Dr Avenue Ave Boulevard Blvd Terrace Court Ct Yard Way Place Square Close Crescent Parkway Row Walk Mews Gardens".split() for form in (word, word.upper())}
#: The town of an address: before its postcode, after it, or not yet in it.
_TOWN_FIRST = re.compile(rf"[,\n]\s?({_CITY})(?:,? [A-Z]{{2}})?,? (?:\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d[A-Z\d]? \d[A-Z]{{2}})$")
_TOWN_LAST = re.compile(rf"\d{{5}}\s({_CITY})$")
_TOWN_NEXT = re.compile(rf", ({_CITY})")
_DE = re.compile(r"(?:(?:Am|An der|Im|Zum|Zur|Alte[rs]?|Neue[rs]?|Große[rs]?|Kleine[rs]?) )?[A-ZÄÖÜ][\wäöüß-]*\.?$")
_ADDRESS_CUE = re.compile(r"(?:\bat|to|moved:|is at|jetzt|\bà|\ban|\ba|c/o [^\n]{2,40},|lists|live[sd]? (?:at|in)|address:?|Adresse:?|[-/|])\s$", re.I)
#: Streets that stand for a trade, and what follows a street's name in a firm's.
_IDIOM = re.compile(r"\b(?:Wall|Main|High|Fleet|Madison)\s(?:Street|St|Avenue)\b|St\. Dev", re.I)

_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
#: What stands right before a name in a text, by kind of slot, and right after one.
_CUES_BEFORE = {
    "greeting": ("Dear ", "Hi ", "Hello ", "Hey ", "Hallo ", "Bonjour ", "Hola ", "Thanks ", "Merci ", "Danke ", "Gracias ", "Liebe ", "Lieber "),
    "title": ("Mr ", "Mr. ", "Mrs ", "Mrs. ", "Ms ", "Ms. ", "Dr ", "Dr. ", "Herr ", "Herrn ", "Frau ", "Mme ", "Señor ", "Señora ", "Sr. ", "Sra. "),
    "closing": ("signed, ", "Best,\n", "Regards,\n", "Cheers,\n", "\n— ", "\n-- \n", "Grüßen, ", "Cordialement, ", "Un saludo, ", "via ", "fwd "),
    "field": ("\"owner\": \"", "name=", "From: ", "\"name\": \""),
    "source": ("According to ", "said ", "Statement for ", "Posted by ", "Reviewed by ", "Approved: ", "Dossier de ", "Rückfragen an ", "Dudas a ", "Écrire à "),
    "with": ("word with ", "Coffee with ", "Lunch with ", "Call with ", "Ask ", "Call ", "Ring ", "Ping ", "tell ", "c/o ", "intern ("),
    "chat": ("] ",),
}
_CUES_AFTER = {
    "doing": (" says ", " said ", " disagrees", " asked ", " got ", " took ", " graded ", " sold me", " hat ", " wohnt ", " entregó ", " wrote ", " thinks "),
    "id": (", SSN", ", ssn", ", Steuer-ID", ", IdNr", ", NI", ", passport", " (SSN", " (ssn", " (Steuer-ID", " (NI", " : SSN", " : ssn"),
}
_NAME_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_NAME_HERE = re.compile(rf"(?:[^\W\d_]\.\s)?({_NAME_WORD})(?:(,?)\s(?:[^\W\d_]\.\s)?({_NAME_WORD}))?")
_NAME_THERE = re.compile(rf"(?:^|[.!?>:,;]\s|\n)(?:[^\W\d_]\.\s)?({_NAME_WORD})(?:(,?)\s(?:[^\W\d_]\.\s)?({_NAME_WORD}))?$")
_CHAT = re.compile(r"\[\d\d:\d\d\] $")
#: What ends a firm's name.
_FIRM = re.compile(r"(?: [A-ZÀ-Þ][\w'-]+){0,2}(?: & | and Sons\b| (?:Capital|Group|Holdings?|Partners|Inc|LLC|Ltd|GmbH|AG|Corp|Company|Securities|Analytics|Bank|Trust|Fund|Advisors|Industries|Associates|Brothers|Bros|Consulting|Ventures|Insurance|Mutual|Realty|Properties|Estates|Hotels|Stores|Foods|Dairies|Breweries|Mills|Looms|Textiles|Tiles|Glass|Paper|Timber|Cement|Steel|Foundry|Mining|Mines|Motors|Tools|Works|Electric|Energy|Power|Oil|Gas|Chemicals|Pharma|Labs|Laboratories|Technologies|Systems|Software|Networks|Media|Press|Publishing|Airlines|Airways|Railways|Shipping|Freight|Logistics|Transport)\b)")
#: What follows a person's name in a sentence, strongly.
_BY = re.compile(r"\s(?:says?|said|disagrees|asked|got|took|graded|sold|hat|wohnt|entregó|wrote|thinks|called)\b|,? who\b|'s\b|\)\s[a-z]|:\s|>\s|,\sle llamo|\s<")
_BEFORE_RE = re.compile(
    r"(?:(?<!\w)(?:Dear|Hi|Hello|Hey|Hallo|Bonjour|Hola|Morning|Thanks|Merci|Danke|Gracias|Liebe|Lieber|Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Herrn?|Frau|Mme\.?|Señora?|Sra?\.|signed,|Grüßen,|Cordialement,|Un saludo,|via|fwd|From:|According to|said|Statement for|by|Approved:|Dossier de|Rückfragen an|Dudas a|Écrire à|with|[Aa]sk|[Cc]all|[Rr]ing|tell|c/o|I,) |(?:Best|Regards|Cheers),\n|\n?— |-- \n|intern \(|\"owner\": \"|\"name\": \"|name=|\[\d\d:\d\d\] )$"
)


ROLES = ("given", "family", "common")
_JOINT = re.compile(r"['’-]")


def _spans(t: str, most: int) -> Iterator[tuple[int, int]]:
    """Start and end of all runs of letters, and of up to ``most`` of them joined by apostrophes or hyphens."""
    for m in _TOKEN.finditer(t):
        cuts = [m.start(), *(j.end() for j in _JOINT.finditer(t, *m.span())), m.end() + 1]
        for i in range(len(cuts) - 1):
            for k in range(i + 1, min(len(cuts), i + 1 + most)):
                yield cuts[i], cuts[k] - 1


class Names:
    """The names to look for: their forms in one automaton with the signs of addresses and emails, and which are given and
    family names."""

    def __init__(self, given: set[str], family: set[str], common: set[str] | frozenset[str] = frozenset()):
        """``common``: words of name slots that are rather no names."""
        self.forms = (set(given), set(family), set(common))
        self.common, self.own = set(common), frozenset()
        self.given, self.family = {x.lower() for x in given}, {x.lower() for x in family}
        self.all = self.given | self.family
        self.auto = ahocorasick.Automaton()
        for name in given | family:
            for form in {name, name.upper(), *((name.lower(),) if name.lower() in self.family else ())}:
                self.auto.add_word(form, (0, len(form), ""))
        for word, lang in _STREET_WORDS.items():
            # A German street's number follows its word, so only then the word is a hit.
            for form in [word + digit for digit in "0123456789"] if lang == "de" else [word]:
                self.auto.add_word(form, (1, len(form), lang))
        for word in ("@", "(at)", "[at]", "(AT)", "[AT]", " dot ", " DOT "):
            self.auto.add_word(word, (2, len(word), ""))
        for tag, table in ((3, _CUES_BEFORE), (4, _CUES_AFTER)):
            for kind, cues in table.items():
                for cue in cues:
                    self.auto.add_word(cue, (tag, len(cue), kind))
        self.auto.make_automaton()

    def beside(self, words: list[tuple[str, str]]) -> Names:
        """These names and the words (name, role) of one text, which are sought in its tokens instead of by the automaton."""
        more = copy.copy(self)
        of = {role: {w for w, r in words if r == role} for role in ROLES}
        more.given, more.family = self.given | {x.lower() for x in of["given"]}, self.family | {x.lower() for x in of["family"]}
        more.all, more.common = more.given | more.family, self.common | of["common"]
        names = of["given"] | of["family"]
        more.own = frozenset(names | {x.upper() for x in names} | {x.lower() for x in names if x.lower() in more.family})
        return more

    def own_hits(self, t: str) -> list[tuple[int, int]]:
        return [(a, b) for a, b in _spans(t, 1 + max(len(_JOINT.findall(x)) for x in self.own)) if t[a:b] in self.own] if self.own else []

    def knows(self, token: str) -> bool:
        low = token.lower()
        return low in self.all or "-" in low and all(p in self.all for p in low.split("-"))

    def is_family(self, token: str) -> bool:
        return token.lower() in self.family or token.lower().split("-")[-1] in self.family

    def is_given(self, token: str) -> bool:
        return token.lower().split("-")[0] in self.given


_TITLES = frozenset(c.strip(" .") for c in _CUES_BEFORE["title"])
#: Kinds of slots that hold persons and hardly anything else.
_SURE_SLOTS = frozenset(("greeting", "title", "closing", "field", "chat", "id"))
_CAPITAL = r"[^\W\d_a-zß-ÿ][^\W\d_]+(?:['’-][^\W\d_]+)*"
_PROPOSED = re.compile(rf"((?:[A-ZÀ-Þ]\. ?){{0,2}})({_CAPITAL})")
_PROPOSED_NEXT = re.compile(rf" ((?:[A-ZÀ-Þ]\. ?){{0,2}})({_CAPITAL})(?![\w@])")
_FLIPPED = re.compile(rf", ({_CAPITAL})(?=[\"\n]| <)")


def _more(t: str, names: Names, b: int, most: int = 3) -> int:
    """Where a name that is proposed up to ``b`` ends: further capitalised words of the line belong to it, up to a family name,
    unless they are common words, titles or part of a firm's name."""
    while most and (m := _PROPOSED_NEXT.match(t, b)) and not _FIRM.match(t, b):
        word = _POSSESSIVE.sub("", m.group(2))
        if not _is_name_word(word) or not names.knows(word) and (word in names.common or word in _TITLES):
            break
        b, most = m.start(2) + len(word), most - 1
        if names.is_family(word) and not names.is_given(word):
            break
    return b


def _proposals(t: str, names: Names, cues: list[tuple[int, int, int, str]], taken: list[tuple[int, int]]) -> dict[int, tuple[int, int, str]]:
    """Start of a name's first word: start with initials, end and kind of slot, of the names that cues announce or follow.
    ``cues``: tag, start, end and kind of those in the text; ``taken``: other spans, whose last word is no cue (as Dr. of a street)."""
    out: dict[int, tuple[int, int, str]] = {}
    for tag, start, end, kind in cues:
        if tag == 3:
            if end >= len(t) or not t[end].isupper() or start and t[start].isalpha() and t[start - 1].isalnum():
                continue
            if any(x <= start < y for x, y in taken):
                continue
            m = _PROPOSED.match(t, end)
            if not m or m.group(2) in _TITLES:
                continue
            a, word = m.start(2), _POSSESSIVE.sub("", m.group(2))
            b = a + len(word)
            if b == m.end() and not (names.is_family(word) and not names.is_given(word)):
                b = _more(t, names, b)
            if kind == "field" and b == m.end() and (flip := _FLIPPED.match(t, b)):
                b = flip.end()
            if kind == "greeting" and b == m.end() and not m.group(1) and t[b : b + 1] not in (",", "!", ":"):
                continue
            if kind == "chat" and (t[b : b + 1] not in (":", ">") or not _CHAT.search(t, max(0, end - 8), end)):
                continue
            first = end
        else:
            m = _NAME_THERE.search(t, max(0, start - 44), start) if start and t[start - 1].isalpha() else None
            if not m:
                continue
            g = 3 if m.group(1) in _TITLES else 1
            if m.group(2) or not m.group(g) or not all(_is_name_word(x) for x in m.groups()[g - 1 :: 2] if x):
                continue
            if "\n" in t[m.start(g) : start]:
                continue
            word, a, b = m.group(g), m.start(g), start
            first = a - 3 if g == 1 and t[a - 2 : a] == ". " and m.start() <= a - 3 and t[a - 3 : a - 2].isupper() else a
        if _is_name_word(word) and (a not in out or out[a][1] < b):
            out[a] = (first, b, kind)
    return out


def _same_case(a: str, b: str) -> bool:
    return a.isupper() == b.isupper() and a.islower() == b.islower()


def _vote(yes: bool, no: bool = False) -> str:
    return "+" if yes else "-" if no else "0"


def _emails(t: str, at: list[int]) -> Iterator[tuple[int, int, str]]:
    """``at``: where "@", "(at)", "[at]" and " dot " end."""
    spans = []
    for end in at:
        if t[end - 1] == "@":
            start = end - 1
        elif t[end - 1] in ")]":
            m = _AT.search(t, end - 5)
            if not m:
                continue
            start, end = m.span()
        else:
            spans += [m.span() for m in _DOT_AT.finditer(t, max(0, end - 90), end + 40)]
            continue
        d = _DOMAIN.match(t, end)
        if d:
            left = _LOCAL.search(t, max(0, start - 64), start)
            if left:
                head = left.start() + len(left.group()) - len(left.group().lstrip(".+'-%"))
                if head < start:
                    spans.append((head, d.end()))
    spans.sort()
    end = -1
    for a, b in spans:
        if a < end:
            continue
        s, end = t[a:b], b
        plain = "@" in s
        known = _KNOWN_TLD.search(s)
        cue = _MAIL_CUE.search(t[max(0, a - 24) : a])
        url = t[max(0, a - 3) : a] == "://"
        yield a, b, _vote(plain or bool(_DISGUISE.search(s))) + _vote(bool(known)) + _vote(bool(cue)) + _vote(s[0].isalnum(), url) + _vote(any(c.isalpha() for c in s[:3]), s[0].isdigit())


_LETTERED = re.compile(r"[A-Z](?:([A-Z] ?\d\d ?\d\d ?\d\d ?[A-D])|\d{8})(?!\w|[-.,/]\d)")
_RUN = re.compile(r"\d[\d ().+/-]{7,}")
_DATES = re.compile(r"(?:[ .]|\d{1,2}/\d{1,2}/\d{4}|20\d\d-\d\d-\d\d|20\d{6}(?!\d)|\d{1,4}\.\d{1,3}(?![.\d]))+[. (+]*$")
_GROUP = re.compile(r"[ .-]\d{1,5}$")
_US = re.compile(r"\+1\D")
_FIELD_END = re.compile(r"(?:[^\W\d]\s[-/|]\s|[^\W\d],|\|\s)$")
_EXT = re.compile(r"\s?(?:x|ext)", re.I)
_AFTER_LINE = re.compile(r"line is|at|tried|faxed")
_WORD_END = re.compile(r"[\w.'’-]+[ ,:(|]+$")


def _numbers(t: str) -> Iterator[tuple[int, int, int, str]]:
    """(kind number, start, end, votes) of phone and identity numbers, sought only around long runs of digits."""
    for m in _LETTERED.finditer(t):
        if m.start() and (t[m.start() - 1].isalnum() or t[m.start() - 1] in "_.,+/-"):
            continue
        label = bool(_ID_LABEL.search(t, max(0, m.start() - 34), m.start()))
        yield 2, *m.span(), _vote(bool(m.group(1))) + _vote(label) + _vote(True) + "0" + _vote(bool(_WORD_END.search(t[max(0, m.start() - 8) : m.start()]))) + _vote(False, not (label or m.group(1)))
    for run in _RUN.finditer(t):
        if sum(map(str.isdigit, run.group())) < 9 or _DATES.match(run.group()):
            continue
        lo, hi = max(0, run.start() - 4), run.end() + 4
        for m in _PHONE.finditer(t, lo, hi):
            a, s = m.start(), m.group()
            if a > 0 and lo == a and (t[a - 1].isalnum() or t[a - 1] in ".+(/@#$-,"):
                continue
            digits = sum(c.isdigit() for c in s)
            most = 11 if _US.match(s) else 13
            while digits > most and _GROUP.search(s):
                s = _GROUP.sub("", s)
                digits = sum(c.isdigit() for c in s)
            if not 9 <= digits <= 14:
                continue
            b = a + len(s)
            before, after = t[max(0, a - 22) : a], t[b : b + 6]
            other, label = bool(_NUMBER_LABEL.search(before)) and not _AFTER_LINE.search(before[-9:]), bool(_ID_LABEL.search(before))
            led = s[0] in "+(" or s[0] == "0"
            cue = bool(_PHONE_CUE.search(before))
            bare = s.isdigit() and len(s) == 10 and not led and (other or not (cue or _FIELD_END.search(before)))  # as any number of ten digits
            yield 1, a, b, _vote(led) + _vote(cue) + _vote(10 <= digits <= 13) + _vote(False, other or label) + _vote(bool(_EXT.match(after)), after[:1] in "%$") + _vote(False, bare)
        for m in _ID.finditer(t, lo, hi):
            a, b = m.span()
            label = bool(_ID_LABEL.search(t, max(0, a - 34), a))
            kind = m.lastgroup
            other = bool(_NUMBER_LABEL.search(t, max(0, a - 12), a)) and not label
            yield 2, a, b, _vote(kind != "plain") + _vote(label) + _vote(label or kind == "ssn") + _vote(False, other) + _vote(bool(_WORD_END.search(t[max(0, a - 8) : a]))) + _vote(False, kind == "plain" and not label)


_DOTTED = re.compile(r"\b(?:ave)\.$", re.I)
_CODE = re.compile(r"\d{5}|\d[A-Z]{2}\b")
_PARTS = re.compile(r"\b(?:apt|suite|unit|flat|floor)\b|#|º", re.I)
_GOES_ON = re.compile(r"\s(?!as\b|is\b|has\b|was\b)(?:[a-z]+s\b|Capital|Group|Holdings)")
_BREAK = re.compile(r"[.,;]?\s*(?:\n|$)")


def _words_back(t: str, at: int, words: int) -> int:
    """Where the ``words``-th word before ``at`` starts, words being separated by blanks and line ends; 0 if there are fewer."""
    for _ in range(words):
        at = max(t.rfind(" ", 0, at), t.rfind("\n", 0, at))
        if at < 0:
            return 0
    return at + 1


def _addresses(t: str, words: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str, str]]:
    """Also each address's town: "=" before one that a postcode ends, "!" before words that punctuation ends, "<" before words at the end of which some
    may be more than the town, ">" before words after the address that may be its town. ``words``: start, end and language of street
    words found in the text."""
    starts, size = [], len(t)
    for a, b, lang in words:
        if lang == "en":
            if (b == size or not (t[b].isalnum() or t[b] == "'")) and (m := _NUMBERED.search(t, _words_back(t, a, 7), a)):
                starts.append(m.start())
        elif lang == "es":
            starts.append(a)
        elif lang == "fr":
            if m := _FR.search(t, max(0, a - 12), a):
                starts.append(m.start())
        elif m := _DE.search(t, _words_back(t, a, 4), b - 2):
            starts.append(m.start())
    end = -1
    for at in sorted(set(starts)):
        m = _ADDRESS.match(t, at) if at >= end else None
        if not m:
            continue
        a, s = m.start(), m.group().rstrip(",;: ")
        if s[-1] == "." and not _DOTTED.search(s):
            s = s[:-1]
        b = end = a + len(s)
        town = ""
        if place := _TOWN_LAST.search(s):
            town = ("!" if b == size or t[b] in ".,;:)\n" else "<") + place.group(1)
        elif place := _TOWN_FIRST.search(s):
            town = "=" + place.group(1)
        elif place := _TOWN_NEXT.match(t, b):
            town = ">" + place.group(1)
        before, after = t[max(0, a - 48) : a], t[b : b + 12]
        full = bool(_CODE.search(s[6:]))
        idiom = bool(_IDIOM.search(s)) and not full
        goes_on = bool(_GOES_ON.match(after))
        cue = bool(_ADDRESS_CUE.search(before))
        yield a, b, _vote(full) + _vote(bool(_PARTS.search(s))) + _vote(cue) + _vote(not goes_on, goes_on) + _vote(False, idiom) + _vote(m.lastgroup != "en" or "," in s or cue or bool(_BREAK.match(after))), town


_NEXT = re.compile(r"(,?\s)((?:[^\W\d_]\.\s)?)([^\W\d_]+(?:['’-][^\W\d_]+)*)")
_PREVIOUS = re.compile(r"(?<![^\W\d_])([^\W\d_]+(?:['’-][^\W\d_]+)*)((?:\s[^\W\d_]\.)?)(,?\s)$")
_INITIALS = re.compile(r"(?<![\w.])(?:[^\W\d_]\.\s?){1,2}$")


def _phrase(t: str, names: Names, a: int, b: int) -> tuple[int, int] | None:
    """The name around the token at a..b: given names, initials and family names that belong together."""
    tok = t[a:b]
    # to the right
    while True:
        m = _NEXT.match(t, b)
        if not m or "\n" in m.group(1):
            break
        nxt = re.sub(r"['’]s$", "", m.group(3), flags=re.I)
        if not names.knows(nxt) or not _same_case(nxt, tok):
            break
        last = _TOKEN.findall(t[a:b])[-1]
        if m.group(1)[0] == ",":
            if not (names.is_family(last) and names.is_given(nxt) and not names.is_given(last)):
                break
        elif names.is_family(last) and not names.is_given(last):
            break
        b = m.start(3) + len(nxt)
    while a > 1 and t[a - 1].isspace() and (t[a - 2].isalpha() or t[a - 2] == "," or t[a - 2] == "." and t[a - 3].isalpha() and not t[a - 4 : a - 3].isalpha()):
        m = _PREVIOUS.search(t, _words_back(t, a - 1, 4), a)
        if not m or "\n" in m.group(3) or "\n" in m.group(2):
            break
        prv, first = m.group(1), _TOKEN.findall(t[a:b])[0]
        if not names.knows(prv) or not _same_case(prv, tok):
            break
        if m.group(3)[0] == ",":
            if m.group(2) or not (names.is_family(prv) and not names.is_given(prv) and names.is_given(first)):
                break
        elif names.is_family(prv) and not names.is_given(prv) or not names.is_given(prv):
            break
        a = m.start(1)
    m = _INITIALS.search(t, max(0, a - 6), a) if a > 1 and "." in t[a - 2 : a] else None
    if m and t[m.start()].isupper():
        a = m.start()
    return a, b


#: Words at the end of a cue; only after them, brackets, line ends and signs the cue's pattern is tried.
_CUE_ENDS = frozenset(
    "Dear Hi Hello Hey Hallo Bonjour Hola Morning Thanks Merci Danke Gracias Liebe Lieber Mr Mr. Mrs Mrs. Ms Ms. Dr Dr. Herr Herrn Frau Mme Mme. Señor Señora Sr. Sra. signed, Grüßen, Cordialement, saludo, via fwd From: to said for by Approved: de an a à with Ask ask Call call Ring ring tell c/o I, — -- mailto:".split()
)


def _cue(before: str) -> bool:
    """Whether a name is announced right before it."""
    end = before[-1:]
    if end == " ":
        if before[-2:-1] != "]" and before.rsplit(None, 1)[-1] not in _CUE_ENDS:
            return False
    elif end not in "\n(\"=":
        return False
    return bool(_BEFORE_RE.search(before))


def _then(after: str) -> tuple[bool, bool, str]:
    """Whether what follows a name suits a person, or a firm; and a capitalised word right after it."""
    cap = _CAP.match(after)
    return bool(_BY.match(after)), bool(_FIRM.match(after)), cap.group(1) if cap else ""


_AND = (" and ", " und ", " et ", " y ")
_LOWER_WORD = re.compile(r" [a-zß-ÿ]")
_VERB = re.compile(r" (?:says?|said|disagrees|asked|got|took|graded|sold|hat|wohnt|entregó|wrote|thinks|called|who)\b| and Sons")
_CAP = re.compile(r" ([A-ZÀ-Þ][a-zß-ÿ]+)")
_LEFT_PART = re.compile(r"[^\W\d_]+['’-]$")
_RIGHT_PART = re.compile(r"(?:['’-][^\W\d_]+)+")
_POSSESSIVE = re.compile(r"['’]s$", re.I)
_LEVELS = ("INFO", "WARN", "ERROR", "DEBUG")


def _persons(t: str, names: Names, hits: list[tuple[int, int]], taken: list[tuple[int, int]], proposed: dict[int, tuple[int, int, str]] | None = None) -> Iterator[tuple[int, int, str, str]]:
    starts = [x[0] for x in taken]
    end, size = -1, len(t)
    proposed = proposed or {}
    if proposed:
        hits = sorted([*hits, *((a, m.end()) for a in proposed if (m := _TOKEN.match(t, a)))])
    for a, b in hits:
        if a < end or a and (t[a - 1].isalnum() or t[a - 1] in "_@+") or b < size and (t[b].isalnum() or t[b] in "_@+"):
            continue
        i = bisect_left(starts, b) - 1
        if i >= 0 and taken[i][1] > a:
            continue
        if a and t[a - 1] in "'’-" and (m := _LEFT_PART.search(t, max(0, a - 24), a)):
            a = m.start()
        if b < size and t[b] in "'’-" and (m := _RIGHT_PART.match(t, b)):
            b = m.end()
        if a and t[a - 1] in "@_":
            continue
        token = _POSSESSIVE.sub("", t[a:b]) if t[b - 1] in "sS" else t[a:b]
        b = a + len(token)
        slot = proposed.get(a)
        if not names.knows(token) and not slot:
            continue
        known = names.knows(token)
        a, b = _phrase(t, names, a, b) if known else slot[:2]
        if known and slot and b < slot[1] and not names.is_family(_TOKEN.findall(t[a:b])[-1]):
            b = slot[1]  # a given name and a family name that isn't known
        i = bisect_left(starts, b) - 1
        if i >= 0 and taken[i][1] > a and (m := _TOKEN.search(t, taken[i][1], b)):
            a = m.start()  # what looked like an initial ends another span
        if a < end:
            continue
        end = b
        before, after = t[max(0, a - 20) : a], t[b : b + 32]
        cue = _cue(before)
        if not slot and not cue and b - a == len(token) and _LOWER_WORD.match(after) and not _VERB.match(after) and not before.endswith(_AND):
            # A single word in running text, as most are: the votes of all labelers are known without asking each.
            yield a, b, f"00000-{'+' if names.is_family(token) else '0'}-0{'-' if token.islower() else '0'}", ""
            continue
        words = _TOKEN.findall(t[a:b])
        shape = len(words) > 1 or "." in t[a:b]
        if before.endswith(_AND):
            other = _TOKEN.findall(before[:-4])
            cue = bool(other) and names.knows(other[-1])
        low = words[0].islower() and not shape and not cue
        by, firm, cap = _then(after) if cue or shape or not _LOWER_WORD.match(after) or _VERB.match(after) else (False, False, "")
        family = any(map(names.is_family, words))
        both = len(words) > 1 and family and any(map(names.is_given, words))
        firm = firm or not shape and bool(cap) and not names.knows(cap) and cap not in _LEVELS
        month = not shape and words[0] == "May" and after[1:2].isdigit()
        plain = not shape and not by and not cue and after[:1] == " " and after[1:2].islower()
        strange = [w for w in words if len(w) > 1 and not names.knows(w)] if slot else []
        common = any(w in names.common for w in strange)
        doubt = common or bool(strange) and not shape and slot[2] not in _SURE_SLOTS
        votes = _vote(both) + _vote(shape) + _vote(cue) + _vote(by) + _vote(False, firm) + _vote(False, month and not cue or plain) + _vote(family and not firm) + _vote(False, common or not shape and not cue and not by) + _vote(False, doubt) + _vote(False, low)
        yield a, b, votes, f"{before[-1:]}|{after[:1]}|{len(words)}"


@lru_cache(400_000)
def _hashed(part: str) -> int:
    return zlib.crc32(part.encode()) % BUCKETS


_LOW, _HIGH, _NINE = re.compile(r"[a-zß-ÿ]+"), re.compile(r"[A-ZÀ-Þ]+"), re.compile(r"\d")


def _features(k: int, votes: str, t: str, a: int, b: int, more: str) -> list[int]:
    if k == 4 and votes[1] == "0" and "-" in votes and "+" not in votes:
        return []  # a single word with votes only against it: the classifier's constant decides
    parts = [f"{k}v{i}{v}" for i, v in enumerate(votes) if v != "0"]
    parts.append(f"{k}all{votes}")
    if k == 4 and votes[8] == "-":  # what surrounds a common word tells nothing of names
        return [_hashed(p) for p in [*parts, f"x={t[a:b].lower()}"]]
    before, after = t[max(0, a - 16) : a], t[b : b + 14]
    prev, nxt = (_TOKEN.findall(before) or [""])[-1].lower(), (_TOKEN.findall(after) or [""])[0].lower()
    parts += [f"{k}p={prev}", f"{k}n={nxt}", f"{k}c={before[-1:]}", f"{k}d={after[:1]}"]
    if k == 4:
        s = t[a:b].lower()
        parts += [f"w={s}", f"wn={nxt}"] if " " not in s else ["w2"]
        parts.append(more)
    else:
        parts.append(f"{k}s={_HIGH.sub('A', _LOW.sub('a', _NINE.sub('9', t[a : min(b, a + 24)])))}")
    return [_hashed(p) for p in parts]


def _flat(text: str) -> str:
    if text.isascii():
        return text
    for odd, plain in _PLAIN.items():
        if odd in text:
            text = text.replace(odd, plain)
    return _WIDE_CHAR.sub(lambda m: chr(ord(m.group()) - 0xFEE0), text) if _WIDE_SEEN.search(text) else text


def candidates_of(text: str, names: Names) -> list[tuple[int, int, int, str, list[int], str]]:
    """(kind number, start, end, votes, features, town) of each candidate; spans of earlier kinds hide those of later ones."""
    t = _flat(text)
    hits, streets, at, cues = [], [], [], []
    for last, (tag, size, lang) in names.auto.iter(t):
        if tag == 0:
            hits.append((last + 1 - size, last + 1))
        elif tag == 1:
            streets.append((last + 1 - size, last + 1, lang))
        elif tag == 2:
            at.append(last + 1)
        else:
            cues.append((tag, last + 1 - size, last + 1, lang))
    hits = sorted([*hits, *names.own_hits(t)]) if names.own else hits
    found, taken = [], []

    def keep(k: int, a: int, b: int, votes: str, town: str = "") -> None:
        if not any(x < b and a < y for x, y in taken):
            found.append((k, a, b, votes, "", town))
            own.append((a, b))

    own: list[tuple[int, int]] = []
    if at:
        for a, b, votes in _emails(t, at):
            keep(0, a, b, votes)
        taken += own
    own = []
    numbers = list(_numbers(t))
    for k in (1, 2):
        for kind, a, b, votes in numbers:
            if kind == k:
                keep(k, a, b, votes)
        taken += own
        own = []
    for a, b, votes, town in _addresses(t, streets):
        keep(3, a, b, votes, town)
    taken += own
    taken.sort()
    found += [(4, *p, "") for p in _persons(t, names, hits, taken, _proposals(t, names, cues, taken))]
    return [(k, a, b, votes, _features(k, votes, t, a, b, more), town) for k, a, b, votes, more, town in found]


def _cue_automaton() -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for table, after in ((_CUES_BEFORE, False), (_CUES_AFTER, True)):
        for kind, cues in table.items():
            for cue in cues:
                auto.add_word(cue, (kind, len(cue), after))
    auto.make_automaton()
    return auto




def _is_name_word(word: str | None) -> bool:
    return bool(word) and len(word) > 1 and word[0].isupper() and not word.isupper()


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, place, slot kind, count) of the words in name slots; place: 0 the first, 1 a later one. At place -1 how often the
    word stands in lower case in the same texts."""
    counts: Counter = Counter()
    lower: Counter = Counter()
    auto = _cue_automaton()
    for batch in batches:
        for t in batch.column(0).to_pylist():
            lower.update(filter(str.islower, (t or "").split(" ")))
            for last, (kind, size, after) in auto.iter(t or ""):
                start, end = last + 1 - size, last + 1
                if after:
                    m = _NAME_THERE.search(t, max(0, start - 44), start)
                elif end < len(t) and t[end].isupper() and not (size and t[start].isalpha() and start and t[start - 1].isalnum()):
                    m = _NAME_HERE.match(t, end)
                    if m and kind == "chat" and (t[m.end() : m.end() + 1] not in (":", ">") or not _CHAT.search(t, max(0, end - 8), end)):
                        continue
                else:
                    continue
                if not m or not _is_name_word(m.group(1)):
                    continue
                first, flip, second = m.group(1), m.group(2) == ",", m.group(3)
                if kind == "greeting" and second is None and t[m.end() : m.end() + 1] not in (",", "!", ":"):
                    continue
                two = _is_name_word(second)
                counts[first, int(flip and two), kind] += 1
                if two:
                    counts[second, int(not flip), kind] += 1
    rows = list(counts.items())
    rows += [((w, -1, ""), n) for w in {k[0] for k in counts} if (n := lower[w.lower()] + lower[f"{w.lower()},"])]
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([k[2] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())],
        ["word", "place", "slot", "n"],
    )


def _held(rows: DataFrame, most: int) -> list | None:
    """The rows if there are at most ``most`` of them."""
    got = rows.limit(most + 1).collect()
    return got if len(got) <= most else None


def learn_names(documents: DataFrame, text: str, lexicon: DataFrame) -> DataFrame:
    """word and role (given, family, common): the lexicon's names and those learned, words that stand in at least SLOT_KINDS
    kinds of slots of the corpus, each with SLOT_SHARE of the word's slots. A name seen in fewer is still found where a cue
    proposes it. The lexicon's names are words, without blanks in them.

    Common are words of slots that stand more often in lower case, and those which stand in one kind of slot only, so often
    that a name, spread over the kinds as all words in slots are, would do so with a probability under ONE_SLOT.

    Slots are counted over all texts, first in each task.
    """
    ship(documents.sparkSession)
    seen = documents.select(F.col(text).cast("string")).mapInArrow(_slots, "word string, place int, slot string, n long")
    seen = materialize(seen, "slots")
    slots = seen.where("place >= 0").groupBy("word", "slot").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("place") == 1, F.col("n")).otherwise(0)).alias("later"))
    kinds = {r["slot"]: r["n"] for r in seen.where("place >= 0").groupBy("slot").agg(F.sum("n").alias("n")).collect()}  # a row for each kind of slot
    share = F.lit(1.0)
    for kind, n in kinds.items():
        share = F.when(F.col("slot") == kind, F.lit(n / sum(kinds.values()))).otherwise(share)
    words = slots.withColumn("all", F.sum("n").over(Window.partitionBy("word")))  # as many rows a word as there are kinds
    words = words.groupBy("word").agg(F.count(F.when(F.col("n") >= SLOT_SHARE * F.col("all"), 1)).alias("often"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.sum("later").alias("later"), F.max("slot").alias("slot"))
    small = seen.where("place < 0").groupBy("word").agg(F.sum("n").alias("lower"))
    listed = lexicon.where("name is not null and kind in ('given', 'family')").select(F.col("name").alias("word"), F.col("kind").alias("role")).distinct()
    words = words.join(small, "word", "left").join(listed.select("word").distinct(), "word", "left_anti")
    odd = (F.coalesce("lower", F.lit(0)) > F.col("n")) | (F.col("kinds") == 1) & (F.pow(share, F.col("n") - 1) < ONE_SLOT)
    role = F.when(F.col("often") >= SLOT_KINDS, F.when(F.col("later") * 2 > F.col("n"), "family").otherwise("given")).when(odd, "common")
    return materialize(words.select("word", role.alias("role")).where("role is not null").unionByName(listed), "names")


_BUILT: dict[str, Names] = {}


def _names(key: str, words) -> Names:
    """The names of a broadcast list of (word, role), built once a worker."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Names(*({w for w, r in words.value if r == role} for role in ROLES))
    return _BUILT[key]


def _with_own_words(documents: DataFrame, id_column: str, text: str, names: DataFrame) -> DataFrame:
    """documents (id_column, text) with ``_own``, the words of ``names`` that stand in each text, by a join on the words."""
    most = names.agg(F.max(F.regexp_count("word", F.lit("['’-]")))).first()[0] or 0

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = _flat(body)
                own = {t[a:b].lower() for a, b in _spans(t, 1 + most)}
                keys += [key] * len(own)
                out += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(out, pa.string())], ["key", "low"])

    d = materialize(documents.select(id_column, text).withColumn("_key", F.sha2(F.concat_ws("|", F.col(id_column).cast("string"), text), 256)), "texts")
    tokens = d.where(F.col(text) != "").select("_key", text).mapInArrow(words, "key string, low string")
    by_low = names.select(F.lower("word").alias("low"), "word", "role")
    own = tokens.join(by_low, "low").groupBy("key").agg(F.collect_set(F.struct("word", "role")).alias("_own"))  # the names in one text
    return d.join(own, F.col("_key") == F.col("key"), "left").select(id_column, text, "_own")


def find_candidates(documents: DataFrame, id_column: str, text: str, names: DataFrame, held: int = HELD) -> DataFrame:
    """id, kind (number in KINDS), start_pos, end_pos, votes, features and town of all candidate spans; null texts have none.

    ``names`` is what learn_names() gives. Up to ``held`` of them go to every worker; of more, each text gets those that
    stand in it.
    """
    spark = documents.sparkSession
    id_type = dict(documents.dtypes)[id_column]
    listed = _held(names, held)
    texts = documents.select(id_column, text) if listed is not None else _with_own_words(documents, id_column, text, names)
    key, words = uuid.uuid4().hex, spark.sparkContext.broadcast([tuple(r) for r in listed or []])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _names(key, words)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                where, rows = [], []
                own = part.column(2).to_pylist() if part.num_columns > 2 else [None] * len(part)
                for i, (body, more) in enumerate(zip(part.column(1).to_pylist(), own)):
                    if body:
                        found = candidates_of(body, known.beside([(x["word"], x["role"]) for x in more]) if more else known)
                        rows += found
                        where += [i] * len(found)
                cols = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(where, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.int32())), pa.array(cols[5], pa.string())],
                    ["id", "kind", "start_pos", "end_pos", "votes", "features", "town"],
                )

    return texts.mapInArrow(run, f"id {id_type}, kind int, start_pos long, end_pos long, votes string, features array<int>, town string")


def reliabilities(patterns: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """The posterior of each vote pattern by expectation maximisation, labelers being independent given the truth.

    Starts from the balance of votes. The share of true spans is estimated too. Each labeler has, for true and for false spans, probabilities of voting for and
    against. They are smoothed by a prior that a vote is more often right than wrong, worth PRIOR candidates, so that few
    candidates can't make the two classes trade places, and many can overrule it. A labeler's votes are never taken for
    their opposite, and one that doesn't vote says nothing: whether a labeler has something to say differs among true spans
    as much as between true and false ones, and two classes would settle on that.
    """
    keys = list(patterns)
    n = np.array([patterns[k] for k in keys], dtype=float)
    v = np.array([["0+-".index(c) for c in k] for k in keys])
    p = 1 / (1 + np.exp(-((v == 1).sum(1) - 2.0 * (v == 2).sum(1))))
    prior_true, prior_false = PRIOR * np.array([0.45, 0.5, 0.05]), PRIOR * np.array([0.45, 0.15, 0.4])
    for _ in range(rounds):
        true = float(n @ p) + PRIOR / 2
        log = np.full(len(keys), np.log(true) - np.log(n.sum() + PRIOR - true))  # how many of the candidates are true
        for j in range(v.shape[1]):
            yes = np.bincount(v[:, j], n * p, 3) + prior_true
            no = np.bincount(v[:, j], n * (1 - p), 3) + prior_false
            ratio = np.log(yes / yes.sum()) - np.log(no / no.sum())
            log += np.array([0.0, max(0.0, ratio[1]), min(0.0, ratio[2])])[v[:, j]]
        new = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        done = np.abs(new - p).max() < 1e-6
        p = new
        if done:
            break
    return dict(zip(keys, p.tolist()))


def fit(features: list[list[int]], labels: np.ndarray, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Logistic regression on hashed features and soft labels, by full gradients with per-weight steps (AdaGrad)."""
    flat = np.fromiter((f for row in features for f in row), dtype=np.int64)
    row = np.repeat(np.arange(len(features)), [len(r) for r in features])
    w, g2, bias = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6), 0.0
    for _ in range(rounds):
        z = np.bincount(row, w[flat], len(features)) + bias
        d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        g = np.bincount(flat, d[row], BUCKETS) / len(features) + 1e-6 * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
        bias -= 0.5 * float(d.mean())
    return w, bias


def known_towns(seen: DataFrame) -> DataFrame:
    """place, of places (place, in lower case, and n, how often each is seen), that are towns: with at least TOWN_SHARE of what
    is seen of them and of their own longer and shorter forms, which start with the same words. Other towns of the same first
    word don't count."""
    words = F.split("place", " ")
    short = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.array_join(F.slice(words, 1, k), " "))
    forms = seen.where(F.size(words) > 1).select("place", "n", F.explode(short).alias("short"))
    pairs = forms.join(seen.select(F.col("place").alias("short"), F.col("n").alias("m")), "short")
    more = pairs.select("place", F.col("m").alias("k")).unionByName(pairs.select(F.col("short").alias("place"), F.col("n").alias("k"))).groupBy("place").agg(F.sum("k").alias("k"))
    return seen.join(more, "place", "left").where(F.col("n") >= TOWN_SHARE * (F.col("n") + F.coalesce("k", F.lit(0)))).select("place")


def _towns_end(found: DataFrame, decided: DataFrame) -> DataFrame:
    """The decided spans (without ``town``) in which the open ends of addresses are set by the towns seen where an end is sure.

    Towns are joined to each of the starts that the words at an address's end have, which are at most three. They are a
    written table, which the planner broadcasts only if it is small.
    """
    first, rest = F.substring("town", 1, 1), F.expr("substring(town, 2)")
    sure = found.where(first.isin("=", "!")).groupBy(F.lower(rest).alias("place")).agg(F.count(F.lit(1)).alias("n"))
    towns = materialize(known_towns(sure), "towns")
    words = F.split(rest, " ")
    starts = [F.when(F.size(words) >= k, F.array_join(F.slice(words, 1, k), " ")) for k in (3, 2, 1)]
    open_ = decided.where(first.isin("!", "<", ">"))
    for k, start in enumerate(starts):
        open_ = open_.join(towns.select(F.col("place").alias(f"_p{k}")), F.lower(start) == F.col(f"_p{k}"), "left")
    size = F.coalesce(*[F.length(f"_p{k}") for k in range(3)])
    end = F.col("end_pos") + F.when(size.isNull(), 0).when(first == ">", size + 2).otherwise(size - F.length(rest))
    cols = [c for c in decided.columns if c != "town"]
    closed = decided.where(~F.coalesce(first.isin("!", "<", ">"), F.lit(False))).select(cols)
    return closed.unionByName(open_.withColumn("end_pos", end).select(cols))


def find_personal(documents: DataFrame, id_column: str, text: str, lexicon: DataFrame, threshold: float = 0.5, held: int = HELD) -> DataFrame:
    """id_column, kind, start_pos, end_pos of personal information; positions count code points from 0, end exclusive.

    Texts are read whole. Null and empty texts have no rows. Rows with equal ids and texts give their spans once each.
    The classifier is fitted to SAMPLE candidates of each kind, those of the smallest hashes; everything else is counted
    over all texts. ``held``: how many names every worker may hold.
    """
    learned = learn_names(documents, text, lexicon)
    found = materialize(find_candidates(documents, id_column, text, learned, held), "candidates")
    counted = found.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()  # vote patterns: a few hundred
    patterns = {k: {r["votes"]: r["n"] for r in counted if r["kind"] == k} for k in range(len(KINDS))}
    posterior = {k: reliabilities(p) for k, p in patterns.items() if p}
    # Hashes below the bar are twice as many as needed, so that sorting is left with a bounded number of rows.
    hashed, bar = F.xxhash64("id", "start_pos", "end_pos"), F.lit(None).cast("double")
    for k, p in patterns.items():
        bar = F.when(F.col("kind") == k, F.lit(min(1.0, 2.0 * SAMPLE / max(1, sum(p.values()))) * 2.0**64 - 2.0**63)).otherwise(bar)
    low = found.withColumn("_h", hashed).where(F.col("_h") <= bar)
    low = low.withColumn("_k", F.row_number().over(Window.partitionBy("kind").orderBy("_h", "id", "start_pos", "end_pos", "votes"))).where(F.col("_k") <= SAMPLE)
    rows = low.select("kind", "votes", "features").orderBy("kind", "_k").collect()  # at most SAMPLE of each kind
    models: dict[int, tuple[np.ndarray, float]] = {}
    for k in posterior:
        own = [r for r in rows if r["kind"] == k]
        if own:
            models[k] = fit([r["features"] for r in own], np.array([posterior[k][r["votes"]] for r in own]))
    weights = {k: (w.astype(np.float32), b) for k, (w, b) in models.items()}
    bar = float(np.log(threshold / (1 - threshold)))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            lists = batch.column(4)
            flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(kinds)), sizes)
            z = np.full(len(kinds), -1.0)
            for k, (w, b) in weights.items():
                mine = kinds == k
                z = np.where(mine, np.bincount(row, w[flat], len(kinds)) + b, z)
            keep = pa.array(np.flatnonzero(z > bar))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(keep), pa.array([KINDS[k] for k in kinds[keep.to_numpy()]], pa.string()), batch.column(2).take(keep), batch.column(3).take(keep), batch.column(5).take(keep)],
                ["id", "kind", "start_pos", "end_pos", "town"],
            )

    id_type = dict(documents.dtypes)[id_column]
    decided = found.select("id", "kind", "start_pos", "end_pos", "features", "town").mapInArrow(decide, f"id {id_type}, kind string, start_pos long, end_pos long, town string")
    return _towns_end(found, materialize(decided, "decided")).withColumnRenamed("id", id_column)


def replaced(documents: DataFrame, id_column: str, text: str, spans: DataFrame) -> DataFrame:
    """id_column and text with each span replaced by its kind in brackets, as [EMAIL]; ids should be unique."""
    per = spans.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "kind"))).alias("_spans"))  # the spans of one text
    id_type = dict(documents.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if own:
                    parts, at = [], 0
                    for s in own:
                        if s["start_pos"] >= at:
                            parts += [body[at : s["start_pos"]], f"[{s['kind'].upper()}]"]
                            at = s["end_pos"]
                    body = "".join([*parts, body[at:]])
                out.append(body)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [id_column, "text"])

    return documents.select(id_column, F.col(text).alias("text")).join(per, id_column, "left").select(id_column, "text", "_spans").mapInArrow(run, f"`{id_column}` {id_type}, text string")
