"""Personal information in free text: anchors are found in one pass, local parsers expand and check them.

An Aho-Corasick automaton over the lower-cased text finds at-signs, schemes, digits, street words, identifier cues, titles,
known names and introducing phrases.  Each hit starts a parser that expands it to the bounds of its own tokens, however
long these are, so a text without anchors costs one pass.  Found spans become typed placeholders; the rest of the text stays as it is.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.storage import bounded

KINDS = ("email", "phone", "id_number", "address", "person")
#: A lexicon up to this size is sent to every worker; of a larger one each record gets the names that stand in it.
MAX_NAMES = 200_000

# Words that start a parser.
SCHEMES = ("mailto:", "xmpp:", "sip:", "tel:", "sms:", "callto:", "whatsapp:")
AT_CUES = ("@", "＠", "(at)", "[at]", "{at}", " at ")
STREET_CUES = ("street", "lane", "close", "court", "road", "avenue", "drive", "boulevard", "place", "terrace", "square", "crescent", " ave", " rd", " st.", " dr.", " ln", " blvd", " way", "straße", "strasse", "weg", "platz", "allee", "gasse", "rue ", "calle ", "avenida ", "plaza ", "paseo ", "box ", "postfach ", "apartado ", "boîte postale ")
ID_CUES = ("ssn", "social security", "sozialversicherung", "sécurité sociale", "seguridad social", "national id", "national insurance", "ni number", "nino", "passport", "passeport", "pasaporte", "reisepass", "driving licen", "driver licen", "driver's licen", "drivers licen", "führerschein", "permis de conduire", "carnet de conducir", "dni", "nif", "steuer-id", "steuer-identifikations", "steuernummer", "tax id", "tax number", "taxpayer", "personalausweis", "insured person", "insurance number", "identity card", "id card", "id number")
TITLES = ("mr", "mrs", "ms", "miss", "mx", "dr", "prof", "professor", "herr", "frau", "señor", "señora", "sr", "sra", "dra", "mme", "mlle", "madame", "monsieur", "doctor")
INTRODUCTIONS = ("my name is", "i am", "i'm", "i’m", "this is", "ich heiße", "ich heisse", "ich bin", "mein name ist", "je m'appelle", "je suis", "me llamo", "mi nombre es", "soy", "signed", "signed by", "regards,", "cheers,", "sincerely,", "grüße,", "called me", "ask for", "therapist", "counsellor", "colleague", "landlord", "neighbour", "named", "care of", "attn")
#: Words that are no part of a name though they may stand capitalised beside one.
NO_NAME = frozenset("""a about after again all also although an and another any as ask at back be because been before but by call can cheers contact could dear did do does down during each either even every finally first for from fun halfway he hello her here hey hi his honestly how however i id if in incident into is it its last later long maybe me meanwhile mine mr mrs ms my never next no nobody not now of oh on once one or our out over people perhaps please post regards reply right sadly said she ship signed since sincerely small so some somehow somewhere still strangely sure thank thanks that the their them then there these they this those to towards twice two under until up was we well were what when where which while who why will with within without yesterday you your edit update order ticket chapter version day week part notes log reference ref box flat apartment street lane assistant bot der die das ein eine und ich mein meine nach im am es sie er wir nicht wie was warum unser unsere mit von zu auf für le la les un une et je mon ma mes il elle nous pourquoi dans avec pour sur el los las una y mi mis nuestro nuestra por qué con para en del al tel whatsapp heiße schreibe asked would read always""".split())
DIGIT_WORDS = ("zero", "oh", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")

_L = r"[^\W\d_]"
_NAME = rf"{_L}+(?:['’\-]{_L}+)*"
_EMAIL = re.compile(r"[\w.+%\-]+[@＠](?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,63}(?![\w])")
_DOTS = r"(?:(?:\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\s(?:dot)\s|\.)[A-Za-z][A-Za-z0-9\-]*)+"
_EMAIL_BRACKET = re.compile(rf"[\w.+%\-]+\s?(?:\(at\)|\[at\]|\{{at\}})\s?[A-Za-z0-9\-]+{_DOTS}", re.I)
_EMAIL_SPELT = re.compile(rf"[\w.+%\-]+\sat\s[A-Za-z0-9\-]+(?:\s(?:dot)\s[A-Za-z][A-Za-z0-9\-]*|\s?[(\[{{]dot[)\]}}]\s?[A-Za-z][A-Za-z0-9\-]*)+", re.I)
_PHONE = re.compile(
    r"""(?<![\w.+\-/@#$€£:=])(?:
      (?:\+|00)[1-9]\d{0,2}(?:[ .\-/]?\(?\d{1,5}\)?){2,7}
    | (?:1[ .\-])?(?:\([2-9]\d{2}\)[ ]?|[2-9]\d{2}[\-. ])[2-9]\d{2}[\-. ]\d{4}
    | 0\d{1,4}(?:[ /\-.]\d{2,9}){1,5}
    | [2-9]\d{2}[2-9]\d{6}
    | 0[1-9]\d{8,9}
    )(?![\w]|[\-.,/:]\d)""",
    re.X,
)
_PHONE_WORDS = re.compile(rf"\b(?:{'|'.join(DIGIT_WORDS)})\b(?:[\s,\-]+(?:double\s)?(?:{'|'.join(DIGIT_WORDS)})\b){{6,14}}", re.I)
_NO_PHONE = re.compile(r"(?:order|ticket|incident|build|version|checksum|reference|ref|request|token|invoice|score|case|no|nr|id|vorgang|block)\W{0,3}$", re.I)
_ID_BODY = r"(?-i:(?:[A-Za-z]{1,3}[ \-]?)?\d(?:[ \-./]?\d|[A-Z]){4,17}(?:[ \-]?[A-Z])?)(?!\w)"
_ID_AFTER = re.compile(
    rf"(?:\s?(?:numbers?|no\.?|nr\.?|num\.?|card|code|nummer|numéro|número|n[º°]\.?))?(?:\s?(?:is|was|:|=|#|ist|est|es|lautet))*\s*[:#]?\s*({_ID_BODY})", re.I
)
_NI = re.compile(r"(?<!\w)[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?!\w)", re.I)
_SSN = re.compile(r"(?<![\w\-.])\d{3}-\d{2}-\d{4}(?![\w\-])")
_DNI = re.compile(r"(?<![\w\-])\d{8}-?[A-Z](?![\w])")

_TYPE = r"(?:Street|St\.|Lane|Ln\.?|Close|Court|Road|Rd\.?|Avenue|Ave\.?|Drive|Dr\.|Boulevard|Blvd\.?|Place|Terrace|Square|Crescent|Way)"
_TOWN = rf"{_L}[\w'’\-]*(?:[ \-]{_L}[\w'’\-]*){{0,2}}"
_UNIT = r"(?:(?:Flat|Apartment|Apt\.?|Unit|Suite|Room)\s#?\w{1,5}(?:,?\s(?:at\s)?))?"
_ADDRESS = tuple(
    re.compile(p, re.I)
    for p in (
        rf"{_UNIT}\b\d{{1,5}}[A-Za-z]?,?\s(?:{_NAME}\s){{1,4}}?{_TYPE}(?:,?\s(?:Flat|Apartment|Apt\.?|Unit|Suite|#)\s?\w{{1,5}})?(?:,\s|\sin\s|\s)(?:{_L}[\w'’\-]*(?:\s{_L}[\w'’\-]*)?,?\s[A-Z]{{2}},?\s\d{{5}}(?:-\d{{4}})?\b|{_L}[\w'’\-]*,?\s[A-Z]{{1,2}}\d[A-Z\d]?\s?\d[A-Z]{{2}}\b|{_L}[\w'’\-]*)",
        rf"\b{_L}*(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer)\s\d{{1,4}}\s?[a-z]?(?:,\s|\sin\s|\s)(?:D-)?\d{{4,5}}\s{_L}[\w'’\-]*",
        rf"\b\d{{1,4}}(?:\s?(?:bis|ter))?,?\s(?:rue|avenue|boulevard|place|chemin|allée|impasse|quai)\s(?:(?:de\s(?:la\s)?|du\s|des\s|d['’]))?{_NAME}(?:[\s\-]{_NAME}){{0,2}},?\s(?:à\s)?\d{{5}}\s{_L}[\w'’\-]*",
        rf"\b(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino)\s(?:de\s(?:la\s|los\s|las\s)?|del\s)?{_NAME}(?:\s{_NAME}){{0,2}},?\s\d{{1,4}}(?:,\s?\d{{1,2}}\s?[º°ª.]?\s?[A-Z]?(?:izq|dcha)?)?,?\s(?:en\s)?\d{{5}}\s{_L}[\w'’\-]*",
        rf"\b(?:P\.?\s?O\.?\s?Box|Postfach|Apartado(?:\sde\s[Cc]orreos)?|Bo[îi]te\s[Pp]ostale|B\.?P\.?|Box)\s\d{{1,6}}(?:,\s|\sin\s|\s)(?:(?:D-)?\d{{4,5}}\s)?{_L}[\w'’\-]*",
    )
)
_PLACE_CHECK = re.compile(rf"(?:\d{{4,5}}|,|\bin)\s(?:\d{{4,5}}\s)?{_L}", re.I)

_CASED = rf"[^\W\d_a-zà-öø-ÿ]{_L}*(?:['’\-]{_L}+)*"
_INITIAL = rf"(?:{_L}\.\s?){{0,2}}"
_FULL = re.compile(rf"({_NAME})\s({_INITIAL})({_NAME})")
_TURNED = re.compile(rf"({_NAME}),\s({_NAME})(?:\s({_L})\.)?")
_AFTER_TITLE = re.compile(rf"\.?\s({_INITIAL})({_CASED})(?:\s{_INITIAL}({_CASED}))?")
_LETTERS = re.compile(rf"{_L}*")
_WORD = re.compile(_NAME)
_BLANKS = re.compile(r"\s+")
_TEL = re.compile(r"(?:\+|%2B)?[\d(](?:[\d().\- ]|%20)*\d", re.I)
_MAIL = re.compile(r"[\w.+%\-]+(?:[@＠]|%40)(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,63}(?!\w)", re.I)


def _local_start(text: str, p: int) -> int:
    """Where the local part that ends before ``p`` begins."""
    while p and (text[p - 1].isalnum() or text[p - 1] in "_.+%-"):
        p -= 1
    return p


def _name_before(text: str, p: int) -> tuple[int, str, bool] | None:
    """Start, name and whether a comma follows, of the name before ``p``, initials between left aside."""
    for _ in range(2):
        q = p - 1 if p and text[p - 1].isspace() else p
        if q < 2 or text[q - 1] != "." or not text[q - 2].isalpha() or (q > 2 and text[q - 3].isalnum()):
            break
        p = q - 2
    if not p or not text[p - 1].isspace():
        return None
    end = p - 1
    comma = end > 0 and text[end - 1] == ","
    end -= comma
    start = end
    while start and (text[start - 1].isalpha() or (text[start - 1] in "'’-" and start < end and start > 1 and text[start - 2].isalpha())):
        start -= 1
    return (start, text[start:end], comma) if start < end else None



class Finder:
    """Spans of personal information in one text; ``names``: pairs of name and kind (given or family)."""

    def __init__(self, names: Iterable[tuple[str, str]] = ()):
        names = list(names)
        self.given = {n.lower() for n, k in names if n and k == "given"}
        self.family = {n.lower() for n, k in names if n and k == "family"}
        a = ahocorasick.Automaton()
        words: dict[str, set[str]] = {}
        for d in "0123456789":
            words.setdefault(d, set()).add("digit")
        for group, kind in ((AT_CUES, "at"), (SCHEMES[:3], "mail scheme"), (SCHEMES[3:], "number scheme"), (STREET_CUES, "street"), (ID_CUES, "id"), (INTRODUCTIONS, "intro"), (self.given, "name"), (self.family, "name")):
            for w in group:
                words.setdefault(w, set()).add(kind)
        for t in TITLES:
            for end in (" ", ". "):
                words.setdefault(t + end, set()).add("title")
        for x in DIGIT_WORDS:
            for y in DIGIT_WORDS:
                words.setdefault(f"{x} {y}", set()).add("spoken")
        for w, kinds in words.items():
            a.add_word(w, (len(w), tuple(kinds)))
        a.make_automaton()
        self.automaton = a

    # -- parsers: each reads the surroundings of its anchor only

    def _emails(self, text: str, at: list[int]) -> Iterator[tuple[int, int, str]]:
        for p in at:
            pattern, end = (_EMAIL, p) if text[p] in "@＠" else (_EMAIL_BRACKET, p - (p > 0 and text[p - 1].isspace())) if text[p] in "([{" else (_EMAIL_SPELT, p - 1)
            m = pattern.match(text, _local_start(text, end))
            if m and m.end() > p:
                local = m.group(0).lstrip(".-")
                yield m.end() - len(local), m.end(), "email"

    def _schemes(self, text: str, ends: list[tuple[int, str]]) -> Iterator[tuple[int, int, str]]:
        """Addresses and numbers that a scheme announces."""
        for end, kind in ends:
            m = (_MAIL if kind == "email" else _TEL).match(text, end)
            if m and (kind == "email" or 5 <= sum(c.isdigit() for c in m.group(0).replace("%2B", "").replace("%20", "")) <= 15):
                yield end, m.end(), kind

    def _phones(self, text: str, digits: list[int]) -> Iterator[tuple[int, int, str]]:
        i = 0
        while i < len(digits):
            j = i
            while j + 1 < len(digits) and digits[j + 1] - digits[j] <= 4:  # a number has up to three marks between digits
                j += 1
            if j - i + 1 >= 8:
                # one character before the number's bracket or plus, and two after it, decide whether it stands alone
                start = max(0, digits[i] - 3)
                for m in _PHONE.finditer(text[start : digits[j] + 4]):
                    n, at = sum(c.isdigit() for c in m.group(0)), start + m.start()
                    if 8 <= n <= 15 and not _NO_PHONE.search(text[max(0, at - 12) : at]):  # the longest word and three marks
                        yield at, start + m.end(), "phone"
            i = j + 1

    def _ids(self, text: str, cues: list[tuple[int, int]], digits: list[int]) -> Iterator[tuple[int, int, str]]:
        for p, end in cues:
            if (p and (text[p - 1].isalnum() or text[p - 1] == "_")) or (end < len(text) and text[end].isalnum() and text[end - 1].isalnum() and text[p:end].lower() in ("ssn", "dni", "nif", "nino")):
                continue
            m = _ID_AFTER.match(text, _LETTERS.match(text, end).end())
            if m and sum(c.isdigit() for c in m.group(1)) >= 6:
                yield m.start(1), m.end(1), "id_number"
        if len(digits) >= 6:
            for pattern in (_SSN, _NI, _DNI):
                for m in pattern.finditer(text, max(0, digits[0] - 4), min(len(text), digits[-1] + 6)):
                    yield m.start(), m.end(), "id_number"

    def _addresses(self, text: str, cues: list[int]) -> Iterator[tuple[int, int, str]]:
        done = -1
        tokens = [m.span() for m in re.finditer(r"\S+", text)]
        starts = [a for a, _ in tokens]
        for p in cues:
            if p < done:
                continue
            # no pattern has more than 9 blanks before its cue or 12 after it
            k = bisect_right(starts, p) - 1
            low, high = starts[max(0, k - 9)], tokens[min(len(tokens) - 1, k + 13)][1]
            near = text[low:high]
            for pattern in _ADDRESS:
                for m in pattern.finditer(near):
                    if low + m.start() <= p + 2 and p - 2 < low + m.end() and _PLACE_CHECK.search(m.group(0)) and self._placed(m.group(0)):
                        done = low + m.end()
                        yield low + m.start(), done, "address"
                        break
                if done > p:
                    break

    @staticmethod
    def _placed(s: str) -> bool:
        """A post code, or a town that is written as a name."""
        return bool(re.search(r"\b\d{4,5}\b|[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}$", s)) or s.split()[-1][0].isupper()

    def _ordinary(self, word: str) -> bool:
        return word.lower() in NO_NAME or len(word) < 2

    def _is_pair(self, first: str, last: str, introduced: bool) -> bool:
        f, l = first.lower(), last.lower()
        if l in self.family and f in self.given:
            return True
        if self._ordinary(first) or self._ordinary(last):
            return False
        shouted = first.isupper() and last.isupper()
        cased = first[0].isupper() and last[0].isupper()
        if f in self.given:
            return (l in self.family) or (cased and (shouted or not last.isupper()) and len(last) >= 3) or (introduced and len(last) >= 3)
        if l in self.family:
            return cased or introduced
        return introduced and cased and len(first) >= 3 and len(last) >= 3

    def _people(self, text: str, names: list[tuple[int, int]], intros: list[int], titles: list[int]) -> Iterator[tuple[int, int, str]]:
        word = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
        starts = {p: False for p, _ in names if not word(p - 1)}
        for end in intros:
            m = _BLANKS.match(text, end)
            if m:
                starts[m.end()] = True
        for p, introduced in starts.items():
            m = _FULL.match(text, p)
            if m and self._is_pair(m.group(1), m.group(3), introduced):
                yield p, m.end(), "person"
                continue
            m = _TURNED.match(text, p)
            if m and self._is_turned(m.group(1), m.group(2), introduced):
                yield p, m.end(2), "person"
                continue
            if introduced:
                continue
            # a known name may be the second part
            b, n = _name_before(text, p), _WORD.match(text, p)
            if b and n and (self._is_turned(b[1], n.group(0), False) if b[2] else self._is_pair(b[1], n.group(0), False)):
                yield b[0], n.end(), "person"
        for end in titles:
            base = end - 1 if text[end - 1] == " " else end
            m = _AFTER_TITLE.match(text, base)
            if m and not self._ordinary(m.group(2)):
                last = 3 if m.group(3) and not self._ordinary(m.group(3)) and (m.group(2).lower() in self.given or m.group(3).lower() in self.family) else 2
                if m.group(2).lower() in self.given and last == 2:
                    continue
                yield base + 1, m.end(last), "person"

    def _is_turned(self, last: str, first: str, introduced: bool) -> bool:
        f, l = first.lower(), last.lower()
        if l in self.family:
            return f in self.given or (not self._ordinary(first) and (introduced or first[0].isupper()) and len(first) >= 3 and (introduced or last[0].isupper()))
        if f in self.given:
            return not self._ordinary(last) and len(last) >= 4 and ((last[0].isupper() and first[0].isupper()) or introduced)
        return introduced and last[0].isupper() and first[0].isupper() and not self._ordinary(last) and not self._ordinary(first) and min(len(last), len(first)) >= 3

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """start, end and kind, in order and without overlap; empty for null, empty and blank texts."""
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        at, digits, streets, spoken, intros, titles = [], [], [], [], [], []
        cues: list[tuple[int, int]] = []
        names: list[tuple[int, int]] = []
        schemes: list[tuple[int, str]] = []
        for last, (size, kinds) in self.automaton.iter(low):
            p = last - size + 1
            for kind in kinds:
                if kind == "digit":
                    digits.append(p)
                elif kind == "at":
                    at.append(p + (low[p] == " "))
                elif kind.endswith("scheme"):
                    if not p or not low[p - 1].isalnum():
                        schemes.append((last + 1, "email" if kind[0] == "m" else "phone"))
                elif kind == "street":
                    streets.append(p)
                elif kind == "id":
                    cues.append((p, last + 1))
                elif kind == "name":
                    names.append((p, last + 1))
                elif not p or not (low[p - 1].isalnum()):
                    if kind == "intro":
                        intros.append(last + 1)
                    elif kind == "title":
                        titles.append(last + 1)
                    else:
                        spoken.append(p)
        found: list[tuple[int, int, str]] = []
        if schemes:
            found += self._schemes(text, schemes)
        if at:
            found += self._emails(text, at)
        if streets and digits:
            found += self._addresses(text, streets)
        if cues or len(digits) >= 6:
            found += self._ids(text, cues, digits)
        if len(digits) >= 8:
            found += self._phones(text, digits)
        if spoken:
            found += [(m.start(), m.end(), "phone") for m in _PHONE_WORDS.finditer(text, spoken[0])]
        if names or intros or titles:
            found += self._people(text, names, intros, titles)
        # first the surest kind, then the longest span
        rank = {k: i for i, k in enumerate(("email", "id_number", "address", "phone", "person"))}
        kept: list[tuple[int, int, str]] = []
        for s in sorted(found, key=lambda s: (rank[s[2]], s[0] - s[1])):
            if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
                kept.append(s)
        return sorted(kept)

    def redact(self, text: str | None) -> str | None:
        """The text with ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` and ``[PERSON]`` in place of the spans."""
        if text is None:
            return None
        out, at = [], 0
        for start, end, kind in self.spans(text):
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
        return "".join([*out, text[at:]])


def read_names(lexicon: DataFrame) -> list[tuple[str, str]]:
    """The lexicon's names as a list; refused above ``MAX_NAMES`` rows, for which the lexicon itself is to be given."""
    rows, fits = bounded(lexicon.where(F.col("name").isNotNull()).select("name", "name_kind").distinct(), MAX_NAMES)
    if not fits:
        raise ValueError(f"the name lexicon has more than {MAX_NAMES} rows")
    return [(r["name"], r["name_kind"]) for r in rows]


def with_names(df: DataFrame, lexicon: DataFrame | list[tuple[str, str]], *, text: str, id_col: str, most: int = MAX_NAMES) -> tuple[DataFrame, list[tuple[str, str]] | None]:
    """id, text and names of each record, and the whole lexicon if it has at most ``most`` names.

    A larger lexicon isn't sent to the workers: its names are joined to the words of the records, and ``names`` then has
    those that stand in the record, which is all that its parsers ask for.  Otherwise ``names`` is null.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    whole = rows.withColumn("names", F.lit(None).cast("array<struct<name:string,name_kind:string>>"))
    if not isinstance(lexicon, DataFrame):
        return whole, [(n, k) for n, k in lexicon if n]
    known = lexicon.where(F.col("name").isNotNull()).select("name", "name_kind").distinct()
    found, fits = bounded(known, most)
    if fits:
        return whole, [(r["name"], r["name_kind"]) for r in found]
    words = rows.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+(?:['’\-][\p{L}]+)*"), F.lit(0)))).alias("word"))
    held = words.join(known.withColumn("word", F.lower("name")), "word").groupBy("id").agg(F.collect_set(F.struct("name", "name_kind")).alias("names"))
    return rows.join(held, "id", "left"), None


def _each(names: list[tuple[str, str]] | None):
    """The finder of a record: one for all, or one for its own names."""
    whole = Finder(names or ())

    def of(own) -> Finder:
        return whole if own is None or not len(own) else Finder((x["name"], x["name_kind"]) for x in own)

    return of


def find_kinds(df: DataFrame, lexicon: DataFrame | list[tuple[str, str]], *, text: str, id_col: str = "row_id", most: int = MAX_NAMES) -> DataFrame:
    """id_col, kind: one row for each record and kind of personal information in its text; null texts give none.

    ``lexicon`` has name and name_kind (given or family), null names left out, or is a list of such pairs; with an empty one only introduced and
    titled names are found.  ``id_col`` must be unique where the lexicon has more than ``most`` names.
    """
    rows, names = with_names(df, lexicon, text=text, id_col=id_col, most=most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = _each(names)
        for pdf in batches:
            ids, kinds = [], []
            for i, t, own in zip(pdf["id"], pdf["text"], pdf["names"]):
                if t:
                    for kind in {s[2] for s in finder(own).spans(t)}:
                        ids.append(i)
                        kinds.append(kind)
            yield pd.DataFrame({id_col: ids, "kind": kinds}).astype({id_col: "int64", "kind": "object"})

    return rows.mapInPandas(run, f"`{id_col}` long, kind string")


def redact(df: DataFrame, lexicon: DataFrame | list[tuple[str, str]], *, text: str, id_col: str = "row_id", out: str = "redacted", most: int = MAX_NAMES) -> DataFrame:
    """id_col, out: every record's text with placeholders; null stays null, empty stays empty. ``lexicon`` as in ``find_kinds``."""
    rows, names = with_names(df, lexicon, text=text, id_col=id_col, most=most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = _each(names)
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf["id"], out: [finder(own).redact(t) for t, own in zip(pdf["text"], pdf["names"])]})

    return rows.mapInPandas(run, f"`{id_col}` long, `{out}` string")
