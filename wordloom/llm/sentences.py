"""Sentence units in any script, by a pushdown automaton over quotation marks, brackets, list levels and final marks.

Openers are pushed if their closer stands in the same paragraph; marks end a unit only on an empty stack.  A closer takes
with it what was opened after its own opener, so crossed pairs don't stick.  Numbers that begin a unit are held against
a second stack, of list levels: the next number of an open level, or a first one, is an item's mark.  Dots are weighed by the token
before them (tries of abbreviations, initials, numbers, file names) and by the word after them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pairs of quotation marks and brackets.
PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "（": "）", "【": "】", "‘": "’", "»": "«", "‚": "‘’"}
# Abbreviations (without their last dot) that never end a unit.
OPEN_ABBREVIATIONS = frozenset("""mr mrs ms mx dr prof st rev hon gen col capt lt sgt gov mme mlle mgr m mm hr hrn fr frl herr sr sra srta dra d dña ing lic arq
    no nr num núm n nos fig figs vol vols ch chap sec sect art eq p pp pg pág págs pag s bd kap abb z zz cf vgl vs v approx ca circa c e.g i.e eg ie viz incl excl
    bzw d.h z.b u.a o.ä sog ggf evtl p.ex p.ej ej ex av bd. tel стр рис т.е т ул им г гл см напр проф д-р डॉ श्री د أ""".split())  # fmt: skip
# Abbreviations, times and company forms that may end a unit before a capital letter.
CLOSE_ABBREVIATIONS = frozenset("""inc ltd co corp llc plc gmbh jr bros etc usw ff al a.m p.m am pm u.k u.s u.s.a e.u d.c ph.d b.a m.a и.т.д т.д т.п д п др пр руб тыс b.c a.d u.n""".split())
# Words that often begin a sentence, for texts written in lower case.
OPENERS = frozenset("""the i it its if my our in on at as after again then that this these he she they we you why what when how to by for from not so yesterday last long small fun people strangely sadly honestly somehow somewhere out over once one all twice towards without during before between halfway within an a another each most some""".split())
# Abbreviations that are also words and count only before a number.
NUMBER_ABBREVIATIONS = frozenset("no art fig figs ch eq abb n nos sec vol".split())
MONTHS_DE = frozenset("januar februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep sept okt nov dez".split())



class Trie:
    """Words by their letters from the last to the first, so that a lookup walks back from the mark that ends them."""

    def __init__(self, words: frozenset[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in reversed(w):
                node = node.setdefault(c, {})
            node[""] = w

    def __contains__(self, word: str) -> bool:
        node = self.root
        for c in reversed(word):
            node = node.get(c)
            if node is None:
                return False
        return "" in node


OPEN, CLOSE, BEFORE_NUMBER = Trie(OPEN_ABBREVIATIONS), Trie(CLOSE_ABBREVIATIONS), Trie(NUMBER_ABBREVIATIONS)

_EVENT = re.compile(r"\n[^\S\n]*(?=\n)|[.!?…。！？।॥؟۔｡．]+|[()\[\]{}“”„«»‹›「」『』《》〈〉（）【】‘’‚\"']|(?<=[ก-๎]) +(?=[ก-๎])")
_CLOSERS = frozenset(")]}”’»›」』》〉）】")
_MARKS = frozenset(".!?…。！？।॥؟۔｡．")
_BOUND = frozenset("()[]{}“”„«»‹›\"‘,;:¿¡")
_NEXT = re.compile(r"\s*([^\W_]+)?")
_SPACE = re.compile(r"\s*")
_URL = re.compile(r"://|www\.|[\w\-]\.[a-z]{2,}(?:/|$)|/", re.I)
_BREAK = re.compile(r"\n[^\S\n]*\n")
_BREAK_NEXT = re.compile(r"[ \t\r]*\n[^\S\n]*\n")


def _lower_style(text: str) -> bool:
    """Whether every sentence of the text begins in lower case."""
    lower = upper = 0
    for before, start in re.findall(r"([^\W\d_]{3,})[.?][\"”»]*\s+([^\W\d_]+)", text):
        if before.lower() in OPEN or before.lower() in CLOSE or start == "I":
            continue
        if start[0].islower():
            lower += 1
        elif start[0].isupper():
            upper += 1
    if lower + upper == 0:
        return next((c for c in text if c.isalpha()), "").islower()
    return lower > upper


def unit_ends(text: str | None) -> list[int]:
    """Code points up to the end of each unit; none for null, empty and blank texts."""
    if not text or not text.strip():
        return []
    lower = _lower_style(text)
    ends: list[int] = []
    begin, n = 0, len(text)  # begin: where the open unit may start
    stack: list[str] = []
    levels: list[int] = []  # the last number of each open list
    limit, skip = -1, -1
    token_start, token_seen = 0, 0  # the token that holds token_seen - 1 begins at token_start

    def close(at: int) -> None:
        nonlocal begin
        while at > begin and text[at - 1].isspace():
            at -= 1
        if at > begin and text[begin:at].strip():
            ends.append(at)
            begin = at

    def token_at(s: int) -> int:
        """Where the token that ends before ``s`` begins; no letter is walked over twice."""
        nonlocal token_start, token_seen
        i = s
        while i > token_seen and not (text[i - 1].isspace() or text[i - 1] in _BOUND):
            i -= 1
        token_start, token_seen = (token_start if i == token_seen else i), s
        return token_start

    def is_item(start: int, s: int) -> bool:
        """Whether the number text[start:s] begins the open unit and counts on in a list, or begins one."""
        if not s - start <= 3 or not text[start:s].isdecimal() or text[begin:start].strip():
            return False
        n = int(text[start:s])
        while levels and levels[-1] + 1 != n and n != 1 and n - 1 in levels:
            levels.pop()
        if levels and levels[-1] + 1 == n:
            levels[-1] = n
        elif n == 1:
            levels.append(n)
        else:
            return False
        return True

    def paragraph_end(at: int) -> int:
        nonlocal limit
        if at >= limit:
            m = _BREAK.search(text, at)
            limit = m.start() if m else n
        return limit

    for e in _EVENT.finditer(text):
        s, t = e.span()
        if s < skip:
            continue
        c = text[s]
        if c == "\n":
            close(s)
            stack.clear()
        elif c == " ":
            if not stack:
                close(s)
        elif c in _MARKS:
            start = token_at(s)
            if not stack and not (text[s:t] == "." and t < n and text[t].isspace() and is_item(start, s)) and _ends(text, s, t, lower, start):
                while t < n and (text[t] in _CLOSERS or (text[t] in "\"'" and (t + 1 == n or not text[t + 1].isalnum()))):
                    t += 1
                skip = t
                close(t)
        elif c in "\"'":
            before, after = text[s - 1] if s else " ", text[t] if t < n else " "
            if c == "'" and before.isalnum() and after.isalnum():
                continue
            if stack and stack[-1] == c and not before.isspace():
                stack.pop()
            elif not before.isalnum() and not after.isspace() and c not in stack:
                m = text.find(c, t, paragraph_end(t))
                while c == "'" and m > 0 and m + 1 < n and text[m - 1].isalnum() and text[m + 1].isalnum():
                    m = text.find(c, m + 1, paragraph_end(t))
                if m > 0:
                    stack.append(c)
        elif c == "’" and s and t < n and text[s - 1].isalnum() and text[t].isalnum():
            continue  # an apostrophe
        elif stack and c in stack[-1]:
            stack.pop()
        elif c in _CLOSERS and any(c in x for x in stack):
            while c not in stack.pop():
                pass
        elif c in PAIRS:
            if c == "‘" and s and text[s - 1].isalnum():
                continue
            stop = paragraph_end(t)
            if any(text.find(x, t, stop) > 0 for x in PAIRS[c]):
                stack.append(PAIRS[c])
    close(n)
    return ends


def _ends(text: str, s: int, t: int, lower: bool, start: int) -> bool:
    """Whether the marks text[s:t], outside quotations and brackets and after the token text[start:s], end a unit."""
    marks, n = text[s:t], len(text)
    token = text[start:s]
    attached = t < n and (text[t].isalnum() or text[t] in "/_@")
    dots = set(marks) <= set(".…．")
    if not dots:
        if attached and text[t].isascii() and token and token[-1].isascii() and _URL.search(token) and "?" in marks:
            return False
        return True
    m = _NEXT.match(text, t)
    word = m.group(1) or ""
    after = _SPACE.match(text, t).end()
    gap = text[t : m.start(1)] if word else text[t : t + 3]
    if after == n or _BREAK_NEXT.match(text, t):
        return True
    if not attached and text[after] in _MARKS:
        return False
    goes_on = word[:1].islower()
    if len(marks) > 1 or marks == "…":
        if lower and goes_on:
            filler = token.isalnum() and text[begin_of_blanks(text, start) - 1 : begin_of_blanks(text, start)] == ","
            return not attached and not filler
        return not goes_on
    if attached:
        if text[t].isdigit() or not (text[t].isupper() or not text[t].isascii() and not goes_on):
            return False
        return len(token) > 1 and token.isalpha() and token.lower() not in OPEN and not token.isupper()
    bare = token.strip(".").lower()
    if bare.isdigit():
        line = begin_of_blanks(text, start)
        if (line == 0 or text[line - 1] == "\n" or "\n" in text[line:start]) and len(token) <= 3 and "\n" not in gap:
            return False
        if word.lower() in MONTHS_DE and len(bare) <= 2:
            return False
        return not goes_on or lower
    last = bare.rpartition(".")[2] or bare
    if len(bare) == 1 and bare.isalpha():
        previous = re.search(r"(\w)\.\s?$", text[max(0, s - 4) : s - 1])
        both = f"{previous.group(1).lower()}.{bare}" if previous else bare
        if both in CLOSE and "." in both:
            return bool(word) and not goes_on and not word[0].isdigit()
        return False
    if bare in CLOSE:
        if lower:
            return word in OPENERS
        return not goes_on
    if bare in BEFORE_NUMBER and not word[:1].isdigit():
        return lower or not goes_on
    if bare in OPEN or last in OPEN and "." in bare and last != bare:
        return False
    if re.fullmatch(r"(?:\w\.)+\w", bare) and not any(ch.isdigit() for ch in bare):
        return not goes_on and not lower
    return lower or not goes_on


def begin_of_blanks(text: str, at: int) -> int:
    """Where the white space before ``at`` begins."""
    while at and text[at - 1].isspace():
        at -= 1
    return at


def split_sentences(df: DataFrame, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, unit, end_char, sentence: one row for each unit, numbered from 0; null, empty and blank texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for low in range(0, len(pdf), 1000):
                part = pdf.iloc[low : low + 1000]
                ids, units, ends, out = [], [], [], []
                for i, t in zip(part["id"], part["text"]):
                    at = 0
                    for k, end in enumerate(unit_ends(t)):
                        ids.append(i)
                        units.append(k)
                        ends.append(end)
                        out.append(t[at:end].strip())
                        at = end
                yield pd.DataFrame({id_col: ids, "unit": units, "end_char": ends, "sentence": out}).astype({id_col: "int64", "unit": "int64", "end_char": "int64", "sentence": "object"})

    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInPandas(run, f"`{id_col}` long, unit long, end_char long, sentence string")
