"""HTML, Markdown, wiki and LaTeX residue: which languages a text holds, and clean text that keeps its structure.

Headings become ``# ``, list items ``- ``, code stays fenced or ticked and formulas stay as they are.  The named method
(differencing pages of one host by URL) can't give this: the records have no URLs, and what they repeat isn't their markup.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("html", "markdown", "wiki", "latex")
# Element names that make a tag.
TAGS = "a abbr address article aside audio b base blockquote body br button caption center cite code col colgroup dd del details div dl dt em embed figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav noscript object ol option p param picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video".split()

_ANY = re.compile(r"[<&#*_~`\[\]{}|\\$=>']|^\s{0,8}(?:[-+•]|\d{1,3}[.)])\s|-{3}", re.M)
_TAG = rf"</?(?:{'|'.join(TAGS)})(?:\s[^<>\n]*|/)?>|</(?:{'|'.join(TAGS)})(?=\s|$)"
_HTML = re.compile(rf"{_TAG}|<!--|<!DOCTYPE|&(?:[A-Za-z][A-Za-z0-9]{{1,24}}|#\d{{1,7}}|#[xX][0-9A-Fa-f]{{1,6}});", re.I | re.M)
_FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n.*?(?:^[ \t]*\1[ \t]*$|\Z)", re.M | re.S)
_WIKI_TABLE = re.compile(r"^\{\|.*?(?:^\|\}|\Z)", re.M | re.S)
_WIKI = re.compile(
    r"^\{\||^={2,6}[^=\n][^\n]*?[^=\n]?={2,6}[ \t\r]*$|^==+ ?[^=\n]+ ?==+|\[\[[^\[\]\n]+\]\]|(?<!')'{2,5}(?!')[^'\n]+?(?:'[^'\n]+?)*'{2,5}(?!')|\{\{[^{}|\n]+\|[^{}]*\}\}|(?<!\])\[(?:https?:)?//\S+ [^\]\n]+\]", re.M
)
_LATEX = re.compile(
    r"\\(?:begin|end)\s?\{|(?<![\w\\:])\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{|(?<![\w\\:])\\item\b|\\\([^\n]+?\\\)|\\\[[^\n]*?[=^_+\\{}][^\n]*?\\\]|\$\$[^$]+\$\$|(?<![\\\w$])\$(?![\s\d{])[^$\n]*[\\^_={}][^$\n]*\$(?!\w)|(?<![\w\\:])\\(?:alpha|beta|gamma|delta|lambda|mu|pi|sigma|theta|omega|sum|int|prod|cdot|times|leq|geq|neq|infty|to|LaTeX|TeX|maketitle|tableofcontents|noindent|newline|hline)\b"
)
_MARKDOWN = re.compile(
    r"""^[ \t]{0,3}\#{1,6}[ \t]+\S | ^[^\n|<>=\-\s][^\n]*\n[ \t]{0,3}(?:={3,}|-{3,})[ \t\r]*$ | ^[ \t]{0,3}(?:```|~~~)
      | (?<![\w*\\])(\*{1,3})(?=[^\s*])(?:[^*\n]|(?<=\w)\*(?=\w))*?[^\s*\\]\1(?![\w*]) | (?<![\w_\\])(_{1,3})(?=[^\s_])[^\n]*?[^\s_]\2(?![\w_])
      | ~~(?=\S)[^~\n]+~~ | !?\[[^\[\]\n]*\]\((?:https?:|/|\#|mailto:|www\.|\.)[^()\s]*(?:\s"[^"\n]*")?\) | !\[[^\[\]\n]*\]\([^()\n]+\)
      | ^[ \t]{0,8}[-+*•][ \t]+\S | ^[ \t]{0,8}1[.)][ \t]+\S[^\n]*\n+[ \t]{0,8}2[.)][ \t] | ^[ \t]{0,8}\d{1,3}[.)][ \t]+\S[^\n]*\n[ \t]{0,8}\d{1,3}[.)][ \t]
      | ^[ \t]{0,3}>+[ \t]*\S | ^\|?[ \t]*:?-{3,}:?[ \t]*\|[ \t:|\-]*$ | ^\|[^\n|]+\|[^\n]*\|[ \t\r]*$ | (?<![`\w])`[^`\n]+`(?!`)
    """,
    re.M | re.X,
)


def markup_of(text: str | None) -> list[str]:
    """The markup languages of which the text holds a construct; none for null and empty texts."""
    if not text or not _ANY.search(text):
        return []
    found = []
    plain = text.replace("\r\n", "\n")
    if _HTML.search(plain):
        found.append("html")
    fenced = _FENCE.sub("\n", plain)
    if fenced != plain or _MARKDOWN.search(_LATEX_SPAN.sub(" ", _WIKI_TABLE.sub("\n", _HTML.sub(" ", fenced)))):
        found.append("markdown")
    if _WIKI.search(fenced):
        found.append("wiki")
    if _LATEX.search(fenced):
        found.append("latex")
    return found


_LATEX_SPAN = re.compile(r"\$\$[^$]+\$\$|\\\(.+?\\\)|\\\[.*?\\\]|(?<![\\\w$])\$(?![\s\d{])[^$\n]*[\\^_={}][^$\n]*\$")
_KEEP = re.compile(r"^[ \t]*```[^\n]*\n.*?^[ \t]*```[ \t]*$|`[^`\n]+`|\$\$[^$]+\$\$|\\\(.+?\\\)|\\\[.*?\\\]|(?<![\\\w$])\$(?![\s\d{])[^$\n]*[\\^_={}][^$\n]*\$", re.M | re.S)
_STEPS: tuple[tuple[re.Pattern, str], ...] = tuple(
    (re.compile(p, re.I | re.M | re.S), r)
    for p, r in (
        (r"<!--.*?(?:-->|\Z)", ""),
        (r"<(script|style)\b.*?</\1>", ""),
        (r"<h([1-6])\b[^>]*>(.*?)</h\1>", r"\n# \2\n"),
        (r"<li\b[^>]*>", "\n- "),
        (r"</t[dh]>\s*<t[dh]\b[^>]*>", " | "),
        (r"<br\s*/?>|</?(?:p|div|ul|ol|table|tr|blockquote|section|article|center|hr|pre|title|body|head|html)\b[^>]*>", "\n"),
        (r"<img\b[^>]*?\balt=(['\"])(.*?)\1[^>]*>", r"\2"),
        (_TAG, ""),
        (r"\[\[(?:Category|File|Image):[^\[\]\n]*\]\]", ""),
        (r"\{\{[^{}|\n]+\|[^{}]*\}\}", ""),
        (r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]+)\]\]", r"\1"),
        (r"\[(?:https?:)?//\S+ ([^\]\n]+)\]", r"\1"),
        (r"^={2,6} *([^=\n]+?) *={2,6}", r"# \1\n"),
        (r"^\{\|[^\n]*\n?|^\|[\-}][^\n]*\n?", ""),
        (r"^\| ?(.*?) ?\|\| ?(.*)$", r"\1 | \2"),
        (r"'{2,5}([^'\n]+)'{2,5}", r"\1"),
        (r"\\(?:sub)*section\*?\{([^{}]*)\}", r"# \1\n"),
        (r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\])?", ""),
        (r"\\item\b(?:\[[^\]\n]*\])? ?", "- "),
        (r"\\(?:cite|label|ref|footnote)[a-z]*\{[^{}]*\}", ""),
        (r"\\[a-z]{2,}\*?\{([^{}]*)\}", r"\1"),
        (r"^([^\n#>\-|][^\n]*)\n[ \t]{0,3}(?:={3,}|-{3,})[ \t]*$", r"# \1"),
        (r"^[ \t]{0,3}#{1,6}[ \t]+", "# "),
        (r"!?\[([^\[\]\n]*)\]\((?:[^()\s]*)(?:\s\"[^\"\n]*\")?\)", r"\1"),
        (r"~~([^~\n]+)~~", r"\1"),
        (r"(?<![\w*])(\*{1,3})(?=[^\s*])([^*\n]*?[^\s*])\1(?![\w*])", r"\2"),
        (r"(?<![\w_])(_{1,3})(?=[^\s_])([^\n]*?[^\s_])\1(?![\w_])", r"\2"),
        (r"^\|?[ \t]*:?-{3,}:?[ \t]*\|[ \t:|\-]*\n?", ""),
        (r"^\|[ \t]*(.*?)[ \t]*\|[ \t]*$", r"\1"),
        (r"^[ \t]{0,8}[*+•][ \t]+", "- "),
        (r"[ \t]+$", ""),
        (r"\n{3,}", "\n\n"),
    )
)


def clean(text: str | None) -> str | None:
    """Text without markup but with headings, lists, code and formulas; null stays null, unmarked text stays as it is."""
    if text is None or not markup_of(text):
        return text
    text = re.sub(r"<pre\b[^>]*>\s*(?:<code\b[^>]*>)?(.*?)(?:</code>)?\s*</pre>", lambda m: f"\n```\n{html.unescape(m.group(1))}\n```\n", text.replace("\r\n", "\n"), flags=re.S | re.I)
    text = re.sub(r"<code\b[^>]*>(.*?)</code>", r"`\1`", text, flags=re.S | re.I)
    kept: list[str] = []

    def hold(m: re.Match) -> str:
        kept.append(m.group(0))
        return f"\ue000{len(kept) - 1}\ue001"

    text = _KEEP.sub(hold, text)
    for pattern, new in _STEPS:
        text = pattern.sub(new, text)
    text = html.unescape(text).replace("\xa0", " ")
    return re.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m.group(1))] if int(m.group(1)) < len(kept) else m.group(0), text).strip()


def _map(df: DataFrame, text: str, id_col: str, schema: str, f) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield f(pdf)

    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInPandas(run, schema)


def find_markup(df: DataFrame, *, text: str, id_col: str = "row_id") -> DataFrame:
    """id_col, markup: one row for each record and markup language in its text."""

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = [(i, x) for i, t in zip(pdf["id"], pdf["text"]) for x in markup_of(t)]
        return pd.DataFrame(pairs, columns=[id_col, "markup"]).astype({id_col: "int64", "markup": "object"})

    return _map(df, text, id_col, f"`{id_col}` long, markup string", found)


def clean_markup(df: DataFrame, *, text: str, id_col: str = "row_id", out: str = "clean_text") -> DataFrame:
    """id_col, out: every record's text without markup; null stays null."""
    return _map(df, text, id_col, f"`{id_col}` long, `{out}` string", lambda pdf: pd.DataFrame({id_col: pdf["id"], out: [clean(t) for t in pdf["text"]]}))
