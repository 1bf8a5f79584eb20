"""Template residue, filler, error pages and script notices instead of posts.

A naive Bayes model is learnt from positive and unlabelled records.  Positive are records that a few sure forms cover;
the rest is unlabelled.  Some positives are hidden among the unlabelled ones as spies, and records that score below
nearly all spies are reliable negatives; expectation-maximisation then re-estimates how likely each other record is
residue.  Words are only a part of what the model sees: repetition, rare words, marks, slots, lengths and the like let it
find forms that no trusted record has.  Every passage of every record is scored, and a record is residue if the log odds
of its passages and its own add up to more than zero and no more than a quarter of its text reads like a post.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Forms of the web at large that only residue has. A record is trusted if one stands in it and it has no post beside it.
TRUSTED = re.compile(
    r"""\{\{\s*\w+\s*\}\} | %%\w+%% | <%=?.*?%> | \$\{[\w.]+\} | ^\{\w+\}\s*$ | \[object\sObject\] | ^\W*lorem\sipsum\b | ^(?:asdf\s+){2} | ^TODO:
      | ^\W*(?:error|fehler|erreur)\W{0,2}[45]\d\d\b | <title>\s*[45]\d\d | "code":\s*[45]\d\d
      | ^(?:please\s)?(?:turn\son|enable|you\sneed\sto\senable)\s(?:javascript|cookies) | ^javascript\sis\s(?:off|disabled|required) | ^bitte\saktivieren\ssie\sjavascript | ^activez\s(?:javascript|les\s(?:scripts|cookies)) | ^active\s(?:javascript|las\scookies)
      | <noscript> | you\sare\s(?:no|not\sa)\srobot | ^checking\syour\sbrowser | ^access\sdenied\. | session\shas\sexpired\. | ^(?:page\snot\sfound|seite\snicht\sgefunden|page\snon\strouvée|página\sno\sencontrada) | down\sfor\smaintenance
    """,
    re.I | re.X | re.M,
)
MODERATED = re.compile(r"^\s*(?:removed|deleted)(?:\s+by\s+\w+)?\s*$|[\[(]\s*(?:removed|deleted)(?:\s+by\s+\w+)?\s*[\])]\s*$|\n\s*(?:removed|deleted)\s+by\s+\w+\s*$", re.I)
_PASSAGE = re.compile(r"(?<=[.!?])\s+|\n+")
_SLOT = re.compile(r"\{\{\s*[\w.]+\s*\}\}|\{\w+\}|\$\{[\w.]+\}|<%=?\s*[\w.]*\s*%>|(%%|@@|##|__)\w+\1|\[[A-Z][A-Z _]{2,}\]")
_TOKEN = re.compile(r"\[slot\]|\[object|</?[a-z]+\d?|[^\W\d_]+|\d+|[{}\[\]<>|%@$:]")


def passages(text: str) -> list[str]:
    return [p for p in (x.strip() for x in _PASSAGE.split(text)) if p]


def tokens(passage: str) -> list[str]:
    """Lower-cased words and marks; slots are one token each, so are status numbers, other digits count by length."""
    return [(("#status" if len(x) == 3 and x[0] in "45" else f"#{min(len(x), 6)}") if x.isdigit() else x) for x in _TOKEN.findall(_SLOT.sub(" [slot] ", passage).lower())]


def _step(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


def features(passage: str, common: frozenset[str]) -> set[str]:
    """Words, pairs of neighbours, and the passage's shape; ``common`` are the words that many posts have."""
    w = tokens(passage)
    words = [x for x in w if x[0].isalpha()]
    rare = sum(x not in common for x in words) / len(words) if words else 1.0
    again = 1 - len(set(w)) / len(w) if len(w) > 2 else 0.0
    marks = sum(not (c.isalnum() or c.isspace()) for c in passage) / len(passage)
    shape = f"{_step(rare, (0.05, 0.2, 0.4, 0.7, 0.95))}"
    return {*w, *(f"{a} {b}" for a, b in zip(["^", *w], [*w, "$"])), f"~rare {shape}", f"~rare {shape} {_step(len(words), (1, 3, 6, 10))}", f"~again {_step(again, (0.1, 0.3, 0.5))}", f"~marks {_step(marks, (0.04, 0.1, 0.2))}"}


def record_features(text: str, parts: list[str]) -> set[str]:
    """What only the whole record shows: its length, and whether its passages repeat."""
    return {f"~length {len(text).bit_length()}", f"~passages {_step(len(parts), (2, 3, 5, 8))}", f"~repeats {len(set(parts)) * 2 <= len(parts)}"}


class ResidueModel:
    """Log odds of residue by feature; features that the sample met once or never say nothing."""

    def __init__(self, weights: dict[str, float], common: frozenset[str], prior: float, line: float = 0.0, margin: float = -4.0):
        self.weights, self.common, self.prior, self.line, self.margin = weights, common, prior, line, margin
        self._seen: dict[str, float] = {}

    def score(self, passage: str) -> float:
        s = self._seen.get(passage)
        if s is None:
            if len(self._seen) > 50_000:
                self._seen.clear()
            get = self.weights.get
            s = sum(get(f, 0.0) for f in features(passage, self.common))
            if len(passage) < 400:
                self._seen[passage] = s
        return s

    def odds(self, text: str, parts: list[str]) -> float:
        """Log odds of a record: its passages' and what only the whole shows."""
        return self.prior + sum(self.weights.get(f, 0.0) for f in record_features(text, parts)) + sum(map(self.score, parts))

    def is_residue(self, text: str | None, share: float = 0.75) -> bool:
        """Whether the record's log odds are above ``line`` and passages below ``margin`` make up at most ``1 - share`` of it.

        Both are learnt: the line is a third of what nearly all reliable negatives are below, so nearer to even odds
        than to any post, and the margin is what nearly all passages of posts are below; passages above it are neutral or
        residue.  Null, blank and moderated texts never are residue.
        """
        if not text or not text.strip() or MODERATED.search(text):
            return False
        parts = passages(text)
        size, good, total = sum(map(len, parts)), 0, self.prior + sum(self.weights.get(f, 0.0) for f in record_features(text, parts))
        for p in parts:
            s = self.score(p)
            total += s
            if s < self.margin:
                good += len(p)
                if good > (1 - share) * size:
                    return False
        return total > self.line


def form_of(text: str) -> str | None:
    """What a trusted record is trusted for: its sure form without digits, or None."""
    m = TRUSTED.search(text)
    return None if m is None else _SLOT.sub("[slot]", re.sub(r"\d+|\s+", " ", m.group(0).lower())).strip()


def learn(positive: list[str], unlabelled: list[str], *, rounds: int = 4, smooth: float = 0.1, folds: int = 6, missed: float = 0.02, start: float = 0.95) -> ResidueModel:
    """Spies first, then expectation-maximisation over the records that aren't reliable negatives.

    The spies are whole forms: in each of ``folds`` rounds some forms of the positives are taken for unlabelled, so that
    their scores show how low forms may score that no positive has.  Records below all but ``missed`` of these scores are
    reliable negatives; Words in 0.4 % of the unlabelled records are common, so a form that fills
    more of the corpus must have a trusted one like it.  ``start`` is the likelihood of the others before the first round of the maximisation, high, so
    that a form of few records isn't given up before its words are known.
    """
    texts = [*positive, *unlabelled]
    split = [passages(t) for t in texts]
    n, trusted = len(texts), np.arange(len(texts)) < len(positive)
    if not len(positive) or not len(unlabelled):
        return ResidueModel({}, frozenset(), -1.0)
    df: Counter = Counter()
    for parts in split[len(positive) :]:
        df.update({x for p in parts for x in tokens(p) if x[0].isalpha()})
    common = frozenset(x for x, c in df.items() if c >= max(2, 0.004 * len(unlabelled)))
    bags: list[set[str]] = []
    for text, parts in zip(texts, split):
        bag = record_features(text, parts)
        for p in parts:
            bag |= features(p, common)
        bags.append(bag)
    seen: Counter = Counter()
    for bag in bags:
        seen.update(bag)
    number = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c > 1))}
    rows = [np.fromiter((number[f] for f in bag if f in number), np.int64) for bag in bags]
    flat, owner = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])

    def fit(likely: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        w = likely[owner]
        pos, neg = np.bincount(flat, w, len(number)) + smooth, np.bincount(flat, 1 - w, len(number)) + smooth
        weights = np.log(pos / (likely.sum() + 2 * smooth)) - np.log(neg / ((1 - likely).sum() + 2 * smooth))
        prior = float(np.log((likely.sum() + 1) / (n - likely.sum() + 1)))
        return weights, prior, np.bincount(owner, weights[flat], n) + prior

    forms = {f: i for i, f in enumerate(sorted({form_of(t) or "" for t in positive}))}
    fold = np.array([forms[form_of(t) or ""] % folds for t in positive] + [-1] * len(unlabelled))
    hidden, odds = np.zeros(n), np.zeros(n)
    for k in set(fold[fold >= 0]):
        if len(forms) > 1:
            hidden[fold == k] = fit(np.where(trusted & (fold != k), 1.0, 0.0))[2][fold == k]
    line = min(0.0, float(np.quantile(hidden[trusted], missed)))
    odds = fit(trusted.astype(float))[2]
    likely = np.where(trusted, 1.0, np.where(odds < line, 0.0, start))
    weights, prior = np.zeros(len(number)), 0.0
    for _ in range(rounds):
        weights, prior, odds = fit(likely)
        likely = np.where(trusted, 1.0, 1 / (1 + np.exp(-np.clip(odds, -50, 50))))
    model = ResidueModel({f: float(weights[i]) for f, i in number.items()}, common, prior)
    negative = [i for i in np.flatnonzero(~trusted & (likely < 0.5))[:2000]]
    if negative:
        model.line = min(0.0, float(np.quantile([model.odds(texts[i], split[i]) for i in negative], 0.999)) / 3)
        model.margin = min(-4.0, float(np.quantile([model.score(p) for i in negative for p in split[i]], 0.98)))
    return model


def fit(df: DataFrame, *, text: str, id_col: str = "row_id", max_positive: int = 2000, max_unlabelled: int = 12_000, pool: int = 100_000) -> ResidueModel:
    """Fit on a sample of at most ``max_positive`` trusted and ``max_unlabelled`` other records.

    The sample is drawn from about ``pool`` records whose hash of the id is least, whole texts of any length; only it
    reaches the driver.  Null, blank and moderated texts aren't in it.
    """
    rows = df.select(F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(1_000_000_000)).alias("h"), F.col(f"`{text}`").alias("t")).where(F.col("t").isNotNull())
    n = max(1, rows.count())
    least = lambda most: -(-1_000_000_000 * most // n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = [(h, t, trusted) for h, t in zip(pdf["h"], pdf["t"]) if t.strip() and ((trusted := bool(TRUSTED.search(t))) or h < least(2 * max_unlabelled)) and not MODERATED.search(t)]
            yield pd.DataFrame(kept, columns=["h", "t", "trusted"]).astype({"h": "int64", "t": "object", "trusted": "bool"})

    picked = rows.where(F.col("h") < least(pool)).mapInPandas(run, "h long, t string, trusted boolean")
    order = F.row_number().over(Window.partitionBy("trusted").orderBy("h", "t"))
    sample = picked.withColumn("n", order).where(F.col("n") <= max(max_positive, max_unlabelled)).where(~F.col("trusted") | (F.col("n") <= max_positive)).collect()
    sample.sort(key=lambda r: (r["h"], r["t"]))
    return learn([r["t"] for r in sample if r["trusted"]], [r["t"] for r in sample if not r["trusted"]][:max_unlabelled])


def find_residue(df: DataFrame, model: ResidueModel, *, text: str, id_col: str = "row_id", share: float = 0.75) -> DataFrame:
    """id_col of the records that are residue; null, blank and moderated texts never are, repeated rows count each."""
    sent = df.sparkSession.sparkContext.broadcast((model.weights, model.common, model.prior, model.line, model.margin))  # bounded by the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = ResidueModel(*sent.value)
        for pdf in batches:
            yield pd.DataFrame({id_col: [i for i, t in zip(pdf["id"], pdf["text"]) if m.is_residue(t, share)]}).astype("int64")

    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInPandas(run, f"`{id_col}` long")
