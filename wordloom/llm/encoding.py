"""Byte-level BPE ids by prefix dynamic programming: every byte prefix of a piece has one valid last token.

``EncodedText`` keeps the last token of every prefix, so that appending goes on where the text ended, and after an edit
only the pieces around it are cut and encoded again, in a long piece only the bytes around it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern that cuts text into pieces before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class PrefixEncoder:
    """``path``: a rank file, one base64 token and its rank a line; the rank is the id."""

    def __init__(self, path: str, cache: int = 200_000):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.cut = regex.compile(PATTERN)
        self.split = lru_cache(maxsize=500_000)(self._split)
        self.fits = lru_cache(maxsize=1_000_000)(self._fits)
        self.short_piece = lru_cache(maxsize=cache)(self._piece)

    def _merge(self, data: bytes) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge made ``token``."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                return None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _fits(self, left: bytes, right: bytes) -> bool:
        """Whether the merges leave ``left`` and ``right`` as they are when they stand side by side."""
        return self._merge(left + right) == [left, right]

    def lasts(self, text: bytes, last: list[int] | None = None, old: list[int] | None = None, shift: int = 0, same: int = 1 << 60) -> list[int]:
        """The length of the one valid last token of every prefix of the piece ``text``; ``last`` has those known already.

        ``old`` are the lengths of a piece that is equal from byte ``same`` of this one on, ``shift`` bytes further
        back; as soon as one longest token's worth of lengths agrees, the rest is taken from it.
        """
        last = list(last or ())
        ranks, fits, longest, agree = self.ranks, self.fits, self.longest, 0
        for end in range(len(last) + 1, len(text) + 1):
            for start in range(max(0, end - longest), end):
                token = text[start:end]
                if token in ranks and (start == 0 and self._merge_is(token) or start and fits(text[start - last[start - 1] : start], token)):
                    last.append(end - start)
                    break
            else:
                raise ValueError(f"the vocabulary has no token for byte {text[end - 1]}")
            if old is not None and end > same + longest:
                agree = agree + 1 if old[end - 1 - shift] == last[-1] else 0
                if agree > longest:
                    return last + old[end - shift :]
        return last

    def ids_of(self, text: bytes, last: list[int]) -> list[int]:
        ids, at = [], len(text)
        while at:
            ids.append(self.ranks[text[at - last[at - 1] : at]])
            at -= last[at - 1]
        return ids[::-1]

    def _piece(self, p: str) -> tuple[int, ...]:
        data = p.encode("utf-8", "replace")
        return tuple(self.ids_of(data, self.lasts(data)))

    def piece(self, p: str) -> tuple[int, ...]:
        """The ids of one piece; only short ones are kept."""
        return self.short_piece(p) if len(p) <= 64 else self._piece(p)

    def _merge_is(self, token: bytes) -> bool:
        return len(token) == 1 or self.split(token) is not None

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; null and empty texts have none.  Strings of special tokens are ordinary text."""
        out: list[int] = []
        for p in self.cut.findall(text or ""):
            out += self.piece(p)
        return out


class EncodedText:
    """A text, its pieces, and of each piece its ids and the last token of every prefix.

    ``edit`` replaces text[start:end]; ``append`` adds at the end.  ``encoded`` counts the pieces that were encoded, whole or in
    part, by the last change.
    """

    #: Characters after a piece that its end may depend on.
    AHEAD = 3

    def __init__(self, encoder: PrefixEncoder, text: str | None = ""):
        self.encoder, self.text, self.encoded = encoder, text or "", 0
        spans = [m.span() for m in encoder.cut.finditer(self.text)]
        self.starts = np.array([a for a, _ in spans], dtype=np.int64)
        self.lasts = [encoder.lasts(self.text[a:b].encode("utf-8", "replace")) for a, b in spans]
        self.parts = [self._ids(self.text[a:b], x) for (a, b), x in zip(spans, self.lasts)]
        self.encoded = len(spans)

    def _ids(self, piece: str, last: list[int]) -> list[int]:
        return self.encoder.ids_of(piece.encode("utf-8", "replace"), last)

    @property
    def ids(self) -> list[int]:
        return [i for part in self.parts for i in part]

    def append(self, new: str) -> None:
        self.edit(len(self.text), len(self.text), new)

    def edit(self, start: int, end: int, new: str) -> None:
        old, n, shift = self.text, len(self.starts), len(new) - (end - start)
        text = old[:start] + new + old[end:]
        # pieces that end far enough before the edit stay: each ends where the next begins
        low = max(0, int(np.searchsorted(self.starts, start - self.AHEAD, side="right")) - 1)
        at = int(self.starts[low]) if n else 0
        spans: list[tuple[int, int]] = []
        high = n
        for m in self.encoder.cut.finditer(text, at):
            if m.start() - shift >= end and m.start() >= start + len(new):
                k = int(np.searchsorted(self.starts, m.start() - shift))
                if k < n and self.starts[k] == m.start() - shift:  # from here on the pieces are the old ones
                    high = k
                    break
            spans.append(m.span())
        lasts = [self._relast(text, a, b, low, high, start, end, new) for a, b in spans]
        self.parts[low:high] = [self._ids(text[a:b], x) for (a, b), x in zip(spans, lasts)]
        self.lasts[low:high] = lasts
        self.starts = np.concatenate([self.starts[:low], np.array([a for a, _ in spans], dtype=np.int64), self.starts[high:] + shift])
        self.text, self.encoded = text, len(spans)

    def _relast(self, text: str, a: int, b: int, low: int, high: int, start: int, end: int, new: str) -> list[int]:
        """The last tokens of the piece text[a:b]: those of an old piece that begins alike, up to the edit, and from it on where both agree again."""
        data = text[a:b].encode("utf-8", "replace")
        k = int(np.searchsorted(self.starts, a))
        if not (low <= k < high and self.starts[k] == a and a < start):
            return self.encoder.lasts(data)
        stop = int(self.starts[k + 1]) if k + 1 < len(self.starts) else len(self.text)
        kept = min(len(text[a : min(start, b)].encode("utf-8", "replace")), len(self.lasts[k]))
        if stop >= end and b >= start + len(new) and b - (start + len(new)) == stop - end:  # the piece goes on after the edit as the old one did
            same = len(text[a : start + len(new)].encode("utf-8", "replace"))
            return self.encoder.lasts(data, self.lasts[k][:kept], self.lasts[k], len(data) - len(self.lasts[k]), same)
        return self.encoder.lasts(data, self.lasts[k][:kept])


def encode_texts(df: DataFrame, vocabulary: str, *, text: str = "text", id_col: str = "doc_id", out: str = "ids") -> DataFrame:
    """id_col, out: the ids of every text; null and empty texts give an empty list, repeated rows each their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = PrefixEncoder(vocabulary)
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                yield pd.DataFrame({id_col: part["id"], out: [encoder.encode(t) for t in part["text"]]})

    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInPandas(run, f"`{id_col}` long, `{out}` array<int>")
