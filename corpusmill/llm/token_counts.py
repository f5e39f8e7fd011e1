"""Exact token counts at every prefix of a text by dynamic programming over byte-level BPE.

For a byte string, the last token of the encoding of each prefix follows from
the shorter prefixes: among the vocabulary tokens that end at the prefix, only
one forms, with the last token in front of it, a pair that BPE leaves as it is.
So one left-to-right pass stores the count of every prefix, and truncation and
budget questions are lookups; nothing is encoded again.  The counts are kept
for each different word, as the split pattern cuts a text into words that are
encoded apart; a text's own counts are sums of them.

Edge cases: a null text is an empty one with 0 tokens; special strings of the
tokenizer inside a text are one token each, as the library reads them; repeated
rows give repeated rows; columns other than the two named are ignored.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from ._batches import map_documents

# Fixed values of the tokenizer's format: white space as its regular expressions read it, the split pattern, and the
# bytes that stand for themselves in the vocabulary (the others are moved to 256 and up, in order).
SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
PLAIN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

MAX_MEMO = 400_000
STEM = 5  # letters of a word's beginning that are looked up together


def _byte_letters() -> dict[int, str]:
    letters = {b: chr(b) for b in PLAIN_BYTES}
    return letters | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)}


class _Memo(dict):
    """Values by key, computed when missing and forgotten together when there are too many."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute

    def __missing__(self, key):
        if len(self) >= MAX_MEMO:
            self.clear()
        value = self[key] = self.compute(key)
        return value


class PrefixCounter:
    """Token counts of one byte-level BPE vocabulary (a tokenizers JSON file)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {pair: i for i, pair in enumerate(pairs)}
        self.vocab = set(spec["model"]["vocab"])
        # the longest token that ends with given three letters; where there is none, tokens have two at most
        self.reach: dict[str, int] = {}
        for token in self.vocab:
            self.reach[token[-3:]] = max(len(token), self.reach.get(token[-3:], 2))
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.letters = _byte_letters()
        self.split = regex.compile(SPLIT)
        self.stays = _Memo(lambda pair: self.encode(pair[0] + pair[1]) == list(pair))
        self.whole = _Memo(lambda token: self.encode(token) == [token])
        self.stems = _Memo(self._from_nothing)
        self.known = _Memo(self._word)

    def encode(self, word: str) -> list[str]:
        """Plain BPE of a string of byte letters: the lowest-ranked pair merges first, the leftmost on ties."""
        parts, rank, none = list(word), self.rank, len(self.rank)
        ranks = [rank.get(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank.get((parts[i], parts[i + 1]), none)
        return parts

    def _extend(self, text: str, last: list[str], counts: list[int]) -> None:
        """Go on with the last tokens and counts of the prefixes of ``text``, which are known up to some length."""
        vocab, stays, reach = self.vocab, self.stays, self.reach
        for end in range(len(last), len(text) + 1):
            longest = reach.get(text[end - 3 : end], 2) if end > 2 else end
            for start in range(max(0, end - longest), end):
                token = text[start:end]
                if token in vocab and (stays[last[start], token] if start else self.whole[token]):
                    last.append(token)
                    counts.append(counts[start] + 1)
                    break
            else:
                raise ValueError(f"no encoding of {text[:end]!r}")

    def _from_nothing(self, text: str) -> tuple[list[str], list[int]]:
        last, counts = [""], [0]
        self._extend(text, last, counts)
        return last, counts

    def _word(self, word: str) -> array:
        """Token counts of all byte prefixes of a piece of text that the split pattern keeps whole.

        Words that begin alike share the work on their first letters.
        """
        text = "".join(map(self.letters.__getitem__, word.encode()))
        last, counts = map(list, self.stems[text[:STEM]])
        self._extend(text, last, counts)
        return array("i", counts)

    def word_prefixes(self, word: str) -> np.ndarray:
        return np.frombuffer(self.known[word], np.int32)

    def _plain(self, text: str) -> np.ndarray:
        """Counts at all byte prefixes of a text without special strings."""
        out, held = [np.zeros(1, np.int32)], 0
        words = self.split.findall(text)
        for i, word in enumerate(words):
            counts = self.word_prefixes(word)
            if len(word) == 3 and word[0] == "'" and word[1:].isalpha():  # cut inside 're, 've, 'll: quote and letter
                counts = np.array([0, 1, 2, counts[-1]], np.int32)
            step = held + counts[1:]  # a new array: the known one stays
            if i and out and self.split.fullmatch(word) and word[0] == " " and len(word) > 1 and words[i - 1].isspace():
                run = words[i - 1] + " "  # a prefix that ends with this blank has the whole run as its last piece
                step[0] = held - int(self.known[words[i - 1]][-1]) + self.known[run][-1]
            elif i and word.isspace() and len(word) == 1 and words[i - 1].isspace():
                step[-1] = held - self.known[words[i - 1]][-1] + self.known[words[i - 1] + word][-1]
                out.append(step)
                held += int(counts[-1])
                continue
            out.append(step)
            held += int(counts[-1])
        return np.concatenate(out)

    def prefixes(self, text: str) -> np.ndarray:
        """``n_bytes + 1`` counts: entry i is the exact count of the prefix of i bytes (i at a character's end)."""
        out, held, start = [np.zeros(1, np.int32)], 0, 0
        for found in self.special.finditer(text) if self.special else ():
            partial = held + self._plain(text[start : found.end() - 1])
            held += int(self._plain(text[start : found.start()])[-1]) + 1
            out += [partial[1:], np.array([held], np.int32)]
            start = found.end()
        out.append(held + self._plain(text[start:])[1:])
        return np.concatenate(out)

    def count(self, text: str, limit: int) -> tuple[int, int]:
        """The token count of a text, and the length in code points of its longest prefix with at most ``limit`` tokens."""
        known = self.known
        if self.special and self.special.search(text):
            counts = self.prefixes(text)
            widths = np.array([len(c.encode()) for c in text], np.int64)
            return int(counts[-1]), int(np.flatnonzero(counts[np.append(0, np.cumsum(widths))] <= limit)[-1])
        words = self.split.findall(text)
        totals = np.cumsum([known[w][-1] for w in words]) if words else np.zeros(1, np.int64)
        if totals[-1] <= limit:
            return int(totals[-1]), len(text)
        # words are cut apart, so only prefixes that end in the first word over the limit, or next to it, are in question
        k = int(np.searchsorted(totals, limit, side="right"))
        a = max(0, k - 1)
        window = "".join(words[a : k + 2])
        counts = self._plain(window) + (totals[a - 1] if a else 0)
        widths = np.array([len(c.encode()) for c in window], np.int64)
        fits = np.flatnonzero(counts[np.append(0, np.cumsum(widths))] <= limit)[-1]
        return int(totals[-1]), sum(map(len, words[:a])) + int(fits)


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    """The counter of a vocabulary file, loaded once for each worker."""
    return PrefixCounter(path)


COUNTS = {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean", "fitting_chars": "long"}


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fitting_chars) of every whole text.

    ``fitting_chars`` is the length of the longest prefix, cut at any character, with at most ``limit`` tokens.
    ``vocabulary`` is the path of a tokenizers JSON file that every executor can read.  One pass without a shuffle.
    Ids that are no whole numbers are text and kept; an empty table gives an empty result; a very long text costs the
    memory of its bytes and their counts.
    """

    def rows(ids, texts):
        count = counter(vocabulary)
        out: dict[str, list] = {f: [] for f in ("doc_id", *COUNTS)}
        for i, text in zip(ids, texts, strict=True):
            tokens, fits = count.count(text, limit)
            for name, value in zip(out, (i, len(text.encode()), tokens, tokens > limit, fits), strict=True):
                out[name].append(value)
        return out

    return map_documents(docs, rows, COUNTS, id_col, text_col)


def prefix_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, counts): the exact token count at every byte prefix of every text, starting with 0 for no bytes.

    ``counts[a]`` answers what a cut after ``a`` bytes costs, for every ``a`` at the end of a character.
    """

    def rows(ids, texts):
        count = counter(vocabulary)
        return {"doc_id": ids, "counts": [count.prefixes(t) for t in texts]}

    return map_documents(docs, rows, {"counts": "array<int>"}, id_col, text_col)
