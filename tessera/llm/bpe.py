"""BPE encoding and decoding by dynamic programming over prefixes.

A word is cut into symbols (its bytes, the last one carrying the end-of-word mark). For every prefix of those symbols
exactly one token can be the last one of the prefix's encoding: the token t that ends there and that stands next to the
last token of the remaining prefix without any merge firing across their border. An automaton over the vocabulary
lists the tokens that end at each position (the suffixes of the prefix that are tokens), the pair test picks the one,
and back-pointers from the end give the ids. No merge queue is run.

Words are cached per Python worker, as natural text repeats them: at most CACHE_WORDS, those used of late, and none of
more than CACHE_CHARS characters. What is forgotten changes speed only, and tasks of other operators drop the caches.
Memory is bounded by them (see README), the vocabulary and one text, whatever its words' lengths.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from string import punctuation

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LEFT_BEHIND, map_rows, text_or_empty

CACHE_WORDS, CACHE_PAIRS, CACHE_CHARS = 300_000, 200_000, 64
_ID_BITS = 32  # of a token's id
_LATIN_END = "\u0250"  # letters before it are letters in every version of Unicode
_END = "\n"  # the end-of-word mark inside the automaton; byte-level symbols never hold it
#: Fixed value: the tokenizer's pattern for pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters with the Unicode property White_Space, as the tokenizer's patterns see them.
_SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


class WordBpe:
    """The model of a tokenizers JSON file with an end-of-word suffix, no decoder and special tokens matched verbatim."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = dict(model["vocab"])
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.names = {i: t for t, i in self.vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y = self.vocab[a], self.vocab[b]
            whole = self.vocab[a + b]
            self.rank.setdefault((x, y), r)
            self.parts.setdefault(whole, (x, y, r))
        self.symbols = byte_symbols()
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}
        self._beside: dict[int, bool] = {}  # a pair as one number, which takes less than a tuple
        self.length: dict[int, int] = {}
        self.automaton = self._automaton()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.names |= {i: t for t, i in special.items()}
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._words = regex.compile(PATTERN.replace("\\s", _SPACE)).findall
        self._chunks = regex.compile(rf"[^{_SPACE}]+").findall
        self._separators = re.compile("[\x1c-\x1f]").search  # str.split() takes them for white space, the tokenizer doesn't
        self._cache = _Chunks(self)
        self._printed = str.maketrans({b: s for b, s in enumerate(self.symbols) if chr(b) != s})
        self._decimals = [str(i) for i in range(max(self.names, default=-1) + 1)]

    def _automaton(self) -> ahocorasick.Automaton:
        """Every token that its own merges can make; others never appear in an encoding."""
        found = ahocorasick.Automaton()
        base = [t for s in self.symbols for t in (s, s + self.suffix)]
        alive: set[int] = {self.vocab[t] for t in base}
        for token in sorted(self.parts, key=lambda t: self.parts[t][2]):
            x, y, r = self.parts[token]
            if token not in alive and x in alive and y in alive and self._unbroken(x, y, r):
                alive.add(token)
        for token in alive:
            text = self.names[token]
            last = bool(self.suffix) and text.endswith(self.suffix)
            body = text[: -len(self.suffix)] if last else text
            self.length[token] = len(body) + last  # the mark counts as a symbol
            found.add_word(body + _END * last, (token, len(body) + last))
        found.make_automaton()
        return found

    def _edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The tokens that stand at that edge of token while it is merged, each with the rank of the merge that ends it."""
        memo = self._right if right else self._left
        if token not in memo:
            spine, ends = [], float("inf")
            at = token
            while True:
                spine.append((at, ends))
                if at not in self.parts:
                    break
                x, y, ends = self.parts[at]
                at = y if right else x
            memo[token] = spine
        return memo[token]

    def _unbroken(self, x: int, y: int, before: float) -> bool:
        """Whether no merge across the border of x and y, of a rank under before, fires ahead of those inside them.

        Of two merges of one rank the left one is done first: so a merge inside x at that rank comes first, one
        inside y doesn't.
        """
        rank = self.rank
        for a, a_ends in self._edge(x, True):
            for b, b_ends in self._edge(y, False):
                m = rank.get((a, b))
                if m is not None and m < before and m < a_ends and m <= b_ends:
                    return False
        return True

    def beside(self, x: int, y: int) -> bool:
        """Whether encoding the text of x and y together gives exactly x, y."""
        pair = x << _ID_BITS | y
        known = self._beside.get(pair)
        if known is None:
            if len(self._beside) >= CACHE_PAIRS:
                self._beside.clear()
            known = self._beside[pair] = self._unbroken(x, y, float("inf"))
        return known

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-token of one or more characters."""
        text = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self._printed)
        done = unmarked = -1
        if self.suffix:
            done = unmarked = len(text) - 1  # where the last symbol ends without the mark: no token ends there
            text += _END
        n = len(text)
        last: list[int] = [-1] * (n + 1)
        known, length = self._beside.get, self.length
        for end, (token, size) in self.automaton.iter(text):
            if end == done or end == unmarked:
                continue
            at = end + 1
            if size < at:
                x = last[at - size]
                ok = known(x << _ID_BITS | token)
                if not (self.beside(x, token) if ok is None else ok):
                    continue
            last[at] = token
            done = end
        ids = []
        while n:
            ids.append(last[n])
            n -= length[last[n]]
        return tuple(ids[::-1])

    def chunks(self, text: str) -> list[str]:
        """The runs of a text between white space, normalised; a special token is one, marked by a leading blank."""
        if self._cut is None or ("<|" not in text and all("<|" in s for s in self.special)):
            return self._plain(text)
        found: list[str] = []
        for k, part in enumerate(self._cut.split(text)):
            found += [" " + part] if k % 2 else self._plain(part)
        return found

    def _plain(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # str.lower() looks at what follows it, the tokenizer doesn't
            text = text.replace("Σ", "σ")
        text = text.lower()
        return self._chunks(text) if self._separators(text) else text.split()

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        if chunk[0] == " ":
            return (self.special[chunk[1:]],)
        if chunk.isalpha() and (chunk.isascii() or max(chunk) < _LATIN_END):
            return self.encode_word(chunk)
        letters = chunk.rstrip(punctuation)
        if letters.isalpha() and letters.isascii():
            return self._cache[letters] + self._cache[chunk[len(letters) :]]  # signs alone are one pre-token
        if not chunk.isascii() and any(unicodedata.category(c) == "Cn" for c in chunk):
            return tuple(chain.from_iterable(map(self.encode_word, self._newer_words(chunk))))
        words = self._words(chunk)
        return self.encode_word(chunk) if len(words) == 1 else tuple(chain.from_iterable([self._cache[w] for w in words]))

    def _newer_words(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk with characters that this Python's Unicode tables lack: by the tables of the tokenizers library."""
        from tokenizers import Regex, normalizers, pre_tokenizers

        chunk = normalizers.Lowercase().normalize_str(chunk)
        return [w for w, _ in pre_tokenizers.Split(Regex(PATTERN), "removed", invert=True).pre_tokenize_str(chunk)]

    def encode_text(self, text: str) -> tuple[str, list[int]]:
        """The ids in decimal, joined by one space, and as numbers."""
        numbers = list(chain.from_iterable(map(self._cache.__getitem__, self.chunks(text))))
        return " ".join(map(self._decimals.__getitem__, numbers)), numbers

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False) without a decoder: token texts joined by one space; unknown ids are left out."""
        return " ".join(filter(None, map(self.names.get, ids)))


class _Chunks(dict):
    """Chunk to its ids; a missing one is encoded and, unless it is long, stored. A pre-token is a chunk of itself.

    When half of CACHE_WORDS is full it becomes the older half, from which what is used comes back, and the half that was
    older goes: so chunks that come once don't drive out those that come again and again.
    """

    def __init__(self, model: WordBpe):
        self.model, self.older = model, {}

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        found = self.older.get(chunk)
        if found is None:
            found = self.model.encode_chunk(chunk)
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS // 2:
                self.older = dict(self)
                self.clear()
            self[chunk] = found
        return found


@lru_cache(maxsize=2)
def model_of(path: str) -> WordBpe:
    return WordBpe(path)


def _forget() -> bool:
    there = model_of.cache_info().currsize > 0
    model_of.cache_clear()
    return there


LEFT_BEHIND["bpe"] = _forget


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes it again.

    Returns doc_id, n_tokens, ids_sha256 and decoded_sha256, with with_ids also token_ids (array<int>). A null text is
    empty: no tokens, digests of the empty string. Repeated rows and null doc_ids are kept, one output row each; other
    columns of docs are ignored. path is that of the tokenizer's JSON file, which every executor must have.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        model = model_of(path)
        for doc_id, text in rows:
            ids, numbers = model.encode_text(text)
            decoded = model.decode(numbers)
            row = (doc_id, len(numbers), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
            yield (*row, np.array(numbers, np.int32)) if with_ids else row

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return map_rows(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, schema, leaves="bpe")
