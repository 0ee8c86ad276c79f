"""Splitting of texts into pretokens, and encoding of each distinct pretoken once.

Byte-level BPE never merges across pretokens, so a text's ids are its pretokens' ids in a row. Texts are split by array
operations that follow the pattern of the byte-level tokenizers

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

and only distinct pretokens reach the tokenizer; a bounded table keeps the ids of those seen before.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import numpy as np

from matchloom.llm.shingles import mixed, weights

#: Characters that are split at once, and pretokens that a worker remembers.
CHUNK_CHARS, REMEMBERED = 1_000_000, 2_000_000
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


@cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            a, b = ord(points[m.start()]), ord(points[m.end() - 1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


@cache
def _mix() -> np.ndarray:
    """Two random odd words for each code point."""
    return np.random.default_rng(11).integers(0, 1 << 63, (2, 0x110000), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def keys(chars: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each pretoken, of 64 and 32 bits: sums of what its characters count at their places."""
    size = np.diff(np.append(begin, len(chars)))
    weight = weights(int(size.max()) if len(size) else 1)[np.arange(len(chars)) - np.repeat(begin, size)]
    first, second = (np.add.reduceat(v[chars] * weight, begin) for v in _mix())
    length = size.astype(np.uint64)
    return mixed(first + length), (mixed(second ^ length) >> np.uint64(32)).astype(np.uint32)


def split(chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pretokens begin. chars: code points of texts in a row; starts: where the (non-empty) texts begin."""
    n = len(chars)
    kind = _classes()[chars]
    first = np.zeros(n + 1, bool)
    first[starts] = True
    first[n] = True
    begin = first.copy()
    begin[1:n] |= kind[1:] != kind[:-1]
    # a run of white space before another character gives its last one away: a blank to what follows
    ends = np.flatnonzero(begin[1:] & (kind == SPACE)) + 1
    ends = ends[~first[ends]]
    begin[ends - 1] = True
    begin[ends[chars[ends - 1] == 32]] = False
    # contractions: an apostrophe that begins a pretoken of its own, and the letters after it
    quote = np.flatnonzero((chars == 39) & begin[:n] & begin[1:])
    quote = quote[~first[quote + 1]]
    if len(quote):
        padded = np.append(chars, [0, 0])
        second = np.where(first[np.minimum(quote + 2, n)], 0, padded[quote + 2])
        one, two = padded[quote + 1], None
        pair = lambda a, b: (one == ord(a)) & (second == ord(b))
        two = pair("r", "e") | pair("v", "e") | pair("l", "l")
        single = np.isin(one, [ord(c) for c in "stmd"])
        hit = single | two
        quote, length = quote[hit], np.where(single, 2, 3)[hit]
        begin[quote + 1] = False
        begin[quote + length] = True
    return np.flatnonzero(begin[:n])


def _merged(a: tuple, b: tuple) -> tuple:
    """Two tables sorted by their first column as one."""
    at = np.searchsorted(a[0], b[0])
    return tuple(np.insert(x, at, y) for x, y in zip(a, b, strict=True))


class SharedHash(Exception):
    """Two different pretokens have one hash."""


class Words:
    """Ids of texts, by way of their distinct pretokens.

    encode turns a list of pretokens into a list of id lists; cut says where pretokens begin (see split), and pattern is
    a regular expression of them. A pretoken must begin wherever a letter meets a blank. What is known of each pretoken is
    a 64-bit hash, one of 32 bits as proof, and place and number of its ids, in two sorted tables: new ones go to the small
    table, which is merged into the large one when it has an eighth of its size. Where two pretokens share the first hash
    but not the second, the text is encoded without the tables. What is remembered is dropped as a whole once it is full,
    so memory stays bounded: some 40 bytes a pretoken.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], cut: Callable[[np.ndarray, np.ndarray], np.ndarray] = split, pattern: str | None = None):
        self.encode, self.cut, self.pattern = encode, cut, pattern
        self._forget()

    def _forget(self):
        self.ids, self.used = np.empty(1 << 20, np.uint32), 0
        nothing = np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.uint32)
        self.large, self.small = nothing, nothing

    def _known(self, keys: np.ndarray, proofs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and number of the ids of each pretoken, and whether it is known."""
        at, size, found = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for table, proof, where, n in (self.large, self.small):
            if len(table):
                i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
                hit = table[i] == keys
                if (proof[i[hit]] != proofs[hit]).any():
                    raise SharedHash
                at[hit], size[hit] = where[i[hit]], n[i[hit]]
                found |= hit
        return at, size, found

    def _learn(self, keys: np.ndarray, proofs: np.ndarray, words: list[str]) -> None:
        """Encodes new pretokens; keys are sorted."""
        if len(self.large[0]) + len(self.small[0]) > REMEMBERED or self.used > 1 << 30:
            self._forget()
        lists = self.encode(words)
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for x in lists for i in x), np.uint32, int(size.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(1 << 20, len(self.ids) // 4), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        new = keys, proofs, (self.used + np.cumsum(size) - size).astype(np.uint32), size.astype(np.uint32)
        self.used += len(flat)
        self.small = _merged(self.small, new)
        if len(self.small[0]) * 8 > len(self.large[0]):
            self.large, self.small = _merged(self.large, self.small), tuple(x[:0] for x in self.small)

    def _chunk(self, text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, and how many each has."""
        try:
            return self._by_tables(text, lengths)
        except SharedHash:
            ends = np.cumsum(lengths)
            ids = [self._whole(text[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            return np.concatenate(ids), np.array([len(i) for i in ids], np.int64)

    def _by_tables(self, text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.cumsum(lengths) - lengths
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        begin = self.cut(chars, starts[lengths > 0])
        end = np.append(begin[1:], len(chars))
        key, proof = keys(chars, begin)
        order = np.argsort(key)
        ranked, proofs = key[order], proof[order]
        fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        if ((proofs[1:] != proofs[:-1]) & ~fresh[1:]).any():
            raise SharedHash
        which = np.empty(len(key), np.int64)
        which[order] = np.cumsum(fresh) - 1
        some, distinct, proofs = order[fresh], ranked[fresh], proofs[fresh]
        at, size, found = self._known(distinct, proofs)
        for _ in range(2):  # a second time if all was forgotten to make room
            if found.all():
                break
            new = np.flatnonzero(~found)
            a, b = begin[some[new]].tolist(), end[some[new]].tolist()
            self._learn(distinct[new], proofs[new], [text[i:j] for i, j in zip(a, b, strict=True)])
            at, size, found = self._known(distinct, proofs)
        at, size = at[which], size[which]
        to = np.cumsum(size)
        ids = self.ids[np.repeat(at - (to - size), size) + np.arange(to[-1])]
        heads = np.concatenate([[0], to])[np.searchsorted(begin, np.append(starts, len(chars)))]
        return ids, np.diff(heads)

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has; null counts as empty."""
        ids, counts, at = [np.empty(0, np.uint32)], [np.empty(0, np.int64)], 0
        lengths = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(np.cumsum(lengths[at:]), CHUNK_CHARS, side="right")) + at)
            chunk = lengths[at:to]
            if chunk.sum() > CHUNK_CHARS:
                i, c = self._long(texts[at])
            elif chunk.sum():
                i, c = self._chunk("".join(t or "" for t in texts[at:to]), chunk)
            else:
                i, c = ids[0], np.zeros(len(chunk), np.int64)
            ids.append(i)
            counts.append(c)
            at = to
        return np.concatenate(ids), np.concatenate(counts)

    def _long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """One text longer than a chunk, cut where a letter meets a blank: a pretoken always begins at that blank."""
        cuts, at = [0], 0
        while len(text) - at > CHUNK_CHARS:
            to = at + CHUNK_CHARS
            while to > at + 1 and not (text[to] == " " and text[to - 1].isascii() and text[to - 1].isalpha() and text[to + 1 : to + 2].isalpha()):
                to -= 1
            if to == at + 1:  # no such place: the tokenizer itself takes the rest
                break
            cuts.append(at := to)
        parts = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]
        ids = [self._chunk(p, np.array([len(p)]))[0] if len(p) <= CHUNK_CHARS else self._whole(p) for p in parts]
        return np.concatenate(ids), np.array([sum(map(len, ids))])

    def _whole(self, text: str) -> np.ndarray:
        import regex
        from public_tokenizers import PATTERN

        return np.array([i for x in self.encode(regex.findall(self.pattern or PATTERN, text)) for i in x], np.uint32)


@cache
def library_words(path: str) -> Words:
    """Pretokens encoded by the tokenizers library with the vocabulary file at path; special strings are plain text."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def encode(words: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            e = tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids, owner = np.array(e.ids, np.uint32), np.array(e.word_ids, np.int64)
            bounds = np.searchsorted(owner, np.arange(len(part) + 1)).tolist()
            ids = ids.tolist()
            out += [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        return out

    return Words(encode)


class AddedWords:
    """Ids of texts as the library's plain call gives them: texts are cut at the added tokens of the vocabulary file."""

    def __init__(self, words: Words, pattern: re.Pattern, ids: dict[str, int]):
        self.words, self.pattern, self.ids = words, pattern, ids

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has; null counts as empty."""
        held = [i for i, t in enumerate(texts) if t and any(c in t for c in self.ids)]
        if not held:
            return self.words.texts(texts)
        parts: list[str | None] = []
        cuts, added = [], {}  # where each text's parts begin, and the ids of the parts that are added tokens
        at = set(held)
        for i, text in enumerate(texts):
            cuts.append(len(parts))
            for part, token in self._cut(text) if i in at else [(text, None)]:
                if token is not None:
                    added[len(parts)] = token
                parts.append(part)
        ids, counts = self.words.texts([None if i in added else p for i, p in enumerate(parts)])
        places = np.array(sorted(added), np.int64)
        begins = np.cumsum(counts) - counts
        ids = np.insert(ids, begins[places], np.array([added[i] for i in places.tolist()], np.uint32))
        counts[places] += 1
        return ids, np.add.reduceat(counts, cuts)

    def _cut(self, text: str) -> list[tuple[str, int | None]]:
        out, at = [], 0
        for m in self.pattern.finditer(text):
            out += [(text[at : m.start()], None), (m.group(), self.ids[m.group()])]
            at = m.end()
        return [*out, (text[at:], None)]


@cache
def added_words(path: str) -> Words | AddedWords:
    """library_words, with the added tokens that the file defines recognised in texts."""
    import json

    with open(path, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens") or []
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in tokens):
        raise ValueError("added tokens that take white space, whole words or normalised text are not supported")
    ids = {t["content"]: t["id"] for t in tokens}
    if not ids:
        return library_words(path)
    pattern = re.compile("|".join(map(re.escape, sorted(ids, key=len, reverse=True))))
    return AddedWords(library_words(path), pattern, ids)
