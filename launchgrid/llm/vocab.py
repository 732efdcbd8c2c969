"""Whole texts to token ids through public tokenizers, chunk by chunk with a bounded cache.

Texts are cut only where no token can cross, so the ids equal those of the whole text. Chunks
repeat, so most are met in the cache of the worker process, which is bounded and emptied when full.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from launchgrid.llm.common import own_caches

CACHE_BYTES = 240_000_000
ENTRY_BYTES = 200  # of a chunk of a dozen characters with its few ids in a dictionary, about
LONG = 48  # longer chunks are not kept
PUNCT = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'  # fixed values: ASCII marks without the apostrophe
_GAP = re.compile(r"(?<=\S)(?= \S)")
_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]  # no later character is white space
_ASCII_SPACES = [c for c in _SPACES if c.isascii()]


def byte_table() -> list[str]:
    """The 256 printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def single_gaps(text: str) -> bool:
    """Whether all white space of a text is single spaces and line breaks between other characters."""
    flat = text.replace("\n", " ")
    if not flat or flat[0] == " " or flat[-1] == " " or "  " in flat:
        return False
    for c in _ASCII_SPACES if flat.isascii() else _SPACES:
        if c in flat:
            return False
    return True


def mark_bytes(text: str) -> str:
    """The text with a zero character at every cut; without zero characters of its own."""
    if single_gaps(text):
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00")
    return _GAP.sub("\x00", text)


def cut_bytes(text: str) -> list[str]:
    """Cut before single spaces and around single line breaks between other characters.

    There the pattern always begins a new match: a space goes with the word after it, and a
    single break is a match of its own. Texts with other white space are only cut at spaces.
    """
    if "\x00" in text:
        return [text]
    return mark_bytes(text).split("\x00") if text else []


def cut_words(text: str) -> list[str]:
    """Cut at spaces, for vocabularies that drop white space and end words there."""
    return [w for w in text.replace("\n", " ").split(" ") if w]


class Encoder:
    """Ids of whole texts as little-endian bytes, by a tokenizers library object."""

    def __init__(self, tokenizer, cut, words: bool = False, letters: bool = False):
        self.tokenizer, self.cut, self.words = tokenizer, cut, words
        self.byte = byte_table() if letters else None  # the pattern takes any letters, with the space before them, as one match
        self.known: dict[str, bytes] = {}

    def _atoms(self, chunk: str) -> tuple[str, str] | None:
        """A word and the marks after it, which encode apart: the pattern ends a match between them."""
        base = chunk.rstrip(PUNCT)
        if len(base) < len(chunk) and base:
            letters = base.lower() if self.words else base.lstrip(" ")  # some capitals become a letter and a mark
            if letters.isalpha() and base[-1] != " ":
                return base.lower() if self.words and base.isascii() else base, chunk[len(base):]
        if self.words and chunk.isascii() and chunk.isalpha() and not chunk.islower():
            return chunk.lower(), ""
        return None

    def _encode(self, atoms: list[str]) -> list[bytes]:
        """Plain words, with the space before them, are one match each: straight to the merges."""
        tokenize, out, rest = self.tokenizer.model.tokenize, [b""] * len(atoms), []
        for i, a in enumerate(atoms):
            bare = a[1:] if a[:1] == " " else a
            if bare.isascii() and bare.isalpha() and (not self.words or a.islower() and bare is a):
                out[i] = array("I", [t.id for t in tokenize(a if bare is a else "\u0120" + bare)]).tobytes()
            elif self.byte and bare.isalpha() and max(bare) < "\u0250":  # Latin letters
                out[i] = array("I", [t.id for t in tokenize("".join(map(self.byte.__getitem__, a.encode())))]).tobytes()
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([atoms[i] for i in rest], add_special_tokens=False)):
            out[i] = array("I", e.ids).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known
        if len(known) * ENTRY_BYTES > CACHE_BYTES:
            known.clear()
        chunks, long = [self.cut(t) for t in texts], ()
        found = [[*map(known.get, cs)] for cs in chunks]
        gaps = [i for i, ids in enumerate(found) for x in ids if x is None]
        if gaps:
            gaps = dict.fromkeys(gaps)
            new = {c for i in gaps for c, x in zip(chunks[i], found[i]) if x is None}
            apart = [(c, *x) for c in new if (x := self._atoms(c)) is not None]
            todo = new.difference([x[0] for x in apart])
            todo.update(a for x in apart for a in x[1:] if a not in known)
            todo = list(todo)
            known.update(zip(todo, self._encode(todo)))
            known.update((c, known[a] + known[b]) for c, a, b in apart)
            long = {c for c in [*new, *todo] if len(c) > LONG}
            for i in gaps:
                found[i] = map(known.__getitem__, chunks[i])
        out = [*map(b"".join, found)]
        for c in long:
            del known[c]
        return out

    def encode_column(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has.

        Arrow cuts the texts and numbers their distinct chunks, so that the cache is asked once per distinct chunk.
        """
        mark = mark_bytes if self.cut is cut_bytes else lambda t: "\x00".join(self.cut(t))
        odd = {i: t for i, t in enumerate(texts) if "\x00" in t}  # zero characters of their own: one chunk each
        cuts = pc.split_pattern(pa.array(["" if i in odd else mark(t) for i, t in enumerate(texts)], pa.large_string()), "\x00")
        chunks = cuts.flatten().dictionary_encode()
        distinct, number = chunks.dictionary.to_numpy(zero_copy_only=False).tolist(), chunks.indices.to_numpy()
        at = cuts.offsets.to_numpy().astype(np.int64)
        if odd:
            place = at[list(odd)] - at[0]  # an empty text has one chunk, the empty one
            number = number.copy()
            number[place] = len(distinct) + np.arange(len(odd))
            distinct += odd.values()
        blobs = self._lookup(distinct)
        width = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        first = np.cumsum(width) - width
        ids, each = np.frombuffer(b"".join(blobs), "<u4"), width[number]
        end = np.cumsum(each)
        spread = np.repeat(first[number] - (end - each), each)
        spread += np.arange(len(spread))
        ends = np.concatenate([[0], end])[at - at[0]]
        return ids[spread], np.diff(ends)

    def _lookup(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks, from the cache where it has them."""
        known = self.known
        if len(known) * ENTRY_BYTES > CACHE_BYTES:
            known.clear()
        found = [*map(known.get, chunks)]
        gaps = [i for i, x in enumerate(found) if x is None]
        if gaps:
            new = [chunks[i] for i in gaps]
            fresh = dict(zip(new, self._fresh(new), strict=True))
            for i in gaps:
                found[i] = fresh[chunks[i]]
            known.update((c, x) for c, x in fresh.items() if len(c) <= LONG)
        return found

    def _fresh(self, new: list[str]) -> list[bytes]:
        """Ids of chunks the cache does not have; the parts of those that come apart are kept as well."""
        known, parts = self.known, [self._atoms(c) for c in new]
        todo = dict.fromkeys(a for c, x in zip(new, parts) for a in (x or (c,)) if a not in known)
        todo = [*todo]
        own = dict(zip(todo, self._encode(todo), strict=True))
        known.update((c, x) for c, x in own.items() if len(c) <= LONG)
        get = lambda a: own[a] if a in own else known[a]
        return [get(c) if x is None else get(x[0]) + get(x[1]) for c, x in zip(new, parts)]


def _quiet() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side


@lru_cache(maxsize=1)
def json_encoder(path: str) -> Encoder:
    """Encoder of a tokenizers file; special strings in texts as the library handles them."""
    _quiet()
    own_caches(("ids", path), json_encoder.cache_clear)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    text = t.to_str().replace(" ", "")
    words = '"end_of_word_suffix":"</w>"' in text
    letters = '"normalizer":null' in text and '"use_regex":true' in text and not words  # the byte-level pattern of the library
    return Encoder(t, cut_words if words else cut_bytes, words, letters)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The merge that makes each token: its bytes merged by lower ranks until two parts are left."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


@lru_cache(maxsize=1)
def rank_encoder(path: str, pattern: str) -> Encoder:
    """Encoder of a rank file: each match of the pattern on its own, no special tokens."""
    _quiet()
    own_caches(("ranks", path), rank_encoder.cache_clear)
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, table = read_ranks(path), byte_table()
    name = lambda b: "".join(table[x] for x in b)
    model = models.BPE({name(b): i for b, i in ranks.items()}, [(name(a), name(b)) for a, b in merges_of(ranks)], ignore_merges=True)
    t = Tokenizer(model)
    t.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return Encoder(t, cut_bytes)


@lru_cache(maxsize=4)
def id_bytes(path: str) -> list[bytes]:
    """The bytes of each id, by reversing the byte table of the vocabulary's strings."""
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for b, i in ranks.items():
        out[i] = b
    return out
