"""Byte-level BPE encoding and decoding.

The merge loop keeps a doubly linked list of symbols and a priority queue of merge ranks; an entry of the queue whose
symbols have changed since is stale and skipped. Decoding concatenates the vocabulary's byte strings. A text is first cut
into words as the vocabulary's pre-tokenizer cuts it; words recur, so their ids are kept in a bounded table.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import tiktoken

from .shared import rows_of

#: The pre-tokenizer's pattern, white space in its sense, and the table of printable bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
ODD = ["  ", "\n\n", " \n", "\n ", *"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B))]
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from 256."""
    others = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(others)}


class _Words(dict):
    """Ids, as bytes, of the words that follow a prefix; made when first asked for. Two generations: when the younger has
    grown to its limit it becomes the older one, which goes; words in use are taken over."""

    def __init__(self, make, prefix: str, limit: int):
        self.make, self.prefix, self.limit, self.old = make, prefix, limit, {}

    def __missing__(self, word: str) -> bytes:
        if (out := self.old.get(word)) is None:
            out = self.make(self.prefix + word)
            if len(word) > 48:
                return out
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out


class ByteBPE:
    """Encoder and decoder of a tokenizer file of the byte-level BPE kind. Strings of special tokens in a text are encoded as these."""

    def __init__(self, path: str, limit: int = 150_000, whole_words: bool = False):
        """limit: of the tables of words. whole_words: the tokenizer library's own merge loop encodes words not seen yet, which is faster."""
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = {to_bytes(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        strings = {i: s for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        parts = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.lengths = np.array([len(x) for x in parts])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.letters = np.frombuffer(b"".join(parts), np.uint8)
        self.of_byte = [vocab[bytes([b])] for b in range(256)]
        #: By pair of ids, the merge's rank and the id it makes.
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = map(to_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            self.ranks[vocab[a] << 24 | vocab[b]] = rank << 24 | vocab[a + b]
        self.split = regex.compile(PATTERN).findall
        self.gaps = re.compile(f"((?! )[{SPACE}][{SPACE}]*| [{SPACE}]+)")
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        make = self._word
        if whole_words:
            whole = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={}).encode_ordinary
            make = lambda word: struct.pack(f"<{len(ids := whole(word))}I", *ids)
        self.pieces = _Words(self._piece, "", limit // 2)
        self.first, self.later = _Words(make, "", limit // 4), _Words(make, " ", limit)
        self.newline = self.pieces["\n"]

    def merge(self, ids: list[int]) -> list[int]:
        """All merges on a list of symbols: least rank first, leftmost of equal ranks first."""
        n, rank_of = len(ids), self.ranks.get
        if n < 2:
            return ids
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [r << 32 | i for i in range(n - 1) if (r := rank_of(ids[i] << 24 | ids[i + 1]))]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            j = right[i]
            if j >= n or ids[i] < 0 or rank_of(ids[i] << 24 | ids[j]) != r:
                continue  # stale
            new = ids[i] = r & 0xFFFFFF
            ids[j] = -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if r := rank_of(new << 24 | ids[k]):
                    heappush(queue, r << 32 | i)
            if (h := left[i]) >= 0 and (r := rank_of(ids[h] << 24 | new)):
                heappush(queue, r << 32 | h)
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> bytes:
        ids = self.merge([self.of_byte[b] for b in piece.encode("utf-8", "surrogatepass")])
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        return b"".join([self.pieces[p] for p in self.split(word)])

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens. Single spaces part words that don't influence each other; other gaps are cut out."""
        out: list[bytes] = []
        later, first = self.later.__getitem__, self.first
        if not any(x in text for x in ODD if ord(x[0]) < 128 or not text.isascii()) and text[0] not in " \n" and text[-1] not in " \n":
            for line in text.split("\n"):
                words = line.split(" ")
                out.append(first[words[0]])
                words[0] = ""
                out += map(later, filter(None, words))
                out.append(self.newline)
            out.pop()
            return b"".join(out)
        parts = self.gaps.split(text)
        lead = False  # the gap's last space belongs to the next word
        for k, part in enumerate(parts):
            if k % 2:
                last = k == len(parts) - 2 and not parts[-1]
                head, tail = (part, "") if last else (part[:-1], part[-1])
                lead = tail == " "
                if head:
                    out.append(self.pieces[head])
                if tail and not lead:
                    out.append(self.pieces[tail])
            elif part:
                words = part.split(" ")
                if not k and not words[0]:  # the text begins with one space
                    words, lead = words[1:], True
                if not words[-1]:  # and ends with one
                    words.pop()
                    end = True
                else:
                    end = False
                if words:
                    if not lead:
                        out.append(first[words[0]])
                        words = words[1:]
                    out += map(later, words)
                if end:
                    out.append(self.pieces[" "])
                lead = False
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; none of a null text."""
        if not text:
            return b""
        if not self.specials or not self.specials.search(text):
            return self._plain(text)
        return b"".join(struct.pack("<I", self.special[x]) if k % 2 else self._plain(x) for k, x in enumerate(self.specials.split(text)) if x)

    def decode(self, ids: bytes) -> bytes:
        """The vocabulary's strings of all ids, one after the other; of bytes that aren't UTF-8, what a lossy decoder makes."""
        at = np.frombuffer(ids, "<u4")
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        out = self.letters[np.repeat(self.starts[at] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        return out.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def tokenizer(path: str, whole_words: bool = False) -> ByteBPE:
    """One for each Python worker."""
    return ByteBPE(path, whole_words=whole_words)


def encode_decode(docs, path: str, id_col: str = "doc_id", text_col: str = "text"):
    """Each whole text encoded and decoded again: id, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded (UTF-8).

    A null text counts as empty and has no ids. Rows may repeat, ids be null; other columns of docs are ignored. Strings
    of special tokens are encoded as these tokens and decoded as their strings. Whole texts are read, however long, one
    at a time. An empty table gives an empty result.
    """

    def run(batches):
        own = tokenizer(path)
        for b in rows_of(batches):
            ids = [own.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.binary())], names)

    src = docs.select(id_col, text_col)
    kind = src.schema[0].dataType.simpleString()
    names = [id_col, "n_tokens", "ids", "decoded"]
    return src.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded binary")
