"""A byte-level BPE vocabulary as a lazily determinised finite-state transducer, and an incremental decoder.

Greedy merging splits a text into tokens such that every two neighbours are *stable*: merging their joint bytes gives
the same two tokens. For every prefix of the input exactly one vocabulary token ends there and is stable after the
token before it. A left-to-right machine therefore needs, for each position since which some vocabulary token may
still be under way, only the trie node reached since and the token that ended there. Such sets are the states; an arc
also says which token ends at its byte. States and arcs are built when an input first needs them and kept. A token is final
once all positions under way follow from it, so the lookahead is bounded by the longest vocabulary entry.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import pack

import regex

#: The pre-splitting pattern of the vocabulary (fixed value, public).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for text of ASCII only, where the standard library's faster engine can say it.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"

#: Arcs, and whole chunks, that a machine keeps before it starts afresh; bounds its memory, not its results.
ARCS_KEPT = 300_000
CHUNKS_KEPT = 200_000
#: Bytes after which a token is final: the longest entry of the vocabulary.
LOOKAHEAD = 128
#: Bytes from which a chunk is read by emitting final tokens instead of to its end.
LONG_CHUNK = 1_024


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Transducer:
    """Encoder for one vocabulary of ``token bytes -> rank``, where rank is id and merge priority."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._size = {i: len(b) for b, i in ranks.items()}
        self._split = regex.compile(PATTERN).findall
        self._split_ascii = re.compile(ASCII_PATTERN).findall
        self._stable: dict[int, bool] = {}
        self._parts: dict[int, tuple[int, int]] = {}
        #: trie of the vocabulary: per node its arcs and, under -1, the token that ends there
        self._trie: list[dict[int, int]] = [{}]
        self._depth = [0]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                to = self._trie[node].get(b)
                if to is None:
                    to = self._trie[node][b] = len(self._trie)
                    self._trie.append({})
                    self._depth.append(self._depth[node] + 1)
                node = to
            self._trie[node][-1] = rank
        self._clear()
        self._chunks: dict[str, bytes] = {}

    def _clear(self) -> None:
        #: A state: trie nodes under way since some position, each with the token before that position (-1: the start), as node << 20 | token + 1.
        self._states: list[tuple[int, ...]] = [(0,)]
        self._number: dict[tuple[int, ...], int] = {(0,): 0}
        #: (state, byte) -> (state, token that ends here)
        self._arcs: dict[int, tuple[int, int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain merging by rank, the definition that stability refers to."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def parts_of(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``; (-1, -1) of a single byte, (-2, -2) if merging never makes it."""
        known = self._parts.get(token)
        if known is None:
            data = self.bytes_of[token]
            known = (-1, -1)
            if len(data) > 1:
                parts = [data[i : i + 1] for i in range(len(data))]
                while len(parts) > 2:
                    best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                    if best >= token:
                        break
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                known = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-2, -2)
            self._parts[token] = known
        return known

    def stable(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: the start of a chunk).

        Two tokens are unstable if, while both are being merged, a merge across their border comes before the next one
        inside: the border's two inner parts are followed from the whole tokens backwards in the order of the merges.
        """
        key = left << 20 | right
        known = self._stable.get(key)
        if known is None:
            known = self._stable[key] = self.parts_of(right)[0] != -2 and (left < 0 or self._border_holds(left, right))
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        ranks, bytes_of = self.ranks, self.bytes_of
        before = 1 << 60  # rank of the merge that ended the present border: a crossing merge must come earlier, on the left side as early
        while True:
            across = ranks.get(bytes_of[left] + bytes_of[right])
            if across is not None and across < before:
                return False
            inner_left, inner_right = self.parts_of(left)[1], self.parts_of(right)[0]
            if inner_left < 0 and inner_right < 0:
                return True
            # undo the later of the two merges that made the border's sides
            if inner_right < 0 or (inner_left >= 0 and left > right):
                before, left = left, inner_left
            else:
                before, right = right + 1, inner_right

    def _arc(self, number: int, byte: int) -> tuple[int, int]:
        """Builds the arc of a state and a byte."""
        on, here, trie = [], -1, self._trie
        for entry in self._states[number]:
            child = trie[entry >> 20].get(byte)
            if child is None:
                continue
            arcs = trie[child]
            token = arcs.get(-1)
            if token is None:
                on.append(child << 20 | entry & 0xFFFFF)
            else:
                if len(arcs) > 1:
                    on.append(child << 20 | entry & 0xFFFFF)
                if here < 0 and self.stable((entry & 0xFFFFF) - 1, token):
                    here = token
        if here < 0:
            raise ValueError("the vocabulary lacks single bytes")
        on.append(here + 1)
        state = tuple(on)
        to = self._number.get(state)
        if to is None:
            to = self._number[state] = len(self._states)
            self._states.append(state)
        self._arcs[number << 8 | byte] = arc = (to, here)
        return arc

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """Tokens of one chunk: the last tokens of all prefixes, followed back from the end; long chunks are read as a stream."""
        if len(self._arcs) > ARCS_KEPT:
            self._clear()
        if len(data) > LONG_CHUNK:
            return tuple(self.stream(data))
        at, arcs, last = 0, self._arcs, []
        for byte in data:
            at, token = arcs.get(at << 8 | byte) or self._arc(at, byte)
            last.append(token)
        out, end, size = [], len(last), self._size
        while end:
            token = last[end - 1]
            out.append(token)
            end -= size[token]
        return tuple(out[::-1])

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of one chunk of any length as they become final, which is looked up every ``LOOKAHEAD`` bytes.

        What follows continues from one of the positions that the state has under way, so the tokens that the paths to all of them share are final.
        """
        at, last, read = 0, [], 0
        for byte in data:
            at, token = self._arcs.get(at << 8 | byte) or self._arc(at, byte)
            last.append(token)
            read += 1
            if read >= LOOKAHEAD:
                read = 0
                paths = [self._path(last, len(last) - self._depth[entry >> 20]) for entry in self._states[at]]
                final = next((k for k, same in enumerate(zip(*paths)) if len(set(same)) > 1), min(map(len, paths)))
                yield from paths[0][:final]
                del last[: sum(self._size[t] for t in paths[0][:final])]
        yield from self._path(last, len(last))

    def _path(self, last: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end - 1])
            end -= self._size[last[end - 1]]
        return out[::-1]

    def packed(self, text: str | None) -> bytes:
        """Ids of ``text`` as packed 32-bit integers; none of null and of empty text.

        Names of special tokens are ordinary text. Arcs over whole chunks seen before are kept beside those over bytes.
        """
        if not text:
            return b""
        known = self._chunks
        words = self._split_ascii(text) if text.isascii() else self._split(text)
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        if len(known) > CHUNKS_KEPT:
            known.clear()
        for w in words:
            if w not in known:
                ids = self.encode_bytes(w.encode())
                known[w] = pack(f"={len(ids)}i", *ids)
        return b"".join(map(known.__getitem__, words))

    def encode(self, text: str | None) -> list[int]:
        return list(memoryview(self.packed(text)).cast("i"))

    def count(self, text: str | None) -> int:
        return len(self.packed(text)) // 4

    def counts(self, text: str | None) -> tuple[int, int]:
        """Tokens of ``text``, and how many of them lie before its body, where it has a preamble."""
        start = (text or "").find("\\begin{document}")
        return self.count(text), self.count(text[:start]) if start > 0 else 0

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of a stream of ids, piece by piece, as soon as its characters are complete."""
        machine = Utf8Machine()
        for i in ids:
            if piece := machine.feed(self.bytes_of[i]):
                yield piece
        if piece := machine.close():
            yield piece


class Utf8Machine:
    """Incremental UTF-8: the state is the value so far, the bytes still due and the range of the next one."""

    def __init__(self) -> None:
        self._value, self._due, self._low, self._high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if not self._due and data.isascii():
            return data.decode("ascii")
        out: list[str] = []
        for b in data:
            if self._due:
                if self._low <= b <= self._high:
                    self._value, self._due, self._low, self._high = self._value << 6 | b & 0x3F, self._due - 1, 0x80, 0xBF
                    if not self._due:
                        out.append(chr(self._value))
                    continue
                self._due, self._low, self._high = 0, 0x80, 0xBF
                out.append("�")
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self._value, self._due = b & 0x1F, 1
            elif 0xE0 <= b <= 0xEF:
                self._value, self._due = b & 0x0F, 2
                self._low, self._high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self._value, self._due = b & 0x07, 3
                self._low, self._high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        """What is left at the end: a replacement character if the last one is incomplete."""
        due, self._due = self._due, 0
        return "�" if due else ""


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """The machine of a vocabulary file, one per process."""
    with open(path, "rb") as lines:
        return Transducer({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})
