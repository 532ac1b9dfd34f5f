r"""Token ids of many texts at once, each distinct stretch of text encoded once.

A text is cut where no token can reach over.  ``space_cuts``: before a space whose left neighbour is no white space; no
token of the byte-level pattern holds such a place, nor does a piece of a vocabulary whose pieces have spaces in front
only.  ``word_cuts`` adds, for the byte-level pattern, other white space after visible text, the end of a single line
break, and the place between a letter and a mark: white space begins a new pre-token, the only look-ahead of the pattern
belongs to runs of white space, which lie whole on one side, and letters and marks never share a pre-token.  So the ids
of a text are those of its stretches one after the other, and a stretch, mostly a space and a word, is encoded when it
is first met.  The distinct stretches of a batch come from Arrow's hash table, which compares bytes; a worker process
keeps what it has encoded, in two generations of bounded size.

Stretches of one word are a pre-token each and go to the model of the tokenizer; others that begin with white space and
end in none are encoded as one text, whose ids are told apart by their lengths in bytes; what is left, one by one.
Neighbours are judged by their bytes, so that no text is searched for characters: visible ASCII, or a character whose
first byte begins no white space of Unicode.  A cut too few only makes a stretch longer.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa

#: Stretches that a worker process keeps in a generation, and the bytes of the longest one kept.
KEPT = 150_000
KEPT_BYTES = 64
#: Bytes of the texts made of new stretches.
JOINED_BYTES = 4096

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0x80:] = True
#: First bytes of the characters that Unicode calls white space, beyond ASCII.
_SPACE_LEADS = np.zeros(256, bool)
_SPACE_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


#: Bytes that begin a stretch after visible text, and marks that begin one after a letter.
_WHITE = np.zeros(256, bool)
_WHITE[[0x09, 0x0A, 0x0D, 0x20]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!\"#$%&'()*+,-./:;=?@[\\]^_`{}~")] = True  # not those that special tokens consist of
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_WORD = re.compile("[ ]?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")


def _clear(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the character before is surely visible."""
    clear = _VISIBLE[data[at - 1]]
    high = np.flatnonzero(data[at - 1] >= 0x80)
    clear[high] &= ~(_SPACE_LEADS[data[np.maximum(at[high] - 2, 0)]] | _SPACE_LEADS[data[np.maximum(at[high] - 3, 0)]])
    return clear


def space_cuts(data: np.ndarray) -> list[np.ndarray]:
    at = np.flatnonzero(data[1:] == 32) + 1
    return [at[_clear(data, at)]]


def word_cuts(data: np.ndarray) -> list[np.ndarray]:
    at = np.flatnonzero(_WHITE[data[1:]]) + 1
    white = at[_clear(data, at)]
    after = white[data[white] == 10] + 1
    after = after[after < len(data)]
    mark = np.flatnonzero(_MARK[data[1:]]) + 1
    before, lead = data[mark - 1], data[np.maximum(mark - 2, 0)]
    letter = _LETTER[before] | ((lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
    return [white, after[_VISIBLE[data[after]] & ~_SPACE_LEADS[data[after]]], mark[letter]]


def stretches(data: np.ndarray, row_start: np.ndarray, cuts) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all stretches (with the end of the data), and the number of the first stretch of each row."""
    begin = np.zeros(len(data) + 1, bool)
    for at in cuts(data):
        begin[at] = True
    begin[row_start] = True
    begin[len(data)] = True
    starts = np.flatnonzero(begin)
    return starts, np.searchsorted(starts, row_start)


def _joinable(stretch: bytes) -> bool:
    return stretch[0] in b" \t\n\r" and 0x21 <= stretch[-1] <= 0x7E


def _packed(ids: Sequence[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class ChunkCoder:
    """Ids of stretches by ``encode``, a function of a list of texts to a list of id lists.

    ``length`` gives the bytes of every id; an id of a length below 0 has none, and stretches with it are encoded alone.
    ``word`` gives the ids of one word with at most one space before it; ``cuts`` the places to cut at; ``kept`` the
    stretches of a generation, by default KEPT.
    """

    def __init__(self, encode: Callable[[list[str]], list[Sequence[int]]], length: np.ndarray, word: Callable[[str], Sequence[int]] | None = None, cuts=space_cuts,
                 kept: int | None = None):
        self.encode, self.length, self.word, self.cuts, self.kept = encode, length, word, cuts, kept
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def of(self, stretches: list[bytes]) -> list[bytes]:
        """Ids of every stretch, as little-endian unsigned 32-bit integers."""
        out = list(map(self.young.get, stretches))
        missing = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            if (ids := self.old.get(stretches[i])) is None:
                missing.append(i)
            else:
                out[i] = ids
                self._keep(stretches[i], ids)
        for i, ids in zip(missing, self._new([stretches[i] for i in missing])):
            out[i] = ids
            self._keep(stretches[i], ids)
        return out

    def _keep(self, stretch: bytes, ids: bytes) -> None:
        if len(stretch) > KEPT_BYTES:
            return
        if len(self.young) >= (self.kept or KEPT):
            self.old, self.young = self.young, {}
        self.young[stretch] = ids

    def forget(self) -> None:
        """Gives the memory of what is kept back."""
        self.young, self.old = {}, {}

    def _alone(self, stretches: list[bytes]) -> list[bytes]:
        return [_packed(ids) for ids in self.encode([s.decode() for s in stretches])]

    def _new(self, stretches: list[bytes]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(stretches)
        if self.word:
            for i, s in enumerate(stretches):
                if _WORD.fullmatch(text := s.decode()):
                    out[i] = _packed(self.word(text))
        join = [i for i, s in enumerate(stretches) if out[i] is None and _joinable(s)]
        texts, members, size = [], [], JOINED_BYTES
        for i in join:
            if size >= JOINED_BYTES:
                texts.append([])
                members.append([])
                size = 0
            texts[-1].append(stretches[i])
            members[-1].append(i)
            size += len(stretches[i])
        for part, ids in zip(members, self.encode([b"".join(t).decode() for t in texts]) if texts else []):
            ids = np.array(ids, "<u4")
            length = self.length[ids]
            reach = np.concatenate([[0], np.cumsum(length)])
            ends = np.cumsum([len(stretches[i]) for i in part])
            spot = np.searchsorted(reach, ends)
            if (length < 0).any() or reach[-1] != ends[-1] or (reach[np.minimum(spot, len(reach) - 1)] != ends).any():
                continue  # not what the bytes say: encoded alone below
            for i, a, b in zip(part, [0, *spot[:-1]], spot):
                out[i] = ids[a:b].tobytes()
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._alone([stretches[i] for i in rest]) if rest else []):
            out[i] = ids
        return out


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct stretches and the number of each occurrence's."""
    if len(starts) < 2:
        return [], np.zeros(0, np.int64)
    offsets = pa.py_buffer(np.ascontiguousarray(starts, np.int64))
    values = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(data))])
    coded = values.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy()


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ... as one array."""
    total = np.cumsum(count)
    return np.repeat(first - (total - count), count) + np.arange(int(total[-1]) if len(total) else 0)


def encode_rows(coder: ChunkCoder, data: np.ndarray, row_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows in one array, and the offsets of the rows in it."""
    starts, first = stretches(data, row_start, coder.cuts)
    words, which = distinct(data, starts)
    coded = coder.of(words)
    count = np.array([len(c) // 4 for c in coded], np.int64)
    flat = np.frombuffer(b"".join(coded), "<u4")
    begin = np.cumsum(count) - count
    reach = np.concatenate([[0], np.cumsum(count[which])]) if len(which) else np.zeros(1, np.int64)
    return flat[spread(begin[which], count[which])], reach[first]


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(0x100 + i): b for i, b in enumerate(others)}}


def byte_level_tokens(tokenizer) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary; an added token's are its own text's."""
    alphabet, added = byte_alphabet(), set(tokenizer.get_added_tokens_decoder())
    out = []
    for i in range(tokenizer.get_vocab_size(with_added_tokens=True)):
        token = tokenizer.id_to_token(i)
        out.append(token.encode() if i in added else bytes(alphabet[c] for c in token))
    return out


def byte_level_coder(path: str, plain_specials: bool = False, kept: int | None = None) -> ChunkCoder:
    """The coder of a tokenizers file; with ``plain_specials`` special tokens' strings are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain_specials
    length = np.array([len(t) for t in byte_level_tokens(tokenizer)], np.int64)

    def encode(texts: list[str]) -> list[Sequence[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    as_letters = {b: c for c, b in byte_alphabet().items()}
    model, space = tokenizer.model, as_letters[32]

    def word(text: str) -> Sequence[int]:
        if text.isascii():  # letters stand for themselves
            return [t.id for t in model.tokenize(text.replace(" ", space))]
        return [t.id for t in model.tokenize(text.encode().decode("latin-1").translate(as_letters))]

    return ChunkCoder(encode, length, word, word_cuts, kept)


_coders: dict = {}


def coder_of_worker(make):
    """The coder of this worker process: reading a vocabulary takes a second, and what it has encoded stays."""
    if make not in _coders:
        _coders[make] = make()
    return _coders[make]


def default_coder() -> ChunkCoder:
    """The public 50k byte-level vocabulary."""
    import public_tokenizers

    return byte_level_coder(public_tokenizers.path("byte_bpe_50k.json"))
