"""Arrow and NumPy kernels over whole texts that the operators share. Every function works on one bounded slice at a time."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes of text each, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
        pa.default_memory_pool().release_unused()


def gathered_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches put together or cut so that each holds about that many bytes of text, or one row: what is distinct is met once in each."""
    held: list[pa.RecordBatch] = []
    size = 0

    def together() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        for part in slices(batch, column, most):
            n = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if held and size + n > most:
                yield together()
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield together()


def texts_of(column: pa.Array) -> pa.Array:
    """As large strings, null as empty, in one chunk."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    # a copy of its own: kernels that rewrite letters take the offsets of a slice for those of a whole array
    return column.take(pa.array(np.arange(len(column))))


def flat_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ([^\\x20\\x09-\\x0D]+) in order, and the number of words of each text."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    lengths = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    real = np.asarray(pc.not_equal(words, ""))
    if not real.all():
        owner = np.repeat(np.arange(len(texts)), lengths)
        lengths = np.bincount(owner[real], minlength=len(texts))
        words = words.filter(pa.array(real))
    return words, lengths


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words and the distinct words they stand for."""
    d = words.dictionary_encode()
    return np.asarray(d.indices, dtype=np.int64), d.dictionary


def strings_of(x: pa.Array) -> list[str]:
    """Python strings, several times as fast as by scalars."""
    return x.to_numpy(zero_copy_only=False).tolist()


def hashes_of(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct strings."""
    import xxhash

    one = xxhash.xxh3_64_intdigest
    return np.fromiter(map(one, strings_of(distinct)), dtype=np.uint64, count=len(distinct))


def word_hashes(words: pa.Array) -> np.ndarray:
    codes, distinct = coded(words)
    return hashes_of(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)


#: Bytes that separate words.
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
BLOCK_BYTES = 1 << 19
LONG_WORD = 256


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1), modulo 2**64."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class ByteHash:
    """Hashes of words straight from bytes: a polynomial over a random value for each byte, mixed with the length; words beyond 256 bytes by xxh3. A-Z count as a-z."""

    BASE = 0xD1342543DE82EF95

    def __init__(self):
        self.value = np.random.default_rng(0xC0FFEE).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.value[65:91] = self.value[97:123]
        self.blank = np.zeros(256, bool)
        self.blank[list(BLANKS)] = True
        n = BLOCK_BYTES + LONG_WORD
        self.up, self.down = powers(self.BASE, n), powers(pow(self.BASE, -1, 1 << 64), n)

    def words(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every word in order, and the unit it lies in; unit i holds data[bounds[i] : bounds[i + 1]]."""
        solid = ~self.blank[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last[:-1] &= ~solid[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        size = ends - starts
        out = np.empty(len(starts), np.uint64)
        long = np.flatnonzero(size > LONG_WORD)
        short = np.flatnonzero(size <= LONG_WORD) if len(long) else np.arange(len(starts))
        s, e = starts[short], ends[short]
        at = 0
        while at < len(s):
            to = int(np.searchsorted(s, s[at] + BLOCK_BYTES))
            low, high = s[at], e[to - 1]
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(self.value[data[low:high]] * self.up[: high - low], out=sums[1:])
            a, b = s[at:to] - low, e[at:to] - low
            out[short[at:to]] = (sums[b] - sums[a]) * self.down[a]
            at = to
        if len(long):
            import xxhash

            for i in long.tolist():
                out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes().lower())
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(starts, bounds)))
        return mixed(out ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), owner


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of large strings, one text after another, and where each begins and the last ends."""
    _, offsets, values = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8)[ends[0] : ends[-1]] if values is not None and len(texts) else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def blobs(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values, each of that many of the given items in a row."""
    offsets = (starts_of(lengths) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def unblobbed(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """All items of a binary column without nulls, in order, and how many each row holds."""
    _, offsets, values = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or ends[0] == ends[-1]:
        return np.zeros(0, kind), np.zeros(len(column), np.int64)
    return np.frombuffer(values, np.uint8)[ends[0] : ends[-1]].view(kind), np.diff(ends) // np.dtype(kind).itemsize


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each run, one run after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(0x100 + hidden.index(b)) for b in range(256)]


class Encoder:
    """Ids of whole texts by a tokenizers file. Each distinct piece of a slice is encoded once, and kept for the slices that follow.

    words: the tokenizer lower-cases and drops white space, so that the pieces are the words. Else pieces are words with the
    single space before them, and line feeds; a text where a space or a line feed stands beside other white space is
    encoded whole. A piece of Latin letters, with ASCII marks after them or not, goes straight to the tokenizer's
    model, as its letters are one pre-token and its marks another; all others take the whole tokenizer.
    """

    #: a space or line feed at an end, or beside white space or a control character
    UNSAFE = r"(?s)^[ \n]|[ \n]$|[\s\pZ\pC][ \n]|[ \n][\s\pZ\pC]|\x00"
    KEPT = 250_000
    #: ASCII marks but the apostrophe, which starts pre-tokens of its own
    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.bpe = self.model.model
        self.words = words
        self.known: dict[str, bytes] = {}
        self.bytes = byte_alphabet()
        self.marks = {m: self._whole([m])[0] for m in ".,"}
        self.common: dict[str, bytes] = {}

    def _whole(self, pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(pieces, add_special_tokens=False)]

    def _letters(self, piece: str) -> bytes | None:
        """The ids of a piece of letters below U+0250 (where case and composition have no context), or None."""
        tail = b""
        if piece[-1] in self.MARKS:
            letters = piece.rstrip(self.MARKS)
            if not letters:
                return None
            mark = piece[len(letters) :]
            tail, piece = self.marks.get(mark), letters
            if tail is None:
                tail = self._whole([mark])[0]
                if len(self.marks) < 10_000:
                    self.marks[mark] = tail
        space = not self.words and piece[0] == " "
        core = piece[1:] if space else piece
        if not core.isalpha():
            return None
        if core.isascii():
            mapped = core.lower() if self.words else core
        elif max(core) < "\u0250" and "\u0130" not in core:
            alphabet = self.bytes
            mapped = "".join([alphabet[b] for b in (core.lower() if self.words else core).encode()])
        else:
            return None
        ids = [t.id for t in self.bpe.tokenize(self.bytes[32] + mapped if space else mapped)]
        return array("I", ids).tobytes() + tail

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # pieces met again are kept for good, up to a number; new ones are kept until there are too many
        if len(self.known) > self.KEPT:
            self.known = {}
        common, known = self.common, self.known
        out = [common.get(p) for p in pieces]
        hard = []
        for i, x in enumerate(out):
            if x is None:
                p = pieces[i]
                x = known.get(p)
                if x is not None:
                    if len(common) < self.KEPT:
                        common[p] = x
                else:
                    x = self._letters(p) if p else b""
                    if x is None:
                        hard.append(i)
                        continue
                    known[p] = x
                out[i] = x
        for i, x in zip(hard, self._whole([pieces[i] for i in hard]), strict=True):
            out[i] = x
            if len(pieces[i]) < 64:
                known[pieces[i]] = x
        lengths = np.fromiter(map(len, out), dtype=np.int64, count=len(out)) // 4
        return np.frombuffer(b"".join(out), np.uint32), lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        if self.words:
            pieces, counts = flat_words(texts)
            return self._by_piece(pieces, counts)
        unsafe = np.asarray(pc.match_substring_regex(texts, self.UNSAFE))
        cut = pc.replace_substring(pc.replace_substring(texts, "\n", "\x00\n\x00"), " ", "\x00 ")
        if unsafe.any():
            whole = np.flatnonzero(unsafe)
            rest = np.flatnonzero(~unsafe)
            raw = self._whole(strings_of(texts.take(pa.array(whole))))
            a, an = np.frombuffer(b"".join(raw), np.uint32), np.array([len(x) // 4 for x in raw], np.int64)
            b, bn = self._split(cut.take(pa.array(rest)))
            lengths = np.zeros(len(texts), np.int64)
            lengths[whole], lengths[rest] = an, bn
            out = np.empty(int(lengths.sum()), np.uint32)
            starts = starts_of(lengths)[:-1]
            out[gathered(starts[whole], an)] = a
            out[gathered(starts[rest], bn)] = b
            return out, lengths
        return self._split(cut)

    def _split(self, cut: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(cut, "\x00")
        return self._by_piece(lists.flatten(), np.asarray(pc.list_value_length(lists), dtype=np.int64))

    def _by_piece(self, pieces: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(pieces):
            return np.zeros(0, np.uint32), np.zeros(len(counts), np.int64)
        codes, distinct = coded(pieces)
        flat, lengths = self._each(strings_of(distinct))
        starts = starts_of(lengths)[:-1]
        each = lengths[codes]
        ids = flat[gathered(starts[codes], each)]
        ends = starts_of(each)[np.cumsum(counts)]
        return ids, np.diff(ends, prepend=0)


_ENCODERS: dict = {}


def encoder(path: str, words: bool) -> Encoder:
    """The worker's own encoder, loaded once."""
    if (path, words) not in _ENCODERS:
        _ENCODERS[path, words] = Encoder(path, words)
    return _ENCODERS[path, words]
