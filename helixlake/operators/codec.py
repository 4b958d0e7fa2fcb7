"""Codecs: bytes to bits to strands and back, with index and error correction.

A file is cut into segments; each gets its index, then check bits, then becomes a strand. Decoding
runs the other way and sorts by the index. Codes are running sums or table look-ups over Arrow batches of
strings, as is Reed-Solomon; so is the fountain's peeling.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.durable import apart, durable, join_checked
from helixlake.functions import flat, rng, seqfn
from helixlake.functions.seqfn import NT
from helixlake.operators import peeling
from helixlake.sources.readers import segments_as


_HEXED = np.frombuffer("".join(f"{k:02X}" for k in range(256)).encode(), np.uint8).reshape(256, 2)


def _arrow(kind: str, run: Callable[..., pa.Array], *columns: Column) -> Column:
    return F.arrow_udf(run, kind)(*columns)


def _valid(column: pa.Array) -> np.ndarray:
    return column.is_valid().to_numpy(zero_copy_only=False)


def _base_written(x: pa.Array) -> pa.Array:
    letters = np.frombuffer(NT.encode(), np.uint8)
    data, at = flat.bytes_of(x)
    n = np.diff(at) // 2
    ends = np.concatenate([[0], np.cumsum(n)])
    if (np.diff(at) % 2).any():
        data = data[np.arange(2 * ends[-1]) + np.repeat(at[:-1] - 2 * ends[:-1], 2 * n)]
    ones = (data == 49).astype(np.uint8)
    return flat.strings(letters[2 * ones[::2] + ones[1::2]], ends, _valid(x))


def _base_read(x: pa.Array) -> pa.Array:
    table, pairs = np.zeros(256, np.uint8), np.frombuffer(b"".join(f"{k:02b}".encode() for k in range(4)), np.uint8).reshape(4, 2)
    table[[ord(c) for c in NT]] = range(1, 5)
    data, at = flat.bytes_of(x)
    rank = table[data]
    if (rank > 0).all():
        return flat.strings(pairs[rank - 1].reshape(-1), at * 2, _valid(x))
    digits = {c: f"{k:02b}" for k, c in enumerate(NT)}  # other letters stay
    return pa.array([None if s is None else "".join([digits.get(c, c) for c in s]) for s in x.to_pylist()], pa.string())


def base_encode(bits: Column) -> Column:
    """Two bits a base: 00 A, 01 C, 10 G, 11 T. An odd last bit is left out."""
    return _arrow("string", _base_written, bits)


def base_decode(seq: Column) -> Column:
    return _arrow("string", _base_read, seq)


def _church_written(x: pa.Array) -> pa.Array:
    """Of each run of equal bits every second one, from its second on, takes the other base."""
    letters = np.frombuffer(NT.encode(), np.uint8)
    data, at = flat.bytes_of(x)
    begins = np.ones(len(data), bool)
    begins[1:] = data[1:] != data[:-1]
    begins[at[:-1][np.diff(at) > 0]] = True
    places = np.arange(len(data), dtype=np.int32)
    odd = (places - np.maximum.accumulate(np.where(begins, places, 0))) & 1
    return flat.strings(letters[2 * (data == 49) + odd], at, _valid(x))


def _church_read(x: pa.Array) -> pa.Array:
    table = np.arange(256, dtype=np.uint8)
    table[[ord(c) for c in NT]] = [48, 48, 49, 49]
    data, at = flat.bytes_of(x)
    return flat.strings(table[data], at, _valid(x))


def church_encode(bits: Column) -> Column:
    """One bit a base: 0 is A or C, 1 is G or T; the first of the pair unless it would repeat the last base."""
    return _arrow("string", _church_written, bits)


def church_decode(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "0011")


ROTATION = {"A": "CGT", "C": "GTA", "G": "TAC", "T": "ACG"}


def ternary_codes() -> list[str]:
    """A prefix code of three symbols for 256 bytes: as many words of five as leave room for the rest in six."""
    split = math.ceil((256 - 243) / 2)
    words = [np.base_repr(k, 3).zfill(5) for k in range(243)]
    return (words[: 243 - split] + [w + c for w in words[243 - split :] for c in "012"])[:256]


def _octets(hexed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of hex strings, where each value's begin and the last ones end); an odd last digit is left out."""
    table = np.full(256, 16, np.uint8)
    for k, d in enumerate(seqfn.HEX):
        table[ord(d)] = table[ord(d.lower())] = k
    data, at = flat.bytes_of(hexed)
    n = np.diff(at) // 2
    ends = np.concatenate([[0], np.cumsum(n)])
    if (np.diff(at) % 2).any():
        data = data[np.arange(2 * ends[-1]) + np.repeat(at[:-1] - 2 * ends[:-1], 2 * n)]
    digits = table[data]
    if (digits > 15).any():
        raise ValueError("not a hex digit")
    return digits[::2] * 16 + digits[1::2], ends


def _packed(bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same of strings of bits, whose lengths must divide by eight."""
    data, at = flat.bytes_of(bits)
    if (at % 8).any():
        raise ValueError("the number of bits must divide by eight")
    return np.packbits(data == 49), at // 8


def _unpacked(octets: np.ndarray, at: np.ndarray, valid: np.ndarray) -> pa.Array:
    return flat.strings(48 + np.unpackbits(octets), at * 8, valid)


def _hex_of(octets: np.ndarray, at: np.ndarray, valid: np.ndarray) -> pa.Array:
    return flat.strings(_HEXED[octets].reshape(-1), at * 2, valid)


#: What turns bytes (and where each value's begin) and which values there are into strands, and back.
Written = Callable[[np.ndarray, np.ndarray, np.ndarray], pa.Array]


def _hex_written(write: Written, hexed: Column) -> Column:
    return _arrow("string", lambda x: write(*_octets(x), _valid(x)), hexed)


def _hex_read(read: Callable, seq: Column) -> Column:
    return _arrow("string", lambda x: _hex_of(*read(x), _valid(x)), seq)


@functools.cache
def _goldman_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trits + 1 of each byte in six places, which of these it has; bytes of six trits read to base 3, the last of five too, -1 for none)."""
    codes = ternary_codes()
    steps, has, known = np.zeros((256, 6), np.uint8), np.zeros((256, 6), bool), np.full(729, -1, np.int64)
    for k, c in enumerate(codes):
        steps[k, : len(c)] = [int(t) + 1 for t in c]
        has[k, : len(c)] = True
        first = int(c.ljust(6, "0"), 3)
        known[first : first + 3 ** (6 - len(c))] = k
    return steps, has, known


def _goldman_written(octets: np.ndarray, at: np.ndarray, valid: np.ndarray) -> pa.Array:
    letters = np.frombuffer(NT.encode(), np.uint8)
    steps, has, _ = _goldman_tables()
    mask = has[octets]
    ends = np.concatenate([[0], np.cumsum(mask.sum(axis=1))])[at]
    total = np.concatenate([[0], np.cumsum(steps[octets][mask], dtype=np.int64)])
    return flat.strings(letters[(total[1:] - np.repeat(total[ends[:-1]], np.diff(ends))) & 3], ends, valid)


def _goldman_read(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    rank = np.full(256, 9, np.int64)
    rank[[ord(c) for c in NT]] = range(4)
    data, at = flat.bytes_of(x)
    now = rank[data]
    last = np.concatenate([[0], now[:-1]])[: len(now)]
    last[at[:-1][np.diff(at) > 0]] = 0
    trits = (now - last - 1) & 3
    trits[(now > 3) | (last > 3)] = 3  # 3 is no trit
    # Words of five that are no byte need a sixth trit: all values go on by a word at a time.
    known, long = _goldman_tables()[2], _goldman_tables()[1].sum(axis=1)
    padded = np.concatenate([trits, np.full(6, 3)])
    here, ends, live = at[:-1].copy(), at[1:], np.arange(len(at) - 1)
    words, counts = [], np.zeros(len(at) - 1, np.int64)
    while len(live):
        live = live[here[live] + 5 <= ends[live]]
        spots = here[live]
        five = padded[spots[:, None] + np.arange(5)]
        sixth = np.where(spots + 6 <= ends[live], padded[spots + 5], 3)
        whole = (five < 3).all(axis=1)
        value = np.where(whole, five @ np.array([243, 81, 27, 9, 3]), 0)
        short = whole & (long[known[value]] == 5) & (known[value] >= 0)
        byte = np.where(short, known[value], np.where(whole & (sixth < 3), known[value + np.where(sixth < 3, sixth, 0)], -1))
        good = byte >= 0
        live, byte = live[good], byte[good]
        here[live] += np.where(short[good], 5, 6)
        counts[live] += 1
        words.append((live, byte.astype(np.uint8)))
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(at[-1]), np.uint8)
    for k, (rows, byte) in enumerate(words):
        out[at[rows] + k] = byte
    return out, at


def goldman_encode(hexed: Column) -> Column:
    """Bytes (as hex) to trits, each trit to one of the three bases that differ from the last, from A on.

    A trit t is the base t + 1 places after the last in A, C, G, T, around: strands are running sums modulo 4."""
    return _hex_written(_goldman_written, hexed)


def goldman_decode(seq: Column) -> Column:
    """Bytes as hex, up to the first base that repeats its last one or isn't one."""
    return _hex_read(_goldman_read, seq)


def grass_codons() -> list[str]:
    """47 triplets whose last two bases differ, in order."""
    return [a + b + c for a in NT for b in NT for c in NT if b != c][:47]


def _grass_written(octets: np.ndarray, at: np.ndarray, valid: np.ndarray) -> pa.Array:
    codons = np.frombuffer("".join(grass_codons()).encode(), np.uint8).reshape(47, 3)
    n = -(-np.diff(at) // 2)
    ends = np.concatenate([[0], np.cumsum(n)])
    units = flat.moved(octets, at, ends[:-1] * 2, int(ends[-1]) * 2).astype(np.int64).reshape(-1, 2) @ np.array([256, 1])
    return flat.strings(codons[np.stack([units // 2209, units // 47 % 47, units % 47], axis=1)].reshape(-1), ends * 9, valid)


def _base_units(x: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ranks of the bases of each unit of `size`, 4 for other letters, which value a unit is of, where each value's units begin and the last
    ones end). A last unit that isn't whole is left out."""
    rank = np.full(256, 4, np.int64)
    rank[[ord(c) for c in NT]] = range(4)
    data, at = flat.bytes_of(x)
    n = np.diff(at) // size
    ends = np.concatenate([[0], np.cumsum(n)])
    if (np.diff(at) % size).any():
        data = data[np.arange(size * ends[-1]) + np.repeat(at[:-1] - size * ends[:-1], size * n)]
    return rank[data].reshape(-1, size), np.repeat(np.arange(len(n)), n), ends


def _grass_read(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    known = np.full(125, -1, np.int64)
    for k, c in enumerate(grass_codons()):
        known[[25 * NT.index(c[0]) + 5 * NT.index(c[1]) + NT.index(c[2])]] = k
    ranks, which, ends = _base_units(x, 9)
    digits = known[ranks.reshape(-1, 3, 3) @ np.array([25, 5, 1])]
    good = (digits >= 0).all(axis=1)
    value = digits @ np.array([2209, 47, 1])
    value = np.where(value > 0xFFFF, value >> 4, value)[good]  # five hex digits: the first four
    counts = np.bincount(which[good], minlength=len(ends) - 1)
    return np.stack([value >> 8, value & 255], axis=1).astype(np.uint8).reshape(-1), np.concatenate([[0], np.cumsum(counts * 2)])


def grass_encode(hexed: Column) -> Column:
    """Two bytes as three digits to base 47, each digit a triplet. An odd last byte is padded with 00."""
    return _hex_written(_grass_written, hexed)


def grass_decode(seq: Column) -> Column:
    return _hex_read(_grass_read, seq)


def blawat_words() -> list[str]:
    """Five bases a byte: bit pairs set the 1st, 2nd and 4th; the 3rd and 5th together carry the last pair (the
    sum of their ranks modulo 4), chosen first in order so that no run begins or ends the word."""
    out = []
    for byte in range(256):
        a, b, d, v = (NT[byte >> s & 3] for s in (6, 4, 2, 0))
        v = NT.index(v)
        options = [(NT[k], NT[(v - k) % 4]) for k in range(4)]
        c, e = next((c, e) for c, e in options if not a == b == c and d != e)
        out.append(a + b + c + d + e)
    return out


def _blawat_written(octets: np.ndarray, at: np.ndarray, valid: np.ndarray) -> pa.Array:
    words = np.frombuffer("".join(blawat_words()).encode(), np.uint8).reshape(256, 5)
    return flat.strings(words[octets].reshape(-1), at * 5, valid)


def _blawat_read(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ranks, which, ends = _base_units(x, 5)
    good = (ranks < 4).all(axis=1)
    a, b, c, d, e = ranks[good].T
    counts = np.bincount(which[good], minlength=len(ends) - 1)
    return (a * 64 + b * 16 + d * 4 + (c + e) % 4).astype(np.uint8), np.concatenate([[0], np.cumsum(counts)])


def blawat_encode(hexed: Column) -> Column:
    return _hex_written(_blawat_written, hexed)


def blawat_decode(seq: Column) -> Column:
    return _hex_read(_blawat_read, seq)


def yin_yang_encode(yang: Column, yin: Column) -> Column:
    """Two bit rows of equal length in one strand. The yang bit chooses A/T or C/G; the yin bit chooses within,
    the other way round after C or T.

    The choice within is the parity of the yin bits so far and the yang bits before: a running sum."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        (first, at), (second, _) = flat.bytes_of(a), flat.bytes_of(b)
        return _fused(first == 49, second == 49, at, _valid(a))

    return _arrow("string", run, yang, yin)


def _fused(yang: np.ndarray, yin: np.ndarray, at: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    letters = np.frombuffer(b"ATCG", np.uint8)
    y, x = yang.astype(np.int64), yin.astype(np.int64)
    total = np.concatenate([[0], np.cumsum(y + x)])
    within = (total[1:] - np.repeat(total[at[:-1]], np.diff(at)) - y) % 2
    return flat.strings(letters[2 * y + within], at, valid)


def yin_yang_strands(rows: DataFrame, segment: int, key: str = "file_id", data: str = "data") -> DataFrame:
    """file_id, pos, seq: what `yin_yang_pairs` makes of the files' segments. Neighbouring segments are one of twice the length, whose
    padding is what an odd last one is paired with, so a batch of files goes through at once and nothing is exchanged."""

    def write(_: np.ndarray, bits: np.ndarray) -> pa.Array:
        return _fused(bits[:, :segment].reshape(-1), bits[:, segment:].reshape(-1), np.arange(len(bits) + 1, dtype=np.int64) * segment)

    return segments_as(rows, key, F.col(data), 2 * segment, write, "seq").withColumnRenamed("seg_no", "pos")


def yin_yang_decode(seq: Column) -> tuple[Column, Column]:
    table = np.zeros(256, np.int8)
    table[[ord(c) for c in "TG"]] |= 1  # within
    table[[ord(c) for c in "CT"]] |= 2  # turns the next one round

    def run(s: pa.Array) -> pa.Array:
        data, at = flat.bytes_of(s)
        found = table[data]
        turned = np.concatenate([[0], found[:-1] >> 1])[: len(found)]
        turned[at[:-1][np.diff(at) > 0]] = 0
        return flat.strings((48 + ((found & 1) ^ turned)).astype(np.uint8), at, _valid(s))

    return F.translate(seq, "ATCG", "0011"), _arrow("string", run, seq)


def hamming_checks(m: int) -> int:
    """Check bits of a single-error-correcting code over m data bits."""
    r = 0
    while 2**r < m + r + 1:
        r += 1
    return r


def _spots(m: int) -> list[int]:
    n = m + hamming_checks(m)
    return [p for p in range(1, n + 1) if p & (p - 1)]


def _hamming_written(x: pa.Array, m: int) -> pa.Array:
    spots, r = _spots(m), hamming_checks(m)
    masks = np.array([[p >> k & 1 for k in range(r)] for p in spots], np.float32)
    data, at = flat.bytes_of(x)
    if (np.diff(at)[_valid(x)] != m).any():
        raise ValueError(f"a segment has other than {m} bits")
    ones = (data == 49).astype(np.uint8).reshape(-1, m)
    out = np.empty((len(ones), m + r), np.uint8)
    out[:, [p - 1 for p in spots]] = ones
    out[:, [(1 << k) - 1 for k in range(r)]] = (ones.astype(np.float32) @ masks).astype(np.int64) % 2
    return flat.strings(48 + out.reshape(-1), np.concatenate([[0], np.cumsum(_valid(x) * (m + r))]), _valid(x))


def hamming_insert(bits: Column, m: int) -> Column:
    """Codeword of m data bits: a check bit at each power of two makes the places of all 1 bits XOR to 0."""
    return _arrow("string", lambda x: _hamming_written(x, m), bits)


def _hamming_read(x: pa.Array, m: int) -> tuple[pa.Array, pa.Array]:
    spots, r = _spots(m), hamming_checks(m)
    n = m + r
    masks = np.array([[p >> k & 1 for k in range(r)] for p in range(1, n + 1)], np.float32)
    places = np.array(spots) - 1
    data, at = flat.bytes_of(x)
    whole = np.diff(at) == n
    rows = data[np.repeat(whole, np.diff(at))].reshape(-1, n).copy()
    s = ((rows == 49).astype(np.float32) @ masks).astype(np.int64) % 2 @ (1 << np.arange(r))
    hit = np.flatnonzero((s > 0) & (s <= n))
    rows[hit, s[hit] - 1] ^= 1
    right = flat.rows_of(np.ascontiguousarray(rows[:, places]))
    if whole.all():
        return right, pa.array(s != 0)
    given, found, flags = x.to_pylist(), iter(right.to_pylist()), iter((s != 0).tolist())
    out = [next(found) if ok else None if w is None else "".join(w[p] for p in places if p < len(w)) for ok, w in zip(whole, given, strict=True)]
    return pa.array(out, pa.string()), pa.array([next(flags) if ok else None for ok in whole], pa.bool_())


def hamming_remove(word: Column, m: int) -> tuple[Column, Column]:
    """(data bits with a single error corrected, whether the word had an error: null for one of another length)."""
    found = _arrow("struct<bits: string, wrong: boolean>", lambda x: pa.StructArray.from_arrays(list(_hamming_read(x, m)), ["bits", "wrong"]), word)
    return found["bits"], found["wrong"]


class ReedSolomon:
    """Codes over GF(256) with the polynomial x^8 + x^4 + x^3 + x^2 + 1 and `checks` check bytes."""

    def __init__(self, checks: int):
        self.checks = checks
        self.exp, self.log = [0] * 512, [0] * 256
        x = 1
        for k in range(255):
            self.exp[k], self.log[x] = x, k
            x <<= 1
            if x & 256:
                x ^= 0x11D
        self.exp[255:510] = self.exp[:255]
        self.generator = [1]
        for k in range(checks):
            self.generator = self._times(self.generator, [1, self.exp[k]])

    def _mul(self, a: int, b: int) -> int:
        return self.exp[self.log[a] + self.log[b]] if a and b else 0

    def _div(self, a: int, b: int) -> int:
        return self.exp[self.log[a] - self.log[b] + 255] if a else 0

    def _times(self, p: list[int], q: list[int]) -> list[int]:
        out = [0] * (len(p) + len(q) - 1)
        for i, a in enumerate(p):
            for j, b in enumerate(q):
                out[i + j] ^= self._mul(a, b)
        return out

    def _at(self, p: list[int], x: int) -> int:
        y = 0
        for c in p:
            y = self._mul(y, x) ^ c
        return y

    def encode(self, data: bytes) -> bytes:
        rest = list(data) + [0] * self.checks
        for k in range(len(data)):
            if lead := rest[k]:
                for j, g in enumerate(self.generator):
                    rest[k + j] ^= self._mul(g, lead)
        return data + bytes(rest[len(data) :])

    def decode(self, word: bytes) -> tuple[bytes, bool]:
        """(data, whether it could be made right). Up to checks // 2 wrong bytes are corrected."""
        syndromes = [self._at(list(word), self.exp[k]) for k in range(self.checks)]
        if not any(syndromes):
            return word[: len(word) - self.checks], True
        locator, before, shift, gap, b = [1], [1], 0, 1, 1
        for k in range(self.checks):
            delta = syndromes[k]
            for j in range(1, shift + 1):
                if j < len(locator):
                    delta ^= self._mul(locator[-1 - j], syndromes[k - j])
            if not delta:
                gap += 1
                continue
            scaled = [self._mul(c, self._div(delta, b)) for c in before] + [0] * gap
            size = max(len(locator), len(scaled))
            new = [x ^ y for x, y in zip([0] * (size - len(locator)) + locator, [0] * (size - len(scaled)) + scaled, strict=True)]
            if 2 * shift <= k:
                before, b, shift, gap = locator, delta, k + 1 - shift, 1
            else:
                gap += 1
            locator = new
        spots = [k for k in range(len(word)) if self._at(locator, self.exp[255 - k]) == 0]
        if len(spots) != shift or shift > self.checks // 2:
            return word[: len(word) - self.checks], False
        product = self._times(syndromes[::-1], locator)[-self.checks :]
        slope = [c if (len(locator) - 1 - k) % 2 else 0 for k, c in enumerate(locator)][:-1]
        out = bytearray(word)
        for k in spots:
            inverse = self.exp[255 - k]
            bottom = self._at(slope, inverse)
            if not bottom:
                return word[: len(word) - self.checks], False
            out[len(word) - 1 - k] ^= self._mul(self._div(self._at(product, inverse), bottom), self.exp[k])
        good = not any(self._at(list(out), self.exp[k]) for k in range(self.checks))
        return bytes(out[: len(word) - self.checks]), good


    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(exp, log, products of any two bytes) as arrays."""
        exp, log = np.array(self.exp), np.array(self.log)
        times = exp[log[:, None] + log[None, :]].astype(np.uint8)
        times[0, :] = times[:, 0] = 0
        return exp, log, times

    def encode_rows(self, rows: np.ndarray) -> np.ndarray:
        """`encode` of the rows of a table of bytes."""
        times, n = self.tables()[2], rows.shape[1]
        rest = np.concatenate([rows, np.zeros((len(rows), self.checks), np.uint8)], axis=1)
        for k in range(n):
            lead = rest[:, k].copy()
            for j, g in enumerate(self.generator):
                rest[:, k + j] ^= times[g][lead]
        rest[:, :n] = rows
        return rest

    def decode_rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`decode` of the rows of a table of bytes. A single wrong byte gives syndromes in constant ratio, which names its place; rows
        with more go to `decode` one by one."""
        exp, log, times = self.tables()
        n, rows = rows.shape[1], rows.copy()
        syndromes = np.zeros((self.checks, len(rows)), np.uint8)
        for k in range(self.checks):
            for c in range(n):
                syndromes[k] = times[self.exp[k]][syndromes[k]] ^ rows[:, c]
        wrong = syndromes.any(axis=0)
        single = wrong & (syndromes > 0).all(axis=0) if self.checks > 1 else np.zeros(len(rows), bool)
        ratio = (log[syndromes[1:]] - log[syndromes[:-1]]) % 255 if self.checks > 1 else np.zeros((1, len(rows)), np.int64)
        single &= (ratio == ratio[0]).all(axis=0) & (ratio[0] < min(n, 255))
        at = np.flatnonzero(single)
        rows[at, n - 1 - ratio[0][at]] ^= syndromes[0][at]
        good = ~wrong | single
        for k in np.flatnonzero(wrong & ~single):
            data, good[k] = self.decode(rows[k].tobytes())
            rows[k, : n - self.checks] = np.frombuffer(data, np.uint8)
        return rows[:, : n - self.checks], good


@functools.cache
def _code(checks: int) -> ReedSolomon:
    return ReedSolomon(checks)


def _by_size(at: np.ndarray, valid: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(values of each length, where their bytes are: a row each), nulls left out."""
    sizes = np.where(valid, np.diff(at), -1)
    for size in np.unique(sizes[sizes >= 0]):
        places = np.flatnonzero(sizes == size)
        yield places, at[places][:, None] + np.arange(size)


def _rs_written(octets: np.ndarray, at: np.ndarray, valid: np.ndarray, checks: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with check bytes, where each value's begin and the last ones end)."""
    ends = np.concatenate([[0], np.cumsum(np.diff(at) + checks * valid)])
    out = np.zeros(int(ends[-1]), np.uint8)
    for places, spots in _by_size(at, valid):
        out[ends[places][:, None] + np.arange(spots.shape[1] + checks)] = _code(checks).encode_rows(octets[spots])
    return out, ends


def _rs_read(octets: np.ndarray, at: np.ndarray, valid: np.ndarray, checks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data bytes, where each value's begin and the last ones end, whether they could be made right)."""
    ends = np.concatenate([[0], np.cumsum(np.maximum(np.diff(at) - checks, 0))])
    out, good = np.zeros(int(ends[-1]), np.uint8), np.zeros(len(valid), bool)
    for places, spots in _by_size(at, valid):
        data, good[places] = _code(checks).decode_rows(octets[spots])
        out[ends[places][:, None] + np.arange(data.shape[1])] = data
    return out, ends, good


def rs_insert(hexed: Column, checks: int = 3) -> Column:
    def run(x: pa.Array) -> pa.Array:
        return _hex_of(*_rs_written(*_octets(x), _valid(x), checks), _valid(x))

    return _arrow("string", run, hexed)


def rs_remove(hexed: Column, checks: int = 3) -> Column:
    """struct(hex, good)."""

    def run(x: pa.Array) -> pa.Array:
        data, at, good = _rs_read(*_octets(x), _valid(x), checks)
        return pa.StructArray.from_arrays([_hex_of(data, at, _valid(x)), pa.array(good, mask=~_valid(x))], ["hex", "good"])

    return _arrow("struct<hex: string, good: boolean>", run, hexed)


def index_length(segments: DataFrame) -> DataFrame:
    """file_id, total, index_length: bits that number the file's segments, 1 at least."""
    counts = segments.groupBy("file_id").agg(F.count("*").alias("total"))
    return counts.withColumn("index_length", F.greatest(F.lit(1), F.ceil(F.log2(F.col("total").cast("double")))).cast("int"))


def with_index(segments: DataFrame, width: int) -> DataFrame:
    return segments.withColumn("bits", F.concat(F.lpad(F.bin("seg_no"), width, "0"), F.col("bits")))


def without_index(segments: DataFrame, width: int) -> DataFrame:
    return segments.withColumn("seg_no", F.conv(F.substr("bits", F.lit(1), F.lit(width)), 2, 10).cast("long")).withColumn("bits", F.expr(f"substr(bits, {width + 1})"))


#: What a batch's strands, or segments, send to their file: runs of segments with following numbers and equal lengths, their bits packed.
RUN = "first long, count long, bits long, packed binary, longest int, known long, bad long"


def _runs(files: pa.Array, number: pa.Array, bits: pa.Array, seq: pa.Array | None) -> pa.RecordBatch:
    """A row for each run, with the longest run of a base and how many strands there are (and that have other letters) of its strands, if given."""
    code = files.dictionary_encode(null_encoding="encode").indices.to_numpy()
    no = number.fill_null(-1).to_numpy()
    data, at = flat.bytes_of(bits)
    n, size = np.diff(at), -(-np.diff(at) // 8)
    ends = np.concatenate([[0], np.cumsum(size)])
    packed = np.packbits(data == 49 if (n % 8 == 0).all() else flat.moved(data, at, ends[:-1] * 8, int(ends[-1]) * 8) == 49)
    new = (code[1:] != code[:-1]) | (no[1:] != no[:-1] + 1) | (n[1:] != n[:-1])
    begins = np.flatnonzero(np.concatenate([[True], new])) if len(no) else np.zeros(0, np.int64)
    count = np.diff(np.append(begins, len(no)))
    longest, known, bad = (np.zeros(len(begins), np.int64) for _ in range(3))
    if seq is not None and len(begins):
        longest, known, bad = _facts(seq, begins)
    blobs = flat.strings(packed, ends[np.append(begins, len(no))], None, pa.binary())
    columns = [files.take(pa.array(begins)), pa.array(no[begins]), pa.array(count), pa.array(n[begins]), blobs, pa.array(longest.astype(np.int32)), pa.array(known), pa.array(bad)]
    return pa.RecordBatch.from_arrays(columns, names=["file_id", "first", "count", "bits", "packed", "longest", "known", "bad"])


def _facts(seq: pa.Array, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the longest run of one base, how many strands aren't null, how many of these aren't bases alone) of the strands from each of `begins` on."""
    base = np.zeros(256, bool)
    base[[ord(c) for c in NT]] = True
    data, at = flat.bytes_of(seq)
    group = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(seq))))
    starts = np.ones(len(data), bool)
    starts[1:] = data[1:] != data[:-1]
    starts[at[:-1][np.diff(at) > 0]] = True
    starts = np.flatnonzero(starts)
    sizes = np.diff(np.append(starts, len(data))) * base[data[starts]]
    longest = np.zeros(len(begins), np.int64)
    np.maximum.at(longest, group[np.searchsorted(at, starts, "right") - 1], sizes)
    others = np.concatenate([[0], np.cumsum(~base[data])])
    valid = _valid(seq)
    plain = (others[at[1:]] == others[at[:-1]]) & (np.diff(at) > 0)
    count = lambda x: np.bincount(group[x], minlength=len(begins))
    return longest, count(valid), count(valid & ~plain)


def _joined(runs: list[tuple[int, int, int, bytes]], size: int | None) -> bytes | None:
    """A file of `size` bits from its runs (first, count, bits, packed) in order of their first."""
    if size is None:
        return None
    apart_all = all(b[0] >= a[0] + a[1] for a, b in zip(runs, runs[1:], strict=False))
    if apart_all and size % 8 == 0 and all(n % 8 == 0 for _, _, n, _ in runs):
        return b"".join([p for *_, p in runs])[: size // 8]
    parts: dict[int, np.ndarray] = {}
    for first, count, n, packed in runs:
        rows = np.unpackbits(np.frombuffer(packed, np.uint8).reshape(count, -1), axis=1)[:, :n] if n else np.zeros((count, 0), np.uint8)
        for k in range(count):
            parts.setdefault(first + k, rows[k])
    bits = np.concatenate([np.zeros(0, np.uint8), *[parts[k] for k in sorted(parts)]])[:size]
    return np.packbits(np.concatenate([np.zeros(-len(bits) // 4 * -4 % 8, np.uint8), bits])).tobytes()


def _files_of(runs: DataFrame, sizes: DataFrame, empty: bool = False) -> DataFrame:
    """file_id, data, longest, bases, strands of the files that have both runs and a size; if `empty`, also of those without runs that have none to have: files of
    no bits (no data, no strands, bases alone), and those whose size is null (neither is known). Runs and sizes take one exchange, and a sorted stream
    puts one file after another together."""
    kind = runs.schema["file_id"].dataType.simpleString()
    given = sizes.select(F.col("file_id").cast(kind), *[F.lit(None).cast(f.dataType).alias(f.name) for f in runs.schema if f.name != "file_id"], F.col("bit_size").cast("long").alias("bit_size"))
    every = runs.withColumn("bit_size", F.lit(None).cast("long")).unionByName(given).where("file_id IS NOT NULL")
    names = ["first", "count", "bits", "packed", "longest", "known", "bad", "bit_size"]

    def run(batches):
        out: list[tuple] = []
        file, wanted, mine, facts, held, kept = None, [], [], [0, 0, 0, 0], 0, None

        def end() -> int:
            nonlocal wanted, mine, facts
            if mine:
                made = [(file, _joined(mine, size), facts[0], None if not facts[1] else not facts[2], facts[3]) for size in wanted]
            else:
                made = [(file, _joined([], size), 0, True, size) for size in wanted if empty and not size]
            out.extend(made)
            wanted, mine, facts = [], [], [0, 0, 0, 0]
            return sum(len(m[1] or b"") for m in made)

        def batch_of() -> pa.RecordBatch:
            types = [kept, pa.binary(), pa.int32(), pa.bool_(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["file_id", "data", "longest", "bases", "strands"])

        for batch in batches:
            kept = batch.schema.field("file_id").type
            for f, first, count, bits, packed, longest, known, bad, size in zip(*[batch.column(c).to_pylist() for c in ("file_id", *names)], strict=True):
                if f != file:
                    held += end()
                    file = f
                    if held > 4 << 20:
                        yield batch_of()
                        out.clear()
                        held = 0
                if first is None:
                    wanted.append(size)
                else:
                    mine.append((first, count, bits, packed))
                    facts = [max(facts[0], longest), facts[1] + known, facts[2] + bad, facts[3] + count]
        end()
        if out:
            yield batch_of()

    dealt = every.repartition("file_id").sortWithinPartitions("file_id", F.col("first").asc_nulls_first()).select("file_id", *names)
    return dealt.mapInArrow(run, f"file_id {kind}, data binary, longest int, bases boolean, strands long")


def reassembled(segments: DataFrame, sizes: DataFrame, empty: bool = False) -> DataFrame:
    """file_id, data: segments in order, joined and cut to the file's bit_size. Of segments with one number any stays. Bits travel packed,
    eight to a byte, and segments that follow one another in a batch as one row, through one exchange by file. If `empty`, files of no bits are empty
    and those without a size null; else only files with segments come back."""

    def run(batches):
        for b in batches:
            yield _runs(b.column("file_id"), b.column("seg_no"), b.column("bits"), None)

    kind = segments.schema["file_id"].dataType.simpleString()
    runs = segments.select("file_id", F.col("seg_no").cast("long").alias("seg_no"), "bits").mapInArrow(run, f"file_id {kind}, {RUN}")
    return _files_of(runs, sizes, empty).select("file_id", "data")


def _by_hex(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda bits: f(seqfn.bits_to_hex(bits))


@dataclass(frozen=True)
class Scheme:
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]
    unit: int  # bits that a segment's length must divide by
    write: Callable[[pa.Array], pa.Array]  # the same of a batch of strings of bits, and of strands
    read: Callable[[pa.Array], pa.Array]


def _octet_scheme(encode, decode, unit: int, write: Written, read: Callable) -> Scheme:
    return Scheme(_by_hex(encode), lambda s: seqfn.hex_to_bits(decode(s)), unit, lambda x: write(*_packed(x), _valid(x)), lambda x: _unpacked(*read(x), _valid(x)))


#: Codecs of one segment to one strand. Decoders may return more bits than went in (padding).
SCHEMES = {
    "base": Scheme(base_encode, base_decode, 2, _base_written, _base_read),
    "church": Scheme(church_encode, church_decode, 1, _church_written, _church_read),
    "goldman": _octet_scheme(goldman_encode, goldman_decode, 8, _goldman_written, _goldman_read),
    "grass": _octet_scheme(grass_encode, grass_decode, 16, _grass_written, _grass_read),
    "blawat": _octet_scheme(blawat_encode, blawat_decode, 8, _blawat_written, _blawat_read),
}


@dataclass(frozen=True)
class Layout:
    """Lengths of a segment's parts in bits, in the order in which they are applied."""

    scheme: str
    ecc: str
    segment: int
    index: int
    checks: int = 3

    @property
    def indexed(self) -> int:
        return self.segment + self.index

    @property
    def coded(self) -> int:
        if self.ecc == "hamming":
            return self.indexed + hamming_checks(self.indexed)
        if self.ecc == "reed_solomon":
            return -(-self.indexed // 8) * 8 + 8 * self.checks
        return self.indexed

    @property
    def padded(self) -> int:
        unit = SCHEMES[self.scheme].unit
        return -(-self.coded // unit) * unit

    def __post_init__(self) -> None:
        if self.scheme not in SCHEMES or self.ecc not in ("none", "hamming", "reed_solomon") or min(self.segment, self.index) < 1:
            raise ValueError(f"unknown scheme or correction, or empty parts: {self}")


def _coded(number: np.ndarray, bits: np.ndarray, layout: Layout) -> pa.Array:
    """Strands of segments: their numbers and bits, a row of 0 and 1 each. Numbers of more than the index's bits lose the last ones."""
    size = np.frexp(number.astype(float))[1]
    shown = number >> np.maximum(size - layout.index, 0)
    index = (shown[:, None] >> np.arange(layout.index)[::-1] & 1).astype(np.uint8)
    rows = np.concatenate([index, bits], axis=1)
    if layout.ecc == "hamming":
        x = _hamming_written(flat.rows_of(48 + rows), layout.indexed)
        rows = flat.bytes_of(x)[0].reshape(len(rows), layout.coded) - 48
    elif layout.ecc == "reed_solomon":
        octets = np.packbits(rows, axis=1)
        rows = np.unpackbits(_code(layout.checks).encode_rows(octets), axis=1)
    if layout.padded > layout.coded:
        rows = np.concatenate([rows, np.zeros((len(rows), layout.padded - layout.coded), np.uint8)], axis=1)
    return SCHEMES[layout.scheme].write(flat.rows_of(48 + rows))


def encode_files(rows: DataFrame, layout: Layout, key: str = "file_id", data: str = "data", strict: bool = False) -> DataFrame:
    """Strands (file_id, pos, seq) of binary files. Segments that don't fit the codec's unit are padded, or
    refused with strict. The index must number the longest file's segments. A batch of files goes through all steps at once."""
    unit = SCHEMES[layout.scheme].unit
    if strict and layout.coded % unit:
        raise ValueError(f"Segment length must be divisible by {unit}")
    return segments_as(rows, key, F.col(data), layout.segment, lambda number, bits: _coded(number, bits, layout), "seq").withColumnRenamed("seg_no", "pos")


def plain_strands(rows: DataFrame, scheme: str, segment: int, key: str = "file_id", data: str = "data") -> DataFrame:
    """file_id, seg_no, seq: strands of a file's segments alone, without index and check bits."""
    return segments_as(rows, key, F.col(data), segment, lambda _, bits: SCHEMES[scheme].write(flat.rows_of(48 + bits)), "seq")


def _sliced(x: pa.Array, start: int, stop: int | None) -> pa.Array:
    data, at = flat.bytes_of(x)
    n = np.diff(at)
    if len(n) and (n == n[0]).all() and not x.null_count:
        return x if not start and (stop is None or n[0] <= stop) else flat.rows_of(np.ascontiguousarray(data.reshape(len(n), n[0])[:, start:stop]))
    return pc.utf8_slice_codeunits(x, start, stop)


def _numbers(x: pa.Array, width: int) -> pa.Array:
    """The numbers that strings of bits begin with: the first `width` bits, up to one that is neither 0 nor 1. Null for an empty one."""
    data, at = flat.bytes_of(x)
    n = np.diff(at)
    if len(n) and (n == n[0]).all() and n[0] >= width and not x.null_count:
        head = data.reshape(len(n), n[0])[:, :width]
        if (head >> 1 == 24).all() and width < 63:
            return pa.array((head & 1).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64)[::-1]))
    heads = [None if s is None else s[:width].strip(" ") for s in x.to_pylist()]
    return pa.array([None if not h else int("0" + "".join(itertools.takewhile("01".__contains__, h)), 2) for h in heads], pa.int64())


def _decoded(seq: pa.Array, layout: Layout) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(number, bits, whether an error was seen) of strands."""
    bits = _sliced(SCHEMES[layout.scheme].read(seq), 0, layout.coded)
    wrong = pa.array(np.zeros(len(seq), bool))
    if layout.ecc == "hamming":
        bits, wrong = _hamming_read(bits, layout.indexed)
    elif layout.ecc == "reed_solomon":
        valid = _valid(bits)
        data, at, good = _rs_read(*_packed(bits), valid, layout.checks)
        bits, wrong = _sliced(_unpacked(data, at, valid), 0, layout.indexed), pa.array(~good, mask=~valid)
    return _numbers(bits, layout.index), _sliced(bits, layout.index, None), wrong


def decode_segments(strands: DataFrame, layout: Layout) -> DataFrame:
    """file_id, seg_no, bits and wrong (an error was seen) of each strand, whatever their order."""

    def run(batches):
        for b in batches:
            number, bits, wrong = _decoded(b.column("seq"), layout)
            yield pa.RecordBatch.from_arrays([b.column("file_id"), bits, wrong, number], names=["file_id", "bits", "wrong", "seg_no"])

    kind = strands.schema["file_id"].dataType.simpleString()
    return strands.select("file_id", "seq").mapInArrow(run, f"file_id {kind}, bits string, wrong boolean, seg_no long")


def decode_files(strands: DataFrame, layout: Layout, sizes: DataFrame, facts: bool = False, empty: bool = False) -> DataFrame:
    """file_id, data of strands, whatever their order; with facts also longest (the longest run of a base in a file's strands), bases (whether they
    have no other letters) and strands (how many there are). Strands become runs of packed bits within their batch. If `empty`, files of no bits
    come back though they have no strands, and those whose size is null as null."""

    def run(batches):
        for b in batches:
            number, bits, _ = _decoded(b.column("seq"), layout)
            yield _runs(b.column("file_id"), number, bits, b.column("seq") if facts else None)

    kind = strands.schema["file_id"].dataType.simpleString()
    found = _files_of(strands.select("file_id", "seq").mapInArrow(run, f"file_id {kind}, {RUN}"), sizes, empty)
    return found if facts else found.select("file_id", "data")


def error_record(segments: DataFrame) -> DataFrame:
    """file_id, error_rate in percent, wrong segment numbers in order."""
    bad = F.array_sort(F.collect_list(F.when(F.col("wrong"), F.col("seg_no"))))
    return segments.groupBy("file_id").agg((F.avg(F.col("wrong").cast("double")) * 100).alias("error_rate"), bad.alias("wrong_segments"))


def encode_info(strands: DataFrame, sizes: DataFrame, layout: Layout, empty: bool = False) -> DataFrame:
    """file_id with the numbers that decoding needs, and the density in bits per base. If `empty`, also files without strands that have none to have: those
    of no bits count none, those whose size is null have no count."""
    per = strands.groupBy("file_id").agg(F.count("*").alias("total_count"), F.sum(F.length("seq")).alias("bases"))
    if empty:
        none = F.when(F.coalesce("bit_size", F.lit(0)) == 0, F.col("bit_size").cast("long"))  # 0 or null, as the size
        per = sizes.join(per, "file_id", "left").where("total_count IS NOT NULL OR coalesce(bit_size, 0) = 0").withColumn("total_count", F.coalesce("total_count", none))
    else:
        per = per.join(sizes, "file_id")
    return per.select("file_id", "bit_size", F.lit(layout.coded).alias("segment_length"), F.lit(layout.index).alias("index_length"), "total_count", F.bround(F.col("bit_size") / F.col("bases"), 3).alias("density"))


def yin_yang_pairs(segments: DataFrame) -> DataFrame:
    """file_id, pos, seq: neighbouring segments (2k, 2k+1) fused; an odd last one is paired with zeros."""
    pair = segments.withColumn("pos", F.floor(F.col("seg_no") / 2)).groupBy("file_id", "pos").agg(F.max(F.when(F.col("seg_no") % 2 == 0, F.col("bits"))).alias("yang"), F.max(F.when(F.col("seg_no") % 2 == 1, F.col("bits"))).alias("yin"))
    yin = F.coalesce("yin", F.repeat(F.lit("0"), F.length("yang")))
    return pair.select("file_id", "pos", yin_yang_encode(F.col("yang"), yin).alias("seq"))


def yin_yang_segments(strands: DataFrame) -> DataFrame:
    yang, yin = yin_yang_decode(F.col("seq"))
    rows = strands.select("file_id", "pos", F.posexplode(F.array(yang, yin)).alias("k", "bits"))
    return rows.select("file_id", (2 * F.col("pos") + F.col("k")).alias("seg_no"), "bits")


@functools.lru_cache(maxsize=64)
def _soliton(k: int) -> list[float]:
    return soliton(k)


def soliton(k: int, c: float = 0.1, delta: float = 0.05) -> list[float]:
    """Cumulative robust soliton distribution of degrees 1..k."""
    s = c * math.log(k / delta) * math.sqrt(k) if k > 1 else 1.0
    spike = max(1, min(k, round(k / s)))
    rho = [1 / k] + [1 / (d * (d - 1)) for d in range(2, k + 1)]
    tau = [s / (k * d) if d < spike else s * max(0.0, math.log(s / delta)) / k if d == spike else 0.0 for d in range(1, k + 1)]
    total = sum(rho) + sum(tau)
    out, at = [], 0.0
    for a, b in zip(rho, tau, strict=True):
        at += (a + b) / total
        out.append(at)
    return out


def members_of(seed: int, file_id: object, droplet: int, total: int) -> list[int]:
    """Segments of a droplet: as many as the robust soliton of `total` gives, distinct (Floyd's sampling), sorted."""
    draw = lambda *c: int(hashlib.md5("|".join(map(str, (seed, *c))).encode()).hexdigest()[:8], 16)
    degree = min(total, bisect.bisect_right(_soliton(total), draw("deg", file_id, droplet) / rng.SPAN) + 1)
    chosen: set[int] = set()
    for k in range(total - degree, total):
        at = draw("pick", file_id, droplet, k) % (k + 1)
        chosen.add(k if at in chosen else at)
    return sorted(chosen)


#: Segments or droplets of a file that are worked on in one task.
FILE_SEGMENTS = 20_000


def droplets(segments: DataFrame, totals: DataFrame, redundancy: float = 0.5, seed: int = 0, longest_run: int = 4, gc: tuple[float, float] = (0.35, 0.65), tries: int = 4, rounds: int = 10, limit: int = FILE_SEGMENTS, refused: str = "raise") -> DataFrame:
    """file_id, droplet, members, hex, seq: XORs of hash-chosen segments (file_id, seg_no, hex) that pass the GC
    and run screens, by droplet number: the first (1 + redundancy) times as many as segments, and more where
    those don't peel back to every segment.

    totals has file_id and total. Degrees follow the robust soliton of the file's total. The first round makes
    `tries` times the wanted number, each further one twice as many as the one before, for the files that still
    lack droplets. A file that `rounds` of them don't suffice for raises an error; with refused="rows" it is a row with a `reason` instead,
    and null else. Files of more than `limit` segments are peeled as tables of edges, with the same result."""
    want = F.ceil(F.col("total") * (1 + redundancy)).cast("int")
    pending = durable(totals.select("file_id", F.col("total").cast("long").alias("total"), want.alias("want")), "fountain-files")
    words = segments.select("file_id", "seg_no", F.posexplode(F.transform(seqfn.pieces(F.col("hex"), 8), lambda h: F.conv(h, 16, 10).cast("long"))).alias("w", "x"), F.length("hex").alias("n"))

    @F.pandas_udf("array<long>")
    def picked(file_id: pd.Series, droplet: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([members_of(seed, *x) for x in zip(file_id, droplet, total, strict=True)])

    passed, lasts, begun = None, None, 0
    for k in range(rounds):
        end = begun + tries * 2**k
        numbers = F.sequence(F.col("want").cast("long") * begun, F.col("want").cast("long") * end - 1)
        made = pending.withColumn("droplet", F.explode(numbers)).withColumn("members", picked("file_id", "droplet", "total"))
        good = durable(_screened(made, words, longest_run, gc), "droplets")
        passed = good if passed is None else passed.unionByName(good)
        found = durable(_enough(passed.select("file_id", "droplet", "members").join(pending, "file_id"), limit), "fountain-last")
        lasts = found if lasts is None else lasts.unionByName(found)
        pending, begun = durable(pending.join(found, "file_id", "left_anti"), "fountain-files"), end
        if pending.isEmpty():
            break
    kept = passed.join(apart(lasts, "file_id"), "file_id").where("droplet <= last").select("file_id", "droplet", "members", "hex", "seq")
    if refused == "rows":
        why = F.format_string("no droplets that pass the screens and peel among %d", F.col("want").cast("long") * begun)
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in kept.schema if f.name != "file_id"]
        return kept.withColumn("reason", F.lit(None).cast("string")).unionByName(pending.select("file_id", *none, why.alias("reason")))
    if not pending.isEmpty():
        raise ValueError(f"{pending.count()} files lack droplets that pass the screens and peel, among them {pending.first()['file_id']}")
    return kept


def _screened(made: DataFrame, words: DataFrame, longest_run: int, gc: tuple[float, float]) -> DataFrame:
    """file_id, droplet, members, hex, seq of the droplets (file_id, droplet, members) that pass the screens."""
    chosen = made.select("file_id", "droplet", "members", F.explode("members").alias("seg_no"))
    xored = chosen.join(words, ["file_id", "seg_no"]).groupBy("file_id", "droplet", "members", "w", "n").agg(F.bit_xor("x").alias("x"))
    size = F.least(F.lit(8), F.col("n") - F.col("w") * 8)
    parts = xored.withColumn("h", F.lpad(F.hex("x"), 8, "0")).withColumn("h", F.when(size < 8, F.substr("h", 9 - size, size)).otherwise(F.col("h")))
    whole = parts.groupBy("file_id", "droplet", "members").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w", "h"))), lambda s: s["h"]), "").alias("hex"))
    strands = whole.withColumn("seq", seqfn.hex_to_nt("hex"))
    return strands.where(~seqfn.has_run("seq", longest_run + 1) & seqfn.gc_fraction("seq").between(*gc))


def _enough(passed: DataFrame, limit: int) -> DataFrame:
    """file_id, last: the droplet by which a file (file_id, droplet, members, total, want) has `want` of them and they
    peel back to all its segments. Files that have no such droplet yet are left out. Files of up to `limit` segments are a group each."""
    large = passed.where(F.col("total") > limit)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("droplet")
        total, want = rows.column("total")[0].as_py(), rows.column("want")[0].as_py()
        known: set[int] = set()
        holders: dict[int, list[set]] = {}
        out = []
        for n, (droplet, members) in enumerate(zip(rows.column("droplet").to_pylist(), rows.column("members").to_pylist(), strict=True), 1):
            left = set(members) - known
            for m in left:
                holders.setdefault(m, []).append(left)
            ready = [left] if len(left) == 1 else []
            while ready:
                one = ready.pop()
                if not one:
                    continue
                seg = next(iter(one))
                known.add(seg)
                for other in holders.pop(seg, []):
                    other.discard(seg)
                    if len(other) == 1:
                        ready.append(other)
            if n >= want and len(known) == total:
                out.append(droplet)
                break
        return pa.table({"file_id": pa.array([rows.column("file_id")[0].as_py()] * len(out), pa.int64()), "last": pa.array(out, pa.int64())})

    small = passed.where(F.col("total") <= limit).groupBy("file_id").applyInArrow(run, "file_id long, last long")
    return small if large.isEmpty() else small.unionByName(peeling.enough(large))


def peeled(found: DataFrame, limit: int = FILE_SEGMENTS) -> DataFrame:
    """file_id, seg_no, hex of the segments that droplets (file_id, members, hex) give by peeling; droplets without members or hex count as
    lost. Files of up to `limit` droplets are a group each, larger ones tables of edges, with the same result."""
    found = found.select("file_id", "members", "hex").where("members IS NOT NULL AND hex IS NOT NULL")
    large = durable(found.groupBy("file_id").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("file_id"), "large-files")

    def run(rows: pa.Table) -> pa.Table:
        packets = [[set(m), int(h, 16) if h else 0, len(h)] for m, h in zip(rows.column("members").to_pylist(), rows.column("hex").to_pylist(), strict=True)]
        known: dict[int, tuple[int, int]] = {}
        holders: dict[int, list[int]] = {}
        for k, (members, _, _) in enumerate(packets):
            for m in members:
                holders.setdefault(m, []).append(k)
        ready = [k for k, p in enumerate(packets) if len(p[0]) == 1]
        while ready:
            members, value, n = packets[ready.pop()]
            if len(members) != 1:
                continue
            seg = next(iter(members))
            if seg in known:
                continue
            known[seg] = (value, n)
            for k in holders.get(seg, []):
                if seg in packets[k][0]:
                    packets[k][0].discard(seg)
                    packets[k][1] ^= value
                    if len(packets[k][0]) == 1:
                        ready.append(k)
        segs = sorted(known)
        return pa.table({"file_id": pa.array([rows.column("file_id")[0].as_py()] * len(segs), pa.int64()), "seg_no": pa.array(segs, pa.int64()), "hex": pa.array([f"{known[s][0]:0{known[s][1]}X}" if known[s][1] else "" for s in segs], pa.string())})

    schema = "file_id long, seg_no long, hex string"
    if large.isEmpty():
        return found.groupBy("file_id").applyInArrow(run, schema)
    small = found.join(large, "file_id", "left_anti").groupBy("file_id").applyInArrow(run, schema)
    return small.unionByName(peeling.segments(join_checked(found, large, "file_id", "left_semi")))
