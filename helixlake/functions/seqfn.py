"""Column builders over DNA strings. Bits and hex digits are exchanged by batch in numpy, the others stay in the JVM."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from helixlake.functions import flat

NT = "ACGT"
HEX = "0123456789ABCDEF"

#: Nearest-neighbour enthalpy and entropy (Allawi & SantaLucia 1997), kcal/mol and cal/(mol K). Fixed values.
STACKS = {
    "AA": (-7.9, -22.2), "TT": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3),
    "CA": (-8.5, -22.7), "TG": (-8.5, -22.7), "GT": (-8.4, -22.4), "AC": (-8.4, -22.4),
    "CT": (-7.8, -21.0), "AG": (-7.8, -21.0), "GA": (-8.2, -22.2), "TC": (-8.2, -22.2),
    "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9), "CC": (-8.0, -19.9),
}
ENDS = {"A": (2.3, 4.1), "T": (2.3, 4.1), "G": (0.1, -2.8), "C": (0.1, -2.8)}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def revcomp(seq: Column | str) -> Column:
    return F.reverse(F.translate(col(seq), "ACGT", "TGCA"))


def gc_count(seq: Column | str) -> Column:
    return F.length(col(seq)) - F.length(F.translate(col(seq), "GC", ""))


def gc_fraction(seq: Column | str) -> Column:
    """G and C over length, 0..1; null for an empty strand."""
    return gc_count(seq) / F.nullif(F.length(col(seq)), F.lit(0))


def longest_run(seq: Column | str) -> Column:
    """Length of the longest run of one base; 0 without bases."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(col(seq), F.lit("A+|C+|G+|T+"), F.lit(0)), F.length)), F.lit(0))


def has_run(seq: Column | str, n: int) -> Column:
    """Whether some base repeats n times."""
    return col(seq).rlike("|".join(f"{b}{{{n}}}" for b in NT))


def windows(seq: Column | str, k: int) -> Column:
    """All k-mers in order; empty if the strand is shorter."""
    s = col(seq)
    return F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda p: F.substr(s, p, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmer_code(kmer: Column | str) -> Column:
    """Base-4 little-endian code with A0 C1 G2 T3; -1 if another letter occurs."""
    k = col(kmer)
    return F.when(k.rlike("^[ACGT]*$"), F.conv(F.reverse(F.translate(k, "ACGT", "0123")), 4, 10).cast("long")).otherwise(F.lit(-1).cast("long"))


def kmer_of(code: Column | str, k: int) -> Column:
    """Inverse of kmer_code for k-mers."""
    return F.reverse(F.translate(F.lpad(F.conv(col(code).cast("string"), 10, 4), k, "0"), "0123", "ACGT"))


def _packed(seqs: pa.Array) -> pa.Array:
    data, at = flat.bytes_of(seqs)
    valid = seqs.is_valid().to_numpy(zero_copy_only=False)
    digit = np.full(256, 4, np.uint8)
    digit[[ord(c) for c in NT]] = range(4)
    found, n = digit[data], np.diff(at)
    size = -(-n // 4)
    first = np.concatenate([[0], np.cumsum(size)])
    fours = found if (n % 4 == 0).all() else flat.moved(found, at, first[:-1] * 4, int(first[-1]) * 4)
    fours = fours.reshape(-1, 4)
    ends = first + np.arange(len(first))  # a byte more for each: how long its last four are
    out = np.zeros(ends[-1], np.uint8)
    out[np.arange(first[-1]) + np.repeat(np.arange(len(n)), size)] = (fours & 3) @ np.array([64, 16, 4, 1], np.uint8)
    out[ends[1:] - 1] = n % 4
    if (found > 3).any():  # strings with other letters are as they are, and end in 255
        rows = [None if s is None else s.encode() + b"\xff" if s.strip(NT) else out[a:b].tobytes() for s, a, b in zip(seqs.to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return pa.array(rows, pa.binary())
    return flat.strings(out, ends, valid, pa.binary())


def packed(seq: Column | str) -> Column:
    """A binary that is equal where the strings are: four bases to a byte. Strings with other letters stay whole."""
    return F.arrow_udf(_packed, "binary")(col(seq))


def hamming(a: Column | str, b: Column | str) -> Column:
    """Positions that differ, over the shorter one's length."""
    pairs = F.zip_with(F.split(col(a), ""), F.split(col(b), ""), lambda x, y: (x.isNotNull() & y.isNotNull() & (x != y)).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def near_keys(word: Column, most: int) -> Column:
    """Array of (k, x): words of equal length that differ in at most `most` places share a key.

    A word is cut into most + 2 blocks. So many differences leave two blocks intact, and a key is a pair of blocks:
    far rarer than a single one, so that common blocks don't gather."""
    parts = most + 2
    cut = lambda b: F.floor(F.length(word) * b / parts).cast("int")
    block = lambda b: F.substr(word, cut(b) + 1, cut(b + 1) - cut(b))
    pairs = [(a, b) for a in range(parts) for b in range(a + 1, parts)]
    return F.array(*[F.struct(F.lit(k).alias("k"), F.length(word).alias("n"), F.concat(block(a), block(b)).alias("x")) for k, (a, b) in enumerate(pairs)])


def hex_to_nt(hexed: Column | str) -> Column:
    """Two bases per hex digit: 00 A, 01 C, 10 G, 11 T. Lower case in between keeps digits and bases apart."""
    out = col(hexed)
    for k, digit in enumerate(HEX):
        out = F.replace(out, F.lit(digit), F.lit((NT[k // 4] + NT[k % 4]).lower()))
    return F.upper(out)


def pieces(text: Column | str, size: int) -> Column:
    """The string in pieces of a fixed size, the last one shorter; empty for an empty string. One pass, whereas
    substr by position walks a string from its start each time."""
    return F.regexp_extract_all(col(text), F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def nt_to_hex(seq: Column | str) -> Column:
    """Inverse of hex_to_nt, two bases to a digit."""
    table = F.create_map(*[F.lit(x) for k, d in enumerate(HEX) for x in (NT[k // 4] + NT[k % 4], d)])
    return F.array_join(F.transform(pieces(seq, 2), lambda p: table[p]), "")


def hex_to_bits(hexed: Column | str) -> Column:
    """Four bits per hex digit, most significant first."""
    table = np.zeros((256, 4), np.uint8)
    for k, d in enumerate(HEX):
        table[ord(d)] = table[ord(d.lower())] = list(f"{k:04b}".encode())

    def run(x: pa.Array) -> pa.Array:
        data, at = flat.bytes_of(x)
        return flat.strings(table[data].reshape(-1), at * 4, x.is_valid().to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, "string")(col(hexed))


def bits_to_hex(bits: Column | str) -> Column:
    """Inverse of hex_to_bits; the length must divide by four."""
    digits = np.frombuffer(HEX.encode(), np.uint8)

    def run(x: pa.Array) -> pa.Array:
        data, at = flat.bytes_of(x)
        if (at % 4).any():
            raise ValueError("the number of bits must divide by four")
        fours = (data == 49).astype(np.uint8).reshape(-1, 4)
        return flat.strings(digits[fours[:, 0] * 8 + fours[:, 1] * 4 + fours[:, 2] * 2 + fours[:, 3]], at // 4, x.is_valid().to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, "string")(col(bits))


def melting_temp(seq: Column | str, na_mm: float = 50.0, strand_nm: float = 25.0) -> Column:
    """Nearest-neighbour melting temperature in degrees C with a salt-corrected entropy.

    Every dinucleotide's sums come from how often it occurs, counted with overlap."""
    s = col(seq)
    table_h = F.create_map(*[F.lit(x) for k, v in STACKS.items() for x in (k, v[0])])
    table_s = F.create_map(*[F.lit(x) for k, v in STACKS.items() for x in (k, v[1])])
    end_h = F.create_map(*[F.lit(x) for k, v in ENDS.items() for x in (k, v[0])])
    end_s = F.create_map(*[F.lit(x) for k, v in ENDS.items() for x in (k, v[1])])
    first, last = F.substring(s, 1, 1), F.substring(s, -1, 1)
    pairs = windows(s, 2)
    add = lambda table: F.aggregate(pairs, F.lit(0.0), lambda t, p: t + table[p])
    dh = add(table_h) + end_h[first] + end_h[last]
    ds = add(table_s) + end_s[first] + end_s[last] + 0.368 * (F.length(s) - 1) * math.log(na_mm / 1000)
    return 1000 * dh / (ds + 1.987 * math.log(strand_nm * 1e-9 / 2)) - 273.15
