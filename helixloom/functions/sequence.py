"""Scalar functions on sequences and Phred strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The FNV-1a constants, the complement of each base, the standard genetic code in TCAG order.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
BASES, COMPLEMENTS = "ACGTacgt", "TGCAtgca"
CODE_ORDER = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
PHRED_OFFSET = 33
MIN_ERROR = 1e-12


def quantized(x: Column, digits: int = 6) -> Column:
    """Rounded half up in binary, the same in any engine."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def count_of(seq: Column, letters: str) -> Column:
    """How many characters of ``seq`` are among ``letters``, without splitting it."""
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def phred(char: Column) -> Column:
    return F.ascii(char) - PHRED_OFFSET


def error_probability(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10.0)


def quality_of(p: Column) -> Column:
    return -10.0 * F.log10(F.greatest(p, F.lit(MIN_ERROR)))


def error_sum(qual: Column) -> Column:
    """Summed error probability of a Phred string, from left to right."""
    chars = F.filter(F.split(qual, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0.0), lambda total, c: total + error_probability(phred(c)))


def mean_quality(qual: Column) -> Column:
    """Quality of the mean error of a Phred string; an empty one has Q120."""
    n = F.length(qual)
    return quality_of(F.when(n > 0, error_sum(qual) / n).otherwise(0.0))


def gc_percent(seq: Column) -> Column:
    """Share of G and C among A, C, G and T in percent, in either case; 0 if there are none."""
    gc, at = count_of(seq, "GCgc"), count_of(seq, "ATat")
    return F.when(gc + at > 0, gc * 100.0 / (gc + at)).otherwise(0.0)


def reverse_complement(seq: Column) -> Column:
    """Case is kept; letters other than bases become N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGTacgtNn]", "N"), BASES, COMPLEMENTS))


def codons(seq: Column) -> Column:
    """The whole codons in order; the sequence is read once."""
    return F.regexp_extract_all(seq, F.lit("(?s)(...)"), F.lit(1))


def codon_index(codon: Column) -> Column:
    """Place of a codon in TCAG order; null if it holds another letter."""
    places = [F.instr(F.lit(CODE_ORDER), F.substring(codon, k + 1, F.lit(1))) for k in range(3)]
    return F.when((places[0] > 0) & (places[1] > 0) & (places[2] > 0), (places[0] - 1) * 16 + (places[1] - 1) * 4 + places[2] - 1)


def translated(seq: Column) -> Column:
    """Protein of the whole codons; codons with other letters are X; one stop at the end is dropped."""
    letters = F.transform(codons(seq), lambda c: F.coalesce(F.substring(F.lit(AMINO_ACIDS), codon_index(c) + 1, F.lit(1)), F.lit("X")))
    return F.regexp_replace(F.array_join(letters, ""), r"\*$", "")


def fnv1a(text: Column) -> Column:
    """FNV-1a over the characters, in 32 bits."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(FNV_OFFSET).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("long")) * FNV_PRIME, F.lit(1 << 32)))


def canonical_hash(kmer: Column) -> Column:
    """struct(hash, strand): the smaller hash of both strands; the forward strand wins ties."""
    forward, backward = fnv1a(kmer), fnv1a(reverse_complement(kmer))
    return F.struct(F.least(forward, backward).alias("hash"), F.when(forward <= backward, 1).otherwise(-1).alias("strand"))


def encoded(seq: Column, rna: bool = False) -> Column:
    """Upper-case A, C, G and T, everything else a gap; with ``rna`` U counts as T."""
    seq = F.translate(seq, "Uu", "Tt") if rna else seq
    return F.regexp_replace(F.upper(seq) if rna else seq, "[^ACGT]", "-")


def _scaled(n: Column, names: tuple[str, str, str, str]) -> Column:
    """In units of 1, 10^3 (one decimal), 10^6 and 10^9 (two decimals), rounded half up from the whole number."""
    label = F.concat(n.cast("string"), F.lit(f" {names[0]}"))
    for unit, digits, name in ((10**3, 1, names[1]), (10**6, 2, names[2]), (10**9, 2, names[3])):
        step = unit // 10**digits
        parts = F.floor((n + step // 2) / F.lit(step)).cast("long")
        text = F.concat(F.floor(parts / 10**digits).cast("string"), F.lit("."), F.lpad((parts % 10**digits).cast("string"), digits, "0"), F.lit(f" {name}"))
        label = F.when(n >= unit, text).otherwise(label)
    return label


def formatted_bases(n: Column) -> Column:
    """1234 as '1.2 kb', 1234567 as '1.23 Mb' and so on, up to Gb."""
    return _scaled(n, ("bp", "kb", "Mb", "Gb"))


def formatted_bytes(n: Column) -> Column:
    """1536 as '1.5 KB', 3145728 as '3.15 MB' and so on, up to GB; units are decimal."""
    return _scaled(n, ("B", "KB", "MB", "GB"))


def bin_label(start: Column) -> Column:
    """The label of a histogram bin by its start: 500, 1k, 1.5k."""
    tenths = F.floor((start + 50) / 100).cast("long")
    decimal = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("k"))
    return F.when(start < 1000, start.cast("string")).when(start % 1000 == 0, F.concat(F.floor(start / 1000).cast("string"), F.lit("k"))).otherwise(decimal)


def mulberry32(seed: int, draw: Column) -> Column:
    """Draw number ``draw`` (from 0) of the mulberry32 stream: the state is a counter, so draws are independent."""
    two32 = 1 << 32

    def mul(a: Column, b: Column) -> Column:  # 32-bit product without overflow of a long
        low, high = b.bitwiseAND(0xFFFF), F.shiftright(b, 16)
        return F.pmod(a * low + F.pmod(a * high, F.lit(two32)) * 65536 % two32, F.lit(two32))

    a = F.pmod(F.lit(seed) + (draw.cast("long") + 1) * 0x6D2B79F5, F.lit(two32))
    t = mul(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
    t = F.pmod(t + mul(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61))), F.lit(two32)).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftright(t, 14)) / float(two32)
