"""Sequence expressions; upper case by translate, since upper() changes letters outside ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC codes with their complements, the codes for ambiguous bases, the genetic code.
IUPAC = "ACGTURYSWKMBDHVNacgturyswkmbdhvn"
COMPLEMENT = "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn"
AMBIGUOUS = "URYSWKMBDHVN"
CODONS = {"TTT": "F", "TTC": "F", "TTA": "L", "TTG": "L", "CTT": "L", "CTC": "L", "CTA": "L", "CTG": "L", "ATT": "I", "ATC": "I", "ATA": "I", "ATG": "M", "GTT": "V", "GTC": "V", "GTA": "V", "GTG": "V", "TCT": "S", "TCC": "S", "TCA": "S", "TCG": "S", "CCT": "P", "CCC": "P", "CCA": "P", "CCG": "P", "ACT": "T", "ACC": "T", "ACA": "T", "ACG": "T", "GCT": "A", "GCC": "A", "GCA": "A", "GCG": "A", "TAT": "Y", "TAC": "Y", "TAA": "*", "TAG": "*", "CAT": "H", "CAC": "H", "CAA": "Q", "CAG": "Q", "AAT": "N", "AAC": "N", "AAA": "K", "AAG": "K", "GAT": "D", "GAC": "D", "GAA": "E", "GAG": "E", "TGT": "C", "TGC": "C", "TGA": "*", "TGG": "W", "CGT": "R", "CGC": "R", "CGA": "R", "CGG": "R", "AGT": "S", "AGC": "S", "AGA": "R", "AGG": "R", "GGT": "G", "GGC": "G", "GGA": "G", "GGG": "G"}

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def upper(seq: Column) -> Column:
    return F.translate(seq, LOWER, UPPER)


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, IUPAC, COMPLEMENT))


def count_of(seq: Column, letters: str) -> Column:
    """How many of the letters (ASCII letters, as they stand) are in a sequence."""
    if len(letters) > 2:
        return F.regexp_count(seq, F.lit(f"[{letters}]")).cast("long")
    rest = seq
    for x in letters:
        rest = F.replace(rest, F.lit(x), F.lit(""))
    return (F.length(seq) - F.length(rest)).cast("long")


def kmers(seq: Column, k: int) -> Column:
    """All k-mers of a sequence in order; none where it is shorter."""
    n = F.length(seq) - k + 1
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, revcomp(kmer))


def translate_frame(seq: Column, frame: int) -> Column:
    """Amino acids of a frame 0 to 2; codons with other letters give X, a rest is left out."""
    code = F.create_map(*[F.lit(x) for kv in CODONS.items() for x in kv])
    n = F.floor((F.length(seq) - frame) / 3).cast("int")
    acids = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.element_at(code, F.substring(seq, i * 3 + frame + 1, F.lit(3))), F.lit("X")))
    return F.when(n >= 1, F.array_join(acids, "")).otherwise(F.lit(""))
