"""Column functions over DNA and protein strings.

Empty and null strings give 0.0 for ratios and empty arrays for codons. Three
ways to cut codons exist, because the measures differ in what they count: full
codons, codons without the last one, and codons with a partial last one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The translation tables 1 and 2 in TCAG order, and stop codons of table 2.
BASES = "TCAG"
TABLES = {
    1: "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG",
    2: "FFLLSSSSYY**CCWWLLLLPPPPHHQQRRRRIIMMTTTTNNKKSS**VVVVAAAADDEEGGGG",
}
STOPS = ("TAA", "TAG", "AGA", "AGG")
#: Genes in index order; the last but one is the only one on the light strand.
GENES = ("ND1", "ND2", "COX1", "COX2", "ATP8", "ATP6", "COX3", "ND3", "ND4L", "ND4", "ND5", "ND6", "CYTB")
LIGHT = ("ND6",)
HIGH_EXPRESSION = ("COX1", "COX2", "COX3", "CYTB")


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once, where a lambda would evaluate it for each element."""
    return F.transform(F.array(value), use)[0]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _count(s: Column, letters: str) -> Column:
    return F.length(s) - F.length(F.translate(s, letters, ""))


def gc_content(seq: Column) -> Column:
    s = F.upper(_text(seq))
    return F.when(F.length(s) > 0, _count(s, "GC") / F.length(s)).otherwise(0.0)


def gc_skew(seq: Column) -> Column:
    s = F.upper(_text(seq))
    g, c = _count(s, "G"), _count(s, "C")
    return F.when(g + c > 0, (g - c) / (g + c)).otherwise(0.0)


def sequence_hash(seq: Column) -> Column:
    return F.sha2(F.upper(seq), 256)


def to_rna(seq: Column) -> Column:
    return F.translate(F.upper(seq), "T", "U")


def chunked(seq: Column, partial: bool = False, drop_last: bool = False) -> Column:
    """Three-letter pieces; partial keeps an incomplete last piece, drop_last leaves the last three letters out."""

    text = _text(seq)
    if drop_last:
        text = F.substr(text, F.lit(1), F.greatest(F.length(text) - 3, F.lit(0)))
    # One pass: a substring for each place would look for its beginning from the text's first letter on.
    return F.regexp_extract_all(text, F.lit("(?s).{1,3}" if partial else "(?s)..."), F.lit(0))


def amino_acid(codon: Column, table: int = 2) -> Column:
    """One letter; X for what is no codon."""
    at = [F.instr(F.lit(BASES), F.substr(codon, F.lit(i), F.lit(1))) for i in (1, 2, 3)]
    known = (F.length(codon) == 3) & (F.least(*at) > 0)
    place = (16 * (at[0] - 1) + 4 * (at[1] - 1) + at[2]).cast("int")
    return F.when(known, F.substr(F.lit(TABLES[table]), place, F.lit(1))).otherwise("X")


def translated(codons: Column, table: int = 2) -> Column:
    return F.array_join(F.transform(codons, lambda c: amino_acid(c, table)), "")


def complies(protein: Column) -> Column:
    """No stop before the last residue; the last one is not looked at."""
    return F.instr(F.substr(protein, F.lit(1), F.greatest(F.length(protein) - 1, F.lit(0))), "*") == 0


def strip_stops(protein: Column, also: str = "") -> Column:
    return F.regexp_replace(protein, f"[*{also}]+$", "")


def strand(gene: Column) -> Column:
    return F.when(gene.isin(*LIGHT), "L").otherwise("H")


def gene_index(gene: Column) -> Column:
    """0-based index; unknown genes have that of the first."""
    at = F.coalesce(F.array_position(F.array(*[F.lit(g) for g in GENES]), gene), F.lit(1))
    return F.greatest(at - 1, F.lit(0)).cast("int")


def condition(gene: Column, mode: str) -> Column:
    """The number that a generator is conditioned on: 'none', 'strand' (0 heavy, 1 light) or 'gene'."""
    if mode == "strand":
        return F.when(gene.isin(*LIGHT), 1).otherwise(0)
    return gene_index(gene) if mode == "gene" else F.lit(0)


CONDITIONS = {"none": 0, "strand": 2, "gene": len(GENES)}


def normalised_protein(text: Column) -> Column:
    """A user's protein: trimmed, upper case, without trailing stops."""
    return strip_stops(F.upper(F.trim(text)))


def invalid_residues(protein: Column, alphabet: str = "ACDEFGHIKLMNPQRSTVWY*") -> Column:
    """The different letters outside the alphabet, sorted."""
    letters = F.filter(F.split(protein, ""), lambda a: a != "")
    return F.array_sort(F.array_except(letters, F.array(*[F.lit(a) for a in alphabet])))


def input_error(protein: Column, longest: int = 700) -> Column:
    """Why a normalised protein cannot be generated for; null where it can."""
    bad = invalid_residues(protein)
    return (
        F.when(F.length(_text(protein)) == 0, "empty protein")
        .when(F.length(protein) > longest, F.concat(F.lit("longer than "), F.lit(longest)))
        .when(F.size(bad) > 0, F.concat(F.lit("invalid residues: "), F.array_join(bad, ",")))
    )


def exact_under(codons: Column, protein: Column, table: int = 2) -> Column:
    """Whether the codons translate to the protein, trailing stops aside."""
    return strip_stops(translated(codons, table)) == strip_stops(protein)


def _counted(hashes: Column) -> Column:
    """Each element of a sorted array with its number among its equals, as one hash."""
    return let(hashes, lambda s: F.transform(s, lambda x, i: F.xxhash64(x, i - F.array_position(s, x))))


def _gram_hashes(codons: Column, n: int) -> Column:
    """Sorted 64-bit hashes of all runs of n codons."""

    def of(cs):
        last = F.size(cs) - n
        grams = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(cs, i + 1, n)))
        return F.array_sort(F.when(last >= 0, grams).otherwise(F.array().cast("array<bigint>")))

    return let(codons, of)


def diversity(codons: Column) -> Column:
    """Shannon entropy in bits of the codons, a partial last one included."""

    def of(s):
        n = F.size(s)
        first = F.transform(F.array_distinct(s), lambda c: F.array_position(s, c))
        after = let(first, lambda f: F.zip_with(f, F.concat(F.slice(f, 2, F.greatest(F.size(f), F.lit(1))), F.array((n + 1).cast("long"))), lambda a, b: (b - a) / n))
        return F.when(n > 0, F.aggregate(after, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)

    return let(F.array_sort(codons), of)


def bleu(reference: Column, hypothesis: Column, order: int = 4) -> Column:
    """Codon BLEU of arrays of codons: clipped matches over the hypothesis' n-grams, floor 1e-8, brevity penalty.

    Clipped matches are the common part of two multisets: elements are numbered
    among their equals, then it is the intersection of two sets.
    """
    logs = []
    for n in range(1, order + 1):
        shared = F.size(F.array_intersect(_counted(_gram_hashes(reference, n)), _counted(_gram_hashes(hypothesis, n))))
        logs.append(F.ln(F.greatest(shared / F.greatest(F.size(hypothesis) - (n - 1), F.lit(1)), F.lit(1e-8))))
    mean = sum(logs[1:], logs[0]) / order
    r, h = F.size(reference), F.size(hypothesis)
    penalty = F.when(h >= r, 1.0).otherwise(F.exp(1 - r / F.greatest(h, F.lit(1))))
    return F.when((r > 0) & (h > 0), penalty * F.exp(mean)).otherwise(0.0)


def _numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(pieces of three letters as numbers, a partial last one included; how many each text has) of a column of ASCII texts."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    sizes = np.diff(ends)
    count = (sizes + 2) // 3
    owner = np.repeat(np.arange(len(count)), count)
    nth = 3 * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))
    letters = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    at = ends[:-1][owner] + nth
    number = np.zeros(len(owner), np.int64)
    for k in range(3):
        number = number * 256 + np.where(nth + k < sizes[owner], letters[np.minimum(at + k, len(letters) - 1)], 0)
    return number, count


def _grams(number: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number) of all runs of n pieces; pieces are below 2**16."""
    owner = np.repeat(np.arange(len(count)), count)
    left = np.repeat(np.cumsum(count), count) - np.arange(len(owner))
    at = np.flatnonzero(left >= n)
    gram = np.zeros(len(at), np.uint64)
    for k in range(n):
        gram = (gram << np.uint64(16)) | number[at + k].astype(np.uint64)
    return owner[at], gram


def _matches(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], rows: int) -> np.ndarray:
    """How many runs two sides have in common in each row, equal ones as often as both have them."""
    sides = []
    for owner, gram in (a, b):
        order = np.lexsort((gram, owner))
        owner, gram = owner[order], gram[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])
        first = np.flatnonzero(new)
        sides.append((owner[first], gram[first], np.diff(np.append(first, len(owner)))))
    owner, gram, count = (np.concatenate(x) for x in zip(*sides))
    order = np.lexsort((gram, owner))
    owner, gram, count = owner[order], gram[order], count[order]
    both = np.flatnonzero((owner[1:] == owner[:-1]) & (gram[1:] == gram[:-1]))
    return np.bincount(owner[both], np.minimum(count[both], count[both + 1]), rows)


#: Rows that are scored together.
TOGETHER = 2048


def _bleu(reference: pa.Array, hypothesis: pa.Array, order: int, missing: float | None) -> np.ndarray:
    r, h = _numbered(reference), _numbered(hypothesis)
    different, number = np.unique(np.concatenate([r[0], h[0]]), return_inverse=True)
    if len(different) > 1 << 16:
        raise ValueError("more than 65,536 different codons among texts that are scored together")
    number = {"r": number[: len(r[0])], "h": number[len(r[0]) :]}
    rows, logs, used = len(reference), 0.0, 0
    for n in range(1, order + 1):
        possible = np.maximum(h[1] - (n - 1), 0)
        share = _matches(_grams(number["r"], r[1], n), _grams(number["h"], h[1], n), rows) / np.maximum(possible, 1)
        value = np.log(np.maximum(share, 1e-8))
        if missing is None:
            value, used = np.where(possible > 0, value, 0.0), used + (possible > 0)
        else:
            used = used + np.ones(rows)
        logs = logs + value
    some = (r[1] > 0) & (h[1] > 0)
    penalty = np.where(h[1] >= r[1], 1.0, np.exp(1 - r[1] / np.maximum(h[1], 1)))
    return np.where(some, penalty * np.exp(logs / np.maximum(used, 1)), 0.0)


def bleu_of(reference: Column, hypothesis: Column, order: int = 4, short: str = "floor") -> Column:
    """`bleu` of two columns of ASCII sequences, cut with a partial last codon: the runs of many rows are sorted and met at once.

    An order for which the hypothesis is too short counts as the floor, or, with
    short="skip", does not count.
    """

    @F.arrow_udf(returnType=T.DoubleType())
    def run(r: pa.Array, h: pa.Array) -> pa.Array:
        parts = [_bleu(r.slice(at, TOGETHER), h.slice(at, TOGETHER), order, None if short == "skip" else 1e-8) for at in range(0, len(r), TOGETHER)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return run(reference, hypothesis)


def _diversity(texts: pa.Array) -> np.ndarray:
    number, count = _numbered(texts)
    owner = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((number, owner))
    owner, number = owner[order], number[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(new)
    share = np.diff(np.append(first, len(owner))) / count[owner[first]]
    return np.bincount(owner[first], -share * np.log2(share), len(count)) + 0.0


def diversity_of(sequence: Column) -> Column:
    """`diversity` of a column of ASCII sequences, cut with a partial last codon."""

    @F.arrow_udf(returnType=T.DoubleType())
    def run(s: pa.Array) -> pa.Array:
        return pa.array(_diversity(s))

    return run(sequence)


def complies_within(sequence: Column) -> Column:
    """`complies` of the translation of a sequence, read off its codons: no stop that another full codon follows."""
    return ~F.rlike(_text(sequence), F.lit(f"(?s)^(?:...)*?(?:{'|'.join(STOPS)})..."))


def identity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    longer = F.greatest(F.length(a), F.length(b), F.lit(1))
    return 1 - F.levenshtein(a, b) / longer


def positional_identity(reference: Column, other: Column) -> Column:
    """Share of the reference's codons that stand at the same place in the other."""
    same = F.size(F.filter(F.arrays_zip(reference.alias("a"), other.alias("b")), lambda x: x["a"] == x["b"]))
    return same / F.greatest(F.size(reference), F.lit(1))


def merged_tokens(protein: Column, codons: Column) -> Column:
    """'a_xyz' per residue; null where the lengths differ."""
    residues = F.split(protein, "")
    return F.when(F.length(protein) == F.size(codons), F.array_join(F.zip_with(residues, codons, lambda a, c: F.concat_ws("_", F.lower(a), F.lower(c))), " "))


def kmers(protein: Column, k: int = 3) -> Column:
    def of(s):
        n = F.length(s) - k + 1
        all_ = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(s, i, F.lit(k)))
        return F.when(n >= 1, F.array_distinct(all_)).otherwise(F.array().cast("array<string>"))

    return let(_text(protein), of)


def padded(tokens: Column, width: int, value: int = 0) -> Column:
    """An array cut or filled up to a fixed width."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(value), width)), 1, width)


def merged_map(*maps: Column) -> Column:
    """One map of several; of equal keys the last one's value stays."""
    out = maps[0]
    for later in maps[1:]:
        def kept(m, later=later):
            return F.map_filter(m, lambda k, _: ~F.map_contains_key(later, k))

        out = F.map_concat(kept(out), later)
    return out


def without_field(items: Column, *fields: str) -> Column:
    """An array of structs without some of their fields."""
    return F.transform(items, lambda x: x.dropFields(*fields))


def measured(sequence: Column, reference: Column, value) -> Column:
    """value(reference, sequence) where there is a reference, else null."""
    return F.when(reference.isNotNull() & (reference != ""), value(reference, sequence))


# Keywords of the groups that published baselines are counted under.
GROUPS = {
    "freq": ("frequency", "cai", "codon usage", "preferred-codon", "most-preferred", "conventional codon"),
    "algo": ("lineardesign", "brute-force", "random"),
    "neural": ("codontransformer", "icor", "gemorna", "codongpt", "bert", "calm", "mistral", "esm2", "language model"),
    "commercial": ("twist", "genewiz", "idt", "genscript", "gensmart"),
    "wt": ("wild-type", "natural", "original"),
}


def categories(names: Column, homology: Column) -> Column:
    """The keyword groups that an array of names falls into, in fixed order; 'homology' by its own flag."""
    text = F.lower(F.concat_ws(" ; ", names))
    hits = [F.when(F.greatest(*[F.instr(text, k) for k in keys]) > 0, F.lit(group)) for group, keys in GROUPS.items()]
    return F.array_compact(F.array(*hits, F.when(homology, F.lit("homology"))))
