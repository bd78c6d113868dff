"""Column expressions on variants: consequences, protein changes, strands, scores."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sequence ontology terms, most severe first.
CONSEQUENCES = [
    "transcript_ablation", "splice_acceptor_variant", "splice_donor_variant", "stop_gained", "frameshift_variant", "stop_lost", "start_lost",
    "transcript_amplification", "inframe_insertion", "inframe_deletion", "missense_variant", "protein_altering_variant", "splice_donor_5th_base_variant",
    "splice_region_variant", "splice_donor_region_variant", "splice_polypyrimidine_tract_variant", "incomplete_terminal_codon_variant",
    "start_retained_variant", "stop_retained_variant", "synonymous_variant", "coding_sequence_variant", "mature_miRNA_variant", "5_prime_UTR_variant",
    "3_prime_UTR_variant", "non_coding_transcript_exon_variant", "intron_variant", "NMD_transcript_variant", "non_coding_transcript_variant",
    "upstream_gene_variant", "downstream_gene_variant", "TFBS_ablation", "TFBS_amplification", "TF_binding_site_variant", "regulatory_region_ablation",
    "regulatory_region_amplification", "feature_elongation", "regulatory_region_variant", "feature_truncation", "intergenic_variant", "sequence_variant",
]

# The class of each term that has one.
CONSEQUENCE_CLASSES = {
    "synonymous_variant": "synonymous",
    "missense_variant": "missense",
    "stop_gained": "nonsense",
    "stop_lost": "nonsense",
    "start_lost": "nonsense",
    "splice_donor_variant": "splicing",
    "splice_acceptor_variant": "splicing",
    "splice_region_variant": "splicing",
    "splice_donor_5th_base_variant": "splicing",
    "splice_donor_region_variant": "splicing",
    "splice_polypyrimidine_tract_variant": "splicing",
    "intron_variant": "splicing",
}
CLASSES = ["missense", "nonsense", "splicing", "synonymous"]
PTMS = ["Acetylation", "Methylation", "Phosphorylation", "Regulatory_Site", "Ubiquitination"]
# The model columns in their order.
FEATURES = ["CLUSTL", "HotMaps", "smRegions", "PhyloP", "nmd", *PTMS, *[f"csqn_type_{c}" for c in CLASSES]]

# Fixed values: (least discovery index, least number of mutations) of the selection tiers, and the least F-score.
TIERS = [(0.0, 50), (0.5, 30), (0.75, 0)]
LEAST_FSCORE = 0.8

# Features that cannot act through a variant of the class, and so are 0 for it.
RECTIFIED = {
    "synonymous": ["CLUSTL", "HotMaps", "smRegions", "nmd", *PTMS],
    "missense": ["nmd"],
    "splicing": ["HotMaps", "nmd", *PTMS],
}


def excess(w: Column) -> Column:
    """Share of mutations beyond the neutral expectation: 0 up to 1, else (w - 1) / w."""
    return F.when(w <= 1, F.lit(0.0)).otherwise((w - 1) / w)


def classify_consequence(terms: Column) -> Column:
    """Class of the most severe term of a comma list; NULL if that term has none, or no term is known."""
    severity = F.array(*[F.lit(t) for t in CONSEQUENCES])
    ranks = F.filter(F.transform(F.split(terms, ","), lambda t: F.array_position(severity, t)), lambda r: r > 0)
    classes = F.array(*[F.lit(CONSEQUENCE_CLASSES.get(t)) for t in CONSEQUENCES])
    return F.get(classes, F.array_min(ranks).cast("int") - 1)


def format_aachange(amino_acids: Column, position: Column) -> Column:
    """I/T at 33 is I33T; L is L33L; '-' is NULL."""
    parts = F.split(amino_acids, "/")
    return F.when(amino_acids != "-", F.concat(parts[0], position.cast("string"), F.element_at(parts, -1)))


def parse_aa_position(aachange: Column, strict: bool = True) -> Column:
    """Integer inside A33C. Strict: all between the first and last character, else -1; or the first run of digits."""
    if strict:
        return F.coalesce(F.substring(aachange, F.lit(2), F.length(aachange) - 2).try_cast("int"), F.lit(-1))
    return F.regexp_extract(aachange, r"(\d+)", 1).try_cast("int")


def protein_change(position: Column, amino_acids: Column) -> Column:
    """A33C of position 33 and A/C; '.' for position '-'; NULL if either is."""
    return F.when(position == "-", F.lit(".")).otherwise(F.concat(F.substring(amino_acids, 1, 1), position.cast("string"), F.substring(amino_acids, -1, 1)))


def split_location(location: Column) -> dict[str, Column]:
    """chr and pos of chr:pos."""
    parts = F.split(location, ":")
    return {"chr": parts[0], "pos": parts[1].cast("int")}


def row_max_flags(*flags: Column) -> Column:
    """1 if any flag is; NULL flags are passed over."""
    return F.greatest(*flags)


def class_threshold(score: Column, threshold: float = 0.5) -> Column:
    return score >= threshold


def nmd_flag(exon: Column, first_exon: bool = False) -> Column:
    """1 for the last exon of k/n (and the first, if asked for); 0 otherwise and for anything else."""
    k, n = F.regexp_extract(exon, r"^(\d+)/(\d+)$", 1), F.regexp_extract(exon, r"^(\d+)/(\d+)$", 2)
    hit = (k != "") & (k == n)
    if first_exon:
        hit = hit | (k == "1")
    return F.coalesce(hit, F.lit(False)).cast("int")


def one_hot_consequence(df: DataFrame, consequence: str) -> DataFrame:
    """csqn_type_* columns of the four classes in place of the class column; others are 0 in all."""
    return df.withColumns({f"csqn_type_{c}": F.coalesce(F.col(consequence) == c, F.lit(False)).cast("int") for c in CLASSES}).drop(consequence)


def rectify(df: DataFrame) -> DataFrame:
    """Set features to 0 that a variant's class excludes; only those that ``df`` has."""
    out = {}
    for feature in FEATURES:
        flags = [F.col(f"csqn_type_{c}") == 1 for c, zero in RECTIFIED.items() if feature in zero]
        if flags and feature in df.columns:
            out[feature] = F.when(reduce(lambda a, b: a | b, flags), F.lit(0)).otherwise(F.col(feature))
    return df.withColumns(out)


def normalize_chrom(chrom: Column) -> Column:
    """Without a leading chr; integer-like names in plain form."""
    bare = F.regexp_replace(chrom.cast("string"), "^chr", "")
    return F.coalesce(bare.try_cast("double").try_cast("int").cast("string"), bare)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def of_bases(seq: Column) -> Column:
    """Whether nothing but A, C, G and T is there; without a pattern, as it is asked for each base of all genes."""
    return F.translate(seq, "ACGT", "") == ""


def pyrimidine_context(triplet: Column, alt: Column) -> Column:
    """Key such as ACA>G of a change, on the strand where the changed base is C or T; NULL unless ACGT."""
    fold = F.substring(triplet, 2, 1).isin("A", "G")
    key = F.concat(F.when(fold, reverse_complement(triplet)).otherwise(triplet), F.lit(">"), F.when(fold, F.translate(alt, "ACGT", "TGCA")).otherwise(alt))
    return F.when((F.length(triplet) == 3) & of_bases(triplet) & (F.length(alt) == 1) & of_bases(alt), key)


def context_keys() -> list[str]:
    """The 96 keys, by changed base, its neighbours and the new base."""
    return [f"{a}{ref}{b}>{alt}" for ref in "CT" for a, b in product("ACGT", repeat=2) for alt in "ACGT" if alt != ref]


def mean_multivalue(values: Column) -> Column:
    """Mean of a comma list without its '.' entries; NULL for '-' and if nothing is left."""
    numbers = F.filter(F.transform(F.split(values, ","), lambda v: F.trim(v).try_cast("double")), lambda v: v.isNotNull())
    return F.try_divide(F.aggregate(numbers, F.lit(0.0), lambda a, v: a + v), F.size(numbers))


def domain_geometry(start: Column, end: Column) -> dict[str, Column]:
    span = end - start
    return {"POS": start + F.floor(span / 2).cast("int"), "SIZE": span + 1}


def tier_predicate(fscore: Column, discovery: Column, n_muts: Column) -> Column:
    """F-score high enough and any of the (discovery, mutations) tiers reached."""
    tiers = [(discovery >= d) & (n_muts >= n) for d, n in TIERS]
    return F.coalesce((fscore >= LEAST_FSCORE) & reduce(lambda a, b: a | b, tiers), F.lit(False))


def half_precision(x: Column) -> Column:
    """Nearest IEEE half-precision value, ties to even; infinite from 65520 on. Subnormal steps are 2**-24."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)) - 10)
    near = F.rint(x / step) * step
    return F.when(x == 0, x).when(F.abs(near) >= 65520, F.signum(x) * F.lit(float("inf"))).otherwise(near)


def hash_uniform(*parts: Column) -> Column:
    """Uniform number of [0, 1) that the parts determine, the same in any engine that has md5."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
