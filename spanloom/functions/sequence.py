"""Column expressions on DNA sequences. Case carries information and is kept; positions are 0-based unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The complement of each base; other characters stand for themselves.
BASES, COMPLEMENTS = "ACGTNacgtn", "TGCANtgcan"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(seq: str | Column) -> Column:
    return F.reverse(F.translate(_col(seq), BASES, COMPLEMENTS))


def gc_content(seq: str | Column) -> Column:
    return F.regexp_count(_col(seq), F.lit("[GCgc]")) / F.nullif(F.length(_col(seq)), F.lit(0))


def repeat_fraction(seq: str | Column) -> Column:
    """Share of lower-case (masked) letters."""
    return F.regexp_count(_col(seq), F.lit("[a-z]")) / F.nullif(F.length(_col(seq)), F.lit(0))


def with_reverse_complements(df: DataFrame) -> DataFrame:
    """Every ``id, seq`` row twice: as it is (``_+``) and reverse-complemented (``_-``)."""
    both = F.array(F.struct(F.concat("id", F.lit("_+")).alias("id"), F.col("seq")), F.struct(F.concat("id", F.lit("_-")).alias("id"), reverse_complement("seq").alias("seq")))
    return df.select(F.explode(both).alias("x")).select("x.*")


def kmer_tokens(seq: str | Column, k: int) -> Column:
    """Ids of the non-overlapping k-mers: 2 + the k-mer as a number in base 4 (a, c, g, t), 1 where a letter is none of these."""
    words = F.regexp_extract_all(F.lower(_col(seq)), F.lit(f"(?s).{{{k}}}"), F.lit(0))
    return F.transform(words, lambda w: F.when(w.rlike(f"^[acgt]{{{k}}}$"), F.conv(F.translate(w, "acgt", "0123"), 4, 10).cast("int") + 2).otherwise(1))


def letters(seq: str | Column) -> Column:
    """The letters of a text; none of an empty one."""
    return F.array_remove(F.split(_col(seq), ""), "")


def char_tokens(seq: str | Column, bos: bool = False, eos: bool = False) -> Column:
    """Ids of the letters: pad 0, unknown 1, then begin and end marks if asked for, then a, c, g, t."""
    first = 2 + bos + eos
    digits = F.translate(F.regexp_replace(F.lower(_col(seq)), "(?s)[^acgt]", "1"), "acgt", "".join(str(first + i) for i in range(4)))
    ids = letters(digits).cast("array<int>")
    begin = F.array(F.lit(2)) if bos else F.array().cast("array<int>")
    end = F.array(F.lit(2 + bos)) if eos else F.array().cast("array<int>")
    return F.concat(begin, ids, end)


def upper_mask(seq: str | Column) -> Column:
    return letters(F.regexp_replace(F.regexp_replace(_col(seq), "(?s)[^A-Z]", "0"), "[A-Z]", "1")).cast("array<boolean>")


def loss_weights(seq: str | Column, lower_weight: float) -> Column:
    """Weight of predicting the next letter: 1 for an upper-case, ``lower_weight`` for a lower-case one, 0 after the last."""
    mask = upper_mask(seq)
    following = F.slice(mask, 2, F.greatest(F.length(_col(seq)) - 1, F.lit(0)))
    return F.concat(F.transform(following, lambda up: F.when(up, 1.0).otherwise(float(lower_weight))), F.array(F.lit(0.0)))


def substitutions(seq: str | Column, at: int | Column) -> Column:
    """The sequence with each of A, C, G, T at the 0-based place."""
    place = F.lit(at) if isinstance(at, int) else at
    return F.transform(F.array(*[F.lit(b) for b in "ACGT"]), lambda b: F.overlay(_col(seq), b, place + 1, F.lit(1)))


def case_encode(seq: str | Column, values: str | Column, threshold: float) -> Column:
    """Upper case where the base's value reaches the threshold, lower case elsewhere; null and NaN do not reach it."""
    return F.array_join(F.zip_with(letters(seq), _col(values), lambda c, v: F.when((v >= threshold) & ~F.isnan(v), F.upper(c)).otherwise(F.lower(c))), "")


def variant_index(window: int, strand: str) -> int:
    """Where the variant stands in a window with ``window // 2`` bases before it on the plus strand."""
    return window // 2 if strand == "+" else window - 1 - window // 2


def context_and_completions(seq: Column, ref: Column, alt: Column, window: int, strand: str = "+") -> Column:
    """Of a window about a variant: what stands before it, and what follows with the reference or the other base first.
    The query fails where the window doesn't hold the reference base."""
    at = window // 2
    base = F.substring(seq, at + 1, 1)
    ok = F.when(F.upper(base) == F.upper(ref), seq).otherwise(F.raise_error(F.lit("reference base differs")).cast("string"))
    other = F.overlay(ok, alt, F.lit(at + 1), F.lit(1))
    if strand == "-":
        ok, other, at = reverse_complement(ok), reverse_complement(other), window - 1 - window // 2
    cut = lambda s: F.substring(s, at + 1, window)
    return F.struct(F.substring(ok, 1, at).alias("context"), cut(ok).alias("ref_completion"), cut(other).alias("alt_completion"))


def variant_example(window: Column, alt: Column, strand: str = "+", bos: bool = False, eos: bool = False) -> Column:
    """``input_ids`` of the reference window and ``alt_token_id``, the other base's id; on the minus strand both reverse-complemented."""
    if strand == "-":
        window, alt = reverse_complement(window), reverse_complement(alt)
    base = F.instr(F.lit("acgt"), F.lower(alt)) + (1 + bos + eos)
    return F.struct(char_tokens(window, bos, eos).alias("input_ids"), F.when(base > 1 + bos + eos, base).otherwise(1).alias("alt_token_id"))


def special_token_counts(ids: Column, bos_id: int | None, eos_id: int | None) -> Column:
    """How many marks an encoder put before and behind, from the ids that it gave for one letter."""
    return F.struct(
        (F.lit(bos_id is not None) & (F.get(ids, F.lit(0)) == F.lit(bos_id))).cast("int").alias("n_prefix"), (F.lit(eos_id is not None) & (F.element_at(ids, -1) == F.lit(eos_id))).cast("int").alias("n_suffix")
    )


def split_log_likelihood(log_p: Column, upper: Column) -> Column:
    """Sums and counts over upper-case and other target letters; ``log_p[i]`` is of letter ``i + 1`` of the mask ``upper``."""
    pairs = F.zip_with(log_p, F.slice(upper, 2, F.greatest(F.size(upper) - 1, F.lit(0))), lambda p, u: F.struct(p.cast("double").alias("p"), u.alias("u")))
    total = lambda own: F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.when(x["u"] == F.lit(own), x["p"]).otherwise(0.0))
    count = lambda own: F.size(F.filter(pairs, lambda x: x["u"] == F.lit(own))).cast("long")
    return F.struct(total(True).alias("ll_upper"), total(False).alias("ll_lower"), count(True).alias("n_upper"), count(False).alias("n_lower"))


def reference_log_probability(log_likelihoods: Column, ref: Column) -> Column:
    """Log probability of the reference base (0 to 3) among the four sequences that differ in it."""
    from .columns import log_softmax

    return F.get(log_softmax(log_likelihoods), ref)


def char_vocabulary(bos: bool = False, eos: bool = False) -> dict[str, int]:
    """The letters' vocabulary that ``char_tokens`` gives ids of."""
    marks = ["[PAD]", "[UNK]", *["[BOS]"] * bos, *["[EOS]"] * eos]
    return {token: i for i, token in enumerate([*marks, *"acgt"])}


def likelihood_example(window: Column, bos: bool = False, eos: bool = False) -> Column:
    """``input_ids`` of a window and ``is_upper``, false for marks: what a likelihood by case is summed over."""
    mark = lambda there: F.array(F.lit(False)) if there else F.array().cast("array<boolean>")
    return F.struct(char_tokens(window, bos, eos).alias("input_ids"), F.concat(mark(bos), upper_mask(window), mark(eos)).alias("is_upper"))
