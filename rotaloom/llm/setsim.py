"""Set-similarity joins with prefix, length and positional filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotaloom.session import cut_lineage

Sized = Callable[[Column, Column], Column]


def _pairs(text: Column) -> Column:
    """Each two neighbouring letters of ``text`` (a text of one letter gives that), in linear time."""
    letters = F.split(text, "")
    two = F.zip_with(letters, F.slice(letters, 2, 1 << 30), lambda a, b: F.concat(a, b))  # null for the last letter
    return F.when(F.length(text) > 1, F.array_compact(two)).otherwise(F.array(text))


def grams(text: Column) -> Column:
    """The distinct pairs of letters of ``text`` with its ends marked; empty for null or empty text."""
    return F.when(F.length(text) > 0, F.array_distinct(_pairs(F.concat(F.lit("^"), text, F.lit("$"))))).otherwise(F.array().cast("array<string>"))


def word_grams(words: Column) -> Column:
    """The distinct pairs of letters inside each of ``words`` (an array), which don't tell their order."""
    return F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: w != ""), lambda w: _pairs(w))))


def overlap_join(left: DataFrame, right: DataFrame | None, on: list[str], need: Sized, left_prefix: Callable[[Column], Column], right_prefix: Callable[[Column], Column], reach: tuple[Callable[[Column], Column], Callable[[Column], Column]] | None = None, retell: Callable[[Column], Column] | None = None, quick: Column | None = None) -> DataFrame:
    """Pairs of sets of the same ``on`` values that share at least ``need`` of their tokens.

    ``left`` and ``right``: ``on`` columns, ``id``, ``tokens`` (array of string); without ``right``,
    pairs of ``left``. ``need`` gives the tokens to share from both sizes; ``left_prefix`` and
    ``right_prefix`` give from a set's size how many of its rarest tokens hold one that any partner
    shares (size - least need + 1). ``reach`` gives from a left id the measures that a partner may have,
    and from a right id its measure, such as a length; it is then a join key and splits the group of a
    token. ``retell`` gives an id's tokens again, so that sets needn't travel through the join; ``quick`` is
    a cheap condition on both ids that every pair wanted meets, tried before the count. Result: the ``on`` columns, ``left_id``, ``right_id``, ``shared``, ``left_size``,
    ``right_size``; every pair once (of one table ``left_id`` < ``right_id``; with ``reach`` the one of
    less measure is left). Empty or null sets and null tokens match nothing. Ids must be unique within
    ``on``; repeated rows are dropped.

    Tokens (as 64-bit hashes) are ordered by rarity over both inputs, so that common tokens are in a
    prefix only where nothing rarer is. The length filter (``need`` above either size) and the
    positional filter (tokens left after the shared one) cut candidates before the exact count. A pair is
    kept at its rarest shared token only, so that counted pairs need no further shuffle.
    """

    def tidy(df: DataFrame) -> DataFrame:
        hashed = F.array_distinct(F.transform(F.filter("tokens", lambda t: t.isNotNull()), lambda t: F.xxhash64(t)))
        return df.select(*on, "id", hashed.alias("_set")).where(F.size("_set") > 0).dropDuplicates([*on, "id"])

    left = tidy(left)
    own, right = right is None, left if right is None else tidy(right)
    both = left.select("_set") if own else left.select("_set").unionAll(right.select("_set"))
    counts = cut_lineage(both.select(F.explode("_set").alias("_t")).groupBy("_t").agg(F.count("*").alias("_n")))  # a table of known size: broadcast if small

    def ordered(sets: DataFrame) -> DataFrame:
        each = sets.select(*on, "id", F.explode("_set").alias("_t")).join(counts, "_t")
        rarest = F.array_sort(F.collect_list(F.struct("_n", "_t")))
        return each.groupBy(*on, "id").agg(F.transform(rarest, lambda x: x["_t"]).alias("_g"))

    def prefixes(ranked: DataFrame, side: str, length: Callable[[Column], Column]) -> DataFrame:
        prefix = F.slice("_g", 1, F.greatest(length(F.size("_g")), F.lit(1)).cast("int"))
        carried = [F.size("_g").alias(f"_{side}_n")] if retell else [F.size("_g").alias(f"_{side}_n"), F.col("_g").alias(f"_{side}")]
        return ranked.select(*on, F.col("id").alias(f"{side}_id"), *carried, F.posexplode(prefix).alias(f"_{side}_at", "_t"))

    l = cut_lineage(ordered(left)) if own else ordered(left)  # read from both sides
    r = prefixes(l if own else ordered(right), "right", right_prefix)
    l = prefixes(l, "left", left_prefix)
    nl, nr = F.col("_left_n"), F.col("_right_n")
    keys = [*on, "_t"]
    if reach is not None:
        l, r, keys = l.withColumn("_m", F.explode(reach[0](F.col("left_id")))), r.withColumn("_m", reach[1](F.col("right_id"))), [*keys, "_m"]
    least = need(nl, nr)
    fits = (F.least(nl, nr) >= least) & (F.least(nl - F.col("_left_at"), nr - F.col("_right_at")) >= least)
    if own:
        smaller = F.col("left_id") < F.col("right_id")
        fits = (smaller if reach is None else (reach[1](F.col("left_id")) < F.col("_m")) | smaller) & fits
    met = l.join(r, keys).where(fits)
    if retell:
        pairs = met.select(*on, "left_id", "right_id", "_left_n", "_right_n").distinct().where(F.lit(True) if quick is None else quick).withColumn("_both", F.size(F.array_intersect(retell(F.col("left_id")), retell(F.col("right_id"))))).where(F.col("_both") >= least)
    else:
        shared = met.withColumn("_shared", F.array_intersect("_left", "_right"))  # in order of rarity
        pairs = shared.where(F.col("_shared")[0] == F.col("_t")).withColumn("_both", F.size("_shared")).where(F.col("_both") >= least)
    return pairs.select(*on, "left_id", "right_id", F.col("_both").alias("shared"), nl.alias("left_size"), nr.alias("right_size"))


def similarity_join(left: DataFrame, right: DataFrame | None, on: list[str], threshold: float) -> DataFrame:
    """``overlap_join`` of sets with Jaccard similarity of at least ``threshold``.

    Result: the ``on`` columns, ``left_id``, ``right_id``, ``jaccard``. A set of n tokens needs a
    prefix of n - ceil(threshold * n) + 1.
    """
    prefix = lambda n: n - F.ceil(n * threshold - 1e-9) + 1
    need = lambda nl, nr: F.greatest(F.ceil((nl + nr) * (threshold / (1 + threshold)) - 1e-9), F.ceil(nl * threshold - 1e-9), F.ceil(nr * threshold - 1e-9))
    pairs = overlap_join(left, right, on, need, prefix, prefix)
    jaccard = F.col("shared") / (F.col("left_size") + F.col("right_size") - F.col("shared"))
    return pairs.select(*on, "left_id", "right_id", jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-9)


def edit_join(left: DataFrame, right: DataFrame | None, on: list[str], most: Callable[[Column], Column], top: int = 2) -> DataFrame:
    """Candidate pairs of texts (``id``) of the same ``on`` values within the edits that ``most`` tolerates
    in the shorter one (a number that doesn't fall with length, ``top`` at most): ``left_id``, ``right_id``.

    Texts are sets of pairs of letters, start and end marked, digit one, i and l read as one. An edit (a
    swap too) changes at most three pairs, so texts within d edits share all but 3 d of either set: the
    prefix of the 3 d + 1 rarest pairs holds one of those, and lengths, a key of the join, differ by d at
    most. Without ``right``, pairs of ``left``, the shorter one left. Texts shorter than three letters, or
    of fewer different pairs than edits may change, may be missed. Pairs aren't verified.
    """
    read = lambda w: F.translate(w, "1i", "ll")
    tokens = lambda w: grams(read(w))
    quick = F.levenshtein(read("left_id"), read("right_id"), 2 * top) >= 0  # a swap counts twice there
    sets = lambda df: df.select(*on, "id", tokens(F.col("id")).alias("tokens"))
    shorter = F.when(F.length("left_id") < F.length("right_id"), F.col("left_id")).otherwise(F.col("right_id"))
    need = lambda nl, nr: F.greatest(F.greatest(nl, nr) - 3 * most(shorter), F.lit(1))
    prefix = lambda _: 3 * most(F.col("id")) + 1
    least = (lambda w: F.length(w)) if right is None else (lambda w: F.greatest(F.length(w) - most(w), F.lit(1)))
    reach = (lambda w: F.sequence(least(w), F.length(w) + most(w)), lambda w: F.length(w))
    return overlap_join(sets(left), None if right is None else sets(right), on, need, prefix, prefix, reach, tokens, quick).select(*on, "left_id", "right_id")


def best_match(pairs: DataFrame, by: list[str], score: str, *ties: str) -> DataFrame:
    """The row of each ``by`` with the highest score, then the least ``ties``."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), *ties)
    return pairs.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")
