"""Evaluation texts leaking into documents: template windows, hash join, slot consistency."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotaloom.session import cut_lineage

WINDOW = 12
#: Words for units of measure.
UNITS = ["units", "unit", "mm", "cm", "m", "km", "g", "kg", "s", "ms", "h", "k", "hours", "days", "packets", "pieces", "samples", "points", "steps", "percent"]

_MACRO = re.compile(r"\\(?:(?:re)?newcommand|providecommand)\*?\s*\{?\\([A-Za-z@]+)\}?\s*\{([^{}\\]*)\}|\\def\s*\\([A-Za-z@]+)\s*\{([^{}\\]*)\}")
# every pattern begins with a literal sign, which the regex engine finds fast
_GONE = re.compile(r"\\(?:-|(?:[a-zA-Z]*cite[a-zA-Z]*|ref|eqref|autoref|[cC]ref|pageref|label|footnotemark|index|hspace|vspace|includegraphics)\*?\s*(?:\[[^\[\]]*\]\s*){0,2}(?:\{[^{}]*\})?)")
_UNSEEN = ("\u00ad", "\u200b", "\u200c", "\u200d", "\u2060", "\ufeff")
_BROKEN = re.compile(r"-(?<=[^\W\d_]-)[ \t]*\r?\n[ \t]*(?:%+[ \t]*)*(?=[^\W\d_])")
_ACCENT = re.compile(r"\\([\"'`^~=.]|[uvHcdbkr](?![A-Za-z]))\s*(?:\{\s*(\\[ij]|[A-Za-z])\s*\}|(\\[ij](?![A-Za-z])|[A-Za-z]))")
_SIGN = re.compile(r"\\(aa|AA|ae|AE|oe|OE|o|O|ss|l|L|i|j)(?![A-Za-z])\s?(?:\{\})?")
_SIGNS = {"aa": "å", "AA": "Å", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "ss": "ß", "l": "ł", "L": "Ł", "i": "i", "j": "j"}
_COMBINING = {'"': "̈", "'": "́", "`": "̀", "^": "̂", "~": "̃", "=": "̄", ".": "̇", "u": "̆", "v": "̌", "H": "̋", "c": "̧", "d": "̣", "b": "̱", "k": "̨", "r": "̊"}
_COMMAND = re.compile(r"\\[A-Za-z@]+\*?")
_GLUE = re.compile(r"\{(?:(?<=[^\W\d_]\{)([^\W\d_]+)\}|([^\W\d_]+)\}(?=[^\W\d_]))")


def _accent(m: re.Match) -> str:
    return unicodedata.normalize("NFC", (m[2] or m[3]).lstrip("\\") + _COMBINING[m[1]])


def readable(text: str) -> str:
    """``text`` as a reader of the source reads it, for comparing words: comments stay; macros with plain
    text are put in, citations, references and layout commands taken out, accents and ligatures are one
    letter, words broken at line ends are joined, and case is folded."""
    if "\\" in text:
        if "command" in text or "\\def" in text:
            for m in _MACRO.finditer(text):
                name, body = m[1] or m[3], m[2] if m[1] else m[4]
                if body.strip() and text.count("\\" + name) > 1:
                    text = re.sub(r"\\" + name + r"(?![A-Za-z@])(?:\{\}|[ \t]+(?=[^\W_]))?", lambda _, b=body: f" {b} ", text)
        text = _GONE.sub("", text)
        text = _SIGN.sub(lambda m: _SIGNS[m[1]], _ACCENT.sub(_accent, text))
        text = _COMMAND.sub(" ", text)
    if "{" in text:
        text = _GLUE.sub(lambda m: m[1] or m[2], text)
    if not text.isascii():
        for sign in _UNSEEN:
            text = text.replace(sign, "")
    text = _BROKEN.sub("", text)
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()


_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd


def _powers(n: int, base: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, base, np.uint64))))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


_WORD_CHAR = np.zeros(0x30000, bool)
for _c in range(0x30000):
    _WORD_CHAR[_c] = chr(_c).isalnum()


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, is-a-number flag and text number of every word of the (readable) texts."""
    joined = " ".join(texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))[:-1]
    inside = _WORD_CHAR[np.minimum(codes, 0x2FFFF)]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64)
    size = end - begin
    value = np.zeros(len(begin), np.uint64)
    order = np.argsort(-size, kind="stable")
    sorted_size, at = size[order], begin[order]
    with np.errstate(over="ignore"):
        for k in range(int(sorted_size[0]) if len(sorted_size) else 0):  # k-th letter of every word that has one
            n = int(np.searchsorted(-sorted_size, -k, "left"))
            if n == 0:
                break
            value[:n] = (value[:n] + codes[at[:n] + k].astype(np.uint64) + np.uint64(1)) * _B1
    out = np.empty_like(value)
    out[order] = _mix(value)
    digit = (codes >= 48) & (codes <= 57)
    counted = np.concatenate(([0], np.cumsum(digit)))
    number = counted[end] - counted[begin] == size
    return out, number, np.searchsorted(starts, begin, "right") - 1


def _window_hash(values: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(max(0, len(values) - width + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _B2 + values[k : k + len(out)]
    return _mix(out)


_NUMBER, _UNIT, _NAME = np.uint64(11), np.uint64(12), np.uint64(13)


def windows(texts: list[str], common: np.ndarray, units: np.ndarray, width: int, wanted: np.ndarray | None = None, fixed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template hash, slot hash, pattern and text number of every window of ``width`` words within one text.

    A template has typed placeholders for numbers, for words of ``units`` and for names (words that
    aren't in the sorted ``common``); the slots are the words that the placeholders stand for; the pattern
    has a sign for each word, the place (from one) of the first slot that holds the same word. ``wanted`` (bits by the template's lowest bits) drops windows
    that can't match, ``fixed`` those with fewer words that are no placeholders."""
    value, number, owner = words(texts)
    none = np.zeros(0, np.uint64)
    if len(value) < width:
        return none, none, np.zeros(0, f"U{width}"), np.zeros(0, np.int64)
    unit = np.isin(value, units)
    if len(common):
        place = np.minimum(np.searchsorted(common, value), len(common) - 1)
        known = common[place] == value
    else:
        known = np.zeros(len(value), bool)
    slot = number | unit | ~known
    typed = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(known, value, _NAME)))
    template = _window_hash(typed, width)
    keep = owner[: len(template)] == owner[width - 1 :]
    if fixed:
        plain = np.concatenate(([0], np.cumsum(~slot)))
        keep &= plain[width:] - plain[:-width] >= fixed
    if wanted is not None:
        bit = template & np.uint64(len(wanted) * 8 - 1)
        keep &= (wanted[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
    at = np.flatnonzero(keep)
    slots = np.where(slot, value, np.uint64(0))
    filled, pattern = np.zeros(len(at), np.uint64), np.zeros((len(at), width), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(width):
            own = slots[at + k]
            filled = filled * _B1 + own
            first = np.full(len(at), k, np.uint32)
            for j in range(k - 1, -1, -1):
                first = np.where(slots[at + j] == own, np.uint32(j), first)
            pattern[:, k] = np.where(own == 0, np.uint32(k), first) + np.uint32(1)
    return template[at], _mix(filled), pattern.view(f"U{width}")[:, 0], owner[at]


def _hashes(texts: list[str]) -> np.ndarray:
    return np.unique(words(texts)[0])


def _told(source: DataFrame, key: str) -> DataFrame:
    return source.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(key, "text")


def _common_words(asked: DataFrame, share: float) -> np.ndarray:
    """The words that stand in at least ``share`` of the items (and in two): as an item has few words, there
    are at most its words' number over ``share`` of these, however many items there are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"w": np.concatenate([_hashes([readable(t)]) for t in batch.text] or [np.zeros(0, np.uint64)]).view(np.int64)})

    total = asked.count()  # one number
    counted = asked.mapInPandas(run, "w bigint").groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, share * total))
    return np.sort(counted.select("w").toPandas().w.to_numpy(np.int64).view(np.uint64))


def _flags(marks: DataFrame, most_bits: int) -> np.ndarray:
    """Bits by the templates' lowest bits, 16 or more for each template, as far as ``most_bits`` allow."""
    count = marks.select("t").distinct().count()  # one number
    bits = 1 << min(max(15, (16 * max(count, 1) - 1).bit_length()), most_bits)
    bit = F.col("t").bitwiseAND(F.lit(bits - 1))
    parts = marks.select(F.floor(bit / 32768).cast("bigint").alias("b"), (bit % 32768).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).toPandas()
    out = np.zeros(bits // 8, np.uint8)
    for b, m in zip(parts.b, parts.m):
        out[b * 4096 : (b + 1) * 4096] = np.frombuffer(m, np.uint8)
    return out


def _marked(documents: DataFrame, items: DataFrame, width: int, share: float, fixed: int, most_bits: int) -> tuple[DataFrame, DataFrame]:
    """The windows (``t``, ``s``, ``p``) of the items, written, and those of the documents that may match one."""
    spark = documents.sparkSession
    asked = _told(items, "item_id").distinct()
    units, common = _hashes([" ".join(UNITS)]), _common_words(asked, share)

    def scan(source: DataFrame, key: str, flags: np.ndarray | None) -> DataFrame:
        packed = spark.sparkContext.broadcast((common, units, flags))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            common, units, wanted = packed.value
            for batch in batches:
                for lo in range(0, len(batch), 200):
                    part = batch.iloc[lo : lo + 200]
                    t, s, p, owner = windows([readable(x) for x in part.text], common, units, width, wanted, fixed)
                    out = pd.DataFrame({key: part[key].to_numpy()[owner], "t": t.view(np.int64), "s": s.view(np.int64), "p": p.astype(object)})
                    yield out.drop_duplicates()

        return source.mapInPandas(run, T.StructType([T.StructField(key, source.schema[key].dataType), T.StructField("t", T.LongType()), T.StructField("s", T.LongType()), T.StructField("p", T.StringType())]))

    marks = cut_lineage(scan(asked, "item_id", None).distinct())
    return marks, scan(_told(documents, "doc_id"), "doc_id", _flags(marks, most_bits))


def leaked_items(documents: DataFrame, items: DataFrame, width: int = WINDOW, share: float = 0.03, most_bits: int = 30) -> DataFrame:
    """Documents that contain at least ``width`` consecutive words of an item's text.

    ``documents``: ``doc_id``, ``text``; ``items``: ``item_id``, ``text``; further columns are ignored.
    Result: ``doc_id``, ``item_id``, distinct. Null ids, null or blank texts and texts shorter than
    ``width`` words have no rows. Repeated rows count once; copies of an item are all reported.

    Texts are made readable, then canonicalised into templates: numbers, units and names (all words but
    those found in at least ``share`` of the items) become typed placeholders. Windows of templates are
    joined by hash, and slots must hold the same values in the same places (their hash is the second
    key), so that questions of one template with other parameters don't match (``retold_items`` finds
    those). Both hashes have 64 bits.

    The items' templates become a filter of bits, built by Spark, of at least 16 bits a template up to
    2 ** ``most_bits`` bits (128 MB) in all; windows of documents that can't match are dropped by it
    before the join, at any number of items. Documents are read whole, once.
    """
    marks, found = _marked(documents, items, width, share, 0, most_bits)
    return found.select("doc_id", "t", "s").join(marks.select("item_id", "t", "s"), ["t", "s"]).select("doc_id", "item_id").distinct()


def _consistent(found: Column, asked: Column, width: int) -> Column:
    """Whether slots that are equal in the pattern ``asked`` are equal in ``found``; further ones may be."""
    sign = lambda p, k: F.substring(p, k, 1)
    return F.forall(F.sequence(F.lit(1), F.lit(width)), lambda k: sign(found, F.ascii(sign(asked, k))) == sign(found, k))


def retold_items(documents: DataFrame, items: DataFrame, width: int = WINDOW, share: float = 0.03, fixed: int = 5, least: int = 4, most_bits: int = 30, each: bool = False) -> DataFrame:
    """Documents that tell an item's question with other numbers, names or units.

    Inputs as for ``leaked_items``. Result: ``doc_id``, ``item_id``, ``windows``: items of the same windows,
    as to templates and equal slots, are one class, told by its least ``item_id``, or with ``each`` by a
    row for each of its items; ``windows`` is the number of the class's windows that the document retells,
    at least ``least`` (so ``width + least - 1`` words). Windows need at least ``fixed`` words that are no
    placeholders. A window that items of several classes have counts for each class.

    A document's window retells an item's if its template is the same and its slots are consistent: of the
    same types in the same places, and equal where the item's are equal, whatever the values (so they may be
    equal where the item's differ). The very words of any item retell none; they neither count nor keep
    others from counting, as a part without placeholders reads the same in a retold question.
    """
    marks, found = _marked(documents, items, width, share, fixed, most_bits)
    had = marks.select("item_id", "t", F.col("p").alias("_asked")).distinct()
    told = [F.bit_xor(F.xxhash64("t", "_asked")).alias("_x"), F.bit_xor(F.xxhash64("_asked", "t")).alias("_y"), F.count("*").alias("_n")]  # of a set of windows, in any order
    sets = cut_lineage(had.groupBy("item_id").agg(*told))
    first = sets.groupBy("_x", "_y", "_n").agg(F.min("item_id").alias("item_id"))
    classes = had.join(first.select("item_id"), "item_id")
    other = found.join(marks.select("t", "s").distinct(), ["t", "s"], "left_anti")
    met = other.select("doc_id", "t", "p").join(classes, "t").where(_consistent(F.col("p"), F.col("_asked"), width))
    counted = met.groupBy("doc_id", "item_id").agg(F.count_distinct("t", "_asked").cast("int").alias("windows")).where(F.col("windows") >= least)
    if each:
        counted = counted.join(first, "item_id").drop("item_id").join(sets, ["_x", "_y", "_n"])
    return counted.select("doc_id", "item_id", "windows")
