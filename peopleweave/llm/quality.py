"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

A sketch is a table of counts: each figure, a whole number, is cut to its ``BITS`` leading bits, which is exact below 2 ** BITS and at most one part in
2 ** (BITS - 1) too low beyond it. Sketches merge by adding counts, so Spark builds them map-side, languages merge from their sources, and the whole
corpus from its languages. Thresholds are fences: the quartiles, moved out by ``FENCES`` times the distance between them or a rule's least width.
A source with fewer than ``LEAST_DOCS`` documents takes those of its language, a language with fewer those of the corpus.
The fences are then joined to the documents by language and source.
"""
from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, stored, with_results

BITS = 8
FENCES, LEAST_DOCS = 3, 100
# Rules on figures in thousandths: (name, least width between the quartiles, whether low figures fail as well).
RULES = (("word_length", 150, True), ("symbol_rate", 50, False), ("dup_line_rate", 150, False), ("repeat_rate", 120, False))

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """(words, code points in words, symbols, lines with a word, lines equal to an earlier one, words in 3-word windows found twice or more)."""
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often, end = Counter(windows), 0
        for i, window in enumerate(windows):
            if often[window] > 1:
                repeated += i + 3 - max(end, i)
                end = i + 3
    return len(words), sum(map(len, words)), sum(map(text.count, _SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated


def with_figures(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Documents with the counts of ``measure``, base_failed and the figures of ``RULES``; a null text counts as an empty one."""
    def start():
        return lambda columns: list(zip(*[measure(t or "") for t in columns["text"]]))
    counts = {c: "long" for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")}
    out = with_results(docs, {"text": F.col(f"`{text_col}`")}, start, counts, keep)
    rate = lambda a, b: F.expr(f"CASE WHEN {b} > 0 THEN 1000 * {a} DIV {b} ELSE 0 END")
    return out.withColumns({"base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
                            "word_length": rate("word_chars", "n_words"), "symbol_rate": rate("n_symbols", "n_words"),
                            "dup_line_rate": rate("n_dup_lines", "n_lines"), "repeat_rate": rate("n_repeat_words", "n_words")})


def cut(value: Column, bits: int = BITS) -> Column:
    """A whole number of zero or more with all but its leading bits set to zero: its place in a sketch."""
    shift = F.greatest(F.length(F.bin(value)) - bits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketch(df: DataFrame, keys: list[str], figures: list[str]) -> DataFrame:
    """(keys, figure, place, n): how many rows have a figure at a place. Counts are formed before the shuffle, so a hot key sends a few rows per task."""
    places = F.explode(F.array(*[F.struct(F.lit(f).alias("figure"), cut(F.col(f)).alias("place")) for f in figures])).alias("x")
    return df.select(*keys, places).groupBy(*keys, "x.figure", "x.place").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser keys."""
    return sketches.groupBy(*keys, "figure", "place").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], shares: dict[str, tuple[int, int]]) -> DataFrame:
    """(keys, figure, n, one column per share p / q): the first place that at least p / q of the rows do not exceed.

    A window holds the places of one key and figure, of which there are at most 64 * 2 ** BITS.
    """
    places = Window.partitionBy(*keys, "figure").orderBy("place")
    upto = sketches.withColumns({"upto": F.sum("n").over(places), "of": F.sum("n").over(Window.partitionBy(*keys, "figure"))})
    return upto.groupBy(*keys, "figure").agg(F.max("of").alias("n"), *[F.min(F.when(F.col("upto") * q >= F.col("of") * p, F.col("place"))).alias(name) for name, (p, q) in shares.items()])


def fences(measured: DataFrame, lang: str = "lang", source: str = "source", fence: int = FENCES, least_docs: int = LEAST_DOCS, rules=RULES) -> DataFrame:
    """(lang, source, own, low_<figure>, high_<figure>) per language and source; ``own`` names whose sketch holds: source, lang or corpus."""
    fine = stored(sketch(measured.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), *[r[0] for r in rules]), ["lang", "source"], [r[0] for r in rules]), "sketches")
    shares = {"q1": (1, 4), "q3": (3, 4)}
    ends = {}
    for figure, width, low in rules:
        at = lambda c, f=figure: F.max(F.when(F.col("figure") == f, F.col(c)))
        wide = F.greatest(at("q3") - at("q1"), F.lit(width)) * fence
        ends[figure] = [(at("q1") - wide if low else F.lit(None).cast("long")).alias(f"low_{figure}"), (at("q3") + wide).alias(f"high_{figure}")]

    def level(keys: list[str]) -> DataFrame:
        table = quantiles(fine if keys == ["lang", "source"] else merge(fine, keys), keys, shares)
        return table.groupBy(*keys).agg(F.max("n").alias("n"), F.struct(*[c for pair in ends.values() for c in pair]).alias("ends"))

    langs = level(["lang"]).select(F.col("lang").alias("of"), F.when(F.col("n") >= least_docs, F.col("ends")).alias("by_lang"))
    corpus = level([]).select(F.col("ends").alias("by_corpus"))
    groups = level(["lang", "source"]).withColumn("by_source", F.when(F.col("n") >= least_docs, F.col("ends")))
    groups = groups.join(langs, F.col("lang").eqNullSafe(F.col("of")), "left").join(F.broadcast(corpus), F.lit(True), "left")    # one row
    own = F.when(F.col("by_source").isNotNull(), "source").when(F.col("by_lang").isNotNull(), "lang").otherwise("corpus")
    return groups.select("lang", "source", own.alias("own"), F.coalesce("by_source", "by_lang", "by_corpus").alias("e")).select("lang", "source", "own", "e.*")


def judge(docs: DataFrame, text_col: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None, fence: int = FENCES,
          least_docs: int = LEAST_DOCS, rules=RULES) -> DataFrame:
    """Documents with their counts, figures, fences (``own`` says whose), base_failed and kept.

    Only documents that pass the base rules shape the fences and are held against them. A null language or source is a group of its own;
    repeated rows count as often as they occur. Documents whose group has no fence, because all of it fails the base rules, are not kept anyway.
    An empty table gives no rows. Columns of the input with the name of a result give way to it.
    """
    kept = [c for c in (docs.columns if keep is None else keep)]
    groups = {"__lang": F.col(f"`{lang}`"), "__source": F.col(f"`{source}`")}
    measured = stored(with_figures(docs.withColumns(groups), text_col, [*kept, *groups]), "figures")
    known = stored(fences(measured.filter(~F.col("base_failed")), "__lang", "__source", fence, least_docs, rules), "fences")
    figures = [r[0] for r in rules]
    known = known.withColumnsRenamed({c: f"__{c}" for c in known.columns if c in ("lang", "source")} | {"lang": "__l", "source": "__s"})
    own = set(known.columns) | {"kept"}
    measured = measured.drop(*[c for c in own if c in measured.columns])
    same = measured["__lang"].eqNullSafe(known["__l"]) & measured["__source"].eqNullSafe(known["__s"])
    inside = F.lit(True)
    for figure in figures:
        inside &= (F.col(figure) <= F.col(f"high_{figure}")) & (F.col(figure) >= F.coalesce(f"low_{figure}", figure))
    out = measured.join(broadcast_if_small(known), same, "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))
    return out.drop("__lang", "__source", "__l", "__s")


def keep_good(docs: DataFrame, text_col: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Documents that pass the base rules and the fences of their group, with their own columns only."""
    marked = judge(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text_col}`").alias("__text"), F.col(f"`{lang}`").alias("__of_lang"),
                               F.col(f"`{source}`").alias("__of_source")), "__text", "__of_lang", "__of_source", keep=["__row"])
    return marked.filter("kept").select("__row.*")
