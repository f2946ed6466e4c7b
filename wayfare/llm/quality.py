"""Quality rules: a threshold table compiled into one projection, without user functions.

Each rule is a row (name, feature, low, high); a document passes when every feature lies between its bounds. The table is
compiled into one boolean expression next to the features themselves, so a scan, one projection and no shuffle do the work.

Defined cases: a null or blank text has no words, all counts 0, and fails; repeated rows are judged each by itself; very
long texts are judged whole, and memory is bounded by the longest text. Extra columns are kept by :func:`annotate`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import free_name, text

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that it for was on are as with be by this or from at have not but had "
    "le la les des de et un une du en que qui dans pour pas sur est au par avec plus ce "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es an "
    "el los las del y por con no para una su al lo como más pero sus se o"
).split()

SPACE_CLASS = "[ \\t-\\r]"


@dataclass(frozen=True)
class Rule:
    """``low <= feature <= high``; a bound of None is open."""

    name: str
    feature: str
    low: float | None = None
    high: float | None = None

    def passes(self, ratios: Column) -> Column:
        c = ratios[self.feature]
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (c >= F.lit(float(self.low)))
        if self.high is not None:
            ok = ok & (c <= F.lit(float(self.high)))
        return ok


#: Production thresholds. The base rules of length and repetition are separate (see ``base_failed``).
RULES = (
    Rule("mean_word_length", "mean_word_length", 2.0, 20.0),
    Rule("symbols_per_word", "symbol_ratio", None, 0.3),
    Rule("stop_words", "stop_ratio", 0.02, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
    Rule("repeated_words", "repeat_ratio", None, 0.5),
)
MIN_WORDS, MAX_REPEAT = 50, 50


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once, however often it is used and wherever Spark moves the expression."""
    return F.transform(F.array(value), then)[0]


def _words(t: Column) -> Column:
    w = F.split(F.regexp_replace(t, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", ""), f"{SPACE_CLASS}+")
    return _let(w, lambda w: F.when(F.length(F.get(w, F.lit(0))) == 0, F.array().cast("array<string>")).otherwise(w))


def _windows(w: Column) -> Column:
    """Chained 64-bit hashes of the 3-word windows."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(hashes)


def _repeat_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more.

    Texts without a repeated window end at the distinct count; the others sort their windows once, and the starts of
    repeated ones cover up to three words each.
    """

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == x["h"])))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(starts, state, lambda c, i: F.struct((c["n"] + F.least(F.lit(3), i - c["last"])).alias("n"), i.alias("last")), lambda c: c["n"])

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_let(ordered, covered))


def _counts(t: Column, w: Column) -> Column:
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    return F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        _let(_windows(w), _repeat_words).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(list(dict.fromkeys(STOP_WORDS))))).cast("long").alias("n_stop"),
    )


def _verdict(c: Column, rules: tuple[Rule, ...], min_words: int, max_repeat: int) -> Column:
    n = F.greatest(c["n_words"], F.lit(1)).cast("double")
    ratios = F.struct(
        c["n_words"].cast("double").alias("n_words"), (c["word_chars"] / n).alias("mean_word_length"), (c["n_symbols"] / n).alias("symbol_ratio"), (c["n_stop"] / n).alias("stop_ratio"),
        (c["lines"]["dup"] / F.greatest(c["lines"]["n"], F.lit(1)).cast("double")).alias("dup_line_ratio"), (c["n_repeat_words"] / n).alias("repeat_ratio"),
    )
    base = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat * c["n_words"])
    failed = lambda r: F.array_compact(F.array(*[F.when(~x.passes(r), F.lit(x.name)) for x in rules])) if rules else F.array().cast("array<string>")
    out = lambda v: F.struct(
        c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"), c["lines"]["n"].alias("n_lines"), c["lines"]["dup"].alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"),
        c["n_stop"].alias("n_stop"), v["base"].alias("base_failed"), (~v["base"] & (F.size(v["failed"]) == 0)).alias("kept"), v["failed"].alias("failed_rules"),
    )
    return _let(_let(ratios, lambda r: F.struct(base.alias("base"), failed(r).alias("failed"))), out)


def verdict(rules: tuple[Rule, ...] = RULES, column: str = "text", min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT) -> Column:
    """The counts, ``base_failed``, ``kept`` and ``failed_rules`` of a text, as one struct of one projection."""
    return _let(text(column), lambda t: _let(_words(t), lambda w: _let(_counts(t, w), lambda c: _verdict(c, rules, min_words, max_repeat))))


def annotate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, column: str = "text", min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """docs and, as its last column, ``verdict()`` named ``_q``; where docs has that column, underscores are put before the name."""
    return docs.withColumn(free_name(docs, "_q"), verdict(rules, column, min_words, max_repeat))


def kept(docs: DataFrame, rules: tuple[Rule, ...] = RULES, column: str = "text") -> DataFrame:
    """The rows of docs that pass; no column is added or lost."""
    return docs.where(verdict(rules, column)["kept"])
