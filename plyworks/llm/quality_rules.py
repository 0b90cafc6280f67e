"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Results for odd input: a null or empty text has no words and fails the base rule (kept is false); repeated rows are
judged one by one; an empty table gives an empty result; columns of the caller's are left as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyworks.llm.common import BLANKS, OWN, text_of, words_of

SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to a in is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son aux ou mais "
    "der die und den von zu das mit sich dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem "
    "el los y las del por con para una su al lo como pero sus ya este o fue"
).split()


@dataclass(frozen=True)
class Threshold:
    """A rule holds where low <= ratio <= high; a bound of None is open."""

    ratio: str
    low: float | None
    high: float | None


#: The production table. Ratios are those of `ratios()`.
THRESHOLDS = (
    Threshold("n_words", 50, None),
    Threshold("mean_word_chars", 2, 12),
    Threshold("symbols_per_word", None, 0.25),
    Threshold("stop_word_ratio", 0.02, None),
    Threshold("dup_line_ratio", None, 0.5),
    Threshold("repeat_word_ratio", None, 0.5),
    Threshold("ellipsis_line_ratio", None, 0.5),
    Threshold("bullet_line_ratio", None, 0.9),
)


def _own(name: str) -> str:
    return OWN + name


def _adjacent(column: str, pair) -> Column:
    """pair(a, b) of every two neighbours of a sorted array."""
    n = F.size(column)
    return F.zip_with(F.slice(column, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(column, F.lit(2), F.greatest(n - 1, F.lit(0))), pair)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with counts in columns named OWN + n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words, n_ellipsis_lines, n_bullet_lines.

    Windows of three words are hashed to 64 bits and sorted within their row; only texts in which some window returns pay for
    the sort. Nothing leaves the row, so there is no shuffle and no group.
    """
    c = _own
    out = docs.withColumn(c("text"), text_of(text))
    out = out.withColumns({c("words"): words_of(F.col(c("text"))), c("lines"): F.filter(F.split(c("text"), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    words = F.col(c("words"))
    out = out.withColumns(
        {
            c("n_words"): F.size(words).cast("long"),
            c("windows"): F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))),
            c("word_chars"): F.length(F.translate(c("text"), BLANKS, "")).cast("long"),
            c("n_symbols"): (F.length(c("text")) - F.length(F.translate(c("text"), SYMBOLS, ""))).cast("long"),
            c("n_lines"): F.size(c("lines")).cast("long"),
            c("n_dup_lines"): (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
            c("n_stop_words"): F.size(F.filter(words, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"),
            c("n_ellipsis_lines"): F.size(F.filter(c("lines"), lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long"),
            c("n_bullet_lines"): F.size(F.filter(c("lines"), lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•●]"))).cast("long"),
        }
    )
    windows = F.col(c("windows"))
    again = F.size(F.array_distinct(windows)) < F.size(windows)
    out = out.withColumn(c("sorted"), F.when(again, F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.flatten(_adjacent(c("sorted"), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
    out = out.withColumn(c("starts"), F.when(F.col(c("sorted")).isNotNull(), F.sort_array(F.array_distinct(twice))))
    covered = F.aggregate(_adjacent(c("starts"), lambda a, b: F.least(b - a, F.lit(3))), F.lit(3), lambda x, y: x + y)
    out = out.withColumn(c("n_repeat_words"), F.coalesce(F.when(F.size(c("starts")) > 0, covered), F.lit(0)).cast("long"))
    return out.drop(*(c(x) for x in ("words", "lines", "windows", "sorted", "starts", "text")))


def ratios() -> dict[str, Column]:
    """The ratios that thresholds speak of, over the columns of features(). Texts without words or lines have ratio 0."""
    c = lambda name: F.col(_own(name)).cast("double")
    over = lambda a, b: F.coalesce(F.try_divide(c(a), c(b)), F.lit(0.0))
    return {
        "n_words": c("n_words"),
        "mean_word_chars": over("word_chars", "n_words"),
        "symbols_per_word": over("n_symbols", "n_words"),
        "stop_word_ratio": over("n_stop_words", "n_words"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "repeat_word_ratio": over("n_repeat_words", "n_words"),
        "ellipsis_line_ratio": over("n_ellipsis_lines", "n_lines"),
        "bullet_line_ratio": over("n_bullet_lines", "n_lines"),
    }


def compile_rules(table=THRESHOLDS) -> Column:
    """One boolean expression that holds where every rule of the table does."""
    found, verdict = ratios(), F.lit(True)
    for rule in table:
        if rule.low is not None:
            verdict = verdict & (found[rule.ratio] >= F.lit(float(rule.low)))
        if rule.high is not None:
            verdict = verdict & (found[rule.ratio] <= F.lit(float(rule.high)))
    return verdict


def base_failed() -> Column:
    return (F.col(_own("n_words")) < 50) | (100 * F.col(_own("n_repeat_words")) > 50 * F.col(_own("n_words")))


def judge(docs: DataFrame, text: str = "text", table=THRESHOLDS) -> DataFrame:
    """docs with the features and two verdicts, all under the OWN prefix: base_failed and kept."""
    out = features(docs, text).withColumn(_own("base_failed"), base_failed())
    return out.withColumn(_own("kept"), ~F.col(_own("base_failed")) & compile_rules(table))


def keep(docs: DataFrame, text: str = "text", table=THRESHOLDS) -> DataFrame:
    """The rows that pass, with the caller's columns alone.

    A plain filter would be pushed below the projections and there repeat them for every mention of a count; a row is instead
    generated as often as it is kept, once or never, from counts that are computed once.
    """
    once = F.explode(F.when(F.col(_own("kept")), F.array(F.lit(True)))).alias(_own("once"))
    return judge(docs, text, table).select(*docs.columns, once).drop(_own("once"))
