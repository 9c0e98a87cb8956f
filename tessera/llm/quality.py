"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every figure is computed from the whole text by Spark's own expressions; there is no user
function, join or shuffle, so the plan is a scan and a projection.

Defined cases: a null text has no words and fails the base rule; a ratio over no words or
lines is null and its rule then passes (the base rule has already rejected the row);
a figure that equals its threshold passes; a very long text is judged whole; repeated rows are judged alike; an empty table gives
no rows; other columns of the input are kept as they are, whatever their names:
the figures are one struct, and :func:`keep_good` has the rest of a row in another meanwhile.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.words import BLANKS

SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for was on are as with he be at by it this from or an "
    "le la de les des et un une en que qui dans pour du au est par pas sur "
    "der die und das den von zu mit sich ist nicht ein eine im dem auf "
    "el los las y por con para del se no es su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """``figure`` must lie in [least, most] where the text has at least ``from_words`` words."""

    figure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The production thresholds, wide enough that ordinary prose in any listed language passes.
RULES = (
    Rule("mean_word_chars", least=2.0, most=15.0, from_words=20),
    Rule("symbols_per_word", most=0.10),
    Rule("shouts_per_word", most=0.30),
    Rule("stop_word_share", least=0.06, from_words=30),
    Rule("upper_share", most=0.50, from_words=20),
    Rule("dup_line_share", most=0.50),
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside a window of WINDOW words that the text holds at least twice."""

    def windows(hashes: Column) -> Column:
        last = F.size(hashes) - WINDOW
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(WINDOW)]))

    def covered(found: Column) -> Column:
        def spots(ordered: Column) -> Column:
            same = lambda x, i: F.get(ordered, i)["h"] == x["h"]
            twice = F.filter(ordered, lambda x, i: F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False)))
            return F.array_sort(F.transform(twice, lambda x: x["p"]))

        pairs = F.array_sort(F.transform(found, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"))
        return F.aggregate(_let(pairs, spots), start, step, lambda acc: acc["n"])

    zero = F.lit(0).cast("long")
    some = _let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: _let(windows(h), lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), zero).otherwise(covered(found))),
    )
    return F.when(F.size(words) <= WINDOW, zero).otherwise(some)


def figures(text: Column, words: Column) -> dict[str, Column]:
    """Counts and ratios of a text; ``words`` is its array of words."""
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    count_of = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(F.translate(line, " \t\n\x0b\x0c\r", "")) > 0)
    letters = F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": count_of(SYMBOLS),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(words),
        "n_lines": F.size(lines).cast("long"),
        "n_shouts": count_of("!"),
        "n_upper": letters.cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")).isin(STOP_WORDS))).cast("long"),
    }


def ratios(x: Column) -> dict[str, Column]:
    """What the rules are about; null where the denominator is zero."""
    over = lambda a, b: F.try_divide(x[a].cast("double"), x[b].cast("double"))
    return {
        "mean_word_chars": over("word_chars", "n_words"),
        "symbols_per_word": over("n_symbols", "n_words"),
        "shouts_per_word": over("n_shouts", "n_words"),
        "stop_word_share": over("n_stop_words", "n_words"),
        "upper_share": over("n_upper", "word_chars"),
        "dup_line_share": over("n_dup_lines", "n_lines"),
    }


def compile_rules(rules: tuple[Rule, ...], x: Column) -> Column:
    """One boolean: no rule of the table is broken."""
    value, ok = ratios(x), F.lit(True)
    for rule in rules:
        broken = F.lit(False)
        if rule.least is not None:
            broken = broken | (value[rule.figure] < rule.least)
        if rule.most is not None:
            broken = broken | (value[rule.figure] > rule.most)
        ok = ok & ~(F.coalesce(broken, F.lit(False)) & (x["n_words"] >= rule.from_words))
    return ok


def with_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", into: str = "quality_figures") -> DataFrame:
    """``docs`` with one more column: a struct of the figures, ``base_failed`` and ``kept``."""
    if into.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {into} already; name another with into=")
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, BLANKS), lambda w: w != "")
    counted = docs.withColumn(into, _let(words, lambda w: F.struct(*[c.alias(n) for n, c in figures(whole, w).items()])))
    x = F.col(into)
    failed = (x["n_words"] < 10) | (100 * x["n_repeat_words"] > 20 * x["n_words"])
    return counted.withColumn(into, x.withField("base_failed", failed).withField("kept", ~failed & compile_rules(rules, x)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document."""
    x = F.col("quality_figures")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_upper", "n_stop_words", "base_failed", "kept")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_quality(docs).select("doc_id", *[x[n].alias(n) for n in names])


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows that the rules keep, unchanged."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    judged = with_quality(whole, rules)
    # A plain filter would be pushed below the figures, and each of its references would compute them again;
    # a generated column stays above them.
    return judged.withColumn("kept", F.explode_outer(F.array(F.col("quality_figures")["kept"]))).filter("kept").select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, unchanged."""
    return keep_good(docs)


_LISTED = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
FIGURES_SQL = f"""
split AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(translate(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '')) > 0) AS ls
  FROM {{docs}}),
spots AS (SELECT doc_id, ws, unnest(range(len(ws) - 4)) AS p FROM split WHERE len(ws) > 5),
twice AS (SELECT doc_id, p FROM spots QUALIFY count(*) OVER (PARTITION BY doc_id, ws[p + 1:p + 5]) > 1),
repeats AS (SELECT doc_id, count(DISTINCT p + j) AS n FROM twice, range(5) AS r(j) GROUP BY doc_id),
figures AS (
  SELECT s.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(length(text) - length(translate(text, '!', '')) AS BIGINT) AS n_shouts,
         CAST(length(regexp_replace(text, '[^\\p{{{{Lu}}}}]', '', 'g')) AS BIGINT) AS n_upper,
         CAST(len(list_filter(ws, lambda w: rtrim(lower(w), '.,;:!?') IN ({_LISTED}))) AS BIGINT) AS n_stop_words
  FROM split s LEFT JOIN repeats r USING (doc_id)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM figures),
quality AS (
  SELECT *, NOT base_failed
    AND NOT (n_words >= 20 AND (word_chars / n_words < 2.0 OR word_chars / n_words > 15.0))
    AND NOT n_symbols / n_words > 0.10
    AND NOT n_shouts / n_words > 0.30
    AND NOT (n_words >= 30 AND n_stop_words / n_words < 0.06)
    AND NOT (n_words >= 20 AND n_upper / word_chars > 0.50)
    AND NOT coalesce(n_dup_lines / nullif(n_lines, 0) > 0.50, false) AS kept
  FROM judged)
"""
ORACLE_SQL = "WITH " + FIGURES_SQL.format(docs="documents") + (
    "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_shouts, n_upper, n_stop_words, base_failed, kept FROM quality"
)
