"""Line-first quality rules in SQL expressions.

Each line is tested first (punctuation, navigation, boilerplate, symbols,
capitals), lines that fail are removed, and a document is rejected when it
loses too much text that way, or by its base statistics.

Everything is computed within the row: no shuffle, no Python.  Repeated words
are found by sorting a document's 64-bit window hashes with their positions.

Defined results: a null text counts as empty; an empty text has no words and
fails the base rules; repeated rows get equal answers; other columns pass
through, and those named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base rules: least words, and the largest share (percent) of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Largest share (percent) of a document's line characters that line cleaning may remove.
MAX_REMOVED_PERCENT = 30
#: A line of this many words or more must end in punctuation, or it fails once it has no punctuation inside either.
UNPUNCTUATED_WORDS = 12
SYMBOL_PERCENT, CAPITAL_PERCENT, CAPITAL_LETTERS = 8, 60, 20
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Phrases of page furniture.
BOILERPLATE = (
    "(?i)\\b(cookie policy|uses cookies|privacy policy|terms of use|terms of service|all rights reserved|enable javascript|"
    "sign up for|subscribe to our|click here|read more|log in to|skip to content|back to top|share this|lorem ipsum|"
    "tous droits réservés|alle rechte vorbehalten|todos los derechos reservados|politique de confidentialité|datenschutzerklärung|política de privacidad)"
)
#: Three or more separators of a menu.
NAVIGATION = r"([|»›·•].*){3,}"


def _line_fails() -> str:
    """SQL of the lambda body over a trimmed line ``l``: true where a rule fails."""
    q = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    count = lambda chars: f"length(regexp_replace(l, {q(f'[^{chars}]+')}, ''))"
    # a necessary condition that is quick to test stands before each costly one
    few = CAPITAL_LETTERS * CAPITAL_PERCENT // 100
    return f"""(
        l rlike {q(f'{NAVIGATION}|{BOILERPLATE}')}
        or (l rlike {q(SYMBOLS)} and 100 * regexp_count(l, {q(SYMBOLS)}) > {SYMBOL_PERCENT} * length(regexp_replace(l, {q(SPACE)}, '')))
        or (regexp_count(l, '[A-Z]') > {few} and {count('A-Za-z')} >= {CAPITAL_LETTERS} and 100 * {count('A-Z')} > {CAPITAL_PERCENT} * {count('A-Za-z')})
        or (not l rlike '[.,;:!?]' and size(split(l, {q(SPACE)})) >= {UNPUNCTUATED_WORDS}))"""


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", F.array_remove(F.split(whole, SPACE), ""))
    hashes = "transform(sequence(0, size(_words) - 3), i -> xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2)))"
    out = out.withColumn("_hashes", F.expr(f"if(size(_words) < 3, cast(array() as array<bigint>), {hashes})"))
    # where windows repeat: their hashes in order, each with its position
    placed = "sort_array(transform(_hashes, (h, i) -> named_struct('h', h, 'i', i)))"
    out = out.withColumn("_sorted", F.expr(f"if(size(array_distinct(_hashes)) = size(_hashes), cast(array() as array<struct<h:bigint,i:int>>), {placed})"))
    out = out.withColumn("_at", F.expr("sort_array(transform(filter(_sorted, (x, j) -> x.h <=> get(_sorted, j - 1).h or x.h <=> get(_sorted, j + 1).h), x -> x.i))"))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(WORD))
    return (
        out.withColumn("_lines", lines)
        .withColumns(
            {
                "n_words": F.size("_words").cast("bigint"),
                "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
                "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)).cast("bigint"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
                "n_repeat_words": F.expr("aggregate(transform(_at, (p, j) -> cast(least(3, coalesce(get(_at, j + 1), p + 3) - p) as bigint)), 0L, (a, b) -> a + b)"),
            }
        )
        .drop("_words", "_hashes", "_sorted", "_at")
    )


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the statistics, line_chars, removed_chars, base_failed and kept."""
    out = statistics(docs, text)
    out = out.withColumn("_trimmed", F.transform("_lines", lambda line: F.trim(line, F.lit(" \t\r\x0b\x0c"))))
    total: Column = F.expr("aggregate(_trimmed, 0L, (a, l) -> a + length(l))")
    removed: Column = F.expr(f"aggregate(filter(_trimmed, l -> {_line_fails()}), 0L, (a, l) -> a + length(l))")
    out = out.withColumns({"line_chars": total, "removed_chars": removed})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        out.withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (100 * F.col("removed_chars") <= MAX_REMOVED_PERCENT * F.col("line_chars")))
        .drop("_lines", "_trimmed")
    )


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """``judge`` with the text cleaned of failed lines (null stays null)."""
    lines = F.expr(f"array_join(filter(transform(split({text}, '\\n'), x -> trim(BOTH ' \\t\\r' FROM x)), l -> l = '' or not {_line_fails()}), '\\n')")
    return judge(docs, text).withColumn("clean_text", lines)


def oracle(path: str = "documents") -> str:
    """DuckDB SQL with the rows of ``op2_quality_rules``."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    visible = f"length(regexp_replace(l, {q(SPACE)}, '', 'g'))"
    fails = f"""(
        regexp_matches(l, {q(NAVIGATION)}) or regexp_matches(l, {q(BOILERPLATE)})
        or 100 * (length(l) - length(regexp_replace(l, {q(SYMBOLS)}, '', 'g'))) > {SYMBOL_PERCENT} * {visible}
        or (length(regexp_replace(l, '[^A-Za-z]+', '', 'g')) >= {CAPITAL_LETTERS}
            and 100 * length(regexp_replace(l, '[^A-Z]+', '', 'g')) > {CAPITAL_PERCENT} * length(regexp_replace(l, '[^A-Za-z]+', '', 'g')))
        or (len(regexp_split_to_array(l, {q(SPACE)})) >= {UNPUNCTUATED_WORDS} and not regexp_matches(l, '[.,;:!?]')))"""
    return f"""
    with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from {path}),
    w as (select rid, doc_id, text, regexp_extract_all(text, {q(WORD + '+')}) as words,
            list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {q(WORD)})) as lines from d),
    grams as (select rid, i, words[i] as a, words[i + 1] as b, words[i + 2] as c
            from (select rid, words, unnest(range(1, len(words) - 1)) as i from w)),
    twice as (select rid, i from (select rid, i, count(*) over (partition by rid, a, b, c) as n from grams) where n > 1),
    covered as (select rid, count(distinct i + o) as n_repeat_words from twice, (select unnest([0, 1, 2]) as o) group by rid),
    trimmed as (select rid, list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) as trimmed from w),
    bases as (select w.rid, doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
            (length(text) - length(regexp_replace(text, {q(SYMBOLS)}, '', 'g')))::bigint as n_symbols,
            (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
            coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
            coalesce(list_sum(list_transform(trimmed, lambda l: length(l))), 0)::bigint as line_chars,
            coalesce(list_sum(list_transform(list_filter(trimmed, lambda l: {fails}), lambda l: length(l))), 0)::bigint as removed_chars
          from w join trimmed using (rid) left join covered using (rid)),
    failed as (select *, (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) as base_failed from bases)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line_chars, removed_chars, base_failed,
           (not base_failed and 100 * removed_chars <= {MAX_REMOVED_PERCENT} * line_chars) as kept from failed"""
