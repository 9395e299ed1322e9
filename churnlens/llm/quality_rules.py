"""Quality rules: line-first cleaning, with DataFrame expressions only.

Each line is judged by its own; lines that fail are removed; a document that
loses more than ``max_loss`` of its characters (white space aside) is
rejected, as is one that fails the base figures (fewer than 50 words, or over
half of its words in repeated three-word windows).

A line with a word fails when

* punctuation: it is short (under ``PROSE_WORDS`` words; longer lines are
  prose, which need not end here) and does not end in a punctuation mark of
  any script, or has at least five words and over 15 % of its characters
  (white space aside) are ``! ? . , ; :`` or symbols such as ``# * $ %``;
* navigation: it holds three or more separators such as ``|`` or ``>``, at
  least one for every four words;
* boilerplate: a phrase of page furniture (cookie notice, sign-in, rights
  notice and the like), found on word bounds, makes up a quarter of its words
  or more, so that prose that happens to use the phrase passes.

All steps work on one row: no shuffle, no Python, memory bounded by one text.

Defined results: null text counts as empty; an empty text has no words and
fails the base; blank lines are neither judged nor counted; repeated rows get
the same result; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm.frames import documents

WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = r"[#*$%&|<>]"
#: Closing marks that are most frequent; then those of every script, without
#: the ones that close nothing.
CLOSING = [*".!?:;…。！？\"'”’»)]"]
MARK_OF_ANY_SCRIPT = r"[\p{Po}\p{Pe}\p{Pf}\p{Pi}]"
NOT_CLOSING = [*"#*%&@/\\,"]
PROSE_WORDS = 12
MARKS = r"[!?.,;:#*$%&|<>]"
SEPARATORS = r"[|>»›•·]"
#: Looked for in the lower-cased line, between characters that are no letters
#: or digits.
BOILERPLATE = (
    "accept all cookies", "accept cookies", "cookie policy", "cookie settings", "use cookies", "uses cookies", "enable javascript",
    "privacy policy", "terms of use", "terms of service", "all rights reserved", "lorem ipsum", "sign in", "log in", "sign up",
    "click here", "read more", "share this", "subscribe now", "subscribe to our newsletter", "copyright ©",
)
RIGHTS_YEAR = r"\(c\) [0-9]{4}"
#: Words of the line per word of the phrase, at most.
PHRASE_SHARE = 4
MIN_WORDS = 50
MAX_REPEAT = 50
MAX_LOSS = 0.5


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _bare_length(text: Column) -> Column:
    """Characters that are not white space."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return F.length(text)


def bounded(phrase: str) -> str:
    return rf"(^|[^\p{{L}}\p{{N}}]){phrase}($|[^\p{{L}}\p{{N}}])"


def line_fails(line: Column, low: Column) -> Column:
    """Whether a line (with a word) fails a rule; ``low`` is the line in
    lower case.  Cheap tests stand first: Spark skips the rest of an AND or OR
    once it is decided."""
    last = F.substring(F.rtrim(line, F.lit(WHITE)), -1, 1)
    closed = last.isin(CLOSING) | (last.rlike(MARK_OF_ANY_SCRIPT) & ~last.isin(NOT_CLOSING))
    words = _count(line, WORD)
    punctuation = (~closed & (words < PROSE_WORDS)) | ((_count(line, MARKS) * 100 > _bare_length(line) * 15) & (words >= 5))
    separators = _count(line, SEPARATORS)
    navigation = (separators >= 3) & (separators * 4 >= words)
    boilerplate = low.contains("(c) ") & (words <= 2 * PHRASE_SHARE) & low.rlike(RIGHTS_YEAR)
    for phrase in BOILERPLATE:
        boilerplate = (low.contains(phrase) & (words <= PHRASE_SHARE * len(phrase.split())) & low.rlike(bounded(phrase))) | boilerplate
    return punctuation | boilerplate | navigation


def base_figures(docs: DataFrame, text_col: str, wrap) -> DataFrame:
    """Adds (under names of its own) the words, lines and base figures."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    out = docs.withColumn(wrap("text"), text)
    out = out.withColumns({
        wrap("words"): F.regexp_extract_all(wrap("text"), F.lit(WORD), F.lit(0)),
        wrap("lines"): F.filter(F.split(wrap("text"), "\n"), lambda x: x.rlike(WORD)),
    })
    n = F.size(wrap("words"))
    words = F.col(wrap("words"))
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    out = out.withColumn(wrap("hashes"), F.slice(hashes, 1, F.greatest(n - 2, F.lit(0))))
    # windows found twice or more stand side by side once sorted; a text
    # without any (the usual case) is not sorted
    h = F.col(wrap("hashes"))
    windows = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn(wrap("windows"), F.when(F.size(F.array_distinct(h)) < F.size(h), windows))
    s = F.col(wrap("windows"))
    twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
    covered = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    t = F.col(wrap("text"))
    return out.withColumns({
        wrap("n_words"): n.cast("bigint"),
        wrap("word_chars"): _bare_length(t).cast("bigint"),
        wrap("n_symbols"): _count(t, SYMBOLS).cast("bigint"),
        wrap("n_dup_lines"): (F.size(wrap("lines")) - F.size(F.array_distinct(wrap("lines")))).cast("bigint"),
        wrap("n_repeat_words"): F.when(s.isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(covered))).cast("bigint"),
    })


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines_removed", "loss", "kept")


def quality_rules(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT,
                  max_loss: float = MAX_LOSS) -> DataFrame:
    """Every input row with its cleaned text, the base figures,
    ``base_failed``, ``n_lines_removed``, ``loss`` and ``kept``.  An input
    column that has a result's name gives way to the result."""
    prefix = "_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"

    def wrap(name: str) -> str:
        return prefix + name

    out = base_figures(docs, text_col, wrap)
    judged = F.zip_with(F.split(wrap("text"), "\n"), F.split(F.lower(wrap("text")), "\n"),
                        lambda x, low: F.when(~x.rlike(WORD) | ~line_fails(x, low), x))
    out = out.withColumn(wrap("cleaned"), F.filter(judged, lambda x: x.isNotNull()))
    left = _bare_length(F.array_join(wrap("cleaned"), "\n"))
    out = out.withColumns({
        wrap("base_failed"): (F.col(wrap("n_words")) < min_words) | (100 * F.col(wrap("n_repeat_words")) > max_repeat * F.col(wrap("n_words"))),
        wrap("n_lines_removed"): (F.size(F.split(wrap("text"), "\n")) - F.size(wrap("cleaned"))).cast("bigint"),
        wrap("loss"): F.when(F.col(wrap("word_chars")) > 0, 1 - left / F.col(wrap("word_chars"))).otherwise(F.lit(0.0)),
    })
    out = out.withColumn(wrap("kept"), ~F.col(wrap("base_failed")) & (F.col(wrap("loss")) <= max_loss))
    rest = [F.array_join(wrap("cleaned"), "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in RESULTS]
    # a generator of one row: a filter on the results stays above it, instead
    # of being evaluated a second time, expression by expression, below
    return out.select(F.inline(F.array(F.struct(*rest, *[F.col(wrap(c)).alias(c) for c in RESULTS]))))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict of every document."""
    return quality_rules(documents(spark, sf_dir)).select("doc_id", *RESULTS)


def _boilerplate_sql() -> str:
    """One test per number of words in a phrase."""
    sizes = sorted({len(p.split()) for p in BOILERPLATE})
    tests = [(k, bounded("(" + "|".join(p for p in BOILERPLATE if len(p.split()) == k) + ")")) for k in sizes] + [(2, RIGHTS_YEAR)]
    return " OR ".join(f"(n <= {PHRASE_SHARE * k} AND regexp_matches(lower(l), '{pattern}'))" for k, pattern in tests)


#: The same in DuckDB SQL; regular expressions are written for RE2.
OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
tri AS (
    SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
    FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
line AS (
    SELECT r, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n
    FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)),
judged AS (
    SELECT r, l, len(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS bare,
        (n < 12 AND NOT regexp_matches(l, '[.!?:;…。！？"''”’»)\]\p{Po}\p{Pe}\p{Pf}\p{Pi}][\x20\x09-\x0D]*$'))
        OR (n < 12 AND regexp_matches(l, '[#*%&@/\\,][\x20\x09-\x0D]*$'))
        OR (n >= 5
            AND 100 * len(regexp_replace(l, '[^!?.,;:#*$%&|<>]', '', 'g')) > 15 * len(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')))
        OR (len(regexp_replace(l, '[^|>»›•·]', '', 'g')) >= 3
            AND 4 * len(regexp_replace(l, '[^|>»›•·]', '', 'g')) >= n)
        OR %BOILERPLATE% AS fails
    FROM line WHERE n > 0),
lines AS (
    SELECT r, count(*) - count(DISTINCT l) AS dup, count(*) FILTER (fails) AS gone, coalesce(sum(bare) FILTER (NOT fails), 0) AS kept_chars
    FROM judged GROUP BY r),
figures AS (
    SELECT doc_id, len(ws)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0)::BIGINT AS n_lines_removed, coalesce(kept_chars, 0) AS kept_chars
    FROM w LEFT JOIN cov USING (r) LEFT JOIN lines USING (r)),
judgement AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        CASE WHEN word_chars > 0 THEN 1 - kept_chars::DOUBLE / word_chars ELSE 0.0 END AS loss FROM figures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines_removed, loss,
    NOT base_failed AND loss <= 0.5 AS kept
FROM judgement
""".replace("%BOILERPLATE%", _boilerplate_sql())
