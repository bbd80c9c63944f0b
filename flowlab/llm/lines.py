"""Line-first cleaning: rules per line, then per document, in column expressions only.

Lines that look like navigation, boilerplate or symbol noise, or that are a
run of many words without any sentence punctuation, are removed; a document
is rejected when the removed lines hold more than ``max_lost`` of its words.
A document also fails on the base counts: fewer than ``min_words`` words, or
more than ``max_repeat`` of its words in a run of ``gram`` words that the
text holds twice or more.  Runs are compared by a 64-bit hash of hashes, so
two runs of one text are mistaken for each other with a chance below 1e-10
for a text of 100,000 words.

Defined results: null text is empty (no words, rejected); lines are split at
line feeds only; a blank line is neither kept nor removed text; repeated
rows each get their row; columns named like the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.text import fresh, quoted

SPACE = r"\x20\x09-\x0D"
SYMBOLS = r"#*$%&|<>"
RESULT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "n_words_removed", "clean_text"]

#: Phrases of boilerplate lines, lower case.
BOILERPLATE = ["all rights reserved", "cookie policy", "enable javascript", "licensed under", "lorem ipsum", "privacy policy", "released under", "sign in to", "subscribe to our", "terms of use"]
#: A line of several fields between bars or arrows, or of menu words.
NAVIGATION = r"(?:\S\s*(?:\||»|›|>)\s*\S.*){3,}"
#: A line with a word of letters and digits before a mark that ends a sentence or clause.
PUNCTUATED = r"[.!?…:;,][\"'”’»)\]]*(?:\s|$)"


def clean_lines(docs: DataFrame, min_words: int = 10, max_repeat: float = 0.2, gram: int = 5, max_lost: float = 0.5,
                long_line: int = 30, max_symbols: float = 0.5) -> DataFrame:
    """``docs`` (needs ``text``) with RESULT columns; ``clean_text`` is the kept lines, joined by line feeds."""
    docs = docs.drop(*RESULT)
    columns = docs.columns
    w, lines, runs, order, places, words_of, keep, t = (fresh(columns, x) for x in ("w_", "lines_", "runs_", "order_", "places_", "words_of_", "keep_", "t_"))
    col = F.col

    out = docs.withColumn(t, F.coalesce("text", F.lit("")))
    out = out.withColumns({
        w: F.filter(F.split(t, f"[{SPACE}]+"), lambda x: x != ""),
        lines: F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]")),
        "n_symbols": F.length(t) - F.length(F.regexp_replace(t, f"[{SYMBOLS}]+", "")),
    })
    out = out.withColumns({
        "n_words": F.size(w),
        "word_chars": F.length(F.array_join(w, "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        runs: F.transform(w, lambda x: F.xxhash64(x)),
        words_of: F.transform(lines, lambda x: F.regexp_count(x, F.lit(f"[^{SPACE}]+"))),
    }).drop(t, w)
    at = [f"{runs}[i + {k}]" for k in range(gram)]
    out = out.withColumn(runs, F.expr(f"CASE WHEN n_words >= {gram} THEN transform(sequence(0, n_words - {gram}), i -> xxhash64({', '.join(at)})) ELSE array() END"))
    out = out.withColumn(order, F.expr(f"CASE WHEN size(array_distinct({runs})) < size({runs}) THEN sort_array(transform({runs}, (h, i) -> named_struct('h', h, 'i', i))) ELSE array() END")).drop(runs)
    out = out.withColumn(places, F.expr(f"sort_array(transform(filter({order}, (x, j) -> x.h = get({order}, j - 1).h OR x.h = get({order}, j + 1).h), x -> x.i))")).drop(order)
    out = out.withColumn("n_repeat_words", F.expr(f"aggregate(transform({places}, (p, j) -> least({gram}, coalesce(get({places}, j + 1) - p, {gram}))), 0, (a, x) -> a + x)")).drop(places)

    def good(line, i):
        n = F.get(words_of, i)
        symbols = F.length(line) - F.length(F.regexp_replace(line, f"[{SYMBOLS}]", ""))
        boilerplate = F.lit(False)
        for phrase in BOILERPLATE:
            boilerplate |= F.contains(F.lower(line), F.lit(phrase))
        return ~(boilerplate | line.rlike(NAVIGATION) | (symbols > max_symbols * n) | ((n >= long_line) & ~line.rlike(PUNCTUATED)))

    out = out.withColumn(keep, F.transform(lines, good))
    out = out.withColumns({
        "n_lines_removed": F.size(F.filter(keep, lambda x: ~x)),
        "n_words_removed": F.expr(f"aggregate({words_of}, 0, (a, x) -> a + x) - aggregate(filter({words_of}, (x, i) -> {keep}[i]), 0, (a, x) -> a + x)"),
        "clean_text": F.array_join(F.filter(lines, lambda x, i: F.get(keep, i)), "\n"),
        "base_failed": (col("n_words") < min_words) | (100 * col("n_repeat_words") > 100 * max_repeat * col("n_words")),
    })
    out = out.withColumn("kept", ~col("base_failed") & (col("n_words_removed") <= max_lost * col("n_words")))
    counts = [c for c in RESULT if c.startswith(("n_", "word"))]
    return out.select(*quoted(columns), *[col(c).cast("long").alias(c) if c in counts else col(c) for c in RESULT])
