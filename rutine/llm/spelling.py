"""Spelling variants: words at an edit distance of one, found by their rarest positional bigrams.

One edit destroys at most two bigrams of a word, so two near words share the first of their bigrams, in any order of all bigrams, that
the edit has left, and it is among the first three of either. The order is rarest first, over the whole vocabulary. What that bigram's place
says is exact: the edit is behind it, and the words agree from their start up to it, or before it, and they agree from it to
their end. The remainder agrees in its first or its second half, too, for there is one edit only. So joins go by
(bigram and what is on its untouched side, half of the remainder), and candidates are verified."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rutine.llm.common import arrow_batches, drop, table, written
from rutine.llm.line_dedup import LOWER, UPPER

#: A run of letters, and how many code points a word has at least.
LETTERS, LEAST = "[A-Za-z\\u00C0-\\u00FF]", 7


def letter_words(docs: DataFrame, least: int = LEAST, slips: int | None = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z in lower case, of at least `least` code points, and how often each occurs.

    With slips, runs lose a letter first: of those whose crc32 of "<id>:<run>" it divides, the one at crc32 % length. A null text has none;
    a null id is written as nothing. Words are counted within each task before they are exchanged."""
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(f"({LETTERS}{{{least},}})"), F.lit(1))).alias("run"))
    word = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    runs = runs.select("id", word.alias("word"))
    if slips:
        h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        runs = runs.withColumn("h", h).select(F.when(F.col("h") % slips == 0, cut).otherwise(F.col("word")).alias("word"))
    return runs.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def bigram_counts(words: DataFrame) -> dict[str, int]:
    """How many places of the words have each bigram.

    The driver holds a row for each pair of letters: at most the square of the alphabet, 8100 for that of LETTERS."""
    at = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.where(F.length("word") > 1).select(F.explode(F.transform(at, lambda i: F.substr("word", i, F.lit(2)))).alias("gram"))
    return {r.gram: r.n for r in grams.groupBy("gram").agg(F.count("*").alias("n")).collect()}


def rarest(word: str, counts: dict[str, int], k: int = 3) -> list[int]:
    """Places of the word's k rarest bigrams, rarest first; ties by bigram, then by place."""
    return sorted(range(len(word) - 1), key=lambda i: (counts[word[i : i + 2]], word[i : i + 2], i))[:k]


def _sides(word: str, counts: dict[str, int]) -> Iterator[tuple[int, bool, bool]]:
    """(place, edit behind it, edit before it) of each bigram that may be the first one left.

    The second is the first one left only if the edit destroyed the first, the third only if it destroyed both, which then touch."""
    at = rarest(word, counts)
    yield at[0], True, True
    if len(at) > 1:
        yield at[1], at[0] > at[1], at[0] < at[1]
    if len(at) > 2 and abs(at[0] - at[1]) == 1:
        yield at[2], max(at[0], at[1]) > at[2], min(at[0], at[1]) < at[2]


def _keys(word: str, counts: dict[str, int], short: int) -> set[int]:
    """Hashes of what the word shares with a near word, where `short` is the length of the shorter of both, or of each.

    Of the part with the edit, of m letters in the shorter word, one edit leaves m - 1 at least at its two ends: the first m // 2, or the others but for one."""
    out = set()
    for at, behind, before in _sides(word, counts):
        if behind:
            rest, m = word[at + 2 :], short - at - 2
            out |= _halves(f"<{word[: at + 2]}", rest, m, short)
        if before:
            rest, m = word[:at], short - (len(word) - at)
            out |= _halves(f">{word[at:]}", rest, m, short)
    return out


def _halves(context: str, rest: str, m: int, short: int) -> set[int]:
    if m < 0:
        return set()
    half, told = m // 2, f"{short}{context}\0"
    out = {xxhash.xxh3_64_intdigest(f"{told}<{rest[:half]}") - 2**63}
    if half:
        out.add(xxhash.xxh3_64_intdigest(f"{told}>{rest[half - m :]}") - 2**63)
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, a_n, b_n) of every two words (word, n; words distinct, of four code points or more) of which one edit makes the other; each pair once.

    Shorter words may lose all of their bigrams to one edit, and are left out.

    Each word sends about six keys as the shorter of a pair or one of equal length, and as many as the longer one. Keys are 64-bit hashes:
    candidates are compared themselves."""
    spark = words.sparkSession
    arrow_batches(spark)
    counts = bigram_counts(words)

    def run(batches):
        for b in batches:
            keys, whose, longer = [], [], []
            for i, word in enumerate(b.column(0).to_pylist()):
                for long in (False, True):
                    mine = _keys(word, counts, len(word) - long)
                    keys += mine
                    whose += [i] * len(mine)
                    longer += [long] * len(mine)
            at = pa.array(whose, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column(0).take(at), b.column(1).take(at), pa.array(longer, pa.bool_())], names=["key", "word", "n", "longer"])

    keyed = written(words.where(F.length("word") > 3).select("word", F.col("n").cast("long")).mapInArrow(run, "key long, word string, n long, longer boolean"), "keyed")
    left = keyed.where("NOT longer").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = keyed.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "longer")
    both = left.join(right, "key").where("longer OR a < b").where(F.levenshtein("a", "b", 1) == 1)
    pairs = written(both.select("a", "b", "a_n", "b_n").distinct(), "pairs")
    drop(keyed)
    return pairs


def last_of(links: DataFrame) -> DataFrame:
    """(word, root): where a walk along links (word, form; one for each word, without a circle) ends, in a logarithmic number of rounds."""
    links = written(links.select("word", "form"), "links")
    while True:
        on = links.select(F.col("word").alias("form"), F.col("form").alias("next"))
        further = written(links.join(on, "form", "left").select("word", F.coalesce("next", "form").alias("form"), F.col("next").isNotNull().alias("moved")), "links")
        drop(links)
        if further.where("moved").isEmpty():
            return further.select("word", F.col("form").alias("root"))
        links = further.select("word", "form")
        links._rutine_path = further._rutine_path


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n), of at least four code points each, words distinct.

    form is the near word of largest n, the smallest of several in order of code points, if it has at least `times` the word's n;
    root is where forms of forms end, the word itself without a form. Words that stand alone have no near ones; an empty table gives an
    empty one. A word may have as many near ones as it has variations: they are folded, never held. No pair is left out."""
    words = written(words.select("word", "n"), "words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    ok = -F.col("best.minus") >= times * F.col("n")
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(ok, F.col("best.other")).alias("form"), F.when(ok, -F.col("best.minus")).alias("form_n"))
    out = written(out, "forms")
    roots = last_of(out.where("form IS NOT NULL"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(letter_words(table(spark, sf_dir, "documents", "doc_id", "text")).where("n >= 2"))


#: crc32 of {text}, bit by bit; DuckDB has no such function.
CRC32 = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(8 * strlen({text})),
    lambda i: (((strpos('0123456789ABCDEF', substr(hex({text}), 2 * (i // 8) + CASE WHEN i % 8 < 4 THEN 2 ELSE 1 END, 1)) - 1) >> (i % 4)::INT) & 1)::UBIGINT)),
    lambda c, b: xor(c >> 1, 3988292384::UBIGINT * (xor(c, b) & 1))))"""

ORACLE = {
    "op13_spelling": r"""
        WITH RECURSIVE o AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')) AS w FROM documents),
        r AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM o GROUP BY 1, 2),
        h AS (SELECT w, n, concat(doc_id, ':', w) AS t FROM r),
        c AS (SELECT w, n, """ + CRC32.format(text="t") + r""" AS c FROM h),
        s AS (SELECT CASE WHEN c % 31 = 0 THEN substr(w, 1, (c % length(w))::INT) || substr(w, (c % length(w))::INT + 2) ELSE w END AS word, n FROM c),
        v AS (SELECT word, sum(n)::BIGINT AS n FROM s WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        p AS (SELECT word, n, unnest(range(length(word)::BIGINT)) AS i FROM v),
        d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM p),
        e AS (SELECT a.word, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
              UNION SELECT a.word, b.word, b.n FROM d a JOIN v b ON a.cut = b.word
              UNION SELECT b.word, a.word, a.n FROM d a JOIN v b ON a.cut = b.word),
        g AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM e GROUP BY word),
        f AS (SELECT g.word, n_near, top, min(e.other) AS other FROM g JOIN e ON e.word = g.word AND e.other_n = g.top GROUP BY 1, 2, 3),
        x AS (SELECT v.word, CASE WHEN top >= 10 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * n THEN top END AS form_n
              FROM v LEFT JOIN f USING (word)),
        walk(word, root, step) AS (SELECT word, word, 0 FROM x
                                   UNION ALL SELECT walk.word, x.form, step + 1 FROM walk JOIN x ON x.word = walk.root WHERE x.form IS NOT NULL)
        SELECT x.word, form, root, n, n_near, form_n FROM x JOIN (SELECT word, arg_max(root, step) AS root FROM walk GROUP BY word) USING (word)""",
}
