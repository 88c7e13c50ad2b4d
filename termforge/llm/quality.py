"""Problem 1: statistics of each text that tell running prose from lists, tables and junk, and of each name that tell it from junk values.

The statistics of a text are counted once, in the Arrow pass that takes its main part out of the page; those of a name are SQL
expressions. An ordered list of rules over them is induced from labelled rows by incremental reduced-error pruning: each rule is
grown condition by condition on one part of the labels by information gain, pruned from its end on the other part, and kept while
it is right more often than wrong there. The learned thresholds become a SQL CASE expression that is applied to all rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termforge.llm.boilerplate import article
from termforge.llm.encodings import is_garbled, restore
from termforge.llm.words import slices, words
from termforge.plans.tables import cut, join_sized

#: Rules are induced from at most this many labelled documents, by the order of a hash of their id.
MOST_LABELLED = 20_000
#: Words that most running texts hold, for the languages of the corpus.
COMMON = tuple(
    """the of and to in that is was were for it with as his on be at by had not are but from or have an they which one you all her she there would their we him been has when who will no more if out so what up than
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über
    le la les de des et à un une du en est que qui dans il au ce ne pas sur se plus par pour avec son sa ses aux ou où sans
    el los las y del se con una su al lo como más pero sus por para
    o os as da do dos em um uma não na no ao mais foi são
    w i z na się nie do jest to że od po przez przed za
    и в не на я что он с как это по но они мы за из у к до при без""".split()
)
_COMMON = "array(" + ", ".join(f"'{w}'" for w in dict.fromkeys(COMMON)) + ")"
_TERMINAL = ".!?。…”\"’»:"

#: The four measures that exported feature schemas name, over a column ``t`` (never null).
MEASURES = {
    "doc_word_count": "size(w)",
    "doc_mean_word_length": "length(array_join(w, '')) / nullif(size(w), 0)",
    "doc_symbol_ratio": r"length(regexp_replace(t, '[\\p{L}\\p{N}\\s]+', '')) / nullif(length(t), 0)",
    "doc_terminal_line_ratio": f"size(filter(l, x -> contains('{_TERMINAL}', right(x, 1)))) / nullif(size(l), 0)",
    "doc_common_word_ratio": f"size(filter(w, x -> array_contains({_COMMON}, x))) / nullif(size(w), 0)",
}
#: What the rules may ask, in the order of ``text_statistics``.
STATISTICS = ("chars", "words", "lines", "word_chars", "line_words", "words_per_end", "terminal_lines", "bullet_lines", "distinct_lines", "distinct_words", "distinct_sentences", "common_words", "symbols", "digits", "separators", "columns", "commas", "turned_ends", "odd_neighbours")
_COMMON_WORDS = frozenset(COMMON)
_SENTENCE_SPLIT = re.compile(r"[.!?。]\s*")
_END = re.compile(r"[.!?。](?:(?<=[^\W_]{2}.)|(?<=[^\W_]{2}[)”\"’»].))(?=[\s”\"’»)]|$|[^\x00-\x7F])")
_BULLET = re.compile(r"(?:[-*•–·›]|\[[ xX]?\]|\d{1,3}[.)]|[a-z]\))\s")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'’“”\"()–-]|_")
_DIGIT = re.compile("[0-9]")
_COLUMN = re.compile(r" {2,}(?=\S)")
_TURNED = re.compile(r"\s[.,!?][^\W\d_”]|\s[.,!?]”")
#: English words after which a noun group must follow, and words that begin none.
_BEFORE_NOUNS = frozenset("the a an of to".split())
_NO_NOUNS = frozenset("a an of to in and or is was were than by for with had has have not but they he she we it at on as will".split())


def text_statistics(t: str) -> tuple[float, ...] | None:
    """The statistics of a text; None for a blank one. What has no value for a text without words or sentences is 0."""
    lines = [x for x in (y.strip(" \t\r\n") for y in t.split("\n")) if x]
    if not lines:
        return None
    w = words(t)
    sentences = [x for x in _SENTENCE_SPLIT.split(t) if x]
    d, chars, nw, nl = set(w), len(t), len(w), len(lines)
    per_word = nw or 1
    odd = sum(a in _BEFORE_NOUNS and b in _NO_NOUNS for a, b in zip(w, w[1:])) if not d.isdisjoint(_BEFORE_NOUNS) else 0
    return (
        chars, nw, nl, chars / nw if nw else 0.0, nw / nl,
        (nw or chars) / (len(_END.findall(t)) + 0.5),
        sum(x[-1] in _TERMINAL for x in lines) / nl,
        sum(_BULLET.match(x) is not None for x in lines) / nl,
        len(set(lines)) / nl,
        len(d) / per_word,
        len(set(sentences)) / (len(sentences) or 1),
        len(d & _COMMON_WORDS) / (len(d) or 1),
        len(_SYMBOL.findall(t)) / chars,
        len(_DIGIT.findall(t)) / chars,
        (t.count("\t") + t.count("|") + t.count(";") + t.count("=")) / nl,
        len(_COLUMN.findall(t)) / nl,
        t.count(",") / per_word,
        len(_TURNED.findall(t)) / per_word,
        odd / per_word,
    )


def _parsed(df: DataFrame, text: str) -> DataFrame:
    lines = r"array_remove(split(trim(BOTH ' \t\r\n' FROM t), '[ \t\r]*\n[ \t\r\n]*'), '')"
    tokens = r"array_remove(split(lower(t), '[^\\p{L}\\p{N}]+'), '')"
    return df.withColumn("t", F.coalesce(F.col(text), F.lit(""))).withColumns({"w": F.expr(tokens), "l": F.expr(lines)})


def measures(df: DataFrame, record: str, text: str) -> DataFrame:
    """``record`` and the measures above, one row per row of ``df``. Null counts as empty; what an empty text has no value for is 0."""
    rows = _parsed(df.select(F.col(record).alias("record"), F.col(text).alias("body")), "body")
    return rows.select("record", *[F.coalesce(F.expr(sql).cast("double" if name != "doc_word_count" else "bigint"), F.lit(0)).alias(name) for name, sql in MEASURES.items()])


def _statistics_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, 1):
        rows, found = [], []
        for i, text in enumerate(texts):
            if text and not text.isascii() and is_garbled(text):
                text = restore(text)
            values = text_statistics(article(text, mended=True)) if text else None
            if values is not None:
                rows.append(i)
                found.append(values)
        columns = np.array(found, float).reshape(len(found), len(STATISTICS)).T
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *map(pa.array, columns)], names=["record", *STATISTICS])


def statistics(df: DataFrame, record: str, body: str) -> DataFrame:
    """``record`` and the statistics of the main part of each body, without page furniture and with wrong encodings mended.

    Null, empty and blank bodies, and bodies of furniture only, give no row.
    """
    source = df.select(F.col(record).alias("record"), F.col(body).alias("body")).where("body is not null")
    return source.mapInArrow(_statistics_batches, ", ".join([f"record {source.schema['record'].dataType.simpleString()}", *(f"`{n}` double" for n in STATISTICS)]))


@dataclass(frozen=True)
class Rule:
    """A class and the conditions (statistic, sign, threshold) that together give it."""

    label: str
    conditions: tuple[tuple[str, str, float], ...]

    def sql(self) -> str:
        return " and ".join(f"`{name}` {sign} {value!r}D" for name, sign, value in self.conditions)

    def holds(self, values: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(values), bool)
        for name, sign, value in self.conditions:
            column = values[:, names.index(name)]
            out &= column <= value if sign == "<=" else column >= value
        return out


def _best_condition(values: np.ndarray, positive: np.ndarray) -> tuple[int, str, float] | None:
    """The condition of the greatest information gain over the rows that a rule still covers."""
    p0, n0 = positive.sum(), (~positive).sum()
    base = np.log2(p0 / (p0 + n0))
    best, found = 1e-9, None
    for j in range(values.shape[1]):
        order = np.argsort(values[:, j], kind="stable")
        v, y = values[order, j], positive[order]
        ends = np.flatnonzero(v[1:] > v[:-1])  # a threshold lies between two different values
        if not len(ends):
            continue
        below_p, below_n = np.cumsum(y)[ends], np.cumsum(~y)[ends]
        for sign, p, n in (("<=", below_p, below_n), (">=", p0 - below_p, n0 - below_n)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -1)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = gain[k], (j, sign, float((v[ends[k]] + v[ends[k] + 1]) / 2))
    return found


def _grown(values: np.ndarray, positive: np.ndarray, names: list[str], label: str) -> Rule:
    rows, conditions = np.ones(len(values), bool), []
    while (~positive[rows]).any() and positive[rows].any():
        condition = _best_condition(values[rows], positive[rows])
        if condition is None:
            break
        j, sign, value = condition
        conditions.append((names[j], sign, value))
        rows &= values[:, j] <= value if sign == "<=" else values[:, j] >= value
    return Rule(label, tuple(conditions))


def _pruned(rule: Rule, values: np.ndarray, positive: np.ndarray, names: list[str]) -> tuple[Rule, float]:
    """The beginning of the rule with the best (p - n) / (p + n) on other rows; the longest of equals."""
    best, worth = rule, -1.0
    for size in range(len(rule.conditions), 0, -1):
        short = Rule(rule.label, rule.conditions[:size])
        covered = short.holds(values, names)
        p, n = int((covered & positive).sum()), int((covered & ~positive).sum())
        value = (p - n) / (p + n) if p + n else -1.0
        if value > worth:
            best, worth = short, value
    return best, worth


def induced(values: np.ndarray, labels: np.ndarray, names: list[str], default: str, part: np.ndarray) -> list[Rule]:
    """An ordered rule list for all labels but ``default``, the rarest label first; ``part`` (0..2) says which third a row is in: 2 prunes, and the others in
    turn where no rule holds up. A label is done when no third confirms another rule.

    A third without a row of the label cannot confirm anything: with one or two labelled rows of a kind the rows that are there prune too.
    """
    rules: list[Rule] = []
    kinds, counts = np.unique(labels, return_counts=True)
    left = np.ones(len(labels), bool)
    for _, label in sorted((c, k) for k, c in zip(kinds, counts) if k != default):
        failed = 0
        while failed < 3:
            positive = left & (labels == label)
            if not positive.any():
                break
            pruning = (part + failed) % 3 == 2
            grow, prune = left & ~pruning, left & pruning
            grow = grow if (positive & grow).any() else left
            prune = prune if (positive & prune).any() else left
            rule = _grown(values[grow], positive[grow], names, str(label))
            rule, worth = _pruned(rule, values[prune], positive[prune], names)
            covered = rule.holds(values, names) & left
            if not rule.conditions or worth <= 0 or not (covered & positive).any():
                failed += 1  # another third prunes
                continue
            rules.append(rule)
            left &= ~covered
    return rules


def nested(values: np.ndarray, labels: np.ndarray, names: list[str], default: str, part: np.ndarray) -> list[Rule]:
    """Rules for anything but ``default`` first, as all its kinds together have more labelled rows to prune on than each has, then rules for the
    kind of what they cover; as one ordered list."""
    other = labels != default
    if not other.any():
        return []
    kinds, counts = np.unique(labels[other], return_counts=True)
    most = str(kinds[np.argmax(counts)])
    inner = induced(values[other], labels[other], names, most, part[other])
    outer = induced(values, np.where(other, "other", default), names, default, part)
    return [Rule(k.label, r.conditions + k.conditions) for r in outer for k in [*inner, Rule(most, ())]]


def rules_sql(rules: list[Rule], default: str) -> str:
    """The rule list as one CASE expression."""
    return "case " + " ".join(f"when {r.sql()} then '{r.label}'" for r in rules) + f" else '{default}' end" if rules else f"'{default}'"


def learned_rules(stats: DataFrame, labels: DataFrame, record: str, label: str, default: str = "prose") -> list[Rule]:
    """Rules from the labelled records among ``stats`` (a cut table); null labels, records with two labels and records without statistics are left out."""
    once = labels.where(F.col(record).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(record).alias("record")).agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other")
    once = cut(once.select("record", "label", F.xxhash64("record").alias("h")).orderBy("h", "record").limit(MOST_LABELLED), "labelled")
    rows = sorted({(r["h"], r["label"], *[r[n] for n in STATISTICS]) for r in join_sized(stats, once, "record").toLocalIterator()})
    if not rows:
        return []
    return nested(np.array([r[2:] for r in rows], float), np.array([r[1] for r in rows]), list(STATISTICS), default, np.array([r[0] % 3 for r in rows]))


def classified(stats: DataFrame, rules: list[Rule], default: str = "prose") -> DataFrame:
    """``record, kind`` by the rule list, applied as SQL."""
    return stats.select("record", F.expr(rules_sql(rules, default)).alias("kind"))


# Names


#: The statistics of a name, over its value ``v`` without blanks around, lower-cased.
NAME_STATISTICS = {
    "length": "length(v)",
    "letters": "length(regexp_replace(v, '[^a-z]', '')) / greatest(length(v), 1)",
    "digits": "length(regexp_replace(v, '[^0-9]', '')) / greatest(length(v), 1)",
    "symbols": r"length(regexp_replace(v, '[a-z0-9_. \\-]', '')) / greatest(length(v), 1)",
    "vowels": "length(regexp_replace(v, '[^aeiouy]', '')) / greatest(length(regexp_replace(v, '[^a-z]', '')), 1)",
    "consonant_run": "coalesce(array_max(transform(split(v, '[^bcdfghjklmnpqrstvwxz]+'), x -> length(x))), 0)",
    "digit_run": "coalesce(array_max(transform(split(v, '[^0-9]+'), x -> length(x))), 0)",
    "joints": "regexp_count(v, '[_. -]{2,}') + regexp_count(v, '^[^a-z]') + regexp_count(v, '[^a-z0-9]$')",
}
#: A value that stands in this share of the records, and in so many, is taken for a name.
NAME_SHARE, NAME_RECORDS = 0.05, 3


def no_names(names: list[str]) -> list[str]:
    """Values that are no names, made of names by rule: their consonants alone, their hash in hexadecimal, runs of signs, rows of numbers, placeholders and records of them."""
    out = ["", "-", "n/a", "null | null"]
    for name in names:
        h = hashlib.blake2b(name.encode(), digest_size=8).hexdigest()
        digits = [str(int(h[i : i + 2], 16)) for i in range(0, 8, 2)]
        sign = "#-=*<>~@!?"[int(h[0], 16) % 10]
        out += ["".join(c for c in name * 2 if c in "bcdfghjklmnpqrstvwxz")[:14], "0x" + h[:8], sign * (2 + int(h[1], 16)), ";".join(digits), f"%{name[:3]}{digits[0]}%_??", f"{{'{name}': {digits[0]}, '{name[::-1]}': {digits[1]}}}", " | ".join(["n/a"] * (1 + int(h[2], 16) % 4))]
        out.append("".join("*<>=~@!_"[int(c, 16) % 8] for c in h[:12]))
    return out


def _name_values(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("v", F.lower(F.regexp_replace(F.col(name), r"^\s+|\s+$", "")))


def _named_statistics(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, *[F.expr(sql).cast("double").alias(n) for n, sql in NAME_STATISTICS.items()])


def name_rules(df: DataFrame, record: str, name: str) -> list[Rule]:
    """Rules for values that are no names (label ``junk``), from the values that most records share, their parts, and what ``no_names`` makes of them.

    The shared values are at most ``MOST_LABELLED``, by the order of a hash. A table without shared values gives the rules of the made values alone.
    """
    rows = cut(_name_values(df.where(F.col(name).isNotNull()), name).groupBy("v").agg(F.countDistinct(record).alias("records")), "name-values")
    records = df.agg(F.countDistinct(record).alias("n")).first()["n"]
    shared = rows.where(F.col("records") >= max(NAME_RECORDS, NAME_SHARE * records)).orderBy(F.xxhash64("v"), "v").limit(MOST_LABELLED)
    names = [r["v"] for r in shared.collect()]  # at most MOST_LABELLED
    names += sorted({p for x in names for p in re.split(r"[_. -]", x) if len(p) > 3 and p.isalpha()} - set(names))
    wrong = sorted(set(no_names(names)) - set(names))
    made = df.sparkSession.createDataFrame([(v, k) for k, vs in (("name", names), ("junk", wrong)) for v in vs], "v string, label string")
    known = sorted(tuple(r) for r in _named_statistics(made, "label", "v").collect())
    values = np.array([r[2:] for r in known], float)
    part = np.array([int(hashlib.blake2b(r[1].encode(), digest_size=4).hexdigest(), 16) % 3 for r in known])
    return induced(values, np.array([r[0] for r in known]), list(NAME_STATISTICS), "name", part) if names else []


def odd_names(df: DataFrame, key: list[str], name: str, rules: list[Rule]) -> DataFrame:
    """The rows of ``df`` (columns ``key`` and ``value``) whose non-null value is no name made of word-like parts, by the rule list as SQL.

    Letter case and blanks around do not matter; an empty or blank value is no name.
    """
    rows = _name_values(df.where(F.col(name).isNotNull()), name).withColumnRenamed(name, "value")
    kinds = _named_statistics(rows, *key, "value", "v").withColumn("kind", F.expr(rules_sql(rules, "name")))
    return kinds.where("kind = 'junk' or v = ''").select(*key, "value")
