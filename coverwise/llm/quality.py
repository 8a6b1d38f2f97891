"""Quality rules combined by weak supervision.

Each rule looks at a few counts of a document and votes good (+1), bad (-1) or
abstains (0). No rule decides alone: an expectation-maximisation fit over all
documents estimates, per rule, how often it votes each way on good and on bad
documents, and the posterior probability of "good" given all votes replaces the
usual all-rules-must-pass filter.

Everything per document is built-in column functions. The fit needs only the
number of documents per vote pattern (at most 3 ** number of rules rows, whatever
the corpus), which Spark aggregates; the EM arithmetic on that table runs on the
driver, and its result is a handful of log-odds that go back as literals.

Counts (words are ``[^\\x20\\x09-\\x0D]+``): n_words, word_chars (code points in
words), n_symbols (characters of ``[#*$%&|<>]``), n_dup_lines (lines with a word
that equal an earlier line), n_repeat_words (words inside 8-word windows found
twice or more, first included).

Defined results: null and empty text have all counts 0 and base_failed; ids may be
null or repeated, each row is judged on its own text; an empty table gives no
rows; only the named columns are read, so clashing extra columns do no harm. Very
long texts stay one row (all per-text work is O(n log n)).
"""
from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = "#*$%&|<>"


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts per document; the text is not carried along."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, _SPACE, "")) > 0)
    t = t.select("doc_id", "t", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "").alias("w"), lines.alias("lines"))
    at = F.when(F.size("w") >= WINDOW, F.sequence(F.lit(0), F.size("w") - WINDOW)).otherwise(F.array().cast("array<int>"))
    t = t.withColumn("h", F.transform(at, lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(WINDOW)])))
    # most texts repeat no window: only the others are sorted
    t = t.withColumn("h", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.col("h")).otherwise(F.array().cast("array<bigint>")))
    t = t.withColumn("p", F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    same = lambda x, k: F.coalesce(F.get("p", k)["h"] == x["h"], F.lit(False))
    again = F.filter("p", lambda x, j: same(x, j - 1) | same(x, j + 1))
    t = t.withColumn("starts", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(F.transform("starts", lambda x, j: F.when(j == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get("starts", j - 1)))),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    chars = F.length("t")
    return t.select(
        "doc_id", F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", _SPACE, "")).cast("long").alias("word_chars"),
        (chars - F.length(F.translate("t", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (chars - F.length(F.regexp_replace("t", r"\p{L}+", ""))).cast("long").alias("n_letters"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        (chars - F.length(F.translate("t", ".!?;:,", ""))).cast("long").alias("n_marks"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Name -> vote, over the columns of :func:`counts`. Most rules only know one kind of junk; "length", "symbols" and
    "prose" can speak for a text too. A ratio of an empty text abstains."""
    n = F.col("n_words")
    per = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    never = F.lit(False)
    mean = per("word_chars", "n_words")
    symbols, dup = per("n_symbols", "n_words"), per("n_dup_lines", "n_lines")
    repeat, letters = per("n_repeat_words", "n_words"), per("n_letters", "word_chars")
    distinct, marks = per("n_distinct", "n_words"), per("n_marks", "n_words")
    return {
        "length": _vote(n < MIN_WORDS, n >= 100),
        "word_length": _vote((mean < 2) | (mean > 15), never),
        "symbols": _vote(symbols > 0.1, (n >= MIN_WORDS) & (symbols <= 0.02)),
        "dup_lines": _vote(dup > 0.3, never),
        "repeats": _vote(repeat > 0.25, never),
        "letters": _vote(letters < 0.7, never),
        "vocabulary": _vote((n >= 50) & (distinct < 0.1), never),
        "prose": _vote((n >= 50) & (marks < 0.005), (symbols <= 0.02) & (letters >= 0.85) & marks.between(0.01, 0.5)),
    }


@dataclass
class VoteModel:
    """P(good) and, per rule, P(vote | bad) and P(vote | good) for the votes -1, 0, 1."""
    names: list[str]
    prior: float = 0.8
    bad: list[list[float]] = field(default_factory=list)
    good: list[list[float]] = field(default_factory=list)

    def accuracy(self) -> dict[str, float]:
        """Of a rule's votes that don't abstain, the share that is right."""
        out = {}
        for r, name in enumerate(self.names):
            right = self.prior * self.good[r][2] + (1 - self.prior) * self.bad[r][0]
            cast = self.prior * (1 - self.good[r][1]) + (1 - self.prior) * (1 - self.bad[r][1])
            out[name] = right / cast if cast else 0.5
        return out

    def log_odds(self) -> list[list[float]]:
        return [[math.log(g / b) for g, b in zip(gs, bs)] for gs, bs in zip(self.good, self.bad)]

    def evidence(self, accused: bool) -> list[list[float]]:
        """Log-odds of each vote in a text with (``accused``) or without a bad vote. Abstentions may back a bad vote, but where
        no rule votes bad, no vote counts against the text: its posterior is the prior or more."""
        return [odds if accused else [0.0, max(0.0, odds[1]), max(0.0, odds[2])] for odds in self.log_odds()]


#: Pseudo-documents behind each rate: a rule is presumed right before data say otherwise.
PRIOR_GOOD, PRIOR_BAD = (0.5, 4.0, 15.5), (8.0, 8.0, 4.0)
ROUNDS = 50


def fit(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = ROUNDS) -> VoteModel:
    """EM on (votes, documents) rows. Starts from "a document with a bad vote is bad" and keeps the
    classes anchored by pseudo-counts, so good cannot swap with bad."""
    patterns = sorted(patterns)
    belief = [0.1 if -1 in v else 0.95 for v, _ in patterns]
    model = VoteModel(names)
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        model.prior = (sum(b * n for b, (_, n) in zip(belief, patterns)) + 8) / (total + 10)
        model.good, model.bad = [], []
        for r in range(len(names)):
            g, w = list(PRIOR_GOOD), list(PRIOR_BAD)
            for b, (v, n) in zip(belief, patterns):
                g[v[r] + 1] += b * n
                w[v[r] + 1] += (1 - b) * n
            model.good.append([x / sum(g) for x in g])
            model.bad.append([x / sum(w) for x in w])
        odds, start = {k: model.evidence(k) for k in (False, True)}, math.log(model.prior / (1 - model.prior))
        new = [1 / (1 + math.exp(-max(-60.0, min(60.0, start + sum(odds[-1 in v][r][x + 1] for r, x in enumerate(v)))))) for v, _ in patterns]
        done = max((abs(a - b) for a, b in zip(new, belief)), default=0) < 1e-6
        belief = new
        if done:
            break
    return model


def posterior(model: VoteModel, votes: list[Column]) -> Column:
    def total(accused: bool) -> Column:
        out = F.lit(math.log(model.prior / (1 - model.prior)))
        for v, (bad, zero, good) in zip(votes, model.evidence(accused)):
            out = out + F.when(v == -1, bad).when(v == 1, good).otherwise(zero)
        return out

    return 1 / (1 + F.exp(-F.when(F.least(*votes) < 0, total(True)).otherwise(total(False))))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Counts, base verdict, votes, p_good and kept for every row of ``docs``."""
    votes = rules()
    names = list(votes)
    table = save(counts(docs, id_col, text_col).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        *[v.cast("int").alias("vote_" + k) for k, v in votes.items()]), "quality-counts")
    cols = ["vote_" + k for k in names]
    patterns = [(tuple(r[c] for c in cols), r["n"]) for r in
                table.groupBy(*cols).agg(F.count("*").alias("n")).collect()]  # at most 3 ** len(names) rows
    model = fit(patterns, names) if patterns else fit([], names)
    p = posterior(model, [F.col(c) for c in cols])
    return (table.withColumn("p_good", F.round(p, 6))
            .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)))
