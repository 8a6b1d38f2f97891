"""Column functions for text: tokenisers, n-grams, overlap, sentence split.

Everything here returns a ``Column`` built from Spark built-ins (regex,
higher-order array functions), so it runs inside whole-stage code generation
with no Python worker.

Two tokenisers are used, as in the reference:

* retrieval tokens: lower-cased runs of two or more word characters
  (letters, digits, underscore), stop words removed;
* grading tokens: lower-cased ASCII runs ``[a-z0-9]+`` of any length, no stop
  list (keyword overlap, sentence scoring, groundedness).
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Apache Spark ML's default English stop-word list
# (StopWordsRemover.loadDefaultStopWords("english")), in its published order.
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by",
    "for", "with", "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where", "why",
    "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will",
    "just", "don", "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll",
    "i'd", "you'd", "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's",
    "it's", "we're", "they're", "i've", "we've", "you've", "they've", "isn't", "aren't",
    "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't",
    "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't", "cannot",
    "could", "here's", "how's", "let's", "ought", "that's", "there's", "what's", "when's",
    "where's", "who's", "why's", "would",
]

RETRIEVAL_TOKEN = r"[\p{L}\p{N}_]{2,}"
GRADING_TOKEN = "[a-z0-9]+"
# Sentence boundary: whitespace that follows '.', '!' or '?'
SENTENCE_SPLIT = r"(?<=[.!?])\s+"


def effective_stop_words(stop_words: list[str] | None = None) -> list[str]:
    """Stop words that can ever equal a retrieval token (others never match)."""
    import re
    words = ENGLISH_STOP_WORDS if stop_words is None else stop_words
    return [w for w in dict.fromkeys(words) if re.fullmatch(r"\w{2,}", w)]


def retrieval_tokens(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case word tokens of length >= 2, stop words removed, in text order."""
    toks = F.regexp_extract_all(F.lower(text), F.lit(RETRIEVAL_TOKEN), 0)
    stops = effective_stop_words(stop_words)
    if not stops:
        return toks
    # a literal IN list becomes a hashed INSET (one lookup per token), where
    # array_contains over a literal array would scan every stop word
    return F.filter(toks, lambda t: ~t.isin(stops))


def with_bigrams(tokens: Column) -> Column:
    """Unigrams followed by the bigrams of adjacent surviving tokens ("a b")."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    bigrams = F.zip_with(F.slice(tokens, 1, n), F.slice(tokens, 2, n),
                         lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(tokens, bigrams)


def term_codes(tokens: Column) -> Column:
    """xxhash64 of every token (see :func:`code_bigrams` for the pairs)."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def code_bigrams(codes: Column) -> Column:
    """``with_bigrams`` over codes: a bigram's code is that of its two tokens' codes."""
    n = F.greatest(F.size(codes) - 1, F.lit(0))
    return F.concat(codes, F.zip_with(F.slice(codes, 1, n), F.slice(codes, 2, n), lambda a, b: F.xxhash64(a, b)))


def term_code(term: Column) -> Column:
    """The code of a term given as text."""
    left, right = F.substring_index(term, " ", 1), F.substring_index(term, " ", -1)
    return F.when(F.contains(term, F.lit(" ")), F.xxhash64(F.xxhash64(left), F.xxhash64(right))).otherwise(F.xxhash64(term))


def retrieval_terms(text: Column, stop_words: list[str] | None = None) -> Column:
    return with_bigrams(retrieval_tokens(text, stop_words))


def grading_terms(text: Column) -> Column:
    """Distinct ASCII word set used by overlap and grading."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(GRADING_TOKEN), 0))


def keyword_overlap(question: Column, doc_text: Column) -> Column:
    """|distinct(q) & distinct(doc)| / |distinct(q)|, 0 when the question has no words."""
    q = grading_terms(question)
    d = grading_terms(doc_text)
    n = F.size(q)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, d)) / n)


def py_strip(c: Column) -> Column:
    """Strip leading/trailing ASCII whitespace (like Python's ``str.strip``)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Newlines to spaces, then split after sentence marks followed by whitespace."""
    return F.split(F.regexp_replace(text, "\n", " "), SENTENCE_SPLIT)
