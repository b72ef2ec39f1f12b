"""Lexical features of a text as columns: one row in, twelve numbers out, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The words that make a question.
QUESTION_WORDS = ("what", "when", "where", "who", "whom", "whose", "why", "how", "which", "can", "could", "do", "does", "is", "am", "are", "should", "would", "will")
#: Fixed value: signs and beginnings of words that speak of money.
MONEY = r"[$£€¥]|\bdollar|\beuro|\bpound|\bgbp|\busd|\beur"

LEXICAL = ("n_chars", "n_tokens", "avg_word_len", "n_digits", "n_punct", "n_uppercase", "has_question_mark", "has_money_symbol", "has_number", "starts_with_qword", "qword_count", "type_token_ratio")
#: The names of the entity counts.
ENTITIES = ("ner_count", "ner_money", "ner_date", "ner_gpe", "ner_org")


def tokens(text: Column) -> Column:
    """The parts between Unicode white space, none empty."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def bare(token: Column) -> Column:
    """A token in lower case, without ASCII punctuation at its ends."""
    return F.lower(F.regexp_replace(token, r"^\p{Punct}+|\p{Punct}+$", ""))


def lexical_columns(text: Column) -> dict[str, Column]:
    """The twelve lexical features; null counts as an empty text, for which the lengths are 1 and the rest 0."""
    s = F.coalesce(text.cast("string"), F.lit(""))
    parts = tokens(s)
    return _features(s, parts, F.transform(parts, bare))


def _features(s: Column, parts: Column, plain: Column) -> dict[str, Column]:
    count = F.greatest(F.size(parts), F.lit(1))
    long = lambda c: c.cast("long")
    return {
        "n_chars": long(F.greatest(F.length(s), F.lit(1))),
        "n_tokens": long(count),
        "avg_word_len": F.length(F.regexp_replace(s, r"(?U)\s", "")) / count,
        "n_digits": long(F.regexp_count(s, F.lit(r"\p{Nd}"))),
        "n_punct": long(F.regexp_count(s, F.lit(r"\p{Punct}"))),
        "n_uppercase": long(F.regexp_count(s, F.lit(r"\p{Lu}"))),
        "has_question_mark": long(F.contains(s, F.lit("?"))),
        "has_money_symbol": long(F.lower(s).rlike(MONEY)),
        "has_number": long(s.rlike(r"\p{Nd}")),
        "starts_with_qword": long(F.coalesce(F.get(plain, F.lit(0)).isin(*QUESTION_WORDS), F.lit(False))),
        "qword_count": long(F.size(F.filter(plain, lambda x: x.isin(*QUESTION_WORDS)))),
        "type_token_ratio": F.size(F.array_distinct(plain)) / count,
    }


def with_lexical(df: DataFrame, text: str, *kept: str) -> DataFrame:
    """The kept columns and the twelve features of a text: its parts and bare tokens are made once, as columns that the features read."""
    s, parts, plain = (f"_{x}_of_text" for x in ("s", "parts", "plain"))
    keep = [F.col(f"`{c}`") for c in kept]
    staged = df.select(*keep, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(s))
    staged = staged.select("*", tokens(F.col(s)).alias(parts))
    staged = staged.select("*", F.transform(parts, bare).alias(plain))
    return staged.select(*keep, *[c.alias(n) for n, c in _features(F.col(s), F.col(parts), F.col(plain)).items()])


def entity_columns(text: Column, rules: bool = False) -> dict[str, Column]:
    """Entity counts. Without a recognizer they are 0; ``rules`` counts amounts of money and dates by pattern, which is not the same as a model's entities."""
    s = F.coalesce(text.cast("string"), F.lit(""))
    zero = F.lit(0).cast("long")
    if not rules:
        return dict.fromkeys(ENTITIES, zero)
    money = F.regexp_count(s, F.lit(r"(?i)[$£€¥]\s?\d[\d.,]*|\d[\d.,]*\s?(?:eur|usd|gbp|dollars|euros|pounds)\b")).cast("long")
    date = F.regexp_count(s, F.lit(r"(?i)\b\d{1,2} (?:january|february|march|april|may|june|july|august|september|october|november|december)\b|\b\d{4}-\d{2}-\d{2}\b")).cast("long")
    return {"ner_count": money + date, "ner_money": money, "ner_date": date, "ner_gpe": zero, "ner_org": zero}


def description(column: str, known: dict[str, str] | None = None) -> str:
    """A feature in words: the known text, for term weights their term, otherwise the name."""
    kind, _, term = column.partition("_")
    told = {"tfidf": f"how much '{term}' stands out in the text"}
    return (known or {}).get(column) or told.get(kind if term else "", column)
