"""Text to terms: the same rules as Column expressions and, for one short query, in Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a query.
STOP_WORDS = ("a", "an", "and", "api", "apis", "best", "compare", "find", "for", "i", "me", "need", "of", "please", "service", "services", "the", "to", "with")
_TOKEN = r"[a-z0-9]+(?:[._+\-][a-z0-9]+)*|\p{IsHan}+"
_PY_TOKEN = regex.compile(_TOKEN.replace("IsHan", "Han"))
HAN = r"\p{IsHan}"


def nfkc(text: Column, form: str = "NFKC") -> Column:
    """Unicode normalization; only texts that are not ASCII leave the JVM."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    wide = F.coalesce(text.rlike(r"[^\x00-\x7F]"), F.lit(False))
    return F.when(wide, run(F.when(wide, text))).otherwise(text)


def words(text: Column) -> Column:
    """Tokens of a text in compatible form and lower case: runs of letters and digits joined by . _ + -, and runs of Han; & reads "and"; null has none."""
    low = F.replace(F.lower(nfkc(F.coalesce(text, F.lit("")))), F.lit("&"), F.lit(" and "))
    return F.regexp_extract_all(low, F.lit(_TOKEN), F.lit(0))


def normalize_text(text: Column) -> Column:
    return F.array_join(words(text), " ")


def stem(token: Column) -> Column:
    n = F.length(token)
    return (
        F.when(token == "apis", "api")
        .when((n > 4) & token.endswith("ies"), F.concat(F.substring(token, F.lit(1), n - 3), F.lit("y")))
        .when((n > 3) & token.endswith("s") & ~token.endswith("ss"), F.substring(token, F.lit(1), n - 1))
        .otherwise(token)
    )


def terms(tokens: Column) -> Column:
    """Tokens to index terms: stems without stop words; a run of Han gives itself and, if longer than two, its pairs."""
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])

    def of(t: Column) -> Column:
        n = F.length(t)
        pairs = F.when(n > 2, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.substring(t, k, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.when(t.rlike("^" + HAN), F.concat(F.array(t), pairs)).otherwise(F.filter(F.array(stem(t)), lambda s: ~F.array_contains(stops, s)))

    return F.flatten(F.transform(tokens, of))


def tokenize(text: Column) -> Column:
    return terms(words(text))


def canonical_phrase(text: Column) -> Column:
    """A name without the word "api", its tokens run together."""
    return F.array_join(F.regexp_extract_all(F.regexp_replace(normalize_text(text), r"\bapis?\b", " "), F.lit(_TOKEN), F.lit(0)), "")


# ---- the same for one string on the driver ---------------------------------------------


def words_of(text: str | None) -> list[str]:
    low = unicodedata.normalize("NFKC", text or "").lower().replace("&", " and ")
    return _PY_TOKEN.findall(low)


def has_han(text: str) -> bool:
    return bool(regex.search(r"\p{Han}", text))


def stem_of(t: str) -> str:
    if t == "apis":
        return "api"
    if len(t) > 4 and t.endswith("ies"):
        return t[:-3] + "y"
    return t[:-1] if len(t) > 3 and t.endswith("s") and not t.endswith("ss") else t


def terms_of(text: str | None) -> list[str]:
    out: list[str] = []
    for t in words_of(text):
        if has_han(t[0]):
            out += [t] + ([t[k : k + 2] for k in range(len(t) - 1)] if len(t) > 2 else [])
        elif (s := stem_of(t)) not in STOP_WORDS:
            out.append(s)
    return out


def phrase_of(text: str | None) -> str:
    return "".join(_PY_TOKEN.findall(regex.sub(r"\bapis?\b", " ", " ".join(words_of(text)))))
