"""Column functions: cleaning, imputation, time, length, price and interaction features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# What the cleaning rules remove, in the order they apply.
TAGS, URLS, OTHER_CHARS = r"<[^>]+>", r"https?://\S+", r"[^a-zA-Z0-9\s.,!?']"
#: ASCII marks that count as punctuation.
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def clean_text(text: Column) -> Column:
    """Without tags, URLs and rare characters; single spaces, lower case."""
    kept = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, TAGS, " "), URLS, " "), OTHER_CHARS, " ")
    return F.lower(F.trim(F.regexp_replace(kept, r"\s+", " ")))


def combine_text(*columns: Column) -> Column:
    """The texts, null ones empty, joined by a space and trimmed."""
    return F.trim(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns]))


def vector_text(*columns: Column) -> Column:
    """Text for vectorisers: joined, lower case first, then only a-z, 0-9 and white space."""
    return F.regexp_replace(F.lower(F.concat_ws(" ", *columns)), r"[^a-z0-9\s]", "")


def flag(value: Column) -> Column:
    """1 for true, 1 and yes in any case, else 0."""
    return F.when(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes"), 1).otherwise(0)


def number(value: Column) -> Column:
    """A number out of text; what is none becomes 0."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def clip(value: Column, low: float = 1.0, high: float = 5.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def half_steps(value: Column) -> Column:
    return F.round(value * 2) / 2


def time_parts(ts: Column) -> dict[str, Column]:
    """year, month, day, weekday (1 is Sunday), hour, weekend and holiday-season flags."""
    weekday = F.dayofweek(ts)
    return {
        "year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "weekday": weekday, "hour": F.hour(ts),
        "is_weekend": weekday.isin(1, 7).cast("int"), "is_holiday_season": F.month(ts).isin(11, 12).cast("int"),
    }


def length_features(title: Column, comment: Column) -> dict[str, Column]:
    title, comment = F.coalesce(title, F.lit("")), F.coalesce(comment, F.lit(""))
    return {
        "title_len": F.length(title), "comment_len": F.length(comment), "len_ratio": F.length(title) / (F.length(comment) + 1.0),
        "has_caps": comment.rlike("[A-Z]").cast("int"), "has_exclamation": comment.contains("!").cast("int"),
    }


def text_stats(text: Column) -> dict[str, Column]:
    """chars, words and the shares of punctuation, upper case and digits (ASCII), 0 for an empty text."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1)).cast("double")

    def share(kind: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, kind, ""))) / size  # replaces the few, not all others one by one

    inside = F.trim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(inside == "", 0).otherwise(F.size(F.split(inside, r"[ \t\n\x0B\f\r]+")))
    return {"chars": F.length(text), "words": words, "punct_ratio": share(f"{PUNCTUATION}+"), "upper_ratio": share("[A-Z]+"), "digit_ratio": share("[0-9]+")}


def price_bucket(price: Column, low: float = 20.0, high: float = 100.0) -> Column:
    """0 below ``low``, 1 up to ``high``, else (and for null) 2."""
    return F.when(price < low, 0).when(price <= high, 1).otherwise(2)


def list_features(literal: Column) -> dict[str, Column]:
    """Of a list written as text, with either kind of quotes: count, total and mean length, has flag; bad text is an empty list."""
    quoted = r"""'[^'\\]*(?:\\.[^'\\]*)*'|"[^"\\]*(?:\\.[^"\\]*)*\""""
    inside = F.transform(F.regexp_extract_all(literal, F.lit(f"({quoted})"), F.lit(1)), lambda x: F.regexp_replace(F.substr(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1"))
    strings = F.when(F.regexp_replace(literal, quoted, "").rlike(r"^\s*\[[\s,]*\]\s*$"), inside)
    items = F.coalesce(strings, F.from_json(literal, "array<string>"), F.array().cast("array<string>"))
    total = F.aggregate(items, F.lit(0), lambda a, x: a + F.length(F.coalesce(x, F.lit(""))))
    return {"n_items": F.size(items), "total_len": total, "mean_len": F.when(F.size(items) > 0, total / F.size(items)).otherwise(0.0), "has_items": (F.size(items) > 0).cast("int")}


def interactions(user_mean: Column, user_count: Column, prod_mean: Column, prod_count: Column) -> dict[str, Column]:
    return {
        "mean_diff": user_mean - prod_mean, "mean_avg": (user_mean + prod_mean) / 2, "mean_ratio": user_mean / (prod_mean + 1e-6),
        "user_weight": user_mean * user_count, "prod_weight": prod_mean * prod_count,
        "log_user_count": F.log1p(F.greatest(user_count, F.lit(0))), "log_prod_count": F.log1p(F.greatest(prod_count, F.lit(0))),
    }


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Float columns at ``digits`` decimals, without negative zeros."""
    floats = [c for c, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in floats})


def safe_columns(df: DataFrame, leaking: Sequence[str]) -> DataFrame:
    """All columns but those on the deny-list."""
    return df.select(*[c for c in df.columns if c not in set(leaking)])


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns that both tables have, in the order of the first."""
    return [c for c in left.columns if c in set(right.columns)]
