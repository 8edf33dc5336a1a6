"""Scalar string functions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of list items, tried in this order.
ITEM_PREFIXES = (
    r"^\s*\d+\.\s*",
    r"^\s*\d+\)\s*",
    r"^\s*[a-zA-Z]\.\s*",
    r"^\s*[a-zA-Z]\)\s*",
    r"^\s*[ivxlc]+\.\s*",
    r"^\s*[IVXLC]+\.\s*",
    r"^\s*[•·◦▪▫‣⁃]\s*",
    r"^\s*[-+]\s*",
    r"^\s*\*(?!\*)\s*",
    r"^\s*[→⟶]\s*",
)
# Powers of 1024 by unit.
UNITS = {"B": 0, "KB": 1, "MB": 2, "GB": 3, "TB": 4}


def safe_filename(text: Column) -> Column:
    """Runs of characters other than letters, digits, dot, underscore and dash become one underscore; none at the ends."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), "_+", "_"), F.lit("_"))


def wrapped(text: Column, width: int = 50, mark: str = "<br>") -> Column:
    """Words filled greedily into lines of at most ``width`` characters, joined by ``mark``; longer words stand alone."""
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

    def add(acc: Column, word: Column) -> Column:
        fits = (F.length(acc["line"]) == 0) | (F.length(acc["line"]) + 1 + F.length(word) <= width)
        longer = F.when(F.length(acc["line"]) == 0, word).otherwise(F.concat(acc["line"], F.lit(" "), word))
        ended = F.when(F.length(acc["done"]) == 0, acc["line"]).otherwise(F.concat(acc["done"], F.lit(mark), acc["line"]))
        return F.when(fits, F.struct(acc["done"].alias("done"), longer.alias("line"))).otherwise(F.struct(ended.alias("done"), word.alias("line")))

    end = lambda acc: F.when(F.length(acc["done"]) == 0, acc["line"]).otherwise(F.concat(acc["done"], F.lit(mark), acc["line"]))
    return F.aggregate(F.filter(F.split(text, " "), lambda w: w != ""), start, add, end)


def list_item(text: Column) -> Column:
    """A list item without its number, letter, numeral or bullet."""
    out = F.trim(text)
    for prefix in ITEM_PREFIXES:
        out = F.regexp_replace(out, prefix, "")
    return F.trim(out)


def bare(text: Column) -> Column:
    """Lower case without punctuation, for comparing labels."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", ""))


def matched_label(answer: Column, options: Column) -> Column:
    """The first option that contains the answer, both bare; any talk of outliers is Outliers; an empty answer matches nothing."""
    mine = bare(answer)
    hits = F.filter(options, lambda o: F.contains(bare(o), mine))
    return F.when(F.contains(mine, F.lit("outliers")), "Outliers").when(mine != "", F.get(hits, F.lit(0)))


def model_key(name: Column) -> Column:
    """A model's name without vendor prefix and instruct suffix, in lower case."""
    return F.lower(F.replace(F.regexp_replace(name, "^[^_]*_", ""), F.lit("-Instruct"), F.lit("")))


def model_of(answer: Column, model_a: Column, model_b: Column) -> Column:
    """Which of two models an extraction means, by name, by side or by its key; A is tried before B, then 'unknown'."""
    side = F.lower(F.trim(answer))
    for_a = (answer == model_a) | side.isin("model a", "model_a", "a") | (model_key(answer) == model_key(model_a))
    for_b = (answer == model_b) | side.isin("model b", "model_b", "b") | (model_key(answer) == model_key(model_b))
    return F.when(for_a, model_a).when(for_b, model_b).otherwise(F.lit("unknown"))


def base_id(identifier: Column, sep: str = "-") -> Column:
    return F.split_part(identifier, F.lit(sep), F.lit(1))


def unquoted(label: Column) -> Column:
    """At most one quote less at either end."""
    return F.regexp_replace(F.regexp_replace(F.trim(label), "^[\"']", ""), "[\"']$", "")


def bytes_of(size: Column) -> Column:
    """Bytes of a size such as 1.5TB, with units of 1024; null if it is none."""
    number = F.regexp_extract(F.upper(F.trim(size)), r"^([0-9.]+)\s*([KMGT]?B)$", 1).try_cast("double")
    unit = F.regexp_extract(F.upper(F.trim(size)), r"^([0-9.]+)\s*([KMGT]?B)$", 2)
    power = F.create_map(*[F.lit(x) for u, p in UNITS.items() for x in (u, float(1024**p))])
    return (number * F.try_element_at(power, unit)).cast("long")


def filled(template: Column, **values: Column) -> Column:
    """A template with its named placeholders replaced and all other braces left alone."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def sections(title: str, **fields: Column) -> Column:
    """A title and a [key] block for each field that is not null."""
    return F.concat_ws("\n\n", F.lit(title), *[F.when(v.isNotNull(), F.concat(F.lit(f"[{k}]\n"), v)) for k, v in fields.items()])


def is_outlier(label: Column) -> Column:
    return (label == "Outliers") | F.startswith(label, F.lit("Outliers - "))


def shortened(text: Column, limit: int = 2000, mark: str = "... [truncated]") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def prompt_key(prompt: Column) -> Column:
    """A prompt as a key: JSON objects and arrays with sorted keys and no spaces between, other text as it is."""
    v = F.try_parse_json(prompt)
    return F.when(F.rlike(F.ltrim(prompt), F.lit(r"^[\[{]")) & v.isNotNull(), F.to_json(v)).otherwise(prompt)
