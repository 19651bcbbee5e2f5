"""Labels and place names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def event_label(commune: Column, ts: Column) -> Column:
    return F.concat_ws("_", F.lit("fire"), F.coalesce(commune, F.lit("XX")), F.date_format(ts, "yyyyMMdd"))


def full_label(code: Column, commune: Column, country: Column, region: Column, ts: Column) -> Column:
    """The older five-part label."""
    parts = [F.coalesce(c, F.lit("XX")) for c in (code, commune, country, region)]
    return F.concat_ws("_", *parts, F.date_format(ts, "yyyyMMdd"))


def label_parts(label: Column) -> Column:
    """Third and fourth underscore part of a label."""
    return F.array_join(F.slice(F.split(label, "_"), 3, 2), " ")


# Latin letters with marks and their plain forms, position by position.
MARKED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖØòóôõöøÙÚÛÜùúûüÝýÿŠšŽž"
PLAIN = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOOooooooUUUUuuuuYyySsZz"
# Further Latin letters and their plain forms.
MARKED_MORE = "ĀāĂăĄąĆćĈĉĊċČčĎďĐđĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĨĩĪīĬĭĮįİıĴĵĶķĹĺĻļĽľŁłŃńŅņŇňŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŢţŤťŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżȘșȚț"
PLAIN_MORE = "AaAaAaCcCcCcCcDdDdEeEeEeEeEeGgGgGgGgHhIiIiIiIiIiJjKkLlLlLlLlNnNnNnOoOoOoRrRrRrSsSsSsTtTtUuUuUuUuUuUuWwYyYZzZzSsTt"
# Greek letters and their Latin forms.
GREEK = "ΑΒΓΔΕΖΗΙΚΛΜΝΞΟΠΡΣΤΥΦΩαβγδεζηικλμνξοπρσςτυφωΆΈΉΊΌΎΏάέήίόύώΪΫϊϋΐΰ"
GREEK_PLAIN = "AVGDEZIIKLMNXOPRSTYFOavgdeziiklmnxoprsstyfoAEIIOYOaeiioyoIYiyiy"
# Letters that become two.
DOUBLED = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "Θ": "Th", "θ": "th", "Χ": "Ch", "χ": "ch", "Ψ": "Ps", "ψ": "ps", "Þ": "Th", "þ": "th"}


def to_ascii(text: Column) -> Column:
    """Latin and Greek letters without marks; other scripts stay as they are."""
    out = F.translate(text, MARKED + MARKED_MORE + GREEK, PLAIN + PLAIN_MORE + GREEK_PLAIN)
    for letter, pair in DOUBLED.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return out


def clean_name(name_en: Column, name: Column) -> Column:
    """English name, else local name, else 'unknown'; plain letters, no blanks."""
    return F.regexp_replace(to_ascii(F.coalesce(name_en, name, F.lit("unknown"))), " ", "")


def is_true_word(text: Column) -> Column:
    # Words read as true.
    return text.isin("true", "TRUE", "True", "1", "t", "y", "yes", "yeah", "yup", "certainly", "uh-huh")


def has_tag(name: Column, tag: str = "_FR_") -> Column:
    return F.coalesce(F.contains(name, F.lit(tag)), F.lit(False))
