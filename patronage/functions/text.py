"""Text expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Product categories in order of precedence, with the words that select them.
CATEGORY_KEYWORDS = {
    "Home & Living": ("CANDLE", "HOLDER", "FRAME", "CLOCK", "CUSHION", "LAMP", "MIRROR"),
    "Kitchen & Dining": ("MUG", "CUP", "PLATE", "BOWL", "TEA", "KITCHEN", "CUTLERY"),
    "Bags & Accessories": ("BAG", "PURSE", "WALLET", "UMBRELLA"),
    "Stationery": ("CARD", "NOTEBOOK", "PENCIL", "PEN ", "PAPER", "STICKER"),
    "Seasonal & Gifts": ("CHRISTMAS", "HEART", "GIFT", "BIRTHDAY", "EASTER", "DECORATION"),
    "Kids & Toys": ("TOY", "DOLL", "CHILD", "BABY", "GAME"),
}
OTHER_CATEGORY = "Other"

# Unicode white space, as text editors and other parsers strip it.
BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
          "\u2028\u2029\u202f\u205f\u3000")

# Cell texts that stand for a missing value.
NULL_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
              "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Texts read as true.
TRUE_TEXTS = ("1", "true", "yes", "y")


def header_name(name: str) -> str:
    """``'  Signup Date '`` becomes ``'signup_date'``."""
    return re.sub(r"\s+", "_", name.strip().lower())


def stripped(text: Column) -> Column:
    """Without white space at either end; ``trim`` alone takes off blanks only.

    Most cells begin and end with a printed ASCII character and are left as they are.
    """
    text = text.cast("string")

    def printed(end: Column) -> Column:
        return F.ascii(end).between(ord("!"), ord("~"))

    return F.when(printed(text) & printed(F.substring(text, -1, 1)), text).otherwise(F.btrim(text, F.lit(BLANKS)))


def known_text(text: Column) -> Column:
    """Null for a cell that stands for a missing value."""
    return F.when(~text.isin(*NULL_TEXTS), text)


def title_case(text: Column) -> Column:
    """Capitalise every run of letters: ``o'brien mary-jane`` becomes ``O'Brien Mary-Jane``.

    ``initcap`` starts a word only after a space, which would give ``O'brien``; it does
    for texts of ASCII letters and spaces.
    """
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    whole = F.array_join(
        F.transform(runs, lambda run: F.concat(F.upper(F.left(run, F.lit(1))),
                                               F.lower(F.substr(run, F.lit(2))))), "")
    return F.when(text.rlike("^[A-Za-z ]*$"), F.initcap(text)).otherwise(whole)


def tidy_title(text: Column) -> Column:
    return title_case(stripped(text))


def tidy_gender(text: Column) -> Column:
    title = tidy_title(text)
    return F.when(title == "M", "Male").when(title == "F", "Female").otherwise(title)


def truth(text: Column) -> Column:
    """Boolean from text; anything unknown, null included, is false."""
    return F.coalesce(F.lower(stripped(text)).isin(*TRUE_TEXTS), F.lit(False))


def keyword_category(description: Column) -> Column:
    """First category one of whose words occurs anywhere in the text, else ``Other``."""
    def choose(upper: Column) -> Column:
        choice = F.when(F.lit(False), OTHER_CATEGORY)
        for category, words in CATEGORY_KEYWORDS.items():
            hit = upper.contains(words[0])
            for word in words[1:]:
                hit = hit | upper.contains(word)
            choice = choice.when(hit, category)
        return choice.otherwise(OTHER_CATEGORY)

    # as the only element of an array the upper-case text is made once, not once per word
    return F.element_at(F.transform(F.array(F.upper(description)), choose), 1)


def customer_label(customer_id: Column) -> Column:
    return F.format_string("Customer %d", customer_id)
