"""Readers of dirty values as Column expressions. They run in the JVM, without Python workers.

An id or a number may be padded, quoted, grouped by commas or dots, in exponent form, in full-width
digits, with a currency or with a zero fraction. A text without a digit has no value (null).
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"
PLAIN = "^[0-9]{1,18}$"
WHOLE = "^[0-9]{1,18}(?:[.]0{1,2})?$"
EXPONENT = "([0-9]+)(?:[.,]([0-9]+))?[eE]([+-]?[0-9]{1,2})(?![0-9])"
RUN = "[0-9](?:[0-9]|[.,'\\u00a0\\u202f ](?=[0-9]))*"
FRACTION = "[.,][0-9]{1,2}$"
MOST = (1 << 63) - 1


def _digits(c: Column) -> Column:
    """The digits of the whole number in a text, without leading zeros; null if there is no digit."""
    text = F.translate(c, WIDE_DIGITS, DIGITS)
    whole, part = F.regexp_extract(text, EXPONENT, 1), F.regexp_extract(text, EXPONENT, 2)
    places = F.length(whole) + F.regexp_extract(text, EXPONENT, 3).try_cast("int")
    shifted = F.when(places > 0, F.substring(F.rpad(F.concat(whole, part), places, "0"), F.lit(1), places)).otherwise("0")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, RUN, 0), FRACTION, ""), "[^0-9]", "")
    found = F.when(text.rlike(EXPONENT), shifted).otherwise(plain)
    return F.when(text.rlike("[0-9]"), F.regexp_replace(found, "^0+(?=[0-9])", ""))


def item_key(c: Column) -> Column:
    """An item id as plain decimal text without leading zeros, of any length. Signs mean nothing."""
    return F.when(c.rlike(PLAIN), c.cast("bigint").cast("string")).otherwise(_digits(c))


def amount(c: Column) -> Column:
    """A price as whole bigint. What is beyond 64 bits becomes the largest (smallest) bigint; a fraction of
    one or two digits is cut off."""
    size = F.coalesce(_digits(c).try_cast("bigint"), F.when(c.rlike("[0-9０-９]"), F.lit(MOST)))
    signed = F.when(c.rlike("[-\\u2212][^0-9A-Za-z]*[0-9０-９]") & ~c.rlike("[eE]-[0-9]"), -size).otherwise(size)
    return F.when(c.rlike(WHOLE), F.substring_index(c, ".", 1).try_cast("bigint")).otherwise(signed)


def valid_location(c: Column) -> Column:
    """The location if it is 0 or more, else null."""
    return F.when(c >= 0, c)


def token(c: Column) -> Column:
    """An event type in one spelling: small letters, each run of other characters one underscore."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), "[^0-9a-z]+", "_"), "^_+|_+$", "")
    return F.when(c.rlike("^[a-z0-9]+(?:_[a-z0-9]+)*$"), c).otherwise(F.when(plain != "", plain))


def action(c: Column) -> Column:
    """A log action in letters only, small."""
    return F.regexp_replace(F.lower(c), "[^a-z]+", "")


def number_order(c: Column) -> list[Column]:
    """Sort keys that order plain decimal texts as numbers."""
    return [F.length(c), c]
