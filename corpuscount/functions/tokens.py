"""Token columns. A token is a run of ASCII letters and digits; everything else, any non-ASCII byte included, separates.

Tokens are found first and lowered afterwards: lowering the text before would turn some other letters into ASCII ones.
The expressions are meant to be exploded where they stand: a named token array that a later select explodes is
evaluated several times.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9]+"


def tokens(text: Column | str) -> Column:
    """All tokens of a text, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def latin1(content: Column | str) -> Column:
    """Raw bytes as text with one character for each byte, so that no byte is lost or joined."""
    return F.decode(content, "ISO-8859-1")


def bigrams(text: Column | str) -> Column:
    """Pairs of adjacent lower-case tokens, joined by a blank; none for fewer than two tokens.

    The token array is bound once, as the variable of a lambda over an array of one.
    """
    none = F.array().cast("array<string>")
    pairs = lambda t: F.when(F.size(t) > 1, F.zip_with(F.slice(t, 1, F.size(t) - 1), F.slice(t, 2, F.size(t) - 1), lambda a, b: F.lower(F.concat_ws(" ", a, b)))).otherwise(none)
    return F.flatten(F.transform(F.array(tokens(text)), pairs))


def crc(key: Column | str) -> Column:
    """CRC-32 of a key's bytes."""
    return F.crc32(F.col(key).cast("binary") if isinstance(key, str) else key.cast("binary"))


def reducer(key: Column | str, reducers: int) -> Column:
    return (crc(key) % reducers).cast("int")


#: Byte sequences of UTF-8, one character for each byte.
_UTF8 = r"[\x00-\x7F]++|[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}"


def decoded(content: Column | str) -> Column:
    """UTF-8 without the bytes that aren't: what stands around them is joined. Only invalid content is looked at byte by byte."""
    c = F.col(content) if isinstance(content, str) else content
    raw = c.cast("binary")
    mended = F.decode(F.encode(F.regexp_replace(latin1(raw), f"({_UTF8})|[\\s\\S]", "$1"), "ISO-8859-1"), "UTF-8")
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(mended)
