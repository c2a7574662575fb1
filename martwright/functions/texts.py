"""Text cleaning."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks a place where a capital may follow although no space stands there.
_MARK = "\ue000 "


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def initcap_words(text: Column | str) -> Column:
    """Capitalise every run of letters and digits, as SQL databases do.

    Spark's own ``initcap`` starts a word after a space only. A mark ending in a
    space is put behind every other separator and taken out again, which keeps the
    expression inside generated code.
    """
    marked = F.regexp_replace(_col(text), r"([^\p{L}\p{N} ])", "$1" + _MARK)
    return F.replace(F.initcap(marked), F.lit(_MARK), F.lit(""))


def clean_label(text: Column | str) -> Column:
    """Underscores to spaces, then capitalised words."""
    return initcap_words(F.replace(_col(text), F.lit("_"), F.lit(" ")))


# Spellings of characters that stand for more than one letter or sign.
MULTI_CHAR_ASCII = {
    "ß": "ss",
    "æ": "ae",
    "Æ": "AE",
    "œ": "oe",
    "Œ": "OE",
    "þ": "th",
    "Þ": "Th",
    "€": "EUR",
    "…": "...",
    "—": "--",
    "«": "<<",
    "»": ">>",
    "©": "(c)",
    "®": "(r)",
    "°": "deg",
    "¢": "C/",
    "£": "PS",
    "¤": "$?",
    "¥": "Y=",
    "§": "SS",
    "\u00ad": "",
    "¼": "1/4",
    "½": "1/2",
    "¾": "3/4",
    "±": "+-",
    "™": "(tm)",
    "‰": "%0",
    "„": ",,",
    "″": "''",
    "ﬁ": "fi",
    "ﬂ": "fl",
    "ĳ": "ij",
    "Ĳ": "IJ",
}

# Single signs and letters without a Unicode decomposition.
SINGLE_CHAR_ASCII = {
    "ø": "o",
    "Ø": "O",
    "đ": "d",
    "Đ": "D",
    "ð": "d",
    "Ð": "D",
    "ł": "l",
    "Ł": "L",
    "ı": "i",
    "‘": "'",
    "’": "'",
    "“": '"',
    "”": '"',
    "–": "-",
    "‚": ",",
    "‹": "<",
    "›": ">",
    "•": "*",
    "·": "*",
    "−": "-",
    "‐": "-",
    "‑": "-",
    "‒": "-",
    "―": "-",
    "′": "'",
    "¡": "!",
    "¦": "|",
    "¨": '"',
    "ª": "a",
    "¬": "!",
    "¯": "-",
    "²": "2",
    "³": "3",
    "´": "'",
    "µ": "u",
    "¶": "P",
    "¸": ",",
    "¹": "1",
    "º": "o",
    "¿": "?",
    "×": "x",
    "÷": "/",
    "\u00a0": " ",
    "\u2009": " ",
    "\u202f": " ",
}


def _single_char_map() -> dict[str, str]:
    """Latin letters with marks mapped to their base letter by Unicode decomposition."""
    table = dict(SINGLE_CHAR_ASCII)
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            table.setdefault(chr(code), base)
    return table


def ascii_clean_columns(df: DataFrame) -> DataFrame:
    """:func:`ascii_clean` on every text column of a table."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(
        *[ascii_clean(F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns]
    )


def ascii_clean(text: Column | str) -> Column:
    """Transliterate to ASCII, then keep code points 32 to 126 only. NULL stays NULL.

    A text of such code points alone is taken as it is.
    """
    text = out = _col(text)
    for source, target in MULTI_CHAR_ASCII.items():
        out = F.replace(out, F.lit(source), F.lit(target))
    singles = _single_char_map()
    out = F.translate(out, "".join(singles), "".join(singles.values()))
    cleaned = F.regexp_replace(out, r"[^\x20-\x7E]", "")
    return F.when(text.rlike(r"[^\x20-\x7E]"), cleaned).otherwise(text)
