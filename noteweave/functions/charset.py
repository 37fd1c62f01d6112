"""Character set detection and decoding of page bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteweave.functions import fixed


def detect_charset(body: Column) -> Column:
    """Character set named in the first bytes of a body.

    Latin-1 maps every byte to one character, so ASCII marks match as they are.
    """
    head = F.decode(F.substring(body, 1, fixed.CHARSET_WINDOW), "ISO-8859-1")
    result = F.lit(fixed.DEFAULT_CHARSET)
    for charset, marks in reversed(fixed.CHARSET_MARKS.items()):
        found = F.lit(False)
        for mark in marks:
            found = found | F.contains(head, F.lit(mark))
        result = F.when(found, F.lit(charset)).otherwise(result)
    return result


def decode_body(body: Column) -> Column:
    """Bytes to text in the detected character set (needs ``session.SETTINGS``)."""
    charset = detect_charset(body)
    return (
        F.when(charset == "euc-jp", F.decode(body, "EUC-JP"))
        .when(charset == "shift_jis", F.decode(body, "Shift_JIS"))
        .otherwise(F.decode(body, "UTF-8"))
    )
