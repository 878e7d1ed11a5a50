"""Text column functions used by the cleaning step. All are built-in Spark
expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shipledger.constants import NULL_TOKENS


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters Python's str.strip() treats as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip_ws(c: str | Column) -> Column:
    """Remove leading and trailing white space of any kind (plain ``trim``
    removes only the ASCII space). A character-set trim, no regex; it looks every
    character up, so a value whose ends are printable ASCII is left as it is. The ends
    are compared as bytes: cutting characters out counts all of them first."""
    v = col_(c)
    last = F.substring(v.cast("binary"), -1, 1)
    plain = (v >= "!") & (v < "\x7f") & (last >= F.lit(b"!")) & (last <= F.lit(b"~"))
    return F.when(plain, v).otherwise(F.trim(v, F.lit(WHITESPACE)))


def title_case(c: str | Column) -> Column:
    """Word-initial capitals where a word restarts after any non-letter
    (``next-day am 2nd`` -> ``Next-Day Am 2Nd``). ``initcap`` restarts only
    after spaces, so a space is appended after every non-letter, ``initcap``
    applied, and exactly those appended spaces removed again (each non-letter
    is immediately followed by its own). No lambda, so whole-stage codegen
    keeps the projection compiled. One word of letters a-z needs no such help."""
    low = F.lower(col_(c))
    spaced = F.regexp_replace(low, r"([^\p{L}])", "$1 ")
    return F.when(low.rlike(r"^[a-z]*\z"), F.concat(F.upper(F.substring(low, 1, 1)), F.substr(low, F.lit(2)))).otherwise(
        F.regexp_replace(F.initcap(spaced), r"([^\p{L}]) ", "$1"))


def carrier_key(c: str | Column) -> Column:
    """Lookup key for carrier spellings: lower case, letters a-z only."""
    low = F.replace(F.lower(F.coalesce(col_(c), F.lit(""))), F.lit(" "), F.lit(""))
    return F.when(low.rlike(r"^[a-z]*\z"), low).otherwise(F.regexp_replace(low, "[^a-z]", ""))


def null_tokens(c: str | Column, tokens: list[str] | None = None) -> Column:
    """Read the usual missing-value spellings as null. A value longer than all of
    them is not looked up."""
    toks = NULL_TOKENS if tokens is None else tokens
    v = col_(c)
    longest = max((len(t.encode()) for t in toks), default=0)
    return F.when((F.octet_length(v) <= longest) & v.isin(toks), F.lit(None).cast("string")).otherwise(v)


def lookup(mapping: dict, key: Column, value_type: str | None = None) -> Column:
    """Look a key up in a small constant dict, null when absent. The dict
    becomes a map literal, so no join is planned at all."""
    if not mapping:
        return F.lit(None)
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v) if value_type is None else F.lit(v).cast(value_type)]
    return F.element_at(F.create_map(*pairs), key) if key is not None else F.lit(None)
