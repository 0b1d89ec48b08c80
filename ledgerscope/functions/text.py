"""Text expressions. Each function takes and returns a ``Column`` and stays inside codegen."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerscope import schema as S

# Spelling of an acceptance state -> canonical state, in order of precedence.
STATE_SPELLINGS = {
    "aceptada": "Aceptada",
    "aceptado": "Aceptada",
    "accepted": "Aceptada",
    "observada": "Observada",
    "observado": "Observada",
    "aceptada con observaciones": "Observada",
    "rechazada": "Rechazada",
    "rechazado": "Rechazada",
    "rejected": "Rechazada",
    "anulada": "Rechazada",
    "pendiente": "Pendiente / Borrador",
    "borrador": "Pendiente / Borrador",
    "pendiente / borrador": "Pendiente / Borrador",
    "en proceso": "Pendiente / Borrador",
    "por enviar": "Pendiente / Borrador",
}

KEY_DIGITS = 11


def normalize_key(value: Column) -> Column:
    """Tax id as 11 digits: separators dropped, short ids padded, longer ones null."""
    digits = F.regexp_replace(value.cast("string"), "[^0-9]", "")
    # No match gives an empty array and so null; a condition on the length would clean the text twice.
    fitting = F.regexp_extract_all(digits, F.lit(f"^[0-9]{{1,{KEY_DIGITS}}}$"), F.lit(0))
    return F.lpad(F.get(fitting, F.lit(0)), KEY_DIGITS, "0")


def is_valid_key(value: Column) -> Column:
    """Exactly 11 digits as written; null counts as invalid."""
    return F.coalesce(F.trim(value.cast("string")).rlike(f"^[0-9]{{{KEY_DIGITS}}}$"), F.lit(False))


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


@functools.cache
def accent_table() -> tuple[str, str]:
    """Accented Latin letters and their plain lower-case letter, derived from Unicode."""
    accented, plain = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        letter = chr(code)
        base = unicodedata.normalize("NFKD", letter).encode("ascii", "ignore").decode().lower()
        if len(base) == 1:
            accented.append(letter)
            plain.append(base)
    return "".join(accented), "".join(plain)


def ascii_text(value: Column) -> Column:
    """Lower case without accents; every other run of symbols becomes one space."""
    folded = F.lower(F.translate(value, *accent_table()))
    ascii_only = F.regexp_replace(folded, r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(ascii_only, "[^a-z0-9]+", " "))


def plain_ascii(text: object) -> str:
    """``ascii_text`` for a single header name on the driver."""
    folded = unicodedata.normalize("NFKD", str(text)).encode("ascii", "ignore").decode().lower()
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in folded).split())


def upper_name(value: Column) -> Column:
    """Header-like name: upper case, Spanish accents folded, other symbols to ``_``."""
    folded = F.translate(F.upper(F.trim(value)), "ÁÉÍÓÚÑ", "AEIOUN")
    return F.regexp_replace(F.regexp_replace(folded, "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def clean_upper(value: Column) -> Column:
    """Blanks collapsed, trimmed and upper-cased; null becomes an empty string."""
    return F.upper(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")))


def join_address(*parts: Column) -> Column:
    """Address parts in one line; empty parts and lone dashes are left out."""
    kept = [F.when(F.trim(part) != "-", F.trim(part)) for part in parts]
    return F.trim(F.regexp_replace(F.concat_ws(" ", *kept), r"\s+", " "))


def normalize_state(value: Column, spellings: dict[str, str] | None = None) -> Column:
    """Canonical acceptance state: whole-text match first, then a spelling contained in the text."""
    table = {plain_ascii(k): v for k, v in (spellings or STATE_SPELLINGS).items()}

    def lookup(text: Column) -> Column:
        chain = F.when(text.isNull(), F.lit(S.PENDING))
        for spelling, state in table.items():
            chain = chain.when(text == spelling, F.lit(state))
        for spelling, state in table.items():
            chain = chain.when(F.contains(text, F.lit(spelling)), F.lit(state))
        return chain

    # The lambda argument is computed once; written out, every branch would clean the text again.
    found = F.get(F.transform(F.array(ascii_text(value)), lookup), F.lit(0))
    return F.coalesce(found, F.trim(value))


def parse_amount(value: Column) -> Column:
    """Money text to double. A comma followed by one or two final digits is the decimal mark."""
    kept = F.regexp_replace(value, r"[^0-9,.\-]", "")
    comma_decimal = F.translate(F.replace(kept, F.lit("."), F.lit("")), ",", ".")
    point_decimal = F.replace(kept, F.lit(","), F.lit(""))
    return F.when(kept.rlike(r",[0-9]{1,2}$"), comma_decimal).otherwise(point_decimal).try_cast("double")


def best_name(*names: Column) -> Column:
    """First name that is not blank; empty string when none is known."""
    return F.coalesce(*[blank_to_null(n) for n in names], F.lit(""))


def mask(value: Column, replacement: str = "***") -> Column:
    """Hide a non-empty value behind a constant; empty and null stay as they are."""
    return F.when(value != "", F.lit(replacement)).otherwise(value)


def ellipsize(value: Column, length: int = 28) -> Column:
    return F.when(F.length(value) > length, F.concat(F.left(value, F.lit(length - 1)), F.lit("…"))).otherwise(value)


def month_label(value: Column) -> Column:
    """Short Spanish month and two-digit year, e.g. ``Set 97``."""
    names = F.array(*[F.lit(m) for m in S.MONTH_NAMES])
    year = F.lpad((F.year(value) % 100).cast("string"), 2, "0")
    return F.concat(F.element_at(names, F.month(value)), F.lit(" "), year)
