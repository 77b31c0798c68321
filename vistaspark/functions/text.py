"""Text functions (T1, T2, T4, T10, T11, T16): Column -> Column, JVM-side only."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of


def fold_word(w: str) -> str:
    """T1 of one plain string: NFKD, non-ASCII dropped, upper, strip."""
    return _ascii_part(w).upper().strip()


def _ascii_part(text: str) -> str:
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")


def _fold_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Every non-ASCII code point whose NFKD form keeps ASCII characters, by rule: those that keep
    one character (as ``translate`` strings) and those that keep several (as pairs)."""
    src, dst, several = [], [], []
    for ch in map(chr, range(0x80, sys.maxunicode + 1)):
        kept = _ascii_part(ch) if unicodedata.decomposition(ch) else ""
        if len(kept) == 1:
            src.append(ch)
            dst.append(kept)
        elif kept:
            several.append((ch, kept))
    return "".join(src), "".join(dst), several


def _class_of(chars: Iterable[str], gap: int = 16) -> str:
    """A regex class that holds ``chars``; near neighbours are joined, so it may hold a few more."""
    ranges: list[list[int]] = []
    for cp in map(ord, chars):
        if ranges and cp - ranges[-1][1] <= gap:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return "[" + "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in ranges) + "]"


_FOLD_FROM, _FOLD_TO, _FOLD_SEVERAL = _fold_tables()
_SEVERAL_PAIRS = "\n".join(ch + kept for ch, kept in _FOLD_SEVERAL)
_SEVERAL_CLASS = _class_of(ch for ch, _ in _FOLD_SEVERAL)

# Keywords that mark an ocular exam, and the exam-profile rules in priority
# order (first match wins; anything else is "Otros estudios").
OCULAR_KEYWORDS = ("OJO", "OCULAR", "OFTALMO", "OPTICO", "OPTICA", "RETINA", "MACULA", "OCT", "FONDO", "GLAUCOMA",
                   "TONOMETRIA", "CAMPIMETRIA", "CORNEA", "PAQUIMETRIA", "TOPOGRAFIA", "ANGIOGRAFIA", "CATARATA",
                   "CRISTALINO", "REFRACCION", "AGUDEZA", "BIOMETRIA")
EXAM_PROFILE_RULES = (
    ("Retina y macula", ("RETINA", "MACULA", "OCT", "FONDO", "ANGIOGRAFIA")),
    ("Glaucoma", ("GLAUCOMA", "TONOMETRIA", "CAMPIMETRIA", "PRESION")),
    ("Cornea", ("CORNEA", "PAQUIMETRIA", "TOPOGRAFIA")),
    ("Catarata", ("CATARATA", "CRISTALINO", "BIOMETRIA")),
    ("Vision y refraccion", ("REFRACCION", "AGUDEZA", "OPTICA")),
)
EXAM_PROFILE_DEFAULT = "Otros estudios"



def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(col_of(c), r"^\s+|\s+$", "")


def fold(c) -> Column:
    """NFKD fold -> drop non-ASCII -> upper -> strip; null -> ''."""
    x = F.coalesce(col_of(c).cast("string"), F.lit(""))
    mapped = F.translate(x, _FOLD_FROM, _FOLD_TO)
    ascii_only = F.regexp_replace(mapped, r"[^\x00-\x7F]", "")
    # characters that decompose to several (ligatures, fractions, "...") are rare: only a text that
    # lost characters to the ASCII filter and holds one goes through their replacement
    pairs = F.split(F.lit(_SEVERAL_PAIRS), "\n")  # one literal: a character, then what it becomes
    spelled = F.aggregate(pairs, mapped, lambda text, pair: F.replace(
        text, F.substring(pair, 1, 1), F.substr(pair, F.lit(2))))
    x = F.when((F.length(ascii_only) < F.length(mapped)) & mapped.rlike(_SEVERAL_CLASS),
               F.regexp_replace(spelled, r"[^\x00-\x7F]", "")).otherwise(ascii_only)
    return strip_ws(F.upper(x))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Literal substring test (never a regex) for any of ``words``; False on no words."""
    cond = F.lit(False)
    for w in words:
        cond = cond | text.contains(w)
    return cond


def classify(c, rules: Sequence[tuple[str, Sequence[str]]] = EXAM_PROFILE_RULES, default: str = EXAM_PROFILE_DEFAULT,
             folded: bool = False) -> Column:
    """First rule whose keyword occurs in the folded text wins (priority = list order)."""
    text = col_of(c) if folded else fold(c)
    out = None
    for label, words in rules:
        hit = contains_any(text, [w.upper() for w in words])
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


BP_PATTERN = r"(\d{2,3})\s*/\s*(\d{2,3})"


def parse_bp(c) -> Column:
    """T4: first "120/80" anywhere in the text -> struct(sistolica int, diastolica int)."""
    s = col_of(c).cast("string")
    sys_ = F.regexp_extract(s, BP_PATTERN, 1)
    dia = F.regexp_extract(s, BP_PATTERN, 2)
    return F.struct(
        F.when(sys_ != "", sys_.cast("int")).alias("sistolica"),
        F.when(dia != "", dia.cast("int")).alias("diastolica"),
    )


def full_name(*parts) -> Column:
    """Null-safe "surname1 surname2 name" (nulls skipped, ends trimmed)."""
    return F.trim(F.concat_ws(" ", *[col_of(p) for p in parts]))


def clip_label(c, max_len: int = 36, fallback: str = "Sin dato") -> Column:
    """Strip, fall back on blank, cut to ``max_len`` chars ending in '...'."""
    raw = col_of(c).cast("string")
    text = F.when(raw.isNull() | (raw == ""), F.lit(fallback)).otherwise(raw)
    text = strip_ws(text)
    return F.when(
        F.char_length(text) > max_len, F.concat(F.substring(text, 1, max_len - 3), F.lit("..."))
    ).otherwise(text)


def factor_list(factors: Sequence[tuple[str, Column]], sep: str = ", ") -> Column:
    """Text listing only the factors whose condition holds (concat_ws skips nulls)."""
    return F.concat_ws(sep, *[F.when(cond, F.lit(label)) for label, cond in factors])
