"""Names: normal form, keys, parts, phonetic forms; and which names are worth looking for."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import SETTINGS
from .text import fold, fold_text

_CYRILLIC = dict(zip("абвгдезийклмнопрстуфыэ", "abvgdeziyklmnoprstufye")) | {
    "ё": "e", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ь": "", "ю": "yu", "я": "ya", "і": "i", "ї": "i", "є": "e", "ґ": "g",
}
_GREEK = dict(zip("αβγδεζηικλμνξοπρστυφω", "abgdeziiklmnxoprstyfo")) | {"θ": "th", "χ": "ch", "ψ": "ps", "ς": "s"}
LATIN = _CYRILLIC | _GREEK
PERSON_PREFIXES = ("mr", "mrs", "ms", "miss", "dr", "prof", "sir", "lady", "lord", "hon", "herr", "frau", "don", "dona", "mme", "m")
#: Legal forms, each with the short form it is compared by.
ORG_FORMS = {
    "limited": "ltd", "incorporated": "inc", "corporation": "corp", "company": "co", "aktiengesellschaft": "ag",
    "gesellschaft mit beschrankter haftung": "gmbh", "societe anonyme": "sa", "limited liability company": "llc",
    "public limited company": "plc", "obshchestvo s ogranichennoy otvetstvennostyu": "ooo",
}
LEGAL = ("LegalEntity", "Person", "Organization", "Company", "PublicBody")


def name_normal(name: Column) -> Column:
    """Letters and digits only, single blanks, lower case, no accents."""
    return F.trim(F.regexp_replace(fold(name), r"[^\p{L}\p{N}]+", " "))


def normalize_name(name: str) -> str:
    return " ".join(re.sub(r"[\W_]+", " ", fold_text(name)).split())


def ascii_name(name: Column) -> Column:
    """Normal form with Cyrillic and Greek letters in Latin script."""
    single = {k: v for k, v in LATIN.items() if len(v) == 1}
    normal = name_normal(name)
    out = normal
    for k, v in LATIN.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    gone = "".join(k for k, v in LATIN.items() if not v)
    latin = F.translate(out, "".join(single) + gone, "".join(single.values()))
    return F.when(normal.rlike(r"[^\x00-\x7F]"), latin).otherwise(normal)


def ascii_text(name: str) -> str:
    return "".join(LATIN.get(c, c) for c in normalize_name(name))


def without_forms(schema: Column, ascii_: Column) -> Column:
    """Long legal forms shortened for organisations, titles taken off for persons."""
    org = F.concat(F.lit(" "), ascii_, F.lit(" "))
    for long, short in sorted(ORG_FORMS.items(), key=lambda kv: -len(kv[0])):
        org = F.replace(org, F.lit(f" {long} "), F.lit(f" {short} "))
    person = F.regexp_replace(ascii_, rf"^(?:(?:{'|'.join(PERSON_PREFIXES)}) )+(?=.)", "")
    return F.when(schema == "Person", person).when(schema.isin(*LEGAL), F.trim(org)).otherwise(ascii_)


def name_tokens(schema: Column, name: Column) -> Column:
    return F.filter(F.split(without_forms(schema, ascii_name(name)), " "), lambda t: t != "")


def token_lists(schema: Column, names: Column) -> Column:
    """Of each name its tokens; what keys, parts and phonetic forms are made from."""
    return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: name_tokens(schema, n))


def _all(lists: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(lists)))


def name_keys(tokens: Column) -> Column:
    """Of each name its tokens, sorted and joined, if longer than five characters."""
    keys = F.transform(tokens, lambda ts: F.array_join(F.array_sort(ts), ""))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: F.length(k) > 5)))


def name_parts(schema: Column, names: Column, tokens: Column) -> Column:
    """Tokens of at least two characters, in the name's script and in Latin; legal entities only."""
    own = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.split(name_normal(n), " "))
    parts = F.filter(_all(F.concat(own, tokens)), lambda t: F.length(t) >= 2)
    return F.when(schema.isin(*LEGAL), parts).otherwise(F.array().cast("array<string>"))


def metaphone(word: str) -> str:
    """How an English word sounds (after L. Philips, 1990)."""
    w = re.sub(r"[^A-Z]", "", word.upper())
    if not w:
        return ""
    for start, to in (("KN", "N"), ("GN", "N"), ("PN", "N"), ("AE", "E"), ("WR", "R"), ("WH", "W")):
        if w.startswith(start):
            w = to + w[2:]
            break
    if w[0] == "X":
        w = "S" + w[1:]
    out, n = [], len(w)
    at = lambda i: w[i] if 0 <= i < n else ""
    i = 0
    while i < n:
        c, before, after = w[i], at(i - 1), at(i + 1)
        if c == before and c != "C":
            i += 1
            continue
        if c in "AEIOU":
            if i == 0:
                out.append(c)
        elif c == "B":
            if not (before == "M" and i == n - 1):
                out.append("B")
        elif c == "C":
            if after == "I" and at(i + 2) == "A" or after == "H":
                out.append("K" if after == "H" and before == "S" else "X")
                i += after == "H"
            elif after and after in "IEY":
                if before != "S":
                    out.append("S")
            else:
                out.append("K")
        elif c == "D":
            if after == "G" and at(i + 2) and at(i + 2) in "EIY":
                out.append("J")
                i += 1
            else:
                out.append("T")
        elif c == "G":
            if after == "H":
                if i == 0 or at(i + 2) and at(i + 2) in "AEIOU":
                    out.append("K")
                    i += 1
            elif after == "N" and (i + 2 >= n or w[i + 1 :] == "NED"):
                pass
            elif after and after in "EIY" and before != "G":
                out.append("J")
            else:
                out.append("K")
        elif c == "H":
            if (not after or after in "AEIOU") and not (before and before in "CSPTG") and after:
                out.append("H")
        elif c == "K":
            if before != "C":
                out.append("K")
        elif c == "P":
            out.append("F" if after == "H" else "P")
            i += after == "H"
        elif c == "Q":
            out.append("K")
        elif c == "S":
            if after == "H" or after == "I" and at(i + 2) and at(i + 2) in "OA":
                out.append("X")
                i += after == "H"
            else:
                out.append("S")
        elif c == "T":
            if after == "I" and at(i + 2) and at(i + 2) in "OA":
                out.append("X")
            elif after == "H":
                out.append("0")
                i += 1
            elif not (after == "C" and at(i + 2) == "H"):
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            if after and after in "AEIOU":
                out.append(c)
        elif c == "X":
            out += ["K", "S"]
        elif c == "Z":
            out.append("S")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def phonetic_tokens(tokens: Column) -> Column:
    """Phonetic forms of more than two letters of tokens of three letters or more.
    Metaphone has no built-in, so this is an Arrow-batched UDF."""

    @F.pandas_udf("array<string>")
    def sound(col: pd.Series) -> pd.Series:
        memory: dict[str, str] = {}

        def of(token: str) -> str:
            if token not in memory:
                memory[token] = metaphone(token) if len(token) > 2 and token.isascii() and token.isalpha() else ""
            return memory[token]

        return col.map(lambda ts: sorted({s for s in map(of, ts if ts is not None else ()) if len(s) > 2}))

    return sound(tokens)


def name_phonetic(schema: Column, tokens: Column) -> Column:
    return phonetic_tokens(F.when(schema.isin(*LEGAL), _all(tokens)).otherwise(F.array().cast("array<string>")))


def name_ngrams(text: str, least: int = 2, most: int = 4) -> list[str]:
    """Name keys of all runs of two to four words of a query text, with legal forms
    as names have them."""
    joined = f" {ascii_text(text)} "
    for long, short in sorted(ORG_FORMS.items(), key=lambda kv: -len(kv[0])):
        joined = joined.replace(f" {long} ", f" {short} ")
    w = joined.split()
    out = {"".join(sorted(w[i : i + k])) for k in range(least, most + 1) for i in range(len(w) - k + 1)}
    return sorted(k for k in out if len(k) >= 6)


def clean_names(names: list[str], single_length: int | None = None, strict: bool = True) -> list[str]:
    """Names that are worth looking for in texts. Strict: of several words with one
    of three letters or more; of one word only a long one, if there is no name of
    several words. Otherwise all that aren't blank, once each."""
    least = SETTINGS.single_token_length if single_length is None else single_length
    seen: dict[str, str] = {}
    for n in names:
        n = " ".join(unicodedata.normalize("NFC", n).split())
        if n:
            seen.setdefault(n.lower(), n)
    kept = list(seen.values())
    if not strict:
        return kept
    several = [n for n in kept if len(n.split()) > 1 and any(len(t) >= 3 for t in n.split())]
    return several or [n for n in kept if len(n.split()) == 1 and len(n) >= least]


def clean_names_column(names: Column, single_length: int | None = None) -> Column:
    """``clean_names`` (strict) of a column of name arrays."""
    least = SETTINGS.single_token_length if single_length is None else single_length
    squashed = F.filter(F.transform(names, lambda n: F.trim(F.regexp_replace(n, r"\s+", " "))), lambda n: n != "")
    kept = F.array_distinct(squashed)
    several = F.filter(kept, lambda n: (F.size(F.split(n, " ")) > 1) & F.exists(F.split(n, " "), lambda t: F.length(t) >= 3))
    single = F.filter(kept, lambda n: (F.size(F.split(n, " ")) == 1) & (F.length(n) >= least))
    return F.when(F.size(several) > 0, several).otherwise(single)


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def pick_names(names: list[str], limit: int | None = None) -> list[str]:
    """Up to ``limit`` names that stand for all: the one nearest to all others,
    then each time the one farthest from those picked."""
    limit = SETTINGS.match_names if limit is None else limit
    left = sorted(dict.fromkeys(names))
    if len(left) <= limit:
        return left
    picked = [min(left, key=lambda a: (sum(edit_distance(a, b) for b in left), a))]
    while len(picked) < limit:
        rest = [n for n in left if n not in picked]
        picked.append(max(rest, key=lambda a: (sum(edit_distance(a, b) for b in picked), a)))
    return picked
