"""Text analysis as column expressions, with SQL twins for the same rules.

Everything stays in the JVM: stripping markup, folding accents, tokens, positions.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZWJ = "‍"
_W = r"\p{L}\p{N}\p{M}_"
#: Runs of word characters, with full stops and apostrophes inside; ideographs one by one.
WORD = rf"\p{{IsHan}}|[{_W}{ZWJ}&&[^\p{{IsHan}}]]+(?:[.'’][{_W}{ZWJ}&&[^\p{{IsHan}}]]+)*"
#: The same for engines without class intersection, on text without ideographs or markers.
WORD_SQL = rf"[{_W}]+(?:[.'’][{_W}]+)*"
_SPECIAL = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "ħ": "h", "ı": "i", "ŋ": "n", "ŧ": "t"}


def _fold_table() -> tuple[str, str]:
    src, dst = [], []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1:
            src.append(c)
            dst.append(base)
    for c, to in _SPECIAL.items():
        if len(to) == 1:
            src.append(c)
            dst.append(to)
    return "".join(src), "".join(dst)


_SRC, _DST = _fold_table()


def fold(text: Column) -> Column:
    """Lower case, without accents."""
    out = F.translate(F.regexp_replace(F.lower(text), r"\p{M}+", ""), _SRC, _DST)
    for c, to in _SPECIAL.items():
        if len(to) > 1:
            out = F.replace(out, F.lit(c), F.lit(to))
    return out


def fold_text(text: str) -> str:
    """The same for one text on the driver."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.category(c).startswith("M"))
    return "".join(_SPECIAL.get(c, c) for c in plain)


def strip_html(text: Column) -> Column:
    """Markup becomes blanks; scripts, styles and comments go with what they hold."""
    out = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^<>]*>", " ")
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(c))
    return out


def strip_html_text(text: str) -> str:
    out = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^<>]*>", " ", text)
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        out = out.replace(f"&{name};", c)
    return out


#: What each searchable field does to its text before tokens are taken.
ANALYZERS = {"content": "folded", "text": "folded", "translation": "folded", "name": "lower"}


def words(text: Column, analyzer: str = "folded") -> Column:
    """Tokens in order. ``folded`` strips markup and accents, ``lower`` only lowers."""
    if analyzer == "folded":
        bare = F.when(text.rlike("[<&]"), strip_html(text)).otherwise(text)
        ready = F.when(bare.rlike(r"[^\x00-\x7F]"), fold(bare)).otherwise(F.lower(bare))
    else:
        ready = F.lower(text)
    #: Most texts need neither markers nor ideographs, and have a simpler pattern.
    plain = F.regexp_extract_all(ready, F.lit(WORD_SQL), F.lit(0))
    return F.when(text.rlike(rf"[\p{{IsHan}}{ZWJ}]"), F.regexp_extract_all(ready, F.lit(WORD), F.lit(0))).otherwise(plain)


def tokens(text: Column, analyzer: str = "folded") -> Column:
    """array<struct<term, pos>>. Markers joined to a word by U+200D share its position."""
    spread = F.transform(
        words(text, analyzer),
        lambda w, i: F.transform(F.filter(F.split(w, ZWJ), lambda t: t != ""), lambda t: F.struct(t.alias("term"), i.alias("pos"))),
    )
    return F.flatten(spread)


def exploded(df: DataFrame, text: Column, analyzer: str, *more: str | Column) -> DataFrame:
    """(more..., pos, term): a row for each token, by generators that run in compiled
    code rather than by functions over arrays."""
    each = df.select(*more, F.posexplode(words(text, analyzer)).alias("pos", "word__"))
    kept = [c for c in each.columns if c != "word__"]
    return each.select(*kept, F.explode(F.split("word__", ZWJ)).alias("term")).where("term <> ''")


#: Marks that stand by themselves, as in decomposed accents, belong to a word too; ``\w`` hasn't them.
_MARKS = "".join(c for c in map(chr, range(0x300, 0x1F000)) if unicodedata.category(c).startswith("M"))
_PY_WORD = re.compile(rf"[一-鿿㐀-䶿]|[\w{_MARKS}{ZWJ}]+(?:[.'’][\w{_MARKS}{ZWJ}]+)*")


def words_of(text: str, analyzer: str = "folded") -> list[str]:
    """Tokens of one text on the driver (for query texts and hits)."""
    ready = fold_text(strip_html_text(text)) if analyzer == "folded" else text.lower()
    return [t for w in _PY_WORD.findall(ready) for t in w.split(ZWJ) if t]


def spans_of(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, tokens) of each word of one text, for highlighting."""
    out = []
    for m in _PY_WORD.finditer(text):
        out.append((m.start(), m.end(), [fold_text(t) for t in m[0].split(ZWJ) if t]))
    return out


def analyze_text(text: str, field: str = "content", tokens_only: bool = True) -> list:
    """What a field makes of a text: its tokens, or (token, position) pairs."""
    if field in ("names", "name_keyword"):
        from .names import normalize_name

        return [normalize_name(text)] if tokens_only else [(normalize_name(text), 0)]
    kind = ANALYZERS.get(field, "lower")
    if tokens_only:
        return words_of(text, kind)
    ready = fold_text(strip_html_text(text)) if kind == "folded" else text.lower()
    return [(t, i) for i, w in enumerate(_PY_WORD.findall(ready)) for t in w.split(ZWJ) if t]


def words_sql(column: str) -> str:
    """SQL for ``words(column, 'folded')`` of text without markup."""
    folded = f"replace(replace(replace(strip_accents(lower({column})), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe')"
    pattern = WORD_SQL.replace("'", "''")
    return f"regexp_extract_all({folded}, '{pattern}')"
