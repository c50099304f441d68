"""Marked passages of the hits of one page. Only these few rows pass through Python, in Arrow batches."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..plans.query_string import Node
from ..settings import SETTINGS

_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")


def query_terms(node: Node, synonyms: dict[str, list[str]] | None = None) -> tuple[list[str], list[str]]:
    """(words, patterns) of a query that may be marked; what is excluded isn't."""
    if node.kind == "not":
        return [], []
    words, patterns = [], []
    if node.kind in ("words", "phrase", "fuzzy"):
        for t in X.words_of(node.text):
            words += [t, *(synonyms or {}).get(t, [])]
    elif node.kind == "wildcard":
        from .fulltext import _pattern

        patterns.append(_pattern(X.fold_text(node.text)))
    for p in node.parts:
        w, q = query_terms(p, synonyms)
        words, patterns = words + w, patterns + q
    return list(dict.fromkeys(words)), list(dict.fromkeys(patterns))


def marked(text: str, words: set[str], patterns: list[re.Pattern], tag: str = "em", encode: bool = True) -> tuple[str, int]:
    """The text with each matching word in a tag, and how many there are."""
    out, at, n = [], 0, 0
    plain = (lambda s: html.escape(s, quote=False)) if encode else (lambda s: s)
    for start, end, tokens in X.spans_of(text):
        if any(t in words or any(p.match(t) for p in patterns) for t in tokens):
            out += [plain(text[at:start]), f"<{tag}>", plain(text[start:end]), f"</{tag}>"]
            at, n = end, n + 1
    return "".join(out) + plain(text[at:]), n


def phrases_marked(text: str, phrases: list[list[str]], slop: int = 2, tag: str = "em") -> tuple[str, int]:
    """The text with each whole phrase in one tag."""
    spans = X.spans_of(text)
    found: list[tuple[int, int]] = []
    for words in phrases:
        at = [[i for i, (_, _, ts) in enumerate(spans) if w in ts] for w in words]
        for i in at[0] if at and all(at) else []:
            chosen = [i]
            for k, places in enumerate(at[1:], 1):
                near = [p for p in places if abs((p - k) - i) <= slop and p not in chosen]
                if not near:
                    break
                chosen.append(min(near, key=lambda p: abs((p - k) - i)))
            disp = [p - k for k, p in enumerate(chosen)]
            if len(chosen) == len(words) and max(disp) - min(disp) <= slop:
                found.append((spans[min(chosen)][0], spans[max(chosen)][1]))
    out, at, n = [], 0, 0
    for a, b in sorted(set(found)):
        if a >= at:
            out += [html.escape(text[at:a], quote=False), f"<{tag}>", html.escape(text[a:b], quote=False), f"</{tag}>"]
            at, n = b, n + 1
    return "".join(out) + html.escape(text[at:], quote=False), n


def _passages(text: str, size: int) -> list[str]:
    """Runs of whole sentences of about so many characters."""
    parts, now = [], ""
    for s in _SENTENCE.split(text):
        if now and len(now) + len(s) > size:
            parts.append(now)
            now = ""
        now = f"{now} {s}".strip()
    return [*parts, now] if now else parts


def fragments(text: str, words: set[str], patterns: list[re.Pattern], size: int, count: int, no_match: int, whole: bool = False) -> list[str]:
    """Up to ``count`` passages of whole sentences of about ``size`` characters, those
    with the most marks first and then in order; without a mark the beginning."""
    if whole:
        got, n = marked(text, words, patterns)
        return [got] if n else []
    parts = _passages(text, size)
    scored = [(marked(p, words, patterns), i) for i, p in enumerate(parts)]
    best = sorted((x for x in scored if x[0][1]), key=lambda x: (-x[0][1], x[1]))[:count]
    if best:
        return [m[0] for m, _ in sorted(best, key=lambda x: x[1])]
    return [html.escape(text[:no_match], quote=False)] if no_match and text else []


def highlight(hits: DataFrame, node: Node, count: int = SETTINGS.highlight_fragments, synonyms: dict[str, list[str]] | None = None, more: list[str] | None = None) -> DataFrame:
    """Hits with ``highlight``, a map from field to marked passages. ``content`` has
    passages of whole sentences and, without a match, its beginning; names come
    whole, other fields one passage. ``more`` are further words, of filters."""
    words, patterns = query_terms(node, synonyms)
    words = {*words, *(t for v in more or [] for t in X.words_of(v))}
    compiled = [re.compile(p) for p in patterns]
    fields = [f for f in ("content", "names", "text", "translation") if f in hits.columns]
    settings = SETTINGS

    def one(values: dict[str, list[str]]) -> dict[str, list[str]]:
        out = {}
        for f in fields:
            texts = [t for t in (values.get(f) if values.get(f) is not None else []) if t]
            if f == "content":
                text = "\n".join(texts)[: settings.highlight_most]
                got = fragments(text, words, compiled, settings.highlight_fragment, count or settings.highlight_fragments, settings.highlight_no_match)
            elif f == "names":
                got = [t for t in texts if marked(t, words, compiled)[1]][:1]
            else:
                got = [x for t in texts for x in fragments(t[: settings.highlight_most], words, compiled, 150, 1, 0)][:1]
            if got:
                out[f] = got
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["highlight"] = [one(row) for row in frame[fields].to_dict("records")]
            yield frame[["_id", "highlight"]]

    as_lists = [F.col(f) if isinstance(hits.schema[f].dataType, T.ArrayType) else F.array(f).alias(f) for f in fields]
    made = hits.select("_id", *as_lists).mapInPandas(run, "_id string, highlight map<string,array<string>>")
    return hits.join(made, "_id", "left")


def phrase_passages(hits: DataFrame, names: str, count: int = SETTINGS.highlight_fragments, slop: int = SETTINGS.percolate_slop, text: str = "content", no_match: int = 0) -> DataFrame:
    """Hits with ``highlight``, a map of ``text`` to passages in which the hit's own
    names (an array) are marked as wholes, and ``surface_forms``, the marked places as
    they are written, of the whole text. Without a mark there is the text's beginning,
    of ``no_match`` characters."""
    size = SETTINGS.highlight_fragment

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            passages, forms = [], []
            for value, own in zip(frame[text], frame["names__"]):
                value = "\n".join(v for v in ([value] if isinstance(value, str) else value if value is not None else []) if v)
                words = [w for w in (X.words_of(n) for n in (own if own is not None else [])) if w]
                whole, _ = phrases_marked(value, words, slop)
                forms.append(sorted({html.unescape(m) for m in re.findall(r"(?s)<em>(.*?)</em>", whole)}))
                parts = [x for x in (phrases_marked(p, words, slop) for p in _passages(value, size)) if x[1]]
                start = [html.escape(value[:no_match], quote=False)] if no_match and value else []
                passages.append({text: got} if (got := [p for p, _ in parts[: count or None]] or start) else {})
            yield pd.DataFrame({"_id": frame["_id"], "highlight": passages, "surface_forms": forms})

    column = F.col(text) if isinstance(hits.schema[text].dataType, T.ArrayType) else F.array(text)
    given = hits.select("_id", column.alias(text), F.col(names).alias("names__"))
    made = given.mapInPandas(run, "_id string, highlight map<string,array<string>>, surface_forms array<string>")
    return hits.join(made, "_id", "left")


def surface_forms(column: str) -> Column:
    """Distinct texts within <em> tags of an array of passages, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(column, lambda t: F.regexp_extract_all(t, F.lit("<em>(.*?)</em>"), F.lit(1))))))
