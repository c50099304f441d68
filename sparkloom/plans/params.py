"""Requests: ordered (key, value) pairs, as of a URL, and what they ask for."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from urllib.parse import parse_qsl

from .. import model
from ..operators.predicates import OPS
from ..settings import SETTINGS

#: Facets of few values, which anonymous users see whole.
SMALL_FACETS = ("schema", "schemata", "dataset", "collection_id", "countries", "languages")
_TRUE, _FALSE = ("1", "true", "yes", "t", "on"), ("0", "false", "no", "f", "off")


@dataclass
class Params:
    args: list[tuple[str, str]]
    auth: model.Auth | None = None
    need_auth: bool = False
    default_limit: int = field(default_factory=lambda: SETTINGS.query_limit)
    max_limit: int = field(default_factory=lambda: SETTINGS.max_page)

    def __post_init__(self) -> None:
        self.args = [(k, "" if v is None else str(v)) for k, v in (self.args.items() if isinstance(self.args, dict) else self.args)]
        if self.need_auth and self.auth is None:
            raise RuntimeError("a request with authorisation needs to know who asks")
        for gone in ("highlight_text", "highlight_length"):
            if self.get(gone) is not None:
                raise RuntimeError(f"{gone} isn't supported any more")

    # getters
    def getlist(self, name: str) -> list[str]:
        return [v for k, v in self.args if k == name and v != ""]

    def get(self, name: str, default: str | None = None) -> str | None:
        return next(iter(self.getlist(name)), default)

    def getint(self, name: str, default: int | None = None) -> int | None:
        try:
            return int(self.get(name, ""))
        except ValueError:
            return default

    def getintlist(self, name: str) -> list[int]:
        out = []
        for v in self.getlist(name):
            try:
                out.append(int(v))
            except ValueError:
                continue
        return out

    def getbool(self, name: str, default: bool = False) -> bool:
        v = self.get(name, "").strip().lower()
        return True if v in _TRUE else False if v in _FALSE else default

    def prefixed(self, prefix: str) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for k, v in self.args:
            if k.startswith(prefix) and len(k) > len(prefix):
                values = out.setdefault(k[len(prefix) :], [])
                if v not in values:
                    values.append(v)
        return out

    # text
    @property
    def q(self) -> str:
        return " ".join(self.get("q", "").replace("\x00", " ").split())

    @property
    def prefix(self) -> str:
        return self.get("prefix", "").strip().lower()

    @property
    def is_empty(self) -> bool:
        return not self.q and not self.prefix

    @property
    def synonyms(self) -> bool:
        return self.getbool("synonyms")

    # pages
    @property
    def offset(self) -> int:
        return min(max(0, self.getint("offset", 0)), self.max_limit)

    @property
    def limit(self) -> int:
        asked = self.getint("limit", self.default_limit)
        return max(0, min(asked, self.max_limit, self.max_limit - self.offset))

    @property
    def next_limit(self) -> int:
        return self.getint("next_limit", self.limit)

    @property
    def page(self) -> int:
        return 1 if not self.limit else self.offset // self.limit + 1

    @property
    def sorts(self) -> list[tuple[str, str]]:
        out = []
        for s in self.getlist("sort"):
            name, _, way = s.partition(":")
            if (way or "asc") in ("asc", "desc"):
                out.append((name, way or "asc"))
        return out

    # filters
    @property
    def filters(self) -> dict[str, list[str]]:
        return {k: v for k, v in self.prefixed("filter:").items() if k.split(":")[0] not in OPS}

    @property
    def ranges(self) -> dict[str, dict[str, str]]:
        """Of each field its bounds; of several values for one bound the first."""
        out: dict[str, dict[str, str]] = {}
        for op in OPS:
            for f, values in self.prefixed(f"filter:{op}:").items():
                out.setdefault(f, {})[op] = values[0]
        return out

    @property
    def excludes(self) -> dict[str, list[str]]:
        return self.prefixed("exclude:")

    @property
    def empties(self) -> list[str]:
        return sorted(self.prefixed("empty:"))

    @property
    def datasets(self) -> set[str]:
        asked = {model.valid_dataset(v) for f in ("dataset", "datasets") for v in self.filters.get(f, [])}
        if self.auth is not None and not self.auth.is_admin:
            asked = asked & self.auth.datasets if asked else set(self.auth.datasets)
        return asked

    @property
    def collection_ids(self) -> set[int]:
        asked = {int(v) for f in ("collection_id", "collection") for v in self.filters.get(f, []) if v.isdigit()}
        if self.auth is not None and not self.auth.is_admin:
            asked = asked & self.auth.collection_ids if asked else set(self.auth.collection_ids)
        return asked

    # facets
    @property
    def facets(self) -> list[str]:
        return list(dict.fromkeys(self.getlist("facet")))

    @property
    def _anonymous(self) -> bool:
        return self.auth is not None and not self.auth.logged_in and not self.auth.is_admin

    def _size(self, kind: str, f: str) -> int:
        size = self.getint(f"{kind}_size:{f}") or SETTINGS.facet_size
        return min(size, SETTINGS.anonymous_facet_size) if self._anonymous and f not in SMALL_FACETS else size

    def _total(self, kind: str, f: str) -> bool:
        return not (self._anonymous and f not in SMALL_FACETS) and self.getbool(f"{kind}_total:{f}")

    def facet_size(self, f: str) -> int:
        return self._size("facet", f)

    def facet_total(self, f: str) -> bool:
        return self._total("facet", f)

    def facet_values(self, f: str) -> bool:
        return self.getbool(f"facet_values:{f}", True)

    def facet_type(self, f: str) -> str | None:
        return self.get(f"facet_type:{f}")

    def facet_interval(self, f: str) -> str | None:
        v = self.get(f"facet_interval:{f}")
        return v if v in ("year", "quarter", "month", "week", "day", "hour", "minute") else None

    @property
    def significant(self) -> list[str]:
        return list(dict.fromkeys(self.getlist("facet_significant")))

    def significant_size(self, f: str) -> int:
        return self._size("facet_significant", f)

    def significant_total(self, f: str) -> bool:
        return self._total("facet_significant", f)

    def significant_type(self, f: str) -> str | None:
        return self.get(f"facet_significant_type:{f}")

    def significant_values(self, f: str) -> bool:
        return self.getbool(f"facet_significant_values:{f}", True)

    @property
    def significant_text(self) -> str | None:
        asked = [v for k, v in self.args if k == "facet_significant_text"]
        return (asked[0] or "content") if asked else None

    @property
    def significant_text_size(self) -> int:
        return self.getint("facet_significant_text_size") or 5

    @property
    def significant_text_min_doc_count(self) -> int:
        return self.getint("facet_significant_text_min_doc_count") or 5

    @property
    def metrics(self) -> dict[str, list[str]]:
        return {k: v for k, v in self.prefixed("metric:").items() if k in ("sum", "avg", "min", "max")}

    # what comes back
    @property
    def highlight(self) -> bool:
        return self.getbool("highlight")

    @property
    def highlight_count(self) -> int:
        return self.getint("highlight_count") or SETTINGS.highlight_fragments

    @property
    def dehydrate(self) -> bool:
        return self.getbool("dehydrate")

    @property
    def include_fields(self) -> list[str]:
        return list(dict.fromkeys(self.getlist("include_fields")))

    @property
    def similar(self) -> dict[str, object]:
        """Limits of more-like-this; 0 stands for the default."""
        asked = {n: self.getint(f"mlt_{n}") or getattr(SETTINGS, f"mlt_{n}") for n in ("min_doc_freq", "min_term_freq", "min_word_length", "max_doc_freq")}
        asked["max_terms"] = self.getint("mlt_max_query_terms") or SETTINGS.mlt_max_query_terms
        asked["minimum"] = self.get("mlt_minimum_should_match") or SETTINGS.mlt_minimum_should_match
        return asked

    def to_dict(self) -> dict[str, object]:
        return {"q": self.q, "prefix": self.prefix, "offset": self.offset, "limit": self.limit, "filters": self.filters, "ranges": self.ranges,
                "excludes": self.excludes, "empties": self.empties, "sorts": self.sorts, "facets": self.facets}


def from_url(q: str = "", args: str | Iterable[tuple[str, str]] = "", auth: model.Auth | None = None) -> Params:
    """Parameters of a URL's query, with the query text first."""
    pairs = parse_qsl(args, keep_blank_values=True) if isinstance(args, str) else list(args)
    if q and any(k == "q" for k, _ in pairs):
        raise RuntimeError("q is given twice")
    return Params([("q", q), *pairs] if q else pairs, auth)
