"""The ontology: classes of entities, their properties, types and groups; and who may read what."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

#: Property type -> the cross-property field that collects its values.
GROUPS = {
    "address": "addresses", "checksum": "checksums", "country": "countries", "date": "dates", "email": "emails", "entity": "entities",
    "gender": "genders", "identifier": "identifiers", "ip": "ips", "language": "languages", "mimetype": "mimetypes", "name": "names",
    "phone": "phones", "topic": "topics", "url": "urls",
}
NUMERIC_TYPES = ("number", "date")
TEXT_TYPES = ("text",)
UNINDEXED_TYPES = ("text", "html", "json")
BUCKETS = ("page", "pages", "documents", "intervals", "things")


@dataclass(frozen=True)
class Schema:
    name: str
    parents: tuple[str, ...] = ()
    properties: dict[str, str] = field(default_factory=dict)
    caption: tuple[str, ...] = ("name",)
    abstract: bool = False
    matchable: bool = False
    hidden: bool = False

    @cached_property
    def ancestors(self) -> tuple[str, ...]:
        """Itself and all classes above, nearest first."""
        out = [self.name]
        for p in self.parents:
            out += [a for a in SCHEMATA[p].ancestors if a not in out]
        return tuple(out)

    @cached_property
    def all_properties(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for a in reversed(self.ancestors):
            out |= SCHEMATA[a].properties
        return out

    @cached_property
    def captions(self) -> tuple[str, ...]:
        return self.caption

    @cached_property
    def descendants(self) -> tuple[str, ...]:
        """Itself and all classes below, in order of name."""
        return tuple(sorted(s.name for s in SCHEMATA.values() if self.name in s.ancestors))

    def is_a(self, name: str) -> bool:
        return name in self.ancestors

    @cached_property
    def matchable_schemata(self) -> tuple[str, ...]:
        """The matchable classes above and below that entities of this one are compared with."""
        return tuple(sorted(s.name for s in SCHEMATA.values() if s.matchable and (self.is_a(s.name) or s.is_a(self.name))))

    @cached_property
    def bucket(self) -> str:
        if self.name == "Page":
            return "page"
        if self.name == "Pages":
            return "pages"
        for above, bucket in (("Document", "documents"), ("Thing", "things"), ("Interval", "intervals")):
            if self.is_a(above):
                return bucket
        return "things"


_DOC = {
    "title": "name", "fileName": "name", "fileSize": "number", "mimeType": "mimetype", "contentHash": "checksum", "author": "name",
    "generator": "string", "encoding": "string", "language": "language", "date": "date", "processingStatus": "string",
    "processingError": "string", "parent": "entity", "ancestors": "entity", "bodyText": "text", "bodyHtml": "html",
    "translatedText": "text", "messageId": "identifier", "namesMentioned": "name", "peopleMentioned": "name",
    "companiesMentioned": "name", "emailMentioned": "email", "locationMentioned": "address", "processedAt": "date",
}

SCHEMATA: dict[str, Schema] = {
    s.name: s
    for s in (
        Schema("Thing", (), {
            "name": "name", "alias": "name", "previousName": "name", "weakAlias": "name", "summary": "text", "notes": "text",
            "description": "text", "country": "country", "address": "address", "addressEntity": "entity", "topics": "topic",
            "sourceUrl": "url", "publisher": "string", "wikidataId": "identifier", "keywords": "string", "modifiedAt": "date",
        }),
        Schema("Interval", (), {"startDate": "date", "endDate": "date", "date": "date", "summary": "text", "description": "text", "sourceUrl": "url"}, ()),
        Schema("Analyzable", (), {"namesMentioned": "name", "emailMentioned": "email", "language": "language"}, abstract=True),
        Schema("LegalEntity", ("Thing",), {
            "email": "email", "phone": "phone", "website": "url", "legalForm": "string", "incorporationDate": "date", "taxNumber": "identifier",
            "registrationNumber": "identifier", "idNumber": "identifier", "jurisdiction": "country", "mainCountry": "country", "sector": "string",
        }, matchable=True),
        Schema("Person", ("LegalEntity",), {
            "birthDate": "date", "deathDate": "date", "nationality": "country", "citizenship": "country", "gender": "gender", "position": "string",
            "passportNumber": "identifier", "firstName": "name", "lastName": "name", "birthPlace": "string",
        }, matchable=True),
        Schema("Organization", ("LegalEntity",), {"imoNumber": "identifier"}, matchable=True),
        Schema("Company", ("Organization",), {"amount": "number", "currency": "string", "capital": "number"}, matchable=True),
        Schema("PublicBody", ("Organization",), {}, matchable=True),
        Schema("Vessel", ("Thing",), {"imoNumber": "identifier", "flag": "country", "mmsi": "identifier", "callSign": "identifier"}, matchable=True),
        Schema("Address", ("Thing",), {"full": "address", "street": "string", "city": "string", "latitude": "number", "longitude": "number"}, ("full",), matchable=True),
        Schema("Event", ("Thing", "Interval"), {"location": "address", "involved": "entity", "value": "number", "props": "json"}),
        Schema("CallForTenders", ("Interval",), {"title": "name", "deadline": "date", "value": "number"}, ("title",)),
        Schema("Ownership", ("Interval",), {"owner": "entity", "asset": "entity", "percentage": "number"}, ()),
        Schema("Sanction", ("Interval",), {"entity": "entity", "authority": "string", "program": "string"}, ("program",)),
        Schema("Payment", ("Interval",), {"amount": "number", "currency": "string", "payer": "entity", "beneficiary": "entity", "purpose": "text", "status": "topic"}, ()),
        Schema("Identification", ("Interval",), {"holder": "entity", "number": "identifier", "country": "country"}, ("number",)),
        Schema("Document", ("Thing", "Analyzable"), _DOC, ("fileName", "title", "name")),
        Schema("PlainText", ("Document",), {}, ("fileName", "title", "name")),
        Schema("HyperText", ("Document",), {}, ("title", "fileName", "name")),
        Schema("Pages", ("Document",), {"pdfHash": "checksum"}, ("fileName", "title", "name")),
        Schema("Page", ("Analyzable",), {"document": "entity", "index": "number", "bodyText": "text", "translatedText": "text"}, (), hidden=True),
        Schema("Table", ("Document",), {"csvHash": "checksum", "rowCount": "number", "columns": "json"}, ("title", "fileName")),
        Schema("Workbook", ("Document",), {}, ("fileName", "title")),
        Schema("Folder", ("Document",), {}, ("fileName", "title")),
        Schema("Package", ("Folder",), {}, ("fileName", "title")),
        Schema("Email", ("Document",), {"subject": "name", "from": "name", "to": "name", "emitters": "entity", "recipients": "entity"}, ("subject", "fileName")),
        Schema("Note", ("Thing",), {"entity": "entity"}),
        Schema("Mention", (), {"document": "entity", "resolved": "entity", "name": "name", "contextCountry": "country"}, hidden=True),
    )
}
HIDDEN = tuple(sorted(s.name for s in SCHEMATA.values() if s.hidden))


def schema(name: str) -> Schema:
    if name not in SCHEMATA:
        raise ValueError(f"no schema {name!r}")
    return SCHEMATA[name]


def concrete(names: list[str] | tuple[str, ...], descendants: bool = False) -> list[str]:
    """The classes that can have entities, with those below on request, in order."""
    found = {d for n in names for d in (schema(n).descendants if descendants else (n,))}
    return sorted(n for n in found if not SCHEMATA[n].abstract)


def buckets_of(names: list[str] | tuple[str, ...], descendants: bool = True) -> list[str]:
    """The partitions that hold entities of these classes."""
    return sorted({SCHEMATA[n].bucket for n in concrete(names, descendants)})


def write_bucket(name: str) -> str:
    s = schema(name)
    if s.abstract:
        raise ValueError(f"{name} is abstract and has no entities")
    return s.bucket


def property_types() -> dict[str, str]:
    """Type of each property name. Where classes disagree, the type that can be
    filtered by exact value wins over running text."""
    out: dict[str, str] = {}
    for s in sorted(SCHEMATA.values(), key=lambda s: s.name):
        for name, kind in s.properties.items():
            if name not in out or out[name] in UNINDEXED_TYPES:
                out[name] = kind
    return out


def properties_of_group(group: str) -> list[str]:
    return sorted(n for n, k in property_types().items() if GROUPS.get(k) == group)


@dataclass(frozen=True)
class Auth:
    """Who asks: the datasets and collections they may read; an admin reads all."""

    datasets: frozenset[str] = frozenset()
    collection_ids: frozenset[int] = frozenset()
    logged_in: bool = False
    is_admin: bool = False


def valid_dataset(name: str) -> str:
    cleaned = name.strip().lower()
    if not cleaned or not all(c.isalnum() or c == "_" for c in cleaned):
        raise ValueError(f"not a name of a dataset: {name!r}")
    return cleaned
