"""What an index holds of each field, and how queries are run."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: Zones of these fields are read by the loaders themselves.
PATH_FIELD, LINK_FIELD = "_relative_fp", "_add_files"


@dataclass(frozen=True)
class FieldConfig:
    """A field is searched if its weight is positive; k and b are its BM25 parameters.

    storage: "text" keeps its zones, "enum" its first value as a facet, "i64" its first number; any of them, or none.
    parse: how numbers are read: "integer", "round", or "datetime" by `fmt`.  default stands for a missing number.
    """

    name: str
    weight: float = 0.0
    k: float = 1.2
    b: float = 0.75
    storage: tuple[str, ...] = ("text",)
    parse: str = "integer"
    default: int = 0
    fmt: str = "yyyy MMM dd HH:mm Z"


DEFAULT_FIELDS = (
    FieldConfig("title", 2.0, 1.2, 0.15),
    FieldConfig("h1", 2.0, 1.2, 0.15),
    FieldConfig("heading", 1.5, 1.2, 0.25),
    FieldConfig("body", 1.0, 1.2, 0.75),
    FieldConfig("headingLink"),
    FieldConfig(PATH_FIELD),
    FieldConfig("link"),
)


def merged_fields(own: dict[str, FieldConfig | None], defaults: tuple[FieldConfig, ...] = DEFAULT_FIELDS) -> tuple[FieldConfig, ...]:
    """The defaults with a user's fields over them; None takes a default away."""
    out = {f.name: f for f in defaults}
    for name, f in own.items():
        if f is None:
            out.pop(name, None)
        else:
            out[name] = f
    return tuple(out.values())


@dataclass(frozen=True)
class IndexConfig:
    """fields, analyzer ("ascii", "ascii_stemmer" or "chinese") and layout of an index."""

    fields: tuple[FieldConfig, ...] = DEFAULT_FIELDS
    analyzer: str = "ascii"
    stem_language: str = "english"
    with_positions: bool = True
    ignore_stop_words: bool = False
    stop_words: tuple[str, ...] | None = None
    max_term_len: int = 80
    #: Directories of the postings table, by hash of the term, and the tasks that write each one, by hash of the document,
    #: so that the bucket of a term that is everywhere isn't one task's work.
    buckets: int = 64
    spread: int = 4

    @property
    def scored(self) -> tuple[FieldConfig, ...]:
        """Searched fields in descending weight; a field's place is its id."""
        return tuple(sorted((f for f in self.fields if f.weight > 0), key=lambda f: -f.weight))

    def field_id(self, name: str) -> int | None:
        return next((i for i, f in enumerate(self.scored) if f.name == name), None)


def preset(size: str, base: IndexConfig | None = None) -> IndexConfig:
    """Layouts for collections of a size: more buckets let a query read less of a larger index."""
    buckets, spread = {"small": (8, 2), "medium": (64, 4), "large": (1024, 64)}[size]
    return replace(base or IndexConfig(), buckets=buckets, spread=spread)


@dataclass(frozen=True)
class SearchOptions:
    max_auto_suffix: int = 3
    max_suffix: int = 5
    proximity: bool = True
    result_limit: int | None = None
    #: Facet name to allowed values; None among them stands for documents without a value.
    enums: dict[str, list[str | None]] = field(default_factory=dict)
    #: Numeric facet to (least, most), either of which may be None.
    ranges: dict[str, tuple[int | None, int | None]] = field(default_factory=dict)
    sort: str | None = None
    ascending: bool = False
