"""Chat formatting by schema fingerprints.

A record is a JSON object.  Its nested field paths (keys joined by dots, `[]` for an array's members) are held against
each declarative layout: of those that the layout knows, the sorted paths are hashed, and the layout fits if it is
registered under that hash, which it is for each choice of its optional paths.  The fitting layout that reads most of the
record's paths counts, and of equal ones the one that stands first.  A layout says where turns are and which paths hold role
and content.  Structures are looked up once for each set of known paths.  All layouts become (record, turn, role, content).

Defined results: keys that a layout doesn't know, also ones that clash with the table's or are other layouts' own,
don't keep it from fitting.  A null value counts as an absent path, but a null content of a present turn gives a turn with null
content where the layout takes roles from the record.  Content that is an array of parts is the parts' texts, joined by
line ends; other values that are no strings stand as JSON.  A record of no known layout, of no turns, or that is no JSON
object gives one row with null turn, role and content and its fingerprint (of all known paths where no layout fits), so none is
lost.  Unknown roles are kept in lower case.  Repeated records give repeated rows.  Very long texts are kept whole.
Extra columns are passed over.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = {"human": "user", "user": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "assistant": "assistant", "chatgpt": "assistant", "agent": "assistant", "system": "system", "developer": "system", "tool": "tool", "function": "tool"}


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.

    turns: the path of an array of messages, with the paths of role and content within; or, where it is empty,
    `fixed`: (role, path) of single turns in their order, several paths of one turn joined by a blank line with "+";
    or, where `row` is set, the record is one turn and row is the path of its number.
    before: (role, path) of turns that come first, such as a system prompt.  optional: paths that may be absent.
    """

    name: str
    turns: str = ""
    role: str = ""
    content: str = ""
    fixed: tuple[tuple[str, str], ...] = ()
    row: str = ""
    before: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()

    def paths(self) -> set[str]:
        """All its paths, and those on the way to them."""
        out = {p for _, ps in (*self.fixed, *self.before) for p in ps.split("+")}
        if self.turns:
            out |= {f"{self.turns}[].{self.role}", f"{self.turns}[].{self.content}"}
        elif self.row:
            out |= {self.row, self.role, self.content}
        for p in list(out):
            keys = p.split(".")
            out |= {".".join(keys[:k]) for k in range(1, len(keys))}
        return out | {p[:-2] for p in out if p.endswith("[]")}


LAYOUTS = (
    Layout("turn-row", row="turn", role="role", content="text", optional=("role", "text")),
    Layout("messages", turns="messages", role="role", content="content", before=(("system", "system"),), optional=("system", "messages[].content")),
    Layout("sharegpt", turns="conversations", role="from", content="value", before=(("system", "system"),), optional=("system", "conversations[].value")),
    Layout("role-conversations", turns="conversations", role="role", content="content", before=(("system", "system"),), optional=("system", "conversations[].content")),
    Layout("dialog", turns="dialog", role="speaker", content="text", optional=("dialog[].text",)),
    Layout("nested-messages", turns="conversation.messages", role="author", content="content.text"),
    Layout("alpaca", fixed=(("user", "instruction+input"), ("assistant", "output")), before=(("system", "system"),), optional=("input", "output", "system")),
    Layout("instruction-response", fixed=(("user", "instruction+context"), ("assistant", "response")), before=(("system", "system"),), optional=("context", "system")),
    Layout("prompt-completion", fixed=(("user", "prompt"), ("assistant", "completion")), before=(("system", "system"),), optional=("system",)),
    Layout("prompt-response", fixed=(("user", "prompt"), ("assistant", "response")), before=(("system", "system"),), optional=("system",)),
    Layout("preference", fixed=(("user", "prompt"), ("assistant", "chosen")), before=(("system", "system"),), optional=("system",)),
    Layout("question-answer", fixed=(("user", "context+question"), ("assistant", "answer")), optional=("context", "answer")),
    Layout("prompt-alone", fixed=(("user", "prompt"),)),
)


def fingerprint(paths: set[str]) -> str:
    """The hash of a set of field paths."""
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(value: object, at: str = "") -> set[str]:
    """All paths of a parsed record whose values aren't null."""
    if isinstance(value, dict):
        out = {at} if at else set()
        for k, v in value.items():
            if v is not None:
                out |= field_paths(v, f"{at}.{k}" if at else str(k))
        return out
    if isinstance(value, list):
        return {at}.union(*(field_paths(v, f"{at}[]") for v in value))
    return {at} if at else set()


@dataclass(frozen=True)
class Registry:
    """Layouts, each with its paths and the fingerprints of those sets of them that it admits."""

    layouts: tuple[tuple[Layout, frozenset[str], frozenset[str]], ...]
    known: frozenset[str]

    def find(self, paths: frozenset[str]) -> tuple[Layout | None, str]:
        """(layout, fingerprint) of a record's known paths."""
        fitting = [(len(paths & own), layout, mark) for layout, own, marks in self.layouts if (mark := fingerprint(paths & own)) in marks]
        _, layout, mark = max(fitting, key=lambda x: x[0], default=(0, None, fingerprint(paths)))
        return layout, mark


def registry(layouts: tuple[Layout, ...] = LAYOUTS) -> Registry:
    made = []
    for x in layouts:
        own = frozenset(x.paths())
        marks = frozenset(fingerprint(own - set(gone)) for k in range(len(x.optional) + 1) for gone in itertools.combinations(x.optional, k))
        made.append((x, own, marks))
    return Registry(tuple(made), frozenset().union(*(own for _, own, _ in made)))


def _get(value: object, path: str) -> object:
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, list):  # parts of a message; those without a text, such as images, stand as JSON
        return "\n".join(x if isinstance(x, str) else x["text"] if isinstance(x, dict) and isinstance(x.get("text"), str) else json.dumps(x, ensure_ascii=False) for x in value)
    return json.dumps(value, ensure_ascii=False)


def _role(value: object) -> str | None:
    said = _text(value)
    return said if said is None else ROLES.get(said.strip().lower(), said.strip().lower())


def turns(record: object, layout: Layout) -> list[tuple[int, str | None, str | None]]:
    """(turn, role, content) of a record in a layout; turns are numbered from 0 unless the record numbers them."""
    if layout.row:
        number = _get(record, layout.row)
        if isinstance(number, int) and not isinstance(number, bool):
            return [(number, _role(_get(record, layout.role)), _text(_get(record, layout.content)))]
        return []
    out: list[tuple[str | None, str | None]] = []
    for role, path in layout.before:
        if (said := _text(_get(record, path))) is not None:
            out.append((role, said))
    for role, paths in layout.fixed:
        parts = [_text(_get(record, p)) for p in paths.split("+")]
        if any(p is not None for p in parts):
            out.append((role, "\n\n".join(p for p in parts if p)))
    messages = _get(record, layout.turns) if layout.turns else None
    for m in messages if isinstance(messages, list) else []:
        if isinstance(m, dict):
            out.append((_role(_get(m, layout.role)), _text(_get(m, layout.content))))
    return [(k, *x) for k, x in enumerate(out)]


def canonical_turns(records: DataFrame, key: str, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(<key>, turn, role, content, layout, fingerprint) of all records, by one narrow pass."""
    known = registry(layouts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[frozenset[str], tuple[Layout | None, str]] = {}  # as many as there are sets of known paths
        for batch in batches:
            own, rows = [], []
            for i, source in enumerate(batch.column(1).to_pylist()):
                try:
                    value = json.loads(source) if source is not None else None
                    paths = known.known & field_paths(value) if isinstance(value, dict) else frozenset()
                except (ValueError, RecursionError):  # no JSON, or nested too deeply for any layout
                    value, paths = None, frozenset()
                if paths not in seen:
                    seen[paths] = known.find(paths)
                layout, mark = seen[paths]
                said = turns(value, layout) if layout else []
                for turn, role, content in said or [(None, None, None)]:
                    own.append(i)
                    rows.append((turn, role, content, layout.name if layout else None, mark))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [key, "turn", "role", "content", "layout", "fingerprint"])

    return records.select(key, record).mapInArrow(run, f"`{key}` {dict(records.dtypes)[key]}, turn bigint, role string, content string, layout string, fingerprint string")


def table_turns(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """canonical_turns of a table whose rows are records: a struct of all its columns is the record."""
    return canonical_turns(rows.select(F.col(key), F.to_json(F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys(rows.columns)])).alias("record")), key)


def oracle() -> str:
    """table_turns over the table conversations, whose rows are of the layout turn-row where they have a turn, in DuckDB's SQL."""

    def marks(every: set[str]) -> str:
        return " ".join(
            f"WHEN {' AND '.join(f'{c} IS {"NULL" if c in gone else "NOT NULL"}' for c in LAYOUTS[0].optional)} THEN '{fingerprint(every - set(gone))}'"
            for k in range(len(LAYOUTS[0].optional) + 1)
            for gone in itertools.combinations(LAYOUTS[0].optional, k)
        )

    every = LAYOUTS[0].paths()
    roles = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ROLES.items())
    said = "lower(trim(role))"
    fits = "turn IS NOT NULL"
    return (
        f"SELECT conv_id, turn, CASE WHEN {fits} THEN CASE {said} {roles} ELSE {said} END END AS role, CASE WHEN {fits} THEN text END AS content, "
        f"CASE WHEN {fits} THEN '{LAYOUTS[0].name}' END AS layout, CASE WHEN {fits} THEN CASE {marks(every)} END ELSE CASE {marks(every - {'turn'})} END END AS fingerprint FROM conversations"
    )
