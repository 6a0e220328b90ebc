"""Prompts as Column expressions: for files by type, for insights from summaries (whole or in parts), for joining partial results, and for questions. They are built in the JVM, beside the rows that they ask about."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Headers of the part that holds the data. Fixed values.
CODE, FILE_SUMMARIES, FRAGMENTED_DATA = "CODE", "FILE_SUMMARIES", "FRAGMENTED_DATA"
PERSONA = "You are an experienced developer who studies the code of an existing application."
FENCE = "```"


@dataclass(frozen=True)
class Kind:
    """What a prompt of one kind asks: of which data (about), for what (a line each, or a section's title with its lines), and the schema of the answer."""

    about: str
    asks: Sequence[str | tuple[str, Sequence[str]]]
    schema: Mapping[str, object] = field(default_factory=dict)
    header: str = CODE
    fenced: bool = False
    note: str = ""

    def lines(self) -> str:
        out = []
        for ask in self.asks:
            title, lines = ("", [ask]) if isinstance(ask, str) else ask
            out += [f"__{title}__"] * bool(title) + [f"* {x}" for x in lines]
        return "\n".join(out)

    def before(self, note: str | None = None) -> str:
        """All that stands before the data."""
        note = self.note if note is None else note
        parts = [f"{PERSONA} The section {self.header} below holds {self.about}. From it, give:", self.lines(), f"Answer with JSON of this schema and nothing else:\n{json.dumps(self.schema)}", *([note] if note else []), f"{self.header}:\n"]
        return "\n\n".join(parts)


def partial_note(header: str) -> str:
    what = header.lower().replace("_", " ")
    return f"These are a part of many more {what}; tell only what this part shows."


def rendered(kind: Kind, content: Column, note: str | None = None) -> Column:
    """Prompt of one kind over content (null: empty)."""
    fence = FENCE + "\n" if kind.fenced else ""
    return F.concat(F.lit(kind.before(note) + fence), F.coalesce(content, F.lit("")), F.lit("\n" + FENCE if kind.fenced else ""))


def source_prompt(kinds: Mapping[str, Kind], name: Column, content: Column, otherwise: str | None = None) -> Column:
    """Prompt for a file by its type; types without a kind take that of otherwise, or have no prompt (null)."""
    out: Column = rendered(kinds[otherwise], content) if otherwise is not None else F.lit(None).cast("string")
    for key in sorted(kinds, reverse=True):
        out = F.when(name == key, rendered(kinds[key], content)).otherwise(out)
    return out


def insight_prompt(kind: Kind, content: Column, partial: Column | bool = False) -> Column:
    """Prompt for one category of insights; where partial, it says that the data is a part of the whole."""
    partial = F.lit(partial) if isinstance(partial, bool) else F.coalesce(partial, F.lit(False))
    return F.when(partial, rendered(kind, content, partial_note(kind.header))).otherwise(rendered(kind, content))


def reduce_prompt(category: str, schema: Mapping[str, object], content: Column) -> Column:
    """Prompt to join partial results of a category into one without repeats."""
    return rendered(Kind(f"partial results for '{category}' as JSON, which may repeat each other", [f"One list of '{category}' without repeats"], schema, FRAGMENTED_DATA), content)


def query_prompt(question: Column, content: Column) -> Column:
    """Prompt for a question about code that a search found; the answer is text."""
    head = f"{PERSONA} The section {CODE} below holds files of it. Answer the QUESTION in a few paragraphs, and name the places in the code that the answer rests on.\n\nQUESTION:\n"
    return F.concat(F.lit(head), F.coalesce(question, F.lit("")), F.lit(f"\n\n{CODE}:\n"), F.coalesce(content, F.lit("")))
