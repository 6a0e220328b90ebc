"""From text to data: phases of repair with a strict parse after each, then validation, and coercion where that fails."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from . import reader
from .coerce import TRANSFORMS, Schema, invalid, restore_names
from .words import INSIGNIFICANT


RECOVERED = "recovering reader"


@dataclass
class Result:
    data: object = None
    error: str | None = None
    repairs: list[str] = field(default_factory=list)
    steps: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return self.error is None

    @property
    def significant(self) -> bool:
        return bool(set(self.repairs) - set(INSIGNIFICANT))


def _no(name: str) -> float:
    raise ValueError(f"{name} isn't JSON")


def strict(text: str) -> object:
    return json.loads(text, parse_constant=_no)


# Phases: text -> (text, repairs). Each looks at what is outside strings, as far as strings can be told.


def strip_fences(text: str) -> tuple[str, list[str]]:
    out = text.strip()
    notes = ["Trimmed white space"] if out != text else []
    if m := re.match(r"(?:```|~~~)[ \t]*\w*[ \t]*\r?\n?", out):
        out = re.sub(r"\s*(?:```|~~~)\s*$", "", out[m.end() :]).strip()
        notes.append("Removed code fences")
    return out, notes


def _span(text: str, start: int) -> int | None:
    """End of the balanced structure that begins at start, or None."""
    depth, at, n = 0, start, len(text)
    while at < n:
        c = text[at]
        if c == '"':
            at += 1
            while at < n and text[at] != '"':
                at += 2 if text[at] == "\\" else 1
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return at + 1
        at += 1
    return None


def extract(text: str) -> tuple[str, list[str]]:
    """The first balanced structure that begins plausibly, if text surrounds it; text before a structure that never ends goes, too. The same structure twice in a row counts once."""
    half = len(text) // 2
    for k in (half, half + 1):
        if len(text) > 3 and text[:k].strip() == text[k:].strip() and text[:1] in "{[":
            return text[:k].strip(), ["Collapsed duplicate structure"]
    for m in re.finditer(r"\{(?=\s*(?:[\"'“}]|[\w$]+[\"”]?\s*:|//|/\*|$))|\[(?=\s*(?:[\"'“{\[\]\d\-]|true|false|null|$))", text):
        end = _span(text, m.start())
        if end is None:
            if m.start():
                return text[m.start() :], ["Removed text before JSON"]
            return text, []
        if m.start() or end < len(text):
            # A structure that closes early in a text that begins with it is more likely damaged than complete.
            rest = text[end:].strip()
            if not m.start() and (re.match(r"[,}\]\"]", rest) or rest[:1] not in ("{", "[") and rest.count("}") > rest.count("{")):
                return text, []
            return text[m.start() : end], ["Extracted JSON from surrounding text"]
        return text, []
    return text, []


def strip_comments(text: str) -> tuple[str, list[str]]:
    out, at, n = [], 0, len(text)
    while at < n:
        m = re.compile(r'"(?:[^"\\\n]|\\.)*"|//[^\n]*|/\*.*?\*/|<!--.*?-->|[^"/<]+|.', re.S).match(text, at)
        if not (m[0].startswith("//") or m[0].startswith(("/*", "<!--")) and len(m[0]) > 3):
            out.append(m[0])
        at = m.end()
    got = "".join(out)
    return got, ["Removed comments"] if got != text else []


def unescape(text: str) -> tuple[str, list[str]]:
    """A whole text whose quotes are all escaped."""
    if re.match(r'[{\[]\s*\\"', text) and not re.search(r'(?<!\\)"', text):
        return re.sub(r'\\(["\\/])', r"\1", text).replace("\\n", "\n"), ["Removed escapes of quotes"]
    return text, []


def normalise_characters(text: str) -> tuple[str, list[str]]:
    """Control characters in strings escaped, others dropped; bad escapes doubled."""
    notes: list[str] = []

    def fix(m: re.Match) -> str:
        s = m[0]
        s = re.sub(r"\\(?![\"\\/bfnrt]|u[0-9a-fA-F]{4})", lambda e: "" if m[0][e.end() : e.end() + 1] in "'`" else "\\\\", s)
        return re.sub(r"[\x00-\x1f]", lambda c: {"\n": "\\n", "\t": "\\t", "\r": "\\r"}.get(c[0], ""), s)

    out = re.sub(r'"(?:[^"\\]|\\.)*"', fix, text, flags=re.S)
    out = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufeff\u200b]", "", out)
    if out != text:
        notes.append("Normalised characters")
    return out, notes


def fix_commas(text: str) -> tuple[str, list[str]]:
    out = re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*(?:,|[}\]]))', lambda m: m[1] or "", text, flags=re.S)
    return out, ["Removed trailing commas"] if out != text else []


Phase = tuple[str, Callable[[str], tuple[str, list[str]]]]
#: Their result is what later steps work on.
STRUCTURE: tuple[Phase, ...] = (("structure: fences", strip_fences), ("structure: extraction", extract), ("structure: escapes", unescape))
#: Tried one on top of the other; where strings are damaged they may mistake what is a string, so the recovering reader, which does the same in passing, begins from the text before them.
SURFACE: tuple[Phase, ...] = (
    ("comments", strip_comments),
    ("characters", normalise_characters),
    ("syntax: commas", fix_commas),
)


#: Properties, their quotes escaped, over several lines of a string: the reader parts them from it.
LEAKED = re.compile(r'[^\\]\\"\s*,[ \t]*\n\s*\\"[A-Za-z]\w*\\"\s*:')


def parse(text: str | None) -> Result:
    """Data of a text. Empty texts and texts without any brace or bracket are errors."""
    out = Result()
    if text is None or not text.strip():
        out.error = "PARSE: empty"
        return out
    if "{" not in text and "[" not in text:
        out.error = "PARSE: no JSON"
        return out
    try:
        out.data = strict(text)
        if isinstance(out.data, dict | list):
            return out
        text = out.data if isinstance(out.data, str) else text  # JSON within a JSON string
        out.repairs.append("Unwrapped JSON from a string")
    except (ValueError, RecursionError):
        pass
    for phases in (STRUCTURE, SURFACE):
        if phases is SURFACE and LEAKED.search(text):
            break
        trial, repairs, steps = text, [], []
        for name, phase in phases:
            changed, notes = phase(trial)
            if changed != trial:
                trial = changed
                repairs += notes
                steps.append(name)
                try:
                    out.data = strict(trial)
                except (ValueError, RecursionError):
                    continue
                if isinstance(out.data, dict | list):
                    out.repairs += repairs
                    out.steps += steps
                    return out
        if phases is STRUCTURE:
            text = trial
            out.repairs += repairs
            out.steps += steps
    try:
        out.data, notes = reader.read(text)
        out.repairs += [n for n in notes if n not in out.repairs]
        out.steps.append(RECOVERED)
    except (ValueError, RecursionError, IndexError) as e:
        out.error = f"PARSE: {e}"
    return out


def validate(out: Result, schema: Schema | None) -> Result:
    """Data that fits the schema as it is stays; else transforms run in their order, and the result is validated again. What the reader recovered may have lost parts of names that the schema doesn't demand, so names are restored in any case."""
    if out.error or schema is None:
        return out
    if RECOVERED in out.steps and (named := restore_names(out.data, schema)) != out.data:
        out.data = named
        out.steps.append("restore names")
    if not (wrong := invalid(out.data, schema)):
        return out
    data = out.data
    for name, transform in TRANSFORMS:
        changed = transform(data, schema)
        if changed != data:
            out.steps.append(name)
            data = changed
    wrong = invalid(data, schema)
    if wrong:
        out.error = f"VALIDATION: {wrong}"
    out.data = data
    return out


def parse_and_validate(text: str | None, schema: Schema | None = None) -> Result:
    return validate(parse(text), schema)


def validate_object(data: object, schema: Schema) -> Result:
    """An object that needs no parsing."""
    return validate(Result(data=data), schema)
