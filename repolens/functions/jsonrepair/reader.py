"""A JSON reader that recovers.

It reads the grammar of JSON and, wherever the text departs from it, makes the least change that lets reading go on, and notes what it did. It looks ahead a bounded number of characters, and never goes back further than the token at hand, so its time grows with the text's length.
"""

from __future__ import annotations

import re
import sys
import threading
from collections.abc import Callable

from .words import ARTIFACT_KEY, BULLETS, CLOSING_QUOTES, FILLER, FRAGMENTS, OPENING_QUOTES

WORD = re.compile(r"[^\W\d]\w*(?:[.$\-/]\w+)*|_?\w+(?:[.$\-/]\w+)*")
NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])")
LITERALS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None, "undefined": None, "NaN": None, "Infinity": None, "-Infinity": None, "nil": None}
ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
#: Marks that models use among themselves, and code fences.
TOKEN = re.compile(r"<(?:\|?/?[\w:=]+\|?)>|\[/?(?:EOS|PAD|UNK|CLS|SEP|MASK|BOS|INST)\]|```\w*")
#: A property, its quotes escaped, that ended up in the string before it.
EMBEDDED = re.compile(r'\\"\s*,\s*(?:\\n\s*)*\\"[A-Za-z]\w*\\"\s*:')
AHEAD = 400
NEXT_KEY = re.compile(r"\s*[\"'“”]?[A-Za-z_$][\w$ .\-]{0,80}[\"'“”]\s*:")
#: Open structures, beyond which a text is no data.
DEEPEST = 5000
STACK = 256 << 20

MISSING = object()


class Hopeless(ValueError):
    pass


#: Openers up to which Python's own stack will do.
SHALLOW = 200


def deeply(work: Callable[[], object]) -> object:
    """What work returns, on a thread whose stack is large enough for DEEPEST open structures."""
    got: list[object] = []
    wrong: list[BaseException] = []

    def run() -> None:
        try:
            got.append(work())
        except Exception as e:  # noqa: BLE001  raised again by the caller's thread
            wrong.append(e)

    limit, size = sys.getrecursionlimit(), threading.stack_size(STACK)
    try:
        sys.setrecursionlimit(max(limit, 8 * DEEPEST))
        thread = threading.Thread(target=run)
        thread.start()
        thread.join()
    finally:
        sys.setrecursionlimit(limit)
        threading.stack_size(size)
    if wrong:
        raise wrong[0]
    return got[0]


class Reader:
    def __init__(self, text: str):
        self.text, self.n, self.at = text, len(text), 0
        self.repairs: list[str] = []
        #: Kinds of the open structures, outermost first.
        self.open: list[str] = []
        #: A name that stands for a whole broken property.
        self.pending = ""
        #: Whether the last value had lost its beginning.
        self.lost = False

    def note(self, what: str) -> None:
        if what not in self.repairs:
            self.repairs.append(what)

    def peek(self, k: int = 0) -> str:
        return self.text[self.at + k] if self.at + k < self.n else ""

    def space(self) -> None:
        """Past white space and comments."""
        while self.at < self.n:
            c = self.text[self.at]
            if c.isspace() or c == "\ufeff":
                self.at += 1
            elif c == "/" and self.peek(1) == "/":
                end = self.text.find("\n", self.at)
                self.at = self.n if end < 0 else end
                self.note("Removed comments")
            elif c == "/" and self.peek(1) == "*":
                end = self.text.find("*/", self.at)
                self.at = self.n if end < 0 else end + 2
                self.note("Removed comments")
            elif c == "<" and self.text.startswith("<!--", self.at):
                end = self.text.find("-->", self.at)
                self.at = self.n if end < 0 else end + 3
                self.note("Removed comments")
            else:
                return

    def after(self, at: int) -> str:
        """The next character that isn't white space, from a place on."""
        while at < self.n and self.text[at].isspace():
            at += 1
        return self.text[at] if at < self.n else ""

    # values

    def document(self) -> object:
        self.space()
        got = self.value()
        while isinstance(got, dict) and self.goes_on():
            self.note("Removed early closers")
            before, more = self.at, self.object(opened=True)
            got |= more
            if self.at == before:
                break
        return got

    def goes_on(self) -> bool:
        """Whether the outermost object closed too early: properties follow, and more closers than openers."""
        rest = self.text[self.at :]
        if rest.count("}") <= rest.count("{") or rest.lstrip()[:1] in "{[":
            return False
        return bool(re.match(r"[\s,]*[^{}\[\]\"]{0,300}\"?[\w$]+\"\s*:", rest))

    def value(self) -> object:
        if len(self.open) > DEEPEST:
            raise Hopeless("too deep")
        self.space()
        while m := TOKEN.match(self.text, self.at):
            self.at = m.end()
            self.note("Removed token artifacts")
            self.space()
        c = self.peek()
        if c == "{":
            return self.object()
        if c == "[":
            return self.array()
        if c == '"' and re.compile(r"\"\[\s*\"").match(self.text, self.at):  # an array in the place of a string
            self.at += 1
            got = self.array()
            self.at += self.peek() == '"'
            self.note("Removed quotes around an array")
            return got
        if c and (c in OPENING_QUOTES or c in CLOSING_QUOTES or c == "'" or c == "`"):
            if m := re.compile(r"\"[\w$]+\"\s*:\s*(?=[\"{\[\d])").match(self.text, self.at):
                if self.open and self.open[-1] == "object":  # the property's name once more
                    self.at = m.end()
                    self.note("Removed repeated property name")
                    return self.value()
            return self.concatenated(self.string())
        if c == "" or c in ",}]":
            return MISSING
        if c == "\\" and self.peek(1) == '"':
            self.at += 1
            self.note("Removed escapes of quotes")
            return self.string()
        return self.bare()

    def concatenated(self, first: str) -> str:
        """String literals joined by +; identifiers among them vanish."""
        out = first
        while True:
            at = self.at
            self.space()
            if self.peek() != "+":
                self.at = at
                return out
            self.at += 1
            self.space()
            self.note("Merged string concatenation")
            if self.peek() and self.peek() in "\"'“”`":
                out += self.string()
            elif m := WORD.match(self.text, self.at):
                self.at = m.end()
                if self.peek() == "(":
                    close = self.text.find(")", self.at)
                    self.at = self.n if close < 0 else close + 1
            else:
                return out

    def bare(self) -> object:
        """What has no quotes where a value belongs."""
        if (m := NUMBER.match(self.text, self.at)) and (self.after(m.end()) in ("", ",", "}", "]") or "\n" in self.text[m.end() : m.end() + 2]):
            self.at = m.end()
            return float(m[0]) if re.search("[.eE]", m[0]) else int(m[0])
        if m := re.compile(r"[_~≈+]\s*(-?\d+(?:\.\d+)?)(?=\s*[,}\]\n])").match(self.text, self.at):
            self.at = m.end()
            self.note("Fixed invalid literals")
            return float(m[1]) if "." in m[1] else int(m[1])
        m = WORD.match(self.text, self.at)
        if m:
            word, end = m[0], m.end()
            if word in LITERALS and self.after(end) in (",", "}", "]", ""):
                self.at = end
                if word not in ("true", "false", "null"):
                    self.note("Fixed invalid literals")
                return LITERALS[word]
            nearest = self.after(end)
            if self.text[end : end + 1] and self.text[end] in "\"“”":
                follow = self.after(end + 1)
                if follow == ":":  # word": value - the word and its colon are corrupt
                    self.at = end + 1
                    self.space()
                    self.at += 1
                    self.note("Removed corrupt text between colon and value")
                    return self.value()
                if follow in (",", "}", "]", "") or "\n" in self.text[end + 1 : end + 3]:
                    self.at = end + 1
                    self.lost = True
                    self.note("Added missing opening quote")
                    return word
                self.at = end  # stray word before a quoted value
                self.note("Removed stray text before value")
                return self.value()
            if nearest == ":" and self.open and self.open[-1] == "object":
                self.at = end
                self.space()
                self.at += 1
                self.note("Removed corrupt text between colon and value")
                return self.value()
            if nearest == "+":
                self.at = end
                return self.concatenated("")
            if nearest and nearest in "{[":
                self.at = end
                self.note("Removed stray text before value")
                return self.value()
        # text up to a delimiter or the end of the line; a quote at its end belongs to it
        end = self.at
        while end < self.n and self.text[end] not in ",}]\n":
            if self.text[end] == '"' and end > self.at and (self.after(end + 1) in (",", "}", "]", "") or self.text[end - 1].isspace() and NEXT_KEY.match(self.text, end)):
                break
            end += 1
        text = self.text[self.at : end].strip()
        self.at = end + (1 if self.text[end : end + 1] == '"' and not NEXT_KEY.match(self.text, end) else 0)
        self.note("Quoted bare values")
        return MISSING if not text else text

    def string(self) -> str:
        """A quoted text. A quote ends it if what follows can follow a string; others are part of it, if the line has one that does."""
        quote = self.peek()
        self.at += 1
        plain = quote == '"'
        if not plain:
            self.note("Normalised quotes")
        closing = {"“": "”\"", "”": "”\"", "„": "“”\"", "‘": "’'", "’": "’'"}.get(quote, quote)
        out: list[str] = []
        while self.at < self.n:
            c = self.text[self.at]
            if c == "\\":
                self.escape(out)
            elif c in closing:
                if self.ends_here(self.at + 1):
                    self.at += 1
                    return "".join(out)
                out.append(c)
                self.at += 1
                self.note("Escaped quotes within strings")
            elif c == "\n" and self.unterminated():
                text = "".join(out).rstrip()
                self.note("Closed unterminated string")
                return text[:-1].rstrip() if text.endswith(",") else text
            else:
                if c < " ":
                    self.note("Escaped control characters")
                out.append(c)
                self.at += 1
        self.note("Completed truncated text")
        return "".join(out)

    def escape(self, out: list[str]) -> None:
        c = self.peek(1)
        if c == '"' and (m := EMBEDDED.match(self.text, self.at)):
            end = re.compile(r'(?<!\\)"').search(self.text, m.end())
            self.at = end.start() if end else self.n
            self.note("Removed properties within a string")
            return
        if c == "u" and re.fullmatch("[0-9a-fA-F]{4}", self.text[self.at + 2 : self.at + 6]):
            code = int(self.text[self.at + 2 : self.at + 6], 16)
            self.at += 6
            if 0xD800 <= code < 0xDC00 and re.fullmatch(r"\\u[dD][c-fC-F][0-9a-fA-F]{2}", self.text[self.at : self.at + 6]):
                code = 0x10000 + ((code - 0xD800) << 10) + int(self.text[self.at + 2 : self.at + 6], 16) - 0xDC00
                self.at += 6
            out.append("\ufffd" if 0xD800 <= code < 0xE000 else chr(code))
        elif c in ESCAPES and c:
            if c == '"' and self.text[self.at + 2 : self.at + 3] in ("", "\n") and self.after(self.at + 2) in ("}", "]", ""):
                self.note("Removed escapes of quotes")
                self.at += 1  # the quote ends the string
                return
            out.append(ESCAPES[c])
            self.at += 2
        else:
            self.note("Fixed invalid escapes")
            if c in "'`$":
                out.append(c)
                self.at += 2
            else:
                out.append("\\")
                self.at += 1

    def ends_here(self, at: int) -> bool:
        """Whether a quote that stands before this place ends its string."""
        c = self.after(at)
        if c == "" or c in "}]":
            return True
        if c == ":":
            return not self.open or self.open[-1] == "object" or NEXT_KEY.match(self.text, at) is None
        if c == ",":
            # within a sentence, a comma after a quote is followed by plain words up to another quote that ends well
            rest = self.text[self.text.index(",", at) + 1 : at + AHEAD]
            if m := re.match(r"[ \t]+[a-z][^\"\n{}\[\]:]*\"(?=\s*[,}\]])", rest):
                return bool(re.match(r"[ \t]+[\w.$]+\"", rest)) and not m[0].strip(' "').count(" ")
            return True
        between = self.text[at : at + AHEAD]
        stripped = between.lstrip()
        if stripped.startswith("<!--"):
            return True
        if self.open and self.open[-1] == "array" and re.match(r"[^\s\",\[\]{}:]+\s*,\s*\"", stripped):
            return True  # one stray word, then the next element
        if "\n" in between[: len(between) - len(stripped)]:
            return True
        if stripped[0] in "\"“" or stripped[0] == "+" or stripped[0] == "/":
            return True
        # letters follow on the same line: an inner quote, if another one ends the string on this line
        line = stripped.split("\n", 1)[0]
        return not re.search(r"\"\s*(?:[,}\]]|$)", line) or bool(re.match(r"[\w*•\-<>|]+[\"“]\s*[\w]+[\"”]\s*:", line))

    def unterminated(self) -> bool:
        """Whether a line end within a string is better taken as its end: the next line looks like a new property or a closer."""
        rest = self.text[self.at + 1 : self.at + AHEAD]
        return bool(re.match(r"\s*(?:\"[\w$ .\-]{1,80}\"\s*:|[}\]]\s*(?:[,}\]]|$))", rest))

    # arrays

    def array(self) -> list:
        self.at += 1
        self.open.append("array")
        out: list = []
        while True:
            self.space()
            c = self.peek()
            if c == "":
                self.note("Completed truncated text")
                break
            if c == "]":
                self.at += 1
                break
            if c == "}":
                if self.closes_outer():
                    self.note("Fixed mismatched delimiters")
                    break
                self.at += 1
                self.note("Fixed mismatched delimiters")
                break
            if c == ",":
                self.at += 1
                self.comma_ahead()
                continue
            before = self.at
            if self.is_property():
                if not out or all(isinstance(x, str | int | float) for x in out):
                    if len(self.open) > 1 and self.open[-2] == "object":
                        self.note("Closed array before a property")
                        break
                if out and isinstance(out[-1], dict) or not out:
                    self.note("Added missing opening brace")
                    out.append(self.object(opened=True))
                    continue
                self.key()
                self.value()
                self.note("Removed property from array")
                continue
            if self.skip_stray(in_array=True):
                continue
            got = self.value()
            if self.lost and isinstance(got, str):
                got = self.mended(got, out)
            self.lost = False
            if got is not MISSING:
                out.append(got)
            if self.at == before:
                self.at += 1
                self.note("Removed stray characters")
            self.separator()
        self.open.pop()
        return out

    def mended(self, name: str, others: list) -> str:
        """A dotted name without its opening quote whose first part is corrupt takes the beginning of a neighbour that has the rest of it."""
        first, _, rest = name.partition(".")
        parts = rest.split(".")
        known = [x for x in others if isinstance(x, str) and "." in x]
        if len(parts) < 2 or any(x.startswith(first + ".") for x in known):
            return name
        for x in reversed(known):
            at = x.find(f".{parts[0]}.{parts[1]}.") if len(parts) > 2 else x.find(f".{parts[0]}.")
            if at > 0:
                self.note("Restored package prefix")
                return f"{x[:at]}.{rest}"
        return name

    def is_property(self) -> bool:
        """Whether a quoted text and a colon follow."""
        return bool(re.compile(r"\"[^\"\n\\]{1,120}\"\s*:(?!:)").match(self.text, self.at))

    def closes_outer(self) -> bool:
        """Whether a } within an array is the enclosing object's."""
        if len(self.open) < 2 or self.open[-2] != "object":
            return False
        rest = self.text[self.at + 1 : self.at + 1 + AHEAD].lstrip()
        if len(self.open) < 3:
            return not (rest.startswith(",") or rest.startswith('"'))
        if rest.startswith(",") and re.match(r',\s*"[^"\n]{1,120}"\s*:', rest):
            return self.open[-3] == "object"
        return True

    # objects

    def object(self, opened: bool = False) -> dict:
        self.at += not opened
        self.open.append("object")
        out: dict = {}
        while True:
            self.space()
            c = self.peek()
            if c == "":
                self.note("Completed truncated text")
                break
            if c == "}":
                self.at += 1
                break
            if c == "{" and out and len(self.open) > 1 and self.open[-2] == "array":
                self.note("Added missing closing brace")
                break
            if c == "]":
                if len(self.open) < 2 or self.open[-2] != "array":
                    self.at += 1
                    if self.after(self.at) in ("", "]", "}"):
                        self.note("Fixed mismatched delimiters")
                        break
                    self.note("Removed stray closers")
                    continue
                # ], then a property: the object's brace is missing; ], then , { or a closer: the bracket stands for the brace
                rest = self.text[self.at + 1 : self.at + 1 + AHEAD].lstrip()
                self.note("Fixed mismatched delimiters")
                if re.match(r",\s*\{", rest):
                    self.at += 1
                break
            if c == ",":
                self.at += 1
                self.comma_ahead()
                continue
            before = self.at
            if self.skip_stray():
                if self.pending:
                    out.setdefault("name", self.pending)
                    self.pending = ""
                continue
            if m := re.compile(r"\"\s*:\s*(?=\")").match(self.text, self.at):
                self.at = m.end()  # ": "value" lacks the name
                self.note("Named a property without name")
                got = self.value()
                out.setdefault("description" if "name" in out else "name", got)
                self.separator()
                continue
            key = self.key()
            if key is None:
                if self.at == before:
                    self.at += 1
                    self.note("Removed stray characters")
                continue
            got = self.after_key(key)
            if got is not MISSING:
                if ARTIFACT_KEY.fullmatch(key):
                    self.note("Removed artifact properties")
                else:
                    out[key] = got
            self.separator()
        self.open.pop()
        return out

    def comma_ahead(self) -> None:
        c = self.after(self.at)
        if c in ("}", "]"):
            self.note("Removed trailing commas")
        elif c == ",":
            self.note("Removed repeated commas")

    def separator(self) -> None:
        """After a value: past stray text up to a comma, a closer, a quote or a line end."""
        before = self.at
        self.space()
        c = self.peek()
        if c == "" or c in ",}]":
            return
        if self.open[-1] == "array" and "\n" in self.text[before : self.at] and re.compile(r"[A-Z][A-Z0-9_]+\s*[,\]\n]|[\w$]+(?:\.[\w$]+)+\s*[\",\]\n]").match(self.text, self.at):
            self.note("Added missing commas")
            return
        if c in '"“{[':
            self.note("Added missing commas")
            return
        end = self.at
        while end < self.n and self.text[end] not in ',}]"\n':
            end += 1
        if self.text[end : end + 1] == '"' and self.is_key_at(end):
            word = re.search(r"[\w$]+$", self.text[self.at : end])
            if word and self.after(end + 1) == ":":
                self.note("Added missing commas")
                self.at = end - len(word[0])
                return
        if re.match(r"[\w$]+\"?\s*:", self.text[self.at : self.at + 80]):
            self.note("Added missing commas")
            return
        self.at = end
        self.note("Removed stray text after value")

    def is_key_at(self, at: int) -> bool:
        return self.text[at : at + 1] == '"'

    def skip_stray(self, in_array: bool = False) -> bool:
        """Past markers of lists, token artifacts, ellipses, and words or lines that no quote or colon belongs to."""
        text, at = self.text, self.at
        c = text[at]
        if m := re.compile(r"[\w$]+\s*=\s*\"\s*(?=\"[\w$ ]+\"\s*:)|_\w+_?\s*=\s*\"[^\"\n]*\"|[A-Z0-9][A-Z0-9.\-_]*\.JAR\"|[\w.$]+\s*=\s*[\w.]+[ \t]+(?=\"[\w$ ]+\"\s*:)").match(text, at):
            self.at = m.end()
            self.note("Removed artifact text")
            return True
        if not in_array and (m := re.compile(r"[A-Za-z]\w*(?:-\w+)+:[^\n\"{\[]*(?:\n\s*-[^\n]*)*(?:\n(?=\s*[\"}])|$)").match(text, at)):
            self.at = m.end()
            self.note("Removed stray text before property")
            return True
        if not in_array and (m := re.compile(r"_([A-Z][A-Z0-9_]*)\"\s*:\s*\"[^\"\n]*\"").match(text, at)):
            self.pending = m[1]
            self.at = m.end()
            self.note("Named a property without name")
            return True
        if m := TOKEN.match(text, at):
            self.at = m.end()
            self.note("Removed token artifacts")
            return True
        if c in BULLETS and (not in_array or c != "-" or not text[at + 1 : at + 2].isdigit()):
            self.at += 1
            self.note("Removed list markers")
            return True
        if m := re.compile(r"\.{2,}|…").match(text, at):
            self.at = m.end()
            self.note("Removed truncation marks")
            return True
        if m := re.compile(r"\"?(?:\.{3}|…|\[?(?:TRUNCATED|_TRUNCATED_)\]?)\"?(?=\s*[,}\]])").match(text, at):
            self.at = m.end()
            self.note("Removed truncation marks")
            return True
        if m := re.compile(r"[^\x00-\x7f“”„]+(?=\"[^\"\n]*\"\s*(?:[,\]:}\n]|$))").match(text, at):
            self.at = m.end()
            self.note("Removed stray text before value")
            return True
        if c in OPENING_QUOTES or c in "'`{[\\" or c in CLOSING_QUOTES:
            return False
        m = WORD.match(text, at)
        if not m:
            return False
        end = m.end()
        follow = text[end : end + 1]
        if follow and follow in "\"“”":
            quoted = re.compile(r"[^\"\n]{0,200}\"").match(text, end + 1)
            is_key = self.after(end + 1) == ":"
            if in_array:
                # word", is an element without its opening quote; word"text" has a stray word in front
                if quoted and self.after(end + 1) not in (",", "]", "}", ""):
                    self.at = end
                    self.note("Removed stray text before value")
                    return True
                return False
            if not is_key and quoted:
                self.at = end
                self.note("Removed stray text before property")
                return True
            return False
        if follow == ":" or self.after(end) in (":", "=") or in_array and (follow in (",", "]") or self.after(end) in (",", "]") or m[0] in LITERALS):
            return False
        line_end = text.find("\n", at)
        line = text[at : line_end if line_end >= 0 else self.n]
        if in_array:
            if "\"" not in line and "," not in line and (FILLER.search(line) or re.match(r"\s*[a-z]+(?: [\w.]+)+\s*$|\s*[a-z]+\.+\s*$", line)):
                self.at = at + len(line)
                self.note("Removed stray text")
                return True
            if re.match(r"\w+\s+[\"“]", line):
                self.at = end
                self.note("Removed stray text before value")
                return True
            return False
        quote = line.find('"')
        yaml = re.match(r"[\w\-]+:\s", line)
        if yaml:
            return False
        self.at = at + (len(line) if quote < 0 else quote)
        if quote >= 0 and line[:quote].rstrip().endswith(":"):
            self.at = at
            return False
        self.note("Removed stray text before property")
        return True

    def key(self) -> str | None:
        """A property's name, with quotes or without; None if there is none."""
        c = self.peek()
        if c in OPENING_QUOTES or c in "'`" or c in CLOSING_QUOTES:
            m = c == "'" and re.compile(r"'([^'\"\n\\]*)'(?=\s*[:=])").match(self.text, self.at)
            m = m or re.compile(r"[\"“”'`]([^\"“”\n\\]*)[\"“”'`](?=\s*[:=])").match(self.text, self.at)
            if m:
                self.at = m.end()
                if c != '"':
                    self.note("Normalised quotes")
                return self.clean_key(m[1])
            if m := re.compile(r"\"([A-Za-z_$][\w$\-]*)\s*:\s*\"\s*(?=[\[{\d]|-\d|true\b|false\b|null\b|\"[^\"\n]*\"\s*[,}\n])").match(self.text, self.at):
                self.at = m.end()  # "name:" value has the colon within the quotes
                self.note("Moved the colon out of a property name")
                return self.clean_key(m[1])
            if m := re.compile(r"\"([A-Za-z_$][\w$\-]*)\s*:\s*(?=[\"{\[\d]|true|false|null)").match(self.text, self.at):
                self.at = m.end(1)  # "name: "value" lacks the closing quote
                self.note("Added missing quote of property name")
                return self.clean_key(m[1])
            if m := re.compile(r"\"([A-Za-z_$][\w$\-]*)\s+\"(?=[^\"\n]*\"\s*[,}\n])").match(self.text, self.at):
                self.at = m.end() - 1  # "name "value" lacks quote and colon
                self.note("Added missing quote of property name")
                return self.clean_key(m[1])
            return self.clean_key(self.string())
        if c == ":":
            self.note("Named a property without name")
            return "name"
        if m := re.compile(r"([A-Za-z_$][\w$\-]*)[\"“”'](?=\s*:)").match(self.text, self.at):
            self.at = m.end()
            self.note("Added missing quote of property name")
            return FRAGMENTS.get(m[1], self.clean_key(m[1]))
        if m := re.compile(r"([A-Za-z_$][\w$\-]*)(?=\s*(?::|=))").match(self.text, self.at):
            self.at = m.end()
            self.note("Quoted property names")
            return self.clean_key(m[1])
        return None

    def clean_key(self, key: str) -> str:
        cut = re.sub(r"\s+", " ", key).strip()
        cut = re.sub(r"^[*•\-\s]+", "", cut)
        if m := re.fullmatch(r"([a-z][A-Za-z]+) [a-z]+", cut):
            cut = m[1]  # a name and a stray word
        if cut != key:
            self.note("Cleaned property names")
        return cut

    def after_key(self, key: str) -> object:
        """The value of a property, from its colon (or what stands for it) on."""
        self.space()
        c = self.peek()
        if c == ":" or c == "=":
            m = re.compile(r"(?::=|=>|=|::|:)\s*").match(self.text, self.at)
            if m[0].strip() != ":":
                self.note("Fixed assignment signs")
            self.at = m.end()
            self.space()
            if self.peek() == "-" and self.peek(1) in (" ", '"', ":"):
                self.at += 1
                self.note("Removed stray characters")
            if self.peek() == ":":
                self.at += 1
                self.note("Removed stray characters")
        elif c == "-" and self.after(self.at + 1) == ":":
            self.at = self.text.index(":", self.at) + 1
            self.note("Removed stray characters")
        elif c and (c in '"{[' or c.isdigit() or re.compile(r"(?:true|false|null)\b").match(self.text, self.at)):
            self.note("Added missing colons")
        elif c == "" or c in ",}]":
            if re.fullmatch(r"[A-Za-z_$][\w$]*", key):
                self.note("Completed dangling properties")
                return None
            self.note("Removed stray strings")
            return MISSING
        else:
            end = self.text.find("\n", self.at)
            colon = self.text.find(":", self.at)
            if 0 <= colon < (end if end >= 0 else self.n):
                self.at = colon + 1
                self.note("Removed stray characters")
            else:
                self.note("Removed stray strings")
                return MISSING
        got = self.value()
        if got is MISSING:
            self.note("Completed dangling properties")
            return None
        return got


def read(text: str) -> tuple[object, list[str]]:
    """The value that a text holds, and the repairs that were made."""
    reader = Reader(text)
    got = deeply(reader.document) if text.count("{") + text.count("[") > SHALLOW else reader.document()
    if got is MISSING or not isinstance(got, dict | list):
        raise Hopeless("no object or array")
    return got, reader.repairs
