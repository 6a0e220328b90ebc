"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V

def literal_map(pairs: Iterable[tuple[str, object]]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def first_match(pairs: Iterable[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    pairs = list(pairs)
    out = F.when(pairs[0][0], pairs[0][1])
    for condition, value in pairs[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


# Texts and paths


_SPACE = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def js_trim(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(c, f"^{_SPACE}|{_SPACE}$", "")


def count_lines(c: Column) -> Column:
    """Line feeds, and one more if the text doesn't end in one; an empty text has no line."""
    return F.when(c == "", F.lit(0)).otherwise(F.octet_length(c) - F.octet_length(F.replace(c, F.lit("\n"), F.lit(""))) + F.when(F.endswith(c, F.lit("\n")), 0).otherwise(1)).cast("long")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def relative_path(root: Column, path: Column) -> Column:
    """path below root; other paths stay as they are."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, base), F.substr(path, F.char_length(base) + 1)).otherwise(path)


def extension(name: Column) -> Column:
    """What follows the last dot of a file name, in lower case; none for names that begin with their only dot."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


_BY_EXTENSION = {e: (t, code) for t, names, code in V.EXTENSION_TYPES for e in names.split()}


def canonical_type(name: Column, ext: Column) -> Column:
    """File type by whole name, then by the beginning of the name, then by extension, else default."""
    low = F.lower(name)
    starts = [((low == w) | low.startswith(f"{w}.") if alone else low.startswith(f"{w}."), t) for w, t, alone in V.NAME_PREFIX_TYPES]
    by_extension = literal_map(({e: t for e, (t, _) in _BY_EXTENSION.items()} | V.EXTENSION_ALIASES).items())
    return F.coalesce(F.try_element_at(literal_map(V.FILENAME_TYPES.items()), low), first_match(starts), F.try_element_at(by_extension, F.lower(ext)), F.lit("default"))


def is_code(ext: Column) -> Column:
    """False for known documentation and project files, else true."""
    return F.coalesce(F.try_element_at(literal_map((e, code) for e, (_, code) in _BY_EXTENSION.items()), F.lower(ext)), F.lit(True))


def _segments(path: Column) -> Column:
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: s != "")


def module_of_path(path: Column, depth: int) -> Column:
    """The first depth segments; null if there are fewer (the file name counts)."""
    parts = _segments(path)
    return F.when(F.size(parts) >= depth, F.array_join(F.slice(parts, 1, depth), "/"))


def module_of_reference(reference: Column, source: Column, depth: int) -> Column:
    """Module of a reference in a source file: a path (resolved against the source's folder if it begins with a dot), or a dotted name; null for others and for short ones."""
    dots, folder = F.split(reference, r"\."), F.slice(_segments(source), 1, F.greatest(F.lit(0), F.size(_segments(source)) - 1))

    def fold(acc: Column, s: Column) -> Column:
        up = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != "..")
        return F.when(s == ".", acc).when((s == "..") & up, F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.array_append(acc, s))

    resolved = F.aggregate(F.concat(folder, _segments(reference)), F.array().cast("array<string>"), fold)
    path = F.when(reference.startswith("."), F.array_join(resolved, "/")).otherwise(reference)
    return F.when(reference.contains("/") | reference.contains("\\"), module_of_path(path, depth)).when(reference.contains(".") & (F.size(dots) >= depth), F.array_join(F.slice(dots, 1, depth), "."))


def title_case(c: Column) -> Column:
    """camelCase to separate words, each with a capital."""
    spaced = F.regexp_replace(c, r"(?<=[a-z])(?=[A-Z])", " ")
    return F.array_join(F.transform(F.split(spaced, r"(?<=\W)(?=\w)"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))), "")


def join_lines(lines: Column, separator: str = "\n", prefix: str = "") -> Column:
    return F.array_join(F.transform(lines, lambda x: F.concat(F.lit(prefix), x)), separator)


def code_block(kind: Column, content: Column) -> Column:
    return F.concat(F.lit("```"), kind, F.lit("\n"), content, F.lit("\n```\n\n"))


def code_block_with_path(path: Column, content: Column) -> Column:
    return F.concat(F.lit("\n``` "), path, F.lit("\n"), js_trim(content), F.lit("\n```\n"))


def summary_bullet(label: Column, purpose: Column, implementation: Column) -> Column:
    none = F.lit("undefined")
    return F.concat(F.lit("* "), label, F.lit(": "), F.coalesce(purpose, none), F.lit(" "), F.coalesce(implementation, none))


def file_timestamp(ts: Column) -> Column:
    """ISO time with - for : and . so that it may be part of a file name."""
    return F.translate(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), ":.", "--")


def redact_url(url: Column) -> Column:
    """User and password of a URL replaced; a fixed word for what isn't a URL."""
    has = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*@")
    parsed = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/\s?#]+)?")
    return F.when(~F.coalesce(parsed, F.lit(False)), F.lit(V.REDACTED_URL)).when(has, F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#]*@", f"$1{V.REDACTED}:{V.REDACTED}@")).otherwise(url)


def mermaid_label(c: Column) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), V.MERMAID_ESCAPES, c)


def mermaid_node(c: Column, index: Column) -> Column:
    return F.concat(F.lower(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9]+", "_"), "^_|_$", "")), F.lit("_"), index.cast("string"))


def table_cell(value: Column, nested: bool = False) -> Column:
    return F.coalesce(F.to_json(value) if nested else value.cast("string"), F.lit(""))


# Levels and labels


def coupling_level(count: Column, most: Column) -> Column:
    share = count / most
    return F.when(most <= 0, V.LOWEST).otherwise(first_match([(share >= x, name) for x, name in V.COUPLING_LEVELS], V.LOWEST))


def debt_level(blocks: Column) -> Column:
    return first_match([(blocks > x, name) for x, name in V.DEBT_LEVELS], V.LOWEST)


def level_class(level: Column, classes: dict[str, str]) -> Column:
    return F.try_element_at(literal_map(classes.items()), level)


def tag_library_class(uri: Column) -> Column:
    return first_match([(uri.contains(p), name) for p, name in V.TAG_LIBRARIES], V.OTHER_TAG_LIBRARY)


def trigger_type(trigger: Column) -> Column:
    """Type of a job's trigger: by known words in order, else what stands before a colon, else the first word without a final , or ; else the whole text; unknown if empty."""
    t = F.lower(js_trim(trigger))
    rest = F.when(t.contains(":"), js_trim(F.substring_index(t, ":", 1))).when(t.contains(" "), F.regexp_replace(js_trim(F.substring_index(t, " ", 1)), "[,;]$", "")).otherwise(t)
    return F.when(t == "", V.UNKNOWN).otherwise(F.coalesce(first_match([(t.contains(w), name) for w, name in V.TRIGGER_WORDS]), rest))


def smell_advice(smell: Column) -> Column:
    return first_match([(F.lower(smell).contains(w), advice) for w, advice in V.SMELL_ADVICE], V.SMELL_ADVICE_OTHERWISE)


def scriptlet_advice(total: Column, average: Column) -> Column:
    (low, first), (moderate, second), (_, third) = V.SCRIPTLET_ADVICE
    return F.when(total == 0, V.NO_SCRIPTLETS).when(average < low, F.format_string(first, average)).when(average < moderate, F.format_string(second, average)).otherwise(F.format_string(third, average))


# Enumerations, defaults and numbers


def normalise_enum(c: Column, values: Iterable[str]) -> Column:
    """Upper case; INVALID unless known. Null stays null."""
    return F.when(c.isNull(), None).when(F.upper(c).isin(*values), F.upper(c)).otherwise(V.INVALID)


def normalise_enums(items: Column, values: Iterable[str]) -> Column:
    """Each element of an array of texts, nulls dropped."""
    values = tuple(values)
    return F.transform(F.filter(items, lambda x: x.isNotNull()), lambda x: F.when(F.upper(x).isin(*values), F.upper(x)).otherwise(V.INVALID))


def first_of(*paths: str) -> Column:
    """The first of several nested fields that isn't null."""
    return F.coalesce(*map(F.col, paths))


def average(total: Column, n: Column) -> Column:
    return F.coalesce(total / F.nullif(n, F.lit(0)), F.lit(0.0))


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(F.lit(100.0) * part / whole + 0.5)).otherwise(0).cast("long")


def slice_path(start: Column, end: Column, radius: float, cx: float, cy: float) -> Column:
    """SVG path of a pie slice between two angles."""
    point = lambda a: F.concat(F.format_string("%.2f", F.lit(cx) + radius * F.cos(a)), F.lit(" "), F.format_string("%.2f", F.lit(cy) + radius * F.sin(a)))
    return F.concat(F.lit(f"M {cx:.2f} {cy:.2f} L "), point(start), F.lit(f" A {radius:.2f} {radius:.2f} 0 "), F.when(end - start > 3.141592653589793, "1").otherwise("0"), F.lit(" 1 "), point(end), F.lit(" Z"))


def slice_colour(index: Column) -> Column:
    """Hues at the golden angle, from the sixteenth slice on."""
    return F.concat(F.lit("hsl("), F.pmod((index - 15) * F.lit(137.5), F.lit(360.0)).cast("string"), F.lit(", 65%, 55%)"))


# Model calls


def estimated_tokens(chars: Column) -> Column:
    return F.floor(chars / V.CHARS_PER_TOKEN).cast("long")


def error_tokens(message: Column, prompt_chars: Column, provider: str, most: Column) -> Column:
    """Token usage that a provider's error message tells: struct(prompt, completion, most). Character limits are scaled to the model's tokens; what the message lacks is estimated."""
    number = lambda p, g: F.regexp_extract(message, p, g).try_cast("long") if g else F.lit(None).cast("long")
    empty = F.struct(F.lit(None).cast("long").alias("prompt"), F.lit(None).cast("long").alias("completion"), F.lit(None).cast("long").alias("most"))
    cases = []
    for pattern, unit, limit, prompt, completion in V.ERROR_PATTERNS[provider]:
        a, b = number(pattern, limit), number(pattern, prompt)
        if unit == "tokens":
            told = F.struct(b.alias("prompt"), F.coalesce(number(pattern, completion), F.lit(0).cast("long")).alias("completion"), F.when(a > 0, a).otherwise(most).alias("most"))
        else:
            scaled = F.greatest(F.ceil(b / a * most).cast("long"), most + 1)
            told = F.when((a > 0) & (b > 0), F.struct(scaled.alias("prompt"), F.lit(0).cast("long").alias("completion"), most.alias("most"))).otherwise(empty)
        cases.append((message.rlike(pattern), told))
    found = first_match(cases, empty)
    limit = F.when(found["most"] > 0, found["most"]).otherwise(most)
    return F.struct(F.coalesce(found["prompt"], F.greatest(estimated_tokens(prompt_chars), limit + 1)).alias("prompt"), F.coalesce(found["completion"], F.lit(0).cast("long")).alias("completion"), limit.alias("most"))


def cropped_length(chars: Column, prompt: Column, completion: Column, most: Column, most_completion: Column) -> Column:
    """Length to which a prompt is cut after an answer that hit a limit."""
    full = (most_completion > 0) & (completion >= most_completion - V.COMPLETION_BUFFER)
    ratio = F.when(full, F.least(most_completion / (completion + 1), F.lit(V.COMPLETION_RATIO))).when(most > 0, F.least(most / (prompt + completion + 1), F.lit(V.PROMPT_RATIO))).otherwise(F.lit(1.0))
    return F.floor(chars * ratio).cast("long")
