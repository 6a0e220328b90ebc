"""How models break JSON, a text and its repaired data for each kind of damage. %d stands for a number. The kinds are those of the repair catalogue, by its families; texts and data are this repository's own."""

from __future__ import annotations

#: (kind, broken text, repaired JSON)
FORMS: list[tuple[str, str, str]] = [
    # arrays
    ("quote missing before a dotted element", '{"n": %d, "a": [\n  "x.y.A",\n  x.y.B",\n  "x.y.C"\n]}', '{"n": %d, "a": ["x.y.A", "x.y.B", "x.y.C"]}'),
    ("quote missing before a capital", '{"n": %d, "a": [\n  "First",\n  Second",\n  "Third"\n]}', '{"n": %d, "a": ["First", "Second", "Third"]}'),
    ("minus before an element", '{"n": %d, "a": [\n  -"x",\n  "y"\n]}', '{"n": %d, "a": ["x", "y"]}'),
    ("asterisk before an element", '{"n": %d, "a": [\n  *   "x.A",\n  *   "x.B"\n]}', '{"n": %d, "a": ["x.A", "x.B"]}'),
    ("stray character after an element", '{"n": %d, "a": ["x">, "y"]}', '{"n": %d, "a": ["x", "y"]}'),
    ("stray word after an element", '{"n": %d, "a": ["x" garbage, "y"]}', '{"n": %d, "a": ["x", "y"]}'),
    ("library name after an element", '{"n": %d, "a": [\n  "net.Pump",WATERWORKS-KIT-0.9.4.JAR"\n  "net.Valve"\n]}', '{"n": %d, "a": ["net.Pump", "net.Valve"]}'),
    ("comma and quote missing at a line end", '{"n": %d, "a": [\n  "x.One",\n  x.Two"\n]}', '{"n": %d, "a": ["x.One", "x.Two"]}'),
    ("comma missing between elements", '{"n": %d, "a": [\n  "x"\n  "y"\n]}', '{"n": %d, "a": ["x", "y"]}'),
    ("stray text after an inner closer", '{"n": %d, "a": [{"b": 1}stray, {"b": 2}]}', '{"n": %d, "a": [{"b": 1}, {"b": 2}]}'),
    ("other script before an element", '{"n": %d, "a": [\n  "java.util.List",\n  করে"java.util.Map"\n]}', '{"n": %d, "a": ["java.util.List", "java.util.Map"]}'),
    ("assignment in an array", '{"n": %d, "a": [\n  "x",\n  _DOC_NOTE_LIST_ = "some",\n  "y"\n]}', '{"n": %d, "a": ["x", "y"]}'),
    ("stop before an element", '{"n": %d, "a": [\n  "x",\n  stop"y"\n]}', '{"n": %d, "a": ["x", "y"]}'),
    ("letter before an element on a line", '{"n": %d, "a": [\n  "org.x.A",\n  e    "org.x.B"\n]}', '{"n": %d, "a": ["org.x.A", "org.x.B"]}'),
    # stray characters
    ("letter before a property", '{"n": %d,\n a  "b": 1}', '{"n": %d, "b": 1}'),
    ("words before a property", '{"n": %d,\n running on a different machine "b": 1}', '{"n": %d, "b": 1}'),
    ("letter against an element", '{"n": %d, "a": ["x", e"y"]}', '{"n": %d, "a": ["x", "y"]}'),
    ("letter against a property", '{"n": %d, y"b": 1}', '{"n": %d, "b": 1}'),
    ("letter against the first property", '{y"n": %d, "b": 1}', '{"n": %d, "b": 1}'),
    ("syllable against an element", '{"n": %d, "a": ["x", stray"y"]}', '{"n": %d, "a": ["x", "y"]}'),
    ("bullet before a property", '{"n": %d,\n • "b": 1,\n → "c": 2}', '{"n": %d, "b": 1, "c": 2}'),
    ("syllable after an object", '{"a": [{"b": 1},ce\n {"b": 2}], "n": %d}', '{"a": [{"b": 1}, {"b": 2}], "n": %d}'),
    ("text after the last brace", '{"n": %d}tribal-assistant-v1-final-answer', '{"n": %d}'),
    ("placeholder between properties", '{"n": %d,\n _SOME_PLACEHOLDER_TEXT_\n "b": 1}', '{"n": %d, "b": 1}'),
    ("triple quotes after the end", '{"n": %d}\n"""', '{"n": %d}'),
    ("corrupt constant in an array", '{"n": %d, "a": [\n  "x",\n  _MODULE",\n  "y"\n]}', '{"n": %d, "a": ["x", "_MODULE", "y"]}'),
    ("letter before a brace", '{"a": [{"b": 1}, c{"b": 2}], "n": %d}', '{"a": [{"b": 1}, {"b": 2}], "n": %d}'),
    # artifacts
    ("binary marker before a name", '{"n": %d,\n <x_bin_151>b": 1}', '{"n": %d, "b": 1}'),
    # Fixed value: the words of the warning.
    ("warning of generated content", '{"n": %d,\nAI-generated content. Review and use carefully.\n"b": 1}', '{"n": %d, "b": 1}'),
    ("explanation between objects", '{"a": [{"b": []\n},\nthe remaining ones are left out for brevity\n{"b": [1]}], "n": %d}', '{"a": [{"b": []}, {"b": [1]}], "n": %d}'),
    # metadata
    ("extra text before a property", '{"n": %d,\n extra_text="  "b": [1]}', '{"n": %d, "b": [1]}'),
    ("extra text as an assignment", '{"n": %d,\n extra_text="some words",\n "b": 1}', '{"n": %d, "b": 1}'),
    ("extra property after an array", '{"n": %d, "a": [1]\n extra_text: "some",\n "b": 1}', '{"n": %d, "a": [1], "b": 1}'),
    ("thoughts in a line", '{"n": %d,\nextra_thoughts: I have found all of them\n"b": 1}', '{"n": %d, "b": 1}'),
    ("extra text in a line", '{"n": %d,\nextra_text= some text\n"b": 1}', '{"n": %d, "b": 1}'),
    ("extra property block", '{"n": %d,\nextra_code_analysis: {"x": [1, {"y": 2}]},\n"b": 1}', '{"n": %d, "b": 1}'),
    ("artifact block of a model", '{n: %d,\n"_llm_notes": {"x": 1},\n"b": 1}', '{"n": %d, "b": 1}'),
    ("artifact property by its name", '{n: %d, "extra_reasoning": "because", "b": 1}', '{"n": %d, "b": 1}'),
    # commentary
    ("word in a line", '{"n": %d, "a": [1],\ntrib\n"b": 1}', '{"n": %d, "a": [1], "b": 1}'),
    ("sentence before a property", '{"n": %d, "a": [1],\nthere are more methods, but these will do.\n"b": 1}', '{"n": %d, "a": [1], "b": 1}'),
    ("sentence before an object", '{"n": %d, "a": [{"b": 1},\nthis is some text between the two\n{"b": 2}]}', '{"n": %d, "a": [{"b": 1}, {"b": 2}]}'),
    ("setting before a property", '{"n": %d,\npost_max_size = 20M    "b": 1}', '{"n": %d, "b": 1}'),
    ("line comment", '{"n": %d, // note\n "b": 1}', '{"n": %d, "b": 1}'),
    ("block comment", '{"n": %d, /* note */ "b": 1}', '{"n": %d, "b": 1}'),
    ("hash comment", '{"n": %d,\n# note of the model\n"b": 1}', '{"n": %d, "b": 1}'),
    ("markup comment after a value", '{"n": %d, "b": "X" <!-- c -->, "p": ["a"]}', '{"n": %d, "b": "X", "p": ["a"]}'),
    ("markup comment in a line", '{"n": %d,\n<!-- more -->\n"b": 1}', '{"n": %d, "b": 1}'),
    # damaged strings
    ("properties leaked into a string", '{"n": %d, "b": "0\\",\n \\"c\\": \\"String"}', '{"n": %d, "b": "0"}'),
    ("instruction after the end", '{"n": %d}\n[instruction]Now sum up what the second chapter says', '{"n": %d}'),
    ("string cut off", '{"n": %d, "b": "some text that is', '{"n": %d, "b": "some text that is"}'),
    ("line end in a string", '{"n": %d, "b": "one\ntwo"}', '{"n": %d, "b": "one\\ntwo"}'),
    ("quotes within a string", '{"n": %d, "b": "the "best" one"}', '{"n": %d, "b": "the \\"best\\" one"}'),
    ("bad escape", '{"n": %d, "b": "C:\\dir"}', '{"n": %d, "b": "C:\\\\dir"}'),
    # YAML
    ("list in YAML", '{"n": %d,\nsome-key:\n  - item1\n  - item2\n"b": 1}', '{"n": %d, "b": 1}'),
    ("value in YAML", '{"n": %d,\nnote-text: all of them are here\n"b": 1}', '{"n": %d, "b": 1}'),
    # assignments
    ("stray name after a colon", '{"n": %d, "b":stray": "value"}', '{"n": %d, "b": "value"}'),
    ("assignment for a colon", '{"n": %d, "b":= "x"}', '{"n": %d, "b": "x"}'),
    ("equals sign for a colon", '{"n": %d, "b" = "x"}', '{"n": %d, "b": "x"}'),
    ("arrow for a colon", '{"n": %d, "b" => "x"}', '{"n": %d, "b": "x"}'),
    ("minus after a colon", '{"n": %d, "b":- "x"}', '{"n": %d, "b": "x"}'),
    ("stray text after a colon", '{"n": %d, "b": stray": "value"}', '{"n": %d, "b": "value"}'),
    ("quote missing before a value", '{"n": %d, "b": value",\n "c": 1}', '{"n": %d, "b": "value", "c": 1}'),
    ("value without quotes", '{"n": %d, "b": value,\n "c": 1}', '{"n": %d, "b": "value", "c": 1}'),
    ("stray text after a value", '{"n": %d, "b": "value" oops,\n "c": 1}', '{"n": %d, "b": "value", "c": 1}'),
    # names
    ("name with extra text", '{"n": %d, "b":extra_text": 1, "c": 2}', '{"n": %d, "b": 1, "c": 2}'),
    ("name without quotes", '{n: %d, b: {"c": 1}}', '{"n": %d, "b": {"c": 1}}'),
    ("name without its first quote", '{"n": %d, b": 1}', '{"n": %d, "b": 1}'),
    ("name without its last quote", '{"n": %d, "b: 1}', '{"n": %d, "b": 1}'),
    ("space before a name's last quote", '{"n": %d, "b ": 1}', '{"n": %d, "b ": 1}'),
    ("colon within the quotes", '{"n": %d, "b:" 1}', '{"n": %d, "b": 1}'),
    ("colon missing", '{"n": %d, "b" "x"}', '{"n": %d, "b": "x"}'),
    ("colon missing before a number", '{"b" 1, "n": %d}', '{"b": 1, "n": %d}'),
    ("name twice", '{"n": %d, "b": "b": 1}', '{"n": %d, "b": 1}'),
    ("backtick before the colon", '{"n": %d, "b`: 1}', '{"n": %d, "b": 1}'),
    ("name in single quotes", "{'n': %d, 'b': 'x'}", '{"n": %d, "b": "x"}'),
    ("name in curly quotes", '{“n”: %d, “b”: “x”}', '{"n": %d, "b": "x"}'),
    ("other script before a name", '{"n": %d,\n করে"b": 1}', '{"n": %d, "b": 1}'),
    ("dash before a name", '{"n": %d,\n - "b": 1}', '{"n": %d, "b": 1}'),
    # structure
    ("closing braces twice", '{"n": %d, "b": {"c": 1}}}}', '{"n": %d, "b": {"c": 1}}'),
    ("closing brackets twice", '{"n": %d, "a": [1, 2]], "b": 1}', '{"n": %d, "a": [1, 2], "b": 1}'),
    ("bracket for a brace", '{"n": %d, "b": {"c": 1]}', '{"n": %d, "b": {"c": 1}}'),
    ("brace for a bracket", '{"n": %d, "a": [1, 2}}', '{"n": %d, "a": [1, 2]}'),
    ("dash after a comma", '{"n": %d,-\n "b": 1}', '{"n": %d, "b": 1}'),
    ("letter in a line", '{"n": %d,\nx\n"b": 1}', '{"n": %d, "b": 1}'),
    ("letter before a closing brace", '{"a": {"b": 1\nx}, "n": %d}', '{"a": {"b": 1}, "n": %d}'),
    ("array in a string's place", '{"n": %d, "a": "["x", "y"]"}', '{"n": %d, "a": ["x", "y"]}'),
    ("text around the object", 'Here it is: {"n": %d, "b": 1} I hope that it helps.', '{"n": %d, "b": 1}'),
    ("code fences", '```json\n{"n": %d}\n```', '{"n": %d}'),
    ("underscore after a value", '{"n": %d, "b": "x"_,\n "c": 1}', '{"n": %d, "b": "x", "c": 1}'),
    ("text after an opening brace", '{"a": {so "b": 1}, "n": %d}', '{"a": {"b": 1}, "n": %d}'),
    ("ellipsis for what is left out", '{"n": %d, "a": ["x", "y", ...]}', '{"n": %d, "a": ["x", "y"]}'),
    ("comma twice after an array", '{"a": [1],, "n": %d}', '{"a": [1], "n": %d}'),
    ("comma missing after an array", '{"a": [1]\n "n": %d}', '{"a": [1], "n": %d}'),
    ("trailing comma", '{"n": %d, "a": [1, 2,],}', '{"n": %d, "a": [1, 2]}'),
    ("value missing", '{"n": %d, "b": , "c": 1}', '{"n": %d, "b": null, "c": 1}'),
    ("brackets missing at the end", '{"n": %d, "a": [{"b": [1', '{"n": %d, "a": [{"b": [1]}]}'),
    ("brace missing between objects", '{"n": %d, "a": [{"b": 1, {"b": 2}]}', '{"n": %d, "a": [{"b": 1}, {"b": 2}]}'),
    ("object twice", '{"n": %d}{"n": %d}', '{"n": %d}'),
    ("literals of other languages", '{"n": %d, "b": True, "c": None, "d": undefined}', '{"n": %d, "b": true, "c": null, "d": null}'),
    ("concatenated strings", '{"n": %d, "b": "one" + "two"}', '{"n": %d, "b": "onetwo"}'),
]
