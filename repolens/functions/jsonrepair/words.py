"""Fixed values of JSON repair."""

import re

OPENING_QUOTES = '"“„'
CLOSING_QUOTES = "”"
BULLETS = "*•◦▪▸►‣●○-–—+#>"
#: Names of properties that models add by themselves.
ARTIFACT_KEY = re.compile(r"(?i)(?:extra|llm|ai|model|assistant|internal)_\w+|_[a-z_]+|\w*_(?:thoughts?|notes?|reasoning|scratchpad)|\w*(?:thought_?process|inner_?monologue)\w*")
#: What is left of names that lost their quote and a part.
FRAGMENTS = {"n": "name", "na": "name", "nam": "name", "me": "name", "ame": "name", "p": "purpose", "pu": "purpose", "pur": "purpose", "purp": "purpose", "purpos": "purpose", "d": "description", "de": "description", "des": "description", "desc": "description", "t": "type", "ty": "type", "typ": "type", "v": "value", "va": "value", "val": "value", "valu": "value"}
#: Beginnings of sentences that are no data.
FILLER = re.compile(r"(?i)\b(?:I |let me|here is|here's|the following|note that|sorry|continued|to be continued|this (?:is|json)|please)\b")
#: Repairs that leave the data as it is.
INSIGNIFICANT = ("Trimmed white space", "Removed code fences")
#: Bullets of lists in texts.
LIST_BULLETS = "-*•◦▪▸►▹‣⁃○●◆◇■□→➤➢"
SCHEMA_TYPES = ("string", "number", "integer", "boolean", "object", "array", "null")
SCHEMA_WORDS = ("$schema", "additionalProperties", "required", "items", "enum", "allOf", "anyOf", "oneOf", "format", "pattern", "minimum", "maximum", "minLength", "maxLength", "definitions", "$ref", "$id", "const", "default", "title")
