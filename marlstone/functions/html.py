"""HTML to text, and redaction of contacts.

Text is made by regular expressions in the JVM: markup becomes break marks or nothing, break marks become line ends, character references
are resolved, white space is put in order.  Only references other than the common ones need Python, and only rows that hold such ones
reach it.
"""

from __future__ import annotations

from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Tags that break lines, tags whose contents are no text, modes and errors.
BLOCK_TAGS = ["p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol"]
SILENT_TAGS = ["script", "style"]
MODES = ["standard", "declared-double-escaped"]
MIXED = "mixed-literal-and-escaped-markup"
UNSUPPORTED = "unsupported-angle-reference"
NESTED = "residual-nested-encoding"
UNCLOSED = "unclosed-script-or-style"
#: References that the JVM resolves; "&amp;" must be the last of them.
PLAIN = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?U)(?<!\w)(\+?\d[\d().\-\s\x{1c}-\x{1f}]{7,}\d)(?!\w)"

# What the steps below use as marks, which is no text in HTML: around the name of a tag, and for a break.
_OPENS, _CLOSES, _BREAK = "\x01", "\x02", "\x03"
_REST = r"""(?:=\s*+"[^"]*"|=\s*+'[^']*'|[^>])*+"""
_SILENT = "|".join(SILENT_TAGS)
_ELEMENT = rf"(?i)<(?:{_SILENT})(?=[\s/>]){_REST}(?<!/)>"
#: One pass over all markup; the name of a block tag is kept, as group 1.
_MARKUP = "(?is)" + "|".join(
    [
        *(rf"<{tag}(?=[\s/>]){_REST}(?<!/)>.*?</{tag}(?=[\s/>])[^>]*>" for tag in SILENT_TAGS),
        r"<!--.*?--!?>",
        r"<[!?][^>]*>",
        r"</(?:>|[^a-z>][^>]*>)",
        rf"</?({'|'.join(BLOCK_TAGS)})(?=[\s/>]){_REST}>",
        rf"<(?:{_SILENT})(?=[\s/>]){_REST}(?<=/)>",
        rf"<(?:/|(?!(?:{_SILENT})[\s/>]))[a-z]{_REST}>",
    ]
)
_NAMED, _CODE = r"&(?:lt|gt|LT|GT)", r"&#0*6[02](?:;|(?=[^0-9])|\z)|&#[xX]0*3[cCeE](?:;|(?=[^0-9A-Fa-f])|\z)"
_OPEN = _NAMED + "(?!;)"
_ESCAPED = _NAMED + ";|" + _CODE


def _lines_ends(x: Column) -> Column:
    return F.regexp_replace(x, "\r\n?", "\n")


def _marked(html: Column) -> Column:
    """Markup as marks: a mark for each block tag, nothing for the rest; an element that is never closed stays."""
    out = F.regexp_replace(F.translate(_lines_ends(html), _OPENS + _CLOSES + _BREAK, ""), _MARKUP, f"{_OPENS}$1{_CLOSES}")
    return F.regexp_replace(F.regexp_replace(out, f"{_OPENS}[a-zA-Z0-9]+{_CLOSES}", _BREAK), _OPENS + _CLOSES, "")


def _resolved(x: Column) -> Column:
    """Character references as characters."""

    @F.arrow_udf("string")
    def in_python(x: pa.Array) -> pa.Array:
        few = [x.slice(i, 64) for i in range(0, max(1, len(x)), 64)]  # texts that are Python objects at one time
        return pa.concat_arrays([pa.array([None if t is None else unescape(t) for t in part.to_pylist()], x.type) for part in few])

    plain = x
    for name, char in PLAIN.items():
        plain = F.replace(plain, F.lit(name), F.lit(char))
    rare = x.rlike("&(?!(?:" + "|".join(n[1:-1] for n in PLAIN) + r");|[\s&<]|\z)")
    return F.when(rare, in_python(F.when(rare, x))).otherwise(plain)


def _laid_out(x: Column) -> Column:
    """Break marks as line ends, unless one is there already; runs of blanks as one, runs of blank lines as one."""
    x = F.regexp_replace(F.regexp_replace(x, rf"(\A|\n){_BREAK}+", "$1"), f"{_BREAK}+", "\n")
    x = F.regexp_replace(F.regexp_replace(_lines_ends(x), "[ \t]+", " "), r"(?<=\A|\n) (?=\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(x, "\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")


def html_to_text(x: Column, mode: str = "standard") -> Column:
    """struct(text, error): one of them is null, both for a null.

    Block tags break lines, contents of scripts and styles are no text, comments and other tags are nothing.  Control characters 1 to 3
    are left out.  In the mode "declared-double-escaped" the text is unescaped once before; what cannot be told apart then is an error.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    error, source = F.lit(None).cast("string"), x
    if mode == MODES[1]:
        source = _resolved(x)
        literal, escaped = x.rlike("[<>]"), x.rlike(_ESCAPED) | x.rlike(_OPEN)
        error = F.when(literal & escaped, MIXED).when(x.rlike(_OPEN) | source.rlike(_OPEN), UNSUPPORTED).when(source.rlike(_ESCAPED), NESTED)
    marked = _marked(source)
    error = F.coalesce(error, F.when(marked.rlike(_ELEMENT), UNCLOSED))
    return F.struct(F.when(error.isNull(), _laid_out(_resolved(marked))).alias("text"), error.alias("error"))


def redact_contacts(x: Column) -> Column:
    """E-mail addresses, then phone numbers, as [REDACTED_EMAIL] and [REDACTED_PHONE]."""
    return F.regexp_replace(F.regexp_replace(x, EMAIL, "[REDACTED_EMAIL]"), PHONE, "[REDACTED_PHONE]")
