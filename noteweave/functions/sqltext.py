"""Array expressions as Spark SQL text.

Nested lambdas read better as SQL than as Python calls, and a large expression
reaches the JVM in one piece.  Functions take and return SQL text; callers wrap
the result in ``expr``.
"""

from __future__ import annotations

from noteweave.functions import fixed

# The whitespace set of JavaScript strings; Java's \s alone is ASCII only.
_WIDE = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
SPACES = " \t\n\x0b\f\r" + "".join(map(chr, _WIDE))
_SET = r"[\t-\r " + "".join(rf"\x{{{code:x}}}" for code in _WIDE) + "]"
# The intersections answer for plain letters after one range test.
SPACE = rf"[\t-\r \x{{a0}}-\x{{feff}}&&{_SET}]"
# Runs that a collapse to one space would change; single plain spaces are not matched.
SPACE_RUN = rf"[\t-\r\x{{a0}}-\x{{feff}}&&{_SET}]{SPACE}*+| {SPACE}++"


def literal(text: str) -> str:
    """SQL string literal; what is not printable ASCII or a letter goes in as an escape."""
    plain = text.replace("\\", "\\\\").replace("'", "\\'")
    return "'" + "".join(c if c.isprintable() else f"\\u{ord(c):04x}" for c in plain) + "'"


def literals(values) -> str:
    return ", ".join(literal(v) for v in values)


def fill(template: str, **places: str) -> str:
    """Concatenation of a literal template with SQL in its ``{name}`` places."""
    parts, rest = [], template
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(literal(head))
        if not brace:
            break
        name, _, rest = tail.partition("}")
        parts.append(places[name])
    return f"concat({', '.join(parts)})"


def utf16_len(x: str) -> str:
    """Length in UTF-16 units (``length`` counts code points)."""
    return f"cast(octet_length(encode({x}, 'UTF-16BE')) div 2 AS int)"


def js_trim(x: str) -> str:
    return f"btrim({x}, {literal(SPACES)})"


def js_ltrim(x: str) -> str:
    return f"ltrim({literal(SPACES)}, {x})"


def js_rtrim(x: str) -> str:
    return f"rtrim({literal(SPACES)}, {x})"


def collapse_space(x: str) -> str:
    """Every run of whitespace becomes one space."""
    return f"regexp_replace({x}, {literal(SPACE_RUN)}, ' ')"


def escape_markup(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def text_lines(x: str) -> str:
    """Sentences of a text, trimmed, short ones dropped.

    After the collapse a plain space is the only whitespace left to trim.
    """
    sentences = f"transform(split({collapse_space(x)}, {literal(fixed.SENTENCE_END)}), s -> trim(s))"
    return f"filter({sentences}, s -> {utf16_len('s')} > {fixed.MIN_LINE_CHARS})"


def pack_paragraphs(lines: str) -> str:
    """Greedy packing of lines into paragraphs.

    Each line gets its sentence end back and joins the open paragraph.  The
    paragraph closes once it is long enough or the line holds a mark; what is
    open at the end is kept too.  The reset makes this a fold, which no window
    frame can express.
    """
    grown = f"concat(acc.open, line, {literal(fixed.SENTENCE_END)})"
    marked = " OR ".join(f"contains(line, {literal(mark)})" for mark in fixed.PARAGRAPH_MARKS)
    closes = f"({utf16_len(grown)} > {fixed.PARAGRAPH_CHARS} OR {marked})"
    return f"""aggregate({lines},
        named_struct('done', cast(array() AS array<string>), 'open', ''),
        (acc, line) -> named_struct(
            'done', if({closes}, array_append(acc.done, {grown}), acc.done),
            'open', if({closes}, '', {grown})),
        acc -> if(acc.open <> '', array_append(acc.done, acc.open), acc.done))"""


def paragraphs_to_markup(paragraphs: str) -> str:
    """``<p>`` line per paragraph; an empty string for no paragraphs."""
    return f"array_join(transform({paragraphs}, p -> concat('<p>', {escape_markup('p')}, '</p>\\n')), '')"
