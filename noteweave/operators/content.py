"""Main-content extraction over a page table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.functions import fixed
from noteweave.functions.sqltext import (
    collapse_space,
    fill,
    js_ltrim,
    js_rtrim,
    js_trim,
    literal,
    pack_paragraphs,
    paragraphs_to_markup,
    text_lines,
    utf16_len,
)
from noteweave.operators.elements import BODY_RANK, page_marks


def _gaps(holes: str, first: str, last: str) -> str:
    """SQL: ranges of ``first..last`` left over by sorted, possibly nested, holes."""
    return f"""aggregate({holes},
        named_struct('at', cast({first} AS int), 'gaps', cast(array() AS array<struct<first:int,last:int>>)),
        (acc, hole) -> named_struct(
            'at', greatest(acc.at, hole.end_pos + 1),
            'gaps', if(hole.start_pos > acc.at,
                array_append(acc.gaps, named_struct('first', acc.at, 'last', hole.start_pos - 1)), acc.gaps)),
        acc -> if(acc.at <= {last},
            array_append(acc.gaps, named_struct('first', acc.at, 'last', cast({last} AS int))), acc.gaps))"""


def _slice(array: str, first: str, last: str) -> str:
    """SQL: elements ``first..last`` (0-based); none if the range is empty."""
    return f"slice({array}, cast({first} AS int) + 1, greatest(cast({last} AS int) - cast({first} AS int) + 1, 0))"


def _text_between(holes: str, first: str, last: str) -> str:
    """SQL: visible text of the tokens ``first..last`` outside the holes.

    Works on slices of the token array, so the cost follows the text length and
    not text length times holes.
    """
    inside = f"filter({holes}, h -> h.start_pos BETWEEN {first} AND {last})"
    return f"""array_join(transform({_gaps(inside, first, last)}, gap -> array_join({_slice("shown", "gap.first", "gap.last")}, '')), '')"""


def _shown() -> str:
    """SQL: the token texts with an empty string in place of every token of a removed span.

    ``drops`` are sorted and apart: each gives the texts since the one before, then its blanks.
    """
    before = "if(i = 0, 0, drops[i - 1].end_pos + 1)"
    pieces = f"""transform(drops, (d, i) -> concat({_slice("texts", before, "d.start_pos - 1")},
        array_repeat('', least(d.end_pos, last_pos) - d.start_pos + 1)))"""
    rest = _slice("texts", "element_at(drops, -1).end_pos + 1", "last_pos")
    return f"if(size(drops) = 0, texts, concat(flatten({pieces}), {rest}))"


#: Tokens between two stored running lengths.
STRIDE = 64


def _running(lengths: str) -> str:
    """SQL: the sum of the lengths in front of every STRIDE-th token."""
    return f"""aggregate(sequence(0, size({lengths}) div {STRIDE}), array(0L),
        (acc, k) -> array_append(acc, element_at(acc, -1) + aggregate(slice({lengths}, cast(k AS int) * {STRIDE} + 1, {STRIDE}), 0L, (a, n) -> a + n)))"""


def _length_before(pos: str) -> str:
    """SQL: UTF-16 length of the visible text in front of token ``pos``: a stored sum and the few tokens behind it."""
    at = f"cast({pos} AS int)"
    return f"(running[{at} div {STRIDE}] + aggregate(slice(lengths, cast({at} div {STRIDE} AS int) * {STRIDE} + 1, {at} % {STRIDE}), 0L, (a, n) -> a + n))"


def _measured(spans: str) -> str:
    """SQL: UTF-16 length of the trimmed text of all spans (``start_pos, end_pos``; sorted), one behind the other.

    No text is built: a span's length is the difference of two running lengths.  White space goes from the front of the first span that has
    visible characters and from the end of the last one, spans without any in front of and behind these go as a whole.
    """
    first, last = "greatest(s.start_pos, 0)", "s.end_pos"
    whole = f"{_length_before('s.last + 1')} - {_length_before('s.first')}"
    places = f"transform({spans}, s -> named_struct('first', {first}, 'last', {last}))"
    seen = f"""filter(transform({places}, s -> named_struct('first', s.first, 'last', s.last,
        'from', array_position({_slice("visible", "s.first", "s.last")}, true))), s -> s.from > 0)"""
    begin = "(f.first + f.from - 1)"
    lead = f"{_length_before(begin)} - {_length_before('f.first')} + {utf16_len(f'shown[{begin}]')} - {utf16_len(js_ltrim(f'shown[{begin}]'))}"
    end = f"(l.last - array_position(reverse({_slice('visible', 'l.first', 'l.last')}), true) + 1)"
    trail = f"{_length_before('l.last + 1')} - {_length_before(f'{end} + 1')} + {utf16_len(f'shown[{end}]')} - {utf16_len(js_rtrim(f'shown[{end}]'))}"
    # Blank spans between two visible ones count: those from the first visible span to the last one are added up.
    inside = f"filter({places}, s -> s.first >= v[0].first AND s.first <= element_at(v, -1).first)"
    total = f"aggregate({inside}, 0L, (a, s) -> a + {whole})"
    return f"""aggregate(array({seen}), 0L, (acc, v) -> if(size(v) = 0, 0L, {total}
        - element_at(transform(slice(v, 1, 1), f -> {lead}), 1) - element_at(transform(slice(v, -1, 1), l -> {trail}), 1)))"""


def _begin_near(pos: str) -> str:
    """SQL: where the first visible character from token ``pos`` to the end of its stride begins, in UTF-16 units from the start; null if none is."""
    found = f"array_position(slice(visible, {pos} + 1, {STRIDE} - {pos} % {STRIDE}), true)"
    places = f"transform(filter(array(cast({found} AS int)), n -> n > 0), n -> {pos} + n - 1)"
    return f"get(transform({places}, v -> {_length_before('v')} + leads[v]), 0)"


def _end_near(pos: str) -> str:
    """SQL: where the last visible character from the start of token ``pos``'s stride to that token ends; null if none is."""
    base = f"cast({pos} div {STRIDE} AS int) * {STRIDE}"
    found = f"array_position(reverse(slice(visible, {base} + 1, {pos} - {base} + 1)), true)"
    places = f"transform(filter(array(cast({found} AS int)), n -> n > 0), n -> {pos} - n + 1)"
    return f"get(transform({places}, v -> {_length_before('v + 1')} - trails[v]), 0)"


def with_visible_ends(texts: DataFrame) -> DataFrame:
    """Add what ``_trimmed`` looks up: white space at both ends of each token (all of it one UTF-16 unit a character), and for every stride
    of tokens where the next visible character begins in it or behind it (``begins``) and where the last one in front of it ends (``ends``).
    """
    count = f"cast(size(visible) div {STRIDE} AS int)"
    begins = f"transform(sequence(0, {count}), k -> {_begin_near(f'(k * {STRIDE})')})"
    ends = f"transform(sequence(0, {count}), k -> {_end_near(f'least(k * {STRIDE} + {STRIDE - 1}, last_pos)')})"
    edges = texts.selectExpr(
        "*",
        f"transform(shown, t -> length(t) - length({js_ltrim('t')})) AS leads",
        f"transform(shown, t -> length(t) - length({js_rtrim('t')})) AS trails",
    )
    return edges.selectExpr(
        "*",
        f"aggregate(reverse({begins}), array(element_at(running, -1)), (acc, x) -> array_prepend(acc, coalesce(x, acc[0]))) AS begins",
        f"aggregate({ends}, array(0L), (acc, x) -> array_append(acc, coalesce(x, element_at(acc, -1)))) AS ends",
    )


def _trimmed(first: str, last: str) -> str:
    """SQL: UTF-16 length of the trimmed text of the tokens ``first..last``, from their first visible character to their last one.

    Both are found in the token's own stride or in what is stored for its neighbours, so the cost does not follow the span.
    """
    begin = f"coalesce({_begin_near(first)}, get(begins, cast({first} div {STRIDE} AS int) + 1))"
    end = f"coalesce({_end_near(last)}, get(ends, cast({last} div {STRIDE} AS int)))"
    return f"greatest({end} - {begin}, 0L)"


def page_texts(
    pages: DataFrame,
    key: str,
    html_col: str = "html",
    rendered: bool = False,
    blocks: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Each page's token texts with its structural marks.

    A page is split into tokens once; its texts, a fraction of the markup, and the columns named in ``keep`` travel with
    its events.  A parser gives every document a body, so one is added where the tag is missing.
    ``shown`` are the texts without those of removed elements; beside it stand the lengths of its tokens, which tokens
    have more than white space, and running lengths, from which spans are measured.
    """
    also = tuple(fixed.LONGEST_BLOCK_TAGS) if blocks else ()
    marks = page_marks(pages, key, html_col, also, True, rendered, keep)
    spans = "cast(array() AS array<struct<start_pos:int,end_pos:int>>)"
    candidates = "cast(array() AS array<struct<start_pos:int,end_pos:int,ranks:array<int>>>)"
    body = f"named_struct('start_pos', -1, 'end_pos', size(texts) - 1, 'ranks', array({BODY_RANK}))"
    joined = marks.selectExpr(
        key,
        *keep,
        "texts",
        "size(texts) - 1 AS last_pos",
        *[f"coalesce({name}, {spans}) AS {name}" for name in ("drops", "inners", "blocks")],
        f"if(coalesce(has_body, false), candidates, array_prepend(coalesce(candidates, {candidates}), {body})) AS candidates",
    )
    shown = joined.selectExpr(key, *keep, f"{_shown()} AS shown", "last_pos", "inners", "blocks", "candidates")
    lengths, visible = f"transform(shown, t -> {utf16_len('t')})", f"transform(shown, t -> {js_trim('t')} <> '')"
    return shown.selectExpr("*", f"{lengths} AS lengths", f"{visible} AS visible").selectExpr("*", f"{_running('lengths')} AS running")


def stripped_text(pages: DataFrame, key: str, html_col: str = "html") -> DataFrame:
    """Text of each page after the page-level removals."""
    return page_texts(pages, key, html_col).selectExpr(key, "array_join(shown, '') AS text")


def pick_content(texts: DataFrame, rendered: bool = False) -> DataFrame:
    """Add ``pick``: rank, span and text length of the chosen element.

    Per rank the length test takes the text of all matches (only of the first
    one for rendered pages); the element kept is the first match.
    """
    ranks = "array_sort(array_distinct(flatten(transform(candidates, c -> c.ranks))))"
    matches = "filter(candidates, c -> array_contains(c.ranks, rank))"
    if rendered:
        text = f"array_join({_slice('shown', f'greatest({matches}[0].start_pos, 0)', f'{matches}[0].end_pos')}, '')"
        chars = utf16_len(js_trim(collapse_space(text)))
    else:
        chars = _measured(matches)
    # A fold, so that later ranks are not measured once one qualifies.
    state = "struct<rank:int,start_pos:int,end_pos:int,chars:bigint>"
    enter = f"named_struct('rank', rank, 'start_pos', {matches}[0].start_pos, 'end_pos', {matches}[0].end_pos, 'chars', cast({chars} AS bigint))"
    fold = f"""aggregate({ranks}, cast(NULL AS {state}),
        (acc, rank) -> if(acc.chars > {fixed.MIN_CANDIDATE_CHARS}, acc, {enter}))"""
    folded = texts.selectExpr("*", f"{fold} AS _last")
    pick = f"if(_last.chars > {fixed.MIN_CANDIDATE_CHARS}, _last, NULL)"
    if rendered:
        # Rendered pages fall back to the body text, whatever its length.
        pick = f"coalesce({pick}, named_struct('rank', {BODY_RANK}, 'start_pos', 0, 'end_pos', last_pos, 'chars', 0L))"
    return folded.selectExpr("*", f"{pick} AS pick").drop("_last")


def longest_block(pages: DataFrame, key: str, html_col: str = "html") -> DataFrame:
    """Longest block element per page with more than the minimum text.

    The first of equally long blocks wins.  In the full extraction this stage
    can never find what ``body`` did not, because no block is longer than the
    body around it, so the extraction job does not run it.
    """
    chars = f"cast({_trimmed('b.start_pos', 'least(b.end_pos, last_pos)')} AS int)"
    measured = f"""transform(blocks, b ->
        named_struct('chars', {chars}, 'place', -b.start_pos, 'end_pos', b.end_pos))"""
    texts = with_visible_ends(page_texts(pages, key, html_col, blocks=True))
    # Too short ones go here: a filter on the result would be moved in front of the steps above, and these into it, once for every block and look-up.
    best = texts.selectExpr(key, f"inline(filter(array(array_max({measured})), best -> best.chars > {fixed.MIN_CANDIDATE_CHARS}))")
    return best.selectExpr(key, "-place AS start_pos", "end_pos", "chars")


def article_text(
    pages: DataFrame, key: str, html_col: str = "html", rendered: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``key, rank, text, chars``: raw text of the chosen element after inner clean-up."""
    picked = pick_content(page_texts(pages, key, html_col, rendered, keep=keep), rendered)
    # Inner rules take descendants of the chosen element, never the element itself.
    below = "filter(inners, h -> h.start_pos > pick.start_pos AND h.start_pos <= pick.end_pos)"
    span = "greatest(pick.start_pos, 0)", "pick.end_pos"
    whole = f"array_join({_slice('shown', *span)}, '')"
    text = whole if rendered else f"if(size({below}) = 0, {whole}, {_text_between(below, *span)})"
    chosen = picked.selectExpr(key, *keep, "pick.rank AS rank", f"if(pick IS NULL, NULL, {text}) AS text")
    seen = collapse_space("text") if rendered else "text"  # visible text shows white space once
    return chosen.selectExpr(key, *keep, "rank", "text", f"{utf16_len(js_trim(seen))} AS chars")


def extract(
    pages: DataFrame,
    key: str,
    url_col: str = "url",
    html_col: str = "html",
    rendered: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``key, url, content, status`` (and ``keep``): the markup fragment of each page.

    ``status`` is ``ok``, ``ok_empty`` (text but no line long enough),
    ``too_short`` or ``none_found``.
    """
    keep = ((url_col,) if key != url_col else ()) + keep
    places = {"url": url_col, "suffix": literal(fixed.RENDERED_SUFFIX if rendered else "")}
    markup = paragraphs_to_markup(pack_paragraphs(text_lines("text")))
    marked = article_text(pages, key, html_col, rendered, keep).selectExpr(
        key, *keep, "rank", f"if(chars >= {fixed.MIN_CONTENT_CHARS}, {markup}, NULL) AS markup"
    )
    return marked.select(
        key,
        *keep,
        F.expr(
            f"""CASE WHEN markup IS NULL THEN {fill(fixed.TEXT_NOT_EXTRACTED, **places)}
                WHEN markup = '' THEN {fill(fixed.TEXT_NO_LINES, **places)} ELSE markup END AS content"""
        ),
        F.expr(
            """CASE WHEN rank IS NULL THEN 'none_found' WHEN markup IS NULL THEN 'too_short'
                WHEN markup = '' THEN 'ok_empty' ELSE 'ok' END AS status"""
        ),
    )
