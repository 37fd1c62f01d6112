"""Page structure as tables: tokens, tag events, element spans, per-page marks.

Only the few tag tokens that can matter for clean-up or selection leave the page
row.  They are shuffled once by the page key, and every window below partitions
by that key (plus finer columns), so no further exchange is needed.  Page text
itself is never exploded or sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.functions import fixed, html
from noteweave.functions.html import TAG_NAME, attribute, class_names, tag_name, token_kind
from noteweave.functions.sqltext import literal, literals

BODY_RANK = len(fixed.CONTENT_SELECTORS)
# Tags that matter by name alone.
NAMED_TAGS = sorted(
    {tag for tag in fixed.DROP_TAGS if tag not in ("script", "style")} | {"article", "main", "body"}
)


def html_tokens(pages: DataFrame, key: str, html_col: str = "html") -> DataFrame:
    """One row per token of each page: ``key, pos, kind, tag, token``."""
    exploded = pages.select(key, F.posexplode_outer(html.tokens(F.col(html_col))).alias("pos", "token"))
    exploded = exploded.where("pos IS NOT NULL")
    kind = token_kind(F.col("token"))
    return exploded.select(
        key,
        "pos",
        kind.alias("kind"),
        F.when(kind.isin("open", "close"), tag_name(F.col("token"))).alias("tag"),
        "token",
    )


def _split_selector(selector: str) -> tuple[bool, str]:
    scope, _, simple = selector.rpartition(" ")
    return bool(scope), simple


def _matches(simple: str) -> str:
    """SQL condition for one simple selector over the tag event columns."""
    if simple.startswith("."):
        return f"array_contains(classes, {literal(simple[1:])})"
    if simple.startswith("#"):
        return f"_id = {literal(simple[1:])}"
    if simple.startswith("["):
        name, _, value = simple.strip("[]").partition("=")
        return f"_{name} = {literal(value.strip(chr(34)))}"
    return f"tag = {literal(simple)}"


def _ranks(scoped: bool) -> str:
    """SQL: ranks of the selectors an element matches (article-scoped ones or the rest)."""
    hits = ", ".join(
        f"if({_matches(simple)}, {rank}, NULL)"
        for rank, (needs_article, simple) in enumerate(map(_split_selector, fixed.CONTENT_SELECTORS), 1)
        if needs_article == scoped
    )
    return f"if(opens, array_compact(array({hits})), cast(array() AS array<int>))"


def _rule(tags: list[str], classes: list[str]) -> str:
    """SQL: start tag that matches a removal rule."""
    return f"opens AND (tag IN ({literals(tags)}) OR arrays_overlap(classes, array({literals(classes)})))"


def _hinted(token: str) -> str:
    """SQL: cheap superset test for start tags whose class, id or role could match a rule."""
    words = {simple.strip(".#") for _, simple in map(_split_selector, fixed.CONTENT_SELECTORS) if simple[0] in ".#"}
    words |= {"main"} | set(fixed.DROP_CLASSES) | set(fixed.INNER_DROP_CLASSES)
    has_attribute = r"(?i)^<(?!script|style|title)[a-z][^\s/>]*[\s/][\s\S]*?(?:class|id|role)\s*="
    has_word = r"[\s\"'=](?:" + "|".join(sorted(words)) + r")[\s\"'/>]"
    return f"regexp_like({token}, {literal(has_attribute)}) AND regexp_like({token}, {literal(has_word)})"


#: Position of the row that carries a page's texts along with its events.
TEXT_POS = -1


def tag_events(
    pages: DataFrame, key: str, html_col: str = "html", also: tuple[str, ...] = (), texts: bool = False, rendered: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Start and end tags that can matter, with their rule matches.

    The rows are hashed by ``key`` here, so that all windows that follow share
    this one exchange.  With ``texts``, one more row of each page, at TEXT_POS, carries the texts of its tokens (``texts``) and the columns
    ``keep``, so a page is split into tokens once and its parts need no join.

    Kept are tags that matter by name, tags named in ``also``, and all tags whose
    name carries a possibly matching attribute somewhere on the page (their end
    tags and same-named neighbours are needed for pairing), with the tags that end those without an end tag.
    """
    hinted = f"""array_distinct(transform(filter(tokens, t -> startswith(t, '<') AND {_hinted("t")}),
        t -> lower(regexp_extract(t, {literal(TAG_NAME)}, 1))))"""
    enders = ", ".join(
        f"if(arrays_overlap(hinted, array({literals(group[0])})), array({literals(_companions(group[0]))}), cast(array() AS array<string>))" for group in fixed.IMPLIED_ENDS
    )
    per_page = pages.select(key, *keep, html.tokens(F.col(html_col)).alias("tokens")).selectExpr(
        key, *keep, "tokens", f"{hinted} AS hinted", "size(tokens) - 1 AS last_pos"
    )
    per_page = per_page.selectExpr(key, *keep, "tokens", f"if(size(hinted) > 0, concat(hinted, {enders}), hinted) AS hinted", "last_pos")
    named = rf"(?i)^</?(?:{'|'.join([*NAMED_TAGS, *also, *_companions(list(also))])})[\s/>]"
    name = lambda token: f"lower(regexp_extract({token}, {literal(TAG_NAME)}, 1))"
    matters = f"""startswith(x.token, '<') AND (regexp_like(x.token, {literal(named)})
        OR (size(hinted) > 0 AND array_contains(hinted, {name("x.token")})))"""
    entries = f"filter(transform(tokens, (t, i) -> named_struct('pos', i, 'token', t)), x -> {matters})"
    if texts:
        page = f"array(named_struct('pos', {TEXT_POS}, 'token', cast(NULL AS string), 'texts', {html.token_texts('tokens', rendered)}))"
        empty = "cast(NULL AS array<string>)"
        entries = f"concat({page}, coalesce(transform({entries}, x -> named_struct('pos', x.pos, 'token', x.token, 'texts', {empty})), array()))"
    exploded = per_page.selectExpr(key, *keep, "last_pos", f"explode({entries}) AS entry")
    events = exploded.selectExpr(
        key, *keep, "last_pos", "entry.pos", "entry.token", f"{name('entry.token')} AS tag", "NOT startswith(entry.token, '</') AS opens", *(["entry.texts"] if texts else [])
    )
    carried = (*keep, "texts") if texts else keep
    with_attributes = events.select(
        key,
        *carried,
        "pos",
        "last_pos",
        "tag",
        "opens",
        F.when(F.col("opens"), class_names(F.col("token"))).alias("classes"),
        F.when(F.col("opens"), attribute(F.col("token"), "id")).alias("_id"),
        F.when(F.col("opens"), attribute(F.col("token"), "role")).alias("_role"),
    )
    return with_attributes.selectExpr(
        key,
        *carried,
        "pos",
        "last_pos",
        "tag",
        "opens",
        f"{_rule(fixed.DROP_TAGS, fixed.DROP_CLASSES)} AS dropped",
        f"{_rule(fixed.INNER_DROP_TAGS, fixed.INNER_DROP_CLASSES)} AS inner_drop",
        f"{_ranks(scoped=False)} AS ranks",
        f"{_ranks(scoped=True)} AS scoped_ranks",
    ).repartition(key)


def _family(number: int) -> str:
    return f"'{fixed.IMPLIED_ENDS[number][0][0]}'"


def _companions(names: list[str]) -> list[str]:
    """Tags that end an element of these names without its end tag."""
    return sorted({tag for group in fixed.IMPLIED_ENDS if set(group[0]) & set(names) for part in group for tag in part})


def _roles() -> str:
    """SQL: the groups in which a tag opens or ends elements, as structs of group, level and whether it is the group's own element.

    Elements of a group are told apart by how many of the elements around them are open.
    """
    own = [tag for group in fixed.IMPLIED_ENDS for tag in group[0]]
    roles = [f"if(tag IN ({literals(own)}), NULL, named_struct('grp', tag, 'lvl', level, 'own', true))"]
    for n, (members, scope, others) in enumerate(fixed.IMPLIED_ENDS):
        ends = [f"tag IN ({literals([*members, *others])})"] + ([f"(tag IN ({literals(scope)}) AND NOT opens)"] if scope else [])
        roles.append(f"if({' OR '.join(ends)}, named_struct('grp', concat('/', {_family(n)}), 'lvl', cast(scope_{n} AS bigint), 'own', tag IN ({literals(members)})), NULL)")
    return f"array_compact(array({', '.join(roles)}))"


def element_spans(events: DataFrame, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pair start and end tags by name and nesting level.

    A running depth per tag name gives each event its level; inside one level
    starts and ends alternate, so the next event of the level ends the element.
    An element without an end runs to the last token, as ``body`` always does
    (text after ``</body>`` still belongs to it).  Elements whose end tag may be left out (``fixed.IMPLIED_ENDS``) end at the
    next event of their group: at their end tag, or in front of whatever else ends them at the same depth of the elements around.
    """
    depths = []
    for n, (_, scope, _) in enumerate(fixed.IMPLIED_ENDS):
        inside = f"tag IN ({literals(scope)})" if scope else "false"
        running = f"sum(CASE WHEN {inside} THEN if(opens, 1, -1) ELSE 0 END) OVER (PARTITION BY {key} ORDER BY pos ROWS UNBOUNDED PRECEDING)"
        depths.append(f"{running} + if({inside} AND NOT opens, 1, 0) AS scope_{n}" if scope else f"0 AS scope_{n}")
    leveled = events.selectExpr("*", *depths).selectExpr(
        "*",
        f"sum(if(opens, 1, -1)) OVER (PARTITION BY {key}, tag ORDER BY pos ROWS UNBOUNDED PRECEDING)"
        " + if(opens, 0, 1) AS level",
    )
    placed = leveled.selectExpr("*", f"explode({_roles()}) AS role")
    over = f"OVER (PARTITION BY {key}, role.grp, role.lvl ORDER BY pos)"
    paired = placed.selectExpr("*", *[f"lead({name}) {over} AS next_{name}" for name in ("pos", "tag", "opens")])
    end = """CASE WHEN tag = 'body' THEN last_pos
        WHEN startswith(role.grp, '/') AND (next_opens OR next_tag <> tag) THEN next_pos - 1
        ELSE coalesce(next_pos, last_pos) END AS end_pos"""
    return paired.where(f"(opens AND role.own) OR pos = {TEXT_POS}").selectExpr(
        key, *carry, "tag", "pos AS start_pos", end, "dropped", "inner_drop", "ranks", "scoped_ranks"
    )


def visible_spans(spans: DataFrame, key: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Mark spans inside a dropped element, and resolve article-scoped ranks.

    Spans are intervals of one tree, so "some earlier dropped span still open"
    is a running maximum over the start order; the same holds for articles.
    """
    earlier = f"OVER (PARTITION BY {key} ORDER BY start_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    covered = spans.selectExpr(
        "*",
        f"max(if(dropped, end_pos, NULL)) {earlier} AS cover",
        f"max(if(tag = 'article', end_pos, NULL)) {earlier} AS article",
    )
    return covered.selectExpr(
        key,
        *carry,
        "tag",
        "start_pos",
        "end_pos",
        "dropped",
        "inner_drop",
        "coalesce(cover >= start_pos, false) AS hidden",
        "if(article >= start_pos, concat(scoped_ranks, ranks), ranks) AS ranks",
    )


def page_marks(
    pages: DataFrame, key: str, html_col: str = "html", also: tuple[str, ...] = (), texts: bool = False, rendered: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per page with the spans that shape its content.

    ``drops`` are the outermost removed spans, ``inners`` the spans removed from
    the chosen element only, ``candidates`` the selector matches and ``blocks``
    the elements named in ``also``; all without what lies in a removed element.  With ``texts`` every page has a row, with its
    ``texts`` and the columns ``keep``.
    """
    carry = (*keep, "texts") if texts else ()
    events = tag_events(pages, key, html_col, also, texts, rendered, keep)
    spans = visible_spans(element_spans(events, key, carry), key, carry)
    span = "struct(start_pos, end_pos)"
    live = "NOT hidden AND NOT dropped"
    in_blocks = f"{live} AND tag IN ({literals(also)})" if also else "false"

    def spans_where(condition: str, name: str, value: str = span):
        return F.expr(f"array_sort(collect_list(if({condition}, {value}, NULL))) AS {name}")

    return spans.groupBy(key).agg(
        *(F.first(F.when(F.col("start_pos") == TEXT_POS, F.col(c)), ignorenulls=True).alias(c) for c in carry),
        spans_where("dropped AND NOT hidden", "drops"),
        spans_where(f"inner_drop AND {live}", "inners"),
        spans_where(f"{live} AND size(ranks) > 0", "candidates", "struct(start_pos, end_pos, ranks)"),
        spans_where(in_blocks, "blocks"),
        F.expr("max(tag = 'body') AS has_body"),
    )
