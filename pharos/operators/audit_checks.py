"""The accessibility checks, each an expression over the elements of one document.

A check is SQL text that yields an array of issue candidates; all checks of an audit are concatenated and exploded in one
projection, so that an audit needs no shuffle. `CHECKS` is in order of execution. Where a check breaks off on malformed
input (a span that is no number, a row without cells, a colour of four or five digits), the candidates before that place
stay and the later ones of the check on that page are left out.
"""

from __future__ import annotations

ISSUE = "struct<type string, criterion string, severity string, status string, pre int, detail string, text_color string, background_color string, ratio string, required string, large boolean>"

# Phrases and patterns the checks compare with.
GENERIC_HEADINGS = ("heading", "title", "subtitle", "header")
GENERIC_TITLES = ("untitled", "document", "page", "new page", "title")
GENERIC_ALTS = ("image", "diagram", "photo", "picture", "graphic", "icon")
GENERIC_LINKS = (
    "click here", "click", "here", "read more", "more", "learn more", "details", "link", "this link", "this page", "this", "go", "go to", "view", "view more",
    "see more", "see details", "continue", "continue reading",
)
URL_LIKE = r"(?i)^https?://|^www\\.|\\.(com|org|net|edu|gov|io)(/|$)"
NEW_WINDOW = r"(?i)new window|new tab|opens in new|external"
READER_CLASSES, ICON_CLASSES = r"sr-only|visually-hidden|screen-reader-text", r"external|new-window|fa-external-link"
TEXT_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "a", "span", "div", "li", "td", "th")
LAYOUT_CLASSES = r"(?i)layout|grid|non-data"
COLOUR = r"(#[0-9a-fA-F]{3,6}|rgb\\(\\s*\\d+\\s*,\\s*\\d+\\s*,\\s*\\d+\\s*\\))"
UNLABELLED_INPUTS = ("hidden", "submit", "reset", "button")


def names(*tags: str) -> str:
    return ", ".join(f"'{t}'" for t in tags)


def tagged(*tags: str) -> str:
    return f"filter(nodes, n -> n.name IN ({names(*tags)}))"


def attr(node: str, key: str) -> str:
    return f"coalesce({node}.attrs['{key}'], '')"


def has(node: str, key: str) -> str:
    return f"map_contains_key({node}.attrs, '{key}')"


def below(node: str, condition: str = "true", var: str = "d") -> str:
    """The descendants of `node` that meet a condition on `var`."""
    return f"filter(nodes, {var} -> {var}.pre > {node}.pre AND {var}.pre <= {node}.post AND ({condition}))"


def any_below(node: str, condition: str, var: str = "d") -> str:
    return f"exists(nodes, {var} -> {var}.pre > {node}.pre AND {var}.pre <= {node}.post AND ({condition}))"


def any_above(node: str, condition: str, var: str = "u") -> str:
    return f"exists(nodes, {var} -> array_contains({node}.above, {var}.pre) AND ({condition}))"


def let(value: str, var: str, body: str) -> str:
    """`body` with `var` bound to `value`."""
    return f"get(transform(array({value}), {var} -> {body}), 0)"


def issue(kind: str, criterion: str, severity: str, pre: str, detail: str = "''", status: str = "'needs_remediation'") -> str:
    """One candidate. All arguments but the criterion are SQL."""
    return (
        f"named_struct('type', {kind}, 'criterion', '{criterion}', 'severity', {severity}, 'status', {status}, 'pre', CAST({pre} AS INT), 'detail', {detail},"
        " 'text_color', CAST(NULL AS STRING), 'background_color', CAST(NULL AS STRING), 'ratio', CAST(NULL AS STRING), 'required', CAST(NULL AS STRING), 'large', CAST(NULL AS BOOLEAN))"
    )


NO_ISSUE = f"CAST(array() AS array<{ISSUE}>)"
PRE_OF = lambda tag: f"get({tagged(tag)}, 0).pre"
HEADINGS = "flatten(transform(sequence(1, 6), l -> filter(nodes, n -> n.name = concat('h', l))))"


def when(condition: str, then: str, otherwise: str = NO_ISSUE) -> str:
    return f"CASE WHEN {condition} THEN {then} ELSE {otherwise} END"


def heading_hierarchy() -> str:
    level = lambda x: f"CAST(substr({x}.name, 2) AS INT)"
    skipped = f"filter(sequence(1, greatest(size(hs) - 1, 1)), i -> i < size(hs) AND {level('get(hs, i)')} > {level('get(hs, i - 1)')} + 1)"
    found = (
        "concat("
        + when("get(hs, 0).name <> 'h1'", f"array({issue("'no-h1'", '1.3.1', "'major'", PRE_OF('body'))})")
        + f", transform(sk, i -> {issue("'skipped-heading-level'", '1.3.1', "'major'", 'get(hs, i).pre', 'get(hs, i).text')}), "
        + when("get(hs, 0).name = 'h1' AND size(sk) = 0", f"array({issue("'compliant-heading-hierarchy'", '1.3.1', "'major'", 'get(hs, 0).pre', "''", "'compliant'")})")
        + ")"
    )
    return let(HEADINGS, "hs", when("size(hs) = 0", f"array({issue("'no-headings'", '1.3.1', "'major'", PRE_OF('body'))})", let(skipped, "sk", found)))


def heading_content() -> str:
    bad = f"filter(hs, h -> h.text = '' OR lower(h.text) IN ({names(*GENERIC_HEADINGS)}))"
    found = f"transform(bad, h -> {issue("if(h.text = '', 'empty-heading', 'generic-heading')", '2.4.6', "if(h.text = '', 'major', 'minor')", 'h.pre', 'h.text')})"
    good = f"array({issue("'compliant-heading-content'", '2.4.6', "'major'", 'get(hs, 0).pre', 'get(hs, 0).text', "'compliant'")})"
    return let(HEADINGS, "hs", when("size(hs) = 0", NO_ISSUE, let(bad, "bad", when("size(bad) = 0", good, found))))


def document_title() -> str:
    kind = f"CASE WHEN t.text = '' THEN 'empty-title' WHEN lower(t.text) IN ({names(*GENERIC_TITLES)}) THEN 'generic-title' ELSE 'compliant-document-title' END"
    status = f"if(t.text = '' OR lower(t.text) IN ({names(*GENERIC_TITLES)}), 'needs_remediation', 'compliant')"
    severity = f"if(t.text <> '' AND lower(t.text) IN ({names(*GENERIC_TITLES)}), 'minor', 'major')"
    missing = f"array({issue("'missing-title'", '2.4.2', "'major'", PRE_OF('head'))})"
    return let(f"get({tagged('title')}, 0)", "t", when("t IS NULL", missing, f"array({issue(kind, '2.4.2', severity, 't.pre', 't.text', status)})"))


def document_language() -> str:
    lang = f"trim({attr('h', 'lang')})"
    kind = f"CASE WHEN NOT {has('h', 'lang')} THEN 'missing-document-language' WHEN length({lang}) < 2 THEN 'invalid-document-language' ELSE 'compliant-document-language' END"
    severity = f"if({has('h', 'lang')} AND length({lang}) < 2, 'major', 'critical')"
    return let(f"get({tagged('html')}, 0)", "h", when("h IS NULL", NO_ISSUE, f"array({issue(kind, '3.1.1', severity, 'h.pre', lang, f"if(length({lang}) < 2, 'needs_remediation', 'compliant')")})"))


def landmark(tag: str, role: str, name: str, severity: str) -> str:
    first = f"coalesce(get({tagged(tag)}, 0), get(filter(nodes, n -> {attr('n', 'role')} = '{role}'), 0))"
    return let(first, "m", f"array({issue(f"if(m IS NULL, 'missing-{name}-landmark', 'compliant-{name}-landmark')", '1.3.1', f"'{severity}'", f'coalesce(m.pre, {PRE_OF("body")})', "''", "if(m IS NULL, 'needs_remediation', 'compliant')")})")


def skip_link() -> str:
    first = f"get(filter(slice({tagged('a')}, 1, 5), a -> startswith({attr('a', 'href')}, '#') AND lower(a.text) RLIKE 'skip|jump|content|main'), 0)"
    return let(first, "s", f"array({issue("if(s IS NULL, 'missing-skip-link', 'compliant-skip-link')", '2.4.1', "'major'", f'coalesce(s.pre, {PRE_OF("body")})', "''", "if(s IS NULL, 'needs_remediation', 'compliant')")})")


def landmarks() -> str:
    return f"concat({landmark('nav', 'navigation', 'navigation', 'minor')}, {landmark('header', 'banner', 'header', 'minor')}, {landmark('footer', 'contentinfo', 'footer', 'minor')})"


def image_alt() -> str:
    alt = f"trim({attr('n', 'alt')})"
    decorative = f"({attr('n', 'role')} = 'presentation' OR {attr('n', 'aria-hidden')} = 'true')"
    cases = (
        f"CASE WHEN NOT {has('n', 'alt')} THEN 'missing-alt-text' WHEN {alt} = '' AND {decorative} THEN 'compliant-decorative-image' WHEN {alt} = '' THEN 'empty-alt-text'"
        f" WHEN lower({alt}) IN ({names(*GENERIC_ALTS)}) THEN 'generic-alt-text' ELSE 'compliant-alt-text' END"
    )
    severity = "CASE WHEN k IN ('missing-alt-text', 'compliant-alt-text') THEN 'critical' WHEN k = 'compliant-decorative-image' THEN 'minor' ELSE 'major' END"
    return f"transform({tagged('img')}, n -> {let(cases, 'k', issue('k', '1.1.1', severity, 'n.pre', alt, "if(startswith(k, 'compliant'), 'compliant', 'needs_remediation')"))})"


def figure() -> str:
    caption = f"get({below('n', "d.name = 'figcaption'")}, 0)"
    kind = "CASE WHEN c IS NULL THEN 'missing-figure-caption' WHEN c.text = '' THEN 'empty-figure-caption' ELSE 'compliant-figure-structure' END"
    return f"transform({tagged('figure')}, n -> {let(caption, 'c', issue(kind, '1.1.1', "'major'", 'n.pre', "coalesce(c.text, '')", "if(coalesce(c.text, '') = '', 'needs_remediation', 'compliant')"))})"


def link_text() -> str:
    links = f"filter(nodes, n -> n.name = 'a' AND NOT ({attr('n', 'href')} RLIKE '^#+$'))"
    image = any_below("n", f"d.name = 'img' AND trim({attr('d', 'alt')}) <> ''")
    kind = (
        f"CASE WHEN n.text = '' THEN if({image}, 'compliant-image-link', 'empty-link-text') WHEN lower(n.text) IN ({names(*GENERIC_LINKS)}) THEN 'generic-link-text'"
        f" WHEN n.text RLIKE '{URL_LIKE}' THEN 'url-as-link-text' ELSE 'compliant-link-text' END"
    )
    severity = "CASE k WHEN 'empty-link-text' THEN 'critical' WHEN 'generic-link-text' THEN 'major' WHEN 'url-as-link-text' THEN 'minor' ELSE 'info' END"
    each = f"transform(ls, n -> {let(kind, 'k', issue('k', '2.4.4', severity, 'n.pre', 'n.text', "if(startswith(k, 'compliant'), 'compliant', 'needs_remediation')"))})"
    # texts with several targets, and every link of the page whose single string is that text, skipped ones included
    texts = f"filter(array_distinct(transform(filter(ls, n -> n.text <> ''), n -> lower(n.text))), t -> size(array_distinct(transform(filter(ls, n -> lower(n.text) = t), n -> {attr('n', 'href')}))) > 1)"
    same = f"flatten(transform({texts}, t -> transform(filter(nodes, n -> n.name = 'a' AND lower(n.string_value) = t), n -> {issue("'duplicate-link-text-different-url'", '2.4.9', "'major'", 'n.pre', 't')})))"
    return let(links, "ls", f"concat({each}, {same})")


def new_window() -> str:
    warned = f"'{NEW_WINDOW}'"
    reader = any_below("n", f"d.name IN ('span', 'div') AND exists(d.classes, c -> c RLIKE '{READER_CLASSES}') AND d.text RLIKE {warned}")
    icon = any_below("n", f"d.name = 'i' AND exists(d.classes, c -> c RLIKE '{ICON_CLASSES}')")
    method = (
        f"CASE WHEN {icon} THEN 'icon' WHEN {reader} THEN 'screen reader text' WHEN {attr('n', 'title')} RLIKE {warned} THEN 'title attribute'"
        f" WHEN {attr('n', 'aria-label')} RLIKE {warned} THEN 'aria-label' WHEN n.text RLIKE {warned} THEN 'text content' END"
    )
    links = f"concat(filter(nodes, n -> n.name = 'a' AND {attr('n', 'target')} = '_blank'), filter(nodes, n -> n.name = 'a' AND array_contains(split({attr('n', 'rel')}, '\\\\s+'), 'external')))"
    one = issue("if(w IS NULL, 'new-window-link-no-warning', 'compliant-new-window-link')", "3.2.5", "if(w IS NULL, 'minor', 'info')", "n.pre", "coalesce(w, n.text)", "if(w IS NULL, 'needs_remediation', 'compliant')")
    return f"transform({links}, n -> {let(method, 'w', one)})"


def _table(body: str) -> str:
    """`body` for each table `t` with its rows `rs`, header cells `th`, cells `cs` and first row's cells `fr`, stopping where a span is no number."""
    rows, heads, cells = below("t", "d.name = 'tr'"), below("t", "d.name = 'th'"), below("t", "d.name IN ('td', 'th')")
    first = f"CASE WHEN size(rs) > 0 THEN {below('get(rs, 0)', "d.name IN ('td', 'th')")} ELSE filter(nodes, d -> false) END"
    inner = let(rows, "rs", let(heads, "th", let(cells, "cs", let(first, "fr", body))))
    return inner


LAYOUT = (
    f"({attr('t', 'role')} = 'presentation' OR concat_ws(' ', t.classes) RLIKE '{LAYOUT_CLASSES}'"
    f" OR (size(th) = 0 AND NOT {any_below('t', "d.name = 'caption'")} AND (size(rs) <= 1 OR size(fr) <= 1)))"
)
_SPAN = lambda c, k: f"CASE WHEN {has(c, k)} THEN coalesce(TRY_CAST(trim({attr(c, k)}) AS INT), -1) ELSE 0 END"
#: First cell with a span above one, and first with one that is no number; the latter stops the check if it comes first.
COMPLEX = (
    f"(exists(cs, c -> {_SPAN('c', 'rowspan')} > 1 OR {_SPAN('c', 'colspan')} > 1) OR size(filter(rs, r -> {any_below('r', "d.name = 'th'")})) > 1 OR size(rs) > 10)"
)
_BAD = f"coalesce(array_min(transform(filter(cs, c -> {_SPAN('c', 'rowspan')} = -1 OR ({_SPAN('c', 'rowspan')} <= 1 AND {_SPAN('c', 'colspan')} = -1)), c -> c.pre)), 2147483647)"
_GOOD = f"coalesce(array_min(transform(filter(cs, c -> {_SPAN('c', 'rowspan')} > 1 OR {_SPAN('c', 'colspan')} > 1), c -> c.pre)), 2147483646)"
BAD_SPAN = f"({_BAD} <= {_GOOD})"


def _until_broken(each: str) -> str:
    """Candidates of the tables up to and including the first that breaks off. `each` gives (found, broken) of table `t`."""
    return let(
        f"transform({tagged('table')}, t -> {each})", "per",
        "flatten(transform(slice(per, 1, coalesce(get(filter(sequence(1, greatest(size(per), 1)), i -> coalesce(get(per, i - 1).broken, false)), 0), greatest(size(per), 1))), p -> p.found))",
    )


def table_headers() -> str:
    heads = when(
        "size(th) = 0", f"array({issue("'table-missing-headers'", '1.3.1', "'major'", 't.pre')})",
        f"transform(filter(th, h -> NOT {has('h', 'scope')}), h -> {issue("'table-missing-scope'", '1.3.1', "'minor'", 'h.pre', 'h.text')})",
    )
    caption = when(f"NOT {BAD_SPAN} AND {COMPLEX} AND NOT {any_below('t', "d.name = 'caption'")}", f"array({issue("'table-missing-caption'", '1.3.1', "'minor'", 't.pre')})")
    one = f"CASE WHEN {LAYOUT} THEN named_struct('found', {NO_ISSUE}, 'broken', false) ELSE named_struct('found', concat({heads}, {caption}), 'broken', {BAD_SPAN}) END"
    return _until_broken(_table(one))


def table_structure() -> str:
    one_issue = lambda kind, severity: f"array({issue(f"'{kind}'", '1.3.1', f"'{severity}'", 't.pre')})"
    thead = when(f"size(rs) > 0 AND {any_below('get(rs, 0)', "d.name = 'th'")} AND NOT {any_below('t', "d.name = 'thead'")}", one_issue("table-missing-thead", "minor"))
    tbody = when(f"size(rs) > 1 AND NOT {any_below('t', "d.name = 'tbody'")}", one_issue("table-missing-tbody", "minor"))
    ids = when(f"{COMPLEX} AND NOT exists(cs, c -> c.name = 'td' AND {has('c', 'headers')}) AND NOT exists(th, h -> {has('h', 'id')})", one_issue("table-missing-headers-id", "major"))
    row_heads = "size(filter(fr, c -> c.name = 'th'))"
    first_cell = f"transform(rs, r -> get({below('r', "d.name IN ('td', 'th')")}, 0).name)"
    row = when(f"size(rs) >= 2 AND {row_heads} > 0 AND {row_heads} < size(fr)", one_issue("table-irregular-headers", "major"))
    column = let(first_cell, "fc", when("size(rs) >= 2 AND size(filter(fc, x -> x = 'th')) > 0 AND size(filter(fc, x -> x = 'th')) < size(rs)", one_issue("table-irregular-headers", "major")))
    empty_row = f"(size(rs) >= 2 AND exists({first_cell}, x -> x IS NULL))"
    whole = (
        f"CASE WHEN {BAD_SPAN} THEN named_struct('found', concat({thead}, {tbody}), 'broken', true)"
        f" WHEN {empty_row} THEN named_struct('found', concat({thead}, {tbody}, {ids}), 'broken', true)"
        f" ELSE named_struct('found', concat({thead}, {tbody}, {ids}, {row}, {column}), 'broken', false) END"
    )
    return _until_broken(_table(f"CASE WHEN {LAYOUT} THEN named_struct('found', {NO_ISSUE}, 'broken', false) ELSE {whole} END"))


def colour_of(style: str, prop: str) -> str:
    """The colour told after `prop` in a style, NULL if none; the text colour's pattern also meets a background's."""
    return f"nullif(regexp_extract({style}, '{prop}:\\\\s*{COLOUR}', 1), '')"


def hex_of(colour: str) -> str:
    part = lambda i: f"lpad(hex(CAST(regexp_extract({colour}, '(\\\\d+)\\\\D+(\\\\d+)\\\\D+(\\\\d+)', {i}) AS INT)), 2, '0')"
    short = f"concat('#', substr({colour}, 2, 1), substr({colour}, 2, 1), substr({colour}, 3, 1), substr({colour}, 3, 1), substr({colour}, 4, 1), substr({colour}, 4, 1))"
    return f"CASE WHEN startswith({colour}, 'rgb') THEN concat('#', {part(1)}, {part(2)}, {part(3)}) WHEN length({colour}) = 4 THEN upper({short}) ELSE upper({colour}) END"


def luminance(colour: str) -> str:
    def channel(i: int) -> str:
        v = f"(CAST(conv(substr({colour}, {i}, 2), 16, 10) AS DOUBLE) / 255D)"
        return f"CASE WHEN {v} <= 0.03928D THEN {v} / 12.92D ELSE pow(({v} + 0.055D) / 1.055D, 2.4D) END"

    return f"(0.2126D * {channel(2)} + 0.7152D * {channel(4)} + 0.0722D * {channel(6)})"


def contrast() -> str:
    style = attr("n", "style")
    own = f"filter(nodes, u -> (array_contains(n.above, u.pre) OR u.pre = n.pre) AND {colour_of(attr('u', 'style'), 'background-color')} IS NOT NULL"
    own += " AND (u.pre = n.pre OR u.pre > coalesce(array_max(transform(filter(nodes, h -> h.name = 'html' AND array_contains(n.above, h.pre)), h -> h.pre)), -1)))"
    background = f"coalesce({hex_of(colour_of(attr(f'element_at({own}, -1)', 'style'), 'background-color'))}, '#FFFFFF')"
    background = let(own, "bs", f"CASE WHEN size(bs) = 0 THEN '#FFFFFF' ELSE {let(colour_of(attr('get(bs, size(bs) - 1)', 'style'), 'background-color'), 'bc', hex_of('bc'))} END")
    text = let(colour_of(style, "color"), "tc", f"CASE WHEN tc IS NULL THEN '#000000' ELSE {hex_of('tc')} END")
    px = f"CAST(nullif(regexp_extract({style}, 'font-size:\\\\s*(\\\\d+)(px|pt|em|rem)', 1), '') AS DOUBLE)"
    unit = f"regexp_extract({style}, 'font-size:\\\\s*(\\\\d+)(px|pt|em|rem)', 2)"
    size = f"coalesce({px} * CASE {unit} WHEN 'pt' THEN 1.333D WHEN 'px' THEN 1D ELSE 16D END, 0D)"
    bold = f"(n.name IN ('b', 'strong') OR {style} RLIKE 'font-weight:\\\\s*(bold|700|800|900)')"
    large = f"(n.name IN ('h1', 'h2', 'h3') OR {size} >= 24D OR ({size} >= 18.67D AND {bold}))"
    judged = let(
        f"named_struct('pre', n.pre, 'fg', {text}, 'bg', {background}, 'large', {large})", "x",
        f"named_struct('pre', x.pre, 'fg', x.fg, 'bg', x.bg, 'large', x.large, 'broken', length(x.fg) <> 7 OR length(x.bg) <> 7, 'ratio', CASE WHEN length(x.fg) = 7 AND length(x.bg) = 7 THEN {let(luminance('x.fg'), 'l1', let(luminance('x.bg'), 'l2', '(greatest(l1, l2) + 0.05D) / (least(l1, l2) + 0.05D)'))} END)",
    )
    # an element without any style takes black on the page's background; only those below a style can fail
    found = f"transform(filter(nodes, n -> n.name IN ({names(*TEXT_TAGS)}) AND trim(n.text) <> ''), n -> {judged})"
    issue_row = (
        "named_struct('type', 'insufficient-color-contrast', 'criterion', '1.4.3', 'severity', 'major', 'status', 'needs_remediation', 'pre', x.pre, 'detail', concat(format_string('%.2f', x.ratio), ':1'),"
        " 'text_color', x.fg, 'background_color', x.bg, 'ratio', concat(format_string('%.2f', x.ratio), ':1'), 'required', if(x.large, '3.0:1', '4.5:1'), 'large', x.large)"
    )
    upto = "slice(js, 1, coalesce(get(filter(sequence(1, greatest(size(js), 1)), i -> coalesce(get(js, i - 1).broken, false)), 0), greatest(size(js), 1)))"
    return when(f"exists(nodes, n -> {has('n', 'style')})", let(found, "js", f"transform(filter({upto}, x -> NOT x.broken AND x.ratio < if(x.large, 3D, 4.5D)), x -> {issue_row})"))


CONTROLS = f"concat(filter(nodes, n -> n.name = 'input' AND NOT lower({attr('n', 'type')}) IN ({names(*UNLABELLED_INPUTS)})), {tagged('select')}, {tagged('textarea')})"


def labelled(c: str) -> str:
    by_for = f"({has(c, 'id')} AND exists(nodes, l -> l.name = 'label' AND {has('l', 'for')} AND {attr('l', 'for')} = {attr(c, 'id')}))"
    by_ids = f"exists(split(trim({attr(c, 'aria-labelledby')}), '\\\\s+'), i -> i <> '' AND coalesce(get(filter(nodes, l -> {attr('l', 'id')} = i), 0).text, '') <> '')"
    return f"({by_for} OR {any_above(c, "u.name = 'label'")} OR {by_ids} OR trim({attr(c, 'aria-label')}) <> '' OR trim({attr(c, 'title')}) <> '')"


def form_labels() -> str:
    each = f"flatten(transform({CONTROLS}, c -> concat({when(f'NOT {has("c", "name")}', f"array({issue("'form-control-missing-name'", '1.3.1', "'major'", 'c.pre')})")}, {when(f'NOT {labelled("c")}', f"array({issue("'form-control-missing-label'", '1.3.1', "'critical'", 'c.pre')})")})))"
    empty = f"transform(filter(nodes, n -> n.name = 'label' AND n.text = ''), n -> {issue("'form-label-empty'", '3.3.2', "'major'", 'n.pre')})"
    return f"concat({each}, {empty})"


def required_fields() -> str:
    marked = lambda t: f"(contains(coalesce({t}, ''), '*') OR contains(lower(coalesce({t}, '')), 'required'))"
    by_for = f"({has('c', 'id')} AND {marked(f"get(filter(nodes, l -> l.name = 'label' AND {has('l', 'for')} AND {attr('l', 'for')} = {attr('c', 'id')}), 0).text")})"
    wrapping = f"get(reverse(filter(nodes, u -> u.name = 'label' AND array_contains(c.above, u.pre))), 0).text"
    controls = f"filter(nodes, c -> c.name IN ('input', 'select', 'textarea') AND NOT (c.name = 'input' AND lower({attr('c', 'type')}) IN ({names(*UNLABELLED_INPUTS)})) AND ({has('c', 'required')} OR {attr('c', 'aria-required')} = 'true'))"
    aria = when(f"NOT {has('c', 'aria-required')}", f"array({issue("'form-required-field-missing-aria'", '3.3.2', "'minor'", 'c.pre')})")
    told = when(f"NOT ({by_for} OR {marked(wrapping)})", f"array({issue("'form-required-field-not-indicated'", '3.3.2', "'major'", 'c.pre')})")
    return f"flatten(transform({controls}, c -> concat({aria}, {told})))"


def fieldsets() -> str:
    legend = f"trim(coalesce(get({below('n', "d.name = 'legend'")}, 0).text, ''))"
    missing = f"transform(filter({tagged('fieldset')}, n -> {legend} = ''), n -> {issue("'form-fieldset-missing-legend'", '1.3.1', "'major'", 'n.pre')})"
    in_set = lambda g: f"exists({g}, r -> {any_above('r', "u.name = 'fieldset'")})"
    radios = below("f", f"d.name = 'input' AND {attr('d', 'type')} = 'radio' AND {has('d', 'name')}")
    groups = f"transform(array_distinct(transform(rad, r -> {attr('r', 'name')})), k -> filter(rad, r -> {attr('r', 'name')} = k))"
    by_name = let(radios, "rad", f"transform(filter({groups}, g -> size(g) > 1 AND NOT {in_set('g')}), g -> {issue("'form-related-controls-no-fieldset'", '1.3.1', "'major'", 'get(g, 0).pre', 'CAST(size(g) AS STRING)')})")
    boxes = below("f", f"d.name = 'input' AND {attr('d', 'type')} = 'checkbox'")
    # runs of checkboxes that share one of their three nearest ancestors with the one before; the document itself is an ancestor too
    near = lambda x: f"slice(reverse(concat(array(-1), {x}.above)), 1, 3)"
    starts = f"filter(sequence(1, size(box)), i -> i = 1 OR NOT arrays_overlap({near('get(box, i - 1)')}, {near('get(box, i - 2)')}))"
    runs = f"transform(st, s -> slice(box, s, coalesce(array_min(filter(st, e -> e > s)), size(box) + 1) - s))"
    by_place = let(
        boxes, "box",
        when("size(box) > 2", let(starts, "st", f"transform(filter({runs}, g -> size(g) > 1 AND NOT {in_set('g')}), g -> {issue("'form-related-controls-no-fieldset'", '1.3.1', "'minor'", 'get(g, 0).pre', 'CAST(size(g) AS STRING)')})")),
    )
    return f"concat({missing}, flatten(transform({tagged('form')}, f -> concat({by_name}, {by_place}))))"


#: Name and expression of each check in order of execution.
CHECKS: dict[str, str] = {
    "heading_hierarchy": heading_hierarchy(), "heading_content": heading_content(), "document_title": document_title(), "document_language": document_language(),
    "main_landmark": landmark("main", "main", "main", "major"), "skip_link": skip_link(), "landmarks": landmarks(), "image_alt": image_alt(), "figure": figure(), "link_text": link_text(),
    "new_window": new_window(), "table_headers": table_headers(), "table_structure": table_structure(), "contrast": contrast(), "form_labels": form_labels(),
    "required_fields": required_fields(), "fieldsets": fieldsets(),
}
