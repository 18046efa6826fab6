"""A second set of checks with its own type names and severities ; see `audit_checks` for the first."""

from __future__ import annotations

from pharos.operators.audit_checks import CONTROLS, HEADINGS, NO_ISSUE, PRE_OF, any_below, attr, below, has, issue, let, names, tagged, when

# Phrases and patterns of this rule set.
GENERIC_LINKS = ("click here", "click", "here", "this link", "more", "read more", "details", "learn more", "link", "this", "go", "go to")
GENERIC_ALT = r"^image\\s*\\d*$|^photo\\s*\\d*$|^picture\\s*\\d*$|^graphic\\s*\\d*$|^IMAGE$|^ICON$|^FIGURE$|^DIAGRAM$"
NAMED_GENERIC_ALTS = ("ICON", "DIAGRAM", "FIGURE", "IMAGE")
DECORATIVE_SOURCES, COMPLEX_SOURCES, FIGURE_REFERENCE = "separator|divider|spacer|bullet", "figure|diagram|chart|graph", r"Figure\\s+\\d+"
GENERATED_ALT, GENERATED_ID = "data-bda-generated-alt", "data-bda-id"
DECORATIVE_SIZE, COMPLEX_SIZE = 20, 300
LONG_ALT = 150


def _one(kind: str, criterion: str, severity: str, pre: str, detail: str = "''") -> str:
    return issue(f"'{kind}'", criterion, f"'{severity}'", pre, detail)


def heading_structure() -> str:
    """Each heading whose next higher level isn't among the headings seen before it, levels in order."""
    level = "CAST(substr(h.name, 2) AS INT)"
    return let(HEADINGS, "hs", f"transform(filter(hs, h -> {level} > 1 AND NOT exists(hs, g -> CAST(substr(g.name, 2) AS INT) = {level} - 1)), h -> {_one('improper-heading-structure', '1.3.1', 'major', 'h.pre', 'h.text')})")


def document_language() -> str:
    return let(f"get({tagged('html')}, 0)", "h", when(f"h IS NOT NULL AND NOT {has('h', 'lang')}", f"array({_one('missing-document-language', '3.1.1', 'critical', 'h.pre')})"))


def page_title() -> str:
    return let(f"get({tagged('title')}, 0)", "t", when("trim(coalesce(t.string_value, '')) = ''", f"array({_one('missing-page-title', '2.4.2', 'major', PRE_OF('head'))})"))


def main_landmark() -> str:
    return when(f"NOT exists(nodes, n -> n.name = 'main' OR {attr('n', 'role')} = 'main')", f"array({_one('missing-main-landmark', '1.3.1', 'major', PRE_OF('body'))})")


def skip_link() -> str:
    there = f"exists(slice({tagged('a')}, 1, 5), a -> startswith({attr('a', 'href')}, '#') AND lower(a.text) RLIKE 'skip|jump|content|main')"
    return when(f"NOT {there}", f"array({_one('missing-skip-link', '2.4.1', 'major', PRE_OF('body'))})")


def tables() -> str:
    """All tables, laid out ones too: headers, scopes, captions, and ids in tables of more than two rows and headers."""
    rows, heads = below("t", "d.name = 'tr'"), below("t", "d.name = 'th'")
    head = when("size(th) = 0", f"array({_one('missing-table-headers', '1.3.1', 'critical', 't.pre')})", f"transform(filter(th, h -> NOT {has('h', 'scope')}), h -> {_one('missing-header-scope', '1.3.1', 'major', 'h.pre', 'h.text')})")
    caption = when(f"NOT {any_below('t', "d.name = 'caption'")}", f"array({_one('missing-table-caption', '1.3.1', 'minor', 't.pre')})")
    ids = when(f"size(rs) > 2 AND size(th) > 2 AND {any_below('t', "d.name = 'td'")} AND NOT {any_below('t', f"d.name = 'td' AND {has('d', 'headers')}")}", f"array({_one('complex-table-no-ids', '1.3.1', 'critical', 't.pre')})")
    return f"flatten(transform({tagged('table')}, t -> {let(rows, 'rs', let(heads, 'th', f'concat({head}, {caption}, {ids})'))}))"


def forms() -> str:
    """Controls without a label of their own (a wrapping one doesn't count) and required ones without the attribute for it."""
    by_for = f"({has('c', 'id')} AND exists(nodes, l -> l.name = 'label' AND {has('l', 'for')} AND {attr('l', 'for')} = {attr('c', 'id')}))"
    told = f"({by_for} OR trim({attr('c', 'aria-label')}) <> '' OR trim({attr('c', 'aria-labelledby')}) <> '' OR trim({attr('c', 'title')}) <> '')"
    label = when(f"NOT {told}", f"array({_one('missing-form-label', '3.3.2', 'critical', 'c.pre')})")
    required = when(f"{has('c', 'required')} AND NOT {has('c', 'aria-required')}", f"array({_one('missing-aria-required', '3.3.2', 'minor', 'c.pre')})")
    return f"flatten(transform({CONTROLS}, c -> concat({label}, {required})))"


def links() -> str:
    image = any_below("n", "d.name = 'img'")
    empty = when(f"n.text = '' AND NOT {image}", f"array({_one('empty-link', '2.4.4', 'critical', 'n.pre')})")
    generic = when(f"lower(n.text) IN ({names(*GENERIC_LINKS)})", f"array({_one('generic-link-text', '2.4.4', 'major', 'n.pre', 'n.text')})")
    # only the first image of a link counts, and it is the link that is at fault
    first = f"get({below('n', "d.name = 'img'")}, 0)"
    bare = when(f"{image} AND trim({attr(first, 'alt')}) = ''", f"array({_one('link-image-missing-alt', '2.4.4', 'critical', 'n.pre')})")
    return f"flatten(transform({tagged('a')}, n -> concat({empty}, {generic}, {when("n.text = ''", bare)})))"


def _sized(condition: str) -> str:
    """Whether an image has both a width and a height, and both meet a condition on `v`."""
    return " AND ".join(f"exists(array(try_cast({attr('n', k)} AS INT)), v -> v IS NOT NULL AND v {condition})" for k in ("width", "height"))


def decorative() -> str:
    """Whether the image `n` is likely decorative: by role, by being hidden or small, or by the name of its source."""
    return f"({attr('n', 'role')} = 'presentation' OR {attr('n', 'aria-hidden')} = 'true' OR ({_sized(f'< {DECORATIVE_SIZE}')}) OR {attr('n', 'src')} RLIKE '{DECORATIVE_SOURCES}')"


def complex_figure() -> str:
    """Whether the image `n` likely needs a longer description: a figure told of in the next paragraph, by the name of its source, or large."""
    told = f"({attr('n', GENERATED_ID)} <> '' AND coalesce(get(filter(nodes, p -> p.name = 'p' AND p.pre > n.pre), 0).text RLIKE '{FIGURE_REFERENCE}', false))"
    return f"({told} OR lower({attr('n', 'src')}) RLIKE '{COMPLEX_SOURCES}' OR ({_sized(f'> {COMPLEX_SIZE}')}))"


def images() -> str:
    """One finding on each alternative text, good ones included, and one on the figure an image is in or should be in."""
    alt, generated = f"trim({attr('n', 'alt')})", f"{attr('n', GENERATED_ALT)} = 'true'"
    generic = f"{alt} RLIKE '{GENERIC_ALT}'"
    none = _one("missing-alt-text", "1.1.1", "critical", "n.pre")
    present = lambda status: issue("'alt-text-present'", "1.1.1", "'info'", "n.pre", alt, f"'{status}'")
    plain_generic = _one("generic-alt-text", "1.1.1", "major", "n.pre", alt)
    named = issue(f"CASE WHEN {alt} IN ({names(*NAMED_GENERIC_ALTS)}) THEN concat('generic-alt-text-', lower({alt})) ELSE 'generic-alt-text' END", "1.1.1", "'major'", "n.pre", alt)
    text = (
        f"CASE WHEN NOT {has('n', 'alt')} THEN array({none})"
        f" WHEN {generated} THEN concat(array({present('auto_remediated')}), {when(generic, f'array({plain_generic})')})"
        f" WHEN {alt} = '' AND NOT {decorative()} THEN array({_one('empty-alt-text', '1.1.1', 'major', 'n.pre')})"
        f" WHEN {generic} THEN array({named})"
        f" WHEN length({alt}) > {LONG_ALT} THEN array({_one('long-alt-text', '1.1.1', 'minor', 'n.pre')})"
        f" ELSE array({present('remediated')}) END"
    )
    # the innermost figure around the image
    figure = "element_at(concat(array(CAST(NULL AS INT)), transform(filter(nodes, u -> u.name = 'figure' AND array_contains(n.above, u.pre)), u -> u.pre)), -1)"
    captioned = "exists(nodes, u -> u.pre = f AND exists(nodes, d -> d.name = 'figcaption' AND d.pre > u.pre AND d.pre <= u.post))"
    around = let(
        figure, "f",
        f"CASE WHEN f IS NULL AND {complex_figure()} THEN array({_one('improper-figure-structure', '1.1.1', 'major', 'n.pre')})"
        f" WHEN f IS NOT NULL AND NOT {captioned} THEN array({_one('missing-figcaption', '1.1.1', 'major', 'f')}) ELSE {NO_ISSUE} END",
    )
    return f"flatten(transform({tagged('img')}, n -> concat({text}, {around})))"


#: Name and expression of each check of the second set.
CHECKS = {
    "alt_heading_structure": heading_structure(), "alt_document_language": document_language(), "alt_page_title": page_title(), "alt_main_landmark": main_landmark(), "alt_skip_link": skip_link(),
    "alt_tables": tables(), "alt_forms": forms(), "alt_links": links(), "alt_images": images(),
}
