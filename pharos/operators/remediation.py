"""Repairs of documents by their issues.

What to put into a document is decided by rules without a model; rewrites of one document depend on one another and so
run in one pass over it, issue by issue in order. Elements are found by their place in the document (`node_pre`).
Documents and their issues meet in one join; a document is a row and its rewrite touches nothing else.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pharos.operators.issues import passes
from pharos.runtime import arrow_batches
from pharos.sources.html_tree import OPAQUE, VOID, HTMLParser

# What stands in where nothing better is known.
DEFAULT_TITLE, DEFAULT_CAPTION, DEFAULT_LANGUAGE, SKIP_TEXT = "Document", "Table data", "en", "Skip to main content"
NO_DESCRIPTION = "Image description unavailable"
REPAIRED_LINKS = ("click here", "here", "read more", "more", "learn more", "details", "link")
LINK_TEXTS = {"click here": "View details", "read more": "Read more about this topic", "learn more": "Learn more about this topic"}
OTHER_LINK_TEXT, URL_TEXT = "View related information", "Visit website"
DECORATIVE_ROLES, DECORATIVE_CLASSES, DECORATIVE_SIZE = ("presentation", "none"), ("decorative", "icon", "bullet", "separator", "spacer", "bg"), 16
DECORATIVE_PARENTS = ("banner", "header", "logo", "icon")
GENERIC_HEADING = r"^(heading|title|section|\s*\d+\s*)$"
#: Headings a document without any gets at most.
MOST_HEADINGS = 5


class Node:
    """An element, or the document itself; children are elements and texts."""

    def __init__(self, name: str, attrs: dict | None = None, pre: int = -1):
        self.name, self.attrs, self.pre = name, attrs or {}, pre
        self.kids: list[Node | str] = []
        self.up: Node | None = None

    def add(self, kid: Node | str, at: int | None = None) -> None:
        if isinstance(kid, Node):
            if kid.up is not None:
                kid.up.kids.remove(kid)
            kid.up = self
        self.kids.insert(len(self.kids) if at is None else at, kid)

    def walk(self) -> Iterator[Node]:
        for k in list(self.kids):
            if isinstance(k, Node):
                yield k
                yield from k.walk()

    def all(self, *names: str) -> list[Node]:
        return [n for n in self.walk() if n.name in names]

    def first(self, *names: str) -> Node | None:
        return next((n for n in self.walk() if n.name in names), None)

    def above(self, *names: str) -> Node | None:
        p = self.up
        while p is not None and p.name not in names:
            p = p.up
        return p

    def text(self) -> str:
        return "".join(k.strip() if isinstance(k, str) else k.text() for k in self.kids if isinstance(k, str) or k.name not in OPAQUE)

    def set_text(self, text: str) -> None:
        self.kids = [text]

    def html(self) -> str:
        inner = "".join(k.html() if isinstance(k, Node) else k if self.name in OPAQUE or k.startswith("<!") else entities.escape(k, quote=False) for k in self.kids)
        if self.name == "":
            return inner
        attrs = "".join(f' {k}="{entities.escape(v)}"' for k, v in self.attrs.items())
        return f"<{self.name}{attrs}>" if self.name in VOID else f"<{self.name}{attrs}>{inner}</{self.name}>"


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]
        self.count = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        n = Node(tag, {k: v or "" for k, v in attrs}, self.count)
        self.count += 1
        self.open[-1].add(n)
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag: str, attrs) -> None:
        n = Node(tag, {k: v or "" for k, v in attrs}, self.count)
        self.count += 1
        self.open[-1].add(n)

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].name == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        self.open[-1].kids.append(data)

    def handle_decl(self, decl: str) -> None:
        self.open[-1].kids.append(f"<!{decl}>")


def build(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def domain_of(url: str) -> str:
    m = re.search(r"https?://(?:www\.)?([^/]+)", url)
    return m[1] if m else ""


def heading_before(root: Node, node: Node) -> str:
    last = ""
    for n in root.walk():
        if n is node:
            return last
        if re.fullmatch("h[1-6]", n.name) and n.text():
            last = n.text()
    return last


def alt_for(root: Node, img: Node, kind: str) -> str:
    """A generic alternative text filled with the text around the image, else with the heading before it."""
    around = img.up.text() if img.up is not None else ""
    about = around if len(around) < 200 and around else heading_before(root, img)
    diagram, photo = any(w in kind for w in ("diagram", "chart", "graph")), any(w in kind for w in ("photo", "picture"))
    if about:
        return f"{'Diagram showing' if diagram else 'Photo of' if photo else 'Image of'} {about}"
    return f"{'Diagram' if diagram else 'Photo' if photo else 'Image'} related to this content"


def is_decorative(img: Node) -> bool:
    """By role, by class, as both sides are small, or by the class of a block around it."""
    if img.attrs.get("role") in DECORATIVE_ROLES or any(w in img.attrs.get("class", "").lower() for w in DECORATIVE_CLASSES):
        return True
    sides = [img.attrs.get(k, "").strip() for k in ("width", "height")]
    if all(re.fullmatch(r"[+-]?\d+", s) and int(s) <= DECORATIVE_SIZE for s in sides):
        return True
    return img.up is not None and img.up.name == "div" and any(w in img.up.attrs.get("class", "").lower() for w in DECORATIVE_PARENTS)


def scope_for(table: Node, th: Node) -> str:
    """col or row: by the table's head, the first row, the first cell of a row, then by role and class."""
    row = th.above("tr")
    if row is None or row.name != "tr" or (row.up is not None and row.up.name == "thead"):
        return "col"
    rows = table.all("tr")
    if rows and rows[0] is row:
        return "col"
    cells = row.all("td", "th")
    if cells and cells[0] is th:
        return "row"
    hints = " ".join([th.attrs.get("role", ""), th.attrs.get("class", "")]).lower()
    return "row" if "rowhead" in hints else "col"


def id_for(text: str, number: int) -> str:
    if not text:
        return f"th-{number}"
    slug = "".join(c if c.isalnum() else "-" for c in text.lower())
    return f"th-{(slug if slug[0].isalpha() else f'header-{number}')[:20]}"


Rule = Callable[[Node, Node], str | None]


def _body(root: Node) -> Node:
    return root.first("body") or root


def fix_alt(root: Node, n: Node) -> str | None:
    """Without a model, a missing or empty text is told to be unavailable, a generic one filled in; a long one needs a model."""
    alt = n.attrs.get("alt")
    if alt is None:
        n.attrs["alt"] = NO_DESCRIPTION
    elif not alt.strip():
        if is_decorative(n):
            n.attrs |= {"alt": "", "role": "presentation"}
            return "marked as decorative"
        n.attrs["alt"] = NO_DESCRIPTION
    else:
        n.attrs["alt"] = alt_for(root, n, alt.strip().lower())
    return "alternative text written"


def fix_long_alt(root: Node, n: Node) -> str | None:
    return None


def fix_empty_link(root: Node, n: Node) -> str | None:
    href = n.attrs.get("href", "")
    n.set_text(f"Link to {(domain_of(href) if href.startswith('http') else '') or href}")
    return "link text written"


def fix_generic_link(root: Node, n: Node) -> str | None:
    href, text = n.attrs.get("href", ""), n.text()
    if text.lower() not in REPAIRED_LINKS:
        return None
    if href.startswith("http") and (where := domain_of(href)):
        n.set_text(f"Visit {where} website")
        return "link text written"
    around = n.up.text().replace(text, "").strip() if n.up is not None and n.up.name not in ("body", "") else ""
    if around:
        n.set_text(f"More about {around[:30].strip()}{'...' if len(around) > 30 else ''}")
    else:
        n.set_text(LINK_TEXTS.get(text.lower(), OTHER_LINK_TEXT))
    return "link text written"


def fix_url_link(root: Node, n: Node) -> str | None:
    text = n.text()
    if not text.startswith(("http://", "https://", "www.")):
        return None
    where = domain_of(text)
    n.set_text(f"Visit {where}" if where else URL_TEXT)
    return "link text written"


def fix_new_window(root: Node, n: Node) -> str | None:
    text = n.text()
    if "new window" in text.lower() or "new tab" in text.lower():
        return None
    hint = Node("span", {"class": "sr-only"})
    hint.set_text(" (opens in new window)")
    n.add(hint)
    if not n.attrs.get("title"):
        n.attrs["title"] = f"{text} (opens in new window)"
    return "warning added"


def fix_table_heads(root: Node, n: Node) -> str | None:
    rows = n.all("tr")
    for c in rows[0].all("td") if rows else []:
        c.name = "th"
        c.attrs["scope"] = "col"
    return "first row made headers" if rows else None


def fix_scopes(root: Node, n: Node) -> str | None:
    table = n if n.name == "table" else n.above("table")
    heads = [h for h in (table.all("th") if table is not None else []) if "scope" not in h.attrs]
    for h in heads:
        h.attrs["scope"] = scope_for(table, h)
    return "scopes set" if heads or table is not None else None


def fix_caption(root: Node, n: Node) -> str | None:
    if n.first("caption") is None:
        c = Node("caption")
        c.set_text(heading_before(root, n) or DEFAULT_CAPTION)
        n.add(c, 0)
    return "caption added"


def fix_thead(root: Node, n: Node) -> str | None:
    rows = n.all("tr")
    if not rows:
        return None
    if n.first("thead") is None:
        head = Node("thead")
        n.add(head, 1 if n.first("caption") is not None else 0)
        if not rows[0].all("th"):
            for c in rows[0].all("td"):
                c.name = "th"
        head.add(rows[0])
    return "head made of the first row"


def fix_tbody(root: Node, n: Node) -> str | None:
    if n.first("tbody") is None:
        body = Node("tbody")
        for r in [r for r in n.all("tr") if r.above("thead", "tfoot", "table") is n]:
            body.add(r)
        n.add(body)
    return "body made of the other rows"


def fix_header_ids(root: Node, n: Node) -> str | None:
    heads = n.all("th")
    if not heads:
        return None
    for i, h in enumerate(heads, 1):
        h.attrs.setdefault("id", id_for(h.text(), i))
    place = {}
    rows = n.all("tr")
    for r, row in enumerate(rows):
        for c, cell in enumerate(row.all("td", "th")):
            if cell.name == "th":
                place[r, c] = cell.attrs["id"]
    for r, row in enumerate(rows):
        for c, cell in enumerate(row.all("td")):
            own = [place[k] for k in ((0, c), (r, 0)) if k in place]
            if own:
                cell.attrs["headers"] = " ".join(own)
    return "header cells linked"


def fix_no_h1(root: Node, n: Node) -> str | None:
    if root.first("h1") is None:
        title = root.first("title")
        h = Node("h1")
        h.set_text((title.text() if title is not None else "") or DEFAULT_TITLE)
        (root.first("header") or root.first("main") or _body(root)).add(h, 0)
    return "first heading added"


def fix_no_headings(root: Node, n: Node) -> str | None:
    fix_no_h1(root, n)
    bold = [p for p in root.all("p") if (k := [x for x in p.kids if isinstance(x, Node) or x.strip()]) and len(k) == 1 and isinstance(k[0], Node) and k[0].name in ("b", "strong")]
    short = [d for d in root.all("div") if 0 < len(d.text()) < 60 and not d.all("div", "p", "table", "ul", "form", "img")]
    for x in [*bold, *short][:MOST_HEADINGS]:
        x.name = "h2"
    return "headings made"


def fix_skipped(root: Node, n: Node) -> str | None:
    """Puts the levels between in front of a heading, and does so in the order levels are looked at."""
    level = int(n.name[1])
    have = {int(h.name[1]) for h in root.all("h1", "h2", "h3", "h4", "h5", "h6")}
    for k in range(max((x for x in have if x < level), default=0) + 1, level):
        h = Node(f"h{k}")
        h.set_text(n.text() or "Section")
        n.up.add(h, n.up.kids.index(n))
    return "levels filled in"


def fix_heading_text(root: Node, n: Node) -> str | None:
    """The beginning of the next paragraph, else of the other text of the section, else a name by level and place."""
    if n.text() and not re.match(GENERIC_HEADING, n.text(), re.I):
        return None
    level, order = int(n.name[1]), list(root.walk())
    rest = order[next(i for i, x in enumerate(order) if x is n) + 1 :]
    about = next((x.text() for x in rest if x.name == "p"), "")[:100]
    row = n.up.kids
    at = next(i for i, k in enumerate(row) if k is n)
    if not about:
        end = next((x for x in rest if re.fullmatch("h[1-6]", x.name) and int(x.name[1]) <= level), None)
        texts = []
        for k in row[at + 1 :]:
            if k is end:
                break
            if isinstance(k, Node) and k.text():
                texts.append(k.text())
        about = " ".join(texts)[:100]
    words = about.split()
    before = sum(1 for k in row[:at] if isinstance(k, Node) and k.name == n.name)
    n.set_text((" ".join(words[:5]) + "..." if len(words) > 5 else about) if about else "Document Title" if level == 1 else f"Section {before + 1}")
    return "heading written"


def _landmark(tag: str, role: str, make: Callable[[Node, Node], None]) -> Rule:
    def fix(root: Node, n: Node) -> str | None:
        if root.first(tag) is not None or any(x.attrs.get("role") == role for x in root.walk()):
            return "already there"
        make(root, _body(root))
        return f"{tag} added"

    return fix


def _make_main(root: Node, body: Node) -> None:
    main = Node("main", {"id": "main-content"})
    for k in [k for k in body.kids if not (isinstance(k, Node) and k.name in ("header", "nav", "footer", "script"))]:
        if isinstance(k, Node):
            main.add(k)
        else:
            body.kids.remove(k)
            main.kids.append(k)
    body.add(main)


def _make_nav(root: Node, body: Node) -> None:
    for a in root.all("a"):
        row = [k for k in a.up.kids if isinstance(k, Node)]
        i = row.index(a)
        if i + 1 < len(row) and row[i + 1].name == "a" and a.up.name not in ("html", "head"):
            nav, at = Node("nav"), a.up.kids.index(a)
            home = a.up
            home.add(nav, at)
            for x in row[i:]:
                if x.name != "a":
                    break
                nav.add(x)
            return
    body.add(Node("nav", {"aria-label": "Main"}), 0)


def fix_skip_link(root: Node, n: Node) -> str | None:
    main = root.first("main")
    if main is None:
        _make_main(root, _body(root))
        main = root.first("main")
    main.attrs.setdefault("id", "main-content")
    a = Node("a", {"href": f"#{main.attrs['id']}", "class": "skip-link"})
    a.set_text(SKIP_TEXT)
    _body(root).add(a, 0)
    return "skip link added"


def fix_title(root: Node, n: Node) -> str | None:
    title = root.first("title")
    if title is None:
        head = root.first("head")
        if head is None:
            head = Node("head")
            (root.first("html") or root).add(head, 0)
        title = Node("title")
        head.add(title)
    h1 = root.first("h1")
    meta = next((m.attrs.get("content", "") for m in root.all("meta") if m.attrs.get("name", "").lower() == "description"), "")
    title.set_text((h1.text() if h1 is not None else "") or meta[:60] or DEFAULT_TITLE)
    return "title written"


def fix_language(root: Node, n: Node) -> str | None:
    tag = root.first("html")
    if tag is None:
        return None
    tag.attrs["lang"] = DEFAULT_LANGUAGE
    return "language set"


def fix_label(root: Node, n: Node) -> str | None:
    name = n.attrs.get("name") or n.attrs.get("id") or n.attrs.get("placeholder") or n.attrs.get("type") or n.name
    n.attrs["aria-label"] = " ".join(w.capitalize() for w in re.split("[_-]", name))
    return "label added"


def fix_name(root: Node, n: Node) -> str | None:
    n.attrs["name"] = n.attrs.get("id") or f"{n.name}-{n.pre}"
    return "name added"


def fix_required(root: Node, n: Node) -> str | None:
    n.attrs["aria-required"] = "true"
    label = next((x for x in root.all("label") if n.attrs.get("id") and x.attrs.get("for") == n.attrs["id"]), None) or n.above("label")
    if label is None:
        label = Node("label")
        home, at = n.up, n.up.kids.index(n)
        home.add(label, at)
        label.set_text(n.attrs.get("aria-label", ""))
        label.add(n)
    label.kids.insert(0, "* ")
    return "marked as required"


def fix_legend(root: Node, n: Node) -> str | None:
    old = n.first("legend")
    if old is None:
        old = Node("legend")
        n.add(old, 0)
    old.set_text("Options")
    return "legend added"


def fix_fieldset(root: Node, n: Node) -> str | None:
    form = n.above("form") or n.up
    same = [x for x in form.all("input") if x.attrs.get("type") == n.attrs.get("type") and (x.attrs.get("type") == "checkbox" or x.attrs.get("name") == n.attrs.get("name"))]
    box = Node("fieldset")
    home, at = n.up, n.up.kids.index(n)
    home.add(box, at)
    legend = Node("legend")
    legend.set_text(" ".join(w.capitalize() for w in re.split("[_-]", n.attrs.get("name", "options"))))
    box.add(legend)
    for x in same:
        box.add(x.above("label") if x.above("label") is not None else x)
    return "grouped"


def fix_figure(root: Node, n: Node) -> str | None:
    caption = n.first("figcaption")
    if caption is None:
        caption = Node("figcaption")
        n.add(caption)
    img = n.first("img")
    words = re.findall("[A-Za-z0-9]+", re.sub(r"\.[^.]*$", "", (img.attrs.get("src", "") if img is not None else "").rsplit("/", 1)[-1]))
    caption.set_text((img.attrs.get("alt", "").strip() if img is not None else "") or heading_before(root, n) or " ".join(w.capitalize() for w in words) or "Figure")
    return "caption added"


def fix_contrast(root: Node, n: Node) -> str | None:
    """Black on bright backgrounds, white on dark ones."""
    p, back = n, "#ffffff"
    while p is not None:
        if m := re.search(r"background-color:\s*(#[0-9a-fA-F]{6})", p.attrs.get("style", "")):
            back = m[1]
            break
        p = p.up
    r, g, b = (int(back[i : i + 2], 16) for i in (1, 3, 5))
    text = "#ffffff" if (0.299 * r + 0.587 * g + 0.114 * b) / 255 < 0.5 else "#000000"
    rest = re.sub(r"(?<![-\w])color:[^;]*;?", "", n.attrs.get("style", "")).strip()
    n.attrs["style"] = f"color:{text};{rest}"  # the colour comes first, so that a background isn't taken for it
    return "colour set"


def fix_text_label(root: Node, n: Node) -> str | None:
    n.set_text(n.attrs.get("for", "").replace("-", " ").replace("_", " ").strip().capitalize() or "Field")
    return "label written"


#: What repairs each type of issue.
RULES: dict[str, Rule] = {
    "missing-alt-text": fix_alt, "empty-alt-text": fix_alt, "generic-alt-text": fix_alt, "long-alt-text": fix_long_alt, "empty-link-text": fix_empty_link, "generic-link-text": fix_generic_link, "url-as-link-text": fix_url_link,
    "new-window-link-no-warning": fix_new_window, "table-missing-headers": fix_table_heads, "table-missing-scope": fix_scopes, "table-irregular-headers": fix_scopes, "table-missing-caption": fix_caption,
    "table-missing-thead": fix_thead, "table-missing-tbody": fix_tbody, "table-missing-headers-id": fix_header_ids, "no-h1": fix_no_h1, "no-headings": fix_no_headings, "skipped-heading-level": fix_skipped,
    "empty-heading": fix_heading_text, "generic-heading": fix_heading_text, "missing-main-landmark": _landmark("main", "main", _make_main), "missing-navigation-landmark": _landmark("nav", "navigation", _make_nav),
    "missing-header-landmark": _landmark("header", "banner", lambda root, body: body.add(Node("header"), 0)), "missing-footer-landmark": _landmark("footer", "contentinfo", lambda root, body: body.add(Node("footer"))),
    "missing-skip-link": fix_skip_link, "missing-title": fix_title, "empty-title": fix_title, "generic-title": fix_title, "missing-document-language": fix_language, "invalid-document-language": fix_language,
    "form-control-missing-label": fix_label, "form-control-missing-name": fix_name, "form-label-empty": fix_text_label, "form-required-field-missing-aria": fix_required, "form-required-field-not-indicated": fix_required,
    "form-fieldset-missing-legend": fix_legend, "form-related-controls-no-fieldset": fix_fieldset, "missing-figure-caption": fix_figure, "empty-figure-caption": fix_figure, "insufficient-color-contrast": fix_contrast,
}


def repaired(html: str | None, issues: list[tuple[str, str, int | None]]) -> tuple[str, list[dict]]:
    """(document, what became of each issue) for issues (id, type, node_pre) in order.

    A type without a rule is skipped; an element that isn't there, or a rule that finds nothing to do, fails.
    """
    root = build(html)
    by_pre = {n.pre: n for n in root.walk()}
    details = []
    for issue_id, kind, pre in issues:
        rule = RULES.get(kind)
        node = root if pre is None else by_pre.get(pre)
        said = rule(root, node) if rule is not None and node is not None else None
        details.append({"id": issue_id, "type": kind, "status": "remediated" if said else "failed" if rule else "skipped", "message": said})
    return root.html(), details


def _rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if pdf.empty:
            continue
        done = [repaired(h, [(i["id"], i["type"], i["node_pre"]) for i in (todo if todo is not None else [])]) for h, todo in zip(pdf["html"], pdf["todo"])]
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "file_path": pdf["file_path"], "html": [d[0] for d in done], "details": [d[1] for d in done]})


def remediate(pages: DataFrame, issues: DataFrame, severity_threshold: str = "minor", issue_types: list[str] | None = None, max_issues: int | None = None) -> DataFrame:
    """(doc_id, file_path, html, details) of pages repaired by their issues.

    `max_issues` takes the first issues of each document before types and severities are looked at. A document without issues
    comes back as it was written anew; issues of unknown documents are left out. Issues need no numbers; without them, their results have no id.
    """
    arrow_batches(pages.sparkSession)
    todo = issues.where(F.col("remediation_status") == "needs_remediation")
    if "issue_seq" not in issues.columns:
        todo = todo.withColumns({"issue_seq": F.lit(None).cast("bigint"), "id": F.lit(None).cast("string")})
    entry = F.struct("check_ord", "emit_ord", F.coalesce("issue_seq", F.lit(0)).alias("seq"), "id", "type", "severity", "node_pre")
    listed = todo.groupBy("doc_id").agg(F.sort_array(F.collect_list(entry)).alias("todo"))
    if max_issues is not None:
        listed = listed.withColumn("todo", F.slice("todo", 1, max_issues))
    wanted = lambda x: passes(x.severity, F.lit("needs_remediation"), severity_threshold) & (x.type.isin(issue_types) if issue_types is not None else F.lit(True))
    listed = listed.withColumn("todo", F.filter("todo", wanted))
    whole = pages.select("doc_id", "file_path", "html").join(listed, "doc_id", "left")
    return whole.mapInPandas(_rewrite, "doc_id bigint, file_path string, html string, details array<struct<id string, type string, status string, message string>>")
