"""HTML documents as trees in interval encoding: one row per document, its elements in an array.

Each element has `pre` (place in document order), `post` (last `pre` below it) and `parent`, so that descendants,
ancestors and neighbours are comparisons of integers and checks need no shuffle. Nesting is lenient: an unclosed tag
stays open, a stray end tag is ignored, void tags never enclose anything, scripts and styles are opaque.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pharos.runtime import arrow_batches, spread

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = ("script", "style")
SNIPPET = 500

NODE = (
    "struct<pre int, post int, parent int, depth int, name string, attrs map<string,string>, classes array<string>, text string,"
    " string_value string, nth int, idx int, total int, path string, page int, above array<int>, snippet string>"
)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.runs: list[tuple[int, str]] = []  # (innermost element, text) in document order
        self.open: list[int] = []
        self.kids: dict[tuple[int, str], int] = {}

    def _enter(self, name: str, attrs: list[tuple[str, str | None]]) -> int:
        parent = self.open[-1] if self.open else -1
        pre = len(self.nodes)
        own = {k: v if v is not None else "" for k, v in attrs}  # the last of repeated attributes wins
        nth = self.kids[parent, name] = self.kids.get((parent, name), 0) + 1
        self.nodes.append(
            {
                "pre": pre, "post": pre, "parent": parent, "depth": len(self.open) + 1, "name": name, "attrs": own, "classes": own.get("class", "").split(),
                "nth": nth, "above": list(self.open), "start": self.get_starttag_text() or "", "runs": [],
            }
        )
        return pre

    def handle_starttag(self, tag: str, attrs) -> None:
        pre = self._enter(tag, attrs)
        if tag not in VOID:
            self.open.append(pre)

    def handle_startendtag(self, tag: str, attrs) -> None:
        pre = self._enter(tag, attrs)
        if tag not in VOID:
            self.nodes[pre]["post"] = pre

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[i]]["name"] == tag:
                last = len(self.nodes) - 1
                for pre in self.open[i:]:
                    self.nodes[pre]["post"] = last
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.open:
            self.runs.append((self.open[-1], data))


def parse(html: str | None) -> list[dict]:
    """The elements of a document; an empty or null one has none."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    nodes = tree.nodes
    last = len(nodes) - 1
    for pre in tree.open:
        nodes[pre]["post"] = last
    for owner, data in tree.runs:
        holders = [owner] if nodes[owner]["name"] in OPAQUE else [*nodes[owner]["above"], owner]
        for pre in holders:
            nodes[pre]["runs"].append(data)
    child_elements: dict[int, int] = {}
    direct_runs: dict[int, int] = {}
    for n in nodes:
        child_elements[n["parent"]] = child_elements.get(n["parent"], 0) + 1
    for owner, _ in tree.runs:
        direct_runs[owner] = direct_runs.get(owner, 0) + 1
    of_name: dict[str, int] = {}
    for n in nodes:
        n["idx"] = of_name.get(n["name"], 0)
        of_name[n["name"]] = n["idx"] + 1
    for n in reversed(nodes):  # a single string is a lone text run, or the one of a lone child
        pre, runs, kids = n["pre"], direct_runs.get(n["pre"], 0), child_elements.get(n["pre"], 0)
        n["string_value"] = n["runs"][0] if runs == 1 and kids == 0 else nodes[pre + 1]["string_value"] if runs == 0 and kids == 1 else None
    for n in nodes:
        n["total"] = of_name[n["name"]]
        n["text"] = "".join(r.strip() for r in n["runs"])
        own = n["attrs"]
        if own.get("id"):
            n["step"] = f"{n['name']}#{own['id']}"
        elif n["classes"]:
            n["step"] = ".".join([n["name"], *n["classes"]])
        else:
            n["step"] = n["name"] if n["nth"] == 1 else f"{n['name']}:nth-of-type({n['nth']})"
        chain = [*n["above"], n["pre"]]
        first = max((i for i, p in enumerate(chain) if nodes[p]["attrs"].get("id")), default=None)
        n["path"] = " > ".join(nodes[p]["step"] for p in chain[first:]) if first is not None else " > ".join(["[document]", *(nodes[p]["step"] for p in chain)])
        n["page"] = _page(nodes, n)
        inner = "".join(n["runs"])
        n["snippet"] = (n["start"] + inner + ("" if n["name"] in VOID else f"</{n['name']}>"))[:SNIPPET]
        del n["start"], n["runs"]
    for n in nodes:
        del n["step"]
    return nodes


def _page(nodes: list[dict], n: dict) -> int | None:
    import re

    told = n["attrs"].get("data-page-number", "")
    if told.isdigit():
        return int(told)
    for p in reversed(n["above"]):
        if any("page" in c.lower() for c in nodes[p]["classes"]):
            for value in [*nodes[p]["classes"], nodes[p]["attrs"].get("id", "")]:
                if m := re.search(r"page[_-]?(\d+)", value.lower()):
                    return int(m[1])
            return None
    return None


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if pdf.empty:
            continue
        yield pdf.drop(columns="html").assign(nodes=[parse(h) for h in pdf["html"]])


def parsed(pages: DataFrame) -> DataFrame:
    """(doc_id, file_path, file_name, page_number, nodes) of pages given as (doc_id, file_path, html).

    The only Python stage of an audit; rows stay where they are read. The page number is that of the file name's end.
    """
    arrow_batches(pages.sparkSession)
    name = F.element_at(F.split(F.coalesce("file_path", F.lit("")), "/"), -1)
    number = F.regexp_extract(name, r"(?i)page[_-]?(\d+)\.html$", 1).try_cast("int")
    source = pages.select("doc_id", "file_path", name.alias("file_name"), number.alias("page_number"), "html")
    return spread(source).mapInPandas(_parsed, f"doc_id bigint, file_path string, file_name string, page_number int, nodes array<{NODE}>")


def flat_nodes(trees: DataFrame) -> DataFrame:
    """One row per element."""
    return trees.select("doc_id", F.inline("nodes"))


def read_html(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(doc_id, file_path, html) of the HTML files of a file or folder, ordered by path; `doc_id` is a hash of the path."""
    reader = spark.read.option("wholetext", True).option("pathGlobFilter", "*.[hH][tT][mM][lL]").option("recursiveFileLookup", recursive)
    return reader.text(path).select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.input_file_name().alias("file_path"), F.col("value").alias("html"))
