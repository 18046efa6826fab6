"""Small HTML documents rendered from relational rows: every shape the checks tell apart, with an answer known from the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(key: Column, *shapes: Column) -> Column:
    return F.element_at(F.array(*shapes), (key % len(shapes) + 1).cast("int"))


def _page(body: Column, head: str = "<title>Catalogue of parts</title>") -> Column:
    return F.concat(F.lit(f'<html lang="en"><head>{head}</head><body>'), body, F.lit("</body></html>"))


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _documents(rows: DataFrame, key: str, html: Column, kind: str) -> DataFrame:
    return rows.select(F.col(key).cast("bigint").alias("doc_id"), F.concat(F.lit(f"out/{kind}/page-"), F.col(key), F.lit(".html")).alias("file_path"), html.alias("html"))


def images(part: DataFrame) -> DataFrame:
    """p_size % 6: no alt, empty, decorative, generic, named, blank but hidden."""
    src = F.concat(F.lit('<img src="i'), "p_partkey", F.lit('.png"'))
    shapes = [_say(src, ">"), _say(src, ' alt="">'), _say(src, ' alt="" role="presentation">'), _say(src, ' alt="Photo">'), _say(src, ' alt="', F.col("p_name"), '">'), _say(src, ' alt="  " aria-hidden="true"/>')]
    return _documents(part, "p_partkey", _page(_pick(F.col("p_size"), *shapes)), "img")


def figures(part: DataFrame) -> DataFrame:
    """p_size % 3: no caption, blank caption, caption."""
    shapes = [F.lit("<figure><img src='a.png'></figure>"), F.lit("<figure><img src='a.png'><figcaption> </figcaption></figure>"), _say("<figure><p><figcaption><b>", F.col("p_name"), "</b></figcaption></figure>")]
    return _documents(part, "p_partkey", _page(_pick(F.col("p_size"), *shapes)), "fig")


def headings(part: DataFrame) -> DataFrame:
    """p_size % 8 as a bitmap of the levels 1, 2 and 3, largest level first; p_size % 5 = 4 makes the last one empty, 3 generic."""
    text = F.when(F.col("p_size") % 5 == 4, " ").when(F.col("p_size") % 5 == 3, "Title").otherwise(F.col("p_name"))
    level = lambda n, bit: F.when(F.col("p_size").bitwiseAND(bit) > 0, _say(f"<h{n}>", text if n == 1 else F.lit("On parts"), f"</h{n}>")).otherwise("")
    return _documents(part, "p_partkey", _page(_say(level(3, 4), level(1, 1), level(2, 2))), "head")


def links(customer: DataFrame) -> DataFrame:
    """c_custkey % 9: empty, image link, generic, address, bare anchor, new window with and without a warning, external, plain; and two links of one text."""
    shapes = [
        '<a href="/a"> </a>', '<a href="/a"><img src="x.png" alt="Logo"></a>', '<a href="/a">Click Here</a>', '<a href="/a">www.example.test</a>', '<a href="#">top</a>',
        '<a href="/a" target="_blank">Terms (new window)</a>', '<a href="/a" target="_blank">Terms</a>', '<a href="/a" rel="nofollow external" target="_blank">Terms</a>', '<a href="/a">Price list</a>',
    ]
    two = F.when(F.col("c_nationkey") % 2 == 0, '<a href="/b">Order form</a><a href="/c">order FORM</a><a href="#">Order form</a>').otherwise('<a href="/b">Order form</a><a href="/b">Order form</a>')
    return _documents(customer, "c_custkey", _page(_say(_pick(F.col("c_custkey"), *map(F.lit, shapes)), two)), "link")


def tables(orders: DataFrame) -> DataFrame:
    """o_orderkey % 7: no heads, heads without scope, whole table, spans without ids, many rows, layout, an empty row."""
    many = "".join(f"<tr><td>{i}</td><td>b</td></tr>" for i in range(11))
    shapes = [
        "<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>",
        "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>",
        '<table><caption>c</caption><thead><tr><th scope="col">a</th><th scope="col">b</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>',
        '<table><thead><tr><th scope="col" colspan="2">a</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>',
        f"<table><tbody>{many}</tbody></table>",
        '<table role="presentation"><tr><td>a</td><td>b</td></tr><tr><td>1</td></tr></table>',
        "<table><tr><th>a</th><td>b</td></tr><tr></tr></table><table><tr><td>a</td><td>b</td></tr><tr><td>1</td></tr></table>",
    ]
    return _documents(orders, "o_orderkey", _page(_pick(F.col("o_orderkey"), *map(F.lit, shapes))), "table")


def forms(customer: DataFrame) -> DataFrame:
    """c_nationkey % 7: label for, wrapping label, aria-label, title, placeholder only, required marked and not, labelled by id."""
    shapes = [
        '<form><label for="n">Name</label><input id="n" name="n"></form>', '<form><label>Name <input name="n"></label></form>', '<form><input name="n" aria-label="Name"></form>',
        '<form><select title="Country"><option>a</option></select></form>', '<form><textarea placeholder="Text" required></textarea></form>',
        '<form><label for="n">Name *</label><input id="n" name="n" required aria-required="true"></form>', '<form><b id="x">Name</b><label></label><input name="n" aria-labelledby="y x" required><input type="hidden"></form>',
    ]
    return _documents(customer, "c_custkey", _page(_pick(F.col("c_nationkey"), *map(F.lit, shapes))), "form")


def groups(supplier: DataFrame) -> DataFrame:
    """s_suppkey % 5: radios outside and inside a fieldset, near and far checkboxes, fieldset without a legend."""
    radio = '<input type="radio" name="r" value="1"><input type="radio" name="r" value="2">'
    box = '<input type="checkbox" name="c">'
    deep = lambda s: f"<div><div><div><div>{s}</div></div></div></div>"
    shapes = [f"<form>{radio}</form>", f"<form><fieldset><legend>Pay</legend>{radio}</fieldset></form>", f"<form><p>{box}{box}{box}</p></form>", f"<form>{deep(box)}{deep(box)}{deep(box)}</form>", f"<form><fieldset>{radio}</fieldset></form>"]
    return _documents(supplier, "s_suppkey", _page(_pick(F.col("s_suppkey"), *map(F.lit, shapes))), "group")


def colours(part: DataFrame) -> DataFrame:
    """p_partkey % 6: grey on white, short and large text, rgb on an ancestor, background before colour, five digits."""
    shapes = [
        '<p style="color:#777777;background-color:#ffffff">text</p>', '<h2 style="color:#777">text</h2>', '<div style="background-color: rgb(0, 0, 128)"><span style="color:#000080">text</span></div>',
        '<p style="background-color:#fff;color:#000">text</p>', '<p style="color:#12345">text</p><p style="color:#eeeeee">later</p>', '<p style="color:#888888;font-size:20px;font-weight:bold">text</p><p>plain</p>',
    ]
    return _documents(part, "p_partkey", _page(_pick(F.col("p_partkey"), *map(F.lit, shapes))), "colour")
