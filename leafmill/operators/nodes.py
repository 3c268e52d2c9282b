"""Pages as rows of nodes: a row for each tag and text, with the element it stands in and where its own element ends.

nodes() reads markup as browsers do where end tags are left out: an element ends where another begins that it can't hold,
or where the element around it ends. Changes fill columns of the rows: attrs (with changed), gone, after; serialise()
joins what is left. Rows of a page share _page, the number of its row in the input, so pages may share an id. All windows
are parted by _page first, so pages are shuffled once.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from leafmill.functions.text import SPACE
from leafmill.operators.staging import dealt

#: Elements without an end tag. Fixed values.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Elements whose content is text up to their end tag. Fixed values.
PLAIN = ("script", "style", "textarea", "title")
_BLOCKS = "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt"
_CELLS, _GROUPS = ("td", "th"), ("thead", "tbody", "tfoot", "caption", "colgroup")
#: Which open elements a start tag ends, and those that it does not look beyond. Fixed values of the markup language.
ENDS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {name: (("p",), ("table", "td", "th", "caption", "button", "object")) for name in _BLOCKS.split()}
ENDS |= {"li": (("li", "p"), ("ol", "ul", "menu", "table", "td", "th", "caption", "button", "object")), "option": (("option",), ("select",)), "optgroup": (("option", "optgroup"), ("select",))}
ENDS |= {name: (("dt", "dd", "p"), ("dl", "table", "td", "th", "caption", "button", "object")) for name in ("dt", "dd")}
ENDS |= {name: (_CELLS, ("tr", "table")) for name in _CELLS}
ENDS |= {"tr": (("tr", *_CELLS, "caption", "colgroup"), ("table",)), "body": (("head",), ())}
ENDS |= {name: ((*_GROUPS, "tr", *_CELLS), ("table",)) for name in _GROUPS}
#: What an end tag does not look beyond; other names stop at cells and tables.
LIMITS: dict[str, tuple[str, ...]] = {"li": ("ol", "ul", "menu", "td", "th", "caption", "table"), "table": (), "html": (), "body": ()}
LIMITS |= {name: ("table",) for name in (*_CELLS, *_GROUPS, "tr")}
_LIMIT = ("td", "th", "caption", "table")
#: Elements of which each node names the nearest around it, itself included.
AROUND = {"head": ("head",), "list": ("ol", "ul"), "item": ("li",), "table": ("table",), "row": ("tr",), "cell": ("td", "th"), "division": ("div",), "paragraph": ("p",)}
_SAID = ("td", "th", "p")

#: A tag ends at the first > outside of quoted values.
TOKEN = r"""(?s)<!--.*?-->|<!.*?>|</?[A-Za-z](?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+>|[^<]+|<"""
_NAME = r"^</?([A-Za-z][A-Za-z0-9:-]*)"
_TEXTS, _FLAGS = ("raw", "name", "kind", "up", "upper", "listed", "said"), ("closed",)
_FIELDS = ("raw", "name", "kind", "parent", "depth", "up", "upper", "listed", "end", "closed", "nth", "inside", "said", *AROUND)
_NODE = StructType([StructField(c, ArrayType(StringType() if c in _TEXTS else BooleanType() if c in _FLAGS else IntegerType())) for c in _FIELDS])


def matched(kinds: list[str], names: list[str], raws: list[str], counted: list[bool]) -> dict[str, list]:
    """Of each token, as a list for each field: its kind, the element it stands in, and of an element its last token,
    whether its end tag is there, its number among its parent's elements of that name (cells are of one), names of its
    parent, of that one's and of the nearest list, how many elements are around it, how many tokens counted it holds, and
    the text of cells and paragraphs."""
    n = len(kinds)
    kind, parent, end = list(kinds), [-1] * n, list(range(n))
    depth, nth, inside, closed, said = [0] * n, [0] * n, [0] * n, [False] * n, [None] * n
    near: list[tuple[int, ...]] = []  # positions of the nearest elements around, by the order of AROUND
    nowhere = (-1,) * len(AROUND)
    column = {name: k for k, some in enumerate(AROUND.values()) for name in some}
    lists = list(AROUND).index("list")
    stack: list[int] = []
    seen: list[dict[str, int]] = [{}]
    total, totals = 0, []
    plain = None

    def leave(to: int, last: int) -> None:
        for i in stack[to:]:
            end[i] = last
        del stack[to:], seen[to + 1 :]

    def outermost(some: tuple[str, ...], limits: tuple[str, ...], nearest: bool = False) -> int:
        """Where on the stack, above the limits, the outermost (or the nearest) element of some names is; -1 if none."""
        found = -1
        for d in range(len(stack) - 1, -1, -1):
            name = names[stack[d]]
            if name in some:
                found = d
                if nearest:
                    return d
            if name in limits:
                break
        return found

    for i, name in enumerate(names):
        k = kind[i]
        if plain and not (k == "close" and name == plain):
            kind[i] = k = "text"
        elif k in ("open", "void") and name:
            if name in ENDS and (d := outermost(*ENDS[name])) >= 0:
                leave(d, i - 1)
            if stack and names[stack[-1]] == "head" and name not in ("meta", "title", "link", "style", "script", "base", "noscript", "template"):
                leave(len(stack) - 1, i - 1)
        at = stack[-1] if stack else -1
        if k == "close":
            d = outermost((name,), LIMITS.get(name, _LIMIT), True)
            if d < 0:
                kind[i] = "stray"
            else:
                leave(d + 1, i - 1)
                at = stack[d]
                closed[at] = True
                leave(d, i)
                plain = None
        parent[i], depth[i] = at, len(stack) + (kind[i] == "close")
        around = near[at] if at >= 0 else nowhere
        if k in ("open", "void") and name:
            group = "td" if name == "th" else name
            nth[i] = seen[-1].get(group, 0)
            seen[-1][group] = nth[i] + 1
            if k == "open":
                stack.append(i)
                seen.append({})
                if name in column:
                    around = (*around[: column[name]], i, *around[column[name] + 1 :])
                if name in PLAIN:
                    plain = name
        near.append(around)
        total += bool(counted[i])
        totals.append(total)
    leave(0, n - 1)
    for i in range(n):
        if kind[i] == "open":
            inside[i] = totals[end[i]] - totals[i]
            if names[i] in _SAID:
                said[i] = "".join(raws[k] for k in range(i + 1, end[i] + 1) if kind[k] == "text")
    up = [names[p] if p >= 0 else "" for p in parent]
    # the nearest list of a list's own tag is the one around it, for names
    listed = [names[j] if (j := (near[p][lists] if p >= 0 else -1)) >= 0 else "" for p in parent]
    out = {"kind": kind, "parent": parent, "depth": depth, "up": up, "upper": [up[p] if p >= 0 else "" for p in parent], "listed": listed, "end": end, "closed": closed, "nth": nth, "inside": inside, "said": said}
    return out | dict(zip(AROUND, map(list, zip(*near, strict=True)) if n else [[]] * len(AROUND), strict=True))


_FOUND, _NAMED = re.compile(TOKEN, re.A), re.compile(_NAME)
_MEDIA = ("img", "video", "audio", "canvas", "svg", "object", "embed", "iframe", "table")
_NBSP, _SEEN = re.compile("&nbsp;", re.I | re.A), re.compile(f"[^{SPACE[1:-1]}]".replace(r"\x{", r"\u").replace("}", "").replace(r"\u00A0", r"\xA0"), re.A)


def tokens(html: str) -> tuple[list[str], list[str], list[str], list[bool]]:
    """Of each token of markup its kind, name and text, and whether it counts: media, tables and texts that are not blank do."""
    kinds, names, raws, counted = [], [], _FOUND.findall(html), []
    for r in raws:
        name = m[1].lower() if r[0] == "<" and (m := _NAMED.match(r)) else ""
        names.append(name)
        if r[0] != "<" or r == "<":
            kinds.append("text")
            counted.append(_SEEN.search(_NBSP.sub(" ", r) if "&" in r else r) is not None)
            continue
        close = r[1] == "/"
        kinds.append("close" if close else "void" if not name or name in VOID or r[-2] == "/" else "open")
        counted.append(not close and name in _MEDIA)
    return kinds, names, raws, counted


#: Characters of pages that are turned into arrays at a time. A limit of a task's memory; it decides nothing.
_AT_ONCE = 1 << 18


@F.arrow_udf(_NODE)
def _matched(pages: pa.Array) -> pa.Array:
    types = [f.type for f in to_arrow_type(_NODE)]
    parts, held, sizes, size = [], {c: [] for c in _FIELDS}, [0], 0

    def put() -> None:
        ends = pa.array(sizes, pa.int32())
        parts.append(pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(held[c], t.value_type)).cast(t) for c, t in zip(_FIELDS, types, strict=True)], list(_FIELDS)))
        for c in _FIELDS:
            held[c].clear()

    for text in pages:
        html = text.as_py() or ""
        kinds, names, raws, counted = tokens(html)
        made = matched(kinds, names, raws, counted)
        made["raw"], made["name"] = raws, ["" if k == "text" else n for k, n in zip(made["kind"], names, strict=True)]
        for c in _FIELDS:
            held[c].extend(made[c])
        sizes.append(sizes[-1] + len(raws))
        size += len(html)
        if size >= _AT_ONCE:
            put()
            sizes, size = [0], 0
    if len(sizes) > 1 or not parts:
        put()
    return pa.concat_arrays(parts)


def nodes(pages: DataFrame, html: str) -> DataFrame:
    """A row for each tag, text, comment and declaration of pages, in order (pos), with the columns of pages but html.

    kind: open, void (no end tag, or no name), close, stray (an end tag of nothing open), text. parent: position of the
    element that holds it, -1 for none; up, upper: that one's name, and that of the one around it; depth: how many elements are around; listed: the name of the nearest list around; an end tag is held
    by its own element. end: the last position of an element, its
    end tag if it has one (closed). attrs: a tag's attributes. Null or empty markup gives one row without pos. Ids may be
    null or repeat. Pages are dealt by _page before they are taken apart, so all that follows needs no other shuffle. Columns of pages should not have names of these.
    """
    kept = [F.col(f"`{c}`") for c in pages.columns if c != html]
    found = dealt(pages.select(F.monotonically_increasing_id().alias("_page"), *kept, F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("_text")), "_page")
    found = found.select("_page", *kept, _matched("_text").alias("_node"))
    parts = F.arrays_zip(*[F.col(f"_node.{c}").alias(c) for c in _FIELDS])
    rows = found.select("_page", *kept, F.posexplode_outer(parts).alias("pos", "_t")).select("_page", *kept, "pos", "_t.*")
    tag = F.col("kind").isin("open", "void") & (F.col("name") != "")
    return rows.withColumns({"attrs": F.when(tag, attributes(F.col("raw"))), "changed": F.lit(False), "gone": F.lit(False), "after": F.lit("")})


# ---- attributes


def attributes(raw: Column) -> Column:
    """array<struct<name, value, text>> of a tag, in order: name in small letters, value as written without its quotes, null where none is given."""
    body = F.regexp_replace(F.regexp_replace(raw, r"^<[A-Za-z][A-Za-z0-9:-]*", ""), r"\s*/?>$", "")
    parts = F.regexp_extract_all(body, F.lit(r"""[^\s/=][^\s/=]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|\S+))?"""), F.lit(0))
    value = lambda p: F.regexp_extract(p, r"(?s)^[^=]*=\s*(.*)$", 1)
    bare = lambda v: F.when(v.rlike("""^["']"""), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return F.transform(parts, lambda p: F.struct(F.lower(F.rtrim(F.substring_index(p, "=", 1))).alias("name"), F.when(F.contains(p, F.lit("=")), bare(value(p))).alias("value"), p.alias("text")))


def get(attrs: Column, name: str) -> Column:
    """The value of the first attribute of a name, empty where none is given; null where there is no such attribute."""
    own = F.get(F.filter(attrs, lambda a: a["name"] == name), 0)
    return F.when(own.isNotNull(), F.coalesce(own["value"], F.lit("")))


def drop(attrs: Column, name: str) -> Column:
    return F.filter(attrs, lambda a: a["name"] != name)


def put(attrs: Column, name: str, value: Column) -> Column:
    """The attribute goes from where it stood and comes last."""
    text = F.concat(F.lit(f'{name}="'), F.replace(value, F.lit('"'), F.lit("&quot;")), F.lit('"'))
    return F.array_append(drop(attrs, name), F.struct(F.lit(name).alias("name"), value.alias("value"), text.alias("text")))


def put_classes(attrs: Column, names: Column) -> Column:
    """More classes, each once, in order."""
    have = F.filter(F.split(F.coalesce(get(attrs, "class"), F.lit("")), r"\s+"), lambda c: c != "")
    return put(attrs, "class", F.array_join(F.array_union(have, names), " "))


def has_class(attrs: Column, name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(get(attrs, "class"), F.lit("")), r"\s+"), name)


def set_attrs(rows: DataFrame, when: Column, attrs: Column) -> DataFrame:
    """New attributes for the nodes where when holds; null counts as false."""
    when = F.coalesce(when, F.lit(False))
    return rows.withColumns({"attrs": F.when(when, attrs).otherwise(F.col("attrs")), "changed": F.col("changed") | when})


def tag_text() -> Column:
    """A node as text, with what comes after it."""
    start = F.regexp_extract("raw", r"^<[A-Za-z][A-Za-z0-9:-]*", 0)
    whole = F.concat(start, F.array_join(F.transform("attrs", lambda a: F.concat(F.lit(" "), a["text"])), ""), F.regexp_extract("raw", r"/?>$", 0))
    return F.concat(F.when(F.col("changed"), whole).otherwise(F.col("raw")), F.col("after"))


# ---- rows of a page

def page_window():
    return Window.partitionBy("_page").orderBy("pos")


def within(test: Column) -> Column:
    """Whether a node stands in an element, not itself, for which test holds."""
    ends = F.max(F.when(test, F.col("end"))).over(page_window().rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(ends >= F.col("pos"), F.lit(False))


def is_open(*names: str) -> Column:
    return (F.col("kind") == "open") & F.col("name").isin(*names)


def settle(rows: DataFrame, deep: bool = True) -> DataFrame:
    """Nodes that are gone, and if deep what they hold, become nodes of kind gone, without name, text or attributes; their counts stay."""
    out = F.col("gone") | F.col("_in")
    rows = rows.withColumn("_in", within(F.col("gone")) if deep else F.lit(False))
    rows = rows.withColumns({"gone": out, "kind": F.when(out, "gone").otherwise(F.col("kind")), **{c: F.when(out, "").otherwise(F.col(c)) for c in ("name", "raw", "after")}, "attrs": F.when(~out, F.col("attrs")), "changed": F.col("changed") & ~out})
    return rows.drop("_in")


def serialise(rows: DataFrame, *columns: str) -> DataFrame:
    """(columns, html): each page's nodes in order; an empty text for pages without any."""
    parts = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", tag_text().alias("text")))))
    return rows.groupBy("_page").agg(*[F.first(c).alias(c) for c in columns], F.array_join(F.transform(parts, lambda t: t["text"]), "").alias("html")).drop("_page")


# ---- selectors


def _compound(text: str) -> Column:
    """Test of a selector without combinators: element, .class, #id, [attribute] and [attribute=value], in any number."""
    if not re.fullmatch(r"""(\*|[A-Za-z][\w-]*)?([.#][\w-]+|\[\s*[\w:-]+\s*(=\s*("[^"]*"|'[^']*'|[^\]\s"']+)\s*)?\])*""", text) or not text:
        raise ValueError(f"selector {text!r} is not supported")
    test = F.col("kind").isin("open", "void") & (F.col("name") != "")
    for part in re.findall(r"""^[\w*-]+|[.#][\w-]+|\[[^\]]*\]""", text):
        if part[0] == ".":
            test &= has_class(F.col("attrs"), part[1:])
        elif part[0] == "#":
            test &= get(F.col("attrs"), "id") == part[1:]
        elif part[0] == "[":
            name, _, value = part[1:-1].partition("=")
            own = get(F.col("attrs"), name.strip().lower())
            test &= own == value.strip().strip("\"'") if value else own.isNotNull()
        elif part != "*":
            test &= F.col("name") == part.lower()
    return F.coalesce(test, F.lit(False))


def select(rows: DataFrame, selector: str, out: str) -> DataFrame:
    """Adds out: whether a node is selected. Selectors may be listed with commas; a blank stands for any depth, > for one step."""
    found = []
    for k, one in enumerate(selector.split(",")):
        steps = one.replace(">", " > ").split()
        if not steps or ">" in (steps[0], steps[-1]):
            raise ValueError(f"selector {selector!r} is not supported")
        held = F.lit(True)
        for j, step in enumerate(steps):
            if step == ">":
                continue
            mine, around = f"_is{k}_{j}", f"_in{k}_{j}"
            rows = rows.withColumn(mine, _compound(step) & held)
            if j + 1 < len(steps):
                child = steps[j + 1] == ">"
                hits = F.collect_set(F.when(F.col(mine), F.col("pos"))).over(Window.partitionBy("_page"))
                rows = rows.withColumn(around, F.array_contains(hits, F.col("parent")) if child else within(F.col(mine)))
                held = F.col(around)
        found.append(F.col(mine))
    test = F.lit(False)
    for f in found:
        test = test | f
    return rows.withColumn(out, test).drop(*[c for c in rows.columns if c.startswith(("_is", "_in"))])
